"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Document evidence. Two classifiers are fitted on a bounded sample of labelled rows (SAMPLE_ROWS, taken by a hash of
the doc_id): low quality, a logistic regression on style measures of the text; toxicity, a logistic regression on the summed weights (log likelihood
ratios) of the distinct terms that a text has from a learnt lexicon; a word counts by its heaviest term. A term is a lower-cased word or a word's first PREFIXES
bytes. Its support is counted over different texts, copies and near
copies once (by min-hashes of the sampled texts). A term enters the lexicon if its support alone is strong: STRONG texts, with a precision whose lower
confidence bound is BOUND. Of weaker terms, with MIN_SUPPORT texts at least (more in a large sample) and precision PRECISION, as few enter as cover the toxic rows that
no strong term covers, chosen greedily by the rows they newly cover. Candidates are all terms of the sample with that support, of
which toxic rows are BOUND at least. Both classifiers yield probabilities.

Hierarchy. A document's host is its source, its path is (source, lang). Evidence is summed by path and by host in map-side
combined aggregations. A host's posterior shrinks its mean evidence toward the global mean with a strength found from
the spread between hosts (method of moments); a path's shrinks toward its host's with a strength found from the spread of
paths within hosts. The log odds of a document move by the log odds of its path against the global ones; that posterior leaves the
document's own evidence out at both levels, so nothing counts twice. Documents with final probability above REJECT are rejected.

A text is scored once: its evidence is stored, posteriors are summed from what is stored and joined back to it.

Texts without words, or null, carry no evidence: their probability is their path's posterior. Null sources and langs are
values of their own. Without labels there is no lexicon and no style model, evidence is EPS everywhere, nothing is
rejected. Label rows with null doc_id are ignored; of repeated ones, the largest values count. Repeated document rows
are judged one by one, each with the others as evidence of its path. Very long texts are scored whole, as one row. Terms that cover
equally many rows are taken in the order of their hashes; a probability of exactly REJECT stays. Other columns pass through the filter untouched, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import _text as T
from ledgerloom.llm._spark import small, store, store_counted

SAMPLE_ROWS = 20_000
MIN_SUPPORT = 3
STRONG = 8
PRECISION = 0.9
#: Lower confidence bound of a strong term's precision, and the normal quantile that it is taken at.
BOUND, QUANTILE = 0.7, 1.64
#: A term needs a sample row in so many besides, so that chance finds of a large sample do not enter.
ROWS_PER_SUPPORT = 5_000
SIGNS = 4
REJECT = 0.5
EPS = 1e-4
PREFIXES = (4, 5, 6, 7, 8)

_CLASSES = [
    np.isin(np.arange(256), list(range(65, 91))),
    np.isin(np.arange(256), list(range(97, 123))) | (np.arange(256) >= 128),
    np.isin(np.arange(256), list(range(48, 58))),
    np.isin(np.arange(256), list(b".,;:'\"-()")),
    np.isin(np.arange(256), list(b"!?")),
    np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    np.isin(np.arange(256), list(b"\n")),
]


def style(raw: np.ndarray, words: T.Words, h: np.ndarray) -> np.ndarray:
    """Style measures (rows x measures)."""
    off = words.offsets
    size = np.maximum(np.diff(off), 1)
    cols = []
    for c in _CLASSES:
        run = np.concatenate([[0], np.cumsum(c[raw], dtype=np.int64)])
        cols.append((run[off[1:]] - run[off[:-1]]) / size)
    n = words.count
    lengths = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    mean = (lengths[words.row_ptr[1:]] - lengths[words.row_ptr[:-1]]) / np.maximum(n, 1)
    bare = np.zeros(256, bool)
    bare[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
    letters = np.concatenate([[0], np.cumsum(bare[raw], dtype=np.int64)])
    none = letters[words.ends] == letters[words.starts]
    junk = np.bincount(words.row[none], minlength=len(n)) / np.maximum(n, 1)
    order = np.lexsort((h, words.row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (words.row[order][1:] != words.row[order][:-1])
    distinct = np.bincount(words.row[order][new], minlength=len(n)) / np.maximum(n, 1)
    caps = cols[0] / np.maximum(cols[0] + cols[1], 1e-9)
    return np.column_stack([*cols, caps, caps > 0.5, mean, junk, distinct, np.log1p(n)]).astype(np.float64)


def terms(words: T.Words, h: np.ndarray) -> list[np.ndarray]:
    return [h, *(words.prefix_hashes(k) for k in PREFIXES)]


def _signs(words: T.Words, h: np.ndarray) -> np.ndarray:
    """SIGNS min-hashes of each row's words (rows x SIGNS); rows of equal or nearly equal texts share most of them."""
    out = np.zeros((len(words.count), SIGNS), np.int64)
    full = np.flatnonzero(words.count)
    for i in range(SIGNS if len(full) else 0):
        out[full, i] = np.minimum.reduceat(T.mix(h + np.uint64(i + 1)), words.row_ptr[full]).view(np.int64)
    return out


def _read(texts: pa.Array):
    raw, offsets = T.buffers(texts)
    for a, b in T.blocks(offsets):
        yield a, b, T.Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1], T.NON_SPACE, T.LOWER), raw[offsets[a] : offsets[b]]


def _term_counts(batches):
    """term, toxic and all rows of the sample that have it; columns text, quality, toxic."""
    for batch in batches:
        toxic = np.array([bool(x) for x in batch.column(2).to_pylist()])
        for a, b, words, _ in _read(batch.column(0)):
            t, r = np.concatenate(terms(words, words.hashes())), np.tile(words.row, 1 + len(PREFIXES))
            order = np.lexsort((r, t))
            t, r = t[order], r[order]
            keep = np.ones(len(t), bool)
            keep[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
            t, r = t[keep], r[keep]
            if not len(t):
                continue
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(t[first].view(np.int64)), pa.array(np.add.reduceat(toxic[a:b][r].astype(np.int64), first)),
                    pa.array(np.diff(np.append(first, len(t)))),
                ],
                ["term", "toxic", "n"],
            )


def _sample_rows(shared):
    """quality, toxic, style, the candidate terms and min-hashes of each sample row."""

    def run(batches):
        keys = shared.value
        for batch in batches:
            for a, b, words, raw in _read(batch.column(0)):
                h = words.hashes()
                x = style(raw, words, h)
                found = [set() for _ in range(b - a)]
                for t in terms(words, h):
                    i = np.minimum(np.searchsorted(keys, t), max(len(keys) - 1, 0))
                    ok = keys[i] == t if len(keys) else np.zeros(len(t), bool)
                    for r, k in zip(words.row[ok], i[ok]):
                        found[r].add(int(k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a),
                        pa.array(x.tolist(), pa.list_(pa.float64())), pa.array([sorted(f) for f in found], pa.list_(pa.int32())),
                        pa.array(words.count), pa.array(_signs(words, h).tolist(), pa.list_(pa.int64())),
                    ],
                    ["quality", "toxic", "style", "terms", "n", "signs"],
                )

    return run


def _sums(shared):
    """toxic and the summed term weights of the sample rows that the half's terms do not come from."""

    def run(batches):
        for batch in batches:
            for a, b, words, _ in _read(batch.column(0)):
                h = words.hashes()
                total, other = shared.value.sums(words, h), _signs(words, h)[:, 0] & 1 == 1
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a), pa.array(total)], ["toxic", "total"]).filter(pa.array(other))

    return run


def logistic(z: np.ndarray, y: np.ndarray, ridge: float, start: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a ridge around start: Newton steps, halved until the loss falls, so that
    classes that are nearly separable do not throw the weights away."""

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + ridge * ((w - start) ** 2).sum() / 2)

    w, now = start, loss(start)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1]), z.T @ (p - y) + ridge * (w - start))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        before, at = now, loss(w - size * step)
        if at >= before:
            break
        w, now = w - size * step, at
        if before - now < 1e-9:
            break
    return w


class Model:
    """Style weights, lexicon and calibration."""

    def __init__(self) -> None:
        self.mean = self.scale = self.weights = None
        self.lexicon = np.zeros(0, np.uint64)
        self.term_weights = np.zeros(0)
        self.slope, self.offset = 1.0, 0.0

    def fit_style(self, x: np.ndarray, bad: np.ndarray) -> None:
        if len(bad) < 20 or bad.min() == bad.max():
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        self.weights = logistic(z, bad, 0.1, np.zeros(z.shape[1]))

    def fit_lexicon(self, keys: np.ndarray, rows: list[list[int]], signs: np.ndarray, toxic: np.ndarray, least: int) -> None:
        members: dict[int, list[int]] = {}
        for r, own in enumerate(rows):
            for k in own:
                members.setdefault(k, []).append(r)
        bad: dict[int, list[int]] = {}
        chosen = []
        for k, own in members.items():
            hit = [r for r in own if toxic[r]]
            support, clean = different(signs[hit]), different(signs[[r for r in own if not toxic[r]]])
            if support >= STRONG and lower_bound(support, support + clean) >= BOUND:
                chosen.append(k)
            elif support >= least and len(hit) >= PRECISION * len(own):
                bad[k] = hit
        covered = {r for k in chosen for r in members[k]}
        open_rows = {r for own in bad.values() for r in own} - covered
        # gains only fall, so a term whose noted gain still holds is the best one
        queue = [(-len(own), k) for k, own in bad.items()]
        heapq.heapify(queue)
        while queue:
            noted, best = heapq.heappop(queue)
            gain = sum(r in open_rows for r in bad[best])
            if gain >= least and gain == -noted:
                chosen.append(best)
                open_rows -= set(bad[best])
            elif gain >= least:
                heapq.heappush(queue, (-gain, best))
        chosen = sorted(chosen, key=lambda k: keys[k])
        self.lexicon = keys[chosen] if chosen else np.zeros(0, np.uint64)
        texts = different(signs[toxic]), different(signs[~toxic])
        weights = []
        for k in chosen:
            own = np.array(members[k])
            have = different(signs[own[toxic[own]]]), different(signs[own[~toxic[own]]])
            weights.append(np.log((have[0] + 0.5) / (texts[0] + 1)) - np.log((have[1] + 0.5) / (texts[1] + 1)))
        self.term_weights = np.array(weights)

    def fit_toxic(self, sums: np.ndarray, toxic: np.ndarray) -> None:
        """The logistic curve from summed weights to the probability of toxicity, over rows that have a term and were not
        used for the terms. Weights pull toward the likelihood ratios that they are, with the prior odds of the rows."""
        y = toxic.astype(float)
        if not len(y):
            return
        z = np.column_stack([sums / 5, np.ones(len(y))])
        start = np.array([5.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) - sums.mean()])
        w = logistic(z, y, 0.05, start)
        self.slope, self.offset = max(float(w[0]) / 5, 0.05), float(w[1])

    def sums(self, words: T.Words, h: np.ndarray) -> np.ndarray:
        """The summed weights of each row's distinct terms, each word by its heaviest."""
        rows = len(words.count)
        if not len(self.lexicon):
            return np.zeros(rows)
        best, term = np.zeros(len(h)), np.full(len(h), -1)
        for t in terms(words, h):
            i = np.minimum(np.searchsorted(self.lexicon, t), len(self.lexicon) - 1)
            ok = np.flatnonzero((self.lexicon[i] == t) & (self.term_weights[i] > best))
            best[ok], term[ok] = self.term_weights[i[ok]], i[ok]
        at = np.flatnonzero(term >= 0)
        pairs = np.unique(np.column_stack([words.row[at], term[at]]), axis=0)
        return np.bincount(pairs[:, 0], weights=self.term_weights[pairs[:, 1]], minlength=rows) if len(at) else np.zeros(rows)

    def score(self, raw: np.ndarray, words: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of toxicity and of low quality; NaN for rows without words."""
        h = words.hashes()
        rows = len(words.count)
        bad = np.full(rows, EPS)
        if self.weights is not None:
            z = np.column_stack([(style(raw, words, h) - self.mean) / self.scale, np.ones(rows)])
            bad = np.clip(1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30))), EPS, 1 - EPS)
        sums = self.sums(words, h)
        toxic = np.where(sums > 0, np.clip(1 / (1 + np.exp(-np.clip(self.slope * sums + self.offset, -30, 30))), EPS, 1 - EPS), EPS)
        none = words.count == 0
        toxic[none] = bad[none] = np.nan
        return toxic, bad


def different(signs: np.ndarray) -> int:
    """The number of different texts among rows with these min-hashes: the least over the hashes."""
    return min((len(np.unique(signs[:, i])) for i in range(signs.shape[1])), default=0) if len(signs) else 0


def lower_bound(hits: int, n: int) -> float:
    """The lower end of the Wilson interval of hits among n."""
    if not n:
        return 0.0
    p, z = hits / n, QUANTILE * QUANTILE / n
    return (p + z / 2 - QUANTILE * np.sqrt(p * (1 - p) / n + z / (4 * n))) / (1 + z)


def support(rows: int) -> int:
    """The toxic sample rows that a lexicon term needs."""
    return max(MIN_SUPPORT, rows // ROWS_PER_SUPPORT)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from a sample of at most about SAMPLE_ROWS labelled rows."""
    spark = docs.sparkSession
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    n = one.count()
    model = Model()
    if not n:
        return model
    share = min(1.0, SAMPLE_ROWS / n)
    drawn = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", F.col("q").cast("int").alias("quality"), F.col("t").cast("int").alias("toxic"))
    rows = store(rows, "labelled").repartition(max(8, spark.sparkContext.defaultParallelism))
    counts = rows.mapInArrow(_term_counts, "term long, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    least = support(min(n, SAMPLE_ROWS))
    good = counts.where((F.col("toxic") >= least) & (F.col("toxic") >= BOUND * F.col("n")))
    keys = np.sort(good.select("term").toArrow().column(0).to_numpy().view(np.uint64))
    got = rows.mapInArrow(
        _sample_rows(spark.sparkContext.broadcast(keys)), "quality int, toxic int, style array<double>, terms array<int>, n long, signs array<long>"
    ).where("n > 0").collect()
    if got:
        toxic = np.array([r["toxic"] == 1 for r in got])
        known = [r for r in got if r["quality"] is not None]
        signs = np.array([r["signs"] for r in got], np.int64)
        terms_ = [r["terms"] for r in got]
        # near copies share min-hashes, so they are on one side; the curve is fitted on the side that gave no terms
        half = np.flatnonzero(signs[:, 0] & 1 == 0)
        model.fit_lexicon(keys, [terms_[i] for i in half], signs[half], toxic[half], least)
        pairs = rows.mapInArrow(_sums(spark.sparkContext.broadcast(model)), "toxic int, total double").where("total > 0").collect()
        model.fit_toxic(np.array([r["total"] for r in pairs]), np.array([r["toxic"] == 1 for r in pairs], bool))
        model.fit_lexicon(keys, terms_, signs, toxic, least)
        if known:
            model.fit_style(np.array([r["style"] for r in known]), np.array([float(r["quality"] == 0) for r in known]))
    return model


def evidence(text: Column, model: Model, spark: SparkSession) -> Column:
    """struct(toxic, bad): the probabilities of a text, null where it has no words. Only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        toxic, bad = np.zeros(len(texts)), np.zeros(len(texts))
        for a, b, words, raw in _read(texts):
            toxic[a:b], bad[a:b] = shared.value.score(raw, words)
        none = np.isnan(toxic)
        return pa.StructArray.from_arrays([pa.array(toxic, mask=none), pa.array(bad, mask=none)], ["toxic", "bad"])

    return F.arrow_udf(run, "struct<toxic:double,bad:double>")(text)


def _either(p: str) -> Column:
    return 1 - (1 - F.col(f"{p}.toxic")) * (1 - F.col(f"{p}.bad"))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return F.when(p.isNotNull(), F.log(q / (1 - q)))


def _strength(mean: float, spread: float) -> float:
    """The number of rows that a prior of this spread around its mean is worth."""
    return float(min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 2.0), 1e6))


def posteriors(found: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Paths (host, path) with host_posterior, path_posterior, their rows with evidence and its sums (n, s; of the host: hn, hs); and the global mean, the
    strengths of the two levels (host, path) and the number of paths (rows)."""
    paths = found.groupBy("host", "path").agg(F.count("e").alias("n"), F.coalesce(F.sum("e"), F.lit(0.0)).alias("s"))
    paths = store(paths, "paths")
    square = F.col("s") * F.col("s") / F.greatest("n", F.lit(1))
    hosts = paths.groupBy(F.col("host").alias("__h")).agg(
        F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(square).alias("squares"), F.count_if(F.col("n") > 0).alias("full")
    )
    one = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.col("hs") * F.col("hs") / F.greatest("hn", F.lit(1))).alias("between"),
        F.count_if(F.col("hn") > 0).alias("hosts"), F.sum("squares").alias("squares"), F.sum("full").alias("paths"),
    ).first()
    rows = max(one["n"] or 0, 1)
    mean = min(max((one["s"] or 0.0) / rows, EPS), 1 - EPS)
    noise, between = mean * (1 - mean) / rows, (one["between"] or 0.0) / rows
    level = {
        "mean": mean, "host": _strength(mean, between - mean * mean - noise * (one["hosts"] or 0)),
        "path": _strength(mean, (one["squares"] or 0.0) / rows - between - noise * ((one["paths"] or 0) - (one["hosts"] or 0))),
    }
    out = paths.join(hosts.drop("squares", "full"), F.col("host").eqNullSafe(F.col("__h"))).drop("__h")
    host, path = _shrunk(level, F.lit(0.0), F.lit(0))
    out, seen = store_counted(out.withColumns({"host_posterior": host, "path_posterior": path}), "posteriors", n=F.count(F.lit(1)))
    return out, level | {"rows": seen["n"]}


def _shrunk(level: dict[str, float], own: Column, one: Column) -> tuple[Column, Column]:
    """Posteriors of a host and a path from n, s, hn and hs without one (0 or 1) row of evidence own."""
    host = (F.lit(level["host"] * level["mean"]) + F.col("hs") - own) / (F.lit(level["host"]) + F.col("hn") - one)
    return host, (F.lit(level["path"]) * host + F.col("s") - own) / (F.lit(level["path"]) + F.col("n") - one)


def judged(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """A struct row of the columns keep of each document, and e (its evidence), host_posterior, path_posterior, score, rejected."""
    model = fit(docs, labels)
    row = F.struct(*[F.col(c) for c in keep]).alias("row")
    at = docs.select(row, F.col("source").alias("host"), F.col("lang").alias("path"), evidence(F.col("text"), model, docs.sparkSession).alias("e"))
    at = store(at, "evidence")
    means, level = posteriors(at.select("host", "path", _either("e").alias("e")))
    means = small(means.withColumnsRenamed({"host": "h", "path": "p"}), level["rows"])
    at = at.join(means, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    own = _either("e")
    _, others = _shrunk(level, F.coalesce(own, F.lit(0.0)), own.isNotNull().cast("int"))
    prior = F.lit(float(np.log(level["mean"] / (1 - level["mean"]))))
    odds = F.coalesce(_logit(own), prior) + _logit(others) - prior
    score = 1 / (1 + F.exp(-odds))
    return at.select("row", "e", "host_posterior", "path_posterior", score.alias("score"), (score > REJECT).alias("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with their own columns."""
    return judged(docs, labels, docs.columns).where(~F.col("rejected")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
    return out.select(
        "row.doc_id", F.col("e.toxic").alias("p_toxic"), F.col("e.bad").alias("p_low_quality"), "host_posterior", "path_posterior", "score", "rejected"
    )
