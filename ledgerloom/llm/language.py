"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; every run of characters other than letters is one space, and so are both ends. Per language the
counts of ORDER-grams are gathered from all training rows by a map-side combined aggregation. Lower orders use continuation counts (the number of
different characters that precede a gram), aggregated from all grams of the order above; each order is interpolated with the one below by its absolute
discount n1 / (n1 + 2 n2), down to a uniform distribution over the characters seen. Discounts, totals and kinds of contexts come from all counts.

Every probability is that of all counts. What travels to the tasks is bounded: of each order the grams of a language's greatest counts, as many as its share of the
model allows (MAX_GRAMS at most, and CELLS values over all languages), ties at the least count left out together, and besides all lower grams that these are interpolated
with; each for all languages that have it. If that is everything, a gram that is not stored backs off by its context's weight. If not, the grams of a text that are not
stored leave the task, and their probabilities come from joins of the different ones with the tables of all counts (Counts.exact); they are added to the
text's sums in whole numbers, so that the order of addition does not matter.

The model is a set of sorted hash arrays, one per order over the grams of all languages, with a column of log
probabilities per language (a gram that a language lacks has its backed-off value stored), and one per order over the contexts with their log weights. A
lookup is a search in one array; grams that no language has take their context's weight and fall to the next order. A text's language has the least
cross-entropy per character; every character of the text counts. The score is the probability of that language under equal priors
with evidence of at most EVIDENCE characters.

Calibrated rejection: a slice of the training texts (by a hash of the text, a tenth of them, about CALIBRATION_ROWS at most) is kept out of the
counts. For each language a quantile of the cross-entropies of its texts in the slice, one text more counted, is the limit; a text above it is marked
rejected. A slice of too few texts for the quantile rejects none. Its language is still given, for the result must name a learned language wherever there is a letter.

Nulls and texts without letters are `und` with score 0. Rows with null lang are not learned from; with no training
rows every text with letters is `und`. Null doc_ids count as held out. Repeated rows are answered one by one; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _text as T
from ledgerloom.llm._spark import store

ORDER = 4
MAX_GRAMS = 300_000
#: Values of the stored model: grams times languages.
CELLS = 60_000_000
#: Greater counts than this are told apart by their leading bits only when the least count stored is chosen.
RARE = 1024
#: Parts of a nat in which the probabilities of grams that are not stored are added.
PARTS = 1 << 32
CALIBRATION_ROWS = 20_000
EVIDENCE = 60
QUANTILE = 0.999
#: A context of ORDER - 1 characters is one number of 63 bits.
BITS = 21
UNDETERMINED = "und"

_letters = np.array([chr(i).isalpha() for i in range(0x110000)])


def _shorter(context, k: int):
    """A context's last k characters."""
    return context & ((1 << (BITS * k)) - 1)


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised characters of all texts as code points (int64), row bounds, and the letters of each row."""
    low = [("" if t is None else t.lower()) for t in texts]
    n = np.fromiter((len(t) for t in low), np.int64, len(low))
    raw = np.frombuffer(" ".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    raw = np.concatenate([raw, np.array([32], np.uint32)]) if len(low) else raw
    letter = _letters[raw]
    counts = np.concatenate([[0], np.cumsum(letter)])
    letters = counts[bounds[1:]] - counts[bounds[:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stands for the run
    value = np.where(letter, raw, 32).astype(np.int64)
    lead = np.zeros(len(raw) + 1, np.int64)
    lead[1:] = np.cumsum(keep)
    return value[keep], np.stack([lead[bounds[:-1]], lead[bounds[1:]]], 1), letters


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The context (ORDER - 1 characters, a space stands before the first) and the character at each place, its row, and letters."""
    kept, bounds, letters = codes(texts)
    size = bounds[:, 1] - bounds[:, 0]
    pad = ORDER - 1
    out = np.full(int(size.sum()) + pad * len(size), 32, np.int64)
    begin = np.concatenate([[0], np.cumsum(size + pad)])[:-1]
    place = np.arange(len(kept)) + np.repeat(begin + pad - bounds[:, 0], size) if len(kept) else np.zeros(0, np.int64)
    out[place] = kept
    context = np.zeros(len(place), np.int64)
    for j in range(pad):
        context |= out[place - pad + j] << (BITS * (pad - 1 - j))
    return context, out[place], np.repeat(np.arange(len(size)), size), letters


def _count(batches):
    """lang, context, ch, n over batches of (lang, text)."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.to_numpy()
        offsets = T.buffers(batch.column(1))[1]
        for a, b in T.blocks(offsets, T.BLOCK_BYTES):
            context, ch, row, _ = grams(batch.column(1).slice(a, b - a).to_pylist())
            if not len(ch):
                continue
            lang = code[a:b][row]
            order = np.lexsort((ch, context, lang))
            context, ch, lang = context[order], ch[order], lang[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(context) != 0) | (np.diff(ch) != 0) | (np.diff(lang) != 0)]))
            n = np.diff(np.append(first, len(ch)))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang[first])), pa.array(context[first]), pa.array(ch[first].astype(np.int32)), pa.array(n)], ["lang", "context", "ch", "n"]
            )


class SortedHashes:
    """64-bit names of grams or contexts as a sorted array of hash values, with the positions at which their leading bits begin."""

    def __init__(self, keys: np.ndarray) -> None:
        h = T.mix(keys)
        self.order = np.argsort(h)
        self.hashes = np.append(h[self.order], np.uint64(0))
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) + 1))) + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(h[self.order], np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.starts = np.append(self.starts, len(keys)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions in the sorted array, -1 where a key is missing."""
        h = T.mix(keys)
        lead = (h >> self.shift).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        hit = (self.hashes[at] == h) & (at < end)
        out = np.where(hit, at, np.int32(-1))
        rest = np.flatnonzero(~hit & (at + 1 < end))
        at = at[rest] + 1
        while len(rest):
            hit = self.hashes[at] == h[rest]
            out[rest[hit]] = at[hit]
            more = ~hit & (at + 1 < end[rest])
            rest, at = rest[more], at[more] + 1
        return out


class Order:
    """What a language stores of one order: grams (context, ch), counts, totals and kinds of their contexts, and the discount."""

    def __init__(self, context: np.ndarray, ch: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray, discount: float) -> None:
        self.context, self.ch = context.astype(np.int64), ch.astype(np.int64)
        self.n, self.total, self.kinds = (x.astype(np.float64) for x in (n, total, kinds))
        self.discount = discount
        own, first = np.unique(self.context, return_index=True)
        self.know(own, self.total[first], self.kinds[first])

    def know(self, contexts: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
        """The language's contexts among those of stored grams, also of grams that it lacks."""
        self.contexts, self.weights = contexts.astype(np.int64), np.log(self.discount * kinds.astype(np.float64) / total)


def discount(n1: float, n2: float) -> float:
    return min(0.95, max(0.1, n1 / max(n1 + 2 * n2, 1)))


def _gram_name(context: np.ndarray, ch: np.ndarray) -> np.ndarray:
    return T.mix(context.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F)) + ch.view(np.uint64) * np.uint64(0xE7037ED1A0B428DB)


class KneserNey:
    """Sorted gram and context arrays per order with a column of log values per language."""

    def __init__(self, tables: dict[str, dict[int, Order]], alphabet: int | None = None, complete: bool = True) -> None:
        self.langs, self.complete = sorted(tables), complete
        some = [tables[x] for x in self.langs]
        self.limits = np.full(len(self.langs), np.inf)
        alphabet = alphabet or (len(np.unique(np.concatenate([t[1].ch for t in some]))) + 1 if some else 1)
        self.floor = -float(np.log(alphabet))
        self.grams: dict[int, tuple[SortedHashes, np.ndarray]] = {}
        self.contexts: dict[int, tuple[SortedHashes, np.ndarray]] = {}
        for k in range(1, ORDER + 1 if some else 1):
            whole = np.unique(np.concatenate([np.stack([t[k].context, t[k].ch], 1) for t in some]), axis=0)
            context, ch = np.ascontiguousarray(whole[:, 0]), np.ascontiguousarray(whole[:, 1])
            known = np.unique(context)
            weight = np.zeros((len(known), len(some)))
            for i, t in enumerate(some):
                weight[np.searchsorted(known, t[k].contexts), i] = t[k].weights
            index = SortedHashes(known.view(np.uint64))
            self.contexts[k] = index, weight[index.order].astype(np.float32)
            below = self.evaluate(k - 1, _shorter(context, k - 2) if k > 1 else context, ch)
            value = below + weight[np.searchsorted(known, context)]
            name = _gram_name(context, ch)
            index = SortedHashes(name)
            for i, t in enumerate(some):
                place = index.order[index.find(_gram_name(t[k].context, t[k].ch))]
                value[place, i] = np.log(np.maximum(t[k].n - t[k].discount, 0) / t[k].total + np.exp(value[place, i]))
            self.grams[k] = index, np.ascontiguousarray(value[index.order].T.astype(np.float32))

    def evaluate(self, k: int, context: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """Log probabilities (places x languages) of characters after contexts of k - 1 characters."""
        out = np.full((len(ch), len(self.langs)), self.floor)
        if k < 1 or not len(ch):
            return out
        index, value = self.grams[k]
        found = index.find(_gram_name(context, ch))
        hit = found >= 0
        out[hit] = value[:, found[hit]].T
        open_ = np.flatnonzero(~hit)
        if len(open_):
            out[open_] = self._back_off(k, context[open_], ch[open_])
        return out

    def _back_off(self, k: int, context: np.ndarray, ch: np.ndarray) -> np.ndarray:
        index, weight = self.contexts[k]
        at = index.find(context.view(np.uint64))
        low = self.evaluate(k - 1, _shorter(context, k - 2) if k > 1 else context, ch)
        low[at >= 0] += weight[at[at >= 0]]
        return low

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Log probabilities by language (rows x languages), characters and letters of each row; then row, context and character at the places
        that the sums leave out, as the model is not complete."""
        context, ch, row, letters = grams(texts)
        rows = len(texts)
        n = np.bincount(row, minlength=rows)
        sums = np.zeros((rows, len(self.langs)))
        full = np.flatnonzero(n)
        open_ = np.zeros(0, np.int64)
        if len(full):
            first = (np.cumsum(n) - n)[full]
            index, value = self.grams[ORDER]
            found = index.find(_gram_name(context, ch))
            open_ = np.flatnonzero(found < 0)
            low = self._back_off(ORDER, context[open_], ch[open_]) if self.complete and len(open_) else np.zeros((len(open_), len(self.langs)))
            for x in range(len(self.langs)):
                own = value[x][found].astype(np.float64) if value.shape[1] else np.zeros(len(found))
                own[open_] = low[:, x]
                sums[full, x] = np.add.reduceat(own, first)
        if self.complete:
            open_ = open_[:0]
        return sums, n, letters, row[open_], context[open_], ch[open_]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character by language (rows x languages), characters and letters of each row, by a complete model."""
        sums, n, letters = self.sums(texts)[:3]
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        return self.decide(*self.entropies(texts))

    def decide(self, h: np.ndarray, n: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """As predict(), from entropies, characters and letters."""
        best = np.argmin(h, axis=1)
        least = h[np.arange(len(h)), best]
        score = 1 / np.exp((least[:, None] - h) * np.minimum(n, EVIDENCE)[:, None]).sum(1)
        none = letters == 0
        score[none] = 0
        return [UNDETERMINED if x else self.langs[b] for b, x in zip(best, none)], score, least, none | (least > self.limits[best])


def _blocks(texts: pa.Array):
    for a, b in T.blocks(T.buffers(texts)[1], T.BLOCK_BYTES):
        yield texts.slice(a, b - a).to_pylist()


def _histogram(shared):
    """Of training rows (lang, text): lang, cross-entropy under the own language in hundredths, rows."""

    def run(batches):
        model = shared.value
        index = {x: i for i, x in enumerate(model.langs)}
        for batch in batches:
            h = np.concatenate([np.zeros((0, len(index))), *(model.entropies(t)[0] for t in _blocks(batch.column(1)))])
            own = np.array([index.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            h, own = h[own >= 0], own[own >= 0]
            if len(own):
                pairs, n = np.unique(np.column_stack([own, np.ceil(h[np.arange(len(own)), own] * 100)]).astype(np.int64), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n.astype(np.int64))], ["i", "h", "n"])

    return run


def _last(k: int) -> Column:
    return F.col("context").bitwiseAND(F.lit((1 << (BITS * k)) - 1))


@dataclass
class Counts:
    """The tables of all counts by order: grams (lang, context, ch, n) and contexts (lang, context, total, kinds); and what of them is stored."""

    langs: list[str]
    grams: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    discounts: dict[str, dict[int, float]]
    alphabet: int
    stored: dict[str, dict[int, Order]]
    complete: bool

    def exact(self, grams: DataFrame) -> DataFrame:
        """context, ch and value, the log probabilities by language in PARTS of a nat, for different grams (context, ch) of the highest order. Each order asks for the
        different grams of the one below, so no key has more rows than there are characters."""
        needed = {ORDER: grams}
        for k in range(ORDER - 1, 0, -1):
            needed[k] = needed[k + 1].select(_last(k - 1).alias("context"), "ch").distinct()
        found = None
        for k in range(1, ORDER + 1):
            langs = grams.sparkSession.createDataFrame([(x, self.discounts[x][k]) for x in self.langs], "lang string, d double")
            contexts = F.broadcast(self.contexts[k]) if k == 1 else self.contexts[k]
            rows = needed[k].crossJoin(F.broadcast(langs)).join(contexts, ["lang", "context"], "left").join(self.grams[k], ["lang", "context", "ch"], "left")
            if found is None:
                rows = rows.withColumn("low", F.lit(1 / self.alphabet))
            else:
                below = found.select("lang", F.col("context").alias("tail"), "ch", F.col("p").alias("low"))
                rows = rows.withColumn("tail", _last(k - 2)).join(below, ["lang", "tail", "ch"])
            own = (F.greatest(F.coalesce("n", F.lit(0)) - F.col("d"), F.lit(0.0)) + F.col("d") * F.col("kinds") * F.col("low")) / F.col("total")
            found = rows.select("lang", "context", "ch", F.when(F.col("total").isNull(), F.col("low")).otherwise(own).alias("p"))
        value = F.round(F.log("p") * F.lit(float(PARTS))).cast("long").alias("value")
        found = found.select("lang", "context", "ch", value).groupBy("context", "ch").agg(F.sort_array(F.collect_list(F.struct("lang", "value"))).alias("all"))
        return found.select("context", "ch", F.col("all.value").alias("value"))


def _steps() -> Column:
    """Counts above RARE rounded down to six leading bits."""
    step = F.pow(F.lit(2.0), F.floor(F.log2("n")) - F.lit(5))
    return F.when(F.col("n") < F.lit(RARE), F.col("n")).otherwise((F.floor(F.col("n") / step) * step).cast("long"))


def all_counts(counts: DataFrame) -> Counts:
    """The tables below the counts of all ORDER-grams (lang, context, ch, n), and what each language stores."""
    spark = counts.sparkSession
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        low = tables[k + 1].groupBy("lang", _last(k - 1).alias("context"), "ch")
        tables[k] = store(low.agg(F.count(F.lit(1)).alias("n")), "grams")
    seen = [t.groupBy("lang", _steps().alias("n")).agg(F.count(F.lit(1)).alias("kinds")).withColumn("k", F.lit(k)) for k, t in tables.items()]
    kinds: dict[tuple, dict[int, int]] = {}
    for r in reduce(DataFrame.unionByName, seen).collect():
        kinds.setdefault((r["lang"], r["k"]), {})[r["n"]] = r["kinds"]
    langs = sorted({lang for lang, _ in kinds})
    discounts = {x: {k: discount(kinds[(x, k)].get(1, 0), kinds[(x, k)].get(2, 0)) for k in tables} for x in langs}
    limit = min(MAX_GRAMS, CELLS // max(1, len(langs)) ** 2)
    out: dict[str, dict[int, Order]] = {lang: {} for lang in langs}
    contexts, needed, complete = {}, None, True
    for k in range(ORDER, 0, -1):
        least, whole = [], True
        for lang in langs:
            kept, low = 0, max(kinds[(lang, k)]) + 1
            for n, many in sorted(kinds[(lang, k)].items(), reverse=True):
                kept += many
                if kept > limit:
                    whole = False
                    break
                low = n
            least.append((lang, low))
        complete &= whole
        contexts[k] = tables[k].groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows, known = tables[k], None
        if not whole:
            contexts[k] = store(contexts[k], "contexts")
            rows = rows.join(F.broadcast(spark.createDataFrame(least, "lang string, least long")), "lang").where(_steps() >= F.col("least")).select("context", "ch")
            chosen = store((rows if needed is None else rows.unionByName(needed)).distinct(), "chosen")
            needed = chosen.select(_last(k - 2).alias("context"), "ch").distinct() if k > 1 else None
            known = contexts[k].join(chosen.select("context").distinct(), "context").select("lang", "context", "total", "kinds").toArrow()
            rows = tables[k].join(chosen, ["context", "ch"])
        table = rows.join(contexts[k], ["lang", "context"]).select("lang", "context", "ch", "n", "total", "kinds").toArrow()
        of = {name: _by_lang(t) for name, t in (("grams", table), ("contexts", known)) if t is not None}
        for lang in langs:
            out[lang][k] = Order(*of["grams"](lang, "context", "ch", "n", "total", "kinds"), discounts[lang][k])
            if known is not None:
                out[lang][k].know(*of["contexts"](lang, "context", "total", "kinds"))
    alphabet = tables[1].select("ch").distinct().count() + 1 if langs else 1
    return Counts(langs, tables, contexts, discounts, alphabet, out, complete)


def _by_lang(table: pa.Table):
    """The columns of one language."""
    code = table.column("lang").combine_chunks().dictionary_encode()
    names, index = {x: i for i, x in enumerate(code.dictionary.to_pylist())}, code.indices.to_numpy()

    def of(lang: str, *columns: str) -> list[np.ndarray]:
        own = np.flatnonzero(index == names.get(lang, -1))
        return [table.column(c).to_numpy()[own] for c in columns]

    return of


def stored_tables(counts: DataFrame) -> dict[str, dict[int, Order]]:
    """What each language stores, from the counts of all its ORDER-grams (lang, context, ch, n)."""
    return all_counts(counts).stored


def _partial(shared):
    """Of rows (..., text): the other columns, the sums over stored grams, and the grams left out with their number in the text."""

    def run(batches):
        for batch in batches:
            got = [shared.value.sums(t) for t in _blocks(batch.column(batch.num_columns - 1))]
            if not got:
                continue
            sums, n, letters = (np.concatenate([g[i] for g in got]) for i in range(3))
            base = np.cumsum([0] + [len(g[0]) for g in got])
            row, context, ch = (np.concatenate([g[3 + i] + (base[j] if i == 0 else 0) for j, g in enumerate(got)]) for i in range(3))
            order = np.lexsort((ch, context, row))
            row, context, ch = row[order], context[order], ch[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(context) != 0) | (np.diff(ch) != 0)])) if len(row) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(row)))
            cut = pa.array(np.searchsorted(row[first], np.arange(len(n) + 1)).astype(np.int32))
            many = pa.array((np.arange(len(n) + 1) * sums.shape[1]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (context[first], ch[first].astype(np.int32), times.astype(np.int64))]
            names = [*batch.schema.names[:-1], "n", "letters", "sums", "contexts", "chs", "times"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n.astype(np.int64)), pa.array(letters.astype(np.int64)), pa.ListArray.from_arrays(many, pa.array(sums.ravel())), *lists], names)

    return run


def whole_sums(rows: DataFrame, shared, counts: Counts) -> DataFrame:
    """For rows (..., text) the other columns, n, letters and sums, the log probabilities of the whole texts by language."""
    rows = rows.select(F.monotonically_increasing_id().alias("id"), *rows.columns)
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    part = store(rows.mapInArrow(_partial(shared), f"{own}, n long, letters long, sums array<double>, contexts array<long>, chs array<int>, times array<long>"), "partial")
    zipped = F.explode(F.arrays_zip(F.col("contexts").alias("context"), F.col("chs").alias("ch"), F.col("times").alias("times"))).alias("x")
    open_ = part.select("id", zipped).select("id", "x.context", "x.ch", "x.times")
    different = store(open_.select("context", "ch").distinct(), "open")
    rest = open_.join(counts.exact(different), ["context", "ch"]).groupBy("id")
    rest = rest.agg(F.array(*[F.sum(F.col("times") * F.col("value")[i]) for i in range(len(counts.langs))]).alias("rest"))
    both = F.zip_with("sums", "rest", lambda a, b: a + b / F.lit(float(PARTS)))
    out = part.select(*rows.columns[:-1], "n", "letters", "sums").join(rest, "id", "left")
    return out.withColumn("sums", F.when(F.col("rest").isNull(), F.col("sums")).otherwise(both)).drop("id", "rest")


def train(rows: DataFrame) -> tuple[KneserNey, Counts]:
    """A model from rows (lang, text), and all its counts; all rows but the calibration slice are counted."""
    rows = rows.where("lang is not null and text is not null").select("lang", "text")
    share = min(0.1, CALIBRATION_ROWS / max(rows.count(), 1))
    aside = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    counts = rows.where(~aside).mapInArrow(_count, "lang string, context long, ch int, n long").groupBy("lang", "context", "ch").agg(F.sum("n").alias("n"))
    counts = all_counts(store(counts, "grams"))
    model = KneserNey(counts.stored, counts.alphabet, counts.complete)
    if model.langs:
        shared = rows.sparkSession.sparkContext.broadcast(model)
        if model.complete:
            found = rows.where(aside).mapInArrow(_histogram(shared), "i long, h long, n long")
        else:
            i = (F.array_position(F.array(*map(F.lit, model.langs)), F.col("lang")) - 1).cast("int")
            found = whole_sums(rows.where(aside), shared, counts).withColumn("i", i).where("i >= 0")
            h = F.ceil(-F.element_at("sums", F.col("i") + 1) / F.greatest("n", F.lit(1)) * 100)
            found = found.select("i", h.alias("h"), F.lit(1).alias("n"))
        found = found.groupBy("i", "h").agg(F.sum("n").alias("n")).collect()
        for i in range(len(model.langs)):
            own = sorted((r["h"], r["n"]) for r in found if r["i"] == i)
            total, run = sum(n for _, n in own), 0
            for h, n in own:
                run += n
                if run >= QUANTILE * (total + 1):
                    model.limits[i] = h / 100
                    break
    return model, counts


_ANSWERS = "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"


def _answers(doc_id, held_out, got: list) -> pa.RecordBatch:
    lang = [x for g in got for x in g[0]]
    score, entropy, rejected = (np.concatenate([g[i] for g in got]) if got else np.zeros(0) for i in (1, 2, 3))
    return pa.RecordBatch.from_arrays(
        [doc_id, held_out, pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected.astype(bool))],
        ["doc_id", "held_out", "lang_pred", "score", "entropy", "rejected"],
    )


def _predict(shared):
    def run(batches):
        for batch in batches:
            yield _answers(batch.column(0), batch.column(2), [shared.value.predict(t) for t in _blocks(batch.column(1))])

    return run


def _decide(shared):
    """Answers from rows (doc_id, held_out, n, letters, sums)."""

    def run(batches):
        for batch in batches:
            n, letters = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            sums = batch.column(4).flatten().to_numpy().reshape(len(n), -1) if len(n) else np.zeros((0, len(shared.value.langs)))
            yield _answers(batch.column(0), batch.column(1), [shared.value.decide(-sums / np.maximum(n, 1)[:, None], n, letters)])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for docs (doc_id, text, lang)."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    model, counts = train(docs.where(~F.col("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if not model.complete:
        sums = whole_sums(docs.select("doc_id", "held_out", "text"), shared, counts)
        return sums.select("doc_id", "held_out", "n", "letters", "sums").mapInArrow(_decide(shared), _ANSWERS)
    return docs.select("doc_id", "text", "held_out").mapInArrow(_predict(shared), _ANSWERS)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
