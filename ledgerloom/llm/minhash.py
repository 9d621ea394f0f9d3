"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct 5-word shingles. A SetSketch keeps, for each of M registers, the smallest of
the exponentially distributed hash values of the set's elements, stored as the power of a base B it lies at and
truncated to a fixed range. Sketches merge by the larger register. Equal registers become more likely with the
Jaccard similarity, so bands of them find candidates; a pair of candidates is estimated by likelihood, jointly from the
numbers of larger, smaller and equal registers and the known set sizes; what may be similar is verified on the full sets.

Shape of the job:

1. One pass over the texts makes a row per document: set size, a digest of the word sequence, registers.
2. Equal word sequences collapse to the smallest doc_id by a map-side combined aggregation.
3. Band hashes put sequences into buckets. In each round a bucket's smallest member leads it, and every other member is estimated
   against the leader (distinct pairs only, never a bucket's pairs). An estimate of at least 2t - 1 - MARGIN, t being the threshold, makes
   an edge. A member estimated at t or more leaves the bucket: by the triangle inequality of the Jaccard distance whatever is similar to it has
   an edge to the leader, too. The others stay for the next leader. What is still in a bucket after ROUNDS is tied
   together without an estimate, so nothing is lost. Connected components of the edges are the candidate groups.
4. The texts of candidate groups alone are moved, once. Groups are cut into blocks of bounded rows and shingles, each with the
   group's pivot (its smallest doc_id). Within a block all pairs not joined yet are compared, word for word, and each member's distance to the
   pivot is measured.
5. In groups of several blocks, members outside the largest joined set still have to meet the others. By the triangle
   inequality a pair can only be similar if its distances to the pivot differ by at most 1 - t, so members are dealt to cells by that distance,
   and such a member visits only the cells within its reach. Connected components of the verified links are the result.

Nulls and texts without words have no set, link with nothing and stand alone. Set sizes count distinct 64-bit shingle hashes; links are verified
on the words themselves. Rows that repeat a doc_id are answered one by one, each with its own set size; they are one document with several texts, and what
one of them is linked with, all are. Rows with a null doc_id stand alone with a null component. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _text as T
from ledgerloom.llm._spark import components, small, store, store_counted

SHINGLE = 5
THRESHOLD = (85, 100)
REGISTERS = 192
BAND_ROWS = 8
BASE = 1.02
LEVELS = 1 << 13
BLOCK_ROWS = 192
BLOCK_SHINGLES = 1 << 18
VISITORS = 512
CELLS = 32
ROUNDS = 2
#: What an estimate may be off: 3 to 4 standard deviations.
MARGIN = 0.15

_rng = np.random.default_rng(85100)
_MULT = _rng.integers(1, 1 << 62, REGISTERS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 62, REGISTERS, dtype=np.int64).astype(np.uint64)


def shingle_sets(words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows and the bounds of each row's part."""
    h = words.hashes()
    n = words.count
    rows = len(n)
    k = SHINGLE
    whole = T.window_hashes(h, k)
    fit = np.flatnonzero(words.fits(k)[: len(whole)])
    values, at = [whole[fit]], [words.row[fit]]
    for short in range(1, k):
        rows_short = np.flatnonzero(n == short)
        if len(rows_short):
            first = words.row_ptr[rows_short]
            acc = np.zeros(len(rows_short), np.uint64)
            for j in range(short):
                acc = T.mix(acc * np.uint64(31) + h[first + j])
            values.append(T.mix(acc + np.uint64(short)))
            at.append(rows_short)
    v, r = np.concatenate(values), np.concatenate(at)
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(rows + 1))


def sketch(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS) of non-empty sets: floor(1 - log_B(smallest exponential)), truncated to LEVELS."""
    lows = np.empty((len(bounds) - 1, REGISTERS), np.uint64)
    step = max(1, (1 << 17))
    cuts = [0]
    while cuts[-1] < len(bounds) - 1:
        to = int(np.searchsorted(bounds, bounds[cuts[-1]] + step, "right")) - 1
        cuts.append(min(len(bounds) - 1, max(cuts[-1] + 1, to)))
    for a, b in zip(cuts, cuts[1:]):
        part = values[bounds[a] : bounds[b]]
        at = bounds[a:b] - bounds[a]
        for i in range(REGISTERS):
            x = part * _MULT[i]
            x += _ADD[i]
            x ^= x >> np.uint64(32)
            x *= _MULT[-1 - i]
            lows[a:b, i] = np.minimum.reduceat(x, at)
    e = -np.log1p(-((lows >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, LEVELS).astype(np.int16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


_GRID = 257


def similarities(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarities of largest likelihood given the registers of pairs of sets (rows) and their sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - larger - smaller
    j = np.minimum(u / v, v / u)[:, None] * np.linspace(0, 1, _GRID)[None, :-1]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    like = larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + equal[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[np.arange(len(j)), np.argmax(like, axis=1)]


def bands(registers: np.ndarray, band_rows: int = BAND_ROWS) -> np.ndarray:
    """Band hashes (rows x bands)."""
    out = []
    for b in range(REGISTERS // band_rows):
        acc = np.full(len(registers), b + 1, np.uint64)
        for i in range(b * band_rows, (b + 1) * band_rows):
            acc = T.mix(acc * np.uint64(1_000_003) + registers[:, i].astype(np.uint64))
        out.append(acc)
    return np.stack(out, 1).view(np.int64)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), REGISTERS)


def _digests(batches):
    """doc_id, n_shingles, digest of the word sequence, registers; no registers for empty sets."""
    for batch in batches:
        raw, offsets = T.buffers(batch.column(1))
        for a, b in T.blocks(offsets):
            words = T.Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1], T.NON_SPACE, T.LOWER)
            values, bounds = shingle_sets(words)
            size = np.diff(bounds)
            full = np.flatnonzero(size > 0)
            registers: list[bytes | None] = [None] * (b - a)
            if len(full):
                for i, r in zip(full.tolist(), sketch(values, np.append(bounds[full], bounds[-1]))):
                    registers[i] = r.tobytes()
            folded, off = words.raw.tobytes(), words.offsets
            digests = [T.digest(folded[off[i] : off[i + 1]]) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())],
                ["doc_id", "n_shingles", "digest", "registers"],
            )


def _banded(band_rows: int):
    """rep, band for each band of each class."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                hashes = bands(_registers(batch.column(1)), band_rows)
                rep = np.repeat(batch.column(0).to_numpy(), hashes.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(hashes.ravel())], ["rep", "band"])

    return run


def _estimated(batches):
    """rep, lead, estimate of pairs (rep, lead, their registers and set sizes)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            a, b = _registers(part.column(2)), _registers(part.column(3))
            j = similarities(a, b, part.column(4).to_numpy().astype(float), part.column(5).to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(j)], ["rep", "lead", "j"])


def _led(rows: DataFrame) -> tuple[DataFrame, dict]:
    """rep, band, lead for the members of buckets (rep, band) that have others, and how many rows that is."""
    leads = rows.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("top")).where("lead < top").drop("top")
    leads, many = store_counted(leads, "leads", n=F.count(F.lit(1)))
    led = rows.join(small(leads, many["n"]), "band").where("rep <> lead").select("rep", "band", "lead")
    return store_counted(led, "buckets", n=F.count(F.lit(1)))


def candidate_edges(reps: DataFrame, threshold: tuple[int, int], band_rows: int) -> DataFrame:
    """Pairs (a, b) whose components are the candidate groups; see step 3 above. reps: rep, n, registers."""
    t = threshold[0] / threshold[1]
    banded = reps.select("rep", "registers").mapInArrow(_banded(band_rows), "rep long, band long")
    open_, left = _led(banded)
    edges = []
    for _ in range(ROUNDS):
        if not left["n"]:
            break
        mine = reps.select("rep", F.col("n").alias("na"), F.col("registers").alias("ra"))
        other = reps.select(F.col("rep").alias("lead"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
        pairs = open_.select("rep", "lead").distinct().join(mine, "rep").join(other, "lead").select("rep", "lead", "ra", "rb", "na", "nb")
        pairs = store(pairs.mapInArrow(_estimated, "rep long, lead long, j double"), "estimates")
        edges.append(pairs.where(F.col("j") >= 2 * t - 1 - MARGIN).select(F.col("rep").alias("a"), F.col("lead").alias("b")))
        rest = open_.join(pairs.where(F.col("j") < t).drop("j"), ["rep", "lead"]).select("rep", "band")
        open_, left = _led(store(rest, "rest"))
    edges.append(open_.select(F.col("rep").alias("a"), F.col("lead").alias("b")))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out.distinct()


def exact_sets(words: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle numbers of all rows and the bounds of each row's part. Equal numbers are equal words. A row of fewer
    words than a shingle shares its only element with none, for rows of the same few words are one class."""
    g = T.gram_numbers(words.numbers(), SHINGLE)
    fit = np.flatnonzero(words.fits(SHINGLE)[: len(g)])
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    v, r = np.concatenate([g[fit], -1 - short]), np.concatenate([words.row[fit], short])
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.searchsorted(r[keep], np.arange(len(words.count) + 1))


def links(texts: pa.Array, old: np.ndarray, threshold: tuple[int, int] = THRESHOLD, pivot: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Verified links (row pairs) that join the rows as far as their sets allow, and each row's Jaccard distance to the pivot row. Rows with
    equal old labels need no link. Each row is compared with the rows of other labels by counting the shingles they share, so the links
    returned are a forest and the comparisons are complete."""
    raw, offsets = T.buffers(texts)
    values, bounds = exact_sets(T.Words(raw, offsets, T.NON_SPACE, T.LOWER))
    n = len(bounds) - 1
    size = np.diff(bounds)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    ids = np.unique(values, return_inverse=True)[1]
    post = row[order]
    start = np.searchsorted(ids[order], np.arange(ids.max() + 2 if len(ids) else 1))
    label = np.unique(old, return_inverse=True)[1].astype(np.int64)
    num, den = threshold

    def shared_with(i: int) -> np.ndarray:
        mine = ids[bounds[i] : bounds[i + 1]]
        return np.bincount(np.concatenate([post[start[x] : start[x + 1]] for x in mine]), minlength=n) if len(mine) else np.zeros(n, np.int64)

    out = []
    for i in range(1, n):
        if not size[i]:
            continue
        near = (size * den >= size[i] * num) & (size[i] * den >= size * num) & (label != label[i])
        near[i:] = False
        if not near.any():
            continue
        shared = shared_with(i)
        for j in np.flatnonzero(near & (shared * den >= num * (size + size[i] - shared))):
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    away = np.ones(n)
    if pivot is not None:
        shared = shared_with(pivot)
        away = 1 - shared / np.maximum(size + size[pivot] - shared, 1)
    return out, away


def _verify(threshold: tuple[int, int], measure: bool):
    """The links (a, b) of one block between reps, and with measure the distance d of each row a to the pivot, the row whose rep is the
    group's number; without it the links are between labels."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        rep, grp = table.column("rep").to_numpy(), table.column("grp")[0].as_py()
        pivot = int(np.searchsorted(rep, grp)) if measure else None
        pairs, away = links(table.column("text").combine_chunks(), table.column("label").to_numpy(), threshold, pivot)
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        name = rep if measure else table.column("label").to_numpy()
        out = pa.table({"a": name[a], "b": pa.array(name[b]), "d": pa.nulls(len(a), pa.float64())})
        if measure:
            out = pa.concat_tables([out, pa.table({"a": rep, "b": pa.nulls(len(rep), pa.int64()), "d": away})])
        return out

    return run


def _pieces(rows: Column, shingles: Column, most: int) -> Column:
    return F.greatest(F.ceil(rows / F.lit(most)), F.ceil(shingles / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = THRESHOLD, band_rows: int = BAND_ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; see the module's docstring. Pairs link from a Jaccard similarity of threshold
    (numerator, denominator); a lower one needs fewer registers a band to find as many of its pairs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digests = store(docs.mapInArrow(_digests, "doc_id long, n_shingles long, digest binary, registers binary"), "sketch")
    classes = (
        digests.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("registers").alias("registers"))
    )
    reps = store(classes, "classes")
    edges = candidate_edges(reps, threshold, band_rows)
    groups = components(edges, "candidates").withColumnRenamed("node", "rep").withColumnRenamed("component", "grp")
    members, seen = store_counted(groups.join(reps.select("rep", "n", "digest"), "rep"), "members", n=F.count(F.lit(1)))
    ids = small(members.select("rep", "digest"), seen["n"])
    texts = docs.join(ids, F.col("doc_id") == F.col("rep"), "inner")
    texts = store(_own_text(texts), "texts")
    sizes = members.groupBy("grp").agg(_pieces(F.count(F.lit(1)), F.sum("n"), BLOCK_ROWS).alias("cut"))
    placed = members.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int"))
    pivots = sizes.where("cut > 1").select(F.col("grp").alias("rep"), "grp", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("block"))
    ready = placed.select("rep", "grp", "block").unionByName(pivots).distinct().join(texts, "rep").withColumn("label", F.col("rep"))
    found = store(ready.groupBy("grp", "block").applyInArrow(_verify(threshold, True), "a long, b long, d double"), "links")
    joined = components(found.where("d is null"), "joined")
    several = sizes.where("cut > 1").select("grp")
    away = found.where("d is not null").groupBy(F.col("a").alias("rep")).agg(F.min("d").alias("d"))
    wide, count = store_counted(_cells(members, several, away, joined), "cells", n=F.count_if("minor"))
    if count["n"]:
        again = _visits(wide, 1 - threshold[0] / threshold[1]).join(texts, "rep")
        more = store(again.groupBy("grp", "cell", "part", "turn").applyInArrow(_verify(threshold, False), "a long, b long, d double"), "more-links")
        again = components(more.select("a", "b"), "rejoined").select(F.col("node").alias("component"), F.col("component").alias("last"))
        joined = joined.unionByName(members.select(F.col("rep").alias("node"), F.col("rep").alias("component")).join(joined.select("node"), "node", "left_anti"))
        joined = joined.join(again, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    final = reps.join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = digests.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id")
    )


def _own_text(texts: DataFrame) -> DataFrame:
    """rep, text from rows (rep, digest, text): the text of each rep that has the digest, once."""

    def run(batches):
        for batch in batches:
            raw, offsets = T.buffers(batch.column(2))
            folded = T.LOWER[raw].tobytes()
            good = [T.digest(folded[a:b]) == d for a, b, d in zip(offsets, offsets[1:], batch.column(1).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    own = texts.select("rep", "digest", "text").mapInArrow(run, "rep long, digest binary, text string")
    return own.dropDuplicates(["rep", "digest"]).drop("digest")


def _cells(members: DataFrame, several: DataFrame, away: DataFrame, joined: DataFrame) -> DataFrame:
    """rep, grp, n, d, label, minor of the members of groups of several blocks; minor: outside the group's largest joined set."""
    label = F.coalesce("component", "rep").alias("label")
    own = (
        members.join(several, "grp", "left_semi").join(away, "rep").join(joined, F.col("rep") == F.col("node"), "left")
        .select("rep", "grp", "n", "d", label)
    )
    counts = own.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("many"))
    most = counts.groupBy("grp").agg(F.max(F.struct("many", "label")).alias("m")).select("grp", F.col("m.label").alias("top"))
    return own.join(most, "grp").select("rep", "grp", "n", "d", "label", (F.col("label") != F.col("top")).alias("minor"))


def _visits(wide: DataFrame, reach: float) -> DataFrame:
    """rep, grp, cell, part, turn, label: every member once in its home (cell of the distance to the pivot, part of it) for each turn of its group's
    visitors, and minor members as visitors in the cells within their reach."""
    cell = lambda d: F.floor(d * CELLS).cast("int")
    part = lambda pieces: F.pmod(F.xxhash64("rep"), pieces).cast("int")
    wide = wide.withColumn("cell", cell(F.col("d")))
    minor = wide.where("minor")
    cells = wide.groupBy("grp", "cell").agg(_pieces(F.count(F.lit(1)), F.sum("n"), BLOCK_ROWS).alias("parts"))
    turns = minor.groupBy("grp").agg(_pieces(F.count(F.lit(1)), F.sum("n"), VISITORS).alias("turns"))
    home = wide.join(cells, ["grp", "cell"]).join(turns, "grp").select(
        "rep", "grp", "cell", part(F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "label"
    )
    low, high = cell(F.col("d") - F.lit(reach + 1e-9)), cell(F.col("d") + F.lit(reach + 1e-9))
    going = minor.drop("cell").withColumn("cell", F.explode(F.sequence(low, high))).join(cells, ["grp", "cell"]).join(turns, "grp")
    going = going.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "rep", "grp", "cell", "part", part(F.col("turns")).alias("turn"), "label"
    )
    return home.unionByName(going).dropDuplicates(["rep", "grp", "cell", "part", "turn"])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=(85, 100), band_rows=8)


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') || case when len(w) < 5 then chr(10) || len(w) else '' end g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*)::bigint n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) m from r group by a)
select w.doc_id, coalesce(n, 0)::bigint n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) component_id, w.doc_id <= coalesce(m, w.doc_id) kept
from w left join n using (doc_id) left join c on c.a = w.doc_id
"""
