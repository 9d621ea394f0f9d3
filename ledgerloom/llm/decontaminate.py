"""Benchmark passages in documents by a prefix-filtered set join.

A benchmark item is a set of windows: its runs of WINDOW words, or the whole of a shorter item. A window occurs where
all of its words follow each other in a document, that is, where the window's shingles (SHINGLE words each) are all
contained. For full containment the prefix of a window needs a single shingle, and the rarest one gives the fewest
candidates:

1. One pass counts, over all documents, the shingles that the benchmark has; each window's shingles are ordered by that
   count and the rarest is its prefix.
2. A second pass joins document shingles with the prefixes. A match fixes where the window would lie; it has to fit
   into the document there (length and position bounds), and then every word is compared over the item-sized window, by its hash and, where
   all hashes agree, by its bytes.

The index is broadcast in blocks of at most BLOCK_WORDS benchmark words; a larger benchmark takes several passes. A pass gives
word spans and items of the documents that it hits, without their texts; spans and items of several passes meet by (doc_id, digest of the text).
Documents are never grouped: a passage that a third of them hold is found in each on its own.

Nulls and texts without words have no hits. Equal windows of several items count for each of the items; items without
words occur nowhere. A null item_id counts as the empty string. A null doc_id is a value like any other; repeated document rows are answered one by
one. Other columns of either table are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _text as T
from ledgerloom.llm._spark import lean, store

WINDOW = 13
SHINGLE = 3
BLOCK_WORDS = 2_000_000
#: contaminated: hit words times this reach the document's words.
SHARE = 20
_FILTER_BITS = 20


def _words(texts: list[str]) -> T.Words:
    raw, offsets = T.buffers(pa.array(texts, pa.large_string()))
    return T.Words(raw, offsets, T.ALNUM, T.LOWER)


class Windows:
    """Distinct windows of benchmark items: their words and these words' hashes, the items of each, and all of their shingles."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        words = _words([text or "" for _, text in items])
        h = words.hashes()
        starts, sizes, owner = [], [], []
        for r, n in enumerate(words.count):
            size = min(WINDOW, int(n))
            if size:
                at = np.arange(words.row_ptr[r], words.row_ptr[r] + n - size + 1)
                starts.append(at)
                sizes.append(np.full(len(at), size))
                owner.append(np.full(len(at), r))
        self.names = [name for name, _ in items]
        empty = np.zeros(0, np.int64)
        start, size, owner = (np.concatenate(x) if x else empty for x in (starts, sizes, owner))
        table, numbers = np.zeros((len(start), WINDOW), np.uint64), np.full((len(start), WINDOW), -1)
        number = words.numbers()
        for j in range(WINDOW):
            fits = size > j
            table[fits, j] = h[start[fits] + j]
            numbers[fits, j] = number[start[fits] + j]
        first, where = np.unique(numbers, axis=0, return_index=True, return_inverse=True)[1:] if len(start) else (empty, empty)
        where = where.ravel()
        self.words, self.size = table[first], size[first]
        data = words.raw.tobytes()
        self.texts = [b" ".join(data[x:y] for x, y in zip(words.starts[s : s + k], words.ends[s : s + k])) for s, k in zip(start[first], self.size)]
        order = np.lexsort((owner, where))
        self.items, self.item_ptr = owner[order], np.searchsorted(where[order], np.arange(len(first) + 1))
        self.shingles = {}
        for k in range(1, SHINGLE + 1):
            own = np.flatnonzero(np.minimum(self.size, SHINGLE) == k)
            if len(own):
                cells = np.stack([T.window_hashes(np.append(w, np.uint64(0)), k)[:WINDOW - k + 1] for w in self.words[own]])
                self.shingles[k] = (own, cells)

    def keys(self) -> dict[int, np.ndarray]:
        """Distinct shingle hashes by the number of words."""
        out = {}
        for k, (own, cells) in self.shingles.items():
            inside = np.arange(cells.shape[1]) <= (self.size[own] - k)[:, None]
            out[k] = np.unique(cells[inside])
        return out

    def prefixes(self, counts: dict[int, dict[int, int]]) -> dict[int, tuple]:
        """Per shingle length: sorted rarest shingles, and the windows and offsets of each."""
        out = {}
        for k, (own, cells) in self.shingles.items():
            seen = counts.get(k, {})
            uniq, back = np.unique(cells, return_inverse=True)
            many = np.array([seen.get(int(x.view(np.int64)), 0) for x in uniq], np.int64)[back.reshape(cells.shape)]
            many = np.where(np.arange(cells.shape[1]) <= (self.size[own] - k)[:, None], many, np.iinfo(np.int64).max)
            offset = np.argmin(many, axis=1)
            key = cells[np.arange(len(own)), offset]
            order = np.argsort(key, kind="stable")
            key, window, offset = key[order], own[order], offset[order]
            distinct, first = np.unique(key, return_index=True)
            out[k] = (distinct, np.append(first, len(key)), window, offset, _filter(distinct))
        return out


def _filter(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _FILTER_BITS, bool)
    table[(keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return table


def _lookup(g: np.ndarray, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of g whose value is in keys, and the value's index there."""
    at = np.flatnonzero(table[(g & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    if not len(at):
        return at, at
    i = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
    ok = keys[i] == g[at]
    return at[ok], i[ok]


def _shingles(words: T.Words, h: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes by position; those that leave their row are 0."""
    g = T.window_hashes(h, k)
    g[~words.fits(k)[: len(g)]] = 0
    return g


def _counts(shared):
    def run(batches):
        keys = shared.value
        tables = {k: _filter(v) for k, v in keys.items()}
        total = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
        for batch in batches:
            raw, offsets = T.buffers(batch.column(0))
            for a, b in T.blocks(offsets):
                words = T.Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1], T.ALNUM, T.LOWER)
                h = words.hashes()
                for k, v in keys.items():
                    _, i = _lookup(_shingles(words, h, k), v, tables[k])
                    total[k] += np.bincount(i, minlength=len(v))
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), k, np.int32)), pa.array(keys[k][some].view(np.int64)), pa.array(n[some])],
                ["k", "key", "n"],
            )

    return run


def _says(words: T.Words, data: bytes, start: int, text: bytes, k: int) -> bool:
    """Whether the k words from start on are the window's."""
    if data[words.starts[start] : words.ends[start + k - 1]] == text:
        return True
    return b" ".join(data[x:y] for x, y in zip(words.starts[start : start + k], words.ends[start : start + k])) == text


def hits(words: T.Words, h: np.ndarray, windows: Windows, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """Verified occurrences: word positions of their starts and the windows' numbers."""
    found_at, found, data = [], [], words.raw.tobytes()
    for k, (keys, ptr, window, offset, table) in index.items():
        at, i = _lookup(_shingles(words, h, k), keys, table)
        n = ptr[i + 1] - ptr[i]
        entry = np.repeat(ptr[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        w = window[entry]
        start = at - offset[entry]
        row = words.row[at]
        ok = (start >= words.row_ptr[row]) & (start + windows.size[w] <= words.row_ptr[row + 1])
        start, w = start[ok], w[ok]
        for j in range(WINDOW):
            if not len(start):
                break
            inside = windows.size[w] > j
            same = ~inside
            same[inside] = h[start[inside] + j] == windows.words[w[inside], j]
            start, w = start[same], w[same]
        ok = np.fromiter((_says(words, data, s, windows.texts[x], k) for s, x, k in zip(start.tolist(), w.tolist(), windows.size[w].tolist())), bool, len(start))
        found_at.append(start[ok])
        found.append(w[ok])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_at), np.concatenate(found)) if found else (empty, empty)


def _scan(shared, only_hits: bool):
    """doc_id, key, n_words, spans, items of documents (doc_id, text, key); of all of them, or of those that are hit."""

    def run(batches):
        windows, index = shared.value
        for batch in batches:
            raw, offsets = T.buffers(batch.column(1))
            spans: list = [None] * batch.num_rows
            names: list = [None] * batch.num_rows
            n_words = np.zeros(len(offsets) - 1, np.int64)
            for a, b in T.blocks(offsets):
                words = T.Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1], T.ALNUM, T.LOWER)
                h = words.hashes()
                n_words[a:b] = words.count
                start, w = hits(words, h, windows, index)
                if not len(start):
                    continue
                edge = np.zeros(len(h) + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + windows.size[w], -1)
                covered = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                first, last = T.runs(covered, words.row[covered])
                row = words.row[covered[first]]
                for r, x, y in zip(row, covered[first] - words.row_ptr[row], covered[last - 1] + 1 - words.row_ptr[row]):
                    spans[a + r] = [*(spans[a + r] or []), {"s": int(x), "e": int(y)}]
                both = np.unique(np.column_stack([words.row[start], w]), axis=0)
                for r, x in both:
                    own = windows.items[windows.item_ptr[x] : windows.item_ptr[x + 1]]
                    names[a + r] = [*(names[a + r] or []), *[windows.names[i] for i in own]]
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                    pa.array([sorted(set(x)) if x else x for x in names], pa.list_(pa.string())),
                ],
                ["doc_id", "key", "n_words", "spans", "items"],
            )
            yield out.filter(pa.array([x is not None for x in spans], pa.bool_())) if only_hits else out

    return run


def _digest(batches):
    """Of rows (doc_id, n_words, spans, items): what is counted of them; spans and items may come from several passes."""
    for batch in batches:
        n_hit, n_items, digest = [], [], []
        for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            names = sorted(set(items or []))
            n_hit.append(_covered(spans or []))
            n_items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), batch.column(2)],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans"],
        )


def _covered(spans: list[dict]) -> int:
    """Words that the spans cover together."""
    total, last = 0, -1
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        total += max(0, e - max(s, last))
        last = max(last, e)
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit word ranges)."""
    spark = docs.sparkSession
    lean(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // (4 * BLOCK_WORDS)))
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))) if n > 1 else F.lit(None).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    found = []
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == block) if n > 1 else items
        windows = Windows([(r[0], r[1]) for r in part.collect()])
        keys = windows.keys()
        counts: dict[int, dict[int, int]] = {}
        if keys:
            rare = texts.select("text").mapInArrow(_counts(spark.sparkContext.broadcast(keys)), "k int, key long, n long")
            for r in rare.groupBy("k", "key").agg(F.sum("n")).collect():
                counts.setdefault(r[0], {})[r[1]] = r[2]
        shared = spark.sparkContext.broadcast((windows, windows.prefixes(counts)))
        found.append(texts.mapInArrow(_scan(shared, block > 0), "doc_id long, key binary, n_words long, spans array<struct<s:int,e:int>>, items array<string>"))
    out = found[0]
    if n > 1:
        found = [store(x, "decontaminate") for x in found]
        all_hits = reduce(DataFrame.unionByName, found).where("spans is not null").groupBy("doc_id", "key").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
        other = all_hits.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "spans", "items")
        out = found[0].select("doc_id", "key", "n_words").join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    out = out.select("doc_id", "n_words", "spans", "items").mapInArrow(
        _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<s:int,e:int>>"
    )
    bad = (F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", bad)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (select doc_id, {_WORDS} w from documents), b as (select coalesce(item_id::varchar, '') item, {_WORDS} w from benchmark),
bw as (select distinct item, least(13, len(w)) k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') g from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from b where len(w) > 0)),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) i from d, (select distinct k from bw))),
h as (select doc_id, i, bw.k, item from dw join bw on dw.k = bw.k and dw.g = bw.g),
p as (select doc_id, count(distinct i + j) n from h, (select unnest(range(0, 13)) j) where j < k group by doc_id),
t as (select doc_id, count(distinct item) n, array_to_string(list_sort(list(distinct item)), ',') names from h group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(p.n, 0)::bigint n_hit, coalesce(t.n, 0)::bigint n_items, sha256(coalesce(names, '')) items_sha256,
  (coalesce(p.n, 0) > 0 and 20 * coalesce(p.n, 0) >= len(w)) contaminated from d left join p using (doc_id) left join t using (doc_id)
"""
