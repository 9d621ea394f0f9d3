"""Removal of repeated byte strings by suffix arrays per shard.

A byte goes if a string of WINDOW bytes that covers it also starts anywhere else, in the same document or another.

* Windows are dealt by content first: the key of a window is the smallest hash of the K-byte strings in it, so equal windows have equal keys, and neighbouring windows
  mostly share one and travel as one segment. Only keys move for that. A key that occurs in one segment, and once in it, has no repeated window, and its segments go
  no further. A key seen twice in a map block is known to be shared and sends a few rows a task, not one an occurrence.
* The segments left carry their bytes to shards of about SHARD bytes. A key with more is split over several shards by a hash of the row.
* A shard holds each distinct segment once, with its number of copies. Its suffixes are sorted by Larsson-Sadakane refinement: groups of equal prefixes are split by the ranks
  of what follows, over twice the length each round, and only groups with several suffixes are sorted again. A rank pair and a position share one 63-bit number, so that a round is one
  sort. Common prefixes follow Kasai's inequality in waves of halved strides: each starts from what its left neighbour leaves and ends at what its right one allows. The intervals of
  WINDOW or more are the repeated windows.
* Shards of one key meet once more: each sends its distinct windows, sorted by fingerprints of 128 bits, and the sorted runs of all are merged by binary search. A window that is single in its
  shard and found in another is repeated. Fingerprints decide here only, between shards of one key.

Rules: a null text is empty. A row is named by a 64-bit hash of doc_id and text, so repeated rows are documents that repeat each other, and doc_ids may be null or repeated; among 3e9 rows
the odds that any two names collide are one in four, and then these two rows also lose each other's spans. Texts under WINDOW bytes lose nothing. Spans may cut a character, so what is kept is binary. A
very long text is one block of work: memory grows with the longest text. Ties cannot occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _text as T
from ledgerloom.llm._spark import partitions, small, store, store_counted
from ledgerloom.llm.substring import COUNT_BYTES, _joined, _packed, _PENDING, _SHARED

WINDOW = 400
K = 64
#: Bytes of segments in a shard, about; a heavier key is split. Positions of a shard take BITS bits.
SHARD = 1_500_000
BITS = 21
#: A longer run of windows with one key is cut.
CUT = 1 << 19
_KNOWN = 1 << 16
#: Positions measured at a time.
_WAVE = 1 << 17
_CODES = T.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MASK = np.uint64((1 << BITS) - 1)

_RANGES = "row long, key long, s int, n int"
_PIECES = "grp long, part int, row binary, key binary, s binary, size binary, text binary"
_FOUND = "row long, s int, e int, bucket long, run binary"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of width values."""
    if len(values) < width:
        return values[:0]
    have, least = 1, values
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - have : width - have + n])


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, row, s, n of the runs of windows with one key, and whether the key occurs more than once among these bytes. s counts from the row's start."""
    offsets = offsets - offsets[0]
    empty = tuple(np.zeros(0, kind) for kind in (np.uint64, np.int64, np.int64, np.int64, bool))
    if len(raw) < WINDOW:
        return empty
    grams = T.window_hashes(_CODES[raw], K)
    least = sliding_least(grams, WINDOW - K + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(np.arange(len(least)) + WINDOW <= offsets[row[: len(least)] + 1])
    if not len(at):
        return empty
    first, last = T.runs(at, least[at])
    start, n = at[first], last - first
    pieces = -(-n // CUT)
    if int(pieces.max()) > 1:
        which = np.repeat(np.arange(len(n)), pieces)
        k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, n = start[which] + k * CUT, np.minimum(n[which] - k * CUT, CUT)
    key = least[start]
    keys, back = np.unique(key, return_inverse=True)
    # occurrences of the keys' grams: one in several segments, or several in one segment
    table = np.zeros(1 << 16, bool)
    table[keys >> np.uint64(48)] = True
    near = np.flatnonzero(table[grams >> np.uint64(48)])
    slot = np.minimum(np.searchsorted(keys, grams[near]), len(keys) - 1)
    hit = keys[slot] == grams[near]
    shared = np.bincount(slot[hit], minlength=len(keys)) > 1
    return key, row[start], start - offsets[row[start]], n, shared[back]


def _keys(buckets: int):
    """Packed segments by bucket: those whose key is pending, and those whose key is known to be shared. Pending entries without length say that a key is shared."""

    def run(batches):
        known = np.zeros(_KNOWN, np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, offsets = T.buffers(batch.column(1))
            for a, b in T.blocks(offsets):
                key, row, s, n, shared = segments(raw[offsets[a] : offsets[b]], offsets[a : b + 1])
                if not len(key):
                    continue
                row = ids[a:b][row]
                for kind, own in ((_PENDING, ~shared), (_SHARED, shared)):
                    yield from _packed(key[own], row[own], s[own], n[own], kind, buckets)
                say = np.unique(key[shared])
                say = say[known[(say & np.uint64(_KNOWN - 1)).astype(np.int64)] != say]
                known[(say & np.uint64(_KNOWN - 1)).astype(np.int64)] = say
                nothing = np.zeros(2 * len(say), np.int64)
                yield from _packed(np.tile(say, 2), nothing, nothing, nothing, _PENDING, buckets)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket the segments whose key is shared."""
    out = []
    for kind in (_PENDING, _SHARED):
        part = table.filter(pc.equal(table.column("kind"), kind))
        if not part.num_rows:
            continue
        key, row = _joined(part, "key", np.uint64), _joined(part, "doc", np.int64)
        s, n = _joined(part, "s", np.int32), _joined(part, "n", np.int32)
        if kind == _PENDING:
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            keep = np.flatnonzero((count[back] > 1) & (n > 0))
            key, row, s, n = key[keep], row[keep], s[keep], n[keep]
        out.append(pa.table({"row": row, "key": key.view(np.int64), "s": s, "n": n}))
    return pa.concat_tables(out)


def _pieces(groups: int):
    """Bytes of the segments, packed for their shards. Columns: row, packed text, its size, segments."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, offsets = T.buffers(T.unpack(batch.column(1), batch.column(2)))
            lists = batch.column(3)
            cut = lists.offsets.to_numpy()
            flat = lists.values
            key, s, n, parts = (flat.field(i).to_numpy() for i in range(4))
            for a, b in T.blocks(offsets):
                row = np.repeat(np.arange(a, b), np.diff(cut[a : b + 1]))
                some = slice(cut[a], cut[b])
                if not len(row):
                    continue
                heavy, own, name = parts[some] > 1, key[some], ids[row]
                grp = np.where(heavy, own, (T.mix(own.view(np.uint64)) % np.uint64(groups)).view(np.int64))
                part = np.where(heavy, 1 + (T.mix(name.view(np.uint64)) % np.maximum(parts[some], 1).astype(np.uint64)).view(np.int64), 0)
                order = np.lexsort((part, grp))
                new = np.flatnonzero(np.concatenate([[True], (np.diff(grp[order]) != 0) | (np.diff(part[order]) != 0)]))
                at = np.append(new, len(order))
                lo = (offsets[row] + s[some])[order]
                hi = lo + n[some][order] + WINDOW - 1
                data = memoryview(raw)
                text = [b"".join([data[x:y] for x, y in zip(lo[i:j].tolist(), hi[i:j].tolist())]) for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grp[order][new]), pa.array(part[order][new].astype(np.int32)), T.split_binary(name, order, at), T.split_binary(own, order, at),
                        T.split_binary(s[some], order, at), T.split_binary((hi - lo).astype(np.int32), None, at), T.pack(pa.array(text, pa.binary()))[0],
                    ],
                    ["grp", "part", "row", "key", "s", "size", "text"],
                )

    return run


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of segments in order, by Larsson-Sadakane refinement; ends[i] is the end of the segment that holds position i. A suffix that is
    another's prefix comes first, and equal ones follow their positions."""
    n = len(text)
    if n >= 1 << BITS:
        raise ValueError("too many positions for a shard")
    place = np.arange(n, dtype=np.int32)
    left = ends.astype(np.int32) - place
    wide = np.append(text, np.zeros(4, np.uint8))
    key = np.zeros(n, np.uint64)
    for j in range(4):
        key <<= np.uint64(9)
        key |= np.where(left > j, wide[j : j + n].astype(np.uint16) + np.uint16(1), np.uint16(0))
    key <<= np.uint64(BITS)
    key |= place.view(np.uint32)
    key.sort()
    order = (key & _MASK).astype(np.int32)
    rank = np.empty(n, np.int32)
    open_ = place
    length, most = 4, int(left.max(initial=0))
    while True:
        # ranks of the groups just sorted: the place of each group's first suffix
        key >>= np.uint64(BITS)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        del key
        first = np.where(new, open_, np.int32(0))
        np.maximum.accumulate(first, out=first)
        first += np.int32(1)
        rank[order[open_]] = first
        del first
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = open_[~alone]
        if not len(open_) or length >= most:
            return order
        i = order[open_]
        after = np.where(left[i] > length, rank[np.minimum(i + np.int32(length), np.int32(n - 1))], np.int32(0))
        key = rank[i].astype(np.uint64)
        for part in (after, i):
            key <<= np.uint64(BITS)
            key |= part.view(np.uint32)
        del after, i, part
        key.sort()
        order[open_] = (key & _MASK).astype(np.int32)
        length *= 2


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray, enough: int = WINDOW) -> np.ndarray:
    """For each place in the order the length of the prefix shared with the suffix before, exact below enough. By text position these lengths
    fall by at most one a step (Kasai); positions are measured in waves of halved strides."""
    n, stride = len(text), 64
    cap = np.int32(enough + stride)
    if not n:
        return np.zeros(0, np.int32)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    ends = ends.astype(np.int32)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    shared = np.zeros(n, np.int32)
    step = stride
    while step:
        i = np.arange(0 if step == stride else step, n, step if step == stride else 2 * step, dtype=np.int32)
        i = i[before[i] >= 0]
        for a in range(0, len(i), _WAVE):
            _measure(eight, ends, before, shared, i[a : a + _WAVE], step, stride, cap, enough)
        step //= 2
    return shared[order]


def _measure(eight, ends, before, shared, i, step: int, stride: int, cap, enough: int) -> None:
    """A part of a wave: the prefixes that the positions i share with the suffixes before them."""
    n, p = len(shared), before[i]
    most = np.minimum(np.minimum(ends[i] - i, ends[p] - p), cap)
    at = np.zeros(len(i), np.int32)
    if step < stride:
        step = np.int32(step)
        at = np.maximum(shared[i - step] - step, np.int32(0))
        right = np.minimum(i + step, np.int32(n - 1))
        most = np.where((i + step < n) & (shared[right] < cap), np.minimum(most, shared[right] + step), most)
        at = np.minimum(at, most)
    wait = np.flatnonzero(at < most)
    if step < stride:
        wait = wait[at[wait] < enough]
    while len(wait):
        x = np.ascontiguousarray(eight[i[wait] + at[wait]]).view(np.uint64).ravel() ^ np.ascontiguousarray(eight[p[wait] + at[wait]]).view(np.uint64).ravel()
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int32) >> 3)
        at[wait] += same.astype(np.int32)
        wait = wait[(same == 8) & (at[wait] < most[wait])]
    shared[i] = np.minimum(at, most)


def repeated_windows(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position whether its window occurs at another, and the first position, in the array's order, of the same window; -1 without a window."""
    ends = ends.astype(np.int32)
    order = suffix_array(text, ends)
    head = common_prefixes(text, ends, order) < WINDOW
    start = np.flatnonzero(head).astype(np.int32)
    node = np.cumsum(head, dtype=np.int32)
    node -= np.int32(1)
    again, first = np.empty(len(text), bool), np.empty(len(text), np.int32)
    again[order] = (np.diff(np.append(start, np.int32(len(text)))) > 1)[node]
    first[order] = order[start][node]
    whole = ends - np.arange(len(text), dtype=np.int32) >= WINDOW
    first[~whole] = -1
    again &= whole
    return again, first


def _shards(buckets: int):
    """Of one group of segments: the spans that they lose; of a shard of a heavy key also its distinct windows, as sorted runs by bucket."""

    def run(table: pa.Table) -> pa.Table:
        size = _joined(table, "size", np.int32)
        row, s, key = _joined(table, "row", np.int64), _joined(table, "s", np.int32), _joined(table, "key", np.int64)
        sizes = [int(np.frombuffer(x, np.int32).sum()) for x in table.column("size").to_pylist()]
        raw, _ = T.buffers(T.unpack(table.column("text").combine_chunks(), pa.array(sizes)))
        part = table.column("part")[0].as_py()
        start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        order = np.argsort(key, kind="stable")
        out, at = [], 0
        while at < len(order):
            # whole keys up to the bound; equal windows have equal keys
            total = np.cumsum(size[order[at:]], dtype=np.int64)
            to = at + max(1, int(np.searchsorted(total, (1 << BITS) - 1)))
            if to < len(order) and not part:
                same = np.searchsorted(key[order], key[order[to]])
                to = int(same) if same > at else to
            own = order[at:to]
            out.append(_shard(raw, start, own, row[own], s[own], part, buckets))
            at = to
        return pa.concat_tables(out)

    return run


def _shard(raw, start, own, row, s, part: int, buckets: int) -> pa.Table:
    # bytes, for pa.array() never lets go of memory that it reads through a memoryview
    texts = pa.array([raw[a:b].tobytes() for a, b in zip(start[own].tolist(), start[own + 1].tolist())], pa.large_binary()).dictionary_encode()
    copy = texts.indices.to_numpy().astype(np.int64)
    text, offsets = T.buffers(texts.dictionary)
    copies = np.bincount(copy, minlength=len(offsets) - 1)
    seg = np.repeat(np.arange(len(copies), dtype=np.int32), np.diff(offsets))
    again, first = repeated_windows(text, offsets.astype(np.int32)[1:][seg])
    gone = again | ((first >= 0) & (copies > 1)[seg])
    w = np.flatnonzero(gone)
    a, b = T.runs(w, seg[w])
    lo, hi = w[a] - offsets[seg[w[a]]], w[b - 1] - offsets[seg[w[a]]] + WINDOW
    per = np.searchsorted(seg[w[a]], np.arange(len(copies) + 1))
    many = np.diff(per)[copy]
    which = np.repeat(np.arange(len(own)), many)
    span = np.repeat(per[copy] - (np.cumsum(many) - many), many) + np.arange(len(which))
    n = len(which)
    out = pa.table({
        "row": row[which], "s": (s[which] + lo[span]).astype(np.int32), "e": (s[which] + hi[span]).astype(np.int32), "bucket": pa.nulls(n, pa.int64()), "run": pa.nulls(n, pa.binary()),
    })
    if part:
        holder = np.empty(len(copies), np.int64)
        holder[copy] = np.arange(len(own))
        w = np.flatnonzero(first == np.arange(len(text)))
        mark = fingerprints(text)[w]
        to = (T.mix(mark["f"][:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        entry = np.zeros(len(w), _ENTRY)
        entry["mark"] = mark.view("S16").ravel()
        entry["row"], entry["s"], entry["single"] = row[holder[seg[w]]], s[holder[seg[w]]] + w - offsets[seg[w]], ~gone[w]
        order = np.lexsort((entry["mark"], to))
        dealt, cut = np.unique(to[order], return_index=True)
        cut = np.append(cut, len(order))
        runs = [entry[order[i:j]].tobytes() for i, j in zip(cut, cut[1:])]
        n = len(dealt)
        nothing = pa.array(np.zeros(n, np.int32))
        out = pa.concat_tables([out, pa.table({"row": pa.array(np.zeros(n, np.int64)), "s": nothing, "e": nothing, "bucket": dealt, "run": pa.array(runs, pa.binary())})])
    return out


_ENTRY = np.dtype([("mark", "S16"), ("row", np.int64), ("s", np.int32), ("single", bool)])


def fingerprints(text: np.ndarray) -> np.ndarray:
    """128 bits of the window at each position that has one, by two codes of bytes."""
    two = [T.window_hashes(codes[text], WINDOW) for codes in (_CODES, T.mix(_CODES + np.uint64(1)))]
    # no final zero byte, which a fixed-width string would not hold
    out = np.zeros(len(two[0]), [("f", ">u8", 2)])
    out["f"][:, 0], out["f"][:, 1] = two[0], two[1] | np.uint64(1)
    return out


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs of distinct windows as one, each window once; second marks what was found in more than one run. Pairs of runs are merged by binary search."""
    out = []
    runs = [(r, np.zeros(len(r), bool)) for r in runs]
    while len(runs) > 1:
        runs = [_two(*runs[i : i + 2], out) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return np.concatenate(out) if out else np.zeros(0, _ENTRY)


def _two(a, b, found: list) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs as one; the single windows that meet their equal go to found, once each."""
    (x, x_met), (y, y_met) = a, b
    at = np.searchsorted(x["mark"], y["mark"])
    hit = x["mark"][np.minimum(at, len(x) - 1)] == y["mark"] if len(x) else np.zeros(len(y), bool)
    there = at[hit]
    found.append(x[there][x["single"][there] & ~x_met[there]])
    found.append(y[hit & y["single"] & ~y_met])
    x_met = x_met.copy()
    x_met[there] = True
    return np.insert(x, at[~hit], y[~hit]), np.insert(x_met, at[~hit], y_met[~hit])


def _met(table: pa.Table) -> pa.Table:
    """Spans of the windows that occur in several shards, of one bucket."""
    found = merged([np.frombuffer(x, _ENTRY) for x in table.column("run").to_pylist()])
    found = found[np.lexsort((found["s"], found["row"]))]
    a, b = T.runs(found["s"].astype(np.int64), found["row"])
    return pa.table({"row": found["row"][a], "s": found["s"][a], "e": (found["s"][b - 1] + WINDOW).astype(np.int32)})


def _pack(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *T.pack(batch.column(2))], ["row", "doc_id", "packed", "size"])


def repeated_spans(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """row and the byte spans (s, e) it loses, as one list a row. rows: row, text; packed: row, packed, size."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark) * 4, -(-size // COUNT_BYTES))
    keys = rows.mapInArrow(_keys(buckets), "bucket long, kind int, key binary, doc binary, s binary, n binary")
    ranges = keys.groupBy("bucket").applyInArrow(_repeated, _RANGES)
    length = (F.col("n") + F.lit(WINDOW - 1)).cast("long")
    ranges, seen = store_counted(ranges, "segments", bytes=F.sum(length))
    groups = max(partitions(spark), -(-(seen["bytes"] or 0) // SHARD))
    heavy = ranges.groupBy("key").agg(F.sum(length).alias("bytes")).where(F.col("bytes") > SHARD)
    heavy, many = store_counted(heavy.select("key", F.ceil(F.col("bytes") / F.lit(SHARD)).cast("int").alias("parts")), "heavy", n=F.count(F.lit(1)))
    parts = F.lit(1).alias("parts")
    if many["n"]:
        ranges, parts = ranges.join(small(heavy, many["n"]), "key", "left"), F.coalesce("parts", F.lit(1)).alias("parts")
    wanted = ranges.groupBy("row").agg(F.collect_set(F.struct("key", "s", "n", parts)).alias("parts"))
    moved = packed.join(wanted, "row").select("row", "packed", "size", "parts").mapInArrow(_pieces(groups), _PIECES)
    found, left = store_counted(moved.groupBy("grp", "part").applyInArrow(_shards(buckets), _FOUND), "spans", runs=F.count("run"))
    spans = found.where("run is null").select("row", "s", "e")
    if left["runs"]:
        spans = spans.unionByName(found.where("run is not null").groupBy("bucket").applyInArrow(_met, "row long, s int, e int"))
    return spans.groupBy("row").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _kept(batches):
    for batch in batches:
        out = []
        spans = batch.column(3).to_pylist()
        for text, lost in zip(T.unpack(batch.column(1), batch.column(2)), spans):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            gone = np.zeros(len(data) + 1, np.int32)
            if lost:
                np.add.at(gone, [x["s"] for x in lost], 1)
                np.add.at(gone, [x["e"] for x in lost], -1)
            gone = np.cumsum(gone)[:-1] > 0
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
            out.append((len(data), int(gone.sum()), runs, data[~gone].tobytes()))
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left)."""
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(_pack, "row long, doc_id long, packed binary, size int")
    spans = repeated_spans(rows.select("row", "text"), packed.select("row", "packed", "size"))
    return packed.join(spans, "row", "left").select("doc_id", "packed", "size", "spans").mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def query(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
