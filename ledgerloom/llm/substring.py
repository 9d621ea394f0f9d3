"""Removal of repeated word passages by prefix-partitioned suffix trees.

Every word starts a suffix. Two suffixes share a passage of at least WINDOW words exactly if they hang below a common
internal node of word depth WINDOW or more of the generalised suffix tree. The tree is never held whole: suffixes are
split by a prefix of variable length, and subtrees are packed into groups of bounded size.

* The prefix of a suffix ends where the smallest K-gram hash of its first WINDOW words lies, so it is K to WINDOW words
  long, equal windows have equal prefixes, and neighbouring suffixes mostly share one and travel as one segment.
* Prefix counts come first. Only prefix keys are moved for that, to as many groups as the texts' bytes ask for. A prefix
  that occurs in one document has no deep internal node below it, and its suffixes go no further. Within a map block a
  window seen before in a smaller doc_id is settled on the spot, and a prefix seen in two documents of a block is known to
  be shared, so a common passage or phrase sends a few rows a task to its prefix's group, not one a document.
* The segments left carry their words. Light prefixes are packed into groups of about GROUP_WORDS. A prefix heavier than
  that is lengthened: its segments are first settled in parts of bounded size, by a hash of the document, which leaves the first
  document of each window and part, and these windows meet again under the longest prefix, all of their WINDOW words.
* In a group the suffixes are sorted by their words to the ends of their segments (a suffix array by prefix doubling over
  exact word numbers), neighbours' common prefixes are measured, and the intervals of WINDOW or more are the topmost deep
  nodes. The smallest doc_id below a node keeps the passage; all other suffixes there lose it. Every deeper node, and so
  every maximal repeat, lies below one of these; consecutive windows lost are one span.

Texts meet their segments and spans, compressed, by a shuffle on doc_id at every size; the spans of a large corpus have no bound that
would allow a broadcast.

Nulls have no words. Rows of one doc_id are never judged against each other and lose the same word positions. Rows whose doc_id is
null are left whole and take nothing from others. Texts shorter than a window stay whole. Other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _text as T
from ledgerloom.llm._spark import partitions, small, store, store_counted

WINDOW = 13
K = 5
#: Words of segments in a group of subtrees, about; a heavier prefix is lengthened.
GROUP_WORDS = 1_000_000
#: Bytes of text whose prefix keys a group counts, about.
COUNT_BYTES = 16 << 20
_KNOWN = 1 << 16
_PENDING, _REMOVED, _SHARED = 0, 1, 2

_RANGES = "doc_id long, key long, s int, e int, removed boolean"
_PACKED = "grp long, part int, doc binary, s binary, size binary, text binary"
_FOUND = "doc_id long, s int, e int, key long, text string"


def prefix_keys(h: np.ndarray) -> np.ndarray:
    """For each window start, the smallest K-gram hash in the window (the end of its variable-length prefix)."""
    g = T.window_hashes(h, K)
    width = WINDOW - K + 1
    if len(g) < width:
        return np.zeros(0, np.uint64)
    have, least = 1, g
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    n = len(g) - width + 1
    return np.minimum(least[:n], least[width - have : width - have + n])


def suffix_array(numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of segments, sorted by their words' numbers, and the length of the prefix that each shares with the
    one before it. ends[i] is the end of the segment that holds position i; no suffix reaches over it."""
    n = len(numbers)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - np.arange(n)
    ranks, length = [np.unique(numbers, return_inverse=True)[1].astype(np.int64) + 1], 1
    while length < int(size.max()):
        after = np.zeros(n, np.int64)
        reach = np.flatnonzero(size > length)
        after[reach] = ranks[-1][reach + length]
        rank = np.unique(ranks[-1] * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        ranks.append(rank)
        length *= 2
        if int(rank.max()) == n:
            break
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[1:], order[:-1]
    most, shared = np.minimum(size[a], size[b]), np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        open_ = np.flatnonzero(shared + step <= most)
        same = ranks[level][a[open_] + shared[open_]] == ranks[level][b[open_] + shared[open_]]
        # a rank of this level speaks of step words only where both suffixes have as many left
        shared[open_[same]] += step
    return order, np.concatenate([[0], shared])


def later(order: np.ndarray, node: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window start, whether a smaller doc_id hangs below its node."""
    if not len(order):
        return np.zeros(0, bool)
    d = doc[order]
    least = np.minimum.reduceat(d, np.flatnonzero(np.diff(node, prepend=-1)))
    out = np.empty(len(order), bool)
    out[order] = d > least[node]
    return out


def equal_windows(h: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the window starts at and, in that order, the number of the node of depth WINDOW that each hangs below.
    Neighbours are compared by all of their words; a node that a collision splits is settled in its group."""
    f = T.window_hashes(h, WINDOW)[at]
    order = np.argsort(f, kind="stable")
    f = f[order]
    new = np.ones(len(at), bool)
    new[1:] = f[1:] != f[:-1]
    again = np.flatnonzero(~new)
    a, b = at[order[again]], at[order[again - 1]]
    differ = np.zeros(len(again), bool)
    for j in range(WINDOW):
        differ |= numbers[a + j] != numbers[b + j]
    new[again[differ]] = True
    return order, np.cumsum(new) - 1


def _by_key(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest and largest doc of each, and the number of each entry's key."""
    keys, back = np.unique(key, return_inverse=True)
    order = np.argsort(back, kind="stable")
    first = np.searchsorted(back[order], np.arange(len(keys)))
    d = doc[order]
    return keys, np.minimum.reduceat(d, first), np.maximum.reduceat(d, first), back


def _prefixes(buckets: int):
    """Packed entries by bucket: segments whose prefix is pending, spans that are removed, segments known to be shared.
    Pending entries without length say that a key is shared."""

    def run(batches):
        known = np.zeros(_KNOWN, np.uint64)
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            batch = batch.take(pc.sort_indices(batch.column(0)))
            ids = batch.column(0).to_numpy()
            raw, offsets = T.buffers(batch.column(1))
            for a, b in T.blocks(offsets):
                words = T.Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1], T.NON_SPACE)
                if len(words.starts) < WINDOW:
                    continue
                h = words.hashes()
                key = prefix_keys(h)
                at = np.flatnonzero(words.fits(WINDOW)[: len(key)])
                if not len(at):
                    continue
                doc = ids[a:b][words.row]
                gone = later(*equal_windows(h, words.numbers(), at), doc[at])
                w = at[gone]
                first, last = T.runs(w, words.row[w])
                parts = [(np.zeros(len(first), np.uint64), w[first], w[last - 1] + 1 if len(first) else first, _REMOVED)]
                w = at[~gone]
                if len(w):
                    first, last = T.runs(w, words.row[w], key[w])
                    k, s, e = key[w[first]], w[first], w[last - 1] + 1
                    keys, low, high, back = _by_key(k, doc[s])
                    shared = low != high
                    parts += [(k[x], s[x], e[x], kind) for x, kind in ((~shared[back], _PENDING), (shared[back], _SHARED))]
                    slot = (keys & np.uint64(_KNOWN - 1)).astype(np.int64)
                    say = np.flatnonzero(shared & (known[slot] != keys))
                    known[slot[say]] = keys[say]
                    yield from _packed(np.tile(keys[say], 2), np.concatenate([low[say], high[say]]), np.zeros(2 * len(say), np.int64), np.zeros(2 * len(say), np.int64), _PENDING, buckets)
                for k, s, e, kind in parts:
                    yield from _packed(k, doc[s], s - words.row_ptr[words.row[s]], e - s, kind, buckets)

    return run


def _packed(key, doc, s, n, kind: int, buckets: int):
    if len(key):
        to = ((T.mix(key) if kind == _PENDING else T.mix(doc.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        own, cut = np.unique(to[order], return_index=True)
        cut = np.append(cut, len(order))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own), pa.array(np.full(len(own), kind, np.int32)), T.split_binary(key, order, cut), T.split_binary(doc, order, cut),
                T.split_binary(s.astype(np.int32), order, cut), T.split_binary(n.astype(np.int32), order, cut),
            ],
            ["bucket", "kind", "key", "doc", "s", "n"],
        )


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    column = table.column(name)
    if not pa.types.is_binary(column.type):
        return column.to_numpy().astype(kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _repeated(table: pa.Table) -> pa.Table:
    """Of one group: settled spans and shared segments as they are, and the pending segments whose prefix occurs in two
    documents."""
    out = []
    for kind in (_PENDING, _REMOVED, _SHARED):
        part = table.filter(pc.equal(table.column("kind"), kind))
        if not part.num_rows:
            continue
        key, doc = _joined(part, "key", np.uint64), _joined(part, "doc", np.int64)
        s, n = _joined(part, "s", np.int32), _joined(part, "n", np.int32)
        if kind == _PENDING:
            _, low, high, back = _by_key(key, doc)
            keep = np.flatnonzero((low != high)[back] & (n > 0))
            key, doc, s, n = key[keep], doc[keep], s[keep], n[keep]
        end = s + n + WINDOW - 1
        out.append(pa.table({"doc_id": doc, "key": key.view(np.int64), "s": s, "e": end.astype(np.int32), "removed": np.full(len(doc), kind == _REMOVED)}))
    return pa.concat_tables(out)


def _segments(groups: int):
    """Words of the segments, packed for the groups of their prefixes. Columns: doc_id, packed text, its size, segments."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, offsets = T.buffers(T.unpack(batch.column(1), batch.column(2)))
            lists = batch.column(3)
            cut = lists.offsets.to_numpy()
            flat = lists.values
            if isinstance(flat, pa.ExtensionArray):
                flat = flat.storage
            key, s, e, parts = (flat.field(i).to_numpy() for i in range(4))
            for a, b in T.blocks(offsets):
                words = T.Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1], T.NON_SPACE)
                row = np.repeat(np.arange(b - a), np.diff(cut[a : b + 1]))
                some = slice(cut[a], cut[b])
                if not len(words.starts):
                    continue
                first = np.minimum(words.row_ptr[row] + s[some], len(words.starts) - 1)
                last = np.minimum(words.row_ptr[row] + e[some] - 1, len(words.starts) - 1)
                doc, heavy = ids[a:b][row], parts[some] > 1
                grp = np.where(heavy, key[some], (T.mix(key[some].view(np.uint64)) % np.uint64(groups)).view(np.int64))
                part = np.where(heavy, 1 + (T.mix(doc.view(np.uint64)) % np.maximum(parts[some], 1).astype(np.uint64)).view(np.int64), 0)
                order = np.lexsort((part, grp))
                new = np.flatnonzero(np.concatenate([[True], (np.diff(grp[order]) != 0) | (np.diff(part[order]) != 0)]))
                at = np.append(new, len(order))
                lo, hi = words.starts[first][order], words.ends[last][order]
                data = words.raw.tobytes()
                text = [b"".join([data[x:y] for x, y in zip(lo[i:j], hi[i:j])]) for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grp[order][new]), pa.array(part[order][new].astype(np.int32)), T.split_binary(doc, order, at), T.split_binary(s[some], order, at),
                        T.split_binary((hi - lo).astype(np.int32), None, at), T.pack(pa.array(text, pa.binary()))[0],
                    ],
                    ["grp", "part", "doc", "s", "size", "text"],
                )

    return run


def _subtrees(table: pa.Table) -> pa.Table:
    """Of one group of subtrees: the word spans that suffixes below deep nodes lose; of a part of a heavy prefix also the
    windows that its first documents keep, with their words and the hash of them."""
    doc, s = _joined(table, "doc", np.int64), _joined(table, "s", np.int32)
    if pa.types.is_binary(table.column("size").type):
        size = _joined(table, "size", np.int32)
        sizes = [int(np.frombuffer(x, np.int32).sum()) for x in table.column("size").to_pylist()]
        raw, _ = T.buffers(T.unpack(table.column("text").combine_chunks(), pa.array(sizes)))
    else:
        raw, offsets = T.buffers(table.column("text"))
        size = np.diff(offsets)
    words = T.Words(raw, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), T.NON_SPACE)
    order, shared = suffix_array(words.numbers(), words.row_ptr[words.row + 1])
    fits = words.fits(WINDOW)
    node = np.cumsum(shared < WINDOW) - 1
    whole = fits[order]
    order, node = order[whole], np.unique(node[whole], return_inverse=True)[1]
    gone = np.zeros(len(words.starts), bool)
    if len(order):
        d = doc[words.row[order]]
        least = np.minimum.reduceat(d, np.flatnonzero(np.diff(node, prepend=-1)))
        gone[order] = d > least[node]
    w = np.flatnonzero(gone)
    row = words.row[w]
    first, last = T.runs(w, row)
    start = w[first] - words.row_ptr[row[first]] + s[row[first]]
    length = w[last - 1] - w[first] + WINDOW if len(first) else first
    n = len(first)
    out = pa.table({
        "doc_id": doc[row[first]], "s": start.astype(np.int32), "e": (start + length).astype(np.int32), "key": pa.nulls(n, pa.int64()), "text": pa.nulls(n, pa.string()),
    })
    if table.num_rows and table.column("part")[0].as_py():
        w = np.flatnonzero(fits & ~gone)
        row, data = words.row[w], words.raw.tobytes()
        at = (w - words.row_ptr[row] + s[row]).astype(np.int32)
        key = T.window_hashes(words.hashes(), WINDOW)[w].view(np.int64)
        text = [data[x:y].decode() for x, y in zip(words.starts[w], words.ends[w + WINDOW - 1])]
        out = pa.concat_tables([out, pa.table({"doc_id": doc[row], "s": at, "e": at + np.int32(WINDOW), "key": key, "text": pa.array(text, pa.string())})])
    return out


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, packed, size: what the shuffles move of a text."""
    return docs.mapInArrow(_pack, "doc_id long, packed binary, size int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the word spans (s, e) it loses, as one list a document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark) * 4, -(-size // COUNT_BYTES))
    packed = docs.mapInArrow(_prefixes(buckets), "bucket long, kind int, key binary, doc binary, s binary, n binary")
    ranges = packed.groupBy("bucket").applyInArrow(_repeated, _RANGES)
    words = F.when(~F.col("removed"), (F.col("e") - F.col("s")).cast("long"))
    ranges, seen = store_counted(ranges, "prefixes", words=F.sum(words))
    groups = max(partitions(spark), -(-(seen["words"] or 0) // GROUP_WORDS))
    segments = ranges.where("not removed")
    heavy = segments.groupBy("key").agg(F.sum((F.col("e") - F.col("s")).cast("long")).alias("words")).where(F.col("words") > GROUP_WORDS)
    heavy, many = store_counted(heavy.select("key", F.ceil(F.col("words") / F.lit(GROUP_WORDS)).cast("int").alias("parts")), "heavy", n=F.count(F.lit(1)))
    parts = F.lit(1).alias("parts")
    if many["n"]:
        segments, parts = segments.join(small(heavy, many["n"]), "key", "left"), F.coalesce("parts", F.lit(1)).alias("parts")
    wanted = segments.groupBy("doc_id").agg(F.collect_list(F.struct("key", "s", "e", parts)).alias("parts"))
    moved = packed_texts(docs).join(wanted, "doc_id").select("doc_id", "packed", "size", "parts").mapInArrow(_segments(groups), _PACKED)
    found = moved.groupBy("grp", "part").applyInArrow(_subtrees, _FOUND)
    if many["n"]:
        found, left = store_counted(found, "subtrees", n=F.count("text"))
        to = F.pmod("key", F.lit(max(partitions(spark), -(-left["n"] * WINDOW // GROUP_WORDS))))
        again = found.where("text is not null").select(
            to.alias("grp"), F.lit(0).alias("part"), F.col("doc_id").alias("doc"), "s", F.lit(0).alias("size"), "text"
        )
        found = found.where("text is null").unionByName(again.groupBy("grp", "part").applyInArrow(_subtrees, _FOUND))
    spans = found.select("doc_id", "s", "e").unionByName(ranges.where("removed").select("doc_id", "s", "e"))
    spans = spans.groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return store(spans, "spans")


def _pack(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *T.pack(batch.column(1))], ["doc_id", "packed", "size"])


def _cut(batches):
    for batch in batches:
        out = []
        spans = batch.column(3).to_pylist()
        texts = T.unpack(batch.column(1), batch.column(2)).to_pylist()
        for text, lost in zip(texts, spans):
            words = (text or b"").split()
            n = len(words)
            if lost:
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, [min(n, x["s"]) for x in lost], 1)
                np.add.at(edge, [min(n, x["e"]) for x in lost], -1)
                keep = np.cumsum(edge)[:n] == 0
                words = [words[i] for i in np.flatnonzero(keep)]
            kept = b" ".join(words)
            out.append((n, n - len(words), kept.decode(), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs)
    return packed_texts(docs).join(spans, "doc_id", "left").select("doc_id", "packed", "size", "spans").mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 11)) i from w where len(w) >= 13),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') k from s),
b as (select doc_id, i, min(doc_id) over (partition by k) as first from g),
r as (select distinct doc_id, i + j as p from b, (select unnest(range(0, 13)) j) where first < doc_id),
l as (select doc_id, list(p) lost from r group by doc_id),
k as (select w.doc_id, w, list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_contains(coalesce(lost, []), i) then null else w[i] end), lambda x: x is not null) kept from w left join l using (doc_id))
select doc_id, len(w)::bigint n_words, (len(w) - len(kept))::bigint n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) kept_sha256 from k
"""
