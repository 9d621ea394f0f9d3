"""Alignment of two tokenizers over the same bytes by an event sweep.

Every token of either tokenizer is an event at the byte where it ends. The events of both, A and B, are united, repartitioned by document and sorted
within partitions by offset; a state machine streams through them. Its state is what has come since the last byte where tokens of both end: when
both end again, those tokens are a group and the two last ones are a link. A document of any length passes in rows of STRIDE bytes of text, so the state
grows with the longest group, not with the text.

An event row holds the events of one tokenizer with ends in one stride: its place and the ids, from whose byte lengths the ends follow. Ids are
packed, since a text has a token every two to four bytes.

How often an id pair is linked corpus-wide is counted from each document's distinct pairs, summed per task first. Documents meet the
table of pairs again in slices of SLICE pairs, which are broadcast one at a time, so neither frequent pairs nor a large table meet in one task.

Rules: byte strings of both sides must equal a space and the text; a text that is null, empty, or for which they differ (a normaliser changed it, or it holds
the piece that stands for the space) has no tokens: zeros and an empty groups_sha256. Special tokens' strings inside texts are plain text. Every row of the input is a
document of its own, also with a null or repeated doc_id. Ties among the most frequent partners of a B id all count as best. An empty table gives an empty
result. Other columns are ignored. doc_id is cast to long.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _text as T
from ledgerloom.llm._spark import lean, store, store_counted

#: Files of the tokenizers; every executor has them under this path.
A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose events travel in a row.
STRIDE = 1 << 16
#: Pairs of ids that are broadcast at a time, 17 bytes each.
SLICE = 2_000_000
#: A piece of a long document's links is written after so many.
FLUSH = 1 << 20
#: Fixed value: the word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A pair is one number: the A id above the B id.
SHIFT = 32

_EVENTS = "row long, doc_id long, at long, side int, ids binary"
_SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


class ByteLevel:
    """A byte-level BPE tokenizer file. Its merges run in the same order as its ids, so the ids are the ranks of a faster encoder of the same vocabulary,
    which gives the same ids; texts that encoder refuses go through the file's own."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        self.path, self.tokens = path, [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = True
        return own

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        except BaseException as e:  # the native library panics on some very long runs, with an exception of its own
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return np.array(self.slow.encode(" " + text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """A sentence-piece model with byte fallback; it adds the space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.model.get_piece_size())
        ]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)


class Side:
    """A tokenizer with its tokens' bytes and lengths."""

    def __init__(self, own) -> None:
        self.encode = own.encode
        self.bytes = pa.array(own.tokens, pa.binary())
        self.length = np.array([len(t) for t in own.tokens], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return T.buffers(self.bytes.take(pa.array(ids)))[0].tobytes()


@functools.cache
def sides(a_path: str, b_path: str) -> tuple[Side, Side]:
    return Side(ByteLevel(a_path)), Side(Pieces(b_path))


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type that holds them, its width first, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    data = bytes([kind.itemsize]) + values.astype(kind).tobytes()
    return len(data).to_bytes(8, "little") + T._ZSTD.compress(data, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    raw = T._ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _end_events(a_path: str, b_path: str, stride: int):
    """Event rows of both tokenizers; a document without tokens has one row without a side."""

    def run(batches):
        both = sides(a_path, b_path)
        for batch in batches:
            for i in range(batch.num_rows):
                row, doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                out = []
                if text:
                    data = b" " + text.encode()
                    for side, own in enumerate(both):
                        ids = own.encode(text)
                        if own.joined(ids) != data:
                            out = []
                            break
                        ends = np.cumsum(own.length[ids])
                        cuts = np.concatenate([[0], np.searchsorted(ends, np.arange(stride, len(data), stride), "right"), [len(ids)]])
                        out += [(k, side, pack(ids[x:y])) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
                at, side, ids = zip(*out) if out else ((0,), (-1,), (b"",))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(at), pa.int64()), pa.array([doc] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(side, pa.int32()), pa.array(ids, pa.binary())],
                    ["row", "doc_id", "at", "side", "ids"],
                )

    return run


class Groups:
    """Text of the groups, built from whole arrays: every id with the mark that follows it."""

    def __init__(self, ids: int) -> None:
        self.text = pa.array([f"{i}{mark}" for i in range(ids) for mark in ",|;"], pa.string())

    def of(self, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray) -> bytes:
        """a and b hold whole groups, numbered from 0; the result ends with the mark of the last group."""
        n = int(b_group[-1]) + 1
        a_size, b_size = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        out = np.empty(len(a) + len(b), np.int64)
        a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_mark[np.cumsum(a_size) - 1], b_mark[np.cumsum(b_size) - 1] = 1, 2
        out[np.arange(len(a)) + (np.cumsum(b_size) - b_size)[a_group]] = a * 3 + a_mark
        out[np.arange(len(b)) + np.cumsum(a_size)[b_group]] = b * 3 + b_mark
        return T.buffers(self.text.take(pa.array(out)))[0].tobytes()


class Sweep:
    """The state machine over one document's events."""

    def __init__(self, both: tuple[Side, Side], groups: Groups) -> None:
        self.both, self.groups = both, groups
        self.open = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.begin = [0, 0]
        self.count, self.n_groups = [0, 0], 0
        self.sha, self.mark, self.links = hashlib.sha256(), b"", []

    def take(self, side: int, ids: np.ndarray) -> None:
        """Events of a side: its ids wait, from the byte where the first of them begins."""
        self.open[side] = np.concatenate([self.open[side], ids])
        self.count[side] += len(ids)

    def meet(self) -> None:
        """Closes all groups up to the last byte where tokens of both sides end."""
        ends = [self.begin[s] + np.cumsum(self.both[s].length[self.open[s]]) for s in (0, 1)]
        low = min(self.begin)
        hit = [self._ends_in(ends[s], ends[1 - s], low) for s in (0, 1)]
        at_a, at_b = np.flatnonzero(hit[0]), np.flatnonzero(hit[1])
        if not len(at_a):
            return
        a, b = self.open[0][: at_a[-1] + 1], self.open[1][: at_b[-1] + 1]
        # the number of closed groups before a token is the number of its group
        group = [(np.cumsum(h) - h)[: len(x)] for h, x in zip(hit, (a, b))]
        text = self.groups.of(a, group[0], b, group[1])
        self.sha.update(self.mark + text[:-1])
        self.mark = b";"
        self.links.append(a[at_a] << SHIFT | b[at_b])
        self.n_groups += len(at_a)
        self.begin = [int(ends[0][at_a[-1]])] * 2
        self.open = [self.open[0][len(a) :], self.open[1][len(b) :]]

    @staticmethod
    def _ends_in(own: np.ndarray, other: np.ndarray, low: int) -> np.ndarray:
        """For each end whether it is one of the other side's."""
        marks = np.zeros(int(max(own[-1:].max(initial=low), other[-1:].max(initial=low))) - low + 1, bool)
        marks[other - low] = True
        return marks[own - low]

    def pairs(self) -> bytes:
        """Distinct pairs since the last call and how often each was linked, packed."""
        pair, n = np.unique(np.concatenate(self.links or [np.zeros(0, np.int64)]), return_counts=True)
        self.links = []
        return pack(np.concatenate([np.diff(pair >> SHIFT, prepend=0), pair & (1 << SHIFT) - 1, n]))


def _unpaired(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and counts that Sweep.pairs() packed."""
    a, b, n = unpack(data).reshape(3, -1)
    return np.cumsum(a) << SHIFT | b, n


def _sweeps(a_path: str, b_path: str):
    """One row a document with its numbers, the last of its rows; before it pieces of its links where they are many."""

    def run(batches):
        both = sides(a_path, b_path)
        groups = Groups(max(len(s.length) for s in both))
        out, at, now = [], None, None

        def close(last: bool) -> None:
            said = (*now.count, now.n_groups, now.sha.hexdigest() if now.n_groups else "") if last else (None,) * 4
            out.append((*at, *said, now.pairs()))

        def written():
            cols = list(zip(*out))
            out.clear()
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

        for batch in batches:
            rows, docs, side = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i in range(batch.num_rows):
                if at is None or rows[i] != at[0]:
                    if at is not None:
                        close(True)
                    at, now = (rows[i], docs[i]), Sweep(both, groups)
                if side[i] < 0:
                    continue
                now.take(side[i], unpack(batch.column(4)[i].as_py()))
                if side[i] == 1:
                    now.meet()
                    if sum(map(len, now.links)) >= FLUSH:
                        close(False)
                if len(out) >= 256:
                    yield written()
        if at is not None:
            close(True)
        if out:
            yield written()

    return run


def _counted(batches):
    """Pairs and their links of a few batches, summed."""
    pairs, counts = [], []

    def summed():
        pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, back, np.concatenate(counts))
        return pair, n

    for batch in batches:
        for data in batch.column(0).to_pylist():
            pair, n = _unpaired(data)
            pairs.append(pair)
            counts.append(n)
        if sum(map(len, pairs)) >= FLUSH:
            pair, n = summed()
            pairs, counts = [pair], [n]
            if len(pair) >= FLUSH // 2:
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])
                pairs, counts = [], []
    if pairs:
        pair, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])


def _looked_up(table):
    """For each row the sum of its links' counts and the number of its best links, of the pairs in the broadcast slice."""

    def run(batches):
        pair, n, best = (np.frombuffer(x, kind) for x, kind in zip(table.value, (np.int64, np.int64, bool)))
        for batch in batches:
            total, good = [], []
            for data in batch.column(1).to_pylist():
                own, times = _unpaired(data)
                at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
                hit = pair[at] == own
                total.append(int((n[at] * times)[hit].sum()))
                good.append(int(times[hit & best[at]].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(good, pa.int64())], ["row", "count_sum", "n_best"])

    return run


def pair_counts(swept: DataFrame) -> tuple[DataFrame, int]:
    """pair (A id shifted, B id), n (links that hold it), best (n is the highest of its B id), and the number of pairs."""
    counts = swept.select("links").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = store(counts.withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1)), "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    counts, seen = store_counted(counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pair-counts", n=F.count(F.lit(1)))
    return counts, seen["n"]


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = A_PATH, b_path: str = B_PATH, stride: int = STRIDE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    lean(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    events = rows.mapInArrow(_end_events(a_path, b_path, stride), _EVENTS)
    swept = store(events.repartition("row").sortWithinPartitions("row", "at", "side").mapInArrow(_sweeps(a_path, b_path), _SWEPT), "swept")
    counts, n = pair_counts(swept)
    found, slices = None, max(1, -(-n // SLICE))
    for i in range(slices):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == i).toArrow().sort_by("pair")
        table = spark.sparkContext.broadcast(tuple(c.to_numpy().tobytes() for c in part.columns))
        own = swept.select("row", "links").mapInArrow(_looked_up(table), "row long, count_sum long, n_best long") if part.num_rows else None
        found = found.unionByName(own) if found is not None and own is not None else own or found
    if found is None:
        found = swept.select("row", F.lit(0).cast("long").alias("count_sum"), F.lit(0).cast("long").alias("n_best"))
    sums = found.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return swept.where("n_a is not null").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
