"""Suffix arrays, Merkle manifest and tokenizer alignment: brute force, edge rows, long texts, hot groups."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import align, merkle, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, level int, place long, tree long, part int"


def frame(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if n % 3 else None, (sources or ["s1", None, "s0", ""])[n % len(sources or "1234")], len(t) if t else None, 7, "x", 1, 2, 3, 4) for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed, alphabet="abcdefg é日 "):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


# Suffix arrays ------------------------------------------------------------------------------------------------------
def repeats(texts, window=400):
    count = Counter(b[i : i + window] for t in texts for b in [(t or "").encode()] for i in range(len(b) - window + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(b) > 0 and gone[0]))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def suffix_rows(spark, texts, ids=None):
    got = suffixes.remove_repeats(frame(spark, texts, ids)).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got)


def repeated_texts():
    p, q = prose(450, 1), prose(900, 2)
    texts = [None, "", "short", "a" * 399, "a" * 400, "a" * 401, "ab" * 3000, prose(5000, 3), prose(5000, 3), prose(60_000, 4) + p, p, p[:300], p[100:] + "x", "y" + q + "z", prose(700, 5) + q, q[:500] + "!" + q[400:]]
    return texts + [prose(300, 20 + i) + q[i * 20 : i * 20 + 420 + i] + prose(200, 90 + i) for i in range(20)]


def test_suffix_arrays_against_brute_force(spark):
    texts = repeated_texts()
    want = sorted((False, i, *w) for i, w in enumerate(repeats(texts)))
    assert suffix_rows(spark, texts) == want
    assert any(0 < w[3] < w[2] for w in want) and any(w[4] > 1 for w in want)


def test_suffix_arrays_merge_shards_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 3_000)
    texts = repeated_texts() + ["".join([prose(100, 200 + i), prose(430, 2), prose(100, 300 + i)]) for i in range(60)]
    assert suffix_rows(spark, texts) == sorted((False, i, *w) for i, w in enumerate(repeats(texts)))


def test_suffix_arrays_repeated_and_null_ids(spark):
    texts = [prose(800, 1), prose(800, 1), prose(500, 2), prose(500, 3) + prose(500, 2), "x" * 1000]
    ids = [5, 5, None, 5, None]
    assert suffix_rows(spark, texts, ids) == sorted((i is None, i or 0, *w) for i, w in zip(ids, repeats(texts)))
    assert suffixes.remove_repeats(frame(spark, [])).collect() == [] and suffix_rows(spark, [prose(900, 1)])[0][3] == 0


def test_suffix_array_and_prefixes_against_a_sort():
    r = random.Random(1)
    for trial in range(25):
        parts = [b"ab" * r.randrange(1, 30) if trial % 3 == 0 else bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(r.randrange(1, 10))]
        text, off = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts])
        ends = np.repeat(off[1:], np.diff(off))
        own = [bytes(text[i : ends[i]]) for i in range(len(text))]
        order = suffixes.suffix_array(text, ends)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: (own[i], i))
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(own[a], own[b])) if x != y), min(len(own[a]), len(own[b]))) for a, b in zip(order, order[1:])]
        for enough in (3, 10, 200):
            got = suffixes.common_prefixes(text, ends, order, enough).tolist()
            assert all(g == s if s < enough else g >= enough for g, s in zip(got, shared))


def test_suffix_arrays_memory_a_byte():
    """A shard of 1.5 MB takes less than 60 bytes a byte at once; two workers of an executor hold one each."""
    r = np.random.default_rng(5)
    text = r.integers(97, 123, 1_500_000).astype(np.uint8)
    text[900_000:1_400_000] = text[:500_000]
    ends = np.full(len(text), len(text))
    tracemalloc.start()
    again, first = suffixes.repeated_windows(text, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int(again.sum()) == 2 * (500_000 - suffixes.WINDOW + 1) and (first >= 0).sum() == len(text) - suffixes.WINDOW + 1
    assert peak < 60 * len(text)


def test_suffix_arrays_leave_no_memory_behind():
    start = np.arange(0, 200_001, 1000)
    own = np.arange(len(start) - 1)
    before = pa.total_allocated_bytes()
    for part in (0, 1):
        raw = np.frombuffer(pa.array([prose(200_000, 6, "abc").encode()], pa.large_binary()).buffers()[2], np.uint8)
        suffixes._shard(raw, start, own, own, np.zeros(len(own), np.int64), part, 4)
        del raw
    assert pa.total_allocated_bytes() - before < 100_000


def test_equal_windows_have_equal_keys():
    p = np.frombuffer(prose(900, 5).encode(), np.uint8)
    data = np.concatenate([np.frombuffer(b"x" * 500, np.uint8), p, np.frombuffer(b"yz" * 300, np.uint8), p])
    key, row, s, n, shared = suffixes.segments(data, np.array([0, 500 + len(p), len(data)]))
    at = {(r, a + i): k for k, r, a, m in zip(key, row, s, n) for i in range(m)}
    assert all(at[0, 500 + i] == at[1, 600 + i] for i in range(len(p) - suffixes.WINDOW + 1))
    known = {int(k) for k, x in zip(key, shared) if x}
    assert all(int(at[0, 500 + i]) in known for i in range(len(p) - suffixes.WINDOW + 1))


# Merkle manifest ----------------------------------------------------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return out


def manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = []
    for doc_id, text, lang, source, n in rows:
        head = "".join(field(v) for v in (doc_id, source, lang, n))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None
        own.append((source, doc_id, sha(head + field(text)), sha(head + field(text.translate(lower) if bad else text))))
    out, sources = [], sorted({o[0] for o in own}, key=lambda s: (s is not None, (s or "").encode()))
    per = [sorted((o for o in own if o[0] == s), key=lambda o: (o[1] is not None, o[1] or 0, o[2])) for s in sources]
    trees = [tree([o[2] for o in leaves]) for leaves in per]
    top = tree([t[-1][0] for t in trees])
    for s, (leaves, levels) in enumerate(zip(per, trees)):
        for i, (_, doc_id, leaf, tampered) in enumerate(leaves):
            steps, now = path(levels, i) + path(top, s), tampered
            for pre, post in steps:
                now = sha(pre + now + post)
            out.append((doc_id, leaf, levels[-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), now, now == top[-1][0]))
    return sorted(out, key=str)


def merkle_rows(df):
    return sorted(map(tuple, merkle.manifest(df).collect()), key=str)


@pytest.mark.parametrize("limit", [200_000, 3])
def test_merkle_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(merkle, "PART_ROWS", 60)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    texts = [None if i % 50 == 0 else "" if i % 50 == 1 else f"Text {i % 40} É" * (1 + i % 3) for i in range(700)] + ["X" * 300_000]
    ids = [None if i % 97 == 0 else i // 2 if i % 10 == 0 else i for i in range(len(texts))]
    df = frame(spark, texts, ids, ["hot"] * 30 + [None, "", "é", "Z", "a", "lone"])
    got = merkle_rows(df)
    assert got == manifest([tuple(r)[:5] for r in df.collect()])
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_merkle_small_tables(spark):
    for texts, sources in ((["a"], ["s"]), (["A", "B"], ["s", "t"]), (["A"] * 17, ["s"]), (["a"] * 16 + [None], [None])):
        df = frame(spark, texts, sources=sources)
        assert merkle_rows(df) == manifest([tuple(r)[:5] for r in df.collect()])
    assert merkle_rows(frame(spark, [])) == []


def test_merkle_sql(spark):
    df = frame(spark, [f"T{i}" if i % 7 else None for i in range(300)], sources=["hot"] * 8 + [None, "x"])
    documents = df.toPandas()[["doc_id", "text", "lang", "source", "n_chars"]].astype({"n_chars": "Int64"})
    c = duckdb.connect()
    c.register("documents", documents)
    assert sorted(c.sql(merkle.SQL).fetchall(), key=str) == merkle_rows(df)


def test_merkle_is_native(spark):
    plan = merkle.manifest(frame(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Tokenizer alignment ------------------------------------------------------------------------------------------------
def aligned(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_own, b_own = Tokenizer.from_file(align.A_PATH), sentencepiece.SentencePieceProcessor(model_file=align.B_PATH)
    a_own.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    a_bytes = lambda i: bytes(back[c] for c in a_own.id_to_token(i))

    def b_bytes(i):
        piece = b_own.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    per, counts = [], Counter()
    for t in texts:
        groups, links, a, b = [], [], [], []
        if t:
            a, b = a_own.encode(" " + t, add_special_tokens=False).ids, b_own.encode(t)
            if not b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == (" " + t).encode():
                a, b = [], []
        a_end, b_end = np.cumsum([len(a_bytes(i)) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()
        i = j = 0
        for end in sorted(set(a_end) & set(b_end)):
            x, y = a_end.index(end) + 1, b_end.index(end) + 1
            groups.append((a[i:x], b[j:y]))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        counts.update(links)
        per.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    text = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return [(na, nb, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), sha(text(g)) if g else "") for na, nb, g, k in per]


EDGE = [
    None, "", " ", "  two  spaces  ", "a", "The quick brown fox.", "The quick brown fox.", "naïve café — ½ ☃ 日本語 \U0001f600", "<|endoftext|> <s></s> <unk>", "has the mark ▁ inside", "tab\tnew\nline\r\n", "\x00\x01 control",
    "ﬁ ligature Å", "é vs é", "a" * 3000, " " * 500 + "x", "12345678901234567890", "don't we'll I'M",
]


def align_rows(df, **more):
    return sorted(tuple(r) for r in align.align(df, **more).collect())


@pytest.mark.parametrize("stride", [align.STRIDE, 7])
def test_alignment_against_brute_force(spark, stride):
    texts = EDGE + [prose(4000, 8, "abcdefgh étn .,\n")]
    got = align_rows(frame(spark, texts), stride=stride)
    assert got == [(i, *w) for i, w in enumerate(aligned(texts))]
    assert got[9][1:] == (0, 0, 0, 0, 0, 0, "") and got[5][1] > 0


def test_alignment_in_slices_and_pieces(spark, monkeypatch):
    texts = [prose(900, i, "abcdefgh étn .,\n") for i in range(6)]
    want = [(i, *w) for i, w in enumerate(aligned(texts))]
    monkeypatch.setattr(align, "SLICE", 10)
    assert align_rows(frame(spark, texts)) == want
    monkeypatch.setattr(align, "FLUSH", 1)
    assert align_rows(frame(spark, texts[:2]), stride=50) == [(i, *w) for i, w in enumerate(aligned(texts[:2]))]


def test_alignment_repeated_null_ids_and_empty(spark):
    texts, ids = ["same text", "same text", "other", None], [3, 3, None, None]
    got = sorted(tuple(r) for r in align.align(frame(spark, texts, ids)).select(*[c for c in align.align(frame(spark, [])).columns if c != "doc_id"]).collect())
    assert got == sorted(aligned(texts))
    assert align.align(frame(spark, [])).collect() == [] and align_rows(frame(spark, [None, ""])) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_fast_ids_are_the_files_own():
    """Every character beside letters, digits, marks and spaces: the word patterns of both libraries class it alike."""
    from tokenizers import Tokenizer

    own, fast = Tokenizer.from_file(align.A_PATH), align.ByteLevel(align.A_PATH)
    own.encode_special_tokens = True
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b 1{c}2 {c}{c} .{c}!" for c in chars[i : i + 500]) for i in range(0, len(chars), 500)]
    for t, e in zip(texts, own.encode_batch([" " + t for t in texts], add_special_tokens=False)):
        assert fast.encode(t).tolist() == e.ids
