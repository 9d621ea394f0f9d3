"""Small tests of the training-data operators: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns,
and agreement with brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import decontaminate, embeddings, extract, language, minhash, mixing, quality, sharding, substring, warc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, rep int"


def words(n, seed, alphabet=400):
    r = random.Random(seed)
    return [f"w{r.randrange(alphabet)}é" for _ in range(n)]


def make_docs():
    base, passage = words(90, 1), words(30, 2)
    texts = [" ".join(base), " ".join(base), " ".join(base[:-2] + ["x", "y"]), None, "", " \n\t ", "one", "ONE", "a b c d", "The Quick\tbrown\x0bfox"]
    texts += [" ".join(words(40, 10 + i) + passage + words(20, 50 + i)) for i in range(6)]
    texts += [" ".join(words(9000, 99, 5000)), "héllo wörld ünï " * 5]
    texts += [" ".join(base[:i] + [f"z{i}"] + base[i + 1 :]) for i in range(0, 60, 3)]
    sources = ["s1", "s1", None, "s2", "", "s1"]
    return [(i, t, "en" if i % 5 else None, sources[i % 6], 1, 7, "x", 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_mixing(spark, docs, none):
    got = rows(mixing.mix(docs))
    text = {d[0]: d[1] for d in make_docs()}
    assert all(r["size"] == len(SPACE.findall(text[r["doc_id"]] or "")) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in got)
    left, open_ = 1.5 * total, dict(zip(sorted(by, key=lambda s: (s is None, s or "")), [5, 2, 1, 5, 2, 1]))
    target = {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w > 2 * by[s][0]["source_size"]]
        for s in full or list(open_):
            target[s] = 2 * by[s][0]["source_size"] if full else level * open_[s]
            left -= target[s]
            del open_[s]
    for s, own in by.items():
        assert own[0]["target"] == pytest.approx(target[s])
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"])
    assert sorted(map(str, rows(mixing.mix(docs)))) == sorted(map(str, got))
    assert rows(mixing.mix(none)) == []


def runs_of(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def test_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(60):
        sizes = [r.randrange(1, 60) for _ in range(r.randrange(0, 60))]
        pieces, count = sharding.best_fit_decreasing(runs_of(sizes), 60)
        naive: list[int] = []
        want = []
        for size in sorted(sizes, reverse=True):
            fit = [b for b, left in enumerate(naive) if left >= size]
            if not fit:
                naive.append(60)
                fit = [len(naive) - 1]
            b = min(fit, key=lambda b: (naive[b], b))
            naive[b] -= size
            want.append(b)
        assert [b for _, b, n in pieces for _ in range(n)] == want and count == len(naive)
        packed = sharding.pack(runs_of(sizes), 5)
        assert sum(n for _, _, n in packed) == len(sizes) and all(0 <= b < 5 for _, b, _ in packed)


def test_remaining_tree_is_balanced():
    tree = sharding.RemainingTree()
    for i in range(1000):
        tree.insert((i, i))
    assert tree.root[3] <= 14
    assert [tree.take_tightest(500) for _ in range(3)] == [(500, 500), (501, 501), (502, 502)] and tree.take_tightest(5000) is None


def test_sharding_repeats_and_nulls(spark):
    data = [(None, "a"), (None, "a"), (1, None), (1, None), (1, ""), (2, "b" * 5000)] + [(i, f"t{i % 50}") for i in range(300)]
    got = rows(sharding.shard(spark.createDataFrame([(*d, 1, "x") for d in data], "doc_id long, text string, shard int, cell string"), shards=3))
    assert len(got) == len(data)
    by = defaultdict(set)
    for r in got:
        by[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding(spark, docs, none):
    got = rows(sharding.shard(docs, shards=4))
    data = make_docs()
    text = {d[0]: d[1] or "" for d in data}
    assert len(got) == len(data)
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(4)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rows(sharding.shard(none)) == []
    many = spark.createDataFrame([(i, "same text " * 20) for i in range(400)] + [(1000 + i, f"text {i}") for i in range(400)], "doc_id long, text string")
    load = Counter()
    for r in rows(sharding.shard(many, shards=4)):
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values())


def test_sharding_keeps_groups_of_up_to_an_even_shard(spark):
    data = [(i, "same text " * 20) for i in range(75)] + [(1000 + i, f"{i:03} other " * 22 + "x") for i in range(325)]
    by, load = defaultdict(set), Counter()
    for row in rows(sharding.shard(spark.createDataFrame(data, "doc_id long, text string"), shards=4)):
        by[row["doc_id"] < 1000].add(row["shard"])
        load[row["shard"]] += row["size"]
    assert len(by[True]) == 1
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values())


def brute_components(data, percent=85):
    sets = {}
    for i, t, *_ in data:
        w = SPACE.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_minhash(docs, none):
    got = {r["doc_id"]: r for r in rows(minhash.near_duplicates(docs))}
    for i, (n, c) in brute_components(make_docs()).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c)
    assert rows(minhash.near_duplicates(none)) == []


def test_minhash_blocks(spark, monkeypatch):
    """A group larger than a block loses no link."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 6)
    base = words(120, 5)
    data = []
    for i in range(60):
        w = list(base)
        for j in range(i % 7):
            w[(i * 13 + j * 17) % 120] = f"q{i}-{j}"
        data.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))}
    assert got == {i: c for i, (_, c) in brute_components(data).items()}


def test_setsketch_merges_and_estimates():
    r = np.random.default_rng(1)
    v = r.integers(1, 1 << 62, 4000, dtype=np.int64).astype(np.uint64)
    sk = lambda x: minhash.sketch(np.sort(x), np.array([0, len(x)]))[0]
    a, b = v[:3000], v[1000:]
    assert (minhash.merge(sk(a), sk(b)) == sk(v)).all()
    n = np.array([3000.0, 3000.0])
    half, same = minhash.similarities(np.stack([sk(a), sk(a)]), np.stack([sk(b), sk(a)]), n, n)
    assert abs(half - 0.5) < 0.12 and same > 0.95


def test_minhash_repeated_ids_and_thresholds(spark):
    base = words(100, 8)
    near = lambda i, k: " ".join(base[:i] + [f"n{i}-{j}" for j in range(k)] + base[i + k :])
    data = [(1, " ".join(base)), (1, near(20, 1)), (2, near(50, 2)), (3, near(70, 8)), (None, " ".join(base)), (5, "one two"), (6, "ONE  two"), (7, "one two three")]
    got = rows(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    assert len(got) == len(data)
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by[(1, 96)] == 1 and by[(2, 96)] == 1 and by[(3, 96)] == 3 and by[(None, 96)] is None
    assert by[(5, 1)] == by[(6, 1)] == 5 and by[(7, 1)] == 7
    looser = {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(spark.createDataFrame(data[2:4] + data[:1], "doc_id long, text string"), threshold=(70, 100), band_rows=4))}
    assert looser == {1: 1, 2: 1, 3: 1}


def test_minhash_loses_no_link_of_a_wide_group(spark, monkeypatch):
    """Members outside the main set meet all cells within their reach."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 5)
    monkeypatch.setattr(minhash, "VISITORS", 3)
    r = random.Random(11)
    base, data = words(90, 21, 5000), []
    for i in range(90):
        w = list(base)
        for j in r.sample(range(90), r.choice([0, 1, 2, 3])):
            w[j] = f"v{r.randrange(40)}"
        data.append((i, " ".join(w)))
    for t in ((85, 100), (80, 100)):
        monkeypatch.setattr(minhash, "THRESHOLD", t)
        got = {x["doc_id"]: x["component_id"] for x in rows(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), threshold=t, band_rows=6))}
        assert got == {i: c for i, (_, c) in brute_components(data, t[0]).items()}


def test_word_hashes_have_no_linear_collisions():
    """Thue-Morse words collide under any polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    texts = [a[:64], b[:64], a, b, a[:90], b[:90]]
    import pyarrow as pa

    raw, offsets = minhash.T.buffers(pa.array(texts))
    w = minhash.T.Words(raw, offsets, minhash.T.NON_SPACE, minhash.T.LOWER)
    assert len(set(w.hashes().tolist())) == len(texts) and len(set(w.numbers().tolist())) == len(texts)
    spaced = [" ".join(a), " ".join(b)]
    assert len({minhash.T.digest(x.encode()) for x in spaced}) == 2


def test_components_with_hubs(spark, monkeypatch):
    from ledgerloom.llm import _spark

    monkeypatch.setattr(_spark, "HUB", 4)
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(500, 540)] + [(900, i) for i in range(600, 640)] + [(None, 3), (7, 7)]
    root = {i: i for i in range(1000)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in rows(_spark.components(spark.createDataFrame(edges, "a long, b long"), "t"))}
    assert got == {x: find(x) for a, b in edges if a is not None and a != b for x in (a, b)}


def test_decontamination(spark, docs, none, monkeypatch):
    data = make_docs()
    passage = words(30, 2)
    items = [(0, " ".join(passage)), (1, "ONE"), (2, None), (3, "a-b"), (10, " ".join(passage[:14])), (11, " ".join(passage)), (12, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(str(i))

    def expected(t):
        w = ALNUM.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for x, own in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    found |= own
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)

    for block in (2_000_000, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = {r["doc_id"]: r for r in rows(decontaminate.contamination(docs, bench))}
        for d in data:
            r = got[d[0]]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == expected(d[1])
    assert rows(decontaminate.contamination(none, bench)) == []
    assert all(r["n_hit"] == 0 for r in rows(decontaminate.contamination(docs, bench.limit(0))))


def test_substring(docs, none):
    data = make_docs()
    split = {d[0]: SPACE.findall(d[1] or "") for d in data}
    first = {}
    for i, w in split.items():
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for r in rows(substring.remove_repeats(docs)):
        w = split[r["doc_id"]]
        keep = [True] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < r["doc_id"]:
                keep[j : j + 13] = [False] * 13
        text = " ".join(x for x, k in zip(w, keep) if k)
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(w) - sum(keep), text)
        assert r["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert rows(substring.remove_repeats(none)) == []


def test_substring_heavy_prefixes(spark, monkeypatch):
    """Prefixes above a group's size take two levels and give the same result; null and repeated ids."""
    monkeypatch.setattr(substring, "GROUP_WORDS", 60)
    passage = words(16, 3)
    data = [(i, " ".join(words(6, 100 + i, 9000) + passage + words(6, 200 + i, 9000))) for i in range(40)]
    data += [(None, " ".join(passage)), (50, " ".join(passage)), (50, " ".join(passage)), (51, "w1é " * 60), (52, "w1é " * 40)]
    split = [(d[0], SPACE.findall(d[1])) for d in data]
    first = {}
    for i, w in split:
        for j in range(len(w) - 12):
            if i is not None:
                k = tuple(w[j : j + 13])
                first[k] = min(i, first.get(k, i))
    want = Counter()
    for i, w in split:
        keep = [True] * len(w)
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                keep[j : j + 13] = [False] * 13
        want[(i, " ".join(x for x, k in zip(w, keep) if k))] += 1
    got = Counter((r["doc_id"], r["kept_text"]) for r in rows(substring.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"))))
    assert got == want


def test_suffix_array_of_segments():
    r = random.Random(9)
    segments = [[r.randrange(3) for _ in range(r.randrange(1, 30))] for _ in range(12)]
    flat = np.array([x for s in segments for x in s])
    ends = np.repeat(np.cumsum([len(s) for s in segments]), [len(s) for s in segments])
    order, shared = substring.suffix_array(flat, ends)
    suffix = lambda i: tuple(flat[i : ends[i]].tolist())
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(len(flat)))
    for k in range(1, len(order)):
        a, b = suffix(order[k]), suffix(order[k - 1])
        n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
        assert shared[k] == n


def test_prefix_keys_agree_on_equal_windows():
    h = np.random.default_rng(2).integers(1, 1 << 62, 200, dtype=np.int64).astype(np.uint64)
    both = np.concatenate([h[:40], h[50:120], h[:40]])
    keys = substring.prefix_keys(both)
    assert (keys[:28] == keys[110 : 110 + 28]).all()


def test_language(spark, none):
    r = random.Random(4)
    stems = {"en": ["the", "and", "ing", "tion", "whe"], "fr": ["le", "éau", "oux", "ment", "que"], "de": ["sch", "ung", "ein", "keit", "über"]}
    data = [(i, " ".join("".join(r.choice(s) for _ in range(2)) for _ in range(60)), k) for i, (k, s) in enumerate([x for _ in range(40) for x in stems.items()])]
    data += [(900, None, "en"), (901, "", None), (902, "123 !?", "fr"), (903, "éaumentque " * 5000, None), (900, None, "en")]
    got = rows(language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")))
    assert len(got) == len(data)
    want = {d[0]: d[2] for d in data}
    for g in got:
        assert 0 <= g["score"] <= 1 and g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1)
        if g["doc_id"] < 900:
            assert g["lang_pred"] == want[g["doc_id"]]
        elif g["doc_id"] < 903:
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
        else:
            assert g["lang_pred"] == "fr"
    assert rows(language.identify(none.select("doc_id", "text", "lang"))) == []


def test_kneser_ney_against_dictionaries(spark):
    """Every probability equals that of a naive implementation, for grams seen and unseen and letters beyond 16 bits."""
    texts = {"en": ["the cat and the hat sat on the mat", "a bat"], "fr": ["le chat é sur \U00020071 le tapis", "la  la la!"]}
    chars = lambda t: re.sub(r"[^\w]+", " ", t.lower() + " ")
    tables = {}
    for lang, own in texts.items():
        four = Counter(("   " + chars(t))[i : i + 4] for t in own for i in range(len(chars(t))))
        tables[lang] = {4: four}
        for k in (3, 2, 1):
            tables[lang][k] = Counter(g[1:] for g in tables[lang][k + 1])
    alphabet = len({g for t in tables.values() for g in t[1]}) + 1

    def probability(table, k, gram):
        if not k:
            return 1 / alphabet
        counts = table[k]
        d = language.discount(sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values()))
        context = [v for g, v in counts.items() if g[:-1] == gram[:-1]]
        low = probability(table, k - 1, gram[1:])
        return max(counts.get(gram, 0) - d, 0) / sum(context) + d * len(context) / sum(context) * low if context else low

    df = spark.createDataFrame([(k, t) for k, own in texts.items() for t in own], "lang string, text string")
    counts = df.mapInArrow(language._count, "lang string, context long, ch int, n long").groupBy("lang", "context", "ch").sum("n").withColumnRenamed("sum(n)", "n")
    model = language.KneserNey(language.stored_tables(counts))
    r = random.Random(1)
    letters = sorted({g for t in tables.values() for g in t[1]}) + ["z"]
    for _ in range(400):
        gram = r.choice(list(tables[r.choice(["en", "fr"])][4])) if r.random() < 0.6 else "".join(r.choice(letters) for _ in range(4))
        gram = gram[:3] + r.choice(letters) if r.random() < 0.3 else gram
        context = sum(ord(c) << (21 * (2 - i)) for i, c in enumerate(gram[:3]))
        got = model.evaluate(4, np.array([context]), np.array([ord(gram[3])]))[0]
        for i, lang in enumerate(model.langs):
            assert got[i] == pytest.approx(math.log(probability(tables[lang], 4, gram)), abs=1e-4)


@pytest.mark.parametrize("most", [0, 3, 40])
def test_language_beyond_what_is_stored(spark, monkeypatch, most):
    """Answers do not depend on how many grams travel to the tasks, in languages of many grams or of equally rare ones."""
    r = random.Random(8)
    stems = {"en": ["the", "and", "ing", "tion", "whe"], "fr": ["le", "éau", "oux", "ment", "que"], "zz": [chr(0x4E00 + i) for i in range(900)]}
    data = [(i, " ".join("".join(r.choice(stems[k]) for _ in range(2)) for _ in range(40)), k) for i, k in enumerate(["en", "fr", "zz"] * 50)]
    data += [(500, None, "en"), (501, "", "fr"), (502, "12 !", None), (None, data[0][1], None), (503, "ωмега " * 50 + "the thing", None), (0, data[0][1], "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    order = lambda g: (g["doc_id"] is None, g["doc_id"] or 0)
    want = sorted(rows(language.identify(docs)), key=order)
    monkeypatch.setattr(language, "MAX_GRAMS", most)
    monkeypatch.setattr(language, "RARE", 8)
    got = sorted(rows(language.identify(docs)), key=order)
    assert len(got) == len(data)
    for g, w in zip(got, want, strict=True):
        assert all(g[c] == w[c] for c in ("doc_id", "held_out", "lang_pred", "rejected"))
        assert g["entropy"] == pytest.approx(w["entropy"], abs=1e-5) and g["score"] == pytest.approx(w["score"], abs=1e-3)


def test_language_holds_out(spark):
    """Held-out accuracy and the rejection on texts that the counts have not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs.withColumn("score", docs.doc_id)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.rejected.mean() < 0.1


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav><header>Site</header>
<div class="ad">Buy now</div><article><h1>Big  Title</h1><p>First &amp; <b>bold</b> text.<p>Second<br>third<aside>side</aside>
<div class="comments"><p>nice</p></div><form><input></form></article><footer>&copy; me</footer></body></html>"""


def test_extract(spark):
    plain = "<body><div>menu one two three four five six seven</div><p>Unique {0} words here for page {0}</p></body>"
    data = [(0, "http://a/1", PAGE, 1), (1, None, None, 1), (2, "http://a/2", "", 1)] + [(10 + i, f"http://b/{i}", plain.format(i), 1) for i in range(6)] + [(20, "http://c/", "a < b &amp; c<p>x", 1), (0, "http://a/1", PAGE, 1)]
    got = rows(extract.main_text(spark.createDataFrame(data, "page_id long, url string, html string, text int")))
    assert len(got) == len(data)
    by = {r["page_id"]: r for r in got}
    assert by[0]["text"] == "Big Title\nFirst & bold text.\nSecond\nthird"
    assert by[1]["text"] == "" and by[2]["n_chars"] == 0
    assert by[12]["text"] == "Unique 2 words here for page 2"
    assert by[20]["text"] == "a < b & c\nx"
    assert rows(extract.main_text(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def test_extract_loose_text_beside_articles(spark):
    """The suffix array decides unmarked loose text of pages with an article too, and what stays is in page order."""
    page = "<body><div>Site</div><div>go one two three four five six</div><h1>Head {0}</h1><article><p>Body {0}</p></article><p>After {0}</p></body>"
    data = [(i, f"http://a/{i}", page.format(i)) for i in range(6)]
    data += [(6, "http://b/", "<body><p>First</p><main>x<p>y</main><div>z</div></body>"), (7, "http://b/2", "<article>only</article>")]
    by = {r["page_id"]: r["text"] for r in rows(extract.main_text(spark.createDataFrame(data, "page_id long, url string, html string")))}
    assert [by[i] for i in range(6)] == [f"Head {i}\nBody {i}\nAfter {i}" for i in range(6)]
    assert by[6] == "First\nx\ny\nz" and by[7] == "only"


def test_extract_markup():
    text = lambda html: extract._texts(extract.Pages([html]), np.zeros(len(extract.Pages([html]).at), np.int64), [{}])[0]
    assert text('<article><p>a <svg viewBox="0"/> b</p><p>c</p></article>') == "a b\nc"
    assert text("<article><p>x<svg><g>t</g><p>y</article>") == "x\ny"
    assert text('<article><p class="share-price">1</p><div id="search-results">2</div><p class="related-work">3</p><div class="share-buttons">no</div></article>') == "1\n2\n3"
    assert text("<form><main><p>Story</main><input></form>") == text("<div class='content-widget'><article><p>Story</article></div>") == "Story"
    assert text("<form><div role=main><p>a</div>b</form>") == text("<div class='sidebar-page'><main>a<form>b</form></main>c</div>") == "a"
    assert text("<article>a</article><div class='comments'><article>no</article></div><aside class='related'><article>no</article></aside><div class=widget>no</div>") == "a"
    assert text("</div></p>" * 3000 + "<p>a" + "<div>" * 3000 + "b") == "a\nb"
    assert len(text("<p>" + "word " * 200_000)) == 999_999


def test_extract_weak_marks_and_notices(spark):
    """A class that only hints at a widget goes where its text repeats; a block on most of a host's articles is a notice; copied articles stay."""
    page = '<article><h1>T{0}</h1><div class="share-price">price of the share is {1}</div><p>{2}</p><p>This site uses notices on all pages today</p><p>own text {0} with a good many words of its own that make it an article</p></article>'
    data = [(i, f"http://a/{i}", page.format(i, i, "x" * (i + 1))) for i in range(8)]
    data += [(20 + i, f"http://b/{i}", f"<article><p>the same long copied article text</p></article><footer>{i}</footer>") for i in range(8)]
    data += [(40 + i, f"http://c/{i}", f"<div class='search-help'>use the box above to search all of it</div><p>only {i}</p>") for i in range(4)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    by = {r["page_id"]: r["text"] for r in rows(extract.main_text(df))}
    assert by[3] == "T3\nprice of the share is 3\nxxxx\nown text 3 with a good many words of its own that make it an article"
    assert by[22] == "the same long copied article text" and by[41] == "only 1"
    for n in (1, 7):
        assert {r["page_id"]: r["text"] for r in rows(extract.main_text(df.repartition(n)))} == by


def test_extract_counts_over_the_whole_host(spark, monkeypatch):
    """Repeats of a large host in many groups, against brute force; copies of a page count once."""
    monkeypatch.setattr(extract, "GROUP_PAGES", 8)
    r = random.Random(3)
    side = [" ".join(f"s{k}w{j}" for j in range(8)) for k in range(6)]
    data = []
    for i in range(120):
        extra = [side[k] for k in range(6) if r.random() < (0.5, 0.2, 0.04, 0.02, 0.01, 0.3)[k]]
        data.append((i, f"http://h/{i}", "".join(f"<div>{x}</div>" for x in extra) + f"<p>own words of page {i} " + " ".join(f"p{i}q{j}" for j in range(5))))
    data += [(500 + i, f"http://h/c{i}", "<p>copied page with enough words to repeat often</p>") for i in range(5)]
    n = 121
    need = max(2, min(3, n), math.ceil(0.01 * n))
    on = Counter(x for _, _, h in data[:120] for x in side if x in h)
    got = {x["page_id"]: x["text"] for x in rows(extract.main_text(spark.createDataFrame(data, "page_id long, url string, html string")))}
    for i, _, h in data[:120]:
        want = [x for x in side if x in h and on[x] < need] + [f"own words of page {i} " + " ".join(f"p{i}q{j}" for j in range(5))]
        assert sorted(got[i].split("\n")) == sorted(want)
    assert all(got[500 + i] == "copied page with enough words to repeat often" for i in range(5))
    monkeypatch.setattr(extract, "NAMES", 0)
    assert {x["page_id"]: x["text"] for x in rows(extract.main_text(spark.createDataFrame(data, "page_id long, url string, html string")))} == got


def test_extract_suffix_array():
    r = np.random.default_rng(5)
    x = np.unique(r.integers(1, 3, (60, extract.DEPTH)).astype(np.uint64), axis=0)
    order, shared = extract.suffix_array(x)
    assert [tuple(x[i]) for i in order] == sorted(map(tuple, x))
    for k in range(1, len(x)):
        a, b = x[order[k]], x[order[k - 1]]
        assert shared[k] == next((j for j in range(len(a)) if a[j] != b[j]), len(a))


def test_warc(spark, tmp_path):
    body = "x" * 150
    data = [(3, "u3", body, 9), (1, "u1", body, 9), (2, None, "short", 9), (4, "u4", None, 9), (5, "u5", "short", 9), (None, "u", body, 9), (6, "u\n6", "é" * 99, 9), (1, "u1", body, 9)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, digest int")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(df, folder, file_bytes=300)
    got = rows(warc.read(manifest, folder))
    assert len(got) == len(data)
    assert sum(r["records"] for r in manifest.collect()) == len(data)
    import zlib

    ids, infos = [], 0
    for p in (tmp_path / "w").iterdir():
        if p.suffix == ".gz":
            text = b""
            rest = p.read_bytes()
            while rest:
                d = zlib.decompressobj(31)
                text += d.decompress(rest)
                rest = d.unused_data
            ids += re.findall(rb"WARC-Record-ID: (\S+)", text)
            infos += text.count(b"WARC-Type: warcinfo")
    assert len(ids) == len(set(ids)) == len(data) + infos and infos == manifest.count()
    for r in got:
        payload = next((d[2] or "") for d in data if d[0] == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if r["page_id"] == 3 else ("response", None))
    first = {p.name: p.read_bytes() for p in (tmp_path / "w").iterdir()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    warc.write(df.repartition(5), f"file://{tmp_path}/v", file_bytes=300)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {p.name: p.read_bytes() for p in (tmp_path / "v").iterdir()} == first
    empty = df.limit(0)
    assert rows(warc.read(warc.write(empty, f"file://{tmp_path}/e"), f"file://{tmp_path}/e")) == []


def test_warc_hashed_ids_and_a_frequent_payload(spark, tmp_path, monkeypatch):
    """Ids over all of 64 bits, one payload on a third of the rows, texts of a megabyte; small cells, hubs and shards."""
    from ledgerloom.llm import _spark

    monkeypatch.setattr(warc, "HUB", 20)
    monkeypatch.setattr(_spark, "HUB", 20)
    monkeypatch.setattr(warc, "CELL_ROWS", 10)
    monkeypatch.setattr(warc, "SHARD_BYTES", 20_000)
    r = random.Random(7)
    ids = sorted({r.randrange(-(1 << 63), 1 << 63) for _ in range(400)} | {-(1 << 63), (1 << 63) - 1, 0, -1, 5})
    data = [(i, f"u{i}", "frequent " * 30 if n % 3 == 0 else f"page {n % 90} " * 20 if n % 3 == 1 else f"own {n}") for n, i in enumerate(ids)] + [(7, "long", "é" * 600_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(df, folder)
    got = {x["page_id"]: (x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in rows(warc.read(manifest, folder))}
    first = {}
    for i, _, html in sorted(data):
        first.setdefault(html, i)
    want = {}
    for i, _, html in data:
        again = len(html.encode()) >= 100 and first[html] != i
        want[i] = (len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "revisit" if again else "response", first[html] if again else None)
    assert got == want and manifest.select("shard").distinct().count() > 3


def test_warc_rejects_damage():
    data = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), "response", None)
    assert warc.parse(data)["payload_bytes"] == 7
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"paylaod"))


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 40)
    monkeypatch.setattr(embeddings, "PART", 16)
    r = np.random.default_rng(6)
    centres = r.standard_normal((60, 16))
    x = [c + 0.01 * r.standard_normal(16) for c in centres for _ in range(5)]
    data = [(i, [float(f) for f in v], int(i % 2 == 0)) for i, v in enumerate(x)]
    data += [(1000 + i, data[0][1], data[0][2]) for i in range(4)]
    data += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None] * 8, 1), (2004, data[0][1], None), (2005, [1.0], 1), (2006, [], 1)]
    got = {r["vec_id"]: r for r in rows(embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")))}
    assert len(got) == len(data)
    good = [d for d in data if d[0] < 2000]
    m = np.array([d[1] for d in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.98) & (np.array([d[2] for d in good])[:, None] == np.array([d[2] for d in good]))
    np.fill_diagonal(near, False)
    found = np.array([got[d[0]]["n_links"] for d in good])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(2000, 2007))
    assert got[1003]["component_id"] == 0
    assert rows(embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int"))) == []


def cosine_links(x, labels=None):
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = m @ m.T >= 0.98
    np.fill_diagonal(near, False)
    return near if labels is None else near & (labels[:, None] == labels[None, :])


def test_embeddings_recall_of_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 60)
    r = np.random.default_rng(16)
    centres = r.standard_normal((700, 32))
    x = np.array([c + 0.05 * r.standard_normal(32) for c in centres for _ in range(4)])
    df = spark.createDataFrame([(i, v.tolist(), 1, "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, cell string")
    got = np.array([n for _, n in sorted((g["vec_id"], g["n_links"]) for g in rows(embeddings.near_duplicates(df)))])
    want = cosine_links(x).sum(1)
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() and np.ceil(np.log2(2800 / 60)) >= 4


def test_embeddings_tight_cluster_costs_few_copies(spark, monkeypatch):
    """A third of the vectors within a hair of each other: balls, exact counts, and few copies in the forest."""
    r = np.random.default_rng(7)
    c = r.standard_normal(24)
    tight = c / np.linalg.norm(c) + 0.001 * r.standard_normal((900, 24))
    loose = r.standard_normal((1800, 24))
    x = np.concatenate([tight, loose])
    monkeypatch.setattr(embeddings, "LEAF", 100)
    placed = []
    real = embeddings.place
    monkeypatch.setattr(embeddings, "place", lambda found: placed.append(real(found)) or placed[-1])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {g["vec_id"]: g for g in rows(embeddings.near_duplicates(df))}
    want = cosine_links(x).sum(1)
    assert all(got[i]["n_links"] == want[i] and got[i]["component_id"] == 0 for i in range(900))
    leaves = [len(p["leaves"]) for p in rows(placed[0])]
    assert len(leaves) < 2000 and sum(leaves) < 4 * embeddings.TREES * len(leaves)


def test_embeddings_single_and_repeated_ids(spark):
    data = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.01], "a"), (3, [0.01, 1.0], "a"), (4, [1.0, 0.0], "b"), (None, [1.0, 0.0], "a"), (5, [1.0, 0.0], None)]
    got = rows(embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")))
    by = Counter((g["vec_id"], g["n_links"], g["component_id"]) for g in got)
    assert by == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (None, 0, None), (5, 0, 5)])


@pytest.mark.parametrize("deal", [[5], []])
def test_quality_held_out(spark, deal):
    """Labels outside the sample, at sf0.1: precision and recall of toxic and of low-quality rows. The second deal has classes that style separates nearly."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", *map(F.lit, deal)), F.lit(2)) == 0
    out = quality.judged(docs, labels.where(half), ["doc_id"]).select("row.doc_id", "rejected").join(labels.where(~half), "doc_id").toPandas()
    toxic, bad = out.toxic == 1, out.quality == 0
    assert (toxic & out.rejected).sum() >= 0.8 * toxic.sum() and (bad & out.rejected).sum() >= 0.95 * bad.sum()
    assert (~toxic & ~bad & out.rejected).sum() <= 0.01 * (~toxic & ~bad).sum()


def brute_posteriors(found):
    """From rows (host, path, e): the mean, both strengths and, for any row, the posteriors of its host and path without that row."""
    known = [x for x in found if x[2] is not None]
    mean = sum(x[2] for x in known) / len(known)
    hosts, paths = defaultdict(list), defaultdict(list)
    for host, path, e in known:
        hosts[host].append(e)
        paths[host, path].append(e)

    def average(x):
        return sum(x) / len(x)

    noise = mean * (1 - mean) / len(known)
    between = sum(len(x) * (average(x) - mean) ** 2 for x in hosts.values()) / len(known) - noise * len(hosts)
    within = sum(len(x) * (average(x) - average(hosts[h])) ** 2 for (h, _), x in paths.items()) / len(known) - noise * (len(paths) - len(hosts))
    kh, kp = (min(max(mean * (1 - mean) / max(v, 1e-9) - 1, 2.0), 1e6) for v in (between, within))

    def at(host, path, without=None):
        h, p = list(hosts[host]), list(paths[host, path])
        if without is not None:
            h.remove(without)
            p.remove(without)
        up = (kh * mean + sum(h)) / (kh + len(h))
        return up, (kp * up + sum(p)) / (kp + len(p))

    return mean, kh, kp, at


def test_quality_posteriors_equal_brute_force(spark):
    r = random.Random(5)
    found = []
    for host in (None, "", "a", "b", "c"):
        for path in (None, "en", "fr", "de"):
            rate = r.random()
            found += [(host, path, min(max(r.gauss(rate, 0.1), 0.0), 1.0)) for _ in range(r.randrange(1, 40))]
    found += [("a", "en", None), ("empty", None, None), ("single", "en", 0.75)]
    out, level = quality.posteriors(spark.createDataFrame(found, "host string, path string, e double"))
    mean, kh, kp, at = brute_posteriors(found)
    assert (level["mean"], level["host"], level["path"]) == pytest.approx((mean, kh, kp)) and kh != pytest.approx(kp)
    got = {(x["host"], x["path"]): (x["host_posterior"], x["path_posterior"]) for x in out.collect()}
    assert len(got) == level["rows"] == 22
    for key, two in got.items():
        assert two == pytest.approx(at(*key)), key


def test_quality_scores_leave_the_own_evidence_out(spark):
    r = random.Random(6)
    data, labels = [], []
    for i in range(300):
        toxic = (i % 7 == 0) if i % 2 else (i % 3 == 0)
        text = " ".join(f"{r.choice('aeiou')}{r.randrange(9000)}" for _ in range(30)) + (" vile slur" if toxic else "")
        data.append((i, text if i % 50 else None, ["en", "fr", None][i % 3], f"s{i % 2}", 1, 7, "x", 3))
        labels.append((i, 1, int(toxic)))
    out = quality.judged(spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ["doc_id", "source", "lang"]).collect()
    own = {x["row"]["doc_id"]: None if x["e"]["toxic"] is None else 1 - (1 - x["e"]["toxic"]) * (1 - x["e"]["bad"]) for x in out}
    assert len(out) == 300 and sum(e is None for e in own.values()) == 6
    mean, _, _, at = brute_posteriors([(x["row"]["source"], x["row"]["lang"], own[x["row"]["doc_id"]]) for x in out])

    def logit(p):
        p = min(max(p, quality.EPS), 1 - quality.EPS)
        return math.log(p / (1 - p))

    for x in out:
        e, key = own[x["row"]["doc_id"]], (x["row"]["source"], x["row"]["lang"])
        others = at(*key, e)[1]
        odds = logit(others) + (0 if e is None else logit(e) - logit(mean))
        assert x["score"] == pytest.approx(1 / (1 + math.exp(-odds))) and x["rejected"] == (x["score"] > quality.REJECT)
        assert (x["host_posterior"], x["path_posterior"]) == pytest.approx(at(*key))
    # without a text, the path decides: that of 0 and 150 is toxic throughout
    assert {x["row"]["doc_id"] for x in out if x["rejected"]} == {0, 150} | {i for i, (_, _, toxic) in enumerate(labels) if toxic and i % 50}


def test_quality_lexicon_equals_a_plain_greedy_choice():
    r = np.random.default_rng(3)
    n, keys = 900, np.arange(10, 310, dtype=np.uint64)
    toxic = np.arange(n) < 400
    rows = [sorted(set(r.integers(0, 300, 4))) if toxic[i] else sorted(set(r.integers(0, 300, 12) // 12 * 12)) for i in range(n)]
    signs = np.tile(np.arange(n)[:, None], (1, quality.SIGNS))
    model = quality.Model()
    model.fit_lexicon(keys, rows, signs, toxic, 2)
    have = {k: [i for i in range(n) if k in rows[i]] for k in range(300)}
    hit = {k: {i for i in own if toxic[i]} for k, own in have.items()}
    strong = {k for k in have if len(hit[k]) >= quality.STRONG and quality.lower_bound(len(hit[k]), len(have[k])) >= quality.BOUND}
    weak = {k for k in have if k not in strong and len(hit[k]) >= max(2, quality.PRECISION * len(have[k]))}
    left = set().union(*(hit[k] for k in weak)) - set().union(*(set(have[k]) for k in strong))
    while weak:
        best = max(weak, key=lambda k: (len(hit[k] & left), -k))
        if len(hit[best] & left) < 2:
            break
        strong.add(best)
        weak.remove(best)
        left -= hit[best]
    assert model.lexicon.tolist() == [10 + k for k in sorted(strong)] and len(strong) > 20


@pytest.mark.parametrize("steep", [1, 8, 1000])
def test_quality_style_fit_is_the_least_loss(steep):
    """Also where the classes are nearly, or wholly, separable."""
    r = np.random.default_rng(4)
    x = np.column_stack([r.normal(size=(400, 3)), r.random(400) < 0.02, r.exponential(size=400) ** 4]).astype(float)
    bad = (r.random(400) < 1 / (1 + np.exp(np.clip(-steep * (x @ np.array([1.0, -2, 0, 0.5, 0]) - 1), -700, 700)))).astype(float)
    model = quality.Model()
    model.fit_style(x, bad)
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(400)])

    def loss(w):
        return np.logaddexp(0, np.where(bad > 0, -1, 1) * (z @ w)).sum() + 0.05 * (w * w).sum()

    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-2
        assert loss(model.weights) < min(loss(model.weights + step), loss(model.weights - step))


def test_quality_clashing_names_and_repeated_rows(spark):
    data = [(i % 40, f"word{i % 7} other words here {i}", "en", "s", "c", "d", 1.0) for i in range(80)] + [(None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, host string, path string, score double")
    kept = quality.keep_good(docs, spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and len(rows(kept)) == len(data)


def test_quality(spark, none):
    r = random.Random(7)
    vocabulary = [f"word{i}" for i in range(300)]
    data, labels = [], []
    for i in range(300):
        w = [r.choice(vocabulary) for _ in range(40)]
        toxic, bad = i % 10 == 0, i % 10 == 1
        if toxic:
            w[5], w[20] = "idiot", "idiot,"
        text = "!! ".join(x.upper() for x in w) if bad else " ".join(w)
        data.append((i, text, "en", f"s{i % 3}", "clash"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    data += [(900, None, None, None, "c"), (901, "", "en", "s1", "c"), (902, "word1 " * 20000, "en", "s1", "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score string")
    lab = spark.createDataFrame(labels + [(None, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in rows(quality.keep_good(docs, lab))}
    assert kept >= {i for i in range(300) if i % 10 > 1} and not kept & {i for i in range(300) if i % 10 <= 1}
    assert {900, 901} <= kept
    assert len(rows(quality.keep_good(docs, lab.limit(0)))) == len(data)
    assert rows(quality.keep_good(none, lab)) == []
