"""Relational operators: small constructed cases, folds and streams against plain Python."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import ratio
from ledgerloom.operators import dictionary as D
from ledgerloom.operators import documents as P
from ledgerloom.operators import matching as M
from ledgerloom.operators import review as R
from ledgerloom.operators import suppliers as S
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import jobs

LINE = "job_id long, idx int, ref string, designation string, qty decimal(18,4), price decimal(18,4), tva decimal(9,4), total decimal(18,4), confidence double"


def line(job, idx, ref, name, qty, price, tva=19, total=None, confidence=1.0):
    d = lambda x: None if x is None else Decimal(str(x))
    return (job, idx, ref, name, d(qty), d(price), d(tva), d(total), confidence)


@pytest.fixture(scope="module")
def frames(spark):
    return lambda rows: spark.createDataFrame(rows, LINE)


def match(spark, frames, bc, fac, bl=(), ht=None, t=M.DEFAULT):
    invoices = spark.createDataFrame([(1, None if ht is None else Decimal(str(ht)), Decimal("19"))], "job_id long, total_ht decimal(18,4), tva_rate decimal(9,4)")
    got = M.three_way_match(frames(list(bc)), frames(list(bl)), frames(list(fac)), invoices, t).orderBy("part", "ord").collect()
    return [(r["ref_produit"], r["verdict"], r["mismatch_fields"], r["match_layer"]) for r in got]


def test_verdicts(spark, frames):
    bc = [line(1, 0, "A1", "vis", 5, 10), line(1, 1, "B2", "boulon", 5, 10), line(1, 2, "C3", "rondelle plate", 5, 10), line(1, 3, "D4", "joint torique", 5, 10), line(1, 4, "E5", "palier", 2, 240.278)]
    fac = [line(1, 0, "A1", "vis", 5, 10), line(1, 1, "B2", "boulon", 4, 10), line(1, 2, "C3", "rondelle plate", 5, 12), line(1, 3, "WWW777", "transport", 1, 7), line(1, 4, "E5", "palier", 2, 24.028)]
    assert match(spark, frames, bc, fac) == [
        ("A1", "MATCH", [], 1), ("B2", "PARTIAL_MATCH", [], 1), ("C3", "MISMATCH", ["prix_unitaire"], 1), ("D4", "MISSING", [], 0), ("E5", "LOW_CONFIDENCE", [], 1), ("WWW777", "EXTRA", ["ref_produit"], 0),
    ]
    strict = M.Tolerances(invoice_allow_partial=False)
    assert match(spark, frames, bc[1:2], fac[1:2], t=strict) == [("B2", "MISMATCH", ["qty_bc_vs_facture"], 1)]


def test_line_and_document_totals_repair_quantities(spark, frames):
    bc = [line(1, 0, "A1", "vis", 10, 5), line(1, 1, "B2", "boulon", 2, 50)]
    by_line = [line(1, 0, "A1", "vis", 1, 5, total=50), line(1, 1, "B2", "boulon", 2, 50, total=100)]
    assert [v[1] for v in match(spark, frames, bc, by_line)] == ["MATCH", "MATCH"]
    by_total = [line(1, 0, "A1", "vis", 20, 5), line(1, 1, "B2", "boulon", 2, 50)]
    assert [v[1] for v in match(spark, frames, bc, by_total, ht=150)] == ["MATCH", "MATCH"]
    assert [v[1] for v in match(spark, frames, bc, [line(1, 0, "A1", "vis", 10, 9), by_total[1]], ht=190)] == ["MISMATCH", "MATCH"]


def test_rate_slip(spark, frames):
    bc = [line(1, i, f"A{i}", "vis", 1, 5, tva=19) for i in range(3)]
    fac = [line(1, i, f"A{i}", "vis", 1, 5, tva=19 if i else 16) for i in range(3)]
    assert [v[1] for v in match(spark, frames, bc, fac)] == ["MATCH"] * 3
    fac = [line(1, i, f"A{i}", "vis", 1, 5, tva=19 if i else 7) for i in range(3)]
    assert [v[1] for v in match(spark, frames, bc, fac)] == ["MISMATCH", "MATCH", "MATCH"]


def test_delivery_merge_and_global_verdict(spark, frames):
    rows = [(1, 1, 0, "a1 ", "vis", Decimal(3)), (1, 2, 0, "A1", "autre", Decimal(2)), (1, 1, 1, None, "x", None), (1, 2, 1, "", "y", Decimal(1))]
    df = spark.createDataFrame(rows, "job_id long, doc_ord int, idx int, ref string, designation string, qty decimal(18,4)")
    df = df.select("*", *[F.lit(None).cast("decimal(18,4)").alias(c) for c in ("price", "tva", "total")], F.lit(0.9).alias("confidence"), F.lit(False).alias("low"))
    got = M.merge_deliveries(df).orderBy("idx").collect()
    assert [(r["designation"], r["qty"]) for r in got] == [("vis", Decimal("5.0000")), ("x", None), ("y", Decimal("1.0000"))]
    verdicts = spark.createDataFrame([(1, "MATCH"), (1, "MISSING"), (2, "MISMATCH"), (3, "MATCH"), (4, "PARTIAL_DATA")], "job_id long, verdict string")
    jobs_ = spark.createDataFrame([(1, True, True, 0), (2, True, True, 0), (3, True, True, 1), (4, True, True, 0), (5, True, False, 0), (6, False, True, 0)], "job_id long, has_order boolean, has_invoice boolean, n_warnings int")
    out = {r["job_id"]: (r["global_verdict"], r["status"]) for r in M.match_results(verdicts, jobs_).collect()}
    assert out == {1: ("PARTIAL", "COMPLETED"), 2: ("REJECTED", "COMPLETED"), 3: ("REVIEW", "REVIEW_REQUIRED"), 4: ("VALIDATED", "COMPLETED"), 5: ("INCOMPLETE", "REVIEW_REQUIRED"), 6: ("VALIDATED", "FAILED")}


def fold(pages):
    """Pages (number, kind, reference, text) grouped one after the other."""
    groups, open_ = [], None
    for number, kind, ref, text in pages:
        if kind == "RECEPTION":
            continue
        if open_ and kind != "UNKNOWN":
            fits = text == "SUITE" or (open_[2] in ("", ref) if ref else False)
            if (kind == open_[0] and fits) or (kind == "FACTURE" and text == "NET HORS TAXES" and open_[0] in ("BC", "BL")):
                open_[1].append(number)
                open_[2] = open_[2] or ref
                continue
        groups.append([kind, [number], ref])
        open_ = groups[-1] if kind != "UNKNOWN" else None
    return [tuple(g) for g in groups]


def test_page_groups_against_a_fold(spark):
    import random

    r = random.Random(4)
    data, want = [], {}
    for job in range(120):
        pages = [(n, r.choice(["BC", "BC", "BL", "FACTURE", "RECEPTION", "UNKNOWN"]), r.choice(["", "", "R1", "R2"]), r.choice(["", "x", "SUITE", "NET HORS TAXES"])) for n in range(r.randrange(1, 12))]
        want[job] = fold(pages)
        data += [(job, n, k, 0.5, 1, ref, text) for n, k, ref, text in pages]
    df = spark.createDataFrame(data, "job_id long, page_number int, doc_type string, confidence double, tier int, ref string, text string")
    got = {}
    for g in P.group_pages(df).orderBy("job_id", "group_no").collect():
        got.setdefault(g["job_id"], []).append((g["doc_type"], g["pages"], g["ref"]))
    assert got == {k: v for k, v in want.items() if v}


def test_summary_page_joins_its_order(spark):
    data = [(1, 0, "BC", 0.8, 1, "R1", "BON DE COMMANDE"), (1, 1, "FACTURE", 0.4, 2, "", "NET HORS TAXES 10")]
    df = spark.createDataFrame(data, "job_id long, page_number int, doc_type string, confidence double, tier int, ref string, text string")
    got = P.group_pages(df).collect()
    assert [(g["doc_type"], g["pages"], g["confidence"], g["tier"]) for g in got] == [("BC", [0, 1], 0.4, 2)]


DICTIONARY = "raw_form string, canonical_form string, category string, weight double, source string, verified boolean, ignored boolean, supplier_id string, usage_count int"


def test_dictionary_lookup_against_brute_force(spark):
    import random

    r = random.Random(5)
    entries = sorted({"".join(r.choice("abcde") for _ in range(r.randrange(4, 9))) for _ in range(150)})
    known = spark.createDataFrame([(e, e.upper(), "PRODUCT", 0.9, "MANUAL", True, False, None, 0) for e in entries], DICTIONARY)
    keys = sorted({"".join(r.choice("abcde") for _ in range(r.randrange(4, 9))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {(k, e): distance(k, e) for k in keys for e in entries if distance(k, e) <= 2}
    got = {(x["key"], x["raw_form"]): x["distance"] for x in D.near_entries(spark.createDataFrame([(k,) for k in keys], "key string"), known).collect()}
    assert got == want
    best = {x["key"]: x["weight"] for x in D.fuzzy_lookup(spark.createDataFrame([(k,) for k in keys], "key string"), known).collect()}
    for k in keys:
        scores = [ratio(k, e) / 100 * (1 - 0.05 * d) for (a, e), d in want.items() if a == k and ratio(k, e) >= 80]
        assert (k in best) == bool(scores) and (not scores or best[k] == pytest.approx(min(max(scores) * 0.95, 0.95)))


def test_correction_and_texts(spark):
    known = spark.createDataFrame([("disque", "DISQUE", "PRODUCT", 0.9, "MANUAL", True, False, None, 0), ("weak", "WEAK", "PRODUCT", 0.5, "MODEL", True, False, None, 0)], DICTIONARY)
    tokens = spark.createDataFrame([("disque",), ("d1sque",), ("BCF04H",), ("weak",), ("zzzz",)], "token string")
    got = {r["token"]: (r["corrected"], r["method"]) for r in D.correct_tokens(tokens, known).collect()}
    assert got == {"disque": ("DISQUE", "EXACT"), "d1sque": ("DISQUE", "FUZZY"), "BCF04H": ("BCF04H", "PROTECTED"), "weak": ("WEAK", "FUZZY"), "zzzz": ("zzzz", "PASSTHROUGH")}
    texts = spark.createDataFrame([(1, "d1sque  BCF04H\tdisque"), (2, None), (3, "")], "id long, text string")
    assert {r["id"]: r["normalised"] for r in D.normalise_texts(texts, known).collect()} == {1: "DISQUE  BCF04H\tDISQUE", 2: None, 3: ""}


def test_aliases(spark):
    cols = "supplier_key string, external_ref string, internal_ref string, is_active boolean, usage_count int"
    known = spark.createDataFrame([("k", "X-1", "A1", False, 2), ("k", "X2", "B2", True, 0)], cols)
    new = spark.createDataFrame([("k", "x1", "A1", True, 0), ("k", "X2", "OTHER", True, 0), ("k", "X3", "C3", True, 0)], cols)
    kept, clash = R.approve_aliases(known, new)
    assert {(r["external_ref"], r["internal_ref"], r["is_active"]) for r in kept.collect()} == {("X-1", "A1", True), ("X2", "B2", True), ("X3", "C3", True)}
    assert [r["external_ref"] for r in clash.collect()] == ["X2"]


def test_external_answers(spark):
    good = '{"ref_bc": "a}1", "lines": [{"qty": "2", "prix_unitaire": "5000", "total_ligne_ht": "10"}]}'
    data = [(1, "BC", "", [f"Voici {good} fin"]), (2, "BC", "", ["{note}", good]), (3, "BC", "", None), (4, "BL", "", [good, good]), (5, "BC", "P1000001 P1000002", [good, good])]
    docs = spark.createDataFrame(data, "doc_id long, kind string, text string, answers array<string>")
    got = {r["doc_id"]: r for r in P.mapped_external(docs).collect()}
    assert set(got) == {1, 2, 5} and got[1]["ref_document"] == "A}1" and got[1]["lines"][0]["prix_unitaire"] == Decimal("5.000000")
    assert [(got[i]["used"], got[i]["tries"]) for i in (1, 2, 5)] == [(1, 1), (2, 1), (2, 1)]


def test_answers_are_read_as_they_come():
    read = lambda t: P.read_answer(t)[:2]
    assert read('{"a": 1}') == (True, '{"a": 1}') and read("[1]") == (True, None) and read("") == read(None) == (False, None)
    assert read('x {"a": "}"} {"b": 2}') == (True, '{"a": "}"}') and read("{x} {\"b\": 2}") == (True, '{"b": 2}')
    assert read('```json\n{"a": 1}\n```') == (True, '{"a": 1}') and read('"open {"') == (True, None) and read('"open {') == (False, None)
    assert P.read_answer('{"line_count_in_document": 3, "lines": [1]}')[2:] == (3, 1) and P.read_answer('{"line_count_in_document": "3"}')[2:] == (None, 0)


def test_roles_and_detection(spark):
    lines = spark.createDataFrame([(1, 1, "Fournisseur : Boulons SA"), (1, 2, "Client:"), (1, 3, "Usine X"), (1, 4, "GRANDE MAISON")], "doc_id long, line_no int, line string")
    got = {(r["role"], r["name"]) for r in S.roles(lines).collect()}
    assert got == {("ISSUER", "Boulons SA"), ("RECIPIENT", "Usine X"), ("ISSUER", "GRANDE MAISON")}
    df = spark.createDataFrame([(0.5, "x"), (0.3, "x"), (0.1, "x"), (0.3, None)], "s double, n string")
    assert [r[0] for r in df.select(S.detection(F.col("s"), F.col("n"))).collect()] == ["ENRICH", "CREATE", "GENERIC", "GENERIC"]


def test_stream_equals_batch(spark, tmp_path):
    schema = "supplier_key string, pattern string, doc_id long"
    rows = [("s", "p", i) for i in range(4)] + [("s", "q", 1), ("s", "q", 1), ("t", "p", 9)]
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert jobs.finished(jobs.promoted_patterns(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    batch = S.promoted_patterns(spark.createDataFrame(rows, schema)).select("supplier_key", "pattern")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("supplier_key", "pattern").collect()]
    assert sorted(got) == sorted(tuple(r) for r in batch.collect())


def test_batches_are_idempotent(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = jobs.run_batches(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda df: df.where("id % 2 = 0"), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert jobs.finished(q)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"nope")
    assert {r["is_pdf"] for r in readers.pdf_uploads(spark, f"{tmp_path}/*.pdf").collect()} == {True, False}
    (tmp_path / "s.sql").write_text("INSERT INTO t VALUES\n('k', 'X''1', 'A1'),\n-- no\n")
    assert [r[0] for r in readers.seed_aliases(spark, f"{tmp_path}/s.sql").collect()] == [["k", "X'1", "A1"]]
    (tmp_path / "j.json").write_text('{"id": "j", "documents": [{"id": "d", "doc_type": "BC", "lines": [{"line_number": 1, "qty": 2.0}]}]}')
    assert readers.job_lines(readers.job_documents(spark, f"{tmp_path}/j.json")).collect()[0]["qty"] == 2.0
    df = spark.createDataFrame([(Decimal("0.00"), "a"), (Decimal("1.50"), "b")], "q decimal(9,2), r string")
    assert [r["q"] for r in sinks.stored_lines(df).orderBy("r").collect()] == [None, 1.5]
    now = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert {tuple(r) for r in sinks.replace_keys(now, spark.createDataFrame([(2, "z")], "id int, v string"), ["id"]).collect()} == {(1, "x"), (2, "z")}


def test_contained_against_brute_force(spark):
    import random

    from ledgerloom.operators.containment import contained

    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    texts = [(i, word(r.randrange(0, 60)) if i else None) for i in range(80)]
    needles = sorted({word(r.randrange(1, 6)) for _ in range(60)} | {""})
    got = [contained(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"), limit) for limit in (10_000, 40)]
    want = sorted((i, n) for i, t in texts for n in needles if n and t and n in t)
    assert all(sorted(map(tuple, g.collect())) == want for g in got)


def test_profiles_against_brute_force(spark):
    import random
    import re

    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "REF-1", "zz"]
    data = []
    for i in range(14):
        pick = lambda k: r.sample(words, k) if r.random() < 0.7 else None
        data.append((f"Maison {i % 7}{'abcdefghij'[i % 10]}", str(1000 + i) if r.random() < 0.4 else None, f"TN{i}" if r.random() < 0.4 else "", pick(1), pick(2), [r"REF-\d", "Q+"] if r.random() < 0.5 else None))
    texts = [(i, " ".join(r.choice([*words, *[d[0] for d in data], "1003", "TN5", "x"]) for _ in range(r.randrange(0, 6))), r.choice([None, "MAISON 1B", "Maison 22C", "rien"])) for i in range(60)]

    def alike(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return 2 * rows[-1][-1] / (len(a) + len(b))

    def best(text, detected):
        up, found = text.upper(), (0.0, "")
        for name, siret, vat, aliases, keywords, patterns in data:
            if name == data[3][0]:
                continue
            weights = [0.70] * (name.upper() in up) + [0.30] * bool(detected and alike(detected.upper(), name.upper()) >= 0.85) + [0.50] * any(len(a) >= 3 and a.upper() in up for a in aliases or [])
            weights += [0.90] * bool(siret and siret in text) + [0.90] * bool(vat and vat in text)
            weights += [0.40 * sum(k.upper() in up for k in keywords or []) / len(keywords or "-")] * bool(keywords) + [0.30] * any(re.search(p, up) for p in patterns or [])
            if weights:
                found = max(found, (round(min(1.0, sum(weights) / len(weights)), 9), name))
        return found if found[0] > 0 else None

    profiles = spark.createDataFrame(data, "name string, siret string, vat_number string, name_aliases array<string>, keywords array<string>, ref_patterns array<string>")
    got = S.profile_scores(spark.createDataFrame(texts, "doc_id long, text string, detected_name string"), profiles, (data[3][0].lower(),)).collect()
    assert {r["doc_id"]: (round(r["score"], 9), r["name"]) for r in got} == {i: b for i, t, d in texts if (b := best(t, d))}


def test_a_worse_assignment_is_not_optimal(spark):
    from ledgerloom.operators import assignment as A

    scores = [(1, "BL", 1, 1, 1.0), (1, "BL", 1, 2, 0.85), (1, "BL", 2, 1, 0.85), (1, "BL", 2, 2, 0.0)]
    scores = spark.createDataFrame(scores, "job_id long, side string, bc_idx int, doc_idx int, score double")
    proof = "job_id long, side string, of string, idx int, potential double, mate int, confidence double"
    good = [(1, "BL", "BC", 1, 0.0, 2, 0.85), (1, "BL", "BC", 2, 0.15, 1, 0.85), (1, "BL", "BL", 1, 0.0, None, None), (1, "BL", "BL", 2, 0.15, None, None)]
    greedy = [(1, "BL", "BC", 1, 0.0, 1, 1.0), (1, "BL", "BC", 2, 0.15, 2, 0.0), (1, "BL", "BL", 1, 0.0, None, None), (1, "BL", "BL", 2, 0.15, None, None)]
    bold = [(j, s, o, i, p + 0.5, m, c) for j, s, o, i, p, m, c in greedy]
    assert [A.optimality(spark.createDataFrame(p, proof), scores).first()["optimal"] for p in (good, greedy, bold)] == [True, False, False]


def test_merged_keys_survive_killed_batches(spark, tmp_path):
    schema, at = "k long, v int, t int", str(tmp_path / "t")
    batch = lambda rows: spark.createDataFrame(rows, schema)
    now = lambda: [tuple(r) for r in sinks.current_rows(spark, at, schema).collect()]
    merge = lambda rows, n: sinks.merge_by_key(batch(rows), at, ["k"], ["t"], n, 4)
    assert now() == []
    merge([(1, 10, 1), (2, 20, 1), (2, 21, 2), (None, 5, 1)], 0)
    merge([(1, 11, 0), (3, 30, 1), (2, 22, 2)], 1)
    want = [(1, 10, 1), (2, 22, 2), (3, 30, 1)]
    assert sorted(map(str, now())) == sorted(map(str, [*want, (None, 5, 1)]))
    # a batch that was killed after its rows and before its manifest leaves no trace, and ends as it should when it is run again
    merge([(1, 99, 9), (4, 40, 1)], 2)
    import shutil

    shutil.rmtree(f"{at}/manifest/batch=2")
    assert sorted(map(str, now())) == sorted(map(str, [*want, (None, 5, 1)]))
    for _ in range(2):
        merge([(1, 99, 9), (4, 40, 1)], 2)
        assert sorted(map(str, now())) == sorted(map(str, [(1, 99, 9), (2, 22, 2), (3, 30, 1), (4, 40, 1), (None, 5, 1)]))
    merge([(1, 100, 10)], 1)  # an older batch again
    assert "(1, 99, 9)" in set(map(str, now()))


def test_table_rows_against_a_loop(spark):
    import random

    from ledgerloom.operators import tables as B

    r = random.Random(11)
    data = [(p, i, f"w{i}", r.randrange(0, 400), r.randrange(0, 120), 20, 10, 90.0) for p in range(12) for i in range(r.randrange(1, 40))]
    df = spark.createDataFrame(data, "doc_id long, ord int, text string, x int, y int, w int, h int, conf double")
    want = {}
    for p in {d[0] for d in data}:
        row, anchor = -1, None
        for d in sorted((d for d in data if d[0] == p), key=lambda d: (d[4] + d[6] / 2, d[3], d[1])):
            centre = d[4] + d[6] / 2
            if anchor is None or abs(centre - anchor) > B.ROW_GAP:
                row, anchor = row + 1, centre
            want[p, d[1]] = row
    assert {(x["doc_id"], x["ord"]): x["row"] for x in B.word_rows(df, ["doc_id"]).collect()} == want


def test_table_of_two_columns_ends_at_its_total(spark):
    from ledgerloom.operators import tables as B

    lines = [("ACME", "2024"), ("REF", "PRIX UNIT"), ("A10", "5,000"), ("vis", "rouge"), ("TOTAL HT", "5,000"), ("B20", "6,000")]
    data = [(1, 10 * i + j, t, 10 + 200 * j, 30 * i, 60, 10, 80.0 + 10 * j) for i, row in enumerate(lines) for j, t in enumerate(row)]
    df = spark.createDataFrame(data, "doc_id long, ord int, text string, x int, y int, w int, h int, conf double")
    got = B.table_lines(df, ["doc_id"]).collect()
    assert [(g["row"], g["ref_produit"], g["prix_unitaire"], g["confidence"]) for g in got] == [(2, "A10", Decimal("5.000000"), 0.8)]
    assert B.with_columns(B.page_rows(df.where("text <> 'REF'"), ["doc_id"])).count() == 0


def test_ratios_lose_no_pair_to_the_edit_distance(spark):
    import random

    from ledgerloom.functions.similarity import ratio

    r = random.Random(12)
    words = sorted({"".join(r.choice("abc ") for _ in range(r.randrange(0, 12))).strip() for _ in range(60)})
    pairs = [(a, b) for a in words for b in words]
    got = S.ratios_of_at_least(spark.createDataFrame(pairs, "a string, b string"), "a", "b", 60.0)
    assert {(x["a"], x["b"], x["ratio"]) for x in got.collect()} == {(a, b, ratio(a, b)) for a, b in pairs if ratio(a, b) >= 60}


def test_streamed_profiles_equal_the_batch(spark, tmp_path):
    import random

    r = random.Random(13)
    schema = "supplier_key string, pattern string, doc_id long, pos int"
    rows = [(r.choice("st"), f"p{r.randrange(9)}", doc, pos) for doc in range(60) for pos in range(r.randrange(0, 5))]
    every = spark.createDataFrame(rows, schema)
    for i in range(4):
        every.where(f"doc_id div 15 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", schema, 1)
    assert jobs.finished(jobs.profiles(stream, f"{tmp_path}/out", f"{tmp_path}/cp", keep=5))
    out = spark.read.parquet(f"{tmp_path}/out")
    got = {tuple(x) for x in out.where("pattern is not null").select("supplier_key", "pattern", "promoted_by", "place").collect()}
    want = S.promoted_patterns(every, keep=5).select("supplier_key", "pattern", "promoted_by", "place")
    assert got == {tuple(x) for x in want.collect()} and len(got) == 10
    last = {tuple(x) for x in out.groupBy("supplier_key").agg(F.max("changes"), F.max("confidence")).collect()}
    assert last == {tuple(x) for x in S.raised_confidence(every, keep=5).select("supplier_key", "changes", "confidence").collect()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
