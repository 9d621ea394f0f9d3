"""Queries against their SQL on tables like those of larger scale factors, and forms that hold at any size."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom import registry
from tests.test_registry import comparable

ENTRIES = registry.entries()


def against_sql(spark, folder, name, **tables):
    """The query and its SQL over tables written to a folder."""
    duck = duckdb.connect()
    for table, rows in tables.items():
        rows.to_parquet(f"{folder}/{table}.parquet")
        duck.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = comparable(ENTRIES[name].query(spark, str(folder)).toPandas()), comparable(duck.sql(ENTRIES[name].sql).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    return want


def suppliers(keys):
    return pd.DataFrame({"s_suppkey": pd.Series(keys, dtype="int64"), "s_name": [f"Supplier#{k:09d}" for k in keys], "s_nationkey": pd.Series([1] * len(keys), dtype="int32"), "s_acctbal": 1.0})


def test_profile_scores_of_names_that_share_digits_in_other_places(spark, tmp_path):
    assert len(against_sql(spark, tmp_path, "profile_scores", supplier=suppliers([9, 39, 48, 69, 84, 881, 956, 986, 998, 19998, 89999]))) == 11


SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cascade_classifies_a_page_once_in_many_tasks(spark):
    once, cascade = (ENTRIES[n].query(spark, SF) for n in ("classify_rule", "classify_cascade"))
    assert plan(cascade).count("ORDRE") == plan(once).count("ORDRE") > 0
    assert cascade.rdd.getNumPartitions() >= 4


def test_classify_by_guards_equals_plain_patterns(spark):
    from ledgerloom.operators import documents as D

    texts = ["BON DE COMMANDE N°12\nx\ny", "a\nb\nc\nd\nBL-2024", "RÉCEPTION : le\nQTÉ RÉCEPT", "facture n° 7\nAVOIR", "ORDRE D'ACHAT : 5", "DATE REÇU 12\nEXPODIO LE", "rien du tout ici", "N° BC 12 et FACT N°3\n\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", D.classify(F.col("text"))["confidence"].alias("c"), D.classify(F.col("text"))["type"].alias("t")).collect()
    import re

    for r in rows:
        up = r["text"].upper()
        lines = up.splitlines()
        top = "\n".join(lines[: max(1, len(up.split("\n")) * 4 // 10)])
        s = {k: min(1.0, sum(0.40 if re.search(p, top) else 0.15 if re.search(p, up) else 0.0 for p in ps)) for k, ps in D.KEYWORDS.items()}
        best, second = sorted(s.values(), reverse=True)[:2]
        want = ("UNKNOWN", 0.0) if best < 0.15 else (next(k for k in s if s[k] == best), best * 0.7 if best - second < 0.10 else best)
        assert r["t"] == want[0] and r["c"] == pytest.approx(want[1]), r["text"]


@pytest.mark.parametrize("pattern, fixed", [(r"\bBC[-/]\d{4}", "BC"), (r"ab|cd", ""), (r"a?bc", "bc"), (r"(abc)?d", "d"), (r"\bR[ÉE]CEPTION\b", "CEPTION")])
def test_letters_that_every_match_holds(pattern, fixed):
    from ledgerloom.operators import documents as D

    assert D._fixed(pattern) == fixed


def test_bounded_streams_are_waited_for_without_a_limit():
    from ledgerloom.streaming import jobs

    class Slow:
        def awaitTermination(self, *seconds):  # noqa: N802
            return None if not seconds else False

    assert jobs.finished(Slow()) and not jobs.finished(Slow(), 1)


def test_promotion_by_keyed_state_across_batches(spark, tmp_path):
    """Documents that repeat in later batches count once; a hot pattern keeps three ids; older states go."""
    from ledgerloom.streaming import jobs

    schema, rng = "supplier_key string, pattern string, doc_id long", __import__("random").Random(5)
    rows = [[(rng.choice("st"), f"p{rng.randrange(12)}", rng.randrange(6)) for _ in range(14)] + [("s", "hot", d) for d in range(500 * i)] for i in range(4)]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert jobs.finished(jobs.promoted_patterns(jobs.file_stream(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out", f"{tmp_path}/cp"))
    docs, want = {}, {}
    for i, part in enumerate(rows):
        for s, p, d in part:
            docs.setdefault((s, p), set()).add(d)
        want |= {k: i for k, v in docs.items() if len(v) >= 3 and k not in want}
    got = {(r["supplier_key"], r["pattern"]): r["batch"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want and len(set(want.values())) > 1
    state = spark.read.parquet(f"{tmp_path}/cp/keyed/state-3")
    assert state.count() == len(docs) and state.agg(F.max(F.size("docs"))).first()[0] == 3
    assert not (tmp_path / "cp/keyed/state-1").exists() and (tmp_path / "cp/keyed/state-2").exists()


def test_alias_order_ranks_a_list_of_keys_once(spark, monkeypatch):
    """No row of a job is sorted or moved: the window stands below the join. Equal priorities, null keys' jobs and blocks of jobs as in the plain form."""
    from pyspark.sql import Window

    from ledgerloom.operators import review as R

    aliases = spark.createDataFrame([(i, f"k{i % 4}", i % 5 > 0) for i in range(60)], "id long, supplier_key string, is_active boolean")
    keys = spark.createDataFrame([(j, f"k{k}", p) for j in range(30) for k, p in ((j % 3, 0), (3, j % 2), (9, 5))], "job_id long, supplier_key string, priority int")
    plain = aliases.where("is_active").join(keys, "supplier_key").withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("priority", "id")))
    want = sorted(map(tuple, plain.select("job_id", "id", "supplier_key", "priority", "place").collect()))
    for small in (R.SMALL, 7):
        monkeypatch.setattr(R, "SMALL", small)
        got = R.alias_order(aliases, keys)
        assert sorted(map(tuple, got.collect())) == want
        above = plan(got).split("Window ")[0]
        assert "job_id" in above and "Sort" not in above and len(want) > 400


def test_external_lines_polish_a_line_once_in_many_tasks(spark):
    from ledgerloom.operators import documents as D

    df = ENTRIES["external_lines"].query(spark, SF)
    assert 0 < plan(df).count(D.ODD_REFERENCE) <= 6  # 12 where each field of a line polishes it anew
    assert df.rdd.getNumPartitions() >= 4


def test_rematch_parses_saved_documents_once(spark):
    """What the later steps read is written before: no JSON is parsed in the plan that is returned, and no pair is looked up."""
    text = plan(ENTRIES["rematched"].query(spark, SF))
    assert "from_json" not in text and "jsontostructs" not in text.lower() and "doc_idx" not in text


def test_nested_results_pair_lines_once(spark):
    assert "lineitem" not in plan(ENTRIES["nested_results"].query(spark, SF)) and "l_orderkey" not in plan(ENTRIES["nested_results"].query(spark, SF))
