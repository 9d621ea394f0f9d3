"""Every registered query against its SQL on the smallest driver tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from ledgerloom import registry

SF = "/root/testdata/sf0.001"
ENTRIES = registry.entries()


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if out[c].dtype.kind == "f" or str(out[c].dtype) in ("Int64", "Float64"):
            out[c] = out[c].astype(float).round(9)
    text = out.astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"}).replace(r"\.0$", "", regex=True)
    return text.sort_values(list(text.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_equals_sql(spark, duck, name):
    got, want = comparable(ENTRIES[name].query(spark, SF).toPandas()), comparable(duck.sql(ENTRIES[name].sql).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.sql])
def test_query_has_rows(spark, name):
    assert ENTRIES[name].query(spark, SF).limit(1).count() == 1


def test_entry_points(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


#: External steps and plumbing, which have no query; all other operators have one that is compared with SQL.
COUNTS = {"SRC": 14, "SNK": 7, "NRM": 14, "NUM": 7, "FMT": 3, "FLT": 22, "JN": 22, "AGG": 21, "WIN": 8, "SRT": 8, "SET": 4, "CLS": 4, "EXT": 14, "DIC": 12, "SUP": 5, "VAL": 5, "REC": 4, "VRD": 12, "STR": 6}
OUTSIDE = {"SRC3", "SRC9", "SRC11", "DIC7"}


def test_every_operator_has_a_query_with_sql():
    claimed = {x for e in ENTRIES.values() if e.sql for x in e.operators}
    assert {f"{k}{i}" for k, n in COUNTS.items() for i in range(1, n + 1)} - claimed == OUTSIDE
