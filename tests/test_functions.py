"""Table-driven tests of the scalar functions, guards and similarity."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import guards as G
from ledgerloom.functions import similarity as S
from ledgerloom.functions import text as X
from ledgerloom.operators.assignment import hungarian, solve


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


NUMBERS = [
    ("1,50", "1.50"), ("240,278", "240.278"), ("1,200", "1.200"), ("12000,500", "12000500"), ("1,2345", "12345"), ("122.341", "122.341"),
    ("1.200,50", "1200.50"), ("1,200.50", "1.20050"), ("1,200,000.5", "1200000.5"), ("1.200.000", "1200.000"), ("1200", "1200"), ("1 200,5 DT", "1200.5"),
    ("-5", "5"), ("", None), ("abc", None), (None, None), (",", None),
]


def test_number(spark):
    got = apply(spark, [a for a, _ in NUMBERS], X.number)
    assert got == [None if b is None else Decimal(b).quantize(Decimal("0.000001")) for _, b in NUMBERS]


def test_quantity_keeps_the_raw_text(spark):
    got = apply(spark, ["~ 12,5 ", "-3", None], X.quantity)
    assert [(r["value"], r["raw"]) for r in got] == [(Decimal("12.5"), "~ 12,5"), (Decimal("3"), "-3"), (None, None)]


def restated(text):
    text = text.replace(" ", "")
    swap = dict(zip("OolISBGZ", "00115862"))
    near = set("0123456789OolISBGZ")
    return "".join(swap[c] if c in swap and ((i and text[i - 1] in near) or (i + 1 < len(text) and text[i + 1] in near)) else c for i, c in enumerate(text))


def test_digits_for_letters(spark):
    r = random.Random(1)
    values = ["".join(r.choice("0159OolISBGZAx- ") for _ in range(r.randrange(0, 14))) for _ in range(400)]
    assert apply(spark, values, X.digits_for_letters) == [restated(v) for v in values]


@pytest.mark.parametrize("fn, cases", [
    (X.match_key, [(" bc-2024/é1 ", "BC20241"), (None, ""), ("", "")]),
    (X.description, [("Disqué  Ø40, œuf", "disque  40 oeuf"), (None, "")]),
    (X.supplier_key, [("Sté ACME S.A.R.L", "ACMESARL"), ("SARL", "SARL"), ("Ets. Boulon Tunisie", "BOULON")]),
    (X.dictionary_key, [(" Disqué ", "disque"), ("P.U.HT", "p.u.ht"), ("Bon de  Commande!", "bon de commande"), (None, "")]),
    (X.join_broken, [("quan- tité  a", "quantité a")]),
    (X.generalised, [("AB-1234", "AB\\-\\d{4}"), ("Boulon12", "[A-Z]{1,6}\\d{2}")]),
    (X.supplier_code, [("Boulonnerie Générale", "BOULGENE"), ("a", "UNKNOWN")]),
])
def test_normalisers(spark, fn, cases):
    assert apply(spark, [a for a, _ in cases], fn) == [b for _, b in cases]


def test_dates(spark):
    got = apply(spark, ["05/03/2024", "5-3-2024", "05.03.2024", "2024-03-05", "05/03/24", "05/03/75", "5 march 2024", "05/03/2024 10:30", "x", None], X.date)
    assert [str(d) for d in got] == ["2024-03-05"] * 5 + ["1975-03-05", "2024-03-05", "2024-03-05", "None", "None"]


def test_guards(spark):
    codes = ["P199420414", "BCF04H", "595X395X330", "C/C", "BC-2024-001", "disque", "12", "vis"]
    assert apply(spark, codes, G.looks_like_code) == [True] * 5 + [False] * 3
    assert apply(spark, ["6 576,000", "12/05/2024", "a@b.tn", "disque", "", None], G.is_protected) == [True, True, True, False, False, False]
    assert apply(spark, ["disque", "12", "d1sque", "x", "BCF04H"], G.is_dictionary_candidate) == [True, False, True, False, False]
    assert apply(spark, ["a", "$$$x", "abc", None], G.is_noise) == [True, True, False, True]


def test_ratios():
    assert S.lcs("abcdef", "acf") == 3 and S.ratio("abc", "abc") == 100.0 and S.ratio("", "") == 100.0
    assert S.token_sort_ratio("b a", "a b") == 100.0
    assert S.partial_ratio("abc", "xxabcxx") == 100.0
    assert S.weighted_ratio("vis acier", "vis laiton longueur 40") == pytest.approx(85.5)
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert S.lcs(a, b) == table[-1][-1]


def test_pair_layers():
    assert S.pair_score("A1", "x", "A1", "y") == (1.0, 1)
    assert S.pair_score("NKX25", "", "NKX2528Z", "") == (0.85, 2)
    assert S.pair_score("", "vis acier", "", "vis laiton longueur 40") == (0.75, 3)
    assert S.pair_score("", "", "", "") == (0.0, 0)
    assert S.with_price(0.75, 10, 10.05) == pytest.approx(0.80) and S.with_price(0.75, 0, 10) == 0.75


def test_hungarian_against_brute_force():
    import itertools

    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        n, m = (int(x) for x in r.integers(1, 6, 2))
        cost = r.integers(0, 4, (n, m)).astype(float)
        got, u, v = hungarian(cost)
        small, big = min(n, m), max(n, m)
        best = min(sum((cost if n <= m else cost.T)[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert sum(cost[i, j] for i, j in got) == best and len(got) == small
        # the potentials prove it
        assert (u[:, None] + v[None, :] <= cost + 1e-9).all() and u.sum() + v.sum() == pytest.approx(best) and (v if n <= m else u).max() <= 1e-9


def test_assignment_prefers_document_order_and_aliases():
    lines = [(i, "R1", "vis", 1.0, None) for i in range(3)]
    assert [(a, b) for a, b, _, _ in solve(lines, lines)] == [(0, 0), (1, 1), (2, 2)]
    assert solve([(0, "R1", "aaa", None, None)], [(5, "X9", "bbb", None, "R1")]) == [(0, 5, 1.0, 6)]
    assert solve([], lines) == []
