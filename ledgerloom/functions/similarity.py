"""String similarity in percent, with the public semantics of the usual token ratios, and the Arrow form for columns.

ratio is 200 * LCS / (len a + len b). LCS is found bit-parallel over Python integers. Strings are compared as they come;
callers normalise them first.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

# Thresholds and confidences of the scoring layers.
REF_HIGH, REF_LOW = 90.0, 75.0
DESC_HIGH, DESC_LOW = 80.0, 60.0
EXACT, REF_HIGH_CONF, REF_LOW_CONF, DESC_HIGH_CONF, DESC_LOW_CONF, CONTAINED_CONF = 1.00, 0.85, 0.65, 0.75, 0.55, 0.75
PRICE_BONUS, PRICE_NEAR = 0.05, 0.01


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


@lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _sorted(x: str) -> str:
    return " ".join(sorted(x.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = (f"{both} {only_a}".strip(), f"{both} {only_b}".strip())
    best = ratio(with_a, with_b)
    return max(best, ratio(both, with_a), ratio(both, with_b)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against the windows of the longer one, cut ones at its ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    stretch = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if stretch < 1.5:
        return max(plain, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if stretch <= 8 else 0.6
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


@lru_cache(maxsize=1 << 17)
def fuzz(a: str, b: str) -> float:
    """JN4. For two single words of like length all its parts are the plain ratio, or less."""
    if not a or not b:
        return 0.0
    if " " not in a and " " not in b and 2 * max(len(a), len(b)) < 3 * min(len(a), len(b)):
        return ratio(a, b)
    return max(token_sort_ratio(a, b), weighted_ratio(a, b))


def pair_score(ref_a: str, desc_a: str, ref_b: str, desc_b: str) -> tuple[float, int]:
    """JN2: confidence and layer of two lines by normalised reference and description; the earlier layer wins ties."""
    if ref_a and ref_a == ref_b:
        return EXACT, 1
    best, layer = 0.0, 0
    if ref_a and ref_b:
        f = fuzz(ref_a.lower(), ref_b.lower())
        if f >= REF_LOW:
            best, layer = (REF_HIGH_CONF if f >= REF_HIGH else REF_LOW_CONF), 2
    if desc_a and desc_b:
        f = fuzz(desc_a, desc_b)
        got = DESC_HIGH_CONF if f >= DESC_HIGH else DESC_LOW_CONF if f >= DESC_LOW else 0.0
        if got > best:
            best, layer = got, 3
    short, long_ = sorted((ref_a, ref_b), key=len)
    inside = (
        (ref_a and ref_a.lower() in desc_b.replace(" ", "")) or (ref_b and ref_b.lower() in desc_a.replace(" ", ""))
        or (len(short) >= 4 and short in long_)
    )
    if inside and CONTAINED_CONF > best:
        best, layer = CONTAINED_CONF, 4
    return best, layer


def with_price(confidence: float, price_a: float | None, price_b: float | None) -> float:
    """JN3."""
    if confidence and price_a and price_b and abs(price_a - price_b) / ((price_a + price_b) / 2) <= PRICE_NEAR:
        return min(1.0, confidence + PRICE_BONUS)
    return confidence


def _fuzz(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fuzz(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def _pair_score(ref_a: pd.Series, desc_a: pd.Series, ref_b: pd.Series, desc_b: pd.Series) -> pd.DataFrame:
    got = [pair_score(a or "", b or "", c or "", d or "") for a, b, c, d in zip(ref_a, desc_a, ref_b, desc_b)]
    return pd.DataFrame(got, columns=["confidence", "layer"])


# Made on call: workers import this module without a session.
def fuzz_column(a, b):
    """JN4 over columns; give it distinct pairs."""
    return F.pandas_udf(_fuzz, "double")(a, b)


def ratio_column(a, b):
    """The plain ratio over columns."""
    return F.pandas_udf(_ratio, "double")(a, b)


def pair_score_columns(ref_a, desc_a, ref_b, desc_b):
    """JN2 over columns of normalised values; give it distinct pairs."""
    return F.pandas_udf(_pair_score, "confidence double, layer int")(ref_a, desc_a, ref_b, desc_b)
