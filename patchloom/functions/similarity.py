"""String similarity as Arrow UDFs; Spark has no built-in for it."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: two executables above it are the same one.
SIMILARITY_THRESHOLD = 0.65


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_score(a: str | None, b: str | None, weight: float = 0.1, least: float = 0.7) -> float | None:
    """Jaro similarity raised by a shared prefix of up to four letters when it exceeds ``least``."""
    if a is None or b is None:
        return None
    score = jaro(a, b)
    if score <= least:
        return score
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return score + prefix * weight * (1 - score)


def _score_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict = {}
    return pd.Series([memo[k] if (k := (x, y)) in memo else memo.setdefault(k, jaro_winkler_score(x, y)) for x, y in zip(a, b, strict=True)], dtype=float)


def jaro_winkler(a, b) -> Column:
    """Arrow UDF; made on use, since a module is also imported where no session exists."""
    return F.pandas_udf(_score_batch, "double")(a, b)


def line_distance(a: Column, b: Column, most: Column) -> Column:
    """(most - |a - b|) / most; null without a position."""
    return F.when(a.isNotNull() & b.isNotNull() & (most > 0), (most - F.abs(a - b)) / most)


def overall(signature: Column, body: Column, line: Column) -> Column:
    """Weighted mean of the three similarities; a null line similarity drops out with its weight."""
    # fixed values: the weights 1.25, 1.0 and 0.75
    known = F.when(line.isNull(), 0.0).otherwise(0.75)
    return (1.25 * signature + 1.0 * body + known * F.coalesce(line, F.lit(0.0))) / (2.25 + known)
