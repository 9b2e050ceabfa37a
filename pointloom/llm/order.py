"""Buckets of neighbouring keys, so that order and running sums need no single task.

Bounds are approximate quantiles of the key, a bounded number of them, found in one pass over the key column. Any bounds
give right results; even ones give even buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a bucket that are aimed at, and the number of buckets at most.
ROWS, MOST = 1000, 16_384


def bounds(df: DataFrame, key: str, rows: int = ROWS) -> list[int]:
    """Ascending distinct bounds of the buckets of ``key``; none for a table of a few rows or without keys."""
    n = df.count()
    parts = min(MOST, math.ceil(n / rows))
    if parts < 2:
        return []
    shares = ", ".join(repr(k / parts) for k in range(1, parts))
    found = df.select(F.expr(f"percentile_approx({key}, array({shares}), {max(10_000, 10 * parts)})").alias("q")).first().q
    return sorted(set(found or []))


def bucket(key: Column, at: list[int]) -> Column:
    """How many bounds lie at or below ``key``, in two steps of about the root of their number; 0 for a null."""
    if not at:
        return F.lit(0)
    wide = math.isqrt(len(at) - 1) + 1
    groups = [at[k : k + wide] for k in range(0, len(at), wide)]
    firsts = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    inner = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    major = F.size(F.filter(firsts, lambda b: b <= key))
    own = F.element_at(inner, F.greatest(major, F.lit(1)))
    return F.greatest(F.lit(0), (major - 1) * wide) + F.when(major > 0, F.size(F.filter(own, lambda b: b <= key))).otherwise(0)
