"""Timing samples, proportions and benchmark rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def welch(df: DataFrame, kind: Column, value: str, a: str, b: str) -> DataFrame:
    """(t1, t2): Welch's t of two classes, and of their squared distances from their own means; 0 where undefined."""
    x = df.select(kind.alias("k"), F.col(value).alias("x")).where(F.col("k").isin(a, b))
    mean = x.groupBy("k").agg(F.avg("x").alias("mu"))
    both = x.join(F.broadcast(mean), "k").withColumn("d", F.pow(F.col("x") - F.col("mu"), 2))
    side = lambda name, c, i: [f(F.when(F.col("k") == name, F.col(c))).alias(f"{f.__name__}{i}") for f in (F.count, F.avg, F.var_samp)]
    s = both.agg(*[x for i, (n, c) in enumerate(((a, "x"), (b, "x"), (a, "d"), (b, "d"))) for x in side(n, c, i)])

    def t(i: int, j: int) -> Column:
        under = F.col(f"var_samp{i}") / F.col(f"count{i}") + F.col(f"var_samp{j}") / F.col(f"count{j}")
        fine = (F.col(f"count{i}") > 1) & (F.col(f"count{j}") > 1) & (under > 0)
        return F.when(fine, (F.col(f"avg{i}") - F.col(f"avg{j}")) / F.sqrt(F.when(fine, under))).otherwise(F.lit(0.0))

    return s.select(F.round(t(0, 1), 6).alias("t1"), F.round(t(2, 3), 6).alias("t2"))


def leakage(t1: float, t2: float, threshold: float = 4.5) -> tuple[float, float, bool]:
    """(largest t, p, passed)."""
    t = max(abs(t1), abs(t2))
    return t, math.erfc(t / math.sqrt(2)), t < threshold


def proportion_bound(failures: Column, total: Column, alpha: float = 0.01, z: float = 3.0) -> dict[str, Column]:
    """The share, the bounds alpha -+ z sqrt(alpha (1 - alpha) / n) within [0, 1], and whether it lies between them."""
    half = z * F.sqrt(F.lit(alpha * (1 - alpha)) / total)
    low, high, share = F.greatest(F.lit(0.0), alpha - half), F.least(F.lit(1.0), alpha + half), failures / total
    return {"share": F.round(share, 6), "low": F.round(low, 6), "high": F.round(high, 6), "passed": (share >= low) & (share <= high)}


def stable_row(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, least, median, mean, most); the median is the element n div 2 in order, not an average of two.

    It is found by position in a range-partitioned order, so a key with many samples is not gathered.
    """
    from tarn.operators.scan import sequenced

    s = sequenced(df.select(key, F.col(value).alias("_x")).where(F.col("_x").isNotNull()), [key, "_x"])
    g = df.groupBy(key).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("most"))
    first = s.groupBy(key).agg(F.min("pos").alias("_first")).join(g.select(key, "n"), key).select(key, (F.col("_first") + F.floor(F.col("n") / 2)).alias("pos"))
    return g.join(s.join(first, [key, "pos"]).select(key, F.col("_x").alias("median")), key).select(key, "n", "least", "median", "mean", "most")
