"""Counts, bands, samples and short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.scan import sequenced


def tally(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    return df.groupBy(F.coalesce(label, F.lit("undeclared")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def band_of(rank: Column, total: Column) -> Column:
    """Quarters of a ranking, the larger ones first; a quarter is (n + 3) div 4, so the last may be short."""
    quarter = F.floor((total + 3) / 4)
    return F.when(rank < quarter, "huge").when(rank < 2 * quarter, "big").when(rank < 3 * quarter, "mid").otherwise("small")


def size_bands(df: DataFrame, key: str, size: str) -> DataFrame:
    """(key, size, rank, band, share): ranked by size from the largest, ties by key; share of the largest size."""
    bounds = df.agg(F.count(F.lit(1)).alias("_total"), F.max(size).alias("_most"))
    ranked = sequenced(df.select(key, size, (-F.col(size)).alias("_down")), ["_down", key])
    return ranked.crossJoin(F.broadcast(bounds)).select(key, size, F.col("pos").alias("rank"), band_of(F.col("pos"), F.col("_total")).alias("band"), F.round(F.col(size) / F.col("_most"), 6).alias("share"))


def health_of(average: Column) -> Column:
    return F.when(average <= 12, "ok").when(average <= 25, "alright").when(average <= 45, "poor").otherwise("critical")


def inner_bucket(lines: Column) -> Column:
    """0..5 for 1-2, 3-5, 6-10, 11-20, 21-40 and more lines."""
    return F.when(lines <= 2, 0).when(lines <= 5, 1).when(lines <= 10, 2).when(lines <= 20, 3).when(lines <= 40, 4).otherwise(5)


def coverage_buckets(items: DataFrame, hits: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(hits, n): items by how many rows of ``hits`` name them, ``most`` and above together; items without any count too."""
    n = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return items.select(key).join(n, key, "left").groupBy(F.least(F.coalesce("_n", F.lit(0)), F.lit(most)).alias("hits")).agg(F.count(F.lit(1)).alias("n"))


def scope_totals(df: DataFrame, scope: str, measure: str) -> DataFrame:
    """Totals for each scope and for all rows together (scope ``all``)."""
    expanded = df.select(F.explode(F.array(F.coalesce(F.col(scope), F.lit("undeclared")), F.lit("all"))).alias("scope"), F.col(measure).alias("_m"))
    return expanded.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("_m"), 4).alias("total"), F.round(F.avg("_m"), 6).alias("average"))


def even_sample(df: DataFrame, order: list[str], want: int) -> DataFrame:
    """All rows of a short history; of a long one the first, the last, and those where floor(pos * want / n) changes."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    at = F.floor(F.col("pos") * want / F.col("_n"))
    before = F.floor((F.col("pos") - 1) * want / F.col("_n"))
    kept = (F.col("_n") <= want) | (F.col("pos") == 0) | (F.col("pos") == F.col("_n") - 1) | (at != before)
    return sequenced(df, order).crossJoin(F.broadcast(n)).where(kept).drop("_n")


def first_n(df: DataFrame, key: str, order: list[str], n: int = 8) -> DataFrame:
    """The first n rows of each key, and how many it has in all."""
    ranked = df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n)
    return ranked.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("total")), key)


def top(df: DataFrame, order: list[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows by a total order, and the count of all rows as one row."""
    return df.orderBy(*order).limit(n), df.agg(F.count(F.lit(1)).alias("total"))


def idf(items: DataFrame, key: str, term: str) -> DataFrame:
    """(term, df, weight): ln((N + 1) / (df + 1)) + 1 with N items that have terms."""
    pairs = items.select(key, F.col(term).alias("term")).distinct()
    n = pairs.agg(F.count_distinct(key).alias("_n"))
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((F.col("_n") + 1) / (F.col("df") + 1)) + 1, 6).alias("weight"))


def normalised(array: Column) -> Column:
    """Tags trimmed, lower-case, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(array, lambda x: F.lower(F.trim(x)))))


def likeness(a: Column, b: Column) -> Column:
    """Of two bags (maps of counts): sum of the lesser over sum of the greater counts; null when both are empty."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("lo"), F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("hi"))))
    total = lambda f: F.aggregate(both, F.lit(0).cast("long"), lambda s, x: s + x[f])
    return F.when(total("hi") > 0, total("lo") / total("hi"))
