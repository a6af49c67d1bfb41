"""Positions, running sums and neighbours over one global order, without a window over all rows.

Rows are range-partitioned by the order; each partition sums itself, the sums of whole partitions are added up (one row
for each), and a window inside a partition does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.session import stored

#: Positions to a window where neighbours are looked up.
BLOCK = 1 << 16


def sequenced(df: DataFrame, order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``pos`` (0-based) and, for each of ``sums``, the running total up to and including the row.

    The order must be total; rows with equal keys come in no particular order. Nulls come first.
    """
    sums = sums or {}
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()})
    rows = stored(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(totals), "_part").withColumns({"pos": F.col("_from") + F.row_number().over(inside) - 1} | {k: F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(upto) for k in sums})
    return out.select(*df.columns, "pos", *sums)


def with_next(df: DataFrame, columns: dict[str, str], ahead: int = 1, block: int = BLOCK) -> DataFrame:
    """``df`` (with ``pos``) and the values of the row ``ahead`` later, null after the last: {source: new name}.

    Rows are dealt by block of positions; the first rows of a block also go to the block before, so that no
    neighbour is missed.
    """
    if not 0 < ahead <= block:
        raise ValueError("ahead lies in 1..block")
    home = F.floor(F.col("pos") / block)
    copies = df.withColumn("_home", home).withColumn("_at", F.explode(F.when((F.col("pos") % block < ahead) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))))
    w = Window.partitionBy("_at").orderBy("pos")
    return copies.withColumns({new: F.lead(old, ahead).over(w) for old, new in columns.items()}).where("_at = _home").drop("_home", "_at")
