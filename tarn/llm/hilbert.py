"""Shards along a Hilbert curve through several metadata columns, so that files prune on any of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.shared import small, text_or_empty, written

BITS = 4
#: Rows to a range of the global sort.
RANGE_ROWS = 50_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The curve's index of each row of cells (rows, dimensions), by turning the axes back from the highest bit to the lowest."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(on, x[i] if i else x[0], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def bounds(df: DataFrame, column: str, cells: int) -> list:
    """At most ``cells - 1`` values that cut the rows into parts of about equal size by ``column``; a bounded list whatever the rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(column)
    part = F.floor((F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n") / 2) * F.lit(cells) / F.sum("_n").over(Window.partitionBy()))
    rows = counts.select(column, F.least(part, F.lit(cells - 1)).alias("_part")).groupBy("_part").agg(F.min(column).alias("_first")).where("_part > 0").orderBy("_first").collect()
    return [r["_first"] for r in rows]


def quantised(column: Column, cuts: list) -> Column:
    """How many of the cuts lie at or below the value; null is 0."""
    got = F.lit(0)
    for c in cuts:
        got = got + F.coalesce((column >= F.lit(c)).cast("int"), F.lit(0))
    return got


def curve(thin: DataFrame, strings: list[str], numbers: list[str], bits: int = BITS) -> DataFrame:
    """``thin`` with ``_h``, its place on the curve through the quantised columns."""
    cells = 1 << bits
    cols = [quantised(F.col(c), bounds(thin, c, cells)) for c in strings]
    if numbers:
        cuts = thin.agg(*[F.percentile_approx(c, [k / cells for k in range(1, cells)], 10_000).alias(c) for c in numbers]).first()
        cols += [quantised(F.col(c), sorted(set(cuts[c] or []))) for c in numbers]

    dims = len(cols)

    @F.pandas_udf("long")
    def index(x: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for cell in x:
            digits = np.stack([(cell.to_numpy() >> (bits * k)) & (cells - 1) for k in range(dims)], axis=1)
            yield pd.Series(hilbert_index(digits, bits))

    packed = F.lit(0).cast("long")
    for k, c in enumerate(cols):
        packed = packed + F.shiftleft(c.cast("long"), bits * k)
    return thin.withColumn("_h", index(packed))


def hilbert_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", strings: tuple[str, ...] = ("source", "lang"), bits: int = BITS) -> DataFrame:
    """Cut the curve's order into ``shards`` runs of near equal bytes (a text's UTF-8 bytes plus 1).

    Dimensions: the given strings, the size and the id, each cut at 2**bits quantiles of its rows. Rows sort by curve
    index, then id and text checksum; running sums of bytes come from range partitions of about RANGE_ROWS rows and one
    sum for each, so neither a hot source nor a hot cell lands in one task. A row goes to the shard that its middle byte
    falls in: a shard is off the mean by less than its largest row. Equal texts of equal metadata are neighbours.

    Returns, for each row: id_col, size, text_crc32, hilbert, shard, slot (its place in the shard, gapless from 0). Null
    ids, texts and dimensions count as lowest; an empty table gives none; repeated rows stand side by side.
    """
    text = text_or_empty()
    names = {c: f"_s{k}" for k, c in enumerate(strings)}
    thin = written(docs.select(F.col(id_col).alias("_id"), *[F.col(c).cast("string").alias(n) for c, n in names.items()], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "sizes")
    rows = thin.count()
    placed = curve(thin, list(names.values()), ["size", "_id"], bits)
    ranges = max(1, -(-rows // RANGE_ROWS), int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("_h"), F.col("_id").asc_nulls_first(), F.col("text_crc32")]
    sorted_ = written(placed.repartitionByRange(ranges, *order).select("_id", "size", "text_crc32", "_h", F.spark_partition_id().alias("_part")), "curve")
    parts = sorted_.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    back = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.select("_part", F.coalesce(F.sum("_bytes").over(back), F.lit(0)).alias("_before"), F.coalesce(F.sum("_rows").over(back), F.lit(0)).alias("_rows_before"), F.sum("_bytes").over(Window.partitionBy()).alias("_all")), "parts")
    upto = Window.partitionBy("_part").orderBy(*order)
    got = sorted_.join(small(parts, ranges), "_part").withColumns(
        {"_end": F.col("_before") + F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_row": F.col("_rows_before") + F.row_number().over(upto) - 1}
    )
    # exact in longs: bytes * 2 * shards stay far below 2**63
    got = written(got.withColumn("shard", F.expr(f"(({shards}L * (_end * 2 - size)) div (_all * 2))").cast("int")).select("_id", "size", "text_crc32", "_h", "shard", "_row"), "runs")
    first = small(got.groupBy("shard").agg(F.min("_row").alias("_first")), shards)
    return got.join(first, "shard").select(F.col("_id").alias(id_col), "size", "text_crc32", F.col("_h").alias("hilbert"), "shard", (F.col("_row") - F.col("_first")).alias("slot"))
