"""Mixing sources to target weights, by DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.shared import WORDS, fresh, small, text_or_empty, uniform, written

#: Weights by the source's rank, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3.0
SEED = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST_REPEATS) -> DataFrame:
    """``target`` for each row of (source, source_size): shares of share * all sizes by weight, none above most * its size.

    What a capped source can't take goes to the others by weight until none is above its cap. In the end, a source is
    capped if its cap for each unit of weight is below the level that the rest stands at; so the capped ones are a prefix
    in the order of that ratio, and running sums find how long it is. Sources are ranked by code point, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    ranked = ranked.withColumns({"left": F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("weight").over(after)})
    # the level if this source and all after it are open; the first that is not above its cap there sets it for all
    level = F.col("left") / F.col("open")
    fits = F.when(level * F.col("weight") <= F.col("cap"), level)
    return ranked.withColumn("level", F.first(fits, ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """How often each document is taken so that sources come near their targets.

    Rates are target / source size; a document comes floor(rate) times, and once more with the fraction's probability,
    by a hash of the seed and its id: reruns and lost tasks give the same. Ids that occur twice are drawn alike.

    Returns, for each row: doc_id, source, size (words), source_size, target, rate, copies, taken. A null text has 0
    words and a null source is a source of its own, last in order; an empty table gives none. Sizes are summed within
    partitions before the shuffle, so a source with a third of all rows is one row of each partition; the table of
    sources is broadcast only if its rows are counted to be few.
    """
    thin = written(docs.select("doc_id", "source", n_words(text_or_empty()).alias("size")), "sizes")
    right = rates(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumnRenamed("source", "_source")
    return (
        thin.join(right, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", n_copies(F.col("doc_id"), F.col("rate"), seed))
        .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def rates(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, rate), to be broadcast if its rows are counted to be few."""
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    got = written(targets(sizes, weights, most=most), "targets")
    return small(got.withColumn("rate", rate), got.count())


def n_copies(key: Column, rate: Column, seed: int) -> Column:
    return F.floor(rate) + (uniform(seed, key) < rate - F.floor(rate)).cast("long")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: each row of ``docs``, with all its columns, as often as ``mix`` says.

    A row's copies hang on its source and its id only, so texts stay where they are. An id with two sources is drawn by
    the rate of each; a row whose id is null is drawn as any other row.
    """
    s, rate, k = (fresh(docs, x) for x in ("_source", "_rate", "_copy"))
    sizes = docs.groupBy("source").agg(F.sum(n_words(text_or_empty())).alias("source_size"))
    right = rates(sizes, weights, most).select(F.col("source").alias(s), F.col("rate").alias(rate))
    got = docs.join(right, docs["source"].eqNullSafe(F.col(s))).withColumn(k, n_copies(F.col("doc_id"), F.col(rate), seed).cast("int")).where(F.col(k) > 0)
    return got.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(k))).alias(k)).select(*docs.columns)


SQL = """
WITH thin AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM thin GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM sizes),
summed AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM ranked WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST)),
levels AS (SELECT *, CASE WHEN room / open * weight <= cap THEN room / open END AS fits, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS k FROM summed),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(fits, k) FROM levels WHERE fits IS NOT NULL), 'infinity'::DOUBLE) * weight) AS target FROM levels),
rates AS (SELECT thin.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0 END AS rate
  FROM thin JOIN targets t ON thin.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN CAST(('0x' || substr(md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '␀')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rates
"""
