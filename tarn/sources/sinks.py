"""Graph tables as text: DOT, Mermaid, a layout tree, JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.tallies import normalised


def _safe(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_]", "_")


def dot(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): a line for each routine and each call, for a text sink; the first and last line make it a document."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
    spark = functions.sparkSession
    part = lambda n, df: df.select(F.lit(n).alias("_part"), "value")
    nodes = functions.select(F.concat(F.lit("  "), quote(F.col("fn_id")), F.lit(" [label="), quote(F.col("name")), F.lit("];")).alias("value"))
    calls = edges.select(F.concat(F.lit("  "), quote(F.col("caller")), F.lit(" -> "), quote(F.col("callee")), F.lit(";")).alias("value"))
    ends = [spark.createDataFrame([(v,)], "value string") for v in ("digraph calls {", "}")]
    return part(0, ends[0]).unionByName(part(1, nodes)).unionByName(part(2, calls)).unionByName(part(3, ends[1])).orderBy("_part", "value").select("value")


def mermaid(functions: DataFrame, edges: DataFrame) -> DataFrame:
    head = functions.sparkSession.createDataFrame([("flowchart TD",)], "value string").select(F.lit(0).alias("_part"), "value")
    nodes = functions.select(F.lit(1).alias("_part"), F.concat(F.lit("  "), _safe(F.col("fn_id")), F.lit("["), F.col("name"), F.lit("]")).alias("value"))
    calls = edges.select(F.lit(2).alias("_part"), F.concat(F.lit("  "), _safe(F.col("caller")), F.lit(" --> "), _safe(F.col("callee"))).alias("value"))
    return head.unionByName(nodes).unionByName(calls).orderBy("_part", "value").select("value")


def layout(functions: DataFrame) -> DataFrame:
    """(value): routines under their module, by line and name."""
    heads = functions.select("module").distinct().select("module", F.lit(-1).cast("long").alias("line_start"), F.lit("").alias("name"), F.col("module").alias("value"))
    rows = functions.select("module", F.col("line_start").cast("long").alias("line_start"), "name", F.concat(F.lit("  "), F.col("name"), F.lit(":"), F.col("line_start").cast("string")).alias("value"))
    return heads.unionByName(rows).orderBy("module", "line_start", "name").select("value")


def graph_rows(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): one JSON document for each routine and edge; tags trimmed, lower-case, each once, in order."""
    f = functions.withColumn("tags", normalised(F.col("tags"))) if "tags" in functions.columns else functions
    return f.select(F.lit("function").alias("kind"), F.to_json(F.struct(*f.columns)).alias("json")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))
