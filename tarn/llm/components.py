"""Connected components by contraction: every node goes to its least neighbour, chains are shortened, and edges move to the new nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); a component is named by its least node.

    Least neighbours are found by aggregation within partitions first, and joins stand alone between two exchanges, so
    Spark can split a node that has very many edges. Each round at least halves the nodes that are left to join.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["a"]
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = spark.createDataFrame([], f"node {kind}, component {kind}")
    first = True
    while edges.limit(1).count():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("other")).unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("other")))
        parent = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "parents")
        while True:  # chains of parents become one step; each pass shortens them by a factor of four
            jumped = parent.withColumn("was", F.col("component"))
            for _ in range(3):
                up = parent.select(F.col("node").alias("component"), F.col("component").alias("up"))
                jumped = jumped.join(up, "component").select("node", F.col("up").alias("component"), "was")
            jumped = written(jumped, "parents")
            parent = jumped.select("node", "component")
            if not jumped.where("was <> component").limit(1).count():
                break
        old = label.withColumnRenamed("component", "node_").withColumnRenamed("node", "leaf")
        moved = old.join(parent, old["node_"] == parent["node"], "left").select(F.col("leaf").alias("node"), F.coalesce("component", "node_").alias("component"))
        label = parent if first else written(moved, "labels")
        first = False
        a = parent.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = parent.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        half = written(edges.join(a, "a").select(F.col("ca").alias("a"), "b"), "edges")
        whole = half.join(b, "b").select("a", F.col("cb").alias("b")).where("a <> b")
        edges = written(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return label
