"""Tables in the folder that driver and executors share, and joins that survive a hot key."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a table that may be broadcast: of a few columns of numbers, some tens of MB at most.
BROADCAST_ROWS = 200_000
#: Bytes of a written table, as Spark holds it in memory, that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Words of a bit filter, at least and at most.
FILTER_WORDS, MOST_FILTER_WORDS = 1 << 20, 1 << 22
#: Spark's pattern of a word.
WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset on one machine, as in tests, a temporary folder."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tarn-")
        spark.conf.set("spark.checkpoint.dir", got)
        _delete_at_exit(spark, got)
    return got.rstrip("/")


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what is done now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage, survives lost executors and is computed once.

    It goes when the driver ends (``deleteOnExit``).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._tarn_path = path
    return got


def path_of(df: DataFrame) -> str:
    """The folder of a table that ``written`` returned."""
    return df._tarn_path


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the counted rows are within the bound; beyond it Spark shuffles, and splits skewed partitions."""
    return F.broadcast(df) if rows <= bound else df


@contextmanager
def small_batches(spark: SparkSession, size: str = "16m") -> Iterator[None]:
    """Arrow batches of this many bytes at most for what is computed inside: a task holds a few of them, in Spark and in Python, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def weight(df: DataFrame) -> int:
    """About the bytes that a table's rows take in memory: eight for each number and word of a row, and what strings and arrays hold."""

    def of(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.aggregate(F.transform(column, lambda x: of(x, kind.elementType)), F.lit(24).cast("long"), lambda a, x: a + x), F.lit(8)).cast("long")
        if isinstance(kind, T.StructType):
            return sum((of(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
        return F.lit(8)

    return df.agg(F.sum(sum((of(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(24)).cast("long"))).first()[0] or 0


def within_bytes(df: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the weighed table is within the bound; beyond it Spark shuffles, and splits skewed partitions."""
    return F.broadcast(df) if weight(df) <= bound else df


def bit_filter(ids: DataFrame, key: str) -> np.ndarray:
    """A table of 64-bit words with one bit set for each id, by its low bits: 16 bits or more for each counted id, but 2**28 bits at most."""
    n, size = ids.count(), FILTER_WORDS
    while size < MOST_FILTER_WORDS and size * 4 < n:
        size *= 2
    slot = F.col(key).bitwiseAND(F.lit((size << 6) - 1))
    bits = ids.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(size, dtype=np.int64)
    table[bits["w"].to_numpy()] = bits["b"].to_numpy()
    return table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(seed: int, *cols) -> Column:
    """A number in [0, 1) that hangs on the seed and the columns only: 48 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("␀")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose doc_id is not among gone(doc_id); rows without an id stay."""
    name = fresh(docs, "_gone")
    right = gone.select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct()
    return docs.join(right, F.col("doc_id") == F.col(name), "left_anti")
