"""Epsilon grid order join of embeddings: cells on leading principal dimensions, intervals of the sequence, distant blocks skipped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.components import components
from tarn.llm.shared import written

#: Leading principal dimensions that order the vectors and bound blocks.
DIMS = 8
#: Vectors to an interval of the sequence that tasks exchange, and to a block that is compared at once.
INTERVAL, LEAF = 1024, 64


def _vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, vectors in double precision, of length 1) of the vectors that can be compared."""
    rows, got = [], []
    for i, x in enumerate(column.to_pylist()):
        if not x or any(y is None for y in x):
            continue
        v = np.array(x, dtype=np.float64)
        if not np.isfinite(v).all() or not v.any():
            continue
        v = v / np.abs(v).max()  # no square overflows or vanishes
        rows.append(i)
        got.append(v / np.sqrt(v @ v))
    return np.array(rows, dtype=np.int64), got


def _covariance(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each width of vectors the axes of most variance; sums of fixed size are all that is gathered."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            by: dict[int, list] = {}
            for x in b.column(0).to_pylist():
                by.setdefault(len(x) // 8, []).append(np.frombuffer(x))
            for d, vs in by.items():
                m = np.c_[np.stack(vs), np.ones(len(vs))]
                total[d] = total.get(d, 0) + m.T @ m
        for d, m in total.items():
            at = np.arange(len(m), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d, dtype=np.int32)), pa.array(at), pa.array(list(m), pa.list_(pa.float64()))], names=["d", "i", "row"])

    got: dict[int, np.ndarray] = {}
    flat = reps.select("v").mapInArrow(sums, "d int, i int, row array<double>").select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    for d, part in flat.groupby("d"):
        m = np.zeros((d + 1, d + 1))
        m[part["i"], part["j"]] = part["x"]
        n = m[d, d]
        mean = m[d, :d] / n
        values, axes = np.linalg.eigh(m[:d, :d] / n - np.outer(mean, mean))
        got[int(d)] = axes[:, np.argsort(-values)[:DIMS]]
    return got


def _boxes_apart(a: np.ndarray, b: np.ndarray, radius: float) -> bool:
    """Whether no point of one box comes within radius of the other; boxes are (least, greatest) over the leading dimensions."""
    gap = np.maximum(np.maximum(a[0] - b[1], b[0] - a[1]), 0)
    return float(gap @ gap) > radius * radius


def _box(p: np.ndarray) -> np.ndarray:
    return np.stack([p.min(0), p.max(0)])


class _Join:
    """Links between two runs of the sequence, by halving until a run is a block; halves that lie apart are skipped."""

    def __init__(self, va, pa_, vb, pb, least: float, radius: float, same: bool) -> None:
        self.va, self.pa, self.vb, self.pb, self.least, self.radius, self.same = va, pa_, vb, pb, least, radius, same
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def run(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and a0 >= b1:
            return
        if _boxes_apart(_box(self.pa[a0:a1]), _box(self.pb[b0:b1]), self.radius):
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            x, y = np.nonzero(self.va[a0:a1] @ self.vb[b0:b1].T >= self.least)
            x, y = x + a0, y + b0
            if self.same:
                x, y = x[x < y], y[x < y]
            if len(x):
                self.found.append((x, y))
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            self.run(a0, m, b0, b1)
            self.run(m, a1, b0, b1)
        else:
            m = (b0 + b1) // 2
            self.run(a0, a1, b0, m)
            self.run(a0, a1, m, b1)


def _forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of these links enough for the same components."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while (p := up.get(i, i)) != i:
            up[i] = up.get(p, p)
            i = p
        return i

    kept = []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = top(i), top(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def near_duplicates(df: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of equal label whose cosine is ``least`` or more, in double precision.

    Equal vectors of a label are one vector with a weight. The others sort by label and by their cells of width
    sqrt(2 - 2 least) on the leading principal dimensions: cosine c is distance sqrt(2 - 2 c) on the sphere, and no
    projection stretches it. Runs of INTERVAL vectors carry the box that bounds them; two intervals meet in a task only
    if their boxes come within that distance, and there halves are joined in turn while theirs do. So all pairs within the distance are
    compared, and a dense group costs its pairs' products but sends only a spanning forest and sums for each vector.

    Returns, for each row: id_col, n_links, component_id (the smallest id reachable), kept (id_col = component_id).
    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
    of different widths are not compared; repeated rows link with one another as any equal vectors; null ids are kept as
    rows but never name a component; an empty table gives none.
    """
    if not -1 < least <= 1:
        raise ValueError("least lies in (-1, 1]")
    kind, label = dict(df.dtypes)[id_col], F.col(label_col)
    rows = df.select(F.col(id_col).alias("_id"), label.cast("string").alias("_label"), F.col(vector_col).alias("_v"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, vs = _vectors(b.column(2))
            v = [None] * b.num_rows
            for i, x in zip(at.tolist(), vs, strict=True):
                v[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(v, pa.binary())], names=["_id", "_label", "v"])

    ready = rows.mapInArrow(clean, f"_id {kind}, _label string, v binary").withColumn("key", F.when(F.col("_label").isNotNull() & F.col("v").isNotNull(), F.sha2(F.concat(F.encode("_label", "utf-8"), F.lit(b"\0"), F.col("v")), 256)))
    ready = written(ready, "vectors")
    reps = written(ready.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.first("_label").alias("_label"), F.first("v").alias("v")), "distinct")
    edges, sums = _links(reps, least)
    comps = components(edges).withColumnRenamed("node", "key")
    named = ready.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("_id").alias("_least")).join(comps, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = written(named, "named")
    names = written(named.groupBy("component").agg(F.min("_least").alias("component_id")), "names")  # so that the join below can be split
    info = reps.select("key", "weight").join(sums, "key", "left").join(named.join(names, "component").select("key", "component_id"), "key")
    info = written(info.select("key", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "info")
    return ready.select("_id", "key").join(info, "key", "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"), F.coalesce(F.col("_id") == F.coalesce("component_id", "_id"), F.lit(True)).alias("kept")
    )


def _links(reps: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) of a spanning forest of the links, and (key, others): the weights of all vectors linked to each."""
    spark = reps.sparkSession
    axes = spark.sparkContext.broadcast(_covariance(reps))
    radius = float(np.sqrt(max(2 - 2 * least, 0.0))) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.frombuffer(x) for x in b.column(3).to_pylist()]
            p = [x @ axes.value[len(x)] for x in v]
            cell = [[len(x), *np.floor(y / radius).astype(int).tolist()] for x, y in zip(v, p, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.list_(pa.int64())), pa.array([x.tobytes() for x in p], pa.binary())], names=["key", "weight", "_label", "v", "cell", "p"])

    placed = reps.select("key", "weight", "_label", "v").mapInArrow(place, "key string, weight long, _label string, v binary, cell array<long>, p binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one label and width, INTERVAL vectors at most, out of a sorted partition."""
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            p = np.stack([np.frombuffer(h[5]) for h in held])
            box = _box(p)
            ids = "".join(h[0] for h in held)
            values = [pa.array([x], t) for x, t in ((held[0][0], pa.string()), (held[0][2], pa.string()), (len(held[0][3]) // 8, pa.int32()), (box[0].tolist(), pa.list_(pa.float64())), (box[1].tolist(), pa.list_(pa.float64())), (ids, pa.string()), (b"".join(h[3] for h in held), pa.binary()), (p.tobytes(), pa.binary()), (np.array([h[1] for h in held]).tobytes(), pa.binary()))]
            return pa.RecordBatch.from_arrays(values, names=["name", "_label", "d", "lo", "hi", "ids", "vs", "ps", "ws"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) >= INTERVAL or row[2] != held[0][2] or len(row[3]) != len(held[0][3])):
                    yield out()
                    held.clear()
                held.append(row)
        if held:
            yield out()

    kind = "name string, _label string, d int, lo array<double>, hi array<double>, ids string, vs binary, ps binary, ws binary"
    blocks = written(placed.repartitionByRange(parts, "_label", "cell", "key").sortWithinPartitions("_label", "cell", "key").mapInArrow(intervals, kind), "intervals")
    # intervals that overlap in the first dimension's slabs of width radius, then in all dimensions
    slabs = lambda more: F.explode(F.sequence(F.floor(F.col("lo")[0] / radius) - more, F.floor(F.col("hi")[0] / radius) + more))
    a = blocks.select(F.col("name").alias("na"), "_label", "d", F.col("lo").alias("la"), F.col("hi").alias("ha"), slabs(0).alias("slab"))
    b = blocks.select(F.col("name").alias("nb"), "_label", "d", F.col("lo").alias("lb"), F.col("hi").alias("hb"), slabs(1).alias("slab"))
    gap = F.aggregate(F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    pairs = written(a.join(b, ["_label", "d", "slab"]).where(F.col("na") <= F.col("nb")).where(gap <= radius * radius).select("na", "nb").distinct(), "interval-pairs")
    body = ["ids", "vs", "ps", "ws"]
    left = blocks.select(F.col("name").alias("na"), "d", *[F.col(c).alias(f"{c}_a") for c in body])
    right = blocks.select(F.col("name").alias("nb"), *[F.col(c).alias(f"{c}_b") for c in body])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d, same = r["d"], r["na"] == r["nb"]
                side = []
                for s in "ab":
                    v = np.frombuffer(r[f"vs_{s}"]).reshape(-1, d)
                    side.append(([r[f"ids_{s}"][k : k + 64] for k in range(0, 64 * len(v), 64)], v, np.frombuffer(r[f"ps_{s}"]).reshape(len(v), -1), np.frombuffer(r[f"ws_{s}"], dtype=np.int64)))
                (ka, va, pa_, wa), (kb, vb, pb, wb) = side
                j = _Join(va, pa_, vb, pb, least, radius, same)
                j.run(0, len(va), 0, len(vb))
                if not j.found:
                    continue
                x, y = (np.concatenate(z) for z in zip(*j.found, strict=True))
                shift = 0 if same else len(va)
                keys, weights = (ka, wa) if same else (ka + kb, np.r_[wa, wb])
                y = y + shift
                others = np.bincount(x, weights=weights[y], minlength=len(keys)) + np.bincount(y, weights=weights[x], minlength=len(keys))
                at = np.flatnonzero(others)
                tree = _forest(x, y)
                none = [None] * len(tree)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in at] + none, pa.string()), pa.array(others[at].astype(np.int64).tolist() + none, pa.int64()), pa.array([None] * len(at) + [keys[i] for i, _ in tree], pa.string()), pa.array([None] * len(at) + [keys[i] for _, i in tree], pa.string())],
                    names=["key", "others", "a", "b"],
                )

    # a pair of intervals is heavy work on little data: spread by hash, one batch row at a time
    work = written(pairs.join(left, "na").join(right, "nb").repartition(max(parts, 4 * spark.sparkContext.defaultParallelism), "na", "nb").mapInArrow(join, "key string, others long, a string, b string"), "links")
    return work.where("a IS NOT NULL").select("a", "b"), work.where("key IS NOT NULL").groupBy("key").agg(F.sum("others").alias("others"))
