"""Jaccard metric-space join over word shingles: pivots, Voronoi regions, triangle-inequality windows, exact links.

Jaccard distance is a metric, but almost all pairs of texts share no shingle and so are at distance 1: text pivots alone
split nothing. So the first level's pivots are single shingles {s}: a text is at distance 1 - 1/n from those it holds
and at 1 from all others, and of the equally near ones its region is that of the first in one global order, rare ones
before frequent ones. A neighbour at distance e or less lacks at most n - ceil((1 - e) n) of the text's shingles, so its
own region is among those of the text's first n - ceil((1 - e) n) + 1 shingles: that window is replicated. Within a
region the pivots are texts: distances to them link members directly, members go to the cell of their nearest pivot, and
to every cell whose pivot is at most 2 e farther, and the cells go on in the same way, as long as that lessens the pairs
that are left by half. Where it doesn't, all members are about as far from each other: such a region is dealt into
bands of sizes and blocks, and each two blocks make a cell. Cells are compared inside tasks, and what leaves a task is a
forest: one pair for each two classes that meet, never all pairs. Pairs that are linked through others already need no
distance, so a group of copies costs about one distance for each member.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.components import components
from tarn.llm.shared import bit_filter, drop, path_of, release, small_batches, without, written
from tarn.llm.text import U64, cut, distinct, flat, mix, windows, words

#: Counters that estimate how often shingles occur; they only set the order, so that collisions cost time, never links.
#: One bit more for each doubling of the input's partitions beyond FEW_PARTS.
COUNTER_BITS, MOST_COUNTER_BITS, FEW_PARTS = 22, 24, 512
CHUNK = 1 << 16
#: Regions up to this size are compared inside a task, by sketches: SKETCH counts at least, and a quarter of the set's
#: size or more, so that long sets stay apart. They are folded to a quarter first.
SMALL_REGION, SKETCH = 4096, 512
#: Shingles of the sets that a task holds at once for exact comparisons.
MOST_HELD = 1 << 23


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, distinct shingles, where each row's begin) of runs of texts."""
    data, offsets = flat(column)
    for i, j in cut(offsets):
        h, row = distinct(*windows(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), n))
        yield i, j, h, np.searchsorted(row, np.arange(j - i + 1))


_NONE = np.zeros(0, dtype=np.int64)


def set_ids(h: np.ndarray, at: np.ndarray, clash: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set, 0 for an empty one. Where the first is among ``clash``, the second replaces it."""
    sums = [np.r_[U64(0), np.cumsum(mix(h + U64(s)), dtype=U64)] for s in (1, 2)]
    size = np.diff(at)
    a, b = (np.where(size > 0, mix(s[at[1:]] - s[at[:-1]] + size.astype(U64)), U64(0)).view(np.int64) for s in sums)
    return renamed(a, b, clash), b


def renamed(a: np.ndarray, b: np.ndarray, clash: np.ndarray) -> np.ndarray:
    return np.where(np.isin(a, clash), mix(b.view(U64) + U64(3)).view(np.int64), a) if len(clash) else a


def counter_bits(docs: DataFrame) -> int:
    doublings = np.log2(max(1, docs.rdd.getNumPartitions() / FEW_PARTS))
    return min(COUNTER_BITS + int(np.ceil(doublings)), MOST_COUNTER_BITS)


def _sets_and_counters(docs: DataFrame, n: int, bits: int) -> DataFrame:
    kind = dict(docs.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, dtype=np.uint16)
        out = lambda m, **c: pa.RecordBatch.from_arrays([c.get(f.name, pa.nulls(m, f.type)) for f in schema], schema=schema)
        schema = None
        for b in batches:
            schema = schema or pa.schema([("_id", b.schema.field(0).type), ("n", pa.int64()), ("sid", pa.int64()), ("sid2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
            for i, j, h, at in shingle_sets(b.column(1), n):
                slot = (h >> U64(64 - bits)).astype(np.int64)
                slot, c = np.unique(slot, return_counts=True)
                counters[slot] = np.minimum(counters[slot].astype(np.int64) + c, 65_535)
                a, a2 = set_ids(h, at)
                yield out(j - i, _id=b.column(0)[i:j], n=pa.array(np.diff(at), pa.int64()), sid=pa.array(a), sid2=pa.array(a2))
        if schema:
            parts = counters.reshape(-1, CHUNK)
            some = np.flatnonzero(parts.any(1))
            yield out(len(some), chunk=pa.array(some, pa.int32()), counts=pa.array([zlib.compress(parts[k].astype("<u2").tobytes(), 1) for k in some], pa.binary()))

    return written(docs.mapInArrow(run, f"_id {kind}, n long, sid long, sid2 long, chunk int, counts binary"), "sets")


def _levels(sets: DataFrame, bits: int) -> np.ndarray:
    """For each counter 0, or how many times it doubles what an even spread would give; a table of fixed size."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, dtype=np.uint32)
        for x in group["counts"]:
            total += np.frombuffer(zlib.decompress(x.as_py()), dtype="<u2")
        return pa.table({"chunk": group["chunk"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = sets.where(F.col("chunk").isNotNull()).select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").toArrow()
    parts = dict(zip(rows["chunk"].to_pylist(), rows["counts"], strict=True))
    even = sum(int(np.frombuffer(x.as_py(), dtype=np.uint32).sum(dtype=np.int64)) for x in parts.values()) / (1 << bits)
    floor = even + 6 * np.sqrt(even) + 16
    levels = np.zeros(((1 << bits) // CHUNK, CHUNK), dtype=np.uint8)
    for k, x in parts.items():  # one chunk at a time: the driver holds no more than the counts and the levels
        total = np.frombuffer(x.as_py(), dtype=np.uint32)
        levels[k] = np.minimum(np.where(total > floor, 1 + np.log2(np.maximum(total, 1) / floor), 0), 15)
    return levels.ravel()


def _entries(docs: DataFrame, n: int, clash: np.ndarray, percent: int, levels) -> DataFrame:
    """(s, sid, n): each set in the regions of its window, once for each task that holds the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = levels.value, set()
        shift = U64(64 - (len(table).bit_length() - 1))
        for b in batches:
            for _, _, h, at in shingle_sets(b.column(0), n):
                sid, _ = set_ids(h, at, clash)
                size = np.diff(at)
                level = table[h >> shift]
                key = (level.astype(U64) << U64(60)) | (h >> U64(4))
                picked, owner = [], []
                for r in np.flatnonzero(size).tolist():
                    if (s := int(sid[r])) in seen:
                        continue
                    seen.add(s)
                    p, q = at[r], at[r + 1]
                    m = int(size[r] - -(-percent * size[r] // 100) + 1)
                    order = np.argsort(key[p:q], kind="stable")[:m] if level[p:q].any() else np.arange(m)
                    picked.append(p + order)
                    owner.append(np.full(m, r))
                if picked:
                    at_, of = np.concatenate(picked), np.concatenate(owner)
                    yield pa.RecordBatch.from_arrays([pa.array(h[at_].view(np.int64)), pa.array(sid[of]), pa.array(size[of], pa.int32())], names=["s", "sid", "n"])

    return docs.select("_text").mapInArrow(run, "s long, sid long, n int")


def _regions(entries: DataFrame) -> DataFrame:
    """(s, sid, n, pivot, pn) of the regions with more than one set; the pivot is the least id. Rows stream in order of the region, so none is gathered."""
    kind = "s long, sid long, n int, pivot long, pn int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (s, pivot, pn, sid of the last row, whether the pivot itself was sent)
        for b in batches:
            s, sid, n = (b.column(k).to_numpy() for k in range(3))
            if not len(s):
                continue
            new = np.r_[True, s[1:] != s[:-1]]
            again = np.r_[False, (~new[1:]) & (sid[1:] == sid[:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            pivot, pn = sid[first].copy(), n[first].copy()
            head = 0
            if last and s[0] == last[0]:
                head = int(np.argmax(new[1:]) + 1) if new[1:].any() else len(s)
                pivot[:head], pn[:head] = last[1], last[2]
                again[0] = sid[0] == last[3]
            keep = ~again & (sid != pivot)
            own = np.flatnonzero(new & (np.arange(len(s)) >= head))  # where regions begin that this batch opens
            extra = [last[:3] + last[1:3]] if head and keep[:head].any() and not last[4] else []
            sent = bool(last and last[4]) or bool(keep.any())
            if len(own):
                many = np.add.reduceat(keep, own, dtype=np.int64) > 0
                keep[own[many]] = True
                sent = bool(many[-1])
            at = np.flatnonzero(keep)
            cols = [s[at], sid[at], n[at], pivot[at], pn[at]]
            if extra:
                cols = [np.r_[np.array([e], dtype=c.dtype), c] for e, c in zip(extra[0], cols, strict=True)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["s", "sid", "n", "pivot", "pn"])
            last = (s[-1], pivot[-1], pn[-1], sid[-1], sent)

    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return written(entries.repartition(parts, "s").sortWithinPartitions("s", "sid").mapInArrow(run, kind), "regions")


def _fits(a: str, b: str, percent: int):
    """Two sizes of which a link is not ruled out."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def widths(n: np.ndarray) -> np.ndarray:
    """Counts of the sketches of sets of n shingles: powers of two."""
    return np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(n / 4, 1))).astype(np.int64))


def sketch(h: np.ndarray) -> np.ndarray:
    """How many shingles each class by hash holds, up to 255: differences sum to no more than the shingles that only one of two sets has."""
    width = int(widths(np.array([len(h)]))[0])
    return np.minimum(np.bincount((h >> U64(64 - (width.bit_length() - 1))).astype(np.int64), minlength=width), 255).astype(np.uint8)


def folded(k: np.ndarray, width: int) -> np.ndarray:
    """The sketch of fewer counts."""
    return k if len(k) == width else np.minimum(k.reshape(width, -1).sum(1, dtype=np.int64), 255).astype(np.uint8)


def _sets_of(docs: DataFrame, ids: DataFrame, n: int, clash: np.ndarray, sketches: bool) -> DataFrame:
    """(sid, set) of the sets with these ids: the sorted shingles, or a sketch of them.

    A bit filter drops most others before anything is sent; where more ids are counted than it has bits for, more sets
    are sent, and the join drops them.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bit_filter(ids, "sid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, seen = sent.value, set()
        for b in batches:
            for _, _, h, at in shingle_sets(b.column(0), n):
                sid, _ = set_ids(h, at, clash)
                slots = sid & ((len(filter_) << 6) - 1)
                hit = ((filter_[slots >> 6] >> (slots & 63)) & 1).astype(bool) & (np.diff(at) > 0)
                rows = [r for r in np.flatnonzero(hit).tolist() if not (int(sid[r]) in seen or seen.add(int(sid[r])))]
                sets = [h[at[r] : at[r + 1]] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(sid[rows]), pa.array([(sketch(x) if sketches else x).tobytes() for x in sets], pa.binary())], names=["sid", "set"])

    got = docs.select("_text").mapInArrow(run, "sid long, set binary").join(ids, "sid", "left_semi")
    got = written(got.groupBy("sid").agg(F.first("set").alias("set")), "sketches" if sketches else "shingles")
    sent.destroy()
    return got


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not rule a link out."""
    left, right = sketches.select(F.col("sid").alias("a"), F.col("set").alias("ka")), sketches.select(F.col("sid").alias("b"), F.col("set").alias("kb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))
            x, y = ([np.frombuffer(k, dtype=np.uint8) for k in get(c).to_pylist()] for c in ("ka", "kb"))
            apart = np.zeros(len(x), dtype=np.int64)
            width = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)], dtype=np.int64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                p, q = (np.stack([folded(z[k], w) for k in at.tolist()]).astype(np.int16) for z in (x, y))
                apart[at] = np.abs(p - q).sum(1, dtype=np.int64)
            keep = _near(apart, get("an").to_numpy().astype(np.int64) + get("bn").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([get(c).filter(pa.array(keep)) for c in ("a", "b", "an", "bn")], names=["a", "b", "an", "bn"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "an", "bn", "ka", "kb").mapInArrow(run, "a long, b long, an int, bn int")


def _near(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes together can be linked with so many shingles in only one of them: common >= p / (1 + p) * sizes."""
    return apart * (100 + percent) <= sizes * (100 - percent)


def near(n: np.ndarray, root: np.ndarray, sketches: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later members of other classes than i's that neither sizes nor sketches rule out); members come by size.

    ``root`` names the classes and may change between two steps.
    """
    width = np.array([len(k) for k in sketches])
    most = np.searchsorted(n, n * 100 // percent, "right")  # larger ones can't be linked
    for w in np.unique(width).tolist():
        p, q = np.searchsorted(width, [w, w + 1]).tolist()
        end = int(most[q - 1])
        k = np.stack([folded(x, w) for x in sketches[p:end]])
        rough = k.reshape(len(k), w // 4, 4).sum(2, dtype=np.int16)  # sums differ by no more than their parts
        for i in range(p, q):
            j = np.arange(i + 1, most[i])
            j = j[root[j] != root[i]]
            for table in (rough, k) if len(j) else ():
                j = j[_near(np.abs(table[j - p].astype(np.int16, copy=False) - table[i - p].astype(np.int16, copy=False)).sum(1, dtype=np.int64), n[j] + n[i], percent)]
            if len(j):
                yield i, j


def merged(root: np.ndarray, i: int, j: int) -> None:
    root[root == root[j]] = root[i]


def forest(n: np.ndarray, root: np.ndarray, sketches: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """One pair of members for each two classes that come together if sketches speak true."""
    out = []
    for i, js in near(n, root, sketches, percent):
        for j in js[np.unique(root[js], return_index=True)[1]].tolist():
            out.append((i, j))
            merged(root, i, j)
    return out


def doubtful(n: np.ndarray, root: np.ndarray, sketches: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Members that have others of other classes which sketches don't rule out: sets of members within which all such pairs lie.

    One of more than MOST_HELD shingles is dealt into blocks, and each two blocks make a set.
    """
    group, some = np.arange(len(n)), np.zeros(len(n), dtype=bool)
    for i, js in near(n, root, sketches, percent):
        some[i] = some[js] = True
        group[np.isin(group, group[js])] = group[i]
    out = []
    for g in np.unique(group[some]).tolist():
        at = np.flatnonzero((group == g) & some)
        block = np.cumsum(n[at]) // max(1, MOST_HELD // 2)
        parts = [at[block == x] for x in np.unique(block)]
        out += [np.r_[x, y] for k, x in enumerate(parts) for y in parts[k + 1 :]] if len(parts) > 1 else parts
    return out


def settled(n: np.ndarray, root: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Linked pairs, by their whole sets: one for each two classes that come together."""
    out = []
    for i, js in near(n, root, [sketch(x) for x in sets], percent):
        for j in js.tolist():
            if root[j] != root[i] and 100 * (c := overlap(sets[i], sets[j])) >= percent * int(n[i] + n[j] - c):
                out.append((i, j))
                merged(root, i, j)
    return out


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two sorted sets have in common."""
    if not len(x) or not len(y):
        return 0
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def _by_cell(rows: DataFrame, work, kind: str) -> DataFrame:
    """``work(cell, sid, n, comp, bodies)`` for the rows (cell, sid, n, comp, set) of each cell, members by size, sent out as it comes.

    Rows stream by cell; a cell is held as a whole, its size is bounded by SMALL_REGION or MOST_HELD.
    """
    names = [x.split()[0] for x in kind.split(", ")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def done(cell, sid, n, comp, bodies) -> pa.RecordBatch:
        order = np.lexsort((sid, n))
        got = work(cell, sid[order], n[order].astype(np.int64), np.unique(comp[order], return_inverse=True)[1], [bodies[k] for k in order.tolist()])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cell, sid, n, comp = (b.column(c).to_numpy() for c in range(4))
            bodies = b.column(4).to_pylist()
            begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
            for p, q in zip(begin, np.r_[begin[1:], len(cell)], strict=True) if len(cell) else []:
                part = (cell[p], sid[p:q], n[p:q], comp[p:q], bodies[p:q])
                if held and held[0] == part[0]:
                    held = (held[0], *[np.r_[x, y] for x, y in zip(held[1:4], part[1:4], strict=True)], held[4] + part[4])
                else:
                    if held:
                        yield done(*held)
                    held = part
        if held:
            yield done(*held)

    rows = rows.select("cell", "sid", "n", "comp", "set").repartition(parts, "cell").sortWithinPartitions("cell")
    return rows.mapInArrow(run, kind)


def _ordered(sid: np.ndarray, n: np.ndarray, pairs: list[tuple[int, int]]) -> list[np.ndarray]:
    """a, b, an, bn of pairs of places, the lesser id first."""
    i, j = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    swap = sid[i] > sid[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    return [sid[a], sid[b], n[a].astype(np.int32), n[b].astype(np.int32)]


def _forest(cells: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(cell, a, b, an, bn): of each cell, fewer pairs than it has members."""

    def work(cell, sid, n, comp, bodies):
        pairs = forest(n, comp, [np.frombuffer(x, dtype=np.uint8) for x in bodies], percent)
        return [np.full(len(pairs), cell), *_ordered(sid, n, pairs)]

    return _by_cell(cells.join(sketches, "sid"), work, "cell long, a long, b long, an int, bn int")


def _doubtful(cells: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(cell, sid, n, comp): members that sketches can't tell apart, in cells of their own; equal ones are one."""

    def work(cell, sid, n, comp, bodies):
        groups = doubtful(n, comp, [np.frombuffer(x, dtype=np.uint8) for x in bodies], percent)
        at = np.concatenate(groups) if groups else np.zeros(0, dtype=np.int64)
        names = [mix(np.array([mix(sid[g].view(U64)).sum(dtype=U64)])) for g in groups]
        cell = np.repeat(np.concatenate(names), [len(g) for g in groups]).view(np.int64) if groups else at
        return [cell, sid[at], n[at].astype(np.int32)]

    return _by_cell(cells.join(sketches, "sid"), work, "cell long, sid long, n int").distinct()


def _settled(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of linked sets of different classes: fewer than a group has members."""

    def work(cell, sid, n, comp, bodies):
        return _ordered(sid, n, settled(n, comp, [np.frombuffer(x, dtype=U64) for x in bodies], percent))[:2]

    return _by_cell(groups.join(sets, "sid"), work, "a long, b long").distinct()


def _overlaps(pairs: DataFrame, docs: DataFrame, n: int, clash: np.ndarray) -> DataFrame:
    """(a, b, an, bn, common) of distinct pairs; the texts are read once more for the sets of these pairs only."""
    sets = _sets_of(docs, pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct(), n, clash, sketches=False)
    left, right = sets.select(F.col("sid").alias("a"), F.col("set").alias("sa")), sets.select(F.col("sid").alias("b"), F.col("set").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))
            common = [overlap(np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)) for x, y in zip(get("sa").to_pylist(), get("sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([get("a"), get("b"), get("an"), get("bn"), pa.array(common, pa.int32())], names=["a", "b", "an", "bn", "common"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "an", "bn", "sa", "sb")
    got = written(joined.mapInArrow(run, "a long, b long, an int, bn int, common int"), "overlaps")
    drop(docs.sparkSession, path_of(sets))
    release(docs.sparkSession)
    return got


def _distance():
    return 1.0 - F.col("common") / (F.col("an") + F.col("bn") - F.col("common"))


def similar_sets(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of texts whose sets of ``n``-word shingles are linked: 100 * common >= percent * union, over any chain.

    Words are lowered (A-Z); a text of fewer than n words is one shingle; one without words is linked with nothing, not
    even with its like. Texts with equal sets count as one set, so no pair of copies is ever formed; links between
    different sets are found without loss, though not each is computed: pairs already in one class are skipped.

    Returns, for each row: id_col, n_shingles, component_id (the smallest id of the class; null ids don't count). A null
    text is an empty one; repeated rows are copies; an empty table gives none; other columns are not looked at.
    """
    with small_batches(docs.sparkSession):
        return _similar_sets(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), n, percent, id_col)


def _similar_sets(thin: DataFrame, n: int, percent: int, id_col: str) -> DataFrame:
    bits = counter_bits(thin)
    sets = _sets_and_counters(thin, n, bits)
    rows = sets.where(F.col("chunk").isNull()).select("_id", "n", "sid", "sid2")
    gathered = lambda: written(rows.where("n > 0").groupBy("sid").agg(F.min("_id").alias("_least"), F.min("sid2").alias("_lo"), F.max("sid2").alias("_hi")), "classes")
    classes = gathered()
    # different sets with one id: fewer than ten are to be expected of 10**10 sets; they take their second digest
    clash = classes.where("_lo <> _hi").select("sid").toArrow()["sid"].to_numpy()
    if len(clash):
        rows = written(_renamed(rows, clash), "renamed")
        classes = gathered()
    comps = _links(thin, sets, n, percent, clash, bits)
    # the least id of each class's rows, then of each component's classes
    least = written(classes.join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("component", "sid").alias("comp"), "_least"), "members")
    ids = written(least.groupBy("comp").agg(F.min("_least").alias("component_id")), "names")  # so that the join below can be split
    known = written(least.join(ids, "comp").select("sid", "component_id"), "ids")
    return rows.join(known, "sid", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns as they are, without those that have a smaller id in their class.

    Rows that repeat an id stay together, and rows without an id stay: nothing tells them apart.
    """
    classes = similar_sets(docs, n, percent)
    return without(docs, classes.where("doc_id <> component_id"))


def _renamed(rows: DataFrame, clash: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, other = (b.column(k).to_numpy() for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(renamed(a, other, clash)), b.column(3)], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _links(thin: DataFrame, sets: DataFrame, n: int, percent: int, clash: np.ndarray, bits: int) -> DataFrame:
    """(node, component) of linked sets, from enough links that their chains are those of all."""
    spark = thin.sparkSession
    levels = spark.sparkContext.broadcast(_levels(sets, bits))
    regions = _regions(_entries(thin, n, clash, percent, levels))
    levels.destroy()
    pair = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("xn")).otherwise(F.col("yn")).alias("an"), F.when(F.col("x") < F.col("y"), F.col("yn")).otherwise(F.col("xn")).alias("bn")).distinct()
    stars = pair(regions.where(F.col("sid") != F.col("pivot")).where(_fits("n", "pn", percent)).select(F.col("sid").alias("x"), F.col("pivot").alias("y"), F.col("n").alias("xn"), F.col("pn").alias("yn")))
    stars = written(stars, "stars")
    release(spark)
    sketches = _sets_of(thin, regions.select("sid").distinct(), n, clash, sketches=True)
    done = [_overlaps(written(_alike(stars, sketches, percent), "stars"), thin, n, clash)]
    more: list[DataFrame] = []
    linked = lambda: reduce(DataFrame.unionByName, [reduce(DataFrame.unionByName, done).where(F.col("common") * 100 >= (F.col("an") + F.col("bn") - F.col("common")) * percent).select("a", "b"), *more])
    known: dict[int, DataFrame] = {}

    def comps() -> DataFrame:
        k = len(done) + len(more)
        if k not in known:
            known[k] = components(linked())
        return known[k].withColumnRenamed("node", "sid")

    cells, small = regions.select(F.col("s").alias("cell"), "sid", "n"), []
    for depth in count():
        cells = _open(cells, comps())
        small.append(cells.where(F.col("size") <= SMALL_REGION).select("cell", "sid", "n"))
        many = cells.where(F.col("size") > SMALL_REGION)
        if not many.limit(1).count():
            break
        # pivots: the first and last by two hashes, found by aggregation, not by sorting the cell
        rank = lambda k: F.struct(F.xxhash64(F.lit(k), "sid").alias("h"), "sid", "n")
        pivots = many.groupBy("cell").agg(*[f(rank(k)).alias(f"p{i}") for i, (f, k) in enumerate(((F.min, depth), (F.max, depth), (F.min, -1 - depth), (F.max, -1 - depth)))])
        pivots = written(pivots.select("cell", F.explode(F.array_distinct(F.transform(F.array("p0", "p1", "p2", "p3"), lambda p: F.struct(p["sid"].alias("y"), p["n"].alias("yn"))))).alias("p")).select("cell", "p.*"), "pivots")
        against = written(many.select("cell", F.col("sid").alias("x"), F.col("n").alias("xn")).join(pivots, "cell").where(F.col("x") != F.col("y")), "against")
        new = pair(against.select("x", "y", "xn", "yn")).join(reduce(DataFrame.unionByName, done).select("a", "b"), ["a", "b"], "left_anti")
        done.append(_overlaps(written(new, "pairs"), thin, n, clash))
        cells, dense = _cells(many, against, pivots, reduce(DataFrame.unionByName, done), percent)
        small.append(_blocks(dense, percent))
    if len(small) > 1:
        cells = _open(reduce(DataFrame.unionByName, small), comps())
    pairs = written(_forest(cells, sketches, percent), "pairs")
    if pairs.limit(1).count():
        done.append(_overlaps(written(pairs.select("a", "b", "an", "bn").distinct(), "pairs"), thin, n, clash))
        cells = _open(cells.select("cell", "sid", "n").join(pairs.select("cell").distinct(), "cell", "left_semi"), comps())
        # what sketches joined but sets don't may hide links between other members of the same classes
        groups = written(_doubtful(cells, sketches, percent), "doubtful")
        if groups.limit(1).count():
            groups = groups.join(comps(), "sid", "left").select("cell", "sid", "n", F.coalesce("component", "sid").alias("comp"))
            more.append(written(_settled(groups, _sets_of(thin, groups.select("sid").distinct(), n, clash, sketches=False), percent), "settled"))
    return comps().withColumnRenamed("sid", "node")


def _open(cells: DataFrame, comps: DataFrame) -> DataFrame:
    """(cell, sid, n, comp, size) of the cells that hold sets of several components; of cells with equal members, one."""
    placed = written(cells.join(comps, "sid", "left").select("cell", "sid", "n", F.coalesce("component", "sid").alias("comp")), "placed")
    digest = placed.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("sid")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("d2")).where("lo <> hi")
    kept = written(digest.groupBy("size", "d1", "d2").agg(F.min("cell").alias("cell")).select("cell", "size"), "open")
    return written(placed.join(kept, "cell"), "cells")


def _cells(many: DataFrame, against: DataFrame, pivots: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The members of large regions in the cells of their pivots, of the nearest, and of those up to twice the radius farther; and the members of regions that this does not open.

    A region is opened if the squares of its cells' sizes sum to half of its own or less: so each round halves what is left.
    """
    radius = 1 - percent / 100
    pairs = against.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    dist = written(pairs.join(known.withColumn("d", _distance()).select("a", "b", "d"), ["a", "b"]).select("cell", "x", "y", "xn", "d"), "distances")
    nearest = dist.groupBy("cell", "x").agg(F.min("d").alias("least"))
    own = pivots.select("cell", F.col("y").alias("x"))
    placed = dist.join(nearest, ["cell", "x"]).where(F.col("d") <= F.col("least") + 2 * radius + 1e-9).join(own, ["cell", "x"], "left_anti")
    placed = written(placed.select("cell", "y", F.col("x").alias("sid"), F.col("xn").alias("n")), "cells")
    sizes = placed.groupBy("cell", "y").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("cell").agg(F.sum(F.col("k") * F.col("k")).alias("left"))
    whole = many.groupBy("cell").agg(F.first("size").cast("double").alias("size"))
    fine = written(whole.join(sizes, "cell", "left").select("cell", (F.coalesce("left", F.lit(0.0)) * 2 <= F.col("size") * F.col("size")).alias("fine")), "fine")
    opened = placed.join(fine.where("fine"), "cell").select(F.xxhash64("cell", "y").alias("cell"), "sid", "n")
    return opened, many.select("cell", "sid", "n").join(fine.where("not fine"), "cell").select("cell", "sid", "n")


def _blocks(dense: DataFrame, percent: int) -> DataFrame:
    """(cell, sid, n): regions whose members lie too close for pivots, dealt so that any two that can be linked meet in a cell of bounded size.

    Linked sizes lie in one band or in two that follow each other. A band with too many members is dealt into blocks of
    half of SMALL_REGION, and each two blocks make a cell; so a member comes once for each block of its band.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * (1 + 1e-9)))
    banded = written(dense.select(F.explode(F.array(F.xxhash64("cell", band), F.xxhash64("cell", band - 1))).alias("cell"), "sid", "n"), "bands")
    blocks = banded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * 2 / SMALL_REGION).cast("int").alias("blocks")).withColumn("blocks", F.when(F.col("blocks") > 2, F.col("blocks")).otherwise(1))
    own = F.pmod(F.xxhash64(F.lit(7), "sid"), "blocks")
    dealt = banded.join(written(blocks, "blocks"), "cell").select("cell", "sid", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return written(dealt.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "sid", "n"), "dealt")
