"""Exact removal of repeated passages: suffix arrays over shards of the places where texts may repeat each other.

Any two equal strings of LENGTH bytes hold the same least hash of GRAM bytes at the same offset, so both texts have an
anchor there. Anchors that two different texts share say where to look; their surroundings, equal ones once, go to the
shard of the anchor's hash. Each shard sorts the suffixes of its surroundings by induction and reads from the
permuted common prefixes which strings a text with a smaller id has too. Nothing between anchors is lost: the
surroundings of an anchor cover every string that can hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import drop, path_of, release, small_batches, text_or_empty, written
from tarn.llm.suffixes import joined, permuted_reach, suffix_array
from tarn.llm.text import _BYTE, POWERS, U64, cut, flat, mix

LENGTH, GRAM = 50, 20
#: Texts are scanned in runs of about this many bytes, and a shard's suffixes sorted in lots of about so many.
SCAN_BYTES, LOT_BYTES = 1 << 19, 4_000_000
#: Bytes of different texts for each shard. An anchor that more places share than HOT is dealt out by what stands beside it.
SHARD_BYTES, HOT = 8 << 20, 20_000
_HOT = U64(1 << 63)


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w values."""
    out, span = a, 1
    while span * 2 <= w:
        out = f(out[:-span], out[span:])
        span *= 2
    return f(out[: len(a) - w + 1], out[w - span : len(a) - span + 1]) if span < w else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, row) of the grams that are the least of a window of ``length`` bytes inside one text."""
    n, w = len(data), length - gram + 1
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, np.zeros(0, dtype=U64), none
    up, down = POWERS.upto(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least = np.where(row[: n - length + 1] == row[length - 1 :], _slide(h, w, np.minimum), U64(0))
    padded = np.r_[np.zeros(w - 1, dtype=U64), least, np.zeros(len(h) - len(least), dtype=U64)]
    at = np.flatnonzero(_slide(padded, w, np.maximum) == h)
    return at, h[at], row[at]


def _keys(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of an anchor and its 32-bit code in there; anchors with equal codes are only looked at together."""
    return ((h >> U64(32)) % U64(shards)).astype(np.int64), h.astype(np.uint32)


def _split(of: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(of, kind="stable")
    at = np.searchsorted(of[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, order[at[k] : at[k + 1]]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of runs of equal values, and their lengths."""
    begin = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)
    return x[begin], np.diff(np.r_[begin, len(x)]).astype(np.int32)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def _cat(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *[np.frombuffer(x, dtype=kind) for x in column.to_pylist()]])


def _shared(docs: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """(unit, codes): for each different text with anchors that other texts have too, those anchors. unit is 64 bits of its digest."""
    packed = pa.schema([("shard", pa.int32()), ("units", pa.binary()), ("many", pa.binary()), ("codes", pa.binary())])
    kind = "shard int, units binary, many binary, codes binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            units = b.column(0).to_numpy()
            keep = np.array([not (u in seen or seen.add(u)) for u in units.tolist()], dtype=bool)
            b, units = b.filter(pa.array(keep)), units[keep]
            data, offsets = flat(b.column(1))
            parts = []
            for i, j in cut(offsets, SCAN_BYTES):
                _, h, row = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                parts.append((h, row + i))
            if not parts:
                continue
            h, row = (np.concatenate(x) for x in zip(*parts, strict=True))
            of, code = _keys(h, shards)
            rows = []
            for k, at in _split(of, shards):
                r, many = _runs(row[at])
                rows.append((k, units[r].tobytes(), many.tobytes(), code[at].tobytes()))
            yield _batch(packed, rows)

    def meet(group: pa.Table) -> pa.Table:
        k = group["shard"][0].as_py()
        unit = np.repeat(_cat(group["units"], np.int64), _cat(group["many"], np.int32))
        code = _cat(group["codes"], np.uint32)
        order = np.argsort(code, kind="stable")
        begin = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
        u = unit[order]
        two = np.minimum.reduceat(u, begin) != np.maximum.reduceat(u, begin)
        dup = np.empty(len(code), dtype=bool)
        many = np.diff(np.r_[begin, len(code)])
        dup[order] = np.repeat(two, many)
        hot = np.empty(len(code), dtype=bool)
        hot[order] = np.repeat(many > HOT, many)
        unit, code, hot = unit[dup], code[dup], hot[dup]
        rows = []
        for to, at in _split((unit.view(U64) % U64(shards)).astype(np.int64), shards):
            at = at[np.argsort(unit[at], kind="stable")]
            r, many = _runs(unit[at])
            rows.append((to, r.tobytes(), many.tobytes(), ((np.uint64(k) << U64(32)) | code[at] | np.where(hot[at], _HOT, U64(0))).tobytes()))
        return pa.Table.from_batches([_batch(packed, rows)])

    def back(group: pa.Table) -> pa.Table:
        unit, code = np.repeat(_cat(group["units"], np.int64), _cat(group["many"], np.int32)), _cat(group["codes"], U64)
        order = np.lexsort((code, unit))
        unit, code = unit[order], code[order]
        r, many = _runs(unit)
        at = np.r_[0, np.cumsum(many)]
        return pa.table({"unit": pa.array(r, pa.int64()), "codes": pa.array([np.unique(code[p:q]).tobytes() for p, q in zip(at, at[1:], strict=False)], pa.binary())})

    met = _dealt(docs.select("unit", "_text").mapInArrow(scan, kind), shards).groupBy("shard").applyInArrow(meet, kind)
    return written(_dealt(met, shards).groupBy("shard").applyInArrow(back, "unit long, codes binary"), "shared-anchors")


def _covered(texts: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """(unit, spans) of owners' texts: the bytes, as (start, end) pairs, that strings of texts with smaller ids cover."""
    before, after, side = length - gram, length, (length - gram) // 2
    packed = pa.schema([("shard", pa.int32()), ("code", pa.binary()), ("context", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary()), ("member", pa.binary()), ("unit", pa.binary()), ("owner", pa.binary()), ("start", pa.binary())])
    kind = "shard int, code binary, context binary, sizes binary, bytes binary, member binary, unit binary, owner binary, start binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each shard the different surroundings once, packed, and who has them where."""
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            owner, unit = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offsets = flat(b.column(2))
            asked = [np.frombuffer(x, dtype=U64) for x in b.column(3).to_pylist()]
            parts = []
            for i, j in cut(offsets, SCAN_BYTES):
                at, h, row = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                of, code = _keys(h, shards)
                key = (of.astype(U64) << U64(32)) | code
                first = np.searchsorted(row, np.arange(j - i + 1))
                met = lambda k: np.concatenate([np.zeros(0, dtype=bool), *[_within(k[p:q], asked[i + r]) for r, (p, q) in enumerate(zip(first, first[1:], strict=False))]])
                some = any(len(x) and x[-1] >= _HOT for x in asked[i:j])
                hit, hot = met(key), met(key | _HOT) if some else np.zeros(len(key), dtype=bool)
                h, at, row = h[hit | hot], at[hit | hot] + offsets[i], row[hit | hot] + i
                of, code, hot = of[hit | hot], code[hit | hot], hot[hit | hot]
                lo, hi = np.maximum(at - before, offsets[row]), np.minimum(at + after, offsets[row + 1])
                context = _hashed(data, lo, hi)
                parts.append(tuple(x[~hot] for x in (of, code, row, lo, hi, context)))
                # equal strings reach ``side`` bytes beyond the anchor to the left or to the right, so each side is a key
                for name, a, z in ((1, at - side, at), (2, at + gram, at + gram + side)) if hot.any() else ():
                    k = hot & (a >= offsets[row]) & (z <= offsets[row + 1])
                    of2, code2 = _keys(mix(h[k] ^ _hashed(data, a[k], z[k]) ^ U64(name)), shards)
                    parts.append((of2, code2, row[k], lo[k], hi[k], mix(context[k] + U64(name))))
            if not parts:
                continue
            of, code, row, lo, hi, context = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows = []
            for k, at in _split(of, shards):
                _, one, member = np.unique(context[at], return_index=True, return_inverse=True)
                c = at[one]
                body = b"".join([data[p:q].tobytes() for p, q in zip(lo[c].tolist(), hi[c].tolist(), strict=True)])
                rows.append((k, code[c].tobytes(), context[c].tobytes(), (hi[c] - lo[c]).astype(np.int32).tobytes(), pack.compress(body), member.astype(np.int32).tobytes(), unit[row[at]].tobytes(), owner[row[at]].tobytes(), (lo[at] - offsets[row[at]]).astype(np.int32).tobytes()))
            yield _batch(packed, rows)

    spans = pa.schema([("shard", pa.int32()), ("unit", pa.binary()), ("start", pa.binary()), ("end", pa.binary())])

    def find(group: pa.Table) -> pa.Table:
        code, context, sizes = _cat(group["code"], np.uint32), _cat(group["context"], U64), _cat(group["sizes"], np.int32)
        many = [len(x) // 4 for x in group["sizes"].to_pylist()]
        shift = np.repeat(np.r_[0, np.cumsum(many)[:-1]], [len(x) // 4 for x in group["member"].to_pylist()])
        member, unit, owner, start = _cat(group["member"], np.int32) + shift, _cat(group["unit"], np.int64), _cat(group["owner"], np.int64), _cat(group["start"], np.int32)
        unpack = zstandard.ZstdDecompressor()
        body = np.frombuffer(b"".join(unpack.decompress(x) for x in group["bytes"].to_pylist()), dtype=np.uint8)
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        _, one, klass = np.unique(context, return_index=True, return_inverse=True)
        member = klass[member]  # now of the shard's different surroundings
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, member, owner)
        code, sizes, begin = code[one], sizes[one].astype(np.int64), begin[one]
        masks = _masks(code, sizes, begin, body, least, length)
        out_u, out_s, out_e = [], [], []
        # all of it lies in the text with the smallest id, so the others lose all of it
        whole = (owner > least[member]) & (sizes[member] >= length)
        out_u.append(unit[whole])
        out_s.append(start[whole].astype(np.int64))
        out_e.append(start[whole] + sizes[member[whole]])
        own = np.flatnonzero(~whole & np.isin(member, np.fromiter(masks, dtype=np.int64, count=len(masks))))
        for i in own.tolist():
            for a, z in masks[int(member[i])]:
                out_u.append(unit[i : i + 1])
                out_s.append(np.array([start[i] + a], dtype=np.int64))
                out_e.append(np.array([start[i] + z], dtype=np.int64))
        u, s, e = (np.concatenate(x) for x in (out_u, out_s, out_e))
        rows = [(to, u[at].tobytes(), s[at].astype(np.int32).tobytes(), e[at].astype(np.int32).tobytes()) for to, at in _split((u.view(U64) % U64(shards)).astype(np.int64), shards)]
        return pa.Table.from_batches([_batch(spans, rows)])

    def gather(group: pa.Table) -> pa.Table:
        u, s, e = _cat(group["unit"], np.int64), _cat(group["start"], np.int32), _cat(group["end"], np.int32)
        order = np.lexsort((s, u))
        u, s, e = u[order], s[order], e[order]
        names, many = _runs(u)
        at = np.r_[0, np.cumsum(many)]
        return pa.table({"unit": pa.array(names, pa.int64()), "spans": pa.array([_merged(s[p:q], e[p:q]).tobytes() for p, q in zip(at, at[1:], strict=False)], pa.binary())})

    found = _dealt(texts.mapInArrow(send, kind), shards).groupBy("shard").applyInArrow(find, "shard int, unit binary, start binary, end binary")
    return written(_dealt(found, shards).groupBy("shard").applyInArrow(gather, "unit long, spans binary"), "spans")


def _dealt(df: DataFrame, shards: int) -> DataFrame:
    """Rows by shard in as many partitions as there are shards, so that a task's share does not grow with the input."""
    return df.repartition(min(shards, 1 << 16), "shard")


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _hashed(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes."""
    if not len(lo):
        return np.zeros(0, dtype=U64)
    a, z = int(lo.min()), int(hi.max())
    up, down = POWERS.upto(z - a + 1)
    sums = np.zeros(z - a + 1, dtype=U64)
    np.cumsum(_BYTE[data[a:z]] * up[: z - a], out=sums[1:])
    return mix((sums[hi - a] - sums[lo - a]) * down[lo - a] + (hi - lo).astype(U64))


def _merged(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Disjoint runs, not touching, of stretches in order of their starts; as int32 pairs."""
    reach = np.maximum.accumulate(e)
    new = np.r_[True, s[1:] > reach[:-1]]
    begin = np.flatnonzero(new)
    return np.stack([s[begin], np.maximum.reduceat(e, begin)], axis=1).astype(np.int32)


def _masks(code: np.ndarray, sizes: np.ndarray, begin: np.ndarray, body: np.ndarray, least: np.ndarray, length: int) -> dict[int, list[tuple[int, int]]]:
    """For surroundings that share strings with others of a smaller least id: the stretches that those strings cover.

    Surroundings whose anchor has no others need no look. Those of one anchor stay in one lot.
    """
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
    many = np.diff(np.r_[first, len(order)])
    order = order[np.repeat(many > 1, many)]
    order = order[sizes[order] >= length]
    out: dict[int, list[tuple[int, int]]] = {}
    if not len(order):
        return out
    ends = np.cumsum(sizes[order] + 1)
    edge = np.flatnonzero(np.r_[code[order][1:] != code[order][:-1], True]) + 1  # where a lot may end
    p = 0
    while p < len(order):
        fits = edge[(edge > p) & (ends[edge - 1] - (ends[p - 1] if p else 0) <= LOT_BYTES)]
        q = int(fits[-1]) if len(fits) else int(edge[edge > p][0])
        part = order[p:q]
        text, starts = joined([body[begin[c] : begin[c] + sizes[c]].tobytes() for c in part.tolist()])
        sa = suffix_array(text)
        reach = permuted_reach(text, sa, length)
        of = np.repeat(np.arange(len(part)), sizes[part] + 1)
        of = np.r_[of, 0]
        ids = least[part][of[sa]]
        run = np.flatnonzero(~reach[sa])
        lowest = np.repeat(np.minimum.reduceat(ids, run), np.diff(np.r_[run, len(sa)]))
        same = np.repeat(np.diff(np.r_[run, len(sa)]) > 1, np.diff(np.r_[run, len(sa)]))
        at = np.sort(sa[same & (lowest < ids)])
        if len(at):
            k = of[at]
            s = at - starts[k]
            cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            for a, z in zip(cuts.tolist(), np.r_[cuts[1:], len(k)].tolist(), strict=True):
                out[int(part[k[a]])] = _merged(s[a:z], s[a:z] + length).tolist()
        p = q
    return out


def strip_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte of a text covered by a string of ``length`` bytes that also starts in one with a smaller id.

    Strings are judged on the input. Copies of a whole text, but for the one with the smallest id, lose all of it at once
    and are not looked at again, so a group of copies costs as much as one text.

    Returns, for each row: id_col, n_bytes, n_removed, n_spans, kept_sha256. A null text is an empty one; a null id is
    larger than all others and no smaller than itself; rows of equal id never strip each other, but both lose what a
    smaller id has; an empty table gives none; other columns are not looked at.
    """
    with small_batches(docs.sparkSession):
        return _strip_repeats(docs, length, id_col, text_col)


def _strip_repeats(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    text, last = text_or_empty(text_col), (1 << 63) - 1
    whole = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("place"), text.alias("_text")).withColumn("sha", F.sha2("_text", 256))
    half = lambda k: F.conv(F.substring("sha", k, 8), 16, 10).cast("long")
    named = lambda df, clash: df.withColumn("unit", F.when(F.col("sha").isin(*clash), F.shiftleft(half(17), 32).bitwiseOR(half(25))).otherwise(F.shiftleft(half(1), 32).bitwiseOR(half(9))))
    facts = written(whole.select("_id", "place", "sha", F.octet_length("_text").cast("long").alias("n_bytes")), "rows")
    owners = written(named(facts, [""]).groupBy("sha", "unit").agg(F.min("place").alias("owner"), F.first("n_bytes").alias("_n")), "owners")
    # different texts whose digests begin with the same 64 bits: fewer than ten are to be expected of 10**10; they take the next 64
    twice = owners.groupBy("unit").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("unit")
    clash = [r["sha"] for r in owners.join(twice, "unit", "left_semi").select("sha").collect()]
    if clash:
        owners = written(named(owners, clash), "owners")
    whole, rows = named(whole, clash or [""]), facts.select("_id", "place", "sha", "n_bytes")
    total = owners.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    owners = owners.drop("_n")
    shards = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    shared = _shared(whole, shards, length, min(GRAM, length))
    release(spark)
    wanted = shared.join(owners, "unit").select("owner", "unit", "codes")
    texts = whole.select("place", "unit", "_text").join(wanted.withColumnsRenamed({"unit": "u"}), (F.col("place") == F.col("owner")) & (F.col("unit") == F.col("u"))).select("owner", "unit", "_text", "codes")
    spans = _covered(texts, shards, length, min(GRAM, length))
    drop(spark, path_of(shared))
    release(spark)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            got = []
            for body, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                body, s = body.encode(), np.frombuffer(s, dtype=np.int32).reshape(-1, 2)
                ends = [0, *s[:, 1].tolist()]
                kept = b"".join(body[a:z] for a, z in zip(ends, [*s[:, 0].tolist(), len(body)], strict=True))
                got.append((len(body) - len(kept), len(s), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], names=["unit", "n_removed", "n_spans", "kept"])

    hit = spans.join(owners, "unit").select(F.col("owner"), F.col("unit").alias("u"), "spans")
    cut_texts = whole.select("place", "unit", "_text").join(hit, (F.col("place") == F.col("owner")) & (F.col("unit") == F.col("u"))).select("unit", "_text", "spans")
    stripped = written(cut_texts.mapInArrow(cut_out, "unit long, n_removed long, n_spans long, kept string"), "stripped").dropDuplicates(["unit"])
    release(spark)
    facts = written(owners.join(stripped, "unit", "left"), "facts")
    copy = (F.col("place") > F.col("owner")) & (F.col("n_bytes") >= length)
    nothing = F.lit("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")  # of no bytes
    return rows.join(facts.drop("unit"), "sha").select(
        F.col("_id").alias(id_col), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )

