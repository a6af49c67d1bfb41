"""Diagnostics of a bit stream: tables (pos, bit), or numbered blocks of bits where a kernel needs a whole block.

Positions run from 0. Partial blocks at the end are dropped; pattern windows are circular; a test passes when p >= alpha.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.scan import BLOCK, sequenced, with_next
from tarn.session import stored

ALPHA = 0.01
#: Longest-run classes: block length -> (first class, last class) (fixed values).
RUN_CLASSES = {8: (1, 4), 128: (4, 9), 10000: (10, 16)}
#: Probabilities of the longest-run classes (fixed values).
RUN_MODEL = {
    8: (0.2148, 0.3672, 0.2305, 0.1875),
    128: (0.1174, 0.2430, 0.2493, 0.1752, 0.1027, 0.1124),
    10000: (0.0882, 0.2092, 0.2483, 0.1933, 0.1208, 0.0675, 0.0727),
}
#: Probabilities of the linear-complexity classes (fixed values).
COMPLEXITY_MODEL = (0.010417, 0.03125, 0.125, 0.5, 0.25, 0.0625, 0.020833)
#: Expected value and variance of the universal statistic by block length (fixed values).
UNIVERSAL_MODEL = {6: (5.2177052, 2.954), 7: (6.1962507, 3.125), 8: (7.1836656, 3.238), 9: (8.1764248, 3.311), 10: (9.1723243, 3.356), 11: (10.170032, 3.384), 12: (11.168765, 3.401), 13: (12.168070, 3.410), 14: (13.167693, 3.416), 15: (14.167488, 3.419), 16: (15.167379, 3.421)}


def from_bytes(df: DataFrame, column: str = "bytes", key: str | None = None) -> DataFrame:
    """(stream, pos, bit): most significant bit first."""
    hexed = F.hex(F.col(column))
    k = F.explode(F.sequence(F.lit(0), F.length(hexed) * 4 - 1))
    rows = df.where(F.length(hexed) > 0).select((F.col(key) if key else F.lit(0)).alias("stream"), hexed.alias("_h"), k.alias("pos"))
    nibble = F.conv(F.substring(F.col("_h"), F.floor(F.col("pos") / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    return rows.select("stream", F.col("pos").cast("long").alias("pos"), nibble.alias("_n")).select("stream", "pos", F.expr("(_n div cast(pow(2, 3 - pos % 4) as int)) % 2").cast("int").alias("bit"))


def stream_of(df: DataFrame, order: list[str], bit: Column) -> DataFrame:
    """(pos, bit, walk): a table's rows in order as bits, and the walk's place (+1, -1 steps) after each."""
    return sequenced(df.select(*order, bit.cast("int").alias("bit")), order, {"walk": 2 * F.col("bit") - 1}).select("pos", "bit", "walk")


def monobit(bits: DataFrame) -> DataFrame:
    return bits.agg(F.count(F.lit(1)).alias("n"), F.round(F.abs(F.sum(2 * F.col("bit") - 1)) / F.sqrt(F.count(F.lit(1))), 6).alias("statistic"))


def block_frequency(bits: DataFrame, m: int) -> DataFrame:
    share = bits.groupBy(F.floor(F.col("pos") / m).alias("block")).agg(F.count(F.lit(1)).alias("k"), F.avg("bit").alias("pi")).where(F.col("k") == m)
    return share.agg(F.count(F.lit(1)).alias("blocks"), F.round(4 * m * F.sum(F.pow(F.col("pi") - 0.5, 2)), 6).alias("statistic"))


def runs(bits: DataFrame) -> DataFrame:
    """(n, ones, runs, applies): whether the share of ones is within 2 / sqrt(n) of a half."""
    nxt = with_next(bits, {"bit": "_next"})
    got = nxt.agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("ones"), (F.sum(F.when(F.col("_next") != F.col("bit"), 1).otherwise(0)) + 1).alias("runs"))
    return got.withColumn("applies", F.abs(F.col("ones") / F.col("n") - 0.5) < 2 / F.sqrt("n"))


def longest_runs(bits: DataFrame, m: int) -> DataFrame:
    """(class, blocks): blocks of m bits by their longest run of ones, clipped to the classes of that length."""
    lo, hi = RUN_CLASSES[m]
    b = bits.withColumn("block", F.floor(F.col("pos") / m))
    w = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    isles = b.withColumn("isle", F.sum(1 - F.col("bit")).over(w)).groupBy("block", "isle").agg(F.sum("bit").alias("run"), F.count(F.lit(1)).alias("k"))
    longest = isles.groupBy("block").agg(F.max("run").alias("run"), F.sum("k").alias("k")).where(F.col("k") == m)
    return longest.groupBy(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("run"))).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("blocks"))


def cusum(bits: DataFrame, forward: bool = True) -> DataFrame:
    """The largest distance of the walk from where it begins; backward it begins at the end."""
    if forward:
        return bits.agg(F.max(F.abs("walk")).alias("z"))
    end = bits.agg(F.sum(2 * F.col("bit") - 1).alias("_end"))
    return bits.crossJoin(F.broadcast(end)).agg(F.max(F.abs(F.col("_end") - F.col("walk") + 2 * F.col("bit") - 1)).alias("z"))


def excursion_visits(bits: DataFrame, most: int = 4) -> DataFrame:
    """(state, visits, cycles): steps of the walk at each state but 0 within ``most``; an unfinished tail is a cycle too."""
    n = bits.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("walk") == 0).alias("zeros"), F.max_by("walk", "pos").alias("end"))
    cycles = n.select((F.col("zeros") + (F.col("end") != 0).cast("int")).alias("cycles"))
    return bits.where((F.col("walk") != 0) & (F.abs("walk") <= most)).groupBy(F.col("walk").alias("state")).agg(F.count(F.lit(1)).alias("visits")).crossJoin(F.broadcast(cycles))


def excursion_bins(bits: DataFrame, most: int = 4) -> DataFrame:
    """(state, bin, cycles): cycles by how often they visit a state, five and above together."""
    z = sequenced(bits.select("pos", "walk").withColumnRenamed("pos", "_at"), ["_at"], {"_cycle": (F.col("walk") == 0).cast("long")})
    cycle = F.col("_cycle") - (F.col("walk") == 0).cast("long")  # a zero ends its own cycle
    visits = z.select(cycle.alias("cycle"), "walk")
    total = visits.agg((F.max("cycle") + 1).alias("j"))
    per = visits.where((F.col("walk") != 0) & (F.abs("walk") <= most)).groupBy("cycle", F.col("walk").alias("state")).agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("bin"))
    some = per.groupBy("state", "bin").agg(F.count(F.lit(1)).alias("cycles"))
    states = bits.sparkSession.createDataFrame([(s,) for s in range(-most, most + 1) if s], "state long")
    never = states.crossJoin(F.broadcast(total)).join(some.groupBy("state").agg(F.sum("cycles").alias("k")), "state", "left").select("state", F.lit(0).cast("long").alias("bin"), (F.col("j") - F.coalesce("k", F.lit(0))).alias("cycles"))
    return some.select("state", F.col("bin").cast("long").alias("bin"), "cycles").unionByName(never.where("cycles > 0"))


def pattern_counts(bits: DataFrame, m: int) -> DataFrame:
    """(pattern, n): circular overlapping windows of m bits."""
    if m < 1:
        raise ValueError("m is 1 or more")
    n = bits.agg(F.count(F.lit(1)).alias("_n"))
    wrapped = bits.select("pos", "bit").unionByName(bits.where(F.col("pos") < m - 1).crossJoin(F.broadcast(n)).select((F.col("pos") + F.col("_n")).alias("pos"), "bit"))
    home = F.floor(F.col("pos") / BLOCK)
    spread = wrapped.select("pos", "bit").withColumn("_home", home).withColumn("_at", F.explode(F.when((F.col("pos") % BLOCK < m - 1) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))))
    w = Window.partitionBy("_at").orderBy("pos")
    pattern = reduce(lambda a, b: a * 2 + b, [F.col("bit"), *[F.lead("bit", k).over(w) for k in range(1, m)]])
    return spread.withColumn("pattern", pattern).where("_at = _home AND pattern IS NOT NULL").crossJoin(F.broadcast(n)).where("pos < _n").groupBy(F.col("pattern").cast("long").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def psi2(bits: DataFrame, m: int) -> DataFrame:
    return pattern_counts(bits, m).agg(F.round(F.lit(float(2**m)) / F.sum("n") * F.sum(F.col("n") * F.col("n")) - F.sum("n"), 6).alias("psi2"))


def phi(bits: DataFrame, m: int) -> DataFrame:
    c = pattern_counts(bits, m)
    n = c.agg(F.sum("n").alias("_n"))
    return c.crossJoin(F.broadcast(n)).agg(F.round(F.sum(F.col("n") / F.col("_n") * F.log(F.col("n") / F.col("_n"))), 6).alias("phi"))


def universal(bits: DataFrame, width: int, first: int) -> DataFrame:
    """(blocks, fn): mean log2 distance to the last equal block after ``first`` blocks; a pattern not seen yet counts from 0."""
    blocks = bits.groupBy(F.floor(F.col("pos") / width).alias("i")).agg(F.sum(F.col("bit") * F.pow(F.lit(2), F.lit(width - 1) - F.col("pos") % width)).cast("long").alias("pattern"), F.count(F.lit(1)).alias("k")).where(F.col("k") == width)
    at = F.col("i") + 1
    gap = at - F.coalesce(F.lag(at).over(Window.partitionBy("pattern").orderBy("i")), F.lit(0))
    tested = blocks.withColumn("gap", gap).where(F.col("i") >= first)
    return tested.agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg(F.log2("gap")), 6).alias("fn"))


def overlapping_templates(bits: DataFrame, m: int, block: int) -> DataFrame:
    """(bin, blocks): blocks by their windows of m ones, five and above together."""
    b = bits.withColumn("block", F.floor(F.col("pos") / block))
    w = Window.partitionBy("block").orderBy("pos")
    hit = F.when((F.sum("bit").over(w.rowsBetween(-(m - 1), 0)) == m) & (F.row_number().over(w) >= m), 1).otherwise(0)
    per = b.withColumn("hit", hit).groupBy("block").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("k")).where(F.col("k") == block)
    return per.groupBy(F.least("hits", F.lit(5)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("blocks"))


def blocks(bits: DataFrame, size: int) -> DataFrame:
    """(block, bits): whole blocks as text of 0 and 1; a block is of bounded size."""
    g = bits.groupBy(F.floor(F.col("pos") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "bit"))).alias("b"))
    return g.where(F.size("b") == size).select("block", F.array_join(F.transform("b", lambda x: x["bit"].cast("string")), "").alias("bits"))


def gf2_rank(rows: list[int]) -> int:
    """Rank over GF(2) of rows given as integers."""
    pivots: list[int] = []
    for r in rows:
        for p in pivots:
            r = min(r, r ^ p)
        if r:
            pivots.append(r)
            pivots.sort(reverse=True)
    return len(pivots)


def berlekamp_massey(bits: str) -> int:
    """Length of the shortest linear feedback register that gives the bits; polynomials and the history are integers."""
    c = b = 1
    length, m, past = 0, 1, 0
    for i, x in enumerate(bits):
        past = past << 1 | (x == "1")
        # coefficient k of c meets the bit k places back
        if (c & past).bit_count() & 1:
            t = c
            c ^= b << m
            if 2 * length <= i:
                length, b, m = i + 1 - length, t, 1
            else:
                m += 1
        else:
            m += 1
    return length


def _ranks(x: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for b, width in x:
        yield pd.Series([gf2_rank([int(t[i : i + w], 2) for i in range(0, len(t), w)]) for t, w in zip(b, width, strict=True)], dtype="int32")


def _complexities(x: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in x:
        yield b.map(berlekamp_massey).astype("int32")


def rank_of(bits: Column | str, width: Column) -> Column:
    """Rank of blocks of bits read as rows of the given width."""
    return F.pandas_udf(_ranks, "int")(bits, width)


def complexity_of(bits: Column | str) -> Column:
    return F.pandas_udf(_complexities, "int")(bits)


def matrix_ranks(bits: DataFrame, rows: int, columns: int) -> DataFrame:
    """(rank, blocks): full, one less, and the rest (as full - 2)."""
    full = min(rows, columns)
    r = blocks(bits, rows * columns).select(rank_of("bits", F.lit(columns)).alias("r"))
    return r.groupBy(F.greatest("r", F.lit(full - 2)).cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("blocks"))


def rank_probability(rows: int, columns: int, rank: int) -> float:
    """Of a random binary matrix to have that rank."""
    log2 = rank * (rows + columns - rank) - rows * columns
    return 2.0**log2 * math.prod((1 - 2.0 ** (i - rows)) * (1 - 2.0 ** (i - columns)) / (1 - 2.0 ** (i - rank)) for i in range(rank))


def linear_complexities(bits: DataFrame, m: int) -> DataFrame:
    """(class, blocks): blocks of m bits by (-1)^m (L - mean) + 2/9 in seven classes."""
    mean = m / 2 + (9 + (-1) ** (m + 1)) / 36 - (m / 3 + 2 / 9) / 2**m
    t = blocks(bits, m).select(((-1) ** m * (complexity_of("bits") - mean) + 2 / 9).alias("t"))
    k = sum(((F.col("t") > x).cast("long") for x in (-2.5, -1.5, -0.5, 0.5, 1.5, 2.5)), F.lit(0))
    return t.groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("blocks"))


def spectral(bits: DataFrame, most: int | None = None) -> DataFrame:
    """(n, below, threshold): of the largest power of two of bits, transform values of the first half below the threshold.

    The transform goes in two steps, columns and then rows of a nearly square table, so no task holds more than about the
    root of the stream: X[k1 + n1 k2] is the transform over j of w^(j k1) times the transform over i of x[n2 i + j].
    """
    n = bits.count()
    n = min(n, most) if most else n
    total = 1 << (n.bit_length() - 1) if n else 0
    n1 = 1 << ((max(total, 1).bit_length() - 1) // 2)
    n2 = max(total // n1, 1)
    threshold = math.sqrt(math.log(1 / 0.05) * total)

    def columns(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = np.fft.fft(g.sort_values("i")["bit"].to_numpy(dtype=float) * 2 - 1)
        x = x * np.exp(-2j * np.pi * key[0] * np.arange(n1) / total)
        return pd.DataFrame({"k1": np.arange(n1), "j": key[0], "re": x.real, "im": x.imag})

    def rows(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("j")
        x = np.abs(np.fft.fft(g["re"].to_numpy() + 1j * g["im"].to_numpy()))
        k = key[0] + n1 * np.arange(n2)
        return pd.DataFrame({"below": [int((x[k < total // 2] < threshold).sum())]})

    x = bits.where(F.col("pos") < total).select((F.col("pos") % n2).alias("j"), F.floor(F.col("pos") / n2).alias("i"), "bit")
    first = x.groupBy("j").applyInPandas(columns, "k1 long, j long, re double, im double")
    below = first.groupBy("k1").applyInPandas(rows, "below long")
    return below.agg(F.lit(total).cast("long").alias("n"), F.coalesce(F.sum("below"), F.lit(0)).alias("below"), F.lit(round(threshold, 6)).alias("threshold"))


def parity(a: Column, b: Column) -> Column:
    """Parity of the ones that two arrays of words have in common."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x) % 2


def non_overlapping(bits: DataFrame, m: int, block: int, templates: int) -> DataFrame:
    """(template, hits, squares): greedy matches that do not overlap, of the patterns 1..templates of m bits, over all blocks; and the sum of their squares."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text in f["bits"]:
                for t in range(1, templates + 1):
                    rows.append((t, text.count(format(t, f"0{m}b"))))
            yield pd.DataFrame(rows, columns=["template", "hits"])

    got = blocks(bits, block).select("bits").mapInPandas(run, "template long, hits long")
    return got.groupBy("template").agg(F.sum("hits").alias("hits"), F.sum(F.col("hits") * F.col("hits")).alias("squares"))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: a series for small x, a continued fraction for large."""
    if x < 0 or a <= 0:
        return 0.0
    if x == 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-12:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return scale * h


def chi_square(counts: list[int], model: list[float], n: int) -> float:
    return sum((c - n * p) ** 2 / (n * p) for c, p in zip(counts, model, strict=True))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def cusum_p(z: float, n: int) -> float:
    """Two sums of differences of the normal distribution function."""
    if z <= 0 or n <= 0:
        return 1.0
    s, part = math.sqrt(n), lambda a, b, lo, hi: sum(normal_cdf((4 * k + a) * z / s) - normal_cdf((4 * k + b) * z / s) for k in range(math.floor(lo), math.floor(hi) + 1))
    s = math.sqrt(n)
    return 1 - part(1, -1, (-n / z + 1) / 4, (n / z - 1) / 4) + part(3, 1, (-n / z - 3) / 4, (n / z - 1) / 4)


#: Bits from which each longer block of the universal test is used, from 6 on (fixed values).
UNIVERSAL_BITS = (387_840, 904_960, 2_068_480, 4_654_080, 10_342_400, 22_753_280, 49_643_520, 107_560_960, 231_669_760, 496_435_200, 1_059_061_760)
#: Probabilities of 0 to 4 and of more visits of a cycle to the states 1 to 4 (fixed values).
VISIT_MODEL = (
    (0.5, 0.25, 0.125, 0.0625, 0.03125, 0.03125),
    (0.75, 0.0625, 0.046875, 0.03515625, 0.0263671875, 0.0791015625),
    (0.8333333333333334, 0.027777777777777776, 0.023148148148148147, 0.019290123456790122, 0.016075102880658436, 0.08037551435629237),
    (0.875, 0.015625, 0.013671875, 0.011962890625, 0.010467529296875, 0.073272705078125),
)


def params(n: int) -> dict[str, int]:
    """Sizes that suit a stream of n bits."""
    return {
        "block": 128, "pattern": 10, "longest": 10_000 if n >= 750_000 else 128 if n >= 6272 else 8, "rank": 32, "template": 9, "template_block": max(1032, n // 8),
        "templates": 16, "overlap": 9, "overlap_block": 1032, "complexity": 500, "universal": max((6 + i for i, least in enumerate(UNIVERSAL_BITS) if n >= least), default=0),
    }


Row = tuple[str, float, float]


def _value(df: DataFrame, name: str) -> float:
    return float(df.first()[name] or 0)


def _monobit(bits: DataFrame, n: int) -> Row:
    s = _value(bits.agg(F.abs(F.sum(2 * F.col("bit") - 1)).alias("s")), "s") / math.sqrt(n) if n else 0.0
    return "monobit", s, math.erfc(s / math.sqrt(2)) if n else 0.0


def _block_frequency(bits: DataFrame, n: int, m: int) -> Row:
    share = bits.where(F.col("pos") < n // m * m).groupBy(F.floor(F.col("pos") / m)).agg(F.avg("bit").alias("pi"))
    x = 4 * m * _value(share.agg(F.sum(F.pow(F.col("pi") - 0.5, 2)).alias("x")), "x")
    return ("block_frequency", x, gamma_q(n // m / 2, x / 2)) if n >= m else ("block_frequency", 0.0, 0.0)


def _runs(bits: DataFrame, n: int) -> Row:
    r = runs(bits).first()
    if not n or not r["applies"]:
        return "runs", 0.0, 0.0
    pi = r["ones"] / n
    return "runs", float(r["runs"]), math.erfc(abs(r["runs"] - 2 * n * pi * (1 - pi)) / (2 * math.sqrt(2 * n) * pi * (1 - pi)))


def _binned(name: str, got: dict[int, int], labels: list[int], model: list[float], blocks: int, shape: float) -> Row:
    """A chi square of counted classes; no whole block or an impossible class fails."""
    if not blocks or not all(0 < p <= 1 for p in model):
        return name, 0.0, 0.0
    x = chi_square([got.get(c, 0) for c in labels], model, blocks)
    return name, x, gamma_q(shape, x / 2)


def _longest(bits: DataFrame, n: int, m: int) -> Row:
    lo, hi = RUN_CLASSES[m]
    return _binned(f"longest_run_m{m}", {x["class"]: x["blocks"] for x in longest_runs(bits, m).collect()}, list(range(lo, hi + 1)), list(RUN_MODEL[m]), n // m, (hi - lo) / 2)


def _rank(bits: DataFrame, n: int, size: int) -> Row:
    model = [rank_probability(size, size, k) for k in (size, size - 1)]
    got = {x["rank"]: x["blocks"] for x in matrix_ranks(bits, size, size).collect()}
    return _binned("rank", got, [size, size - 1, size - 2], [*model, 1 - sum(model)], n // (size * size), 1.0)


def _spectral(bits: DataFrame) -> Row:
    r = spectral(bits).first()
    if r["n"] < 2:
        return "spectral", 0.0, 0.0
    x = (r["below"] - 0.95 * r["n"] / 2) / math.sqrt(r["n"] * 0.95 * 0.05 / 4)
    return "spectral", x, math.erfc(abs(x) / math.sqrt(2))


def _entropy(bits: DataFrame, n: int, m: int) -> Row:
    part = F.col("n") / n if n else F.lit(0.0)
    a, b = (_value(pattern_counts(bits, k).agg(F.sum(part * F.log(part)).alias("x")), "x") for k in (m, m + 1))
    x = 2 * n * (math.log(2) - (a - b))
    return (f"approx_entropy_m{m}", x, gamma_q(2.0 ** (m - 1), x / 2)) if n else (f"approx_entropy_m{m}", 0.0, 0.0)


def _serial(bits: DataFrame, n: int, m: int) -> list[Row]:
    if m < 3 or not n:
        return [(f"serial_m{m}_{k}", 0.0, 0.0) for k in (1, 2)]
    p2, p1, p0 = (2.0**k / n * _value(pattern_counts(bits, k).agg(F.sum(F.col("n") * F.col("n")).alias("x")), "x") - n for k in (m, m - 1, m - 2))
    one, two = p2 - p1, p2 - 2 * p1 + p0
    return [(f"serial_m{m}_1", one, gamma_q(2.0 ** (m - 2), one / 2)), (f"serial_m{m}_2", two, gamma_q(2.0 ** (m - 3), two / 2))]


def _cusums(bits: DataFrame, n: int) -> list[Row]:
    if not n:
        return [("cumulative_sums", 0.0, 0.0)] * 2
    z = [(k, _value(cusum(bits, k == "fwd"), "z")) for k in ("fwd", "rev")]
    return [(f"cumulative_sums_{k}", x, cusum_p(x, n)) for k, x in z]


def _templates(bits: DataFrame, n: int, m: int, block: int, templates: int) -> list[Row]:
    mean, variance = (block - m + 1) * 2.0**-m, block * (2.0**-m - (2 * m - 1) * 2.0 ** (-2 * m))
    k = n // block
    if not k or block < m or variance <= 0:
        return []
    out = []
    for r in sorted(non_overlapping(bits, m, block, templates).collect(), key=lambda r: r["template"]):
        x = (r["squares"] - 2 * mean * r["hits"] + k * mean * mean) / variance
        out.append((f"non_overlapping_m{m}_t{r['template'] - 1}", x, gamma_q(k / 2, x / 2)))
    return out


def _overlapping(bits: DataFrame, n: int, m: int, block: int) -> Row:
    x = (block - m + 1) * 2.0**-m / 2
    model = [math.exp(-x) * x**i / math.factorial(i) for i in range(5)]
    got = {r["bin"]: r["blocks"] for r in overlapping_templates(bits, m, block).collect()}
    return _binned(f"overlapping_template_m{m}", got, list(range(6)), [*model, 1 - sum(model)], n // block, 2.5)


def _universal(bits: DataFrame, n: int, width: int) -> Row:
    name, first = f"universal_statistical_L{width}", 10 * 2**width
    if width not in UNIVERSAL_MODEL or n // width <= first:
        return name, 0.0, 0.0
    k, phi_ = n // width - first, _value(universal(bits, width, first), "fn")
    mean, variance = UNIVERSAL_MODEL[width]
    c = 0.7 - 0.8 / width + (4 + 32 / width) * k ** (-3 / width) / 15
    return name, phi_, math.erfc(abs(phi_ - mean) / (math.sqrt(2) * c * math.sqrt(variance / k)))


def _complexity(bits: DataFrame, n: int, m: int) -> Row:
    got = {r["class"]: r["blocks"] for r in linear_complexities(bits, m).collect()}
    return _binned(f"linear_complexity_m{m}", got, list(range(7)), list(COMPLEXITY_MODEL), n // m, 3.0)


def _excursions(bits: DataFrame) -> list[Row]:
    bins: dict[int, dict[int, int]] = {}
    for r in excursion_bins(bits).collect():
        bins.setdefault(r["state"], {})[r["bin"]] = r["cycles"]
    cycles = sum(next(iter(bins.values()), {}).values())
    if not cycles:
        return []
    out = [_binned(f"random_excursions_x{s}", bins.get(s, {0: cycles}), list(range(6)), list(VISIT_MODEL[abs(s) - 1]), cycles, 2.5) for s in range(-4, 5) if s]
    visits = {r["state"]: r["visits"] for r in excursion_visits(bits, 9).collect()}
    for s in range(-9, 10):
        if s:
            x = float(abs(visits.get(s, 0) - cycles))
            out.append((f"random_excursions_variant_x{s}", x, math.erfc(x / math.sqrt(2 * cycles * (4 * abs(s) - 2)))))
    return out


def suite(bits: DataFrame, full: bool = False, alpha: float = ALPHA) -> DataFrame:
    """(ord, name, statistic, p, passed): the eleven core diagnostics of a stream (pos, bit, walk), or all of them, in a fixed order.

    Each is a few aggregates of the stored stream; only counts of classes come to the driver. Diagnostics that don't apply
    to a stream of that length fail with p = 0; without a cycle there are no excursions.
    """
    spark = bits.sparkSession
    bits = stored(bits)
    n = bits.count()
    p = params(n)
    first = [_monobit(bits, n), _block_frequency(bits, n, p["block"]), _runs(bits, n), _longest(bits, n, p["longest"]), _rank(bits, n, p["rank"]), _spectral(bits)]
    middle = [*_templates(bits, n, p["template"], p["template_block"], p["templates"]), _overlapping(bits, n, p["overlap"], p["overlap_block"]), _universal(bits, n, p["universal"]), _complexity(bits, n, p["complexity"])] if full else []
    last = [_entropy(bits, n, p["pattern"]), *_serial(bits, n, p["pattern"]), *_cusums(bits, n)]
    rows = [*first, *middle, *last, *(_excursions(bits) if full else [])]
    return spark.createDataFrame([(i, k, float(v), float(q), bool(q >= alpha)) for i, (k, v, q) in enumerate(rows)], "ord int, name string, statistic double, p double, passed boolean")
