"""Shapes of routines, near duplicates among them, and families that differ in a few places only."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.code import line_letter
from tarn.operators.similarity import _greedy, jaccard, lcs_ratio, split_words

COUNTS = ("lines", "params", "variables", "loops", "branches", "calls", "assigns", "returns")
#: A family's members agree this much with its first one, number this many at least, and vary in so many counts at most.
AGREEMENT, MEMBERS, VARYING = 0.82, 3, 3
#: Pairs: least closeness of counts, least letters, least score.
CLOSE, LETTERS, SCORE = 0.55, 5, 0.72
#: Weights of closeness, letters and name words, and the least ratio of skeleton lengths with which SCORE can be reached.
NEAR, SHAPE, NAME = 0.5, 0.34, 0.16
LEAST_RATIO = (SCORE - NEAR - NAME) / SHAPE


def shapes(functions: DataFrame, most: int = 160) -> DataFrame:
    """(fn_id, module, decl_kind, name, skeleton, counts): the letters of the code lines, and counts of what they do."""
    letters = F.filter(F.transform("body", line_letter), lambda x: x.isNotNull())
    has = lambda p: F.size(F.filter("body", lambda x: F.trim(x).rlike(p)))
    counts = {
        "lines": F.size(letters), "params": F.size(F.filter("sockets", lambda s: s["direction"] != "out")), "variables": has("^(var|let) "), "loops": has("^(for|while) "),
        "branches": has("^(if|elif|case|of) "), "calls": F.size("calls"), "assigns": has(r"^[\w.\[\]]+ [+*-]?= "), "returns": has("^(return|result)"),
    }
    return functions.select("fn_id", "module", "decl_kind", "name", F.array_join(F.slice(letters, 1, most), "").alias("skeleton"), *[c.cast("double").alias(k) for k, c in counts.items()])


def duplicates(shapes_: DataFrame) -> DataFrame:
    """(a, b, score): half closeness of counts, a third sequence agreement, the rest name words; cheap tests first.

    The agreement is at most the shorter skeleton over the longer one, so a score of SCORE needs a ratio of LEAST_RATIO.
    Pairs meet by bands of skeleton length, twice as long each, as far apart as that ratio allows.
    """
    top = shapes_.agg(*[F.greatest(F.max(c), F.lit(1.0)).alias(f"_{c}") for c in COUNTS])
    x = shapes_.where(F.length("skeleton") >= LETTERS).crossJoin(F.broadcast(top)).withColumn("v", F.array(*[F.col(c) / F.col(f"_{c}") for c in COUNTS]))
    x = x.withColumn("size", F.length("skeleton")).withColumn("band", F.floor(F.log2("size"))).select("fn_id", "skeleton", "size", "v", "band", split_words(F.col("name")).alias("w"))
    a = x.select(*[F.col(c).alias(f"{c}_a") for c in x.columns])
    apart = math.ceil(-math.log2(LEAST_RATIO))
    b = x.withColumn("at", F.explode(F.sequence(F.col("band") - apart, F.col("band") + apart))).select("at", *[F.col(c).alias(f"{c}_b") for c in x.columns])
    near = 1 - F.sqrt(F.aggregate(F.zip_with("v_a", "v_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t) / len(COUNTS))
    name = jaccard(F.col("w_a"), F.col("w_b"))
    pairs = a.join(b, F.col("band_a") == F.col("at")).where("fn_id_a < fn_id_b").withColumn("near", near).where(F.col("near") >= CLOSE)
    # the score is rounded to six places, so what could round up to SCORE stays
    ratio = F.least("size_a", "size_b") / F.greatest("size_a", "size_b")
    pairs = pairs.where(NEAR * F.col("near") + SHAPE * ratio + NAME * name >= SCORE - 1e-6)
    score = NEAR * F.col("near") + SHAPE * lcs_ratio("skeleton_a", "skeleton_b") + NAME * name
    return pairs.select(F.col("fn_id_a").alias("a"), F.col("fn_id_b").alias("b"), F.round(score, 6).alias("score")).where(F.col("score") >= SCORE)


def families(shapes_: DataFrame, level: str = "module") -> DataFrame:
    """(family, level, members, agreement, varying, score): greedy families of one level and kind, each around its first free member.

    The agreement is a walk with two pointers, not a longest subsequence. A level is a file or folder, so its group is bounded.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        left, out = g.sort_values("fn_id").to_dict("records"), []
        while left:
            seed, *rest = left
            agree = [(_greedy(seed["skeleton"], r["skeleton"]), r) for r in rest]
            own = [(a, r) for a, r in agree if a >= AGREEMENT]
            members = [seed, *[r for _, r in own]]
            varying = sum(len({m[c] for m in members}) > 1 for c in COUNTS if c != "lines")
            if len(members) >= MEMBERS and varying <= VARYING:
                mean = sum(a for a, _ in own) / len(own)
                out.append((seed["fn_id"], seed[level], sorted(m["fn_id"] for m in members), round(mean, 6), varying, round(min(len(members) / 6, 1) * mean * (1 - varying / 4), 6)))
                gone = {m["fn_id"] for m in members}
                left = [r for r in rest if r["fn_id"] not in gone]
            else:
                left = rest
        return pd.DataFrame(out, columns=["family", "level", "members", "agreement", "varying", "score"])

    return shapes_.where(F.length("skeleton") > 0).groupBy(level, "decl_kind").applyInPandas(run, "family string, level string, members array<string>, agreement double, varying long, score double")
