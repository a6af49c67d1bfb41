"""Text classifiers trained here: follow-the-regularised-leader for quality, non-negative PU learning for toxicity.

Both fit on a bounded sample of rows, a documented parameter, and score every whole text where it lies: the model is a
small table that goes with the function, so nothing is shuffled. What decides a score is the text alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import uniform
from tarn.llm.text import U64, Words, cut, flat, mix, windows, words

#: Labelled rows, or positives and unlabelled rows together, that a classifier is fitted on at most (about: by hash).
MOST_ROWS = 8_000
BITS = 18
FOLDS = 5

_ALNUM = np.ones(256, dtype=bool)
_ALNUM[:128] = [chr(i).isalnum() for i in range(128)]
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1
_MARK = np.zeros(256, dtype=np.int32)
_MARK[33:127] = [not chr(i).isalnum() for i in range(33, 127)]


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(FOLDS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def shapes(data: np.ndarray, w: Words) -> np.ndarray:
    """A code for each word's outward form: capitals, marks, length, and whether it repeats the word before."""
    if not len(w.hashes):
        return np.zeros(0, dtype=U64)
    size = w.ends - w.starts
    upper, mark = np.add.reduceat(_UPPER[data], w.starts), np.add.reduceat(_MARK[data], w.starts)
    letters = size - mark
    case = np.where(upper == 0, 0, np.where((upper > 1) & (upper * 2 >= letters), 2, 1))
    again = np.zeros(len(size), dtype=np.int64)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    code = case + 3 * np.minimum(mark, 3) + 12 * (letters == 0) + 24 * np.minimum(size // 4, 3) + 96 * again
    return mix(code.astype(U64) + U64(77_777))


def ngram_features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed n-gram, value) of 1- and 2-grams of words as written and of words' forms; each row's values have length 1."""
    w = words(data, offsets, lowered=False)
    form = Words(shapes(data, w), w.first, w.starts, w.ends)
    parts = [windows(x, n, short=False) for x in (w, form) for n in (1, 2)]
    h, row = np.concatenate([mix(p[0] + U64(k)) for k, p in enumerate(parts)]), np.concatenate([p[1] for p in parts])
    key = (row.astype(U64) << U64(bits)) | (h & U64((1 << bits) - 1))
    key, count = np.unique(key, return_counts=True)
    row, index, value = (key >> U64(bits)).astype(np.int64), (key & U64((1 << bits) - 1)).astype(np.int64), np.sqrt(count)
    norm = np.sqrt(np.bincount(row, weights=count, minlength=len(offsets) - 1))
    return row, index, value / norm[row]


@dataclass
class Ftrl:
    """Logistic regression with per-coordinate follow-the-regularised-leader updates; one pass takes the examples one by one."""

    bits: int = BITS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    passes: int = 4

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
        """Weights, the last for the bias. The order of the rows is shuffled with a fixed seed in each pass."""
        n = (1 << self.bits) + 1
        z, s = np.zeros(n), np.zeros(n)
        rng = np.random.default_rng(8)
        for _ in range(self.passes):
            for i in rng.permutation(len(rows)):
                at, x = np.append(rows[i][0], n - 1), np.append(rows[i][1].astype(np.float64), 1.0)
                w = self._weights(z[at], s[at])
                g = (sigmoid(np.array(w @ x)) - y[i]) * x
                more = s[at] + g * g
                z[at] += g - (np.sqrt(more) - np.sqrt(s[at])) / self.alpha * w
                s[at] = more
        return self._weights(z, s).astype(np.float32)

    def _weights(self, z: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(s)) / self.alpha + self.l2))


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of lowered runs of letters and digits."""
    w = words(np.where(_ALNUM[data], data, np.uint8(32)), offsets)
    return w.row, w.hashes


def pu_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct lowered words."""
    row, h = letter_words(data, offsets)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


@dataclass
class NonNegativePu:
    """A linear classifier of word presence under the non-negative risk of positive and unlabelled rows.

    With prior p of positives: risk = p * R(positive as 1) + max(0, R(unlabelled as 0) - p * R(positive as 0)). When the
    second part falls below zero the step climbs it, so the model does not fit unlabelled positives as negatives.
    Words are chosen if more of the positives hold them than the unlabelled rows lead to expect, by ``least`` deviations.
    """

    words: int = 512
    least: float = 4.0
    steps: int = 400
    rate: float = 0.05
    l2: float = 1e-4

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(hashes ascending, weights, bias). Without positives: no words and the prior as the score of all."""
        base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
        if not positive or not unlabelled:
            return np.zeros(0, dtype=U64), np.zeros(0), base
        hp, cp = np.unique(np.concatenate(positive), return_counts=True)
        hu, cu = np.unique(np.concatenate(unlabelled), return_counts=True)
        at = np.minimum(np.searchsorted(hu, hp), len(hu) - 1)
        other = np.where(hu[at] == hp, cu[at], 0) / len(unlabelled)
        own = cp / len(positive)
        expected = other * len(positive)
        gain = (cp - expected) / np.sqrt(expected + 1)
        order = np.argsort(-gain, kind="stable")[: self.words]
        kept = np.sort(hp[order[gain[order] >= self.least]])
        xp, xu = (self._matrix(rows, kept) for rows in (positive, unlabelled))
        w, b = np.zeros(len(kept)), base
        m1, m2 = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
        for t in range(1, self.steps + 1):
            p, u = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
            negative = -np.log(np.maximum(1 - u, 1e-12)).mean() + prior * np.log(np.maximum(1 - p, 1e-12)).mean()
            up, uu = p / len(p), u / len(u)  # slopes of the losses as 0
            as_0 = np.append(xu.T @ uu - prior * (xp.T @ up), uu.sum() - prior * up.sum())
            slope = (p - 1) / len(p)
            g = prior * np.append(xp.T @ slope, slope.sum()) + as_0 if negative >= 0 else -as_0
            g[:-1] += self.l2 * w
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            step = self.rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        return kept, w, float(b)

    @staticmethod
    def _matrix(rows: list[np.ndarray], kept: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), len(kept)), dtype=np.float32)
        for i, h in enumerate(rows):
            if len(kept):
                at = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
                x[i, at[kept[at] == h]] = 1
        return x


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, only: Column | None = None) -> DataFrame:
    """(_id, _y, _text) of training rows, about ``most`` at most, chosen by a hash of the id.

    A label that is null counts as none, of several for an id the highest does. The chosen labels are bounded by ``most``
    and so broadcast; texts are not shuffled.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y")).where(remainder() != 0)
    y = y.where(only) if only is not None else y
    n = y.count()
    chosen = y.where(uniform(7, F.col("doc_id")) < F.lit(most / max(n, 1))).select(F.col("doc_id").alias("_id"), "_y")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "_y", F.coalesce("text", F.lit("")).alias("_text"))


def gathered(rows: DataFrame, features: Callable, valued: bool) -> list[tuple]:
    """(label, hashes or indexes, values) of each training row, featurised where the texts are; ordered by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column(2))
            for i, j in cut(offsets):
                got = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.searchsorted(got[0], np.arange(j - i + 1))
                key = got[1].astype(np.int32) if valued else got[1]
                pairs = [(key[p:q].tobytes(), got[2][p:q].astype(np.float32).tobytes() if valued else b"") for p, q in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j].cast(pa.int64()), b.column(1)[i:j].cast(pa.int32()), pa.array([p for p, _ in pairs], pa.binary()), pa.array([v for _, v in pairs], pa.binary())], names=["id", "y", "f", "v"])

    got = rows.mapInArrow(run, "id long, y int, f binary, v binary").toArrow().sort_by([("id", "ascending"), ("f", "ascending")])
    # views of the columns' own bytes: the driver holds the sample once
    (f, at), (v, of) = flat(got["f"]), flat(got["v"])
    return [(y, f[at[k] : at[k + 1]].view(np.int32 if valued else U64), v[of[k] : of[k + 1]].view(np.float32)) for k, y in enumerate(got["y"].to_pylist())]


Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def scored(docs: DataFrame, score: Score, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs, in place."""
    thin = docs.select("doc_id", (remainder() == 0).alias("held_out"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _scores(b.column(2), score)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def passing(docs: DataFrame, score: Score, threshold: float) -> DataFrame:
    """The rows of docs, all columns as they are, that score ``threshold`` or more; nothing is joined or shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at), score) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _scores(texts: pa.Array, score: Score) -> np.ndarray:
    data, offsets = flat(texts)
    got = [score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in cut(offsets)]
    return np.concatenate(got) if got else np.zeros(0)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MOST_ROWS, **options) -> DataFrame:
    """Probability that a text is of quality 1.

    Fits on about ``most`` labelled rows outside the held-out fold. Returns, for each row: doc_id, held_out, score,
    predicted. A null text is an empty one and scores the bias; without labels all score 0.5; repeated rows score alike.
    """
    return scored(docs, quality_model(docs, labels, most, **options), threshold)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MOST_ROWS, **options) -> DataFrame:
    """The documents, as they are, whose score is ``threshold`` or more; nulls and repeated rows as in score_quality."""
    return passing(docs, quality_model(docs, labels, most, **options), threshold)


def quality_model(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, **options) -> Score:
    rows = gathered(labelled(docs, labels, "quality", most), ngram_features, valued=True)
    model = Ftrl(**options).fit([(f, v) for _, f, v in rows], np.array([y for y, _, _ in rows], dtype=float))
    weights, bias = model[:-1], float(model[-1])

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, index, value = ngram_features(data, offsets)
        return sigmoid(np.bincount(row, weights=weights[index] * value, minlength=len(offsets) - 1) + bias)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = MOST_ROWS, **options) -> DataFrame:
    """Probability that a text is toxic, learned from confirmed toxic rows and unlabelled ones.

    Positives: rows with label 1 outside the held-out fold, about half of ``most``; unlabelled: texts of that many other
    rows outside it, by hash, whatever their labels. The prior is the share of 1 among the labels outside the fold.
    Returns, for each row: doc_id, held_out, score, predicted. A null text is an empty one and scores the bias; without
    labels all score near 0; repeated rows score alike.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(remainder() != 0)
    prior = float(known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0])
    positive = gathered(labelled(docs, labels, "toxic", most // 2, F.col("_y") == 1), pu_features, valued=False)
    pool = docs.where(remainder() != 0)
    n = pool.count()
    sample = pool.where(uniform(9, F.col("doc_id")) < F.lit(most / 2 / max(n, 1))).select(F.col("doc_id").alias("_id"), F.lit(0).alias("_y"), F.coalesce("text", F.lit("")).alias("_text"))
    unlabelled = gathered(sample, pu_features, valued=False)
    kept, weights, bias = NonNegativePu(**options).fit([f for _, f, _ in positive], [f for _, f, _ in unlabelled], prior)

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, h = letter_words(data, offsets)
        if not len(kept):
            return np.full(n, sigmoid(np.array(bias)))
        at = np.minimum(np.searchsorted(kept, h), len(kept) - 1)
        hit = kept[at] == h
        pair = np.unique(row[hit] * len(kept) + at[hit])
        return sigmoid(np.bincount(pair // len(kept), weights=weights[pair % len(kept)], minlength=n) + bias)

    return scored(docs, score, threshold)
