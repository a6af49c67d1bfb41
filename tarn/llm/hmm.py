"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihoods by scaled forward recursion.

A text is its lowered words and one end. The most frequent words are symbols of their own; further words that are
frequent share a symbol with those of about the same count; all others, unknown words included, share the symbol
REST. A symbol with several words gives each a fixed share by its count, so the model is a distribution over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.classifiers import FOLDS
from tarn.llm.shared import written
from tarn.llm.text import U64, cut, flat, words

#: Words whose counts go with the functions, at most; the counts of others are looked up where they lie.
HEAD = 300_000
#: Words that are symbols of their own, at most.
SYMBOLS = 6_000
END, REST, FIRST_BUCKET, BUCKETS = 0, 1, 2, 40
STATES, ROUNDS, SEGMENT = 6, 3, 128
#: At first a state is kept with this probability, so that states find kinds of text; and the weight of the unigram
#: distribution in emissions, against the mean count of a state.
STAY, SMOOTH = 0.995, 0.4


@dataclass
class Vocabulary:
    """Counts of the training tokens, and what the head's words are worth. ``n`` and ``v`` include the end."""

    hashes: np.ndarray
    counts: np.ndarray
    ends: int
    n: int
    v: int
    symbol: np.ndarray = field(init=False)
    share: np.ndarray = field(init=False)
    n_symbols: int = field(init=False)

    def __post_init__(self) -> None:
        order = np.lexsort((self.hashes, -self.counts))
        self.symbol, self.share = np.zeros(len(order), dtype=np.int16), np.zeros(len(order))
        own = order[:SYMBOLS]
        self.symbol[own] = FIRST_BUCKET + BUCKETS + np.arange(len(own))
        rest = order[SYMBOLS:]
        bucket = np.log2(np.maximum(self.counts[rest], 1)).astype(np.int64)
        mass = np.bincount(bucket, weights=self.counts[rest], minlength=BUCKETS)
        self.symbol[rest] = FIRST_BUCKET + bucket
        self.share[rest] = np.log10(self.counts[rest] / mass[bucket])
        self.n_symbols = FIRST_BUCKET + BUCKETS + len(own)
        # what is left for the words outside the head, the unknown one included
        self.rest_mass = float(self.n - self.ends - self.counts.sum()) + 0.5 * (self.v - len(order))

    @property
    def norm(self) -> float:
        return float(np.log10(self.n + 0.5 * (self.v + 1)))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(20)) % U64(shards)).astype(np.int64)


def word_counts(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, h, c, texts) of the training texts: hashes of words with counts, packed; one row for each task and shard, then one for each shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, texts, pending = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), 0, []

        def fold() -> None:
            nonlocal h, c, pending
            all_h, all_c = np.concatenate([h, *[x for x, _ in pending]]), np.concatenate([c, *[x for _, x in pending]])
            h, c = _summed(all_h, all_c)
            pending = []

        for b in batches:
            texts += b.num_rows
            data, offsets = flat(b.column(0))
            for i, j in cut(offsets):
                pending.append(np.unique(words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).hashes, return_counts=True))
                if len(pending) >= 16:
                    fold()
        fold()
        of = _shard(h, shards)
        order = np.argsort(of, kind="stable")
        at = np.searchsorted(of[order], np.arange(shards + 1))
        rows = [(k, h[order[p:q]].tobytes(), c[order[p:q]].tobytes(), texts if not k else 0) for k, (p, q) in enumerate(zip(at, at[1:], strict=False)) if q > p or not k]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["shard", "h", "c", "texts"])

    def merge(group: pa.Table) -> pa.Table:
        h, c = _summed(*(np.concatenate([np.frombuffer(x, dtype=t) for x in group[name].to_pylist()]) for name, t in (("h", U64), ("c", np.int64))))
        return pa.table({"shard": group["shard"][:1], "h": pa.array([h.tobytes()], pa.binary()), "c": pa.array([c.tobytes()], pa.binary()), "texts": pa.array([sum(group["texts"].to_pylist())], pa.int64())})

    kind = "shard int, h binary, c binary, texts long"
    return written(docs.mapInArrow(count, kind).groupBy("shard").applyInArrow(merge, kind), "word-counts")


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return h.astype(U64), c.astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[begin], np.add.reduceat(c, begin)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The totals, and the most frequent words down to the count at which ``head`` is reached."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                c, n = np.unique(np.frombuffer(x, dtype=np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n, pa.int64())], names=["c", "n"])

    sizes = counts.select("c").mapInArrow(histogram, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("c")).toPandas()
    texts = counts.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    c, n = sizes["c"].to_numpy(dtype=np.int64), sizes["n"].to_numpy(dtype=np.int64)
    fits = np.cumsum(n) <= head
    least = int(c[fits].min()) if fits.any() else (int(c.max()) + 1 if len(c) else 1)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = (k := np.frombuffer(y, dtype=np.int64)) >= least
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(x, dtype=U64)[got].tobytes()], pa.binary()), pa.array([k[got].tobytes()], pa.binary())], names=["h", "c"])

    got = counts.select("h", "c").mapInArrow(top, "h binary, c binary").toArrow()
    h, k = (np.concatenate([np.zeros(0, dtype=t), *[np.frombuffer(x, dtype=t) for x in got[name].to_pylist()]]) for name, t in (("h", U64), ("c", np.int64)))
    order = np.argsort(h)
    return Vocabulary(h[order], k[order], int(texts), int((c * n).sum() + texts), int(n.sum() + (texts > 0)))


ENCODED = "row long, {id} {kind}, held_out boolean, n_tokens long, known long, base double, share double, symbols binary, tail binary"


def encode(docs: DataFrame, vocab, id_col: str) -> DataFrame:
    """Each text as symbols, with what the head's words add to the two scores, and the hashes of the words outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = vocab.value
        row0 = TaskContext.get().partitionId() << 33
        log_c = np.log10(v.counts + 0.5)
        for b in batches:
            data, offsets = flat(b.column(2))
            for i, j in cut(offsets):
                w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.minimum(np.searchsorted(v.hashes, w.hashes), max(len(v.hashes) - 1, 0))
                hit = v.hashes[at] == w.hashes if len(v.hashes) else np.zeros(len(w.hashes), dtype=bool)
                at, row, m = at[hit], w.row, j - i
                sums = [np.bincount(row[hit], weights=x, minlength=m) for x in (np.ones(len(at)), log_c[at] if len(at) else [], v.share[at] if len(at) else [])]
                symbols = np.full(len(w.hashes) + m, END, dtype=np.int16)
                place = np.arange(len(w.hashes)) + row
                symbols[place] = REST
                symbols[place[hit]] = v.symbol[at]
                ends = w.first[1:] + np.arange(1, m + 1)
                tail, tail_at = w.hashes[~hit], np.searchsorted(row[~hit], np.arange(m + 1))
                begin = np.r_[0, ends]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row0 + np.arange(m), pa.int64()), b.column(0)[i:j], b.column(1)[i:j], pa.array(w.counts + 1, pa.int64()), pa.array(sums[0].astype(np.int64) + (v.ends > 0)),
                        pa.array(sums[1] + np.log10(v.ends + 0.5)), pa.array(sums[2]),
                        pa.array([symbols[p:q].tobytes() for p, q in zip(begin, begin[1:], strict=False)], pa.binary()),
                        pa.array([tail[p:q].tobytes() for p, q in zip(tail_at, tail_at[1:], strict=False)], pa.binary()),
                    ],
                    names=["row", id_col, "held_out", "n_tokens", "known", "base", "share", "symbols", "tail"],
                )
                row0 += m

    return written(docs.mapInArrow(run, ENCODED.format(id=id_col, kind=docs.schema[id_col].dataType.simpleString())), "encoded")


def tail_sums(encoded: DataFrame, counts: DataFrame, shards: int, rest_mass: float) -> DataFrame:
    """(row, known, base, share) of the words outside the head, looked up in the counts' shards."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [np.frombuffer(x, dtype=U64) for x in b.column(1).to_pylist()]
            h = np.concatenate(blobs) if blobs else np.zeros(0, dtype=U64)
            row = np.repeat(b.column(0).to_numpy(), [len(x) for x in blobs])
            of = _shard(h, shards)
            order = np.argsort(of, kind="stable")
            at = np.searchsorted(of[order], np.arange(shards + 1))
            parts = [(k, order[p:q]) for k, (p, q) in enumerate(zip(at, at[1:], strict=False)) if q > p]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([h[o].tobytes() for _, o in parts], pa.binary()), pa.array([row[o].tobytes() for _, o in parts], pa.binary()), pa.array([True] * len(parts))], names=["shard", "h", "c", "query"])

    def look(group: pa.Table) -> pa.Table:
        asked = group["query"].to_numpy(zero_copy_only=False)
        pick = lambda name, kind, mask: np.concatenate([np.zeros(0, dtype=kind), *[np.frombuffer(x.as_py(), dtype=kind) for x, m in zip(group[name], mask, strict=True) if m]])
        h, c, q, row = pick("h", U64, ~asked), pick("c", np.int64, ~asked), pick("h", U64, asked), pick("c", np.int64, asked)
        n = np.zeros(len(q), dtype=np.int64)
        if len(h):
            at = np.minimum(np.searchsorted(h, q), len(h) - 1)
            n = np.where(h[at] == q, c[at], 0)
        log_c = np.log10(n + 0.5)
        rows, first, many = np.unique(row, return_inverse=True, return_counts=True)
        base = np.bincount(first, weights=log_c, minlength=len(rows))
        return pa.table({"row": pa.array(rows, pa.int64()), "known": pa.array(np.bincount(first, weights=n > 0, minlength=len(rows)).astype(np.int64)), "base": pa.array(base), "share": pa.array(base - many * np.log10(rest_mass))})

    asked = encoded.select("row", "tail").where(F.octet_length("tail") > 0).mapInArrow(send, "shard int, h binary, c binary, query boolean")
    found = asked.unionByName(counts.select("shard", "h", "c", F.lit(False).alias("query"))).groupBy("shard").applyInArrow(look, "row long, known long, base double, share double")
    return found.groupBy("row").agg(F.sum("known").alias("_known"), F.sum("base").alias("_base"), F.sum("share").alias("_share"))


@dataclass
class Hmm:
    first: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)

    @classmethod
    def start(cls, unigram: np.ndarray, states: int) -> Hmm:
        """Near the unigram distribution, each state leaning to other symbols, each rather staying than leaving."""
        rng = np.random.default_rng(9)
        emit = (unigram[:, None] * rng.gamma(2.0, 0.5, (len(unigram), states))) + 1e-9
        step = np.full((states, states), (1 - STAY) / max(states - 1, 1))
        np.fill_diagonal(step, STAY if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), step, emit / emit.sum(0))

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 of each whole sequence's probability."""
        out = np.zeros(len(sequences))
        for part, ids, alive in _steps(sequences):
            a, got = None, np.zeros(len(part))
            for t, n in enumerate(alive):
                x = ids[t]
                a = (self.first if a is None else a[:n] @ self.step) * self.emit[x]
                s = a.sum(1)
                a /= s[:, None]
                got[:n] += np.log10(s)
            out[part] = got
        return out

    def expected(self, sequences: list[np.ndarray], before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
        """Expected counts of first states, steps and emissions, the log10 likelihood, and the states after each sequence.

        With ``before``, the states after what precedes each sequence, they go on from there: the step across counts, and
        none is a first state.
        """
        k = len(self.first)
        first, step, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros(self.emit.shape), 0.0
        after = np.zeros((len(sequences), k))
        for part, ids, alive in _steps(sequences):
            alphas, scales, a = [], [], None
            begin = self.first if before is None else before[part] @ self.step
            for t, n in enumerate(alive):
                a = (begin if a is None else a[:n] @ self.step) * self.emit[ids[t]]
                s = a.sum(1)
                a = a / s[:, None]
                alphas.append(a)
                scales.append(s)
            total += sum(float(np.log10(s).sum()) for s in scales)
            beta, gammas = None, [None] * len(alive)
            for t in range(len(alive) - 1, -1, -1):
                n = alive[t]
                now = np.ones((n, k))
                if beta is not None and len(beta):
                    m = len(beta)
                    ahead = self.emit[ids[t + 1]] * beta / scales[t + 1][:, None]
                    step += self.step * (alphas[t][:m].T @ ahead)
                    now[:m] = ahead @ self.step.T
                gammas[t] = alphas[t] * now
                beta = now
            if before is None:
                first += gammas[0].sum(0)
            else:
                step += self.step * (before[part].T @ (self.emit[ids[0]] * beta / scales[0][:, None]))
            for a, n, m in zip(alphas, alive, [*alive[1:], 0], strict=True):
                after[part[m:n]] = a[m:n]
            x, g = np.concatenate(ids), np.concatenate(gammas)
            for j in range(k):
                emit[:, j] += np.bincount(x, weights=g[:, j], minlength=len(emit))
        return first, step, emit, total, after


def _steps(sequences: list[np.ndarray], cells: int = 400_000) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[int]]]:
    """Sequences in groups, long ones first: their places, the symbols at each step of those that last as long, and how many those are."""
    sizes = np.array([len(x) for x in sequences], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        n = max(1, min(len(order) - at, int(np.searchsorted(np.cumsum(sizes[order[at:]]), cells)) + 1))
        part = order[at : at + n]
        size = sizes[part]
        alive = np.searchsorted(-size, -np.arange(size[0]), "left").tolist()
        flat_ = np.concatenate([sequences[i] for i in part])
        begin = np.r_[0, np.cumsum(size)[:-1]]
        yield part, [flat_[begin[:m] + t] for t, m in enumerate(alive)], alive
        at += n


def train(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over all training texts, SEGMENT symbols at a time.

    A segment begins with the states that the text has come to, and the step across counts; only what lies ahead of a
    segment does not speak for the states in it.

    Each task sums the expected counts of its segments and returns them by symbol; Spark adds them, so what reaches the
    driver is one row for each symbol. Emissions are smoothed by the unigram distribution.
    """
    spark = encoded.sparkSession
    unigram = np.bincount(vocab.symbol, weights=vocab.counts, minlength=vocab.n_symbols) + 0.01
    unigram[END], unigram[REST] = vocab.ends + 0.5, max(vocab.rest_mass, 0.5)
    unigram /= unigram.sum()
    model = Hmm.start(unigram, states)
    training = encoded.where(~F.col("held_out")).select("symbols")
    kind = T.StructType([T.StructField("symbol", T.IntegerType()), *[T.StructField(f"s{j}", T.DoubleType()) for j in range(states)]])
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = sent.value
            first, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros(m.emit.shape)
            for b in batches:
                column = b.column(0)
                for i in range(0, len(column), 2048):
                    left, before = [np.frombuffer(x, dtype=np.int16) for x in column[i : i + 2048].to_pylist()], None
                    while left:
                        f, s, e, _, after = m.expected([x[:SEGMENT] for x in left], before)
                        first, step, emit = first + f, step + s, emit + e
                        on = [k for k, x in enumerate(left) if len(x) > SEGMENT]
                        left, before = [left[k][SEGMENT:] for k in on], after[on]
            rows = np.concatenate([emit, step, first[None]])
            at = np.flatnonzero(rows.sum(1) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(rows[at, j]) for j in range(states)]], names=kind.names)

        got = training.mapInArrow(expect, kind).groupBy("symbol").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(states)]).toPandas()
        rows = np.zeros((vocab.n_symbols + states + 1, states))
        rows[got["symbol"].to_numpy(dtype=np.int64)] = got[kind.names[1:]].to_numpy(dtype=float)
        emit, step, first = rows[: vocab.n_symbols], rows[vocab.n_symbols : -1] + 1.0, rows[-1] + 1.0
        emit = emit + (SMOOTH * emit.sum() / states + 1.0) * unigram[:, None]
        model = Hmm(first / first.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
        sent.destroy()
    return model


def score_texts(docs: DataFrame, held_out: int = 1, id_col: str = "doc_id", head: int = HEAD, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """log10 probability of each whole text under a unigram base and the hidden Markov model.

    Trains on the texts whose crc32(id as text) modulo FOLDS is not ``held_out``. Counts are of all training words; those
    of the words outside the head are never gathered anywhere: the words are sent to the shards that hold their counts.

    Returns, for each row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score. A null text is an empty
    one: a sequence of the end alone; a null id counts as an empty text; repeated rows count as often as they occur; an
    empty table gives none; without training texts every token is unknown.
    """
    spark = docs.sparkSession
    part = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(FOLDS)) == held_out
    thin = docs.select(F.col(id_col), part.alias("held_out"), F.col("text").alias("_text"))
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = word_counts(thin.where(~F.col("held_out")).select("_text"), shards)
    vocab = vocabulary(counts, head)
    sent = spark.sparkContext.broadcast(vocab)
    encoded = encode(thin, sent, id_col)
    model = train(encoded, vocab, states, rounds)
    ready = spark.sparkContext.broadcast(model)
    norm = vocab.norm
    tail = tail_sums(encoded, counts, shards, max(vocab.rest_mass, 0.5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ready.value
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                p = b.slice(i, 2048)
                x = m.log10([np.frombuffer(s, dtype=np.int16) for s in p.column(p.schema.get_field_index("symbols")).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[p.column(k) for k in range(p.num_columns - 1)], pa.array(x)], names=[*p.schema.names[:-1], "model"])

    kept = encoded.select("row", id_col, "held_out", "n_tokens", "known", "base", "share", "symbols")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    forward = kept.mapInArrow(score, f"{types}, model double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return forward.join(tail, "row", "left").select(
        id_col, "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("_base") - F.lit(norm) * F.col("n_tokens")).alias("base_score"), (F.col("model") + F.col("share") + zero("_share")).alias("score"),
    )
