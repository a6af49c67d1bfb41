"""Token counts behind a digest cache: only texts that no run has counted yet are encoded."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.shared import bit_filter, new_path, text_or_empty, written

CACHE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())])
#: Pieces whose counts a worker remembers; beyond it the memory starts anew.
MEMORY = 400_000
_CHUNK = re.compile(" *[^ ]+| +$")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class PieceCounter:
    """Counts of a sentencepiece model whose pieces hold spaces only in front.

    No merge can then cross from a character to a space that follows, so a text's count is the sum over runs of spaces with
    the characters after them, and each distinct run is encoded once. The constructor checks this of the model; one that
    has pieces with inner spaces, or that rewrites its input, encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        as_it_is = "ﬁ ｱ  　x"
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.decode(self.model.encode(as_it_is)) == as_it_is and self.model.encode("a", out_type=str)[0].startswith("▁")
        self.memory: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [self.count(x) for x in texts]

    def count(self, text: str) -> int:
        if "▁" in text:
            text = text.replace("▁", " ")
        if not text:
            return 0
        # the model puts one space before a text; each run is kept without its first space, which the model puts back
        runs = text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else self.runs(text)
        memory = self.memory
        if new := list(set(runs).difference(memory)):
            if len(memory) + len(new) > MEMORY:
                memory.clear()
                new = list(set(runs))
            memory.update(zip(new, (len(x) if r else 1 for r, x in zip(new, self.model.encode(new, num_threads=1), strict=True)), strict=True))
        return sum(map(memory.__getitem__, runs))

    @staticmethod
    def runs(text: str) -> list[str]:
        return [x[1:] for x in _CHUNK.findall(" " + text)]


@lru_cache(1)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model: str | None = None, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text, as the model's library gives them, without begin, end or special tokens.

    Texts meet the cache (a Parquet folder: digest, version, n_tokens) by their SHA-256 and the model file's. Of those it
    lacks, each distinct one is encoded and appended. Without ``cache`` a new folder in the shared one serves. Texts are
    never shuffled: one row for each digest is chosen by digests and ids alone, a bit filter tells the tasks that read the
    texts which these are, and they encode them on the spot; where it has too few bits, some texts are encoded twice.

    Returns, for each row: id_col, digest, n_bytes, n_tokens. A null text is an empty one and has 0 tokens; repeated rows
    give repeated rows; an empty table gives none; other columns are not looked at, whatever their names.
    """
    spark, path = docs.sparkSession, model or model_path()
    cache, version = cache or new_path(spark, "token-cache"), version_of(path)
    text = text_or_empty(text_col)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    read = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    whole = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("digest", F.sha2("_text", 256))
    thin = written(whole.select("_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes")), "digests")
    misses = thin.groupBy("digest").agg(F.min("_id").alias("_first")).join(read(), "digest", "left_anti")
    misses = written(misses.select("digest", F.xxhash64("_first", "digest").alias("row")), "misses")
    sent = spark.sparkContext.broadcast(bit_filter(misses, "row"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, wanted, seen = counter(path), sent.value, set()
        for b in batches:
            row = b.column(0).to_numpy()
            slots = row & ((len(wanted) << 6) - 1)
            hit = np.flatnonzero((wanted[slots >> 6] >> (slots & 63)) & 1)
            at = [k for k in hit.tolist() if not (row[k] in seen or seen.add(row[k]))]  # a row may occur twice
            b = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(count(b.column(2).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    rows = whole.select(F.xxhash64("_id", "digest").alias("row"), "digest", "_text")
    found = rows.mapInArrow(encode, "digest string, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).join(misses, "digest", "left_semi")
    found.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    sent.destroy()
    return thin.join(read(), "digest").select(F.col("_id").alias(id_col), "digest", "n_bytes", "n_tokens")
