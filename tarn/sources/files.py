"""Source trees as tables: files, lines, git output, disassembly."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarn.functions import code


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, ext, bytes, is_test, is_src, content) of one's own files below ``root``; vendored folders are left out.

    ``root`` is any path that Spark reads. Content is read as UTF-8; wrong bytes become replacement marks.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    top = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z]+:/+", ""), f"^{_literal(top)}/?", "")
    f = raw.select(path.alias("path"), F.col("length").alias("bytes"), F.decode("content", "utf-8").alias("content"))
    return f.where(~code.is_ignored(F.col("path"))).select("path", code.extension(F.col("path")).alias("ext"), "bytes", code.is_test(F.col("path")).alias("is_test"), code.is_src(F.col("path")).alias("is_src"), "content")


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in text)


def lines(files_: DataFrame) -> DataFrame:
    """(path, line_no, text, indent, is_code), lines from 1; code is what is neither blank nor a comment line."""
    x = files_.select("path", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("_n", "text"))
    body = F.trim("text")
    return x.select("path", (F.col("_n") + 1).cast("long").alias("line_no"), "text", (F.length("text") - F.length(F.ltrim("text"))).alias("indent"), ((body != "") & ~body.startswith("#")).alias("is_code"))


def git_kept(files_: DataFrame, ignored: DataFrame) -> DataFrame:
    """Files that are no ignored path and in no ignored folder (a path that ends in /); ignored(path)."""
    exact = files_.join(ignored.where("NOT endswith(path, '/')"), "path", "left_anti")
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.concat(F.array_join(F.slice(F.split("path", "/"), 1, k), "/"), F.lit("/")))
    inside = exact.select("path", F.explode(folders).alias("folder")).join(ignored.select(F.col("path").alias("folder")), "folder", "left_semi").select("path").distinct()
    return exact.join(inside, "path", "left_anti")


class GitSource(DataSource):
    """Lines of a git command as rows (line_no, text): spark.read.format("git_lines").option("repo", ...).option("args", "log --oneline")."""

    @classmethod
    def name(cls) -> str:
        return "git_lines"

    def schema(self) -> str:
        return "line_no long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options.get("repo", "."), self.options.get("args", ""))


class _GitReader(DataSourceReader):
    ALLOWED = ("log", "ls-tree", "ls-files", "diff", "rev-list", "show")

    def __init__(self, repo: str, args: str) -> None:
        self.repo, self.args = repo, args.split()
        if not self.args or self.args[0] not in self.ALLOWED:
            raise ValueError(f"git command: one of {', '.join(self.ALLOWED)}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        got = subprocess.run(["git", "-c", "core.quotePath=false", "-C", self.repo, *self.args], capture_output=True, check=True)
        for i, text in enumerate(got.stdout.decode("utf-8", "replace").splitlines(), 1):
            yield i, text


def git(spark: SparkSession, repo: str, args: str) -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("git_lines").option("repo", repo).option("args", args).load()


def tree_counts(tree: DataFrame) -> DataFrame:
    """(files, src, tests, bytes) of ``ls-tree -r --long`` lines."""
    x = tree.select(F.regexp_extract("text", r"^\S+ blob \S+\s+(\d+)\t(.*)$", 1).alias("n"), F.regexp_extract("text", r"^\S+ blob \S+\s+(\d+)\t(.*)$", 2).alias("path")).where("n <> ''")
    return x.agg(F.count(F.lit(1)).alias("files"), F.count_if(code.is_src(F.col("path"))).alias("src"), F.count_if(code.is_test(F.col("path"))).alias("tests"), F.sum(F.col("n").cast("long")).alias("bytes"))


def hunks(diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``diff --unified=0`` lines: hunks (path, first, last) of the new side and removed lines (path, text).

    A file's header is the last ``+++ b/`` above a line; a deleted file keeps its old path. A hunk of no lines still
    touches the line it follows.
    """
    head = F.when(F.col("text").rlike(r"^\+\+\+ b/"), F.substring("text", 7, 1 << 20)).when(F.col("text").rlike("^--- a/"), F.substring("text", 7, 1 << 20))
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one diff is one reading
    x = diff.withColumn("path", F.last(head, ignorenulls=True).over(w))
    c = F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 1)
    n = F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 2)
    h = x.where(c != "").select("path", c.cast("long").alias("first"), F.greatest(F.when(n == "", 1).otherwise(F.expr("try_cast(regexp_extract(text, '^@@ -[0-9]+(?:,[0-9]+)? [+][0-9]+,([0-9]+) @@', 1) as long)")), F.lit(1)).alias("k"))
    removed = x.where(F.col("text").rlike("^-") & ~F.col("text").rlike("^--- (a/|/dev/null)")).select("path", F.substring("text", 2, 1 << 20).alias("text"))
    return h.select("path", "first", (F.col("first") + F.col("k") - 1).alias("last")), removed


def instructions(listing: DataFrame) -> DataFrame:
    """(line_no, routine, source, source_line, address, mnemonic, operands, target) of disassembly text (file, line_no, text).

    Headers and source lines hold for what follows them in their file.
    """
    t = F.col("text")
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head, src = r"^[0-9a-f]+ <(.+)>:$", r"^(\S.*):(\d+)(?: \(discriminator \d+\))?$"
    code_ = r"^\s*([0-9a-f]+):\t(?:[0-9a-f]{2} )+\s*\t(?:(?:rep|repz|repnz|lock|bnd|notrack|data16|cs) )*([a-z][a-z0-9.]*)\s*([^#]*)"
    x = listing.withColumns({"routine": F.last(F.when(t.rlike(head), F.regexp_extract(t, head, 1)), True).over(w), "_src": F.last(F.when(t.rlike(src) & ~t.rlike(head) & ~t.rlike(code_), t), True).over(w)})
    x = x.where(t.rlike(code_)).withColumn("_ops", F.trim(F.regexp_replace(F.regexp_extract(t, code_, 3), "<[^>]*>", "")))
    return x.select(
        "file", "line_no", "routine", F.regexp_extract("_src", src, 1).alias("source"), F.expr("try_cast(regexp_extract(_src, '^(.+):([0-9]+)', 2) as long)").alias("source_line"),
        F.conv(F.regexp_extract(t, code_, 1), 16, 10).cast("long").alias("address"), F.regexp_extract(t, code_, 2).alias("mnemonic"),
        F.when(F.col("_ops") == "", F.array().cast("array<string>")).otherwise(F.split("_ops", r",(?![^\[]*\])")).alias("operands"),
        F.expr(r"try_cast(conv(nullif(regexp_extract(_ops, '^([0-9a-f]+)$', 1), ''), 16, 10) as long)").alias("target"),
    )
