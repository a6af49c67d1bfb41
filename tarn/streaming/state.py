"""Stateful answers over streams: leases, once-only findings, a line gate, first calls, spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def leases(beats: DataFrame, key: str = "process", at: str = "ts", gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(key, start, end, beats): runs of heartbeats no further apart than ``gap``; batch or stream.

    On a stream a lease is emitted once the watermark has passed its end, so append mode never changes one.
    """
    df = beats.withWatermark(at, late) if beats.isStreaming else beats
    g = df.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("beats"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def once_only(findings: DataFrame) -> DataFrame:
    """Each finding (path, line_text, finding) once ever: its identity has no line number, so code that moves is not new.

    The log never expires; the state is one digest for each finding.
    """
    same = F.sha2(F.concat_ws("\x1f", F.coalesce("path", F.lit("")), F.trim(F.coalesce("line_text", F.lit(""))), F.coalesce("finding", F.lit(""))), 256)
    return findings.withColumn("identity", same).dropDuplicates(["identity"])


def line_gate(changes: DataFrame, key: str = "repo", lines: str = "lines", limit: int = 150) -> DataFrame:
    """(key, fired_at): fires when the lines changed since the last firing reach ``limit``, then counts anew; a stream."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, seen = state.get if state.exists else (0, 0)
        fired = []
        for f in frames:
            for n in f[lines].fillna(0):
                total, seen = total + int(n), seen + 1
                if total >= limit:
                    fired.append(seen)
                    total = 0
        state.update((total, seen))
        yield pd.DataFrame({key: [k[0]] * len(fired), "fired_at": fired})

    kind = dict(changes.dtypes)[key]
    return changes.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, fired_at long", "total long, seen long", "append", GroupStateTimeout.NoTimeout)


def first_calls(calls: DataFrame, key: str = "routine", most: int = 8) -> DataFrame:
    """(key, seq, shown): each call with its number for the routine, shown for the first ``most``; a stream."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for f in frames:
            seq = range(n + 1, n + 1 + len(f))
            n += len(f)
            yield pd.DataFrame({key: [k[0]] * len(f), "seq": list(seq), "shown": [i <= most for i in seq]})
        state.update((n,))

    kind = dict(calls.dtypes)[key]
    return calls.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seq long, shown boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def spans(events: DataFrame, thread: str = "thread", order: str = "seq") -> DataFrame:
    """(thread, name, depth, entered, left) from rows with ``kind`` enter or exit: nesting by running sums of +1 and -1.

    An exit closes the last entry at its depth; a span that never ends has no ``left``. Batch form.
    """
    w = Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == "enter", 1).otherwise(-1)
    e = events.withColumn("_sum", F.sum(step).over(w)).withColumn("depth", F.when(F.col("kind") == "enter", F.col("_sum")).otherwise(F.col("_sum") + 1))
    level = Window.partitionBy(thread, "depth").orderBy(order)
    nxt = e.withColumn("_kind", F.lead("kind").over(level)).withColumn("left", F.when(F.col("_kind") == "exit", F.lead("at").over(level)))
    return nxt.where("kind = 'enter'").select(thread, "name", F.col("depth").cast("long").alias("depth"), F.col("at").alias("entered"), "left")


def timing_lines(spans_: DataFrame) -> DataFrame:
    """(value): tab-separated lines of a timing log, ready for a text sink: name, location, start, end, duration."""
    duration = F.col("end") - F.col("start")
    return spans_.select(F.concat_ws("\t", "name", F.concat_ws(":", "path", "line", "column"), F.col("start").cast("string"), F.col("end").cast("string"), duration.cast("string")).alias("value"))
