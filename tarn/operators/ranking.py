"""Reports as short lists: the order of each, with its ties, and how many rows it shows; the total is kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(part: str | tuple[str, ...]) -> Column:
    """``x`` up, ``-x`` down, (x, values...) in the order of the values, others last."""
    if isinstance(part, str):
        return F.desc(part[1:]) if part.startswith("-") else F.asc(part)
    out = F.lit(len(part))
    for k, v in reversed(list(enumerate(part[1:]))):
        out = F.when(F.col(part[0]) == v, k).otherwise(out)
    return out.asc()


#: Report -> (order, rows shown; None for all). The bounds are fixed values.
ORDERS: dict[str, tuple[list, int | None]] = {
    "files": (["-lines", "path"], None),
    "nesting": (["-depth", "-inner_lines", "path", "line"], 60),
    "duplicates": (["-score", "a", "b"], 40),
    "families": (["-score", "-lines", "level"], 20),
    "placeholders": (["-score", "-lines", "path", "name"], 60),
    "unused": (["-lines", "path", "name"], 60),
    "deep": (["-depth", "path", "name"], 25),
    "depths": (["depth"], None),
    "doors": ([("kind", "open",), "-hops", "path", "name"], 60),
    "guards": ([("verdict", "unchecked", "shallow", "solid",), "-guards", "name"], None),
    "embedded": (["-score", "-lines", "path", "line"], 40),
    "controls": (["-depth", "path", "line"], 40),
    "layout": ([("kind", "cut",), "-severity", "path", "line"], None),
    "settings": ([("verdict", "does nothing", "never set", "untouched", "contested",), "-touches", "name"], 80),
    "outcomes": ([("kind", "abort",), "hops", "path", "name"], None),
    "timeline": (["unix", "path"], None),
    "presses": (["path", "line"], None),
    "routines_of_file": (["path", "line"], None),
    "routines": (["module", "line", "name"], None),
    "ui_tests": (["menu", "name", "version"], None),
}


def ranked(df: DataFrame, report: str, shown: int | None = None) -> DataFrame:
    """The rows of a report that are shown, in its order: a bounded list is found by partial lists, without a full sort."""
    order, most = ORDERS[report]
    most = most if shown is None else shown
    got = df.orderBy(*map(_column, order))
    return got if most is None else got.limit(most)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))
