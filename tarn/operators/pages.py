"""Pages as trees: elements, sizes, distances, controls behind gates, style facts and the scores of a press."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CONTROLS = ("button", "a", "input", "select", "textarea", "summary")
GATES = ("details", "dialog", "menu", "template")
ELEMENT = "page_id long, idx long, parent long, tag string, id string, classes array<string>, gate boolean, hidden boolean, line long, ancestors array<long>, label string, key_only boolean"
FAR, CHAIN = 10, 64


class _Tree(HTMLParser):
    """Elements in document order; an end tag closes up to its start tag, and is passed over without one."""

    def __init__(self, page: int, hidden: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.hidden, self.rows, self.open = page, hidden, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        hide = "hidden" in a or a.get("aria-hidden") == "true" or bool(self.hidden.intersection(classes)) or "display:none" in a.get("style", "").replace(" ", "")
        key = tag not in ("button", "a") and "tabindex" in a and "onclick" not in a
        row = [self.page, len(self.rows), self.open[-1] if self.open else None, tag, a.get("id", ""), classes, tag in GATES or hide, hide, self.getpos()[0], list(self.open[-CHAIN:]), a.get("aria-label") or a.get("title") or a.get("value") or "", key]
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row[1])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.rows[self.open[i]][3] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if self.open and data.strip() and not self.rows[self.open[-1]][10]:
            self.rows[self.open[-1]][10] = data.strip()[:40]


def elements(pages: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """One row for each element of (page_id, html); classes in ``hidden`` hide what has them."""
    classes = frozenset(hidden)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page, html in zip(f["page_id"], f["html"], strict=True):
                t = _Tree(page, classes)
                t.feed(html or "")
                rows += t.rows
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ELEMENT.split(", ")]).astype({"parent": "Int64"})

    return pages.select("page_id", "html").mapInPandas(run, ELEMENT)


def sizes(elements_: DataFrame) -> DataFrame:
    """(page_id, idx, size): elements of each subtree, itself included."""
    up = elements_.select("page_id", F.explode(F.concat("ancestors", F.array("idx"))).alias("idx"))
    return up.groupBy("page_id", "idx").agg(F.count(F.lit(1)).alias("size"))


def distance(a: Column, b: Column) -> Column:
    """Steps between two elements given as paths from the root (ancestors and itself): up to the common one and down; FAR without one."""
    common = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda s: s))
    return F.when(common == 0, F.lit(FAR)).otherwise(F.size(a) + F.size(b) - 2 * common)


def controls(elements_: DataFrame) -> DataFrame:
    """(page_id, idx, tag, label, depth, key_only): depth counts the gates among the ancestors and a hidden mark of its own."""
    gates = elements_.where("gate").select("page_id", F.col("idx").alias("anc"))
    c = elements_.where(F.col("tag").isin(*CONTROLS) | F.col("key_only"))
    behind = c.select("page_id", "idx", F.explode(F.concat("ancestors", F.array("idx"))).alias("anc")).join(gates, ["page_id", "anc"]).groupBy("page_id", "idx").agg(F.count(F.lit(1)).alias("depth"))
    return c.join(behind, ["page_id", "idx"], "left").select("page_id", "idx", "tag", "label", F.coalesce("depth", F.lit(0)).alias("depth"), "key_only")


def on_screen(elements_: DataFrame) -> DataFrame:
    """(page_id, screen): elements without a hidden ancestor or mark."""
    hidden = elements_.where("hidden").select("page_id", F.col("idx").alias("anc"))
    gone = elements_.select("page_id", "idx", F.explode(F.concat("ancestors", F.array("idx"))).alias("anc")).join(hidden, ["page_id", "anc"], "left_semi").select("page_id", "idx").distinct()
    return elements_.join(gone, ["page_id", "idx"], "left_anti").groupBy("page_id").agg(F.count(F.lit(1)).alias("screen"))


def hidden_classes(css: DataFrame) -> DataFrame:
    """(class): classes of stand-alone selectors whose body hides; at-rules are dropped."""
    rules = css.select(F.explode(F.regexp_extract_all(F.regexp_replace("css", r"@[^{]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|/\*.*?\*/", ""), F.lit(r"([^{}]+\{[^{}]*\})"), F.lit(1))).alias("rule"))
    hide = F.regexp_replace(F.regexp_extract("rule", r"\{([^{}]*)\}", 1), r"\s", "").rlike(r"display:none|visibility:hidden")
    return rules.where(hide).select(F.explode(F.split(F.regexp_extract("rule", r"^([^{]+)\{", 1), ",")).alias("s")).select(F.regexp_extract(F.trim("s"), r"^\.([A-Za-z0-9_-]+)$", 1).alias("class")).where("class <> ''").distinct()


def press_score(moves: list[Column], cap_teleport: Column) -> Column:
    """The mean of the measured parts (null: not measured) as 0..100, at most 39 for a teleport; null if nothing was measured."""
    parts = F.filter(F.array(*moves), lambda x: x.isNotNull())
    mean = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)
    score = F.when(F.size(parts) > 0, F.round(100 * mean, 2))
    return F.when(cap_teleport, F.least(score, F.lit(39.0))).otherwise(score)
