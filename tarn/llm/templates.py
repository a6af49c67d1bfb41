"""Benchmark decontamination by templates: copied and re-parameterised questions, found with DataFrame expressions only.

Numbers, units and names become typed placeholders, so a question asked with other values has the same template.
Windows of WINDOW template words are joined by hash; then the slots must agree: in an alignment each value of the
benchmark item stands for the value that the text has in most of its places (none, if two are as frequent), and windows
with another one don't count. Different values may become one value, and windows without slots always count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import within_bytes, without, written

WINDOW = 5
#: Share of an item's windows that a text must hold, slots agreeing, to count as contaminated.
COVERAGE = 0.8
#: Placeholders: a digit begins no other token, as each number becomes one.
NUMBER, UNIT, NAME = "0n", "0u", "0p"
#: Words for units after a number (fixed values).
UNITS = ("%", "°c", "°f", "°", "km/h", "kmh", "mph", "kwh", "kw", "cm", "mm", "km", "kg", "mg", "ml", "lbs", "lb", "oz", "ft", "hrs", "hr", "min", "sec", "ms", "ghz", "mhz", "khz", "hz", "kb", "mb", "gb", "tb", "days", "day", "hours", "hour", "minutes", "minute", "seconds", "second", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "euros", "euro", "cents", "cent", "metres", "meters", "metre", "meter", "miles", "mile", "feet", "foot", "inches", "inch", "pounds", "pound", "grams", "gram", "litres", "liters", "litre", "liter", "m", "g", "l", "h", "s")


def tokens(text: Column) -> Column:
    """Lower-case words without marks; a number, unit or name (a capital word inside a sentence) as placeholder and value."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[\p{Ll},;] )(\p{Lu}\p{L}*)", f"{NAME}$1")
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}])(\d+)(?:[.,:/](\d+))?(?:[.,:/]\d+)*", f" {NUMBER}$1x$2")
    x = F.regexp_replace(F.lower(x), rf"({NUMBER}\d+x\d*) ?({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    return F.split(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), " ")


def is_slot(token: Column) -> Column:
    return token.startswith("0")


def template_hash(words: Column) -> Column:
    """A hash of a window's template: placeholders without their values."""
    return F.xxhash64(F.array_join(F.transform(words, template_of), " "))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, m, size, w, hash, values, anchor, after, anchor_at): windows that hold two plain words at least, or all words of a shorter item.

    The anchor is a plain word with the template of the word after it, the longest such pair: long ones are rare. An
    item of one word has no word after it.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").alias("item"), tokens(F.col("text")).alias("t")).where("t[0] <> ''").withColumn("size", F.least(F.lit(window), F.size("t")))
    # whether an item's first word is a name can't be told, so the first window only counts if there is no other
    w = items.select("item", "size", "t", F.explode(F.sequence(F.least(F.lit(1), F.size("t") - F.col("size")), F.size("t") - F.col("size"))).alias("w")).withColumn("values", F.slice("t", F.col("w") + 1, F.col("size")))
    plain = F.filter("values", lambda x: ~is_slot(x))
    after = F.slice("values", F.lit(2), F.greatest(F.lit(1), F.col("size") - 1))
    pairs = F.filter(F.transform(F.arrays_zip(F.col("values").alias("a"), after.alias("b")), lambda x, i: F.struct((F.length(x["a"]) + F.length(F.coalesce(x["b"], F.lit("")))).alias("n"), (-i).alias("i"), x["a"].alias("a"), x["b"].alias("b"))), lambda x: ~is_slot(x["a"]) & (x["b"].isNotNull() | (F.col("size") == 1)))
    w = w.where(F.size(plain) >= F.least(F.lit(2), F.col("size"))).withColumn("pair", F.array_max(pairs)).where("pair IS NOT NULL")
    w = w.withColumn("anchor", F.col("pair.a")).withColumn("after", F.when(F.col("size") > 1, template_of(F.col("pair.b")))).withColumn("anchor_at", -F.col("pair.i")).withColumn("hash", template_hash(F.col("values")))
    m = w.groupBy("item").agg(F.count_distinct("hash").alias("m"))
    return w.join(m, "item").select("item", "m", "size", "w", "hash", "values", "anchor", "after", "anchor_at")


def template_of(token: Column) -> Column:
    return F.when(is_slot(token), F.substring(token, 1, 2)).otherwise(token)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, n_slots, changed) of each text that holds a benchmark item.

    A text that holds the share ``coverage`` of an item's m windows lacks at most (1 - coverage) m of them, so it holds
    one of any floor((1 - coverage) m) + 1: those with the longest anchors. Pairs of words of the texts meet these
    anchors, each once however many items share it, in one pass; only where the whole window's hash fits does anything
    go on. Each such text then meets all windows, alignment by alignment; windows whose slots contradict the rest of the
    alignment don't count. ``n_slots``: values of an alignment, ``changed``: those that the text has others for.

    What is broadcast is weighed first; beyond ``BROADCAST_BYTES`` it is shuffled. Null texts and null or empty items
    match nothing, repeated rows come as often as they occur in one row per doc_id and text, items without a window of
    two plain words can't be told from others and match nothing; empty tables give an empty result.
    """
    windows = written(item_windows(benchmark, window), "item-windows")
    place = F.array_sort(F.collect_list(F.struct((-F.length("anchor") - F.length(F.coalesce("after", F.lit("")))).alias("o"), "w", "hash", "anchor", "after", "anchor_at", "size")))
    chosen = windows.groupBy("item", "m").agg(place.alias("a"))  # an item is one text: its windows are few
    few = F.floor(F.lit(1 - coverage) * F.col("m") + F.lit(1e-9)).cast("int") + 1
    # equal windows of an item count once in m, so the slice is of distinct ones
    first = F.filter("a", lambda x, i: ~F.exists(F.slice(F.col("a"), 1, i), lambda y: y["hash"] == x["hash"]))
    anchors = chosen.select(F.explode(F.slice(first, F.lit(1), few)).alias("x")).select("x.hash", "x.anchor", "x.after", "x.anchor_at", "x.size").distinct()
    anchors = within_bytes(written(anchors, "anchors"))
    # the exploded rows carry no array: those few that meet an anchor go back to their texts
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("_whole"), tokens(text).alias("t"))  # apart, so that it is done once
    two = F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b"))
    flat = split.select("doc_id", F.xxhash64("_whole").alias("text"), F.posexplode(two).alias("pos", "x")).select("doc_id", "text", "pos", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    # the second word is only looked at where the first fits
    met = flat.join(anchors, (F.col("a") == F.col("anchor")) & (F.col("after").isNull() | (F.col("after") == template_of(F.col("b")))))
    met = met.select("doc_id", "text", "size", "hash", (F.col("pos") - F.col("anchor_at")).alias("from"))
    near = met.where("from >= 0").groupBy("doc_id", "text").agg(F.collect_set(F.struct("size", "hash", "from")).alias("at"))  # of one text, so bounded by it
    near = within_bytes(written(near.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), "at"), "texts-met"))
    whole = docs.select("doc_id", text.alias("_whole"), F.xxhash64(text).alias("text"))
    hits = whole.join(near, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_text"))).select("doc_id", "text", tokens(F.col("_whole")).alias("t"), "at")
    fits = F.exists("at", lambda x: (x["from"] + x["size"] <= F.size("t")) & (template_hash(F.slice("t", x["from"] + 1, x["size"])) == x["hash"]))
    hits = written(hits.where(fits).select("doc_id", "text", "t"), "hits")
    sizes = within_bytes(written(windows.select("size").distinct(), "sizes"))  # no more than WINDOW rows
    # the windows leave their text behind before they are dealt out, so no row of a window carries it
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("t") - F.col("size"))), lambda i: F.struct(i.alias("from"), F.slice("t", i + 1, F.col("size")).alias("theirs")))
    placed = hits.join(sizes, F.size("t") >= F.col("size")).select("doc_id", "text", each.alias("each")).select("doc_id", "text", F.explode("each").alias("x")).select("doc_id", "text", "x.*").withColumn("hash", template_hash(F.col("theirs")))
    right = within_bytes(written(windows.select("item", "hash", "w", "m", "values"), "windows"))
    met = placed.join(right, "hash").withColumn("shift", F.col("from") - F.col("w"))
    slots = F.filter(F.transform(F.arrays_zip(F.col("values").alias("a"), F.col("theirs").alias("b")), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), (F.col("w") + i).alias("at"))), lambda s: is_slot(s["a"]))
    key = ["doc_id", "text", "item", "shift"]
    met = written(met.select(*key, "m", "hash", slots.alias("slots")), "met")
    votes = met.select(*key, F.explode("slots").alias("s")).groupBy(*key, "s.a", "s.b").agg(F.count_distinct("s.at").alias("votes"))
    most = votes.groupBy(*key, "a").agg(F.sort_array(F.collect_list(F.struct("votes", "b")), asc=False).alias("v"))
    most = most.select(*key, "a", F.when((F.size("v") == 1) | (F.get("v", F.lit(0))["votes"] > F.get("v", F.lit(1))["votes"]), F.get("v", F.lit(0))["b"]).alias("b"))
    agree = most.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("means"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("other"))  # an item's values are few
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    joined = met.alias("l").join(agree.alias("r"), same[0] & same[1] & same[2] & same[3], "left").where(F.forall("slots", lambda s: F.col("means")[s["a"]] == s["b"])).select(*[F.col(f"l.{k}") for k in key], "m", "hash", "n", "other")
    found = joined.groupBy("doc_id", "text", "item").agg(F.count_distinct("hash").alias("matched"), F.max("m").alias("windows"), F.coalesce(F.max("n"), F.lit(0)).alias("n_slots"), F.coalesce(F.max("other"), F.lit(0)).alias("changed"))
    share = F.col("matched") / F.col("windows")
    return found.where(share >= coverage - 1e-9).select("doc_id", F.col("item").alias("item_id"), "matched", "windows", share.alias("coverage"), "n_slots", "changed")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns as they are, without those that hold a benchmark item; rows without an id stay."""
    return without(docs, contaminated(docs, benchmark, **options))
