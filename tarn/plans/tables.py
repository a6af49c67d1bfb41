"""Counts, bands, samples, windows and joins on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import code
from tarn.operators import graph, pages, samples, similarity, tallies
from tarn.session import table


def size_bands(spark: SparkSession, d: str) -> DataFrame:
    return tallies.size_bands(table(spark, d, "documents"), "doc_id", "n_chars")


def health_bands(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    g = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(F.split("text", "\n"))).alias("_avg"))
    return g.select("source", "n", F.round("_avg", 6).alias("average"), tallies.health_of(F.col("_avg")).alias("health"), tallies.inner_bucket(F.floor("_avg")).cast("long").alias("bucket"))


def role_tally(spark: SparkSession, d: str) -> DataFrame:
    return tallies.tally(table(spark, d, "conversations"), F.col("role"), "role")


def lang_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lang = F.when(F.col("lang").isin("en", "de", "fr", "es"), F.col("lang")).otherwise("other")
    return docs.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("text", "\n"))).cast("long").alias("lines"))


def scope_totals(spark: SparkSession, d: str) -> DataFrame:
    return tallies.scope_totals(table(spark, d, "events"), "event_type", "value")


def coverage_buckets(spark: SparkSession, d: str) -> DataFrame:
    return tallies.coverage_buckets(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return tallies.even_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 48)


def timeline(spark: SparkSession, d: str) -> DataFrame:
    from tarn.operators.scan import sequenced

    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return sequenced(m, ["month"], {"so_far": F.col("n")}).select("month", "n", "total", "so_far")


def resolve_best(spark: SparkSession, d: str) -> DataFrame:
    """Lines as calls by customers: the part is the name, suppliers of the part the candidates, nations the modules."""
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").distinct()
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("module"))
    calls = line.join(orders, "l_orderkey").join(cust, "o_custkey").groupBy(F.concat(F.lit("c"), "o_custkey").alias("caller"), "module", F.col("l_partkey").alias("name")).agg(F.min("l_orderkey").alias("ord"))
    supp = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("module"))
    fns = line.select("l_partkey", "l_suppkey").distinct().join(supp, "l_suppkey").select(F.concat(F.lit("s"), "l_suppkey").alias("fn_id"), "module", F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("ord"))
    return graph.resolve(calls, fns)


def unresolved(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def line_owner(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    marks = e.where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("owner"))
    return graph.nearest_before(e.where("event_type <> 'signup'").select("user_id", "event_id"), marks, "user_id", "event_id", "owner")


def touched_findings(spark: SparkSession, d: str) -> DataFrame:
    """Error events that lie within 50 ids of a purchase of the same user, and those that do not."""
    e = table(spark, d, "events")
    f = e.where("event_type = 'error'").select(F.col("user_id").alias("path"), F.col("event_id").alias("line"))
    h = e.where("event_type = 'purchase'").select(F.col("user_id").alias("path"), (F.col("event_id") - 50).alias("first"), (F.col("event_id") + 50).alias("last"))
    yours, nearby = graph.touched(f, h)
    return yours.withColumn("kind", F.lit("yours")).unionByName(nearby.withColumn("kind", F.lit("nearby")))


def _supply(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of one part in the order of their keys, as edges from each to the next."""
    ps = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    nxt = F.lead("l_suppkey").over(Window.partitionBy("l_partkey").orderBy("l_suppkey"))
    return ps.select(F.col("l_suppkey").alias("src"), nxt.alias("dst")).where("dst IS NOT NULL").distinct()


def blast_callers(spark: SparkSession, d: str) -> DataFrame:
    back = _supply(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = table(spark, d, "supplier").where("s_suppkey = 50").select(F.col("s_suppkey").alias("node"))
    return graph.within(back, seeds, 2, include=False).select("node", "depth")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws(":", "conv_id", "turn")
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", "role", name.alias("node"), F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("nxt"))


def _turn_edges(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    return t.select(F.col("node").alias("src"), F.col("nxt").alias("dst")).join(t.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def reach(spark: SparkSession, d: str) -> DataFrame:
    seeds = _turns(spark, d).where("turn = 0").select("node")
    got = graph.within(_turn_edges(spark, d), seeds)
    return got.groupBy("seed").agg(F.count(F.lit(1)).alias("reached"), F.max("depth").alias("farthest"))


def nearest_guard(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    return graph.nearest(_turn_edges(spark, d), t.where("role = 'user'").select("node"), t.where("role IN ('system', 'assistant')").select("node"))


def depth_hist(spark: SparkSession, d: str) -> DataFrame:
    got = graph.depths(_turns(spark, d).select("node"), _turn_edges(spark, d))
    return got.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def idf_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("term"))
    return tallies.idf(words, "doc_id", "term")


def word_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose words of name and type are half the same or more."""
    words = similarity.split_words(F.regexp_replace(F.concat_ws(" ", "p_name", "p_type"), " ", "_"))
    return similarity.word_pairs(table(spark, d, "part").select("p_partkey", words.alias("words")), "p_partkey", "words")


def twins(spark: SparkSession, d: str) -> DataFrame:
    return similarity.twins(table(spark, d, "documents"), "doc_id", "text")


def contested(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("thing"), F.col("l_partkey").alias("writer"))
    return similarity.contested(w)


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return similarity.neighbours(table(spark, d, "events"), "user_id", ["event_id"], "event_type")


def first_n(spark: SparkSession, d: str) -> DataFrame:
    return tallies.first_n(table(spark, d, "events").select("user_id", "event_id"), "user_id", ["event_id"])


def session_lease(spark: SparkSession, d: str) -> DataFrame:
    """Leases of a user: beats no more than a day apart belong to one."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    new = F.when(F.col("us") - F.lag("us").over(w) <= 86_400_000_000, 0).otherwise(1)
    s = e.withColumn("new", new).withColumn("lease", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy("user_id", "lease").agg(F.count(F.lit(1)).alias("beats"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def welch_t(spark: SparkSession, d: str) -> DataFrame:
    return samples.welch(table(spark, d, "events"), F.col("event_type"), "value", "click", "view")


def failure_bound(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return g.withColumns(samples.proportion_bound(F.col("failures"), F.col("total"), 0.1))


def stable_bench(spark: SparkSession, d: str) -> DataFrame:
    return samples.stable_row(table(spark, d, "events"), "event_type", "value")


def line_letters(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("n", "line"))
    return lines.groupBy(code.line_letter(F.col("line")).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


def path_facts(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.element_at(F.array(F.lit("src/a/"), F.lit("tests/"), F.lit("lib/node_modules/x/"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int")), F.lit("test_"), F.col("page_id").cast("string"), F.element_at(F.array(F.lit(".nim"), F.lit(".JS"), F.lit(".md")), (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", p.alias("path")).select("page_id", code.extension(F.col("path")).alias("ext"), code.is_ignored(F.col("path")).alias("ignored"), code.is_test(F.col("path")).alias("is_test"), code.is_src(F.col("path")).alias("is_src"), code.module_of(F.col("path")).alias("module"))


def page_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("anchors"), F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count(F.lit(1)).alias("tags"))


def embedded_lang(spark: SparkSession, d: str) -> DataFrame:
    return code.classify(table(spark, d, "pages").select("page_id", F.col("html").alias("text")), "page_id").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


def scatter(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as a group inside all orders of its status, by key: how many others start between them."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("path"), F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("line"))
    return code.strangers(o).where("strangers >= 4")


def press_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of moves: seconds of a transition from the value of an event, hops from its id."""
    e = table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("s"), (F.col("event_id") % 14).alias("hops"))
    return e.select("event_id", F.round(code.move_score(F.col("s")), 6).alias("move"), F.round(code.near_score(F.col("hops")), 6).alias("near"))


def page_tree(spark: SparkSession, d: str) -> DataFrame:
    """Elements of each page, the largest subtree below its root, and what is on screen."""
    from tarn.session import stored

    e = stored(pages.elements(table(spark, d, "pages")))
    roots = e.where("parent IS NULL").select("page_id", "idx")
    below = pages.sizes(e).join(roots, ["page_id", "idx"], "left_anti").groupBy("page_id").agg(F.max("size").alias("largest"))
    return e.groupBy("page_id").agg(F.count(F.lit(1)).alias("elements"), F.max(F.size("ancestors")).alias("depth")).join(below, "page_id", "left").join(pages.on_screen(e), "page_id", "left")


def ui_depth(spark: SparkSession, d: str) -> DataFrame:
    """Controls by how many gates they are behind."""
    c = pages.controls(pages.elements(table(spark, d, "pages")))
    return c.groupBy("depth", "tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("key_only").alias("key_only"))


def trace_top(spark: SparkSession, d: str) -> DataFrame:
    """The 25 users with the most events; of equal ones the lower id first."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return tallies.top(g, [F.desc("n"), F.asc("user_id")], 25)[0]


def setting_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as settings: returned lines read them, large lines with a discount above 9 % write them, a first line is their default."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("reads"), F.count_if((F.col("l_discount") > 0.09) & (F.col("l_quantity") > 40)).alias("writes"), (F.min("l_linenumber") == 1).alias("has_default"))
    return g.select("l_suppkey", "reads", "writes", "has_default", code.setting_verdict(F.col("reads"), F.col("writes"), F.col("has_default")).alias("verdict"))


def skeletons(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the letters of their first 160 code lines."""
    lines = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("n", "line"))
    return code.skeleton(lines, "page_id", "n", "line")


def screen_share(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, what is left of a screen as large as its source's largest one; null where no document of a source has over 50 characters."""
    n = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    most = F.max(F.when(F.col("n_chars") > 50, F.col("n_chars"))).over(Window.partitionBy("source"))
    return n.withColumn("screen", most).select("doc_id", F.round(code.kept_share(F.col("n_chars"), F.col("screen")), 6).alias("kept"))


def tag_rows(spark: SparkSession, d: str) -> DataFrame:
    """Words of a conversation's roles as tags: trimmed, lower-case, each once, in order."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.lit(" "), F.upper("role"))).alias("tags"))
    return g.select("conv_id", F.array_join(tallies.normalised(F.col("tags")), ",").alias("tags"))
