"""Project operators on the driver's tables: rows of these tables are read as lines, routines, calls, settings and pages of a project.

Each reading is a list of SQL expressions that both engines understand; what is done with it is written twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import code, lines
from tarn.operators import project, ranking
from tarn.session import table

#: Lines that a row of lineitem stands for.
TEXTS = (
    "if a and b:", "  raise newException(ValueError)", "when defined(ssl) and windows:", "  x = cast[int](y)", "result = callee(a, b)", "# if or", "foo.bar(baz, qux)", "let s = \"if while\" & t",
    "{.raises: [IOError, ValueError].}", "", "for i in 0..3: discard readLine(stdin)", "useavx = true # avx", "#ifdef _win32 posix", "elif alpha or beta:", "    copyMem(a, b, 3)", "  quit(1)",
)


def _case(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def _dual(name: str, *columns: str) -> tuple[str, tuple[str, ...]]:
    return name, columns


LINES = _dual("lineitem", "'src/o' || l_orderkey || '.nim' AS path", "l_linenumber AS line", f"{_case(f'(l_partkey + l_linenumber) % {len(TEXTS)}', TEXTS)} AS text")
#: The same lines, none in one place with a different one.
SPREAD = (LINES[0], (LINES[1][0], "l_linenumber * 100000 + l_partkey % 100000 AS line", LINES[1][2]))
ROUTINES = _dual("orders", "'f' || o_orderkey AS fn_id", "'src/o' || o_orderkey || '.nim' AS path", "'n' || o_custkey AS name", "CASE WHEN o_orderkey % 5 = 0 THEN 'template' WHEN o_orderkey % 7 = 0 THEN 'macro' ELSE 'proc' END AS decl_kind", "1 + o_orderkey % 2 AS line_start", "3 + o_orderkey % 3 AS line_end", "o_orderkey % 9 = 0 AS is_input", "o_orderkey % 3 <> 0 AS exported", "CASE o_orderkey % 4 WHEN 0 THEN 'math' WHEN 1 THEN 'Sanitizer' WHEN 2 THEN 'data_fetcher' ELSE 'helper' END AS role")
SITES = _dual("lineitem", "'f' || l_orderkey AS fn_id", "1 + CAST(l_quantity AS INT) % 4 AS depth", "1 + l_partkey % 45 AS inner_lines", "l_suppkey % 2 = 0 AS leaf")
RANKED = _dual(
    "documents", "'src/' || source || '/' || doc_id AS path", "lang || (doc_id % 97) AS name", "source AS module", "lang AS level", "n_chars % 300 AS lines", "CAST(n_chars % 100 AS DOUBLE) / 100 AS score", "n_chars % 9 AS depth", "n_chars % 41 AS inner_lines", "doc_id AS line", "n_chars % 4 AS hops", "n_chars % 17 AS touches",
    "n_chars % 11 AS severity", "n_chars % 13 AS guards", "doc_id * 7 % 1009 AS unix", "doc_id AS a", "doc_id + 1 AS b", "CASE n_chars % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'cut' ELSE 'abort' END AS kind", "CASE n_chars % 5 WHEN 0 THEN 'solid' WHEN 1 THEN 'shallow' WHEN 2 THEN 'unchecked' WHEN 3 THEN 'does nothing' ELSE 'fine' END AS verdict", "lang AS menu", "doc_id AS version",
)
ARGUMENTS = _dual("lineitem", "l_linenumber AS pos", "CASE l_partkey % 6 WHEN 0 THEN '1' || (l_suppkey % 9) WHEN 1 THEN '\"txt\"' WHEN 2 THEN 'true' WHEN 3 THEN 'value' WHEN 4 THEN ' -4' ELSE 'nilly' END AS text")
AFTERS = (" = 3", "[i] = 4", ".add(x)", ".clear()", "[k].clear()", " == 2", " += 1", ".len", "[a][b] = 1", " =~ p", "", " *= 2")
TYPES = ("int", "seq[int]", "Option[string]", "var float", "openArray[seq[bool]]", "Table[string, int]", "ref Node", "Node", "array[3, int]", "set[char]", "", "seq[Option[char]]", "option[]", "JsonNode")
SAMPLES = ("42", "@[42]", 'some("sample")', "3.14", "@[@[true]]", "initTable[string, int]()", "nil", "default(Node)", "default(array[3, int])", "{}", "", "@[some('x')]", "none(int)", '%*{"sample": true}')
SYMBOLS = ("_ZN1s9earlyExitE9openArray", "earlyExit__s_u12", "sboxCt.constprop.0", "plain", "_ZN3abc2de4fourE", "a__b__c", "__x")
BASES = ("earlyExit", "earlyExit", "sboxCt", "plain", "four", "a", "__x")
MODULES = ("s", "", "", "", "abc.de", "", "")
TEST_NAMES = ("keeps bug #12 fixed", "a regression here", "throughput of x", "empty input", "random bytes", "starts at all", "for every x", "end to end", "adds two", "edge of integration")
KINDS = ("bugfix", "regression", "benchmark", "edge case", "fuzz", "smoke", "property", "integration", "unit", "edge case")
LABELS = ("truthBuilder", " data_fetcher", "rawdata", "helper", "OtherRole", "preparddata")
LABELLED = ("truth builder", "data fetcher", "raw data", "helper", "other", "prepared data")


def read(spark: SparkSession, d: str, dual: tuple[str, tuple[str, ...]]) -> DataFrame:
    return table(spark, d, dual[0]).selectExpr(*dual[1])


def sql(dual: tuple[str, tuple[str, ...]]) -> str:
    return f"SELECT {', '.join(dual[1])} FROM {dual[0]}"


def _counted(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _texts(spark: SparkSession, d: str, values: tuple[str, ...]) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", _case(f"p_partkey % {len(values)}", values) + " AS text")


def called_names(spark: SparkSession, d: str) -> DataFrame:
    return _counted(read(spark, d, LINES).select(F.explode(lines.names_called(F.col("text"))).alias("name")), "name")


def passed_and_dotted(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, LINES)
    rows = [t.select(F.lit(kind).alias("kind"), F.explode(f(F.col("text"))).alias("name")) for kind, f in (("passed", lines.names_passed), ("dotted", lines.names_after_dots))]
    return _counted(rows[0].unionByName(rows[1]), "kind", "name")


def raises_and_pragmas(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, LINES)
    raised = t.select(F.lit("raises").alias("kind"), F.explode(lines.raises_declared(F.col("text"))).alias("name"))
    return _counted(raised.unionByName(t.select(F.lit("pragma").alias("kind"), F.explode(lines.pragma_names(F.col("text"))).alias("name"))).unionByName(t.select(F.lit("flag").alias("kind"), F.explode(lines.flags(F.col("text"))).alias("name"))), "kind", "name")


def branch_census(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, LINES)
    return t.groupBy(lines.branch_words(F.col("text")).cast("long").alias("words")).agg(F.count(F.lit(1)).alias("n"), F.count_if(lines.is_branch_head(F.col("text"))).alias("heads"), F.count_if(lines.aborts(F.col("text"))).alias("aborts"), F.count_if(lines.refuses(F.col("text"))).alias("refusals"))


def platform_lines(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, LINES)
    vectors = t.select(lines.vector_feature(F.col("text")).alias("platform")).where("platform IS NOT NULL")
    return project.platform_counts(t).unionByName(_counted(vectors, "platform"))


def unsafe_lines(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, ROUTINES)
    return project.unsafe_rows(read(spark, d, LINES), f, project.input_rows(f).where("role = 'input'")).select("path", "line", "kind", "name", "external")


def input_routines(spark: SparkSession, d: str) -> DataFrame:
    return project.input_rows(read(spark, d, ROUTINES))


def top_level(spark: SparkSession, d: str) -> DataFrame:
    return project.top_level_calls(read(spark, d, LINES), read(spark, d, ROUTINES))


def code_lengths(spark: SparkSession, d: str) -> DataFrame:
    return project.code_lengths(read(spark, d, ROUTINES), read(spark, d, LINES))


def file_rows(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, ROUTINES)
    cover = read(spark, d, SITES).where("leaf").groupBy("fn_id").agg(F.count(F.lit(1)).alias("hits"))
    return project.file_rows(f.select("path"), f, read(spark, d, LINES), read(spark, d, SITES).where("depth > 1"), cover)


def nest_totals(spark: SparkSession, d: str) -> DataFrame:
    return project.nest_stats(read(spark, d, SITES).where("depth > 1"), read(spark, d, ROUTINES))


def refused(spark: SparkSession, d: str) -> DataFrame:
    settings = spark.createDataFrame([("a",), ("b",), ("alpha",), ("beta",)], "name string")
    return project.refused_pairs(read(spark, d, SPREAD), settings)


def contested_settings(spark: SparkSession, d: str) -> DataFrame:
    return project.contested_settings(table(spark, d, "lineitem").selectExpr("l_suppkey AS name", "l_partkey AS writer"))


def argument_evidence(spark: SparkSession, d: str) -> DataFrame:
    got = project.argument_evidence(read(spark, d, ARGUMENTS))
    return got.select("pos", F.array_join("literals", "|").alias("literals"), "from_variables")


def use_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d, AFTERS)
    return t.select("p_partkey", lines.use_kind(F.col("text")).alias("use"))


def sample_values(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, TYPES).select("p_partkey", lines.sample_value(F.col("text")).alias("sample"))


def symbol_names(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, SYMBOLS).select("p_partkey", lines.symbol_name(F.col("text")).alias("x")).select("p_partkey", "x.base", "x.module")


def test_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, TEST_NAMES).select("p_partkey", code.test_kind(F.col("text")).alias("kind"))


def role_labels(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, LABELS).select("p_partkey", lines.role_label(F.col("text")).alias("label"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", lines.stable_id(F.col("p_type"), F.col("p_name")).alias("id"))


def setting_types(spark: SparkSession, d: str) -> DataFrame:
    names = ("AppSettings", "ConfigReport", "cfg", "UiConfig", "Opts", "Optical", "userPrefs")
    return _texts(spark, d, names).select("p_partkey", lines.is_setting_type(F.col("text")).alias("setting"))


def library(spark: SparkSession, d: str) -> DataFrame:
    return project.is_library(read(spark, d, ROUTINES))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Customers as routines: those whose returned orders were their last calls."""
    o = table(spark, d, "orders")
    name = lambda flag: o.where(f"o_orderstatus {flag} 'F'").select(F.concat(F.lit("n"), "o_custkey").alias("name"))
    return project.orphans(name("=").distinct(), name("<>"), read(spark, d, ROUTINES))


def hot_files(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("path"), "event_type")
    return project.hot_files(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"))


def elapsed(spark: SparkSession, d: str) -> DataFrame:
    return project.elapsed(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


def outermost(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as nested pieces: even ones lie in the one before."""
    t = table(spark, d, "lineitem").selectExpr("l_orderkey AS path", "l_linenumber * 10 + (l_linenumber % 2) AS first", "CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber * 10 + 15 ELSE l_linenumber * 10 + 4 END AS last", "(l_orderkey + l_linenumber) % 3 <> 0 AS is_func")
    return project.outermost(t)


def cheap_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_size <= 5")
    chunks = p.selectExpr("p_partkey AS id", "p_brand AS repo", "p_size AS lines", "p_partkey % 3 = 0 AS words_only")
    k = p.select("p_partkey", "p_type", "p_size")
    pairs = k.withColumnRenamed("p_partkey", "a").join(k.withColumnRenamed("p_partkey", "b"), ["p_type"]).where("a < b").select("a", "b")
    return project.cheap_pairs(pairs, chunks, across=True)


def barriers(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as call sites; lines 2 and 3 lie in a try, lines 5 and 6 in one that catches all."""
    sites, regions = _tries(spark, d)
    return project.barriers(sites, regions).join(project.any_survives(sites, regions, "IOError"), "fn_id")


def _tries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sites = table(spark, d, "lineitem").where("l_partkey % 2 = 0 OR l_linenumber > 4").selectExpr("l_orderkey AS fn_id", "l_linenumber AS line")
    o = table(spark, d, "orders")
    one = o.selectExpr("o_orderkey AS fn_id", "2 AS first", "3 AS last", "CASE WHEN o_orderkey % 2 = 0 THEN array('IOError') ELSE array('OSError') END AS caught", "false AS catch_all")
    two = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS fn_id", "5 AS first", "6 AS last", "array() AS caught", "true AS catch_all")
    return sites, one.unionByName(two.withColumn("caught", F.col("caught").cast("array<string>")))


def spec_names(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' nations as modules of routines; names with and without a module are looked up."""
    r = table(spark, d, "supplier").selectExpr("s_suppkey AS fn_id", "'b' || (s_suppkey % 20) AS base", "'core.m' || s_nationkey AS module")
    given = table(spark, d, "nation").selectExpr("'m' || n_nationkey || '.b3' AS wanted", "n_nationkey AS rank")
    declared = table(spark, d, "region").selectExpr("CASE WHEN r_regionkey < 2 THEN 'b' || r_regionkey ELSE 'm' || r_regionkey || '.b3' END AS wanted", "100 + r_regionkey AS rank")
    both = project.merged_specs(given.selectExpr("wanted AS name", "rank"), declared.selectExpr("wanted AS name", "rank"))
    return project.matching(r, both.selectExpr("name AS wanted", "rank")).join(both.withColumnRenamed("name", "wanted"), "wanted")


def inlined(spark: SparkSession, d: str) -> DataFrame:
    """Users as files: signups are headers, other events instructions."""
    e = table(spark, d, "events")
    got = project.inlined_into(e.where("event_type <> 'signup'").selectExpr("event_type AS routine", "user_id AS file", "event_id AS line"), e.where("event_type = 'signup'").selectExpr("user_id AS file", "event_id AS line", "event_id AS owner"))
    return got.select("owner", F.array_join("routines", ",").alias("routines"))


def names_in_use(spark: SparkSession, d: str) -> DataFrame:
    return project.names_in_use(table(spark, d, "nation").selectExpr("n_name AS name"), table(spark, d, "region").selectExpr("lower(r_name) AS name"), table(spark, d, "region").selectExpr("r_name AS name"))


def type_radius(spark: SparkSession, d: str) -> DataFrame:
    """Customers of each order as results, its status as a parameter: what gives and what takes one type."""
    f = table(spark, d, "orders").selectExpr("o_orderkey AS fn_id", "'Seg' || (o_custkey % 30) AS return_type", "array(named_struct('name', 'x', 'type', 'Seg' || (o_orderkey % 40), 'direction', 'in')) AS sockets")
    makes, takes = project.type_radius(f, "seg3")
    return makes.select("fn_id", F.lit("gives").alias("side")).unionByName(takes.select("fn_id", F.lit("takes").alias("side"))).unionByName(project.producers(f, "Seg3").select("fn_id", F.lit("is").alias("side")))


def scatter_merged(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer in a status as a group: their span, and the groups that are spread."""
    o = table(spark, d, "orders").selectExpr("o_orderstatus AS path", "o_custkey AS grp", "o_orderkey AS line")
    s = code.strangers(o).withColumn("own_lines", F.col("own") * 2)
    f = project.scattered(s).selectExpr("path", "grp % 40 AS members", "'by ' || grp AS evidence")
    return project.merged_scatter(f)


def unused_imports(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files that import nations and segments, orders as their words."""
    i = table(spark, d, "customer").selectExpr("c_custkey AS path", "'a' || (c_custkey % 50) AS alias", "'m' || c_nationkey AS target", "CASE WHEN c_custkey % 4 = 0 THEN 'symbol' ELSE 'module' END AS kind")
    w = table(spark, d, "orders").selectExpr("o_custkey AS path", "CASE WHEN o_orderkey % 3 = 0 THEN 'a' || (o_custkey % 50) ELSE 'w' || (o_orderkey % 60) END AS word").distinct()
    e = table(spark, d, "nation").selectExpr("'m' || n_nationkey AS target", "CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 'w' || n_nationkey END AS name").where("target <> 'm7'")
    return project.unused_imports(i, w, e)


def ignored(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").selectExpr("source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'build/' ELSE 'src/' END || doc_id AS path", "n_chars AS lines")
    kept = table(spark, d, "documents").where("doc_id % 3 = 0").selectExpr("source || '/src/' || doc_id AS path")
    return project.ignored_stats(files, kept)


def doors(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, ROUTINES)
    return f.select("fn_id", project.is_door(F.lower("role"), F.col("name"), F.col("is_input")).alias("door"))


def input_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey", _case(f"p_partkey % {len(TYPES)}", TYPES) + " AS t")
    s = p.select("p_partkey", F.array(F.struct(F.lit("a").alias("name"), F.col("t").alias("type"), F.when(F.col("t").startswith("var"), "var").otherwise("in").alias("direction")), F.struct(F.lit("r").alias("name"), F.lit("int").alias("type"), F.lit("out").alias("direction"))).alias("s"))
    return s.select("p_partkey", lines.input_kind(F.col("s")).alias("kind"), lines.input_types(F.col("s")).alias("types"))


GRAPH = _dual("supplier", "s_suppkey AS src", "s_suppkey * 3 % 101 AS dst")
GRAPH_2 = _dual("supplier", "s_suppkey AS src", "(s_suppkey + 7) * 5 % 127 AS dst")
TREE = _dual("supplier", "CAST(floor((s_suppkey + 1) / 2) AS BIGINT) AS src", "CAST(s_suppkey + 1 AS BIGINT) AS dst")
ROLE = "CASE s_suppkey % 7 WHEN 1 THEN 'orchestrator' WHEN 2 THEN 'helper' WHEN 3 THEN 'parser' WHEN 4 THEN 'unknown' WHEN 5 THEN 'statecontroller' WHEN 6 THEN 'math' ELSE 'actor' END AS role"
RULES = (("r1", "div", "", (), ("red",), 0.3), ("r2", "", "i2", (), ("blue", "red"), 0.1), ("r3", "", "", ("c1",), ("green",), 0.0), ("r4", "p", "", ("c1", "c2"), ("white",), 0.9), ("r5", "", "", (), ("black",), 0.05))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, GRAPH).unionByName(read(spark, d, GRAPH_2))


def call_rings(spark: SparkSession, d: str) -> DataFrame:
    return project.rings(_edges(spark, d))


def longest_chains(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, TREE)
    got = project.longest_chain(e.selectExpr("src AS node").unionByName(e.selectExpr("dst AS node")), e)
    return got.select("node", "depth", F.array_join("chain", ">").alias("chain"))


def import_depths(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as modules that import two others; modules past the last are outside."""
    s = table(spark, d, "supplier")
    return project.import_depth(s.selectExpr("s_suppkey + 1 AS module", "s_suppkey * 2 + 2 AS target").unionByName(s.selectExpr("s_suppkey + 1 AS module", "s_suppkey * 2 + 3 AS target")))


def orchestrator_groups(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, TREE).selectExpr("src AS caller", "dst AS callee")
    return project.orchestrator_groups(table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS fn_id", ROLE), e)


def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS fn_id", ROLE)
    e = read(spark, d, TREE).selectExpr("src AS caller", "dst AS callee")
    return project.graph_summary(f, project.within_tree(e, f), table(spark, d, "nation"), project.orchestrator_groups(f, e))


def caller_reach(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS fn_id", "'n' || s_suppkey AS name", "CASE WHEN s_suppkey % 9 = 0 THEN 'tests/x' WHEN s_suppkey % 8 = 0 THEN 'examples/src/x' ELSE 'src/f' || (s_suppkey % 10) END AS path")
    files = table(spark, d, "region").selectExpr("'src/f' || r_regionkey AS path")
    got = project.caller_reach(project.changed_routines(f, files), read(spark, d, TREE).selectExpr("src AS caller", "dst AS callee"), f)
    return got.select("name", "callers", F.array_join("names", ",").alias("names"))


def file_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Nations as files of their customers; customers call some with lower keys."""
    f = table(spark, d, "customer").selectExpr("c_nationkey AS path", "c_custkey AS id", "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord")
    f = f.selectExpr("*", "ord * 20 + 1 AS line_start", "ord * 20 + 18 AS line_end")
    files = f.groupBy("path").agg((F.count(F.lit(1)) * 20).alias("lines"))
    calls = table(spark, d, "customer").selectExpr("c_custkey AS caller", "c_custkey - 1 - c_custkey % 300 AS callee")
    return project.cuts(files, f, calls)


def exclusive_branches(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "orders").selectExpr("o_orderkey AS fn_id", "1 AS i", "2 + o_custkey % 3 AS j", "o_orderkey % 4 AS indent", "o_orderkey % 2 = 0 AS on_head")
    return project.exclusive(pairs, table(spark, d, "lineitem").where("l_suppkey % 3 = 0").selectExpr("l_orderkey AS fn_id", "l_linenumber AS line", "l_partkey % 4 AS indent"))


def element_looks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").selectExpr("p_brand AS page_id", "p_partkey AS idx", "CASE p_size % 3 WHEN 0 THEN 'div' WHEN 1 THEN 'p' ELSE 'a' END AS tag", "'i' || (p_partkey % 5) AS id", "CASE p_partkey % 3 WHEN 0 THEN array('c1') WHEN 1 THEN array('c2', 'c1') ELSE array('c3') END AS classes")
    rules = spark.createDataFrame([(a, b, c, list(k), list(v), s) for a, b, c, k, v, s in RULES], "rule string, tag string, id string, classes array<string>, colours array<string>, seconds double")
    got = project.looks(e, rules)
    return got.select("idx", F.array_join("colours", ",").alias("colours"), "seconds", project.joined_colours(F.col("colours"), F.array(F.lit("red")), F.lit(True)).alias("joined"))


def list_fields(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").selectExpr("p_partkey AS type", "'f' AS field", _case(f"p_partkey % {len(TYPES)}", TYPES) + " AS field_type")
    return project.containers(f, "int").select("type")


def failure_fields(spark: SparkSession, d: str) -> DataFrame:
    fns = table(spark, d, "orders").selectExpr("o_orderkey AS fn_id", "CASE o_orderkey % 5 WHEN 0 THEN 'ref Loaded' WHEN 1 THEN 'seq[Made]' WHEN 2 THEN 'Plain' WHEN 3 THEN 'Option[Loaded]' ELSE '' END AS return_type")
    fields = spark.createDataFrame([("Loaded", "width", 0), ("Loaded", "Reason", 2), ("Loaded", "error", 1), ("Made", "ok", 0), ("Plain", "x", 0)], "type string, field string, ord int")
    return project.carrier_fields(fns, fields)


def abort_ways(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers under ten names with chains of one to five names to an abort or an exception."""
    s = table(spark, d, "supplier")
    e = s.selectExpr("s_suppkey AS fn_id", "'E' || (s_suppkey % 3) AS name", "CASE WHEN s_suppkey % 2 = 0 THEN 'abort' ELSE 'raise' END AS kind", "transform(sequence(1, 1 + s_suppkey % 5), x -> 'v' || (x + s_suppkey)) AS via")
    f = s.selectExpr("s_suppkey AS fn_id", "'n' || (s_suppkey % 10) AS name")
    far = project.abort_reach(e, f).select("name", F.lit("abort").alias("ending"), F.array_join("via", ">").alias("via"))
    return far.unionByName(project.yields(e, f, "n3").select(F.lit("n3").alias("name"), "ending", F.array_join("via", ">").alias("via")))


def embedded_code(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as files with a string of three lines: SQL, prose, Python, or the file's own language."""
    body = "CASE s_suppkey % 4 WHEN 0 THEN 'select a#from t#  where x = 1' WHEN 1 THEN 'some words#and more of them#to the end' WHEN 2 THEN 'def f(self):#    self.x = None#    import os' ELSE 'function a() {#  document.x = 1;#}' END"
    s = table(spark, d, "supplier").selectExpr("'x' || s_suppkey || '.js' AS path", f"split('const q = `#' || {body} || '#`; let y = 2;#let z = `one`;#', '#') AS t")
    return project.embedded(s.select("path", F.posexplode("t").alias("n", "text")).selectExpr("path", "CAST(n AS BIGINT) + 1 AS line", "text"))


def _top(name: str, spark: SparkSession, d: str) -> DataFrame:
    order, _ = ranking.ORDERS[name]
    columns = [c[0] if isinstance(c, tuple) else c.lstrip("-") for c in order]
    return ranking.ranked(read(spark, d, RANKED).select(*columns), name)


def _top_sql(name: str) -> str:
    order, most = ranking.ORDERS[name]
    columns, by = [], []
    for c in order:
        if isinstance(c, tuple):
            columns.append(c[0])
            by.append(f"coalesce(list_position([{', '.join(repr(v) for v in c[1:])}], {c[0]}), 99)")
        else:
            columns.append(c.lstrip("-"))
            by.append(c[1:] + " DESC" if c.startswith("-") else c)
    return f"WITH r AS ({sql(RANKED)}) SELECT {', '.join(columns)} FROM r ORDER BY {', '.join(by)}" + (f" LIMIT {most}" if most else "")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        called_names, passed_and_dotted, raises_and_pragmas, branch_census, platform_lines, unsafe_lines, input_routines, top_level, code_lengths, file_rows, nest_totals, refused, contested_settings, argument_evidence, use_kinds,
        sample_values, symbol_names, test_kinds, role_labels, stable_ids, setting_types, library, orphans, hot_files, elapsed, outermost, cheap_pairs, barriers, spec_names, inlined, names_in_use, type_radius, scatter_merged,
        unused_imports, ignored, doors, input_kinds, call_rings, longest_chains, import_depths, orchestrator_groups, graph_counts, caller_reach, file_cuts, exclusive_branches, element_looks, list_fields, failure_fields,
        abort_ways, embedded_code,
    )
}
QUERIES |= {f"top_{name}": partial(_top, name) for name in ranking.ORDERS}

BARE = """regexp_replace(regexp_replace(text, '"[^"]*"', '""', 'g'), '#.*$', '')"""
OWNED = "o AS (SELECT l.*, (SELECT arg_max(r, r.line_start) FROM r WHERE r.path = l.path AND r.line_start <= l.line) AS own FROM l), w AS (SELECT path, line, text, CASE WHEN own.line_end >= line THEN own END AS own FROM o)"
BASE = f"l AS ({sql(LINES)}), r AS ({sql(ROUTINES)}), s AS ({sql(SITES)})"


def _listed(values: tuple[str, ...], column: str) -> str:
    return _case(f"p_partkey % {len(values)}", values) + f" AS {column}"


ORACLE_SQL: dict[str, str] = {
    "called_names": f"WITH {BASE}, x AS (SELECT unnest(list_distinct(regexp_extract_all({BARE}, '([A-Za-z_]\\w*)\\s*(?:\\[[^\\[\\]]*\\])?\\(', 1))) AS name FROM l) SELECT name, count(*) AS n FROM x WHERE name NOT IN ('if', 'cast', 'and', 'quit_') GROUP BY name",
    "passed_and_dotted": f"WITH {BASE}, x AS (SELECT 'dotted' AS kind, unnest(regexp_extract_all({BARE}, '\\.\\s*([A-Za-z_]\\w*)', 1)) AS name FROM l UNION ALL SELECT 'passed', unnest(CASE text WHEN 'result = callee(a, b)' THEN ['a', 'b'] WHEN 'foo.bar(baz, qux)' THEN ['baz', 'qux'] WHEN '  raise newException(ValueError)' THEN ['ValueError'] WHEN '  x = cast[int](y)' THEN ['y'] WHEN 'when defined(ssl) and windows:' THEN ['ssl'] WHEN '    copyMem(a, b, 3)' THEN ['a', 'b'] WHEN 'for i in 0..3: discard readLine(stdin)' THEN ['stdin'] ELSE []::VARCHAR[] END) FROM l) SELECT kind, name, count(*) AS n FROM x GROUP BY ALL",
    "raises_and_pragmas": f"WITH {BASE}, x AS (SELECT CASE WHEN text LIKE '%raises:%' THEN [('raises', 'IOError'), ('raises', 'ValueError'), ('pragma', 'raises'), ('pragma', 'ValueError')] ELSE [('flag', 'ssl')] END AS a FROM l WHERE text LIKE '%raises:%' OR text LIKE '%defined(ssl)%'), y AS (SELECT unnest(a) AS p FROM x) SELECT p[1] AS kind, p[2] AS name, count(*) AS n FROM y GROUP BY ALL",
    "branch_census": f"WITH {BASE}, x AS (SELECT text, len(list_filter(regexp_split_to_array({BARE}, '[ ():,\\[\\]\\t]'), lambda w: w IN ('if', 'elif', 'while', 'for', 'case', 'of', 'and', 'or', 'try', 'except'))) AS words FROM l) SELECT words, count(*) AS n, count(*) FILTER (regexp_matches(trim(text), '^(of |elif |else:|else )')) AS heads, count(*) FILTER (text LIKE '%quit(%' AND text NOT LIKE '#%') AS aborts, count(*) FILTER (regexp_matches(lower(trim(text)), '^(raise|quit|error|abort|invalid|cannot)') OR regexp_matches(lower(trim(text)), '(raise|quit|error|abort|invalid|cannot) ')) AS refusals FROM x GROUP BY words",
    "platform_lines": f"WITH {BASE}, c AS (SELECT lower(text) AS t FROM l WHERE regexp_matches(trim(text), '^(when |#ifdef |#if )')) SELECT 'windows' AS platform, count(*) FILTER (contains(t, 'windows') OR contains(t, '_win32')) AS n FROM c UNION ALL SELECT 'linux', count(*) FILTER (contains(t, 'linux')) FROM c UNION ALL SELECT 'nixos', count(*) FILTER (contains(t, 'nix')) FROM c UNION ALL SELECT 'posix', count(*) FILTER (contains(t, 'posix')) FROM c UNION ALL SELECT 'AVX', count(*) FROM l WHERE contains(text, 'avx')",
    "unsafe_lines": f"WITH {BASE}, {OWNED} SELECT path, line, CASE WHEN contains(text, 'cast[') THEN 'cast' ELSE 'copyMem' END AS kind, coalesce(own.name, string_split(path, '/')[2]) AS name, coalesce(own.name, '') IN (SELECT name FROM r x WHERE x.path = w.path AND x.role <> 'Sanitizer' AND (x.is_input OR x.role = 'data_fetcher')) AS external FROM w WHERE contains(text, 'cast[') OR contains(text, 'copyMem(')",
    "input_routines": f"WITH {BASE} SELECT fn_id, path, name, CASE WHEN role = 'Sanitizer' THEN 'sanitizer' ELSE 'input' END AS role FROM r WHERE role = 'Sanitizer' OR is_input OR role = 'data_fetcher'",
    "top_level": f"WITH {BASE}, {OWNED}, x AS (SELECT path, unnest(regexp_extract_all({BARE}, '([A-Za-z_]\\w*)\\s*(?:\\[[^\\[\\]]*\\])?\\(', 1)) AS name FROM w WHERE own IS NULL) SELECT DISTINCT path, name FROM x WHERE name NOT IN ('if', 'cast')",
    "code_lengths": f"WITH {BASE} SELECT fn_id, greatest(1, (SELECT count(*) FROM l WHERE l.path = r.path AND line BETWEEN line_start AND line_end AND trim(text) <> '' AND text NOT LIKE '#%')) AS code FROM r",
    "file_rows": f"""WITH {BASE}, c AS (SELECT fn_id, greatest(1, (SELECT count(*) FROM l WHERE l.path = r.path AND line BETWEEN line_start AND line_end AND trim(text) <> '' AND text NOT LIKE '#%')) AS code FROM r),
        n AS (SELECT path, count(*) AS lines, count(*) FILTER (trim(text) <> '' AND text NOT LIKE '#%') AS code_lines FROM l GROUP BY path), k AS (SELECT fn_id, count(*) AS nested, max(depth) AS deepest FROM s WHERE depth > 1 GROUP BY fn_id), h AS (SELECT DISTINCT fn_id FROM s WHERE leaf)
        SELECT r.path, coalesce(n.lines, 0) AS lines, coalesce(n.code_lines, 0) AS code_lines, 1 AS functions, (decl_kind = 'template')::BIGINT AS templates, (decl_kind = 'macro')::BIGINT AS macros, (line_end - line_start + 1)::DOUBLE AS avg_lines, c.code::DOUBLE AS avg_code_lines, line_end - line_start + 1 AS max_lines, is_input::BIGINT AS inputs,
        coalesce(k.nested, 0) AS nested, coalesce(k.deepest, 1) AS deepest, (h.fn_id IS NULL)::BIGINT AS untested, coalesce(n.lines, 0) - coalesce(n.code_lines, 0) AS comment_lines, 'ok' AS health_with_comments, 'ok' AS health, false AS is_test
        FROM r JOIN c USING (fn_id) LEFT JOIN n ON n.path = r.path LEFT JOIN k ON k.fn_id = r.fn_id LEFT JOIN h ON h.fn_id = r.fn_id""",
    "nest_totals": f"WITH {BASE}, x AS (SELECT s.*, role = 'math' AS math, CASE WHEN inner_lines <= 2 THEN 0 WHEN inner_lines <= 5 THEN 1 WHEN inner_lines <= 10 THEN 2 WHEN inner_lines <= 20 THEN 3 WHEN inner_lines <= 40 THEN 4 ELSE 5 END AS bucket FROM s JOIN r USING (fn_id) WHERE depth > 1) SELECT count(*) FILTER (depth = 2) AS doubles, count(*) FILTER (depth = 3) AS triples, count(*) FILTER (depth > 3) AS deeper, count(DISTINCT fn_id) AS nested, count(DISTINCT fn_id) FILTER (math) AS math_nested, count(DISTINCT fn_id) FILTER (NOT math) AS other_nested, {', '.join(f'count(*) FILTER (leaf AND bucket = {k}) AS leaf_{k}' for k in range(6))} FROM x",
    "refused": f"WITH l AS ({sql(SPREAD)}), x AS (SELECT *, lead(text) OVER (PARTITION BY path ORDER BY line) AS nxt FROM l), y AS (SELECT CASE WHEN text LIKE 'if%' THEN 'a' ELSE 'alpha' END AS a, CASE WHEN text LIKE 'if%' THEN 'b' ELSE 'beta' END AS b, path, line FROM x WHERE (text = 'if a and b:' OR text = 'elif alpha or beta:') AND regexp_matches(lower(trim(nxt)), '^(raise|quit)')) SELECT a, b, arg_min(path, (path, line)) AS path, arg_min(line, (path, line)) AS line FROM y GROUP BY a, b",
    "contested_settings": "WITH w AS (SELECT DISTINCT l_suppkey AS name, l_partkey AS writer FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 2)) SELECT a.name AS a, b.name AS b, count(*) AS shared, round(least(0.99::DOUBLE, 0.4::DOUBLE + 0.1::DOUBLE * count(*)), 6) AS certainty FROM w a JOIN w b ON a.writer = b.writer AND a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 2",
    "argument_evidence": f"WITH x AS ({sql(ARGUMENTS)}), y AS (SELECT pos, trim(text) AS t, regexp_matches(trim(text), '^([\"'']|-?[0-9])') OR trim(text) IN ('true', 'false', 'nil', '@[]') AS lit FROM x) SELECT pos, array_to_string(list_sort(list_distinct(list(t) FILTER (lit))), '|') AS literals, count(*) FILTER (NOT lit) AS from_variables FROM y GROUP BY pos",
    "use_kinds": f"SELECT p_partkey, CASE p_partkey % {len(AFTERS)} WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 2 WHEN 8 THEN 2 WHEN 11 THEN 2 ELSE 0 END AS use FROM part",
    "sample_values": f"SELECT p_partkey, {_case(f'p_partkey % {len(SAMPLES)}', tuple(x.replace(chr(39), chr(39) * 2) for x in SAMPLES))} AS sample FROM part",
    "symbol_names": f"SELECT p_partkey, {_listed(BASES, 'base')}, {_listed(MODULES, 'module')} FROM part",
    "test_kinds": f"SELECT p_partkey, {_listed(KINDS, 'kind')} FROM part",
    "role_labels": f"SELECT p_partkey, {_listed(LABELLED, 'label')} FROM part",
    "stable_ids": "SELECT p_partkey, trim(regexp_replace(lower(p_type || '-' || p_name), '[^a-z0-9_]+', '-', 'g'), '-') AS id FROM part",
    "setting_types": "SELECT p_partkey, p_partkey % 7 NOT IN (1, 5) AS setting FROM part",
    "library": f"WITH {BASE} SELECT count(*) >= 8 AND 2 * count(*) FILTER (exported) >= count(*) AS library FROM r WHERE decl_kind = 'proc'",
    "orphans": f"WITH {BASE}, g AS (SELECT DISTINCT 'n' || o_custkey AS name FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')) SELECT name, arg_min(path, (path, line_start)) AS path, arg_min(line_start, (path, line_start)) AS line FROM r SEMI JOIN g USING (name) GROUP BY name",
    "hot_files": "SELECT user_id AS path, count(*) FILTER (event_type = 'purchase') AS yours, count(*) FILTER (event_type = 'error') AS nearby FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1",
    "elapsed": "SELECT user_id, event_id, event_id - min(event_id) OVER (PARTITION BY user_id) AS since_first, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events",
    "outermost": """WITH p AS (SELECT DISTINCT l_orderkey AS path, l_linenumber * 10 + (l_linenumber % 2) AS first, CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber * 10 + 15 ELSE l_linenumber * 10 + 4 END AS last, (l_orderkey + l_linenumber) % 3 <> 0 AS is_func FROM lineitem),
        k AS (SELECT * FROM p WHERE is_func OR NOT EXISTS (SELECT 1 FROM p q WHERE q.path = p.path AND q.is_func AND q.first > p.first AND q.last <= p.last)) SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k q WHERE q.path = k.path AND q.first < k.first AND q.last >= k.last)""",
    "cheap_pairs": "WITH p AS (SELECT * FROM part WHERE p_size <= 5) SELECT a.p_partkey AS a, b.p_partkey AS b FROM p a JOIN p b ON a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE (a.p_partkey % 3 = 0) = (b.p_partkey % 3 = 0) AND least(a.p_size, b.p_size) >= 0.4 * greatest(a.p_size, b.p_size) AND a.p_brand <> b.p_brand",
    "barriers": """WITH c AS (SELECT l_orderkey AS fn_id, l_linenumber AS line, l_linenumber BETWEEN 5 AND 6 AND l_orderkey % 3 = 0 AS whole, l_linenumber BETWEEN 2 AND 3 AND l_orderkey % 2 = 0 AS io FROM lineitem WHERE l_partkey % 2 = 0 OR l_linenumber > 4) SELECT fn_id, bool_and(whole) AS barrier, bool_or(NOT whole AND NOT io) AS survives FROM c GROUP BY fn_id""",
    "spec_names": """WITH g AS (SELECT 'm' || n_nationkey || '.b3' AS wanted, n_nationkey AS rank FROM nation), x AS (SELECT CASE WHEN r_regionkey < 2 THEN 'b' || r_regionkey ELSE 'm' || r_regionkey || '.b3' END AS wanted, 100 + r_regionkey AS rank FROM region), b AS (SELECT * FROM g UNION ALL SELECT * FROM x WHERE wanted NOT IN (SELECT wanted FROM g))
        SELECT wanted, s_suppkey AS fn_id, rank FROM b JOIN supplier ON CASE WHEN contains(wanted, '.') THEN s_suppkey % 20 = 3 AND wanted = 'm' || s_nationkey || '.b3' ELSE wanted = 'b' || (s_suppkey % 20) END""",
    "inlined": "WITH x AS (SELECT event_type, (SELECT max(h.event_id) FROM events h WHERE h.event_type = 'signup' AND h.user_id = e.user_id AND h.event_id <= e.event_id) AS owner FROM events e WHERE event_type <> 'signup' AND event_id > 0) SELECT owner, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS routines FROM x WHERE owner IS NOT NULL GROUP BY owner",
    "names_in_use": "SELECT lower(n_name) AS name FROM nation UNION SELECT lower(r_name) FROM region",
    "type_radius": "SELECT o_orderkey AS fn_id, 'gives' AS side FROM orders WHERE o_custkey % 30 = 3 UNION ALL SELECT o_orderkey, 'takes' FROM orders WHERE o_orderkey % 40 = 3 OR o_orderkey % 40 BETWEEN 30 AND 39 UNION ALL SELECT o_orderkey, 'is' FROM orders WHERE o_custkey % 30 = 3",
    "scatter_merged": """WITH o AS (SELECT o_orderstatus AS path, o_custkey AS grp, o_orderkey AS line, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS pos FROM orders), g AS (SELECT path, grp, min(line) AS first, max(line) AS last, count(*) AS own, max(pos) - min(pos) + 1 - count(*) AS strangers FROM o GROUP BY path, grp)
        SELECT path, grp % 40 AS members, count(*) AS callers, min('by ' || grp) AS evidence FROM g WHERE strangers >= 4 AND own * 6 < last - first + 1 GROUP BY 1, 2""",
    "unused_imports": """WITH i AS (SELECT c_custkey AS path, 'a' || (c_custkey % 50) AS alias, 'm' || c_nationkey AS target, CASE WHEN c_custkey % 4 = 0 THEN 'symbol' ELSE 'module' END AS kind, c_nationkey AS k FROM customer), w AS (SELECT DISTINCT o_custkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || (o_custkey % 50) ELSE 'w' || (o_orderkey % 60) END AS word FROM orders)
        SELECT path, alias, target, kind FROM i WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.path = i.path AND word = alias) AND (kind = 'symbol' OR (k % 6 <> 0 AND k <> 7 AND NOT EXISTS (SELECT 1 FROM w WHERE w.path = i.path AND word = 'w' || k)))""",
    "ignored": "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS lines FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0",
    "doors": f"WITH {BASE} SELECT fn_id, role <> 'Sanitizer' AND (is_input OR role = 'data_fetcher') AS door FROM r",
    "input_kinds": f"SELECT p_partkey, CASE p_partkey % {len(TYPES)} WHEN 3 THEN 3 WHEN 1 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 8 THEN 2 WHEN 11 THEN 2 ELSE 1 END AS kind, {_listed(('int', 'seq[int]', 'option[string]', 'float', 'seq[seq[bool]]', 'table[string,int]', 'node', 'node', 'array[3,int]', 'set[char]', '', 'seq[option[char]]', 'option[]', 'jsonnode'), 'types')} FROM part",
}
ROLES = f"f AS (SELECT CAST(s_suppkey AS BIGINT) AS fn_id, {ROLE} FROM supplier), t AS ({sql(TREE)})"
GROUPED = f"""{ROLES}, g AS (SELECT fn_id AS head, fn_id AS node FROM f WHERE role = 'orchestrator' UNION SELECT g.head, t.dst FROM g JOIN t ON t.src = g.node JOIN f ON f.fn_id = t.dst WHERE f.role NOT IN ('orchestrator', 'statecontroller')), m AS (SELECT head, node FROM g JOIN f ON f.fn_id = node WHERE head <> node AND role IN ('helper', 'parser', 'actor', 'math'))"""
_STYLE = ", ".join(f"('{a}', '{b}', '{c}', {list(k)}::VARCHAR[], {list(v)}::VARCHAR[], {s}::DOUBLE)" for a, b, c, k, v, s in RULES)
ORACLE_SQL |= {
    "call_rings": f"WITH RECURSIVE e AS ({sql(GRAPH)} UNION {sql(GRAPH_2)}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT a.src AS node, least(a.src, min(a.dst)) AS ring FROM c a JOIN c b ON a.dst = b.src AND b.dst = a.src GROUP BY a.src",
    "longest_chains": f"WITH RECURSIVE e AS ({sql(TREE)}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT node AS top, node, 1 AS depth, [node::VARCHAR] AS chain FROM n UNION ALL SELECT top, dst, depth + 1, list_append(chain, dst::VARCHAR) FROM c JOIN e ON e.src = c.node) SELECT top AS node, CAST(max(depth) AS BIGINT) AS depth, array_to_string(arg_min(chain, (-depth, chain)), '>') AS chain FROM c GROUP BY top",
    "import_depths": "WITH RECURSIVE i AS (SELECT s_suppkey + 1 AS module, s_suppkey * 2 + 2 AS target FROM supplier UNION ALL SELECT s_suppkey + 1, s_suppkey * 2 + 3 FROM supplier), c AS (SELECT s_suppkey + 1 AS top, s_suppkey + 1 AS module, 1 AS depth FROM supplier UNION ALL SELECT top, target, depth + 1 FROM c JOIN i USING (module) WHERE target IN (SELECT s_suppkey + 1 FROM supplier)) SELECT top AS module, CAST(max(depth) AS BIGINT) AS depth FROM c GROUP BY top",
    "orchestrator_groups": f'WITH RECURSIVE {GROUPED} SELECT DISTINCT head AS "group", node AS member FROM m',
    "graph_counts": f"WITH RECURSIVE {GROUPED} SELECT 'functions' AS what, count(*) AS n FROM f UNION ALL SELECT 'edges', count(*) FROM t WHERE src IN (SELECT fn_id FROM f) AND dst IN (SELECT fn_id FROM f) UNION ALL SELECT 'unresolved', count(*) FROM nation UNION ALL SELECT 'groups', count(DISTINCT head) FROM m UNION ALL SELECT 'role ' || role, count(*) FROM f GROUP BY role",
    "caller_reach": f"""WITH RECURSIVE t AS ({sql(TREE)}), f AS (SELECT CAST(s_suppkey AS BIGINT) AS fn_id, 'n' || s_suppkey AS name, s_suppkey % 9 <> 0 AND s_suppkey % 8 <> 0 AND s_suppkey % 10 < 5 AS hit FROM supplier), c AS (SELECT name, fn_id AS top, fn_id AS node, 0 AS hops FROM f WHERE hit UNION SELECT name, top, src, hops + 1 FROM c JOIN t ON t.dst = c.node WHERE hops < 3)
        SELECT c.name, count(DISTINCT node) AS callers, array_to_string(list_sort(list_distinct(list(f.name)))[1:5], ',') AS names FROM c JOIN f ON f.fn_id = node WHERE node <> top GROUP BY c.name""",
    "file_cuts": """WITH f AS (SELECT c_nationkey AS path, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord FROM customer), n AS (SELECT path, count(*) AS n FROM f GROUP BY path HAVING count(*) >= 35), k AS (SELECT f.path, ord AS cut, n FROM f JOIN n USING (path) WHERE ord >= greatest(2, n * 30 // 100) AND ord <= n - greatest(2, n * 30 // 100) AND least(ord * 20 - 2, (n - ord) * 20 - 2) >= n * 20 * 30 // 100),
        c AS (SELECT a.path, b.id, b.ord AS pos, max(a.ord) AS last FROM f a JOIN f b ON b.id = a.id - 1 - a.id % 300 AND a.path = b.path AND a.ord > b.ord GROUP BY 1, 2, 3), w AS (SELECT k.path, cut, (SELECT count(*) FROM c WHERE c.path = k.path AND pos < cut AND last >= cut) AS waist FROM k), b AS (SELECT path, arg_min(cut, (waist, cut)) AS above, min(waist) AS waist FROM w GROUP BY path)
        SELECT path, above, above * 20 + 1 AS line, waist FROM b WHERE waist <= 12 AND waist * 100 <= above * 40""",
    "exclusive_branches": "SELECT fn_id, i, j FROM (SELECT o_orderkey AS fn_id, 1 AS i, 2 + o_custkey % 3 AS j, o_orderkey % 4 AS indent, o_orderkey % 2 = 0 AS on_head FROM orders) p WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey % 3 = 0 AND l_orderkey = fn_id AND l_linenumber > i AND l_linenumber <= j AND (l_partkey % 4 < indent OR (on_head AND l_partkey % 4 = indent)))",
    "element_looks": f"""WITH r(rule, tag, id, classes, colours, seconds) AS (VALUES {_STYLE}), e AS (SELECT p_partkey AS idx, CASE p_size % 3 WHEN 0 THEN 'div' WHEN 1 THEN 'p' ELSE 'a' END AS tag, 'i' || (p_partkey % 5) AS id, CASE p_partkey % 3 WHEN 0 THEN ['c1'] WHEN 1 THEN ['c2', 'c1'] ELSE ['c3'] END AS classes FROM part),
        m AS (SELECT idx, list_sort(list_distinct(flatten(list(r.colours)))) AS c, max(seconds) AS seconds FROM e JOIN r ON (r.tag = '' OR r.tag = e.tag) AND (r.id = '' OR r.id = e.id) AND list_has_all(e.classes, r.classes) GROUP BY idx) SELECT idx, array_to_string(c, ',') AS colours, seconds, list_contains(c, 'red')::INT::DOUBLE AS joined FROM m""",
    "list_fields": f"SELECT p_partkey AS type FROM part WHERE p_partkey % {len(TYPES)} IN (1, 5, 8)",
    "failure_fields": "SELECT o_orderkey AS fn_id, CASE WHEN o_orderkey % 5 = 1 THEN 'ok' ELSE 'error' END AS field FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)",
    "abort_ways": """WITH e AS (SELECT 'n' || (s_suppkey % 10) AS name, 'E' || (s_suppkey % 3) AS ending, CASE WHEN s_suppkey % 2 = 0 THEN 'abort' ELSE 'raise' END AS kind, list_transform(range(1, 2 + s_suppkey % 5), lambda x: 'v' || (x + s_suppkey)) AS via FROM supplier)
        SELECT name, 'abort' AS ending, array_to_string(arg_min(via, (len(via), via)), '>') AS via FROM e WHERE kind = 'abort' AND len(via) >= 3 GROUP BY name UNION ALL SELECT 'n3', ending, array_to_string(arg_min(via, (len(via), via)), '>') FROM e WHERE name = 'n3' GROUP BY kind, ending""",
    "embedded_code": "SELECT 'x' || s_suppkey || '.js' AS path, 1 AS line, 3 AS lines, CASE WHEN s_suppkey % 4 = 0 THEN 'sql' ELSE 'python' END AS language, CASE WHEN s_suppkey % 4 = 0 THEN 4 ELSE 8 END AS score FROM supplier WHERE s_suppkey % 2 = 0",
}
ORACLE_SQL |= {f"top_{name}": _top_sql(name) for name in ranking.ORDERS}
