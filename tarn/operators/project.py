"""Project tables: files and their routines, imports, names in use, changes, types and styles. Inputs are tables of paths, lines and routines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import code, lines
from tarn.operators import graph, tallies
from tarn.session import stored

#: A file is looked at for a cut from so many lines and routines on; bounds of the halves and of the waist (fixed values).
CUT_LINES, CUT_ROUTINES, CUT_BALANCE, WAIST_MOST, WAIST_PERCENT = 700, 12, 30, 12, 40


def is_code(line: Column) -> Column:
    return (F.trim(line) != "") & ~F.trim(line).startswith("#")


def code_lengths(functions: DataFrame, text: DataFrame) -> DataFrame:
    """(fn_id, code): code lines of each routine, one at least; text(path, line, text).

    Lines count up along their file, so the code of a span is the difference of two sums, and no line meets a routine's range.
    Rows of one line number count together, so each of them has the same sum, whichever comes last.
    """
    w = Window.partitionBy("path").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = text.select("path", "line", F.sum(is_code(F.col("text")).cast("long")).over(w).alias("sum"))
    ends = functions.select("fn_id", "path", F.explode(F.array(F.struct((F.col("line_start") - 1).alias("line"), F.lit(-1).alias("sign")), F.struct(F.col("line_end").alias("line"), F.lit(1).alias("sign")))).alias("e")).select("fn_id", "path", "e.line", "e.sign")
    at = graph.nearest_before(ends, sums, "path", "line", "sum")
    return at.groupBy("fn_id").agg(F.greatest(F.lit(1), F.sum(F.col("sign") * F.coalesce("sum", F.lit(0)))).cast("long").alias("code"))


def file_rows(files: DataFrame, functions: DataFrame, text: DataFrame, sites: DataFrame, cover: DataFrame) -> DataFrame:
    """A row of each file, those without routines too: counts, averages, nesting, inputs, untested, health with and without comments.

    files(path), sites(fn_id, depth), cover(fn_id, hits); functions has fn_id, path, decl_kind, line_start, line_end, is_input.
    """
    n = text.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_if(is_code(F.col("text"))).alias("code_lines"))
    nest = sites.groupBy("fn_id").agg(F.count(F.lit(1)).alias("nested"), F.max("depth").alias("deepest"))
    f = functions.join(code_lengths(functions, text), "fn_id", "left").join(nest, "fn_id", "left").join(cover.select("fn_id", "hits"), "fn_id", "left")
    length = F.col("line_end") - F.col("line_start") + 1
    per = f.groupBy("path").agg(
        F.count(F.lit(1)).alias("functions"), F.count_if(F.col("decl_kind") == "template").alias("templates"), F.count_if(F.col("decl_kind") == "macro").alias("macros"),
        F.round(F.avg(length), 6).alias("avg_lines"), F.round(F.avg("code"), 6).alias("avg_code_lines"), F.max(length).alias("max_lines"), F.count_if("is_input").alias("inputs"),
        F.coalesce(F.sum("nested"), F.lit(0)).alias("nested"), F.coalesce(F.max("deepest"), F.lit(1)).alias("deepest"), F.count_if(F.coalesce("hits", F.lit(0)) == 0).alias("untested"),
    )
    zero = ("lines", "code_lines", "functions", "templates", "macros", "avg_lines", "avg_code_lines", "max_lines", "inputs", "nested", "untested")
    got = files.select("path").join(n, "path", "left").join(per, "path", "left").fillna(0, list(zero)).fillna(1, ["deepest"])
    return got.withColumns({"comment_lines": F.col("lines") - F.col("code_lines"), "health_with_comments": tallies.health_of(F.col("avg_lines")), "health": tallies.health_of(F.col("avg_code_lines")), "is_test": code.is_test(F.col("path"))})


def nest_stats(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: sites at depth 2, 3 and deeper, nested routines by whether their role is math, and leaves by size."""
    s = sites.join(functions.select("fn_id", (F.col("role") == "math").alias("math")), "fn_id")
    leaf = [F.count_if(F.col("leaf") & (tallies.inner_bucket(F.col("inner_lines")) == k)).alias(f"leaf_{k}") for k in range(6)]
    fns = lambda cond: F.count_distinct(F.when(cond, F.col("fn_id")))
    return s.agg(F.count_if(F.col("depth") == 2).alias("doubles"), F.count_if(F.col("depth") == 3).alias("triples"), F.count_if(F.col("depth") > 3).alias("deeper"), fns(F.lit(True)).alias("nested"), fns(F.col("math")).alias("math_nested"), fns(~F.col("math")).alias("other_nested"), *leaf)


def ignored_stats(files: DataFrame, kept: DataFrame) -> DataFrame:
    """(n, lines) of own files that version control does not keep; files(path, lines), kept(path)."""
    return files.where(~code.is_ignored(F.col("path"))).join(kept.select("path").distinct(), "path", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def platform_counts(text: DataFrame) -> DataFrame:
    """(platform, n): conditions that name each platform, those without any too."""
    hits = text.where(lines.is_condition(F.col("text"))).select(F.explode(lines.platforms(F.col("text"))).alias("platform")).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))
    every = text.sparkSession.createDataFrame([(p,) for p in ("windows", "linux", "nixos", "posix")], "platform string")
    return every.join(hits, "platform", "left").fillna(0, ["n"])


def input_rows(functions: DataFrame) -> DataFrame:
    """(fn_id, path, name, role): routines that take input from outside, and those that clean it."""
    role = lines.role_label(F.coalesce("role", F.lit("")))
    return functions.select("fn_id", "path", "name", F.when(role == "sanitizer", "sanitizer").when(F.col("is_input") | role.isin("data fetcher", "input"), "input").alias("role")).where("role IS NOT NULL")


def owners(points: DataFrame, functions: DataFrame) -> DataFrame:
    """Points (path, line, ...) with the innermost routine that begins at or before their line and has not ended, else null."""
    marks = functions.select("path", F.col("line_start").alias("line"), F.struct("fn_id", "name", "line_end").alias("owner"))
    got = graph.nearest_before(points, marks, "path", "line", "owner")
    return got.withColumn("owner", F.when(F.col("owner.line_end") >= F.col("line"), F.col("owner")))


def unsafe_rows(text: DataFrame, functions: DataFrame, inputs: DataFrame) -> DataFrame:
    """(path, line, kind, name, external): unsafe lines, the routine around them (else the file), and whether that takes input."""
    k = text.withColumn("kind", lines.unsafe_kind(F.col("text"), code.extension(F.col("path")))).where("kind IS NOT NULL").select("path", "line", "kind")
    o = owners(k, functions).select("path", "line", "kind", F.coalesce("owner.name", F.regexp_extract("path", r"[^/]*$", 0)).alias("name"))
    i = inputs.select("path", F.lower("name").alias("_n"), F.lit(True).alias("external")).distinct()
    return o.withColumn("_n", F.lower("name")).join(i, ["path", "_n"], "left").drop("_n").fillna(False, ["external"])


def split_tests(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routines of source files and of tests."""
    test = code.is_test(F.col("path"))
    return functions.where(~test), functions.where(test)


def is_library(functions: DataFrame) -> DataFrame:
    """One row: whether there are eight routines or more, templates and macros aside, and half of them or more are exported."""
    f = functions.where(~F.col("decl_kind").isin("template", "macro"))
    return f.agg((F.count(F.lit(1)) >= 8).alias("_some"), F.avg(F.col("exported").cast("double")).alias("_share")).select((F.col("_some") & (F.coalesce("_share", F.lit(0.0)) >= 0.5)).alias("library"))


def exported_names(text: DataFrame) -> DataFrame:
    """(path, name) of names declared with a star, and (path, null) for files that pass others on, so that nothing can be told of them."""
    t = F.trim("text")
    shallow = (F.length("text") - F.length(F.ltrim("text"))) <= 2
    head = F.regexp_extract(t, r"^(?:(?:proc|func|method|iterator|template|macro|converter|const|let|var|type)\s+)?`?(\w+)`?\*", 1)
    rows = text.where(shallow & is_code(F.col("text")))
    return rows.where(t.startswith("export ") | (head != "")).select("path", F.when(~t.startswith("export "), head).alias("name")).distinct()


def unused_imports(imports: DataFrame, words: DataFrame, exports: DataFrame) -> DataFrame:
    """Imports (path, alias, target, kind symbol|module) of which the file uses neither the alias nor, for a module that is known and not opaque, any exported name.

    words(path, word): words of each file without its import lines; exports(target, name) with a null name if opaque.
    """
    own = imports.where(F.length("alias") > 1).join(words.select("path", F.col("word").alias("alias")), ["path", "alias"], "left_anti")
    modules = own.where("kind <> 'symbol'")
    known = modules.join(exports.select("target").distinct(), "target", "left_semi").join(exports.where("name IS NULL").select("target").distinct(), "target", "left_anti")
    used = known.join(exports.where("name IS NOT NULL"), "target").join(words.select("path", F.col("word").alias("name")), ["path", "name"], "left_semi").select("path", "alias", "target").distinct()
    left = known.join(used, ["path", "alias", "target"], "left_anti")
    return own.where("kind = 'symbol'").unionByName(left).select(*imports.columns)


def within_tree(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges (caller, callee) whose ends are both known."""
    ids = functions.select("fn_id").distinct()
    return edges.join(ids.withColumnRenamed("fn_id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("fn_id", "callee"), "callee", "left_semi").select("caller", "callee")


def rings(edges: DataFrame) -> DataFrame:
    """(node, ring): nodes of (src, dst) that reach themselves, by the least node of their ring.

    Nodes without a way in or out are taken off until only rings, and ways between them, are left; then least names are
    passed along edges both ways until they stand still.
    """
    left = stored(edges.select("src", "dst").distinct())
    while True:
        ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        fewer = stored(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        if fewer.count() == left.count():
            break
        left = fewer
    reach = graph.within(left, left.select(F.col("src").alias("node")).distinct(), include=False) if left.limit(1).count() else None
    if reach is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("ring")).limit(0)
    pairs = stored(reach.select("seed", "node").unionByName(left.where("src = dst").select(F.col("src").alias("seed"), F.col("dst").alias("node"))).distinct())
    back = pairs.select(F.col("node").alias("seed"), F.col("seed").alias("node"))
    mutual = pairs.join(back, ["seed", "node"], "left_semi")
    loops = left.join(pairs.select(F.col("seed").alias("dst"), F.col("node").alias("src")), ["src", "dst"], "left_semi").select(F.col("src").alias("seed"), F.col("src").alias("node"))
    return mutual.unionByName(loops).groupBy(F.col("seed").alias("node")).agg(F.min("node").alias("_o")).select("node", F.least("node", "_o").alias("ring"))


def longest_chain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth, chain): of each node that no ring holds or feeds on, the longest way down; of equally long ones the least names."""
    known = stored(nodes.select("node").distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(1).cast("long").alias("depth"), F.array(F.col("node").cast("string")).alias("chain")))
    outs = stored(edges.select("src", "dst").distinct())
    need = stored(outs.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
    while True:
        best = F.max_by("chain", F.struct("depth"))
        ready = outs.join(known.select(F.col("node").alias("dst"), "depth", "chain"), "dst").groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.max("depth").alias("d"), F.min(F.struct((-F.col("depth")).alias("o"), "chain"))["chain"].alias("best")).join(need, "src").where("k = n")
        new = stored(ready.select(F.col("src").alias("node"), (F.col("d") + 1).alias("depth"), F.concat(F.array(F.col("src").cast("string")), "best").alias("chain")).join(known.select("node"), "node", "left_anti"))
        if not new.limit(1).count():
            return known
        known = stored(known.unionByName(new))


def import_depth(imports: DataFrame) -> DataFrame:
    """(module, depth) over imports(module, target) between local modules: 1 for one that imports none; modules outside count 0. Rings and what feeds on them are left to ``rings``."""
    local = imports.select("module").distinct()
    edges = imports.join(local.withColumnRenamed("module", "target"), "target", "left_semi").select(F.col("module").alias("src"), F.col("target").alias("dst")).distinct()
    return graph.depths(local.select(F.col("module").alias("node")), edges).select(F.col("node").alias("module"), "depth")


def is_door(role: Column, name: Column, takes_input: Column) -> Column:
    from tarn.operators.reports import is_sanitizer

    return ~is_sanitizer(role, name) & (takes_input | F.coalesce(F.lower(role).isin("datafetcher", "data_fetcher", "input"), F.lit(False)))


def orchestrator_groups(functions: DataFrame, edges: DataFrame, groupable: tuple[str, ...] = ("helper", "wrapper", "parser", "truthbuilder", "datafetcher", "actor", "sanitizer", "math")) -> DataFrame:
    """(group, member): what lies below each orchestrator, down to other orchestrators and state controllers, in roles that can be grouped."""
    stops = ("orchestrator", "metaorchestrator", "statecontroller")
    roles = stored(functions.select("fn_id", "role"))
    open_ = roles.where(~F.col("role").isin(*stops)).select(F.col("fn_id").alias("callee"))
    way = edges.join(open_, "callee", "left_semi").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    heads = roles.where(F.col("role").isin("orchestrator", "metaorchestrator")).select(F.col("fn_id").alias("node"))
    got = graph.within(way, heads, include=False)
    return got.join(roles.where(F.col("role").isin(*groupable)).select(F.col("fn_id").alias("node")), "node", "left_semi").select(F.col("seed").alias("group"), F.col("node").alias("member")).where("group <> member").distinct()


def removed_calls(removed: DataFrame) -> DataFrame:
    """Names called on removed lines (path, text), each once."""
    return removed.select(F.explode(lines.names_called(F.col("text"))).alias("name")).distinct()


def orphans(cut: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(name, path, line): routines whose last call is among the removed ones, the first of each name; cut(name), calls(name)."""
    gone = cut.withColumn("_n", F.lower("name")).join(calls.select(F.lower("name").alias("_n")).distinct(), "_n", "left_anti").select("name")
    return functions.join(gone, "name", "left_semi").groupBy("name").agg(F.min(F.struct("path", F.col("line_start").alias("line"))).alias("x")).select("name", "x.path", "x.line")


def changed_routines(functions: DataFrame, files: DataFrame) -> DataFrame:
    return functions.where(code.is_src(F.col("path")) & ~F.col("path").startswith("examples/")).join(files.select("path").distinct(), "path", "left_semi")


def caller_reach(changed: DataFrame, edges: DataFrame, functions: DataFrame, hops: int = 3) -> DataFrame:
    """(name, callers, names): of each changed routine's name how many routines call it within ``hops``, and five of their names."""
    seeds = changed.select(F.col("fn_id").alias("node"), F.col("name").alias("routine"))
    up = edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    got = graph.within(up, seeds.select("node"), hops, include=False).select(F.col("seed").alias("n0"), "node").join(seeds.withColumnRenamed("node", "n0"), "n0").join(functions.select(F.col("fn_id").alias("node"), "name"), "node")
    return got.groupBy("routine").agg(F.count_distinct("node").alias("callers"), F.slice(F.array_sort(F.collect_set("name")), 1, 5).alias("names")).select(F.col("routine").alias("name"), "callers", "names")


def hot_files(yours: DataFrame, nearby: DataFrame) -> DataFrame:
    """(path, yours, nearby): findings of each file on changed lines and off them."""
    both = yours.select("path", F.lit(1).alias("y")).unionByName(nearby.select("path", F.lit(0).alias("y")))
    return both.groupBy("path").agg(F.sum("y").cast("long").alias("yours"), F.sum(1 - F.col("y")).cast("long").alias("nearby"))


def merged_specs(given: DataFrame, declared: DataFrame) -> DataFrame:
    """Given specifications, and of the declared ones those whose name is not given."""
    return given.unionByName(declared.join(given.select("name"), "name", "left_anti").select(*given.columns))


def matching(routines: DataFrame, names: DataFrame) -> DataFrame:
    """(wanted, fn_id): routines (fn_id, base, module) that a name means, alone or after its module."""
    n = names.select("wanted", F.substring_index("wanted", ".", -1).alias("base"), F.when(F.contains("wanted", F.lit(".")), F.regexp_replace("wanted", r"\.[^.]*$", "")).alias("_m"))
    return routines.join(n, "base").where(F.col("_m").isNull() | (F.col("module") == F.col("_m")) | F.col("module").endswith(F.concat(F.lit("."), "_m"))).select("wanted", "fn_id")


def inlined_into(instructions: DataFrame, headers: DataFrame) -> DataFrame:
    """(owner, routines): of each source routine the machine routines that hold lines of it; instructions(routine, file, line), headers(file, line, owner)."""
    at = graph.nearest_before(instructions.where("line > 0"), headers, "file", "line", "owner").where("owner IS NOT NULL")
    return at.groupBy("owner").agg(F.array_sort(F.collect_set("routine")).alias("routines"))


def refused_pairs(text: DataFrame, settings: DataFrame) -> DataFrame:
    """(a, b, path, line): the first two settings that a guard line names if the next line refuses, each pair once; text(path, line, text), settings(name)."""
    t = F.trim("text")
    w = Window.partitionBy("path").orderBy("line")
    guards = text.withColumn("_next", F.lead("text").over(w)).where((t.startswith("if ") | t.startswith("elif ")) & t.rlike(" (and|or) ") & lines.refuses(F.coalesce("_next", F.lit(""))))
    named = guards.select("path", "line", F.posexplode(F.split(F.col("text"), r"\W+")).alias("at", "name")).join(settings.select("name").distinct(), "name")
    pair = named.groupBy("path", "line", "name").agg(F.min("at").alias("at")).groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("n")).where(F.size("n") >= 2)
    return pair.groupBy(F.col("n")[0]["name"].alias("a"), F.col("n")[1]["name"].alias("b")).agg(F.min(F.struct("path", "line")).alias("x")).select("a", "b", "x.path", "x.line")


def contested_settings(writes: DataFrame) -> DataFrame:
    """(a, b, shared, certainty): settings that are each written twice or more and share two writers or more; writes(name, writer)."""
    from tarn.operators import similarity

    often = writes.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("name")
    w = writes.join(often, "name", "left_semi").select(F.col("name").alias("thing"), "writer")
    return similarity.contested(w, 2).withColumn("certainty", F.round(F.least(F.lit(0.99), 0.4 + 0.1 * F.col("shared")), 6))


def producers(functions: DataFrame, name: str) -> DataFrame:
    return functions.where(F.lower(F.trim("return_type")) == name.lower())


def type_radius(functions: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Routines whose result names a type, and those whose parameters do, in any case."""
    ins = F.array_join(F.transform(F.filter("sockets", lambda s: s["direction"] != "out"), lambda s: s["type"]), ",")
    has = lambda c: F.contains(F.lower(c), F.lit(name.lower()))
    return functions.where(has(F.col("return_type"))), functions.where(has(ins))


def looks(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, idx, colours, seconds): what the style rules that fit an element give it; rules(rule, tag, id, classes, colours, seconds), empty parts fit all.

    Rules meet elements by one key each, the id, a class or the tag, so only rules without any part meet all elements.
    """
    rule_key = F.when(F.col("id") != "", F.concat(F.lit("#"), "id")).when(F.size("classes") > 0, F.concat(F.lit("."), F.col("classes")[0])).when(F.col("tag") != "", F.col("tag")).otherwise("*")
    r = rules.select(*[F.col(c).alias(f"r_{c}") for c in ("rule", "tag", "id", "classes", "colours", "seconds")], rule_key.alias("_key"))
    keys = F.array_distinct(F.concat(F.array(F.lit("*"), "tag", F.concat(F.lit("#"), F.coalesce("id", F.lit("")))), F.transform("classes", lambda c: F.concat(F.lit("."), c))))
    e = elements.select("page_id", "idx", "tag", "id", "classes", F.explode(keys).alias("_key"))
    fits = ((F.col("r_tag") == "") | (F.col("r_tag") == F.col("tag"))) & ((F.col("r_id") == "") | F.col("r_id").eqNullSafe(F.col("id"))) & (F.size(F.array_except("r_classes", "classes")) == 0)
    return e.join(r, "_key").where(fits).groupBy("page_id", "idx").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("r_colours")))).alias("colours"), F.max("r_seconds").alias("seconds"))


def joined_colours(a: Column, b: Column, known: Column) -> Column:
    """1 if two sets of colours meet, 0 if not, null where no style is known."""
    return F.when(known, F.arrays_overlap(a, b).cast("double"))


def merged_scatter(findings: DataFrame) -> DataFrame:
    """(path, members, callers, evidence): findings of the same members as one, with how many callers they had."""
    return findings.groupBy("path", "members").agg(F.count(F.lit(1)).alias("callers"), F.min("evidence").alias("evidence"))


def scattered(spans: DataFrame) -> DataFrame:
    """Groups with four strangers or more whose own lines are less than a third of their span; spans(path, grp, first, last, own_lines, strangers)."""
    return spans.where((F.col("strangers") >= 4) & (F.col("own_lines") * 3 < F.col("last") - F.col("first") + 1))


def cuts(files: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, above, line, waist): where a long file is best cut: the place with the fewest names above that are called below, the first of equal ones.

    files(path, lines), functions(path, id, ord, line_start, line_end) with ord from 0 in each file, calls(caller, callee).
    """
    big = functions.groupBy("path").agg(F.count(F.lit(1)).alias("n")).join(files.select("path", "lines"), "path").where((F.col("lines") >= CUT_LINES) & (F.col("n") >= CUT_ROUTINES))
    f = functions.join(big, "path")
    up, down = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    span = lambda w: F.max("line_end").over(w) - F.min("line_start").over(w) + 1
    at = f.select("path", F.col("ord").alias("cut"), F.col("line_start").alias("line"), "n", "lines", span(up).alias("above_lines"), span(down).alias("below_lines"))
    most = F.greatest(F.lit(2), F.floor(F.col("n") * CUT_BALANCE / 100))
    fine = at.where((F.col("cut") >= most) & (F.col("cut") <= F.col("n") - most) & (F.least("above_lines", "below_lines") >= F.floor(F.col("lines") * CUT_BALANCE / 100)))
    w = code.waists(f.select("path", "id", "ord"), calls)
    best = fine.join(w, ["path", "cut"]).groupBy("path").agg(F.min(F.struct("waist", "cut", "line")).alias("x")).select("path", F.col("x.cut").alias("above"), "x.line", "x.waist")
    return best.where((F.col("waist") <= WAIST_MOST) & (F.col("waist") * 100 <= F.col("above") * WAIST_PERCENT))


def exclusive(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (fn_id, i, j, indent, on_head) of lines of which a later branch head keeps the second apart from the first; heads(fn_id, line, indent).

    A head counts if it stands left of the first line, or level with it when that is a head itself.
    """
    h = heads.select("fn_id", F.col("line").alias("_line"), F.col("indent").alias("_indent"))
    on = ["fn_id"]
    got = pairs.join(h, on).where((F.col("_line") > F.col("i")) & (F.col("_line") <= F.col("j")) & ((F.col("_indent") < F.col("indent")) | (F.col("on_head") & (F.col("_indent") == F.col("indent")))))
    return got.select("fn_id", "i", "j").distinct()


def elapsed(df: DataFrame, key: str, at: str) -> DataFrame:
    """Messages with the time since the first of their key and since the one before."""
    w = Window.partitionBy(key).orderBy(at)
    return df.withColumns({"since_first": F.col(at) - F.min(at).over(Window.partitionBy(key)), "gap": F.col(at) - F.lag(at).over(w)})


def outermost(pieces: DataFrame) -> DataFrame:
    """Pieces (path, first, last, is_func) without containers that hold a routine, and without those inside a kept one."""
    spans = Window.partitionBy("path")
    routine_ends = F.collect_list(F.when(F.col("is_func"), F.struct("first", "last"))).over(spans)
    holds = F.exists("_r", lambda r: (r["first"] > F.col("first")) & (r["last"] <= F.col("last")))
    kept = pieces.withColumn("_r", routine_ends).where(F.col("is_func") | ~holds).drop("_r")
    before = spans.orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    # what lies inside an earlier piece ends no later than the farthest end so far
    return kept.withColumn("_reach", F.max("last").over(before)).where(F.coalesce(F.col("first") > F.col("_reach"), F.lit(True))).drop("_reach")


def cheap_pairs(pairs: DataFrame, chunks: DataFrame, across: bool = False, least: float = 0.4) -> DataFrame:
    """Pairs (a, b) of one kind whose lengths lie within 40 %, of different repositories with ``across``; chunks(id, repo, lines, words_only)."""
    side = lambda x: chunks.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("repo", "lines", "words_only")])
    got = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("words_only_a") == F.col("words_only_b")) & (F.least("lines_a", "lines_b") >= least * F.greatest("lines_a", "lines_b")))
    return (got.where("repo_a <> repo_b") if across else got).select(*pairs.columns)


def containers(fields: DataFrame, name: str) -> DataFrame:
    """Fields (type, field, field_type) that hold a list of a type."""
    return fields.where(F.regexp_replace(F.lower("field_type"), r"\s", "").rlike(rf"^(seq|array|table|set|deque)\[.*\b{name.lower()}\b.*\]$"))


def carrier_fields(functions: DataFrame, fields: DataFrame) -> DataFrame:
    """(fn_id, field): the first field of a routine's result that can carry a failure; fields(type, field, ord)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim("return_type"), r"^(ref |var |seq\[|Option\[|lent )+", ""), r"[\] ]+$", "")
    f = fields.where(F.lower("field").isin(*lines.FAILURE_FIELDS)).groupBy("type").agg(F.min_by("field", "ord").alias("field"))
    return functions.select("fn_id", bare.alias("type")).join(f, "type").select("fn_id", "field")


def covered_sites(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """Call sites (fn_id, line) with the try around them: ``caught`` names and whether it catches all; regions(fn_id, first, last, caught, catch_all) don't overlap in a routine."""
    marks = regions.select("fn_id", F.col("first").alias("line"), F.struct("last", "caught", "catch_all").alias("region"))
    got = graph.nearest_before(sites, marks, "fn_id", "line", "region")
    return got.withColumn("region", F.when(F.col("region.last") >= F.col("line"), F.col("region")))


def barriers(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """(fn_id, barrier): routines with calls, and whether each of these lies in a try that catches all."""
    return covered_sites(sites, regions).groupBy("fn_id").agg(F.every(F.coalesce("region.catch_all", F.lit(False))).alias("barrier"))


def any_survives(sites: DataFrame, regions: DataFrame, name: str) -> DataFrame:
    """(fn_id, survives): whether an exception of that name gets out at one of the sites or more."""
    c = covered_sites(sites, regions)
    out = F.col("region").isNull() | (~F.col("region.catch_all") & ~F.array_contains("region.caught", name))
    return c.groupBy("fn_id").agg(F.some(out).alias("survives"))


def abort_reach(endings: DataFrame, functions: DataFrame) -> DataFrame:
    """(name, via): routines that an abort three names or more away can end, the shortest way of each name, longest first."""
    far = endings.where((F.col("kind") == "abort") & (F.size("via") >= 3)).select("fn_id", "via").join(functions.select("fn_id", F.col("name").alias("routine")), "fn_id")
    got = far.groupBy("routine").agg(F.min(F.struct(F.size("via").alias("n"), "via")).alias("x")).select(F.col("routine").alias("name"), "x.via")
    return got.orderBy(F.desc(F.size("via")), "name")


def yields(endings: DataFrame, functions: DataFrame, name: str) -> DataFrame:
    """(kind, ending, via): how routines of a name can end, the shortest way over its overloads; an unknown name is an error."""
    ids = functions.where(F.col("name") == name).select("fn_id")
    if not ids.limit(1).count():
        raise ValueError(f"no routine is named {name!r}")
    got = endings.join(ids, "fn_id", "left_semi").groupBy("kind", F.col("name").alias("ending")).agg(F.min(F.struct(F.size("via").alias("n"), "via")).alias("x"))
    return got.select("kind", "ending", "x.via").orderBy(F.col("kind") != "abort", F.size("via"), "ending")


def argument_evidence(arguments: DataFrame) -> DataFrame:
    """(pos, literals, from_variables): of each argument place the different literals, and how often something else stands there; arguments(pos, text)."""
    lit = lines.is_literal(F.col("text"))
    return arguments.groupBy("pos").agg(F.array_sort(F.collect_set(F.when(lit, F.trim("text")))).alias("literals"), F.count_if(~lit).alias("from_variables"))


def names_in_use(*tables: DataFrame) -> DataFrame:
    """Lower-case names of several tables (name), each once."""
    return reduce(DataFrame.unionByName, [t.select(F.lower("name").alias("name")) for t in tables]).distinct()


def called_set(edges: DataFrame) -> DataFrame:
    return edges.select("callee").distinct()


def template_names(functions: DataFrame) -> DataFrame:
    return functions.where("decl_kind = 'template'").select(F.lower("name").alias("name")).distinct()


def pragma_keys(functions: DataFrame) -> DataFrame:
    """Words before the colon of all tags, each once."""
    return functions.select(F.explode("tags").alias("t")).select(F.lower(F.substring_index("t", ":", 1)).alias("key")).distinct()


def template_uses(functions: DataFrame, templates: DataFrame) -> DataFrame:
    """(fn_id, n): calls and tags of a routine that are names of templates."""
    uses = functions.select("fn_id", F.explode(F.concat("calls", F.transform("tags", lambda t: F.substring_index(t, ":", 1)))).alias("name")).select("fn_id", F.lower("name").alias("name"))
    return functions.select("fn_id").join(uses.join(templates, "name").groupBy("fn_id").agg(F.count(F.lit(1)).alias("n")), "fn_id", "left").fillna(0, ["n"])


def gather_tests(blocks: DataFrame, functions: DataFrame) -> DataFrame:
    """(test_id, kind): test blocks, and routines whose tags say that they are tests."""
    kind = F.get(F.filter(F.transform("tags", code.pragma_kind), lambda x: x.isNotNull()), F.lit(0))
    return blocks.select("test_id", "kind").unionByName(functions.select(F.col("fn_id").alias("test_id"), kind.alias("kind")).where("kind IS NOT NULL"))


def top_level_calls(text: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, name): names called on lines (path, line, text) that lie in no routine, each once."""
    o = owners(text, functions)
    return o.where("owner IS NULL").select("path", F.explode(lines.names_called(F.col("text"))).alias("name")).distinct()


def graph_summary(functions: DataFrame, edges: DataFrame, unresolved: DataFrame, groups: DataFrame) -> DataFrame:
    """(what, n): routines, edges, names without a routine, groups, and routines of each role."""
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    roles = functions.groupBy(F.concat(F.lit("role "), F.coalesce("role", F.lit("unknown"))).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return reduce(DataFrame.unionByName, [n(functions, "functions"), n(edges, "edges"), n(unresolved, "unresolved"), n(groups.select("group").distinct(), "groups"), roles])


def embedded_blocks(text: DataFrame) -> DataFrame:
    """(path, line, lines, text): what stands in strings of several lines, from two lines on, by the delimiters of the file's ending; text(path, line, text).

    A line that opens and closes is no block. Inside lines come from a running count of the delimiter's lines. Files are windows of their own.
    """
    out = []
    for ending, opens, closes in code.DELIMITERS:
        t = text.where(code.extension(F.col("path")) == ending)
        times = lambda s: (F.length("text") - F.length(F.replace(F.col("text"), F.lit(s), F.lit("")))) / len(s)
        w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if opens == closes:
            turns = (times(opens) % 2 == 1).cast("int")
            k = t.withColumn("_n", F.sum(turns).over(w)).withColumn("_turn", turns)
            inside = k.where((F.col("_n") % 2 == 1))
        else:
            o, c = F.contains("text", F.lit(opens)), F.contains("text", F.lit(closes))
            turn = F.when(o & ~c, 1).when(c & ~o, -1).otherwise(0)
            last = F.last(F.when(turn != 0, turn), ignorenulls=True).over(w)
            k = t.withColumn("_open", last).withColumn("_turn", (turn == 1).cast("int"))
            starts = (F.col("_turn") == 1) & (F.coalesce(F.lag("_open").over(Window.partitionBy("path").orderBy("line")), F.lit(-1)) != 1)
            k = k.withColumn("_turn", starts.cast("int"))
            inside = k.withColumn("_n", F.sum("_turn").over(w)).where("_open = 1")
        rows = F.array_sort(F.collect_list(F.when(F.col("_turn") == 0, F.struct("line", "text"))))
        got = inside.groupBy("path", "_n").agg(F.min("line").alias("line"), F.max("line").alias("_last"), rows.alias("_b"))
        end = t.groupBy("path").agg(F.max("line").alias("_end"))
        out.append(got.join(end, "path").where((F.size("_b") >= 2) & (F.col("_last") < F.col("_end"))).select("path", "line", F.size("_b").cast("long").alias("lines"), F.array_join(F.transform("_b", lambda x: x["text"]), "\n").alias("text")))
    return reduce(DataFrame.unionByName, out)


def embedded(text: DataFrame) -> DataFrame:
    """(path, line, lines, language, score): blocks in strings that are code of another language than the file's."""
    b = embedded_blocks(text).withColumn("_id", F.struct("path", "line", "lines"))
    hosts = F.create_map(*[F.lit(x) for kv in code.HOSTS.items() for x in kv])
    got = code.classify(b.select("_id", "text"), "_id").select("_id.*", "language", "score")
    return got.where(~F.coalesce(hosts[code.extension(F.col("path"))], F.lit("")).eqNullSafe(F.col("language")))
