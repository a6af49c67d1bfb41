"""Reports over routine tables: nesting, coverage, roles, guards, endings, placeholders, unused names, state writes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators import graph
from tarn.session import stored

OPENERS = ("for", "while", "if", "elif", "else", "case", "of", "try", "except", "finally", "when", "block")
#: Words in a name that tell a sanitizer (fixed values).
SANITIZERS = ("sanitize", "sanitise", "validate", "clean", "escape", "scrub")
#: Words of comments that mark what is unfinished, and bodies that do nothing (fixed values).
UNFINISHED = ("todo", "fixme", "not implemented", "notimplemented", "unimplemented", "placeholder", "stub", "for now")
NOTHING = ("discard", "nil", "void", "pass")
#: Reported from this score on.
PLACEHOLDER_FLOOR, PLACEHOLDER_MOST = 0.45, 0.99
ROUNDS, CHAIN = 12, 6


def _word(line: str) -> str:
    s = line.strip()
    return s.split(" ", 1)[0].rstrip(":(") if s and not s.startswith("#") else ""


def _sites(fn_id: str, body: list[str]) -> list[tuple]:
    """Openers inside other openers, by a stack of indents: every open frame counts, branches of a case too."""
    code = [(i, len(x) - len(x.lstrip()), _word(x)) for i, x in enumerate(body) if x.strip() and not x.strip().startswith("#")]
    stack: list[int] = []
    out = []
    for k, (i, indent, word) in enumerate(code):
        while stack and indent <= stack[-1]:
            stack.pop()
        if word in ("proc", "func", "method", "iterator", "template", "macro"):
            stack = []
        elif word in OPENERS:
            stack.append(indent)
            inner = next((n for n, (_, later, _) in enumerate(code[k + 1 :]) if later <= indent), len(code) - k - 1)
            if len(stack) >= 2 and inner:
                out.append((fn_id, len(out), word, i, len(stack), inner))
    return out


def nest_sites(functions: DataFrame) -> DataFrame:
    """(fn_id, ord, keyword, line, depth, inner_lines, leaf): openers at depth 2 or more; a leaf has no deeper one after it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([s for i, b in zip(f["fn_id"], f["body"], strict=True) for s in _sites(i, list(b))], columns=["fn_id", "ord", "keyword", "line", "depth", "inner_lines"])

    s = functions.select("fn_id", "body").mapInPandas(run, "fn_id string, ord long, keyword string, line long, depth long, inner_lines long")
    return s.withColumn("leaf", F.coalesce(F.lead("depth").over(Window.partitionBy("fn_id").orderBy("ord")) <= F.col("depth"), F.lit(True)))


def walk_tests(tests: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn_id, hits, kinds): how many tests reach a routine, and of which kinds; tests(test_id, kind, name) name what they call.

    A test reaches every overload of a name, and all that these call.
    """
    seeds = tests.join(functions.select("fn_id", "name"), "name").select("test_id", F.col("fn_id").alias("node")).distinct()
    reached = graph.within(edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), seeds.select("node"))
    pairs = seeds.join(reached.select(F.col("seed").alias("node"), F.col("node").alias("fn_id")), "node").select("test_id", "fn_id").distinct()
    hits = pairs.join(tests.select("test_id", "kind").distinct(), "test_id").groupBy("fn_id").agg(F.count_distinct("test_id").alias("hits"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return functions.select("fn_id").join(hits, "fn_id", "left").select("fn_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def declared_role(functions: DataFrame) -> Column:
    """The first tag ``role: x``, or null."""
    return F.get(F.transform(F.filter("tags", lambda t: t.rlike(r"^role\s*:")), lambda t: F.trim(F.regexp_replace(t, r"^role\s*:", ""))), F.lit(0))


def infer_roles(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn_id, role, confidence): a declared role is certain; else the best of nine additive scores, the first of equal ones, unknown under 0.45."""
    outs = edges.groupBy(F.col("caller").alias("fn_id")).agg(F.count(F.lit(1)).alias("o"))
    ins = edges.groupBy(F.col("callee").alias("fn_id")).agg(F.count(F.lit(1)).alias("i"))
    low = F.transform("body", lambda x: F.lower(F.trim(x)))
    branches = F.size(F.filter(low, lambda x: x.startswith("if ") | x.startswith("elif ") | x.startswith("case ") | x.startswith("of ")))
    params = F.filter("sockets", lambda x: x["direction"] != "out")
    state = F.exists(params, lambda x: F.lower(F.trim(x["name"])).startswith("s") | F.contains(F.lower(F.concat_ws(":", x["name"], x["type"])), F.lit("state")))
    state = state | F.exists(low, lambda x: F.contains(x, F.lit(".state")) | F.contains(x, F.lit("case s")))
    f = functions.select("fn_id", declared_role(functions).alias("declared"), F.lower("name").alias("n"), F.size("body").alias("lines"), branches.alias("b"), F.coalesce(state, F.lit(False)).alias("state"))
    f = f.join(outs, "fn_id", "left").join(ins, "fn_id", "left").fillna(0, ["o", "i"])
    o, i, b, lines = (F.col(c) for c in ("o", "i", "b", "lines"))
    named = lambda *w: reduce(lambda x, y: x | y, [F.contains("n", F.lit(k)) for k in w])
    # roles in order, their conditions and weights (fixed values)
    rules = [
        ("helper", ((o <= 1, 0.35), (b <= 1, 0.2), (lines <= 14, 0.2), (i >= 1, 0.25))),
        ("wrapper", ((o == 1, 0.5), (lines <= 8, 0.25), (b == 0, 0.25))),
        ("parser", ((named("parse", "token", "scan", "decode"), 0.55), (o <= 1, 0.2))),
        ("truthbuilder", ((named("build", "compose", "assemble", "make"), 0.5), (o >= 1, 0.2))),
        ("datafetcher", ((named("fetch", "read", "load", "pull"), 0.55), (o <= 1, 0.2))),
        ("actor", ((named("emit", "write", "apply", "commit", "run", "act"), 0.45), (o >= 1, 0.15))),
        ("orchestrator", ((o >= 2, 0.4), (lines >= 8, 0.2), (b >= 1, 0.2), (i == 0, 0.2))),
        ("metaorchestrator", ((o >= 4, 0.45), (i == 0, 0.2), (lines >= 12, 0.15))),
        ("statecontroller", ((b >= 3, 0.5), (F.col("state"), 0.3), (o >= 1, 0.2))),
    ]
    scores = [(name, F.round(reduce(lambda x, y: x + y, [F.when(c, w).otherwise(0.0) for c, w in parts]), 2)) for name, parts in rules]
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-k).alias("k"), F.lit(name).alias("r")) for k, (name, s) in enumerate(scores)]))
    return f.select("fn_id", F.coalesce("declared", F.when(best["s"] >= 0.45, best["r"]), F.lit("unknown")).alias("role"), F.when(F.col("declared").isNotNull(), 1.0).otherwise(best["s"]).alias("confidence"))


def is_sanitizer(role: Column, name: Column) -> Column:
    """A declared role decides; only without one, the name."""
    return F.when(role.isNotNull() & (role != "unknown"), F.lower(role).isin("sanitizer", "decryptor", "sanitiser")).otherwise(F.lower(name).rlike("|".join(SANITIZERS)))


def coupling(functions: DataFrame, edges: DataFrame, doors: DataFrame, guards: DataFrame, cover: DataFrame) -> DataFrame:
    """(door, guard, hops, route, relied, verdict): the nearest guard behind each door, how many doors rely on it, how it is tested."""
    near = stored(graph.nearest(edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), doors, guards))
    relied = near.where("guard IS NOT NULL").groupBy("guard").agg(F.count(F.lit(1)).alias("relied"))
    from tarn.functions.code import verdict

    tested = cover.select(F.col("fn_id").alias("guard"), verdict(F.col("hits"), F.array_contains("kinds", "edge case"), F.array_contains("kinds", "regression") | F.array_contains("kinds", "bugfix")).alias("verdict"))
    return near.join(relied, "guard", "left").join(tested, "guard", "left")


def placeholder_scores(functions: DataFrame, called: DataFrame) -> DataFrame:
    """(fn_id, score): how much a routine looks like a stand-in; called(name).

    A declared stage scores 1, or 0 if it is done. Else 0.7 for a body that does nothing or only refuses, 0.55 for one that
    hands back a constant, 0.3 more for a comment that marks it, 0.15 more if nothing calls it and it has 12 lines at most.
    """
    bare = F.transform("body", lambda x: F.trim(F.regexp_replace(F.trim(x), r'^((?:[^"#]|"[^"]*")*)#.*$', "$1")))
    code = F.filter(bare, lambda x: x != "")
    n = F.size(code)
    every = lambda test: (n > 0) & ~F.exists(code, lambda x: ~test(x))
    empty = every(lambda x: F.lower(x).isin(*NOTHING) | F.lower(x).startswith("discard"))
    refuses = lambda x: x.startswith("raise ") | x.startswith("quit") | x.startswith("doAssert false")
    ins = F.transform(F.filter("sockets", lambda x: x["direction"] != "out"), lambda x: F.trim(x["name"]))
    uses = F.exists(ins, lambda name: (name != "") & F.exists(code, lambda x: F.array_contains(F.split(x, "[^A-Za-z0-9_]+"), name)))
    uses = F.coalesce(uses, F.lit(False))
    only_refuses = (n > 0) & (n <= 3) & F.exists(code, refuses) & ~F.exists(code, lambda x: ~(refuses(x) | x.startswith("discard"))) & ~uses
    gives = F.exists(code, lambda x: x.startswith("result") | x.startswith("return"))
    start = (F.size(ins) == 0) & F.lower("name").rlike("^(default|init)")
    changes = F.coalesce(F.exists("sockets", lambda x: x["direction"] == "var"), F.lit(False))
    calls = F.exists(code, lambda x: x.rlike(r"[A-Za-z_]\w*\s*\("))
    constant = (n > 0) & (n <= 6) & gives & ~calls & ~uses & ~changes & ~start
    base = F.when(empty, 0.7).when(only_refuses, 0.7).when(constant, 0.55).otherwise(0.0)
    said = F.lower(F.array_join(F.transform("body", lambda x: F.regexp_extract(x, r'^(?:[^"#]|"[^"]*")*#(.*)$', 1)), " "))
    todo = F.when(reduce(lambda a, b: a | b, [F.contains(said, F.lit(w)) for w in UNFINISHED]), 0.3).otherwise(0.0)
    small = F.when(F.col("_called").isNull() & (F.col("decl_kind") != "method") & (n <= 12), 0.15).otherwise(0.0)
    tags = F.transform("tags", lambda t: F.lower(F.trim(t)))
    stage = F.get(F.filter(F.transform(tags, lambda t: F.when(t.startswith("stage:"), F.trim(F.substring(t, 7, 200))).when(t.startswith("deprecated"), "deprecated")), lambda x: x.isNotNull()), F.lit(0))
    done = stage.isin("stdone", "done")
    c = called.select(F.lower("name").alias("_name"), F.lit(True).alias("_called")).distinct()
    x = functions.join(c, F.lower(functions["name"]) == F.col("_name"), "left")
    score = F.when(stage.isNotNull() & ~done, 1.0).when(done | (n == 0) | F.array_contains(tags, "pragma"), 0.0)
    return x.select("fn_id", score.otherwise(F.round(F.least(F.lit(PLACEHOLDER_MOST), base + todo + small), 2)).alias("score"))


def unused(functions: DataFrame, called: DataFrame) -> DataFrame:
    """(fn_id, path, name, lines, kind): routines whose lower-case name nothing calls; main, converters and operators aside."""
    f = functions.where((F.col("decl_kind") != "converter") & (F.lower("name") != "main") & F.col("name").rlike("^[A-Za-z_]"))
    left = f.withColumn("_n", F.lower("name")).join(called.select(F.lower("name").alias("_n")).distinct(), "_n", "left_anti")
    lines = F.col("line_end") - F.col("line_start") + 1
    return left.select("fn_id", "path", "name", lines.alias("lines"), F.when(F.col("exported"), "public").otherwise("leftover").alias("kind"))


def endings(own: DataFrame, edges: DataFrame, tries: DataFrame, rounds: int = ROUNDS, chain: int = CHAIN) -> DataFrame:
    """(fn_id, name, kind, via): how routines can end, carried up the calls a hop a round; the shortest way of each is kept.

    own(fn_id, name, kind raise|abort); tries(caller, callee, caught array, all boolean) tells what is caught around a
    call. A caught exception ends there, an abort never does. A chain has ``chain`` names at most and none twice.
    """
    now = stored(own.select("fn_id", "name", "kind", F.array(F.col("fn_id")).alias("via")).groupBy("fn_id", "name", "kind").agg(F.min("via").alias("via")))
    calls = edges.select("caller", F.col("callee").alias("fn_id")).distinct().join(tries.select("caller", F.col("callee").alias("fn_id"), "caught", F.col("all").alias("_all")), ["caller", "fn_id"], "left")
    new = now
    for _ in range(rounds):
        up = new.join(calls, "fn_id").where((F.col("kind") == "abort") | ~(F.coalesce("_all", F.lit(False)) | F.coalesce(F.array_contains("caught", F.col("name")), F.lit(False))))
        up = up.where((F.size("via") < chain) & ~F.array_contains("via", F.col("caller"))).select(F.col("caller").alias("fn_id"), "name", "kind", F.concat(F.array("caller"), "via").alias("via"))
        up = up.groupBy("fn_id", "name", "kind").agg(F.min(F.struct(F.size("via").alias("n"), "via")).alias("x")).select("fn_id", "name", "kind", "x.via")
        new = stored(up.join(now.select("fn_id", "name", "kind"), ["fn_id", "name", "kind"], "left_anti"))
        if not new.limit(1).count():
            break
        now = stored(now.unionByName(new))
    return now


def blast(functions: DataFrame, edges: DataFrame, name: str, hops: int = 3) -> DataFrame:
    """(fn_id, name, depth): callers of a name within ``hops``; an unknown name is an error."""
    seeds = functions.where(F.col("name") == name).select(F.col("fn_id").alias("node"))
    if not seeds.limit(1).count():
        raise ValueError(f"no routine is named {name!r}")
    got = graph.within(edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst")), seeds, hops, include=False)
    return got.groupBy("node").agg(F.min("depth").alias("depth")).join(functions.select(F.col("fn_id").alias("node"), "name"), "node").select(F.col("node").alias("fn_id"), "name", "depth")


def field_traffic(uses: DataFrame) -> DataFrame:
    """(type, field, blind, folding, readers) from uses(type, field, fn_id, writes, folds, reads): a routine that reads or folds does not write blindly."""
    per = uses.groupBy("type", "field", "fn_id").agg(*[F.sum(c).alias(c) for c in ("writes", "folds", "reads")])
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("fn_id"))))
    return per.groupBy("type", "field").agg(names((F.col("writes") > 0) & (F.col("folds") == 0) & (F.col("reads") == 0)).alias("blind"), names(F.col("folds") > 0).alias("folding"), names((F.col("reads") > 0) & (F.col("writes") == 0) & (F.col("folds") == 0)).alias("readers"))


def lost_writes(traffic: DataFrame, calls: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(type, field, verdict, witness): never read, lost (two blind writers called one after the other), guarded, or perhaps.

    calls(fn_id, line, name): the calls of a routine by line. A reader between two writers guards them. Fields without
    a writer or in allowed(type, field) have no finding; a field that nothing reads is no lost write.
    """
    t = traffic if allowed is None else traffic.join(allowed, ["type", "field"], "left_anti")
    t = t.where(F.size("blind") + F.size("folding") > 0)
    role = lambda c, r: t.select("type", "field", F.explode(c).alias("name"), F.lit(r).alias("role"))
    roles = reduce(DataFrame.unionByName, [role("blind", "write"), role("readers", "read"), role("folding", "read")])
    w = Window.partitionBy("type", "field", "fn_id").orderBy("line", "name")
    seq = calls.join(roles, "name").select("type", "field", "fn_id", "line", "name", "role")
    pair = seq.withColumns({"n_role": F.lead("role").over(w), "n_name": F.lead("name").over(w)}).where("role = 'write'")
    seen = pair.groupBy("type", "field").agg(F.min(F.when((F.col("n_role") == "write") & (F.col("n_name") != F.col("name")), F.col("fn_id"))).alias("witness"), F.max((F.col("n_role") == "read").cast("int")).alias("guarded"))
    x = t.join(seen, ["type", "field"], "left")
    v = F.when((F.size("readers") == 0) & (F.size("folding") == 0), "never read").when(F.size("blind") < 2, None).when(F.col("witness").isNotNull(), "lost").when(F.col("guarded") == 1, None).otherwise("perhaps lost")
    return x.select("type", "field", v.alias("verdict"), F.when(v == "lost", F.col("witness")).alias("witness")).where("verdict IS NOT NULL")


def gate(blocks: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(block, place, line): of each report that has rows its count as a heading and its first rows; reports have (rank, line)."""
    parts = []
    for name, (df, n) in blocks.items():
        count = df.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(name).alias("block"), F.lit(0).cast("long").alias("place"), F.concat(F.lit(f"{name}: "), F.col("n").cast("string")).alias("line"))
        first = df.orderBy("rank", "line").limit(n).withColumn("place", F.row_number().over(Window.orderBy("rank", "line")).cast("long")).select(F.lit(name).alias("block"), "place", "line")
        parts += [count, first]
    return reduce(DataFrame.unionByName, parts)
