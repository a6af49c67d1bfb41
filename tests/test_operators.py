import math

import pytest
from pyspark.sql import functions as F

from tarn.functions import code
from tarn.operators import bits, graph, reports, samples, scan, similarity, tallies
from tarn.sources import files, routines, sinks
from tarn.streaming import state


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sequenced_and_next(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k int, v int")
    got = {r["pos"]: r for r in scan.sequenced(df, ["k"], {"s": F.col("k")}).collect()}
    assert [got[i]["k"] for i in range(50)] == list(range(50))
    assert all(got[i]["s"] == i * (i + 1) // 2 for i in range(50))
    nxt = scan.with_next(scan.sequenced(df, ["k"]).select("pos", "k"), {"k": "n"}, 2, block=8)
    assert {r["k"]: r["n"] for r in nxt.collect()} == {i: i + 2 if i < 48 else None for i in range(50)}


def test_bands_and_samples(spark):
    df = spark.createDataFrame([(i, 10 * i) for i in range(1, 6)], "id long, size long")
    assert [r["band"] for r in tallies.size_bands(df, "id", "size").orderBy("rank").collect()] == ["huge", "huge", "big", "big", "mid"]
    many = spark.range(100).withColumnRenamed("id", "k")
    got = [r["k"] for r in tallies.even_sample(many, ["k"], 10).orderBy("k").collect()]
    assert got[0] == 0 and got[-1] == 99 and len(got) in (10, 11)
    assert tallies.even_sample(many.where("k < 5"), ["k"], 10).count() == 5


def test_resolution_rules(spark):
    fns = spark.createDataFrame([("a.f", "a", "f", 0), ("b.f", "b", "f", 1), ("b.g", "b", "g", 2), ("c.f", "c", "f", 3)], "fn_id string, module string, name string, ord long")
    calls = spark.createDataFrame([("b.g", "b", "f", 0), ("x.h", "x", "f", 0), ("x.h", "x", "g", 1), ("x.h", "x", "nope", 2), ("y.k", "y", "f", 0), ("b.g", "b", "g", 1)], "caller string, module string, name string, ord long")
    imports = spark.createDataFrame([("y", "f", "c", 5), ("y", "f", "b", 9)], "module string, name string, target string, rank long")
    got = rows(graph.resolve(calls, fns, imports), "caller", "callee", "name")
    assert got == [("b.g", "b.f", "f"), ("x.h", "a.f", "f"), ("x.h", "b.g", "g"), ("y.k", "c.f", "f")]
    assert rows(graph.unresolved(calls, fns), "caller", "name") == [("x.h", "nope")]


def test_walks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.within(e, seed), "node", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.within(e, seed, 1, include=False), "node", "depth") == [("b", 1)]
    got = graph.nearest(e, seed, spark.createDataFrame([("d",)], "node string"))
    assert rows(got, "door", "guard", "hops", "route") == [("a", "d", 3, "b>c>d")]
    nodes = spark.createDataFrame([(c,) for c in "pqrs"], "node string")
    chain = spark.createDataFrame([("p", "q"), ("q", "r"), ("p", "r")], "src string, dst string")
    assert rows(graph.depths(nodes, chain), "node", "depth") == [("p", 3), ("q", 2), ("r", 1), ("s", 1)]


def test_similarity(spark):
    df = spark.createDataFrame([("VIR", "VIRKR"), ("", "A"), ("ABC", "ABC"), ("AXBYC", "ABC")], "a string, b string")
    got = [(round(r["l"], 3), round(r["g"], 3)) for r in df.select(similarity.lcs_ratio("a", "b").alias("l"), similarity.greedy_agreement("a", "b").alias("g")).collect()]
    assert got == [(0.6, 0.6), (0.0, 0.0), (1.0, 1.0), (0.6, 0.6)]
    pairs = [(i, i + 1) for i in range(11)] + [(20, 21), (20, 22), (20, 23)]
    stars = rows(similarity.star_clusters(spark.createDataFrame(pairs, "a long, b long")), "centre", "member")
    neighbours, free, want = {}, set(), []
    for a, b in pairs:
        neighbours.setdefault(a, set()).add(b)
        neighbours.setdefault(b, set()).add(a)
    free = set(neighbours)
    for c in sorted(neighbours, key=lambda x: (-len(neighbours[x]), x)):
        if c in free and (near := neighbours[c] & free):
            want += [(c, c)] + [(c, m) for m in near]
            free -= near | {c}
    assert stars == sorted(want)
    words = spark.createDataFrame([("parseUserName",), ("parse_user_id",)], "n string").select(similarity.split_words(F.col("n")).alias("w"))
    assert [r["w"] for r in words.collect()] == [["parse", "user", "name"], ["parse", "user"]]


def xorshift(n):
    s, out = 0x716BC241, []
    for _ in range(n):
        s ^= s << 13 & 0xFFFFFFFF
        s ^= s >> 17
        s ^= s << 5 & 0xFFFFFFFF
        out.append(s & 1)
    return out


def test_bits(spark):
    x = xorshift(257)
    b = bits.stream_of(spark.createDataFrame(list(enumerate(x)), "i long, v int"), ["i"], F.col("v")).cache()
    assert [r["bit"] for r in b.orderBy("pos").collect()] == x
    assert bits.monobit(b).first()["statistic"] == pytest.approx(abs(2 * sum(x) - 257) / math.sqrt(257), abs=1e-6)
    assert bits.runs(b).first()["runs"] == 1 + sum(p != q for p, q in zip(x, x[1:], strict=False))
    want = {}
    for i in range(257):
        p = x[i] * 4 + x[(i + 1) % 257] * 2 + x[(i + 2) % 257]
        want[p] = want.get(p, 0) + 1
    assert dict(rows(bits.pattern_counts(b, 3), "pattern", "n")) == want
    walk = [sum(2 * v - 1 for v in x[: i + 1]) for i in range(257)]
    assert bits.cusum(b).first()["z"] == max(map(abs, walk))
    assert rows(bits.from_bytes(spark.createDataFrame([(bytearray(b"\xa5\x01"),)], "bytes binary")), "pos", "bit") == list(enumerate([1, 0, 1, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1]))


def test_bit_kernels():
    assert [bits.gf2_rank(r) for r in ([0, 0], [1, 1], [1, 2], [3, 5, 6])] == [0, 1, 2, 2]
    assert bits.berlekamp_massey("1101011110001") == 4
    assert bits.berlekamp_massey("0000") == 0 and bits.berlekamp_massey("0001") == 4
    assert sum(bits.rank_probability(8, 8, k) for k in range(9)) == pytest.approx(1)
    assert bits.gamma_q(1, 2) == pytest.approx(math.exp(-2)) and bits.gamma_q(0.5, 3.0) == pytest.approx(math.erfc(math.sqrt(3)))
    assert bits.cusum_p(16, 100) == pytest.approx(0.219194, abs=1e-5)


def test_samples(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 9)] + [("b", float(v)) for v in (1, 2, 3, 4, 9)], "k string, x double")
    assert tuple(samples.welch(df, F.col("k"), "x", "a", "b").first()) == (0.0, 0.0)
    assert rows(samples.stable_row(df, "k", "x"), "k", "median") == [("a", 3.0), ("b", 3.0)]
    got = spark.createDataFrame([(10, 1000), (100, 1000)], "f int, n int").withColumns(samples.proportion_bound(F.col("f"), F.col("n"))).collect()
    assert [r["passed"] for r in got] == [True, False]


SOURCE = '''import strutils, ./db
from store import keep, drop

## role: parser
proc parse*(text: string, strict = true): seq[string] {.raises: [ValueError].} =
  ## Splits a text.
  for line in text.splitLines:
    if line.len > 0:
      while more(line):
        result.add clean(line)
  keep(result)

proc clean(x: string): string = strip(x)

template forward(a, b: int, c: var string)

proc later(): int =
  # TODO
  discard
'''


def test_routines(spark, tmp_path):
    got = {r["name"]: r for r in routines.routines("src/a.nim", SOURCE)}
    assert list(got) == ["parse", "clean", "forward", "later"]
    p = got["parse"]
    assert p["exported"] and p["return_type"] == "seq[string]" and p["line_start"] == 5 and p["line_end"] == 11
    assert [(s["name"], s["type"], s["direction"]) for s in p["sockets"]] == [("text", "string", "in"), ("strict", "", "in"), ("result", "seq[string]", "out")]
    assert p["calls"] == ["more", "clean", "keep"] and "role: parser" in p["tags"]
    assert [(s["name"], s["type"], s["direction"]) for s in got["forward"]["sockets"]] == [("a", "int", "in"), ("b", "int", "in"), ("c", "string", "var")]
    assert got["clean"]["calls"] == ["strip"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.nim").write_text(SOURCE)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.nim").write_text("proc no() = discard")
    f = files.files(spark, str(tmp_path)).cache()
    assert rows(f, "path", "ext", "is_src") == [("src/a.nim", "nim", True)]
    fns = routines.functions(f).cache()
    edges = graph.resolve(routines.calls(fns), fns, routines.imports(f)).cache()
    assert [(a.split("::")[1], b.split("::")[1]) for a, b in rows(edges, "caller", "callee")] == [("parse@5", "clean@13")]
    assert rows(reports.nest_sites(fns), "keyword", "depth", "inner_lines", "leaf") == [("if", 2, 2, False), ("while", 3, 1, True)]
    score = {r["fn_id"].split("::")[1].split("@")[0]: r["score"] for r in reports.placeholder_scores(fns, routines.calls(fns).select("name")).collect()}
    assert score["later"] >= 0.7 and score["parse"] < 0.45 and score["forward"] == 0
    assert [r["name"] for r in reports.unused(fns, routines.calls(fns)).orderBy("name").collect()] == ["forward", "later", "parse"]
    assert "digraph calls {" in [r["value"] for r in sinks.dot(fns, edges).collect()]
    tests = spark.createDataFrame([("t1", "edge", "parse"), ("t2", "unit", "clean")], "test_id string, kind string, name string")
    hits = {r["fn_id"].split("::")[1].split("@")[0]: r["hits"] for r in reports.walk_tests(tests, fns, edges).collect()}
    assert hits == {"parse": 1, "clean": 2, "forward": 0, "later": 0}


def test_endings_and_states(spark):
    own = spark.createDataFrame([("read", "IOError", "raise"), ("read", "quit", "abort")], "fn_id string, name string, kind string")
    edges = spark.createDataFrame([("parse", "read"), ("safe", "parse"), ("all", "safe")], "caller string, callee string")
    tries = spark.createDataFrame([("safe", "parse", ["IOError"], False)], "caller string, callee string, caught array<string>, all boolean")
    got = rows(reports.endings(own, edges, tries).withColumn("v", F.array_join("via", ">")), "fn_id", "name", "v")
    assert got == [("all", "quit", "all>safe>parse>read"), ("parse", "IOError", "parse>read"), ("parse", "quit", "parse>read"), ("read", "IOError", "read"), ("read", "quit", "read"), ("safe", "quit", "safe>parse>read")]
    use = lambda f, fn, w, o, r: ("T", f, fn, w, o, r)
    uses = spark.createDataFrame([use("price", "setA", 1, 0, 0), use("price", "setB", 1, 0, 0), use("price", "show", 0, 0, 1), use("volume", "addV", 1, 1, 0), use("seen", "mark", 1, 0, 0), use("depth", "dA", 1, 0, 0), use("depth", "dB", 1, 0, 0), use("depth", "peek", 0, 0, 1)], "type string, field string, fn_id string, writes int, folds int, reads int")
    calls = spark.createDataFrame([("run", 1, "setA"), ("run", 2, "setB"), ("go", 1, "dA"), ("go", 2, "peek"), ("go", 3, "dB")], "fn_id string, line int, name string")
    assert rows(reports.lost_writes(reports.field_traffic(uses), calls), "field", "verdict", "witness") == [("price", "lost", "run"), ("seen", "never read", None)]


def test_ranges_and_layout(spark):
    f = spark.createDataFrame([("a", 5), ("a", 50), ("b", 5)], "path string, line int")
    h = spark.createDataFrame([("a", 1, 10)], "path string, first int, last int")
    yours, nearby = graph.touched(f, h)
    assert rows(yours, "path", "line") == [("a", 5)] and rows(nearby, "path", "line") == [("a", 50), ("b", 5)]
    items = spark.createDataFrame([("f", x, i) for i, x in enumerate("abcd")], "path string, id string, ord long")
    calls = spark.createDataFrame([("c", "a"), ("d", "a"), ("d", "c")], "caller string, callee string")
    assert dict(rows(code.waists(items, calls), "cut", "waist")) == {0: 0, 1: 1, 2: 1, 3: 2}
    bags = spark.sql("SELECT map('x', 2L, 'y', 1L) AS a, map('x', 1L, 'z', 1L) AS b, map_from_arrays(array(), array()) AS c")
    assert bags.select(tallies.likeness(F.col("a"), F.col("b"))).first()[0] == 0.25


def test_sources_text(spark):
    text = ["0000000000401000 <check__mod_u1>:", "/src/a.nim:12", "  401000:\t48 8b 07             \tmov    rax,QWORD PTR [rdi+rsi*2,0x8]", "  401003:\t75 02                \tjne    401007 <check__mod_u1+0x7>"]
    i = files.instructions(spark.createDataFrame([("f", n, t) for n, t in enumerate(text)], "file string, line_no int, text string")).orderBy("address").collect()
    assert [(r["mnemonic"], r["operands"], r["target"], r["source_line"]) for r in i] == [("mov", ["rax", "QWORD PTR [rdi+rsi*2,0x8]"], None, 12), ("jne", ["401007"], 0x401007, 12)]
    diff = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,2 +1,3 @@", "-old", "+new", "@@ -9 +12,0 @@", "-gone"]
    h, r = files.hunks(spark.createDataFrame(list(enumerate(diff)), "line_no int, text string"))
    assert rows(h, "path", "first", "last") == [("x", 1, 3), ("x", 12, 12)] and rows(r, "path", "text") == [("x", "gone"), ("x", "old")]


def test_streams(spark, tmp_path):
    once = state.once_only(spark.createDataFrame([("a", " x", "f", 1), ("a", "x", "f", 9), ("b", "x", "f", 1)], "path string, line_text string, finding string, line int"))
    assert once.count() == 2
    e = spark.createDataFrame([("t", 1, "enter", "a", 10), ("t", 2, "enter", "b", 11), ("t", 3, "exit", "b", 12), ("t", 4, "enter", "c", 13), ("t", 5, "exit", "c", 15), ("t", 6, "exit", "a", 20)], "thread string, seq int, kind string, name string, at int")
    assert rows(state.spans(e), "name", "depth", "entered", "left") == [("a", 1, 10, 20), ("b", 2, 11, 12), ("c", 2, 13, 15)]
    src = str(tmp_path / "in")
    spark.createDataFrame([("r", 100), ("r", 60), ("r", 10), ("r", 145)], "repo string, lines int").coalesce(1).write.parquet(src)
    stream = state.line_gate(spark.readStream.schema("repo string, lines int").parquet(src))
    q = stream.writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("gate"), "repo", "fired_at") == [("r", 2), ("r", 4)]


def test_catalogue_names():
    from tarn import catalogue

    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
