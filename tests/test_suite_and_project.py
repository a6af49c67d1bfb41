"""The bit suite against plain definitions, and project operators that have no query of their own."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import code, lines
from tarn.operators import bits, project, ranking, reports, similarity


def counted(x, m):
    out = {}
    for i in range(len(x)):
        k = tuple(x[(i + j) % len(x)] for j in range(m))
        out[k] = out.get(k, 0) + 1
    return out.values()


def plain(x):
    """(name, statistic) of the full suite by its definitions, where they are short."""
    n, walk = len(x), np.cumsum(2 * x - 1)
    want = {"monobit": abs(walk[-1]) / math.sqrt(n), "block_frequency": 4 * 128 * sum((x[i : i + 128].mean() - 0.5) ** 2 for i in range(0, n - 127, 128))}
    want["runs"] = float(1 + (x[1:] != x[:-1]).sum())
    want["cumulative_sums_fwd"] = float(np.abs(walk).max())
    want["cumulative_sums_rev"] = float(np.abs(np.cumsum((2 * x - 1)[::-1])).max())
    phi = {m: sum(c / n * math.log(c / n) for c in counted(x, m)) for m in (10, 11)}
    want["approx_entropy_m10"] = 2 * n * (math.log(2) - phi[10] + phi[11])
    psi = {m: 2**m / n * sum(c * c for c in counted(x, m)) - n for m in (8, 9, 10)}
    want["serial_m10_1"], want["serial_m10_2"] = psi[10] - psi[9], psi[10] - 2 * psi[9] + psi[8]
    p = 1 << (n.bit_length() - 1)
    below = (np.abs(np.fft.fft(2.0 * x[:p] - 1))[: p // 2] < math.sqrt(math.log(20) * p)).sum()
    want["spectral"] = (below - 0.95 * p / 2) / math.sqrt(p * 0.95 * 0.05 / 4)
    text, block = "".join(map(str, x)), max(1032, n // 8)
    mean, var = (block - 8) * 2**-9, block * (2**-9 - 17 * 2**-18)
    for t in range(16):
        want[f"non_overlapping_m9_t{t}"] = sum((text[i : i + block].count(format(t + 1, "09b")) - mean) ** 2 / var for i in range(0, n - block + 1, block))
    cycles = np.r_[0, np.cumsum(walk == 0)[:-1]]
    j = int((walk == 0).sum() + (walk[-1] != 0))
    for s in [k for k in range(-9, 10) if k]:
        want[f"random_excursions_variant_x{s}"] = float(abs((walk == s).sum() - j))
        if abs(s) <= 4:
            seen = np.minimum([((walk == s) & (cycles == c)).sum() for c in range(j)], 5)
            want[f"random_excursions_x{s}"] = sum(((seen == k).sum() - j * q) ** 2 / (j * q) for k, q in enumerate(bits.VISIT_MODEL[abs(s) - 1]))
    hits = np.minimum([sum(text[i + k : i + k + 9] == "1" * 9 for k in range(1032 - 8)) for i in range(0, n - 1031, 1032)], 5)
    lam = 1024 / 512 / 2
    model = [math.exp(-lam) * lam**k / math.factorial(k) for k in range(5)]
    want["overlapping_template_m9"] = sum(((hits == k).sum() - len(hits) * q) ** 2 / (len(hits) * q) for k, q in enumerate([*model, 1 - sum(model)]))
    return want


def test_full_suite(spark):
    rng = random.Random(4)
    x = np.array([rng.random() < 0.52 for _ in range(9000)]).astype(int)
    df = spark.createDataFrame([(i, int(b)) for i, b in enumerate(x)], "i long, b int")
    got = {r["name"]: r for r in bits.suite(bits.stream_of(df, ["i"], F.col("b")), full=True).collect()}
    core = [r["name"] for r in bits.suite(bits.stream_of(df, ["i"], F.col("b"))).orderBy("ord").collect()]
    assert core == ["monobit", "block_frequency", "runs", "longest_run_m128", "rank", "spectral", "approx_entropy_m10", "serial_m10_1", "serial_m10_2", "cumulative_sums_fwd", "cumulative_sums_rev"]
    assert len(got) == 56 and got["universal_statistical_L0"]["p"] == 0
    for name, value in plain(x).items():
        if got[name]["p"] or got[name]["statistic"]:  # runs doesn't apply to a lopsided stream
            assert got[name]["statistic"] == pytest.approx(value, abs=1e-5), name
    assert got["monobit"]["p"] == pytest.approx(math.erfc(got["monobit"]["statistic"] / math.sqrt(2)))
    assert all(0 <= r["p"] <= 1 and r["passed"] == (r["p"] >= 0.01) for r in got.values())
    none = bits.suite(bits.stream_of(df.limit(0), ["i"], F.col("b")), full=True).collect()
    assert none and not any(r["passed"] for r in none)


def test_universal_and_parity(spark):
    rng = random.Random(5)
    x = [rng.randint(0, 1) for _ in range(6 * 760)]
    df = bits.stream_of(spark.createDataFrame(list(enumerate(x)), "i long, b int"), ["i"], F.col("b"))
    name, fn, p = bits._universal(df, len(x), 6)
    last, total = {}, 0.0
    for i in range(760):
        k = tuple(x[6 * i : 6 * i + 6])
        total += math.log2(i + 1 - last.get(k, 0)) if i >= 640 else 0
        last[k] = i + 1
    assert (name, fn) == ("universal_statistical_L6", pytest.approx(total / 120, abs=1e-5)) and 0 < p <= 1
    assert bits._universal(df, len(x), 5) == ("universal_statistical_L5", 0.0, 0.0)
    got = spark.createDataFrame([([5, 3], [4, 1])], "a array<long>, b array<long>").select(bits.parity(F.col("a"), F.col("b")).alias("p")).first()
    assert got["p"] == 0


def test_letters_and_signs(spark):
    want = {"for i in x:": "F", "elif a": "E", "if a == b:": "I", "finally:": "T", "except:": "T", "raise x": "X", "quit(1)": "X", "return a": "R", "const a = 1": "V", "a = b(c)": "A", "f(a == b)": "K", "when x:": ".", "# no": None, "": None}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r["s"]: r["l"] for r in df.select("s", code.line_letter(F.col("s")).alias("l")).collect()} == want
    table = np.array(similarity.signs(64))
    assert abs(table.mean()) < 0.05 and len({tuple(c) for c in table.T.tolist()}) == 64


FN = "fn_id string, name string, decl_kind string, tags array<string>, body array<string>, sockets array<struct<name:string,type:string,direction:string,sample:string>>"


def fn(name, body, tags=(), sockets=(), kind="proc"):
    return (name, name, kind, list(tags), list(body), [(*s, "") for s in sockets])


def test_placeholders_and_roles(spark):
    rows = [
        fn("empty", ["discard"]), fn("called", ["discard"]), fn("refuses", ['raise newException(E, "x")']), fn("uses", ["raise fail(a)"], sockets=[("a", "int", "in")]), fn("width", ["result = 80"], sockets=[("s", "string", "in")]),
        fn("defaultWidth", ["result = 80"]), fn("noted", ["result = work(s) # TODO later"]), fn("done", ["discard"], tags=["stage: done"]), fn("declared", ["x()"], tags=["stage: stub"]), fn("sends", [], tags=[]), fn("works", ["result = s + 1", "# plain"], sockets=[("s", "int", "in")]),
    ]
    df = spark.createDataFrame(rows, FN)
    called = spark.createDataFrame([("CALLED",), ("works",), ("refuses",), ("uses",), ("noted",), ("width",), ("defaultwidth",)], "name string")
    got = {r["fn_id"]: r["score"] for r in reports.placeholder_scores(df, called).collect()}
    assert got == {"empty": 0.85, "called": 0.7, "refuses": 0.7, "uses": 0.0, "width": 0.55, "defaultWidth": 0.0, "noted": 0.3, "done": 0.0, "declared": 1.0, "sends": 0.0, "works": 0.0}
    fns = [fn("parseAll", ["a()"] * 20, sockets=[("x", "int", "in")]), fn("tiny", ["b()"]), fn("lead", ["if a:", *["c()"] * 9]), fn("said", ["x"], tags=["role: sanitizer"]), fn("big", ["case a", "of b", "of c", "d()"], sockets=[("state", "int", "var")])]
    edges = [("parseAll", "tiny"), *[("lead", x) for x in ("tiny", "said")], ("big", "tiny"), ("big", "said")]
    roles = {r["fn_id"]: (r["role"], r["confidence"]) for r in reports.infer_roles(spark.createDataFrame(fns, FN), spark.createDataFrame(edges, "caller string, callee string")).collect()}
    assert roles["said"] == ("sanitizer", 1.0) and roles["tiny"] == ("helper", 1.0) and roles["lead"] == ("orchestrator", 1.0) and roles["big"] == ("statecontroller", 1.0) and roles["parseAll"] == ("wrapper", 0.75)


def test_doors_and_names(spark):
    s = spark.createDataFrame([("sanitise", None, False), ("x", "decryptor", True), ("cleanUp", "helper", True), ("normalize", None, True), ("y", "data_fetcher", False)], "name string, role string, i boolean")
    got = {r["name"]: (r["a"], r["b"]) for r in s.select("name", reports.is_sanitizer(F.col("role"), F.col("name")).alias("a"), project.is_door(F.col("role"), F.col("name"), F.col("i")).alias("b")).collect()}
    assert got == {"sanitise": (True, False), "x": (True, False), "cleanUp": (False, True), "normalize": (False, True), "y": (False, True)}
    f = spark.createDataFrame([("a", "Fast", "template", ["role: x", "testKind: tkSmoke"], ["fast", "go"]), ("b", "g", "proc", ["fast: 1"], ["Fast", "h"])], "fn_id string, name string, decl_kind string, tags array<string>, calls array<string>")
    assert [r["name"] for r in project.template_names(f).collect()] == ["fast"]
    assert {r["key"] for r in project.pragma_keys(f).collect()} == {"role", "testkind", "fast"}
    assert {r["fn_id"]: r["n"] for r in project.template_uses(f, project.template_names(f)).collect()} == {"a": 1, "b": 2}
    blocks = spark.createDataFrame([("t1", "unit")], "test_id string, kind string")
    assert {(r["test_id"], r["kind"]) for r in project.gather_tests(blocks, f).collect()} == {("t1", "unit"), ("a", "smoke")}
    assert [len(x.collect()) for x in project.split_tests(spark.createDataFrame([("src/a.nim",), ("tests/b.nim",), ("test_c.nim",)], "path string"))] == [1, 2]
    calls = spark.createDataFrame([(["readLine", "f"], ["x = stdin.readLine()  # recv(", "let a = paramStr( 1 )"])], "c array<string>, b array<string>")
    assert calls.select(lines.input_signals(F.col("c"), F.col("b")).alias("x")).first()["x"] == ["readLine", "stdin.read", "paramstr("]
    b = spark.createDataFrame([("Conf(root: a, title: b)", "Conf", "title", True), ("Conf(subtitle: b)", "Conf", "title", False), ("x.title = 1", "Conf", "title", False)], "l string, t string, f string, want boolean")
    assert all(r["got"] == r["want"] for r in b.select("want", lines.built_in(F.col("l"), F.col("t"), F.col("f")).alias("got")).collect())
    x = spark.createDataFrame([("a.nim", 1, "proc f*(a: int) ="), ("a.nim", 2, "    proc g*() ="), ("a.nim", 3, "const W* = 3"), ("b.nim", 1, "export c")], "path string, line int, text string")
    assert {(r["path"], r["name"]) for r in project.exported_names(x).collect()} == {("a.nim", "f"), ("a.nim", "W"), ("b.nim", None)}


def test_short_lists(spark):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate((("shallow", 1), ("solid", 9), ("unchecked", 2), ("unchecked", 5)))], "verdict string, guards int, name int")
    assert [r["name"] for r in ranking.ranked(df, "guards").collect()] == [3, 2, 0, 1]
    assert [r["name"] for r in ranking.ranked(df, "guards", 2).collect()] == [3, 2] and ranking.total(df).first()["total"] == 4


def test_lines_in_one_place_count_together(spark, monkeypatch):
    text = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, "# no"), ("a", 2, "z"), ("a", 2, "w"), ("a", 3, "v")], "path string, line long, text string")
    functions = spark.createDataFrame([("f", "a", 1, 1), ("g", "a", 2, 3), ("h", "a", 1, 2)], "fn_id string, path string, line_start long, line_end long")
    as_of = project.graph.nearest_before
    for order in (F.desc("sum"), F.asc("sum")):  # rows of one place may come in any order
        monkeypatch.setattr(project.graph, "nearest_before", lambda points, marks, *a, o=order: as_of(points, marks.coalesce(1).sortWithinPartitions(o), *a))
        assert {(r["fn_id"], r["code"]) for r in project.code_lengths(functions, text).collect()} == {("f", 2), ("g", 3), ("h", 4)}
