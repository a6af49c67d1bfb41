import random

from pyspark.sql import functions as F

from tarn.operators import families, machine, pages
from tarn.operators.similarity import _lcs
from tarn.sources import routines

HTML = """<body><button id=b>Go</button><details><summary>More</summary><div class="off"><a href=x>In</a><input></div></details>
<p>One<br>two</p></div></body>"""


def test_pages(spark):
    css = spark.createDataFrame([(".off { display : none } .on{color:red} .a .b{display:none} @media x{.z{display:none}}",)], "css string")
    hidden = [r[0] for r in pages.hidden_classes(css).collect()]
    assert hidden == ["off"]
    e = pages.elements(spark.createDataFrame([(1, HTML), (2, None)], "page_id long, html string"), tuple(hidden)).cache()
    assert [r["tag"] for r in e.orderBy("idx").collect()] == ["body", "button", "details", "summary", "div", "a", "input", "p", "br"]
    size = {r["idx"]: r["size"] for r in pages.sizes(e).collect()}
    assert size[0] == 9 and size[2] == 5 and size[4] == 3 and size[7] == 2
    assert {r["tag"]: r["depth"] for r in pages.controls(e).collect()} == {"button": 0, "summary": 1, "a": 2, "input": 2}
    assert pages.on_screen(e).first()["screen"] == 6
    path = F.concat("ancestors", F.array("idx"))
    two = e.where("tag IN ('a', 'br')").agg(F.collect_list(path).alias("p")).select(pages.distance(F.col("p")[0], F.col("p")[1]).alias("d"))
    assert two.first()["d"] == 5


def test_secrets(spark):
    def code(name, lines):
        return [(name, i * 4, op, ops, t) for i, (op, ops, t) in enumerate(lines)]

    rows = code("early", [("mov", ["eax", "DWORD PTR [rsi]"], None), ("cmp", ["eax", "edi"], None), ("jne", ["10"], 16), ("mov", ["eax", "0x1"], None), ("ret", [], None)])
    rows += code("steady", [("xor", ["eax", "edi"], None), ("or", ["eax", "esi"], None), ("xor", ["edi", "edi"], None), ("cmp", ["edi", "0x0"], None), ("jne", ["14"], 20), ("ret", [], None)])
    rows += code("table", [("movzx", ["eax", "dil"], None), ("mov", ["al", "BYTE PTR [rsi+rax*1]"], None), ("ret", [], None)])
    df = spark.createDataFrame(rows, "routine string, address long, mnemonic string, operands array<string>, target long")
    got = sorted((r["routine"], r["address"], r["finding"]) for r in machine.secrets(df).collect())
    assert got == [("early", 8, "BRANCH"), ("table", 4, "ADDRESS")]
    assert sorted({r["block"] for r in machine.blocks(df).where("routine = 'early'").collect()}) == [1, 2, 3]


def test_families(spark):
    one = "proc {n}(x: int): int =\n  var y = {v}\n  for i in 0 .. x:\n    y += i\n  if y > {v}:\n    y = 0\n  result = y\n\n"
    text = "".join(one.format(n=n, v=v) for n, v in (("sumSmall", 1), ("sumBig", 2), ("sumHuge", 3))) + "proc other() =\n  discard\n"
    fns = routines.functions(spark.createDataFrame([("a.nim", text)], "path string, content string"))
    s = families.shapes(fns).cache()
    assert {r["name"]: r["skeleton"] for r in s.collect()}["sumBig"] == "VFAIAR"
    fam = families.families(s).collect()
    assert len(fam) == 1 and len(fam[0]["members"]) == 3 and fam[0]["agreement"] == 1.0 and fam[0]["varying"] == 0
    assert families.duplicates(s).count() == 3


def test_duplicates_are_those_of_all_pairs(spark):
    rnd = random.Random(7)
    rows = []
    for i, n in enumerate([4, 5, 6, 7, 7, 8, 16, 16, 17, 28, 31, 33, 40, 63, 100, 170, 700, 1000]):
        skeleton = ("VF.I.R" * 200)[:n] if i % 3 else "".join(rnd.choice("VFIRK.") for _ in range(n))
        rows.append((f"f{i:02}", "m", "proc", ("sumAll", "sum_all", "otherName")[i % 3 if i > 8 else 0], skeleton[:160], float(n), *[float(rnd.choice((6, 9, 10, 10, 10))) for _ in range(7)]))
    df = spark.createDataFrame(rows, "fn_id string, module string, decl_kind string, name string, skeleton string, " + ", ".join(f"{c} double" for c in families.COUNTS))
    top = [max(1.0, *(r[5 + k] for r in rows)) for k in range(8)]
    words = lambda n: {"sumAll": {"sum", "all"}, "sum_all": {"sum", "all"}, "otherName": {"other", "name"}}[n]
    want = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0] and min(len(x[4]), len(y[4])) >= 5:
                near = 1 - (sum(((x[5 + k] - y[5 + k]) / top[k]) ** 2 for k in range(8)) / 8) ** 0.5
                name = len(words(x[3]) & words(y[3])) / len(words(x[3]) | words(y[3]))
                score = round(0.5 * near + 0.34 * _lcs(x[4], y[4]) + 0.16 * name, 6)
                if near >= 0.55 and score >= 0.72:
                    want[x[0], y[0]] = score
    got = {(r["a"], r["b"]): r["score"] for r in families.duplicates(df).collect()}
    size = {r[0]: int(r[5]) for r in rows}
    assert sum(abs(size[a].bit_length() - size[b].bit_length()) > 1 for a, b in want) > 0
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
