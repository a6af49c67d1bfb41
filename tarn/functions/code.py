"""Column rules for paths, lines, names and scores of source trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.scan import sequenced

#: Folders of code that is not one's own (fixed values).
VENDORED = (".git", "build", "builds", "nimcache", ".nimble_cache", "dist", "node_modules", "submodules")
#: Endings of source files that are read (fixed values).
SOURCES = ("nim", "c", "h", "cpp", "hpp", "js", "ts", "html", "css", "json", "toml", "md", "py", "sh")


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name; empty without one or if the name begins with it."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))


def is_ignored(path: Column, tests: bool = False, more: tuple[str, ...] = ()) -> Column:
    """Below a folder of other people's code, or one of ``more``, such as the scratch folder of a tool."""
    names = VENDORED + (("tests",) if tests else ()) + more
    return F.lower(F.concat(F.lit("/"), F.translate(path, "\\", "/"), F.lit("/"))).rlike(f"/({_any_of(names)})/")


def is_scannable(path: Column) -> Column:
    return extension(path).isin(*SOURCES) & ~is_ignored(path)


def is_test(path: Column) -> Column:
    """Below a test folder, or, outside src, a file named test_* or *_test.nim."""
    p = F.translate(path, "\\", "/")
    return p.rlike(r"(^|/)tests?/") | (~p.rlike(r"(^|/)src/") & p.rlike(r"(^|/)(test_[^/]*|[^/]*_test\.nim)$"))


def is_src(path: Column) -> Column:
    return F.translate(path, "\\", "/").rlike(r"(^|/)src/") & ~is_test(path)


def module_of(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"\.nim$", "")


def line_letter(line: Column) -> Column:
    """One letter for what a code line does; null for blank and comment lines. The first rule that fits counts."""
    s = F.trim(line)
    starts = lambda *w: reduce(lambda a, b: a | b, [s.startswith(x) for x in w])
    # the rules in order (fixed values)
    rules = [
        ("F", starts("for ")), ("W", starts("while ")), ("E", starts("elif ", "else")), ("I", starts("if ")), ("C", starts("case ")), ("O", starts("of ")),
        ("T", starts("try", "except", "finally")), ("X", starts("raise ", "quit")), ("R", starts("return", "result")), ("V", starts("var ", "let ", "const ")),
        ("A", s.contains("=") & ~s.contains("==")), ("K", s.contains("(")),
    ]
    out = F.when((s == "") | s.startswith("#"), F.lit(None).cast("string"))
    for letter, rule in rules:
        out = out.when(rule, letter)
    return out.otherwise(".")


def skeleton(lines: DataFrame, key: str, order: str, text: str, most: int = 160) -> DataFrame:
    """(key, skeleton): the letters of a routine's code lines in order, the first ``most``."""
    x = lines.select(key, order, line_letter(F.col(text)).alias("l")).where("l IS NOT NULL")
    x = x.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("n") <= most)
    return x.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "l"))), lambda s: s["l"]), "").alias("skeleton"))


def return_kind(name: Column) -> Column:
    """0 nothing, 1 number, 2 text, 3 list, 4 truth, 5 other."""
    t = lower_type(name)
    return F.when((t == "") | (t == "void"), 0).when(t.rlike(r"^(u?int\d*|float\d*|natural|positive|byte)$"), 1).when(t.rlike("^(string|cstring|char)$"), 2).when(t.rlike(r"^(seq|array|set|hashset)\["), 3).when(t == "bool", 4).otherwise(5)


def lower_type(name: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(name)), r"^((var|ref|ptr|lent)\s+)+", "")
    return F.regexp_replace(F.regexp_replace(t, "openarray", "seq"), r"\s", "")


def verdict(tests: Column, edge: Column, regression: Column) -> Column:
    return F.when(tests == 0, "unchecked").when(~edge & ~regression, "shallow").otherwise("solid")


#: Languages, how each writes a comment, and the strong and weak words that tell it (fixed values).
SIGNATURES = (
    ("html", "<!-- -->", ("<!doctype", "<html", "<body", "<head>", "</div>", "</span>"), ("<div", "<p>", "<a ", "<table", "class=", "href=", "</")),
    ("css", "/* */", ("@media", "@keyframes", "!important"), ("px;", "rem;", "margin:", "padding:", "color:", "background:", "display:", "border:")),
    ("javascript", "//", ("function ", "=>", "document.", "console.", "addEventListener", "querySelector"), ("const ", "let ", "var ", "return ", "null", "undefined", "typeof ", "new Set(", "JSON.")),
    ("typescript", "//", ("interface ", "implements ", "as const", ": Promise<", "readonly "), (": string", ": number", ": boolean", "export type", "<T>")),
    ("c", "//", ("#include", "int main(", "printf(", "malloc(", "size_t ", "typedef struct"), ("unsigned ", "->", "NULL", "sizeof(", "static void", "char *")),
    ("opencl", "//", ("__kernel", "get_global_id", "__global", "__local", "barrier(CLK"), ("float4", "int4", "uchar", "clEnqueue")),
    ("objectivec", "//", ("@interface", "@implementation", "NSString", "@autoreleasepool", "nonatomic"), ("[[", "alloc]", "@property", "NSObject")),
    ("python", "#", ("def ", "elif ", "__init__", "self.", "lambda ", "if __name__"), ("None", "True", "False", "print(", "import ", "except ", "raise ")),
    ("assembly", ";", (".globl", ".section", "movq ", "pushq ", "%rax", "%rsp", "xmm0"), ("mov ", "push ", "pop ", "jmp ", "ret", "call ", "nop")),
    ("sql", "--", ("select ", "insert into", "create table", "left join"), (" from ", " where ", " group by ", " order by ")),
    ("shell", "#", ("#!/bin/sh", "#!/bin/bash", "esac", "fi;"), ("echo ", "$(", "then", "done", "elif ")),
)
#: What opens and closes a string of several lines, by the file's ending, and what a file of an ending is written in (fixed values).
DELIMITERS = (("nim", '"""', '"""'), ("py", '"""', '"""'), ("py", "'''", "'''"), ("js", "`", "`"), ("ts", "`", "`"), ("html", "<script", "</script>"), ("html", "<style", "</style>"))
HOSTS = {"js": "javascript", "ts": "typescript", "py": "python", "html": "html", "css": "css"}


def classify(texts: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(key, language, score): strong words count 3 and weak ones 1, each once, in any case; the best score wins, the first of equal ones.

    Under ``least`` a text that looks like code is ``other`` with that score, and one that does not is left out.
    """
    t = F.lower("text")
    score = lambda strong, weak: reduce(lambda a, b: a + b, [F.when(F.contains(t, F.lit(w.lower())), n).otherwise(0) for ws, n in ((strong, 3), (weak, 1)) for w in ws])
    scores = F.array(*[F.struct(score(strong, weak).alias("score"), F.lit(-i).alias("ord"), F.lit(lang).alias("language")) for i, (lang, _, strong, weak) in enumerate(SIGNATURES)])
    best = texts.select(key, F.array_max(scores).alias("b"), looks_like_code(F.col("text")).alias("code"))
    known = F.col("b.score") >= least
    return best.select(key, F.when(known, F.col("b.language")).when(F.col("code"), "other").alias("language"), F.when(known, F.col("b.score")).otherwise(least).alias("score")).where("language IS NOT NULL")


def looks_like_code(text: Column) -> Column:
    """Two or more lines that are not blank, at least half of them with an ending or a form of code."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    hits = F.filter(lines, lambda x: F.trim(x).rlike(r"[;{}:]$") | (F.contains(x, F.lit("(")) & F.contains(x, F.lit(")"))) | F.contains(F.trim(x), F.lit(" = ")))
    return (F.size(lines) >= 2) & (F.size(hits) * 2 >= F.size(lines))


def strangers(items: DataFrame) -> DataFrame:
    """(path, grp, first, last, own, strangers): of each group, the items of its path that start strictly inside its span and are not its own.

    Counts come from positions in one order, so no group is compared with all others. Lines are distinct in a path.
    """
    s = sequenced(items, ["path", "line"])
    g = s.groupBy("path", "grp").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count(F.lit(1)).alias("own"), F.min("pos").alias("_a"), F.max("pos").alias("_b"))
    return g.select("path", "grp", "first", "last", "own", (F.col("_b") - F.col("_a") + 1 - F.col("own")).alias("strangers"))


def waists(items: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, cut, waist): for each cut before place k, how many items above are still called from below.

    items(path, id, ord), calls(caller, callee). An item is open from the cut after it to its last caller: +1 and -1 at
    the ends of these stretches, summed along the cuts.
    """
    a = items.select("path", F.col("id").alias("callee"), F.col("ord").alias("at"))
    b = items.select("path", F.col("id").alias("caller"), F.col("ord").alias("from"))
    last = calls.join(a, "callee").join(b, ["path", "caller"]).where(F.col("from") > F.col("at")).groupBy("path", "callee", "at").agg(F.max("from").alias("last"))
    steps = last.select("path", (F.col("at") + 1).alias("cut"), F.lit(1).alias("d")).unionByName(last.select("path", (F.col("last") + 1).alias("cut"), F.lit(-1).alias("d")))
    cuts = items.select("path", F.col("ord").alias("cut"), F.lit(0).alias("d"))
    per = steps.unionByName(cuts).groupBy("path", "cut").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("path").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select("path", "cut", F.sum("d").over(w).alias("waist")).join(items.select("path", F.col("ord").alias("cut")).distinct(), ["path", "cut"], "left_semi")


def move_score(seconds: Column) -> Column:
    """A ramp to 0.04 s, full to 0.3, down to 0.3 at 0.6, then 0.1."""
    return F.when(seconds < 0.04, seconds / 0.04).when(seconds <= 0.3, 1.0).when(seconds <= 0.6, 1 - (seconds - 0.3) / 0.3 * 0.7).otherwise(0.1)


def near_score(hops: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (hops - 2) / 8))


def kept_share(old: Column, screen: Column) -> Column:
    """Null for an empty screen."""
    return F.when(screen > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - old / screen)))


#: Words of a test's name and suite that tell its kind, in order (fixed values).
KIND_WORDS = (
    ("bugfix", ("bugfix", "bug #", "issue #")),
    ("regression", ("regression", "must not come back", "stays fixed")),
    ("benchmark", ("benchmark", "bench ", "throughput", "how fast", "speed of")),
    ("edge case", ("edge", "empty", "boundary", "overflow", "zero-length", "out of range", "malformed", "truncated")),
    ("fuzz", ("fuzz", "random")),
    ("smoke", ("smoke", "starts at all")),
    ("property", ("property", "invariant", "for every")),
    ("integration", ("integration", "end to end", "together")),
)


def test_kind(name: Column, suite: Column | None = None) -> Column:
    """The kind that the words of a test's name and suite tell; the first rule that fits counts."""
    n = F.lower(F.concat(name, F.lit(" "), F.coalesce(suite, F.lit("")))) if suite is not None else F.lower(F.concat(name, F.lit(" ")))
    out = F.when(F.lit(False), "")
    for kind, some in KIND_WORDS:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(n, F.lit(w)) for w in some]), kind)
    return out.otherwise("unit")


def pragma_kind(tag: Column) -> Column:
    """The kind that a tag ``testKind: tkX`` declares; null for other tags, ``other`` for unknown kinds."""
    t = F.lower(F.trim(tag))
    value = F.regexp_replace(F.regexp_extract(t, "^testkind:(.*)$", 1), r"^[{} .]+|[{} .]+$", "")
    known = {"tkunit": "unit", "tkedgecase": "edge case", "tkbenchmark": "benchmark", "tkregression": "regression", "tkbugfix": "bugfix", "tkintegration": "integration", "tkfuzz": "fuzz", "tksmoke": "smoke", "tkproperty": "property"}
    out = F.when(~t.startswith("testkind:"), F.lit(None).cast("string"))
    for word, kind in known.items():
        out = out.when(value == word, kind)
    return out.otherwise("other")


def setting_verdict(reads: Column, writes: Column, has_default: Column | None = None) -> Column:
    """A setting that nothing writes is never set only if it has no default."""
    default = has_default if has_default is not None else F.lit(False)
    return F.when((reads == 0) & (writes > 0), "does nothing").when(reads == 0, "untouched").when((writes == 0) & ~default, "never set").when(writes >= 3, "contested").otherwise("fine")
