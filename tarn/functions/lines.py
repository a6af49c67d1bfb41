"""Column rules for single lines of source, types, tags and symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.sources.routines import NO_CALLS

#: Names and text that tell input from outside (fixed values).
INPUT_CALLS = ("readline", "readchar", "readpasswordfromstdin", "getch", "getkey", "getkeywithtimeout", "commandlineparams", "paramstr", "recv", "recvfrom", "recvline", "receive", "readall")
INPUT_TEXT = ("stdin.read", "stdin.readline(", "stdin.readchar(", "readline(stdin", "readlinefromstdin(", "readpasswordfromstdin(", "commandlineparams(", "paramstr(", "recv(", "recvfrom(", "recvline(", "receive(", "getch(", "getkey(")
#: Spellings of declared roles (fixed values).
ROLE_LABELS = {
    "truthbuilder": "truth builder", "truth_builder": "truth builder", "truthstate": "truth state", "datafetcher": "data fetcher", "data_fetcher": "data fetcher", "datawriter": "data writer",
    "metaorchestrator": "meta orchestrator", "meta_orchestrator": "meta orchestrator", "metaparser": "meta parser", "statecontroller": "state controller", "state_controller": "state controller",
    "preparddata": "prepared data", "otherrole": "other", "preparedata": "prepared data", "prepareddata": "prepared data", "rawdata": "raw data",
}
#: Symbols that a compiler defines by itself (fixed values).
IMPLICIT = ("aarch64", "amd64", "android", "arm", "arm64", "debug", "danger", "dragonfly", "emscripten", "freebsd", "haiku", "i386", "ios", "js", "linux", "macosx", "netbsd", "nimvm", "openbsd", "posix", "release", "solaris", "threads", "unix", "wasm", "wasm32", "windows")
#: Endings of settings types, and words that refuse (fixed values).
SETTING_ENDINGS = ("config", "settings", "options", "preferences", "opts", "prefs")
REFUSALS = ("raise", "quit", "error", "abort", "invalid", "cannot")
#: Calls that add to a field and that empty it; words of names that take a value away (fixed values).
FOLDING = (".add(", ".incl(", ".insert(", ".mgetOrPut(", ".addLast(", ".addFirst(", ".push(")
REPLACING = (".setLen(", ".clear(", ".reset(", ".del(", ".delete(")
RESETS = ("clear", "reset", "wipe", "zero", "erase", "destroy", "free", "dispose")
#: Words that branch (fixed values).
BRANCHES = ("if", "elif", "while", "for", "case", "of", "and", "or", "try", "except")
#: Fields that carry a failure, and calls that no caller can catch (fixed values).
FAILURE_FIELDS = ("error", "err", "ok", "success", "failed", "reason")
ABORTS = ("quit(", "doAssert", "assert ", "raiseAssert", "sysFatal", "abort(")
#: Unsafe operations by the file's ending: kind and what shows it, in order (fixed values).
UNSAFE = {
    ("nim", "nims"): (("cast", ("cast[",)), ("addr", ("addr(", "unsafeAddr(")), ("uncheckedArray", ("UncheckedArray[", "uncheckedArray")), ("alloc", ("alloc(", "dealloc(")), ("copyMem", ("copyMem(",))),
    ("c", "cpp", "h"): (("malloc", ("malloc(", "free(")), ("memcpy", ("memcpy(", "strcpy(")), ("pointerCast", ("(void*)", "cast"))),
}


def _any(column: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(w)) for w in words])


def without_text(line: Column) -> Column:
    """The line with what stands in quotes taken out, and without its comment."""
    return F.regexp_replace(F.regexp_replace(line, r'"(?:\\.|[^"\\])*"', '""'), "#.*$", "")


def names_called(line: Column) -> Column:
    """Names before a bracket, each once, in order; words of the language aside."""
    found = F.array_distinct(F.regexp_extract_all(without_text(line), F.lit(r"([A-Za-z_]\w*)\s*(?:\[[^\[\]]*\])?\("), F.lit(1)))
    return F.filter(found, lambda x: ~x.isin(*sorted(NO_CALLS)))


def names_after_dots(line: Column) -> Column:
    return F.regexp_extract_all(without_text(line), F.lit(r"\.\s*([A-Za-z_]\w*)"), F.lit(1))


def names_passed(line: Column) -> Column:
    """Names that stand alone between a bracket or comma and a comma or bracket."""
    return F.regexp_extract_all(without_text(line), F.lit(r"(?<=[(,])\s*([A-Za-z_]\w*)\s*(?=[,)])"), F.lit(1))


def pragma_names(text: Column) -> Column:
    """Names at the beginning of each entry between ``{.`` and ``.}``, over all lines of a text, each once."""
    inside = F.regexp_extract_all(F.regexp_replace(text, r"#[^\n]*", ""), F.lit(r"(?s)\{\.(.*?)\.\}"), F.lit(1))
    names = F.transform(F.flatten(F.transform(inside, lambda x: F.split(x, ","))), lambda x: F.regexp_extract(x, r"^\s*(\w*)", 1))
    return F.filter(F.array_distinct(names), lambda x: x != "")


def raises_declared(signature: Column) -> Column:
    """Names in ``raises: [...]``; an empty list if it says that nothing escapes, null if it says nothing."""
    inside = F.regexp_extract(signature, r"raises:[^\[]*\[([^\]]*)\]", 1)
    return F.when(signature.rlike(r"raises:[^\[]*\[[^\]]*\]"), F.filter(F.transform(F.split(inside, ","), lambda x: F.trim(x)), lambda x: x != ""))


def flags(line: Column) -> Column:
    """Symbols in ``defined(x)``, without those that compilers define."""
    found = F.array_distinct(F.regexp_extract_all(line, F.lit(r"defined\s*\(?\s*(\w+)"), F.lit(1)))
    return F.filter(found, lambda x: ~F.lower(x).isin(*IMPLICIT))


def stable_id(path: Column, routine: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat(path, F.lit("-"), routine)), "[^a-z0-9_]+", "-"), "^-+|-+$", "")


def is_literal(argument: Column) -> Column:
    return F.trim(argument).rlike(r"""^(["'].*|-?[0-9].*|true|false|nil|@\[\])$""")


def unsafe_kind(line: Column, ending: Column) -> Column:
    """The first unsafe operation that a line shows; null without one."""
    out = F.when(F.lit(False), "")
    for endings, kinds in UNSAFE.items():
        for kind, signs in kinds:
            out = out.when(ending.isin(*endings) & _any(line, signs), kind)
    return out


def is_condition(line: Column) -> Column:
    return F.trim(line).rlike(r"^(when |#ifdef |#if )")


def vector_feature(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("avx")), "AVX").when(F.contains(line, F.lit("sse")), "SSE").when(F.contains(line, F.lit("neon")), "NEON").when(F.contains(line, F.lit("nimsimd")) | F.contains(line, F.lit("vector")), "SIMD")


def platforms(line: Column) -> Column:
    """The platforms that a condition names."""
    s = F.lower(line)
    rules = (("windows", ("windows", "_win32")), ("linux", ("linux", "__linux__")), ("nixos", ("nixos", "nix")), ("posix", ("posix",)))
    return F.filter(F.array(*[F.when(_any(s, words), name) for name, words in rules]), lambda x: x.isNotNull())


def branch_words(line: Column) -> Column:
    """How many branching words a line holds outside texts and comments."""
    return F.size(F.filter(F.split(without_text(line), r"[ ():,\[\]\t]"), lambda w: w.isin(*BRANCHES)))


def is_branch_head(line: Column) -> Column:
    return F.trim(line).rlike(r"^(of |elif |else:|else )")


def is_setting_type(name: Column, declaration: Column | None = None) -> Column:
    said = F.contains(F.lower(declaration), F.lit("configurator")) if declaration is not None else F.lit(False)
    return said | F.lower(name).rlike(rf"({'|'.join(SETTING_ENDINGS)})$") | F.lower(name).isin("cfg", "conf")


def built_in(line: Column, kind: Column, field: Column) -> Column:
    """Whether a line sets a field by building the whole object."""
    return F.rlike(line, F.concat(kind, F.lit(r"\((|.*[^\w.])"), field, F.lit(":")))


def refuses(line: Column) -> Column:
    s = F.lower(F.trim(line))
    return s.rlike(rf"^({'|'.join(REFUSALS)})") | s.rlike(rf"({'|'.join(REFUSALS)}) ")


def use_kind(after: Column) -> Column:
    """What follows a field's name makes of it: 0 a read, 1 a write that loses what was there, 2 one that keeps the rest."""
    rest = F.regexp_replace(F.trim(after), r"^(\[[^\[\]]*\]\s*)+", "")
    stepped = F.trim(after).startswith("[")
    begins = lambda words: reduce(lambda a, b: a | b, [rest.startswith(w) for w in words])
    lost = F.when(stepped, 2).otherwise(1)
    return F.when(begins(FOLDING), 2).when(begins(REPLACING), lost).when(rest.rlike(r"^=[=~]"), 0).when(rest.rlike(r"^[-+*/&]="), 2).when(rest.startswith("="), lost).otherwise(0)


def input_kind(sockets: Column) -> Column:
    """0 takes nothing, 1 plain values, 2 lists, 3 things that it changes."""
    from tarn.functions.code import lower_type

    ins = F.filter(sockets, lambda s: s["direction"] != "out")
    lists = F.exists(ins, lambda s: lower_type(s["type"]).rlike("^(seq|array|table|hashset)"))
    return F.when(F.size(ins) <= 0, 0).when(F.exists(ins, lambda s: s["direction"] == "var"), 3).when(lists, 2).otherwise(1)


def input_types(sockets: Column) -> Column:
    from tarn.functions.code import lower_type

    return F.array_join(F.transform(F.filter(sockets, lambda s: s["direction"] != "out"), lambda s: lower_type(s["type"])), ",")


def role_label(raw: Column) -> Column:
    t = F.lower(F.trim(raw))
    out = F.when(F.lit(False), "")
    for spelling, label in ROLE_LABELS.items():
        out = out.when(t == spelling, label)
    return out.otherwise(t)


def sample_value(kind: Column, depth: int = 3) -> Column:
    """A value of a type as it is written in source; lists and options hold one of their inner type, ``depth`` levels down."""
    raw = F.trim(F.regexp_replace(kind, r"^\s*(var|lent|sink)\s+", ""))
    t = F.regexp_replace(F.lower(raw), " ", "")
    inner = F.trim(F.regexp_extract(raw, r"^[^\[]*\[(.*)\]$", 1))
    below = sample_value(inner, depth - 1) if depth else F.lit("")
    return (
        F.when(t == "", "")
        .when(t.rlike(r"^(u?int(8|16|32|64)?|byte|cint|cuint|clong|culong|csize_t)$"), "42")
        .when(t.rlike(r"^(float(32|64)?|cfloat|cdouble)$"), "3.14")
        .when(t == "bool", "true")
        .when(t.isin("string", "cstring"), '"sample"')
        .when(t == "char", "'x'")
        .when(t == "jsonnode", '%*{"sample": true}')
        .when(t.rlike(r"^(seq|openarray)\["), F.concat(F.lit("@["), F.when(inner != "", below).otherwise(""), F.lit("]")))
        .when(t.startswith("set["), "{}")
        .when(t.startswith("option["), F.when(inner == "", "none(int)").otherwise(F.concat(F.lit("some("), below, F.lit(")"))))
        .when(t.rlike(r"^(table|orderedtable)\["), F.concat(F.lit("initTable["), inner, F.lit("]()")))
        .when(F.lower(raw).rlike("^(ref|ptr) "), "nil")
        .otherwise(F.concat(F.lit("default("), raw, F.lit(")")))
    )


def symbol_name(symbol: Column) -> Column:
    """(base, module) of a symbol: lengths and letters after ``_ZN``, else what stands before two underscores or a dot."""
    plain = F.split(symbol, r"\.")[0]
    # each step takes a length and as many letters off the front
    step = lambda acc, _: F.struct(
        F.substring(acc["rest"], F.length(F.regexp_extract(acc["rest"], r"^(\d+)", 1)) + F.coalesce(F.regexp_extract(acc["rest"], r"^(\d+)", 1).try_cast("int"), F.lit(0)) + 1, F.length(acc["rest"])).alias("rest"),
        F.when(acc["rest"].rlike(r"^\d"), F.concat(acc["parts"], F.array(F.substring(acc["rest"], F.length(F.regexp_extract(acc["rest"], r"^(\d+)", 1)) + 1, F.regexp_extract(acc["rest"], r"^(\d+)", 1).try_cast("int"))))).otherwise(acc["parts"]).alias("parts"),
    )
    start = F.struct(F.substring(symbol, 4, 1 << 20).alias("rest"), F.array().cast("array<string>").alias("parts"))
    parts = F.aggregate(F.sequence(F.lit(1), F.lit(16)), start, step)["parts"]
    hidden = symbol.startswith("_ZN") & (F.size(parts) > 0)
    base = F.when(hidden, F.element_at(parts, -1)).when(F.instr(symbol, "__") > 1, F.substring_index(symbol, "__", 1)).otherwise(plain)
    return F.struct(base.alias("base"), F.when(hidden, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ".")).otherwise("").alias("module"))


def input_signals(calls: Column, body: Column) -> Column:
    """Calls that read from outside, then signs of it in the body (the first of a line), each once."""
    hits = F.filter(calls, lambda c: F.lower(F.trim(c)).isin(*INPUT_CALLS))
    bare = F.transform(body, lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, "#.*$", "")), " ", ""))
    first = F.transform(bare, lambda x: F.get(F.filter(F.array(*map(F.lit, INPUT_TEXT)), lambda h: F.contains(x, h)), F.lit(0)))
    return F.array_distinct(F.concat(hits, F.filter(first, lambda x: x.isNotNull())))


def resets(name: Column) -> Column:
    return _any(F.lower(name), RESETS)


def aborts(line: Column) -> Column:
    return _any(without_text(line), ABORTS)
