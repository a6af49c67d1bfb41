"""Routines out of source text: a reader of indented routine blocks, and the tables made of what it finds.

The reader is plain Python and runs where the files are; everything after it is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("proc", "func", "method", "iterator", "template", "macro", "converter")
#: Words before a bracket that call nothing (fixed values).
NO_CALLS = frozenset("if elif while for case of when and or not in is div mod return discard raise assert except var let const type proc func method iterator template macro converter yield echo block try finally static defer cast addr".split())
HEAD = re.compile(rf"^(\s*)({'|'.join(KINDS)})[ `]+([^\s`(*\[:=]+)`?(\*?)")
CALL = re.compile(r"([A-Za-z_]\w*)\s*(?:\[[^\[\]]*\])?\(")
TEXT = re.compile(r'"(?:\\.|[^"\\])*"')
FUNCTION = (
    "fn_id string, module string, path string, name string, decl_kind string, exported boolean, return_type string, line_start long, line_end long, ord long,"
    " sockets array<struct<name:string,type:string,direction:string,sample:string>>, tags array<string>, docs array<string>, body array<string>, calls array<string>"
)


def bare(line: str) -> str:
    """A line with its texts emptied and without a comment."""
    return TEXT.sub('""', line).split("#", 1)[0].rstrip()


def split_top(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside brackets and texts."""
    parts, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == '"' and (i == 0 or text[i - 1] != "\\"):
            quoted = not quoted
        elif not quoted:
            depth += (c in "([{") - (c in ")]}")
            if c == mark and depth == 0:
                parts.append(text[start:i])
                start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def closing(text: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes, or -1."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in "([{") - (text[i] in ")]}")
        if depth == 0:
            return i
    return -1


def sockets(params: str) -> list[dict]:
    """Inputs of a parameter list; names that share a type each get it, with the default as a sample."""
    got = []
    for group in split_top(params.replace(";", ","), ","):
        names, _, rest = group.partition(":")
        kind, _, sample = rest.partition("=")
        if not rest and "=" in names:
            names, _, sample = names.partition("=")
        kind = kind.strip()
        got.append({"name": names.strip().strip("`"), "type": re.sub(r"^var\s+", "", kind), "direction": "var" if kind.startswith("var ") else "in", "sample": sample.strip()})
    for one, after in zip(reversed(got[:-1]), reversed(got[1:]), strict=False):  # a, b: int
        if not one["type"] and not one["sample"]:
            one["type"], one["direction"] = after["type"], after["direction"]
    return got


def routines(path: str, text: str) -> list[dict]:
    """All routines of a file, in order. A body ends where a line is indented no more than its header."""
    lines = re.sub(r'"""(.*?)"""', lambda m: '""' + "\n" * m[0].count("\n"), text, flags=re.S).splitlines()
    module = re.sub(r"\.nims?$", "", path)
    out, i = [], 0
    while i < len(lines):
        m = HEAD.match(lines[i])
        if not m:
            i += 1
            continue
        indent, head, j = len(m[1]), bare(lines[i]), i
        while j + 1 < len(lines) and j - i < 40 and not (head.count("(") <= head.count(")") and head.count("{.") <= head.count(".}") and (head.endswith("=") or not lines[j + 1].strip() or len(lines[j + 1]) - len(lines[j + 1].lstrip()) <= indent or HEAD.match(lines[j + 1]))):
            j += 1
            head += " " + bare(lines[j]).strip()
        body, k = [], j + 1
        while k < len(lines) and head.rstrip().endswith("=") and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > indent):
            body.append(lines[k])
            k += 1
        while body and not body[-1].strip():
            body.pop()
        one_line = head.split("=", 1)[1].strip() if not head.rstrip().endswith("=") and re.search(r"=\s*\S", re.sub(r"\([^)]*\)|\{\..*?\.\}", "", head)) else ""
        if one_line and not body:
            body = [one_line]
        a = head.find("(")
        z = closing(head, a) if a >= 0 else -1
        after = head[z + 1 :] if z >= 0 else head[m.end() :]
        r = re.match(r"\s*:\s*([^={]+)", after)
        pragma = re.search(r"\{\.(.*?)\.\}", head)
        docs, up = [], i - 1
        while up >= 0 and lines[up].strip().startswith("##"):
            docs.insert(0, lines[up].strip().lstrip("# "))
            up -= 1
        docs += [b.strip().lstrip("# ") for b in body if b.strip().startswith("##")]
        tags = [t.strip().strip('"').lower() for t in split_top(pragma[1], ",")] if pragma else []
        tags += [d.strip().lower() for d in docs if re.match(r"(role|risk|issue|tag)s?\s*:", d.strip().lower())]
        calls = list(dict.fromkeys(c for b in body for c in CALL.findall(bare(b)) if c not in NO_CALLS))
        returns = r[1].strip() if r else ""
        ins = sockets(head[a + 1 : z]) if a >= 0 and z > a else []
        outs = [{"name": "result", "type": returns, "direction": "out", "sample": ""}] if returns and returns != "void" else []
        out.append({"fn_id": f"{module}::{m[3]}@{i + 1}", "module": module, "path": path, "name": m[3], "decl_kind": m[2], "exported": m[4] == "*", "return_type": returns, "line_start": i + 1, "line_end": j + 1 + len(body), "ord": len(out), "sockets": ins + outs, "tags": tags, "docs": docs, "body": body, "calls": calls})
        i = j + 1
    return out


def functions(files: DataFrame) -> DataFrame:
    """The routines of all files (path, content); ids hold the line, so overloads stay apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0] for x in re.sub(r"<.*?>>?", "", FUNCTION).split(",")]
        for f in frames:
            rows = [r for p, t in zip(f["path"], f["content"], strict=True) for r in routines(p, t or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, FUNCTION)


def without_forwards(functions_: DataFrame) -> DataFrame:
    """A routine without a body goes when its module has one of that name with a body."""
    full = functions_.where(F.size("body") > 0).select("module", "name").distinct()
    return functions_.where(F.size("body") > 0).unionByName(functions_.where(F.size("body") == 0).join(full, ["module", "name"], "left_anti"))


def calls(functions_: DataFrame) -> DataFrame:
    """(caller, module, name, ord) of all calls."""
    return functions_.select(F.col("fn_id").alias("caller"), "module", F.posexplode("calls").alias("_n", "name")).select("caller", "module", "name", F.col("_n").cast("long").alias("ord"))


def imports(files: DataFrame) -> DataFrame:
    """(module, name, target, rank): symbol imports first by place, module imports (any name) after rank 1024."""
    x = files.select(F.regexp_replace("path", r"\.nims?$", "").alias("module"), F.posexplode(F.split("content", "\n")).alias("n", "text"))
    s = x.select("module", "n", F.regexp_extract("text", r"^from\s+(\S+)\s+import\s+(.+)$", 1).alias("target"), F.explode(F.split(F.regexp_extract("text", r"^from\s+(\S+)\s+import\s+(.+)$", 2), r"\s*,\s*")).alias("name")).where("target <> ''")
    m = x.select("module", "n", F.explode(F.split(F.regexp_extract("text", r"^import\s+(.+)$", 1), r"\s*,\s*")).alias("target")).where("target <> ''")
    clean = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+as\s+\w+$", "")), r"^(\./)+", "")
    return s.select("module", F.trim("name").alias("name"), clean(F.col("target")).alias("target"), F.col("n").cast("long").alias("rank")).unionByName(m.select("module", F.lit(None).cast("string").alias("name"), clean(F.col("target")).alias("target"), (F.col("n") + 1024).cast("long").alias("rank")))
