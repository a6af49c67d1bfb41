"""Machine code as tables: control-flow blocks, and a forward search for branches and addresses that hang on secrets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Registers of the x86-64 calling convention and their names by width (fixed values).
NAMES = {"rax": ("eax", "ax", "al", "ah"), "rbx": ("ebx", "bx", "bl", "bh"), "rcx": ("ecx", "cx", "cl", "ch"), "rdx": ("edx", "dx", "dl", "dh"), "rsi": ("esi", "si", "sil"), "rdi": ("edi", "di", "dil"), "rbp": ("ebp", "bp", "bpl"), "rsp": ("esp", "sp", "spl")} | {f"r{i}": (f"r{i}d", f"r{i}w", f"r{i}b") for i in range(8, 16)}
ARGUMENTS = ("rdi", "rsi", "rdx", "rcx", "r8", "r9")
VOLATILE = ("rax", "rcx", "rdx", "rsi", "rdi", "r8", "r9", "r10", "r11")
WHOLE = {n: w for w, ns in NAMES.items() for n in (w, *ns)}
REGISTER = re.compile(r"\b(" + "|".join(sorted(WHOLE, key=len, reverse=True)) + r")\b")
#: Mnemonics that write the first operand without reading it; and those that only compare.
MOVES, COMPARES = ("mov", "movzx", "movsx", "movsxd", "movabs", "lea", "set", "pop"), ("cmp", "test", "bt", "ucomis", "comis")
STEPS = 2_000_000


def blocks(instructions: DataFrame) -> DataFrame:
    """(routine, address, mnemonic, operands, target, block): a block begins at a routine's start, a jump target or after a jump."""
    i = instructions.join(instructions.select("routine", F.col("target").alias("address"), F.lit(True).alias("_goal")).where("address IS NOT NULL").distinct(), ["routine", "address"], "left")
    w = Window.partitionBy("routine").orderBy("address")
    jump = F.lag("mnemonic").over(w).rlike("^(j|ret)")
    lead = F.when(F.coalesce("_goal", F.lit(False)) | F.coalesce(jump, F.lit(True)), 1).otherwise(0)
    return i.withColumn("_lead", lead).withColumn("block", F.sum("_lead").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_lead", "_goal")


def _registers(text: str) -> set[str]:
    return {WHOLE[r] for r in REGISTER.findall(text)}


def _step(state: frozenset, flags: bool, op: str, operands: list[str]) -> tuple[frozenset, bool, list[str]]:
    """Marks after an instruction, and what it gives away: BRANCH on marked flags, ADDRESS from marked registers."""
    found = []
    memory = [o for o in operands if "[" in o]
    if op != "lea" and any(_registers(o[o.index("[") :]) & state for o in memory):
        found.append("ADDRESS")
    if re.match(r"^(j(?!mp)|loop)", op):
        return state, flags, found + (["BRANCH"] if flags else [])
    if op in ("jmp", "call") and operands and _registers(operands[0]) & state:
        found.append("ADDRESS")
    if op == "call":
        return frozenset(state - set(VOLATILE)), False, found
    if op in ("jmp", "ret", "nop", "push") or not operands:
        return state, flags, found
    if op.startswith(COMPARES):
        return state, bool(set().union(*map(_registers, operands)) & state) or any(f"m:{o}" in state for o in memory), found
    goal, sources = operands[0], operands[1:]
    if op == "xor" and len(operands) == 2 and operands[0] == operands[1]:
        marked = False
    else:
        read = sources if op.startswith(MOVES) else operands
        marked = any(_registers(o) & state if "[" not in o else (_registers(o[o.index("[") :]) & state or f"m:{o}" in state) for o in read) or (op.startswith(("set", "cmov", "adc", "sbb")) and flags)
    names = {f"m:{goal}"} if "[" in goal else _registers(goal)
    state = frozenset(state | names if marked else state - names)
    return state, flags if op.startswith(("mov", "lea", "set", "cmov")) else marked, found


def secrets(instructions: DataFrame, arguments: tuple[str, ...] = ("rdi",)) -> DataFrame:
    """(routine, address, finding): where a branch or an address hangs on a marked argument; a fixpoint over the blocks of each routine.

    Marks are those of registers and of memory operands as written; a call clears the registers it may change. Routines
    are small and independent, so each is one task's work on a bounded group.
    """
    marked = frozenset(WHOLE[a] for a in arguments)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("address")
        by = {b: list(zip(x["address"], x["mnemonic"], x["operands"], x["target"], strict=True)) for b, x in g.groupby("block")}
        at = {x[0][0]: b for b, x in by.items()}
        order = sorted(by)
        states = {order[0]: (marked, False)} if order else {}
        work, found, budget = order[:1], set(), STEPS
        while work and budget > 0:
            b = work.pop()
            state, flags = states[b]
            for address, op, operands, _, in by[b]:
                state, flags, got = _step(state, flags, op, list(operands))
                found |= {(address, f) for f in got}
                budget -= 1
            last = by[b][-1]
            after = []
            if not re.match("^(jmp|ret)", last[1]) and (k := order.index(b) + 1) < len(order):
                after.append(order[k])
            if last[1].startswith("j") and last[3] in at:
                after.append(at[last[3]])
            for n in after:
                old = states.get(n)
                new = (state | old[0], flags or old[1]) if old else (state, flags)
                if new != old:
                    states[n] = new
                    work.append(n)
        name = g["routine"].iloc[0] if len(g) else None
        return pd.DataFrame([(name, a, f) for a, f in sorted(found)], columns=["routine", "address", "finding"])

    return blocks(instructions).groupBy("routine").applyInPandas(run, "routine string, address long, finding string")
