"""Queries on small tables against brute force over all rows."""

import math
import re
from collections import defaultdict

import numpy as np

from tarn.operators import similarity
from tarn.plans import streams, tables


def tables_in(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_blast_callers_uses_every_part(spark, tmp_path):
    lines = [(p, s) for p in range(1, 40) for s in (p % 3 + 50 - 3 * (p % 4), p % 5 + 46 - 2 * (p % 3))]
    d = tables_in(spark, tmp_path, lineitem=(lines, "l_partkey long, l_suppkey long"), supplier=([(s,) for s in range(40, 60)], "s_suppkey long"))
    parts, back = defaultdict(set), defaultdict(set)
    for p, s in lines:
        parts[p].add(s)
    for of in parts.values():
        for a, b in zip(sorted(of), sorted(of)[1:]):
            back[b].add(a)
    one = back[50]
    two = set().union(*(back[x] for x in one)) - one - {50}
    assert one and two
    assert {(r["node"], r["depth"]) for r in tables.blast_callers(spark, d).collect()} == {(x, 1) for x in one} | {(x, 2) for x in two}


def test_idf_weights_keeps_rare_terms(spark, tmp_path):
    texts = ["a rare word", "a common word here", "a common word there", "A  b", "a", "a common lone"]
    d = tables_in(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    df = defaultdict(int)
    for t in texts:
        for term in set(t.lower().split(" ")):
            df[term] += 1
    want = {(t, n, round(math.log((len(texts) + 1) / (n + 1)) + 1, 6)) for t, n in df.items()}
    assert {(r["term"], r["df"], r["weight"]) for r in tables.idf_weights(spark, d).collect()} == want


def test_word_jaccard_finds_all_pairs(spark, tmp_path):
    names = ["large ring", "hot bolt", "blue ring", "large ring", "tiny Ring", "old gear box", "gear box", "ab", "ring blue", "Old steelGear"]
    parts = [(i, n, ("LARGE", "SMALL STEEL", "")[i % 3], f"Brand#{i}", i) for i, n in enumerate(names * 2)]
    d = tables_in(spark, tmp_path, part=(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size long"))
    sets = {i: {w for w in re.split("[_$-]", re.sub("([a-z0-9])([A-Z])", r"\1_\2", f"{n} {t}".replace(" ", "_")).lower()) if len(w) >= 3} for i, n, t, _, _ in parts}
    want = {(a, b, round(len(x & y) / len(x | y), 6)) for a, x in sets.items() for b, y in sets.items() if a < b and x | y and len(x & y) / len(x | y) >= 0.5}
    got = [(r["a"], r["b"], r["score"]) for r in tables.word_jaccard(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_contested_from_two_shared_parts(spark, tmp_path):
    of = {1: {1, 2, 3, 4, 5, 6, 7, 8, 9}, 2: {1, 2, 3, 4, 5, 6, 7, 8}, 3: {1, 2}, 4: {9, 20}, 5: {20, 21, 9}}
    lines = [(s, p) for s, ps in of.items() for p in ps for _ in range(2)]
    d = tables_in(spark, tmp_path, lineitem=(lines, "l_suppkey long, l_partkey long"))
    want = {(a, b, len(of[a] & of[b])) for a in of for b in of if a < b and len(of[a] & of[b]) >= 2}
    assert {(r["a"], r["b"], r["shared"]) for r in tables.contested(spark, d).collect()} == want


def test_band_pairs_compares_large_buckets(spark):
    h = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 3100, dtype=np.int64) & ~np.int64(63)  # one bucket in the first band
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(h)], "id long, h long")
    want = {(a, b) for a in range(len(h)) for b in np.flatnonzero(np.bitwise_count((h[a] ^ h).view(np.uint64)) <= 20).tolist() if a < b}
    pairs, skipped = similarity.band_pairs(items, "id", "h")
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and skipped.count() == 0
    few, skipped = similarity.band_pairs(items, "id", "h", most=3000)
    assert few.count() < len(want) and [r["size"] for r in skipped.collect()] == [3100]


def test_word_jaccard_deals_out_copies(spark, tmp_path):
    parts = [(i, ("hot ring", "old ring", "blue bolt")[i % 3 if i < 30 else 0], "LARGE") for i in range(2300)]  # more copies than a block holds
    d = tables_in(spark, tmp_path, part=(parts, "p_partkey long, p_name string, p_type string"))
    q = tables.word_jaccard(spark, d)
    assert "explode(ids_b" in q._jdf.queryExecution().toString()  # lists of members are opened after all joins
    n = {w: sum(p[1] == w for p in parts) for w in ("hot ring", "old ring", "blue bolt")}
    same = sum(k * (k - 1) // 2 for k in n.values())
    got = {r["score"]: r["n"] for r in q.groupBy("score").count().withColumnRenamed("count", "n").collect()}
    assert got == {1.0: same, 0.5: n["hot ring"] * n["old ring"]} and q.where("a >= b").count() == 0 and q.select("a", "b").distinct().count() == sum(got.values())


def test_dup_lcs_names_stand_for_their_copies(spark, tmp_path):
    names = ["red nut", "nut red", "", None, "red", "old nut"]
    parts = [(i, names[i * i % 11 % 6], ("A", "B", None)[i % 3 if i % 10 == 2 else i % 2], (1, 2, None)[2 if i == 7 else i % 4 // 2]) for i in range(80)]
    got = streams.dup_lcs(spark, tables_in(spark, tmp_path, part=(parts, "p_partkey long, p_name string, p_type string, p_size int"))).collect()
    first = {i: i for i, *_ in parts} | {r["b"]: r["a"] for r in got if r["copy"]}
    alike = {(r["a"], r["b"]): (r["lcs"], r["greedy"]) for r in got}
    name = {i: n or "" for i, n, _, _ in parts}
    known = [(i, (t, s)) for i, _, t, s in parts if t is not None and s is not None]
    for i, x in known:  # every pair that the query stands for, by definition
        for j, y in known:
            if i < j and x == y:
                want = (round(similarity._lcs(name[i], name[j]), 6), round(similarity._greedy(name[i], name[j]), 6))
                f, g = sorted((first[i], first[j]))
                assert (alike[f, g] if f != g else (float(name[i] != ""),) * 2) == want
    assert len(alike) == len(got) and all(a < b for a, b in alike) and len({(x, name[i]) for i, x in known}) == len(known) - sum(r["copy"] for r in got)
    of = dict(known)
    assert all(of[a] == of[b] for a, b in alike) and max(sum(not r["copy"] for r in got), 1) <= 4 * 10  # 5 names at most in each of 4 kinds


def greedy(links, n, near):
    """Stars by definition over all copies: (first ones' class, copy) as nodes."""
    nodes = [(c, k) for c in n for k in range(n[c])]
    around = {x: [y for y in nodes if y != x and ((x[0] == y[0] and near[x[0]]) or frozenset((x[0], y[0])) in links)] for x in nodes}
    free, out = set(nodes), set()
    for x in sorted(nodes, key=lambda x: (-len(around[x]), x)):
        if x in free and (took := [y for y in around[x] if y in free]):
            out |= {(x, x)} | {(x, y) for y in took}
            free -= {x, *took}
    return out


def test_stars_in_few_rounds_and_by_classes(spark, monkeypatch):
    from tarn import session

    draw = np.random.default_rng(5)
    links = {frozenset((int(a), int(b))) for a, b in draw.integers(0, 40, (90, 2)) if a != b}
    pairs = spark.createDataFrame([(max(x), min(x)) for x in links], "a long, b long")
    nodes = {c for x in links for c in x} | {50, 51, 52}
    n = {c: 1 if c % 3 else c % 4 + 1 for c in nodes} | {50: 3, 51: 3, 52: 1}
    near = {c: c % 5 > 0 for c in nodes} | {50: True, 51: False, 52: True}
    calls, keep = [], session.stored
    monkeypatch.setattr(session, "stored", lambda df: calls.append(1) or keep(df))
    for few in (0, 100_000):  # in rounds, and all on the driver
        monkeypatch.setattr(similarity, "FEW_PAIRS", few)
        calls.clear()
        got = {(r["centre"], r["member"]) for r in similarity.star_clusters(pairs).collect()}
        assert got == {(x[0], y[0]) for x, y in greedy(links, {c: 1 for c in nodes}, near)} and len(calls) <= 16
        classes = spark.createDataFrame([(c, n[c], near[c]) for c in nodes], "id long, n long, near boolean")
        got = {(r["centre"], r["member"]) for r in similarity.star_clusters(pairs, classes).collect()}
        assert got == {(x[0], y[0]) for x, y in greedy(links, n, near)}


def test_near_vectors_finds_all_pairs_of_bands(spark):
    v = np.random.default_rng(7).normal(size=(120, 64)).astype(np.float32)
    v[40:80] = v[:40] + v[40:80] * np.float32(0.3)
    v[100], v[101] = 0, v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (201, [1.0]), (202, [float("nan")] * 64)]
    items = spark.createDataFrame(rows, "id long, v array<float>").withColumn("h", similarity.sign_hash("v", 64))
    h = {r["id"]: r["h"] & (1 << 64) - 1 for r in items.where("h IS NOT NULL").collect()}
    unit = v.astype(np.float64) / np.maximum(np.linalg.norm(v.astype(np.float64), axis=1), 1e-300)[:, None]
    want = {}
    for i in range(120):
        for j in range(i + 1, 120):
            differ, d = h[i] ^ h[j], max(0.0, 1 - unit[i] @ unit[j])
            if 100 not in (i, j) and differ.bit_count() <= 20 and any(not differ >> 6 * k & 63 for k in range(11)) and d <= 0.8:
                want[i, j] = d
    for block in (2048, 5):
        found = similarity.near_vectors(items, "id", "v", "h", 0.8, block=block).collect()
        got = {(r["a"], r["b"]): r["distance"] for r in found}
        assert len(found) == len(got) > 40 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
