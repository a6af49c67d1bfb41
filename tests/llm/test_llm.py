import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import classifiers, grid_join, hilbert, hmm, mixing, ngram_join, repeats, suffixes, templates, token_counts
from tarn.llm.components import components
from tarn.llm.text import distinct, of_text, windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, _id string, sid string"
WORDS = [f"w{i}" for i in range(400)]


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def cut(x):
    return re.findall(r"[^\x20\x09-\x0D]+", low(x or ""))


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages, very long, empty and null ones, odd spaces and repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(40))
    texts = [None, "", " \n\t ", "one", "One", "two words", "ÄÖ ü\x0bx", "\x1fa\x1c b", "a▁b  c ", " ".join(rng.choice(WORDS) for _ in range(6000))]
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 120))]
        texts.append(" ".join(words))
        if i % 4 == 0:
            k = rng.randrange(len(words))
            texts.append(" ".join(words[:k] + ["New"] + words[k + 1 :]))
        if i % 5 == 0:
            texts.append(texts[-1].upper())
            texts.append(" ".join(words))
        if i % 6 == 0:
            texts.append(f"{' '.join(words[:20])} {passage} {rng.choice(WORDS)}")
    rows = [(i * 3 % 1009, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "Z", None]), 0, 7, "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[15], (None, texts[12], "en", "a", 0, 1, "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


def collected(df):
    return [r.asDict() for r in df.collect()]


def classes(rows, n, percent):
    sets = []
    for r in rows:
        w = cut(r["text"])
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[top(i)].append(r["doc_id"])
    return sorted((str(r["doc_id"]), len(s), str(min(least[top(i)]) if s and least[top(i)] else r["doc_id"])) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (2, 60)])
def test_op1_matches_brute_force(docs, n, percent):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.similar_sets(docs, n, percent).collect())
    assert got == classes(collected(docs), n, percent)


def test_op1_large_regions_go_on_with_pivots(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_REGION", 4)
    rng = random.Random(5)
    core = [rng.choice(WORDS) for _ in range(30)]
    rows = [(i, " ".join(core[:24] + [rng.choice(WORDS) for _ in range(rng.randint(0, 9))]), *[None] * 6) for i in range(24)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.similar_sets(df, 3, 80).collect())
    assert got == classes(collected(df), 3, 80)


def test_op1_dense_regions_end_in_blocks(spark, monkeypatch):
    """Texts that share one shingle are about as far from each other as from any pivot: one round, then blocks."""
    monkeypatch.setattr(ngram_join, "SMALL_REGION", 64)
    monkeypatch.setattr(ngram_join, "_levels", lambda sets, bits: np.zeros(1 << bits, dtype=np.uint8))
    rounds, cells = [], ngram_join._cells
    monkeypatch.setattr(ngram_join, "_cells", lambda *a: rounds.append(1) or cells(*a))
    # the common shingle comes first in the order of hashes for most texts, as all counters are equal
    common = min((" ".join(x) for x in zip(WORDS, WORDS[1:], WORDS[2:], WORDS[3:], strict=False)), key=lambda x: int(windows(of_text([x]), 4)[0][0]))
    rng = random.Random(6)
    rows = [(i, f"{common} {rng.choice(WORDS[:30])} {rng.choice(WORDS)}", *[None] * 6) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.similar_sets(df, 4, 85).collect())
    assert got == classes(collected(df), 4, 85)
    assert len(rounds) == 1


def test_op1_pairs_of_one_cell_against_brute_force():
    """Forests, doubtful groups and settled links of a cell, with long sets, whose sketches are wider, and held sets cut into blocks."""
    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(0, 2**63, 40_000, dtype=np.uint64) * np.uint64(2))
    base = [np.sort(rng.choice(pool, size, replace=False)) for size in (40, 60, 6000, 9000)]
    sets = []
    for b in base:
        for share in (1.0, 0.95, 0.9, 0.85, 0.8, 0.5):
            keep = rng.random(len(b)) < share
            sets.append(np.unique(np.r_[b[keep], rng.integers(0, 2**63, int((1 - share) * len(b) / 2), dtype=np.uint64)]))
    sets.sort(key=len)
    n = np.array([len(x) for x in sets])
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * ngram_join.overlap(sets[i], sets[j]) >= 80 * (n[i] + n[j] - ngram_join.overlap(sets[i], sets[j]))}
    assert all(ngram_join.overlap(sets[i], sets[j]) == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(0, 24, 5) for j in range(24))

    def parts(pairs):
        root = np.arange(len(sets))
        for i, j in pairs:
            ngram_join.merged(root, i, j)
        return {frozenset(np.flatnonzero(root == r).tolist()) for r in root}

    sketches = [ngram_join.sketch(x) for x in sets]
    assert {len(k) for k in sketches} >= {512, 2048}
    got = ngram_join.settled(n, np.arange(len(sets)), sets, 80)
    assert set(got) <= linked and parts(got) == parts(linked)
    near = {(i, j) for i, js in ngram_join.near(n, np.arange(len(sets)), sketches, 80) for j in js.tolist()}
    assert linked <= near and len(near) < len(sets) ** 2 / 4
    assert len(ngram_join.forest(n, np.arange(len(sets)), sketches, 80)) < len(sets)
    for held in (1 << 23, 4000):
        ngram_join.MOST_HELD, was = held, ngram_join.MOST_HELD
        groups = [set(g.tolist()) for g in ngram_join.doubtful(n, np.arange(len(sets)), sketches, 80)]
        ngram_join.MOST_HELD = was
        assert all(any({i, j} <= g for g in groups) for i, j in near)


def test_op1_sets_with_one_id_take_their_second_digest(spark, monkeypatch):
    ids = ngram_join.set_ids

    def poor(h, at, clash=ngram_join._NONE):
        a, b = ids(h, at)
        a = np.where(np.diff(at) > 0, a % 7 + 1, 0)
        return ngram_join.renamed(a, b, clash), b

    monkeypatch.setattr(ngram_join, "set_ids", poor)
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t u {i // 3}", *[None] * 6) for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.similar_sets(df, 4, 85).collect())
    assert got == classes(collected(df), 4, 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, i) for i in range(60, 90)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 50 for i in [50, *range(60, 90)]}


def test_op2_shards(docs):
    rows = collected(hilbert.hilbert_shards(docs, shards=4))
    assert len(rows) == docs.count()
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in p) for p in per.values()]
    assert set(per) <= set(range(4)) and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(r["slot"] for r in p) == list(range(len(p))) for p in per.values())
    text = {r["doc_id"]: r["text"] or "" for r in collected(docs)}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_op2_curve_is_a_path(dims):
    cells = np.stack(np.meshgrid(*[np.arange(8)] * dims, indexing="ij"), -1).reshape(-1, dims)
    path = cells[np.argsort(hilbert.hilbert_index(cells, 3))]
    assert sorted(hilbert.hilbert_index(cells, 3)) == list(range(8**dims))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_op3_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(160):
        v = centres[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.4])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, rows[1][1], None), (304, [1.0, None] * 8, 0), (305, [1.0] * 15, 0), (306, [], 0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("k"))
    fine = [(k, np.array(v, dtype=float), lab) if lab is not None and v and not any(x is None or not math.isfinite(x) for x in v) and any(v) else (k, None, lab) for k, v, lab in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a, la) in enumerate(fine):
        for j, (_, b, lb) in enumerate(fine[:i]):
            if a is not None and b is not None and la == lb and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i], links[j] = links[i] + 1, links[j] + 1
                up[top(i)] = top(j)
    least = defaultdict(lambda: 10**9)
    for i, r in enumerate(rows):
        least[top(i)] = min(least[top(i)], r[0])
    want = sorted((r[0], links[i], least[top(i)], r[0] == least[top(i)]) for i, r in enumerate(rows))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in grid_join.near_duplicates(df).collect())
    assert got == want and sum(links) > 50


def test_op4_counts_and_cache(docs, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    cache = f"file://{tmp_path}/cache"
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs, cache=cache).collect())
    assert got == sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in collected(docs))
    spark = docs.sparkSession
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r["text"] or "" for r in collected(docs)})
    token_counts.token_counts(docs, cache=cache).count()
    assert spark.read.parquet(cache).count() == stored.count()  # nothing was encoded again
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("a text that no one has counted")))
    token_counts.token_counts(more, cache=cache).count()
    assert spark.read.parquet(cache).count() == stored.count() + 1


def test_op4_runs_of_spaces():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    count = token_counts.counter(token_counts.model_path())
    rng = random.Random(4)
    texts = ["".join(rng.choice(" ▁ab\n\tcﬁé  🙂<s>") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert count(texts) == [len(x) for x in model.encode(texts)]


def test_op5_finds_other_values(spark):
    item = "If Anna buys 3 apples for 4 euros, how many apples does Anna get for 20 euros at the same shop in Berlin today?"
    other = "Well then. If Boris buys 7 apples for 9 euros, how many apples does Boris get for 45 euros at the same shop in Paris today? The end."
    wrong = "Well then. If Boris buys 7 apples for 9 euros, how many apples does Carla get for 45 euros at the same shop in Paris today? The end."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one"), (5, "1 2 3 4 5 6 7")], "item_id long, text string")
    rows = [(1, f"Some words. {item} More words."), (2, other), (3, wrong), (4, "nothing here at all"), (5, None), (6, ""), (None, item), (7, "it is a short one indeed"), (8, "1 2 3 4 5 6 7"), (2, other)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, item long, hash string")
    got = {(r["doc_id"], r["item_id"]): r for r in templates.contaminated(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (None, 1), (7, 4)}
    assert got[2, 1]["changed"] > 0 and got[1, 1]["changed"] == 0 and got[1, 1]["coverage"] == 1
    assert sorted(str(r["doc_id"]) for r in templates.clean(df, bench).collect()) == ["3", "4", "5", "6", "8", "None"]
    assert templates.contaminated(df.limit(0), bench).count() == 0 and templates.contaminated(df, bench.limit(0)).count() == 0


def test_op5_one_slot_discounts_its_own_windows_only(spark):
    short = "If Anna buys 3 apples for 4 euros, how many apples does she get at the same shop in Berlin today?"
    rest = " ".join(f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    long = f"The train leaves with 12 wagons and {rest} so that all 12 wagons come back before the night is over"
    apart = "Of the 5 boxes we sold 5 boxes and then went home with the money to count it all again in peace"
    bench = spark.createDataFrame([(1, short), (2, long), (3, apart)], "item_id long, text string")
    one = short.replace("3 apples", "5 apples").replace("4 euros", "5 euros")
    docs = [(1, f"Well. {one} So."), (2, f"Well. {long.replace('all 12', 'all 13')} So."), (3, f"Well. {rest[:200]} So."), (4, f"Well. {apart.replace('5', '8')} So."), (5, f"Well. {apart.replace('sold 5', 'sold 6')} So.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in templates.contaminated(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 3)}
    assert got[1, 1]["coverage"] == 1 and 0.8 <= got[2, 2]["coverage"] < 1
    assert {r["doc_id"] for r in templates.clean(df, bench).collect()} == {3, 5}


def template_of(t):
    return " ".join(x[:2] if x.startswith("0") else x for x in t)


def item_matches(text_tokens, item_tokens):
    """(matched, m) of an item against a text, by the definition: windows, alignments, majorities of the slots."""
    k = min(5, len(item_tokens))
    places = range(min(1, len(item_tokens) - k), len(item_tokens) - k + 1)
    own = {w: item_tokens[w : w + k] for w in places if sum(not x.startswith("0") for x in item_tokens[w : w + k]) >= min(2, k)}
    m = len({template_of(v) for v in own.values()})
    shifts = defaultdict(list)
    for w, v in own.items():
        for i in range(len(text_tokens) - k + 1):
            if template_of(text_tokens[i : i + k]) == template_of(v):
                shifts[i - w].append((w, v, text_tokens[i : i + k]))
    found = set()
    for rows in shifts.values():
        votes = defaultdict(lambda: defaultdict(set))
        for w, v, x in rows:
            for d, (a, b) in enumerate(zip(v, x, strict=True)):
                if a.startswith("0"):
                    votes[a][b].add(w + d)
        means = {}
        for a, bs in votes.items():
            top = sorted((len(at) for at in bs.values()), reverse=True)
            means[a] = max(bs, key=lambda b: len(bs[b])) if len(top) == 1 or top[0] > top[1] else None
        found |= {template_of(v) for w, v, x in rows if all(means[a] == b for a, b in zip(v, x, strict=True) if a.startswith("0"))}
    return len(found), m


def test_op5_matches_brute_force(spark):
    rng = random.Random(9)
    hot = ["wonderful", "question"]  # the longest words stand in most items and texts, one after the other too
    word = lambda: rng.choice(hot) if rng.random() < 0.3 else rng.choice(WORDS[:60]).replace("w", "w" + rng.choice("abc"))
    item = lambda n: " ".join(str(rng.randint(1, 9)) if rng.random() < 0.2 else rng.choice(["Anna", "Boris", "Carla"]) if rng.random() < 0.1 else word() for _ in range(n))
    items = [(i, item(rng.choice([3, 8, 20, 40]))) for i in range(25)] + [(30, "wonderful"), (31, None), (32, "")]
    texts = []
    for i in range(60):
        body = rng.choice(items[:25])[1]
        if i % 3 == 0:
            body = re.sub(r"\d", lambda x: str(rng.randint(1, 9)), body)
        if i % 3 == 1:
            body = re.sub("Anna", "Dora", re.sub("[1-5]", "7", body))
        texts.append((i, f"{item(rng.randint(0, 30))} {body} {item(rng.randint(0, 30))}"))
    texts += [(60, None), (61, ""), (62, f"{item(9000)} {items[3][1]} {item(9000)}"), (63, "so wonderful"), (5, texts[5][1])]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    split = {r[0]: r[1] for r in bench.select("item_id", templates.tokens(F.col("text"))).collect()}
    want = {}
    for doc, t in {r[0]: r[1] for r in df.select("doc_id", templates.tokens(F.col("text"))).collect()}.items():
        for i, x in split.items():
            if x[0]:
                got, m = item_matches(t, x)
                if m and got >= 0.8 * m - 1e-9:
                    want[doc, i] = (got, m)
    assert {(r["doc_id"], r["item_id"]): (r["matched"], r["windows"]) for r in templates.contaminated(df, bench).collect()} == want and len(want) > 30
    assert templates.contaminated(df, bench).count() == len(want)


def test_what_is_weighed_is_broadcast_within_the_bound(spark):
    from tarn.llm.shared import weight, within_bytes

    df = spark.createDataFrame([(i, ["abc"] * 10, None) for i in range(1000)], "a long, b array<string>, c string")
    assert 150_000 < weight(df) < 400_000 and weight(df.limit(0)) == 0
    plan = lambda bound: spark.range(9).join(within_bytes(df, bound), F.col("id") == F.col("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(1 << 20) and "broadcast" not in plan(1 << 10)


def test_op6_an_id_with_two_sources_is_drawn_by_each(spark):
    rows = [(i % 50, "word " * (1 + i % 3), "a" if i < 50 else "b") for i in range(1050)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_rate", F.lit("x")).withColumn("_SOURCE", F.lit(1))
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    got = mixing.apply_mix(df)
    assert got.columns == df.columns
    assert Counter((r["doc_id"], r["source"]) for r in got.collect()) == +want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(doc_id" not in plan  # texts stay where they are


def test_op6_targets_and_copies(docs, spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0), ("d", 5)], "source string, source_size long")
    got = {r["source"]: r for r in mixing.targets(sizes).collect()}
    weight, cap = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {s: 3 * r["source_size"] for s, r in got.items()}
    open_, room, want = set(weight), 1515.0, {}
    while over := [s for s in open_ if room * weight[s] / sum(weight[x] for x in open_) > cap[s]]:
        for s in over:
            want[s] = cap[s]
            open_.remove(s)
        room = 1515.0 - sum(want.values())
        if not open_:
            break
    want |= {s: room * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert {s: pytest.approx(r["target"]) for s, r in got.items()} == want
    rows = collected(mixing.mix(docs))
    assert len(rows) == docs.count() and all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, collected(mixing.mix(docs.repartition(2)))))
    text = {r["doc_id"]: r["text"] for r in collected(docs)}
    assert all(r["size"] == len(cut(text[r["doc_id"]])) for r in rows)
    many = Counter(str(r["doc_id"]) for r in collected(mixing.apply_mix(docs)))
    want_n = Counter()
    for r in rows:
        want_n[str(r["doc_id"])] += r["copies"]
    assert many == +want_n
    assert mixing.mix(docs.limit(0)).count() == 0


def labelled(spark, toxic):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(500):
        bad = rng.random() < 0.3
        words = [rng.choice(WORDS) for _ in range(rng.randint(3, 60))]
        if bad and toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["Vile!", "rotten", "nasty,"]))
        if bad and not toxic:
            words = [f"{w}%%%" for w in words]
        rows.append((i, " ".join(words), None, None, None, 0, None, None))
        labels += [(i, int(not bad), int(bad))] if i % 5 else [(i, None, None)]
        labels += [(i, int(not bad), int(bad))] if i % 50 == 0 else []
    rows += [(900, None, *[None] * 6), (901, "", *[None] * 6), (None, "some words", *[None] * 6)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("toxic", [False, True])
def test_op7_op8_held_out(spark, toxic):
    df, labels = labelled(spark, toxic)
    score = classifiers.score_toxicity if toxic else classifiers.score_quality
    got = {r["doc_id"]: r for r in score(df, labels).collect()}
    assert len(got) == 503 and all(0 <= r["score"] <= 1 for r in got.values())
    truth = {r["doc_id"]: r["toxic" if toxic else "quality"] for r in labels.collect() if r["toxic"] is not None}
    held = [k for k in truth if got[k]["held_out"]]
    assert {k for k in got if k is not None and got[k]["held_out"]} == {k for k in got if k is not None and zlib.crc32(str(k).encode()) % 5 == 0}
    assert len(held) > 50 and sum(got[k]["predicted"] == truth[k] for k in held) / len(held) > 0.9
    assert score(df, labels.limit(0)).count() == 503 and score(df.limit(0), labels).count() == 0


def test_op9_base_and_likelihood(docs):
    rows = [r for r in collected(docs)]
    train = [r for r in rows if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 != 1]
    counts = Counter(t for r in train for t in [*cut(r["text"]), None])
    n, v = sum(counts.values()), len(counts)
    got = sorted(collected(hmm.score_texts(docs, head=150)), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    rows.sort(key=lambda r: (str(r["doc_id"]), len(cut(r["text"]))))
    for r, g in zip(rows, got, strict=True):
        tokens = [*cut(r["text"]), None]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert g["base_score"] == pytest.approx(base) and g["score"] < 0
    assert hmm.score_texts(docs.limit(0)).count() == 0


def test_op9_forward_is_exact():
    rng = np.random.default_rng(1)
    m = hmm.Hmm(rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 4, 2).T)
    seqs = [np.array(s) for s in ([0], [1, 2], [3, 3, 1, 0], [2])]
    for s, got in zip(seqs, m.log10(seqs), strict=True):
        total = 0.0
        for path in np.ndindex(*[2] * len(s)):
            p = m.first[path[0]] * m.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= m.step[a, b] * m.emit[x, b]
            total += p
        assert got == pytest.approx(math.log10(total))
    before = m.expected(seqs)
    assert before[2].sum() == pytest.approx(8) and before[0].sum() == pytest.approx(4) and before[1].sum() == pytest.approx(4)
    better = hmm.Hmm(before[0] / before[0].sum(), before[1] / before[1].sum(1, keepdims=True), before[2] / before[2].sum(0))
    assert better.expected(seqs)[3] >= before[3]


def test_op9_segments_go_on_where_the_text_has_come_to():
    rng = np.random.default_rng(3)
    m = hmm.Hmm(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 7, 8, 23, 12)]
    total, first, step, emit, left, before = 0.0, 0.0, 0.0, 0.0, list(seqs), None
    while left:
        f, s, e, t, after = m.expected([x[:4] for x in left], before)
        total, first, step, emit = total + t, first + f.sum(), step + s.sum(), emit + e.sum()
        on = [k for k, x in enumerate(left) if len(x) > 4]
        left, before = [left[k][4:] for k in on], after[on]
    assert total == pytest.approx(m.log10(seqs).sum())  # the likelihood of whole texts
    assert first == pytest.approx(len(seqs)) and emit == pytest.approx(sum(map(len, seqs))) and step == pytest.approx(sum(len(x) - 1 for x in seqs))


def test_op10_suffix_array():
    rng = random.Random(1)
    for _ in range(60):
        alphabet = rng.choice([b"ab", b"abc", b"a", bytes(range(256))])
        segments = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 9))]
        segments += [segments[0], segments[0][2:] + b"z"]
        text, _ = suffixes.joined(segments)
        sep = np.cumsum(text == 1)
        sep[sep == sep.max()] = 0
        key = [(0,) if x == 0 else (1, int(sep[i])) if x == 1 else (2, int(x)) for i, x in enumerate(text)]
        assert list(suffixes.suffix_array(text)) == sorted(range(len(text)), key=lambda i: key[i:])


@pytest.mark.parametrize(("length", "hot"), [(50, 20_000), (12, 20_000), (50, 1), (13, 1)])
def test_op10_matches_brute_force(docs, length, hot, monkeypatch):
    """With hot = 1 all anchors that texts share are dealt out by what stands beside them."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = collected(docs)
    place = lambda r: 1 << 62 if r["doc_id"] is None else r["doc_id"]
    first = {}
    for r in sorted(rows, key=place):
        b = (r["text"] or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], place(r))
    want = []
    for r in rows:
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < place(r):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((str(r["doc_id"]), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.strip_repeats(docs, length).collect())
    assert got == sorted(want) and sum(w[2] for w in want) > 1000


def test_op10_shards_grow_with_the_bytes(docs, monkeypatch):
    seen = []
    shared = repeats._shared
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1000)
    monkeypatch.setattr(repeats, "_shared", lambda d, shards, *a: seen.append(shards) or shared(d, shards, *a))
    repeats.strip_repeats(docs.limit(30)).count()
    different = {r["text"] or "" for r in docs.limit(30).collect()}
    assert seen[0] == max(8, -(-sum(len(x.encode()) for x in different) // 1000))


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    assert ngram_join.similar_sets(none).count() == 0 and hilbert.hilbert_shards(none).count() == 0
    assert repeats.strip_repeats(none).count() == 0 and token_counts.token_counts(none).count() == 0
    assert grid_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_words_and_windows():
    for text in [r[1] or "" for r in corpus()]:
        w = of_text([text])
        assert len(w.hashes) == len(cut(text)) and len(set(w.hashes.tolist())) == len(set(cut(text)))
        h, _ = distinct(*windows(w, 3))
        words = cut(text)
        assert len(h) == len({tuple(words[k : k + 3]) for k in range(len(words) - 2)} or ({tuple(words)} if words else set()))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    spark.createDataFrame([(*r[:5],) for r in corpus(n=30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    leak = corpus(n=30)[9][1].split(" ")[100:140]
    spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = spark.read.parquet(f"{d}/documents.parquet")
    names = got.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = got
        got = corpus_pipeline.written(stage(spark, got, d), name)
        assert got.columns == names
        if name == "near_duplicates":
            gone = {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in got.select("doc_id").collect()}
            want = {int(k) for k, _, c in classes(collected(before), 5, 80) if k != c and k != "None"}
            assert gone == want
        if name == "decontaminate":
            assert 27 not in {r["doc_id"] for r in got.collect()} and before.count() == got.count() + 1
    assert corpus_pipeline.STAGES[-1][1](spark, got, d).count() == got.count()
