"""SQL for a second engine, written independently of the DataFrame plans, over the same tables and column names."""

from __future__ import annotations

from tarn.functions.code import SIGNATURES

BITS = "b AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, CAST(floor(value * 100) AS BIGINT) % 2 AS bit FROM events), w AS (SELECT pos, bit, sum(2 * bit - 1) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS walk FROM b)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _classify() -> str:
    parts = []
    for i, (lang, _, strong, weak) in enumerate(SIGNATURES):
        score = " + ".join(f"CASE WHEN contains(t, {_q(w.lower())}) THEN {n} ELSE 0 END" for ws, n in ((strong, 3), (weak, 1)) for w in ws)
        parts.append(f"SELECT page_id, {_q(lang)} AS language, {i} AS ord, {score} AS score, html FROM p")
    return f"""
    WITH p AS (SELECT page_id, lower(html) AS t, html FROM pages), s AS ({" UNION ALL ".join(parts)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS k FROM s),
    c AS (SELECT *, list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '') AS lines FROM r WHERE k = 1),
    d AS (SELECT CASE WHEN score >= 3 THEN language WHEN len(lines) >= 2 AND 2 * len(list_filter(lines, lambda x: regexp_matches(trim(x), '[;{{}}:]$') OR (contains(x, '(') AND contains(x, ')')) OR contains(trim(x), ' = '))) >= len(lines) THEN 'other' END AS language, greatest(score, 3) AS score FROM c)
    SELECT language, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM d WHERE language IS NOT NULL GROUP BY language"""


def _planes(dims: int) -> list[list[int]]:
    """One plane a bit from the finishing steps of splitmix64, worked out apart from the library."""
    out = []
    for d in range(dims):
        z = (d + 2685821657736338717) % 2**64
        for shift, by in ((30, 13787848793156543929), (27, 10723151780598845931)):
            z = ((z ^ (z // 2**shift)) * by) % 2**64
        z ^= z // 2**31
        out.append([2 * int(x) - 1 for x in reversed(f"{z:064b}")])
    return out


def _sign_hash() -> str:
    rows = _planes(64)
    bits = " | ".join(f"(CASE WHEN list_dot_product(e, [{','.join(str(float(r[b])) for r in rows)}]::DOUBLE[]) > 0 THEN ({1 << b if b < 63 else "-9223372036854775807 - 1"})::BIGINT ELSE 0::BIGINT END)" for b in range(64))
    return f"h AS (SELECT vec_id, embedding, {bits} AS h FROM (SELECT vec_id, embedding, embedding::DOUBLE[] AS e FROM embeddings))"


HASHED = _sign_hash()
PAIRS = """x AS (SELECT vec_id, embedding, h, k, CASE WHEN k = 10 THEN (h >> 60) & 15 ELSE (h >> (6 * k)) & 63 END AS bits FROM h, (SELECT unnest(range(11))::INT AS k)),
p AS (SELECT DISTINCT l.vec_id AS a, r.vec_id AS b, bit_count(xor(l.h, r.h)) AS hamming FROM x l JOIN x r ON l.k = r.k AND l.bits = r.bits AND l.vec_id < r.vec_id WHERE bit_count(xor(l.h, r.h)) <= 20)"""
TURNS = "t AS (SELECT conv_id, turn, role, conv_id || ':' || turn AS node, conv_id || ':' || (turn + 1) AS nxt FROM conversations), e AS (SELECT t.node AS src, u.node AS dst FROM t JOIN t u ON u.node = t.nxt)"
LETTER = """CASE WHEN s = '' OR s LIKE '#%' THEN NULL WHEN s LIKE 'for %' THEN 'F' WHEN s LIKE 'while %' THEN 'W' WHEN s LIKE 'elif %' OR s LIKE 'else%' THEN 'E' WHEN s LIKE 'if %' THEN 'I' WHEN s LIKE 'case %' THEN 'C' WHEN s LIKE 'of %' THEN 'O'
        WHEN s LIKE 'try%' OR s LIKE 'except%' OR s LIKE 'finally%' THEN 'T' WHEN s LIKE 'raise %' OR s LIKE 'quit%' THEN 'X' WHEN s LIKE 'return%' OR s LIKE 'result%' THEN 'R' WHEN s LIKE 'var %' OR s LIKE 'let %' OR s LIKE 'const %' THEN 'V'
        WHEN contains(s, '=') AND NOT contains(s, '==') THEN 'A' WHEN contains(s, '(') THEN 'K' ELSE '.' END"""
NORM = r"md5(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')))"

ORACLE_SQL: dict[str, str] = {
    "size_bands": """SELECT doc_id, n_chars, rank, CASE WHEN rank < q THEN 'huge' WHEN rank < 2 * q THEN 'big' WHEN rank < 3 * q THEN 'mid' ELSE 'small' END AS band, round(n_chars / most, 6) AS share
        FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank, (count(*) OVER () + 3) // 4 AS q, max(n_chars) OVER () AS most FROM documents)""",
    "health_bands": """SELECT source, n, round(a, 6) AS average, CASE WHEN a <= 12 THEN 'ok' WHEN a <= 25 THEN 'alright' WHEN a <= 45 THEN 'poor' ELSE 'critical' END AS health,
        CAST(CASE WHEN floor(a) <= 2 THEN 0 WHEN floor(a) <= 5 THEN 1 WHEN floor(a) <= 10 THEN 2 WHEN floor(a) <= 20 THEN 3 WHEN floor(a) <= 40 THEN 4 ELSE 5 END AS BIGINT) AS bucket
        FROM (SELECT source, count(*) AS n, avg(len(string_split(text, chr(10)))) AS a FROM documents GROUP BY source)""",
    "role_tally": "SELECT coalesce(role, 'undeclared') AS role, count(*) AS n FROM conversations GROUP BY 1",
    "lang_stats": "SELECT CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS lang, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY 1",
    "scope_totals": "SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS scope, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS average FROM events GROUP BY GROUPING SETS ((event_type), ())",
    "coverage_buckets": "SELECT least(h, 5) AS hits, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS h FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) GROUP BY 1",
    "even_sample": "SELECT o_orderkey, o_totalprice, pos FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) WHERE n <= 48 OR pos = 0 OR pos = n - 1 OR pos * 48 // n <> (pos - 1) * 48 // n",
    "timeline": "SELECT month, n, total, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS so_far FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)",
    "resolve_best": """WITH l AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem), c AS (SELECT 'c' || o_custkey AS caller, c_nationkey AS m, l_partkey AS name, min(l_orderkey) AS ord FROM l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
        f AS (SELECT DISTINCT l_partkey AS name, l_suppkey AS s, s_nationkey AS m FROM l JOIN supplier ON s_suppkey = l_suppkey),
        r AS (SELECT caller, 's' || s AS callee, c.name, ord, row_number() OVER (PARTITION BY caller, c.name ORDER BY f.m <> c.m, s) AS k FROM c JOIN f ON f.name = c.name)
        SELECT caller, callee, arg_min(name, (ord, name)) AS name FROM r WHERE k = 1 GROUP BY caller, callee""",
    "unresolved": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "line_owner": "SELECT e.user_id, e.event_id, (SELECT max(s.event_id) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.event_id <= e.event_id) AS owner FROM events e WHERE event_type <> 'signup'",
    "touched_findings": "SELECT user_id AS path, event_id AS line, CASE WHEN EXISTS (SELECT 1 FROM events h WHERE h.event_type = 'purchase' AND h.user_id = e.user_id AND e.event_id BETWEEN h.event_id - 50 AND h.event_id + 50) THEN 'yours' ELSE 'nearby' END AS kind FROM events e WHERE event_type = 'error'",
    "blast_callers": """WITH RECURSIVE ps AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), e AS (SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS dst FROM ps) WHERE dst IS NOT NULL),
        r AS (SELECT s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey = 50 UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 2)
        SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node HAVING min(depth) > 0""",
    "reach": f"WITH RECURSIVE {TURNS}, r AS (SELECT node AS seed, node, 0 AS depth FROM t WHERE turn = 0 UNION SELECT seed, dst, depth + 1 FROM r JOIN e ON e.src = r.node) SELECT seed, count(*) AS reached, CAST(max(depth) AS BIGINT) AS farthest FROM r GROUP BY seed",
    "nearest_guard": f"""WITH RECURSIVE {TURNS}, g AS (SELECT node FROM t WHERE role IN ('system', 'assistant')),
        r AS (SELECT node AS door, node, '' AS route, 0 AS hops, false AS hit FROM t WHERE role = 'user' UNION ALL SELECT door, dst, CASE WHEN route = '' THEN dst ELSE route || '>' || dst END, hops + 1, dst IN (SELECT node FROM g) FROM r JOIN e ON e.src = r.node WHERE hops < 3 AND NOT hit)
        SELECT d.node AS door, f.node AS guard, CAST(f.hops AS BIGINT) AS hops, f.route FROM (SELECT DISTINCT node FROM t WHERE role = 'user') d LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY door ORDER BY hops, node, route) AS k FROM r WHERE hit) WHERE k = 1) f ON f.door = d.node""",
    "depth_hist": f"WITH RECURSIVE {TURNS}, r AS (SELECT node AS top, node, 1 AS depth FROM t UNION ALL SELECT top, dst, depth + 1 FROM r JOIN e ON e.src = r.node) SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM (SELECT top, max(depth) AS depth FROM r GROUP BY top) GROUP BY 1",
    "idf_weights": "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM w) SELECT term, count(*) AS df, round(ln((any_value(n) + 1) / (count(*) + 1)) + 1, 6) AS weight FROM w, n GROUP BY term",
    "word_jaccard": """WITH p AS (SELECT p_partkey, p_brand, p_size, list_filter(string_split_regex(lower(regexp_replace(replace(p_name || ' ' || p_type, ' ', '_'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_$-]'), lambda x: length(x) >= 3 AND x NOT IN ('self', 'this', 'true', 'false', 'null', 'none', 'undefined', 'const', 'string', 'number', 'int', 'bool', 'void', 'return', 'new', 'var', 'let', 'len', 'for', 'the', 'and', 'not', 'str', 'usize')) AS w FROM part)
        SELECT * FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(list_distinct(a.w), b.w)) / len(list_distinct(a.w || b.w)), 6) AS score FROM p a JOIN p b ON a.p_partkey < b.p_partkey) WHERE score >= 0.5""",
    "twins": f"SELECT {NORM} AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "contested": "WITH w AS (SELECT DISTINCT l_suppkey AS thing, l_partkey AS writer FROM lineitem) SELECT a.thing AS a, b.thing AS b, count(*) AS shared FROM w a JOIN w b ON a.writer = b.writer AND a.thing < b.thing GROUP BY ALL HAVING count(*) >= 2",
    "neighbours": "SELECT kind, next_kind, count(*) AS n FROM (SELECT event_type AS kind, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next_kind FROM events) WHERE next_kind <> kind GROUP BY ALL",
    "first_n": "SELECT user_id, event_id, CAST(nth AS INT) AS nth, total FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE nth <= 8",
    "session_lease": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events), n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 86400000000 THEN 0 ELSE 1 END AS new FROM e),
        s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lease FROM n) SELECT user_id, lease, count(*) AS beats, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY ALL""",
    "welch_t": """WITH x AS (SELECT event_type AS k, value AS x, avg(value) OVER (PARTITION BY event_type) AS mu FROM events WHERE event_type IN ('click', 'view')), s AS (SELECT k, count(*) AS n, avg(x) AS m, var_samp(x) AS v, avg((x - mu) ** 2) AS m2, var_samp((x - mu) ** 2) AS v2 FROM x GROUP BY k)
        SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t1, round((a.m2 - b.m2) / sqrt(a.v2 / a.n + b.v2 / b.n), 6) AS t2 FROM s a, s b WHERE a.k = 'click' AND b.k = 'view'""",
    "failure_bound": """SELECT day, total, failures, round(failures / total, 6) AS share, round(greatest(0.0, 0.1 - h), 6) AS low, round(least(1.0, 0.1 + h), 6) AS high, failures / total BETWEEN greatest(0.0, 0.1 - h) AND least(1.0, 0.1 + h) AS passed
        FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS failures, 3.0::DOUBLE * sqrt(0.09::DOUBLE / count(*)) AS h FROM events GROUP BY 1)""",
    "stable_bench": "SELECT event_type, len(l) AS n, l[1] AS least, l[len(l) // 2 + 1] AS median, round(list_avg(l), 6) AS mean, l[len(l)] AS most FROM (SELECT event_type, list(value ORDER BY value) AS l FROM events WHERE value IS NOT NULL GROUP BY 1)",
    "page_tags": "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT page_id, count(*) FILTER (tag = 'a') AS anchors, count(*) FILTER (tag = 'p') AS paragraphs, count(*) AS tags FROM t GROUP BY 1",
    "embedded_lang": _classify(),
    "line_letters": f"""WITH l AS (SELECT trim(unnest(string_split(html, chr(10)))) AS s FROM pages)
        SELECT {LETTER} AS letter, count(*) AS n FROM l GROUP BY 1""",
    "path_facts": r"""WITH p AS (SELECT page_id, ['src/a/', 'tests/', 'lib/node_modules/x/', ''][page_id % 4 + 1] || 'test_' || page_id || ['.nim', '.JS', '.md'][page_id % 3 + 1] AS path FROM pages),
        q AS (SELECT *, regexp_matches(path, '(^|/)tests?/') OR (NOT regexp_matches(path, '(^|/)src/') AND regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test\.nim)$')) AS is_test FROM p)
        SELECT page_id, lower(split_part(path, '.', -1)) AS ext, contains('/' || lower(path) || '/', '/node_modules/') AS ignored, is_test, regexp_matches(path, '(^|/)src/') AND NOT is_test AS is_src, regexp_replace(path, '\.nim$', '') AS module FROM q""",
    "scatter": """WITH o AS (SELECT o_orderstatus AS path, o_custkey AS grp, o_orderkey AS line, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS pos FROM orders)
        SELECT path, grp, min(line) AS first, max(line) AS last, count(*) AS own, max(pos) - min(pos) + 1 - count(*) AS strangers FROM o GROUP BY path, grp HAVING max(pos) - min(pos) + 1 - count(*) >= 4""",
    "press_score": """SELECT event_id, round(CASE WHEN s < 0.04 THEN s / 0.04::DOUBLE WHEN s <= 0.3 THEN 1.0 WHEN s <= 0.6 THEN 1 - (s - 0.3::DOUBLE) / 0.3::DOUBLE * 0.7::DOUBLE ELSE 0.1 END, 6) AS move, round(greatest(0.0, least(1.0, 1 - (event_id % 14 - 2) / 8)), 6) AS near FROM (SELECT event_id, value / 100 AS s FROM events)""",
    "monobit": f"WITH {BITS} SELECT count(*) AS n, round(abs(sum(2 * bit - 1)) / sqrt(count(*)), 6) AS statistic FROM b",
    "block_freq": f"WITH {BITS}, s AS (SELECT avg(bit) AS pi FROM b GROUP BY pos // 128 HAVING count(*) = 128) SELECT count(*) AS blocks, round(512 * sum((pi - 0.5) ** 2), 6) AS statistic FROM s",
    "runs": f"WITH {BITS}, r AS (SELECT bit, lag(bit) OVER (ORDER BY pos) AS p FROM b), s AS (SELECT count(*) AS n, CAST(sum(bit) AS BIGINT) AS ones, CAST(sum(CASE WHEN p IS NULL OR p <> bit THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM r) SELECT *, abs(ones / n - 0.5) < 2 / sqrt(n) AS applies FROM s",
    "longest_run": f"""WITH {BITS}, i AS (SELECT pos // 128 AS block, bit, sum(1 - bit) OVER (PARTITION BY pos // 128 ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isle FROM b), r AS (SELECT block, sum(bit) AS run, count(*) AS k FROM i GROUP BY block, isle),
        m AS (SELECT max(run) AS run FROM r GROUP BY block HAVING sum(k) = 128) SELECT CAST(greatest(4, least(9, run)) AS BIGINT) AS class, count(*) AS blocks FROM m GROUP BY 1""",
    "cusum_z": f"WITH {BITS} SELECT CAST(max(abs(walk)) AS BIGINT) AS z, 'forward' AS mode FROM w UNION ALL SELECT CAST(max(abs(s)) AS BIGINT), 'backward' FROM (SELECT sum(2 * bit - 1) OVER (ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS s FROM b)",
    "excursion_visits": f"WITH {BITS}, c AS (SELECT count(*) FILTER (walk = 0) + (arg_max(walk, pos) <> 0)::INT AS cycles FROM w) SELECT CAST(walk AS BIGINT) AS state, count(*) AS visits, any_value(cycles) AS cycles FROM w, c WHERE walk <> 0 AND abs(walk) <= 9 GROUP BY walk",
    "excursion_bins": f"""WITH {BITS}, c AS (SELECT walk, coalesce(sum((walk = 0)::INT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cycle FROM w), j AS (SELECT DISTINCT cycle FROM c), s AS (SELECT unnest([-4, -3, -2, -1, 1, 2, 3, 4]) AS state),
        v AS (SELECT s.state, j.cycle, count(c.walk) AS k FROM s CROSS JOIN j LEFT JOIN c ON c.cycle = j.cycle AND c.walk = s.state GROUP BY ALL) SELECT CAST(state AS BIGINT) AS state, least(k, 5) AS bin, count(*) AS cycles FROM v GROUP BY ALL""",
    "pattern_counts": f"WITH {BITS}, n AS (SELECT count(*) AS n FROM b) SELECT CAST(8 * b.bit + 4 * b1.bit + 2 * b2.bit + b3.bit AS BIGINT) AS pattern, count(*) AS n FROM b, n, b b1, b b2, b b3 WHERE b1.pos = (b.pos + 1) % n.n AND b2.pos = (b.pos + 2) % n.n AND b3.pos = (b.pos + 3) % n.n GROUP BY 1",
    "psi2": f"""WITH {BITS}, n AS (SELECT count(*) AS n FROM b), c3 AS (SELECT count(*) AS c FROM b, n, b b1, b b2 WHERE b1.pos = (b.pos + 1) % n.n AND b2.pos = (b.pos + 2) % n.n GROUP BY b.bit, b1.bit, b2.bit), c2 AS (SELECT count(*) AS c FROM b, n, b b1 WHERE b1.pos = (b.pos + 1) % n.n GROUP BY b.bit, b1.bit)
        SELECT round(8.0 / sum(c) * sum(c * c) - sum(c), 6)::DOUBLE AS psi2, 3 AS m FROM c3 UNION ALL SELECT round(4.0 / sum(c) * sum(c * c) - sum(c), 6)::DOUBLE, 2 FROM c2""",
    "phi": f"WITH {BITS}, n AS (SELECT count(*) AS n FROM b), c AS (SELECT count(*) AS c FROM b, n, b b1, b b2 WHERE b1.pos = (b.pos + 1) % n.n AND b2.pos = (b.pos + 2) % n.n GROUP BY b.bit, b1.bit, b2.bit) SELECT round(sum(c / n * ln(c / n)), 6) AS phi FROM c, n",
    "universal_fn": f"""WITH {BITS}, p AS (SELECT pos // 6 AS i, sum(bit * (1 << (5 - pos % 6)::INT)) AS pattern FROM b GROUP BY 1 HAVING count(*) = 6), g AS (SELECT i, i + 1 - coalesce(lag(i + 1) OVER (PARTITION BY pattern ORDER BY i), 0) AS gap FROM p) SELECT count(*) AS blocks, round(avg(log2(gap)), 6) AS fn FROM g WHERE i >= 640""",
    "overlapping_templates": f"""WITH {BITS}, h AS (SELECT pos // 128 AS block, (sum(bit) OVER (PARTITION BY pos // 128 ORDER BY pos ROWS 4 PRECEDING) = 5)::INT AS hit FROM b), k AS (SELECT sum(hit) AS hits FROM h GROUP BY block HAVING count(*) = 128) SELECT CAST(least(hits, 5) AS BIGINT) AS bin, count(*) AS blocks FROM k GROUP BY 1""",
    "non_overlapping_templates": f"""WITH {BITS}, k AS (SELECT string_agg(bit, '' ORDER BY pos) AS s FROM b GROUP BY pos // 128 HAVING count(*) = 128), t AS (SELECT unnest(range(1, 9)) AS template), h AS (SELECT template, (length(s) - length(replace(s, lpad(bin(template), 5, '0'), ''))) // 5 AS hits FROM k, t)
        SELECT template, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(hits * hits) AS BIGINT) AS squares FROM h GROUP BY template""",
    "byte_bits": "WITH p AS (SELECT p_brand, unnest(range(8 * strlen(p_brand))) AS pos FROM part) SELECT pos, count(*) AS n, CAST(sum((ascii(p_brand[(pos // 8 + 1)::INT]) >> (7 - pos % 8)::INT) & 1) AS BIGINT) AS ones FROM p GROUP BY pos",
    "sign_hashes": f"WITH {HASHED} SELECT vec_id, CAST(bit_count(h) AS INT) AS ones, h & 65535 AS low FROM h",
    "band_pairs": f"WITH {HASHED}, {PAIRS} SELECT a, b, CAST(hamming AS INT) AS hamming FROM p",
    "alike_pairs": f"WITH {HASHED}, {PAIRS} SELECT * FROM (SELECT a, b, round(greatest(0.0, 1 - list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[])), 6) AS distance FROM p JOIN embeddings l ON l.vec_id = a JOIN embeddings r ON r.vec_id = b) WHERE distance <= 0.8",
    "trace_top": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 25",
    "setting_verdicts": "SELECT l_suppkey, reads, writes, has_default, CASE WHEN reads = 0 AND writes = 0 THEN 'untouched' WHEN reads = 0 THEN 'does nothing' WHEN writes = 0 AND NOT has_default THEN 'never set' WHEN writes >= 3 THEN 'contested' ELSE 'fine' END AS verdict FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS reads, count(*) FILTER (l_discount > 0.09::DOUBLE AND l_quantity > 40) AS writes, min(l_linenumber) = 1 AS has_default FROM lineitem GROUP BY 1)",
    "skeletons": f"WITH l AS (SELECT page_id, unnest(range(len(a))) AS n, trim(unnest(a)) AS s FROM (SELECT page_id, string_split(html, chr(10)) AS a FROM pages)), x AS (SELECT page_id, n, {LETTER} AS letter FROM l) SELECT page_id, substr(string_agg(letter, '' ORDER BY n), 1, 160) AS skeleton FROM x WHERE letter IS NOT NULL GROUP BY 1",
    "screen_share": "SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - n_chars / nullif(max(CASE WHEN n_chars > 50 THEN n_chars END) OVER (PARTITION BY source), 0))), 6) AS kept FROM documents",
    "tag_rows": "SELECT conv_id, array_to_string(list_sort(list_distinct(list(lower(role)))), ',') AS tags FROM conversations GROUP BY 1",
}
