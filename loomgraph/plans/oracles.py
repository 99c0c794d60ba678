"""DuckDB SQL of the registered queries."""

from __future__ import annotations

WS = r"[ \t\n\r]"
RELATIVE = "'../../x/./' || lang || '/../' || id || '.js'"
PUNCT = r"[!-/:-@\[-^`{-~]"


def _estimate(x: str) -> str:
    ws, runs, punct = (f"len(regexp_extract_all({x}, '{p}'))" for p in (WS, WS + "+", PUNCT))
    return f"CAST(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE greatest(1, ceil((length({x}) - {ws} - {punct}) / 3.6::DOUBLE + {punct} + {runs} * 0.4::DOUBLE)) END AS BIGINT)"


def _lines(x: str) -> str:
    return f"CAST(CASE WHEN coalesce(length({x}), 0) = 0 THEN 0 ELSE length({x}) - length(replace({x}, chr(10), '')) + 1 END AS BIGINT)"


def _skip(x: str) -> str:
    return f"CASE WHEN regexp_matches(substr({x}, 1, 2000), '(?i)(@generated|code generated by|do not edit|auto-generated by)') THEN 'generated' WHEN length({x})::DOUBLE / (length({x}) - length(replace({x}, chr(10), '')) + 1) > 500 THEN 'minified' END"


FILES = f"""files AS (SELECT doc_id AS id, source || '/' || lang || '/' || doc_id || '.txt' AS path, lang, source, CAST(n_chars AS BIGINT) AS size,
  {_estimate("text")} AS tok, {_lines("text")} AS loc, substr(sha256(text), 1, 32) AS hash, {_skip("text")} AS skip_reason FROM documents)"""
FILE_ID = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) * 1000 + p_size"
PART_FILES = f"""pfiles AS (SELECT DISTINCT {FILE_ID} AS id, 'src/' || lower(replace(p_brand, '#', '')) || '/m' || p_size || '.py' AS path, p_size % 10 <> 0 AS parsed,
  CASE WHEN p_size % 10 = 0 THEN 'generated' END AS skip_reason FROM part)"""
NODES = f"""nodes AS (SELECT p_partkey AS id, {FILE_ID} AS file_id, CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'STANDARD' THEN 'class' WHEN 'PROMO' THEN 'method' WHEN 'LARGE' THEN 'field'
  WHEN 'SMALL' THEN 'const' WHEN 'MEDIUM' THEN 'type' ELSE 'var' END AS kind, p_name AS name, p_brand || '::' || p_name AS qname, p_type || ' ' || p_name AS signature, p_size AS tok,
  (p_partkey % 100) / 100.0::DOUBLE AS rank, p_size % 2 = 0 AS is_exported, p_partkey AS ordinal, p_size AS start_line, p_size + p_partkey % 7 AS end_line, CASE WHEN p_partkey % 5 = 0 THEN 'private' END AS visibility FROM part)"""
EDGES = """edges AS (SELECT l_partkey AS src_id, n AS dst_id, CASE WHEN n IS NULL THEN l_suppkey END AS ext_id, CASE WHEN l_linestatus = 'F' THEN 'call' ELSE 'type' END AS kind,
  CASE WHEN l_returnflag = 'R' THEN 'INFERRED' ELSE 'EXACT' END AS confidence, CAST(l_linenumber AS BIGINT) AS line
  FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem))"""
PLACES = """places AS (SELECT o_orderkey * 10 + 1 AS src_id, o_custkey * 10 + 2 AS dst_id, CASE WHEN o_orderstatus = 'F' THEN 'INFERRED' ELSE 'EXACT' END AS confidence FROM orders
  UNION ALL SELECT c_custkey * 10 + 2, CAST(c_nationkey AS BIGINT) * 10 + 3, 'EXACT' FROM customer UNION ALL SELECT s_suppkey * 10 + 5, CAST(s_nationkey AS BIGINT) * 10 + 3, 'EXACT' FROM supplier
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 10 + 3, CAST(n_regionkey AS BIGINT) * 10 + 4, 'EXACT' FROM nation)"""
TRIGRAMS = "grams AS (SELECT DISTINCT substr(lower(name), CAST(i AS BIGINT), 3) AS tri, id AS node_id FROM nodes, LATERAL (SELECT unnest(range(1, greatest(length(name) - 2, 1) + 1)) AS i) WHERE length(name) > 0)"
WITH_FILES = "n AS (SELECT nodes.*, path FROM nodes JOIN pfiles ON pfiles.id = file_id)"
SYMBOL_SEARCH = f"WITH {PART_FILES}, {NODES}, {WITH_FILES}"
EXACT, PREFIX = "name = 'red widget'", "lower(name) LIKE 'red%' AND name <> 'RED'"


def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{t}')" for t in terms for c in ("name", "qname", "signature")) + ")"


def _fuzzy(q: str) -> str:
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    need = -(-7 * len(grams) // 10)
    return f"SELECT node_id AS id, count(DISTINCT tri) AS hits FROM grams WHERE tri IN ({', '.join(repr(g) for g in grams)}) GROUP BY node_id HAVING count(DISTINCT tri) >= {need}"


def _split(x: str) -> str:
    """Identifier words without look-around: marks at every edge, twice where edges overlap."""
    for rx in (r"([a-z])([A-Z])", r"([A-Z])([A-Z][a-z])", r"([0-9])([A-Za-z])", r"([A-Za-z])([0-9])"):
        x = f"regexp_replace({x}, '{rx}', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _fold(path: str, spec: str) -> str:
    """Relative specifier folded onto a path's directory."""
    dirs = f"list_slice(string_split({path}, '/'), 1, len(string_split({path}, '/')) - 1)"
    step = "CASE WHEN s[1] IN ('', '.') THEN acc WHEN s[1] = '..' THEN list_slice(acc, 1, len(acc) - 1) ELSE list_concat(acc, s) END"
    return f"array_to_string(list_reduce(list_concat([{dirs}], list_transform(string_split({spec}, '/'), lambda x: [x])), lambda acc, s: {step}), '/')"


def _pagerank(n_iter: int = 20, damping: float = 0.85) -> str:
    head = f"""WITH {NODES}, {EDGES}, l AS MATERIALIZED (SELECT src_id, dst_id, count(*) AS m FROM edges WHERE dst_id IS NOT NULL AND dst_id IN (SELECT id FROM nodes) GROUP BY ALL),
o AS MATERIALIZED (SELECT src_id, sum(m)::DOUBLE AS out FROM l GROUP BY 1), k AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes),
r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS r FROM nodes, k)"""
    for i in range(1, n_iter + 1):
        head += f""",
r{i} AS MATERIALIZED (SELECT nodes.id, {1 - damping}::DOUBLE / n + {damping}::DOUBLE * (coalesce(g.s, 0) + d.lost / n) AS r FROM nodes CROSS JOIN k
  CROSS JOIN (SELECT coalesce(sum(r), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src_id FROM o)) d
  LEFT JOIN (SELECT dst_id, sum(r * m / out) AS s FROM l JOIN o USING (src_id) JOIN r{i - 1} ON id = src_id GROUP BY 1) g ON g.dst_id = nodes.id)"""
    return head + f" SELECT id, round(r / (SELECT max(r) FROM r{n_iter}), 8) AS rank FROM r{n_iter}"


def _reach(start: str, depth: int, edges: str = "places") -> str:
    """Levels of reverse reachability: the smallest distance of every (start, node)."""
    parts = f"q0 AS MATERIALIZED ({start})"
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT start_id, id FROM q{j}" for j in range(i))
        parts += f", q{i} AS MATERIALIZED (SELECT start_id, src_id AS id, {i} AS distance, min(e.confidence) AS edge_confidence FROM q{i - 1} q JOIN {edges} e ON e.dst_id = q.id WHERE (start_id, src_id) NOT IN (SELECT (start_id, id) FROM ({seen})) GROUP BY 1, 2)"
    return parts


def _hits(where: str, limit: int) -> str:
    return f"SELECT id, qname, path FROM n WHERE {where} ORDER BY rank DESC, id LIMIT {limit}"


MERGED_TERMS = ["red", "widget"]
MERGED = f"""WITH {PART_FILES}, {NODES}, {WITH_FILES}, {TRIGRAMS},
h AS (
  (SELECT id, 100 AS score, 'exact' AS why FROM n WHERE {EXACT} ORDER BY rank DESC, id LIMIT 50)
  UNION ALL (SELECT id, 40, 'prefix' FROM n WHERE starts_with(lower(name), 'red widget') AND name <> 'red widget' ORDER BY rank DESC, id LIMIT 50)
  UNION ALL (SELECT id, 25, 'text' FROM n WHERE {_any(MERGED_TERMS)} ORDER BY rank DESC, id LIMIT 60)
  UNION ALL (SELECT n.id, 10, 'fuzzy' FROM n JOIN ({_fuzzy("red widget")}) f ON f.id = n.id ORDER BY hits DESC, rank DESC, n.id LIMIT 40)
  UNION ALL (SELECT -id - 1, 8, 'file' FROM pfiles WHERE NOT parsed AND contains(lower(path), 'red widget') LIMIT 30))
SELECT h.id, CAST(sum(score) AS BIGINT) AS score, string_agg(why, '+' ORDER BY why) AS why, round(sum(score) * (1 + 2 * any_value(n.rank)), 6) AS final
FROM h JOIN n ON n.id = h.id GROUP BY h.id ORDER BY sum(score) * (1 + 2 * any_value(n.rank)) DESC, any_value(qname), h.id LIMIT 20"""

BM25 = f"""WITH {PART_FILES}, {NODES}, f AS (
  SELECT id AS node_id, 'name' AS field, name AS body FROM nodes UNION ALL SELECT id, 'parts', CASE WHEN contains({_split("name")}, ' ') THEN {_split("name")} ELSE '' END FROM nodes
  UNION ALL SELECT id, 'qname', qname FROM nodes UNION ALL SELECT id, 'signature', signature FROM nodes),
t AS (SELECT term, node_id, field, count(*) AS tf FROM (SELECT node_id, field, unnest(regexp_split_to_array(lower(body), '[^a-z0-9_]+')) AS term FROM f) WHERE term <> '' GROUP BY ALL),
len AS (SELECT node_id, sum(tf)::DOUBLE AS len FROM t GROUP BY 1), tot AS (SELECT count(*)::DOUBLE AS docs, avg(len) AS avg FROM len),
hit AS (SELECT word, node_id, sum(tf)::DOUBLE AS tf FROM t JOIN (VALUES ('re'), ('red'), ('widget')) AS w(word) ON starts_with(term, word) GROUP BY ALL),
df AS (SELECT word, count(*)::DOUBLE AS df FROM hit GROUP BY 1)
SELECT node_id AS id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))), 6) AS bm25
FROM hit JOIN df USING (word) JOIN len USING (node_id), tot GROUP BY 1 ORDER BY sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))) DESC, 1 LIMIT 60"""

BEST = f"""best AS (SELECT name, arg_min(nodes.id, row(NOT is_exported, -rank, lpath, ordinal)) AS any_id, arg_min(nodes.id, row(NOT is_exported, kind NOT IN ('function', 'method'), -rank, lpath, ordinal)) AS call_id
  FROM nodes JOIN (SELECT id AS fid, path AS lpath FROM pfiles) ON fid = file_id GROUP BY name)"""
FIRST = "firsts AS (SELECT file_id, name, arg_min(id, ordinal) AS node_id FROM nodes GROUP BY ALL)"


def _rollup(depth: int) -> str:
    dirs = " || '/' || ".join(["source", "lang"][:depth])
    return f"WITH {FILES} SELECT {dirs} AS dir, count(*) AS files, CAST(sum(tok) AS BIGINT) AS tok, CAST(sum(loc) AS BIGINT) AS loc, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM files GROUP BY 1"


LANG = "CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'tsx' WHEN 3 THEN 'c' WHEN 5 THEN 'yaml' END"
MARK = "CASE kind WHEN 'function' THEN 'f' WHEN 'class' THEN 'C' WHEN 'method' THEN 'm' END"
HTML = {t: f"len(regexp_extract_all(html, '<{t}[ >]'))" for t in ("article", "body", "footer", "form", "head", "header", "html", "main", "nav", "section", "script", "style")}


def sql() -> dict[str, str]:
    files = f"WITH {FILES} "
    return {
        "token_estimate": f"SELECT doc_id, {_estimate('text')} AS tok FROM documents",
        "content_hash": "SELECT doc_id, substr(sha256(text), 1, 32) AS hash FROM documents",
        "skip_reason": f"SELECT doc_id, {_skip('text')} AS skip_reason FROM documents",
        "line_count": f"SELECT doc_id, {_lines('text')} AS loc FROM documents",
        "binary_sniff": "SELECT page_id, page_id % 3 = 0 AND octet_length(encode(html)) < 8000 AS tail_binary, page_id % 3 = 0 AS head_binary FROM pages",
        "stub_reason": "SELECT doc_id, r AS reason, CASE WHEN r = 'too-large' THEN 'size:' || s || ':' || doc_id WHEN r IS NOT NULL THEN 'stat:' || s || ':' || doc_id END AS hash FROM (SELECT doc_id, n_chars * 300 AS s, CASE WHEN n_chars * 300 > 1048576 THEN 'too-large' WHEN doc_id % 4 = 0 THEN 'image' END AS r FROM documents)",
        "language_detect": f"SELECT doc_id, {LANG} AS language FROM documents",
        "identifier_split": f"""SELECT c_custkey, {_split("c_name || 'HTTPServerV2' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '_x'")} AS words FROM customer""",
        "path_functions": files + "SELECT id, id || '.txt' AS base, source || '/' || lang AS dir, '.txt' AS ext, source AS top, path AS norm FROM files",
        "normalize_relative": files + f"SELECT id, {_fold('path', RELATIVE)} AS target FROM files",
        "symbol_text": f"WITH {NODES} SELECT id, substr(kind || ' — ' || qname || ' — ' || signature, 1, 1000) AS body FROM nodes",
        "trigram_index": f"WITH {NODES}, {TRIGRAMS} SELECT tri, node_id FROM grams",
        "dir_rollup": _rollup(1),
        "dir_rollup_deep": _rollup(2),
        "outline_budget": f"SELECT conv_id, ord, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY ord ROWS UNBOUNDED PRECEDING) <= 400 AS kept FROM (SELECT conv_id, turn AS ord, {_estimate('line')} + 1 AS cost FROM (SELECT *, role || ': ' || text AS line FROM conversations))",
        "file_outline": f"WITH {NODES} SELECT file_id, ordinal AS ord, lpad(CAST(start_line AS VARCHAR), 4, ' ') || ' ' || {MARK} || ' ' || CASE WHEN visibility = 'private' THEN '-' ELSE '' END || signature AS line FROM nodes WHERE kind IN ('function', 'class', 'method')",
        "search_exact": SYMBOL_SEARCH + _hits(EXACT, 50),
        "search_prefix": SYMBOL_SEARCH + _hits(PREFIX, 50),
        "search_text": SYMBOL_SEARCH + _hits(_any(["widget", "brand#2", "brand"]), 60),
        "search_fuzzy": f"WITH {PART_FILES}, {NODES}, {WITH_FILES}, {TRIGRAMS} SELECT n.id, qname, path FROM n JOIN ({_fuzzy('red widgte')}) f ON f.id = n.id ORDER BY hits DESC, rank DESC, n.id LIMIT 40",
        "search_file": f"WITH {PART_FILES} SELECT id, regexp_extract(path, '[^/]*$') AS name, path, skip_reason AS signature FROM pfiles WHERE NOT parsed AND contains(path, 'm10') ORDER BY path LIMIT 30",
        "search_merged": MERGED,
        "find_symbol": f"WITH {NODES}, t AS (SELECT *, CASE WHEN qname = 'widget' THEN 1 WHEN name = 'widget' THEN 2 WHEN contains(lower(qname), 'widget') THEN 3 END AS tier FROM nodes) SELECT id, qname, CAST(tier AS BIGINT) AS tier FROM t WHERE tier = (SELECT min(tier) FROM t) ORDER BY rank DESC, tok DESC, id LIMIT 10",
        "full_text_search": BM25,
        "first_definitions": f"WITH {NODES}, {FIRST} SELECT file_id, name, node_id FROM firsts",
        "best_definitions": f"WITH {PART_FILES}, {NODES}, {BEST} SELECT name, any_id, call_id FROM best",
        "namespace_longest_prefix": "WITH d AS (SELECT DISTINCT replace(p_brand, '#', '') || '.' || split_part(p_name, ' ', 1) AS ns FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT replace(p_brand, '#', '') FROM part) SELECT p_partkey, arg_max(ns, length(ns)) AS ns FROM part JOIN d ON starts_with(replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '.') || '.', ns || '.') GROUP BY 1",
        "html_links": f"""WITH l AS (SELECT DISTINCT page_id, 'pages/' || page_id || '.html' AS path, unnest(regexp_extract_all(html, '<(?:a|link|script|img|iframe)(?: [^>]*)? (?:href|src)="([^"]+)"', 1)) AS spec FROM pages)
SELECT path, {_fold("path", "spec")} AS target, count(*) AS links FROM l GROUP BY ALL""",
        "degree": f"WITH {NODES}, {EDGES}, p AS (SELECT DISTINCT src_id, dst_id FROM edges WHERE dst_id IS NOT NULL) SELECT id, coalesce(a.n, 0) AS callers, coalesce(b.n, 0) AS callees FROM nodes LEFT JOIN (SELECT dst_id, count(*) AS n FROM p GROUP BY 1) a ON a.dst_id = id LEFT JOIN (SELECT src_id, count(*) AS n FROM p GROUP BY 1) b ON b.src_id = id",
        "callers_weakest_link": f"WITH {EDGES} SELECT dst_id, src_id, min(line) AS line, count(*) AS sites, max(confidence) AS confidence, min(kind) AS kind FROM edges WHERE dst_id IS NOT NULL GROUP BY 1, 2",
        "callers_exact": f"WITH {EDGES} SELECT dst_id, src_id, min(line) AS line, count(*) AS sites, max(confidence) AS confidence, min(kind) AS kind FROM edges WHERE dst_id IS NOT NULL AND confidence = 'EXACT' GROUP BY 1, 2",
        "callers_of_node": f"WITH {PART_FILES}, {NODES}, {WITH_FILES}, {EDGES} SELECT n.id, qname, path, min(e.line) AS line, count(*) AS sites, max(confidence) AS confidence, min(e.kind) AS kind FROM edges e JOIN n ON n.id = e.src_id WHERE e.dst_id = 42 GROUP BY n.id, qname, path, n.rank ORDER BY n.rank DESC, path, n.id LIMIT 50",
        "callees_of_node": f"WITH {PART_FILES}, {NODES}, {WITH_FILES}, {EDGES} (SELECT DISTINCT false AS is_external, n.id, qname AS name, path AS \"where\", e.line, confidence, e.kind FROM edges e JOIN n ON n.id = e.dst_id WHERE e.src_id = 42 ORDER BY e.line, n.id, e.kind LIMIT 50) UNION ALL (SELECT DISTINCT true, s_suppkey, s_name, 'suppliers', line, confidence, kind FROM edges JOIN supplier ON s_suppkey = ext_id WHERE src_id = 42 ORDER BY line, s_suppkey, kind LIMIT 50)",
        "pagerank": _pagerank(),
        "impact_bfs": f"WITH {PLACES}, {_reach('SELECT 4::BIGINT AS start_id, 4::BIGINT AS id, 0 AS distance', 3)} SELECT id, CAST(distance AS BIGINT) AS distance, edge_confidence FROM (SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3)",
        "reachable_all_regions": f"WITH {PLACES}, {_reach('SELECT DISTINCT dst_id AS start_id, dst_id AS id, 0 AS distance FROM places WHERE dst_id % 10 = 4', 3)} SELECT start_id, CAST(distance AS BIGINT) AS distance, count(*) AS n FROM (SELECT start_id, id, distance FROM q0 UNION ALL SELECT start_id, id, distance FROM q1 UNION ALL SELECT start_id, id, distance FROM q2 UNION ALL SELECT start_id, id, distance FROM q3) GROUP BY 1, 2",
        "shortest_path_length": f"WITH RECURSIVE {EDGES}, p AS (SELECT DISTINCT src_id, dst_id FROM edges WHERE dst_id IS NOT NULL), w AS (SELECT 1::BIGINT AS id, 0 AS hops UNION SELECT dst_id, hops + 1 FROM w JOIN p ON src_id = id WHERE hops < 5) SELECT CAST(min(hops) AS BIGINT) AS hops FROM w WHERE id = 2",
        "level_breaks": f"WITH {PLACES}, {_reach('SELECT 14::BIGINT AS start_id, 14::BIGINT AS id, 0 AS distance', 2)} SELECT CAST(distance AS BIGINT) AS distance, arg_min(id, row(-(id % 97) / 97.0::DOUBLE, id)) AS id FROM (SELECT * FROM q1 UNION ALL SELECT * FROM q2) GROUP BY 1",
        "embed_queue": f"WITH {NODES} SELECT id, substr(kind || ' — ' || qname || ' — ' || signature, 1, 1000) AS text FROM nodes WHERE kind NOT IN ('module', 'var', 'const') AND id NOT IN (SELECT doc_id FROM labels)",
        "index_stats": f"WITH {FILES}, {EDGES} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE skip_reason IS NULL) AS parsed, (SELECT CAST(sum(loc) AS BIGINT) FROM files) AS loc, (SELECT CAST(sum(tok) AS BIGINT) FROM files) AS tok, (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE confidence = 'EXACT') AS exact, (SELECT count(*) FROM orders) AS imports, (SELECT count(*) FROM supplier) AS externals, (SELECT count(*) FROM customer) AS unresolved",
        "health_by_language": f"WITH {FILES}, q AS (SELECT lang, count(*) FILTER (quality = 1) AS exact, count(*) FILTER (quality <> 1 OR quality IS NULL) AS inferred, count(*) FILTER (toxic = 1) AS unresolved FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT f.lang, files, parsed, coalesce(exact, 0) AS exact, coalesce(inferred, 0) AS inferred, coalesce(unresolved, 0) AS unresolved, CAST(floor(exact * 100.0::DOUBLE / (exact + inferred + unresolved) + 0.5::DOUBLE) AS BIGINT) AS quality FROM (SELECT lang, count(*) AS files, count(*) FILTER (skip_reason IS NULL) AS parsed FROM files GROUP BY 1) f LEFT JOIN q USING (lang)",
        "skip_histogram": files + "SELECT skip_reason, count(*) AS files FROM files WHERE skip_reason IS NOT NULL GROUP BY 1",
        "top_unresolved": "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "import_rate": "SELECT count(*) AS imports, count(*) FILTER (l_returnflag = 'A') AS inside, count(*) FILTER (l_returnflag = 'N') AS outside, count(*) FILTER (l_returnflag = 'R') AS unresolved, CAST(floor(count(*) FILTER (l_returnflag <> 'R') * 100.0::DOUBLE / count(*) + 0.5::DOUBLE) AS BIGINT) AS rate FROM lineitem",
        "usage_ledger": "SELECT tool, calls, r AS tokens_returned, s AS tokens_source, CAST(floor(r::DOUBLE / calls + 0.5::DOUBLE) AS BIGINT) AS avg_returned, CAST(floor((s - r) * 100.0::DOUBLE / s + 0.5::DOUBLE) AS BIGINT) AS saved_percent FROM (SELECT event_type AS tool, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS r, CAST(sum(CAST(floor(value * 3) AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY 1)",
        "known_minus_seen": "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "incremental_status": "SELECT status, count(*) AS files FROM (SELECT CASE WHEN doc_id % 5 = 0 AND doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 11 = 0 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 3 = 0 THEN 'touched' ELSE 'unchanged' END AS status FROM documents) WHERE status IS NOT NULL GROUP BY 1",
        "debounce_sessions": "SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run",
        "throttle": "SELECT user_id, CAST(n AS BIGINT) AS fires FROM (SELECT user_id, list_reduce(list_concat([{'last': NULL::BIGINT, 'n': 0}], list_transform(list_sort(list(epoch_us(ts))), lambda t: {'last': t, 'n': 0})), lambda a, x: CASE WHEN a.last IS NULL OR x.last - a.last >= 86400000000 THEN {'last': x.last, 'n': a.n + 1} ELSE a END).n AS n FROM events GROUP BY 1)",
        "upsert_snapshot": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier",
        "html_symbols": "SELECT name, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, {x} AS n FROM pages" for t, x in HTML.items()) + " UNION ALL SELECT unnest(regexp_extract_all(html, '<[a-z0-9]+[^>]*\\sid=\"([^\"]+)\"', 1)) AS name, 1 AS n FROM pages) GROUP BY 1 HAVING sum(n) > 0",
        "json_keys": "SELECT name, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS name FROM events) GROUP BY 1",
    }
