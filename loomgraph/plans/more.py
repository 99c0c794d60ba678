"""Queries of the operators that read, render, resolve and scan; each calls the operator itself and has its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import extract, graph, health, resolve, retrieve, search, similar, technologies
from loomgraph.plans import languages as L
from loomgraph.plans import oracles as O
from loomgraph.plans import views as V
from loomgraph.sources import walk
from loomgraph.streaming import incremental

QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return keep


def sql() -> dict[str, str]:
    return dict(_SQL)


def _plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, as SQL has them."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


P, N, E = O.PART_FILES, O.NODES, O.EDGES

# -- reading and outlines


@query("SELECT i + 1 AS line_no, string_split(text, chr(10))[i + 1] AS line FROM documents, LATERAL (SELECT unnest(range(0, len(string_split(text, chr(10))))) AS i) WHERE doc_id = 7 AND i BETWEEN 0 AND 4")
def read_range(s, d):
    """Lines 1 to 5 of a document."""
    c = V.table(s, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id")).alias("path"), "text")
    return _plain(retrieve.read_range(c, "d/7", 1, 5))


def _numbered(s, d) -> DataFrame:
    """A text of 60 numbered lines for every part file."""
    return V.part_files(s, d).select("path", F.concat_ws("\n", *[F.concat(F.lit(f"{i} "), "path") for i in range(1, 61)]).alias("text"))


@query(f"WITH {P}, {N}, {O.WITH_FILES} SELECT i AS line_no, i || ' ' || path AS line FROM n, LATERAL (SELECT unnest(range(start_line, end_line + 1)) AS i) WHERE id = 42 AND i <= 60")
def read_symbol_body(s, d):
    """The lines of a symbol."""
    return _plain(retrieve.read_symbol(_numbered(s, d), V.part_files(s, d), V.part_nodes(s, d), 42))


@query(f"WITH {N} SELECT start_line AS line_no, signature AS line FROM nodes WHERE id = 42")
def read_symbol_signature(s, d):
    return _plain(retrieve.read_symbol(_numbered(s, d), V.part_files(s, d), V.part_nodes(s, d), 42, "signature"))


_MARK = "CASE kind WHEN 'function' THEN 'f' WHEN 'class' THEN 'C' WHEN 'method' THEN 'm' WHEN 'field' THEN '.' WHEN 'const' THEN 'k' WHEN 'type' THEN 't' ELSE 'v' END"
_LINE = f"lpad(CAST(start_line AS VARCHAR), 4, ' ') || ' ' || {_MARK} || ' ' || CASE WHEN visibility = 'private' THEN '-' ELSE '' END || signature"


@query(f"""WITH {P}, {N}, w AS (SELECT id, path FROM pfiles WHERE path = 'src/brand3/m7.py'),
h AS (SELECT path || '  L7 ~70' AS line FROM w),
l AS (SELECT ordinal, {_LINE} AS line FROM nodes JOIN w ON w.id = file_id),
c AS (SELECT ordinal, line, sum({O._estimate("line")} + 1) OVER (ORDER BY ordinal) AS used FROM l),
b AS (SELECT 60 - {O._estimate("line")} AS room FROM h)
SELECT CAST(-1 AS BIGINT) AS ord, line FROM h UNION ALL SELECT ordinal, line FROM c, b WHERE used <= room
UNION ALL SELECT 2147483647, CASE WHEN count(*) = 0 THEN '  (no symbols extracted)' ELSE '  ... ' || count_if(used > room) || ' more symbols (raise the budget to see them)' END FROM c, b
HAVING count(*) = 0 OR count_if(used > room) > 0""")
def outline_file_budget(s, d):
    """Outline of one file within 60 tokens: header, symbols, note of what is left out."""
    return _plain(retrieve.outline_file(V.part_files(s, d), V.part_nodes(s, d), "src/brand3/m7.py", 60))


_COMPACT = "CASE WHEN sum(tok) < 1000 THEN CAST(CAST(sum(tok) AS BIGINT) AS VARCHAR) WHEN sum(tok) < 10000 THEN format('{:.1f}', floor(sum(tok) / 100.0::DOUBLE + 0.5) / 10) || 'k' WHEN sum(tok) < 1000000 THEN CAST(CAST(floor(sum(tok) / 1000.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || 'k' ELSE format('{:.1f}', floor(sum(tok) / 100000.0::DOUBLE + 0.5) / 10) || 'M' END"


@query(f"""WITH {O.FILES}, g AS (SELECT 0 AS section, sum(tok) AS tok, source || '/' || lang AS path, source || '/' || lang || '/  ' || count(*) || ' files ~' || {_COMPACT} || ' ' || lang AS line FROM files WHERE source = (SELECT min(source) FROM documents) GROUP BY source, lang)
SELECT row_number() OVER (ORDER BY section, tok DESC, path) AS ord, line FROM g""")
def outline_directory(s, d):
    """The directories of the first source, by tokens."""
    first = V.table(s, d, "documents").agg(F.min("source")).first()[0]
    return _plain(retrieve.outline_dir(V.document_files(s, d), first, 1))


# -- search


@query(f"""WITH {P}, {N}, {O.WITH_FILES}, {O.TRIGRAMS}, h AS (
  (SELECT id, 100 AS score, 'exact' AS why FROM n WHERE name = 'red widget' ORDER BY rank DESC, id LIMIT 50)
  UNION ALL (SELECT id, 40, 'prefix' FROM n WHERE starts_with(lower(name), 'red widget') AND name <> 'red widget' ORDER BY rank DESC, id LIMIT 50)
  UNION ALL (SELECT id, 25, 'text' FROM n WHERE {O._any(O.MERGED_TERMS)} ORDER BY rank DESC, id LIMIT 60)
  UNION ALL (SELECT n.id, 10, 'fuzzy' FROM n JOIN ({O._fuzzy("red widget")}) f ON f.id = n.id ORDER BY hits DESC, rank DESC, n.id LIMIT 40))
SELECT h.id, CAST(sum(score) AS BIGINT) AS score FROM h JOIN n ON n.id = h.id WHERE kind = 'function' AND starts_with(path, 'src/brand1')
GROUP BY h.id ORDER BY sum(score) * (1 + 2 * any_value(n.rank)) DESC, any_value(qname), h.id LIMIT 20""")
def search_filtered(s, d):
    """The merged search, functions of some directories only: filters hold after the strategies' limits."""
    r = search.search(V.part_nodes(s, d), V.part_files(s, d), "red widget", kind="function", lang="python", path="src/brand1")
    return r.select("id", F.col("score").cast("bigint").alias("score"))


@query(f"WITH {P}, {N}, b AS (SELECT *, row_number() OVER (ORDER BY rank DESC, tok DESC, id) AS n FROM nodes WHERE name = 'red widget') SELECT qname, kind, path, start_line AS line FROM b JOIN pfiles ON pfiles.id = file_id WHERE n BETWEEN 2 AND 9")
def ambiguous_symbols(s, d):
    return _plain(search.ambiguous(V.part_nodes(s, d), V.part_files(s, d), "red widget"))


@query(f"WITH {P} SELECT CASE WHEN min(path) IS NOT NULL THEN 'no-symbols' ELSE 'unknown' END AS reason, min(path) AS path FROM pfiles WHERE contains(path, 'm17')")
def miss_reason(s, d):
    return search.miss_reason(V.part_files(s, d), "M17")


@query(f"WITH {P} SELECT CASE WHEN count_if(starts_with(path, 'src/brand3/')) > 0 THEN 'src/brand3' WHEN count_if(starts_with(path, 'src/')) > 0 THEN 'src' ELSE '' END AS path FROM pfiles")
def nearest_level(s, d):
    return search.nearest_level(V.part_files(s, d), "src/brand3/none/x.py")


@query(f"WITH {P}, {N}, {O.WITH_FILES}, x AS (SELECT *, row_number() OVER (ORDER BY rank DESC, id) AS k FROM n WHERE name = 'red widget' ORDER BY rank DESC, id LIMIT 5), y AS (SELECT *, row_number() OVER (ORDER BY rank DESC, qname, id) AS m FROM x) SELECT m * 2 AS ord, lpad(CAST(m AS VARCHAR), 2, ' ') || CASE WHEN rank >= 0.5 THEN '*' ELSE ' ' END || ' ' || qname || ' ' || kind || ' [exact]' AS line FROM y UNION ALL SELECT m * 2 + 1, '     ' || signature FROM y WHERE signature <> name")
def rendered_hits(s, d):
    """Numbered lines of the five best exact hits."""
    hits = search.exact(search.with_files(V.part_nodes(s, d), V.part_files(s, d)), "red widget", 5)
    return _plain(search.render_hits(hits.withColumns({"why": F.array(F.lit("exact")), "final": F.col("rank")})))


# -- resolution


def _imports(s, d) -> DataFrame:
    """Every part file imports the next two of its brand, a package and a standard module."""
    f = V.part_files(s, d).select(F.col("id").alias("file_id"), F.pmod("id", F.lit(1000)).alias("n"))
    rows = [(F.concat(F.lit(".m"), F.col("n") + 1), None, "nx"), (F.lit("requests"), "get", "get"), (F.concat(F.lit(".m"), F.col("n") + 2), "red widget", "rw"), (F.lit("os.path"), None, "os")]
    specs = F.array(*[F.struct(a.alias("spec"), F.lit(b).cast("string").alias("symbol"), F.lit(c).alias("alias")) for a, b, c in rows])
    out = f.select("file_id", F.posexplode(specs).alias("ordinal", "i")).select("file_id", "ordinal", "i.*")
    return out.select(F.xxhash64("file_id", "ordinal").alias("id"), "file_id", "spec", "symbol", "alias", F.lit(1).alias("line"), "ordinal")


def _refs(s, d) -> DataFrame:
    """A reference for every order line, in the file of its part, of seven sorts."""
    li = V.table(s, d, "lineitem")
    n = V.part_nodes(s, d)
    r = li.join(n.select(F.col("id").alias("l_partkey"), "file_id"), "l_partkey").join(n.select(F.col("id").alias("l_suppkey"), F.col("name").alias("other")), "l_suppkey")
    c = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(7))
    name = F.when(c.isin(0, 3), F.col("other")).when(c == 1, "get").when(c == 2, "rw").when(c == 4, "print").when(c == 5, "join").otherwise("zzz")
    receiver = F.when(c == 0, "nx.x").when(c == 5, "os.path").when(c == 6, "qq")
    return r.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "file_id", F.col("l_partkey").alias("src_id"), name.alias("name"), F.when(c == 3, "type").otherwise("call").alias("kind"), receiver.alias("receiver"), F.lit(1).alias("line"), F.lit(0).alias("ordinal"))


def _resolved(s, d) -> dict[str, DataFrame]:
    return resolve.resolve(V.part_files(s, d), V.part_nodes(s, d), _imports(s, d), _refs(s, d))


_RESOLVED = f"""WITH {P}, {N}, {O.BEST}, {O.FIRST}, f AS (SELECT id, regexp_extract(path, '(brand[0-9]+)', 1) AS b, id % 1000 AS n FROM pfiles),
r AS (SELECT l_partkey AS src, p.file_id, o.name AS other, (l_orderkey + l_linenumber) % 7 AS c FROM lineitem JOIN nodes p ON p.id = l_partkey JOIN nodes o ON o.id = l_suppkey),
t AS (SELECT r.*, nx.id AS nx, rw.id AS rw FROM r JOIN f ON f.id = r.file_id LEFT JOIN f nx ON nx.b = f.b AND nx.n = f.n + 1 LEFT JOIN f rw ON rw.b = f.b AND rw.n = f.n + 2),
u AS (SELECT t.*, v.node_id AS via, w.node_id AS red, h.node_id AS here, call_id, any_id FROM t LEFT JOIN firsts v ON v.file_id = nx AND v.name = other LEFT JOIN firsts w ON w.file_id = rw AND w.name = 'red widget'
  LEFT JOIN firsts h ON h.file_id = t.file_id AND h.name = other LEFT JOIN best ON best.name = other),
e AS (SELECT src, CASE WHEN c = 3 THEN 'type' ELSE 'call' END AS kind,
  CASE c WHEN 0 THEN coalesce(via, here, call_id) WHEN 2 THEN red WHEN 3 THEN coalesce(here, any_id) END AS dst,
  CASE c WHEN 0 THEN CASE WHEN coalesce(via, here) IS NULL THEN 'INFERRED' ELSE 'EXACT' END WHEN 3 THEN CASE WHEN here IS NULL THEN 'INFERRED' ELSE 'EXACT' END WHEN 2 THEN CASE WHEN red IS NULL THEN 'NONE' ELSE 'EXACT' END WHEN 6 THEN 'NONE' ELSE 'EXACT' END AS confidence,
  CASE c WHEN 1 THEN 'pypi' WHEN 4 THEN 'builtin' WHEN 5 THEN 'python-stdlib' END AS ecosystem, CASE c WHEN 1 THEN 'requests' WHEN 4 THEN 'python' WHEN 5 THEN 'os' END AS package,
  CASE c WHEN 1 THEN 'get' WHEN 4 THEN 'print' WHEN 5 THEN '' END AS symbol, CASE c WHEN 2 THEN 'rw' WHEN 6 THEN 'zzz' END AS missing FROM u)"""


@query(_RESOLVED + " SELECT kind, confidence, coalesce(dst, -1) AS dst_id, coalesce(ecosystem, '-') AS ecosystem, coalesce(package, '-') AS package, coalesce(symbol, '-') AS symbol, count(*) AS n FROM e WHERE confidence <> 'NONE' AND dst IS DISTINCT FROM src GROUP BY ALL")
def resolved_references(s, d):
    """All rungs of the resolver: imported receiver, imported name, same file, best definition anywhere, runtime."""
    out = _resolved(s, d)
    ext = out["externals"].select(F.col("id").alias("ext_id"), "ecosystem", "package", "symbol")
    none = [F.coalesce(c, F.lit(v)).alias(c) for c, v in (("dst_id", -1), ("ecosystem", "-"), ("package", "-"), ("symbol", "-"))]
    return out["edges"].join(ext, "ext_id", "left").groupBy("kind", "confidence", *none).agg(F.count(F.lit(1)).alias("n"))


@query(_RESOLVED + " SELECT missing AS name, 'no-match' AS reason, count(*) AS n FROM e WHERE confidence = 'NONE' GROUP BY 1")
def unresolved_references(s, d):
    return _resolved(s, d)["unresolved"].groupBy("name", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(_RESOLVED + " SELECT 'no-match' AS reason, count(*) AS n FROM e WHERE confidence = 'NONE' HAVING count(*) > 0")
def unresolved_by_reason(s, d):
    return resolve.unresolved_by_reason(_resolved(s, d)["unresolved"])


@query(_RESOLVED + ", k AS (SELECT * FROM e WHERE confidence <> 'NONE' AND dst IS DISTINCT FROM src) SELECT count(*) AS edges, CAST(count_if(dst IS NOT NULL AND confidence = 'EXACT') AS BIGINT) AS exact, CAST(count_if(dst IS NOT NULL AND confidence = 'INFERRED') AS BIGINT) AS inferred, CAST(count_if(dst IS NULL) AS BIGINT) AS external, (SELECT count(*) FROM e WHERE confidence = 'NONE') AS unresolved FROM k")
def resolution_stats(s, d):
    out = _resolved(s, d)
    return resolve.stats(out["edges"], out["unresolved"])


@query(_RESOLVED + " SELECT ecosystem, package, symbol, count(*) AS use_count FROM e WHERE ecosystem IS NOT NULL GROUP BY ALL")
def external_uses(s, d):
    """Externals with the number of references to them."""
    return _resolved(s, d)["externals"].where("use_count > 0").select("ecosystem", "package", "symbol", "use_count")


@query(f"WITH {P}, f AS (SELECT id, path, regexp_extract(path, '(brand[0-9]+)', 1) AS b, id % 1000 AS n FROM pfiles) SELECT a.id AS file_id, a.path, '.m' || (a.n + k) AS spec, CASE k WHEN 2 THEN 'red widget' END AS symbol FROM f a JOIN (VALUES (1), (2)) AS t(k) ON true JOIN f z ON z.b = a.b AND z.n = a.n + k WHERE z.path = 'src/brand3/m7.py'")
def importers_of_file(s, d):
    f = V.part_files(s, d)
    imports = resolve.resolve_imports(_imports(s, d), f)
    one = f.where("path = 'src/brand3/m7.py'").select("id").first()
    return graph.importers(imports, f, one[0] if one else -1).select("file_id", "path", "spec", "symbol")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{lang}', '{x}', {k})" for i, (lang, _, _, want) in enumerate(L.IMPORTS) for k, x in enumerate(want)) + ") AS t(n, lang, key, ord)")
def import_candidates(s, d):
    """What specifiers of six languages may mean, in order."""
    c = s.createDataFrame([(i, lang, spec, at) for i, (lang, spec, at, _) in enumerate(L.IMPORTS)], "n int, lang string, spec string, path string")
    keys = resolve.import_candidates(F.col("lang"), F.col("spec"), F.col("path"), {"@/": ["src/"]}, "example.com/mod")
    return _plain(c.select("n", "lang", F.posexplode(keys).alias("ord", "key")))


# -- graph


@query(f"WITH {O.PLACES}, {O._reach('SELECT 14::BIGINT AS start_id, 14::BIGINT AS id, 0 AS distance', 2)} SELECT id, CAST(distance AS BIGINT) AS distance, count(*) OVER () >= 25 AS truncated FROM (SELECT * FROM q1 UNION ALL SELECT * FROM q2) ORDER BY distance, (id % 97) / 97.0::DOUBLE DESC, id LIMIT 25")
def impact_limited(s, d):
    """The 25 nearest, most important nodes that reach a region within two steps."""
    return graph.impact(V.place_edges(s, d), V.place_nodes(s, d), 14, 2, 25).select("id", F.col("distance").cast("bigint").alias("distance"), "truncated")


@query(f"WITH {N} SELECT p.p_partkey + 0 AS id, arg_min(nodes.id, row(nodes.end_line - nodes.start_line, nodes.id)) AS dst_id, 'EXACT' AS confidence FROM part p JOIN nodes ON nodes.file_id = {O.FILE_ID.replace('p_brand', 'p.p_brand').replace('p_size', 'p.p_size')} AND nodes.start_line <= p.p_size + 1 AND nodes.end_line >= p.p_size + 1 GROUP BY 1")
def proven_edges(s, d):
    """An inferred edge from every part, proven at the line after its own first one: it points to the innermost symbol there."""
    n = V.part_nodes(s, d)
    edges = n.select("id", F.lit(-1).cast("bigint").alias("dst_id"), F.lit("INFERRED").alias("confidence"))
    proofs = n.select(F.col("id").alias("edge_id"), "file_id", (F.col("start_line") + 1).alias("line"))
    return graph.upgrade_by_proof(edges, proofs, n).where("confidence = 'EXACT'")


@query(f"WITH {N}, {E} SELECT dst_id AS id, any_value(name) AS name, any_value(nodes.kind) AS kind, count(*) AS uses FROM edges JOIN nodes ON nodes.id = dst_id WHERE length(name) > 3 GROUP BY 1 ORDER BY uses DESC, 1 LIMIT 10")
def symbol_uses(s, d):
    return health.symbol_uses(V.part_nodes(s, d), V.part_edges(s, d))


@query(f"WITH {P}, {N}, {O.WITH_FILES}, {E}, c AS (SELECT n.qname, n.rank, path, n.id, min(e.line) AS line, max(confidence) AS confidence, min(e.kind) AS kind FROM edges e JOIN n ON n.id = e.src_id WHERE e.dst_id = 42 GROUP BY ALL) SELECT row_number() OVER (ORDER BY rank DESC, path, id) AS ord, CASE WHEN confidence = 'INFERRED' THEN '!' ELSE ' ' END || qname || ' :' || line || ' [' || kind || ']' AS line FROM c ORDER BY rank DESC, path, id LIMIT 50")
def rendered_callers(s, d):
    r = graph.callers(V.part_edges(s, d), V.part_nodes(s, d), V.part_files(s, d), 42)
    return _plain(retrieve.render_graph(r.withColumn("name", F.col("qname")), [F.desc("rank"), "path", "id"]))


# -- embeddings


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id AS node_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE)), 6) AS score FROM embeddings, q ORDER BY score DESC, 1 LIMIT 10")
def semantic_topk(s, d):
    e = V.table(s, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return similar.semantic_search(e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector")), q, 10).select("node_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, 4 * len(embedding) AS bytes, true AS same FROM embeddings")
def packed_vectors(s, d):
    """Vectors as bytes and back."""
    e = V.table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v")).withColumn("b", similar.pack_vector(F.col("v")))
    return e.select("vec_id", F.length("b").cast("bigint").alias("bytes"), (similar.unpack_vector(F.col("b")) == F.col("v")).alias("same"))


# -- health


@query(f"WITH {O.FILES} SELECT 'language' AS by, lang AS value, count(*) AS files FROM files WHERE skip_reason IS NULL AND lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'skip', skip_reason, count(*) FROM files WHERE skip_reason IS NOT NULL GROUP BY 2")
def run_breakdown(s, d):
    return health.run_breakdown(V.document_files(s, d))


@query("SELECT DISTINCT source AS subproject FROM documents WHERE source IS NOT NULL")
def subprojects(s, d):
    return health.subprojects(V.document_files(s, d))


@query(f"WITH {O.FILES} SELECT lang, count(*) AS files FROM files WHERE lang IS NOT NULL AND skip_reason IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_languages(s, d):
    return health.top_languages(V.document_files(s, d))


@query("SELECT doc_id, CASE WHEN n_chars % 101 >= 85 THEN 'good' WHEN n_chars % 101 >= 60 THEN 'fair' ELSE 'poor' END AS band FROM documents")
def quality_bands(s, d):
    return V.table(s, d, "documents").select("doc_id", health.quality_band(F.col("n_chars") % 101).alias("band"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","gone":null}' AS json FROM nation""")
def json_rows(s, d):
    return health.to_json(V.table(s, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("gone")))


# -- walking and change detection


@query("WITH f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, source, lang FROM documents) SELECT path, CASE WHEN lang = 'en' THEN source || '/en' WHEN doc_id % 2 >= 0 AND source <= 'm' THEN source END AS subproject FROM f")
def nearest_subproject(s, d):
    """Sub-projects at some sources, and at every source's English directory."""
    f = V.document_files(s, d).select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("source"))
    top = f.where("source <= 'm'").select(F.col("source").alias("dir")).distinct()
    marks = top.unionByName(f.select(F.concat("source", F.lit("/en")).alias("dir")).distinct())
    return walk.subproject_of(f.select("path"), marks)


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0 OR doc_id % 3 = 0")
def changed_by_stat(s, d):
    """Files that the index doesn't have with this time and size."""
    f = V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("mtime"), F.col("n_chars").cast("bigint").alias("size"))
    known = f.where("mtime % 10 != 0").withColumn("size", F.col("size") + F.when(F.col("mtime") % 3 == 0, 1).otherwise(0))
    return walk.changed_by_stat(f, known).select(F.col("path").cast("bigint").alias("doc_id"))


@query(f"WITH {N} SELECT 'nodes' AS part, count(*) AS n FROM nodes WHERE file_id % 3 <> 0 UNION ALL SELECT 'files', count(*) FROM (SELECT DISTINCT file_id FROM nodes) WHERE file_id % 3 <> 0")
def without_files(s, d):
    """What stays of an index when every third file goes."""
    f, n = V.part_files(s, d), V.part_nodes(s, d)
    kept = incremental.without_files({"files": f, "nodes": n}, f.where("id % 3 = 0").select("id"))
    return kept["nodes"].agg(F.lit("nodes").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(kept["files"].agg(F.lit("files").alias("part"), F.count(F.lit(1)).alias("n")))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', {str(h).lower()})" for p, h in L.IGNORED) + ") AS t(path, hidden)")
def ignore_rules(s, d):
    """Ignore rules of a root and of two directories, over some paths."""
    rules = walk.IgnoreRules(L.IGNORE_FRAMES)
    return s.createDataFrame([(p, rules.ignores(p)) for p, _ in L.IGNORED], "path string, hidden boolean")


@query("""SELECT n_nationkey, stack, ecosystem, evidence, frameworks FROM nation, (VALUES ('node', 'npm', 'package.json', 'js-tests,react'), ('python', 'pypi', 'api/pyproject.toml,requirements.txt', 'django,pytest'), ('rust', 'cargo', 'a/b/c/Cargo.toml', '')) AS t(stack, ecosystem, evidence, frameworks)""")
def detected_technologies(s, d):
    """Manifests of a repository for every nation: stacks, ecosystems, frameworks, evidence."""
    m = [("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}'), ("requirements.txt", "django==5\n"), ("api/pyproject.toml", "[tool.pytest]\n"), ("a/b/c/Cargo.toml", ""), ("a/b/c/d/go.mod", "module x"), ("node_modules/x/package.json", '"next": 1'), ("readme.md", "flask")]
    each = V.table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in m])).alias("m")).select("n_nationkey", "m.*")
    t = technologies.technologies(each, ["n_nationkey"])
    return t.select("n_nationkey", "stack", "ecosystem", F.array_join("evidence", ",").alias("evidence"), F.array_join("frameworks", ",").alias("frameworks"))


@query("""SELECT s_suppkey, s_name AS unquoted, s_name AS comment, '{"a//b": "' || s_name || '",  "k": [1 ] ' || chr(10) || '}' AS json, 'A Foo < ' || s_name AS summary, 'src/x.py' AS path, s_suppkey + 1 AS first, s_suppkey + 4 AS last,
'http://h' || s_suppkey || '/v1/embeddings' AS url, 3 AS line_start, 'a.py::' || s_name AS top, 'a.py::C#' || s_name AS method, 'f ' || s_name AS signature,
CASE WHEN s_suppkey * 1371 < 1000 THEN CAST(s_suppkey * 1371 AS VARCHAR) WHEN s_suppkey * 1371 < 10000 THEN format('{:.1f}', floor(s_suppkey * 13.71::DOUBLE + 0.5) / 10) || 'k' WHEN s_suppkey * 1371 < 1000000 THEN CAST(CAST(floor(s_suppkey * 1.371::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || 'k' ELSE format('{:.1f}', floor(s_suppkey * 0.01371::DOUBLE + 0.5) / 10) || 'M' END AS tokens FROM supplier""")
def text_helpers(s, d):
    """Scalar helpers over every supplier's name and number."""
    n, k = F.col("s_name"), F.col("s_suppkey")
    loc = T.parse_location(F.concat(F.lit("src/x.py:"), k + 1, F.lit("-"), k + 4))
    out = V.table(s, d, "supplier").select(
        "s_suppkey",
        T.unquote(F.concat(F.lit("`"), n, F.lit('"'))).alias("unquoted"),
        T.strip_comment(F.concat(F.lit("  /** "), n, F.lit(" */"))).alias("comment"),
        T.strip_json_comments(F.concat(F.lit('{"a//b": "'), n, F.lit('", /* x */ "k": [1, ], // y\n}'))).alias("json"),
        T.xml_summary(F.concat(F.lit('<summary>A <see cref="T:N.Foo"/> &lt;\n '), n, F.lit("</summary> more"))).alias("summary"),
        loc["path"].alias("path"),
        loc["first"].alias("first"),
        loc["last"].alias("last"),
        T.embeddings_url(F.concat(F.lit("http://h"), k, F.lit("/v1/"))).alias("url"),
        T.line_start(F.concat(F.lit("ab\ncd"), n), F.lit(5)).alias("line_start"),
        T.qualified_name(F.lit("function"), n, F.lit("module"), F.lit("a.py")).alias("top"),
        T.qualified_name(F.lit("method"), n, F.lit("class"), F.lit("a.py::C")).alias("method"),
        T.signature_line(F.concat(F.lit("f  "), n, F.lit(" {\n x"))).alias("signature"),
        T.compact_tokens(k * 1371).alias("tokens"),
    )
    return _plain(out)


# -- scanners


def _scanner(lang: str) -> None:
    """The source of ``languages.SOURCES`` for every supplier, its key in the names: definitions, references and imports."""
    ext, source, rows = L.SOURCES[lang]

    def run(s, d):
        text = F.replace(F.lit(source), F.lit("{k}"), F.col("s_suppkey").cast("string"))
        f = V.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("src/f"), F.col("s_suppkey"), F.lit(ext)).alias("path"), F.lit(lang).alias("lang"), text.alias("text"))
        x = extract.extract(f)
        nodes = x["nodes"].where("parent_id is not null")
        owner = x["nodes"].select(F.col("id").alias("parent_id"), F.when(F.col("parent_id").isNotNull(), F.col("name")).otherwise("").alias("owner"))
        defs = nodes.join(owner, "parent_id").select("file_id", F.lit("def").alias("record"), "kind", "name", "owner", F.col("start_line").alias("line"))
        holder = x["nodes"].select(F.col("id").alias("src_id"), F.when(F.col("parent_id").isNotNull(), F.col("name")).otherwise("").alias("owner"))
        refs = x["refs"].join(holder, "src_id").select("file_id", F.lit("ref").alias("record"), "kind", "name", "owner", "line")
        imports = x["imports"].select("file_id", F.lit("import").alias("record"), F.coalesce("symbol", F.lit("")).alias("kind"), F.col("spec").alias("name"), F.coalesce("alias", F.lit("")).alias("owner"), "line")
        return _plain(defs.unionByName(refs).unionByName(imports).withColumnRenamed("file_id", "s_suppkey"))

    name = f"symbols_{lang}"
    QUERIES[name] = run
    values = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    key = ", ".join(f"replace({c}, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS {c}" for c in ("kind", "name", "owner"))
    _SQL[name] = f"SELECT s_suppkey, record, {key}, line FROM supplier, (VALUES {values}) AS t(record, kind, name, owner, line)"


for _lang in L.SOURCES:
    _scanner(_lang)
