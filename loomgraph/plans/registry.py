"""Registry of the engine's own queries: each applies an operator to whole tables; SQL twins are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import extract, graph, health, resolve, retrieve, search, similar
from loomgraph.packs.languages import detect_language
from loomgraph.plans import more, oracles
from loomgraph.plans import views as V
from loomgraph.sources import walk
from loomgraph.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


# -- scalar functions and scans


@query
def token_estimate(s, d):
    return V.table(s, d, "documents").select("doc_id", T.estimate(F.col("text")).alias("tok"))


@query
def content_hash(s, d):
    return V.table(s, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query
def skip_reason(s, d):
    return V.table(s, d, "documents").select("doc_id", T.text_skip_reason(F.col("text")).alias("skip_reason"))


@query
def line_count(s, d):
    return V.table(s, d, "documents").select("doc_id", T.line_count(F.col("text")).alias("loc"))


@query
def binary_sniff(s, d):
    return V.table(s, d, "pages").select("page_id", T.is_binary(F.concat(F.col("html").cast("binary"), F.when(F.col("page_id") % 3 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")))).alias("tail_binary"), T.is_binary(F.concat(F.when(F.col("page_id") % 3 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")), F.col("html").cast("binary"))).alias("head_binary"))


@query
def stub_reason(s, d):
    """Oversized files and images are listed without being read; size is the document's, scaled."""
    f = V.table(s, d, "documents").select("doc_id", F.concat(F.lit("a/"), F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, ".PNG").otherwise(".txt")).alias("path"), (F.col("n_chars") * 300).alias("size"))
    reason = walk.stub_reason(F.col("path"), F.col("size"))
    return f.select("doc_id", reason.alias("reason"), F.when(reason.isNotNull(), walk.stub_hash(reason, F.col("size"), F.col("doc_id"))).alias("hash"))


@query
def language_detect(s, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("py", "RS", "tsx", "h", "unknown", "yml")]), (F.col("doc_id") % 6 + 1).cast("int"))
    p = V.table(s, d, "documents").select("doc_id", F.concat(F.lit("src/f"), F.col("doc_id"), F.lit("."), ext).alias("path"))
    return p.select("doc_id", detect_language(F.col("path")).alias("language"))


@query
def identifier_split(s, d):
    c = V.table(s, d, "customer")
    name = F.concat("c_name", F.lit("HTTPServerV2"), F.initcap("c_mktsegment"), F.lit("_x"))
    return c.select("c_custkey", F.array_join(T.split_identifier(name), " ").alias("words"))


@query
def path_functions(s, d):
    f = V.document_files(s, d).select("id", "path")
    p = F.col("path")
    return f.select("id", T.basename(p).alias("base"), T.dirname(p).alias("dir"), T.extension(p).alias("ext"), T.dir_prefix(p, 1).alias("top"), T.normalize_path(F.concat(F.lit("./"), F.replace(p, F.lit("/"), F.lit("\\")), F.lit("/"))).alias("norm"))


@query
def normalize_relative(s, d):
    f = V.document_files(s, d)
    spec = F.concat(F.lit("../../x/./"), "lang", F.lit("/../"), F.col("id"), F.lit(".js"))
    return f.select("id", T.normalize_relative(F.col("path"), spec).alias("target"))


@query
def symbol_text(s, d):
    n = V.part_nodes(s, d)
    return n.select("id", T.symbol_text(F.col("kind"), F.col("qname"), F.col("signature"), F.col("name"), F.col("doc")).alias("body"))


@query
def trigram_index(s, d):
    return search.trigram_index(V.part_nodes(s, d))


# -- rollups, outlines, budgets


@query
def dir_rollup(s, d):
    r = retrieve.dir_rollup(V.document_files(s, d), "", 1)
    return r.select("dir", "files", "tok", "loc", F.array_join("langs", ",").alias("langs"))


@query
def dir_rollup_deep(s, d):
    r = retrieve.dir_rollup(V.document_files(s, d), "", 2)
    return r.select("dir", "files", "tok", "loc", F.array_join("langs", ",").alias("langs"))


@query
def outline_budget(s, d):
    """Each conversation's turns as an outline under a budget of 400 tokens."""
    c = V.table(s, d, "conversations")
    lines = c.select("conv_id", F.col("turn").alias("ord"), F.concat("role", F.lit(": "), "text").alias("line"))
    return retrieve.fit_to_budget(lines, 400, ["conv_id"]).select("conv_id", "ord", "cost", "kept")


@query
def file_outline(s, d):
    return retrieve.outline_lines(V.part_nodes(s, d), ["function", "class", "method"])


# -- search


@query
def search_exact(s, d):
    return search.exact(search.with_files(V.part_nodes(s, d), V.part_files(s, d)), "red widget").select("id", "qname", "path")


@query
def search_prefix(s, d):
    return search.prefix(search.with_files(V.part_nodes(s, d), V.part_files(s, d)), "RED").select("id", "qname", "path")


@query
def search_text(s, d):
    return search.text(search.with_files(V.part_nodes(s, d), V.part_files(s, d)), "widget Brand#2").select("id", "qname", "path")


@query
def search_fuzzy(s, d):
    n = V.part_nodes(s, d)
    return search.fuzzy(search.with_files(n, V.part_files(s, d)), search.trigram_index(n), "red widgte").select("id", "qname", "path")


@query
def search_file(s, d):
    return search.unparsed_files(V.part_files(s, d), "m10").select("id", "name", "path", "signature")


@query
def search_merged(s, d):
    r = search.search(V.part_nodes(s, d), V.part_files(s, d), "red widget")
    return r.select("id", F.col("score").cast("bigint").alias("score"), F.array_join("why", "+").alias("why"), F.round("final", 6).alias("final"))


@query
def find_symbol(s, d):
    return search.find_symbol(V.part_nodes(s, d), "widget").select("id", "qname", F.col("tier").cast("bigint").alias("tier"))


@query
def full_text_search(s, d):
    n = V.part_nodes(s, d)
    return search.full_text(n, search.postings(n), "re red widget").select("id", F.round("bm25", 6).alias("bm25"))


# -- symbol tables and resolution


@query
def first_definitions(s, d):
    return resolve.first_definitions(V.part_nodes(s, d))


@query
def best_definitions(s, d):
    return resolve.best_definitions(V.part_nodes(s, d), V.part_files(s, d))


@query
def namespace_longest_prefix(s, d):
    """Each part's dotted name resolved to the longest declared prefix."""
    p = V.table(s, d, "part")
    brand, name = F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("."))
    declared = p.select(F.concat_ws(".", brand, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("ns")).where(F.col("p_size") % 2 == 0).unionByName(p.select(brand.alias("ns"))).groupBy("ns").agg(F.lit(1).alias("one"))
    want = p.select("p_partkey", F.explode(F.transform(resolve.csharp_candidates(F.concat_ws(".", brand, name)), lambda x: F.substring(x, 4, 1000))).alias("ns"))
    return want.join(declared, "ns").groupBy("p_partkey").agg(F.max_by("ns", F.length("ns")).alias("ns"))


# -- graph


@query
def degree(s, d):
    r = graph.degree(V.part_nodes(s, d), V.part_edges(s, d))
    return r.select("id", F.col("callers").cast("bigint").alias("callers"), F.col("callees").cast("bigint").alias("callees"))


@query
def callers_weakest_link(s, d):
    return graph.all_callers(V.part_edges(s, d))


@query
def callers_exact(s, d):
    return graph.all_callers(V.part_edges(s, d), "EXACT")


@query
def callers_of_node(s, d):
    r = graph.callers(V.part_edges(s, d), V.part_nodes(s, d), V.part_files(s, d), 42)
    return r.select("id", "qname", "path", "line", "sites", "confidence", "kind")


@query
def callees_of_node(s, d):
    ext = V.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("suppliers").alias("ecosystem"), F.col("s_name").alias("package"), F.lit("").alias("symbol"))
    return graph.callees(V.part_edges(s, d), V.part_nodes(s, d), V.part_files(s, d), ext, 42)


@query
def pagerank(s, d):
    r = graph.pagerank(V.part_nodes(s, d), V.part_edges(s, d))
    return r.select("id", F.round("rank", 8).alias("rank"))


@query
def impact_bfs(s, d):
    """All that reaches region 0 within three steps."""
    r = graph.impact(V.place_edges(s, d), V.place_nodes(s, d), 4, 3, None)
    return r.select("id", F.col("distance").cast("bigint").alias("distance"), "edge_confidence")


@query
def reachable_all_regions(s, d):
    e = V.place_edges(s, d)
    starts = e.where("dst_id % 10 = 4").select(F.col("dst_id").alias("id")).distinct()
    return graph.reachable(e, starts, 3).groupBy("start_id", F.col("distance").cast("bigint").alias("distance")).agg(F.count(F.lit(1)).alias("n"))


@query
def shortest_path_length(s, d):
    p = graph.shortest_path(V.part_edges(s, d), 1, 2)
    return s.createDataFrame([(len(p) - 1 if p else None,)], "hops bigint")


@query
def level_breaks(s, d):
    r = graph.impact(V.place_edges(s, d), V.place_nodes(s, d), 14, 2, None)
    return retrieve.level_breaks(r).where("is_first").select(F.col("distance").cast("bigint").alias("distance"), "id")


# -- embeddings


@query
def embed_queue(s, d):
    chunks = V.table(s, d, "labels").select(F.col("doc_id").alias("node_id"))
    q = similar.embed_queue(V.part_nodes(s, d), chunks)
    return q.select("id", "text")


# -- health, ledger, streaming shapes


@query
def index_stats(s, d):
    f, e = V.document_files(s, d), V.part_edges(s, d)
    r = health.index_stats(f, V.part_nodes(s, d), e, V.table(s, d, "orders"), V.table(s, d, "supplier"), V.table(s, d, "customer"))
    return r.select(*[F.col(c).cast("bigint").alias(c) for c in r.columns])


@query
def health_by_language(s, d):
    f = V.document_files(s, d)
    n = V.table(s, d, "labels")
    e = n.select(F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 1, "EXACT").otherwise("INFERRED").alias("confidence"))
    u = n.where("toxic = 1").select(F.col("doc_id").alias("file_id"))
    r = health.by_language(f, e, u)
    return r.select("lang", *[F.col(c).cast("bigint").alias(c) for c in r.columns[1:]])


@query
def skip_histogram(s, d):
    return health.skip_histogram(V.document_files(s, d))


@query
def top_unresolved(s, d):
    return health.top_unresolved(V.part_nodes(s, d).select("name"))


@query
def import_rate(s, d):
    i = V.table(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("resolved_file_id"), F.when(F.col("l_returnflag") == "N", F.col("l_suppkey")).alias("external_id"))
    r = health.import_rate(i)
    return r.select(*[F.col(c).cast("bigint").alias(c) for c in r.columns])


@query
def usage_ledger(s, d):
    e = V.table(s, d, "events").select(F.col("event_type").alias("tool"), F.floor("value").alias("tokens_returned"), F.floor(F.col("value") * 3).alias("tokens_source"))
    r = health.usage_ledger(e)
    return r.select("tool", *[F.col(c).cast("bigint").alias(c) for c in r.columns[1:]])


@query
def known_minus_seen(s, d):
    known = V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"))
    return incremental.evicted(known, V.table(s, d, "labels").select(F.col("doc_id").cast("string").alias("path")))


@query
def incremental_status(s, d):
    f = V.document_files(s, d).select("path", "hash", F.col("id").alias("mtime"))
    known = f.where("mtime % 5 != 0").select("path", F.when(F.col("mtime") % 7 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"), (F.col("mtime") + F.when(F.col("mtime") % 3 == 0, 1).otherwise(0)).alias("mtime"))
    return health.run_stats(walk.status_of(f.where("mtime % 11 != 0"), known))


@query
def debounce_sessions(s, d):
    r = incremental.debounce(V.table(s, d, "events"), "user_id", "ts", 3_600_000)
    return r


@query
def throttle(s, d):
    return incremental.throttle(V.table(s, d, "events"), "user_id", "ts", 86_400_000)


@query
def upsert_snapshot(s, d):
    old = V.table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = old.where("s_suppkey % 3 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), (F.col("s_acctbal") * 2).alias("s_acctbal"))
    return incremental.upsert(old, new, "s_suppkey")


# -- extraction


@query
def html_symbols(s, d):
    """Landmark elements of all pages, by name."""
    n = extract.extract(V.page_files(s, d))["nodes"]
    return n.where("kind = 'element'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query
def html_links(s, d):
    """Links of all pages, resolved against the page's path."""
    p = V.page_files(s, d)
    x = extract.extract(p)
    i = x["imports"].join(p.select(F.col("id").alias("file_id"), "path"), "file_id")
    return i.select("path", "spec", T.normalize_relative(F.col("path"), F.col("spec")).alias("target")).groupBy("path", "target").agg(F.count(F.lit(1)).alias("links"))


@query
def json_keys(s, d):
    e = V.table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("e/"), F.col("event_id"), F.lit(".json")).alias("path"), F.lit("json").alias("lang"), F.col("props").alias("text"))
    return extract.extract(e)["nodes"].where("kind = 'key'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return _QUERIES | more.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.sql().items() if k in _QUERIES} | more.sql()


