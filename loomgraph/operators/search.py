"""Symbol search over nodes and files. Every strategy is a DataFrame; evidence adds up in one aggregate.

``nodes`` carries id, file_id, kind, name, qname, signature, doc, rank and (joined by ``with_files``) path and lang. Limits of the strategies are
part of the semantics and have total orders: rank, then id.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import basename, identifier_parts, trigrams
from loomgraph.operators.shared import spread, written

HIT = ["id", "kind", "name", "qname", "signature", "rank", "path", "lang"]
SCORES = {"exact": 100, "prefix": 40, "text": 25, "fuzzy": 10, "file": 8}


def with_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with their file's path and language."""
    return nodes.join(files.select(F.col("id").alias("file_id"), "path", "lang"), "file_id")


def symbols(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") != "module")


def query_terms(query: str) -> list[str]:
    """Distinct words of a query: by white space and by the parts of identifiers; at least two characters."""
    import re

    edge = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|[^A-Za-z0-9]+"
    words = query.split() + [w.lower() for w in re.split(edge, query) if w]
    return [w for w in dict.fromkeys(words) if len(w) >= 2]


def _top(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("rank"), "id").limit(n)


def exact(nodes: DataFrame, q: str, limit: int = 50) -> DataFrame:
    return _top(symbols(nodes).where(F.col("name") == q).select(HIT), limit)


def prefix(nodes: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """Names that begin with the query in any case, but aren't it."""
    if len(q) < 2:
        return nodes.select(HIT).limit(0)
    return _top(symbols(nodes).where(F.lower("name").startswith(q.lower()) & (F.col("name") != q)).select(HIT), limit)


def text(nodes: DataFrame, q: str, limit: int = 60) -> DataFrame:
    """Any term within name, qualified name, signature or doc; terms are literal."""
    terms = query_terms(q)
    if not terms:
        return nodes.select(HIT).limit(0)
    tests = [F.lower(c).contains(t.lower()) for t in terms for c in ("name", "qname", "signature", "doc")]
    return _top(symbols(nodes).where(functools.reduce(operator.or_, [F.coalesce(t, F.lit(False)) for t in tests])).select(HIT), limit)


def trigram_index(nodes: DataFrame) -> DataFrame:
    """(tri, node_id): the inverted index of all symbol names."""
    return symbols(nodes).select(F.explode(trigrams(F.col("name"))).alias("tri"), F.col("id").alias("node_id"))


def fuzzy(nodes: DataFrame, index: DataFrame, q: str, limit: int = 40) -> DataFrame:
    """Names that share at least 70 % of the query's trigrams, most shared first."""
    low = q.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)} or ({low} if low else set()))
    if not grams:
        return nodes.select(HIT).limit(0)
    need = math.ceil(0.7 * len(grams) - 1e-9)
    hits = index.where(F.col("tri").isin(grams)).groupBy("node_id").agg(F.countDistinct("tri").alias("hits")).where(F.col("hits") >= need)
    return symbols(nodes).join(hits, F.col("id") == F.col("node_id")).orderBy(F.desc("hits"), F.desc("rank"), "id").limit(limit).select(HIT)


def unparsed_files(files: DataFrame, q: str, limit: int = 30) -> DataFrame:
    """Files without symbols whose path holds the query; their ids are negative-free pseudo ids ``file:<id>``."""
    hit = files.where(~F.col("parsed") & F.lower("path").contains(q.lower())).orderBy("path").limit(limit)
    return hit.select("id", F.lit("file").alias("kind"), basename(F.col("path")).alias("name"), F.col("path").alias("qname"), F.col("skip_reason").alias("signature"), F.lit(0.0).alias("rank"), "path", "lang")


def search(nodes: DataFrame, files: DataFrame, query: str, kind: str | None = None, lang: str | None = None, path: str | None = None, limit: int = 20, index: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(HIT columns, score, why, final), best first: sum of the strategies' scores times (1 + 2 rank), ties by qualified name and id. An empty query finds nothing.
    With ``terms`` (stored postings) the text strategy is the full-text one, else it looks for the terms as substrings."""
    q = query.strip()
    n = with_files(nodes, files)
    if not q:
        return n.select(*HIT, F.lit(0).alias("score"), F.array().cast("array<string>").alias("why"), F.lit(0.0).alias("final")).limit(0)
    found = {"exact": exact(n, q), "prefix": prefix(n, q), "text": text(n, q) if terms is None else n.join(full_text(nodes, terms, q).select("id"), "id").select(HIT), "fuzzy": fuzzy(n, index if index is not None else trigram_index(nodes), q), "file": unparsed_files(files, q)}
    parts = [df.withColumns({"why": F.lit(k), "score": F.lit(SCORES[k]), "is_file": F.lit(k == "file")}) for k, df in found.items()]
    every = functools.reduce(DataFrame.unionByName, parts)
    # hits of one node are equal in all other columns
    hits = every.groupBy("is_file", "id").agg(*[F.first(c).alias(c) for c in HIT if c != "id"], F.sum("score").alias("score"), F.sort_array(F.collect_set("why")).alias("why"))
    for column, want in (("kind", kind), ("lang", lang)):
        if want:
            hits = hits.where(F.col(column) == want)
    if path:
        hits = hits.where(F.startswith("path", F.lit(path)))
    return hits.withColumn("final", F.col("score") * (1 + 2 * F.col("rank"))).orderBy(F.desc("final"), "qname", "id").limit(limit).select(*HIT, "score", "why", "final")


def render_hits(hits: DataFrame) -> DataFrame:
    """(ord, line): numbered lines of search hits, a star for important ones, their signatures below."""
    n = hits.withColumn("n", F.row_number().over(W.orderBy(F.desc("final"), "qname", "id")))
    head = F.concat(F.lpad(F.col("n").cast("string"), 2, " "), F.when(F.col("rank") >= 0.5, "*").otherwise(" "), F.lit(" "), "qname", F.lit(" "), "kind", F.lit(" ["), F.array_join("why", "+"), F.lit("]"))
    sig = F.when(F.col("signature").isNotNull() & (F.col("signature") != F.col("name")), F.concat(F.lit("     "), "signature"))
    lines = n.select("n", F.posexplode(F.filter(F.array(head, sig), lambda x: x.isNotNull())).alias("pos", "line"))
    return lines.select((F.col("n") * 2 + F.col("pos")).alias("ord"), "line")


def find_symbol(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The first tier that has any: equal qualified name, equal name, qualified name holding the query. Modules count too."""
    q = query.strip()
    tier = F.when(F.col("qname") == q, 1).when(F.col("name") == q, 2).when(F.lower("qname").contains(q.lower()), 3)
    hits = nodes.withColumn("tier", tier).where(F.col("tier").isNotNull())
    best = hits.agg(F.min("tier").alias("tier"))
    return hits.join(F.broadcast(best), "tier").orderBy(F.desc("rank"), F.desc("tok"), "id").limit(limit)


def ambiguous(nodes: DataFrame, files: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(qname, kind, path, line): what else a symbol query matches in the same tier, after the best match."""
    best = find_symbol(nodes, query, limit + 1)
    n = best.withColumn("n", F.row_number().over(W.orderBy(F.desc("rank"), F.desc("tok"), "id"))).where("n > 1")  # at most limit + 1 rows
    return n.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").orderBy("n").select("qname", "kind", "path", F.col("start_line").alias("line"))


def miss_reason(files: DataFrame, query: str) -> DataFrame:
    """One row (reason, path) for a query that finds no symbol: 'no-symbols' with the first file whose path holds it (indexed, but without symbols), else 'unknown'."""
    hit = files.where(F.lower("path").contains(query.strip().lower())).agg(F.min("path").alias("path"))
    return hit.select(F.when(F.col("path").isNotNull(), "no-symbols").otherwise("unknown").alias("reason"), "path")


def nearest_level(files: DataFrame, path: str) -> DataFrame:
    """One row (path): the deepest directory above a path that has files, '' where none has."""
    parts = [p for p in path.split("/") if p]
    ups = ["/".join(parts[:k]) for k in range(len(parts), 0, -1)]
    if not ups:
        return files.limit(0).select("path").unionByName(files.sparkSession.createDataFrame([("",)], "path string"))
    depth = F.coalesce(*[F.when(F.startswith("path", F.lit(u + "/")), F.lit(len(ups) - i)) for i, u in enumerate(ups)], F.lit(0))
    best = files.agg(F.coalesce(F.max(depth), F.lit(0)).alias("d"))
    return best.select(F.array_join(F.slice(F.array(*[F.lit(p) for p in parts]), F.lit(1), F.col("d")), "/").alias("path"))


def postings(nodes: DataFrame) -> DataFrame:
    """(term, node_id, field, tf): full-text postings of names, their parts, qualified names, signatures and docs."""
    fields = {"name": F.col("name"), "parts": identifier_parts(F.col("name")), "qname": F.col("qname"), "signature": F.col("signature"), "doc": F.col("doc")}
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(v, F.lit("")).alias("body")) for k, v in fields.items()])
    one = spread(symbols(nodes).select("id", "name", "qname", "signature", "doc"), "id").select(F.col("id").alias("node_id"), F.explode(pairs).alias("f")).select("node_id", "f.field", F.explode(F.split(F.lower(fold_diacritics(F.col("f.body"))), r"[^\p{L}\p{N}_]+")).alias("term"))
    return one.where("term != ''").groupBy("term", "node_id", "field").agg(F.count(F.lit(1)).alias("tf"))


def fold_diacritics(c):
    """Latin letters without their accents."""
    src = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
    dst = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
    return F.translate(c, src, dst)


def full_text(nodes: DataFrame, index: DataFrame, q: str, limit: int = 60, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """bm25-ranked hits of any query word as a prefix of a term: (id, bm25), best first."""
    import re

    words = sorted({w for t in query_terms(q) for w in re.split(r"[^\w]+", t.lower()) if w})
    if not words:
        return nodes.select("id", F.lit(0.0).alias("bm25")).limit(0)
    # one row for each node: its length, and what terms begin with each word (a term counts for every word that it begins with)
    tf = [f"tf{i}" for i in range(len(words))]
    found = [F.coalesce(F.sum(F.when(F.startswith("term", F.lit(w)), F.col("tf"))), F.lit(0)).alias(c) for w, c in zip(words, tf)]
    each = written(index.groupBy("node_id").agg(F.sum("tf").alias("len"), *found), "full-text")
    total = each.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg"), *[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in tf])
    parts = [_bm25(F.col(c), F.col(f"d{c}"), k1, b) for c in tf]
    scored = each.where(functools.reduce(operator.or_, [F.col(c) > 0 for c in tf])).crossJoin(F.broadcast(total)).select("node_id", functools.reduce(operator.add, parts).alias("bm25"))
    return scored.select(F.col("node_id").alias("id"), "bm25").orderBy(F.desc("bm25"), "id").limit(limit)


def _bm25(tf: Column, df: Column, k1: float, b: float) -> Column:
    """What a word adds to the score of a node of ``len`` terms, 0 where it isn't found."""
    idf = F.log((F.col("docs") - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg")))
