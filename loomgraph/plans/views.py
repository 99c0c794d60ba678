"""Index tables derived from the driver's tables, for the registered queries. Each has its SQL twin in ``oracles``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import content_hash, estimate, line_count, text_skip_reason


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of a directory tree source/language."""
    d = table(spark, sf_dir, "documents")
    reason = text_skip_reason(F.col("text"))
    return d.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "lang", F.col("n_chars").cast("bigint").alias("size"), estimate(F.col("text")).alias("tok"), line_count(F.col("text")).alias("loc"), content_hash(F.col("text")).alias("hash"), reason.alias("skip_reason"), reason.isNull().alias("parsed"), F.col("source").alias("subproject"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part size and brand."""
    p = table(spark, sf_dir, "part").select("p_size", "p_brand").distinct()
    return p.select(_file_id().alias("id"), F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/m"), F.col("p_size"), F.lit(".py")).alias("path"), F.lit("python").alias("lang"), (F.col("p_size") % 10 != 0).alias("parsed"), F.when(F.col("p_size") % 10 == 0, "generated").alias("skip_reason"), (F.col("p_size") * 10).cast("bigint").alias("tok"), F.col("p_size").cast("bigint").alias("loc"))


def _file_id():
    return (F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint") * 1000 + F.col("p_size")).cast("bigint")


KINDS = {"ECONOMY": "function", "STANDARD": "class", "PROMO": "method", "LARGE": "field", "SMALL": "const", "MEDIUM": "type"}


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a symbol of its file."""
    p = table(spark, sf_dir, "part")
    kind = F.coalesce(*[F.when(F.col("p_type") == k, v) for k, v in KINDS.items()], F.lit("var"))
    return p.select(F.col("p_partkey").alias("id"), _file_id().alias("file_id"), kind.alias("kind"), F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_name").alias("qname"), F.concat_ws(" ", "p_type", "p_name").alias("signature"), F.lit(None).cast("string").alias("doc"), F.col("p_size").cast("bigint").alias("tok"), (F.pmod("p_partkey", F.lit(100)) / 100.0).alias("rank"), (F.col("p_size") % 2 == 0).alias("is_exported"), F.col("p_partkey").alias("ordinal"), F.lit(None).cast("bigint").alias("parent_id"), F.col("p_size").alias("start_line"), (F.col("p_size") + F.pmod("p_partkey", F.lit(7)).cast("int")).alias("end_line"), F.when(F.pmod("p_partkey", F.lit(5)) == 0, "private").alias("visibility"), F.lit(0).alias("depth"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from the part of each order line to that of the next line of the same order; the last line's goes outside, to the supplier."""
    li = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    nxt = F.lead("l_partkey").over(w)
    return li.select(F.col("l_partkey").alias("src_id"), nxt.alias("dst_id"), F.when(nxt.isNull(), F.col("l_suppkey")).alias("ext_id"), F.col("l_orderkey").alias("file_id"), F.when(F.col("l_linestatus") == "F", "call").otherwise("type").alias("kind"), F.when(F.col("l_returnflag") == "R", "INFERRED").otherwise("EXACT").alias("confidence"), F.col("l_linenumber").cast("bigint").alias("line"))


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shallow graph: order -> customer -> nation -> region, and supplier -> nation; ids are spread by kind."""
    o, c, n, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "supplier"))
    rows = [
        o.select((F.col("o_orderkey") * 10 + 1).alias("src_id"), (F.col("o_custkey") * 10 + 2).alias("dst_id"), F.when(F.col("o_orderstatus") == "F", "INFERRED").otherwise("EXACT").alias("confidence")),
        c.select((F.col("c_custkey") * 10 + 2).alias("src_id"), (F.col("c_nationkey").cast("bigint") * 10 + 3).alias("dst_id"), F.lit("EXACT").alias("confidence")),
        s.select((F.col("s_suppkey") * 10 + 5).alias("src_id"), (F.col("s_nationkey").cast("bigint") * 10 + 3).alias("dst_id"), F.lit("EXACT").alias("confidence")),
        n.select((F.col("n_nationkey").cast("bigint") * 10 + 3).alias("src_id"), (F.col("n_regionkey").cast("bigint") * 10 + 4).alias("dst_id"), F.lit("EXACT").alias("confidence")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumns({"kind": F.lit("call"), "line": F.lit(1).cast("bigint"), "ext_id": F.lit(None).cast("bigint")})


def place_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = place_edges(spark, sf_dir)
    ids = e.select(F.col("src_id").alias("id")).unionByName(e.select(F.col("dst_id").alias("id"))).distinct()
    return ids.select("id", (F.pmod("id", F.lit(97)) / 97.0).alias("rank"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("id"), F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")).alias("path"), F.lit("html").alias("lang"), F.col("html").alias("text"))
