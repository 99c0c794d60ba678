"""Index statistics, health by language, usage ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import percent


def index_stats(files: DataFrame, nodes: DataFrame, edges: DataFrame, imports: DataFrame, externals: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row of totals; every table is read once, narrow. ``exact`` counts edges to the outside too."""
    n = F.count(F.lit(1))
    parts = [
        files.agg(n.alias("files"), F.count_if("parsed").alias("parsed"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.coalesce(F.sum("tok"), F.lit(0)).alias("tok")),
        nodes.agg(n.alias("nodes")),
        edges.agg(n.alias("edges"), F.count_if(F.col("confidence") == "EXACT").alias("exact")),
        imports.agg(n.alias("imports")),
        externals.agg(n.alias("externals")),
        unresolved.agg(n.alias("unresolved")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # single rows
    return out


def by_language(files: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(lang, files, parsed, exact, inferred, unresolved, quality): quality is the rounded percentage of proven references."""
    lang = files.select(F.col("id").alias("file_id"), "lang")
    f = files.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.count_if("parsed").alias("parsed"))
    e = edges.join(lang, "file_id").groupBy("lang").agg(F.count_if(F.col("confidence") == "EXACT").alias("exact"), F.count_if(F.col("confidence") == "INFERRED").alias("inferred"))
    u = unresolved.join(lang, "file_id").groupBy("lang").agg(F.count(F.lit(1)).alias("unresolved"))
    out = f.join(e, "lang", "left").join(u, "lang", "left").fillna(0, ["exact", "inferred", "unresolved"])
    return out.withColumn("quality", percent(F.col("exact"), F.col("exact") + F.col("inferred") + F.col("unresolved"))).orderBy(F.desc("files"), "lang")


def quality_band(quality):
    return F.when(quality >= 85, "good").when(quality >= 60, "fair").when(quality.isNotNull(), "poor")


def skip_histogram(files: DataFrame) -> DataFrame:
    return files.where("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "skip_reason")


def top_unresolved(unresolved: DataFrame, limit: int = 10) -> DataFrame:
    return unresolved.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def import_rate(imports: DataFrame) -> DataFrame:
    """One row: imports, inside, outside, unresolved and the resolved percentage."""
    inside, outside = F.col("resolved_file_id").isNotNull(), F.col("external_id").isNotNull()
    out = imports.agg(F.count(F.lit(1)).alias("imports"), F.count_if(inside).alias("inside"), F.count_if(~inside & outside).alias("outside"), F.count_if(~inside & ~outside).alias("unresolved"))
    return out.withColumn("rate", percent(F.col("inside") + F.col("outside"), F.col("imports")))


def usage_ledger(rows: DataFrame) -> DataFrame:
    """Totals by tool of ledger rows (tool, tokens_returned, tokens_source)."""
    out = rows.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_returned").alias("tokens_returned"), F.sum("tokens_source").alias("tokens_source"))
    return out.withColumn("avg_returned", F.floor(F.col("tokens_returned") / F.col("calls") + 0.5)).withColumn("saved_percent", percent(F.col("tokens_source") - F.col("tokens_returned"), F.col("tokens_source")))


def run_stats(status: DataFrame) -> DataFrame:
    """Files by status of a run."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def run_breakdown(changed: DataFrame) -> DataFrame:
    """Parsed files of a run by language and skipped ones by reason: (by, value, files)."""
    lang = changed.where("skip_reason is null and lang is not null").groupBy(F.lit("language").alias("by"), F.col("lang").alias("value")).agg(F.count(F.lit(1)).alias("files"))
    skip = changed.where("skip_reason is not null").groupBy(F.lit("skip").alias("by"), F.col("skip_reason").alias("value")).agg(F.count(F.lit(1)).alias("files"))
    return lang.unionByName(skip)


def subprojects(files: DataFrame) -> DataFrame:
    """Distinct sub-projects, by name."""
    return files.where("subproject is not null").select("subproject").distinct().orderBy("subproject")


def top_languages(files: DataFrame, limit: int = 12) -> DataFrame:
    """The languages with most parsed files."""
    return files.where("lang is not null and parsed").groupBy("lang").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "lang").limit(limit)


def symbol_uses(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Symbols with a name of more than three characters by the number of edges that end at them."""
    uses = edges.where("dst_id is not null").groupBy(F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    return nodes.where((F.length("name") > 3) & (F.col("kind") != "module")).join(uses, "id").select("id", "name", "kind", "uses").orderBy(F.desc("uses"), "id").limit(limit)


def write_ledger(calls: DataFrame, path: str) -> None:
    """Append usage rows (tool, tokens_returned, tokens_source) to a ledger that ``usage_ledger`` sums up."""
    calls.select("tool", F.col("tokens_returned").cast("bigint"), F.col("tokens_source").cast("bigint")).write.mode("append").parquet(path)


def to_json(rows: DataFrame) -> DataFrame:
    """(json): one object for each row, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))
