"""Incremental indexing: batch differences, a streaming watcher, and debounce / throttle operators over event logs."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Snapshot with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def evicted(known: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    """Known rows that were not seen again."""
    return known.join(seen.select(key), key, "left_anti")


def without_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables less what belongs to the files (id) of ``gone``, and edges that point into them."""
    g = gone.select(F.col("id").alias("file_id"))
    out = {k: (t.join(gone.select("id"), "id", "left_anti") if k == "files" else t.join(g, "file_id", "left_anti") if "file_id" in t.columns else t) for k, t in tables.items()}
    lost = tables["nodes"].join(g, "file_id", "left_semi").select("id")
    if "edges" in out:
        out["edges"] = out["edges"].join(lost.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    for k in ("trigrams", "chunks"):
        if k in out:
            out[k] = out[k].join(lost.withColumnRenamed("id", "node_id"), "node_id", "left_anti")
    return out


def _micros(events: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column with or without time zone, or of one in milliseconds."""
    kind = dict(events.dtypes)[ts]
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(ts) if kind == "timestamp" else F.col(ts) * 1000


def debounce(events: DataFrame, key: str, ts: str, gap_ms: int = 250) -> DataFrame:
    """(key, started, ended, events): runs of events that follow each other within ``gap_ms``."""
    w = W.partitionBy(key).orderBy(ts)
    at = _micros(events, ts)
    new = F.coalesce((at - F.lag(at).over(w)) > gap_ms * 1000, F.lit(True)).cast("int")
    runs = events.where(F.col(ts).isNotNull()).withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events")).drop("run")


def throttle(events: DataFrame, key: str, ts: str, every_ms: int = 3000) -> DataFrame:
    """(key, fires): how often a throttled action fires: at the first event, then at the first one ``every_ms`` after the last that fired."""
    at = _micros(events, ts)
    times = events.where(F.col(ts).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("t"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, x):
        fire = acc["last"].isNull() | (x - acc["last"] >= every_ms * 1000)
        return F.struct(F.when(fire, x).otherwise(acc["last"]).alias("last"), (acc["n"] + fire.cast("bigint")).alias("n"))

    return times.select(key, F.aggregate("t", start, step)["n"].alias("fires"))


def debounce_stream(stream: DataFrame, key: str, ts: str, gap: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Streaming debounce: session windows with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), F.col(key)).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def watch(spark: SparkSession, root: str, update: Callable[[DataFrame], None], checkpoint: str, every: str = "250 milliseconds") -> StreamingQuery:
    """Call ``update`` with each micro-batch of new or changed files (path, mtime, size): one call at a time, later changes wait for the next.

    The file source doesn't report deletions: ``update`` finds them by the difference of listings."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(str(Path(root).resolve()))
    rows = stream.select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return rows.writeStream.foreachBatch(lambda df, _: update(df)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
