"""Shared plumbing of the training-data operators: the shared folder, written steps, Arrow text buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of 8-byte keys that an operator broadcasts after counting them; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000

#: Bytes of text that one vectorised step handles at a time (a longer document goes in several steps).
SLICE_BYTES = 1 << 20


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach. The cluster names it in ``spark.checkpoint.dir``;
    only where that is unset and the master is local (tests) a temporary folder is chosen; a cluster without it is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        at = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return at.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark understands it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    path = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return path if "://" in path else path.replace("file:/", "file:///", 1)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors,
    and gives the planner the true size of the result (so broadcasts rest on file sizes). The table
    is deleted by ``dispose``, at the latest when the driver's JVM ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def again(df: DataFrame) -> DataFrame:
    """The same written table as another relation: for joining it with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._written)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is deleted when the driver's JVM ends."""
    path = qualified(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at.getParent())
    files.deleteOnExit(at)
    return path


def dispose(*frames: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more: what was made of them has been written itself."""
    for df in frames:
        if df is not None:
            remove(df.sparkSession, df._written)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slots(spark: SparkSession) -> int:
    """Tasks that a wide step should have at least: the session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def integer_id(df: DataFrame, col: str) -> None:
    if df.schema[col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{col} must be an integer column, not {df.schema[col].dataType.simpleString()}")


def key_join(left: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join ``left`` with ``keys`` (few narrow columns, already written). The right side is
    counted: up to BROADCAST_KEYS rows it is broadcast, beyond that both sides shuffle."""
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return left.join(F.broadcast(keys), on, how)
    return left.join(keys.hint("merge"), on, how)


def text_buffer(col: pa.Array | pa.ChunkedArray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values of a string column and the n+1 offsets into them; null counts as ''."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if lower:
        col = pc.utf8_lower(col)
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def doc_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [i, j) of at most ``limit`` bytes; a longer document is alone in its run."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


#: Bytes of a batch that travels to a Python worker, unless the session names a figure of its own: texts are of any length,
#: and 10,000 long ones at once would not fit a worker. A single longer text is a batch by itself.
BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over batches of about BATCH_BYTES at most; memory that Arrow keeps for reuse is returned after each task."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))

    def tidy(it):
        yield from run(it)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy, schema)


def filtered(df: DataFrame, keep) -> DataFrame:
    """Rows of ``df`` for which ``keep(record_batch) -> bool array`` holds; all columns stay as they are."""

    def run(it):
        for b in it:
            if b.num_rows:
                yield b.filter(pa.array(np.asarray(keep(b), dtype=bool)))

    return map_arrow(df, run, df.schema)


def data_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(data_path(sf_dir, table))
