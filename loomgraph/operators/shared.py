"""The shared folder and written steps (no lineage to recompute, true sizes for the planner); batches that fit a Python worker."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that travels to a Python worker, unless the session names a figure of its own. A longer text is a batch by itself.
BATCH_BYTES = 4 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests) a temporary one is taken; a cluster without it is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        at = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return at.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, in folders ``by`` a column where that is named, and read back; the table is deleted by ``dispose``, at the latest when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at.getParent())
    files.deleteOnExit(at)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def folder(df: DataFrame) -> str:
    """Where a written table is, with its scheme, for tasks that read parts of it themselves."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    path = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return path if "://" in path else path.replace("file:/", "file:///", 1)


def dispose(*frames: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more: what was made of them has been written itself."""
    for df in frames:
        if df is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends batches of about BATCH_BYTES at most to Python workers where it names no figure of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``df`` by keys over all cores, before a step that takes long or grows: a small file of many rows is read by one task. The number isn't
    left to the planner, which would merge what is small still."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)
