"""PageRank of graphs beyond one task. Nodes are numbered within blocks; the links into a block are kept as arrays of positions, and one task
works out the block's new ranks while it reads the old ones block by block. Nothing is shuffled between iterations, each is one job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.shared import dispose, folder, written

#: Nodes of a block at most (8 bytes each in three arrays of a task). Every block reads all old ranks once in an iteration, so few large ones read least.
BLOCK_NODES = 1 << 22
#: Links that a task sorts at once (16 bytes each), and those of one stored row at most.
SORTED_LINKS, ROW_LINKS = 1 << 21, 1 << 16

#: Rows of links into block ``part`` from block ``other``: positions there (``a``) and here (``b``); with ``part`` below 0 positions and numbers of links out of block -1 - part.
LINKS = pa.schema([("part", pa.int32()), ("other", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
RANKS = pa.schema([("block", pa.int32()), ("ranks", pa.binary()), ("lost", pa.float64()), ("top", pa.float64())])


def _rows(at: str, columns: list[str]):
    """Record batches of the Parquet files in a folder; none where there is no folder."""
    files, root = fs.FileSystem.from_uri(at)
    for name in sorted(f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")):
        with files.open_input_file(name) as file:
            yield from pq.ParquetFile(file).iter_batches(16, columns=columns)


def _runs(key: np.ndarray):
    """(start, end) of runs of equal keys, of ROW_LINKS at most."""
    edges = np.flatnonzero(np.diff(key)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
        yield from ((i, min(b, i + ROW_LINKS)) for i in range(a, b, ROW_LINKS))


def _packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    db, dp, sb, sp = (np.concatenate(x) for x in zip(*parts))
    out: list[tuple] = []
    order = np.lexsort((sb, db))
    db, dp, to, at = db[order], dp[order], sb[order], sp[order]
    for i, j in _runs(db.astype(np.int64) << 32 | to):
        out.append((int(db[i]), int(to[i]), at[i:j].tobytes(), dp[i:j].tobytes()))
    source, links = np.unique(sb.astype(np.int64) << 32 | sp, return_counts=True)
    sb, sp, links = (source >> 32).astype(np.int32), (source & 0xFFFFFFFF).astype(np.int32), links.astype(np.int32)
    for i, j in _runs(sb):
        out.append((-1 - int(sb[i]), -1, sp[i:j].tobytes(), links[i:j].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), LINKS.types)], schema=LINKS)


def _pack(it):
    held, parts = 0, []
    for b in it:
        parts.append(tuple(c.to_numpy() for c in b.columns))
        held += b.num_rows
        if held >= SORTED_LINKS:
            yield _packed(parts)
            held, parts = 0, []
    if held:
        yield _packed(parts)


def by_blocks(known: DataFrame, links: DataFrame, n: int, damping: float, iterations: int) -> DataFrame:
    """(id, rank) of ``n`` known ids and links (src_id, dst_id), parallel ones counted; as ``graph.pagerank``."""
    spark = known.sparkSession
    blocks = max(-(-n // BLOCK_NODES), 2 * spark.sparkContext.defaultParallelism)
    placed = known.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    placed = written(placed.withColumn("pos", F.row_number().over(W.partitionBy("block").orderBy("id")) - 1), "pagerank-nodes", "block")
    size = dict(placed.groupBy("block").count().collect())

    inside = links.join(placed.select(F.col("id").alias("dst_id"), F.col("block").alias("db"), F.col("pos").alias("dp")), "dst_id")
    inside = inside.join(placed.select(F.col("id").alias("src_id"), F.col("block").alias("sb"), F.col("pos").alias("sp")), "src_id").select("db", "dp", "sb", "sp")
    packed = inside.mapInArrow(_pack, "part int, other int, a binary, b binary")
    packed = written(packed.repartition(2 * blocks, "part").sortWithinPartitions("part", "other"), "pagerank-blocks", "part")
    at, nodes_at = folder(packed), folder(placed)

    def into(k: int, before: str) -> np.ndarray:
        """What the links into a block give it."""
        given, have, ranks, links = np.zeros(size.get(k, 0)), None, None, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add():
            if held:
                a, b = (np.concatenate(x) for x in zip(*held))
                given[:] += np.bincount(b, ranks[a], len(given))
                held.clear()

        for batch in _rows(f"{at}/part={k}", ["other", "a", "b"]):
            for other, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if other != have or links >= SORTED_LINKS:
                    add()
                    links = 0
                if other != have:
                    have, ranks = other, np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for y in _rows(f"{before}/block={other}", ["ranks"]) for x in y.column(0)])
                held.append((np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)))
                links += len(held[-1][0])
        add()
        return given

    def step(before: str | None, last: bool):
        def run(it):
            for k in (k for b in it for k in b.column(0).to_pylist()):
                out = np.zeros(size.get(k, 0))
                for b in _rows(f"{at}/part={-1 - k}", ["a", "b"]):
                    for a, links in zip(*(c.to_pylist() for c in b.columns)):
                        out[np.frombuffer(a, np.int32)] += np.frombuffer(links, np.int32)  # a row names a position once
                if before is None:
                    r = np.full(len(out), 1.0 / n)
                else:
                    lost = sum(x for other in range(blocks) for b in _rows(f"{before}/block={other}", ["lost"]) for x in b.column(0).to_pylist())
                    r = (1 - damping) / n + damping * (into(k, before) + lost / n)
                share = r if last else np.divide(r, out, out=np.zeros(len(r)), where=out > 0)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((k, share.tobytes(), float(r[out == 0].sum()), float(r.max(initial=0.0))), RANKS.types)], schema=RANKS)

        return written(spark.range(0, blocks, 1, blocks).mapInArrow(run, "block int, ranks binary, lost double, top double"), "pagerank", "block")

    ranks = step(None, iterations == 0)
    for i in range(1, iterations + 1):
        ranks, old = step(folder(ranks), i == iterations), ranks
        dispose(old)
    dispose(packed)
    top, ranks_at = ranks.agg(F.max("top")).first()[0], folder(ranks)

    def named(it):
        for k in (k for b in it for k in b.column(0).to_pylist()):
            r = np.concatenate([np.zeros(0), *(np.frombuffer(x.as_buffer(), np.float64) for b in _rows(f"{ranks_at}/block={k}", ["ranks"]) for x in b.column(0))]) / top
            files, root = fs.FileSystem.from_uri(f"{nodes_at}/block={k}")
            if size.get(k):
                for f in sorted(x.path for x in files.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet")):
                    with files.open_input_file(f) as file:
                        for b in pq.ParquetFile(file).iter_batches(columns=["id", "pos"]):
                            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r[b.column(1).to_numpy()])], names=["id", "rank"])

    return spark.range(0, blocks, 1, blocks).mapInArrow(named, "id bigint, rank double")
