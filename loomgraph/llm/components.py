"""Connected components of an edge table: in one task while the edges are few, by alternating large-star and small-star steps beyond."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import dispose, map_arrow, written

#: Edges (16 bytes each) up to which one task does it all; the result is the same either way.
ONE_TASK_EDGES = 2_000_000

SCHEMA = "doc_id bigint, cluster bigint"


def lowest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest vertex of each vertex's component, of a graph of the vertices 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new[label]


def connected_components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(doc_id, cluster) for every vertex of ``edges`` (a bigint, b bigint); cluster is the lowest id reachable.

    Beyond ``one_task_edges`` every round hangs each vertex's larger (then smaller) neighbours on its smallest one, until nothing
    changes: O(log n) rounds, each a few shuffles of the edges. Each step is written to the shared folder, so lost
    executors cost one step. Edges with a null end are ignored; a == b only names a vertex. An empty table gives an empty one.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    now = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    if now.limit(one_task_edges + 1).count() <= one_task_edges:

        def run(it):
            parts = list(it)
            if not parts:
                return
            a, b = (np.concatenate([x.column(c).to_numpy() for x in parts]) for c in ("a", "b"))
            ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            low = lowest_reachable(len(ids), place[: len(a)], place[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[low])], names=["doc_id", "cluster"])

        out = written(map_arrow(now.coalesce(1), run, SCHEMA), "components-found")
        dispose(now)
        return out
    loops = written(now.where("a = b").select(F.col("a").alias("doc_id")), "components-loops")
    first, now = now, written(now.where("a != b"), "components")
    dispose(first)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a vertex go to its minimum
        large = both.join(low, "a").where("b > a and m != b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a vertex and its smaller neighbours go to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        step = written(step, "components")
        state = step.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        dispose(now)
        now = step
        if state == before:
            break
        before = state
    tree = now.select(F.col("a").alias("doc_id"), F.col("b").alias("cluster"))
    roots = tree.select(F.col("cluster").alias("doc_id"), "cluster").distinct()
    lone = loops.join(tree.select("doc_id").unionByName(roots.select("doc_id")), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("cluster"))
    return tree.unionByName(roots).unionByName(lone)
