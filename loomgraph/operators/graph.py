"""Graph operators over edges (src_id, dst_id, ext_id, file_id, kind, confidence, line). Frontiers are DataFrames, never literal lists;
each level is written to the shared folder, which cuts lineage and survives lost executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import rank
from loomgraph.operators.shared import dispose, written

DIRECTIONS = ("callees", "callers", "explore", "impact", "path")

#: Links (16 bytes each) up to which one task walks or ranks a graph; beyond that every level or iteration is a distributed step. The result is the same.
ONE_TASK_LINKS = 2_000_000


def check_direction(direction: str) -> str:
    """The direction, or a ValueError that names those there are."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}: one of {', '.join(DIRECTIONS)}")
    return direction


def _few(links: DataFrame, most: int) -> bool:
    return links.limit(most + 1).count() <= most


def _sure(edges: DataFrame, min_confidence: str | None) -> DataFrame:
    return edges.where(F.col("confidence") == "EXACT") if min_confidence == "EXACT" else edges


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, callees): distinct neighbours of every node, callees within the index only."""
    pairs = edges.where("dst_id is not null").select("src_id", "dst_id").distinct()
    both = pairs.select(F.col("dst_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(pairs.select(F.col("src_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sums = both.groupBy("id").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def all_callers(edges: DataFrame, min_confidence: str | None = None) -> DataFrame:
    """(dst_id, src_id, line, sites, confidence, kind): the weakest link is a caller's confidence (INFERRED sorts after EXACT)."""
    return _sure(edges, min_confidence).where("dst_id is not null").groupBy("dst_id", "src_id").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("sites"), F.max("confidence").alias("confidence"), F.min("kind").alias("kind"))


def callers(edges: DataFrame, nodes: DataFrame, files: DataFrame, node_id: int, limit: int = 50, min_confidence: str | None = None) -> DataFrame:
    """Callers of one node, most important first."""
    rows = all_callers(edges.where(F.col("dst_id") == node_id), min_confidence)
    named = rows.join(nodes.select(F.col("id").alias("src_id"), "name", "qname", F.col("kind").alias("node_kind"), "rank", "file_id"), "src_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return named.select(F.col("src_id").alias("id"), "name", "qname", "node_kind", "path", "line", "sites", "confidence", "kind", "rank").orderBy(F.desc("rank"), "path", "id").limit(limit)


def callees(edges: DataFrame, nodes: DataFrame, files: DataFrame, externals: DataFrame, node_id: int, limit: int = 50) -> DataFrame:
    """(is_external, id, name, where, line, confidence, kind): internal and external targets, the limit for each of them, by line."""
    own = edges.where(F.col("src_id") == node_id)
    inside = own.join(nodes.select(F.col("id").alias("dst_id"), "qname", F.col("file_id").alias("_f")), "dst_id").join(files.select(F.col("id").alias("_f"), "path"), "_f")
    inside = inside.select(F.lit(False).alias("is_external"), F.col("dst_id").alias("id"), F.col("qname").alias("name"), F.col("path").alias("where"), "line", "confidence", "kind").distinct().orderBy("line", "id", "kind").limit(limit)
    outside = own.join(externals.select(F.col("id").alias("ext_id"), "ecosystem", "package", "symbol"), "ext_id")
    outside = outside.select(F.lit(True).alias("is_external"), F.col("ext_id").alias("id"), F.concat_ws(".", "package", F.when(F.col("symbol") != "", F.col("symbol"))).alias("name"), F.col("ecosystem").alias("where"), "line", "confidence", "kind").distinct().orderBy("line", "id", "kind").limit(limit)
    return inside.unionByName(outside)


def importers(imports: DataFrame, files: DataFrame, file_id: int, limit: int = 100) -> DataFrame:
    """Distinct imports that resolve to a file, by path."""
    hit = imports.where(F.col("resolved_file_id") == file_id).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return hit.select("file_id", "path", "spec", "symbol", "line").distinct().orderBy("path", "line", "spec", "symbol").limit(limit)


def impact(edges: DataFrame, nodes: DataFrame, node_id: int, depth: int = 3, limit: int | None = 200, min_confidence: str | None = None) -> DataFrame:
    """(id, distance, edge_confidence, rank, truncated): everything that reaches a node within ``depth`` steps back, at its smallest distance.

    ``edge_confidence`` is that of the strongest edge that reached the node first. ``limit`` None keeps all; else the closest, then most important, stay
    and ``truncated`` tells that there were at least ``limit``."""
    back = _sure(edges, min_confidence).where("dst_id is not null").groupBy("src_id", "dst_id").agg(F.min("confidence").alias("edge_confidence"))
    back = written(back.repartition("dst_id"), "impact-back")  # grouped once, not on every level
    start = nodes.where(F.col("id") == node_id).select("id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("edge_confidence"))
    seen = frontier = written(start, "impact")
    for d in range(1, depth + 1):
        new = back.join(frontier.select(F.col("id").alias("dst_id")), "dst_id").groupBy(F.col("src_id").alias("id")).agg(F.min("edge_confidence").alias("edge_confidence"))
        frontier = written(new.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("distance"), "edge_confidence"), "impact")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    out = seen.where("distance > 0").join(nodes.select("id", "rank"), "id")
    if limit is None:
        return out.withColumn("truncated", F.lit(False))
    cut = out.orderBy("distance", F.desc("rank"), "id").limit(limit + 1)
    many = cut.agg((F.count(F.lit(1)) >= limit).alias("truncated"))
    return cut.orderBy("distance", F.desc("rank"), "id").limit(limit).crossJoin(F.broadcast(many))


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start_id, id, distance): reverse reachability of many nodes at once, smallest distances."""
    back = edges.where("dst_id is not null").select("src_id", "dst_id").distinct()
    seen = frontier = written(starts.select(F.col("id").alias("start_id"), "id", F.lit(0).alias("distance")), "reach")
    for d in range(1, depth + 1):
        new = back.join(frontier.select("start_id", F.col("id").alias("dst_id")), "dst_id").select("start_id", F.col("src_id").alias("id")).distinct()
        frontier = written(new.join(seen, ["start_id", "id"], "left_anti").select("start_id", "id", F.lit(d).alias("distance")), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, src: int, dst: int, max_rounds: int = 8, one_task_links: int = ONE_TASK_LINKS) -> list[int] | None:
    """Node ids of a shortest path along edges of all kinds, None without one; bidirectional, both sides one level a round; ties by the lowest ids."""
    if src == dst:
        return [src]
    spark = edges.sparkSession
    steps = written(edges.where("dst_id is not null").select("src_id", "dst_id").distinct(), "path")
    if _few(steps, one_task_links):
        return _path_at_once(steps, src, dst, max_rounds)
    side = "id bigint, prev bigint"
    sides = [(spark.createDataFrame([(src, None)], side), "src_id", "dst_id"), (spark.createDataFrame([(dst, None)], side), "dst_id", "src_id")]
    seen = [s[0] for s in sides]
    levels: list[list[DataFrame]] = [[seen[0]], [seen[1]]]
    for _ in range(max_rounds):
        for i, (_, a, b) in enumerate(sides):
            frontier = levels[i][-1]
            new = steps.join(frontier.select(F.col("id").alias(a)), a).groupBy(F.col(b).alias("id")).agg(F.min(a).alias("prev")).join(seen[i].select("id"), "id", "left_anti")
            new = written(new.select("id", "prev"), "path")
            levels[i].append(new)
            seen[i] = seen[i].unionByName(new)
            meet = new.join(seen[1 - i].select("id"), "id").agg(F.min("id")).first()[0]
            if meet is not None:
                return _trace(levels[0], meet)[::-1] + _trace(levels[1], meet)[1:]
            if new.isEmpty():
                return None
    return None


def _path_at_once(steps: DataFrame, src: int, dst: int, max_rounds: int) -> list[int] | None:
    """The same search in one task, over arrays of all links."""

    def run(it):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in it]
        ends = [np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), ()))]
        came = [{src: None}, {dst: None}]
        front = [np.array([src]), np.array([dst])]
        for _ in range(max_rounds):
            for i in (0, 1):
                a, b = ends[i], ends[1 - i]
                hit = np.isin(a, front[i])
                order = np.lexsort((a[hit], b[hit]))  # of several ways to a node the one from the lowest id
                found: dict = {}
                for x, y in zip(a[hit][order].tolist(), b[hit][order].tolist()):
                    if y not in came[i]:
                        found.setdefault(y, x)
                came[i] |= found
                front[i] = np.array(sorted(found), np.int64)
                meet = min((x for x in found if x in came[1 - i]), default=None)
                if meet is not None:
                    left, right = [meet], [meet]
                    while (x := came[0][left[-1]]) is not None:
                        left.append(x)
                    while (x := came[1][right[-1]]) is not None:
                        right.append(x)
                    yield pa.RecordBatch.from_arrays([pa.array([left[::-1] + right[1:]], pa.list_(pa.int64()))], names=["path"])
                    return
                if not found:
                    return

    row = steps.select("src_id", "dst_id").coalesce(1).mapInArrow(run, "path array<bigint>").first()
    return list(row[0]) if row else None


def _trace(levels: list[DataFrame], node: int) -> list[int]:
    """From ``node`` back to the start of its side: one lookup for each level."""
    out = [node]
    for level in reversed(levels[1:]):
        row = level.where(F.col("id") == out[-1]).select("prev").first()
        if row is not None:
            out.append(row[0])
    return out


def hydrate(ids: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes of (pos, id) rows in their order."""
    return ids.join(nodes, "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").orderBy("pos")


def explore(edges: DataFrame, nodes: DataFrame, files: DataFrame, externals: DataFrame, node_id: int, limit: int = 30) -> dict[str, DataFrame]:
    """Degree, callers and callees of a node."""
    return {"degree": degree(nodes.where(F.col("id") == node_id), edges.where((F.col("src_id") == node_id) | (F.col("dst_id") == node_id))), "callers": callers(edges, nodes, files, node_id, limit), "callees": callees(edges, nodes, files, externals, node_id, limit)}


#: Levels of the blocks that ranges of lines are cut into: all of a 32-bit line number.
LINE_LEVELS = 31


def _blocks(first, last):
    """The (level, block) that a range of lines is made of, a block of level k being 2^k lines: at most two of each level, none overlapping."""

    def of(k):
        lo, hi = -F.call_function("shiftright", -first, k), F.call_function("shiftright", last + 1, k)
        own = lambda odd, block: F.when((lo < hi) & (odd.bitwiseAND(1) == 1), F.struct(k.alias("level"), block.alias("block")))
        return F.array(own(lo, lo), own(hi, hi - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LINE_LEVELS)), of)))


def upgrade_by_proof(edges: DataFrame, proofs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target a proof (edge_id, file_id, line) names become EXACT and point to the innermost node there.

    Ranges are cut into blocks, of which each keeps its shortest range; a line then looks up the one block of every level that it is in, so
    that no line meets all ranges of its file."""
    shortest = F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "id")
    ranges = nodes.where("kind != 'module'").groupBy("file_id", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line")).agg(F.min("id").alias("id"))
    blocks = ranges.select("file_id", shortest.alias("inner"), F.explode(_blocks(F.col("start_line"), F.col("end_line"))).alias("b")).groupBy("file_id", "b.level", "b.block").agg(F.min("inner").alias("inner"))
    proofs = proofs.select("edge_id", "file_id", F.col("line").cast("bigint").alias("line"))
    lines = proofs.select("file_id", "line").distinct().select("file_id", "line", F.explode(F.sequence(F.lit(0), F.lit(LINE_LEVELS))).alias("level"))
    at = lines.withColumn("block", F.call_function("shiftright", F.col("line"), F.col("level"))).join(blocks, ["file_id", "level", "block"]).groupBy("file_id", "line").agg(F.min("inner").alias("inner"))
    inner = proofs.join(at, ["file_id", "line"]).groupBy(F.col("edge_id").alias("id")).agg(F.min("inner").alias("inner")).select("id", F.col("inner.id").alias("proven"))
    changed = F.col("proven").isNotNull() & (F.col("confidence") == "INFERRED")
    return edges.join(inner, "id", "left").select(*[F.when(changed, F.col("proven")).otherwise(F.col(c)).alias(c) if c == "dst_id" else F.when(changed, "EXACT").otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in edges.columns])


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """(id, rank): power iteration from 1/n, parallel edges counted, the mass of nodes without targets spread evenly; divided by the maximum at the end.

    The links are written once. A small graph is ranked by one task, over arrays; a larger one by blocks of nodes (``rank``)."""
    known = nodes.select("id")
    links = written(edges.where("dst_id is not null").select("src_id", "dst_id"), "pagerank-links")
    n = known.count()
    if not n:
        return known.select("id", F.lit(0.0).alias("rank"))
    if n > one_task_links or not _few(links, one_task_links):
        out = rank.by_blocks(known, links, n, damping, iterations)
        dispose(links)
        return out
    links = links.join(known.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(known.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")
    out = links.groupBy("src_id").agg(F.count(F.lit(1)).alias("out"))
    links = links.groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("m")).join(out, "src_id").select("src_id", "dst_id", (F.col("m") / F.col("out")).alias("share"))
    base = known.join(out.select(F.col("src_id").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling"))
    return _pagerank_at_once(base, links, n, damping, iterations)


def _pagerank_at_once(base: DataFrame, links: DataFrame, n: int, damping: float, iterations: int) -> DataFrame:
    rows = base.select(F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("share"), "dangling")
    rows = rows.unionByName(links.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "share", F.lit(None).cast("boolean").alias("dangling")))

    def run(it):
        t = pa.Table.from_batches(list(it)).combine_chunks()
        own, linked = t.filter(t.column("b").is_null()), t.filter(t.column("b").is_valid())  # apart first: 64-bit ids beside nulls would pass through floats
        order = np.argsort(own.column("a").to_numpy())
        ids = own.column("a").to_numpy()[order]
        alone = own.column("dangling").to_numpy()[order]
        src, dst = (np.searchsorted(ids, linked.column(c).to_numpy()) for c in ("a", "b"))
        share = linked.column("share").to_numpy()
        r = np.full(n, 1.0 / n)
        for _ in range(iterations):
            r = (1 - damping) / n + damping * (np.bincount(dst, r[src] * share, n) + r[alone].sum() / n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(r / r.max())], names=["id", "rank"])

    return rows.coalesce(1).mapInArrow(run, "id bigint, rank double")
