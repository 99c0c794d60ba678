"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are spread by hash over shards of at most about ``shard_rows`` (fewer, so that there is work for all tasks, but no fewer than ``least_rows``). In a shard
the level of a vector is drawn from a hash of its id, geometrically. Levels are built from the top: vectors are inserted
in batches into the graph made so far, each batch searching it with a beam of ``ef_build`` from where the levels above lead, and comparing its own members with each other; of
what is found the diversity rule keeps ``m`` (a candidate is dropped if it lies nearer to a neighbour already
chosen; free places go to the nearest dropped). These stay; as many places again hold the most similar of the vectors that chose
this one, and a vector that none holds gets a place at its nearest. Each level is a flat array of neighbour numbers of fixed
width. Building takes about n log n, so a shard may have millions of vectors.

A search goes down the levels with a small beam, then widens one of ``ef`` on the lowest; many queries walk in step, so that every
step is one array operation. The queries are the rows whose id is divisible by ``query_every``; each visits every shard of vectors of its
length, and the best ``k`` over all shards remain. Shards and blocks of queries are packed rows in the shared folder; a task takes one shard and some blocks of queries.

Defined results: null vectors, and those with null, NaN, infinite or only zero entries, are neither found nor queries. Rows with a null id are left out. Of rows
that share an id the lowest vector counts. A row isn't its own neighbour; equal vectors under other ids are. Ties go to the lower id. Vectors of different lengths
(numbers of entries) never meet: each length has its own shards. Fewer than k + 1 vectors give fewer neighbours; an empty table gives an empty
result. Only the id and vector columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import dispose, slots, written
from loomgraph.llm.embdedup import units, usable

SCHEMA = "vec_id bigint, rank int, neighbour_id bigint, cosine double"


@dataclass(frozen=True)
class HnswParams:
    """``m``: neighbours that a vector chooses (it has twice as many places); ``ef``, ``ef_build``, ``ef_down``: beams of the search, of the build, and on the upper levels."""

    k: int = 10
    m: int = 16
    ef: int = 128
    ef_build: int = 48
    ef_down: int = 8
    shard_rows: int = 262_144
    least_rows: int = 8192
    query_block: int = 512
    query_every: int = 50


@dataclass
class Graph:
    """levels[l] = (member numbers, neighbours[member, width] by place among the members, -1 where there is none); level 0 has all vectors."""

    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]


def level_of(ids: np.ndarray, m: int) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum((-np.log(u) / np.log(m)).astype(int), 12)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, expand: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, cosines)[query, ef] found by walking ``links`` from ``start``[query, s], best first; -1 and -3 where there are fewer."""
    nq, n = len(q), len(x)
    ef = min(max(ef, start.shape[1]), n)
    score = np.full((nq, ef), -3, np.float32)
    num = np.full((nq, ef), -1, np.int32)
    done = np.ones((nq, ef), bool)
    seen = np.full(nq * n, -1, np.int32)
    s = start.shape[1]
    there = start >= 0
    num[:, :s] = start
    score[:, :s] = np.where(there, np.matmul(x[np.maximum(start, 0)], q[:, :, None])[:, :, 0], -3)
    done[:, :s] = ~there
    r, c = np.nonzero(there)
    seen[r * n + start[r, c]] = 0
    live = np.arange(nq)
    expand = min(expand, ef)
    while len(live):
        b, sc, d = num[live], score[live], done[live]
        rank = np.where(d, np.float32(-4), sc)
        j = np.argpartition(-rank, expand - 1, axis=1)[:, :expand] if expand < ef else np.broadcast_to(np.arange(ef), (len(live), ef))
        open_ = ~np.take_along_axis(d, j, 1)
        some = open_.any(axis=1)
        if not some.all():
            live, b, sc, d, j, open_ = live[some], b[some], sc[some], d[some], j[some], open_[some]
            if not len(live):
                break
        np.put_along_axis(d, j, True, 1)
        cand = links[np.take_along_axis(b, j, 1)]
        cand[~open_] = -1
        cand = cand.reshape(len(live), -1)
        r, c = np.nonzero(cand >= 0)
        v = cand[r, c]
        at = live[r] * n + v
        new = seen.take(at) < 0
        r, v, at = r[new], v[new], at[new]
        turn = np.arange(len(at), dtype=np.int32)
        seen[at] = turn  # a number that two expansions name counts once: for the one that wrote last
        new = seen.take(at) == turn
        r, v = r[new], v[new]
        per = np.bincount(r, minlength=len(live))
        width = int(per.max()) if len(r) else 0
        if width:
            place = np.arange(len(r)) - (np.cumsum(per) - per)[r]
            more = np.full((len(live), width), -3, np.float32)
            names = np.full((len(live), width), -1, np.int32)
            more[r, place] = np.einsum("ij,ij->i", x.take(v, 0), q.take(live[r], 0))
            names[r, place] = v
            b, sc, d = np.concatenate([b, names], 1), np.concatenate([sc, more], 1), np.concatenate([d, names < 0], 1)
            keep = np.argpartition(-sc, ef - 1, axis=1)[:, :ef]
            b, sc, d = (np.take_along_axis(a, keep, 1) for a in (b, sc, d))
        num[live], score[live], done[live] = b, sc, d
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(num, order, 1), np.take_along_axis(score, order, 1)


def diverse(x: np.ndarray, cand: np.ndarray, val: np.ndarray, m: int) -> np.ndarray:
    """Boolean choice of at most ``m`` of the candidates (best first, -1 where there is none) of each row."""
    near = np.matmul(v := x[np.maximum(cand, 0)], v.transpose(0, 2, 1))
    there = cand >= 0
    chosen = np.zeros(cand.shape, bool)
    room = np.full(len(cand), m)
    for j in range(cand.shape[1]):
        clash = ((near[:, j, :] > val[:, j, None]) & chosen).any(axis=1)
        ok = there[:, j] & ~clash & (room > 0)
        chosen[:, j] = ok
        room -= ok
    for j in range(cand.shape[1]):
        ok = there[:, j] & ~chosen[:, j] & (room > 0)
        chosen[:, j] |= ok
        room -= ok
    return chosen


def _exact(x: np.ndarray, rows: slice, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, cosines) of the nearest of the vectors ``rows`` among each other, best first."""
    part = x[rows]
    sim = part @ part.T
    np.fill_diagonal(sim, -3)
    ef = min(ef, len(part) - 1)
    top = np.argpartition(-sim, ef - 1, axis=1)[:, :ef]
    val = np.take_along_axis(sim, top, 1)
    order = np.argsort(-val, axis=1, kind="stable")
    return np.take_along_axis(top, order, 1) + rows.start, np.take_along_axis(val, order, 1)


class _Level:
    """One level while it grows: vectors in the order of insertion."""

    def __init__(self, x: np.ndarray, m: int):
        self.x, self.m = x, m
        self.links = np.full((len(x), 2 * m), -1, np.int32)
        self.back = np.full((len(x), m), -3, np.float32)  # similarity of those who chose this one

    def insert(self, rows: slice, cand: np.ndarray, val: np.ndarray) -> None:
        chosen = diverse(self.x, cand, val, self.m)
        r, c = np.nonzero(chosen)
        place = (np.cumsum(chosen, axis=1) - 1)[r, c]
        src, dst, sim = rows.start + r, cand[r, c], val[r, c]
        self.links[src, place] = dst
        # those chosen hear of it: m places each for the most similar
        order = np.lexsort((src, -sim, dst))
        src, dst, sim = src[order], dst[order], sim[order]
        first = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else np.zeros(0, int)
        pos = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
        own = pos < self.m
        src, dst, sim, pos = src[own], dst[own], sim[own], pos[own]
        who = dst[pos == 0]
        names = np.full((len(who), self.m), -1, np.int32)
        sims = np.full((len(who), self.m), -3, np.float32)
        at = np.searchsorted(who, dst)
        names[at, pos], sims[at, pos] = src, sim
        names, sims = np.concatenate([self.links[who, self.m :], names], 1), np.concatenate([self.back[who], sims], 1)
        keep = np.argsort(-sims, axis=1, kind="stable")[:, : self.m]
        self.links[who, self.m :], self.back[who] = np.take_along_axis(names, keep, 1), np.take_along_axis(sims, keep, 1)

    def finish(self) -> np.ndarray:
        """The links; a vector that nobody holds takes the last place of the nearest that it chose."""
        held = np.zeros(len(self.x), bool)
        held[self.links[self.links >= 0]] = True
        for v in np.flatnonzero(~held & (self.links[:, 0] >= 0)):
            self.links[self.links[v, 0], -1] = v
        return self.links


def _descend(g: Graph, q: np.ndarray, ef: int) -> np.ndarray:
    """Numbers of vectors near each query, found on the levels of ``g``."""
    start = None
    for members, links in g.levels:  # from the top while building and searching
        x = g.vectors[members]
        first = np.zeros((len(q), 1), np.int64) if start is None else np.searchsorted(members, start)
        found, _ = beam(x, links, q, first, ef)
        start = members[np.maximum(found[:, : max(1, ef // 2)], 0)]
    return start


def build(ids: np.ndarray, x: np.ndarray, p: HnswParams) -> Graph:
    """Graph of unit vectors (float32)."""
    level = level_of(ids, p.m)
    upper = Graph(x, [])
    for lv in range(level.max(), -1, -1):
        members = np.flatnonzero(level >= lv)
        # those of the levels above come first: they are where the search arrives
        order = members[np.argsort(-level[members], kind="stable")]
        xs = np.ascontiguousarray(x[order])
        place = np.full(len(x), -1, np.int64)
        place[order] = np.arange(len(order))
        grown, size = _Level(xs, p.m), min(len(xs), 1024)
        if size > 1:
            grown.insert(slice(0, size), *_exact(xs, slice(0, size), p.ef_build))
        while size < len(xs):
            rows = slice(size, min(len(xs), size + min(size, 1024, max(64, (1 << 25) // size))))
            q = xs[rows]
            start = np.zeros((len(q), 1), np.int64)
            if upper.levels:
                start = place[_descend(upper, q, p.ef_down)]
                start = np.where(start < size, start, 0)
                start[:, 1:] = np.where(start[:, 1:] == start[:, :1], -1, start[:, 1:])
            cand, val = beam(xs[:size], grown.links[:size], q, start, p.ef_build)
            if len(q) > 1:
                near = _exact(xs, rows, p.ef_build // 2)
                cand, val = np.concatenate([cand, near[0].astype(np.int32)], 1), np.concatenate([val, near[1]], 1)
                best = np.argsort(-val, axis=1, kind="stable")[:, : p.ef_build]
                cand, val = np.take_along_axis(cand, best, 1), np.take_along_axis(val, best, 1)
            grown.insert(rows, cand, val)
            size = rows.stop
        links = grown.finish()
        # back to the order of the members
        by_member = np.argsort(order, kind="stable")
        number = np.empty(len(order), np.int32)
        number[by_member] = np.arange(len(order))
        out = links[by_member]
        upper.levels.append((members, np.where(out >= 0, number[out], -1)))
    return upper


def search(g: Graph, q: np.ndarray, p: HnswParams, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, cosines) of the ``k`` best found for each query; -1 where there are fewer."""
    start = _descend(Graph(g.vectors, g.levels[:-1]), q, p.ef_down) if len(g.levels) > 1 else np.zeros((len(q), 1), np.int64)
    start[:, 1:] = np.where(start[:, 1:] == start[:, :1], -1, start[:, 1:])
    num, score = beam(g.vectors, g.levels[-1][1], q, start, max(p.ef, k))
    return num[:, :k], score[:, :k]


def neighbours(vectors: DataFrame, params: HnswParams = HnswParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """SCHEMA: the ``k`` nearest others found for every query, best first."""
    spark, p = vectors.sparkSession, params
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base = written(base.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "hnsw-vectors")
    asked = base.where(F.pmod("id", F.lit(p.query_every)) == 0)
    sizes = {r["dim"]: r["count"] for r in base.groupBy("dim").count().collect()}  # a row for each length of vectors
    if not sizes:
        return spark.createDataFrame([], SCHEMA)
    shards = {d: max(-(-n // p.shard_rows), min(slots(spark), -(-n // p.least_rows))) for d, n in sizes.items()}
    blocks = {r["dim"]: -(-r["count"] // p.query_block) for r in asked.groupBy("dim").count().collect()}
    if not blocks:
        return spark.createDataFrame([], SCHEMA)
    # a shard's blocks of queries are split over several tasks where shards are few
    parts = {d: max(1, min(blocks.get(d, 1), -(-slots(spark) // s))) for d, s in shards.items()}
    layout = spark.createDataFrame([(d, shards[d], blocks.get(d, 0), parts[d]) for d in sizes], "dim int, shards int, blocks int, parts int")

    level_type = pa.struct([("members", pa.binary()), ("links", pa.binary())])
    graph_schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("parts", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("levels", pa.list_(level_type))])

    def build_shard(keys, table):
        dim, shard, parts = (k.as_py() for k in keys)
        table = table.sort_by("id").combine_chunks()
        ids, x = table.column("id").to_numpy(), units(table.column("v").combine_chunks(), dim).astype(np.float32)
        g = build(ids, x, p)
        levels = [{"members": m.astype(np.int32).tobytes(), "links": e.astype(np.int32).tobytes()} for m, e in g.levels]
        return pa.Table.from_pylist([{"dim": dim, "shard": shard, "parts": parts, "ids": ids.tobytes(), "vectors": x.tobytes(), "levels": levels}], graph_schema)

    placed = base.join(F.broadcast(layout), "dim")
    graphs = placed.select("dim", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), "parts", "id", "v").groupBy("dim", "shard", "parts").applyInArrow(build_shard, "dim int, shard int, parts int, ids binary, vectors binary, levels array<struct<members: binary, links: binary>>")
    graphs = written(graphs, "hnsw-graphs")
    query_schema = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("shards", pa.int32()), ("parts", pa.int32()), ("q_ids", pa.binary()), ("q_vectors", pa.binary())])

    def pack_queries(keys, table):
        dim, block, shards, parts = (k.as_py() for k in keys)
        table = table.combine_chunks()
        x = units(table.column("v").combine_chunks(), dim).astype(np.float32)
        return pa.Table.from_pylist([{"dim": dim, "block": block, "shards": shards, "parts": parts, "q_ids": table.column("id").to_numpy().tobytes(), "q_vectors": x.tobytes()}], query_schema)

    packed = asked.join(F.broadcast(layout), "dim").select("dim", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks")).cast("int").alias("block"), "shards", "parts", "id", "v")
    packed = written(packed.groupBy("dim", "block", "shards", "parts").applyInArrow(pack_queries, "dim int, block int, shards int, parts int, q_ids binary, q_vectors binary"), "hnsw-queries")
    dispose(base)
    found_schema = pa.schema([("vec_id", pa.int64()), ("neighbour_id", pa.int64()), ("cosine", pa.float64())])

    def run(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        out, dim = [], keys[0].as_py()
        for gr in left.to_pylist():  # one graph
            ids = np.frombuffer(gr["ids"], np.int64)
            levels = [(np.frombuffer(v["members"], np.int32).astype(np.int64), np.frombuffer(v["links"], np.int32).reshape(-1, 2 * p.m)) for v in gr["levels"]]
            g = Graph(np.frombuffer(gr["vectors"], np.float32).reshape(-1, dim), levels)
            step = max(16, min(p.query_block, (1 << 25) // len(ids)))
            for batch in right.select(["q_ids", "q_vectors"]).to_batches(max_chunksize=1):  # one block of queries at a time
                qid = np.frombuffer(batch.column(0)[0].as_buffer(), np.int64)
                q = np.frombuffer(batch.column(1)[0].as_buffer(), np.float32).reshape(-1, dim)
                for i in range(0, len(q), step):
                    num, _ = search(g, q[i : i + step], p, p.k + 1)
                    rr, cc = np.nonzero(num >= 0)
                    a, b = qid[i + rr], ids[num[rr, cc]]
                    cos = np.einsum("ij,ij->i", q[i + rr].astype(np.float64), g.vectors[num[rr, cc]].astype(np.float64))
                    ok = a != b
                    out.append(pa.Table.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(np.round(cos[ok], 6))], schema=found_schema))
        return pa.concat_tables(out) if out else found_schema.empty_table()

    left = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = packed.withColumn("part", F.pmod("block", F.col("parts"))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    found = left.groupBy("dim", "shard", "part").cogroup(right.groupBy("dim", "shard", "part")).applyInArrow(run, "vec_id bigint, neighbour_id bigint, cosine double")
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.k).select("vec_id", "rank", "neighbour_id", "cosine")
