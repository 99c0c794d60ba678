"""MinHash near-dedup by a chosen-path set similarity join.

1. Every document's word ``shingle``-grams give ``n_hashes`` minwise tokens (whole texts, one pass); the
   sketches are written once. Documents with equal shingle sequences collapse to their lowest id.
2. Chosen path: each of ``trees`` independent trees branches a document, at every level, into the children
   named by those of its minwise tokens that a hash of (node, token) selects, each with probability
   1 / (branch_at * n_hashes): pairs as similar as ``branch_at`` meet again in about one child a level,
   dissimilar ones part quickly. The number of trees is the least with which a pair whose share of equal tokens is ``threshold`` meets
   in some node of level ``max_depth`` with probability ``target_recall``; pairs that are more similar, or part of smaller nodes, meet more surely.
   The first ``depth`` levels need no knowledge of other documents and are computed
   where the document is. Nodes that then hold more than ``leaf`` documents branch on, level by level, up to ``max_depth``; nodes that a sample shows
   to be hot do so before anything is shuffled.
3. Small nodes are compared exhaustively on one bit of each minwise token (another bit in each tree), generously; a spanning forest of
   what passes gives coarse clusters, a superset of the result found in any tree.
4. Within each coarse cluster the full signatures decide: documents are linked when at least ``threshold`` of their minwise
   tokens agree, and the connected components of these links are the groups. No pair, partner or candidate
   is capped; a hot group of copies costs little, as members already reached aren't compared again.

A task never holds more than ``leaf`` documents of a node or cluster. Larger ones that can't branch any more are linked in tiles (``tiled_edges``): by
chunks, then the chunks' representatives, and then the documents outside the largest component against all others, tile by tile.

Defined results: a document without any word (null, empty, only punctuation) is alone in its group. Of a group the lowest
id stays. Rows that share an id are one document: it appears once in the result and its rows' partners are joined; of such rows
``keep_one`` keeps the one with the lowest text. A null id is
alone, one row for each such row. A text of fewer words than ``shingle`` is one shingle. Empty tables give an empty result.
Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import again, dispose, key_join, map_arrow, text_buffer, written
from loomgraph.llm.components import connected_components
from loomgraph.llm.textvec import mix, shingles, word_hashes

SIG_SCHEMA = "doc_id bigint, h1 bigint, h2 bigint, sig binary"


@dataclass(frozen=True)
class MinHashParams:
    """``sample`` bounds the documents on which hot nodes are looked for, ``hot_share`` is the share of them from which a node is hot; neither changes the result's meaning."""

    threshold: float = 0.55
    shingle: int = 2
    n_hashes: int = 128
    target_recall: float = 0.95
    branch_at: float = 0.6
    depth: int = 3
    leaf: int = 4096
    max_depth: int = 5
    sample: int = 20_000
    hot_share: float = 0.005
    seed: int = 5

    @property
    def trees(self) -> int:
        """Trees for ``target_recall`` at the threshold: a branching process in which each equal token is selected with 1 / (branch_at * n_hashes)."""
        lost = 0.0
        for _ in range(self.max_depth):
            lost = (1 - (1 - lost) / (self.branch_at * self.n_hashes)) ** (self.threshold * self.n_hashes)
        return max(1, ceil(log(1 - self.target_recall) / log(lost)))


def _coefficients(p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return rng.integers(0, 1 << 32, p.n_hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, p.n_hashes, dtype=np.uint64).astype(np.uint32)


def signature(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 16-bit minwise token for each hash function."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (sh >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        m = np.multiply.outer(x[i : i + 512], a)
        m += b
        np.minimum(low, m.min(axis=0), out=low)
    low = low * np.uint32(0x85EBCA6B)
    low ^= low >> np.uint32(15)
    return ((low * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.uint16)


def sketches(docs: DataFrame, p: MinHashParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SIG_SCHEMA: a 128-bit hash of the shingle sequence and the minwise tokens; both null for a text without words."""

    def run(it):
        a, b = _coefficients(p)
        for batch in it:
            raw, offs = text_buffer(batch.column(text_col), lower=True)
            h1, h2, sig = ([None] * batch.num_rows for _ in range(3))
            for k, words in word_hashes(raw, offs):
                if len(words):
                    sh = shingles(words, p.shingle)
                    n = np.arange(1, len(words) + 1, dtype=np.uint64)
                    h1[k], h2[k] = (int(np.bitwise_xor.reduce(mix(words + n * c)).view(np.int64)) for c in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)))
                    sig[k] = signature(sh, a, b).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "h1", "h2", "sig"])

    return map_arrow(docs.select(id_col, text_col), run, SIG_SCHEMA)


def _branch(nodes: np.ndarray, owner: np.ndarray, keys: np.ndarray, p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, document) rows: keys[document] are the hashed (function, token) pairs."""
    cut = np.uint64(int(2**64 / (p.branch_at * p.n_hashes)))
    out_n, out_o = [], []
    for i in range(0, len(nodes), 4096):
        h = keys[owner[i : i + 4096]] ^ nodes[i : i + 4096, None]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        r, c = np.nonzero(h < cut)
        out_n.append(mix(h[r, c] + np.uint64(0x632BE59BD9B4E019)))
        out_o.append(owner[i : i + 4096][r])
    return (np.concatenate(out_n), np.concatenate(out_o)) if out_n else (nodes, owner)


def _sigs(col: pa.Array, p: MinHashParams) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, p.n_hashes)


def _keys(sig: np.ndarray, p: MinHashParams) -> np.ndarray:
    return mix(sig.astype(np.uint64) + (np.arange(p.n_hashes, dtype=np.uint64) << np.uint64(16)) + np.uint64(p.seed << 40))


def _bits(sig: np.ndarray, tree: int) -> np.ndarray:
    """One bit of each minwise token, another in each of 16 trees, packed: (n, n_hashes / 64) words."""
    return np.ascontiguousarray(np.packbits((sig >> np.uint16(tree % 16) & 1).astype(np.uint8), axis=1)).view(np.uint64)


#: ``x`` is what documents are compared by: bits in nodes, signatures in clusters. ``level`` -1: to be linked in tiles.
ROW = "node bigint, level int, doc_id bigint, x binary"
_NAMES = ["node", "level", "doc_id", "x"]


def _packed(x: np.ndarray) -> pa.Array:
    w = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(w), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _in(nodes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which nodes are among the sorted ``some``."""
    if not len(some):
        return np.zeros(len(nodes), bool)
    at = np.searchsorted(some, nodes)
    at[at == len(some)] = 0
    return some[at] == nodes


def _leaves(tree: int, keys: np.ndarray, p: MinHashParams, hot: np.ndarray):
    """(nodes, levels, owners) of a block of documents in one tree; hot nodes have branched on, those of the last level have level -1."""
    owner = np.arange(len(keys))
    nodes = np.full(len(keys), mix(np.array([tree + 1], np.uint64))[0])
    for _ in range(p.depth):
        nodes, owner = _branch(nodes, owner, keys, p)
    out = []
    for level in range(p.depth, p.max_depth + 1):
        own = _in(nodes, hot)
        out.append((nodes[~own], np.full((~own).sum(), level, np.int32), owner[~own]))
        nodes, owner = nodes[own], owner[own]
        if level < p.max_depth and len(nodes):
            nodes, owner = _branch(nodes, owner, keys, p)
    out.append((nodes, np.full(len(nodes), -1, np.int32), owner))
    return tuple(np.concatenate(c) for c in zip(*out))


def hot_nodes(sigs: DataFrame, p: MinHashParams) -> np.ndarray:
    """Sorted nodes, of levels depth to max_depth, that hold at least ``hot_share`` of a bounded sample (and enough of it to tell)."""
    every = max(1, -(-sigs.count() // p.sample))
    some = sigs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("sig")  # about ``sample`` of them, wherever they are
    least = max(20, int(p.hot_share * p.sample))

    def run(it):
        for b in it:
            keys = _keys(_sigs(b.column("sig"), p), p)
            for tree in range(p.trees):
                nodes, owner = np.full(len(keys), mix(np.array([tree + 1], np.uint64))[0]), np.arange(len(keys))
                for level in range(1, p.max_depth + 1):
                    nodes, owner = _branch(nodes, owner, keys, p)
                    if level >= p.depth and len(nodes):
                        u, n = np.unique(nodes, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["node", "n"])

    found = map_arrow(some, run, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["node"] for r in found.select("node").collect()], np.int64).view(np.uint64))  # few: their counts add up to a bounded number


def _first_levels(sigs: DataFrame, p: MinHashParams, hot: np.ndarray) -> DataFrame:
    shared = sigs.sparkSession.sparkContext.broadcast(hot)

    def run(it):
        for b in it:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                sig = _sigs(part.column("sig"), p)
                keys, ids = _keys(sig, p), part.column("doc_id").to_numpy()
                for tree in range(p.trees):
                    nodes, level, owner = _leaves(tree, keys, p, shared.value)
                    if len(nodes):
                        yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(level), pa.array(ids[owner]), _packed(_bits(sig, tree)[owner])], names=_NAMES)

    return map_arrow(sigs.select("doc_id", "sig"), run, ROW)


def _next_level(rows: DataFrame, sigs: DataFrame, p: MinHashParams) -> DataFrame:
    """Branch rows of large nodes once more; their signatures are joined by id."""

    def run(it):
        for b in it:
            if b.num_rows:
                nodes, owner = _branch(b.column("node").to_numpy().view(np.uint64), np.arange(b.num_rows), _keys(_sigs(b.column("sig"), p), p), p)
                pick = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(b.column("level").to_numpy()[owner] + np.int32(1)), b.column("doc_id").take(pick), b.column("x").take(pick)], names=_NAMES)

    return map_arrow(rows.select(*_NAMES).join(sigs.select("doc_id", "sig"), "doc_id"), run, ROW)


def _alike(kind: str, p: MinHashParams):
    """(type and number of the numbers of a packed row, function (row or rows, rows) -> mask): the coarse test on bits, or the final one on signatures."""
    if kind == "sig":
        need = int(np.ceil(p.threshold * p.n_hashes - 1e-9))
        return np.uint16, p.n_hashes, lambda one, many: (many == one).sum(axis=1) >= need
    agree = (1 + p.threshold) / 2
    most = p.n_hashes - int(p.n_hashes * (agree - 2.5 * np.sqrt(agree * (1 - agree) / p.n_hashes)))
    return np.uint64, p.n_hashes // 64, lambda one, many: np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int32) <= most


def _numbers(col: pa.Array, kind: str, p: MinHashParams) -> np.ndarray:
    dtype, width, _ = _alike(kind, p)
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, width)


def _forest(n: int, similar) -> tuple[list[int], list[int]]:
    """Spanning forest edges of a graph of ``n`` vertices; similar(i, others) -> mask. Vertices already reached aren't compared again."""
    rest, src, dst = np.arange(n), [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = similar(i, rest)
            if hit.any():
                found = rest[hit]
                src += [int(i)] * len(found)
                dst += found.tolist()
                queue += found.tolist()
                rest = rest[~hit]
    return src, dst


FOUND = "a bigint, b bigint, node bigint, level int, x binary"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("node", pa.int64()), ("level", pa.int32()), ("x", pa.binary())])


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    ne = a != b
    e = np.unique(np.stack([np.minimum(a, b)[ne], np.maximum(a, b)[ne]], 1), axis=0) if ne.any() else np.zeros((0, 2), np.int64)
    n = len(e)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_FOUND)


def _compare(rows: DataFrame, p: MinHashParams, kind: str) -> DataFrame:
    """FOUND: edges (a, b) of a spanning forest of each node's alike pairs; the rows of nodes of more than ``leaf`` rows come back as they are, with
    their document in ``a`` and no ``b``, and so do rows of level -1. A task sees a node as a run of sorted rows and holds ``leaf`` of them at most."""
    alike = pairs = _alike(kind, p)[2]

    def back(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.nulls(b.num_rows, pa.int64()), b.column("node"), b.column("level"), b.column("x")], schema=_FOUND)

    def solve(parts: list[pa.RecordBatch]):
        b = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        node, ids = b.column("node").to_numpy(), b.column("doc_id").to_numpy()
        own = _numbers(b.column("x"), kind, p)
        start = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node))
        size = np.diff(start)
        two = start[:-1][size == 2]  # most nodes with company hold two documents: all of these at once
        ok = pairs(own[two], own[two + 1])
        a_out, b_out = [ids[two[ok]]], [ids[two[ok] + 1]]
        for k in np.flatnonzero(size > 2):
            s = start[k]
            if size[k] > p.leaf:
                yield back(b.slice(s, size[k]))
                continue
            mine = own[s : s + size[k]]
            src, dst = _forest(int(size[k]), lambda i, r, mine=mine: alike(mine[i], mine[r]))
            a_out.append(ids[s + np.array(src, np.int64)])
            b_out.append(ids[s + np.array(dst, np.int64)])
        yield _edge_batch(np.concatenate(a_out), np.concatenate(b_out))

    def run(it):
        held: list[pa.RecordBatch] = []  # the last node so far; empty once it is known to be too large
        last, n = None, 0
        for b in it:
            if (hot := b.column("level").to_numpy() < 0).any():
                yield back(b.filter(pa.array(hot)))
                b = b.filter(pa.array(~hot))
            if not b.num_rows:
                continue
            node = b.column("node").to_numpy()
            cut = np.flatnonzero(node[1:] != node[:-1]) + 1
            at = 0
            if node[0] == last:
                at = int(cut[0]) if len(cut) else len(node)
                n += at
                held.append(b.slice(0, at))
                if n > p.leaf:
                    yield from map(back, held)
                    held = []
                if at == len(node):
                    continue
            tail = int(cut[-1]) if len(cut) else 0
            whole = held + ([b.slice(at, tail - at)] if tail > at else [])
            if whole:
                yield from solve(whole)
            last, n, held = node[-1], len(node) - tail, [b.slice(tail)]
            if n > p.leaf:
                yield from map(back, held)
                held = []
        if held:
            yield from solve(held)

    # nodes known to be hot only pass through, spread over many partitions
    spread = F.when(F.col("level") < 0, F.pmod(F.xxhash64("doc_id"), F.lit(64))).otherwise(F.lit(0).cast("bigint"))
    return map_arrow(rows.select(*_NAMES).repartition("node", spread).sortWithinPartitions("node"), run, FOUND)


def tiled_edges(rows: DataFrame, p: MinHashParams, kind: str) -> DataFrame:
    """Edges (a, b) whose components are, in every node of ``rows``, those of all its alike pairs; no task holds more than about two chunks of ``leaf`` documents.

    A: forests within the chunks of a node. B: forests of the representatives of the chunks' components, where a node has at most ``leaf`` of them. C: the
    documents that are then outside the node's largest component are compared with all its documents of other components, chunk by chunk. With copies, hot or not, B leaves few for C."""
    alike = _alike(kind, p)[2]
    rows = written(rows.select("node", "doc_id", "x"), "tiles-rows")
    sizes = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / p.leaf).cast("int").alias("chunks"))
    cut = rows.join(sizes, "node").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    label_schema = pa.schema([("node", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("doc_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary())])

    def label(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        ids, own = table.column("doc_id").to_numpy(), _numbers(table.column("x").combine_chunks(), kind, p)
        src, dst = _forest(len(ids), lambda i, r: alike(own[i], own[r]))
        root = np.arange(len(ids))
        for s, d in zip(src, dst):  # in the order of discovery: s already has its root
            root[d] = root[s]
        return pa.Table.from_arrays([*(table.column(c) for c in ("node", "chunk", "chunks", "doc_id")), pa.array(ids[root]), table.column("x")], schema=label_schema)

    inner = written(cut.groupBy("node", "chunk").applyInArrow(label, "node bigint, chunk int, chunks int, doc_id bigint, label bigint, x binary"), "tiles-inner")
    dispose(rows)
    edges = inner.where("label != doc_id").select(F.col("label").alias("a"), F.col("doc_id").alias("b"))
    reps = inner.where("label = doc_id").select("node", F.lit(0).alias("level"), "doc_id", "x")
    joined = written(_compare(reps, p, kind).where("b is not null").select("a", "b"), "tiles-reps")
    edges = edges.unionByName(joined)
    # components inside each node: the same document may be in several nodes, so vertices are (node, label)
    local = inner.select("node", "label").distinct().withColumn("vertex", F.xxhash64("node", "label"))
    ends = joined.select("a", "b").distinct()
    both = local.select("node", F.col("label").alias("a"), F.col("vertex").alias("va")).join(ends, "a").join(local.select("node", F.col("label").alias("b"), F.col("vertex").alias("vb")), ["node", "b"])
    parts = connected_components(both.select(F.col("va").alias("a"), F.col("vb").alias("b")))
    part = inner.withColumn("vertex", F.xxhash64("node", "label")).join(parts.withColumnRenamed("doc_id", "vertex"), "vertex", "left").select("node", "chunk", "chunks", "doc_id", "x", F.coalesce("cluster", "vertex").alias("part"))
    part = written(part, "tiles-parts")
    counts = part.groupBy("node", "part").count()
    main = counts.groupBy("node").agg(F.max(F.struct("count", "part"))["part"].alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    open_ = written(main.where("n > most").select("node", "main", F.ceil((F.col("n") - F.col("most")) / p.leaf).cast("int").alias("tiles")), "tiles-open")
    if open_.isEmpty():
        return edges
    left = part.join(open_, "node").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    right = again(part).join(again(open_), "node").where("part != main").withColumn("tile", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("tiles")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def cross(many: pa.Table, few: pa.Table) -> pa.Table:
        if not many.num_rows or not few.num_rows:
            return schema.empty_table()
        (ids, parts, own), (fi, fp, fx) = ((t.column("doc_id").to_numpy(), t.column("part").to_numpy(), _numbers(t.column("x").combine_chunks(), kind, p)) for t in (many, few))
        a, b, linked = [], [], {}  # components already joined here

        def root(v):
            while linked.setdefault(v, v) != v:
                v = linked[v]
            return v

        for i in range(len(fi)):
            hit = np.flatnonzero(alike(fx[i], own) & (parts != fp[i]))
            for k in hit[np.unique(parts[hit], return_index=True)[1]]:
                x, y = root(int(fp[i])), root(int(parts[k]))
                if x != y:
                    linked[x] = y
                    a.append(fi[i])
                    b.append(ids[k])
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    cols = ["node", "chunk", "tile", "doc_id", "part", "x"]
    outer = left.select(cols).groupBy("node", "chunk", "tile").cogroup(right.select(cols).groupBy("node", "chunk", "tile")).applyInArrow(cross, "a bigint, b bigint")
    return edges.unionByName(outer)


def node_edges(rows: DataFrame, p: MinHashParams, kind: str, sigs: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between alike documents of the same node of ``rows`` (ROW), large nodes included; ``sigs`` lets these branch on first."""
    edges = tiles = None
    while True:
        found = written(_compare(rows, p, kind), "minhash-found")
        now = found.where("b is not null").select("a", "b")
        edges = now if edges is None else edges.unionByName(now)
        big = found.where("b is null").select("node", "level", F.col("a").alias("doc_id"), "x")
        n = {(r["level"] < 0 or r["level"] >= p.max_depth or sigs is None): r["count"] for r in big.groupBy("level").count().collect()}
        branching = (F.col("level") >= 0) & (F.col("level") < p.max_depth) if sigs is not None else F.lit(False)
        if n.get(True):
            last = big.where(~branching)
            tiles = last if tiles is None else tiles.unionByName(last)
        if not n.get(False):
            break
        rows = _next_level(big.where(branching), sigs, p)
    return edges if tiles is None else edges.unionByName(tiled_edges(tiles, p, kind))


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, is_kept) for every document of ``docs``."""
    sk = written(sketches(docs, p, id_col, text_col), "minhash-sketches")
    some = sk.where("h1 is not null and doc_id is not null")
    reps = written(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "minhash-reps")
    sigs = reps.select(F.col("rep").alias("doc_id"), "sig")
    rows = _first_levels(sigs, p, hot_nodes(sigs, p))
    edges = written(node_edges(rows, p, "bits", sigs).distinct(), "minhash-edges")
    coarse = connected_components(edges)  # doc_id, cluster
    members = coarse.join(sigs, "doc_id").select(F.col("cluster").alias("node"), F.lit(0).alias("level"), "doc_id", F.col("sig").alias("x"))
    links = node_edges(members, p, "sig")
    # every id's representatives: several where its rows have different texts, which joins these
    ids = sk.where("doc_id is not null")
    named = ids.where("h1 is not null").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep")
    named = named.unionByName(ids.where("h1 is null").select("doc_id", F.lit(None).cast("bigint").alias("rep")))
    named = written(named.distinct(), "minhash-named")
    low = named.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    same = named.join(low.where("rep != other").select("doc_id", F.col("rep").alias("low")), "doc_id").where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    final = connected_components(links.where("a != b").unionByName(same))
    out = low.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).join(final.withColumnRenamed("doc_id", "rep"), "rep", "left")
    out = out.select("doc_id", F.coalesce("cluster", "rep").alias("group_id"))
    out = out.unionByName(sk.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("group_id")))
    return out.withColumn("is_kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))


def keep_one(docs: DataFrame, p: MinHashParams = MinHashParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one document of each group, with all their columns; of rows that share an id one stays."""
    gone = written(near_duplicates(docs, p, id_col, text_col).where("not is_kept").select(F.col("doc_id").alias("_gone")), "minhash-gone")
    keys = gone.withColumnRenamed("_gone", id_col)
    repeated = written(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "minhash-repeated")
    kept = key_join(docs, keys, id_col, "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    # of rows that share an id the one with the lowest text (then any order of its other columns that can be sorted) stays
    rest = [c for c in docs.columns if c not in (id_col, text_col) and docs.schema[c].dataType.typeName() != "map"]
    whole = F.struct(F.col(text_col).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.struct(*docs.columns).alias("row"))
    once = key_join(kept, repeated, id_col, "left_semi").groupBy(F.col(id_col).alias("_key")).agg(F.min(whole)["row"].alias("_row")).select("_row.*")
    return key_join(kept, repeated, id_col, "left_anti").select(docs.columns).unionByName(once)
