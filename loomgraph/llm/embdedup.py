"""Embedding near-dedup: int8 tile products with rigorous bounds, full precision only where the bounds can't decide.

Each vector is scaled to length 1 and rounded to int8 with a scale of its own, once; |x - sq| is kept as its error e. For two vectors
|x.y - st(q.r)| <= e|tr| + f|sq| + e f, so the integer product, which is exact, gives a lower and an upper bound of the cosine. Pairs whose lower bound reaches
``threshold`` are links, those whose upper bound doesn't are none, and only those between are computed again in float64. No
link is lost and none is invented.

1. Vectors that are equal entry by entry collapse to the lowest id and a weight.
2. Every vector goes to the cell of the nearest of at most ``pivots`` sampled vectors, and every cell is cut by hash into tiles of
   about ``tile`` vectors. A tile is one row of packed arrays in the shared folder: ids, weights, int8 vectors, scales, error norms, float32 vectors, and
   the least and greatest angle of its vectors to every pivot. Links inside the tile are found where it is packed.
3. The pairs of tiles are numbered, and tasks take runs of numbers: they read the two tiles from the shared folder, so nothing is
   shuffled and no list of pairs exists. If the angles to some pivot differ by more than the threshold's angle, no pair of
   vectors can be a link (the triangle inequality) and the products are left out.
4. A tile pair gives the number of links of each vector, and of its components of links only a spanning forest between those that were already known
   inside the tiles: a hot group of near copies costs a few edges a tile pair. Connected components of these edges are the classes.

The number of tile products is quadratic in the number of distinct vectors that can't be told apart by angles to pivots: the method is exhaustive by design.

Defined results: one row for every id. Null vectors, vectors with null, NaN or infinite entries and zero vectors have no cosine: they are classes of their own
without links; vectors of different lengths (numbers of entries) are never linked. Of rows that share an id the lowest vector counts. Rows with a
null id are left out. An empty table gives an empty result. Only the id and vector columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import dispose, map_arrow, remove, scratch, slots, written
from loomgraph.llm.components import connected_components

SCHEMA = "vec_id bigint, class_id bigint, n_links bigint"

#: Tile pairs that one task takes at most.
PAIRS_A_TASK = 2048


@dataclass(frozen=True)
class EmbeddingParams:
    """``pivots`` bounds the sampled vectors that the tiles are arranged by; the result doesn't depend on them."""

    threshold: float = 0.95
    tile: int = 4096
    block: int = 512
    pivots: int = 256


def usable(v: F.Column) -> F.Column:
    """Whether a column of vectors has a direction: not null, no null, NaN or infinite entry, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def units(col: pa.Array, dim: int) -> np.ndarray:
    """Float64 unit vectors of a column of usable vectors of one length."""
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 vectors, scale, error norm, norm of the rounded vector) of float64 unit vectors; the norms are rounded up."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top, 1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    approx = q * scale[:, None]
    up = 1 + 1e-12
    return q, scale, np.linalg.norm(x - approx, axis=1) * up + 1e-14, np.linalg.norm(approx, axis=1) * up


class Tile:
    """One tile's arrays. ``x`` (float32 vectors as given, made float64 units on demand) is called for only if pairs are undecided."""

    def __init__(self, ids, q, scale, err, norm, weight, x):
        self.ids, self.q, self.scale, self.err, self.norm, self.weight, self._x = ids, q, scale, err, norm, weight, x
        self._units = None

    @property
    def units(self) -> np.ndarray:
        if self._units is None:
            x = self._x().astype(np.float64)
            self._units = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._units


def linked(a: Tile, b: Tile, threshold: float, block: int):
    """(first row, boolean links[block, rows of b], pairs recomputed) for blocks of rows of ``a``."""
    wide = a.q.shape[1] * 127 * 127 >= 1 << 24  # integer products below 2**24 are exact in float32
    kind = np.float64 if wide else np.float32
    fb = b.q.astype(kind).T
    margin = 1e-5  # more than the rounding of the few float32 operations below, on numbers of about 1
    for i in range(0, len(a.q), block):
        s = slice(i, i + block)
        mid = (a.q[s].astype(kind) @ fb) * np.multiply.outer(a.scale[s], b.scale).astype(np.float32)
        slack = np.multiply.outer(a.err[s], b.norm + b.err).astype(np.float32)
        slack += np.multiply.outer(a.norm[s], b.err).astype(np.float32)
        maybe = mid + slack >= threshold - margin
        if not maybe.any():
            yield i, maybe, 0
            continue
        sure = mid - slack >= threshold + margin
        r, c = np.nonzero(maybe & ~sure)
        for k in range(0, len(r), 65_536):
            x, y = r[k : k + 65_536], c[k : k + 65_536]
            sure[x, y] = np.einsum("ij,ij->i", a.units[x + i], b.units[y]) >= threshold
        yield i, sure, len(r)


def self_links(t: Tile, threshold: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, weighted number of links) of each vector of a tile; the label is the lowest row of its component."""
    label, count = np.arange(len(t.ids)), np.zeros(len(t.ids), np.int64)
    for i, m, _ in linked(t, t, threshold, block):
        rows = np.arange(len(m))
        m[rows, rows + i] = False
        count[i : i + len(m)] = m @ t.weight
        for r in np.flatnonzero(m.any(axis=1)):
            roots = np.unique(np.append(label[m[r]], label[r + i]))
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    return label, count


def forest(m: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a bipartite graph given as a boolean matrix."""
    label, out = np.arange(m.shape[1]), []
    for r in np.flatnonzero(m.any(axis=1)):
        cols = np.flatnonzero(m[r])
        roots, first = np.unique(label[cols], return_index=True)
        out += [(int(r), int(cols[k])) for k in first]
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    return out


def cross_links(a: Tile, b: Tile, label_a: np.ndarray, label_b: np.ndarray, threshold: float, block: int):
    """(links of a's vectors, links of b's, spanning edges between components) of two tiles."""
    na, nb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    met = np.zeros((len(a.ids), len(b.ids)), bool)
    for i, m, _ in linked(a, b, threshold, block):
        if m.any():
            na[i : i + len(m)] += m @ b.weight
            nb += a.weight[i : i + len(m)] @ m
            r, c = np.nonzero(m)
            met[label_a[r + i], label_b[c]] = True
    return na, nb, forest(met)


def apart(lo_a, hi_a, lo_b, hi_b, angle: float) -> bool:
    """Whether the angles to some pivot prove that no pair of vectors of the two tiles is within ``angle``."""
    return bool(((lo_b > hi_a + angle) | (lo_a > hi_b + angle)).any())


def pair_at(k: int, n: int) -> tuple[int, int]:
    """The k-th pair (i, j), i < j < n, in the order of (i, j)."""
    m = n * (n - 1) // 2 - 1 - k  # counted from the end, the last row has one pair, the one before two, ...
    row = (isqrt(8 * m + 1) - 1) // 2
    i = n - 2 - row
    return i, n - 1 - (m - row * (row + 1) // 2)


FOUND = "a bigint, b bigint, n bigint"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _counts(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some])], schema=_FOUND)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=_FOUND)


def classes(vectors: DataFrame, params: EmbeddingParams = EmbeddingParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """SCHEMA: for each id its class (the lowest id that a chain of links reaches) and the number of ids that it is linked with directly."""
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null")
    base = written(base.groupBy("id").agg(F.min("v").alias("v")), "embeddings")
    reps = written(base.where(usable(F.col("v"))).groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "embeddings-distinct")
    found, tiles = _links(reps, params)
    out = base.select("id")
    if found is None:
        return out.select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    found = written(found, "embeddings-found")
    remove(base.sparkSession, tiles)
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    twins = reps.where("w > 1").select("v", F.col("id").alias("rep"), F.col("w").alias("w"))
    copies = base.join(twins, "v").select("id", "rep", "w")  # vectors travel here, but only to those that have twins
    out = out.join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce(F.col("w") - 1, F.lit(0)).alias("twins"))
    out = out.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(parts.withColumnRenamed("doc_id", "rep"), "rep", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("cluster", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("twins")).cast("bigint").alias("n_links"))


def _links(reps: DataFrame, p: EmbeddingParams) -> tuple[DataFrame | None, str]:
    """(FOUND: numbers of links (b null) and edges of a spanning graph (n null), folder of the tiles); None without vectors."""
    spark = reps.sparkSession
    sizes = {r["dim"]: r["count"] for r in reps.groupBy(F.size("v").alias("dim")).count().collect()}  # a row for each length of vectors
    if not sizes:
        return None, ""
    pivots = {}
    for dim, n in sizes.items():
        some = reps.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(min(p.pivots, -(-n // p.tile)))
        x = np.array([r["v"] for r in some.select("v").collect()], np.float64)
        pivots[dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(pivots)  # at most ``pivots`` vectors of each length

    def cells(it):
        for b in it:
            n = b.column("v").value_lengths().to_numpy()
            cell = np.zeros(b.num_rows, np.int32)
            for dim in np.unique(n):
                at = np.flatnonzero(n == dim)
                cell[at] = (units(b.column("v").take(pa.array(at)), int(dim)) @ shared.value[int(dim)].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("w"), b.column("v"), pa.array(n, pa.int32()), pa.array(cell)], names=["id", "w", "v", "dim", "cell"])

    placed = written(map_arrow(reps.select("id", "w", "v"), cells, "id bigint, w bigint, v array<float>, dim int, cell int"), "embeddings-cells")
    first, at = {}, dict.fromkeys(sizes, 0)  # the first tile and the number of tiles of each cell
    for r in sorted(placed.groupBy("dim", "cell").count().collect()):  # at most ``pivots`` rows of each length
        k = -(-r["count"] // p.tile)
        first[r["dim"], r["cell"]] = (at[r["dim"]], k)
        at[r["dim"]] += k
    where = spark.createDataFrame([(d, c, f, k) for (d, c), (f, k) in first.items()], "dim int, cell int, first int, k int")
    tiled = placed.join(F.broadcast(where), ["dim", "cell"]).select("dim", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("k"))).cast("int").alias("tile"), "id", "w", "v")
    threshold, block = p.threshold, p.block
    fields = ["ids", "weight", "q", "scale", "err", "norm", "x", "lo", "hi", "label", "count"]
    schema = pa.schema([("dim", pa.int32()), ("tile", pa.int32()), *[(c, pa.binary()) for c in fields]])

    def pack(keys, table):
        dim, tile = keys[0].as_py(), keys[1].as_py()
        table = table.sort_by("id").combine_chunks()
        v = table.column("v").combine_chunks()
        x = units(v, dim)
        ids, w = table.column("id").to_numpy(), table.column("w").to_numpy()
        raw = v.flatten().to_numpy().astype(np.float32)
        q, scale, err, norm = quantise(x)
        angle = np.arccos(np.clip(x @ shared.value[dim].T, -1, 1))
        t = Tile(ids, q, scale, err, norm, w, lambda: raw.reshape(-1, dim))
        label, count = self_links(t, threshold, block)
        cols = [ids, w, q, scale, err, norm, raw, angle.min(axis=0) - 1e-6, angle.max(axis=0) + 1e-6, label.astype(np.int32), count]
        return pa.Table.from_arrays([pa.array([dim], pa.int32()), pa.array([tile], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], schema=schema)

    folder = scratch(spark, "embeddings-tiles")
    packed = tiled.groupBy("dim", "tile").applyInArrow(pack, "dim int, tile int, " + ", ".join(f"{c} binary" for c in fields))
    packed.write.partitionBy("dim", "tile").parquet(folder)
    dispose(placed)

    def inner(it):
        for b in it:
            for ids, label, count in zip(*(b.column(c).to_pylist() for c in ("ids", "label", "count"))):
                ids, label = np.frombuffer(ids, np.int64), np.frombuffer(label, np.int32)
                yield _counts(ids, np.frombuffer(count, np.int64))
                own = np.flatnonzero(label != np.arange(len(label)))
                yield _edges(ids[label[own]], ids[own])

    found = map_arrow(spark.read.parquet(folder).select("ids", "label", "count"), inner, FOUND)
    pairs = {d: n * (n - 1) // 2 for d, n in at.items()}
    total = sum(pairs.values())
    if not total:
        return found, folder
    ends = np.cumsum(list(pairs.values()))
    dims, numbers = list(pairs), dict(at)
    angle = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def outer(it):
        files, root = fs.FileSystem.from_uri(folder)
        held: dict[tuple[int, int], tuple] = {}

        def load(dim, tile):
            if (dim, tile) not in held:
                if len(held) > 2:  # the row's own tile stays, the others change
                    held.pop(next(k for k in held if k != row))
                at = f"{root}/dim={dim}/tile={tile}"
                name = next(f.path for f in files.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))
                get = lambda *cols: [pq.read_table(name, columns=[c], filesystem=files, partitioning=None).column(0)[0].as_buffer() for c in cols]
                lo, hi = (np.frombuffer(x) for x in get("lo", "hi"))
                held[dim, tile] = [lo, hi, get, None]
            return held[dim, tile]

        def body(entry, dim):
            if entry[3] is None:
                ids, w, q, scale, err, norm, label = entry[2]("ids", "weight", "q", "scale", "err", "norm", "label")
                one = Tile(np.frombuffer(ids, np.int64), np.frombuffer(q, np.int8).reshape(-1, dim), np.frombuffer(scale), np.frombuffer(err), np.frombuffer(norm), np.frombuffer(w, np.int64), lambda: np.frombuffer(entry[2]("x")[0], np.float32).reshape(-1, dim))
                entry[3] = one, np.frombuffer(label, np.int32)
            return entry[3]

        row, mine, sums = None, None, None
        for b in it:
            for k in b.column("id").to_pylist():
                d = int(np.searchsorted(ends, k, "right"))
                dim = dims[d]
                i, j = pair_at(k - int(ends[d - 1] if d else 0), numbers[dim])
                if (dim, i) != row:
                    if sums is not None:
                        yield _counts(mine, sums)
                    row, sums = (dim, i), None
                ea, eb = load(dim, i), load(dim, j)
                if apart(ea[0], ea[1], eb[0], eb[1], angle):
                    continue
                (ta, la), (tb, lb) = body(ea, dim), body(eb, dim)
                na, nb, links = cross_links(ta, tb, la, lb, threshold, block)
                sums, mine = na if sums is None else sums + na, ta.ids
                if nb.any():
                    yield _counts(tb.ids, nb)
                if links:
                    x, y = np.array(links).T
                    yield _edges(ta.ids[x], tb.ids[y])
        if sums is not None:
            yield _counts(mine, sums)

    tasks = min(total, max(4 * slots(spark), -(-total // PAIRS_A_TASK)))
    return found.unionByName(map_arrow(spark.range(0, total, 1, tasks), outer, FOUND)), folder
