"""Hierarchical packing of documents into context windows of several sizes.

Documents longer than the largest tier are cut into full windows and a rest; every piece is routed to the smallest tier
that holds it. Packing rests on the histogram of piece lengths, whose size depends on the largest window
only, never on the corpus: from the longest tier down, pieces of a length go, best fit first, into the smallest gap that
holds them, then into new windows; when a tier's own pieces are placed, its gaps are filled from the shorter
tiers, longest pieces first, before these are packed themselves. The plan is a short list of runs (pieces k0..k1 of length n go to windows
w0.. at offset o), and a piece finds its run by its number among the pieces of its length: executors do that in parallel, from
counts by (length, shard). Windows of a tier, from fullest to emptiest, are dealt to step groups to and fro, so that the groups of a tier
have nearly equal numbers of tokens; a group has ``step_tokens`` tokens' worth of windows.

Lengths are token counts by the byte-level vocabulary, over whole texts, plus one end token each. Defined results: a null or empty text has nothing to pack and gives no
row. Repeated rows are packed once each, in turn. Null ids are packed too. Ties between windows go to the one that has had that gap for longer. An empty table gives an empty result. Only the
id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import map_arrow, written
from loomgraph.llm.tokens import TOKENIZERS, encode, rank_path

SCHEMA = "doc_id bigint, piece int, token_from bigint, n_tokens int, tier int, window_id bigint, window_offset int, step_group bigint"


@dataclass(frozen=True)
class PackingParams:
    tiers: tuple[int, ...] = (512, 2048, 8192, 32768)
    step_tokens: int = 262_144
    shards: int = 64
    tokenizers: str = TOKENIZERS


@dataclass
class Plan:
    """Runs sorted by (length, k0), and per tier the number of windows and their order by fill."""

    length: np.ndarray
    k0: np.ndarray
    k1: np.ndarray
    tier: np.ndarray
    w0: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    fill_w0: dict[int, np.ndarray]
    fill_rank: dict[int, np.ndarray]
    windows: dict[int, int]


class _Gaps:
    """Ranges of windows [w0, w0 + n) by the gap they have left."""

    def __init__(self):
        self.sizes: list[int] = []
        self.of: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, w0: int, n: int) -> None:
        if gap not in self.of:
            bisect.insort(self.sizes, gap)
            self.of[gap] = []
        self.of[gap].append((w0, n))

    def take(self, gap: int) -> tuple[int, int]:
        got = self.of[gap].pop(0)
        if not self.of[gap]:
            del self.of[gap]
            self.sizes.pop(bisect.bisect_left(self.sizes, gap))
        return got

    def smallest(self, need: int) -> int | None:
        i = bisect.bisect_left(self.sizes, need)
        return self.sizes[i] if i < len(self.sizes) else None

    def largest(self) -> int:
        return self.sizes[-1] if self.sizes else 0


def make_plan(histogram: dict[int, int], tiers: tuple[int, ...]) -> Plan:
    """Plan for ``histogram[length] = pieces``, all lengths in 1..max(tiers)."""
    tiers = tuple(sorted(tiers))
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)  # pieces of a length placed so far
    runs: list[tuple[int, int, int, int, int, int, int]] = []
    fills: dict[int, _Gaps] = {}
    windows: dict[int, int] = {}

    def place(n: int, count: int, tier: int, w0: int, each: int, offset: int) -> None:
        runs.append((n, used[n], used[n] + count, tier, w0, each, offset))
        used[n] += count
        left[n] -= count

    for at in range(len(tiers) - 1, -1, -1):
        cap, low = tiers[at], tiers[at - 1] if at else 0
        gaps, new = _Gaps(), 0
        fills[cap] = gaps
        lengths = sorted((n for n, c in left.items() if c and n <= cap), reverse=True)
        for n in lengths:
            while left[n]:
                gap = gaps.smallest(n)
                if gap is None:
                    if n <= low:
                        break  # a shorter tier's piece: fills gaps, but opens no window here
                    each = cap // n
                    full, rest = divmod(left[n], each)
                    if full:
                        place(n, full * each, cap, new, each, 0)
                        gaps.add(cap - each * n, new, full)
                        new += full
                    if rest:
                        place(n, rest, cap, new, rest, 0)
                        gaps.add(cap - rest * n, new, 1)
                        new += 1
                    continue
                w0, m = gaps.take(gap)
                each = gap // n
                full, rest = divmod(min(left[n], m * each), each)
                if full:
                    place(n, full * each, cap, w0, each, cap - gap)
                    gaps.add(gap - each * n, w0, full)
                if rest:
                    place(n, rest, cap, w0 + full, rest, cap - gap)
                    gaps.add(gap - rest * n, w0 + full, 1)
                keep = m - full - (1 if rest else 0)
                if keep:
                    gaps.add(gap, w0 + m - keep, keep)
        windows[cap] = new
    runs.sort()
    cols = [np.array(c, np.int64) for c in zip(*runs)] if runs else [np.zeros(0, np.int64)] * 7
    fill_w0, fill_rank = {}, {}
    for cap, gaps in fills.items():
        ranges, rank = [], 0
        for gap in gaps.sizes:  # fullest first
            for w0, n in sorted(gaps.of[gap]):
                ranges.append((w0, rank))
                rank += n
        ranges.sort()
        fill_w0[cap] = np.array([r[0] for r in ranges], np.int64)
        fill_rank[cap] = np.array([r[1] for r in ranges], np.int64)
    return Plan(*cols, fill_w0, fill_rank, windows)


def locate(plan: Plan, length: np.ndarray, k: np.ndarray, step_tokens: int) -> tuple[np.ndarray, ...]:
    """(tier, window, offset, step group) of piece number ``k`` of its ``length``."""
    if not len(length):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    # runs are sorted by (length, k0): the last one at or before (length, k)
    lo = np.searchsorted(plan.length, length, "left")
    hi = np.searchsorted(plan.length, length, "right")
    while True:  # bisect all rows at once
        mid = (lo + hi) // 2
        go = hi - lo > 1
        if not go.any():
            break
        right = plan.k0[np.minimum(mid, len(plan.k0) - 1)] <= k
        lo = np.where(go & right, mid, lo)
        hi = np.where(go & ~right, mid, hi)
    r = lo
    i = k - plan.k0[r]
    window = plan.w0[r] + i // plan.each[r]
    offset = plan.offset[r] + i % plan.each[r] * length
    tier = plan.tier[r]
    group = np.zeros(len(k), np.int64)
    for cap, n in plan.windows.items():
        own = tier == cap
        if own.any():
            f = np.searchsorted(plan.fill_w0[cap], window[own], "right") - 1
            rank = plan.fill_rank[cap][f] + window[own] - plan.fill_w0[cap][f]
            groups = max(1, -(-n * cap // step_tokens))
            row, pos = np.divmod(rank, groups)
            group[own] = np.where(row % 2 == 0, pos, groups - 1 - pos)
    return tier, window, offset, group


def piece_lengths(docs: DataFrame, params: PackingParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, token_from, n_tokens, shard): the pieces of every document with a text."""
    path, top, shards = rank_path(params.tokenizers), max(params.tiers), params.shards

    def run(it):
        for b in it:
            n = np.array([len(encode(path, t)) + 1 if t else 0 for t in b.column(text_col).to_pylist()], np.int64)
            pieces = -(-n // top)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(n[row] - piece * top, top)
            ids = b.column(id_col).cast(pa.int64()).take(pa.array(row))
            key = ids.fill_null(-1).to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            run = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, int)
            nth = np.empty(len(key), np.int64)
            nth[order] = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))
            shard = (key * 0x9E3779B1 + nth) % shards  # rows that share an id, or have none, are spread too
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(piece * top), pa.array(size, pa.int32()), pa.array(shard, pa.int32())], names=["doc_id", "piece", "token_from", "n_tokens", "shard"])

    return map_arrow(docs.select(id_col, text_col), run, "doc_id bigint, piece int, token_from bigint, n_tokens int, shard int")


def pack(docs: DataFrame, params: PackingParams = PackingParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: where every piece of every document goes. ``window_id`` counts within its tier; so does ``step_group``."""
    spark = docs.sparkSession
    pieces = written(piece_lengths(docs, params, id_col, text_col), "packing-pieces")
    # at most max(tiers) x shards rows, whatever the corpus
    counts = pieces.groupBy("n_tokens", "shard").count().toPandas().sort_values(["n_tokens", "shard"])
    counts["base"] = counts.groupby("n_tokens")["count"].cumsum() - counts["count"]
    plan = make_plan(counts.groupby("n_tokens")["count"].sum().to_dict(), params.tiers)
    base = np.zeros((max(params.tiers) + 1, params.shards), np.int64)
    base[counts["n_tokens"], counts["shard"]] = counts["base"]
    shared = spark.sparkContext.broadcast((plan, base))
    step = params.step_tokens

    def run(it):
        plan, base = shared.value
        for b in it:
            n = b.column("n_tokens").to_numpy().astype(np.int64)
            k = base[n, b.column("shard").to_numpy()] + b.column("k").to_numpy()
            tier, window, offset, group = locate(plan, n, k, step)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "token_from", "n_tokens")), pa.array(tier, pa.int32()), pa.array(window), pa.array(offset, pa.int32()), pa.array(group)], names=["doc_id", "piece", "token_from", "n_tokens", "tier", "window_id", "window_offset", "step_group"])

    k = (F.row_number().over(W.partitionBy("n_tokens", "shard").orderBy("doc_id", "piece")) - 1).cast("bigint").alias("k")
    return map_arrow(pieces.select("doc_id", "piece", "token_from", "n_tokens", "shard", k), run, SCHEMA)
