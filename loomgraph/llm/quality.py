"""Quality classifier: similarity-weighted vote of the nearest labelled documents in a latent-semantic space.

Fit: a bounded, class-balanced sample of labelled documents (``max_labelled``, lowest hashes of the ids)
gives the weights of hashed byte trigrams, a truncated SVD and the labelled vectors. These have a fixed
size, whatever the corpus, and are broadcast. Score: every document's whole text becomes a vector, and its
cosines with all labelled vectors are computed exactly in blocks; the ``k`` nearest vote.

Defined results: a null or empty text, or one of fewer than three bytes, has no vector, hence no
neighbours: score null, kept. Neighbours tied with the k-th all vote. A labelled document never votes on
itself. Labels that are null are ignored; an id labelled twice counts once, with its lower label; of labelled rows that share an id
the lowest text is fitted on. Repeated rows are each scored. Null ids are scored. Ids are integers: any other type raises a TypeError at once.
Without labels of both classes all scores are null and all documents are kept. An empty table gives an empty result.
Columns other than the id and the text are never looked at, so their names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import filtered, integer_id, map_arrow, text_buffer
from loomgraph.llm.textvec import idf_of, ngram_counts, tfidf

SCHEMA = "doc_id bigint, score double, top_similarity double, n_votes int, is_kept boolean"


@dataclass(frozen=True)
class QualityParams:
    """``max_labelled`` bounds the sample that the classifier is fitted on; documents whose score is under ``reject_below`` are rejected."""

    max_labelled: int = 4096
    dim: int = 4096
    rank: int = 64
    k: int = 15
    reject_below: float = 0.35
    seed: int = 7


@dataclass
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    params: QualityParams


def counts_frame(docs: DataFrame, id_col: str, text_col: str, extra: list[str], dim: int, table=None, lower: bool = False) -> DataFrame:
    """Rows (extra..., counts) of hashed n-gram counts as sparse bytes, for the fits."""

    def run(it):
        for b in it:
            raw, offs = text_buffer(b.column(text_col), lower)
            out = []
            for _, _, m in ngram_counts(raw, offs, dim, table):
                for row in m:
                    nz = np.flatnonzero(row).astype(np.int32)
                    out.append(nz.tobytes() + row[nz].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in [id_col, *extra]] + [pa.array(out, pa.binary())], names=[id_col, *extra, "counts"])

    cols = docs.select(id_col, *extra, text_col)
    return map_arrow(cols, run, ", ".join(f"`{c}` {cols.schema[c].dataType.simpleString()}" for c in [id_col, *extra]) + ", counts binary")


def dense(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.float32)
    for i, r in enumerate(rows):
        n = len(r) // 8
        out[i, np.frombuffer(r, np.int32, n)] = np.frombuffer(r, np.float32, n, 4 * n)
    return out


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    """Fit on at most ``max_labelled`` labelled documents, as many good as bad where there are enough; None without both classes."""
    integer_id(docs, id_col), integer_id(labels, id_col)
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_y")).where(F.col(id_col).isNotNull() & F.col("_y").isin(0, 1))
    known = known.groupBy(id_col).agg(F.min("_y").alias("_y"))
    half = params.max_labelled // 2
    order = [F.xxhash64(id_col), F.col(id_col)]
    chosen = known.where("_y = 0").orderBy(*order).limit(half).unionByName(known.where("_y = 1").orderBy(*order).limit(half))
    # at most max_labelled rows come out of this, however often an id is repeated
    picked = docs.select(id_col, F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()).join(F.broadcast(chosen), id_col).groupBy(id_col, "_y").agg(F.min("_text").alias("_text"))
    rows = counts_frame(picked, id_col, "_text", ["_y"], params.dim).collect()
    first = {r[id_col]: r for r in sorted(rows, key=lambda r: r[id_col]) if len(r["counts"])}
    if len({r["_y"] for r in first.values()}) < 2:
        return None
    x = dense([r["counts"] for r in first.values()], params.dim)
    idf = idf_of(x)
    x = tfidf(x, idf)
    rank = min(params.rank, len(x))
    q = np.random.default_rng(params.seed).standard_normal((params.dim, rank + 16)).astype(np.float32)
    for _ in range(4):  # randomised subspace iteration for the leading right singular vectors
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = np.ascontiguousarray((q @ vt[:rank].T).astype(np.float32))
    v = unit(x @ basis)
    return QualityModel(idf, basis, v, np.array([r["_y"] for r in first.values()], np.float32), np.array(list(first), np.int64), params)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def vote(model: QualityModel, vecs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, best similarity, votes) of each vector; NaN where a vector is zero or nothing is similar."""
    sim = vecs @ model.vectors.T
    at = np.searchsorted(model.sorted_ids, ids)
    at[at == len(model.sorted_ids)] = 0
    hit = np.flatnonzero(model.sorted_ids[at] == ids)
    sim[hit, model.order[at[hit]]] = -2
    k = min(model.params.k, sim.shape[1])
    kth = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
    r, c = np.nonzero((sim >= kth[:, None]) & (sim > 0))
    w = sim[r, c].astype(np.float64)
    n = len(vecs)
    total = np.bincount(r, w, n)
    with np.errstate(invalid="ignore"):
        score = np.bincount(r, w * model.labels[c], n) / total
    zero = ~vecs.any(axis=1)
    score[zero] = np.nan
    return score, np.where(np.isnan(score), np.nan, sim.max(axis=1)), np.where(np.isnan(score), 0, np.bincount(r, minlength=n))


def _score_batch(model: QualityModel, b: pa.RecordBatch, id_col: str, text_col: str):
    if not hasattr(model, "order"):
        model.order = np.argsort(model.ids, kind="stable")
        model.sorted_ids = model.ids[model.order]
    raw, offs = text_buffer(b.column(text_col), lower=False)
    ids = b.column(id_col).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = [vote(model, unit(tfidf(m, model.idf) @ model.basis), ids[i:j].copy()) for i, j, m in ngram_counts(raw, offs, model.params.dim, None)]
    score, top, n = (np.concatenate(x) if parts else np.zeros(0) for x in (zip(*parts) if parts else ((), (), ())))
    score, top = np.round(score, 6), np.round(top, 5)
    return score, top, n, ~(score < model.params.reject_below)


def _broadcast(docs: DataFrame, model: QualityModel | None):
    return docs.sparkSession.sparkContext.broadcast(model) if model else None


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: SCHEMA."""
    integer_id(docs, id_col)
    if model is None:
        return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("top_similarity"), F.lit(0).alias("n_votes"), F.lit(True).alias("is_kept"))
    shared = _broadcast(docs, model)

    def run(it):
        for b in it:
            s, top, n, keep = _score_batch(shared.value, b, id_col, text_col)
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), pa.array(s, pa.float64(), from_pandas=True), pa.array(top, pa.float64(), from_pandas=True), pa.array(n.astype(np.int32)), pa.array(keep)], names=["doc_id", "score", "top_similarity", "n_votes", "is_kept"])

    return map_arrow(docs.select(id_col, text_col), run, SCHEMA)


def keep_good(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns; one pass, no shuffle."""
    integer_id(docs, id_col)
    if model is None:
        return docs
    shared = _broadcast(docs, model)
    return filtered(docs, lambda b: _score_batch(shared.value, b, id_col, text_col)[3])
