"""Language identification: nearest of several clustered centroids per language, with rejection by distance.

Fit: a bounded sample of documents per language (``per_language``, lowest hashes of the ids) gives TF-IDF
weights of hashed letter trigrams; spherical k-means makes ``clusters`` centroids per language. Short texts
lie farther from any centroid, so the largest accepted distance is fitted for each length class (the number
of letter trigrams, by powers of two): the similarity that all but ``quantile`` of examples of such lengths
reach, times ``slack``, must be reached. Centroids and decisions rest on whole texts. The examples are the sampled
texts as they are and, of each, one piece of every length in ``piece_chars`` that it exceeds, from a place that a hash of the text names; all count alike.

Defined results: a null or empty text, or one without three letters in a row, has no vector; its language
is null and it is rejected. Ties go to the language that comes first in alphabetical order. Documents whose language is
null don't take part in the fit; of rows that share an id and a language the fit takes the lowest text. Repeated rows are each
classified. Null ids are classified, but not fitted on. Without any usable document all are rejected. Only the id, text and language
columns are looked at, so others may have any name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import filtered, key_join, map_arrow, text_buffer, written
from loomgraph.llm.quality import counts_frame, dense
from loomgraph.llm.textvec import LETTERS, idf_of, ngram_counts, tfidf

SCHEMA = "doc_id bigint, language string, similarity double, distance double, max_distance double, is_kept boolean"
CLASSES = 24


@dataclass(frozen=True)
class LangParams:
    """``per_language`` bounds the sample that the centroids are fitted on; ``piece_chars`` are the lengths of the pieces that the rejection is calibrated on."""

    per_language: int = 600
    dim: int = 4096
    clusters: int = 4
    quantile: float = 0.001
    slack: float = 0.7
    piece_chars: tuple[int, ...] = (20, 40, 80, 160, 320, 640, 1280, 2560, 5120, 10_240)
    seed: int = 11


@dataclass
class LangModel:
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    languages: list[str]
    max_distance: np.ndarray
    params: LangParams


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), CLASSES - 1)


def _counts(texts: pa.Array, dim: int):
    raw, offs = text_buffer(texts, lower=True)
    return ngram_counts(raw, offs, dim, LETTERS)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means with farthest-first seeds."""
    c = [x[rng.integers(len(x))]]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin((x @ np.array(c).T).max(axis=1))])
    c = np.array(c)
    for _ in range(15):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def fit(docs: DataFrame, params: LangParams = LangParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel | None:
    """Fit on at most ``per_language`` documents of each language; None where no document has both language and text."""
    # one row for each id and language first: a repeated id takes one place of the sample, and the sample stays bounded
    ids = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).where("_lang is not null and _id is not null").distinct()
    rank = F.row_number().over(W.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    chosen = written(ids.withColumn("_r", rank).where(F.col("_r") <= params.per_language).select("_id", "_lang"), "langid-chosen")
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(F.col("_text").isNotNull())
    sample = written(key_join(picked, chosen, ["_id", "_lang"], "left_semi").groupBy("_id", "_lang").agg(F.min("_text").alias("_text")), "langid-sample")
    rows = counts_frame(sample, "_id", "_text", ["_lang"], params.dim, LETTERS, lower=True).collect()
    rows = sorted((r for r in rows if len(r["counts"])), key=lambda r: (r["_lang"], r["_id"], bytes(r["counts"])))
    if not rows:
        return None
    x = dense([r["counts"] for r in rows], params.dim)
    idf = idf_of(x)
    x = tfidf(x, idf)
    lang = np.array([r["_lang"] for r in rows])
    languages, rng = sorted(set(lang)), np.random.default_rng(params.seed)
    cents = [_kmeans(x[lang == g], params.clusters, rng) for g in languages]
    model = LangModel(idf, np.concatenate(cents).astype(np.float32), np.repeat(np.arange(len(cents)), [len(y) for y in cents]), languages, np.ones(CLASSES), params)
    model.max_distance = _calibrate(sample, model)
    return model


def _calibrate(sample: DataFrame, model: LangModel) -> np.ndarray:
    """Largest accepted distance of each length class, from the sampled texts and pieces of them."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = shared.value
        for b in it:
            texts = [(t, zlib.crc32(t.encode())) for t in b.column("_text").to_pylist() if t]
            for size in (*m.params.piece_chars, None):
                if size is None:
                    parts = [t for t, _ in texts]
                else:
                    parts = [t[(at := h % (len(t) - size)) : at + size] for t, h in texts if len(t) > size]
                for _, _, c in _counts(pa.array(parts, pa.string()), m.params.dim):
                    n = c.sum(axis=1)
                    near = (tfidf(c, m.idf) @ m.centroids.T).max(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(length_class(n)[n > 0], pa.int32()), pa.array(near[n > 0].astype(np.float64))], names=["k", "s"])

    rows = map_arrow(sample.select("_text"), run, "k int, s double").collect()
    near = [np.array([r["s"] for r in rows if r["k"] == k]) for k in range(CLASSES)]
    low = np.array([np.quantile(s, model.params.quantile) if len(s) >= 20 else np.nan for s in near])
    ok = np.flatnonzero(~np.isnan(low))
    if not len(ok):
        return np.full(CLASSES, 0.999)
    low = low[ok[np.abs(np.arange(CLASSES)[:, None] - ok[None, :]).argmin(axis=1)]]  # classes without examples: as the nearest that has some
    return 1 - np.maximum(low * model.params.slack, 0.001)


def _classify(model: LangModel, texts: pa.Array):
    out = []
    for _, _, m in _counts(texts, model.params.dim):
        n = m.sum(axis=1)
        sim = tfidf(m, model.idf) @ model.centroids.T
        best = sim.argmax(axis=1)  # centroids are in the order of the languages: the first of equals wins
        out.append((model.owner[best], np.round(sim.max(axis=1).astype(np.float64), 6), model.max_distance[length_class(n)], n > 0))
    own, sim, far, some = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 4
    return own, sim, far, some.astype(bool)


def identify(docs: DataFrame, model: LangModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: SCHEMA. ``language`` is that of the nearest centroid, null where rejected."""
    if model is None:
        return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("language"), *[F.lit(None).cast("double").alias(c) for c in ("similarity", "distance", "max_distance")], F.lit(False).alias("is_kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for b in it:
            m = shared.value
            own, sim, far, some = _classify(m, b.column(text_col))
            keep = some & (1 - sim <= far)
            names = pa.array(m.languages, pa.string()).take(pa.array(own, pa.int64(), mask=~keep))
            none = pa.array(~some)
            num = lambda v: pc.if_else(none, pa.scalar(None, pa.float64()), pa.array(v, pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), names, num(sim), num(1 - sim), num(far), pa.array(keep)], names=["doc_id", "language", "similarity", "distance", "max_distance", "is_kept"])

    return map_arrow(docs.select(id_col, text_col), run, SCHEMA)


def keep_known(docs: DataFrame, model: LangModel | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns; one pass, no shuffle."""
    if model is None:
        return docs.where(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(b):
        _, sim, far, some = _classify(shared.value, b.column(text_col))
        return some & (1 - sim <= far)

    return filtered(docs, keep)
