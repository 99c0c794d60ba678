"""Embedding queue and exact semantic search. Vectors come as DataFrames or from an injected embedder; nothing calls a network."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import symbol_text
from loomgraph.functions.vector import dot

SKIPPED_KINDS = ("const", "module", "var")


def embed_queue(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, text, rank) of nodes without a vector yet, most important first; constants, variables and modules are left out."""
    todo = nodes.where(~F.col("kind").isin(*SKIPPED_KINDS)).join(chunks.select(F.col("node_id").alias("id")), "id", "left_anti")
    return todo.select("id", symbol_text(F.col("kind"), F.col("qname"), F.col("signature"), F.col("name"), F.col("doc")).alias("text"), "rank").orderBy(F.desc("rank"), "id")


def embed(queue: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 96) -> DataFrame:
    """Chunks of a queue by an injected embedder, in batches; vectors of unequal width in a batch are refused."""

    def run(it):
        for b in it:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vecs = embedder(part.column("text").to_pylist())
                if len({len(v) for v in vecs}) > 1 or len(vecs) != part.num_rows:
                    raise ValueError("the embedder returned vectors of unequal width or number")
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(v) for v in vecs], pa.int32()), pa.array(vecs, pa.list_(pa.float32()))], names=["node_id", "dim", "vector"])

    return queue.select("id", "text").mapInArrow(run, "node_id bigint, dim int, vector array<float>")


def semantic_search(chunks: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(node_id, score): the ``k`` largest cosines over all vectors; a zero vector scores 0. The query is a literal; only top rows leave a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col("vector")
    den = F.sqrt(dot(v, v)) * F.lit(sum(x * x for x in query) ** 0.5)
    return chunks.select("node_id", F.when(den > 0, dot(v, q) / den).otherwise(F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def pack_vector(vector: Column) -> Column:
    """Little-endian float32 bytes of a vector."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return pack(vector)


def unpack_vector(raw: Column) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return unpack(raw)


def check_embedding_config(provider: str | None, model: str | None, dim: int | None, base_url: str | None = None) -> None:
    """A ValueError that names every problem of an embedding configuration at once."""
    wrong = []
    if provider not in ("voyage", "openai", "local"):
        wrong.append(f"provider {provider!r} is none of voyage, openai, local")
    if not model:
        wrong.append("no model is named")
    if dim is not None and (not isinstance(dim, int) or dim <= 0):
        wrong.append(f"dim {dim!r} is no positive number")
    if provider == "local" and not base_url:
        wrong.append("a local provider needs base_url")
    if wrong:
        raise ValueError("; ".join(wrong))
