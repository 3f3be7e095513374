"""Vectors of chunks and exact nearest-neighbour search over them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMENSIONS = 256
QUERY_BLOCK = 8192


def embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A deterministic bag-of-words vector of length one: a word's MD5 gives its place (first four bytes) and sign (last bit of the fifth).

    Words are runs between blanks, A-Z in lower case. Each word of a batch is hashed once.
    """

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        own = list(set().union(*split))
        hashed = np.frombuffer(b"".join(hashlib.md5(w, usedforsecurity=False).digest()[:5] for w in own), np.uint8).reshape(-1, 5).astype(np.int64)
        at, sign = (hashed[:, :4] << np.array([24, 16, 8, 0])).sum(axis=1) % dimensions, 1 - 2 * (hashed[:, 4] & 1)
        place = dict(zip(own, range(len(own)), strict=True))
        sizes = np.array([len(ws) for ws in split], dtype=np.int64)
        words = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        key = np.repeat(np.arange(len(split)), sizes) * dimensions + at[words]
        out = np.bincount(key, sign[words], len(split) * dimensions).reshape(-1, dimensions)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return pd.Series(list((out / np.where(norm == 0, 1, norm)).astype(np.float32)))

    return vectors(text)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles of length one; zero vectors stay zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[list, list]]:
    ids, vectors = [], []
    for r in queries.toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == size:
            yield ids, vectors
            ids, vectors = [], []
    if ids:
        yield ids, vectors


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", where: Column | None = None, digits: int = 6) -> DataFrame:
    """(query_id, neighbor_id, similarity, rank): the k rows of largest cosine for each query, itself left out.

    Queries go out in blocks of bounded size; every task keeps its own k best for each
    query, so only tasks * k rows a query are shuffled. ``where`` filters rows by their
    metadata before any vector is compared. Ties go to the smaller key.
    """
    rows = rows.where(F.col(vector).isNotNull())
    rows = (rows if where is None else rows.where(where)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector)
    found = rows.sparkSession.createDataFrame([], "query_id long, neighbor_id long, similarity double")
    for ids, vectors in _blocks(asked, QUERY_BLOCK):
        block = rows.sparkSession.sparkContext.broadcast((np.array(ids), _matrix(pa.array(vectors, pa.list_(pa.float32())))))
        found = found.unionByName(rows.mapInArrow(_nearest(block, k, digits), "query_id long, neighbor_id long, similarity double"))
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _nearest(block, k: int, digits: int):
    def nearest(batches):
        query_ids, wanted = block.value
        ids, close = np.empty((len(query_ids), 0), np.int64), np.empty((len(query_ids), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("id").to_numpy()
            near = np.round(wanted @ _matrix(batch.column("v")).T, digits)
            near[query_ids[:, None] == own[None, :]] = -np.inf
            ids, close = np.hstack([ids, np.broadcast_to(own, near.shape)]), np.hstack([close, near])
            keep = np.lexsort((ids, -close), axis=1)[:, :k]
            ids, close = np.take_along_axis(ids, keep, 1), np.take_along_axis(close, keep, 1)
        real = np.isfinite(close)
        asked = np.broadcast_to(query_ids[:, None], close.shape)[real]
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ids[real]), pa.array(close[real])], names=["query_id", "neighbor_id", "similarity"])

    return nearest
