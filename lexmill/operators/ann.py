"""Inverted-file vector index: rows are put into lists by their nearest centroid, a query looks into the nearest lists.

Centroids are fitted on a bounded sample (``SAMPLE`` rows, the least by a hash of the key, so the same at every run);
every row is indexed. Written by list, a search reads only the lists that its queries probe. With all lists probed the
result is exact; ``recall`` measures any other setting against that.

Defined results: null and zero vectors are in no list; fewer rows than lists give fewer lists; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.retrieval import top_k

SAMPLE, ROUNDS = 20_000, 12


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def fit(vectors: DataFrame, lists: int, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Centroids (rows of length one) of a bounded sample by spherical k-means."""
    rows = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(x):
        return np.zeros((0, 0))
    x = _unit(x[np.linalg.norm(x, axis=1) > 0])
    # far-first start: the next centroid is the row least like those chosen
    chosen = [0]
    near = x @ x[0]
    for _ in range(min(lists, len(x)) - 1):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def assign(vectors: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Adds list_id to every row that can be searched."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf(T.IntegerType())
    def nearest(v: pd.Series) -> pd.Series:
        c = held.value
        out = []
        for x in v:
            ok = x is not None and len(c) and len(x) == c.shape[1] and np.linalg.norm(x) > 0
            out.append(int(np.argmax(c @ np.asarray(x, dtype=np.float64))) if ok else None)
        return pd.Series(out, dtype="Int32")

    return vectors.withColumn("list_id", nearest(vector)).where(F.col("list_id").isNotNull())


def search(indexed: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", block: int = 4096) -> DataFrame:
    """query_id, key, score (cosine, six places), rank among the lists probed."""
    spark = indexed.sparkSession
    kind = indexed.schema[key].dataType.simpleString()
    schema = f"query_id bigint, {key} {kind}, score double"
    out: DataFrame | None = None
    rows = queries.select(query_key, vector).where(F.col(vector).isNotNull()).toLocalIterator()
    while len(centroids) and (pending := [r for _, r in zip(range(block), rows, strict=False)]):
        ids = np.array([r[0] for r in pending], dtype=np.int64)
        q = _unit(np.array([r[1] for r in pending], dtype=np.float64))
        lists = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :probes]
        asks = {int(x): np.flatnonzero((lists == x).any(axis=1)) for x in np.unique(lists)}
        held = spark.sparkContext.broadcast((ids, q, asks))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q, asks = held.value
            for pdf in batches:
                for number, part in pdf.groupby("list_id"):
                    who = asks.get(int(number))
                    if who is None:
                        continue
                    sim = np.round(_unit(np.stack(part[vector].to_numpy()).astype(np.float64)) @ q[who].T, 6)
                    keys = part[key].to_numpy()
                    order = np.lexsort((keys[:, None].repeat(len(who), 1), -sim), axis=0)[: min(k, len(part))]
                    col = np.broadcast_to(np.arange(len(who)), order.shape).ravel()
                    flat = order.ravel()
                    yield pd.DataFrame({"query_id": ids[who[col]], key: keys[flat], "score": sim[flat, col]})

        # the lists probed are known here: the filter prunes folders of an index written by list
        got = indexed.where(F.col("list_id").isin(*asks)).select(key, vector, "list_id").mapInPandas(scan, schema)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    return top_k(out, k, "query_id", key)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """query_id, recall: share of the exact neighbours that were found."""
    hits = found.select("query_id", key, F.lit(1.0).alias("_hit"))
    return exact.select("query_id", key).join(hits, ["query_id", key], "left").groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))
