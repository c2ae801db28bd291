"""Vectors: cosine similarity, nearest neighbours, codec, and embeddings that need no model."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of query vectors that go to every task at once.
BLOCK_BYTES = 8 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length, null where lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n > 1e-12, dot(a, b) / n).otherwise(0.0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """Exact k nearest (query_id, vec_id, score, rank) by cosine inside a scope column, if given.

    vectors has (vec_id, embedding), queries (query_id, embedding). Queries come in blocks of bounded
    size; each task keeps k rows a query before anything is shuffled.
    """
    types = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "vec_id"))]
    cols = ["query_id", "embedding"] + ([scope] if scope else [])
    out, block, size = None, [], 0

    def against(rows: list) -> DataFrame:
        ids = [r["query_id"] for r in rows]
        scopes = [r[scope] for r in rows] if scope else None
        q = np.array([r["embedding"] for r in rows], np.float64)
        length = np.linalg.norm(q, axis=1)
        q = q / np.where(length > 0, length, 1)[:, None]
        shared = vectors.sparkSession.sparkContext.broadcast((ids, scopes, q))

        def best(batches):
            ids, scopes, q = shared.value
            held: dict[int, list] = {}
            for pdf in batches:
                pdf = pdf[[v is not None and len(v) == q.shape[1] for v in pdf["embedding"]]]
                for a in range(0, len(pdf), 4096):
                    part = pdf.iloc[a : a + 4096]
                    v = np.array(part["embedding"].tolist(), np.float64)
                    n = np.linalg.norm(v, axis=1)
                    scores = (v / np.where(n > 0, n, 1)[:, None]) @ q.T
                    for j in range(q.shape[0]):
                        s, own = scores[:, j], part["vec_id"].to_numpy()
                        if scopes is not None:
                            same = part[scope].to_numpy() == scopes[j]
                            s, own = s[same], own[same]
                        place = np.unique(own, return_inverse=True)[1]
                        top = np.lexsort([place, -np.round(s, 9)])[:k]
                        rows = held.get(j, []) + list(zip((-np.round(s[top], 9)).tolist(), own[top].tolist(), s[top].tolist(), strict=True))
                        held[j] = sorted(rows)[:k]
            rows = [(ids[j], i, float(s)) for j, found in held.items() for _, i, s in found]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        return vectors.select("vec_id", "embedding", *([scope] if scope else [])).mapInPandas(best, f"query_id {types[0]}, vec_id {types[1]}, score double")

    for row in queries.select(*cols).toLocalIterator():
        block.append(row)
        size += 8 * len(row["embedding"]) + 64
        if size >= BLOCK_BYTES:
            out = against(block) if out is None else out.unionByName(against(block))
            block, size = [], 0
    if block:
        out = against(block) if out is None else out.unionByName(against(block))
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {types[0]}, vec_id {types[1]}, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def encode(vector: Column) -> Column:
    """A tagged blob of little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else b"F32\0" + np.asarray(v, "<f4").tobytes())

    return pack(vector)


def decode(blob: Column) -> Column:
    """Vectors from tagged blobs, plain floats, or JSON lists."""

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            if b[:4] == b"F32\0":
                return np.frombuffer(b[4:], "<f4")
            if b[:1] == b"[":
                return np.array(json.loads(b), "<f4")
            return np.frombuffer(b, "<f4")

        return blobs.map(one)

    return unpack(blob)


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """A unit vector fixed by the text alone: stands in for a model in tests and without a network."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            seed = int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).standard_normal(dimensions)
            return (v / np.linalg.norm(v)).astype(np.float32)

        return texts.map(one)

    return embed(text)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New vectors in place of old ones of the same key; empty vectors are left out."""
    fresh = new.where(F.size("embedding") > 0)
    return old.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)
