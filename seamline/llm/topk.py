"""Exact top-k search by inner product with norm buckets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of one length bucket.
BUCKET = 2048
#: Bytes of query vectors that are broadcast at once; further queries are taken in further blocks.
BLOCK_BYTES = 8 << 20
#: From this local cosine threshold on, coordinates are tested before products are taken.
COORDINATE_FROM = 0.7
#: Coordinates that are tested.
FOCUS = 4
#: Rows that a task gathers before it sorts them by length.
RUN = 1 << 17
SLACK = 1e-9


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; in float64 as long as they are exact there, else in Python's integers."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)))
    if float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2**53:
        return q @ v.T
    return q.astype(object) @ np.array([[int(x) for x in r] for r in v], object).T


class Best:
    """The k best of each query so far, by score and then by smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.floor = np.full(n, -np.inf)
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            kth = np.partition(scores.astype(np.float64), len(scores) - self.k)[len(scores) - self.k]
            near = scores >= kth - abs(kth) * 1e-12
            scores, ids = scores[near], ids[near]
        rows = self.rows[q] + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
        rows.sort()
        self.rows[q] = rows = rows[: self.k]
        if len(rows) == self.k:
            self.floor[q] = -rows[-1][0]


def search(best: Best, q_ids: np.ndarray, q: np.ndarray, q_norm: np.ndarray, ids: np.ndarray, v: np.ndarray, bucket: int = BUCKET) -> None:
    """Add candidates v to best. Buckets come in order of falling length.

    A query's k-th best score, over its length and that of the bucket, is the cosine that a candidate
    needs. Above 1 the bucket is left out. If it is high, each of the query's largest coordinates
    leaves a range for the candidate's, and only candidates inside all ranges are verified; else
    candidates too short for the score are left out.
    """
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-norm, kind="stable")
    ids, v, norm = ids[order], v[order], norm[order]
    unit_q = q / np.where(q_norm == 0, 1, q_norm)[:, None]
    focus = np.argsort(-np.abs(unit_q), 1)[:, : min(FOCUS, q.shape[1])]
    for a in range(0, len(ids), bucket):
        b_ids, b_v, b_norm = ids[a : a + bucket], v[a : a + bucket], norm[a : a + bucket]
        longest = b_norm[0]
        reach = q_norm * longest
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(reach > 0, best.floor / reach, np.where(best.floor > 0, np.inf, -np.inf))
        alive = need <= 1 + SLACK
        if longest > 0:
            unit = b_v / np.where(b_norm == 0, 1, b_norm)[:, None]
            for i in np.flatnonzero(alive & (need >= COORDINATE_FROM)):
                # the cosine that the bucket's longest vector needs is the least that any of it needs
                t = min(1.0, need[i])
                keep = np.ones(len(b_ids), bool)
                angle = np.arccos(np.clip(t, -1, 1))
                for f in focus[i]:
                    # a vector within `angle` of the query is within it of the query's own angle to the axis
                    own = np.arccos(np.clip(unit_q[i, f], -1, 1))
                    keep &= unit[:, f] >= np.cos(min(np.pi, own + angle)) - 1e-7
                    keep &= unit[:, f] <= np.cos(max(0.0, own - angle)) + 1e-7
                keep &= b_norm * q_norm[i] >= best.floor[i] * (1 - SLACK)
                keep &= b_ids != q_ids[i]
                if keep.any():
                    scores = exact(q[i : i + 1], b_v[keep])[0]
                    best.take(i, scores, b_ids[keep])
        plain = np.flatnonzero(alive & ~(need >= COORDINATE_FROM)) if longest > 0 else np.flatnonzero(alive)
        if len(plain):
            all_scores = exact(q[plain], b_v)
            for i, scores in zip(plain, all_scores, strict=True):
                keep = (scores >= best.floor[i]) & (b_ids != q_ids[i])
                if keep.any():
                    best.take(i, scores[keep], b_ids[keep])


def _matrix(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bounds, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def by_dimension(ids: list[int], vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        groups.setdefault(len(v), []).append(i)
    return {d: (np.array([ids[i] for i in rows], np.int64), np.floor(1024.0 * np.array([vectors[i] for i in rows], np.float64).reshape(len(rows), d))) for d, rows in groups.items()}


def candidates(batches: Iterator[pa.RecordBatch], queries: dict, k: int) -> Iterator[pa.RecordBatch]:
    """The best of this task's vectors for each query of a block; queries and vectors of unlike dimension don't meet."""
    best = {d: Best(len(ids), k) for d, (ids, _) in queries.items()}
    norms = {d: np.sqrt((q**2).sum(1)) for d, (_, q) in queries.items()}
    held_ids: list[int] = []
    held: list[np.ndarray] = []

    def flush() -> None:
        for d, (ids, v) in by_dimension(held_ids, held).items():
            if d in queries:
                search(best[d], queries[d][0], queries[d][1], norms[d], ids, v)
        held_ids.clear()
        held.clear()

    for batch in batches:
        held_ids += batch.column(0).to_pylist()
        held += _matrix(batch.column(1))
        if len(held) >= RUN:
            flush()
    flush()
    for d, (ids, _) in queries.items():
        rows = [(int(q), i, max(-(1 << 63), min((1 << 63) - 1, -s))) for q, r in zip(ids, best[d].rows, strict=True) for s, i in r]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])


def query_blocks(queries: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[dict]:
    """Query vectors in blocks of bounded size, one at a time on the driver."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []
    size = 0
    for row in queries.toLocalIterator():
        ids.append(row[0])
        vectors.append(np.array(row[1], np.float64))
        size += 8 * len(row[1]) + 64
        if size >= limit:
            yield by_dimension(ids, vectors)
            ids, vectors, size = [], [], 0
    if ids:
        yield by_dimension(ids, vectors)


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each query row (vec_id divisible by `every`) its k largest integer inner products with all other rows.

    Components are floor(1024 * x). Vectors are dealt by length, so that a task holds a range of
    lengths and equal vectors are spread; each task keeps k rows a query, which are then merged.
    Null, empty-id or non-finite vectors take no part; vectors meet those of equal dimension alone.
    Ties go to the smaller vec_id. A score outside a long's range is its end, after the ranking inside a
    task; between tasks such scores are ties. Repeated rows come each; an empty table gives an empty
    result; other columns are ignored. Rows that share the query's vec_id count as its own.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # dealt by length; vec_id splits runs of equal lengths
    dealt = rows.withColumn("__length", length).repartitionByRange(F.desc("__length"), F.asc("vec_id")).select("vec_id", "embedding")
    parts = []
    for block in query_blocks(rows.where(F.col("vec_id") % every == 0), block_bytes):
        shared = spark.sparkContext.broadcast(block)
        parts.append(dealt.mapInArrow(lambda b, s=shared: candidates(b, s.value, k), "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
