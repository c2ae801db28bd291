"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them. u > v holds for every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges that are contracted together.
EDGES = 1 << 17


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) in, of every EDGES of them a star for each component out: the same connections in fewer steps."""
    least: dict = {}

    def root(x):
        while (up := least.setdefault(x, x)) != x:
            least[x] = x = least[up]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, top) for x in list(least) if (top := root(x)) != x]
        least.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], names=["u", "v"])

    seen, kind = 0, None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            least[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= EDGES:
            seen = 0
            yield stars()
    if least:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge, root being the least node of its component.

    Columns u and v of edges may be of any type that can be ordered. Blocks of edges are contracted in
    place first. Each round is written to the shared folder; rounds end when no edge has changed, or
    when a single block holds all. Degrees are never gathered: minima are aggregated before they are
    shuffled, and joins on a hub may be split. `discard` deletes the result's files.
    """
    schema = edges.select("u", "v").schema
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(contract, schema), "edges")
    if edges.count() <= EDGES:
        # one block holds them all, and its stars are the components
        return _stars(edges, stored(edges.coalesce(1).mapInArrow(contract, schema), "edges"))
    mark = _mark(edges)
    while True:
        before, edges = edges, stored(_small_star(_large_star(edges)), "edges")
        discard(before)
        now = _mark(edges)
        if now == mark:
            return _stars(None, edges)
        mark = now


def _stars(before: DataFrame | None, edges: DataFrame) -> DataFrame:
    if before is not None:
        discard(before)
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    found.stored_at = edges.stored_at
    return found


def _mark(edges: DataFrame) -> tuple:
    """A digest of an edge set."""
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h), F.bit_xor(F.xxhash64("v", "u"))).first())
