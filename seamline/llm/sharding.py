"""Sharding over a hierarchical weighted hash tree of regions, racks and shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.llm.common import fresh

#: Shards of a rack and racks of a region.
RACK, REGION = 5, 2
#: Fixed number of blocks that a shard is numbered in.
BLOCKS = 1024
#: Points of a region with gaps that are looked at; with one shard in ten, none is taken with a probability of 2e-12.
POINTS = 256


def tree(shards: int, rack: int = RACK, region: int = REGION) -> list[list[list[int]]]:
    """Regions of racks of shards, filled in order of the shard number."""
    racks = [list(range(i, min(i + rack, shards))) for i in range(0, shards, rack)]
    return [racks[i : i + region] for i in range(0, len(racks), region)]


def _hash(key: Column, node: str, point: Column) -> Column:
    return F.md5(F.concat(key, F.lit(f"/{node}/"), point.cast("string")))


def _number(digest: Column, at: int, digits: int) -> Column:
    """Hexadecimal digits of a digest, from 0 to 1."""
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("double") / float(16**digits)


def _wait(digest: Column, weight: float) -> Column:
    """An exponential draw with rate `weight`; the least of several wins in proportion to its weight."""
    return -F.log(_number(digest, 1, 12) + 2.0**-48) / F.lit(float(weight))


def _descend(digest: Column, region: int) -> Column:
    """Down from a region: a draw for the rack, another for the shard in it."""
    rack = F.floor(_number(digest, 13, 8) * REGION)
    return (F.lit(region * REGION * RACK) + rack * RACK + F.floor(_number(digest, 21, 8) * RACK)).cast("int")


def _first_point(key: Column, region: int, weights: dict[int, float], bound: Column) -> Column:
    """(t, shard) of a region's first point, up to `bound`, that falls on a shard it has: a point of each shard is taken with the probability of its weight, up to 1."""
    size = REGION * RACK
    if all(weights.get(s, 0.0) >= 1.0 for s in range(region * size, (region + 1) * size)):
        digest = _hash(key, f"g{region}", F.lit(1))
        return F.struct(_wait(digest, size).alias("t"), _descend(digest, region).alias("shard"))
    taken = F.create_map(*[F.lit(x) for s, w in sorted(weights.items()) if s // size == region for x in (s, min(w, 1.0))])
    none = F.lit(-1)

    def step(state: Column, point: Column) -> Column:
        def look(digest: Column) -> Column:
            shard = _descend(digest, region)
            fits = _number(digest, 29, 4) < F.coalesce(F.element_at(taken, shard), F.lit(0.0))
            return F.struct((state["t"] + _wait(digest, size)).alias("t"), F.when(fits, shard).otherwise(none).alias("shard"))

        # the digest is computed once
        return F.when((state["shard"] >= 0) | (state["t"] > bound), state).otherwise(F.transform(F.array(_hash(key, f"g{region}", point)), look)[0])

    found = F.aggregate(F.sequence(F.lit(1), F.lit(POINTS)), F.struct(F.lit(0.0).alias("t"), none.alias("shard")), step)
    return F.struct(F.when(found["shard"] >= 0, found["t"]).otherwise(float("inf")).alias("t"), found["shard"].alias("shard"))


def place(df: DataFrame, key: str, shards: int, out: str, weights: Sequence[float] | None = None) -> DataFrame:
    """Add the shard of each row, down the tree from region to rack to shard.

    A region draws points in time at the rate of all its places, whether they are filled or not; at each
    point a draw chooses the rack and another the shard in it. The region whose first point on a shard
    that exists comes first wins, so regions win in proportion to the weights below them. A full region
    draws once. Weight over 1 is a further draw of its shard, weight under 1 leaves points out. A shard
    that is added, or made heavier, only takes points that nobody had or that came later, so rows
    move into it and nowhere else; one that is removed or made lighter gives rows away and nothing else
    moves. A null key is a key of its own. Weights of 0 are left out.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    if shards < 1 or len(weights) != shards or min(weights) < 0 or not sum(weights):
        raise ValueError("one weight of 0 or more a shard, and one above 0, are needed")
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    held = {s: float(w) for s, w in enumerate(weights) if w > 0}
    size = REGION * RACK
    regions = sorted({s // size for s in held})
    full = [g for g in regions if all(held.get(s, 0.0) >= 1.0 for s in range(g * size, (g + 1) * size))]
    never = F.lit(float("inf"))
    draws = [_first_point(text, g, held, never) for g in full]
    draws += [F.struct(_wait(_hash(text, f"s{s}", F.lit(1)), w - 1.0).alias("t"), F.lit(s).alias("shard")) for s, w in held.items() if w > 1]
    best = F.least(*draws) if len(draws) > 1 else draws[0] if draws else F.struct(never.alias("t"), F.lit(-1).alias("shard"))
    (name,) = fresh(df, "__best")
    df = df.withColumn(name, best)
    for g in regions:
        if g not in full:
            # a later point than the best so far can't win
            df = df.withColumn(name, F.least(F.col(name), _first_point(text, g, held, F.col(name)["t"])))
    return df.withColumn(out, F.when(F.col(name)["t"] < never, F.col(name)["shard"]).otherwise(min(held)).cast("int")).drop(name)


def numbered(df: DataFrame, shard: str, key: str, order: Sequence[str], out: str = "slot", blocks: int = BLOCKS) -> DataFrame:
    """Number the rows of each shard from 0 without a gap, and without gathering a shard in one task.

    A row's block is a hash of its key and of all columns of the order, so that rows of one key, or of
    none, are spread unless they are alike. Rows are ranked inside (shard, block); the rows of the blocks
    before come from a count table of at most shards * blocks rows.
    """
    block, s, b, n, skip, rank = fresh(df, "__block", "__s", "__b", "__n", "__before", "__rank")
    named = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in dict.fromkeys([key, *order])])
    df = df.withColumn(block, F.pmod(F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int"))
    counts = df.groupBy(F.col(shard).alias(s), F.col(block).alias(b)).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(s, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(skip))
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(shard, block).orderBy(*order)))
    joined = ranked.join(F.broadcast(offsets), (F.col(shard) == F.col(s)) & (F.col(block) == F.col(b)))
    return joined.withColumn(out, (F.col(rank) - 1 + F.col(skip)).cast("long")).drop(block, s, b, skip, rank)


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Shard, slot and shard after growth by one for each document, by the law `key`: doc_id and shard count decide.

    Rows with equal doc_id, and all with a null doc_id, share a shard. A null text counts as empty.
    Repeated rows keep a slot each. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    # both placements share the draws of the regions they have in common
    rows = place(place(rows, "doc_id", shards, "shard"), "doc_id", shards + 1, "grown_shard")
    return numbered(rows, "shard", "doc_id", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
