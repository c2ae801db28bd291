"""Near-duplicate detection with HyperMinHash sketches, banding, and verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.llm.common import NOT_SPACE, U64, BitFilter, apart, bit_filter, chunks, discard, mix, prefix_hashes, release, span_hashes, stored, word_hashes, word_spans
from seamline.llm.components import components

#: Words of a shingle, and the similarity of a link in hundredths.
WORDS, SIMILAR = 5, 75
#: Buckets of a sketch and registers of a band. A pair at 0.75 shares none of the 40 bands with probability (1 - 0.75^4)^40 < 1e-6.
BUCKETS, BAND = 160, 4
BANDS = BUCKETS // BAND
#: Sets of up to MOST_SMALL shingles have a register for each of BUCKETS hash functions, sets of LEAST_LARGE and more one for each part of
#: a single hash; those between have both, so that any two similar sets have one kind in common.
LEAST_LARGE, MOST_SMALL = 96, 128
#: A register: 6 bits count leading zeros, 10 bits follow the leading one. EMPTY is no such value.
MANTISSA, EMPTY = 10, 0xFFFF
#: Two unlike registers are equal by chance: sum over k of 2^-2k / 2^MANTISSA.
COLLISION = (1 / 3) / (1 << MANTISSA)
#: Pairs whose estimate lies this many standard errors under the similarity aren't verified.
SIGMAS = 5.0
LIKELY = SIMILAR / 100 - SIGMAS * (SIMILAR / 100 * (1 - SIMILAR / 100) / BUCKETS) ** 0.5
#: Rows of a bucket that are compared at once; larger buckets are compared block by block.
BLOCK = 2048
#: Candidates of one class that share a verifying group.
FAN = 512
#: Bands that a class and the least class of a bucket have in common where the pair is verified first.
SHARED = 6
#: Components are paired by their most similar classes as long as this share of the pairs, and more than FEW, turn out to be links.
WORTH, FEW = 0.02, 20
#: Most similar pairs of a root that are verified in one round, and classes of a shingle that names the pairs that share it.
ROUND, RARE = 3, 4

#: What tells the keys of the bands apart.
SALT = mix(np.arange(1, 2 * BANDS + 1, dtype=U64)).reshape(2, BANDS)
SEEDS = mix(np.arange(1, BUCKETS + 1, dtype=U64) * U64(0xBF58476D1CE4E5B9))
#: Where an empty register begins to look for a full one.
FROM = (mix(np.arange(1, BUCKETS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) % U64(BUCKETS)).astype(np.int64)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each row's distinct shingles. Fewer than WORDS words: the whole sequence as one."""
    starts, ends, first = word_spans(data, bounds, NOT_SPACE)
    words = word_hashes(data, starts, ends)
    prefix = prefix_hashes(words)
    n = np.diff(first)
    at = np.arange(max(0, len(words) - WORDS + 1))
    full = span_hashes(prefix, at, at + WORDS)
    short = span_hashes(prefix, first[:-1], first[1:])
    none = np.zeros(0, U64)
    return [none if not k else short[r : r + 1] if k < WORDS else np.unique(full[a : a + k - WORDS + 1]) for r, (a, k) in enumerate(zip(first[:-1].tolist(), n.tolist(), strict=True))]


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of BUCKETS registers for small and for large sets: compressed least hashes. Rows of the kind that a set doesn't have are EMPTY."""
    small, large = (np.full((len(sets), BUCKETS), EMPTY, np.uint16) for _ in range(2))
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.flatnonzero(sizes >= LEAST_LARGE)
    if len(rows):
        h = np.concatenate([sets[r] for r in rows])
        # sorted hashes are sorted by bucket as well
        bucket = ((h >> U64(32)) * U64(BUCKETS)) >> U64(32)
        group = np.repeat(rows, sizes[rows]) * BUCKETS + bucket.astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        large.reshape(-1)[group[begin]] = compress(np.minimum.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), begin))
    rows = np.flatnonzero((sizes > 0) & (sizes <= MOST_SMALL))
    for a in range(0, len(rows), 64):
        part = rows[a : a + 64]
        h = np.concatenate([sets[r] for r in part])
        begin = np.cumsum(np.concatenate([[0], sizes[part][:-1]]))
        small[part] = compress(np.minimum.reduceat(mix(h[:, None] ^ SEEDS), begin, axis=0))
    return small, densify(large)


def compress(x: np.ndarray) -> np.ndarray:
    """Leading zeros (up to 62) and the next MANTISSA bits of 64-bit values."""
    _, exponent = np.frexp((x >> U64(11)).astype(np.float64))
    zeros = np.minimum(53 - exponent, 62 - MANTISSA)
    shifted = x << (zeros + 1).astype(U64)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (shifted >> U64(64 - MANTISSA)).astype(np.uint16)


def estimates(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of pairs of sketches (small, large) row by row; and whether the pair may be similar.

    Pairs are compared by the kind that both have, pairs without one are no candidates.
    """
    has_small = (a[0][:, 0] != EMPTY) & (b[0][:, 0] != EMPTY)
    has_large = (a[1][:, 0] != EMPTY) & (b[1][:, 0] != EMPTY)
    x, y = (np.where(has_small[:, None], c[0], c[1]) for c in (a, b))
    estimate = np.clip(((x == y).mean(1) - COLLISION) / (1 - COLLISION), 0, 1)
    return estimate, (has_small | has_large) & (estimate >= LIKELY)


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    """A 128-bit digest of each set: two sums of independent hashes of its members."""
    return [np.array([mix(s).sum(dtype=U64), mix(s ^ U64(0xC2B2AE3D27D4EB4F)).sum(dtype=U64)], ">u8").tobytes() for s in sets]


SIGNED = "doc_id long, n long, cls binary, small binary, large binary"


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id and text in; set size, class (digest of the set) and sketch out."""
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            sets = shingle_sets(data, bounds)
            registers = [pa.array([r.tobytes() if r[0] != EMPTY else None for r in kind], pa.binary()) for kind in sketches(sets)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(_digests(sets), pa.binary()), *registers],
                names=["doc_id", "n", "cls", "small", "large"],
            )


def densify(r: np.ndarray) -> np.ndarray:
    """Fill empty registers from full ones: each takes the next full one from a place of its own on."""
    full = r != EMPTY
    at = np.where(full, np.arange(BUCKETS), 2 * BUCKETS)
    following = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1]
    following = np.where(following < BUCKETS, following, at.min(1, keepdims=True))
    borrowed = np.take_along_axis(r, np.minimum(following[:, FROM], BUCKETS - 1), 1)
    return np.where(full, r, borrowed)


NO_SKETCH = np.full(BUCKETS, EMPTY, np.uint16).tobytes()


def _registers(values: list) -> np.ndarray:
    return np.frombuffer(b"".join(v or NO_SKETCH for v in values), np.uint16).reshape(len(values), BUCKETS)


def _keys(r: np.ndarray, kind: int) -> np.ndarray:
    """Keys of the bands of sketches of a kind."""
    return mix(r.view(U64).reshape(-1, BANDS) ^ SALT[kind])


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns cls and sketches in; a row (key, id) for each band out.

    id is half of the class's digest. Two classes may share one; joins on it then bring both, and verification tells them apart.
    """
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            ids = np.frombuffer(b"".join(part.column(0).to_pylist()), ">i8")[::2].astype(np.int64)
            for kind in (0, 1):
                r = _registers(part.column(1 + kind).to_pylist())
                has = r[:, 0] != EMPTY
                if has.any():
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(np.ascontiguousarray(r[has]), kind).reshape(-1).view(np.int64)), pa.array(np.repeat(ids[has], BANDS))], names=["key", "id"])


def estimate_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns cls, hub and the sketches of both in; the likely pairs with their estimates out."""
    for batch in batches:
        a, b = (tuple(_registers(batch.column(i).to_pylist()) for i in pair) for pair in ((2, 3), (4, 5)))
        estimate, fits = estimates(a, b)
        keep = pa.array(np.flatnonzero(fits))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(estimate[fits])], names=["cls", "hub", "estimate"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, cls, text), sorted by hub and salt with the hub's own text (cls null) first; the linked (cls, hub) out."""
    group, own = None, np.zeros(0, U64)
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            hubs, salts, members = (rows.column(i).to_pylist() for i in range(3))
            found: list[tuple[bytes, bytes]] = []
            for hub, salt, cls, s in zip(hubs, salts, members, shingle_sets(data, bounds), strict=True):
                if cls is None:
                    group, own = (hub, salt), s
                elif group == (hub, salt):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= SIMILAR * (len(own) + len(s) - both):
                        found.append((cls, hub))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["u", "v"])


PAIRS = "cls binary, other binary, root binary, estimate double"
CELL = ("key", "i", "j", "side", "minor", "cls", "root", "n", "common", "small", "large")


def across(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Rows of CELL sorted by (key, i, j): likely pairs of a cell whose roots differ, each out of the first band that it shares.

    A cell compares block i of all rows of a bucket (side 0) with block j of its minority (side 1), the
    rows outside the bucket's largest component; where a bucket is one cell, minority rows come once.
    With `every` all pairs come out, else for each class its most similar one: a row a class and cell.
    """
    name, held = None, []

    def pairs() -> Iterator[tuple[bytes, bytes, bytes, float]]:
        side, minor, cls, root, n, common = (np.array([h[k] for h in held]) for k in range(6))
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1)
        if not len(b):
            b = a[minor[a]]
        if not len(a) or not len(b):
            return
        sketch = tuple(_registers([h[k] for h in held]) for k in (6, 7))
        rank = np.unique(cls, return_inverse=True)[1]
        roots = np.unique(root, return_inverse=True)[1]
        best: dict[bytes, tuple[float, bytes, bytes]] = {}
        step = max(1, 4096 // len(a))
        for begin in range(0, len(b), step):
            part = b[begin : begin + step, None]
            least = np.minimum(common[a], common[part])
            # no more than `least` shingles can be in both
            fits = (roots[a] != roots[part]) & ((100 + SIMILAR) * least >= SIMILAR * (n[a] + n[part])) & (~minor[a] | (rank[a] < rank[part]))
            y, x = np.nonzero(fits)
            if not len(x):
                continue
            x, y = a[x], b[begin + y]
            estimate, likely = estimates((sketch[0][x], sketch[1][x]), (sketch[0][y], sketch[1][y]))
            x, y, estimate = x[likely], y[likely], estimate[likely]
            equal = np.concatenate([(sketch[k][x] == sketch[k][y]).reshape(-1, BANDS, BAND).all(2) & (sketch[k][x, :1] != EMPTY) for k in (0, 1)], 1)
            keys = np.concatenate([_keys(sketch[k][x], k) for k in (0, 1)], 1)
            here = keys[np.arange(len(x)), equal.argmax(1)].view(np.int64) == name[0]
            for e, p, q in zip(estimate[here].tolist(), x[here].tolist(), y[here].tolist(), strict=True):
                for u, v in ((p, q),) if every else ((p, q), (q, p)):
                    if every:
                        yield (held[u][2], held[v][2], held[u][3], e)
                    elif (old := best.get(held[u][2])) is None or (e, held[v][2]) > old[:2]:
                        best[held[u][2]] = (e, held[v][2], held[u][3])
        for u, (e, v, r) in best.items():
            yield (u, v, r, e)

    def flush() -> Iterator[pa.RecordBatch]:
        out = []
        for pair in pairs() if len(held) > 1 else ():
            out.append(pair)
            if len(out) == 1 << 14:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def table(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=pa.schema([("cls", pa.binary()), ("other", pa.binary()), ("root", pa.binary()), ("estimate", pa.float64())]))

    for batch in batches:
        for key, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, i, j) != name:
                yield from flush()
                name, held = (key, i, j), []
            held.append(rest)
    yield from flush()


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links of (cls, hub) pairs. A hub's pairs are spread over groups of about FAN, each with one copy of the hub's text."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("groups"))
    dealt = pairs.select("cls", "hub").join(sizes, "hub").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("groups")).cast("int"))
    members = dealt.join(texts, "cls").select("hub", "salt", "cls", "text")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    own = hubs.join(texts.withColumnRenamed("cls", "hub"), "hub").select("hub", "salt", F.lit(None).cast("binary").alias("cls"), "text")
    rows = members.unionAll(own).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("cls"))
    return rows.mapInArrow(verify, "u binary, v binary")


def _id(column: str):
    return F.conv(F.hex(F.substring(column, 1, 8)), 16, -10).cast("long")


def _promising(distinct: DataFrame, shared: DataFrame) -> DataFrame:
    """Likely pairs (cls, hub) of a class and the least class of a bucket: the one with most bands in common, and the least of those with several."""
    counted = shared.where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED)
    two = counted.groupBy("id").agg(F.max_by("hub", F.struct("n", "hub")).alias("a"), F.min("hub").alias("b"))
    pairs = two.select("id", F.explode(F.array_distinct(F.array("a", "b"))).alias("hub_id"))
    sketch = distinct.select("id", "cls", "small", "large")
    joined = pairs.join(sketch, "id").join(sketch.select(F.col("id").alias("hub_id"), F.col("cls").alias("hub"), F.col("small").alias("hub_small"), F.col("large").alias("hub_large")), "hub_id")
    return joined.where("cls <> hub").select("cls", "hub", "small", "large", "hub_small", "hub_large").mapInArrow(estimate_pairs, "cls binary, hub binary, estimate double").select("cls", "hub")


def _cells(info: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, dealt to cells of a block of all rows and a block of the minority.

    Members of a bucket's largest component are compared with the others alone, so a large group that
    has been linked costs its size times the blocks of what is still apart.
    """
    marked = info.withColumn("mark", F.xxhash64("root"))
    rooted = shared.select("key", "id").join(marked.select("id", "mark"), "id")
    per_root = rooted.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("c"))
    sizes = per_root.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "mark")).alias("top")).where(F.col("n") > F.col("top.c"))
    blocks = sizes.select("key", F.col("top.mark").alias("top"), F.ceil(F.col("n") / BLOCK).cast("int").alias("a"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).cast("int").alias("b"))
    placed = rooted.join(blocks, "key").withColumn("minor", F.col("mark") != F.col("top"))
    own_a, own_b = (F.pmod(F.xxhash64("id", F.lit(name)), F.col(name)).cast("int") for name in ("a", "b"))
    rows = placed.select("key", own_a.alias("i"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"), F.lit(0).alias("side"), "minor", "id", "mark")
    seconds = placed.where(F.col("minor") & (F.col("a") * F.col("b") > 1))
    seconds = seconds.select("key", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), own_b.alias("j"), F.lit(1).alias("side"), "minor", "id", "mark")
    # two classes of one half digest that have unlike roots are told apart by the mark
    return rows.unionAll(seconds).join(marked, ["id", "mark"]).select(*CELL).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _outside(info: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What these classes can share with classes of other components, by their shingles: two stored tables.

    Shingles that occur in one component alone can't be in both classes of a pair that is still looked
    for. Of the others, those of at most RARE classes name the pairs that have them in common, few for
    each; (cls, hub, n) counts them. The rest are counted in (cls, common). So a pair shares at most
    the lesser of its two `common`, and its own n. Shingles are compared by hash, which can only make
    both larger.
    """
    rows = texts.join(info.select("cls", F.xxhash64("root").alias("mark")), "cls").select("cls", "mark", "text").mapInArrow(shingle_rows, "shingle long, mark long, cls binary")
    rows = stored(rows, "shingles")
    spread = rows.groupBy("shingle").agg(F.min("mark").alias("a"), F.max("mark").alias("b"), F.count(F.lit(1)).alias("c")).where("a <> b").select("shingle", "c")
    both = stored(rows.join(spread, "shingle"), "outside")
    common = stored(both.where(F.col("c") > RARE).groupBy("cls").agg(F.count(F.lit(1)).alias("common")), "common")
    lists = both.where(F.col("c") <= RARE).groupBy("shingle").agg(F.collect_list(F.struct("cls", "mark")).alias("x"))
    pairs = lists.select(F.explode("x").alias("u"), "x").select("u", F.explode("x").alias("v")).where("u.mark <> v.mark and u.cls > v.cls")
    pairs = stored(pairs.groupBy(F.col("u.cls").alias("cls"), F.col("v.cls").alias("hub")).agg(F.count(F.lit(1)).alias("n")), "rare")
    discard(rows, both)
    return common, pairs


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, mark, text) in, a row for each distinct shingle out."""
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            sets = shingle_sets(data, bounds)
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), rows.column(1).take(at), rows.column(0).take(at)], names=["shingle", "mark", "cls"])


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, n, cls, root): set size, class of equal shingle sets, and the least class of its component, one row per document, stored.

    1. Documents are signed; equal sets form a class, represented by its least doc_id.
    2. In every band's bucket each class is paired with the bucket's least class; pairs that share
       several bands and are likely by their sketches are verified on the full sets. Links so far
       give components.
    3. In buckets that still hold several components, each class names its most similar partner of
       another component. Classes that name none are done. Of each component the most similar pairs
       are verified, as long as that links many.
    4. Of the classes that remain the shingles that occur in another component too are counted, and
       pairs that share rare ones are named: what can't reach a link by these counts is done.
    5. At last all likely pairs of unlike components are verified. So every pair that shares a band is
       in one component, or ruled out by its sketches or by shingles it can't share, or verified.
    """
    spark = documents.sparkSession
    signed = stored(documents.select("doc_id", "text").mapInArrow(sign, SIGNED), "signed")
    distinct = stored(signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("small").alias("small"), F.first("large").alias("large")).withColumn("id", _id("cls")), "classes")
    keys = stored(distinct.select("cls", "small", "large").mapInArrow(bands, "key long, id long"), "keys")
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "hub")
    shared = stored(keys.join(hubs, "key"), "shared")
    discard(keys)
    scratch = [distinct, shared]

    def keep(df: DataFrame, label: str) -> DataFrame:
        scratch.append(stored(df, label))
        return scratch[-1]

    tried = keep(_promising(distinct, shared), "pairs")
    links = _verified(documents, distinct, tried)
    scratch.append(links)
    found = components(links)
    info = distinct.withColumn("common", F.col("n"))
    rows, named, every, first = shared.select("key", "id"), None, False, True
    while True:
        here = info.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        pairs = keep(_cells(here, rows).mapInArrow(lambda b, e=every: across(b, e), PAIRS), "likely")
        pair = F.greatest("cls", "other").alias("cls"), F.least("cls", "other").alias("hub")
        if every:
            more = pairs.select(*pair)
        else:
            ranked = pairs.select(*pair, "root", "estimate").distinct().join(tried, ["cls", "hub"], "left_anti")
            best = Window.partitionBy("root").orderBy(F.desc("estimate"), "cls", "hub")
            more = ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= ROUND)
        more = more.select("cls", "hub")
        if named is not None:
            more, named = more.unionAll(named), None
        more = keep(more.distinct().join(tried, ["cls", "hub"], "left_anti"), "pairs")
        n_more, n_linked = more.count(), 0
        if n_more:
            linked = _verified(documents, distinct, more)
            scratch.append(linked)
            if n_linked := linked.count():
                links = links.unionAll(linked)
                discard(found)
                found = components(links)
        if every:
            break
        every = n_linked <= max(FEW, WORTH * n_more)
        tried = tried.select("cls", "hub").unionAll(more)
        if first:
            # what names no partner now has none: components only grow
            first = False
            active = keep(pairs.select("cls").distinct(), "active")
            here = distinct.join(active, "cls", "left_semi").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
            texts = _texts(documents, distinct, active.withColumn("hub", F.col("cls")))
            common, rare = _outside(here, texts)
            scratch += [texts, common, rare]
            info = keep(distinct.join(active, "cls", "left_semi").join(common, "cls", "left").withColumn("common", F.coalesce("common", F.lit(0))), "info")
            sizes = info.select("cls", F.col("n").alias("n_cls"), F.col("common").alias("c_cls"))
            named = rare.join(sizes, "cls").join(sizes.toDF("hub", "n_hub", "c_hub"), "hub")
            named = named.where((100 + SIMILAR) * (F.least("c_cls", "c_hub") + F.col("n")) >= SIMILAR * (F.col("n_cls") + F.col("n_hub"))).select("cls", "hub")
            info = info.where(100 * F.col("common") >= SIMILAR * F.col("n"))
            rows = keep(shared.select("key", "id").join(info.select("id").distinct(), "id", "left_semi"), "shared")
    out = stored(signed.select("doc_id", "n", "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "n", "cls", F.when(F.col("n") > 0, F.coalesce("root", "cls")).alias("root")), "rooted")
    for table in (signed, found, *scratch):
        discard(table)
    release(spark)
    return out


def _verified(documents: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    texts = _texts(documents, distinct, pairs)
    links = stored(_links(pairs, texts), "links")
    discard(texts)
    release(documents.sparkSession)
    return links


def _texts(documents: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls, text) of one document of each class in pairs. A filter of the doc_ids keeps most other texts out of the join."""
    needed = pairs.select("cls").unionAll(pairs.select(F.col("hub").alias("cls"))).distinct()
    chosen = stored(distinct.join(needed, "cls", "left_semi").select("cls", F.col("least").alias("doc_id")), "chosen")
    bits = documents.sparkSession.sparkContext.broadcast(bit_filter(chosen, F.col("doc_id")))
    asked = documents.select("doc_id", "text").mapInArrow(lambda b: _asked(b, bits.value), "doc_id long, text string")
    named = asked.join(chosen, "doc_id").select("doc_id", "text", "cls").mapInArrow(_of_class, "cls binary, text string")
    nameless = documents.where("doc_id is null").select("text").mapInArrow(_classed, "cls binary, text string").join(chosen.where("doc_id is null").select("cls"), "cls", "left_semi")
    out = stored(named.unionAll(nameless).dropDuplicates(["cls"]), "texts")
    discard(chosen)
    return out


def _asked(batches: Iterator[pa.RecordBatch], bits: BitFilter) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(bits.has(batch.column(0).fill_null(0).to_numpy())))


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            yield pa.RecordBatch.from_arrays([pa.array(_digests(shingle_sets(data, bounds)), pa.binary()), rows.column(0)], names=["cls", "text"])


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the class's set: where a doc_id is repeated, others may come with it."""
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            right = pa.array([a == b for a, b in zip(_digests(shingle_sets(data, bounds)), rows.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(2).filter(right), rows.column(1).filter(right)], names=["cls", "text"])


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable over links), and kept (doc_id = component_id).

    A null text has no words; such documents are linked with nothing. A null doc_id counts as larger
    than any other: it is a component's id only where there is no other, and is kept only then.
    Repeated rows share a component. Documents of one doc_id but unlike texts are nodes of their own.
    """
    rows = classes(documents)
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = rows.join(least, "root", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(_digests(shingle_sets(data, bounds)), pa.binary())], names=[*rows.schema.names, "__cls"])


@apart
def deduplicate(documents: DataFrame) -> DataFrame:
    """The same columns, and one row of each component: that of the least doc_id. Rows without words all stay.

    Rows are joined with the chosen ones on doc_id and class, so that a large group of copies meets in no task.
    """
    rows = classes(documents).where("n > 0")
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "cls")).alias("row")).select("row.doc_id", F.col("row.cls").alias("cls"))
    chosen = chosen.select(F.col("doc_id").alias("__doc_id"), F.col("cls").alias("__chosen"))
    columns = ", ".join(f"`{n}` {t}" for n, t in documents.dtypes)
    has_word = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    signed = documents.where(has_word).mapInArrow(_with_class, f"{columns}, __cls binary")
    kept = signed.join(chosen, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__cls") == F.col("__chosen"))).dropDuplicates(["doc_id", "__cls"])
    return kept.select(*[f"`{n}`" for n in documents.columns]).unionAll(documents.where(~has_word))
