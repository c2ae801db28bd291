"""Removal of byte strings that also start in an earlier document, by sharded suffix sorting.

Every string of LENGTH bytes belongs to one of its grams, the one with the least hash; equal strings
belong to equal grams. Strings that follow each other and belong to one gram are cut out together, as
a record. Records of grams that occur in one document alone can't matter and are left out; the others
are dealt to shards by gram, so that equal strings meet. Where a gram has records of unlike content,
the suffixes of the records are sorted by external induction (induced_sort), and neighbours that share
LENGTH bytes are one string, of which the least document counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import U64, BitFilter, bit_filter, byte_values, chunks, discard, powers, prefix_hashes, release, span_hashes, stored
from seamline.llm.induced_sort import DEPTH, MEMORY, sorted_suffixes

LENGTH, GRAM = DEPTH, 24
#: Rows of one gram that are looked at together in any case.
HELD = 1 << 16
#: Bits of a position inside a chunk that stand behind a gram's hash when least grams are searched.
PLACE = 22
#: Text of records that is sorted at once, in bytes; a gram's records stay together.
SHARD = 2 << 20
#: Text behind one partition of the records.
SHARDS = 16 << 20
#: Text behind one part of the gram count, and bits of a block of the filter.
PART, BLOCK_BITS = 64 << 20, 1 << 20
#: Most blocks of the filter, 128 MB. Up to 5 GB of text it has a bit for each five bytes; beyond, it lets more through, which costs time but no result.
BLOCKS = 1024
#: Stands for a null doc_id, which is greater than any other.
NO_ID = (1 << 63) - 1
#: No byte of UTF-8.
SEPARATOR = b"\xff"

_VALUES = byte_values(fold_case=False)


def _gram_hashes(prefix: np.ndarray, begin: int, n: int) -> np.ndarray:
    """Hashes of the n grams from `begin` on."""
    h = prefix[begin + GRAM : begin + GRAM + n] - prefix[begin : begin + n]
    h *= powers(begin + n)[1][begin : begin + n]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> U64(shift)
        h *= U64(factor)
    h ^= h >> U64(31)
    return h


def _records(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gram hash, row, first and last string start of each record of a chunk, and the prefix hashes of the chunk."""
    prefix = prefix_hashes(_VALUES[data])
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(U64), none, none, none, prefix
    out = []
    rows_at = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # a chunk that is too long for PLACE is taken in overlapping parts
    for begin in range(0, len(data) - LENGTH + 1, (1 << PLACE) - LENGTH):
        end = min(len(data), begin + (1 << PLACE) - 1)
        grams = _gram_hashes(prefix, begin, end - begin - GRAM + 1)
        least, size, window = grams & ~U64((1 << PLACE) - 1), 1, LENGTH - GRAM + 1
        least |= np.arange(len(grams), dtype=U64)
        while 2 * size <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
        anchor = (least & U64((1 << PLACE) - 1)).astype(np.int64)
        start = np.arange(len(anchor)) + begin
        row = rows_at[begin : begin + len(anchor)]
        inside = np.flatnonzero(start + LENGTH <= bounds[row + 1])
        if begin + (1 << PLACE) - LENGTH < len(data) - LENGTH + 1:
            inside = inside[start[inside] < begin + (1 << PLACE) - LENGTH]
        if len(inside):
            a, r, s = anchor[inside], row[inside], start[inside]
            new = np.ones(len(inside), bool)
            new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
            first = np.flatnonzero(new)
            out.append((grams[a[first]], r[first], s[first], s[np.append(first[1:], len(inside)) - 1]))
    return (*(np.concatenate(c) for c in zip(*out, strict=True)), prefix) if out else (none.astype(U64), none, none, none, prefix)


def _parts(grams: np.ndarray, blocks: int, per_block: int) -> np.ndarray:
    block = (grams >> U64(64 - blocks.bit_length() + 1)).astype(np.int64) if blocks > 1 else np.zeros(len(grams), np.int64)
    return block * per_block + (grams % U64(per_block)).astype(np.int64)


def _bit(grams: np.ndarray, blocks: int) -> np.ndarray:
    """Place of a gram in the filter: block, and bit inside the block."""
    return (grams >> U64(64 - (blocks.bit_length() - 1) - 20)).astype(np.int64)


def gram_lists(batches: Iterator[pa.RecordBatch], blocks: int, per_block: int) -> Iterator[pa.RecordBatch]:
    """(part, grams): grams of each document, each once, packed by part."""
    for batch in batches:
        found = []
        for rows, data, bounds in chunks(batch):
            grams, row, *_ = _records(data, bounds)
            if len(grams):
                order = np.lexsort([grams, row])
                g, r = grams[order], row[order]
                keep = np.ones(len(g), bool)
                keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
                found.append(g[keep])
        if found:
            grams = np.concatenate(found)
            part = _parts(grams, blocks, per_block)
            order = np.argsort(part, kind="stable")
            grams, part = grams[order], part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array([g.tobytes() for g in np.split(grams, cuts[1:])], pa.binary())], names=["part", "grams"])


def repeated_bits(batches: Iterator[pa.RecordBatch], blocks: int, per_block: int) -> Iterator[pa.RecordBatch]:
    """(block, bits) of the grams that come twice in a part. Rows are sorted by part."""
    name, held = -1, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        grams = np.sort(np.frombuffer(b"".join(held), U64))
        twice = grams[1:][grams[1:] == grams[:-1]]
        if len(twice):
            bits = np.zeros(BLOCK_BITS, bool)
            bits[_bit(twice, blocks) % BLOCK_BITS] = True
            yield pa.RecordBatch.from_arrays([pa.array([name // per_block], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for part, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != name:
                yield from flush()
                name, held = part, []
            held.append(grams)
    yield from flush()


def merged_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of each block in one row."""
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = np.frombuffer(bits, np.uint8)
            out[block] = out[block] | new if block in out else new
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array([b.tobytes() for b in out.values()], pa.binary())], names=["block", "bits"])


OCCURRENCES = "gram long, digest long, doc long, uid long, start int, n int"


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def occurrences(batches: Iterator[pa.RecordBatch], bits: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """Records whose gram passes the filter: start and number of strings.

    Where a batch holds a record's content in a smaller document too, the record is covered already
    and comes with n below 0; so of a content that very many documents share one row a batch is dealt by its gram.
    """
    for batch in batches:
        held = []
        for rows, data, bounds in chunks(batch):
            grams, row, first, last, prefix = _records(data, bounds)
            at = _bit(grams, blocks)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            grams, row, first, last = grams[hit], row[hit], first[hit], last[hit]
            if len(grams):
                doc = rows.column(0).fill_null(NO_ID).to_numpy()[row]
                uid = span_hashes(prefix, bounds[:-1], bounds[1:])[row].view(np.int64)
                held.append((grams.view(np.int64), span_hashes(prefix, first, last + LENGTH).view(np.int64), doc, uid, (first - bounds[row]).astype(np.int32), (last - first + 1).astype(np.int32)))
        if held:
            gram, digest, doc, uid, start, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort([doc, digest, gram])
            gram, digest, doc, uid, start, n = (c[order] for c in (gram, digest, doc, uid, start, n))
            run = np.flatnonzero(_first_of_runs(gram, digest))
            least = np.repeat(doc[run], np.diff(np.append(run, len(doc))))
            n[doc > least] *= -1
            yield pa.RecordBatch.from_arrays([*map(pa.array, (gram, digest, doc, uid, start, n))], names=["gram", "digest", "doc", "uid", "start", "n"])


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, digest, doc, uid, start, n) sorted so; those with n below 0 just pass. Out come, with a null gram, records that a smaller document has as a whole; and, of grams with unlike contents, the records of each content's least document."""

    def table(columns: list, gram_null: np.ndarray) -> pa.RecordBatch:
        gram, digest, doc, uid, start, n = columns
        return pa.RecordBatch.from_arrays([pa.array(gram, mask=gram_null), *map(pa.array, (digest, doc, uid, start, n))], names=["gram", "digest", "doc", "uid", "start", "n"])

    rest: list | None = None
    least_of: tuple[int, int, int] | None = None
    several_of: int | None = None
    for batch in _with_end(batches):
        columns = rest
        if batch is not None:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            passing = new[5] < 0
            if passing.any():
                covered = [c[passing] for c in new]
                covered[5] = -covered[5]
                yield table(covered, np.ones(len(covered[0]), bool))
                new = [c[~passing] for c in new]
            columns = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
        if columns is None or not len(columns[0]):
            continue
        gram, digest, doc = columns[:3]
        if batch is None:
            cut = len(gram)
        else:
            # the last content may go on in the next batch: of it keep what is needed to tell
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut == 0 and len(gram) < 4 * HELD:
                rest = columns
                continue
            if cut == 0:
                cut = len(gram)
        part, rest = [c[:cut] for c in columns], [c[cut:] for c in columns] if cut < len(gram) else None
        gram, digest, doc = part[:3]
        run = np.flatnonzero(_first_of_runs(gram, digest))
        sizes = np.diff(np.append(run, len(gram)))
        first = doc[run].copy()
        several = np.zeros(len(run), bool)
        several[1:] |= gram[run[1:]] == gram[run[:-1]]
        several[:-1] |= gram[run[1:]] == gram[run[:-1]]
        if least_of is not None and gram[0] == least_of[0]:
            if digest[0] == least_of[1]:
                first[0] = min(first[0], least_of[2])
            several |= gram[run] == gram[0]
        if cut == len(gram) and batch is not None:
            # a gram of very many rows goes on: its contents count as several
            several |= gram[run] == gram[-1]
            least_of = (int(gram[-1]), int(digest[-1]), int(first[-1]))
        least, many = np.repeat(first, sizes), np.repeat(several, sizes)
        over = doc > least
        keep = over | many
        yield table([c[keep] for c in part], over[keep])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


CONTENTS = "gram long, digest long, doc long, uid long, start int, n int, content binary"


def contents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text and records (gram, digest, doc, uid, start, n) of it in; the records with their bytes out."""
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            raw, out = data.tobytes(), []
            for r, records in enumerate(rows.column(rows.schema.get_field_index("records")).to_pylist()):
                begin = int(bounds[r])
                for x in records:
                    a = begin + x["start"]
                    out.append((x["gram"], x["digest"], x["doc"], x["uid"], x["start"], x["n"], raw[a : a + x["n"] - 1 + LENGTH]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["gram", "digest", "doc", "uid", "start", "n", "content"])


COVERS = "doc long, uid long, start int, end int"


def least_documents(contents: list[bytes], starts: list[int], docs: list[int], memory: int = MEMORY) -> list[np.ndarray]:
    """For each content, the least document of each of its first starts[i] strings, over all contents."""
    text = np.frombuffer(SEPARATOR.join(contents) + SEPARATOR, np.uint8)
    begin = np.cumsum([0, *(len(c) + 1 for c in contents)])[:-1]
    sizes = np.array(starts)
    mine = np.full(len(text), -1, np.int32)
    where = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    mine[where] = np.repeat(np.arange(len(contents)), sizes)
    least = np.full(len(text), NO_ID, np.int64)
    docs = np.array(docs, np.int64)
    tail_at, tail_least = np.zeros(0, np.int64), NO_ID
    for positions, common in sorted_suffixes(text, memory):
        owner = mine[positions]
        group = np.cumsum(common < LENGTH)
        best = np.full(int(group[-1]) + 1, NO_ID, np.int64)
        if group[0] == 0:
            best[0] = tail_least
        used = np.flatnonzero(owner >= 0)
        np.minimum.at(best, group[used], docs[owner[used]])
        if group[0] == 0:
            least[tail_at] = best[0]
        least[positions[used]] = best[group[used]]
        ends = used[group[used] == group[-1]]
        tail_at = np.concatenate([tail_at, positions[ends]]) if group[-1] == 0 else positions[ends]
        tail_least = int(best[-1])
    return [least[b : b + n] for b, n in zip(begin, sizes, strict=True)]


def shared(contents: list[bytes]) -> list[tuple[int, int, int]]:
    """(content, first, last) of runs of strings that may occur in another content too, by their hashes."""
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents), np.uint8)
    begin = np.cumsum(np.concatenate([[0], sizes]))[:-1]
    n = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(contents)), n)
    place = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    at = begin[owner] + place
    hashes = span_hashes(prefix_hashes(_VALUES[data]), at, at + LENGTH)
    order = np.argsort(hashes)
    equal = hashes[order[1:]] == hashes[order[:-1]]
    hit = np.zeros(len(hashes), bool)
    hit[order[1:][equal]] = hit[order[:-1][equal]] = True
    hits = np.flatnonzero(hit)
    if not len(hits):
        return []
    new = np.ones(len(hits), bool)
    new[1:] = (np.diff(hits) > 1) | (owner[hits[1:]] != owner[hits[:-1]])
    first = hits[new]
    last = hits[np.append(np.flatnonzero(new)[1:], len(hits)) - 1]
    return list(zip(owner[first].tolist(), place[first].tolist(), place[last].tolist(), strict=True))


def answers(batches: Iterator[pa.RecordBatch], shard: int, memory: int) -> Iterator[pa.RecordBatch]:
    """Rows (gram, digest, doc, uid, start, n, content) sorted by gram: runs of their strings that a smaller document holds, as covers of bytes."""
    waiting: list[tuple] = []
    size, name = 0, None

    def sort() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if len(waiting) > 1:
            runs = shared([w[6] for w in waiting])
            out = []
            if runs:
                texts = [waiting[i][6][a : b + LENGTH] for i, a, b in runs]
                found = least_documents(texts, [b - a + 1 for _, a, b in runs], [waiting[i][2] for i, _, _ in runs], memory)
                for (i, a, _), least in zip(runs, found, strict=True):
                    doc, uid, start = waiting[i][2], waiting[i][3], waiting[i][4] + a
                    gone = np.flatnonzero(least < doc)
                    if len(gone):
                        first = gone[np.concatenate([[True], np.diff(gone) > 1])]
                        last = gone[np.concatenate([np.diff(gone) > 1, [True]])]
                        out += [(doc, uid, start + int(x), start + int(y) + LENGTH) for x, y in zip(first, last, strict=True)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc", "uid", "start", "end"])
        waiting.clear()
        size = 0

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != name:
                if size >= shard:
                    yield from sort()
                name = row[0]
            waiting.append(row)
            size += len(row[6])
    yield from sort()


CUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept binary"


def cut(batches: Iterator[pa.RecordBatch], with_kept: bool, has_covers: bool) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text and, if has_covers, covers in; the maximal removed runs, and what is left, out."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            raw, ids = data.tobytes(), rows.column(0)
            n_bytes, removed, spans, digests, kept = [], [], [], [], []
            for r, covers in enumerate(rows.column(2).to_pylist() if has_covers else [None] * rows.num_rows):
                text, at, left, runs = raw[bounds[r] : bounds[r + 1]], 0, [], []
                for c in sorted((c["start"], c["end"]) for c in covers or ()):
                    if runs and c[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], c[1])
                    else:
                        runs.append(list(c))
                for a, b in runs:
                    left.append(text[at:a])
                    at = b
                rest = b"".join([*left, text[at:]])
                n_bytes.append(len(text))
                removed.append(len(text) - len(rest))
                spans.append([{"start": a, "end": b} for a, b in runs])
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(digests), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"],
            )


def _with_key(batches: Iterator[pa.RecordBatch], bits: BitFilter, passing: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) whose text digest passes the filter or doesn't, with the digest."""
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            raw = data.tobytes()
            keys = [hashlib.md5(raw[a:b]).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            mask = pa.array(bits.has(np.array([int.from_bytes(k[:4], "big") for k in keys], np.int64)) == passing)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(keys, pa.binary())], names=["doc_id", "text", "key"]).filter(mask)


def _with_uid(batches: Iterator[pa.RecordBatch], bits: BitFilter, passing: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            uid = span_hashes(prefix_hashes(_VALUES[data]), bounds[:-1], bounds[1:]).view(np.int64)
            mask = pa.array(bits.has(uid) == passing)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(uid)], names=["doc_id", "text", "uid"]).filter(mask)


def repeats(documents: DataFrame, with_kept: bool = False, shard: int = SHARD, memory: int = MEMORY) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, digest of the rest, and the rest itself if with_kept.

    Strings are judged on the input. Of equal texts all but those of the least doc_id go at once, if
    they have LENGTH bytes; only one text of each kind is searched. A null text counts as empty. A
    null doc_id is greater than any other. Rows that repeat a doc_id don't remove each other.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(NO_ID))
    kinds = stored(rows.groupBy(F.unhex(F.md5("text")).alias("key")).agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n"), F.min(F.octet_length("text")).alias("size")), "kinds")
    total = kinds.agg(F.sum("size")).first()[0] or 0
    twins = kinds.where("n > 1").select("key", "least")
    twin_bits = sc.broadcast(bit_filter(twins, F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")))
    matched = rows.mapInArrow(lambda b: _with_key(b, twin_bits.value, True), "doc_id long, text string, key binary").join(twins, "key", "left")
    is_copy = F.col("least").isNotNull() & (order > F.col("least"))
    copy_size = F.octet_length("text")
    whole = F.array(F.struct(F.lit(0).alias("start"), copy_size.alias("end")))
    gone = copy_size >= LENGTH
    copies = matched.where(is_copy).select(
        "doc_id",
        copy_size.cast("long").alias("n_bytes"),
        F.when(gone, copy_size).otherwise(0).cast("long").alias("n_removed"),
        F.when(gone, whole).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.sha2(F.when(gone, "").otherwise(F.col("text")), 256).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept") if with_kept else F.lit(None).cast("binary").alias("kept"),
    )
    first_twins = stored(matched.where(~is_copy).select("doc_id", "text"), "twins")

    def searched(f, schema: str) -> DataFrame:
        """f over one document of each text, in the worker that leaves the others out."""
        return rows.mapInArrow(lambda b: f(_with_key(b, twin_bits.value, False)), schema).unionAll(first_twins.mapInArrow(f, schema))

    blocks = 1
    while blocks < BLOCKS and blocks * BLOCK_BITS < total // 5:
        blocks *= 2
    per_block = max(1, -(-total // (PART * blocks)))
    lists = searched(lambda b: gram_lists(b, blocks, per_block), "part int, grams binary")
    twice = lists.repartition(blocks * per_block, "part").sortWithinPartitions("part").mapInArrow(lambda b: repeated_bits(b, blocks, per_block), "block int, bits binary")
    bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
    for block, packed in twice.repartition("block").mapInArrow(merged_bits, "block int, bits binary").toLocalIterator():
        bits[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = np.frombuffer(packed, np.uint8)
    release(spark)
    passing = sc.broadcast(bits)
    found = searched(lambda b: occurrences(b, passing.value, blocks), OCCURRENCES)
    shards = max(1, sc.defaultParallelism, int(total // SHARDS))
    dealt = found.repartition(shards, F.when(F.col("n") < 0, F.col("uid")).otherwise(F.col("gram"))).sortWithinPartitions("gram", "digest", "doc")
    records = stored(dealt.mapInArrow(resolve, OCCURRENCES), "resolved")
    release(spark)
    unlike = records.where("gram is not null").groupBy("doc", "uid").agg(F.collect_list(F.struct("gram", "digest", "doc", "uid", "start", "n")).alias("records"))
    unlike_bits = sc.broadcast(bit_filter(records.where("gram is not null").select("uid").distinct(), F.col("uid")))
    asked = searched(lambda b: _with_uid(b, unlike_bits.value, True), "doc_id long, text string, uid long").withColumn("doc", order)
    contents = asked.dropDuplicates(["doc", "uid"]).join(unlike, ["doc", "uid"]).select("text", "records").mapInArrow(contents_of, CONTENTS)
    contents = contents.repartition(shards, "gram").sortWithinPartitions("gram", "digest")
    partly = contents.mapInArrow(lambda b: answers(b, shard, memory), COVERS)
    wholly = records.where("gram is null").select("doc", "uid", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("end"))
    covers = stored(partly.unionAll(wholly).groupBy("doc", "uid").agg(F.collect_list(F.struct("start", "end")).alias("covers")), "covers")
    discard(records)
    release(spark)
    cover_bits = sc.broadcast(bit_filter(covers, F.col("uid")))
    plain = searched(lambda b: cut(_with_uid(b, cover_bits.value, False), with_kept, False), CUT)
    some = searched(lambda b: _with_uid(b, cover_bits.value, True), "doc_id long, text string, uid long").withColumn("doc", order)
    some = some.join(covers, ["doc", "uid"], "left").select("doc_id", "text", "covers").mapInArrow(lambda b: cut(b, with_kept, True), CUT)
    return plain.unionAll(some).unionAll(copies)


def report(documents: DataFrame) -> DataFrame:
    rows = repeats(documents)
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
