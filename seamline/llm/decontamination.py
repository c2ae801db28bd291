"""Benchmark decontamination with a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import ALNUM, apart, chunks, prefix_hashes, span_hashes, word_hashes, word_spans

#: Consecutive words of a window.
WINDOW = 13
#: Bytes of benchmark text in one broadcast set; more items are taken in further sets, one after the other.
SET_BYTES = 8 << 20
#: Columns that mark() adds.
ADDED = ("__n_words", "__n_hit", "__items", "__spans")


class WindowSet:
    """The distinct windows of some benchmark items: sorted hashes by window length, the words to verify hits with, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW) -> None:
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        names: dict[bytes, bytes] = {}
        #: words of one window of each kind, and the ids of the items that hold it
        self.words: list[list[bytes]] = []
        self.items: list[frozenset[str]] = []
        texts: list[list[bytes]] = []
        for k, (_, text) in enumerate(items):
            data = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
            raw = data.tobytes().lower()
            texts.append([names.setdefault(w := raw[a:b], w) for a, b in zip(starts, ends, strict=True)])
            if n := min(window, len(starts)):
                hashes = windows(word_hashes(data, starts, ends), n)
                by_length.setdefault(n, []).extend((int(h), k, p) for p, h in enumerate(hashes))
        #: for each length the hashes, and the kinds of window of each: one, but for collisions
        self.tables: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n, rows in by_length.items():
            rows.sort()
            known, kinds = [], []
            for h, same in groupby(rows, lambda r: r[0]):
                found: dict[tuple[bytes, ...], set] = {}
                for _, k, p in same:
                    found.setdefault(tuple(texts[k][p : p + n]), set()).add(items[k][0])
                known.append(h)
                kinds.append(list(range(len(self.words), len(self.words) + len(found))))
                self.words += map(list, found)
                self.items += [frozenset(x - {None}) for x in found.values()]
            self.tables[n] = (np.array(known, np.uint64), kinds)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    prefix = prefix_hashes(hashes)
    starts = np.arange(len(hashes) - n + 1)
    return span_hashes(prefix, starts, starts + n)


def scan(batches: Iterator[pa.RecordBatch], found: WindowSet, again: bool) -> Iterator[pa.RecordBatch]:
    """Add the hit words and the items of one set; again: to those of the sets before."""
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            starts, ends, first = word_spans(data, bounds, ALNUM)
            hashes = word_hashes(data, starts, ends)
            raw = data.tobytes().lower()
            hit: dict[int, list[tuple[int, int]]] = {}
            kinds: dict[int, set[int]] = {}
            for n, (known, kinds_of) in found.tables.items():
                here = windows(hashes, n)
                at = np.searchsorted(known, here)
                at[at == len(known)] = 0
                for p in np.flatnonzero(known[at] == here) if len(known) else ():
                    row = int(np.searchsorted(first, p, "right")) - 1
                    if p + n > first[row + 1]:
                        continue
                    mine = [raw[a:b] for a, b in zip(starts[p : p + n], ends[p : p + n], strict=True)]
                    for kind in kinds_of[at[p]]:
                        if found.words[kind] == mine:
                            hit.setdefault(row, []).append((int(p), int(p) + n))
                            kinds.setdefault(row, set()).add(kind)
            old_spans = rows.column(rows.schema.get_field_index("__spans")).to_pylist() if again else None
            old_items = rows.column(rows.schema.get_field_index("__items")).to_pylist() if again else None
            n_words, out_spans, out_items, n_hit = np.diff(first), [], [], []
            for r in range(rows.num_rows):
                spans = hit.get(r, [])
                word_runs = union([(a - int(first[r]), b - int(first[r])) for a, b in spans] + ([(s["start"], s["end"]) for s in old_spans[r]] if again else []))
                names = set(old_items[r]) if again else set()
                names.update(*(found.items[k] for k in kinds.get(r, ())))
                out_items.append(sorted(names))
                out_spans.append([{"start": a, "end": b} for a, b in word_runs])
                n_hit.append(sum(b - a for a, b in word_runs))
            keep = [i for i, name in enumerate(rows.schema.names) if name not in ADDED]
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in keep), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(out_items, pa.list_(pa.string())), pa.array(out_spans, pa.list_(span))],
                names=[*(rows.schema.names[i] for i in keep), *ADDED],
            )


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def item_sets(benchmark: DataFrame, limit: int = SET_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """Benchmark items in lists of about `limit` bytes of text; items are never cut. Repeated items come once, items without text never."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    part: list[tuple[str | None, str]] = []
    size = 0
    for row in items.toLocalIterator():
        part.append((row[0], row[1]))
        size += len(row[1]) + 64
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def mark(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """All columns of documents, and __n_words, __n_hit, __items (ids with occurring windows) and __spans (hit runs of words).

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window.
    Hits are found by hash and verified word by word. The set is broadcast in parts of bounded size
    that are applied one after the other in one scan, so that a large benchmark needs no shuffle.
    Items without text have no windows; those of an item without an id hit words, but no id can be named
    for them. Nulls and texts without words have no hits. Repeated documents have a row each; an empty
    benchmark hits nothing. Columns of the added names are replaced.
    """
    documents = documents.drop(*ADDED)
    sc = documents.sparkSession.sparkContext
    plain = [f"`{n}` {t}" for n, t in documents.dtypes]
    added = "__n_words long, __n_hit long, __items array<string>, __spans array<struct<start:int,end:int>>"
    out, again = documents, False
    for part in item_sets(benchmark, set_bytes):
        shared = sc.broadcast(WindowSet(part, window))
        out = out.mapInArrow(lambda b, s=shared, a=again: scan(b, s.value, a), ", ".join([*plain, added]))
        again = True
    if not again:
        shared = sc.broadcast(WindowSet([], window))
        out = out.mapInArrow(lambda b, s=shared: scan(b, s.value, False), ", ".join([*plain, added]))
    return out


def contaminated(n_hit: str, n_words: str):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items with occurring windows (count and digest), and whether it is contaminated.

    Null and empty texts have no words and are clean. Repeated rows have a row each; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = mark(documents.select("doc_id", "text"), benchmark)
    ids = F.array_join(F.array_sort("__items"), ",")
    return rows.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        contaminated("__n_hit", "__n_words").alias("contaminated"),
    )


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the hit runs of words out of the text; what stands between two words of a run goes with it."""
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            spans = rows.column(rows.schema.get_field_index("__spans")).to_pylist()
            if any(spans):
                starts, ends, first = word_spans(data, bounds, ALNUM)
                for r, runs in enumerate(spans):
                    if runs:
                        raw, base, at, out = data[bounds[r] : bounds[r + 1]].tobytes(), int(bounds[r]), 0, []
                        for s in runs:
                            a, b = int(starts[first[r] + s["start"]]) - base, int(ends[first[r] + s["end"] - 1]) - base
                            out.append(raw[at:a])
                            at = b
                        texts[r] = b"".join([*out, raw[at:]]).decode()
            keep = [i for i, n in enumerate(rows.schema.names) if n not in ADDED]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if rows.schema.names[i] == "text" else rows.column(i) for i in keep], names=[rows.schema.names[i] for i in keep])


@apart
def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same columns: contaminated documents go; from others that hold a benchmark window its words are cut out.

    Null and empty texts stay as they are, repeated rows are judged each for itself.
    """
    rows = mark(documents, benchmark).where(~contaminated("__n_hit", "__n_words"))
    return rows.mapInArrow(cut_spans, documents.schema)
