"""Which symbol fits a span of lines best, path by path: merge-sort trees in place of joins of all spans with all symbols of a path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rows that are worked on at once; paths are never cut.
BATCH_ROWS = 200_000

Arrays = tuple[np.ndarray, ...]


def _least(y: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each question the least r (a permutation of 0 to n - 1) at places low to high - 1 where y <= bound, else n. n log n steps in numpy."""
    n = len(y)
    out = np.full(len(low), n, np.int64)
    levels = np.unique(y)
    width = len(levels) + 1
    rank, most = np.searchsorted(levels, y), np.searchsorted(levels, bound, "right")
    low, high, at, k = low.copy(), high.copy(), np.arange(n), 0
    while (live := low < high).any():
        # nodes of 2^k places, by y inside
        node = at >> k
        key = node * width + rank[at]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        node = at >> k
        running = np.minimum.accumulate(r[at] - node * (n + 1)) + node * (n + 1)
        for edge, shift in ((low, 0), (high, 1)):
            q = np.flatnonzero(live & (edge & 1 == 1))
            wanted = edge[q] - shift
            place = np.searchsorted(key, wanted * width + most[q], "left") - 1
            there = place >= wanted << k
            q, place = q[there], place[there]
            out[q] = np.minimum(out[q], running[place])
        low, high, k = (low + 1) >> 1, high >> 1, k + 1
    return out


def _find(spans: Arrays, keep: np.ndarray, x: np.ndarray, y: np.ndarray, order: Arrays, asked: np.ndarray, low, high, bound) -> np.ndarray:
    """For each asked path the first span in `order` (last key first) with low <= x <= high and y <= bound, else -1; low or high None: no bound."""
    out = np.full(len(asked), -1, np.int64)
    held = np.flatnonzero(keep)
    if not len(held) or not len(asked):
        return out
    p, x, y = spans[0][held], x[held], y[held]
    by_rank = np.lexsort([o[held] for o in order])
    r = np.empty(len(held), np.int64)
    r[by_rank] = np.arange(len(held))
    values = np.unique(x)
    width = len(values) + 1
    key = p * width + np.searchsorted(values, x)
    place = np.argsort(key, kind="stable")
    key = key[place]
    first = np.searchsorted(values, low, "left") if low is not None else 0
    last = np.searchsorted(values, high, "right") if high is not None else len(values)
    a, b = np.searchsorted(key, asked * width + first, "left"), np.searchsorted(key, asked * width + last, "left")
    found = _least(y[place], r[place], a, b, bound)
    hit = found < len(held)
    out[hit] = held[by_rank[found[hit]]]
    return out


def _first(spans: Arrays, start: np.ndarray, end: np.ndarray, choices: list[np.ndarray], by_size: bool) -> np.ndarray:
    """Of several choices for each question the one with the nearest ends, then the shortest (`by_size`), then the first by id."""
    _, a, b, _ = spans
    off = lambda c: np.abs(a[c] - start) + np.abs(b[c] - end)
    best = choices[0]
    for c in choices[1:]:
        d, e = off(c), off(best)
        size_c, size_best = ((b - a)[c], (b - a)[best]) if by_size else (0, 0)
        better = (d < e) | (d == e) & ((size_c < size_best) | (size_c == size_best) & (c < best))
        best = np.where((c >= 0) & ((best < 0) | better), c, best)
    return best


def overlapping(spans: Arrays, asked: Arrays) -> np.ndarray:
    """The span that meets the asked one: the nearest ends, the shortest, the first id. One search for each way in which the ends may lie."""
    p, a, b, valid = spans
    q, start, end, _ = asked
    ids, none = np.arange(len(p)), np.full(len(q), -1, np.int64)
    if not len(p):
        return none
    good = valid & (a <= b)
    choices = [
        _find(spans, good, b, a, (ids, b - a), q, np.maximum(start, end), None, np.minimum(start, end)),
        _find(spans, good, b, a, (ids, b - a, -(a + b)), q, start, end, start),
        _find(spans, good, a, -b, (ids, b - a, a + b), q, start, end, -end),
        _find(spans, good, a, b, (ids, a - b), q, start, end, end),
        _find(spans, valid & (a > b), b, a, (ids, a - b), q, start, None, end),
    ]
    return _first(spans, start, end, choices, True)


def containing(spans: Arrays, asked: Arrays) -> np.ndarray:
    """The shortest span around the asked one, else the one with the nearest ends; the first id. Without lines the first id of the path."""
    p, a, b, valid = spans
    q, start, end, lines = asked
    ids, out = np.arange(len(p)), np.full(len(q), -1, np.int64)
    if not len(p):
        return out
    at = np.searchsorted(p, q)
    out = np.where(p[np.minimum(at, len(p) - 1)] == q, np.minimum(at, len(p) - 1), -1)
    around = _find(spans, valid, b, a, (ids, b - a), q, end, None, start)
    rest = np.flatnonzero(lines & (around < 0))
    q, s, e = q[rest], start[rest], end[rest]
    choices = [
        _find(spans, valid, b, a, (ids, -(a + b)), q, None, e, s),
        _find(spans, valid, a, -b, (ids, a + b), q, s, None, -e),
        _find(spans, valid, a, b, (ids, a - b), q, s, None, e),
    ]
    near = _first(spans, s, e, choices, False)
    out[rest] = np.where(near >= 0, near, out[rest])
    return np.where(lines & (around >= 0), around, out)


def innermost(spans: Arrays, asked: Arrays) -> np.ndarray:
    """The shortest span around a line, the last that begins, the first id."""
    p, a, b, valid = spans
    q, line, _, _ = asked
    return _find(spans, valid, b, a, (np.arange(len(p)), -a, b - a), q, line, None, line)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(0).to_numpy()


def best(asked: DataFrame, key: str, start: str, end: str, symbols: DataFrame, scope: list[str], choose: Callable[[Arrays, Arrays], np.ndarray]) -> DataFrame:
    """Each row of asked (key, path, start, end) with the symbol of its path that `choose` gives: (*scope, key, path, line_start, line_end, symbol_id, a, b).

    Rows and symbols are dealt by path and sorted; no pair of them is ever a row, and a task holds one path or BATCH_ROWS at a time.
    """
    keys, batch_rows = [*scope, "path"], BATCH_ROWS
    known = lambda rows: rows.where(" and ".join(f"`{c}` is not null" for c in keys))
    lines = lambda a, b: [F.col(a).cast("long").alias("line_start"), F.col(b).cast("long").alias("line_end")]
    none = lambda rows, name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    mine = asked.select(*keys, key, none(symbols, "symbol_id"), *lines(start, end), F.lit(False).alias("is_symbol"))
    theirs = symbols.select(*keys, none(asked, key), "symbol_id", *lines("line_start", "line_end"), F.lit(True).alias("is_symbol"))
    rows = known(mine).unionByName(known(theirs)).repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, "symbol_id")
    fields = [*keys, key, "line_start", "line_end", "symbol_id"]
    shape = StructType([StructField(c, rows.schema[c].dataType) for c in fields] + [StructField("a", LongType()), StructField("b", LongType())])

    def answer(table: pa.Table, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        is_symbol = table["is_symbol"].to_numpy()
        valid = pc.and_(pc.is_valid(table["line_start"]), pc.is_valid(table["line_end"])).to_numpy()
        a, b = _numbers(table["line_start"]), _numbers(table["line_end"])
        s, q = np.flatnonzero(is_symbol), np.flatnonzero(~is_symbol)
        p = codes - codes[0]
        chosen = choose((p[s], a[s], b[s], valid[s]), (p[q], a[q], b[q], valid[q]))
        if choose is not containing:
            chosen = np.where(valid[q], chosen, -1)
        if not len(q):
            return
        none = chosen < 0
        taken = pa.array(s[np.where(none, 0, chosen)] if len(s) else np.zeros(len(q), np.int64), mask=none)
        found = table.take(pa.array(q)).select(fields[:-1])
        for name, column in (("symbol_id", "symbol_id"), ("a", "line_start"), ("b", "line_end")):
            found = found.append_column(name, table[column].take(taken))
        yield from found.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes, n, code, last = [], [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = np.zeros(batch.num_rows, bool)
            for name in keys:
                c = batch.column(name)
                begins[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            tail = [batch.column(name)[batch.num_rows - 1].as_py() for name in keys]
            begins[0] = last is not None and [batch.column(name)[0].as_py() for name in keys] != last
            place = code + np.cumsum(begins)
            starts = np.flatnonzero(begins)
            if n + batch.num_rows >= batch_rows and len(starts) and n + starts[-1]:
                cut = int(starts[-1])
                yield from answer(pa.Table.from_batches([*held, batch.slice(0, cut)]), np.concatenate([*codes, place[:cut]]))
                held, codes, n = [], [], 0
                code, last = place[-1], tail
                batch, place = batch.slice(cut), place[cut:]
            held.append(batch)
            codes.append(place)
            n, code, last = n + batch.num_rows, place[-1], tail
        if n:
            yield from answer(pa.Table.from_batches(held), np.concatenate(codes))

    lost = mine.where(" or ".join(f"`{c}` is null" for c in keys)).select(*fields[:-1], "symbol_id", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    return rows.mapInArrow(run, shape).unionByName(lost)
