"""BM25 scores of blocks of queries, worked out document by document: only each task's best rows of a query leave it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from seamline.sources.shared import materialised

#: Queries of a block, and bytes of their terms; a block at a time goes to every task.
BLOCK_QUERIES, BLOCK_BYTES = 2048, 16 << 20
#: Terms of a block that are multiplied as dense matrices; the others go by their postings.
DENSE_TERMS = 1024
#: Scores that a task holds at once.
CELLS = 1 << 21
#: Asked terms up to which a document's other terms are dropped before it is written.
FEW_TERMS = 100_000


def counted(rows: DataFrame, asked: list[str] | None) -> DataFrame:
    """(doc_id, n, texts, length, terms, tfs, lens) of rows (doc_id, lists): a document's distinct terms by text length, among those asked for."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer = batch.column("lists")
            inner = outer.flatten()
            owner = np.asarray(pc.list_parent_indices(outer), np.int64)
            size = pc.list_value_length(inner)
            there, size = pc.is_valid(inner).to_numpy(zero_copy_only=False), size.fill_null(0).to_numpy().astype(np.int64)
            m = batch.num_rows
            count = lambda w: np.bincount(owner, weights=w, minlength=m).astype(np.int64)
            flat = inner.flatten()
            coded = (flat if isinstance(flat, pa.Array) else flat.combine_chunks()).dictionary_encode()
            word, code = coded.dictionary, np.asarray(coded.indices, np.int64)
            row, length = np.repeat(owner, size), np.repeat(size, size)
            if asked is not None:
                keep = pc.is_in(word, value_set=pa.array(asked, word.type)).to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
                row, length, code = row[keep], length[keep], code[keep]
            order = np.lexsort([code, length, row])
            row, length, code = row[order], length[order], code[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (length[1:] != length[:-1]) | (code[1:] != code[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(row)))
            row, length, code = row[first], length[first], code[first]
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=m))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (word.take(pa.array(code)), pa.array(tf.astype(np.int32)), pa.array(length.astype(np.int32)))]
            numbers = [pa.array(v) for v in (count(np.ones(len(owner))), count(there), count(size))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, *lists], ["doc_id", "n", "texts", "length", "terms", "tfs", "lens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n long, texts long, length long, terms array<string>, tfs array<int>, lens array<int>")


class _Block:
    """Some queries with their terms' weights: dense for terms that many documents and queries have, by postings for the others."""

    def __init__(self, rows: list) -> None:
        self.ids = [r["query_id"] for r in rows]
        words, codes, weights, dfs = {}, [], [], []
        for r in rows:
            for term, weight, df in r["terms"]:
                if term not in words:
                    words[term] = len(words)
                    dfs.append(df)
                codes.append(words[term])
                weights.append(weight)
        query = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
        codes = np.array(codes, np.int64)
        asked = np.bincount(codes, minlength=len(words))
        order = np.argsort(-(asked * np.array(dfs, np.float64)), kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        names = list(words)
        self.words = pa.array([names[i] for i in order], pa.string())
        by_code = np.argsort(place[codes], kind="stable")
        self.queries, self.weights = query[by_code].astype(np.int32), np.array(weights)[by_code]
        self.starts = np.append(0, np.cumsum(asked[order]))

    def dense(self) -> np.ndarray:
        f = min(DENSE_TERMS, len(self.words))
        out, n = np.zeros((f, len(self.ids))), self.starts[f]
        out[np.repeat(np.arange(f), np.diff(self.starts[: f + 1])), self.queries[:n]] = self.weights[:n]
        return out

    def rare(self, out: np.ndarray, row: np.ndarray, code: np.ndarray, w: np.ndarray) -> None:
        """Add the scores of postings (row, code, w), some at a time."""
        n, nq = np.diff(self.starts)[code], len(self.ids)
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // CELLS)) + 1
        for part in np.split(np.arange(len(row)), cuts):
            if len(part):
                k = n[part]
                at = np.repeat(self.starts[code[part]] - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(k.sum())
                cell = np.repeat(row[part], k) * nq + self.queries[at]
                out += np.bincount(cell, weights=np.repeat(w[part], k) * self.weights[at], minlength=out.size).reshape(out.shape)


def _against(docs: DataFrame, rows: list, avg_len: float, k1: float, b: float, k: int, shape: StructType):
    """The best k documents of each query of a block in each task, and the block's broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(_Block(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        nq, dense = len(block.ids), block.dense()
        step, f = max(64, min(4096, CELLS // max(nq, len(dense)))), len(dense)
        q_held, s_held, ids = np.zeros(0, np.int64), np.zeros(0), None
        for batch in batches:
            terms = batch.column("terms")
            code = pc.index_in(terms.flatten(), value_set=block.words)
            hit = pc.is_valid(code).to_numpy(zero_copy_only=False)
            row, code = np.asarray(pc.list_parent_indices(terms), np.int64)[hit], code.fill_null(0).to_numpy()[hit].astype(np.int64)
            tf, length = (batch.column(c).flatten().to_numpy()[hit].astype(np.float64) for c in ("tfs", "lens"))
            w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))
            for first in range(0, batch.num_rows, step):
                x, y = np.searchsorted(row, [first, first + step])
                m = min(step, batch.num_rows - first)
                r, c, v = row[x:y] - first, code[x:y], w[x:y]
                often = c < f
                scores = np.bincount(r[often] * f + c[often], weights=v[often], minlength=m * f).reshape(m, f) @ dense
                block.rare(scores, r[~often], c[~often], v[~often])
                rounded = np.round(scores, 9)
                least = np.full(nq, -1.0)
                full = np.bincount(q_held, minlength=nq) >= k
                np.minimum.at(worst := np.full(nq, np.inf), q_held, np.round(s_held, 9))
                least[full] = worst[full]
                if m > k:
                    least = np.maximum(least, np.partition(rounded, m - k, axis=0)[m - k])
                d, q = np.nonzero((rounded >= least) & (scores > 0))
                fresh = batch.column("doc_id").slice(first, m).take(pa.array(d))
                ids = fresh if ids is None else pa.concat_arrays([ids, fresh])
                q, s = np.append(q_held, q), np.append(s_held, scores[d, q])
                place = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense"), np.int64)
                order = np.lexsort([place, -np.round(s, 9), q])
                begin = np.searchsorted(q[order], np.arange(nq))
                order = order[np.arange(len(order)) - begin[q[order]] < k]
                q_held, s_held, ids = q[order], s[order], ids.take(pa.array(order))
        if ids is not None:
            names = pa.array(block.ids).take(pa.array(q_held))
            for a in range(0, len(ids), 10_000):
                yield pa.RecordBatch.from_arrays([names[a : a + 10_000], ids[a : a + 10_000], pa.array(s_held[a : a + 10_000])], ["query_id", "doc_id", "score"])

    return docs.select("doc_id", "terms", "tfs", "lens").mapInArrow(run, shape), shared


def best(docs: DataFrame, queries: DataFrame, avg_len: float, k1: float, b: float, k: int) -> DataFrame:
    """(query_id, doc_id, score) of rows of `counted` and queries (query_id, terms: term, idf, df), among them the best k of each query.

    Queries come in blocks. Where there are several, each block's rows are written before the next
    goes out, so driver and tasks hold one block at a time.
    """
    types = [(n, df.schema[n].dataType) for n, df in (("query_id", queries), ("doc_id", docs))]
    shape = StructType([StructField(n, t) for n, t in types]).add("score", "double")
    out, block, size, spark = [], [], 0, docs.sparkSession

    def flush(last: bool) -> None:
        found, shared = _against(docs, block, avg_len, k1, b, k, shape)
        if last and not out:
            out.append(found)
            return
        out.append(materialised(found, "scores"))
        shared.destroy()

    for row in queries.toLocalIterator():
        if block and (len(block) >= BLOCK_QUERIES or size >= BLOCK_BYTES):
            flush(False)
            block, size = [], 0
        block.append(row)
        size += 64 + 32 * len(row["terms"])
    if not block:
        return spark.createDataFrame([], shape)
    flush(True)
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows
