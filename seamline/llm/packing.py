"""Sum-of-squares online packing of tokenised documents into windows of fixed length."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
#: Id that ends each document.
END = 1
#: A text of more characters goes through `tokenizers` itself, whose memory and time stay even for any text.
LONG = 1 << 20
#: Most windows that are open at once; beyond it all are closed, which bounds a task's memory to about 4 * WINDOW bytes for each.
OPEN = 4096


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others are counted up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Ids of a byte-level BPE file as `tokenizers` gives them without special tokens added.

    The same merges run in tiktoken, several times faster; a probe text checks that both agree, and
    else, or for a very long text, `tokenizers` does the work.
    """

    PROBE = "It's a test:  naïve ÉTÉ\t\n\n 12345 %%% don't   　日本語 🙂  x___y\r\n end "

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special = special
        byte = _byte_of()
        self.fast = None
        try:
            ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            if self.fast.encode_ordinary(self.PROBE) != self.slow.encode(self.PROBE, add_special_tokens=False).ids:
                self.fast = None
        except KeyError:
            self.fast = None

    def ids(self, text: str) -> list[int]:
        if self.fast is None or len(text) > LONG:
            return self.slow.encode(text, add_special_tokens=False).ids
        if self.split is None or not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        out: list[int] = []
        for part in self.split.split(text):
            out += [self.special[part]] if part in self.special else self.fast.encode_ordinary(part)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total


class SumOfSquares:
    """Places each piece where the sum of squared counts of partially filled windows, by fill level, grows least.

    count[h] is the number of open windows filled to h. A piece of size s that goes from level h to
    h + s changes the sum by 2 * (count[h + s] - count[h]) + 2, by 2 * count[s] + 1 in a new window,
    and by 1 - 2 * count[h] if it fills the window. Ties go to the fullest window.
    """

    def __init__(self, size: int = WINDOW, most: int = OPEN) -> None:
        self.size, self.most = size, most
        self.reset()

    def reset(self) -> None:
        self.count = np.zeros(self.size + 1, np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(self.size + 1)]
        self.n_open = 0

    def add(self, piece: Piece) -> list[list[Piece]]:
        """Windows that are finished by this piece."""
        s, size = len(piece.ids), self.size
        if s == size:
            return [[piece]]
        here = self.count[1 : size - s + 1]
        change = 2 * (self.count[1 + s :] - here) + 2
        change[-1] = 1 - 2 * here[-1]
        change[here == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if change[best] > 2 * self.count[s] + 1:
            window, level = [piece], s
            self.n_open += 1
        else:
            h = best + 1
            window = self.at[h].pop()
            self.count[h] -= 1
            window.append(piece)
            level = h + s
        if level == size:
            self.n_open -= 1
            return [window]
        self.at[level].append(window)
        self.count[level] += 1
        return self.close() if self.n_open > self.most else []

    def close(self) -> list[list[Piece]]:
        """Fill the fullest open windows with cuts from the emptiest ones, so that at most one stays partly filled."""
        windows = [(h, w) for h in range(self.size, 0, -1) for w in self.at[h]]
        self.reset()
        out, first, last = [], 0, len(windows) - 1
        while first <= last:
            level, window = windows[first]
            while level < self.size and first < last:
                h, donor = windows[last]
                piece = donor.pop()
                room = self.size - level
                if len(piece.ids) > room:
                    donor.append(Piece(piece.doc, piece.start, piece.ids[:-room], piece.total))
                    piece = Piece(piece.doc, piece.start + len(piece.ids) - room, piece.ids[-room:], piece.total)
                window.append(piece)
                level += len(piece.ids)
                windows[last] = (h - len(piece.ids), donor)
                if not donor:
                    last -= 1
            out.append(window)
            first += 1
        return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _rows(windows: list[list[Piece]], first: int, with_ids: bool) -> tuple[list[tuple], int]:
    rows = []
    for window in windows:
        offset = 0
        for p in window:
            row = (p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, first, offset)
            rows.append((*row, p.ids.astype(np.int32)) if with_ids else row)
            offset += len(p.ids)
        first += 1
    return rows, first


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    schema = SCHEMA if with_ids else pa.schema(list(SCHEMA)[:-1])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pack_partition(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    packer, enc = SumOfSquares(window), encoder(path)
    sequence = TaskContext.get().partitionId() << 40
    pending: list[tuple] = []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*enc.ids(text.as_py() or ""), end], "<u4")
            for start in range(0, len(ids), window):
                rows, sequence = _rows(packer.add(Piece(doc, start, ids[start : start + window], len(ids))), sequence, with_ids)
                pending += rows
            if len(pending) >= 4096:
                yield _batch(pending, with_ids)
                pending = []
    rows, sequence = _rows(packer.close(), sequence, with_ids)
    if pending := pending + rows:
        yield _batch(pending, with_ids)


def pack(documents: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of `window` tokens: one row per piece, with its ids if with_ids.

    A document of more than `window` tokens is cut into full windows and a rest; a rest is placed
    whole by the sum-of-squares rule, inside its partition. When a partition ends, its open windows
    are filled up with cuts, so that padding is less than a window for each partition and nothing is
    shuffled. A null text counts as empty: its document is the end id alone. Null or repeated
    doc_ids keep a piece of their own, also in equal rows. Sequence ids are unique, not consecutive. An
    empty table gives no pieces; other columns are ignored.
    """
    path = path or tokenizer_path()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(lambda b: pack_partition(b, path, window, end, with_ids), schema)
