"""Suffix sorting by induction, with common prefixes carried along and queues that spill to disk.

All suffixes of a text over bytes are sorted as far as DEPTH bytes. Suffixes are of type S if they
are less than the one after them, else of type L; an S suffix after an L suffix is S*. Sorted S*
suffixes induce the L suffixes in ascending, those the S suffixes in descending order: a suffix that
comes out of a queue puts the one before it into the queue of that one's first byte. Queues are
emptied in order of their byte, and entries of one queue come out in the order they went in, so that
the queues together are a priority queue over (byte, order of the rest). With each suffix goes the
length of the prefix it shares with the one before it in its queue: one more than the least value
among the entries that came out since that one's successor did.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Common prefixes count up to this.
DEPTH = 50
#: Entries that leave a queue at once, and bytes of entries that all queues hold in memory.
RUN, MEMORY = 1 << 20, 96 << 20


class Queues:
    """A first-in-first-out queue of (position, common prefix) arrays for each byte; beyond `memory` bytes they go to a temporary file that vanishes with the task."""

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.used, self.file = memory, 0, None
        self.parts: list[list] = [[] for _ in range(256)]

    def put(self, byte: int, positions: np.ndarray, common: np.ndarray) -> None:
        size = positions.nbytes + common.nbytes
        if self.used + size > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile(prefix="seamline-queue-")
            at = self.file.seek(0, 2)
            self.file.write(positions.tobytes())
            self.file.write(common.tobytes())
            self.parts[byte].append((at, len(positions)))
        else:
            self.used += size
            self.parts[byte].append((positions, common))

    def take(self, byte: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next entries, about `most`; None if there are none."""
        taken, n = [], 0
        while self.parts[byte] and n < most:
            a, b = self.parts[byte].pop(0)
            if isinstance(a, np.ndarray):
                self.used -= a.nbytes + b.nbytes
            else:
                self.file.seek(a)
                a, b = np.frombuffer(self.file.read(8 * b), np.int64), np.frombuffer(self.file.read(b), np.uint8)
            taken.append((a, b))
            n += len(a)
        if not taken:
            return None
        return taken[0] if len(taken) == 1 else (np.concatenate([a for a, _ in taken]), np.concatenate([b for _, b in taken]))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes of type S. Equal bytes have the type of the run they are in: S if the next byte is greater. The end counts as less than any byte."""
    last = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    after = np.append(text[last[:-1] + 1].astype(np.int16), -1)
    return np.repeat(after > text[last], np.diff(np.concatenate([[-1], last])))


def range_minima(values: np.ndarray):
    """A function of arrays (i, j), i <= j: least of values[i..j]."""
    levels, size = [values], 1
    while 2 * size <= len(values):
        levels.append(np.minimum(levels[-1][:-size], levels[-1][size:]))
        size *= 2
    flat, starts = np.concatenate(levels), np.cumsum([0, *map(len, levels)])[:-1]

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = np.frexp((j - i + 1).astype(np.float64))[1] - 1
        return np.minimum(flat[starts[k] + i], flat[starts[k] + j + 1 - (1 << k)])

    return least


def _starts(keys: np.ndarray) -> np.ndarray:
    """For each of sorted keys the index of the first that is equal to it."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(new)
    return np.repeat(first, np.diff(np.append(first, len(keys))))


def _rank(keys: np.ndarray) -> np.ndarray:
    """For each key the number of keys less than it."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    if len(keys):
        out[order] = _starts(keys[order])
    return out


def _refine(ranks: np.ndarray, rows: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Tell rows of one rank apart by the values after; rows are all that aren't alone with their rank. Returns those that still aren't."""
    order = np.lexsort([after, ranks[rows]]) if int(after.max(initial=0)) >= 1 << 31 else np.argsort(ranks[rows] << 32 | after)
    rows, after = rows[order], after[order]
    old = ranks[rows]
    whole = _starts(old)
    new = np.concatenate([[True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    ranks[rows] = old + np.repeat(first, size) - whole
    return rows[np.repeat(size, size) > 1]


def _name_substrings(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each S* suffix to the next, under the order of bytes and, for equal bytes, of types (L before S)."""
    ends = np.append(stars[1:] + 1, len(text))
    symbols = np.concatenate([text.astype(np.uint64) * np.uint64(2) + is_s + np.uint64(1), np.zeros(7, np.uint64)])

    def word(rows: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for i in range(7):
            at = stars[rows] + 7 * k + i
            inside = at < ends[rows]
            out = out << np.uint64(9) | np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], np.uint64(0))
        return out

    names = _rank(word(np.arange(len(stars)), 0))
    long, k = np.flatnonzero(ends - stars > 7), 1
    while len(long):
        # only substrings of one rank have to be told apart; a shorter one has no further symbols
        counts = np.bincount(names, minlength=len(names))
        rows = np.flatnonzero(counts[names] > 1)
        rows = rows[np.isin(names[rows], names[long])]
        if not len(rows):
            break
        _refine(names, rows, _rank(word(rows, k)))
        k += 1
        long = long[(ends[long] - stars[long]) > 7 * k]
    return names


def sort_stars(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """S* suffixes in order, as far as DEPTH bytes: the string of substring names is ranked recursively by names of twice the length."""
    names, span = _name_substrings(text, is_s, stars), 1
    rows = np.flatnonzero(np.bincount(names, minlength=len(names))[names] > 1) if len(names) else np.zeros(0, np.int64)
    # a name covers two bytes at least
    while 2 * span < DEPTH + 2 and len(rows):
        after = np.where(rows + span < len(names), names[np.minimum(rows + span, len(names) - 1)] + 1, 0)
        rows = _refine(names, rows, after)
        span *= 2
    return stars[np.argsort(names, kind="stable")]


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length up to DEPTH of the prefix that each suffix shares with the one before it in order."""
    out = np.zeros(len(order), np.uint8)
    alive = np.arange(1, len(order))
    for k in range(DEPTH):
        a, b = order[alive - 1] + k, order[alive] + k
        inside = (a < len(text)) & (b < len(text))
        alive = alive[inside]
        alive = alive[text[a[inside]] == text[b[inside]]]
        if not len(alive):
            break
        out[alive] = k + 1
    return out


def _run_length(text: np.ndarray, at: int) -> int:
    end = at
    while end < len(text) and text[end] == text[at] and end - at < DEPTH:
        end += 1
    return end - at


class _Induction:
    """One pass over the queues, ascending for L suffixes and descending for S suffixes."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, want_s: bool, memory: int) -> None:
        self.text, self.is_s, self.want_s = text, is_s, want_s
        self.queues = Queues(memory)
        #: least common prefix since the last entry of each byte was put
        self.since = np.zeros(256, np.uint8)

    def induce(self, positions: np.ndarray, common: np.ndarray) -> None:
        """Put the suffixes before these into their queues. common[i] is shared with the entry that came out before."""
        if not len(positions):
            return
        before = positions - 1
        valid = np.flatnonzero((before >= 0) & (self.is_s[np.maximum(before, 0)] == self.want_s))
        total = common.min()
        new_since = np.minimum(self.since, total)
        if len(valid):
            byte = self.text[before[valid]]
            order = np.argsort(byte, kind="stable")
            at, byte = valid[order], byte[order]
            first = np.concatenate([[True], byte[1:] != byte[:-1]])
            least = range_minima(common)
            begin = np.where(first, 0, np.concatenate([[0], at[:-1] + 1]))
            shared = least(begin, at)
            shared[first] = np.minimum(shared[first], self.since[byte[first]])
            shared = np.minimum(shared + 1, DEPTH).astype(np.uint8)
            heads = np.flatnonzero(first)
            tails = np.append(heads[1:], len(at)) - 1
            for h, t in zip(heads, tails, strict=True):
                self.queues.put(int(byte[h]), before[at[h : t + 1]], shared[h : t + 1])
            last = at[tails]
            open_end = last + 1 < len(common)
            new_since[byte[tails]] = DEPTH
            if open_end.any():
                new_since[byte[tails[open_end]]] = least(last[open_end] + 1, np.full(open_end.sum(), len(common) - 1))
        self.since = new_since


def sorted_suffixes(text: np.ndarray, memory: int = MEMORY, run: int = RUN):
    """Yield (positions, common prefixes) of all suffixes in descending order, in pieces.

    The order holds as far as DEPTH bytes; common[i] is shared with the entry yielded before. The
    first byte of the text's tail should be one that occurs nowhere else, or the tail long enough, if
    comparisons over its end matter.
    """
    if not len(text):
        return
    is_s = suffix_types(text)
    stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    stars = sort_stars(text, is_s, stars)
    star_common = common_prefixes(text, stars)
    star_bounds = np.searchsorted(text[stars], np.arange(257)) if len(stars) else np.zeros(257, np.int64)
    up = _Induction(text, is_s, False, memory)
    kept = Queues(memory)
    # the last suffix is of type L and has nothing to be induced from
    up.queues.put(int(text[-1]), np.array([len(text) - 1]), np.zeros(1, np.uint8))
    for byte in range(256):
        last = -1
        while (entry := up.queues.take(byte, run)) is not None:
            positions, common = entry
            if last < 0:
                common = np.concatenate([np.zeros(1, np.uint8), common[1:]])
            kept.put(byte, positions, common)
            for a in range(0, len(positions), run):
                up.induce(positions[a : a + run], common[a : a + run])
            last = int(positions[-1])
        a, b = star_bounds[byte], star_bounds[byte + 1]
        if b > a:
            common = star_common[a:b].copy()
            common[0] = 0 if last < 0 else min(_run_length(text, last), _run_length(text, int(stars[a])), DEPTH)
            for x in range(a, b, run):
                up.induce(stars[x : min(b, x + run)], common[x - a : x - a + run])
    up.queues.close()
    down = _Induction(text, is_s, True, memory)
    for byte in range(255, -1, -1):
        last, pieces = -1, []
        while (entry := down.queues.take(byte, run)) is not None:
            positions, common = entry
            if last < 0:
                common = np.concatenate([np.zeros(1, np.uint8), common[1:]])
            pieces.append((positions, common))
            for a in range(0, len(positions), run):
                down.induce(positions[a : a + run], common[a : a + run])
            yield positions, common
            last = int(positions[-1])
        # the L suffixes of this byte, backwards: what an entry shares with the one above it is what that one carries
        held = []
        while (entry := kept.take(byte, run)) is not None:
            held.append(entry)
        if held:
            positions = np.concatenate([p for p, _ in held])[::-1]
            common = np.concatenate([c for _, c in held])[::-1]
            common = np.concatenate([[0 if last < 0 else min(_run_length(text, last), _run_length(text, int(positions[0])), DEPTH)], common[:-1]]).astype(np.uint8)
            for a in range(0, len(positions), run):
                down.induce(positions[a : a + run], common[a : a + run])
            yield positions, common
    down.queues.close()
    kept.close()
