"""Toxicity: obfuscated words are decoded by a noisy channel, then the restored text is scored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import ALNUM, U64, BitFilter, bit_filter, byte_values, chunks, discard, mix, prefix_hashes, span_hashes, stored, word_spans
from seamline.llm.common import apart as keeping_columns

#: Symbols of the character model: a to z, any other letter, and the boundary of a word.
OTHER, EDGE, SYMBOLS = 26, 27, 28
#: Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "abcdefghijklmnopqrstuvwxyz"}
SEPARATORS = " ._-"
#: Costs in nats: a character read as a letter, a separator or repeated letter left out, a word boundary kept, any other character left out.
READ, SKIP, BREAK, DROP = 1.0, 0.2, 4.0, 5.0
WILD = 3.5
#: Most labelled rows that the classifier is fitted on: those with the least hashes of doc_id.
TRAINING_ROWS = 8000
#: Prefixes, in bytes, that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: Toxic rows that a feature has to occur in.
SUPPORT = 3
#: Hash functions under which near copies are found among the toxic training rows.
MINIMA = 3
#: Features that would pass by chance, of all that are tried.
CHANCE = 0.5
#: Weight of the squares of the features' weights against the fit.
RIDGE = 1.0
THRESHOLD = 0.3

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_LEET = np.array([chr(b) in LEET for b in range(256)])
_GAP = np.array([chr(b) in SEPARATORS or b in (9, 10, 13) for b in range(256)])
_SYMBOL = np.full(256, EDGE, np.uint8)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(26)
_SYMBOL[0xC0:] = OTHER
_SYMBOL[0x80:0xC0] = 255

_CHARS = re.escape("".join(LEET))
RUN = re.compile(
    rf"(?<![^\W_])(?:[a-z{_CHARS}][{re.escape(SEPARATORS)}]+){{3,}}[a-z{_CHARS}](?![^\W_])"  # letters set apart
    rf"|(?<![^\W_])[{_CHARS}]{{0,2}}(?:[^\W\d_]+[{_CHARS}]+)+[^\W\d_]*(?![^\W_])|(?<![^\W_])[{_CHARS}]{{1,2}}[^\W\d_]{{2,}}(?:[{_CHARS}]+[^\W\d_]+)*(?![^\W_])"  # letters and look-alikes
    r"|(?<![^\W_])[^\W_]*?([a-z])\1\1[^\W_]*+",  # a letter three times
    re.IGNORECASE,
)
#: Look-alikes behind a letter at the end of a run: part of the word, or punctuation and numbers that stay as they are for the cost of one that is left out.
TAIL = re.compile(rf"(?<=[^\W\d_])[{_CHARS}]+\Z")
#: Readings of runs up to this length are kept for the next time; longer ones are read each time, with no character more than three times in a row.
LONGEST = 48
REPEATED = re.compile(r"(.)\1{3,}", re.DOTALL)


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of symbols in all texts of a task."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for _, data, bounds in chunks(batch):
            s = np.insert(_SYMBOL[data], bounds, EDGE)
            s = s[s != 255].astype(np.int32)
            if len(s) > 2:
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])


class CharacterModel:
    """Negative log probabilities of a symbol after two others, interpolated with shorter contexts."""

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        one = (c.sum((0, 1)) + 1) / (c.sum() + SYMBOLS)
        two = (c.sum(0) + 8 * one) / (c.sum(0).sum(1, keepdims=True) + 8)
        three = (c + 8 * two) / (c.sum(2, keepdims=True) + 8)
        self.costs = (-np.log(three)).tolist()


def _options(ch: str) -> list[tuple[str, float]]:
    if ch in LEET:
        letters = LEET[ch]
        return [(x, WILD if len(letters) > 3 else READ) for x in letters]
    return [(ch, 0.0)]


def cheapest(run: str, model: CharacterModel) -> tuple[float, str]:
    """Cost and text of the cheapest reading of a run: Viterbi over the lattice of its characters' readings, states being the last two symbols.

    A look-alike is read as one of its letters or left out; a separator is left out or is a word
    boundary; a letter equal to the one before may be left out. The model's cost of each symbol, and
    of the boundary after the last, is added. A state holds its text as a chain of letters, so that
    time and memory are linear in the run.
    """
    costs = model.costs
    Chain = tuple | None
    states: dict[tuple[int, int], tuple[float, Chain]] = {(EDGE, EDGE): (0.0, None)}
    for ch in run.lower():
        after: dict[tuple[int, int], tuple[float, Chain]] = {}

        def offer(state: tuple[int, int], cost: float, chain: Chain, letter: str = "") -> None:
            if state not in after or cost < after[state][0]:  # noqa: B023
                after[state] = (cost, (chain, letter) if letter else chain)  # noqa: B023

        for (a, b), (cost, chain) in states.items():
            if ch in SEPARATORS:
                offer((a, b), cost + SKIP, chain)
                offer((b, EDGE), cost + BREAK + costs[a][b][EDGE], chain, " ")
                continue
            for letter, extra in _options(ch):
                s = ord(letter) - 97 if "a" <= letter <= "z" else OTHER
                offer((b, s), cost + extra + costs[a][b][s], chain, letter)
                if chain and chain[1] == letter:
                    offer((a, b), cost + extra + SKIP, chain)
            if ch in LEET:
                offer((a, b), cost + DROP, chain)
        states = after
    total = {state: cost + costs[state[0]][state[1]][EDGE] for state, (cost, _) in states.items()}
    least = min(total.values())
    return least, min(_spelt(states[state][1]) for state, cost in total.items() if cost == least)


def _spelt(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


def decode(run: str, model: CharacterModel) -> str:
    return cheapest(run, model)[1]


def reading(run: str, model: CharacterModel) -> str:
    """The cheapest reading of a run, look-alikes at its end being read with it or kept as they are."""
    tail = TAIL.search(run)
    if not tail:
        return decode(run, model)
    stem, marks = run[: tail.start()], tail.group()
    kept, rest = cheapest(stem, model)
    # three of one mark are punctuation
    if marks.isdigit() or len(marks) < 3 or len(set(marks)) > 1:
        cost, text = cheapest(run, model)
        if cost < kept + DROP:
            return text
    return (rest if RUN.fullmatch(stem) else stem) + marks


def suspicious(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows that may hold an obfuscated word, from their bytes alone."""
    if len(data) < 2:
        return np.zeros(len(bounds) - 1, bool)
    letter, leet, gap = _LETTER[data], _LEET[data], _GAP[data]
    mark = np.zeros(len(data) + 1, np.int64)
    m = mark[1:]
    word = letter | (data >= 0x80)
    m[:-1] |= ((leet[:-1] & word[1:]) | (word[:-1] & leet[1:])).astype(np.int64)
    m[:-2] |= letter[:-2] & (data[:-2] | 32 == data[1:-1] | 32) & (data[1:-1] | 32 == data[2:] | 32)
    # separators in a row count as one
    at = np.flatnonzero(np.concatenate([[True], ~(gap[1:] & gap[:-1])]))
    if len(at) > 6:
        one, gap = (letter | leet)[at], gap[at]
        m[at[:-6]] |= one[:-6] & gap[1:-5] & one[2:-4] & gap[3:-3] & one[4:-2] & gap[5:-1] & one[6:]
    np.cumsum(mark, out=mark)
    return mark[bounds[1:]] > mark[bounds[:-1]]


class Restorer:
    """Restores the obfuscated words of texts; readings of a run are kept for the next time."""

    def __init__(self, model: CharacterModel) -> None:
        self.model = model
        self.read = lru_cache(maxsize=1 << 16)(lambda run: reading(run, model))

    def text(self, text: str) -> str:
        def word(m: re.Match) -> str:
            run = m.group()
            return self.read(run.lower()) if len(run) <= LONGEST else reading(REPEATED.sub(r"\1\1\1", run.lower()), self.model)

        return RUN.sub(word, text)

    def rows(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same rows with restored texts."""
        hot = suspicious(data, bounds)
        if not hot.any():
            return data, bounds
        raw = data.tobytes()
        parts = [self.text(raw[a:b].decode()).encode() if h else raw[a:b] for a, b, h in zip(bounds[:-1], bounds[1:], hot, strict=True)]
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


_VALUES = byte_values()


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each row's words (words, and prefixes of longer ones): row and feature."""
    starts, ends, first = word_spans(data, bounds, ALNUM)
    prefix = prefix_hashes(_VALUES[data])
    words = span_hashes(prefix, starts, ends)
    row = np.searchsorted(first, np.arange(len(words)), "right") - 1
    rows, found = [row], [words]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        rows.append(row[long])
        found.append(mix(span_hashes(prefix, starts[long], starts[long] + n) + U64(n)))
    return np.concatenate(rows), np.concatenate(found).view(np.int64)


def with_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, its digest, and the least hashes of its five-word sequences under several hash functions (of its words, if there are fewer)."""
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            starts, ends, first = word_spans(data, bounds, ALNUM)
            words = span_hashes(prefix_hashes(_VALUES[data]), starts, ends)
            text = span_hashes(prefix_hashes(_VALUES[data]), bounds[:-1], bounds[1:]).view(np.int64)
            minima = []
            for r in range(rows.num_rows):
                w = words[first[r] : first[r + 1]]
                if len(w) >= 5:
                    at = np.arange(len(w) - 4)
                    w = span_hashes(prefix_hashes(w), at, at + 5)
                minima.append([int(mix(w + U64(k)).min().view(np.int64)) if len(w) else 0 for k in range(MINIMA)])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(text), *(pa.array([m[k] for m in minima], pa.int64()) for k in range(MINIMA))], names=["text", "digest", *(f"m{k}" for k in range(MINIMA))])


def row_counts(batches: Iterator[pa.RecordBatch], model: CharacterModel, bits: BitFilter | None = None) -> Iterator[pa.RecordBatch]:
    """(feature, rows) of a task, for features that pass the filter."""
    restorer = Restorer(model)
    for batch in batches:
        for _, data, bounds in chunks(batch):
            r, f = features(*restorer.rows(data, bounds))
            if bits is not None:
                hit = bits.has(f)
                r, f = r[hit], f[hit]
            pairs = np.unique(np.stack([r, f], 1), axis=0) if len(f) else np.zeros((0, 2), np.int64)
            value, n = np.unique(pairs[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(n, pa.int64())], names=["f", "n"])


def present(restorer: Restorer, found: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in `found`, which is sorted, of the features that rows have, each once."""
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, f = features(*restorer.rows(data, bounds))
    at = np.minimum(np.searchsorted(found, f), len(found) - 1)
    hit = found[at] == f
    pairs = np.unique(np.stack([r[hit], at[hit]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def design(batches: Iterator[pa.RecordBatch], model: CharacterModel, found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns text and toxic in; toxic and the features of each row out."""
    restorer = Restorer(model)
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            r, c = present(restorer, found, data, bounds)
            parts = np.split(c, np.searchsorted(r, np.arange(1, rows.num_rows)))
            yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(parts, pa.list_(pa.int64()))], names=["toxic", "found"])


def logistic(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, n: int, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights of n features and the constant of a logistic regression on a sparse table of ones, by Newton steps of conjugate gradients."""
    w = np.zeros(n + 1)
    penalty = np.append(np.full(n, ridge), 1e-6)

    def forth(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, v[columns], minlength=len(y)) + v[-1]

    def back(u: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, u[rows], minlength=n), u.sum())

    def loss(v: np.ndarray) -> float:
        z = forth(v)
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * v**2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-forth(w)))
        gradient = back(p - y) + penalty * w
        if np.abs(gradient).max() < 1e-7:
            break
        curve = p * (1 - p)
        step, left = np.zeros(n + 1), -gradient
        direction, size = left.copy(), left @ left
        for _ in range(2 * n + 20):
            moved = back(curve * forth(direction)) + penalty * direction
            a = size / (direction @ moved)
            step += a * direction
            left = left - a * moved
            new = left @ left
            if new < 1e-18 * (gradient @ gradient):
                break
            direction, size = left + new / size * direction, new
        scale, now = 1.0, loss(w)
        while scale > 1e-6 and loss(w + scale * step) > now:
            scale /= 2
        w = w + scale * step
    return w[:-1], float(w[-1])


class Scorer:
    """Probability that a row is toxic: a logistic model over all features of the restored text."""

    def __init__(self, model: CharacterModel, found: np.ndarray, weights: np.ndarray, constant: float) -> None:
        self.model, self.found, self.weights, self.constant = model, found, weights, constant

    def scores(self, restorer: Restorer, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        r, c = present(restorer, self.found, data, bounds)
        z = self.constant + np.bincount(r, self.weights[c], minlength=len(bounds) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_rows(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    restorer = Restorer(scorer.model)
    for batch in batches:
        for rows, data, bounds in chunks(batch):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scorer.scores(restorer, data, bounds), pa.float64())], names=[*rows.schema.names, "__score"])


def held_out(doc_id: str):
    """Rows that no label is learnt from: crc32 of the decimal doc_id leaves 2 over 4. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def character_model(documents: DataFrame) -> CharacterModel:
    """Counted over all texts; what comes to the driver is a table of fixed size."""
    cells = documents.select("text").mapInArrow(count_trigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return CharacterModel(counts)


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Scorer:
    """A scorer from the labels of at most `rows` rows that aren't held out.

    Features are words and prefixes of words of the restored texts, of which those are used that chance
    would hardly give so large a share of toxic rows. Exact and near copies among the toxic rows (a
    least hash of their five-word sequences in common) count once. Over them a logistic model is fitted.
    Without labelled texts of both classes nothing scores high.
    """
    sc = documents.sparkSession.sparkContext
    model = character_model(documents)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()  # at most `rows` rows
    n_toxic = sum(r["toxic"] == 1 for r in sample)
    if not 0 < n_toxic < len(sample):
        return Scorer(model, np.zeros(0, np.int64), np.zeros(0), -500.0)
    base = n_toxic / len(sample)
    chosen = F.broadcast(documents.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in sample], "doc_id long, toxic int"))
    texts = stored(documents.select("doc_id", "text").join(chosen, "doc_id").where("text is not null").select("text", "toxic"), "labelled")
    shared = sc.broadcast(model)
    apart = texts.where("toxic = 1").select("text").mapInArrow(with_minima, "text string, digest long, " + ", ".join(f"m{k} long" for k in range(MINIMA)))
    for k in range(MINIMA):
        apart = apart.groupBy(f"m{k}").agg(F.min_by(F.struct("text", "digest", *(f"m{j}" for j in range(k + 1, MINIMA))), "digest").alias("row")).select("row.*")
    apart = stored(apart.select("text", F.lit(1).alias("toxic")), "apart")
    toxic = apart.select("text").mapInArrow(lambda b: row_counts(b, shared.value), "f long, n long").groupBy("f").agg(F.sum("n").alias("c")).where(F.col("c") >= SUPPORT)
    toxic = stored(toxic, "toxic")
    passing = sc.broadcast(bit_filter(toxic, F.col("f")))
    others = texts.where("toxic <> 1").select("text", F.lit(0).alias("toxic"))
    clean = others.select("text").mapInArrow(lambda b: row_counts(b, shared.value, passing.value), "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    tried = toxic.count()
    n = F.col("c") + F.coalesce("n", F.lit(0))
    raw = F.col("c") / n
    # n times the divergence of the share from the base rate bounds the log of the chance to see it
    surprise = n * (raw * F.log(raw / base) + F.when(raw < 1, (1 - raw) * F.log((1 - raw) / (1 - base))).otherwise(0.0))
    telling = (raw > base) & (surprise >= F.log(F.lit(max(tried, 1) / CHANCE)))
    found = np.sort(toxic.join(clean, "f", "left").where(telling).select("f").toArrow().column("f").to_numpy())
    marks = sc.broadcast(found)
    # a row of indices for each of at most `rows` texts
    table = apart.unionAll(others).mapInArrow(lambda b: design(b, shared.value, marks.value), "toxic int, found array<long>").toArrow()
    lists = table.column("found").to_pylist()
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    discard(texts, apart, toxic)
    y = table.column("toxic").to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        # the labelled documents of one class aren't in the table
        return Scorer(model, np.zeros(0, np.int64), np.zeros(0), -500.0)
    weights, constant = logistic(at, np.array([c for x in lists for c in x], np.int64), y, len(found))
    return Scorer(model, found, weights, constant)


def with_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of documents and __score, from 0 to 1. Scores depend on the text alone, so repeated rows score alike; a null text counts as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    columns = ", ".join(f"`{n}` {t}" for n, t in documents.dtypes)
    return documents.mapInArrow(lambda b: score_rows(b, shared.value), f"{columns}, __score double")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it is held out, its score, and the prediction.

    Null and empty texts have the score of a text without telling words. Repeated rows keep a row each,
    with equal scores; an empty table gives an empty result; other columns are ignored.
    """
    rows = with_scores(documents.select("doc_id", "text"), labels)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


@keeping_columns
def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under the threshold, with the same columns; repeated rows, nulls and empty texts are judged like any other."""
    return with_scores(documents, labels).where(F.col("__score") < THRESHOLD).drop("__score")
