"""URL filtering by rules, and by the likelihood ratio of two character models for all that no rule decides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import stored

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest context of the models, in bytes. A window is a context with the byte after it, and fits into a long.
ORDER = 5
#: Weight of the next shorter context against a context's own counts.
SHARE = 2.0
#: One of this many labelled URLs calibrates the threshold, the others train the models.
FOLDS = 5
#: Bins of the calibration histogram, over log-likelihood differences a byte from -SPAN to SPAN.
BINS, SPAN = 2000, 4.0
#: Log-likelihood differences are summed as integers of this many parts, so that no order of summing matters.
PARTS = 1 << 20


def host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is no ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_fits(host_col: Column, path_col: Column, rule: tuple[str, str, str]) -> Column:
    name, prefix, _ = rule
    return ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(prefix)


def match_rules(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add `rule` (host and path of the longest rule that fits, or null) and `ruled` (its verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = rule_fits(F.col("host"), F.col("path"), r)
        rule, verdict = F.when(fits, r[0] + r[1]).otherwise(rule), F.when(fits, r[2]).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("ruled", verdict)


_FOLDED = np.arange(256, dtype=np.int64)
_FOLDED[65:91] += 32


def url_windows(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and window of each byte of the URLs without scheme, A-Z as a-z, with a start before and an end behind."""
    parts = [(u or "").partition("://")[2].encode() or (u or "").encode() for u in urls]
    data = _FOLDED[np.frombuffer(b"".join(b"\x02" * ORDER + p + b"\x03" for p in parts), np.uint8)]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    row = np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(len(row)) + ORDER * (row + 1)
    out = np.zeros(len(row), np.int64)
    for k in range(ORDER, -1, -1):
        out = out << 8 | data[at - k]
    return row, out


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A column url and others in; for each URL its distinct windows, with their number c, out."""
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            row, window = url_windows(part.column(0).to_pylist())
            order = np.lexsort([window, row])
            row, window = row[order], window[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (window[1:] != window[:-1])])) if len(row) else np.zeros(0, np.int64)
            taken = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in part.columns[1:]), pa.array(window[first]), pa.array(np.diff(np.append(first, len(row))))], names=[*part.schema.names[1:], "window", "c"])


def _spread(df: DataFrame, columns: str) -> DataFrame:
    return df.mapInArrow(spread, f"{columns}, window long, c long")


class Short:
    """Counts of the contexts of no byte and of one, by class: tables of 256 and 65,536 cells, whatever the corpus."""

    def __init__(self, counts: np.ndarray) -> None:
        self.pairs = counts.reshape(2, 256, 256)

    def probability(self, window: np.ndarray) -> np.ndarray:
        """Probabilities of a window's last byte under both classes, from these contexts."""
        before, byte = window >> 8 & 0xFF, window & 0xFF
        none, one = self.pairs.sum(1), self.pairs.sum(2)
        p = (none[:, byte] + SHARE / 256) / (none.sum(1)[:, None] + SHARE)
        return (self.pairs[:, before, byte] + SHARE * p) / (one[:, before] + SHARE)


def ratios(batches: Iterator[pa.RecordBatch], short: Short) -> Iterator[pa.RecordBatch]:
    """Rows (near, window, accepted, rejected), sorted by near, the two bytes before a window's last: a window's log-likelihood difference out.

    Each class interpolates: a context adds its counts to the probability from the next shorter one.
    All windows that share their two nearest bytes are together, so every longer context is whole.
    """
    held: list[list[np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        window, *counts = (np.concatenate(c) for c in zip(*held, strict=True))
        counts = np.array(counts, np.float64)
        p = short.probability(window)
        for order in range(2, ORDER + 1):
            bits = 8 * order
            gram, context = (np.unique(window & ((1 << bits + 8) - 1), return_inverse=True)[1], np.unique(window >> 8 & ((1 << bits) - 1), return_inverse=True)[1])
            for k in (0, 1):
                n_gram, n_context = np.bincount(gram, counts[k])[gram], np.bincount(context, counts[k])[context]
                p[k] = (n_gram + SHARE * p[k]) / (n_context + SHARE)
        ratio = np.rint((np.log(p[0]) - np.log(p[1])) * PARTS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(window), pa.array(ratio)], names=["window", "ratio"])

    name = None
    for batch in batches:
        near, *columns = (c.to_numpy() for c in batch.columns)
        cuts = np.concatenate([[0], np.flatnonzero(near[1:] != near[:-1]) + 1, [len(near)]]) if len(near) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if near[a] != name:
                if held:
                    yield from flush()
                name, held = near[a], []
            held.append([c[a:b] for c in columns])
    if held:
        yield from flush()


def window_ratios(labelled: DataFrame, urls: DataFrame) -> DataFrame:
    """(window, ratio) of all windows of `urls`, under models of all rows of labelled (url, accepted). Counts are exact, and shuffled by window."""
    spark = labelled.sparkSession
    trained = _spread(labelled.select("url", "accepted"), "accepted boolean").groupBy("window").agg(F.sum(F.when(F.col("accepted"), F.col("c")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("c"))).alias("no"))
    trained = stored(trained, "windows")
    pair = F.col("window").bitwiseAND(F.lit(0xFFFF))
    table = np.zeros((2, 65536))
    for r in trained.groupBy(pair.alias("pair")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect():  # 65,536 rows at most
        table[:, r["pair"]] = r["yes"], r["no"]
    short = spark.sparkContext.broadcast(Short(table))
    needed = urls.select("url").mapInArrow(spread, "window long, c long").select("window").distinct()
    rows = needed.join(trained, "window", "full").select(F.shiftright("window", 8).bitwiseAND(F.lit(0xFFFF)).alias("near"), "window", F.coalesce("yes", F.lit(0)).alias("yes"), F.coalesce("no", F.lit(0)).alias("no"))
    return stored(rows.repartition("near").sortWithinPartitions("near").mapInArrow(lambda b: ratios(b, short.value), "window long, ratio long"), "ratios")


def _keys() -> list[Column]:
    """96 bits that name a URL."""
    url = F.coalesce("url", F.lit(""))
    return [F.xxhash64(url).alias("h"), F.crc32(url).alias("g")]


def differences(urls: DataFrame, ratio: DataFrame) -> DataFrame:
    """(h, g, difference): log-likelihood of each distinct URL under accepted less that under rejected, over its bytes."""
    distinct = urls.select("url", *_keys()).dropDuplicates(["h", "g"])
    joined = _spread(distinct, "h long, g long").join(ratio, "window")
    return joined.groupBy("h", "g").agg((F.sum(F.col("c") * F.col("ratio")) / F.sum("c") / PARTS).alias("difference"))


def fit(labelled: DataFrame, urls: DataFrame) -> tuple[DataFrame, float]:
    """Window ratios for all of `urls`, and the threshold, from all rows of (url, accepted).

    Every URL but one in FOLDS (by crc32 of the url) is counted; the others set the threshold where
    the two classes' error rates have the least sum, the middle of the best bins. Nothing of the
    model's size is broadcast or collected. Without rows of both classes the threshold is 0.
    """
    fold = F.crc32(F.coalesce("url", F.lit(""))) % FOLDS
    apart = labelled.where(fold == 0).select("url", "accepted")
    ratio = window_ratios(labelled.where(fold != 0), urls.select("url").unionAll(apart.select("url")))
    scored = apart.select("accepted", *_keys()).join(differences(apart, ratio), ["h", "g"])
    bin_of = F.least(F.greatest(F.floor((F.col("difference") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS - 1)).cast("int")
    histogram = np.zeros((2, BINS))
    for r in scored.groupBy("accepted", bin_of.alias("bin")).count().collect():
        histogram[int(r["accepted"]), r["bin"]] += r["count"]
    return ratio, threshold(histogram)


def threshold(histogram: np.ndarray) -> float:
    totals = histogram.sum(1)
    if not totals.all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(histogram, 1)], 1) / totals[:, None]
    errors = below[1] + 1 - below[0]
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 * (2 * SPAN / BINS) - SPAN)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Host, path, rule and verdict of each url.

    A rule decides where one fits. Elsewhere the url is allowed if its log-likelihood difference a
    byte reaches the calibrated threshold. `labelled` (url, accepted) trains the models; by default
    the urls that rules decide do, all of them. A null url, or one without ://, has an empty host and
    path, and is judged by the models, a null one as the empty text. Repeated rows keep a row each and
    count each in the models; equal differences have equal verdicts. An empty table gives an empty
    result; other columns are ignored.
    """
    rows = match_rules(pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules)
    if labelled is None:
        labelled = rows.where("ruled is not null").select("url", (F.col("ruled") == "allow").alias("accepted"))
    ratio, least = fit(labelled, rows)
    scored = rows.select("*", *_keys()).join(differences(rows, ratio), ["h", "g"], "left")
    own = F.when(F.col("difference") >= least, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.col("difference").alias("log_likelihood_difference"))
