"""Shared helpers: Arrow batches as flat byte arrays, rolling hashes, durable intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _TRIM = None
#: Bytes of text that are hashed at once; bounds a worker's memory at about 60 times this.
CHUNK_BYTES = 1 << 18
#: A flat chunk and these bounds are all a hashing pass needs.
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set to a temporary one only where it is unset and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jsc.get() if jsc.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seamline-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def tuned(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches than Spark's default, where nobody has set another number: texts are long, and each worker holds a batch or two."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")
    return spark


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    tuned(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have: these, with underscores before those that it has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def apart(f):
    """For functions that give back the columns of their first argument: no other column than doc_id and text has a name inside that could clash."""

    @wraps(f)
    def run(documents: DataFrame, *args, **options) -> DataFrame:
        names = documents.columns
        inside = documents.toDF(*[n if n in ("doc_id", "text") else f"__c{i}" for i, n in enumerate(names)])
        return f(inside, *args, **options).toDF(*names)

    return run


def trim() -> None:
    """Give freed memory back: workers live on between tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        if name := getattr(df, "stored_at", None):
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class BitFilter:
    """Which residues of numbers occur: 2^25 bits at most, 4 MB. A filter that is full lets more rows through; what passes is joined exactly."""

    def __init__(self, bits: int, bytes_: np.ndarray) -> None:
        self.bits, self.bytes = bits, bytes_

    def has(self, numbers: np.ndarray) -> np.ndarray:
        """Which of these 64-bit numbers may occur."""
        at = (numbers % self.bits).astype(np.int64)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bit_filter(df: DataFrame, number, most: int = 1 << 25) -> BitFilter:
    """A filter of the values of `number` in df, with 1,024 bits a row from 2^21 up to `most`; maps of 32,768 bits come to the driver, no values."""
    number = df.where(number.isNotNull()).select(number.cast("long").alias("number"))
    rows, bits = number.count(), 1 << 21
    while bits < most and bits < 1024 * rows:
        bits *= 2
    # both functions count from 1
    at = F.pmod("number", F.lit(bits)) + 1
    maps = number.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in maps.collect():  # at most most / 32,768 rows of 4 KB
        out[(bucket - 1) << 12 : bucket << 12] = np.frombuffer(bitmap, np.uint8)
    return BitFilter(bits, out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a hash depends on every bit of the input."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * U64(pow(base, filled, 1 << 64))
        filled += step
    return out


class Powers:
    """Powers of the rolling base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        return self.up, self.down


_POWERS = Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse, n of them at least."""
    return _POWERS.upto(n)


def byte_values(fold_case: bool = True) -> np.ndarray:
    """A random 64-bit value for each byte; with fold_case, A-Z have the values of a-z."""
    values = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    if fold_case:
        values[65:91] = values[97:123]
    return values


_FOLDED = byte_values()


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """out[i]: hash of values[:i], from which span_hashes takes any span."""
    up, _ = _POWERS.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _POWERS.upto(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column (null: empty) as one byte array, and the bounds of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or not pa.types.is_large_string(column.type) else column
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about `limit` bytes of text: (rows, bytes, bounds). A longer text is a part of its own."""
    if not batch.num_rows:
        return
    data, bounds = flat_texts(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first), data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last
    trim()


def word_spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes inside each row: starts, ends, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = is_word[data]
    start, end = inside.copy(), inside.copy()
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z as a-z."""
    return span_hashes(prefix_hashes(_FOLDED[data]), starts, ends)


#: Word bytes: all but the ASCII white space.
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Word bytes: digits, letters and all of non-ASCII characters.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
