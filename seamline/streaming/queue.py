"""Incremental work: supersession of queued updates, and syncs of index tables, on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GENERATIONS = "key string, id long, generation long, superseded_before long"


def generations(updates: DataFrame, key: str, event_id: str) -> DataFrame:
    """A generation number for each update of a key, counted across micro-batches; all with a smaller number than `superseded_before` are void.

    State is one counter a key. Updates of one batch are numbered in order of their id.
    """

    def number(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        ids = sorted(i for pdf in batches for i in pdf["id"])
        state.update((last + len(ids),))
        yield pd.DataFrame({"key": k[0], "id": ids, "generation": range(last + 1, last + len(ids) + 1), "superseded_before": last + len(ids)})

    rows = updates.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("id"))
    return rows.groupBy("key").applyInPandasWithState(number, GENERATIONS, "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and kind; rows later than `late` are dropped and their state with them."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sync(updates: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of changed files goes to `apply`, which replaces what it touches; a batch that is repeated has the same effect."""
    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
