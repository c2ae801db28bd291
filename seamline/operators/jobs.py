"""Control tables: the enrichment queue, jobs, branches, leases, workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions import scoring

# Backlog from which a queue is degraded, and minutes from which its lag is low, medium, high.
DEGRADED_AT, LAG_MINUTES = 128, (1, 5, 30)


def with_generations(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add `generation`, counting the updates of a key, and `superseded` for all but the last."""
    w = Window.partitionBy(*keys)
    rows = updates.withColumn("generation", F.row_number().over(w.orderBy(*order)))
    return rows.withColumn("superseded", F.col("generation") < F.max("generation").over(w))


def due(queue: DataFrame, keys: list[str], now: Column, limit: int | None = None) -> DataFrame:
    """Pending rows of their key's last generation whose time has come, first in first out; with a limit, of each key the first rows."""
    latest = queue.withColumn("__last", F.max("generation").over(Window.partitionBy(*keys)))
    ready = (F.col("status") == "pending") & (F.col("generation") == F.col("__last")) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    rows = latest.where(ready).drop("__last")
    if limit is None:
        return rows.orderBy("enqueued_at", "id")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("enqueued_at", "id"))).where(F.col("__n") <= limit).drop("__n")


def retried(failed: DataFrame, now: Column, most: int) -> DataFrame:
    """Failed attempts: pending again after a growing pause, or failed for good beyond `most` retries."""
    again = F.col("retry_count") < most
    pause = scoring.backoff_seconds(F.col("retry_count"))
    return failed.select(
        "*",
        F.when(again, "pending").otherwise("failed").alias("new_status"),
        F.when(again, F.timestamp_seconds(F.unix_seconds(now) + pause)).alias("new_attempt_at"),
        F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("new_retry_count"),
    )


def expired(queue: DataFrame, now: Column, done_hours: int = 48, failed_hours: int = 168) -> DataFrame:
    """Finished rows whose time to be kept is over."""
    age = (F.unix_seconds(now) - F.unix_seconds("completed_at")) / 3600.0
    return queue.where(((F.col("status") == "done") & (age > done_hours)) | ((F.col("status") == "failed") & (age > failed_hours)))


def queue_state(queue: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """Per key: backlog, lag, state and why it is degraded."""
    waiting = F.col("status").isin("pending", "running")
    lag = F.floor((F.unix_seconds(now) - F.unix_seconds("enqueued_at")) / 60)
    recent = (F.col("status") == "failed") & (F.unix_seconds("completed_at") >= F.unix_seconds(now) - 3600)
    rows = queue.groupBy(*keys).agg(F.count_if(waiting).alias("backlog"), F.coalesce(F.max(F.when(waiting, lag)), F.lit(0)).alias("lag_minutes"), F.count_if(recent).alias("recent_failures"))
    low, medium, high = LAG_MINUTES
    hint = F.when(F.col("lag_minutes") >= high, "high").when(F.col("lag_minutes") >= medium, "medium").when(F.col("lag_minutes") >= low, "low").otherwise("none")
    failing, large = F.col("recent_failures") > 0, F.col("backlog") >= DEGRADED_AT
    state = F.when(failing | large, "degraded").when(F.col("backlog") > 0, "backlog").otherwise("ready")
    why = F.when(failing, "recent_worker_failures").when(large, "backlog_exceeded_degraded_threshold")
    return rows.withColumns({"lag_hint": hint, "state": state, "degraded_reason": why})


def duplicate_active(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one active job, of which there may be one."""
    active = jobs.where(F.col("status").isin("queued", "running", "validating"))
    return active.groupBy(*keys).agg(F.count(F.lit(1)).alias("active")).where("active > 1")


def interrupted(jobs: DataFrame) -> DataFrame:
    """What was active when the process ended counts as interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running", "validating"), "interrupted").otherwise(F.col("status")))


def recent(rows: DataFrame, keys: list[str], at: str, tie: str, limit: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(tie).desc())
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def evicted(workspaces: DataFrame, at: str, tie: str, most: int) -> DataFrame:
    """All but the `most` automatically found workspaces used last."""
    found = workspaces.where("auto_discovered")
    keep = found.orderBy(F.col(at).desc(), tie).limit(most)
    return found.join(keep.select(tie), tie, "left_anti")


def prunable(branches: DataFrame, leases: DataFrame, default_ref: str, cutoff: Column) -> DataFrame:
    """Overlays of other refs that nobody has used since the cutoff or holds a lease on."""
    old = branches.where((F.col("ref") != default_ref) & (F.col("last_accessed_at") < cutoff))
    return old.join(leases.where("refcount > 0").select("repo", "ref").distinct(), ["repo", "ref"], "left_anti")


def stale_leases(leases: DataFrame, cutoff: Column) -> DataFrame:
    return leases.where((F.col("refcount") <= 0) & (F.col("last_used_at") < cutoff))


def counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def language_histogram(manifest: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("language"), F.lit("")), F.lit("unknown"))
    return manifest.groupBy(name.alias("language")).agg(F.count(F.lit(1)).alias("files"))


def import_rates(resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, resolved and unresolved imports, and their shares."""
    ok = F.col("outcome") == "resolved_internal"
    rows = resolutions.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("resolved"), F.count_if(F.col("outcome") == "unresolved").alias("unresolved"))
    return rows.withColumns({"resolution_rate": F.col("resolved") / F.col("attempts"), "unresolved_rate": F.col("unresolved") / F.col("attempts")})
