"""State of the control tables: manifest, branches, jobs, leases, projects, workspaces. Each step takes tables and gives the new ones."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions import scoring
from seamline.operators.versions import upsert

# Columns and keys of the control tables.
SCHEMAS = {
    "projects": "project_id string, repo_root string, display_name string, default_ref string, vcs_mode int, schema_version int, parser_version int, created_at timestamp, updated_at timestamp",
    "file_manifest": "repo string, ref string, path string, content_hash string, size_bytes long, mtime_ns long, language string, indexed_at timestamp",
    "branch_state": "repo string, ref string, merge_base_commit string, last_indexed_commit string, overlay_dir string, file_count int, symbol_count int, is_default_branch int, status string, eviction_eligible_at timestamp, created_at timestamp, last_accessed_at timestamp",
    "branch_tombstones": "repo string, ref string, path string, tombstone_type string, created_at timestamp",
    "worktree_leases": "repo string, ref string, worktree_path string, owner_pid int, refcount int, status string, created_at timestamp, last_used_at timestamp, updated_at timestamp",
    "index_jobs": "job_id string, project_id string, ref string, mode string, head_commit string, sync_id string, status string, changed_files int, duration_ms long, error_message string, retry_count int, progress_token string, files_scanned int, files_indexed int, symbols_extracted int, created_at timestamp, updated_at timestamp",
    "known_workspaces": "workspace_path string, project_id string, auto_discovered int, last_used_at timestamp, index_status string",
    "semantic_enrichment_queue": "id long, project_id string, ref string, path string, generation long, status string, retry_count int, last_error_code string, enqueued_at timestamp, started_at timestamp, completed_at timestamp, next_attempt_at timestamp",
}
KEYS = {
    "projects": ["project_id"],
    "file_manifest": ["repo", "ref", "path"],
    "branch_state": ["repo", "ref"],
    "branch_tombstones": ["repo", "ref", "path"],
    "worktree_leases": ["repo", "ref"],
    "index_jobs": ["job_id"],
    "known_workspaces": ["workspace_path"],
    "semantic_enrichment_queue": ["project_id", "ref", "path", "generation"],
}
ACTIVE = ("queued", "running", "validating")
#: Rows that a worker takes in one cycle at most, and the seconds it may take.
BATCH, CYCLE_SECONDS = 32, 15


def put(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new in place of those of their key. What a branch or workspace was first seen with, its created_at, stays."""
    if "created_at" in new.columns and name in ("branch_state", "worktree_leases", "projects"):
        first = old.select(*KEYS[name], F.col("created_at").alias("__first"))
        new = new.join(first, KEYS[name], "left").withColumn("created_at", F.coalesce("__first", "created_at")).select(*new.columns)
    return upsert(old, new, KEYS[name])


def manifest_hashes(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content hash of each asked path (repo, ref, path); null for those the manifest doesn't know."""
    return wanted.join(manifest.select(*KEYS["file_manifest"], "content_hash"), KEYS["file_manifest"], "left")


def dequeued(queue: DataFrame, now: Column, limit: int, per: list[str]) -> DataFrame:
    """The queue after each project and ref has taken its first `limit` due rows: these run. Only a path's last generation is due, first in first out."""
    last = F.max("generation").over(Window.partitionBy(*per, "path"))
    due = (F.col("status") == "pending") & (F.col("generation") == last) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    rows = queue.withColumn("__due", due)
    place = F.row_number().over(Window.partitionBy(*per, "__due").orderBy("enqueued_at", "id"))
    taken = rows.withColumn("__taken", F.col("__due") & (place <= limit))
    started = {"status": F.when(F.col("__taken"), "running").otherwise(F.col("status"))}
    if "started_at" in queue.columns:
        started["started_at"] = F.when(F.col("__taken"), now).otherwise(F.col("started_at"))
    return taken.withColumns(started).withColumn("taken", F.col("__taken")).drop("__due", "__taken")


def completed(queue: DataFrame, outcomes: DataFrame, now: Column, keys: list[str], most_retries: int = 3) -> DataFrame:
    """The queue after a worker's outcomes (keys, error; null if it went well): done, waiting for another attempt, or failed for good.

    An outcome of a row that doesn't run is left aside, as is one of a generation that a later one has replaced.
    """
    rows = queue.join(outcomes.select(*keys, "error", F.lit(True).alias("__told")), keys, "left")
    told = F.col("__told") & (F.col("status") == "running")
    again = F.col("retry_count") < most_retries
    status = F.when(F.col("error").isNull(), "done").when(again, "pending").otherwise("failed")
    final = told & (F.col("error").isNull() | ~again)
    out = {
        "next_attempt_at": F.when(told & F.col("error").isNotNull() & again, F.timestamp_seconds(F.unix_seconds(now) + scoring.backoff_seconds(F.col("retry_count")))).otherwise(F.col("next_attempt_at")),
        "retry_count": F.when(told & F.col("error").isNotNull() & again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        "completed_at": F.when(final, now).otherwise(F.col("completed_at")),
        "last_error_code": F.when(told, F.when(F.col("error").isNotNull(), scoring.worker_error(F.col("error")))).otherwise(F.col("last_error_code")),
        "status": F.when(told, status).otherwise(F.col("status")),
    }
    return rows.withColumns(out).drop("error", "__told")


def worker_cycle(queue: DataFrame, work, now: Column, batch: int, keys: list[str], per: list[str]) -> DataFrame:
    """One cycle: take up to min(batch, BATCH) rows of each project and ref, hand them to `work`, enter its outcomes.

    `work` gets the taken rows and gives (keys, error) for those that it has got to within CYCLE_SECONDS;
    what it leaves out goes back to pending.
    """
    taken = dequeued(queue, now, min(batch, BATCH), per)
    after = completed(taken.drop("taken"), work(taken.where("taken")), now, keys)
    mine = taken.where("taken").select(*keys, F.lit(True).alias("__mine"))
    left = F.col("__mine") & (F.col("status") == "running")
    return after.join(mine, keys, "left").withColumn("status", F.when(left, "pending").otherwise(F.col("status"))).drop("__mine")


def cleaned(queue: DataFrame, now: Column, done_hours: int, failed_hours: int, batch: int, order: list[str]) -> DataFrame:
    """The queue without the `batch` oldest of the finished rows whose time is over, each kind by its own time."""
    age = (F.unix_seconds(now) - F.unix_seconds("completed_at")) / 3600.0
    over = ((F.col("status") == "done") & (age > done_hours)) | ((F.col("status") == "failed") & (age > failed_hours))
    gone = queue.where(over).orderBy("completed_at", *order).limit(batch)
    return queue.join(gone.select(*order), order, "left_anti")


def created(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with the new ones that may begin: of each project and ref one may be active. The earliest of several new ones wins."""
    scope = ["project_id", "ref"]
    busy = jobs.where(F.col("status").isin(*ACTIVE)).select(*scope).distinct()
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(*scope).orderBy("created_at", "job_id"))).where("__n = 1").drop("__n")
    return jobs.unionByName(first.join(busy, scope, "left_anti").select(*jobs.columns))


# States that may follow a job's state.
FOLLOWS = {"queued": ("running", "failed", "interrupted"), "running": ("validating", "published", "failed", "rolled_back", "interrupted"), "validating": ("published", "failed", "rolled_back", "interrupted")}


def moved(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Jobs after changes (job_id, new_status, error_message, updated_at); `rejected` marks those whose state has no such successor, which stay."""
    told = changes.select("job_id", "new_status", F.col("error_message").alias("__error"), F.col("updated_at").alias("__at"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, follow in FOLLOWS.items() for b in follow])
    rows = jobs.join(told, "job_id", "left")
    fits = F.col("new_status").isNotNull() & F.array_contains(allowed, F.concat_ws(">", "status", "new_status"))
    rows = rows.withColumn("rejected", F.col("new_status").isNotNull() & ~fits)
    out = {"error_message": F.when(fits, F.col("__error")).otherwise(F.col("error_message")), "updated_at": F.when(fits, F.col("__at")).otherwise(F.col("updated_at")), "status": F.when(fits, F.col("new_status")).otherwise(F.col("status"))}
    return rows.withColumns(out).drop("new_status", "__error", "__at")


def synced(branches: DataFrame, published: DataFrame, now: Column) -> DataFrame:
    """Branch states after published syncs (repo, ref, commit, file_count, symbol_count): the last commit and counts; a branch not known before begins."""
    told = published.select("repo", "ref", F.col("commit").alias("__c"), F.col("file_count").alias("__f"), F.col("symbol_count").alias("__s"))
    rows = branches.join(told, ["repo", "ref"], "full_outer")
    there = F.col("__c").isNotNull()
    return rows.select(
        "repo", "ref",
        F.when(there, F.col("__c")).otherwise(F.col("last_indexed_commit")).alias("last_indexed_commit"),
        F.when(there, F.col("__f")).otherwise(F.col("file_count")).alias("file_count"),
        F.when(there, F.col("__s")).otherwise(F.col("symbol_count")).alias("symbol_count"),
        F.when(there, "active").otherwise(F.col("status")).alias("status"),
        F.when(there, now).otherwise(F.col("last_accessed_at")).alias("last_accessed_at"),
    )


def remapped(rows: DataFrame, old: str, new: str, column: str = "repo") -> DataFrame:
    """An imported table under the local project; branch states among them are stale until the next sync."""
    mine = F.col(column) == old
    if {"status", "last_indexed_commit"} <= set(rows.columns):
        rows = rows.withColumn("status", F.when(mine, "stale").otherwise(F.col("status")))
    return rows.withColumn(column, F.when(mine, new).otherwise(F.col(column)))


def leased(leases: DataFrame, events: DataFrame) -> DataFrame:
    """Leases (repo, ref, refcount, owner_pid, last_used_at) after acquisitions and releases (repo, ref, delta, owner_pid, at): counts never fall under 0, the last owner counts."""
    told = events.groupBy("repo", "ref").agg(F.sum("delta").alias("__d"), F.max_by("owner_pid", "at").alias("__p"), F.max("at").alias("__at"))
    rows = leases.join(told, ["repo", "ref"], "full_outer")
    count = F.greatest(F.coalesce("refcount", F.lit(0)) + F.coalesce("__d", F.lit(0)), F.lit(0)).cast("int")
    return rows.select("repo", "ref", count.alias("refcount"), F.coalesce("__p", "owner_pid").alias("owner_pid"), F.greatest("__at", "last_used_at").alias("last_used_at"), F.when(count > 0, "active").otherwise("idle").alias("status"))


def registered(workspaces: DataFrame, seen: DataFrame) -> DataFrame:
    """Known workspaces after sightings (workspace_path, project_id, auto_discovered, last_used_at): the last use counts, a project once known stays, and what was named by hand stays so."""
    told = seen.groupBy("workspace_path").agg(F.max("last_used_at").alias("__at"), F.max_by("project_id", "last_used_at").alias("__p"), F.min("auto_discovered").alias("__auto"))
    rows = workspaces.join(told, "workspace_path", "full_outer")
    auto = F.least(F.coalesce("auto_discovered", "__auto"), F.coalesce("__auto", "auto_discovered"))
    return rows.select("workspace_path", F.coalesce("project_id", "__p").alias("project_id"), auto.alias("auto_discovered"), F.greatest("__at", "last_used_at").alias("last_used_at"), F.coalesce("index_status", F.lit("unknown")).alias("index_status"))


def claimed(workspaces: DataFrame, claims: DataFrame) -> DataFrame:
    """Workspaces after claims (workspace_path, claimant) to index them: of those not indexed yet the least claimant gets each."""
    first = claims.groupBy("workspace_path").agg(F.min("claimant").alias("claimant"))
    rows = workspaces.join(first, "workspace_path", "left")
    wins = F.col("claimant").isNotNull() & F.col("index_status").isin("unknown", "failed")
    return rows.withColumn("claimant", F.when(wins, F.col("claimant"))).withColumn("index_status", F.when(wins, "indexing").otherwise(F.col("index_status")))


def recovery_report(jobs: DataFrame) -> DataFrame:
    """Per project: jobs that were cut off, the last of them, and how many are still active."""
    cut = F.col("status") == "interrupted"
    return jobs.groupBy("project_id").agg(F.count_if(cut).alias("interrupted"), F.max_by(F.when(cut, F.col("job_id")), F.when(cut, F.struct("updated_at", "job_id"))).alias("last_interrupted"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))


def is_inside(path: str, roots: list[str]) -> bool:
    """Whether a path, links resolved, is one of the roots or lies in one."""
    real = Path(path).resolve()
    return any(real == (root := Path(r).resolve()) or root in real.parents for r in roots)


def overlay_allowed(data_dir: str, overlay: str) -> bool:
    """Overlay folders may lie in the overlays folder of the data folder, and not be it."""
    return is_inside(overlay, [f"{data_dir}/overlays"]) and Path(overlay).resolve() != Path(f"{data_dir}/overlays").resolve()


def inside(path: Column, roots: list[str]) -> Column:
    """The same for a column of absolute paths without links: dots are resolved by name."""
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    plain = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))
    out = F.lit(False)
    for r in roots:
        root = "/" + "/".join(p for p in r.split("/") if p)
        out = out | (plain == root) | plain.startswith(root.rstrip("/") + "/")
    return path.startswith("/") & out
