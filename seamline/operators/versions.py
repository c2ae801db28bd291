"""Versions of a code base: snapshot differences, layers with tombstones, symbol changes, manifests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Fixed value: lines from which on texts are told apart by their length alone.
LONGEST = 2000


def snapshot_diff(base: DataFrame, head: DataFrame, rename: bool = False) -> DataFrame:
    """(change, path, old_path) between two snapshots (path, content_hash); with `rename`, a deleted and an added file of one content are one rename.

    Of several files of one content the least paths are matched in order.
    """
    b, h = base.select("path", F.col("content_hash").alias("old_hash")), head.select("path", F.col("content_hash").alias("new_hash"))
    both = b.join(h, "path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    rows = both.withColumn("change", change).where("change is not null")
    if not rename:
        return rows.select("change", "path", F.lit(None).cast("string").alias("old_path"))

    def numbered(kind: str, column: str) -> DataFrame:
        w = Window.partitionBy(column).orderBy("path")
        return rows.where(F.col("change") == kind).select(F.col(column).alias("h"), F.col("path").alias(f"{kind}_path"), F.row_number().over(w).alias("n"))

    moved = numbered("deleted", "old_hash").join(numbered("added", "new_hash"), ["h", "n"], "full_outer")
    renamed = F.col("deleted_path").isNotNull() & F.col("added_path").isNotNull()
    kind = F.when(renamed, "renamed").when(F.col("added_path").isNotNull(), "added").otherwise("deleted")
    out = moved.select(kind.alias("change"), F.coalesce("added_path", "deleted_path").alias("path"), F.when(renamed, F.col("deleted_path")).alias("old_path"))
    return out.unionByName(rows.where("change = 'modified'").select("change", "path", F.lit(None).cast("string").alias("old_path")))


def sync_actions(diff: DataFrame) -> DataFrame:
    """(path, action): a rename deletes the old path and adds the new one."""
    one = lambda path, action: F.struct(path.alias("path"), F.lit(action).alias("action"))
    steps = (
        F.when(F.col("change") == "renamed", F.array(one(F.col("old_path"), "deleted"), one(F.col("path"), "added")))
        .when(F.col("change") == "added", F.array(one(F.col("path"), "added")))
        .when(F.col("change") == "deleted", F.array(one(F.col("path"), "deleted")))
        .otherwise(F.array(one(F.col("path"), "modified")))
    )
    return diff.select(F.explode(steps).alias("s")).select("s.*")


def changed_paths(diff: DataFrame) -> DataFrame:
    return diff.select("path").unionAll(diff.select(F.col("old_path").alias("path"))).where("path is not null").distinct()


def with_path(diff: DataFrame, prefix: str) -> DataFrame:
    """Changes under a path, be it the new or the old one."""
    return diff.where(F.col("path").startswith(prefix) | F.coalesce(F.col("old_path").startswith(prefix), F.lit(False)))


def tombstones(actions: DataFrame) -> DataFrame:
    """Deleted files are marked deleted, modified ones replaced; added ones need no mark."""
    kind = F.when(F.col("action") == "deleted", "deleted").when(F.col("action") == "modified", "replaced")
    return actions.select("path", kind.alias("tombstone")).where("tombstone is not null").distinct()


def merge_layers(base: DataFrame, overlay: DataFrame, dead: DataFrame, key: str = "merge_key") -> DataFrame:
    """Rows of both layers: those of the overlay win by key, and the base's on paths with a tombstone go. `layer` tells where a row is from."""
    top = overlay.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "result_id"))).where("__n = 1").drop("__n")
    alive = base.join(dead.select("path").distinct(), "path", "left_anti").join(top.select(key), key, "left_anti").select(*base.columns)
    return alive.withColumn("layer", F.lit("base")).unionByName(top.withColumn("layer", F.lit("overlay")))


def symbol_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """(stable_id, kind, change) by symbol (stable_id, kind, content_hash, signature); unchanged ones are left out."""
    keys = ["stable_id", "kind"]
    b = base.select(*keys, F.col("content_hash").alias("h0"), F.col("signature").alias("s0"), F.lit(True).alias("in_base"))
    h = head.select(*keys, F.col("content_hash").alias("h1"), F.col("signature").alias("s1"), F.lit(True).alias("in_head"))
    same = F.col("h0").eqNullSafe(F.col("h1")) & F.col("s0").eqNullSafe(F.col("s1"))
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "deleted").when(~same, "modified")
    return b.join(h, keys, "full_outer").select(*keys, change.alias("change")).where("change is not null")


def compare_symbol(base: DataFrame, head: DataFrame) -> DataFrame:
    """Each name's first symbol (by path, line, id) in either ref, side by side: status, what changed, and lines added and removed.

    A symbol whose lines have moved is modified too. Lines are counted by line_delta where both refs have
    the content, else by length.
    """

    def first(rows: DataFrame, tag: str) -> DataFrame:
        w = Window.partitionBy("name").orderBy("path", "line_start", "symbol_id")
        one = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1")
        return one.select("name", *[F.col(c).alias(f"{c}_{tag}") for c in ("signature", "content", "line_start", "line_end")], F.lit(True).alias(f"in_{tag}"))

    rows = first(base, "base").join(first(head, "head"), "name", "full_outer")
    both = F.col("in_base").isNotNull() & F.col("in_head").isNotNull()
    body = ~both | ~F.col("content_base").eqNullSafe(F.col("content_head"))
    signature = ~both | ~F.col("signature_base").eqNullSafe(F.col("signature_head"))
    shifted = ~both | (F.col("line_start_base") != F.col("line_start_head")) | (F.col("line_end_base") != F.col("line_end_head"))
    status = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "deleted").when(body | signature | shifted, "modified").otherwise("unchanged")
    span = lambda tag: F.greatest(F.col(f"line_end_{tag}") - F.col(f"line_start_{tag}"), F.lit(0)) + 1
    alone = lambda tag: F.coalesce(F.nullif(F.size(_lines(F.col(f"content_{tag}"))), F.lit(0)), span(tag))
    delta = line_delta(F.coalesce("content_base", F.lit("")), F.coalesce("content_head", F.lit("")))
    known = F.col("content_base").isNotNull() & F.col("content_head").isNotNull()
    # an empty content has no lines at all
    counted = lambda n, own: F.when(F.col(f"content_{own}") == "", 0).when((F.col("content_base") == "") | (F.col("content_head") == ""), F.size(_lines(F.col(f"content_{own}")))).otherwise(n)
    more = span("head") - span("base")
    added = F.when(F.col("in_base").isNull(), alone("head")).when(F.col("in_head").isNull(), 0).when(known, counted(delta["added"], "head")).otherwise(F.greatest(more, F.lit(0)))
    removed = F.when(F.col("in_base").isNull(), 0).when(F.col("in_head").isNull(), alone("base")).when(known, counted(delta["removed"], "base")).otherwise(F.greatest(-more, F.lit(0)))
    return rows.select("name", status.alias("status"), signature.alias("signature_changed"), body.alias("body_changed"), shifted.alias("line_range_shifted"), added.cast("int").alias("lines_added"), removed.cast("int").alias("lines_removed"))


def _lines(text: Column) -> Column:
    """Lines without their ends; a break at the end of the text begins no further line. Null for null."""
    whole = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n$", "")
    return F.when(text.isNull(), F.lit(None)).when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n"))


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence. Rows of the table are bits of one integer, so a line costs one step however long the other text."""
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << j
    row = mask = (1 << len(b)) - 1
    for x in a.tolist():
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & mask
    return len(b) - row.bit_count()


def _delta(base: pd.Series, head: pd.Series) -> pd.DataFrame:
    def lines(text: str) -> list[str]:
        parts = text.replace("\r\n", "\n").split("\n")
        return parts[:-1] if len(parts) > 1 and parts[-1] == "" else parts

    out = []
    for a, b in zip(map(lines, base), map(lines, head), strict=True):
        if a == b:
            out.append((0, 0))
        elif max(len(a), len(b)) > LONGEST:
            more = len(b) - len(a)
            out.append((max(more, 0), max(-more, 0)) if more else (1, 1))
        else:
            names = {x: i for i, x in enumerate(dict.fromkeys(a + b))}
            common = common_length(np.array([names[x] for x in a], int), np.array([names[x] for x in b], int))
            out.append((len(b) - common, len(a) - common))
    return pd.DataFrame(out, columns=["added", "removed"])


def line_delta(base: Column, head: Column) -> Column:
    """struct(added, removed) of two texts by their longest common sequence of lines; beyond LONGEST lines by length alone, as (1, 1) if that is equal. An empty text counts as one empty line."""
    return F.pandas_udf(_delta, "struct<added:int,removed:int>")(base, head)


def manifest_changes(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state): new and changed files are to be indexed, vanished ones removed, others skipped."""
    s, m = scanned.select("path", F.col("content_hash").alias("now")), manifest.select("path", F.col("content_hash").alias("then"))
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "vanished").when(F.col("now") != F.col("then"), "changed").otherwise("unchanged")
    return s.join(m, "path", "full_outer").select("path", state.alias("state"))


def is_stale(scanned: DataFrame, manifest: DataFrame) -> bool:
    """Whether any scanned file is unknown to the manifest or differs from it."""
    return not scanned.select("path", "content_hash").join(manifest.select("path", "content_hash"), ["path", "content_hash"], "left_anti").isEmpty()


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence | None = None) -> DataFrame:
    """The rows of old whose keys new lacks, and the last row of each key in new. Null keys are equal."""
    fresh = new
    if order:
        fresh = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    kept = old.alias("o").join(fresh.select(*keys).distinct().alias("n"), condition, "left_anti")
    return kept.unionByName(fresh)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")
