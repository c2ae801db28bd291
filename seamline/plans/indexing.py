"""Building and keeping the index: from files to tables, and from a changed snapshot to an overlay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import scoring, text
from seamline.operators import extraction, graph, vectors, versions
from seamline.sources import files as sources
from seamline.sources import tables as sinks
from seamline.sources.shared import materialised


@dataclass(frozen=True)
class Index:
    """Tables of one repo and ref."""

    files: DataFrame
    symbols: DataFrame
    snippets: DataFrame
    edges: DataFrame


def _edges(items: DataFrame, symbols: DataFrame, files: DataFrame, repo: str, ref: str) -> DataFrame:
    """Call and import edges: callers by enclosing span, callees and imports by name, each with its confidence."""
    calls = items.where("item = 'call'").withColumn("call_id", F.sha2(F.concat_ws("|", "path", "line_start", "target"), 256)).dropDuplicates(["call_id"])
    calls = calls.select("call_id", "path", F.col("line_start").alias("line"), text.call_target(F.col("target")).alias("target"), "label")
    callers = graph.enclosing_caller(calls.select("call_id", "path", "line"), symbols)
    callees = graph.resolve_callees(calls.select("call_id", "target"), symbols).drop("target")
    called = calls.join(callers, "call_id").join(callees, "call_id")
    from_calls = called.select(F.col("caller").alias("from_symbol_id"), F.col("callee").alias("to_symbol_id"), F.when(F.col("callee").isNull(), F.col("target")).alias("to_name"), F.lit("calls").alias("edge_type"), "label", F.col("path").alias("source_file"), F.col("line").alias("source_line"))
    raw = items.where("item = 'import'").withColumn("import_id", F.sha2(F.concat_ws("|", "path", "line_start", "target"), 256)).dropDuplicates(["import_id"])
    stems = files.select(F.regexp_replace("path", r"(/(index|__init__|mod))?\.[^./]+$", "").alias("stem"), F.col("path").alias("target_path")).dropDuplicates(["stem"])
    wanted = raw.select("import_id", F.col("target").alias("qualified"), text.last_segment(F.col("target")).alias("name"), F.col("label").alias("stem"), "path", "line_start", "target").join(stems, "stem", "left")
    found = graph.resolve_imports(wanted.select("import_id", "qualified", "name", "target_path"), symbols, files)
    imported = wanted.select("import_id", "path", "line_start", "target").join(found, "import_id")
    from_imports = imported.select(F.concat(F.lit("file::"), "path").alias("from_symbol_id"), "to_symbol_id", F.when(F.col("to_symbol_id").isNull(), F.col("target")).alias("to_name"), F.lit("imports").alias("edge_type"), F.lit(None).cast("string").alias("label"), F.col("path").alias("source_file"), F.col("line_start").alias("source_line"))
    rows = from_calls.unionByName(from_imports)
    none = F.lit(None).cast("string")
    rated = rows.withColumn("c", scoring.edge_confidence(none, F.col("edge_type"), none, F.col("to_symbol_id"), F.col("to_name"), F.col("label")))
    return rated.select(F.lit(repo).alias("repo"), F.lit(ref).alias("ref"), "from_symbol_id", "to_symbol_id", "to_name", "edge_type", F.col("c.bucket").alias("confidence"), F.col("c.provider").alias("edge_provider"), F.col("c.outcome").alias("resolution_outcome"), F.col("c.weight").alias("confidence_weight"), "source_file", "source_line")


def build(files: DataFrame, repo: str, ref: str = "live") -> Index:
    """All tables of a set of files (path, language, content); files are parsed once."""
    items = materialised(extraction.extract(files), "items")
    symbols = materialised(extraction.symbol_rows(items, repo, ref), "symbols")
    edges = materialised(_edges(items, symbols, files, repo, ref), "edges")
    central = graph.file_centrality(edges, symbols).groupBy("path").agg(F.max("centrality").alias("file_centrality"))
    snippets = extraction.snippet_rows(symbols, files).withColumns({"repo": F.lit(repo), "ref": F.lit(ref)})
    snippets = materialised(snippets, "snippets")
    body = snippets.where("chunk_index = 0 and symbol_id is not null").select("symbol_id", F.col("content"))
    symbols = symbols.drop("item", "target", "label", "parent").join(body, "symbol_id", "left").join(central, "path", "left").withColumn("file_centrality", F.coalesce("file_centrality", F.lit(0.0)))
    # every tool reads these several times over
    return Index(materialised(sources.records(files, repo, ref), "files"), materialised(symbols, "symbols"), snippets, edges)


def overlay(base_files: DataFrame, head_files: DataFrame, repo: str, ref: str) -> tuple[Index, DataFrame, DataFrame]:
    """(tables of the changed files, tombstones, actions) that turn a base snapshot into a ref; unchanged files aren't parsed."""
    hashed = lambda rows: rows.select("path", F.sha2("content", 256).alias("content_hash"))
    actions = versions.sync_actions(versions.snapshot_diff(hashed(base_files), hashed(head_files), rename=True))
    touched = actions.where("action <> 'deleted'").select("path").distinct()
    return build(head_files.join(touched, "path", "left_semi"), repo, ref), versions.tombstones(actions), actions


def layered(base: DataFrame, top: DataFrame, dead: DataFrame) -> DataFrame:
    """A table as the ref sees it: the overlay's rows, and the base's on paths that have no tombstone and aren't in the overlay."""
    hidden = dead.select("path").unionAll(top.select("path")).distinct()
    return base.join(hidden, "path", "left_anti").select(*top.columns).unionByName(top)


def publish(index: Index, root: str) -> None:
    """Write all tables; each is swapped in as a whole."""
    for name, rows in (("files", index.files), ("symbols", index.symbols), ("snippets", index.snippets.withColumns({"language": F.lit(None).cast("string"), "parent_symbol_stable_id": F.col("symbol_id")})), ("symbol_edges", index.edges)):
        sinks.publish(sinks.checked(rows, name), f"{root}/{name}")


def embed(index: Index, model: str = "hashed-64", provider=vectors.hashed_embedding) -> DataFrame:
    """Vectors of the snippets by an embedding provider (Column to Column)."""
    rows = index.snippets.where("content is not null")
    return rows.select("repo", "ref", F.col("symbol_id").alias("symbol_stable_id"), F.sha2("content", 256).alias("snippet_hash"), F.lit(model).alias("model"), "path", "line_start", "line_end", provider(F.col("content")).alias("vector"))


def merge_base(commits: DataFrame, a: str, b: str, depth: int = 64) -> str | None:
    """The nearest common ancestor of two commits over (commit, parent); None if there is none within `depth` steps.

    Both lineages go up together, a step a round, and stop at the first round in which they have met;
    each round's new commits are written, so plans stay short.
    """
    spark = commits.sparkSession
    level = materialised(spark.createDataFrame([(a, "a"), (b, "b")], "commit string, side string").withColumn("distance", F.lit(0)), "lineage")
    seen, up = level, commits.where("parent is not null").select("commit", "parent").distinct()
    best = lambda rows: rows.groupBy("commit").agg(F.countDistinct("side").alias("sides"), F.sum("distance").alias("far")).where("sides = 2").orderBy("far", "commit").first()
    for d in range(1, depth + 1):
        if (met := best(seen.groupBy("commit", "side").agg(F.min("distance").alias("distance")))) is not None and met["far"] < d:
            return met["commit"]
        level = level.join(up, "commit").select(F.col("parent").alias("commit"), "side").distinct().join(seen.select("commit", "side"), ["commit", "side"], "left_anti")
        level = materialised(level.withColumn("distance", F.lit(d)), "lineage")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    met = best(seen.groupBy("commit", "side").agg(F.min("distance").alias("distance")))
    return met["commit"] if met else None


def is_ancestor(commits: DataFrame, old: str, new: str) -> bool:
    return merge_base(commits, old, new) == old


def effective_ref(explicit: str | None, head: str | None, fallback: str = "live") -> str:
    return explicit or head or fallback


def scanned(spark: SparkSession, root: str, **options) -> DataFrame:
    return sources.scan(spark, root, **options)


def content_hash(snippet: Column, manifest: Column, *span: Column) -> Column:
    """Hash of a result's text: of its snippet, else of its file, else of its place."""
    return F.coalesce(F.sha2(snippet, 256), manifest, F.sha2(F.concat_ws("|", *span), 256))
