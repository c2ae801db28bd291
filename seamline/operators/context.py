"""Context packs: sections, clusters, caps and budgets of tokens or bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions import text

SECTIONS = ("definitions", "usages", "deps", "tests", "config", "docs")
# Rows that a section holds before the rest counts as overflow.
CAPS = {"full": (8, 8, 5, 4, 4, 3), "edit_minimal": (8, 6, 4, 1, 2, 0)}
# Words that find what a language's files depend on.
DEPENDENCY_WORDS = {"rust": "use", "go": "package", "python": "import", "typescript": "import"}
# Names of files that hold dependencies or configuration.
DEPENDENCY_FILES = r"(cargo\.toml|go\.mod|go\.sum|package\.json|pnpm-lock\.yaml|requirements\.txt|pyproject\.toml|pom\.xml)$"
CONFIG_FILES = r"(\.toml|\.yaml|\.yml|\.ini|\.json|dockerfile)$|\.github/workflows"
DOC_FILES = r"(\.md|\.rst|\.txt)$|/docs/|readme"
TEST_FILES = r"/tests/|/test/|_test\.|\.spec\.|tests\.rs$"


def section(result_type: Column, path: Column, kind: Column, chunk_type: Column, snippet: Column) -> Column:
    """The section of a result."""
    path, kind, chunk = F.lower(path), F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(chunk_type, F.lit("")))
    head = F.lower(F.ltrim(F.coalesce(snippet, F.lit(""))))
    dependency = path.rlike(DEPENDENCY_FILES) | head.rlike("^(use|import|from) ") | kind.contains("import") | kind.contains("module")
    test, config, docs = path.rlike(TEST_FILES), path.rlike(CONFIG_FILES), path.rlike(DOC_FILES)
    other = ~(dependency | test | config | docs)
    usage = other & (chunk.rlike("usage|call|reference") | head.contains(" call ") | (result_type == "snippet"))
    return F.when(result_type == "symbol", "definitions").when(usage, "usages").when(dependency, "deps").when(test, "tests").when(config, "config").when(docs, "docs").otherwise("usages")


def section_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), name) - 1


def probes(queries: DataFrame, mode: str, language: str | None = None) -> DataFrame:
    """The searches that a pack makes for each query (query_id, query)."""
    word = DEPENDENCY_WORDS.get(language or "", "import")
    made = [("primary", F.col("query"))]
    if mode == "full":
        made += [("tests_probe", F.concat(F.col("query"), F.lit(" test"))), ("deps_probe", F.concat(F.col("query"), F.lit(f" {word}")))]
    parts = F.array(*[F.struct(F.lit(i).alias("probe_rank"), F.lit(n).alias("probe"), q.alias("text")) for i, (n, q) in enumerate(made)])
    return queries.select("query_id", F.explode(parts).alias("p")).select("query_id", "p.*")


ORDER = ("path", "line_start", "line_end", "result_id")


def cluster(candidates: DataFrame) -> DataFrame:
    """One candidate of each symbol and span: of the first section, the highest score. `duplicates` counts the others."""
    key = F.concat_ws(":", F.coalesce(F.nullif(F.col("symbol_stable_id"), F.lit("")), F.lit("span")), "path", "line_start", "line_end")
    rows = candidates.withColumn("__key", key)
    w = Window.partitionBy("query_id", "__key")
    best = w.orderBy(section_rank(F.col("section")), F.col("score").desc(), *ORDER)
    return rows.withColumn("__n", F.row_number().over(best)).withColumn("duplicates", F.count(F.lit(1)).over(w) - 1).where("__n = 1").drop("__n", "__key")


def queue(candidates: DataFrame, mode: str = "full") -> DataFrame:
    """Add `place`: the best rows of each section, section by section, then what is over their caps. Sections with a cap of 0 are left out."""
    caps = F.element_at(F.create_map(*[x for s, c in zip(SECTIONS, CAPS[mode], strict=True) for x in (F.lit(s), F.lit(c))]), F.col("section"))
    inside = Window.partitionBy("query_id", "section").orderBy(F.col("score").desc(), *ORDER)
    rows = candidates.withColumn("__n", F.row_number().over(inside)).withColumn("__cap", caps).where("__cap > 0").withColumn("overflow", F.col("__n") > F.col("__cap"))
    order = Window.partitionBy("query_id").orderBy("overflow", section_rank(F.col("section")), "__n")
    return rows.withColumn("place", F.row_number().over(order)).drop("__n", "__cap")


def fit_skipping(rows: DataFrame, budget: int, cost: str = "tokens", place: str = "place") -> DataFrame:
    """(query_id, place) of rows that fit one after the other into the budget; a row that doesn't is passed over."""
    ordered = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(cost).cast("long").alias("c")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    taken = F.aggregate(
        "items",
        start,
        lambda a, x: F.when(a["used"] + x["c"] <= budget, F.struct((a["used"] + x["c"]).alias("used"), F.array_append(a["kept"], x["p"].cast("int")).alias("kept"))).otherwise(a),
    )
    return ordered.select("query_id", F.explode(taken["kept"]).alias(place))


def fit_prefix(rows: DataFrame, budget: int, cost: str = "tokens", place: str = "place") -> DataFrame:
    """Rows up to the first that no longer fits."""
    w = Window.partitionBy("query_id").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def fit_payload(rows: DataFrame, payload: Column, limit: int = 64 * 1024, place: str = "place") -> DataFrame:
    """Rows whose JSON list stays under `limit` bytes: two for the brackets, and one for each comma."""
    w = Window.partitionBy("query_id").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length(payload) + F.when(F.row_number().over(Window.partitionBy("query_id").orderBy(place)) > 1, 1).otherwise(0)
    sized = rows.withColumn("__size", size)
    return sized.withColumn("bytes", F.sum("__size").over(w) + 2).where(F.col("bytes") <= limit).drop("__size")


def coverage(kept: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows and tokens of every section of every query, empty ones too."""
    all_sections = queries.select("query_id", F.explode(F.array(*[F.lit(s) for s in SECTIONS])).alias("section"))
    counts = kept.groupBy("query_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    return all_sections.join(counts, ["query_id", "section"], "left").select("query_id", "section", F.coalesce("n", F.lit(0)).alias("items"), F.coalesce("t", F.lit(0)).alias("tokens"))


def source_range(content: Column, first: Column, last: Column, most: int = 40) -> Column:
    """Lines first to last (from 1) of a text, cut after `most` lines."""
    size = F.least(last - first + 1, F.lit(most))
    taken = F.array_join(F.slice(F.split(content, "\n"), first, F.greatest(size, F.lit(0))), "\n")
    return F.when(last - first + 1 > most, F.concat(taken, F.lit("\n..."))).otherwise(taken)


def source_at(rows: DataFrame, files: DataFrame, workspace: DataFrame | None = None, most: int = 40) -> DataFrame:
    """Add `snippet`: lines line_start to line_end of each row's file as its ref has it (files: path, content, and repo and ref where both tables have them), else as the workspace has it, else `fallback`.

    Cut after `most` lines with a mark; without white space around it; null if nothing is left.
    """
    scope = [c for c in ("repo", "ref") if c in rows.columns and c in files.columns]
    joined = rows.join(files.select(*scope, "path", F.col("content").alias("__content")), [*scope, "path"], "left")
    content = F.col("__content")
    if workspace is not None:
        joined = joined.join(workspace.select("path", F.col("content").alias("__plain")), "path", "left")
        content = F.coalesce("__content", "__plain")
    lines = text.lines(content)
    last = F.least(F.col("line_end"), F.size(lines))
    there = (content != "") & (F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start")) & (F.col("line_start") <= F.size(lines))
    taken = F.array_join(F.slice(lines, F.col("line_start"), F.greatest(F.least(last - F.col("line_start") + 1, F.lit(most)), F.lit(0))), "\n")
    cut = F.when(there, F.when(last - F.col("line_start") + 1 > most, F.concat(taken, F.lit("\n..."))).otherwise(taken))
    snippet = F.nullif(F.regexp_replace(F.coalesce(cut, "fallback"), r"^\s+|\s+$", ""), F.lit(""))
    return joined.withColumn("snippet", snippet).drop("__content", "__plain")


def source_line(content: Column, line: Column) -> Column:
    return F.trim(F.try_element_at(F.split(content, "\n"), line))


DETAIL = {
    "location": ("path", "line_start", "line_end", "kind", "name"),
    "signature": ("path", "line_start", "line_end", "kind", "name", "qualified_name", "signature", "language", "visibility"),
}
COMPACT_DROPS = ("snippet", "body_preview", "parent", "related_symbols")


def at_detail(results: DataFrame, level: str = "context", compact: bool = False) -> DataFrame:
    """The columns of a level of detail; context has all, compact drops the bulky ones."""
    keep = [c for c in results.columns if level == "context" or c in DETAIL[level]]
    return results.select(*[c for c in keep if not (compact and c in COMPACT_DROPS)])


def with_relations(results: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """Each result with its parent's name and the names of up to `most` siblings."""
    parents = symbols.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("parent_name"))
    kin = symbols.where("parent_symbol_id is not null").select("parent_symbol_id", "symbol_id", "name", "line_start")
    ranked = results.select("symbol_id", "parent_symbol_id").join(kin.withColumnRenamed("symbol_id", "kin_id"), "parent_symbol_id").where("kin_id <> symbol_id")
    w = Window.partitionBy("symbol_id").orderBy("line_start", "kin_id")
    few = ranked.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy("symbol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ",").alias("siblings"))
    return results.join(parents, "parent_symbol_id", "left").join(few, "symbol_id", "left")
