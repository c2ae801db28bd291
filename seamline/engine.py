"""The engine's tools over one index: each takes plain arguments or a table of queries and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions import scoring, text
from seamline.operators import context, graph, jobs, policy, ranking, retrieval, semantic, versions
from seamline.plans.indexing import Index, layered


class SymbolNotFound(LookupError):
    """No symbol has this name."""


class AmbiguousSymbol(LookupError):
    """Symbols of several files have this name, and no path tells which is meant."""


class UnknownTool(LookupError):
    """No tool has this name."""


# Names that tools are called by.
TOOLS = ("search_code", "locate_symbol", "find_references", "get_call_graph", "get_symbol_hierarchy", "find_related_symbols", "get_file_outline", "get_code_context", "build_context_pack", "explain_ranking", "suggest_followup_queries", "diff_context", "compare_symbol_between_commits", "list_refs", "index_status")


def _result_id(channel: str, doc: str):
    return F.sha2(F.concat_ws("|", channel, doc), 256)


class Engine:
    """Search, navigation, comparison and context over the tables of one ref."""

    def __init__(self, index: Index, rules: policy.Policy = policy.Policy(mode="off"), search: scoring.Search = scoring.Search(), vectors: DataFrame | None = None) -> None:  # noqa: B008
        self.index, self.rules, self.search, self.vectors = index, rules, search, vectors
        # texts of plans repeat those of every kept table that they read
        index.symbols.sparkSession.conf.set("spark.sql.maxPlanStringLength", "65536")

    def with_overlay(self, top: Index, dead: DataFrame) -> Engine:
        """The same engine as a ref sees it."""
        merged = Index(*(layered(getattr(self.index, n), getattr(top, n), dead) for n in ("files", "symbols", "snippets")), edges=self._edges_of(top, dead))
        return Engine(merged, self.rules, self.search, self.vectors)

    def _edges_of(self, top: Index, dead: DataFrame) -> DataFrame:
        rows = layered(self.index.edges.withColumn("path", F.col("source_file")), top.edges.withColumn("path", F.col("source_file")), dead)
        return rows.drop("path")

    def _sources(self) -> dict[str, DataFrame]:
        return {
            "symbol": self.index.symbols.withColumn("__doc", F.col("symbol_id")),
            "snippet": self.index.snippets.withColumn("__doc", F.concat_ws("|", "path", "line_start", "line_end", "chunk_index")),
            "file": self.index.files.withColumn("__doc", F.col("path")),
        }

    def _known(self) -> DataFrame:
        """What results tell of symbols, snippets and files, by result_id."""
        symbols, snippets, files = self._sources().values()
        none = lambda *cols: {c: F.lit(None).cast("string") for c in cols}
        facts = [
            symbols.withColumns(none("chunk_type", "origin")).withColumns({"channel": F.lit("symbol"), "snippet": F.col("content")}),
            snippets.withColumns(none("kind", "name", "qualified_name", "visibility")).withColumns({"channel": F.lit("snippet"), "snippet": F.col("content"), "file_centrality": F.lit(0.0)}),
            files.withColumns(none("kind", "name", "qualified_name", "visibility", "symbol_id", "chunk_type", "origin")).withColumns({"channel": F.lit("file"), "snippet": F.col("content_head"), "file_centrality": F.lit(0.0), "line_start": F.lit(1), "line_end": F.lit(1)}),
        ]
        columns = ["channel", F.col("__doc").alias("doc_id"), "path", "line_start", "line_end", "kind", "name", "qualified_name", "visibility", "file_centrality", "symbol_id", "snippet", "chunk_type", "origin"]
        rows = [f.select(*columns) for f in facts]
        return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("result_id", _result_id("channel", "doc_id"))

    def _channels(self, queries: DataFrame) -> DataFrame:
        """(query_id, result_id, score) of each channel that a query's intent asks for."""
        asked = text.signature_tokens(F.col("query"))
        limit = max(2 * self.search.limit, 20)
        words = lambda *cols: text.signature_tokens(F.concat_ws(" ", *cols))
        fields = {"symbol": ("name", "qualified_name", "signature", "content"), "snippet": ("content",), "file": ("path", "content_head")}
        ranked = {name: retrieval.search(rows, "__doc", words(*fields[name]), queries, "query_id", asked, limit) for name, rows in self._sources().items()}
        plan = retrieval.channel_plan(queries, "query_id", "query").select("query_id", "channel", "weight")
        return retrieval.fuse(ranked, plan).select("query_id", _result_id("channel", "doc_id").alias("result_id"), "score")

    def _candidates(self, queries: DataFrame) -> DataFrame:
        """Rows of the lexical branch and, where there are vectors of symbols and of the queries (embedding), of the semantic one, with all that is known of them."""
        found = self._channels(queries).withColumn("provenance", F.lit("lexical"))
        if self.vectors is not None and "embedding" in queries.columns:
            order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "result_id")
            lexical = found.select("query_id", F.col("result_id").alias("key"), "score", F.row_number().over(order).alias("rank"))
            top = lexical.groupBy("query_id").agg(F.max("score").alias("top"))
            gate = scoring.semantic_gate(F.lit("hybrid"), scoring.intent(F.col("query"))["intent"], F.lit(self.search.semantic_ratio), scoring.normalised(F.coalesce("top", F.lit(0.0))), self.search)
            asked = queries.join(top, "query_id", "left").withColumn("gate", gate)
            rows = self.vectors.select(F.col("symbol_stable_id").alias("vec_id"), F.col("vector").alias("embedding")).where("vec_id is not null")
            near = semantic.search(rows, asked, max(3 * self.search.limit, 30)).withColumn("channel", F.lit("symbol"))
            near = near.select("query_id", _result_id("channel", "vec_id").alias("key"), "rank", "score")
            found = semantic.hybrid(lexical, near, self.search.semantic_ratio, max(4 * self.search.limit, 40), max(3 * self.search.limit, 30)).withColumnRenamed("key", "result_id")
        rows = found.join(self._known(), "result_id").join(queries.select("query_id", "query"), "query_id")
        return semantic.adjusted(rows.withColumn("result_type", F.col("channel")))

    def search_code(self, queries: DataFrame, role: str | None = None, explain: bool = False, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Ranked results (query_id, rank, score, ...) of queries (query_id, query).

        Channels by intent, rank fusion, the semantic branch where queries come with an `embedding` and
        the engine has vectors, budgeted rules, policy, an optional reranker over the fused
        rows (it gets and returns them with a column `score`), edges between symbols, removal of
        covered fallbacks, variety of files, and the limit.
        """
        rows = ranking.rule_rerank(self._candidates(queries), explain=explain)
        rows = rows.withColumn("score", F.col("rule_score"))
        if role:
            rows = retrieval.retain_role(rows, role)
        rows = policy.apply(rows, self.rules).drop("block_reason")
        if rerank is not None:
            rows = rerank(rows)
        rows = ranking.structural_boost(rows, ranking.structural_stats(self.index.edges))
        tier = scoring.lexical_tier(F.when(F.lower("name") == F.lower(F.trim("query")), 1).otherwise(0), F.when(F.lower("qualified_name").contains(F.lower(F.trim("query"))), 1).otherwise(0))
        symbol = F.col("result_type") == "symbol"
        rows = rows.withColumn("score", F.when(symbol, F.col("boosted_score")).otherwise(F.col("score"))).withColumn("tier", tier)
        rows = ranking.drop_covered_fallbacks(rows)
        order = Window.partitionBy("query_id").orderBy(F.col("tier").desc(), F.round("score", 9).desc(), "result_id")
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 3 * self.search.limit)
        varied = ranking.file_diversity(ranked.select("query_id", "rank", "path", "score", "result_id"))
        return ranked.drop("rank").join(varied.select("query_id", "result_id", "rank"), ["query_id", "result_id"]).where(F.col("rank") <= self.search.limit)

    def explain_ranking(self, queries: DataFrame, path: str, line: int) -> DataFrame:
        """Signals of one result of each query."""
        rows = self.search_code(queries, explain=True).where((F.col("path") == path) & (F.col("line_start") == line))
        return ranking.reasons(rows)

    def search_metadata(self, queries: DataFrame, results: DataFrame) -> DataFrame:
        """Intent, confidence and suggested action of each query."""
        asked = queries.withColumn("intent", scoring.intent(F.col("query"))["intent"])
        if "provenance" not in results.columns:
            results = results.withColumn("provenance", F.lit("lexical"))
        return ranking.confidence(results, asked, self.search.confidence)

    def locate_symbol(self, name: str, kind: str | None = None, role: str | None = None, language: str | None = None, limit: int | None = None) -> DataFrame:
        return retrieval.locate(self.index.symbols, name, kind, role, language, limit=limit or self.search.limit)

    def _target(self, name: str, path: str | None = None) -> dict:
        """The one symbol of a name, or of a qualified name."""
        for column in ("name", "qualified_name"):
            rows = self.index.symbols.where(F.col(column) == name)
            rows = rows.where(F.col("path") == path) if path else rows
            first = rows.orderBy("path", "line_start", "qualified_name").select("symbol_id", "path").limit(1).collect()
            if first:
                if path is None and column == "name" and not rows.where(F.col("path") != first[0]["path"]).isEmpty():
                    raise AmbiguousSymbol(name)
                return first[0].asDict()
        raise SymbolNotFound(name)

    def find_references(self, name: str, path: str | None = None, kind: str | None = None, limit: int = 0) -> DataFrame:
        target = self.index.symbols.sparkSession.createDataFrame([(self._target(name, path)["symbol_id"],)], "target_id string")
        rows = graph.references(self.index.edges, target, self.index.symbols)
        rows = rows.where(F.col("edge_type") == kind) if kind else rows
        rows = rows.orderBy("source_file", "source_line", "from_symbol_id")
        return rows.limit(limit) if limit else rows

    def get_call_graph(self, name: str, path: str | None = None, direction: str = "both", depth: int = 1, limit: int = 20) -> DataFrame:
        root = self.index.symbols.sparkSession.createDataFrame([(self._target(name, path)["symbol_id"],)], "root string")
        rows = graph.call_graph(self.index.edges.where("edge_type = 'calls'"), root, depth, direction, limit)
        return rows.join(self.index.symbols.select(F.col("symbol_id").alias("symbol"), "name", "path", "line_start"), "symbol", "left")

    def get_symbol_hierarchy(self, name: str, path: str | None = None, direction: str = "ancestors") -> DataFrame:
        own = self._target(name, path)["symbol_id"]
        pairs = graph.ancestors(self.index.symbols.select("symbol_id", "parent_symbol_id"))
        if direction == "ancestors":
            found = pairs.where(F.col("symbol_id") == own).select(F.col("ancestor").alias("symbol_id"), "depth")
        else:
            found = pairs.where(F.col("ancestor") == own).select("symbol_id", "depth")
        return found.join(self.index.symbols, "symbol_id").orderBy("depth", "path", "line_start")

    def find_related_symbols(self, name: str, path: str | None = None, limit: int = 20) -> DataFrame:
        anchor = self.index.symbols.sparkSession.createDataFrame([(self._target(name, path)["symbol_id"],)], "anchor_id string")
        imports = self.index.edges.where("edge_type = 'imports' and to_symbol_id is not null").select("from_symbol_id", "to_symbol_id")
        return graph.related(self.index.symbols, anchor, imports, limit)

    def get_file_outline(self, path: str, top_only: bool = False) -> DataFrame:
        return graph.outline(self.index.symbols, path, top_only)

    def diff_context(self, head: Engine, prefix: str = "") -> DataFrame:
        """Changed symbols between this ref and another, on paths under a prefix."""
        shape = lambda e: e.index.symbols.where(F.col("path").startswith(prefix)).select(F.col("symbol_stable_id").alias("stable_id"), "kind", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), "signature", "path", "name")
        a, b = shape(self), shape(head)
        names = a.select("stable_id", "kind", "name", "path").unionByName(b.select("stable_id", "kind", "name", "path")).dropDuplicates(["stable_id", "kind"])
        return versions.symbol_changes(a, b).join(names, ["stable_id", "kind"])

    def compare_symbol_between_commits(self, head: Engine, name: str) -> DataFrame:
        pick = lambda e: e.index.symbols.where(F.col("name") == name)
        return versions.compare_symbol(pick(self), pick(head))

    def suggest_followup_queries(self, previous: DataFrame) -> DataFrame:
        return ranking.followups(previous)

    def get_code_context(self, queries: DataFrame, max_tokens: int = 4000) -> DataFrame:
        """Results up to the first that no longer fits the budget."""
        rows = self.search_code(queries).withColumn("tokens", text.token_estimate(F.col("snippet")))
        return context.fit_prefix(rows, max_tokens, place="rank")

    def build_context_pack(self, queries: DataFrame, budget_tokens: int = 4000, mode: str = "full", language: str | None = None) -> DataFrame:
        """Results of several probes a query, by section, one a place, as many as fit the budget."""
        made = context.probes(queries, mode, language)
        probe_id = F.concat_ws("\u0000", F.col("query_id").cast("string"), F.col("probe"))
        found = self.search_code(made.select(probe_id.alias("query_id"), F.col("text").alias("query")))
        rows = found.withColumn("query_id", F.substring_index("query_id", "\u0000", 1)).withColumn("symbol_stable_id", F.col("symbol_id"))
        rows = rows.withColumn("section", context.section(F.col("result_type"), F.col("path"), F.col("kind"), F.col("chunk_type"), F.col("snippet")))
        rows = rows.withColumn("tokens", F.greatest(text.token_estimate(F.col("snippet")), F.lit(8)))
        queued = context.queue(context.cluster(rows), mode)
        return queued.join(context.fit_skipping(queued, budget_tokens), ["query_id", "place"])

    def list_refs(self) -> DataFrame:
        return self.index.files.select("repo", "ref").distinct()

    def index_status(self) -> DataFrame:
        counts = [jobs.counts(getattr(self.index, n), ["repo", "ref"]).withColumn("table", F.lit(n)) for n in ("files", "symbols", "snippets", "edges")]
        return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])

    def call(self, tool: str, **arguments) -> DataFrame:
        """A tool by its name; arguments that it doesn't take are an error, as is a name that isn't a tool's."""
        if tool not in TOOLS:
            raise UnknownTool(tool)
        return getattr(self, tool)(**arguments)
