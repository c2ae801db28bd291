"""Queries over symbols, spans and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators import context, graph, jobs
from seamline.plans.registry import EDGES, SYMBOLS, edges, query, symbols, table

BASE = f"WITH {SYMBOLS}, {EDGES}"


@query(
    f"""{BASE}, c AS (SELECT t.path, count(DISTINCT source_file) AS sources FROM edges e JOIN symbols t ON t.symbol_id = e.to_symbol_id WHERE source_file <> t.path GROUP BY 1) SELECT path, sources, round(sources / max(sources) OVER (), 6) AS centrality FROM c"""
)
def file_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.file_centrality(edges(spark, sf_dir), symbols(spark, sf_dir))
    return rows.select("path", "sources", F.round("centrality", 6).alias("centrality"))


@query(f"{BASE} SELECT e.to_symbol_id, coalesce(f.name, 'unknown') AS from_label, edge_type, count(*) AS n FROM edges e JOIN symbols t ON t.symbol_id = e.to_symbol_id LEFT JOIN symbols f ON f.symbol_id = e.from_symbol_id WHERE t.name = 'red_widget' GROUP BY ALL")
def find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    rows = graph.references(edges(spark, sf_dir), s.where("name = 'red_widget'").select(F.col("symbol_id").alias("target_id")), s)
    return rows.groupBy("to_symbol_id", "from_label", "edge_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT edge_type, count(*) AS n FROM edges WHERE to_symbol_id IS NULL AND (to_name = 'red_widget' OR to_name LIKE '%.red!_widget' ESCAPE '!' OR to_name LIKE '%::red!_widget' ESCAPE '!') GROUP BY 1")
def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.where(graph.unresolved_references(e, "red_widget")).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


#: Most call sites of a root and direction.
SITES = 20
CALLS = f"""{SYMBOLS}, {EDGES}, st AS (SELECT from_symbol_id AS a, to_symbol_id AS b, source_file AS f, line AS l, bucket AS c FROM edges WHERE edge_type = 'calls' AND to_symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a, b, f, l ORDER BY c NULLS FIRST) = 1)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where("edge_type = 'calls'").withColumnsRenamed({"line": "source_line", "bucket": "confidence"})


@query(
    f"""WITH {CALLS}, d1 AS (SELECT a AS root, b AS symbol, f, l, c, row_number() OVER (PARTITION BY a ORDER BY f NULLS FIRST, l, b) AS n FROM st),
 fr AS (SELECT root, symbol, min(n) AS before FROM d1 WHERE symbol <> root AND root NOT IN (SELECT root FROM d1 GROUP BY 1 HAVING count(*) > {SITES}) GROUP BY 1, 2),
 d2 AS (SELECT root, b AS symbol, f, l, c, before FROM fr JOIN st ON a = symbol QUALIFY row_number() OVER (PARTITION BY root, b, f, l ORDER BY before, c NULLS FIRST) = 1),
 e AS (SELECT root, symbol, f, l, 1 AS depth, c, n FROM d1 UNION ALL SELECT root, symbol, f, l, 2, c, row_number() OVER (PARTITION BY root ORDER BY before, f NULLS FIRST, l, symbol) FROM d2),
 p AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, n) AS place, count(*) OVER (PARTITION BY root) > {SITES} AS truncated FROM e)
 SELECT root, symbol, f AS source_file, l AS source_line, depth, c AS confidence, place, truncated FROM p WHERE place <= {SITES}"""
)
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees of every symbol in up to two steps, by call site."""
    roots = symbols(spark, sf_dir).select(F.col("symbol_id").alias("root"))
    return graph.call_graph(_calls(spark, sf_dir), roots, 2, limit=SITES).drop("direction")


@query(f"WITH {CALLS} SELECT b AS root, a AS symbol, f AS source_file, l AS source_line, c AS confidence, row_number() OVER (PARTITION BY b ORDER BY f NULLS FIRST, l, a) AS place FROM st SEMI JOIN symbols ON symbol_id = b")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of every symbol, by call site."""
    roots = symbols(spark, sf_dir).select(F.col("symbol_id").alias("root"))
    return graph.call_graph(_calls(spark, sf_dir), roots, 1, "callers").select("root", "symbol", "source_file", "source_line", "confidence", "place")


@query(
    f"""WITH RECURSIVE {SYMBOLS}, a AS (SELECT symbol_id, parent_symbol_id AS ancestor, 1 AS depth FROM symbols WHERE parent_symbol_id IS NOT NULL UNION ALL SELECT a.symbol_id, s.parent_symbol_id, depth + 1 FROM a JOIN symbols s ON s.symbol_id = a.ancestor WHERE s.parent_symbol_id IS NOT NULL AND depth < 8)
 SELECT symbol_id, ancestor, depth FROM a"""
)
def symbol_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(symbols(spark, sf_dir))


SPANS = f"""{SYMBOLS}, sn AS (SELECT p_partkey AS snippet_id, 'src/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '.rs' AS path, cast(p_partkey * 13 % 960 + 1 AS int) AS line_start, cast(p_partkey * 13 % 960 + 1 + p_size // 2 AS int) AS line_end FROM part)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("p_partkey") * 13 % 960 + 1).cast("int")
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.regexp_replace(F.lower("p_brand"), "#", ""), F.lit(".rs"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("snippet_id"), path.alias("path"), start.alias("line_start"), (start + F.floor(F.col("p_size") / 2)).cast("int").alias("line_end"))


@query(
    f"""WITH {SPANS}, p AS (SELECT n.*, s.symbol_id, s.line_start AS a, s.line_end AS b, abs(s.line_start - n.line_start) + abs(s.line_end - n.line_end) AS off FROM sn n LEFT JOIN symbols s ON s.path = n.path AND s.line_start <= n.line_end AND n.line_start <= s.line_end)
 SELECT snippet_id, symbol_id FROM p QUALIFY row_number() OVER (PARTITION BY snippet_id ORDER BY off = 0 DESC, off, b - a, symbol_id) = 1"""
)
def snippet_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.overlapping_symbol(_spans(spark, sf_dir), symbols(spark, sf_dir))


@query(
    f"""WITH {SPANS}, p AS (SELECT n.*, s.symbol_id, s.line_start AS a, s.line_end AS b, s.line_start <= n.line_start AND s.line_end >= n.line_end AS inside, abs(s.line_start - n.line_start) + abs(s.line_end - n.line_end) AS off FROM sn n LEFT JOIN symbols s ON s.path = n.path)
 SELECT snippet_id, symbol_id FROM p QUALIFY row_number() OVER (PARTITION BY snippet_id ORDER BY inside DESC, CASE WHEN inside THEN b - a END NULLS FIRST, off, symbol_id) = 1"""
)
def embedding_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.containing_symbol(_spans(spark, sf_dir), symbols(spark, sf_dir))


@query(
    f"""WITH {SPANS}, p AS (SELECT n.snippet_id AS call_id, n.path, s.symbol_id, s.line_start AS a, s.line_end AS b FROM sn n LEFT JOIN symbols s ON s.path = n.path AND s.kind IN ('function', 'method') AND n.line_start BETWEEN s.line_start AND s.line_end)
 SELECT call_id, coalesce(symbol_id, 'file::' || path) AS caller FROM p QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY b - a, a DESC, symbol_id) = 1"""
)
def enclosing_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _spans(spark, sf_dir).select(F.col("snippet_id").alias("call_id"), "path", F.col("line_start").alias("line"))
    return graph.enclosing_caller(calls, symbols(spark, sf_dir))


@query(
    f"""WITH {SYMBOLS}, c AS (SELECT s_suppkey AS call_id, CASE s_suppkey % 3 WHEN 0 THEN 'promo::red_widget' WHEN 1 THEN 'lib.hot_gear' ELSE 'nothing' END AS target FROM supplier),
 q AS (SELECT qualified_name, symbol_id FROM symbols QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY path, line_start, symbol_id) = 1), n AS (SELECT name, symbol_id FROM symbols QUALIFY row_number() OVER (PARTITION BY name ORDER BY qualified_name, path, line_start, symbol_id) = 1)
 SELECT call_id, target, coalesce(q.symbol_id, n.symbol_id) AS callee FROM c LEFT JOIN q ON q.qualified_name = target LEFT JOIN n ON n.name = regexp_extract(target, '([^.:]*)$', 1)"""
)
def resolved_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    calls = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("call_id"), F.when(k == 0, "promo::red_widget").when(k == 1, "lib.hot_gear").otherwise("nothing").alias("target"))
    return graph.resolve_callees(calls, symbols(spark, sf_dir))


IMPORTS = f"""{SYMBOLS}, im AS (SELECT c_custkey AS import_id, CASE WHEN c_custkey % 4 = 0 THEN 'promo::red_widget' ELSE 'x::' || c_custkey END AS qualified, CASE WHEN c_custkey % 4 = 1 THEN 'hot_gear' ELSE 'n' || c_custkey END AS name,
  CASE c_custkey % 4 WHEN 2 THEN 'src/promo/brand1.rs' WHEN 3 THEN CASE WHEN c_custkey % 8 = 3 THEN 'vendor/x.rs' END END AS target_path FROM customer)"""


@query(
    f"""WITH {IMPORTS}, q AS (SELECT qualified_name, symbol_id FROM symbols QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY line_start, symbol_id) = 1), n AS (SELECT name, symbol_id FROM symbols QUALIFY row_number() OVER (PARTITION BY name ORDER BY line_start, path, symbol_id) = 1), p AS (SELECT path, symbol_id FROM symbols QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_start, symbol_id) = 1),
 r AS (SELECT import_id, coalesce(q.symbol_id, n.symbol_id, p.symbol_id) AS to_symbol_id, target_path IS NOT NULL AND p.path IS NULL AS outside FROM im LEFT JOIN q ON q.qualified_name = qualified LEFT JOIN n ON n.name = im.name LEFT JOIN p ON p.path = target_path)
 SELECT CASE WHEN to_symbol_id IS NOT NULL THEN 'resolved_internal' WHEN outside THEN 'external_reference' ELSE 'unresolved' END AS outcome, count(*) AS n, count(DISTINCT to_symbol_id) AS targets FROM r GROUP BY 1"""
)
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.resolve_imports(_imports(spark, sf_dir), symbols(spark, sf_dir), symbols(spark, sf_dir).select("path"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("to_symbol_id").alias("targets"))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("import_id"),
        F.when(k % 4 == 0, "promo::red_widget").otherwise(F.concat(F.lit("x::"), k)).alias("qualified"),
        F.when(k % 4 == 1, "hot_gear").otherwise(F.concat(F.lit("n"), k)).alias("name"),
        F.when(k % 4 == 2, "src/promo/brand1.rs").when((k % 4 == 3) & (k % 8 == 3), "vendor/x.rs").alias("target_path"),
    )


@query(
    f"""WITH {IMPORTS}, k AS (SELECT c_mktsegment AS segment, count(*) AS attempts, count(*) FILTER (c_custkey % 4 = 0) AS resolved, count(*) FILTER (c_custkey % 4 <> 0) AS unresolved FROM customer GROUP BY 1) SELECT segment, attempts, resolved, unresolved, round(resolved / attempts, 6) AS resolution_rate FROM k"""
)
def import_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 4 == 0, "resolved_internal").otherwise("unresolved").alias("outcome"))
    return jobs.import_rates(rows, ["segment"]).select("segment", "attempts", "resolved", "unresolved", F.round("resolution_rate", 6).alias("resolution_rate"))


FOLDER, TOP = "regexp_extract({}, '^(.*/)[^/]*$', 1)", "regexp_extract({}, '^([^/]*/)', 1)"
NEAR = f"""WITH {SYMBOLS}, an AS (SELECT symbol_id AS anchor_id, path AS ap FROM symbols), r AS (SELECT anchor_id, s.symbol_id, s.path, s.line_start, CASE WHEN s.path = ap THEN 0 WHEN starts_with(s.path, {FOLDER.format("ap")}) THEN 1 ELSE 2 END AS priority FROM an JOIN symbols s ON s.symbol_id <> anchor_id AND {TOP.format("s.path")} = {TOP.format("ap")})"""


@query(f"{NEAR} SELECT anchor_id, symbol_id, priority, row_number() OVER (PARTITION BY anchor_id ORDER BY priority, path, line_start, symbol_id) AS rank FROM r QUALIFY rank <= 20")
def related_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 symbols of each symbol's file, folder and top folder."""
    return _related(spark, sf_dir, "package")


@query(
    f"""{NEAR}, {EDGES}, im AS (SELECT DISTINCT from_symbol_id AS anchor_id, to_symbol_id AS symbol_id FROM edges WHERE edge_type = 'imports' AND to_symbol_id IS NOT NULL AND from_symbol_id <> to_symbol_id),
 u AS (SELECT * FROM r WHERE priority < 2 UNION ALL SELECT anchor_id, symbol_id, path, line_start, 3 FROM im JOIN symbols USING (symbol_id)), m AS (SELECT anchor_id, symbol_id, path, line_start, min(priority) AS priority FROM u GROUP BY ALL)
 SELECT anchor_id, symbol_id, priority, row_number() OVER (PARTITION BY anchor_id ORDER BY priority, path, line_start, symbol_id) AS rank FROM m QUALIFY rank <= 20"""
)
def module_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 symbols of each symbol's file and folder, and of what it imports."""
    return _related(spark, sf_dir, "module")


def _related(spark: SparkSession, sf_dir: str, reach: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    imports = edges(spark, sf_dir).where("edge_type = 'imports' and to_symbol_id is not null").select("from_symbol_id", "to_symbol_id")
    rows = graph.related(s, s.select(F.col("symbol_id").alias("anchor_id")), imports, 20, reach)
    return rows.select("anchor_id", "symbol_id", "priority", "rank")


@query(f"WITH {SYMBOLS} SELECT symbol_id, name, line_start FROM symbols WHERE path = 'src/promo/brand1.rs' AND parent_symbol_id IS NULL")
def file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.outline(symbols(spark, sf_dir), "src/promo/brand1.rs", top_only=True).select("symbol_id", "name", "line_start")


@query(
    f"""WITH {SYMBOLS}, k AS (SELECT a.symbol_id, b.name, row_number() OVER (PARTITION BY a.symbol_id ORDER BY b.line_start, b.symbol_id) AS n FROM symbols a JOIN symbols b ON a.parent_symbol_id = b.parent_symbol_id AND a.symbol_id <> b.symbol_id),
 f AS (SELECT symbol_id, string_agg(name, ',' ORDER BY n) AS siblings FROM k WHERE n <= 2 GROUP BY 1) SELECT s.symbol_id, p.name AS parent_name, siblings FROM symbols s LEFT JOIN symbols p ON p.symbol_id = s.parent_symbol_id LEFT JOIN f ON f.symbol_id = s.symbol_id"""
)
def symbol_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    return context.with_relations(s, s, 2).select("symbol_id", "parent_name", "siblings")


@query(f"{BASE} SELECT from_symbol_id, to_symbol_id, edge_type, line, site FROM edges WHERE to_symbol_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY from_symbol_id, to_symbol_id, edge_type ORDER BY line, site) = 1")
def distinct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["from_symbol_id", "to_symbol_id", "edge_type"]
    return graph.distinct_edges(edges(spark, sf_dir).where("to_symbol_id is not null").select(*keys, "line", "site"), keys, ["line", "site"])


@query(f"{BASE} SELECT edge_type, confidence_missing, count(*) AS n FROM (SELECT edge_type, bucket IS NULL AS confidence_missing FROM edges) GROUP BY ALL")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.counts(edges(spark, sf_dir).select("edge_type", F.col("bucket").isNull().alias("confidence_missing")), ["edge_type", "confidence_missing"])


#: The same symbols and references in two refs: in the second some symbols are gone and others have moved.
TWO_REFS = f"""{SYMBOLS}, {EDGES}, sy AS (SELECT 'r' AS repo, 'main' AS ref, * FROM symbols UNION ALL SELECT 'r', 'dev', * REPLACE (line_start + 3 AS line_start, line_end + 3 AS line_end) FROM symbols WHERE symbol_id::bigint % 7 <> 0),
 ed AS (SELECT 'r' AS repo, x.ref, e.* FROM edges e, (VALUES ('main', 0), ('dev', 1)) x(ref, k) WHERE k = 0 OR site % 3 <> 0)"""


def _two_refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, e = symbols(spark, sf_dir), edges(spark, sf_dir)
    main = s.select(F.lit("r").alias("repo"), F.lit("main").alias("ref"), *s.columns)
    moved = s.where(F.col("symbol_id").cast("long") % 7 != 0).withColumns({"line_start": F.col("line_start") + 3, "line_end": F.col("line_end") + 3})
    dev = moved.select(F.lit("r").alias("repo"), F.lit("dev").alias("ref"), *s.columns)
    both = e.withColumns({"repo": F.lit("r"), "ref": F.lit("main")}).unionByName(e.where("site % 3 <> 0").withColumns({"repo": F.lit("r"), "ref": F.lit("dev")}))
    return main.unionByName(dev), both


@query(f"WITH {TWO_REFS}, c AS (SELECT t.repo, t.ref, t.path, count(DISTINCT source_file) AS sources FROM ed e JOIN sy t ON t.symbol_id = e.to_symbol_id AND t.ref = e.ref WHERE source_file <> t.path GROUP BY ALL) SELECT ref, path, sources, round(sources / max(sources) OVER (PARTITION BY repo, ref), 6) AS centrality FROM c")
def centrality_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = _two_refs(spark, sf_dir)
    return graph.file_centrality(e, s).select("ref", "path", "sources", F.round("centrality", 6).alias("centrality"))


@query(f"WITH {TWO_REFS} SELECT e.ref, e.to_symbol_id, coalesce(f.name, 'unknown') AS from_label, count(*) AS n FROM ed e JOIN sy t ON t.symbol_id = e.to_symbol_id AND t.ref = e.ref LEFT JOIN sy f ON f.symbol_id = e.from_symbol_id AND f.ref = e.ref WHERE t.kind = 'trait' GROUP BY ALL")
def references_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = _two_refs(spark, sf_dir)
    rows = graph.references(e, s.where("kind = 'trait'").select("repo", "ref", F.col("symbol_id").alias("target_id")), s)
    return rows.groupBy("ref", "to_symbol_id", "from_label").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {TWO_REFS}, d AS (SELECT DISTINCT e.ref, e.to_symbol_id AS root, from_symbol_id AS symbol, source_file, line FROM ed e JOIN sy t ON t.symbol_id = e.to_symbol_id AND t.ref = e.ref WHERE edge_type = 'calls') SELECT ref, root, count(*) AS sites, count(DISTINCT symbol) AS callers FROM d GROUP BY ALL"""
)
def callers_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = _two_refs(spark, sf_dir)
    rows = graph.call_graph(e.where("edge_type = 'calls'").withColumnsRenamed({"line": "source_line", "bucket": "confidence"}), s.select("repo", "ref", F.col("symbol_id").alias("root")), 1, "callers")
    return rows.groupBy("ref", "root").agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("symbol").alias("callers"))


SCOPED_SPANS = f"""{TWO_REFS}, sn AS (SELECT x.ref, p_partkey AS snippet_id, 'src/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '.rs' AS path, cast(p_partkey * 13 % 960 + 1 AS int) AS line_start, cast(p_partkey * 13 % 960 + 1 + p_size // 2 AS int) AS line_end FROM part, (VALUES ('main'), ('dev')) x(ref))"""


def _scoped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    return rows.select(F.lit("r").alias("repo"), F.explode(F.array(F.lit("main"), F.lit("dev"))).alias("ref"), *rows.columns)


@query(
    f"""WITH {SCOPED_SPANS}, p AS (SELECT n.*, s.symbol_id, s.line_start AS a, s.line_end AS b, abs(s.line_start - n.line_start) + abs(s.line_end - n.line_end) AS off, s.line_start <= n.line_start AND s.line_end >= n.line_end AS inside, s.line_start <= n.line_end AND n.line_start <= s.line_end AS meets, s.kind IN ('function', 'method') AND n.line_start BETWEEN s.line_start AND s.line_end AS calls FROM sn n LEFT JOIN sy s ON s.path = n.path AND s.ref = n.ref),
 o AS (SELECT ref, snippet_id, CASE WHEN meets THEN symbol_id END AS overlapping FROM p QUALIFY row_number() OVER (PARTITION BY ref, snippet_id ORDER BY coalesce(meets, false) DESC, off = 0 DESC, off, b - a, symbol_id) = 1),
 c AS (SELECT ref, snippet_id, symbol_id AS containing FROM p QUALIFY row_number() OVER (PARTITION BY ref, snippet_id ORDER BY inside DESC, CASE WHEN inside THEN b - a END NULLS FIRST, off, symbol_id) = 1),
 k AS (SELECT ref, snippet_id, CASE WHEN calls THEN symbol_id ELSE 'file::' || path END AS caller FROM p QUALIFY row_number() OVER (PARTITION BY ref, snippet_id ORDER BY coalesce(calls, false) DESC, b - a, a DESC, symbol_id) = 1)
 SELECT ref, snippet_id, overlapping, containing, caller FROM o JOIN c USING (ref, snippet_id) JOIN k USING (ref, snippet_id)"""
)
def spans_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _two_refs(spark, sf_dir)
    rows = _scoped_spans(spark, sf_dir)
    keys = ["repo", "ref", "snippet_id"]
    calls = rows.select("repo", "ref", F.col("snippet_id").alias("call_id"), "path", F.col("line_start").alias("line"))
    found = graph.overlapping_symbol(rows, s).withColumnRenamed("symbol_id", "overlapping").join(graph.containing_symbol(rows, s).withColumnRenamed("symbol_id", "containing"), keys)
    return found.join(graph.enclosing_caller(calls, s).withColumnRenamed("call_id", "snippet_id"), keys).select("ref", "snippet_id", "overlapping", "containing", "caller")


@query(
    f"""WITH {TWO_REFS}, c AS (SELECT x.ref, s_suppkey AS call_id, 'lib.' || name AS target, name FROM supplier JOIN symbols ON symbol_id = s_suppkey::varchar, (VALUES ('main'), ('dev')) x(ref)),
 n AS (SELECT ref, name, symbol_id FROM sy QUALIFY row_number() OVER (PARTITION BY ref, name ORDER BY qualified_name, path, line_start, symbol_id) = 1), m AS (SELECT ref, name, symbol_id FROM sy QUALIFY row_number() OVER (PARTITION BY ref, name ORDER BY line_start, path, symbol_id) = 1)
 SELECT c.ref, call_id, n.symbol_id AS callee, m.symbol_id AS imported, sy.symbol_id IS NOT NULL AS file_known FROM c LEFT JOIN n ON n.ref = c.ref AND n.name = c.name LEFT JOIN m ON m.ref = c.ref AND m.name = c.name LEFT JOIN sy ON sy.ref = c.ref AND sy.symbol_id = call_id::varchar"""
)
def targets_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _two_refs(spark, sf_dir)
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol_id")).join(symbols(spark, sf_dir).select("symbol_id", "name"), "symbol_id")
    rows = known.select(F.lit("r").alias("repo"), F.explode(F.array(F.lit("main"), F.lit("dev"))).alias("ref"), F.col("symbol_id").cast("long").alias("call_id"), "name", F.concat(F.lit("lib."), "name").alias("target"))
    keys = ["repo", "ref", "call_id"]
    callees = graph.resolve_callees(rows.select(*keys, "target"), s)
    files = s.select("repo", "ref", F.concat(F.lit("f/"), "symbol_id").alias("path"))
    wanted = rows.select("repo", "ref", F.col("call_id").alias("import_id"), F.lit("none::x").alias("qualified"), "name", F.concat(F.lit("f/"), "call_id").alias("target_path"))
    imported = graph.resolve_imports(wanted, s, files).select("repo", "ref", F.col("import_id").alias("call_id"), F.col("to_symbol_id").alias("imported"))
    there = graph.existing_imports(wanted, files).select("repo", "ref", F.col("import_id").alias("call_id"), F.lit(True).alias("known"))
    joined = callees.join(imported, keys).join(there, keys, "left")
    return joined.select("ref", "call_id", "callee", "imported", F.coalesce("known", F.lit(False)).alias("file_known"))
