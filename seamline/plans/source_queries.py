"""Queries over source files: what is read, left out, extracted, recorded, written and carried elsewhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import scoring, text
from seamline.operators import context, extraction, policy, retrieval, versions
from seamline.plans import indexing
from seamline.plans.registry import SYMBOLS, query, symbols, table
from seamline.sources import evalsets, files, tables
from seamline.sources.shared import shared_root

#: Parts as small files of two languages.
PYTHON = "import os\nfrom .util import helper%d\n\nclass Box%d:\n    def size(self):\n        return helper%d(self)\n\ndef main%d(x):\n    box = Box%d()\n    return os.getcwd()\n"
RUST = "use a::{b, c::d};\npub struct S%d { x: i32 }\nimpl S%d {\n    fn open(&self) -> i32 { make%d(1) }\n}\n"
FILES = """f AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS py, CASE WHEN p_partkey % 2 = 0 THEN 'pkg/m' || p_partkey || '.py' ELSE 'src/m' || p_partkey || '.rs' END AS path FROM part)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    py = k % 2 == 0
    content = F.when(py, F.format_string(PYTHON, k % 7, k, k % 7, k, k)).otherwise(F.format_string(RUST, k, k, k))
    path = F.when(py, F.concat(F.lit("pkg/m"), k, F.lit(".py"))).otherwise(F.concat(F.lit("src/m"), k, F.lit(".rs")))
    return table(spark, sf_dir, "part").select(path.alias("path"), F.when(py, "python").otherwise("rust").alias("language"), content.alias("content"))


FOUND = f"""{FILES}, s AS (SELECT path, unnest(CASE WHEN py THEN [{{'name': 'Box' || k, 'q': 'Box' || k, 'kind': 'class', 'a': 4, 'b': 6, 'p': NULL}}, {{'name': 'size', 'q': 'Box' || k || '.size', 'kind': 'method', 'a': 5, 'b': 6, 'p': 'Box' || k}}, {{'name': 'main' || k, 'q': 'main' || k, 'kind': 'function', 'a': 8, 'b': 10, 'p': NULL}}]
  ELSE [{{'name': 'S' || k, 'q': 'S' || k, 'kind': 'struct', 'a': 2, 'b': 2, 'p': NULL}}, {{'name': 'open', 'q': 'S' || k || '::open', 'kind': 'method', 'a': 4, 'b': 4, 'p': 'S' || k}}] END) AS x FROM f)"""


@query(f"WITH {FOUND} SELECT path, x.name AS name, x.q AS qualified_name, x.kind AS kind, x.a AS line_start, x.b AS line_end, x.p AS parent_name FROM s")
def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of all files, each with its parent."""
    rows = extraction.symbol_rows(extraction.extract(_files(spark, sf_dir)), "demo")
    parents = rows.select(F.col("symbol_id").alias("parent_symbol_id"), F.col("name").alias("parent_name"))
    return rows.join(parents, "parent_symbol_id", "left").select("path", "name", "qualified_name", "kind", "line_start", "line_end", "parent_name")


@query(f"WITH {FILES} SELECT path, x.t AS target, x.l AS stem, x.n AS line_start FROM (SELECT path, unnest(CASE WHEN py THEN [{{'t': 'os', 'l': NULL, 'n': 1}}, {{'t': '.util.helper' || k % 7, 'l': 'pkg/util', 'n': 2}}] ELSE [{{'t': 'a::b', 'l': NULL, 'n': 1}}, {{'t': 'a::c::d', 'l': NULL, 'n': 1}}] END) AS x FROM f)")
def extracted_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of all files; trees of them are unfolded, relative ones led to a file's stem."""
    return extraction.extract(_files(spark, sf_dir)).where("item = 'import'").select("path", "target", F.col("label").alias("stem"), "line_start")


@query(f"WITH {FILES} SELECT path, x.t AS target, x.l AS label, x.n AS line_start FROM (SELECT path, unnest(CASE WHEN py THEN [{{'t': 'helper' || k % 7, 'l': 'static', 'n': 6}}, {{'t': 'Box' || k, 'l': 'static', 'n': 9}}, {{'t': 'os.getcwd', 'l': 'heuristic', 'n': 10}}] ELSE [{{'t': 'make' || k, 'l': 'static', 'n': 4}}] END) AS x FROM f)")
def extracted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all files."""
    return extraction.extract(_files(spark, sf_dir)).where("item = 'call'").select("path", "target", "label", "line_start")


@query(f"WITH {FOUND} SELECT path, x.kind || '_body' AS chunk_type, x.a AS line_start, x.b AS line_end, 0 AS chunk_index FROM s")
def symbol_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the symbols' bodies."""
    rows = _files(spark, sf_dir)
    found = extraction.symbol_rows(extraction.extract(rows), "demo")
    return extraction.snippet_rows(found, rows).select("path", "chunk_type", "line_start", "line_end", "chunk_index")


@query(f"""WITH {FILES}, e AS (SELECT path, py, k, unnest(CASE WHEN py THEN ['Box' || k, 'helper' || k % 7, 'os.getcwd'] ELSE ['make' || k] END) AS t FROM f)
 SELECT path AS source_file, edge_type, n, resolved FROM (SELECT path, 'calls' AS edge_type, count(*) AS n, count(*) FILTER (starts_with(t, 'Box')) AS resolved FROM e GROUP BY 1 UNION ALL SELECT path, 'imports', 2, 0 FROM f)""")
def indexed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a full index: calls and imports of each file, and how many of them lead to a symbol."""
    edges = indexing.build(_files(spark, sf_dir), "demo").edges
    return edges.groupBy("source_file", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.count("to_symbol_id").alias("resolved"))


@query(f"WITH {FILES} SELECT path, regexp_extract(path, '[^/]*$') AS filename, CASE WHEN py THEN 'python' ELSE 'rust' END AS language, CASE WHEN py THEN 10 ELSE 5 END AS n_lines FROM f")
def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows of the index."""
    rows = files.records(_files(spark, sf_dir), "demo")
    return rows.select("path", "filename", "language", F.size(text.lines(F.col("content_head"))).alias("n_lines"))


@query("SELECT c_custkey AS k, c_custkey % 8 IN (1, 2, 4, 7) AS built_in, c_custkey % 8 = 5 AS by_rules FROM customer")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths left out by the built-in rules, and by rules of the project's own."""
    k = F.col("c_custkey")
    path = F.element_at(F.array(*[F.lit(p) for p in ("src/a.rs", "node_modules/x/a.js", "a/target/b.rs", "targets/b.rs", "web/x.min.js", "logs/a.py", "logs/keep.py", "docs/b.png")]), (k % 8 + 1).cast("int"))
    rules = files.ignore_rules(["# own", "logs/*", "!logs/keep.py"])
    return table(spark, sf_dir, "customer").select(k.alias("k"), files.ignored(path).alias("built_in"), files.ignored_by(path, rules).alias("by_rules"))


@query(f"WITH {SYMBOLS} SELECT symbol_id FROM symbols WHERE kind IN ('struct', 'class', 'enum', 'trait', 'interface')")
def type_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one role."""
    return retrieval.retain_role(symbols(spark, sf_dir).withColumn("result_type", F.lit("symbol")), "type").select("symbol_id")


@query(f"WITH {SYMBOLS} SELECT path, line_start, line_end, kind, name FROM symbols")
def located_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results at the least level of detail."""
    return context.at_detail(symbols(spark, sf_dir), "location").select("path", "line_start", "line_end", "kind", "name")


@query(f"WITH {SYMBOLS}, t AS (SELECT *, ['red_widget', 'promo', 'zzz'][symbol_id::bigint % 3 + 1] AS q FROM symbols) SELECT symbol_id, CASE WHEN lower(name) = q THEN 2 WHEN contains(lower(qualified_name), q) THEN 1 ELSE 0 END AS tier FROM t")
def lexical_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier of each result: named exactly, in its qualified name, or neither."""
    q = F.element_at(F.array(F.lit("red_widget"), F.lit("promo"), F.lit("zzz")), (F.col("symbol_id").cast("long") % 3 + 1).cast("int"))
    exact, qualified = (F.lower("name") == q).cast("int"), F.lower("qualified_name").contains(q).cast("int")
    return symbols(spark, sf_dir).select("symbol_id", scoring.lexical_tier(exact, qualified).alias("tier"))


@query("SELECT item_id, CASE WHEN strlen(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM benchmark WHERE regexp_full_match(text, '[\\x00-\\x7F]*')")
def snippet_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short forms of texts; only plain ASCII here, where bytes are characters."""
    rows = table(spark, sf_dir, "benchmark").where(~F.col("text").rlike("[^\\x00-\\x7F]"))
    return rows.select("item_id", text.snippet_preview(F.col("text")).alias("preview"))


@query("SELECT c_custkey AS k, sha256(CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'm' || c_custkey ELSE 'p|' || c_custkey || '|9' END) AS hash FROM customer")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of a result's text: of its snippet, else of its file, else of its place."""
    k = F.col("c_custkey")
    snippet, manifest = F.when(k % 3 == 0, F.col("c_name")), F.when(k % 3 == 1, F.sha2(F.concat(F.lit("m"), k), 256))
    return table(spark, sf_dir, "customer").select(k.alias("k"), indexing.content_hash(snippet, manifest, F.lit("p"), k, F.lit(9)).alias("hash"))


@query("SELECT event_id, least(greatest(coalesce(CASE WHEN event_id % 3 = 0 THEN value / 50 - 0.5 END, CASE WHEN event_id % 3 = 1 THEN 0.4 END, 0.3), 0), 1)::double AS ratio FROM events")
def semantic_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the semantic branch: the request's, else the intent's, else the default."""
    n = F.col("event_id")
    ratio = scoring.effective_ratio(F.when(n % 3 == 0, F.col("value") / 50 - 0.5), F.when(n % 3 == 1, F.lit(0.4)), 0.3)
    return table(spark, sf_dir, "events").select("event_id", ratio.alias("ratio"))


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 'exact name match (+' || printf('%.2f', c_acctbal) || ')' ELSE 'no exact match' END AS reason FROM customer")
def component_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons in words."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), scoring.component_reason(F.col("c_acctbal"), "exact name match", "no exact match").alias("reason"))


@query("SELECT * FROM (VALUES ('balanced', 'off', 'off', 0), ('balanced', 'strict', 'balanced', 1), ('balanced', NULL, 'balanced', 0), ('strict', 'audit_only', 'audit_only', 0), ('off', 'off', 'off', 0)) t(own, request, mode, warnings)")
def policy_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode that a request gets."""
    asked = [("balanced", "off"), ("balanced", "strict"), ("balanced", None), ("strict", "audit_only"), ("off", "off")]
    rows = [(own, request, *policy.Policy(mode=own).resolved(request)) for own, request in asked]
    return spark.createDataFrame([(o, r, m, len(w)) for o, r, m, w in rows], "own string, request string, mode string, warnings int")


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) > 0 AS stale, false AS same")
def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a scan holds what the manifest doesn't, and whether it does against itself."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("path"), F.md5("c_name").alias("content_hash"), "c_custkey")
    changed = rows.withColumn("content_hash", F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.col("content_hash")))
    return spark.createDataFrame([(versions.is_stale(changed, rows), versions.is_stale(rows, rows))], "stale boolean, same boolean")


def _index_files(spark: SparkSession, sf_dir: str, ref: str) -> DataFrame:
    rows = files.records(_files(spark, sf_dir), "demo", ref)
    return tables.checked(rows, "files")


@query(f"""WITH {FILES}, m AS (SELECT 'main' AS ref, * FROM f UNION ALL SELECT 'dev', * FROM f WHERE k % 3 = 0) SELECT ref, path, CASE WHEN ref = 'main' AND k % 5 = 0 THEN 'new' ELSE 'old' END AS state FROM m WHERE NOT (ref = 'main' AND k % 7 = 0 AND k % 5 <> 0)""")
def published_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file table published, read again, and merged: rows of changed files go, new ones come, by repo, ref and path."""
    k = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    old = _index_files(spark, sf_dir, "main").unionByName(_index_files(spark, sf_dir, "dev").where(k % 3 == 0))
    path = f"{shared_root(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    tables.publish(old, path)
    main = tables.checked(spark.read.parquet(path), "files").where("ref = 'main'")
    new = main.where(k % 5 == 0).withColumn("content_head", F.lit("new"))
    merged = tables.merge(spark, path, "files", new, main.where((k % 7 == 0) | (k % 5 == 0)).select("repo", "ref", "path"))
    return merged.select("ref", "path", F.when(F.col("content_head") == "new", "new").otherwise("old").alias("state"))


@query(f"WITH {FILES} SELECT 'local' AS repo, path, 'x' AS version FROM f")
def carried_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle written and read under another repo."""
    path = f"{shared_root(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"
    tables.export_bundle({"files": _index_files(spark, sf_dir, "main")}, path, {"version": "x"})
    carried, metadata = tables.import_bundle(spark, path, ["files"], "local")
    return carried["files"].select("repo", "path", F.lit(metadata["version"]).alias("version"))


@query("SELECT 'q' || c_nationkey AS query_id, 'd' || c_custkey AS doc_id, (c_custkey % 3)::double AS score FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 5 <> 0")
def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of a suite in files, without its header, comments, scores of 0 and documents that aren't in its corpus."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    root = f"{shared_root(spark).rstrip('/')}/suite-{uuid.uuid4().hex}"
    rows.where(k % 5 != 0).select(F.concat(F.lit("d"), k).alias("_id"), F.col("c_name").alias("title"), F.col("c_name").alias("text")).write.json(f"{root}/corpus")
    rows.select(F.concat(F.lit("q"), "c_nationkey").alias("_id"), F.lit("text").alias("text")).distinct().write.json(f"{root}/queries")
    head = spark.createDataFrame([("query-id\tcorpus-id\tscore",), ("# made up",)], "value string")
    lines = rows.select(F.concat_ws("\t", F.concat(F.lit("q"), "c_nationkey"), F.concat(F.lit("d"), k), (k % 3).cast("string")).alias("value"))
    head.unionByName(lines).write.text(f"{root}/qrels")
    return evalsets.beir(spark, f"{root}/corpus", f"{root}/queries", f"{root}/qrels")[2]


@query(f"""WITH {FILES}, h AS (SELECT *, CASE WHEN k % 6 = 0 THEN 'deleted' WHEN k % 10 = 1 THEN 'modified' END AS action FROM f) SELECT path, action FROM h WHERE action IS NOT NULL""")
def overlay_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental sync does, from two snapshots."""
    base = _files(spark, sf_dir)
    k = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    head = base.where(k % 6 != 0).withColumn("content", F.when(k % 10 == 1, F.concat("content", F.lit("// end\n"))).otherwise(F.col("content")))
    _, _, actions = indexing.overlay(base, head, "demo", "feature")
    return actions.select("path", "action")
