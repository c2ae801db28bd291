"""Registration of queries with their SQL, and the engine's tables as views of the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = ("function", "method", "struct", "class", "enum", "trait", "interface", "constant", "variable", "type_alias", "module")

#: Parts as the symbols of a code base: folders by type, files by brand.
SYMBOLS = """symbols AS (SELECT cast(p_partkey AS varchar) AS symbol_id, replace(p_name, ' ', '_') AS name, lower(p_type) || '::' || replace(p_name, ' ', '_') AS qualified_name,
  ['function','method','struct','class','enum','trait','interface','constant','variable','type_alias','module'][cast(p_size % 11 AS int) + 1] AS kind,
  'src/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '') || CASE WHEN p_partkey % 9 = 0 THEN '_test.rs' ELSE '.rs' END AS path,
  cast(p_partkey % 97 * 10 + 1 AS int) AS line_start, cast(p_partkey % 97 * 10 + 1 + p_size AS int) AS line_end,
  CASE WHEN p_partkey % 4 <> 0 THEN cast(p_partkey // 4 AS varchar) END AS parent_symbol_id,
  CASE p_partkey % 3 WHEN 0 THEN 'pub' WHEN 1 THEN 'private' END AS visibility, 'fn ' || replace(p_name, ' ', '_') || '(' || p_brand || ')' AS signature, p_name || ' ' || p_type AS content FROM part)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.regexp_replace("p_name", " ", "_")
    test = F.when(F.col("p_partkey") % 9 == 0, "_test.rs").otherwise(".rs")
    start = (F.col("p_partkey") % 97 * 10 + 1).cast("int")
    return p.select(
        F.col("p_partkey").cast("string").alias("symbol_id"),
        name.alias("name"),
        F.concat(F.lower("p_type"), F.lit("::"), name).alias("qualified_name"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_size") % 11 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.regexp_replace(F.lower("p_brand"), "#", ""), test).alias("path"),
        start.alias("line_start"),
        (start + F.col("p_size")).cast("int").alias("line_end"),
        F.when(F.col("p_partkey") % 4 != 0, F.floor(F.col("p_partkey") / 4).cast("string")).alias("parent_symbol_id"),
        F.when(F.col("p_partkey") % 3 == 0, "pub").when(F.col("p_partkey") % 3 == 1, "private").alias("visibility"),
        F.concat(F.lit("fn "), name, F.lit("("), F.col("p_brand"), F.lit(")")).alias("signature"),
        F.concat_ws(" ", "p_name", "p_type").alias("content"),
    )


#: Order lines as the references between those symbols.
EDGES = """edges AS (SELECT cast(l_partkey AS varchar) AS from_symbol_id, CASE WHEN l_linenumber % 4 <> 3 THEN cast(l_suppkey AS varchar) END AS to_symbol_id,
  CASE WHEN l_linenumber % 4 = 3 THEN CASE l_suppkey % 3 WHEN 0 THEN 'std::fmt' WHEN 1 THEN 'red_widget' ELSE 'lib::red_widget' END END AS to_name,
  CASE WHEN l_returnflag = 'A' THEN 'imports' ELSE 'calls' END AS edge_type, CASE l_linestatus WHEN 'F' THEN 'heuristic' END AS bucket, s.path AS source_file, l_linenumber AS line, l_orderkey AS site
  FROM lineitem LEFT JOIN symbols s ON s.symbol_id = cast(l_partkey AS varchar))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_end = F.col("l_linenumber") % 4 == 3
    other = F.when(F.col("l_suppkey") % 3 == 0, "std::fmt").when(F.col("l_suppkey") % 3 == 1, "red_widget").otherwise("lib::red_widget")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("from_symbol_id"),
        F.when(~open_end, F.col("l_suppkey").cast("string")).alias("to_symbol_id"),
        F.when(open_end, other).alias("to_name"),
        F.when(F.col("l_returnflag") == "A", "imports").otherwise("calls").alias("edge_type"),
        F.when(F.col("l_linestatus") == "F", "heuristic").alias("bucket"),
        F.col("l_linenumber").alias("line"),
        F.col("l_orderkey").alias("site"),
    )
    return rows.join(symbols(spark, sf_dir).select(F.col("symbol_id").alias("from_symbol_id"), F.col("path").alias("source_file")), "from_symbol_id", "left")


#: Confidence of those edges.
RATED = """rated AS (SELECT *, CASE WHEN to_symbol_id IS NOT NULL THEN 'resolved_internal' WHEN to_name LIKE 'std::%' THEN 'external_reference' ELSE 'unresolved' END AS outcome,
  CASE WHEN bucket = 'heuristic' THEN 'low' WHEN to_symbol_id IS NOT NULL THEN 'high' WHEN to_name LIKE 'std::%' THEN 'medium' ELSE 'low' END AS confidence FROM edges),
 weighted AS (SELECT *, CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.2 END::double AS confidence_weight FROM rated)"""


def rated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seamline.functions.scoring import edge_confidence

    none = F.lit(None).cast("string")
    rows = edges(spark, sf_dir).withColumn("c", edge_confidence(none, F.col("edge_type"), none, F.col("to_symbol_id"), F.col("to_name"), F.col("bucket")))
    return rows.select("*", F.col("c.provider").alias("edge_provider"), F.col("c.outcome").alias("outcome"), F.col("c.bucket").alias("confidence"), F.col("c.weight").alias("confidence_weight")).drop("c")


#: Pages as the files of a site, by the path of their url.
def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND strlen(x) <= 40)"


def sql_bm25(name: str, doc: str, tokens: str, source: str, terms: str = "terms") -> str:
    """CTEs <name>_top(query_id, doc_id, score, rank) of the ten best documents of each query."""
    return f"""{name}_tok AS (SELECT {doc} AS doc_id, {tokens} AS toks FROM {source}),
 {name}_stat AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM {name}_tok),
 {name}_tf AS (SELECT term, doc_id, len_ AS doc_len, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len_, unnest(toks) AS term FROM {name}_tok) GROUP BY ALL),
 {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
 {name}_score AS (SELECT q.query_id, t.doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS score
   FROM {name}_tf t JOIN {name}_df USING (term) JOIN {terms} q USING (term) CROSS JOIN {name}_stat GROUP BY ALL),
 {name}_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_score QUALIFY rank <= 10)"""


QUERY_TERMS = f"terms AS (SELECT DISTINCT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark)"
