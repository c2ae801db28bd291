"""Queries that search and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions import scoring, text
from seamline.operators import ranking, retrieval, vectors
from seamline.plans.registry import EDGES, QUERY_TERMS, RATED, SYMBOLS, query, rated_edges, sql_bm25, sql_tokens, symbols, table

DOC_TOKENS, URL_TOKENS = sql_tokens("text"), sql_tokens("url")
ALL_CHANNELS = f"""WITH {QUERY_TERMS}, {sql_bm25("d", "doc_id", DOC_TOKENS, "documents")}, {sql_bm25("p", "page_id", URL_TOKENS, "pages")}, {sql_bm25("c", "conv_id * 1000 + turn", DOC_TOKENS, "conversations")},
 w AS (SELECT item_id AS query_id, CASE WHEN regexp_matches(text, 'error:|Error:|panic:|FATAL|exception|Exception|traceback|at line') THEN 'error' WHEN contains(text, '/') OR contains(text, chr(92)) THEN 'path' ELSE 'natural_language' END AS intent FROM benchmark),
 fused AS (SELECT query_id, intent, 'snippet' AS channel, doc_id::varchar AS doc_id, CASE intent WHEN 'error' THEN 3.0 WHEN 'path' THEN 0 ELSE 2.0 END / (60.0 + rank) AS score FROM d_top JOIN w USING (query_id)
  UNION ALL SELECT query_id, intent, 'file', doc_id::varchar, CASE intent WHEN 'path' THEN 3.0 ELSE 1.0 END / (60.0 + rank) FROM p_top JOIN w USING (query_id)
  UNION ALL SELECT query_id, intent, 'symbol', doc_id::varchar, CASE intent WHEN 'natural_language' THEN 2.0 ELSE 0 END / (60.0 + rank) FROM c_top JOIN w USING (query_id))"""


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fused rows of the three channels for every benchmark question, and the questions."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    asked = text.default_tokens(F.col("query"))
    body = text.default_tokens(F.col("text"))
    sources = {
        "snippet": (table(spark, sf_dir, "documents"), "doc_id", body),
        "file": (table(spark, sf_dir, "pages"), "page_id", text.default_tokens(F.col("url"))),
        "symbol": (table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", body),
    }
    ranked = {name: retrieval.search(rows, doc, tokens, questions, "query_id", asked, 10) for name, (rows, doc, tokens) in sources.items()}
    plan = retrieval.channel_plan(questions, "query_id", "query")
    fused = retrieval.fuse(ranked, plan.select("query_id", "channel", "weight"))
    return fused, questions.join(plan.select("query_id", "intent").distinct(), "query_id")


@query(f"{ALL_CHANNELS} SELECT query_id, intent, channel, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, channel, doc_id) AS rank FROM fused WHERE score > 0 QUALIFY rank <= 10")
def search_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: intent, channels by intent, BM25 in each, rank fusion, ten best of each question."""
    fused, questions = _channels(spark, sf_dir)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "channel", "doc_id")
    rows = fused.withColumn("rank", F.row_number().over(order)).where("rank <= 10").drop("weight")
    return rows.join(questions.select("query_id", "intent"), "query_id").select("query_id", "intent", "channel", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {QUERY_TERMS}, {sql_bm25('d', 'doc_id', DOC_TOKENS, 'documents')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM d_top")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    rows = retrieval.search(table(spark, sf_dir, "documents"), "doc_id", text.default_tokens(F.col("text")), questions, "item_id", text.default_tokens(F.col("query")), 10)
    return rows.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""{ALL_CHANNELS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, channel, doc_id) AS rank FROM fused WHERE score > 0),
 a AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2 FROM r GROUP BY 1),
 c AS (SELECT w.query_id, CASE WHEN s1 > 0 THEN s1 / (s1 + 1) ELSE 0 END AS top_score, CASE WHEN s2 IS NULL THEN CASE WHEN s1 > 0 THEN s1 / (s1 + 1) ELSE 0 END WHEN s1 - s2 > 0 THEN (s1 - s2) / (s1 - s2 + 1) ELSE 0 END AS margin FROM w LEFT JOIN a USING (query_id))
 SELECT query_id, round(top_score, 6) AS top_score, round(margin, 6) AS score_margin, round(least(greatest(0.55 * top_score + 0.3 * margin, 0), 1), 6) AS composite, 0.55 * top_score + 0.3 * margin < 0.5 AS low_confidence FROM c"""
)
def search_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused, questions = _channels(spark, sf_dir)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "channel", "doc_id")
    rows = fused.withColumn("rank", F.row_number().over(order)).withColumn("provenance", F.lit("lexical"))
    c = ranking.confidence(rows, questions)
    return c.select("query_id", F.round("top_score", 6).alias("top_score"), F.round("score_margin", 6).alias("score_margin"), F.round("composite", 6).alias("composite"), "low_confidence")


@query(f"WITH {SYMBOLS} SELECT symbol_id, path, line_start FROM symbols WHERE name = 'red_widget' AND kind IN ('struct','class','enum','trait','interface') ORDER BY path, line_start, symbol_id LIMIT 10")
def locate_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.locate(symbols(spark, sf_dir), "red_widget", role="type", limit=10).select("symbol_id", "path", "line_start")


NORMS = "v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, label AS q_label, e AS qe FROM v WHERE vec_id % 20 = 0)"
NEAREST = f"{NORMS}, s AS (SELECT query_id, vec_id, list_cosine_similarity(qe, e) AS score FROM q JOIN v ON true), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10)"


@query(f"WITH {NEAREST} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM n")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    rows = vectors.nearest(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)
    return rows.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {NORMS}, s AS (SELECT query_id, vec_id, list_cosine_similarity(qe, e) AS score FROM q JOIN v ON label = q_label), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 5)
 SELECT query_id, vec_id, round(score, 6) AS score, rank FROM n"""
)
def nearest_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    rows = vectors.nearest(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5, scope="label")
    return rows.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


#: Labelled vectors with their documents: words of the document of a vector's number are the lexical query.
BLEND = f"""WITH {NEAREST}, terms AS (SELECT DISTINCT doc_id AS query_id, unnest({DOC_TOKENS}) AS term FROM documents WHERE doc_id IN (SELECT query_id FROM q)), {sql_bm25("d", "doc_id", DOC_TOKENS, "documents")}"""


@query(
    f"""{BLEND}, a AS (SELECT query_id, doc_id AS vec_id, 0.7 / (60 + rank) AS x FROM d_top), b AS (SELECT query_id, vec_id, 0.3 / (60 + rank) AS y FROM n)
 SELECT query_id, vec_id, round(coalesce(x, 0) + coalesce(y, 0), 6) AS score, CASE WHEN x IS NULL THEN 'semantic' WHEN y IS NULL THEN 'lexical' ELSE 'hybrid' END AS provenance FROM a FULL JOIN b USING (query_id, vec_id)"""
)
def hybrid_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    asked = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    semantic = vectors.nearest(v, asked, 10).withColumnRenamed("vec_id", "key")
    questions = docs.select(F.col("doc_id").alias("query_id"), "text").join(asked.select("query_id"), "query_id", "left_semi")
    lexical = retrieval.search(docs, "doc_id", text.default_tokens(F.col("text")), questions, "query_id", text.default_tokens(F.col("text")), 10).withColumnRenamed("doc_id", "key")
    rows = ranking.blend(lexical, semantic, 0.3, 40, 30)
    return rows.select("query_id", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "provenance")


CANDIDATES = f"""{SYMBOLS}, names AS (SELECT DISTINCT name AS query, name AS query_id FROM symbols),
 cand AS (SELECT query_id, query, s.*, symbol_id AS result_id, 'symbol' AS result_type, (symbol_id::bigint % 11) / 10.0::double AS file_centrality, 1.0 / (60 + symbol_id::bigint % 50)::double AS score FROM names n JOIN symbols s ON split_part(n.query, '_', 1) = split_part(s.name, '_', 1))"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    ids = s.select(F.col("name").alias("query")).distinct().withColumn("query_id", F.col("query"))
    n = F.col("symbol_id").cast("long")
    rows = ids.join(s, F.substring_index("query", "_", 1) == F.substring_index("name", "_", 1))
    return rows.select("query_id", "query", *s.columns, F.col("symbol_id").alias("result_id"), F.lit("symbol").alias("result_type"), ((n % 11) / 10.0).alias("file_centrality"), (1.0 / (60 + n % 50)).alias("score"))


RULES = f"""{CANDIDATES}, kc AS (SELECT query_id, kind, count(*) AS n FROM cand GROUP BY ALL), kf AS (SELECT *, sum(n) OVER (PARTITION BY query_id) AS total, n / sum(n) OVER (PARTITION BY query_id) AS f FROM kc), km AS (SELECT query_id, median(f) AS m FROM kf GROUP BY 1),
 pr AS (SELECT query_id, kind, CASE WHEN total >= 12 AND m > 1e-9 THEN least(greatest((m - f) / m, -1), 1) * 0.25 ELSE 0 END AS prior FROM kf JOIN km USING (query_id)),
 sig AS (SELECT c.*, CASE WHEN lower(name) = lower(query) THEN 5.0 ELSE 0 END AS e, CASE WHEN contains(lower(qualified_name), lower(query)) THEN 2.0 ELSE 0 END AS q, CASE WHEN contains(lower(path), lower(query)) THEN 1.0 ELSE 0 END AS pa, 1.0 AS d,
  least(greatest(CASE WHEN kind IN ('struct','class','enum','trait','interface') THEN 2.0 WHEN kind IN ('function','method') THEN 1.6 WHEN kind = 'module' THEN 1.2 WHEN kind IN ('constant','variable') THEN 0.9 ELSE 0.8 END
   + least(greatest(CASE WHEN kind IN ('class','interface','trait') THEN 0.2 WHEN kind IN ('struct','enum') THEN 0.15 WHEN kind IN ('function','method') THEN 0.1 WHEN kind = 'module' THEN 0.05 WHEN kind = 'type_alias' THEN -0.05 WHEN kind = 'variable' THEN -0.1 ELSE 0 END + CASE WHEN kind IN ('function','method') THEN 0.5 ELSE 0 END, -0.2), 0.2)
   + prior + least(CASE WHEN visibility = 'pub' THEN 0.05 ELSE 0 END + file_centrality * 0.15, 0.3), 0), 3) AS k, CASE WHEN contains(path, '_test.') THEN -0.5 ELSE 0 END AS t FROM cand c JOIN pr USING (query_id, kind)),
 eff AS (SELECT *, CASE WHEN e > 0 AND q + pa + d + k > 2 THEN 2 / (q + pa + d + k) ELSE 1 END AS scale FROM sig),
 ruled AS (SELECT *, score + e + (q + pa + d + k) * scale + t AS rule_score FROM eff), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (e > 0) DESC, round(rule_score, 9) DESC, result_id) AS rule_rank FROM ruled)"""


@query(f"WITH {RULES} SELECT query_id, result_id, round(rule_score, 6) AS rule_score, rule_rank FROM ranked")
def rule_reranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.rule_rerank(_candidates(spark, sf_dir))
    return rows.select("query_id", "result_id", F.round("rule_score", 6).alias("rule_score"), "rule_rank")


@query(
    f"""WITH {RULES}, x AS (SELECT query_id, result_id, unnest([{{'signal': 'exact_match', 'r': e, 'v': e}}, {{'signal': 'qualified_name', 'r': q, 'v': q * scale}}, {{'signal': 'path_affinity', 'r': pa, 'v': pa * scale}}, {{'signal': 'definition_boost', 'r': d, 'v': d * scale}}, {{'signal': 'test_file_penalty', 'r': t, 'v': t}}]) AS s FROM ranked WHERE rule_rank <= 3)
 SELECT query_id, result_id, s.signal AS signal, round(s.r::double, 6) AS raw_value, round(s.v::double, 6) AS effective_value FROM x"""
)
def ranking_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.reasons(ranking.rule_rerank(_candidates(spark, sf_dir), explain=True).where("rule_rank <= 3"))
    return rows.where("signal <> 'kind_match'").select("query_id", "result_id", "signal", F.round("raw_value", 6).alias("raw_value"), F.round("effective_value", 6).alias("effective_value"))


@query(
    f"""WITH {CANDIDATES}, t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(replace(query, '_', ' ')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: strlen(x) > 1)) AS qt, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: strlen(x) > 1)) AS dt FROM cand),
 n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id) AS place FROM t),
 s AS (SELECT *, CASE WHEN place <= 50 THEN score + 2.5 * len(list_intersect(qt, dt)) / len(qt) + CASE WHEN contains(lower(content), replace(query, '_', ' ')) THEN 0.75 ELSE 0 END ELSE score END AS r FROM n)
 SELECT query_id, result_id, round(r, 6) AS reranked_score, row_number() OVER (PARTITION BY query_id ORDER BY round(r, 9) DESC, result_id) AS reranked_rank FROM s"""
)
def local_reranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumn("asked", F.regexp_replace("query", "_", " "))
    return ranking.rerank_locally(rows, "asked", "content").select("query_id", "result_id", F.round("reranked_score", 6).alias("reranked_score"), "reranked_rank")


STRUCTURE = f"""{CANDIDATES}, {EDGES}, {RATED}, src AS (SELECT to_symbol_id, coalesce(source_file, from_symbol_id) AS source, max(confidence_weight) AS w, count(*) AS n, count(*) FILTER (confidence IN ('high', 'medium')) AS sure FROM weighted WHERE to_symbol_id IS NOT NULL GROUP BY 1, 2),
 st AS (SELECT to_symbol_id, count(*) AS raw_sources, sum(w) AS weighted_sources, sum(n) AS total_edges, sum(sure) AS sure_edges FROM src GROUP BY 1)"""


@query(
    f"""WITH {STRUCTURE}, j AS (SELECT c.*, st.*, max(weighted_sources) OVER (PARTITION BY query_id) AS most, coalesce(sure_edges / total_edges, 1.0) AS cov FROM cand c LEFT JOIN st ON st.to_symbol_id = c.symbol_id)
 SELECT query_id, result_id, round(CASE WHEN most > 0 THEN coalesce(weighted_sources / most, 0) * CASE WHEN cov < 0.45 THEN cov / 0.45 ELSE 1 END ELSE 0 END, 6) AS structural, round(least(file_centrality, 0.5), 6) AS centrality_boost FROM j"""
)
def structural_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.structural_boost(_candidates(spark, sf_dir), ranking.structural_stats(rated_edges(spark, sf_dir)))
    return rows.select("query_id", "result_id", F.round("structural", 6).alias("structural"), F.round("centrality_boost", 6).alias("centrality_boost"))


@query(
    f"""WITH {SYMBOLS} SELECT path, kind, symbol_id AS first_symbol, n - 1 AS suppressed FROM (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY line_start, symbol_id) AS r, count(*) OVER (PARTITION BY path, kind) AS n FROM symbols) WHERE r = 1"""
)
def suppressed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.first_of_each(symbols(spark, sf_dir), ["path", "kind"], ["line_start", "symbol_id"])
    return rows.select("path", "kind", F.col("symbol_id").alias("first_symbol"), "suppressed")


@query(
    f"""WITH {SYMBOLS}, r AS (SELECT symbol_id, path, line_start, line_end, CASE WHEN symbol_id::bigint % 3 = 0 THEN 'file_fallback' ELSE 'symbol_origin' END AS origin FROM symbols)
 SELECT symbol_id FROM r a WHERE origin = 'symbol_origin' OR NOT EXISTS (SELECT 1 FROM r b WHERE b.origin = 'symbol_origin' AND a.path = b.path AND a.line_start <= b.line_end AND b.line_start <= a.line_end)"""
)
def uncovered_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.when(F.col("symbol_id").cast("long") % 3 == 0, "file_fallback").otherwise("symbol_origin")
    rows = symbols(spark, sf_dir).withColumns({"query_id": F.lit(1), "result_type": F.lit("snippet"), "origin": origin})
    return ranking.drop_covered_fallbacks(rows).select("symbol_id")


@query()
def diverse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.rule_rerank(_candidates(spark, sf_dir)).where("rule_rank <= 30").select("query_id", F.col("rule_rank").alias("rank"), "path", F.col("rule_score").alias("score"), "result_id")
    return ranking.file_diversity(ranked)


@query(
    """WITH v AS (SELECT event_id AS query_id, ['search_code','locate_symbol','get_call_graph'][event_id % 3 + 1] AS tool, event_type || ' of user_' || user_id AS q, value / 100 AS top, event_id % 4 AS found FROM events),
 low AS (SELECT * FROM v WHERE CASE WHEN tool = 'get_call_graph' THEN found = 0 ELSE found = 0 OR top < 0.1 END)
 SELECT query_id, tool, s.next_tool AS next_tool, s.argument AS argument FROM (SELECT query_id, tool, unnest(list_filter([CASE WHEN tool = 'search_code' THEN {'next_tool': 'locate_symbol', 'argument': split_part(q, ' ', 1)} END, CASE WHEN tool = 'search_code' THEN {'next_tool': 'get_call_graph', 'argument': split_part(q, ' ', 1)} END,
  CASE WHEN tool = 'search_code' THEN {'next_tool': 'search_code', 'argument': replace(q, ' of ', ' ')} END, CASE WHEN (tool = 'locate_symbol' AND found = 0) OR (tool = 'get_call_graph' AND found = 0) THEN {'next_tool': 'search_code', 'argument': q} END], lambda x: x IS NOT NULL)) AS s FROM low)"""
)
def followup_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        n.alias("query_id"),
        F.element_at(F.array(F.lit("search_code"), F.lit("locate_symbol"), F.lit("get_call_graph")), (n % 3 + 1).cast("int")).alias("tool"),
        F.concat("event_type", F.lit(" of user_"), "user_id").alias("query"),
        F.lit("natural_language").alias("intent"),
        (F.col("value") / 100).alias("top_score"),
        F.lit(0.1).alias("threshold"),
        (n % 4).alias("total_candidates"),
        (n % 4).alias("total_edges"),
    )
    return ranking.followups(rows)


@query(
    """SELECT event_id, CASE WHEN mode = 'off' THEN 'disabled' WHEN event_type <> 'view' THEN 'intent_not_nl' WHEN mode = 'rerank_only' THEN 'rerank_only' WHEN event_id % 5 = 0 THEN 'ratio_zero' WHEN value / 30 >= 0.85 THEN 'lexical_short_circuit' ELSE 'run' END AS gate
 FROM (SELECT *, ['off','hybrid','rerank_only','hybrid'][event_id % 4 + 1] AS mode FROM events)"""
)
def semantic_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("off", "hybrid", "rerank_only", "hybrid")]), (n % 4 + 1).cast("int"))
    intent = F.when(F.col("event_type") == "view", "natural_language").otherwise("symbol")
    ratio = F.when(n % 5 == 0, 0.0).otherwise(0.3)
    return table(spark, sf_dir, "events").select("event_id", scoring.semantic_gate(mode, intent, ratio, F.col("value") / 30).alias("gate"))


#: Questions against documents: words by BM25, meaning by the vectors of the same numbers; documents as the symbols of these numbers.
HYBRID = f"""WITH {QUERY_TERMS}, {sql_bm25("d", "doc_id", DOC_TOKENS, "documents")}, {SYMBOLS}, {EDGES}, {RATED},
 w AS (SELECT item_id AS query_id, text AS query, CASE WHEN regexp_matches(text, 'error:|Error:|panic:|FATAL|exception|Exception|traceback|at line') THEN 'error' WHEN contains(text, '/') OR contains(text, chr(92)) THEN 'path' ELSE 'natural_language' END AS intent FROM benchmark),
 qv AS (SELECT item_id AS query_id, embedding::double[] AS qe FROM benchmark JOIN embeddings ON vec_id = item_id),
 sem AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qe, embedding::double[]), 9) DESC, vec_id) AS rank FROM qv JOIN w USING (query_id), embeddings WHERE intent = 'natural_language' QUALIFY rank <= 10),
 bl AS (SELECT query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN max(b.rank) OVER (PARTITION BY query_id) IS NULL THEN 1.0 / (60 + a.rank) ELSE coalesce(0.7 / (60 + a.rank), 0) + coalesce(0.3 / (60 + b.rank), 0) END::double AS score, CASE WHEN a.rank IS NULL THEN 'semantic' WHEN b.rank IS NULL THEN 'lexical' ELSE 'hybrid' END AS provenance FROM (SELECT query_id, doc_id, rank FROM d_top) a FULL JOIN sem b USING (query_id, doc_id)),
 en AS (SELECT b.*, w.query, s.symbol_id, s.kind, s.name, s.qualified_name, s.visibility, coalesce(s.path, 'src/none.rs') AS path FROM bl b JOIN w USING (query_id) LEFT JOIN symbols s ON s.symbol_id = b.doc_id::varchar),
 km AS (SELECT *, CASE WHEN kind IS NULL THEN 0 ELSE CASE WHEN kind IN ('struct','class','enum','trait','interface') THEN 2.0 WHEN kind IN ('function','method') THEN 1.6 WHEN kind = 'module' THEN 1.2 WHEN kind IN ('constant','variable') THEN 0.9 ELSE 0.8 END
   + least(greatest(CASE WHEN kind IN ('class','interface','trait') THEN 0.2 WHEN kind IN ('struct','enum') THEN 0.15 WHEN kind IN ('function','method') THEN 0.1 WHEN kind = 'module' THEN 0.05 WHEN kind = 'type_alias' THEN -0.05 WHEN kind = 'variable' THEN -0.1 ELSE 0 END
    + CASE WHEN regexp_matches(trim(query), '^\\p{{Lu}}') AND NOT contains(query, '_') AND kind IN ('class','struct','enum','trait','interface','type_alias') THEN 1 WHEN (regexp_matches(trim(query), '^\\p{{Ll}}') OR contains(query, '_')) AND kind IN ('function','method') THEN 0.5 ELSE 0 END, -0.2), 0.2) END AS km,
   CASE WHEN regexp_matches(path, '_test\\.') THEN -0.5 ELSE 0 END AS tp FROM en),
 kc AS (SELECT query_id, kind, count(*) AS n FROM km WHERE kind IS NOT NULL GROUP BY ALL), kf AS (SELECT *, sum(n) OVER (PARTITION BY query_id) AS total, n / sum(n) OVER (PARTITION BY query_id) AS f FROM kc), kd AS (SELECT query_id, median(f) AS m FROM kf GROUP BY 1),
 pr AS (SELECT query_id, kind, CASE WHEN total >= 12 AND m > 1e-9 THEN least(greatest((m - f) / m, -1), 1) * 0.25 ELSE 0 END AS prior FROM kf JOIN kd USING (query_id)),
 ru AS (SELECT k.*, CASE WHEN provenance = 'semantic' THEN score + least(greatest(km, 0), 3) + tp ELSE score END + 1.0 + least(greatest(km + coalesce(prior, 0) + CASE WHEN visibility = 'pub' THEN 0.05 ELSE 0 END, 0), 3) + tp AS rs FROM km k LEFT JOIN pr ON pr.query_id = k.query_id AND pr.kind = k.kind),
 src AS (SELECT to_symbol_id, coalesce(source_file, from_symbol_id) AS source, max(confidence_weight) AS w, count(*) AS n, count(*) FILTER (confidence IN ('high', 'medium')) AS sure FROM weighted WHERE to_symbol_id IS NOT NULL GROUP BY 1, 2), st AS (SELECT to_symbol_id, sum(w) AS ws, sum(n) AS te, sum(sure) AS se FROM src GROUP BY 1),
 bo AS (SELECT r.*, max(ws) OVER (PARTITION BY query_id) AS most, ws, coalesce(se / te, 1.0) AS cov FROM ru r LEFT JOIN st ON st.to_symbol_id = r.symbol_id WHERE kind IS DISTINCT FROM 'variable' AND kind IS NOT NULL),
 hf AS (SELECT query_id, doc_id, provenance, rs + CASE WHEN most > 0 THEN coalesce(ws / most, 0) * CASE WHEN cov < 0.45 THEN cov / 0.45 ELSE 1 END ELSE 0 END AS score FROM bo),
 hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hf)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The whole way of a search, up to where files are varied: both branches, what hits lack, rules, policy, structure."""
    from seamline.operators import policy, semantic

    bench, v = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    questions = bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).withColumn("intent", scoring.intent(F.col("query"))["intent"])
    found = retrieval.search(table(spark, sf_dir, "documents"), "doc_id", text.default_tokens(F.col("text")), questions, "query_id", text.default_tokens(F.col("query")), 10)
    lexical = found.select("query_id", F.col("doc_id").alias("key"), "rank", scoring.rrf(F.col("rank")).alias("score"))
    gate = scoring.semantic_gate(F.lit("hybrid"), F.col("intent"), F.lit(0.3), F.lit(0.0))
    asked = questions.join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").withColumn("gate", gate)
    near = semantic.search(v, asked, 10).select("query_id", F.col("vec_id").alias("key"), "rank", "score")
    rows = semantic.hybrid(lexical, near, 0.3, 40, 30).join(questions.select("query_id", "query", "intent"), "query_id")
    s = symbols(spark, sf_dir)
    hits = rows.select("*", F.col("key").cast("string").alias("symbol_stable_id"))
    hits = semantic.enriched(hits, s.withColumn("symbol_stable_id", F.col("symbol_id")))
    facts = s.select(F.col("symbol_id").alias("symbol_stable_id"), "symbol_id", "path", "visibility")
    hits = hits.join(facts, "symbol_stable_id", "left").withColumns({"path": F.coalesce("path", F.lit("src/none.rs")), "file_centrality": F.lit(0.0), "result_type": F.lit("symbol"), "result_id": F.col("key"), "snippet": F.lit("")})
    ruled = ranking.rule_rerank(semantic.adjusted(hits)).withColumn("score", F.col("rule_score"))
    kept = policy.apply(ruled, policy.Policy(deny_kinds=("variable",))).drop("block_reason")
    boosted = ranking.structural_boost(kept, ranking.structural_stats(rated_edges(spark, sf_dir)))
    order = Window.partitionBy("query_id").orderBy(F.round("boosted_score", 9).desc(), "result_id")
    return boosted.withColumn("score", F.col("boosted_score")).withColumn("rank", F.row_number().over(order)), questions


@query(f"{HYBRID} SELECT query_id, doc_id, provenance, round(score, 5) AS score, rank FROM hr WHERE rank <= 10")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship with its semantic branch: the ten best of each question."""
    rows, _ = _hybrid(spark, sf_dir)
    return rows.where("rank <= 10").select("query_id", F.col("key").alias("doc_id"), "provenance", F.round("score", 5).alias("score"), "rank")


@query(
    f"""{HYBRID}, a AS (SELECT query_id, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, count(*) FILTER (rank <= 5) AS n, count(*) FILTER (rank <= 5 AND provenance = 'hybrid') AS h, count(*) FILTER (rank <= 5 AND provenance = 'semantic') AS se, count(*) FILTER (rank <= 5 AND provenance = 'lexical') AS le FROM hr GROUP BY 1),
 c AS (SELECT w.query_id, CASE WHEN s1 > 0 THEN s1 / (s1 + 1) ELSE 0 END AS top, CASE WHEN s2 IS NULL THEN CASE WHEN s1 > 0 THEN s1 / (s1 + 1) ELSE 0 END WHEN s1 - s2 > 0 THEN (s1 - s2) / (s1 - s2 + 1) ELSE 0 END AS margin, CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN h > 0 THEN 0.5 + 0.5 * h / n WHEN se > 0 AND le > 0 THEN 0.4 ELSE 0 END AS ag FROM w LEFT JOIN a USING (query_id))
 SELECT query_id, round(ag::double, 6) AS channel_agreement, round(least(greatest(0.55 * top + 0.3 * margin + 0.15 * ag, 0), 1), 6) AS composite FROM c"""
)
def hybrid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the branches among the first five, and the confidence of each question's results."""
    rows, questions = _hybrid(spark, sf_dir)
    c = ranking.confidence(rows, questions)
    return c.select("query_id", F.round("channel_agreement", 6).alias("channel_agreement"), F.round("composite", 6).alias("composite"))


@query()
def varied_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship to its end: no file crowds out the others among a question's ten results."""
    rows, _ = _hybrid(spark, sf_dir)
    near = rows.where("rank <= 30").select("query_id", "rank", "path", "score", "result_id")
    return ranking.file_diversity(near).where("rank <= 10")
