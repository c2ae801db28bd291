"""Queries over versions, policies, context packs, evaluation and control tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions import text
from seamline.operators import context, evaluation, jobs, policy, versions, vectors
from seamline.plans.registry import QUERY_TERMS, SYMBOLS, query, sql_bm25, sql_tokens, symbols, table

#: Two snapshots of the orders: keys divisible by 11 are gone from the second, by 13 new in it, by 7 changed; those divisible by 17 have moved.
SNAPS = """base AS (SELECT 'o/' || o_orderkey AS path, md5(o_orderkey || o_orderpriority) AS h FROM orders WHERE o_orderkey % 13 <> 0),
 head AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'moved/' ELSE 'o/' END || o_orderkey AS path, md5(o_orderkey || CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 17 <> 0 THEN 'x' ELSE o_orderpriority END) AS h FROM orders WHERE o_orderkey % 11 <> 0),
 d AS (SELECT coalesce(b.path, n.path) AS path, b.h AS h0, n.h AS h1, CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN b.h <> n.h THEN 'modified' END AS change FROM base b FULL JOIN head n ON b.path = n.path)"""
RENAMES = """a AS (SELECT path, h1 AS h, row_number() OVER (PARTITION BY h1 ORDER BY path) AS n FROM d WHERE change = 'added'), x AS (SELECT path, h0 AS h, row_number() OVER (PARTITION BY h0 ORDER BY path) AS n FROM d WHERE change = 'deleted'),
 diff AS (SELECT CASE WHEN a.path IS NOT NULL AND x.path IS NOT NULL THEN 'renamed' WHEN a.path IS NOT NULL THEN 'added' ELSE 'deleted' END AS change, coalesce(a.path, x.path) AS path, CASE WHEN a.path IS NOT NULL AND x.path IS NOT NULL THEN x.path END AS old_path FROM a FULL JOIN x ON a.h = x.h AND a.n = x.n
  UNION ALL SELECT change, path, NULL FROM d WHERE change = 'modified')"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    base = o.where(k % 13 != 0).select(F.concat(F.lit("o/"), k).alias("path"), F.md5(F.concat(k, "o_orderpriority")).alias("content_hash"))
    folder = F.when(k % 17 == 0, "moved/").otherwise("o/")
    body = F.when((k % 7 == 0) & (k % 17 != 0), "x").otherwise(F.col("o_orderpriority"))
    return base, o.where(k % 11 != 0).select(F.concat(folder, k).alias("path"), F.md5(F.concat(k, body)).alias("content_hash"))


@query(f"WITH {SNAPS}, {RENAMES} SELECT change, path, old_path FROM diff")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.snapshot_diff(*_snapshots(spark, sf_dir), rename=True)


@query(
    f"""WITH {SNAPS}, {RENAMES}, acts AS (SELECT path, CASE change WHEN 'renamed' THEN 'added' ELSE change END AS action FROM diff UNION ALL SELECT old_path, 'deleted' FROM diff WHERE change = 'renamed')
 SELECT path, CASE action WHEN 'deleted' THEN 'deleted' ELSE 'replaced' END AS tombstone FROM acts WHERE action IN ('deleted', 'modified') GROUP BY ALL"""
)
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.tombstones(versions.sync_actions(versions.snapshot_diff(*_snapshots(spark, sf_dir), rename=True)))


@query(f"WITH {SNAPS}, {RENAMES} SELECT DISTINCT path FROM (SELECT path FROM diff UNION ALL SELECT old_path FROM diff) WHERE path LIKE 'moved/%'")
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = versions.snapshot_diff(*_snapshots(spark, sf_dir), rename=True)
    return versions.changed_paths(versions.with_path(diff, "moved/")).where(F.col("path").startswith("moved/"))


@query(f"WITH {SNAPS} SELECT coalesce(change, 'unchanged') AS c, count(*) AS n FROM d GROUP BY 1")
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = _snapshots(spark, sf_dir)
    name = F.element_at(F.create_map(*[F.lit(x) for p in (("new", "added"), ("changed", "modified"), ("vanished", "deleted"), ("unchanged", "unchanged")) for x in p]), F.col("state"))
    return versions.manifest_changes(head, base).groupBy(name.alias("c")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {SYMBOLS}, b AS (SELECT 'k' || symbol_id AS merge_key, path, symbol_id AS result_id, 1.0::double AS score FROM symbols WHERE symbol_id::bigint % 5 <> 0), o AS (SELECT 'k' || symbol_id AS merge_key, path, symbol_id AS result_id, 2.0::double AS score FROM symbols WHERE symbol_id::bigint % 3 = 0), t AS (SELECT DISTINCT path FROM symbols WHERE contains(path, 'brand1'))
 SELECT merge_key, score, 'overlay' AS layer FROM o UNION ALL SELECT merge_key, score, 'base' FROM b WHERE path NOT IN (SELECT path FROM t) AND merge_key NOT IN (SELECT merge_key FROM o)"""
)
def merged_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir).select(F.concat(F.lit("k"), "symbol_id").alias("merge_key"), "path", F.col("symbol_id").alias("result_id"))
    n = F.col("result_id").cast("long")
    base, overlay = s.where(n % 5 != 0).withColumn("score", F.lit(1.0)), s.where(n % 3 == 0).withColumn("score", F.lit(2.0))
    return versions.merge_layers(base, overlay, s.where(F.col("path").contains("brand1")).select("path")).select("merge_key", "score", "layer")


REFS = f"""{SYMBOLS}, b AS (SELECT symbol_id AS stable_id, kind, md5(content) AS h, signature AS s FROM symbols WHERE symbol_id::bigint % 13 <> 0), h AS (SELECT symbol_id AS stable_id, kind, md5(CASE WHEN symbol_id::bigint % 7 = 0 THEN 'x' ELSE content END) AS h, CASE WHEN symbol_id::bigint % 19 <> 0 THEN signature END AS s FROM symbols WHERE symbol_id::bigint % 11 <> 0)"""


@query(f"WITH {REFS} SELECT * FROM (SELECT coalesce(b.stable_id, h.stable_id) AS stable_id, coalesce(b.kind, h.kind) AS kind, CASE WHEN b.kind IS NULL THEN 'added' WHEN h.kind IS NULL THEN 'deleted' WHEN b.h <> h.h OR b.s IS DISTINCT FROM h.s THEN 'modified' END AS change FROM b FULL JOIN h ON b.stable_id = h.stable_id AND b.kind = h.kind) WHERE change IS NOT NULL")
def symbol_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = symbols(spark, sf_dir), F.col("symbol_id").cast("long")
    base = s.where(n % 13 != 0).select(F.col("symbol_id").alias("stable_id"), "kind", F.md5("content").alias("content_hash"), "signature")
    body = F.when(n % 7 == 0, "x").otherwise(F.col("content"))
    head = s.where(n % 11 != 0).select(F.col("symbol_id").alias("stable_id"), "kind", F.md5(body).alias("content_hash"), F.when(n % 19 != 0, F.col("signature")).alias("signature"))
    return versions.symbol_changes(base, head)


@query(
    f"""WITH {SYMBOLS}, b AS (SELECT * FROM symbols WHERE contains(path, 'brand1') QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, line_start, symbol_id) = 1), h AS (SELECT * FROM symbols WHERE contains(path, 'brand2') QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, line_start, symbol_id) = 1),
 c AS (SELECT coalesce(b.name, h.name) AS name, b.name IS NULL AS new_, h.name IS NULL AS gone, b.name IS NULL OR h.name IS NULL OR b.signature IS DISTINCT FROM h.signature AS signature_changed, b.name IS NULL OR h.name IS NULL OR b.content IS DISTINCT FROM h.content AS body_changed, b.name IS NULL OR h.name IS NULL OR b.line_start <> h.line_start OR b.line_end <> h.line_end AS line_range_shifted FROM b FULL JOIN h ON b.name = h.name)
 SELECT name, CASE WHEN new_ THEN 'added' WHEN gone THEN 'deleted' WHEN signature_changed OR body_changed OR line_range_shifted THEN 'modified' ELSE 'unchanged' END AS status, signature_changed, body_changed, line_range_shifted, CASE WHEN gone OR NOT body_changed THEN 0 ELSE 1 END AS lines_added, CASE WHEN new_ OR NOT body_changed THEN 0 ELSE 1 END AS lines_removed FROM c"""
)
def symbol_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols(spark, sf_dir)
    return versions.compare_symbol(s.where(F.col("path").contains("brand1")), s.where(F.col("path").contains("brand2")))


@query()
def line_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations")
    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = pages.select("conv_id", "turn", F.lag("text").over(turns).alias("before"), "text").where("before is not null")
    rows = rows.withColumn("d", versions.line_delta(F.col("before"), F.col("text")))
    return rows.select("conv_id", "turn", F.col("d.added").alias("added"), F.col("d.removed").alias("removed"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 9 <> 0")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = rows.where("k % 4 = 0").withColumn("v", F.col("v") + 1)
    return versions.delete_keys(versions.upsert(rows, new, ["k"]), rows.where("k % 9 = 0"), ["k"])


POLICY = policy.Policy(deny_paths=("src/**/brand1*.rs",), allow_paths=("src/{promo,small,economy}/*",), deny_types=("file",), deny_kinds=("variable",), allow_kinds=("function", "method", "class", "struct"))
BLOCKED = f"""{SYMBOLS}, r AS (SELECT *, CASE symbol_id::bigint % 10 WHEN 0 THEN 'file' WHEN 1 THEN 'snippet' ELSE 'symbol' END AS result_type FROM symbols),
 bl AS (SELECT *, CASE WHEN regexp_matches(path, '^src/(.*/)?brand1[^/]*\\.rs$') THEN 'path_denied' WHEN NOT regexp_matches(path, '^src/(promo|small|economy)/[^/]*$') THEN 'path_not_allowed' WHEN result_type = 'file' THEN 'type_denied' WHEN result_type = 'symbol' AND kind = 'variable' THEN 'kind_denied'
  WHEN result_type = 'symbol' AND kind NOT IN ('function','method','class','struct') THEN 'kind_not_allowed' END AS reason FROM r)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("symbol_id").cast("long") % 10
    return symbols(spark, sf_dir).withColumn("result_type", F.when(n == 0, "file").when(n == 1, "snippet").otherwise("symbol"))


@query(f"WITH {BLOCKED} SELECT reason, count(*) AS blocked FROM bl WHERE reason IS NOT NULL GROUP BY 1")
def blocked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.counters(_results(spark, sf_dir), POLICY)


@query(f"WITH {BLOCKED} SELECT symbol_id, content || CASE WHEN symbol_id::bigint % 2 = 0 THEN ' [REDACTED:high_entropy]' ELSE ' aaaaaaaaaaaaaaaaaaaaaaaa' END AS snippet FROM bl WHERE reason IS NULL")
def governed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.when(F.col("symbol_id").cast("long") % 2 == 0, " qX7zP2kL9vB4nM1sD8fG3hJ6").otherwise(" aaaaaaaaaaaaaaaaaaaaaaaa")
    rows = _results(spark, sf_dir).withColumn("snippet", F.concat("content", secret))
    return policy.apply(rows, POLICY).select("symbol_id", "snippet")


@query(
    """WITH v AS (SELECT p_partkey, ['symbol','snippet','file','file'][p_partkey % 4 + 1] AS t, ['src/a.rs','go.mod','src/tests/a.rs','conf/x.yaml','docs/readme.md','b/c_test.go','package.json','x/y.zz'][p_partkey % 8 + 1] AS p, CASE p_partkey % 5 WHEN 0 THEN 'use std::x' WHEN 1 THEN 'a call b' ELSE 'text' END AS s FROM part),
 f AS (SELECT *, regexp_matches(p, '(cargo\\.toml|go\\.mod|go\\.sum|package\\.json)$') OR s LIKE 'use %' AS dep, regexp_matches(p, '/tests/|/test/|_test\\.|\\.spec\\.|tests\\.rs$') AS tst, regexp_matches(p, '(\\.toml|\\.yaml|\\.yml|\\.ini|\\.json|dockerfile)$') AS cfg, regexp_matches(p, '(\\.md|\\.rst|\\.txt)$|/docs/|readme') AS dcs FROM v)
 SELECT p_partkey, CASE WHEN t = 'symbol' THEN 'definitions' WHEN NOT (dep OR tst OR cfg OR dcs) AND (contains(s, ' call ') OR t = 'snippet') THEN 'usages' WHEN dep THEN 'deps' WHEN tst THEN 'tests' WHEN cfg THEN 'config' WHEN dcs THEN 'docs' ELSE 'usages' END AS section FROM f"""
)
def context_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    t = pick(("symbol", "snippet", "file", "file"), 4)
    p = pick(("src/a.rs", "go.mod", "src/tests/a.rs", "conf/x.yaml", "docs/readme.md", "b/c_test.go", "package.json", "x/y.zz"), 8)
    s = F.when(k % 5 == 0, "use std::x").when(k % 5 == 1, "a call b").otherwise("text")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", context.section(t, p, none, none, s).alias("section"))


PACK = f"""{SYMBOLS}, cand AS (SELECT split_part(name, '_', 1) AS query_id, ['definitions','usages','deps','tests','config','docs'][symbol_id::bigint % 6 + 1] AS section, (symbol_id::bigint * 37 % 1000) / 1000.0::double AS score, path, line_start, line_end, symbol_id AS result_id, CASE WHEN symbol_id::bigint % 2 = 0 THEN 's' || symbol_id::bigint % 40 END AS sid, (10 + symbol_id::bigint % 31)::bigint AS tokens FROM symbols),
 sr AS (SELECT *, list_position(['definitions','usages','deps','tests','config','docs'], section) AS srank, coalesce(sid, 'span') || ':' || path || ':' || line_start || ':' || line_end AS ck FROM cand),
 cl AS (SELECT *, count(*) OVER (PARTITION BY query_id, ck) - 1 AS duplicates FROM sr QUALIFY row_number() OVER (PARTITION BY query_id, ck ORDER BY srank, score DESC, path, line_start, line_end, result_id) = 1),
 cp AS (SELECT *, [8, 8, 5, 4, 4, 3][srank] AS cap, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, path, line_start, line_end, result_id) AS n FROM cl),
 qu AS (SELECT *, n > cap AS overflow, row_number() OVER (PARTITION BY query_id ORDER BY n > cap, srank, n) AS place FROM cp)"""


def _pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("symbol_id").cast("long")
    rows = symbols(spark, sf_dir).select(
        F.substring_index("name", "_", 1).alias("query_id"),
        F.element_at(F.array(*[F.lit(s) for s in context.SECTIONS]), (n % 6 + 1).cast("int")).alias("section"),
        (n * 37 % 1000 / 1000.0).alias("score"),
        "path",
        "line_start",
        "line_end",
        F.col("symbol_id").alias("result_id"),
        F.when(n % 2 == 0, F.concat(F.lit("s"), n % 40)).alias("symbol_stable_id"),
        (10 + n % 31).alias("tokens"),
    )
    return context.queue(context.cluster(rows))


@query(f"WITH {PACK} SELECT query_id, result_id, section, overflow, place, duplicates FROM qu")
def pack_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir).select("query_id", "result_id", "section", "overflow", "place", "duplicates")


@query(
    f"""WITH RECURSIVE {PACK}, w AS (SELECT query_id, 0::bigint AS place, 0::bigint AS used, false AS kept FROM qu GROUP BY 1 UNION ALL SELECT w.query_id, q.place, CASE WHEN used + tokens <= 300 THEN used + tokens ELSE used END, used + tokens <= 300 FROM w JOIN qu q ON q.query_id = w.query_id AND q.place = w.place + 1)
 SELECT query_id, place::int AS place FROM w WHERE kept"""
)
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.fit_skipping(_pack(spark, sf_dir), 300)


@query(f"WITH {PACK}, u AS (SELECT query_id, place, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS used FROM qu) SELECT query_id, place, used::bigint AS used FROM u WHERE used <= 200")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.fit_prefix(_pack(spark, sf_dir), 200).select("query_id", "place", "used")


@query(f"WITH {PACK}, u AS (SELECT query_id, place, 2 + sum(strlen(path) + CASE WHEN place > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY place) AS bytes FROM qu) SELECT query_id, place, bytes::bigint AS bytes FROM u WHERE bytes <= 500")
def payload_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.fit_payload(_pack(spark, sf_dir), F.col("path"), 500).select("query_id", "place", "bytes")


@query(f"WITH {PACK}, k AS (SELECT DISTINCT query_id FROM cand), s AS (SELECT query_id, unnest(['definitions','usages','deps','tests','config','docs']) AS section FROM k) SELECT s.query_id, s.section, count(q.place) AS items, coalesce(sum(tokens), 0)::bigint AS tokens FROM s LEFT JOIN qu q ON q.query_id = s.query_id AND q.section = s.section AND NOT overflow GROUP BY ALL")
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pack(spark, sf_dir)
    return context.coverage(rows.where("not overflow"), rows.select("query_id").distinct())


@query("SELECT item_id AS query_id, unnest([{'r': 0, 'p': 'primary', 't': md5(text)}, {'r': 1, 'p': 'tests_probe', 't': md5(text || ' test')}, {'r': 2, 'p': 'deps_probe', 't': md5(text || ' use')}], recursive := true) FROM benchmark")
def pack_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return context.probes(q, "full", "rust").select("query_id", F.col("probe_rank").alias("r"), F.col("probe").alias("p"), F.md5("text").alias("t"))


@query("SELECT doc_id, md5(array_to_string(l[2:3], chr(10)) || '') AS range_md5, trim(l[1]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) >= 3")
def source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where(F.size(F.split("text", "\n")) >= 3)
    return rows.select("doc_id", F.md5(context.source_range(F.col("text"), F.lit(2), F.lit(3))).alias("range_md5"), context.source_line(F.col("text"), F.lit(1)).alias("line"))


RUN = f"""{QUERY_TERMS}, {sql_bm25("d", "doc_id", sql_tokens("text"), "documents")}, tg AS (SELECT item_id AS query_id, doc_id FROM documents JOIN benchmark ON doc_id % (SELECT count(*) FROM benchmark) = item_id),
 run AS (SELECT t.query_id, t.doc_id, rank, source AS path FROM d_top t JOIN documents USING (doc_id)), hit AS (SELECT query_id, doc_id, rank FROM run JOIN tg USING (query_id, doc_id)),
 m AS (SELECT t.query_id, coalesce(first_hit, 0) AS first_hit, coalesce(1.0 / first_hit, 0) AS rr, coalesce(found / targets, 0) AS recall, coalesce(dcg / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, least(targets, results)::bigint + 1) x(i)), 0) AS ndcg, largest / results AS clustering
  FROM (SELECT query_id, count(DISTINCT doc_id) AS targets FROM tg GROUP BY 1) t LEFT JOIN (SELECT query_id, sum(n) AS results, max(n) AS largest FROM (SELECT query_id, path, count(*) AS n FROM run GROUP BY 1, 2) GROUP BY 1) r USING (query_id)
  LEFT JOIN (SELECT query_id, min(rank) AS first_hit, count(*) AS found, sum(1 / log2(rank + 1.0)) AS dcg FROM hit GROUP BY 1) h USING (query_id))"""


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from seamline.operators import retrieval

    docs = table(spark, sf_dir, "documents")
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    found = retrieval.search(docs, "doc_id", text.default_tokens(F.col("text")), q, "item_id", text.default_tokens(F.col("query")), 10)
    run = found.join(docs.select("doc_id", F.col("source").alias("path")), "doc_id")
    # every document is judged relevant to one question
    dealt = docs.select("doc_id").crossJoin(F.broadcast(q.agg(F.count(F.lit(1)).alias("n")))).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"))
    targets = dealt.join(q.select("item_id"), "item_id").select(F.col("item_id").alias("query_id"), "doc_id")
    return run, targets


@query(f"WITH {RUN} SELECT query_id, first_hit, round(rr::double, 6) AS reciprocal_rank, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(clustering, 6) AS clustering FROM m")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.metrics(*_run(spark, sf_dir))
    return m.select("query_id", "first_hit", *[F.round(c, 6).alias(c) for c in ("reciprocal_rank", "recall", "ndcg", "clustering")])


@query(
    f"""WITH {RUN}, s AS (SELECT avg(rr) AS mrr, avg(recall) AS recall_at_k, avg(ndcg) AS ndcg_at_k FROM m), c AS (SELECT unnest([{{'metric': 'recall_at_k', 'v': recall_at_k, 'b': 0.55}}, {{'metric': 'mrr', 'v': mrr, 'b': 0.45}}, {{'metric': 'ndcg_at_k', 'v': ndcg_at_k, 'b': 0.47}}]) AS x FROM s)
 SELECT x.metric AS metric, round(x.v, 6) AS value, x.b::double AS bound, x.v >= x.b AS passed, CASE WHEN x.v < x.b THEN CASE x.metric WHEN 'recall_at_k' THEN 'recall_drop' ELSE 'ranking_shift' END END AS label FROM c"""
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = evaluation.Gate({"recall_at_k": (0.55, 0.58, 0.05), "mrr": (0.45, 0.5, 0.05), "ndcg_at_k": (0.45, 0.52, 0.05)}, {})
    return evaluation.gate(evaluation.summary(evaluation.metrics(*_run(spark, sf_dir))), rules).withColumn("value", F.round("value", 6))


@query("SELECT event_type AS intent, count(*) AS samples, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1")
def latency_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("intent"), F.col("value").alias("latency_ms"))
    return evaluation.latencies(rows).withColumn("mean_ms", F.round("mean_ms", 6))


@query(f"WITH {RUN} SELECT query_id || chr(9) || 'Q0' || chr(9) || t.doc_id || chr(9) || rank || chr(9) || printf('%.2f', round(score, 2)) || chr(9) || 'seamline' AS line FROM d_top t")
def trec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, _ = _run(spark, sf_dir)
    lines = evaluation.trec_run(run.withColumn("score", F.round("score", 2)))
    return lines.select(F.regexp_replace("line", r"(\.\d\d)0000\t", "$1\t").alias("line"))


@query(f"WITH {RUN} SELECT query_id, count(*) AS negative_hits FROM hit GROUP BY 1")
def negative_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.negative_hits(*_run(spark, sf_dir))


@query(
    f"""WITH {SYMBOLS} SELECT symbol_id, lower(path) = t OR path LIKE '%/' || t OR name = t OR qualified_name = t OR qualified_name LIKE '%::' || t AS hit FROM (SELECT *, ['brand1.rs','red_widget','promo::hot_gear','nothing'][symbol_id::bigint % 4 + 1] AS t FROM symbols)"""
)
def target_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.element_at(F.array(*[F.lit(x) for x in ("brand1.rs", "red_widget", "promo::hot_gear", "nothing")]), (F.col("symbol_id").cast("long") % 4 + 1).cast("int"))
    return symbols(spark, sf_dir).select("symbol_id", evaluation.matches(t, F.col("path"), F.col("name"), F.col("qualified_name"), F.col("symbol_id")).alias("hit"))


#: Events as updates of files in the enrichment queue.
QUEUE = """q AS (SELECT event_id AS id, user_id, ts AS enqueued_at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS generation, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'done' WHEN 'click' THEN 'running' ELSE 'pending' END AS status, ts + INTERVAL 1 MINUTE AS completed_at, event_id % 5 AS retry_count,
  CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 10 DAY END AS next_attempt_at FROM events), clock AS (SELECT max(ts) AS now FROM events)"""


def _queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").cast("timestamp").alias("enqueued_at"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "done").when(F.col("event_type") == "click", "running").otherwise("pending").alias("status"),
        (F.col("ts").cast("timestamp") + F.expr("interval 1 minute")).alias("completed_at"),
        (F.col("event_id") % 5).alias("retry_count"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp") + F.expr("interval 10 days")).alias("next_attempt_at"),
    )
    now = F.lit(e.agg(F.max("ts").cast("timestamp")).first()[0])
    return jobs.with_generations(rows, ["user_id"], ["enqueued_at", "id"]), now


@query(f"WITH {QUEUE} SELECT id, user_id, generation, generation < max(generation) OVER (PARTITION BY user_id) AS superseded FROM q")
def queue_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir)[0].select("id", "user_id", "generation", "superseded")


@query(f"WITH {QUEUE}, l AS (SELECT *, max(generation) OVER (PARTITION BY user_id) AS last_ FROM q) SELECT id, user_id, generation FROM l, clock WHERE status = 'pending' AND generation = last_ AND (next_attempt_at IS NULL OR next_attempt_at <= now)")
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, now = _queue(spark, sf_dir)
    return jobs.due(rows, ["user_id"], now).select("id", "user_id", "generation")


@query(f"WITH {QUEUE} SELECT id, CASE WHEN retry_count < 3 THEN 'pending' ELSE 'failed' END AS new_status, CASE WHEN retry_count < 3 THEN epoch(date_trunc('second', now))::bigint + least(900, 15 * pow(2, least(retry_count, 6)))::bigint ELSE 0 END AS due_at FROM q, clock WHERE status = 'failed'")
def retried_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, now = _queue(spark, sf_dir)
    out = jobs.retried(rows.where("status = 'failed'"), now, 3)
    return out.select("id", "new_status", F.coalesce(F.unix_seconds("new_attempt_at"), F.lit(0)).alias("due_at"))


@query(f"WITH {QUEUE} SELECT id, status FROM q, clock WHERE (status = 'done' AND (floor(epoch(now)) - floor(epoch(completed_at))) / 3600.0 > 48) OR (status = 'failed' AND (floor(epoch(now)) - floor(epoch(completed_at))) / 3600.0 > 168)")
def expired_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, now = _queue(spark, sf_dir)
    return jobs.expired(rows, now).select("id", "status")


@query(
    f"""WITH {QUEUE}, s AS (SELECT user_id, count(*) FILTER (status IN ('pending', 'running')) AS backlog, coalesce(max(CASE WHEN status IN ('pending', 'running') THEN floor((floor(epoch(now)) - floor(epoch(enqueued_at))) / 60) END), 0)::bigint AS lag_minutes, count(*) FILTER (status = 'failed' AND floor(epoch(completed_at)) >= floor(epoch(now)) - 3600) AS recent_failures FROM q, clock GROUP BY 1)
 SELECT user_id, backlog, lag_minutes, CASE WHEN lag_minutes >= 30 THEN 'high' WHEN lag_minutes >= 5 THEN 'medium' WHEN lag_minutes >= 1 THEN 'low' ELSE 'none' END AS lag_hint, CASE WHEN recent_failures > 0 OR backlog >= 128 THEN 'degraded' WHEN backlog > 0 THEN 'backlog' ELSE 'ready' END AS state FROM s"""
)
def queue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, now = _queue(spark, sf_dir)
    return jobs.queue_state(rows, now, ["user_id"]).select("user_id", "backlog", "lag_minutes", "lag_hint", "state")


@query("SELECT user_id, count(*) AS active FROM events WHERE event_type IN ('click', 'signup') GROUP BY 1 HAVING count(*) > 1")
def duplicate_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "signup", "queued").otherwise("published")
    return jobs.duplicate_active(table(spark, sf_dir, "events").withColumn("status", status), ["user_id"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events QUALIFY n <= 3")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 3).select("user_id", "event_id", "n")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20)")
def evicted_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("auto_discovered", F.col("c_custkey") % 3 == 0)
    return jobs.evicted(rows, "c_acctbal", "c_custkey", 20).select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey <> 0 AND s_acctbal < 3000 AND s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 0)")
def prunable_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    branches = s.select("s_suppkey", F.lit("r").alias("repo"), F.when(F.col("s_nationkey") == 0, "main").otherwise(F.concat(F.lit("b"), "s_suppkey")).alias("ref"), F.col("s_acctbal").alias("last_accessed_at"))
    leases = s.select(F.lit("r").alias("repo"), F.concat(F.lit("b"), "s_suppkey").alias("ref"), F.when(F.col("s_suppkey") % 4 == 0, 1).otherwise(0).alias("refcount"))
    return jobs.prunable(branches, leases, "main", F.lit(3000.0)).select("s_suppkey")


@query("SELECT vec_id, len(embedding)::int AS n, round(list_sum(embedding::double[]), 5) AS total FROM embeddings")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.decode(vectors.encode(F.col("embedding"))).alias("v"))
    return rows.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by a stream over the events, run to its end; its last state is the result."""
    from seamline.streaming import queue

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"counts_{abs(hash(sf_dir))}"
    writer = queue.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        writer = writer.option("checkpointLocation", f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    writer.start().awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))
