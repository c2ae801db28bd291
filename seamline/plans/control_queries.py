"""Queries over control tables and over the semantic branch's plain parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators import context, control, semantic
from seamline.plans.registry import query, table
from seamline.plans.version_queries import QUEUE, _queue

ROWS = f"{QUEUE}, r AS (SELECT *, user_id % 7 AS project, user_id AS path FROM q)"


def _rows(spark: SparkSession, sf_dir: str):
    rows, now = _queue(spark, sf_dir)
    none = F.lit(None).cast("timestamp")
    rows = rows.drop("superseded").withColumns({"project": F.col("user_id") % 7, "path": F.col("user_id"), "started_at": none, "last_error_code": F.lit(None).cast("string")})
    return rows, now


DUE = f"""{ROWS}, d AS (SELECT *, status = 'pending' AND generation = max(generation) OVER (PARTITION BY project, path) AND (next_attempt_at IS NULL OR next_attempt_at <= now) AS due FROM r, clock),
 tk AS (SELECT *, due AND row_number() OVER (PARTITION BY project, due ORDER BY enqueued_at, id) <= 3 AS taken FROM d)"""


@query(f"WITH {DUE} SELECT id, project, CASE WHEN taken THEN 'running' ELSE status END AS status, taken FROM tk")
def dequeued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after each project has taken its first three due rows."""
    rows, now = _rows(spark, sf_dir)
    return control.dequeued(rows, now, 3, ["project"]).select("id", "project", "status", "taken")


OUTCOME = "CASE id % 4 WHEN 1 THEN 'read timeout' WHEN 2 THEN 'missing embedding model' WHEN 3 THEN 'tantivy gone' END"
CODE = "CASE id % 4 WHEN 1 THEN 'semantic_worker_timeout' WHEN 2 THEN 'semantic_embedding_provider_unavailable' WHEN 3 THEN 'semantic_snippet_load_failed' END"


def _outcome():
    k = F.col("id") % 4
    return F.when(k == 1, "read timeout").when(k == 2, "missing embedding model").when(k == 3, "tantivy gone")


@query(
    f"""WITH {ROWS}, o AS (SELECT *, status = 'running' AND id % 10 <> 0 AS told, {OUTCOME} AS error FROM r)
 SELECT id, CASE WHEN NOT told THEN status WHEN error IS NULL THEN 'done' WHEN retry_count < 3 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN told AND error IS NOT NULL AND retry_count < 3 THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN told THEN {CODE} END AS last_error_code FROM o"""
)
def completed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running rows after their worker's outcomes."""
    rows, now = _rows(spark, sf_dir)
    outcomes = rows.where("id % 10 <> 0").select("id", _outcome().alias("error"))
    return control.completed(rows, outcomes, now, ["id"]).select("id", "status", "retry_count", "last_error_code")


@query(
    f"""WITH {DUE}, w AS (SELECT *, taken AND id % 5 <> 0 AS told, {OUTCOME} AS error FROM tk)
 SELECT id, CASE WHEN told THEN CASE WHEN error IS NULL THEN 'done' WHEN retry_count < 3 THEN 'pending' ELSE 'failed' END ELSE status END AS status FROM w"""
)
def worker_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One worker cycle of each project; what it doesn't get to waits on."""
    rows, now = _rows(spark, sf_dir)
    work = lambda taken: taken.where("id % 5 <> 0").select("id", _outcome().alias("error"))
    return control.worker_cycle(rows, work, now, 3, ["id"], ["project"]).select("id", "status")


@query(
    f"""WITH {QUEUE}, g AS (SELECT id FROM q, clock WHERE (status = 'done' AND (floor(epoch(now)) - floor(epoch(completed_at))) / 3600.0 > 48) OR (status = 'failed' AND (floor(epoch(now)) - floor(epoch(completed_at))) / 3600.0 > 168) ORDER BY completed_at, id LIMIT 25)
 SELECT id, status FROM q WHERE id NOT IN (SELECT id FROM g)"""
)
def cleaned_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue without its 25 oldest rows that are over."""
    rows, now = _rows(spark, sf_dir)
    return control.cleaned(rows, now, 48, 168, 25, ["id"]).select("id", "status")


JOBS = """j AS (SELECT o_orderkey::varchar AS job_id, (o_custkey % 50)::varchar AS project_id, o_orderpriority AS ref, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'queued' ELSE 'failed' END ELSE 'running' END AS status, o_orderdate AS created_at, o_totalprice AS price FROM orders)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "published").when((F.col("o_orderstatus") == "O") & (k % 3 == 0), "queued").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("job_id"), (F.col("o_custkey") % 50).cast("string").alias("project_id"), F.col("o_orderpriority").alias("ref"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


@query(
    f"""WITH {JOBS}, old AS (SELECT * FROM j WHERE job_id::bigint % 50 <> 0), new_ AS (SELECT * REPLACE ('queued' AS status) FROM j WHERE job_id::bigint % 50 = 0 QUALIFY row_number() OVER (PARTITION BY project_id, ref ORDER BY created_at, job_id) = 1),
 busy AS (SELECT DISTINCT project_id, ref FROM old WHERE status IN ('queued', 'running', 'validating')) SELECT job_id, status FROM old UNION ALL SELECT job_id, status FROM new_ ANTI JOIN busy USING (project_id, ref)"""
)
def created_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after new ones have come: one active of each project and ref."""
    rows, k = _jobs(spark, sf_dir), F.col("job_id").cast("long")
    return control.created(rows.where(k % 50 != 0), rows.where(k % 50 == 0).withColumn("status", F.lit("queued"))).select("job_id", "status")


NEXT = "['running', 'validating', 'published', 'rolled_back', 'failed'][job_id::bigint % 5 + 1]"


@query(
    f"""WITH {JOBS}, n AS (SELECT *, {NEXT} AS next_ FROM j), f AS (SELECT *, (status = 'queued' AND next_ IN ('running', 'failed')) OR (status = 'running' AND next_ IN ('validating', 'published', 'failed', 'rolled_back')) AS fits FROM n)
 SELECT job_id, CASE WHEN fits THEN next_ ELSE status END AS status, NOT fits AS rejected, CASE WHEN fits AND next_ = 'failed' THEN 'no space' END AS error_message FROM f"""
)
def moved_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a change of state each; those with no such successor stay."""
    rows = _jobs(spark, sf_dir).withColumns({"error_message": F.lit(None).cast("string"), "updated_at": F.col("created_at")})
    states = F.array(*[F.lit(s) for s in ("running", "validating", "published", "rolled_back", "failed")])
    new = F.element_at(states, (F.col("job_id").cast("long") % 5 + 1).cast("int"))
    changes = rows.select("job_id", new.alias("new_status"), "updated_at").withColumn("error_message", F.when(F.col("new_status") == "failed", "no space"))
    return control.moved(rows, changes).select("job_id", "status", "rejected", "error_message")


@query(f"WITH {JOBS}, i AS (SELECT *, CASE WHEN status IN ('queued', 'running') AND job_id::bigint % 2 = 0 THEN 'interrupted' ELSE status END AS s FROM j) SELECT project_id, count(*) FILTER (s = 'interrupted') AS interrupted, max_by(job_id, (created_at, job_id)) FILTER (s = 'interrupted') AS last_interrupted, count(*) FILTER (s IN ('queued', 'running', 'validating')) AS active FROM i GROUP BY 1")
def recovery_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was cut off, by project."""
    cut = F.col("status").isin("queued", "running") & (F.col("job_id").cast("long") % 2 == 0)
    rows = _jobs(spark, sf_dir).withColumn("status", F.when(cut, "interrupted").otherwise(F.col("status"))).withColumn("updated_at", F.col("created_at"))
    return control.recovery_report(rows)


BRANCHES = "b AS (SELECT 'n' || s_nationkey AS repo, 'b' || s_suppkey AS ref, 'c' || s_suppkey AS last_indexed_commit, s_suppkey % 9 AS file_count, s_suppkey % 5 AS symbol_count, CASE WHEN s_suppkey % 6 = 0 THEN 'stale' ELSE 'active' END AS status, s_suppkey AS k FROM supplier)"


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("n"), "s_nationkey").alias("repo"), F.concat(F.lit("b"), k).alias("ref"), F.concat(F.lit("c"), k).alias("last_indexed_commit"), (k % 9).cast("int").alias("file_count"), (k % 5).cast("int").alias("symbol_count"),
        F.when(k % 6 == 0, "stale").otherwise("active").alias("status"), F.lit(None).cast("timestamp").alias("last_accessed_at"), k.alias("k"),
    )


@query(
    f"""WITH {BRANCHES}, p AS (SELECT repo, ref, 'd' || k AS c, 7 AS f, 8 AS s FROM b WHERE k % 3 = 0), o AS (SELECT * FROM b WHERE k % 4 <> 0)
 SELECT coalesce(o.repo, p.repo) AS repo, coalesce(o.ref, p.ref) AS ref, coalesce(c, last_indexed_commit) AS last_indexed_commit, coalesce(f, file_count)::int AS file_count, coalesce(s, symbol_count)::int AS symbol_count, CASE WHEN c IS NOT NULL THEN 'active' ELSE status END AS status FROM o FULL JOIN p ON o.repo = p.repo AND o.ref = p.ref"""
)
def branch_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch states after published syncs."""
    rows = _branches(spark, sf_dir)
    done = rows.where("k % 3 = 0").select("repo", "ref", F.concat(F.lit("d"), "k").alias("commit"), F.lit(7).alias("file_count"), F.lit(8).alias("symbol_count"))
    return control.synced(rows.where("k % 4 <> 0").drop("k"), done, F.lit("2026-01-01").cast("timestamp")).drop("last_accessed_at")


@query(f"WITH {BRANCHES} SELECT CASE WHEN repo = 'n1' THEN 'local' ELSE repo END AS repo, ref, CASE WHEN repo = 'n1' THEN 'stale' ELSE status END AS status FROM b")
def remapped_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported branch states under the local project."""
    return control.remapped(_branches(spark, sf_dir), "n1", "local").select("repo", "ref", "status")


@query(
    f"""WITH {BRANCHES} SELECT repo, ref, CASE WHEN 'c' || CASE WHEN k % 2 = 0 THEN k ELSE k + 1 END = last_indexed_commit THEN 'fresh' WHEN k % 3 = 0 THEN 'syncing' ELSE 'stale' END AS state,
 CASE WHEN k % 2 = 0 THEN 'proceed' WHEN k % 3 = 0 THEN 'proceed_with_stale_indicator' WHEN k % 5 = 0 THEN 'block' ELSE 'proceed_with_stale_indicator_and_sync' END AS action FROM b"""
)
def branch_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each branch's index is of its head, and what the policy makes of it."""
    rows = _branches(spark, sf_dir)
    head = F.concat(F.lit("c"), F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(F.col("k") + 1))
    policy = F.when(F.substring("ref", 2, 20).cast("long") % 5 == 0, "strict").otherwise("balanced")
    busy = rows.where("k % 3 = 0").select("repo", "ref", F.lit("running").alias("status"))
    return semantic.freshness(rows.select("repo", "ref", "last_indexed_commit"), rows.select("repo", "ref", head.alias("head_commit")), busy, policy)


@query(
    """WITH l AS (SELECT s_suppkey AS k, s_suppkey % 3 AS n FROM supplier WHERE s_suppkey % 2 = 0), e AS (SELECT l_suppkey AS k, sum(CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 ELSE 0 END) AS d, max(l_shipdate) AS at_ FROM lineitem GROUP BY 1)
 SELECT 'b' || coalesce(l.k, e.k) AS ref, greatest(coalesce(n, 0) + coalesce(d, 0), 0)::int AS refcount, CASE WHEN coalesce(n, 0) + coalesce(d, 0) > 0 THEN 'active' ELSE 'idle' END AS status, at_ AS last_used_at FROM l FULL JOIN e ON l.k = e.k"""
)
def worktree_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases after acquisitions and releases."""
    k = F.col("s_suppkey")
    held = table(spark, sf_dir, "supplier").where(k % 2 == 0).select(F.lit("r").alias("repo"), F.concat(F.lit("b"), k).alias("ref"), (k % 3).cast("int").alias("refcount"), F.lit(1).alias("owner_pid"), F.lit(None).cast("date").alias("last_used_at"))
    delta = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    events = table(spark, sf_dir, "lineitem").select(F.lit("r").alias("repo"), F.concat(F.lit("b"), "l_suppkey").alias("ref"), delta.alias("delta"), F.lit(2).alias("owner_pid"), F.col("l_shipdate").alias("at"))
    return control.leased(held, events.withColumn("at", F.col("at").cast(table(spark, sf_dir, "lineitem").schema["l_shipdate"].dataType))).select("ref", "refcount", "status", "last_used_at")


@query(
    """WITH known AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_custkey END AS project_id, (c_custkey % 3 = 0)::int AS auto, CASE WHEN c_custkey % 5 = 0 THEN 'ready' ELSE 'unknown' END AS status FROM customer WHERE c_custkey % 4 <> 0),
 seen AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT coalesce(known.k, seen.k) AS k, coalesce(project_id, CASE WHEN seen.k IS NOT NULL THEN 'q' || seen.k END) AS project_id, CASE WHEN known.k IS NULL THEN 1 ELSE auto END AS auto, coalesce(status, 'unknown') AS status FROM known FULL JOIN seen ON known.k = seen.k)
 SELECT '/w/' || r.k AS workspace_path, project_id, auto::int AS auto_discovered, CASE WHEN status = 'unknown' AND k % 6 = 1 THEN 'indexing' ELSE status END AS index_status, CASE WHEN status = 'unknown' AND k % 6 = 1 THEN 'a' END AS claimant FROM r"""
)
def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces after sightings and claims."""
    k = F.col("c_custkey")
    path = lambda c: F.concat(F.lit("/w/"), c)
    known = table(spark, sf_dir, "customer").where(k % 4 != 0).select(path(k).alias("workspace_path"), F.when(k % 2 == 0, F.concat(F.lit("p"), k)).alias("project_id"), (k % 3 == 0).cast("int").alias("auto_discovered"), F.lit(None).cast("date").alias("last_used_at"), F.when(k % 5 == 0, "ready").otherwise("unknown").alias("index_status"))
    seen = table(spark, sf_dir, "orders").select(path(F.col("o_custkey")).alias("workspace_path"), F.concat(F.lit("q"), "o_custkey").alias("project_id"), F.lit(1).alias("auto_discovered"), F.col("o_orderdate").alias("last_used_at"))
    now = control.registered(known, seen)
    n = F.substring("workspace_path", 4, 20).cast("long")
    claims = now.where(n % 6 == 1).select("workspace_path", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("claimant"))
    return control.claimed(now, claims).drop("last_used_at")


@query("""SELECT c_custkey AS k, p, p = '/data' OR starts_with(p, '/data/') OR starts_with(p, '/srv/x/') AS allowed FROM (SELECT c_custkey, ['/data', '/data/a', '/data2/a', '/srv/x/y', '/srv/xy', '/etc'][c_custkey % 6 + 1] AS p FROM customer)""")
def allowed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under the allowed roots; detours by dots are resolved first."""
    k = F.col("c_custkey")
    p = F.element_at(F.array(*[F.lit(x) for x in ("/data", "/data/a", "/data2/a", "/srv/x/y", "/srv/xy", "/etc")]), (k % 6 + 1).cast("int"))
    winding = F.when(k % 4 == 0, F.concat(F.lit("/tmp/.."), p)).when(k % 4 == 1, F.concat(p, F.lit("/b/../."))).otherwise(p)
    return table(spark, sf_dir, "customer").select(k.alias("k"), p.alias("p"), control.inside(winding, ["/data", "/srv/x/"]).alias("allowed"))


@query("""WITH m AS (SELECT 'f' || c_custkey AS path, md5(c_name) AS content_hash FROM customer WHERE c_custkey % 3 <> 0) SELECT 'f' || c_custkey AS path, content_hash FROM customer LEFT JOIN m ON m.path = 'f' || c_custkey""")
def manifest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes of all asked paths."""
    c = table(spark, sf_dir, "customer").select(F.lit("r").alias("repo"), F.lit("main").alias("ref"), F.concat(F.lit("f"), "c_custkey").alias("path"), F.md5("c_name").alias("content_hash"), "c_custkey")
    return control.manifest_hashes(c.where("c_custkey % 3 <> 0"), c.select("repo", "ref", "path")).select("path", "content_hash")


@query(
    """WITH c AS (SELECT p_partkey AS k, ['', 'code_quality', ' High_Quality ', 'odd'][p_partkey % 4 + 1] AS profile, CASE WHEN p_partkey % 5 = 0 THEN 'own-model' ELSE '' END AS model, ['local', 'voyage', 'openai'][p_partkey % 3 + 1] AS provider, p_partkey % 2 = 0 AS leave_ FROM part),
 m AS (SELECT *, CASE WHEN model <> '' THEN model WHEN lower(trim(profile)) = 'code_quality' THEN 'JinaEmbeddingsV2BaseCode' WHEN lower(trim(profile)) = 'high_quality' THEN 'BGELargeENV15' ELSE 'NomicEmbedTextV15Q' END AS chosen FROM c)
 SELECT k, CASE WHEN trim(profile) = '' THEN 'fast_local' ELSE lower(trim(profile)) END AS profile, chosen AS model, CASE chosen WHEN 'BGELargeENV15' THEN 1024 ELSE 768 END::int AS dimensions, CASE WHEN provider <> 'local' AND leave_ THEN provider ELSE 'local' END AS provider, provider <> 'local' AND NOT leave_ AS external_blocked, provider = 'local' AND chosen = 'BGELargeENV15' AS wrong FROM m"""
)
def embedding_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model, dimensions and provider by settings."""
    k = F.col("p_partkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    c = semantic.model_choice(pick(4, "", "code_quality", " High_Quality ", "odd"), F.when(k % 5 == 0, "own-model").otherwise(""), pick(3, "local", "voyage", "openai"), F.lit(768), k % 2 == 0)
    rows = table(spark, sf_dir, "part").select(k.alias("k"), c.alias("c"))
    return rows.select("k", "c.profile", "c.model", "c.dimensions", "c.provider", "c.external_blocked", F.col("c.error").isNotNull().alias("wrong"))


@query(
    """SELECT vec_id, CASE vec_id % 6 WHEN 1 THEN 'external_embedding_index_mixed_presence' WHEN 2 THEN 'external_embedding_index_out_of_range' WHEN 3 THEN 'external_embedding_duplicate_index' WHEN 4 THEN 'external_embedding_result_count_mismatch' END AS error,
 CASE vec_id % 6 WHEN 0 THEN round(embedding[1]::double, 5) WHEN 5 THEN round(embedding[2]::double, 5) END AS first FROM embeddings"""
)
def aligned_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's answers, two vectors each, put in order or refused."""
    k, e = F.col("vec_id") % 6, F.col("embedding")
    one = lambda index, v: F.struct(index.cast("int").alias("index"), F.array(v).alias("embedding"))
    none, a, b = F.lit(None).cast("int"), F.element_at(e, 1), F.element_at(e, 2)
    data = (
        F.when(k == 0, F.array(one(F.lit(1), b), one(F.lit(0), a)))
        .when(k == 1, F.array(one(F.lit(0), a), one(none, b)))
        .when(k == 2, F.array(one(F.lit(0), a), one(F.lit(2), b)))
        .when(k == 3, F.array(one(F.lit(0), a), one(F.lit(0), b)))
        .when(k == 4, F.array(one(none, a)))
        .otherwise(F.array(one(none, b), one(none, a)))
    )
    rows = table(spark, sf_dir, "embeddings").select("vec_id", semantic.aligned(data, F.lit(2), F.lit(1)).alias("x"))
    return rows.select("vec_id", "x.error", F.round(F.element_at(F.element_at("x.vectors", 1), 1).cast("double"), 5).alias("first"))


@query(
    """WITH c AS (SELECT event_id, ['local', 'cohere', 'cross-encoder', 'none'][event_id % 4 + 1] AS p, event_id % 3 = 0 AS leave_, CASE WHEN event_id % 5 = 0 THEN 'timeout' END AS failure FROM events)
 SELECT event_id, CASE WHEN p IN ('local', 'none') OR (p = 'cohere' AND NOT leave_) OR failure IS NOT NULL THEN 'local' ELSE p END AS provider, p NOT IN ('local', 'none') AND ((p = 'cohere' AND NOT leave_) OR failure IS NOT NULL) AS fallback, CASE WHEN p = 'cohere' AND NOT leave_ THEN 'external_provider_blocked' WHEN p IN ('cohere', 'cross-encoder') THEN failure END AS reason FROM c"""
)
def rerank_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who reranks, and why it isn't who was asked."""
    n = F.col("event_id")
    provider = F.element_at(F.array(*[F.lit(x) for x in ("local", "cohere", "cross-encoder", "none")]), (n % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", semantic.rerank_dispatch(provider, n % 3 == 0, F.when(n % 5 == 0, "timeout")).alias("x"))
    return rows.select("event_id", "x.provider", "x.fallback", "x.reason")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 10 WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS candidates, CASE WHEN event_id % 3 = 0 THEN 4 WHEN event_id % 3 = 1 THEN 3 ELSE 0 END AS edges, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'n' || user_id END AS query FROM events""")
def result_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What JSON results and parameters tell."""
    n = F.col("event_id")
    results = F.when(n % 3 == 0, F.format_string('{"total_candidates": %d, "total_edges": 4}', n % 10)).when(n % 3 == 1, '{"results": [1, {"a": 2}], "callers": [1], "callees": [2, 3]}').otherwise("{}")
    parameters = F.when(n % 3 == 0, F.format_string('{"query": "%s", "name": "x"}', F.col("event_type"))).when(n % 3 == 1, F.format_string('{"symbol_name": "n%d"}', F.col("user_id"))).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", semantic.candidates_of(results).alias("candidates"), semantic.edges_of(results).alias("edges"), semantic.query_of(parameters).alias("query"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || '...' WHEN c_custkey % 3 = 1 THEN c_name ELSE 'fallback' END AS snippet FROM customer")
def source_at_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files as a ref has them, cut to a number of lines; where the ref lacks the file, the text given."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.concat(F.lit("f"), k).alias("path"), F.lit(2).alias("line_start"), (F.lit(2) + F.when(k % 3 == 0, 5).otherwise(0)).alias("line_end"), F.lit("fallback").alias("fallback"), "c_name")
    files = rows.where(k % 3 != 2).select("path", F.concat(F.lit("first\n"), "c_name", F.lit("\nthird\nfourth")).alias("content"))
    return context.source_at(rows, files, most=1).select("k", "snippet")

