"""The semantic branch: model choice, vectors of providers, nearest rows, and how they join the lexical branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions import scoring
from seamline.operators import ranking, vectors

# Model of each profile, and the dimensions of known models.
PROFILE_MODELS = {"code_quality": "JinaEmbeddingsV2BaseCode", "high_quality": "BGELargeENV15"}
DEFAULT_MODEL = "NomicEmbedTextV15Q"
DIMENSIONS = {"JinaEmbeddingsV2BaseCode": 768, "BGELargeENV15": 1024, "NomicEmbedTextV15Q": 768}


def _among(table: dict, key: Column) -> Column:
    out = F.lit(None)
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def model_choice(profile: Column, model: Column, provider: Column, dimensions: Column, external_allowed: Column) -> Column:
    """struct(profile, model, dimensions, provider, external_blocked, error): a named model wins over the profile's; an outside provider needs leave, else the local one is used."""
    profile = F.lower(F.trim(F.coalesce(profile, F.lit(""))))
    named = F.trim(F.coalesce(model, F.lit("")))
    chosen = F.when(named != "", named).otherwise(F.coalesce(_among(PROFILE_MODELS, profile), F.lit(DEFAULT_MODEL)))
    expected = F.coalesce(_among(DIMENSIONS, chosen), dimensions)
    outside = F.lower(provider).isin("voyage", "openai")
    error = F.when((provider == "local") & (dimensions != expected), F.format_string("embedding dimensions mismatch: model=%s expected=%d configured=%d", chosen, expected, dimensions))
    return F.struct(
        F.when(profile == "", "fast_local").otherwise(profile).alias("profile"),
        chosen.alias("model"),
        expected.alias("dimensions"),
        F.when(outside & external_allowed, F.lower(provider)).otherwise("local").alias("provider"),
        (outside & ~external_allowed).alias("external_blocked"),
        error.alias("error"),
    )


def aligned(data: Column, expected: Column, dimensions: Column) -> Column:
    """struct(vectors, error) of a provider's answer, an array of (index, embedding): in the order asked for, or why it can't be used."""
    size, indexed = F.size(data), F.size(F.filter(data, lambda x: x["index"].isNotNull()))
    out_of_range = F.filter(data, lambda x: (x["index"] < 0) | (x["index"] >= expected))
    wrong = F.filter(data, lambda x: F.size(x["embedding"]) != dimensions)
    distinct = F.size(F.array_distinct(F.transform(data, lambda x: x["index"])))
    error = (
        F.when((indexed > 0) & (indexed != size), "external_embedding_index_mixed_presence")
        .when((indexed > 0) & (F.size(out_of_range) > 0), "external_embedding_index_out_of_range")
        .when((indexed == 0) & (size != expected), "external_embedding_result_count_mismatch")
        .when(F.size(wrong) > 0, "external_embedding_dimensions_mismatch")
        .when((indexed > 0) & (distinct < size), "external_embedding_duplicate_index")
        .when((indexed > 0) & (size < expected), "external_embedding_missing_index")
    )
    placed = F.when(indexed > 0, F.array_sort(data, lambda a, b: (a["index"] - b["index"]).cast("int"))).otherwise(data)
    return F.struct(F.when(error.isNull(), F.transform(placed, lambda x: x["embedding"])).alias("vectors"), error.alias("error"))


def search(rows: DataFrame, queries: DataFrame, limit: int, scope: str | None = None) -> DataFrame:
    """Nearest rows (vec_id, embedding) of queries (query_id, query, embedding, gate): those whose gate is `run`, with a query and a vector. provenance is `semantic`."""
    asked = queries.where((F.col("gate") == "run") & (F.trim("query") != "") & (F.size("embedding") > 0))
    found = vectors.nearest(rows, asked.select("query_id", "embedding", *([scope] if scope else [])), limit, scope)
    return found.withColumn("provenance", F.lit("semantic"))


def hybrid(lexical: DataFrame, semantic: DataFrame, ratio: float, lexical_fanout: int, semantic_fanout: int) -> DataFrame:
    """Both branches (query_id, key, rank, score) of each query blended; where a query has one branch alone, its scores stay."""
    rows = ranking.blend(lexical, semantic, ratio, lexical_fanout, semantic_fanout)
    whole = Window.partitionBy("query_id")
    only_lexical = F.max((F.col("provenance") != "lexical").cast("int")).over(whole) == 0
    only_semantic = F.max((F.col("provenance") != "semantic").cast("int")).over(whole) == 0
    own = lambda branch, name: branch.groupBy("query_id", "key").agg(F.max("score").alias(name))
    rows = rows.join(own(lexical, "__l"), ["query_id", "key"], "left").join(own(semantic, "__s"), ["query_id", "key"], "left")
    return rows.withColumn("score", F.when(only_lexical, F.col("__l")).when(only_semantic, F.col("__s")).otherwise(F.col("score"))).drop("__l", "__s")


def enriched(hits: DataFrame, symbols: DataFrame, key: str = "symbol_stable_id") -> DataFrame:
    """Hits with what they lack of kind, name and qualified name, from the symbol of their stable id (and ref, where both have it)."""
    on = [key, *(["ref"] if "ref" in hits.columns and "ref" in symbols.columns else [])]
    facts = [c for c in ("kind", "name", "qualified_name") if c in symbols.columns]
    one = symbols.withColumn("__n", F.row_number().over(Window.partitionBy(*on).orderBy(*facts))).where("__n = 1")
    rows = hits.join(one.select(*on, *[F.col(c).alias(f"__{c}") for c in facts]), on, "left")
    return rows.withColumns({c: F.coalesce(c, f"__{c}") if c in hits.columns else F.col(f"__{c}") for c in facts}).drop(*[f"__{c}" for c in facts])


def adjusted(results: DataFrame, query: str = "query") -> DataFrame:
    """Rows that only the semantic branch has found gain by their kind and lose in test files, within the budgets of these signals."""
    kind = F.col("kind")
    own = scoring.role_weight(kind) + scoring.clamp(scoring.kind_adjustment(kind) + scoring.query_kind_boost(F.col(query), kind), -scoring.KIND_BOUND, scoring.KIND_BOUND)
    gain = scoring.within_budget(F.when(kind.isNotNull(), own).otherwise(0.0), "kind_match") + scoring.within_budget(scoring.test_file_penalty(F.col("path")), "test_file_penalty")
    return results.withColumn("score", F.when(F.col("provenance") == "semantic", F.col("score") + gain).otherwise(F.col("score")))


def rerank_dispatch(provider: Column, external_allowed: Column, failure: Column) -> Column:
    """struct(provider, fallback, reason, external_blocked): who reranks. What isn't local falls back to local with a reason, if it may not be called or fails (failure not null)."""
    asked = F.lower(F.trim(F.coalesce(provider, F.lit("local"))))
    local = asked.isin("none", "local", "")
    cross = asked == "cross-encoder"
    blocked = ~local & ~cross & ~external_allowed
    failed = ~local & ~blocked & failure.isNotNull()
    return F.struct(
        F.when(local | blocked | failed, "local").otherwise(asked).alias("provider"),
        (blocked | failed).alias("fallback"),
        F.when(blocked, "external_provider_blocked").when(failed, failure).alias("reason"),
        blocked.alias("external_blocked"),
    )


def reranked(results: DataFrame, local, outside=None, provider: str = "local", external_allowed: bool = False) -> DataFrame:
    """Results by the reranker asked for: `outside` (rows in, rows with `score` and `failure` out) where it may be called, `local` for queries where it failed and in all other cases."""
    asked = rerank_dispatch(F.lit(provider), F.lit(external_allowed), F.lit(None).cast("string"))
    if outside is None or provider.strip().lower() in ("none", "local", "") or provider.strip().lower() != "cross-encoder" and not external_allowed:
        return local(results).withColumn("rerank", asked)
    tried = outside(results)
    failures = tried.groupBy("query_id").agg(F.max("failure").alias("failure"))
    good = tried.join(failures.where("failure is null").select("query_id"), "query_id", "left_semi").drop("failure").withColumn("rerank", asked)
    bad = results.join(failures.where("failure is not null"), "query_id")
    back = local(bad).withColumn("rerank", rerank_dispatch(F.lit(provider), F.lit(external_allowed), F.col("failure"))).drop("failure")
    return good.unionByName(back, allowMissingColumns=True)


def candidates_of(results: Column) -> Column:
    """Candidates that a JSON result tells of: its count, else its results, else none."""
    count = F.get_json_object(results, "$.total_candidates").try_cast("long")
    return F.coalesce(count, F.json_array_length(F.get_json_object(results, "$.results")), F.lit(0)).cast("long")


def edges_of(results: Column) -> Column:
    """Edges that a JSON result tells of: its count, else its callers and callees."""
    size = lambda name: F.coalesce(F.json_array_length(F.get_json_object(results, f"$.{name}")), F.lit(0))
    count = F.get_json_object(results, "$.total_edges").try_cast("long")
    return F.coalesce(count, size("callers") + size("callees")).cast("long")


def query_of(parameters: Column) -> Column:
    """The query text among JSON parameters, under any of its names."""
    return F.coalesce(*[F.get_json_object(parameters, f"$.{name}") for name in ("query", "name", "symbol_name")])


def freshness(branches: DataFrame, heads: DataFrame, jobs: DataFrame, policy: Column) -> DataFrame:
    """(repo, ref, state, action): whether each ref's index is of its head, and what that means for a query under the policy."""
    busy = jobs.where(F.col("status").isin("queued", "running", "validating")).select("repo", "ref").distinct().withColumn("busy", F.lit(True))
    rows = heads.join(branches.select("repo", "ref", "last_indexed_commit"), ["repo", "ref"], "left").join(busy, ["repo", "ref"], "left")
    state = F.when(F.col("last_indexed_commit").eqNullSafe(F.col("head_commit")), "fresh").when(F.col("busy"), "syncing").otherwise("stale")
    return rows.withColumn("state", state).select("repo", "ref", "state", scoring.freshness_action(policy, F.col("state")).alias("action"))
