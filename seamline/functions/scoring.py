"""Scores, signals, intents and keys from Column to Column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion.
RRF = 60.0
# Kinds by their names, roles of kinds, weights of roles, and adjustments of kinds.
KIND_NAMES = {
    "function": "function", "fn": "function", "func": "function", "def": "function", "method": "method", "struct": "struct", "class": "class", "enum": "enum", "trait": "trait",
    "interface": "interface", "constant": "constant", "const": "constant", "variable": "variable", "var": "variable", "type_alias": "type_alias", "type": "type_alias",
    "module": "module", "mod": "module", "import": "module", "use": "module",
}
ROLES = {
    "struct": "type", "class": "type", "enum": "type", "trait": "type", "interface": "type", "type_alias": "alias", "function": "callable", "method": "callable",
    "constant": "value", "variable": "value", "module": "namespace",
}
ROLE_WEIGHTS = {"type": 2.0, "callable": 1.6, "namespace": 1.2, "value": 0.9, "alias": 0.8}
KIND_ADJUSTMENTS = {"class": 0.20, "interface": 0.20, "trait": 0.20, "struct": 0.15, "enum": 0.15, "function": 0.10, "method": 0.10, "module": 0.05, "type_alias": -0.05, "constant": 0.0, "variable": -0.10}
KIND_BOUND, PRIOR_BOUND, PRIOR_SAMPLE, SURFACE_BOUND = 0.2, 0.25, 12, 0.3
# Fixed values: (least, most, default) of each ranking signal.
BUDGETS = {
    "exact_match": (0.0, 8.0, 5.0), "qualified_name": (0.0, 4.0, 2.0), "path_affinity": (0.0, 2.0, 1.0), "definition_boost": (0.0, 2.0, 1.0), "kind_match": (0.0, 3.0, 2.0),
    "test_file_penalty": (-2.0, 0.0, -0.5), "file_centrality": (0.0, 0.5, 0.25), "secondary_cap": (0.5, 6.0, 2.0),
}
# Intent rules.
ERROR_PATTERNS = ("error:", "Error:", "panic:", "FATAL", "exception", "Exception", "traceback", "at line", "thread '")
PATH_EXTENSIONS = (".rs", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".java", ".c", ".h", ".cpp", ".rb", ".swift")
KIND_KEYWORDS = ("fn", "func", "function", "struct", "class", "enum", "trait", "interface", "type", "const", "method")
HINTS = {
    "natural_language": "Intent confidence is low; retry as symbol/path if you know exact identifiers.",
    "symbol": "Intent confidence is low; retry with natural-language wording or include file path.",
    "path": "Intent confidence is low; retry with exact path or broaden to filename-only search.",
    "error": "Intent confidence is low; include exact error text or stack-frame snippet.",
}
# Weights of the symbol, snippet and file channels by intent.
CHANNEL_WEIGHTS = {"symbol": (3.0, 1.0, 0.0), "path": (0.0, 0.0, 3.0), "error": (0.0, 3.0, 1.0), "natural_language": (2.0, 2.0, 1.0)}
# Plans (semantic limit, lexical and semantic fan-out multipliers, latency budget in ms).
PLANS = {"lexical_fast": (0, 2, 0, 120), "hybrid_standard": (2, 4, 3, 300), "semantic_deep": (4, 6, 5, 700)}
TEST_PATHS = r"_test\.|\.test\.|\.spec\.|/test/|/tests/|test_"


@dataclass(frozen=True)
class Confidence:
    """Weights of the parts of a result's confidence, and the threshold."""

    top: float = 0.55
    margin: float = 0.30
    agreement: float = 0.15
    threshold: float = 0.5


@dataclass(frozen=True)
class Search:
    """Parameters of a search."""

    limit: int = 10
    semantic_ratio: float = 0.3
    short_circuit: float = 0.85
    high_confidence: float = 0.75
    low_confidence: float = 0.55
    phrase_boost: float = 0.75
    overlap_weight: float = 2.5
    rerank_cap: int = 50
    confidence: Confidence = field(default_factory=Confidence)


def _map(table: dict, key: Column, default=None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def finite(x: Column, default: float = 0.0) -> Column:
    """x, or the default where x is null, NaN or infinite (Spark orders NaN above all numbers)."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), default).otherwise(F.coalesce(x, F.lit(default)))


def normalised(score: Column) -> Column:
    """s / (s + 1) of a positive finite score, else 0."""
    return F.when((score > 0) & ~F.isnan(score) & (score != F.lit(float("inf"))), score / (score + 1.0)).otherwise(0.0)


def rrf(rank: Column, weight=1.0) -> Column:
    return F.lit(weight) / (F.lit(RRF) + rank) if not isinstance(weight, Column) else weight / (F.lit(RRF) + rank)


def parse_kind(name: Column) -> Column:
    return _map(KIND_NAMES, name)


def role(kind: Column) -> Column:
    return _map(ROLES, kind)


def role_weight(kind: Column) -> Column:
    return _map(ROLE_WEIGHTS, role(parse_kind(kind)), 0.0)


def kind_adjustment(kind: Column) -> Column:
    return clamp(_map(KIND_ADJUSTMENTS, F.lower(F.trim(kind)), 0.0), -KIND_BOUND, KIND_BOUND)


def kind_weight(kind: Column) -> Column:
    return role_weight(kind) + kind_adjustment(kind)


def query_kind_boost(query: Column, kind: Column) -> Column:
    """A query that looks like a type favours types, one that looks like a function favours callables."""
    query, kind = F.trim(query), F.lower(F.trim(kind))
    upper, lower, underscore = query.rlike(r"^\p{Lu}"), query.rlike(r"^\p{Ll}"), query.contains("_")
    types = kind.isin("class", "struct", "enum", "trait", "interface", "type_alias")
    return F.when(upper & ~underscore & types, 1.0).when((lower | underscore) & kind.isin("function", "method"), 0.5).otherwise(0.0)


def test_file_penalty(path: Column) -> Column:
    return F.when(F.lower(path).rlike(TEST_PATHS), -0.5).otherwise(0.0)


def is_top_level(name: Column) -> Column:
    name = F.trim(F.coalesce(name, F.lit("")))
    return (name != "") & ~name.contains("::") & ~name.contains(".")


def public_surface(path: Column, qualified_name: Column, visibility: Column, centrality: Column) -> Column:
    """How much a symbol is part of what a code base offers to others."""
    path = F.lower(path)
    hidden = path.rlike(r"/test/|/tests/|\.test\.|\.spec\.|/internal/")
    boost = (
        F.when(is_top_level(qualified_name), 0.10).otherwise(0.0)
        + F.when(F.lower(F.trim(visibility)).isin("pub", "public", "export"), 0.05).otherwise(0.0)
        + clamp(F.coalesce(centrality, F.lit(0.0)), 0.0, 1.0) * 0.15
        + F.when(path.contains("/api/") | path.contains("/public/"), 0.05).otherwise(0.0)
    )
    return F.when(hidden, 0.0).otherwise(clamp(boost, 0.0, SURFACE_BOUND))


def within_budget(raw: Column, signal: str, budgets: dict = BUDGETS) -> Column:
    low, high, _ = budgets[signal]
    return clamp(finite(raw), low, high) if low <= high else F.lit(0.0)


def rule_signals(query: Column, budgets: dict = BUDGETS, prior: Column | None = None) -> dict[str, Column]:
    """Raw values of the signals of a candidate row (name, qualified_name, kind, path, result_type, visibility, file_centrality)."""
    lowered = F.lower(query)
    adjustment = clamp(kind_adjustment(F.col("kind")) + query_kind_boost(query, F.col("kind")), -KIND_BOUND, KIND_BOUND)
    kind = F.when(F.col("kind").isNotNull(), role_weight(F.col("kind")) + adjustment).otherwise(0.0)
    surface = public_surface(F.col("path"), F.col("qualified_name"), F.col("visibility"), F.col("file_centrality"))
    return {
        "exact_match": F.when(F.lower("name") == lowered, budgets["exact_match"][2]).otherwise(0.0),
        "qualified_name": F.when(F.lower("qualified_name").contains(lowered), budgets["qualified_name"][2]).otherwise(0.0),
        "path_affinity": F.when(F.lower("path").contains(lowered), budgets["path_affinity"][2]).otherwise(0.0),
        "definition_boost": F.when(F.col("result_type") == "symbol", budgets["definition_boost"][2]).otherwise(0.0),
        "kind_match": kind + (F.lit(0.0) if prior is None else prior) + surface,
        "test_file_penalty": test_file_penalty(F.col("path")),
    }


SECONDARY = ("qualified_name", "path_affinity", "definition_boost", "kind_match")


def effective_signals(raw: dict[str, Column], budgets: dict = BUDGETS) -> dict[str, Column]:
    """Signals within their budgets; beside an exact match the positive secondary ones are scaled down to a common cap."""
    clamped = {s: within_budget(c, s, budgets) for s, c in raw.items()}
    total = sum((F.greatest(clamped[s], F.lit(0.0)) for s in SECONDARY[1:]), F.greatest(clamped[SECONDARY[0]], F.lit(0.0)))
    low, high, default = budgets["secondary_cap"]
    cap = max(0.0, min(max(default, low), high))
    scale = F.when((clamped["exact_match"] > 1e-9) & (total > cap), F.lit(cap) / total).otherwise(1.0)
    return {s: F.when(c > 0, c * scale).otherwise(c) if s in SECONDARY else c for s, c in clamped.items()}


def lexical_tier(exact: Column, qualified: Column) -> Column:
    return F.when(exact > 0, 2).when(qualified > 0, 1).otherwise(0)


def token_overlap(query_tokens: Column, tokens: Column) -> Column:
    """Share of the query's tokens that a document has."""
    return F.when(F.size(query_tokens) > 0, F.size(F.array_intersect(query_tokens, tokens)) / F.size(query_tokens)).otherwise(0.0)


def local_rerank(base: Column, overlap: Column, has_phrase: Column, search: Search = Search()) -> Column:  # noqa: B008
    return base + F.lit(search.overlap_weight) * overlap + F.when(has_phrase, search.phrase_boost).otherwise(0.0)


def intent(query: Column) -> Column:
    """struct(intent, confidence, hint) by the first rule that fits: error text, path, quoted literal, symbol, natural language."""
    q = F.trim(query)
    words = F.filter(F.split(q, r"\s+"), lambda x: x != "")
    n, one = F.size(words), F.try_element_at(words, F.lit(1))
    error = F.lit(False)
    for pattern in ERROR_PATTERNS:
        error = error | q.contains(pattern)
    slashed = q.contains("/") | q.contains("\\")
    extension = F.lower(q).rlike("(" + "|".join(e.replace(".", r"\.") for e in PATH_EXTENSIONS) + ")$")
    quoted = (F.octet_length(q) > 1) & (q.rlike('(?s)^".*"$') | q.rlike("(?s)^`.*`$"))
    single = n == 1
    symbol = (
        F.when(single & one.rlike(r"^.+\p{Lu}"), 0.88)
        .when(single & one.contains("_"), 0.85)
        .when(single & (one.contains("::") | one.contains(".")), 0.9)
        .when(single & one.rlike(r"^[\p{L}\p{N}_]+$") & (F.octet_length(one) > 2), 0.6)
        .when((n == 2) & F.lower(one).isin(*KIND_KEYWORDS), 0.76)
    )
    found = (
        F.when(error, F.struct(F.lit("error").alias("intent"), F.lit(0.9).alias("confidence")))
        .when(slashed, F.struct(F.lit("path").alias("intent"), F.lit(0.95).alias("confidence")))
        .when(extension, F.struct(F.lit("path").alias("intent"), F.lit(0.85).alias("confidence")))
        .when(quoted, F.struct(F.lit("error").alias("intent"), F.lit(0.9).alias("confidence")))
        .when(symbol.isNotNull(), F.struct(F.lit("symbol").alias("intent"), symbol.alias("confidence")))
        .otherwise(F.struct(F.lit("natural_language").alias("intent"), F.when(n <= 1, 0.55).otherwise(0.72).alias("confidence")))
    )
    return F.struct(found["intent"].alias("intent"), found["confidence"].alias("confidence"), F.when(found["confidence"] < 0.65, _map(HINTS, found["intent"])).alias("hint"))


def channel_weight(intent_name: Column, channel: int) -> Column:
    return _map({k: v[channel] for k, v in CHANNEL_WEIGHTS.items()}, intent_name, 0.0)


def adaptive_plan(intent_name: Column, confidence: Column, semantic_available: Column, override: Column, search: Search = Search()) -> Column:  # noqa: B008
    """struct(selected, reason, executed, downgraded, downgrade_reason)."""
    code = intent_name.isin("symbol", "path", "error")
    chosen = override.isin(*PLANS)
    chosen = F.coalesce(chosen, F.lit(False))
    fast = ~semantic_available | (code & (confidence >= search.high_confidence))
    deep = (intent_name == "natural_language") & (confidence < search.low_confidence)
    selected = F.when(chosen, override).when(fast, "lexical_fast").when(deep, "semantic_deep").otherwise("hybrid_standard")
    reason = (
        F.when(chosen, "override")
        .when(~semantic_available, "semantic_unavailable")
        .when(fast, "high_lexical_confidence")
        .when(deep, "low_lexical_confidence_exploratory")
        .otherwise("default_hybrid")
    )
    down = chosen & ~semantic_available & (selected != "lexical_fast")
    return F.struct(
        selected.alias("selected"),
        reason.alias("reason"),
        F.when(down, "lexical_fast").otherwise(selected).alias("executed"),
        down.alias("downgraded"),
        F.when(down, "semantic_unavailable").alias("downgrade_reason"),
    )


def plan_budget(plan: Column, limit: Column) -> dict[str, Column]:
    """Semantic limit, lexical and semantic fan-out and latency of a plan, for a result limit."""
    part = lambda i: _map({k: v[i] for k, v in PLANS.items()}, plan, 0)
    fast = plan == "lexical_fast"
    return {
        "semantic_limit": F.when(fast, 0).otherwise(clamp(limit * part(0), 20, 1000)),
        "lexical_fanout": clamp(limit * part(1), 40, 2000),
        "semantic_fanout": F.when(fast, 0).otherwise(clamp(limit * part(2), 30, 1000)),
        "latency_ms": part(3),
    }


def downgrade(plan: Column) -> Column:
    """One step down; the fastest plan stays."""
    return _map({"semantic_deep": "hybrid_standard", "hybrid_standard": "lexical_fast", "lexical_fast": "lexical_fast"}, plan)


def semantic_gate(mode: Column, intent_name: Column, ratio: Column, top_lexical: Column, search: Search = Search()) -> Column:  # noqa: B008
    """Why the semantic branch runs or doesn't."""
    return (
        F.when(mode == "off", "disabled")
        .when(intent_name != "natural_language", "intent_not_nl")
        .when(mode == "rerank_only", "rerank_only")
        .when(ratio <= 0, "ratio_zero")
        .when(top_lexical >= search.short_circuit, "lexical_short_circuit")
        .otherwise("run")
    )


def edge_confidence(provider: Column, edge_type: Column, outcome: Column, to_id: Column, to_name: Column, bucket: Column) -> Column:
    """struct(provider, outcome, bucket, weight) of a graph edge."""
    tidy = lambda c: F.lower(F.trim(c))
    p = (
        F.when(tidy(provider).isin("import_resolver", "call_resolver", "legacy"), tidy(provider))
        .when(tidy(edge_type) == "imports", "import_resolver")
        .when(tidy(edge_type) == "calls", "call_resolver")
        .otherwise("legacy")
    )
    name = F.trim(to_name)
    external = (name != "") & (name.startswith("external::") | name.contains("/") | name.contains(".") | name.rlike(r"^(std|core|alloc|proc_macro|test)\s*::"))
    o = (
        F.when(tidy(outcome).isin("resolved_internal", "external_reference", "unresolved"), tidy(outcome))
        .when(F.trim(to_id) != "", "resolved_internal")
        .when(external, "external_reference")
        .otherwise("unresolved")
    )
    b = (
        F.when(tidy(bucket).isin("high", "static"), "high")
        .when(tidy(bucket) == "medium", "medium")
        .when(tidy(bucket).isin("low", "heuristic"), "low")
        .when(o == "resolved_internal", "high")
        .when(o == "external_reference", "medium")
        .otherwise("low")
    )
    return F.struct(p.alias("provider"), o.alias("outcome"), b.alias("bucket"), F.when(b == "high", 1.0).when(b == "medium", 0.6).otherwise(0.2).alias("weight"))


def _id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def stable_id(language: Column, kind: Column, qualified_name: Column, signature: Column) -> Column:
    """Id of a symbol wherever it stands."""
    return _id(language, kind, qualified_name, signature)


def symbol_id(repo: Column, ref: Column, path: Column, kind: Column, line_start: Column, name: Column) -> Column:
    """Id of a symbol at its place."""
    return _id(repo, ref, path, kind, line_start, name)


def project_id(root: Column) -> Column:
    return F.substring(F.sha2(root, 256), 1, 16)


def file_key(repo: Column, ref: Column, path: Column) -> Column:
    return F.concat_ws("|", repo, ref, path)


def merge_key(result_type: Column) -> Column:
    """What makes a row of one layer the same as one of another (repo, symbol_stable_id, kind, path, chunk_type, line_start, line_end)."""
    span = F.concat_ws(":", "path", "line_start", "line_end")
    symbol = (result_type == "symbol") & (F.coalesce("symbol_stable_id", F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != "")
    return (
        F.when(symbol, F.concat_ws("|", "repo", F.lit("symbol"), F.concat_ws(":", "symbol_stable_id", "kind")))
        .when(result_type == "snippet", F.concat_ws("|", "repo", F.lit("snippet"), F.concat_ws(":", "path", F.coalesce("chunk_type", F.lit("unknown")), "line_start", "line_end")))
        .when(result_type == "file", F.concat_ws("|", "repo", F.lit("file"), "path"))
        .otherwise(F.concat_ws("|", "repo", result_type, span))
    )


def backoff_seconds(retries: Column) -> Column:
    return F.least(F.lit(900), (F.lit(15) * F.pow(F.lit(2.0), clamp(retries, 0, 6))).cast("int"))


def worker_error(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(m.contains("timeout"), "semantic_worker_timeout")
        .when(m.contains("missing") & m.contains("embedding"), "semantic_embedding_provider_unavailable")
        .when(m.contains("tantivy"), "semantic_snippet_load_failed")
        .otherwise("semantic_embedding_write_failed")
    )


def freshness_action(policy: Column, state: Column) -> Column:
    return (
        F.when(state == "fresh", "proceed")
        .when(state == "syncing", "proceed_with_stale_indicator")
        .when(policy == "strict", "block")
        .when(policy == "balanced", "proceed_with_stale_indicator_and_sync")
        .otherwise("proceed_with_stale_indicator")
    )


def semantic_profile(file_count: Column, code_ratio: Column, target_ms: Column) -> Column:
    """struct(profile, reason, bucket): which embedding profile suits a code base."""
    bucket = F.when(file_count < 10_000, "<10k").when(file_count <= 50_000, "10k-50k").otherwise(">50k")
    low = (target_ms <= 180) | (file_count > 50_000)
    high = (file_count < 10_000) & (target_ms >= 650) & (code_ratio >= 0.6)
    balanced = (code_ratio >= 0.45) & (target_ms >= 260)
    profile = F.when(low, "fast_local").when(high, "high_quality").when(balanced, "code_quality").otherwise("fast_local")
    reason = F.when(low, "prefer_low_latency").when(high, "small_repo_high_budget").when(balanced, "balanced_quality_latency").when(code_ratio >= 0.3, "moderate_latency_code_mix").otherwise("fallback_fast_local")
    return F.struct(profile.alias("profile"), reason.alias("reason"), bucket.alias("bucket"))


def component_reason(value: Column, positive: str, none: str) -> Column:
    return F.when(value > 0, F.format_string(positive + " (+%.2f)", value)).otherwise(none)


def effective_ratio(request: Column, by_intent: Column, default: float) -> Column:
    return clamp(F.coalesce(request, by_intent, F.lit(default)), 0.0, 1.0)
