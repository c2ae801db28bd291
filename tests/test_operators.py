import random
import re

import pytest

from seamline.operators import context, evaluation, policy, ranking, retrieval, vectors, versions


def test_globs():
    cases = {"src/**/a.rs": ["src/a.rs", "src/x/y/a.rs"], "*.md": ["a.md"], "src/{a,b}/?.py": ["src/a/x.py", "src/b/y.py"], "**": ["x/y"], "[!a]x": ["bx"]}
    misses = {"src/**/a.rs": "src/xa.rs", "*.md": "d/a.md", "src/{a,b}/?.py": "src/c/x.py", "[!a]x": "ax"}
    for g, hits in cases.items():
        assert all(re.match(policy.glob_regex(g), h) for h in hits), g
        assert g not in misses or not re.match(policy.glob_regex(g), misses[g])
    with pytest.raises(ValueError):
        policy.compile_globs(("[a",), True)
    assert policy.compile_globs(("[a", "b"), False)[0] == ["^b$"]


def test_policy_modes(spark):
    rows = spark.createDataFrame([("a/x.rs", "symbol", "function", "mail a@b.org"), ("secret/y.rs", "symbol", "function", "z"), ("a/z.rs", "symbol", None, "q")], "path string, result_type string, kind string, snippet string")
    p = policy.Policy(deny_paths=("secret/**",), deny_kinds=("variable",))
    assert [(r["path"], r["snippet"]) for r in policy.apply(rows, p).collect()] == [("a/x.rs", "mail [REDACTED:email]")]
    audit = policy.apply(rows, policy.Policy(mode="audit_only", deny_paths=("secret/**",), deny_kinds=("variable",))).collect()
    assert [r["block_reason"] for r in audit] == [None, "path_denied", "kind_missing"] and audit[0]["snippet"] == "mail a@b.org"
    assert policy.apply(rows, policy.Policy(mode="off")).count() == 3
    assert p.resolved("off") == ("off", []) and p.resolved("strict")[0] == "balanced"
    with pytest.raises(ValueError):
        policy.Policy(mode="strict").resolved("off" * 2)


def test_file_diversity(spark):
    rows = [("q", i + 1, p, 1.0 - i * 0.01, str(i)) for i, p in enumerate("aaaabbc")]
    df = spark.createDataFrame(rows, "query_id string, rank int, path string, score double, result_id string")
    got = [r["path"] for r in ranking.file_diversity(df).orderBy("rank").collect()]
    assert got == ["a", "a", "b", "b", "c", "a", "a"]


def test_budgets(spark):
    df = spark.createDataFrame([("q", i + 1, c) for i, c in enumerate([50, 40, 30, 10])], "query_id string, place int, tokens long")
    assert sorted(r["place"] for r in context.fit_skipping(df, 100).collect()) == [1, 2, 4]
    assert sorted(r["place"] for r in context.fit_prefix(df, 100).collect()) == [1, 2]


def test_rename_detection_and_upsert(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "1")], "path string, content_hash string")
    head = spark.createDataFrame([("a2", "1"), ("b", "9"), ("e", "5"), ("d", "1")], "path string, content_hash string")
    diff = versions.snapshot_diff(base, head, rename=True)
    assert {tuple(r) for r in diff.collect()} == {("renamed", "a2", "a"), ("modified", "b", None), ("added", "e", None), ("deleted", "c", None)}
    assert {tuple(r) for r in versions.tombstones(versions.sync_actions(diff)).collect()} == {("a", "deleted"), ("b", "replaced"), ("c", "deleted")}
    assert versions.is_stale(head, base) and not versions.is_stale(base, base)
    old = spark.createDataFrame([(1, None, "x"), (2, "k", "y")], "a int, b string, v string")
    new = spark.createDataFrame([(1, None, "z"), (3, "k", "w")], "a int, b string, v string")
    assert {tuple(r) for r in versions.upsert(old, new, ["a", "b"]).collect()} == {(1, None, "z"), (2, "k", "y"), (3, "k", "w")}


def test_metrics_credit_each_target_once(spark):
    run = spark.createDataFrame([("q", 1, "x", "p"), ("q", 2, "y", "p"), ("q", 3, "z", "r")], "query_id string, rank int, doc_id string, path string")
    targets = spark.createDataFrame([("q", "y"), ("q", "w"), ("none", "v")], "query_id string, doc_id string")
    rows = {r["query_id"]: r for r in evaluation.metrics(run, targets).collect()}
    assert rows["q"]["reciprocal_rank"] == 0.5 and rows["q"]["recall"] == 0.5 and rows["none"]["recall"] == 0
    assert abs(rows["q"]["ndcg"] - (1 / 1.584962500721156) / (1 + 1 / 1.584962500721156)) < 1e-9 and abs(rows["q"]["clustering"] - 2 / 3) < 1e-9


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(100, [0.0] * 4), (101, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    found = lambda: sorted((r["query_id"], r["vec_id"], r["rank"]) for r in vectors.nearest(v, q, 5).collect())
    whole = found()
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 100)
    assert found() == whole and len(whole) == 35


def test_roles(spark):
    rows = spark.createDataFrame([("symbol", "struct"), ("symbol", "fn"), ("file", "struct")], "result_type string, kind string")
    assert retrieval.retain_role(rows, "type").count() == 1 and retrieval.retain_role(rows, "odd").count() == 0


def test_suggestions_need_low_confidence(spark):
    rows = spark.createDataFrame([("1", "search_code", "where is RateLimit", "natural_language", 0.1, 0.5, 3, 0), ("2", "search_code", "x", "symbol", 0.9, 0.5, 3, 0)], "query_id string, tool string, query string, intent string, top_score double, threshold double, total_candidates int, total_edges int")
    assert [(r["next_tool"], r["argument"]) for r in ranking.followups(rows).collect()] == [("locate_symbol", "RateLimit"), ("get_call_graph", "RateLimit"), ("search_code", "RateLimit")]
    assert retrieval.with_path_prefix(spark.createDataFrame([("Src/a",)], "path string"), "src/").count() == 1
