import pytest
from pyspark.sql import functions as F

from seamline.engine import AmbiguousSymbol, Engine, SymbolNotFound
from seamline.operators.policy import Policy
from seamline.plans import indexing
from seamline.sources import tables
from tests.test_sources import PYTHON, RUST

FILES = [("src/store.rs", "rust", RUST), ("app/web/auth.py", "python", PYTHON), ("app/core.py", "python", "from .web.auth import validate\n\ndef base(t):\n    return validate(t)\n"), ("app/tests/test_auth.py", "python", "def test_validate():\n    assert validate(1)\n")]


def stored(spark, index, folder):
    def one(name):
        getattr(index, name).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return indexing.Index(*(one(n) for n in ("files", "symbols", "snippets", "edges")))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    index = indexing.build(spark.createDataFrame(FILES, "path string, language string, content string"), "demo")
    return Engine(stored(spark, index, tmp_path_factory.mktemp("index")))


def asked(spark, *queries):
    return spark.createDataFrame([(str(i), q) for i, q in enumerate(queries)], "query_id string, query string")


def test_search_ranks_the_named_symbol_first(spark, engine):
    rows = engine.search_code(asked(spark, "validate", "where is the token checked", "src/store.rs")).collect()
    best = {r["query_id"]: r for r in rows if r["rank"] == 1}
    assert (best["0"]["name"], best["0"]["path"]) == ("validate", "app/web/auth.py")
    assert best["2"]["path"] == "src/store.rs"
    assert all(r["rank"] <= 10 for r in rows)
    reasons = engine.explain_ranking(asked(spark, "validate"), "app/web/auth.py", 10).collect()
    assert max(r["effective_value"] for r in reasons if r["signal"] == "exact_match") == 5.0
    governed = Engine(engine.index, Policy(deny_paths=("app/**",)))
    assert not [r for r in governed.search_code(asked(spark, "validate")).collect() if r["path"].startswith("app/")]


def test_navigation(spark, engine):
    assert [r["qualified_name"] for r in engine.locate_symbol("open").collect()] == ["Store::open"]
    assert {r["source_file"] for r in engine.find_references("validate").collect()} == {"app/web/auth.py", "app/core.py", "app/tests/test_auth.py"}
    assert {r["name"] for r in engine.get_call_graph("validate", direction="callers").collect()} == {"check", "base", "test_validate"}
    assert {(r["name"], r["depth"]) for r in engine.get_call_graph("base", direction="callees", depth=2).collect()} == {("validate", 1)}
    assert [r["name"] for r in engine.get_symbol_hierarchy("check").collect()] == ["Auth"]
    assert [r["name"] for r in engine.get_symbol_hierarchy("Auth", direction="descendants").collect()] == ["check"]
    assert engine.find_related_symbols("check").where("priority = 0").count() == 3
    assert [r["name"] for r in engine.get_file_outline("app/web/auth.py", top_only=True).collect()] == ["LIMIT", "Auth", "validate"]
    with pytest.raises(SymbolNotFound):
        engine.find_references("nothing")
    central = {r["path"]: r["file_centrality"] for r in engine.index.symbols.select("path", "file_centrality").distinct().collect()}
    assert central["app/web/auth.py"] == 1.0 and central["src/store.rs"] == 0.0
    assert engine.index_status().where(F.col("table") == "files").first()["n"] == 4 and engine.list_refs().count() == 1


def test_overlay_shows_the_ref(spark, engine, tmp_path):
    base = spark.createDataFrame(FILES, "path string, language string, content string")
    changed = [FILES[0], ("app/web/auth.py", "python", PYTHON.replace("def validate(t)", "def validate(t, strict)")), ("app/core.py", "python", "def validate():\n    pass\n")]
    head = spark.createDataFrame(changed, "path string, language string, content string")
    top, dead, actions = indexing.overlay(base, head, "demo", "feature")
    assert {tuple(r) for r in actions.collect()} == {("app/web/auth.py", "modified"), ("app/core.py", "modified"), ("app/tests/test_auth.py", "deleted")}
    ref = engine.with_overlay(stored(spark, top, tmp_path), dead)
    assert {r["path"] for r in ref.index.files.collect()} == {f[0] for f in changed}
    with pytest.raises(AmbiguousSymbol):
        ref.find_references("validate")
    changes = {(r["name"], r["change"]) for r in engine.diff_context(ref).collect()}
    assert ("base", "deleted") in changes and ("validate", "added") in changes and ("test_validate", "deleted") in changes
    assert engine.compare_symbol_between_commits(ref, "base").first()["status"] == "deleted"


def test_context_packs_and_publishing(spark, engine, tmp_path):
    pack = engine.build_context_pack(asked(spark, "validate"), 60).collect()
    assert pack and sum(r["tokens"] for r in pack) <= 60 and {r["query_id"] for r in pack} == {"0"}
    assert engine.get_code_context(asked(spark, "validate"), 50).agg(F.max("used")).first()[0] <= 50
    indexing.publish(engine.index, str(tmp_path))
    assert tables.read(spark, str(tmp_path), "symbols", "demo", "live").count() == engine.index.symbols.count()
    assert indexing.embed(engine.index).where(F.size("vector") == 64).count() == engine.index.snippets.count()


def test_commits(spark):
    commits = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "b"), ("y", "x"), ("a", None)], "commit string, parent string")
    assert indexing.merge_base(commits, "c", "y") == "b" and indexing.is_ancestor(commits, "a", "y") and not indexing.is_ancestor(commits, "c", "y")
    assert indexing.effective_ref(None, "main") == "main" and indexing.effective_ref(None, None) == "live"


def test_the_semantic_branch_finds_what_words_miss(spark, engine):
    from seamline.operators import vectors

    table = indexing.embed(engine.index)
    with_vectors = Engine(engine.index, vectors=table)
    body = engine.index.snippets.where("symbol_id is not null").orderBy("symbol_id").first()
    queries = spark.createDataFrame([("0", "what is it that nobody names here")], "query_id string, query string")
    queries = queries.withColumn("embedding", vectors.hashed_embedding(F.lit(body["content"])))
    assert engine.search_code(queries).count() == 0
    rows = with_vectors.search_code(queries).collect()
    assert rows and {r["provenance"] for r in rows} == {"semantic"}
    assert body["symbol_id"] in {r["symbol_id"] for r in rows}


def test_call_sites_come_back_with_recursion_and_limits(spark):
    from seamline.operators import graph

    edges = [("a", "b", 1), ("b", "a", 2), ("b", "c", 3), ("a", "b", 4), ("c", "c", 5)]
    edges = spark.createDataFrame([("r", "x", u, v, "f", n, "high") for u, v, n in edges] + [("r", "y", "a", "z", "f", 9, "low")], "repo string, ref string, from_symbol_id string, to_symbol_id string, source_file string, source_line int, confidence string")
    roots = spark.createDataFrame([("r", "x", "a")], "repo string, ref string, root string")
    rows = [(r["symbol"], r["source_line"], r["depth"]) for r in graph.call_graph(edges, roots, 3).orderBy("place").collect()]
    assert rows == [("b", 1, 1), ("b", 4, 1), ("a", 2, 2), ("c", 3, 2), ("c", 5, 3)]
    few = graph.call_graph(edges, roots, 3, limit=3).orderBy("place").collect()
    assert [(r["symbol"], r["source_line"]) for r in few] == [("b", 1), ("b", 4), ("a", 2)] and all(r["truncated"] for r in few)
    both = graph.call_graph(edges, roots, 1, "both").collect()
    assert {(r["direction"], r["symbol"], r["source_line"]) for r in both} == {("callees", "b", 1), ("callees", "b", 4), ("callers", "b", 2)}


def test_jobs_leases_and_paths(spark, tmp_path):
    from seamline.operators import control

    inside = tmp_path / "data" / "overlays" / "feature"
    inside.mkdir(parents=True)
    assert control.overlay_allowed(str(tmp_path / "data"), str(inside)) and not control.overlay_allowed(str(tmp_path / "data"), str(tmp_path / "data" / "overlays" / ".." / "base"))
    (tmp_path / "data" / "overlays" / "link").symlink_to(tmp_path)
    assert not control.overlay_allowed(str(tmp_path / "data"), str(tmp_path / "data" / "overlays" / "link"))
    assert set(control.KEYS) == set(control.SCHEMAS)
    old = spark.createDataFrame([("r", "a", 1)], "repo string, ref string, created_at int")
    new = spark.createDataFrame([("r", "a", 5), ("r", "b", 6)], "repo string, ref string, created_at int")
    assert {tuple(r) for r in control.put("branch_state", old, new).collect()} == {("r", "a", 1), ("r", "b", 6)}
