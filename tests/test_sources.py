import pytest

from seamline.operators import extraction
from seamline.sources import evalsets, files, tables
from seamline.streaming import queue

RUST = """use std::{fmt, io::{self, Read}};

pub struct Store { n: u32 }

impl Store {
    pub fn open(path: &str) -> Store {
        helper(path);
        self.inner.load(path)
    }
}

fn helper(p: &str) {}
"""
PYTHON = '''import os
from ..core import base

LIMIT = 3

class Auth:
    def check(self, t):
        return validate(t) or self.store.get(t)

def validate(t):
    return os.path.exists(t)
'''


def test_scan_extract_and_index(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in {"src/store.rs": RUST, "app/web/auth.py": PYTHON, "app/bad.py": "def (", "node_modules/x.js": "x()", "big.go": "a" * 2000, "readme.md": "# x", "skip/me.py": "x = 1"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    found = files.scan(spark, str(root), max_bytes=1000, gitignore=["skip/", "# c", "*.tmp"])
    assert {r["path"] for r in found.collect()} == {"src/store.rs", "app/web/auth.py", "app/bad.py"}
    items = extraction.extract(found).cache()
    symbols = {(r["qualified_name"], r["kind"], r["line_start"], r["line_end"]) for r in items.where("item = 'symbol'").collect()}
    assert symbols >= {("Store", "struct", 3, 3), ("Store::open", "method", 6, 9), ("helper", "function", 12, 12), ("Auth", "class", 6, 8), ("Auth.check", "method", 7, 8), ("validate", "function", 10, 11), ("LIMIT", "constant", 4, 4)}
    imports = {r["target"] for r in items.where("item = 'import'").collect()}
    assert imports >= {"std::fmt", "std::io", "std::io::Read", "os", "..core.base"}
    calls = {(r["target"], r["label"]) for r in items.where("item = 'call'").collect()}
    assert calls >= {("helper", "static"), ("self.inner.load", "heuristic"), ("validate", "static"), ("os.path.exists", "heuristic")}
    assert [r["path"] for r in items.where("item = 'error'").collect()] == ["app/bad.py"]
    rows = extraction.symbol_rows(items, "demo")
    by_name = {r["qualified_name"]: r for r in rows.collect()}
    assert by_name["Auth.check"]["parent_symbol_id"] == by_name["Auth"]["symbol_id"]
    snippets = extraction.snippet_rows(rows, found).collect()
    assert {s["origin"] for s in snippets if s["path"] == "app/bad.py"} == {"file_fallback"} and any(s["chunk_type"] == "method_body" and "self.inner.load" in s["content"] for s in snippets)
    records = files.records(found, "demo")
    assert records.where("filename = 'auth.py'").first()["size_bytes"] == len(PYTHON)
    path = str(tmp_path / "index" / "files")
    tables.publish(tables.checked(records, "files"), path)
    tables.publish(tables.checked(records, "files"), path)
    assert tables.read(spark, str(tmp_path / "index"), "files", "demo", "live").count() == 3
    merged = tables.merge(spark, path, "files", records.where("path = 'src/store.rs'"))
    assert merged.count() == 3 and tables.without_ref(merged, "demo", "live").count() == 0
    with pytest.raises(tables.SchemaMismatch):
        tables.checked(records.drop("path"), "files")
    tables.export_bundle({"files": records}, str(tmp_path / "bundle"), {"v": 1})
    loaded, metadata = tables.import_bundle(spark, str(tmp_path / "bundle"), ["files"], "other")
    assert metadata == {"v": 1} and {r["repo"] for r in loaded["files"].collect()} == {"other"}


def test_gitignore_rules(spark):
    rows = spark.createDataFrame([("a/b.log",), ("keep.log",), ("out/x",), ("src/out.py",)], "path string")
    rules = files.ignore_rules(["*.log", "!keep.log", "out/"])
    assert [r["path"] for r in rows.where(~files.ignored_by(rows["path"], rules)).collect()] == ["keep.log", "src/out.py"]


def test_evaluation_sets(spark, tmp_path):
    suite = tmp_path / "suite.json"
    suite.write_text('{"version": "1", "queries": [{"id": "a", "query": "x", "intent": "symbol", "expected_targets": [{"hint": "T"}], "negative_targets": [{"hint": "N"}]}]}')
    queries, targets, negatives = evalsets.suite(spark, str(suite))
    assert (queries.count(), targets.first()["target"], negatives.first()["target"]) == (1, "T", "N")
    suite.write_text('{"version": "1", "queries": [{"id": "a", "query": "", "intent": "symbol", "expected_targets": []}]}')
    with pytest.raises(evalsets.SuiteError):
        evalsets.suite(spark, str(suite))
    (tmp_path / "corpus").write_text('{"_id": "d1", "text": "t"}\n{"_id": "d2", "title": "x"}\n')
    (tmp_path / "queries").write_text('{"_id": "q1", "text": "t"}\n{"_id": "q2", "text": "u"}\n')
    (tmp_path / "qrels").write_text("query-id\tcorpus-id\tscore\n# c\nq1\td1\t1\nq2\td1\t0\nq2\tdx\t1\n")
    docs, asked, judged = evalsets.beir(spark, *(str(tmp_path / n) for n in ("corpus", "queries", "qrels")))
    assert (docs.count(), [r["query_id"] for r in asked.collect()], judged.count()) == (2, ["q1"], 1)
    (tmp_path / "trec").write_text("q1 0 d1 2\nq2 0 d2 1\n")
    assert evalsets.judgements(spark, str(tmp_path / "trec")).count() == 2


def test_generations_across_batches(spark, tmp_path):
    source, out = tmp_path / "in", []
    for i, rows in enumerate([[("a", 1), ("b", 2), ("a", 3)], [("a", 4)]]):
        spark.createDataFrame(rows, "path string, id long").coalesce(1).write.mode("append").parquet(str(source))
        stream = queue.generations(spark.readStream.schema("path string, id long").parquet(str(source)), "path", "id")
        run = queue.sync(stream, lambda df, n: out.extend(map(tuple, df.collect())), str(tmp_path / "checkpoint"))
        run.awaitTermination()
    assert sorted(out) == [("a", 1, 1, 2), ("a", 3, 2, 2), ("a", 4, 3, 3), ("b", 2, 1, 1)]
