"""Symbols by spans against brute force, on odd spans too."""

import random

import pytest

from seamline.operators import graph, spans

SYMBOLS = "symbol_id string, path string, kind string, line_start int, line_end int"


def tables(spark, n, seed):
    rnd = random.Random(seed)
    line = lambda most: None if rnd.random() < 0.03 else rnd.randrange(most)
    syms, asked = [], []
    for i in range(n):
        a = line(60)
        b = line(60) if a is None or rnd.random() < 0.1 else a + rnd.randrange(12)
        syms.append((f"s{rnd.randrange(10**6)}x{i}", rnd.choice(["p", "q", "r", None]), rnd.choice(["function", "struct"]), a, b))
        a = line(60)
        b = line(60) if a is None or rnd.random() < 0.1 else a + rnd.randrange(12)
        asked.append((i, rnd.choice(["p", "q", "z", None]), a, b))
    return spark.createDataFrame(syms, SYMBOLS), spark.createDataFrame(asked, "snippet_id long, path string, line_start int, line_end int"), syms, asked


@pytest.mark.parametrize("seed", range(3))
def test_spans_against_brute_force(spark, seed, monkeypatch):
    symbols, asked, syms, rows = tables(spark, 150, seed)
    over = {r["snippet_id"]: r["symbol_id"] for r in graph.overlapping_symbol(asked, symbols).collect()}
    around = {r["snippet_id"]: r["symbol_id"] for r in graph.containing_symbol(asked, symbols).collect()}
    calls = {r["call_id"]: r["caller"] for r in graph.enclosing_caller(asked.withColumnsRenamed({"snippet_id": "call_id", "line_start": "line"}), symbols).collect()}
    assert len(over) == len(around) == len(calls) == len(rows)
    for i, path, s, e in rows:
        mine = [(t, k, a, b) for t, p, k, a, b in syms if p == path and p is not None]
        known = [x for x in mine if None not in (x[2], x[3])] if None not in (s, e) else []
        off = lambda x: abs(x[2] - s) + abs(x[3] - e)
        met = [x for x in known if x[2] <= e and s <= x[3]]
        assert over[i] == (min(met, key=lambda x: (off(x), x[3] - x[2], x[0]))[0] if met else None)
        inside = [x for x in known if x[2] <= s and x[3] >= e]
        if inside:
            assert around[i] == min(inside, key=lambda x: (x[3] - x[2], x[0]))[0]
        elif known:
            assert around[i] == min(known, key=lambda x: (off(x), x[0]))[0]
        else:
            assert around[i] == (min(x[0] for x in mine) if mine else None)
        fun = [x for x in mine if x[1] == "function" and None not in (x[2], x[3], s) and x[2] <= s <= x[3]]
        want = min(fun, key=lambda x: (x[3] - x[2], -x[2], x[0]))[0] if fun else None if path is None else f"file::{path}"
        assert calls[i] == want


def test_spans_are_not_joined_pair_by_pair(spark):
    """A path of many symbols and snippets: a join on the path would have 10^10 rows."""
    symbols = spark.range(100_000).selectExpr("cast(id as string) as symbol_id", "'p' as path", "'function' as kind", "cast(id as int) as line_start", "cast(id + 100000 as int) as line_end")
    asked = spark.range(100_000).selectExpr("id as snippet_id", "'p' as path", "cast(id as int) as line_start", "cast(id + 1 as int) as line_end")
    found = graph.overlapping_symbol(asked, symbols)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("symbol_id is not null").count() == 100_000


def test_batches_end_at_paths(spark, monkeypatch):
    monkeypatch.setattr(spans, "BATCH_ROWS", 1)
    symbols = spark.range(300).selectExpr("cast(id as string) as symbol_id", "concat('p', id % 7) as path", "'function' as kind", "cast(id as int) as line_start", "cast(id as int) as line_end")
    asked = spark.range(300).selectExpr("id as snippet_id", "concat('p', id % 7) as path", "cast(id as int) as line_start", "cast(id as int) as line_end").coalesce(1)
    found = graph.overlapping_symbol(asked, symbols).collect()
    assert all(str(r["snippet_id"]) == r["symbol_id"] for r in found) and len(found) == 300
