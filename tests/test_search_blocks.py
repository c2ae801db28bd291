"""Ranked search against brute force: repeated ids, texts that are missing, several blocks of queries, sparse terms."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seamline.functions import text
from seamline.operators import retrieval, scores


def brute(docs, queries, k):
    tokens = {q: set((t or "").split()) for q, t in queries}
    rows = Counter()
    for d, t in docs:
        for w in (t or "").split():
            rows[w, d, len(t.split())] += 1
    df, n = Counter(w for w, _, _ in rows), len(docs)
    lens = [len(t.split()) for _, t in docs if t is not None]
    avg, found = sum(lens) / len(lens), []
    for q, asked in tokens.items():
        s = defaultdict(float)
        for (w, d, size), tf in rows.items():
            if w in asked:
                s[d] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg))
        found += [(q, d, i + 1) for i, (d, _) in enumerate(sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k])]
    return sorted(found)


@pytest.mark.parametrize("few", [True, False])
def test_search_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(scores, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(scores, "FEW_TERMS", 100_000 if few else 3)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rnd.choice(words[: rnd.randrange(1, 40)]) for _ in range(n))
    docs = [(i % 90, say(rnd.randrange(0, 30))) for i in range(120)] + [(200, None), (201, ""), (202, "same words"), (203, "same words")]
    queries = [(i, say(rnd.randrange(1, 12))) for i in range(20)] + [(3, "w1 w2"), (50, "same"), (51, "never"), (52, None)]
    q = [(i, " ".join(filter(None, (t for j, t in queries if j == i)))) for i in sorted({i for i, _ in queries})]
    corpus, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, query string")
    got = retrieval.search(corpus, "doc_id", text.default_tokens(F.col("text")), asked, "item_id", text.default_tokens(F.col("query")), 5)
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in got.collect()) == brute(docs, q, 5)


def test_rows_of_a_search_are_bounded_by_tasks(spark):
    """A word that all documents and queries have: pairs of them aren't rows of any stage."""
    corpus = spark.range(2000).selectExpr("id as doc_id", "concat('word x', id) as text").coalesce(2)
    asked = spark.range(300).selectExpr("id as item_id", "concat('word x', id) as query")
    got = retrieval.search(corpus, "doc_id", text.default_tokens(F.col("text")), asked, "item_id", text.default_tokens(F.col("query")), 3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["query_id"] for r in got.where("rank = 1 and doc_id = query_id").collect()} == set(range(300))


def test_terms_beyond_the_dense_ones(spark):
    rows = [scores_row(q, [(f"t{i}", 1.0 + i, 5) for i in range(q, q + 5)]) for q in range(8)]
    block = scores._Block(rows)
    import numpy as np

    want = np.zeros((len(block.words), 8))
    for q, r in enumerate(rows):
        for t, w, _ in r["terms"]:
            want[block.words.to_pylist().index(t), q] = w
    out = np.zeros((len(block.words), 8))
    n = np.arange(len(block.words))
    block.rare(out, n, n, np.ones(len(n)))
    assert np.allclose(out, want) and np.allclose(block.dense(), want)


def scores_row(query_id, terms):
    return {"query_id": query_id, "terms": terms}
