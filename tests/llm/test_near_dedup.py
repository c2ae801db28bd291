import random
import re

import numpy as np

from seamline.llm import near_dedup as nd
from seamline.llm.components import components
from tests.llm.helpers import documents, empty, read


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = {}
    for i, s in enumerate(sets):
        for g in s:
            inverted.setdefault(g, []).append(i)
    seen = set()
    for members in inverted.values():
        for x in members:
            for y in members:
                if x < y and (x, y) not in seen:
                    seen.add((x, y))
                    both = len(sets[x] & sets[y])
                    if 100 * both >= 75 * len(sets[x] | sets[y]):
                        parent[top(x)] = top(y)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[top(i)] if x is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def check(docs):
    got = sorted(map(tuple, nd.near_duplicates(docs).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    return got


def test_against_brute_force(spark):
    got = check(read(spark, "documents"))
    assert sum(not r[3] for r in got) > 5


def test_awkward_rows(spark):
    check(documents(spark))
    assert nd.near_duplicates(empty(spark)).count() == 0
    check(documents(spark, [(1, "same words here", "", "", 1), (1, "other words here now and then", "", "", 1), (2, "same words here", "", "", 1), (None, "lonely row of words", "", "", 1)]))
    long = " ".join(f"w{i}" for i in range(60))
    check(documents(spark, [(None, long, "", "", 1), (None, long + " more", "", "", 1), (None, "quite other words", "", "", 1), (5, long + " and", "", "", 1)]))


def test_borderline_pairs_chains_and_large_groups(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(15):
        base = [word() for _ in range(rng.choice([5, 8, 20, 60, 150]))]
        for _ in range(12):
            # a walk: each text is near the one before, not always near the first
            base = [word() if rng.random() < 0.02 else w for w in base]
            rows.append((rng.randrange(10**6), " ".join(base), "", "", 1))
    rng.shuffle(rows)
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "FAN", 3)
    check(documents(spark, rows))


def pair(rng, inter, a, b):
    x = rng.integers(0, 2**64, inter + a + b, dtype=np.uint64)
    return np.unique(x[: inter + a]), np.unique(np.concatenate([x[:inter], x[inter + a :]]))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for inter, a, b in [(3000, 1000, 500), (60, 20, 10), (90, 10, 20), (400, 1000, 900), (3, 1, 0)]:
        sets = pair(rng, inter, a, b)
        small, large = nd.sketches(list(sets))
        estimate, _ = nd.estimates((small[:1], large[:1]), (small[1:], large[1:]))
        assert abs(estimate[0] - inter / (inter + a + b)) < 0.17


def test_no_borderline_pair_is_missed():
    rng = np.random.default_rng(4)
    for inter, a, b in [(3, 1, 0), (6, 1, 1), (9, 1, 2), (30, 5, 5), (72, 12, 12), (97, 0, 32), (96, 32, 0), (150, 25, 25)]:
        sets = [s for _ in range(400) for s in pair(rng, inter, a, b)]
        small, large = nd.sketches(sets)
        bands = sum(((r[::2] == r[1::2]).reshape(-1, nd.BANDS, nd.BAND).all(2) & (r[::2, :1] != nd.EMPTY)).sum(1) for r in (small, large))
        _, fits = nd.estimates((small[::2], large[::2]), (small[1::2], large[1::2]))
        assert bands.min() >= 1 and fits.all()


def test_registers_hold_zeros_and_mantissa():
    x = np.array([1 << 63, (1 << 63) | (1 << 53), 1 << 62, 3 << 60], np.uint64)
    assert nd.compress(x).tolist() == [0, 1, 1 << 10, (2 << 10) | 512]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).distinct().collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_that_no_block_holds(spark, monkeypatch):
    from seamline.llm import components as c

    # the driver takes the rounds of stars
    monkeypatch.setattr(c, "EDGES", 4)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 120)]
    got = dict(c.components(spark.createDataFrame(edges, "u long, v long").repartition(6)).distinct().collect())
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 120), 100)}


def test_one_row_of_each_group_stays(spark):
    for docs in (documents(spark), read(spark, "documents")):
        out = nd.deduplicate(docs)
        assert out.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = sorted({(d, c) for d, n, c, kept in brute(rows) if kept and n} | set(), key=str)
        with_words = [(r["doc_id"], r["doc_id"]) for r in out.collect() if shingles(r["text"])]
        assert sorted(with_words, key=str) == want
        assert sum(not shingles(r["text"]) for r in out.collect()) == sum(not shingles(t) for _, t in rows)
    assert nd.deduplicate(empty(spark)).count() == 0
