import hashlib
import random

import numpy as np
import pytest

from seamline.llm import suffix_dedup as sd
from seamline.llm.induced_sort import DEPTH, sorted_suffixes
from tests.llm.helpers import documents, empty, read


@pytest.mark.parametrize("letters", [b"ab", b"ab\x00c", b"a", bytes(range(256))])
def test_suffixes_are_sorted_and_common_prefixes_carried(letters):
    rng = random.Random(len(letters))
    for _ in range(80):
        text = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 150)))
        pieces = list(sorted_suffixes(np.frombuffer(text, np.uint8), memory=rng.choice([10, 10**6]), run=rng.choice([1, 3, 1000])))
        positions = np.concatenate([p for p, _ in pieces]).tolist()
        common = np.concatenate([c for _, c in pieces]).tolist()
        assert sorted(positions) == list(range(len(text)))
        prefixes = [text[p : p + DEPTH] for p in positions]
        assert prefixes == sorted(prefixes, reverse=True)
        for i in range(1, len(text)):
            a, b = prefixes[i - 1], prefixes[i]
            assert common[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute(rows):
    least = {}
    texts = [(float("inf") if d is None else d, d, (t or "").encode()) for d, t in rows]
    for o, _, t in texts:
        for i in range(len(t) - 49):
            s = t[i : i + 50]
            least[s] = min(least.get(s, float("inf")), o)
    out = []
    for o, d, t in texts:
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < o:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs):
    got = sorted(map(tuple, sd.report(docs).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    return got


def test_against_brute_force(spark):
    assert sum(r[2] > 0 for r in check(read(spark, "documents"))) > 20


def test_awkward_rows(spark):
    check(documents(spark))
    assert sd.report(empty(spark)).count() == 0
    check(documents(spark, [(i, "é" * 40, "", "", 1) for i in (3, 1, 2, 2)] + [(5, "é" * 25, "", "", 1), (6, "é" * 24, "", "", 1), (None, "é" * 30, "", "", 1), (None, "é" * 40, "", "", 1)]))
    check(documents(spark, [(1, "x" * 200 + "y" * 60, "", "", 1), (1, "y" * 60 + "x" * 199, "", "", 1), (0, "x" * 51, "", "", 1)]))


def test_shared_passages_and_small_shards(spark, monkeypatch):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcd ") for _ in range(rng.choice([49, 50, 51, 70, 200]))) for _ in range(12)]
    rows = []
    for _ in range(80):
        text = "".join(rng.choice(passages)[rng.randrange(10) :] + "".join(rng.choice("abcd ") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 6)))
        rows.append((rng.randrange(1000), text, "", "", 1))
    docs = documents(spark, rows)
    want = check(docs)
    kept = sd.repeats(docs, with_kept=True, shard=100, memory=1000).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in kept), key=str) == want


def test_chunks_longer_than_a_place(monkeypatch):
    rng = np.random.default_rng(1)
    data, bounds = rng.integers(97, 103, 3000).astype(np.uint8), np.array([0, 700, 1500, 3000])
    whole = sd._records(data, bounds)
    monkeypatch.setattr(sd, "PLACE", 9)
    parts = sd._records(data, bounds)
    spread = lambda r: {(int(s), int(g)) for g, a, b in zip(r[0], r[2], r[3]) for s in range(a, b + 1)}
    assert {s for s, _ in spread(whole)} == {s for s, _ in spread(parts)} and sum(len(x[2]) for x in (whole,)) > 0
