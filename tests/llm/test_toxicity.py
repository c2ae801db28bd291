import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seamline.llm import toxicity as t
from tests.llm.helpers import documents, empty, read

VOCABULARY = "the cat sat on a mat and an idiot met some clown with stupid moron friends while worthless trash went by pathetic loser of the town said hello world again".split()


def model():
    text = " ".join(VOCABULARY * 30).encode()
    batch = next(t.count_trigrams(iter([documents_batch([text.decode()])])))
    counts = np.zeros(t.SYMBOLS**3, np.int64)
    counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return t.CharacterModel(counts)


def documents_batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


def test_trigram_counts():
    batch = next(t.count_trigrams(iter([documents_batch(["Ab é", None, "", "7ab"])])))
    counts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    n = t.SYMBOLS
    seq = [27, 0, 1, 27, 26, 27, 27, 27, 27, 0, 1, 27]
    want = {}
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        want[(a * n + b) * n + c] = want.get((a * n + b) * n + c, 0) + 1
    assert counts == want


def test_obfuscated_words_are_restored():
    r = t.Restorer(model())
    for text, want in [
        ("you 1d10t there", "you idiot there"),
        ("you i d i o t there", "you idiot there"),
        ("m.o.r.o.n", "moron"),
        ("stuuuupid thing", "stupid thing"),
        ("a $tupid cl0wn", "a stupid clown"),
        ("tr@sh", "trash"),
        ("l-o-s-e-r!", "loser!"),
        ("st*pid", "stupid"),
    ]:
        assert r.text(text) == want, (text, r.text(text))
    for text in ["hello world, 42 cats", "word%%% word$$$ end***", "2353820953013749", "y a la", "+1 (988) 555-2485"]:
        assert r.text(text) == text


def brute_decode(run, m):
    """Every reading of a run, by its cost."""
    best = (float("inf"), "")
    stack = [(0, t.EDGE, t.EDGE, 0.0, "")]
    while stack:
        i, a, b, cost, text = stack.pop()
        if i == len(run):
            best = min(best, (cost + m.costs[a][b][t.EDGE], text))
            continue
        ch = run[i]
        if ch in t.SEPARATORS:
            stack.append((i + 1, a, b, cost + t.SKIP, text))
            stack.append((i + 1, b, t.EDGE, cost + t.BREAK + m.costs[a][b][t.EDGE], text + " "))
            continue
        for letter, extra in t._options(ch):
            s = ord(letter) - 97 if "a" <= letter <= "z" else t.OTHER
            stack.append((i + 1, b, s, cost + extra + m.costs[a][b][s], text + letter))
            if text.endswith(letter):
                stack.append((i + 1, a, b, cost + extra + t.SKIP, text))
        if ch in t.LEET:
            stack.append((i + 1, a, b, cost + t.DROP, text))
    return best


def test_viterbi_finds_the_cheapest_reading():
    m = model()
    for run in ["1d10t", "i d i o t", "stuupid", "m0r0n", "aa1é-b", "t-r@ssh"]:
        cost, text = brute_decode(run, m)
        assert t.decode(run, m) == text


@settings(max_examples=150, deadline=None)
@given(st.text("ab1 @.é!$0-", max_size=30))
def test_rows_that_are_not_suspicious_have_no_runs(text):
    data = np.frombuffer(text.encode(), np.uint8)
    if not t.suspicious(data, np.array([0, len(data)]))[0]:
        assert t.RUN.search(text) is None


def test_runs_of_any_length_are_restored():
    r = t.Restorer(model())
    text = r.text("you " + " ".join("worthlessstupididiotpatheticmoron") + " there")
    assert all(word in text for word in ("you ", "stupid", "idiot", "pathetic", "moron", " there")), text
    assert r.text("st" + "u" * 60 + "pid") == "stupid"
    assert not any(c.isdigit() for c in r.text("st0pid1d10t" * 6))
    assert len(t.decode("a b " * 20000, model())) > 1000


def test_words_that_end_in_look_alikes_or_stand_in_quotes():
    text = " ".join((VOCABULARY + ["lame", "dumbass", "ass", "his", "less"]) * 30)
    counts = np.zeros(t.SYMBOLS**3, np.int64)
    batch = next(t.count_trigrams(iter([documents_batch([text])])))
    counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    r = t.Restorer(t.CharacterModel(counts))
    for text, want in [
        ("1d107", "idiot"),
        ("an idio7.", "an idiot."),
        ("w0r7hl355", "worthless"),
        ("a$$", "ass"),
        ("l4m3", "lame"),
        ("dumba55", "dumbass"),
        ('"stup1d"', '"stupid"'),
        ("(stup1d", "(stupid"),
        ("you.stup1d", "you.stupid"),
        ("-stup1d", "-stupid"),
        ("you s  t  u  p  i  d there", "you stupid there"),
        ("hello! world, cats!!! stup1d!", "hello! world, cats!!! stupid!"),
    ]:
        assert t.suspicious(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
        assert r.text(text) == want, (text, r.text(text))


def labelled(spark):
    words = "river stone cloud light green table house paper music water".split()
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(600):
        text = [str(w) for w in rng.choice(words, 12)]
        toxic = i % 5 == 0
        if toxic:
            text[3] = str(rng.choice(["idiot", "clown"]))
        docs.append((i, " ".join(text), "", "", 1))
        labels.append((i, 1, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_and_unseen_obfuscation(spark):
    docs, labels = labelled(spark)
    extra = [(1000, "river 1d10t stone", "", "", 1), (1001, "cl0wn water", "", "", 1), (1002, "river i d i o t stone", "", "", 1), (1003, None, "", "", 1), (1004, "", "", "", 1), (None, "an idiot", "", "", 1)]
    rows = {r["doc_id"]: r for r in t.report(documents(spark, docs + extra), labels).collect()}
    for i in range(600):
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert rows[i]["predicted"] == int(i % 5 == 0) == int(rows[i]["score"] >= 0.3) and 0 <= rows[i]["score"] <= 1
    assert [rows[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, None)] == [1, 1, 1, 0, 0, 1]
    kept = t.keep_clean(documents(spark, docs + extra), labels)
    assert kept.columns == documents(spark).columns and kept.count() == 600 - 120 + 2


def test_awkward_tables(spark):
    _, labels = labelled(spark)
    assert t.report(empty(spark), labels).count() == 0
    assert t.report(documents(spark), labels.limit(0)).count() == documents(spark).count()
    got = t.report(documents(spark), read(spark, "labels"))
    assert got.count() == documents(spark).count() and got.where("score is null").count() == 0


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = t.report(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    found = sum(r["predicted"] and r["toxic"] for r in rows) / sum(r["toxic"] for r in rows)
    assert hit > 0.9 and found > 0.8


def test_runs_are_found_in_linear_time():
    n = 1 << 20
    for shape in ("ab" * (n // 2), "a1" * (n // 2) + "2", "a " * 3 + " " * n + "bb", "a@" * (n // 2) + "2", "@" * n, "7" * n):
        began = time.process_time()
        t.suspicious(np.frombuffer(shape.encode(), np.uint8), np.array([0, len(shape)]))
        for m in t.RUN.finditer(shape):
            m.group()
        assert time.process_time() - began < 5


def test_the_logistic_model_has_the_least_loss():
    rng = np.random.default_rng(6)
    x = (rng.random((300, 12)) < 0.2).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(2 - 3 * x[:, 0] - 2 * x[:, 1]))).astype(float)
    rows, columns = np.nonzero(x)
    w, c = t.logistic(rows, columns, y, 12)
    full = np.append(w, c)
    a = np.hstack([x, np.ones((300, 1))])
    penalty = np.append(np.full(12, t.RIDGE), 1e-6)
    # the gradient is zero where the loss is least, as the loss is convex
    assert np.abs(a.T @ (1 / (1 + np.exp(-a @ full)) - y) + penalty * full).max() < 1e-5
    assert t.logistic(np.zeros(0, int), np.zeros(0, int), np.array([1.0, 0, 0, 0]), 0)[1] < 0


def test_scores_against_brute_force(spark):
    """Features, choice, fit and scores of the whole query by plain dictionaries."""
    docs, labels = labelled(spark)
    table = documents(spark, docs)
    scorer = t.fit(table, labels)
    got = {r["doc_id"]: r["score"] for r in t.report(table, labels).collect()}

    def feats(text):
        words = re.findall("[0-9a-z]+", text.lower())
        return {("w", x) for x in words} | {(n, x[:n]) for x in words for n in t.PREFIXES if len(x) > n}

    train = [(feats(text), int(i % 5 == 0)) for i, text, *_ in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    base = sum(y for _, y in train) / len(train)
    # no two of these texts have a run of five words in common, so all toxic rows count
    counts = {f: (sum(f in s and y for s, y in train), sum(f in s for s, _ in train)) for f in set().union(*(s for s, _ in train))}
    tried = sum(c >= t.SUPPORT for c, _ in counts.values())

    def surprise(c, n):
        raw = c / n
        return n * (raw * np.log(raw / base) + ((1 - raw) * np.log((1 - raw) / (1 - base)) if raw < 1 else 0))

    telling = sorted((f for f, (c, n) in counts.items() if c >= t.SUPPORT and c / n > base and surprise(c, n) >= np.log(tried / t.CHANCE)), key=str)
    assert len(telling) == len(scorer.found)
    a = np.array([[f in s for f in telling] + [True] for s, _ in train], float)
    y = np.array([v for _, v in train], float)
    w = np.zeros(a.shape[1])
    penalty = np.append(np.full(len(telling), t.RIDGE), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
    for i, text, *_ in docs:
        s = feats(text)
        want = 1 / (1 + np.exp(-(w[:-1] @ [f in s for f in telling] + w[-1])))
        assert abs(got[i] - want) < 0.05
