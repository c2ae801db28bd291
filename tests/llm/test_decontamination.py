import hashlib
import re

from seamline.llm.decontamination import decontaminate, decontaminate_report
from tests.llm.helpers import documents, empty, read

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    grams = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (who := grams.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= who
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(docs, bench, **more):
    rows = [tuple(r) for r in decontaminate_report(docs, bench).collect()]
    assert sorted(rows, key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    return rows


def test_against_brute_force(spark):
    rows = check(read(spark, "documents"), read(spark, "benchmark"))
    assert any(r[5] for r in rows)


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "Quick BROWN fox"), (2, None), (3, ""), (4, "a b c d e f g h i j k l m n"), (5, "one two"), (6, "naïve 日本語"), (10, "one two"), (7, "日本語 🙂 word ÉTÉ")], "item_id long, text string")
    rows = check(documents(spark), bench)
    assert sum(r[2] > 0 for r in rows) >= 6
    check(empty(spark), bench)
    check(documents(spark), bench.limit(0))


def test_sets_of_bounded_size(spark):
    import seamline.llm.decontamination as d

    docs, bench = read(spark, "documents").select("doc_id", "text"), read(spark, "benchmark")
    whole = {(r["doc_id"], r["__n_hit"], tuple(r["__items"])) for r in d.mark(docs, bench).collect()}
    parts = {(r["doc_id"], r["__n_hit"], tuple(r["__items"])) for r in d.mark(docs, bench, set_bytes=2000).collect()}
    assert whole == parts


def test_documents_and_spans_are_removed(spark):
    filler = " ".join(f"w{i}" for i in range(500))
    passage = " ".join(f"bench{i}" for i in range(13))
    docs = documents(spark, [(1, passage, "", "", 1), (2, f"{filler}. {passage}! {filler}", "", "", 1), (3, filler, "", "", 1), (4, None, "", "", 1)])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = decontaminate(docs, bench)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {2: f"{filler}. ! {filler}", 3: filler, 4: None}
