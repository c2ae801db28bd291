"""Columns of a table that have the names operators use inside, and tables whose rows are all null."""

from seamline.llm import decontamination, near_dedup, pii, toxicity
from tests.llm.helpers import DOCS, read

NAMES = ("__score", "__key", "__cls", "__terms", "__items", "__spans", "__n_words", "__n_hit", "__doc_id", "__chosen", "__c0", "size", "score", "term")
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)


def table(spark, rows):
    return spark.createDataFrame([(r[0], r[1], *NAMES) for r in rows], SCHEMA)


def test_columns_with_inner_names_stay(spark):
    docs = table(spark, DOCS)
    nulls = spark.createDataFrame([(None,) * (2 + len(NAMES))] * 3, SCHEMA)
    bench, labels = read(spark, "benchmark"), read(spark, "labels")
    for f in (near_dedup.deduplicate, lambda d: toxicity.keep_clean(d, labels), lambda d: decontamination.decontaminate(d, bench), lambda d: pii.sanitise(d, everywhere=True)):
        out = f(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r)[2:] == NAMES for r in rows)
        assert f(nulls).count() == 3


def test_items_without_an_id_hit_but_have_no_name(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, words), (2, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, words), ("a", None), ("b", " ".join(["same"] * 40))], "item_id string, text string")
    rows = {r["doc_id"]: r for r in decontamination.decontaminate_report(docs, bench).collect()}
    assert (rows[1]["n_hit"], rows[1]["n_items"], rows[1]["contaminated"]) == (20, 0, True) and rows[2]["n_hit"] == 0
