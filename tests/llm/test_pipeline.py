import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from seamline.llm import toxicity
from seamline.llm.packing import tokenizer_path
from tests.llm import test_decontamination, test_near_dedup, test_pii
from tests.llm.helpers import read

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = read(spark, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.report(docs, read(spark, "labels")).collect()}
    out = {}
    for name in names[:-1]:
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stored(stage[name](spark, docs, SF))
        assert docs.columns == columns
        out[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(out[name])
        if name == "toxicity":
            assert out[name] == {d: t for d, t in rows.items() if not scored[d]}
        if name == "near_dedup":
            assert out[name] == {d: rows[d] for d, n, _, kept in test_near_dedup.brute(list(rows.items())) if kept}
        if name == "decontamination":
            marks = {r[0]: r for r in test_decontamination.brute(rows.items(), [(r["item_id"], r["text"]) for r in read(spark, "benchmark").collect()])}
            assert set(out[name]) == {d for d in rows if not marks[d][5]}
            assert all(out[name][d] == rows[d] for d in out[name] if not marks[d][2])
        if name == "pii":
            assert set(out[name]) == set(rows)
            for d, text in rows.items():
                spans = test_pii.brute(text)
                assert any(spans.values()) or out[name][d] == text
                assert not any(test_pii.brute(out[name][d]).values())
    pieces = stage["packing"](spark, docs, SF).collect()
    # an exact round trip: pieces of a document are its ids, in order and whole
    tokenizer = Tokenizer.from_file(tokenizer_path())
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(out["pii"])
    for d, text in out["pii"].items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert corpus_pipeline.ORACLE_SQL is None
