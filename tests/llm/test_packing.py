import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seamline.llm.packing import SumOfSquares, Piece, encoder, pack, tokenizer_path
from tests.llm.helpers import documents, empty, read


def expected(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [(r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]


def test_every_id_lies_in_one_piece_and_windows_have_no_gaps(spark):
    for docs in (documents(spark), read(spark, "documents").repartition(3)):
        rows = pack(docs, with_ids=True).collect()
        pieces, windows = {}, {}
        for r in rows:
            assert r["length"] == len(r["ids"]) > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            pieces.setdefault(r["doc_id"], []).append(r)
            windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in windows.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r["length"] for r in rows)
        assert len(windows) * 2048 - total < 2048 * docs.rdd.getNumPartitions()
        want = {}
        for doc, ids in expected(docs):
            want.setdefault(doc, []).append(ids)
        for doc, copies in want.items():
            assert sum(map(len, copies)) == sum(r["length"] for r in pieces[doc])
            if len(copies) == 1:
                assert [i for r in sorted(pieces[doc], key=lambda r: r["start"]) for i in r["ids"]] == copies[0]
                assert {r["doc_tokens"] for r in pieces[doc]} == {len(copies[0])}
    assert pack(empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200) | st.lists(st.sampled_from(["a", " ", "\n", "'s", "<|endoftext|>", "1", "é", "\u00a0", "🙂", "\x85", "\u2028"]), max_size=60).map("".join))
def test_ids_are_those_of_tokenizers(text):
    e = encoder(tokenizer_path())
    assert e.fast is not None
    assert e.ids(text) == e.slow.encode(text, add_special_tokens=False).ids


def test_a_piece_goes_where_the_sum_of_squares_grows_least():
    rng = np.random.default_rng(1)
    packer = SumOfSquares(20)
    for _ in range(400):
        s = int(rng.integers(1, 20))
        before = packer.count.copy()
        options = {}
        for h in range(0, 20 - s + 1):
            if h == 0 or before[h]:
                after = before.copy()
                after[h] -= h > 0
                after[h + s] += h + s < 20
                options[h] = int((after[1:20] ** 2).sum())
        packer.add(Piece(0, 0, np.zeros(s, "<u4"), s))
        assert int((packer.count[1:20] ** 2).sum()) == min(options.values())


def test_open_windows_are_bounded_and_closing_loses_nothing():
    packer, out, n = SumOfSquares(100, most=5), [], 0
    for s in [51, 60, 70, 99, 55, 52, 88, 90, 77, 66, 51, 51]:
        out += packer.add(Piece(n, 0, np.arange(s, dtype="<u4"), s))
        n += s
    out += packer.close()
    assert sum(len(p.ids) for w in out for p in w) == n and sum(sum(len(p.ids) for p in w) < 100 for w in out) <= 3
