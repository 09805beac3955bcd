"""Operator 11 against the public library."""

import random
import struct

import numpy as np
import pytest

from workrisk.llm import piecebpe
from workrisk.llm.queries import pieces_path

ODD = [None, "", " ", "  a", "a  b ", "▁x", "▁▁▁ ▁", "\x00a", "日本語😀", "a\n\tb\r\n", "\xa0", "<s> </s> <unk> <0x41>", "é ﬁ",
       "a" * 5000, "ab" * 3000, " " * 40 + "x" + " " * 33, "same", "same", "1234567890 12", "\U0010ffff�", "==========--------"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=pieces_path())


def values(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_encode_and_decode_equal_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(ODD)], "doc_id long, text string, ids string, kept string")
    rows = piecebpe.encode(docs, pieces_path(), decoded_col="decoded").orderBy("doc_id").collect()
    for text, row in zip(ODD, rows, strict=True):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert values(row["ids"]) == want and row["decoded"] == library.decode(want) and row["kept"] == "y"
    again = piecebpe.decode(piecebpe.encode(docs, pieces_path(), ends=False), pieces_path()).orderBy("doc_id").collect()
    assert [values(r["ids"]) for r in again] == [library.encode(t or "") for t in ODD]
    assert [r["decoded"] for r in again] == [library.decode(library.encode(t or "")) for t in ODD]
    assert piecebpe.encode(docs.limit(0), pieces_path()).count() == 0
    empty = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, ids binary")
    assert [r["decoded"] for r in piecebpe.decode(empty, pieces_path()).collect()] == ["", ""]


def test_random_texts_equal_the_library(library):
    r, coder = random.Random(3), piecebpe.PieceBPE(pieces_path())
    texts = ["".join(r.choices("abcdefghij ethn  srt▁lu\n0123.,é日😀", k=r.randrange(1, 80))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x500), r.randrange(0x500, 0xD000), r.randrange(0xE000, 0x1FFFF)]))
                      for _ in range(r.randrange(1, 60))) for _ in range(1000)]
    assert [values(x) for x in coder.encode_batch(texts)] == [library.encode(t, add_bos=True, add_eos=True) for t in texts]


def test_search_equals_merging(library):
    """The backtracking search finds what merging the whole string gives, also if every match must be given up."""
    r, coder = random.Random(4), piecebpe.PieceBPE(pieces_path())
    words = ["".join(r.choices("▁theranidos", k=r.randrange(2, 63))) for _ in range(2000)]
    want = [coder.merge(w) for w in words]
    assert [coder.search(w) for w in words] == want
    assert [[coder.names[k] for k in found] for found in coder.search_words(words)] == want


def test_decoding_of_any_ids_equals_the_library(library):
    r, coder = random.Random(5), piecebpe.PieceBPE(pieces_path())
    for _ in range(4000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(300)]) for _ in range(r.randrange(12))]
        assert coder.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids)


def test_caches_are_bounded_and_emptied():
    coder = piecebpe.PieceBPE(pieces_path(), cache_bytes=100_000)
    texts = [f"word{i} and some{i * 7919 % 1000}thing" for i in range(3000)]
    whole = piecebpe.PieceBPE(pieces_path()).encode_batch(texts)
    assert coder.encode_batch(texts) == whole and coder.cached < 110_000
    coder.forget()
    assert not coder.cache and coder.cached == 0 and piecebpe.PAIR * len(coder.follows) <= 100_000


def test_long_run_without_spaces(library):
    text = "ab" * 500_000 + " " * 300_000
    assert values(piecebpe.PieceBPE(pieces_path()).encode(text)) == library.encode(text, add_bos=True, add_eos=True)
