"""Operator 12 against the public tokenizers and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from workrisk.llm import align
from workrisk.llm.bpe import byte_characters
from workrisk.llm.queries import pieces_path, tokenizer_path

DOCS = "doc_id long, text string, n_a string, unit string, `key` string"
ODD = [None, "", " ", "one", "Hello, world! 123", "ünïcode ßtraße 日本語 😀 ́x", "a" * 3000, "same text here", "same text here",
       "text with <|endoftext|> and <s> </s> <0x41>", "U+2581 ▁ inside", "it's we'll  two  spaces\r\n\t", "\x00\x7f", " " * 50]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=pieces_path())


def token_ends(a, b, text):
    """(id, end) of both sides, or nothing."""
    back = {c: i for i, c in enumerate(byte_characters())}
    vocab = {i: t for t, i in a.get_vocab().items()}
    if not text:
        return [], []
    sides = []
    for ids, raw in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(back[c] for c in vocab[i])),
                     (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                      else b.id_to_piece(i).replace("▁", " ").encode())):
        at, side, joined = 0, [], b""
        for i in ids:
            joined += raw(i)
            side.append((i, len(joined)))
        if joined != (" " + text).encode():
            return [], []
        sides.append(side)
    return sides


def brute(a, b, texts):
    links, rows, counts = [], [], Counter()
    for text in texts:
        left, right = token_ends(a, b, text)
        both = {e for _, e in left} & {e for _, e in right}
        found = [(i, j) for i, e in left for j, f in right if e == f]
        links.append(found)
        counts.update(found)
        spans = [[(s, e) for s, e in zip([0, *(e for _, e in x)], (e for _, e in x))] for x in (left, right)]
        n_overlaps = sum(max(s, t) < min(e, f) for s, e in spans[0] for t, f in spans[1]) if len(left) < 500 else None
        groups, low = [], 0
        for end in sorted(both):
            groups.append("|".join(",".join(str(i) for i, e in side if low < e <= end) for side in (left, right)))
            low = end
        rows.append([len(left), len(right), len(both), len(found), n_overlaps,
                     hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [tuple([*row, sum(counts[x] == best[x[1]] for x in found), sum(counts[x] for x in found)])
            for row, found in zip(rows, links)]


@pytest.mark.parametrize("unit", [200, align.UNIT_BYTES])
def test_alignment_equals_brute_force(spark, monkeypatch, libraries, unit):
    monkeypatch.setattr(align, "UNIT_BYTES", unit)
    r = np.random.default_rng(2)
    texts = ODD + ["".join(r.choice(list("abcdeth  ,.é1\n"), r.integers(1, 120))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)
    found = align.align(docs, tokenizer_path(), pieces_path()).orderBy("doc_id").collect()
    want = brute(*libraries, texts)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "n_best", "count_sum")
    for row, w in zip(found, want, strict=True):
        got = tuple(row[c] for c in names)
        assert got[:4] == w[:4] and got[5:] == w[5:] and w[4] in (None, got[4]), texts[row["doc_id"]]


def test_repeated_and_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same row", "", "", ""), (1, "same row", "", "", ""), (1, None, "", "", ""), (None, "no id", "", "", "")], DOCS)
    rows = align.align(docs, tokenizer_path(), pieces_path()).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in rows) == [(0, 2), (1, 0), (1, 2), (1, 2)]
    assert align.align(docs.limit(0), tokenizer_path(), pieces_path()).count() == 0


def test_long_text(libraries):
    pair = align.Pair(tokenizer_path(), pieces_path())
    text = "word after word 日本 " * 60_000
    numbers, digests, keys, links, times = align.align_unit(pair, [text, "", text])
    assert numbers["n_groups"][0] == numbers["n_groups"][2] > 100_000 and numbers["n_groups"][1] == 0
    assert digests[0] == digests[2] and digests[1] == "" and times.sum() == sum(len(x) // 4 for x in links)


def test_words_in_use_stay_remembered():
    from workrisk.llm.bpe import ByteBPE
    coder, merged = ByteBPE(tokenizer_path(), cache_bytes=40_000), []
    block = coder._merge_block
    coder._merge_block = lambda words, leaves: merged.extend(words) or block(words, leaves)
    for i in range(40):
        coder.encode(" words of every text " + " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(26)))
    assert merged.count(b" every") == 1 and len(coder.cache) + len(coder.old) < 400
