"""Odd rows of the training-data operators: short, deeply nested, very long, many languages, clashing columns."""

import numpy as np
import pytest

from workrisk.llm import htmltext, langid, packing, quality
from workrisk.llm.common import free_name
from workrisk.llm.queries import tokenizer_path

RNG = np.random.default_rng(3)


def flat_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])


def plain_ngrams(text):
    """N-grams of full length and short words of one text, by a plain loop."""
    raw = b" " + bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 97 <= b < 123 else 32 for b in text.encode()) + b" "
    full = [raw[i:i + 5] for i in range(len(raw) - 4) if b"  " not in raw[i:i + 5]]
    short = [b" " + w + b" " for w in raw.split(b" ") if 0 < len(w) < 3]
    return full, short


def packed(grams):
    return sorted(int.from_bytes(g, "big") for g in grams)


def test_ngrams_equal_a_plain_loop():
    texts = ["", "Re.", "In. The.", "a", "Der", "x  y é", "the cat sat", "...", " ", "12 ab", "日本", "ends a", "b begins", ""]
    gram, row = langid.ngrams(*flat_of(texts))
    used, used_row = langid.deciding(gram, row, len(texts))
    for i, text in enumerate(texts):
        full, short = plain_ngrams(text)
        assert sorted(gram[row == i].tolist()) == packed(full + short)
        assert sorted(used[used_row == i].tolist()) == packed(full or short)


@pytest.mark.parametrize("languages", [3, 70])
def test_filter_shares_equal_exact_sets(languages):
    """No false negative, and corrected shares near those of exact sets, also beyond 64 languages."""
    words = ["".join(RNG.choice(list("abcdefghijklmnop"), 6)) for _ in range(40 * languages)]
    texts = {f"l{i:02}": " ".join(words[40 * i:40 * (i + 1)]) for i in range(languages)}
    grams = {k: np.unique(langid.ngrams(*flat_of([t]))[0]) for k, t in texts.items()}
    model = langid.LanguageFilter.build(grams)
    assert model.masks.shape[0] == (languages > 64) + 1
    share, total = model.estimates(*flat_of(list(texts.values())))
    assert [model.languages[i] for i in share.argmax(axis=1)] == list(texts)
    for i, text in enumerate(texts.values()):
        own = langid.ngrams(*flat_of([text]))[0]
        own = own[own >= 1 << 32]
        assert total[i] == len(own)
        exact = np.array([np.isin(own, grams[k]).mean() for k in model.languages])
        assert share[i, i] == 1 and np.abs(share[i] - exact).max() < 0.02


def test_short_texts_get_their_language(spark):
    rows = [(i, f"Re. In. the cat {i} sat on it as we do", "en") for i in range(20)]
    rows += [(100 + i, f"Un le chat {i} se met la", "fr") for i in range(20)] + [(200, "zu ab", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(0, "Re.", "x"), (1, "Un. La.", "y"), (2, "Zu", "z"), (3, "the", "u"), (4, "..", "v")],
                                 "doc_id long, text string, _HAS_letter string")
    got = langid.predict(docs, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["en", "fr", "de", "en", "und"]
    assert [r["_HAS_letter"] for r in got] == list("xyzuv") and all(r["score"] > 0 for r in got[:4])


def test_free_name(spark):
    df = spark.createDataFrame([], "_Key long, __key long")
    assert free_name(df, "_key") == "___key" and free_name(df, "other") == "other"


def test_scores_do_not_depend_on_the_batch():
    texts = ["".join(RNG.choice(list("abcdef ghij.é"), n)) for n in RNG.integers(0, 900, 300)]
    net = quality.train([t.encode() for t in texts[:100]], RNG.integers(0, 2, 100).astype(float), steps=30)
    together = quality.score_texts(net, *flat_of(texts))
    assert [quality.score_texts(net, *flat_of([t]))[0] for t in texts] == together.tolist()
    assert quality.score_texts(net, *flat_of(texts[::-1])).tolist() == together[::-1].tolist()


def test_network_equals_a_plain_convolution():
    net = quality.Network.start()
    for text in (b"", b"short", bytes(RNG.integers(32, 127, 700, dtype=np.uint8))):
        data = list(text) + [quality.PAD] * (quality.WINDOW + quality.STRIDE)
        strides = max(1, -(-len(text) // quality.STRIDE))
        data += [quality.PAD] * (strides * quality.STRIDE)
        last = strides * quality.STRIDE - quality.WINDOW
        z = [sum(net.embed[data[i + w]] @ net.conv[w] for w in range(quality.WINDOW)) for i in range(last + 1)]
        chunks = []
        for s in range(strides):
            end = min((s + quality.SPAN) * quality.STRIDE, last + 1)
            chunks.append(np.tanh(np.max(z[s * quality.STRIDE:end], axis=0)))
        x = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0)])
        h = np.maximum(x @ net.hidden + net.hidden_bias, 0)
        want = 1 / (1 + np.exp(-(h @ net.out + net.out_bias[0])))
        flat, offsets = flat_of([text.decode()])
        assert abs(quality.score_texts(net, flat, offsets)[0] - want) < 1e-5


def test_deep_nesting_needs_little_memory():
    import tracemalloc
    tracemalloc.start()
    page = htmltext.blocks("".join(f"<div class='c{chr(97 + i % 26)}'>t" for i in range(20_000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(page) == 20_000 and peak < 100 << 20
    assert max(len(b.path) for b in page) <= 32
    # the features are those of the whole path
    nested = htmltext.blocks("<div class=a><div class=b><section><div class=a><p>x")[0]
    assert htmltext.path_features(nested.path) == {"div", ".a", ".b", "section", "p", "in:p", "two:div>p"}


def test_unclosed_elements_keep_the_rest_of_the_page():
    def texts(html):
        return [b.text for b in htmltext.blocks(html)]
    for tag in ("select", "svg", "noscript", "iframe", "template", "object", "math"):
        assert texts(f"<article><p>one</p><{tag}><p>two</p><p>three</p></article>")[-2:] == ["two", "three"], tag
    assert texts("<p>a</p><select><option>x</option></select><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><svg><g><svg><text>x</text></svg></g></svg><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><select><p>b</p><select><option>x</option></select><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert texts("<p>see <object data=u>the fallback</object> here</p>") == ["see the fallback here"]
    assert texts("<p>a</p><script>if (a) { <p>") == ["a"]
    assert len(texts("<svg>" * 20_000 + "<p>x</p>")) == 1


def test_packing_of_long_white_space(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    texts = [" " * 1_000_000, "a" + "\n" * 300_000 + "b", "x  y", "word " * 1_000_000]
    assert [list(packing.cut_runs(t)) for t in ("", "x  y")] == [[""], ["x  y"]]
    assert all("".join(packing.cut_runs(t)) == t for t in texts)
    enc = packing.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in packing.pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                                      public_tokenizers.PATTERN)
           .groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    for i, text in enumerate(texts):
        ids = [t for part in packing.cut_runs(text) for t in enc.encode_ordinary(part)]
        assert enc.decode(ids) == text and got[i] == len(ids)
    lib = Tokenizer.from_file(tokenizer_path())
    assert enc.encode_ordinary(texts[2]) == lib.encode(texts[2], add_special_tokens=False).ids


def test_pipeline_keeps_clashing_columns(spark):
    import corpus_pipeline as P
    texts = [f"{a} words of document {a} go on here with {a} more and more" for a in "pqrs"]
    docs = spark.createDataFrame([(i // 2, t, f"k{i}", f"r{i}", f"q{i}") for i, t in enumerate(texts + texts[:1])],
                                 "doc_id long, text string, _KEY string, _row string, _quality string")
    got = P.duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = {(0, "k0", "r0", "q0"), (0, "k1", "r1", "q1"), (1, "k2", "r2", "q2"), (1, "k3", "r3", "q3")}
    assert {(r["doc_id"], r["_KEY"], r["_row"], r["_quality"]) for r in got.collect()} == want


def test_a_process_holds_one_large_object_and_small_caches():
    from workrisk.llm import bpe, common
    coder = bpe.tokenizer(tokenizer_path())
    assert bpe.tokenizer(tokenizer_path()) is coder
    small = bpe.ByteBPE(tokenizer_path(), cache_bytes=20_000)
    texts = [" ".join("".join(chr(97 + int(d)) for d in str(1000 * i + j)) for j in range(300)) for i in range(1, 7)]
    assert [small.encode(t) for t in texts] == [coder.encode(t) for t in texts]
    assert len(small.cache) < len(coder.cache)
    small.forget()
    assert not small.cache and small.cached == 0
    list(common.lean(iter)(iter([])))
    assert not common._held and bpe.tokenizer(tokenizer_path()) is not coder
