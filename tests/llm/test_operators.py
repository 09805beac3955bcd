"""The training-data operators on small tables: brute force, round trips, odd rows."""

import hashlib
import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from workrisk.llm import (bpe, covertree, decontaminate, htmltext, jaccard, langid, license, packing, quality, warc)
from workrisk.llm.components import connected_components
from workrisk.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, ids string, score string, group string"
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, texts, start=0):
    """Documents with extra columns whose names clash with what the operators add."""
    return spark.createDataFrame([(start + i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t", "one", "Hello, world! 123", "ünïcode ßtraße 日本語 😀", "a" * 5000, "same text here", "same text here",
       "text with <|endoftext|> inside", "it's we'll  two  spaces\r\n"]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer
    path = tokenizer_path()
    lib = Tokenizer.from_file(path)
    rows = bpe.encode(docs_of(spark, ODD), path, decoded_col="decoded").collect()
    for text, row in zip(ODD, rows, strict=True):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == want
        assert row["decoded"] == lib.decode(want, skip_special_tokens=False) and row["score"] == "y"
    assert bpe.encode(docs_of(spark, []), path).count() == 0
    assert bpe.decode(bpe.encode(docs_of(spark, ODD), path), path).count() == len(ODD)


def test_bpe_lockstep_equals_single_tree():
    coder, r = bpe.tokenizer(tokenizer_path()), np.random.default_rng(1)
    words = [bytes(r.choice(list(b"aetinosh r\xc3\xa9"), r.integers(1, 50))) for _ in range(500)]
    assert [x.tolist() for x in coder.merge_words(words)] == [coder.merge_word(w) for w in words]


def brute_components(texts):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return [len(s) for s in sets], label


def test_jaccard_equals_brute_force(spark):
    r = np.random.default_rng(4)
    texts = [None, "", "one two", "One  two", "a b c d e"]
    passage = " ".join(r.choice(WORDS, 40))
    for n in (5, 8, 9, 10, 12, 14, 18, 25, 60, 200):
        base = r.choice(WORDS, n).tolist()
        for _ in range(9):
            words = list(base)
            for _ in range(r.integers(0, max(2, n // 12))):
                words[r.integers(0, len(words))] = str(r.choice(WORDS))
            words += r.choice(WORDS, r.integers(0, max(1, n // 10) + 1)).tolist()
            texts.append(" ".join(words))
    texts += [passage + " " + " ".join(r.choice(WORDS, 50)) for _ in range(25)]
    texts += [texts[20], texts[20]]
    sizes, label = brute_components(texts)
    rows = {x["doc_id"]: x for x in jaccard.join_components(docs_of(spark, texts)).collect()}
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [rows[i]["component_id"] for i in range(len(texts))] == label
    assert jaccard.join_components(docs_of(spark, [])).count() == 0


def test_jaccard_blocks_outnumber_differences():
    sizes = jaccard.Sizes()
    for n in (10, 50, 118, 146, 1000, 20_000):
        r = np.random.default_rng(n)
        value = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (jaccard.shared_blocks(value, np.array([0, len(value)]), sizes) > 1).any() or n < 50


def linked_sets(r, sizes, n, m):
    """Hashes of two sets of sizes n and m that share as few as linked sets may."""
    c = sizes.overlap(n, m)
    x = r.permutation(np.unique(r.integers(0, 1 << 63, 2 * (n + m)).astype(np.uint64) * np.uint64(2)))[:n + m - c]
    return np.sort(x[:n]), np.sort(x[n - c:])


@pytest.mark.parametrize("limit", [4, 12, 13])
def test_jaccard_linked_sets_of_every_size_share_a_key(limit):
    sizes, r = jaccard.Sizes(), np.random.default_rng(limit)
    for n, m in ((n, m) for n in [*range(1, 40), 52, 64, 65, 80] for m in sizes.partners(n) if n <= m):
        if sizes.overlap(n, m) > n:
            continue
        for _ in range(150 if n < 20 else 20):
            a, b = linked_sets(r, sizes, n, m)
            key, row, _ = jaccard.batch_keys(np.concatenate([a, b]), np.array([0, n, n + m]), limit, sizes)
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist()), (n, m)
            if 0.8 * m >= limit:  # no filled block in common: the prefix keys alone
                assert set(jaccard.prefix_keys(a, limit, sizes)) & set(jaccard.prefix_keys(b, limit, sizes)), (n, m)


def test_repeated_ids_with_different_texts(spark):
    import corpus_pipeline as P
    r = np.random.default_rng(7)
    one, two, three = (" ".join(r.choice(WORDS, 60)) for _ in range(3))
    near = two + " " + str(r.choice(WORDS))
    rows = [(1, one, "b"), (5, one, "a"), (5, two, "a"), (6, two, "a"), (7, near, "a"), (8, three, "b"), (8, three, "a"),
            (9, "", "a"), (9, None, "a"), (None, one, "a"), (10, three + " end", "a"), (10, "a short one", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((x["doc_id"], x["component_id"]) for x in jaccard.join_components(docs).collect() if x["doc_id"])
    assert got == [(1, 1), (5, 1), (5, 1), (6, 1), (7, 1), (8, 8), (8, 8), (9, 9), (9, 9), (10, 8), (10, 8)]
    kept = [tuple(x) for x in P.duplicate_stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, one, "b"), (5, two, "a"), (8, three, "a"), (9, "", "a"), (9, None, "a"),
                                            (None, one, "a"), (10, "a short one", "a")], key=str)


def test_jaccard_boundary_does_not_follow_the_table_below_its_floor():
    sizes = jaccard.Sizes()
    for histogram in ({n: 100 for n in range(1, 25)}, {n: 1000 // n for n in range(1, 25)}, {n: 100 for n in range(5, 25)}, {}):
        assert sizes.boundary(histogram) >= 12


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (8, 8)], "a long, b long")
    assert dict(connected_components(edges, "a", "b").collect()) == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_masks_hit_every_window_with_three_substitutions():
    kept = [[i for i, b in enumerate(m) if b == "1"] for m in decontaminate.MASKS]
    for miss in itertools.combinations(range(16), 3):
        assert any(not {s + i for i in k} & set(miss) for k in kept for s in range(16 - k[-1]))


def test_decontaminate_finds_substituted_passages(spark):
    item = [f"t{i}" for i in range(40)]
    changed = [w if i % 6 else "other" for i, w in enumerate(item)]
    texts = ["x y z " + " ".join(item) + " end", " ".join(changed[:30]), " ".join(item[:9]), None, "",
             " ".join(f"q{i}" for i in range(60)), "X Y " + " ".join(item).upper()]
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "short one")], "item_id long, text string")
    found = decontaminate.overlaps(docs_of(spark, texts), items)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(0, 7), (1, 7), (6, 7)]
    assert decontaminate.overlaps(docs_of(spark, []), items).count() == 0


def test_decontaminate_shuffled_equals_broadcast(spark):
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text")
    items = items.union(spark.createDataFrame([(-1, None), (-2, "one two three four five six seven")], items.schema))
    docs = docs.union(spark.createDataFrame([(-1, "zero one two three four five six seven eight"), (-2, None)], docs.schema))
    shuffled = decontaminate.overlaps(docs, items, broadcast_bytes=-1)
    assert "BroadcastHashJoin" in decontaminate.overlaps(docs, items)._jdf.queryExecution().toString()
    rows = sorted(map(tuple, decontaminate.overlaps(docs, items).collect()))
    assert (-1, -2, 7, 7) in rows and rows == sorted(map(tuple, shuffled.collect()))


def accepted(doc, item):
    """The acceptance rule, tried at every alignment: the most equal tokens of a window, or None."""
    n, best = min(16, len(item)), -1
    for p, q in itertools.product(range(len(doc) - n + 1), range(len(item) - n + 1)):
        best = max(best, sum(a == b for a, b in zip(doc[p:p + n], item[q:q + n], strict=True)))
    return (best, n) if n and best * 100 >= n * 80 else None


def test_decontaminate_short_items_equal_the_acceptance_rule(spark):
    items = {n: [f"i{n}t{k}" for k in range(n)] for n in range(1, 21)} | {50: ["same"] * 7, 51: ["你好世界"]}
    docs = {}
    for n, item in [x for x in items.items() if x[0] <= 20]:
        for miss in range(n - -(-n * 80 // 100) + 2):
            for gone in itertools.islice(itertools.combinations(range(n), miss), 0, None, 1 if n < 12 else 17):
                docs[len(docs)] = ["a", "b", *("x" if k in gone else t for k, t in enumerate(item[:n])), "c"]
    docs |= {len(docs) + k: d for k, d in enumerate((["same"] * 5, ["same"] * 9, ["q", "你好世界"], ["i3t0", "i3t1"], []))}
    item_rows = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), (90, " .,"), (91, None)], "item_id long, text string")
    found = decontaminate.overlaps(docs_of(spark, [" ".join(d) for d in docs.values()]), item_rows)
    want = {(d, i, *a) for d, w in docs.items() for i, v in items.items() if set(v) & set(w) and (a := accepted(w, v))}
    assert set(map(tuple, found.collect())) == want and {i for _, i, *_ in want} == set(items)


def test_langid(spark):
    r = np.random.default_rng(2)
    parts = {"aa": ["the", "ing", "wh", "tion"], "bb": ["ñol", "qué", "ción", "rr"]}
    rows = [(i, " ".join("".join(r.choice(parts[lang], 2)) for _ in range(40)), lang)
            for i, lang in enumerate(["aa", "bb"] * 40)]
    model = langid.fit(spark.createDataFrame([*rows, (500, None, "aa"), (501, "x", None)],
                                             "doc_id long, text string, lang string"))
    got = langid.predict(docs_of(spark, [rows[0][1], rows[1][1].upper(), None, "", "123 !!"]), model).collect()
    assert [x["lang_pred"] for x in got] == ["aa", "bb", "und", "und", "und"]
    assert all(0 <= x["score"] <= 1 for x in got) and got[2]["score"] == 0
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.predict(docs_of(spark, ["abc"]), empty).first()["lang_pred"] == "und"


def test_quality_learns_and_scores_odd_rows(spark):
    r = np.random.default_rng(3)
    good = [" ".join(r.choice(WORDS, 60)) for _ in range(120)]
    bad = [" ".join(f"{w}%%%" for w in r.choice(WORDS, 60)) for _ in range(120)]
    net = quality.train([t.encode() for t in good[:90] + bad[:90]], np.array([1.0] * 90 + [0.0] * 90), steps=150)
    rows = quality.score(docs_of(spark, [*good[90:], *bad[90:], None, "", "z" * 100_000]), net).collect()
    s = [x["score"] for x in rows]
    assert min(s[:30]) > max(s[30:60]) and all(0 <= x <= 1 for x in s) and s[60] == s[61]
    assert quality.train([], np.zeros(0)).prior == 0.5 and quality.train([b"a"], np.ones(1)).prior == 1.0


def test_warc_round_trip(spark):
    html = ["<p>a</p>", None, "", "<p>b</p>", "<p>a</p>", "x" * 50_000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(None, None, "n")],
                                  "page_id long, url string, html string")
    folder = warc.archive(pages)
    rows = {x["page_id"]: x for x in warc.read_archives(spark, folder, payload=True).collect()}
    assert len(rows) == 8
    for i, h in enumerate(html):
        same = max(j for j, g in enumerate(html) if (g or "") == (h or ""))
        row, data = rows[i], (h or "").encode()
        assert row["payload_bytes"] == len(data) and row["payload_digest"] == warc.sha1_base32(data)
        assert (row["record_type"], row["refers_to"]) == (("response", None) if same == i else ("revisit", same))
        assert same != i or bytes(row["payload"]) == data
    assert warc.read_archives(spark, warc.archive(pages.limit(0))).count() == 0
    name = next(f for f in os.listdir(folder.removeprefix("file:")) if f.endswith(".zst"))
    with open(os.path.join(folder.removeprefix("file:"), name), "rb") as f:
        assert f.read(4) == (0x184D2A5D).to_bytes(4, "little")


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 8)).astype(np.float32)
    x[50:200] = x[50]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1001, [float("nan")] * 8), (1002, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, covertree.top_k(df, df.where("vec_id % 100 = 0"), k=5).collect()))
    whole, want = np.floor(1024 * x.astype(np.float64)).astype(np.int64), []
    for q in range(0, 400, 100):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(400), -score)).tolist() if i != q][:5]
        want += [(q, n + 1, i, int(score[i])) for n, i in enumerate(order)]
    assert got == want
    assert covertree.top_k(df.limit(0), df).count() == 0


def test_top_k_of_repeated_ids_and_ties(spark):
    r = np.random.default_rng(8)
    for seed, (n, ids, spread) in enumerate([(24, 13, 3), (600, 90, 2), (700, 700, 1), (300, 4, 5)]):
        x = r.integers(-spread, spread + 1, (n, 6)).astype(np.float32) / 8
        vec_id = r.integers(0, ids, n) * 5
        df = spark.createDataFrame([(int(i), v) for i, v in zip(vec_id, x.tolist())], "vec_id long, embedding array<float>")
        got = sorted(map(tuple, covertree.top_k(df, df.where("vec_id % 20 = 0"), k=10).collect()))
        whole = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
        best = {}
        for q in np.flatnonzero(vec_id % 20 == 0):
            for i, s in zip(vec_id.tolist(), (whole @ whole[q]).tolist()):
                if i != vec_id[q]:
                    key = (int(vec_id[q]), i)
                    best[key] = max(best.get(key, s), s)
        want = []
        for q in sorted({q for q, _ in best}):
            order = sorted((-s, i) for (a, i), s in best.items() if a == q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
        assert got == want, seed


def test_cover_trees_prune_compact_data_and_stay_exact():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 8)) * 4000
    data = np.floor(centres[r.integers(0, 40, 6000)] + r.normal(size=(6000, 8)) * 30)
    queries = data[:200]
    found = covertree.dual_search(queries, np.arange(200), data, [np.array([i]) for i in range(6000)], 10)
    scores = queries @ data.T
    scores[np.arange(200), np.arange(200)] = -np.inf
    for i in range(200):
        assert found.id[i].tolist() == np.lexsort((np.arange(6000), -scores[i]))[:10].tolist()


def test_html_blocks_and_extraction():
    page = ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li>"
            "<a href=/x>Home</a></li></ul></nav><!-- c --><article><h1>Big &amp; title</h1><p><b>First   one.<br><p>Second"
            " &lt;one&gt; is a longer paragraph, with commas.</article><footer>&copy; me</footer></body></html>")
    found = htmltext.blocks(page)
    assert [b.text for b in found] == ["Home", "Big & title", "First one.", "Second <one> is a longer paragraph, with commas.",
                                       "© me"]
    import random
    r, texts = random.Random(1), [" ".join(WORDS[i:i + 60]) + "." for i in range(0, 300, 20)]
    crf = htmltext.train([htmltext.layout(r, texts) for _ in range(300)], iterations=60)
    pages = [htmltext.layout(r, texts) for _ in range(60)]
    wrong = sum(a != b for p, y in pages for a, b in zip(y, crf.viterbi(p), strict=True))
    assert wrong <= 0.03 * sum(len(y) for _, y in pages)
    assert htmltext.extract_text(crf, None) == "" == htmltext.extract_text(crf, "<p")
    assert htmltext.extract_text(crf, page).split("\n")[0] == "Big & title"


def test_html_viterbi_is_the_best_path():
    crf = htmltext.Crf({}, np.zeros(0), np.random.default_rng(0).normal(size=htmltext.TEXT_FEATURES),
                       np.array([[0.5, -1.0], [-0.7, 0.9]]), np.array([0.3, -0.2]))
    page = [htmltext.Block((), t, 0.0) for t in ("short", "a longer text, with commas.", "x", "more text here. " * 4)]
    emit = crf.emissions(page)

    def value(labels):
        return (sum(e for e, y in zip(emit, labels, strict=True) if y) + crf.ends[0] * labels[0] + crf.ends[1] * labels[-1]
                + sum(crf.trans[a][b] for a, b in itertools.pairwise(labels)))
    best = max(itertools.product((0, 1), repeat=4), key=value)
    assert tuple(map(int, crf.viterbi(page))) == best


def test_packing_loses_no_token(spark):
    import public_tokenizers
    texts = [*ODD, *[" ".join(WORDS[:n]) for n in range(1, 300, 13)]]
    lines = packing.pack(docs_of(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                         row_length=64, folder=(folder := warc.shared_path(spark, "packtest")))
    coder = packing.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {i: [] for i in range(len(texts))}
    for x in lines.orderBy("doc_id", "piece").collect():
        if x["length"]:
            ids = np.load(f"{folder}/{x['file']}.ids.npy")
            resets = np.load(f"{folder}/{x['file']}.resets.npy").tolist()
            assert [x["row"], x["column"]] in resets and x["column"] + x["length"] <= 64
            got[x["doc_id"]] += ids[x["row"], x["column"]:x["column"] + x["length"]].tolist()
    assert [got[i] for i in range(len(texts))] == [coder.encode_ordinary(t or "") for t in texts]


def test_best_fit_takes_the_least_room():
    r = np.random.default_rng(8)
    lengths = r.integers(1, 50, 300).tolist()
    row, column, rows = packing.best_fit_decreasing(lengths, 50)
    room = []
    want = {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        fits = [x for x in room if x >= lengths[i]]
        size = min(fits) if fits else 50
        if fits:
            room.remove(size)
        room.append(size - lengths[i])
        want[i] = 50 - size
    assert column == [want[i] for i in range(300)] and rows == len(room)


def test_license_families(spark):
    r = np.random.default_rng(9)
    plain = [" ".join(r.choice(WORDS, 12)) for _ in range(300)]
    scanner = license.train(plain, epochs=4)
    texts = ["intro\nReleased under the MIT License.\nend", "Licensed under CC BY-NC 4.0.\n\nLicensed under the Apache License, "
             "Version 2.0.", None, "", *plain[:5], "license to thrill"]
    rows = license.scan(docs_of(spark, texts), scanner).collect()
    assert [x["families"] for x in rows] == [["MIT"], ["Apache", "CC-BY-NC"], *[[]] * 8]
    assert rows[0]["paragraphs"] == [1] and rows[0]["n_paragraphs"] == 3 and rows[2]["n_paragraphs"] == 0


def test_license_wrapped_and_dual_notices(spark):
    import textwrap
    r = np.random.default_rng(9)
    plain = [" ".join(r.choice(WORDS, 12)) for _ in range(300)]
    scanner = license.train(plain, epochs=4)
    notices = [("BSD", license.TEMPLATES["BSD"][0] + ":"), ("GPL", license.TEMPLATES["GPL"][1] + ", either version 3 of the License."),
               ("LGPL", license.TEMPLATES["LGPL"][0]), ("MIT", license.TEMPLATES["MIT"][1] + " (the Software)")]
    texts = ["\n".join([plain[0], *textwrap.wrap(t, width), plain[1]]) for _, t in notices for width in (40, 70)]
    texts += ["Licensed under the Apache License, Version 2.0 or the MIT license.", "SPDX-License-Identifier: MIT OR Apache-2.0",
              "\n".join(plain), "Redistribution and use in source\n\nand binary forms, with or\n\nwithout modification, are"]
    rows = license.scan(docs_of(spark, texts), scanner).collect()
    want = [[f] for f, _ in notices for _ in (40, 70)] + [["Apache", "MIT"]] * 2 + [[], []]
    assert [x["families"] for x in rows] == want
    assert all(1 <= n < x["n_paragraphs"] - 1 for x in rows[:8] for n in x["paragraphs"])  # a notice may have two runs


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P
    from conftest import SF_SMALL
    assert [n for n, _ in P.STAGES] == ["language", "quality", "duplicates", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = docs.limit(3).union(spark.createDataFrame([(None, None, None, None, None), (10**9, "", None, None, 0)], docs.schema))
    docs = docs.union(extra)
    kept = P.duplicate_stage(spark, docs, SF_SMALL)
    texts = {x["doc_id"]: x["text"] for x in docs.where("doc_id is not null").collect()}
    ids = sorted(texts)
    _, label = brute_components([texts[i] for i in ids])
    got = sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None)
    assert kept.columns == docs.columns and got == [i for n, i in enumerate(ids) if label[n] == n]
    lang = P.language_stage(spark, docs, SF_SMALL)
    assert lang.where("text is null or text = ''").count() == 0 and lang.count() > 150
    clean = P.decontamination_stage(spark, docs, SF_SMALL)
    assert clean.columns == docs.columns and clean.count() < docs.count()
    tokens = P.token_stage(spark, docs.limit(5), SF_SMALL)
    assert tokens.columns == ["doc_id", "n_tokens", "ids"]


@pytest.mark.parametrize("name", ["op7_decontaminate"])
def test_query_matches_oracle(spark, name):
    from conftest import SF_SMALL
    from oracle import compare, duck
    from workrisk.llm.queries import QUERIES, SQL
    ok, message = compare(QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), SQL[name], check_types=True)
    assert ok, message


def test_digest_columns(spark):
    from conftest import SF_SMALL
    from workrisk.llm.queries import QUERIES
    row = QUERIES["op2_bpe"](spark, SF_SMALL).where(F.col("n_tokens") > 0).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where(F.col("doc_id") == row["doc_id"]).first()["text"]
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
