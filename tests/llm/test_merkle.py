"""Operator 13 against a plain recomputation of trees, proofs and tampering."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from workrisk.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, `group` string, part int"


def digest(*values):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def fold_up(nodes):
    """Root of the nodes and, for each, the siblings and the side lists up to the root."""
    ways = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, below = [], []
        for start in range(0, len(nodes), 16):
            run = nodes[start:start + 16]
            for k in range(len(run)):
                for i in under[start + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(sha256("".join(run).encode()).hexdigest())
            below.append([i for k in range(len(run)) for i in under[start + k]])
        nodes, under = above, below
    return nodes[0], ways


def brute(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = digest(doc_id, source, lang, n, text)
        claimed = leaf
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            claimed = digest(doc_id, source, lang, n, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, claimed, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [fold_up([x[2] for x in sorted(groups[s])]) for s in names]
    root, tops = fold_up([t[0] for t in trees])
    out = []
    for name, (subroot, ways), top in zip(names, trees, tops, strict=True):
        for (_, _, leaf, claimed, doc_id), way in zip(sorted(groups[name]), ways, strict=True):
            folded = claimed
            for left, right in way + top:
                folded = sha256((left + folded + right).encode()).hexdigest()
            proof = sha256("".join(a + b for a, b in way + top).encode()).hexdigest()
            out.append((doc_id, leaf, subroot, root, proof, folded, folded == root))
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", "z", 7) for r in rows], DOCS)
    found = merkle.manifest(docs, tampered={"text": merkle.lower_ascii(F.col("text"))},
                            where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return [tuple(x) for x in found.collect()]


def sample(n, sources, seed=0):
    r = np.random.default_rng(seed)
    ids = r.permutation(n * 3)[:n]
    return [(int(i), f"Text {i} ÄÖ", "en", str(r.choice(sources)), int(i) % 50) for i in ids]


ODD = [(1, None, "en", "a", 3), (2, "", None, None, None), (None, "No id", "de", "a", 5), (None, None, None, None, None),
       (3, "Same", "en", "a", 4), (3, "Same", "en", "a", 4), (3, "Other", "en", "a", 5), (4, "LONG " * 40_000, "en", "ü", 9),
       (5, "x", "en", "", 1), (6, "Y", "en", "Z", 1)]


@pytest.mark.parametrize("part", [7, 32_768])
@pytest.mark.parametrize("rows", [ODD, ODD[:1], sample(900, ["s"]), sample(700, [*("hot",) * 5, *map(str, range(60))], 1) + ODD],
                         ids=["odd", "one", "hot", "many"])
def test_manifest_equals_brute_force(spark, monkeypatch, part, rows):
    monkeypatch.setattr(merkle, "PART_LEAVES", part)
    if part < 50 and len(rows) > 800:
        rows = rows[:300]
    assert sorted(run(spark, rows), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("total", [1, 2, 16, 17, 256, 257, 5000])
def test_missing_nodes_are_minimal_and_enough(total):
    r = np.random.default_rng(total)
    for _ in range(10):
        own = np.unique(r.integers(0, total, r.integers(1, 40)))
        missing = [(level, int(i)) for level, found in merkle.missing_nodes(own, total) for i in found]
        below = lambda level, i: set(range(i * 16 ** level, min((i + 1) * 16 ** level, total)))
        covered = [x for level, i in missing for x in below(level, i)] + own.tolist()
        assert sorted(covered) == list(range(total))  # each leaf below one fetched node or own: nothing twice, nothing left
        digests = [str(i) for i in range(total)]
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([merkle.sha256("".join(levels[-1][k:k + 16])) for k in range(0, len(levels[-1]), 16)])
        tree = merkle.PartialTree(own, [digests[i] for i in own], total, {(k, i): levels[k][i] for k, i in missing})
        assert tree.root == levels[-1][0]
        assert all(tree.fold(int(i), digests[i]) == tree.root and tree.fold(int(i), "x") != tree.root or total == 1 for i in own)
