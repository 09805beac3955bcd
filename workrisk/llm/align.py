"""Alignment of the tokens of two tokenizers (operator 12).

Every text is encoded by a byte-level BPE (A, the text after a space) and by a piece model (B, which puts
the space itself), so the bytes of both sides are the same and token ranges can be compared. The work on
the tokens runs in units of some MB of texts: a backward ``merge_asof`` from the token starts of A, keyed
by document, finds the covering token of B and the same from B the one of A. The union of both directions
holds all overlapping pairs; where a pair ends at the same byte it is a link, and the links cut the tokens
into groups.

Counts of linked id pairs over the corpus: each unit sends its distinct pairs with their numbers once.
Spark sums them, marks those that are the highest of their B id, and sends the results back to the
units that asked, so the counts are never in one place and a frequent pair is sent once a unit.

Defined results: special tokens' strings are plain text; a text that is null, empty, or of which a side's
joined bytes differ from the space and the text (it holds U+2581, say) has no tokens: all numbers are 0
and ``groups_sha256`` is empty; rows that repeat an id are documents of their own, null ids are kept; of
two equal counts of a B id both are the highest; an empty table gives an empty table. Only the id and the
text are read, so further columns of any name have no effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ByteBPE
from .common import pieces, text_bytes, written
from .piecebpe import SPACE, PieceBPE

UNIT_BYTES = 2 << 20  # of texts in a unit, about
CACHE_BYTES, WORD_BYTES = 64 << 20, 44 << 20  # of the encoders of B and A
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")


class Pair:
    """The two encoders of a process, with the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteBPE(byte_path, WORD_BYTES), PieceBPE(piece_path, CACHE_BYTES)
        self.a.special, self.a.special_split = {}, None  # their strings are plain text here
        self.sizes = [np.array([len(x) for x in side.token_bytes], np.int64) for side in (self.a, self.b)]
        self.names = [names(len(self.a.token_bytes), b",|"), names(len(self.b.token_bytes), b",;")]
        self.widths = [np.char.str_len(x[:, 0]).astype(np.int32) for x in self.names]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none where a side's bytes are not those of the space and the text."""
        both: tuple[list, list] = ([], [])
        spaced = [" " + t for t in texts]
        coded = zip(texts, spaced, self.a.encode_batch(spaced), self.b.encode_batch(texts, ends=False), strict=True)
        for text, whole, *sides in coded:
            ids = [np.frombuffer(x, "<u4") for x in sides]
            if not text or not self.same_bytes(whole, ids):
                ids = [x[:0] for x in ids]
            for out, x in zip(both, ids, strict=True):
                out.append(x)
        return both

    def same_bytes(self, whole: str, ids: list[np.ndarray]) -> bool:
        """Whether the tokens' bytes of both sides join to those of the text.

        Both encoders only cut a text, but for characters that stand for others (U+2581 for a space)
        and unknown ids, so elsewhere the number of bytes tells; there the bytes are compared."""
        raw = whole.encode()
        if any(s[x].sum() != len(raw) for s, x in zip(self.sizes, ids, strict=True)):
            return False
        if SPACE not in whole and (ids[1] != self.b.unknown).all():
            return True
        return all(b"".join(map(s.token_bytes.__getitem__, x.tolist())) == raw for s, x in zip((self.a, self.b), ids, strict=True))


def names(size: int, marks: bytes) -> np.ndarray:
    """The decimal names of ids, each with either mark behind it."""
    return np.array([[str(i).encode() + bytes([m]) for m in marks] for i in range(size)])


@lru_cache(maxsize=1)
def encoders(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


class Tokens:
    """The tokens of a unit's documents in turn: doc, id, start and end, in bytes from the unit's start."""

    def __init__(self, ids: list[np.ndarray], sizes: np.ndarray):
        self.doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        self.id = np.concatenate([*ids, np.zeros(0, "<u4")])
        self.end = np.cumsum(sizes[self.id])
        self.start = self.end - sizes[self.id]

    def __len__(self) -> int:
        return len(self.id)

    def frame(self, row: str) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "start": self.start, row: np.arange(len(self), dtype=np.int32)}, copy=False)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs of tokens that overlap: each start's covering token of the other side, in both directions."""
    left, right = a.frame("a"), b.frame("b")
    forth = pd.merge_asof(left, right, on="start", by="doc")["b"].to_numpy()
    back = pd.merge_asof(right, left, on="start", by="doc")["a"].to_numpy()
    new = a.start[back] != b.start  # a pair that starts together is found both ways
    return np.append(left["a"].to_numpy(), back[new]), np.append(forth, right["b"].to_numpy()[new])


def groups_text(a: Tokens, b: Tokens, link_a: np.ndarray, link_b: np.ndarray, pair: Pair) -> tuple[bytes, np.ndarray, np.ndarray]:
    """``a1,a2|b1;...`` of all documents in turn, and the length of each token's part, for A and for B."""
    last_a, last_b = np.zeros(len(a), np.int8), np.zeros(len(b), np.int8)
    last_a[link_a], last_b[link_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    place_a = np.arange(len(a)) + np.append(0, link_b + 1)[group_a]  # behind the B tokens of earlier groups
    place_b = np.arange(len(b)) + (link_a + 1)[group_b]
    text = np.zeros(len(a) + len(b), dtype=max(x.dtype for x in pair.names))
    text[place_a], text[place_b] = pair.names[0][a.id, last_a], pair.names[1][b.id, last_b]
    return text.tobytes().translate(None, b"\0"), pair.widths[0][a.id], pair.widths[1][b.id]


def align_unit(pair: Pair, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, list[bytes], np.ndarray]:
    """Numbers and digest of each document, distinct linked id pairs (sorted), the documents' links as places among
    these, and how many links each pair has."""
    n, (ids_a, ids_b) = len(texts), pair.encode(texts)
    a, b = Tokens(ids_a, pair.sizes[0]), Tokens(ids_b, pair.sizes[1])
    row_a, row_b = overlaps(a, b)
    together = a.end[row_a] == b.end[row_b]
    link_a, link_b = np.sort(row_a[together]), np.sort(row_b[together])  # in both sides' order
    count = lambda docs, weights=None: np.bincount(docs, weights, n).astype(np.int64)
    per_link = count(a.doc[link_a])
    numbers = {"n_a": count(a.doc), "n_b": count(b.doc), "n_groups": per_link, "n_links": per_link,
               "n_overlaps": count(a.doc[row_a])}
    text, width_a, width_b = groups_text(a, b, link_a, link_b, pair)
    ends = np.cumsum(count(a.doc, width_a) + count(b.doc, width_b)).tolist()
    digests = [hashlib.sha256(text[s:e - 1]).hexdigest() if e > s else "" for s, e in zip([0, *ends[:-1]], ends, strict=True)]
    place, keys = pd.factorize(a.id[link_a].astype(np.int64) << 32 | b.id[link_b])
    order = np.argsort(keys)
    keys, times = keys[order], np.bincount(place, minlength=len(keys))[order]
    place = np.argsort(order).astype("<u4")[place]
    return numbers, digests, keys, [x.tobytes() for x in np.split(place, np.cumsum(per_link)[:-1])], times


UNITS = T.StructType([
    T.StructField("unit", T.LongType()), *(T.StructField(c, T.LongType()) for c in NUMBERS),
    T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType()),
    T.StructField("pairs", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("times", T.LongType())])))])


def aligned_units(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``docs`` (doc_id, text) aligned: a row for each document and, in each unit, one more with its distinct pairs."""
    schema = T.StructType([docs.schema["doc_id"], *UNITS.fields])
    pair_type = pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        pair, unit = encoders(byte_path, piece_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for start, end in pieces(offsets, UNIT_BYTES):
                part = batch.slice(start, end - start)
                texts = [t or "" for t in part.column(1).to_pylist()]
                numbers, digests, keys, links, times = align_unit(pair, texts)
                n = len(texts)
                own = [pa.array(np.full(n, unit)), *(pa.array(numbers[c]) for c in NUMBERS), pa.array(digests, pa.string()),
                       pa.array(links, pa.binary()), pa.nulls(n, pair_type)]
                yield pa.RecordBatch.from_arrays([part.column(0), *own], names=schema.names)
                found = pa.ListArray.from_arrays([0, len(keys)], pa.StructArray.from_arrays([keys, times], ["key", "times"]))
                rest = [pa.nulls(1, x.type) for x in own[1:-1]]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, part.column(0).type), pa.array([unit]), *rest,
                                                  found.cast(pair_type)], names=schema.names)
                unit += 1

    return docs.mapInArrow(run, schema)


def pair_counts(units: DataFrame) -> DataFrame:
    """Links of each id pair in the corpus: key (A id, B id below), count, and whether it is the B id's highest."""
    sums = written(units.where("pairs is not null").select(F.inline("pairs")).groupBy("key").agg(F.sum("times").alias("count")), "pairs")
    sums = sums.withColumn("b", F.col("key").bitwiseAND(0xFFFFFFFF))
    best = sums.groupBy("b").agg(F.max("count").alias("most"))  # at most one row for each id of B's vocabulary
    return sums.join(F.broadcast(best), "b").select("key", "count", (F.col("count") == F.col("most")).alias("best"))


def sums_of_unit(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """``n_best`` and ``count_sum`` of a unit's documents."""
    encoders.cache_clear()  # the process has no more texts to encode
    counts = counts.sort_by("key")
    count, best = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    n_best, total = [], []
    for links in docs.column("links").to_pylist():
        place = np.frombuffer(links, "<u4")
        n_best.append(int(best[place].sum()))
        total.append(int(count[place].sum()))
    docs = docs.drop_columns(["unit", "links"])
    return docs.append_column("n_best", [n_best]).append_column("count_sum", [pa.array(total, pa.int64())])


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token alignment of every text: id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best, count_sum."""
    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    units = written(aligned_units(chosen, byte_path, piece_path), "units")
    asked = units.where("pairs is not null").select(F.col("unit").alias("asker"), F.inline("pairs")).drop("times")
    answers = asked.join(pair_counts(units), "key").select("asker", "key", "count", "best")
    rows = units.where("pairs is null").drop("pairs")
    schema = T.StructType([*rows.drop("unit", "links").schema.fields, T.StructField("n_best", T.LongType()),
                           T.StructField("count_sum", T.LongType())])
    found = rows.groupBy("unit").cogroup(answers.groupBy("asker")).applyInArrow(sums_of_unit, schema)
    return found.withColumnRenamed("doc_id", id_col)
