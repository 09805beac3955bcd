"""Language identification by language-bitmask n-gram filters (operator 9).

One bit-sliced Bloom filter holds the byte n-grams of all languages: a slot is a bit
mask with one bit per language, and the AND of an n-gram's slots is the mask of all
languages that contain it. The popcount of a language over a text's n-grams, corrected
for the filter's false positives in that language's slice, estimates how many of the
n-grams the language really contains; the highest estimate decides.

Texts are lower-cased in ASCII; bytes that are no letters become spaces, a text has a
space before and after it, and n-grams hold at most one space next to another character,
so digits and punctuation carry no weight. Words of one or two bytes with their spaces are
learned as well; they decide where a text has no n-gram of full length.

Defined results: null text, empty text and text without a letter give ``und`` with
score 0; equal estimates go to the alphabetically smaller language (with score 0, if no
n-gram is known in any); without any labelled text every row is ``und``. Null ids are as
good as others; columns of the input keep their values, but for one that has the name of an
added column. Rows are never dropped or repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, free_name, lean, mix64, pieces, text_bytes

UNKNOWN = "und"
ORDER = 5          # bytes in an n-gram
SLOTS = 1 << 20    # slots of the filter, each with a bit per language
HASHES = 2
SAMPLE_PER_LANGUAGE = 1500   # labelled documents learned from, per language, about
MIN_SHARE = 0.004  # an n-gram belongs to a language if at least this share of its texts has it
LETTER = "\\p{L}"

# Byte -> byte of the normalised text: lower-case ASCII letters and all non-ASCII bytes stay.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def ngrams(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and short words (uint64, packed bytes) of the rows of a flat byte buffer, and the row of each."""
    rows = len(offsets) - 1
    start = offsets + 2 * np.arange(rows + 1)  # a space before and after each row; two spaces in a row part the rows
    text = np.full(start[-1] + ORDER, 32, dtype=np.uint8)
    text[np.arange(len(flat)) + 1 + 2 * np.repeat(np.arange(rows), np.diff(offsets))] = _FOLD[flat]
    n = len(text) - ORDER + 1
    space = text == 32
    double = space[:-1] & space[1:]  # at its first space
    valid = ~double[:n]
    for i in range(1, ORDER - 1):
        valid &= ~double[i:n + i]
    grams, places = [], []
    opens = space[:n] & ~space[1:n + 1]  # before the first byte of a word
    for size, use in ((ORDER, valid), (3, opens & space[2:n + 2]), (4, opens & ~space[2:n + 2] & space[3:n + 3])):
        at = np.flatnonzero(use)
        gram = np.zeros(len(at), dtype=np.uint64)
        for i in range(size):
            gram = gram << np.uint64(8) | text[at + i]
        grams.append(gram)
        places.append(at)
    return np.concatenate(grams), np.searchsorted(start, np.concatenate(places), side="right") - 1


def deciding(gram: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of full length; short words only of rows that have none."""
    full = gram >= np.uint64(1 << 8 * (ORDER - 1))
    has = np.zeros(rows, dtype=bool)
    has[row[full]] = True
    keep = full | ~has[row]
    return gram[keep], row[keep]


def slots(gram: np.ndarray, size: int = SLOTS) -> list[np.ndarray]:
    mixed = mix64(gram + np.uint64(1))
    return [((mixed >> np.uint64(32 * i)) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class LanguageFilter:
    """The bit-sliced filter and each language's rate of false positives."""

    languages: list[str]
    masks: np.ndarray  # words of a mask x slots: one word up to 64 languages
    false_rate: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], size: int = SLOTS) -> LanguageFilter:
        languages = sorted(grams)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64)
                    if min(len(languages), 64) <= 8 * k().itemsize)
        masks = np.zeros((max(1, -(-len(languages) // 64)), size), dtype=kind)
        fill = np.zeros(len(languages))
        for i, lang in enumerate(languages):
            bit = kind(1 << i % 64)
            for s in slots(grams[lang], size):
                np.bitwise_or.at(masks[i // 64], s, bit)
            fill[i] = np.count_nonzero(masks[i // 64] & bit) / size
        return cls(languages, masks, fill ** HASHES)

    def estimates(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each row's n-grams in each language; and the n-grams of each row."""
        rows = len(offsets) - 1
        share = np.zeros((rows, len(self.languages)))
        total = np.zeros(rows)
        for a, b in pieces(offsets):
            gram, row = deciding(*ngrams(flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]), b - a)
            if not len(gram):
                continue
            at = slots(gram, self.masks.shape[1])
            total[a:b] = np.bincount(row, minlength=b - a)
            for word, found in enumerate(self.masks):
                mask = np.bitwise_and.reduce([found[s] for s in at])
                for i in range(64 * word, min(64 * (word + 1), len(self.languages))):
                    bit = (mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
                    share[a:b, i] = np.bincount(row, weights=bit, minlength=b - a)
        share /= np.maximum(total, 1)[:, None]
        return np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1), total


def sample_by_language(labelled: DataFrame, id_col: str, lang_col: str, per_language: int) -> DataFrame:
    """About ``per_language`` documents of each language, chosen by a hash of the id."""
    counts = labelled.groupBy(lang_col).agg(F.count("*").alias("_n")).collect()  # a row per language
    keep = F.lit(False)
    for row in counts:
        limit = int(min(1.0, per_language / row["_n"]) * (1 << 30))
        keep = keep | ((F.col(lang_col) == F.lit(row[lang_col])) & (F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < limit))
    return labelled.where(keep)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageFilter:
    """Learn the filter from rows with text and language.

    Learns from a bounded sample: about ``per_language`` documents of each language.
    The n-grams are counted by Spark; only those that enough documents have come back."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = sample_by_language(rows, id_col, lang_col, per_language)

    def count(batches):
        for batch in batches:
            flat, offsets = text_bytes(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            gram, row = ngrams(flat, offsets)
            bits = np.uint64(8 * ORDER)  # an n-gram counts once for each text
            pairs = np.unique(row.astype(np.uint64) << bits | gram)
            lang_of = langs[(pairs >> bits).astype(np.int64)]
            for lang in set(langs):
                own, n = np.unique(pairs[lang_of == lang] & ((np.uint64(1) << bits) - np.uint64(1)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(own) + 1), pa.string()), pa.array([*own.astype(np.int64), None], pa.int64()),
                     pa.array([*n.astype(np.int64), int((langs == lang).sum())], pa.int64())], ["lang", "gram", "n"])

    counted = (sample.select(F.col(text_col), F.col(lang_col)).mapInArrow(lean(count), "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    texts = F.max(F.when(F.col("gram").isNull(), F.col("n")))
    total = counted.groupBy("lang").agg(texts.alias("texts"))
    kept = (counted.join(F.broadcast(total), "lang")  # a row per language
            .where(F.col("gram").isNotNull() & (F.col("n") >= F.greatest(F.least(F.lit(2), F.col("texts")), F.col("texts") * MIN_SHARE)))
            .groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect())
    return LanguageFilter.build({r["lang"]: np.array(r["grams"], dtype=np.int64).astype(np.uint64) for r in kept})


def predict(df: DataFrame, model: LanguageFilter, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """Append the predicted language and a score from 0 to 1.

    The score is the winner's corrected share less half of the runner-up's."""
    bc = df.sparkSession.sparkContext.broadcast(model)  # SLOTS masks: a fixed size
    letter = free_name(df, "_has_letter")

    def run(columns):
        m = bc.value
        flat, offsets = text_bytes(columns[0])
        has = np.array(columns[1].fill_null(False).to_pylist(), dtype=bool)
        rows = len(has)
        if not m.languages:
            return [pa.array([UNKNOWN] * rows, pa.string()), pa.array(np.zeros(rows))]
        share, _ = m.estimates(flat, offsets)
        best = share.argmax(axis=1) if rows else np.zeros(0, int)
        top = np.sort(share, axis=1)
        second = top[:, -2] if share.shape[1] > 1 else np.zeros(rows)
        score = np.where(has, np.clip(top[:, -1] - second / 2, 0, 1), 0.0)
        names = np.array(m.languages, dtype=object)
        return [pa.array(np.where(has, names[best], UNKNOWN).tolist(), pa.string()), pa.array(score)]

    flagged = df.withColumn(letter, F.col(text_col).rlike(LETTER))
    return append_columns(flagged, [text_col, letter], [T.StructField(lang_out, T.StringType()),
                                                        T.StructField(score_out, T.DoubleType())], run).drop(letter)
