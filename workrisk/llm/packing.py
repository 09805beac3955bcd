"""Packed token ids in binary files (operator 1).

Every task turns its documents into token ids, cuts documents longer than a row into
pieces without losing a token, and packs the pieces into rows by best-fit-decreasing: the
longest piece first, each into the row with the least room that still holds it. A segment
tree over the capacities 0..row length finds that room in logarithmic time. Pieces are
packed in groups of about ``GROUP_TOKENS`` tokens, so memory does not grow with the table
and no token is shuffled.

A group becomes three files in a folder that all executors share: ``ids`` (the packed
matrix, 16 bits an id if the vocabulary allows), ``cu_seqlens`` (cumulative lengths of the
segments, row by row, padding left out) and ``resets`` (row and column of every segment
start, where position ids begin anew). They are NumPy files written under temporary names
and renamed; a repeated task writes the same files again.

Defined results: a null or empty text has no tokens: one line with length 0 and no file;
a null id keeps its row, with a null id; repeated rows are packed each; ties between equal
lengths keep the order of the rows; an empty table writes nothing. Only the id and the text of
a row are read, so other columns may have any name. Runs of white space beyond ``SPACE_RUN``
characters are cut there before they are encoded (the library fails on very long ones); no
character is lost.
"""

from __future__ import annotations

import base64
import io
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written
from .warc import store_of

ROW_LENGTH = 2048
GROUP_TOKENS = 4 << 20
PAD_ID = 0
SPACE_RUN = 4096  # characters of white space that the tokenizer library gets at once
_LONG_RUN = re.compile(rf"\s{{{SPACE_RUN}}}(?=\s)")


class RoomTree:
    """Segment tree over capacities: the smallest one of at least a given size that some row has left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) with the least room of ``least`` or more; it leaves the tree."""
        count, node = self.count, self.size + least
        if not count[node]:
            # up to the first ancestor that has rows to the right, then down to the leftmost
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Row and column of each piece, and the number of rows."""
    row, column = [0] * len(lengths), [0] * len(lengths)
    tree, rows = RoomTree(capacity), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i]) if lengths[i] < capacity else None
        if found is None:
            found, rows = (capacity, rows), rows + 1
        room, row[i] = found
        column[i] = capacity - room
        if room > lengths[i]:
            tree.add(room - lengths[i], row[i])
    return row, column, rows


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """A tiktoken encoding from a file of ranks."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut_runs(text: str) -> Iterator[str]:
    """The text in pieces, cut after every ``SPACE_RUN`` characters of a longer run of white space."""
    start = 0
    for m in _LONG_RUN.finditer(text):
        yield text[start:m.end()]
        start = m.end()
    yield text[start:]


def save(fs, base: str, name: str, array: np.ndarray) -> None:
    data = io.BytesIO()
    np.save(data, array)
    temporary = f"{base}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(data.getvalue())
    fs.move(temporary, f"{base}/{name}.npy")


def pack_group(doc_ids: list, tokens: list[np.ndarray], capacity: int, dtype) -> tuple:
    """(lines, matrix, cumulative lengths, resets) of one group of documents."""
    lines, parts = [], []
    for doc_id, ids in zip(doc_ids, tokens, strict=True):
        for piece, start in enumerate(range(0, max(len(ids), 1), capacity)):
            lines.append([doc_id, piece, start])
            parts.append(ids[start:start + capacity])
    used = [i for i, p in enumerate(parts) if len(p)]
    row, column, rows = best_fit_decreasing([len(parts[i]) for i in used], capacity)
    matrix = np.full((rows, capacity), PAD_ID, dtype=dtype)
    place: list = [(None, None)] * len(parts)
    for i, r, c in zip(used, row, column, strict=True):
        matrix[r, c:c + len(parts[i])] = parts[i]
        place[i] = (r, c)
    order = sorted(range(len(used)), key=lambda i: (row[i], column[i]))
    lengths = [len(parts[used[i]]) for i in order]
    resets = np.array([(row[i], column[i]) for i in order], dtype=np.int32).reshape(-1, 2)
    out = [(*line, len(p), *at) for line, p, at in zip(lines, parts, place, strict=True)]
    return out, matrix, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), resets


def pack(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
         row_length: int = ROW_LENGTH, folder: str | None = None) -> DataFrame:
    """Write the packed files; one line per piece: doc_id, piece, start, length, file, row, column.

    ``start`` is the piece's first token in its document; ``file`` the common name of its
    group's files below ``folder`` (null for a document without tokens)."""
    folder = folder or shared_path(df.sparkSession, "packed")
    names = ["doc_id", "piece", "start", "length", "file", "row", "column"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def run(batches):
        enc = encoding(path, pattern)
        dtype = np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32
        fs, base = store_of(folder)
        fs.create_dir(base, recursive=True)
        part, number, ids, tokens, size = TaskContext.get().partitionId(), 0, [], [], 0

        def finish():
            name = f"part-{part:06d}-{number:05d}"
            lines, matrix, lengths, resets = pack_group(ids, tokens, row_length, dtype)
            for kind, array in (("ids", matrix), ("cu_seqlens", lengths), ("resets", resets)):
                save(fs, base, f"{name}.{kind}", array)
            lines = [(d, p, s, n, name if n else None, r, c) for d, p, s, n, r, c in lines]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), types, strict=True)],
                                              names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                tokens.append(np.concatenate([np.array(enc.encode_ordinary(t), dtype=dtype) for t in cut_runs(text or "")]))
                size += len(tokens[-1]) + 1
                if size >= GROUP_TOKENS:
                    yield finish()
                    ids, tokens, size, number = [], [], 0, number + 1
        if ids:
            yield finish()

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # written: the files are complete before anything reads the lines
    return written(docs.mapInArrow(run, "doc_id long, piece int, start long, length int, file string, row int, column int"),
                   "pieces")
