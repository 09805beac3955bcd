"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workrisk.session import ensure_checkpoint_dir, settings

# Ids of at most this many rows (8 bytes each) may be broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000
BATCH_BYTES = 4 << 20  # input that a function of ``append_columns`` gets at a time, about


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{kind}-{uuid.uuid4().hex}")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, keeps columns prunable and
    survives the loss of executors. The shuffles of the job go with it, as nothing reads them
    again; else they stay on the disks until the driver happens to collect its garbage."""
    path = shared_path(df.sparkSession, kind)
    with settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict[Any, Any] = {}


def held(key, make: Callable[[], Any]) -> Any:
    """The one large object that a worker process keeps for its next tasks; another one takes its place."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's call that gives freed memory back to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def release_memory() -> None:
    """Give back what earlier work of a reused worker process has freed but kept."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable:
    """``run`` for ``mapInArrow``; a task begins and ends without memory that its worker no longer uses.

    Without ``keep`` the object that an earlier operator holds in the process goes too."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            _held.clear()
        release_memory()
        yield from run(batches)
        release_memory()

    return task


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField],
                   fn: Callable[[list[pa.Array]], list[pa.Array]], done: Callable[[], None] | None = None,
                   keep: bool = False) -> DataFrame:
    """Add columns that ``fn`` computes from the ``inputs`` of an Arrow batch; ``done`` runs when a task ends.
    ``keep``: ``fn`` uses a ``held`` object.

    Every other column passes through unchanged. A column of ``df`` that has the
    name of an added one is replaced, as ``withColumn`` does. ``fn`` gets runs of whole
    rows of about ``BATCH_BYTES`` of input, so its memory follows that and the longest row,
    not the number of rows in a batch."""
    added = {f.name for f in fields}
    rest = [c for c in df.columns if c not in added]
    base = df.select([F.col(f"`{c}`") for c in rest])
    where = [rest.index(c) for c in inputs]
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.ones(batch.num_rows, dtype=np.int64)
            for i in where:
                if pa.types.is_boolean(batch.column(i).type):
                    continue
                size += pc.binary_length(batch.column(i)).fill_null(0).to_numpy(zero_copy_only=False)
            for start, end in pieces(np.concatenate([[0], np.cumsum(size)]), BATCH_BYTES):
                part = batch.slice(start, end - start)
                new = fn([part.column(i) for i in where])
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)
        if done is not None:
            done()

    return base.mapInArrow(lean(run, keep), schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat UTF-8 bytes of a string column and the offsets of its rows (null: empty)."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes, one row at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def fold_of(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``rows`` rows chosen by a hash of the key (all, if there are fewer).

    A first cut by the hash leaves about twice as many, so that not every partition sends
    its own share to the driver."""
    share = min(1.0, 2 * (rows + 50) / max(df.count(), 1))
    hashed = df.withColumn("_hash", F.xxhash64(key)).where(F.pmod("_hash", F.lit(1 << 40)) < int(share * (1 << 40)))
    return hashed.orderBy("_hash", key).limit(rows).drop("_hash")


def with_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of ``df`` with a written table of ids.

    The ids are broadcast after a check of their number; beyond it both sides shuffle."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash (wraps modulo 2**64)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Remembered:
    """Encoded words of a process, in two generations of half the bytes each.

    A full generation becomes the old one in place of the one before it, and a word of the old one that
    is met again joins the new one. So the words in use stay, whatever else passes through."""

    def __init__(self, cache_bytes: int, entry: int, longest: int):
        self.cache_bytes, self.entry, self.longest_kept = cache_bytes, entry, longest
        self.forget()

    def forget(self) -> None:
        """Empty the cache of words."""
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cached = 0  # bytes in the new generation, about

    def unmet(self, cut: list[list[str]]) -> list[str]:
        """The words that no generation holds; those of the old one join the new one."""
        if self.cached > self.cache_bytes // 2:
            self.old, self.cache, self.cached = self.cache, {}, 0
        cache, old, fresh = self.cache, self.old, []
        for word in set().union(*cut).difference(cache):
            if (ids := old.get(word)) is None:
                fresh.append(word)
            else:
                cache[word] = ids
                self.cached += self.entry + len(word) + len(ids)
        return fresh

    def keep(self, fresh: list[str]) -> None:
        """Count the words that are new in the cache; the longest are not kept."""
        for word in fresh:
            if len(word) > self.longest_kept:
                del self.cache[word]
            else:
                self.cached += self.entry + len(word) + len(self.cache[word])


_WORD_BYTE = np.zeros(256, dtype=np.uint8)  # ASCII letters in lower case, all digits as 0, non-ASCII bytes; else 0
_WORD_BYTE[128:] = np.arange(128, 256)
_WORD_BYTE[97:123] = np.arange(97, 123)
_WORD_BYTE[65:91] = np.arange(97, 123)
_WORD_BYTE[48:58] = 48
_POWER = 0x9E3779B97F4A7C15 | 1


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, digits and non-ASCII bytes) of each row, and the row of each."""
    low = _WORD_BYTE[flat]
    inside = low > 0
    starts, ends = inside.copy(), inside.copy()
    cut = np.zeros(len(low) + 1, dtype=bool)
    cut[offsets] = True
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    # a polynomial modulo 2**64 summed up to each byte; the difference is shifted back by the inverse power
    power = np.ones(len(low) + 1, dtype=np.uint64)
    power[1:] = np.uint64(_POWER)
    np.multiply.accumulate(power, out=power)
    back = np.ones(len(low) + 1, dtype=np.uint64)
    back[1:] = np.uint64(pow(_POWER, -1, 1 << 64))
    np.multiply.accumulate(back, out=back)
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(mix64(low.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix64((total[last] - total[first]) * back[first]), np.searchsorted(offsets, first, side="right") - 1
