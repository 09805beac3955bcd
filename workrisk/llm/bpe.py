"""Byte-level BPE encoding and decoding (operator 2).

The vocabulary and merge ranks come from a public tokenizer file whose path is a
parameter. A pre-token is encoded with a segment tree over the ranks of adjacent
pairs: every leaf holds (rank, position) of one pair, the root therefore yields the
leftmost pair of lowest rank, and a merge changes three leaves, each updated in
logarithmic time, until no mergeable pair remains. Encoded pre-tokens are kept in a
bounded per-process cache.

Defined results: a null text is encoded like an empty one (no ids); decoding null or
empty ids gives the empty string; ids outside the vocabulary are skipped, as the
public library does; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Remembered, append_columns, held

# White space, the alternatives of the public split pattern, the letters and
# numbers that Unicode 16 added to this Python's tables, and the printable stand-ins of bytes.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = r" ?[{L}]+|'(?:[stmd]|re|ve|ll)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
               (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
               (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
               (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
               (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
               (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Texts below this code point use a pattern of a few ranges, which matches faster.
SIMPLE = 0x530
# Leaves of the trees that are worked on many words at a time.
LEAVES = (8, 16, 32)
CACHE_BYTES = 16 << 20  # words and ids that a tokenizer remembers, about
LONGEST_CACHED = 64
ENTRY = 200  # bytes of a remembered word besides its own and those of its ids
NONE = 1 << 62
SHIFT = 32


def char_class(kind: str, extra: list[tuple[int, int]], below: int) -> str:
    """Ranges of the code points of a general category, as the inside of a character class."""
    members = [c for c in range(below) if unicodedata.category(chr(c))[0] == kind]
    members = sorted({*members, *(c for a, b in extra for c in range(a, b + 1) if c < below)})
    ends = [i for i, c in enumerate(members) if i + 1 == len(members) or members[i + 1] != c + 1]
    starts = [0, *(i + 1 for i in ends[:-1])]
    return "".join(f"\\U{members[i]:08x}-\\U{members[j]:08x}" for i, j in zip(starts, ends, strict=True))


def split_pattern(below: int = 0x110000) -> re.Pattern:
    return re.compile(SPLIT.format(L=char_class("L", NEW_LETTERS, below), N=char_class("N", NEW_NUMBERS, below),
                                   S=SPACE))


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary file."""
    spare = iter(range(256, 512))
    own = set(PRINTABLE)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteBPE(Remembered):
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_id = [vocab[c] for c in chars]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault(vocab[a] << SHIFT | vocab[b], (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        names = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.simple_split, self.split = split_pattern(SIMPLE), split_pattern()
        self.beyond = re.compile(f"[^\\x00-{chr(SIMPLE - 1)}]")
        keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.pair_keys = np.append(keys, np.int64(NONE))
        self.pair_rank = np.array([*(self.pairs[k][0] for k in keys.tolist()), 0], dtype=np.int64)
        self.rank_id = np.zeros(len(self.pairs) and max(r for r, _ in self.pairs.values()) + 1, dtype=np.int64)
        for rank, merged in self.pairs.values():
            self.rank_id[rank] = merged
        super().__init__(cache_bytes, ENTRY, LONGEST_CACHED)

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token, by a segment tree over adjacent pair ranks."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        pairs = self.pairs
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            found = pairs.get(ids[i] << SHIFT | ids[i + 1])
            if found is not None:
                tree[size + i] = found[0] << SHIFT | i
        for node in range(size - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while (low := tree[1]) < NONE:
            i = low & 0xFFFFFFFF
            j = after[i]
            ids[i] = pairs[ids[i] << SHIFT | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            changed = [(j, NONE)] if j < n - 1 else []
            if k < n:
                before[k] = i
                found = pairs.get(ids[i] << SHIFT | ids[k])
                changed.append((i, NONE if found is None else found[0] << SHIFT | i))
            else:
                changed.append((i, NONE))
            h = before[i]
            if h >= 0:
                found = pairs.get(ids[h] << SHIFT | ids[i])
                changed.append((h, NONE if found is None else found[0] << SHIFT | h))
            for leaf, value in changed:
                node = size + leaf
                if tree[node] == value:
                    continue
                tree[node] = value
                node >>= 1
                while node:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    low = a if a < b else b
                    if tree[node] == low:
                        break
                    tree[node] = low
                    node >>= 1
        return [i for i in ids if i >= 0]

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """``merge_word`` of many short pre-tokens: their trees advance together, node by node."""
        return [np.frombuffer(ids, "<u4") for ids in self.merged(words)]

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        low = 1
        for leaves in LEAVES:
            rows = np.flatnonzero((sizes >= low) & (sizes <= leaves + 1))
            low = leaves + 2
            for start in range(0, len(rows), 8192):
                part = rows[start:start + 8192]
                for r, ids in zip(part.tolist(), self._merge_block([words[i] for i in part], leaves), strict=True):
                    out[r] = ids
        for r in np.flatnonzero((sizes >= low) | (sizes == 0)).tolist():
            out[r] = np.array(self.merge_word(words[r]), dtype="<u4").tobytes()
        return out

    def _values(self, left: np.ndarray, right: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Leaf values (rank, place) of pairs of ids; NONE where an id is missing or no merge exists."""
        key = left << SHIFT | right
        at = np.searchsorted(self.pair_keys, key)
        found = (self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_rank[np.minimum(at, len(self.pair_rank) - 1)] << 8 | place, NONE)

    def _merge_block(self, words: list[bytes], leaves: int) -> list[bytes]:
        n, width = len(words), leaves + 1
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        ids = np.ascontiguousarray(np.where(np.arange(width) < size[:, None], np.array(self.byte_id)[raw], -1).T)
        ids = np.vstack([ids, np.full((1, n), -1)])
        tree = np.full((2 * leaves, n), NONE, dtype=np.int64)
        tree[leaves:] = self._values(ids[:leaves], ids[1:leaves + 1], np.arange(leaves)[:, None])
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
        after = np.repeat(np.minimum(np.arange(1, width + 2), width)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, width)[:, None], n, axis=1)
        col = np.flatnonzero(tree[1] < NONE)
        while len(col):
            root = tree[1, col]
            i = root & 255
            j = after[i, col]
            k = after[j, col]
            h = before[i, col]
            new = self.rank_id[root >> 8]
            ids[i, col] = new
            ids[j, col] = -1
            after[i, col] = k
            before[k, col] = i
            # the leaf of the symbol that went, of the merged one and of the one before it
            leaf = [(np.minimum(j, leaves - 1), np.full(len(col), NONE), j < leaves),
                    (i, self._values(new, ids[k, col], i), None),
                    (np.maximum(h, 0), self._values(np.where(h >= 0, ids[h, col], -1), new, h), h >= 0)]
            for at, value, valid in leaf:
                if valid is not None:
                    at, value, c = at[valid], value[valid], col[valid]
                else:
                    c = col
                node = at + leaves
                tree[node, c] = value
                step = leaves
                while step > 1:
                    node = node >> 1
                    tree[node, c] = np.minimum(tree[2 * node, c], tree[2 * node + 1, c])
                    step >>= 1
            col = col[tree[1, col] < NONE]
        kept = ids.T >= 0
        flat, ends = ids.T[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def pre_tokens(self, text: str) -> list[str]:
        """The text cut into pre-tokens; a special token is one by itself."""
        if self.special_split is not None and any(s in text for s in self.special):
            return [w for part in self.special_split.split(text)
                    for w in ([part] if part in self.special else self._cut(part))]
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        return (self.split if self.beyond.search(text) else self.simple_split).findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers."""
        cut = [self.pre_tokens(t) for t in texts]
        fresh = self.unmet(cut)
        cache = self.cache
        cache.update(zip(fresh, self.merged([w.encode("utf-8", "surrogatepass") for w in fresh]), strict=True))
        for word, i in self.special.items():
            cache[word] = i.to_bytes(4, "little")
        out = [b"".join(map(cache.__getitem__, words)) for words in cut]
        self.keep(fresh)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        table, size = self.token_bytes, len(self.token_bytes)
        values = np.frombuffer(ids, dtype="<u4")
        if len(values) and values.max() >= size:
            values = values[values < size]
        return b"".join(map(table.__getitem__, values.tolist())).decode("utf-8", "replace")


def tokenizer(path: str) -> ByteBPE:
    """The tokenizer of a file, kept in the process until another operator works there."""
    return held(("byte_bpe", path), lambda: ByteBPE(path))


def _texts(column: pa.Array, limit: int = 1 << 20):
    """Lists of texts of about ``limit`` characters (null: empty)."""
    part, size = [], 0
    for text in column.to_pylist():
        part.append(text or "")
        size += len(part[-1])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """Append ``ids_col``: the token ids as binary, little-endian unsigned 32-bit integers.

    With ``decoded_col`` the ids are decoded again in the same pass."""
    fields = [T.StructField(ids_col, T.BinaryType())]
    fields += [T.StructField(decoded_col, T.StringType())] if decoded_col else []

    def run(columns):
        bpe = tokenizer(path)
        ids = [x for part in _texts(columns[0]) for x in bpe.encode_batch(part)]
        out = [pa.array(ids, pa.binary())]
        return [*out, pa.array(map(bpe.decode, ids), pa.string())] if decoded_col else out

    return append_columns(df, [text_col], fields, run, done=lambda: tokenizer(path).forget(), keep=True)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Append ``text_col``: the text of the packed ids."""

    def run(columns):
        bpe = tokenizer(path)
        return [pa.array([bpe.decode(x or b"") for x in columns[0].to_pylist()], pa.string())]

    return append_columns(df, [ids_col], [T.StructField(text_col, T.StringType())], run, keep=True)
