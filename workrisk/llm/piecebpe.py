"""SentencePiece encoding and decoding of merge-type models (operator 11).

The pieces, their scores and the settings come from a public model file whose path is a parameter.
A merge-type model joins, again and again, the leftmost of the adjacent pairs whose joined string is
the piece of highest score. Here no merges run over the text. A sequence of pieces is the result of
those merges exactly if every piece and every two adjacent ones merge to themselves, so the encoder
searches for that sequence:

* an Aho-Corasick automaton gives the pieces that match at every position, the longest is tried first;
* a piece may follow another if merging their joined string again gives just these two (remembered);
* a bitfield holds the positions from which no way leads on; as the pieces before a position are
  unique, one bit is enough, and each position is given up once at most.

Texts are cut where no piece of the model can cross: before a space that follows another character and
around characters that occur in no longer piece. Encoded cuts are kept in a cache bounded by bytes,
which ``encode`` empties when a task ends; which pieces may stand behind which is remembered within the same bound.

Defined results: a null text is encoded like an empty one (only the begin and end ids); characters
without a piece become the ids of their UTF-8 bytes, or the unknown id where the model has no byte
pieces; decoding null or empty ids gives the empty string; ids outside the model raise an error;
columns that clash with an added one are replaced, all others pass through; repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _texts
from .common import Remembered, append_columns

# Fixed values of the public model format.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3

CACHE_BYTES = 80 << 20  # of cached cuts with ids, and again of remembered pairs, about
ENTRY = 160  # bytes that a cached cut takes besides its strings, about
PAIR = 120  # bytes that a remembered pair takes, about
LONGEST_CACHED = 64
WIDTHS = (6, 10, 16, 30, 62)  # lengths of cuts that are searched together; a bitfield of 64 bits holds the last
STEP_WORDS = 16_384
NONE = 1 << 62


def wire_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        size = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        if size is None:
            size = varint()
        yield tag >> 3, raw[at:at + size]
        at += size


class PieceBPE(Remembered):
    """Encoder and decoder of one merge-type model file."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        with open(path, "rb") as f:
            raw = f.read()
        pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normalizer: dict[int, int | bytes] = {}
        for number, value in wire_fields(raw):
            if number == PIECES:
                own = dict(wire_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif number == TRAINER:
                trainer = dict(wire_fields(value))
            elif number == NORMALIZER:
                normalizer = dict(wire_fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != MERGE_TYPE or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("not a plain merge-type model")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("a model with a character map or removed spaces is not supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.unknown_surface = trainer.get(44, " ⁇ ".encode())
        self.begin = next(i for i, p in enumerate(pieces) if p[0] == trainer.get(46, b"<s>").decode())
        self.end = next(i for i, p in enumerate(pieces) if p[0] == trainer.get(47, b"</s>").decode())
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        byte_ids = [i for i, p in enumerate(pieces) if p[2] == BYTE]
        self.byte_id = {int(pieces[i][0][3:5], 16): i for i in byte_ids}
        self.piece_id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        # merges of equal score are ordered by place alone, so ranks must keep ties
        scores = sorted({pieces[i][1] for i in self.piece_id.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.rank = {p: place[pieces[i][1]] for p, i in self.piece_id.items() if len(p) > 1}
        self.no_rank = len(scores)

        self.token_bytes = [p.replace(SPACE, " ").encode() if kind == NORMAL else b"" for p, _, kind in pieces]
        for byte, i in self.byte_id.items():
            self.token_bytes[i] = bytes([byte])
        self.token_bytes[self.unknown] = self.unknown_surface
        self.bytes_only = set(byte_ids)
        self.control = {i for i, p in enumerate(pieces) if p[2] == CONTROL}
        self.leading = {i for p, i in self.piece_id.items() if p.startswith(SPACE)}

        inside = {c for p in self.rank for c in p}
        self.names = sorted({*self.piece_id, *inside})
        self.number = {p: k for k, p in enumerate(self.names)}
        self.matches = LongestMatches(self.names)
        self.size = np.array([len(p) for p in self.names])
        self.coded = [self.bytes_of(p) for p in self.names]
        self.widest = max(map(len, self.names))
        self.automaton = ahocorasick.Automaton()
        for p in self.names:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.next_shorter = np.array([next((self.number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.number), -1)
                                      for p in self.names])
        if any(a != SPACE and b == SPACE for p in self.rank for a, b in zip(p, p[1:], strict=False)):
            self.cut, self.alphabet = re.compile(r".+", re.DOTALL), None
        else:
            own = re.escape("".join(sorted(inside - {SPACE})))
            self.alphabet = inside
            self.cut = re.compile(f"{SPACE}*[{own}]+|{SPACE}+|[^{own}]")
            self.plain_cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")  # the same where all characters are in longer pieces
        self.coded_size = np.array([len(x) // 4 for x in self.coded])
        self.coded_ids = np.frombuffer(b"".join(self.coded), "<u4")
        self.forget_pairs()
        super().__init__(cache_bytes, ENTRY, LONGEST_CACHED)

    def merge(self, text: str, border: int = 0) -> list[str]:
        """Pieces of a short string by merging; stops at once if a merge crosses ``border`` (if given)."""
        parts, starts = list(text), list(range(len(text)))
        rank, most = self.rank, self.no_rank
        ranks = [rank.get(a + b, most) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < most:
            i = ranks.index(low)
            if border and starts[i + 1] == border:
                return []
            parts[i] += parts.pop(i + 1)
            del ranks[i], starts[i + 1]
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], most)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], most)
        return parts

    def forget_pairs(self) -> None:
        self.follows: dict[int, bool] = {}  # by last * number of pieces + piece (last is one more; 0: at the start)
        self.keys, self.allowed = np.array([NONE]), np.zeros(1, bool)

    def may_follow(self, last: int, piece: int) -> bool:
        """Whether merging the joined string of two pieces (``last`` is one more; 0: none) gives just these again."""
        key = last * len(self.names) + piece
        known = self.follows.get(key)
        if known is None:
            own = self.names[piece]
            before = self.names[last - 1] if last else ""
            known = self.follows[key] = self.merge(before + own, len(before)) == ([before, own] if last else [own])
        return known

    def may_follow_all(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        key = last * len(self.names) + piece
        place = np.searchsorted(self.keys, key)
        new = np.unique(key[self.keys[place] != key])
        if len(new):
            known = [self.may_follow(*divmod(k, len(self.names))) for k in new.tolist()]
            where = np.searchsorted(self.keys, new)
            self.keys, self.allowed = np.insert(self.keys, where, new), np.insert(self.allowed, where, known)
            place = np.searchsorted(self.keys, key)
        return self.allowed[place]

    def search_words(self, words: list[str]) -> list[list[int]]:
        """``search`` of many cuts of 2 to ``WIDTHS[-1]`` characters: numbers of their pieces, all cuts step by step."""
        return self._search_words(words, lambda flat, ends: [flat[s:e].tolist() for s, e in zip([0, *ends[:-1]], ends, strict=True)])

    def coded_words(self, words: list[str]) -> list[bytes]:
        """``search_words`` as ids, little-endian unsigned 32-bit integers."""
        first = np.cumsum(self.coded_size) - self.coded_size

        def ids(flat: np.ndarray, ends: list[int]) -> list[bytes]:
            size = self.coded_size[flat]
            to = np.cumsum(size)
            raw = self.coded_ids[np.arange(size.sum()) + np.repeat(first[flat] - to + size, size)].tobytes()
            to = (4 * np.append(0, to)[ends]).tolist()
            return [raw[s:e] for s, e in zip([0, *to[:-1]], to, strict=True)]

        return self._search_words(words, ids)

    def _search_words(self, words: list[str], parts: Callable[[np.ndarray, list[int]], list]) -> list:
        """``parts`` of the piece numbers of blocks of cuts, and where each cut's end, in the order of the cuts."""
        out: list = [None] * len(words)
        length = np.array([len(w) for w in words])
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= width))
            low = width
            for start in range(0, len(rows), STEP_WORDS):
                part = rows[start:start + STEP_WORDS]
                found_parts = parts(*self._search_block([words[i] for i in part], length[part], width))
                for r, found in zip(part.tolist(), found_parts, strict=True):
                    out[r] = found
        return out

    def _search_block(self, words: list[str], length: np.ndarray, width: int) -> tuple[np.ndarray, list[int]]:
        n = len(words)
        chars = np.frombuffer("".join([w.ljust(width) for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
        longest = self.matches.at_each_place(chars.reshape(n, width).T.astype(np.int64), length)
        at, depth, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        failed, piece = np.zeros(n, np.int64), longest[0].copy()  # one bit for each position
        pieces = np.zeros((width + 1, n), np.int64)
        col = np.arange(n)
        while len(col):
            own = piece[col]
            end = at[col] + self.size[own]
            free = failed[col] >> end & 1 == 0
            free[free] = self.may_follow_all(last[col[free]], own[free])
            on, own, end, rest = col[free], own[free], end[free], col[~free]
            pieces[depth[on], on] = own
            at[on], last[on] = end, own + 1
            depth[on] += 1
            piece[on] = longest[np.minimum(end, width - 1), on]
            piece[rest] = self.next_shorter[piece[rest]]
            back = rest[piece[rest] < 0]  # nothing leads on from here: back to the piece before
            if len(back):
                failed[back] |= 1 << at[back]
                depth[back] -= 1
                piece[back] = pieces[depth[back], back]
                at[back] -= self.size[piece[back]]
                last[back] = np.where(depth[back] > 0, pieces[depth[back] - 1, back] + 1, 0)
            col = col[at[col] < length[col]]
        return pieces.T[np.arange(width + 1) < depth[:, None]], np.cumsum(depth).tolist()

    def longest(self, word: str, at: int) -> str:
        """The longest piece that matches at a position, or the character there."""
        ahead = word[at:at + self.widest]
        end, length = next(self.automaton.iter_long(ahead), (0, 1))
        return ahead[:end + 1] if end + 1 == length else ahead[0]

    def search(self, word: str) -> list[str]:
        """The pieces of a cut, by backtracking over the longest matches."""
        number, names, n = self.number, self.names, len(word)
        failed = bytearray(n // 8 + 1)  # one bit for each position
        pieces: list[str] = []
        at, piece = 0, self.longest(word, 0)
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and self.fits(pieces[-1] if pieces else "", piece):
                pieces.append(piece)
                if end == n:
                    return pieces
                at, piece = end, self.longest(word, end)
                continue
            shorter = self.next_shorter[number[piece]] if piece in number else -1
            if shorter >= 0:
                piece = names[shorter]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = pieces.pop()
                at -= len(piece)

    def fits(self, last: str, piece: str) -> bool:
        """``may_follow`` of strings; a character that is in no piece fits everywhere."""
        if piece not in self.number or last and last not in self.number:
            return piece not in self.number or self.may_follow(0, self.number[piece])
        return self.may_follow(self.number[last] + 1 if last else 0, self.number[piece])

    def bytes_of(self, piece: str) -> bytes:
        """The ids of a piece or of a character without one."""
        if piece in self.piece_id:
            ids = [self.piece_id[piece]]
        elif self.byte_id:
            ids = [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]
        else:
            ids = [self.unknown]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of cuts."""
        many = [w for w in words if 1 < len(w) <= WIDTHS[-1] and (self.alphabet or not self.beyond(w))]
        found = dict(zip(many, self.coded_words(many), strict=True)) if many else {}
        return [found[w] if w in found else b"".join(map(self.bytes_of, self.search(w) if len(w) > 1 else [w])) for w in words]

    def beyond(self, word: str) -> bool:
        return any(c not in self.number for c in word)

    def forget(self) -> None:
        """Empty the cache of cuts (at the end of a task) and, if it has grown large, that of pairs."""
        super().forget()
        if PAIR * len(self.follows) > self.cache_bytes:
            self.forget_pairs()

    def cuts(self, text: str) -> list[str]:
        plain = self.alphabet is not None and self.alphabet.issuperset(text)
        return (self.plain_cut if plain else self.cut).findall(text)

    def encode_batch(self, texts: list[str], ends: bool = True) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers, with begin and end ids where ``ends``."""
        first, last = (struct.pack("<I", i) if ends else b"" for i in (self.begin, self.end))
        if PAIR * len(self.follows) > self.cache_bytes:
            self.forget_pairs()
        cut = [self.cuts((" " + t if t and self.dummy_prefix else t).replace(" ", SPACE)) for t in texts]
        fresh = self.unmet(cut)
        cache = self.cache
        cache.update(zip(fresh, self.encode_words(fresh), strict=True))
        out = [b"".join([first, *map(cache.__getitem__, words), last]) for words in cut]
        self.keep(fresh)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        values = np.frombuffer(ids, dtype="<u4").tolist()
        first = next((i for i, x in enumerate(values) if x not in self.control), len(values))
        strip = self.dummy_prefix and first < len(values) and values[first] in self.leading
        joined = b"".join(map(self.token_bytes.__getitem__, values))[strip:]
        try:
            if not self.control.isdisjoint(values[1:-1]):
                raise ValueError("a control id may part the bytes of a character")
            return joined.decode()
        except ValueError:
            runs = groupby(values, key=lambda i: (i in self.bytes_only, i in self.control))
            return "".join(decode_by_character(b"".join(map(self.token_bytes.__getitem__, run)))
                           for _, run in runs)[strip:]


class LongestMatches:
    """Aho-Corasick automaton of the reversed pieces, for many strings at a time.

    Read from its end, a string is at each place in the state of the longest beginning of a reversed piece;
    the longest piece that ends a state is the longest one that starts at this place of the string."""

    def __init__(self, names: list[str]):
        children: list[dict[int, int]] = [{}]
        out = [-1]
        for number, piece in enumerate(names):
            state = 0
            for c in map(ord, reversed(piece)):
                if c not in children[state]:
                    children[state][c] = len(out)
                    children.append({})
                    out.append(-1)
                state = children[state][c]
            out[state] = number
        fail = [0] * len(out)
        level = list(children[0].values())
        while level:
            deeper = []
            for state in level:
                if out[state] < 0:
                    out[state] = out[fail[state]]
                for c, child in children[state].items():
                    back = fail[state]
                    while back and c not in children[back]:
                        back = fail[back]
                    fail[child] = children[back].get(c, 0)
                    deeper.append(child)
            level = deeper
        edges = sorted((state << 21 | c, child) for state, next_states in enumerate(children) for c, child in next_states.items())
        self.edge = np.array([*(e for e, _ in edges), NONE])
        self.child = np.array([*(c for _, c in edges), 0])
        self.fail, self.out = np.array(fail), np.array(out)

    def at_each_place(self, chars: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of the longest piece at each place; ``chars`` has a column for each string."""
        state, found = np.zeros(len(length), np.int64), np.zeros(chars.shape, np.int64)
        for place in range(len(chars) - 1, -1, -1):
            rows = np.flatnonzero(length > place)
            while len(rows):
                edge = state[rows] << 21 | chars[place, rows]
                at = np.searchsorted(self.edge, edge)
                known = self.edge[at] == edge
                state[rows[known]] = self.child[at[known]]
                rows = rows[~known]
                rows = rows[state[rows] > 0]
                state[rows] = self.fail[state[rows]]
            found[place] = self.out[state]
        return found


def decode_by_character(raw: bytes) -> str:
    """UTF-8 with one replacement character for every byte that starts no valid character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceBPE:
    """One model for each file and process."""
    return PieceBPE(path)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None,
           ends: bool = True) -> DataFrame:
    """Append ``ids_col``: the ids as binary, little-endian unsigned 32-bit integers.

    ``ends`` adds the begin and end ids. With ``decoded_col`` the ids are decoded again in the same pass."""
    fields = [T.StructField(ids_col, T.BinaryType())]
    fields += [T.StructField(decoded_col, T.StringType())] if decoded_col else []

    def run(columns):
        coder = model(path)
        ids = [x for part in _texts(columns[0]) for x in coder.encode_batch(part, ends)]
        out = [pa.array(ids, pa.binary())]
        return [*out, pa.array(map(coder.decode, ids), pa.string())] if decoded_col else out

    return append_columns(df, [text_col], fields, run, lambda: model(path).forget())


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Append ``text_col``: the text of the packed ids."""

    def run(columns):
        coder = model(path)
        return [pa.array([coder.decode(x or b"") for x in columns[0].to_pylist()], pa.string())]

    return append_columns(df, [ids_col], [T.StructField(text_col, T.StringType())], run)
