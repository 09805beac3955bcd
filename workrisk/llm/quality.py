"""Quality classifier: a byte-level convolutional network in numpy (operator 4).

Every document is covered from its first to its last byte by overlapping chunks (192
bytes, a new one every 64). Learned filters over short byte windows (a byte embedding
followed by a convolution) are max-pooled within each chunk; the mean, the maximum and
the minimum over the document's chunks are combined by a small dense layer into one
probability. A chunk that repeats itself excites few filters, odd characters excite
their own, so both show in the pooled values.

The network is fitted with Adam on a bounded sample of labelled documents
(``SAMPLE_DOCS`` rows of at most ``TRAIN_BYTES`` bytes, chosen by a hash of the id);
scoring always reads whole texts.

Defined results: a null text is scored like an empty one, which is a single chunk of
padding; with labels of one class or none the score is the share of label 1 (0.5 without
labels). Null ids are as good as others. Repeated rows get equal scores: a score depends on
the text alone, not on the rows it is scored with.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, hash_sample, pieces, text_bytes

WINDOW = 6        # bytes seen by a filter
FILTERS = 16
EMBED = 8
HIDDEN = 16
STRIDE = 64       # a new chunk every so many bytes
SPAN = 3          # strides in a chunk
SAMPLE_DOCS = 3000
TRAIN_BYTES = 16_384
STEPS = 850        # training batches
BATCH = 32
PAD = 256         # the byte value that fills up a row


@dataclass
class Network:
    embed: np.ndarray   # 257 x EMBED
    conv: np.ndarray    # WINDOW x EMBED x FILTERS
    hidden: np.ndarray  # 3 FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray     # HIDDEN
    out_bias: np.ndarray
    prior: float | None = None  # the score of every row if there was nothing to learn

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return cls((r.normal(0, 0.5, (257, EMBED))).astype(np.float32),
                   (r.normal(0, 0.35, (WINDOW, EMBED, FILTERS))).astype(np.float32),
                   (r.normal(0, 0.2, (3 * FILTERS, HIDDEN))).astype(np.float32), np.zeros(HIDDEN, np.float32),
                   (r.normal(0, 0.3, HIDDEN)).astype(np.float32), np.zeros(1, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def tables(self) -> np.ndarray:
        """Response of each filter to each byte at each place of the window."""
        return np.ascontiguousarray(np.einsum("be,wek->wbk", self.embed, self.conv))


def padded(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows filled up to whole strides (one at least); and the first stride of each row."""
    size = np.diff(offsets)
    strides = np.maximum((size + STRIDE - 1) // STRIDE, 1)
    first = np.concatenate([[0], np.cumsum(strides)])
    out = np.full(first[-1] * STRIDE + WINDOW, PAD, dtype=np.uint16)
    for i in range(len(size)):
        out[first[i] * STRIDE:first[i] * STRIDE + size[i]] = flat[offsets[i]:offsets[i + 1]]
    return out, first


def responses(tables: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """Response of every filter at each of the first ``count`` positions."""
    total = tables[0].take(data[:count], axis=0)
    for w in range(1, WINDOW):
        total += tables[w].take(data[w:count + w], axis=0)
    return total


def within_rows(z: np.ndarray, first: np.ndarray) -> None:
    """Takes out the windows that reach over the end of a row; z: strides x STRIDE x FILTERS."""
    last = first[1:] - 1
    z[last[(last >= 0) & (last < len(z))], STRIDE - WINDOW + 1:] = -np.inf


def chunk_max(per_stride: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum over SPAN strides from each stride on, within its row."""
    best = per_stride.copy()
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for step in range(1, SPAN):
        same = np.flatnonzero(row[step:] == row[:len(row) - step])
        best[same] = np.maximum(best[same], per_stride[same + step])
    return best


def pooled(chunks: np.ndarray, first: np.ndarray) -> np.ndarray:
    start = first[:-1]
    mean = np.add.reduceat(chunks, start, axis=0) / np.diff(first)[:, None]
    return np.hstack([mean, np.maximum.reduceat(chunks, start, axis=0), np.minimum.reduceat(chunks, start, axis=0)])


def features(tables: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    data, first = padded(flat, offsets)
    n = first[-1]
    per_stride = np.empty((n, FILTERS), dtype=np.float32)
    step = 2048  # strides at a time: the responses stay in the processor's cache
    for a in range(0, n, step):
        b = min(a + step, n)
        z = responses(tables, data[a * STRIDE:b * STRIDE + WINDOW], (b - a) * STRIDE).reshape(b - a, STRIDE, FILTERS)
        within_rows(z, first - a)
        z.max(axis=1, out=per_stride[a:b])
    return pooled(np.tanh(chunk_max(per_stride, first)), first)


def head(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and hidden values. Sums run in a fixed order: a matrix product's depends on the number of rows."""
    h = np.zeros((len(x), HIDDEN), dtype=x.dtype) + net.hidden_bias
    for i in range(x.shape[1]):
        h += x[:, i:i + 1] * net.hidden[i]
    np.maximum(h, 0, out=h)
    logit = np.zeros(len(x), dtype=x.dtype) + net.out_bias
    for i in range(HIDDEN):
        logit += h[:, i] * net.out[i]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), h


def score_texts(net: Network, flat: np.ndarray, offsets: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
    rows = len(offsets) - 1
    if net.prior is not None:
        return np.full(rows, net.prior)
    tables = net.tables() if tables is None else tables
    out = np.zeros(rows)
    for a, b in pieces(offsets):
        out[a:b] = head(net, features(tables, flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))[0]
    return out


def gradients(net: Network, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted cross-entropy of one batch."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data, first = padded(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    n = first[-1]
    z = responses(net.tables(), data, n * STRIDE).reshape(n, STRIDE, FILTERS)
    within_rows(z, first)
    place = z.argmax(axis=1)
    per_stride = np.take_along_axis(z, place[:, None, :], axis=1)[:, 0]
    # which stride gives the maximum of a chunk
    source = np.repeat(np.arange(n)[:, None], FILTERS, axis=1)
    best = per_stride.copy()
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    for step in range(1, SPAN):
        same = np.flatnonzero(row[step:] == row[:n - step])
        better = per_stride[same + step] > best[same]
        best[same] = np.where(better, per_stride[same + step], best[same])
        source[same] = np.where(better, (same + step)[:, None], source[same])
    chunks = np.tanh(best)
    x = pooled(chunks, first)
    p, h = head(net, x)
    d_logit = ((p - labels) * weight / len(texts)).astype(np.float32)
    d_h = np.outer(d_logit, net.out) * (h > 0)
    d_x = d_h @ net.hidden.T
    d_mean, d_max, d_min = np.split(d_x, 3, axis=1)
    d_chunk = (d_mean / np.diff(first)[:, None])[row]
    for part, extreme in ((d_max, x[:, FILTERS:2 * FILTERS]), (d_min, x[:, 2 * FILTERS:])):
        hit = chunks == extreme[row]
        d_chunk = d_chunk + hit * part[row] / np.maximum(np.add.reduceat(hit, first[:-1], axis=0, dtype=np.int64), 1)[row]
    d_z = d_chunk * (1 - chunks ** 2)
    k = np.broadcast_to(np.arange(FILTERS), source.shape)
    at = source * STRIDE + place[source, k]
    d_tables = np.zeros((WINDOW, 257, FILTERS), np.float32)
    for w in range(WINDOW):
        key = data[at + w].astype(np.int64) * FILTERS + k
        d_tables[w] = np.bincount(key.ravel(), weights=d_z.ravel(), minlength=257 * FILTERS).reshape(257, FILTERS)
    return [np.einsum("wbk,wek->be", d_tables, net.conv), np.einsum("wbk,be->wek", d_tables, net.embed),
            x.T @ d_h, d_h.sum(axis=0), h.T @ d_logit, d_logit.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on shuffled batches; both classes weigh the same."""
    net = Network.start(seed)
    ones = float(labels.mean()) if len(labels) else 0.5
    if ones in (0.0, 1.0) or not len(labels):
        net.prior = ones
        return net
    r = np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / (1 - ones))
    epochs, t = -(-steps // -(-len(texts) // BATCH)), 0
    steps = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            part = order[start:start + BATCH]
            t += 1
            rate = 0.01 * min(1, t / 30) * (1 - 0.95 * t / steps)
            for w, g, (m, v) in zip(net.weights(), gradients(net, [texts[i] for i in part], labels[part], weight[part]),
                                    moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-7)
    return net


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_docs: int = SAMPLE_DOCS, train_bytes: int = TRAIN_BYTES) -> Network:
    """Fit on a bounded sample: ``sample_docs`` labelled rows of at most ``train_bytes`` bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    short = labelled.where(F.col(label_col).isin(0, 1) & (F.octet_length(text) <= train_bytes))
    rows = hash_sample(short.select(F.col(id_col).alias("id"), text.alias("t"), F.col(label_col).alias("y")), "id",
                       sample_docs).collect()
    return train([r["t"].encode() for r in rows], np.array([float(r["y"]) for r in rows]))


def score(df: DataFrame, net: Network, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """Append the probability of label 1."""
    bc = df.sparkSession.sparkContext.broadcast(net)  # some 10,000 weights

    def run(columns):
        flat, offsets = text_bytes(columns[0])
        return [pa.array(score_texts(bc.value, flat, offsets))]

    return append_columns(df, [text_col], [T.StructField(score_out, T.DoubleType())], run)
