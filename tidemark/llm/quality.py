"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes run over every byte position of a text. Chunks of two strides of ``STRIDE``
bytes overlap by half and cover the whole text; in each, every filter's rectified response is
max-pooled. A text's features are the maximum, mean and minimum of its chunks' pooled responses, and
a logistic layer makes them one probability. A filter on one-hot bytes is a table of 256 numbers for
each of its positions, so the convolution is a sum of table rows; learning sends the gradient only to
the bytes that won the pooling.

Learning takes labelled rows whose fold is not 0, at most ``rows`` and ``size`` bytes in expectation,
picked by a hash of the id; it runs on the driver.

Cases: null and empty text are one zero byte and get a score like any other; a document with several
labels counts as good if one says so; rows with a null label aren't learned from; without both
classes the score is the smoothed share of good labels; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import fold_of, kept_rows, only, slices, text_bytes

WIDTH, STRIDE, FILTERS = 5, 256, 16


class Net:
    """tables: (WIDTH, 256, FILTERS); bias of filters; weights of max, mean and minimum; bias of the logit."""

    def __init__(self, seed: int = 42):
        r = np.random.default_rng(seed)
        self.tables = (r.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = (r.standard_normal(3 * FILTERS) * 0.1).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.constant: float | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.weights, self.base]


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with zeros behind each text, each text's first byte and length, and its number of strides."""
    texts = [t or b"\0" for t in texts]
    n = np.array([len(t) for t in texts], np.int64)
    gap = b"\0" * (WIDTH - 1)
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    first = np.cumsum(n + WIDTH - 1) - (n + WIDTH - 1)
    return data, first, n, (n + STRIDE - 1) // STRIDE


def responses(net: Net, data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Rectified responses at byte positions ``a`` to ``b``."""
    out = net.tables[0].take(data[a:b], axis=0)
    for j in range(1, WIDTH):
        out += net.tables[j].take(data[a + j : b + j], axis=0)
    out += net.bias
    return np.maximum(out, 0, out=out)


def stride_maxima(net: Net, data: np.ndarray, first: np.ndarray, n: np.ndarray, strides: np.ndarray, block: int = 512, winners: bool = False):
    """Maximum response in each stride of each text; with ``winners`` also the positions that have it."""
    start = np.repeat(first, strides) + STRIDE * (np.arange(strides.sum()) - np.repeat(np.cumsum(strides) - strides, strides))
    stop = np.minimum(start + STRIDE, np.repeat(first + n, strides))
    out = np.empty((len(start), FILTERS), np.float32)
    at = np.empty((len(start), FILTERS), np.int64) if winners else None
    for i in range(0, len(start), block):
        s, e = start[i : i + block], stop[i : i + block]
        r = responses(net, data, int(s[0]), int(e[-1]))
        if len(s) > 1:
            gaps = np.flatnonzero(s[1:] > e[:-1])
            for g in gaps.tolist():
                r[int(e[g] - s[0]) : int(s[g + 1] - s[0])] = 0
        out[i : i + block] = np.maximum.reduceat(r, s - s[0], axis=0)
        if winners:
            for k, (x, y) in enumerate(zip((s - s[0]).tolist(), (e - s[0]).tolist())):
                at[i + k] = s[0] + x + r[x:y].argmax(0)
    return (out, at) if winners else out


def chunk_maxima(halves: np.ndarray, strides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of two neighbouring strides (of one, in a text of one): maxima, the first stride of each, and each text's first chunk."""
    chunks = np.maximum(strides - 1, 1)
    begin = np.cumsum(chunks) - chunks
    left = np.arange(chunks.sum()) + np.repeat((np.cumsum(strides) - strides) - begin, chunks)
    right = np.where(np.repeat(strides, chunks) > 1, left + 1, left)
    return np.maximum(halves[left], halves[right]), np.where((halves[right] > halves[left]), right[:, None], left[:, None]), begin


def text_features(pooled: np.ndarray, begin: np.ndarray) -> np.ndarray:
    n = np.diff(np.append(begin, len(pooled)))[:, None]
    return np.hstack([np.maximum.reduceat(pooled, begin, axis=0), np.add.reduceat(pooled, begin, axis=0) / n, np.minimum.reduceat(pooled, begin, axis=0)])


def score(net: Net, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 for each text."""
    if net.constant is not None or not texts:
        return np.full(len(texts), net.constant if net.constant is not None else 0.0)
    data, first, n, strides = layout(texts)
    pooled, _, begin = chunk_maxima(stride_maxima(net, data, first, n, strides), strides)
    z = text_features(pooled, begin).astype(np.float64) @ net.weights.astype(np.float64) + float(net.base[0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradient(net: Net, texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """The mean log loss's gradient in each of the network's parts, over ``texts``."""
    data, first, n, strides = layout(texts)
    halves, at = stride_maxima(net, data, first, n, strides, winners=True)
    pooled, chosen, begin = chunk_maxima(halves, strides)
    x = text_features(pooled, begin)
    p = 1 / (1 + np.exp(-np.clip(x @ net.weights + net.base[0], -30, 30)))
    d = ((p - labels) / len(texts)).astype(np.float32)
    dx = d[:, None] * net.weights
    count = np.diff(np.append(begin, len(pooled)))
    doc = np.repeat(np.arange(len(texts)), count)
    top, low = x[doc, :FILTERS] == pooled, x[doc, 2 * FILTERS :] == pooled
    share = lambda hit: hit / np.maximum(np.add.reduceat(hit.astype(np.float32), begin, axis=0), 1)[doc]
    dp = dx[doc, :FILTERS] * share(top) + dx[doc, FILTERS : 2 * FILTERS] / count[doc][:, None] + dx[doc, 2 * FILTERS :] * share(low)
    dp = np.where(pooled > 0, dp, 0)
    where = at[chosen, np.arange(FILTERS)]
    tables = np.stack([np.bincount((data[where + j].astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), dp.ravel(), 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)])
    return tables, dp.sum(0), x.T @ d, np.array([d.sum()], np.float32)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 42) -> Net:
    """A network fitted by Adam on the log loss."""
    net, r = Net(seed), np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        net.constant = (float(labels.sum()) + 1) / (len(labels) + 2)
        return net
    net.base[0] = np.log(labels.mean() / (1 - labels.mean()))
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            step += 1
            for k, (w, g) in enumerate(zip(net.parts(), gradient(net, [texts[j] for j in pick], labels[pick]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w -= (rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame, rows: int = 3000, size: int = 16 << 20, seed: int = 42) -> Net:
    """A network from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    known = only(labels, doc_id="long", quality="int").where("quality is not null and doc_id is not null")
    known = known.where(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    part = min(1.0, rows / max(1, known.count()))
    picked = known.where(draw < part)
    texts = only(docs, doc_id="long", text="string").where("doc_id is not null")
    texts = texts.join(F.broadcast(picked), "doc_id")  # ``rows`` bounds what is sent
    held = texts.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0].n or 0
    got = texts.where(draw < part * min(1.0, size / max(1, held))).orderBy("doc_id", "text").toArrow()
    raw, at = text_bytes(got.column("text"))
    data = raw.tobytes()
    return fit([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], got.column("quality").to_numpy().astype(np.float32), seed=seed)


def predict(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    rows = only(docs, doc_id="long", text="string").select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw, at = text_bytes(part.column(2))
            data = raw.tobytes()
            s = score(sent.value, [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
            yield pa.record_batch([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, net: Net, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    return kept_rows(docs, "text", lambda: lambda texts: score(sent.value, texts) >= threshold)
