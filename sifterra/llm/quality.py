"""Quality: a byte-level convolutional network in numpy.

Each byte has a learned embedding; learned filters of ``WIDTH`` bytes slide by ``STRIDE``
over chunks of ``CHUNK`` bytes that overlap by ``WIDTH - STRIDE`` and cover the whole
document.  Each filter is rectified and max-pooled within a chunk; the pooled values are
averaged and maximised over the chunks, and a logistic layer makes one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifterra.llm.columns import BLOCK_BYTES, blocks, held_out, text_bytes, trimmed

WIDTH, STRIDE, FILTERS, DIM = 12, 4, 24, 6
CHUNK = 256
_TAPS, _STEPS = WIDTH // STRIDE, CHUNK // STRIDE
#: Bounds of the training sample: labelled rows of each class, and bytes of one text.
MAX_ROWS_PER_CLASS = 1500
MAX_TEXT_BYTES = 20_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Byte embeddings, filters and the last layer."""

    emb: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    bias: float

    def score_texts(self, column: pa.Array, block: int = BLOCK_BYTES) -> np.ndarray:
        """Probability of label 1 of each text; an empty text is one chunk of zero bytes.  A
        text of more than ``block`` bytes is read slice by slice."""
        raw, at = text_bytes(column)
        p = np.empty(len(column))
        for lo, hi in blocks(at, block):
            own = raw[at[lo] : at[hi]]
            if len(own) > block:
                features = self._long(own, max(1, block // CHUNK) * CHUNK)
            else:
                pooled, _, first = _pool(self, own, at[lo : hi + 1] - at[lo])
                features = _features(pooled, first)
            p[lo:hi] = 1 / (1 + np.exp(-np.clip(features @ self.out + self.bias, -60, 60)))
        return p

    def _long(self, raw: np.ndarray, step: int) -> np.ndarray:
        """Features of one text from slices of whole chunks; each looks as far into the next as
        its last windows reach."""
        total, most, n = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0
        for lo in range(0, len(raw) + WIDTH - STRIDE, step):
            last = lo + step >= len(raw) + WIDTH - STRIDE
            part = raw[lo : lo + step + (0 if last else WIDTH - STRIDE)]
            relu = np.maximum(_pool(self, part, np.array([0, len(part)]))[0], 0)
            relu = relu if last else relu[: step // CHUNK]
            total, most, n = total + relu.sum(0, dtype=np.float64), np.maximum(most, relu.max(0)), n + len(relu)
        return np.concatenate([total / n, most])[None]


def _layout(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to whole chunks, and each text's first chunk.

    One group of STRIDE bytes is one step; a chunk has _STEPS steps.  The padding is
    enough for the last steps of a text, which would look into the next, to hold none.
    """
    chunks = -(-(np.diff(at) + WIDTH - STRIDE) // CHUNK)
    chunks = np.maximum(1, chunks)
    first = np.concatenate([[0], np.cumsum(chunks)])
    padded = np.zeros((first[-1] * CHUNK,), np.uint8)
    padded[np.repeat(first[:-1] * CHUNK - at[:-1], np.diff(at)) + np.arange(len(raw))] = raw
    return padded, first


def _pool(model: QualityModel, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks x FILTERS maxima before rectifying, padded bytes, first chunk of each text)."""
    padded, first = _layout(raw, at)
    steps = model.emb[padded].reshape(-1, STRIDE * DIM)
    taps = model.filters.reshape(_TAPS, STRIDE * DIM, FILTERS).transpose(1, 0, 2).reshape(STRIDE * DIM, -1)
    each = steps @ taps
    total = each[:, :FILTERS].copy()
    for k in range(1, _TAPS):  # the last steps of a chunk look into the next one: the overlap
        total[: len(total) - k] += each[k:, k * FILTERS : (k + 1) * FILTERS]
    _close(total, first)
    return total.reshape(-1, _STEPS, FILTERS).max(1) + model.shift, padded, first


def _close(total: np.ndarray, first: np.ndarray) -> None:
    """No maximum at the steps whose windows end in the next text."""
    for k in range(1, _TAPS):
        total[first[1:] * _STEPS - k] = -1e30


def _features(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    relu = np.maximum(pooled, 0)
    mean = np.add.reduceat(relu, first[:-1], 0) / np.diff(first)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(relu, first[:-1], 0)], 1)


def _windows(padded: np.ndarray) -> np.ndarray:
    """View of the WIDTH bytes at each step; past the end there are zeros."""
    longer = np.concatenate([padded, np.zeros(WIDTH, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(longer, WIDTH)[: len(padded) : STRIDE]


def train(texts: list[str], labels: np.ndarray, epochs: int | None = None, batch: int = 48, seed: int = 11) -> QualityModel:
    """Adam on minibatches; the gradient goes through the maxima only.  Classes weigh alike
    while learning; the bias is moved half-way to the rates of the sample afterwards.
    ``epochs``: 12, or for small samples as many as make 600 steps, 60 at most."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
    filters = rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
    shift, out, bias = np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32)
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return QualityModel(emb, filters, shift, out * 0, 0.0 if not len(y) else float(6 * y[0] - 3))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    params = [emb, filters, shift, out, bias]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    epochs = epochs or min(60, max(12, 600 * batch // len(y)))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = order[lo : lo + batch]
            raw, at = text_bytes(pa.array([texts[i] for i in rows], pa.string()))
            model = QualityModel(emb, filters, shift, out, float(bias[0]))
            padded, first = _layout(raw, at)
            windows = _windows(padded)
            flat = emb[padded].reshape(-1, STRIDE * DIM)
            taps = filters.reshape(_TAPS, STRIDE * DIM, FILTERS).transpose(1, 0, 2).reshape(STRIDE * DIM, -1)
            each = flat @ taps
            total = each[:, :FILTERS].copy()
            for k in range(1, _TAPS):
                total[: len(total) - k] += each[k:, k * FILTERS : (k + 1) * FILTERS]
            _close(total, first)
            cube = total.reshape(-1, _STEPS, FILTERS)
            where = cube.argmax(1)
            pooled = np.take_along_axis(cube, where[:, None], 1)[:, 0] + shift
            feats = _features(pooled, first)
            p = 1 / (1 + np.exp(-np.clip(feats @ model.out + model.bias, -60, 60)))
            g = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            gf = g[:, None] * out[None]
            doc = np.repeat(np.arange(len(rows)), np.diff(first))
            relu = np.maximum(pooled, 0)
            gp = gf[doc, :FILTERS] / np.diff(first)[doc, None]
            best = feats[doc, FILTERS:] == relu
            gp = (gp + gf[doc, FILTERS:] * best) * (pooled > 0)
            at_step = where + (np.arange(len(where)) * _STEPS)[:, None]
            used = windows[at_step]  # chunks x FILTERS x WIDTH
            x = emb[used].reshape(*at_step.shape, -1)
            g_filters = np.einsum("cfk,cf->kf", x, gp)
            gx = (filters.T[None] * gp[:, :, None]).reshape(-1, DIM)
            flat_bytes = used.reshape(-1)
            g_emb = np.stack([np.bincount(flat_bytes, gx[:, d], 256) for d in range(DIM)], 1)
            grads = [g_emb, g_filters + 1e-4 * filters, gp.sum(0), feats.T @ g + 1e-4 * out, g.sum(keepdims=True)]
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for (m, v), value, grad in zip(moments, params, grads, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return QualityModel(emb, filters, shift, out, float(bias[0]) + 0.5 * float(np.log(y.sum() / (1 - y).sum())))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_class: int = MAX_ROWS_PER_CLASS, text_bytes_limit: int = MAX_TEXT_BYTES) -> QualityModel:
    """Train on a bounded sample, as ``bounded_sample`` draws it, learning only from rows
    whose crc32(doc_id) mod 5 is not 0."""
    from sifterra.llm.toxicity import bounded_sample

    rows = bounded_sample(docs, labels, label, rows_per_class, text_bytes_limit)
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows]))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, whole texts, in one pass.

    Only doc_id and text are read.  A null or empty text is scored as one chunk of zero
    bytes; a null doc_id stays null and counts as held out; repeated rows give repeated
    results; an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), held_out(batch.column(0)), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(score), "doc_id long, held_out boolean, score double, predicted int")
