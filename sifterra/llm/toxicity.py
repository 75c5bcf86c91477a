"""Toxicity: subword bags averaged into a linear softmax, trained jointly in numpy.

A text is read in windows of ``WINDOW`` words, one from each word on.  A window is the bag
of its words' character n-grams (3 to 6 UTF-8 bytes of the lower-cased word with a space
at either end, hashed to ``BUCKETS`` rows), whose embeddings are averaged and enter a
linear softmax of two classes; embeddings and softmax are trained together.  The most
toxic window of a text counts, so that a few words in a very long text are not averaged
away.  Misspelled words share most of their n-grams with the words they come from.

At scoring time embedding and softmax fold into one number per bucket (both are
linear), which gives the same score as the two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifterra.llm.columns import BLOCK_BYTES, blocks, held_out, text_bytes, trimmed

SIZES = (3, 4, 5, 6)
BITS = 17
BUCKETS = 1 << BITS
WINDOW = 3
DIM = 8
#: N-grams of fewer training texts keep an embedding of zero; weight decay of the rest.
MIN_TEXTS, DECAY = 3, 3e-6
#: How sharply the best windows of a text are preferred at the end of the training.
SHARPNESS = 1.0
#: Share of the largest gradient scale that is added to each one.
DAMPING = 0.1
#: Clean texts that one clean text of the balanced sample stands for when the offset is placed.
CLEAN_WEIGHT = 5
#: Bounds of the training sample: labelled rows of each class, and bytes of one text.
MAX_ROWS_PER_CLASS = 1200
MAX_TEXT_BYTES = 16_000
TRAIN_BLOCK = 1 << 18
#: Words of the texts that the training holds windows of at once.
TRAIN_WORDS = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 32
_LOWER[[33, 34, 40, 41, 44, 46, 58, 59, 63]] = 32  # ! " ( ) , . : ; ? end words as spaces do


def _grams(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: bucket by position, and whether a gram of one word starts there.

    ``raw`` is lower-cased and starts and ends with a space.
    """
    blank = raw == 32
    wide = raw.astype(np.uint32) + np.uint32(1)
    h = wide[:-1] * np.uint32(0x9E3779B1) + wide[1:]
    inner = ~blank[1:]  # no space strictly inside the gram so far
    for n in range(3, SIZES[-1] + 1):
        h = h[:-1] * np.uint32(0x85EBCA6B) + wide[n - 1 :]
        ok = inner[: len(h)].copy()
        inner = inner[:-1] & ~blank[n - 1 :][: len(inner) - 1] if n < SIZES[-1] else inner
        x = h ^ (h >> np.uint32(15))
        yield ((x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int32), ok


def _padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts lower-cased with one space before each and one after the last; their starts."""
    n = len(at) - 1
    out = np.full(len(raw) + n + 1, 32, np.uint8)
    place = np.ones(len(out), bool)
    starts = at + np.arange(n + 1)
    place[starts] = False
    out[place] = _LOWER[raw]
    return out, starts


def _words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start position of each word (the space before it) and its text."""
    blank = raw == 32
    first = np.flatnonzero(blank[:-1] & ~blank[1:])
    return first, np.searchsorted(starts, first, "right") - 1


def _sliding(total: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the sum over it and the next WINDOW - 1 words of its text."""
    out = total.copy()
    for k in range(1, min(WINDOW, len(total))):
        same = doc[k:] == doc[:-k]
        out[: len(total) - k] += total[k:] * same
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """One score per bucket, and the offset; what ``score_batch`` needs and nothing else."""

    scores: np.ndarray
    offset: float

    def score_texts(self, column: pa.Array, block: int = BLOCK_BYTES) -> np.ndarray:
        """Probability of label 1 for each text; no words: the offset alone.  A text of more
        than ``block`` bytes is read slice by slice."""
        raw, at = text_bytes(column)
        out = np.full(len(column), self.offset, np.float64)
        for lo, hi in blocks(at, block):
            own = raw[at[lo] : at[hi]]
            if len(own) > block:
                out[lo] += self._long(own, block)
                continue
            sums, counts, doc = self._word_sums(own, at[lo : hi + 1] - at[lo])
            if len(doc):
                mean = _sliding(sums, doc) / np.maximum(1, _sliding(counts, doc))
                some, first = np.unique(doc, return_index=True)
                out[lo + some] = np.maximum.reduceat(mean, first) + self.offset
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    def _word_sums(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of n-gram scores, n-grams, text) of each word."""
        low, starts = _padded(raw, at)
        begin, doc = _words(low, starts)
        total, count = np.zeros(len(low), np.float32), np.zeros(len(low), np.int8)
        for bucket, ok in _grams(low):
            total[: len(ok)] += np.where(ok, self.scores[bucket], np.float32(0))
            count[: len(ok)] += ok
        if not len(begin):
            return np.zeros(0), np.zeros(0, np.int64), doc
        return np.add.reduceat(total, begin, dtype=np.float64), np.add.reduceat(count, begin, dtype=np.int64), doc

    def _long(self, raw: np.ndarray, block: int) -> float:
        """Best window of one text, in slices that end at spaces; the last words of a slice
        are carried into the next."""
        best, sums, counts, lo = -np.inf, np.zeros(0), np.zeros(0, np.int64), 0
        while lo < len(raw):
            hi = min(lo + block, len(raw))
            while hi < len(raw):
                blank = np.flatnonzero(_LOWER[raw[hi : hi + 4096]] == 32)
                hi += int(blank[0]) if len(blank) else len(raw[hi : hi + 4096])
                if len(blank):
                    break
            s, c, _ = self._word_sums(raw[lo:hi], np.array([0, hi - lo]))
            sums, counts = np.concatenate([sums, s]), np.concatenate([counts, c])
            one = np.zeros(len(sums), np.int32)
            mean = _sliding(sums, one) / np.maximum(1, _sliding(counts, one))
            whole = max(0, len(mean) - WINDOW + 1) if hi < len(raw) else len(mean)  # the others go on
            best = max(best, mean[:whole].max(initial=-np.inf))
            sums, counts, lo = sums[whole:], counts[whole:], hi
        return best if best > -np.inf else 0.0


def train(texts: list[str], labels: np.ndarray, epochs: int = 60, seed: int = 7) -> ToxicityModel:
    """Fit embeddings and softmax together by Adam on the whole sample at each step.

    A text's gradient goes to its windows by their scores, first evenly, in the end to the
    most toxic ones; the two classes weigh alike.  A fifth of the sample is kept aside to place the offset.  No texts: score 1/2.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0 if not len(y) else (-3.0 if y[0] == 0 else 3.0))
    check, y_check = [], y[:0]
    if min(y.sum(), (1 - y).sum()) >= 10:
        aside = np.arange(len(y)) % 5 == 4
        check, y_check = [t for t, a in zip(texts, aside, strict=True) if a], y[aside]
        texts, y = [t for t, a in zip(texts, aside, strict=True) if not a], y[~aside]
    word_of, doc, grams, ends, texts_with = _bags(texts)
    if not len(word_of):
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0)
    some, first = np.unique(doc, return_index=True)
    y = y[some]
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    common = texts_with >= MIN_TEXTS  # others would only learn single texts by heart
    emb = (rng.normal(0, 0.02, (BUCKETS, DIM)) * common[:, None]).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, out, bias)]
    gram_word = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    parts = _parts(np.append(first, len(doc)), TRAIN_WORDS)
    grams_of = np.diff(ends).astype(np.int32)
    for step in range(1, epochs + 1):
        side = out[:, 1] - out[:, 0]
        margin = (emb @ side).astype(np.float32)
        word = np.bincount(gram_word, margin[grams], len(ends) - 1)
        g, pull_of = np.zeros(len(some)), np.zeros(len(ends) - 1)
        for lo, hi in parts:  # whole texts, so that what is kept for each window stays small
            own = slice(first[lo], first[hi] if hi < len(first) else len(doc))
            words_, doc_, first_ = word_of[own], doc[own], first[lo:hi] - first[lo]
            text_of = np.repeat(np.arange(hi - lo), np.diff(np.append(first_, len(doc_))))
            size = np.maximum(1, _sliding(grams_of[words_], doc_)).astype(np.float32)
            window = _sliding(word[words_], doc_) / size
            # windows share a text's gradient by their scores, ever more sharply
            sharp = np.exp(np.minimum(1.0, step / (0.7 * epochs)) * SHARPNESS * (window - np.maximum.reduceat(window, first_)[text_of]))
            share = sharp / np.add.reduceat(sharp, first_)[text_of]
            logit = np.add.reduceat(share * window, first_) + bias[1] - bias[0]
            g[lo:hi] = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[lo:hi]) * weight[lo:hi]
            # a word takes part in the windows that start at it and at the WINDOW - 1 before it
            each = _sliding((g[lo:hi][text_of] * share / size)[::-1], doc_[::-1])[::-1]
            np.add.at(pull_of, words_, each)
        flow = np.bincount(grams, pull_of[gram_word], BUCKETS)
        flow *= common
        pull = (flow @ emb).astype(np.float32)
        grads = ((flow[:, None] * side).astype(np.float32) + DECAY * emb, np.stack([-pull, pull], 1), np.array([-g.sum(), g.sum()], np.float32))
        for (m, v), value, grad in zip(moments, (emb, out, bias), grads, strict=True):
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            scale = np.sqrt(v / (1 - 0.98**step))
            # n-grams of few texts have small gradients and shall not move as far as others
            value -= 0.05 * (m / (1 - 0.9**step)) / (scale + DAMPING * scale.max() + 1e-8)
    model = ToxicityModel((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    return model if not check else _calibrated(model, check, y_check)


def _parts(bounds: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` words each, or of one text."""
    out, lo = [], 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' n-grams, once: (number of each word, text of each word, n-grams of word
    i at ends[i]:ends[i + 1], ends, texts that hold each n-gram)."""
    raw, at = text_bytes(pa.array(texts, pa.string()))
    number: dict[bytes, int] = {}
    word_of, docs = [], []
    for lo, hi in blocks(at, TRAIN_BLOCK):
        for i in range(lo, hi):
            words = _LOWER[raw[at[i] : at[i + 1]]].tobytes().split(b" ")
            mine = [number.setdefault(w, len(number)) for w in words if w]
            word_of.append(np.array(mine, np.int32))
            docs.append(np.full(len(mine), i, np.int32))
    word_of, doc = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (word_of, docs))
    texts_with = np.zeros(BUCKETS, np.int32)
    if not number:
        return word_of, doc, np.zeros(0, np.int32), np.zeros(1, np.int64), texts_with
    low = np.frombuffer(b" " + b" ".join(number) + b" ", np.uint8)
    begin, _ = _words(low, np.zeros(2, np.int64))
    grams, rows = [], []
    for bucket, ok in _grams(low):
        p = np.flatnonzero(ok)
        rows.append((np.searchsorted(begin, p, "right") - 1).astype(np.int32))
        grams.append(bucket[p])
    rows, grams = np.concatenate(rows), np.concatenate(grams)
    order = np.argsort(rows, kind="stable")
    grams, ends = grams[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(number)))])
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        w = np.unique(word_of[a:b])
        size = ends[w + 1] - ends[w]
        at_ = np.repeat(ends[w] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        texts_with[np.unique(grams[at_])] += 1
    return word_of, doc, grams, ends, texts_with


def _calibrated(model: ToxicityModel, texts: list[str], y: np.ndarray) -> ToxicityModel:
    """Move the offset to where texts not learnt from are told apart best (F1 at 1/2, clean texts weighted)."""
    p = np.clip(model.score_texts(pa.array(texts, pa.string())), 1e-12, 1 - 1e-12)
    logit = np.log(p / (1 - p))
    order = np.argsort(-logit)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.cumsum(np.where(y[order] > 0, 1, CLEAN_WEIGHT)) + y.sum())
    best = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[-1])
    low = logit[order[best + 1]] if best + 1 < len(y) else logit[order[best]] - 2
    return ToxicityModel(model.scores, model.offset - float(logit[order[best]] + low) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_class: int = MAX_ROWS_PER_CLASS, text_bytes_limit: int = MAX_TEXT_BYTES) -> ToxicityModel:
    """Train on a bounded sample: at most ``rows_per_class`` labelled rows of each class,
    in the order of a hash of the id, whose texts have at most ``text_bytes_limit`` bytes.

    Only rows whose crc32(doc_id) mod 5 is not 0 are learnt from.  Rows with a null id,
    text or label are left out.  The sample is the only thing that reaches the driver.
    """
    rows = bounded_sample(docs, labels, label, rows_per_class, text_bytes_limit)
    return train([r["text"] for r in rows], np.array([r["label"] for r in rows]))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, text_bytes_limit: int) -> list:
    """Rows (text, label); see ``fit_toxicity``.  First ids are chosen, then texts read."""
    may = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    may = may.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = [may.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for k in (0, 1)]
    ids = F.broadcast(ids[0].unionAll(ids[1]))  # at most 2 * rows_per_class rows
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes_limit)).join(ids, "doc_id")
    # repeated ids: one text of each, so the bound holds
    return sorted(texts.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("doc_id", "x.*").collect(), key=lambda r: r["doc_id"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, whole texts, in one pass.

    Only doc_id and text are read, so other columns may have any name.  A null or empty
    text gets the model's offset as its score; a null doc_id stays null and counts as
    held out; repeated rows give repeated results; an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), held_out(batch.column(0)), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(score), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose text the model scores below ``threshold``.

    Needs a text column only; null and empty texts stay unless the offset alone rejects.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score_texts(batch.column(place)) < threshold))

    return docs.mapInArrow(trimmed(keep), docs.schema)
