"""Toxicity and quality: learning, edge rows, whole texts."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from sifterra.llm import quality, toxicity

WORDS = "the of and tion ing her that with for en ou er re st nd".split()
BAD = ["idiot", "moron", "stupid", "clown"]


def _texts(n, seed, make):
    rng = np.random.default_rng(seed)
    return [make(rng, i) for i in range(n)]


def _toxic(rng, i):
    words = [WORDS[j] + WORDS[k] for j, k in rng.integers(0, len(WORDS), (60, 2))]
    if i % 3 == 0:
        for p in rng.integers(0, 60, 2):
            words[p] = BAD[rng.integers(4)]
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    return toxicity.train(_texts(300, 1, _toxic), np.array([i % 3 == 0 for i in range(300)]))


def test_toxicity_held_out_accuracy(model):
    p = model.score_texts(pa.array(_texts(150, 2, _toxic)))
    assert ((p >= 0.5) == [i % 3 == 0 for i in range(150)]).mean() > 0.95


def test_misspelled_words_share_ngrams(model):
    base = " ".join(WORDS)
    p = model.score_texts(pa.array([base, base + " idiots", base + " idiott"]))
    assert p[0] < 0.5 < min(p[1:])


def test_last_words_of_very_long_texts_count(model):
    long_ = " ".join(WORDS * 20_000)
    p = model.score_texts(pa.array([long_, long_ + " you stupid idiot moron clown"]))
    assert p[0] < 0.5 < p[1]


def test_toxicity_scores_do_not_depend_on_the_batch(model):
    texts = [*_texts(20, 3, _toxic), "", None, "a", " \n\t"]
    alone = [model.score_texts(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(alone, model.score_texts(pa.array(texts, pa.string())), atol=1e-6)


def test_toxicity_query_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "idiot", None), (3, None, "y"), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == 5 and {r["predicted"] for r in got} == {0}
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.keep_clean(docs, model).count() == 5


def test_training_leaves_held_out_rows_alone(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, toxic int, quality int")
    got = toxicity.bounded_sample(docs, labels, "toxic", 10, 100)
    assert len(got) == 20 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)


def test_no_labels_is_no_crash(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).first()["score"] == 0.5
    assert quality.score_quality(docs, quality.fit_quality(docs, labels)).first()["score"] == 0.5


def _quality(rng, i):
    words = [WORDS[j] + WORDS[k] for j, k in rng.integers(0, len(WORDS), (80, 2))]
    return " ".join(w + "###" for w in words) if i % 3 == 0 else " ".join(words) + "."


def test_quality_learns_and_covers_chunks():
    model = quality.train(_texts(240, 4, _quality), np.array([i % 3 != 0 for i in range(240)]))
    texts = [*_texts(90, 5, _quality), "", None, "x" * 100_000]
    p = model.score_texts(pa.array(texts, pa.string()))
    assert ((p[:90] >= 0.5) == [i % 3 != 0 for i in range(90)]).mean() > 0.95
    alone = [model.score_texts(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(alone, p, atol=1e-5)


def test_quality_pooling_against_brute_force():
    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.normal(size=(256, quality.DIM)).astype(np.float32), rng.normal(size=(quality.WIDTH * quality.DIM, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), rng.normal(size=2 * quality.FILTERS).astype(np.float32), 0.1)
    text = bytes(rng.integers(97, 122, 700).astype(np.uint8)).decode()
    padded = np.zeros(3 * quality.CHUNK + quality.WIDTH, np.uint8)
    padded[:700] = np.frombuffer(text.encode(), np.uint8)
    pooled = []
    for c in range(3):
        starts = range(c * quality.CHUNK, (c + 1) * quality.CHUNK, quality.STRIDE)
        # windows lie within the text's own chunks
        rows = [model.emb[padded[s : s + quality.WIDTH]].reshape(-1) @ model.filters for s in starts if s + quality.WIDTH <= 3 * quality.CHUNK]
        pooled.append(np.maximum(np.max(rows, 0), 0))
    want = 1 / (1 + np.exp(-(np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)]) @ model.out + 0.1)))
    assert abs(model.score_texts(pa.array([text]))[0] - want) < 1e-4


def test_long_texts_score_alike_in_slices(model):
    rng = np.random.default_rng(4)
    words = _texts(40, 9, _toxic)
    net = quality.train(words, np.arange(40) % 2, epochs=2)
    for n in (300, 5000, 40_000):
        text = " ".join(rng.choice(" ".join(words).split(), n // 5))[:n] + " \u00e9" * 3
        for m in (model, net):
            whole = m.score_texts(pa.array([text, "a", text]))
            for block in (256, 700, 4096):
                assert np.allclose(m.score_texts(pa.array([text, "a", text]), block), whole, atol=1e-5)
    blank = pa.array([" " * 9000, "x" * 9000])
    assert np.allclose(model.score_texts(blank, 300), model.score_texts(blank))


def test_a_window_averages_several_words():
    assert toxicity.WINDOW > 1
    scores = np.zeros(toxicity.BUCKETS, np.float32)
    m = toxicity.ToxicityModel(scores + np.float32(1), 0.0)
    assert np.allclose(m.score_texts(pa.array(["aa bb cc dd"])), 1 / (1 + np.exp(-1)))
    total, doc = np.arange(1.0, 7.0), np.array([0, 0, 0, 0, 1, 1])
    assert toxicity._sliding(total, doc).tolist() == [6.0, 9.0, 7.0, 4.0, 11.0, 6.0]


def test_models_take_empty_tables_and_repeated_rows(spark, model):
    net = quality.train(_texts(20, 9, _toxic), np.arange(20) % 2, epochs=1)
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "idiot", None), (3, None, "y"), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    for scored in (toxicity.score_toxicity, quality.score_quality):
        m = model if scored is toxicity.score_toxicity else net
        got = scored(docs, m).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and sum(r["doc_id"] == 1 for r in got) == 2
        assert scored(docs.limit(0), m).count() == 0


def _plain_bucket(gram):
    """Bucket of 3 to 6 bytes, by 32-bit arithmetic."""
    h = ((gram[0] + 1) * 0x9E3779B1 + gram[1] + 1) % 2**32
    for b in gram[2:]:
        h = (h * 0x85EBCA6B + b + 1) % 2**32
    return ((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> (32 - toxicity.BITS)


def _plain_score(model, text):
    """Bags of the n-grams of three words from each word on, their average, the best window."""
    blank = set(b" \t\n\x0b\f\r!\"(),.:;?")
    s = bytes([32, *(32 if b in blank else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()), 32])
    words = []  # scores of the n-grams of each word
    for p in range(len(s) - 1):
        if s[p] == 32 and s[p + 1] != 32:
            words.append([])
        for n in range(3, 7):
            if p + n <= len(s) and 32 not in s[p + 1 : p + n - 1]:
                words[-1].append(float(model.scores[_plain_bucket(s[p : p + n])]))
    best = max((sum(map(sum, words[i : i + 3])) / max(1, sum(map(len, words[i : i + 3]))) for i in range(len(words))), default=0.0)
    return 1 / (1 + np.exp(-(best + model.offset)))


def test_toxicity_against_plain_loops(spark, sf_dir):
    """Buckets, words, windows and averages of whole texts, without any array arithmetic."""
    rng = np.random.default_rng(11)
    model = toxicity.ToxicityModel(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.7)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted(rows, key=lambda r: len(r.text or ""))[:120]
    texts = [r.text for r in rows] + ["", None, "a", " a", "A, b! c", "x  y\tz", "\u00e9\u00df", "?!", "one two", "ab" * 50]
    got = model.score_texts(pa.array(texts, pa.string()))
    assert np.allclose(got, [_plain_score(model, t) for t in texts], atol=1e-5)
    assert len(set(np.round(got, 3))) > 60


def test_toxicity_training_in_parts_gives_the_same_model(monkeypatch):
    import random

    from sifterra.llm import toxicity

    rng, kept = random.Random(2), []
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 30, 200]))) + " bad" * (i % 2) for i in range(60)]
    plain = toxicity._sliding
    monkeypatch.setattr(toxicity, "_sliding", lambda total, doc: kept.append(len(total)) or plain(total, doc))
    models = []
    for words in (1 << 18, 250, 1):
        kept.clear()
        monkeypatch.setattr(toxicity, "TRAIN_WORDS", words)
        models.append((toxicity.train(texts[:9], np.arange(9) % 2, epochs=4), max(kept)))
    assert all((m.scores == models[0][0].scores).all() and m.offset == models[0][0].offset for m, _ in models)
    assert models[0][1] > 250 >= models[1][1] >= models[2][1]
