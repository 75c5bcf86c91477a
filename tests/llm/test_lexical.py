"""Block-Max WAND against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import duck, same_rows

from sifterra.llm import lexical
from sifterra.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, item_id string, score int, term int", "item_id long, text string, doc_id int, rank int"


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _plain(docs, items, k=10):
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(_terms(text))
    out = []
    for item, mine in asked.items():
        found = []
        for doc_id, c, size in counted:
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in mine if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def _frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 3, 4) for i, t in items], ITEMS)


def _same(spark, docs, items, **more):
    got = lexical.search(*_frames(spark, docs, items), **more)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _plain(docs, items, more.get("k", 10))


def _corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "日本", "A_b", "x1Y"]
    text = lambda m: rng.choice([" ", "-", "\n"]).join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(m))
    return [(i, text(rng.randrange(0, 40))) for i in range(n)], [(i, text(rng.randrange(0, 25))) for i in range(12)]


@pytest.mark.parametrize(("seed", "shard_bytes", "postings"), [(1, 1 << 20, 4), (2, 500, 128), (3, 1 << 20, 1)])
def test_random_corpora(spark, seed, shard_bytes, postings):
    docs, items = _corpus(seed, 400)
    random.Random(0).shuffle(docs)
    _same(spark, docs, items, shard_bytes=shard_bytes, postings=postings)


def test_nulls_ties_repeats_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 1000)
    docs = [(7, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (None, "beta alpha"), (None, None), (1, ""), (2, "?! _"), (9, "ALPHA " * 5000 + "gamma"), (10, "y" * 30_000), (11, "alpha\x00beta")]
    items = [(0, "alpha"), (1, "beta gamma Alpha"), (2, None), (3, ""), (None, "gamma"), (None, "alpha"), (4, "y" * 30_000), (5, "unknown")]
    _same(spark, docs, items)
    _same(spark, docs, items, k=2)


def test_empty_tables(spark):
    assert lexical.search(*_frames(spark, [], [(1, "a")])).collect() == []
    assert lexical.search(*_frames(spark, [(1, "a")], [])).collect() == []
    assert lexical.search(*_frames(spark, [(1, "..")], [(1, "a")])).collect() == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 5)
    docs, items = _corpus(5, 120)
    _same(spark, docs, items)


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**31, 2**40, 2**62, 5])
    raw, ends = lexical.packed(values)
    assert lexical.unpacked(raw).tolist() == values.tolist()
    assert ends[-1] == len(raw) and lexical.unpacked(raw[ends[2] : ends[5]]).tolist() == values[3:6].tolist()


def _one_shard(docs):
    made = lexical.ShardBuilder(lexical.Corpus(len(docs), sum(len(lexical.terms(t)) for _, t in docs)), 16)
    for doc_id, text in docs:
        made.add(doc_id, text)
    batch = made.rows(0)
    return lexical.Shard([tuple(batch.column(i)[j].as_py() for i in range(1, 5)) for j in range(batch.num_rows)], 16), batch


def test_most_blocks_are_never_decompressed():
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["common", "other", "more", f"r{rng.randrange(500)}"]) for _ in range(20)).encode()) for i in range(8000)]
    docs[4000] = (4000, b"needle common needle hay")
    shard, batch = _one_shard(docs)
    best = lexical.Best(1)
    lexical.search_shard(shard, {b"needle": 9000, b"hay": 9000, b"common": 300, b"other": 300}, best)
    assert best.rows[0][2] == 4000
    blocks = sum(shard.range[t][1] - shard.range[t][0] for t in (b"needle", b"hay", b"common", b"other"))
    assert 0 < shard.decoded < blocks / 20
    assert batch.column(4).nbytes < 6 * sum(len(set(t.split())) for _, t in docs)


def test_block_maximum_bounds_its_postings():
    docs, _ = _corpus(9, 300)
    shard, _ = _one_shard([(i, t.encode()) for i, t in docs if t])
    for b in range(len(shard.first)):
        doc, tf = shard.postings(np.array([b]))
        got = lexical.impact(tf, shard.norms[doc])
        assert got.max() == shard.top[b] and doc[0] == shard.first[b] and doc[-1] == shard.last[b] and (np.diff(doc) > 0).all()


def test_query_oracle(spark, sf_dir):
    same_rows(duck(sf_dir), QUERIES["op12_lexical"](spark, sf_dir), ORACLES["op12_lexical"])
