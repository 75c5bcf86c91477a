"""Jaccard join and embedding near-duplicates against brute force."""

import re
import time

import numpy as np
import pytest
from oracle import duck, same_rows

from sifterra.llm import hnsw, jaccard, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _brute(rows):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def _corpus(seed, n=120, groups=12):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    shared = " ".join(rng.choice(vocabulary, 20))
    texts = []
    for _ in range(groups):
        base = list(rng.choice(vocabulary, int(rng.integers(4, 60))))
        for _ in range(n // groups):
            words = list(base)
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
            texts.append(" ".join(words).upper() if rng.random() < 0.3 else " \n".join(words))
    texts += [f"{shared} {' '.join(rng.choice(vocabulary, 10))}" for _ in range(30)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_exact(spark, seed):
    rows = _corpus(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)


def test_large_groups_are_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_GROUP", 2)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 8)
    rows = _corpus(3, 150, 5)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)


def test_edge_rows(spark):
    t = "a b c d e f g h i j"
    rows = [(5, t), (5, t), (3, t.upper()), (None, t), (7, None), (8, ""), (9, " \t\n"), (10, "a b"), (11, "A\tB"), (None, "zz"), (12, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, component_id string, key int")
    got = jaccard.jaccard_components(docs).collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    kept = jaccard.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 7, 8, 9, 10, 12]


def test_signatures_agree_for_similar_sets():
    rng = np.random.default_rng(4)
    none = np.zeros(0, np.uint64)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        cut = int(rng.integers(0, max(1, len(a) // 5) + 1))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 5 + 1)), np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(a) != len(b) or cut:
            if 100 * both >= 80 * (len(a) + len(b) - both) and min(len(a), len(b)) >= 4:
                assert len(np.intersect1d(jaccard.signatures(a, none), jaccard.signatures(b, none)))
                common = a[:: 3]
                assert len(np.intersect1d(jaccard.signatures(a, common), jaccard.signatures(b, common)))


def test_jaccard_query_oracle(spark, sf_dir):
    same_rows(duck(sf_dir), queries.op7_jaccard(spark, sf_dir), queries.ORACLES["op7_jaccard"])


def test_embedding_query_oracle(spark, sf_dir):
    same_rows(duck(sf_dir), queries.op4_embeddings(spark, sf_dir), queries.ORACLES["op4_embeddings"])


def test_graphs_answer_the_query_at_every_size(spark):
    """Shards of a few dozen vectors, too, are searched by their graph; brute force agrees."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], np.float64)
    rng = np.random.default_rng(2)
    near = x[:60] + 0.01 * rng.standard_normal((60, x.shape[1])) * np.abs(x[:60]).mean()
    for part in (np.concatenate([x, near]), np.concatenate([x[:60], near[:30]])):
        n = len(part)
        unit = part / np.sqrt((part * part).sum(1))[:, None]
        want = ((unit @ unit.T >= 0.95).sum(1) - 1).tolist()
        blocks = tuple(spark.sparkContext.accumulator(0) for _ in range(2))
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(part)], "vec_id long, embedding array<double>")
        got = {r.vec_id: r.n_links for r in hnsw.embedding_components(frame, blocks=blocks).collect()}
        assert [got[i] for i in range(n)] == want and sum(want) >= 30
        assert blocks[0].value > 0 and blocks[1].value == 0


def test_graph_recall_on_clusters():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32))
    x = np.concatenate([c + rng.normal(size=(60, 32)) * 0.12 for c in centres] + [rng.normal(size=(800, 32))])
    x /= np.sqrt((x * x).sum(1))[:, None]
    graph = hnsw.Graph.loads(hnsw.build(x.astype(np.float32)).dumps(), x.astype(np.float32))
    a, b = hnsw._joined(hnsw.near(graph, x.astype(np.float32), x, x)[0])
    truth = x @ x.T >= 0.95
    assert truth[a, b].all() and len(a) >= 0.995 * truth.sum()


def test_dense_cluster_agrees_with_brute_force_in_bounded_time():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((5000, 64))
    x[:4000] = rng.standard_normal(64) / 8 + 0.025 * rng.standard_normal((4000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    graph = hnsw.build(x.astype(np.float32))
    assert len(np.unique(graph.owner)) < 2500  # the cluster has few nodes
    q = x[::5]
    began = time.perf_counter()
    truth = hnsw._brute(q, x, 0.95)
    brute = time.perf_counter() - began
    a, b = hnsw._joined(hnsw.near(graph, q.astype(np.float32), q, x)[0])
    assert time.perf_counter() - began < 21 * brute + 3
    assert len(a) == len(set(zip(a.tolist(), b.tolist()))) >= 0.995 * len(truth[0])
    assert (np.einsum("kd,kd->k", q[a], x[b]) >= 0.95 - 1e-12).all()


def test_spanning_unites_what_the_pairs_unite():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    root = {i: i for i in range(300)}
    for i, j in zip(a.tolist(), b.tolist()):
        low, high = sorted((root[i], root[j]))
        root = {k: low if v == high else v for k, v in root.items()}
    e = hnsw.spanning(a, b)
    assert {i: r for i, r in e.tolist()} == {i: r for i, r in root.items() if i != r}


def test_double_vectors_and_repeated_ids(spark):
    rows = [(1, [1e200, 0.0]), (1, [0.0, 1e-200]), (2, [2e200, 1e199]), (3, [0.0, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, hnsw.embedding_components(df).collect()))
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]


def test_embedding_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(4, v), (2, [2.0, 4.0, 6.0]), (4, v), (None, v), (9, None), (10, [0.0, 0.0, 0.0]), (11, [float("nan"), 1.0, 1.0]), (12, [1.0, None, 1.0]), (13, [1.0]), (17, [5.0]), (18, [-5.0]), (14, [-1.0, -2.0, -3.0]), (15, [float("inf"), 0.0, 0.0]), (16, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, n_links int")
    got = sorted(map(tuple, hnsw.embedding_components(df).collect()), key=str)
    assert got == sorted([(4, 3, 2, False), (2, 3, 2, True), (4, 3, 2, False), (None, 3, 2, False), (13, 1, 13, True), (17, 1, 13, False), *[(i, 0, i, True) for i in (9, 10, 11, 12, 14, 15, 16, 18)]], key=str)
    assert hnsw.embedding_components(df.limit(0)).count() == 0


def test_audit_notices_a_graph_that_finds_only_itself():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 24))
    x[1::2] = x[::2] + 0.02 * rng.standard_normal((300, 24))
    x /= np.sqrt((x * x).sum(1))[:, None]
    keys = np.arange(600)
    want = set(zip(*hnsw._brute(x, x, 0.95)))

    class Lost(hnsw.Graph):
        def search(self, q, beam):
            hit = (q @ self.x[:-1].T).argmax(1)
            ids, sims = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -2, np.float32)
            own = np.isclose((q * self.x[hit]).sum(1), 1, atol=1e-5)
            ids[own, 0], sims[own, 0] = hit[own], 1
            return ids, sims

    g = hnsw.build(x.astype(np.float32))
    assert len(want) > 600
    for graph in (g, Lost(g.x, g.layers, g.entry, g.owner, g.reach)):
        assert set(zip(*hnsw._joined(hnsw.near(graph, x.astype(np.float32), x, x, 0.95, (keys, keys))[0]))) == want
    # without any partner only perturbed copies can tell
    y = x[::2]
    h = hnsw.build(y.astype(np.float32))
    lost, seen = Lost(h.x, h.layers, h.entry, h.owner, h.reach), []
    lost.search = lambda q, beam: seen.append(beam) or Lost.search(lost, q, beam)
    assert hnsw.near(lost, y.astype(np.float32), y, y, 0.95, (keys[:300], keys[:300]))[1] > max(seen) == hnsw.BEAM
    a, b = hnsw._audit(x, x, 0.95, (keys, keys))
    assert len(a) >= 200 and (a != b).all()


def test_representatives_of_repeated_ids_ties_and_clashing_names(spark):
    a, b, c = ("one two three four five six seven", "uno dos tres cuatro cinco seis siete", "x y")
    rows = [(0, b), (1, a), (1, b), (2, a), (None, a), (None, c), (None, c), (5, None), (5, ""), (5, ""), (6, " \t"), (7, a + " "), (0, b)]
    docs = spark.createDataFrame([(*r, i, {"k": i}) for i, r in enumerate(rows)], "doc_id long, text string, __n int, row map<string,int>")
    kept = jaccard.keep_representatives(docs)
    assert kept.columns == docs.columns
    got = sorted((r["__n"], r["doc_id"], r["text"]) for r in kept.collect())
    # one row of each text group; rows without words all stay; the first of two equal rows
    assert [g[0] for g in got] == [0, 1, 5, 7, 8, 9, 10]
    assert jaccard.keep_representatives(docs.limit(0)).count() == 0
