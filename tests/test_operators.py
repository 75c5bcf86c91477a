"""Operators on small tables: invariants, ties, nulls and empty inputs."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sifterra.functions import text as tx
from sifterra.operators import agreement, assignment, dedup, restructure, sampling
from sifterra.operators.components import connected_components
from sifterra.sources import readers, sinks
from sifterra.streaming import incremental


def test_components_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    got = dict(connected_components(spark.createDataFrame(edges + [(None, 3), (7, 7)], "src long, dst long").repartition(5)).collect())
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {n: find(n) for e in edges for n in e if e[0] != e[1] or any(n in x and x[0] != x[1] for x in edges)}
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sample_is_a_partition_of_the_input(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 7).alias("c"))
    out = sampling.stratified_sample(rows, "g", ["c"], 40, "id").toPandas()
    assert len(out) == 500 and (out[out.sampled].groupby("g").size() == 40).all()


def test_assignment_covers_each_batch_twice(spark):
    batches = [(f"batch_{i:03d}", "art" if i % 5 == 0 else "math", 50 - i % 3) for i in range(60)]
    groups = assignment.Groups(list("abcdefg"), ["a", "b"], {"art": ["c", "d"]})
    got = assignment.assign(batches, groups)
    rows = spark.createDataFrame([(p, b) for p, bs in got.items() for b in bs], "annotator string, batch_id string")
    assert assignment.coverage(rows).count() == 0 and rows.count() == 120
    assert not set(got["a"]) & set(got["b"])
    assert all(b in got["c"] + got["d"] for b, s, _ in batches if s == "art")


def test_idempotent_transforms(spark):
    df = spark.createDataFrame([("a “q” b",), ("x _____ y ---- z",), ("کتاب abc 12 کتاب",), ("",), (None,), ("$a?$ b? c",)], "x string")
    for change in (tx.normalize_quotes, tx.normalize_blanks, tx.strip_bidi, tx.clean_text, lambda x: tx.outside_math(x, tx.normalize_punctuation), tx.isolate_left_to_right):
        once = df.withColumn("y", change(F.col("x")))
        assert once.where(~F.col("y").eqNullSafe(change(F.col("y")))).count() == 0


def test_exact_dedup_rules(spark):
    rows = spark.createDataFrame([(1, "k", 1, "s1"), (2, "k", None, "s2"), (3, "d", 1, "s1"), (4, "d", 0, "s1"), (5, "", 1, "s1"), (6, "z", None, None)], "id long, k string, a int, s string")
    got = {r["dedup_key"]: (r["id"], r["n_rows"], r["sources"]) for r in dedup.exact_dedup(rows, F.col("k"), "a", "id", "s", True).collect()}
    assert got == {"k": (1, 2, ["s1", "s2"]), "z": (6, 1, None), "": (5, 1, ["s1"])}


def test_verdicts(spark):
    rows = spark.createDataFrame([(["A"], False), (["A", "A"], True), (["A", "unsure"], False), (["A", None], False), (["A", "B"], False), (["A", "A"], False)], "p array<string>, f boolean")
    got = [r[0] for r in rows.select(agreement.verdict(F.col("p"), F.col("f"), list("ABCD"))).collect()]
    assert got == ["single_annotated", "flagged", "unsure", "invalid", "disagree", "include"]


def test_contiguous_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(9)
    got = restructure.contiguous_ids(rows, ["x"]).toPandas()
    assert (got.x == got.id).all()


def test_lettered_goes_past_z(spark):
    df = spark.range(1).select(restructure.lettered(F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: i.cast("string"))).alias("m"))
    assert list(df.first()["m"])[-3:] == ["Z", "AA", "AB"]


def test_zip_sources(spark):
    df = spark.createDataFrame([(["Book", "x"], ["", "https://www.Site.org/a"])], "n array<string>, u array<string>")
    got = df.select(restructure.zip_sources(F.col("n"), F.col("u"), {"Book": "https://book.example"}, {}).alias("z")).first()["z"]
    assert [(r["name"], r["url"]) for r in got] == [("Book", "https://book.example"), ("Site", "https://www.Site.org/a")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "Ann__batch_001.json").write_text('{"annotator": "Ann", "batch_id": "batch_001", "annotations": [{"annotator": "Ann", "batch_id": "batch_001", "mcq_id": 5, "selected_key": "B"}]}')
    got = readers.envelopes(spark, str(tmp_path / "a"))
    row = got.first()
    assert (row["mcq_id"], row["selected_key"], row["pos"]) == (5, "B", 0)
    (tmp_path / "q.json").write_text('[{"id": 1, "question": "x"}, {"id": 2}]')
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "q.json").write_text("[{")
    assert readers.json_array(spark, str(tmp_path / "q.json")).count() == 2
    sinks.kept_and_dropped(spark.createDataFrame([(1, None), (2, "r")], "i int, drop_reason string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/kept")).count() == 1
    paths = spark.createDataFrame([("x/2-a/f",), ("x/10-b/f",), ("x/9-c/f",)], "path string")
    assert readers.latest_stage(paths).first().asDict() == {"path": "x/10-b", "stage": 10}
    assert readers.latest_stage(paths, names=("f",)).first()["stage"] == 10
    more = paths.union(spark.createDataFrame([("x/3-c/with.json",), ("x/4-d/other.json",), ("top.json",)], "path string"))
    assert readers.latest_stage(more, names=("with.json", "without.json")).first().asDict() == {"path": "x/3-c", "stage": 3}
    assert readers.latest_stage(more, names=("none",)).first()["stage"] == 10 and readers.latest_stage(paths.limit(0)).collect() == []


def test_page_questions(spark):
    html = "<h3>One <b>q</b>?</h3><ol><li>a</li><li>b</li></ol>Answer: B<h3>Two</h3><ol><li>c</li></ol>"
    got = readers.page_questions(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("pos").collect()
    assert [(r["question"], r["options"], r["answer"]) for r in got] == [("One q?", ["a", "b"], "B"), ("Two", ["c"], "")]


def test_inference_stub_and_breaker(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "id long, p string").coalesce(1)
    out = incremental.infer(df, lambda ps: [p.upper() for p in ps], "p", "id").toPandas()
    assert out.prediction.tolist() == [f"P{i}" for i in range(30)]

    def broken(ps):
        raise RuntimeError("down")

    out = incremental.infer(df, broken, "p", "id", 2).toPandas()
    assert out.error.all() and (out.prediction == "ERROR: given up").sum() == 20


def test_streaming_upsert_and_windows(spark, tmp_path):
    schema = "k string, v int, ts timestamp"
    (tmp_path / "in").mkdir()
    pd.DataFrame({"k": ["a", "b"], "v": pd.array([1, 2], "int32"), "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:30"]).astype("datetime64[us]")}).to_parquet(tmp_path / "in" / "1.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(incremental.upsert(["k"], ["ts", "v"], str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.schema(schema).parquet(str(tmp_path / "t/v0")).count() == 2
    w = incremental.windowed_counts(stream, "ts", "k")
    q = w.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert set(spark.table("w").columns) == {"start", "k", "n"}


@pytest.mark.parametrize("name,want", [("Answer key: B", "B"), ("ERROR: x", None), ("", None), (None, None), ("no letter here", None)])
def test_parse_key(spark, name, want):
    assert spark.createDataFrame([(name,)], "x string").select(tx.parse_key(F.col("x"))).first()[0] == want


def test_full_sweep_against_brute_force(spark, tmp_path):
    from sifterra.plans import QUERIES

    rng = random.Random(5)
    texts = []
    for g in range(25):
        base = [f"g{g}x{i}" for i in range(rng.randrange(4, 30))] + [f"c{rng.randrange(8)}" for _ in range(3)]
        for _ in range(5):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: frozenset(t.split()) for i, t in rows}
    df = {}
    for s in sets.values():
        for w in s:
            df[w] = df.get(w, 0) + 1
    assert max(df.values()) <= 200 and min(map(len, sets.values())) >= 4
    want = []
    for threshold in (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0):
        root = list(range(len(rows)))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for i in sets:
            for j in range(i):
                if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        removed = sum(find(i) != i for i in sets)
        want.append((threshold, len(rows) - removed, removed))
    assert len({r for *_, r in want}) > 5
    assert sorted(map(tuple, QUERIES["threshold_sweep_full"](spark, str(tmp_path)).collect())) == want


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, v int"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    incremental.upsert(["k"], ["v"], path)(batch(("a", 1), ("b", 2)), 0)
    again = incremental.upsert(["k"], ["v"], path)  # a new process knows nothing
    again(batch(("a", 5), ("c", 3)), 1)
    again(batch(("z", 9)), 1)  # a replayed epoch changes nothing
    assert sorted(map(tuple, spark.read.parquet(f"{path}/v1").collect())) == [("a", 5), ("b", 2), ("c", 3)]
    incremental.upsert(["k"], ["v"], path)(batch(("b", 1)), 2)
    assert spark.read.parquet(f"{path}/v2").count() == 3 and not (tmp_path / "t" / "v0").exists()


def test_a_failed_write_leaves_the_old_result(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.json_lines(spark.range(3), path)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.json_lines(bad, path)
    assert spark.read.json(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]
    sinks.json_lines(spark.range(5), path)
    assert spark.read.json(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_nothing_is_left_when_a_result_is_written(spark, sf_dir, tmp_path):
    from pathlib import Path

    from sifterra import storage
    from sifterra.plans import QUERIES

    root = Path(storage.shared_dir(spark).removeprefix("file://")) / "sifterra"
    storage.clear(spark)  # of the tests before
    before = set(root.iterdir()) if root.exists() else set()  # of other processes
    QUERIES["fuzzy_dedup"](spark, sf_dir).write.parquet(str(tmp_path / "out"))
    assert set(root.iterdir()) > before
    storage.clear(spark)
    assert set(root.iterdir()) <= before and spark.read.parquet(str(tmp_path / "out")).count() > 0


def _noted(seed: int, named: bool):
    """Rows (item, who, pick) with missing picks, items and annotators; one item has them all."""
    rng = random.Random(seed)
    people = [f"ä{i}" if named else i * 7 for i in range(40)]
    rows = [(i, p, rng.choice(["a", "b", "c", None])) for i in range(12) for p in people if i == 3 or rng.random() < 0.5]
    return [*rows, (50, people[0], None), (50, people[1], "a"), (51, people[2], "b"), (None, people[0], "a"), (None, people[1], "a"), (4, None, "a")]


def _counted(rows):
    agree, total, ok = {}, {}, [r for r in rows if r[0] is not None and r[1] is not None]
    for i, p, x in ok:
        for j, q, y in ok:
            if i == j and p < q:
                total[p, q] = total.get((p, q), 0) + 1
                agree[p, q] = agree.get((p, q), 0) + (x is not None and x == y)
    return {(*k, agree[k], n) for k, n in total.items()}


@pytest.mark.parametrize("named", [False, True])
def test_pairs_of_annotators_are_not_moved_where_items_are_shared_by_many(spark, monkeypatch, named):
    from sifterra.operators import agreement as ag

    rows = _noted(1, named)
    df = spark.createDataFrame(rows, f"item long, who {'string' if named else 'long'}, pick string")
    for least, chunk, joined in ((10**6, 100, True), (5, 100, False), (5, 10**6, False), (2, 1, False)):
        monkeypatch.setattr(ag, "MIN_BLOCKS", least)
        monkeypatch.setattr(ag, "CHUNK", chunk)
        out = ag._pairs_by_blocks(df.where("item is not null and who is not null"), least) if least < 10 else ag.pair_agreement(df, "item", "who", "pick")
        assert {(r["first"], r["second"], r["agree"], r["total"]) for r in out.collect()} == _counted(rows) and out.count() == len(_counted(rows))
        assert ("Join" in out._jdf.queryExecution().toString()) == joined
    monkeypatch.setattr(ag, "MIN_BLOCKS", 2)  # 12 items of some 20 annotators: blocks move less
    assert "Join" not in ag.pair_agreement(df, "item", "who", "pick")._jdf.queryExecution().toString()


def test_disagreements_with_missing_picks(spark):
    from sifterra.operators import agreement as ag

    rows = _noted(2, False)
    ok, want = [r for r in rows if r[0] is not None and r[1] is not None], set()
    for p in {r[1] for r in ok}:
        pairs = [(x, y) for i, who, x in ok if who == p for j, other, y in ok if i == j and other != p]
        both = [x != y for x, y in pairs if x is not None and y is not None]
        if len(pairs) >= 10:
            want.add((p, sum(both) if both else None, len(pairs)))
    got = ag.disagreements(spark.createDataFrame(rows, "item long, who long, pick string"), "item", "who", "pick", 10)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.85, 0.95])
def test_whole_sets_travel_for_few_more_pairs_than_there_are(spark, monkeypatch, threshold):
    from sifterra.operators import dedup as dd

    rng = random.Random(4)
    rows, common = [], [f"c{k}" for k in range(150)]
    for g in range(30):  # groups of near copies, and rows that share rare tokens only
        base = rng.sample(common, 20) + [f"r{rng.randrange(60)}" for _ in range(rng.choice([3, 40, 150]))] + [f"g{g}x{k}" for k in range(rng.choice([3, 40, 200]))]
        for k in range(6):
            words = list(dict.fromkeys([*base, *[f"c{x}" for x in range(rng.randrange(5))]]))
            gone = rng.choice([0, 0, 0.05, 0.3])
            rows.append((g * 10 + k, [w for w in words if rng.random() >= gone]))
    rows += [(900, None), (901, []), (902, ["c1", "c2"])]
    sets = {n: set(w) for n, w in rows if w and len(w) >= 4}
    df = {}
    for s in sets.values():
        for w in s:
            df[w] = df.get(w, 0) + 1
    rare = {w for w, k in df.items() if k <= 60}
    want = {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and sets[i] & sets[j] & rare and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}
    made, plain = {}, dd.materialize

    def keep(d, name="table"):
        made[name] = plain(d, name)
        return made[name]

    monkeypatch.setattr(dd, "materialize", keep)
    monkeypatch.setattr(dd, "discard", lambda d: None)
    monkeypatch.setattr(dd, "MET_PAIRS", 50)
    monkeypatch.setattr(dd, "HOT_TOKENS", 100)
    got = dd.jaccard_pairs(spark.createDataFrame(rows, "n long, w array<string>"), "n", F.col("w"), threshold, stop_df=60)
    assert {(r["i"], r["j"], r["inter"]) for r in got.collect()} == want
    assert len(want) > 20
    assert len(want) <= made["near"].count() <= (3 if threshold >= 0.5 else 9) * len(want)


@pytest.mark.parametrize("threshold, links", [(0.5, False), (0.7, True), (0.85, False), (1.0, True)])
def test_pairs_that_share_frequent_tokens_only_and_copies_are_found(spark, monkeypatch, threshold, links):
    from sifterra.operators import dedup as dd

    rng = random.Random(5)
    rows, common, rare = [], [f"c{k}" for k in range(30)], [f"r{k}" for k in range(300)]
    for k in range(200):  # rows of frequent tokens only, of both, and of rare ones, and copies of all
        words = [*rng.sample(common, rng.choice([4, 6, 15, 25])), *rng.sample(rare, rng.choice([0, 0, 1, 5]))] if k % 5 else rng.sample(rare, 6)
        rows += [(1000 * c + k, rng.sample(words, len(words))) for c in range(rng.choice([1, 1, 2, 6]))]
    rows += [(9000, None), (9001, []), (9002, ["c1", "c2"]), (9003, ["c1", "c2"])]
    sets = {n: frozenset(w) for n, w in rows if w and len(w) >= 4}
    want = {(i, j, len(sets[i] & sets[j]), len(sets[i]), len(sets[j])) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}
    for hot, least, block in ((200_000, 200, 8192), (20, 10, 7)):
        for name, value in (("HOT_TOKENS", hot), ("RARE", least), ("BLOCK_ROWS", block), ("MET_PAIRS", 50)):
            monkeypatch.setattr(dd, name, value)
        out = [tuple(r) for r in dd.jaccard_pairs(spark.createDataFrame(rows, "n long, w array<string>"), "n", F.col("w"), threshold, links=links).select("i", "j", "inter", "n_i", "n_j").collect()]
        assert len(out) == len(set(out)) and set(out) <= want
        if not links:
            assert set(out) == want
        assert _parts(sets, out) == _parts(sets, want)


def _parts(nodes, pairs):
    """Smallest node that each of ``nodes`` reaches by ``pairs``."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, j, *_ in pairs:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def frequent(spark, tmp_path_factory):
    """Documents 0 to 229 share all of their five words, 230 to 449 five of six; each word is in more than 200."""
    path = str(tmp_path_factory.mktemp("frequent"))
    texts = ["one two three four five" if k < 230 else "six seven eight nine ten " + ("one" if k % 2 else "two") for k in range(450)]
    spark.createDataFrame([(k, x, "en", f"s{k % 3}") for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(450)], "doc_id long, quality long").write.parquet(f"{path}/labels.parquet")
    return path


def test_fuzzy_pairs_of_frequent_words(spark, frequent):
    from sifterra.plans import QUERIES

    got = [tuple(r) for r in QUERIES["fuzzy_pairs"](spark, frequent).select("i", "j", "inter", "n_i", "n_j").collect()]
    want = {(i, j, 5, 5, 5) for j in range(230) for i in range(j)} | {(i, j, 6, 6, 6) for j in range(230, 450) for i in range(230, j) if (i - j) % 2 == 0}
    assert set(got) == want and len(got) == len(want)


def test_fuzzy_dedup_of_frequent_words(spark, frequent):
    from sifterra.plans import QUERIES

    assert {tuple(r) for r in QUERIES["fuzzy_dedup"](spark, frequent).select("doc_id", "group_size").collect()} == {(0, 230), (230, 110), (231, 110)}


def test_threshold_sweep_of_frequent_words(spark, frequent):
    from sifterra.plans import QUERIES

    got = {tuple(r) for r in QUERIES["threshold_sweep"](spark, frequent).select("threshold", "kept", "removed").collect()}
    assert got == {(t, 3, 447) for t in (0.85, 0.9, 0.95, 1.0)}


def test_threshold_sweep_full_of_frequent_words(spark, frequent):
    from sifterra.plans import QUERIES

    got = {tuple(r) for r in QUERIES["threshold_sweep_full"](spark, frequent).select("threshold", "kept", "removed").collect()}
    assert got == {(t, 2 if t <= 0.7 else 3, 448 if t <= 0.7 else 447) for t in (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)}


def test_correlated_dedup_of_frequent_words(spark, frequent):
    from sifterra.plans import QUERIES

    got = {(r["doc_id"], r["group_size"], r["sources"]) for r in QUERIES["correlated_dedup"](spark, frequent).collect()}
    assert got == {(0, 230, "s0,s1,s2"), (230, 110, "s2,s1,s0"), (231, 110, "s0,s2,s1")}


def test_rows_go_packed_to_the_blocks_of_annotators(spark):
    from sifterra.operators import agreement as ag

    rows = spark.range(60_000).selectExpr("id * 31 % 997 as item", "id div 60 as who", "elt(cast(id * 7 % 5 as int) + 1, 'click', 'view', 'error', 'signup', 'purchase') as pick")
    plan = ag._pairs_by_blocks(rows, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "pick" not in plan.split("Generate explode")[0]  # what is repeated has no plain rows
    packed = ag._packed(rows, 3).selectExpr("count(distinct g)", "sum(length(data))").first()
    assert packed[0] == 3 and packed[1] < 6 * 60_000
