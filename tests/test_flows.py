"""Scraping, crawling, inference, decoding, publishing and the combining flows by value."""

import json
import os
import random
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifterra.functions import replies
from sifterra.functions import text as tx
from sifterra.operators import charts, counters
from sifterra.operators import records as rc
from sifterra.operators import sampling as sm
from sifterra.sources import crawl, dom, published, readers
from sifterra.streaming import inference, pages
from sifterra.streaming.breaker import STORE, breaker

# a tree of nested lists, built without numbers or intervals


class Plain(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.root = {"tag": None, "up": None, "kids": [], "attrs": {}}
        self.at = self.root
        self.order = []
        self.feed(html)
        self.close()

    def _node(self, **x):
        node = {"up": self.at, "kids": [], **x}
        self.at["kids"].append(node)
        self.order.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._node(tag=tag, attrs=dict(attrs))
        if tag not in dom.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        up = self.at
        while up is not None and up["tag"] != tag:
            up = up["up"]
        if up is not None:
            self.at = up["up"]

    def handle_data(self, data):
        if self.at["tag"] not in dom.NO_TEXT:
            self._node(tag="#text", attrs={}, text=data)

    def below(self, node):
        for k in node["kids"]:
            yield k
            yield from self.below(k)

    def has(self, node, tag, cls):
        return node["tag"] == tag and cls in (node["attrs"].get("class") or "").split()

    def block(self, h2):
        up = h2["up"]
        for _ in range(6):
            if up is None:
                break
            found = next((n for n in self.below(up) if self.has(n, "div", "excerpt")), None)
            if found:
                return found
            up = up["up"]
        after = [id(n) for n in self.order].index(id(h2))
        return next((n for n in self.order[after + 1 :] if self.has(n, "div", "excerpt")), None)


def _random_html(rng):
    parts = ["<div>", "</div>", '<div class="excerpt x">', "<p>", "</p>", "text ", "<br>", "<b/>", "</h2>", '<h2 class="is-title">', '<a href="/x">q</a>', "<i>", "</i>", "A. one<br>", "<strong>B) two</strong>", "<!-- C. no -->", "<script>D. no</script>", "&amp;", "</nothing>", "submitted by: me<br>"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(60)))


def test_trees_and_blocks_against_nested_lists():
    rng, blocks = random.Random(3), 0
    for _ in range(400):
        html = _random_html(rng)
        tree, plain = dom.Tree(html), Plain(html)
        assert tree.tag == [n["tag"] for n in plain.order]
        place = {id(n): i for i, n in enumerate(plain.order)}
        assert tree.parent == [place.get(id(n["up"]), -1) for n in plain.order]
        assert tree.last == [max([i, *(place[id(k)] for k in plain.below(n))]) for i, n in enumerate(plain.order)]
        known = [i for i, n in enumerate(plain.order) if plain.has(n, "div", "excerpt")]
        for i, n in enumerate(plain.order):
            if plain.has(n, "h2", "is-title"):
                want = plain.block(n)
                assert tree._block_of(i, known) == (None if want is None else place[id(want)])
                blocks += want is not None
    assert blocks > 100


def test_quiz_titles_with_cut_and_other_entities(spark, tmp_path):
    from oracle import duck, same_rows

    from sifterra.plans import ORACLES, QUERIES

    titles = ["cut &amp", "token = &quot;a1", "a &lt;b&gt; &amp;amp; c", "raw <b>x</b> & y", "&copy 5 &#39;", "plain"]
    rows = [(i, f'<title>{x}</title><a href="/a?b=1&amp;c">x</a><a href="/p&q">y</a><a href="/r&lt">z</a>') for i, x in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    same_rows(duck(str(tmp_path)), QUERIES["dom_questions"](spark, str(tmp_path)), ORACLES["dom_questions"])


def test_dom_of_nulls_and_repeats(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "<li>x"), (None, "<li>x")], "page_id long, html string")
    assert dom.titled_questions(rows).collect() == []
    got = [(r.page_id, r.node, r.parent, r.last, r.depth, r.tag, r.text) for r in dom.nodes(rows).collect()]
    assert got == [(None, 0, -1, 1, 0, "li", None), (None, 1, 0, 1, 1, "#text", "x")] * 2


LINKS = ["a", "./a", "../a", "../../../a", "/a/./b/../c", "", "?q", "#f", "a?x#y", "//h.org/b/../c", "https://o.org/x/", "HTTP://o.org/y", "mailto:x@y", "..", ".", "a/", "/", "a/../", "b;p/../c", "?a/../b"]
BASES = ["http://s.org/c/d/e.html", "http://s.org", "https://s.org/", "http://s.org/c/?q=1#t", "http://s.org/a/b/"]


def test_links_resolve_as_the_standard_library_has_it(spark):
    rows = spark.createDataFrame([(b, x) for b in BASES for x in LINKS], "b string, x string")
    for b, x, got in rows.select("b", "x", crawl.resolved(F.col("b"), F.col("x"))).collect():
        assert got.lower() == urldefrag(urljoin(b, x))[0].lower(), (b, x)


def test_crawl_of_cycles_seeds_and_nothing(spark, monkeypatch):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("a", "c"), ("c", "c"), ("x", "y"), ("c", None)]
    links = spark.createDataFrame([(u, i, v) for i, (u, v) in enumerate(edges)], "url string, pos long, link string").where("link is not null")
    seeds = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "url string")
    got = crawl.crawl(links, seeds, F.lit(True)).collect()
    assert sorted((r.url, r.level, r.parent) for r in got) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("z", 0, None)]
    assert crawl.crawl(links, seeds.limit(0), F.lit(True)).collect() == []
    monkeypatch.setattr(crawl, "KEPT", 2)  # levels are put together on the way
    chain = spark.range(9).selectExpr("cast(id as string) as url", "0L as pos", "cast(id + 1 as string) as link")
    got = crawl.crawl(chain, spark.createDataFrame([("0",), ("4",)], "url string"), F.lit(True)).collect()
    assert sorted((r.url, r.level) for r in got) == [(str(i), i % 4) for i in range(8)] + [("8", 4), ("9", 5)]
    with pytest.raises(RuntimeError, match="levels"):
        crawl.crawl(spark.range(9).selectExpr("cast(id as string) as url", "0L as pos", "cast(id + 1 as string) as link"), spark.createDataFrame([("0",)], "url string"), F.lit(True), 3)


def _samples(spark, n, parts=3):
    return spark.range(n).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).repartition(parts)


def test_inference_with_random_failures_and_a_killed_job(spark, tmp_path):
    mark, path = str(tmp_path / "killed"), str(tmp_path / "answers")

    def client(prompts):
        if "p77" in prompts and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)  # the worker dies in the middle of a flush
        if random.random() < 0.4:
            raise ConnectionError("down")
        return [(f"a{p}", {"input": 2, "output": None}) for p in prompts]

    samples = _samples(spark, 200)
    how = {"flush_rows": 60, "batch": 7, "retries": 30, "wait": 0}
    with pytest.raises(Exception, match="."):
        inference.run(samples, client, path, **how)
    before = inference.results(spark, path, "id", T.LongType()).count()
    assert os.path.exists(mark) and before < 200
    done = inference.run(samples, client, path, **how)
    rows = inference.results(spark, path, "id", T.LongType()).collect()
    assert sorted(r.id for r in rows) == list(range(200)) and all(r.prediction == f"ap{r.id}" and not r.error for r in rows)
    folders = inference._committed(spark, path)
    assert sum(spark.read.parquet(f).count() for f in folders) == 200  # nothing was committed twice
    assert sum(d["answered"] for d in done) == 200 - before == sum(d["input"] for d in done) / 2 and all(d["errors"] == 0 for d in done)
    assert inference.run(samples, client, path, **how) == []


def test_inference_halts_and_goes_on(spark, tmp_path):
    path, samples = str(tmp_path / "answers"), _samples(spark, 40, 1)
    broken = lambda ps: ["ERROR: x"] * len(ps)
    with pytest.raises(inference.Halted):
        inference.run(samples, broken, path, batch=3, halt_after=5)
    rows = inference.results(spark, path, "id", T.LongType())
    assert rows.count() == 5 and rows.where("error").count() == 5
    good = lambda ps: ["", *["ok"] * (len(ps) - 1)]
    done = inference.run(samples, good, path, batch=10)
    assert (done[0]["asked"], done[0]["errors"]) == (40, 4)
    assert sorted(r.id for r in inference.results(spark, path, "id", T.LongType()).collect()) == list(range(40))
    assert [d["asked"] for d in inference.run(samples, good, path, batch=10)] == [4]
    assert inference.run(samples, good, path, again=False) == []
    short = lambda ps: ["x"]
    late = inference.run(spark.createDataFrame([(99, None), (98, "p")], "id long, prompt string"), short, path, retries=2, wait=0, batch=2)
    assert late[0]["errors"] + late[0]["answered"] >= 2


def test_breaker_over_batches_and_a_restart(spark, tmp_path):
    session = spark.newSession()
    for k, v in (STORE | {"spark.sql.shuffle.partitions": "2"}).items():
        session.conf.set(k, v)
    rng = random.Random(8)
    rows = [(k, i, rng.random() < 0.6 if rng.random() < 0.9 else None) for i, k in enumerate(rng.choice("abc") for _ in range(120))]
    (tmp_path / "in").mkdir()

    def feed(name, part):
        pd.DataFrame({"k": [r[0] for r in part], "i": [r[1] for r in part], "e": pd.array([r[2] for r in part], "boolean")}).to_parquet(tmp_path / "in" / name)

    def run():
        stream = session.readStream.schema("k string, i long, e boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = breaker(stream, "k", "i", "e", 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    feed("1.parquet", random.Random(1).sample(rows[:50], 50))
    run()
    feed("2.parquet", rows[50:80])
    run()  # a new query from the checkpoint
    feed("3.parquet", rows[80:])
    run()
    want, state = [], {}
    for k, i, e in rows:
        n = state.get(k, 0)
        halted = n >= 3
        state[k] = n if halted else n + 1 if e else 0
        want.append((k, i, state[k], halted))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.k, r.i, r.in_a_row, r.halted) for r in got) == sorted(want) and any(w[3] for w in want)


def test_replies_by_hand(spark):
    item = {"question_number": "3a", "question": " q ", "options": [" a", 1, 2.5, True, None, {"x": 1}], "has_image": 1, "image_bbox": [0, 1]}
    rows = [
        ("```json\n" + json.dumps([item]) + "\n```", [("3a", "q", ["a", "1", "2.5", "True", "None", '{"x":1}'], True, "[0,1]")]),
        (json.dumps([item | {"has_image": ""}, item | {"question": 5}, item | {"options": "a"}, {"question": "x"}, 7, None, item | {"question_number": None}]), [("3a", "q", ["a", "1", "2.5", "True", "None", '{"x":1}'], False, None)]),
        ("[]", []), ("```\n[]", []), ("```[]```", None), ("{}", None), ("[", None), ("", None), (None, None), ("text [] text", None), ("[{]", None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i long, x string")
    got = {r.i: r.q for r in df.select("i", replies.questions(F.col("x")).alias("q")).collect()}
    assert {i: None if q is None else [tuple(x) for x in q] for i, q in got.items()} == {i: w for i, (_, w) in enumerate(rows)}
    good, corrupt = replies.decoded(df, "x")
    assert good.count() == 2 and sorted(r.i for r in corrupt.collect()) == [i for i, (_, w) in enumerate(rows) if w is None]


def test_labels_by_hand(spark):
    rows = [('{"label": "urdu_mcq", "domain": " d "}', ("urdu_mcq", "d")), ('```\n{"label": "english", "domain": "d"}\n```', ("english", None)), (' Skip ', ("skip", None)), ('ENGLISH"', ("english", None)), ('"english"', ("skip", None)), ('{"label": "urdu_mcq"}', ("urdu_mcq", "")), ('{"label": "urdu_mcq", "domain": 5}', ("urdu_mcq", "5")), ('{"label": 5}', ("skip", None)), ("[1]", ("skip", None)), ("what", ("skip", None)), (None, ("skip", None))]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "i long, x string")
    assert [tuple(r.x) for r in df.orderBy("i").select(replies.page_label(F.col("x")).alias("x")).collect()] == [w for _, w in rows]
    text = '{"a": "odd", "b": {"label": "urdu_mcq", "domain": "x"}, "c": {"label": "no"}, "d": 5, "e": null}'
    got = spark.createDataFrame([(text,), ("[]",), (None,)], "x string").select(replies.keyed_labels(F.col("x")).alias("m")).collect()
    assert {k: tuple(v) for k, v in got[0].m.items()} == {"a": ("odd", None), "b": ("urdu_mcq", "x"), "c": ("skip", None), "d": ("skip", None), "e": ("skip", None)}
    assert got[1].m == {} and got[2].m == {}


def test_pages_from_files_to_questions(spark, tmp_path):
    for i in range(1, 7):  # Spark lists no empty files
        (tmp_path / f"scan_page_{i:03d}.{'PNG' if i % 2 else 'jpg'}").write_bytes(b"x" * i)
    (tmp_path / "notes.txt").write_text("no")

    def classify(images):
        if any(len(x) == 5 for x in images):
            raise RuntimeError("refused")
        return ['{"label": "urdu_mcq", "domain": "D"}' if len(x) % 2 == 0 else "english" for x in images]

    def extract(images):
        return ["broken" if len(x) == 4 else json.dumps([{"question_number": len(x), "question": "q", "options": ["a"]}]) for x in images]

    found = readers.images(spark, str(tmp_path))
    labels, questions, corrupt = pages.page_questions(found, classify, extract, batch=1)
    assert sorted(r.label for r in labels.collect()) == ["english", "english", "skip", "urdu_mcq", "urdu_mcq", "urdu_mcq"]
    assert sorted((r.page, r.domain, r.question_number) for r in questions.collect()) == [(2, "D", "2"), (6, "D", "6")]
    assert [r.reply for r in corrupt.collect()] == ["broken"]

    def never(images):
        return ["english" if len(x) == 5 else "skip" for x in images]

    again = pages.labelled(found, never, labels, 1)
    assert sorted(r.label for r in again.collect()) == ["english", "english", "english", "urdu_mcq", "urdu_mcq", "urdu_mcq"]


def test_published_files_appear_at_once(spark, tmp_path):
    path = str(tmp_path / "table")
    published.write(spark.range(5).withColumn("t", F.lit('a "é"\n')), path)
    first = published.files(path)
    assert sorted(map(tuple, published.read(spark, path, "id long, t string").collect())) == [(i, 'a "é"\n') for i in range(5)]
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="no"):
        published.write(bad, path)
    assert published.files(path) == first and all(os.path.exists(f) for f in first)
    assert len([d for d in os.listdir(path) if os.path.isdir(f"{path}/{d}")]) == 1  # the failed job's files are gone
    published.write(spark.range(5, 7).withColumn("t", F.lit(None).cast("string")), path, append=True)
    assert published.read(spark, path, "id long, t string").count() == 7
    published.write(spark.range(3).withColumn("t", F.lit("x,y")), path, kind="csv")
    assert [r.t for r in published.read(spark, path, "id long, t string").collect()] == ["x,y"] * 3
    assert all(os.path.exists(f) for f in first)  # of the version before: somebody may be reading them
    published.write(spark.range(0), path)
    assert published.read(spark, path, "id long").count() == 0 and not any(os.path.exists(f) for f in first)


def test_published_batches(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit("batch_"), (F.col("id") % 7).cast("string")).alias("batch_id"))
    path = str(tmp_path / "b")
    published.batch_files(rows, path)
    names = [f.rsplit("/", 1)[1].split("-")[0] for f in published.files(path)]
    assert sorted(names) == [f"batch_{i}" for i in range(7)]
    for f, n in zip(published.files(path), names, strict=True):
        assert {json.loads(x)["id"] % 7 for x in open(f)} == {int(n[-1])}


def proportional_allocate(sizes, cap):
    """The rule of ``quotas``, one place at a time."""
    total = sum(sizes)
    if total <= cap:
        return sizes
    got = [min(n, round(n * cap / total)) for n in sizes]
    by_size = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    while sum(got) < cap:
        k = next(k for k in by_size if got[k] < sizes[k])
        got[k] += 1
    while sum(got) > cap:
        most = max((got[k] * total - sizes[k] * cap, k) for k in range(len(sizes)) if got[k])[1]
        got[most] -= 1
    return got


def test_quotas_against_one_place_at_a_time(spark):
    rng = random.Random(1)
    groups, rows = {}, []
    for g in range(150):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 12))]
        groups[g] = sizes
        rows += [(g, c if c else None, i) for c, n in enumerate(sizes) for i in [c * 100 + x for x in range(n)]]
    df = spark.createDataFrame(rows, "g long, c long, pos long")
    for cap in (1, 7, 60):
        got = {}
        for r in sm.quotas(df, "g", ["c"], cap, "pos").collect():
            got.setdefault(r.g, {})[r.c or 0] = r.quota
        assert {g: [q[c] for c in range(len(q))] for g, q in got.items()} == {g: proportional_allocate(s, cap) for g, s in groups.items()}
    assert "Python" not in sm.quotas(df, "g", ["c"], 5, "pos")._jdf.queryExecution().toString()


def test_range_join_without_a_nested_loop(spark):
    rng = random.Random(2)
    cuts = {k: sorted({0.0, 1.0, *(rng.choice([rng.random(), rng.randrange(8) / 8]) for _ in range(40))}) for k in ("a", "b", None)}
    ranges = [(k, lo, hi, f"{k}{i}") for k, c in cuts.items() for i, (lo, hi) in enumerate(zip(c, c[1:], strict=False))]
    points = [(i, rng.choice(["a", "b", None, "none"]), rng.choice([rng.random(), rng.randrange(8) / 8])) for i in range(500)]
    p, r = spark.createDataFrame(points, "i long, k string, v double"), spark.createDataFrame(ranges, "k string, lo double, hi double, name string")
    out = sm.in_ranges(p, r, "k", "v", bins=8)
    want = sorted((i, n) for i, k, v in points for kk, lo, hi, n in ranges if k == kk and lo <= v < hi)
    assert sorted((x.i, x.name) for x in out.collect()) == want and len(want) > 300
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_imputation_by_ranges_of_groups_without_levels(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", None), (4, None, ""), (5, "b", "")], "id long, g string, l string")
    got = {r.id: r.l for r in sm.impute_level_by_ranges(rows, rows.where("l <> ''"), "g", "l", "id").collect()}
    assert got == {i: "x" for i in range(1, 6)}
    none = sm.impute_level_by_ranges(rows, rows.where("false"), "g", "l", "id")
    assert sorted((r.id, r.l or "") for r in none.collect()) == [(1, "x"), (2, ""), (3, ""), (4, ""), (5, "")]


def test_hierarchy_and_heatmap_of_little(spark):
    rows = spark.createDataFrame([("d", "s"), ("d", None), ("d", "s"), (None, ""), ("e", "t")], "a string, b string")
    got = {(r.depth, r.a, r.b): (r.n, round(r.share, 3), r.place) for r in charts.hierarchy(rows, ["a", "b"], ["U", "-"]).collect()}
    assert got[(0, None, None)] == (5, 1.0, 1) and got[(1, "d", None)] == (3, 0.6, 1) and got[(2, "d", "-")] == (1, 0.333, 2)
    assert charts.hierarchy(rows.limit(0), ["a", "b"], ["U", "-"]).collect() == []
    pairs = spark.createDataFrame([("x", "y", 3, 4)], "first string, second string, agree long, total long")
    got = {r.annotator: (r.x, r.y, r.z) for r in charts.heatmap(pairs, ["x", "y", "z"], "agreement").collect()}
    assert got == {"x": (None, 0.75, None), "y": (0.75, None, None), "z": (None, None, None)}


def test_counters_ride_on_one_write(spark, tmp_path):
    rows = spark.createDataFrame([("a____b ---- ‏",), (None,), ("“x” ...",)], "x string")
    found = counters.counted(rows, {"n": F.count(F.lit(1))} | counters.changes(F.col("x")), lambda df: df.write.parquet(str(tmp_path / "o")))
    assert {k: found[k] for k in ("n", "blank_runs", "blank_extra", "quotes_changed", "ellipses", "bidi_chars")} == {"n": 3, "blank_runs": 2, "blank_extra": 0, "quotes_changed": 1, "ellipses": 1, "bidi_chars": 1}
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
    nothing = counters.counted(rows.limit(0), counters.changes(F.col("x")), lambda df: df.write.parquet(str(tmp_path / "p")))
    assert set(nothing.values()) == {0}


def test_domains_before_renames(spark):
    kind = "id long, pos long, question string, domain string, subdomain string, correct_key string"
    first = spark.createDataFrame([(7, 0, "q1", "Other", "professional development", None)], kind)
    second = spark.createDataFrame([(7, 0, "⁧q1 ", "x", "y", "A"), (8, 1, "q2", "Other", "law", "B"), (9, 2, "q3", "Other", "law", "E"), (10, 3, "q4", None, None, "C")], kind)
    out = rc.combined({"annotated": first, "scraped": second}, "question", "pos", {"professional development": "Profession", "law": "Profession"}, {"law": "studies"}, trusted=["annotated"])
    assert sorted((r.id, r.legacy_id, r.question, r.domain, r.subdomain) for r in out.collect()) == [(0, 7, "q1", "Profession", "professional development"), (1, 8, "q2", "Profession", "studies"), (2, 10, "q4", None, None)]


def test_last_notes_edits_and_the_usual_domain(spark):
    items = spark.createDataFrame([(1, "q", {"A": "a"}, "D1", "s"), (2, "q", {"A": "a"}, "D2", "s"), (3, "q", {"A": "a"}, "D2", "t"), (4, "q", {"A": "a"}, "D3", "s")], "id long, question string, options map<string,string>, domain string, subdomain string")
    n = lambda i, who, at, pick, **x: (i, who, at, pick, x.get("flagged", False), x.get("q"), x.get("s"), x.get("o"))
    notes = spark.createDataFrame(
        [n(1, "x", 0, "B"), n(1, "x", 5, "A", q="long"), n(1, "y", 1, "A", q="qq", s="t"), n(2, "x", 0, "A"), n(3, "x", 0, "A", flagged=True), n(3, "y", 0, "A"), n(4, "y", 0, "C", s="new", o={"A": ""}), n(4, "z", 0, "C"), n(99, "x", 0, "A")],
        "id long, annotator string, at long, pick string, flagged boolean, question_edit string, subdomain_edit string, option_edits map<string,string>",
    )
    noted = rc.noted(items, notes, ["at"], list("ABCD"))
    assert {r.verdict: r.n for r in rc.drop_counts(noted).collect()} == {"include": 2, "single_annotated": 1, "flagged": 1}
    got = {r.id: (r.question, r.options, r.correct_key, r.domain, r.subdomain, r.domain_corrected) for r in rc.annotated(noted).collect()}
    assert got == {1: ("long", {"A": "a"}, "A", "D2", "t", True), 4: ("q", {"A": "a"}, "C", "D3", "new", False)}


def test_correlated_groups_keep_first_rows_and_sources(spark):
    base = "one two three four five six seven eight nine ten"
    o = {"A": "x", "B": "y"}
    rows = [(5, base, o, "Yes.", ["s2", "s1"], ["u2"]), (3, base + " eleven", o, " yes", ["s1", ""], ["u1", "u"]), (9, base, {"A": "p", "B": "q"}, "no", ["s9"], ["u9"]), (11, "short text", o, None, None, None), (12, "short text", o, None, ["k"], ["v"])]
    df = spark.createDataFrame(rows, "id long, q string, o map<string,string>, a string, source array<string>, url array<string>")
    out = rc.correlated_dedup(df, "id", tx.tokens(F.col("q")), F.col("o"), "a", names="source", urls="url").collect()
    assert {r.id: (r.group_size, r.source, r.url) for r in out} == {3: (2, ["s1", "s2"], ["u1", "u2"]), 9: (1, ["s9"], ["u9"]), 11: (1, None, None), 12: (1, ["k"], ["v"])}
    disputed = spark.createDataFrame([(1, base, o, "yes"), (2, base, o, "no"), (3, "other words in this one", o, "")], "id long, q string, o map<string,string>, a string")
    assert [r.id for r in rc.correlated_dedup(disputed, "id", tx.tokens(F.col("q")), F.col("o"), "a").collect()] == [3]
    kept = rc.correlated_dedup(disputed, "id", tx.tokens(F.col("q")), F.col("o"), "a", check_answer=False).collect()
    assert sorted((r.id, r.group_size) for r in kept) == [(1, 2), (3, 1)]


def test_readers_of_trees_of_files(spark, tmp_path):
    for folder, files in {"en/m1": ["predictions.json"], "ur/m2": ["predictions.json", "other.json"]}.items():
        (tmp_path / folder).mkdir(parents=True)
        for f in files:
            (tmp_path / folder / f).write_text('[{"id": 1, "question": "q"}, {"id": 2, "question": null}]')
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "predictions.json").write_text('[{"id": 1, ')
    rows = readers.named_files(spark, str(tmp_path), "predictions.json", "id long, question string")
    assert sorted((r.id, r.question) for r in rows.collect()) == [(1, "q"), (1, "q"), (2, None), (2, None)]
    (tmp_path / "bad" / "predictions.json").unlink()
    found = readers.predictions(spark, str(tmp_path), "id long, question string").collect()
    assert sorted((r.language, r.model, r.id) for r in found) == [("en", "m1", 1), ("en", "m1", 2), ("ur", "m2", 1), ("ur", "m2", 2)]
    for name, n in {"ur/m2/results_2024-01.json": 1, "ur/m2/results_2024-10.json": 2, "en/m1/results_2023.json": 3}.items():
        (tmp_path / name).write_text(json.dumps({"n": n}))
    assert sorted((r.model, r.n) for r in readers.latest_results(spark, str(tmp_path), "n int").collect()) == [("m1", 3), ("m2", 2)]
    assert readers.latest_results(spark, str(tmp_path), "n int", "none_*").collect() == []
    paths = spark.createDataFrame([("r/a/x_1.json",), ("r/a/x_2.json",), ("r/b/x_0.json",), ("r/en/gpt/predictions.json",), ("w/Ann__batch_012.json",)], "path string")
    assert sorted(r.path for r in readers.latest_per_directory(paths.limit(3)).collect()) == ["r/a/x_2.json", "r/b/x_0.json"]
    assert paths.where("path like '%predictions%'").select(*readers.prediction_path(F.col("path"))).first().asDict() == {"language": "en", "model": "gpt"}
    assert paths.where("path like 'w/%'").select(*readers.submission_name(F.col("path"))).first().asDict() == {"annotator": "Ann", "batch_id": "batch_012"}


EXPERIMENT = """
experiment: {limit: 2, batch_size: 5, prompt_language: [en, ur]}
data: {metadata_path: data/x.json}
prompts:
  en: {system: " be good \\n", user_template: "{domain}: {question}\\nA) {A}\\nB) {B}"}
  ur: {system: "s", user_template: "{question}"}
models:
  - {provider: p, enabled: true, name: "org/m:1 x", temperature: 0, user_prompt_suffix: /no_think}
  - {provider: q, enabled: false, name: off}
  - {provider: q, name: off2}
"""


def test_experiment_files(spark, tmp_path):
    from sifterra.sources import experiments

    pytest.importorskip("yaml")
    (tmp_path / "e.yaml").write_text(EXPERIMENT)
    found = experiments.load(spark, str(tmp_path / "e.yaml"))
    assert (found.languages, found.limit, found.batch_size, len(found.models)) == (["en", "ur"], 2, 5, 1)
    rows = experiments.runs(spark, found).collect()
    assert [(r.language, r.folder, r.system, r.suffix, r.options) for r in rows] == [("en", "en/org__m-1_x", "be good", "/no_think", {"temperature": "0"}), ("ur", "ur/org__m-1_x", "s", "/no_think", {"temperature": "0"})]
    records = spark.createDataFrame([(i, "d", f"q{i}", {"A": "a"}) for i in (3, 1, 2)], "id long, domain string, question string, options map<string,string>")
    first = experiments.samples(records, found, "id")
    shown = first.select(experiments.user_prompt(rows[0].template, F.col("options"), rows[0].suffix, domain=F.col("domain"), question=F.col("question"))).collect()
    assert [r[0] for r in shown] == [f"d: q{i}\nA) a\nB) \n\n/no_think" for i in (1, 2)]
    with pytest.raises(ValueError, match="ur"):
        experiments.parsed(json.dumps({"experiment": {"prompt_language": "ur"}, "prompts": {}}))
    assert experiments.parsed(json.dumps({"experiment": {"prompt_language": "ur"}, "prompts": {"ur": {}}})).models == []
