"""The pipeline's stages against a plain version of each, over a whole small table."""

import numpy as np
import plain_pii
import pyarrow as pa
import pytest
from test_pairs import _brute

import corpus_pipeline
from sifterra.llm import mixing, queries, toxicity
from sifterra.storage import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir), name))
    return out


def test_columns_stay_until_the_last(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    model = toxicity.fit_toxicity(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = stages[0].select("doc_id", "text").collect()
    p = model.score_texts(pa.array([r["text"] for r in rows]))
    assert {r["doc_id"] for r in stages[1].collect()} == {r["doc_id"] for r, x in zip(rows, p, strict=True) if x < 0.5}


def test_one_of_each_group_stays(stages):
    want = [d for d, _, c in _brute([(r["doc_id"], r["text"]) for r in stages[1].collect()]) if d == c]
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(want)


def test_personal_data_gives_way(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    changed = 0
    for r in stages[3].collect():
        want, kinds = plain_pii.replaced(before[r["doc_id"]] or "")
        assert ((r["text"] or ""), r["n_chars"]) == (want, len(want))
        changed += len(kinds)
    assert changed


def test_mixing_draws_the_counts(stages):
    counts = {(r["doc_id"], r["n_copies"]) for r in mixing.mix_sources(stages[3]).select("doc_id", "n_copies").collect()}
    got = {(r["doc_id"], r["count"]) for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == counts


def test_packing_holds_every_token(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_paths()[0])
    want = sum(len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    rows = stages[5].toPandas()
    assert rows.length.sum() == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 1024


def test_run_gives_the_same(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32")
    want = stages[5].select("doc_id", "piece", "length", "ids_crc32")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


CLASH = "doc_id long, text string, lang string, source string, n_chars int, row string, key int, rate double, __n int"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_clashing_names_and_nothing(spark, sf_dir, name):
    """Null ids, texts and sources, repeated rows and clashing names go through each stage; an
    empty table gives an empty one.  The length of a null text is null."""
    stage = dict(corpus_pipeline.STAGES)[name]
    text = "please write to a.b@mail.example.com about one two three four five six seven"
    rows = [(1, text, "en", "s", 3, "r", 1, 2.0, 5), (1, text, "en", "s", 3, "r", 1, 2.0, 5), (2, None, None, None, None, None, None, None, None), (None, "", "en", "", 0, "", 0, 0.0, 0), (4, "x " * 30_000, "en", "t", 1, "r", 2, 1.0, 1)]
    docs = spark.createDataFrame(rows, CLASH)
    out = stage(spark, docs, sf_dir)
    got = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {1, 2, None, 4} and all(0 < r["length"] <= 1024 for r in got)
    else:
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in got]
        if name == "near_duplicates":
            assert sorted(map(str, ids)) == ["1", "2", "4", "None"]
        elif name == "personal_data":
            assert len(ids) == 5 and all("a.b@mail" not in (r["text"] or "") for r in got)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
        elif name == "toxicity":
            assert set(ids) <= {1, 2, None, 4} and all(tuple(r) in set(rows) for r in got)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
