"""Exact duplicates by block naming against a plain grouping of normalised texts."""

import hashlib
import random
import re

import pytest
from oracle import duck, same_rows
from pyspark.sql import functions as F

from sifterra.llm import block_naming
from sifterra.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, block binary, name long, row string"


def _plain(rows):
    """(doc_id, keep_id, group_size, sha) of each row, and how many rows of each text stay."""
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = [x for x in ids if x is not None]
        out += [(x, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()) for x in ids]
    return sorted(out, key=str), len(groups)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, b"b", 7, "r") for i, t in rows], SCHEMA)


def _same(df, rows):
    got = df.collect()
    want, groups = _plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == groups
    assert all(r.doc_id == r.keep_id for r in kept)


def _texts(n):
    rng = random.Random(7)
    pieces = ["ab", "ba", "é", "\U0001f600", " ", "\t\n", " ", "x" * 9]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 3, 8, 2048])
def test_groups_of_random_texts(spark, size):
    rows = list(enumerate(_texts(60)))
    random.Random(1).shuffle(rows)
    _same(block_naming.exact_groups(_frame(spark, rows), size), rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "abcdefgh " * 5000
    rows = [(1, None), (2, ""), (3, " "), (4, "\n \t"), (None, "a  b"), (5, "a b"), (5, "a b"), (6, "a b "), (None, "only"), (None, "only"), (7, long), (8, long + "x"), (9, long.replace(" ", "\t ")), (10, long[:2048]), (11, long[:4096]), (12, "aa"), (13, "a")]
    _same(block_naming.exact_groups(_frame(spark, rows), 64), rows)


def test_equal_blocks_at_other_depths_stay_apart(spark):
    """One name may stand at several levels and places; only whole trees are equal."""
    rows = [(0, "aa"), (1, "aaaa"), (2, "a"), (3, "aaa"), (4, "aaaaa"), (5, "baaa"), (6, "aaab"), (7, "aaaa")]
    _same(block_naming.exact_groups(_frame(spark, rows), 1), rows)


def test_empty_table(spark):
    assert block_naming.exact_groups(_frame(spark, [])).collect() == []


def test_alike_addresses_give_way_to_the_next_seed(spark):
    seen = []

    def weak(block, seed):
        seen.append(seed)
        return block_naming.addresses(block, seed) if seed >= 2 else (F.octet_length(block).cast("long"), F.lit(0).cast("long"))

    rows = list(enumerate(["ab", "ba", "abab", "ab", "", "abba", "abab"]))
    _same(block_naming.exact_groups(_frame(spark, rows), 2, weak), rows)
    assert set(seen) == {0, 1, 2}
    with pytest.raises(RuntimeError, match="seed"):
        block_naming.exact_groups(_frame(spark, rows), 2, lambda b, s: (F.lit(0).cast("long"), F.lit(0).cast("long")))


def test_main_path_is_native(spark):
    plan = block_naming.exact_groups(_frame(spark, [(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_drop_exact_copies_keeps_columns_and_rows(spark):
    rows = [(3, "a  b"), (1, "a b"), (1, "a b"), (None, "c"), (2, None), (4, "")]
    got = block_naming.drop_exact_copies(_frame(spark, rows))
    assert got.columns == ["doc_id", "text", "block", "name", "row"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b"), (None, "c"), (2, None)], key=str)


def test_query_oracle(spark, sf_dir):
    same_rows(duck(sf_dir), QUERIES["op13_block_naming"](spark, sf_dir), ORACLES["op13_block_naming"])
