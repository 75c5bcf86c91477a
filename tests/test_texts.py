"""Text operators by value: rows by hand, and whole tables against plain Python."""

import plain_text
import pytest
from pyspark.sql import functions as F

from sifterra.functions import text as tx
from sifterra.plans import QUERIES
from sifterra.plans.texts import _KEYS, _LETTERS, _MIXED

BY_HAND = {
    "rlm": ([("کتاب", "کتاب"), ("a کتاب", "‏a کتاب"), ("abc", "abc"), ("‏x کتاب", "‏x کتاب"), ("", ""), ("ﭖ", "‏ﭖ"), (None, None)], tx.right_to_left_mark),
    "characters": ([("abc", "abc"), ("x²", "x2"), ("a b", "a b"), ("كي", "کی"), ("…", "..."), ("", ""), (None, None)], tx.normalize_characters),
    "punctuation": ([("a?", "a؟"), ("1,000, b", "1,000, b"), ("a, b", "a، b"), ("کتاب.", "کتاب۔"), ("x...", "x…"), ("a.b", "a.b")], tx.normalize_punctuation),
    "math_guard": ([("a? $x?$ b?", "a؟ $x?$ b؟"), ("$$a,b$$, c", "$$a,b$$، c"), ("$a", "$a"), ("", "")], lambda x: tx.outside_math(x, tx.normalize_punctuation)),
    "exponents": ([("a2 + b2", "a² + b²"), ("log5 8", "log₅ 8"), ("(x)3", "(x)³"), ("a2b", "a²b"), ("a12", "a12"), ("x1", "x1")], tx.convert_exponents),
    "isolates": ([("abc", "⁦abc⁩"), ("کتاب", "کتاب"), ("کتاب abc کتاب", "کتاب ⁦abc⁩ کتاب"), ("!!", "!!"), ("⁦a⁩", "⁦a⁩")], tx.isolate_left_to_right),
    "level": ([("Physics HSSC-II", "HSSC-II"), ("Biology SSC Part-I (9th)", "SSC-I"), ("Urdu Paper-II", "SSC-II"), ("Math SSA-I", "SSA-I"), ("Art ssc iii", "SSC-III"), ("x", None)], tx.level_of),
    "without_level": ([("Physics HSSC-II", "Physics"), ("Biology SSC Part-I (9th)", "Biology"), ("plain", "plain")], tx.without_level),
    "parse_key": ([("Answer key: B", "B"), ("The answer is (c)", "C"), ("\\boxed{D}", "D"), ("**A** because", "A"), ("د", "D"), ("Answer: apple", "A"), ("I pick d.", "D")], tx.parse_key),
    "page_number": ([("x_page_12.png", "12"), ("scan-7.jpg", "7"), ("a1-page-003.png", "3"), ("no", None)], lambda x: tx.page_number(x).cast("string")),
    "safe_name": ([("a/b:c d", "a__b-c_d"), ("m", "m")], tx.safe_name),
    "host": ([("https://www.Example.com/a", "example.com"), ("http://x.org", "x.org")], tx.host),
    "subdomain": ([("  General Science ", "general_science"), ("art", "art")], tx.subdomain_key),
    "fence": ([("```json\n[1]\n```", "[1]"), ("[2]", "[2]")], tx.unfenced),
    "option_prefix": ([("A) first", "first"), ("الف ۔ x", "x"), ("B) x", "B) x"), ("Apple", "Apple"), ("‏A. x", "‏x")], lambda x: tx.strip_option_prefix(x, F.lit("A"))),
    "match_options": ([("Answer text: Karachi", "B"), ("Lahore", "A"), ("it is Karachi indeed", "B"), ("nothing", None), ("a", None)], lambda x: tx.parse_key_from_options(x, F.create_map(*[F.lit(v) for v in ("A", "Lahore", "B", "Karachi", "C", "Quetta", "D", "Multan")]))),
}


@pytest.mark.parametrize("name", sorted(BY_HAND))
def test_by_hand(spark, name):
    rows, change = BY_HAND[name]
    given = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i long, x string")
    assert [r[0] for r in given.orderBy("i").select(change(F.col("x"))).collect()] == [b for _, b in rows]


@pytest.mark.parametrize(
    ("name", "table", "key", "before", "plain"),
    [
        ("txt_characters", "documents", ["doc_id"], _LETTERS, plain_text.characters),
        ("txt_isolates", "documents", ["doc_id"], _MIXED, plain_text.isolates),
        ("txt_parse_key", "conversations", ["conv_id", "turn"], _KEYS, plain_text.parse_key),
    ],
)
def test_whole_tables_against_plain_python(spark, sf_dir, name, table, key, before, plain):
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*key, "text").collect()
    want = {tuple(r[:-1]): plain(before[r[-2] % len(before)] + r.text) for r in rows}
    got = {tuple(r[:-1]): r.result for r in QUERIES[name](spark, sf_dir).select(*key, "result").collect()}
    assert got == want
    assert len(set(want.values())) > 4


def test_one_python_function_in_the_plan_of_characters(spark):
    plan = spark.range(1).select(tx.normalize_characters(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert plan.count("ArrowEvalPython [") <= 2 and "_normal_forms" in plan
