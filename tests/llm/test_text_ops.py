"""Packing, media, chat, token counts, mixing and personal data."""

import hashlib
import math
import re
import zlib

import numpy as np
import plain_pii
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import duck, same_rows
from pyspark.sql import functions as F

from sifterra.llm import chat, media, mixing, packing, pii, queries, token_counts

EDGE = "doc_id long, text string, source string, copy string, length string"


def _edge(spark, *texts):
    return spark.createDataFrame([(i, t, "s", "c", "l") for i, t in enumerate(texts)], EDGE)


# ---- packing


def test_fullest_is_the_best_subset_sum():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6), strict=True)}
        room = int(rng.integers(1, 90))
        got = packing.fullest(counts, room)
        assert all(k <= counts[x] for x, k in got)
        reach = {0}
        for x, n in counts.items():
            reach = {r + x * k for r in reach for k in range(n + 1)}
        assert sum(x * k for x, k in got) == max(r for r in reach if r <= room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 50), max_size=40))
def test_bins_hold_all_pieces_and_never_overflow(histogram):
    runs = packing.minimum_bin_slack(histogram)
    used: dict = {}
    for bins, combo in runs:
        assert sum(x * k for x, k in combo) <= 1024
        for x, k in combo:
            used[x] = used.get(x, 0) + bins * k
    assert used == histogram


def test_packing_of_edge_rows(spark):
    docs = _edge(spark, "a b c", None, "", "word " * 3000, "a b c", "é\n\n  x  y", "<|endoftext|> z")
    docs = docs.unionAll(docs.limit(1)).unionAll(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = packing.pack(packing.tokenize_pieces(docs, *queries.tokenizer_paths())).toPandas()
    assert (rows.length <= 1024).all() and (rows.length > 0).all()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 1024
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_paths()[0])
    for doc, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id.isna() if doc is None else rows.doc_id == doc].drop_duplicates("piece").sort_values("piece")
        assert own.length.sum() == len(ids)
        for _, p in own.iterrows():
            assert zlib.crc32(ids[int(p.start) : int(p.start + p.length)].tobytes()) == p.ids_crc32
        assert (own.length.iloc[1:] == 1024).all()
    assert packing.pack(packing.tokenize_pieces(docs.limit(0), *queries.tokenizer_paths())).count() == 0


_WORDS = st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "the", "naïve", "漢字", "🙂", "it's", "don't", "12345", "\n", "\t", " ", "  ", "x" * 70, "\u00a0", "\u3000", "{", "--", "aaaaaaaa"]) | st.text(max_size=8), max_size=30)


@settings(max_examples=300, deadline=None)
@given(_WORDS, st.sampled_from(["", " "]))
def test_ids_are_those_of_the_plain_call(words, glue):
    from tokenizers import Tokenizer

    paths = queries.tokenizer_paths()
    text = glue.join(words)
    plain = _PLAIN.setdefault("t", None) or _PLAIN.update(t=Tokenizer.from_file(paths[0])) or _PLAIN["t"]
    ours = packing._tokenizer(*paths)
    assert ours.fast is not None
    assert ours.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


_PLAIN: dict = {}


# ---- media


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=60_000))
def test_streams_round_trip(data):
    payload = media.padded_payload(np.frombuffer(data, np.uint8))
    got = media.demux(media.mux(payload))
    (s,) = got.streams
    assert s.data.tobytes() == payload.tobytes() and not got.errors and not s.continuity_errors
    assert (np.diff(s.pts) == media.TICKS).all() and s.random_access[:: media.RANDOM_EVERY].all()
    assert s.random_access.sum() == -(-len(s.pts) // media.RANDOM_EVERY)


def test_lost_packets_and_broken_tables_are_seen():
    stream = media.mux(media.padded_payload(np.arange(5000, dtype=np.int64).astype(np.uint8)))
    packets = stream.reshape(-1, 188)
    assert media.demux(np.delete(packets, 5, 0).reshape(-1)).streams[0].continuity_errors == 1
    twice = np.insert(packets, 6, packets[6], 0)
    assert media.demux(twice.reshape(-1)).streams[0].continuity_errors == 0
    broken = packets.copy()
    broken[0, 10] ^= 1
    assert "section crc" in media.demux(broken.reshape(-1)).errors
    assert media.demux(np.zeros(100, np.uint8)).errors


def test_section_crc_is_the_published_one():
    assert media.section_crc(b"123456789") == 0x0376E6E7


def test_media_rows(spark):
    docs = _edge(spark, "abc", None, "", "abc", "ü" * 70_000)
    got = {r["doc_id"]: r for r in media.media_digests(docs).collect()}
    for i, t in enumerate(["abc", "", "", "abc", "ü" * 70_000]):
        raw = t.encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert got[0]["media_sha256"] == got[3]["media_sha256"] and got[0]["feature"] == got[3]["feature"]
    assert media.media_digests(docs.limit(0)).count() == 0


# ---- chat

_TURN = st.lists(st.sampled_from(list("ab\\\n|<> ") + [chat.START, chat.END, chat.MARK]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(_TURN, _TURN), max_size=6))
def test_any_conversation_parses_back(turns):
    out, spans = "", []
    for role, text in turns:
        segment, lo, hi = chat.render_turn(role, text)
        spans.append((len(out) + lo, len(out) + hi))
        out += segment
    at, back = 0, []
    while at < len(out):
        role, text, lo, hi, at = chat.parse_turn(out, at)
        assert (lo, hi) == spans[len(back)]
        back.append((role, text))
    assert back == turns


def test_chat_query_and_edges(spark, sf_dir):
    same_rows(duck(sf_dir), queries.op8_chat(spark, sf_dir), queries.ORACLES["op8_chat"])
    rows = spark.createDataFrame([(1, 1, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "assistant", "y" * 300_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chat(rows)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 300_000
    assert chat.read_back(chat.format_chat(rows.limit(0))).count() == 0


# ---- token counts


def _brute(scores, floor, word):
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        width = len(word[d - 1].encode())
        options = [(best[d - 1][0] + floor * width, best[d - 1][1] - width)]
        options += [(best[lo][0] + scores[word[lo:d]], best[lo][1] - 1) for lo in range(d) if word[lo:d] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_counts_against_brute_force(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.zipf_scores(token_counts.vocabulary(path))
    trie = token_counts.UnigramTrie(scores)
    words = "the nation tionishly über naïve 日本 x 12345 ".split() + ["a" * 100, "nation" * 60]
    want = [_brute(scores, trie.floor, token_counts.MARK + w) for w in words]
    assert trie.count_all(words) == want
    docs = _edge(spark, " ".join(words), None, "", " \n ", "the the").withColumns({"n_tokens": F.lit(7), "n_pretokens": F.lit("x")})
    got = {r["doc_id"]: (r["n_tokens"], r["n_pretokens"]) for r in token_counts.count_tokens(docs, path).collect()}
    assert got[0][0] == sum(want) and got[1] == got[2] == got[3] == (0, 0) and got[4] == (2, 2)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_token_count_query_against_brute_force(spark, sf_dir):
    import public_tokenizers

    scores = token_counts.zipf_scores(token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    floor, known = min(scores.values()) - 10.0, {}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = (r["text"] or "").split()
        for w in words:
            if w not in known:
                known[w] = _brute(scores, floor, token_counts.MARK + w)
        want[r["doc_id"]] = sum(known[w] for w in words), len(words)
    got = queries.op9_token_counts(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_pretokens"]) for r in got} == want and len(got) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcß漢🙂", min_size=1, max_size=12), unique=True, max_size=60), st.dictionaries(st.text("abcß漢▁", min_size=1, max_size=4), st.sampled_from([-1.0, -1.5, -2.0, -3.0]), max_size=30))
def test_counts_of_any_vocabulary(words, scores):
    trie = token_counts.UnigramTrie(scores)
    assert trie.count_all(words) == [_brute(scores, trie.floor, token_counts.MARK + w) for w in words]


def test_trie_shares_prefixes_and_its_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "FEW", 0)
    scores = {"a": -1.0, "ab": -1.5, "b": -1.0}
    trie = token_counts.UnigramTrie(scores)
    assert trie.count_all(["abab", "abaa", "ab"]) == [5, 6, 4]
    assert trie.nodes == 6  # the mark, a, ab, aba, abab, abaa
    assert trie.count_texts(["abab ab", None, " ", "abab"]) == [(9, 2), (0, 0), (0, 0), (5, 1)]
    seen = trie.nodes
    assert trie.count_texts(["ab\tabab"]) == [(9, 2)] and trie.nodes == seen + 1  # only the mark, for no words
    monkeypatch.setattr(token_counts, "SLICE", 100)
    small = token_counts.UnigramTrie(scores, max_kept=300)
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 9, 20)) for _ in range(50)] + ["abc" * 5000]
    assert small.count_texts(texts) == trie.count_texts(texts)
    assert small.kept < 20_000 and sum(map(len, small.older)) < 20_000


def test_long_texts_are_split_at_gaps(monkeypatch):
    scores = {"a": -1.0, "ab": -1.5, "b": -1.0}
    text = " ".join(["abab", "b", "a" * 30] * 50) + "\n"
    want = token_counts.UnigramTrie(scores).count_texts([text, "b"])
    monkeypatch.setattr(token_counts, "SLICE", 17)
    assert token_counts.UnigramTrie(scores).count_texts([text, "b"]) == want


# ---- mixing


def test_mixing_query(spark, sf_dir):
    same_rows(duck(sf_dir), queries.op5_mixing(spark, sf_dir), queries.ORACLES["op5_mixing"])


def test_mixing_rates_and_edges(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 == 1, None).otherwise("big").alias("source"))
    got = mixing.mix_sources(docs, {"rare": 3.0, "big": 1.0, "none": 5.0}, 30_000).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    # weights of 3, 1 and (absent) 0
    assert abs(n["rare"] - 22_500) < 6 * math.sqrt(22_500) and abs(n["big"] - 7_500) < 6 * math.sqrt(7_500) and None not in n
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mix_sources(docs, total=0).count() == 0
    twice = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (None, "b", None), (None, None, None)], "doc_id long, text string, source string")
    out = mixing.mix_sources(twice, total=40).toPandas()
    assert {"copy", "n_copies", "rate"} < set(out.columns) and len(out) > 0


def test_poisson_table_matches_the_distribution(spark):
    rates = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.3), ("c", 1, 40.0)], "source string, n_docs long, rate double")
    for r in mixing.poisson_tables(rates).collect():
        p, total = math.exp(-r["rate"]), 0.0
        for k, c in enumerate(r["__cdf"]):
            total += p
            p *= r["rate"] / (k + 1)
            assert abs(c - total) < 1e-9
        assert abs(r["__cdf"][-1] - 1) < 1e-9


# ---- personal data

SAMPLES = [
    ("write to anna.b7@mail3.example.org now", ["email"]),
    ("call +1 (212) 555-0123 or (212) 555-0123", ["phone", "phone"]),
    ("card 4111 1111 1111 1111 and 4012888888881881", ["card", "card"]),
    ("ssn 123-45-6789 ip 10.0.0.255.", ["ssn", "ip"]),
    ('token = "0cab398dc11d1a2a11dc6572c8df8bd228c864f3"', ["secret"]),
    ("Mr. Brown met Mary Brown", ["person", "person"]),
    ("Анна Петрова, Иван Петров", ["person", "person"]),
    ("no data: 1.2.3, 2024, 3.14, a@b", []),
    ("", []),
    (None, []),
]


@pytest.fixture(scope="module")
def report(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(SAMPLES)], "doc_id long, text string, surrogate string")
    return {r["doc_id"]: r for r in pii.surrogate_report(docs).collect()}


def test_kinds(report):
    for i, (_, kinds) in enumerate(SAMPLES):
        assert report[i]["kinds"].split(",") == (kinds or [""]) and report[i]["n_entities"] == len(kinds)


def _luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(sum(divmod(c * (1 + i % 2), 10)) for i, c in enumerate(d)) % 10 == 0


def test_formats_and_rules(report):
    for i, (text, kinds) in enumerate(SAMPLES):
        got = report[i]["text"]
        if not kinds:
            assert got == text
            continue
        assert got != text and ("ip" in kinds or re.sub(r"\d", "9", got).count("9") == re.sub(r"\d", "9", text).count("9") or "secret" in kinds)
    cards = re.findall(r"(?:\d{4} ?){4}", report[2]["text"])
    assert len(cards) == 2 and all(map(_luhn, cards)) and "1111" not in report[2]["text"]
    assert re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or \([2-9]\d\d\) [2-9]\d\d-\d{4}", report[1]["text"])
    assert all(int(x) < 256 for x in re.search(r"(\d+)\.(\d+)\.(\d+)\.(\d+)\.", report[3]["text"]).groups())
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', report[4]["text"])
    title, last, first, again = re.fullmatch(r"(Mr\.) (\w+) met (\w+) (\w+)", report[5]["text"]).groups()
    assert last == again != "Brown" and first in pii.FIRST_NAMES["latin_f"] and first != "Mary"
    names = re.findall(r"\w+", report[6]["text"])
    assert names[0] in pii.FIRST_NAMES["cyrillic_f"] and names[2] in pii.FIRST_NAMES["cyrillic_m"]


def test_no_two_values_share_a_surrogate(spark):
    rows = [f"{a}.{b:02d}@m{c}.example.com" for a in ("ab", "ba", "cd") for b in range(40) for c in range(8)] + [f"10.1.{a}.{b}" for a in range(30) for b in range(30)] + [f"+1 (212) 555-{i:04d}" for i in range(800)] + [f"{4000000000000000 + 7 * i}" for i in range(800)]
    docs = spark.createDataFrame([(" ; ".join(rows[i : i + 50]),) for i in range(0, len(rows), 50)], "text string")
    found = pii.entities(docs)
    assert found.count() == len(set(rows)) == found.select("surrogate").distinct().count()
    assert pii.collisions(docs).count() == 0


def test_keys_matter_and_no_python_runs(spark):
    docs = spark.createDataFrame([("a.b@c.example.com",)], "text string")
    a, b = (pii.replace_pii(docs, k, check=False) for k in ("k1", "k2"))
    assert a.first()[0] != b.first()[0]
    assert "Python" not in a._jdf.queryExecution().executedPlan().toString()


SECRETS = [
    ('TOKEN = "9233A8ECF7C5B09FE5949719B6B8"', "9233A8ECF7C5B09FE5949719B6B8"),
    ('access_token = "abc12345xyz"', "abc12345xyz"),
    ("db_password='hunter2hunter2'", "hunter2hunter2"),
    ("AWS_SECRET_KEY=wJalrXUtnFEMI", "wJalrXUtnFEMI"),
    ("aws_secret_access_key: wJalrXUtnFEMI", "wJalrXUtnFEMI"),
    ('{"password": "hunter2hunter2"}', "hunter2hunter2"),
    ("password: correcthorse", "correcthorse"),
    ('{\\"apiKey\\": \\"k3y-k3y-k3y\\"}', "k3y-k3y-k3y"),
]


def test_secrets_in_all_forms(spark):
    docs = spark.createDataFrame([(i, f"so {t} then") for i, (t, _) in enumerate(SECRETS)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.surrogate_report(docs).collect()}
    for i, (text, value) in enumerate(SECRETS):
        head, tail = f"so {text} then".split(value)
        assert got[i]["kinds"] == "secret" and value not in got[i]["text"], text
        assert got[i]["text"].startswith(head) and got[i]["text"].endswith(tail)
        assert len(got[i]["text"]) == len(f"so {text} then")
    assert re.fullmatch(r'so TOKEN = "[0-9A-F]{28}" then', got[0]["text"])


def test_each_kind_keeps_its_boundary(spark):
    texts = [("see:-GB82 WEST 1234 5698 7654 32 now", "iban"), ("by 7Mary Brown.", "person"), ("x.Mr. Brown", "person"), ("-Mary Brown", "person"), ("secret: Elizabeth Brown", "person"), ("password: annabella@mail.example.org", "email"), ("XX12 ABCD EFGH IJKL", "iban")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.surrogate_report(docs).collect()}
    assert [got[i]["kinds"] for i in range(len(texts))] == [k for _, k in texts]
    assert all("Brown" not in r["text"] and "annabella" not in r["text"] for r in got.values())


def test_later_mentions_follow_the_full_name(spark):
    texts = [
        "John Smith said. Later Smith and John left; Smith's car, John’s hat, smith, Smithers.",
        "Smith came. Then Dr. Smith and Mary J. Smith-Jones; Smith-Jones, Jones and Mary.",
        "Анна Павлова и Павлова, потом Анна.",
        "Smith and John left.",
        "Mr. Bean, a.bean@x.example.com and Bean",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.surrogate_report(docs).collect()}
    for i, t in enumerate(texts):
        if t.isascii() or i == 0:  # the plain version knows Latin letters only
            assert (got[i]["text"], got[i]["kinds"]) == (plain_pii.replaced(t)[0], ",".join(plain_pii.replaced(t)[1]))
    first = re.match(r"(\w+) (\w+) said\. Later (\w+) and (\w+) left; (\w+)'s car, (\w+)’s hat, smith, Smithers\.$", got[0]["text"]).groups()
    assert first[0] == first[3] == first[5] != "John" and first[1] == first[2] == first[4] != "Smith"
    second = re.match(r"(\w+) came\. Then Dr\. (\w+) and (\w+) J\. ([\w-]+); ([\w-]+), Jones and (\w+)\.$", got[1]["text"]).groups()
    assert second[0] == second[1] == first[1] and second[3] == second[4] != "Smith-Jones" and second[2] == second[5] != "Mary"
    assert "Павлов" not in got[2]["text"] and "Анна" not in got[2]["text"]
    assert got[3]["text"] == texts[3] and "Bean" not in got[4]["text"]


def test_account_numbers_stay_as_right_or_wrong_as_they_were(spark):
    good = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    bad = ["GB81 WEST 1234 5698 7654 32", "DE00370400440532013000"]
    docs = spark.createDataFrame([(i, f"to {x}.") for i, x in enumerate(good + bad)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"][3:-1] for r in pii.surrogate_report(docs).collect()}
    for i, x in enumerate(good + bad):
        y = got[i]
        assert y != x and len(y) == len(x) and y[:2] == x[:2] and [c == " " for c in y] == [c == " " for c in x]
        assert (int(y[2:4]) == plain_pii.right_check(y[:2], y[4:])) == (i < len(good))
    many = [f"DE{c:02d}3704004405320130{k:02d}" for c in range(100) for k in range(10)]
    rows = spark.createDataFrame([(" ; ".join(many[i : i + 50]),) for i in range(0, len(many), 50)], "text string")
    assert pii.entities(rows).select("surrogate").distinct().count() == 1000 and pii.collisions(rows).count() == 0


def test_quick_look_and_plain_words(spark):
    docs = spark.createDataFrame([(0, "the token of thanks, secretly: passwords matter"), (1, "a secret = x")], "doc_id long, text string")
    assert [r["n_entities"] for r in pii.surrogate_report(docs).collect()] == [0, 0]


def test_upper_case_hex_secrets_stay_distinct(spark):
    rows = [f'TOKEN = "{i:08X}"' for i in range(0, 600_000_000, 400_000)] + [f'token = "{i:08x}"' for i in range(0, 600_000_000, 400_000)]
    docs = spark.createDataFrame([(" ; ".join(rows[i : i + 50]),) for i in range(0, len(rows), 50)], "text string")
    assert pii.collisions(docs).count() == 0


def test_personal_data_query_against_the_plain_version(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op10_pii(spark, sf_dir).collect()
    assert len(got) == len(docs) and sum(r["n_entities"] for r in got)
    for r in got:
        text, kinds = plain_pii.replaced(docs[r["doc_id"]] or "")
        assert (r["text"] or "", r["kinds"], r["n_entities"]) == (text, ",".join(kinds), len(kinds)), r["doc_id"]


_PARTS = ["MT84 MALT ABCD EFGH", "GB82WEST12345698765432", "a.b@x-y.co.uk", "token = 'abcdefgh12'", "AWS_SECRET_KEY: QWERTY123456", "123-45-6789", "+49 30 1234567", "+1 (212) 555-0199", "(212) 555-0199", "212.555.0199",
          "10.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "Mr. Bean", "Prof. Özil", "Mary J. Smith", "Анна Павлова", "فاطمہ خان", "James", "password", "x@", "+7", "12", "AB12", ".", "-", " ", "(", "é", "Dr", "=", ":"]


def test_the_quick_look_misses_nothing(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(_PARTS, rng.integers(1, 5))) for _ in range(3000)]
    texts += ["".join(rng.choice(list("+()-. 0123456789AB@:=tokenMDPrs"), rng.integers(5, 30))) for _ in range(5000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found, quick = (F.expr(f"text rlike {pii._quoted(p)}") for p in (pii.DETECT, pii.QUICK))
    assert rows.where(found).count() > 2000 and rows.where(found & ~quick).count() == 0


def test_personal_data_in_very_long_texts(spark):
    texts = ["x a@" + "b." * 100_000 + "com", "1" * 500_000, "a." * 250_000 + "@", "A" * 500_000, "secret=" + "Ab1" * 10_000, None, ""]
    docs = _edge(spark, *texts).withColumns({"row": F.lit(1), "pii": F.lit("p"), "__pii": F.lit("q")})
    got = {r["doc_id"]: r for r in pii.surrogate_report(docs).collect()}
    assert [got[i]["kinds"] for i in range(7)] == ["email", "", "", "", "secret", "", ""]
    assert all(len(got[i]["text"]) == len(texts[i]) for i in range(5)) and got[5]["text"] is None and got[6]["text"] == ""
    kept = pii.replace_pii(docs, check=False)
    assert kept.columns == docs.columns and kept.where("row = 1 and pii = 'p' and __pii = 'q'").count() == 7
    assert pii.replace_pii(docs.limit(0)).count() == 0


def test_mixing_of_large_rates_and_clashing_names(spark):
    rows = [(1, "a", "s", 7.0, "c", 3), (1, "a", "s", 7.0, "c", 3), (2, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double, copy string, __cdf int").withColumns({"row": F.lit(1), "__at": F.lit(2), "n_copies": F.lit("n")})
    big = mixing.poisson_tables(mixing.repetition_rates(docs, total=1e9)).agg(F.max(F.size("__cdf"))).first()[0]
    assert big < 1_000_000
    out = mixing.mixed_rows(docs, total=20_000)
    assert out.columns == docs.columns and abs(out.count() - 20_000) < 900
    assert {tuple(r) for r in out.distinct().collect()} == {tuple(r) for r in docs.distinct().collect()}
    drawn = mixing.mix_sources(docs, total=20_000).groupBy("doc_id", "n_copies").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("k")).collect()
    assert all(r["k"] == r["n_copies"] and r["n"] == r["n_copies"] * (2 if r["doc_id"] == 1 else 1) for r in drawn)


@pytest.mark.parametrize("rate", [0.3, 5.0, 400.0, 25_000.0])
def test_poisson_window_is_the_distribution(spark, rate):
    r = mixing.poisson_tables(spark.createDataFrame([("s", 1, rate)], "source string, n_docs long, rate double")).first()
    cdf, low = np.array(r["__cdf"]), r["__low"]
    log = np.cumsum([-rate, *(np.log(rate / k) for k in range(1, low + len(cdf)))])
    assert np.allclose(cdf, np.cumsum(np.exp(log))[low:], atol=1e-10) and abs(cdf[-1] - 1) < 1e-12
