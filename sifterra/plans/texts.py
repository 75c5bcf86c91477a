"""Text operators over whole tables.

Where no text of the tables has what an operator acts on, the query makes its input from
each row's own text and id, so that every branch is reached by rows of every table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sifterra.functions import text as tx
from sifterra.operators.counters import changes
from sifterra.plans.registry import Tables, query

#: The fingerprint in DuckDB's SQL.
FINGERPRINT = (
    "trim(regexp_replace(lower(regexp_replace(regexp_replace(coalesce({x},''), '[ً-ٰٟؐ-ؚـ]', '', 'g'),"
    " '[‏‎,،.۔?؟!:;\"''“”‘’()\\[\\]{{}}<>—–\\-_/\\\\|]', ' ', 'g')), '\\s+', ' ', 'g'))"
)


def fingerprint_sql(x: str) -> str:
    return FINGERPRINT.format(x=x)


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x},''), '\\s+'), lambda w: w <> '')"


@query("select doc_id, regexp_replace(regexp_replace(text, '[“”]', '\"', 'g'), '\"{2,}', '\"', 'g') as plain, "
       "case when (length(q) - length(replace(q, '\"', ''))) % 2 = 1 then '\"' || q else q end as quoted "
       "from (select doc_id, text, regexp_replace(regexp_replace(text, '[“”]', '\"', 'g'), '\"{2,}', '\"', 'g') as q from documents)")
def txt_quotes(t: Tables):
    """TXT2 over whole texts."""
    return t.documents.select("doc_id", tx.plain_quotes(F.col("text")).alias("plain"), tx.normalize_quotes(F.col("text")).alias("quoted"))


@query("select doc_id, regexp_replace(text, '[_—–]{3,}|-{4,}', '____', 'g') as blanked, "
       "len(regexp_extract_all(text, '[_—–]{3,}|-{4,}'))::bigint as runs from documents")
def txt_blanks(t: Tables):
    """TXT7."""
    return t.documents.select("doc_id", tx.normalize_blanks(F.col("text")).alias("blanked"), tx.blank_runs(F.col("text")).cast("long").alias("runs"))


@query(f"select doc_id, {fingerprint_sql('text')} as fp from documents")
def txt_fingerprint(t: Tables):
    """TXT8."""
    return t.documents.select("doc_id", tx.fingerprint(F.col("text")).alias("fp"))


@query(f"select doc_id, len(list_distinct(list_filter(string_split({fingerprint_sql('text')}, ' '), lambda w: w <> '')))::bigint as n_tokens, "
       f"list_aggregate(list_sort(list_distinct(list_filter(string_split({fingerprint_sql('text')}, ' '), lambda w: w <> ''))), 'string_agg', ' ') as tokens from documents")
def txt_tokens(t: Tables):
    """TXT11: the token set, sorted for comparison."""
    x = tx.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(x).cast("long").alias("n_tokens"), F.array_join(F.array_sort(x), " ").alias("tokens"))


@query(f"select doc_id, case when len({words_sql('text')}) <= 9 then 'short' else 'long' end as tier, len({words_sql('text')})::bigint as n_words from documents")
def txt_length_tier(t: Tables):
    """TXT17."""
    return t.documents.select("doc_id", tx.length_tier(F.col("text")).alias("tier"), F.size(tx.words(F.col("text"))).cast("long").alias("n_words"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as clean, trim(translate(text, '‏', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as squashed, translate(text, '‎‏‪‫‬‭‮⁦⁧⁨⁩', '') as no_bidi from documents")
def txt_clean(t: Tables):
    """TXT15, TXT16 and TXT19."""
    x = F.col("text")
    return t.documents.select("doc_id", tx.clean_text(x).alias("clean"), tx.squashed(x).alias("squashed"), tx.strip_bidi(x).alias("no_bidi"))


_WORDS = ", ".join(f"'{w}'" for w in tx.ENGLISH_WORDS if len(w) > 1)


@query("select doc_id, len(list_filter(regexp_extract_all(lower(regexp_replace(replace(text, '‏', ''), '(?s)\\$\\$.+?\\$\\$|\\$[^$]+\\$', ' ', 'g')), '[a-z]{2,}'), "
       f"lambda w: w in ({_WORDS})))::bigint as hits, hits >= 2 and source in ('src1', 'src2', 'src3') as dropped from documents")
def flt_english_prose(t: Tables):
    """FLT5/TXT18, with three sources in the place of the guarded one."""
    hits = tx.english_hits(F.col("text")).cast("long")
    return t.documents.select("doc_id", hits.alias("hits"), ((hits >= 2) & F.col("source").isin("src1", "src2", "src3")).alias("dropped"))


@query(f"select lang, count(*) as n, count(*) filter (where text <> b)::bigint as blanks_changed, count(*) filter (where text <> q)::bigint as quotes_changed, sum(length(text) - length(translate(text, '{tx.BIDI_CHARS}', '')))::bigint as bidi_chars "
       "from (select lang, text, regexp_replace(text, '[_—–]{3,}|-{4,}', '____', 'g') as b, regexp_replace(regexp_replace(text, '[“”]', '\"', 'g'), '\"{2,}', '\"', 'g') as q from documents) group by lang")
def agg_change_tallies(t: Tables):
    """AGG4 and AGG23: how many texts each transform changes, by language."""
    counts = changes(F.col("text"))
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[counts[c].alias(c) for c in ("blanks_changed", "quotes_changed", "bidi_chars")])


@query(f"select least(len({words_sql('text')}), 50)::bigint as bin, lang, count(*) as n from documents group by all")
def agg_word_histogram(t: Tables):
    """AGG19."""
    n = F.least(F.size(tx.words(F.col("text"))), F.lit(50)).cast("long")
    return t.documents.groupBy(n.alias("bin"), "lang").agg(F.count(F.lit(1)).alias("n"))


_WORD = "coalesce(list_filter(regexp_split_to_array(coalesce(text,''), '\\s+'), lambda w: w <> '')[1], 'x')"


def _word(i: int = 0):
    return F.coalesce(F.get(tx.words(F.col("text")), F.lit(i)), F.lit("x"))


def _by_id(values: list[str], column: str = "doc_id"):
    """One of ``values`` for each row, by its id."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.col(column), F.lit(len(values))).cast("int"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _by_id_sql(values: list[str], column: str = "doc_id") -> str:
    return f"[{', '.join(map(_quoted, values))}][{column} % {len(values)} + 1]"


_STARTS = ["", "کتاب ", "ﭖ ", tx.RLM + "کتاب ", "1 کتاب", "($ ژ) "]
_SCRIPT = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}"


@query(f"with x as (select doc_id, {_by_id_sql(_STARTS)} || text as x from documents) select doc_id, case when not starts_with(x, '{tx.RLM}') and regexp_matches(x, '[{_SCRIPT}\\x{{FB50}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFF}}]') and not regexp_matches(x, '^[{_SCRIPT}]') then '{tx.RLM}' || x else x end as result from x")
def txt_rlm(t: Tables):
    """TXT1: texts that begin in one script and hold another."""
    return t.documents.select("doc_id", tx.right_to_left_mark(F.concat(_by_id(_STARTS), "text")).alias("result"))


_LETTERS = ["", "x² ", "كتابي ", "ﬁ … ", "e\u0301 ", "ﷺ ه ى "]


@query()
def txt_characters(t: Tables):
    """TXT3: compatibility forms and look-alike letters before each text."""
    return t.documents.select("doc_id", tx.normalize_characters(F.concat(_by_id(_LETTERS), "text")).alias("result"))


_PREFIXES = [("A", "A) ", ""), ("B", "ب۔ ", ""), ("C", "C - ", ""), ("D", tx.RLM + "D. ", tx.RLM), ("A", "B) ", "B) "), ("E", "ھ: ", ""), ("A", "الف ) ", ""), ("D", "Dx ", "Dx ")]


@query(f"select doc_id, {_by_id_sql([k for k, _, _ in _PREFIXES])} as k, {_by_id_sql([r for _, _, r in _PREFIXES])} || 'w' || {_WORD} as result from documents")
def txt_option_prefix(t: Tables):
    """TXT4: the letter of an option, or of another, before a word of each text."""
    key, before = _by_id([k for k, _, _ in _PREFIXES]), _by_id([p for _, p, _ in _PREFIXES])
    return t.documents.select("doc_id", key.alias("k"), tx.strip_option_prefix(F.concat(before, F.lit("w"), _word()), key).alias("result"))


_MARKED = ["", "کتاب. 1,000, b? ", "a... ,5 5, x,y ", "۔ ژ.ژ. $a, b?$ "]
_INPUT = f"{_by_id_sql(_MARKED)} || coalesce(text, '')"


def _punctuated_sql(x: str) -> str:
    comma = f"replace(replace({x}, '...', '…'), '?', '؟')"
    for _ in range(2):  # neighbours of a comma may be shared by two
        comma = f"regexp_replace({comma}, '(^|[^0-9]),($|[^0-9])', '\\1،\\2', 'g')"
    return f"regexp_replace({comma}, '([\\x{{0600}}-\\x{{06FF}}])\\.', '\\1۔', 'g')"


@query(f"select doc_id, {_punctuated_sql(_INPUT)} as result from documents")
def txt_punctuation(t: Tables):
    """TXT6: marks of one script become those of another."""
    return t.documents.select("doc_id", tx.normalize_punctuation(F.concat(_by_id(_MARKED), F.coalesce("text", F.lit("")))).alias("result"))


_MATH = r"(?s)\$\$.+?\$\$|\$[^$]+\$"


@query(f"with x as (select doc_id, {_INPUT} as x from documents), y as (select doc_id, regexp_split_to_array(x, '{_MATH}') as p, regexp_extract_all(x, '{_MATH}') as m from x) select doc_id, array_to_string(list_transform(p, lambda s, i: {_punctuated_sql('s')} || coalesce(m[i], '')), '') as result from y")
def txt_math_guard(t: Tables):
    """TXT5: the same outside formulas only."""
    return t.documents.select("doc_id", tx.outside_math(F.concat(_by_id(_MARKED), F.coalesce("text", F.lit(""))), tx.normalize_punctuation).alias("result"))


_FORMULAS = ["a2 + b2 ", "log5 8 exp9)", "(x)3 a2b ", "x1 a12 2a ", "α4β ln7 "]


def _exponents_sql(x: str) -> str:
    letter = "A-Za-zΑ-Ωα-ω"
    for d, low in tx.SUBSCRIPTS.items():
        x = f"regexp_replace({x}, '\\b(log|ln|lg|exp){d}([^A-Za-z0-9]|$)', '\\1{low}\\2', 'g')"
    for d, high in tx.SUPERSCRIPTS.items():
        x = f"regexp_replace(regexp_replace({x}, '([{letter})]){d}([^A-Za-z0-9]|$)', '\\1{high}\\2', 'g'), '([{letter})]){d}([^A-Za-z0-9]|$)', '\\1{high}\\2', 'g')"
    for d, high in tx.SUPERSCRIPTS.items():
        x = f"regexp_replace(regexp_replace({x}, '([{letter}]){d}([{letter}])', '\\1{high}\\2', 'g'), '([{letter}]){d}([{letter}])', '\\1{high}\\2', 'g')"
    return x


@query(f"with x as (select doc_id, {_by_id_sql(_FORMULAS)} || coalesce(text, '') as x from documents) select doc_id, lang = 'en' as mathematics, case when lang = 'en' then {_exponents_sql('x')} else x end as result from x join documents using (doc_id)")
def txt_exponents(t: Tables):
    """TXT13: digits of formulas, in one subject only."""
    x = F.concat(_by_id(_FORMULAS), F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", (F.col("lang") == "en").alias("mathematics"), tx.convert_exponents_of(x, F.col("lang"), ("en",)).alias("result"))


_MIXED = ["", "کتاب ", "کتاب (a) ", tx.LRI + "a" + tx.PDI, "!! "]


@query()
def txt_isolates(t: Tables):
    """TXT14: left-to-right runs within and without another script."""
    return t.documents.select("doc_id", tx.isolate_left_to_right(F.concat(_by_id(_MIXED), "text")).alias("result"))


# How a level may be written, and its canonical form.
_LEVELS = [("HSSC-II", "HSSC-II"), ("SSC Part-I (9th)", "SSC-I"), ("Paper-II", "SSC-II"), ("SSA-I", "SSA-I"), ("ssc iii", "SSC-III"), ("SSA III", "SSA-II"), ("ایس ایس سی II (a)", "SSC-II"), ("ایس ایس سی", "SSC"), ("none", None), ("hssc i", "HSSC-I")]
_LEVEL_OF = "[" + ", ".join(_quoted(v) if v else "null" for _, v in _LEVELS) + f"][doc_id % {len(_LEVELS)} + 1]"


@query(f"select doc_id, {_LEVEL_OF} as level, 'q' || {_WORD} || case when {_LEVEL_OF} is null then ' none' else '' end as subdomain from documents")
def txt_level(t: Tables):
    """TXT20: a level after a word of each text."""
    x = F.concat(F.lit("q"), _word(), F.lit(" "), _by_id([v for v, _ in _LEVELS]))
    return t.documents.select("doc_id", tx.level_of(x).alias("level"), tx.without_level(x).alias("subdomain"))


_ALIASES, _RENAMES = {"src1": "first source", "src2 en": "second"}, {"src3 de": "third"}


@query("with x as (select doc_id, coalesce(source, '') as s, coalesce(lang, '') as l from documents) select doc_id, case when s = 'src1' and doc_id % 2 = 0 then 'first source' when s = 'src2' and l = 'en' and doc_id % 2 = 1 then 'second' when doc_id % 2 = 1 then s || '_' || l else s end as key, case when s = 'src3' and l = 'de' then 'third' else s || ' ' || l end as label from x")
def txt_subdomain(t: Tables):
    """TXT22: keys with aliases, labels with renames."""
    s, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    key = F.concat(F.lit("  "), F.upper(s), F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit(" "), lang)).otherwise(F.lit(" ")))
    return t.documents.select("doc_id", tx.subdomain_key(key, _ALIASES).alias("key"), tx.subdomain_label(F.concat(s, F.lit("_"), lang), _RENAMES).alias("label"))


_KEYS = ["Answer key: B\n", "The answer is (c). ", "\\boxed{D} ", "so **a** ", "Answer: د ", "(ج) ", "", "ERROR: "]


@query()
def txt_parse_key(t: Tables):
    """TXT25: ways to name a key before each turn."""
    return t.conversations.select("conv_id", "turn", tx.parse_key(F.concat(_by_id(_KEYS, "turn"), F.coalesce("text", F.lit("")))).alias("result"))


@query("select page_id, case page_id % 5 when 0 then page_id when 1 then page_id when 2 then 3 when 3 then null else 12 end::int as result from pages")
def txt_page_number(t: Tables):
    """TXT27: names of page files."""
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 5
    name = F.when(k == 0, F.concat(F.lit("x_page_"), i, F.lit("-2.png"))).when(k == 1, F.concat(F.lit("scan-"), i, F.lit("_b.jpg"))).when(k == 2, F.concat(F.lit("a"), i, F.lit("-PAGE-003.png"))).when(k == 3, F.lit("none.png")).otherwise(F.concat(i, F.lit("b.c0012.jpeg")))
    return t.pages.select("page_id", tx.page_number(name).alias("result"))


@query("select page_id, replace(replace(replace(url, '/', '__'), ':', '-'), ' ', '_') as model, replace(replace(url, '/', '_'), ':', '_') as short, trim(regexp_replace(url || ' ', '[\\\\/:*?\"<>|]+', '_', 'g')) as file from pages")
def txt_safe_name(t: Tables):
    """TXT28: three ways to make a name safe."""
    u = F.col("url")
    return t.pages.select("page_id", tx.safe_name(u).alias("model"), tx.safe_short_name(u).alias("short"), tx.safe_file_name(F.concat(u, F.lit(" "))).alias("file"))


@query("select page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') as host, case when page_id % 3 = 0 then 'plain name' when page_id % 3 = 1 then 'Known' else upper(substr(h, 1, 1)) || substr(h, 2) end as name from (select *, split_part(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', ''), '.', 1) as h from pages)")
def txt_host(t: Tables):
    """TXT24 and JN12: hosts, and names by host, by URL or as they are."""
    i = F.col("page_id") % 3
    url = F.when(i == 0, F.lit("")).when(i == 1, F.lit("https://www.known.example/x")).otherwise(F.col("url"))
    return t.pages.select("page_id", tx.host(F.col("url")).alias("host"), tx.source_name(F.lit("plain name"), url, {"known.example": "Known"}).alias("name"))


@query(f"with x as (select doc_id, len({words_sql('text')}) as n, doc_id % 4 as k from documents) select doc_id, n < 4 as short_question, k in (1, 2) as catch_all from x")
def txt_quality_flags(t: Tables):
    """FLT6 and JN13: flags of short questions and of catch-all options."""
    k = F.col("doc_id") % 4
    last = F.when(k == 1, F.concat(F.lit(tx.RLM + " "), F.lit(tx.CATCH_ALL[0]), F.lit("۔"))).when(k == 2, F.lit("None of the Above!")).when(k == 3, F.lit("none of these")).otherwise(F.lit(None).cast("string"))
    options = F.create_map(F.lit("A"), F.coalesce("source", F.lit("a")), F.lit("B"), F.lit("two"), F.lit("C"), last)
    flags = tx.quality_flags(F.col("text"), options)
    return t.documents.select("doc_id", F.array_contains(flags, "short_question").alias("short_question"), F.array_contains(flags, "catch_all").alias("catch_all"))
