"""Text expressions: each takes and returns a Column, stays in the JVM (NFKC excepted).

Regular expressions carry ``(?U)`` where Python's classes are Unicode-aware.  Null in,
null out unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code point ranges and characters.
URDU06 = "\\u0600-\\u06FF"
URDU = URDU06 + "\\u0750-\\u077F"
URDU_ALL = URDU + "\\uFB50-\\uFDFF\\uFE70-\\uFEFF"
RLM = "\u200f"
LRI, PDI = "\u2066", "\u2069"
BIDI_CHARS = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
MATH = "(?s)\\$\\$.+?\\$\\$|\\$[^$]+\\$"
DIACRITICS = "[\u064b-\u065f\u0670\u0610-\u061a\u0640]"
PUNCTUATION = "[\u200f\u200e,\u060c.\u06d4?\u061f!:;\"'\u201c\u201d\u2018\u2019()\\[\\]{}<>\u2014\u2013\\-_/\\\\|]"
ENGLISH_WORDS = [
    "the", "is", "are", "was", "were", "be", "been", "a", "an", "and", "or", "not", "of", "in", "on", "at",
    "to", "for", "with", "from", "by", "as", "this", "that", "these", "those", "what", "who", "whom", "where", "when", "why",
    "which", "how", "has", "have", "had", "do", "does", "did", "will", "would", "should", "could", "can", "may", "might", "must",
    "i", "you", "he", "she", "it", "we", "they", "us", "our", "his", "her", "their", "my", "your", "one", "two",
    "three", "all", "some",
]
ERROR_PREFIXES = ("ERROR", "CONNECTION_FAILED", "EMPTY_OUTPUT")
PREFIX_LETTERS = {"A": "\u0627\u0644\u0641|\u0623|A", "B": "\u0628|B", "C": "\u062c|C", "D": "\u062f|D", "E": "\u06be|\u06c1|E"}
ANSWER_LETTERS = {"\u0627": "A", "\u0623": "A", "\u0625": "A", "\u0622": "A", "\u0628": "B", "\u062c": "C", "\u062f": "D"}
CHARACTER_MAP = {"\u064a": "\u06cc", "\u0649": "\u06cc", "\u0643": "\u06a9", "\u0647": "\u06c1"}
OPTION_MAP = {"\u064a": "\u06cc", "\u0649": "\u06cc", "\u0643": "\u06a9", "\u0629": "\u06c1", "\u0640": ""}
SUPERSCRIPTS = dict(zip("23456789", "²³⁴⁵⁶⁷⁸⁹", strict=True))
SUBSCRIPTS = dict(zip("23456789", "₂₃₄₅₆₇₈₉", strict=True))
CATCH_ALL = [
    "ان میں سے کوئی نہیں",
    "مذکورہ بالا میں سے کوئی نہیں",
    "مذکورہ میں سے کوئی نہیں",
    "تمام کے تمام",
    "ان میں سے کوئی بھی نہیں",
    "none of the above",
    "all of the above",
]


def deleted(x: Column, chars: str) -> Column:
    """``x`` without any of ``chars``."""
    return F.translate(x, chars, "")


def stripped(x: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(x: Column) -> Column:
    """Array of the parts between white space; null gives an empty array."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def right_to_left_mark(x: Column) -> Column:
    """A mark before texts that hold right-to-left letters but do not start with one."""
    needs = ~x.startswith(RLM) & x.rlike(f"[{URDU_ALL}]") & ~x.rlike(f"^[{URDU}]")
    return F.when(needs, F.concat(F.lit(RLM), x)).otherwise(x)


def plain_quotes(x: Column) -> Column:
    """Curly double quotes straight, runs of them single."""
    return F.regexp_replace(F.translate(x, "\u201c\u201d", '""'), '"{2,}', '"')


def normalize_quotes(x: Column) -> Column:
    """``plain_quotes``, and an even number of them."""
    plain = plain_quotes(x)
    odd = F.regexp_count(plain, F.lit('"')) % 2 == 1
    return F.when(odd, F.concat(F.lit('"'), plain)).otherwise(plain)


_LOOK_ALIKE = str.maketrans(CHARACTER_MAP)


@F.arrow_udf(T.StringType())
def _normal_forms(x: pa.Array) -> pa.Array:
    form = unicodedata.normalize
    return pa.array([None if s is None else form("NFC", form("NFKC", s).translate(_LOOK_ALIKE)) for s in x.to_pylist()], pa.string())


def normalize_characters(x: Column) -> Column:
    """NFKC, look-alike letters to those of the language, NFC, in one Arrow batch.

    ASCII texts pass by: the function gets a null in their place (it is evaluated for all
    rows, whatever stands around it).
    """
    plain = x.rlike("^\\p{ASCII}*$")
    return F.when(plain, x).otherwise(_normal_forms(F.when(~plain, x)))


def strip_option_prefix(value: Column, key: Column) -> Column:
    """An option's own letter, with its delimiter, off its text; a leading mark stays."""
    out = value
    for letter, names in PREFIX_LETTERS.items():
        pattern = f"(?U)^[\u200f\\s]*(?:{names})(?:\\s*[):.\\-\u06d4]\\s*|\\s+(?=[^A-Za-z{URDU06}]))"
        cut = F.regexp_replace(value, pattern, "")
        cut = F.when(value.startswith(RLM) & ~cut.startswith(RLM), F.concat(F.lit(RLM), cut)).otherwise(cut)
        out = F.when((key == letter) & value.rlike(pattern), cut).otherwise(out)
    return out


def outside_math(x: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` applied to what lies outside $...$ and $$...$$."""
    plain, math = F.split(x, MATH, -1), F.regexp_extract_all(x, F.lit(MATH), 0)
    return F.array_join(F.zip_with(plain, math, lambda p, m: F.concat(change(p), F.coalesce(m, F.lit("")))), "")


def normalize_punctuation(x: Column) -> Column:
    """Ellipsis, question mark, comma (not between digits) and full stop of the script."""
    y = F.replace(F.replace(x, F.lit("..."), F.lit("…")), F.lit("?"), F.lit("؟"))
    y = F.regexp_replace(y, r"(?U)(?<!\d),(?!\d)", "،")
    return F.regexp_replace(y, f"([{URDU06}])\\.", "$1۔")


def normalize_blanks(x: Column) -> Column:
    """Runs of underscores or dashes to one blank of four."""
    return F.regexp_replace(x, "[_—–]{3,}|-{4,}", "____")


def blank_runs(x: Column) -> Column:
    """Number of runs that ``normalize_blanks`` would replace."""
    return F.size(F.regexp_extract_all(x, F.lit("[_—–]{3,}|-{4,}"), 0))


def fingerprint(x: Column) -> Column:
    """Comparable form: no diacritics, punctuation as space, lower case, single spaces;
    null gives ''."""
    y = F.regexp_replace(F.coalesce(x, F.lit("")), DIACRITICS, "")
    return F.trim(F.lower(F.regexp_replace(y, f"(?U){PUNCTUATION[:-1]}\\s]+", " ")))


def canonical_key(question: Column, options: Column) -> Column:
    """Fingerprint of the question and of the sorted option texts."""
    texts = F.array_sort(F.transform(F.map_values(options), fingerprint))
    return F.concat(fingerprint(question), F.lit("‖"), F.coalesce(F.array_join(texts, "|"), F.lit("")))


def option_signatures(options: Column) -> Column:
    """Set of option fingerprints without spaces, empty ones left out."""
    each = F.transform(F.map_values(options), lambda v: F.replace(fingerprint(v), F.lit(" "), F.lit("")))
    return F.array_distinct(F.filter(each, lambda v: v != ""))


def tokens(x: Column) -> Column:
    """Distinct words of the fingerprint."""
    return F.array_distinct(F.filter(F.split(fingerprint(x), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays taken as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def convert_exponents(x: Column) -> Column:
    """Digits after function names become subscripts, after letters superscripts."""
    y = x
    for digit, low in SUBSCRIPTS.items():
        y = F.regexp_replace(y, f"(?U)\\b(log|ln|lg|exp){digit}(?=[^A-Za-z0-9]|$)", f"$1{low}")
    for digit, high in SUPERSCRIPTS.items():
        y = F.regexp_replace(y, f"(?<=[A-Za-zΑ-Ωα-ω)]){digit}(?=[^A-Za-z0-9]|$)", high)
    for digit, high in SUPERSCRIPTS.items():
        y = F.regexp_replace(y, f"(?<=[A-Za-zΑ-Ωα-ω]){digit}(?=[A-Za-zΑ-Ωα-ω])", high)
    return y


def convert_exponents_of(x: Column, subject: Column, subjects: tuple[str, ...] = ("mathematics",)) -> Column:
    """``convert_exponents`` in the given subjects only: in others such digits are indices."""
    return F.when(F.coalesce(subject.isin(*subjects), F.lit(False)), convert_exponents(x)).otherwise(x)


def isolate_left_to_right(x: Column) -> Column:
    """Isolates around left-to-right runs within right-to-left text, or the whole text if it
    has no right-to-left letters; texts that have isolates, or no letter or digit, stay."""
    runs = F.regexp_replace(x, f"(?U)(?:(?<=[{URDU}])|^)(\\s*+)(?=[^{URDU}]*[A-Za-z0-9])([^{URDU}]*?)(\\s*)(?=[{URDU}]|\\z)", f"$1{LRI}$2{PDI}$3")
    return F.when(x.rlike(f"[{LRI}{PDI}]") | ~x.rlike("[A-Za-z0-9]"), x).when(~x.rlike(f"[{URDU}]"), F.concat(F.lit(LRI), x, F.lit(PDI))).otherwise(runs)


def strip_bidi(x: Column) -> Column:
    """Without direction marks, embeddings and isolates."""
    return deleted(x, BIDI_CHARS)


def squashed(x: Column) -> Column:
    """Without right-to-left marks and outer white space; null gives ''."""
    return stripped(deleted(F.coalesce(x, F.lit("")), RLM))


def length_tier(x: Column, boundary: int = 9) -> Column:
    """'short' up to ``boundary`` words, else 'long'."""
    return F.when(F.size(words(deleted(x, RLM))) <= boundary, "short").otherwise("long")


def english_hits(x: Column, vocabulary: list[str] = ENGLISH_WORDS) -> Column:
    """Occurrences of function words among words of two letters or more, outside math."""
    y = F.regexp_replace(deleted(F.coalesce(x, F.lit("")), RLM), MATH, " ")
    found = F.regexp_extract_all(F.lower(y), F.lit("[a-z]{2,}"), 0)
    return F.size(F.filter(found, lambda w: w.isin(*[v for v in vocabulary if len(v) > 1])))


def is_english_prose(x: Column) -> Column:
    return english_hits(x) >= 2


def clean_text(x: Column) -> Column:
    """White space collapsed and trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


# How levels are written.
_LEVEL = r"(?iU)\s*(SSC\s+Part[-\s]?(?:III|II|I)|SSC[-\s]?(?:III|II|I)|SSA[-\s]?(?:III|II|I)|HSSC[-\s]?(?:III|II|I)|Paper[-\s]?(?:III|II|I)|ایس ایس سی\s*(?:III|II|I)?)\s*(?:\([^)]*\))?"


def level_of(x: Column) -> Column:
    """Canonical level of the first level token in a subdomain, null without one."""
    token = F.upper(stripped(F.regexp_extract(x, _LEVEL, 1)))
    roman = F.regexp_extract(token, "(III|II|I)$", 1)
    two = F.when(roman == "III", "II").otherwise(roman)
    kind = F.when(token.startswith("SSC"), F.concat(F.lit("SSC-"), roman)).when(token.startswith("SSA"), F.concat(F.lit("SSA-"), two))
    kind = kind.when(token.startswith("HSSC"), F.concat(F.lit("HSSC-"), two)).when(token.startswith("PAPER"), F.concat(F.lit("SSC-"), two))
    script = F.when(two != "", F.concat(F.lit("SSC-"), two)).otherwise("SSC")
    return F.when(x.rlike(_LEVEL), kind.otherwise(script))


def without_level(x: Column) -> Column:
    """A subdomain without its level tokens; unchanged without one."""
    return F.when(x.rlike(_LEVEL), stripped(F.regexp_replace(x, _LEVEL, ""))).otherwise(x)


def host(url: Column) -> Column:
    """Host of a URL, lower case, without 'www.'; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def source_name(name: Column, url: Column, display: Mapping[str, str]) -> Column:
    """Display name by host, else the host's first label in title case, else by name."""
    table = F.create_map(*[F.lit(v) for kv in display.items() for v in kv]) if display else F.create_map()
    by_host = F.coalesce(F.try_element_at(table, host(url)), F.initcap(F.split_part(host(url), F.lit("."), F.lit(1))))
    return F.when(F.coalesce(url, F.lit("")) != "", by_host).otherwise(F.coalesce(F.try_element_at(table, name), name))


def _renamed(x: Column, names: Mapping[str, str], otherwise: Column) -> Column:
    if not names:
        return otherwise
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x), otherwise)


def subdomain_key(x: Column, aliases: Mapping[str, str] = {}) -> Column:  # noqa: B006
    """Lower case with underscores, or the alias of the lower-case name."""
    low = F.lower(stripped(x))
    return _renamed(low, aliases, F.replace(low, F.lit(" "), F.lit("_")))


def subdomain_label(x: Column, renames: Mapping[str, str] = {}) -> Column:  # noqa: B006
    """Spaces for underscores, then renamed; null is empty."""
    name = stripped(F.replace(F.coalesce(x, F.lit("")), F.lit("_"), F.lit(" ")))
    return _renamed(name, renames, name)


def safe_name(x: Column) -> Column:
    """Model name as a file name."""
    return F.replace(F.replace(F.replace(x, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("-")), F.lit(" "), F.lit("_"))


def safe_short_name(x: Column) -> Column:
    """A name with single underscores for slashes and colons."""
    return F.translate(x, "/:", "__")


def safe_file_name(x: Column) -> Column:
    """A name without characters that file systems forbid, runs of them as one underscore."""
    return stripped(F.regexp_replace(x, r'[\\/:*?"<>|]+', "_"))


def page_number(x: Column) -> Column:
    """Number after 'page', else the last digits before the extension, else null."""
    named, last = F.regexp_extract(x, r"[_-]page[_-](\d+)", 1), F.regexp_extract(x, r"(\d+)[^0-9]*\.[^.]*$", 1)
    return F.when(named != "", named).when(last != "", last).cast("int")


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", "")


def is_error(x: Column) -> Column:
    """Empty, or one of the client's error strings."""
    y = stripped(F.coalesce(x, F.lit("")))
    return (y == "") | y.startswith(ERROR_PREFIXES[0]) | y.startswith(ERROR_PREFIXES[1]) | y.startswith(ERROR_PREFIXES[2])


# What counts as an answer, in order of preference; K is an answer letter.
ANSWER_PATTERNS = [
    r"Answer\s*key\s*[:\-]\s*\(?\s*(K)\s*\)?",
    r"\bFinal\s*Answer\s*[:\-]\s*\(?\s*(K)\s*\)?",
    r"\bAnswer\s*[:\-]\s*\(?\s*(K)\s*\)?",
    r"\bThe\s*answer\s*is\s*\(?\s*(K)\s*\)?",
    r"\bcorrect\s*answer\s*is\s*\(?\s*(K)\s*\)?",
    r"\\boxed\{\s*\(?\s*(K)\s*\)?\s*\}",
    r"(?:^|\s)\*\*\s*(K)\s*\*\*",
    r"(?:^|\s)__\s*(K)\s*__",
    r"(?:^|\n)\s*\(?\s*(K)\s*[\)\.\:]\s*",
    r"(?<![A-Za-z])([ABCD])(?![A-Za-z])",
]


def parse_key(x: Column) -> Column:
    """Answer letter A-D of a prediction, null where there is none."""
    letters = "".join(ANSWER_LETTERS)
    y = stripped(x)
    found = [F.regexp_extract(y, "(?iuU)" + p.replace("(K)", f"([ABCD{letters}])"), 1) for p in ANSWER_PATTERNS]
    found.append(F.regexp_extract(y, f"(?U)(?:^|[\\s(\\[.,:;])([{letters}])(?:[\\s).,:;\\-]|$)", 1))
    first = F.coalesce(*[F.when(f != "", f) for f in found])
    return F.when(~is_error(x), F.upper(F.translate(first, letters, "".join(ANSWER_LETTERS.values()))))


def option_text(x: Column) -> Column:
    """Text for comparing with options: look-alike letters folded, single spaces."""
    keep = {k: v for k, v in OPTION_MAP.items() if v}
    return clean_text(deleted(F.translate(x, "".join(keep), "".join(keep.values())), "".join(k for k, v in OPTION_MAP.items() if not v)))


def _match_options(text: Column, options: Column) -> Column:
    t = option_text(text)
    exact = F.map_filter(options, lambda k, v: option_text(v) == t)
    part = F.map_filter(options, lambda k, v: F.contains(option_text(v), t) | F.contains(t, option_text(v)))
    one = lambda m: F.when(F.size(m) == 1, F.upper(F.map_keys(m)[0]))
    return F.when(t != "", F.coalesce(one(exact), one(part)))


def parse_key_from_options(x: Column, options: Column) -> Column:
    """Letter of the one option that the answer text (else the whole prediction) matches."""
    said = stripped(F.regexp_extract(x, r"(?iuU)Answer\s*text\s*[:\-]\s*(.+?)(?:\n|$)", 1))
    return F.coalesce(F.when(said != "", _match_options(said, options)), F.when(F.coalesce(x, F.lit("")) != "", _match_options(x, options)))


def unfenced(x: Column) -> Column:
    """A model's reply without code fences."""
    return stripped(F.regexp_replace(x, r"(?m)^\s*```[A-Za-z]*\s*$", ""))


def catch_all(options: Column) -> Column:
    """Whether an option holds one of the catch-all phrases, as it is or lower-cased."""
    clean = lambda v: stripped(deleted(v, RLM))
    any_in = lambda v: F.exists(F.array(*[F.lit(p) for p in CATCH_ALL]), lambda p: F.contains(v, p) | F.contains(F.lower(v), p))
    return F.coalesce(F.exists(F.map_values(options), lambda v: F.coalesce(any_in(clean(v)), F.lit(False))), F.lit(False))


def quality_flags(question: Column, options: Column) -> Column:
    """'short_question' for fewer than 4 words, 'catch_all' for such options."""
    short = F.when(F.size(words(deleted(question, RLM))) < 4, F.lit("short_question"))
    return F.array_compact(F.array(short, F.when(catch_all(options), F.lit("catch_all"))))
