"""Personal data: detection and surrogates, in DataFrame functions only.

Detected entities get keyed surrogates of the same type.  Characters keep their class
(digit, vowel or consonant, case, script), separators stay, and a Feistel network over
the character classes makes the map a permutation of all strings of one format: equal
values get equal surrogates everywhere (coreference) and different ones different ones
(distinctness).  Where a format has a validity rule (check digit of card numbers, area
codes), the permutation is walked until the surrogate obeys it as the original does,
which keeps it one-to-one.  Check digits of bank accounts are computed anew, as far off the
right ones as they were.  First names rotate within their gender and script.  Where a text
names a person in full, its other mentions of that first name or surname alone get the
same surrogates.  A collision check over the distinct entities of the table confirms
distinctness.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifterra.storage import partitions

# Character classes of surrogates.
CLASSES = [
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "AEIOU",
    "BCDFGHJKLMNPQRSTVWXYZ",
    "áéíóúàèìòùäöüâêîôûåæøœ",
    "ÁÉÍÓÚÀÈÌÒÙÄÖÜÂÊÎÔÛÅÆØŒ",
    "ñçß",
    "аеиоуыэюя",
    "бвгджзклмнпрстфхцчшщ",
    "АЕИОУЭЮЯ",
    "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "ابتثجحخدذرزسشصضطظعغفقکگلمنوہی",
]

# First names by script and gender.
FIRST_NAMES = {
    "latin_m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Steven", "Andrew", "Kenneth", "Kevin", "Brian", "George", "Edward"],
    "latin_f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Margaret", "Sandra", "Ashley", "Emily", "Michelle", "Amanda", "Melissa", "Deborah", "Stephanie", "Rebecca"],
    "cyrillic_m": ["Иван", "Сергей", "Андрей", "Дмитрий", "Николай", "Михаил", "Павел", "Борис"],
    "cyrillic_f": ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина", "Светлана", "Татьяна"],
    "arabic_m": ["احمد", "محمد", "علی", "حسن", "عمر", "خالد", "یوسف", "بلال"],
    "arabic_f": ["فاطمہ", "عائشہ", "زینب", "مریم", "سارہ", "خدیجہ", "حنا", "نادیہ"],
}

# What is detected, in order of preference.
TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof)\. "
_PERSON = r"(?:" + TITLE + r")?(?:" + "|".join(n for names in FIRST_NAMES.values() for n in names) + r")(?: \p{Lu}\.)? [\p{Lu}\p{Lo}][\p{L}'’\-]+"
#: Names of secrets in any case; a prefix (``access_token``) stays in front of the match.
SECRET_NAME = r"(?i:token|secret|passw(?:or)?d|api[_-]?key)"
PATTERNS = {
    "secret": SECRET_NAME + r"(?i:[_-]?(?:access[_-]?)?key)?(?:\\?[\"'])?\s{0,3}[=:]\s{0,3}(?:\\?[\"']|(?!" + _PERSON + r"))[A-Za-z0-9+/_.\-]{8,}+(?!@)",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}_][\p{L}\p{N}._%+\-]*+@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\+(?!1[ .\-(])\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,5}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "card": r"(?<![\d.])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\d])",
    "person": r"(?<!\p{L})" + _PERSON + r"|(?<!\p{L})" + TITLE + r"\p{Lu}[\p{L}'’\-]+",
}
#: One expression for all, each part with its own boundary; a look at the next character
#: comes first, so that most places are passed without trying any.
DETECT = (
    "(?=[AaPpSsTt])" + PATTERNS["secret"] + "|" + PATTERNS["email"]
    + r"|(?=[\p{Lu}\p{Lo}])(?:" + PATTERNS["iban"] + "|" + PATTERNS["person"] + ")"
    + r"|(?=[\d+(])(?:" + "|".join(PATTERNS[k] for k in ("ssn", "phone", "ip", "card")) + ")"
)
#: A cheap look at the whole text: every match of DETECT holds a match of this.  By kind:
#: secrets hold their name, e-mails "@", the others a digit and what must follow it at the
#: least, persons a title or the rest of a first name after its first letter.
_NAMES = [n for names in FIRST_NAMES.values() for n in names]
QUICK = r"@|\d[\d .()\-]{4}|[A-Z]{2}\d{2} ?[A-Z0-9]{4}|" + SECRET_NAME + "|[" + "".join(sorted({n[0] for n in _NAMES} | set("MDP"))) + "](?:" + "|".join([n[1:] for n in _NAMES] + [r"rs?\. ", r"s\. ", r"rof\. "]) + ")"
#: Tried until a surrogate obeys its rule; a miss has a probability below 1e-12.
WALK = 30
DEFAULT_KEY = "sifterra-surrogates"


_serial = iter(range(1 << 60))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, body) -> str:
    """SQL that evaluates ``value`` once and uses it in ``body``."""
    v = f"v{next(_serial)}"
    return f"transform(array({value}), {v} -> {body(v)})[0]"


_ALPHABETS = "array(" + ", ".join(map(_quoted, CLASSES)) + ")"


def permuted(value: str, alphabets: str, salt: str, rounds: int = 6) -> str:
    """SQL of the Feistel permutation of a string: in each round the characters of one
    parity move within their class by amounts that depend on those of the other parity."""
    n = next(_serial)
    st, r, c, i, a, d = (f"{x}{n}" for x in ("st", "r", "c", "i", "a", "d"))
    digest = f"sha2(concat_ws('|', {salt}, cast({r} as string), cast(size({st}) as string), array_join(filter({st}, ({c}, {i}) -> {i} % 2 <> {r} % 2), '')), 256)"
    move = f"cast(conv(substr({d}, pmod({i} * 4, 60) + 1, 4), 16, 10) as bigint) + {i}"
    moved = f"coalesce(try_element_at(transform(filter({alphabets}, {a} -> instr({a}, {c}) > 0), {a} -> substr({a}, cast(pmod(instr({a}, {c}) - 1 + {move}, length({a})) as int) + 1, 1)), 1), {c})"
    one = f"transform(array({digest}), {d} -> transform({st}, ({c}, {i}) -> if({i} % 2 = {r} % 2, {moved}, {c})))[0]"
    return f"array_join(aggregate(sequence(0, {rounds - 1}), regexp_extract_all({value}, '(?s).', 0), ({st}, {r}) -> {one}), '')"


def _walked(value: str, alphabets: str, salt: str, rule) -> str:
    """SQL: the permutation, and again until the rule holds as it does for the value."""
    n = next(_serial)
    x, k = f"x{n}", f"k{n}"
    start = f"named_struct('v', {value}, 'want', {rule(value)}, 'open', true)"
    moved = permuted(f"{x}.v", alphabets, salt)
    step = _let(moved, lambda v: f"named_struct('v', {v}, 'want', {x}.want, 'open', {rule(v)} <> {x}.want)")
    return f"aggregate(sequence(1, {WALK}), {start}, ({x}, {k}) -> if({x}.open, {step}, {x})).v"


def _luhn(digits: str) -> str:
    n = next(_serial)
    c, i, t, u = (f"{x}{n}" for x in ("c", "i", "t", "u"))
    twice = f"cast({c} as int) * (1 + {i} % 2)"
    terms = f"transform(regexp_extract_all(reverse({digits}), '[0-9]', 0), ({c}, {i}) -> ({twice}) div 10 + ({twice}) % 10)"
    return f"(aggregate({terms}, 0L, ({t}, {u}) -> {t} + {u}) % 10 = 0)"


def _area(digits: str) -> str:
    return f"({digits} rlike '^[2-9][0-9]{{2}}[2-9]')"


def _iban_check(country: str, rest: str) -> str:
    """SQL: the right check digits (2 to 98) of an account number."""
    n = next(_serial)
    t, c = f"t{n}", f"c{n}"
    step = f"if({c} rlike '[0-9]', ({t} * 10 + cast({c} as bigint)) % 97, ({t} * 100 + ascii({c}) - 55) % 97)"
    return f"(98 - aggregate(regexp_extract_all(concat({rest}, {country}, '00'), '[0-9A-Z]', 0), 0L, ({t}, {c}) -> {step}))"


def _iban(before: str, rest: str) -> str:
    """SQL: the number of ``before``'s country with a new rest, its check digits as far off the
    right ones as before."""
    country = f"substr({before}, 1, 2)"
    off = f"(cast(substr({before}, 3, 2) as bigint) - {_iban_check(country, f'substr({before}, 5)')})"
    return f"concat({country}, lpad(cast(pmod({_iban_check(country, rest)} + {off}, 100) as string), 2, '0'), {rest})"


def _refilled(value: str, digits: str) -> str:
    """SQL: ``value`` with its digits replaced in order by ``digits`` (as many)."""
    n = next(_serial)
    acc, c = f"acc{n}", f"c{n}"
    step = f"if({c} rlike '[0-9]', named_struct('o', concat({acc}.o, substr({acc}.d, 1, 1)), 'd', substr({acc}.d, 2)), named_struct('o', concat({acc}.o, {c}), 'd', {acc}.d))"
    return f"aggregate(regexp_extract_all({value}, '(?s).', 0), named_struct('o', '', 'd', {digits}), ({acc}, {c}) -> {step}).o"


def kind_sql(m: str) -> str:
    """SQL of the type of a detected entity, the first pattern that matches all of it."""
    inner = {k: p.replace(r"(?<![\d.])", "").replace(r"(?<!\p{L})", "") for k, p in PATTERNS.items()}
    return "case " + " ".join(f"when {m} rlike {_quoted('^(?:' + p + ')$')} then '{k}'" for k, p in inner.items()) + " else 'card' end"


def _first_name(word: str, key: str) -> str:
    """SQL: a first name of the same gender and script, or null for other words."""
    cases = []
    for group, names in FIRST_NAMES.items():
        table = "array(" + ", ".join(map(_quoted, names)) + ")"
        turn = 1 + int(hashlib.sha256(f"{key}|{group}".encode()).hexdigest()[:8], 16) % (len(names) - 1)
        cases.append(f"when array_contains({table}, {word}) then {table}[cast((array_position({table}, {word}) - 1 + {turn}) % {len(names)} as int)]")
    return "case " + " ".join(cases) + " end"


def surrogate_sql(m: str, key: str = DEFAULT_KEY) -> str:
    """SQL of struct(kind, surrogate) of a detected entity ``m`` (a lambda variable or column).

    Each kind says which part stays in front, which part is permuted in which classes,
    which rule the permuted part obeys, and whether it fills the digits of the entity.
    """
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    secret_head = _quoted(r"""^[^=:]*[=:]\s{0,3}(?:\\?["'])?""")
    country = _quoted(r"^[+](?:1(?=[^0-9]?[(]?[0-9]{3}[^0-9]?[0-9]{3}[^0-9]?[0-9]{4}$)|[0-9]{1,3}(?=[ .(-])|)")
    last = _quoted(r"[^ ]+$")
    n = next(_serial)
    w = f"w{n}"
    fronts = f"transform(split(regexp_replace({m}, {last}, ''), ' '), {w} -> coalesce({_first_name(w, key)}, {w}))"

    def parts(k: str) -> str:
        front = f"case {k} when 'secret' then regexp_extract({m}, {secret_head}, 0) when 'phone' then regexp_extract({m}, {country}, 0) when 'person' then array_join({fronts}, ' ') else '' end"
        core = (
            f"case {k} when 'secret' then regexp_replace({m}, {secret_head}, '') when 'iban' then substr({m}, 5) when 'phone' then regexp_replace(regexp_replace({m}, {country}, ''), '[^0-9]', '')"
            f" when 'person' then regexp_extract({m}, {last}, 0) when 'email' then regexp_replace({m}, '[.][^.]+$', '') when 'ip' then array_join(transform(split({m}, '[.]'), {w}x -> lower(lpad(hex(cast({w}x as bigint)), 2, '0'))), '') else {digits} end"
        )
        rest = f"case {k} when 'phone' then regexp_replace({m}, {country}, '') when 'email' then regexp_extract({m}, '[.][^.]+$', 0) else {m} end"
        return f"named_struct('kind', {k}, 'front', {front}, 'core', {core}, 'rest', {rest})"

    def moved(e: str) -> str:
        def rule(v: str) -> str:
            hexes = f"case when {v} rlike '^[0-9a-f]+$' then 1 when {v} rlike '^[0-9A-F]+$' then 2 else 0 end"
            return f"case {e}.kind when 'card' then cast({_luhn(v)} as int) when 'phone' then cast({_area(v)} as int) when 'secret' then {hexes} else 1 end"

        hexed = f"({e}.kind = 'ip' or {e}.kind = 'secret' and {e}.core rlike '^[0-9a-f]+$')"
        upper = f"({e}.kind = 'secret' and {e}.core rlike '^[0-9A-F]+$')"
        alphabets = f"case when {hexed} then array('0123456789abcdef') when {upper} then array('0123456789ABCDEF') else {_ALPHABETS} end"
        return _walked(f"{e}.core", alphabets, f"concat({_quoted(key + '|')}, {e}.kind)", rule)

    def written(e: str) -> str:
        def use(v: str) -> str:
            octet = f"o{next(_serial)}"
            ip = f"array_join(transform(sequence(0, 3), {octet} -> conv(substr({v}, 2 * {octet} + 1, 2), 16, 10)), '.')"
            out = f"case when {e}.kind in ('secret', 'person') then concat({e}.front, {v}) when {e}.kind = 'iban' then {_iban(f'{e}.rest', v)} when {e}.kind = 'email' then concat({v}, {e}.rest) when {e}.kind = 'ip' then {ip} else concat({e}.front, {_refilled(f'{e}.rest', v)}) end"
            return f"named_struct('kind', {e}.kind, 'surrogate', {out})"

        return _let(moved(e), use)

    return _let(_let(kind_sql(m), parts), written)


def _found(text: str) -> str:
    return f"if({text} rlike {_quoted(QUICK)}, regexp_extract_all({text}, {_quoted(DETECT)}, 0), array())"


def entities(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(value, n, kind, surrogate) for each distinct entity of the table."""
    each = docs.select(F.explode(F.expr(_found("text"))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    # few bytes but much work: a fixed number of partitions, which adaptive execution does not
    # join (by another expression than the grouping's, or the planner takes it for the same)
    each = each.repartition(partitions(docs.sparkSession), F.xxhash64("value"))
    return each.withColumn("made", F.expr(surrogate_sql("value", key))).select("value", "n", "made.*")


def collisions(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(kind, surrogate, n_values) where different values share one surrogate: none should."""
    by = entities(docs, key).groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n_values"))
    return by.where("n_values > 1")


def _names_of(made: str) -> str:
    """SQL: the first names and surnames (w) of the persons found, with their surrogates (s);
    titles and initials, which stay, are none."""
    n = next(_serial)
    e, x, y = (f"{c}{n}" for c in "exy")
    pairs = f"zip_with(split({e}.value, ' '), split({e}.made.surrogate, ' '), ({x}, {y}) -> named_struct('w', {x}, 's', {y}))"
    return f"filter(flatten(transform(filter({made}, {e} -> {e}.made.kind = 'person'), {e} -> {pairs})), {x} -> {x}.w <> {x}.s)"


def _mentions(part: str, names: str) -> str:
    """SQL: a part of a text between entities with its words that are one of ``names`` (an
    ``'s`` at the end apart) replaced, in one pass over its words."""
    n = next(_serial)
    t, b, x = (f"{c}{n}" for c in "tbx")
    word, owner = _quoted(r"[\p{L}'’\-]+|[^\p{L}'’\-]+"), _quoted(r"['’]s$")
    found = lambda w: f"try_element_at(filter({names}, {x} -> {x}.w = {w}), 1).s"
    base = f"regexp_replace({t}, {owner}, '')"
    one = f"coalesce({found(t)}, {_let(base, lambda v: f'concat({found(v)}, substr({t}, length({v}) + 1))')}, {t})"
    return f"array_join(transform(regexp_extract_all({part}, {word}, 0), {t} -> {one}), '')"


def _replaced(docs: DataFrame, key: str, check: bool) -> DataFrame:
    """(row, pii): each row as a struct of all its columns, the replaced text and the kinds
    found in it."""
    if check and (bad := collisions(docs.select("text"), key).limit(1).collect()):
        raise ValueError(f"two values of kind {bad[0]['kind']} share a surrogate: take another key")

    def whole(made: str) -> str:
        def text(names: str) -> str:
            between = f"if(size({names}) = 0, p, {_mentions('p', names)})"
            return f"array_join(zip_with(split(row.text, {_quoted(DETECT)}, -1), {made}, (p, e) -> concat({between}, coalesce(e.made.surrogate, ''))), '')"

        return f"named_struct('text', if(size({made}) = 0, row.text, {_let(_names_of(made), text)}), 'kinds', transform({made}, e -> e.made.kind))"

    made = f"transform({_found("coalesce(row.text, '')")}, m -> named_struct('value', m, 'made', {surrogate_sql('m', key)}))"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.withColumn("pii", F.expr(_let(made, whole)))


def replace_pii(docs: DataFrame, key: str = DEFAULT_KEY, check: bool = True) -> DataFrame:
    """``docs``, all columns, with the entities in ``text`` replaced by surrogates.

    Rows are independent: nothing is joined, and a table of any size is one pass (two
    with ``check``, which raises ValueError if two values of the table share a surrogate).
    Null texts stay null, empty and clean ones unchanged; repeated rows give repeated
    results; only ``text`` is read, whatever the other columns are called.  An empty table
    gives an empty one.
    """
    made = _replaced(docs, key, check)
    return made.select(*[F.col("pii.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def surrogate_report(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(doc_id, n_entities, kinds, text): each document with its replaced text.

    ``kinds`` are the types in the order of the text, separated by commas.  A null text
    has no entities (0 and '') and stays null; see ``replace_pii``.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = _replaced(base, key, True)
    return made.select("row.doc_id", F.size("pii.kinds").alias("n_entities"), F.array_join("pii.kinds", ",").alias("kinds"), "pii.text")
