"""Counts of what transforms change, gathered while rows are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sifterra.functions import text as tx


def changes(x: Column) -> dict[str, Column]:
    """Aggregates over texts: how many each transform changes, and how much it replaces.

    ``blank_extra`` counts the characters of blanks beyond four; ``bidi_chars`` all of the
    eleven direction marks.  Null texts count nowhere.
    """
    runs = F.regexp_extract_all(x, F.lit("[_—–]{3,}|-{4,}"), 0)
    marks = F.length(x) - F.length(tx.strip_bidi(x))
    quotes = F.regexp_replace(F.translate(x, "“”", '""'), '"{2,}', '"')
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return {
        "blanks_changed": F.count_if(x != tx.normalize_blanks(x)),
        "blank_runs": whole(F.size(runs)),
        "blank_extra": whole(F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r) - 4)),
        "quotes_changed": F.count_if(x != quotes),
        "quotes_odd": F.count_if(quotes != tx.normalize_quotes(x)),
        "ellipses": whole(F.size(F.split(x, r"\.\.\.", -1)) - 1),
        "question_marks": whole(F.length(x) - F.length(F.replace(x, F.lit("?"), F.lit("")))),
        "commas": whole(F.regexp_count(x, F.lit(r"(?U)(?<!\d),(?!\d)"))),
        "full_stops": whole(F.regexp_count(x, F.lit(f"[{tx.URDU06}]\\."))),
        "letters_mapped": whole(F.length(x) - F.length(tx.deleted(x, "".join(tx.CHARACTER_MAP)))),
        "marks_added": F.count_if(x != tx.right_to_left_mark(x)),
        "bidi_chars": whole(marks),
        "bidi_changed": F.count_if(marks > 0),
    }


def counted(rows: DataFrame, counts: dict[str, Column], write: Callable[[DataFrame], None]) -> dict[str, int]:
    """The aggregates ``counts`` over ``rows``, observed by the one pass in which ``write``
    writes them; an empty table counts 0."""
    seen = Observation()
    write(rows.observe(seen, *[c.alias(k) for k, c in counts.items()]))
    found = seen.get
    return {k: found.get(k) or 0 for k in counts}


def token_usage(used: Column) -> Column:
    """Token counts (input, output, cached) of a JSON object, 0 where one is missing."""
    x = F.from_json(used, "input long, output long, cached long")
    return F.struct(*[F.coalesce(x[k], F.lit(0)).cast("long").alias(k) for k in ("input", "output", "cached")])
