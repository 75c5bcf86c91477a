"""Repair of conversation structure by dynamic programming on a shared trie.

A conversation's rows are reduced to a signature, a character for each row's role and
fault, last row first.  Distinct signatures are sorted, so that a task meets them in the
order of a walk through their prefix trie: the path from the root to the last signature is
all of the trie that is ever held, and a layer (cheapest cost from each state of the role
grammar to the end) is computed once for each shared prefix.  At a terminal node the walk
back to the root reads the edits off, first row first.  All conversations of a signature
share its answer.

Grammar of role initials: ``(s?(ua)+)?``.  Edits: Keep 0, Rerole (to user or assistant) 3,
Delete 4 (required for blank and duplicate rows), Insert an empty user or assistant row 3;
a truncated row that is not deleted adds 3.  Of the cheapest edits the ones whose initials
are least in ASCII are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifterra.llm.columns import trimmed
from sifterra.storage import materialize, partitions

WHITE = "\t\n\x0b\f\r "
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a.  Where the next new row leads, and its role.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Letters of a plan and the initials of their edits: u and a insert, U and A rerole.
PLAN, INITIALS = "DuaKUA", "DIIKRR"
_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 marks the row as gone, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 sets
    role user.  A null stands as one space in the key, the role and the text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    out = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(k == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (k == 0).alias("gone"), k.alias("k"))
    return out.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k", "copy")


def diagnosed(turns: DataFrame) -> DataFrame:
    """Each row with its place (from 1, by turn, nulls first, then role and text), its first
    fault (blank, duplicate, truncated or null), ``illegal`` (its initial may not follow the
    one before), ``new_turn`` and ``symbol`` (the character of its signature).

    ``turns`` has conv_id, turn, role, text and, if rows are to count as absent, ``gone``.
    """
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), gone.alias("gone"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    order = Window.partitionBy("conv_id", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial, kept = F.substring("role", 1, 1), F.rtrim("text", F.lit(WHITE))
    rows = rows.withColumns({"pos": F.row_number().over(order).cast("long"), "initial": initial, "before": F.lag(initial).over(order), "turn_before": F.lag("turn").over(order), "last": F.right(kept, F.lit(1))})
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("pos")) > 1
    fault = F.when(F.col("last") == "", "blank").when(seen, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    symbol = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return rows.withColumn("fault", fault).select(
        "conv_id", "gone", "turn", "pos", "role", "text", "fault",
        (F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
        F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(symbol)).otherwise(symbol).alias("symbol"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of each conversation
    of ``diagnosed`` rows; the signature lists the symbols from the last row to the first."""
    here = ~F.col("gone")
    count = lambda c: F.count(F.when(here & c, 1))
    turn = F.when(here, F.col("turn"))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1, F.lit(0)) - count(F.col("new_turn"))
    listed = F.sort_array(F.collect_list(F.when(here, F.struct("pos", "symbol"))), asc=False)
    return rows.groupBy("conv_id").agg(
        gaps.cast("long").alias("gaps"),
        *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(listed, lambda x: x["symbol"]), "").alias("signature"),
    )


class RepairTrie:
    """The path of the last signature in the trie: costs and plan letters of each layer."""

    def __init__(self) -> None:
        self.path = ""
        self.costs: list[tuple[float, ...]] = [(0, 2 * INSERT, INSERT, 0)]
        self.letters: list[str] = [" ua "]  # of each state; a blank: the end
        self.computed = 0  # layers so far

    def _layer(self, symbol: str) -> None:
        after = self.costs[-1]
        extra = TRUNCATED if symbol.isupper() else 0
        keeps = _AFTER.get(symbol.lower(), (None,) * 4)
        options = []  # of each state: (cost, edit's initial, plan letter)
        for q in range(4):
            mine = [(DELETE + after[q], "D", "D")]
            if symbol != "x":
                if keeps[q] is not None:
                    mine.append((KEEP + extra + after[keeps[q]], "K", "K"))
                mine.append((REROLE + extra + after[_NEXT[q]], "R", _ROLE[q][0].upper()))
            options.append(mine)
        base = [min(o)[0] for o in options]
        two = min(base[2], INSERT + base[3])
        cost = (min(base[0], INSERT + two), min(base[1], INSERT + two), two, min(base[3], INSERT + two))
        for q in range(4):
            options[q].append((INSERT + cost[_NEXT[q]], "I", _ROLE[q][0]))
        self.costs.append(cost)
        self.letters.append("".join(min(o[1:] for o in options[q] if o[0] == cost[q])[1] for q in range(4)))
        self.computed += 1

    def insert(self, signature: str) -> tuple[int, str]:
        """(cost, plan) of a signature; layers of the prefix that it shares with the last one stay."""
        shared, most = 0, min(len(signature), len(self.path))
        while shared < most and signature[shared] == self.path[shared]:
            shared += 1
        del self.costs[shared + 1 :], self.letters[shared + 1 :]
        for symbol in signature[shared:]:
            self._layer(symbol)
        self.path = signature
        plan, q, depth = [], 0, len(signature)
        while (letter := self.letters[depth][q]) != " ":
            plan.append(letter)
            if letter in "ua":
                q = _NEXT[q]
                continue
            if letter in "UA":
                q = _NEXT[q]
            elif letter == "K":
                q = _AFTER[signature[depth - 1].lower()][q]
            depth -= 1
        return int(self.costs[-1][0]), "".join(plan)


def plans(found: DataFrame) -> DataFrame:
    """(signature, cost, plan) of the distinct signatures of ``found``."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RepairTrie()
        for batch in batches:
            got = [trie.insert(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in got], pa.int64()), pa.array([p for _, p in got], pa.string())], ["signature", "cost", "plan"])

    ordered = found.select("signature").distinct().repartitionByRange(partitions(found.sparkSession), "signature").sortWithinPartitions("signature")
    return ordered.mapInArrow(trimmed(solve), "signature string, cost long, plan string")


class Replay:
    """A plan carried out on a conversation's rows, one after the other."""

    def __init__(self, plan: str) -> None:
        self.plan, self.at = plan, 0

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.plan) and self.plan[self.at] in "ua":
            yield ("user" if self.plan[self.at] == "u" else "assistant"), ""
            self.at += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        letter = self.plan[self.at]
        self.at += 1
        if letter != "D":
            yield {"K": role, "U": "user", "A": "assistant"}[letter], text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def _with_plans(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of each conversation behind the row of its plan (at place 0), in order."""
    kinds = {"plan": "string", "cost": "long"} | {c: "long" for c in _STATS}
    heads = answers.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *kinds)
    lines = rows.where("not gone").select("conv_id", "pos", "role", "text", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    return heads.unionAll(lines).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos")


def _prepared(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Diagnosed rows, and (conv_id, statistics, signature, cost, plan)."""
    rows = materialize(diagnosed(turns), "rows")
    found = materialize(signatures(rows), "signatures")
    return rows, found.join(plans(found), "signature")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired rows of each conversation, from 0."""

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, position, out = None, None, 0, []

        def emit(lines: Iterable[tuple[str, str]]) -> None:
            nonlocal position
            for role, text in lines:
                out.append((conv, position, role, text))
                position += 1

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "position", "role", "text"])
            out.clear()
            return made

        for batch in batches:
            for c, pos, role, text, plan in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if pos == 0:
                    emit(state.rest() if state else ())
                    conv, state, position = c, Replay(plan), 0
                else:
                    emit(state.row(role, text))
            yield flush()
        emit(state.rest() if state else ())
        yield flush()

    rows, answers = _prepared(turns)
    return _with_plans(rows, answers).select("conv_id", "pos", "role", "text", "plan").mapInArrow(trimmed(replay), "conv_id long, position long, role string, text string")


def repair_report(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    One row for each conv_id of ``turns`` (a null one is a conversation, too); one whose rows
    are all ``gone`` has zeros, an empty audit and the hash of an empty string.  Null roles
    and texts stand as one space.  Rows of equal turn are ordered by role and text, so
    repeated rows are neighbours.  An empty table gives an empty result.  Only conv_id, turn,
    role, text and ``gone`` are read.

    Texts are streamed through tasks and hashed piece by piece; what one task holds of a
    conversation is its signature and plan, a character a row.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, sha, first, head, done = None, hashlib.sha256(), True, None, []

        def add(lines: Iterable[tuple[str, str]]) -> None:
            nonlocal first
            for role, text in lines:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        def close() -> None:
            if state:
                add(state.rest())
                done.append((*head, sha.hexdigest()))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], ["conv_id", *_STATS, "cost", "audit", "repaired_sha256"])
            done.clear()
            return made

        initials = str.maketrans(PLAN, INITIALS)
        for batch in batches:
            for conv, pos, role, text, plan, cost, *stats in zip(*(batch.column(i).to_pylist() for i in range(11)), strict=True):
                if pos == 0:
                    close()
                    state, sha, first, head = Replay(plan), hashlib.sha256(), True, (conv, *stats, cost, plan.translate(initials))
                else:
                    add(state.row(role, text))
            yield flush()
        close()
        yield flush()

    rows, answers = _prepared(turns)
    return _with_plans(rows, answers).mapInArrow(trimmed(digest), "conv_id long, " + ", ".join(f"{c} long" for c in _STATS) + ", cost long, audit string, repaired_sha256 string")
