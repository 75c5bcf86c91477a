"""Chat formatting with a grammar round trip.

A turn is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Each rendered turn is parsed again by a
deterministic parser, and what it recovers is compared with the source; where they
differ (a text holds control strings, a role a line break), the turn is rendered at the
next level of escaping until it is identical.  The level stands in the header, so the
parser needs nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifterra.llm.columns import trimmed
from sifterra.storage import partitions

START, END, MARK = "<|im_start|>", "<|im_end|>", "<|esc|>"
LOSS_ROLE = "assistant"
_ESCAPED = re.compile(r"\\(.)", re.S)


def _escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|").replace("\n", "\\n")


def _unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _render(role: str, text: str, level: int) -> tuple[str, int, int]:
    """(rendered turn, start and end of the text in it)."""
    if level:
        head = f"{START}{_escape(role)}{MARK}\n"
        text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    else:
        head = f"{START}{role}\n"
    return f"{head}{text}{END}\n", len(head), len(head) + len(text)


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """(role, text, start and end of the written text, place after the turn).

    Grammar: START, header without control strings up to a line break, text without
    control strings, END, line break.  Anything else raises ValueError.
    """
    if not rendered.startswith(START, at):
        raise ValueError("no start")
    line = rendered.find("\n", at)
    stop = rendered.find(END, at)
    if line < 0 or stop < line or not rendered.startswith("\n", stop + len(END)):
        raise ValueError("no header or end")
    role, text = rendered[at + len(START) : line], rendered[line + 1 : stop]
    escaped = role.endswith(MARK)
    if escaped:
        role = role[: -len(MARK)]
    if any(c in x for x in (role, text) for c in (START, END, MARK)):
        raise ValueError("control string")
    if escaped:
        role, text_out = _unescape(role), _ESCAPED.sub(r"\1", text)
    else:
        text_out = text
    return role, text_out, line + 1, stop, stop + len(END) + 1


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The first level of escaping at which the parser returns role and text unchanged."""
    for level in (0, 1):
        out = _render(role, text, level)
        try:
            back = parse_turn(out[0])
        except ValueError:
            continue
        if back[:2] == (role, text) and back[4] == len(out[0]):
            return out
    raise AssertionError("escaping must make any turn parse")


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, position, segment, loss_start, loss_end): the rendered turns of each
    conversation, in order; joined without separator they are the formatted conversation.

    Rows of a conversation are ordered by turn, then role and text (ties and repeated rows
    stay, in that order; null turns come first).  A null text or role is empty.  The loss
    span (code points within the segment) is null but for assistant turns.  Rows with a
    null conv_id form one conversation.  Rows are streamed in sorted partitions, so a
    conversation of any length needs the memory of one turn.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position = object(), 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != current:
                    current, position = conv, 0
                segment, lo, hi = render_turn(role, text)
                rows.append((conv, position, segment, *((lo, hi) if role == LOSS_ROLE else (None, None))))
                position += 1
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "position", "segment", "loss_start", "loss_end"])

    clean = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = clean.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(trimmed(render), "conv_id long, position long, segment string, loss_start long, loss_end long")


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its rendered segments alone.

    ``segments`` must come straight from ``format_chat`` (whole conversations in order).
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = object(), None, []

        def close() -> None:
            if state is not None:
                n, turns, chars, loss, size, conv = state
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            for conv, segment, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, conv]
                at = 0
                while at < len(segment):
                    role, text, _, _, at = parse_turn(segment, at)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    escaped = segment[: lo - 1].endswith(MARK)
                    masked = _ESCAPED.sub(r"\1", segment[lo:hi]) if escaped else segment[lo:hi]
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(segment)
            if len(done) > 5000:
                yield flush()
        close()
        if done:
            yield flush()

    return segments.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(trimmed(digest), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
