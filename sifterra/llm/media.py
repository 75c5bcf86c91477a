"""Media columns: MPEG transport streams.

``demux`` parses the program tables (association and map sections with their CRC),
checks continuity counters, reassembles elementary packets and returns, for each
elementary packet, its timestamps, its place and whether it is a random-access point.
``mux`` is the writer that stores a payload as one private elementary stream, a unit of
``UNIT`` bytes to a packet.  Both work on whole arrays of 188-byte packets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifterra.llm.columns import text_bytes, trimmed

PACKET = 188
UNIT = 576
#: 90 kHz ticks between units, units between random-access points and between tables.
TICKS, RANDOM_EVERY, TABLES_EVERY = 3600, 12, 64
MAP_PID, STREAM_PID, STREAM_TYPE = 0x1000, 0x0100, 0x06
BATCH_BYTES = 4 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def section_crc(data: bytes) -> int:
    """CRC-32 of program tables (no reflection, no final inversion); 0 over a whole section."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _table_packet(pid: int, table: int, ident: int, body: bytes) -> np.ndarray:
    """One packet with one section, continuity counter 0."""
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    section = head + body
    section += section_crc(section).to_bytes(4, "big")
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(0, 0, 1, (1).to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
_PMT = _table_packet(MAP_PID, 2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")


def mux(payload: np.ndarray) -> np.ndarray:
    """Transport stream of ``payload`` (a positive multiple of UNIT bytes).

    Each unit makes four packets: clock and random-access flag with the elementary header,
    two full ones, and one with stuffing.  Tables come before every TABLES_EVERY units.
    """
    n = len(payload) // UNIT
    units = payload.reshape(n, UNIT)
    k = np.arange(n, dtype=np.int64)
    out = np.empty((n, 4, PACKET), np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = (np.arange(4 * n).reshape(n, 4) & 15) | np.array([0x30, 0x10, 0x10, 0x30])
    ticks = (k * TICKS) & ((1 << 33) - 1)
    out[:, 0, 4] = 7
    out[:, 0, 5] = np.where(k % RANDOM_EVERY == 0, 0x50, 0x10)
    out[:, 0, 6], out[:, 0, 7], out[:, 0, 8], out[:, 0, 9] = ticks >> 25, ticks >> 17 & 255, ticks >> 9 & 255, ticks >> 1 & 255
    out[:, 0, 10], out[:, 0, 11] = (ticks & 1) << 7 | 0x7E, 0
    length = UNIT + 8
    out[:, 0, 12:21] = [0, 0, 1, 0xBD, length >> 8, length & 255, 0x80, 0x80, 5]
    out[:, 0, 21] = 0x21 | (ticks >> 29 & 0x0E)
    out[:, 0, 22], out[:, 0, 23], out[:, 0, 24], out[:, 0, 25] = ticks >> 22 & 255, ticks >> 14 & 254 | 1, ticks >> 7 & 255, (ticks << 1 & 254) | 1
    out[:, 0, 26:] = units[:, :162]
    out[:, 1, 4:], out[:, 2, 4:] = units[:, 162:346], units[:, 346:530]
    out[:, 3, 4], out[:, 3, 5], out[:, 3, 6:142] = 137, 0, 0xFF
    out[:, 3, 142:] = units[:, 530:]
    groups = -(-n // TABLES_EVERY)
    tables = np.stack([np.stack([_PAT, _PMT])] * groups)
    tables[:, :, 3] |= (np.arange(groups, dtype=np.uint8) & 15)[:, None]
    parts = []
    for g in range(groups):
        parts += [tables[g].reshape(-1), out[g * TABLES_EVERY : (g + 1) * TABLES_EVERY].reshape(-1)]
    return np.concatenate(parts)


@dataclass
class Stream:
    """One elementary stream: bytes, and per packet its offset, times and random access."""

    pid: int
    stream_type: int
    data: np.ndarray
    offsets: np.ndarray
    pts: np.ndarray
    dts: np.ndarray
    random_access: np.ndarray
    continuity_errors: int = 0


@dataclass
class Parsed:
    """Result of ``demux``; ``errors`` says what was not as the format asks."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: list[Stream] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def _sections(packets: np.ndarray, errors: list[str]) -> list[bytes]:
    """Whole sections with a right CRC from the packets of one PID, each different one once."""
    found, pending = [], b""
    for raw in dict.fromkeys(bytes([p[1] & 0x40, p[3] >> 4 & 3]) + p[4:].tobytes() for p in packets):
        start, control, body = raw[0], raw[1], raw[2:]
        if not control & 1:
            continue
        if control & 2:
            body = body[1 + body[0] :]
        if start:
            pending, body = b"", body[1 + body[0] :]
        pending += body
        while len(pending) >= 3 and pending[0] != 0xFF:
            size = 3 + ((pending[1] & 0x0F) << 8 | pending[2])
            if len(pending) < size:
                break
            section, pending = pending[:size], pending[size:]
            if section_crc(section):
                errors.append("section crc")
            else:
                found.append(section)
    return list(dict.fromkeys(found))


def _time(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.int64)
    return (h[:, 0] >> 1 & 7) << 30 | h[:, 1] << 22 | h[:, 2] >> 1 << 15 | h[:, 3] << 7 | h[:, 4] >> 1


def demux(raw: np.ndarray) -> Parsed:
    """Parse a transport stream.  Bytes that are no packets are reported, not raised."""
    out = Parsed()
    n = len(raw) // PACKET
    packets = raw[: n * PACKET].reshape(n, PACKET)
    if len(raw) % PACKET or (packets[:, 0] != 0x47).any():
        out.errors.append("sync")
        packets = packets[packets[:, 0] == 0x47]
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    types: dict[int, int] = {}
    for s in _sections(packets[pid == 0], out.errors):
        if s[0] == 0:
            for i in range(8, len(s) - 4, 4):
                if number := int.from_bytes(s[i : i + 2], "big"):
                    out.programs[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    for map_pid in out.programs.values():
        for s in _sections(packets[pid == map_pid], out.errors):
            if s[0] == 2:
                i = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
                while i < len(s) - 4:
                    types[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                    i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0x0FFF)
    for own, kind in types.items():
        out.streams.append(_elementary(packets[pid == own], own, kind, out.errors))
    return out


def _elementary(p: np.ndarray, pid: int, kind: int, errors: list[str]) -> Stream:
    control, counter = p[:, 3] >> 4 & 3, p[:, 3] & 15
    adapt = np.where(control & 2, p[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(adapt > 1, p[:, 5], 0)
    if len(p):  # a counter rises by one with each payload; one exact repeat is allowed
        step = (counter[1:].astype(np.int16) - counter[:-1]) & 15
        same = (step == 0) & (p[1:] == p[:-1]).all(1)
        wrong = np.where(control[1:] & 1, step != 1, step != 0) & ~same & ~(flags[1:] >> 7).astype(bool)
        bad = int(wrong.sum())
        keep = np.concatenate([[True], ~same]) & (control & 1 == 1) & (adapt < PACKET - 4)
    else:
        bad, keep = 0, np.zeros(0, bool)
    p, adapt, flags = p[keep], adapt[keep], flags[keep]
    start = (p[:, 1] & 0x40) > 0
    if len(p) and not start[0]:
        errors.append("payload before a start")
        first = int(np.argmax(start)) if start.any() else len(p)
        p, adapt, flags, start = p[first:], adapt[first:], flags[first:], start[first:]
    begin = 4 + adapt
    head = p[start]
    at = begin[start]
    rows = np.arange(len(head))[:, None]
    fixed = head[rows, np.minimum(at[:, None] + np.arange(19), PACKET - 1)] if len(head) else np.zeros((0, 19), np.uint8)
    if len(fixed) and ((fixed[:, :3] != [0, 0, 1]).any() or (at + 19 > PACKET).any()):
        errors.append("elementary header")
    skip = 9 + fixed[:, 8].astype(np.int32)
    has_pts, has_dts = fixed[:, 7] >> 7 == 1, fixed[:, 7] >> 6 & 1 == 1
    pts = np.where(has_pts, _time(fixed[:, 9:14]), -1)
    dts = np.where(has_dts, _time(fixed[:, 14:19]), pts)
    begin = begin.copy()
    begin[start] += skip
    data = p[np.arange(PACKET)[None] >= begin[:, None]]
    sizes = PACKET - begin
    offsets = (np.cumsum(sizes) - sizes)[start]
    said = (fixed[:, 4].astype(np.int64) << 8 | fixed[:, 5]) + 6 - skip
    got = np.diff(np.append(offsets, len(data)))
    if ((said != got) & (fixed[:, 4].astype(np.int64) + fixed[:, 5] > 0)).any():
        errors.append("elementary length")
    return Stream(pid, kind, data, offsets, pts, dts, (flags[start] & 0x40) > 0, bad)


def padded_payload(raw: np.ndarray) -> np.ndarray:
    """Bytes with 255 appended up to a positive multiple of UNIT."""
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    out = np.full(size, 255, np.uint8)
    out[: len(raw)] = raw
    return out


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text stored as a transport stream.

    Only doc_id and text are read.  A null or empty text is one unit of bytes 255; a null
    doc_id stays; repeated rows give repeated results; an empty table an empty one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            done, size, media = 0, 0, []
            for i in range(len(at) - 1):
                media.append(mux(padded_payload(raw[at[i] : at[i + 1]])).tobytes())
                size += len(media[-1])
                if size >= BATCH_BYTES or i == len(at) - 2:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[done : i + 1], pa.array(np.diff(at[done : i + 2])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    done, size, media = i + 1, 0, []

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(encode), "doc_id long, n_bytes long, media binary")


#: Columns that ``parse_media`` adds.
PARSED = "pid int, stream_type int, data binary, pts array<long>, dts array<long>, offsets array<long>, random_access array<boolean>, continuity_errors int, errors array<string>"


def parse_media(media: DataFrame) -> DataFrame:
    """One row for each elementary stream of each row of (doc_id, n_bytes, media), with its
    reassembled bytes, timestamps, packet offsets and random-access points.

    A null or broken stream gives a row with pid null and what is wrong in ``errors``.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("data", pa.binary()), ("pts", pa.list_(pa.int64())), ("dts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("random_access", pa.list_(pa.bool_())), ("continuity_errors", pa.int32()), ("errors", pa.list_(pa.string()))])
        for batch in batches:
            rows, size = [], 0
            for doc, n, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                stored = stored.as_py()
                got = demux(np.frombuffer(stored or b"", np.uint8))
                for s in got.streams:
                    rows.append((doc, n, stored, s.pid, s.stream_type, s.data.tobytes(), s.pts, s.dts, s.offsets, s.random_access, s.continuity_errors, got.errors))
                if not got.streams:
                    rows.append((doc, n, stored, None, None, None, None, None, None, None, None, [*got.errors, "no stream"]))
                size += len(stored or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(trimmed(parse), f"doc_id long, n_bytes long, media binary, {PARSED}")


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests of the stored form and of the payload read back from it, for each document."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(x) for x in data], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in data]),
                    pa.array([zlib.crc32(x[-32:]) for x in data], pa.int64()),
                    pa.array([len(x.as_py()) for x in batch.column(2)], pa.int64()),
                    pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(2)]),
                    batch.column(4),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    feature = F.concat_ws(
        ";",
        F.format_string("pid=%d", "pid"),
        F.format_string("type=%d", "stream_type"),
        F.format_string("units=%d", F.size("pts")),
        F.format_string("pts=%d-%d", F.array_min("pts"), F.array_max("pts")),
        F.format_string("random=%d", F.size(F.filter("random_access", lambda x: x))),
        F.format_string("continuity=%d", "continuity_errors"),
        F.format_string("errors=%d", F.size("errors")),
    )
    parsed = parse_media(encode_texts(docs)).select("doc_id", "n_bytes", "media", "data", feature.alias("feature"))
    return parsed.mapInArrow(trimmed(crc), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
