"""A media column as MPEG transport streams: writing, reading and features.

`mux` stores 8-bit samples in one program: packets of 188 bytes, a program association table and a
program map table with their checksums, and elementary packets with presentation times. Every
elementary packet starts with a clock reference and every eighth (the first included) is marked as
a random-access point. `demux` is a general reader: it finds the packet grid, reads program tables,
checks continuity counters (a repeated packet is dropped, a gap is counted and, where the stream says
so, forgiven), reassembles elementary packets per stream and gives their times and random-access points.

Cases: a null or empty text is one unit of blanks; equal texts give equal bytes; rows are handled
one by one, so repeated rows repeat; very long texts take more elementary packets; no row is dropped;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_bytes

PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0, 0x100, 0x101, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private elementary packets
#: Samples a unit, units an elementary packet, and 90 kHz ticks a unit (192 samples at 8 kHz).
UNIT, UNITS_A_PES, TICKS = 192, 60, 2160
RANDOM_ACCESS_EVERY = 8
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, first_pts long, last_pts long, random_access_points array<long>, continuity_errors int"
)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 04C11DB7, most significant bit first, no final inversion."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, extension >> 8, extension & 255, 0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _table_packet(
    PMT_PID,
    _section(2, PROGRAM, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0])),
)


def _time(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def _clock(t: int) -> bytes:
    return ((t & 0x1FFFFFFFF) << 15 | 0x3F << 9).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload, whose length is a positive multiple of UNIT."""
    out, counter, size = [_TABLES], 0, UNIT * UNITS_A_PES
    for k, at in enumerate(range(0, len(payload), size)):
        chunk = payload[at : at + size]
        time = at // UNIT * TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(chunk) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(2, time & 0x1FFFFFFFF) + chunk
        access = 0x40 if k % RANDOM_ACCESS_EVERY == 0 else 0
        n = 1 + max(0, -(-(len(pes) - 176) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = STREAM_PID >> 8
        packets[:, 2] = STREAM_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        body = np.frombuffer(pes, np.uint8)
        first = min(176, len(body))
        field_size = 183 - first  # the adaptation field also stuffs an only packet
        packets[0, 4:12] = np.frombuffer(bytes([field_size, access | 0x10]) + _clock(time), np.uint8)
        packets[0, PACKET - first :] = body[:first]
        rest = body[first:]
        if n > 1:
            full = len(rest) // 184
            packets[1 : 1 + full, 4:] = rest[: full * 184].reshape(full, 184)
            last = rest[full * 184 :]
            if len(last):
                packets[n - 1, 3] |= 0x20
                packets[n - 1, 4] = 183 - len(last)
                if len(last) < 183:
                    packets[n - 1, 5] = 0
                packets[n - 1, PACKET - len(last) :] = last
        counter = (counter + n) & 15
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """One elementary stream as read."""

    pid: int
    stream_type: int
    program: int
    packets: list[bytes] = field(default_factory=list)
    times: list[int | None] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    continuity_errors: int = 0

    @property
    def data(self) -> bytes:
        return b"".join(self.packets)


def _grid(data: bytes) -> np.ndarray:
    """The packets from the first offset at which sync bytes stand at every step; bad ones are left out."""
    if len(data) >= PACKET and data[0] == SYNC and len(data) % PACKET == 0:
        grid = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    else:
        raw = np.frombuffer(data, np.uint8)
        if len(raw) < PACKET:
            return np.zeros((0, PACKET), np.uint8)
        hits = [int((raw[k :: PACKET] == SYNC)[: (len(raw) - k) // PACKET].sum()) for k in range(min(PACKET, len(raw) - PACKET + 1))]
        k = int(np.argmax(hits))
        grid = raw[k : k + (len(raw) - k) // PACKET * PACKET].reshape(-1, PACKET)
    return grid[(grid[:, 0] == SYNC) & (grid[:, 1] & 0x80 == 0)]


def _sections(grid: np.ndarray, pid: np.ndarray, wanted: int, start: np.ndarray) -> Iterator[bytes]:
    """Sections with a right checksum from the packets of one PID."""
    held = b""
    for i in np.flatnonzero(pid == wanted):
        body = grid[i, start[i] :].tobytes()
        if grid[i, 1] & 0x40:
            pointer = body[0] if body else 0
            held = body[1 + pointer :]
        else:
            held += body
        while len(held) >= 3 and held[0] != 0xFF:
            n = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < n:
                break
            if section_crc(held[:n]) == 0:
                yield held[:n]
            held = held[n:]


def demux(data: bytes) -> dict[int, Stream]:
    """Elementary streams by PID, as the program tables announce them."""
    grid = _grid(data)
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    control = grid[:, 3] >> 4 & 3
    adapted, loaded = control & 2 > 0, control & 1 > 0
    start = np.where(adapted, 5 + grid[:, 4].astype(np.int32), 4)
    start = np.where(loaded, np.minimum(start, PACKET), PACKET)
    flags = np.where(adapted & (grid[:, 4] > 0), grid[:, 5], 0)
    streams: dict[int, Stream] = {}
    programs: dict[int, int] = {}
    for s in _sections(grid, pid, PAT_PID, start):
        if s[0] == 0:
            for k in range(8, len(s) - 4, 4):
                if number := s[k] << 8 | s[k + 1]:
                    programs[number] = (s[k + 2] & 0x1F) << 8 | s[k + 3]
    for number, table in programs.items():
        for s in _sections(grid, pid, table, start):
            if s[0] != 2:
                continue
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k + 5 <= len(s) - 4:
                p = (s[k + 1] & 0x1F) << 8 | s[k + 2]
                streams.setdefault(p, Stream(p, s[k], number))
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    for p, stream in streams.items():
        own = np.flatnonzero((pid == p) & loaded)
        if len(own) == 0:
            continue
        count = grid[own, 3] & 15
        step = (count[1:].astype(np.int16) - count[:-1]) & 15
        again = np.concatenate([[False], (step == 0) & (grid[own[1:], 4:] == grid[own[:-1], 4:]).all(axis=1)])
        forgiven = flags[own[1:]] & 0x80 > 0
        stream.continuity_errors = int(((step != 1) & ~again[1:] & ~forgiven).sum())
        own = own[~again]
        bounds = np.flatnonzero(grid[own, 1] & 0x40)
        column = np.arange(PACKET)
        for a, b in zip(bounds, [*bounds[1:], len(own)], strict=True):
            part = own[a:b]
            pes = grid[part][column >= start[part][:, None]].tobytes()
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                stream.continuity_errors += 1
                continue
            size = pes[4] << 8 | pes[5]
            body = pes[9 + pes[8] : 6 + size] if size else pes[9 + pes[8] :]
            time = None
            if pes[7] & 0x80:
                t = pes[9:14]
                time = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
            if flags[part[0]] & 0x40:
                stream.random_access.append(len(stream.packets))
            stream.packets.append(body)
            stream.times.append(time)
    return streams


def payload_of(text: bytes) -> bytes:
    """The bytes with blanks up to a positive multiple of a unit."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def features(streams: dict[int, Stream]) -> str:
    """Program layout, times, random-access points and the loudness of the samples."""
    out = []
    for s in streams.values():
        samples = np.frombuffer(s.data, np.uint8)
        level = int(np.abs(samples.astype(np.int16) - 128).sum()) / max(1, len(samples))
        times = [t for t in s.times if t is not None]
        out.append(f"program={s.program};pid={s.pid};type={s.stream_type};pes={len(s.packets)};pts={times[0] if times else ''}-{times[-1] if times else ''};access={len(s.random_access)};errors={s.continuity_errors};level={level:.4f}")
    return "|".join(out)


def media_table(docs: DataFrame) -> DataFrame:
    """Every text as a transport stream, read back: one row a document with checks and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                rows = []
                for text in text_bytes(batch.column(1)):
                    media = mux(payload_of(text))
                    streams = demux(media)
                    s = streams[STREAM_PID]
                    back = s.data
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(streams), s.times[0], s.times[-1], [s.times[i] for i in s.random_access], s.continuity_errors))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
