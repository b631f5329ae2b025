"""MPEG transport streams in a binary column: tables, continuity, elementary packets, timestamps.

`demux` reads 188-byte packets (or 192- and 204-byte ones, by where the sync
bytes repeat), resynchronises after damage, and checks the 4-bit continuity
counter of every PID, tables too: an exact repeat of a packet is a legal
duplicate and is skipped, a set discontinuity indicator excuses the next jump,
any other jump is a discontinuity. It assembles program association and map
sections (checked by length and CRC-32/MPEG-2), follows each elementary PID that
a map names, also for packets before the map, puts PES packets together, drops
one that a gap falls into, and stores each one's PTS and DTS, size and place,
with the random-access flag.

There is no media table, so `streams_of` multiplexes the html of `pages` into
transport streams, a program with a PES stream each; every 16th page loses a
packet and every 16th repeats one, so both counters are exercised.

Defined cases: null gives null; empty bytes, and bytes without three sync bytes
in step, give no packets and no programs; a cut-off last packet is ignored; a
packet that says it has errors, or whose adaptation field doesn't fit, is
counted as broken and not read; an unbounded PES packet ends where the next
starts; a PES packet shorter than it says is damaged; one that was complete
before a gap isn't; stream ids without an optional header are all payload,
padding has none; sections that are too short, cut off by a gap or another
section, or have a wrong CRC are counted as bad; tables that aren't in force yet
are skipped; of several maps that name a PID the first counts; PIDs that no
program names are counted only; scrambled packets are counted and not assembled;
null ids and repeated rows are treated like any other; very long streams are read
whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import subset

_INT, _LONG = (T.IntegerType(), pa.int32()), (T.LongType(), pa.int64())
_PES = {"pid": _INT, "packet": _INT, "pts": _LONG, "dts": _LONG, "size": _INT, "random_access": (T.BooleanType(), pa.bool_())}
_STREAM = {n: _INT for n in ("program", "pid", "stream_type", "pes_packets", "damaged", "discontinuities", "duplicates")} | {"payload": (T.BinaryType(), pa.binary())}
COUNTS = ("packets", "broken_packets", "bad_sections", "unnamed_packets", "scrambled_packets", "discontinuities", "duplicates")
RESULT = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in COUNTS] + [T.StructField(n, T.ArrayType(T.StructType([T.StructField(k, t) for k, (t, _) in fields.items()]))) for n, fields in (("streams", _STREAM), ("pes", _PES))]
)
_ARROW = pa.struct([(n, pa.int32()) for n in COUNTS] + [(n, pa.list_(pa.struct([(k, t) for k, (_, t) in fields.items()]))) for n, fields in (("streams", _STREAM), ("pes", _PES))])

_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC.append(_c)


def crc32(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def packets(data: bytes) -> Iterator[bytes]:
    """Whole 188-byte packets. Sync is three sync bytes in step, or as many as the bytes left allow."""
    n, at, step = len(data), 0, 0
    while at + 188 <= n:
        if step and data[at] == 0x47:
            yield data[at : at + 188]
            at += step
            continue
        step = 0
        at = data.find(b"\x47", at)
        if at < 0:
            return
        for size in (188, 192, 204):
            more = [at + k * size for k in (1, 2) if at + k * size < n]
            if at + 188 <= n and all(data[q] == 0x47 for q in more):
                step = size
                break
        else:
            at += 1


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


#: stream ids whose packets have no optional header
_BARE = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))
PADDING = 0xBE


class _Counter:
    """The continuity of a PID."""

    __slots__ = ("last", "body", "repeated", "excused", "gaps", "repeats")

    def __init__(self) -> None:
        self.last, self.body = -1, b""
        self.repeated = self.excused = False
        self.gaps = self.repeats = 0

    def take(self, counter: int, body: bytes) -> tuple[bool, bool]:
        """(whether the packet is new, whether some were lost before it)"""
        if counter == self.last and body == self.body and not self.repeated and not self.excused:
            self.repeated = True
            self.repeats += 1
            return False, False
        gap = self.last >= 0 and counter != (self.last + 1 & 15) and not self.excused
        self.gaps += gap
        self.last, self.body, self.repeated, self.excused = counter, body, False, False
        return True, gap


class _Stream:
    def __init__(self, program: int, kind: int) -> None:
        self.program, self.kind = program, kind
        self.pes = self.damaged = 0
        self.parts: list[bytes] | None = None
        self.where, self.entry = 0, False
        self.payload: list[bytes] = []

    def finish(self, pid: int, out: list[dict], gap: bool = False) -> None:
        """End the open PES packet; `gap`: it lacks what came last unless it has all that it says."""
        if self.parts is None:
            return
        data, self.parts = b"".join(self.parts), None
        if len(data) < 6 or data[:3] != b"\0\0\1":
            self.damaged += 1
            return
        kind, size = data[3], data[4] << 8 | data[5]
        end = size + 6 if size else len(data)
        if len(data) < end or (gap and not size):
            self.damaged += 1
            return
        pts = dts = None
        if kind in _BARE:
            body = b"" if kind == PADDING else data[6:end]
        else:
            if end < 9 or data[6] >> 6 != 2 or 9 + data[8] > end:
                self.damaged += 1
                return
            body, flags = data[9 + data[8] : end], data[7] >> 6
            pts = _stamp(data[9:14]) if flags & 2 and data[8] >= 5 else None
            dts = _stamp(data[14:19]) if flags == 3 and data[8] >= 10 else None
        self.pes += 1
        self.payload.append(body)
        out.append({"pid": pid, "packet": self.where, "pts": pts, "dts": dts, "size": len(body), "random_access": self.entry})


class _Tables:
    """Sections of the PIDs that carry them."""

    def __init__(self) -> None:
        self.held: dict[int, bytearray] = {}
        self.bad = 0

    def feed(self, pid: int, start: bool, body: bytes, gap: bool) -> Iterator[bytes]:
        """Whole sections with a right CRC."""
        if gap and self.held.pop(pid, None):
            self.bad += 1
        if start:
            if not body:
                return
            pointer = body[0]
            if pid in self.held:
                self.held[pid] += body[1 : 1 + pointer]
                yield from self._whole(pid)
                self.bad += bool(self.held.pop(pid, None))
            self.held[pid] = bytearray(body[1 + pointer :])
        elif pid in self.held:
            self.held[pid] += body
        else:
            return
        yield from self._whole(pid)

    def _whole(self, pid: int) -> Iterator[bytes]:
        buf = self.held[pid]
        while len(buf) >= 3 and buf[0] != 0xFF:
            size = 3 + ((buf[1] & 15) << 8 | buf[2])
            if len(buf) < size:
                return
            s = bytes(buf[:size])
            del buf[:size]
            if s[1] & 0x80 and size >= 12 and not crc32(s):
                yield s
            elif s[0] in (0, 2):  # other tables may be short ones without a CRC
                self.bad += 1
        if not buf or buf[0] == 0xFF:
            del self.held[pid]


def _read(p: bytes) -> tuple[int, int, bytes | None] | None:
    """(flags of the adaptation field, its length, payload) of a packet; None where it is broken."""
    if p[1] & 0x80:
        return None
    control = p[3] >> 4 & 3
    if not control & 2:
        return 0, 0, p[4:] if control else None
    length = p[4]
    if length > (182 if control & 1 else 183):
        return None
    return p[5] if length else 0, length, p[5 + length :] if control & 1 else None


def _programs(s: bytes) -> Iterator[tuple[int, int]]:
    """(PID of the map, program) of an association section."""
    for k in range(8, len(s) - 7, 4):
        if program := s[k] << 8 | s[k + 1]:
            yield (s[k + 2] & 0x1F) << 8 | s[k + 3], program


def _named(s: bytes) -> Iterator[tuple[int, int]] | None:
    """(PID, stream type) of a map section; None where it is cut short."""
    if len(s) < 16:
        return None
    out, k, end = [], 12 + ((s[10] & 15) << 8 | s[11]), len(s) - 4
    while k + 5 <= end:
        out.append(((s[k + 1] & 0x1F) << 8 | s[k + 2], s[k]))
        k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    return iter(out) if k == end else None


def _tables(taken: list[tuple[int, bool, bytes, bool]], wanted: set[int], table: int, tables: _Tables) -> Iterator[tuple[int, bytes]]:
    """(PID, section) of the sections in force with this table id on the wanted PIDs."""
    for pid, start, body, gap in taken:
        if pid in wanted:
            for s in tables.feed(pid, start, body, gap):
                if s[0] == table and s[5] & 1:
                    yield pid, s


def demux(data: bytes | None) -> dict | None:
    if data is None:
        return None
    counters: dict[int, _Counter] = {}
    taken: list[tuple[int, bool, bytes, bool]] = []  # PID, unit start, payload, lost some before: packets of tables
    media: list[tuple[int, int, bool, bytes, bool, bool, bool]] = []
    n = broken = 0
    for n, p in enumerate(packets(data), 1):
        pid = (p[1] & 0x1F) << 8 | p[2]
        if pid == 0x1FFF:
            continue
        if (parts := _read(p)) is None:
            broken += 1
            continue
        flags, _, body = parts
        c = counters.setdefault(pid, _Counter())
        c.excused = c.excused or bool(flags & 0x80)
        new, gap = c.take(p[3] & 15, body) if body is not None else (True, False)
        if new:
            media.append((n - 1, pid, bool(p[1] & 0x40), body or b"", gap, bool(flags & 0x40), bool(p[3] & 0xC0)))
            if body is not None and not p[3] & 0xC0:
                taken.append((pid, bool(p[1] & 0x40), body, gap))
    tables = _Tables()
    maps: dict[int, list[int]] = {}
    for _, s in _tables(taken, {0}, 0, tables):
        for pid, program in _programs(s):
            if program not in maps.setdefault(pid, []):
                maps[pid].append(program)
    maps.pop(0, None)
    streams: dict[int, _Stream] = {}
    for pid, s in _tables(taken, set(maps), 2, tables):
        program, named = s[3] << 8 | s[4], _named(s)
        if named is None:
            tables.bad += 1
        elif program in maps[pid]:
            for own, kind in named:
                if own not in maps and own:
                    streams.setdefault(own, _Stream(program, kind))
    tables.bad += sum(map(bool, tables.held.values()))
    pes: list[dict] = []
    unnamed = scrambled = 0
    for at, pid, start, body, gap, entry, locked in media:
        x = streams.get(pid)
        if x is None:
            unnamed += pid != 0 and pid not in maps
            continue
        if gap:
            x.finish(pid, pes, gap=True)
        if locked:
            scrambled += 1
            continue
        if start and body:
            x.finish(pid, pes)
            x.parts, x.where, x.entry = [body], at, entry
        elif x.parts is not None:
            x.parts.append(body)
    found = []
    for pid, x in sorted(streams.items()):
        x.finish(pid, pes)
        c = counters.get(pid) or _Counter()
        found.append({"program": x.program, "pid": pid, "stream_type": x.kind, "pes_packets": x.pes, "damaged": x.damaged, "discontinuities": c.gaps, "duplicates": c.repeats, "payload": b"".join(x.payload)})
    pes.sort(key=lambda e: (e["packet"], e["pid"]))
    sums = (n, broken, tables.bad, unnamed, scrambled, sum(c.gaps for c in counters.values()), sum(c.repeats for c in counters.values()))
    return dict(zip(COUNTS, sums)) | {"streams": found, "pes": pes}


def _packet(pid: int, counter: int, body: bytes, start: bool, entry: bool = False) -> bytes:
    """A packet with as much of the body as is given; the adaptation field fills the rest."""
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255])
    room = 184 - len(body)
    if not room:
        return head + bytes([0x10 | counter]) + body
    field = b"\0" if room == 1 else bytes([room - 1, 0x40 if entry else 0]) + b"\xff" * (room - 2)
    return head + bytes([0x30 | counter]) + field + body


def _section(table: int, body: bytes) -> bytes:
    s = bytes([table, 0xB0 | (len(body) + 4) >> 8, (len(body) + 4) & 255]) + body
    return b"\0" + s + crc32(s).to_bytes(4, "big")


def mux(data: bytes, pes_bytes: int = 2000, pid: int = 0x101, lose: bool = False, repeat: bool = False) -> bytes:
    """One program with one private stream; every fourth PES packet is a random-access point."""
    pat, pmt = _section(0, b"\0\1\xc1\0\0" + b"\0\1\xe1\0"), _section(2, b"\0\1\xc1\0\0" + bytes([0xE0 | pid >> 8, pid & 255]) + b"\xf0\0" + b"\x06" + bytes([0xE0 | pid >> 8, pid & 255]) + b"\xf0\0")
    out = [_packet(0, 0, pat + b"\xff" * (184 - len(pat)), True), _packet(0x100, 0, pmt + b"\xff" * (184 - len(pmt)), True)]
    counter = 0
    for k in range(0, len(data), pes_bytes):
        part, t = data[k : k + pes_bytes], 90_000 + k // pes_bytes * 3003
        stamp = bytes([0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])
        rest = b"\0\0\1\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp + part
        entry, start = k // pes_bytes % 4 == 0, True
        while rest:
            room = 182 if start and entry else 184
            out.append(_packet(pid, counter, rest[:room], start, entry and start))
            rest, counter, start = rest[room:], counter + 1 & 15, False
    if repeat and len(out) > 3:
        out.insert(4, out[3])
    if lose and len(out) > 4:
        del out[4]
    return b"".join(out)


@F.arrow_udf(T.BinaryType())
def _muxed(ids: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for keys, pages in ids:
        yield pa.array([None if h is None else mux(h.encode(), lose=(k or 0) % 16 == 7, repeat=(k or 0) % 16 == 3) for k, h in zip(keys.to_pylist(), pages.to_pylist())], pa.binary())


@F.arrow_udf(RESULT)
def _demuxed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        yield pa.array([demux(d) for d in column.to_pylist()], _ARROW)


def streams_of(pages: DataFrame) -> DataFrame:
    """(page_id, media): a transport stream of each page's html."""
    return subset(pages, "page_id", "html").select("page_id", _muxed("page_id", "html").alias("media"))


def parsed(media: Column | str) -> Column:
    return _demuxed(media)


def read_streams(media: DataFrame) -> DataFrame:
    """page_id with what its transport stream holds."""
    return subset(media, "page_id", "media").select("page_id", parsed("media").alias("r")).select("page_id", "r.*")


def flat(read: DataFrame) -> DataFrame:
    """The same with a list for each field of the streams and PES packets, payloads in hexadecimal."""
    columns = [F.transform(f"{name}.{k}", F.hex).alias(f"{name}_{k}") if k == "payload" else F.col(f"{name}.{k}").alias(f"{name}_{k}") for name, fields in (("streams", _STREAM), ("pes", _PES)) for k in fields]
    return read.select("page_id", *COUNTS, *columns)


def streams_sql(table: str = "pages", pes_bytes: int = 2000) -> str:
    """What `flat(read_streams(streams_of(pages)))` finds, by arithmetic on the length of a page."""
    return f"""
with raw as (select page_id, hex(encode(html)) as x, octet_length(encode(html)) as n, coalesce(page_id, 0) % 16 as kind from {table}),
pieces as (select *, range(0, n, {pes_bytes}) as begins from raw),
packed as (select *, list_transform(begins, lambda b: 14 + least({pes_bytes}, n - b)) as sizes from pieces),
-- packets of each PES packet: 184 bytes each, the first of a random-access point 182
cut as (select *, list_transform(sizes, lambda s, i: case when (i - 1) % 4 = 0 then 1 + (greatest(s - 182, 0) + 183) // 184 else (s + 183) // 184 end) as counts from packed),
sums as (select *, 2 + coalesce(list_sum(counts), 0) as sent, len(begins) as units from cut),
fate as (select *, kind = 7 and sent > 4 as lost, kind = 3 and sent > 3 as doubled from sums),
kept as (select *, case when lost then 2 else 1 end as from_unit, lost and (counts[1] > 3 or units > 1) as seen from fate)
select page_id, CAST(case when n is not null then sent - CAST(lost AS INTEGER) + CAST(doubled AS INTEGER) end AS INTEGER) as packets, CAST(case when n is not null then 0 end AS INTEGER) as broken_packets, CAST(case when n is not null then 0 end AS INTEGER) as bad_sections,
  CAST(case when n is not null then 0 end AS INTEGER) as unnamed_packets, CAST(case when n is not null then 0 end AS INTEGER) as scrambled_packets,
  CAST(case when n is not null then seen end AS INTEGER) as discontinuities, CAST(case when n is not null then doubled end AS INTEGER) as duplicates,
  case when n is not null then [1] end as streams_program, case when n is not null then [257] end as streams_pid, case when n is not null then [6] end as streams_stream_type,
  case when n is not null then [CAST(units - CAST(lost AS INTEGER) AS INTEGER)] end as streams_pes_packets, case when n is not null then [CAST(lost AS INTEGER)] end as streams_damaged,
  case when n is not null then [CAST(seen AS INTEGER)] end as streams_discontinuities, case when n is not null then [CAST(doubled AS INTEGER)] end as streams_duplicates,
  case when n is not null then [case when lost then substr(x, {2 * pes_bytes} + 1) else x end] end as streams_payload,
  list_transform(begins[from_unit:], lambda b: 257) as pes_pid,
  list_transform(range(from_unit, units + 1), lambda i: CAST(2 + coalesce(list_sum(counts[1:i - 1]), 0) - CAST(lost AS INTEGER) + CAST(doubled and i > 1 AS INTEGER) AS INTEGER)) as pes_packet,
  list_transform(begins[from_unit:], lambda b: 90000 + b // {pes_bytes} * 3003) as pes_pts, list_transform(begins[from_unit:], lambda b: CAST(null AS BIGINT)) as pes_dts,
  list_transform(begins[from_unit:], lambda b: CAST(least({pes_bytes}, n - b) AS INTEGER)) as pes_size, list_transform(begins[from_unit:], lambda b: b // {pes_bytes} % 4 = 0) as pes_random_access
from kept"""
