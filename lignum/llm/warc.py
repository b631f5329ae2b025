"""WARC archives: records, reassembly of segmented ones, and decoding of chunked transfer framing.

`read_records` parses archives (binary, plain or gzip members): a version line,
named fields, a block of Content-Length bytes. A record that was cut into
segments is one first record with the number 1 and continuations, often in other
archives, that name it (WARC-Segment-Origin-ID) with a number each; the last one
has the total length (WARC-Segment-Total-Length). `reassemble` groups them by the
origin's identifier, puts them in order of number, checks them (numbers 1..n
without gaps, one total length, bytes that add up), joins them, splits the HTTP
head off responses and decodes chunked framing.

Segments are shuffled once by origin and sorted, where they may spill; windows
over the sorted rows tell what is wrong before the first byte is joined, and a
task then streams through them, holding a segment and a part of the body.
Segments that repeat are dropped before the shuffle, as far as a task sees them,
and again after it, so a hot group of copies costs a row for each task.

`archives_of` writes the pages as such archives, as the tables hold none: an
archive for each segment, so a record's segments are apart; every 50th page of
more than a segment lacks its second one.

Defined cases: a missing, surplus or wrongly sized segment leaves `complete`
false and the body null, with the reason in `problem`; segments that repeat with
the same bytes count once, with different bytes they conflict; a record without
segment fields is whole as it is and its length is the total; a record without
an identifier can't be grouped and is left out, warcinfo records are too; null
payloads are empty; records other than responses have no HTTP head and keep
their block as body; without chunked framing the body is the rest of the
payload; a payload without an end of head within `HEAD_BYTES`, or with broken
framing, has no body; a body of more than `PART_BYTES` comes as several rows,
numbered by `part`, and if its framing breaks after the first of them the last
row has the problem; bytes that are no record are skipped up to the next version
line; a block that is cut off has the bytes that are there; a null archive has no
records; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import subset

SEGMENT_BYTES, CHUNK_BYTES = 2048, 1000
PART_BYTES, HEAD_BYTES = 64 << 20, 16 << 20
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_BATCH = 16 << 20  # bytes of payloads sent to the JVM at once
_SEEN = 100_000  # digests that a task remembers to drop repeats early

_RECORD = [("record_id", pa.string()), ("record_type", pa.string()), ("origin_id", pa.string()), ("segment_number", pa.int32()), ("total_length", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())]
RECORDS = "record_id string, record_type string, origin_id string, segment_number int, total_length bigint, target_uri string, payload binary"
_JOINED = [("record_id", pa.string()), ("target_uri", pa.string()), ("segments", pa.int32()), ("total_length", pa.int64()), ("complete", pa.bool_()), ("status", pa.int32()), ("part", pa.int32()), ("body", pa.binary()), ("problem", pa.string())]
JOINED = "record_id string, target_uri string, segments int, total_length bigint, complete boolean, status int, part int, body binary, problem string"

_VERSION = re.compile(rb"WARC/\d+\.\d+[ \t]*\r?\n")
_END = re.compile(rb"\r?\n\r?\n")


def _inflated(data: bytes) -> bytes:
    """All gzip members of an archive; what comes after a broken one is left out."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out += [d.decompress(data), d.flush()]
        except zlib.error:
            break
        data = d.unused_data
    return b"".join(out)


def fields(head: bytes) -> dict[str, str]:
    """Values by lower-case name; folded lines are one. Of a name that is there twice the last counts."""
    found: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).splitlines():
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def records(data: bytes | None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive."""
    if not data:
        return
    data = _inflated(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while m := _VERSION.search(data, at):
        gap = _END.search(data, m.end() - 2)
        if gap is None:
            return
        named = fields(data[m.end() : gap.start()])
        size = named.get("content-length", "")
        if not size.isascii() or not size.isdigit():
            at = m.end()
            continue
        at = gap.end() + int(size)
        yield named, data[gap.end() : at]


def _whole_number(text: str | None, most: int) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 20 and int(text) <= most else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for data in batch.column(0):
            for f, block in records(data.as_py()):
                kind = f.get("warc-type", "").lower()
                if kind == "warcinfo":
                    continue
                rows.append((f.get("warc-record-id"), kind, f.get("warc-segment-origin-id"), _whole_number(f.get("warc-segment-number"), 2**31 - 1), _whole_number(f.get("warc-segment-total-length"), 2**63 - 1), f.get("warc-target-uri"), block))
                size += len(block) + 200
                if size > _BATCH:
                    yield _batch(rows, _RECORD)
                    rows, size = [], 0
    if rows:
        yield _batch(rows, _RECORD)


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])


def read_records(archives: DataFrame) -> DataFrame:
    """The records of a table with a column `data`: fields that segments need, and payload."""
    return subset(archives, "data").mapInArrow(_parsed, RECORDS)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, data) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("data"))


class Dechunker:
    """Decodes chunked framing as bytes come; ValueError where it is broken. Trailers are dropped."""

    def __init__(self) -> None:
        self.held, self.left, self.state = b"", 0, "size"

    def feed(self, data: bytes) -> Iterator[bytes]:
        data, at = self.held + data, 0
        while self.state != "over":
            if self.state == "size":
                end = data.find(b"\r\n", at)
                if end < 0:
                    if len(data) - at > 1 << 16:
                        raise ValueError("bad chunk size")
                    break
                digits = data[at:end].split(b";")[0].strip()
                if not digits or digits.strip(b"0123456789abcdefABCDEF"):
                    raise ValueError("bad chunk size")
                self.left, at = int(digits, 16), end + 2
                self.state = "data" if self.left else "over"
            elif self.state == "data":
                part = data[at : at + self.left]
                if part:
                    yield part
                at, self.left = at + len(part), self.left - len(part)
                if self.left:
                    break
                self.state = "end"
            else:
                if len(data) - at < 2:
                    break
                if data[at : at + 2] != b"\r\n":
                    raise ValueError("cut-off chunk")
                at, self.state = at + 2, "size"
        self.held = data[at:] if self.state != "over" else b""

    def finish(self) -> None:
        if self.state != "over":
            raise ValueError("no chunk size" if self.state == "size" else "cut-off chunk")


class Response:
    """An HTTP response as its bytes come: status, then what the body is made of."""

    def __init__(self, http: bool) -> None:
        self.status: int | None = None
        self.head: bytes | None = b"" if http else None  # None once it is over
        self.chunks: Dechunker | None = None

    def feed(self, data: bytes) -> Iterator[bytes]:
        if self.head is not None:
            self.head += data
            head, gap, data = self.head.partition(b"\r\n\r\n")
            if not gap:
                if len(self.head) > HEAD_BYTES:
                    raise ValueError("no end of head")
                return
            self.head = None
            lines = head.split(b"\r\n")
            first = lines[0].split()
            self.status = int(first[1]) if len(first) > 1 and first[1].isdigit() and len(first[1]) < 10 else None
            coding = [v.strip().lower() for k, _, v in (x.partition(b":") for x in lines[1:]) if k.strip().lower() == b"transfer-encoding"]
            if coding and coding[-1].endswith(b"chunked"):
                self.chunks = Dechunker()
        if self.chunks is not None:
            yield from self.chunks.feed(data)
        elif data:
            yield data

    def finish(self) -> None:
        if self.head is not None:
            raise ValueError("no end of head")
        if self.chunks is not None:
            self.chunks.finish()


def unchunk(data: bytes) -> bytes:
    """Decode chunked framing at once."""
    d = Dechunker()
    out = b"".join(d.feed(data))
    d.finish()
    return out


def decode_http(data: bytes | None) -> dict | None:
    """Status and body of an HTTP response."""
    if data is None:
        return None
    r = Response(True)
    try:
        body = b"".join(r.feed(data))
        r.finish()
    except ValueError as e:
        return {"status": r.status, "body": None, "problem": str(e)}
    return {"status": r.status, "body": body, "problem": None}


def _condensed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows that the task has seen before; what it forgets is dropped after the shuffle."""
    seen: set[tuple] = set()
    for batch in batches:
        keys, numbers, totals, payloads = (batch.column(n) for n in ("key", "n", "total", "payload"))
        keep = []
        for key, n, total, p in zip(keys.to_pylist(), numbers.to_pylist(), totals.to_pylist(), payloads):
            mark = key, n, total, hashlib.md5(p.as_buffer() or b"").digest()
            keep.append(mark not in seen)
            if len(seen) < _SEEN:
                seen.add(mark)
        yield batch if all(keep) else batch.filter(pa.array(keep))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of key and number, the same facts on each row of a key."""
    rows: list[tuple] = []
    size = 0
    key: str | None = None
    facts: tuple = ()
    reader: Response | None = None
    problem: str | None = None
    body: list[bytes] = []
    held = part = 0

    def close() -> tuple:
        why = problem
        if reader is not None and why is None:
            try:
                reader.finish()
            except ValueError as e:
                why = str(e)
        uri, segments, total, gone = facts
        return key, uri, segments, total, gone is None, None if reader is None else reader.status, part, b"".join(body) if why is None else None, why

    for batch in batches:
        names = ("key", "uri", "segments", "total_length", "gone", "kind", "payload")
        for k, uri, segments, total, gone, kind, payload in zip(*(batch.column(n).to_pylist() for n in names)):
            if k != key or not facts:
                if facts:
                    rows.append(close())
                    size += held
                key, facts, problem, body, held, part = k, (uri, segments, total, gone), gone, [], 0, 0
                reader = Response(kind == "response") if gone is None else None
            if reader is None or problem is not None:
                continue
            try:
                for piece in reader.feed(payload or b""):
                    for at in range(0, len(piece), PART_BYTES):
                        bit = piece[at : at + PART_BYTES]
                        if held + len(bit) > PART_BYTES:
                            rows.append((key, uri, segments, total, True, reader.status, part, b"".join(body), None))
                            size, body, held, part = size + held, [], 0, part + 1
                        body.append(bit)
                        held += len(bit)
            except ValueError as e:
                problem = str(e)
            if size > _BATCH:
                yield _batch(rows, _JOINED)
                rows, size = [], 0
    if facts:
        rows.append(close())
    if rows:
        yield _batch(rows, _JOINED)


def reassemble(found: DataFrame) -> DataFrame:
    """(record_id, target_uri, segments, total_length, complete, status, part, body, problem) of the records of `read_records`."""
    rows = subset(found, *(n for n, _ in _RECORD))
    alone = F.col("segment_number").isNull() & F.col("origin_id").isNull() & (F.coalesce("record_type", F.lit("")) != "continuation")
    keyed = rows.select(
        F.coalesce("origin_id", "record_id").alias("key"),
        F.col("target_uri").alias("uri"),
        F.col("record_type").alias("kind"),
        F.when(alone, 1).otherwise(F.col("segment_number")).alias("n"),
        F.when(alone, F.octet_length(F.coalesce("payload", F.lit(b"")))).otherwise(F.col("total_length")).cast("bigint").alias("total"),
        F.coalesce("payload", F.lit(b"")).alias("payload"),
    ).filter("key is not null")
    few = keyed.mapInArrow(_condensed, keyed.schema).withColumns({"digest": F.md5("payload"), "size": F.octet_length("payload").cast("bigint")}).repartition("key")
    along = Window.partitionBy("key").orderBy("n", "digest", "total")
    every = Window.partitionBy("key")
    before = few.withColumn("before", F.lag(F.struct("n", "digest", "total")).over(along))
    same = F.col("before").eqNullSafe(F.struct("n", "digest", "total"))
    marked = before.select("*", same.alias("same"), (F.col("before.n").eqNullSafe(F.col("n")) & F.col("before").isNotNull()).alias("again")).select(
        "key", "uri", "kind", "n", "total", "payload", "digest", "size", "same", (F.col("again") & ~F.col("same")).alias("conflict"), (~F.col("again") & ~F.coalesce(F.col("n") == F.coalesce("before.n", F.lit(0)) + 1, F.lit(False))).alias("gap")
    )
    facts = {
        "segments": F.sum(F.when(~F.col("same"), 1).otherwise(0)).over(every).cast("int"),
        "total_length": F.max("total").over(every),
        "least": F.min("total").over(every),
        "sum": F.sum(F.when(~F.col("same"), F.col("size")).otherwise(0)).over(every),
        "conflicts": F.max("conflict").over(every),
        "gaps": F.max("gap").over(every),
        "ended": F.max_by(F.col("total").isNotNull(), F.coalesce("n", F.lit(0))).over(every),
        "uri": F.min_by("uri", F.coalesce("n", F.lit(0))).over(every),
        "kind": F.min_by("kind", F.coalesce("n", F.lit(0))).over(every),
    }
    known = marked.withColumns(facts)
    gone = F.when(F.col("conflicts"), "conflicting segments").when(F.col("gaps"), "missing segment").when(~F.col("ended") | (F.col("least") != F.col("total_length")), "no single total length").when(F.col("sum") != F.col("total_length"), "length differs")
    ready = known.filter("not same").withColumn("gone", gone).withColumn("payload", F.when(F.col("gone").isNull(), F.col("payload"))).sortWithinPartitions("key", "n", "digest", "total")
    return ready.select("key", "uri", "segments", "total_length", "gone", "kind", "payload").mapInArrow(_joined, JOINED)


def chunked(data: bytes, size: int) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(data[k : k + size]), data[k : k + size]) for k in range(0, len(data), size)) + b"0\r\n\r\n"


def write_record(named: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in named.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def archives(page_id: int, url: str | None, page: str | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The archives that hold a page's response, one for each segment."""
    payload = _HEAD + chunked((page or "").encode("utf-8", "replace"), chunk_bytes)
    origin = f"<urn:page:{page_id}>"
    begins = range(0, len(payload), segment_bytes)
    out = []
    for number, at in enumerate(begins, 1):
        first = number == 1
        named: dict[str, object] = {"WARC-Type": "response" if first else "continuation", "WARC-Record-ID": origin if first else f"<urn:page:{page_id}:{number}>"}
        if first and url is not None:
            named["WARC-Target-URI"] = url
        if len(begins) > 1:
            named["WARC-Segment-Number"] = number
        if not first:
            named["WARC-Segment-Origin-ID"] = origin
            if number == len(begins):
                named["WARC-Segment-Total-Length"] = len(payload)
        info = write_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:archive:{page_id}:{number}>"}, b"software: lignum\r\n")
        if page_id % 50 != 17 or number != 2:
            out.append(info + write_record(named, payload[at : at + segment_bytes]))
    return out


def archives_of(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(data): the archives of all pages that have an id."""

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def archived(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, urls, htmls in batches:
            yield pa.array([archives(i, u, h, segment_bytes, chunk_bytes) for i, u, h in zip(ids.to_pylist(), urls.to_pylist(), htmls.to_pylist())], pa.list_(pa.binary()))

    return subset(pages, "page_id", "url", "html").filter("page_id is not null").select(F.explode(archived("page_id", "url", "html")).alias("data"))


def text_bodies(joined: DataFrame) -> DataFrame:
    """Bodies as text, for archives whose responses are all UTF-8."""
    return joined.withColumn("body", F.col("body").cast("string"))


def reassemble_sql(table: str = "pages", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> str:
    """What `text_bodies(reassemble(read_records(archives_of(pages))))` finds, by arithmetic on the length of a page; page_id is unique."""
    digits = lambda n: f"length(printf('%x', {n}))"
    return f"""
with raw as (select page_id, url, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from {table} where page_id is not null),
sent as (select *, {len(_HEAD) + 5} + n // {chunk_bytes} * ({digits(chunk_bytes)} + 4 + {chunk_bytes}) + case when n % {chunk_bytes} > 0 then {digits(f"n % {chunk_bytes}")} + 4 + n % {chunk_bytes} else 0 end as size from raw),
cut as (select *, (size - 1) // {segment_bytes} + 1 as parts from sent),
fate as (select *, page_id % 50 = 17 and parts > 1 as lost from cut)
select '<urn:page:' || page_id || '>' as record_id, url as target_uri, CAST(parts - CAST(lost AS INTEGER) AS INTEGER) as segments, CAST(case when not lost or parts > 2 then size end AS BIGINT) as total_length, not lost as complete,
  CAST(case when not lost then 200 end AS INTEGER) as status, CAST(0 AS INTEGER) as part, case when not lost then html end as body, case when lost then case when parts > 2 then 'missing segment' else 'no single total length' end end as problem
from fate"""
