import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lignum.llm import mpegts


def test_crc():
    assert mpegts.crc32(b"123456789") == 0x0376E6E7


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=6000), st.integers(1, 3000))
def test_round_trip(data, pes_bytes):
    r = mpegts.demux(mpegts.mux(data, pes_bytes))
    (s,) = r["streams"]
    assert s["payload"] == data and s["damaged"] == s["discontinuities"] == s["duplicates"] == 0
    assert (s["program"], s["pid"], s["stream_type"]) == (1, 0x101, 6)
    assert [p["size"] for p in r["pes"]] == [len(data[k : k + pes_bytes]) for k in range(0, len(data), pes_bytes)]
    assert [p["pts"] for p in r["pes"]] == [90_000 + 3003 * k for k in range(len(r["pes"]))]
    assert [p["random_access"] for p in r["pes"]] == [k % 4 == 0 for k in range(len(r["pes"]))]


def test_loss_and_repeats_are_seen():
    data = bytes(range(256)) * 40
    lost, twice = mpegts.demux(mpegts.mux(data, lose=True)), mpegts.demux(mpegts.mux(data, repeat=True))
    assert lost["streams"][0]["discontinuities"] == 1 and lost["streams"][0]["damaged"] == 1
    assert twice["streams"][0]["duplicates"] == 1 and twice["streams"][0]["payload"] == data


def _stuffed(stream, size):
    return b"".join(stream[k : k + 188] + b"\xff" * (size - 188) for k in range(0, len(stream), 188))


@pytest.mark.parametrize("size", [188, 192, 204])
def test_packet_sizes_and_damage(size):
    stream = _stuffed(mpegts.mux(b"payload" * 500), size)
    assert mpegts.demux(stream)["streams"][0]["payload"] == b"payload" * 500
    assert mpegts.demux(b"noise" + stream)["streams"][0]["payload"] == b"payload" * 500


def test_tables():
    whole = mpegts.mux(b"x" * 400)
    broken = bytearray(whole)
    broken[20] ^= 1  # in the association table
    r = mpegts.demux(bytes(broken))
    assert r["bad_sections"] == 1 and r["streams"] == [] and r["unnamed_packets"] > 0
    scrambled = bytearray(whole)
    for k in range(376, len(whole), 188):
        scrambled[k + 3] |= 0x80
    r = mpegts.demux(bytes(scrambled))
    assert r["scrambled_packets"] == len(whole) // 188 - 2 and r["pes"] == []


def test_section_over_several_packets_and_dts():
    streams = b"".join(bytes([0x1B, 0xE0 | k >> 8, k & 255, 0xF0, 0]) for k in range(0x200, 0x230))
    pmt = mpegts._section(2, b"\0\1\xc1\0\0\xe1\1\xf0\0" + streams)
    out = [mpegts._packet(0, 0, mpegts._section(0, b"\0\1\xc1\0\0\0\1\xe1\0"), True)]
    out += [mpegts._packet(0x100, k, pmt[a : a + 184], k == 0) for k, a in enumerate(range(0, len(pmt), 184))]
    stamp = lambda mark, t: bytes([mark << 4 | t >> 29 & 14 | 1, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])
    pts, dts = (1 << 33) - 5, 123_456_789
    out.append(mpegts._packet(0x22F, 0, b"\0\0\1\xe0\0\0\x80\xc0\x0a" + stamp(3, pts) + stamp(1, dts) + b"picture", True, True))
    r = mpegts.demux(b"".join(out))
    assert [s["pid"] for s in r["streams"]] == list(range(0x200, 0x230))
    assert r["pes"] == [{"pid": 0x22F, "packet": len(out) - 1, "pts": pts, "dts": dts, "size": 7, "random_access": True}]


def test_nothing_in_it():
    assert mpegts.demux(None) is None
    for data in (b"", b"\x47", b"\x47" * 1000, b"no sync" * 100):
        r = mpegts.demux(data)
        assert r["streams"] == [] and r["pes"] == []


@settings(deadline=None)
@given(st.binary(max_size=800), st.integers(0, 1500))
def test_no_bytes_crash(data, at):
    stream = mpegts.mux(b"q" * 3000)
    mpegts.demux(stream[:at] + data + stream[at:])


def test_table(spark):
    rows = [(k, "<p>" + "x" * 50 * k) for k in range(40)] + [(3, "<p>" + "x" * 150), (None, "nobody"), (50, None), (51, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"media": F.lit("mine"), "r": F.lit("mine")})
    got = mpegts.read_streams(mpegts.streams_of(pages))
    assert got.columns == ["page_id", *mpegts.COUNTS, "streams", "pes"]
    out = got.collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    text = dict(rows)
    assert by[50].packets is None and by[51].streams[0].payload == b""
    for k, r in by.items():
        if k is not None and k < 40 and k % 16 != 7:
            assert bytes(r.streams[0].payload).decode() == text[k]
    assert by[23].streams[0].discontinuities == 1 and by[19].streams[0].duplicates == 1
    assert mpegts.read_streams(mpegts.streams_of(pages.filter("false"))).collect() == []


def test_short_sections_crash_nothing():
    """Sections too short for their table whose CRC is right."""
    for table in (0, 2):
        for size in range(0, 16):
            body = bytes([0, 1, 0xC1, 0, 0, 0xE1, 0, 0xF0, 0, *range(16)])[:size]
            for pid in (0, 0x100):
                whole = mpegts.mux(b"x" * 400)
                extra = mpegts._packet(pid, 1, mpegts._section(table, body) + b"\xff" * (183 - size - 7 - 1), True)
                r = mpegts.demux(whole[:376] + extra + whole[376:])
                assert r["streams"][0]["payload"] == b"x" * 400
                if (table, pid) == (2, 0x100):
                    assert r["bad_sections"] == (size != 9)  # 9 is a map without streams


def long_map(repeat=None, lose=None):
    streams = b"".join(bytes([0x1B, 0xE0 | k >> 8, k & 255, 0xF0, 0]) for k in range(0x200, 0x280))
    pmt = mpegts._section(2, b"\0\1\xc1\0\0\xe1\1\xf0\0" + streams)
    out = [mpegts._packet(0, 0, mpegts._section(0, b"\0\1\xc1\0\0\0\1\xe1\0"), True)]
    out += [mpegts._packet(0x100, k, pmt[a : a + 184], k == 0) for k, a in enumerate(range(0, len(pmt), 184))]
    if repeat is not None:
        out.insert(repeat, out[repeat])
    if lose is not None:
        del out[lose]
    return mpegts.demux(b"".join(out))


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_tables_have_continuity(k):
    r = long_map(repeat=k)
    assert len(r["streams"]) == 128 and (r["bad_sections"], r["duplicates"], r["discontinuities"]) == (0, 1, 0)
    r = long_map(lose=k)
    assert r["streams"] == [] and r["discontinuities"] == (k in (2, 3))


def test_stream_ids_without_a_header():
    pat, pmt = mpegts.mux(b"")[:188], mpegts.mux(b"")[188:376]
    for kind, body in ((0xBF, b"q" * 20), (0xF0, b"q" * 20), (0xBE, b"")):
        r = mpegts.demux(pat + pmt + mpegts._packet(0x101, 0, b"\0\0\1" + bytes([kind]) + b"\0\x14" + b"q" * 20, True))
        assert r["streams"][0]["payload"] == body and r["streams"][0]["damaged"] == 0 and r["pes"][0]["pts"] is None


def test_a_whole_packet_before_a_gap_stays():
    data = bytes(range(256)) * 20
    stream = mpegts.mux(data, pes_bytes=300)  # two packets for each PES packet
    at = 188 * 6  # the first packet of the third
    r = mpegts.demux(stream[:at] + stream[at + 188 :])
    (s,) = r["streams"]
    assert s["discontinuities"] == 1 and s["payload"] == data[:600] + data[900:] and s["damaged"] == 0


def test_packets_before_the_map_count():
    stream = mpegts.mux(b"early" * 100)
    assert mpegts.demux(stream[376:] + stream[:376])["streams"][0]["payload"] == b"early" * 100


def test_broken_packets():
    stream = bytearray(mpegts.mux(b"z" * 3000))
    stream[188 * 3 + 1] |= 0x80
    r = mpegts.demux(bytes(stream))
    assert r["broken_packets"] == 1 and r["streams"][0]["damaged"] == 1


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0x100, 0x101, 0x1FFF]), st.integers(0, 15), st.binary(max_size=184), st.booleans()), max_size=12))
def test_no_packets_crash(rows):
    stream = mpegts.mux(b"q" * 900)
    extra = b"".join(mpegts._packet(pid, c, body, start) for pid, c, body, start in rows)
    mpegts.demux(stream[:376] + extra + stream[376:])


def test_odd_pages_have_the_sql_result(spark, duck):
    rows = [(k, "\u00e9x" * n) for k, n in enumerate([0, 1, 50, 60, 61, 100, 119, 120, 121, 122, 183, 184, 400, 640, 667, 1000, 1334, 2000, 5000, 119, 120, 180, 300, 61, 122, 123, 4001])]
    rows += [(7, "a" * n) for n in (1, 168, 169, 300, 352, 353, 354, 536, 537, 538, 540, 1999, 2000, 2001, 4000)] + [(3, "b" * n) for n in (0, 1, 168, 169, 170, 2000, 2500)] + [(None, "n"), (5, None), (7, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = mpegts.flat(mpegts.read_streams(mpegts.streams_of(pages)))
    want = duck(mpegts.streams_sql(), pages, "pages")
    assert sorted(repr(r.asDict()) for r in got.collect()) == sorted(repr({c: w[c] for c in got.columns}) for w in want)
