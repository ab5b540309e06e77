"""Archives written and read: an exact round trip, and what any reader makes of a file."""

import glob
import hashlib
import io
import struct

import zstandard

from brindle.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1, "z") for i, u, h in rows], SCHEMA).repartition(3)


BIG, OTHER = "<p>" + "é" * 600 + "</p>", "x" * 1000
ROWS = [(1, "http://a/ b\r\nX: y", BIG), (2, None, BIG), (3, "http://c/ü", BIG), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", OTHER), (7, "u", OTHER), (8, "u", None), (9, "u", ""), (10, "u", "WARC/1.1\r\n\r\n\x00\x18MP*M" * 5), (11, "u", "long " * 400_000), (None, "u", BIG), (7, "u", OTHER)]


def brute(rows):
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        revisit = len(raw) >= 1000 and len(same) > 1 and i is not None and i != max(same)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    found = warc.round_trip(frame(spark, ROWS)).collect()
    assert sorted(((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in found), key=str) == brute(ROWS)
    texts = {i: (h or "").encode() for i, _, h in ROWS}
    assert all(bytes(x["payload"]) == texts[x["page_id"]] for x in found if x["record_type"] == "response" and x["page_id"] is not None)


def test_files_are_plain_zstandard(spark, tmp_path):
    pages = warc.classified(frame(spark, ROWS))
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=1500)
    names = glob.glob(f"{tmp_path}/w/part-*")
    assert len(names) > 3
    records = 0
    for name in names:
        raw = open(name, "rb").read()
        magic, size = struct.unpack_from("<II", raw)
        assert magic == 0x184D2A5D
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
        # a reader that knows the dictionary passes over all skippable frames by itself
        text = zstandard.ZstdDecompressor(dict_data=known).stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        records += len(list(warc.parsed(raw)))
    assert records == len(ROWS)
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == len(ROWS)


def test_empty(spark):
    assert warc.round_trip(frame(spark, [])).collect() == []
