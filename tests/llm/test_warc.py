import hashlib
import struct

import zstandard

from tidemark.llm import warc_zstd as w
from tidemark.llm.shared import open_fs


def brute(rows):
    payload = [(r[0], (r[2] or "").encode()) for r in rows]
    best = {}
    for p, b in payload:
        if p is not None:
            best[b] = max(p, best.get(b, p))
    out = []
    for p, b in payload:
        refers = best.get(b) if len(b) >= 1000 and best.get(b) != p else None
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, winner int, payload_bytes string")


def test_rules_and_round_trip(spark):
    big, small = "<p>é</p>\r\n\r\n" * 200, "<p>x</p>"
    rows = [(1, "http://a\r\nX: y", big), (2, None, big), (3, "http://c", small), (4, "http://d", small), (5, "u", None), (6, "u", ""), (None, "u", big), (None, "u", big + "z"), (None, "v", big + "z"), (7, "u", "z" * 300_000), (8, "u", "a" * 1000), (9, "u", "a" * 1000), (9, "u", "a" * 1000), (10, "u", "b" * 999), (11, "u", "b" * 999)]
    got = sorted((tuple(r) for r in w.read_archives(w.write_archives(pages(spark, rows))).collect()), key=repr)
    assert got == brute(rows)
    assert w.read_archives(w.write_archives(pages(spark, []))).collect() == []


def test_archive_layout(spark):
    rows = [(i, f"http://h/{i}", f"<html><body>{'common text ' * (20 + i % 7)}{i}</body></html>") for i in range(400)]
    manifest = w.write_archives(pages(spark, rows)).collect()
    assert sum(m.records for m in manifest) == 400
    for m in manifest:
        fs, path = open_fs(m.path)
        raw = fs.open_input_stream(path).read()
        magic, n = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D and n > 0
        # Without the dictionary the records cannot be read; with it each frame stands alone.
        reader = zstandard.ZstdDecompressor(dict_data=w.as_dictionary(raw[8 : 8 + n]))
        at, seen = 8 + n, 0
        while at < len(raw):
            one = reader.decompressobj()
            record = one.decompress(raw[at:])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            at, seen = len(raw) - len(one.unused_data), seen + 1
        assert seen == m.records
    plain = sum(len(zstandard.compress(w.record(p, u, h.encode(), len(h), hashlib.sha1(h.encode()).hexdigest(), None))) for p, u, h in rows)
    assert sum(m.bytes for m in manifest) < plain
