"""WARC round trips, the normaliser, and the deduplication of payloads."""

import base64
import gzip
import hashlib
import json
import zlib

import pytest

from docmill.llm import warc

LONG = "<p>é</p>" * 400_000


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(pages, least=0):
    first = {}
    for page, _, html in pages:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in pages:
        again = page is not None and page > first.get(html or "", page)
        out.append((page, len((html or "").encode()), sha(html), "revisit" if again else "response",
                    first[html or ""] if again else None))
    return sorted(out, key=repr)


PAGES = [
    (5, "http://a.example/", "<html>same</html>"), (3, "http://b.example/", "<html>same</html>"), (9, None, "<html>same</html>"),
    (1, "http://c.example/\r\nInjected: yes", "line\r\n\r\nbreaks\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"),
    (2, "", None), (4, "http://d.example/ü?q=日本", ""), (None, "http://e.example/", "<html>same</html>"), (None, None, None),
    (7, "x", LONG), (8, "y", LONG), (10, "twice", "repeated row"), (10, "twice", "repeated row"), (11, "later", "repeated row"),
    (12, "nul", "\x00\x1f\x8b binary \x7f"),
]


def frame(spark, pages=PAGES):
    return spark.createDataFrame([(p, u, h, "x", 1) for p, u, h in pages],
                                 "page_id long, url string, html string, digest string, first int")


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 1, 100])
def test_round_trip_with_odd_rows(spark, least):
    assert got(warc.round_trip(spark, frame(spark).repartition(3), least)) == brute(PAGES, least)


def test_empty_table(spark):
    assert got(warc.round_trip(spark, frame(spark).limit(0))) == []


def test_normaliser_writes_members_and_offsets(spark, tmp_path):
    written = warc.write_archives(frame(spark).coalesce(1), f"{tmp_path}/streams", archive_bytes=1000)
    files = [r.archive for r in written.collect()]
    assert len(files) > 2 and sorted(files) == sorted(p.name for p in (tmp_path / "streams").iterdir())
    archives = warc.normalise(written, f"{tmp_path}/streams", f"{tmp_path}/records")
    seen = 0
    for name in [r.archive for r in archives.collect()]:
        raw = (tmp_path / "records" / name).read_bytes()
        stream = gzip.decompress((tmp_path / "streams" / name.split("-", 1)[1]).read_bytes())
        assert gzip.decompress(raw) == stream  # the same records, byte for byte
        at = 0
        for line in (tmp_path / "records" / f"{name}.index").read_text().splitlines():
            entry = json.loads(line)
            member = zlib.decompressobj(31)
            whole = member.decompress(raw[entry["offset"]:entry["offset"] + entry["length"]])
            assert entry["offset"] == at and member.eof and not member.unused_data
            assert whole.startswith(b"WARC/1.1\r\n") and warc.headers_of(whole)[0]["warc-type"] == entry["type"]
            at += entry["length"]
            seen += entry["type"] != "warcinfo"
        assert at == len(raw)
    assert seen == len(PAGES)


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_records_of_any_members_and_chunks(step):
    records = [warc.record([("WARC-Type", "resource"), ("N", i)], b"x\r\n\r\n" * i) for i in range(30)]
    for stream in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)),
                   gzip.compress(b"".join(records[:9])) + b"".join(map(gzip.compress, records[9:]))):
        chunks = (stream[i:i + step] for i in range(0, len(stream), step))
        assert [raw for _, raw in warc.records_in(chunks)] == records


def test_large_records_inflate_in_bounded_steps():
    record = warc.record([("WARC-Type", "resource")], bytes(100 << 20))
    assert [len(raw) for _, raw in warc.records_in(iter([gzip.compress(record, 1)]))] == [len(record)]


def test_damage_is_an_error():
    raw = warc.page_record(1, None, b"payload", None, "n")
    headers, start = warc.headers_of(raw)
    assert warc.page_of(headers, raw, start)[1] == 7
    with pytest.raises(ValueError):
        warc.page_of(headers, raw.replace(b"payload", b"pAyload"), start)
    with pytest.raises(ValueError):
        list(warc.records_in(iter([gzip.compress(raw[:-6])])))
