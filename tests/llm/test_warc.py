"""WARC archives: round trip, frames and damage."""

import io
import struct

import pytest
import zstandard

import brute
from pathweave.llm import queries, warc

SCHEMA = "page_id bigint, url string, html string"


def test_round_trip_of_the_pages(spark):
    rows = queries.op5_warc(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    want = sorted((i, len(p), brute.sha1_base32(p), "response" if first[p] == i else "revisit", None if first[p] == i else first[p])
                  for i, p in pages.items())
    assert sorted(map(tuple, rows)) == want


def test_copies_nulls_and_repeated_rows(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (7, "a\r\nb", ""), (8, "u", None), (8, "u", None), (None, "n", "same"),
            (None, "n", "alone"), (1, "ü", "é" * 70_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    folder = warc.shared_path(spark, "warc-test")
    archives = warc.write_archives(df, folder)
    got = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes, r.payload)
                 for r in warc.read_archives(archives).collect())
    big = ("é" * 70_000).encode()
    assert got == sorted([(5, "revisit", 3, 4, None), (3, "response", None, 4, b"same"), (9, "revisit", 3, 4, None),
                          (7, "response", None, 0, b""), (8, "revisit", 7, 0, None), (8, "revisit", 7, 0, None),
                          (-1, "revisit", 3, 4, None), (-1, "response", None, 5, b"alone"), (1, "response", None, len(big), big)],
                         key=lambda r: (r[0], r[1], r[2], r[3], r[4]) if r[4] is not None else (r[0], r[1], r[2], r[3]))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(records, dictionary=b""):
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, dictionary)
    for r in records:
        w.add(r)
    return out.getvalue()


def record(payload=b"hello", **changed):
    return warc.record(changed.get("page_id", 1), "u", payload, changed.get("sha1", warc.digest(payload)), None, False)


def test_dictionary_comes_first_and_each_record_is_a_frame():
    dictionary = zstandard.train_dictionary(2000, [b"some common words %d" % (i % 7) * 20 for i in range(300)]).as_bytes()
    data = archive([record(b"a" * i) for i in (0, 5, 300_000)], dictionary)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:8 + size] == dictionary
    assert [warc.parse_record(x)["payload"] for x in warc.frames(io.BytesIO(data))] == [b"", b"a" * 5, b"a" * 300_000]
    packed = zstandard.ZstdCompressor().compress(dictionary)          # a compressed dictionary is allowed as well
    other = struct.pack("<II", magic, len(packed)) + packed + data[8 + size:]
    assert len(list(warc.frames(io.BytesIO(other)))) == 3


@pytest.mark.parametrize("harm", [lambda d: d[8:], lambda d: d[:-3], lambda d: d[:8] + b"junk" + d[8:], lambda d: d + b"ab",
                                  lambda d: d[:-20] + bytes([d[-20] ^ 255]) + d[-19:]])
def test_damaged_archives_raise(harm):
    data = harm(archive([record(b"some text that is long enough to be damaged" * 3)]))
    with pytest.raises(ValueError):
        for x in warc.frames(io.BytesIO(data)):
            warc.parse_record(x)


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 5", b"Content-Length: 6"), (b"hello", b"hellO"),
                                    (b"WARC-Type: response", b"WARC-Type: other"), (b"WARC-Type: response\r\n", b""),
                                    (b"X-Payload-Length: 5", b"X-Payload-Length: 4"), (b"Content-Type: text", b"Content-Type text")])
def test_bad_records_raise(change):
    data = record()
    assert warc.parse_record(data)["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(*change))


def test_further_columns_whose_names_clash(spark):
    rows = [(i, f"<p>{i // 2}</p>" if i else None, "u", "H", i, "p", "d", i) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, url string, HTML string, row bigint, payload string, `digest` string, "
                                     "_c0 int")
    alone = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, html string, url string")
    plain = sorted(map(tuple, warc.round_trip(alone).collect()), key=str)
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    assert got == plain and len(got) == 6
