"""WARC archives compressed with Zstandard: writer and reader.

An archive starts with a skippable frame that holds the compression dictionary, followed
by one Zstandard frame for each record, so that records can be read one by one.

Writing: payload digests are computed where the pages are read; only (id, digest) rows
are grouped (with partial aggregation, so a page that makes up a third of all rows is one
row for each task) to find the first page of each payload.  Equal payloads are then
written once, as a response record; later pages are revisit records that name the first.
Each task writes archives of at most ``ARCHIVE_BYTES`` below the shared folder, under
names of its own attempt; the list of archives is a table that Spark commits, so what a
lost or repeated attempt leaves is never read.

Reading: the archive list is spread over the tasks.  Each archive is streamed: the
dictionary frame is loaded, every frame is found by its block headers, decompressed and
checked (version line, content lengths, digests).  A damaged archive raises ``ValueError``.

Defined cases: a null payload is an empty one; all pages that have the least id of their
payload (repeated rows) are responses; a null id is never the least unless all ids of
that payload are null, and refers to the least id otherwise; an empty table gives
no records; a page without a URL has no target URI.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import map_arrow, pick, shared_table
from pathweave.session import shared_path

SKIPPABLE_DICT = 0x184D2A5D    # magic number of the leading frame with the dictionary
FRAME = 0xFD2FB528
ARCHIVE_BYTES = 32 << 20       # compressed
DICT_BYTES = 64 << 10
DICT_SAMPLE = 400              # pages that the dictionary is made from
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"  # a fixed date, so that equal input gives equal archives
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROW = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "url string, record_id string, payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own but states its length and digest."""
    name = "null" if page_id is None else str(page_id)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{sha1}"))
    block = b"" if revisit else payload
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("X-Payload-Length", str(len(payload))), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
             ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Check one record and give its fields."""
    if not data.startswith(b"WARC/1.1\r\n"):
        raise ValueError("no WARC version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("unterminated WARC header")
    head: dict[str, str] = {}
    for line in data[10:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("WARC header line without a colon")
        head[name.decode().strip().lower()] = value.decode().strip()
    missing = {"warc-type", "warc-record-id", "content-length", "warc-payload-digest", "x-payload-length"} - head.keys()
    if missing:
        raise ValueError(f"WARC header lacks {sorted(missing)}")
    size = int(head["content-length"])
    block = data[end + 4:end + 4 + size]
    if len(block) != size or data[end + 4 + size:] != b"\r\n\r\n":
        raise ValueError("WARC content length does not fit the record")
    if head["warc-type"] not in ("response", "revisit"):
        raise ValueError(f"unexpected WARC type {head['warc-type']}")
    kind, length, sha1 = head["warc-type"], int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    if digest(block) != head.get("warc-block-digest", "").removeprefix("sha1:"):
        raise ValueError("WARC block digest does not fit the record")
    if kind == "response" and (len(block) != length or digest(block) != sha1):
        raise ValueError("WARC payload digest does not fit the record")

    def page(name: str) -> int | None:
        value = head[name].removeprefix("<urn:page:").removesuffix(">")
        return None if value == "null" else int(value)

    return {"page_id": page("warc-record-id"), "payload_bytes": length, "payload_digest": sha1, "record_type": kind,
            "refers_to": page("warc-refers-to") if kind == "revisit" else None, "url": head.get("warc-target-uri"),
            "record_id": head["warc-record-id"], "payload": block if kind == "response" else None}


class ArchiveWriter:
    """Frames of one archive on a binary stream."""

    def __init__(self, out, dictionary: bytes):
        self.out, self.records, self.size = out, 0, 0
        self.comp = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True,
                                             dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self._write(struct.pack("<II", SKIPPABLE_DICT, len(dictionary)) + dictionary)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._write(self.comp.compress(data))
        self.records += 1


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError("archive ends within a frame")
    return bytes(data)


def frames(stream) -> Iterator[bytes]:
    """The decompressed frames of an archive, one at a time; memory is that of one record."""
    magic, size = struct.unpack("<II", _exactly(stream, 8))
    if magic != SKIPPABLE_DICT:
        raise ValueError("archive has no leading dictionary frame")
    dictionary = _exactly(stream, size)
    if dictionary[:4] == struct.pack("<I", FRAME):                 # the dictionary itself may be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while start := stream.read(4):
        start = bytes(start)
        if len(start) != 4:
            raise ValueError("archive ends within a frame")
        number = struct.unpack("<I", start)[0]
        if 0x184D2A50 <= number <= 0x184D2A5F:                     # further skippable frames carry no record
            _exactly(stream, struct.unpack("<I", _exactly(stream, 4))[0])
            continue
        if number != FRAME:
            raise ValueError("no Zstandard frame where one is due")
        flags = _exactly(stream, 1)
        single, dict_flag, size_flag = flags[0] >> 5 & 1, flags[0] & 3, flags[0] >> 6
        head = flags + _exactly(stream, (not single) + (0, 1, 2, 4)[dict_flag] + ((1 if single else 0), 2, 4, 8)[size_flag])
        parts, last = [start, head], False
        while not last:
            block = _exactly(stream, 3)
            bits = int.from_bytes(block, "little")
            last, kind, length = bool(bits & 1), bits >> 1 & 3, bits >> 3
            if kind == 3:
                raise ValueError("reserved Zstandard block type")
            parts += [block, _exactly(stream, 1 if kind == 1 else length)]
        if flags[0] >> 2 & 1:
            parts.append(_exactly(stream, 4))
        whole = b"".join(parts)
        stated = zstandard.frame_content_size(whole)
        try:
            data = plain.decompress(whole) if stated >= 0 else plain.decompressobj().decompress(whole)
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged Zstandard frame: {e}") from e
        if stated >= 0 and len(data) != stated:
            raise ValueError("Zstandard frame has another length than it states")
        yield data


def open_path(path: str):
    """(file system, path in it) for a Hadoop-style path: file, hdfs, s3a, gs and so on."""
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _writer(folder: str, dictionary) -> Callable:
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        system, base = open_path(folder)
        archive, out, name, done = None, None, "", []

        def close():
            nonlocal archive
            if archive:
                out.close()
                done.append((name, archive.records, archive.size))
                archive = None

        for batch in batches:
            payloads = batch.column(2).cast(pa.binary()).to_pylist()
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for page_id, url, refers_to, revisit, payload in zip(*columns, payloads, strict=True):
                if archive and archive.size >= ARCHIVE_BYTES:
                    close()
                if not archive:
                    name = f"{folder}/part-{attempt}-{len(done):04d}.warc.zst"
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}")
                    archive = ArchiveWriter(out, dictionary.value)
                payload = payload or b""
                archive.add(record(page_id, url, payload, digest(payload), refers_to, revisit))
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])
    return write


def _read(batches):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def rows(found: list[dict]):
        names = list(found[0])
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

    for batch in batches:
        for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            system, at = open_path(path)
            n, held, found = 0, 0, []
            with system.open_input_stream(at, buffer_size=1 << 20) as stream:
                for data in frames(stream):
                    found.append(parse_record(data))
                    n, held = n + 1, held + len(data)
                    if held >= 4 << 20:
                        yield rows(found)
                        held, found = 0, []
            if n != records:
                raise ValueError(f"{path} has {n} records, {records} were written")
            if found:
                yield rows(found)


def make_dictionary(pages: DataFrame, sample: int = DICT_SAMPLE) -> bytes:
    """A dictionary from a bounded sample of payloads; empty if they are too few or too small.

    It only changes how well records compress, never what is read back.
    """
    some = pages.filter(F.length("payload") > 0).select(F.substring("payload", 1, 16384).alias("p")).limit(sample)
    payloads = [r[0].encode() for r in some.collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, payloads).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; the result lists the archives: path, records, bytes."""
    rows = pick(pages, page_id="bigint", url="string", html="string").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    dictionary = pages.sparkSession.sparkContext.broadcast(make_dictionary(rows))
    payload = F.col("payload").cast("binary")
    keyed = rows.select("page_id", F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("size"))
    slim = shared_table(keyed.select("page_id", F.unhex("sha").alias("sha"), "size"), "digests")
    firsts = shared_table(slim.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                          .filter("n > 1"), "firsts")
    # Only pages of payloads that occur more than once; every other page is its own first.
    later = (slim.join(firsts, ["sha", "size"]).filter(F.col("first").isNotNull())
             .filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))))
    later = shared_table(later.select(F.col("page_id").alias("_page"), "sha", "first").distinct(), "revisits")
    same = rows["page_id"].eqNullSafe(later["_page"]) & (F.unhex(F.sha2(payload, 256)) == later["sha"])
    marked = rows.join(later, same, "left").select(
        "page_id", "url", "payload", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit"))
    return shared_table(map_arrow(marked, _writer(folder, dictionary), "path string, records bigint, bytes bigint"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of listed archives, checked; ``payload`` is null for revisits."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = archives.select("path", "records").repartition(n, "path")
    return map_arrow(listed, _read, _ROW)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new folder below the shared one and read the archives back."""
    folder = shared_path(pages.sparkSession, f"warc/{uuid.uuid4().hex}")
    return read_archives(write_archives(pages, folder))
