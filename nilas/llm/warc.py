"""WARC archives compressed record by record with an embedded Zstandard dictionary.

An archive starts with a skippable frame that holds the dictionary; every record is a frame of its own. Archives
end at a fixed size, so that each is built, written and read within a task's memory. Spark's text writer puts them into place: a "line" is an
archive, each in a file, and the line separator is an empty skippable frame, which readers pass over. So a task that is lost or
runs twice leaves no half-written archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm.common import drop, key_filter, new_path, passing, saved

EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Bytes of records on which a dictionary is built, its size, and the level of compression.
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 2 << 20, 64 << 10, 6
#: Bytes at which an archive ends.
ARCHIVE_BYTES = 16 << 20
#: Payloads whose copies have more bytes than this and than one in so many of all copies' bytes aren't shuffled.
HOT_BYTES, HOT_SHARES = 1 << 20, 1 << 16


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit repeats the HTTP head, with the payload's length, but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _dictionary(sample: list[bytes]) -> bytes:
    size = min(DICTIONARY_BYTES, sum(map(len, sample)) // 8)
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few records to train on: their bytes serve as they are
        return b"".join(sample)[:DICTIONARY_BYTES]


def _archives(records, most: int):
    """Archives of about `most` bytes: the leading frame with the dictionary, then a frame for each record."""
    sample, held, out, size, packer = [], 0, [], 0, None

    def start():
        nonlocal packer
        data = _dictionary(sample)
        packer = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True, write_checksum=True)
        return [struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data, *map(packer.compress, sample)]

    for r in records:
        if packer:
            out.append(packer.compress(r))
            size += len(out[-1])
        else:
            sample.append(r)
            held += len(r)
            if held >= min(SAMPLE_BYTES, most):
                out = start()
                size = sum(map(len, out))
        if packer and size >= most:
            yield b"".join(out)
            sample, held, out, size, packer = [], 0, [], 0, None
    if sample and not packer:
        out = start()
    if out:
        yield b"".join(out)


def _pack(most: int, repeated=None):
    """Archives of rows (page_id, url, html, first); with a filter of the keys that may repeat, of the rows (.., key, hot) that are hot or don't pass it."""

    def chosen(batches):
        for batch in batches:
            if repeated is None:
                yield batch
                continue
            hot = batch.column(batch.schema.get_field_index("hot")).fill_null(False)
            yield batch.filter(hot)
            yield passing(batch.filter(pc.invert(hot)), "key", repeated.value, False)

    def run(batches):
        def records():
            for batch in chosen(batches):
                column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
                for page_id, url, html, first in zip(column("page_id"), column("url"), column("html"), column("first"), strict=True):
                    payload = (html or "").encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    yield record(page_id, url, payload, digest, None if first is None or first == page_id else first)

        for archive in _archives(records(), most):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    return run


def _passing(repeated):
    def run(batches):
        for batch in batches:
            yield passing(batch, "key", repeated.value)

    return run


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, hot_bytes: int = HOT_BYTES) -> None:
    """Writes a WARC record for each row of pages (page_id, url, html) below path, in archives that end at about archive_bytes.

    Of rows with equal payloads (null is empty) the one with the smallest page_id is the response, the others revisit it;
    repeated rows with that page_id are responses too, and their records share an ID. Rows without page_id revisit, or are responses
    where no equal payload has a page_id. An empty table writes no records. Further columns aren't archived. Only pages whose payload may
    occur again are shuffled, and of these only payloads whose copies come to at most hot_bytes or one in HOT_SHARES of all copies' bytes:
    of the others, fewer than HOT_SHARES, the response is broadcast, so no task takes in all copies of a page.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    pages = pages.select("page_id", "url", "html").withColumn("digest", digest).withColumn("key", F.xxhash64("digest"))
    size = F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 1)
    first = saved(pages.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), size.alias("bytes")).where("n > 1").drop("n"), "first")
    total = first.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    repeated = key_filter(first.select(F.xxhash64("digest").alias("key")))
    hot = F.broadcast(first.where(F.col("bytes") > max(hot_bytes, total / HOT_SHARES)).select("digest", "first", F.lit(True).alias("hot")))
    alone = pages.join(hot, "digest", "left").drop("digest").mapInArrow(_pack(archive_bytes, repeated), "archive binary")
    rows = pages.join(hot, "digest", "left_anti").select(*pages.columns).mapInArrow(_passing(repeated), pages.schema)
    rows = rows.join(first.select("digest", "first"), "digest", "left").select("page_id", "url", "html", "first")
    archives = alone.unionByName(rows.mapInArrow(_pack(archive_bytes), "archive binary")).select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", 1).text(path)
    drop(first)


def _frame_end(buf: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends (RFC 8878, 3.1.1)."""
    flags = buf[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    last = 0
    while not last:
        head = int.from_bytes(buf[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * (flags >> 2 & 1)


def records_of(buf: bytes):
    """The records of one archive, decompressed one by one."""
    at, unpack = 0, zstandard.ZstdDecompressor()
    while at < len(buf):
        magic, size = struct.unpack_from("<II", buf, at)
        if magic == ZSTD_MAGIC:
            end = _frame_end(buf, at)
            yield unpack.decompress(buf[at:end])
            at = end
        elif magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(buf[at + 8 : at + 8 + size]))
            at += 8 + size
        else:
            raise ValueError(f"no frame at byte {at}")


def parse(raw: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest and lengths."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest,
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _unpack(with_payload: bool):
    schema = SCHEMA if with_payload else pa.schema(list(SCHEMA)[:-1])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw in records_of(content.as_py()):
                    row = parse(raw)
                    if not with_payload:
                        del row["payload"]
                    rows.append(row)
                    size += len(raw) if with_payload else 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of every record below path; payload is null for revisits."""
    kinds = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_unpack(with_payload), kinds)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
