"""WARC archives of individually compressed records that share a dictionary.

Every task writes one archive of the pages it reads; no page moves. An archive
starts with a skippable frame that holds a Zstandard dictionary, trained on
records of that archive; then comes one frame per record. Spark's text writer puts
the bytes into the shared folder, so any file system and its commit protocol
serve. The writer ends each row with a separator, and that is itself an empty
skippable frame, so the files are plain Zstandard streams.

Only digests move to find equal payloads; they are counted before they are joined.
"""

from __future__ import annotations

import hashlib
import struct
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, new_folder, sized_join, stored

LEAST_REVISIT = 1000
LEVEL = 3
DICTIONARY_BYTES = 32 << 10
# Records of an archive that its dictionary is trained on, evenly spaced; the bound only affects sizes.
TRAINING_BYTES = 2 << 20
# Payload bytes of one archive; a task with more starts another dictionary in the same file.
ARCHIVE_BYTES = 32 << 20
# The frame of a dictionary, and an empty skippable frame.
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
ID = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<{ID}{'' if page_id is None else page_id}>"


def page_of(identifier: str):
    number = identifier.strip()[len(ID) + 1 : -1]
    return int(number) if number else None


def warc_record(page_id, url: str, payload, digest: str, length: int, refers_to, date: str) -> bytes:
    """A response, or a revisit that has the headers of the payload but not its bytes."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        "WARC-Target-URI: " + "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode()).encode("latin-1").decode("utf-8"),
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return {"fields": fields, "payload": payload, "length": length}


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from evenly spaced records; None for too few."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    some = records[::step]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, some)) // 20)), some, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return None


def frames(records: list[bytes]) -> list[bytes]:
    """The frames of one archive: the dictionary's, then one per record."""
    if not records:
        return []
    dictionary = train(records)
    body = b"" if dictionary is None else dictionary.as_bytes()
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    return [struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body, *map(pack.compress, records)]


def read_frames(data: bytes):
    """The records of an archive's bytes, one after the other."""
    unpack, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if magic == DICTIONARY_MAGIC:
                body = data[at + 8 : at + 8 + size]
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else zstandard.ZstdDecompressor()
            at += 8 + size
            continue
        one = unpack.decompressobj()
        yield one.decompress(data[at:] if len(data) - at < 1 << 16 else data[at : at + frame_size(data, at)])
        at += frame_size(data, at)


def frame_size(data: bytes, at: int) -> int:
    """Bytes of the Zstandard frame at ``at``, from its block headers."""
    header = zstandard.frame_header_size(data[at : at + 18])
    checksum = 4 if data[at + 4] & 4 else 0
    here = at + header
    while True:
        block = int.from_bytes(data[here : here + 3], "little")
        kind, size = block >> 1 & 3, block >> 3
        here += 3 + (1 if kind == 1 else size)
        if block & 1:
            return here + checksum - at


def _archives(date: str):
    def run(batches):
        records, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "payload_bytes", "refers_to")]
            for page_id, url, digest, length, refers_to, payload in zip(*columns, byte_slices(batch.column("payload"))):
                records.append(warc_record(page_id, url, bytes(payload), digest, length, refers_to, date))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield _rows(records)
                    records, size = [], 0
        if records:
            yield _rows(records)

    return run


def _rows(records) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(frames(records), pa.binary())], names=["frame"])


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT, date: datetime | None = None) -> None:
    """Write a record per row of ``pages`` into archives under ``path``.

    The payload is the HTML in UTF-8, null counting as empty. Of equal payloads of
    at least ``least`` bytes that with the largest id is a response and the others
    revisit it; rows with that same id are responses too, and so are all rows of a
    payload whose ids are all null. A null URL is empty. A record, however long, is held
    by its task, and so are about ARCHIVE_BYTES of records. An empty table gives no
    archives; other columns, whatever their names, are ignored.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    digests = rows.select("page_id", F.sha2("payload", 256).alias("same"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    responses = digests.groupBy("same").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.select("*", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)).alias("same"))
    joined = sized_join(marked, stored(responses, "warc-responses"), ["same"], "left")
    out = joined.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))
    stamp = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    frames_ = out.mapInArrow(_archives(stamp), "frame binary")
    frames_.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def _read(batches):
    for batch in batches:
        out = []
        for data in byte_slices(batch.column("content")):
            for raw in read_frames(bytes(data)):
                record = parse_record(raw)
                fields, refers_to = record["fields"], record["fields"].get("WARC-Refers-To")
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if refers_to is None and (len(record["payload"]) != record["length"] or hashlib.sha1(record["payload"]).hexdigest() != digest):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                out.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], record["length"], digest, fields["WARC-Type"], refers_to and page_of(refers_to), None if refers_to else record["payload"]))
                if len(out) >= 2000:
                    yield _read_rows(out)
                    out = []
        if out:
            yield _read_rows(out)


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read_rows(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in READ.split(", ")])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record under ``path``, with its payload if it is a response. Payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_read, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read them back."""
    path = new_folder(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).drop("payload", "url")
