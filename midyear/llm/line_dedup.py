"""Line dedup with two Bloom filters.

Tasks note the hash of each line key in a once-seen filter, and in a twice-seen
filter when the first has it already. Filters travel in blocks and are merged in
turn: what is in both the sum so far and the next filter has been seen twice. The
twice-seen filter misses no key that two documents share. It is sent to all tasks,
so its size is bounded by a parameter; where the lines need more, their hashes are
split into ranges, each with filters of its own and a pass over the texts. Only keys
that are suspected are shuffled, to be counted exactly. A fuller filter suspects more
keys; it never changes the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, byte_slices, keyed, new_folder, sized_join, stored

MIN_DOCUMENTS = 10
MIN_KEY = 1
BITS_PER_LINE = 16
# Of a filter that is broadcast: 64 MB. Beyond it there are more ranges of hashes, not fuller filters.
MOST_BITS = 1 << 29
BLOCK_BITS = 1 << 20
HASHES = 4
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def line_keys(text) -> list[bytes]:
    """Each line without blanks at its ends and with ASCII letters in lower case."""
    return [line.strip() for line in bytes(text).translate(LOWER).split(b"\n")]


def code_points(key: bytes) -> int:
    return len(key) - sum(key.count(bytes([c])) for c in range(0x80, 0xC0)) if not key.isascii() else len(key)


def distinct_keys(text, least: int) -> dict[bytes, int]:
    """The keys of a document that are long enough, with the number of the first line."""
    found: dict[bytes, int] = {}
    for i, key in enumerate(line_keys(text)):
        if key and (least <= 1 or code_points(key) >= least):
            found.setdefault(key, i)
    return found


def hashes_of(keys) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(k) for k in keys), np.uint64)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES places for each hash, all in the block that the hash names."""
    base = ((hashes >> np.uint64(40)) % np.uint64(bits // BLOCK_BITS)) * np.uint64(BLOCK_BITS)
    step = (hashes >> np.uint64(20)) | np.uint64(1)
    i = np.arange(HASHES, dtype=np.uint64)[:, None]
    return base + (hashes + i * step) % np.uint64(BLOCK_BITS)


class Bloom:
    def __init__(self, bits: int, data: np.ndarray | None = None) -> None:
        self.bits, self.data = bits, np.zeros(bits // 8, np.uint8) if data is None else data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = places(hashes, self.bits)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        if len(hashes):
            at = np.unique(places(hashes, self.bits))
            cell = at >> np.uint64(3)
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            self.data[cell[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (at & np.uint64(7)).astype(np.uint8), first)


@dataclass(frozen=True)
class Range:
    """One of ``ranges`` equal ranges that the hashes are split into."""

    number: int = 0
    ranges: int = 1

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if self.ranges == 1:
            return np.ones(len(hashes), bool)
        # Other bits than those that name a place in a filter.
        mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return (mixed * np.uint64(self.ranges)) >> np.uint64(32) == self.number


def _sketch(bits: int, least: int, range_: Range):
    def run(batches):
        once, twice = Bloom(bits), Bloom(bits)
        for batch in batches:
            found = [hashes_of(distinct_keys(t, least)) for t in byte_slices(batch.column("text"))]
            if not found:
                continue
            hashes = np.concatenate(found)
            values, counts = np.unique(hashes[range_.holds(hashes)], return_counts=True)
            twice.add(values[(counts > 1) | once.has(values)])
            once.add(values)
        pack = zstandard.ZstdCompressor(level=1).compress
        for block in range(bits // BLOCK_BITS):
            cut = slice(block * BLOCK_BITS // 8, (block + 1) * BLOCK_BITS // 8)
            if once.data[cut].any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(once.data[cut].tobytes())]), pa.array([pack(twice.data[cut].tobytes())])], names=["block", "once", "twice"])

    return run


def _merge(filters: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of all filters, read in turn; only the sums are held."""
    unpack, block = zstandard.ZstdDecompressor().decompress, None
    once, twice = np.zeros(BLOCK_BITS // 8, np.uint8), np.zeros(BLOCK_BITS // 8, np.uint8)
    for batch in filters:
        for a, b in zip(batch.column("once"), batch.column("twice")):
            seen = np.frombuffer(unpack(a.as_py()), np.uint8)
            twice |= np.frombuffer(unpack(b.as_py()), np.uint8) | (once & seen)
            once |= seen
        block = batch.column("block")[:1]
    yield pa.RecordBatch.from_arrays([block, pa.array([zstandard.ZstdCompressor(level=1).compress(twice.tobytes())])], names=["block", "twice"])


def twice_seen(rows: DataFrame, bits: int, least: int, range_: Range = Range()) -> Bloom:
    """The merged filter of a range of hashes; its size is ``bits``, whatever the rows."""
    merged = rows.select("text").mapInArrow(_sketch(bits, least, range_), "block int, once binary, twice binary").groupBy("block").applyInArrow(_merge, "block int, twice binary")
    filter_ = Bloom(bits)
    for block, data in merged.toLocalIterator():
        filter_.data[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return filter_


def _suspects(sent, bits: int, least: int, range_: Range):
    def run(batches):
        filter_ = Bloom(bits, np.frombuffer(sent.value, np.uint8))
        for batch in batches:
            ids, hashes, keys, lines = [], [], [], []
            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), byte_slices(batch.column("text"))):
                own = distinct_keys(text, least)
                known = hashes_of(own)
                for (key, line), hit in zip(own.items(), (filter_.has(known) & range_.holds(known)).tolist()):
                    if hit:
                        ids.append(doc_id)
                        hashes.append(text_hash)
                        keys.append(key)
                        lines.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lines, pa.int32())], names=["doc_id", "text_hash", "line_key", "line"])

    return run


def _kept(batches):
    for batch in batches:
        out = []
        for dropped, firsts, text in zip(batch.column("dropped").to_pylist(), batch.column("firsts").to_pylist(), byte_slices(batch.column("text"))):
            lines = bytes(text).split(b"\n")
            kept = lines
            if dropped:
                gone, stays = set(dropped), set(firsts or ())
                kept = [line for i, (line, key) in enumerate(zip(lines, line_keys(text))) if key not in gone or i in stays]
            out.append((len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
        a, b, c = zip(*out) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS, min_key: int = MIN_KEY, keep_first: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256.

    Lines whose key has at least ``min_key`` code points and stands in at least
    ``min_documents`` documents (2 or more) go from every document; with
    ``keep_first`` the first stays, by id, then text hash, then line. Every row is a
    document, so repeated rows count as often as they stand. Null and empty texts
    are one empty line. A text that loses all lines is empty. A text's lines are held
    at once by the task that reads it. Ids may be null; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    rows = keyed(docs, key, text).withColumn("text", F.col("text").cast("binary"))
    counted = keyed(docs, key, text).agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    wanted = max(BLOCK_BITS, 1 << (BITS_PER_LINE * counted - 1).bit_length() if counted else 0)
    bits, ranges = min(MOST_BITS, wanted), -(-wanted // MOST_BITS)
    schema, path = "doc_id long, text_hash long, line_key binary, line int", new_folder(spark, "lines-suspected")
    for range_ in (Range(i, ranges) for i in range(ranges)):
        sent = spark.sparkContext.broadcast(twice_seen(rows, bits, min_key, range_).data.tobytes())
        rows.mapInArrow(_suspects(sent, bits, min_key, range_), schema).write.option("compression", "zstd").mode("append").parquet(path)
        sent.destroy()
    suspects = spark.read.schema(schema).parquet(path)
    counts = suspects.groupBy("line_key")
    if keep_first:
        frequent = counts.agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "line")).alias("first"))
    else:
        frequent = counts.agg(F.count("*").alias("n"))
    frequent = stored(frequent.where(F.col("n") >= min_documents).drop("n"), "lines-frequent")
    hit = sized_join(suspects, frequent, ["line_key"], "inner")
    first = F.lit(None).cast("int")
    if keep_first:
        first = F.when(F.struct(*ROW_KEY, "line").eqNullSafe(F.col("first")), F.col("line"))
    dropped = hit.groupBy(*ROW_KEY).agg(F.collect_set("line_key").alias("dropped"), F.collect_set(first).alias("firsts"))
    found = sized_join(rows, stored(dropped, "lines-dropped"), ROW_KEY, "left")
    return found.mapInArrow(_kept, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
