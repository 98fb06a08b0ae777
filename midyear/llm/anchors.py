"""Finding symbol sequences that repeat anywhere in a table, in linear work.

A document is a sequence of symbols (bytes, or digests of words). Each window of
``length`` symbols picks the position of the least hash among its ``gram``-symbol
grams: its anchor. Equal windows pick equal anchors at equal places, so windows
need comparing only where anchors are equal. Around an anchor lies its segment,
the symbols that windows with this anchor can reach.

The rolling hashes of grams only bring together what may be equal; collisions cost
work, not results. Where a digest stands for symbols that are not compared
themselves it is one of BLAKE2b: 128 bits for whole segments and windows of hot
anchors, 64 bits for a word.

1. All anchors are listed with a hash of the anchor and a digest of its segment.
   Where a text goes on with a short period, each period has an anchor of the same
   kind: of such a run only the two ends are listed, the first with its whole extent.
2. Anchors that occur once are dropped after one pre-aggregated count.
3. Segments that occur twice are repeated as a whole; they need no symbols.
4. One segment of each kind that shares its anchor with another kind is cut from
   the texts, and the operator's own method finds the windows they share. Anchors
   are dealt to blocks of bounded size. An anchor with more kinds of segments than
   a block takes is dealt by its windows' digests instead.
5. Repeated stretches are gathered per document.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, byte_slices, keyed, parts, sized_join, stored, worker_memory

BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20
MOST_WORDS = 1 << 18
MOST_HOT_KINDS = 1000
BLANK_BYTE = re.compile(rb"[\x20\x09-\x0D]")
BLOCK_SEGMENTS = 8192
HOT_SEGMENTS = 50_000
# The tables of anchors grow with the texts: all but small ones are joined by shuffle.
SMALL = 1 << 20
U = np.uint64


@dataclass(frozen=True)
class Repeats:
    """What counts as repeated: ``length`` symbols, found by grams of ``gram`` symbols."""

    length: int
    gram: int
    words: bool
    block_segments: int = BLOCK_SEGMENTS
    hot_segments: int = HOT_SEGMENTS

    @property
    def reach(self) -> int:
        """Windows that can share one anchor, less one: the symbols before an anchor in its segment."""
        return self.length - self.gram


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each."""
    kept = worker_memory()
    if len(getattr(kept, "powers", ((),))[0]) < n:
        n = max(n, CHUNK + 4096)
        inverse = pow(BASE, -1, 1 << 64)
        up, down = np.full(n, U(BASE)), np.full(n, U(inverse))
        up[0] = down[0] = 1
        kept.powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return kept.powers


def sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() reads the hash of any stretch."""
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start, end) -> np.ndarray:
    """Hash of the symbols from start to end, wherever they stand."""
    _, down = powers(len(prefix))
    h = (prefix[end] - prefix[start]) * down[start]
    h ^= h >> U(31)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the first least value of some window of ``width`` values."""
    n = len(values)
    low = U((1 << 21) - 1)
    packed = (values & ~low) | np.arange(n, dtype=U)
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    padded[:n] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & low
    return least[np.r_[True, least[1:] != least[:-1]]].astype(np.int64)


def digests(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, tags: np.ndarray | None = None) -> bytes:
    """The 16-byte digests of stretches of symbols, one after another; a tag is part of what is digested."""
    data, width = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.dtype.itemsize
    out = []
    salts = itertools.repeat(b"") if tags is None else (t.to_bytes(8, "little") for t in tags.tolist())
    for a, b, salt in zip((starts * width).tolist(), (ends * width).tolist(), salts):
        out.append(hashlib.blake2b(data[a:b], digest_size=16, salt=salt).digest())
    return b"".join(out)


def binary16(data: bytes) -> pa.Array:
    n = len(data) // 16
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(data)])


def anchors_of(symbols: np.ndarray, raw: np.ndarray, rule: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(positions, ends of what they reach, anchor hashes, segment digests) of one document; long ones go chunk by chunk.

    raw: what the digests are taken of, a number per symbol. Of a run of neighbours
    with equal anchors and segments, which therefore all repeat, the first and the last
    are given, and the first reaches to the end of the run: neighbours are at most
    ``reach`` + 1 apart, so their segments leave no gap.
    """
    n, found = len(symbols), []
    for first in range(0, n - rule.length + 1, CHUNK):  # first: of the windows of this chunk
        until = min(n - rule.length + 1, first + CHUNK)
        low, high = max(0, first - rule.reach), min(n, until + rule.length + rule.reach)
        prefix = sums(symbols[low:high])
        gram_starts = np.arange(first, until + rule.reach) - low
        grams = span_hash(prefix, gram_starts, gram_starts + rule.gram)
        at = least_in_windows(grams, rule.reach + 1)
        found.append((at + first, grams[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), b""
    position, anchor = (np.concatenate(x) for x in zip(*found))
    position, once = np.unique(position, return_index=True)  # chunks may share an anchor
    anchor, left, right = anchor[once], np.minimum(rule.reach, position), np.minimum(rule.length, n - position)
    end = position + right
    segment = np.frombuffer(digests(raw, position - left, end, left << 32 | right), U).reshape(-1, 2)
    alike = np.r_[False, (anchor[1:] == anchor[:-1]) & (segment[1:] == segment[:-1]).all(axis=1), False]
    first, last = ~alike[:-1], ~alike[1:]  # of a run
    end[first] = end[last]
    kept = first | last
    return position[kept], end[kept], anchor[kept], segment[kept].tobytes()


def byte_values(seed: int = 3) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, U)


class Words(dict):
    """Digests of words, kept from text to text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = value
        return value


def word_hashes(text) -> np.ndarray:
    """A 64-bit digest of each word."""
    kept, out, done = worker_memory(), [], 0
    if not hasattr(kept, "words"):
        kept.words = Words()
    while done < len(text):  # by stretches of about CHUNK bytes that end with a word
        gap = BLANK_BYTE.search(text, min(done + CHUNK, len(text)))
        end = gap.start() if gap else len(text)
        words = bytes(text[done:end]).split()
        out.append(np.fromiter(map(kept.words.__getitem__, words), U, len(words)))
        done = end + 1
    return np.concatenate(out) if out else np.zeros(0, U)


def symbols_of(text, rule: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """(numbers for rolling hashes, what digests are taken of), per symbol of a text."""
    if rule.words:
        words = word_hashes(text)
        return words, words
    raw = np.frombuffer(text, np.uint8)
    return byte_values()[raw], raw


ANCHOR = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("end", pa.int64()), ("at", pa.int64()), ("anchor", pa.int64()), ("segment", pa.binary())])
SPAN = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _list_anchors(rule: Repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist())
            ids, columns, segments, n = [], [], [], 0

            def table() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.concatenate(c)) for c in zip(*columns)), binary16(b"".join(segments))], schema=ANCHOR)

            for key, text in zip(keys, byte_slices(batch.column("text"))):
                symbols, raw = symbols_of(text, rule)
                at, end, anchor, segment = anchors_of(symbols, raw, rule)
                if len(at):
                    ids += [key[0]] * len(at)
                    columns.append((np.full(len(at), key[1]), end, at, anchor.view(np.int64)))
                    segments.append(segment)
                    n += len(at)
                if n > 200_000:
                    yield table()
                    ids, columns, segments, n = [], [], [], 0
            if n:
                yield table()

    return run


SEGMENT = "block int, doc_id long, text_hash long, start long, anchor_at long, whole boolean, symbols binary"


def _once(batch: pa.RecordBatch, seen: set):
    """Rows that repeat an earlier row of the task are passed over; all their segments repeat anyway."""
    for row in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("wanted").to_pylist(), byte_slices(batch.column("text"))):
        if row[:2] not in seen:
            seen.add(row[:2])
            yield row


def _cut(rule: Repeats, blocks: int, merged: bool):
    """Rows with a text and its list ``wanted`` of (anchor, at, whole) become segments.

    ``merged``: segments of one document that overlap in one block become one, so
    that no place of the corpus stands in a block twice.
    """

    def run(batches):
        seen = set()
        for batch in batches:
            rows, size = [], 0
            for doc_id, text_hash, wanted, text in _once(batch, seen):
                symbols = word_hashes(text) if rule.words else np.frombuffer(text, np.uint8)
                own: dict[int, list] = {}
                for w in sorted(wanted, key=lambda w: w["at"]):
                    start, end = max(0, w["at"] - rule.reach), min(len(symbols), w["at"] + rule.length)
                    block = ((w["anchor"] & ((1 << 64) - 1)) >> 20) % blocks
                    into = own.setdefault(block, [])
                    if merged and into and start < into[-1][1]:
                        into[-1][1] = max(into[-1][1], end)
                        into[-1][3] = into[-1][3] and w["whole"]
                    else:
                        into.append([start, end, w["at"], w["whole"]])
                for block, spans in own.items():
                    for start, end, at, whole in spans:
                        cut = symbols[start:end].tobytes()
                        rows.append((block, doc_id, text_hash, start, at, whole, cut))
                        size += len(cut)
                if size > 16 << 20:
                    yield _segments(rows)
                    rows, size = [], 0
            if rows:
                yield _segments(rows)

    return run


def _segments(rows) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SEGMENT.split(", ")])


def _windows(rule: Repeats):
    """The digest of every window with a wanted anchor, each place once."""

    def run(batches):
        seen = set()
        for batch in batches:
            for doc_id, text_hash, wanted, text in _once(batch, seen):
                _, raw = symbols_of(text, rule)
                last = len(raw) - rule.length
                starts = np.unique(np.concatenate([np.arange(max(0, w["at"] - rule.reach), min(w["at"], last) + 1) for w in wanted]))
                for low in range(0, len(starts), CHUNK):
                    some = starts[low : low + CHUNK]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, text_hash)), pa.array(some), pa.array(some + rule.length), binary16(digests(raw, some, some + rule.length))], names=["doc_id", "text_hash", "start", "end", "window"])

    return run


def repeated_spans(docs: DataFrame, rule: Repeats, resolve: Callable[[pa.Table, Repeats], pa.Table], merged: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, spans: the stretches of symbols covered by windows that also start elsewhere.

    ``resolve`` gets the segments of a block and returns such stretches (SPAN).
    Spans may overlap; rows without any are left out; each row key has one row.
    """
    rows = keyed(docs, key, text).withColumn("text", F.col("text").cast("binary"))
    schema = "doc_id long, text_hash long, end long, at long, anchor long, segment binary"
    anchors = stored(rows.mapInArrow(_list_anchors(rule), schema), "anchors")
    again = stored(anchors.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors-repeated")
    shared = stored(sized_join(anchors, again, ["anchor"], "left_semi", SMALL), "anchors-shared")

    one = F.min(F.struct("doc_id", "text_hash", "at")).alias("one")
    kinds = stored(shared.groupBy("anchor", "segment").agg(F.count("*").alias("times"), one), "segments")
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("least"))
    groups = stored(groups.where("kinds > 1 and least = 1").select("anchor", (F.col("kinds") > rule.hot_segments).alias("hot")), "segment-groups")
    open_ = stored(sized_join(kinds, groups, ["anchor"], "inner", SMALL).select("one.*", "anchor", (F.col("times") > 1).alias("whole"), "hot"), "segments-open")

    def texts_of(some: DataFrame) -> DataFrame:
        wanted = some.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("anchor", "at", "whole")).alias("wanted"))
        return sized_join(rows, stored(wanted, "segments-wanted"), ROW_KEY, "inner", SMALL)

    cold = open_.where("not hot")
    blocks = parts(cold.count(), rule.block_segments)
    segments = texts_of(cold).mapInArrow(_cut(rule, blocks, merged), SEGMENT)
    span_schema = "doc_id long, text_hash long, start long, end long"
    found = segments.groupBy("block").applyInArrow(lambda table: resolve(table, rule), span_schema)

    reach = (F.greatest(F.col("at") - rule.reach, F.lit(0)).alias("start"), F.col("end"))
    # A kind with more than a thousandth of all rows is one of a thousand at most: these are broadcast, the others joined by shuffle.
    pair, many = ["anchor", "segment"], F.col("times") > F.lit(max(1, shared.count() // MOST_HOT_KINDS))
    common = F.broadcast(stored(kinds.where("times > 1").where(many).select(*pair), "segments-common"))
    rest = stored(kinds.where("times > 1").where(~many).select(*pair), "segments-whole")
    whole = shared.join(common, pair, "left_semi").unionByName(sized_join(shared.join(common, pair, "left_anti"), rest, pair, "left_semi", SMALL))
    spans = found.unionByName(whole.select(*ROW_KEY, *reach))
    hot = open_.where("hot")
    if not hot.isEmpty():
        windows = stored(texts_of(hot).mapInArrow(_windows(rule), span_schema + ", window binary"), "windows")
        twice = stored(windows.groupBy("window").count().where("count > 1").select("window"), "windows-repeated")
        spans = spans.unionByName(sized_join(windows, twice, ["window"], "left_semi", SMALL).drop("window"))
    return stored(spans.groupBy(*ROW_KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def united(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]
