"""Exact dedup with counting quotient filters.

Every partition turns its fingerprints into a counting quotient filter, block by
block of the fingerprints' range. In a block the next bits of a fingerprint, about
as many as name its entries, are the quotient: they say in which slot's run it stands.
What is left is the remainder; remainders are kept in order and packed to their bits,
run lengths take a byte per slot, and counts stand in line only where above one.
Entries of a block are thus in the order of their fingerprints whatever its shape, so
filters merge without loss, two sorted runs of remainders at a time, adding counts of
equal ones. A merge task reads one block of every filter in turn. Fingerprints that
count above one name the rows whose bytes are compared; no other text moves.

A text that a third of all rows carry is one entry per filter and one partial
group per task when its bytes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARACTERS, keep_rows, keyed, parts, sized_join, stored

# Fingerprints of one filter, and filter entries that a merge task is meant to hold.
FILTER_ROWS = 1 << 21
BLOCK_ROWS = 1 << 19
FILTER = "block int, filter binary"
LONG_RUN = 255  # a byte that says: the run's length stands in the list behind
U = np.uint64


def counted(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, and how often each occurs."""
    values = np.sort(fingerprints)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other."""
    if not width:
        return b""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :]
    return np.packbits(bits).tobytes()


def unpack_bits(data: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, U)
    bits = np.unpackbits(data, count=n * width).reshape(n, width)
    whole = np.zeros((n, 64), np.uint8)
    whole[:, 64 - width :] = bits
    return np.packbits(whole, axis=1).view(">u8").ravel().astype(U)


def encoded(values: np.ndarray, counts: np.ndarray, block_bits: int) -> bytes:
    """The filter of one block: fingerprints in order that agree in their first ``block_bits`` bits, with counts."""
    n = len(values)
    q = min(max(0, (n - 1).bit_length()), 64 - block_bits)
    r = 64 - block_bits - q
    low = values & U((1 << (64 - block_bits)) - 1) if block_bits else values
    runs = np.bincount((low >> U(r)).astype(np.int64), minlength=1 << q)
    long, again = runs[runs >= LONG_RUN], np.flatnonzero(counts > 1)
    head = np.array([n, q, len(long), len(again)], "<i8").tobytes()
    marks = np.packbits(counts > 1).tobytes()
    inline = counts[again]
    small = np.minimum(inline, LONG_RUN).astype(np.uint8).tobytes()
    large = inline[inline >= LONG_RUN].astype("<i8").tobytes()
    return b"".join([head, np.minimum(runs, LONG_RUN).astype(np.uint8).tobytes(), long.astype("<i8").tobytes(), marks, small, large, pack_bits(low, r)])


def decoded(data: bytes, block: int, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in order and their counts."""
    n, q, n_long, n_again = np.frombuffer(data, "<i8", 4).tolist()
    at = 32

    def take(kind, size: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, size, at)
        at += out.nbytes
        return out

    runs = take(np.uint8, 1 << q).astype(np.int64)
    runs[runs == LONG_RUN] = take("<i8", n_long)
    again = np.unpackbits(take(np.uint8, -(-n // 8)), count=n).astype(bool)
    inline = take(np.uint8, n_again).astype(np.int64)
    large = np.flatnonzero(inline == LONG_RUN)
    inline[large] = take("<i8", len(large))
    counts = np.ones(n, np.int64)
    counts[again] = inline
    r = 64 - block_bits - q
    remainders = unpack_bits(np.frombuffer(data, np.uint8, offset=at), r, n)
    quotients = np.repeat(np.arange(1 << q, dtype=U), runs)
    base = U(block << (64 - block_bits)) if block_bits else U(0)
    return base | (quotients << U(r) if r < 64 else U(0)) | remainders, counts


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two runs of sorted entries as one; counts of equal entries are added."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    place = np.searchsorted(a[0], b[0])
    equal = np.zeros(len(b[0]), bool)
    inside = place < len(a[0])
    equal[inside] = a[0][place[inside]] == b[0][inside]
    counts = a[1].copy()
    counts[place[equal]] += b[1][equal]
    new = ~equal
    at = place[new] + np.arange(int(new.sum()))
    values, sums = np.empty(len(a[0]) + len(at), U), np.empty(len(a[0]) + len(at), np.int64)
    old = np.ones(len(values), bool)
    old[at] = False
    values[at], sums[at] = b[0][new], b[1][new]
    values[old], sums[old] = a[0], counts
    return values, sums


class Merge:
    """Filters come in one after the other; those merged equally often are merged with each other."""

    def __init__(self) -> None:
        self.held: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []

    def add(self, entries: tuple[np.ndarray, np.ndarray]) -> None:
        level = 0
        while self.held and self.held[-1][0] == level:
            entries, level = merged(self.held.pop()[1], entries), level + 1
        self.held.append((level, entries))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        out = (np.zeros(0, U), np.zeros(0, np.int64))
        for _, entries in reversed(self.held):
            out = merged(out, entries)
        return out


def _filters(block_bits: int):
    def emit(fingerprints: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, counts = counted(fingerprints)
        block = (values >> U(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(values), np.int64)
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        data = [encoded(values[i:j], counts[i:j], block_bits) for i, j in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int32()), pa.array(data, pa.binary())], names=["block", "filter"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(U))
            n += batch.num_rows
            if n >= FILTER_ROWS:
                yield from emit(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from emit(np.concatenate(held))

    return run


def _merged(block_bits: int):
    def run(filters: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = Merge()
        for batch in filters:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("filter").to_pylist()):
                merge.add(decoded(data, block, block_bits))
        values, counts = merge.result()
        again = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(values[again].view(np.int64)), pa.array(counts[again])], names=["fingerprint", "n"])

    return run


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """fingerprint, n: those that occur more than once in the one long column of ``fingerprints``."""
    block_bits = max(3, (parts(rows, BLOCK_ROWS) - 1).bit_length())
    filters = fingerprints.mapInArrow(_filters(block_bits), FILTER)
    return filters.groupBy("block").applyInArrow(_merged(block_bits), "fingerprint long, n long")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when they are identical without blanks (space and U+0009 to
    U+000D); null counts as empty, so null, empty and blank texts form one group.
    The row with the most code points stays, then the smallest id; a null id ranks
    after every id. Of rows that agree in id and text exactly one stays. An empty
    table gives an empty result. Texts may be as long as a row holds; other columns,
    whatever their names, are ignored.
    """
    normal = F.translate("text", BLANK_CHARACTERS, "")
    rows = keyed(docs, key, text).select("doc_id", "text_hash", F.char_length("text").cast("long").alias("length"), F.xxhash64(normal).alias("fingerprint"), F.sha2(normal, 256).alias("text_sha256"))
    narrow = stored(rows, "exact-rows")
    total = narrow.count()
    repeated = stored(repeated_fingerprints(narrow.select("fingerprint"), total).select("fingerprint"), "exact-suspects")
    # Byte verification: whole normalised texts of the suspects are grouped.
    texts = keyed(docs, key, text).select(normal.alias("bytes"), F.xxhash64(normal).alias("fingerprint"))
    same = sized_join(texts, repeated, ["fingerprint"], "left_semi").groupBy("fingerprint", "bytes").count().where("count > 1")
    verified = stored(same.select("fingerprint", F.sha2("bytes", 256).alias("text_sha256"), F.col("count").alias("group_size")), "exact-verified")
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("low_id"), "doc_id", "text_hash"))
    groups = sized_join(narrow, verified.drop("group_size"), ["fingerprint", "text_sha256"], "left_semi").groupBy("fingerprint", "text_sha256").agg(best.alias("best"))
    groups = groups.select("fingerprint", "text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.text_hash").alias("keep_hash"))
    groups = stored(groups.join(verified, ["fingerprint", "text_sha256"]), "exact-groups")
    lone = narrow.groupBy("doc_id", "text_hash", "fingerprint", "text_sha256").agg(F.count("*").cast("int").alias("copies"))
    found = sized_join(lone, groups, ["fingerprint", "text_sha256"], "left")
    grouped = F.col("group_size").isNotNull()
    wins = ~grouped | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash")))
    return found.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        wins.alias("wins"),
        "text_sha256",
        "text_hash",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "text_hash")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = stored(exact_groups(docs).select("doc_id", "text_hash", "kept"), "exact-result")
    per_row = stored(found.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "exact-drop")
    return keep_rows(docs, per_row)
