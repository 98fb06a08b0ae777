"""Vector codes from integer codebooks, assigned through memoised grid cells.

Vectors are cut into equal parts, each with a codebook. To find the nearest entry of a
part, the part's coarse cell (its components over ``CELL``) is looked up in a table
the task's worker keeps. A cell's list holds the entries that no other entry dominates
across the cell's box: an entry is left out if its least distance to the box exceeds
another's greatest. Only listed entries are evaluated exactly, so the result is that
of comparing all. Lists are worked out once per cell and codebook, a batch's new cells
at a time. Rounds move sums and counts per entry, a few thousand numbers per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, sized_join, stored, worker_memory
from .vectors import integer_vectors, longest, padded

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
CELL = 64  # width of a cell, about half the spread of a component
MOST_CELLS = 1 << 15  # that a worker keeps per part
AT_ONCE = 1 << 21
SAFE = 1 << 24  # components up to this have distances within 64 bits in parts of up to 2**13


class Cells:
    """Lists of entries per coarse cell, for one part and state of its codebook."""

    def __init__(self, book: np.ndarray, cell: int) -> None:
        self.book, self.cell, self.lists, self.evaluated = book, cell, {}, 0

    def learn(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries of each cell that are not dominated."""
        out, step = [], max(1, AT_ONCE // len(self.book))
        for at in range(0, len(cells), step):
            some = cells[at : at + step]
            near, far = np.zeros((len(some), len(self.book)), np.int64), np.zeros((len(some), len(self.book)), np.int64)
            for j in range(some.shape[1]):
                # Few coordinates are distinct: distances to the sides are worked out once for each.
                places, which = np.unique(some[:, j], return_inverse=True)
                low = (places * self.cell)[:, None] - self.book[None, :, j]
                high = low + (self.cell - 1)
                near += (np.maximum(np.maximum(low, -high), 0) ** 2)[which]
                far += (np.maximum(np.abs(low), np.abs(high)) ** 2)[which]
            row, entry = np.nonzero(near <= far.min(axis=1, keepdims=True))
            out += np.split(entry, np.searchsorted(row, np.arange(1, len(some))))
        return out

    def of(self, parts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The lists of the distinct cells of these parts, and which one each part is in."""
        cells = np.ascontiguousarray(parts // self.cell)
        _, first, which = np.unique(cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel(), return_index=True, return_inverse=True)
        cells = cells[first]
        keys = [c.tobytes() for c in cells]
        lists = [self.lists.get(k) for k in keys]
        new = [i for i, found in enumerate(lists) if found is None]
        if new:
            if len(self.lists) + len(new) > MOST_CELLS:
                self.lists = {}
            for i, found in zip(new, self.learn(cells[new])):
                lists[i] = found
                if len(self.lists) < MOST_CELLS:
                    self.lists[keys[i]] = found.astype(np.int16)
        return lists, which

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part; ties go to the lower entry."""
        if not parts.shape[1] or not len(parts):
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        lists, which = self.of(parts)
        sizes, pool = np.array([len(x) for x in lists]), np.concatenate(lists).astype(np.int64)
        starts, n = np.cumsum(sizes) - sizes, len(self.book)
        code, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        ends = np.cumsum(sizes[which])
        at = 0
        while at < len(parts):
            done = ends[at - 1] if at else 0
            until = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE // parts.shape[1], side="right")))
            some = which[at:until]
            first = np.cumsum(sizes[some]) - sizes[some]
            entry = pool[np.arange(int(sizes[some].sum())) + np.repeat(starts[some] - first, sizes[some])]
            apart = np.repeat(parts[at:until], sizes[some], axis=0)
            apart -= self.book[entry]
            d = np.einsum("ij,ij->i", apart, apart)
            distance[at:until] = np.minimum.reduceat(d, first)
            tied = np.where(d == np.repeat(distance[at:until], sizes[some]), entry, n)
            code[at:until] = np.minimum.reduceat(tied, first)
            self.evaluated += len(entry)
            at = until
        return code, distance


def nearest_of_all(book: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``Cells.nearest`` for numbers of any size, entry by entry; distances are held within 64 bits."""
    wide, best, code = parts.astype(object), None, np.zeros(len(parts), np.int64)
    for i, entry in enumerate(book.astype(object)):
        d = ((wide - entry) ** 2).sum(axis=1) if parts.shape[1] else np.zeros(len(parts), object)
        closer = np.ones(len(parts), bool) if best is None else (d < best).astype(bool)
        best = np.where(closer, d, best) if best is not None else d
        code[closer] = i
    return code, np.array([min(int(x), (1 << 63) - 1) for x in best], np.int64)


def assign(books: np.ndarray, vectors: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances), a column per part; books: part, entry, component."""
    kept, name = worker_memory(), (hashlib.sha256(books.tobytes()).digest(), books.shape, cell)
    if getattr(kept, "cells_of", None) != name:
        kept.cells_of, kept.cells = name, [Cells(book, cell) for book in books]
    width, out = books.shape[2], []
    safe = max(np.abs(books).max(initial=0), np.abs(vectors).max(initial=0)) <= SAFE
    for i, cells in enumerate(kept.cells):
        parts = np.ascontiguousarray(vectors[:, i * width : (i + 1) * width])
        if not safe:  # whole columns of numbers that overflow: a few vectors of a batch at most
            small = np.abs(parts).max(axis=1, initial=0) <= SAFE if np.abs(cells.book).max(initial=0) <= SAFE else np.zeros(len(parts), bool)
            code, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
            code[small], distance[small] = cells.nearest(parts[small])
            code[~small], distance[~small] = nearest_of_all(cells.book, parts[~small])
            out.append((code, distance))
        else:
            out.append(cells.nearest(parts))
    return np.stack([c for c, _ in out], axis=1), np.stack([d for _, d in out], axis=1)


def _sums(books, cell: int):
    """Per task, part and entry: the sum of the parts assigned to it, and their number."""

    def run(batches):
        b = books.value
        total, count = np.zeros(b.shape, object), np.zeros(b.shape[:2], np.int64)
        for batch in batches:
            vectors = padded(batch.column("vector"), b.shape[0] * b.shape[2])
            codes, _ = assign(b, vectors, cell)
            wide = np.abs(vectors).max(initial=0) > SAFE
            for i in range(b.shape[0]):
                parts = vectors[:, i * b.shape[2] : (i + 1) * b.shape[2]]
                some = np.zeros(b.shape[1:], object if wide else np.int64)
                np.add.at(some, codes[:, i], parts.astype(object) if wide else parts)
                total[i] += some
                count[i] += np.bincount(codes[:, i], minlength=b.shape[1])
        part, entry = np.nonzero(count)
        sums = [[str(x) for x in total[p, e]] for p, e in zip(part, entry)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(sums, pa.list_(pa.string())), pa.array(count[part, entry], pa.int64())], names=["part", "entry", "sums", "n"])
        release_memory()

    return run


def improved(rows: DataFrame, books: np.ndarray, cell: int) -> np.ndarray:
    """The codebooks after one round: every entry becomes the floor of the mean of its parts; unused entries stay."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(books)
    sums = rows.select("vector").mapInArrow(_sums(sent, cell), "part int, entry int, sums array<string>, n long")
    each = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(books.shape[2])]
    after = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # at most a row per entry
        after[r.part, r.entry] = [int(r[f"s{j}"]) // r.n for j in range(books.shape[2])]
    sent.destroy()
    return after


def first_books(rows: DataFrame, entries: int, parts: int, width: int) -> np.ndarray:
    """The parts of the vectors with the ``entries`` smallest ids; rows without an id come last."""
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).toArrow()
    vectors = padded(seeds.column("vector"), parts * width)
    return np.ascontiguousarray(vectors.reshape(len(vectors), parts, width).transpose(1, 0, 2))


def _coded(books, cell: int):
    def run(batches):
        b = books.value
        for batch in batches:
            codes, distances = assign(b, padded(batch.column("vector"), b.shape[0] * b.shape[2]), cell)
            text = ["".join(f"{x:02x}" for x in row) for row in codes.tolist()]
            error = [min(sum(row), (1 << 63) - 1) for row in distances.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
        release_memory()

    return run


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL) -> np.ndarray:
    """The codebooks of a table of integer vectors: part, entry, component."""
    books = first_books(rows, entries, parts, -(-longest(rows) // parts))
    for _ in range(rounds if books.size else 0):
        books = improved(rows, books, cell)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(df: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``df`` whose vector is whole: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out; so the
    result of an empty table is empty. Vectors shorter than the longest, and a longest
    one that the parts do not divide, are filled up with zeros. With fewer rows than
    entries each row begins an entry. Rows with equal or null ids are rows of their own,
    equal ones in the order of their vectors; null ids come last. Null labels are one
    label. Distances beyond 64 bits are held at the largest long. Other columns,
    whatever their names, are ignored.
    """
    rows = integer_vectors(df, scale, F.col(label).alias("label"), key=key, vector=vector)
    books = trained(rows, parts, entries, rounds, cell)
    sent = df.sparkSession.sparkContext.broadcast(books)
    kind = rows.schema["label"].dataType.simpleString()
    coded = stored(rows.select("vec_id", "label", "vector").mapInArrow(_coded(sent, cell), f"vec_id long, label {kind}, code string, error long"), "codes")
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "code-errors")
    return sized_join(coded, sums, ["label"], "inner").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
