"""Integer vectors in tables and in tasks, and numbered blocks of a query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

VALUES_IN_HAND = 1 << 20  # components that a task holds of a table at a time


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def integer_vectors(df: DataFrame, scale: int, *more: Column, key: str = "vec_id", vector: str = "embedding", label: str = "integer-vectors") -> DataFrame:
    """row, vec_id, vector, ``more``; stored. Components become floor(scale * x), held within 64 bits.

    Vectors that are null or hold null or non-finite components are left out. ``row``
    tells rows with equal ids apart. Other columns, whatever their names, are left behind.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    chosen = df.where(is_finite(F.col(vector))).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("vec_id"), whole.alias("vector"), *more)
    return stored(chosen, label)


def longest(rows: DataFrame) -> int:
    """The length of the longest vector."""
    return rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]


def in_blocks(rows: DataFrame, per_block: int, *order: str) -> DataFrame:
    """``rows`` with a number ``block``, stored; every block but the last has exactly ``per_block`` rows.

    Rows are numbered in the order of ``order``: a range partitioning, and one row per
    partition for the offsets, so no task holds them all.
    """
    ordered = stored(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    number = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    found = ordered.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return stored(found.withColumn("block", F.floor(number / per_block).cast("int")).drop("__at", "__part", "__start"), "blocks")


def padded(column, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of ``width`` numbers; what is missing is zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of at least ``rows`` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def fits_double(*most: float, width: int) -> bool:
    """Whether sums of ``width`` products of numbers up to these are exact in doubles."""
    return float(np.prod([float(x) for x in most])) * max(width, 1) < 2.0**52


def magnitude(numbers: np.ndarray) -> float:
    return float(max(-float(numbers.min()), float(numbers.max()))) if numbers.size else 0.0


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices; exact if they fit 64 bits."""
    if fits_double(magnitude(a), magnitude(b), width=a.shape[1]):
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best_of(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group, in order: higher scores first, then smaller ids, then rows."""
    order = np.lexsort((rows, ids, ~scores, groups))
    g = groups[order]
    new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return order[np.arange(len(g)) - first < k]
