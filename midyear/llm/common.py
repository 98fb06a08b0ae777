"""Shared by the operators: input columns, stored tables, joins of measured size."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from midyear.session import ensure_checkpoint_dir

# The characters that separate words, as a Java class and as the set for translate().
BLANK = r"\x20\x09-\x0D"
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"
WORD = f"[^{BLANK}]+"
# Tables up to this measured size are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16 << 20
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused path in the folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, and lost executors reread files.

    The shuffle files of the write go when it ends; nothing else reads them.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """doc_id, text_hash, text (null becomes empty) and ``more``; other columns, whatever their names, are left behind.

    (doc_id, text_hash) names a row in joins: ids may be null or repeated, and rows
    that agree in both get the same results.
    """
    filled = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(filled).alias("text_hash"), filled.alias("text"), *more)


ROW_KEY = ["doc_id", "text_hash"]


def _width(field: T.StructField) -> Column:
    kind, name = field.dataType, F.col(field.name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = 16 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 16
        return F.coalesce(F.size(name), F.lit(0)) * inner + 16
    return F.lit(16)


def size_of(df: DataFrame) -> int:
    """Bytes of the rows of a stored table, from a pass over it."""
    total = reduce(lambda a, b: a + b, [_width(f) for f in df.schema.fields])
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join on null-safe equality of ``keys``. ``right`` is a stored table: it is measured, broadcast
    within ``limit`` bytes and shuffled beyond, where adaptive execution splits skewed keys of ``left``."""
    names = {k: f"__{k}_{uuid.uuid4().hex[:8]}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[names[k]]) for k in keys])
    if size_of(right) <= limit:
        renamed = F.broadcast(renamed)
    return left.join(renamed, condition, how).drop(*names.values())


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped``; all its columns stay, clashing names too."""
    key = keyed(docs, "doc_id", "text", F.struct("*").alias("row")).drop("text")
    return sized_join(key, dropped, ROW_KEY, "left_anti").select("row.*")


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``verdicts`` has doc_id, text_hash, kept and n, the number of rows with that key,
    for keys that are dropped or stand for several rows; of the latter one row stays.
    """
    once = without_rows(docs, verdicts.select(*ROW_KEY))
    again = stored(verdicts.where("kept").select(*ROW_KEY), "kept-once")
    rows = keyed(docs, "doc_id", "text", F.struct("*").alias("row")).drop("text")
    return once.unionByName(sized_join(rows, again, ROW_KEY, "inner").dropDuplicates(ROW_KEY).select("row.*"))


def parts(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


def worker_memory() -> types.SimpleNamespace:
    """Where a Python worker keeps tables between its tasks."""
    name = "midyear_llm_worker"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name]


def release_memory() -> None:
    """At the end of a task: give what its tables took back to the system, since the worker goes on to live beside the next tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def byte_slices(column) -> list[memoryview]:
    """The values of an Arrow binary column without copies."""
    if not len(column):
        return []
    offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == "binary" else np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    view = memoryview(data if data is not None else b"")
    return [view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
