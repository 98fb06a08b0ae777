"""Session set-up and lineage cutting."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

# Times are compared and printed in UTC. The archive side of a join is large, so
# adaptive execution, skew splitting and run-time bloom filters stay on.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app_name: str = "midyear", master: str | None = None, shuffle_partitions: int | None = None, **conf: str
) -> SparkSession:
    """Session with the settings above; keyword names use ``__`` for dots.

    ``shuffle_partitions``: how finely shuffles are cut before adaptive execution
    joins small parts; about the shuffled bytes over 128 MB.
    """
    if shuffle_partitions:
        conf["spark__sql__adaptive__coalescePartitions__initialPartitionNum"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may do without the setting, in a folder under the warehouse;
    on a cluster a missing setting is an error, since executors could not share the files.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/midyear-checkpoint"
        context.setCheckpointDir(shared)
    return context.getCheckpointDir().rstrip("/")


def checkpoint_path(spark: SparkSession, label: str = "stored") -> str:
    """An unused path in the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into Parquet files in the checkpoint folder; lost executors reread them.

    Later plans read only the columns they need, and know the size of the files.
    """
    path = checkpoint_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Keys:
    """URLs of a stored table, with the rows they come from, and their sizes as counted while it was written."""

    urls: DataFrame
    count: int
    bytes: int
    row_bytes: int

    def __add__(self, other: Keys) -> Keys:
        return Keys(
            self.urls.unionByName(other.urls), self.count + other.count, self.bytes + other.bytes,
            self.row_bytes + other.row_bytes,
        )


@dataclass(frozen=True)
class Stored:
    """A table in the checkpoint folder and the URLs it asks for."""

    rows: DataFrame
    count: int
    keys: Keys


def _bytes(field: StructField) -> Column:
    return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16 if isinstance(field.dataType, StringType) else F.lit(16)


def store(df: DataFrame, url: str, wanted: Column | None = None) -> Stored:
    """As ``cut_lineage``; rows, and the URLs of rows where ``wanted`` holds, are counted as they are written."""
    wanted = F.lit(True) if wanted is None else wanted
    asks = F.coalesce(wanted & F.col(url).isNotNull(), F.lit(False))
    width = reduce(lambda a, b: a + b, [_bytes(f) for f in df.schema.fields])
    seen = Observation()
    rows = cut_lineage(df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(asks).alias("count"),
        F.coalesce(F.sum(F.when(asks, F.octet_length(url) + 16)), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(asks, width)), F.lit(0)).alias("row_bytes"),
    ))
    got = seen.get
    urls = rows.where(asks).select(F.col(url).alias("url"))
    return Stored(rows, got["rows"], Keys(urls, got["count"], got["bytes"], got["row_bytes"]))
