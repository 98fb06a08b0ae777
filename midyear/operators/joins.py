"""Joins against the archive that leave it where it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from midyear.session import Keys

# So few URLs are written into the plan: only the files of their buckets, and in them their row groups, are read.
FEW_URLS = 200


def restrict(archive: DataFrame, wanted: Keys, max_bytes: int, buckets: int | None = None) -> DataFrame:
    """Rows of ``archive`` whose url is wanted, so that what follows works on these only.

    Few URLs become a filter on a bucketed archive. URLs within ``max_bytes`` are
    broadcast and the archive is filtered where it is read. More of them are dealt to
    the buckets of the archive and met there; its rows stay where they are. Only
    without buckets are both sides shuffled.
    """
    if buckets and wanted.count <= FEW_URLS:
        return archive.where(F.col("url").isin([r.url for r in wanted.urls.distinct().collect()]))
    if wanted.bytes <= max_bytes:
        return archive.join(F.broadcast(wanted.urls.distinct()), "url", "left_semi")
    urls = wanted.urls.repartition(buckets, "url") if buckets else wanted.urls
    return archive.join(urls.distinct().hint("shuffle_hash"), "url", "left_semi")
