"""Mixing sources to target weights.

Words are summed per source, targets follow from the weights, and a source's
rate is its target over its size. A document is taken ``floor(rate)`` times and
once more when a hash of its id falls below the remaining fraction. One pass
over the texts and one pre-aggregated sum per source; ranks of sources come from
a range partitioning, so no task holds all sources and no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, sized_join, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3.0
SEED = 5


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size, rank: ranks from 0 in code point order, null last."""
    ordered = stored(sizes.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("part", part).join(starts, "part").select("source", "source_size", (F.col("start") + within).alias("rank"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: the weights share the sum of all sizes; a source stops at ``most``
    times its size and what it leaves is shared again by weight until no source is above.

    Sizes of zero get a target of zero. Each round is one sum over the sources.
    """
    ranked = ranked_sources(sizes)
    place = F.col("rank") % len(weights)
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(place == i, F.lit(float(w))).otherwise(weight)
    table = stored(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "mix-weights")
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = 0.0, -1
    while True:
        # The level at which the open sources' weights use up what the full ones leave.
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        taken, open_weight, now_full = table.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(over, 1)),
        ).first()
        if now_full == full or open_weight == 0:
            break
        level, full = (total - taken) / open_weight, now_full
    return table.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    """Whole repeats and one more with the probability of the fraction; a function of the seed and the key."""
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))
    whole = F.floor(rate)
    return whole + F.when(uniform < rate - whole, 1).otherwise(0)


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    body = F.col(text)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(body.cast("string"), F.lit(""))).alias("text_hash"), F.col(source).cast("string").alias("source"), word_count(body).alias("size"))


def _shares(sized: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return stored(targets(sizes, weights, most), "mix-targets")


def _copies(most: float, seed: int) -> Column:
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    return copies(rate, F.coalesce("doc_id", "text_hash"), seed).cast("int")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, size, source_size, target, copies, taken.

    Null texts have size 0; null is a source of its own; sources without words get
    no copies. Rows with equal ids are taken equally often, and rows with a null id
    draw by their text. Texts of any length are counted in the row. An empty table
    gives an empty result; other columns, whatever their names, are ignored. Runs agree.
    """
    sized = stored(_sized(docs, key, text, source), "mix-sizes")
    found = sized_join(sized, _shares(sized, weights, most), ["source"], "inner").withColumn("copies", _copies(most, seed))
    return found.select("doc_id", "text_hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, and all its columns, whatever their names.

    A row's copies follow from its source's share and its own key, so rows meet only
    the table of sources. Nulls, repeated rows and empty tables as in ``mix``.
    """
    shares = _shares(_sized(docs, "doc_id", "text", "source"), WEIGHTS, MOST_REPEATS)
    rows = keyed(docs, "doc_id", "text", F.col("source").cast("string").alias("source"), F.struct("*").alias("row")).drop("text")
    taken = sized_join(rows, shares, ["source"], "inner").select("row", _copies(MOST_REPEATS, SEED).alias("copies"))
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
