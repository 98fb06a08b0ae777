"""One response per URL out of a log of fetch attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from midyear.functions.outcomes import is_throttled


def resolve_attempts(log: DataFrame, key: str | list[str], payload: list[str], attempts: int = 3) -> DataFrame:
    """First attempt with status 200 wins; without one, the last attempt up to the cap.

    ``n_retries`` counts the failures before the winner, or is the cap.
    log: key (one or more columns), attempt, status and the ``payload`` columns.
    """
    keys = [key] if isinstance(key, str) else key
    if attempts < 1:
        raise ValueError("attempts must be at least 1")
    ok = F.col("status") == 200
    content = F.struct("status", *payload)
    return (
        log.where(F.col("attempt") <= attempts)
        .groupBy(*keys)
        .agg(
            F.min_by(F.when(ok, content), F.when(ok, F.col("attempt"))).alias("won"),
            F.min(F.when(ok, F.col("attempt"))).alias("won_at"),
            F.max_by(content, F.col("attempt")).alias("last"),
        )
        .select(
            *keys,
            F.coalesce("won", "last").alias("r"),
            F.coalesce(F.col("won_at") - 1, F.lit(attempts)).cast("int").alias("n_retries"),
        )
        .select(*keys, "r.*", "n_retries")
    )


def resolve_rounds(log: DataFrame, key: str, payload: list[str], attempts: int = 3) -> DataFrame:
    """As ``resolve_attempts``, with a second round in place of a throttled first one.

    log has a ``round`` column (1 or 2); ``payload`` includes ``final_url``.
    Both rounds come out of one aggregation over the key.
    """
    ok = F.col("status") == 200
    content = F.struct("status", *payload)

    def of_round(number: int) -> list:
        here = F.col("round") == number
        return [
            F.min_by(F.when(here & ok, content), F.when(here & ok, F.col("attempt"))).alias(f"won{number}"),
            F.min(F.when(here & ok, F.col("attempt"))).alias(f"won_at{number}"),
            F.max_by(F.when(here, content), F.when(here, F.col("attempt"))).alias(f"last{number}"),
        ]

    rounds = log.where(F.col("attempt") <= attempts).groupBy(key).agg(*of_round(1), *of_round(2))
    first = F.coalesce("won1", "last1")
    second = F.coalesce("won2", "last2")
    again = is_throttled(first["status"], first["final_url"]) & second.isNotNull()
    failures = F.when(again, F.coalesce(F.col("won_at2") - 1, F.lit(attempts))).otherwise(
        F.coalesce(F.col("won_at1") - 1, F.lit(attempts))
    )
    return rounds.select(
        key,
        F.when(again, second).otherwise(first).alias("r"),
        failures.cast("int").alias("n_retries"),
        F.when(again, 2).otherwise(1).alias("round"),
    ).select(key, "r.*", "n_retries", "round")


def compacted(log: DataFrame, key: str, attempts: int = 3) -> DataFrame:
    """The attempts of a log that can still decide what ``resolve_rounds`` picks, whatever is logged later.

    Per round: the first that succeeded, and the last up to the cap. At most four rows
    per key stay, so a log that is compacted with each addition grows with its keys, not
    with its attempts. The choice moves numbers only; rows are then picked by key.
    """
    within = log.where(F.col("attempt") <= attempts)
    ends = within.groupBy(key, "round").agg(
        F.min(F.when(F.col("status") == 200, F.col("attempt"))).alias("won"), F.max("attempt").alias("last")
    )
    kept = ends.select(key, "round", F.explode(F.array_distinct(F.array_compact(F.array("won", "last")))).alias("attempt"))
    return log.join(kept, [key, "round", "attempt"], "left_semi").select(*log.columns)
