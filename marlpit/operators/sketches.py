"""Distinct counts that merge: theta sketches by day, so that any window or difference comes from small rows.

A sketch of 2^log_k entries is exact up to that many different values; beyond, an estimate's relative deviation is about
2^(-log_k / 2), and that of a difference grows with the root of the union over the difference. Exact counts stay the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K = 14
KINDS = ("users", "items", "pairs")


def daily(events: DataFrame, *by: str, log_k: int = LOG_K) -> DataFrame:
    """(day, by, events, users, items, pairs), a sketch each of the last three. Nulls are no values; a pair needs both sides; events
    without a time have a null day. Sketches are filled ahead of the shuffle, so a hot day or kind is no load."""
    values = {"users": F.col("user_id"), "items": F.col("item_id"), "pairs": F.when(F.col("user_id").isNotNull() & F.col("item_id").isNotNull(), F.xxhash64("user_id", "item_id"))}
    return events.groupBy(F.to_date("ts").alias("day"), *by).agg(F.count("*").alias("events"), *(F.theta_sketch_agg(v, F.lit(log_k)).alias(n) for n, v in values.items()))


def merged(sketches: DataFrame, *by: Column | str, log_k: int = LOG_K) -> DataFrame:
    """Sketches of groups of days from those of their days."""
    return sketches.groupBy(*by).agg(F.sum("events").alias("events"), *(F.theta_union_agg(n, F.lit(log_k)).alias(n) for n in KINDS))


def trailing(sketches: DataFrame, days: int, *by: str, log_k: int = LOG_K) -> DataFrame:
    """Sketches of the ``days`` days that end with each day on which there is anything of the group's."""
    ends = sketches.select(F.col("day").alias("end"), *(F.col(c).alias(f"of_{c}") for c in by)).distinct()
    spread = sketches.withColumn("end", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda n: F.date_add("day", n))))
    spread = spread.withColumnRenamed("end", "to")
    same = spread["to"] == ends["end"]
    for c in by:
        same = same & spread[c].eqNullSafe(ends[f"of_{c}"])
    held = spread.join(ends, same, "left_semi").drop("day").withColumnRenamed("to", "day")
    return merged(held, "day", *by, log_k=log_k)


def estimates(sketches: DataFrame) -> DataFrame:
    """Numbers in place of sketches."""
    return sketches.withColumns({n: F.theta_sketch_estimate(n) for n in KINDS})


def beyond(now: Column, before: Column) -> Column:
    """Estimated number of values in the first sketch and not in the second; all without a second one."""
    return F.theta_sketch_estimate(F.when(before.isNull(), now).otherwise(F.theta_difference(now, before)))


def fits(estimate: Column, exact: Column, union: Column | None = None, log_k: int = LOG_K, deviations: float = 4.0) -> Column:
    """Whether an estimate is within so many deviations of the exact count, of a difference where the ``union`` is given."""
    room = F.sqrt(exact.cast("double") * (exact if union is None else union).cast("double")) * deviations / 2 ** (log_k / 2)
    return F.abs(estimate - exact) <= room
