"""Exact order statistics by distributed selection, without a sort and without a buffer of a group's values.

A pass cuts the range of values that holds a wanted rank into bins and counts rows by bin, ahead of the
shuffle; the bin with the rank, shrunk to the smallest and largest value in it, is the next
range. Bins follow a monotone function of the value, so ranks never move between them, and the ends of a range fall into
different bins, so every pass narrows it until both ends are one value. A range loses about ten bits a pass: evenly
spread values take one pass for every three digits of a group's rows, values over many magnitudes more, ties end at once, and
one group of all rows is counted by all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from marlpit.sources.durable import cut

BINS = 1024
#: Ranges of up to this many rows are broadcast to the values, after a count of them.
FEW_RANGES = 50_000


def _key(by: Sequence[str]) -> Column:
    """Group columns as one struct, in which nulls are equal to each other."""
    return F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))


def _bin(exact: bool) -> Column:
    """Bin of a value between lo and hi, from 0 to BINS - 1. Decimals are doubles only after the exact difference; both
    ends of doubles are halved, so that no difference overflows."""
    v, lo, hi = (F.col(c) if exact else F.col(c) / 2 for c in ("v", "lo", "hi"))
    place = F.floor(F.try_divide((v - lo).cast("double"), (hi - lo).cast("double")) * BINS)
    return F.coalesce(F.least(place.cast("int"), F.lit(BINS - 1)), F.lit(0))


def select(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, rank, v) for each row of ``wanted`` (key, rank from 0) that its group of ``values`` (key, v) reaches.

    Nulls and NaN take no part, repeated values count each, repeated wishes give one row, and no rows give none. A decimal
    stays a decimal; all other numbers are compared as doubles.
    """
    exact = isinstance(values.schema["v"].dataType, DecimalType)
    held = values.where("v is not null") if exact else values.select("key", F.col("v").cast("double").alias("v")).where("v is not null and not isnan(v)")
    held = cut(held)
    ends = held.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    state = cut(wanted.select("key", F.col("rank").cast("long").alias("rank")).distinct().join(ends, "key").where("rank >= 0 and rank < n").select("key", "rank", "lo", "hi", F.lit(0).cast("long").alias("before")))
    while (n := state.where("lo < hi").count()):
        todo = state.where("lo < hi")
        ranges = todo.select("key", "lo", "hi").distinct()
        met = held.join(F.broadcast(ranges) if n <= FEW_RANGES else ranges, "key").where("v >= lo and v <= hi")
        counted = met.groupBy("key", "lo", "hi", _bin(exact).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy("key", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # a row a bin
        found = todo.join(counted.withColumn("upto", upto), ["key", "lo", "hi"])
        place = F.col("rank") - F.col("before")
        found = found.where((place < F.col("upto")) & (place >= F.col("upto") - F.col("n")))
        found = found.select("key", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("upto") - F.col("n")).alias("before"))
        state = cut(state.where("lo = hi").unionByName(found))
    return state.select("key", "rank", F.col("lo").alias("v"))


def quantiles(rows: DataFrame, value: str, at: dict[str, float], *by: str) -> DataFrame:
    """(by, names of ``at``): linearly interpolated quantiles of each group that has a value."""
    values = cut(rows.select(_key(by).alias("key"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"))
    sizes = values.groupBy("key").agg(F.count("*").alias("n"))
    spots = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(q))).alias("at")) for name, q in at.items()))
    spots = cut(sizes.select("key", F.explode(spots).alias("s")).select("key", "s.name", "s.at", F.floor("s.at").alias("low"), F.ceil("s.at").alias("high")))
    found = select(values, spots.select("key", F.explode(F.array("low", "high")).alias("rank")))
    end = lambda name, to: found.select("key", F.col("rank").alias(name), F.col("v").alias(to))
    share = F.col("at") - F.col("low")
    both = spots.join(end("low", "a"), ["key", "low"]).join(end("high", "b"), ["key", "high"]).withColumn("x", F.when(share == 0, F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b")))
    told = both.groupBy("key").agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in at))
    return told.select(*(F.col("key")[c].alias(c) for c in by), *at)


def with_quantiles(stats: DataFrame, rows: DataFrame, value: str, at: dict[str, float], *by: str) -> DataFrame:
    """``stats``, a row for each group, with quantiles of the groups of ``rows``; null for a group without a value."""
    found = quantiles(rows, value, at, *by)
    if not by:
        return stats.join(found, F.lit(True), "left")  # one row each
    told = found.select(_key(by).alias("of"), *at)
    return stats.join(told, _key(by) == F.col("of"), "left").drop("of")


def decimal_quantile(rows: DataFrame, value: str, q: str, *by: str) -> DataFrame:
    """(by, percentile): a linear quantile of exact decimals, interpolated as decimals; ``q`` is a text like ``0.25``."""
    values = cut(rows.select(_key(by).alias("key"), F.col(value).alias("v")).where("v is not null"))
    spots = values.groupBy("key").agg(((F.count("*") - 1) * F.lit(q).cast("decimal(3,2)")).alias("at"))
    spots = cut(spots.withColumns({"low": F.floor("at").cast("long"), "high": F.ceil("at").cast("long"), "share": (F.col("at") - F.floor("at")).cast("decimal(3,2)")}))
    found = select(values, spots.select("key", F.explode(F.array("low", "high")).alias("rank")))
    end = lambda name, to: found.select("key", F.col("rank").alias(name), F.col("v").alias(to))
    both = spots.join(end("low", "a"), ["key", "low"]).join(end("high", "b"), ["key", "high"])
    return both.select(*(F.col("key")[c].alias(c) for c in by), (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("percentile"))
