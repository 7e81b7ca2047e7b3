"""Ordered scans whose hottest keys don't end up in one task.

A scan gives each row a state folded from the rows of its key up to it. Keys of up to ``most`` rows take a window. Rows of hotter keys
are range-partitioned by key and order, so one key lies in many ranges; each range is folded by itself, what a
range adds to the keys that reach over its borders is summed up in one row, these rows are combined from range to range, and the
state at a range's start is filled into its rows. Only the keys at both ends of a range can reach over a border, so
what is combined and filled in has at most two rows a range.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.sources.durable import cut

#: Rows of one key that one task may hold.
MOST = 1_000_000
#: Hot keys that are broadcast; with more of them only hotter ones are spread.
FEW_KEYS = 100_000


@dataclass(frozen=True)
class Fold:
    """A state that merges: the sum, the largest or the last non-null value so far, with or without the row itself."""

    kind: str
    value: Column
    itself: bool = False

    def inside(self, keys: Sequence[str], order: Sequence[str]) -> Column:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if self.itself else -1)
        found = {"total": F.sum(self.value), "largest": F.max(self.value), "last": F.last(self.value, ignorenulls=True)}[self.kind].over(frame)
        return F.coalesce(found, F.lit(0)) if self.kind == "total" else found

    def of_range(self, order: Sequence[str]) -> Column:
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order)))
        return F.sum(self.value) if self.kind == "total" else F.max(self.value)

    def ahead(self, name: str, keys: Sequence[str], part: str) -> Column:
        frame = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        return {"total": F.sum, "largest": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[self.kind](name).over(frame)

    def merged(self, ahead: Column, own: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(own, ahead)
        return F.coalesce(ahead, F.lit(0)) + own if self.kind == "total" else F.greatest(ahead, own)


def total(value: Column, itself: bool = False) -> Fold:
    return Fold("total", value, itself)


def largest(value: Column, itself: bool = False) -> Fold:
    return Fold("largest", value, itself)


def last(value: Column, itself: bool = False) -> Fold:
    return Fold("last", value, itself)


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"of_{c}"]) for c in columns))


@dataclass(frozen=True)
class Scan:
    """Rows made ready by ``scan``: ``fold`` and ``add`` give them columns, ``rows`` gives them back."""

    calm: DataFrame
    hot: DataFrame | None
    keys: tuple[str, ...]
    order: tuple[str, ...]

    def fold(self, **folds: Fold) -> Scan:
        """With a column of each fold's state; a row's peers in the whole order come in any order, as in a window of rows."""
        calm = self.calm.withColumns({n: f.inside(self.keys, self.order) for n, f in folds.items()})
        if self.hot is None:
            return replace(self, calm=calm)
        parted = [*self.keys, "scan_range"]
        key = F.struct(*self.keys)
        ends = self.hot.groupBy("scan_range").agg(F.min(key).alias("first"), F.max(key).alias("last"))
        ends = ends.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("k")).groupBy("k").agg(F.count("*").alias("ranges")).where("ranges > 1")
        ends = F.broadcast(ends.select(*(F.col("k")[c].alias(f"of_{c}") for c in self.keys)))
        sums = self.hot.join(ends, _same(self.hot, ends, self.keys), "left_semi").groupBy(*parted).agg(*(f.of_range(self.order).alias(n) for n, f in folds.items()))
        ahead = sums.select(*(F.col(c).alias(f"of_{c}") for c in parted), *(f.ahead(n, self.keys, "scan_range").alias(f"ahead_{n}") for n, f in folds.items()))
        ahead = F.broadcast(cut(ahead))
        inside = self.hot.withColumns({n: f.inside(parted, self.order) for n, f in folds.items()})
        told = inside.join(ahead, _same(inside, ahead, parted), "left")
        told = told.withColumns({n: f.merged(F.col(f"ahead_{n}"), F.col(n)) for n, f in folds.items()})
        return replace(self, calm=calm, hot=told.drop(*(f"of_{c}" for c in parted), *(f"ahead_{n}" for n in folds)))

    def add(self, **columns: Column) -> Scan:
        """With further columns of each row."""
        return replace(self, calm=self.calm.withColumns(columns), hot=None if self.hot is None else self.hot.withColumns(columns))

    def rows(self) -> DataFrame:
        return self.calm if self.hot is None else self.calm.unionByName(self.hot.drop("scan_range"))


def hot_keys(rows: DataFrame, key: str, most: int = MOST) -> tuple[DataFrame, int] | None:
    """Keys with more than ``most`` rows, nulls as one key, and the number of their rows; none without such a key. They are at most ``FEW_KEYS``."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    while True:
        held = counts.where(F.col("n") > most)
        keys, of_them = held.agg(F.count("*"), F.sum("n")).first()
        if keys <= FEW_KEYS:
            return (cut(held.select(F.col(key).alias(f"of_{key}"))), of_them) if keys else None
        most *= 4


def scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = MOST) -> Scan:
    """``rows`` ready to be folded by ``keys`` in ``order``. The first key alone says which rows are hot, as no longer key has more of them.

    Null keys are a key like any other, and null times come first. Rows that agree in all of keys and order stay in one range.
    Empty tables give empty ones. ``scan_range`` and names with ``of_`` or ``ahead_`` before a key's or fold's name are taken.
    """
    found = hot_keys(rows, keys[0], most)
    if found is None:
        return Scan(rows, None, tuple(keys), tuple(order))
    hot, of_them = F.broadcast(found[0]), found[1]
    apart = _same(rows, hot, keys[:1])
    ranges = max(-(-of_them // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = rows.join(hot, apart, "left_semi").repartitionByRange(ranges, *keys, *order).withColumn("scan_range", F.spark_partition_id())
    return Scan(rows.join(hot, apart, "left_anti"), cut(spread), tuple(keys), tuple(order))
