"""Validators that gather every broken rule as rows (rule, key), report them and raise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.operators import sequences as Q


class InvalidData(ValueError):
    """Rows break rules; the message lists the first of them and the total."""


def broken(rows: DataFrame, rule: str, *key: str) -> DataFrame:
    """(rule, key) of rows that break a rule, the key's parts joined by colons."""
    return rows.select(F.lit(rule).alias("rule"), F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key)).alias("key"))


def together(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated(rows: DataFrame, rule: str, *key: str) -> DataFrame:
    return broken(rows.groupBy(*key).agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1"), rule, *key)


def unknown(rows: DataFrame, rule: str, column: str, known: DataFrame, *key: str) -> DataFrame:
    """Rows whose ``column`` is not the only column of ``known``."""
    return broken(rows.join(known.toDF("known_id"), F.col(column) == F.col("known_id"), "left_anti"), rule, *key)


def event_violations(events: DataFrame, users: DataFrame, items: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Rules of one event: unique id, known user, item and kind, a time."""
    return together([
        repeated(events, "event id repeats", "event_id"), unknown(events, "unknown user", "user_id", users, "event_id"), unknown(events, "unknown item", "item_id", items, "event_id"),
        broken(events.where(~F.coalesce(F.col("event_type").isin(*kinds), F.lit(False))), "unknown event type", "event_id"), broken(events.where("ts is null"), "no time", "event_id"),
    ])


def session_violations(events: DataFrame) -> DataFrame:
    """Rules of a session's order: times increase, an item is shown once, a view follows an impression of the session."""
    shown = events.where(Q.kind("impression"))
    return together([
        broken(Q.not_increasing(events), "time does not increase", "event_id"), repeated(shown, "impression repeats", "user_id", "session", "item_id"),
        broken(Q.views_without_impression(events), "view without earlier impression", "event_id"),
    ])


def engagement_violations(events: DataFrame) -> DataFrame:
    """Rules of a pair's funnel: each engagement once, and after a view of the pair."""
    held = events.where(Q.kind(*Q.ENGAGEMENTS))
    return together([repeated(held, "engagement repeats", "user_id", "item_id", "event_type"), broken(Q.source_views(events).where("source_view is null"), "engagement without earlier view", "event_id")])


def split_violations(events: DataFrame, splits: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules of a labelled split (column ``split``): each event lies in the split whose half-open window holds its time."""
    inside: Column = F.lit(False)
    for name, start, end in splits:
        inside |= (F.col("split") == name) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return broken(events.where(~F.coalesce(inside, F.lit(False))), "outside its split", "event_id")


def catalog_violations(products: DataFrame, key: str, name: str, price: str, bounded: Sequence[str] = ()) -> DataFrame:
    """Rules of products: unique id and name, a positive price, attributes between 0 and 1."""
    out = [repeated(products, "product id repeats", key), repeated(products, "product name repeats", name), broken(products.where(~F.coalesce(F.col(price) > 0, F.lit(False))), "price not positive", key)]
    out += [broken(products.where(~F.coalesce(F.col(c).between(0, 1), F.lit(False))), f"{c} outside 0 to 1", key) for c in bounded]
    return together(out)


def counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count("*").alias("n"))


def check(violations: DataFrame, what: str, shown: int = 50) -> None:
    """Raise with the first ``shown`` violations, in order, and the number of the others; nothing else reaches the driver."""
    total = violations.count()
    if total:
        first = [f"{r['rule']}: {r['key']}" for r in violations.orderBy("rule", "key").limit(shown).collect()]
        more = f"\n- ... and {total - len(first)} more" if total > len(first) else ""
        raise InvalidData(f"{what}: {total} rules broken\n- " + "\n- ".join(first) + more)
