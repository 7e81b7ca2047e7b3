"""Popularity scores, deterministic rankings, top-k lists and macro-averaged ranking metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.operators.dataset import favoriteplus, placed

SIGNALS = ("total_view", "unique_view_users", "log_view", "favoriteplus", "cart", "purchase", "weighted")


@dataclass(frozen=True)
class Weights:
    """Weights of the combined signal; only log1p of views is known."""

    view: float = 1.0
    favorite: float = 3.0
    cart: float = 5.0
    purchase: float = 8.0

    def __post_init__(self) -> None:
        if any(not math.isfinite(w) or w < 0 for w in (self.view, self.favorite, self.cart, self.purchase)):
            raise ValueError("weights must be finite and not negative")

    def strength(self) -> Column:
        has = lambda n: (F.col(f"{n}_count") > 0).cast("double")
        return self.view * F.log1p("view_count") + self.favorite * has("favorite") + self.cart * has("cart") + self.purchase * has("purchase")


def popularity_scores(facts: DataFrame, items: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """All seven scores of every item in one pass over train facts; cold items score 0."""
    sums = {
        "total_view": F.col("view_count"), "unique_view_users": F.col("view_count") > 0, "log_view": F.log1p("view_count"), "favoriteplus": favoriteplus(),
        "cart": F.col("cart_count"), "purchase": F.col("purchase_count"), "weighted": weights.strength(),
    }
    found = facts.groupBy("item_id").agg(*(F.round(F.sum(c.cast("double")), 9).alias(n) for n, c in sums.items()))
    return items.select("item_id").join(found, "item_id", "left").fillna(0.0, list(sums))


def long_scores(scores: DataFrame) -> DataFrame:
    return scores.unpivot("item_id", list(SIGNALS), "signal", "score")


def ranked(scores: DataFrame, *by: str) -> DataFrame:
    """Rank by score, largest first, then by item, within ``by``. Places come from range partitions of all rows and
    start anew where a group does, so no task has a group's items."""
    held, _ = placed(scores, *by, F.col("score").desc(), F.col("item_id"))
    if not by:
        return held.withColumn("rank", (F.col("place") + 1).cast("int")).drop("place")
    starts = held.groupBy(*by).agg(F.min("place").alias("start"))
    return held.join(starts, list(by)).withColumn("rank", (F.col("place") - F.col("start") + 1).cast("int")).drop("place", "start")


def positions(ranking: DataFrame, relevance: DataFrame, seen: DataFrame | None, *by: str) -> DataFrame:
    """Where a ranking that all users share puts each relevant item after the user's seen items are left out.

    A relevant item's place is its rank less the user's seen items above it, so no list is
    ever built: work grows with relevant and seen pairs, not with users times items. Items
    that are no candidates or seen have no place but stay in the denominators.
    """
    if seen is None:
        return relevance.join(ranking.select(*by, "item_id", "rank"), [*by, "item_id"], "left").withColumnRenamed("rank", "position")
    above = seen.join(ranking.select(*by, "item_id", "rank"), [*by, "item_id"]).groupBy(*by, "user_id").agg(F.collect_set("rank").alias("gone"))
    held = relevance.join(ranking.select(*by, "item_id", "rank"), [*by, "item_id"], "left").join(above, [*by, "user_id"], "left")
    ahead = F.coalesce(F.size(F.filter("gone", lambda r: r < F.col("rank"))), F.lit(0))
    out = F.coalesce(F.array_contains("gone", F.col("rank")), F.lit(False))
    return held.withColumn("position", F.when(~out, F.col("rank") - F.when(F.col("gone").isNull(), 0).otherwise(ahead))).drop("gone", "rank")


def user_metrics(found: DataFrame, ks: Sequence[int], *by: str) -> DataFrame:
    """Recall, NDCG, hit rate and precision of each eligible user and k, from (``by``, user_id, item_id, position)."""
    k = F.explode(F.array(*map(F.lit, ks)))
    hit = F.col("position") <= F.col("k")
    per = found.withColumn("k", k).groupBy(*by, "user_id", "k").agg(
        F.count("*").alias("relevant"), F.count_if(hit).alias("hits"), F.coalesce(F.sum(F.when(hit, 1 / F.log2(F.col("position") + 1))), F.lit(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", F.col("relevant").cast("int"))), F.lit(0.0), lambda x, i: x + 1 / F.log2(i + 1))
    return per.select(
        *by, "user_id", "k", "relevant", (F.col("hits") / F.col("relevant")).alias("recall"), (F.col("dcg") / ideal).alias("ndcg"),
        (F.col("hits") > 0).cast("double").alias("hit_rate"), (F.col("hits") / F.col("k")).alias("precision"),
    )


METRICS = ("recall", "ndcg", "hit_rate", "precision")


def macro(per_user: DataFrame, *by: str) -> DataFrame:
    return per_user.groupBy(*by, "k").agg(F.count("*").alias("eligible_users"), *(F.avg(m).alias(m) for m in METRICS))


def top_k(ranking: DataFrame, users: DataFrame, seen: DataFrame | None, k: int) -> DataFrame:
    """(user_id, item_id, position) of each user's first k items of one shared ranking, without seen items.

    Only a user's first k + (own seen items) ranks can appear, so the work is k a user and one row a seen pair.
    """
    held = users.select("user_id").withColumn("n_seen", F.lit(0).cast("long")) if seen is None else with_seen_count(users.select("user_id"), seen)
    ranks = held.select("user_id", F.explode(F.sequence(F.lit(1), (F.col("n_seen") + k).cast("int"))).alias("rank"))
    pairs = ranks.join(ranking.select("item_id", "rank"), "rank")
    if seen is None:
        return pairs.select("user_id", "item_id", F.col("rank").alias("position"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("rank"))
    left = pairs.join(seen, ["user_id", "item_id"], "left_anti")
    return left.withColumn("position", place).where(F.col("position") <= k).select("user_id", "item_id", "position")


def with_seen_count(users: DataFrame, seen: DataFrame) -> DataFrame:
    """``users`` with ``n_seen``, the number of different items each has seen."""
    counts = seen.groupBy("user_id").agg(F.countDistinct("item_id").alias("n_seen"))
    return users.join(counts, "user_id", "left").withColumn("n_seen", F.coalesce("n_seen", F.lit(0).cast("long")))


def top_k_scored(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """First k of each user's own scores (user_id, item_id, score); a partial limit runs before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by, "user_id").orderBy(F.col("score").desc(), "item_id"))
    return scores.withColumn("position", place).where(F.col("position") <= k)


def listed_positions(lists: DataFrame, relevance: DataFrame, *by: str) -> DataFrame:
    """Positions of relevant items in per-user lists; a repeated item counts at its first place."""
    first = lists.groupBy(*by, "user_id", "item_id").agg(F.min("position").alias("position"))
    return relevance.join(first, [*by, "user_id", "item_id"], "left")


def group_by_position(rows: DataFrame, order: Sequence, parts: int, name: str) -> DataFrame:
    """Bucket b of n rows holds places floor(b*n/parts) up to floor((b+1)*n/parts), which is not what ntile deals."""
    held, n = placed(rows, *order)
    return held.withColumn(name, F.floor((parts * (F.col("place") + 1) - 1) / n).cast("int")).drop("place")


class TestOnce:
    """Lets the test split be evaluated a single time."""

    __test__ = False

    def __init__(self) -> None:
        self.used = False

    def __call__(self, found: DataFrame, ks: Sequence[int], *by: str) -> DataFrame:
        if self.used:
            raise RuntimeError("the test split has been evaluated already")
        self.used = True
        return macro(user_metrics(found, ks, *by), *by)
