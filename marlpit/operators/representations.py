"""Interaction representations, confidences, cart signals and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.operators.dataset import favoriteplus, placed
from marlpit.operators.ranking import Weights
from marlpit.operators.selection import with_quantiles
from marlpit.sources.durable import cut

REPRESENTATIONS = ("binary_viewplus", "view_count", "log_view", "favoriteplus", "binary_purchase", "weighted")
CONFIDENCES = ("binary_view", "log_view", "weighted", "favoriteplus", "purchase_only")
CART_SIGNALS = ("existing_weighted", "cartplus", "favorite_cartplus", "cart_centered_weighted")


def _has(n: str) -> Column:
    return (F.col(f"{n}_count") > 0).cast("double")


def representation(name: str, weights: Weights = Weights()) -> Column:
    return {
        "binary_viewplus": _has("view"), "view_count": F.col("view_count").cast("double"), "log_view": F.log1p("view_count"),
        "favoriteplus": favoriteplus().cast("double"), "binary_purchase": _has("purchase"), "weighted": weights.strength(),
    }[name]


def confidence(name: str) -> tuple[Column, Column]:
    """Which pairs are positive, and their confidence; sampled pairs get 1."""
    view = F.col("view_count") > 0
    one = F.lit(1.0)
    return {
        "binary_view": (view, one), "log_view": (view, 1 + F.log1p("view_count")), "weighted": (view, 1 + F.log1p(Weights().strength())),
        "favoriteplus": (favoriteplus(), one), "purchase_only": (F.col("purchase_count") > 0, one),
    }[name]


def cart_signal(name: str) -> tuple[Column, Column]:
    """Which pairs a cart-centred signal calls positive, and its strength."""
    view, deep = F.col("view_count") > 0, (F.col("cart_count") > 0) | (F.col("purchase_count") > 0)
    return {
        "existing_weighted": (view, Weights().strength()), "cartplus": (deep, 5 * _has("cart") + 8 * _has("purchase")),
        "favorite_cartplus": (favoriteplus(), 3 * _has("favorite") + 5 * _has("cart") + 8 * _has("purchase")),
        "cart_centered_weighted": (view, 0.5 * F.log1p("view_count") + 2 * _has("favorite") + 6 * _has("cart") + 10 * _has("purchase")),
    }[name]


def signal_state(positive: Column, exposed_def: str = "impression_no_view") -> Column:
    """Pool of a pair that isn't positive. ``impression_no_view`` calls impressed pairs without a
    view exposed; ``signal_relative`` those viewed or favorited without the signal's action."""
    exposed = {
        "impression_no_view": (F.col("impression_count") > 0) & (F.col("view_count") == 0),
        "signal_relative": (F.col("view_count") > 0) | (F.col("favorite_count") > 0),
    }[exposed_def]
    return F.when(positive, "positive").when(exposed, "observed_non_conversion").otherwise("unknown")


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, population deviation and linear quantiles."""
    rows = cut(rows.select(*by, value))  # read again by each pass of the selection
    held = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    told = with_quantiles(held, rows, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}, *by)
    return told.select(*by, "n", "mean", "std", "min", "p25", "median", "p75", "max")


def long_values(facts: DataFrame, columns: dict[str, Column], name: str, value: str = "value") -> DataFrame:
    held = F.explode(F.array(*(F.struct(F.lit(n).alias(name), c.cast("double").alias(value)) for n, c in columns.items())))
    return facts.select("user_id", "item_id", held.alias("v")).select("user_id", "item_id", f"v.{name}", f"v.{value}")


def representation_stats(facts: DataFrame, universe: int) -> DataFrame:
    """Statistics of the positive values of each representation; density over all pairs."""
    held = long_values(facts, {n: representation(n) for n in REPRESENTATIONS}, "representation").where("value > 0")
    return describe(held, "value", "representation").withColumn("density", F.try_divide("n", F.lit(universe)))


def activity(facts: DataFrame, users: DataFrame) -> DataFrame:
    held = facts.groupBy("user_id").agg(F.sum("view_count").cast("double").alias("raw"), F.sum(F.log1p("view_count")).alias("log"))
    return users.select("user_id").join(held, "user_id", "left").fillna(0.0, ["raw", "log"])


def heavy_users(active: DataFrame) -> DataFrame:
    """Shares of the top 1 percent of users, at least one, by raw views."""
    held, n = placed(active, F.col("raw").desc(), F.col("user_id"))
    keep = F.col("place") < max(1, -(-n // 100))
    share = lambda c: F.try_divide(F.sum(F.when(keep, F.col(c))), F.sum(c))
    return held.agg(F.count("*").alias("users"), F.count_if(keep).alias("top_users"), share("raw").alias("raw_share"), share("log").alias("log_share"), F.max("raw").alias("max_raw"), F.max("log").alias("max_log"))


def signal_overlap(facts: DataFrame) -> DataFrame:
    view, fav, buy = F.col("view_count") > 0, favoriteplus(), F.col("purchase_count") > 0
    return facts.agg(
        F.count_if(view).alias("view_pairs"), F.count_if(fav).alias("favoriteplus_pairs"), F.count_if(buy).alias("purchase_pairs"), F.count_if(fav & ~view).alias("favoriteplus_outside_view"),
        F.count_if(buy & ~view).alias("purchase_outside_view"), F.count_if(buy & ~fav).alias("purchase_outside_favoriteplus"),
        F.max("favorite_count").alias("max_favorite"), F.max("cart_count").alias("max_cart"), F.max("purchase_count").alias("max_purchase"),
    )


def coverage(positives: DataFrame, users: int, items: int, *by: str) -> DataFrame:
    held = positives.groupBy(*by).agg(F.count("*").alias("positive_pairs"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"))
    return held.withColumns({"cold_users": users - F.col("users"), "cold_items": items - F.col("items"), "density": F.try_divide("positive_pairs", F.lit(users * items))})
