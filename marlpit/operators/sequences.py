"""Ordered-sequence operators over event logs: running states, funnels, paths, continuity, concentration, separability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.operators.dataset import running
from marlpit.operators.sampling import gini
from marlpit.operators.scans import MOST, largest, last, scan, total
from marlpit.operators.selection import select, with_quantiles
from marlpit.sources.durable import cut

ENGAGEMENTS = ("favorite", "add_to_cart", "purchase")


def kind(*names: str) -> Column:
    return F.col("event_type").isin(*names)


def sessionize(events: DataFrame, gap_minutes: int = 24 * 60, most: int = MOST) -> DataFrame:
    """``events`` with the ordinal of the user's session: a new one starts after a gap. Users of more than ``most`` events are scanned in ranges."""
    held = scan(events, ["user_id"], ["ts", "event_id"], most).fold(before=last(F.struct("ts")))
    gap = F.col("ts") > F.col("before.ts") + F.expr(f"INTERVAL {gap_minutes} MINUTES")
    new = F.when(F.col("before.ts").isNull() | gap, 1).otherwise(0)
    return held.add(new=new).fold(session=total(F.col("new"), itself=True)).rows().drop("new", "before")


def sessions(events: DataFrame) -> DataFrame:
    """(user_id, session, started_at, ended_at, events, impressions, duration_seconds) of sessionized events."""
    held = events.groupBy("user_id", "session").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("events"), F.count_if(kind("impression")).alias("impressions"))
    return held.withColumn("duration_seconds", F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at")))


def running_view_count(events: DataFrame, most: int = MOST) -> DataFrame:
    held = scan(events.where(kind("view")), ["user_id", "item_id"], ["ts", "event_id"], most).fold(views=total(F.lit(1), itself=True)).rows()
    return held.select("event_id", "user_id", "item_id", F.col("views").cast("int").alias("view_count"))


def prior_state_flags(events: DataFrame, most: int = MOST) -> DataFrame:
    """Whether the pair had a favorite or a cart before each engagement."""
    had = lambda name: largest(kind(name).cast("int"))
    held = scan(events, ["user_id", "item_id"], ["ts", "event_id"], most).fold(had_favorite=had("favorite"), had_cart=had("add_to_cart"), views_before=total(kind("view").cast("int")))
    return held.rows().where(kind(*ENGAGEMENTS)).withColumns({n: F.coalesce(n, F.lit(0)) for n in ("had_favorite", "had_cart")})


def not_increasing(events: DataFrame, most: int = MOST) -> DataFrame:
    """Events of a session whose time isn't after the one before."""
    held = scan(events, ["user_id", "session"], ["ts", "event_id"], most).fold(before=last(F.struct("ts"))).rows()
    return held.withColumn("before", F.col("before.ts")).where("ts <= before")


def views_without_impression(events: DataFrame, most: int = MOST) -> DataFrame:
    """Views whose item was not shown before in the same session."""
    shown = largest(kind("impression").cast("int"), itself=True)
    return scan(events, ["user_id", "session", "item_id"], ["ts", "event_id"], most).fold(shown=shown).rows().where(kind("view") & (F.col("shown") == 0))


def continuity(events: DataFrame, category: str = "category", most: int = MOST) -> DataFrame:
    """Impressions after a view of the session, and the share that shows the last viewed category."""
    held = scan(events, ["user_id", "session"], ["ts", "event_id"], most).fold(last=last(F.when(kind("view"), F.col(category)))).rows()
    held = held.where(kind("impression") & F.col("last").isNotNull())
    return held.agg(F.count("*").alias("eligible"), F.avg((F.col(category) == F.col("last")).cast("double")).alias("same_share"))


def future_sessions(views: DataFrame, starts: DataFrame, days: int = 7) -> DataFrame:
    """Each view's later sessions of the same user within ``days``. Both sides are cut into spans of that length: a
    session is in its view's span or the next one, so a user's views don't meet all of the user's sessions."""
    span = lambda t: F.floor(F.unix_seconds(F.col(t).cast("timestamp")) / (86400 * days))
    held = views.withColumn("span", F.explode(F.array(span("ts"), span("ts") + 1))).alias("v")
    later = starts.withColumn("span", span("started_at")).alias("s")
    met = held.join(later, (F.col("v.user_id") == F.col("s.user_id")) & (F.col("v.span") == F.col("s.span")))
    near = (F.col("s.started_at") > F.col("v.ts")) & (F.col("s.started_at") <= F.col("v.ts") + F.expr(f"INTERVAL {days} DAYS"))
    return met.where(near).groupBy("v.event_id").agg(F.count("*").alias("future_sessions"), F.min("s.session").alias("next_session"))


def source_views(events: DataFrame, most: int = MOST) -> DataFrame:
    """As-of form: the last strictly earlier view of the pair for each engagement, in one scan."""
    # at one time views come last, so what is before an engagement is earlier
    held = scan(events.withColumn("is_view", kind("view").cast("int")), ["user_id", "item_id"], ["ts", "is_view", "event_id"], most)
    held = held.fold(v=last(F.when(kind("view"), F.col("event_id")))).rows()
    return held.where(kind(*ENGAGEMENTS)).select("event_id", "event_type", "user_id", "item_id", F.col("v").alias("source_view"))


def funnel(events: DataFrame) -> DataFrame:
    """Step totals and seven conversion rates; the last three are shares of pairs."""
    pairs = events.groupBy("user_id", "item_id").agg(*(F.count_if(kind(k)).alias(k) for k in ("impression", "view", *ENGAGEMENTS)))
    has = {k: F.col(k) > 0 for k in ENGAGEMENTS}
    t = pairs.agg(
        *(F.sum(k).alias(k) for k in ("impression", "view", *ENGAGEMENTS)), F.count_if(has["favorite"]).alias("fav"), F.count_if(has["add_to_cart"]).alias("cart"),
        F.count_if(has["favorite"] & has["add_to_cart"]).alias("fav_cart"), F.count_if(has["favorite"] & has["purchase"]).alias("fav_buy"), F.count_if(has["add_to_cart"] & has["purchase"]).alias("cart_buy"),
    )
    rate = lambda a, b, name: F.try_divide(F.col(a), F.col(b)).alias(name)
    return t.select(
        F.col("impression").alias("impressions"), F.col("view").alias("views"), F.col("favorite").alias("favorites"), F.col("add_to_cart").alias("carts"), F.col("purchase").alias("purchases"),
        rate("view", "impression", "impression_to_view"), rate("favorite", "view", "view_to_favorite"), rate("add_to_cart", "view", "view_to_cart"), rate("purchase", "view", "view_to_purchase"),
        rate("fav_cart", "fav", "favorite_to_cart"), rate("fav_buy", "fav", "favorite_to_purchase"), rate("cart_buy", "cart", "cart_to_purchase"),
    )


def paths(events: DataFrame) -> DataFrame:
    """Histogram of viewed pairs' engagement paths in time order."""
    steps = F.array_sort(F.collect_list(F.when(kind(*ENGAGEMENTS), F.struct("ts", "event_id", "event_type"))))
    held = events.groupBy("user_id", "item_id").agg(F.max(kind("view")).alias("viewed"), F.transform(steps, lambda x: x["event_type"]).alias("steps")).where("viewed")
    path = F.concat(F.lit("view → "), F.when(F.size("steps") == 0, "exit").otherwise(F.array_join("steps", " → ")))
    return held.groupBy(path.alias("path")).agg(F.count("*").alias("pairs"))


def view_rates(events: DataFrame, *keys: str) -> DataFrame:
    """Impressions, views and their rate for each of several keys by itself, in one pass of grouping sets."""
    held = events.where(kind("impression", "view")).groupingSets([[k] for k in keys], *keys).agg(F.count_if(kind("impression")).alias("impressions"), F.count_if(kind("view")).alias("views"), *(F.grouping(k).alias(f"g_{k}") for k in keys))
    name = F.coalesce(*(F.when(F.col(f"g_{k}") == 0, k) for k in keys))
    value = F.coalesce(*(F.when(F.col(f"g_{k}") == 0, F.col(k).cast("string")) for k in keys))
    return held.select(name.alias("key"), value.alias("value"), "impressions", "views", F.try_divide("views", "impressions").alias("view_rate")).where("impressions > 0")


def concentration(events: DataFrame, items: int) -> DataFrame:
    """Gini over items that occur, the ten largest items' share, items without any, smallest, median and largest count."""
    per = cut(events.groupBy("item_id").agg(F.count("*").alias("c")))
    top = per.orderBy(F.col("c").desc()).limit(10).agg(F.sum("c").alias("top"))
    held = per.agg(F.count("*").alias("n"), F.sum("c").alias("total"), F.min("c").alias("minimum"), F.max("c").alias("maximum"))
    held = with_quantiles(held, per, "c", {"median": 0.5})
    return held.crossJoin(gini(per, "c")).crossJoin(top).select(  # one row each
        F.when(F.col("n") > 0, F.col("gini")).alias("gini"), F.try_divide("top", "total").alias("top10_share"), (items - F.col("n")).alias("zero_items"), "minimum", "median", "maximum",
    )


def mid_ranked(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the rank of a ``value`` that is never null, from 1, averaged over ties."""
    per, _ = running(rows.groupBy(value).agg(F.count("*").alias("own")), "own", value)
    return rows.join(per.select(value, (F.col("upto") - (F.col("own") - 1) / 2).alias(name)), value)


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Probability that a positive scores above a negative, ties half; 0.5 if a class is empty."""
    per = rows.groupBy(score).agg(F.count_if(label).alias("p"), F.count("*").alias("all"))  # a row a different score
    ranked, _ = running(per, "all", score)
    rank = F.col("upto") - (F.col("all") - 1) / 2
    held = ranked.agg(F.sum(F.col("p") * rank).alias("s"), F.sum("p").cast("double").alias("p"), F.sum(F.col("all") - F.col("p")).cast("double").alias("n"))
    p, n = F.col("p"), F.col("n")
    return held.select(F.when((F.coalesce(p, F.lit(0.0)) == 0) | (F.coalesce(n, F.lit(0.0)) == 0), 0.5).otherwise((F.col("s") - p * (p + 1) / 2) / (p * n)).alias("auc"))


def best_threshold(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Accuracy of predicting positive above the best threshold; calling all positive is the first candidate, earlier ones win ties."""
    per = rows.groupBy(score).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("n"))
    held, _ = running(per.withColumn("gain", F.col("n") - F.col("p")), "gain", score)
    best = F.max_by(F.struct(F.col(score).alias("threshold"), "upto"), F.struct("upto", -F.col(score))).alias("best")
    sums = held.agg(F.min(score).alias("first"), F.sum("p").alias("positives"), F.sum(F.col("p") + F.col("n")).alias("total"), best)
    ends = sums.withColumn("best", F.struct("best.threshold", (F.col("positives") + F.col("best.upto")).alias("correct")))
    take = F.col("best.correct") > F.col("positives")
    return ends.select(F.when(take, F.col("best.threshold")).otherwise(F.col("first")).alias("threshold"), (F.when(take, F.col("best.correct")).otherwise(F.col("positives")) / F.nullif("total", F.lit(0))).alias("accuracy"))


def quartile_thresholds(rows: DataFrame, value: str) -> DataFrame:
    """Order statistics at n // 4 and 3n // 4 of the sorted values, not interpolated."""
    held = cut(rows.select(F.struct(F.lit(0).alias("all")).alias("key"), F.col(value).alias("v")).where("v is not null"))
    wanted = held.groupBy("key").agg(F.count("*").alias("n")).select("key", F.explode(F.array(F.expr("n div 4"), F.expr("3 * n div 4"))).alias("rank"), "n")
    found = select(held, wanted).join(wanted, ["key", "rank"])
    at = lambda k: F.max(F.when(F.col("rank") == F.expr(f"{k} * n div 4"), F.col("v")))
    return found.agg(at(1).alias("low"), at(3).alias("high"))
