"""Observed-fact dataset: temporal splits, user-item facts, three-state labels, relevance, seen and candidate sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.sources.adapter import SPLITS
from marlpit.operators.selection import with_quantiles
from marlpit.sources.durable import cut

#: Event type and the name of its columns.
KINDS = {"impression": "impression", "view": "view", "favorite": "favorite", "add_to_cart": "cart", "purchase": "purchase"}
TASKS = {"viewplus": ("view",), "favoriteplus": ("favorite", "add_to_cart", "purchase"), "purchase": ("purchase",)}
COUNTS = [f"{n}_count" for n in KINDS.values()]


def between(ts: str | Column, start: str, end: str) -> Column:
    """Half-open window [start, end) of UTC wall-clock times."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def with_split(events: DataFrame, splits: Sequence[tuple[str, str, str]] = SPLITS) -> DataFrame:
    """``events`` with the split of each, null outside all windows."""
    split = F.lit(None).cast("string")
    for name, start, end in reversed(splits):
        split = F.when(between("ts", start, end), name).otherwise(split)
    return events.withColumn("split", split)


def interaction_facts(events: DataFrame, *by: str) -> DataFrame:
    """Counts, first and last times of each event type for each (``by``, user, item), in one hash aggregate."""
    of = {n: F.col("event_type") == kind for kind, n in KINDS.items()}
    return events.groupBy(*by, "user_id", "item_id").agg(
        *(F.count_if(c).alias(f"{n}_count") for n, c in of.items()),
        *(f(F.when(c, F.col("ts"))).alias(f"{w}_{n}_at") for n, c in of.items() for w, f in (("first", F.min), ("last", F.max))),
        F.min("ts").alias("first_interaction_at"), F.max("ts").alias("last_interaction_at"),
    )


def split_facts(events: DataFrame) -> DataFrame:
    """Facts of each split by itself: nothing later can change an earlier one."""
    return interaction_facts(with_split(events).where("split is not null"), "split")


def flags(facts: DataFrame) -> DataFrame:
    names = {"impression": "was_impressed", "view": "was_viewed", "favorite": "was_favorited", "cart": "was_carted", "purchase": "was_purchased"}
    return facts.withColumns({flag: (F.col(f"{n}_count") > 0).cast("int") for n, flag in names.items()})


def favoriteplus() -> Column:
    return (F.col("favorite_count") > 0) | (F.col("cart_count") > 0) | (F.col("purchase_count") > 0)


def is_positive(task: str) -> Column:
    return {"viewplus": F.col("view_count") > 0, "favoriteplus": favoriteplus(), "purchase": F.col("purchase_count") > 0}[task]


def task_state(task: str) -> Column:
    """positive, else observed_non_conversion where the prerequisite was met, else unknown: a zero is never a negative."""
    met = F.col("impression_count" if task == "viewplus" else "view_count") > 0
    return F.when(is_positive(task), "positive").when(met, "observed_non_conversion").otherwise("unknown")


def pair_universe(users: DataFrame, items: DataFrame, max_items: int = 1_000_000) -> DataFrame:
    """All pairs. The item side is broadcast only up to ``max_items`` rows, counted first; beyond that it is shuffled."""
    small = items.limit(max_items + 1).count() <= max_items
    return users.crossJoin(F.broadcast(items) if small else items)


def master_interactions(users: DataFrame, items: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of every pair: zero counts and null times where nothing was observed."""
    held = pair_universe(users, items.select("item_id")).join(facts, ["user_id", "item_id"], "left")
    return flags(held.fillna(0, COUNTS))


def relevance(events: DataFrame, task: str | None = None) -> DataFrame:
    """(split, task, user_id, item_id): items with a positive event, whatever the candidates."""
    kinds = F.array(*(F.struct(F.lit(t).alias("task"), F.lit(k).alias("kind")) for t, ks in TASKS.items() if task in (None, t) for k in ks))
    tasks = F.transform(F.filter(kinds, lambda x: x["kind"] == F.col("event_type")), lambda x: x["task"])
    held = with_split(events).where("split is not null").select("split", F.explode(tasks).alias("task"), "user_id", "item_id")
    return held.distinct()


def train_seen(facts: DataFrame, task: str) -> DataFrame:
    """Same-task train positives (user_id, item_id) from train facts."""
    return facts.where(is_positive(task)).select("user_id", "item_id")


def candidates(items: DataFrame, task: str) -> DataFrame:
    """All items, but for purchases only those available."""
    return items.where("status = 'available'").select("item_id") if task == "purchase" else items.select("item_id")


def impressed(events: DataFrame) -> DataFrame:
    return with_split(events).where("split is not null and event_type = 'impression'").select("split", "user_id", "item_id").distinct()


def as_sets(pairs: DataFrame, *by: str) -> DataFrame:
    """Long pairs as one sorted item array for each key."""
    return pairs.groupBy(*by, "user_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def split_summary(events: DataFrame) -> DataFrame:
    held = with_split(events).where("split is not null")
    return held.groupBy("split").agg(F.count("*").alias("events"), *(F.count_if(F.col("event_type") == k).alias(f"{n}_events") for k, n in KINDS.items()), F.countDistinct("user_id", "item_id").alias("pairs"))


def state_distribution(facts: DataFrame, users: int | Column, items: int | Column) -> DataFrame:
    """(split, task, state, pairs, share) over the whole universe; pairs without facts are added as a number, not as rows."""
    tasks = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), task_state(t).alias("state")) for t in TASKS)))
    seen = facts.select("split", tasks.alias("s")).groupBy("split", "s.task", "s.state").agg(F.count("*").alias("pairs"))
    observed = facts.groupBy("split").agg(F.count("*").alias("observed"))
    grid = observed.select("split", "observed", F.explode(F.array(*map(F.lit, TASKS))).alias("task"), F.array(*map(F.lit, ("positive", "observed_non_conversion", "unknown"))).alias("states")).select("split", "observed", "task", F.explode("states").alias("state"))
    total = (users if isinstance(users, Column) else F.lit(users)) * (items if isinstance(items, Column) else F.lit(items))
    pairs = F.coalesce("pairs", F.lit(0)) + F.when(F.col("state") == "unknown", total - F.col("observed")).otherwise(0)
    return grid.join(seen, ["split", "task", "state"], "left").select("split", "task", "state", pairs.cast("long").alias("pairs"), F.try_divide(pairs, total).alias("share"))


def sparsity(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Positive pairs for each user or item and task of train facts: zero rows counted in, 1 or 2 pairs as cold-ish."""
    tasks = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), is_positive(t).cast("int").alias("hit")) for t in TASKS)))
    per = facts.select(key, tasks.alias("s")).groupBy(key, "s.task").agg(F.sum("s.hit").alias("n"))
    grid = dimension.select(key, F.explode(F.array(*map(F.lit, TASKS))).alias("task"))
    n = F.coalesce("n", F.lit(0)).cast("double")
    held = cut(grid.join(per, [key, "task"], "left").select("task", n.alias("n")))
    stats = held.groupBy("task").agg(
        F.count("*").alias("members"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"),
        F.count_if(F.col("n") == 0).alias("zero"), F.count_if(F.col("n").between(1, 2)).alias("cold_ish"),
    )
    return with_quantiles(stats, held, "n", {"median": 0.5}, "task")


def leakage_audit(facts: DataFrame) -> DataFrame:
    """Purchases of later splits whose pair was or wasn't known in train."""
    later = facts.where("split <> 'train' and purchase_count > 0").select("split", "user_id", "item_id")
    known = facts.where("split = 'train'").select("user_id", "item_id", F.lit(1).alias("known"), (F.col("purchase_count") > 0).cast("int").alias("bought"))
    held = later.join(known, ["user_id", "item_id"], "left")
    return held.groupBy("split").agg(F.count("*").alias("purchase_pairs"), F.count("known").alias("with_train_history"), F.coalesce(F.sum("bought"), F.lit(0)).alias("bought_in_train"))


def id_index(dimension: DataFrame, key: str) -> DataFrame:
    """Dense numbers from 0 in id order."""
    held, _ = placed(dimension.select(key).distinct(), key)
    return held.select(key, F.col("place").alias("idx"))


def placed(rows: DataFrame, *order) -> tuple[DataFrame, int]:
    """``rows`` with their ``place`` from 0 in a total order, and their number."""
    held, total = running(rows.withColumn("place", F.lit(1)), "place", *order)
    return held.withColumn("place", (F.col("upto") - 1).cast("long")).drop("upto"), total


def running(rows: DataFrame, value: str, *order) -> tuple[DataFrame, int]:
    """``rows`` with ``upto``, the sum of a whole-numbered ``value`` up to each row in a total order, and the whole sum.
    No task sorts all: rows are range-partitioned, summed up inside each range, and ranges are offset by those before."""
    held = cut(rows.repartitionByRange(*order).withColumn("range_part", F.spark_partition_id()))
    before = Window.orderBy("range_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("range_part").agg(F.sum(value).alias("own"))  # a row a partition
    ahead = cut(sizes.select("range_part", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("range_ahead")))
    inside = F.sum(value).over(Window.partitionBy("range_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = held.withColumn("upto", inside).join(ahead.drop("own"), "range_part")
    return out.withColumn("upto", F.col("upto") + F.col("range_ahead")).drop("range_part", "range_ahead"), ahead.agg(F.sum("own")).first()[0] or 0
