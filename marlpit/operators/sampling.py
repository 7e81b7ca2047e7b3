"""Reproducible non-positive sampling by drawn indices.

A pool that exists as rows (exposed pairs) is numbered by user in a hash order, and a
positive takes as many consecutive places as it wants, from a hashed start on. The pool of
unknown pairs is the rest of the universe and never built: item numbers are drawn by hashes
of seed, user, positive and attempt, and drawn items that are known are rejected. Users for
whom ``ATTEMPTS`` draws are too few know nearly all items, so the rest of theirs is small
enough to be numbered like an exposed pool. Work grows with positives and facts, not with
positives times items. A draw depends on no other positive, so it is the same in any engine
and partitioning. A sampled pair is a contrast, never a true negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.operators.dataset import id_index
from marlpit.operators.selection import with_quantiles
from marlpit.sources.durable import cut

RATIO = 4
#: Draws from the universe for each positive.
ATTEMPTS = 16
#: Draws that are enough for most positives; the others draw all.
FIRST_ATTEMPTS = 7


def hashed(*parts) -> Column:
    """60 bits of a hash of the parts as a number; any engine with MD5 gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _places(positives: DataFrame, pool: DataFrame, seed: int, n: int) -> DataFrame:
    """(user_id, item_id, sampled, t): ``n`` consecutive places of the user's pool in its hash order, round its end, or the whole pool if that is less."""
    order = Window.partitionBy("user_id").orderBy(hashed(F.lit(seed), "user_id", "sampled"), "sampled")
    numbered = pool.select("user_id", F.col("item_id").alias("sampled")).withColumn("slot", (F.row_number().over(order) - 1).cast("long"))
    numbered = cut(numbered)
    sizes = numbered.groupBy("user_id").agg(F.count("*").alias("m"))
    t = F.explode(F.sequence(F.lit(0), (F.least(F.lit(n), "m") - 1).cast("int")))
    wanted = positives.join(sizes, "user_id").select("user_id", "item_id", "m", t.alias("t"))
    wanted = wanted.withColumn("slot", F.pmod(hashed(F.lit(seed), "user_id", "item_id") + F.col("t"), F.col("m")))
    return wanted.join(numbered, ["user_id", "slot"]).select("user_id", "item_id", "sampled", "t")


def _first_unknown(positives: DataFrame, known: DataFrame, numbered: DataFrame, total: int, seed: int, n: int, attempts: int) -> DataFrame:
    """(user_id, item_id, found): the first ``n`` different unknown items in ``attempts`` draws of each positive that has any."""
    tries = positives.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    drawn = tries.withColumn("idx", F.pmod(hashed(F.lit(seed), "user_id", "item_id", "t"), F.lit(total))).join(numbered, "idx")
    left = drawn.join(known, ["user_id", "sampled"], "left_anti").groupBy("user_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("t", "sampled"))).alias("draws"))
    return left.select("user_id", "item_id", F.slice(F.array_distinct("draws.sampled"), 1, n).alias("found"))


def _unknown(positives: DataFrame, known: DataFrame, items: DataFrame, seed: int, n: int) -> DataFrame:
    """(user_id, item_id, sampled, r): the first ``n`` different unknown items of each positive, in the order of draws."""
    numbered = cut(id_index(items, "item_id").select("idx", F.col("item_id").alias("sampled")))
    total = numbered.count()
    known = known.select("user_id", F.col("item_id").alias("sampled")).distinct()
    if not total:
        return positives.select("user_id", "item_id", F.col("item_id").alias("sampled"), F.lit(0).alias("r")).limit(0)
    few = cut(_first_unknown(positives, known, numbered, total, seed, n, min(FIRST_ATTEMPTS, ATTEMPTS)))
    done = few.where((F.size("found") >= n) & F.col("user_id").isNotNull() & F.col("item_id").isNotNull())  # null ids meet nothing below
    # the others draw all of theirs, which leaves the first ones where they are
    held = done.unionByName(cut(_first_unknown(positives.join(done, ["user_id", "item_id"], "left_anti"), known, numbered, total, seed, n, ATTEMPTS)))
    got = held.select("user_id", "item_id", F.posexplode("found").alias("r", "sampled")).withColumn("r", F.col("r") + 1)
    counts = held.select("user_id", "item_id", F.size("found").alias("got"))
    short = cut(positives.join(counts, ["user_id", "item_id"], "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col("got") < n))
    if not short.limit(1).count():
        return got.select("user_id", "item_id", "sampled", "r")
    rest = short.select("user_id").distinct().crossJoin(items.select("item_id")).join(known.withColumnRenamed("sampled", "item_id"), ["user_id", "item_id"], "left_anti")
    more = _places(short.select("user_id", "item_id"), rest, seed, 2 * n).join(got.select("user_id", "item_id", "sampled"), ["user_id", "item_id", "sampled"], "left_anti")
    placed = more.withColumn("r", F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy("t"))).join(short, ["user_id", "item_id"])
    filled = placed.withColumn("r", F.col("r") + F.col("got")).where(F.col("r") <= n)
    return got.select("user_id", "item_id", "sampled", "r").unionByName(filled.select("user_id", "item_id", "sampled", F.col("r").cast("int").alias("r")))


def sample(positives: DataFrame, exposed: DataFrame, items: DataFrame, strategy: str, seed: int = 42, ratio: int = RATIO, strict: bool = True) -> DataFrame:
    """(user_id, item_id, sampled, source, is_backfill): ``ratio`` different pairs for each positive.

    ``unknown`` takes all from pairs that are neither positive nor exposed. ``exposed`` prefers
    exposed non-conversions, ``mixed`` wants half of each; what the exposed pool lacks comes
    from unknown pairs as backfill. With ``strict`` a pool too small for a positive raises.
    """
    wanted = {"unknown": 0, "exposed": ratio, "mixed": ratio // 2}[strategy]
    positives = cut(positives.select("user_id", "item_id"))
    known = positives.unionByName(exposed.select("user_id", "item_id"))
    if not wanted:
        rest = _unknown(positives, known, items, seed, ratio)
        out = rest.select("user_id", "item_id", "sampled", F.lit("random_unknown").alias("source"), F.lit(False).alias("is_backfill"))
    else:
        shown = cut(_places(positives, exposed, seed, wanted))
        got = shown.groupBy("user_id", "item_id").agg(F.count("*").alias("got"))
        lacking = cut(positives.join(got, ["user_id", "item_id"], "left").fillna(0, ["got"]).where(F.col("got") < ratio))
        rest = _unknown(lacking.select("user_id", "item_id"), known, items, seed, ratio)  # a draw depends on no other positive
        held = rest.join(got, ["user_id", "item_id"], "left").fillna(0, ["got"]).where(F.col("r") <= ratio - F.col("got"))
        backfill = F.col("r") > ratio - wanted
        out = shown.select("user_id", "item_id", "sampled", F.lit("exposed_non_conversion").alias("source"), F.lit(False).alias("is_backfill")).unionByName(
            held.select("user_id", "item_id", "sampled", F.lit("random_unknown").alias("source"), backfill.alias("is_backfill"))
        )
    out = cut(out)
    if strict:
        short = positives.join(out.groupBy("user_id", "item_id").count(), ["user_id", "item_id"], "left").where(F.coalesce("count", F.lit(0)) < ratio)
        if short.limit(1).count():
            raise ValueError("a user's pool is too small for the sampling ratio")
    return out


def gini(values: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of a column's positive total, 0 for none."""
    per = values.groupBy(value).agg(F.count("*").alias("m"))  # a row a different value
    last = F.sum("m").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))  # place of its last one
    places = F.col("m") * (2 * F.col("last") - F.col("m") + 1) / 2
    held = per.withColumn("last", last).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col(value)).alias("total"), F.sum(places * F.col(value)).alias("weighted"))
    return held.select(F.when(F.coalesce("total", F.lit(0)) == 0, 0.0).otherwise((2 * F.col("weighted") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))).alias("gini"))


def sampling_stats(samples: DataFrame, items: int, ratio: int = RATIO) -> DataFrame:
    per_item = samples.groupBy("sampled").agg(F.count("*").alias("c"))
    top = per_item.orderBy(F.col("c").desc(), "sampled").limit(10).agg(F.sum("c").alias("top"))
    head = samples.agg(
        F.count("*").alias("total"), F.countDistinct("user_id", "sampled").alias("unique_pairs"), F.count_if(F.col("source") == "random_unknown").alias("random_unknown"),
        F.count_if(F.col("source") == "exposed_non_conversion").alias("exposed"), F.count_if("is_backfill").alias("backfill"), F.countDistinct("user_id").alias("users"), F.countDistinct("sampled").alias("items"),
    )
    total = F.col("total")
    return head.crossJoin(gini(per_item, "c")).crossJoin(top).select(
        "total", "unique_pairs", "random_unknown", "exposed", F.try_divide("exposed", total).alias("exposed_share"), "backfill", F.try_divide("backfill", total).alias("backfill_rate"), "users", "items",
        (items - F.col("items")).alias("never_sampled"), "gini", F.try_divide("top", total).alias("top10_share"),
    )


def hardness(samples: DataFrame, item_counts: DataFrame) -> DataFrame:
    """Popularity and exposure of sampled items by source and over all."""
    held = samples.join(item_counts.withColumnRenamed("item_id", "sampled"), "sampled")
    both = cut(held.select(F.explode(F.array("source", F.lit("all"))).alias("source"), "carts", "exposures"))
    out = both.groupBy("source").agg(
        F.count("*").alias("n"), F.avg("carts").alias("mean_cart"), F.stddev_pop("carts").alias("std_cart"), F.avg("exposures").alias("mean_exposure"), F.stddev_pop("exposures").alias("std_exposure"),
    )
    out = with_quantiles(out, both, "carts", {"median_cart": 0.5}, "source")
    return with_quantiles(out, both, "exposures", {"median_exposure": 0.5}, "source")


def bce_examples(positives: DataFrame, samples: DataFrame) -> DataFrame:
    """Positives once with label 1 and their confidence, sampled pairs as 0 with confidence 1."""
    return positives.select("user_id", "item_id", F.lit(1).alias("label"), "confidence").unionByName(samples.select("user_id", F.col("sampled").alias("item_id"), F.lit(0).alias("label"), F.lit(1.0).alias("confidence")))
