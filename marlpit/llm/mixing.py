"""Mixing sources to target weights as a time-varying curriculum.

Sources share a word budget by weight, none beyond ``max_repeats`` times its size. Within
a source documents lie in hash order, and the mix reads that order round and round until
the source's target is met. A source's weight may change over the training time from 0 to
1: the integral of its schedule says which share of the target is due by then, so the
cumulative words in front of a document, put through the inverse of that integral, give
the time at which it is read. Documents are range-sorted by that time.

Everything is DataFrame expressions. The order of a source is cut by hash into buckets,
so that a source with a third of all rows is still spread over thousands of groups. Only the
shares of sources are worked out in one task, on one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import WORD_JVM

#: Weight and schedule (time, factor) of the first, second and third source by name, and so on in turn:
#: heavy sources fade, light ones grow. A schedule is linear between its points and scaled to the weight.
CYCLE = [(5.0, [(0.0, 1.5), (1.0, 0.5)]), (2.0, [(0.0, 1.0), (1.0, 1.0)]), (1.0, [(0.0, 0.5), (0.5, 0.75), (1.0, 1.75)])]
BUCKET_BITS = 12


def words(text: str = "text") -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_JVM)), F.lit(0)).cast("long")


def _segments(points: list[tuple[float, float]]) -> Column:
    """A schedule as pieces (start, width, factor, rise, share before, share after), the area under it being 1."""
    pieces = [(t0, t1 - t0, f0, f1) for (t0, f0), (t1, f1) in zip(points, points[1:], strict=False)]
    area, total, out = 0.0, sum(w * (f0 + f1) / 2 for _, w, f0, f1 in pieces), []
    for t, w, f0, f1 in pieces:
        after = area + w * (f0 + f1) / 2 / total
        names = ("t", "w", "f", "rise", "before", "after")
        out.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(names, (t, w, f0 / total, (f1 - f0) / total / w, area, after), strict=True))))
        area = after
    return F.array(*out)


def _time_of(share: Column, segments: Column) -> Column:
    """When a schedule's integral reaches ``share``: the root of f*d + rise*d*d/2 = share - before in its piece."""
    piece = F.coalesce(F.get(F.filter(segments, lambda s: s["after"] >= share), F.lit(0)), F.element_at(segments, -1))
    return F.element_at(
        F.transform(F.array(piece), lambda s: F.least(s["t"] + s["w"], s["t"] + 2 * (share - s["before"]) / (s["f"] + F.sqrt(F.greatest(F.lit(0.0), s["f"] * s["f"] + 2 * s["rise"] * (share - s["before"])))))), 1
    )


def targets(sizes: DataFrame, cycle: list = CYCLE, budget: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target, segments) of each row (source, source_size) of a small table with one row a source.

    A source below its cap gets level * weight. Sources leave at their cap in the order of
    cap / weight, so the level follows from running sums in that order.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    pick = lambda values: F.element_at(F.array(*values), (turn + 1).cast("int"))
    rows = sizes.select("source", "source_size", pick([F.lit(float(w)) for w, _ in cycle]).alias("weight"), pick([_segments(p) for _, p in cycle]).alias("segments"))
    rows = rows.withColumn("cap", max_repeats * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (budget * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    fits = rows.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(Window.partitionBy()))
    return fits.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"), "segments")


def mix(docs: DataFrame, cycle: list = CYCLE, budget: float = 1.5, max_repeats: int = 2, whole: bool = False, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (by default the id) as a struct ``row``, and size, source_size, target, taken, draws.

    ``draws`` holds a struct (round, words, position) for each time the mix reads the
    document, in order. By default the read that meets the target is cut there, so a source
    gives its target to the word; with ``whole`` it is read whole if its middle lies before
    the target. ``taken`` is the sum of words read, at most ``max_repeats`` times the size.
    A null text has size 0, a null source is the last source; equal rows share what falls
    to them in some order, which the result doesn't show. Same input, same result.
    """
    kept = F.struct(*(F.col(f"`{c}`") for c in (keep or [id_column])))
    key = F.xxhash64(id_column, text_column)  # rows without an id, or with a common one, are spread by their text
    rows = docs.select(kept.alias("row"), F.col(source_column).alias("source"), words(text_column).alias("size"), key.alias("h"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS)).withColumn("named", F.coalesce("source", F.lit(""))).withColumn("nameless", F.col("source").isNull())
    group = ["named", "nameless", "bucket"]
    buckets = rows.groupBy(*group).agg(F.sum("size").alias("s"), F.first("source").alias("source"))
    sources = targets(buckets.groupBy("named", "nameless").agg(F.sum("s").alias("source_size"), F.first("source").alias("source")).select("source", "source_size"), cycle, budget, max_repeats)
    named = sources.withColumn("named", F.coalesce("source", F.lit(""))).withColumn("nameless", F.col("source").isNull()).drop("source")
    ahead = F.coalesce(F.sum("s").over(Window.partitionBy("named", "nameless").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = buckets.select(*group, ahead.alias("ahead")).join(named, ["named", "nameless"])
    inside = Window.partitionBy(*group).orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(placed, group)
    start, due = F.col("ahead") + F.col("inside"), F.floor(F.col("target") + 0.5)
    draws = []
    for k in range(max_repeats):
        begin = start + k * F.col("source_size")
        if whole:
            read = F.when(begin + F.col("size") / 2 <= F.col("target"), F.col("size"))
        else:
            left = F.least(F.col("size"), due - begin)
            read = F.when(left > 0, left)
        share = F.least(F.lit(1.0), begin / F.greatest(F.lit(1.0), F.col("target")))
        draws.append(F.when(read.isNotNull(), F.struct(F.lit(k).alias("round"), read.cast("long").alias("words"), _time_of(share, F.col("segments")).alias("position"))))
    held = at.withColumn("draws", F.filter(F.array(*draws), lambda d: d.isNotNull()))
    return held.select("row", "source", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda x, d: x + d["words"]).alias("taken"), "draws")


def training_order(mixed: DataFrame) -> DataFrame:
    """A mix by the time of its first read, documents that are never read last."""
    return mixed.withColumn("position", F.get("draws", F.lit(0))["position"]).orderBy(F.col("position").asc_nulls_last(), "row")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix reads, whole, once for each read and in training order, with the columns of ``docs``."""
    reads = mix(docs, whole=True, keep=docs.columns, **options).select("row", F.explode("draws").alias("draw"))
    return reads.orderBy(F.col("draw.position"), F.col("draw.round"), F.xxhash64("row")).select("row.*")
