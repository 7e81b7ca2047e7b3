"""Catalog operators: listings, nested documents, descriptive statistics, exact decimals, tags, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.functions import scalar as S
from marlpit.operators.representations import describe
from marlpit.operators.selection import decimal_quantile as decimal_percentile  # noqa: F401  a catalog operator by this name


def page(products: DataFrame, order: str, number: int, size: int = 24) -> DataFrame:
    return products.orderBy(order).offset(number * size).limit(size)


def nested_json(products: DataFrame, id: str, attributes: Sequence[str], tags: str, plain: Sequence[str]) -> DataFrame:
    """One JSON document a product: plain fields, attribute object in name order, tag list."""
    attrs = F.struct(*(F.col(a) for a in sorted(attributes)))
    return products.select(id, F.to_json(F.struct(*plain, attrs.alias("attributes"), F.col(tags).alias("tags"))).alias("doc"))


def axis_stats(rows: DataFrame, axes: Sequence[str], *by: str) -> DataFrame:
    """Statistics of several numeric columns in long form."""
    held = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in axes))).alias("x")).select(*by, "x.axis", "x.value")
    return describe(held, "value", *by, "axis")


def boundary_shares(rows: DataFrame, ranges: dict[str, tuple[float, float]], margin: float) -> DataFrame:
    """(axis, low_share, high_share): rows within ``margin`` of the range from either end, in one pass."""
    near = lambda c, lo, hi: (F.avg((F.col(c) <= lo + (hi - lo) * margin).cast("int")), F.avg((F.col(c) >= hi - (hi - lo) * margin).cast("int")))
    one = rows.agg(F.array(*(F.struct(F.lit(c).alias("axis"), *(x.alias(n) for x, n in zip(near(c, *ends), ("low_share", "high_share"), strict=True))) for c, ends in ranges.items())).alias("x"))
    return one.select(F.inline("x"))


def correlations(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns in one pass; 0 where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i + 1 :]]
    one = rows.agg(*(S.correlation(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs))
    held = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    names = F.split("pair", r"\|")
    return held.select(names[0].alias("a"), names[1].alias("b"), "r")


def standardized(rows: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """``rows`` with the population z-score of ``value`` in its group, 0 where the deviation is 0 or unknown: sums by group, ahead of the shuffle, joined back."""
    stats = rows.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    z = F.coalesce(F.try_divide(F.col(value) - F.col("_mean"), F.nullif(F.nanvl(F.col("_std"), F.lit(0.0)), F.lit(0.0))), F.lit(0.0))
    return rows.join(stats, same).select(*rows.columns, z.alias(name))


def tag_counts(rows: DataFrame, tags: Column, vocabulary: DataFrame | None = None) -> DataFrame:
    """Uses of each tag; with a vocabulary (tag) unused ones count 0."""
    held = rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return held if vocabulary is None else vocabulary.join(held, "tag", "left").fillna(0, ["n"])


def upsert_plan(current: DataFrame, incoming: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """(key, action): insert, update, keep, or delete for rows only in ``current``, from one full outer join on the key."""
    a, b = current.select(key, F.struct(*compare).alias("old")), incoming.select(key, F.struct(*compare).alias("new"))
    held = a.join(b, key, "full_outer")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return held.select(key, action.alias("action"))


def guarded_replace(spark, incoming: DataFrame, path: str, key: str, protected: DataFrame | None = None, dry_run: bool = False) -> dict[str, int]:
    """Replace a stored table, but refuse where rows that go are still referred to by ``protected`` (key)."""
    try:
        current = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        current = incoming.limit(0)
    plan = upsert_plan(current, incoming, key, [c for c in incoming.columns if c != key])
    if protected is not None:
        held = plan.where("action = 'delete'").join(protected, key, "left_semi").count()
        if held:
            raise ValueError(f"{held} rows to delete are still in use")
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    if not dry_run:
        fresh, old = (f"{path.rstrip('/')}.{x}" for x in ("next", "old"))
        incoming.write.mode("overwrite").parquet(fresh)
        # two renames: whatever fails, the table or its whole copy under .next or .old is there
        to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        store = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(to(path)):
            store.delete(to(old), True)
            store.rename(to(path), to(old))
        store.rename(to(fresh), to(path))
        store.delete(to(old), True)
    return counts
