"""Matrix factorization of implicit feedback by alternating least squares, and the losses of pairwise and pointwise training.

Spark's own ALS solves users and items in turn in blocks of both sides that meet by
shuffle, so neither side nor any user's pairs are ever in one place. Pairs without feedback count
as 0 with confidence 1, which takes the place of drawn samples and of stochastic steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.operators import ranking as R
from marlpit.operators.dataset import id_index
from marlpit.operators.vectors import score_blocks
from marlpit.sources.durable import cut


@dataclass(frozen=True)
class Config:
    dim: int = 16
    iterations: int = 10
    reg: float = 0.05
    confidence: float = 4.0
    seed: int = 42
    #: Blocks of each side. First vectors are drawn by block, so their number is part of a result; a larger world wants more.
    blocks: int = 16


def bce(score: Column, label: Column) -> Column:
    """Log-loss of a logit in its stable form."""
    return F.greatest(score, F.lit(0.0)) - score * label + F.log1p(F.exp(-F.abs(score)))


def bpr(margin: Column) -> Column:
    return F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))


def train(pairs: DataFrame, c: Config = Config()) -> DataFrame:
    """State (kind, id, vec) from positive pairs (user_id, item_id, strength): kind is u or i. Ids may be any numbers; users and items without a pair have no row."""
    users, items = (cut(id_index(pairs, k).withColumnRenamed("idx", n)) for k, n in (("user_id", "u"), ("item_id", "i")))
    coded = pairs.join(users, "user_id").join(items, "item_id").select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("strength").cast("float").alias("r"))
    coded = cut(coded)
    model = ALS(numUserBlocks=c.blocks, numItemBlocks=c.blocks, rank=c.dim, maxIter=c.iterations, regParam=c.reg, alpha=c.confidence, implicitPrefs=True, seed=c.seed, userCol="u", itemCol="i", ratingCol="r").fit(coded)
    side = lambda factors, ids, key, n, kind: factors.join(ids, factors["id"] == ids[n]).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col("features").cast("array<double>").alias("vec"))
    return cut(side(model.userFactors, users, "user_id", "u", "u").unionByName(side(model.itemFactors, items, "item_id", "i", "i")))


def capacity(state: DataFrame) -> DataFrame:
    """(parameters, mean_user_norm, mean_item_norm): norms are over the root of the dimension."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda x, v: x + v * v) / F.size("vec"))
    return state.agg(F.sum(F.size("vec")).alias("parameters"), *(F.avg(F.when(F.col("kind") == k, norm)).alias(n) for k, n in (("u", "mean_user_norm"), ("i", "mean_item_norm"))))


def top_lists(state: DataFrame, candidates: DataFrame, seen: DataFrame, k: int, counts: DataFrame | None = None) -> DataFrame:
    """Each user's best k candidates without seen items. A user keeps as many more of each block as the user has seen;
    ``counts`` are these numbers (user_id, n_seen), if they are there already."""
    users = state.where("kind = 'u'").select(F.col("id").alias("user_id"), "vec")
    items = state.where("kind = 'i'").select(F.col("id").cast(candidates.schema["item_id"].dataType).alias("item_id"), "vec").join(candidates, "item_id", "left_semi")
    users = R.with_seen_count(users, seen) if counts is None else users.join(counts, "user_id", "left").fillna(0, ["n_seen"])
    held = score_blocks(users, items, k, "user_id", "item_id", more="n_seen").join(seen, ["user_id", "item_id"], "left_anti")
    return R.top_k_scored(held, k)


def with_fallback(lists: DataFrame, known: DataFrame, fallback: DataFrame) -> DataFrame:
    """Lists of users with train positives, and the fallback's for cold users."""
    cols = ["user_id", "item_id", "position"]
    return lists.join(known, "user_id", "left_semi").select(cols).unionByName(fallback.join(known, "user_id", "left_anti").select(cols))


def save(state: DataFrame, path: str) -> None:
    """Store a state as a table by kind; ``load`` reads it again."""
    state.write.mode("overwrite").partitionBy("kind").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("kind", "id", "vec")
