"""Experiments on trained factorizations: a run each of latent dimensions, sampling strategies, confidences and cart signals.

A run trains on its examples until validation stops it, and its test metrics are taken once. All runs of an experiment share
the evaluation's stored tables; the one with the best validation figure, the first of equal ones, is marked as selected.
None has a SQL statement, as training is no query.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.operators import dsgd as G
from marlpit.operators import mf as MF
from marlpit.operators import ranking as R
from marlpit.operators import representations as P
from marlpit.operators import sampling as M
from marlpit.plans.models import bias_effects, evaluator, purchase_metrics, stored_world
from marlpit.plans.ranking import KS
from marlpit.plans.registry import query
from marlpit.plans.sequences import SEED
from marlpit.sources import adapter as A
from marlpit.sources.durable import cut

DIMENSIONS = (8, 16, 32, 64)
#: Sides whose biases are learned.
LEARNED = {"none": [], "item": ["i"], "user_item": ["u", "i"]}
STRATEGIES = ("unknown", "exposed", "mixed")
#: Runs at the same time; a task of training has up to three blocks and their examples in memory.
TOGETHER = 4


def contrasts(s, d, positive: Column, confidence: Column, strategy: str, exposed_def: str = "impression_no_view", world=None) -> DataFrame:
    """Positives with their confidence as 1 and four drawn pairs each as 0, in the columns of training."""
    held, items, _ = world or stored_world(s, d)
    facts = cut(held.select("user_id", "item_id", P.signal_state(positive, exposed_def).alias("state"), confidence.cast("double").alias("confidence")).where("state <> 'unknown'"))
    own, exposed = facts.where("state = 'positive'"), facts.where("state = 'observed_non_conversion'")
    drawn = M.sample(own, exposed, items.select("item_id"), strategy, SEED)
    told = M.bce_examples(own.select("user_id", "item_id", "confidence"), drawn)
    return cut(told.select("user_id", "item_id", F.lit(None).cast("long").alias("other_id"), F.col("label").cast("double").alias("label"), F.col("confidence").alias("weight")))


def compared(s, d, runs: dict[str, tuple[Callable[[], DataFrame], G.Config]], name: str, biased: bool, world=None) -> DataFrame:
    """A row for each run and k: test metrics, best epoch and its validation figure, positives and their coverage, parameters and
    norms, and with ``biased`` what item biases follow and explain. Up to ``TOGETHER`` runs go on side by side, as an epoch alone has few tasks."""
    world = world or stored_world(s, d)
    positions = evaluator(s, d, world)
    figure = lambda params: purchase_metrics(positions, params, "validation").agg(F.coalesce(F.max("ndcg"), F.lit(0.0))).first()[0]
    builds = list(dict.fromkeys(build for build, _ in runs.values()))  # runs that differ in the model alone share their examples

    def ran(run: str, config: G.Config, examples: DataFrame) -> tuple[DataFrame, float]:
        held = G.fit(examples, config, figure, every=4)
        best = max(held.figures, default=0.0)
        params = cut(held.params)
        about = examples.where("label = 1").agg(F.count("*").alias("positive_pairs"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"))
        biases = params.agg(F.count_if(F.col("kind").isin(LEARNED[config.bias])).alias("biases"))
        size = MF.capacity(params).crossJoin(biases).withColumn("parameters", F.col("parameters") + F.col("biases")).drop("biases")
        row = R.TestOnce()(positions(G.folded(params), "test"), KS).crossJoin(about).crossJoin(size)  # one row each beside the metrics
        if biased:
            row = row.crossJoin(bias_effects(s, d, params, examples, world[0]))
        return cut(row.select(F.lit(run).alias(name), F.lit(held.epoch).alias("epoch"), F.lit(best).alias("validation_ndcg"), *row.columns)), best

    with ThreadPoolExecutor(TOGETHER) as pool:
        start = lambda f, *args: pool.submit(inheritable_thread_target(s)(f), *args)  # noqa: E731  each with properties of its own
        made = {build: start(build) for build in builds}
        made = {build: x.result() for build, x in made.items()}
        rows = [start(ran, run, config, made[build]) for run, (build, config) in runs.items()]
        rows = [x.result() for x in rows]
    best = max(zip(runs, rows, strict=True), key=lambda x: x[1][1])[0]
    return reduce(DataFrame.unionByName, (row for row, _ in rows)).withColumn("selected", F.col(name) == best)


@query("mf_latent_dim")
def mf_latent_dim(s, d):
    """Models with item bias of four dimensions on the combined signal and exposed contrasts."""
    world, (positive, strength) = stored_world(s, d), P.cart_signal("existing_weighted")
    build = lambda: contrasts(s, d, positive, 1 + F.log1p(strength), "exposed", world=world)
    return compared(s, d, {str(n): (build, G.Config(dim=n)) for n in DIMENSIONS}, "dim", True, world)


@query("mf_sampling")
def mf_sampling(s, d):
    """Models without bias on unknown, exposed and mixed contrasts."""
    world, (positive, confidence) = stored_world(s, d), P.confidence("weighted")
    return compared(s, d, {x: ((lambda x=x: contrasts(s, d, positive, confidence, x, world=world)), G.Config(bias="none")) for x in STRATEGIES}, "strategy", False, world)


@query("mf_representation")
def mf_representation(s, d):
    """Models without bias on each way to call pairs positive and weigh them, with unknown contrasts."""
    world = stored_world(s, d)
    runs = {n: ((lambda n=n: contrasts(s, d, *P.confidence(n), "unknown", world=world)), G.Config(bias="none")) for n in P.CONFIDENCES}
    return compared(s, d, runs, "representation", False, world)


@query("mf_signal")
def mf_signal(s, d):
    """Models with item bias on each cart signal; exposed pairs of the deeper ones are those viewed or favorited without a positive."""
    world = stored_world(s, d)

    def build(n):
        positive, strength = P.cart_signal(n)
        shown = "impression_no_view" if n == "existing_weighted" else "signal_relative"
        return lambda: contrasts(s, d, positive, 1 + F.log1p(strength), "exposed", shown, world)

    return compared(s, d, {n: (build(n), G.Config()) for n in P.CART_SIGNALS}, "signal", True, world)
