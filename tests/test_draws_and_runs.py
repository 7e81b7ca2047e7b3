"""Samples and experiments: what is drawn and read no more than once."""

from pyspark.sql import functions as F

from marlpit.operators import dsgd as G
from marlpit.operators import representations as P
from marlpit.operators import sampling as M
from marlpit.plans import experiments as E
from marlpit.plans import models

SF = "/root/testdata/sf0.001"


def drawn(spark, strategy):
    own = spark.createDataFrame([(u, i) for u in range(1, 9) for i in range(0, 2 * u, 2)] + [(None, 1)], "user_id long, item_id int")
    shown = spark.createDataFrame([(u, i) for u in range(1, 9) for i in range(1, 2 * (u % 4), 2)], "user_id long, item_id int")
    items = spark.createDataFrame([(i,) for i in range(21)], "item_id int")
    return sorted((tuple(r) for r in M.sample(own, shown, items, strategy, 7, strict=False).collect()), key=repr)


def test_few_draws_first_give_the_samples_of_all_draws(spark, monkeypatch):
    for strategy in ("unknown", "exposed", "mixed"):
        got = drawn(spark, strategy)
        monkeypatch.setattr(M, "FIRST_ATTEMPTS", M.ATTEMPTS)
        assert got == drawn(spark, strategy) and len(set(got)) == len(got) > 100
        monkeypatch.undo()


def test_exposed_samples_draw_only_for_positives_that_lack_some(spark, monkeypatch):
    asked = []
    real = M._unknown
    monkeypatch.setattr(M, "_unknown", lambda positives, *rest: asked.append(positives.count()) or real(positives, *rest))
    own = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id long, item_id int")
    shown = spark.createDataFrame([(1, i) for i in range(3, 9)], "user_id long, item_id int")
    assert M.sample(own, shown, spark.createDataFrame([(i,) for i in range(20)], "item_id int"), "exposed").count() == 12
    assert asked == [1]


def test_an_experiment_reads_facts_once_and_runs_equal_those_one_by_one(spark, monkeypatch):
    read = []
    real = models.train
    monkeypatch.setattr(models, "train", lambda s, d: read.append(d) or real(s, d))
    world = models.stored_world(spark, SF)
    runs = {n: ((lambda n=n: E.contrasts(spark, SF, *P.confidence(n), "unknown", world=world)), G.Config(bias="item", epochs=4, dim=2)) for n in ("binary_view", "purchase_only")}
    together = {tuple(r) for r in E.compared(spark, SF, runs, "run", True, world).withColumn("ndcg", F.round("ndcg", 9)).select("run", "k", "ndcg", "parameters", "positive_pairs").collect()}
    assert read == [SF]
    alone = set()
    for n in runs:
        alone |= {tuple(r) for r in E.compared(spark, SF, {n: runs[n]}, "run", True, world).withColumn("ndcg", F.round("ndcg", 9)).select("run", "k", "ndcg", "parameters", "positive_pairs").collect()}
    assert together == alone and len(together) == 2 * len(E.KS)


def test_cart_lists_of_the_evaluation_are_those_of_the_query(spark):
    from marlpit.plans.ranking import topk_of, topk_popularity

    assert {tuple(r) for r in topk_of(*models.stored_world(spark, SF)).collect()} == {tuple(r) for r in topk_popularity(spark, SF).collect()}


def test_columns_of_cells_are_small_and_exact():
    import numpy as np

    rng = np.random.default_rng(9)
    few, many = rng.integers(0, 200, 5000) / 7, rng.normal(size=5000)
    ids, big = rng.integers(-(2**31), 2**31, 5000), rng.integers(-(2**62), 2**62, 5000)
    for x, most in ((few, 7000), (many, 40001), (ids, 20001), (big, 40001), (ids[:0], 1)):
        blob = G._small(x)
        assert len(blob) <= most and (G._whole(blob, "<f8" if x.dtype.kind == "f" else "<i8") == x).all()
