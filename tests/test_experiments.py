"""Experiments: shared examples, contrasts, selection by validation; packages name queries that exist."""

import pytest
from pyspark.sql import functions as F

from marlpit import cli
from marlpit.operators import dsgd as G
from marlpit.operators import representations as P
from marlpit.plans import experiments as E
from marlpit.plans import registry
from marlpit.plans.dataset import train

SF = "/root/testdata/sf0.001"


def test_packages_and_reports_name_queries():
    known = set(registry.queries())
    for names, small in cli.PACKAGES.values():
        assert set(names) | set(small) <= known
    for names in cli.REPORTS.values():
        assert set(names) <= known


@pytest.mark.parametrize("strategy", E.STRATEGIES)
def test_contrasts(spark, strategy):
    positive, confidence = P.confidence("weighted")
    got = E.contrasts(spark, SF, positive, confidence, strategy)
    facts = train(spark, SF).select("user_id", "item_id", P.signal_state(positive).alias("state"), confidence.alias("c"))
    held = got.join(facts, ["user_id", "item_id"], "left").fillna("none", ["state"])
    n = {(r["label"], r["state"]): r["count"] for r in held.groupBy("label", "state").count().collect()}
    own = facts.where("state = 'positive'").count()
    assert n.pop((1.0, "positive")) == own and sum(n.values()) == 4 * own
    assert (0.0, "positive") not in n and (strategy != "unknown" or (0.0, "observed_non_conversion") not in n)
    assert held.where(F.abs(F.col("weight") - F.when(F.col("label") == 1, F.col("c")).otherwise(1.0)) > 1e-12).count() == 0


def test_runs_share_examples_and_one_is_selected(spark):
    positive, confidence = P.confidence("purchase_only")
    made = []

    def build():
        made.append(1)
        return E.contrasts(spark, SF, positive, confidence, "unknown")

    rows = E.compared(spark, SF, {str(n): (build, G.Config(dim=n, epochs=4)) for n in (2, 4)}, "dim", False).collect()
    assert len(made) == 1 and len(rows) == 2 * len(E.KS)
    size = {r["dim"]: r["parameters"] for r in rows}
    ids = (size["4"] - size["2"]) // 2  # users and items with a vector
    assert 0 < size["2"] - 2 * ids < ids  # and a bias an item
    best = max(rows, key=lambda r: r["validation_ndcg"])["validation_ndcg"]
    chosen = {r["dim"] for r in rows if r["selected"]}
    assert len(chosen) == 1 and {r["validation_ndcg"] for r in rows if r["selected"]} == {best}
