"""Splits, facts, states and sets on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlpit.operators import dataset as D

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, item_id int, event_type string, value double"


def rows(spark, *events):
    return spark.createDataFrame([(i, datetime.fromisoformat(t), u, p, k, 0.0) for i, (t, u, p, k) in enumerate(events)], SCHEMA)


def test_windows_are_half_open(spark):
    ev = rows(spark, ("2024-01-01T00:00:00", 1, 1, "view"), ("2024-01-20T23:59:59.999999", 1, 1, "view"), ("2024-01-21T00:00:00", 1, 1, "view"), ("2024-01-26T00:00:00", 1, 1, "view"), ("2024-01-31T00:00:00", 1, 1, "view"))
    assert [r["split"] for r in D.with_split(ev).orderBy("event_id").collect()] == ["train", "train", "validation", "test", None]


def test_facts_count_and_bound_each_type(spark):
    ev = rows(spark, ("2024-01-02T00:00:00", 1, 7, "impression"), ("2024-01-03T00:00:00", 1, 7, "impression"), ("2024-01-03T01:00:00", 1, 7, "view"), ("2024-01-03T02:00:00", 1, 7, "favorite"), ("2024-01-03T03:00:00", 1, 7, "add_to_cart"), ("2024-01-03T04:00:00", 1, 7, "purchase"))
    r = D.split_facts(ev).first()
    assert [r[c] for c in D.COUNTS] == [2, 1, 1, 1, 1]
    assert (r["first_impression_at"], r["last_impression_at"]) == (datetime(2024, 1, 2), datetime(2024, 1, 3))
    assert (r["first_interaction_at"], r["last_interaction_at"]) == (datetime(2024, 1, 2), datetime(2024, 1, 3, 4))


@pytest.mark.parametrize(
    ("counts", "states"),
    [
        ((1, 0, 0, 0, 0), ("observed_non_conversion", "unknown", "unknown")),
        ((0, 1, 0, 0, 0), ("positive", "observed_non_conversion", "observed_non_conversion")),
        ((0, 0, 0, 1, 0), ("unknown", "positive", "unknown")),
        ((0, 0, 0, 0, 1), ("unknown", "positive", "positive")),
        ((0, 0, 0, 0, 0), ("unknown", "unknown", "unknown")),
    ],
)
def test_three_states(spark, counts, states):
    df = spark.createDataFrame([counts], ", ".join(f"{c} long" for c in D.COUNTS))
    assert tuple(df.select(*(D.task_state(t).alias(t) for t in D.TASKS)).first()) == states


def test_later_events_never_change_train(spark):
    old = [("2024-01-02T00:00:00", 1, 7, "view")]
    new = [*old, ("2024-01-27T00:00:00", 1, 7, "purchase")]
    train = lambda e: D.split_facts(rows(spark, *e)).where("split = 'train'").collect()
    assert train(old) == train(new)
    assert D.relevance(rows(spark, *new), "purchase").where("split = 'test'").count() == 1


def test_universe_has_zero_rows_and_null_times(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    items = spark.createDataFrame([(7, "available"), (8, "sold_out")], "item_id int, status string")
    facts = D.interaction_facts(rows(spark, ("2024-01-02T00:00:00", 1, 7, "view")))
    out = D.master_interactions(users, items, facts)
    assert out.count() == 4
    empty = out.where("user_id = 2 and item_id = 8").first()
    assert empty["view_count"] == 0 and empty["was_viewed"] == 0 and empty["first_view_at"] is None
    assert [r[0] for r in D.candidates(items, "purchase").collect()] == [7]
    assert D.candidates(items, "viewplus").count() == 2


def test_state_distribution_counts_unseen_pairs_without_rows(spark):
    facts = D.split_facts(rows(spark, ("2024-01-02T00:00:00", 1, 7, "impression"), ("2024-01-02T00:00:00", 1, 8, "view")))
    got = {(r["task"], r["state"]): r["pairs"] for r in D.state_distribution(facts, 3, 4).where("split = 'train'").collect()}
    assert got["viewplus", "positive"] == 1 and got["viewplus", "observed_non_conversion"] == 1 and got["viewplus", "unknown"] == 10


def test_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(x,) for x in (30, 10, 20, 10)], "k long")
    assert {r["k"]: r["idx"] for r in D.id_index(df, "k").collect()} == {10: 0, 20: 1, 30: 2}


def test_empty_events(spark):
    ev = spark.createDataFrame([], SCHEMA)
    assert D.split_facts(ev).count() == 0 and D.relevance(ev).count() == 0
    assert D.split_summary(ev).agg(F.count("*")).first()[0] == 0
