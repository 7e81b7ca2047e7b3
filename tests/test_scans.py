"""Scans in ranges equal plain windows, and a hot key is in all tasks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.operators import scans as C
from marlpit.operators import sequences as Q

KINDS = ["impression", "view", "favorite", "add_to_cart", "purchase"]
KIND = "event_id long, user_id long, item_id long, ts timestamp_ntz, event_type string"


def events(spark, n=3000, seed=0):
    """Nine of ten rows belong to one user, times repeat, one user is null."""
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        user = 7 if rng.random() < 0.9 else [None, 1, 2, 3][rng.integers(4)]
        rows.append((i, user, int(rng.integers(3)), start + dt.timedelta(hours=int(rng.integers(n))), KINDS[rng.choice(5, p=[0.4, 0.3, 0.1, 0.1, 0.1])]))
    return spark.createDataFrame(rows, KIND).repartition(5)


def bag(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def held(spark):
    return events(spark).cache()


def test_each_scan_equals_its_window(spark, held):
    short = held.withColumn("category", F.col("item_id") % 2)
    plain, spread = (Q.sessionize(short, 120, most).cache() for most in (10**6, 100))
    assert bag(plain) == bag(spread) and plain.agg(F.max("session")).first()[0] > 100
    long = Q.sessionize(short, 24 * 60).cache()  # sessions that reach over many ranges
    for fn in (Q.running_view_count, Q.prior_state_flags, Q.source_views):
        assert bag(fn(held)) == bag(fn(held, most=100)) != []
    for fn in (Q.not_increasing, Q.views_without_impression, Q.continuity):
        assert bag(fn(long)) == bag(fn(long, most=100))
    assert Q.continuity(long, most=100).first()["eligible"] > 500


def test_a_row_at_a_time(held):
    """Against a loop: running number, last view before, largest item so far."""
    folds = dict(n=C.total(F.lit(1), itself=True), seen=C.last(F.when(F.col("event_type") == "view", F.col("event_id"))), top=C.largest(F.col("item_id")))
    got = {r["event_id"]: (r["n"], r["seen"], r["top"]) for r in C.scan(held, ["user_id"], ["ts", "event_id"], 50).fold(**folds).rows().collect()}
    want, state = {}, {}
    for r in sorted(held.collect(), key=lambda r: (r["ts"], r["event_id"])):
        n, seen, top = state.get(r["user_id"], (0, None, None))
        want[r["event_id"]] = (n + 1, seen, top)
        state[r["user_id"]] = (n + 1, r["event_id"] if r["event_type"] == "view" else seen, max(r["item_id"], top if top is not None else -1))
    assert got == want


def test_a_hot_key_is_in_all_tasks(spark, held):
    ready = C.scan(held, ["user_id"], ["ts", "event_id"], 100)
    sizes = [r["n"] for r in ready.hot.groupBy("scan_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 20 and max(sizes) < 400 and ready.hot.where("user_id = 7").select("scan_range").distinct().count() >= 20
    assert {r["user_id"] for r in ready.calm.select("user_id").distinct().collect()}.isdisjoint({7})


def test_null_key_may_be_hot_and_repeats_stay(spark):
    rows = spark.createDataFrame([(i // 2, None if i < 60 else 1, 0, None if i < 10 else dt.datetime(2024, 1, 1), "view") for i in range(70)], KIND)
    got = C.scan(rows, ["user_id"], ["ts", "event_id"], 15).fold(n=C.total(F.lit(1), itself=True)).rows()
    assert sorted(r["n"] for r in got.where("user_id is null").collect()) == list(range(1, 61)) and got.count() == 70


def test_empty_and_extra_columns(spark, held):
    none = Q.sessionize(held.limit(0), most=1)
    assert none.count() == 0 and "session" in none.columns
    odd = held.withColumns({"n": F.lit("x"), "k": F.lit(1), "first": F.lit(2), "a.b": F.lit(3)})
    got = Q.sessionize(odd, most=100)
    assert set(got.columns) == {*odd.columns, "session"} and got.count() == held.count()


def test_more_hot_keys_than_may_be_broadcast(held, monkeypatch):
    monkeypatch.setattr(C, "FEW_KEYS", 1)
    keys, rows = C.hot_keys(held, "user_id", 10)
    assert [r[0] for r in keys.collect()] == [7] and rows > 2500
