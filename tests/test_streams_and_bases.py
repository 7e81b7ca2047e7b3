"""Streams over several batches, and rates whose base is zero or null."""

import datetime as dt
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from marlpit.operators import sampling, sequences, vectors
from marlpit.plans import registry
from marlpit.sources.snapshots import SnapshotTable
from marlpit.streaming import incremental as T

DAY = dt.datetime(2024, 1, 1)


def files(spark, path, batches):
    """Event files that arrive one a batch: (event_id, day, user, type, item)."""
    for n, rows in enumerate(batches):
        told = [(i, DAY + dt.timedelta(days=day), user, kind, 1.0, f'{{"k": {item}}}') for i, day, user, kind, item in rows]
        spark.createDataFrame(told, T.RAW).coalesce(1).write.mode("append").parquet(f"{path}/part{n}")
    os.makedirs(f"{path}/in", exist_ok=True)
    for n in range(len(batches)):
        (one,) = glob.glob(f"{path}/part{n}/*.parquet")
        shutil.move(one, f"{path}/in/{n}-events.parquet")
        os.utime(f"{path}/in/{n}-events.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return f"{path}/in"


def test_funnel_over_batches_with_long_gaps_equals_the_batch_form(spark, tmp_path):
    raw = {"view": "view", "click": "favorite", "signup": "add_to_cart", "purchase": "purchase"}
    batches = [
        [(1, 0, 1, "purchase", 5), (2, 0, 2, "view", 5), (3, 0, 3, "error", 5)],
        [(4, 12, 2, "signup", 5), (5, 12, 9, "view", 1), (6, 13, 9, "click", 1)],
        [(7, 24, 1, "view", 5), (8, 24, 2, "view", 5), (9, 25, 3, "view", 5)],
    ]
    where = files(spark, str(tmp_path), batches)
    run = lambda: T.drain(T.funnel_state(T.read_events(spark, where, "*.parquet", files=1)), "update", ["user_id", "item_id"], largest="depth")
    got = T.with_settings(spark, T.STATE_STORE | {"spark.sql.session.timeZone": "UTC"}, lambda: {(r.user_id, r.item_id): r.stage for r in run().collect()})
    want = {}
    for _, _, user, kind, item in (x for b in batches for x in b):
        want[user, item] = max(want.get((user, item), 0), T.STAGES.index(raw.get(kind, "none")))
    assert got == {k: T.STAGES[v] for k, v in want.items()}
    assert got[1, 5] == "purchase"


def test_late_rows_are_kept_apart_and_all_reports_are_added_up(spark, tmp_path):
    batches = [[(10 * n + k, 2 * n if k else 2 * n - 9, k, "view", 1) for k in range(3)] for n in range(1, 7)]
    where = files(spark, str(tmp_path), batches)
    stream = lambda: T.read_events(spark, where, "*.parquet", files=1)
    on_time, late = T.split_late(stream())
    assert on_time.count() + late.count() == 18
    assert sorted(r.event_id for r in late.collect()) == [20, 30, 40, 50, 60]  # the first batch has nothing before it
    settings = {"spark.sql.streaming.numRecentProgressUpdates": "1"}
    # Spark compares with the watermark of one batch earlier, and each late day and type is a row of a partial sum
    assert T.with_settings(spark, settings, lambda: T.late_rows(T.tumbling(stream()))) == 4


def test_facts_in_a_snapshot_table_follow_the_stream_and_survive_a_repeat(spark, tmp_path):
    batches = [[(1, 0, 1, "view", 5), (2, 0, 2, "view", 5)], [(3, 1, 1, "view", 5), (4, 1, 1, "purchase", 5)], [(5, 1, 3, "purchase", 6)]]
    where = files(spark, str(tmp_path), batches)
    table = SnapshotTable(spark, str(tmp_path / "table"), ["user_id", "item_id"], buckets=4)
    kept = lambda: T.facts(T.read_events(spark, where, "*.parquet", files=1)).select("user_id", "item_id", "view_count", "purchase_count")
    T.with_session_zone(spark, lambda: T.drain_into(kept(), table, str(tmp_path / "state")))
    want = {(1, 5): (2, 1), (2, 5): (1, 0), (3, 6): (0, 1)}
    assert {(r.user_id, r.item_id): (r.view_count, r.purchase_count) for r in table.read().collect()} == want
    number = table.latest().number
    last = max(int(x) for x in os.listdir(tmp_path / "state" / "commits") if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # as if the driver was lost after the upsert
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    T.with_session_zone(spark, lambda: T.drain_into(kept(), table, str(tmp_path / "state")))
    assert table.latest().number == number


def test_a_stream_without_files_is_an_empty_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    held = T.drain(T.tumbling(T.read_events(spark, str(tmp_path / "none"))), "complete")
    assert held.count() == 0 and set(held.columns) == {"start", "end", "event_type", "n"}
    on_time, late = T.split_late(T.read_events(spark, str(tmp_path / "none")))
    assert on_time.count() == late.count() == 0


def test_null_budgets_afford_nothing_and_stay(spark):
    users = spark.createDataFrame([(1, 50.0), (2, None), (3, -10.0), (4, float("nan")), (5, 1000.0)], "u_id long, budget double")
    prices = spark.createDataFrame([(10.0,), (50.0,), (120.0,), (None,)], "price double")
    got = {r.u_id: (r.affordable, r.share) for r in vectors.affordability(users, prices, "budget", "price").collect()}
    assert got == {1: (2, 0.5), 2: (0, 0.0), 3: (0, 0.0), 4: (0, 0.0), 5: (3, 0.75)}
    none = vectors.affordability(users, prices.where("price > 1e9"), "budget", "price").collect()
    assert len(none) == 5 and {(r.affordable, r.share) for r in none} == {(0, None)}


@pytest.fixture(scope="module")
def no_views(spark, tmp_path_factory):
    """The smallest tables, with impressions and purchases as the only events."""
    path = str(tmp_path_factory.mktemp("tables"))
    for t in ("customer", "part", "orders", "nation", "region", "supplier", "lineitem", "embeddings", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type in ('error', 'purchase')").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["funnel_by_group", "price_signal", "sampling_stats", "quartile_rates", "spearman", "signal_alignment", "funnel_conversion", "view_rates", "auc_single_feature", "corr_matrix", "coverage"])
def test_rates_without_a_base_are_null_and_end_no_query(spark, no_views, name):
    registry.queries()[name](spark, no_views).collect()


def test_no_rows_at_all(spark):
    none = spark.createDataFrame([], "user_id long, item_id int, sampled int, source string, is_backfill boolean, score double, label boolean")
    assert sampling.sampling_stats(none, 0).first().exposed_share is None
    assert sequences.auc(none, "score", "label").first().auc == 0.5
    assert sequences.best_threshold(none, "score", "label").first().accuracy is None
    assert sequences.concentration(none.select("item_id"), 3).select("top10_share", F.col("zero_items")).first() == (None, 3)
