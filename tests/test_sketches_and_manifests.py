"""Distinct counts from merged sketches against sets, and manifests made while tables are written."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.operators import sketches as K
from marlpit.sources import sinks

KIND = "user_id long, item_id long, ts timestamp, event_type string"


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(0)
    day = dt.datetime(2024, 3, 1)
    rows = [(int(u) if u else None, int(i), day + dt.timedelta(days=int(t)), "view" if v else None) for u, i, t, v in zip(rng.integers(0, 3000, 9000), rng.integers(0, 50, 9000), rng.integers(0, 20, 9000), rng.integers(0, 9, 9000), strict=True)]
    return spark.createDataFrame([*rows, (1, 1, None, "view")], KIND).cache()


def test_every_trailing_window_is_within_the_bound(spark, events, tmp_path):
    log_k = 9  # 512 entries, so windows are estimates
    K.daily(events, "event_type", log_k=log_k).write.parquet(str(tmp_path / "sketches"))
    kept = spark.read.parquet(str(tmp_path / "sketches"))
    got = K.estimates(K.trailing(kept, 7, "event_type", log_k=log_k)).collect()
    rows = [r for r in events.collect() if r["ts"]]
    assert len(got) == len({(r["ts"].date(), r["event_type"]) for r in rows})
    estimated = 0
    for g in got:
        inside = [r for r in rows if r["event_type"] == g["event_type"] and 0 <= (g["day"] - r["ts"].date()).days < 7]
        assert g["events"] == len(inside)
        for name, values in (("users", {r["user_id"] for r in inside} - {None}), ("items", {r["item_id"] for r in inside}), ("pairs", {(r["user_id"], r["item_id"]) for r in inside if r["user_id"] is not None})):
            assert abs(g[name] - len(values)) <= 4 * len(values) / 2 ** (log_k / 2)
            if len(values) <= 2**log_k:
                assert g[name] == len(values)
            else:
                estimated += g[name] != len(values)
    assert estimated > 10


def test_differences(spark, events):
    cut = dt.datetime(2024, 3, 11)
    half = K.daily(events.where("ts is not null").withColumn("late", F.col("ts") >= F.lit(cut)), "late")
    both = K.merged(half, "late").groupBy().agg(F.max(F.when(F.col("late"), F.col("users"))).alias("now"), F.max(F.when(~F.col("late"), F.col("users"))).alias("before"))
    rows = [r for r in events.collect() if r["ts"] and r["user_id"] is not None]
    now, before = ({r["user_id"] for r in rows if (r["ts"] >= cut) == late} for late in (True, False))
    told = both.select(K.beyond(F.col("now"), F.col("before")), K.beyond(F.col("now"), F.lit(None).cast("binary")), K.beyond(F.col("now"), F.col("now"))).first()
    assert tuple(told) == (len(now - before), len(now), 0)  # exact, as they fit


def test_no_events_no_sketches(events):
    assert K.estimates(K.trailing(K.daily(events.limit(0), "event_type"), 7, "event_type")).count() == 0


def test_a_table_is_computed_once_and_its_manifest_holds(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.range(1000).select("id", (F.col("id") % 7 == 0).alias("flag"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('a "b",\n'), F.col("id"))).alias("text"))
    once = df.repartition(3).mapInArrow(seen, df.schema).withColumn("a.b", F.lit(""))
    df = df.withColumn("a.b", F.lit(""))
    made = sinks.write_dataset({"t": once, "none": df.limit(0)}, str(tmp_path / "p"))["artifacts"]
    assert reads.value == 1000 and made["t"]["rows"] == 1000 and made["none"]["rows"] == 0
    same = sinks.write_dataset({"t": df.coalesce(1)}, str(tmp_path / "q"))["artifacts"]["t"]
    assert same["digest"] == made["t"]["digest"]
    assert sinks.check_dataset(spark, str(tmp_path / "p")) == {"t": True, "none": True}
    df.where("id <> 5").write.mode("overwrite").parquet(str(tmp_path / "p" / "t"))
    assert sinks.check_dataset(spark, str(tmp_path / "p")) == {"t": False, "none": True}


def test_text_files_hold_what_the_manifest_says(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") / 3).alias("x"), (F.col("id") % 2 == 0).alias("flag"), F.array(F.lit("p"), F.lit("q")).alias("tags"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") > 9, "t").alias("text"))
    sinks.write_dataset({"t": df}, str(tmp_path), "csv")
    assert sinks.check_dataset(spark, str(tmp_path)) == {"t": True}
