"""Readers, sinks, upserts, streams and the command line."""

import json

import pytest

from marlpit import cli
from marlpit.operators import catalog as C
from marlpit.sources import readers, sinks


def test_csv_events(spark, tmp_path):
    one, two = tmp_path / "a.csv", tmp_path / "b.csv"
    one.write_text("event_id,user_id,product_id,event_type,timestamp,generation_version,extra\ne1,u,p,view,2024-01-02T03:04:05Z,v1,hidden\n")
    two.write_text("timestamp,event_id,user_id,product_id,event_type,generation_version\n2024-01-02T03:04:05+02:00,e2,u,p,purchase,v1\n")
    got = readers.events_from_csv(spark, str(one), str(two), expect={"generation_version": "v1"})
    assert "extra" not in got.columns and got.count() == 2
    with pytest.raises(ValueError):
        readers.events_from_csv(spark, str(one), expect={"generation_version": "v2"})
    two.write_text("timestamp,event_id,user_id,product_id,event_type\n2024-01-02T03:04:05,e2,u,p,purchase\n")
    with pytest.raises(ValueError):
        readers.events_from_csv(spark, str(two))


def test_json_sets(spark, tmp_path):
    (tmp_path / "seen.json").write_text(json.dumps({"u1": ["a", "b"], "u2": []}))
    got = readers.sets_from_json(spark, str(tmp_path / "seen.json"))
    assert sorted(map(tuple, got.collect())) == [("u1", "a"), ("u1", "b")]


def test_manifest_is_the_same_for_any_layout(spark, tmp_path):
    df = spark.range(20).withColumnRenamed("id", "k")
    a = sinks.write_dataset({"t": df.repartition(3)}, str(tmp_path / "a"))["artifacts"]["t"]
    b = sinks.write_dataset({"t": df.coalesce(1)}, str(tmp_path / "b"))["artifacts"]["t"]
    assert a["rows"] == 20 and a["digest"] == b["digest"] and a["bytes"] > 0
    assert json.loads((tmp_path / "a" / "manifest.json").read_text())["artifacts"]["t"]["rows"] == 20
    other = sinks.write_dataset({"t": df.where("k > 0")}, str(tmp_path / "c"))["artifacts"]["t"]
    assert other["digest"] != a["digest"]


def test_guarded_replace(spark, tmp_path):
    path = str(tmp_path / "products")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert C.guarded_replace(spark, one, path, "id") == {"insert": 2}
    two = spark.createDataFrame([(2, "b"), (3, "c")], "id long, name string")
    used = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(ValueError):
        C.guarded_replace(spark, two, path, "id", used)
    assert C.guarded_replace(spark, two, path, "id") == {"insert": 1, "keep": 1, "delete": 1}
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, "b"), (3, "c")]


def test_experiments_keep_each_other(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([(1.0,)], "ndcg double")
    sinks.write_experiment(df, path, "x", "a")
    sinks.write_experiment(df, path, "x", "b")
    sinks.write_experiment(df, path, "x", "b")
    assert spark.read.parquet(path).count() == 2


def test_packages(spark, tmp_path):
    """A package can be read as a control of a later experiment, unless it was changed."""
    df = spark.createDataFrame([("a", 0.5, True, ["x", "y"]), ("b", 0.25, False, [])], "model string, ndcg double, best boolean, tags array<string>")
    data = sinks.write_dataset({"facts": spark.range(3)}, str(tmp_path / "data"))
    made = sinks.write_package({"metrics": df}, {"config": {"k": [5, 10]}}, str(tmp_path / "p"), str(tmp_path / "data" / "manifest.json"))
    assert made["artifacts"]["metrics"]["rows"] == 2 and made["policies"]["source"]["facts"]["digest"] == data["artifacts"]["facts"]["digest"]
    assert sinks.read_json(spark, str(tmp_path / "p" / "config.json")) == {"k": [5, 10]}
    back = sinks.read_package(spark, str(tmp_path / "p"), "metrics")
    assert sorted((r["model"], r["ndcg"], r["best"], r["tags"]) for r in back.collect()) == [("a", 0.5, 1, "x|y"), ("b", 0.25, 0, None)]
    sinks.csv_ready(df.limit(1)).write.mode("overwrite").option("header", True).csv(str(tmp_path / "p" / "metrics"))
    with pytest.raises(ValueError):
        sinks.read_package(spark, str(tmp_path / "p"), "metrics")


def test_violations_are_gathered_and_raised(spark):
    from datetime import datetime, timedelta

    from marlpit.operators import validation as V

    t = datetime(2024, 1, 1)
    rows = [(1, t, 1, 1, "impression", 1), (2, t + timedelta(hours=1), 1, 1, "view", 1), (3, t + timedelta(hours=1), 1, 1, "impression", 1), (4, t + timedelta(hours=2), 1, 2, "view", 1), (5, t + timedelta(hours=3), 1, 9, "purchase", 1), (5, t + timedelta(hours=4), 8, 1, "strange", 1)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, item_id int, event_type string, session long")
    users, items = spark.createDataFrame([(1,)], "u long"), spark.createDataFrame([(1,), (2,)], "i int")
    found = V.together([V.event_violations(df, users, items, ["impression", "view", "purchase"]), V.session_violations(df), V.engagement_violations(df)])
    assert sorted(map(tuple, found.collect())) == sorted([
        ("event id repeats", "5"), ("unknown user", "5"), ("unknown item", "5"), ("unknown event type", "5"), ("time does not increase", "3"), ("impression repeats", "1:1:1"),
        ("view without earlier impression", "4"), ("engagement without earlier view", "5"),
    ])
    with pytest.raises(V.InvalidData, match="8 rules broken(.|\n)*and 5 more"):
        V.check(found, "events", 3)
    V.check(found.limit(0), "events")
    labelled = spark.createDataFrame([(1, t, "train"), (2, t, "test"), (3, t, None), (4, None, "train")], "event_id long, ts timestamp_ntz, split string")
    assert {r["key"] for r in V.split_violations(labelled, [("train", "2024-01-01", "2024-01-02"), ("test", "2024-01-02", "2024-01-03")]).collect()} == {"2", "3", "4"}
    products = spark.createDataFrame([(1, "a", 2.0, 0.5), (1, "b", 0.0, 1.5), (2, "b", None, None)], "id long, name string, price double, x double")
    assert V.counts(V.catalog_violations(products, "id", "name", "price", ["x"])).agg({"n": "sum"}).first()[0] == 6


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    from datetime import datetime, timedelta

    from marlpit.streaming import incremental as T

    t = datetime(2024, 1, 1)
    for n, days in enumerate(([0, 1, 10], [10], [9.5, 1, 2])):  # the last file's last two come after the watermark that the first one set
        rows = [(10 * n + i, t + timedelta(days=x), 1, "view", 1.0, '{"k": 1}') for i, x in enumerate(days)]
        spark.createDataFrame(rows, T.RAW).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    (tmp_path / "all").mkdir()
    for n in range(3):
        next((tmp_path / f"in{n}").glob("*.parquet")).rename(tmp_path / "all" / f"{n}.parquet")
    held = T.read_events(spark, str(tmp_path / "all"), "*.parquet", files=1)
    assert T.late_rows(T.tumbling(held)) == 2


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "eval_popularity" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "/nowhere"]) == 2
