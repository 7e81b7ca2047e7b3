"""Relational files: round trips, filters, additive columns, upserts."""

import json
import math
from datetime import date, datetime
from decimal import Decimal

import pytest

from marlpit.sources import relational as R

SCHEMA = "id long, `the \"name\"` string, x double, ok boolean, price decimal(12,2), at timestamp_ntz, day date, raw binary"


def rows():
    t = datetime(2024, 1, 2, 3, 4, 5, 678)
    return [
        (1, "a", 0.5, True, Decimal("10.20"), t, date(2024, 1, 2), b"\x00\xff"), (2, None, None, None, None, None, None, None), (None, "", math.inf, False, Decimal("-0.01"), t, date(1969, 1, 1), b""),
        (3, "é'\"", -0.5, False, Decimal("9999999999.99"), t, date(2024, 1, 2), b"x"), (3, "é'\"", -0.5, False, Decimal("9999999999.99"), t, date(2024, 1, 2), b"x"),
    ]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    R.write_table(df, f"file://{tmp_path}", "t", "id")
    back = R.read_table(spark, f"file://{tmp_path}", "t")
    assert back.schema == df.schema
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    R.write_table(df.limit(0), str(tmp_path), "none", "id")
    assert R.read_table(spark, str(tmp_path), "none").count() == 0
    nan = spark.createDataFrame([(1, math.nan), (2, None)], "id long, x double")
    R.write_table(nan, str(tmp_path), "nan", "id")
    assert {r["id"]: str(r["x"]) for r in R.read_table(spark, str(tmp_path), "nan").collect()} == {1: "nan", 2: "None"}
    with pytest.raises(Exception, match="no table"):
        R.read_table(spark, str(tmp_path), "missing").count()


def test_conditions_reach_the_files(spark, tmp_path):
    df = spark.range(1000).selectExpr("id as k", "cast(id % 7 as int) as m", "concat('s', id) as s").union(spark.sql("select cast(null as long), null, null")).cache()
    R.write_table(df, str(tmp_path), "t", "k", 4)
    n = len(R.latest(str(tmp_path), "t").files)
    assert n > 1
    cases = [
        ([("k", "=", 500)], "k = 500", 1), ([("k", ">", 990), ("m", "=", 3)], "k > 990 and m = 3", 1), ([("k", "in", [1, 2, 999])], "k in (1, 2, 999)", 2), ([("k", "is null")], "k is null", 1),
        ([("s", "<", "s2"), ("m", "in", [1, 3])], "s < 's2' and m in (1, 3)", n), ([("k", "<=", 3), ("k", ">=", 2)], "k between 2 and 3", 1), ([("k", "<", 0)], "k < 0", 1), ([("s", "is not null")], "s is not null", n), ([], "true", n),
    ]
    for where, sql, files in cases:
        got = R.read_table(spark, str(tmp_path), "t", where)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, df.where(sql).collect())), sql
        assert got.rdd.getNumPartitions() == files, sql
    held = R.read_table(spark, str(tmp_path), "t")
    for sql in ("k = 500", "m = 3 or k = 1", "not (m = 3)", "k <=> null"):  # one frame under several plans
        assert held.where(sql).count() == df.where(sql).count(), sql
    assert held.where("k = 1").crossJoin(held.where("k = 2").select("s")).count() == 1
    for bad in ([("k", "like", "x")], [("nothing", "=", 1)]):
        with pytest.raises(Exception, match="tell|nothing"):
            R.read_table(spark, str(tmp_path), "t", bad).count()


def test_files_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FILE_BYTES", 1 << 16)
    schema = spark.range(1).schema
    import pyarrow as pa

    writer = R.Writer({"path": str(tmp_path), "table": "t"}, schema, True)
    told = writer.write(iter([pa.RecordBatch.from_pydict({"id": list(range(n, n + 4000))}) for n in (0, 4000, 8000)]))
    assert len(told.files) > 1 and sum(f["rows"] for f in told.files) == 12_000
    assert R.latest(str(tmp_path), "t") is None  # nothing is visible ahead of the commit
    writer.commit([told, None])
    other = R.Writer({"path": str(tmp_path), "table": "t"}, schema, False)
    third = R.Writer({"path": str(tmp_path), "table": "t"}, schema, False)
    other.commit([R.Written([])])
    with pytest.raises(FileExistsError):
        third.commit([R.Written([])])
    third.abort([told])
    assert not list((tmp_path / "t").glob("*.db"))


def test_columns_are_added_and_old_layouts_kept(spark, tmp_path):
    path = str(tmp_path)
    R.write_table(spark.range(10).withColumnRenamed("id", "k"), path, "t", "k")
    files = [f["name"] for f in R.latest(path, "t").files]
    assert R.add_columns(path, "t", "kind string, seed int", {"kind": "made"}) == ["kind", "seed"]
    assert R.add_columns(path, "t", "kind string, seed int", {"kind": "made"}) == []
    with pytest.raises(ValueError):
        R.add_columns(path, "t", "kind int")
    assert [f["name"] for f in R.latest(path, "t").files] == files
    held = R.read_table(spark, path, "t")
    assert held.where("kind = 'made' and seed is null").count() == 10 and held.where("kind = 'x'").count() == 0
    assert R.set_aside(path, "t", ["k", "kind"]) is None and R.set_aside(path, "nothing", ["k"]) is None
    name = R.set_aside(path, "t", ["category_id"])
    assert R.latest(path, "t") is None and R.read_table(spark, path, name).count() == 10


def test_upserts_rewrite_touched_files(spark, tmp_path):
    path = str(tmp_path)
    R.write_table(spark.range(0, 1000).selectExpr("id as k", "id * 2 as v"), path, "t", "k", 4)
    R.add_columns(path, "t", "kind string", {"kind": "made"})
    before = {f["name"] for f in R.latest(path, "t").files}
    assert len(before) > 1
    new = spark.createDataFrame([(1, 2), (2, 5), (2000, 7)], "k long, v long")
    assert R.upsert(new, path, "t") == {"keep": 1, "update": 1, "insert": 1}
    after = R.latest(path, "t")
    assert len(before & {f["name"] for f in after.files}) == len(before) - 1
    got = {r["k"]: (r["v"], r["kind"]) for r in R.read_table(spark, path, "t").collect()}
    assert len(got) == 1001 and got[1] == (2, "made") and got[2] == (5, "made") and got[2000] == (7, "made") and got[999] == (1998, "made")
    assert R.upsert(new, path, "t") == {"keep": 3} and R.latest(path, "t") == after
    assert R.upsert(spark.createDataFrame([(2, "own")], "k long, kind string"), path, "t") == {"update": 1}
    assert R.read_table(spark, path, "t").where("k = 2").first().asDict() == {"k": 2, "v": 5, "kind": "own"}
    for bad in ([(1, 1), (1, 2)], [(None, 1)]):
        with pytest.raises(ValueError):
            R.upsert(spark.createDataFrame(bad, "k long, v long"), path, "t")
    assert json.loads(R.latest(path, "t").schema)["fields"][2]["name"] == "kind"
