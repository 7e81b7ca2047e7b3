"""Selection against sorting, over ties, wide ranges, decimals, null groups and one group of all rows."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlpit.operators import selection as S


def linear(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    low, share = math.floor(at), at - math.floor(at)
    return values[low] if share == 0 else (1 - share) * values[low] + share * values[low + 1]


@pytest.mark.parametrize("kind", ["even", "ties", "wide", "huge", "tiny gaps"])
def test_quantiles_equal_sorting(spark, kind, monkeypatch):
    monkeypatch.setattr(S, "BINS", 64)  # several passes on few rows
    rng = random.Random(3)
    draw = {
        "even": lambda: rng.uniform(-5, 5), "ties": lambda: float(rng.choice([1, 1, 1, 2, 9])), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-6, 6),
        "huge": lambda: rng.choice([-1.7e308, 1.7e308, 0.0, 1.0]), "tiny gaps": lambda: 1.0 + rng.randint(0, 5) * 2.220446049250313e-16,
    }[kind]
    rows = [(rng.choice(["a", "b", None]), draw()) for _ in range(200)] + [("one", draw()), ("two", 1.0), ("two", 3.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.low, r.mid, r.high) for r in S.quantiles(df, "x", {"low": 0.25, "mid": 0.5, "high": 0.9}, "g").collect()}
    groups = {g: [x for k, x in rows if k == g and x is not None and not math.isnan(x)] for g, _ in rows}
    assert got == {g: tuple(linear(v, q) for q in (0.25, 0.5, 0.9)) for g, v in groups.items() if v}


def test_survey_values_and_missing_groups(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int")
    assert S.quantiles(df, "x", {"a": 0.25, "b": 0.5, "c": 0.75}).first() == (1.75, 2.5, 4.75)
    assert S.quantiles(df.where("x > 99"), "x", {"a": 0.5}).count() == 0
    stats = S.with_quantiles(spark.createDataFrame([(None, 1), ("z", 2)], "g string, n int"), spark.createDataFrame([(None, 4.0)], "g string, x double"), "x", {"m": 0.5}, "g")
    assert {r.g: r.m for r in stats.collect()} == {None: 4.0, "z": None}


def test_decimals_stay_exact(spark):
    values = [Decimal("12345678901234567.01"), Decimal("12345678901234567.02"), Decimal("12345678901234567.03"), Decimal("12345678901234567.04")]  # equal as doubles
    df = spark.createDataFrame([("a", v) for v in values], "g string, v decimal(20,2)")
    assert S.decimal_quantile(df, "v", "0.50", "g").first().percentile == Decimal("12345678901234567.025")


def test_no_plan_buffers_or_sorts_a_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    plan = S.quantiles(df, "x", {"m": 0.5}, "g")._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_list" not in plan
