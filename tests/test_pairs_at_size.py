"""Queries over all pairs: what a pair costs, beside their results."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.functions import scalar as S
from marlpit.plans import catalog

SF = "/root/testdata/sf0.001"


def test_continuity_has_no_interpreted_function_a_pair(spark):
    plan = catalog.continuity_score(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan


@pytest.mark.parametrize("groups", [1, 2, 7])
def test_continuity_pairs_meet_once_in_any_number_of_groups(spark, groups):
    rows = [(i, f"b{i % 2}", None if i == 5 else f"c{i % 3}", float(i % 4), 10.0 * i) for i in range(1, 30)] + [(3, "b1", "c0", 1.0, 30.0), (None, "b1", "c0", 1.0, 30.0), (40, None, "c0", 1.0, 30.0)]
    held = catalog.continuity_pairs(spark.createDataFrame(rows, "product_id long, brand string, category string, size double, retail double"), groups)
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] and b[0] and a[1] == b[1] and a[0] < b[0])
    got = held.collect()
    assert sorted((r["a"], r["b"]) for r in got) == want
    assert {r["score"] is None for r in got if 5 in (r["a"], r["b"])} == {True}


def test_numbers_are_rounded_as_by_the_other_engine(spark):
    values = [0.5e-9, 1.5e-9, 2.5e-9, -0.5e-9, -2.5e-9, 0.1234567885, 1 / 3, -2 / 3, 0.0, 1e300, float("inf"), *np.random.default_rng(4).normal(size=50).tolist()]
    con = duckdb.connect()
    want = [con.execute("select round(cast(? as double), 9)", [v]).fetchall()[0][0] for v in values]
    got = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", S.rounded_number(F.col("x"), 9).alias("y")).orderBy("i").collect()
    assert [r["y"] for r in got] == want
