"""Exact search through an index against plain products, and what its bounds skip."""

import numpy as np
import pytest

from marlpit.operators import nearest as N


def frame(spark, x, name, ids=None, more=None):
    rows = [(int(i), v.tolist(), *([int(m)] if more is not None else [])) for i, v, m in zip(ids if ids is not None else range(len(x)), x, more if more is not None else [0] * len(x), strict=True)]
    return spark.createDataFrame(rows, f"{name} long, vec array<double>" + (", more long" if more is not None else ""))


def plain(x, y, k, metric="dot", skip_same=False):
    if metric == "cosine":
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
    s = np.round(x @ y.T, 9)
    if skip_same:
        np.fill_diagonal(s, -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(i, int(j), n + 1) for i, js in enumerate(order) for n, j in enumerate(js)}


def clusters(rng, n, of=20, dim=16):
    return rng.normal(size=(of, dim))[rng.integers(0, of, n)] * 3 + rng.normal(size=(n, dim)) * 0.15


def found(rows):
    return {(r["l"], r["r"], r["rank"]) for r in rows.collect()}


def test_clusters_are_skipped_and_results_are_exact(spark):
    x = clusters(np.random.default_rng(1), 1500)
    got = N.search(frame(spark, x, "l"), frame(spark, x, "r"), 5, "l", "r", metric="cosine", skip_same=True, size=64)
    assert found(got.rows) == plain(x, x, 5, "cosine", True)
    w = got.work.first()
    assert w["pairs"] == 1500 * 1500 and w["full_pairs"] < w["pairs"] / 4 and w["part_pairs"] < w["pairs"] / 2 and w["met_cell_pairs"] < w["cell_pairs"] / 2


def test_large_norms_end_the_search(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 8)), rng.normal(size=(2000, 8)) * rng.pareto(1.5, size=(2000, 1))
    got = N.search(frame(spark, x, "l"), frame(spark, y, "r"), 10, "l", "r", size=32)
    assert found(got.rows) == plain(x, y, 10)
    w = got.work.first()
    assert w["met_cell_pairs"] < w["cell_pairs"] / 2 and w["full_pairs"] < w["pairs"] / 4


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_isotropic_rows_and_all_ranks(spark, metric):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 5)), rng.normal(size=(90, 5))
    for k in (1, 7, 200):
        assert found(N.search(frame(spark, x, "l"), frame(spark, y, "r"), k, "l", "r", metric=metric, size=16).rows) == plain(x, y, k, metric)


def test_equal_vectors_take_the_smaller_ids_and_do_not_multiply(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(900, 6))
    y[::3] = y[0]  # a third of all rows
    x = np.vstack([y[:40], np.zeros((1, 6))])
    got = N.search(frame(spark, x, "l"), frame(spark, y, "r"), 4, "l", "r", size=32)
    assert found(got.rows) == plain(x, y, 4)
    same = N.search(frame(spark, y, "l"), frame(spark, y, "r"), 4, "l", "r", metric="cosine", skip_same=True, size=32)
    assert found(same.rows) == plain(y, y, 4, "cosine", True)
    assert same.work.first()["part_pairs"] < 900 * 700  # the copies beyond the first ones were met by nobody


def test_more_rows_for_a_later_filter(spark):
    rng = np.random.default_rng(5)
    x, y, more = rng.normal(size=(30, 4)), rng.normal(size=(200, 4)), rng.integers(0, 40, 30)
    rows = N.search(frame(spark, x, "l", more=more), frame(spark, y, "r"), 3, "l", "r", more="more", size=16).rows.collect()
    held = {}
    for r in rows:
        held.setdefault(r["l"], []).append((-r["score"], r["r"]))
    s = np.round(x @ y.T, 9)
    for i in range(30):
        wanted = sorted((-s[i, j], j) for j in range(200))[: 3 + more[i]]
        assert sorted(held[i])[: len(wanted)] == wanted


def test_odd_rows(spark):
    kind = "l string, vec array<double>"
    x = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), (None, [1.0, 1.0]), ("n", None), ("h", [None, 1.0]), ("q", [float("nan"), 1.0]), ("i", [float("inf"), 1.0]), ("a", [1.0, 0.0])], kind)
    got = N.search(x, x.withColumnRenamed("l", "r"), 5, "l", "r")
    assert sorted((r["l"], r["r"], r["score"], r["rank"]) for r in got.rows.collect()) == [("a", "a", 1.0, 1), ("a", "z", 0.0, 2), ("z", "a", 0.0, 1), ("z", "z", 0.0, 2)]
    for left, right in ((x.limit(0), x), (x, x.limit(0)), (x.where("l = 'n'"), x)):
        none = N.search(left, right.withColumnRenamed("l", "r"), 5, "l", "r")
        assert none.rows.count() == 0 and none.rows.columns == ["l", "r", "score", "rank"] and none.work.first()["met_cell_pairs"] == 0
    with pytest.raises(ValueError):
        N.search(x, x.withColumnRenamed("l", "r"), 0, "l", "r")
