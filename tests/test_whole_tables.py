"""The queries over whole tables against brute force."""

import numpy as np
import pytest

from marlpit.operators import vectors as V
from marlpit.plans import catalog

N = 330


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("world")), np.random.default_rng(3)
    vecs = rng.normal(size=(N, 4)).round(6)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    parts = [(i, f"name {i}", f"brand {i % 3}", f"type {i % 5}", i % 50, 1000.0 + i) for i in range(1, N + 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i, 0.1, 0.2, "A") for i in range(1, N + 1)], "l_partkey long, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return folder, vecs, parts


def test_neighbors(spark, world):
    folder, vecs, _ = world
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 9)
    np.fill_diagonal(score, -np.inf)
    want = {(i, int(j)) for i in range(N) for j in np.argsort(-score[i], kind="stable")[:5]}
    assert {(r["vec_id"], r["neighbor"]) for r in catalog.nearest_neighbors(spark, folder).collect()} == want


def test_matches(spark, world):
    folder, vecs, _ = world
    z, p = np.clip((vecs - vecs.mean(0)) / vecs.std(0), -2.5, 2.5), 1 / (1 + np.exp(-vecs)) - 0.5
    want = 1 / (1 + np.exp(-2.2 * (p @ z.T) / (1 + np.abs(p).sum(1))[:, None]))
    got = catalog.preference_match(spark, folder).collect()
    assert len(got) == N * (N - 1)
    assert all(abs(r["match"] - want[r["user_vec"], r["item_vec"]]) < 2e-6 for r in got)


def test_continuity(spark, world):
    folder, _, parts = world
    want = {(a[0], b[0]): 0.65 * (a[3] == b[3]) + 0.35 * (1 - (abs(a[4] - b[4]) / 50 + abs(a[5] - b[5]) / 5000) / 2) for a in parts for b in parts if a[2] == b[2] and a[0] < b[0]}
    got = {(r["a"], r["b"]): r["score"] for r in catalog.continuity_score(spark, folder).collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_details(spark, world):
    got = catalog.catalog_detail(spark, world[0]).collect()
    assert sorted(r["product_id"] for r in got) == list(range(1, N + 1)) and all(r["lines"] == 1 and r["flags"] == "A" for r in got)


def test_scores_without_k_are_all(spark, world):
    held = catalog.vectors(spark, world[0])
    assert V.score_blocks(held, held.withColumnRenamed("vec_id", "other"), None, "vec_id", "other", block=100).count() == N * N
