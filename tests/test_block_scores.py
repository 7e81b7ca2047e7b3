"""Best scores kept over blocks against one sort of all pairs; what a task sends on."""

import numpy as np
import pyarrow as pa
import pytest

from marlpit.operators import vectors as V


def frame(spark, rows, name):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], f"{name} long, vec array<double>")


def plain(a, b, k, skip):
    out = set()
    for i, x in a:
        found = sorted((-round(float(np.dot(x, y)), 9), int(j)) for j, y in b if np.isfinite(np.dot(x, y)) and not (skip and i == j))
        out |= {(int(i), j, n + 1) for n, (_, j) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("skip", [False, True])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_over_blocks_equal_one_sort(spark, k, skip):
    rng = np.random.default_rng(5)
    a = [(i, rng.integers(-2, 3, 3)) for i in range(37)]  # many ties
    b = [(i, rng.integers(-2, 3, 3)) for i in range(20, 90)] + [(200, [float("inf"), 0, 0]), (201, [float("nan"), 0, 0])]
    got = V.score_blocks(frame(spark, a, "l"), frame(spark, b, "r"), k, "l", "r", block=8, skip_same=skip)
    assert {(r["l"], r["r"], r["rank"]) for r in got.collect()} == plain(a, b, k, skip)


def test_equal_vectors_and_further_rows(spark):
    a = spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 4)], "l long, vec array<double>, more int")
    b = frame(spark, [(i, [1.0]) for i in range(40)], "r")
    got = sorted((r["l"], r["r"]) for r in V.score_blocks(a, b.repartition(1), 2, "l", "r", block=64, more="more").collect())
    assert got == [(1, 0), (1, 1), *((2, i) for i in range(6))]


def test_a_block_sends_on_k_rows_however_many_blocks_it_meets():
    rng = np.random.default_rng(6)
    held = V._Best(pa.array(range(5)), pa.array([0]), np.full(5, 3), 9)
    every = []
    for at in range(0, 4000, 400):
        s = rng.normal(size=(5, 400))
        every.append(s)
        held.add(pa.array(range(at, at + 400)), s)
    whole = np.round(np.hstack(every), 9)
    assert held.rows().num_rows == 15
    want = np.argsort(-whole, axis=1, kind="stable")[:, :3]
    assert held.rows().column("r").to_pylist() == want.ravel().tolist()
    assert (held.least == np.take_along_axis(whole, want[:, 2:], axis=1)[:, 0]).all()


def test_equal_ids_are_found_with_repeats():
    i, j = V._same(pa.array([5, 7, None, 5]), pa.array([7, 5, 7, None]))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (1, 0), (1, 2), (2, 3), (3, 1)]


def test_all_pairs_leave_in_small_batches():
    parts = list(V._all_pairs(pa.array(range(10)), pa.array(range(100)), np.arange(1000.0).reshape(10, 100), most=200))
    assert [p.num_rows for p in parts] == [200] * 5
    assert [(r["l"], r["r"], r["score"]) for p in parts for r in p.to_pylist()] == [(i, j, i * 100.0 + j) for i in range(10) for j in range(100)]


def test_all_pairs_in_the_order_of_scores():
    s = np.random.default_rng(7).normal(size=(10, 100))
    s[3, 4] = np.nan
    parts = list(V._all_pairs(pa.array(range(10)), pa.array(range(100)), s, most=200, in_order=True))
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert len(rows) == 999 and {(i, j): x for i, j, x in rows} == {(i, j): s[i, j] for i in range(10) for j in range(100) if (i, j) != (3, 4)}
    assert [x for _, _, x in rows] == sorted(x for _, _, x in rows)


def test_stored_matches_take_few_bytes_a_pair(spark, tmp_path):
    from marlpit.plans import catalog

    rng, n = np.random.default_rng(8), 1500
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(n, 16)))], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    catalog.preference_match(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == n * (n - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * n * n
