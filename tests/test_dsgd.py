"""Stratified SGD against finite differences, a plain loop over the same cells, and its own repeats."""

import numpy as np
import pytest

from marlpit.operators import dsgd as G


@pytest.mark.parametrize("objective", G.OBJECTIVES)
@pytest.mark.parametrize("bias", G.BIASES)
def test_slopes_equal_finite_differences(objective, bias):
    rng = np.random.default_rng(1)
    c = G.Config(dim=3, objective=objective, bias=bias)
    u, i, o = (rng.normal(size=(6, 4)) for _ in range(3))
    if objective == "bce":
        o = None
    labels, weights = rng.integers(0, 2, 6).astype(float), rng.uniform(0.5, 3, 6)
    slopes = G.loss_and_slopes(c, u, i, o, labels, weights)[1:]
    for which, rows in enumerate((u, i, o)):
        if rows is None:
            continue
        for col in range(4):
            ends = []
            for sign in (1, -1):
                moved = [x if x is None else x.copy() for x in (u, i, o)]
                moved[which][:, col] += sign * 1e-6
                ends.append(G.loss_and_slopes(c, *moved, labels, weights)[0])
            free = col < 3 or bias == "user_item" or (bias == "item" and which > 0)
            want = (ends[0] - ends[1]) / 2e-6 if free else np.zeros(6)
            assert slopes[which][:, col] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("teams", [2, 4, 6, 10])
def test_every_two_blocks_meet_once(teams):
    rounds = G.tournament(teams)
    assert sorted(tuple(sorted(p)) for r in rounds for p in r) == [(a, b) for a in range(teams) for b in range(a + 1, teams)]
    assert all(sorted(x for p in r for x in p) == list(range(teams)) for r in rounds)


def examples(spark, objective, n=400):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(n):
        u, i, o = int(rng.integers(0, 30)), int(rng.integers(0, 12)), int(rng.integers(12, 24))
        rows.append((u, i, o, 1.0, float(rng.uniform(1, 2))) if objective == "bpr" else (u, i if rng.random() < 0.5 else o, None, 0.0, 1.0))
    if objective == "bce":
        rows = [(u, i, None, float(i < 12), w) for u, i, _, _, w in rows]
    return spark.createDataFrame([*rows, (None, 1, None, 1.0, 1.0), (3, 1, None if objective == "bce" else 2, 1.0, None)], "user_id long, item_id long, other_id long, label double, weight double")


def plain(rows, cells, c):
    """The same epochs in one process: cells in turn, each on whole tables of parameters."""
    sides = {k: np.array(sorted(v)) for k, v in (("u", {r.user_id for r in rows if r.user_id is not None}), ("i", {x for r in rows for x in (r.item_id, r.other_id) if x is not None}))}
    held = {k: {"ids": ids, "params": G.first_params(ids, c.dim + 1, c.seed + (k == "i")), "squares": np.zeros((len(ids), c.dim + 1))} for k, ids in sides.items()}
    lost = []
    for _ in range(c.epochs):
        lost.append(sum(G.step(c, held["u"], held["i"], cell) for cell in cells))
    return held, lost


@pytest.mark.parametrize("objective", G.OBJECTIVES)
def test_strata_equal_a_plain_loop_and_losses_fall(spark, objective):
    c = G.Config(dim=4, objective=objective, bias="user_item", epochs=3, batch=16, blocks=2, seed=5)
    df = examples(spark, objective)
    cells = sorted(G._cells(df, c).collect(), key=lambda r: (r["round"], r["turn"], r["k"]))
    kinds = {n: "<f8" if n in G._CELL[3:] else "<i8" for n in G._CELL}
    opened = [{n: np.frombuffer(r[n], kinds[n]) for n in G._CELL} for r in cells]
    assert sum(len(x["users"]) for x in opened) == 400  # each example has one cell, those with nulls none
    assert max(len(x["users"]) for x in opened) < 200
    held, lost = plain(df.collect(), opened, c)
    assert lost[0] > lost[1] > lost[2]
    for parts in (1, 7):
        got = {(r.kind, r.id): [*r.vec, r.bias] for r in G.fit(df.repartition(parts), c).params.collect()}
        for kind in "ui":
            for n, p in zip(held[kind]["ids"].tolist(), held[kind]["params"], strict=True):
                assert got[kind, n] == pytest.approx(p.tolist(), abs=1e-12)


def test_best_epoch_is_kept_and_patience_ends_training(spark):
    figures = iter([1.0, 3.0, 3.0, 2.0, 9.0])
    c = G.Config(dim=2, epochs=5, patience=2, blocks=1)
    held = G.fit(examples(spark, "bce"), c, lambda params: next(figures))
    assert (held.epoch, held.figures) == (2, [1.0, 3.0, 3.0, 2.0])


def test_no_examples_and_refused_settings(spark):
    assert G.fit(examples(spark, "bce").where("user_id < 0"), G.Config(epochs=1)).params.count() == 0
    with pytest.raises(ValueError):
        G.Config(objective="hinge")


def test_scores_include_both_biases(spark):
    params = spark.createDataFrame([("u", 1, [1.0, 2.0], 0.5), ("i", 7, [3.0, 1.0], 0.25), ("i", 8, [0.0, 0.0], -1.0)], "kind string, id long, vec array<double>, bias double")
    row = G.scored(params, spark.createDataFrame([(1, 7, 8)], "user_id long, item_id long, other_id long")).first()
    assert (row.score, row.other_score) == (5.75, -0.5)
