"""Samplers, ordered sequences, separability, scalar functions and kernels."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.functions import scalar as S
from marlpit.operators import catalog as C
from marlpit.operators import dataset as D
from marlpit.operators import mf as MF
from marlpit.operators import sampling as M
from marlpit.operators import sequences as Q
from marlpit.operators import vectors as V

PAIR = "user_id long, item_id int"


@pytest.fixture
def pools(spark):
    positive = spark.createDataFrame([(0, 0), (1, 0)], PAIR)
    exposed = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4)] + [(1, 1)], PAIR)
    items = spark.createDataFrame([(i,) for i in range(9)], "item_id int")
    return positive, exposed, items


def drawn(pools, strategy):
    out = {}
    for r in M.sample(*pools, strategy).collect():
        out.setdefault(r["user_id"], []).append((r["sampled"], r["source"], r["is_backfill"]))
    return out


def test_exposed_sampler_backfills(pools):
    got = drawn(pools, "exposed")
    assert [sum(s == "exposed_non_conversion" for _, s, _ in got[u]) for u in (0, 1)] == [4, 1]
    assert sum(b for *_, b in got[1]) == 3 and not any(b for *_, b in got[0])
    assert all(len({i for i, *_ in rows}) == 4 for rows in got.values())


def test_mixed_sampler(pools):
    got = drawn(pools, "mixed")
    assert [sum(s == "exposed_non_conversion" for _, s, _ in got[u]) for u in (0, 1)] == [2, 1]
    assert [sum(b for *_, b in got[u]) for u in (0, 1)] == [0, 1]


def test_small_pool_raises(spark, pools):
    positive, exposed, items = pools
    with pytest.raises(ValueError):
        M.sample(positive, exposed, items.where("item_id < 7"), "unknown")
    assert drawn(pools, "unknown") == drawn(pools, "unknown")


def test_auc_and_threshold(spark):
    df = spark.createDataFrame([(0.1, False), (0.5, True), (0.5, False), (0.9, True)], "s double, y boolean")
    assert Q.auc(df, "s", "y").first()[0] == pytest.approx(0.875)
    assert Q.auc(df.where("y"), "s", "y").first()[0] == 0.5
    best = Q.best_threshold(df, "s", "y").first()
    assert best["accuracy"] == 0.75 and best["threshold"] == 0.1


def test_quartiles_are_order_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10)], "v double")
    assert tuple(Q.quartile_thresholds(df, "v").first()) == (2.0, 7.0)


def test_source_view_is_strictly_earlier(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, 1, 1, "view"), (2, t + timedelta(hours=1), 1, 1, "view"), (3, t + timedelta(hours=1), 1, 1, "purchase"), (4, t, 2, 1, "favorite")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, item_id int, event_type string")
    assert {r["event_id"]: r["source_view"] for r in Q.source_views(df).collect()} == {3: 1, 4: None}


def test_gini_domains(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (1,)], "c long")
    assert M.gini(df, "c").first()[0] == pytest.approx(0)
    assert M.gini(df.unionByName(spark.createDataFrame([(0,)] * 4, "c long")), "c").first()[0] == pytest.approx(0.5)
    assert M.gini(spark.createDataFrame([(0,)], "c long"), "c").first()[0] == 0.0


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(S.slugify(F.lit("  Arts & Crafts!! "))) == "arts-and-crafts"
    assert value(S.clip(F.lit(3.0))) == 1.0 and value(S.logistic(F.lit(0.0))) == 0.5
    assert value(S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert 0 <= value(S.stable_noise(1, F.lit("x"))) <= 1
    with pytest.raises(ValueError):
        S.blend(1.5, F.lit(1.0), F.lit(1.0))
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x double").select(S.zscore(F.col("x")).alias("z"))
    assert [r["z"] for r in flat.collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        S.register("clip", S.clip)


def test_largest_remainder_sums_up(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double")
    assert sorted((r["k"], r["n"]) for r in S.largest_remainder(df, "w", 10, ["k"]).collect()) == [("a", 4), ("b", 3), ("c", 3)]


def test_decimal_percentile_is_exact(spark):
    df = spark.createDataFrame([(str(10**29 + i),) for i in (0, 1)], "p string").select(F.col("p").cast("decimal(38,2)").alias("p"))
    assert str(C.decimal_percentile(df.select("p"), "p", "0.50").first()[0]).startswith("1" + "0" * 29 + ".5")


def test_score_blocks_match_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(7, 3)), rng.normal(size=(9, 3))
    frame = lambda m, n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{n} long, vec array<double>")
    got = {(r["l"], r["rank"]): r["r"] for r in V.score_blocks(frame(a, "l"), frame(b, "r"), 3, "l", "r", block=4).collect()}
    order = np.argsort(-(a @ b.T), axis=1)
    assert got == {(i, k + 1): order[i, k] for i in range(7) for k in range(3)}


def test_affordability_matches_a_plain_count(spark):
    users = spark.createDataFrame([(1, 99.0), (2, 100.0), (3, 450.5), (4, -5.0)], "user_id long, budget double")
    prices = spark.createDataFrame([(100.0,), (99.0,), (450.5,), (1000.0,)], "price double")
    assert {r["user_id"]: r["affordable"] for r in V.affordability(users, prices, "budget", "price").collect()} == {1: 1, 2: 2, 3: 3, 4: 0}


def test_alpha_ties_choose_the_larger(spark):
    df = spark.createDataFrame([(0.0, 0.5, 0.1), (1.0, 0.5, 0.1), (0.5, 0.4, 0.9)], "alpha double, ndcg double, recall double")
    assert V.select_alpha(df).first()["alpha"] == 1.0


def test_als_solves_its_equations(spark):
    """The last half step gives each user the weighted least-squares solution for the items' vectors."""
    rng = np.random.default_rng(4)
    rows = [(10**12 + u, int(i), float(rng.integers(1, 5))) for u in range(12) for i in rng.choice(20, 6, replace=False)]
    c = MF.Config(dim=4, iterations=6, reg=0.1, confidence=2.0)
    state = MF.train(spark.createDataFrame(rows, "user_id long, item_id long, strength double"), c)
    vec = {(r["kind"], r["id"]): np.array(r["vec"]) for r in state.collect()}
    y = np.array([v for (k, _), v in sorted(vec.items()) if k == "i"])
    for u in {r[0] for r in rows}:
        own = [(vec["i", i], c.confidence * s) for w, i, s in rows if w == u]
        a = y.T @ y + sum(s * np.outer(v, v) for v, s in own) + c.reg * len(own) * np.eye(c.dim)
        b = sum((1 + s) * v for v, s in own)
        assert vec["u", u] == pytest.approx(np.linalg.solve(a, b), abs=2e-4)
    top = MF.capacity(state).first()
    assert top["parameters"] == 4 * len(vec) and top["mean_item_norm"] == pytest.approx(np.mean(np.linalg.norm(y, axis=1) / 2))


def test_model_tables_and_lists(spark, tmp_path):
    state = spark.createDataFrame([("u", 1, [1.0, 0.0]), ("u", 2, [0.0, 1.0])] + [("i", i, [float(i), -float(i)]) for i in range(5)], "kind string, id long, vec array<double>")
    MF.save(state, str(tmp_path / "m"))
    back = MF.load(spark, str(tmp_path / "m"))
    assert sorted(map(str, back.collect())) == sorted(map(str, state.collect()))
    seen = spark.createDataFrame([(1, 4), (1, 3)], PAIR)
    candidates = spark.createDataFrame([(i,) for i in range(5)], "item_id int")
    got = {(r["user_id"], r["position"]): r["item_id"] for r in MF.top_lists(back, candidates, seen, 2).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 1): 0, (2, 2): 1}


def test_drawn_items_are_different_and_unknown(spark):
    """A user who knows nearly all items gets the rest, others get their first draws."""
    items = spark.createDataFrame([(i,) for i in range(60)], "item_id int")
    positive = spark.createDataFrame([(1, i) for i in range(55)] + [(2, 7), (2, 8)], PAIR)
    out = M.sample(positive, spark.createDataFrame([], PAIR), items, "unknown").collect()
    by = {}
    for r in out:
        by.setdefault((r["user_id"], r["item_id"]), set()).add(r["sampled"])
    assert len(out) == 4 * 57 and all(len(v) == 4 for v in by.values())
    assert all(min(v) >= 55 for (u, _), v in by.items() if u == 1) and not by[2, 7] & {7, 8}


def test_hybrid_blends_whole_rows(spark):
    rng = np.random.default_rng(1)
    u, v, cart = rng.normal(size=(7, 3)), rng.normal(size=(23, 3)), rng.integers(0, 9, 23).astype(float)
    users = spark.createDataFrame([(i, x.tolist(), i) for i, x in enumerate(u)], "user_id long, vec array<double>, n_seen long")
    items = spark.createDataFrame([(i, x.tolist(), c) for i, (x, c) in enumerate(zip(v, cart.tolist(), strict=True))], "item_id int, vec array<double>, cart double")
    s = np.round(u @ v.T, 9)
    z = (s - s.mean(1, keepdims=True)) / s.std(1, keepdims=True)
    want = 0.25 * z + 0.75 * (cart - cart.mean()) / cart.std()
    got = {(r["user_id"], r["item_id"]): r["score"] for r in V.hybrid(users, items, [0.25], block=5).collect()}
    assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-8) for i in range(7) for j in range(23))
    best = V.hybrid(users, items, [0.25], 2, "n_seen", block=100).collect()
    assert {(r["user_id"], r["item_id"]) for r in best} == {(i, int(j)) for i in range(7) for j in np.argsort(-want[i])[: 2 + i]}


def test_future_sessions_across_spans(spark):
    t = datetime(2024, 1, 3)
    views = spark.createDataFrame([(1, 1, t), (2, 1, t + timedelta(days=5))], "event_id long, user_id long, ts timestamp_ntz")
    starts = spark.createDataFrame([(1, i, t + timedelta(days=d)) for i, d in enumerate((-1, 0, 0.5, 6.9, 7, 7.1, 11, 13))], "user_id long, session long, started_at timestamp_ntz")
    got = {r["event_id"]: (r["future_sessions"], r["next_session"]) for r in Q.future_sessions(views, starts).collect()}
    assert got == {1: (3, 2), 2: (4, 3)}


def test_order_statistics_of_many_ranges(spark):
    from marlpit.operators import ranking as R

    df = spark.createDataFrame([(float(x * 7 % 101),) for x in range(101)], "v double").repartition(5)
    assert tuple(Q.quartile_thresholds(df, "v").first()) == (25.0, 75.0)
    got = {r["v"]: r["b"] for r in R.group_by_position(df, ["v"], 10, "b").collect()}
    assert got == {float(i): (10 * (i + 1) - 1) // 101 for i in range(101)}


def test_running_sums_over_ranges(spark):
    df = spark.createDataFrame([(i % 50, i - 20) for i in range(200)], "k long, v long").repartition(7)
    held, total = D.running(df, "v", "k", "v")
    got, upto = held.orderBy("k", "v").collect(), 0
    for r in got:
        upto += r["v"]
        assert r["upto"] == upto
    assert total == upto and len(got) == 200
    none, nothing = D.running(df.limit(0), "v", "k")
    assert (none.count(), nothing) == (0, 0)


def test_mid_ranks_of_ties(spark):
    df = spark.createDataFrame([(x,) for x in (3, 1, 3, 7, 3, 1)], "v long")
    assert sorted((r["v"], r["r"]) for r in Q.mid_ranked(df, "v", "r").collect()) == [(1, 1.5), (1, 1.5), (3, 4.0), (3, 4.0), (3, 4.0), (7, 6.0)]
