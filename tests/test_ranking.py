"""Scores, rankings and metrics against their definitions."""

import math

import pytest

from marlpit.operators import dataset as D
from marlpit.operators import ranking as R
from marlpit.operators import representations as P

FACT = "user_id long, item_id int, impression_count long, view_count long, favorite_count long, cart_count long, purchase_count long"


@pytest.fixture
def facts(spark):
    return spark.createDataFrame([(1, 1, 1, 3, 0, 2, 1), (2, 1, 0, 1, 1, 0, 0), (1, 2, 1, 0, 0, 1, 0)], FACT)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "available"), (2, "available"), (3, "sold_out")], "item_id int, status string")


def test_seven_scores(facts, items):
    got = {r["item_id"]: r.asDict() for r in R.popularity_scores(facts, items).collect()}
    one = got[1]
    assert (one["total_view"], one["unique_view_users"], one["favoriteplus"], one["cart"], one["purchase"]) == (4, 2, 2, 2, 1)
    assert one["log_view"] == pytest.approx(math.log(4) + math.log(2))  # a sum of logs, not the log of the sum
    assert one["weighted"] == pytest.approx(math.log(4) + math.log(2) + 3 + 5 + 8)  # carts count once a pair
    assert all(got[3][s] == 0 for s in R.SIGNALS)


def test_weights_are_checked():
    with pytest.raises(ValueError):
        R.Weights(view=-1)
    with pytest.raises(ValueError):
        R.Weights(cart=float("nan"))


def test_ties_go_to_the_smaller_item(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 5.0)], "item_id int, score double")
    assert [r["item_id"] for r in R.ranked(df).orderBy("rank").collect()] == [2, 1, 3]


def metrics(spark, ranking, relevant, seen=(), k=2):
    rank = spark.createDataFrame([(x, i + 1) for i, x in enumerate(ranking)], "item_id int, rank int")
    rel = spark.createDataFrame([(1, x) for x in relevant], "user_id long, item_id int")
    gone = spark.createDataFrame([(1, x) for x in seen], "user_id long, item_id int")
    r = R.macro(R.user_metrics(R.positions(rank, rel, gone), (k,))).first()
    return r["recall"], r["ndcg"], r["hit_rate"], r["precision"]


def test_metrics_by_hand(spark):
    assert metrics(spark, [1, 2], [1, 2]) == (1.0, 1.0, 1.0, 1.0)
    recall, ndcg, hit, precision = metrics(spark, [1, 2], [2])
    assert (recall, hit, precision) == (1.0, 1.0, 0.5) and ndcg == pytest.approx(1 / math.log2(3))
    assert metrics(spark, [1, 2], [9]) == (0.0, 0.0, 0.0, 0.0)


def test_seen_items_leave_the_list_but_not_the_denominator(spark):
    # item 1 is seen: item 3 moves up to place 2, item 1 stays relevant and unreachable
    recall, ndcg, _, precision = metrics(spark, [1, 2, 3], [1, 3], seen=[1])
    assert (recall, precision) == (0.5, 0.5)
    assert ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_top_k_equals_positions(spark):
    rank = spark.createDataFrame([(x, x) for x in range(1, 8)], "item_id int, rank int")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    seen = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "user_id long, item_id int")
    got = {}
    for r in R.top_k(rank, users, seen, 3).collect():
        got.setdefault(r["user_id"], {})[r["position"]] = r["item_id"]
    assert got == {1: {1: 3, 2: 5, 3: 6}, 2: {1: 1, 2: 2, 3: 3}}


def test_repeated_items_count_at_their_first_place(spark):
    lists = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], "user_id long, item_id int, position int")
    rel = spark.createDataFrame([(1, 5)], "user_id long, item_id int")
    assert R.listed_positions(lists, rel).first()["position"] == 1


@pytest.mark.parametrize(("n", "parts"), [(15, 10), (212, 3), (7, 10), (10, 10)])
def test_positional_buckets(spark, n, parts):
    df = spark.createDataFrame([(i,) for i in range(n)], "x long")
    got = [r["b"] for r in R.group_by_position(df, ["x"], parts, "b").orderBy("x").collect()]
    assert got == [next(b for b in range(parts) if b * n // parts <= i < (b + 1) * n // parts) for i in range(n)]


def test_test_split_is_used_once(spark):
    once = R.TestOnce()
    rel = spark.createDataFrame([(1, 5, 1)], "user_id long, item_id int, position int")
    once(rel, (1,))
    with pytest.raises(RuntimeError):
        once(rel, (1,))


def test_percentiles_are_linear(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    r = P.describe(df, "v").first()
    assert (r["p25"], r["median"], r["p75"]) == (1.75, 2.5, 4.75)


def test_both_meanings_of_exposed(spark, facts):
    df = spark.createDataFrame([(1, 1, 1, 0, 0, 0, 0), (1, 2, 1, 0, 1, 0, 0), (1, 3, 0, 2, 0, 0, 0)], FACT)
    positive, _ = P.cart_signal("cartplus")
    first = [r[0] for r in df.select(P.signal_state(positive)).collect()]
    second = [r[0] for r in df.select(P.signal_state(positive, "signal_relative")).collect()]
    assert first == ["observed_non_conversion", "observed_non_conversion", "unknown"]
    assert second == ["unknown", "observed_non_conversion", "observed_non_conversion"]
    assert D.train_seen(facts, "purchase").count() == 1
