"""Queries over popularity, metrics and representations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlpit.operators import dataset as D
from marlpit.operators import ranking as R
from marlpit.operators import representations as P
from marlpit.plans.dataset import _POSITIVE, train
from marlpit.plans.registry import query
from marlpit.sources import adapter as A
from marlpit.sources.adapter import SQL_WORLD as W

KS = (5, 10, 20)
_STRENGTH = "(ln(1 + view_count) + 3.0 * CAST(favorite_count > 0 AS INT) + 5.0 * CAST(cart_count > 0 AS INT) + 8.0 * CAST(purchase_count > 0 AS INT))"
_SUMS = {
    "total_view": "view_count", "unique_view_users": "CAST(view_count > 0 AS INT)", "log_view": "ln(1 + view_count)", "favoriteplus": f"CAST({_POSITIVE['favoriteplus']} AS INT)",
    "cart": "cart_count", "purchase": "purchase_count", "weighted": _STRENGTH,
}
SCORES = W + ", ps AS (SELECT i.item_id, " + ", ".join(f"coalesce(round(sum(CAST({x} AS DOUBLE)), 9), 0.0) AS {n}" for n, x in _SUMS.items()) + " FROM it i LEFT JOIN train t USING (item_id) GROUP BY i.item_id)"
LONG = SCORES + ", ls AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT item_id, '{n}' AS signal, {n} AS score FROM ps" for n in _SUMS) + ")"
RANKED = LONG + ", rk AS MATERIALIZED (SELECT task, signal, item_id, row_number() OVER (PARTITION BY task, signal ORDER BY score DESC, item_id) AS rank FROM ls JOIN cand USING (item_id))"
#: Every user's list without seen items, and metrics of each eligible user.
EVAL = RANKED + """, el AS (SELECT DISTINCT split, task, user_id FROM rel WHERE split <> 'train'),
 li AS (SELECT el.split, rk.task, rk.signal, el.user_id, rk.item_id, row_number() OVER (PARTITION BY el.split, rk.task, rk.signal, el.user_id ORDER BY rk.rank) AS position
   FROM el JOIN rk USING (task) LEFT JOIN seen s ON s.task = rk.task AND s.user_id = el.user_id AND s.item_id = rk.item_id WHERE s.item_id IS NULL),
 pl AS MATERIALIZED (SELECT r.split, r.task, g.signal, r.user_id, r.item_id, li.position FROM rel r CROSS JOIN (SELECT DISTINCT signal FROM ls) g
   LEFT JOIN li ON li.split = r.split AND li.task = r.task AND li.signal = g.signal AND li.user_id = r.user_id AND li.item_id = r.item_id WHERE r.split <> 'train'),
 um AS (SELECT split, task, signal, user_id, k, count(*) AS relevant, count(*) FILTER (position <= k) AS hits, coalesce(sum(CASE WHEN position <= k THEN ln(2) / ln(position + 1) END), 0) AS dcg
   FROM pl CROSS JOIN (VALUES (5), (10), (20)) t(k) GROUP BY ALL),
 me AS MATERIALIZED (SELECT split, task, signal, user_id, k, hits / relevant AS recall, dcg / list_sum(list_transform(range(1, least(k, relevant) + 1), lambda i: ln(2) / ln(i + 1))) AS ndcg,
   CAST(hits > 0 AS INT) AS hit_rate, hits / k AS precision FROM um),
 ma AS MATERIALIZED (SELECT split, task, signal, k, count(*) AS eligible_users, avg(recall) AS recall, avg(ndcg) AS ndcg, avg(hit_rate) AS hit_rate, avg(precision) AS precision FROM me GROUP BY ALL)"""
_MA = "eligible_users, round(recall, 8) AS recall, round(ndcg, 8) AS ndcg, round(hit_rate, 8) AS hit_rate, round(precision, 8) AS precision"


def rounded(df, *names, places=8):
    return df.withColumns({n: F.round(n, places) for n in names})


def scores(s, d):
    return R.popularity_scores(train(s, d), A.items(s, d))


def rankings(s, d):
    """(task, signal, item_id, rank) over each task's candidates."""
    long = R.long_scores(scores(s, d))
    items = A.items(s, d)
    parts = [long.join(D.candidates(items, t), "item_id", "left_semi").withColumn("task", F.lit(t)) for t in D.TASKS]
    return R.ranked(parts[0].unionByName(parts[1]).unionByName(parts[2]), "task", "signal").select("task", "signal", "item_id", "rank")


def placed(s, d):
    """Places of all relevant items of the later splits in all rankings."""
    rel = D.relevance(A.events(s, d))
    signals = F.explode(F.array(*map(F.lit, R.SIGNALS))).alias("signal")
    later = rel.where("split <> 'train'").select("split", "task", "user_id", "item_id", signals)
    seen = rel.where("split = 'train'").select("task", "user_id", "item_id", signals)
    return R.positions(rankings(s, d), later, seen, "task", "signal")


def evaluated(s, d, ks=KS):
    return R.macro(R.user_metrics(placed(s, d), ks, "split", "task", "signal"), "split", "task", "signal")


@query("popularity_scores", SCORES + " SELECT item_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in _SUMS) + " FROM ps")
def popularity_scores(s, d):
    return rounded(scores(s, d), *_SUMS, places=6)


@query("popularity_ranking", RANKED + " SELECT task, signal, item_id, CAST(rank AS INT) AS rank FROM rk")
def popularity_ranking(s, d):
    return rankings(s, d)


def _topk(s, d, seen: bool):
    ranking = rankings(s, d).where("task = 'purchase' and signal = 'cart'")
    return R.top_k(ranking, A.users(s, d), D.train_seen(train(s, d), "purchase") if seen else None, 10)


def topk_of(facts, items, users):
    """``_topk`` without seen items from tables that are there already, by the one ranking that it takes."""
    held = R.popularity_scores(facts, items).select("item_id", F.col("cart").alias("score")).join(D.candidates(items, "purchase"), "item_id", "left_semi")
    return R.top_k(R.ranked(held), users, D.train_seen(facts, "purchase"), 10)


_TOP = RANKED + """, t10 AS (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INT) AS position FROM us CROSS JOIN (SELECT * FROM rk WHERE task = 'purchase' AND signal = 'cart') x
 WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.task = 'purchase' AND s.user_id = us.user_id AND s.item_id = x.item_id) QUALIFY position <= 10)"""


@query("topk_popularity", _TOP + " SELECT user_id, item_id, position FROM t10")
def topk_popularity(s, d):
    return _topk(s, d, True)


@query("topk_include_seen", RANKED + " SELECT user_id, item_id, CAST(rank AS INT) AS position FROM us CROSS JOIN (SELECT * FROM rk WHERE task = 'purchase' AND signal = 'cart' AND rank <= 10) x")
def topk_include_seen(s, d):
    return _topk(s, d, False)


@query("eval_popularity", EVAL + f" SELECT split, task, signal, k, {_MA} FROM ma")
def eval_popularity(s, d):
    return rounded(evaluated(s, d), *R.METRICS)


@query("eval_multi_k", EVAL + f" SELECT k, {_MA} FROM ma WHERE split = 'test' AND task = 'purchase' AND signal = 'cart'")
def eval_multi_k(s, d):
    return rounded(evaluated(s, d).where("split = 'test' and task = 'purchase' and signal = 'cart'").drop("split", "task", "signal"), *R.METRICS)


@query("eval_purchase_cart_at_10", EVAL + f" SELECT {_MA} FROM ma WHERE split = 'test' AND task = 'purchase' AND signal = 'cart' AND k = 10")
def eval_purchase_cart_at_10(s, d):
    """Train cart popularity against Test purchases."""
    held = scores(s, d).select("item_id", F.col("cart").alias("score")).join(D.candidates(A.items(s, d), "purchase"), "item_id", "left_semi")
    rel = D.relevance(A.events(s, d), "purchase")
    later = rel.where("split = 'test'").select("user_id", "item_id")
    seen = rel.where("split = 'train'").select("user_id", "item_id")
    out = R.macro(R.user_metrics(R.positions(R.ranked(held), later, seen), (10,)))
    return rounded(out.drop("k"), *R.METRICS)


@query("stability", EVAL + """ SELECT v.task, v.signal, round(v.recall, 8) AS validation_recall, round(t.recall, 8) AS test_recall, round(t.recall - v.recall, 8) AS recall_delta,
 round(v.ndcg, 8) AS validation_ndcg, round(t.ndcg, 8) AS test_ndcg, round(t.ndcg - v.ndcg, 8) AS ndcg_delta
 FROM ma v JOIN ma t ON t.task = v.task AND t.signal = v.signal AND t.k = v.k AND t.split = 'test' WHERE v.split = 'validation' AND v.k = 10""")
def stability(s, d):
    held = evaluated(s, d, (10,)).groupBy("task", "signal").pivot("split", ["validation", "test"]).agg(F.first("recall").alias("recall"), F.first("ndcg").alias("ndcg"))
    return held.select("task", "signal", *(F.round(x, 8).alias(n) for m in ("recall", "ndcg") for n, x in ((f"validation_{m}", F.col(f"validation_{m}")), (f"test_{m}", F.col(f"test_{m}")), (f"{m}_delta", F.col(f"test_{m}") - F.col(f"validation_{m}")))))


@query("best_baseline", EVAL + """ SELECT task, arg_max(signal, (round(ndcg, 8), round(recall, 8), signal)) AS best_ndcg_signal, round(max(ndcg), 8) AS best_ndcg,
 arg_max(signal, (round(recall, 8), round(ndcg, 8), signal)) AS best_recall_signal, round(max(recall), 8) AS best_recall FROM ma WHERE split = 'test' AND k = 10 GROUP BY task""")
def best_baseline(s, d):
    held = rounded(evaluated(s, d, (10,)).where("split = 'test'"), "recall", "ndcg")
    return held.groupBy("task").agg(
        F.max_by("signal", F.struct("ndcg", "recall", "signal")).alias("best_ndcg_signal"), F.max("ndcg").alias("best_ndcg"),
        F.max_by("signal", F.struct("recall", "ndcg", "signal")).alias("best_recall_signal"), F.max("recall").alias("best_recall"),
    )


_RICH = {"view": "view_count > 0", "favoriteplus": _POSITIVE["favoriteplus"], "cart": "cart_count > 0", "purchase": "purchase_count > 0", "weighted": f"{_STRENGTH} > 0"}


@query("signal_richness", W + ", n AS (SELECT (SELECT count(*) FROM us) * (SELECT count(*) FROM it) AS n) " + " UNION ALL ".join(f"SELECT '{k}' AS signal, count(*) AS pairs, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, round(count(*) / any_value(n), 9) AS density FROM train, n WHERE {x}" for k, x in _RICH.items()))
def signal_richness(s, d):
    held = P.long_values(train(s, d), {k: F.expr(x) if k != "weighted" else R.Weights().strength() > 0 for k, x in _RICH.items()}, "signal").where("value > 0")
    n = A.users(s, d).count() * A.items(s, d).count()
    return held.groupBy("signal").agg(F.count("*").alias("pairs"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.round(F.count("*") / n, 9).alias("density"))


_REP = {"binary_viewplus": "CAST(view_count > 0 AS INT)", "view_count": "view_count", "log_view": "ln(1 + view_count)", "favoriteplus": f"CAST({_POSITIVE['favoriteplus']} AS INT)", "binary_purchase": "CAST(purchase_count > 0 AS INT)", "weighted": _STRENGTH}
_RV = W + ", rv AS (" + " UNION ALL ".join(f"SELECT user_id, item_id, '{n}' AS representation, CAST({x} AS DOUBLE) AS value FROM train" for n, x in _REP.items()) + ")"
_STAT = "count(*) AS n, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, round(min({v}), 6) AS \"min\", round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS p75, round(max({v}), 6) AS \"max\""
STATS = ("mean", "std", "min", "p25", "median", "p75", "max")


@query("representation_values", _RV + " SELECT user_id, item_id, representation, round(value, 6) AS value FROM rv WHERE value > 0")
def representation_values(s, d):
    return rounded(P.long_values(train(s, d), {n: P.representation(n) for n in P.REPRESENTATIONS}, "representation").where("value > 0"), "value", places=6)


@query("representation_stats", _RV + f" SELECT representation, {_STAT.format(v='value')}, round(count(*) / ((SELECT count(*) FROM us) * (SELECT count(*) FROM it)), 9) AS density FROM rv WHERE value > 0 GROUP BY representation")
def representation_stats(s, d):
    return rounded(rounded(P.representation_stats(train(s, d), A.users(s, d).count() * A.items(s, d).count()), *STATS, places=6), "density", places=9)


_ACT = W + ", ac AS (SELECT us.user_id, CAST(coalesce(sum(view_count), 0) AS DOUBLE) AS raw, coalesce(sum(ln(1 + view_count)), 0) AS log FROM us LEFT JOIN train USING (user_id) GROUP BY 1)"


@query("heavy_user", _ACT + """, r AS (SELECT *, row_number() OVER (ORDER BY raw DESC, user_id) <= greatest(1, ceil(count(*) OVER () * 0.01)) AS top FROM ac)
 SELECT count(*) AS users, count(*) FILTER (top) AS top_users, round(sum(raw) FILTER (top) / sum(raw), 8) AS raw_share, round(sum(log) FILTER (top) / sum(log), 8) AS log_share, max(raw) AS max_raw, round(max(log), 8) AS max_log FROM r""")
def heavy_user(s, d):
    return rounded(P.heavy_users(P.activity(train(s, d), A.users(s, d))), "raw_share", "log_share", "max_log")


@query("activity_deciles", _ACT + """, r AS (SELECT *, row_number() OVER (ORDER BY raw DESC, user_id) - 1 AS p, count(*) OVER () AS n FROM ac), b AS (SELECT r.*, t.i AS decile FROM r JOIN range(10) t(i) ON p >= i * n // 10 AND p < (i + 1) * n // 10)
 SELECT CAST(decile + 1 AS INT) AS decile, count(*) AS users, round(avg(raw), 6) AS mean_raw, round(avg(log), 6) AS mean_log FROM b GROUP BY decile""")
def activity_deciles(s, d):
    held = R.group_by_position(P.activity(train(s, d), A.users(s, d)), [F.col("raw").desc(), "user_id"], 10, "decile")
    return held.groupBy((F.col("decile") + 1).alias("decile")).agg(F.count("*").alias("users"), F.round(F.avg("raw"), 6).alias("mean_raw"), F.round(F.avg("log"), 6).alias("mean_log"))


@query("signal_overlap", W + f""" SELECT count(*) FILTER (view_count > 0) AS view_pairs, count(*) FILTER ({_POSITIVE['favoriteplus']}) AS favoriteplus_pairs, count(*) FILTER (purchase_count > 0) AS purchase_pairs,
 count(*) FILTER ({_POSITIVE['favoriteplus']} AND view_count = 0) AS favoriteplus_outside_view, count(*) FILTER (purchase_count > 0 AND view_count = 0) AS purchase_outside_view,
 count(*) FILTER (purchase_count > 0 AND NOT {_POSITIVE['favoriteplus']}) AS purchase_outside_favoriteplus, max(favorite_count) AS max_favorite, max(cart_count) AS max_cart, max(purchase_count) AS max_purchase FROM train""")
def signal_overlap(s, d):
    return P.signal_overlap(train(s, d))


@query("item_train_counts", W + " SELECT item_id, CAST(coalesce(sum(view_count), 0) AS BIGINT) AS views, CAST(coalesce(sum(cart_count), 0) AS BIGINT) AS carts, CAST(coalesce(sum(purchase_count), 0) AS BIGINT) AS purchases, CAST(coalesce(sum(impression_count), 0) AS BIGINT) AS exposures FROM it LEFT JOIN train USING (item_id) GROUP BY item_id")
def item_train_counts(s, d):
    held = train(s, d).groupBy("item_id").agg(F.sum("view_count").alias("views"), F.sum("cart_count").alias("carts"), F.sum("purchase_count").alias("purchases"), F.sum("impression_count").alias("exposures"))
    return A.items(s, d).select("item_id").join(held, "item_id", "left").fillna(0)


_CONF = {"binary_view": ("view_count > 0", "1.0"), "log_view": ("view_count > 0", "1 + ln(1 + view_count)"), "weighted": ("view_count > 0", f"1 + ln(1 + {_STRENGTH})"), "favoriteplus": (_POSITIVE["favoriteplus"], "1.0"), "purchase_only": ("purchase_count > 0", "1.0")}
_CV = W + ", cv AS (" + " UNION ALL ".join(f"SELECT user_id, item_id, '{n}' AS representation, CAST({x} AS DOUBLE) AS confidence FROM train WHERE {p}" for n, (p, x) in _CONF.items()) + ")"


def confidences(s, d):
    parts = {n: F.when(p, c) for n in P.CONFIDENCES for p, c in [P.confidence(n)]}
    return P.long_values(train(s, d), parts, "representation", "confidence").where("confidence is not null")


@query("confidence_values", _CV + " SELECT user_id, item_id, representation, round(confidence, 6) AS confidence FROM cv")
def confidence_values(s, d):
    return rounded(confidences(s, d), "confidence", places=6)


@query("confidence_stats", _CV + f" SELECT representation, {_STAT.format(v='confidence')} FROM cv GROUP BY representation")
def confidence_stats(s, d):
    return rounded(P.describe(confidences(s, d), "confidence", "representation"), *STATS, places=6)


@query("coverage", _CV + """, n AS (SELECT (SELECT count(*) FROM us) AS u, (SELECT count(*) FROM it) AS i)
 SELECT representation, count(*) AS positive_pairs, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, any_value(u) - count(DISTINCT user_id) AS cold_users, any_value(i) - count(DISTINCT item_id) AS cold_items,
 round(count(*) / (any_value(u) * any_value(i)), 9) AS density FROM cv, n GROUP BY representation""")
def coverage(s, d):
    return rounded(P.coverage(confidences(s, d), A.users(s, d).count(), A.items(s, d).count(), "representation"), "density", places=9)


_CART = {
    "existing_weighted": ("view_count > 0", _STRENGTH), "cartplus": ("(cart_count > 0 OR purchase_count > 0)", "5.0 * CAST(cart_count > 0 AS INT) + 8.0 * CAST(purchase_count > 0 AS INT)"),
    "favorite_cartplus": (_POSITIVE["favoriteplus"], "3.0 * CAST(favorite_count > 0 AS INT) + 5.0 * CAST(cart_count > 0 AS INT) + 8.0 * CAST(purchase_count > 0 AS INT)"),
    "cart_centered_weighted": ("view_count > 0", "0.5 * ln(1 + view_count) + 2.0 * CAST(favorite_count > 0 AS INT) + 6.0 * CAST(cart_count > 0 AS INT) + 10.0 * CAST(purchase_count > 0 AS INT)"),
}


@query("cart_signal_states", W + " " + " UNION ALL ".join(f"""SELECT '{n}' AS signal, '{e}' AS exposed_def, state, count(*) AS pairs, round(avg(confidence), 6) AS mean_confidence FROM (SELECT CASE WHEN {p} THEN 'positive' WHEN {x} THEN 'observed_non_conversion' ELSE 'unknown' END AS state,
 CASE WHEN {p} THEN 1 + ln(1 + {v}) ELSE 1.0 END AS confidence FROM train) GROUP BY state""" for n, (p, v) in _CART.items() for e, x in (("impression_no_view", "impression_count > 0 AND view_count = 0"), ("signal_relative", "view_count > 0 OR favorite_count > 0"))))
def cart_signal_states(s, d):
    """Pools of each cart signal under both meanings of exposed, among observed pairs."""
    rows = []
    for n in P.CART_SIGNALS:
        positive, strength = P.cart_signal(n)
        for e in ("impression_no_view", "signal_relative"):
            rows.append(F.struct(F.lit(n).alias("signal"), F.lit(e).alias("exposed_def"), P.signal_state(positive, e).alias("state"), F.when(positive, 1 + F.log1p(strength)).otherwise(1.0).alias("confidence")))
    held = train(s, d).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return held.groupBy("signal", "exposed_def", "state").agg(F.count("*").alias("pairs"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("top10_items", W + " SELECT item_id, count(*) AS n FROM ev WHERE event_type = 'impression' GROUP BY item_id ORDER BY n DESC, item_id LIMIT 10")
def top10_items(s, d):
    return A.events(s, d).where("event_type = 'impression'").groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "item_id").limit(10)


@query("cold_users_items", W + " SELECT 'user' AS kind, CAST(user_id AS BIGINT) AS id FROM us WHERE user_id NOT IN (SELECT user_id FROM train WHERE view_count > 0) UNION ALL SELECT 'item', CAST(item_id AS BIGINT) FROM it WHERE item_id NOT IN (SELECT item_id FROM train WHERE view_count > 0)")
def cold_users_items(s, d):
    hot = train(s, d).where("view_count > 0")
    cold = lambda dim, key, kind: dim.select(key).join(hot, key, "left_anti").select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"))
    return cold(A.users(s, d), "user_id", "user").unionByName(cold(A.items(s, d), "item_id", "item"))


@query("signal_alignment", W + """, p AS (SELECT DISTINCT user_id, item_id FROM rel WHERE split = 'test' AND task = 'purchase'), t AS (SELECT user_id, item_id FROM train WHERE view_count > 0),
 u AS (SELECT p.user_id, count(t.item_id) AS overlap, (SELECT count(*) FROM t x WHERE x.user_id = p.user_id) AS positives FROM p LEFT JOIN t ON t.user_id = p.user_id AND t.item_id = p.item_id GROUP BY p.user_id)
 SELECT count(*) AS eligible_users, count(*) FILTER (positives > 0) AS with_positive, count(*) FILTER (positives = 0) AS without_positive, count(*) FILTER (overlap > 0) AS continuing,
 round(count(*) FILTER (overlap > 0) / count(*), 8) AS continuing_rate, round(avg(overlap), 8) AS mean_overlap FROM u""")
def signal_alignment(s, d):
    want = D.relevance(A.events(s, d), "purchase").where("split = 'test'").select("user_id", "item_id")
    own = train(s, d).where("view_count > 0").select("user_id", "item_id", F.lit(1).alias("known"))
    per = want.join(own, ["user_id", "item_id"], "left").groupBy("user_id").agg(F.count("known").alias("overlap"))
    held = per.join(own.groupBy("user_id").agg(F.count("*").alias("positives")), "user_id", "left").fillna(0, ["positives"])
    hit = F.col("overlap") > 0
    return held.agg(
        F.count("*").alias("eligible_users"), F.count_if(F.col("positives") > 0).alias("with_positive"), F.count_if(F.col("positives") == 0).alias("without_positive"), F.count_if(hit).alias("continuing"),
        F.round(F.try_divide(F.count_if(hit), F.count("*")), 8).alias("continuing_rate"), F.round(F.avg("overlap"), 8).alias("mean_overlap"),
    )


_UM10 = EVAL + ", u10 AS (SELECT * FROM me WHERE split = 'test' AND task = 'purchase' AND signal = 'cart' AND k = 10)"
_GROUP = "count(*) AS users, round(avg(recall), 8) AS recall, round(avg(ndcg), 8) AS ndcg, round(avg(hit_rate), 8) AS hit_rate, round(avg(precision), 8) AS precision"


def cart_places(s, d, rel=None):
    """Places of Test purchases in the cart ranking."""
    ranking = rankings(s, d).where("task = 'purchase' and signal = 'cart'").select("item_id", "rank")
    every = D.relevance(A.events(s, d), "purchase")
    later = every.where("split = 'test'").select("user_id", "item_id") if rel is None else rel
    return R.positions(ranking, later, every.where("split = 'train'").select("user_id", "item_id"))


def grouped(per_user, *by):
    return per_user.groupBy(*by).agg(F.count("*").alias("users"), *(F.round(F.avg(m), 8).alias(m) for m in R.METRICS))


@query("evaluation_bundle", W + """ SELECT 'relevance' AS part, split, task, count(*) AS rows, count(DISTINCT user_id) AS users FROM rel WHERE split <> 'train' GROUP BY 2, 3 UNION ALL SELECT 'seen', 'train', task, count(*), count(DISTINCT user_id) FROM seen GROUP BY 3
 UNION ALL SELECT 'candidates', 'all', task, count(*), 0 FROM cand GROUP BY 3""")
def evaluation_bundle(s, d):
    """What an evaluation rests on: relevance of two splits, seen pairs and candidates of each task, with their sizes."""
    rel = D.relevance(A.events(s, d)).withColumn("part", F.when(F.col("split") == "train", "seen").otherwise("relevance"))
    pairs = rel.groupBy("part", "split", "task").agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"))
    items = A.items(s, d)
    for task in D.TASKS:
        pairs = pairs.unionByName(D.candidates(items, task).agg(F.count("*").alias("rows")).select(F.lit("candidates").alias("part"), F.lit("all").alias("split"), F.lit(task).alias("task"), "rows", F.lit(0).cast("long").alias("users")))
    return pairs


@query("fallback_groups", _UM10 + f" SELECT CASE WHEN user_id IN (SELECT user_id FROM train WHERE purchase_count > 0) THEN 'learned' ELSE 'fallback' END AS grp, {_GROUP} FROM u10 GROUP BY 1")
def fallback_groups(s, d):
    known = train(s, d).where("purchase_count > 0").select("user_id", F.lit("learned").alias("g")).distinct()
    held = R.user_metrics(cart_places(s, d), (10,)).join(known, "user_id", "left")
    return grouped(held, F.coalesce("g", F.lit("fallback")).alias("grp"))


@query("backfill_groups", _UM10 + f", sx AS (SELECT user_id, count(*) AS n FROM train WHERE view_count = 0 AND impression_count > 0 GROUP BY 1) SELECT CASE WHEN coalesce(n, 0) < 4 THEN 'backfilled' ELSE 'exposed_only' END AS grp, {_GROUP} FROM u10 LEFT JOIN sx USING (user_id) GROUP BY 1")
def backfill_groups(s, d):
    """Users whose exposed pool is too small for a sampled positive against the others."""
    pool = train(s, d).where("view_count = 0 and impression_count > 0").groupBy("user_id").agg(F.count("*").alias("n"))
    held = R.user_metrics(cart_places(s, d), (10,)).join(pool, "user_id", "left")
    return grouped(held, F.when(F.coalesce("n", F.lit(0)) < 4, "backfilled").otherwise("exposed_only").alias("grp"))


@query("history_groups", _UM10 + f""", h AS (SELECT user_id, count(*) AS n FROM train WHERE view_count > 0 GROUP BY 1), o AS (SELECT u10.*, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0), user_id) - 1 AS p, count(*) OVER () AS c FROM u10 LEFT JOIN h USING (user_id))
 SELECT CASE WHEN p < c // 3 THEN 'low' WHEN p < 2 * c // 3 THEN 'medium' ELSE 'high' END AS grp, min(n) AS min_pairs, max(n) AS max_pairs, round(avg(n), 8) AS mean_pairs, {_GROUP} FROM o GROUP BY 1""")
def history_groups(s, d):
    own = train(s, d).where("view_count > 0").groupBy("user_id").agg(F.count("*").alias("n"))
    held = R.user_metrics(cart_places(s, d), (10,)).join(own, "user_id", "left").fillna(0, ["n"])
    held = R.group_by_position(held, ["n", "user_id"], 3, "g").withColumn("grp", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("g") + 1))
    return held.groupBy("grp").agg(F.min("n").alias("min_pairs"), F.max("n").alias("max_pairs"), F.round(F.avg("n"), 8).alias("mean_pairs"), F.count("*").alias("users"), *(F.round(F.avg(m), 8).alias(m) for m in R.METRICS))


@query("popularity_groups", EVAL + f""", ig AS (SELECT item_id, cart, CASE WHEN p < c // 3 THEN 'low' WHEN p < 2 * c // 3 THEN 'medium' ELSE 'high' END AS grp FROM (SELECT item_id, cart, row_number() OVER (ORDER BY cart, item_id) - 1 AS p, count(*) OVER () AS c FROM ps JOIN it USING (item_id) WHERE status = 'available')),
 gp AS (SELECT grp, user_id, count(*) AS relevant, count(*) FILTER (position <= 10) AS hits, coalesce(sum(CASE WHEN position <= 10 THEN ln(2) / ln(position + 1) END), 0) AS dcg FROM pl JOIN ig USING (item_id) WHERE split = 'test' AND task = 'purchase' AND signal = 'cart' GROUP BY 1, 2),
 gm AS (SELECT grp, count(*) AS users, round(avg(hits / relevant), 8) AS recall, round(avg(dcg / list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: ln(2) / ln(i + 1)))), 8) AS ndcg, round(avg(CAST(hits > 0 AS INT)), 8) AS hit_rate, round(avg(hits / 10), 8) AS precision FROM gp GROUP BY grp),
 gi AS (SELECT grp, count(*) AS items, min(cart) AS min_cart, max(cart) AS max_cart, round(avg(cart), 8) AS mean_cart FROM ig GROUP BY grp) SELECT * FROM gi JOIN gm USING (grp)""")
def popularity_groups(s, d):
    """Metrics with relevance narrowed to a third of the candidates by cart popularity."""
    held = scores(s, d).select("item_id", "cart").join(D.candidates(A.items(s, d), "purchase"), "item_id", "left_semi")
    parts = R.group_by_position(held, ["cart", "item_id"], 3, "g").withColumn("grp", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("g") + 1)).drop("g")
    per = R.user_metrics(cart_places(s, d).join(parts.select("item_id", "grp"), "item_id"), (10,), "grp")
    sizes = parts.groupBy("grp").agg(F.count("*").alias("items"), F.min("cart").alias("min_cart"), F.max("cart").alias("max_cart"), F.round(F.avg("cart"), 8).alias("mean_cart"))
    return sizes.join(grouped(per, "grp"), "grp")


@query("pairwise_overlap", _TOP + """, l AS (SELECT * FROM t10 WHERE user_id IN (SELECT user_id FROM rel WHERE split = 'test' AND task = 'purchase'))
 SELECT count(DISTINCT a.user_id) AS users, round(sum(o) / 10 / (any_value(n) * (any_value(n) - 1) / 2), 8) AS mean_overlap FROM (SELECT x.user_id, count(*) AS o FROM l x JOIN l y ON x.item_id = y.item_id AND x.user_id < y.user_id GROUP BY 1) b RIGHT JOIN (SELECT DISTINCT user_id FROM l) a USING (user_id), (SELECT count(DISTINCT user_id) AS n FROM l) c""")
def pairwise_overlap(s, d):
    """Mean overlap of all pairs of lists: an item in n lists is shared by n(n-1)/2 pairs, so pairs are never formed."""
    want = D.relevance(A.events(s, d), "purchase").where("split = 'test'").select("user_id").distinct()
    lists = _topk(s, d, True).join(want, "user_id", "left_semi")
    shared = lists.groupBy("item_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("shared"))
    users = lists.agg(F.countDistinct("user_id").alias("users"))
    return users.crossJoin(shared).select("users", F.round(F.try_divide(F.col("shared") / 10, F.col("users") * (F.col("users") - 1) / 2), 8).alias("mean_overlap"))


@query("personalization", _TOP + """, l AS (SELECT * FROM t10 WHERE user_id IN (SELECT user_id FROM rel WHERE split = 'test' AND task = 'purchase')),
 s AS (SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY position) AS items FROM l GROUP BY 1)
 SELECT (SELECT count(DISTINCT items) FROM s) AS unique_lists, (SELECT count(*) FROM s) AS users, count(DISTINCT item_id) AS items, round(avg(cart), 8) AS mean_cart FROM l JOIN ps USING (item_id)""")
def personalization(s, d):
    want = D.relevance(A.events(s, d), "purchase").where("split = 'test'").select("user_id").distinct()
    lists = _topk(s, d, True).join(want, "user_id", "left_semi")
    whole = lists.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("position", "item_id"))).alias("items")).agg(F.countDistinct("items").alias("unique_lists"), F.count("*").alias("users"))
    carts = lists.join(scores(s, d).select("item_id", "cart"), "item_id").agg(F.countDistinct("item_id").alias("items"), F.round(F.avg("cart"), 8).alias("mean_cart"))
    return whole.crossJoin(carts)
