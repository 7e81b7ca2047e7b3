"""Queries over samples, sessions, funnels and separability."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlpit.operators import dataset as D
from marlpit.operators import representations as P
from marlpit.operators import sampling as M
from marlpit.operators import sequences as Q
from marlpit.operators import validation as V
from marlpit.plans.dataset import train
from marlpit.plans.ranking import rounded
from marlpit.plans.registry import oracle_of, query
from marlpit.sources import adapter as A
from marlpit.sources.adapter import SQL_WORLD as W

SEED = 42
# Pools of the viewplus task: exposed is impressed without a view, unknown is the rest of the universe.
_POOLS = W + """, pos AS (SELECT user_id, item_id FROM train WHERE view_count > 0), ex AS (SELECT user_id, item_id FROM train WHERE view_count = 0 AND impression_count > 0),
 kn AS (SELECT * FROM pos UNION ALL SELECT * FROM ex), ix AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS n FROM it),
 tr AS (SELECT user_id, item_id, t, """ + f"CAST('0x' || substr(md5('{SEED}:' || user_id || ':' || item_id || ':' || t), 1, 15) AS BIGINT) AS h FROM pos, range({M.ATTEMPTS}) r(t))" + """,
 dr AS (SELECT user_id, tr.item_id, ix.item_id AS sampled, min(t) AS t FROM tr JOIN ix ON ix.idx = h % ix.n WHERE (user_id, ix.item_id) NOT IN (SELECT (user_id, item_id) FROM kn) GROUP BY 1, 2, 3),
 gt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY t) AS r FROM dr QUALIFY r <= 4),
 sr AS MATERIALIZED (SELECT pos.user_id, pos.item_id, count(gt.sampled) AS got FROM pos LEFT JOIN gt ON gt.user_id = pos.user_id AND gt.item_id = pos.item_id GROUP BY 1, 2 HAVING count(gt.sampled) < 4),
 un AS (SELECT user_id, item_id FROM (SELECT DISTINCT user_id FROM sr) CROSS JOIN it WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM kn))"""


def _places(pool: str, wanting: str, n: int) -> str:
    """Consecutive places of a user's pool in its hash order, from a hashed start on."""
    order = f"CAST('0x' || substr(md5('{SEED}:' || user_id || ':' || item_id), 1, 15) AS BIGINT)"
    held = f"(SELECT user_id, item_id AS sampled, row_number() OVER (PARTITION BY user_id ORDER BY {order}, item_id) - 1 AS slot, count(*) OVER (PARTITION BY user_id) AS m FROM {pool})"
    return f"(SELECT p.user_id, p.item_id, q.sampled, t FROM (SELECT user_id, item_id, {order} AS h FROM {wanting}) p CROSS JOIN range({n}) r(t) JOIN {held} q ON q.user_id = p.user_id AND t < q.m AND q.slot = (p.h + t) % q.m)"


_REST = f"""rs AS MATERIALIZED (SELECT user_id, item_id, sampled, r FROM gt UNION ALL SELECT user_id, item_id, sampled, r FROM (SELECT m.user_id, m.item_id, m.sampled, got + row_number() OVER (PARTITION BY m.user_id, m.item_id ORDER BY m.t) AS r
 FROM {_places("un", "sr", 8)} m JOIN sr USING (user_id, item_id) WHERE (m.user_id, m.item_id, m.sampled) NOT IN (SELECT (user_id, item_id, sampled) FROM gt)) WHERE r <= 4)"""


def _sampled(wanted: int) -> str:
    if not wanted:
        return _POOLS + f", {_REST}, sm AS (SELECT user_id, item_id, sampled, 'random_unknown' AS source, false AS is_backfill FROM rs)"
    return _POOLS + f""", {_REST}, sh AS MATERIALIZED {_places("ex", "pos", wanted)}, got AS (SELECT user_id, item_id, count(*) AS got FROM sh GROUP BY ALL),
 sm AS (SELECT user_id, item_id, sampled, 'exposed_non_conversion' AS source, false AS is_backfill FROM sh UNION ALL
  SELECT user_id, item_id, sampled, 'random_unknown', r > {4 - wanted} FROM rs LEFT JOIN got USING (user_id, item_id) WHERE r <= 4 - coalesce(got, 0))"""


def pools(s, d):
    """(positives, exposed pairs, items) of the viewplus task in train."""
    facts = train(s, d)
    return facts.where("view_count > 0").select("user_id", "item_id"), facts.where("view_count = 0 and impression_count > 0").select("user_id", "item_id"), A.items(s, d).select("item_id")


def samples(s, d, strategy):
    return M.sample(*pools(s, d), strategy, SEED)


for _name, _wanted in (("unknown", 0), ("exposed", 4), ("mixed", 2)):

    @query(f"sample_{_name}", _sampled(_wanted) + " SELECT user_id, item_id, sampled, source, is_backfill FROM sm")
    def sampled(s, d, strategy=_name):
        return samples(s, d, strategy)


@query("sampling_stats", _sampled(4) + """, c AS (SELECT sampled, count(*) AS c FROM sm GROUP BY 1), g AS (SELECT sum(i * c) AS w, count(*) AS n, sum(c) AS t FROM (SELECT c, row_number() OVER (ORDER BY c) AS i FROM c))
 SELECT count(*) AS total, count(DISTINCT (user_id, sampled)) AS unique_pairs, count(*) FILTER (source = 'random_unknown') AS random_unknown, count(*) FILTER (source <> 'random_unknown') AS exposed,
 round(count(*) FILTER (source <> 'random_unknown') / count(*), 8) AS exposed_share, count(*) FILTER (is_backfill) AS backfill, round(count(*) FILTER (is_backfill) / count(*), 8) AS backfill_rate, count(DISTINCT user_id) AS users,
 count(DISTINCT sampled) AS items, (SELECT count(*) FROM it) - count(DISTINCT sampled) AS never_sampled, round((SELECT (2 * w - (n + 1) * t) / (n * t) FROM g), 8) AS gini,
 round((SELECT sum(c) FROM (SELECT c FROM c ORDER BY c DESC, sampled LIMIT 10)) / count(*), 8) AS top10_share FROM sm""")
def sampling_stats(s, d):
    return rounded(M.sampling_stats(samples(s, d, "exposed"), A.items(s, d).count()), "exposed_share", "backfill_rate", "gini", "top10_share")


@query("hardness", _sampled(2) + """, c AS (SELECT item_id, coalesce(sum(cart_count), 0) AS carts, coalesce(sum(impression_count), 0) AS exposures FROM it LEFT JOIN train USING (item_id) GROUP BY 1), j AS (SELECT sm.source, carts, exposures FROM sm JOIN c ON c.item_id = sm.sampled),
 k AS (SELECT * FROM j UNION ALL SELECT 'all', carts, exposures FROM j)
 SELECT source, count(*) AS n, round(avg(carts), 6) AS mean_cart, round(quantile_cont(CAST(carts AS DOUBLE), 0.5), 6) AS median_cart, round(stddev_pop(carts), 6) AS std_cart, round(avg(exposures), 6) AS mean_exposure,
 round(quantile_cont(CAST(exposures AS DOUBLE), 0.5), 6) AS median_exposure, round(stddev_pop(exposures), 6) AS std_exposure FROM k GROUP BY source""")
def hardness(s, d):
    counts = train(s, d).groupBy("item_id").agg(F.sum("cart_count").alias("carts"), F.sum("impression_count").alias("exposures"))
    every = A.items(s, d).select("item_id").join(counts, "item_id", "left").fillna(0)
    return rounded(M.hardness(samples(s, d, "mixed"), every), "mean_cart", "median_cart", "std_cart", "mean_exposure", "median_exposure", "std_exposure", places=6)


@query("bce_examples", _sampled(4) + " SELECT p.user_id, p.item_id, 1 AS label, round(1 + ln(1 + t.view_count), 6) AS confidence FROM pos p JOIN train t USING (user_id, item_id) UNION ALL SELECT user_id, sampled, 0, 1.0 FROM sm")
def bce_examples(s, d):
    positive, confidence = P.confidence("log_view")
    own = train(s, d).where(positive).select("user_id", "item_id", F.round(confidence, 6).alias("confidence"))
    return M.bce_examples(own, samples(s, d, "exposed"))


# Sessions: a new one starts after a gap of a day.
SESS = W + """, sv AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 1440 MINUTES THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 se AS (SELECT * EXCLUDE (new), CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM sv)"""


def sessionized(s, d):
    return Q.sessionize(A.events(s, d))


@query("session_ordinal", SESS + " SELECT event_id, user_id, session FROM se")
def session_ordinal(s, d):
    return sessionized(s, d).select("event_id", "user_id", "session")


@query("session_summary", SESS + """, x AS (SELECT user_id, session, count(*) AS events, count(*) FILTER (event_type = 'impression') AS impressions, date_diff('second', min(ts), max(ts)) AS dur FROM se GROUP BY 1, 2)
 SELECT count(*) AS sessions, count(DISTINCT user_id) AS users, round(avg(events), 6) AS mean_events, round(avg(impressions), 6) AS mean_impressions, max(impressions) AS max_impressions, round(stddev_pop(impressions), 6) AS std_impressions FROM x""")
def session_summary(s, d):
    return Q.sessions(sessionized(s, d)).agg(
        F.count("*").alias("sessions"), F.countDistinct("user_id").alias("users"), F.round(F.avg("events"), 6).alias("mean_events"), F.round(F.avg("impressions"), 6).alias("mean_impressions"),
        F.max("impressions").alias("max_impressions"), F.round(F.stddev_pop("impressions"), 6).alias("std_impressions"),
    )


@query("session_rows", SESS + """ SELECT user_id, session, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS ended_at, date_sub('second', min(ts), max(ts)) AS duration_seconds, count(*) AS events,
 count(*) FILTER (event_type = 'impression') AS impressions FROM se GROUP BY 1, 2""")
def session_rows(s, d):
    """Sessions as they are exported: times with a Z, duration in whole seconds."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    return Q.sessions(sessionized(s, d)).select("user_id", "session", stamp("started_at"), stamp("ended_at"), "duration_seconds", "events", "impressions")


@query("ts_monotonic_audit", SESS + " SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS b FROM se) WHERE ts <= b")
def ts_monotonic_audit(s, d):
    return Q.not_increasing(sessionized(s, d)).select("event_id")


@query("view_needs_impression", SESS + " SELECT event_id FROM (SELECT event_id, event_type, max(CAST(event_type = 'impression' AS INT)) OVER (PARTITION BY user_id, session, item_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM se) WHERE event_type = 'view' AND shown = 0")
def view_needs_impression(s, d):
    return Q.views_without_impression(sessionized(s, d)).select("event_id")


@query("continuity", SESS + """, c AS (SELECT *, item_id % 8 AS category FROM se), l AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN category END IGNORE NULLS) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM c)
 SELECT count(*) AS eligible, round(avg(CAST(category = last AS INT)), 8) AS same_share FROM l WHERE event_type = 'impression' AND last IS NOT NULL""")
def continuity(s, d):
    return rounded(Q.continuity(sessionized(s, d).withColumn("category", F.col("item_id") % 8)), "same_share")


@query("running_view_count", W + " SELECT event_id, user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) AS INT) AS view_count FROM ev WHERE event_type = 'view'")
def running_view_count(s, d):
    return Q.running_view_count(A.events(s, d))


_PRIOR = W + """, pr AS (SELECT *, coalesce(max(CAST(event_type = 'favorite' AS INT)) OVER w, 0) AS had_favorite, coalesce(max(CAST(event_type = 'add_to_cart' AS INT)) OVER w, 0) AS had_cart, count(*) FILTER (event_type = 'view') OVER w AS views_before
 FROM ev WINDOW w AS (PARTITION BY user_id, item_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("prior_state_flags", _PRIOR + " SELECT event_id, event_type, had_favorite, had_cart, views_before FROM pr WHERE event_type IN ('favorite','add_to_cart','purchase')")
def prior_state_flags(s, d):
    return Q.prior_state_flags(A.events(s, d)).select("event_id", "event_type", "had_favorite", "had_cart", "views_before")


@query("future_sessions_7d", SESS + """, st AS (SELECT user_id, session, min(ts) AS started_at FROM se GROUP BY 1, 2)
 SELECT v.event_id, count(*) AS future_sessions, min(s.session) AS next_session FROM ev v JOIN st s ON s.user_id = v.user_id AND s.started_at > v.ts AND s.started_at <= v.ts + INTERVAL 7 DAY WHERE v.event_type = 'view' GROUP BY 1""")
def future_sessions_7d(s, d):
    held = sessionized(s, d)
    return Q.future_sessions(held.where(Q.kind("view")).select("event_id", "user_id", "ts"), Q.sessions(held).select("user_id", "session", "started_at"))


_SRC = W + """, sc AS (SELECT e.event_id, e.event_type, e.ts, e.user_id, e.item_id, arg_max(v.event_id, (v.ts, v.event_id)) AS source_view, max(v.ts) AS view_ts FROM ev e LEFT JOIN ev v ON v.event_type = 'view' AND v.user_id = e.user_id AND v.item_id = e.item_id AND v.ts < e.ts
 WHERE e.event_type IN ('favorite','add_to_cart','purchase') GROUP BY ALL)"""


@query("source_view_audit", _SRC + " SELECT event_id, event_type, source_view FROM sc")
def source_view_audit(s, d):
    return Q.source_views(A.events(s, d)).select("event_id", "event_type", "source_view")


@query("conversion_timing", SESS + _SRC[len(W):] + """ SELECT sc.event_type, CASE WHEN a.session = b.session THEN 'same_session' ELSE 'later_session' END AS timing, count(*) AS n FROM sc JOIN se a ON a.event_id = sc.event_id JOIN se b ON b.event_id = sc.source_view GROUP BY 1, 2""")
def conversion_timing(s, d):
    held = sessionized(s, d)
    own = held.select("event_id", "session")
    found = Q.source_views(held).where("source_view is not null").join(own, "event_id").join(own.select(F.col("event_id").alias("source_view"), F.col("session").alias("view_session")), "source_view")
    timing = F.when(F.col("session") == F.col("view_session"), "same_session").otherwise("later_session")
    return found.groupBy("event_type", timing.alias("timing")).agg(F.count("*").alias("n"))


@query("funnel_conversion", W + """, p AS (SELECT user_id, item_id, sum(impression_count) AS i, sum(view_count) AS v, sum(favorite_count) AS f, sum(cart_count) AS c, sum(purchase_count) AS b FROM facts GROUP BY 1, 2)
 SELECT CAST(sum(i) AS BIGINT) AS impressions, CAST(sum(v) AS BIGINT) AS views, CAST(sum(f) AS BIGINT) AS favorites, CAST(sum(c) AS BIGINT) AS carts, CAST(sum(b) AS BIGINT) AS purchases,
 round(sum(v) / sum(i), 8) AS impression_to_view, round(sum(f) / sum(v), 8) AS view_to_favorite, round(sum(c) / sum(v), 8) AS view_to_cart, round(sum(b) / sum(v), 8) AS view_to_purchase,
 round(count(*) FILTER (f > 0 AND c > 0) / count(*) FILTER (f > 0), 8) AS favorite_to_cart, round(count(*) FILTER (f > 0 AND b > 0) / count(*) FILTER (f > 0), 8) AS favorite_to_purchase, round(count(*) FILTER (c > 0 AND b > 0) / count(*) FILTER (c > 0), 8) AS cart_to_purchase FROM p""")
def funnel_conversion(s, d):
    names = ("impression_to_view", "view_to_favorite", "view_to_cart", "view_to_purchase", "favorite_to_cart", "favorite_to_purchase", "cart_to_purchase")
    return rounded(Q.funnel(D.with_split(A.events(s, d)).where("split is not null")), *names)


@query("funnel_paths", W + """, p AS (SELECT user_id, item_id, string_agg(event_type, ' → ' ORDER BY ts, event_id) FILTER (event_type IN ('favorite','add_to_cart','purchase')) AS steps FROM ev GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'view') > 0)
 SELECT 'view → ' || coalesce(steps, 'exit') AS path, count(*) AS pairs FROM p GROUP BY 1""")
def funnel_paths(s, d):
    return Q.paths(A.events(s, d))


@query("view_rates", W + """, x AS (SELECT 'category' AS key, CAST(item_id % 8 AS VARCHAR) AS value, event_type FROM ev UNION ALL SELECT 'segment', CAST(user_id % 5 AS VARCHAR), event_type FROM ev UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), event_type FROM ev),
 c AS (SELECT key, value, count(*) FILTER (event_type = 'impression') AS impressions, count(*) FILTER (event_type = 'view') AS views FROM x GROUP BY 1, 2) SELECT key, value, impressions, views, round(views / impressions, 8) AS view_rate FROM c WHERE impressions > 0""")
def view_rates(s, d):
    held = A.events(s, d).withColumns({"category": F.col("item_id") % 8, "segment": F.col("user_id") % 5})
    return rounded(Q.view_rates(held, "category", "segment", "user_id"), "view_rate")


@query("funnel_by_group", W + """, x AS (SELECT c_mktsegment AS grp, event_type FROM ev JOIN customer ON c_custkey = user_id), c AS (SELECT grp, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'favorite') AS favorites,
 count(*) FILTER (event_type = 'add_to_cart') AS carts, count(*) FILTER (event_type = 'purchase') AS purchases FROM x GROUP BY 1)
 SELECT grp, views, favorites, carts, purchases, round(favorites / views, 8) AS favorite_rate, round(carts / views, 8) AS cart_rate, round(purchases / views, 8) AS purchase_rate FROM c""")
def funnel_by_group(s, d):
    held = A.events(s, d).join(A.read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("grp")), "user_id")
    c = held.groupBy("grp").agg(*(F.count_if(Q.kind(k)).alias(n) for k, n in (("view", "views"), ("favorite", "favorites"), ("add_to_cart", "carts"), ("purchase", "purchases"))))
    return c.select("*", *(F.round(F.try_divide(n, "views"), 8).alias(r) for n, r in (("favorites", "favorite_rate"), ("carts", "cart_rate"), ("purchases", "purchase_rate"))))


@query("exposure_concentration", W + """, c AS (SELECT item_id, count(*) AS c FROM ev WHERE event_type = 'impression' GROUP BY 1), r AS (SELECT c, row_number() OVER (ORDER BY c) AS i, row_number() OVER (ORDER BY c DESC, item_id) AS d FROM c)
 SELECT round(2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1) / count(*), 8) AS gini, round(sum(c) FILTER (d <= 10) / sum(c), 8) AS top10_share, (SELECT count(*) FROM it) - count(*) AS zero_items, min(c) AS minimum, quantile_cont(CAST(c AS DOUBLE), 0.5) AS median, max(c) AS maximum FROM r""")
def exposure_concentration(s, d):
    return rounded(Q.concentration(A.events(s, d).where(Q.kind("impression")), A.items(s, d).count()), "gini", "top10_share")


@query("purchase_concentration", W + """, c AS (SELECT it.item_id, count(e.event_id) AS c FROM it LEFT JOIN ev e ON e.item_id = it.item_id AND e.event_type = 'purchase' GROUP BY 1), r AS (SELECT c, row_number() OVER (ORDER BY c) AS i FROM c)
 SELECT round((2 * sum(i * c) - (count(*) + 1) * sum(c)) / (count(*) * sum(c)), 8) AS gini FROM r""")
def purchase_concentration(s, d):
    """Gini over the full item list, zeros included."""
    bought = A.events(s, d).where(Q.kind("purchase")).groupBy("item_id").agg(F.count("*").alias("c"))
    return rounded(M.gini(A.items(s, d).select("item_id").join(bought, "item_id", "left").fillna(0), "c"), "gini")


#: A pair's last view in event order; its value is the feature, a purchase of the pair the label.
_PAIRS = W + ", pv AS (SELECT user_id, item_id, round(arg_max(value, event_id), 2) AS score, (user_id, item_id) IN (SELECT (user_id, item_id) FROM ev WHERE event_type = 'purchase') AS label FROM ev WHERE event_type = 'view' GROUP BY 1, 2)"


def last_views(s, d):
    ev = A.events(s, d)
    held = ev.groupBy("user_id", "item_id").agg(F.max_by(F.when(Q.kind("view"), F.round("value", 2)), F.when(Q.kind("view"), F.col("event_id"))).alias("score"), F.max(Q.kind("view")).alias("viewed"), F.max(Q.kind("purchase")).alias("label"))
    return held.where("viewed").select("user_id", "item_id", "score", "label")


@query("auc_single_feature", _PAIRS + """, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM pv), s AS (SELECT sum(r) FILTER (label) AS s, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n FROM r)
 SELECT round(CASE WHEN p = 0 OR n = 0 THEN 0.5 ELSE (s - p * (p + 1) / 2.0) / (p * n) END, 8) AS auc FROM s""")
def auc_single_feature(s, d):
    return rounded(Q.auc(last_views(s, d), "score", "label"), "auc")


@query("best_threshold", _PAIRS + """, g AS (SELECT score, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n FROM pv GROUP BY 1),
 c AS (SELECT score, sum(p) OVER () - sum(p) OVER w + sum(n) OVER w AS correct, sum(p) OVER () AS positives, sum(p + n) OVER () AS total FROM g WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT min(score) AS first, any_value(positives) AS positives, any_value(total) AS total, arg_max(score, (correct, -score)) AS t, max(correct) AS m FROM c) SELECT CASE WHEN m > positives THEN t ELSE first END AS threshold, round(greatest(m, positives) / total, 8) AS accuracy FROM b""")
def best_threshold(s, d):
    return rounded(Q.best_threshold(last_views(s, d), "score", "label"), "accuracy")


_QUART = W + """, a AS (SELECT c_custkey AS user_id, c_acctbal AS trait FROM customer), o AS (SELECT trait, row_number() OVER (ORDER BY trait) - 1 AS i, count(*) OVER () AS n FROM a), t AS (SELECT max(trait) FILTER (i = n // 4) AS low, max(trait) FILTER (i = 3 * n // 4) AS high FROM o)"""


def traits(s, d):
    return A.read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("trait"))


@query("quartile_signal", _QUART + """, x AS (SELECT value, trait, low, high FROM ev JOIN a USING (user_id), t WHERE event_type = 'view') SELECT any_value(low) AS low_threshold, any_value(high) AS high_threshold, count(*) FILTER (trait <= low) AS low_views, count(*) FILTER (trait >= high) AS high_views,
 round(avg(value) FILTER (trait <= low), 6) AS low_mean, round(avg(value) FILTER (trait >= high), 6) AS high_mean FROM x""")
def quartile_signal(s, d):
    """Means of the low and high user groups; both ends are inclusive, so groups may overlap."""
    t = Q.quartile_thresholds(traits(s, d), "trait")
    held = A.events(s, d).where(Q.kind("view")).join(traits(s, d), "user_id").crossJoin(F.broadcast(t))
    low, high = F.col("trait") <= F.col("low"), F.col("trait") >= F.col("high")
    return held.agg(F.first("low").alias("low_threshold"), F.first("high").alias("high_threshold"), F.count_if(low).alias("low_views"), F.count_if(high).alias("high_views"), F.round(F.avg(F.when(low, F.col("value"))), 6).alias("low_mean"), F.round(F.avg(F.when(high, F.col("value"))), 6).alias("high_mean"))


@query("quartile_rates", _QUART + _PRIOR[len(W):] + """, g AS (SELECT user_id, 'low' AS grp FROM a, t WHERE trait <= low UNION ALL SELECT user_id, 'high' FROM a, t WHERE trait >= high),
 x AS (SELECT grp, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'add_to_cart' AND had_favorite = 0) AS dc, count(*) FILTER (event_type = 'purchase' AND had_favorite = 0 AND had_cart = 0) AS dp, count(*) FILTER (event_type = 'purchase' AND views_before = 1) AS lv FROM pr JOIN g USING (user_id) GROUP BY 1)
 SELECT grp, views, round(dc / views, 8) AS direct_cart_rate, round(dp / views, 8) AS direct_purchase_rate, round(lv / views, 8) AS low_view_purchase_rate FROM x""")
def quartile_rates(s, d):
    t = Q.quartile_thresholds(traits(s, d), "trait")
    groups = traits(s, d).crossJoin(F.broadcast(t)).select("user_id", F.explode(F.array_compact(F.array(F.when(F.col("trait") <= F.col("low"), "low"), F.when(F.col("trait") >= F.col("high"), "high")))).alias("grp"))
    ev = A.events(s, d)
    views = ev.where(Q.kind("view")).join(groups, "user_id").groupBy("grp").agg(F.count("*").alias("views"))
    flags = Q.prior_state_flags(ev).join(groups, "user_id")
    no = (F.col("had_favorite") == 0, F.col("had_cart") == 0)
    c = flags.groupBy("grp").agg(F.count_if(Q.kind("add_to_cart") & no[0]).alias("dc"), F.count_if(Q.kind("purchase") & no[0] & no[1]).alias("dp"), F.count_if(Q.kind("purchase") & (F.col("views_before") == 1)).alias("lv"))
    return views.join(c, "grp").select("grp", "views", *(F.round(F.try_divide(x, "views"), 8).alias(n) for x, n in (("dc", "direct_cart_rate"), ("dp", "direct_purchase_rate"), ("lv", "low_view_purchase_rate"))))


@query("duplicate_audit", W + " SELECT user_id, item_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_audit(s, d):
    return A.events(s, d).groupBy("user_id", "item_id", "event_type").agg(F.count("*").alias("n")).where("n > 1")


@query("split_partition_audit", W + " SELECT coalesce(split, 'none') AS split, count(*) AS events, count(DISTINCT event_id) AS ids FROM ev GROUP BY 1")
def split_partition_audit(s, d):
    """Each event lies in exactly one split: events equal ids in each, and none is outside."""
    return D.with_split(A.events(s, d)).groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"))


@query("world_fk_audit", W + """ SELECT 'unknown_user' AS rule, count(*) AS n FROM ev WHERE user_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'unknown_item', count(*) FROM ev WHERE item_id NOT IN (SELECT item_id FROM it)
 UNION ALL SELECT 'unknown_type', count(*) FROM events WHERE event_type NOT IN ('error','view','click','signup','purchase') UNION ALL SELECT 'duplicate_id', count(*) - count(DISTINCT event_id) FROM ev""")
def world_fk_audit(s, d):
    ev, raw = A.events(s, d), A.read(s, d, "events")
    users = A.read(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    dup = ev.agg((F.count("*") - F.countDistinct("event_id")).alias("n")).select(F.lit("duplicate_id").alias("rule"), "n")
    parts = [count(ev.join(users, "user_id", "left_anti"), "unknown_user"), count(ev.join(A.items(s, d), "item_id", "left_anti"), "unknown_item"), count(raw.where(~F.col("event_type").isin(*A.EVENT_TYPES)), "unknown_type"), dup]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("population_diff", """SELECT 'only_events' AS side, count(*) AS n FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer) UNION ALL SELECT 'only_customers', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events)""")
def population_diff(s, d):
    """Ids of one population that the other lacks, both ways in one full outer join."""
    a, b = A.users(s, d), A.read(s, d, "customer").select("c_custkey").distinct()
    held = a.join(b, a.user_id == b.c_custkey, "full_outer").agg(F.count_if(F.col("c_custkey").isNull()).alias("only_events"), F.count_if(F.col("user_id").isNull()).alias("only_customers"))
    return held.unpivot([], ["only_events", "only_customers"], "side", "n")


_RULES = """ SELECT 'event id repeats' AS rule, CAST(event_id AS VARCHAR) AS key FROM se GROUP BY event_id HAVING count(*) > 1 UNION ALL SELECT 'unknown user', CAST(event_id AS VARCHAR) FROM se WHERE user_id NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'unknown item', CAST(event_id AS VARCHAR) FROM se WHERE item_id NOT IN (SELECT item_id FROM it) UNION ALL SELECT 'unknown event type', CAST(event_id AS VARCHAR) FROM se WHERE coalesce(event_type NOT IN ('impression','view','favorite','add_to_cart','purchase'), true) UNION ALL SELECT 'no time', CAST(event_id AS VARCHAR) FROM se WHERE ts IS NULL
 UNION ALL SELECT 'time does not increase', CAST(event_id AS VARCHAR) FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS b FROM se) WHERE ts <= b
 UNION ALL SELECT 'impression repeats', user_id || ':' || session || ':' || item_id FROM se WHERE event_type = 'impression' GROUP BY user_id, session, item_id HAVING count(*) > 1
 UNION ALL SELECT 'view without earlier impression', CAST(event_id AS VARCHAR) FROM (SELECT event_id, event_type, max(CAST(event_type = 'impression' AS INT)) OVER (PARTITION BY user_id, session, item_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS shown FROM se) WHERE event_type = 'view' AND shown = 0
 UNION ALL SELECT 'engagement repeats', user_id || ':' || item_id || ':' || event_type FROM se WHERE event_type IN ('favorite','add_to_cart','purchase') GROUP BY user_id, item_id, event_type HAVING count(*) > 1
 UNION ALL SELECT 'engagement without earlier view', CAST(event_id AS VARCHAR) FROM sc WHERE source_view IS NULL"""


@query("interaction_violations", SESS + _SRC[len(W):] + _RULES)
def interaction_violations(s, d):
    """Every broken rule of the event log with the key that breaks it."""
    held = sessionized(s, d)
    users = A.read(s, d, "customer").select("c_custkey")
    return V.together([V.event_violations(held, users, A.items(s, d).select("item_id"), list(A.EVENT_TYPES.values())), V.session_violations(held), V.engagement_violations(held)])


@query("violation_counts", SESS + _SRC[len(W):] + f", vi AS ({_RULES}) SELECT rule, count(*) AS n FROM vi GROUP BY 1")
def violation_counts(s, d):
    return V.counts(interaction_violations(s, d))


#: Measures of a whole audit: name, query and its column.
_AUDIT = (("sessions", "session_summary", "sessions"), ("mean_impressions", "session_summary", "mean_impressions"), ("same_category_share", "continuity", "same_share"), ("exposure_gini", "exposure_concentration", "gini"),
          ("impression_to_view", "funnel_conversion", "impression_to_view"), ("view_to_purchase", "funnel_conversion", "view_to_purchase"), ("auc", "auc_single_feature", "auc"), ("threshold_accuracy", "best_threshold", "accuracy"))


@query("interaction_audit", " UNION ALL ".join(f"SELECT '{n}' AS measure, CAST({c} AS DOUBLE) AS value FROM ({oracle_of(q)})" for n, q, c in _AUDIT))
def interaction_audit(s, d):
    """Headline measures of sessions, exposure, funnel and separability in one table."""
    rows = {q: globals()[q](s, d) for q in {q for _, q, _ in _AUDIT}}
    return V.together([rows[q].select(F.lit(n).alias("measure"), F.col(c).cast("double").alias("value")) for n, q, c in _AUDIT])
