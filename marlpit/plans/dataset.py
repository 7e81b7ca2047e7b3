"""Queries over splits, facts, states and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlpit.operators import dataset as D
from marlpit.operators import sketches as K
from marlpit.plans.registry import query
from marlpit.sources import adapter as A
from marlpit.sources.adapter import SQL_WORLD as W


def stamp(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ') AS {c}"


TIMES = [f"{w}_{n}_at" for n in D.KINDS.values() for w in ("first", "last")] + ["first_interaction_at", "last_interaction_at"]
FLAGS = {"was_impressed": "impression", "was_viewed": "view", "was_favorited": "favorite", "was_carted": "cart", "was_purchased": "purchase"}


def facts(s, d):
    return D.split_facts(A.events(s, d))


def train(s, d):
    return facts(s, d).where("split = 'train'").drop("split")


@query("scan_users", W + " SELECT user_id FROM us")
def scan_users(s, d):
    return A.users(s, d)


@query("scan_products", W + " SELECT item_id, status FROM it")
def scan_products(s, d):
    return A.items(s, d)


@query("scan_events", W + f" SELECT event_id, user_id, item_id, event_type, {sql_stamp('ts')} FROM ev")
def scan_events(s, d):
    return A.events(s, d).select("event_id", "user_id", "item_id", "event_type", stamp("ts"))


@query("split_events", W + " SELECT event_id, split FROM ev")
def split_events(s, d):
    return D.with_split(A.events(s, d)).select("event_id", "split")


@query("split_summary", W + """ SELECT split, count(*) AS events, count(*) FILTER (event_type='impression') AS impression_events, count(*) FILTER (event_type='view') AS view_events,
 count(*) FILTER (event_type='favorite') AS favorite_events, count(*) FILTER (event_type='add_to_cart') AS cart_events, count(*) FILTER (event_type='purchase') AS purchase_events,
 count(DISTINCT (user_id, item_id)) AS pairs FROM ev WHERE split IS NOT NULL GROUP BY split""")
def split_summary(s, d):
    return D.split_summary(A.events(s, d))


@query("interaction_facts", W + f" SELECT split, user_id, item_id, {', '.join(D.COUNTS)}, {', '.join(map(sql_stamp, TIMES))} FROM facts")
def interaction_facts(s, d):
    return facts(s, d).select("split", "user_id", "item_id", *D.COUNTS, *map(stamp, TIMES))


@query("pair_universe", W + " SELECT user_id, item_id FROM us CROSS JOIN it")
def pair_universe(s, d):
    return D.pair_universe(A.users(s, d), A.items(s, d).select("item_id"))


_MASTER = f"""SELECT u.user_id, i.item_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in D.COUNTS)},
 {', '.join(f'CASE WHEN coalesce({n}_count, 0) > 0 THEN 1 ELSE 0 END AS {f}' for f, n in FLAGS.items())}, {', '.join(map(sql_stamp, TIMES))}
 FROM us u CROSS JOIN it i LEFT JOIN train t ON t.user_id = u.user_id AND t.item_id = i.item_id"""


@query("master_interactions", W + " " + _MASTER)
def master_interactions(s, d):
    return D.master_interactions(A.users(s, d), A.items(s, d), train(s, d)).select("user_id", "item_id", *D.COUNTS, *FLAGS, *map(stamp, TIMES))


_POSITIVE = {"viewplus": "view_count > 0", "favoriteplus": "(favorite_count > 0 OR cart_count > 0 OR purchase_count > 0)", "purchase": "purchase_count > 0"}


def sql_state(task: str) -> str:
    met = "impression_count" if task == "viewplus" else "view_count"
    return f"CASE WHEN {_POSITIVE[task]} THEN 'positive' WHEN {met} > 0 THEN 'observed_non_conversion' ELSE 'unknown' END"


def _states(task: str) -> None:
    sql = W + f""", m AS ({_MASTER}), x AS (SELECT *, {sql_state(task)} AS state FROM m)
 SELECT user_id, item_id, '{task}' AS task, state, CAST(state='positive' AS INT) AS is_positive, CAST(state='observed_non_conversion' AS INT) AS is_observed_non_conversion,
 CAST(state='unknown' AS INT) AS is_unknown, {', '.join(D.COUNTS)} FROM x"""

    @query(f"task_states_{task}", sql)
    def states(s, d):
        held = D.master_interactions(A.users(s, d), A.items(s, d), train(s, d)).withColumn("state", D.task_state(task))
        one = {f"is_{x}": (F.col("state") == x).cast("int") for x in ("positive", "observed_non_conversion", "unknown")}
        return held.withColumns(one).select("user_id", "item_id", F.lit(task).alias("task"), "state", *one, *D.COUNTS)

    @query(f"train_seen_{task}", W + f" SELECT user_id, string_agg(CAST(item_id AS VARCHAR), '|' ORDER BY item_id) AS items FROM seen WHERE task = '{task}' GROUP BY user_id")
    def seen(s, d):
        return D.as_sets(D.train_seen(train(s, d), task)).select("user_id", F.array_join("items", "|").alias("items"))

    for split in ("validation", "test"):

        @query(f"relevance_{task}_{split}", W + f" SELECT u.user_id, coalesce(string_agg(CAST(item_id AS VARCHAR), '|' ORDER BY item_id), '') AS items FROM us u LEFT JOIN rel r ON r.user_id = u.user_id AND r.task = '{task}' AND r.split = '{split}' GROUP BY u.user_id")
        def relevant(s, d, split=split):
            held = D.as_sets(D.relevance(A.events(s, d), task).where(F.col("split") == split))
            return A.users(s, d).join(held, "user_id", "left").select("user_id", F.coalesce(F.array_join("items", "|"), F.lit("")).alias("items"))


for _task in D.TASKS:
    _states(_task)


@query("candidates", W + " SELECT task, item_id FROM cand")
def candidates(s, d):
    items = A.items(s, d)
    parts = [D.candidates(items, t).select(F.lit(t).alias("task"), "item_id") for t in D.TASKS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("impressed_candidates", W + " SELECT DISTINCT split, user_id, item_id FROM ev WHERE split IS NOT NULL AND event_type = 'impression'")
def impressed_candidates(s, d):
    return D.impressed(A.events(s, d))


@query("state_distribution", W + f""", x AS (SELECT split, unnest(['viewplus','favoriteplus','purchase']) AS task, unnest([{sql_state('viewplus')}, {sql_state('favoriteplus')}, {sql_state('purchase')}]) AS state FROM facts),
 n AS (SELECT (SELECT count(*) FROM us) * (SELECT count(*) FROM it) AS total), o AS (SELECT split, count(*) AS observed FROM facts GROUP BY 1),
 g AS (SELECT * FROM o CROSS JOIN (VALUES ('viewplus'),('favoriteplus'),('purchase')) t(task) CROSS JOIN (VALUES ('positive'),('observed_non_conversion'),('unknown')) v(state)),
 c AS (SELECT split, task, state, count(*) AS pairs FROM x GROUP BY 1, 2, 3),
 r AS (SELECT g.split, g.task, g.state, coalesce(pairs, 0) + CASE WHEN g.state = 'unknown' THEN total - observed ELSE 0 END AS pairs, total FROM g CROSS JOIN n LEFT JOIN c USING (split, task, state))
 SELECT split, task, state, CAST(pairs AS BIGINT) AS pairs, round(pairs / total, 9) AS share FROM r""")
def state_distribution(s, d):
    users, items = A.users(s, d).count(), A.items(s, d).count()
    return D.state_distribution(facts(s, d), users, items).withColumn("share", F.round("share", 9))


def _sparsity(key: str, dim: str, name: str) -> None:
    sql = W + f""", x AS (SELECT {key}, unnest(['viewplus','favoriteplus','purchase']) AS task, unnest([CAST({_POSITIVE['viewplus']} AS INT), CAST({_POSITIVE['favoriteplus']} AS INT), CAST({_POSITIVE['purchase']} AS INT)]) AS hit FROM train),
 p AS (SELECT {key}, task, sum(hit) AS n FROM x GROUP BY 1, 2), g AS (SELECT {key}, task FROM {dim} CROSS JOIN (VALUES ('viewplus'),('favoriteplus'),('purchase')) t(task)),
 f AS (SELECT task, CAST(coalesce(n, 0) AS DOUBLE) AS n FROM g LEFT JOIN p USING ({key}, task))
 SELECT task, count(*) AS members, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS "min", quantile_cont(n, 0.5) AS median, max(n) AS "max",
 count(*) FILTER (n = 0) AS zero, count(*) FILTER (n BETWEEN 1 AND 2) AS cold_ish FROM f GROUP BY task"""

    @query(f"sparsity_{name}", sql)
    def stats(s, d):
        dimension = A.users(s, d) if name == "user" else A.items(s, d)
        return D.sparsity(train(s, d), dimension, key).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})

    @query(f"id_index_{name}", W + f" SELECT {key}, CAST(row_number() OVER (ORDER BY {key}) - 1 AS BIGINT) AS idx FROM {dim}")
    def index(s, d):
        return D.id_index(A.users(s, d) if name == "user" else A.items(s, d), key)


_sparsity("user_id", "us", "user")
_sparsity("item_id", "it", "item")


@query("leakage_audit", W + """ SELECT f.split, count(*) AS purchase_pairs, count(t.user_id) AS with_train_history, CAST(coalesce(sum(CAST(t.purchase_count > 0 AS INT)), 0) AS BIGINT) AS bought_in_train
 FROM facts f LEFT JOIN train t ON t.user_id = f.user_id AND t.item_id = f.item_id WHERE f.split <> 'train' AND f.purchase_count > 0 GROUP BY f.split""")
def leakage_audit(s, d):
    return D.leakage_audit(facts(s, d))


@query("world_events", W + " SELECT event_id, event_type, user_id, item_id FROM ev WHERE event_type IN ('impression','view') UNION ALL SELECT event_id, event_type, user_id, item_id FROM ev WHERE event_type NOT IN ('impression','view')")
def world_events(s, d):
    """Exposure and engagement logs as one stream of rows."""
    held = A.events(s, d).select("event_id", "event_type", "user_id", "item_id")
    shown = F.col("event_type").isin("impression", "view")
    return held.where(shown).unionByName(held.where(~shown))


@query("manifest_counts", W + """ SELECT 'events' AS artifact, count(*) AS n FROM ev UNION ALL SELECT 'facts_' || split, count(*) FROM facts GROUP BY split
 UNION ALL SELECT 'relevance_' || task || '_' || split, count(*) FROM rel GROUP BY task, split UNION ALL SELECT 'candidates_' || task, count(*) FROM cand GROUP BY task
 UNION ALL SELECT 'users', count(*) FROM us UNION ALL SELECT 'items', count(*) FROM it""")
def manifest_counts(s, d):
    ev = A.events(s, d)
    one = lambda df, name: df.groupBy(name.alias("artifact")).agg(F.count("*").alias("n"))
    parts = [
        one(ev, F.lit("events")), one(facts(s, d), F.concat(F.lit("facts_"), "split")), one(D.relevance(ev), F.concat(F.lit("relevance_"), "task", F.lit("_"), "split")),
        one(candidates(s, d), F.concat(F.lit("candidates_"), "task")), one(A.users(s, d), F.lit("users")), one(A.items(s, d), F.lit("items")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("distinct_weeks", W + """ SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT (user_id, item_id)) AS pairs, true AS users_fit, true AS pairs_fit FROM ev GROUP BY 1, 2""")
def distinct_weeks(s, d):
    """Distinct users and pairs of a week by kind, and whether sketches kept by day and merged by week agree within their bound."""
    events = A.events(s, d)
    week = lambda c: F.date_format(F.date_trunc("week", c), "yyyy-MM-dd").alias("week")
    exact = events.groupBy(week("ts"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct("user_id", "item_id").alias("pairs"))
    told = K.estimates(K.merged(K.daily(events, "event_type"), week("day"), "event_type")).select("week", "event_type", F.col("users").alias("u"), F.col("pairs").alias("p"))
    return exact.join(told, ["week", "event_type"]).select(*exact.columns, K.fits(F.col("u"), F.col("users")).alias("users_fit"), K.fits(F.col("p"), F.col("pairs")).alias("pairs_fit"))


@query("fresh_pairs", W + """, f AS (SELECT user_id, item_id, min(CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END) AS first FROM ev WHERE split IS NOT NULL GROUP BY 1, 2)
 SELECT CASE first WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, count(*) AS pairs, true AS fit FROM f GROUP BY 1""")
def fresh_pairs(s, d):
    """Pairs that a split is the first to have, and whether differences of merged sketches agree within their bound."""
    events = D.with_split(A.events(s, d)).where("split is not null")
    names = [n for n, *_ in A.SPLITS]
    number = F.array_position(F.array(*map(F.lit, names)), F.col("split")) - 1
    first = events.groupBy("user_id", "item_id").agg(F.min(number).alias("i")).groupBy("i").agg(F.count("*").alias("pairs"))
    upto = K.merged(K.daily(events, "split"), number.alias("i")).select("i", "pairs")
    spans = upto.select(F.explode(F.sequence(F.col("i").cast("int"), F.lit(len(names) - 1))).alias("to"), "i", "pairs")
    sums = spans.groupBy("to").agg(F.theta_union_agg("pairs", F.lit(K.LOG_K)).alias("all"), F.theta_union_agg(F.when(F.col("i") < F.col("to"), F.col("pairs")), F.lit(K.LOG_K)).alias("before"))
    told = sums.select(F.col("to").cast("long").alias("i"), K.beyond(F.col("all"), F.col("before")).alias("new"), F.theta_sketch_estimate("all").alias("union"))
    return first.join(told, "i").select(F.array(*map(F.lit, names))[F.col("i").cast("int")].alias("split"), "pairs", K.fits(F.col("new"), F.col("pairs"), F.col("union")).alias("fit"))
