"""Queries over losses, training and streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlpit.functions import scalar as S
from marlpit.operators import dataset as D
from marlpit.operators import dsgd as G
from marlpit.operators import mf as MF
from marlpit.operators import ranking as R
from marlpit.operators import representations as P
from marlpit.operators import sampling as M
from marlpit.operators import sequences as Q
from marlpit.operators.ranking import Weights
from marlpit.plans.catalog import _MODEL, model
from marlpit.plans.dataset import train
from marlpit.plans.ranking import KS, evaluated, topk_of
from marlpit.plans.registry import query
from marlpit.plans.sequences import SESS, samples, sessionized
from marlpit.sources import adapter as A
from marlpit.sources.adapter import SQL_WORLD as W
from marlpit.sources.durable import cut, folder
from marlpit.sources.snapshots import SnapshotTable
from marlpit.streaming import incremental as T

_PAIR = _MODEL + """, pp AS (SELECT t.user_id, t.item_id, (t.item_id + 1) % 100 AS other, 1 + ln(1 + t.purchase_count) AS conf FROM train t WHERE purchase_count > 0),
 sc AS (SELECT pp.*, list_inner_product(u.vec, a.vec) AS sp, list_inner_product(u.vec, b.vec) AS sn FROM pp JOIN uv u USING (user_id) JOIN iv a ON a.item_id = pp.item_id JOIN iv b ON b.item_id = pp.other)"""


def scored_pairs(s, d):
    """Train purchases with fixed vectors' scores of the bought item and of the next one."""
    u, i = model(s, d)
    held = train(s, d).where("purchase_count > 0").select("user_id", "item_id", ((F.col("item_id") + 1) % 100).alias("other"), (1 + F.log1p("purchase_count")).alias("conf"))
    iv = lambda key, name: i.select(F.col("item_id").alias(key), F.col("vec").alias(name))
    both = held.join(u, "user_id").join(iv("item_id", "a"), "item_id").join(iv("other", "b"), "other")
    return both.select("user_id", "item_id", "conf", S.dot(F.col("vec"), F.col("a")).alias("sp"), S.dot(F.col("vec"), F.col("b")).alias("sn"))


@query("loss_values", _PAIR + """ SELECT round(avg(ln(1 + exp(-sp)) + ln(1 + exp(sn))) / 2, 6) AS bce, round(avg(ln(1 + exp(-(sp - sn)))), 6) AS bpr,
 round(avg(conf * ln(1 + exp(-sp)) + ln(1 + exp(sn))) / 2, 6) AS weighted_bce, round(avg(conf * ln(1 + exp(-(sp - sn)))), 6) AS weighted_bpr, count(*) AS pairs FROM sc""")
def loss_values(s, d):
    sp, sn, conf = F.col("sp"), F.col("sn"), F.col("conf")
    pos, neg, pair = MF.bce(sp, F.lit(1.0)), MF.bce(sn, F.lit(0.0)), MF.bpr(sp - sn)
    return scored_pairs(s, d).agg(F.round(F.avg(pos + neg) / 2, 6).alias("bce"), F.round(F.avg(pair), 6).alias("bpr"), F.round(F.avg(conf * pos + neg) / 2, 6).alias("weighted_bce"), F.round(F.avg(conf * pair), 6).alias("weighted_bpr"), F.count("*").alias("pairs"))


@query("margin_stats", _PAIR + " SELECT round(avg(sp - sn), 6) AS mean, round(stddev_pop(sp - sn), 6) AS std, round(avg(CAST(sp > sn AS INT)), 6) AS positive_share FROM sc")
def margin_stats(s, d):
    m = F.col("sp") - F.col("sn")
    return scored_pairs(s, d).agg(F.round(F.avg(m), 6).alias("mean"), F.round(F.stddev_pop(m), 6).alias("std"), F.round(F.avg((m > 0).cast("int")), 6).alias("positive_share"))


@query("early_stop_trace", W + """, x AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'purchase') AS figure FROM ev GROUP BY 1), b AS (SELECT day, figure, coalesce(max(figure) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM x),
 g AS (SELECT *, sum(CAST(figure > best + 1e-12 AS INT)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS grp FROM b) SELECT strftime(day, '%Y-%m-%d') AS day, figure, figure > best + 1e-12 AS improved, CAST(row_number() OVER (PARTITION BY grp ORDER BY day) - 1 AS INT) AS waited FROM g""")
def early_stop_trace(s, d):
    """Best so far and rounds without improvement over an ordered series of figures."""
    x = A.events(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count_if(Q.kind("purchase")).alias("figure"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    better = F.col("figure") > F.coalesce(F.max("figure").over(before), F.lit(-1)) + 1e-12
    held = x.withColumn("improved", better).withColumn("grp", F.sum(F.col("improved").cast("int")).over(Window.orderBy("day")))
    return held.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "figure", "improved", (F.row_number().over(Window.partitionBy("grp").orderBy("day")) - 1).alias("waited"))


@query("assign_ts", SESS + " SELECT event_id, round(3600 * sum(1 + item_id) OVER w / (sum(1 + item_id) OVER (PARTITION BY user_id, session) + 1), 6) AS offset_seconds FROM se WINDOW w AS (PARTITION BY user_id, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def assign_ts(s, d):
    """Times inside a session's slack of an hour, in proportion to cumulative weight."""
    whole = Window.partitionBy("user_id", "session")
    upto = whole.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    w = 1 + F.col("item_id")
    return sessionized(s, d).select("event_id", F.round(3600 * F.sum(w).over(upto) / (F.sum(w).over(whole) + 1), 6).alias("offset_seconds"))


DIMS = (8, 16)


def positives(s, d):
    """Train pairs with a view, weighted by the combined signal."""
    return train(s, d).where("view_count > 0").select("user_id", "item_id", Weights().strength().alias("strength"))


def stored_world(s, d):
    """Train facts without times, items and users, read from the events once for all that rests on them."""
    return tuple(cut(x) for x in (train(s, d).select("user_id", "item_id", *D.COUNTS), A.items(s, d), A.users(s, d)))


def evaluator(s, d, world=None):
    """Purchase positions in a state's lists by split, with cart popularity for cold users. What doesn't depend on a state is stored once."""
    facts, items, users = world or stored_world(s, d)
    rel = cut(D.relevance(A.events(s, d), "purchase").select("split", "user_id", "item_id"))
    seen, candidates, fallback = (cut(x) for x in (rel.where("split = 'train'").select("user_id", "item_id"), D.candidates(items, "purchase"), topk_of(facts, items, users)))
    counts = cut(seen.groupBy("user_id").agg(F.countDistinct("item_id").alias("n_seen")))

    def positions(state, split, k=max(KS)):
        lists = MF.top_lists(state, candidates, seen, k, counts)
        every = MF.with_fallback(lists, state.where("kind = 'u'").select(F.col("id").alias("user_id")), fallback)
        return R.listed_positions(every, rel.where(F.col("split") == split).select("user_id", "item_id"))

    return positions


@query("mf_train")
def mf_train(s, d):
    """Validation metrics at 10, parameters and normalised norms of each dimension."""
    out, held = None, evaluator(s, d)
    for dim in DIMS:
        state = MF.train(positives(s, d), MF.Config(dim=dim))
        row = R.macro(R.user_metrics(held(state, "validation"), (10,))).crossJoin(MF.capacity(state)).select(F.lit(dim).alias("dim"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("eval_mf")
def eval_mf(s, d):
    """Test metrics of a model of eight factors."""
    state = MF.train(positives(s, d), MF.Config(dim=8))
    return R.TestOnce()(evaluator(s, d)(state, "test"), KS)


@query("comparison_table")
def comparison_table(s, d):
    """The cart-popularity control next to the trained model, by k."""
    control = evaluated(s, d).where("split = 'test' and task = 'purchase' and signal = 'cart'").drop("split", "task", "signal").withColumn("model", F.lit("cart_popularity"))
    return control.unionByName(eval_mf(s, d).withColumn("model", F.lit("mf_als_8")))


def train_examples(s, d, *names):
    """Train positives against four exposed or unknown contrasts each: pointwise rows with log-loss labels, and triples of both
    items with equal weights or the positive's confidence. Contrasts are drawn once."""
    positive, confidence = P.confidence("log_view")
    own = cut(train(s, d).where(positive).select("user_id", "item_id", confidence.alias("confidence")))
    drawn = samples(s, d, "exposed")
    triples = drawn.join(own, ["user_id", "item_id"])
    told = lambda df, other, label, weight: cut(df.select("user_id", "item_id", other.cast("long").alias("other_id"), label.cast("double").alias("label"), weight.alias("weight")))
    make = {
        "bce": lambda: told(M.bce_examples(own, drawn), F.lit(None), F.col("label"), F.col("confidence")),
        "bpr": lambda: told(triples, F.col("sampled"), F.lit(1), F.lit(1.0)),
        "weighted_bpr": lambda: told(triples, F.col("sampled"), F.lit(1), F.col("confidence")),
    }
    return {n: make[n]() for n in names}


def purchase_metrics(held, params, split):
    """Metrics at 10 of biased scores for purchases."""
    return R.macro(R.user_metrics(held(G.folded(params), split, 10), (10,)))  # longer lists have the same first 10


def bias_effects(s, d, params, examples, facts=None):
    """Correlation of item biases with carts of their item, and what biases and factors share of the scores' variance."""
    bias = params.where("kind = 'i'").select(F.col("id").alias("item_id"), "bias")
    carts = (train(s, d) if facts is None else facts).groupBy("item_id").agg(F.sum("cart_count").cast("double").alias("carts"))
    held = cut(bias.join(carts, "item_id"))
    ranked = Q.mid_ranked(Q.mid_ranked(held, "bias", "bias_rank"), "carts", "cart_rank")
    near = held.agg(S.correlation(F.col("bias"), F.col("carts")).alias("pearson")).crossJoin(ranked.agg(S.correlation(F.col("bias_rank"), F.col("cart_rank")).alias("spearman")))  # one row each
    own = G.scored(params, examples).join(bias, "item_id").join(params.where("kind = 'u'").select(F.col("id").alias("user_id"), F.col("bias").alias("user_bias")), "user_id")
    biases = F.col("bias") + F.col("user_bias")
    return near.crossJoin(own.agg(F.try_divide(F.var_pop(biases), F.var_pop("score")).alias("bias_share"), F.try_divide(F.var_pop(F.col("score") - biases), F.var_pop("score")).alias("factor_share")))


@query("mf_bias")
def mf_bias(s, d):
    """Test metrics and bias diagnostics of BCE models without bias, with item and with both biases."""
    examples, held, out = train_examples(s, d, "bce")["bce"], evaluator(s, d), None
    for bias in G.BIASES:
        params = cut(G.fit(examples, G.Config(bias=bias)).params)
        row = purchase_metrics(held, params, "test").crossJoin(bias_effects(s, d, params, examples)).select(F.lit(bias).alias("bias"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("mf_objective")
def mf_objective(s, d):
    """Test metrics, the best epoch by validation and margins of models trained on BCE, BPR and weighted BPR."""
    every, positions, out = train_examples(s, d, "bce", "bpr", "weighted_bpr"), evaluator(s, d), None
    for name, examples in every.items():
        figure = lambda params: purchase_metrics(positions, params, "validation").agg(F.coalesce(F.max("ndcg"), F.lit(0.0))).first()[0]
        held = G.fit(examples, G.Config(objective=name[-3:]), figure, every=4)
        params = cut(held.params)
        margin = F.col("score") - F.col("other_score")
        margins = G.scored(params, every["bpr"]).agg(F.avg(margin).alias("margin_mean"), F.stddev_pop(margin).alias("margin_std"), F.avg((margin > 0).cast("double")).alias("positive_share"))
        row = purchase_metrics(positions, params, "test").crossJoin(margins).select(F.lit(name).alias("objective"), F.lit(held.epoch).alias("epoch"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# Streams: each query drains the file and must equal the batch statement.
def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("stream_tumbling", W + " SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_tumbling(s, d):
    return T.with_session_zone(s, lambda: T.materialized(T.drain(T.tumbling(T.read_events(s, d)), "complete").select(_text("start"), "event_type", "n")))


@query("stream_sliding", W + """, h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, event_type FROM ev), w AS (SELECT h - INTERVAL (i) HOUR AS start, event_type FROM h, range(6) t(i)) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def stream_sliding(s, d):
    return T.with_session_zone(s, lambda: T.materialized(T.drain(T.tumbling(T.read_events(s, d), "6 hours", "1 hour"), "complete").select(_text("start"), "event_type", "n")))


@query("stream_sessions", W + """, x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM x) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM y GROUP BY user_id, n""")
def stream_sessions(s, d):
    return T.with_session_zone(s, lambda: T.materialized(T.drain(T.gap_sessions(T.read_events(s, d)), "complete").select("user_id", _text("start"), "events")))


@query("stream_facts", W + " SELECT user_id, item_id, count(*) FILTER (event_type = 'view') AS view_count, count(*) FILTER (event_type = 'purchase') AS purchase_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_interaction_at FROM ev GROUP BY 1, 2")
def stream_facts(s, d):
    return T.with_session_zone(s, lambda: T.materialized(T.drain(T.facts(T.read_events(s, d)), "update", ["user_id", "item_id"]).select("user_id", "item_id", "view_count", "purchase_count", _text("first_interaction_at"))))


@query("stream_upsert", W + " SELECT user_id, item_id, count(*) FILTER (event_type = 'view') AS view_count, count(*) FILTER (event_type = 'purchase') AS purchase_count FROM ev GROUP BY 1, 2")
def stream_upsert(s, d):
    """Facts that a stream keeps up to date in a snapshot table, as the table says after the last batch."""
    path = f"{folder(s)}/facts-{uuid4().hex}"
    table = SnapshotTable(s, f"{path}/table", ["user_id", "item_id"], buckets=16)
    kept = T.facts(T.read_events(s, d)).select("user_id", "item_id", "view_count", "purchase_count")
    T.with_session_zone(s, lambda: T.drain_into(kept, table, f"{path}/state"))
    return table.read()


@query("stream_dedup", W + " SELECT event_id, user_id, item_id, event_type FROM ev")
def stream_dedup(s, d):
    twice = lambda: T.read_events(s, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return T.with_session_zone(s, lambda: T.materialized(T.drain(T.deduplicated(twice()), "append").select("event_id", "user_id", "item_id", "event_type")))


@query("stream_funnel", W + " SELECT user_id, item_id, CASE max(CASE event_type WHEN 'view' THEN 1 WHEN 'favorite' THEN 2 WHEN 'add_to_cart' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) WHEN 0 THEN 'none' WHEN 1 THEN 'view' WHEN 2 THEN 'favorite' WHEN 3 THEN 'add_to_cart' ELSE 'purchase' END AS stage FROM ev GROUP BY 1, 2")
def stream_funnel(s, d):
    settings = T.STATE_STORE | {"spark.sql.session.timeZone": "UTC"}
    drained = lambda: T.drain(T.funnel_state(T.read_events(s, d)), "update", ["user_id", "item_id"], largest="depth")
    return T.with_settings(s, settings, lambda: T.materialized(drained().select("user_id", "item_id", "stage")))


@query("stream_late_split", W + """ SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, false AS late, count(*) AS n FROM ev GROUP BY 1, 2""")
def stream_late_split(s, d):
    """Events by day on time and late. All files of the table are one batch, so none is late."""
    on_time, late = T.split_late(T.read_events(s, d).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")))
    told = lambda df, is_late: df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).select("day", F.lit(is_late).alias("late"), "n")
    return told(on_time, False).unionByName(told(late, True))
