"""Queries over catalog, vectors and scalar functions."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlpit.functions import scalar as S
from marlpit.operators import catalog as C
from marlpit.operators import dataset as D
from marlpit.operators import nearest as N
from marlpit.operators import ranking as R
from marlpit.operators import sequences as Q
from marlpit.operators import vectors as V
from marlpit.operators.selection import with_quantiles
from marlpit.plans.dataset import train
from marlpit.plans.ranking import RANKED, STATS, _STAT, rounded
from marlpit.plans.registry import oracle_of, query
from marlpit.sources import adapter as A
from marlpit.sources import relational as T
from marlpit.sources.adapter import SQL_WORLD as W
from marlpit.sources.durable import cut, folder


@query("parse_ts", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc, false AS naive_accepted FROM events")
def parse_ts(s, d):
    """Times written with a zone come back as UTC; those without are rejected."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zoned = S.parse_utc(F.concat(text, F.lit("+00:00")))
    back = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
    return A.read(s, d, "events").select("event_id", back.alias("utc"), S.parse_utc(text).isNotNull().alias("naive_accepted"))


@query("json_sets_roundtrip", W + " SELECT user_id, item_id FROM seen WHERE task = 'purchase'")
def json_sets_roundtrip(s, d):
    """Seen sets to a JSON document and back."""
    docs = D.as_sets(D.train_seen(train(s, d), "purchase")).select(F.to_json(F.struct("user_id", "items")).alias("doc"))
    back = F.from_json("doc", "user_id long, items array<int>")
    return docs.select(back.alias("x")).select("x.user_id", F.explode("x.items").alias("item_id"))


@query("catalog_list", "SELECT s_suppkey AS product_id, s_name AS name, n_name AS category, r_name AS parent FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def catalog_list(s, d):
    return listed(*(A.read(s, d, t) for t in ("supplier", "nation", "region")))


def listed(products, categories, parents):
    tree = categories.join(parents, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return products.join(tree, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("product_id"), F.col("s_name").alias("name"), F.col("n_name").alias("category"), F.col("r_name").alias("parent"))


def stored_in(s):
    return f"{folder(s)}/relational-{uuid4().hex}"


@query("catalog_stored", oracle_of("catalog_list"))
def catalog_stored(s, d):
    """The catalog list from relational tables that hold categories and products."""
    at = stored_in(s)
    for table, key in (("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        T.write_table(A.read(s, d, table), at, table, key)
    return listed(*(T.read_table(s, at, t) for t in ("supplier", "nation", "region")))


@query("catalog_seeded", "SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, CASE WHEN p_size > 25 THEN p_size + 100 ELSE p_size END AS size, CASE WHEN p_size > 10 THEN 'real' ELSE 'speculative' END AS reality_type, CASE WHEN p_size > 10 THEN 'seed_v1' END AS catalog_version FROM part")
def catalog_seeded(s, d):
    """A stored catalog of small and middle products gets provenance columns, then middle and large ones are upserted twice."""
    at, own = stored_in(s), A.catalog(s, d).select("product_id", "name", "brand", F.col("size").cast("int").alias("size"))
    T.write_table(own.where("size <= 25"), at, "products", "product_id")
    T.add_columns(at, "products", "reality_type string, catalog_version string", {"reality_type": "speculative"})
    seeds = own.where("size > 10").withColumns({"size": F.when(F.col("size") > 25, F.col("size") + 100).otherwise(F.col("size")), "reality_type": F.lit("real"), "catalog_version": F.lit("seed_v1")})
    for _ in range(2):  # the second changes nothing
        T.upsert(seeds, at, "products")
    return T.read_table(s, at, "products")


@query("catalog_page", "SELECT p_partkey AS product_id, p_name AS name FROM part ORDER BY p_partkey LIMIT 24 OFFSET 48")
def catalog_page(s, d):
    return C.page(A.catalog(s, d).select("product_id", "name"), "product_id", 2)


_LINES = "SELECT l_partkey, count(*) AS lines, round(avg(l_discount), 6) AS mean_discount, round(avg(l_tax), 6) AS mean_tax, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1"


@query("catalog_detail", f"SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, lines, mean_discount, mean_tax, flags FROM part LEFT JOIN ({_LINES}) ON l_partkey = p_partkey")
def catalog_detail(s, d):
    """Each product with its public attributes and tags gathered from the N side."""
    return details(A.catalog(s, d), A.read(s, d, "lineitem"))


def details(products, lineitem):
    lines = lineitem.groupBy("l_partkey").agg(
        F.count("*").alias("lines"), F.map_from_arrays(F.array(F.lit("mean_discount"), F.lit("mean_tax")), F.array(F.round(F.avg("l_discount"), 6), F.round(F.avg("l_tax"), 6))).alias("attributes"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("flags"),
    )
    held = products.join(lines, F.col("product_id") == F.col("l_partkey"), "left")
    public = F.map_filter("attributes", lambda k, v: k.isin("mean_discount", "mean_tax"))
    return held.select("product_id", "name", "brand", "lines", public["mean_discount"].alias("mean_discount"), public["mean_tax"].alias("mean_tax"), "flags")


@query("catalog_nested_json", "SELECT p_partkey AS product_id, '{\"name\":\"' || p_name || '\",\"attributes\":{\"size\":' || CAST(p_size AS VARCHAR) || '},\"tags\":[' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: '\"' || x || '\"'), ',') || ']}' AS doc FROM part")
def catalog_nested_json(s, d):
    held = A.catalog(s, d).withColumns({"size": F.col("size").cast("int"), "tags": F.split("name", " ")})
    return C.nested_json(held, "product_id", ["size"], "tags", ["name"])


@query("user_nested_json", "SELECT c_custkey AS user_id, '{\"name\":\"' || c_name || '\",\"attributes\":{\"nation\":' || c_nationkey || '},\"tags\":[\"' || c_mktsegment || '\"]}' AS doc FROM customer")
def user_nested_json(s, d):
    held = A.read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.array("c_mktsegment").alias("tags"))
    return C.nested_json(held, "user_id", ["nation"], "tags", ["name"])


@query("referenced_products", "SELECT count(*) AS products, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AS referenced FROM part")
def referenced_products(s, d):
    """How many products a guarded delete would have to leave: those that other rows refer to."""
    used = A.read(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("product_id"), F.lit(True).alias("used")).distinct()
    return A.catalog(s, d).select("product_id").join(used, "product_id", "left").agg(F.count("*").alias("products"), F.count("used").alias("referenced"))


@query("category_tree", "SELECT n.n_name AS category, r.r_name AS parent, count(s_suppkey) AS products FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier ON s_nationkey = n.n_nationkey GROUP BY 1, 2")
def category_tree(s, d):
    n, r, p = A.read(s, d, "nation"), A.read(s, d, "region"), A.read(s, d, "supplier")
    nodes = r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("parent")).unionByName(n.select((F.col("n_nationkey") + 1000).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent")))
    child, parent = nodes.alias("c"), nodes.where("parent is null").alias("p")
    held = child.join(parent, F.col("c.parent") == F.col("p.id")).join(p, F.col("c.id") == F.col("s_nationkey") + 1000, "left")
    return held.groupBy(F.col("c.name").alias("category"), F.col("p.name").alias("parent")).agg(F.count("s_suppkey").alias("products"))


@query("tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1")
def tag_counts(s, d):
    return C.tag_counts(A.catalog(s, d), F.split("name", " "))


@query("upsert_plan", "SELECT product_id, CASE WHEN o IS NULL THEN 'insert' WHEN n IS NULL THEN 'delete' WHEN o <> n THEN 'update' ELSE 'keep' END AS action FROM (SELECT p_partkey AS product_id, p_size AS o FROM part WHERE p_partkey % 7 <> 0) FULL JOIN (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS n FROM part WHERE p_partkey % 11 <> 0) USING (product_id)")
def upsert_plan(s, d):
    held = A.catalog(s, d).select("product_id", "size")
    new = held.where("product_id % 11 <> 0").withColumn("size", F.when(F.col("product_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return C.upsert_plan(held.where("product_id % 7 <> 0"), new, "product_id", ["size"])


_AXES = {"part": ("p_size", "p_retailprice"), "lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}


@query("catalog_stats", " UNION ALL ".join(f"SELECT '{a}' AS axis, {_STAT.format(v=f'CAST({a} AS DOUBLE)')} FROM part" for a in _AXES["part"]))
def catalog_stats(s, d):
    return rounded(C.axis_stats(A.read(s, d, "part"), _AXES["part"]), *STATS, places=6)


_BINS = {"p_size": (1.0, 50.0), "p_retailprice": (900.0, 2100.0)}


@query("boundary_shares", " UNION ALL ".join(f"SELECT '{a}' AS axis, round(avg(CAST({a} <= {lo + (hi - lo) * 0.05} AS INT)), 8) AS low_share, round(avg(CAST({a} >= {hi - (hi - lo) * 0.05} AS INT)), 8) AS high_share FROM part" for a, (lo, hi) in _BINS.items()))
def boundary_shares(s, d):
    """Share of products within a twentieth of either end of each attribute's range."""
    return rounded(C.boundary_shares(A.read(s, d, "part"), _BINS, 0.05), "low_share", "high_share")


@query("price_digits", "SELECT length(CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)) AS digits, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 8) AS share FROM part GROUP BY 1")
def price_digits(s, d):
    """Products by the number of digits before the point of their price."""
    held = A.catalog(s, d).groupBy(F.length(F.floor("price").cast("string")).cast("long").alias("digits")).agg(F.count("*").alias("n"))
    total = held.agg(F.sum("n").alias("total"))
    return held.crossJoin(total).select("digits", "n", F.round(F.col("n") / F.col("total"), 8).alias("share"))


@query("category_means", "SELECT p_type AS category, count(*) AS n, round(avg(p_size), 6) AS mean_size, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1")
def category_means(s, d):
    return A.catalog(s, d).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("size"), 6).alias("mean_size"), F.round(F.avg("retail"), 6).alias("mean_price"))


@query("corr_matrix", "SELECT a, b, round(coalesce(r, 0), 6) AS r, abs(round(coalesce(r, 0), 6)) >= 0.8 AS strong FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(_AXES["lineitem"]) for b in _AXES["lineitem"][i + 1 :]) + ")")
def corr_matrix(s, d):
    held = rounded(C.correlations(A.read(s, d, "lineitem"), _AXES["lineitem"]), "r", places=6)
    return held.withColumn("strong", F.abs("r") >= 0.8)


@query("spearman", W + """, c AS (SELECT item_id, sum(view_count) AS v, sum(cart_count) AS c FROM train GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS a, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS b FROM c)
 SELECT round(coalesce(corr(a, b), 0), 6) AS rho FROM r""")
def spearman(s, d):
    held = train(s, d).groupBy("item_id").agg(F.sum("view_count").alias("v"), F.sum("cart_count").alias("c"))
    return Q.mid_ranked(Q.mid_ranked(held, "v", "a"), "c", "b").agg(F.round(S.correlation(F.col("a"), F.col("b")), 6).alias("rho"))


@query("decimal_percentile", """SELECT p_brand AS brand, CAST(round(a + (b - a) * f, 4) AS DECIMAL(38,4)) AS median, digits FROM (SELECT p_brand, min(x) AS a, max(x) AS b, any_value(f) AS f, any_value(digits) AS digits FROM
 (SELECT p_brand, x, i, (n - 1) * CAST(0.5 AS DECIMAL(3,2)) - floor((n - 1) * 0.5) AS f, floor((n - 1) * 0.5) AS lo, ceil((n - 1) * 0.5) AS hi, digits FROM (SELECT p_brand, CAST(p_retailprice AS DECIMAL(20,2)) AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n,
 max(length(CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR))) OVER (PARTITION BY p_brand) AS digits FROM part)) WHERE i = lo OR i = hi GROUP BY 1)""")
def decimal_percentile(s, d):
    held = A.catalog(s, d).select("brand", "price")
    digits = held.groupBy("brand").agg(F.max(F.length(F.floor("price").cast("string"))).cast("long").alias("digits"))
    return C.decimal_percentile(held, "price", "0.50", "brand").join(digits, "brand").select("brand", F.col("percentile").cast("decimal(38,4)").alias("median"), "digits")


@query("user_summary", "SELECT c_mktsegment AS segment, count(*) AS users, round(avg(c_acctbal), 6) AS mean_balance, round(stddev_pop(c_acctbal), 6) AS std_balance, round(quantile_cont(c_acctbal, 0.5), 6) AS median_balance FROM customer GROUP BY 1")
def user_summary(s, d):
    held = A.read(s, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    stats = held.groupBy("segment").agg(F.count("*").alias("users"), F.avg("c_acctbal").alias("mean_balance"), F.stddev_pop("c_acctbal").alias("std_balance"))
    return rounded(with_quantiles(stats, held, "c_acctbal", {"median_balance": 0.5}, "segment"), "mean_balance", "std_balance", "median_balance", places=6)


@query("affordability", "SELECT c_custkey AS user_id, count(p_partkey) AS affordable, round(count(p_partkey) / (SELECT count(*) FROM part), 8) AS share FROM customer LEFT JOIN part ON p_retailprice <= c_acctbal GROUP BY 1")
def affordability(s, d):
    users = A.read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("budget"))
    return rounded(V.affordability(users, A.catalog(s, d), "budget", "retail"), "share").drop("budget")


@query("affordability_by_tier", "WITH a AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'overdrawn' WHEN c_acctbal < 2000 THEN 'low' WHEN c_acctbal < 6000 THEN 'medium' ELSE 'high' END AS tier, count(p_partkey) / (SELECT count(*) FROM part) AS share FROM customer LEFT JOIN part ON p_retailprice <= c_acctbal GROUP BY 1, 2) SELECT tier, count(*) AS users, round(avg(share), 6) AS mean_share, round(min(share), 6) AS min_share, round(max(share), 6) AS max_share FROM a GROUP BY 1")
def affordability_by_tier(s, d):
    users = A.read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("budget"))
    held = V.affordability(users, A.catalog(s, d), "budget", "retail").withColumn("tier", S.tier(F.col("budget"), [(0, "overdrawn"), (2000, "low"), (6000, "medium")], "high"))
    return held.groupBy("tier").agg(F.count("*").alias("users"), *(F.round(f("share"), 6).alias(f"{n}_share") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))


@query("price_signal", W + """, x AS (SELECT event_type, (item_id * 20.0) > c_acctbal AS over FROM ev JOIN customer ON c_custkey = user_id), c AS (SELECT over, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'add_to_cart') AS carts, count(*) FILTER (event_type = 'purchase') AS purchases FROM x GROUP BY 1)
 SELECT CASE WHEN over THEN 'over' ELSE 'within' END AS budget, views, carts, purchases, round(carts / views, 8) AS cart_rate, round(purchases / views, 8) AS purchase_rate FROM c""")
def price_signal(s, d):
    held = A.events(s, d).join(A.read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal"), "user_id").withColumn("over", F.col("item_id") * 20.0 > F.col("c_acctbal"))
    c = held.groupBy(F.when(F.col("over"), "over").otherwise("within").alias("budget")).agg(*(F.count_if(Q.kind(k)).alias(n) for k, n in (("view", "views"), ("add_to_cart", "carts"), ("purchase", "purchases"))))
    return c.select("*", F.round(F.try_divide("carts", "views"), 8).alias("cart_rate"), F.round(F.try_divide("purchases", "views"), 8).alias("purchase_rate"))


def vectors(s, d):
    return A.read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"


@query("nearest_neighbors", f"WITH {_VEC}, p AS (SELECT a.vec_id, b.vec_id AS neighbor, round(list_inner_product(a.vec, b.vec) / sqrt(list_inner_product(a.vec, a.vec)) / sqrt(list_inner_product(b.vec, b.vec)), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id ) SELECT vec_id, neighbor, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor) AS INT) AS rank FROM p QUALIFY rank <= 5")
def nearest_neighbors(s, d):
    """Five nearest by cosine over all vectors."""
    return neighbors(vectors(s, d))


def neighbors(held):
    return rounded(V.score_blocks(held, held.withColumnRenamed("vec_id", "neighbor"), 5, "vec_id", "neighbor", metric="cosine", skip_same=True), "score", places=6)


def neighbor_index(s, d):
    held = vectors(s, d)
    return N.search(held, held.withColumnRenamed("vec_id", "neighbor"), 5, "vec_id", "neighbor", metric="cosine", skip_same=True)


@query("neighbor_search", oracle_of("nearest_neighbors"))
def neighbor_search(s, d):
    """Five nearest by cosine, found through lists around centroids; exact."""
    return rounded(neighbor_index(s, d).rows, "score", places=6)


_CENT = f"{_VEC}, x AS (SELECT label, generate_subscripts(vec, 1) AS i, unnest(vec) AS e FROM v), m AS (SELECT label, i, avg(e) AS e FROM x GROUP BY 1, 2), c AS (SELECT label, list(e ORDER BY i) AS centroid FROM m GROUP BY 1)"


@query("nearest_prototype", f"WITH {_CENT}, n AS (SELECT v.vec_id, v.label, arg_min(c.label, (round(list_distance(v.vec, c.centroid), 9), c.label)) AS nearest FROM v CROSS JOIN c GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg(CAST(nearest = label AS INT)), 8) AS accuracy FROM n GROUP BY 1")
def nearest_prototype(s, d):
    held = vectors(s, d)
    found = V.nearest_prototype(held, V.centroids(held, "label", "vec"), "vec_id", "vec", "label").join(held.select("vec_id", "label"), "vec_id")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("nearest") == F.col("label")).cast("double")), 8).alias("accuracy"))


@query("archetype_matches", f"WITH {_CENT}, d AS (SELECT c.label, v.vec_id, round(1 / (1 + list_distance(v.vec, c.centroid)), 9) AS score FROM v CROSS JOIN c) SELECT label, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INT) AS rank FROM d QUALIFY rank <= 5")
def archetype_matches(s, d):
    held = vectors(s, d)
    near = held.select("vec_id", "vec").crossJoin(V.few(V.centroids(held, "label", "vec"))).select("label", "vec_id", F.round(1 / (1 + S.euclidean(F.col("vec"), F.col("centroid"))), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", place).where("rank <= 5").withColumn("score", F.round("score", 6))


# Fixed vectors stand in for a trained model: users and items take rows of the embeddings.
_MODEL = W + ", uv AS (SELECT user_id, CAST(embedding AS DOUBLE[]) AS vec FROM us JOIN embeddings ON vec_id = user_id % (SELECT count(*) FROM embeddings)), iv AS (SELECT item_id, CAST(embedding AS DOUBLE[]) AS vec FROM it JOIN embeddings ON vec_id = (item_id * 3 + 7) % (SELECT count(*) FROM embeddings))"
_SCORED = RANKED + _MODEL[len(W):] + ", av AS (SELECT item_id FROM it WHERE status = 'available'), sx AS (SELECT user_id, item_id, round(list_inner_product(uv.vec, iv.vec), 9) AS mf, cart FROM uv CROSS JOIN iv JOIN av USING (item_id) JOIN ps USING (item_id))"


def model(s, d):
    e = A.read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    n = e.count()
    u = A.users(s, d).withColumn("vec_id", F.col("user_id") % n).join(e, "vec_id").select("user_id", "vec")
    i = A.items(s, d).withColumn("vec_id", ((F.col("item_id") * 3 + 7) % n).cast("long")).join(e, "vec_id").select("item_id", "vec", "status")
    return u, i


@query("score_all_items", _SCORED + " SELECT user_id, item_id, round(mf, 6) AS score FROM sx")
def score_all_items(s, d):
    u, i = model(s, d)
    held = V.score_blocks(u, i.where("status = 'available'").select("item_id", "vec"), None, "user_id", "item_id")
    return held.select("user_id", "item_id", F.round("score", 6).alias("score"))


@query("topk_scored", _SCORED + " SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY mf DESC, item_id) AS INT) AS position FROM sx WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM seen WHERE task = 'purchase') QUALIFY position <= 10")
def topk_scored(s, d):
    u, i = model(s, d)
    seen = D.train_seen(train(s, d), "purchase")
    scores = V.score_blocks(R.with_seen_count(u, seen), i.where("status = 'available'").select("item_id", "vec"), 10, "user_id", "item_id", more="n_seen")
    return R.top_k_scored(scores.join(seen, ["user_id", "item_id"], "left_anti"), 10).select("user_id", "item_id", "position")


def item_index(s, d):
    u, i = model(s, d)
    seen = D.train_seen(train(s, d), "purchase")
    return N.search(R.with_seen_count(u, seen), i.where("status = 'available'").select("item_id", "vec"), 10, "user_id", "item_id", more="n_seen"), seen


@query("topk_search", oracle_of("topk_scored"))
def topk_search(s, d):
    """Ten best unseen items by inner product, with cells of items left out by norm and angle; exact."""
    found, seen = item_index(s, d)
    return R.top_k_scored(found.rows.join(seen, ["user_id", "item_id"], "left_anti"), 10).select("user_id", "item_id", "position")


@query("search_work")
def search_work(s, d):
    """What the bounds of both searches skip: pairs of cells that met, pairs of rows met in part and computed in full."""
    both = {"neighbors": neighbor_index(s, d), "items": item_index(s, d)[0]}
    parts = [found.work.withColumn("search", F.lit(name)) for name, found in both.items()]
    return parts[0].unionByName(parts[1])


ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
_HYBRID = _SCORED + """, z AS (SELECT user_id, item_id, coalesce((mf - avg(mf) OVER w) / nullif(stddev_pop(mf) OVER w, 0), 0) AS m, coalesce((cart - avg(cart) OVER w) / nullif(stddev_pop(cart) OVER w, 0), 0) AS c FROM sx WINDOW w AS (PARTITION BY user_id)),
 hy AS MATERIALIZED (SELECT alpha, user_id, item_id, round(alpha * m + (1 - alpha) * c, 9) AS score FROM z CROSS JOIN (VALUES (CAST(0.0 AS DOUBLE)), (0.25), (0.5), (0.75), (1.0)) t(alpha)),
 hp AS MATERIALIZED (SELECT alpha, user_id, item_id, row_number() OVER (PARTITION BY alpha, user_id ORDER BY score DESC, item_id) AS position FROM hy WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM seen WHERE task = 'purchase') QUALIFY position <= 10),
 vr AS (SELECT user_id, item_id FROM rel WHERE split = 'validation' AND task = 'purchase'), hu AS (SELECT alpha, user_id, count(*) AS relevant, count(position) AS hits, coalesce(sum(ln(2) / ln(position + 1)), 0) AS dcg FROM (SELECT x.alpha, vr.user_id, vr.item_id, position FROM vr CROSS JOIN (SELECT DISTINCT alpha FROM hy) x LEFT JOIN hp ON hp.alpha = x.alpha AND hp.user_id = vr.user_id AND hp.item_id = vr.item_id) GROUP BY 1, 2),
 hm AS (SELECT alpha, count(*) AS eligible_users, avg(hits / relevant) AS recall, avg(dcg / list_sum(list_transform(range(1, least(10, relevant) + 1), lambda i: ln(2) / ln(i + 1)))) AS ndcg FROM hu GROUP BY 1)"""


def sides(s, d):
    """Users with their vector and number of seen items, available items with vector and cart popularity, and seen pairs."""
    u, i = model(s, d)
    seen = D.train_seen(train(s, d), "purchase")
    cart = R.popularity_scores(train(s, d), A.items(s, d)).select("item_id", "cart")
    # cut, as each side is counted and read for its moments and again for its scores
    return cut(R.with_seen_count(u, seen)), cut(i.where("status = 'available'").join(cart, "item_id").select("item_id", "vec", "cart")), seen


@query("hybrid_scores", _HYBRID + " SELECT alpha, user_id, item_id, round(score, 6) AS score FROM hy")
def hybrid_scores(s, d):
    users, items, _ = sides(s, d)
    return rounded(V.hybrid(users, items, ALPHAS), "score", places=6)


def alpha_metrics(s, d):
    users, items, seen = sides(s, d)
    held = V.hybrid(users, items, ALPHAS, 10, "n_seen").join(seen, ["user_id", "item_id"], "left_anti")
    lists = R.top_k_scored(held, 10, "alpha").select("alpha", "user_id", "item_id", "position")
    want = D.relevance(A.events(s, d), "purchase").where("split = 'validation'").select("user_id", "item_id", F.explode(F.array(*map(F.lit, ALPHAS))).alias("alpha"))
    return R.macro(R.user_metrics(R.listed_positions(lists, want, "alpha"), (10,), "alpha"), "alpha")


@query("eval_hybrid", _HYBRID + " SELECT alpha, eligible_users, round(recall, 8) AS recall, round(ndcg, 8) AS ndcg FROM hm")
def eval_hybrid(s, d):
    return rounded(alpha_metrics(s, d).select("alpha", "eligible_users", "recall", "ndcg"), "recall", "ndcg")


@query("select_alpha", _HYBRID + " SELECT arg_max(alpha, (round(ndcg, 9), round(recall, 9), alpha)) AS alpha, round(max(ndcg), 8) AS ndcg FROM hm")
def select_alpha(s, d):
    return rounded(V.select_alpha(rounded(alpha_metrics(s, d), "ndcg", "recall", places=9)), "ndcg")


@query("score_decomposition", _SCORED + " SELECT round(var_pop(mf), 6) AS mf_variance, round(var_pop(cart), 6) AS cart_variance, round(avg(mf), 6) AS mf_mean, count(*) AS pairs FROM sx")
def score_decomposition(s, d):
    """Over all pairs, from moments of blocks: no pair is written."""
    users, items, _ = sides(s, d)
    mf = V.merged_moments(V.score_moments(users, items, "user_id", "item_id"))
    cart = items.agg(F.var_pop("cart").alias("cart_variance"))  # each user has all items, so pairs vary as items do
    return mf.crossJoin(cart).select(F.round(F.col("m2") / F.col("n"), 6).alias("mf_variance"), F.round("cart_variance", 6).alias("cart_variance"), F.round("mean", 6).alias("mf_mean"), F.col("n").alias("pairs"))


@query("zscore_safe", "SELECT p_partkey AS product_id, round(coalesce((p_size - avg(p_size) OVER w) / nullif(stddev_pop(p_size) OVER w, 0), 0), 6) AS z FROM part WINDOW w AS (PARTITION BY p_brand)")
def zscore_safe(s, d):
    return C.standardized(A.catalog(s, d).select("product_id", "brand", "size"), "size", "z", "brand").select("product_id", F.round("z", 6).alias("z"))


@query("math_signals", "SELECT event_id, round(ln(1 + value), 6) AS log1p, round(log10(1 + value), 6) AS log10, round(ln(2 + value) / ln(2), 6) AS log2, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS logistic, round(sqrt(value), 6) AS sqrt, CAST(ceil(value) AS BIGINT) AS ceil, CAST(floor(value) AS BIGINT) AS floor FROM events WHERE value >= 0")
def math_signals(s, d):
    v = F.col("value")
    held = A.events(s, d).where("value >= 0")
    return held.select("event_id", *(F.round(x, 6).alias(n) for n, x in (("log1p", F.log1p(v)), ("log10", F.log10(1 + v)), ("log2", F.log2(2 + v)), ("logistic", S.logistic((v - 50) / 10)), ("sqrt", F.sqrt(v)))), F.ceil(v).alias("ceil"), F.floor(v).alias("floor"))


@query("clip_minmax", "SELECT p_partkey AS product_id, round(greatest(0, least(1, p_size / 40.0)), 6) AS clipped, round(CASE WHEN max(p_size) OVER () > min(p_size) OVER () THEN (p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()) ELSE 0 END, 6) AS scaled FROM part")
def clip_minmax(s, d):
    held = A.catalog(s, d)
    ends = held.agg(F.min("size").alias("low"), F.max("size").alias("high"))  # one row, so no window over all rows
    scaled = F.when(F.col("high") > F.col("low"), (F.col("size") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return held.crossJoin(F.broadcast(ends)).select("product_id", F.round(S.clip(F.col("size") / 40.0), 6).alias("clipped"), F.round(scaled, 6).alias("scaled"))


@query("slugify", "SELECT p_partkey AS product_id, trim(regexp_replace(replace(lower(p_name), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugify(s, d):
    return A.catalog(s, d).select("product_id", S.slugify(F.col("name")).alias("slug"))


@query("stable_noise", "SELECT p_partkey AS product_id, round(CAST(CAST('0x' || substr(sha256('42:' || p_name), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551615.0, 9) AS noise FROM part")
def stable_noise(s, d):
    return A.catalog(s, d).select("product_id", F.round(S.stable_noise(42, F.col("name")), 9).alias("noise"))


@query("tier_bucketing", "SELECT c_custkey AS user_id, CASE WHEN c_acctbal < 0 THEN 'overdrawn' WHEN c_acctbal < 2000 THEN 'low' WHEN c_acctbal < 6000 THEN 'medium' ELSE 'high' END AS tier FROM customer")
def tier_bucketing(s, d):
    return A.read(s, d, "customer").select(F.col("c_custkey").alias("user_id"), S.tier(F.col("c_acctbal"), [(0, "overdrawn"), (2000, "low"), (6000, "medium")], "high").alias("tier"))


@query("largest_remainder", """WITH w AS (SELECT c_mktsegment AS segment, count(*) AS weight FROM customer GROUP BY 1), x AS (SELECT *, round(weight / sum(weight) OVER () * 1000, 9) AS share FROM w), r AS (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, weight DESC, segment) AS r, 1000 - sum(floor(share)) OVER () AS rest FROM x)
 SELECT segment, CAST(floor(share) + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM r""")
def largest_remainder(s, d):
    weights = A.read(s, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("weight"))
    return S.largest_remainder(weights, "weight", 1000, [F.col("weight").desc(), "segment"]).select("segment", "n")


@query("format_strings", "SELECT p_partkey AS product_id, 'Item ' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || ' / ' || upper(p_brand) AS label, replace(lower(p_type), ' ', '_') AS code, length(p_name) AS name_length FROM part")
def format_strings(s, d):
    return A.catalog(s, d).select("product_id", F.concat(F.lit("Item "), F.format_string("%07d", "product_id"), F.lit(" / "), F.upper("brand")).alias("label"), F.replace(F.lower("category"), F.lit(" "), F.lit("_")).alias("code"), F.length("name").cast("long").alias("name_length"))


@query("date_functions", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS seconds, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d') AS horizon, extract(hour FROM ts) AS hour FROM events")
def date_functions(s, d):
    ts = F.col("ts")
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.date_trunc("second", ts).cast("timestamp_ntz"))
    return A.events(s, d).select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), seconds.alias("seconds"), F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd").alias("day"), F.date_format(ts + F.expr("INTERVAL 7 DAYS"), "yyyy-MM-dd").alias("horizon"), F.hour(ts).cast("long").alias("hour"))


@query("preference_match", f"""WITH {_VEC}, t AS (SELECT generate_subscripts(vec, 1) AS i, vec_id, unnest(vec) AS x FROM v), z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z, 1 / (1 + exp(-x)) AS p FROM t),
 s AS (SELECT a.vec_id AS user_vec, b.vec_id AS item_vec, sum((a.p - 0.5) * greatest(-2.5, least(2.5, b.z))) AS top, 1 + sum(abs(a.p - 0.5)) AS w FROM z a JOIN z b USING (i) WHERE a.vec_id <> b.vec_id GROUP BY 1, 2) SELECT user_vec, item_vec, round(1 / (1 + exp(-2.2 * top / w)), 6) AS match FROM s""")
def preference_match(s, d):
    """Preferences of every vector against all others, attributes standardised over all vectors."""
    return matches(vectors(s, d), F.lit(True), F.lit(True)).where("user_vec <> item_vec")


def matches(held, profile, product):
    long = held.select("vec_id", F.posexplode("vec").alias("i", "x"))
    stats = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = long.join(stats, "i").groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", ((F.col("x") - F.col("m")) / F.col("sd")).alias("z"), S.logistic(F.col("x")).alias("p")))).alias("a"))
    # a match is a logistic of a dot product: centred preferences over their weight, with clipped attributes
    weight = 1 + F.aggregate("a", F.lit(0.0), lambda x, y: x + F.abs(y["p"] - 0.5))
    users = z.where(profile).withColumn("w", weight).select(F.col("vec_id").alias("user_vec"), F.transform("a", lambda x: (x["p"] - 0.5) / F.col("w")).alias("vec"))
    items = z.where(product).select(F.col("vec_id").alias("item_vec"), F.transform("a", lambda x: S.clip(x["z"], -2.5, 2.5)).alias("vec"))
    held = V.score_blocks(cut(users), cut(items), None, "user_vec", "item_vec", digits=None, in_order=True)
    return held.select("user_vec", "item_vec", S.rounded_number(S.logistic(2.2 * F.col("score")), 6).alias("match"))


@query("continuity_score", "SELECT a.p_partkey AS a, b.p_partkey AS b, round(0.65 * CAST(a.p_type = b.p_type AS INT) + 0.35 * (1 - (abs(a.p_size - b.p_size) / CAST(50 AS DOUBLE) + abs(a.p_retailprice - b.p_retailprice) / CAST(5000 AS DOUBLE)) / 2), 9) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def continuity_score(s, d):
    """All pairs of a brand's products. Each brand is dealt into groups whose pairs meet in tasks of their own."""
    return continuity_pairs(A.catalog(s, d), 16)


def continuity_pairs(products, groups=1):
    held = products.select("product_id", "brand", "category", "size", "retail")
    own, last = F.pmod(F.xxhash64("product_id"), F.lit(groups)), F.lit(groups - 1).cast("long")
    # each two groups meet once, the lower one on the left; only a group's pairs with itself come in both orders
    a = held.withColumn("i", own).withColumn("j", F.explode(F.sequence("i", last))).alias("a")
    b = held.withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "j"))).alias("b")
    met = (F.col("a.brand") == F.col("b.brand")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    x, y = F.col("a.product_id"), F.col("b.product_id")
    both = a.join(b, met & F.when(F.col("a.i") == F.col("a.j"), x < y).otherwise(x != y))
    away = lambda name, whole: F.abs(F.col(f"a.{name}") - F.col(f"b.{name}")) / whole
    score = 0.65 * (F.col("a.category") == F.col("b.category")).cast("double") + 0.35 * (1 - (away("size", 50.0) + away("retail", 5000.0)) / 2)
    return both.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), S.rounded_number(score, 9).alias("score"))
