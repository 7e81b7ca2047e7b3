"""From the driver's tables to the interaction domain.

The mapping is a labelled convention: the five event types of the ``events`` table stand
for the five steps of a funnel, the number in ``props`` for the item. Real logs come in
through ``sources.readers`` with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = {"error": "impression", "view": "view", "click": "favorite", "signup": "add_to_cart", "purchase": "purchase"}
#: Half-open windows [start, end) of the three splits, in UTC.
SPLITS = [("train", "2024-01-01", "2024-01-21"), ("validation", "2024-01-21", "2024-01-26"), ("test", "2024-01-26", "2024-01-31")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, item_id, event_type, value)."""
    kind = F.create_map(*(F.lit(x) for pair in EVENT_TYPES.items() for x in pair))[F.col("event_type")]
    item = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", item.alias("item_id"), kind.alias("event_type"), "value")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id").distinct()


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, status): 17 of 20 items are available."""
    return events(spark, sf_dir).select("item_id").distinct().withColumn("status", F.when(F.col("item_id") % 20 < 17, "available").otherwise("sold_out"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: id, name, category (type), tags (brand and name words), exact price, rarity in [0, 1]."""
    part = read(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail"), F.col("p_retailprice").cast("decimal(38,2)").alias("price"),
        F.when(F.col("p_partkey") % 20 < 17, "available").otherwise("sold_out").alias("status"),
    )


#: The same domain for the SQL engine that checks results.
SQL_WORLD = """WITH ev AS (
  SELECT event_id, ts, user_id, CAST(props->>'$.k' AS INT) AS item_id,
    CASE event_type WHEN 'error' THEN 'impression' WHEN 'view' THEN 'view' WHEN 'click' THEN 'favorite'
      WHEN 'signup' THEN 'add_to_cart' WHEN 'purchase' THEN 'purchase' END AS event_type, value,
    CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-21' THEN 'train'
      WHEN ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-26' THEN 'validation'
      WHEN ts >= TIMESTAMP '2024-01-26' AND ts < TIMESTAMP '2024-01-31' THEN 'test' END AS split
  FROM events),
us AS (SELECT DISTINCT user_id FROM ev),
it AS (SELECT DISTINCT item_id, CASE WHEN item_id % 20 < 17 THEN 'available' ELSE 'sold_out' END AS status FROM ev),
facts AS (SELECT split, user_id, item_id,
    count(*) FILTER (event_type = 'impression') AS impression_count, count(*) FILTER (event_type = 'view') AS view_count,
    count(*) FILTER (event_type = 'favorite') AS favorite_count, count(*) FILTER (event_type = 'add_to_cart') AS cart_count,
    count(*) FILTER (event_type = 'purchase') AS purchase_count,
    min(ts) FILTER (event_type = 'impression') AS first_impression_at, max(ts) FILTER (event_type = 'impression') AS last_impression_at,
    min(ts) FILTER (event_type = 'view') AS first_view_at, max(ts) FILTER (event_type = 'view') AS last_view_at,
    min(ts) FILTER (event_type = 'favorite') AS first_favorite_at, max(ts) FILTER (event_type = 'favorite') AS last_favorite_at,
    min(ts) FILTER (event_type = 'add_to_cart') AS first_cart_at, max(ts) FILTER (event_type = 'add_to_cart') AS last_cart_at,
    min(ts) FILTER (event_type = 'purchase') AS first_purchase_at, max(ts) FILTER (event_type = 'purchase') AS last_purchase_at,
    min(ts) AS first_interaction_at, max(ts) AS last_interaction_at
  FROM ev WHERE split IS NOT NULL GROUP BY 1, 2, 3),
train AS (SELECT * FROM facts WHERE split = 'train'),
rel AS (SELECT DISTINCT split, task, user_id, item_id FROM ev JOIN (VALUES
    ('viewplus','view'), ('favoriteplus','favorite'), ('favoriteplus','add_to_cart'), ('favoriteplus','purchase'), ('purchase','purchase')) AS t(task, kind)
    ON ev.event_type = t.kind WHERE split IS NOT NULL),
seen AS (SELECT task, user_id, item_id FROM rel WHERE split = 'train'),
cand AS (SELECT task, item_id FROM it CROSS JOIN (VALUES ('viewplus'), ('favoriteplus'), ('purchase')) AS t(task)
    WHERE task <> 'purchase' OR status = 'available')"""
