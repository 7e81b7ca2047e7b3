"""Readers with declared schemas: nothing is inferred, extra columns are left in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.scalar import parse_utc

SCHEMAS = {
    "events": "event_id string, session_id string, user_id string, product_id string, product_category string, event_type string, timestamp string, exposure_source string, generation_version string, generation_seed int",
    "users": "user_id string, archetype string, budget_tier string, activity_tier string, generation_version string, generation_seed int",
    "products": "name string, category_name string, tags string, price string, rarity double, status string, catalog_version string, generation_seed int",
    "sessions": "session_id string, user_id string, started_at string, ended_at string, duration_seconds int, entry_type string, impression_count int, generation_version string, generation_seed int",
}


def read_csv(spark: SparkSession, path: str, kind: str, expect: dict[str, object] | None = None) -> DataFrame:
    """A CSV file of one of SCHEMAS by header names; columns that it lacks are null. ``expect`` names columns that must hold one value, as provenance does."""
    schema = SCHEMAS[kind]
    names = [c.split()[0] for c in schema.split(", ")]
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    held = raw.select(*((F.col(f"`{n}`") if n in raw.columns else F.lit(None)).cast(c.split()[1]).alias(n) for n, c in zip(names, schema.split(", "), strict=True)))
    for column, value in (expect or {}).items():
        wrong = held.where(~F.col(column).eqNullSafe(F.lit(value))).limit(1).count()
        if wrong:
            raise ValueError(f"{path}: {column} is not {value!r} everywhere")
    return held


def events_from_csv(spark: SparkSession, *paths: str, expect: dict[str, object] | None = None) -> DataFrame:
    """Exposure and engagement logs as one table in the domain's columns; times without a zone are refused."""
    parts = [read_csv(spark, p, "events", expect) for p in paths]
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p, allowMissingColumns=True)
    out = held.withColumn("ts", parse_utc(F.col("timestamp")))
    if out.where("ts is null").limit(1).count():
        raise ValueError("an event's time is missing or has no zone")
    return out.select("event_id", F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"), "user_id", F.col("product_id").alias("item_id"), "event_type", "session_id", "exposure_source")


def sets_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, item_id) from a JSON object of user to item list."""
    held = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("user_id", "items"))
    return held.select("user_id", F.explode("items").alias("item_id"))
