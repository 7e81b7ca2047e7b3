"""Sinks: datasets with a manifest, partitioned experiment tables, Markdown reports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _digest(df: DataFrame) -> Column:
    """A sum of row digests, which doesn't depend on the order of rows or files."""
    return F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)"))


def write_dataset(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", policies: dict | None = None) -> dict:
    """Write each table and a manifest with its rows, bytes and a digest that doesn't depend on the order of rows or files.

    Rows and digest are observed while the rows are written, so a table is computed once and not read back; ``check_dataset``
    reads it when its files are in doubt. CSV files hold text, so their digest is that of the rows as text.
    """
    spark = next(iter(tables.values())).sparkSession
    manifest: dict = {"policies": policies or {}, "artifacts": {}}
    for name, df in tables.items():
        path = f"{folder}/{name}"
        ready = csv_ready(df) if fmt == "csv" else df
        ready = ready.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in ready.columns)) if fmt == "csv" else ready
        seen = Observation()
        writer = ready.observe(seen, F.count("*").alias("rows"), _digest(ready).alias("digest")).write.mode("overwrite")
        (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
        manifest["artifacts"][name] = {"rows": seen.get.get("rows") or 0, "digest": str(seen.get.get("digest") or 0), "bytes": folder_bytes(spark, path), "format": fmt}
    write_json(spark, manifest, f"{folder}/manifest.json")
    return manifest


def check_dataset(spark: SparkSession, folder: str) -> dict[str, bool]:
    """Whether the files of each table still hold the rows of the manifest; a table without files doesn't."""
    told = {}
    for name, entry in read_json(spark, f"{folder}/manifest.json")["artifacts"].items():
        if "digest" not in entry:
            continue
        try:
            back = spark.read.option("header", True).csv(f"{folder}/{name}") if entry["format"] == "csv" else spark.read.format(entry["format"]).load(f"{folder}/{name}")
        except AnalysisException:  # no folder, or no file that has a schema
            told[name] = entry["rows"] == 0 and entry["bytes"] == folder_bytes(spark, f"{folder}/{name}")
            continue
        rows, digest = back.agg(F.count("*"), _digest(back)).first()
        told[name] = (rows, str(digest or 0)) == (entry["rows"], entry["digest"])
    return told


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a path of any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """Sorted-key JSON through the store's own interface."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode()))
    finally:
        out.close()


def write_package(tables: dict[str, DataFrame], documents: dict[str, dict], folder: str, source_manifest: str | None = None) -> dict:
    """An experiment's package: CSV tables, JSON documents and a manifest of all of them, which names the data set it rests on by digest."""
    spark = next(iter(tables.values())).sparkSession
    manifest = write_dataset(tables, folder, "csv", {"source": read_json(spark, source_manifest)["artifacts"] if source_manifest else None})
    for name, value in documents.items():
        write_json(spark, value, f"{folder}/{name}.json")
        manifest["artifacts"][f"{name}.json"] = {"bytes": folder_bytes(spark, f"{folder}/{name}.json")}
    write_json(spark, manifest, f"{folder}/manifest.json")
    return manifest


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON document of any store that Spark reads."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def read_package(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a package, as a control for a later experiment; it must have the rows that its manifest says."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{name}")
    wanted = read_json(spark, f"{folder}/manifest.json")["artifacts"][name]["rows"]
    if (found := df.count()) != wanted:
        raise ValueError(f"{name} has {found} rows, its manifest says {wanted}")
    return df


def write_experiment(df: DataFrame, folder: str, experiment: str, model: str) -> None:
    """One partition an experiment and model; rewriting one leaves the others."""
    held = df.withColumns({"experiment": F.lit(experiment), "model": F.lit(model)})
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "model").parquet(folder)


def csv_ready(df: DataFrame) -> DataFrame:
    """Columns as CSV can hold them: arrays joined by bars, flags as 0 and 1, times with a Z."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind == "boolean":
            c = c.cast("int")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        out.append(c.alias(f.name))
    return df.select(*out)


def markdown(df: DataFrame, title: str, limit: int = 50) -> str:
    """A small result as a Markdown table; at most ``limit`` rows are shown, and it says so."""
    rows = df.limit(limit + 1).collect()
    head = f"## {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    body = "".join("| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in rows[:limit])
    return head + body + (f"\nOnly the first {limit} rows are shown.\n" if len(rows) > limit else "")
