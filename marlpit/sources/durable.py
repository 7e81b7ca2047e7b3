"""Cuts of lineage for iterative jobs, in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _OWN.setdefault("folder", tempfile.mkdtemp(prefix="marlpit-"))).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
