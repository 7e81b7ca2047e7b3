"""Keyed tables stored as snapshots: upserts rewrite only the buckets they touch, and one rename commits them.

A snapshot is a manifest, ``manifests/<number>.json``: for each hash bucket the folder with its rows, and the
names of the batches it holds. An upsert writes new folders for its buckets, then a manifest that names them and, for
the others, the old folders. The manifest is written aside and renamed to the next number, which fails if that exists: readers see
the old snapshot or the new one, two writers can't both commit, and whatever a failed writer
leaves is named by no manifest. A batch that a snapshot already holds changes nothing, so a stream may repeat it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlpit.sources.sinks import read_json, write_json


@dataclass(frozen=True)
class Snapshot:
    number: int = 0
    buckets: dict[str, str] = field(default_factory=dict)
    batches: tuple[str, ...] = ()
    schema: str = ""


class SnapshotTable:
    """Rows by ``key`` under ``path``. ``buckets`` is fixed with the first snapshot: the rows of one are rewritten together.
    The names of the last ``remembered`` batches are known."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = 64, remembered: int = 10_000) -> None:
        self.spark, self.path, self.key, self.n, self.remembered = spark, path.rstrip("/"), list(key), buckets, remembered

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> Snapshot:
        at, store = self._at(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return Snapshot()
        held = read_json(self.spark, f"{self.path}/manifests/{max(numbers)}.json")
        if held["n_buckets"] != self.n or held["key"] != self.key:
            raise ValueError("the table has another key or number of buckets")
        return Snapshot(max(numbers), held["buckets"], tuple(held["batches"]), held["schema"])

    def read(self, snapshot: Snapshot | None = None) -> DataFrame | None:
        """The rows of a snapshot, the latest one without it; None before the first."""
        held = snapshot or self.latest()
        if not held.number:
            return None
        empty = self.spark.createDataFrame([], self._schema(held.schema))
        return self.spark.read.schema(empty.schema).parquet(*sorted(held.buckets.values())) if held.buckets else empty

    @staticmethod
    def _schema(text: str):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(text))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.n)).cast("string")

    def upsert(self, rows: DataFrame, batch: str, guard: Callable[[DataFrame, DataFrame | None], None] | None = None, deleted: DataFrame | None = None) -> bool:
        """Add ``rows`` or put them in the place of those with their key, and drop the keys of ``deleted``; False if the batch is held already.

        Of incoming rows with one key the greatest (by its columns in order) stays; null keys are keys like others. The
        columns are those of the first batch. ``guard`` gets the incoming and the stored rows and may raise before anything is written.
        """
        held = self.latest()
        if batch in held.batches:
            return False
        stored = self.read(held)
        if stored is not None and sorted(rows.columns) != sorted(stored.columns):
            raise ValueError("the batch has other columns than the table")
        if guard:
            guard(rows, stored)
        names = stored.columns if stored is not None else rows.columns
        one = F.row_number().over(Window.partitionBy(*self.key).orderBy(*(F.desc(c) for c in names)))
        fresh = rows.select(*names).withColumn("_n", one).where("_n = 1").drop("_n")
        gone = deleted.select(*self.key).distinct() if deleted is not None else None
        keys = fresh.select(*self.key) if gone is None else fresh.select(*self.key).unionByName(gone)
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # at most the number of buckets
        same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in self.key]
        if gone is not None:
            fresh = fresh.join(gone, same(fresh, gone), "left_anti")
        old_folders = [held.buckets[b] for b in sorted(touched) if b in held.buckets]
        merged = fresh
        if old_folders:
            old = self.spark.read.schema(stored.schema).parquet(*old_folders)
            old = old.join(keys, same(old, keys), "left_anti")
            merged = fresh.unionByName(old)
        folder = f"{self.path}/data/{uuid4().hex}"
        merged.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        at, store = self._at(folder)
        written = {s.getPath().getName().split("=", 1)[1] for s in store.listStatus(at) if s.getPath().getName().startswith("_bucket=")}
        buckets = {b: f for b, f in held.buckets.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in written}
        schema = held.schema or fresh.schema.json()
        self._commit(held.number + 1, {"buckets": buckets, "batches": [*held.batches, batch][-self.remembered :], "key": self.key, "n_buckets": self.n, "schema": schema})
        return True

    def _commit(self, number: int, manifest: dict) -> None:
        aside = f"{self.path}/manifests/{uuid4().hex}.tmp"
        write_json(self.spark, manifest, aside)
        source, store = self._at(aside)
        target, _ = self._at(f"{self.path}/manifests/{number}.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(source, target, none)  # raises where another writer was first

    def clean(self, keep: int = 2) -> int:
        """Delete what the last ``keep`` snapshots don't name, and older manifests; the number of folders deleted. Not while a writer is at work."""
        newest = self.latest().number
        at, store = self._at(f"{self.path}/manifests")
        if not newest:
            return 0
        named: set[str] = set()
        for s in list(store.listStatus(at)):
            name = s.getPath().getName()
            if name.endswith(".json") and int(name[:-5]) > newest - keep:
                named |= {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in read_json(self.spark, f"{self.path}/manifests/{name}")["buckets"].values()}
            elif name.endswith((".json", ".tmp")):
                store.delete(s.getPath(), False)
        gone = 0
        for version in list(store.listStatus(self._at(f"{self.path}/data")[0])):
            parts = list(store.listStatus(version.getPath()))
            for part in parts:
                if part.getPath().getName().startswith("_bucket=") and f"{version.getPath().getName()}/{part.getPath().getName()}" not in named:
                    gone += store.delete(part.getPath(), True)
            if not any(f"{version.getPath().getName()}/{p.getPath().getName()}" in named for p in parts):
                store.delete(version.getPath(), True)
        return gone


def population_guard(key: Sequence[str], allowed: DataFrame) -> Callable[[DataFrame, DataFrame | None], None]:
    """A guard that refuses rows whose ``key`` columns are not in ``allowed``."""

    def check(rows: DataFrame, stored: DataFrame | None) -> None:
        strangers = rows.join(allowed.select(*key).distinct(), list(key), "left_anti").select(*key).limit(50).collect()
        if strangers:
            raise ValueError(f"rows refer to unknown {tuple(key)}: {[tuple(r) for r in strangers]}")

    return check
