"""A relational data source: tables kept as SQLite files, read and written by Spark tasks.

A table is a folder of files and numbered manifests. A file holds the rows of one task (several files if they are
more than ``FILE_BYTES``) and the manifest tells its smallest and largest key, so a condition on the key leaves out files
before any is opened; conditions on whole numbers and strings run inside the files. Writing by key range makes files of
disjoint ranges. Conditions are given to ``read_table``, not taken from ``where``: Spark 4.1 keeps a Python reader with the filters
of its first plan and reuses it in a later plan of the same frame that has none, which would lose rows. A file is written once, under a name of its own. A commit links the next manifest, which fails where
another writer was first; files of failed tasks are named by no manifest.

Columns are added without rewriting files: the manifest has their default, and a file that lacks one gives it.

The folder has to be mounted by all machines under one path, as SQLite opens files only; ``file:`` in front is fine.
Nulls in any column, NaN, empty tables and repeated rows are kept; a repeated key is refused by ``upsert`` alone.
"""

from __future__ import annotations

import json
import math
import os
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from decimal import Decimal
from pathlib import Path
from urllib.parse import quote, unquote, urlparse
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DateType, DecimalType, FractionalType, IntegralType, StringType, StructType, TimestampNTZType

from marlpit.sources.durable import cut

FORMAT, FILE_BYTES, FETCH = "relational", 64 << 20, 10_000
#: What a condition may ask of a column of whole numbers or strings, which a file answers as Spark would: its SQL, and
#: whether keys from ``low`` to ``high`` can pass.
OPERATORS = {
    "=": ("= ?", lambda low, high, v: low <= v <= high),
    ">": ("> ?", lambda low, high, v: high > v),
    ">=": (">= ?", lambda low, high, v: high >= v),
    "<": ("< ?", lambda low, high, v: low < v),
    "<=": ("<= ?", lambda low, high, v: low <= v),
    "in": ("IN (SELECT value FROM json_each(?))", lambda low, high, vs: any(low <= v <= high for v in vs)),
    "is null": ("IS NULL", None),
    "is not null": ("IS NOT NULL", lambda low, high, _: True),
}


@dataclass(frozen=True)
class Manifest:
    """One state of a table: schema and defaults as JSON, and for each file its name, rows, null keys, key range and columns."""

    number: int
    schema: str
    key: str
    files: list[dict] = field(default_factory=list)
    defaults: dict = field(default_factory=dict)

    @property
    def columns(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


def local(path: str) -> Path:
    return Path(unquote(urlparse(path).path) if path.startswith("file:") else path)


def latest(path: str, table: str) -> Manifest | None:
    numbers = [int(p.stem) for p in (local(path) / table).glob("*.json") if p.stem.isdigit()]
    return Manifest(**json.loads((local(path) / table / f"{max(numbers)}.json").read_text())) if numbers else None


def _commit(path: str, table: str, manifest: Manifest) -> None:
    folder = local(path) / table
    folder.mkdir(parents=True, exist_ok=True)
    aside = folder / f"{uuid4().hex}.tmp"
    aside.write_text(json.dumps(asdict(manifest)))
    try:
        os.link(aside, folder / f"{manifest.number}.json")
    finally:
        aside.unlink()


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def _sql_type(kind) -> str:
    if isinstance(kind, DecimalType):
        return "BLOB"  # no conversion: decimals are kept as their text
    return "INTEGER" if isinstance(kind, IntegralType) else "REAL" if isinstance(kind, FractionalType) else "TEXT" if isinstance(kind, (StringType, DateType, TimestampNTZType)) else "BLOB"


def _into(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"  # a number column keeps it as text, where NaN itself would become null
    if isinstance(value, Decimal):
        return str(value)
    return value.isoformat() if hasattr(value, "isoformat") else value


def _back(values: Sequence, kind: pa.DataType) -> pa.Array:
    if pa.types.is_floating(kind):
        values = [float(v) if isinstance(v, str) else v for v in values]
    elif pa.types.is_decimal(kind):
        values = [None if v is None else Decimal(v) for v in values]
    elif pa.types.is_boolean(kind):
        values = [None if v is None else bool(v) for v in values]
    elif pa.types.is_timestamp(kind) or pa.types.is_date(kind):
        values = [None if v is None else datetime.fromisoformat(v) for v in values]
    return pa.array(values, kind)


def may_hold(file: dict, operator: str, value) -> bool:
    """Whether a file can have rows whose key passes a condition."""
    if operator == "is null":
        return file["nulls"] > 0
    return file["low"] is not None and OPERATORS[operator][1](file["low"], file["high"], value)


@dataclass
class FileOfTable(InputPartition):
    name: str
    held: list[str]


class Reader(DataSourceReader):
    """One task a file that the conditions leave."""

    def __init__(self, options, schema: StructType) -> None:
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.manifest = latest(self.path, self.table)
        self.only = set(json.loads(options["files"])) if "files" in options else None
        self.where = json.loads(options.get("where", "[]"))
        for column, operator, _ in self.where:
            if operator not in OPERATORS or not isinstance(schema[column].dataType, (IntegralType, StringType)):
                raise ValueError(f"a file can't tell {column} {operator}")

    def partitions(self):
        on_key = [(o, v) for c, o, v in self.where if c == self.manifest.key]
        left = [x for x in self.manifest.files if (self.only is None or x["name"] in self.only) and all(may_hold(x, *c) for c in on_key)]
        return [FileOfTable(x["name"], x["columns"]) for x in left] or [FileOfTable("", [])]

    def read(self, partition):
        if not partition.name:
            return
        arrow = to_arrow_schema(self.schema)
        inner, given = [], []
        for c in self.schema.names:
            if c in partition.held:
                inner.append(_name(c))
            else:
                inner.append(f"? AS {_name(c)}")
                given.append(self.manifest.defaults.get(c))
        sql = f"SELECT * FROM (SELECT {', '.join(inner)} FROM rows)" + (" WHERE " + " AND ".join(f"{_name(c)} {OPERATORS[o][0]}" for c, o, _ in self.where) if self.where else "")
        given += [json.dumps(v) if o == "in" else v for _, o, v in self.where if "?" in OPERATORS[o][0]]
        at = quote(str(local(self.path) / self.table / partition.name))
        con = sqlite3.connect(f"file:{at}?mode=ro&immutable=1", uri=True)
        try:
            found = con.execute(sql, given)
            while rows := found.fetchmany(FETCH):
                yield pa.RecordBatch.from_arrays([_back(v, t.type) for v, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        finally:
            con.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Writer(DataSourceArrowWriter):
    """Files built in memory, ``FILE_BYTES`` at most and a batch, and written whole under new names."""

    def __init__(self, options, schema: StructType, overwrite: bool) -> None:
        self.path, self.table, self.schema = options["path"], options["table"], schema
        before = latest(self.path, self.table)
        self.key = options.get("key") or (before.key if before else schema.names[0])
        kept = set(json.loads(options["keep"])) if "keep" in options else set() if overwrite else None
        files = [f for f in before.files if kept is None or f["name"] in kept] if before else []
        if before and (files or "keep" in options):
            if before.columns.simpleString() != schema.simpleString():
                raise ValueError(f"{self.table} has other columns")
            self.next = replace(before, number=before.number + 1, files=files)
        else:
            self.next = Manifest(before.number + 1 if before else 1, schema.json(), self.key)

    def _new(self) -> sqlite3.Connection:
        con = sqlite3.connect(":memory:", isolation_level=None)
        con.execute("PRAGMA journal_mode = OFF")
        con.execute(f"CREATE TABLE rows ({', '.join(f'{_name(f.name)} {_sql_type(f.dataType)}' for f in self.schema)})")
        return con

    def _store(self, con: sqlite3.Connection) -> dict | None:
        k = _name(self.key)
        rows, keys, low, high = con.execute(f"SELECT count(*), count({k}), min({k}), max({k}) FROM rows").fetchone()
        if not rows:
            return None
        con.execute(f"CREATE INDEX by_key ON rows ({k})")
        folder, name = local(self.path) / self.table, f"{uuid4().hex}.db"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.tmp").write_bytes(con.serialize())
        (folder / f"{name}.tmp").rename(folder / name)
        return {"name": name, "rows": rows, "nulls": rows - keys, "low": low, "high": high, "columns": self.schema.names}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, con = [], self._new()
        add = f"INSERT INTO rows VALUES ({', '.join('?' * len(self.schema))})"
        for batch in iterator:
            con.execute("BEGIN")
            con.executemany(add, zip(*(map(_into, c.to_pylist()) for c in batch.columns), strict=True))
            con.execute("COMMIT")
            pages, size = (con.execute(f"PRAGMA {p}").fetchone()[0] for p in ("page_count", "page_size"))
            if pages * size > FILE_BYTES:
                files.append(self._store(con))
                con.close()
                con = self._new()
        files.append(self._store(con))
        con.close()
        return Written([f for f in files if f])

    def commit(self, messages) -> None:
        _commit(self.path, self.table, replace(self.next, files=[*self.next.files, *(f for m in messages if m for f in m.files)]))

    def abort(self, messages) -> None:
        for m in messages:
            for f in m.files if m else ():
                (local(self.path) / self.table / f["name"]).unlink(missing_ok=True)


class Relational(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        held = latest(self.options["path"], self.options["table"])
        if held is None:
            raise ValueError(f"no table {self.options['table']!r} in {self.options['path']}")
        return held.columns

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(Relational)


def write_table(rows: DataFrame, path: str, table: str, key: str, ranges: int | None = None) -> None:
    """Store ``rows`` by ranges of ``key``, as many as Spark finds fit or ``ranges``, in place of what the table holds."""
    register(rows.sparkSession)
    k = F.col(_tick(key))
    placed = (rows.repartitionByRange(ranges, k) if ranges else rows.repartitionByRange(k)).sortWithinPartitions(k)
    placed.write.format(FORMAT).mode("overwrite").option("table", table).option("key", key).save(path)


def read_table(spark: SparkSession, path: str, table: str, where: Sequence[tuple] = (), files: Sequence[str] | None = None) -> DataFrame:
    """The rows of a table that meet all conditions (column, one of OPERATORS, value; a list of values for ``in``), or those of some of its files."""
    register(spark)
    held = spark.read.format(FORMAT).option("table", table).option("where", json.dumps([(c, o, *(v or (None,))) for c, o, *v in where]))
    return (held if files is None else held.option("files", json.dumps(list(files)))).load(path)


def _tick(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def add_columns(path: str, table: str, added: str, defaults: dict | None = None) -> list[str]:
    """Additive migration: append the columns of the DDL ``added`` that the table lacks, null or with a default for rows
    that are there; the names that were new. A column that exists with another type is refused."""
    held = latest(path, table)
    schema, fresh = held.columns, []
    for f in StructType.fromDDL(added):
        if f.name not in schema.names:
            schema = schema.add(f)
            fresh.append(f.name)
        elif schema[f.name].dataType != f.dataType:
            raise ValueError(f"{table}.{f.name} is {schema[f.name].dataType.simpleString()}")
    if fresh:
        new = {n: _into((defaults or {}).get(n)) for n in fresh}
        _commit(path, table, replace(held, number=held.number + 1, schema=schema.json(), defaults={**held.defaults, **new}))
    return fresh


def set_aside(path: str, table: str, needs: Sequence[str]) -> str | None:
    """Rename a table of an older layout, one without all of ``needs``, so that it can still be read; its new name."""
    held = latest(path, table)
    if held is None or set(needs) <= set(held.columns.names):
        return None
    name = f"{table}-before-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid4().hex[:6]}"
    (local(path) / table).rename(local(path) / name)
    return name


def upsert(rows: DataFrame, path: str, table: str) -> dict[str, int]:
    """Insert rows with new keys, replace those whose columns differ, leave the others: counts by action.

    Only files whose key range holds a changed key are rewritten, and a repeated call writes nothing. Columns that ``rows`` lacks
    keep their stored value, or get the default. Null or repeated keys are refused.
    """
    spark, held = rows.sparkSession, latest(path, table)
    key, names = held.key, held.columns.names
    if strange := set(rows.columns) - set(names):
        raise ValueError(f"{table} has no {sorted(strange)}")
    k = F.col(_tick(key))
    if rows.groupBy(k).agg(F.count("*").alias("n")).where((F.col("n") > 1) | k.isNull()).limit(1).count():
        raise ValueError(f"null or repeated {key}")
    given = [c for c in names if c in rows.columns]
    new = rows.select(*(F.col(_tick(c)).cast(held.columns[c].dataType).alias(c) for c in given))
    stored = read_table(spark, path, table)
    pack = lambda df: F.struct(*(df[_tick(c)] for c in given))
    left, right = new.select(k.alias("k"), pack(new).alias("new")), stored.select(k.alias("k"), pack(stored).alias("old"), F.struct(*(stored[_tick(c)] for c in names)).alias("row"))
    met = left.join(right, "k", "left")
    action = F.when(F.col("row").isNull(), "insert").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    default = held.defaults
    fresh = lambda c: F.col("new")[c] if c in given else F.when(F.col("row").isNull(), F.lit(default.get(c)).cast(held.columns[c].dataType)).otherwise(F.col("row")[c])
    changed = cut(met.select("k", action.alias("action"), F.struct(*(fresh(c).alias(c) for c in names)).alias("row")))
    counts = {r["action"]: r["count"] for r in changed.groupBy("action").count().collect()}
    changed = changed.where("action <> 'keep'")
    if not counts.keys() - {"keep"}:
        return counts
    spans = spark.createDataFrame([(f["name"], f["low"], f["high"]) for f in held.files if f["low"] is not None] or [("", None, None)], StructType.fromDDL("name string").add("low", held.columns[key].dataType).add("high", held.columns[key].dataType))
    touched = {r[0] for r in changed.join(spans, changed["k"].between(spans["low"], spans["high"])).select("name").distinct().collect()}
    merged = changed.select("row.*")
    if touched:
        old = read_table(spark, path, table, files=sorted(touched)).select(k.alias("k"), F.struct("*").alias("row"))
        null = F.col("k").isNull()  # stored rows without a key stay
        merged = merged.unionByName(old.where(null).select("row.*")).unionByName(old.where(~null).join(changed.select("k"), "k", "left_anti").select("row.*"))
    keep = json.dumps([f["name"] for f in held.files if f["name"] not in touched])
    placed = merged.repartitionByRange(k).sortWithinPartitions(_tick(key))
    placed.write.format(FORMAT).mode("append").option("table", table).option("keep", keep).save(path)
    return counts
