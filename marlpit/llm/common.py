"""What the operators share: table access, durable cuts of lineage, tokenizer files, slices of text."""

from __future__ import annotations

import gc
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from typing import TypeVar
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same for Spark's regular expressions.
WORD_JVM = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`").alias(c) for c in df.columns))


T = TypeVar("T")
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for all its machines; only a local session without one (tests) gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or _OWN.setdefault("folder", tempfile.mkdtemp(prefix="marlpit-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again: a cut for wide intermediate results."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def modest_batches(spark: SparkSession) -> None:
    """Texts are long rows: unless the session says otherwise, a Python worker gets 1,000 of them at a time, not 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


_HELD: dict[tuple, object] = {}
#: What else a worker remembers, as functions that forget it.
_FORGET: list[Callable[[], None]] = []


def forgotten_with_state(forget: Callable[[], None]) -> None:
    """Have ``forget`` called when a worker goes on to another operator."""
    _FORGET.append(forget)


def worker_state(make: Callable[..., T], *key) -> T:
    """What ``make(*key)`` returns, kept for later tasks of this Python worker. Workers outlive stages and
    each operator's memory would add up, so only the last operator's is kept."""
    name = (make.__module__, make.__qualname__, *key)
    if name not in _HELD:
        _HELD.clear()
        for forget in _FORGET:
            forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make(*key)
    return _HELD[name]


def nothing(operator: str) -> None:
    """The state of an operator without any: taking it lets go of the one before."""


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; ``name`` may also be a path itself."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that byte-level BPE uses for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def arrow_slices(batches: Iterator[pa.RecordBatch], column: str, max_rows: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has at most ``max_rows`` rows and, unless a single text is longer, ``max_bytes`` of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first = total = 0
        for i, size in enumerate(sizes):
            if i > first and (i - first >= max_rows or total + size > max_bytes):
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        yield batch.slice(first)
