"""Structured Streaming forms of the domain's operators; each equals its batch twin over the same files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from marlpit.operators.dataset import interaction_facts
from marlpit.sources.adapter import EVENT_TYPES
from marlpit.sources.durable import folder
from marlpit.sources.snapshots import SnapshotTable

RAW = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, directory: str, name: str = "events.parquet", watermark: str = "1 day", files: int = 1000) -> DataFrame:
    """Events as they arrive, of at most ``files`` files a batch. Event time must be a timestamp with a zone for watermarks, so wall-clock UTC is cast."""
    raw = spark.readStream.schema(RAW).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(directory)
    kind = F.create_map(*(F.lit(x) for pair in EVENT_TYPES.items() for x in pair))[F.col("event_type")]
    held = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.get_json_object("props", "$.k").cast("int").alias("item_id"), kind.alias("event_type"), "value")
    return held.withWatermark("ts", watermark)


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Event counts by type in tumbling, or with ``slide`` sliding, windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def gap_sessions(events: DataFrame, gap: str = "24 hours") -> DataFrame:
    held = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return held.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def facts(events: DataFrame) -> DataFrame:
    return interaction_facts(events)


def deduplicated(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


STAGES = ("none", "view", "favorite", "add_to_cart", "purchase")


#: A pair in the state of its bucket: which ids are null (1 user, 2 item), ids, deepest stage, and the watermark that ends it.
_PAIR = np.dtype([("nulls", "i1"), ("user", "<i8"), ("item", "<i4"), ("depth", "i1"), ("ends", "<i8")])


class _Deepest(StatefulProcessor):
    """Deepest stages of a bucket's pairs as one value, with one timer that clears those idle by then."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getValueState("pairs", "pairs binary")

    def _held(self) -> np.ndarray:
        held = self.pairs.get() if self.pairs.exists() else None
        return np.zeros(0, _PAIR) if held is None else np.frombuffer(held[0], _PAIR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, ends = self._held(), timerValues.getCurrentWatermarkInMs() + self.idle_ms
        if not len(held):
            self.handle.registerTimer(ends)  # later ones end no earlier, and the timer moves on as it fires
        every = [held]
        for part in rows:
            new = np.zeros(len(part), _PAIR)
            for name in ("nulls", "user", "item", "depth"):
                new[name] = part[name].to_numpy()
            new["ends"] = ends
            every.append(new)
        whole = np.concatenate(every)
        order = np.lexsort((whole["item"], whole["user"], whole["nulls"]))
        ids = whole[["nulls", "user", "item"]][order]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        out = whole[order[starts]]
        out["depth"] = np.maximum.reduceat(whole["depth"][order], starts)
        out["ends"] = np.maximum.reduceat(whole["ends"][order], starts)
        self.pairs.update((out.tobytes(),))
        out = out[np.maximum.reduceat(order >= len(held), starts)]
        ids = {n: pd.arrays.IntegerArray(out[c].copy(), (out["nulls"] & bit) > 0) for n, c, bit in (("user_id", "user", 1), ("item_id", "item", 2))}
        yield pd.DataFrame(ids | {"depth": out["depth"].astype("int32"), "stage": np.array(STAGES, object)[out["depth"]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        left = held[held["ends"] > timerValues.getCurrentWatermarkInMs()]
        if len(left):
            self.pairs.update((left.tobytes(),))
            self.handle.registerTimer(int(left["ends"].min()))
        else:
            self.pairs.clear()
        return iter(())

    def close(self) -> None:
        pass


def funnel_state(events: DataFrame, idle_days: int = 7, buckets: int = 4096) -> DataFrame:
    """(user_id, item_id, depth, stage): the deepest stage of each pair that a batch touches, so far as its state remembers.

    Pairs are dealt by hash into ``buckets``, which stay the same over a stream's life: each has one value and one timer, as calls to the state
    store take most of the time and a bucket's pairs are merged as arrays; no user's or item's events come together. A pair
    idle for ``idle_days`` beyond the watermark leaves the state, which bounds it; if it comes back it starts
    anew, so a sink keeps each pair's largest ``depth`` (``drain`` with ``largest``) and equals the batch form
    whatever the gaps. Pairs with a null user or item are pairs like others. Needs ``STATE_STORE``.
    """
    depth = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), F.col("event_type")).cast("int") - 1, F.lit(0))
    nulls = F.col("user_id").isNull().cast("int") + 2 * F.col("item_id").isNull().cast("int")
    # ids without nulls, as those would make numbers of other kinds in Python
    told = events.select(
        F.pmod(F.xxhash64("user_id", "item_id"), F.lit(buckets)).alias("bucket"), nulls.alias("nulls"), F.coalesce("user_id", F.lit(0)).alias("user"), F.coalesce("item_id", F.lit(0)).alias("item"), F.greatest(depth, F.lit(0)).alias("depth"), "ts"
    )
    return told.groupBy("bucket").transformWithStateInPandas(_Deepest(idle_days * 86_400_000 + 1), "user_id long, item_id int, depth int, stage string", "Update", "EventTime")


#: The store that states with timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drain(stream: DataFrame, mode: str, key: list[str] | None = None, largest: str | None = None) -> DataFrame:
    """Process what is there and return the sink's table. Update mode keeps the last row of each ``key``, or with
    ``largest`` that with the largest value of this column. A stream without files gives an empty table.

    A batch overwrites the folder of its own number, so one that is retried is not there twice."""
    spark, path = stream.sparkSession, f"{folder(stream.sparkSession)}/stream-{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if not stored(spark, f"{path}/rows"):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{path}/rows")
    if mode == "update":
        others = [c for c in rows.columns if c not in (*(key or []), "batch")]
        order = F.struct(*([largest] if largest else []), "batch")
        last = rows.groupBy(*(key or [])).agg(F.max_by(F.struct(*others), order).alias("x"))
        return last.select(*(key or []), "x.*")
    return rows.drop("batch")


def drain_into(stream: DataFrame, table: SnapshotTable, checkpoint: str, mode: str = "update") -> None:
    """Upsert each batch of an update-mode stream into a snapshot table. A batch is known by its number, so one that is
    repeated after a failure changes nothing, and readers see whole batches only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # an upsert reads it more than once, and its state must be computed once
        try:
            if not table.upsert(batch, f"{checkpoint}#{number}"):
                batch.write.format("noop").mode("overwrite").save()  # a repeated batch is still due to the state store
        finally:
            batch.unpersist()

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def stored(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class _Drops(StreamingQueryListener):
    """Adds up what state operators drop, over all progress reports of a query."""

    def __init__(self) -> None:
        self.total: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.total[str(p.id)] = self.total.get(str(p.id), 0) + sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))


def late_rows(stream: DataFrame, mode: str = "append", wait_seconds: float = 60) -> int:
    """Rows that a stream's state operators dropped because they came after the watermark, of all batches, however many."""
    spark, path, heard = stream.sparkSession, f"{folder(stream.sparkSession)}/stream-{uuid4().hex}", _Drops()
    spark.streams.addListener(heard)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("noop").start()
        query.awaitTermination()
        end = time.monotonic() + wait_seconds  # reports come a little after the query's end
        while str(query.id) not in heard.ended:
            if time.monotonic() > end:
                raise TimeoutError("the stream's last reports did not come")
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(heard)
    return heard.total.get(str(query.id), 0)


def split_late(events: DataFrame, delay: str = "1 day", at: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a stream: late ones came in a batch after the largest time of earlier batches less ``delay``.

    Nothing is dropped: each batch is cut in two before any stateful step, rows without a time are on time, and the two tables add
    up to the input. Each batch stores its largest time under its number and reads that of the ones before, so a
    batch that is repeated after a restart is cut the same.
    """
    spark, path = events.sparkSession, f"{folder(events.sparkSession)}/stream-{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            limit = None
            if stored(spark, f"{path}/marks"):
                limit = spark.read.schema("top timestamp, batch long").parquet(f"{path}/marks").where(F.col("batch") < number).agg((F.max("top") - F.expr(f"INTERVAL {delay}")).alias("t")).first().t
            late = F.lit(False) if limit is None else F.coalesce(F.col(at) < F.lit(limit), F.lit(False))
            for name, rows in (("on_time", batch.where(~late)), ("late", batch.where(late)), ("marks", batch.agg(F.max(at).cast("timestamp").alias("top")))):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    query = events.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if not stored(spark, f"{path}/marks"):
        return (spark.createDataFrame([], events.schema),) * 2
    return tuple(spark.read.schema(events.schema).parquet(f"{path}/{name}") for name in ("on_time", "late"))


def with_settings(spark: SparkSession, settings: dict[str, str], fn: Callable[[], DataFrame]) -> DataFrame:
    """Run ``fn`` with settings of the session that are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_session_zone(spark: SparkSession, fn: Callable[[], DataFrame]) -> DataFrame:
    """Run ``fn`` with the session's time zone set to UTC, which wall-clock event times are in."""
    return with_settings(spark, {"spark.sql.session.timeZone": "UTC"}, fn)


def materialized(df: DataFrame) -> DataFrame:
    """Rows as they are now, so that a later change of the session's zone doesn't show."""
    from marlpit.sources.durable import cut

    return cut(df)
