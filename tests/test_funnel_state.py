"""The funnel's state: a value a bucket of pairs, odd ids, idle pairs."""

import numpy as np
import pandas as pd

from marlpit.streaming import incremental as T
from tests.test_streams_and_bases import files


class Handle:
    """What a processor sees of its state."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class At:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def rows(*pairs):
    return iter([pd.DataFrame(pairs, columns=["nulls", "user", "item", "depth"])])


def test_a_bucket_of_pairs_takes_a_few_calls_and_idle_pairs_leave_it():
    held, handle = T._Deepest(100), Handle()
    held.init(handle)
    (out,) = held.handleInputRows((0,), rows(*((0, u, i, (u + i) % 5) for u in range(50) for i in range(20)), (0, 3, 3, 4)), At(10))
    assert handle.calls <= 5 and len(out) == 1000  # 1,000 pairs
    assert out.set_index(["user_id", "item_id"]).loc[(3, 3), "stage"] == "purchase"
    (out,) = held.handleInputRows((0,), rows((0, 3, 3, 1), (1, 0, 3, 2), (0, 0, 3, 1)), At(60))
    assert [tuple(r) for r in out.astype(object).where(out.notna(), None).itertuples(index=False)] == [(0, 3, 3, "add_to_cart"), (3, 3, 4, "purchase"), (None, 3, 2, "favorite")]
    assert handle.timers == [110]
    assert list(held.handleExpiredTimer((0,), At(115), None)) == []
    left = np.frombuffer(handle.value[0], T._PAIR)
    assert left[["user", "item"]].tolist() == [(0, 3), (3, 3), (0, 3)] and handle.timers == [110, 160]
    list(held.handleExpiredTimer((0,), At(160), None))
    assert handle.value is None


def test_odd_ids_over_batches(spark, tmp_path):
    big = 2**62 + 1  # not a float
    batches = [[(1, 0, None, "view", 5), (2, 0, big, "click", 5), (3, 0, 7, "view", "null"), (4, 0, 0, "error", 5)], [(5, 1, None, "purchase", 5), (6, 1, big, "view", 5), (7, 1, 7, "other", 5), (8, 1, 7, None, "null")]]
    where = files(spark, str(tmp_path), batches)
    run = lambda: T.drain(T.funnel_state(T.read_events(spark, where, "*.parquet", files=1), buckets=2), "update", ["user_id", "item_id"], largest="depth")
    got = T.with_settings(spark, T.STATE_STORE | {"spark.sql.session.timeZone": "UTC"}, lambda: {(r.user_id, r.item_id): r.stage for r in run().collect()})
    assert got == {(None, 5): "purchase", (big, 5): "favorite", (7, None): "view", (0, 5): "none", (7, 5): "none"}
