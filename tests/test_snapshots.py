"""Upserts into snapshots: touched buckets only, repeats, failures before the commit, guards, deletes."""

import pytest

from marlpit.sources.snapshots import SnapshotTable, population_guard

SCHEMA = "id long, name string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(table):
    return sorted(((r.id, r.name) for r in table.read().collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    held = SnapshotTable(spark, str(tmp_path / "t"), ["id"], buckets=8)
    assert held.read() is None
    assert held.upsert(rows(spark, *((i, f"a{i}") for i in range(40)), (None, "none")), "first")
    return held


def test_only_touched_buckets_are_rewritten(spark, table):
    before = table.latest()
    assert table.upsert(rows(spark, (3, "b"), (100, "new")), "second")
    after = table.latest()
    changed = [b for b in after.buckets if after.buckets[b] != before.buckets.get(b)]
    assert 1 <= len(changed) <= 2
    assert content(table) == sorted([*((i, "b" if i == 3 else f"a{i}") for i in range(40)), (100, "new"), (None, "none")], key=str)
    assert len(table.read(before).collect()) == 41  # the old snapshot is still readable


def test_a_repeated_batch_changes_nothing(spark, table):
    number = table.latest().number
    assert not table.upsert(rows(spark, (3, "other")), "first")
    assert table.latest().number == number and (3, "a3") in content(table)


def test_a_crash_before_the_commit_leaves_the_old_snapshot(spark, table, monkeypatch):
    before = content(table)
    monkeypatch.setattr(table, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.upsert(rows(spark, (3, "b")), "second")
    assert content(table) == before
    monkeypatch.undo()
    assert table.upsert(rows(spark, (3, "b")), "second") and (3, "b") in content(table)


def test_of_two_writers_one_commits(spark, table):
    stale = table.latest()
    assert table.upsert(rows(spark, (1, "x")), "second")
    with pytest.raises(Exception, match="exist"):
        table._commit(stale.number + 1, {"buckets": {}, "batches": [], "key": ["id"], "n_buckets": 8, "schema": stale.schema})
    assert (1, "x") in content(table)


def test_guards_deletes_null_keys_and_repeats(spark, table):
    guard = population_guard(["id"], rows(spark, (1, ""), (2, "")))
    with pytest.raises(ValueError, match="77"):
        table.upsert(rows(spark, (1, "g"), (77, "g")), "guarded", guard)
    assert table.upsert(rows(spark, (1, "g"), (1, "h"), (None, "still")), "twice", deleted=rows(spark, (2, ""), (500, "")))
    got = content(table)
    assert (1, "h") in got and (None, "still") in got and not any(i == 2 for i, _ in got) and len(got) == 40
    with pytest.raises(ValueError, match="columns"):
        table.upsert(spark.createDataFrame([(1, 2)], "id long, other int"), "third")


def test_an_empty_batch_and_cleaning(spark, table):
    assert table.upsert(rows(spark), "empty") and len(content(table)) == 41
    for n in range(3):
        table.upsert(rows(spark, (0, f"v{n}")), f"v{n}")
    assert table.clean(keep=1) >= 3 and (0, "v2") in content(table) and len(content(table)) == 41
    with pytest.raises(ValueError, match="buckets"):
        SnapshotTable(spark, table.path, ["id"], buckets=4).latest()
