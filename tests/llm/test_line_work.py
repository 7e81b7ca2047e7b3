"""Lines are compared many at once, without sets of strings, and bands travel many in a row."""

import random
import tracemalloc

import numpy as np
import pytest

from marlpit.llm import lines


def changed(rng: random.Random, line: str, letters: str) -> str:
    """``line`` with some of it replaced; how much is drawn."""
    out = list(line)
    for _ in range(rng.randrange(len(out) // 25 + 2)):
        i = rng.randrange(len(out))
        out[i : i + rng.randrange(4)] = rng.choice(letters)
    return "".join(out).ljust(lines.SHINGLE, "z")


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghij klmnop", "".join(map(chr, range(97, 97 + 200))), "".join(map(chr, range(0x4E00, 0x5C00))), "ab\U0001f600\ud800\x00"])
def test_pairs_compared_at_once(letters):
    rng = random.Random(7)
    a = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 400))) for _ in range(400)]
    b = [changed(rng, x, letters) if i % 5 else a[i - 1] for i, x in enumerate(a)]
    got = lines.similar_pairs(a, b, 0.8)
    assert got.tolist() == [lines.jaccard(x, y) >= 0.8 for x, y in zip(a, b, strict=True)]
    assert lines.similar_pairs([], [], 0.8).tolist() == []


def test_pairs_with_long_texts(monkeypatch):
    monkeypatch.setattr(lines, "LONG", 100)
    a, b = ["x" * 20, "abcdefgh " * 20, "abcdefgh"], ["x" * 9, "abcdefgh " * 15, "abcdefgi"]
    assert lines.similar_pairs(a, b, 0.8).tolist() == [True, True, False]


def test_blocks_hold_no_sets_of_strings():
    """Variants of 400 lines are linked; what a worker then holds is a small part of their shingles as strings."""
    rng = random.Random(3)
    sources = ["".join(rng.choice("abcdefghij klmnop") for _ in range(1500)) for _ in range(400)]
    left, right = [x[:700] + "!" + x[700:] for x in sources], [x[:300] + x[320:] for x in sources]
    tracemalloc.start()
    try:
        found = lines.block_links(left, right, list(range(400)), list(range(400, 800)), 0.8)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert sorted(found) == [(i, 400 + i) for i in range(400)]
    assert held < 20e6


def test_bands_travel_many_in_a_row(spark):
    """Lines with 9 bands each, some shared: fewer rows than lines are dealt, and a crowded band in parts."""
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 62), 1 << 62, (5000, 9))
    values[:3000, 0] = 77
    values[10:12, 1] = 78
    values[20:22, 2] = values[4000:4002, 2] = 79
    rows = [(v.tolist(), i, -i) for i, v in enumerate(values)]
    lists = spark.createDataFrame(rows + rows[5:400], "bands array<long>, k1 long, k2 long").repartition(3)
    coded = spark.createDataFrame([(bytearray(np.array(v).tobytes()), a, b) for v, a, b in rows], "bands binary, k1 long, k2 long").repartition(3)
    want = {77: set(range(3000)), 78: {10, 11}, 79: {20, 21, 4000, 4001}}
    for df in (lists, coded):
        out = lines._shared_bands(df).collect()
        assert len(out) == 3006
        assert {b: {r["k1"] for r in out if r["band"] == b and r["k2"] == -r["k1"]} for b in want} == want
        assert all(r["n"] == len(want[r["band"]]) for r in out)


def test_rows_dealt():
    """Few rows carry all bands, whatever their number; of a crowded band many parts get some."""
    rows = np.stack([np.arange(100_000), np.arange(100_000), np.zeros(100_000, np.int64)], axis=1)
    rows[:5000, 0] = 7
    batches = list(lines._dealt(rows, 16))
    assert sum(b.num_rows for b in batches) <= 33
    hot = next(b for b in batches if b.column("kind")[0].as_py() == 1)
    sizes = [len(x) // 24 for x in hot.column("rows").to_pylist()]
    assert sum(sizes) == 5000 and len(sizes) == 16 and max(sizes) < 600
