"""Clashing names, crowded buckets, long texts and repeated ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.llm import graph, lines, simhash
from tests.llm.test_near_duplicates import union

#: Names that operators use inside, or did.
CLASHING = ["id", "mark", "row", "k", "k1", "k2", "bands", "band", "n", "n_lines", "dropped", "text_2", "of", "of_mark", "fp", "__id", "__mark", "__gone", "__own", "component", "place", "line", "bucket", "position", "a.b"]


def with_clashing(df):
    return df.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING))


@pytest.mark.parametrize("stage", [lines.without_repeats, simhash.keep_first])
def test_clashing_names_stay_as_they_are(spark, stage):
    long = "this line is long enough to take part in it and has some more words"
    rows = [(1, f"{long}\nfirst"), (2, f"{long}\nother words of the second"), (3, f"{long}\nfirst"), (4, None), (None, f"{long}\nfirst"), (5, "")]
    df = with_clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    out = stage(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for r in got for c in CLASHING)
    plain = stage(df.select("doc_id", "text")).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(r["doc_id"]), r["text"] or "") for r in plain)


def templates(rng, n, own=28, variants=3):
    """Lines of one template whose own words differ too much to be similar, some of them with near copies."""
    head = "this item was posted in the large catalog of used things for sale by the owner, "
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(own))
    out = []
    while len(out) < n:
        line = head + word()
        out.append(line)
        for _ in range(rng.randrange(variants)):
            at = rng.randrange(len(head), len(line) - 1)
            out.append(line[:at] + "z" + line[at + 1 :])
    return sorted(set(out))


@pytest.mark.parametrize("outside", [16, 0])
def test_bucket_of_unlike_lines(spark, monkeypatch, outside):
    """Parting a crowded bucket by rare shingles loses no link of a pair that shares a band."""
    monkeypatch.setattr(lines, "BLOCK", 16)
    monkeypatch.setattr(lines, "OUTSIDE", outside)
    texts = templates(random.Random(3), 240)
    values = lines.bands(texts)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (values[i] == values[j]).any() and lines.jaccard(texts[i], texts[j]) >= 0.8]
    held = np.unique(values.ravel(), return_counts=True)[1]
    assert held.max() > 100 and near
    root = union(near, range(len(texts)))
    got = {r["doc_id"] for r in lines.dropped_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r["dropped"]}
    assert got == {i for i, top in root.items() if top != i}


def test_rare_shingles_part_a_bucket(spark):
    """Of 3,000 unlike lines in one bucket hardly any two meet again: the work is no square."""
    texts = templates(random.Random(5), 3000, variants=1)
    named = spark.createDataFrame([(7, i, i, 100) for i in range(len(texts))], "band long, k long, c long, size long")
    held = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "k long, line string, size int")
    fine = lines._by_rare_shingles(named, held, 0.8, lines.OF_LINES)
    sizes = [r["count"] for r in fine.groupBy("band").count().collect()]
    assert sum(n * n for n in sizes) < 0.05 * len(texts) ** 2


def test_shared_bands_across_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.randrange(5), rng.randrange(2)) for _ in range(600)] + [(1000, i, 0) for i in range(2000)] + [(2000 + i, 1, 1) for i in range(500)]
    df = spark.createDataFrame(rows + rows[:100], "band long, k1 long, k2 long").repartition(7)
    keys = {}
    for band, a, b in rows:
        keys.setdefault(band, set()).add((a, b))
    got = {}
    for r in lines._shared_bands(df).collect():
        key = r["k1"], r["k2"]
        assert key not in got.setdefault(r["band"], set())
        got[r["band"]].add(key)
    assert all(got.get(band) == held for band, held in keys.items() if len(held) > 1)
    assert sum(len(keys[band]) == 1 for band in got) <= 2 * 4


def test_lines_that_share_half_a_key(spark, monkeypatch):
    """Lines are known by 128 bits: equal first halves don't lose a link."""
    real = lines._keys
    monkeypatch.setattr(lines, "_keys", lambda held: [b"\0" * 8 + k[8:] for k in real(held)])
    base = "a line that has a near copy further down in another document of the set"
    rows = [(1, base), (2, base.replace("near", "nexr")), (3, "quite another line that is like nothing else in all of these documents"), (4, base)]
    got = {r["doc_id"]: r["dropped"] for r in lines.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [0]}


def test_long_lines(spark):
    """Lines of a million characters are compared whole, and by themselves."""
    rng = random.Random(1)
    body = " ".join(str(rng.randrange(10**6)) for _ in range(150_000))
    rows = [(1, body), (2, body[:-400] + "x" * 400), (3, body[::-1]), (4, "short line of the set"), (5, None)]
    assert len(body) > 900_000
    got = {r["doc_id"]: r["dropped"] for r in lines.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [], 5: []}
    a, b = body[:70_000], body[100:70_100]
    x, y = lines.shingles(a), lines.shingles(b)
    assert lines.jaccard(a, b) == pytest.approx(len(x & y) / len(x | y))


def test_similar_is_exact():
    rng = random.Random(11)
    held = ["".join(rng.choice("ab") for _ in range(rng.randrange(7, 40))) for _ in range(60)]
    held += [x[:-1] + "c" for x in held] + [x * 3 for x in held[:20]]
    for a in held:
        for b in held:
            x, y = lines.shingles(a), lines.shingles(b)
            assert lines.similar(a, b, 0.8) == (len(x & y) / len(x | y) >= 0.8)


def test_crowded_keys_are_split(spark):
    """Keys of unrelated fingerprints that share 26 bits are split by a longer chain; no link is lost."""
    rng = random.Random(9)
    low = (1 << 26) - 1
    fps = [rng.getrandbits(64) & ~low | 0x2A for _ in range(150)]
    fps += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in fps[:60]]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    want = union([(a, b) for i, a in enumerate(fps) for b in fps[:i] if near(a, b)], fps)
    for crowd in (128, 20, 2):
        edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowd=crowd)
        assert all(near(r["a"], r["b"]) for r in edges.collect())
        got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
        assert {x: got.get(x, x) for x in fps} == want


def test_an_id_with_both_labels_counts_as_bad_in_any_order(spark):
    from marlpit.llm import quality

    stats = spark.createDataFrame([(i, [float(i)], False) for i in range(40)], "doc_id long, features array<double>, base_failed boolean")
    pairs = [(i, q) for i in range(40) for q in (0, 1)] + [(None, 1), (3, None)]
    for rows in (pairs, pairs[::-1]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int").repartition(3)
        got = quality.labelled_stats(stats, labels).select("doc_id", "quality").collect()
        assert len(got) == 40 and {r.quality for r in got} == {0}


def test_long_chains_of_pages_are_walked_once():
    import time

    from marlpit.llm import media

    page = b"OggS\0\0" + b"\0" * 20 + b"\1\1x"
    end = b"OggS\0\4" + b"\0" * 20 + b"\1\1x"
    began = time.process_time()
    blob = media.Blob(page * 20_000)
    assert {media._ogg(blob, i * len(page)) for i in range(20_000)} == {None}
    assert time.process_time() - began < 2
    blob = media.Blob(b"ab" + page * 3 + end + b"tail")
    assert [media._ogg(blob, 2 + i * len(page)) for i in range(4)] == [2 + 4 * len(page)] * 4 and media._ogg(media.Blob(page + end[:-1]), 0) is None
