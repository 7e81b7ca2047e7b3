"""Components, SimHash and line dedup against all pairs; the pipeline against its stages' plain versions."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from marlpit.llm import graph, lines, simhash

SF = "/root/testdata/sf0.001"


def union(edges, nodes=()):
    parent = {n: n for n in nodes}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("share", [None, 100])
@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind, share):
    rng = random.Random(1)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "path": [(i, i + 1) for i in range(100)], "star": [(0, i) for i in range(1, 50)] + [(70, 71)], "empty": []}[kind]
    df = spark.createDataFrame([*edges, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df, rows_per_task=share).collect()}
    assert got == {k: v for k, v in union([e for e in edges if e[0] != e[1]]).items()}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, " \n"), (7, "again id seven"), (None, "no id"), (1003, "É A b C"), (1003, "É A b C")], "doc_id long, text string")
    rows = docs.unionByName(extra)
    held = rows.collect()
    want = defaultdict(list)
    for r in held:
        want[plain_fingerprint(r["text"])].append(r["doc_id"])
    fps = list(want)
    group = union([(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 2], fps)
    least = {}
    for f, ids in want.items():
        known = [i for i in ids if i is not None]
        if known:
            least[group[f]] = min([least.get(group[f], 1 << 60), *known])
    got = simhash.components_of(rows).collect()
    assert len(got) == len(held)
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component"]) for r in got) == sorted((str(i), f, least.get(group[f])) for f, ids in want.items() for i in ids)


@pytest.mark.parametrize("crowd", [128, 4])
def test_links_lose_none(spark, crowd):
    """Pairs of small buckets and half-way points of large ones connect what all pairs connect."""
    rng = random.Random(crowd)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(250):
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.6) * (1 << rng.randrange(64)))
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    want = union([(a, b) for i, a in enumerate(fps) for b in fps[:i] if near(a, b)], fps)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowd=crowd)
    assert all(near(r["a"], r["b"]) for r in edges.collect())
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert {x: got.get(x, x) for x in fps} == want


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, 1), (1, text, 2), (2, text.upper(), 3), (9, "other words are here now", 4), (1, text, 2), (None, "", 5), (None, " ", 6), (11, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["component"]) for r in kept.collect()) == [(1, 2), (9, 4), (11, 7)]
    assert simhash.keep_first(df.limit(0)).count() == 0


def plain_dropped(rows, threshold=0.8):
    """All pairs of lines that share a shingle."""
    places = defaultdict(list)
    for i, text in rows:
        for j, line in enumerate((text or "").split("\n")):
            if len(y := lines.normal(line)) >= lines.MIN_CHARS:
                places[y].append((i, j))
    different = list(places)
    sets = [lines.shingles(y) for y in different]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    edges = []
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j < i:
                    shared[j] += 1
        edges += [(i, j) for j, n in shared.items() if n / (len(s) + len(sets[j]) - n) >= threshold]
    groups = defaultdict(list)
    for i, root in union(edges, range(len(different))).items():
        groups[root] += places[different[i]]
    return {p for g in groups.values() for p in sorted(g)[1:]}, edges


def test_lines_of_documents_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want, edges = plain_dropped([tuple(r) for r in docs.collect()])
    got = {(r["doc_id"], j) for r in lines.dropped_lines(docs).collect() for j in r["dropped"]}
    assert edges and got == want


def family(rng, n):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    source = [word() for _ in range(40)]
    texts = []
    for _ in range(n):
        own = list(source)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(40)] = word()
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("block", [256, 37])
def test_variants_of_a_line(spark, monkeypatch, block):
    """A family without its source, with pairs on both sides of the threshold: all repeats by candidate pairs are found, in one block or many."""
    monkeypatch.setattr(lines, "BLOCK", block)
    texts = sorted(set(family(random.Random(4), 300)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    values = lines.bands(texts)
    near = lambda i, j: (values[i] == values[j]).any() and lines.jaccard(texts[i], texts[j]) >= 0.8
    root = union([(i, j) for i in range(len(texts)) for j in range(i) if near(i, j)], range(len(texts)))
    got = {r["doc_id"] for r in lines.dropped_lines(df).collect() if r["dropped"]}
    assert got == {i for i, top in root.items() if top != i}
    every, _ = plain_dropped(list(enumerate(texts)))
    assert {(i, 0) for i in got} <= every and len(got) >= 0.98 * len(every)


def test_links_of_blocks():
    texts = family(random.Random(6), 120)
    left, right = texts[:50], texts[50:]
    found = lines.block_links(left, right, list(range(50)), list(range(50, 120)), 0.8)
    every = [(i, 50 + j) for i, x in enumerate(left) for j, y in enumerate(right) if lines.jaccard(x, y) >= 0.8]
    assert set(found) <= set(every) and len(found) < len(every)
    assert union(found, range(120)) == union(every, range(120))


def test_similarity_of_bands():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip().ljust(n, "z")
    met = close = 0
    for _ in range(300):
        a = text(rng.randrange(30, 400))
        b = list(a)
        b[rng.randrange(len(b))] = "q"
        b = "".join(b)
        if lines.jaccard(a, b) >= 0.8:
            close += 1
            x, y = lines.bands([a, b])
            met += bool((x == y).any())
    assert close > 100 and met >= 0.98 * close
    far = lines.bands([text(100) for _ in range(100)])
    assert sum((far[i] == far[j]).any() for i in range(100) for j in range(i)) == 0


def test_bands_of_short_lines():
    """Lines with fewer shingles than a signature has bins borrow; pairs at the threshold still meet."""
    rng = random.Random(7)
    for low, high in ((12, 18), (18, 24), (24, 32)):
        met = close = 0
        while close < 300:
            a = "".join(rng.choice("abcdefghijkl ") for _ in range(rng.randrange(low, high)))
            a, b = a.strip(), (a + rng.choice("xyz")).strip()
            if a != b and len(a) >= lines.SHINGLE and lines.jaccard(a, b) >= 0.8:
                close += 1
                x, y = lines.bands([a, b])
                met += bool((x == y).any())
        assert met >= 0.95 * close, (low, met, close)


def test_line_dedup_of_odd_rows(spark):
    long = "this line is long enough to take part in it"
    rows = [
        (2, f"{long}\nshort\nshort", "a"), (1, f"{long.upper()}  \n\n{long}", "b"), (3, long, "c"), (None, f"{long}\nand another line that only this one has", "d"), (4, None, "e"), (5, "", "f"), (3, long, "c"), (6, "short\nshort", "g"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    out = lines.without_repeats(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or -1, r["text"], r["mark"]) for r in out.where("text is not null").collect())
    assert got == [(-1, "and another line that only this one has", "d"), (1, f"{long.upper()}  \n", "b"), (2, "short\nshort", "a"), (5, "", "f"), (6, "short\nshort", "g")]
    assert out.where("text is null").count() == 1
    assert lines.without_repeats(df.limit(0)).count() == 0
    assert lines.dropped_lines(df).count() == len(rows)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, out)
        docs = out
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(o.columns == columns for n, (_, o) in seen.items() if n != "sequence_packing")
    before, after = seen["quality_rules"]
    assert 0 < after.count() < before.count() and after.exceptAll(before).count() == 0
    before, after = seen["line_dedup"]
    gone, _ = plain_dropped([(r["doc_id"], r["text"]) for r in before.collect()])
    want = {}
    for r in before.collect():
        parts = r["text"].split("\n")
        rest = [x for j, x in enumerate(parts) if (r["doc_id"], j) not in gone]
        if rest:
            want[r["doc_id"]] = "\n".join(rest)
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    before, after = seen["simhash_near_dedup"]
    from tests.llm.test_similar_documents import shingles, similarity

    sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
    ids = sorted(sets)
    roots = union([(a, b) for i, a in enumerate(ids) for b in ids[:i] if similarity(sets[a], sets[b]) >= 0.8], ids)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(roots.values()))
    before, after = seen["source_mixing"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    counts = defaultdict(int)
    for r in after.collect():
        assert texts[r["doc_id"]] == r["text"]
        counts[r["doc_id"]] += 1
    assert max(counts.values()) <= 2
    before, after = seen["sequence_packing"]
    total = after.agg({"length": "sum"}).first()[0]
    firsts = after.where("start = 0")
    assert firsts.count() == before.count() and firsts.agg({"doc_tokens": "sum"}).first()[0] == total
    assert np.all([len(r["ids"]) == 4 * r["length"] for r in after.select("ids", "length").collect()])
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_block_links_of_many_blocks_at_once():
    rng = random.Random(12)
    left, right, left_groups, right_groups, left_blocks, right_blocks, want = [], [], [], [], [], [], {}
    source = "".join(rng.choice("abcdefgh ") for _ in range(60))  # all blocks have variants of it, but only lines of one block may meet
    for block in range(40):
        size = rng.randrange(0, 9)
        own = [lines.normal(source[:i] + "xyz"[: rng.randrange(4)] + source[i + rng.randrange(8) :]) for i in (rng.randrange(40) for _ in range(size))]
        groups = list(range(100 * block, 100 * block + size))
        edges = [(groups[i], groups[j]) for i in range(0, size, 2) for j in range(size) if i != j and lines.jaccard(own[i], own[j]) >= 0.8]
        want |= union(edges, groups)
        left += own[::2]
        left_groups += groups[::2]
        left_blocks += [block] * len(own[::2])
        right += own
        right_groups += groups
        right_blocks += [block] * size
    found = lines.block_links(left, right, left_groups, right_groups, 0.8, left_blocks=left_blocks, right_blocks=right_blocks)
    assert union(found, right_groups) == want and all(a // 100 == b // 100 for a, b in found)


def test_similar_lines_with_common_ends():
    rng = random.Random(13)
    for _ in range(3000):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(7, 90))) * rng.choice([1, 1, 3])
        i, j = sorted(rng.randrange(len(a) + 1) for _ in range(2))
        b = a[:i] + "".join(rng.choice("ab c") for _ in range(rng.randrange(6))) + (a[j:] if rng.random() < 0.3 else a[i:])
        if len(b) >= 7:
            assert lines.similar(a, b, 0.8) == (lines.jaccard(a, b) >= 0.8)
    assert lines._common_start("", "a") == 0 and lines._common_start("abc", "abc") == 3 and lines._common_start("abd", "abcd") == 2
