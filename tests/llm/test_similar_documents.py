"""The near-duplicate stage against all pairs at 5-word Jaccard 0.8."""

import random
import re

from pyspark.sql import functions as F

from marlpit.llm import simhash
from tests.llm.test_near_duplicates import plain_fingerprint, union


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def variants(rng, sources, copies, sizes):
    texts = []
    for _ in range(sources):
        source = [f"w{rng.randrange(5000)}" for _ in range(rng.choice(sizes))]
        for _ in range(copies):
            own = list(source)
            for _ in range(rng.randrange(0, 2 + len(own) // 35)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def test_stage_equals_all_pairs(spark):
    rng = random.Random(8)
    texts = [*variants(rng, 40, 6, [3, 12, 40, 150, 600]), *variants(rng, 1, 400, [90])]
    sets = [shingles(t) for t in texts]
    edges = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if similarity(a, b) >= 0.8]
    fps = [plain_fingerprint(t) for t in texts]
    assert sum(bin(fps[i] ^ fps[j]).count("1") > 2 for i, j in edges) > 100  # the rule of op6 does not meet these
    want = sorted(set(union(edges, range(len(texts))).values()))
    kept = simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_fingerprints_are_candidates_without_bands(spark):
    rng = random.Random(9)
    source = [f"w{rng.randrange(5000)}" for _ in range(300)]
    crowd = [" ".join([*source[:150], f"x{i}", *source[150:]]) for i in range(150)]  # more than a key holds
    texts = sorted({*variants(rng, 30, 6, [3, 12, 40, 150, 600]), *crowd, *(t.upper() + " end" for t in crowd[:20])})
    held = spark.createDataFrame([(i, t, f"{i:032x}") for i, t in enumerate(texts)], "id long, text string, m string").select("id", "text", F.unhex("m").alias("mark"))
    rows = simhash._banded(held.select("id", "mark", "text")).withColumn("bands", F.lit(None).cast("array<bigint>")).localCheckpoint()
    fp = {r["id"]: r["fp"] for r in rows.select("id", "fp").collect()}
    sets = [shingles(t) for t in texts]
    for i in (0, 50, 150):  # a fingerprint is the vote of the set's hashes
        hashes = simhash.word_sets([texts[i]])[0].tolist()
        assert fp[i] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    edges = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if similarity(a, b) >= 0.8 and bin((fp[i] ^ fp[j]) % 2**64).count("1") <= 2]
    assert len(edges) > 1000
    groups = simhash.similar_sets(rows, held.select("mark", "text"))
    found = {r["id"]: r["component"] for r in rows.join(groups, ["k1", "k2"]).select("id", "component").collect()}
    want, linked = union(edges, range(len(texts))), {i for e in edges for i in e}
    named = {}
    for i in linked:
        named.setdefault(want[i], set()).add(found[i])
    assert set(found) >= linked and all(len(c) == 1 for c in named.values())
    whole = union([(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if similarity(a, b) >= 0.8], range(len(texts)))
    assert all(whole[min(i for i in found if found[i] == c)] == whole[i] for i, c in found.items())
