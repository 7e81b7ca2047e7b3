"""The divergence audit, hard negatives and byte-level BPE against plain Python and the library."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlpit.llm import bytebpe, divergence, negatives, queries
from marlpit.llm.common import ASCII_LOWER, tokenizer_path

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def plain_divergence(rows, least, top):
    docs = [tuple(x or "" for x in r) for r in rows]
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        words = TERM.findall(text.translate(ASCII_LOWER))
        held[lang].update(set(words))
        count[lang, source].update(words)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        totals = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda c, n, v=len(kept): 1 + 1_000_000_000 * (c + 5) // (n + 5 * v)
        p = {s: {t: share(count[lang, s][t], totals[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(totals.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= top}
    return out


def divergence_rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def random_docs(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Été", "ÉTÉ", "The", "THE", "日本"]
    docs = [(rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", None]), rng.choice([None, "", " 7 ", " ".join(rng.choices(words, k=rng.randint(1, 40)))])) for _ in range(n)]
    return docs + [("en", "only", "1 2 3"), ("xx", "alone", "one two"), ("xx", "other", "")] + docs[:20]


@pytest.mark.parametrize("width", [16384, None])
def test_divergence_equals_plain_counting(spark, width):
    docs = random_docs(5)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, source string, text string, term int, count string").repartition(5)
    got = divergence_rows(divergence.divergence(df, min_docs=6, top=7, width=width))
    assert got == sorted(plain_divergence(docs, 6, 7))


def test_a_crowded_sketch_changes_nothing_and_never_underestimates(spark, monkeypatch):
    monkeypatch.setattr(divergence, "RANGE", 64)
    docs = random_docs(6)
    df = spark.createDataFrame(docs, "lang string, source string, text string").fillna("")
    wide = divergence.possible_terms(df, 16, 6)  # fewer cells than terms: nearly all are possible
    assert np.unpackbits(np.frombuffer(wide, np.uint8)).mean() > 0.9
    assert divergence_rows(divergence.divergence(df, 6, 7, width=16)) == sorted(plain_divergence(docs, 6, 7))


def test_long_texts_are_counted_in_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 50)
    docs = [("en", "a", "alpha Beta " * 40 + "x" * 120), ("en", "b", "beta"), ("en", "b", "y" * 60 + " gamma")] * 3
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    assert divergence._long_text(b"ab cd " * 40 + b"z" * 130) == Counter({b"ab": 40, b"cd": 40, b"z" * 130: 1})
    assert divergence_rows(divergence.divergence(df, 2, 50)) == sorted(plain_divergence(docs, 2, 50))


def test_divergence_of_empty_tables_and_large_counts(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.divergence(none).count() == 0
    share = spark.sql(f"select {10**12} as c, {3 * 10**12} as n, 10 as v").select(divergence._share("c", "n", "v")).first()[0]
    assert share == 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 50)


def plain_negatives(rows, anchor):
    part = {}
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        whole = [math.floor(256 * x) for x in vec]
        if sum(x * x for x in whole) < 1 << 62:
            part[i] = min(part.get(i, (label, whole)), (label, whole))
    score = lambda a, b: sum(x * y for x, y in zip(part[a][1], part[b][1], strict=False))
    out = set()
    for a in filter(anchor, part):
        ranked = sorted(((-score(a, b), b) for b in part if b != a))
        for s, positive in [x for x in ranked if part[x[1]][0] == part[a][0]][:5]:
            fits = [(n, b) for n, b in ranked if part[b][0] != part[a][0] and 50 * -s <= 100 * -n <= 95 * -s]
            out |= {(a, positive, r, b, -s, -n) for r, (n, b) in enumerate(fits[:3], 1)}
    return out


def negative_rows(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_hard_negatives_equal_scoring_all_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 16)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(4, 9))
    rows = [(i, i % 4, (middle[i % 4] * 0.6 + rng.normal(size=9) * 0.5).tolist()) for i in range(400)]
    rows += [(500 + i, 1, rows[0][2]) for i in range(30)]  # ties of many copies
    rows += [(600, 2, [0.0] * 9), (601, None, [1.0] * 9), (602, 1, None), (603, 1, [1.0] * 8 + [None]), (604, 1, [1.0] * 8 + [math.nan]), (605, 3, [math.inf] * 9), (None, 1, [1.0] * 9)]
    rows += [(606, 1, [0.5, 0.5]), (608, 2, []), (700, 1, [1e30] * 9), (702, 2, [-2.0e6] * 9), (704, 2, [2.0e6] * 9), (0, 3, [1.0] * 9), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "vec_id long, label int, embedding array<double>, id int, score string").repartition(3)
    got = negative_rows(negatives.hard_negatives(df, anchors=F.col("vec_id") % 2 == 0))
    assert got == sorted(plain_negatives(rows, lambda i: i % 2 == 0))


def test_residual_bounds_hold_and_prune(spark):
    rows = negatives.whole_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("label"))
    x = np.array([r.vec for r in rows.collect()], np.int64)
    book = negatives.fit(rows, x.shape[1])
    codes, norms = book.encode(x.astype(float))
    row = {"ids": np.arange(len(x)).tobytes(), "codes": codes.tobytes(), "norms": norms.tobytes()}
    low, high = negatives._ranges(row, x, book)
    exact = x @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    fifth = np.partition(low, -5, axis=1)[:, -5]
    assert (high >= fifth[:, None]).mean() < 0.5


def test_hard_negatives_of_an_empty_table(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


@pytest.fixture(scope="module")
def library():
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = bytebpe._ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(2)
    letters = ["ab", "abc ", "the an ", "éèà 日本x1", "xyzXYZ019_- \n\t", "🎉á", "\x1c\x85\xa0 a", "İıßſK²½"]
    texts = ["".join(rng.choices(x, k=rng.randint(0, 300))) for x in letters for _ in range(12)]
    return texts + ["", "don't you'LL I've", "<|endoftext|>", "日本語" * 300, "a" * 5000, " " * 3000 + "x", "ab" * 700, "".join(rng.choices("abcde", k=600)), "\r\n \r\n", "مرحبا 한국어 ไทย"]


def test_encoding_equals_the_library_and_decodes(spark, library):
    texts = [*odd_texts(), None]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in enumerate(texts)], "doc_id long, text string, ids int, value string").repartition(3)
    got = {r.doc_id: r for r in bytebpe.decode(bytebpe.encode(df)).collect()}
    for i, text in enumerate(texts):
        assert got[i]["ids"] == library.encode_ordinary(text or "") and bytes(got[i]["bytes"]) == (text or "").encode() and got[i]["value"] == "b"


def test_any_merge_table_is_followed_leftmost_first(tmp_path):
    """Vocabularies in which a longer token may come before its parts, so pairs may not be contracted together."""
    import tiktoken
    from public_tokenizers import PATTERN

    for seed in range(12):
        rng = random.Random(seed)
        more = {"".join(rng.choices("ab", k=rng.randint(2, 5))).encode() for _ in range(12)}
        order = [*(bytes([b]) for b in range(256)), *rng.sample(sorted(more), len(more))]
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order)))
        want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        bpe = bytebpe.Encoder(str(path))
        texts = ["".join(rng.choices("ab", k=n)) for n in (1, 5, 17, 60, 400)]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == [want.encode_ordinary(t) for t in texts]
        raw = [t.encode() for t in texts]
        assert [np.frombuffer(a, "<u4").tolist() for a in bpe.contract(raw, bytebpe._CONTRACT_RUNS)] == [np.frombuffer(a, "<u4").tolist() for a in bpe.contract(raw)]


def test_decoding_handles_nulls_and_refuses_unknown_ids(spark):
    df = spark.createDataFrame([(None,), ([],), ([15496, None],), ([15496],)], "ids array<int>")
    assert [r["bytes"] and bytes(r["bytes"]) for r in bytebpe.decode(df).collect()] == [None, b"", None, b"Hello"]
    with pytest.raises(Exception, match="vocabulary"):
        bytebpe.decode(spark.createDataFrame([([60000],)], "ids array<int>")).collect()
    assert bytebpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_digests_of_whole_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, SF).collect()}
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_bpe_workers_get_modest_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches if b.num_rows)
    try:
        for step in (bytebpe.encode, lambda docs: bytebpe.decode(docs.selectExpr("array(1) AS ids"))):
            spark.conf.set(name, "10000")
            docs = spark.range(3000).selectExpr("id", "'some text' AS text").coalesce(1)
            assert step(docs).count() == 3000
            assert max(r["n"] for r in docs.mapInArrow(rows, "n long").collect()) <= 1000
    finally:
        spark.conf.set(name, before)
