"""Operators on rows against plain versions: tokens, packing, media, language, quality, licenses, URLs, mixing."""

import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlpit.llm import langid, licenses, media, mixing, packing, quality, tokens, urls
from marlpit.llm.common import tokenizer_path

ODD = [
    None, "", " ", "\n\n", "a", "The cat's mat, it'll do.", "x<|endoftext|>y <|startoftext|>", "ÜMLAUT é 12 ½ ²³", "\x85a\xa0b\x1cc", "日本語 テスト", "_a_ __b", "ſtraße İstanbul Σ", "e\u0301 a\u0308",
    "a<|b|>c", "\ufffd \u200b \U0001f600!", "word " * 3000, "y" * 5000, "tab\tsep\x0bvt\x0cff\r\nend",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, row string, stats string"


@pytest.fixture(scope="module")
def docs(spark):
    """Null and repeated ids, null, empty, odd and long texts, and extra columns whose names operators use."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "x", 1, "r", "s") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], rows[5], (None, "no id here", None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts_equal_the_library(docs, empty):
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()), len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(docs).collect())
    assert got == want
    assert tokens.count_tokens(empty).count() == 0
    assert {r["over_limit"] for r in tokens.count_tokens(docs).where("n_tokens > 2048").collect()} == {True}


def test_packing_round_trip(docs, empty):
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = packing.pack(docs).orderBy("sequence_id").collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    joined, runs = {}, []
    for p in pieces:
        n = p["length"]
        assert n & (n - 1) == 0 and n <= 1024 and len(p["ids"]) == 4 * n and p["offset"] == 0 and p["bucket"] == n
        if p["start"] == 0:
            runs.append([p["doc_id"], b""])
        assert p["start"] * 4 == len(runs[-1][1])
        runs[-1][1] += p["ids"]
    for _, data in runs:
        joined.setdefault(data, 0)
        joined[data] += 1
    want = {}
    for r in docs.collect():
        data = np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want[data] = want.get(data, 0) + 1
    assert joined == want
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, max_length=1000)
    assert packing.binary_lengths(2500, 1024) == [1024, 1024, 256, 128, 64, 4]


def test_text_media(docs, empty):
    got = {(r["n_bytes"], r["payload_sha256"]): r for r in media.text_media(docs).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        own = got[len(raw), hashlib.sha256(payload).hexdigest()]
        stored = media.wav_8bit(payload)
        assert (own["payload_bytes"], own["tail_crc32"], own["media_bytes"]) == (len(payload), zlib.crc32(payload[-64:]), len(stored))
        assert own["media_sha256"] == hashlib.sha256(stored).hexdigest() and own["feature"].startswith("audio/wav")
    assert media.text_media(empty).count() == 0


def png() -> bytes:
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_validates_corrects_and_carves(spark):
    import gzip

    good, zipped, wave = png(), gzip.compress(b"hello"), media.wav_8bit(b"\1\2\3")
    broken = good[:-6] + b"\0" + good[-5:]
    rows = [
        (1, good, "image/jpeg"), (2, wave, "audio/wav"), (3, b"text " + good + b" more " + zipped, None), (4, broken, "image/png"), (5, None, None), (6, b"BM RIFF GIF89a PK\x03\x04 %PDF- \xff\xd8\xff", "text/plain"), (7, good + b"tail", None),
    ]
    df = spark.createDataFrame(rows, "id long, blob binary, kind string")
    got = {r["id"]: r for r in media.sniff(df, "id", "blob", "kind", carve=True).collect()}
    assert (got[1]["detected"], got[1]["corrected"]) == ("image/png", True)
    assert (got[2]["detected"], got[2]["corrected"]) == ("audio/wav", False)
    assert got[3]["detected"] == "application/octet-stream" and [bytes(c) for c in got[3]["carved"]] == [good, zipped]
    assert got[4]["detected"] == "application/octet-stream" and got[4]["corrected"]
    assert got[5]["media"] == [] and got[6]["media"] == []
    assert [(m["start"], m["end"]) for m in got[7]["media"]] == [(0, len(good))]


def posterior_by_hand(e, a):
    n, k = e.shape
    b, t = np.exp(e), np.exp(a)
    f, g = np.zeros((n, k)), np.ones((n, k))
    f[0] = b[0]
    for i in range(1, n):
        f[i] = (f[i - 1] @ t) * b[i]
        f[i] /= f[i].sum()
    for i in range(n - 2, -1, -1):
        g[i] = t @ (b[i + 1] * g[i + 1])
        g[i] /= g[i].sum()
    p = f * g
    return p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("sizes", [[1], [5, 1, 40], [32, 33, 64, 65, 3], [200, 1, 1, 31]])
def test_chunked_forward_backward_is_exact(sizes):
    rng = np.random.default_rng(1)
    e, a = rng.normal(size=(sum(sizes), 3)).astype(np.float32), rng.normal(size=(3, 3))
    got = langid.posteriors(e, np.array(sizes), a)
    want = np.concatenate([posterior_by_hand(x.astype(float), a) for x in np.split(e, np.cumsum(sizes)[:-1])])
    assert np.abs(got - want).max() < 1e-4


def test_language_of_held_out_and_switched_texts(spark, docs, empty):
    words = {"xx": ["alpha", "albon", "alder", "almus", "alto"], "yy": ["zuri", "zumba", "zuko", "zutho", "zurra"]}
    rng = np.random.default_rng(2)
    make = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(["xx", "yy"] * 20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(train)
    test = spark.createDataFrame([(1, make("xx", 7), None), (2, make("yy", 400), None), (3, None, None), (4, "123 !!", None), (5, make("xx", 20) + " " + make("yy", 30), None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(test, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["xx", "yy", "und", "und", "yy"] and got[3]["score"] == 0.0
    spans = langid.spans(test.where("doc_id = 5"), model).orderBy("first_word").collect()
    assert [(s["first_word"], s["n_words"], s["lang"]) for s in spans] == [(0, 20, "xx"), (20, 30, "yy")]
    assert langid.predict(docs, model).count() == docs.count() and langid.predict(empty, model).count() == 0
    assert langid.learn(train.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert spark.range(50).select(langid.held_out("id").alias("h"), "id").where("h").count() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50))


def test_accuracy_on_the_held_out_quarter(spark):
    from marlpit.llm.queries import op4_language_id

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = op4_language_id(spark, sf).where("held_out").join(docs, "doc_id").where("lang is not null")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0


def test_rule_statistics(docs):
    for r in quality.rule_stats(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        held = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)} if len(grams) < 500 else set(range(len(words)))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(held),
        )
        assert r["base_failed"] == (len(words) < 10 or 100 * len(held) > 20 * len(words))


def test_forest_rejects_junk_and_keeps_clean(spark, docs, empty):
    rng = np.random.default_rng(3)
    vocabulary = ["lorem", "ipsum", "dolor", "sitam", "consec", "adipis", "elitse", "eiusm", "tempor", "labore"]
    clean = lambda: ". ".join(" ".join(rng.choice(vocabulary, 6)).capitalize() for _ in range(8))
    junk = lambda: " ".join(w + rng.choice(["###", "%%%", "***"]) for w in rng.choice(vocabulary, 40))
    texts = [(i, junk() if i % 6 == 0 else clean()) for i in range(240)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(0, 240, 2)] + [(0, 0), (None, 1), (9999, None)], "doc_id long, quality int")
    stats = quality.rule_stats(rows)
    judged = quality.judge(stats, quality.fit(quality.labelled_stats(stats, labels))).collect()
    assert [r["kept"] for r in judged if not r["base_failed"]] == [r["doc_id"] % 6 > 0 for r in judged if not r["base_failed"]]
    kept = quality.keep_good(rows, labels)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in judged if r["kept"]}
    none = labels.limit(0)  # without labels only the fixed rules reject
    assert quality.keep_good(docs, none).columns == docs.columns
    assert quality.keep_good(docs, none).count() == quality.rule_stats(docs).where("not base_failed").count()
    assert quality.keep_good(empty, labels).count() == 0


def licensed(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found, last = {}, max(0, (len(words) - 33) // 32 * 32)
    for at in range(0, last + 1, 32):
        block = set(words[at : at + 64])
        for label, t in licenses.TEMPLATES:
            own = set(t.split())
            if len(block & own) >= math.ceil(0.8 * len(own) - 1e-9):
                found[label] = max(found.get(label, 0), len(block & own) / len(own))
    places = [i for i, _ in base]
    names = {x for _, x in base}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(names | set(found))), 1.0 if base else max(found.values(), default=0.0)


def test_license_scan_equals_brute_force(spark, docs, empty):
    pad = "the cat of a mat and under license " * 12
    texts = [pad[: 9 * i] + " ".join(t.split()[: len(t.split()) - cut]) + " " + pad for i, (cut, (_, t)) in enumerate((c, t) for t in licenses.TEMPLATES for c in (0, 1, 3, 6))]
    texts += ["Under the MIT License, under the mit  license!", "CC-BY-NC", "cc by NC Kind İ", "UNDER THE Mİt license", *[t for t in ODD if t is None or len(t) < 2000]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan(df).drop("found").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(licensed(texts[r["doc_id"]])), texts[r["doc_id"]]
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://a.com/en/1", "<link rel='canonical' href='/x/1'>"), (2, "https://b.org/q", '<META HTTP-EQUIV="refresh" content="0; url=http://a.com/x/1">'), (3, "HTTP://A.com:80/x/1#f", ""), (4, None, None), (5, "nourl", "<link rel=canonical href=x>"),
        (6, "http://q.example.com/en/77#f", '<link href="http://z.io/?a=1&amp;b=2" rel="canonical">'), (7, "http://z.io/?a=1&b=2", "<!-- <link rel=canonical href=//a.com/x/1> -->"), (8, "http://com/en/", None), (9, "x://notcom/en/", ""), (3, "HTTP://A.com:80/x/1#f", ""),
        (10, "http://m.io/1", "<link rel=canonical href=http://m.io/2>"), (11, "http://k.com/en/9", "<link rel=canonical href=http://m.io/1>"), (12, "http://k.example.com/en/70", "<link rel=canonical href=http://m.io/2>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages).collect()}
    assert got[1] == ("a.com", "/en/1", "com/en/", "block")
    assert got[2][2:] == (None, "block") and got[3] == ("a.com:80", "/x/1", None, "block")
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("example.com/en/7", "allow") and got[7][2:] == (None, "allow")
    assert got[8][2:] == ("com/en/", "block") and got[9] == ("notcom", "/en/", None, "allow")
    assert got[10][2:] == (None, "allow")  # an explicit allow of an alias goes before a block of another
    assert urls.filter_urls(pages).count() == len(rows) and urls.filter_urls(pages.limit(0)).count() == 0
    redirects = spark.createDataFrame([("http://w.io/", "http://v.io/"), ("http://v.io", "http://u.com/en/")], "source string, target string")
    one = spark.createDataFrame([(1, "http://w.io", "")], "page_id long, url string, html string")
    assert urls.filter_urls(one, redirects=redirects).first()["verdict"] == "block"


def water(sizes, weights, budget):
    target, open_ = {}, set(sizes)
    while True:
        level = (budget - sum(target.values())) / sum(weights[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weights[s] * level > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


def test_mix_meets_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"])
        assert all(0 <= d["position"] <= 1 for d in r["draws"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    key = lambda rs: sorted((str(r["row"]), r["taken"], str(r["draws"])) for r in rs)
    assert key(mixing.mix(docs.repartition(7)).collect()) == key(rows)
    assert mixing.mix(empty).count() == 0
    whole = mixing.mixed_rows(docs)
    assert whole.columns == docs.columns
    copies = {r["text"]: r["count"] for r in whole.groupBy("text").count().collect()}
    assert set(copies) <= {r["text"] for r in docs.collect()} and mixing.mixed_rows(empty).count() == 0


def test_positions_follow_the_schedule(spark):
    df = spark.createDataFrame([(i, "w " * 10, "only") for i in range(200)], "doc_id long, text string, source string")
    falling = [(1.0, [(0.0, 2.0), (1.0, 0.0)])]
    at = sorted(d["position"] for r in mixing.mix(df, cycle=falling, budget=1.0).collect() for d in r["draws"])
    share = np.arange(200) / 200  # demand 1 - (1 - t)^2 is reached at 1 - sqrt(1 - share)
    assert np.abs(np.array(at) - (1 - np.sqrt(1 - share))).max() < 1e-6
    ordered = [r["position"] for r in mixing.training_order(mixing.mix(df, cycle=falling, budget=1.0)).collect()]
    assert ordered == sorted(ordered)
