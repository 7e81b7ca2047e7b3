"""Pieces of the methods against plain versions, and inputs that once went wrong."""

import io
import itertools
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.llm import langid, licenses, media, packing, quality, tokens, urls
from marlpit.llm.common import tokenizer_path


def test_crf_expectations_equal_enumeration():
    rng = np.random.default_rng(0)
    n, length, k = 3, 4, 3
    e, t, gold = rng.normal(size=(n, length, k)) * 2, rng.normal(size=(k, k)), rng.integers(0, k, (n, length))
    loss, pairs, post = langid.expectations(e, t, gold)
    want_loss, want_pairs, want_post = 0.0, np.zeros((k, k)), np.zeros((n, length, k))
    score = lambda s, p: sum(e[s, i, x] for i, x in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise(p))
    for s in range(n):
        all_paths = list(itertools.product(range(k), repeat=length))
        w = np.exp([score(s, p) for p in all_paths])
        want_loss += np.log(w.sum()) - score(s, gold[s])
        for p, x in zip(all_paths, w / w.sum(), strict=True):
            for i, c in enumerate(p):
                want_post[s, i, c] += x
            for a, b in itertools.pairwise(p):
                want_pairs[a, b] += x
    assert loss == pytest.approx(want_loss) and pairs == pytest.approx(want_pairs) and post == pytest.approx(want_post)


def test_learning_with_a_hot_id(spark):
    """An id with thousands of rows is bounded like any other: by rows."""
    words = {"xx": "aka bolo cimu dela efo gani".split(), "yy": "strom brzk plutsch knorr wirst zwock".split()}
    rng = random.Random(1)
    rows = [(7, " ".join(rng.choices(words["xx"], k=40)), "xx") for _ in range(3000)] + [(7, "aka bolo", "xx")] * 500 + [(i, " ".join(rng.choices(words["yy"], k=40)), "yy") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = []
    real = langid.train
    try:
        langid.train = lambda sequences, **k: held.append(len(sequences)) or real(sequences, **k)
        model = langid.learn(df, docs_per_language=30, windows_per_doc=3)
    finally:
        langid.train = real
    assert held[0] <= 2 * 30 * 3
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, "bolo cimu dela"), (2, "knorr wirst")], "doc_id long, text string"), model).collect()}
    assert got == {1: "xx", 2: "yy"}


def test_forest_paths_equal_a_walk():
    rng = np.random.default_rng(3)
    good = rng.uniform(size=(300, 3))
    forest = quality.grow(good, np.zeros(3), np.ones(3), trees=9, rows=64, seed=1)
    x = rng.uniform(-0.5, 1.5, size=(40, 3))
    want = []
    for row in x:
        total = 0.0
        for t in range(9):
            node = 0
            while forest.feature[t, node] >= 0:
                node = 2 * node + 1 + (row[forest.feature[t, node]] >= forest.split[t, node])
            total += forest.path[t, node]
        want.append(2 ** (-(total / 9) / forest.norm))
    assert forest.score(x) == pytest.approx(np.array(want))
    deep = forest.feature[0] >= 0
    assert deep.any() and (forest.path[0][~deep] <= 8 + quality._mean_path(np.array([64]))[0]).all()


MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
)


def test_whole_license_texts(spark):
    """A template of many blocks' length is found whole, short ones keep their short blocks."""
    n = len(MIT.split())
    assert n > 2 * licenses.STRIDE and licenses.stride_of(MIT) >= n - 1 and licenses.stride_of("a b") == licenses.STRIDE
    pad = "words of another kind that no notice would ever have inside " * 40
    cut = " ".join(MIT.split()[: n // 3])
    rows = [(1, f"{pad[:700]} {MIT} {pad}"), (2, f"{pad} {MIT.upper()}"), (3, f"{pad} {cut} {pad}"), (4, pad), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df, [*licenses.TEMPLATES, ("mit-full", MIT)]).collect()}
    assert ["mit-full" in got[i]["labels"].split(",") for i in (1, 2, 3, 4, 5)] == [True, True, False, False, False]
    assert ["mit" in got[i]["labels"].split(",") for i in (1, 2, 3, 4)] == [True, True, True, False]


def test_chains_of_canonical_links(spark):
    """A long chain of pages, each with two canonical links, takes the block of its far end, unless something in it is allowed."""
    page = lambda site, i: f"http://{site}/p{i}"
    html = lambda *to: "".join(f"<link rel='canonical' href='{x}'>" for x in to)
    rows = [(i, page("chain.io", i), html(page("noise.io", i), page("chain.io", i + 1))) for i in range(300)]
    rows += [(900, page("chain.io", 300), html("http://shop.com/en/1"))]
    rows += [(1000 + i, page("free.io", i), html(page("free.io", i + 1), "http://shop.com/en/2" if i == 0 else "")) for i in range(100)]
    rows += [(2000, page("free.io", 100), html("http://example.com/en/7"))]
    rows += [(3000 + i, page("alone.io", i), "") for i in range(50)]
    got = {r["page_id"]: (r["verdict"], r["reason"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == ("block", "alias") for i in [*range(300), 900])
    assert all(got[1000 + i] == ("allow", "alias") for i in range(100)) and got[2000] == ("allow", "alias")
    assert all(got[3000 + i] == ("allow", "default") for i in range(50))


def test_saved_again_and_nested_containers():
    sniffer = media.Sniffer()
    section = b"1 0 obj<<>>endobj\nstartxref\n9\n%%EOF\n"
    pdf = b"%PDF-1.4\n" + section + section
    (kind, start, end), *rest = sniffer.media(b"junk" + pdf + b"tail %PDF-1.5\n" + section)
    assert (kind, start, end) == ("application/pdf", 4, 4 + len(pdf) - 1) and [k for k, *_ in rest] == ["application/pdf"]
    inner, outer = io.BytesIO(), io.BytesIO()
    for to, name, data in ((inner, "a", b"text"), (outer, "b", None)):
        with zipfile.ZipFile(to, "w", zipfile.ZIP_STORED) as z:
            z.writestr(name, data if data is not None else inner.getvalue())
    assert sniffer.media(outer.getvalue()) == [("application/zip", 0, len(outer.getvalue()))]
    assert sniffer.media(b"%PDF-1.4 PK\x03\x04" * 50_000) == []


def test_texts_with_media_inside_are_carved(spark):
    gray = "P5\n2 3\n255\nabcdef"
    df = spark.createDataFrame([(1, f"before {gray} after"), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in media.text_media(df).collect()}
    assert [x.split(";")[:2] for x in got[1]["carved"]] == [["image/x-portable-graymap", str(len(gray))]] and got[2]["carved"] == []
    assert all((r["detected"], r["corrected"]) == ("audio/wav", True) for r in got.values())


def changed(name, tmp_path, change):
    with open(tokenizer_path(name), encoding="utf-8") as f:
        file = json.load(f)
    change(file)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    return str(path)


TEXTS = ["It's 1234 words, and MORE_words!", "don't  stop 55\n\n now", "naïve Ünter 12é"]


def test_files_with_other_patterns(tmp_path):
    """The fast paths only serve files that split as they do; others go through the library or are refused."""
    from tokenizers import Tokenizer

    def split(file):
        file["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\p{L}+|[\p{N}]+|[^\s\p{L}\p{N}]"}

    path = changed("word_bpe_49k.json", tmp_path, split)
    bpe, lib = tokens.WordBpe(path), Tokenizer.from_file(path)
    assert not bpe.known
    for text in TEXTS:
        assert sum(bpe.count(x) for x in bpe.pieces(text)) == len(lib.encode(text, add_special_tokens=False).ids)
    with pytest.raises(ValueError):
        tokens.WordBpe(changed("word_bpe_49k.json", tmp_path, lambda f: f.update(pre_tokenizer={"type": "Whitespace"})))

    path = changed("byte_bpe_50k.json", tmp_path, lambda f: f["pre_tokenizer"].update(add_prefix_space=True))
    bpe, lib = packing.ByteBpe(path), Tokenizer.from_file(path)
    assert not bpe.known and packing.ByteBpe(tokenizer_path("byte_bpe_50k.json")).known and tokens.WordBpe(tokenizer_path("word_bpe_49k.json")).known
    for text in TEXTS:
        assert bpe.ids(text) == np.asarray(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_counts_when_a_task_forgets(spark, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    rows = [(i, " ".join(f"w{j}x{i % 5}" for j in range(i, i + 90))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df.select("*", F.lit(1).alias("block"))).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}
