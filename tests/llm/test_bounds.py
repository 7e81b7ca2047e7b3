"""What is fitted stays bounded, and long texts take little memory."""

import random
import tracemalloc

import numpy as np
import pytest

from marlpit.llm import common, langid, licenses, lines, quality


def test_words_by_numbers_equal_words(monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", "a", "a b c d e", "a b c d e f", "a " * 9, "!! ?? 1 ! a\n" * 7]
    texts += [" ".join(rng.choice(["a", "bb", "é", "--", "1", "c d", "İ"]) for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        assert quality.long_word_stats(t) == quality.word_stats(t), t
    whole = [quality.text_stats(t) for t in texts]
    monkeypatch.setattr(quality, "LONG_TEXT", 8)
    assert [quality.text_stats(t) for t in texts] == whole


@pytest.mark.parametrize("text", ["spam eggs and ham again\n" * 850_000, " ".join(map(str, range(2_600_000)))], ids=["repeats", "different"])
def test_long_text_of_20_mb(text):
    tracemalloc.start()
    n, *_, repeated, _ = quality.text_stats(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 2_000_000 and repeated == (n if text[0] == "s" else 0) and peak < 1 << 30


def test_many_labels_stay_bounded(spark):
    """600 labels of five documents: the most frequent are learned, and no more windows than the bound."""
    rng = random.Random(5)
    rows = [(1000 * n + i, " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}{rng.randrange(40)}".translate({48 + d: 103 + d for d in range(10)}) for _ in range(80)), f"l{n:03}") for n in range(600) for i in range(5 + (n < 12))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, max_languages=12, max_windows=200)
    assert model.languages == [f"l{n:03}" for n in range(12)] and model.weight.shape[0] >= langid.BUCKETS
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    own = [r for r in rows if r[2] in model.languages]
    assert len(got) == len(rows) and np.mean([got[i]["lang_pred"] == lang for i, _, lang in own]) > 0.95
    assert all(r["lang_pred"] in model.languages and 0 <= r["score"] <= 1 for r in got.values())
    wide = langid.learn(df, docs_per_language=1, windows_per_doc=1)
    assert len(wide.languages) == 64 and wide.buckets == langid.BUCKETS // 4 and wide.weight.nbytes < 1 << 27
    assert langid.predict(df, wide).count() == len(rows)


def test_blocks_of_training_agree(monkeypatch):
    rng = np.random.default_rng(1)
    e, t, gold = rng.normal(size=(7, 5, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, (7, 5))
    whole = langid.expectations(e, t, gold)
    monkeypatch.setattr(langid, "BLOCK_NUMBERS", 18)
    for a, b in zip(whole, langid.expectations(e, t, gold), strict=True):
        assert np.allclose(a, b)


@pytest.mark.parametrize("limit", [licenses.BROADCAST_CHARS, 0])
def test_many_long_templates(spark, monkeypatch, limit):
    """Long templates share an index of numbers; without the broadcast results are the same."""
    monkeypatch.setattr(licenses, "BROADCAST_CHARS", limit)
    rng = random.Random(2)
    templates = [(f"t{n}", " ".join(f"w{rng.randrange(900)}" for _ in range(400))) for n in range(8)]
    rows = [(n, f"{'before it ' * 30}{t} after") for n, (_, t) in enumerate(templates)] + [(100, None), (101, ""), (102, " ".join(templates[0][1].split()[:200]))]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert all(f"t{n}" in got[n] for n in range(8)) and len(got) == len(rows) and got[100] == [""] and "t0" not in got[102]


def test_workers_forget_with_their_operator():
    held = lines.Remembered(lambda text: frozenset(text), 100)
    common.worker_state(common.nothing, "one")
    assert held("abc") == {"a", "b", "c"} and held.total == 3
    common.worker_state(common.nothing, "one")
    assert held.total == 3
    common.worker_state(common.nothing, "other")
    assert held.total == 0 and not held.held and held("ab") == {"a", "b"}
