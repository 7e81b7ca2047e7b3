"""Quality rules judged by an isolation forest over rule statistics.

Each document gets statistics that quality rules look at. Two fixed rules reject at
once; for the rest an isolation forest gives an anomaly score from the mean path length
over random splits, and the score that rejects is read off all labelled rows.

Split points are drawn over the box that the labelled rows span, and halve that box with
the node, instead of over the range of the rows that reached it. The rows are labelled
good, so a part of the box without good rows ends early: documents there have short paths,
whereas good rows keep together until the depth limit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import WORD, cut, modest_batches, nothing, worker_state

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Characters from which on a text's words are handled as numbers.
LONG_TEXT = 1 << 18
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Rates that the forest sees: none depends on a text's length or language by itself. Repeated lines
#: are left out, as labelled rows of both qualities have them alike.
FEATURES = ("symbols", "repeats", "echoes", "capitals", "bare_words", "marks", "word_length")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"

_BYTE = np.arange(256)
_IS_SYMBOL = np.isin(_BYTE, list(SYMBOLS.encode()))
_IS_CAPITAL = (_BYTE >= 65) & (_BYTE <= 90)
_IS_MARK = np.isin(_BYTE, list(b"!?"))
_IS_BLANK = np.isin(_BYTE, list(BLANKS.encode()))
#: ASCII letters and the first bytes of longer characters.
_IS_LETTER = _IS_CAPITAL | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 0xC2)
_IS_CHAR = (_BYTE < 0x80) | (_BYTE >= 0xC2)


def word_stats(text: str) -> tuple[int, int, int, int, int]:
    """(words, their characters, words in repeated windows, words that equal the one before, words without letter or digit)."""
    words = WORD.findall(text)
    n, repeated = len(words), 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            held = np.zeros(n + 1, np.int64)
            at = np.fromiter((i for i, w in enumerate(windows) if counts[w] > 1), np.int64)
            np.add.at(held, at, 1)
            np.add.at(held, at + WINDOW, -1)
            repeated = int((np.cumsum(held) > 0).sum())
    bare = sum(1 for w in words if not w[0].isalnum() and not any(map(str.isalnum, w)))
    return n, sum(map(len, words)), repeated, sum(map(eq, words, words[1:])), bare


def long_word_stats(text: str) -> tuple[int, int, int, int, int]:
    """``word_stats`` of a long text by numbers in place of words: some 20 bytes a word at a time, and its different words once."""
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(m[0], len(index)) for m in WORD.finditer(text)), np.int64)
    n, times = len(ids), np.bincount(ids, minlength=len(index))
    sizes = np.fromiter(map(len, index), np.int64, len(index))
    bare = np.fromiter((not any(map(str.isalnum, w)) for w in index), bool, len(index))
    repeated = 0
    if n > WINDOW:
        paired = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]  # noqa: E731  a number for each different pair
        two = paired(ids[:-1], ids[1:])
        window = paired(paired(two[:-2], two[2:])[:-1], ids[WINDOW - 1 :])
        at = np.flatnonzero((np.bincount(window) > 1)[window])
        held = np.bincount(at, minlength=n + 1) - np.bincount(at + WINDOW, minlength=n + 1)
        repeated = int((np.cumsum(held) > 0).sum())
    return n, int((times * sizes).sum()), repeated, int((ids[1:] == ids[:-1]).sum()), int(times[bare].sum())


def text_stats(text: str | None) -> tuple:
    """The values of STATS for one text; null counts as empty. Memory beside a long text is a small multiple of it."""
    text = text or ""
    n, chars, repeated, echoes, bare = (long_word_stats if len(text) > LONG_TEXT else word_stats)(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    found = sum((np.bincount(data[i : i + LONG_TEXT], minlength=256) for i in range(0, len(data), LONG_TEXT)), np.zeros(256, np.int64))
    symbols = int(found[_IS_SYMBOL].sum())
    visible = max(1, int(found[_IS_CHAR & ~_IS_BLANK].sum()))
    letters = int(found[_IS_LETTER].sum())
    rates = [
        symbols / visible, repeated / max(1, n), echoes / max(1, n), int(found[_IS_CAPITAL].sum()) / max(1, letters),
        bare / max(1, n), int(found[_IS_MARK].sum()) / visible, min(chars / max(1, n), 40.0) / 40.0,
    ]
    return n, chars, symbols, dup_lines, repeated, rates


def stats_of(text: Column) -> Column:
    @F.pandas_udf(STATS)
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_state(nothing, "quality")
        for part in texts:
            yield pd.DataFrame([text_stats(t) for t in part], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"])

    return stats(text)


def rule_stats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, statistics and ``base_failed`` of each row; a null text has no words and fails, rows that repeat count each."""
    modest_batches(docs.sparkSession)
    return docs.select(F.col(id_column), stats_of(F.col(text_column)).alias("s")).select(id_column, "s.*", _failed("s").alias("base_failed"))


def _failed(stats: str) -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows of a random tree."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649015329) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees as arrays (trees, nodes); feature -1 marks a leaf."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = float("inf")

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over the normal one: near 1 for anomalies."""
        trees = np.arange(self.feature.shape[0])
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.feature.shape[1] + 1)) - 1):
            f = self.feature[trees, node]
            right = x[rows, np.maximum(f, 0)] >= self.split[trees, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return np.exp2(-self.path[trees, node].mean(axis=1) / self.norm)


def grow(good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 128, rows: int = 256, seed: int = 7) -> Forest:
    """Trees over random draws from ``good``, splitting the box from ``low`` to ``high``."""
    rng, depth = np.random.default_rng(seed), 8
    size = min(rows, len(good))
    feature, split, path = (np.full((trees, 2 ** (depth + 1) - 1), v, t) for v, t in ((-1, np.int64), (0.0, float), (0.0, float)))
    usable = np.flatnonzero(high > low)
    for t in range(trees):
        todo = [(0, 0, good[rng.permutation(len(good))[:size]], low.copy(), high.copy())]
        while todo:
            node, level, part, lo, hi = todo.pop()
            if level == depth or len(part) <= 1 or not len(usable):
                path[t, node] = level + _mean_path(len(part))
                continue
            f = rng.choice(usable)
            at = rng.uniform(lo[f], hi[f])
            feature[t, node], split[t, node] = f, at
            left, right = hi.copy(), lo.copy()
            left[f] = right[f] = at
            goes = part[:, f] >= at
            todo += [(2 * node + 1, level + 1, part[~goes], lo, left), (2 * node + 2, level + 1, part[goes], right, hi)]
    return Forest(feature, split, path, float(max(_mean_path(size), 1.0)))


def score_with(model: Forest):
    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        worker_state(nothing, "quality")
        return pd.Series(model.score(np.stack(features)) if len(features) else [], dtype=float)

    return score


def kept_by(model: Forest):
    """Statistics, fixed rules and score of a text in one call, for rows that go on with their text."""

    @F.pandas_udf("boolean")
    def kept(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_state(nothing, "quality")
        for part in texts:
            stats = [text_stats(t) for t in part]
            n, repeated = (np.array([s[i] for s in stats], np.int64) for i in (0, 4))
            anomaly = model.score(np.array([s[5] for s in stats]).reshape(-1, len(FEATURES)))
            yield pd.Series((n >= MIN_WORDS) & (100 * repeated <= MAX_REPEAT_PERCENT * n) & (anomaly < model.threshold))

    return kept


def fit(labelled: DataFrame, max_fit_rows: int = 4096, max_false_reject: float = 0.001, bins: int = 2000) -> Forest:
    """A calibrated forest from rows (doc_id, quality, features, base_failed).

    The trees come from at most ``max_fit_rows`` rows with quality 1, those of the smallest
    id hashes. The box and the threshold come from all labelled rows that the fixed rules
    let pass: the threshold is the score that best separates the two qualities among those
    that reject at most ``max_false_reject`` of the good. Without both qualities nothing
    is rejected. The driver gets the sample, the box and a histogram of ``bins`` scores.
    """
    rows = labelled.where("not base_failed and quality in (0, 1)")
    sample = [r[0] for r in rows.where("quality = 1").select("features", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id", "features").limit(max_fit_rows).collect()]
    k = len(FEATURES)
    box = rows.agg(*(f(F.col("features")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("a", F.min), ("b", F.max)))).first()
    if not sample:
        return Forest(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1)), 1.0)
    model = grow(np.array(sample), np.array([box[f"a{i}"] for i in range(k)], float), np.array([box[f"b{i}"] for i in range(k)], float))
    counts = rows.groupBy("quality", F.floor(score_with(model)("features") * bins).cast("int").alias("bin")).count().collect()
    of = np.zeros((2, bins + 1), np.int64)
    for r in counts:
        of[r["quality"], min(r["bin"], bins)] += r["count"]
    if of[0].sum() and of[1].sum():
        bad, good = (of[q, ::-1].cumsum()[::-1] / of[q].sum() for q in (0, 1))  # rejected from each bin on
        gain = np.where(good <= max_false_reject, bad - good, -1)
        if gain.max() > 0:
            best = np.flatnonzero(gain == gain.max())
            model.threshold = float(best[len(best) // 2]) / bins
    return model


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics with their label; ids that are null or without a label go, an id's repeated labels count once,
    and an id with both labels counts as bad."""
    once = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return stats.select("doc_id", "features", "base_failed").join(once, "doc_id")


def judge(stats: DataFrame, model: Forest) -> DataFrame:
    """``stats`` with ``anomaly`` and ``kept``: false if a fixed rule fails, else whether the score stays under the threshold."""
    return stats.withColumn("anomaly", score_with(model)("features")).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(model.threshold)))


def keep_good(docs: DataFrame, labels: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, with the same columns whatever their names; labels are looked up by id.

    A null text has no words, so it goes; rows that repeat are judged each; an empty table stays empty; without labelled rows
    the fixed rules decide alone.
    """
    known = labels.select(F.col("doc_id").alias("l")).dropDuplicates()
    stats = rule_stats(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(known, F.col("doc_id") == F.col("l"), "left_semi"))
    model = fit(cut(labelled_stats(stats, labels)))
    return docs.where(kept_by(model)(F.col(text_column)))
