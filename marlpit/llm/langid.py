"""Language of words and documents by a linear-chain conditional random field.

A word's features are its character n-grams, those at its ends (affixes) and its form if
the lexicon has it. Together they give each language an emission score; learned
transition scores say how languages follow each other, so that a text may switch.
Training maximises the likelihood of labelled word sequences, half of them spliced from
two documents; forward-backward gives the posterior of each word in its whole text.

Prediction runs forward-backward exactly over texts of any length, in vectorised form:
words are laid out in chunks, each chunk's transfer matrix is multiplied out, chunk
borders are passed along each text, then every chunk is filled in from its borders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import cut, modest_batches, worker_state

#: A word is a run of letters; Latin texts (but for digits that count as letters here) need no Unicode tables.
_LATIN = re.compile(r"[\x00-ɏ]*")
_LATIN_WORD = re.compile(r"[^\W\d_²³¹¼½¾]+")
START, END, UNKNOWN = "\x02", "\x03", "und"
BUCKETS, CHUNK, SLICE_WORDS, CACHE = 1 << 18, 32, 200_000, 300_000
#: Languages that still get all buckets; beyond, every doubling halves them, so that weights stay bounded.
WIDE_LANGUAGES = 16
#: Numbers of one block of transition products in training, and of chunk matrices in prediction.
BLOCK_NUMBERS = 1 << 22
_TERNARY = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> list[str]:
    """The lower-cased words of a text."""
    text = text.lower()
    if _LATIN.fullmatch(text):
        return _LATIN_WORD.findall(text)
    import regex

    return regex.findall(r"\p{L}+", text)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _TERNARY
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram feature of the words, the word each belongs to, and the hash of each whole word."""
    codes = np.frombuffer("".join(f"{START}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    last = np.repeat(np.cumsum(sizes), sizes)  # where the word's characters end
    at, h, found, owners = np.arange(len(codes)), np.zeros(len(codes), np.uint64), [], []
    marks = (codes == 2) | (codes == 3)
    for n in range(1, 5):
        h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]
        held = at[: len(h)] + n <= last[: len(h)]
        if n == 1:
            held &= ~marks
        found.append(_mix(h[held] * np.uint64(8) + np.uint64(n)) % np.uint64(BUCKETS))
        owners.append(owner[: len(h)][held])
    powers = _mix(codes * np.uint64(131) + (at - (last - np.repeat(sizes, sizes))).astype(np.uint64))
    whole = np.add.reduceat(powers, np.cumsum(sizes) - sizes) if words else np.zeros(0, np.uint64)
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), whole


@dataclass
class Crf:
    languages: list[str]
    weight: np.ndarray  # (BUCKETS + lexicon, languages)
    transition: np.ndarray
    lexicon: np.ndarray  # sorted hashes of known words
    buckets: int = BUCKETS  # a power of two

    def index(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, word and value: a word's features share the weight 1 by their root."""
        found, owner, whole = features(words)
        place = np.searchsorted(self.lexicon, whole)
        known = np.flatnonzero((place < len(self.lexicon)) & (self.lexicon[np.minimum(place, max(0, len(self.lexicon) - 1))] == whole)) if len(self.lexicon) else np.zeros(0, np.int64)
        found, owner = np.concatenate([found % self.buckets, self.buckets + place[known]]), np.concatenate([owner, known])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
        return found, owner, (1 / np.sqrt(np.bincount(owner, minlength=len(words))))[owner]

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        found, owner, value = self.index(words)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return np.add.reduceat(self.weight[found] * value[:, None].astype(np.float32), starts, axis=0).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(sequences: list[tuple[list[str], list[str]]], steps: int = 60, rate: float = 0.15, l2: float = 1e-6, min_lexicon: int = 4, settled: float = 0.002) -> Crf:
    """Fit by Adam on equally long (words, languages) sequences; the bounded sample lies in the driver's memory.

    Training ends after ``steps``, or when the sample's negative log-likelihood a word is below ``settled``.
    """
    languages = sorted({x for _, tags in sequences for x in tags})
    k, of = len(languages), {x: i for i, x in enumerate(languages)}
    flat = [w for words, _ in sequences for w in words]
    vocabulary, ids = np.unique(np.array(flat, dtype=object), return_inverse=True)
    vocabulary = vocabulary.tolist()
    counts = np.bincount(ids, minlength=len(vocabulary))
    lexicon = np.unique(features(vocabulary)[2][counts >= min_lexicon])
    buckets = BUCKETS >> max(0, (-(-k // WIDE_LANGUAGES) - 1).bit_length())
    model = Crf(languages, np.zeros((buckets + len(lexicon), k), np.float32), np.zeros((k, k)), lexicon, buckets)
    found, owner, value = model.index(vocabulary)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    used, found = np.unique(found, return_inverse=True)  # only weights that the sample touches move
    w, t = np.zeros((len(used), k)), np.zeros((k, k))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t)]
    size, length = len(sequences), len(sequences[0][0])
    ids = ids.reshape(size, length)
    gold = np.array([[of[x] for x in tags] for _, tags in sequences])
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    hit = np.eye(k)[gold]
    for step in range(1, steps + 1):
        e = np.add.reduceat(w[found] * value[:, None], starts, axis=0)[ids]
        loss, pairs, post = expectations(e, t, gold)
        if loss / ids.size < settled:
            break
        miss = np.stack([np.bincount(ids.ravel(), (hit - post)[..., j].ravel(), len(vocabulary)) for j in range(k)], 1)
        grad_w = np.stack([np.bincount(found, miss[owner, j] * value, len(used)) for j in range(k)], 1) / size - l2 * w
        for x, g, m in ((w, grad_w, moments[0]), (t, (gold_pairs - pairs) / size, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    model.weight[used], model.transition = w, t
    return model


def expectations(e: np.ndarray, transition: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """By forward-backward over equally long sequences (n, length, k): the negative log-likelihood of the ``gold``
    tags, the expected number of each transition and each word's posterior."""
    n, length, k = e.shape
    top, high = e.max(-1, keepdims=True), transition.max()
    b, a = np.exp(e - top), np.exp(transition - high)
    alpha, beta = np.empty_like(b), np.ones_like(b)
    norm = b[:, 0].sum(-1, keepdims=True)
    alpha[:, 0] = b[:, 0] / norm
    partition = np.log(norm).sum() + top.sum() + high * n * (length - 1)
    for i in range(1, length):
        x = alpha[:, i - 1] @ a * b[:, i]
        norm = x.sum(-1, keepdims=True)
        alpha[:, i] = x / norm
        partition += np.log(norm).sum()
    pairs, rows = np.zeros((k, k)), max(1, BLOCK_NUMBERS // (k * k))
    for i in range(length - 2, -1, -1):
        nxt = b[:, i + 1] * beta[:, i + 1]
        x = nxt @ a.T
        beta[:, i] = x / x.sum(-1, keepdims=True)
        for at in range(0, n, rows):
            joint = alpha[at : at + rows, i, :, None] * a * nxt[at : at + rows, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    post = alpha * beta
    post /= post.sum(-1, keepdims=True)
    score = np.take_along_axis(e, gold[:, :, None], 2).sum() + transition[gold[:, :-1], gold[:, 1:]].sum()
    return float(partition - score), pairs, post


def posteriors(e: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Posterior of each word: ``e`` holds the emissions of texts of ``sizes`` words (each at least one), one after the other."""
    k, chunks = e.shape[1], -(-sizes // CHUNK)
    total = int(chunks.sum())
    first = np.cumsum(chunks) - chunks  # a text's first chunk
    row = np.repeat(first * CHUNK, sizes) + (np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    b = np.ones((total * CHUNK, k), np.float32)
    b[row] = np.exp(e - e.max(1, keepdims=True))
    real = np.zeros(total * CHUNK, bool)
    real[row] = True
    b, real = b.reshape(total, CHUNK, k), real.reshape(total, CHUNK)
    a = np.exp(transition - transition.max()).astype(np.float32)
    opens = np.zeros(total, bool)
    opens[first] = True
    same = np.eye(k, dtype=np.float32)
    enter = np.where(opens[:, None, None], same, a)  # into a chunk's first word
    m = enter * b[:, 0, None, :]
    for i in range(1, CHUNK):
        m = np.where(real[:, i, None, None], (m @ a) * b[:, i, None, :], m)
        m /= m.max((1, 2), keepdims=True)
    into, after = np.full((total, k), 1 / k, np.float32), np.ones((total, k), np.float32)
    order = np.argsort(-chunks, kind="stable")
    start, count = first[order], chunks[order]
    live = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right") if len(count) else []
    for i in range(1, len(live)):  # the i-th chunk of all texts that have one
        at = start[: live[i]] + i
        x = np.einsum("nk,nkj->nj", into[at - 1], m[at - 1])
        into[at] = x / x.sum(1, keepdims=True)
    for i in range(len(live) - 1, 0, -1):
        at = start[: live[i]] + i
        x = np.einsum("nkj,nj->nk", m[at], after[at])
        after[at - 1] = x / x.sum(1, keepdims=True)
    alpha = np.empty_like(b)
    x = np.einsum("nk,nkj->nj", into, enter) * b[:, 0]
    alpha[:, 0] = x / x.sum(1, keepdims=True)
    for i in range(1, CHUNK):
        x = np.where(real[:, i, None], (alpha[:, i - 1] @ a) * b[:, i], alpha[:, i - 1])
        alpha[:, i] = x / x.sum(1, keepdims=True)
    beta = after
    alpha[:, CHUNK - 1] *= beta
    for i in range(CHUNK - 2, -1, -1):
        x = np.where(real[:, i + 1, None], (b[:, i + 1] * beta) @ a.T, beta)
        beta = x / x.sum(1, keepdims=True)
        alpha[:, i] *= beta
    post = alpha.reshape(-1, k)[row]
    return post / post.sum(1, keepdims=True)


class Tagger:
    """Emissions by word, remembered over the texts of a worker."""

    def __init__(self, model: Crf):
        self.model, self.place, self.known = model, {}, np.zeros((0, len(model.languages)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.place) > CACHE:
            self.place, self.known = {}, self.known[:0]
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if new:
            parts = [self.model.emissions(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.known = np.concatenate([self.known, *parts])
        return self.known[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def tag(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the text, posteriors of its words) for the texts that have words."""
        at, words, sizes, places = 0, [], [], []
        slice_words = min(SLICE_WORDS, max(CHUNK, BLOCK_NUMBERS * CHUNK // len(self.model.languages) ** 2))
        for at, text in enumerate(texts):
            if found := letters(text or ""):
                words += found
                sizes.append(len(found))
                places.append(at)
            if len(words) >= slice_words or (at == len(texts) - 1 and words):
                post = posteriors(self.emissions(words), np.array(sizes), self.model.transition)
                yield from zip(places, np.split(post, np.cumsum(sizes)[:-1]), strict=True)
                words, sizes, places = [], [], []


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", docs_per_language: int = 500, windows_per_doc: int = 6, max_languages: int = 64, max_windows: int = 12_000, seed: int = 11) -> Crf | None:
    """Fit on labelled rows: at most ``docs_per_language`` different documents (id and text) of each
    language, those of the smallest hashes, and ``windows_per_doc`` windows of ``CHUNK`` words spread over
    each whole text. None if no labelled row has a word.

    The driver gets ``max_windows`` windows at most, so with many languages each has fewer documents. Only the ``max_languages``
    labels with most documents (by approximate number, then name) are learned, so a label column full of
    stray values can't grow the model; texts of other labels are predicted as one of these.

    A threshold on the hash, from the language's approximate number of different documents, leaves some
    thousand rows before any are ordered, and rows that repeat are one before that: no language and no
    repeated id gathers in one task. Only the three named columns are read.
    """
    h = F.xxhash64(F.col(id_column), F.col(text_column))
    rows = labelled.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), h.alias("h")).where("id is not null and lang is not null")
    counts = cut(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")))
    share = F.col("h") / F.lit(2.0**64) + 0.5  # of all hashes, so many are smaller
    found = counts.limit(max_languages + 1).count()
    if found > max_languages:
        counts, found = cut(counts.orderBy(F.desc("n"), "lang").limit(max_languages)), max_languages
    docs_per_language = max(1, min(docs_per_language, max_windows // (windows_per_doc * max(1, found))))
    near = rows.join(F.broadcast(counts), "lang").where(share * F.col("n") <= 3.0 * docs_per_language + 20)
    once = near.groupBy("lang", "h").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    best = Window.partitionBy("lang").orderBy("h")
    chosen = once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= docs_per_language)

    def cuts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for h, lang, text in zip(part["h"], part["lang"], part["text"], strict=True):
                words = letters(text or "")
                if words:
                    n = min(windows_per_doc, -(-len(words) // CHUNK))
                    for j in range(n):
                        a = (len(words) - CHUNK) * j // max(1, n - 1) if len(words) > CHUNK else 0
                        out.append((h, lang, j, (words * -(-CHUNK // len(words)))[a : a + CHUNK]))
            yield pd.DataFrame(out, columns=["h", "lang", "j", "words"])

    found = chosen.select("h", "lang", "text").mapInPandas(cuts, "h long, lang string, j int, words array<string>").collect()
    windows = [(r["lang"], list(r["words"])) for r in sorted(found, key=lambda r: (r["h"], r["lang"], r["j"]))]
    if not windows:
        return None
    rng, half = np.random.default_rng(seed), CHUNK // 2
    mates = rng.permutation(len(windows))
    sequences = []
    for i, (lang, words) in enumerate(windows):
        if i % 2:
            other, more = windows[mates[i]]
            sequences.append((words[:half] + more[half:], [lang] * half + [other] * (CHUNK - half)))
        else:
            sequences.append((words, [lang] * CHUNK))
    return train(sequences)


PREDICTED = "lang_pred string, score double, n_words long, word_langs array<long>"


def predict(docs: DataFrame, model: Crf | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, ``lang_pred``, ``score``, ``n_words`` and ``word_langs`` (words that each language wins, in the model's order).

    The prediction is the language with the largest mean posterior over the whole text's
    words, the smaller name on a tie; ``score`` is that mean. Text that is null or has no
    letter, or a model that never saw a label, gives ``und`` with score 0. Texts of any length are
    tagged whole; rows that repeat are each predicted, alike; an empty table gives no rows. Only the
    two named columns are read.
    """
    if model is None:
        return docs.select(id_column, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("word_langs"))
    modest_batches(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid4().hex

    @F.pandas_udf(PREDICTED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = worker_state(lambda k: Tagger(shared.value), key)
        names = tagger.model.languages
        for texts in parts:
            out: list[tuple] = [(UNKNOWN, 0.0, 0, [])] * len(texts)
            for at, post in tagger.tag(texts.tolist()):
                mean = post.mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                out[at] = (names[best], min(1.0, float(mean[best])), len(post), np.bincount(post.argmax(axis=1), minlength=len(names)).tolist())
            yield pd.DataFrame(out, columns=["lang_pred", "score", "n_words", "word_langs"])

    return docs.select(F.col(id_column), run(F.col(text_column)).alias("p")).select(id_column, "p.*")


def spans(docs: DataFrame, model: Crf, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Runs of words of one language: id, first_word, n_words, lang, by whole text; texts without words have none."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_column].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        for part in parts:
            out = []
            for at, post in tagger.tag(part["text"].tolist()):
                best = post.argmax(axis=1)
                starts = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
                for s, n in zip(starts.tolist(), np.diff(np.r_[starts, len(best)]).tolist(), strict=True):
                    out.append((part["id"].iloc[at], s, n, tagger.model.languages[best[s]]))
            yield pd.DataFrame(out, columns=["id", "first_word", "n_words", "lang"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInPandas(run, f"id {kind}, first_word long, n_words long, lang string").withColumnRenamed("id", id_column)
