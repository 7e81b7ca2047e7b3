"""Divergence between sources of a language, over terms that enough documents hold.

A first pass over the texts counts, for each (language, term), the documents that hold it in a
count-min sketch: every task emits only the cells that it touched, cells of a range meet in
one partition and are added up. Sums of cells never underestimate, so a term with a cell
below the threshold is impossible; what is left of the sketch is one bit a cell. A second
pass drops impossible terms while it counts and shuffles the others' counts, which are exact. The
counts are sparse: pairs of sources meet at terms that both hold, and all other terms' share of a
distance follows from how often each count occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import arrow_slices, cut

#: Documents that hold a kept term, at least; added to each count; the scale of shares; ranks of terms.
MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Rows of the sketch and cells of a range.
DEPTH, RANGE = 4, 1 << 16
#: A sketch row has 8 cells for each document between these bounds: its bits take 16 MB at most, whatever the
#: input. Beyond that it lets more impossible terms through, which exact counting then drops.
LEAST_WIDTH, MOST_WIDTH = 1 << 16, 1 << 25
BLOCK_ROWS, BLOCK_BYTES = 65536, 8 << 20
#: (language, source) groups for which the table of their sums is broadcast: at most a few MB.
FEW_GROUPS = 10_000
#: A separator of terms becomes a blank, A-Z lower case; all bytes of other characters stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def width_for(rows: int) -> int:
    """Cells of a sketch row, a power of two."""
    return min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (8 * max(rows, 1) - 1).bit_length()))


def _long_text(text: bytes) -> Counter:
    """Terms of a text that is larger than a block, a slice at a time."""
    found: Counter = Counter()
    rest, at = b"", 0
    while at < len(text):
        part = rest + text[at : at + BLOCK_BYTES].translate(_FOLD)
        at += BLOCK_BYTES
        end = part.rfind(b" ") + 1 if at < len(text) else len(part)
        rest = part[end:]
        found.update(part[:end].split())
    return found


def _rows(groups: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a block, and (group, term, documents, occurrences) for each group and term in it by their numbers."""
    if len(texts) == 1 and len(texts[0].as_py()) > BLOCK_BYTES:
        found = _long_text(texts[0].as_py())
        n = len(found)
        return pa.array(list(found), pa.binary()), np.zeros(n, np.int64) + groups[0].as_py(), np.arange(n), np.ones(n, np.int64), np.fromiter(found.values(), np.int64, n)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]].translate(_FOLD) if texts.buffers()[2] else b""
    folded = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(data))
    words = pc.ascii_split_whitespace(folded)
    doc = pc.list_parent_indices(words).to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(words.flatten())
    terms, term = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64)
    full = np.fromiter((len(t) > 0 for t in terms.to_pylist()), bool, len(terms))[term]  # ends of a text give empty words
    n = max(len(terms), 1)
    held, times = np.unique(doc[full] * n + term[full], return_counts=True)
    pairs, at, docs = np.unique(groups.to_numpy(zero_copy_only=False).astype(np.int64)[held // n] * n + held % n, return_inverse=True, return_counts=True)
    return terms, pairs // n, pairs % n, docs, np.bincount(at, times, len(pairs)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[str, str]], pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same for all blocks, with the (language, source) of each group number."""
    for rows in arrow_slices(batches, "text", BLOCK_ROWS, BLOCK_BYTES):
        names: dict[tuple[str, str], int] = {}
        of = [names.setdefault(x, len(names)) for x in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True)]
        yield (list(names), *_rows(pa.array(of, pa.int64()), rows.column("text").cast(pa.binary())))


def _cells(langs: list[str], lang: np.ndarray, terms: pa.Array, term: np.ndarray, width: int) -> np.ndarray:
    """Cells of (language, term) pairs, a row of them for each sketch row."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms.to_pylist()), np.uint64, len(terms))
    salt = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in langs), np.uint64, len(langs))
    with np.errstate(over="ignore"):
        h = (own[term] ^ salt[lang]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        first, step = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        return np.stack([((first + np.uint64(d) * step) % np.uint64(width)).astype(np.int64) + d * width for d in range(DEPTH)])


def _by_lang(names: list[tuple[str, str]], group: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, and the (language, term) pairs with the place of each row's pair."""
    langs: dict[str, int] = {}
    of = np.array([langs.setdefault(x, len(langs)) for x, _ in names], np.int64)
    pairs, at = np.unique(of[group] * max(n_terms, 1) + term, return_inverse=True)
    return list(langs), pairs // max(n_terms, 1), pairs % max(n_terms, 1), at


def possible_terms(docs: DataFrame, width: int, min_docs: int) -> bytes:
    """A bit for each cell of the merged sketch: whether at least ``min_docs`` documents of a language may hold its terms."""
    most = min(min_docs, 65535)  # cells stop there: a document's share beyond the threshold decides nothing

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, docs_in = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for names, terms, group, term, n_docs, _ in _blocks(batches):
            langs, lang, of, at = _by_lang(names, group, term, len(terms))
            held = np.bincount(at, n_docs, len(of)).astype(np.int64)
            found = _cells(langs, lang, terms, of, width).ravel()
            cells, where = np.unique(np.concatenate([cells, found]), return_inverse=True)
            docs_in = np.minimum(np.bincount(where, np.concatenate([docs_in, np.tile(held, DEPTH)]), len(cells)).astype(np.int64), most)
        starts = np.flatnonzero(np.diff(cells // RANGE, prepend=-1))
        for a, b in zip(starts, np.append(starts, len(cells))[1:], strict=True):
            yield pa.RecordBatch.from_pydict({"part": pa.array([cells[a] // RANGE], pa.int32()), "cells": [(cells[a:b] % RANGE).astype("<u2").tobytes()], "docs": [docs_in[a:b].astype("<u2").tobytes()]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held = total.setdefault(row["part"], np.zeros(RANGE, np.uint16))
                at = np.frombuffer(row["cells"], "<u2")  # each once
                held[at] = np.minimum(held[at].astype(np.int64) + np.frombuffer(row["docs"], "<u2"), most)
        for part, held in total.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": [np.packbits(held >= most).tobytes()]})

    rows = docs.mapInArrow(touched, "part int, cells binary, docs binary").repartition("part").mapInArrow(merged, "part int, bits binary")
    bits = bytearray(DEPTH * width // 8)
    for row in rows.toLocalIterator():
        bits[row["part"] * RANGE // 8 : (row["part"] + 1) * RANGE // 8] = row["bits"]
    return bytes(bits)


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, width: int | None = None) -> DataFrame:
    """(lang, source, term, times, lang_times) of the terms that at least ``min_docs`` documents of their language hold.

    ``docs`` has string columns lang, source and text without nulls. Counts are exact.
    """
    width = width or width_for(docs.count())
    if width % (RANGE // DEPTH) or width & (width - 1):
        raise ValueError("the width must be a power of two of at least 16384")
    bits = docs.sparkSession.sparkContext.broadcast(possible_terms(docs, width, min_docs))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(bits.value, np.uint8)
        for names, terms, group, term, n_docs, times in _blocks(batches):
            langs, lang, of, at = _by_lang(names, group, term, len(terms))
            cells = _cells(langs, lang, terms, of, width)
            stays = np.flatnonzero(((seen[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=0)[at])
            column = lambda i: pa.DictionaryArray.from_arrays(group[stays], pa.array([x[i] for x in names], pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_pydict({"lang": column(0), "source": column(1), "term": terms.take(pa.array(term[stays])).cast(pa.string()), "docs": n_docs[stays], "times": times[stays]})

    rows = docs.mapInArrow(survivors, "lang string, source string, term string, docs long, times long")
    # rows are combined by block already: one shuffle by (lang, term) serves all three steps
    exact = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))
    whole = Window.partitionBy("lang", "term")
    held = exact.withColumns({"lang_docs": F.sum("docs").over(whole), "lang_times": F.sum("times").over(whole)})
    return held.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "times", "lang_times")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), without a rounding or an overflow."""
    return F.expr(f"1 + ((cast({count} as decimal(20,0)) + {SMOOTHING}) * {SCALE}) div ({total} + {SMOOTHING} * {terms})")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, width: int | None = None) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): each source's distance to the other sources of its language, and its
    most over-used terms.

    A null text, lang or source counts as ''; documents that repeat count each; texts are read whole, those beyond a
    block in slices; a language without kept terms has distances of 0 and no terms. Equal values rank by the item's bytes. Only the
    three named columns are read. An empty table gives no rows.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = cut(term_counts(docs, min_docs, width))
    named = docs.select("lang", "source").distinct()
    in_group = kept.groupBy("lang", "source").agg(F.sum("times").alias("total"), F.count("*").alias("held"))
    of_lang = kept.groupBy("lang", "term").agg(F.first("lang_times").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    groups = named.join(in_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0)
    groups = cut(groups.withColumn("base", F.when(F.col("terms") > 0, _share("0", "total", "terms"))))
    small = F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups

    shares = kept.join(small, ["lang", "source"]).withColumn("p", _share("times", "total", "terms"))
    over = shares.withColumn("q", _share("lang_times", "lang_total", "terms")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))

    other = small.select("lang", F.col("source").alias("item"), F.col("held").alias("other_held"), F.col("base").alias("other_base"))
    # terms that neither holds, as if no term were held by both
    rest = groups.join(other, "lang").where("source != item").select("lang", "source", "item", F.when(F.col("terms") > 0, (F.col("terms") - F.col("held") - F.col("other_held")) * F.abs(F.col("base") - F.col("other_base"))).otherwise(0).alias("value"))
    # terms that one holds, against the share of a term that the other lacks: by how often each share occurs
    each = shares.groupBy("lang", "source", "p").count()
    alone = each.join(other, "lang").where("source != item").groupBy("lang", "source", "item").agg(F.sum(F.col("count") * F.abs(F.col("p") - F.col("other_base"))).alias("value"))
    # terms that both hold: their distance in the place of what the other two have counted
    side = lambda s: shares.select("lang", "term", F.col("source").alias(f"{s}_source"), F.col("p").alias(f"{s}_p"), F.col("base").alias(f"{s}_base"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = side("a").join(side("b"), ["lang", "term"]).where("a_source < b_source").groupBy("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"))
    both = both.agg(F.sum(gap("a_p", "b_p") - gap("a_p", "b_base") - gap("a_base", "b_p") + gap("a_base", "b_base")).alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    mirrored = alone.unionByName(both).select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")
    pairs = rest.unionByName(mirrored).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", place()).unionByName(over.withColumn("rank", place()).where(F.col("rank") <= top))
