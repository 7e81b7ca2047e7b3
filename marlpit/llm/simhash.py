"""SimHash near-duplicates with pigeonring filtering.

Two fingerprints of 64 bits link at ``radius`` or fewer differing bits. Their bits lie in a
ring of segments. By the pigeonring principle a linked pair has a segment from which every
chain of consecutive segments keeps within its proportional budget: a chain of l of m
segments differs in at most floor(l * radius / m) bits. With five segments and radius 2
the chains of one and two segments must be equal, those of three and four may differ in
one bit. Equal chains are join keys, the longer chains prune a pair before its full
distance is taken.

A key that many different fingerprints share is split by a further chain: over a longer
chain a pair differs in at most one bit, so of the segments that it adds to the equal ones
at least one is equal too. With five segments that makes keys of 38 bits instead of 26,
enough for 10^10 unrelated fingerprints. What is still crowded then are variants of one text, as thousands of
copies with a small change are; pairs would grow with their square, so here the method
differs from pigeonring filtering: fingerprints meet at the points half-way. Two fingerprints within 2 bits are
both within 1 bit of some 64-bit value, and all that are within 1 bit of one value are
within 2 of each other. A value has at most 65 such neighbours, each fingerprint names 65
values, and those at one value link to the smallest. That is exact, whatever the group's size.

``keep_first`` finds near-duplicates by the exact Jaccard similarity of their word shingles. Its
first candidates are the documents whose fingerprints meet in the same way; as 2 bits of 64
are too few for a similarity of 0.8, MinHash bands add those whose fingerprints lie further apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.llm import lines
from marlpit.llm.common import arrow_slices, cut, modest_batches, nothing, row_of, stored, worker_state
from marlpit.llm.graph import components

RADIUS, SEGMENTS, SHINGLE, SEED = 2, 5, 3, 42
#: ``keep_first``: words of a shingle, least Jaccard similarity, MinHash bands and their rows beside fingerprints. Bands miss 3 of 100,000 pairs at the threshold.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
#: A key of more fingerprints than this is split, and goes the way of half-way points if that does not help.
CROWD = 128


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprint of each text as unsigned 64-bit: a bit is set if over half the shingles' hashes have it."""
    parts, size = _hashed(texts, shingle, seed)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        bits = np.unpackbits(np.frombuffer(parts, np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, (np.cumsum(size) - size)[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * votes > size[full, None], axis=1).view(">u8").ravel()
    return out


def _hashed(texts: list[str | None], shingle: int, seed: int) -> tuple[bytes, np.ndarray]:
    """64-bit hashes of the shingles of all texts in order, and how many each text has."""
    import xxhash

    digest, parts, sizes = xxhash.xxh64_digest, [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
        if len(words) <= shingle:
            hashes = [digest(b" ".join(words), seed)] if words else []
        else:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: -shingle].tolist()]
            hashes = [digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        sizes.append(len(hashes))
        parts += hashes
    return b"".join(parts), np.array(sizes, np.int64)


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_state(nothing, "simhash")
        for part in parts:
            texts, found, at = part.tolist(), [np.zeros(0, np.uint64)], 0
            while at < len(texts):  # a million characters at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") < 1_000_000):
                    size += len(texts[end] or "")
                    end += 1
                found.append(fingerprints(texts[at:end], shingle, seed))
                at = end
            yield pd.Series(np.concatenate(found).view(np.int64))

    return run(text)


def hex_of(fingerprint: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fingerprint))), 16, "0")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def chain_masks(segments: int = SEGMENTS) -> list[list[int]]:
    """masks[i][l - 1]: the bits of the chain of l segments from segment i on."""
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    own = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(segments)]
    return [[sum(own[(i + j) % segments] for j in range(n)) for n in range(1, segments + 1)] for i in range(segments)]


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column ``fp``: within a connected group of
    linked fingerprints they connect everything, and each edge joins a linked pair. ``radius`` is 1 or 2."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks, budget = chain_masks(segments), [n * radius // segments for n in range(1, segments + 1)]
    equal, single = (max((n for n in range(1, segments + 1) if budget[n - 1] == b), default=0) for b in (0, 1))
    key = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(m[equal - 1]))).alias("bits")) for i, m in enumerate(masks)))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    within = F.lit(True)
    for n in range(equal + 1, segments):
        within &= F.bit_count(diff.bitwiseAND(F.element_at(F.array(*(F.lit(_signed(m[n - 1])) for m in masks)), F.col("i") + 1))) <= budget[n - 1]
    pairs, crowded = _met(fps.select("fp", F.explode(key).alias("key")), within & (F.bit_count(diff) <= radius), crowd)
    if single - equal > 1:  # with one differing bit in the segments added, another of them is equal
        longer = [F.struct("i", F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.element_at(F.array(*(F.lit(_signed(m[equal - 1] | masks[(i + j) % segments][0])) for i, m in enumerate(masks))), F.col("i") + 1)).alias("bits")) for j in range(equal, single)]
        more, crowded = _met(crowded.select("fp", F.explode(F.array(*longer)).alias("key")), within & (F.bit_count(diff) <= radius), crowd)
        pairs = pairs.unionByName(more)
    crowded = crowded.select("fp").distinct()
    one = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64)))
    if radius == 1:  # half-way points of one bit: the value with that bit cleared, told apart by the bit
        point = F.transform(one, lambda m, i: F.struct(F.col("fp").bitwiseAND(F.bitwise_not(m)).alias("value"), i.alias("bit")))
    else:
        point = F.transform(one, lambda m, i: F.struct(F.col("fp").bitwiseXOR(m).alias("value"), F.lit(0).alias("bit")))
    met = crowded.select("fp", F.explode(point).alias("point")).select("fp", "point.*")
    first = met.groupBy("value", "bit").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("value", "bit", "b")
    stars = met.join(first, ["value", "bit"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def _met(keyed: DataFrame, linked: Column, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of fingerprints with a key in common that are ``linked``, and (fp, i) of the keys of more than ``crowd``."""
    keyed = keyed.select("fp", "key.i", "key.j", "key.bits")
    counts = cut(keyed.groupBy("i", "j", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    shared = keyed.join(counts, ["i", "j", "bits"])
    small = shared.where(F.col("n") <= crowd)
    left, right = (small.select("i", "j", "bits", F.col("fp").alias(c)) for c in ("a", "b"))
    return left.join(right, ["i", "j", "bits"]).where("a < b").where(linked).select("a", "b"), shared.where(F.col("n") > crowd).select("fp", "i")


def near_duplicates(rows: DataFrame) -> DataFrame:
    """(fp, id, component) of each distinct fingerprint of a materialised table (id, fp): ``id`` is the
    smallest id with that fingerprint, ``component`` the smallest that links reach. Null ids never
    win against others; a fingerprint that only null ids have stays null until a link gives it one."""
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("id")))
    groups = components(links(classes.select("fp")))
    named = cut(groups.join(classes, groups.node == classes.fp).select("fp", "id", "component"))
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    reached = named.join(least, "component").select("fp", "least")
    return cut(classes.join(reached, "fp", "left").select("fp", "id", F.coalesce("least", "id").alias("component")))


def components_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, fp (signed long) and component (smallest id reachable) of each row.

    A null text counts as empty; texts without a word all have fingerprint 0 and link like
    others. Rows that repeat share a fingerprint. Only the two named columns are read.
    """
    modest_batches(docs.sparkSession)
    rows = cut(docs.select(F.col(id_column).alias("id"), fingerprint(F.col(text_column)).alias("fp")))
    found = rows.join(near_duplicates(rows).select("fp", "component"), "fp")
    return found.select(F.col("id").alias(id_column), "fp", "component")


def word_sets(texts: list[str | None], shingle: int = WORDS) -> list[np.ndarray]:
    """The different shingles of each text as sorted 64-bit hashes; a text of fewer words is one shingle."""
    parts, sizes = _hashed(texts, shingle, SEED)
    ends = np.cumsum(sizes)
    return [lines.distinct(x) for x in np.split(np.frombuffer(parts, ">u8").astype(np.uint64), ends[:-1])] if len(texts) else []


def set_fingerprint(hashes: np.ndarray) -> int:
    """Fingerprint of a set of shingles as a signed number."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _VOTES):
        votes += np.unpackbits(hashes[i : i + _VOTES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0])


_word_set = lines.Remembered(lambda text: word_sets([text])[0], lines.HELD_SHINGLES)


def word_jaccard(a: str, b: str) -> float:
    """Similarity of two texts as sets of word shingles; two texts without a word are equal."""
    x, y = _word_set(a), _word_set(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def word_similar(a: str, b: str, threshold: float) -> bool:
    return word_jaccard(a, b) >= threshold


def word_similar_pairs(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    return np.array([word_similar(x, y, threshold) for x, y in zip(a, b, strict=True)], bool)


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    held = word_sets(texts)
    return (np.concatenate(held) >> np.uint64(32)).astype(np.uint32), np.array([len(x) for x in held], np.int64)


#: Each permutation of 64-bit hashes: xor with one number, times an odd one.
_XOR, _ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_ODD |= np.uint64(1)
#: Hashes that are permuted at once.
_AT_ONCE = 1024
#: Hashes whose bits are counted at once; their number fits 16 bits.
_VOTES = 1 << 15


def word_bands(hashes: np.ndarray) -> np.ndarray:
    """Band values of a set of shingles: BANDS x ROWS permutations, each band mixes ROWS of their minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _AT_ONCE):
        np.minimum(least, ((hashes[i : i + _AT_ONCE, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = lines._mix(out * np.uint64(31) + least.reshape(BANDS, ROWS)[:, r])
    return out.view(np.int64)


def _banded(docs: DataFrame) -> DataFrame:
    """(id, mark, k1, k2, fp, bands) of the rows (id, mark, text); k1 and k2 are the halves of a 128-bit hash of a text's set of
    shingles, fp its fingerprint. A text without a word has neither fp nor bands."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        worker_state(nothing, "simhash")
        for part in arrow_slices(batches, "text", 1000, 1 << 20):
            sets = word_sets(part.column("text").to_pylist())
            keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            own = pa.array([word_bands(x) if len(x) else None for x in sets], pa.list_(pa.int64()))
            fps = pa.array([set_fingerprint(x) if len(x) else None for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), *map(pa.array, lines._halves(keys)), fps, own], names=["id", "mark", "k1", "k2", "fp", "bands"])

    return docs.mapInArrow(run, f"id {kind}, mark binary, k1 long, k2 long, fp long, bands array<long>")


def similar_sets(rows: DataFrame, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(k1, k2, component) of the sets in ``rows`` that are similar enough to another; ``docs`` has (mark, text).

    Candidates are those whose fingerprints links of pigeonring filtering connect, which make one bucket, and those that
    share a MinHash band. Buckets are handled as those of lines are, and only texts with a candidate are read again."""
    classes = cut(rows.where("fp is not null").groupBy("k1", "k2").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("mark").alias("mark")))
    groups = cut(components(links(cut(classes.select("fp").distinct()))))
    near = classes.join(groups, F.col("fp") == F.col("node"), "left").select(F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("band"), "k1", "k2")

    def texts_of(keys: DataFrame) -> DataFrame:
        wanted = cut(classes.join(keys, ["k1", "k2"], "left_semi").select("k1", "k2", "mark"))
        first = F.conv(F.hex(F.substring("mark", 1, 8)), 16, -10).cast("long")
        shared = lines.key_filter(wanted.select(first.alias("k1")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                if part.num_rows:
                    yield part.take(pa.array(lines.may_hold(shared.value, lines._halves(part.column("mark").to_pylist())[0])))

        return docs.mapInArrow(run, "mark binary, text string").join(wanted, "mark").select("k1", "k2", F.col("text").alias("line"))

    return lines.linked(classes.select("k1", "k2", "bands"), texts_of, threshold, (_word_hashes, word_similar_pairs), near)


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id (null ids last), with the columns of ``docs``.

    Two texts link if their sets of WORDS-word shingles have a Jaccard similarity of ``threshold`` or more, verified
    exactly for all whose fingerprints are within RADIUS bits and all that share a MinHash band;
    null and wordless texts link to each other. Whole texts count, whatever their length. Other columns
    stay as they are, whatever their names; of rows that repeat an id and text one stays. An empty table
    stays empty. Texts are shuffled once, to meet the row that stays; the rows before know them by hash.
    """
    modest_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    held = docs.select(row_of(docs).alias("row"), F.col(id_column).alias("id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("mark"))
    rows = stored(_banded(held.select("id", "mark", "text")))
    groups = similar_sets(rows, held.select("mark", "text"), threshold)
    place = F.struct(F.col("id").isNull().alias("o"), "id", "mark")
    classes = rows.groupBy("k1", "k2").agg(F.min(place).alias("place")).join(groups, ["k1", "k2"], "left")
    # a set without a link is a group by itself
    first = classes.groupBy("component", F.when(F.col("component").isNull(), F.struct("k1", "k2")).alias("own")).agg(F.min("place").alias("place"))
    stay = cut(first.select(F.col("place.id").alias("of"), F.col("place.mark").alias("of_mark")))
    met = held.join(stay, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left_semi")
    return met.groupBy("id", "mark").agg(F.first("row").alias("row")).select("row.*")
