"""Fuzzy line dedup by MinHash.

Lines of at least ``MIN_CHARS`` characters, in lower case and with runs of blanks as one
space, take part. Those under ``SHINGLE`` characters repeat only as equal lines; the others
are sets of character shingles. One permutation hash fills a signature of BANDS x
ROWS bins, empty bins borrow from others by a fixed draw (optimal densification), and lines
that agree in a whole band are candidates: at the threshold 99 of 100 pairs are. Equal
lines are one before that. Candidates are verified by exact Jaccard similarity over whole
lines, verified pairs are the edges of a distributed union-find, and of each component
the line that comes first stays.

A bucket of lines that share a band value is not paired out. Links are found in two steps.
First each of its lines is held against four leaders: the line that collides most in all
bands, which the source of a family of variants does, the bucket's smallest, and the ones
that collide most among those that share its lowest or its highest band too. That is
linear in the lines and links nearly all that belongs together. Then every bucket that
still has several components is settled exactly: its lines outside its largest component
meet all its others, in blocks of some hundred lines by some hundred lines dealt to tasks
of their own, and a block counts common shingles by an index instead of pair by pair. A
bucket with thousands of lines outside, as lines of one template that are no variants of
each other make, is first parted by an exact prefix filter: its shingles are ordered by
their frequency in it, and two lines can only be similar if they share one of the rarest
fifth of their shingles. So components are those of all candidate pairs, whatever a bucket's size.

No step takes a bucket into one task: shared bands are found among rows dealt by band, but
for the lines of a band that many of some ten thousand lines share, which are dealt by line,
and what is summed up by bucket meets its lines in joins that adaptive execution splits.
Lines are known by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import arrow_slices, cut, forgotten_with_state, modest_batches, nothing, row_of, stored, worker_state
from marlpit.llm.graph import components

SHINGLE, BANDS, ROWS, THRESHOLD, MIN_CHARS = 7, 9, 4, 0.8, 6
#: A side of a block that is compared at once has about so many lines, or so many characters if that is fewer lines.
BLOCK, BLOCK_CHARS = 256, 1 << 19
#: A bucket with more lines outside its largest component than so many blocks hold is parted by rare shingles.
OUTSIDE = 16
#: Common shingles, and pairs of lines, that are counted at once.
COMMON = 1 << 19
#: Edges that a task of the union-find takes at least.
EDGES = 50_000
#: Lines that a task remembers to ship the bands of equal ones once.
REMEMBERED = 300_000
#: The filter that fetches candidate texts has eight bits for each key, and 2 to the power of these at least and at most: 1 to 16 MB.
FILTER_BITS = (23, 27)
#: Shingles that a worker remembers, and characters from which a text's are not sets of strings and a pair is compared by itself.
HELD_SHINGLES, LONG = 1 << 20, 1 << 16
#: Characters whose signatures are made, or whose pairs are compared, at once.
RUN = 1 << 16
#: Band values that a task deals out at once, and how many of these may be one band's that are dealt by band.
DEALT, HOT = 1 << 18, 64
_EMPTY = np.uint32(0xFFFFFFFF)
#: White space besides the blank and the end of line.
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def normal(line: str) -> str:
    return " ".join(line.split()).lower()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def _borrowed(bins: int) -> np.ndarray:
    """borrowed[t, bin]: where an empty bin looks at its t-th try."""
    t, b = np.meshgrid(np.arange(8 * bins, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (_mix(t * np.uint64(1009) + b + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


def _runs(lines: list[str]) -> Iterator[list[str]]:
    """``lines`` in order, in lists of about RUN characters: so much work stays in a processor's cache."""
    for first, end in _run_ends(list(map(len, lines))):
        yield lines[first:end]


def _run_ends(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= RUN:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def bands(lines: list[str], shingle: int = SHINGLE, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band values (lines, bands) of normal lines of at least ``shingle`` characters."""
    parts = [_bands(part, shingle, count, rows) for part in _runs(lines)]
    return np.concatenate(parts) if parts else np.zeros((0, count), np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, ascending. Sorting numbers takes a part of the time of numpy's unique, which hashes them."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _shingle_hashes(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of all lines in order, and how many each line has."""
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    span = 1
    while span < shingle:  # hashes of two overlapping or touching runs make that of a run up to twice as long
        step = min(span, shingle - span)
        longer = h[:-step] * np.uint32(0x9E3779B1 + 2 * step)
        longer ^= longer >> np.uint32(15)
        longer += h[step:]
        longer *= np.uint32(0x85EBCA6B)
        longer ^= longer >> np.uint32(13)
        h, span = longer, span + step
    return h[_inside(len(h), sizes, shingle)], sizes - shingle + 1


def _inside(n: int, sizes: np.ndarray, shingle: int) -> np.ndarray:
    """Whether the shingle at each of n starts lies in one line, not in two."""
    inside = np.ones(n, bool)
    if shingle > 1:
        inside[(np.cumsum(sizes)[:-1, None] - np.arange(1, shingle)).ravel()] = False
    return inside


def _bands(lines: list[str], shingle: int, count: int, rows: int) -> np.ndarray:
    bins = count * rows
    h, n = _shingle_hashes(lines, shingle)
    place = h * np.uint32(0xC2B2AE35)
    place >>= np.uint32(16)
    place *= np.uint32(bins)
    place >>= np.uint32(16)
    place += np.repeat((np.arange(len(lines)) * bins).astype(np.uint32), n)
    h = h * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    sig = np.full(len(lines) * bins, _EMPTY, np.uint32)
    np.minimum.at(sig, place.astype(np.int64), h)
    sig = sig.reshape(-1, bins)
    row, col = np.nonzero(sig == _EMPTY)
    filled = sig.copy()
    for tries in _borrowed(bins):
        if not len(row):
            break
        found = sig[row, tries[col]]
        filled[row, col] = found
        row, col = row[found == _EMPTY], col[found == _EMPTY]
    out = np.zeros((len(lines), count), np.uint64)
    for r in range(rows):
        out = _mix(out * np.uint64(31) + filled[:, r::rows][:, :count] + np.uint64(r))
    return (out * np.uint64(count) + np.arange(count, dtype=np.uint64)).view(np.int64)


def _keys(lines: list[str]) -> list[bytes]:
    """128 bits of each line."""
    import xxhash

    return list(map(xxhash.xxh3_128_digest, lines))


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


class _Once:
    """Tells which keys are new to a task. It forgets all when full, so a key may count as new again, never the other way."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()

    def new(self, keys: list[bytes]) -> list[int]:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        out = []
        for i, k in enumerate(keys):
            if k not in self.seen:
                self.seen.add(k)
                out.append(i)
        return out


def _identified(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _taking_part(text: str) -> Iterator[tuple[int, str]]:
    plain = "  " not in text and not any(c in text for c in _BLANKS)  # its lines are normal but for blanks at the ends
    for j, line in enumerate(text.lower().split("\n")):
        line = line.strip(" ") if plain else " ".join(line.split())
        if len(line) >= MIN_CHARS:
            yield j, line


def _lines(docs: DataFrame) -> DataFrame:
    """(id, mark, line, n_lines, k1, k2, bands): a row with line -1 for each row of ``docs`` and one for
    each line that takes part, with bands, as the bytes of longs, for the first of equal ones in a task."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(nothing, "lines")
        once = _Once()
        for part in arrow_slices(batches, "text", 2000, 2 << 20):
            doc, place, held, heads = [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                heads.append(text.count("\n") + 1)
                for j, line in _taking_part(text):
                    doc.append(i), place.append(j), held.append(line)
            none = pa.nulls(len(heads), pa.int64())
            own = [part.column("id"), part.column("mark"), pa.array(np.full(len(heads), -1)), pa.array(heads, pa.int64()), none, none, pa.nulls(len(heads), pa.binary())]
            yield pa.RecordBatch.from_arrays(own, names=["id", "mark", "line", "n_lines", "k1", "k2", "bands"])
            if held:
                at, keys = pa.array(doc, pa.int64()), _keys(held)
                new = np.array([i for i in once.new(keys) if len(held[i]) >= SHINGLE], np.int64)
                has = np.zeros(len(held), bool)
                has[new] = True
                values = bands([held[i] for i in new.tolist()]).ravel() if len(new) else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(has * (8 * BANDS))]).astype(np.int32)
                coded = pa.Array.from_buffers(pa.binary(), len(held), [pa.array(has).buffers()[1], pa.py_buffer(ends), pa.py_buffer(values)])
                k1, k2 = _halves(keys)
                cols = [part.column("id").take(at), part.column("mark").take(at), pa.array(place, pa.int64()), pa.nulls(len(held), pa.int64()), pa.array(k1), pa.array(k2), coded]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "mark", "line", "n_lines", "k1", "k2", "bands"])

    return docs.mapInArrow(run, f"id {kind}, mark long, line long, n_lines long, k1 long, k2 long, bands binary")


def key_filter(keys: DataFrame, name: str = "k1"):
    """A broadcast filter over the long keys in column ``name``, for ``may_hold``; it has at most 2 ** FILTER_BITS[1] bits."""
    bits = min(max((8 * keys.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    bit = F.col(name).bitwiseAND(F.lit((1 << bits) - 1))
    held = keys.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("b")).toPandas()
    mask = np.zeros(1 << (bits - 6), np.uint64)
    mask[held["w"].to_numpy(np.int64)] = held["b"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(mask)


def may_hold(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that the filter lets pass: all that it was made of, and some others."""
    bits = keys.view(np.uint64) & np.uint64(64 * len(mask) - 1)
    return np.flatnonzero(mask[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63)) & np.uint64(1))


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(k1, k2, line) of the lines with one of the ``keys``, and of some others: a filter of key bits drops
    most lines where they are read. It has room for 16 million keys; beyond that more lines are shuffled."""
    shared = key_filter(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for part in arrow_slices(batches, "text", 2000, 2 << 20):
            held = [line for text in part.column("text").to_pylist() for _, line in _taking_part(text) if len(line) >= SHINGLE]
            if held:
                keys = _keys(held)
                k1, k2 = _halves(keys)
                hit = may_hold(shared.value, k1)
                hit = hit[once.new([keys[i] for i in hit.tolist()])]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(k1[hit]), pa.array(k2[hit]), pa.array([held[i] for i in hit.tolist()], pa.string())], names=["k1", "k2", "line"])

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, line string")


class Remembered:
    """What ``make`` gives for texts, as long as it has no more than ``limit`` parts in all."""

    def __init__(self, make: Callable[[str], frozenset | np.ndarray], limit: int):
        self.make, self.limit = make, limit
        self.forget()
        forgotten_with_state(self.forget)

    def forget(self) -> None:
        self.held, self.total = {}, 0

    def __call__(self, text: str):
        if (found := self.held.get(text)) is None:
            found = self.make(text)
            if self.total + len(found) > self.limit:
                self.forget()
            if len(found) <= self.limit // 4:
                self.held[text] = found
                self.total += len(found)
        return found


def shingles(line: str) -> frozenset[str]:
    return frozenset([line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)])


_shingles = Remembered(shingles, HELD_SHINGLES)


def _long_shingles(line: str) -> np.ndarray:
    """The shingles of a long line as sorted rows of code points: a fifth of the memory of a set."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    runs = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, SHINGLE))
    return np.unique(runs.view(f"V{4 * SHINGLE}").ravel())


def jaccard(a: str, b: str) -> float:
    """Similarity of two normal lines as sets of shingles."""
    if len(a) > LONG or len(b) > LONG:
        x, y = _long_shingles(a), _long_shingles(b)
        both = len(np.intersect1d(x, y, assume_unique=True))
    else:
        x, y = _shingles(a), _shingles(b)
        both = len(x & y)
    return both / (len(x) + len(y) - both)


def _line_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return _shingle_hashes(lines, SHINGLE)


def _common_start(a: str, b: str) -> int:
    """How many characters the two begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def similar(a: str, b: str, threshold: float) -> bool:
    """Whether the similarity of two normal lines reaches the threshold, often without the second one's set: it
    has as many shingles as common ones at least and as places for them at most."""
    if len(a) > LONG or len(b) > LONG:
        return jaccard(a, b) >= threshold
    x, places = _shingles(a), len(b) - SHINGLE + 1
    if places < threshold * len(x):
        return False
    # only shingles that reach out of the common start and end can be in one of the two alone
    start = _common_start(a, b)
    same = start + _common_start(a[start:][::-1], b[start:][::-1])
    if len(x) - (len(a) - same + SHINGLE - 1) >= threshold * (len(x) + len(b) - same + SHINGLE - 1):
        return True
    own = [b[i : i + SHINGLE] for i in range(places)]
    both = len(x.intersection(own))
    if both < threshold * len(x):
        return False
    if both >= threshold * (len(x) + places - both):
        return True
    return both / (len(x) + len(set(own)) - both) >= threshold


def _similar(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    both_of = [line for pair in zip(a, b, strict=True) for line in pair]
    codes = np.frombuffer("".join(both_of).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.zeros(int(codes.max()) + 1, bool)
    letters[codes] = True
    rank = np.cumsum(letters).astype(np.uint64) - np.uint64(1)
    bits = max(1, int(rank[-1]).bit_length())
    if SHINGLE * bits + (2 * len(a) - 1).bit_length() > 64:  # fewer pairs have fewer letters
        half = len(a) // 2
        return np.concatenate([_similar(a[:half], b[:half], threshold), _similar(a[half:], b[half:], threshold)]) if half else np.array([similar(a[0], b[0], threshold)])
    h, span = rank[codes], 1
    while span < SHINGLE:  # the letters of a shingle, bit by bit: different shingles have different numbers
        step = min(span, SHINGLE - span)
        h, span = h[:-step] << np.uint64(bits * step) | h[step:] & np.uint64((1 << bits * step) - 1), span + step
    sizes = np.fromiter(map(len, both_of), np.int64, len(both_of))
    side = np.repeat(np.arange(len(both_of), dtype=np.uint64), sizes - SHINGLE + 1)
    above = np.uint64(SHINGLE * bits + 1)
    own = distinct(side >> np.uint64(1) << above | h[_inside(len(h), sizes, SHINGLE)] << np.uint64(1) | side & np.uint64(1))
    pair = (own >> above).astype(np.int64)
    own >>= np.uint64(1)
    both = np.bincount(pair[1:][own[1:] == own[:-1]], minlength=len(a))
    return both / (np.bincount(pair, minlength=len(a)) - both) >= threshold


def similar_pairs(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """Whether the similarity of each two normal lines reaches the threshold, exactly. The shingles of many pairs are
    numbers that one sort brings together; texts that are long are compared by themselves."""
    out = np.zeros(len(a), bool)
    short = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if len(x) <= LONG and len(y) <= LONG]
    if len(short) < len(a):
        for i in set(range(len(a))).difference(short):
            out[i] = similar(a[i], b[i], threshold)
    for first, end in _run_ends([len(a[i]) + len(b[i]) for i in short]):
        at = short[first:end]
        out[at] = _similar([a[i] for i in at], [b[i] for i in at], threshold)
    return out


#: How texts are compared: 32-bit hashes of their shingles with the number of each, and which of many pairs are similar, exactly.
Measure = tuple[Callable[[list[str]], tuple[np.ndarray, np.ndarray]], Callable[[list[str], list[str], float], np.ndarray]]
OF_LINES: Measure = (_line_hashes, similar_pairs)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, measure: Measure = OF_LINES) -> DataFrame:
    """The rows with line keys a and b whose lines are similar enough. Pairs with a long text are handed to Python one by one."""

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        worker_state(nothing, "lines")
        return pd.Series(measure[1](a.tolist(), b.tolist(), threshold), dtype=bool)

    def one(pair: pd.DataFrame) -> pd.DataFrame:
        first = pair.iloc[:1]
        return first[["a", "b"]][measure[1](first["a_line"].tolist(), first["b_line"].tolist(), threshold)]

    left, right = (texts.select(F.col("k").alias(c), F.col("line").alias(f"{c}_line"), F.col("size").alias(f"{c}_size")) for c in ("a", "b"))
    sized = stored(pairs.join(right.select("b", "b_size"), "b").join(left.select("a", "a_size"), "a")) if texts.where(F.col("size") > LONG).limit(1).count() else None
    short = pairs if sized is None else sized.where(F.greatest("a_size", "b_size") <= LONG).select("a", "b")
    met = short.join(right, "b").join(left, "a")  # rows of one a, mostly a bucket's leader, come together
    found = met.where(verified("a_line", "b_line")).select("a", "b")
    if sized is None:
        return found
    large = sized.where(F.greatest("a_size", "b_size") > LONG).select("a", "b").join(right, "b").join(left, "a")
    return found.unionByName(large.groupBy("a", "b").applyInPandas(one, "a long, b long"))


def candidate_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) to verify first, from the buckets (band, k, n) of more than one line."""
    about = shared.groupBy("k").agg(F.sum("n").alias("degree"), F.min("band").alias("lo"), F.max("band").alias("hi"))
    held = stored(shared.join(about, "k"))
    one = F.struct("degree", "k")
    lead = cut(held.groupBy("band").agg(F.array(F.max(one), F.min_by(one, "k")).alias("leaders")))
    found = held.select("band", one.alias("y")).join(lead, "band").select(F.explode("leaders").alias("x"), "y")
    for near in ("lo", "hi"):
        lead = held.groupBy("band", near).agg(F.max(one).alias("x"), F.count("*").alias("of")).where("of > 1").drop("of")
        found = found.unionByName(held.select("band", near, one.alias("y")).join(lead, ["band", near]).select("x", "y"))
    # the end with more collisions goes first, so that a leader's pairs are verified one after the other
    return found.where("x.k <> y.k").select(F.greatest("x", "y")["k"].alias("a"), F.least("x", "y")["k"].alias("b")).distinct()


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (band, i, j) of sorted batches, or of several while they are small, which column ``block`` numbers."""
    held, last, block, rows, size = [], None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")], axis=1)
        length = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("line")).to_numpy())])
        at = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            if held and (key[a] != last).any():
                block += 1
                if rows >= 2 * BLOCK or size >= BLOCK_CHARS:
                    yield pa.Table.from_batches(held)
                    held, rows, size = [], 0, 0
            part = batch.slice(a, b - a)
            held.append(pa.RecordBatch.from_arrays([*(part.column(c) for c in ("left", "line", "c")), pa.array(np.full(b - a, block))], names=["left", "line", "c", "block"]))
            rows, size, last = rows + b - a, size + int(length[b] - length[a]), key[a]
    if held:
        yield pa.Table.from_batches(held)


def _indexed(lines: list[str], measure: Measure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes of each line's shingles: the lines' places, the hashes, and how many each line has."""
    h, n = measure[0](lines)
    own = distinct(np.repeat(np.arange(len(lines), dtype=np.uint64), n) << np.uint64(32) | h)
    owner = (own >> np.uint64(32)).astype(np.int64)
    return owner, (own & np.uint64(0xFFFFFFFF)).astype(np.int64), np.bincount(owner, minlength=len(lines))


def block_links(left: list[str], right: list[str], left_groups: list, right_groups: list, threshold: float, measure: Measure = OF_LINES, left_blocks=None, right_blocks=None) -> list[tuple]:
    """Links between groups of lines: for all similar pairs of a left and a right line they connect the two lines' groups.

    An index of the right lines' shingles gives many left lines' common ones with all of them at
    once, by hash; what is near the threshold or above it is compared exactly. Only lines of one
    block meet: blocks are given as ascending numbers, or all is one.
    """
    if not left or not right:
        return []
    parent: dict = {}

    def root(c):
        while (up := parent.get(c, c)) != c:
            c = up
        return c

    of_left, of_right = (np.zeros(len(x), np.int64) if blocks is None else np.asarray(blocks, np.int64) for x, blocks in ((left, left_blocks), (right, right_blocks)))
    owner, h, sizes = _indexed(right, measure)
    key = of_right[owner] << 32 | h
    order = np.argsort(key, kind="stable")
    owner, key = owner[order], key[order]
    mine, h, left_sizes = _indexed(left, measure)
    h |= of_left[mine] << 32
    first = np.searchsorted(key, h)
    n = np.searchsorted(key, h, "right") - first
    upto, ends = np.concatenate([[0], np.cumsum(n)]), np.searchsorted(mine, np.arange(len(left) + 1))
    base = np.searchsorted(of_right, of_left)
    width = int((np.searchsorted(of_right, of_left, "right") - base).max())
    groups, found, at = (np.asarray(left_groups), np.asarray(right_groups)), [], 0
    while at < len(left) and width:
        end = int(np.searchsorted(upto[ends], upto[ends[at]] + COMMON, "right")) - 1
        end = min(max(end, at + 1), at + max(1, COMMON // width), len(left))
        a, b = ends[at], ends[end]
        places = np.repeat(first[a:b] - (upto[a:b] - upto[a]), n[a:b]) + np.arange(upto[b] - upto[a])
        line = np.repeat(mine[a:b], n[a:b])
        both = np.bincount((line - at) * width + owner[places] - base[line])
        met = np.flatnonzero(both)
        both, x = both[met], met // width + at
        y = met % width + base[x]
        near = (both >= (threshold - 0.02) * (left_sizes[x] + sizes[y] - both)) & (groups[0][x] != groups[1][y])
        rest = list(zip(x[near].tolist(), y[near].tolist(), strict=True))
        while rest:  # one pair of each left group at a time: what it links need not be compared any more
            now, later = {}, []
            for i, j in rest:
                if (a := root(left_groups[i])) != root(right_groups[j]) and now.setdefault(a, (i, j)) != (i, j):
                    later.append((i, j))
            fits = measure[1]([left[i] for i, _ in now.values()], [right[j] for _, j in now.values()], threshold)
            for (i, j), fit in zip(now.values(), fits, strict=True):
                if fit and (a := root(left_groups[i])) != (b := root(right_groups[j])):
                    parent[max(a, b)] = min(a, b)
                    found.append((left_groups[i], right_groups[j]))
            rest = later
        at = end
    return found


def _unsettled(named: DataFrame) -> DataFrame:
    """(band, main, rows, columns) of the buckets with several components: the largest, and the blocks that its
    other lines and all its lines make."""
    held = named.groupBy("band", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    buckets = held.groupBy("band").agg(F.count("*").alias("groups"), F.max(F.struct("n", "c", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("groups > 1")
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_CHARS), F.lit(1)).cast("int")
    return cut(buckets.select("band", F.col("top.c").alias("main"), parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("rows"), parts(F.col("n"), F.col("size")).alias("columns")))


def _by_rare_shingles(named: DataFrame, texts: DataFrame, threshold: float, measure: Measure) -> DataFrame:
    """The rows (band, k, c, size) dealt anew: a bucket's lines that share one of their rarest shingles, by its
    frequency in the bucket, make a bucket. Two sets with a Jaccard similarity of t share t of the larger
    one, so they meet in the rarest of what is left; hashes count as shingles, hence a margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(nothing, "lines")
        for part in arrow_slices(batches, "line", 1000, 1 << 20):
            h, n = measure[0](part.column("line").to_pylist())
            owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), n)
            own = distinct(owner << np.uint64(32) | h)
            ends = np.searchsorted(own, np.arange(part.num_rows + 1, dtype=np.uint64) << np.uint64(32))
            values = pa.array((own & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("band", "k", "c", "size")), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=["band", "k", "c", "size", "hashes"])

    held = stored(named.join(texts.select("k", "line"), "k").select("band", "k", "c", "size", "line").mapInArrow(run, "band long, k long, c long, size long, hashes array<int>"))
    each = held.select("band", "k", F.explode("hashes").alias("h"))
    often = each.groupBy("band", "h").agg(F.count("*").alias("n"))
    placed = stored(each.join(often, ["band", "h"]).groupBy("band", "k").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("order")))
    size = F.size("order")
    rare = F.filter(F.slice("order", 1, size - F.ceil((threshold - 0.02) * size).cast("int") + 1), lambda x: x["n"] > 1)
    fine = placed.select("band", "k", F.explode(rare).alias("x")).join(held.select("band", "k", "c", "size"), ["band", "k"])
    return fine.select(F.xxhash64("band", "x.h").alias("band"), "k", "c", "size")


def remaining_links(shared: DataFrame, groups: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, measure: Measure = OF_LINES) -> DataFrame:
    """Links (a, b) between components, from all pairs of lines that share a bucket and are in different ones.

    ``groups`` (node, component) is what links found so far make of the lines; a line
    without a row is a component by itself. A bucket of two lines is settled already.
    """
    named = shared.where("n > 2").join(groups, F.col("k") == F.col("node"), "left").select("band", "k", F.coalesce("component", "k").alias("c"))
    named = stored(named.join(texts.select("k", F.col("size").cast("long")), "k"))
    buckets = _unsettled(named)
    crowded = buckets.where(F.col("rows") > OUTSIDE).select("band")
    if crowded.limit(1).count():
        fine = _by_rare_shingles(named.join(crowded, "band", "left_semi"), texts, threshold, measure)
        named = stored(named.join(crowded, "band", "left_anti").unionByName(fine, allowMissingColumns=False).select("band", "k", "c", "size"))
        buckets = _unsettled(named)
    at = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    right = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), at("columns").alias("j"), F.lit(False).alias("left")))
    left = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(at("rows").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    dealt = named.join(buckets, "band").select("band", "k", "c", F.when(F.col("c") == F.col("main"), right).otherwise(F.concat(right, left)).alias("to"))
    rows = dealt.join(texts.select("k", "line"), "k").select("band", F.explode("to").alias("to"), "c", "line").select("band", "to.*", "c", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(nothing, "lines")
        for block in _whole_blocks(batches):
            isleft = block.column("left")
            (left, left_c, left_of), (right, right_c, right_of) = ([side.column(x).to_pylist() for x in ("line", "c", "block")] for side in (block.filter(isleft), block.filter(pc.invert(isleft))))
            if found := block_links(left, right, left_c, right_c, threshold, measure, left_of, right_of):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    met = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return met.mapInArrow(run, "a long, b long")


def _band_rows(batch: pa.RecordBatch) -> np.ndarray:
    """(band, k1, k2) of the bands, a list or its bytes, in each row of the batch."""
    bands = batch.column("bands")
    if pa.types.is_list(bands.type):
        values, n = bands.flatten().to_numpy(), pc.list_value_length(bands).to_numpy()
    else:
        values, n = np.frombuffer(b"".join(bands.to_pylist()), np.int64), pc.binary_length(bands).to_numpy() // 8
    return np.stack([values, *(np.repeat(batch.column(c).to_numpy(), n) for c in ("k1", "k2"))], axis=1)


def _runs_of(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and how long they are."""
    first = np.flatnonzero(np.r_[True, band[1:] != band[:-1]]) if len(band) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(band)))


_PLAIN, _HOT_ROWS, _HOT_BANDS = range(3)


def _dealt(rows: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, kind, rows) of the rows (band, k1, k2) that go to each part: by band, and those of a band with more than
    HOT of them by band and key. For a hot band, one row tells the others of the band."""
    place = _mix(rows[:, 0].view(np.uint64))
    order = np.argsort(place)
    rows, place = rows[order], place[order]
    first, n = _runs_of(place)
    hot = n > HOT
    kinds = [(_PLAIN, rows, place)]
    if hot.any():
        own = np.repeat(hot, n)
        many, told = rows[own], first[hot]
        by_key = _mix(place[own] ^ _mix(many[:, 1].view(np.uint64)))
        order = np.argsort(by_key)
        kinds = [(_PLAIN, rows[~own], place[~own]), (_HOT_ROWS, many[order], by_key[order]), (_HOT_BANDS, rows[told], place[told])]
    for kind, held, at in kinds:
        first, n = _runs_of((at >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32))
        if len(first):
            part = (at[first] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((24 * np.append(first, len(at))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(held))])
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), coded], names=["part", "kind", "rows"])


def _met(parts: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """(band, k1, k2, n) of one part: the bands with n keys, more than one; n is null for those of hot bands, which may repeat."""
    rows, many, told = (np.frombuffer(b"".join(parts.get(kind, [])), np.int64).reshape(-1, 3) for kind in (_PLAIN, _HOT_ROWS, _HOT_BANDS))
    order = np.argsort(rows[:, 0])
    band = rows[order, 0]
    same = band[1:] == band[:-1]
    met = np.r_[False, same] | np.r_[same, False] if len(band) else np.zeros(0, bool)
    rows = rows[order[met | np.isin(band, told[:, 0])]]
    rows = rows[np.lexsort(rows.T[::-1])]
    rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]] if len(rows) else rows
    n = np.repeat(x := _runs_of(rows[:, 0])[1], x)
    hot = np.isin(rows[:, 0], told[:, 0])
    plain = ~hot & (n > 1)
    for held, count in ((rows[plain], pa.array(n[plain])), (np.concatenate([rows[hot], many]), None)):
        if len(held):
            yield pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(held.T)), count if count is not None else pa.nulls(len(held), pa.int64())], names=["band", "k1", "k2", "n"])


def _shared_bands(banded: DataFrame) -> DataFrame:
    """The rows (band, k1, k2) of the bands with several keys, each once, with their number n; ``banded`` has
    (band, k1, k2), or several in a row as ``bands``, a list or the bytes of its longs.

    Many rows travel as one: a task sorts what it deals out at once, and a part is sorted by one task. Parts
    are several times the shuffle partitions, so that a task's memory is a fraction of one.
    """
    if "bands" not in banded.columns:
        banded = banded.select(F.array("band").alias("bands"), "k1", "k2")
    parts = 4 * int(banded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_band_rows(batch))
                n += len(held[-1])
            if n >= DEALT:
                yield from _dealt(np.concatenate(held), parts)
                held, n = [], 0
        if n:
            yield from _dealt(np.concatenate(held), parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for batch in batches:
            for part, kind, rows in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "rows")), strict=True):
                if part != last:
                    yield from _met(held)
                    last, held = part, {}
                held.setdefault(kind, []).append(rows)
        yield from _met(held)

    dealt = banded.mapInArrow(deal, "part int, kind int, rows binary").repartition("part").sortWithinPartitions("part")
    met = stored(dealt.mapInArrow(meet, "band long, k1 long, k2 long, n long"))
    many = met.where("n is null").select("band", "k1", "k2")
    if not many.limit(1).count():
        return met
    many = stored(many.distinct())
    sizes = cut(many.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    return stored(met.where("n is not null").unionByName(many.join(sizes, "band").select("band", "k1", "k2", "n")))


def _one_named(rows: DataFrame, double: DataFrame | None) -> DataFrame:
    """``rows`` with ``k`` for (k1, k2): the first half, or a hash of both where different keys share it."""
    if double is None:
        return rows.withColumn("k", F.col("k1")).drop("k1", "k2")
    met = rows.join(double.select("k1", F.lit(True).alias("twice")), "k1", "left")
    return met.withColumn("k", F.when(F.col("twice"), F.xxhash64("k1", "k2")).otherwise(F.col("k1"))).drop("k1", "k2", "twice")


def linked(lines: DataFrame, texts_of: Callable[[DataFrame], DataFrame], threshold: float, measure: Measure = OF_LINES, more: DataFrame | None = None) -> DataFrame:
    """(k1, k2, component) of the texts that link to another, for any texts with a 128-bit key (k1, k2) and bands, a list or its bytes;
    ``texts_of`` gives (k1, k2, line) of at least the keys (k1, k2) it is handed. ``more`` are further
    buckets (band, k1, k2), treated as bands are.

    Inside, a key goes by one long, which is unique among the keys that share a band.
    """
    banded = lines.where("bands is not null").select("bands", "k1", "k2")
    banded = banded.unionByName(more.select(F.array("band").alias("bands"), "k1", "k2")) if more is not None else banded
    met = _shared_bands(banded)
    keys = cut(met.select("k1", "k2").distinct())
    double = cut(keys.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").select("k1"))
    double = double if double.limit(1).count() else None
    shared = _one_named(met, double)
    if double is not None:
        shared = stored(shared)
    pairs = candidate_pairs(shared)
    texts = stored(_one_named(texts_of(keys), double).groupBy("k").agg(F.first("line").alias("line")).select("k", "line", F.length("line").alias("size")))
    groups = cut(components(cut(_verified(pairs, texts, threshold, measure)), rows_per_task=EDGES))
    merged = cut(components(cut(remaining_links(shared, groups, texts, threshold, measure)), rows_per_task=EDGES).select(F.col("node").alias("of"), F.col("component").alias("into")))
    known = groups.join(merged, F.col("component") == F.col("of"), "left").select(F.col("node").alias("k"), F.coalesce("into", "component").alias("component"))
    found = known.unionByName(merged.join(groups, F.col("of") == F.col("node"), "left_anti").select(F.col("of").alias("k"), F.col("into").alias("component")))
    return _one_named(keys.withColumns({"x1": F.col("k1"), "x2": F.col("k2")}), double).join(found, "k").select(F.col("x1").alias("k1"), F.col("x2").alias("k2"), "component")


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, mark, n_lines, dropped) of each row: the numbers from 0 of the lines that repeat an earlier line.

    Earlier is by id (null last), then by line. A document is known by id and text, so rows
    that repeat are one document and get equal results. Null text is one empty line; lines
    under ``MIN_CHARS`` characters, and with them blank ones, always stay. Lines of any length
    take part whole. Only the two named columns are read, so others may have any names; an
    empty table gives no rows.
    """
    modest_batches(docs.sparkSession)
    own = _identified(docs, id_column, text_column)
    lines = stored(_lines(own))
    groups = linked(lines, lambda keys: _texts(own, keys), threshold)
    parts = lines.where("k1 is not null").select("id", "mark", "line", "k1", "k2")
    place = F.struct(F.col("id").isNull().alias("o"), "id", "mark", "line")
    firsts = parts.groupBy("k1", "k2").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    # an unlinked line that occurs once stays, so it needs no second look
    named = cut(firsts.join(groups, ["k1", "k2"], "left").where("n > 1 or component is not null").select("k1", "k2", "place", "component"))
    # cut, so that adaptive execution may split the lines of a large component in the join
    lead = cut(named.where("component is not null").groupBy("component").agg(F.min("place").alias("first")))
    stays = cut(named.join(lead, "component", "left").select("k1", "k2", F.coalesce("first", "place").alias("stays")))
    gone = parts.join(stays, ["k1", "k2"]).where(place != F.col("stays"))
    by_doc = gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    heads = lines.where("line = -1").select("id", "mark", "n_lines")
    match = [F.col("h.id").eqNullSafe(F.col("d.id")), F.col("h.mark") == F.col("d.mark")]
    none = F.array().cast("array<bigint>")
    return heads.alias("h").join(by_doc.alias("d"), match, "left").select(F.col("h.id").alias(id_column), "h.mark", "n_lines", F.coalesce("dropped", none).alias("dropped"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the repeating lines taken out of the text; a document all of whose lines repeat goes.

    Other columns stay as they are, whatever their names. Rows that repeat (same id and text)
    are one document: each comes back, alike. A null text stays null; an empty table stays empty.
    """
    gone = dropped_lines(docs, id_column, text_column, threshold).where("size(dropped) > 0").select(F.col(id_column).alias("of"), F.col("mark").alias("of_mark"), "n_lines", "dropped").dropDuplicates(["of", "of_mark"])
    held = docs.select(row_of(docs).alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("mark"))
    met = held.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("dropped", i.cast("long"))), "\n")
    whole = met.where("dropped is null or size(dropped) < n_lines")
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(rest)
    return whole.select(*((text.alias(c) if c == text_column else F.col("row")[c].alias(c)) for c in docs.columns))
