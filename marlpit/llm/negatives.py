"""Hard negatives by product quantisation with stored residual norms.

Vectors are cut into short segments; a row stores, for each segment, the nearest of 256 integer
centroids and the norm of what remains, as a number. For an anchor, inner products of its
segments with all centroids are a lookup table, so a row's score lies within the sum of its
table entries plus or minus the products of the anchor's and the residual's norms. Rows whose range cannot reach what is asked for are
skipped; all others are scored exactly in integers, so the result is that of scoring every row.

Anchors and rows meet in blocks, each pair of blocks a row of a join; a block gives each
anchor's best only, and the blocks' best are merged by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.llm.common import cut

#: Numbers of a segment, centroids of a segment, rows that centroids are fitted on, and rounds of fitting.
SEGMENT, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 16384, 8
#: Rows and anchors of a block; exact scores that a task holds at a time.
ROW_BLOCK, ANCHOR_BLOCK, AT_ONCE = 4096, 256, 1 << 18
#: Squared norms stay below, so that a score always fits a long.
MOST = float(1 << 62)
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95


@dataclass(frozen=True)
class Codebook:
    """``centroids``: (segments, CENTROIDS, SEGMENT) whole numbers as floats."""

    dim: int
    centroids: np.ndarray

    def segments(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), len(self.centroids) * SEGMENT))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), -1, SEGMENT)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the norm of each row's residual, rounded up."""
        parts, codes, left = self.segments(x), np.empty((len(x), len(self.centroids)), np.uint8), np.zeros(len(x))
        for m, own in enumerate(self.centroids):
            gap = _nearest(parts[:, m], own)
            codes[:, m] = gap
            left += ((parts[:, m] - own[gap]) ** 2).sum(axis=1)
        return codes, np.nextafter(np.sqrt(left) * (1 + 1e-12) + 1e-14 * np.sqrt((x**2).sum(axis=1)), np.inf)

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(segments, anchors, CENTROIDS) inner products; 32-bit floats where they and their sums are exact in them."""
        tables = np.einsum("ams,mcs->mac", self.segments(anchors), self.centroids)
        exact = np.abs(tables).max(axis=2, initial=0).sum(axis=0).max(initial=0) < 1 << 24
        return tables.astype(np.float32) if exact else tables

    def slack(self, anchors: np.ndarray) -> np.ndarray:
        """What rounding in ``tables`` and their sums may add, by anchor."""
        largest = np.abs(self.centroids).max(axis=(1, 2), initial=0)
        return np.abs(self.segments(anchors)).sum(axis=2) @ largest * 1e-13


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centroids**2).sum(axis=1) / 2
    for a in range(0, len(x), 8192):
        out[a : a + 8192] = (half - x[a : a + 8192] @ centroids.T).argmin(axis=1)
    return out


def fit(rows: DataFrame, dim: int) -> Codebook:
    """Centroids by k-means over each segment of at most ``SAMPLE`` rows, those with the smallest hash of the id."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec")
    wide = -(-max(dim, 1) // SEGMENT) * SEGMENT
    x = np.array([list(r.vec) + [0] * (wide - len(r.vec)) for r in sample.collect()], float).reshape(-1, wide // SEGMENT, SEGMENT)
    out = np.zeros((wide // SEGMENT, CENTROIDS, SEGMENT))
    for m in range(len(out) if len(x) else 0):
        part = x[:, m]
        own = part[np.linspace(0, len(part) - 1, CENTROIDS).astype(np.int64)]
        for _ in range(ROUNDS):
            at = _nearest(part, own)
            n = np.bincount(at, minlength=CENTROIDS)
            mean = np.stack([np.bincount(at, part[:, s], CENTROIDS) for s in range(SEGMENT)], axis=1) / np.maximum(n, 1)[:, None]
            own = np.where(n[:, None] > 0, mean, own)
        out[m] = np.rint(own)
    return Codebook(dim, out)


def whole_vectors(embeddings: DataFrame, label: Column) -> DataFrame:
    """(id, label, vec) of the rows that take part: whole-number vectors of floor(256 * x).

    A row takes part if vec_id, label and vector are not null, no component is null or not finite, and
    the squared norm is below 2^62, beyond which a score need not fit a long. Of rows that share a vec_id
    the one with the smallest label, then vector, takes part. Empty vectors score 0 with all others.
    """
    raw = embeddings.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").alias("x"))
    fine = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float(1 << 54))), F.lit(False)))
    rows = raw.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    rows = rows.select("id", "label", F.transform("x", lambda x: F.floor(x.cast("double") * 256)).alias("vec"))
    rows = rows.where(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < MOST)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")


def _packed(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.zeros((batch.num_rows, dim), np.int64)
    vec = batch.column("vec")
    sizes = np.diff(vec.offsets.to_numpy())
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return batch.column("id").to_numpy(), batch.column("label").to_numpy(), x


def _blocks(rows: DataFrame, n: int, size: int, dim: int, prefix: str, book=None, lists: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of about ``size`` of the ``n`` rows, by a hash of the id: a row of bytes each, with codes and norms if there is a ``book``."""
    extra = ["codes", "norms"] if book else ["counts", *lists] if lists else []
    names = [prefix + c for c in ("ids", "labels", "vecs")] + extra

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, labels, x = _packed(whole, dim)
        values = [ids, labels, x.astype("<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<i8")]
        if book:
            values += book.value.encode(x.astype(float))
        elif lists:
            values += [np.diff(whole.column(lists[0]).offsets.to_numpy()), *(whole.column(c).flatten().to_numpy() for c in lists)]
        return pa.RecordBatch.from_pydict({"place": whole.column("place")[:1]} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(names, values, strict=True)})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            places = batch.column("place").to_numpy()
            starts = np.flatnonzero(np.diff(places, prepend=-1))
            for at, end in zip(starts, np.append(starts, len(places))[1:], strict=True):
                if held and held[0].column("place")[0].as_py() != places[at]:
                    yield block(held)
                    held = []
                held.append(batch.slice(at, end - at))
        if held:
            yield block(held)

    place = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // size)))).cast("int")
    dealt = rows.withColumn("place", place).repartition("place").sortWithinPartitions("place", "id")
    return dealt.mapInArrow(pack, "place int, " + ", ".join(f"{c} binary" for c in names))


def _numbers(row: dict, prefix: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[prefix + "ids"], "<i8")
    vecs = row[prefix + "vecs"]
    wide = np.frombuffer(vecs, "<i4" if len(vecs) == 4 * dim * len(ids) else "<i8").reshape(len(ids), dim)
    return ids, np.frombuffer(row[prefix + "labels"], "<i8"), wide


def _ranges(row: dict, anchors: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores of a pair of blocks."""
    n = len(row["ids"]) // 8
    codes = np.frombuffer(row["codes"], np.uint8).reshape(n, -1)
    tables = book.tables(anchors.astype(float))
    middle = np.zeros((len(anchors), n), tables.dtype if tables.size else np.float64)
    for m in range(codes.shape[1]):
        middle += tables[m][:, codes[:, m]]
    norms = np.sqrt((anchors.astype(float) ** 2).sum(axis=1)) * (1 + 1e-12)
    width = norms[:, None] * np.frombuffer(row["norms"], "<f8")[None] + book.slack(anchors.astype(float))[:, None]
    middle = middle.astype(np.float64)
    return middle - width, middle + width


def _exact(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer scores of (anchor, row) pairs, a part of them at a time."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), AT_ONCE):
        s = slice(at, at + AT_ONCE)
        out[s] = np.einsum("ij,ij->i", anchors[a[s]].astype(np.int64), rows[r[s]].astype(np.int64))
    return out


def _kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group by falling score, then id."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    start = np.searchsorted(sorted_group, sorted_group)
    return order[np.arange(len(order)) - start < k]


def _first_by(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pairs of blocks, one at a time."""
    return (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows))


def hard_negatives(embeddings: DataFrame, label: Column | None = None, anchors: Column | None = None) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` and ``anchors`` are expressions over ``embeddings`` and over vec_id; every row is an anchor where
    none is given. A positive is one of an anchor's first five other rows of its label, a negative one of the
    first three rows of other labels with 50 * positive_score <= 100 * negative_score <= 95 * positive_score; ties go by smaller
    vec_id. Negative and zero scores follow the same inequality. Vectors of different length meet in
    their common components. See ``whole_vectors`` for the rows that take part; other columns are not read. An empty table gives no rows.
    """
    rows = cut(whole_vectors(embeddings, F.col("label") if label is None else label))
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    dim = max(dim, 1)
    book = rows.sparkSession.sparkContext.broadcast(fit(rows, dim))  # dim * CENTROIDS numbers
    asked = cut(rows.withColumnRenamed("id", "vec_id").where(F.lit(True) if anchors is None else anchors).withColumnRenamed("vec_id", "id"))
    n_asked, parts = asked.count(), max(1, -(-n // ROW_BLOCK))
    stored = cut(_blocks(rows, n, ROW_BLOCK, dim, "", book))

    def met(queries: DataFrame) -> DataFrame:
        """Each block of anchors with each block of rows: anchors are the stated query set. A fixed number of
        partitions, as the work of a pair of blocks is far larger than its bytes."""
        copies = queries.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return stored.repartition(4 * parts, "place").join(copies.repartition(4 * parts, "place"), "place").drop("place")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _pairs(batches):
            (ids, labels, x), (a_ids, a_labels, a_x) = _numbers(row, "", dim), _numbers(row, "a_", dim)
            low, high = _ranges(row, a_x, book.value)
            other = (labels[None] != a_labels[:, None]) | (ids[None] == a_ids[:, None])
            low[other] = -np.inf
            a, r = np.nonzero((high >= _kth_largest(low, POSITIVES)[:, None]) & ~other)
            score = _exact(a_x, x, a, r)
            at = _first(a, score, ids[r], POSITIVES)
            yield pa.RecordBatch.from_pydict({"anchor": a_ids[a[at]], "id": ids[r[at]], "score": score[at]})

    def in_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _pairs(batches):
            (ids, labels, x), (a_ids, a_labels, a_x) = _numbers(row, "", dim), _numbers(row, "a_", dim)
            low, high = _ranges(row, a_x, book.value)
            same = labels[None] == a_labels[:, None]
            of = np.repeat(np.arange(len(a_ids)), np.frombuffer(row["counts"], "<i4"))
            positives, scores = np.frombuffer(row["positives"], "<i8"), np.frombuffer(row["scores"], "<i8")
            windows = [(-(-LOW * p // 100), HIGH * p // 100) for p in scores.tolist()]
            asked = np.zeros(low.shape, bool)
            for a, (least, most) in zip(of.tolist(), windows, strict=True):
                sure = np.where((low[a] >= least) & (high[a] <= most) & ~same[a], low[a], -np.inf)
                asked[a] |= (high[a] >= max(least, _kth_largest(sure[None], NEGATIVES)[0])) & (low[a] <= most) & ~same[a]
            a, r = np.nonzero(asked)
            score = _exact(a_x, x, a, r)
            window, at = [], []
            for w, (s, e, (least, most)) in enumerate(zip(np.searchsorted(a, of), np.searchsorted(a, of, "right"), windows, strict=True)):
                fits = s + np.flatnonzero((score[s:e] >= least) & (score[s:e] <= most))
                at.append(fits[np.lexsort((ids[r[fits]], -score[fits]))[:NEGATIVES]])
                window.append(np.full(len(at[-1]), w))
            window, at = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (window, at))
            yield pa.RecordBatch.from_pydict({"anchor": a_ids[of[window]], "positive": positives[window], "of": scores[window], "id": ids[r[at]], "score": score[at]})

    queries = cut(_blocks(asked, n_asked, ANCHOR_BLOCK, dim, "a_"))
    positives = _first_by(met(queries).mapInArrow(best, "anchor long, id long, score long"), ["anchor"], POSITIVES)
    # an anchor's windows travel with its vector: five ids and scores at most
    own = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("own"))
    told = asked.join(own, asked["id"] == own["anchor"]).select("id", "label", "vec", F.col("own.id").alias("positives"), F.col("own.score").alias("scores"))
    windows = cut(_blocks(told, n_asked, ANCHOR_BLOCK, dim, "a_", lists=("positives", "scores")))
    found = met(windows).mapInArrow(in_windows, "anchor long, positive long, of long, id long, score long")
    ranked = _first_by(found, ["anchor", "positive", "of"], NEGATIVES)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("of").alias("positive_score"), F.col("score").alias("negative_score"))
