"""Dense vectors: scoring in blocks, neighbours, prototypes, hybrid scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions import scalar as S


def _blocks(rows: DataFrame, id: str, vector: str, size: int, name: str, *more: str, count: int | None = None) -> DataFrame:
    """Rows gathered by hash into about count / size blocks: ids, all vectors in one flat array, and more numbers a row."""
    n = max(1, -(-(rows.count() if count is None else count) // size))
    part = F.pmod(F.xxhash64(id), F.lit(n))
    row = F.struct(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), *(F.col(c).cast("double").alias(c) for c in more))
    held = rows.groupBy(part.alias(f"{name}_block")).agg(F.collect_list(row).alias("x"))
    take = lambda c: F.transform("x", lambda r: r[c])
    return held.select(take("id").alias(f"{name}_id"), F.flatten(take("v")).alias(f"{name}_vec"), *(take(c).alias(f"{name}_{c}") for c in more))


def _products(batches: Iterator[pa.RecordBatch], metric: str, digits: int | None = 9) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array, np.ndarray]]:
    """Of each pair of blocks: the row, ids of both sides (right ones in order) and their scores."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ls, rs = (row.column(f"{c}_id").flatten() for c in "lr")
            x, y = (row.column(f"{c}_vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) for c, ids in (("l", ls), ("r", rs)))
            order = pc.sort_indices(rs)
            rs, y = rs.take(order), y[order.to_numpy()]
            if metric == "cosine":
                x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
            s = x @ y.T
            yield row, ls, rs, s if digits is None else np.round(s, digits)


def _numbers(row: pa.RecordBatch, column: str) -> np.ndarray:
    return row.column(column).flatten().to_numpy(zero_copy_only=False)


def best(s: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's ``keep`` largest scores, the first of equal ones first; all without it."""
    if keep is None:
        return tuple(x.ravel() for x in np.indices(s.shape))
    order = np.argsort(-s, axis=1, kind="stable")[:, : max(1, int(keep.max(initial=1)))]
    i, j = np.nonzero(np.arange(order.shape[1])[None, :] < keep[:, None])
    return i, order[i, j]


def _all_pairs(ls: pa.Array, rs: pa.Array, s: np.ndarray, most: int = 1 << 18, in_order: bool = False) -> Iterator[pa.RecordBatch]:
    """All finite scores of a block, some at a time; ``in_order`` by score, so that a column file holds runs of equal ones."""
    flat = s.ravel()
    at = np.argsort(flat) if in_order else np.arange(len(flat))
    for start in range(0, len(at), most):
        own = at[start : start + most]
        if not (real := np.isfinite(flat[own])).all():
            own = own[real]
        i, j = np.divmod(own, s.shape[1])
        yield pa.RecordBatch.from_arrays([ls.take(pa.array(i)), rs.take(pa.array(j)), pa.array(flat[own])], names=["l", "r", "score"])


def _same(ls: pa.Array, rs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) where a left id equals a right one, repeated ones each."""
    codes = pa.concat_arrays([ls, rs]).dictionary_encode(null_encoding="encode").indices.to_numpy()
    left, right = codes[: len(ls)], codes[len(ls) :]
    order = np.argsort(right, kind="stable")
    low, high = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    i = np.repeat(np.arange(len(left)), high - low)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - high, high - low)]


class _Best:
    """Of one block of left rows, the ``keep`` best of all right rows met so far: a new block gives only what reaches the last one kept."""

    def __init__(self, ls: pa.Array, rs: pa.Array, keep: np.ndarray, digits: int | None) -> None:
        self.ls, self.keep, self.digits = ls, keep, digits
        self.i, self.r, self.score = np.zeros(0, np.int64), rs.slice(0, 0), np.zeros(0)
        self.least = np.full(len(ls), -np.inf)

    def add(self, rs: pa.Array, s: np.ndarray) -> None:
        """Right ids in order and unrounded scores; those that aren't finite take no part."""
        least = self.least
        if np.isneginf(least).any():
            n = min(int(self.keep.max(initial=1)), s.shape[1])
            own = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            if not (own < np.inf).all():  # NaN and infinity come last
                s = np.where(np.isfinite(s), s, -np.inf)
                own = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            least = np.maximum(least, own)
        margin = 0.0 if self.digits is None else 10.0**-self.digits + 1e-12 * np.where(np.isfinite(least), np.abs(least), 0.0)
        at = np.flatnonzero((s >= (least - margin)[:, None]).ravel())
        if len(at) > s.size // 8:  # many equal ones, or few columns
            i, j = best(np.where(np.isfinite(s), s if self.digits is None else np.round(s, self.digits), -np.inf), self.keep)
        else:
            i, j = np.divmod(at, s.shape[1])
        score = s[i, j] if self.digits is None else np.round(s[i, j], self.digits)
        real = np.flatnonzero(np.isfinite(score))
        if not len(real):
            return
        i, r, score = np.concatenate([self.i, i[real]]), pa.concat_arrays([self.r, rs.take(pa.array(j[real]))]), np.concatenate([self.score, score[real]])
        rank = np.empty(len(r), np.int64)
        rank[pc.sort_indices(r).to_numpy()] = np.arange(len(r))
        order = np.lexsort((rank, -score, i))
        place = np.arange(len(order)) - np.searchsorted(i[order], i[order])
        left = place < self.keep[i[order]]
        order, last = order[left], place[left] == self.keep[i[order[left]]] - 1
        self.i, self.r, self.score = i[order], r.take(pa.array(order)), score[order]
        self.least[self.i[last]] = self.score[last]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ls.take(pa.array(self.i)), self.r, pa.array(self.score)], names=["l", "r", "score"])


def score_blocks(left: DataFrame, right: DataFrame, k: int | None, left_id: str, right_id: str, vector: str = "vec", metric: str = "dot", block: int = 2048, skip_same: bool = False, more: str | None = None, digits: int | None = 9, in_order: bool = False) -> DataFrame:
    """(left_id, right_id, score): the k best of the right side for each left row, ties to the smaller id. Without k it is all, unranked.

    Blocks of both sides meet in pairs and each pair is one matrix product. A task keeps k rows of the right for each
    left row over all right blocks that it meets, so at most k candidates a task go on to the last ranking.
    Scores are rounded to ``digits``, so that ties don't depend on the order of a sum.
    Without k, ``in_order`` gives each pair of blocks in the order of scores, which takes a stored table less than half the disk.
    ``more`` names a column of the left side with a number of further rows to keep, as many as a later filter may take away.
    """
    extra = [more] if more else []
    a, b = _blocks(left, left_id, vector, block, "l", *extra), _blocks(right, right_id, vector, block, "r")
    kinds = left.schema[left_id].dataType.simpleString(), right.schema[right_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for row, ls, rs, s in _products(batches, metric, None):
            if skip_same:
                s[_same(ls, rs)] = -np.inf
            if k is None:
                yield from _all_pairs(ls, rs, s if digits is None else np.round(s, digits), in_order=in_order)
                continue
            if held is None or not held.ls.equals(ls):  # pairs of a left block come one after the other
                if held:
                    yield held.rows()
                held = _Best(ls, rs, k + (_numbers(row, f"l_{more}").astype(np.int64) if more else np.zeros(len(ls), np.int64)), digits)
            held.add(rs, s)
        if held:
            yield held.rows()

    found = a.crossJoin(b).mapInArrow(run, f"l {kinds[0]}, r {kinds[1]}, score double")
    if k is None or more:
        return found.select(F.col("l").alias(left_id), F.col("r").alias(right_id), "score")
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.col("score").desc(), "r"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("l").alias(left_id), F.col("r").alias(right_id), "score", "rank")


def score_moments(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str = "vec", block: int = 2048, counts: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """(left_id, n, mean, m2): number, mean and sum of squared deviations of each left row's scores of all right rows; no pair leaves its block."""
    a, b = (_blocks(df, key, vector, block, n, count=c) for df, key, n, c in ((left, left_id, "l", counts[0]), (right, right_id, "r", counts[1])))
    kind = left.schema[left_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ls, rs, s in _products(batches, "dot"):
            mean = s.mean(axis=1)
            yield pa.RecordBatch.from_arrays([ls, pa.array(np.full(len(ls), len(rs))), pa.array(mean), pa.array(((s - mean[:, None]) ** 2).sum(axis=1))], names=["l", "n", "mean", "m2"])

    parts = a.crossJoin(b).mapInArrow(run, f"l {kind}, n long, mean double, m2 double")
    return merged_moments(parts.withColumnRenamed("l", left_id), left_id)


def merged_moments(parts: DataFrame, *by: str) -> DataFrame:
    """Moments (n, mean, m2) of groups from those of their parts."""
    held = parts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    m2 = F.aggregate("parts", F.lit(0.0), lambda x, p: x + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return held.select(*by, "n", "mean", m2.alias("m2"))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label."""
    held = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return held.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def few(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """A small side to broadcast; its number of rows is checked."""
    if rows.limit(most + 1).count() > most:
        raise ValueError("too many rows to broadcast; use score_blocks")
    return F.broadcast(rows)


def nearest_prototype(rows: DataFrame, prototypes: DataFrame, id: str, vector: str, name: str, max_prototypes: int = 10_000) -> DataFrame:
    """The nearest prototype of each row, the smaller name on a tie. Prototypes are few: their number is checked before they are broadcast."""
    held = rows.crossJoin(few(prototypes.select(F.col(name).alias("p"), F.col("centroid")), max_prototypes))
    dist = F.round(S.euclidean(F.col(vector), F.col("centroid")), 9)
    return held.groupBy(id).agg(F.min_by("p", F.struct(dist.alias("d"), F.col("p"))).alias("nearest"), F.min(dist).alias("distance"))


def affordability(users: DataFrame, prices: DataFrame, budget: str, price: str) -> DataFrame:
    """``users`` with the number and share of prices within budget. Both sides are merged in price
    order and counted by a distributed running sum, so no user meets every price. A null or NaN budget affords nothing, such prices
    are left out of the count but not of the total; without prices the share is null."""
    known = F.nanvl(F.col(budget).cast("double"), F.lit(None).cast("double"))
    rows = users.select(F.struct(*users.columns).alias("u"), known.alias("x"), F.lit(0).alias("n"))
    marks = prices.where(F.col(price).isNotNull() & ~F.isnan(F.col(price).cast("double"))).select(F.lit(None).cast(rows.schema["u"].dataType).alias("u"), F.col(price).cast("double").alias("x"), F.lit(1).alias("n"))
    both = rows.unionByName(marks)
    bucket = F.floor(F.col("x") / 100)
    both = both.withColumn("b", bucket)
    sums = both.where("x is not null").groupBy("b").agg(F.sum("n").alias("s"))
    ahead = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("ahead"))
    total = prices.count()
    inside = F.sum("n").over(Window.partitionBy("b").orderBy("x").rangeBetween(Window.unboundedPreceding, 0))
    held = both.where("x is not null").withColumn("inside", inside).where("u is not null").join(ahead, "b")
    count = F.col("inside") + F.col("ahead")
    told = held.select("u", count.cast("long").alias("affordable")).unionByName(rows.where("x is null").select("u", F.lit(0).cast("long").alias("affordable")))
    return told.select("u.*", "affordable", F.try_divide("affordable", F.lit(total)).alias("share"))


def hybrid(users: DataFrame, items: DataFrame, alphas: Sequence[float], k: int | None = None, more: str | None = None, block: int = 2048) -> DataFrame:
    """(alpha, user_id, item_id, score): a user's z-scores over all ``items`` (item_id, vec, cart), blended with those of ``cart``.

    A first pass over the pairs of blocks gives each user's mean and deviation, a second one
    blends inside the matrix product. With k only that many of a user and alpha, and as many
    more as the users' column ``more`` says, leave their block; seen items must still be in.
    """
    for alpha in alphas:
        if not 0 <= alpha <= 1:
            raise ValueError("alpha must be between 0 and 1")
    kinds = users.schema["user_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    sd = F.sqrt(F.col("m2") / F.col("n"))
    counts = users.count(), items.count()
    moments = score_moments(users, items, "user_id", "item_id", block=block, counts=counts).select("user_id", F.col("mean"), sd.alias("sd"))
    ends = items.agg(F.avg("cart").alias("cart_mean"), F.stddev_pop("cart").alias("cart_sd"))  # one row
    z = F.when(F.col("cart_sd") > 0, (F.col("cart") - F.col("cart_mean")) / F.col("cart_sd")).otherwise(0.0)
    left = _blocks(users.join(moments, "user_id"), "user_id", "vec", block, "l", "mean", "sd", *([more] if more else []), count=counts[0])
    right = _blocks(items.crossJoin(ends).withColumn("z", z), "item_id", "vec", block, "r", "z", count=counts[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ls, rs, s in _products(batches, "dot"):
            mean, sd = _numbers(row, "l_mean")[:, None], _numbers(row, "l_sd")[:, None]
            m = np.divide(s - mean, sd, out=np.zeros_like(s), where=sd > 0)
            c = _numbers(row, "r_z")[pc.sort_indices(row.column("r_id").flatten()).to_numpy()][None, :]
            keep = None if k is None else k + (_numbers(row, f"l_{more}").astype(np.int64) if more else np.zeros(len(ls), np.int64))
            for alpha in alphas:
                blend = np.round(alpha * m + (1 - alpha) * c, 9)
                i, j = best(blend, keep)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), alpha)), ls.take(pa.array(i)), rs.take(pa.array(j)), pa.array(blend[i, j])], names=["alpha", "user_id", "item_id", "score"])

    return left.crossJoin(right).mapInArrow(run, f"alpha double, user_id {kinds[0]}, item_id {kinds[1]}, score double")


def select_alpha(metrics: DataFrame) -> DataFrame:
    """The alpha with the largest (ndcg, recall, alpha)."""
    return metrics.agg(F.max_by("alpha", F.struct("ndcg", "recall", "alpha")).alias("alpha"), F.max("ndcg").alias("ndcg"))
