"""Exact top-k search of inner products or cosines through an index of cells, with rigorous bounds.

Right rows lie in lists around centroids. A list is cut into cells of a bounded number of rows, ordered by norm for
inner products and by the angle to the centroid for cosines, so a cell knows the range of norms and angles that it holds. Left rows
lie in cells likewise. First each left cell meets the few cells that promise most, which gives every left row a
threshold: its k-th score so far. Then a pair of cells meets only where a cone bound, the largest norm times the cosine of the
smallest angle there can be, reaches the threshold of some left row. In a pair that meets, the leading
coordinates along the sample's main directions are multiplied first; Cauchy and Schwarz bound the rest by its norms, and only pairs
that can still reach the threshold are computed in full. No bound drops a row of the result: fitting moves only the work.

Bounds of size: centroids and directions are fitted on at most ``SAMPLE`` rows with the smallest hash of the id; there are at most
``LISTS`` lists and, as cells grow beyond 2^16 of them, about 2^16 + LISTS cells, whose directory goes to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlpit.operators.dataset import placed
from marlpit.sources.durable import cut

SAMPLE, LISTS, CELLS = 4096, 1024, 1 << 16
#: A left cell's first look covers this many rows, or 8 times what a row keeps.
FIRST_LOOK = 64
_SLACK = 1e-8
#: Numbers of a zone's vectors, which lie in one row.
ZONE = 1 << 20
#: Columns of a product and pairs of a batch that a task holds at once.
CHUNK, PAIRS = 1024, 1 << 18
_MET = ["l", "r", "score", "part", "full"]


@dataclass(frozen=True)
class Found:
    """``rows`` of the search (left_id, right_id, score, rank), and ``work``, one row: cell pairs there are and that met, pairs of
    rows there are, met in part (first look included) and computed in full (first look included)."""

    rows: DataFrame
    work: DataFrame


@dataclass(frozen=True)
class Frame:
    """What is fitted: main directions as columns, and unit centroids in their coordinates."""

    turn: np.ndarray
    centers: np.ndarray

    @property
    def head(self) -> int:
        return max(1, len(self.turn) * 7 // 8)


@dataclass(frozen=True)
class Directory:
    """Of each right cell: its number, list, rows, largest and smallest norm, smallest and largest angle to the centroid."""

    cell: np.ndarray
    list: np.ndarray
    rows: np.ndarray
    most: np.ndarray
    least: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def zones(self, rows: int) -> np.ndarray:
        """Zone of each cell: about that many rows of cells of neighbouring lists, which meet a left cell in one step."""
        order = np.lexsort((self.cell, self.list))
        out = np.empty(len(order), np.int64)
        out[order] = (np.cumsum(self.rows[order]) - self.rows[order]) // rows
        return out

    def parts(self) -> Iterator[slice]:
        return (slice(at, at + CHUNK) for at in range(0, len(self.cell), CHUNK))

    def bounds(self, norm: np.ndarray, angles: np.ndarray, at: slice) -> np.ndarray:
        """No score of a left row (rows), of which norm and angles to all centroids are given, with a row of a cell (columns) is above this."""
        turn = angles[:, self.list[at]]
        gap = np.maximum(np.maximum(turn - self.far[at], self.near[at] - turn) - 1e-6, 0.0)
        best = np.cos(np.minimum(gap, np.pi))
        return norm[:, None] * np.where(best >= 0, self.most[at] * best, self.least[at] * best)


def _angles(x: np.ndarray, norm: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Angles of rows to unit centroids; 0 for rows without a direction."""
    return np.arccos(np.clip(np.divide(x @ centers.T, norm[:, None], out=np.ones((len(x), len(centers))), where=norm[:, None] > 0), -1.0, 1.0))


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _usable(rows: DataFrame, id: str, vector: str, *more: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    held = rows.select(F.col(id).alias("id"), v.alias("v"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("more") for c in more))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return held.where("id is not null and v is not null").where(F.forall("v", finite)).distinct()


def _first_of_equal(rows: DataFrame, most: int) -> DataFrame:
    """Of rows with one vector those with the ``most`` smallest ids, as no others can be among so many best; Spark limits each
    group ahead of its shuffle."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.withColumn("of_equal", place).where(F.col("of_equal") <= most).drop("of_equal")


def fit(rows: DataFrame, metric: str, lists: int) -> Frame | None:
    """Directions and centroids from a bounded sample of usable rows; none without rows."""
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    if not len(taken):
        return None
    x = _matrix(taken, len(taken))
    x = _units(x) if metric == "cosine" else x
    x = x @ (turn := np.linalg.eigh(x.T @ x)[1][:, ::-1])
    units = _units(x)
    centers = units[np.linspace(0, len(units) - 1, min(lists, len(units))).astype(int)]
    for _ in range(8):  # spherical Lloyd steps
        own = np.argmax(units @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, units)
        centers = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, _units(sums), centers)
    return Frame(turn, centers)


def _cells(rows: DataFrame, frame: Frame, metric: str, size: int, by: str, more: bool) -> DataFrame:
    """Rows in cells (cell, list, id, vec, norm, angle and, if wanted, more as arrays): at most ``size`` rows each, of one list."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), batch.num_rows)
            x = (_units(x) if metric == "cosine" else x) @ frame.turn
            norm = np.linalg.norm(x, axis=1)
            angle = _angles(x, norm, frame.centers)
            own = angle.argmin(axis=1)
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            held = [batch.column("id"), flat, pa.array(own.astype(np.int32)), pa.array(norm), pa.array(angle[np.arange(len(x)), own])]
            names = ["id", "v", "list", "norm", "angle"]
            yield pa.RecordBatch.from_arrays([*held, batch.column("more")] if more else held, names=[*names, "more"] if more else names)

    marked = rows.mapInArrow(run, f"id {kind}, v array<double>, list int, norm double, angle double" + (", more long" if more else ""))
    ordered, _ = placed(marked, "list", F.col(by), "id")
    # a cell never leaves its list, and its number tells its list
    cell = F.floor(F.col("place") / size) * LISTS + F.col("list")
    names = ["id", "norm", "angle", *(["more"] if more else [])]
    held = ordered.groupBy(cell.alias("cell"), "list").agg(F.collect_list(F.struct("id", "v", "norm", "angle", *(["more"] if more else []))).alias("x"))
    take = lambda c: F.transform("x", lambda r: r[c])
    return cut(held.select("cell", "list", F.flatten(take("v")).alias("vec"), *(take(c).alias(c) for c in names)))


def _directory(cells: DataFrame) -> Directory:
    held = cells.select("cell", "list", F.size("id").alias("rows"), F.array_max("norm").alias("most"), F.array_min("norm").alias("least"), F.array_min("angle").alias("near"), F.array_max("angle").alias("far")).toArrow()
    return Directory(*(held.column(c).to_numpy() for c in held.column_names))


def _codes(ls: pa.Array, rs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of both sides as numbers that are equal where ids are."""
    values = pc.unique(rs)
    return pc.fill_null(pc.index_in(ls, values.cast(ls.type)), -1).to_numpy(), pc.index_in(rs, values).to_numpy()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Callable[[str], pa.Scalar | pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield lambda c, at=batch.slice(i, 1): at.column(c).flatten() if pa.types.is_list(at.column(c).type) else at.column(c)[0].as_py()


def _kth(s: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Of each row its keep-th largest number; minus infinity with fewer."""
    out = np.full(len(s), -np.inf)
    for n in np.unique(keep[keep <= s.shape[1]]):
        rows = np.flatnonzero(keep == n)
        out[rows] = np.partition(s[rows], s.shape[1] - n, axis=1)[:, s.shape[1] - n]
    return out


def search(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, vector: str = "vec", metric: str = "dot", more: str | None = None, skip_same: bool = False, size: int = 2048, lists: int | None = None, digits: int = 9) -> Found:
    """The k best right rows of each left row, ties to the smaller id; ``rank`` is missing where ``more`` is given.

    ``more`` names a column of the left side with a number of further rows to keep, which a later filter may take away. Rows with a
    null id or a vector that is null or has a null, NaN or infinite component take no part; repeated
    rows count once; a zero vector scores 0. Empty sides give no rows; with fewer than k partners a left row gets all.
    """
    if metric not in ("dot", "cosine") or k < 1:
        raise ValueError("metric must be dot or cosine, and k at least 1")
    a, b = cut(_usable(left, left_id, vector, *([more] if more else []))), cut(_usable(right, right_id, vector))
    n_left, most, n = *a.agg(F.count("*"), F.max("more") if more else F.lit(0)).first(), b.count()
    kinds = a.schema["id"].dataType.simpleString(), b.schema["id"].dataType.simpleString()
    frame = fit(b, metric, min(LISTS, lists or max(1, int(n**0.5) // 2)))
    if frame is None or not n_left:
        none = left.sparkSession.createDataFrame([], f"l {kinds[0]}, r {kinds[1]}, score double, rank int")
        rows = none.select(F.col("l").alias(left_id), F.col("r").alias(right_id), "score", *([] if more else ["rank"]))
        return Found(rows, left.sparkSession.createDataFrame([(0, 0, n_left * n, 0, 0)], "cell_pairs long, met_cell_pairs long, pairs long, part_pairs long, full_pairs long"))
    lefts = _cells(a, frame, metric, size, "angle", bool(more)).drop("list", "norm", "angle").withColumnsRenamed({c: f"l_{c}" for c in ("cell", "vec", "id", "more")})
    cells = _cells(_first_of_equal(b, k + (most or 0) + 1), frame, metric, max(size, -(-n // CELLS)), "angle" if metric == "cosine" else "norm", False)
    told = _directory(cells)
    rights = cells.select(F.col("cell").alias("r_cell"), F.col("vec").alias("r_vec"), F.col("id").alias("r_id"))

    looks = cut(_looked(lefts, rights, told, frame, k, more, skip_same))
    zone = told.zones(max(size, ZONE // len(frame.turn)))
    pairs = cut(_promising(lefts, looks, told, frame, zone))
    held = pairs.join(lefts, "l_cell").join(looks.select("l_cell", "floor"), "l_cell").join(_zoned(rights, told, zone), "zone")
    met = cut(held.mapInArrow(_meet(told, frame, k, more, skip_same, digits), f"l {kinds[0]}, r {kinds[1]}, score double, part long, full long"))

    sums = met.agg(F.count("part").alias("met_cell_pairs"), F.coalesce(F.sum("part"), F.lit(0)).alias("part"), F.coalesce(F.sum("full"), F.lit(0)).alias("full"))
    seen = looks.agg(F.sum("looked").alias("looked"), F.count("*").alias("cells"))
    work = sums.join(seen, F.lit(True)).select(  # one row each
        (F.col("cells") * len(told.cell)).alias("cell_pairs"), "met_cell_pairs", (F.lit(n_left).cast("long") * n).alias("pairs"),
        (F.col("part") + F.col("looked")).alias("part_pairs"), (F.col("full") + F.col("looked")).alias("full_pairs"),
    )
    rows = met.where("score is not null").select("l", "r", "score")
    if more:
        return Found(rows.select(F.col("l").alias(left_id), F.col("r").alias(right_id), "score"), work)
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.col("score").desc(), "r"))
    return Found(rows.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("l").alias(left_id), F.col("r").alias(right_id), "score", "rank"), work)


def _keep(get: Callable, k: int, more: str | None, n: int) -> np.ndarray:
    return np.full(n, k) + (get("l_more").to_numpy() if more else 0)


def _looked(lefts: DataFrame, rights: DataFrame, told: Directory, frame: Frame, k: int, more: str | None, skip_same: bool) -> DataFrame:
    """(l_cell, floor, looked): after a first look at the most promising cells a lower bound of each left row's k-th score."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get in _each(batches):
            x = _matrix_of(get("l_vec"), n := len(get("l_id")))
            norm = np.linalg.norm(x, axis=1)
            angles = _angles(x, norm, frame.centers)
            best = np.argsort(-np.concatenate([told.bounds(norm, angles, part).mean(axis=0) for part in told.parts()]), kind="stable")
            wanted = max(FIRST_LOOK, 8 * int(np.median(_keep(get, k, more, n))))
            best = best[: int(np.searchsorted(np.cumsum(told.rows[best]), wanted)) + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), get("l_cell"))), pa.array(told.cell[best])], names=["l_cell", "r_cell"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get in _each(batches):
            ls, rs = get("l_id"), get("ids")
            s = _matrix_of(get("l_vec"), len(ls)) @ _matrix_of(get("vecs"), len(rs)).T
            looked = s.size
            if skip_same:
                x, y = _codes(ls, rs)
                s[x[:, None] == y[None, :]] = -np.inf
            floor = _kth(s, _keep(get, k, more, len(ls)))
            yield pa.RecordBatch.from_arrays([pa.array([get("l_cell")]), pa.array([floor.tolist()], pa.list_(pa.float64())), pa.array([looked])], names=["l_cell", "floor", "looked"])

    chosen = lefts.mapInArrow(choose, "l_cell long, r_cell long")
    # bounded: a look ends with the cell that fills it
    gathered = chosen.join(rights, "r_cell").groupBy("l_cell").agg(F.collect_list(F.struct("r_vec", "r_id")).alias("x"))
    gathered = gathered.select("l_cell", F.flatten("x.r_vec").alias("vecs"), F.flatten("x.r_id").alias("ids"))
    return lefts.join(gathered, "l_cell").mapInArrow(look, "l_cell long, floor array<double>, looked long")


def _matrix_of(flat: pa.Array, n: int) -> np.ndarray:
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def _within(norm: np.ndarray, floor: np.ndarray, bound: np.ndarray, most: np.ndarray | float) -> np.ndarray:
    """Whether a bound reaches a row's threshold, with room for rounding."""
    room = _SLACK * (1 + norm[:, None] * most)
    return bound >= floor[:, None] - room


def _zoned(rights: DataFrame, told: Directory, zone: np.ndarray) -> DataFrame:
    """(zone, r_cell, r_rows, r_id, r_vec): a row a zone, in which its cells lie one after the other."""
    spark = rights.sparkSession
    places = spark.createDataFrame(pa.table({"r_cell": told.cell, "zone": zone}))  # bounded as the directory is
    held = rights.join(F.broadcast(places), "r_cell").groupBy("zone").agg(F.collect_list(F.struct("r_cell", "r_id", "r_vec")).alias("x"))
    return held.select("zone", F.col("x.r_cell").alias("r_cell"), F.transform("x", lambda c: F.size(c["r_id"])).alias("r_rows"), F.flatten("x.r_id").alias("r_id"), F.flatten("x.r_vec").alias("r_vec"))


def _promising(lefts: DataFrame, looks: DataFrame, told: Directory, frame: Frame, zone: np.ndarray) -> DataFrame:
    """(l_cell, zone, hits): the zone's cells that may hold a row of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get in _each(batches):
            floor = get("floor").to_numpy()
            x = _matrix_of(get("l_vec"), len(floor))
            norm = np.linalg.norm(x, axis=1)
            angles = _angles(x, norm, frame.centers)
            hit = np.concatenate([_within(norm, floor, told.bounds(norm, angles, part), told.most[part]).any(axis=0) for part in told.parts()])
            zones = np.unique(zone[hit])
            hits = [told.cell[hit & (zone == z)].tolist() for z in zones]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(zones), get("l_cell"))), pa.array(zones), pa.array(hits, pa.list_(pa.int64()))], names=["l_cell", "zone", "hits"])

    return lefts.join(looks, "l_cell").mapInArrow(run, "l_cell long, zone long, hits array<long>")


def _meet(told: Directory, frame: Frame, k: int, more: str | None, skip_same: bool, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each left cell with a zone's cells the best rows above the thresholds, and one row a pair of cells that counts its pairs of rows."""
    spot, head = {int(c): i for i, c in enumerate(told.cell)}, frame.head

    def each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for get in _each(batches):
            ls, rs, floor = get("l_id"), get("r_id"), get("floor").to_numpy()
            x, y = _matrix_of(get("l_vec"), len(ls)), _matrix_of(get("r_vec"), len(rs))
            norm = np.linalg.norm(x, axis=1)
            angles, keep, hits = _angles(x, norm, frame.centers), _keep(get, k, more, len(ls)), set(get("hits").to_pylist())
            ends = np.cumsum(get("r_rows").to_numpy())
            for cell, end, rows in zip(get("r_cell").to_pylist(), ends, get("r_rows").to_numpy(), strict=True):
                if cell in hits:
                    yield cell, ls, rs.slice(end - rows, rows), floor, x, y[end - rows : end], keep, norm, angles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, ls, rs, floor, x, y, keep, norm, angles in each_pair(batches):
            at = slice(spot[cell], spot[cell] + 1)
            alive = np.flatnonzero(_within(norm, floor, told.bounds(norm, angles, at), told.most[at]).ravel())
            order = pc.sort_indices(rs)  # of equal scores the smaller id comes first
            rs, y = rs.take(order), y[order.to_numpy()]
            same = _codes(ls, rs) if skip_same else None
            part = full = 0
            for start in range(0, len(rs), CHUNK):
                z = y[start : start + CHUNK]
                rest = np.linalg.norm(x[alive, head:], axis=1)[:, None] * np.linalg.norm(z[:, head:], axis=1)[None, :]
                first = x[alive, :head] @ z[:, :head].T
                able = _within(norm[alive], floor[alive], first + rest, told.most[at])
                u, v = np.nonzero(able)
                part, full = part + first.size, full + len(u)
                score = first[u, v]
                for lo in range(0, len(u), PAIRS):  # whole scores of what is left
                    some = slice(lo, lo + PAIRS)
                    score[some] += np.einsum("ij,ij->i", x[alive[u[some]], head:], z[v[some], head:])
                score = np.round(score, digits)
                if same:
                    other = same[0][alive[u]] != same[1][v + start]
                    u, v, score = u[other], v[other], score[other]
                order = np.lexsort((v, -score, u))
                u, v, score = u[order], v[order], score[order]
                ahead = np.arange(len(u)) - np.searchsorted(u, u)
                u, v, score = (c[ahead < keep[alive[u]]] for c in (u, v, score))
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([ls.take(pa.array(alive[u])), rs.take(pa.array(v + start)), pa.array(score), none, none], names=_MET)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, ls.type), pa.nulls(1, rs.type), pa.nulls(1, pa.float64()), pa.array([part]), pa.array([full])], names=_MET)

    return run
