"""Biased factorization by stratified distributed SGD, on weighted BCE or BPR.

Users lie in ``blocks`` blocks and items in twice as many, by hash. A stratum pairs each user block with two
item blocks, so that no two of its cells share a row of parameters: all cells step at the same
time and the result is that of one after the other. Item blocks are paired by the rounds of a
tournament, in which every two meet once, and each round's pairs rotate over the user blocks; so every
triple of a user and two items has exactly one cell, and an epoch visits each example
once. State is a table of blocks, cut once an epoch, a stratum is one shuffle by cell, and what a task holds is three
blocks and their examples: with more blocks it gets smaller at any size. The result depends on the
configuration, and not on tasks or partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlpit.sources.durable import cut

BIASES = ("none", "item", "user_item")
OBJECTIVES = ("bce", "bpr")
_STATE = "kind string, block int, ids binary, params binary, squares binary"
_CELL = ("users", "items", "others", "labels", "weights")


@dataclass(frozen=True)
class Config:
    dim: int = 8
    objective: str = "bce"
    bias: str = "item"
    epochs: int = 12
    rate: float = 0.1
    decay: float = 1e-4
    batch: int = 1024
    blocks: int = 2
    patience: int = 3
    seed: int = 42

    def __post_init__(self) -> None:
        if self.objective not in OBJECTIVES or self.bias not in BIASES or min(self.dim, self.epochs, self.batch, self.blocks) < 1:
            raise ValueError("unknown objective or bias, or a size below one")


def blocks_for(examples: int, of_cell: int = 1_000_000) -> int:
    """Blocks for which a cell holds about ``of_cell`` examples."""
    return max(2, int(np.ceil(np.sqrt(examples / of_cell))))


def tournament(teams: int) -> list[list[tuple[int, int]]]:
    """Rounds of pairs of an even number of teams; every two meet once."""
    ring = list(range(teams - 1))
    return [[(teams - 1, ring[r]), *((ring[(r + i) % (teams - 1)], ring[(r - i) % (teams - 1)]) for i in range(1, teams // 2))] for r in range(teams - 1)]


def first_params(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Normal numbers of deviation 0.1, drawn by id; the last column, the bias, starts at 0."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(2 * (width - 1), dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    uniform = ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    a, b = uniform[:, : width - 1], uniform[:, width - 1 :]
    return np.hstack([0.1 * np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b), np.zeros((len(ids), 1))])


def loss_and_slopes(config: Config, u: np.ndarray, i: np.ndarray, o: np.ndarray | None, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Losses of examples and their slopes by the rows of user, item and, for BPR, other item. The last column is the bias."""
    score = lambda item: (u[:, :-1] * item[:, :-1]).sum(axis=1) + u[:, -1] + item[:, -1]
    if config.objective == "bce":
        s = score(i)
        loss = weights * (np.maximum(s, 0) - s * labels + np.log1p(np.exp(-np.abs(s))))
        slope = weights * (1 / (1 + np.exp(-s)) - labels)
    else:
        s = score(i) - score(o)
        loss = weights * (np.maximum(-s, 0) + np.log1p(np.exp(-np.abs(s))))
        slope = -weights / (1 + np.exp(s))
    g = slope[:, None]
    toward = i[:, :-1] if o is None else i[:, :-1] - o[:, :-1]
    of_user = np.hstack([g * toward, g if o is None else np.zeros_like(g)])
    of_item = np.hstack([g * u[:, :-1], g])
    if config.bias != "user_item":
        of_user[:, -1] = 0
    if config.bias == "none":
        of_item[:, -1] = 0
    return loss, of_user, of_item, None if o is None else -of_item


def _adagrad(params: np.ndarray, squares: np.ndarray, at: np.ndarray, slopes: np.ndarray, config: Config) -> None:
    rows, where = np.unique(at, return_inverse=True)
    order = np.argsort(where, kind="stable")
    total = np.add.reduceat(slopes[order], np.flatnonzero(np.diff(where[order], prepend=-1)), axis=0)
    total[:, :-1] += config.decay * params[rows, :-1]
    squares[rows] += total**2
    params[rows] -= config.rate * total / np.sqrt(squares[rows] + 1e-8)


def step(config: Config, users: dict, items: dict, cell: dict) -> float:
    """Mini-batches of a cell in their given order, on the blocks in place; the sum of losses before each step."""
    u, i = np.searchsorted(users["ids"], cell["users"]), np.searchsorted(items["ids"], cell["items"])
    o = np.searchsorted(items["ids"], cell["others"]) if config.objective == "bpr" else None
    lost = 0.0
    for at in range(0, len(u), config.batch):
        s = slice(at, at + config.batch)
        up, ip, op = users["params"], items["params"], None if o is None else items["params"][o[s]]
        loss, gu, gi, go = loss_and_slopes(config, up[u[s]], ip[i[s]], op, cell["labels"][s], cell["weights"][s])
        lost += float(loss.sum())
        _adagrad(users["params"], users["squares"], u[s], gu, config)
        _adagrad(items["params"], items["squares"], i[s] if o is None else np.concatenate([i[s], o[s]]), gi if go is None else np.vstack([gi, go]), config)
    return lost


def _hash_block(key: Column, n: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n)).cast("int")


def _cells(examples: DataFrame, config: Config) -> DataFrame:
    """(round, turn, block, blobs): the examples of each cell in a seeded order, one row a cell."""
    b, rounds = config.blocks, tournament(2 * config.blocks) if config.objective == "bpr" else tournament(2 * config.blocks)[:1]
    lookup = {(x, y): (r, p) for r, pairs in enumerate(rounds) for p, (c, d) in enumerate(pairs) for x, y in ((c, d), (d, c))}
    at = {r: [next(p for p, pair in enumerate(pairs) if x in pair) for x in range(2 * b)] for r, pairs in enumerate(rounds)}
    table = lambda value: F.array(*(F.lit(value(x, y)) for x in range(2 * b) for y in range(2 * b)))
    met, pair = table(lambda x, y: lookup.get((x, y), (-1, -1))[0]), table(lambda x, y: lookup.get((x, y), (-1, -1))[1])
    own = F.array(*(F.lit(at[r][x]) for r in range(len(rounds)) for x in range(2 * b)))
    held = examples.select(
        F.col("user_id").cast("long").alias("users"), F.col("item_id").cast("long").alias("items"), F.coalesce(F.col("other_id"), F.col("item_id")).cast("long").alias("others"), F.col("label").cast("double").alias("labels"), F.col("weight").cast("double").alias("weights")
    ).where("users is not null and items is not null and weights is not null")
    held = held.withColumns({"k": _hash_block(F.col("users"), b, 1), "x": _hash_block(F.col("items"), 2 * b, 2), "y": _hash_block(F.col("others"), 2 * b, 2), "h": F.xxhash64("users", "items", "others", F.lit(config.seed))})
    alone = F.pmod(F.col("h"), F.lit(len(rounds))).cast("int")  # two items of one block meet in any round
    place = (F.col("x") * (2 * b) + F.col("y") + 1).cast("int")
    same = F.lit(config.objective == "bce") | (F.col("x") == F.col("y"))
    held = held.withColumn("round", F.when(same, alone).otherwise(F.element_at(met, place)))
    held = held.withColumn("pair", F.when(same, F.element_at(own, (F.col("round") * (2 * b) + F.col("x") + 1).cast("int"))).otherwise(F.element_at(pair, place)))
    held = held.withColumn("turn", F.pmod(F.col("pair") - F.col("k"), F.lit(b)).cast("int")).drop("x", "y", "pair")
    kinds = ", ".join(f"{c} binary" for c in _CELL)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            blobs = {c: pa.array([whole[c].to_numpy().astype("<f8" if c in _CELL[3:] else "<i8").tobytes()], pa.binary()) for c in _CELL}
            return pa.RecordBatch.from_pydict({c: pa.array([whole[c][0].as_py()], pa.int32()) for c in ("round", "turn", "k")} | blobs)

        parts: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("round").to_numpy() * (b * b) + batch.column("turn").to_numpy() * b + batch.column("k").to_numpy()
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            for start, end in zip(starts, np.append(starts, len(key))[1:], strict=True):
                piece = batch.slice(start, end - start)
                if parts and any(parts[0].column(c)[0].as_py() != piece.column(c)[0].as_py() for c in ("round", "turn", "k")):
                    yield packed(parts)
                    parts = []
                parts.append(piece)
        if parts:
            yield packed(parts)

    ordered = held.repartition("round", "turn", "k").sortWithinPartitions("round", "turn", "k", "h", "users", "items", "others", "labels", "weights").drop("h")
    return ordered.select("round", "turn", "k", *_CELL).mapInArrow(pack, f"round int, turn int, k int, {kinds}")


def _small(x: np.ndarray) -> bytes:
    """A column of a cell in few bytes: codes of up to 256 different floats, or whole numbers of 4 bytes, where that is exact."""
    if x.dtype.kind == "f":
        table, codes = np.unique(x, return_inverse=True)
        if len(table) <= 256:
            return b"t" + len(table).to_bytes(2, "little") + table.astype("<f8").tobytes() + codes.astype("u1").tobytes()
    elif len(x) and -(2**31) <= x.min() and x.max() < 2**31:
        return b"i" + x.astype("<i4").tobytes()
    return b"p" + x.tobytes()


def _whole(blob: bytes, kind: str) -> np.ndarray:
    if blob[:1] == b"t":
        n = int.from_bytes(blob[1:3], "little")
        return np.frombuffer(blob, "<f8", n, 3)[np.frombuffer(blob, "u1", offset=3 + 8 * n)]
    return np.frombuffer(blob, "<i4", offset=1).astype("<i8") if blob[:1] == b"i" else np.frombuffer(blob, kind, offset=1)


def _first_state(examples: DataFrame, config: Config) -> DataFrame:
    """Blocks of users and items with first parameters."""
    items = examples.select(F.col("item_id").alias("id")).unionByName(examples.select(F.col("other_id").alias("id")))
    side = lambda df, kind, n, salt: df.where("id is not null").select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id")).distinct().withColumn("block", _hash_block(F.col("id"), n, salt))
    ids = side(examples.select(F.col("user_id").alias("id")), "u", config.blocks, 1).unionByName(side(items, "i", 2 * config.blocks, 2))

    def first(table: pa.Table) -> pa.Table:
        own = np.sort(table["id"].to_numpy())
        p = first_params(own, config.dim + 1, config.seed + (table["kind"][0].as_py() == "i"))
        return pa.table({"kind": table["kind"][:1], "block": table["block"][:1], "ids": [own.tobytes()], "params": [p.tobytes()], "squares": [np.zeros_like(p).tobytes()]})

    return ids.groupBy("kind", "block").applyInArrow(first, _STATE)


def _opened(row: dict, width: int) -> dict:
    return {"ids": np.frombuffer(row["ids"], "<i8")} | {c: np.frombuffer(row[c], "<f8").reshape(-1, width).copy() for c in ("params", "squares")}


def epochs(examples: DataFrame, config: Config) -> Iterator[DataFrame]:
    """The state after each epoch. ``examples``: user_id, item_id, other_id (null for BCE), label, weight; rows with a null
    user, item or weight take no part, repeated rows count each, no rows give an empty state."""
    b, width = config.blocks, config.dim + 1
    rounds = tournament(2 * b) if config.objective == "bpr" else tournament(2 * b)[:1]
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    names = [c for c in _CELL if c != "others" or config.objective == "bpr"]  # the only one that BCE doesn't read
    kinds = {c: "<f8" if c in _CELL[3:] else "<i8" for c in names}

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                small = {c: pa.array([_small(np.frombuffer(row.column(c)[0].as_buffer(), kinds[c]))], pa.binary()) for c in names}
                yield pa.RecordBatch.from_pydict({c: row.column(c) for c in ("round", "turn", "k")} | small)

    # every stratum of every epoch moves cells, so they are stored as small as they get
    small = _cells(examples, config).select("round", "turn", "k", *names).mapInArrow(shrink, "round int, turn int, k int, " + ", ".join(f"{c} binary" for c in names))
    cells, state = cut(small), cut(_first_state(examples, config))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        users = next((_opened(r, width) for r in rows if r["kind"] == "u"), None)
        held = [(r["block"], _opened(r, width)) for r in rows if r["kind"] == "i"]
        cell = next((r for r in rows if r["kind"] == "c"), None)
        if cell and users and held:
            both = {c: np.concatenate([x[c] for _, x in held]) for c in ("ids", "params", "squares")}
            order = np.argsort(both["ids"])
            both = {c: x[order] for c, x in both.items()}
            step(config, users, both, {c: _whole(cell[c], kinds[c]) for c in names})
            for _, x in held:
                at = np.searchsorted(both["ids"], x["ids"])
                x["params"], x["squares"] = both["params"][at], both["squares"][at]
        out = [(r["block"], "u", users) for r in rows if r["kind"] == "u"] + [(n, "i", x) for n, x in held]
        return pa.table({"kind": [k for _, k, _ in out], "block": pa.array([n for n, _, _ in out], pa.int32())} | {c: pa.array([x[c].tobytes() for _, _, x in out], pa.binary()) for c in ("ids", "params", "squares")})

    for _ in range(config.epochs):
        for r, pairs in enumerate(rounds):
            at = [next(p for p, pair in enumerate(pairs) if x in pair) for x in range(2 * b)]
            for turn in range(b):
                slot = F.when(F.col("kind") == "u", F.col("block")).otherwise(F.pmod(F.element_at(F.array(*map(F.lit, at)), F.col("block") + 1) - turn, F.lit(b)))
                own = cells.where((F.col("round") == r) & (F.col("turn") == turn)).select(F.col("k").alias("slot"), F.lit("c").alias("kind"), F.col("k").alias("block"), *none("ids", "params", "squares"), *names)
                rows = state.select(slot.alias("slot"), "*", *none(*names)).unionByName(own)
                state = rows.groupBy("slot").applyInArrow(run, _STATE)
        state = cut(state)  # strata in between feed only the next one, so an epoch is one job
        yield state


def parameters(state: DataFrame, dim: int) -> DataFrame:
    """(kind, id, vec, bias) of a state's blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, p = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["params"], "<f8").reshape(-1, dim + 1)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * dim + 1, dim), pa.int32()), pa.array(p[:, :-1].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([row["kind"]] * len(ids)), pa.array(ids), vec, pa.array(p[:, -1])], names=["kind", "id", "vec", "bias"])

    return state.mapInArrow(rows, "kind string, id long, vec array<double>, bias double")


def folded(params: DataFrame) -> DataFrame:
    """(kind, id, vec) whose inner products are scores: each side's bias meets a 1 of the other."""
    one, bias = F.array(F.lit(1.0)), F.array("bias")
    return params.select("kind", "id", F.when(F.col("kind") == "u", F.concat("vec", one, bias)).otherwise(F.concat("vec", bias, one)).alias("vec"))


@dataclass(frozen=True)
class Fit:
    params: DataFrame
    epoch: int
    figures: list[float]


def fit(examples: DataFrame, config: Config = Config(), figure: Callable[[DataFrame], float] | None = None, every: int = 1) -> Fit:
    """Parameters of the last epoch, or, with a ``figure`` of parameters, of the epoch with the best one: it is taken
    each ``every`` epochs, a gain counts beyond 1e-12, and training ends after ``patience`` figures without a gain."""
    best, waited, figures = None, 0, []
    for n, state in enumerate(epochs(examples, config), 1):
        if figure is None or n % every:
            last = n, state
            continue
        params = parameters(state, config.dim)
        figures.append(figure(params))
        if best is None or figures[-1] > best[2] + 1e-12:
            best, waited = (n, params, figures[-1]), 0
        else:
            waited += 1
        if waited >= config.patience:
            break
    if best is None:
        return Fit(parameters(last[1], config.dim), last[0], figures)
    return Fit(best[1], best[0], figures)


def with_config(config: Config, **changed) -> Config:
    """A configuration that differs in exactly the named fields."""
    return replace(config, **changed)


def scored(params: DataFrame, examples: DataFrame) -> DataFrame:
    """``examples`` with their score, and for BPR triples the other item's."""
    held = folded(params)
    side = lambda kind, key, name: held.where(F.col("kind") == kind).select(F.col("id").alias(key), F.col("vec").alias(name))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    both = examples.join(side("u", "user_id", "uv"), "user_id").join(side("i", "item_id", "iv"), "item_id").join(side("i", "other_id", "ov"), "other_id", "left")
    return both.select(*examples.columns, dot("uv", "iv").alias("score"), dot("uv", "ov").alias("other_score"))
