"""Exact nearest neighbours by a metric index: pivots, blocks of near rows, and bounds by the triangle inequality.

Equal vectors are one row with a count.  Rows are ordered by their nearest pivot and the distance to it and cut into blocks;
a block keeps the range of its distances to every pivot.  No row of one block can be nearer to a row of another than these
ranges are apart, so a block meets only the blocks within the distance that its rows have found among themselves, the nearer first, and of
those only what is within the distances found by then.  Bounds between blocks are compared in slices, so no task or driver sees them
all; a task holds a panel of blocks and one more at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stash

BLOCK = 2048  # rows of a block
PIVOTS = 32
SAMPLE = 1024  # rows that pivots are taken from
SLICE = 1024  # blocks whose bounds are compared in one step
PANELS = 12  # panels of blocks that are searched for, each in one task
PANEL = 1 << 17  # rows of a panel; with more than so many for each, there are more panels
SPARE = 6  # more neighbours than asked for, found by products; their distances are then taken from differences
SLACK = 1e-12  # share of squared sizes by which squared distances from products may be off
CHUNK = 128  # rows whose products are taken at once, so that these stay in the cache
CROWD = 64  # if more rows than so many for each are within reach of a block, all its distances are compared
HELD = 16  # found rows for each of a block's that are collected before they are put in order
TINY, HUGE = 1e-12, 1e15  # squares of sizes between these are told apart by 32-bit numbers


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(-1))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs by products, and how far off they may be."""
    a, b = (x**2).sum(1), (y**2).sum(1)
    return a[:, None] + b[None] - 2 * (x @ y.T), SLACK * (a.max(initial=0) + b.max(initial=0))


def numbers(batch: pa.RecordBatch, name: str, i: int, width: int = 0, kind=float) -> np.ndarray:
    """A binary cell as numbers, with ``width`` columns if given."""
    x = np.frombuffer(batch.column(name)[i].as_buffer(), kind)
    return x.reshape(-1, width) if width else x


def record(schema: str, *columns) -> pa.RecordBatch:
    """A batch of the columns named in ``schema`` (``name kind, ...``), kinds as in Spark's simple types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def distinct(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, v) that have a vector of the common width with finite numbers; their distinct vectors (id, v, c); the width.

    ``id`` of a distinct vector is the least of its rows', ``c`` their number.  The width is that of the row with the least key.
    """
    x = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    first = x.orderBy("id", F.size("v")).select(F.size("v")).head()
    width = first[0] if first else 0
    x = x.where(F.size("v") == width).where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    x = x.select("id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v"))  # one zero
    return x, x.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("c")).select("id", "v", "c"), width


class Index:
    """Blocks of distinct rows (id, v, c): ``blocks`` has ids, vectors, counts and distances to pivots as binary, and their ranges."""

    def __init__(self, rows: DataFrame, width: int, block: int = BLOCK, pivots: int = PIVOTS):
        rows = stash(rows, "vectors")
        self.n, self.width, spark = rows.count(), width, rows.sparkSession
        # a bounded sample: pivots are far from each other
        some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        self.some = np.array([r.id for r in some], np.int64)
        x = self.sample = np.array([r.v for r in some], float).reshape(len(some), width)
        far, chosen = np.full(len(x), np.inf), []
        for _ in range(min(pivots, len(x))):
            i = int(far.argmax())
            if far[i] == 0:
                break
            chosen.append(i)
            far = np.minimum(far, distance(x, x[i]))
        middle = self.pivots = x[chosen]
        p = self.p = len(middle)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.asarray(batch.column("v").flatten()).reshape(-1, width)
                d = np.stack([distance(v, m) for m in middle], axis=1)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "c")), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "c", "cell", "r"])

        order = ["cell", "r", "id"]
        placed = rows.mapInArrow(place, "id long, v array<double>, c long, cell int, r double")
        self.parts = max(1, math.ceil(self.n / (4 * block)))
        near = placed.repartitionByRange(self.parts, *order).sortWithinPartitions(*order)
        shape = "block long, ids binary, v binary, c binary, far binary, low binary, high binary"

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, made, held = TaskContext.get().partitionId(), 0, None

            def out(ids: np.ndarray, v: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
                d = np.stack([distance(v, m) for m in middle], axis=1)
                return record(shape, [(part << 24) + made], *([a.tobytes()] for a in (ids, v, c, d, d.min(0), d.max(0))))

            for batch in batches:
                new = [np.asarray(batch.column("id")), np.asarray(batch.column("v").flatten()).reshape(-1, width), np.asarray(batch.column("c")), np.asarray(batch.column("cell"))]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
                while len(held[0]) > block:
                    edge = np.flatnonzero(np.diff(held[3][: block + 1])) + 1  # where a cell ends
                    cut = int(edge[-1]) if len(edge) and edge[-1] >= block // 2 else block
                    yield out(*(x[:cut] for x in held[:3]))
                    made, held = made + 1, [x[cut:] for x in held]
            if held is not None and len(held[0]):
                yield out(*held[:3])

        self.blocks = stash(near.mapInArrow(pack, shape), "blocks") if self.n else spark.createDataFrame([], shape)
        self.count, last = self.blocks.agg(F.count("*"), F.max("block")).head()
        self.parts = ((last or 0) >> 24) + 1  # as dealt, which may be more than asked for; panels are shares of them

    def near_blocks(self, bounds: DataFrame) -> DataFrame:
        """(block, others, apart): for each row of ``bounds`` the block itself, at -1, and the blocks that may hold rows within its reach.

        ``bounds``: block, low, high, reach, floor (no distance to the block counts less), alone (blocks with the same number don't meet; null:
        meets all).  Slices of bounds meet pairwise; of a slice, what is out of reach is dropped at once.
        """
        p, slices = self.p, max(1, math.ceil(self.count / SLICE))
        shape = "slice long, blocks binary, lows binary, highs binary, reach binary, floor binary, alone binary"
        cut = bounds.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices))).repartition(slices, "slice")

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: dict[int, list] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    rows.setdefault(r["slice"], []).append(r)
            for s, own in rows.items():
                alone = np.array([-1 if r["alone"] is None else r["alone"] for r in own], np.int64)
                cells = [np.array([r["block"] for r in own], np.int64), *(np.concatenate([np.frombuffer(r[c]) for r in own]) for c in ("low", "high")), np.array([r["reach"] for r in own], float), np.array([r["floor"] for r in own], float), alone]
                yield record(shape, [s], *([x.tobytes()] for x in cells))

        packed = stash(cut.select("slice", "block", "low", "high", "reach", "floor", "alone").mapInArrow(gather, shape), "slices")
        other = packed.select(*(F.col(c).alias(f"o_{c}") for c in ("slice", "blocks", "lows", "highs", "floor", "alone")))
        pairs = packed.withColumn("o_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))).join(other, "o_slice")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    a, b = (numbers(batch, c, i, kind=np.int64) for c in ("blocks", "o_blocks"))
                    low, high, o_low, o_high = (numbers(batch, c, i, p) for c in ("lows", "highs", "o_lows", "o_highs"))
                    reach, floor = numbers(batch, "reach", i), numbers(batch, "o_floor", i)
                    alone, o_alone = (numbers(batch, c, i, kind=np.int64) for c in ("alone", "o_alone"))
                    for j in range(len(a)):
                        apart = np.maximum(o_low - high[j], low[j] - o_high).max(1, initial=0)
                        own = b == a[j]
                        on = own | (within(apart, floor) <= reach[j]) & ((alone[j] < 0) | (alone[j] != o_alone))
                        if on.any():
                            lists = [pa.array([x[on].tolist()], pa.list_(t)) for x, t in ((b, pa.int64()), (np.where(own, -1, apart), pa.float64()))]
                            yield pa.RecordBatch.from_arrays([pa.array([a[j]], pa.int64()), *lists], names=["block", "others", "apart"])

        return pairs.mapInArrow(meet, "block long, others array<long>, apart array<double>")

    def search(self, own: DataFrame, bounds: DataFrame, begin: Callable, visit: Callable, finish: Callable, schema: str, share: float = 1.0, once: tuple[str, ...] = ("far",)) -> DataFrame:
        """Each block meets itself and the blocks within its reach, the nearer first; a panel of consecutive blocks is one task's.

        A block goes once to each panel that holds blocks it may meet, so that what is sent grows with the rows as long as PANEL rows are enough
        for each of PANELS panels.  ``own``: block and more columns of its rows.  ``begin(batch, i)`` makes a state from a block's row,
        ``visit(state, batch, i)`` takes in the row of a block (first the same one; of others the columns ``once`` are null), and ``finish(state)`` gives
        rows of ``schema``.  ``share`` of the rows are searched for, so there are fewer panels; blocks whose reach is under zero have no state.
        """
        blocks = self.blocks.join(own, "block")
        panels = max(1, min(self.count, max(math.ceil(PANELS * share), math.ceil(self.n * share / PANEL))))
        place = F.shiftright("block", 24) * 8 + F.least(F.col("block").bitwiseAND((1 << 24) - 1), F.lit(7))
        panel = F.floor(place * panels / (8 * self.parts)).cast("long")
        pairs = self.near_blocks(bounds).select("block", F.explode(F.arrays_zip("others", "apart")).alias("p")).select("block", F.col("p.others").alias("other"), "p.apart")
        pairs = pairs.where("block <> other").groupBy(panel.alias("panel"), "other").agg(F.min("apart").alias("apart"), F.sort_array(F.collect_list("block")).alias("meets"))
        kinds = dict(blocks.dtypes)
        active = blocks.join(bounds.where("reach >= 0").select("block"), "block", "left_semi")
        self_met = active.select(panel.alias("panel"), F.col("block").alias("other"), F.lit(-1.0).alias("apart"), F.array("block").alias("meets"), *(c for c in blocks.columns if c != "block"))
        met = pairs.join(blocks.withColumns({c: F.lit(None).cast(kinds[c]) for c in once}).withColumnRenamed("block", "other"), "other").select(*self_met.columns)
        met = self_met.unionByName(met).repartitionById(panels, F.col("panel").cast("int")).sortWithinPartitions("panel", "apart", "other")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, states = None, {}
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("panel", "other", "apart", "meets")))
                for i, (panel, other, apart, meets) in enumerate(rows):
                    if panel != now:
                        for state in states.values():
                            yield from finish(state)
                        now, states = panel, {}
                    if apart < 0:
                        states[other] = begin(batch, i)
                    for block in meets:
                        visit(states[block], batch, i)
            for state in states.values():
                yield from finish(state)

        return met.mapInArrow(run, schema)


def within(apart: np.ndarray, floor: np.ndarray | float = 0.0) -> np.ndarray:
    """What a distance from differences can't be less than, rounding included."""
    return np.maximum(apart * (1 - 1e-9) - 1e-9, floor)


def nearest(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of each row's ``k`` nearest rows of ``y`` with another id, no farther than ``reach``; endless and -1 where there are fewer."""
    d, off = squares(x, y)
    d[(ids[:, None] == others[None]) | (d > (reach**2 + off)[:, None])] = np.inf
    m = min(k + SPARE, len(y))
    at = np.argpartition(d, m - 1, axis=1)[:, :m]
    found = np.stack([distance(x, y[at[:, j]]) for j in range(m)], axis=1)
    found[np.isinf(np.take_along_axis(d, at, 1)) | (found > reach[:, None])] = np.inf
    order = np.lexsort((others[at], found), axis=1)[:, :k]
    found, at = np.take_along_axis(found, order, 1), np.take_along_axis(at, order, 1)
    pad = ((0, 0), (0, max(0, k - m)))
    return np.pad(found, pad, constant_values=np.inf), np.pad(np.where(np.isinf(found), -1, at), pad, constant_values=-1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as 32-bit numbers with a one after them, and their squared sizes."""
    half = np.empty((len(x), x.shape[1] + 1), np.float32)
    half[:, :-1], half[:, -1] = x, 1
    return half, (x**2).sum(1)


def candidates(x: np.ndarray, size: np.ndarray, y: np.ndarray, sizes: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of pairs that hold all with a distance up to ``reach``, and few more; None where all are better compared.

    ``x`` and ``size`` are what ``halves`` gives; ``y`` has half of ``sizes``, less than zero, in place of the ones.  A pair is within reach if its
    product is not under a limit; the limit is lowered by what rounding can do.
    """
    top, most = math.sqrt(size.max(initial=0)), math.sqrt(sizes.max(initial=0))
    if not (TINY < top < HUGE and TINY < most < HUGE and np.isfinite(reach).all()):
        return None
    limit = (size - reach**2) / 2
    limit -= (x.shape[1] + 16) * 2.0**-24 * (np.sqrt(size) * most + most**2 / 2 + np.abs(limit))
    limit = limit.astype(np.float32)[:, None]
    rows, cols, left, m = [], [], CROWD * len(x), len(y)
    for a in range(0, len(x), CHUNK):
        at = np.flatnonzero(x[a : a + CHUNK] @ y.T >= limit[a : a + CHUNK])
        left -= len(at)
        if left < 0:
            return None
        rows.append(a + at // m)
        cols.append(at % m)
    return np.concatenate(rows), np.concatenate(cols)


def firsts(state: dict, on: np.ndarray, d: np.ndarray, near: np.ndarray) -> None:
    """Of the neighbours that rows ``on`` have and those in ``d`` and ``near``, the first by distance and id."""
    k = state["d"].shape[1]
    every = np.concatenate([state["d"][on], d], axis=1)
    near = np.concatenate([state["near"][on], near], axis=1)
    order = np.lexsort((near[..., 0], every), axis=1)[:, :k]
    state["d"][on] = np.take_along_axis(every, order, 1)
    state["near"][on] = np.take_along_axis(near, order[..., None], 1)


def settle(state: dict) -> None:
    """Puts what was collected into the rows' neighbours."""
    if not state["held"]:
        return
    row, d, near = (np.concatenate(x) for x in zip(*state["held"]))
    state["held"], state["count"] = [], 0
    order = np.lexsort((near[:, 0], d, row))
    row, d, near = row[order], d[order], near[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    which = np.cumsum(np.diff(row, prepend=-1) != 0) - 1
    rank = np.arange(len(row)) - starts[which]
    some = rank < state["d"].shape[1]
    width = rank[some].max() + 1
    wide, names = np.full((len(starts), width), np.inf), np.zeros((len(starts), width, 2), np.int64)
    wide[which[some], rank[some]], names[which[some], rank[some]] = d[some], near[some]
    firsts(state, row[starts], wide, names)


def neighbours(index: Index, k: int) -> DataFrame:
    """(id, c, near): each distinct row with up to ``k`` nearest distinct others (d, id, c), by distance and id."""
    width, p, middle = index.width, index.p, index.sample.mean(0) if index.n else np.zeros(0)
    shape = "block long, reach double"

    def cells(batch: pa.RecordBatch, i: int) -> list[np.ndarray]:
        return [numbers(batch, "ids", i, kind=np.int64), numbers(batch, "c", i, kind=np.int64), numbers(batch, "v", i, width)]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _, v = cells(batch, i)
                d, _ = nearest(v, ids, v, ids, k, np.full(len(v), np.inf))
                yield record(shape, [batch.column("block")[i].as_py()], [d[:, -1].max()])

    reach = stash(index.blocks.select("block", "ids", "c", "v").mapInArrow(inside, shape), "reach")
    bounds = index.blocks.select("block", "low", "high").join(reach, "block").select("*", F.lit(0.0).alias("floor"), F.col("block").alias("alone"))
    met = {"batch": None, "i": -1}  # the block that a panel's blocks are meeting

    def begin(batch: pa.RecordBatch, i: int) -> dict:
        ids, c, v = cells(batch, i)
        far = numbers(batch, "far", i, p)
        none = np.zeros((len(ids), k), np.int64)
        half, size = halves(v - middle)
        return {"ids": ids.copy(), "c": c.copy(), "v": v.copy(), "half": half, "size": size, "far": far.copy(), "d": np.full((len(ids), k), np.inf), "near": np.stack([none, none], axis=2), "held": [], "count": 0}

    def visit(state: dict, batch: pa.RecordBatch, i: int) -> None:
        if met["batch"] is not batch or met["i"] != i:
            others, c, v = cells(batch, i)
            half, sizes = halves(v - middle)
            half[:, -1] = sizes / -2
            met.update(batch=batch, i=i, others=others, c=c, v=v, half=half, sizes=sizes, low=numbers(batch, "low", i), high=numbers(batch, "high", i))
        others, c, v = met["others"], met["c"], met["v"]
        apart = np.maximum(met["low"] - state["far"], state["far"] - met["high"]).max(1, initial=0)
        on = np.flatnonzero(within(apart) <= state["d"][:, -1])
        if not len(on):
            return
        pairs = candidates(state["half"][on], state["size"][on], met["half"], met["sizes"], state["d"][on, -1])
        if pairs is None:
            settle(state)
            d, at = nearest(state["v"][on], state["ids"][on], v, others, k, state["d"][on, -1])
            firsts(state, on, d, np.stack([np.where(at < 0, 0, x[at]) for x in (others, c)], axis=2))
            return
        row, at = on[pairs[0]], pairs[1]
        d = np.concatenate([np.zeros(0), *(distance(state["v"][row[a : a + 8192]], v[at[a : a + 8192]]) for a in range(0, len(row), 8192))])
        some = (d <= state["d"][row, -1]) & (state["ids"][row] != others[at])
        if some.any():
            state["held"].append((row[some], d[some], np.stack([others[at[some]], c[at[some]]], axis=1)))
            state["count"] += int(some.sum())
            if state["count"] >= HELD * len(state["ids"]):
                settle(state)

    def finish(state: dict) -> Iterator[pa.RecordBatch]:
        settle(state)
        on = np.isfinite(state["d"])
        inner = pa.StructArray.from_arrays([pa.array(state["d"][on]), *(pa.array(state["near"][..., j][on]) for j in (0, 1))], names=["d", "id", "c"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(on.sum(1))]), pa.int32()), inner)
        yield pa.RecordBatch.from_arrays([pa.array(state["ids"]), pa.array(state["c"]), lists], names=["id", "c", "near"])

    return index.search(reach.select("block"), bounds, begin, visit, finish, "id long, c long, near array<struct<d: double, id: long, c: long>>")


def core_of(k: int):
    """The ``k``-th distance, where each neighbour counts as often as its copies and the row's own copies are at no distance."""
    walk = F.aggregate("near", F.struct((F.col("c") - 1).alias("n"), F.when(F.col("c") > k, 0.0).alias("d")), lambda s, x: F.struct((s["n"] + x["c"]).alias("n"), F.when(s["d"].isNotNull(), s["d"]).when(s["n"] + x["c"] >= k, x["d"]).alias("d")))
    return walk["d"]


def core_distances(rows: DataFrame, key: str, vector: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(key, dist): the distance of every row to its ``k``-th nearest other row among all rows.

    Keys are whole numbers.  Rows without a key or a vector of finite numbers, and rows with fewer than ``k`` others, have no
    result; equal vectors are each other's neighbours at distance 0; equal keys are rows of their own.
    """
    kept, few, width = distinct(rows, key, vector)
    near = neighbours(Index(few, width, block), k)
    cores = near.select(F.col("id").alias("first"), core_of(k).alias("dist")).where("dist is not null")
    named = few.select(F.col("id").alias("first"), "v")
    found = cores.join(named, "first")
    return kept.join(found, "v").select(F.col("id").alias(key), "dist")
