"""Reduction by a neighbour graph: fuzzy weights of near neighbours, and the smoothest coordinates on their graph.

Each row gives its nearest neighbour weight 1 and the others less, so that the weights add up to the logarithm of their number; the
weight of a link is that either end gives it.  Coordinates are the leading eigenvectors of the links divided by the roots of the ends'
weights, without the first, which is the same for all of a component: those along which neighbours differ least.  They are found by
subspace iteration: polynomials of the graph are applied to a few columns, by panels of rows that are sent to all panels and joined with the
links between two, and small matrices of their products, which alone come to the driver, turn the columns into orthogonal ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import stash
from .neighbours import BLOCK, Index, distinct, neighbours, numbers, record

SPARE = 6  # columns beyond those asked for; they speed up the others
DEGREE = 8  # of the polynomial that is applied between two turns
TURNS = 12
PANELS = 12  # panels that rows are dealt into, as long as none exceeds PANEL rows; a product sends all columns to each
PANEL = 1 << 18
STATE = "p int, x binary, b binary"


def fuzzy(d: np.ndarray) -> np.ndarray:
    """Weights of neighbours at ascending distances; endless ones have none.

    The least positive distance counts as none; beyond it weights fall off so that all add up to the binary logarithm of the neighbours' number, as
    far as that can be met.
    """
    held = np.isfinite(d)
    aim = np.log2(np.maximum(held.sum(1), 1))
    positive = np.where((d > 0) & held, d, np.inf).min(1, initial=np.inf)
    over = np.where(held, np.maximum(d - np.where(np.isfinite(positive), positive, 0)[:, None], 0), np.inf)
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    width = np.ones(len(d))
    for _ in range(64):
        total = np.exp(-over / width[:, None]).sum(1)
        large = total > aim
        high, low = np.where(large, width, high), np.where(large, low, width)
        width = np.where(np.isinf(high), width * 2, (low + high) / 2)
    mean = np.where(held, d, 0).sum() / max(1, held.sum())
    return np.exp(-over / np.maximum(width, 1e-3 * mean + 1e-300)[:, None])


def neighbour_graph(near: DataFrame, metric: str = "euclid") -> DataFrame:
    """(i, j, w): the links of both directions.  ``near`` is what ``neighbours`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            n = near.value_lengths().to_numpy(zero_copy_only=False)
            flat = near.flatten()
            d = np.full((len(n), max(1, n.max(initial=0))), np.inf)
            on = np.arange(d.shape[1])[None] < n[:, None]
            d[on] = flat.field("d").to_numpy(zero_copy_only=False)
            w = fuzzy(d**2 / 2 if metric == "cosine" else d)
            yield record("i long, j long, w double", np.repeat(np.asarray(batch.column("id")), n), flat.field("id"), w[on])

    one = near.select("id", "near").mapInArrow(run, "i long, j long, w double").where("w > 0")
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    either = F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)
    return both.groupBy("i", "j").agg(either.alias("w"))


def names_apart(spark: SparkSession, count: int) -> list[int]:
    """Numbers whose checksums fall into different ones of ``count`` partitions, so that no task gets two panels."""
    x = spark.range(count * (20 + count.bit_length())).select(F.col("id").cast("int").alias("id"))
    found = x.groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("at")).agg(F.min("id").alias("id"))
    names = sorted(r.id for r in found.collect())
    return names if len(names) == count else list(range(count))


class Panels:
    """A few columns over the rows of a graph (i, j, w), a panel of rows a row: (p, x, b), both of ``count`` numbers for each of its rows.

    ``links`` holds, for each two panels with links between them, the graph divided by the roots of its ends' weights, by rows.
    """

    def __init__(self, graph: DataFrame, panels: int = PANELS, rows: int = PANEL):
        degree = stash(graph.groupBy("i").agg(F.sum("w").alias("d")), "degrees")
        self.n = degree.count()
        self.parts = max(panels, math.ceil(self.n / rows))
        names = names_apart(degree.sparkSession, self.parts)
        panel = F.element_at(F.lit(names), F.pmod(F.xxhash64("i"), F.lit(self.parts)).cast("int") + 1)
        homes = degree.groupBy(panel.alias("p")).agg(F.sort_array(F.collect_list(F.struct("i", "d"))).alias("r"))
        self.homes = stash(homes, "panels")
        self.names = sorted(r.p for r in self.homes.select("p").collect())  # with few rows some have none
        at = self.homes.select("p", F.posexplode("r").alias("at", "r")).select("p", "at", "r.i", "r.d")
        ends = graph.join(at, "i").join(at.select(F.col("p").alias("q"), F.col("at").alias("to"), F.col("i").alias("j"), F.col("d").alias("e")), "j")

        def pack(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(["at", "to"])
            starts = np.flatnonzero(np.diff(own["at"].to_numpy(), prepend=-1))
            cells = [own["at"].to_numpy()[starts].astype(np.int64), starts.astype(np.int64), own["to"].to_numpy().astype(np.int64), own["s"].to_numpy()]
            return pd.DataFrame([[own["p"].iloc[0], own["q"].iloc[0], *(c.tobytes() for c in cells)]], columns=["p", "q", "rows", "starts", "cols", "s"])

        scaled = ends.select("p", "q", "at", "to", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("s"))
        pairs = stash(scaled.groupBy("p", "q").applyInPandas(pack, "p int, q int, rows binary, starts binary, cols binary, s binary"), "links")
        # every product joins on it; what is lost is read again
        self.links = pairs.repartition(self.parts, "p").sortWithinPartitions("p").persist()

    def close(self) -> None:
        self.links.unpersist()

    def columns(self, count: int, seed: int) -> DataFrame:
        """Columns of numbers from checksums."""
        x = F.flatten(F.transform("r", lambda r: F.array(*(F.xxhash64(F.lit(seed + k), r["i"]) / float(2**63) for k in range(count)))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p, v in zip(batch.column("p").to_pylist(), batch.column("x")):
                    yield record(STATE, [p], [np.asarray(v.values).tobytes()], [None])

        return stash(self.homes.select("p", x.alias("x")).mapInArrow(run, STATE), "columns")

    def turned(self, state: DataFrame, by: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, p in enumerate(batch.column("p").to_pylist()):
                    yield record(STATE, [p], [(numbers(batch, "x", i, len(by)) @ by).tobytes()], [None])

        return state.select("p", "x", "b").mapInArrow(run, STATE)

    def sums(self, state: DataFrame, count: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over panels of ``f(x, b)``: a small matrix."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, p in enumerate(batch.column("p").to_pylist()):
                    x = numbers(batch, "x", i, count)
                    b = numbers(batch, "b", i, count) if batch.column("b")[i].is_valid else x
                    yield record("p int, f binary", [p], [f(x, b).tobytes()])

        found = sorted((r.p, bytes(r.f)) for r in state.mapInArrow(run, "p int, f binary").collect())
        return np.sum([np.frombuffer(v) for _, v in found], axis=0)

    def product(self, state: DataFrame, count: int, then: Callable[[np.ndarray, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(p, x, b): what ``then`` makes of the graph times x, of x and of b.

        A panel's columns go to all panels, and each adds up its rows in one task; ``state`` is read once.
        """
        panels = len(self.names)
        far = state.select(F.explode(F.lit(self.names)).alias("p"), F.col("p").alias("q"), "x", "b")
        far = far.select("p", "q", (F.col("p") != F.col("q")).alias("other"), "x", F.when(F.col("p") == F.col("q"), F.col("b")).alias("b"))
        far = far.repartition(self.parts, "p")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = 0
            for batch in batches:
                for i, (p, other) in enumerate(zip(batch.column("p").to_pylist(), batch.column("other").to_pylist())):
                    x = numbers(batch, "x", i, count)
                    if not other:
                        own, now, met = p, x.copy(), 0
                        b = numbers(batch, "b", i, count).copy() if batch.column("b")[i].is_valid else None
                        y = np.zeros((count, len(x)))
                    elif not met or p != own:
                        raise ValueError(f"columns of panel {p} came in parts")
                    met += 1
                    if batch.column("rows")[i].is_valid:
                        rows, starts, cols = (numbers(batch, c, i, kind=np.int64) for c in ("rows", "starts", "cols"))
                        s = numbers(batch, "s", i)
                        for c, column in enumerate(np.ascontiguousarray(x.T)):
                            y[c, rows] += np.add.reduceat(column[cols] * s, starts)
                    if met == panels:
                        yield record(STATE, [own], *([v.tobytes()] for v in then(np.ascontiguousarray(y.T), now, b)))
                        met = 0
            if met:
                raise ValueError(f"panel {own} met {met} of {panels}")

        # a panel has all its rows in one partition; with both numbers as keys, links would be dealt anew
        links = self.links.select(F.col("p").alias("l"), F.col("q").alias("m"), "rows", "starts", "cols", "s").hint("merge")
        met = far.join(links, (F.col("p") == F.col("l")) & (F.col("q") - F.col("m") == 0), "left").drop("l", "m")
        return met.sortWithinPartitions("p", "other", "q").mapInArrow(run, STATE)  # the panel itself comes first

    def smooth(self, state: DataFrame, count: int, low: float, high: float) -> DataFrame:
        """A polynomial that is small for eigenvalues from ``low`` to ``high`` and grows fast above."""
        middle, half = (low + high) / 2, (high - low) / 2

        def step(y: np.ndarray, x: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            return ((y - x * middle) * (1 / half) if before is None else (y - x * middle) * (2 / half) - before), x

        for _ in range(DEGREE):  # each step is used by the two after it
            state = self.product(state, count, step)
        return stash(state, "columns")

    def largest(self, state: DataFrame, count: int) -> list[float]:
        """Each column's entry that is greatest in size, that of the least row if several are."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x = numbers(batch, "x", i, count)
                    at = np.abs(x).argmax(0)
                    ids = np.asarray(batch.column("ids")[i].values)[at]
                    yield record("c int, v double, i long", np.arange(count, dtype=np.int32), x[at, np.arange(count)], ids)

        found = state.join(self.homes.select("p", F.col("r.i").alias("ids")), "p").select("x", "ids").mapInArrow(run, "c int, v double, i long").collect()
        return [max((abs(r.v), -r.i, r.v) for r in found if r.c == c)[2] for c in range(count)]

    def rows(self, state: DataFrame, count: int, by: np.ndarray) -> DataFrame:
        """(i, x0, ...): a row for each row of the graph, of the columns times ``by``."""
        schema = "i long, " + ", ".join(f"x{k} double" for k in range(by.shape[1]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield record(schema, np.asarray(batch.column("ids")[i].values), *(numbers(batch, "x", i, count) @ by).T)

        return state.join(self.homes.select("p", F.col("r.i").alias("ids")), "p").select("x", "ids").mapInArrow(run, schema)


def eigenvectors(graph: DataFrame, count: int, turns: int = TURNS, good: float = 1e-7, seed: int = 42) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(i, x0, ...): the ``count`` leading eigenvectors of the scaled graph, their values and how far each is from being one.

    Iteration ends when all are within ``good``, or after ``turns``.  The entry of each vector that is greatest in size is positive.  Vectors of
    equal values are some basis of theirs.  There are no more than rows.
    """
    panels = Panels(graph)
    try:
        n = panels.n
        m = min(n, count + SPARE)
        x = panels.columns(m, seed)
        low, high = -1.0, 0.0
        for turn in range(turns + 1):
            g = panels.sums(x, m, lambda x, b: x.T @ x).reshape(m, m)
            size = np.sqrt(np.maximum(np.diag(g), 1e-300))
            value, vector = np.linalg.eigh(g / np.outer(size, size))
            keep = value > 1e-13 * max(value.max(initial=0), 1e-300)
            basis = vector[:, keep] / np.sqrt(value[keep]) / size[:, None]
            m = basis.shape[1]  # columns that have become alike go
            both = stash(panels.product(panels.turned(x, basis), m, lambda y, x, b: (x, y)), "columns")
            h = panels.sums(both, m, lambda x, y: x.T @ y).reshape(m, m)
            value, vector = np.linalg.eigh((h + h.T) / 2)
            value, vector = value[::-1], vector[:, ::-1]
            want = min(count, m)
            off = panels.sums(both, m, lambda x, y, turn=vector[:, :want], by=value[:want]: ((y @ turn - x @ turn * by) ** 2).sum(0))
            away = np.sqrt(off)
            x = panels.turned(both, vector)
            if (away < good).all() or turn == turns or m == n:
                break
            high = float(min(value[-1], 0.999))
            x = panels.smooth(x, m, low, max(high, low + 1e-3))
        by = np.eye(m)[:, :want] * np.where(np.array(panels.largest(x, m)) < 0, -1.0, 1.0)[:want]
        return stash(panels.rows(x, m, by), "vectors"), value[:want], away
    finally:
        panels.close()


def spectral_layout(rows: DataFrame, key: str, vector: str, dims: int = 2, k: int = 30, metric: str = "cosine", block: int = BLOCK, turns: int = TURNS) -> DataFrame:
    """(key, z): ``dims`` coordinates of every row that has a vector of finite numbers, by its ``k`` nearest others.

    By ``cosine``, vectors are first set to length 1 and distances are one less the cosine.  Equal vectors have equal coordinates; they are scaled so
    that the mean square of each over distinct vectors is 1.  With fewer distinct vectors than ``dims`` + 2 all are 0.  Where the graph has
    several components, some coordinates tell them apart.
    """
    if metric == "cosine":
        rows = rows.select(key, V.unit(V.doubles(F.col(vector))).alias(vector))
    kept, few, width = distinct(rows, key, vector)
    few = stash(few, "distinct")
    index = Index(few, width, block)
    if index.n < dims + 2:
        return kept.select(F.col("id").alias(key), F.array_repeat(F.lit(0.0), dims).alias("z"))
    vectors, _, _ = eigenvectors(stash(neighbour_graph(neighbours(index, k), metric), "graph"), dims + 1, turns)
    root = math.sqrt(index.n)
    own = vectors.select("i", F.array(*(F.col(f"x{c + 1}") * root for c in range(dims))).alias("z"))
    named = few.select(F.col("id").alias("i"), "v").join(own, "i").select("v", "z")
    return kept.join(named, "v").select(F.col("id").alias(key), "z")
