"""Centroid clustering by kd-tree filtering, exact on whole numbers.

Vectors become whole numbers, ``floor(scale * x)``.  Each task packs its vectors into kd-trees of bounded size, whose nodes
hold count, sums and box; the trees are written once and read in every round.  A round walks down the trees, level by
level, with the centroids still possible: a centroid goes where another one is nearer at every point of the box (or as
near everywhere, with a smaller number); a node with one centroid left is assigned whole, by its count and sums; the vectors
of leaves are compared with what is left.  Only counts and sums of clusters leave a task.

All comparisons are exact: trees hold numbers up to 2**21, for which products of double precision are; vectors with larger
ones are kept apart and compared by Python's whole numbers.

Defined results: vectors that are null, of another width, or with a null or non-finite component have no row; repeated rows,
equal ids and null ids keep a row each; centroids start from fewer vectors where there are fewer; an empty table gives an
empty result; other columns are dropped; a distance or inertia beyond a long is given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, tidy

TREE = 8192  # vectors of a tree
GROUP = 16 << 20  # bytes of a row group of trees
LEAF = 32  # vectors from which a node is split
EXACT = 2**21  # the largest number in a tree: products of 64 components stay below 2**53
LONG = 2**63 - 1
LIMB = 40  # bits of a part of a sum


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as Python's whole numbers; exact for any finite double."""
    out = np.empty(x.shape, object)
    out.flat = [int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return out


def build(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the vectors, and a row for each node, parents first: children (-1: leaf), first and last vector, box, sums."""
    order, width = np.arange(len(q)), q.shape[1]
    nodes, todo = [], [(0, len(q), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = q[order[a:b]]
        low, high = own.min(0), own.max(0)
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        row = np.empty(4 + 3 * width, np.int64)
        row[:4] = -1, -1, a, b
        row[4:] = np.concatenate([low, high, own.sum(0)])
        nodes.append(row)
        i = int((high - low).argmax())
        if b - a <= LEAF or low[i] == high[i]:
            continue
        left = 2 * own[:, i] <= low[i] + high[i]
        if not len(own) // 16 < left.sum() < len(own) - len(own) // 16:  # a lopsided half: the median instead
            middle = np.partition(own[:, i], len(own) // 2)[len(own) // 2]
            left = own[:, i] < middle if middle > low[i] else own[:, i] <= middle
        cut = a + int(left.sum())
        order[a:b] = np.concatenate([order[a:b][left], order[a:b][~left]])
        todo += [(cut, b, len(nodes) - 1, 1), (a, cut, len(nodes) - 1, 0)]
    return order, np.stack(nodes)


def walk(nodes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes that one centroid owns whole and their owners; leaves left over and which centroids are possible there."""
    width, k = centres.shape[1], len(centres)
    size = (centres**2).sum(1)
    apart = np.abs(centres[:, None] - centres[None])
    level, live = np.zeros(1, np.int64), np.ones((1, k), bool)
    done: tuple[list, ...] = ([], [], [], [])
    while len(level):
        low, high = (nodes[level, 4 + i * width : 4 + (i + 1) * width].astype(float) for i in (0, 1))
        score = size - (low + high) @ centres.T  # twice the distance to the middle of the box, less what is the same for all
        best = np.where(live, score, np.inf).argmin(1)
        spread = np.empty_like(score)
        for z in np.unique(best):
            own = best == z
            spread[own] = (high - low)[own] @ apart[z].T
        gain = score - score[np.arange(len(level)), best][:, None] - spread  # twice the least lead of the best in the box
        live &= (gain < 0) | (gain == 0) & (np.arange(k) <= best[:, None])
        sure = live.sum(1) == 1
        leaf = ~sure & (nodes[level, 0] < 0)
        for at, x in enumerate((level[sure], best[sure], level[leaf], live[leaf])):
            done[at].append(x)
        inner = ~sure & ~leaf
        level, live = nodes[level[inner], :2].ravel(), np.repeat(live[inner], 2, axis=0)
    return tuple(np.concatenate(x) for x in done)  # type: ignore[return-value]


def places(nodes: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors below the nodes, and for each the place of its node in ``some``."""
    n = nodes[some, 3] - nodes[some, 2]
    which = np.repeat(np.arange(len(some)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + nodes[some, 2][which], which


def nearest(q: np.ndarray, centres: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
    """The nearest possible centroid of each vector, the smaller number on ties."""
    some = np.arange(len(centres)) if live is None else np.flatnonzero(live.any(0))
    c = centres[some]
    score = (c**2).sum(1) - 2 * (q @ c.T)
    if live is not None:
        score[~live[:, some]] = np.inf
    return some[score.argmin(1)] if len(q) else np.zeros(0, np.int64)


class Tree:
    """A stored tree, or a pack of vectors with large numbers."""

    def __init__(self, row: dict, scale: int, width: int):
        self.large = row["nodes"] is None
        self.points = np.frombuffer(row["points"], float if self.large else np.int32).reshape(-1, width)
        self.nodes = None if self.large else np.frombuffer(row["nodes"], np.int64).reshape(-1, 4 + 3 * width)
        self.scale = scale

    def numbers(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and centroids in the one kind in which they can be compared exactly; ``centres`` are Python's numbers."""
        if self.large or any(abs(v) > EXACT for v in centres.flat):
            return (whole(self.points, self.scale) if self.large else self.points.astype(object)), centres
        return self.points.astype(float), centres.astype(float)

    def owners(self, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The centroid of every vector; nodes that were assigned whole and their owners."""
        none = np.zeros(0, np.int64)
        if c.dtype == object:
            return np.concatenate([nearest(q[a : a + 256], c) for a in range(0, len(q), 256)]), none, none
        sure, owner, leaves, live = walk(self.nodes, c)
        out = np.empty(len(q), np.int64)
        at, which = places(self.nodes, sure)
        out[at] = owner[which]
        at, which = places(self.nodes, leaves)
        out[at] = nearest(q[at], c, live[which])
        return out, sure, owner

    def sums(self, centres: np.ndarray, count: list[int], total: np.ndarray) -> None:
        """Add counts and sums of the vectors of each centroid."""
        q, c = self.numbers(centres)
        owner, sure, theirs = self.owners(q, c)
        rest = np.ones(len(q), bool)
        if len(sure):
            width = q.shape[1]
            rest[places(self.nodes, sure)[0]] = False
            for z in np.unique(theirs):
                total[z] += self.nodes[sure[theirs == z], 4 + 2 * width :].sum(0).astype(object)
        for z in np.unique(owner):
            own = owner == z
            count[z] += int(own.sum())
            if (own & rest).any():
                part = q[own & rest].sum(0)
                total[z] += part if part.dtype == object else part.astype(np.int64).astype(object)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {"ids": batch.column("ids")[i].values, "points": batch.column("points")[i].as_buffer(), "nodes": batch.column("nodes")[i].as_buffer()}
    tidy()


def plant(rows: DataFrame, scale: int, width: int) -> DataFrame:
    """Kd-trees of the vectors of each task: ids, points and nodes.  ``rows``: id, v (array of doubles)."""
    kind = rows.schema["id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, TREE):
                held.append(batch.slice(a, TREE))
                if sum(x.num_rows for x in held) >= TREE:
                    yield from trees(held)
                    held = []
        if any(x.num_rows for x in held):
            yield from trees(held)
        tidy()

    def trees(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("id").combine_chunks()
        x = np.concatenate([np.asarray(c.flatten()) for c in table.column("v").chunks]).reshape(-1, width)
        large = (np.abs(x) > EXACT / scale).any(1)
        for own, is_large in ((np.flatnonzero(~large), False), (np.flatnonzero(large), True)):
            if not len(own):
                continue
            nodes = None
            if is_large:
                points = x[own]
            else:
                q = np.floor(x[own] * scale)
                order, found = build(q)
                own, points, nodes = own[order], q[order].astype(np.int32), found.tobytes()
            part = ids.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), part), pa.array([points.tobytes()], pa.binary()), pa.array([nodes], pa.binary())], names=["ids", "points", "nodes"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("points", T.BinaryType()), T.StructField("nodes", T.BinaryType())])
    return rows.mapInArrow(pack, schema)


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """A whole number as parts that Spark can add up as longs."""
    sign, x, i = (-1, -x, 0) if x < 0 else (1, x, 0)
    while x:
        yield i, sign * (x & (1 << LIMB) - 1)
        x, i = x >> LIMB, i + 1


def one_round(trees: DataFrame, centres: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after one assignment of all vectors; those without vectors stay."""
    c = np.array(centres, object)
    k, width = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, np.zeros((k, width), object)
        for row in rows_of(batches):
            Tree(row, scale, width).sums(c, count, total)
        out = [(z, i, limb, v) for z in range(k) for i, s in enumerate([count[z], *total[z]]) for limb, v in limbs(int(s))]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(4)], names=["z", "i", "limb", "s"])

    sums = [[0] * (width + 1) for _ in range(k)]
    # at most k * (width + 1) sums of a few parts each come to the driver
    for r in trees.mapInArrow(run, "z long, i long, limb long, s long").groupBy("z", "i", "limb").agg(F.sum("s").alias("s")).collect():
        sums[r.z][r.i] += r.s << (LIMB * r.limb)
    return [[s // own[0] for s in own[1:]] if own[0] else old for own, old in zip(sums, centres)]


def centroid_clusters(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, seed: int = 2, width: int = 64, scale: int = 256) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256): every kept vector and its cluster.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:key`` (ties: by key, then by vector).
    ``rounds`` times each becomes the floor of its vectors' mean; then vectors are assigned once more.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kept = kept.where(F.size("v") == width).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(name, "id", "v").limit(k).collect()
    kind = rows.schema[key].dataType
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    schema = T.StructType([T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in names[1:4]), T.StructField(names[4], T.StringType())])
    if not first:
        return spark.createDataFrame([], schema)
    centres = [whole(np.array(r.v, float), scale).tolist() for r in first]
    trees = stash(plant(kept, scale, width), "trees", GROUP)
    for _ in range(rounds):
        centres = one_round(trees, centres, scale)
    c = np.array(centres, object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            tree = Tree(row, scale, width)
            q, own = tree.numbers(c)
            owner = tree.owners(q, own)[0]
            far = ((q - own[owner]) ** 2).sum(1)
            far = [min(int(x), LONG) for x in far] if far.dtype == object else far.astype(np.int64)
            yield pa.RecordBatch.from_arrays([row["ids"], pa.array(owner, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])

    found = stash(trees.mapInArrow(assign, T.StructType([T.StructField("id", kind), *schema.fields[1:3]])), "assigned")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    per = [(z, min(s, LONG), min(sum(sums.values()), LONG), hashlib.sha256(",".join(map(str, centres[z])).encode()).hexdigest()) for z, s in sorted(sums.items())]
    # one row a cluster: at most k
    table = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias(key), *names)
