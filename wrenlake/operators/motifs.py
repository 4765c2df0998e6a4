"""Prototype motifs: medoids, soft assignment of frames, features per segment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import stash

#: The most numbers of prototypes that are sent to all tasks at once (64 MB); more are taken in parts.
MOST_NUMBERS = 8 << 20


def frames_of(embedding: Column, length: int, width: int) -> Column:
    """``length`` frames of ``width`` numbers of one vector."""
    v = V.doubles(embedding)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.slice(v, t * width + 1, width))


def mean_pool(frames: Column) -> Column:
    """Mean of the frames of a row."""
    first = F.transform(F.get(frames, F.lit(0)), lambda x: x * 0.0)
    total = F.aggregate(frames, first, lambda s, f: F.zip_with(s, f, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(frames))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, i, c): mean of each dimension, summed before the shuffle."""
    return rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("c"))


def medoids(rows: DataFrame, key: str, group: str, vector: str, places: int = 9) -> DataFrame:
    """(group, key, p): the member nearest to its group's centroid, least key among equals."""
    c = centroids(rows, group, vector).groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("c"))
    d = rows.join(c, group).withColumn("d", F.round(V.squared_distance(F.col(vector), F.col("c")), places))
    best = d.groupBy(group).agg(F.min_by(F.struct(F.col(key), F.col(vector).alias("p")), F.struct("d", key)).alias("b"))
    return best.select(group, "b.*")


Put = Callable[[np.ndarray, np.ndarray, np.ndarray, list], pd.DataFrame]


def prototype_parts(prototypes: DataFrame, k: str, p: str) -> tuple[list[DataFrame], int]:
    """The prototypes in parts of a bounded number of numbers, and how many there are; one part is usual."""
    kept = stash(prototypes.select(k, p), "prototypes")
    r = kept.agg(F.count("*").alias("n"), F.max(F.size(p)).alias("w")).head()
    parts = -(-r.n * (r.w or 1) // MOST_NUMBERS)
    if parts <= 1:
        return [kept] * parts, r.n
    parts *= 2  # hashes deal unevenly
    return [kept.where(F.pmod(F.xxhash64(k), F.lit(parts)) == i) for i in range(parts)], r.n


def prototype_matrix(prototypes: DataFrame, k: str, p: str) -> tuple[list, np.ndarray]:
    """Ids and rows of a part of the prototypes, for tasks to multiply with."""
    rows = prototypes.orderBy(k).collect()
    return [r[k] for r in rows], np.array([r[p] for r in rows], float)


def scores(frames: np.ndarray, protos: np.ndarray, metric: str, temperature: float) -> np.ndarray:
    """Each frame's cosine or negative squared distance to the prototypes, over the temperature."""
    if metric == "cosine":
        a = frames / np.maximum(np.linalg.norm(frames, axis=1, keepdims=True), V.TINY)
        b = protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), V.TINY)
        s = a @ b.T
    else:
        s = -np.maximum((frames**2).sum(1)[:, None] + (protos**2).sum(1)[None] - 2 * frames @ protos.T, 0)
    return s / temperature


def weights(frames: np.ndarray, protos: np.ndarray, metric: str, temperature: float) -> np.ndarray:
    """Softmax over prototypes of each frame's scores."""
    s = scores(frames, protos, metric, temperature)
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def stacked(column: pd.Series) -> np.ndarray:
    return np.array([f for row in column for f in row], float)


def over_prototypes(segments: DataFrame, key: str, frames: str, parts: list[DataFrame], k: str, p: str, metric: str, temperature: float, put: Put, schema: str) -> DataFrame:
    """Rows of ``schema``, which begins with the key, that ``put(keys, frames by segment, weights, ids)`` makes.  One product per batch, no join.

    More prototypes than tasks can hold are taken in parts: a first pass over the segments for each part finds the greatest score and the sum
    of exponentials of every frame, which are added up by segment; a second one has its part's weights from them.  Then ``put`` sees the weights
    of one part at a time, and each part's rows are stored.
    """
    segments = segments.select(key, frames).where(F.size(frames) > 0)
    if not parts:
        return segments.sparkSession.createDataFrame([], schema)
    if len(parts) == 1:
        ids, matrix = prototype_matrix(parts[0], k, p)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield put(b[key].to_numpy(), b[frames].map(len).to_numpy(), weights(stacked(b[frames]), matrix, metric, temperature), ids)

        return segments.mapInPandas(run, schema)
    segments = stash(segments.select(F.monotonically_increasing_id().alias("_row"), key, frames), "segments")

    def tops(part: DataFrame) -> DataFrame:
        ids, matrix = prototype_matrix(part, k, p)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(ids):
                    s = scores(stacked(b[frames]), matrix, metric, temperature)
                    top = s.max(1)
                    cut = np.cumsum(b[frames].map(len).to_numpy())[:-1]
                    yield pd.DataFrame({"_row": b["_row"], "_m": np.split(top, cut), "_s": np.split(np.exp(s - top[:, None]).sum(1), cut)})

        return stash(segments.select("_row", frames).mapInPandas(run, "_row long, _m array<double>, _s array<double>"), "tops")

    each = reduce(DataFrame.unionByName, [tops(part) for part in parts])  # a row a segment and part

    def joined(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(F.greatest(x["m"], y["m"]).alias("m"), (x["s"] * F.exp(x["m"] - F.greatest(x["m"], y["m"])) + y["s"] * F.exp(y["m"] - F.greatest(x["m"], y["m"]))).alias("s")))

    pairs = F.zip_with("_m", "_s", lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    sums = each.groupBy("_row").agg(F.collect_list(pairs).alias("_l")).select("_row", F.reduce(F.slice("_l", 2, 1 << 30), F.get("_l", F.lit(0)), joined).alias("_n"))
    known = stash(segments.join(sums, "_row").select(key, frames, F.col("_n.m").alias("_m"), F.col("_n.s").alias("_s")), "norms")

    def second(part: DataFrame) -> DataFrame:
        ids, matrix = prototype_matrix(part, k, p)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(ids):
                    s = scores(stacked(b[frames]), matrix, metric, temperature)
                    w = np.exp(s - np.concatenate(b["_m"].to_list())[:, None]) / np.concatenate(b["_s"].to_list())[:, None]
                    yield put(b[key].to_numpy(), b[frames].map(len).to_numpy(), w, ids)

        return stash(known.mapInPandas(run, schema), "weights")

    return reduce(DataFrame.unionByName, [second(part) for part in parts])


def soft_assign(segments: DataFrame, key: str, frames: str, prototypes: DataFrame, k: str = "k", p: str = "p", metric: str = "cosine", temperature: float = 0.1) -> DataFrame:
    """(key, t, k, w): weight of each prototype at each frame.

    Segments without frames (null or none) give no rows; nor do any without prototypes.
    """

    def put(keys: np.ndarray, n: np.ndarray, w: np.ndarray, ids: list) -> pd.DataFrame:
        t = np.concatenate([np.arange(x) for x in n])
        return pd.DataFrame({key: np.repeat(np.repeat(keys, n), len(ids)), "t": np.repeat(t, len(ids)), "k": np.tile(ids, len(w)), "w": w.ravel()})

    return over_prototypes(segments, key, frames, prototype_parts(prototypes, k, p)[0], k, p, metric, temperature, put, f"{key} {dict(segments.dtypes)[key]}, t int, k int, w double")


def motif_features(segments: DataFrame, key: str, frames: str, prototypes: DataFrame, k: str = "k", p: str = "p", metric: str = "cosine", temperature: float = 0.1) -> DataFrame:
    """(key, k, hist, mx, spread, noise): sum, maximum and population deviation of weights over a segment's frames, and its noise.

    A segment's frames stand in one row, so nothing is shuffled unless prototypes are taken in parts.  Segments without frames (null or none) give no
    rows; nor do any without prototypes.  Keys are distinct.
    """
    parts, total = prototype_parts(prototypes, k, p)
    split, scale = len(parts) > 1, np.log(total) if total > 1 else 1.0

    def put(keys: np.ndarray, n: np.ndarray, w: np.ndarray, ids: list) -> pd.DataFrame:
        at = np.cumsum(n) - n
        hist, top = np.add.reduceat(w, at), np.maximum.reduceat(w, at)
        mean = hist / n[:, None]
        dev = np.sqrt(np.add.reduceat((w - np.repeat(mean, n, axis=0)) ** 2, at) / n[:, None])
        own = np.add.reduceat(-w * np.log(w + 1e-10), at) / n[:, None] / scale  # each prototype's part of the noise
        own = own if split else np.repeat(own.sum(1, keepdims=True), len(ids), axis=1)
        return pd.DataFrame({key: np.repeat(keys, len(ids)), "k": np.tile(ids, len(keys)), "hist": hist.ravel(), "mx": top.ravel(), "spread": dev.ravel(), "noise": own.ravel()})

    schema = f"{key} {dict(segments.dtypes)[key]}, k int, hist double, mx double, spread double, noise double"
    out = over_prototypes(segments, key, frames, parts, k, p, metric, temperature, put, schema)
    return out.withColumn("noise", F.sum("noise").over(Window.partitionBy(key))) if split else out


def traces(segments: DataFrame, key: str, frames: str, prototypes: DataFrame, k: str = "k", p: str = "p", metric: str = "cosine", temperature: float = 0.1) -> DataFrame:
    """(key, k, w): the weights of each prototype along a segment's frames, in order; segments without frames give no rows."""

    def put(keys: np.ndarray, n: np.ndarray, w: np.ndarray, ids: list) -> pd.DataFrame:
        own = np.split(w, np.cumsum(n)[:-1])
        return pd.DataFrame({key: np.repeat(keys, len(ids)), "k": np.tile(ids, len(keys)), "w": [c for x in own for c in x.T]})

    return over_prototypes(segments, key, frames, prototype_parts(prototypes, k, p)[0], k, p, metric, temperature, put, f"{key} {dict(segments.dtypes)[key]}, k int, w array<double>")


def runs(trace: Column, cut: float) -> Column:
    """(density, n_runs, longest): share of frames with a weight over ``cut``, their runs without a gap, and the longest run; within the row."""
    start = F.struct(F.lit(0).alias("on"), F.lit(0).alias("now"), F.lit(0).alias("n_runs"), F.lit(0).alias("longest"))

    def step(s: Column, w: Column) -> Column:
        over = F.coalesce(w > cut, F.lit(False))
        now = F.when(over, s["now"] + 1).otherwise(0)
        return F.struct((s["on"] + over.cast("int")).alias("on"), now.alias("now"), (s["n_runs"] + (now == 1).cast("int")).alias("n_runs"), F.greatest(s["longest"], now).alias("longest"))

    return F.aggregate(trace, start, step, lambda s: F.struct((s["on"] / F.size(trace)).alias("density"), s["n_runs"].alias("n_runs"), s["longest"].alias("longest")))


def dominant(features: DataFrame, key: str, places: int = 6) -> DataFrame:
    """(key, k): the prototype with the greatest sum, the first among equals."""
    return features.groupBy(key).agg(F.max_by("k", F.struct(F.round("hist", places), -F.col("k"))).alias("k"))


def contingency(dominants: DataFrame, labels: DataFrame, key: str, species: str) -> DataFrame:
    """(k, species, n, p): labels per dominant prototype and their share of it."""
    n = dominants.join(labels, key).groupBy("k", species).agg(F.sum("y").alias("n"))
    total = n.groupBy("k").agg(F.sum("n").alias("t"))
    return n.join(total, "k").select("k", species, "n", (F.col("n") / F.greatest("t", F.lit(1e-10))).alias("p"))


def purity(counts: DataFrame, species: int) -> DataFrame:
    """(k, n, purity): one less the entropy of the species of a prototype, over all ``species``, absent ones included."""
    eps = 1e-10
    total = F.sum("n")
    q = counts.join(counts.groupBy("k").agg(total.alias("t")), "k").withColumn("q", F.col("n") / F.greatest("t", F.lit(eps)) + eps)
    agg = q.groupBy("k").agg(F.max("t").alias("n"), F.sum("q").alias("s"), F.sum(F.col("q") * F.log("q")).alias("e"), F.count("*").alias("c"))
    z = F.col("s") + (species - F.col("c")) * eps
    e = F.col("e") + (species - F.col("c")) * eps * float(np.log(eps))
    return agg.select("k", "n", (1 - (F.log(z) - e / z) / float(np.log(species))).alias("purity"))
