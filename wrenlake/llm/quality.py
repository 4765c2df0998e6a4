"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

``statistics`` turns each whole text into a fixed vector.  ``fit`` standardises the labelled rows,
maps them by random cosines (an approximation of a Gaussian kernel) and sums the normal equations per
partition and fold.  Each fold is scored by the solution of the others; these scores are binned, and isotonic
regression over the bins calibrates them.  The solution of all folds scores, in one pass without shuffle.

Defined results: null text is empty and scored like any other; repeated rows are repeated; without
labels of both classes every score is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bytes_of, int_lists, is_held_out, slices, stash, word_hashes

#: The bound on labelled rows that a model is fitted on; above it, those with the least hash.
MOST_LABELLED = 200_000
FEATURES = 256
WIDTH = 1.0  # of the kernel, times the root of the number of statistics
RIDGE = 1e-3
BINS = 400
FOLDS = 5
CUT = 0.3

# Byte classes that statistics count.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b"#*$%&|<>", b"!?", b".", b",", b":;", b"'\"()[]{}", b"-_=+/\\~^`@", bytes(range(128, 256)), bytes(range(32)) + b"\x7f"]
CLASS_OF = np.zeros(256, np.int64)
for _i, _chars in enumerate(CLASSES, 1):
    CLASS_OF[np.frombuffer(_chars, np.uint8)] = _i
N_STATS = len(CLASSES) + 13


def describe(text: bytes, h: np.ndarray) -> list[float]:
    """Statistics of one text with word hashes ``h``: logs of sizes, shares of byte classes, and how much lines, words and pairs repeat."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    data = np.frombuffer(text, np.uint8)
    hist = np.bincount(data, minlength=256)
    classes = np.bincount(CLASS_OF, hist, len(CLASSES) + 1)[1:] / n
    share = hist[hist > 0] / n
    m = len(h)
    if m:
        _, counts = np.unique(h, return_counts=True)
        distinct, top = len(counts) / m, counts.max() / m
        spread = float(-(counts / m * np.log(counts / m)).sum()) / max(1.0, math.log(m))
    else:
        distinct = top = spread = 0.0
    same = float(np.mean(h[1:] == h[:-1])) if m > 1 else 0.0
    pairs = len(np.unique(h[1:] * np.uint64(31) + h[:-1])) / (m - 1) if m > 1 else 1.0
    triples = len(np.unique((h[2:] * np.uint64(31) + h[1:-1]) * np.uint64(31) + h[:-2])) / (m - 2) if m > 2 else 1.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    edge = np.flatnonzero(np.diff(SPACE[data], prepend=True, append=True))
    sizes = (edge[1::2] - edge[0::2]).astype(np.float64) if m else np.zeros(1)
    return [*classes, math.log1p(n), math.log1p(m), sizes.mean(), sizes.std(), distinct, top, spread, same, pairs, triples, len(set(lines)) / k, math.log1p(n / k), float(-(share * np.log(share)).sum())]


def describe_all(column: pa.Array) -> list[np.ndarray]:
    texts = bytes_of(column)
    h, at = word_hashes(texts)
    return [np.array(describe(t, h[a:b]), np.float32) for t, a, b in zip(texts, at.tolist(), at[1:].tolist())]


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and ``x``, the statistics, of every whole text."""
    schema = f"{id_column} {dict(docs.dtypes)[id_column]}, x array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            yield pa.RecordBatch.from_arrays([batch.column(id_column), int_lists(describe_all(batch.column(text_column)), pa.float32())], names=[id_column, "x"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores at the knots

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.turn + self.phase) * math.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1) if len(self.weights) else np.full(len(x), self.values[0])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), N_STATS)


def partition_sums(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum over all rows of ``add(x, y, fold)`` (``size`` numbers): one partial sum per partition of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(matrix(batch.column("x")), *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("y", "fold")))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    return sum((np.frombuffer(r.s) for r in rows.select("x", "y", "fold").mapInArrow(run, "s binary").collect()), np.zeros(size))


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit: neighbours that fall are pooled."""
    return np.repeat(*zip(*[(p[0], p[2]) for p in pooled(y, weight)]))


def pooled(y: np.ndarray, weight: np.ndarray) -> list[list[float]]:
    """Value, weight and number of neighbours in each pool of the fit; equal ones are one pool."""
    pools: list[list[float]] = []
    for value, w in zip(y, weight):
        pools.append([value, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return pools


def calibrated(count: np.ndarray, ones: np.ndarray, share: float) -> np.ndarray:
    """Non-decreasing shares of ones over bins: bins are pooled first, then each pool is drawn to ``share`` by half a row."""
    pools = pooled(ones / count, count)
    size = [int(p[2]) for p in pools]
    value = np.array([(p[0] * p[1] + share / 2) / (p[1] + 0.5) for p in pools])
    return np.repeat(isotonic(value, np.array([p[1] for p in pools])), size)


def known(labels: DataFrame, id_column: str = "doc_id", label: str = "quality", most: int = MOST_LABELLED, seed: int = 7) -> DataFrame:
    """(id, y): the labels that a model is fitted on, about ``most`` of those that aren't held out; of several for an id the highest."""
    truth = labels.where(F.col(id_column).isNotNull() & F.col(label).isin(0, 1)).where(~is_held_out(F.col(id_column)))
    truth = truth.groupBy(id_column).agg(F.max(label).cast("double").alias("y"))
    total = truth.count()
    if total > most:
        truth = truth.where(F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / total))
    return truth


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality", most: int = MOST_LABELLED, seed: int = 7) -> Model:
    """Fit on labelled rows that aren't held out, and calibrate on what each fold scores without its own rows.

    The sample is bounded by ``most``; what comes to the driver is a bounded number of sums.
    """
    truth = known(labels, id_column, label, most, seed)
    total = truth.count()
    rows = stats.join(truth, id_column).withColumn("fold", F.pmod(F.xxhash64(id_column), F.lit(FOLDS)))
    rows = stash(rows.select("x", "y", "fold").repartition(max(1, min(total, most) // 10_000)), "quality-train")
    d, rng = N_STATS, np.random.default_rng(seed)
    sums = partition_sums(rows, 2 * d + 2, lambda x, y, fold: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum()]]))
    n, good = sums[-2], sums[-1]
    share = good / n if n else 0.5
    mean = sums[:d] / max(n, 1)
    scale = 1 / np.sqrt(np.maximum(sums[d : 2 * d] / max(n, 1) - mean**2, 1e-6))
    model = Model(mean, scale, rng.standard_normal((d, FEATURES)) / (WIDTH * math.sqrt(d)), rng.uniform(0, 2 * math.pi, FEATURES), np.empty(0), np.zeros(1), np.full(1, share))
    if not 0 < good < n:
        return model
    k = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([np.concatenate([(z[on].T @ z[on]).ravel(), z[on].T @ y[on]]) for on in (fold == f for f in range(FOLDS))])

    sums = partition_sums(rows, FOLDS * (k * k + k), normal).reshape(FOLDS, -1)

    def solved(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[: k * k].reshape(k, k) + RIDGE * np.eye(k), s[k * k :])

    model.weights = solved(sums.sum(0))
    others = np.array([solved(sums.sum(0) - s) for s in sums])

    def binned(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        raw = np.einsum("ij,ij->i", model.features(x), others[fold.astype(int)])
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)])

    count, ones, raw = partition_sums(rows, 3 * BINS, binned).reshape(3, BINS)
    seen = count > 0
    value = calibrated(count[seen], ones[seen], share)
    model.knots = raw[seen] / count[seen]
    model.values = value + 1e-6 * np.arange(len(value))  # keeps the order of scores within a pool
    # beyond the outer knots scores go on rising or falling a little, so that they still rank
    model.knots = np.concatenate([[model.knots[0] - 1], model.knots, [model.knots[-1] + 1]])
    model.values = np.concatenate([[model.values[0] * 0.5], model.values, [(1 + model.values[-1]) / 2]])
    return model


def score(stats: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """``id`` and ``score`` of every row."""
    schema = f"{id_column} {dict(stats.dtypes)[id_column]}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(model.score(matrix(batch.column("x"))), pa.float64())], names=[id_column, "score"])

    return stats.select(id_column, "x").mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: float = CUT) -> DataFrame:
    """Held-out flag, score and prediction of every document."""
    stats = stash(statistics(docs, id_column, text_column), "quality-stats")
    scored = score(stats, fit(stats, labels, id_column), id_column)
    return scored.select(id_column, is_held_out(F.col(id_column)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: float = CUT) -> DataFrame:
    """The documents that score ``cut`` or more, all columns as they are.

    The model is fitted first, on the statistics of labelled texts alone; the filter then scores texts where they stand, so no
    text is shuffled and each is described once.
    """
    ids = F.broadcast(known(labels, id_column).select(id_column))  # about MOST_LABELLED ids at most
    stats = stash(statistics(docs.join(ids, id_column, "left_semi"), id_column, text_column), "quality-stats")
    model = fit(stats, labels, id_column)

    text = f"c{docs.columns.index(text_column)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            x = np.array(describe_all(batch.column(text))).astype(np.float64)
            yield batch.filter(pa.array(model.score(x) >= cut))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots don't go through tasks
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
