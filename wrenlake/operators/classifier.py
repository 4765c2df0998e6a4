"""Multi-label classifiers fitted per fold, with unknown labels left out.

One network a fold: standardised inputs, hidden layers with rectifiers (none: logistic regression for each label), a logit per
label.  An epoch is one or more passes over row groups; in a pass every task sums the gradients of all folds' networks over its rows,
each row for the folds that it isn't held out from, and tasks' sums are added in a second, smaller stage.  After each epoch every row is
scored by the network that hasn't seen it, and a fold stops when its masked area under the curve hasn't risen for a while.
Entries without weight add nothing to loss, gradient or area.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stash
from .metrics import auc_by_class, early_stop

Weights = list[np.ndarray]  # for each layer a matrix and a row of offsets

#: Sums of this many tasks are added by the driver; of more tasks, they are first added by the square root of their number.
FEW_TASKS = 32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def log_loss(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each entry and its slope by the logit."""
    return np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x))), sigmoid(x) - y


def focal(x: np.ndarray, y: np.ndarray, alpha: float = 0.25, gamma: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    loss, slope = log_loss(x, y)
    present = y >= 0.5
    p = sigmoid(x)
    miss = np.where(present, 1 - p, p)
    weight = np.where(present, alpha, 1 - alpha) * miss**gamma
    turn = np.where(present, -1.0, 1.0) * gamma * (1 - miss)  # slope of the logarithm of miss**gamma
    return weight * loss, weight * (turn * loss + slope)


def asymmetric(x: np.ndarray, y: np.ndarray, gamma: float = 4.0, clip: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(x)
    low = np.maximum(p, clip)
    rest = np.maximum(1 - low, 1e-8)
    loss = -y * np.log(np.maximum(p, 1e-8)) - (1 - y) * low**gamma * np.log(rest)
    absent = np.where((p > clip) & (1 - low > 1e-8), -(gamma * low ** (gamma - 1) * np.log(rest) - low**gamma / rest) * p * (1 - p), -np.where(p > clip, gamma * low ** (gamma - 1) * np.log(rest) * p * (1 - p), 0))
    return loss, np.where(p > 1e-8, -y * (1 - p), 0) + (1 - y) * absent


LOSSES = {"log": log_loss, "focal": focal, "asymmetric": asymmetric}


def start(sizes: list[int], seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    out: Weights = []
    for a, b in zip(sizes, sizes[1:]):
        bound = 1 / math.sqrt(a)
        out += [rng.uniform(-bound, bound, (a, b)), np.zeros((1, b))]
    return out


def forward(w: Weights, x: np.ndarray) -> list[np.ndarray]:
    """What comes out of each layer, the inputs first and the logits last."""
    out = [x]
    for i in range(0, len(w), 2):
        z = out[-1] @ w[i] + w[i + 1]
        out.append(z if i + 2 == len(w) else np.maximum(z, 0))
    return out


def gradient(w: Weights, x: np.ndarray, y: np.ndarray, m: np.ndarray, loss: Callable) -> tuple[Weights, float, float]:
    """Summed gradients, loss and weight of entries."""
    layers = forward(w, x)
    value, slope = loss(layers[-1], y)
    d, out = slope * m, [np.empty(0)] * len(w)
    for i in range(len(w) - 2, -1, -2):
        a = layers[i // 2]
        out[i], out[i + 1] = a.T @ d, d.sum(0, keepdims=True)
        if i:
            d = (d @ w[i].T) * (a > 0)
    return out, float((value * m).sum()), float(m.sum())


class Adam:
    """Steps with decoupled decay of weights; offsets decay too."""

    def __init__(self, w: Weights, rate: float, decay: float):
        self.rate, self.decay, self.t = rate, decay, 0
        self.first, self.second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def step(self, w: Weights, g: Weights, share: float) -> Weights:
        """``share`` of the full rate."""
        self.t += 1
        rate, out = self.rate * share, []
        for i, (x, d) in enumerate(zip(w, g)):
            self.first[i] = 0.9 * self.first[i] + 0.1 * d
            self.second[i] = 0.999 * self.second[i] + 0.001 * d * d
            move = (self.first[i] / (1 - 0.9**self.t)) / (np.sqrt(self.second[i] / (1 - 0.999**self.t)) + 1e-8)
            out.append(x * (1 - rate * self.decay) - rate * move)
        return out


def summed(rows: DataFrame, add: Callable[[dict[str, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of ``add(columns of a batch)``, ``size`` numbers; tasks' sums are added in two stages where they are many."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(columns(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("s"):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    sums = rows.mapInArrow(part, "s binary")
    tasks = rows.rdd.getNumPartitions()
    if tasks > FEW_TASKS:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(more, "s binary")
    total = np.zeros(size)
    for r in sums.toLocalIterator():
        total += np.frombuffer(r.s)
    return total


def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {"fold": batch.column("fold").fill_null(-1).to_numpy(zero_copy_only=False)}
    for c in ("x", "y", "m"):
        out[c] = np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1)
    return out


def packed(w: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w])


def unpacked(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([x.size for x in like])[:-1]
    return [part.reshape(x.shape) for part, x in zip(np.split(flat, cuts), like)]


class Fitted:
    """Networks by fold, the scale of inputs, and (fold, epoch, loss, auc) of every epoch."""

    def __init__(self, nets: dict[int, Weights], scale: dict[int, tuple[np.ndarray, np.ndarray]], history: list[tuple[int, int, float, float]]):
        self.nets, self.scale, self.history = nets, scale, history

    def scores(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, fold, j, p): every row by the network of its fold; rows of no fold by the mean of all networks."""
        nets, scale = self.nets, self.scale
        schema = f"{key} {dict(rows.dtypes)[key]}, fold int, p array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                cells = columns(batch)
                each = {f: sigmoid(forward(nets[f], (cells["x"] - scale[f][0]) * scale[f][1])[-1]) for f in nets}
                p = np.mean(list(each.values()), axis=0)
                for f, own in each.items():
                    p[cells["fold"] == f] = own[cells["fold"] == f]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(cells["fold"], pa.int32()), lists], names=[key, "fold", "p"])

        return rows.mapInArrow(run, schema)


def fold_aucs(scored: DataFrame, rows: DataFrame, key: str) -> dict[int, float]:
    """The mean area under the curve of each fold's held-out rows over labels that have both kinds among entries with weight; 0 without any."""
    each = scored.join(rows.select(key, "y", "m"), key).select("fold", F.posexplode(F.arrays_zip("p", "y", "m")).alias("j", "e")).where("e.m > 0")
    each = each.select(F.concat_ws(":", "fold", "j").alias("g"), F.col("e.p").alias("p"), F.col("e.y").alias("y"))
    per = auc_by_class(each, "g", "p", "y").groupBy(F.split("g", ":")[0].cast("int").alias("fold")).agg(F.avg("auc").alias("auc"))
    return {r.fold: r.auc for r in per.collect()}


def stopped(history: list[tuple[int, int, float, float]], spark, patience: int) -> set[int]:
    """Folds whose area hasn't risen for ``patience`` epochs."""
    out = set()
    for fold in {f for f, *_ in history}:
        own = spark.createDataFrame([(e, a) for f, e, _, a in history if f == fold], "epoch long, auc double")
        if early_stop(own, "epoch", "auc", patience).where("stop").head(1):
            out.add(fold)
    return out


def fit_folds(rows: DataFrame, key: str, folds: int, hidden: tuple[int, ...] = (), loss: str = "focal", epochs: int = 50, patience: int = 5, rate: float = 1e-3, decay: float = 1e-2, groups: int = 1, seed: int = 42) -> Fitted:
    """Fit a network for each fold on the rows of the others; the best epoch of each is kept.

    ``rows``: key, fold (null or negative: of no fold, for training by none), x (inputs), y (labels, 0 to 1), m (weights, 0 where
    a label is unknown); arrays of equal length in every row, without nulls.  ``groups``: passes an epoch, each over rows of
    another hash, so that a step needs no more than its share of the rows.  The rate falls from ``rate`` by a half cosine over ``epochs``.
    """
    spark = rows.sparkSession
    rows = stash(rows.select(key, F.coalesce("fold", F.lit(-1)).cast("int").alias("fold"), *(F.col(c).cast("array<double>").alias(c) for c in "xym"), F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("turn")), "training")
    first = rows.select(F.size("x"), F.size("y")).head()
    if first is None:
        return Fitted({}, {}, [])
    d, c = first
    own = np.arange(folds)
    train = rows.where("fold >= 0")

    def spread(cells: dict[str, np.ndarray]) -> np.ndarray:
        # by fold; what others have is what a fold trains on
        out = np.zeros((folds, 2 * d + 1))
        for f in own:
            x = cells["x"][cells["fold"] == f]
            out[f] = np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        return out.ravel()

    by_fold = summed(train, spread, folds * (2 * d + 1)).reshape(folds, -1)
    scale = {}
    for f in own.tolist():
        s = by_fold.sum(0) - by_fold[f]
        n = max(s[-1], 1.0)
        mean = s[:d] / n
        scale[f] = mean, 1 / np.sqrt(np.maximum(s[d : 2 * d] / n - mean**2, 1e-12))
    nets = {f: start([d, *hidden, c], seed) for f in own.tolist()}
    best = {f: (-1.0, w) for f, w in nets.items()}
    solver = {f: Adam(w, rate, decay) for f, w in nets.items()}
    length, history, live = sum(x.size for x in nets[0]), [], set(nets)
    for epoch in range(epochs):
        share = 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        losses = dict.fromkeys(live, 0.0)
        for turn in range(groups):
            now = {f: nets[f] for f in live}

            def add(cells: dict[str, np.ndarray]) -> np.ndarray:
                out = np.zeros((folds, length + 2))
                for f, w in now.items():
                    on = cells["fold"] != f
                    if on.any():
                        g, value, weight = gradient(w, (cells["x"][on] - scale[f][0]) * scale[f][1], cells["y"][on], cells["m"][on], LOSSES[loss])
                        out[f] = np.concatenate([packed(g), [value, weight]])
                return out.ravel()

            sums = summed(train.where(F.col("turn") == turn) if groups > 1 else train, add, folds * (length + 2)).reshape(folds, -1)
            for f in live:
                weight = max(sums[f, -1], 1.0)
                losses[f] += sums[f, -2] / weight / groups
                nets[f] = solver[f].step(nets[f], unpacked(sums[f, :-2] / weight, nets[f]), share)
        held = rows.where(F.col("fold").isin(*live))
        aucs = fold_aucs(Fitted({f: nets[f] for f in live}, scale, []).scores(held, key), held, key)
        for f in sorted(live):
            history.append((f, epoch, losses[f], aucs.get(f, 0.0)))
            if aucs.get(f, 0.0) > best[f][0]:
                best[f] = aucs.get(f, 0.0), nets[f]
        live -= stopped([h for h in history if h[0] in live], spark, patience)
        if not live:
            break
    return Fitted({f: w for f, (_, w) in best.items()}, scale, history)
