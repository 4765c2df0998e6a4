"""Per-group Gaussian mixtures on principal axes, chosen by BIC, on all rows of each group; and what they say of any row.

A model carries all that scoring needs: the mean and axes of its group, and weights, means and full covariances on these axes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: The most rows of a group that are fitted in one task; larger groups are fitted by sums over all partitions.
ONE_TASK = 20_000
STEPS = 200
CHUNK = 256  # rows whose shares are worked out at once
WAVE = 8  # large groups that are fitted side by side; bounds the size of their sums
Mixture = tuple[np.ndarray, np.ndarray, np.ndarray]  # weights, means, covariances


def expect(x: np.ndarray, mixture: Mixture) -> list[np.ndarray]:
    """Log likelihood and, per component, the sums of shares, of differences to its mean and of their outer products.

    Rows are taken CHUNK at a time, so that their differences to all means stay in the processor's cache.
    """
    w, means, covs = mixture
    n, d = x.shape
    k = len(w)
    lows = [np.linalg.cholesky(c) for c in covs]
    turns = [np.linalg.inv(low).T for low in lows]
    base = [np.log(w[j]) - np.log(np.diag(lows[j])).sum() - 0.5 * d * np.log(2 * np.pi) for j in range(k)]
    total, shares, moved, outer = 0.0, np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for a in range(0, n, CHUNK):
        apart = [x[a : a + CHUNK] - m for m in means]
        logs = np.empty((len(apart[0]), k))
        for j in range(k):
            z = apart[j] @ turns[j]
            logs[:, j] = base[j] - 0.5 * np.einsum("ij,ij->i", z, z)
        top = logs.max(1)
        norm = top + np.log(np.exp(logs - top[:, None]).sum(1))
        r = np.exp(logs - norm[:, None])
        total += norm.sum()
        shares += r.sum(0)
        for j in range(k):
            on = r[:, j] > 0
            far, own = (apart[j], r[:, j]) if on.all() else (apart[j][on], r[on, j])
            moved[j] += own @ far
            far = far * np.sqrt(own)[:, None]
            outer[j] += far.T @ far  # half the work of a product of two tables
    return [total, shares, moved, outer]


def maximise(sums: list[np.ndarray], n: int, mixture: Mixture) -> Mixture:
    nk = sums[1] + 1e-10
    move = sums[2] / nk[:, None]
    covs = sums[3] / nk[:, None, None] - move[:, :, None] * move[:, None, :] + 1e-6 * np.eye(move.shape[1])
    return nk / n, mixture[1] + move, covs


def among(column: str, names: Iterable) -> Column:
    """Whether a value, null as well, is one of ``names``."""
    held = [g for g in names if g is not None]
    inside = F.coalesce(F.col(column).isin(held), F.lit(False)) if held else F.lit(False)
    return inside | F.col(column).isNull() if None in names else inside


def converged(total: float, last: float, n: int) -> bool:
    return total - last < 1e-3 * n * 1e-1


def fit_mixture(x: np.ndarray, mixture: Mixture, steps: int = STEPS) -> tuple[float, Mixture]:
    """Log likelihood and mixture by expectation and maximisation."""
    last = -np.inf
    for _ in range(steps):
        sums = expect(x, mixture)
        total = float(sums[0])
        if converged(total, last, len(x)):
            break
        last, mixture = total, maximise(sums, len(x), mixture)
    return total, mixture


def most_components(n: int) -> int:
    return max(1, min(10, n // 20))


def criterion(total: float, k: int, d: int, n: int) -> float:
    return -2 * total + (k * d * (d + 1) / 2 + k * d + k - 1) * np.log(n)


def principal(outer: np.ndarray, n: int, most_dims: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Axes of the greatest spread, as columns, and their variances; None for fewer than two rows or dimensions."""
    d = min(most_dims, n - 1, len(outer))
    if n < 2 or d < 2:
        return None
    value, vector = np.linalg.eigh(outer / (n - 1))
    return vector[:, ::-1][:, :d], np.maximum(value[::-1][:d], 0)


def first_guess(starts: np.ndarray, variances: np.ndarray, k: int) -> Mixture:
    return np.full(k, 1 / k), starts[:k], np.repeat((np.diag(variances) + 1e-6 * np.eye(len(variances)))[None], k, 0)


def far_draw(z: np.ndarray, h: np.ndarray, starts: np.ndarray) -> tuple[float, int]:
    """The least of exponential times over squared distances to the starts: a draw by weight, the same however rows are dealt."""
    far = np.min([((z - m) ** 2).sum(1) for m in starts], axis=0) if len(starts) else np.ones(len(z))
    with np.errstate(divide="ignore"):
        time = -np.log(uniform(h, len(starts))) / far
    i = int(time.argmin())
    return float(time[i]), i


def choose_mixture(x: np.ndarray, h: np.ndarray | None = None, most_dims: int = 64):
    """Mean, axes and the mixture on them with the least BIC; None for fewer than two rows or dimensions.

    ``h``: a hash of each row, for the draw of starts.
    """
    n = len(x)
    h = np.arange(n, dtype=np.uint64) if h is None else h
    centre = x.mean(0)
    found = principal((x - centre).T @ (x - centre), n, most_dims)
    if found is None:
        return None
    axes, variances = found
    z, starts, best = (x - centre) @ axes, np.empty((0, len(variances))), None
    for k in range(1, most_components(n) + 1):
        starts = np.vstack([starts, z[far_draw(z, h, starts)[1]]])
        try:
            total, mixture = fit_mixture(z, first_guess(starts, variances, k))
        except np.linalg.LinAlgError:
            break
        bic = criterion(total, k, len(variances), n)
        if best is None or bic < best[0]:
            best = bic, mixture
    return None if best is None else (centre, axes, best[1])


def per_group(rows: DataFrame, f: Callable[[object, np.ndarray, np.ndarray], np.ndarray], least: bool = False) -> dict:
    """Per group the sum of ``f(group, vectors, hashes)`` over all rows, or the array with the least first value.

    Each task adds up its own rows first; one small shuffle adds up the tasks.  ``rows``: g, v, h.
    """

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        return min(parts, key=lambda p: p[0]) if least else np.sum(parts, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            own = batch.to_pandas()
            for g, part in own.groupby("g", dropna=False):
                g = None if pd.isna(g) else g
                found = f(g, np.stack(part.v.to_numpy()).astype(float), part.h.to_numpy().astype(np.uint64))
                total[g] = found if g not in total else merge([total[g], found])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), batch.schema.field("g").type), pa.array([p.tobytes() for p in total.values()], pa.binary())], names=["g", "p"])

    def add(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": own.g.iloc[:1], "p": [merge([np.frombuffer(p) for p in own.p]).tobytes()]})

    schema = f"g {dict(rows.dtypes)['g']}, p binary"
    return {r.g: np.frombuffer(r.p) for r in rows.mapInArrow(run, schema).groupBy("g").applyInPandas(add, schema).collect()}


def uniform(h: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each hash, another one for every draw."""
    x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(draw + 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def fit_large(rows: DataFrame, sizes: dict, most_dims: int) -> dict:
    """The chosen mixture of each group, as by ``choose_mixture``, with every sum taken over all partitions."""
    centre = {g: s / sizes[g] for g, s in per_group(rows, lambda g, x, h: x.sum(0)).items()}
    spread = per_group(rows, lambda g, x, h: ((x - centre[g]).T @ (x - centre[g])).ravel())
    axes, values = {}, {}
    for g, s in spread.items():
        width = len(centre[g])
        picked = principal(s.reshape(width, width), sizes[g], most_dims)
        if picked is not None:
            axes[g], values[g] = picked
    rows = rows.where(among("g", axes))
    starts = {g: np.empty((0, a.shape[1])) for g, a in axes.items()}

    def draw(g, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        z = (x - centre[g]) @ axes[g]
        time, i = far_draw(z, h, starts[g])
        return np.concatenate([[time], z[i]])

    for _ in range(max((most_components(sizes[g]) for g in axes), default=0)):
        for g, p in per_group(rows, draw, least=True).items():
            starts[g] = np.vstack([starts[g], p[1:]])
    now = {}
    for g in axes:
        now[g] = {k: first_guess(starts[g], values[g], k) for k in range(1, most_components(sizes[g]) + 1)}
    last = {g: dict.fromkeys(m, -np.inf) for g, m in now.items()}
    done: dict = {g: {} for g in axes}

    def step(g, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        z = (x - centre[g]) @ axes[g]
        return np.concatenate([np.ravel(s) for m in now[g].values() for s in expect(z, m)])

    for turn in range(STEPS):
        live = [g for g in now if now[g]]
        if not live:
            break
        some = rows.where(among("g", live))
        for g, flat in per_group(some, step).items():
            d, at = axes[g].shape[1], 0
            for k, mixture in list(now[g].items()):
                cuts = np.cumsum([1, k, k * d, k * d * d])
                parts = np.split(flat[at : at + cuts[-1]], cuts[:-1])
                at += cuts[-1]
                sums = [parts[0][0], parts[1], parts[2].reshape(k, d), parts[3].reshape(k, d, d)]
                total = float(sums[0])
                if k not in now[g]:
                    continue
                if converged(total, last[g][k], sizes[g]):
                    done[g][k] = (total, *mixture)
                    del now[g][k]
                    continue
                last[g][k] = total
                now[g][k] = maximise(sums, sizes[g], mixture)
                try:
                    np.linalg.cholesky(now[g][k][2])
                except np.linalg.LinAlgError:  # neither this number of components nor a larger one
                    now[g] = {q: m for q, m in now[g].items() if q < k}
                    done[g] = {q: m for q, m in done[g].items() if q < k}
                    continue
                if turn == STEPS - 1:
                    done[g][k] = (total, *now[g][k])
    best = {}
    for g, found in done.items():
        if found:
            k = min(found, key=lambda q: (criterion(found[q][0], q, axes[g].shape[1], sizes[g]), q))
            best[g] = centre[g], axes[g], found[k][1:]
    return best


PARTS = ["comp", "weight", "mean", "cov", "n_samples", "centre", "axes"]


def parts(centre: np.ndarray, axes: np.ndarray, mixture: Mixture, n: int) -> list[tuple]:
    """Rows of a model table."""
    w, means, covs = mixture
    return [(j, float(w[j]), means[j].tolist(), covs[j].ravel().tolist(), n, centre.tolist(), axes.ravel().tolist()) for j in range(len(w))]


def group_mixtures(rows: DataFrame, group: str, key: str, vector: str, most_dims: int = 64, one_task: int = ONE_TASK) -> DataFrame:
    """(group, comp, weight, mean, cov, n_samples, centre, axes): one row per component, fitted on all rows; groups too small have none.

    ``centre`` is the group's mean, ``axes`` its principal axes (a row of the flat matrix for each dimension of the vectors); ``mean`` and ``cov``
    lie on these axes.
    """
    kind = dict(rows.dtypes)[group]
    rows = rows.where(F.col(vector).isNotNull())
    schema = f"{group} {kind}, comp int, weight double, mean array<double>, cov array<double>, n_samples long, centre array<double>, axes array<double>"
    large = {r[0]: r.n for r in rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > one_task).collect()}
    is_large = among(group, large)

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        best = choose_mixture(np.stack(own.v.to_numpy()).astype(float), own.h.to_numpy().astype(np.uint64), most_dims)
        return pd.DataFrame([(own.g.iloc[0], *r) for r in parts(*best, len(own))] if best else [], columns=[group, *PARTS])

    some = rows.where(~is_large).select(F.col(group).alias("g"), F.col(vector).alias("v"), F.xxhash64(key).alias("h"))
    out = some.groupBy("g").applyInPandas(fit, schema)
    names = list(large)
    for at in range(0, len(names), WAVE):
        wave = names[at : at + WAVE]
        own = among(group, wave)
        picked = rows.where(own).select(F.col(group).alias("g"), F.col(vector).alias("v"), F.xxhash64(key).alias("h")).persist()
        fitted = fit_large(picked, {g: large[g] for g in wave}, most_dims)
        picked.unpersist()
        out = out.unionByName(rows.sparkSession.createDataFrame([(g, *r) for g, best in fitted.items() for r in parts(*best, large[g])], schema))
    return out


class Scorer:
    """Densities of a group's mixture, with what each component needs worked out once."""

    def __init__(self, own: list):
        first = own[0]
        d = len(first.mean)
        self.centre, self.axes = np.array(first.centre), np.array(first.axes).reshape(-1, d)
        self.means = [np.array(r.mean) for r in own]
        lows = [np.linalg.cholesky(np.array(r["cov"]).reshape(d, d)) for r in own]
        self.turns = [np.linalg.inv(low).T for low in lows]
        self.logs = np.array([np.log(r.weight) - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi) for r, low in zip(own, lows)])

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) @ self.axes
        logs = np.stack([c - 0.5 * (((z - m) @ t) ** 2).sum(1) for m, t, c in zip(self.means, self.turns, self.logs)], axis=1)
        e = np.exp(logs - logs.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


#: Numbers of the models that tasks hold at once; larger sets of models are scored in turns, each a pass over the rows.
MOST_NUMBERS = 1 << 23


def mixture_posteriors(rows: DataFrame, models: DataFrame, groups: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(key, group, best, entropy): for every row and group the greatest posterior over the group's components, and their entropy.

    ``models`` is what ``group_mixtures`` gives, stored; ``groups`` one row a group.  A group without a model scores -100 and 0.  Rows without a vector
    have no result.  Models go to the tasks, MOST_NUMBERS numbers at a time; rows aren't shuffled.
    """
    size = models.groupBy(group).agg(F.sum(F.size("mean") + F.size("cov") + F.size("centre") + F.size("axes")).alias("n"))
    turns: list[list] = [[]]
    held = 0
    for r in groups.select(group).join(size.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "n").orderBy(group).collect():  # a name and a number for each group
        if turns[-1] and held + (r.n or 0) > MOST_NUMBERS:
            turns.append([])
            held = 0
        turns[-1].append(r[0])
        held += r.n or 0
    kinds = dict(rows.dtypes)
    schema = f"{key} {kinds[key]}, {group} {dict(groups.dtypes)[group]}, best double, entropy double"
    rows = rows.select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    return reduce(DataFrame.unionByName, [one_turn(rows, models, turn, key, group, schema) for turn in turns])


def one_turn(rows: DataFrame, models: DataFrame, names: list, key: str, group: str, schema: str) -> DataFrame:
    is_one = among(group, names)
    kind = to_arrow_type(models.schema[group].dataType)
    found: dict = {g: [] for g in names}
    for r in models.where(is_one).orderBy(group, "comp").collect():
        found[r[group]].append(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {g: Scorer(own) if own else None for g, own in found.items()}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column("v").flatten()).reshape(n, -1)
            for g, scorer in scorers.items():
                best, entropy = np.full(n, -100.0), np.zeros(n)
                if scorer is not None:
                    q = scorer.posteriors(x)
                    best = q.max(1)
                    w = (q + 1e-10) / (q + 1e-10).sum(1, keepdims=True)
                    entropy = -(w * np.log(w)).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([g] * n, kind), pa.array(best), pa.array(entropy)], names=[key, group, "best", "entropy"])

    return rows.mapInArrow(run, schema)
