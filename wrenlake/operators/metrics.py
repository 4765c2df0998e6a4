"""Evaluation: ranks, losses and early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def auc_by_class(scored: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Area under the ROC curve per class; classes with one kind of label are left out.

    Rows are first counted per distinct score, so ties need no order and the window runs over distinct scores.
    """
    c = scored.groupBy(group, score).agg(F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("below", F.coalesce(below, F.lit(0.0)))
    s = c.groupBy(group).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return s.where("np > 0 and nn > 0").select(group, (F.col("u") / (F.col("np") * F.col("nn"))).alias("auc"))


def focal_loss(rows: DataFrame, alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """Masked focal loss of columns x (logit), y, m: mean over masked entries; soft targets count as present from 0.5."""
    p = V.sigmoid(F.col("x"))
    present = F.col("y") >= 0.5
    pt = F.when(present, p).otherwise(1 - p)
    at = F.when(present, alpha).otherwise(1 - alpha)
    loss = at * F.pow(1 - pt, gamma) * V.log_loss(F.col("x"), F.col("y"))
    return rows.agg((F.sum(loss * F.col("m")) / F.greatest(F.sum("m"), F.lit(1.0))).alias("loss"))


def asymmetric_loss(rows: DataFrame, gamma_pos: float = 0.0, gamma_neg: float = 4.0, clip: float = 0.05) -> DataFrame:
    """Masked asymmetric loss: probabilities of absent labels count as ``clip`` at least."""
    p = V.sigmoid(F.col("x"))
    low = F.greatest(p, F.lit(clip))
    pos = F.col("y") * F.log(F.greatest(p, F.lit(1e-8))) * F.pow(1 - p, gamma_pos)
    neg = (1 - F.col("y")) * F.log(F.greatest(1 - low, F.lit(1e-8))) * F.pow(low, gamma_neg)
    return rows.agg((-F.sum((pos + neg) * F.col("m")) / F.greatest(F.sum("m"), F.lit(1.0))).alias("loss"))


def early_stop(epochs: DataFrame, epoch: str, metric: str, patience: int) -> DataFrame:
    """(epoch, metric, best, stop): best so far, and whether ``patience`` epochs have passed since it rose.  One row per epoch."""
    so_far = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    x = epochs.select(epoch, metric).withColumn("best", F.max(metric).over(so_far))
    x = x.withColumn("at", F.min(epoch).over(Window.partitionBy("best")))
    return x.select(epoch, metric, "best", (F.col(epoch) - F.col("at") >= patience).alias("stop"))
