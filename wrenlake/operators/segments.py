"""Cutting recordings into windows, and the windows around events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_segments(recordings: DataFrame, duration: str, length: float, overlap: float = 0.0, slack: float = 0.01) -> DataFrame:
    """Rows ``start``, ``end`` of windows of ``length`` seconds; the last may be short by ``slack``; a shorter rest is dropped."""
    step = length - overlap
    if step <= 0:
        raise ValueError("overlap must be less than length")
    last = F.floor((F.col(duration) + slack - length) / step)
    x = recordings.where(last >= 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("i") * step
    return x.withColumn("start", F.round(start, 3)).withColumn("end", F.round(F.least(start + length, F.col(duration)), 3)).drop("i")


def whole_segments(recordings: DataFrame, samples: str, size: int) -> DataFrame:
    """Rows ``i``, ``first``: only whole windows of ``size`` samples."""
    n = F.expr(f"{samples} div {size}")
    return recordings.where(n > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("first", F.col("i") * size)


def centre(start: Column, end: Column, event: Column) -> Column:
    return F.coalesce(event, (start + end) / 2)


def context_window(start: Column, end: Column, event: Column, width: float = 9.0) -> tuple[Column, Column]:
    """``width`` seconds about the event, or the middle; never before 0."""
    c = centre(start, end, event)
    return F.greatest(F.lit(0.0), c - width / 2), c + width / 2


def clip(duration: Column, event: Column, most: float = 15.0) -> tuple[Column, Column, Column]:
    """Start, length and shifted event of a recording cut to ``most`` seconds about its event."""
    start = F.when(duration > most, F.greatest(F.lit(0.0), F.coalesce(event, duration / 2) - most / 2)).otherwise(F.lit(0.0))
    return start, F.least(F.lit(most), duration - start), event - start


def event_window(start: Column, end: Column, total: Column, least: float, most: float) -> tuple[Column, Column]:
    """An event of less than ``least`` seconds grows by half of what is missing on either side, within the recording.

    Where that meets the beginning, the end moves on by the event's start; where it meets the recording's end, the start moves back by what lies after
    the event.  What is longer than ``most`` is cut at its end.
    """
    short = end - start < least
    side = (F.lit(least) - (end - start)) / 2
    a, b = F.greatest(F.lit(0.0), start - side), F.least(total, end + side)
    first = F.when(short, F.when((a > 0) & (b == total), F.greatest(F.lit(0.0), a - (b - end))).otherwise(a)).otherwise(start)
    last = F.when(short, F.when(a == 0, F.least(total, b + start)).otherwise(b)).otherwise(end)
    return first, F.when(last - first > most, F.least(first + most, total)).otherwise(last)


def loud_enough(frames: DataFrame, keys: list[str], level: str, quiet: float, share: float) -> DataFrame:
    """Keys whose share of frames louder than ``quiet`` is at least ``share``; a key without frames doesn't occur."""
    active = F.avg((F.col(level) > quiet).cast("double"))
    return frames.groupBy(*keys).agg(active.alias("active"), F.count("*").alias("n_frames")).where(F.col("active") >= share)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] | None) -> Column:
    """Inside (south, west, north, east), edges included; without numbers false, without a box true."""
    if box is None:
        return F.lit(True)
    south, west, north, east = box
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))
