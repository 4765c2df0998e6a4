"""Label tables, masks, folds and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_index(labels: DataFrame, column: str) -> DataFrame:
    """Distinct labels in order with a dense index from 0.  The list of labels is far smaller than the data."""
    return labels.select(column).where(F.col(column).isNotNull()).distinct().withColumn("idx", F.row_number().over(Window.orderBy(column)) - 1)


def label_masks(segments: DataFrame, species: list[str]) -> DataFrame:
    """Rows (segment, species, y, m) for every segment and species.

    ``segments``: segment, quality, primary (list), secondary (list).  A species is present (y = 1),
    absent (y = 0, m = 1) or unknown (m = 0).  The species list stands in the plan as an array.
    """
    known = F.array(*map(F.lit, species))
    hit = F.when(F.col("quality") == "strong_multilabel", F.col("primary")).when((F.col("quality") == "strong_primary") & F.arrays_overlap("primary", known), F.concat("primary", "secondary")).otherwise(F.array().cast("array<string>"))
    mask = F.col("quality").isin("strong_multilabel", "strong_primary") & (F.size("primary") > 0)
    x = segments.select("segment", F.coalesce(mask, F.lit(False)).alias("mask"), hit.alias("hit"), F.explode(known).alias("species"))
    return x.select("segment", "species", (F.col("mask") & F.array_contains("hit", F.col("species"))).cast("double").alias("y"), F.col("mask").cast("double").alias("m"))


def spread(*columns: str, seed: int = 42) -> Column:
    """A portable order that doesn't follow the data: by the checksum of key and seed."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


#: Keys that one task ranks, about.
RANKED = 1_000_000


def ranked(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with ``r``, the rank from 0 of ``key`` in an order that doesn't follow the data, and ``n``, their number.

    Ranks are counted in ranges of leading checksum digits, whose sizes are added up first: more digits for more rows.
    """
    digits = 2
    total = rows.count()
    while total > RANKED * 16**digits:
        digits += 1
    x = rows.withColumn("_o", spread(key, seed=seed)).withColumn("_b", F.substring("_o", 1, digits))
    size = x.groupBy("_b").agg(F.count("*").alias("_n"))  # as many rows as ranges
    size = size.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"), F.lit(total).alias("n"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_o", key)) - 1
    return x.withColumn("r", rank).join(size, "_b").withColumn("r", F.col("r") + F.col("_before")).drop("_o", "_b", "_before")


def group_folds(keys: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """A fold per distinct key, so that rows of one key share it; sizes in keys differ by one at most."""
    return ranked(keys.select(key).distinct(), key, seed).select(key, (F.col("r") % folds).cast("int").alias("fold"))


def sample_exact(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same on every run."""
    return rows.orderBy(spread(key, seed=seed), key).limit(n)


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the row written last."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def not_seen(rows: DataFrame, seen: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows that match none of the keys of ``seen``: one anti-join per key, not one join with OR."""
    for own, other in pairs:
        rows = rows.join(seen.select(F.col(other).alias("_k")).where("_k is not null").distinct(), F.col(own) == F.col("_k"), "left_anti")
    return rows
