"""Label repair, pseudo-labels from other sources, posterior scores and balanced draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def looks_whole(value: Column) -> Column:
    """Whether a text is digits, with or without minus signs before them."""
    return F.coalesce(F.trim(value).rlike("^-*[0-9]+$"), F.lit(False))


def repair_coded(rows: DataFrame, codes: DataFrame, names: DataFrame, source: str = "birdset") -> DataFrame:
    """Rows of ``source`` whose ``species_name`` is a number get the name that its code stands for.

    ``rows``: source, source_id (``source:config:...``), species_name, common_name and more.  ``codes``: config, number,
    code.  ``names``: code (lower case), scientific_name, other_name.  A number without a code stays; a code without a
    name takes its place.  Adds ``repaired``.
    """
    value = F.trim("species_name")
    coded = F.coalesce(F.col("source") == source, F.lit(False)) & looks_whole(F.col("species_name"))
    keyed = rows.withColumn("_config", F.when(coded, F.get(F.split("source_id", ":"), F.lit(1)))).withColumn("_number", F.when(coded, value.try_cast("long")))
    codes = codes.select(F.col("config").alias("_config"), F.col("number").alias("_number"), F.col("code").alias("_code"))
    names = names.select(F.col("code").alias("_key"), F.col("scientific_name").alias("_name"), F.col("other_name").alias("_other"))
    x = keyed.join(codes, ["_config", "_number"], "left")
    x = x.join(names, F.lower("_code") == F.col("_key"), "left")
    done = F.col("_code").isNotNull() & (F.col("_code") != "")
    species = F.when(done, F.coalesce(F.nullif("_name", F.lit("")), "_code")).otherwise(F.col("species_name"))
    common = F.when(done, F.coalesce("_other", F.lit(""))).otherwise(F.col("common_name"))
    keep = [c for c in rows.columns if c not in ("species_name", "common_name")]
    return x.select(*keep, species.alias("species_name"), common.alias("common_name"), F.coalesce(done, F.lit(False)).alias("repaired"))


def external_labels(segments: DataFrame, found: DataFrame, species: DataFrame) -> DataFrame:
    """Rows (segment, species, status) for labels found elsewhere: matched, or unknown where the species list hasn't it.

    ``segments``: segment, path, start; ``found``: path, start (``H:M:S`` or seconds), species; they meet on the file
    name and the start to a tenth of a second; of several segments with one key the last counts.  Other rows go.
    """
    own = segments.groupBy(T.basename(F.col("path")).alias("name"), F.round("start", 1).alias("at")).agg(F.max("segment").alias("segment"))
    rows = found.select(T.basename(F.col("path")).alias("name"), F.round(T.seconds(F.col("start")), 1).alias("at"), F.trim("species").alias("species"))
    known = species.select(F.trim("species").alias("species")).distinct().withColumn("known", F.lit(True))
    x = rows.join(own, ["name", "at"]).join(known, "species", "left")
    return x.select("segment", "species", F.when(F.col("known"), "matched").otherwise("unknown").alias("status"))


def single_species(segments: DataFrame, known: DataFrame) -> DataFrame:
    """(segment, species) of segments with one clean label.

    ``segments``: segment, quality, labels (``;`` list).  A strong_primary segment counts if its label is known, a
    strong_multilabel one if exactly one of its labels is.
    """
    each = segments.where(F.col("quality").isin("strong_primary", "strong_multilabel")).select("segment", "quality", F.explode(F.when(F.col("quality") == "strong_primary", F.array(F.trim("labels"))).otherwise(T.split_labels(F.col("labels")))).alias("species"))
    held = each.join(known.select("species").distinct(), "species", "left_semi")
    return held.groupBy("segment").agg(F.count("*").alias("n"), F.min("species").alias("species")).where("n = 1").select("segment", "species")


def open_filter(keys: DataFrame, key: str, frames: DataFrame, level: str, quiet: float, share: float) -> DataFrame:
    """Keys with enough loud frames, and those whose frames are missing or can't all be read: what can't be checked stays."""
    seen = frames.groupBy(key).agg(F.avg((F.col(level) > quiet).cast("double")).alias("active"), F.count_if(F.col(level).isNull()).alias("unread"))
    return keys.join(seen, key, "left").where("unread is null or unread > 0 or active >= " + repr(share)).select(*keys.columns)


def posteriors(rows: DataFrame, models: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(key, group, best, entropy): the greatest posterior over a group's components, and their entropy.

    ``models``: one row a group, ``parts`` an array of (weight, mean, var) with diagonal variances, or empty: such groups
    score -100 and 0.  Groups are few, so their models are joined to every row.
    """
    log = F.transform("parts", lambda c: F.log(c["weight"]) - 0.5 * F.aggregate(F.zip_with(F.zip_with(F.col(vector), c["mean"], lambda x, m: (x - m) * (x - m)), c["var"], lambda d, v: d / v + F.log(2 * F.pi() * v)), F.lit(0.0), lambda s, t: s + t))
    x = rows.select(key, vector).crossJoin(F.broadcast(models)).select(key, group, log.alias("l"))
    x = x.withColumn("m", F.array_max("l")).withColumn("e", F.transform("l", lambda v: F.exp(v - F.col("m"))))
    x = x.withColumn("s", F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).withColumn("q", F.transform("e", lambda v: v / F.col("s") + 1e-10))
    x = x.withColumn("z", F.aggregate("q", F.lit(0.0), lambda a, b: a + b))
    entropy = -F.aggregate("q", F.lit(0.0), lambda a, b: a + b / F.col("z") * F.log(b / F.col("z")))
    none = F.size("l") == 0
    return x.select(key, group, F.when(none, -100.0).otherwise(F.array_max(F.transform("e", lambda v: v / F.col("s")))).alias("best"), F.when(none, 0.0).otherwise(entropy).alias("entropy"))


def hashed(seed: int, *columns: Column) -> Column:
    """A whole number of 32 bits by checksum, the same on any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in columns], F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def balanced_draw(rows: DataFrame, key: str, group: str, draws: DataFrame, seed: int = 42) -> DataFrame:
    """(draw, key): for each row of ``draws`` a group with equal chance, then one of its rows; with replacement.

    Groups are few; rows are numbered in the order of a checksum, by sums of its buckets and places within a bucket, so that no
    group comes to one task, and joined by number.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_g", F.row_number().over(Window.orderBy(group)) - 1)
    total = sizes.agg(F.count("*").alias("_groups"))
    picked = draws.crossJoin(F.broadcast(total)).withColumn("_g", hashed(seed, F.lit("g"), F.col("draw")) % F.col("_groups"))
    picked = picked.join(sizes, "_g").withColumn("_r", hashed(seed, F.lit("r"), F.col("draw")) % F.col("_size"))
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    x = rows.select(key, group, order.alias("_h")).withColumn("_b", F.substring("_h", 1, 4))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy(group, "_b").agg(F.count("*").alias("_n")).select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", key)) - 1
    numbered = x.join(base, [group, "_b"]).select(key, group, (F.col("_base") + place).cast("long").alias("_r"))
    return picked.join(numbered, [group, "_r"]).select("draw", key)
