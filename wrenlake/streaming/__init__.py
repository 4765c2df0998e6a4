"""Structured Streaming forms of ingestion: filter, dedup, caps, windows and sessions that close, appended sink."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import new_dir


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table as a stream; its schema is read from the table."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path[:-1] + "[t]")  # a pattern, as streams want for single files, that only this path matches


def accept(stream: DataFrame, keep: Column) -> DataFrame:
    return stream.where(keep)


def dedup(stream: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """The first row of each key within ``horizon`` of event time; state is dropped beyond it."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def hop(rows: DataFrame, time: str, width: str, step: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` per window, sliding if ``step`` is given."""
    w = F.window(time, width, step or width)
    return rows.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def run_all(stream: DataFrame, sink: str, checkpoint: str) -> list[dict]:
    """Process all that is there now into a Parquet sink, appended once over restarts; the reports of its batches."""
    run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return [dict(p) for p in run.recentProgress]


def new_sink(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    return new_dir(spark, "stream")


# State that ends


def with_closing(stream: DataFrame, folder: str) -> DataFrame:
    """The stream and rows that ``close`` puts into ``folder`` later on: they move event time past the last data.

    ``folder`` must exist; a watermark goes on the result.
    """
    return stream.unionByName(stream.sparkSession.readStream.schema(stream.schema).parquet(folder))


def close(spark: SparkSession, schema, folder: str, time: str, at: object) -> None:
    """Put a row into ``folder`` that has only an event time."""
    spark.createDataFrame([(at,)], f"{time} timestamp").select(*(F.col(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(folder)


def run_to_end(stream: DataFrame, time: str, build: Callable[[DataFrame], DataFrame], sink: str, past: dt.timedelta = dt.timedelta(days=1)) -> tuple[DataFrame, list[list[dict]]]:
    """The result of a windowed plan in append mode over all that is there now, each row written once; and the reports of both runs.

    The first run emits what the watermark has passed.  Then a closing row comes in, ``past`` after the latest time that its reports name, and a second
    run from the same checkpoint emits the rest and drops its state; the window of the closing row stays open.  ``build`` sets the watermark; its
    delay and the windows together must be shorter than ``past``.
    """
    spark = stream.sparkSession
    closing = f"{sink}/closing"
    spark.createDataFrame([], stream.schema).write.parquet(closing)
    rows = build(with_closing(stream, closing))
    reports = [run_all(rows, f"{sink}/out", f"{sink}/log")]
    # reports of old batches are dropped, but the watermark stays
    times = [p["eventTime"] for p in reports[0] if p.get("eventTime")]
    if any("max" in t for t in times):
        close(spark, stream.schema, closing, time, max(dt.datetime.fromisoformat(t[c]) for t in times for c in ("max", "watermark") if c in t) + past)
        reports.append(run_all(rows, f"{sink}/out", f"{sink}/log"))
    return spark.read.schema(rows.schema).parquet(f"{sink}/out"), reports


# State by key


def capped(stream: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Up to ``most`` rows of each ``group``, in order of arrival, by ``order`` within a batch; exact over restarts.

    A task keeps the first ``most`` rows of each group of its part of a batch, so no more of a group are shuffled; a counter a
    group says how many are still taken.  Null groups are one group.
    """
    schema = stream.schema
    names = schema.names

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(order, kind="stable").groupby(group, dropna=False, sort=False).head(most)

    def early(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = first(batch if held is None else pd.concat([held, batch]))
        if held is not None:
            yield held

    def take(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = state.get[0] if state.exists else 0
        held = None
        for batch in batches:
            held = first(batch if held is None else pd.concat([held, batch]))
        out = held.iloc[: max(0, most - taken)] if held is not None else None
        if out is not None:
            state.update((taken + len(out),))
            yield out[names]

    return stream.mapInPandas(early, schema).groupBy(group).applyInPandasWithState(take, schema, "taken long", "append", GroupStateTimeout.NoTimeout)


class KeyStore:
    """Keys that a sink has accepted, in buckets beside it: a batch reads only the buckets of its own keys, never the sink.

    Keys and rows of a batch lie in folders of its number.  A batch that comes again reads what was there before it and writes the same folders
    again, so nothing is accepted twice.  Keys may be null; a bucket is by hash, so a common key is one row.
    """

    def __init__(self, path: str, keys: list[str], buckets: int = 256):
        self.path, self.keys, self.buckets = path, keys, buckets

    def held(self, spark: SparkSession, schema: str, batch: int, buckets: list[int]) -> DataFrame:
        """Keys of the buckets that earlier batches accepted."""
        jvm = spark._jvm
        paths = [f"{self.path}/keys/bucket={b}" for b in buckets]
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        paths = [p for p in paths if fs.exists(jvm.org.apache.hadoop.fs.Path(p))]
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, bucket int, batch long").option("basePath", f"{self.path}/keys").parquet(*paths).where(F.col("batch") < batch).drop("batch")

    def accept(self, rows: DataFrame, batch: int) -> None:
        """Write the first row of each key that no earlier batch has; for ``foreachBatch``."""
        spark = rows.sparkSession
        # in any order of rows the same one of a key is kept
        order = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in self.keys), F.lit(0))
        new = rows.groupBy(*self.keys).agg(F.min(order).alias("_r")).select(*self.keys, "_r.*").select(*rows.columns)
        new = new.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most ``buckets``
            if not touched:
                return
            kinds = dict(rows.dtypes)
            held = self.held(spark, ", ".join(f"{k} {kinds[k]}" for k in self.keys), batch, touched)
            if "bucket" in held.columns:
                other = held.select(F.col("bucket").alias("_b"), *(F.col(k).alias(f"_{k}") for k in self.keys))
                same = F.col("bucket") == F.col("_b")
                for k in self.keys:
                    same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
                new = new.join(other, same, "left_anti")
            new = new.withColumn("batch", F.lit(batch).cast("long"))
            new.drop("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/out")
            new.select(*self.keys, "bucket", "batch").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/keys")
        finally:
            new.unpersist()

    def rows(self, spark: SparkSession, schema: str) -> DataFrame:
        """All rows accepted so far."""
        return spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/out").drop("batch")


def run_once_each(stream: DataFrame, store: KeyStore, checkpoint: str) -> None:
    """Send all that is there now through a store."""
    stream.writeStream.foreachBatch(store.accept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
