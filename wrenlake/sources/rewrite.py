"""Rewriting a table in place: new files beside the old, then renames, and recovery when a run dies between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Table:
    """A folder of Parquet files that is replaced as a whole.

    A rewrite writes ``path.new`` and, when Spark's success mark is there, renames the table to ``path.old`` and the new one to ``path``; then
    the old one goes.  ``recover`` ends what a dead run began: it goes on where the new table is whole, else it goes back.  One writer at a time; renames of
    folders must be atomic, as on HDFS or a local disk.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.new, self.old = spark, path, f"{path}.new", f"{path}.old"
        self.jvm = spark._jvm
        self.files = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.files.exists(self.at(path))

    def move(self, a: str, b: str) -> None:
        if not self.files.rename(self.at(a), self.at(b)):
            raise OSError(f"can't rename {a} to {b}")

    def drop(self, path: str) -> None:
        self.files.delete(self.at(path), True)

    def is_whole(self, path: str) -> bool:
        return self.exists(f"{path}/_SUCCESS")

    def recover(self) -> None:
        """Bring the table into the state before or after a rewrite that didn't end."""
        if not self.exists(self.path):  # between the renames
            if self.is_whole(self.new):
                self.move(self.new, self.path)
            elif self.exists(self.old):
                self.move(self.old, self.path)
        self.drop(self.new)  # never became the table
        if self.exists(self.path):
            self.drop(self.old)

    def read(self) -> DataFrame:
        self.recover()
        return self.spark.read.parquet(self.path)

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> None:
        change(self.read()).write.parquet(self.new)
        if not self.is_whole(self.new):
            raise OSError(f"{self.new} isn't whole")
        self.move(self.path, self.old)
        self.move(self.new, self.path)
        self.drop(self.old)
