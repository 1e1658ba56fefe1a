"""Folders and intermediate tables that the driver and all executors see, and how long such tables live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a session that has none gets a local one if it runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


class scratch:  # noqa: N801
    """``with scratch() as tables``: at the end the tables that written() made inside are deleted, but for those kept.

    A table that is kept belongs to the scope around, if there is one; without any scope it stays until the caller drops
    it, as a result that is not read yet needs it.
    """

    open: list[scratch] = []

    def __enter__(self) -> scratch:
        self.made: list[DataFrame] = []
        self.open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.made = [m for m in self.made if m is not df]
        if len(self.open) > 1:
            self.open[-2].made.append(df)
        return df

    def __exit__(self, *error) -> None:
        self.open.pop()
        for df in self.made:
            drop_written(df)


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path  # noqa: SLF001  so that it can be deleted
    if scratch.open:
        scratch.open[-1].made.append(out)
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark knows; nothing happens if it is gone."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)  # noqa: SLF001


def drop_written(df: DataFrame | None) -> None:
    """Deletes a table that written() made and that nothing reads any more; nothing happens if it is gone."""
    if df is not None and getattr(df, "_written_path", None):
        delete_path(df.sparkSession, df._written_path)  # noqa: SLF001
