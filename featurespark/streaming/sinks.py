"""A table keyed by columns and event time that micro-batches are merged into (O-11, O-96).

Rows lie in cells: a slot (a hash of the keys) and a day of the event time. A batch reads the cells that it touches, merges
them and writes them anew below its own version; all other cells stay as they are, so what is written is in proportion to
the cells of the batch. What a batch has written is listed in a manifest under its id, which is written last: a batch that
fails on the way has changed nothing, and a batch that is repeated writes what it wrote before. Every ``compact`` manifests
one lists all cells; then older manifests and the cells that it has replaced are deleted. Readers see the newest manifest
that is there when they begin, and have ``compact`` batches' time to finish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from featurespark.sources.shared import delete_path, scratch, written
from featurespark.sources.tables import upsert

CELL = ["_slot", "_day"]


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers n of the folders n=... that are written to their end, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/n=*/_SUCCESS")  # noqa: SLF001
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []  # noqa: SLF001
    return sorted(int(x.getPath().getParent().getName()[2:]) for x in found)


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)  # noqa: SLF001


class KeyedTable:
    """The newest row per keys and event time; of the same ones in a batch the highest seq."""

    def __init__(self, path: str, keys: list[str], event_time: str, seq: str, slots: int = 16, compact: int = 16):
        self.path, self.keys, self.event_time, self.seq, self.slots, self.compact = path, keys, event_time, seq, slots, compact

    def cells(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """_slot, _day, _version of all cells as of the newest manifest (before a batch)."""
        numbers = [n for n in _numbers(spark, f"{self.path}/manifest") if before is None or n < before]
        kind = "_slot int, _day string, _version long"
        if not numbers:
            return spark.createDataFrame([], kind)
        whole = [n for n in numbers if n % self.compact == 0]
        numbers = [n for n in numbers if n >= max(whole, default=0)]
        rows = spark.read.schema(kind).parquet(*[f"{self.path}/manifest/n={n}" for n in numbers])
        return rows.groupBy(*CELL).agg(F.max("_version").alias("_version"))

    def read(self, spark: SparkSession) -> DataFrame:
        if not _exists(spark, f"{self.path}/schema/_SUCCESS"):
            raise ValueError(f"no batch has been written to {self.path}")
        return self._rows(spark, self.cells(spark))

    def _rows(self, spark: SparkSession, cells: DataFrame) -> DataFrame:
        """The rows of some cells; the driver lists their folders, one path a cell."""
        schema = spark.read.parquet(f"{self.path}/schema").schema
        paths = [f"{self.path}/data/_version={c._version}/_slot={c._slot}/_day={c._day}" for c in cells.collect()]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: merges a micro-batch under its id.

        The batch is written to the shared folder first, as every action on it would run its stateful operators anew.
        """
        with scratch():
            self._merge(written(batch), batch_id)

    def _merge(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not _exists(spark, f"{self.path}/schema/_SUCCESS"):
            batch.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        before = self.cells(spark, batch_id)
        placed = self._placed(batch)
        touched = placed.select(*CELL).distinct()
        old = self._rows(spark, before.join(touched, CELL))
        merged = self._placed(upsert(old, batch, self.keys, self.event_time, self.seq))
        # a cell's rows in one task, and in more where they are many
        merged.hint("rebalance", *CELL).write.partitionBy(*CELL).mode("overwrite").parquet(f"{self.path}/data/_version={batch_id}")
        cells = touched.withColumn("_version", F.lit(batch_id).cast("long"))
        if batch_id % self.compact == 0:
            cells = cells.unionByName(before.join(touched, CELL, "left_anti"))
        cells.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/n={batch_id}")
        if batch_id % self.compact == 0:
            self._collect(spark, batch_id)

    def _placed(self, df: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64(*self.keys), F.lit(self.slots)).cast("int")
        return df.withColumns({"_slot": slot, "_day": F.coalesce(F.date_format(self.event_time, "yyyy-MM-dd"), F.lit("none"))})

    def _collect(self, spark: SparkSession, batch_id: int) -> None:
        """Deletes manifests before the whole one before this, and the cells that were replaced by then."""
        numbers = _numbers(spark, f"{self.path}/manifest")
        keep = max([n for n in numbers if n % self.compact == 0 and n < batch_id], default=None)
        dropped = [n for n in numbers if keep is not None and n < keep]
        if not dropped:
            return
        listed = spark.read.parquet(*[f"{self.path}/manifest/n={n}" for n in [*dropped, keep]]).select(*CELL, "_version").distinct()
        newest = F.max("_version").over(Window.partitionBy(*CELL))
        for c in listed.withColumn("_newest", newest).filter("_version < _newest").collect():  # one row a replaced cell
            delete_path(spark, f"{self.path}/data/_version={c._version}/_slot={c._slot}/_day={c._day}")
        for n in dropped:
            delete_path(spark, f"{self.path}/manifest/n={n}")


def keyed_sink(df: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Merges what is there now into the table and stops; run again, it goes on from the checkpoint."""
    return df.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
