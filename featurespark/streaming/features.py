"""Streaming feature operators (O-10, O-80, O-93 to O-97).

Rolling sums, lags and the as-of join of two streams are one stateful processor (``keyed``); tables that batches are merged
into are in ``sinks``, rules on batches in ``expectations``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

from featurespark.operators.joins import asof_join
from featurespark.ship import ship
from featurespark.sources.avro import decode

from .keyed import ROCKSDB, keyed_features
from .sinks import KeyedTable, keyed_sink


def event_stream(spark: SparkSession, fmt: str, schema: StructType | str, path: str | None = None, ts: str | None = None, delay: str | None = None, avro: str | None = None, header: int = 0, **options) -> DataFrame:
    """A stream of events of a declared schema from the earliest offset.

    ``kafka`` parses the value as JSON, or as Avro by its schema ``avro`` (JSON), of which ``header`` bytes are skipped;
    values that don't parse give null columns. File formats read a folder; with ``avro`` one of files that hold a binary
    column ``value``. NTZ times become timestamps (UTC sessions), which watermarks need.
    """
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(startingOffsets="earliest", **options).load()
    elif avro is not None:
        raw = spark.readStream.format(fmt).schema("value binary").options(**options).load(path)
    else:
        raw = None
    if raw is None:
        df = spark.readStream.format(fmt).schema(schema).options(**options).load(path)
    elif avro is not None:
        df = raw.select(decode(F.col("value"), avro, header).alias("v")).select("v.*")
    else:
        df = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")
    if ts:
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
        df = df.withWatermark(ts, delay) if delay else df
    return df


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Writes what is there now and stops; run again, it goes on from the checkpoint."""
    return df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def rolling_stream(
    stream: DataFrame, key: str, ts: str, id_col: str, value: str, windows: dict[str, int], lags: list[str] = (), emit: str = "immediate"
) -> DataFrame:
    """Each row with sum_<name>, num_<name> over trailing windows and prev_<col> of its key (O-93, O-94); see keyed_features."""
    return keyed_features(stream, [key], ts, id_col, value, windows, lags, emit)


def lag_stream(stream: DataFrame, key: str, ts: str, id_col: str, cols: list[str], emit: str = "immediate") -> DataFrame:
    """Each row with prev_<col> of its key."""
    return keyed_features(stream, [key], ts, id_col, None, {}, cols, emit)


def asof_streams(stream: DataFrame, versions: DataFrame, on: list[str], ts: str, version_ts: str, seq: str, id_col: str | None = None) -> DataFrame:
    """Each row with the newest version of its key at or before its time, both sides as streams with watermarks (O-95).

    Rows wait until the smaller watermark has passed them, so versions that come late by less than the delay are met. State
    keeps the versions after the watermark and one before it.
    """
    return keyed_features(stream, on, ts, id_col, None, {}, (), "ordered", versions, version_ts, seq)


def asof_table(stream: DataFrame, dim: Callable[[], DataFrame], on: list[str], ts: str, dim_ts: str, seq: str, path: str, checkpoint: str, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Joins each micro-batch with a dimension table as it is then; batches are written under their id (idempotent)."""

    def enrich(batch: DataFrame, batch_id: int) -> None:
        out = finish(asof_join(batch, dim(), on, ts, dim_ts, seq=seq))
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(enrich).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The year 9000, in microseconds.
END_OF_TIME = 221_845_392_000_000_000


def closed(stream: DataFrame, ts: str, path: str) -> DataFrame:
    """stream and one row at the end of time, whose watermark lets all others out; for input that is all there.

    ``path`` is a new folder for that row's file. The row itself stays in state and never comes out of ``ordered`` forms.
    """
    spark = stream.sparkSession
    end = spark.range(1).select(*[(F.timestamp_micros(F.lit(END_OF_TIME)) if c == ts else F.lit(None)).cast(stream.schema[c].dataType).alias(c) for c in stream.columns])
    end.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(end.schema).parquet(path))


def fraud_features_stream(stream: DataFrame, cards: DataFrame, windows: dict[str, int], lags: list[str], table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Rolling sums, lags and the card version as of the time, from two streams with watermarks into a keyed table (O-96).

    One processor does all three in order of time, behind the watermark; the table's manifest of a batch is its commit, so
    a repeated batch leaves the table as it was.
    """
    rows = keyed_features(stream, ["cc_num"], "ts", "t_id", "amount", windows, lags, "ordered", cards, "last_modified", "version")
    return keyed_sink(rows, table, checkpoint)


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores parsed events and appends them with their predictions (O-80)."""
    return write_stream(scorer(stream), path, checkpoint)


def dedup_stream(stream: DataFrame, id_col: str, ts: str, delay: str) -> DataFrame:
    """Drops repeated ids that come within the delay; the state of older ids goes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


class _Late(StatefulProcessor):
    """Marks rows older than the watermark of the batch; keeps nothing."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for r in rows:
            _, us, *values = tuple(r)
            yield Row(**dict(zip(self.names, [*values, us is not None and us < mark], strict=True)))

    def close(self) -> None:
        pass


def mark_late(stream: DataFrame, ts: str, delay: str, groups: int | None = None) -> DataFrame:
    """stream with ``late``: true for rows older than the query's own watermark as their batch begins.

    The watermark is the newest time of earlier batches less the delay, in whole milliseconds, and survives restarts with
    the query. Rows without a time are not late. Rows are dealt to groups by a hash of all columns.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    times = [c for c in stream.columns if isinstance(stream.schema[c].dataType, TimestampType)]
    # numbers instead of the time column: Spark itself drops late rows where it sees that column
    values = [F.unix_micros(c).alias(c) if c in times else F.col(c) for c in stream.columns]
    dealt = marked.select(F.pmod(F.xxhash64(*stream.columns), F.lit(groups)).alias("_g"), F.unix_micros("_ts").alias("_us"), *values)
    schema = StructType([*[dealt.schema[c] for c in stream.columns], StructField("late", BooleanType())])
    out = dealt.groupBy("_g").transformWithState(_Late(schema.names), schema, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in times})


def late_split(stream: DataFrame, ts: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes rows in time to ``<path>/late=false`` and late ones to ``<path>/late=true``: two outputs of one sink (O-97)."""
    out = mark_late(stream, ts, delay)
    return out.writeStream.partitionBy("late").format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
