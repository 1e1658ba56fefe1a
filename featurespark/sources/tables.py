"""Batch tables: reads, upserts, versions, numbering (O-01 to O-09, O-12, O-13)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import written


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, columns: list[str] | None = None, **options
) -> DataFrame:
    """A CSV, JSON, ORC or Parquet table; text formats need a schema, so that no pass is spent on guessing one."""
    if schema is None and fmt in ("csv", "json"):
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.select(*columns) if columns else df


def read_since(df: DataFrame, ts: str, start, end=None, inclusive: bool = False) -> DataFrame:
    """Rows after start (or from it) and before end; the bounds reach the scan."""
    low = F.col(ts) >= F.lit(start) if inclusive else F.col(ts) > F.lit(start)
    return df.filter(low if end is None else low & (F.col(ts) < F.lit(end)))


def incremental(df: DataFrame, ts: str, last, lookback: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fn over the rows after ``last`` with as much history as its longest window needs; only new rows come out.

    lookback is an interval such as ``7 DAYS``. The start is closed: a frame that includes its end needs that row.
    """
    since = df.filter(F.col(ts) >= F.expr(f"to_timestamp_ntz('{last}') - INTERVAL {lookback}"))
    return fn(since).filter(F.col(ts) > F.expr(f"to_timestamp_ntz('{last}')"))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order]))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(base: DataFrame, new: DataFrame, keys: list[str], event_time: str, seq: str) -> DataFrame:
    """base and new; of rows with the same keys and event time that of new wins, then that of the highest seq."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return newest(both, [*keys, event_time], [F.col("_new"), F.col(seq)]).drop("_new")


def latest(df: DataFrame, keys: list[str], order: list[str], ttl: str | None = None, now=None) -> DataFrame:
    """The newest row per key, by map-side combine; with ttl only rows of that age or less at ``now``."""
    if ttl is not None:
        df = df.filter(F.col(order[0]) >= F.expr(f"to_timestamp_ntz('{now}') - INTERVAL {ttl}"))
    row = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select("_row.*")


def snapshot_as_of(df: DataFrame, keys: list[str], order: list[str], t) -> DataFrame:
    """The newest version per key at time t."""
    return latest(df.filter(F.col(order[0]) <= F.lit(t)), keys, order)


def with_row_index(df: DataFrame, order: list[str], start: int = 0, name: str = "row_index", parts: int | None = None) -> DataFrame:
    """Numbers rows from start in a total order, without a window over all rows in one task.

    Rows are dealt by range of the order, counted per range, and numbered in their range from the counts before it.
    Ranges are found by sampling, so the dealt rows are written to the shared folder between the two passes. The result
    reads that one table: call it inside ``with scratch()`` and it goes with the scope.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").count()  # one row a partition
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = dealt.withColumn("_own", own).join(F.broadcast(sizes), "_part")
    return out.withColumn(name, F.col("_own") + F.col("_before") + (start - 1)).drop("_part", "_own", "_before")


def assign_ids(df: DataFrame, order: list[str], existing: DataFrame, id_col: str, name: str = "new_id") -> DataFrame:
    """Numbers df on from the highest id of an existing table."""
    top = existing.agg(F.max(id_col)).first()[0]
    return with_row_index(df, order, start=0 if top is None else top + 1, name=name)


def slice_rows(df: DataFrame, order: list[str], start: int, stop: int, drop: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Rows start to stop - 1 by position, some columns dropped or renamed."""
    out = with_row_index(df, order).filter((F.col("row_index") >= start) & (F.col("row_index") < stop))
    return out.drop("row_index", *drop).withColumnsRenamed(rename or {})


READING = "status string, data struct<iaqi: struct<pm25: struct<v: double>>>"


def parse_reading(df: DataFrame, json_col: str, schema: str = READING, ok: str | Column = "reply.status = 'ok'") -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a JSON reply column parsed with an explicit schema into ``reply``; missing nested fields are null.

    ok, a Column or SQL, judges a row by ``reply`` and the row's other columns; null is bad.
    """
    parsed = df.withColumn("reply", F.from_json(json_col, schema))
    good = F.coalesce(F.expr(ok) if isinstance(ok, str) else ok, F.lit(False))
    return parsed.filter(good), parsed.filter(~good)


def first_valid(cols: list[str], valid: Callable[[Column], Column]) -> Column:
    """The first of several columns that is usable."""
    return F.coalesce(*[F.when(valid(F.col(c)), F.col(c)) for c in cols])
