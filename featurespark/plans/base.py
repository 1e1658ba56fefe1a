"""Registration of queries, and the roles that the driver's tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long and floating numbers to six digits, as the SQL side states them."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (IntegerType, ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), 6) + 0.0  # no negative zero
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL if SQL can say it."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """events as card transactions, with an address number."""
    ip = F.pmod(F.col("event_id") * F.lit(2654435761) + F.col("user_id") * 40503, F.lit(1 << 32))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("t_id"), F.col("user_id").alias("cc_num"), F.col("value").alias("amount"),
        (F.col("event_type") == "purchase").alias("card_present"), "ts", ip.alias("ip"),
    )


TX = """tx as (select event_id as t_id, user_id as cc_num, value as amount, event_type = 'purchase' as card_present, ts,
  (event_id * 2654435761 + user_id * 40503) % 4294967296 as ip from events)"""


def card_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-up events as versions of a card."""
    return table(spark, sf, "events").filter("event_type = 'signup'").select(
        F.col("user_id").alias("cc_num"), F.col("ts").alias("last_modified"), F.col("event_id").alias("version")
    )


CARDS = "cards as (select user_id as cc_num, ts as last_modified, event_id as version from events where event_type = 'signup')"


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Address ranges: an equal share for each nation, and a narrower one inside it with a place of its own."""
    n = F.col("n_nationkey").cast("long")
    low = n * 171798691
    nation = table(spark, sf, "nation")
    point = [(n * 7.0 - 80).alias("lat"), (n * 14.0 - 170).alias("lon")]
    wide = nation.select(low.alias("low"), (low + 171798690).alias("high"), F.col("n_name").alias("place"), *point)
    inner = nation.select((low + 40000000).alias("low"), (low + 90000000).alias("high"), F.concat("n_name", F.lit(" inner")).alias("place"), (n * 7.0 - 79.5).alias("lat"), (n * 14.0 - 169.5).alias("lon"))
    return wide.unionByName(inner)


PLACES = """places as (
  select n_nationkey::bigint * 171798691 as low, n_nationkey::bigint * 171798691 + 171798690 as high, n_name as place,
    n_nationkey * 7.0::double - 80 as lat, n_nationkey * 14.0::double - 170 as lon from nation
  union all
  select n_nationkey::bigint * 171798691 + 40000000, n_nationkey::bigint * 171798691 + 90000000, n_name || ' inner',
    n_nationkey * 7.0::double - 79.5, n_nationkey * 14.0::double - 169.5 from nation)"""
PLACED = f"""{TX}, {PLACES}, hit as (
  select t_id, place, lat, lon, row_number() over (partition by t_id order by high - low, place) as rn
  from tx join places on ip between low and high),
placed as (select tx.*, place, lat, lon from tx left join hit on tx.t_id = hit.t_id and rn = 1)"""

DAILY_SQL = "aq as (select o_orderdate as date, avg(o_totalprice) as pm25 from orders group by 1)"


def daily_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Mean order price per day as a daily measurement."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("pm25"))


def km_sql(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)"
    return f"2 * 6371.0 * asin(sqrt(case when {h} > 1 then 1 else {h} end))"


SCORED_SQL = """scored as (select doc_id, toxic as y, quality,
  ('0x' || substr(md5(doc_id::varchar || '|3'), 1, 8))::bigint as u from labels)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """labels with a number from a hash of the id, as outcome and score."""
    from featurespark.operators.training import md5_number

    return table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"), "quality", md5_number("doc_id", F.lit("3")).alias("u"))
