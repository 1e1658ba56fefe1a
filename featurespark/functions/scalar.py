"""Scalar column functions (O-14 to O-31)."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurespark.operators.quantiles import quantile_row


def select_except(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def prefixed(df: DataFrame, prefix: str, keys: list[str] = ()) -> DataFrame:
    """All columns but the keys renamed with a prefix."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keys})


def null_profile(df: DataFrame) -> DataFrame:
    """column_name, n_null in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_null")


def with_constants(df: DataFrame, values: dict[str, Column | object]) -> DataFrame:
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def between_time(df: DataFrame, ts: str, low: str, high: str) -> DataFrame:
    """Rows whose time of day lies between two HH:mm:ss texts, both included."""
    return df.filter(F.date_format(ts, "HH:mm:ss").between(low, high))


def time_parts(ts: str) -> dict[str, Column]:
    return {"hour": F.hour(ts), "date": F.to_date(ts), "day": F.date_trunc("day", ts)}


def band(col: Column, edges: list[float], labels: list[str]) -> Column:
    """labels[i] for values below edges[i], the last label otherwise; null stays null."""
    out = F.when(col.isNull(), None)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(col < edge, label)
    return out.otherwise(labels[-1])


# Lower edges of the air-quality bands, and where the last one ends.
AQI = [(0, "Good"), (50, "Moderate"), (100, "Unhealthy for Some"), (150, "Unhealthy"), (200, "Very Unhealthy"), (300, "Hazardous")]
AQI_END = 500


def aqi_category(col: Column) -> Column:
    """Category of a concentration; a fraction between two whole bands belongs to the lower one, outside is null."""
    out = F.when(col.isNull() | (col < AQI[0][0]) | (col > AQI_END), None)
    for edge, label in reversed(AQI):
        out = out.when(col >= edge, label)
    return out


def seconds_since(ts: Column, prev: Column) -> Column:
    """Whole seconds from prev to ts, toward zero; 0 without prev. May be negative."""
    return F.coalesce(F.timestamp_diff("SECOND", prev, ts), F.lit(0))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def ip_to_int(col: Column) -> Column:
    """The number of a dotted address; null if it is malformed."""
    parts = F.split(col, r"\.")
    numbers = [F.get(parts, i) for i in range(4)]
    good = (F.size(parts) == 4) & reduce(lambda a, b: a & b, [n.rlike(r"^[0-9]{1,3}$") for n in numbers])
    values = [n.try_cast("long") for n in numbers]
    good = good & reduce(lambda a, b: a & b, [v <= 255 for v in values])
    return F.when(good, ((values[0] * 256 + values[1]) * 256 + values[2]) * 256 + values[3])


def int_to_ip(col: Column) -> Column:
    parts = [F.shiftright(col, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(col.between(0, (1 << 32) - 1), F.concat_ws(".", *parts))


def same_subnet(a: Column, b: Column, bits: int) -> Column:
    """Whether two address numbers share their first bits."""
    return F.shiftright(a, 32 - bits) == F.shiftright(b, 32 - bits)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance of two points in degrees; null if a coordinate is."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.sin((c - a) / 2) ** 2 + F.cos(a) * F.cos(c) * F.sin((d - b) / 2) ** 2
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h)))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# Throw-away mail domains.
DISPOSABLE = ["mailinator.com", "guerrillamail.com", "10minutemail.com"]


def email_score(col: Column) -> Column:
    """Trust of an address, 0 to 100: 50, +30 for gov or edu, +20 for com or org, -40 for a throw-away domain."""
    valid = F.coalesce(col.rlike(f"^{EMAIL}$"), F.lit(False))
    domain = F.lower(F.regexp_extract(col, "@(.*)$", 1))
    top = F.substring_index(domain, ".", -1)
    score = F.lit(50) + F.when(top.isin("gov", "edu"), 30).when(top.isin("com", "org"), 20).otherwise(0)
    score = score - F.when(F.substring_index(domain, ".", -2).isin(DISPOSABLE), 40).otherwise(0)
    return F.when(valid, F.greatest(F.lit(0), F.least(F.lit(100), score))).otherwise(0)


def score_emails(df: DataFrame, text: str) -> DataFrame:
    """One row per address found in a text: df's columns but the text, email, email_score."""
    found = df.withColumn("email", F.explode(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1)))).drop(text)
    return found.withColumn("email_score", email_score(F.col("email")))


def row_max(cols: list[str]) -> Column:
    """The largest of several columns; nulls are skipped, NaN is larger than all."""
    return F.greatest(*cols)


def clip_quantile(df: DataFrame, col: str, q: float, lower: float | None = None) -> DataFrame:
    """df with values above the quantile set to it, and values below ``lower`` to that; null stays null."""
    top = quantile_row(df, {"_top": (col, q)})
    value = F.when(F.col(col) > F.col("_top"), F.col("_top")).otherwise(F.col(col))
    if lower is not None:
        value = F.when(value < lower, F.lit(float(lower))).otherwise(value)
    return df.crossJoin(F.broadcast(top)).withColumn(col, value).drop("_top")


def date_range(anchor: datetime.date, kind: str, *dates: datetime.date) -> tuple[datetime.date, datetime.date]:
    """First and last day of a period told relative to an anchor."""
    day, week = datetime.timedelta(days=1), anchor - datetime.timedelta(days=anchor.weekday())
    next_tuesday = anchor + day * ((1 - anchor.weekday() - 1) % 7 + 1)
    periods = {
        "today": (anchor, anchor),
        "yesterday": (anchor - day, anchor - day),
        "tomorrow": (anchor + day, anchor + day),
        "last week": (week - 7 * day, week - day),
        "rest of the week": (anchor, week + 6 * day),
        "next tuesday": (next_tuesday, next_tuesday),
    }
    return (dates[0], dates[1]) if kind == "between" else periods[kind]


def in_date_range(df: DataFrame, date: str, period: tuple[datetime.date, datetime.date]) -> DataFrame:
    """Rows whose timestamp falls on a day of the period; stated on the column itself, so that the scan can skip."""
    low, high = (datetime.datetime.combine(d, datetime.time()) for d in (period[0], period[1] + datetime.timedelta(days=1)))
    return df.filter((F.col(date) >= F.lit(low).cast("timestamp_ntz")) & (F.col(date) < F.lit(high).cast("timestamp_ntz")))
