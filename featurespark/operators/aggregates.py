"""Aggregates, ordered heads, profiles and fits (O-58 to O-70)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .quantiles import quantile_row, quantiles


def group_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum, count, minimum, maximum and mean by key."""
    return df.groupBy(*keys).agg(
        F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")
    )


def agg_if(df: DataFrame, key: str, value: str, category: str, more_than: int = 1) -> DataFrame:
    """The largest value of each key whose rows have more than that many categories, else null."""
    return df.groupBy(key).agg(F.when(F.count_distinct(category) > more_than, F.max(value)).alias("value"))


def distinct_profile(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    """One row: the number of distinct values of each column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(f"n_{c}") for c in cols])


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of a total order; each task keeps k."""
    return df.orderBy(*order).limit(k)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("count"))


def mode(df: DataFrame, col: str) -> DataFrame:
    """The most frequent value, the smallest of equals: counted first, so that no task holds all values."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), col).limit(1).select(F.col(col).alias("mode"), "count")


def describe(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum of each numeric column.

    Exact quartiles come from running counts of equal values, so that no task holds a column; approximate ones take part
    in the one aggregate.
    """
    cols = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    shares, made = {"q25": 0.25, "q50": 0.5, "q75": 0.75}, []
    for c in cols:
        x = F.col(c).cast("double")
        made.append(
            F.struct(
                F.lit(c).alias("column_name"), F.count(c).alias("count"), F.avg(x).alias("mean"), F.stddev(x).alias("std"), F.min(x).alias("min"),
                *[F.percentile_approx(x, F.lit(q)).alias(n) for n, q in shares.items() if approximate], F.max(x).alias("max"),
            ).alias(c)
        )
    out = df.agg(*made).select(F.explode(F.array(*cols)).alias("r")).select("r.*")
    if not approximate:
        out = out.join(F.broadcast(quantiles(df, cols, shares)), "column_name").select(*out.columns[:-1], *shares, "max")
    return out


def daily_counts(df: DataFrame, ts: str, key: str | None = None) -> DataFrame:
    """Rows per day from the first day to the last, 0 where there is none; per key, over the key's own days.

    Rows without a key are counted as a key's, rows without a time are not.
    """
    keys = [key] if key else []
    counts = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("count"))
    counts = counts.filter("day is not null")
    span = counts.groupBy(*keys).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    counts = counts.withColumnsRenamed({c: f"_{c}" for c in [*keys, "day"]})
    same = reduce(lambda a, b: a & b, [span[c].eqNullSafe(counts[f"_{c}"]) for c in [*keys, "day"]])
    return span.join(counts, same, "left").select(*keys, "day", F.coalesce("count", F.lit(0)).alias("count"))


def daily_mean(df: DataFrame, ts: str, cols: list[str], limit: int) -> DataFrame:
    """Mean of columns per day, the first ``limit`` days."""
    day = F.date_trunc("day", ts).alias("day")
    return df.groupBy(day).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols]).orderBy("day").limit(limit)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """bin, low, high, count over equal bins from minimum to maximum; the last bin holds the maximum."""
    ends = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    at = F.least(F.floor((F.col(col) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    placed = df.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(ends)).select(F.coalesce(at, F.lit(0)).alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("count"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    frame = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", width.alias("_w"))
    frame = frame.select(F.col("bin").cast("long").alias("bin"), (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"))
    return frame.join(counts, "bin", "left").fillna(0, ["count"])


def range_summary(df: DataFrame, date: str, value: str) -> DataFrame:
    """One row: mean, minimum and maximum with their (first) dates."""
    worst = F.struct(F.col(value), -F.unix_date(F.to_date(date)))
    best = F.struct(F.col(value), F.unix_date(F.to_date(date)))
    return df.agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.min_by(date, best).alias("min_date"), F.max(value).alias("max"), F.max_by(date, worst).alias("max_date")
    )


def summary(df: DataFrame, key: str, amount: str, flag: str) -> DataFrame:
    """One row: events, keys, mean and median amount, share of keys with a flagged event."""
    by_key = df.groupBy(key).agg(F.max(F.col(flag).cast("int")).alias("bad")).agg(F.count("*").alias("n_keys"), F.avg("bad").alias("bad_share"))
    total = df.agg(F.count("*").alias("n_events"), F.avg(amount).alias("mean_amount"))
    return total.crossJoin(quantile_row(df, {"median_amount": (amount, 0.5)})).crossJoin(by_key)  # one row each


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of frames with the same columns, by name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def linfit(df: DataFrame, x: str, y: str, exclude: Column | None = None, slope: float | None = None) -> DataFrame:
    """One row: n, slope, intercept, r2 and rmse of the least-squares line over rows not excluded.

    A fixed slope leaves only the intercept free. Centred sums keep the residuals accurate; a second pass takes them.
    """
    rows = df.filter(~F.coalesce(exclude, F.lit(False))) if exclude is not None else df
    rows = rows.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    line = rows.agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.regr_r2("_y", "_x").alias("r2"))
    if slope is not None:
        line = line.withColumn("slope", F.lit(slope))
    line = line.withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    error = F.col("_y") - F.col("slope") * F.col("_x") - F.col("intercept")
    sums = rows.crossJoin(F.broadcast(line)).groupBy("n", "slope", "intercept", "r2").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    return sums
