"""Expectations, window statistics and drift (O-88 to O-92)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import train
from .training import md5_number


#: (column, statistic, least, most, strict)
Expectation = tuple[str, str, float | None, float | None, bool]


def judged(expectations: list[Expectation]) -> list[tuple[str, str, Column, Column]]:
    """(column, statistic, value, success) of each expectation, as aggregates; a value that is not there fails."""
    stats = {"min": F.min, "max": F.max, "mean": F.avg, "count": F.count}
    out = []
    for c, stat, least, most, strict in expectations:
        v = stats[stat](F.col(c)).cast("double")
        ok = F.lit(True)
        if least is not None:
            ok = ok & ((v > least) if strict else (v >= least))
        if most is not None:
            ok = ok & ((v < most) if strict else (v <= most))
        out.append((c, stat, v, F.coalesce(ok, F.lit(False))))
    return out


def validate(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """One row per expectation: observed value and success, in one pass."""
    made = [F.struct(F.lit(c).alias("column_name"), F.lit(stat).alias("statistic"), v.alias("observed"), ok.alias("success")) for c, stat, v, ok in judged(expectations)]
    return df.agg(F.array(*made).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def row_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, good rows, rejects): a rule that is null for a row fails it."""
    held = {f"_r_{k}": F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    judged = df.withColumns(held)
    counts = judged.agg(*[F.count_if(~F.col(f"_r_{k}")).alias(k) for k in rules], F.count("*").alias("_n"))
    report = counts.unpivot(["_n"], list(rules), "rule", "n_failed").withColumnRenamed("_n", "n_rows")
    report = report.withColumn("passed", F.col("n_failed") == 0)
    good = F.forall(F.array(*held), lambda x: x)
    return report, judged.filter(good).drop(*held), judged.filter(~good).drop(*held)


def interval(text: str) -> str:
    """An interval for SQL: ``1w``, ``3h`` or ``1d3h`` in days, hours, minutes and seconds; others such as ``7 DAYS`` stay."""
    short = text.replace(" ", "")
    if not re.fullmatch(r"([0-9]+[wdhms])+", short):
        return text
    size = {"w": 7 * 86400, "d": 86400, "h": 3600, "m": 60, "s": 1}
    return f"{sum(int(n) * size[u] for n, u in re.findall('([0-9]+)([wdhms])', short))} SECONDS"


def feature_stats(df: DataFrame, ts: str, now: str, offset: str, length: str | None, cols: list[str], pct: float = 1.0, id_col: str | None = None) -> DataFrame:
    """feature, count, mean, std, sum, min, max over the rows of [now - offset, now - offset + length).

    Offset and length are intervals such as ``7 DAYS`` or ``1w``, ``1d3h``; without length the window ends at now. pct keeps that share of
    rows by a hash of id_col, the same on any partitioning.
    """
    start = f"(timestamp_ntz'{now}' - INTERVAL {interval(offset)})"
    end = f"({start} + INTERVAL {interval(length)})" if length else f"timestamp_ntz'{now}'"
    rows = df.filter(f"`{ts}` >= {start} and `{ts}` < {end}")
    if pct < 1.0:
        rows = rows.filter(md5_number(id_col) < int(pct * (1 << 32)))
    made = []
    for c in cols:
        x = F.col(c).cast("double")
        made.append(F.struct(F.lit(c).alias("feature"), F.count(c).alias("count"), F.avg(x).alias("mean"), F.stddev(x).alias("std"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max")))
    return rows.agg(F.array(*made).alias("r")).select(F.explode("r").alias("r")).select("r.*")


METRICS = ["count", "mean", "std", "sum", "min", "max"]


def compare_stats(detected: DataFrame, reference: DataFrame | float, rules: list[tuple[str, str, float, bool, bool]]) -> DataFrame:
    """One row per rule (feature, metric, threshold, relative, strict): values, difference, and whether it has shifted.

    reference is another window's statistics, or a number. A window without rows is flagged and never shifted.
    """
    spark = detected.sparkSession
    wanted = spark.createDataFrame(rules, "feature string, metric string, threshold double, relative boolean, strict boolean")

    def long(stats: DataFrame, name: str) -> DataFrame:
        cast = stats.select("feature", F.col("count").alias("_n"), *[F.col(m).cast("double").alias(m) for m in METRICS])
        return cast.unpivot(["feature", "_n"], METRICS, "metric", name).withColumnRenamed("_n", f"{name}_count")

    out = wanted.join(long(detected, "detected"), ["feature", "metric"], "left")
    if isinstance(reference, DataFrame):
        out = out.join(long(reference, "reference"), ["feature", "metric"], "left")
    else:
        out = out.withColumns({"reference": F.lit(float(reference)), "reference_count": F.lit(1).cast("long")})
    gap = F.abs(F.col("detected") - F.col("reference"))
    difference = F.when(F.col("relative"), F.try_divide(gap, F.abs("reference"))).otherwise(gap)
    out = out.withColumn("difference", difference)
    over = F.when(F.col("strict"), F.col("difference") > F.col("threshold")).otherwise(F.col("difference") >= F.col("threshold"))
    empty_d, empty_r = F.coalesce(F.col("detected_count") == 0, F.lit(True)), F.coalesce(F.col("reference_count") == 0, F.lit(True))
    out = out.withColumns({"empty_detection": empty_d, "empty_reference": empty_r, "shifted": F.coalesce(over & ~empty_d & ~empty_r, F.lit(False))})
    return out.drop("detected_count", "reference_count")


def chunk_mae(df: DataFrame, ts: str, y: str, pred: str) -> DataFrame:
    """day, n, mae: realised mean absolute error per day."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count(y).alias("n"), F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae"))


def estimate_mae(reference: DataFrame, production: DataFrame, ts: str, features: list[str], y: str, pred: str) -> DataFrame:
    """day, n, estimated_mae of production rows without outcomes: a regressor of the absolute error fitted on reference rows."""
    errors = reference.withColumn("_error", F.abs(F.col(y) - F.col(pred)))
    model = train(errors, [*features, pred], "_error", kind="regressor")
    scored = model.transform(production.drop("prediction") if pred != "prediction" else production.withColumnRenamed("prediction", "_own"))
    return scored.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.avg("prediction").alias("estimated_mae"))
