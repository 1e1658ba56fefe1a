"""Scoring, training and model quality (O-78 to O-87)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from featurespark.ship import ship
from featurespark.sources.shared import scratch, written

from .quantiles import running_sums


def udf_forms(df: DataFrame, x: str, y: str, form: str = "native") -> DataFrame:
    """df with x * 1.1 + sin(x) and exp(-(x - y)**2 / 100) * sin(x / 10) * cos(y / 5), as ``native`` expressions or as
    ``pandas`` or ``python`` functions, which give the same but leave the JVM."""
    if form == "native":
        a, b = F.col(x), F.col(y)
        wave = F.exp(-((a - b) ** 2) / 100) * F.sin(a / 10) * F.cos(b / 5)
        return df.withColumns({"f": a * 1.1 + F.sin(a), "g": wave})

    def f(x):
        return x * 1.1 + np.sin(x)

    def g(x, y):
        return np.exp(-((x - y) ** 2) / 100) * np.sin(x / 10) * np.cos(y / 5)

    if form == "pandas":

        @F.pandas_udf("double")
        def pf(x: pd.Series) -> pd.Series:
            return f(x)

        @F.pandas_udf("double")
        def pg(x: pd.Series, y: pd.Series) -> pd.Series:
            return g(x, y)

        return df.withColumns({"f": pf(x), "g": pg(x, y)})
    plain_f = F.udf(lambda x: None if x is None else float(f(x)), "double")
    plain_g = F.udf(lambda x, y: None if x is None or y is None else float(g(x, y)), "double")
    return df.withColumns({"f": plain_f(x), "g": plain_g(x, y)})


def on_demand(df: DataFrame, fn: Callable[..., pd.Series], inputs: list[str], out: str, returns: DataType | str, drop: list[str] = ()) -> DataFrame:
    """df with a column from a pandas function of declared type, and some of its inputs dropped."""
    return df.withColumn(out, F.pandas_udf(fn, returns)(*inputs)).drop(*drop)


def score(df: DataFrame, model, features: list[str], out: str = "prediction") -> DataFrame:
    """df with predictions. A Spark model transforms; any other with ``predict`` is broadcast, once an executor."""
    if isinstance(model, Model):
        return model.transform(df)
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            yield pd.Series(np.asarray(own.predict(batch), dtype=float))

    return df.withColumn(out, predict(F.struct(*features)))


@dataclass(frozen=True)
class Line:
    """A model of one feature, as ``aggregates.linfit`` fits it."""

    slope: float
    intercept: float

    def predict(self, x: pd.DataFrame) -> pd.Series:
        return x.iloc[:, 0] * self.slope + self.intercept


def train(df: DataFrame, features: list[str], label: str, categorical: list[str] = (), weight: str | None = None, kind: str = "classifier", **options) -> Model:
    """A gradient-boosted classifier or regressor with imputing and indexing in one pipeline."""
    numeric = [c for c in features if c not in categorical]
    filled, coded = [f"{c}__filled" for c in numeric], [f"{c}__code" for c in categorical]
    stages = [Imputer(inputCols=numeric, outputCols=filled)] if numeric else []
    stages += [StringIndexer(inputCols=list(categorical), outputCols=coded, handleInvalid="keep")] if categorical else []
    stages += [VectorAssembler(inputCols=filled + coded, outputCol="features__vector")]
    options = {"maxIter": 10, "maxDepth": 3, "seed": 7} | options | ({"weightCol": weight} if weight else {})
    learner = {"classifier": GBTClassifier, "regressor": GBTRegressor}[kind]
    return Pipeline(stages=[*stages, learner(featuresCol="features__vector", labelCol=label, **options)]).fit(df)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """One row: negatives, positives, their ratio."""
    bad, good = F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)
    return df.agg(bad.alias("negatives"), good.alias("positives"), F.try_divide(bad, good).alias("scale_pos_weight"))


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class and as weighted average: precision, recall, f1, support; and accuracy."""
    cells = confusion(df, y, pred)
    sides = F.explode(F.array(F.struct(F.col("actual").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("p"))))
    per = cells.withColumn("s", sides).groupBy(F.col("s.c").cast("string").alias("class")).agg(
        F.sum(F.when((F.col("actual") == F.col("predicted")) & (F.col("s.a") == 1), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.col("n") * F.col("s.a")).alias("support"), F.sum(F.col("n") * F.col("s.p")).alias("said"),
    )
    p, r = F.coalesce(F.try_divide(F.col("hit"), F.col("said")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0))
    per = per.select("class", "hit", "support", p.alias("precision"), r.alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    per = per.withColumn("f1", f1)

    def weighted(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)

    total = per.agg(weighted("precision"), weighted("recall"), weighted("f1"), F.sum("support").alias("support"), F.try_divide(F.sum("hit"), F.sum("support")).alias("accuracy"))
    out = per.drop("hit").withColumn("accuracy", F.lit(None).cast("double"))
    return out.unionByName(total.withColumn("class", F.lit("weighted")))


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """score, tp, fp (rows at or above the score), pos, neg: one row a distinct score.

    Rows are counted by score first; the running counts are taken in ranges that hold about as many scores each.
    """
    by = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n")).filter("score is not null")
    out = running_sums(by, [F.desc("score")], {"tp": "p", "fp": "n"})
    ends = out.agg(F.max("tp").alias("pos"), F.max("fp").alias("neg"))  # one row
    return out.crossJoin(F.broadcast(ends)).select("score", "tp", "fp", "p", "n", "pos", "neg")


def pr_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """score, precision, recall at each threshold."""
    points = roc_points(df, y, score)
    return points.select("score", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "pos").alias("recall"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: roc_auc, pr_auc (trapezoid, from recall 0 at precision 1), average_precision. Tied scores are one step."""
    before_tp, before_fp = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    last = F.coalesce(F.try_divide(before_tp, before_tp + before_fp), F.lit(1.0))
    areas = (
        F.try_divide(F.sum(F.col("n") * (before_tp + F.col("tp")) / 2), F.max(F.col("pos") * F.col("neg"))).alias("roc_auc"),
        F.try_divide(F.sum(F.col("p") * (precision + last) / 2), F.max("pos")).alias("pr_auc"),
        F.try_divide(F.sum(F.col("p") * precision), F.max("pos")).alias("average_precision"),
    )
    with scratch() as tables:  # the running counts go, one row stays
        steps = roc_points(df, y, score).filter((F.col("p") + F.col("n")) > 0)
        return tables.keep(written(steps.agg(*areas).coalesce(1)))


def regression_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: mse, rmse, mae, r2 (0 where it is undefined)."""
    a, b = F.col(y).cast("double"), F.col(pred).cast("double")
    rows = df.filter(a.isNotNull() & b.isNotNull())
    mse = F.avg((a - b) ** 2)
    r2 = F.coalesce(1 - F.try_divide(mse, F.var_pop(a)), F.lit(0.0))
    return rows.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(a - b)).alias("mae"), F.when(F.isnan(r2), 0.0).otherwise(r2).alias("r2"))


def log_predictions(df: DataFrame, path: str, keys: list[str], features: list[str], prediction: str, event_time: str, batch_id: int | None = None) -> None:
    """Appends keys, features, prediction and event time to a Parquet log; a batch id makes a repeated batch replace itself."""
    rows = df.select(*keys, *features, prediction, event_time)
    if batch_id is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def best_run(metrics: DataFrame, name: str, metric: str, direction: str = "max") -> DataFrame:
    """Per model name the run with the best metric, the first run of equals."""
    best = F.col(metric) if direction == "max" else -F.col(metric)
    row = F.min_by(F.struct(*metrics.columns), F.struct(-best, F.col("run")))
    return metrics.filter(F.col(metric).isNotNull()).groupBy(name).agg(row.alias("_r")).select("_r.*")
