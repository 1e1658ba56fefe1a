"""Training data: imputing, encoding, scaling, splitting (O-71 to O-77).

What is fitted is a DataFrame of one row, or of one row per category, so that it can be stored and applied later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurespark.sources.tables import with_row_index

from .aggregates import mode
from .quantiles import quantile_row


@dataclass(frozen=True)
class Imputer:
    values: DataFrame
    cols: list[str]

    def apply(self, df: DataFrame) -> DataFrame:
        named = self.values.withColumnsRenamed({c: f"_i_{c}" for c in self.cols})
        out = df.crossJoin(F.broadcast(named))  # one row
        return out.withColumns({c: F.coalesce(c, f"_i_{c}") for c in self.cols}).drop(*named.columns)


def fit_imputer(train: DataFrame, spec: dict[str, object]) -> Imputer:
    """spec: column to ``mean``, ``median``, ``mode``, or a constant in a tuple such as ('UNKNOWN',).

    Medians and modes are found from counts of equal values, so that no task holds a column.
    """
    out = train.agg(F.count("*"), *[F.lit(k[0]).alias(c) if isinstance(k, tuple) else F.avg(c).alias(c) for c, k in spec.items() if k == "mean" or isinstance(k, tuple)]).drop("count(1)")
    if medians := {c: (c, 0.5) for c, k in spec.items() if k == "median"}:
        out = out.crossJoin(quantile_row(train, medians))  # one row each
    for c in [c for c, k in spec.items() if k == "mode"]:
        out = out.join(mode(train, c).select(F.col("mode").alias(c)), F.lit(True), "left")
    return Imputer(out.select(*spec), list(spec))


@dataclass(frozen=True)
class Ordinal:
    categories: dict[str, DataFrame]

    def apply(self, df: DataFrame, suffix: str = "_code") -> DataFrame:
        """df with the code of each column, -1 for what training did not have; Spark broadcasts small dictionaries."""
        for c, known in self.categories.items():
            df = df.join(known.select(F.col("category").alias(c), F.col("code").alias(f"{c}{suffix}")), c, "left").fillna(-1, [f"{c}{suffix}"])
        return df


def fit_ordinal(train: DataFrame, cols: list[str]) -> Ordinal:
    """Codes 0, 1, ... of the sorted distinct values of each column."""
    out = {}
    for c in cols:
        values = train.select(F.col(c).alias("category")).dropna().distinct()
        out[c] = with_row_index(values, ["category"], name="code").select("category", F.col("code").cast("int"))
    return Ordinal(out)


def fit_one_hot(train: DataFrame, col: str, most: int = 200) -> list:
    """The sorted distinct values of a column of few; more than ``most`` is an error (use ``fit_one_hot_vectors``)."""
    values = [r[0] for r in train.select(col).dropna().distinct().orderBy(col).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{col} has over {most} values")
    return values


def one_hot(df: DataFrame, col: str, values: list) -> DataFrame:
    """df with a 0/1 column for each value; unseen and null are 0 in all."""
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values})


def fit_one_hot_vectors(train: DataFrame, cols: list[str], suffix: str = "_vector") -> PipelineModel:
    """For columns of many values: a model that adds a sparse 0/1 vector a column, the values in order of their text.

    Unseen and null values are the last place, which training doesn't fill.
    """
    index = StringIndexer(inputCols=cols, outputCols=[f"{c}__index" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep")
    encode = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}{suffix}" for c in cols], dropLast=False)
    return Pipeline(stages=[index, encode]).fit(train)


@dataclass(frozen=True)
class MinMax:
    ends: DataFrame
    cols: list[str]

    def apply(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        out = df.crossJoin(F.broadcast(self.ends))  # one row
        scaled = {c + suffix: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in self.cols}
        return out.withColumns(scaled).drop(*self.ends.columns)


def fit_min_max(train: DataFrame, cols: list[str]) -> MinMax:
    ends = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for f, n in ((F.min, "_lo"), (F.max, "_hi"))]
    return MinMax(train.agg(*ends), cols)


def split_at(df: DataFrame, ts: str, start) -> DataFrame:
    """df with split: train before start, test from it."""
    return df.withColumn("split", F.when(F.col(ts) < F.lit(start), "train").when(F.col(ts).isNotNull(), "test"))


def split_windows(df: DataFrame, ts: str, windows: dict[str, tuple]) -> DataFrame:
    """df with the name of the half-open window [start, end) its time falls in, null outside all."""
    out = F.lit(None).cast("string")
    for name, (start, end) in reversed(list(windows.items())):
        out = F.when((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)), name).otherwise(out)
    return df.withColumn("split", out)


def split_last_dates(df: DataFrame, date: str, n: int, min_train: int = 1) -> DataFrame:
    """df with split: test for the last n distinct dates, train before. Too few dates to train on is an error."""
    dates = [r[0] for r in df.select(date).dropna().distinct().orderBy(F.desc(date)).limit(n + min_train).collect()]
    if len(dates) < n + min_train:
        raise ValueError(f"{len(dates)} dates are too few for {n} test and {min_train} training dates")
    return split_at(df, date, dates[n - 1])


def md5_number(*cols: Column | str) -> Column:
    """A number from 0 to 2**32 - 1 from the text of columns: the same on any partitioning and in other engines."""
    text = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def split_hash(df: DataFrame, id_col: str, fractions: dict[str, float], seed: int) -> DataFrame:
    """df with a random split by fractions (of sum 1) that depends on id and seed alone."""
    u, total, out = md5_number(id_col, F.lit(str(seed))), 0.0, None
    for name, share in list(fractions.items())[:-1]:
        total += share
        cond = u < int(total * (1 << 32))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    last = list(fractions)[-1]
    return df.withColumn("split", out.otherwise(last) if out is not None else F.lit(last))


def kfold(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """df with fold: k contiguous parts of a total order, the first ones a row larger if they don't come out even."""
    numbered = with_row_index(df, order)
    n = numbered.agg(F.count("*").alias("_n"))  # one row
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    i = F.col("row_index")
    fold = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return numbered.crossJoin(F.broadcast(n)).withColumn("fold", fold.cast("int")).drop("_n", "row_index")


def stratified_kfold(df: DataFrame, y: str, id_col: str, k: int, seed: int, salts: int = 64) -> DataFrame:
    """df with fold: each class dealt evenly to k folds in the order of a hash of the id.

    Rows without a class are a class. A class may hold most rows, so it is numbered in slices of the hash's range, counted slice by slice.
    """
    u = md5_number(id_col, F.lit(str(seed)))
    dealt = df.withColumn("_u", u).withColumn("_slice", F.shiftright("_u", 32 - (salts - 1).bit_length()))
    own = F.row_number().over(Window.partitionBy(y, "_slice").orderBy("_u", id_col))
    before = F.sum("n").over(Window.partitionBy(y).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy(y, "_slice").agg(F.count("*").alias("n")).select(y, "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    sizes = sizes.withColumnsRenamed({y: "_y", "_slice": "_s"})
    dealt = dealt.withColumn("_own", own)
    out = dealt.join(sizes, dealt[y].eqNullSafe(sizes["_y"]) & (dealt["_slice"] == sizes["_s"])).drop("_y", "_s")
    return out.withColumn("fold", ((F.col("_own") - 1 + F.col("_before")) % k).cast("int")).drop("_u", "_slice", "_own", "_before")
