"""Exact quantiles and running sums that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurespark.sources.shared import scratch, written


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """df with running sums (name: column) in a total order: summed in ranges of the order, then over the ranges.

    Ranges are found by sampling, so the dealt rows are written to the shared folder between the two passes. The result
    reads that one table: call it inside ``with scratch()`` and it goes with the scope.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    before = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = before.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"_o_{n}": F.sum(c).over(own) for n, c in sums.items()}).join(F.broadcast(before), "_part")
    return out.withColumns({n: F.col(f"_o_{n}") + F.col(f"_b_{n}") for n in sums}).drop("_part", *[f"{p}{n}" for n in sums for p in ("_o_", "_b_")])


def quantiles(df: DataFrame, cols: list[str], qs: dict[str, float]) -> DataFrame:
    """column_name and a column for each quantile (name: share), interpolated between neighbours; null without values.

    Equal values are counted first. The values at the positions asked for are found by running counts. The counts are
    deleted at the end; the result reads a table of one row a column.
    """
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("r"))
    counts = values.select("r.*").filter("v is not null").groupBy("column_name", "v").agg(F.count("*").alias("n"))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("to") > position) & (F.col("to") - F.col("n") <= position), F.col("v")))

    made = []
    for name, q in qs.items():
        position = (F.col("_n") - 1) * F.lit(q)
        made += [at(F.floor(position)).alias(f"_lo_{name}"), at(F.ceil(position)).alias(f"_hi_{name}"), F.max(position - F.floor(position)).alias(f"_w_{name}")]
    with scratch() as tables:
        upto = running_sums(counts, [F.col("column_name"), F.col("v")], {"upto": "n"})
        ends = upto.groupBy("column_name").agg(F.max("upto").alias("_end"), F.sum("n").alias("_n"))  # one row a column
        placed = upto.join(F.broadcast(ends), "column_name").withColumn("to", F.col("upto") - (F.col("_end") - F.col("_n")))
        found = tables.keep(written(placed.groupBy("column_name").agg(*made).coalesce(1)))
    between = {
        name: F.when(F.col(f"_lo_{name}") == F.col(f"_hi_{name}"), F.col(f"_lo_{name}")).otherwise(
            F.col(f"_lo_{name}") * (1 - F.col(f"_w_{name}")) + F.col(f"_hi_{name}") * F.col(f"_w_{name}")
        )
        for name in qs
    }
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column_name"))
    return every.join(F.broadcast(found), "column_name", "left").select("column_name", *[x.alias(n) for n, x in between.items()])


def quantile_row(df: DataFrame, named: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: named quantiles (name: column and share), all columns in one job."""
    cols = list(dict.fromkeys(c for c, _ in named.values()))
    shares = {f"_q{i}": q for i, q in enumerate(dict.fromkeys(q for _, q in named.values()))}
    of = {q: name for name, q in shares.items()}
    found = quantiles(df, cols, shares)
    return found.agg(*[F.max(F.when(F.col("column_name") == c, F.col(of[q]))).alias(name) for name, (c, q) in named.items()])
