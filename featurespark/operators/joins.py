"""Joins (O-32 to O-41)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all_set(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_ts: str,
    right_ts: str,
    how: str = "left",
    seq: str | None = None,
    tolerance: str | None = None,
    strategy: str = "union",
    bucket: str = "day",
) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time; of equal times the highest seq.

    ``union`` sorts both sides together once per key. ``bucketed`` cuts a key's time line into buckets, so that a key of
    any size is spread over tasks, and carries the last right row of earlier buckets over a table of one row per key and
    bucket. ``range`` joins by key with a time condition, for a right side of a few rows per key.
    Null keys and times match nothing. Right columns named like left ones are dropped, the keys and right_ts included
    only if the left has them.
    """
    extra = [c for c in right.columns if c not in left.columns]
    right = right.filter(_all_set([*on, right_ts]))
    if strategy == "range":
        return _asof_range(left, right, on, left_ts, right_ts, how, seq, tolerance, extra)
    value = F.struct(F.col(right_ts).alias("_at"), *[F.col(c).alias(c) for c in extra])
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    key_names = [f"_k{i}" for i in range(len(on))]
    order = F.col(seq) if seq else F.lit(0)
    rows = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[seq] if seq else "int").alias("_seq"), F.struct(*left.columns).alias("_l"))
    versions = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), order.alias("_seq"), value.alias("_r"))
    both = rows.unionByName(versions, allowMissingColumns=True)
    if strategy == "bucketed":
        both = both.withColumn("_bucket", F.date_trunc(bucket, "_ts"))
        last = F.max_by("_r", F.struct("_ts", "_seq"))
        ends = both.groupBy(*key_names, "_bucket").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_ts", "_seq"))).alias("_end"))
        earlier = Window.partitionBy(*key_names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*key_names, "_bucket", F.last("_end", True).over(earlier).alias("_carry"))
        within = Window.partitionBy(*key_names, "_bucket").orderBy("_ts", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_r", F.last("_r", True).over(within)).filter("_side = 1")
        same = reduce(lambda a, b: a & b, [both[c].eqNullSafe(ends[c]) for c in [*key_names, "_bucket"]])
        out = both.join(ends, same, "left").select(both["_l"], *[both[c] for c in key_names], F.coalesce(both["_r"], ends["_carry"]).alias("_r"), both["_ts"])
    else:
        upto = Window.partitionBy(*key_names).orderBy("_ts", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_r", F.last("_r", True).over(upto)).filter("_side = 1")
    good = _all_set([*key_names, "_ts"])
    if tolerance:
        good = good & (F.col("_r._at") >= F.col("_ts") - F.expr(f"INTERVAL {tolerance}"))
    out = out.withColumn("_r", F.when(good, F.col("_r")))
    if how == "inner":
        out = out.filter("_r is not null")
    return out.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in extra])


def _asof_range(left, right, on, left_ts, right_ts, how, seq, tolerance, extra) -> DataFrame:
    rows = left.withColumn("_id", F.monotonically_increasing_id())
    r = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], F.col(right_ts).alias("_at"), (F.col(seq) if seq else F.lit(0)).alias("_seq"), F.struct(*[F.col(c) for c in extra]).alias("_r"))
    when = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(on)]) & (F.col("_at") <= F.col(left_ts))
    if tolerance:
        when = when & (F.col("_at") >= F.col(left_ts) - F.expr(f"INTERVAL {tolerance}"))
    met = rows.join(r, when, "inner" if how == "inner" else "left")
    best = met.groupBy("_id").agg(F.max_by("_r", F.struct("_at", "_seq")).alias("_r"), F.first(F.struct(*left.columns)).alias("_l"))
    return best.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in extra])


@dataclass(frozen=True)
class PITQuery:
    """A point-in-time join of labels with a tree of feature tables; nothing runs before ``build``.

    A table with an event time joins as of the label's time, one without by key alone. Columns get the join's prefix.
    """

    base: DataFrame
    event_time: str
    joins: tuple = field(default=())

    def join(self, features: DataFrame, on: dict[str, str], how: str = "left", prefix: str = "", event_time: str | None = None, seq: str | None = None, at: str | None = None) -> PITQuery:
        """on maps columns of what has been joined so far to columns of features; at: another time column to join at."""
        return replace(self, joins=(*self.joins, (features, on, how, prefix, event_time, seq, at)))

    def build(self) -> DataFrame:
        out = self.base
        for features, on, how, prefix, event_time, seq, at in self.joins:
            named = features.withColumnsRenamed({c: f"{prefix}{c}" for c in features.columns})
            named = named.withColumnsRenamed({f"{prefix}{r}": f"_on_{i}" for i, r in enumerate(on.values())})
            clash = [c for c in named.columns if c in out.columns]
            if clash:
                raise ValueError(f"columns {clash} are there already; give the features a prefix")
            left = out.withColumns({f"_on_{i}": F.col(c) for i, c in enumerate(on)})
            keys = [f"_on_{i}" for i in range(len(on))]
            if event_time:
                out = asof_join(left, named, keys, at or self.event_time, f"{prefix}{event_time}", how, f"{prefix}{seq}" if seq else None)
            else:
                out = left.join(named, keys, how)
            out = out.drop(*keys)
        return out


def equi_join(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Join on several keys of differing names; the right keys are dropped."""
    when = reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in on.items()])
    return left.join(right, when, how).drop(*[right[b] for b in on.values()])


def left_join_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join with values for what is missing."""
    return left.join(right, on, "left").fillna(defaults)


def enforce_fk(df: DataFrame, ref: DataFrame, key: str, ref_key: str, on_invalid: str = "split") -> tuple[DataFrame, DataFrame]:
    """(rows whose key exists in ref, the others); with ``fail`` an error if there are others."""
    keys = ref.select(F.col(ref_key).alias(key)).distinct()
    good, bad = df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")
    if on_invalid == "fail" and not bad.isEmpty():
        raise ValueError(f"{key} has values that {ref_key} lacks")
    return good, bad


def label_by_membership(df: DataFrame, labels: DataFrame, keys: list[str], name: str = "is_fraud") -> DataFrame:
    """df with a flag: its keys occur in labels. Spark broadcasts the labels when they are small."""
    known = labels.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(known, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def ip_lookup(df: DataFrame, ip: str, ranges: DataFrame) -> DataFrame:
    """df with the columns of the narrowest range (low, high, place, ...) that holds the IPv4 address, then of the first place.

    Ranges are cut into aligned blocks of 2**level addresses, at most two of a level; an address looks up the one block of
    each level that occurs. So the join is an equi-join whose pairs are hits only, however many ranges lie side by side.
    """
    extra = [c for c in ranges.columns if c not in ("low", "high")]
    inside = ranges.withColumns({"_lo": F.greatest("low", F.lit(0)).cast("long"), "_hi": F.least("high", F.lit((1 << 32) - 1)).cast("long") + 1})
    ends = """filter(flatten(transform(transform(sequence(0, 32),
        b -> struct(b as level, shiftright(_lo + shiftleft(1L, b) - 1, b) as first, shiftright(_hi, b) as after)),
        x -> array(struct(x.level as level, if(x.first < x.after and x.first % 2 = 1, x.first, null) as block),
                   struct(x.level as level, if(x.first < x.after and x.after % 2 = 1, x.after - 1, null) as block)))),
        y -> y.block is not null)"""
    listed = inside.filter("low is not null and high is not null").withColumn("_b", F.explode(F.expr(ends))).select("low", "high", *extra, "_b.*")
    levels = sorted(r[0] for r in listed.select("level").distinct().collect())  # 33 at most
    ask = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(F.col("_ip").cast("long"), n).alias("block")) for n in levels or [0]]))
    asked = df.filter(F.col(ip).isNotNull()).select(F.col(ip).alias("_ip")).distinct().select("_ip", ask.alias("_a")).select("_ip", "_a.*")
    best = asked.join(listed, ["level", "block"]).groupBy("_ip").agg(F.min_by(F.struct(*extra), F.struct((F.col("high") - F.col("low")), F.col("place"))).alias("_r"))
    return df.join(best, F.col(ip) == F.col("_ip"), "left").select(*df.columns, *[F.col(f"_r.{c}").alias(c) for c in extra])


def home_relation(df: DataFrame, home: str, other: str, edges: DataFrame) -> DataFrame:
    """df with relation: home, neighbour or far. Spark broadcasts edges (place, neighbour) while they are small."""
    known = edges.select(F.col("place").alias(home), F.col("neighbour").alias(other)).distinct().withColumn("_near", F.lit(True))
    relation = F.when(F.col(home) == F.col(other), "home").when(F.col("_near"), "neighbour").otherwise("far")
    return df.join(known, [home, other], "left").withColumn("relation", relation).drop("_near")


def feature_vectors(requests: DataFrame, views: list[tuple[DataFrame, list[str], list[str]]], given: dict[str, str] | None = None) -> DataFrame:
    """Requests with the latest features of each view (table, keys, order); given: request column that wins over a feature."""
    from featurespark.sources.tables import latest

    out = requests
    for table, keys, order in views:
        out = out.join(latest(table, keys, order).drop(*[c for c in order if c in out.columns and c not in keys]), keys, "left")
    return out.withColumns({f: F.coalesce(F.col(r), F.col(f)) for r, f in (given or {}).items()})


def hindcast(predictions: DataFrame, outcomes: DataFrame, on: list[str], horizon: int = 1, horizon_col: str = "days_before_forecast_day") -> DataFrame:
    """Predictions of one horizon beside what happened, in order of the keys."""
    return predictions.filter(F.col(horizon_col) == horizon).join(outcomes, on).orderBy(*on)


def hindcast_or_recent(predictions: DataFrame, outcomes: DataFrame, on: list[str], date: str, n: int = 10, **options) -> DataFrame:
    """The hindcast; while there is none yet, the last n predictions without outcomes."""
    found = hindcast(predictions, outcomes, on, **options)
    if not found.isEmpty():
        return found
    missing = [F.lit(None).cast(outcomes.schema[c].dataType).alias(c) for c in outcomes.columns if c not in on]
    return recent_backfill(predictions, date, n).select("*", *missing).select(*found.columns)


def recent_backfill(df: DataFrame, date: str, n: int) -> DataFrame:
    """The last n rows by date, in order of date: for when there is no hindcast yet."""
    return df.orderBy(F.desc(date)).limit(n).orderBy(date)
