"""Windows and sequences of events per entity (O-42 to O-57)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurespark.functions.scalar import haversine_km

SECOND = 1_000_000


def interval(micros: int) -> str:
    """A day-time interval literal."""
    s, us = divmod(micros, SECOND)
    return f"INTERVAL '{s // 86400} {s // 3600 % 24:02}:{s // 60 % 60:02}:{s % 60:02}.{us:06}' DAY TO SECOND"


def over_time(aggregate: str, keys: list[str], ts: str, seconds: int, closed: str = "both") -> Column:
    """An aggregate (SQL text) over the trailing window; rows of the same time always see each other.

    ``both`` includes the row exactly ``seconds`` ago, ``right`` leaves it out (a microsecond less).
    """
    back = interval(seconds * SECOND - (closed == "right"))
    by = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"{aggregate} OVER (PARTITION BY {by} ORDER BY `{ts}` RANGE BETWEEN {back} PRECEDING AND CURRENT ROW)")


RADIX = 32
TASK_ROWS = 250_000  # to be sorted in a task, those that are moved on included
FEW_TASKS = 200  # up to so many tasks are written to by Spark without holding the rows to be dealt in memory
CELL_PART = 16  # of TASK_ROWS: rows of a key and bucket, which are in one task
SLOTS = 1 << 17  # in which keys and buckets are counted


def _floor(at: str, width: int) -> Column:
    """Whole-number division that rounds down; exact where doubles are not."""
    return F.expr(f"({at} - pmod({at}, {width}L)) div {width}L")


def _range_sums(rows: DataFrame, names: list[str], v: list[str], spans: list[int], width: int, own: bool, tasks: int) -> DataFrame:
    """rows with _s<i><c>: the sum of c over rows of the same names with _at in [_at - spans[i], _at], or before _at.

    The line is cut into buckets of ``width``, at most the shortest span. A row's range is the end of a bucket, whole
    buckets, and the beginning of the row's own. The end comes from rows moved on by the span and added up backwards within
    the bucket in which they land. What lies before the own bucket after that begins at the same offset in every bucket, so
    it is the same for all rows of a bucket: a part of one bucket and a range of whole ones. Ranges of many buckets are the
    same problem on the table of buckets, RADIX times as wide.

    Rows that are moved on by spans[i] have _i = i, others -1; so all have the same few columns, and sorts stay small.
    """
    keys, payload = [*names, "_b"], [c for c in rows.columns if c not in (*names, "_at", *v)]
    rows = rows.select(*names, "_at", *v, F.lit(-1).alias("_i"), F.struct(F.lit(1).alias("_is"), *payload).alias("_row")).withColumn("_b", _floor("_at", width))
    placed = rows.filter("_b is not null")
    both, whole = rows, [F.sum(c).alias(c) for c in v]
    n = [-(-span // width) - 1 for span in spans]  # buckets between the own one and the one in which the range begins
    cut = [-span % width for span in spans]
    for i, span in enumerate(spans):
        left = placed.select(*names, (F.col("_at") + span).alias("_at"), *v, F.lit(i).alias("_i"))
        both = both.unionByName(left.withColumn("_b", _floor("_at", width)), allowMissingColumns=True)
        if n[i] and cut[i]:
            whole += [F.sum(F.when(F.col("_at") - F.col("_b") * width >= cut[i], F.col(c))).alias(f"_cut{i}{c}") for c in v]
    steps = {i: n[i] - (cut[i] > 0) for i in range(len(spans)) if n[i]}
    if steps:
        # dealt to as many tasks as all else: groups of one session-wide number of tasks would grow with the rows
        table = placed.select(*keys, "_at", *v).repartition(tasks, *keys).groupBy(*keys).agg(*whole).withColumnRenamed("_b", "_at")
        far = [i for i, m in steps.items() if m > RADIX]
        if far:
            table = _range_sums(table, names, v, [steps[i] for i in far], RADIX, False, tasks)
        table = table.repartition(tasks, *names)
        by = Window.partitionBy(*names).orderBy("_at")
        middle = []
        for i, m in steps.items():
            for c in v:
                parts = [F.col(f"_s{far.index(i)}{c}")] if i in far else [F.sum(c).over(by.rangeBetween(-m, -1))] if m else []
                parts += [F.sum(f"_cut{i}{c}").over(by.rangeBetween(-n[i], -n[i]))] if cut[i] else []
                middle.append(_total(parts, rows.schema[c].dataType).alias(f"{i}{c}"))
        table = table.select(*names, F.col("_at").alias("_b"), F.struct(*middle).alias("_mid"))
        both = both.unionByName(table, allowMissingColumns=True)
    both = both.repartition(tasks, *keys)
    cell = Window.partitionBy(*keys)
    upto = cell.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0 if own else -1)
    from_here = cell.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    made = {f"_own{c}": F.sum(F.when(F.col("_i") == -1, F.col(c))).over(upto) for c in v}
    made |= {f"_to{i}{c}": F.sum(F.when(F.col("_i") == i, F.col(c))).over(from_here) for i in range(len(spans)) for c in v}
    made |= {"_all": F.max("_mid").over(cell)} if steps else {}  # one row a cell has it
    both = both.withColumns(made).filter("_row is not null")
    out = []
    for i in range(len(spans)):
        for c in v:
            parts = [F.col(f"_own{c}"), F.col(f"_to{i}{c}")] + ([F.col("_all").getField(f"{i}{c}")] if i in steps else [])
            out.append(_total(parts, rows.schema[c].dataType).alias(f"_s{i}{c}"))
    return both.select(*names, "_at", *v, *[F.col(f"_row.`{c}`").alias(c) for c in payload], *out)


def _total(parts: list[Column], kind) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0).cast(kind)) for x in parts]).cast(kind)


def _tasks(rows: int, least: int) -> int:
    """One for TASK_ROWS; those beyond FEW_TASKS only when a task would have over four times as many rows."""
    tasks = -(-rows // TASK_ROWS)
    return max(least, min(tasks, max(FEW_TASKS, -(-tasks // 4))))


def _count_and_width(rows: DataFrame, names: list[str], shortest: int) -> tuple[int, int]:
    """The number of rows, and a width of buckets: the shortest span, or so much less that no key has a crowded bucket.

    Keys and buckets are counted by hash in SLOTS, so a task holds no more than these; several in a slot only make buckets
    narrower than they need be. Rows of the same time stay together: where narrower buckets don't help, wider ones are taken.
    """
    most = {}
    width = shortest
    while True:
        slot = F.when(F.col("_at").isNotNull(), F.pmod(F.xxhash64(*names, _floor("_at", width)), F.lit(SLOTS)))
        sizes = rows.groupBy(slot.alias("_slot")).count()
        n, crowd = sizes.agg(F.sum("count"), F.max(F.when(F.col("_slot").isNotNull(), F.col("count")))).first()
        most[width] = crowd or 0
        if most[width] <= max(1, TASK_ROWS // CELL_PART) or width == 1:
            return n or 0, next(w for w, m in most.items() if m <= 2 * most[width])
        width = max(1, width // RADIX)


def bucketed_sums(
    df: DataFrame, keys: list[str], ts: str, values: dict[str, Column], windows: dict[str, int], closed: str = "both"
) -> DataFrame:
    """df with the sum of each value over each trailing window, as <value>_<window>, in time that does not grow with a frame.

    See _range_sums: buckets are as long as the shortest window, whatever the other lengths, or shorter where more than a
    sixteenth of a task's rows would be in one. All sums are sums of what is inside the window, and a key of any size is
    spread over tasks by bucket; only a row a key and bucket comes together for a whole key. Rows without a time see each other.

    The rows are counted first: the number of tasks goes with them, so that what a task sorts does not grow with df.
    """
    spans = [seconds * SECOND - (closed == "right") for seconds in windows.values()]
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(df.schema[ts].dataType), F.col(ts))
    names, v = [f"_k{i}" for i in range(len(keys))], [f"_v{j}" for j in range(len(values))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], at.alias("_at"), F.struct(*df.columns).alias("_df"), *[x.alias(c) for x, c in zip(values.values(), v, strict=True)])
    n, width = _count_and_width(rows.select(*names, "_at"), names, min(spans))
    tasks = _tasks(n * (1 + len(spans)), df.sparkSession.sparkContext.defaultParallelism)
    out = _range_sums(rows, names, v, spans, width, True, tasks)
    made = [F.col(f"_s{i}{c}").alias(f"{name}_{window}") for i, window in enumerate(windows) for c, name in zip(v, values, strict=True)]
    return out.select("_df.*", *made)


def rolling(
    df: DataFrame, keys: list[str], ts: str, value: str, windows: dict[str, int], closed: str = "both", strategy: str = "frame"
) -> DataFrame:
    """df with sum_<name> (nulls as 0) and num_<name> (nulls not counted) over each trailing window of seconds.

    ``frame``: all windows share one exchange, one sort and one pass. ``bucketed`` suits hot keys and frames of many rows
    (see bucketed_sums).
    """
    if strategy == "bucketed":
        sums = {"sum": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "num": F.col(value).isNotNull().cast("long")}
        return bucketed_sums(df, keys, ts, sums, windows, closed)
    out = {}
    for name, seconds in windows.items():
        out[f"sum_{name}"] = over_time(f"sum(coalesce(`{value}`, 0D))", keys, ts, seconds, closed)
        out[f"num_{name}"] = over_time(f"count(`{value}`)", keys, ts, seconds, closed)
    return df.withColumns(out)


def lag_features(df: DataFrame, key: str, ts: str, cols: list[str], tie: str, prefix: str = "prev_") -> DataFrame:
    """df with the previous values of columns per key in time order, equal times by ``tie``."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    return df.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in cols})


def seq_in_group(df: DataFrame, key: str, order: list[str], name: str = "seq") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def group_count(df: DataFrame, key: str, name: str = "group_count") -> DataFrame:
    """df with its group's size: counted with map-side combine and joined, so a hot group is never in one task.

    Rows without a key are a group.
    """
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias(name))
    return df.join(sizes, df[key].eqNullSafe(sizes["_key"])).drop("_key")


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def fraud_rate(df: DataFrame, key: str, ts: str, flag: str, days: dict[str, int], closed: str = "both") -> DataFrame:
    """df with rate_<name> and count_<name> of flagged rows over each trailing number of days."""
    sums = {"count": F.lit(1).cast("long"), "_flagged": F.coalesce(F.col(flag).cast("long"), F.lit(0))}
    out = bucketed_sums(df, [key], ts, sums, {name: n * 86400 for name, n in days.items()}, closed)
    out = out.withColumns({f"rate_{name}": F.try_divide(f"_flagged_{name}", f"count_{name}") for name in days})
    return out.drop(*[f"_flagged_{name}" for name in days])


def weighted_daily_rate(df: DataFrame, date: str, key: str, rate: str, count: str) -> DataFrame:
    """Per date and entity: total count, and the average of rates weighted by count."""
    total = F.sum(count)
    return df.groupBy(date, key).agg(total.alias("count"), F.try_divide(F.sum(F.col(rate) * F.col(count)), total).alias("rate"))


def travel_check(
    df: DataFrame, key: str, ts: str, lat: str, lon: str, present: str, tie: str, max_kmh: float = 1100.0, unknown: str = "null"
) -> DataFrame:
    """df with distance_km from the previous event, gap_s, and travel_feasible.

    Infeasible: another place at the same time, or faster than max_kmh, if the card is present now or was before. With
    ``unknown='zero'`` a place that is not known counts as (0, 0); by default it makes travel feasible.
    """
    if unknown == "zero":
        df = df.withColumns({lat: F.coalesce(lat, F.lit(0.0)), lon: F.coalesce(lon, F.lit(0.0))})
    w = Window.partitionBy(key).orderBy(ts, tie)
    out = df.withColumns({f"_p{i}": F.lag(c).over(w) for i, c in enumerate((ts, lat, lon, present))})
    out = out.withColumn("distance_km", haversine_km(F.col("_p1"), F.col("_p2"), F.col(lat), F.col(lon)))
    out = out.withColumn("gap_s", F.timestamp_diff("SECOND", F.col("_p0"), F.col(ts)))
    too_fast = F.when(F.col("gap_s") <= 0, F.col("distance_km") > 0).otherwise(F.col("distance_km") / (F.col("gap_s") / 3600) > max_kmh)
    applies = F.coalesce(F.col(present), F.lit(False)) | F.coalesce(F.col("_p3"), F.lit(False))
    return out.withColumn("travel_feasible", ~(applies & F.coalesce(too_fast, F.lit(False)))).drop("_p0", "_p1", "_p2", "_p3")


def detect_bursts(df: DataFrame, key: str, ts: str, amount: str, minutes: int = 30, min_n: int = 5, mult: float = 3.0) -> DataFrame:
    """Keys with min_n events within the trailing minutes, or a largest amount over mult times the mean."""
    counted = bucketed_sums(df, [key], ts, {"_n": F.lit(1).cast("long")}, {"window": minutes * 60}).withColumnRenamed("_n_window", "_n")
    mean, most = F.avg(amount), F.max(amount)
    out = counted.groupBy(key).agg(
        F.count("*").alias("n_events"), F.max("_n").alias("max_in_window"), mean.alias("mean_amount"), most.alias("max_amount"),
        F.try_divide(most, mean).alias("amount_ratio"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.sum(amount).alias("total_amount"),
    )
    return out.filter((F.col("max_in_window") >= min_n) | (F.col("max_amount") > mult * F.col("mean_amount")))


def detect_far_pairs(df: DataFrame, key: str, ts: str, tie: str, lat: str, lon: str, km: float = 100.0, minutes: int = 60) -> DataFrame:
    """Events followed in under the minutes by one over km away: distance_km, gap_s, speed_kmh (infinite for no gap).

    Events of unknown place are left out before events are paired.
    """
    df = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    w = Window.partitionBy(key).orderBy(ts, tie)
    out = df.withColumns({f"_n{i}": F.lead(c).over(w) for i, c in enumerate((ts, lat, lon))} | {f"next_{tie}": F.lead(tie).over(w)})
    out = out.withColumn("distance_km", haversine_km(F.col(lat), F.col(lon), F.col("_n1"), F.col("_n2")))
    out = out.withColumn("gap_s", F.timestamp_diff("SECOND", F.col(ts), F.col("_n0")))
    near = F.timestamp_diff("MICROSECOND", F.col(ts), F.col("_n0")) < minutes * 60 * SECOND
    out = out.filter((F.col("distance_km") > km) & near).drop("_n0", "_n1", "_n2")
    speed = F.when(F.col("gap_s") == 0, F.lit(float("inf"))).otherwise(F.col("distance_km") / (F.col("gap_s") / 3600))
    return out.withColumn("speed_kmh", speed)


def progression(df: DataFrame, key: str, ts: str, tie: str, amount: str, least: int = 3, share: float = 0.7) -> DataFrame:
    """Keys of at least that many events: first amount, mean, and whether the first is below a share of the mean."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.min_by(amount, F.struct(ts, tie)).alias("first_amount"), F.avg(amount).alias("mean_amount"))
    return out.filter(F.col("n") >= least).withColumn("is_progression", F.col("first_amount") < share * F.col("mean_amount"))


def pair_stats(df: DataFrame, key: str, ts: str, tie: str, gap_s: int = 3600) -> DataFrame:
    """One row: keys, keys with exactly two events, their share, keys whose largest gap is within gap_s."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gaps = df.select(key, F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts)).alias("_gap"))
    by_key = gaps.groupBy(key).agg(F.count("*").alias("n"), F.max("_gap").alias("most"))
    pairs = F.count_if(F.col("n") == 2)
    return by_key.agg(F.count("*").alias("n_keys"), pairs.alias("n_pairs"), F.try_divide(pairs, F.count("*")).alias("pair_share"), F.count_if(F.col("most") <= gap_s).alias("n_close"))


def horizon(df: DataFrame, keys: list[str], date: str, name: str = "days_before_forecast_day") -> DataFrame:
    """df with the number of days ahead per key, by order of date."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(date)))


def rolling_rows(df: DataFrame, key: str, order: list[str], value: str, n: int, name: str = "rolling_mean") -> DataFrame:
    """df with the mean of the last n rows per key, null before there are n."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == n, F.avg(value).over(w)))
