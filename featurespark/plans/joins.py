"""O-26 and O-32 to O-57 on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurespark.functions.scalar import haversine_km, seconds_since
from featurespark.operators import joins as J
from featurespark.operators import windows as W

from .base import CARDS, DAILY_SQL, PLACED, PLACES, TX, card_versions, daily_outcome, km_sql, places, query, table, transactions

WINDOWS = {"10_mins": 600, "hour": 3600, "day": 86400, "week": 7 * 86400}


def placed(spark, sf):
    return J.ip_lookup(transactions(spark, sf), "ip", places(spark, sf))


#: Lengths without a common divisor worth the name.
ODD_WINDOWS = {"hour": 3600, "hour_and_7": 3607, "day_and_1": 86401, "fortnight": 14 * 86400 - 59}


def _rolling_sql(cte: str, source: str, key: str, value: str, keep: str, shorter: str = "", windows: dict[str, int] = WINDOWS) -> str:
    out = []
    for name, seconds in windows.items():
        w = f"(partition by {key} order by ts range between interval {seconds} seconds {shorter} preceding and current row)"
        out.append(f"round(sum(coalesce({value}, 0)) over {w}, 6) as sum_{name}, count({value}) over {w} as num_{name}")
    return f"with {cte} select {keep}, {', '.join(out)} from {source}"


@query("o26_haversine", f"with {PLACED} select t_id, round({km_sql('lat', 'lon', '48.0', '11.0')}, 6) as km from placed")
def o26(spark, sf):
    return placed(spark, sf).select("t_id", haversine_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0)).alias("km"))


_ASOF = f"with {TX}, {CARDS} select t_id, tx.cc_num, version, last_modified from tx asof left join cards on tx.cc_num = cards.cc_num and tx.ts >= cards.last_modified"


def _asof(strategy):
    def run(spark, sf):
        t = transactions(spark, sf).select("t_id", "cc_num", "ts")
        out = J.asof_join(t, card_versions(spark, sf), ["cc_num"], "ts", "last_modified", seq="version", strategy=strategy)
        return out.select("t_id", "cc_num", "version", "last_modified")

    return run


query("o32_asof_join", _ASOF)(_asof("union"))
query("o32_asof_join_bucketed", _ASOF)(_asof("bucketed"))
query("o32_asof_join_range", _ASOF)(_asof("range"))


@query(
    "o33_point_in_time",
    f"""with {TX}, {CARDS}, agg as (select cc_num, ts, t_id, sum(amount) over (partition by cc_num order by ts, t_id) as spent from tx where card_present),
    l as (select t_id, cc_num, ts from tx where not card_present)
    select l.t_id, a.spent as aggs_spent, c.version as card_version, c_mktsegment as account_c_mktsegment
    from l asof left join agg a on l.cc_num = a.cc_num and l.ts >= a.ts asof left join cards c on l.cc_num = c.cc_num and l.ts >= c.last_modified
    left join customer on c_custkey = l.cc_num""".replace("a.spent as", "round(a.spent, 6) as"),
)
def o33(spark, sf):
    from pyspark.sql import Window

    t = transactions(spark, sf)
    spent = F.sum("amount").over(Window.partitionBy("cc_num").orderBy("ts", "t_id").rowsBetween(Window.unboundedPreceding, 0))
    aggs = t.filter("card_present").select("cc_num", F.col("ts").alias("at"), F.col("t_id").alias("seq"), spent.alias("spent"))
    labels = t.filter(~F.col("card_present")).select("t_id", "cc_num", "ts")
    account = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    q = J.PITQuery(labels, "ts").join(aggs, {"cc_num": "cc_num"}, prefix="aggs_", event_time="at", seq="seq")
    q = q.join(card_versions(spark, sf), {"cc_num": "cc_num"}, prefix="card_", event_time="last_modified", seq="version")
    q = q.join(account, {"cc_num": "c_custkey"}, prefix="account_")
    return q.build().select("t_id", "aggs_spent", "card_version", "account_c_mktsegment")


@query("o34_equi_join", "select o_orderkey, c_custkey, c_mktsegment, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderpriority = '1-URGENT'")
def o34(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    out = J.equi_join(orders, table(spark, sf, "customer").withColumnRenamed("c_custkey", "k"), {"c_custkey": "k"})
    out = J.equi_join(out, table(spark, sf, "nation"), {"c_nationkey": "n_nationkey"})
    return out.select("o_orderkey", "c_custkey", "c_mktsegment", "n_name")


@query("o35_left_join_default", "select c_custkey, coalesce(n, 0) as n_orders, coalesce(top, 'none') as top from customer left join (select o_custkey, count(*) as n, max(o_orderpriority) as top from orders group by 1) on o_custkey = c_custkey")
def o35(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_orderpriority").alias("top"))
    return J.left_join_default(table(spark, sf, "customer").select("c_custkey"), n, ["c_custkey"], {"n_orders": 0, "top": "none"})


@query("o36_enforce_fk", "select event_id, user_id, user_id in (select c_custkey from customer where c_custkey % 2 = 0) as valid from events")
def o36(spark, sf):
    ref = table(spark, sf, "customer").filter("c_custkey % 2 = 0")
    good, bad = J.enforce_fk(table(spark, sf, "events").select("event_id", "user_id"), ref, "user_id", "c_custkey")
    out = good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))
    return out.select("event_id", "user_id", "valid")


@query("o37_label_by_membership", "select event_id as t_id, event_type = 'error' as is_fraud from events")
def o37(spark, sf):
    bad = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("t_id"))
    return J.label_by_membership(transactions(spark, sf).select("t_id"), bad, ["t_id"])


@query("o38_ip_lookup", f"with {PLACED} select t_id, ip, place, lat, lon from placed")
def o38(spark, sf):
    return placed(spark, sf).select("t_id", "ip", "place", "lat", "lon")


@query(
    "o39_home_relation",
    """select l_orderkey, l_linenumber, case when a = b then 'home' when b = (a + 1) % 25 or a = (b + 1) % 25 then 'neighbour' else 'far' end as relation
    from (select l_orderkey, l_linenumber, s_nationkey as a, c_nationkey as b from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)""",
)
def o39(spark, sf):
    """Whether each line is supplied from the customer's nation, a neighbouring or a far one."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), ((F.col("n_nationkey") + 1) % 25).alias("neighbour"))
    edges = n.unionByName(n.select(F.col("neighbour").alias("place"), F.col("place").alias("neighbour")))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    pairs = lines.join(orders, "l_orderkey").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    pairs = pairs.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    return J.home_relation(pairs, "s_nationkey", "c_nationkey", edges).select("l_orderkey", "l_linenumber", "relation")


@query(
    "o40_feature_vectors",
    f"""with {TX}, {CARDS}, c as (select *, row_number() over (partition by cc_num order by last_modified desc, version desc) as rn from cards),
    f as (select *, row_number() over (partition by cc_num order by ts desc, t_id desc) as rn from tx)
    select o_orderkey, o_custkey as cc_num, case when o_orderkey % 4 = 0 then o_totalprice else f.amount end as amount, c.version
    from orders left join c on c.cc_num = o_custkey and c.rn = 1 left join f on f.cc_num = o_custkey and f.rn = 1""",
)
def o40(spark, sf):
    requests = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cc_num"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).alias("given"))
    cards, t = card_versions(spark, sf), transactions(spark, sf).select("cc_num", "ts", "t_id", "amount")
    views = [(cards, ["cc_num"], ["last_modified", "version"]), (t, ["cc_num"], ["ts", "t_id"])]
    return J.feature_vectors(requests, views, {"given": "amount"}).select("o_orderkey", "cc_num", "amount", "version")


_FORECAST = f"""{DAILY_SQL}, f as (select l_shipdate as date, avg(l_extendedprice) as predicted, (day(l_shipdate) % 3 + 1) as days_before_forecast_day from lineitem group by 1)"""


def forecast(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("predicted"))
    return g.withColumn("days_before_forecast_day", F.day("date") % 3 + 1)


@query("o41_hindcast", f"with {_FORECAST} select date, round(predicted, 6) as predicted, round(pm25, 6) as pm25 from f join aq using (date) where days_before_forecast_day = 1")
def o41(spark, sf):
    return J.hindcast(forecast(spark, sf), daily_outcome(spark, sf), ["date"]).select("date", "predicted", "pm25")


@query("o41_recent_backfill", f"with {_FORECAST} select date, round(predicted, 6) as predicted from f order by date desc limit 10")
def o41b(spark, sf):
    return J.recent_backfill(forecast(spark, sf), "date", 10).select("date", "predicted")


@query("o41_hindcast_fallback", f"with {_FORECAST} select date, round(predicted, 6) as predicted, null::double as pm25 from f order by date desc limit 10")
def o41c(spark, sf):
    """No forecast was made a thousand days ahead, so the last ten predictions stand in, without outcomes."""
    return J.hindcast_or_recent(forecast(spark, sf), daily_outcome(spark, sf), ["date"], "date", horizon=1000).select("date", "predicted", "pm25")


def _rolling(closed="both", strategy="frame", windows=WINDOWS):
    def run(spark, sf):
        t = transactions(spark, sf).drop("card_present", "ip")
        return W.rolling(t, ["cc_num"], "ts", "amount", windows, closed, strategy).drop("ts", "amount")

    return run


query("o42_rolling", _rolling_sql(TX, "tx", "cc_num", "amount", "t_id, cc_num"))(_rolling())
query("o43_rolling_prefix", _rolling_sql(TX, "tx", "cc_num", "amount", "t_id, cc_num"))(_rolling(strategy="bucketed"))
query("o43_rolling_odd", _rolling_sql(TX, "tx", "cc_num", "amount", "t_id, cc_num", windows=ODD_WINDOWS))(_rolling(strategy="bucketed", windows=ODD_WINDOWS))
query("o44_rolling_open", _rolling_sql(TX, "tx", "cc_num", "amount", "t_id, cc_num", "- interval 1 microsecond"))(_rolling("right"))


@query("o45_lag_features", f"with {TX} select t_id, lag(ts) over w as prev_ts, lag(ip) over w as prev_ip, lag(card_present) over w as prev_card_present from tx window w as (partition by cc_num order by ts, t_id)")
def o45(spark, sf):
    out = W.lag_features(transactions(spark, sf), "cc_num", "ts", ["ts", "ip", "card_present"], "t_id")
    return out.select("t_id", "prev_ts", "prev_ip", "prev_card_present")


@query("o46_seq_in_group", "select event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def o46(spark, sf):
    return W.seq_in_group(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("event_id", "seq")


@query("o47_group_count", "select event_id, count(*) over (partition by event_type) as group_count from events")
def o47(spark, sf):
    return W.group_count(table(spark, sf, "events"), "event_type").select("event_id", "group_count")


@query("o47_group_count_nulls", "select event_id, count(*) over (partition by nullif(event_type, 'signup')) as group_count from events")
def o47_nulls(spark, sf):
    t = table(spark, sf, "events").withColumn("kind", F.nullif(F.col("event_type"), F.lit("signup")))
    return W.group_count(t, "kind").select("event_id", "group_count")


@query("o48_dedup_last", "select user_id, day, event_id from (select user_id, ts::date as day, event_id, row_number() over (partition by user_id, ts::date order by ts desc, event_id desc) as rn from events) where rn = 1")
def o48(spark, sf):
    t = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return W.dedup_last(t, ["user_id", "day"], ["ts", "event_id"]).select("user_id", "day", "event_id")


DAYS = {"month": 30, "week": 7, "day": 1}


def _rate_sql() -> str:
    out = []
    for name, n in DAYS.items():
        w = f"(partition by s order by ts range between interval {n} days preceding and current row)"
        out.append(f"count(*) over {w} as count_{name}, sum(f) over {w} / count(*) over {w} as rate_{name}")
    return f"select event_id, event_id % 20 as s, (event_type = 'error')::int as f, ts, {', '.join(out)} from (select *, event_id % 20 as s, (event_type = 'error')::int as f from events)"


def rates(spark, sf, days=DAYS):
    t = table(spark, sf, "events").withColumns({"s": F.col("event_id") % 20, "flag": F.col("event_type") == "error"})
    return W.fraud_rate(t.select("event_id", "s", "ts", "flag"), "s", "ts", "flag", days)


@query("o49_fraud_rate", f"select event_id, {', '.join(f'count_{n}, round(rate_{n}, 6) as rate_{n}' for n in DAYS)} from ({_rate_sql()})")
def o49(spark, sf):
    return rates(spark, sf).select("event_id", *[f"{p}_{n}" for n in DAYS for p in ("count", "rate")])


@query("o50_weighted_rate", f"select ts::date as date, s, sum(count_week)::bigint as count, round(sum(rate_week * count_week) / sum(count_week), 6) as rate from ({_rate_sql()}) group by 1, 2")
def o50(spark, sf):
    return W.weighted_daily_rate(rates(spark, sf, {"week": DAYS["week"]}).withColumn("date", F.to_date("ts")), "date", "s", "rate_week", "count_week")


@query(
    "o51_travel_check",
    f"""with {PLACED}, p as (select *, lag(ts) over w as pt, lag(lat) over w as pla, lag(lon) over w as plo, lag(card_present) over w as pp from placed window w as (partition by cc_num order by ts, t_id)),
    d as (select *, {km_sql('pla', 'plo', 'lat', 'lon')} as km, date_sub('second', pt, ts) as gap from p)
    select t_id, round(km, 6) as distance_km, gap as gap_s, not ((card_present or coalesce(pp, false)) and coalesce(case when gap <= 0 then km > 0 else km / (gap / 3600) > 1100 end, false)) as travel_feasible from d""",
)
def o51(spark, sf):
    out = W.travel_check(placed(spark, sf), "cc_num", "ts", "lat", "lon", "card_present", "t_id")
    return out.select("t_id", "distance_km", "gap_s", "travel_feasible")


@query(
    "o52_bursts",
    f"""with {TX}, c as (select *, count(*) over (partition by cc_num order by ts range between interval 12 hours preceding and current row) as n from tx),
    g as (select cc_num, count(*) as n_events, max(n) as max_in_window, avg(amount) as mean_amount, max(amount) as max_amount, max(amount) / avg(amount) as amount_ratio,
      min(ts) as first_ts, max(ts) as last_ts, sum(amount) as total_amount from c group by 1)
    select cc_num, n_events, max_in_window, round(mean_amount, 6) as mean_amount, max_amount, round(amount_ratio, 6) as amount_ratio, first_ts, last_ts, round(total_amount, 6) as total_amount
    from g where max_in_window >= 5 or max_amount > 3 * mean_amount""",
)
def o52(spark, sf):
    return W.detect_bursts(transactions(spark, sf), "cc_num", "ts", "amount", minutes=720)


@query(
    "o53_far_pairs",
    f"""with {PLACED}, p as (select *, lead(ts) over w as nt, lead(lat) over w as nla, lead(lon) over w as nlo, lead(t_id) over w as next_t_id from placed where lat is not null and lon is not null window w as (partition by cc_num order by ts, t_id)),
    d as (select t_id, next_t_id, {km_sql('lat', 'lon', 'nla', 'nlo')} as km, nt - ts < interval 60 minutes as near, date_sub('second', ts, nt) as gap from p)
    select t_id, next_t_id, round(km, 6) as distance_km, gap as gap_s, round(case when gap = 0 then 'inf'::double else km / (gap / 3600) end, 6) as speed_kmh from d where km > 100 and near""",
)
def o53(spark, sf):
    out = W.detect_far_pairs(placed(spark, sf), "cc_num", "ts", "t_id", "lat", "lon")
    return out.select("t_id", "next_t_id", "distance_km", "gap_s", "speed_kmh")


@query(
    "o54_progression",
    f"""with {TX}, g as (select cc_num, count(*) as n, arg_min(amount, (ts, t_id)) as first_amount, avg(amount) as mean_amount from tx group by 1)
    select cc_num, n, first_amount, round(mean_amount, 6) as mean_amount, first_amount < 0.7 * mean_amount as is_progression from g where n >= 3""",
)
def o54(spark, sf):
    return W.progression(transactions(spark, sf), "cc_num", "ts", "t_id", "amount")


@query(
    "o55_pair_stats",
    f"""with {TX}, g as (select cc_num, date_sub('second', lag(ts) over (partition by cc_num order by ts, t_id), ts) as gap from tx), k as (select cc_num, count(*) as n, max(gap) as most from g group by 1)
    select count(*) as n_keys, count(*) filter (n = 2) as n_pairs, round(count(*) filter (n = 2) / count(*), 6) as pair_share, count(*) filter (most <= 86400) as n_close from k""",
)
def o55(spark, sf):
    return W.pair_stats(transactions(spark, sf), "cc_num", "ts", "t_id", 86400)


@query(
    "o55_pair_stats_by_day",
    f"""with {TX}, g as (select cc_num, ts::date as d, date_sub('second', lag(ts) over (partition by cc_num, ts::date order by ts, t_id), ts) as gap from tx), k as (select cc_num, d, count(*) as n, max(gap) as most from g group by 1, 2)
    select count(*) as n_keys, count(*) filter (n = 2) as n_pairs, round(count(*) filter (n = 2) / count(*), 6) as pair_share, count(*) filter (most <= 3600) as n_close from k""",
)
def o55_by_day(spark, sf):
    """Pairs among all rows: the events of a card on a day are a group."""
    t = transactions(spark, sf)
    t = t.withColumn("card_day", F.struct("cc_num", F.to_date("ts")))
    return W.pair_stats(t, "card_day", "ts", "t_id", 3600)


@query("o56_horizon", f"with {DAILY_SQL} select date, row_number() over (partition by month(date) order by date) as days_before_forecast_day from aq")
def o56(spark, sf):
    t = daily_outcome(spark, sf).withColumn("m", F.month("date"))
    return W.horizon(t, ["m"], "date").select("date", "days_before_forecast_day")


@query("o57_rolling_rows", "select event_id, round(case when count(*) over w = 3 then avg(value) over w end, 6) as rolling_mean from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and current row)")
def o57(spark, sf):
    return W.rolling_rows(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 3).select("event_id", "rolling_mean")


FEATURES_SQL = (
    f"with {TX}, {CARDS}, r as ({_rolling_sql(TX, 'tx', 'cc_num', 'amount', 't_id, cc_num, ts, ip, card_present')}), "
    "l as (select *, lag(ts) over w as prev_ts, lag(ip) over w as prev_ip, lag(card_present) over w as prev_card_present from r window w as (partition by cc_num order by ts, t_id)) "
    f"select t_id, l.cc_num, version, prev_ts, prev_ip, prev_card_present, coalesce(date_sub('second', prev_ts, ts), 0) as time_since_last, {', '.join(f'sum_{n}, num_{n}' for n in WINDOWS)} "
    "from l asof left join cards on l.cc_num = cards.cc_num and l.ts >= cards.last_modified"
)


@query("o96_fraud_features", FEATURES_SQL)
def fraud_features(spark, sf):
    """The batch form of the whole feature chain: rolling sums, card version as of the time, lags. One row per event."""
    out = W.rolling(transactions(spark, sf), ["cc_num"], "ts", "amount", WINDOWS)
    out = W.lag_features(out, "cc_num", "ts", ["ts", "ip", "card_present"], "t_id")
    out = J.asof_join(out, card_versions(spark, sf), ["cc_num"], "ts", "last_modified", seq="version")
    out = out.withColumn("time_since_last", seconds_since(F.col("ts"), F.col("prev_ts")))
    return out.select("t_id", "cc_num", "version", "prev_ts", "prev_ip", "prev_card_present", "time_since_last", *[f"{p}_{n}" for n in WINDOWS for p in ("sum", "num")])
