"""O-01 to O-31 on the driver's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from featurespark.functions import scalar as S
from featurespark.sources import tables as T

from .base import CARDS, DAILY_SQL, TX, card_versions, daily_outcome, query, table, transactions


@query("o01_read_table", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F'")
def o01(spark, sf):
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    return T.read_table(spark, f"{sf}/orders.parquet", columns=cols).filter("o_orderstatus = 'F'").drop("o_orderstatus")


@query("o02_read_since", "select event_id, user_id, ts from events where ts > timestamp '2024-01-10' and ts < timestamp '2024-01-12'")
def o02(spark, sf):
    t = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return T.read_since(t, "ts", datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 12))


@query(
    "o03_incremental",
    f"""with {TX} select t_id, round(s, 6) as sum_week, n as num_week from (
    select t_id, ts, sum(amount) over w as s, count(amount) over w as n from tx
    window w as (partition by cc_num order by ts range between interval 7 days preceding and current row))
    where ts > timestamp '2024-01-20'""",
)
def o03(spark, sf):
    from featurespark.operators.windows import rolling

    fn = lambda df: rolling(df, ["cc_num"], "ts", "amount", {"week": 7 * 86400})
    out = T.incremental(transactions(spark, sf), "ts", "2024-01-20 00:00:00", "7 DAYS", fn)
    return out.select("t_id", "sum_week", "num_week")


@query(
    "o04_upsert",
    """with u as (select c_custkey, c_acctbal, 0 as n, c_custkey as seq from customer union all
    select c_custkey, c_acctbal + 100, 1, c_custkey from customer where c_custkey % 3 = 0 union all
    select c_custkey + 1000000, c_acctbal, 1, c_custkey from customer where c_custkey % 50 = 0)
    select c_custkey, round(c_acctbal, 6) as c_acctbal, seq from (
      select *, row_number() over (partition by c_custkey order by n desc, seq desc) as rn from u) where rn = 1""",
)
def o04(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_custkey").alias("seq"), F.lit(0).alias("at"))
    new = base.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100)
    more = base.filter("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    return T.upsert(base, new.unionByName(more), ["c_custkey"], "at", "seq").drop("at")


@query(
    "o05_latest",
    """select user_id, event_id, ts, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn
    from events where ts >= timestamp '2024-01-30' - interval 20 days) where rn = 1""",
)
def o05(spark, sf):
    t = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return T.latest(t, ["user_id"], ["ts", "event_id"], "20 DAYS", "2024-01-30 00:00:00")


@query(
    "o06_snapshot",
    f"""with {CARDS} select cc_num, last_modified, version from (select *, row_number() over (partition by cc_num
    order by last_modified desc, version desc) as rn from cards where last_modified <= timestamp '2024-01-15') where rn = 1""",
)
def o06(spark, sf):
    return T.snapshot_as_of(card_versions(spark, sf), ["cc_num"], ["last_modified", "version"], datetime.datetime(2024, 1, 15))


@query(
    "o07_assign_ids",
    """select c_custkey, (select max(s_suppkey) from supplier) + row_number() over (order by c_acctbal, c_custkey) as new_id from customer""",
)
def o07(spark, sf):
    new = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return T.assign_ids(new, ["c_acctbal", "c_custkey"], table(spark, sf, "supplier"), "s_suppkey").drop("c_acctbal")


@query("o08_row_index", "select event_id, row_number() over (order by ts, event_id) - 1 as row_index from events")
def o08(spark, sf):
    return T.with_row_index(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).drop("ts")


@query(
    "o09_slice_rows",
    """select vec_id as id, round(embedding[1]::double, 6) as first_value from embeddings where vec_id in (
    select vec_id from (select vec_id, row_number() over (order by vec_id) - 1 as i from embeddings) where i >= 100 and i < 300)""",
)
def o09(spark, sf):
    out = T.slice_rows(table(spark, sf, "embeddings"), ["vec_id"], 100, 300, drop=["label"], rename={"vec_id": "id"})
    return out.select("id", F.get("embedding", F.lit(0)).cast("double").alias("first_value"))


@query("o12_parse_json", "select event_id, (props->>'$.k')::bigint as k from events where (props->>'$.k')::bigint >= 0")
def o12(spark, sf):
    good, _ = T.parse_reading(table(spark, sf, "events"), "props", "k long", "reply.k >= 0")
    return good.select("event_id", F.col("reply.k").alias("k"))


_REPLY_SQL = "case when event_type = 'error' then 'error' else 'ok' end"


@query("o12_nested_reply", f"select event_id, case when event_id % 7 > 0 then round(value, 6) end as pm25, true as good from events where {_REPLY_SQL} = 'ok' union all select event_id, null, false from events where {_REPLY_SQL} <> 'ok'")
def o12_nested(spark, sf):
    """Sensor replies made from events: the nested value, null where it is missing; bad ones hold text in place of data."""
    t = table(spark, sf, "events")
    value = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit('{"v":'), F.col("value").cast("string"), F.lit("}"))).otherwise("{}")
    good = F.concat(F.lit('{"status":"ok","data":{"iaqi":{"pm25":'), value, F.lit("}}}"))
    reply = F.when(F.col("event_type") == "error", F.lit('{"status":"error","data":"Unknown station"}')).otherwise(good)
    good, bad = T.parse_reading(t.select("event_id", reply.alias("j")), "j")
    out = good.select("event_id", F.col("reply.data.iaqi.pm25.v").alias("pm25"), F.lit(True).alias("good"))
    return out.unionByName(bad.select("event_id", F.lit(None).cast("double").alias("pm25"), F.lit(False).alias("good")))


@query(
    "o13_first_valid",
    "select event_id, case when event_type = 'view' then user_id when value > 50 then event_id end as usable from events",
)
def o13(spark, sf):
    t = table(spark, sf, "events").withColumns({"a": F.when(F.col("event_type") == "view", F.col("user_id")), "b": F.when(F.col("value") > 50, F.col("event_id"))})
    return t.select("event_id", T.first_valid(["a", "b"], lambda c: c.isNotNull()).alias("usable"))


@query("o14_select_except", "select s_suppkey as sup_s_suppkey, s_name as sup_s_name, s_nationkey from supplier")
def o14(spark, sf):
    return S.prefixed(S.select_except(table(spark, sf, "supplier"), ["s_acctbal"]), "sup_", ["s_nationkey"])


_NULLED = "select case when c_custkey % 7 = 0 then null else c_mktsegment end as segment, case when c_custkey % 5 = 0 then null else c_acctbal end as balance, c_custkey from customer"


def nulled(spark, sf):
    t = table(spark, sf, "customer")
    return t.select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("balance"), "c_custkey")


@query(
    "o15_null_profile",
    f"""with t as ({_NULLED}) select 'segment' as column_name, count(*) filter (segment is null) as n_null from t union all
    select 'balance', count(*) filter (balance is null) from t union all select 'c_custkey', count(*) filter (c_custkey is null) from t""",
)
def o15(spark, sf):
    return S.null_profile(nulled(spark, sf))


@query("o15_drop_nulls", f"with t as ({_NULLED}) select * from t where segment is not null and balance is not null")
def o15_drop(spark, sf):
    return nulled(spark, sf).dropna()


@query("o16_constants", f"with {DAILY_SQL} select date::date as date, round(pm25, 6) as pm25, 'here' as city from aq")
def o16(spark, sf):
    return S.with_constants(daily_outcome(spark, sf), {"date": F.to_date("date"), "city": "here"})


@query("o17_filter", "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_discount >= 0.05 and l_shipdate is not null")
def o17(spark, sf):
    t = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_discount >= 0.05D and l_shipdate is not null")
    return t.select("l_orderkey", "l_linenumber")


@query("o18_between_time", "select event_id, ts from events where strftime(ts, '%H:%M:%S') between '11:30:00' and '12:30:00'")
def o18(spark, sf):
    return S.between_time(table(spark, sf, "events").select("event_id", "ts"), "ts", "11:30:00", "12:30:00")


@query("o19_time_parts", "select event_id, hour(ts) as hour, ts::date as date, date_trunc('day', ts)::timestamp as day from events")
def o19(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in S.time_parts("ts").items()]).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "o20_band",
    "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' when c_acctbal is not null then 'high' end as band from customer",
)
def o20(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.band(F.col("c_acctbal"), [0, 5000], ["debt", "low", "high"]).alias("band"))


@query(
    "o21_aqi_category",
    """select event_id, case when v is null or v < 0 or v > 500 then null when v >= 300 then 'Hazardous' when v >= 200 then 'Very Unhealthy'
    when v >= 150 then 'Unhealthy' when v >= 100 then 'Unhealthy for Some' when v >= 50 then 'Moderate' else 'Good' end as category
    from (select event_id, value * 6 - 20 as v from events)""",
)
def o21(spark, sf):
    return table(spark, sf, "events").select("event_id", S.aqi_category(F.col("value") * 6 - 20).alias("category"))


@query(
    "o22_seconds_since",
    "select event_id, coalesce(date_sub('second', lag(ts) over (partition by user_id order by ts, event_id), ts), 0) as seconds from events",
)
def o22(spark, sf):
    from featurespark.operators.windows import lag_features

    t = lag_features(table(spark, sf, "events"), "user_id", "ts", ["ts"], "event_id")
    return t.select("event_id", S.seconds_since(F.col("ts"), F.col("prev_ts")).alias("seconds"))


@query("o23_days_between", "select o_orderkey, date_diff('day', o_orderdate::date, date '2001-08-01') as days from orders")
def o23(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.days_between(F.col("o_orderdate"), F.lit("2001-08-01").cast("date")).alias("days"))


@query(
    "o24_ip_numbers",
    f"""with {TX} select t_id, ip, (ip >> 24)::varchar || '.' || ((ip >> 16) & 255)::varchar || '.' || ((ip >> 8) & 255)::varchar || '.' || (ip & 255)::varchar as address from tx""",
)
def o24(spark, sf):
    t = transactions(spark, sf).withColumn("address", S.int_to_ip(F.col("ip")))
    return t.select("t_id", S.ip_to_int(F.col("address")).alias("ip"), "address")


@query("o25_same_subnet", f"with {TX} select cc_num, count(*) filter ((ip >> 16) = (prev >> 16)) as same_16, count(*) filter ((ip >> 8) = (prev >> 8)) as same_24 from (select *, lag(ip) over (partition by cc_num order by ts, t_id) as prev from tx) group by 1")
def o25(spark, sf):
    from featurespark.operators.windows import lag_features

    t = lag_features(transactions(spark, sf), "cc_num", "ts", ["ip"], "t_id")
    return t.groupBy("cc_num").agg(*[F.count_if(S.same_subnet(F.col("ip"), F.col("prev_ip"), b)).alias(f"same_{b}") for b in (16, 24)])


@query(
    "o27_email_score",
    r"""with e as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) as email from documents)
    select doc_id, email, greatest(0, least(100, 50 + case when top in ('gov', 'edu') then 30 when top in ('com', 'org') then 20 else 0 end))::bigint as email_score
    from (select *, lower(regexp_extract(email, '\.([^.]*)$', 1)) as top from e)""",
)
def o27(spark, sf):
    return S.score_emails(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("o28_row_max", "select l_orderkey, l_linenumber, greatest(l_quantity, l_discount * 100, l_tax * 500) as row_max from lineitem")
def o28(spark, sf):
    t = table(spark, sf, "lineitem").withColumns({"d": F.col("l_discount") * 100, "t": F.col("l_tax") * 500})
    return t.select("l_orderkey", "l_linenumber", S.row_max(["l_quantity", "d", "t"]).alias("row_max"))


@query(
    "o29_expressions",
    """select l_orderkey, l_linenumber, round(l_quantity * 1.1::double + sin(l_quantity), 6) as f,
    round(exp(-pow(l_quantity - l_linenumber, 2) / 100) * sin(l_quantity / 10) * cos(l_linenumber / 5), 6) + 0.0 as g from lineitem""",
)
def o29(spark, sf):
    from featurespark.operators.models import udf_forms

    return udf_forms(table(spark, sf, "lineitem"), "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "f", "g")


@query("o30_clip_quantile", "select l_orderkey, l_linenumber, round(least(l_extendedprice, (select quantile_cont(l_extendedprice, 0.9) from lineitem)), 6) as l_extendedprice from lineitem")
def o30(spark, sf):
    return S.clip_quantile(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 0.9)


@query(
    "o30_clip_both",
    """with t as (select l_orderkey, l_linenumber, case when l_linenumber < 7 then l_extendedprice::double end as v from lineitem), q as (select quantile_cont(v, 0.9) as top from t)
    select l_orderkey, l_linenumber, round(case when v > top then top when v < 2000 then 2000 else v end, 6) as v from t, q""",
)
def o30_both(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice").cast("double")).alias("v"))
    return S.clip_quantile(t, "v", 0.9, 2000)


@query("o31_date_range", f"with {DAILY_SQL} select date, round(pm25, 6) as pm25 from aq where date >= timestamp '1998-06-08' and date < timestamp '1998-06-15'")
def o31(spark, sf):
    return S.in_date_range(daily_outcome(spark, sf), "date", S.date_range(datetime.date(1998, 6, 18), "last week"))
