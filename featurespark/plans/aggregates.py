"""O-58 to O-92 on the driver's tables."""

from __future__ import annotations

import datetime

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from featurespark.operators import aggregates as A
from featurespark.operators import models as M
from featurespark.operators import quality as Q
from featurespark.operators import training as L
from featurespark.sources.tables import read_table

from .base import DAILY_SQL, SCORED_SQL, daily_outcome, query, scored, table
from .tables import _NULLED, nulled


@query("o58_group_stats", "select l_returnflag, l_linestatus, round(sum(l_extendedprice), 4) as sum, count(l_extendedprice) as count, min(l_extendedprice) as min, max(l_extendedprice) as max, round(avg(l_extendedprice), 6) as mean from lineitem group by 1, 2")
def o58(spark, sf):
    return A.group_stats(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice").withColumn("sum", F.round("sum", 4))


@query("o59_agg_if", "select l_orderkey, case when count(distinct l_returnflag) > 1 then max(l_extendedprice) end as value from lineitem group by 1")
def o59(spark, sf):
    return A.agg_if(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", "l_returnflag")


@query("o60_distinct", "select count(distinct user_id) as n_user_id, count(distinct event_type) as n_event_type, count(distinct props) as n_props from events")
def o60(spark, sf):
    return A.distinct_profile(table(spark, sf, "events"), ["user_id", "event_type", "props"])


@query("o61_top_k", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10")
def o61(spark, sf):
    return A.top_k(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 10)


@query("o62_value_counts", f"with t as ({_NULLED}) select segment, count(*) as count from t group by 1")
def o62(spark, sf):
    return A.value_counts(nulled(spark, sf), "segment")


@query("o62_mode", f"with t as ({_NULLED}) select segment as mode, count(*) as count from t where segment is not null group by 1 order by 2 desc, 1 limit 1")
def o62_mode(spark, sf):
    return A.mode(nulled(spark, sf), "segment")


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("o63_describe", " union all ".join(f"select '{c}' as column_name, count({c}) as count, round(avg({c}), 6) as mean, round(stddev({c}), 6) as std, min({c}) as min, round(quantile_cont({c}, 0.25), 6) as q25, round(quantile_cont({c}, 0.5), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75, max({c}) as max from lineitem" for c in _LINE))
def o63(spark, sf):
    return A.describe(table(spark, sf, "lineitem").select(*_LINE))


@query(
    "o64_daily_counts",
    """with c as (select nullif(o_orderstatus, 'P') as status, o_orderdate::date as day, count(*) as n from orders group by 1, 2),
    d as (select status, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from c group by 1)
    select d.status, d.day, coalesce(n, 0) as count from d left join c on d.status is not distinct from c.status and d.day = c.day""",
)
def o64(spark, sf):
    t = table(spark, sf, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return A.daily_counts(t, "o_orderdate", "status")


@query("o65_daily_mean", "select date_trunc('day', ts)::timestamp as day, round(avg(value), 6) as mean_value from events group by 1 order by 1 limit 14")
def o65(spark, sf):
    return A.daily_mean(table(spark, sf, "events"), "ts", ["value"], 14).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "o66_histogram",
    """with e as (select min(value) as lo, max(value) as hi from events), c as (select least(floor((value - lo) / (hi - lo) * 20)::bigint, 19) as bin, count(*) as n from events, e group by 1)
    select bin, round(lo + bin * (hi - lo) / 20, 6) as low, round(lo + (bin + 1) * (hi - lo) / 20, 6) as high, coalesce(n, 0) as count from (select unnest(generate_series(0, 19)) as bin) cross join e left join c using (bin)""",
)
def o66(spark, sf):
    return A.histogram(table(spark, sf, "events"), "value", 20)


@query("o67_range_summary", f"with {DAILY_SQL}, r as (select * from aq where date between timestamp '1998-01-01' and timestamp '1998-12-31') select round(avg(pm25), 6) as mean, round(min(pm25), 6) as min, arg_min(date, (pm25, date)) as min_date, round(max(pm25), 6) as max, arg_min(date, (-pm25, date)) as max_date from r")
def o67(spark, sf):
    t = daily_outcome(spark, sf).filter(F.col("date").between(datetime.datetime(1998, 1, 1), datetime.datetime(1998, 12, 31)))
    return A.range_summary(t, "date", "pm25")


@query("o68_summary", "select count(*) as n_events, round(avg(value), 6) as mean_amount, round(median(value), 6) as median_amount, count(distinct user_id) as n_keys, (select round(avg(bad), 6) from (select max((event_type = 'error' and value > 100)::int) as bad from events group by user_id)) as bad_share from events")
def o68(spark, sf):
    t = table(spark, sf, "events").withColumn("bad", (F.col("event_type") == "error") & (F.col("value") > 100))
    return A.summary(t, "user_id", "value", "bad")


@query("o69_union", "select 'c' as kind, c_nationkey as nation, c_acctbal as balance from customer union all select 's', s_nationkey, s_acctbal from supplier")
def o69(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"))
    return A.union_all(c, s)


@query(
    "o70_linfit",
    """with p as (select 'all' as rows_of, l_quantity as x, l_extendedprice as y from lineitem union all select 'some', l_quantity, l_extendedprice from lineitem where l_extendedprice <= 60000),
    l as (select rows_of, count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, regr_r2(y, x) as r2 from p group by 1)
    select rows_of, n, round(slope, 4) as slope, round(intercept, 4) as intercept, round(r2, 6) as r2, round(sqrt(avg(pow(y - slope * x - intercept, 2))), 4) as rmse from p join l using (rows_of) group by all""",
)
def o70(spark, sf):
    t = table(spark, sf, "lineitem")
    out = [A.linfit(t, "l_quantity", "l_extendedprice", e).withColumn("rows_of", F.lit(n)) for n, e in (("all", None), ("some", F.col("l_extendedprice") > 60000))]
    return A.union_all(*out).select("rows_of", "n", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "rmse")], "r2")


@query(
    "o71_impute",
    f"with t as ({_NULLED}), s as (select mode(segment order by segment) as m, avg(balance) as b from t) select c_custkey, coalesce(segment, (select segment from t where segment is not null group by 1 order by count(*) desc, segment limit 1)) as segment, round(coalesce(balance, b), 6) as balance from t cross join s",
)
def o71(spark, sf):
    t = nulled(spark, sf)
    return L.fit_imputer(t, {"segment": "mode", "balance": "mean"}).apply(t).select("c_custkey", "segment", "balance")


@query(
    "o72_ordinal",
    f"with t as ({_NULLED}), d as (select segment, row_number() over (order by segment) - 1 as code from (select distinct segment from t where segment < 'M')) select c_custkey, segment, coalesce(code, -1) as segment_code from t left join d using (segment)",
)
def o72(spark, sf):
    t = nulled(spark, sf)
    return L.fit_ordinal(t.filter("segment < 'M'"), ["segment"]).apply(t).select("c_custkey", "segment", "segment_code")


@query("o73_one_hot", "select o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::int as o_orderstatus_{v}" for v in "FOP") + " from orders")
def o73(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return L.one_hot(t, "o_orderstatus", L.fit_one_hot(t, "o_orderstatus")).drop("o_orderstatus")


@query(
    "o73_one_hot_vectors",
    """with c as (select case when o_orderkey % 11 > 0 then o_custkey::varchar end as cust from orders),
    v as (select cust, row_number() over (order by cust) - 1 as place from (select distinct cust from c where cust < '5'))
    select coalesce(place, (select count(*) from v))::bigint as place, count(*)::double as n from c left join v using (cust) group by 1""",
)
def o73_vectors(spark, sf):
    """How many rows have each place of the sparse vectors; values that training did not have, and nulls, have the last one."""
    t = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 11 > 0, F.col("o_custkey").cast("string")).alias("cust"))
    out = L.fit_one_hot_vectors(t.filter("cust < '5'"), ["cust"]).transform(t)
    total = out.agg(Summarizer.sum(F.col("cust_vector")).alias("n"))
    return total.select(F.posexplode(vector_to_array("n")).alias("place", "n")).filter("n > 0").select(F.col("place").cast("long"), "n")


@query("o74_min_max", "with e as (select min(value) as lo, max(value) as hi from events where ts < timestamp '2024-01-15') select event_id, round((value - lo) / (hi - lo), 6) as value_scaled from events cross join e")
def o74(spark, sf):
    t = table(spark, sf, "events").select("event_id", "ts", "value")
    return L.fit_min_max(t.filter(F.col("ts") < datetime.datetime(2024, 1, 15)), ["value"]).apply(t).select("event_id", "value_scaled")


@query("o75_split_windows", "select event_id, case when ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-20' then 'train' when ts >= timestamp '2024-01-20' and ts < timestamp '2024-01-25' then 'validation' when ts >= timestamp '2024-01-25' and ts < timestamp '2024-01-29' then 'test' end as split from events")
def o75(spark, sf):
    d = lambda n: datetime.datetime(2024, 1, n)
    windows = {"train": (d(1), d(20)), "validation": (d(20), d(25)), "test": (d(25), d(29))}
    return L.split_windows(table(spark, sf, "events"), "ts", windows).select("event_id", "split")


@query("o75_split_last_dates", "select o_orderkey, case when o_orderdate >= (select min(o_orderdate) from (select distinct o_orderdate from orders order by 1 desc limit 30)) then 'test' else 'train' end as split from orders")
def o75_last(spark, sf):
    return L.split_last_dates(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 30, 100).select("o_orderkey", "split")


@query("o76_split_hash", "select o_orderkey, case when u < 3435973836 then 'train' when u < 3865470566 then 'validation' else 'test' end as split from (select o_orderkey, ('0x' || substr(md5(o_orderkey::varchar || '|42'), 1, 8))::bigint as u from orders)")
def o76(spark, sf):
    return L.split_hash(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.8, "validation": 0.1, "test": 0.1}, 42)


@query("o77_kfold", "select c_custkey, case when i < m * (s + 1) then i // (s + 1) else m + (i - m * (s + 1)) // s end as fold from (select c_custkey, row_number() over (order by c_acctbal, c_custkey) - 1 as i, count(*) over () // 7 as s, count(*) over () % 7 as m from customer)")
def o77(spark, sf):
    return L.kfold(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 7).select("c_custkey", "fold")


@query("o77_stratified", "select doc_id, (row_number() over (partition by toxic order by u, doc_id) - 1) % 5 as fold from (select doc_id, toxic, ('0x' || substr(md5(doc_id::varchar || '|1'), 1, 8))::bigint as u from labels)")
def o77_strat(spark, sf):
    return L.stratified_kfold(table(spark, sf, "labels"), "toxic", "doc_id", 5, 1).select("doc_id", "fold")


@query("o77_stratified_nulls", "select doc_id, (row_number() over (partition by y order by u, doc_id) - 1) % 5 as fold from (select doc_id, nullif(toxic, 1) as y, ('0x' || substr(md5(doc_id::varchar || '|1'), 1, 8))::bigint as u from labels)")
def o77_strat_nulls(spark, sf):
    t = table(spark, sf, "labels").withColumn("y", F.nullif(F.col("toxic"), F.lit(1)))
    return L.stratified_kfold(t, "y", "doc_id", 5, 1).select("doc_id", "fold")


_FORMS = "select l_orderkey, l_linenumber, round(l_quantity * 1.1::double + sin(l_quantity), 6) as f, round(exp(-pow(l_quantity - l_linenumber, 2) / 100) * sin(l_quantity / 10) * cos(l_linenumber / 5), 6) + 0.0 as g from lineitem"


@query("o78_pandas_form", _FORMS)
def o78(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return M.udf_forms(t, "l_quantity", "l_linenumber", "pandas").drop("l_quantity")


@query("o78_python_form", _FORMS)
def o78_python(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return M.udf_forms(t, "l_quantity", "l_linenumber", "python").drop("l_quantity")


@query("o79_score", "with l as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem) select l_orderkey, l_linenumber, round(a * l_quantity + b, 4) as prediction from lineitem cross join l")
def o79(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    line = A.linfit(t, "l_quantity", "l_extendedprice").first()
    out = M.score(t, M.Line(line.slope, line.intercept), ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))


def _priced(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate", "l_extendedprice", "l_returnflag")
    return t.withColumn("big", (F.col("l_extendedprice") > 40000).cast("int"))


@query("o81_train_score")
def o81(spark, sf):
    """Trains a classifier on half the lines and scores all of them (O-79, O-81)."""
    t = _priced(spark, sf)
    half = L.split_hash(t.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), "id", {"train": 0.5, "test": 0.5}, 3)
    model = M.train(half.filter("split = 'train'"), ["l_quantity", "l_discount", "l_returnflag"], "big", ["l_returnflag"], maxIter=3)
    return M.score(half, model, []).select("l_orderkey", "l_linenumber", "big", F.col("prediction").cast("int").alias("prediction"))


@query("o82_class_weights", "select count(*) filter (toxic = 0) as negatives, count(*) filter (toxic = 1) as positives, round(count(*) filter (toxic = 0) / count(*) filter (toxic = 1), 6) as scale_pos_weight from labels")
def o82(spark, sf):
    return M.class_weights(table(spark, sf, "labels"), "toxic")


@query(
    "o83_classification_report",
    f"""with {SCORED_SQL}, t as (select y, (u % 3 = 0)::int as p from scored), c as (
      select k::varchar as class, count(*) filter (y = k and p = k) as hit, count(*) filter (y = k) as support, count(*) filter (p = k) as said from t, (select unnest([0, 1]) as k) group by k),
    m as (select class, hit, support, hit / said as precision, hit / support as recall from c), f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from m)
    select class, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, null::double as accuracy from f union all
    select 'weighted', sum(support)::bigint, round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), round(sum(hit) / sum(support), 6) from f""",
)
def o83(spark, sf):
    t = scored(spark, sf).withColumn("p", (F.col("u") % 3 == 0).cast("int"))
    return M.classification_report(t, "y", "p")


_CURVE = f"""{SCORED_SQL}, g as (select s, count(*) filter (y = 1) as p, count(*) filter (y = 0) as n from (select y, (u % 101) / 101 as s from scored) group by 1),
    r as (select s, p, n, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as pos, sum(n) over () as neg from g window w as (order by s desc)),
    q as (select *, tp / (tp + fp) as prec, coalesce(lag(tp / (tp + fp)) over (order by s desc), 1) as last from r)"""


def _curved(spark, sf):
    return scored(spark, sf).withColumn("s", (F.col("u") % 101) / 101)


@query("o84_pr_curve", f"with {_CURVE} select round(s, 6) as score, round(prec, 6) as precision, round(tp / pos, 6) as recall from q")
def o84(spark, sf):
    return M.pr_curve(_curved(spark, sf), "y", "s")


@query("o84_auc", f"with {_CURVE} select round(sum(n * (tp - p + tp) / 2) / max(pos * neg), 6) as roc_auc, round(sum(p * (prec + last) / 2) / max(pos), 6) as pr_auc, round(sum(p * prec) / max(pos), 6) as average_precision from q")
def o84_auc(spark, sf):
    return M.auc(_curved(spark, sf), "y", "s")


@query("o85_regression_report", "with t as (select l_extendedprice as y, l_quantity * 1500 as p from lineitem) select round(avg(pow(y - p, 2)), 2) as mse, round(sqrt(avg(pow(y - p, 2))), 4) as rmse, round(avg(abs(y - p)), 4) as mae, round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) as r2 from t")
def o85(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return M.regression_report(t, "l_extendedprice", "p").select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), "r2")


@query("o86_log_predictions", "select o_orderkey, o_totalprice, o_totalprice > 150000 as prediction, o_orderdate from orders")
def o86(spark, sf):
    from featurespark.sources.shared import shared_path

    t = table(spark, sf, "orders").withColumn("prediction", F.col("o_totalprice") > 150000)
    path = shared_path(spark)
    for i in (0, 1, 1):  # the second batch is repeated
        M.log_predictions(t.filter(F.col("o_orderkey") % 2 == i), path, ["o_orderkey"], ["o_totalprice"], "prediction", "o_orderdate", batch_id=i)
    return read_table(spark, path).drop("batch_id")


@query("o87_best_run", "select n_name as model, s_suppkey as run, s_acctbal as f1 from (select *, row_number() over (partition by n_name order by s_acctbal desc, s_suppkey) as rn from supplier join nation on s_nationkey = n_nationkey) where rn = 1")
def o87(spark, sf):
    m = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return M.best_run(m.select(F.col("n_name").alias("model"), F.col("s_suppkey").alias("run"), F.col("s_acctbal").alias("f1")), "model", "f1")


@query(
    "o88_validate",
    """select 'l_quantity' as column_name, 'min' as statistic, min(l_quantity) as observed, min(l_quantity) > 0 and min(l_quantity) < 500 as success from lineitem union all
    select 'l_discount', 'max', max(l_discount), max(l_discount) <= 0.05 from lineitem union all select 'l_tax', 'mean', round(avg(l_tax), 6), avg(l_tax) >= 0 from lineitem""",
)
def o88(spark, sf):
    rules = [("l_quantity", "min", 0, 500, True), ("l_discount", "max", None, 0.05, False), ("l_tax", "mean", 0, None, False)]
    return Q.validate(table(spark, sf, "lineitem"), rules)


@query("o89_row_rules", "select 'price' as rule, count(*) filter (not l_extendedprice >= 2000) as n_failed, count(*) as n_rows, count(*) filter (not l_extendedprice >= 2000) = 0 as passed from lineitem union all select 'discount', count(*) filter (not l_discount between 0 and 0.09), count(*), count(*) filter (not l_discount between 0 and 0.09) = 0 from lineitem")
def o89(spark, sf):
    rules = {"price": F.col("l_extendedprice") >= 2000, "discount": F.col("l_discount").between(0, 0.09)}
    return Q.row_rules(table(spark, sf, "lineitem"), rules)[0].select("rule", "n_failed", "n_rows", "passed")


def _stats_sql(low: str, high: str, extra: str = "") -> str:
    return " union all ".join(
        f"select '{f}' as feature, count({c}) as count, round(avg({c}), 6) as mean, round(stddev({c}), 6) as std, round(sum({c}), 6) as sum, min({c})::double as min, max({c})::double as max from events where ts >= timestamp '2024-01-28' - interval {low} and ts < timestamp '2024-01-28' - interval {high} {extra}"
        for f, c in (("value", "value"), ("user_id", "user_id"))
    )


@query("o90_feature_stats", _stats_sql("7 days", "3 days", "and ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint < 2147483648"))
def o90(spark, sf):
    return Q.feature_stats(table(spark, sf, "events"), "ts", "2024-01-28 00:00:00", "7 DAYS", "4 DAYS", ["value", "user_id"], 0.5, "event_id")


@query("o90_feature_stats_short", _stats_sql("30 hours", "0 days"))
def o90_short(spark, sf):
    """Offset in the short form of intervals; without a length the window ends at now."""
    return Q.feature_stats(table(spark, sf, "events"), "ts", "2024-01-28 00:00:00", "1d6h", None, ["value", "user_id"])


_RULES = [("value", "mean", 0.5, False, True), ("value", "max", 0.01, True, False), ("user_id", "count", 0.2, True, True), ("user_id", "std", 1.0, False, True)]


@query(
    "o91_compare_stats",
    f"with d as ({_stats_sql('3 days', '0 days')}), r as ({_stats_sql('21 days', '3 days')}), w as (select * from (values "
    + ", ".join(f"('{f}', '{m}', {t}::double, {str(rel).lower()}, {str(s).lower()})" for f, m, t, rel, s in _RULES)
    + """) v(feature, metric, threshold, relative, strict)),
    dl as (unpivot (select feature, count::double as count, mean, std, sum, min, max from d) on count, mean, std, sum, min, max into name metric value detected),
    rl as (unpivot (select feature, count::double as count, mean, std, sum, min, max from r) on count, mean, std, sum, min, max into name metric value reference)
    select feature, metric, threshold, relative, strict, round(detected, 4) as detected, round(reference, 4) as reference, round(case when relative then abs(detected - reference) / abs(reference) else abs(detected - reference) end, 4) as difference, false as empty_detection, false as empty_reference,
      case when strict then case when relative then abs(detected - reference) / abs(reference) else abs(detected - reference) end > threshold else case when relative then abs(detected - reference) / abs(reference) else abs(detected - reference) end >= threshold end as shifted
    from w join dl using (feature, metric) join rl using (feature, metric)""",
)
def o91(spark, sf):
    t, now = table(spark, sf, "events"), "2024-01-28 00:00:00"
    d = Q.feature_stats(t, "ts", now, "3 DAYS", None, ["value", "user_id"])
    r = Q.feature_stats(t, "ts", now, "21 DAYS", "18 DAYS", ["value", "user_id"])
    out = Q.compare_stats(d, r, _RULES)
    return out.withColumns({c: F.round(c, 4) for c in ("detected", "reference", "difference")})


@query("o92_chunk_mae", "select l_shipdate::date as day, count(*) as n, round(avg(abs(l_extendedprice - l_quantity * 1500)), 6) as mae from lineitem group by 1")
def o92(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return Q.chunk_mae(t, "l_shipdate", "l_extendedprice", "p")


@query("o92_estimate_mae")
def o92_estimate(spark, sf):
    t = _priced(spark, sf).withColumn("p", F.col("l_quantity") * 1500)
    old, new = t.filter("l_shipdate < '1998-01-01'"), t.filter("l_shipdate >= '1998-01-01'")
    return Q.estimate_mae(old, new, "l_shipdate", ["l_quantity", "l_discount"], "l_extendedprice", "p")
