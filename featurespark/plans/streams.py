"""O-10, O-11, O-80 and O-93 to O-97: streams over the events table, each run to its end into a table that is returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurespark.sources.avro import encode
from featurespark.sources.shared import shared_path
from featurespark.sources.tables import read_table
from featurespark.streaming import features as S
from featurespark.streaming.expectations import expect, read_expectations
from featurespark.streaming.sinks import KeyedTable, keyed_sink

from .base import CARDS, TX, card_versions, query, table
from .joins import FEATURES_SQL, WINDOWS, _rolling_sql

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, sf, delay=None):
    return S.event_stream(spark, "parquet", EVENTS, f"{sf}/events.parque[t]", "ts", delay)


def _transactions(spark, sf, delay=None):
    ip = F.pmod(F.col("event_id") * F.lit(2654435761) + F.col("user_id") * 40503, F.lit(1 << 32))
    return _events(spark, sf, delay).select(
        F.col("event_id").alias("t_id"), F.col("user_id").alias("cc_num"), F.col("value").alias("amount"),
        (F.col("event_type") == "purchase").alias("card_present"), "ts", ip.alias("ip"),
    )


def _done(spark, df):
    path = shared_path(spark)
    S.write_stream(df, path, shared_path(spark)).awaitTermination()
    return read_table(spark, path, schema=df.schema)


def _ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("o10_event_stream", "select event_id, user_id, ts, (props->>'$.k')::bigint as k from events")
def o10(spark, sf):
    parsed = _events(spark, sf).withColumn("p", F.from_json("props", "k long"))
    return _ntz(_done(spark, parsed.select("event_id", "user_id", "ts", F.col("p.k").alias("k"))), "ts")


AVRO = """{"type": "record", "name": "event", "fields": [{"name": "event_id", "type": "long"}, {"name": "user_id", "type": ["null", "long"]},
  {"name": "ts", "type": {"type": "long", "logicalType": "local-timestamp-micros"}}, {"name": "event_type", "type": ["string", "null"]},
  {"name": "value", "type": ["null", "double"]}]}"""


@query("o10_avro_stream", "select event_id, user_id, ts, event_type, round(value, 6) as value from events")
def o10_avro(spark, sf):
    """The events table as Avro values, five bytes of a registry before each, read back as a stream."""
    path = shared_path(spark)
    names = ["event_id", "user_id", "ts", "event_type", "value"]
    table(spark, sf, "events").select(encode(F.struct(*names), AVRO, b"\x00\x00\x00\x00\x07").alias("value")).write.parquet(path)
    return _done(spark, S.event_stream(spark, "parquet", None, path, avro=AVRO, header=5))


@query("o11_upsert_sink", "select user_id, ts, event_id, value from (select *, row_number() over (partition by user_id, ts order by event_id desc) as rn from events) where rn = 1")
def o11(spark, sf):
    out = KeyedTable(shared_path(spark), ["user_id"], "ts", "event_id", slots=4)
    stream = _events(spark, sf).select("user_id", "ts", "event_id", "value")
    keyed_sink(stream, out, shared_path(spark)).awaitTermination()
    return _ntz(out.read(spark), "ts")


@query("o80_score_stream", "select event_id, round(1 / (1 + exp(-(0.02 * value - 1.0 + case when event_type = 'error' then 0.5 else 0 end))), 6) as prediction from events")
def o80(spark, sf):
    def scorer(df):
        logit = 0.02 * F.col("value") - 1.0 + F.when(F.col("event_type") == "error", 0.5).otherwise(0.0)
        return df.select("event_id", (1 / (1 + F.exp(-logit))).alias("prediction"))

    path = shared_path(spark)
    S.score_stream(_events(spark, sf), scorer, path, shared_path(spark)).awaitTermination()
    return read_table(spark, path, schema="event_id long, prediction double")


@query("o93_rolling_stream", _rolling_sql(TX, "tx", "cc_num", "amount", "t_id, cc_num"))
def o93(spark, sf):
    out = _done(spark, S.rolling_stream(_transactions(spark, sf), "cc_num", "ts", "t_id", "amount", WINDOWS))
    return out.drop("amount", "card_present", "ts", "ip")


@query("o94_lag_stream", f"with {TX} select t_id, lag(ts) over w as prev_ts, lag(ip) over w as prev_ip, lag(card_present) over w as prev_card_present from tx window w as (partition by cc_num order by ts, t_id)")
def o94(spark, sf):
    out = _done(spark, S.lag_stream(_transactions(spark, sf), "cc_num", "ts", "t_id", ["ts", "ip", "card_present"]))
    return _ntz(out.select("t_id", "prev_ts", "prev_ip", "prev_card_present"), "prev_ts")


_ASOF = f"with {TX}, {CARDS} select t_id, tx.cc_num, version, last_modified from tx asof left join cards on tx.cc_num = cards.cc_num and tx.ts >= cards.last_modified"


def _two_streams(spark, sf, delay):
    """Transactions and card versions as streams of their own that end, with watermarks."""
    facts = S.closed(_transactions(spark, sf), "ts", shared_path(spark)).withWatermark("ts", delay)
    cards = _events(spark, sf).filter("event_type = 'signup'").select(F.col("user_id").alias("cc_num"), F.col("ts").alias("last_modified"), F.col("event_id").alias("version"))
    return facts, S.closed(cards, "last_modified", shared_path(spark)).withWatermark("last_modified", delay)


@query("o95_asof_streams", _ASOF)
def o95(spark, sf):
    facts, cards = _two_streams(spark, sf, "1 day")
    out = _done(spark, S.asof_streams(facts, cards, ["cc_num"], "ts", "last_modified", "version"))
    return _ntz(out.select("t_id", "cc_num", "version", "last_modified"), "last_modified")


@query("o95_asof_stream", _ASOF)
def o95_table(spark, sf):
    path = shared_path(spark)
    dim = lambda: card_versions(spark, sf).withColumn("last_modified", F.col("last_modified").cast("timestamp"))
    S.asof_table(_transactions(spark, sf), dim, ["cc_num"], "ts", "last_modified", "version", path, shared_path(spark)).awaitTermination()
    return _ntz(read_table(spark, path).select("t_id", "cc_num", "version", "last_modified"), "last_modified")


@query("o96_fraud_features_stream", FEATURES_SQL)
def o96(spark, sf):
    from featurespark.functions.scalar import seconds_since

    facts, cards = _two_streams(spark, sf, "1 day")
    # no two events of a card have the same id, so the table keeps them all
    out = KeyedTable(shared_path(spark), ["cc_num", "t_id"], "ts", "t_id", slots=4)
    S.fraud_features_stream(facts, cards, WINDOWS, ["ts", "ip", "card_present"], out, shared_path(spark)).awaitTermination()
    rows = out.read(spark).withColumn("time_since_last", seconds_since(F.col("ts"), F.col("prev_ts")))
    names = ["t_id", "cc_num", "version", "prev_ts", "prev_ip", "prev_card_present", "time_since_last"]
    return _ntz(rows.select(*names, *[f"{p}_{n}" for n in WINDOWS for p in ("sum", "num")]), "prev_ts")


@query("o93_rolling_ordered", _rolling_sql(TX, "tx", "cc_num", "amount", "t_id, cc_num"))
def o93_ordered(spark, sf):
    """The same sums given out behind the watermark."""
    facts, _ = _two_streams(spark, sf, "1 day")
    out = _done(spark, S.rolling_stream(facts, "cc_num", "ts", "t_id", "amount", WINDOWS, emit="ordered"))
    return out.drop("amount", "card_present", "ts", "ip")


RULES = [("value", "min", 0.0, None, False), ("value", "max", None, 100.0, True), ("value", "mean", 1.0, 1e6, False), ("event_id", "count", 1.0, None, False), ("user_id", "min", 5.0, None, True)]
_RULES_SQL = " union all ".join(
    f"select '{c}' as column_name, '{s}' as statistic, {dict(min='min', max='max', mean='avg', count='count')[s]}({c})::double as observed, "
    + " and ".join(["true"] + [f"{dict(min='min', max='max', mean='avg', count='count')[s]}({c}) {op}{'' if strict else '='} {v}" for v, op in ((lo, '>'), (hi, '<')) if v is not None])
    + " as success from events"
    for c, s, lo, hi, strict in RULES
)


@query("o88_expect_stream", _RULES_SQL)
def o88(spark, sf):
    """Expectations on a stream: the table is one batch, so its rows are those of the batch form."""
    path = shared_path(spark)
    stream, log = expect(_events(spark, sf), RULES, path)
    _done(spark, stream)
    log.wait()
    spark.streams.removeListener(log)
    return read_expectations(spark, path).drop("batch_id")


@query("o97_dedup_stream", "select event_id, user_id from events")
def o97(spark, sf):
    twice = _events(spark, sf).unionByName(_events(spark, sf))
    return _done(spark, S.dedup_stream(twice, "event_id", "ts", "1 day").select("event_id", "user_id"))


@query("o97_late_split", "select event_id, event_type <> 'purchase' and ts < (select max(ts) from events where event_type = 'purchase') - interval 1 day as late from events")
def o97_late(spark, sf):
    """Purchases come first, all other events in a second run: those over a day older than the newest purchase are late."""
    source, path, checkpoint = (shared_path(spark) for _ in range(3))
    t = table(spark, sf, "events")
    for i, part in enumerate(("event_type = 'purchase'", "event_type <> 'purchase'")):
        t.filter(part).write.parquet(f"{source}/b={i}")
        events = S.event_stream(spark, "parquet", t.schema, f"{source}/b=*", "ts")
        S.late_split(events, "ts", "1 day", path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("event_id", F.col("late").cast("boolean").alias("late"))
