"""Streams equal their batch twins when the input comes in several files, with a restart in between."""

import datetime as dt
import decimal
import pickle
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from featurespark.operators.joins import asof_join
from featurespark.operators.quality import validate
from featurespark.operators.windows import lag_features, rolling
from featurespark.streaming import features as S
from featurespark.streaming import keyed
from featurespark.streaming.expectations import expect, read_expectations
from featurespark.streaming.keyed import Keyed
from featurespark.streaming.sinks import KeyedTable

WINDOWS = {"hour": 3600, "day": 86400}
SCHEMA = "t_id long, cc_num long, amount double, ts timestamp_ntz"


def batches(spark, path, rows, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n] if n < 0 else rows[i * len(rows) // n : (i + 1) * len(rows) // n], SCHEMA).coalesce(1).write.parquet(f"{path}/b={i}")
        yield i


def made(n=120):
    t = dt.datetime(2024, 1, 1)
    return [(i, i % 5, None if i % 11 == 0 else float(i % 7), t + dt.timedelta(minutes=37 * i)) for i in range(n)]


def wanted(spark, rows):
    df = rolling(spark.createDataFrame(rows, SCHEMA), ["cc_num"], "ts", "amount", WINDOWS)
    return {r.t_id: r for r in lag_features(df, "cc_num", "ts", ["amount"], "t_id").collect()}


def run(spark, tmp, source, out, emit, delay=None):
    stream = S.event_stream(spark, "parquet", SCHEMA, f"{source}/b=*", "ts", delay)
    df = S.rolling_stream(stream, "cc_num", "ts", "t_id", "amount", WINDOWS, ["amount"], emit)
    S.write_stream(df, out, f"{tmp}/check").awaitTermination()


def same(got, want):
    for r in got:
        w = want[r.t_id]
        assert (r.num_hour, r.num_day, r.prev_amount) == (w.num_hour, w.num_day, w.prev_amount)
        assert abs(r.sum_hour - w.sum_hour) < 1e-9 and abs(r.sum_day - w.sum_day) < 1e-9


def test_immediate_over_restarts(spark, tmp_path):
    rows = made()
    for _ in batches(spark, f"{tmp_path}/in", rows, 3):
        run(spark, tmp_path, f"{tmp_path}/in", f"{tmp_path}/out", "immediate")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(rows)
    same(got, wanted(spark, rows))


def test_ordered_waits_for_the_watermark(spark, tmp_path):
    rows = made()
    shuffled = [*rows[10:40], *rows[:10], *rows[40:]]  # out of order by less than the delay
    last = [(1000 + k, k, 0.0, dt.datetime(2024, 3, 1)) for k in range(5)]
    later = [(2000 + k, k, 0.0, dt.datetime(2024, 4, 1)) for k in range(5)]
    for i, part in enumerate((shuffled[:30], shuffled[30:80], shuffled[80:], last, later)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
        run(spark, tmp_path, f"{tmp_path}/in", f"{tmp_path}/out", "ordered", "2 days")
    got = [r for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.t_id < 1000]
    assert len(got) == len(rows)
    same(got, wanted(spark, rows))


def add(spark, path, i, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b={i}")


def files(path):
    return {p: p.stat().st_size for p in Path(path).rglob("*.parquet")}


def test_late_rows_and_duplicates(spark, tmp_path):
    """The split by the query's own watermark is the same over restarts; the last batch is late against the first two."""
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    parts = [[(1, 1, 1.0, day(0)), (2, 1, 2.0, day(5))], [(3, 1, 3.0, day(1)), (4, 1, 4.0, day(6))], [(5, 1, 5.0, day(4, 23)), (6, 1, 6.0, day(5)), (7, 1, 7.0, None), (8, 1, 8.0, day(9))], [(9, 1, None, day(7))]]
    for i, part in enumerate(parts):
        add(spark, f"{tmp_path}/in", i, part)
        S.late_split(S.event_stream(spark, "parquet", SCHEMA, f"{tmp_path}/in/b=*", "ts"), "ts", "1 day", f"{tmp_path}/split", f"{tmp_path}/c1").awaitTermination()
    split = {r.t_id: (r.late, r.ts) for r in spark.read.parquet(f"{tmp_path}/split").collect()}
    assert {k for k, v in split.items() if str(v[0]).lower() == "true"} == {3, 5, 9} and len(split) == 9
    assert split[5][1] == day(4, 23) and split[7][1] is None
    stream = S.event_stream(spark, "parquet", SCHEMA, f"{tmp_path}/in/b=*", "ts")
    S.write_stream(S.dedup_stream(stream.unionByName(stream), "t_id", "ts", "10 days"), f"{tmp_path}/once", f"{tmp_path}/c3").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/once").filter("ts is not null").count() == 8


def test_sink_writes_what_a_batch_touches(spark, tmp_path):
    table = KeyedTable(f"{tmp_path}/table", ["cc_num"], "ts", "t_id", slots=4, compact=3)
    t = dt.datetime(2024, 1, 1)
    want, sizes = {}, []
    parts = [[(i, i % 50, float(i), t + dt.timedelta(days=i // 50)) for i in range(2000)]]  # forty days
    parts += [[(5000 + b, 7, float(b), t), (6000 + b, 7, -1.0, t), (7000 + b, 100 + b, None, t + dt.timedelta(days=60))] for b in range(8)]
    for b, part in enumerate(parts):
        before = files(f"{tmp_path}/table/data") if b else {}
        df = spark.createDataFrame(part, SCHEMA)
        table.merge(df, b)
        if b in (1, 4):
            table.merge(df, b)  # a repeated batch
        for r in sorted(part):
            want[r[1], r[3]] = r
        got = [tuple(r) for r in table.read(spark).collect()]
        assert sorted(got) == sorted(want.values(), key=lambda r: r[0]) or sorted(got, key=repr) == sorted(want.values(), key=repr)
        sizes.append(sum(v for p, v in files(f"{tmp_path}/table/data").items() if p not in before))
    assert max(sizes[1:]) < sizes[0] / 10
    left = {int(p.name[2:]) for p in Path(f"{tmp_path}/table/manifest").glob("n=*")}
    assert left == {3, 4, 5, 6, 7, 8}  # the whole ones are 0, 3 and 6
    cells = len(list(Path(f"{tmp_path}/table/data").glob("*/*/*/")))
    assert cells <= table.cells(spark).count() + 2 * 6  # replaced ones of the last batches only
    table.merge(df.limit(0), 9)  # a batch without rows
    assert table.read(spark).count() == len(want)


def test_sums_are_exact_after_a_large_value(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, 1e17, t), (2, 1, 0.5, t + dt.timedelta(minutes=10)), (3, 1, 0.25, t + dt.timedelta(minutes=61)), (4, 1, None, t + dt.timedelta(hours=2)), (5, None, 2.0, t), (6, 1, 3.0, None)]
    for i, r in enumerate(rows):
        add(spark, f"{tmp_path}/in", i, [r])
        run(spark, tmp_path, f"{tmp_path}/in", f"{tmp_path}/out", "immediate")
    got = {r.t_id: (r.sum_hour, r.num_hour) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (1e17, 1), 2: (1e17, 2), 3: (0.75, 2), 4: (0.25, 1), 5: (2.0, 1), 6: (None, None)}


class Store:
    """State of one key in memory that counts calls and bytes."""

    def __init__(self):
        self.data, self.calls, self.bytes = {}, 0, 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.data[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls, self.bytes = self.calls + 1, self.bytes + len(value[0])
        self.data[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.data[key]


def test_a_batch_costs_the_same_however_long_the_history():
    rng = random.Random(1)
    k = Keyed(0, 0, [600, 3600, 7 * 86400], [], False, None, [])
    k.rows, buckets, us, cost, seen = Store(), {}, 0, [], []
    for _ in range(300):
        facts = []
        for _ in range(20):
            us += rng.randrange(3600 * 10**6)
            facts.append((us, 0, rng.choice([None, 1.0, 2.5])))
        calls = k.rows.calls
        sums, buckets = k._sums(facts, buckets)
        cost.append(k.rows.calls - calls)
        seen += facts
        for r, s in zip(facts, sums):
            for i, w in enumerate(k.windows):
                inside = [x[2] for x in seen if r[0] - w <= x[0] <= r[0] and x[2] is not None]
                assert s[2 * i : 2 * i + 2] == [sum(inside), len(inside)]
        seen = [x for x in seen if x[0] >= us - k.longest]
    assert max(cost[250:]) < 1.5 * max(cost[30:80]) and len(buckets) <= 520 and len(k.rows.data) < 700
    for _ in range(50):  # one bucket again and again: parts are put together
        us += 10**6
        sums, buckets = k._sums([(us, 0, 1.0)], buckets)
    assert max(p for _, p in k.rows.data) <= 16


class Value:
    """A value of one key's state in memory."""

    def __init__(self):
        self.data = None

    def get(self):
        return self.data

    def update(self, value):
        self.data = value


def test_a_key_of_few_rows_has_one_value_of_state():
    """Sums equal brute force before and after a key has more than FEW rows; only then buckets are used."""
    rng, us, seen = random.Random(2), 0, []
    k = Keyed(0, 0, [600, 3600, 7 * 86400], [], False, None, [])
    k.rows, k.index = Store(), Value()
    for i in range(60):
        facts = []
        for _ in range(20):
            us += rng.randrange(900 * 10**6) if i % 20 else rng.choice([0, 600 * 10**6])
            facts.append((us, len(seen) + len(facts), rng.choice([None, 1.0, 2.5, 1e17 if i == 3 else 0.5])))
        seen += facts
        got = list(k._emit(facts))
        for r, s in zip(facts, got, strict=True):
            for w, window in enumerate(k.windows):
                inside = [x[2] for x in seen if r[0] - window <= x[0] <= r[0] and x[2] is not None]
                assert s[2 * w : 2 * w + 2] == [pytest.approx(sum(inside)), len(inside)]
        assert (k.rows.calls == 0) == (len(seen) <= 512)


def test_rows_pass_python_packed():
    """A row comes in as one value and rows of a key leave in arrays, whole and in order; versions as of their time."""
    k = Keyed(1, 1, [], [], False, 1, ["a", "b"])
    k.versions, k.index = Value(), Value()
    rows = [("k", pickle.dumps((i, i, None, 1, i * 10))) for i in range(600)] + [("k", pickle.dumps((None, 700, None, 1, -1)))]
    rows += [("k", pickle.dumps((v, v, None, 0, f"v{v}"))) for v in (300, 100)]
    got = list(k.handleInputRows(("k",), iter(rows), None))
    assert [len(r.a) for r in got] == [256, 256, 89]
    flat = [x for r in got for x in zip(r.a, r.b, strict=True)]
    assert flat == [(-1, None)] + [(i * 10, None if i < 100 else "v100" if i < 300 else "v300") for i in range(600)]


class Cell:
    """State and timers of a cell in memory, as map, list, value and handle."""

    def __init__(self):
        self.data, self.calls, self.timers = {}, 0, []

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.data.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.data[key] = value

    def appendValue(self, value):  # noqa: N802
        self.calls += 1
        self.data[len(self.data)] = value

    def get(self):
        self.calls += 1
        return iter(list(self.data.values()))

    def clear(self):
        self.calls += 1
        self.data = {}

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def test_state_is_called_once_a_cell_and_once_a_key():
    """Rows of many keys wait together; a row far ahead holds no other back, and what comes after later rows is dropped."""
    k = Keyed(0, 1, [3600], [0], True, 1, ["a", "sum", "num", "prev", "version"])
    k.handle, k.entries, k.keys, k.held = Cell(), Cell(), Cell(), Cell()
    k.until = Value()
    pairs = [(f"k{i % 50}", (i * 10**6, i, 1.0, 1, i)) for i in range(500)] + [(f"k{i}", (i * 10**6 + 1, i, None, 0, f"v{i}")) for i in range(50)]
    ahead = ("k7", (10**15, 999, 1.0, 1, 999))
    assert list(k.handleInputRows((1,), iter([(pickle.dumps(pairs[:300]),), (pickle.dumps([*pairs[300:], ahead]),)]), None)) == []
    assert (k.held.calls, len(k.handle.timers), k.keys.calls) == (1, 1, 0)
    got = [x for r in k.handleExpiredTimer((1,), Clock(10**6), Clock(1)) for x in zip(r.a, r.sum, r.num, r.prev, r.version, strict=True)]
    assert sorted(got) == [(i, i // 50 + 1.0, i // 50 + 1, i - 50 if i >= 50 else None, f"v{i % 50}" if i >= 50 else None) for i in range(500)]
    assert (k.held.calls, k.keys.calls, k.entries.calls) == (4, 100, 0)
    assert k.handle.timers == [1, 10**12 + 1]  # the row ahead waits for its own time
    late, next_ = ("k1", (5, 1000, 1.0, 1, 1000)), ("k1", (10**9 + 1, 1001, 1.0, 1, 1001))
    assert list(k.handleInputRows((1,), iter([(pickle.dumps([late, next_]),)]), None)) == []
    got = [x for r in k.handleExpiredTimer((1,), Clock(2 * 10**6), Clock(1)) for x in zip(r.a, r.sum, r.num, r.prev, r.version, strict=True)]
    assert got == [(1001, 11.0, 11, 451, "v1")]


def test_keys_and_values_of_odd_kinds(spark, tmp_path):
    """Keys are those of Spark: null, NaN, and one zero; NaN stays NaN."""
    t, nan = dt.datetime(2024, 1, 1), float("nan")
    keys = [0.0, -0.0, nan, None, 1.5, nan, None, -0.0]
    rows = [(i, k, nan if i == 4 else float(i), t + dt.timedelta(minutes=i, microseconds=i)) for i, k in enumerate(keys)]
    add(spark, f"{tmp_path}/in", 0, rows, "t_id long, cc_num double, amount double, ts timestamp_ntz")
    stream = S.event_stream(spark, "parquet", "t_id long, cc_num double, amount double, ts timestamp_ntz", f"{tmp_path}/in/b=*", "ts")
    S.write_stream(S.rolling_stream(stream, "cc_num", "ts", "t_id", "amount", WINDOWS, ["ts"]), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {r.t_id: (str(r.sum_hour), r.num_day, r.prev_ts and r.prev_ts.minute) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: ("0.0", 1, None), 1: ("1.0", 2, 0), 2: ("2.0", 1, None), 3: ("3.0", 1, None), 4: ("nan", 1, None), 5: ("7.0", 2, 2), 6: ("9.0", 2, 3), 7: ("8.0", 3, 1)}


def test_versions_are_looked_up_by_column():
    """Packs wait as they came and are looked up for all keys of a cell at once: one call a new key; a pack may be ready in part."""
    pa = pytest.importorskip("pyarrow")
    rng = random.Random(5)

    def packs(side, rows):  # of (key, us, number, values ...)
        kinds = [pa.int64(), pa.string(), pa.bool_()] if side else [pa.int64(), pa.string()]
        key, us, number, *values = zip(*rows, strict=True)
        arrays = [pa.array([7] * len(rows), pa.int32()), pa.array(key), pa.array(us, pa.int64()), pa.array(number, pa.int64()), pa.nulls(len(rows), pa.float64()), pa.array([side] * len(rows), pa.int32())]
        arrays += [pa.array(v, t) for v, t in zip(values, kinds, strict=True)]
        out = list(keyed._pack_cells([pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])]))  # noqa: SLF001
        assert all(c == 7 for b in out for c in b.column(0).to_pylist())
        return [(d,) for b in out for d in b.column(1).to_pylist()]

    k = Keyed(0, 3, [], [], True, 2, ["a", "b", "c", "version", "name"])
    k.handle, k.entries, k.keys, k.held, k.until = Cell(), Cell(), Cell(), Cell(), Value()
    k.keys.exists = lambda: bool(k.keys.data)
    facts = [(f"k{rng.randrange(30)}", rng.randrange(2000), None, i, rng.choice([None, f"s{i}"]), i % 3 == 0) for i in range(900)]
    cards = [(f"k{rng.randrange(20)}", rng.randrange(2000), rng.choice([None, i]), i, f"v{i}") for i in range(300)]
    none = [(f"k{i}", None, None, -i, None, True) for i in range(3)]
    got = [x for r in k.handleInputRows((7,), iter(packs(1, facts + none) + packs(0, cards)), None) for x in zip(*r, strict=True)]
    assert sorted(got) == sorted((-i, None, True, None, None) for i in range(3))
    flat = []
    for until in (1, 2, 10):  # milliseconds
        calls = k.keys.calls
        flat.append([x for r in k.handleExpiredTimer((7,), Clock(until), Clock(0)) for x in zip(*(c.tolist() if hasattr(c, "tolist") else c for c in r), strict=True)])
        calls = k.keys.calls - calls
        assert calls == len({r[0] for r in cards if r[1] < 1000}) if until == 1 else calls <= 60
    want = {}
    for key, us, _, i, name, odd in facts:
        before = [(v[1], v[2] is not None, v[2], j) for j, v in enumerate(cards) if v[0] == key and v[1] <= us]
        newest = cards[max(before, key=lambda v: (v[0], v[1], v[2] or 0, v[3]))[3]][3:] if before else (None, None)
        want[i] = (i, name, odd, *newest)
    assert [len(x) for x in flat] == [sum(r[1] < 1000 for r in facts), sum(r[1] >= 1000 for r in facts), 0]
    assert sorted(x for part in flat for x in part) == [want[i] for i in sorted(want)] and list(k.held.get()) == []


def test_asof_of_streams_keeps_all_kinds(spark, tmp_path):
    """Columns of many kinds, with and without nulls, in several batches, equal the batch form."""
    kinds = "id int, k string, ts timestamp_ntz, a tinyint, b smallint, c float, d date, e decimal(9,2), f array<int>, g boolean, h timestamp, n int"
    more = "k string, at timestamp_ntz, v int, x float, y date, z array<string>"
    rng, t = random.Random(6), dt.datetime(2024, 1, 1)
    end = t + dt.timedelta(days=365)
    for b in range(3):
        facts = [(b * 100 + i, rng.choice("abc") if i % 7 else None, t + dt.timedelta(days=b, seconds=rng.randrange(86400)), i, -i, i / 2, dt.date(2024, 1, 1 + i % 20), decimal.Decimal(i) / 4, [i, None], i % 2 == 0, t, rng.choice([None, i])) for i in range(60)]
        cards = [(rng.choice("ab"), t + dt.timedelta(days=b, seconds=rng.randrange(86400)), b * 100 + i, i / 4, None if i % 5 == 0 else dt.date(2024, 2, 1), ["x", None]) for i in range(20)]
        if b == 2:
            facts.append((-1, "z", end, *[None] * 9))
            cards.append(("z", end, -1, None, None, None))
        add(spark, f"{tmp_path}/facts", b, facts, kinds)
        add(spark, f"{tmp_path}/cards", b, cards, more)
        left = S.event_stream(spark, "parquet", kinds, f"{tmp_path}/facts/b=*", "ts", "1 hour")
        right = S.event_stream(spark, "parquet", more, f"{tmp_path}/cards/b=*", "at", "1 hour")
        S.write_stream(S.asof_streams(left, right, ["k"], "ts", "at", "v"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    one, two = (spark.read.schema(s).parquet(f"{tmp_path}/{n}/b=*") for n, s in (("facts", kinds), ("cards", more)))
    want = asof_join(one.filter("id >= 0"), two, ["k"], "ts", "at", seq="v").select([f"{c}" for c in got.columns])
    want = want.withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "at")})
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 180


FACTS, CARDS = "t_id long, cc_num long, amount double, ts timestamp_ntz", "cc_num long, last_modified timestamp_ntz, version long, limit_ double"


def chain_input():
    """Facts and versions in batches; both come out of order, versions up to a day after facts they hold for."""
    rng, t = random.Random(4), dt.datetime(2024, 1, 1)
    facts = [(i, rng.choice([1, 2, 3, None]), rng.choice([None, 1.5, 2.0]), t + dt.timedelta(minutes=rng.randrange(8 * 1440))) for i in range(160)]
    cards = [(rng.choice([1, 2, None]), t + dt.timedelta(minutes=rng.randrange(8 * 1440)), i, i / 2) for i in range(60)]
    cards += [(1, cards[0][1], 900, 9.5), (1, cards[0][1], 901, None)]  # equal times
    facts.sort(key=lambda r: r[3] + dt.timedelta(minutes=rng.randrange(700)))
    cards.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(700)))
    end = dt.datetime(2025, 1, 1)
    cut = [t + dt.timedelta(days=d) for d in (0, 2, 3, 5, 30)]
    parts = []
    for a, b in zip(cut, cut[1:]):
        parts.append(([r for r in facts if a <= r[3] < b], [r for r in cards if a <= r[1] < b]))
    # rows change batches by less than the delay
    for i in range(len(parts) - 1):
        for j in (0, 1):
            late = parts[i][j][::5]
            for r in late:
                at = r[3] if j == 0 else r[1]
                if cut[i + 1] - at < dt.timedelta(hours=20):
                    parts[i][j].remove(r)
                    parts[i + 1][j].append(r)
    return facts, cards, [*parts, ([(9000, 9, 0.0, end)], [(9, end, 0, 0.0)])]


def test_chain_of_two_streams_over_restarts(spark, tmp_path):
    facts, cards, parts = chain_input()
    table = KeyedTable(f"{tmp_path}/table", ["cc_num", "t_id"], "ts", "t_id", slots=2, compact=2)
    for i, (f, c) in enumerate(parts):
        add(spark, f"{tmp_path}/facts", i, f, FACTS)
        add(spark, f"{tmp_path}/cards", i, c, CARDS)
        left = S.event_stream(spark, "parquet", FACTS, f"{tmp_path}/facts/b=*", "ts", "2 days")
        right = S.event_stream(spark, "parquet", CARDS, f"{tmp_path}/cards/b=*", "last_modified", "2 days")
        S.fraud_features_stream(left, right, WINDOWS, ["ts", "amount"], table, f"{tmp_path}/check").awaitTermination()
    one, two = spark.createDataFrame(facts, FACTS), spark.createDataFrame(cards, CARDS)
    df = lag_features(rolling(one, ["cc_num"], "ts", "amount", WINDOWS), "cc_num", "ts", ["ts", "amount"], "t_id")
    want = {r.t_id: r for r in asof_join(df, two, ["cc_num"], "ts", "last_modified", seq="version").collect()}
    got = {r.t_id: r for r in table.read(spark).filter("t_id < 9000").collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert (r.version, r.limit_, r.last_modified) == (want[k].version, want[k].limit_, want[k].last_modified)
        assert (r.prev_ts, r.prev_amount, r.num_hour, r.num_day) == (want[k].prev_ts, want[k].prev_amount, want[k].num_hour, want[k].num_day)
        assert abs(r.sum_hour - want[k].sum_hour) < 1e-9 and abs(r.sum_day - want[k].sum_day) < 1e-9
    # the last commit is lost: the batch is made again from state and gives the same table
    before = sorted(map(str, table.read(spark).collect()))
    log = sorted(Path(f"{tmp_path}/check/commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    for p in (log, log.with_name(f".{log.name}.crc")):
        p.unlink(missing_ok=True)
    S.fraud_features_stream(left, right, WINDOWS, ["ts", "amount"], table, f"{tmp_path}/check").awaitTermination()
    assert sorted(map(str, table.read(spark).collect())) == before


def test_asof_streams_equal_the_batch_join(spark, tmp_path):
    facts, cards, parts = chain_input()
    for i, (f, c) in enumerate(parts):
        add(spark, f"{tmp_path}/facts", i, f, FACTS)
        add(spark, f"{tmp_path}/cards", i, c, CARDS)
        left = S.event_stream(spark, "parquet", FACTS, f"{tmp_path}/facts/b=*", "ts", "2 days")
        right = S.event_stream(spark, "parquet", CARDS, f"{tmp_path}/cards/b=*", "last_modified", "2 days")
        S.write_stream(S.asof_streams(left, right, ["cc_num"], "ts", "last_modified", "version", "t_id"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    want = asof_join(spark.createDataFrame(facts, FACTS), spark.createDataFrame(cards, CARDS), ["cc_num"], "ts", "last_modified", seq="version")
    got = spark.read.parquet(f"{tmp_path}/out").filter("t_id < 9000")
    assert sorted((r.t_id, repr(r.version), repr(r.limit_)) for r in got.collect()) == sorted((r.t_id, repr(r.version), repr(r.limit_)) for r in want.collect())


def test_expectations_per_batch(spark, tmp_path):
    rules = [("amount", "min", 0.0, None, False), ("amount", "mean", None, 3.0, True), ("t_id", "count", 5.0, None, False), ("amount", "max", 1.0, 6.0, False)]
    parts = [made(30), [(500, 1, None, dt.datetime(2024, 2, 1))], [(600 + i, 1, -1.0 * i, dt.datetime(2024, 2, 2)) for i in range(8)]]
    for i, part in enumerate(parts):
        add(spark, f"{tmp_path}/in", i, part)
        stream, log = expect(S.event_stream(spark, "parquet", SCHEMA, f"{tmp_path}/in/b=*", "ts"), rules, f"{tmp_path}/log")
        S.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        log.wait()
        spark.streams.removeListener(log)
    got = {(r.batch_id, r.column_name, r.statistic): (r.observed, r.success) for r in read_expectations(spark, f"{tmp_path}/log").collect()}
    want = {}
    for i, part in enumerate(parts):
        for r in validate(spark.createDataFrame(part, SCHEMA), rules).collect():
            want[i, r.column_name, r.statistic] = (r.observed, r.success)
    assert got == want and spark.read.parquet(f"{tmp_path}/out").count() == sum(map(len, parts))


def test_avro_values(spark):
    """Known bytes, a round trip of all types with nulls, and bytes that are no record."""
    from featurespark.sources.avro import decode, encode

    plain = '{"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}, {"name": "c", "type": ["null", "double"]}]}'
    known = [(b"\x36\x06foo\x00",), (b"\x01\x00\x02\x00\x00\x00\x00\x00\x00\xf8\x3f",), (b"\x36\x06fo",), (b"\x36\x06foo\x00\x00",), (None,), (b"",)]
    got = [r.v for r in spark.createDataFrame(known, "x binary").coalesce(1).select(decode(F.col("x"), plain).alias("v")).collect()]
    assert [tuple(v) if v else None for v in got] == [(27, "foo", None), (-1, "", 1.5), None, None, None, None]
    full = """{"type": "record", "name": "r", "fields": [
      {"name": "l", "type": "long"}, {"name": "i", "type": ["int", "null"]}, {"name": "f", "type": "float"}, {"name": "o", "type": "boolean"}, {"name": "y", "type": ["null", "bytes"]},
      {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["x", "y"]}}, {"name": "d", "type": ["null", {"type": "int", "logicalType": "date"}]},
      {"name": "t", "type": {"type": "long", "logicalType": "timestamp-micros"}}, {"name": "m", "type": ["null", {"type": "long", "logicalType": "timestamp-millis"}]},
      {"name": "n", "type": {"type": "long", "logicalType": "local-timestamp-micros"}}, {"name": "a", "type": {"type": "array", "items": ["null", "long"]}},
      {"name": "p", "type": {"type": "map", "values": "double"}}, {"name": "s", "type": ["null", {"type": "record", "name": "s", "fields": [{"name": "k", "type": ["null", "string"]}, {"name": "w", "type": {"type": "long", "logicalType": "timestamp-micros"}}]}]}]}"""
    t, big = dt.datetime(2024, 2, 29, 12, 30, 15, 123456), 2**62 + 1
    rows = [
        (big, None, 0.5, True, None, "y", None, t, None, t, [], {}, None),
        (-big, -7, -2.0, False, b"\x00\xff", "x", dt.date(1969, 12, 31), dt.datetime(1969, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 5000), t, [1, None, -(2**40)], {"\u00e9": 1.5}, (None, t)),
    ]
    kind = "l long, i int, f float, o boolean, y binary, e string, d date, t timestamp, m timestamp, n timestamp_ntz, a array<long>, p map<string, double>, s struct<k: string, w: timestamp>"
    df = spark.createDataFrame(rows, kind)
    out = df.select("*", encode(F.struct(*df.columns), full).alias("x")).select("*", decode(F.col("x"), full, strict=True).alias("v"))
    for r in out.collect():
        assert tuple(r.v) == tuple(r)[: len(df.columns)]
    for bad in ('{"type": "record", "name": "r", "fields": [{"name": "a", "type": ["int", "string"]}]}', '"long"', '{"type": "record", "name": "r", "fields": [{"name": "a", "type": "decimal"}]}'):
        with pytest.raises(ValueError):
            decode(F.col("x"), bad)
