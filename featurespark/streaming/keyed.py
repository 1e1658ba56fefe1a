"""One stateful processor for rolling sums, lags and versions as of a time per key (O-93 to O-96).

Keys are dealt to CELLS groups, as each call to Spark's state and each group of rows costs far more than a row: rows wait
and timers run for a cell, and a key's own state is read and written once in a batch that touches the key.

State of a key, none of which grows with the key's history:

* ``rows``: the rows of the longest window in small packed parts, keyed by bucket of time and number of the part; a batch
  adds parts to the buckets that it touches, and reads only those and the ones in which its windows begin;
* ``index``: for each bucket of the longest window its sum, its count and its number of parts, the last row's values, and
  all rows of a key that has FEW at most, which then needs no ``rows``;
* ``versions``: the newest version before the watermark (``keys`` holds index and versions by key).

State of a cell (``ordered`` only):

* ``held``: rows and versions that wait for the watermark, one packed part a batch, of packs as they came;
* ``until``: up to where rows have come out; what comes later than that is dropped.

A window is the end of one bucket, whole buckets, and the beginning of the row's own, each added up from what is inside
the window: nothing is taken away again, so a large value leaves no rounding behind when it expires.

Rows enter the processor packed by column, up to PACK of a cell in one value, and leave it in arrays of up to CHUNK rows, as
Spark turns rows into Python's cell by cell. Packs wait as they are; where only versions are looked up, all keys of a cell are
done at once by column, else packs become rows when their time has come.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from featurespark.ship import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 512  # of the longest window
PARTS = 16  # of a bucket, before they are put together
FEW = 512  # rows of a key that are kept in one value
CHUNK = 256  # rows in one row of arrays
CELLS = 4096  # groups of keys
PACK = 64  # rows of a cell in one packed value, which bounds what Spark sends at once
PACKED_AT_ONCE = 250_000  # rows that are put in order of cells together
_PACKED = StructType([StructField("data", BinaryType())])
_KEY = StructType([StructField("key", StringType())])
_OF_KEY = StructType([StructField("index", BinaryType()), StructField("versions", BinaryType())])
_PLACE = StructType([StructField("key", StringType()), StructField("bucket", LongType()), StructField("part", LongType())])
_INPUT = StructType([StructField("_cell", IntegerType()), StructField("_data", BinaryType())])


def _pack(us: np.ndarray, v: np.ndarray, ok: np.ndarray) -> bytes:
    return us.tobytes() + v.tobytes() + ok.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 17
    data = bytes(data)
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, n, 8 * n), np.frombuffer(data, np.uint8, n, 16 * n)


def _pack_cells(batches: Iterator) -> Iterator:
    """Arrow batches of (_cell, _key, values of a row ...) as (_cell, packed rows of the cell by column).

    The rows of a pack are in order of keys, all with a time or all without, and all facts or all versions. It holds the
    least and greatest time, the keys and how many rows each has, and the columns: see _column.
    """
    import pyarrow as pa

    def sorted_column(c: pa.Array, order: np.ndarray) -> np.ndarray | list | None:
        if c.null_count == len(c):
            return None
        if c.null_count == 0 and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type) or pa.types.is_boolean(c.type)):
            return c.to_numpy(zero_copy_only=False)[order]
        values = c.to_pylist()
        return [values[i] for i in order.tolist()]

    def packed(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(waiting).combine_chunks()
        cells, keys, us, _, _, side, *_ = (pa.concat_arrays(c.chunks) for c in table.columns)
        keys = keys.dictionary_encode()
        names = keys.dictionary.to_pylist()
        group = cells.to_numpy().astype(np.int64) * 2 + us.is_null().to_numpy(zero_copy_only=False)
        codes = keys.indices.to_numpy().astype(np.int64)
        order = np.argsort((group << 32) | codes, kind="stable")
        group, codes, side = group[order], codes[order], side[0].as_py()
        columns = [sorted_column(pa.concat_arrays(c.chunks), order) for c in table.columns[2:]]
        columns[3] = None  # the side
        own, data = [], []
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for begin, end in zip(bounds, bounds[1:]):
            for i in range(begin, end, PACK):
                j = min(i + PACK, end)
                first = np.concatenate([[0], np.flatnonzero(np.diff(codes[i:j])) + 1])
                cols = [(c.dtype.str, c[i:j].tobytes()) if isinstance(c, np.ndarray) else c and c[i:j] for c in columns]
                at = None if group[i] % 2 else (int(columns[0][i:j].min()), int(columns[0][i:j].max())) if isinstance(columns[0], np.ndarray) else (min(cols[0]), max(cols[0]))
                own.append(int(group[i]) // 2)
                data.append(pickle.dumps({"us": at, "side": side, "keys": [names[c] for c in codes[i:j][first].tolist()], "n": np.diff(first, append=j - i).tolist(), "cols": cols}, 5))
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(data, pa.binary())], names=_INPUT.names)

    waiting, n = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        n += batch.num_rows
        if n >= PACKED_AT_ONCE:
            yield packed(waiting)
            waiting, n = [], 0
    if n:
        yield packed(waiting)


def _column(packs: list[dict], i: int) -> np.ndarray | list:
    """A column of several packs: an array of NumPy if each has numbers of the same kind and no nulls, or else a list."""
    cols = [p["cols"][i] for p in packs]
    if all(isinstance(c, tuple) for c in cols) and len({c[0] for c in cols}) == 1:
        return np.frombuffer(b"".join(c[1] for c in cols), cols[0][0])
    out = []
    for p, c in zip(packs, cols, strict=True):
        out += [None] * sum(p["n"]) if c is None else np.frombuffer(c[1], c[0]).tolist() if isinstance(c, tuple) else c
    return out


def _split(pack: dict, us: int) -> tuple[dict | None, dict | None]:
    """The rows of a pack before a time, and the others; None for no rows."""
    if pack["us"][1] < us:
        return pack, None
    if pack["us"][0] >= us:
        return None, pack
    at = np.asarray(_column([pack], 0), np.int64)
    own = np.repeat(np.arange(len(pack["n"])), pack["n"])
    out = []
    for keep in (at < us, at >= us):
        n = np.bincount(own[keep], minlength=len(pack["n"])).tolist()
        cols = [(c[0], np.frombuffer(c[1], c[0])[keep].tobytes()) if isinstance(c, tuple) else c and list(compress(c, keep.tolist())) for c in pack["cols"]]
        keys = [k for k, m in zip(pack["keys"], n, strict=True) if m]
        out.append({"us": (int(at[keep].min()), int(at[keep].max())), "side": pack["side"], "keys": keys, "n": [m for m in n if m], "cols": cols})
    return tuple(out)


def _pairs(pack: dict) -> list[tuple]:
    """The rows of a pack as (key, row)."""
    cols = [_column([pack], i) if i != 3 else [pack["side"]] * sum(pack["n"]) for i in range(len(pack["cols"]))]
    keys = [k for k, n in zip(pack["keys"], pack["n"], strict=True) for _ in range(n)]
    return list(zip(keys, zip(*[c.tolist() if isinstance(c, np.ndarray) else c for c in cols], strict=True), strict=True))


def _array(values: tuple):
    """Values of a column for Spark: numbers as an array of NumPy, which stays small, others as they are."""
    if None in values or not isinstance(values[0], (int, float)):
        return values
    return np.array(values)


class _Part:
    """A column of a key's value of state, like a value of its own."""

    def __init__(self, data: bytes | None):
        self.data, self.changed = data, False

    def get(self) -> tuple | None:
        return None if self.data is None else (self.data,)

    def update(self, value: tuple) -> None:
        (self.data,), self.changed = value, True


class _Rows:
    """The entries of one key in a map of all keys of a cell."""

    def __init__(self, entries, key: str):
        self.entries, self.key = entries, key

    def getValue(self, place: tuple):  # noqa: N802
        return self.entries.getValue((self.key, *place))

    def updateValue(self, place: tuple, value: tuple) -> None:  # noqa: N802
        self.entries.updateValue((self.key, *place), value)

    def removeKey(self, place: tuple) -> None:  # noqa: N802
        self.entries.removeKey((self.key, *place))


class _Bucket:
    """A bucket's rows in order of time, with sums from its beginning and from its end."""

    def __init__(self, parts: list[tuple]):
        us, v, ok = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(us, kind="stable")
        self.us, self.v, self.ok = us[order], v[order], ok[order].astype(np.int64)
        self.upto, self.n_upto = np.concatenate([[0.0], np.cumsum(self.v)]), np.concatenate([[0], np.cumsum(self.ok)])
        self.since = np.concatenate([np.cumsum(self.v[::-1])[::-1], [0.0]])
        self.n_since = np.concatenate([np.cumsum(self.ok[::-1])[::-1], [0]])


class Keyed(StatefulProcessor):
    """Packs, or packed lists of (key, row), are at ``at``, rows being (_us, _id, _v, _side, values ...); see keyed_features.

    A packed row without a key is one of the key whose state is at hand.
    """

    def __init__(self, at: int, n_facts: int, windows: list[int], lags: list[int], ordered: bool, versions: int | None, names: list[str]):
        self.at, self.n_facts, self.lags, self.ordered, self.n_version, self.names = at, n_facts, lags, ordered, versions, names
        self.windows = [s * 1_000_000 for s in windows]
        self.longest = max(self.windows, default=0)
        self.width = max(1, self.longest // BUCKETS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("rows", _PLACE, _PACKED)
        self.keys = handle.getMapState("keys", _KEY, _OF_KEY)
        if self.ordered:
            self.held = handle.getListState("held", _PACKED)
            self.until = handle.getValueState("until", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._arrays(self._handle(rows))

    def _handle(self, rows: Iterator[Row]) -> Iterator[list]:
        facts, timed = [], []
        since = self.until.get() if self.ordered else None
        for r in rows:
            data = pickle.loads(bytes(r[self.at]))
            if isinstance(data, dict):
                if data["us"] and self.ordered:
                    data = _split(data, since[0])[1] if since else data
                    timed += [data] if data else []
                    continue
                data = _pairs(data)
            for pair in data if isinstance(data, list) else [(None, data)]:
                (facts if pair[1][0] is None else timed).append(pair)
        for _, r in facts:  # rows without a time belong to no window
            yield self._row(r, [None] * (2 * len(self.windows)), [None] * len(self.lags), None)
        if timed and self.ordered:
            if since:
                timed = [x for x in timed if isinstance(x, dict) or x[1][0] >= since[0]]  # packs are cut already
            if timed:
                self._hold(timed)
        elif timed:
            yield from self._by_key(timed)

    def _hold(self, items: list[tuple | dict]) -> None:
        self.held.appendValue((pickle.dumps(items),))
        self.handle.registerTimer(min(x["us"][0] if isinstance(x, dict) else x[1][0] for x in items) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        ready, rest = [], []
        for (data,) in self.held.get():
            for item in pickle.loads(bytes(data)):
                before, after = _split(item, until) if isinstance(item, dict) else (item, None) if item[1][0] < until else (None, item)
                ready += [before] if before else []
                rest += [after] if after else []
        if not ready:
            return
        self.held.clear()
        if rest:
            self._hold(rest)
        self.until.update((until,))
        if not self.windows and not self.lags and self.n_version is not None and all(isinstance(x, dict) for x in ready):
            ids = _column([p for p in ready if p["side"]], 1)
            if isinstance(ids, np.ndarray) or ids.count(None) == len(ids):
                yield from self._asof(ready, ids, until)
                return
        pairs = []
        for x in ready:
            pairs += _pairs(x) if isinstance(x, dict) else [x]
        yield from self._arrays(self._by_key(pairs, until))

    def _asof(self, packs: list[dict], ids: np.ndarray | list, until: int) -> Iterator[Row]:
        """What _by_key and _arrays give where there are only versions to look up, by column for all keys of a cell."""
        facts, new = [p for p in packs if p["side"]], {}
        for p in packs:
            if not p["side"]:
                for key, r in _pairs(p):
                    new.setdefault(key, []).append(r)
        codes = {k: i for i, k in enumerate(dict.fromkeys([*new, *(k for p in facts for k in p["keys"])]))}
        there = self.keys.exists()
        times, owners, values = [], [], []
        for key, code in codes.items():
            index, known = (there and self.keys.getValue((key,))) or (None, None)
            known = pickle.loads(bytes(known)) if known is not None else []
            if key in new:
                known = self._merged(known, new[key])
            times += [v[0] for v in known]
            owners += [code] * len(known)
            values += [v[2] for v in known]
            newest = self._newest(known, until)
            if key in new or newest:
                self.keys.updateValue((key,), (index, pickle.dumps(known[newest:])))
        if not facts:
            return
        n = len(times)
        at = np.concatenate([np.array(times, np.int64), _column(facts, 0)])
        own = np.repeat([codes[k] for p in facts for k in p["keys"]], [m for p in facts for m in p["n"]])
        owners = np.concatenate([np.array(owners, np.int64), own])
        is_fact = np.arange(len(at)) >= n
        by_id = [np.concatenate([np.zeros(n, ids.dtype), ids])] if isinstance(ids, np.ndarray) else []
        order = np.lexsort((*by_id, is_fact, at, owners))
        last = np.maximum.accumulate(np.where(is_fact[order], -1, np.arange(len(at))))  # place of the version before
        place = last[is_fact[order]]
        row = order[is_fact[order]]
        version = np.where(place >= 0, order[place], -1)
        version = np.where((version >= 0) & (owners[version] == owners[row]), version, -1).tolist()
        row = row - n
        out = []
        for i in range(4, 4 + self.n_facts):
            c = _column(facts, i)
            out.append(c[row] if isinstance(c, np.ndarray) else [c[j] for j in row.tolist()])
        for i in range(self.n_version):
            c = [v[i] for v in values] + [None]  # no version is at the end
            out.append([c[j] for j in version])
        for i in range(0, len(row), CHUNK):
            chunk = [c[i : i + CHUNK] for c in out]
            yield Row(**dict(zip(self.names, [c if isinstance(c, np.ndarray) else _array(tuple(c)) for c in chunk], strict=True)))

    def _by_key(self, pairs: list[tuple], until: int | None = None) -> Iterator[list]:
        by_key: dict[str | None, tuple[list, list]] = {}
        for key, r in pairs:
            by_key.setdefault(key, ([], []))[r[3]].append(r)
        for key, (versions, facts) in by_key.items():
            if key is not None:
                state = self.keys.getValue((key,)) or (None, None)
                self.index, self.versions = (_Part(x if x is None else bytes(x)) for x in state)
                self.rows = _Rows(self.entries, key)
            if versions:
                self._add_versions(versions)
            if facts:
                yield from self._emit(facts)
            if until is not None and self.n_version is not None:
                self._keep_newest(until)
            if key is not None and (self.index.changed or self.versions.changed):
                self.keys.updateValue((key,), (self.index.data, self.versions.data))

    def _arrays(self, rows: Iterator[list]) -> Iterator[Row]:
        while chunk := list(islice(rows, CHUNK)):
            yield Row(**dict(zip(self.names, map(_array, zip(*chunk, strict=True)), strict=True)))

    def _row(self, r: tuple, sums: list, lags: list, version: tuple | None) -> list:
        out = [*r[4 : 4 + self.n_facts], *sums, *lags]
        if self.n_version is not None:
            out += version if version is not None else [None] * self.n_version
        return out

    def _emit(self, facts: list[tuple]) -> Iterator[list]:
        facts.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
        state = self.index.get() if self.windows or self.lags else None
        # a key of few rows has them all in ``few`` and no buckets; one of more has None there
        buckets, last, few = pickle.loads(bytes(state[0])) if state else ({}, None, b"")
        if not self.windows:
            sums = [[]] * len(facts)
        elif few is not None and len(few) // 17 + len(facts) <= FEW:
            sums, few = self._sums_of_few(facts, few)
        else:
            if few:
                _, buckets = self._sums([(t, None, x if y else None) for t, x, y in zip(*(c.tolist() for c in _unpack(few)), strict=True)], buckets)
            few = None
            sums, buckets = self._sums(facts, buckets)
        versions = self._versions() if self.n_version is not None else []
        times = [v[0] for v in versions]
        for r, s in zip(facts, sums, strict=True):
            i = bisect_right(times, r[0]) - 1
            yield self._row(r, s, last or [None] * len(self.lags), versions[i][2] if i >= 0 else None)
            last = [r[4 + i] for i in self.lags]
        if self.windows or self.lags:
            self.index.update((pickle.dumps((buckets, last, few)),))

    def _keep_newest(self, until: int) -> None:
        versions = self._versions()
        keep = self._newest(versions, until)
        if keep:
            self.versions.update((pickle.dumps(versions[keep:]),))

    @staticmethod
    def _newest(versions: list[tuple], until: int) -> int:
        """Place of the newest version before the watermark, which is still needed."""
        return max(0, bisect_right([v[0] for v in versions], until - 1) - 1)

    def _versions(self) -> list[tuple]:
        state = self.versions.get()
        return pickle.loads(bytes(state[0])) if state else []

    def _add_versions(self, rows: list[tuple]) -> None:
        self.versions.update((pickle.dumps(self._merged(self._versions(), rows)),))

    @staticmethod
    def _merged(versions: list[tuple], rows: list[tuple]) -> list[tuple]:
        """Versions (time, number, values) with those of rows; of the same time and number the last one stays."""
        known = {v[:2]: v for v in [*versions, *((r[0], r[1], r[4:]) for r in rows if r[0] is not None)]}
        return sorted(known.values(), key=lambda v: (v[0], v[1] is not None, v[1]))

    def _sums_of_few(self, facts: list[tuple], few: bytes) -> tuple[list[tuple], bytes]:
        """Sum and count of each window for facts in order of time, from all rows of the key, and its rows packed anew."""
        at = np.array([r[0] for r in facts], np.int64)
        v = np.array([0.0 if r[2] is None else r[2] for r in facts], np.float64)
        ok = np.array([r[2] is not None for r in facts], np.uint8)
        us, v, ok = (np.concatenate(x) for x in zip(_unpack(few), (at, v, ok), strict=True))
        order = np.argsort(us, kind="stable")
        us, v, ok = us[order], v[order], ok[order]
        n, ended = np.concatenate([[0], np.cumsum(ok, dtype=np.int64)]), np.append(v, 0.0)
        end = np.searchsorted(us, at, "right")  # rows of the same time see each other
        out = []
        for size in self.windows:
            begin = np.searchsorted(us, at - size, "left")
            out += [np.add.reduceat(ended, np.stack([begin, end], 1).ravel())[::2].tolist(), (n[end] - n[begin]).tolist()]
        cut = np.searchsorted(us, us[-1] - self.longest - self.width, "left")
        return list(zip(*out, strict=True)), _pack(us[cut:], v[cut:], ok[cut:])

    def _sums(self, facts: list[tuple], buckets: dict[int, tuple]) -> tuple[list[list], dict[int, tuple]]:
        """Sum and count of each window for facts in order of time, and the new index (bucket: sum, count, parts)."""
        us = np.array([r[0] for r in facts], np.int64)
        v = np.array([0.0 if r[2] is None else r[2] for r in facts], np.float64)
        ok = np.array([r[2] is not None for r in facts], np.uint8)
        own, first = np.unique(us // self.width, return_index=True)
        ends = [*first[1:].tolist(), len(us)]
        fresh = {b: (us[i:j], v[i:j], ok[i:j]) for b, i, j in zip(own.tolist(), first.tolist(), ends, strict=True)}
        new = dict(buckets)
        for b, (_, x, y) in fresh.items():
            s, n, parts = new.get(b, (0.0, 0, 0))
            new[b] = (s + float(x.sum()), n + int(y.sum()), parts)
        numbers = np.array(sorted(new), np.int64)
        whole, n_whole = np.array([new[b][0] for b in numbers.tolist()]), np.array([new[b][1] for b in numbers.tolist()], np.int64)
        loaded: dict[int, _Bucket] = {}

        def load(b: int) -> _Bucket:
            if b not in loaded:
                parts = [_unpack(self.rows.getValue((b, p))[0]) for p in range(buckets.get(b, (0, 0, 0))[2])]
                loaded[b] = _Bucket(parts + ([fresh[b]] if b in fresh else []))
            return loaded[b]

        middle: dict[tuple[int, int], tuple[float, int]] = {}
        out = []
        for t in us.tolist():
            b, row = t // self.width, []
            here = load(b)
            end = int(np.searchsorted(here.us, t, "right"))  # rows of the same time see each other
            for size in self.windows:
                since = t - size
                a = since // self.width
                if a == b:
                    i = int(np.searchsorted(here.us, since, "left"))
                    row += [float(here.v[i:end].sum()), int(here.ok[i:end].sum())]
                    continue
                if (a, b) not in middle:
                    lo, hi = np.searchsorted(numbers, a, "right"), np.searchsorted(numbers, b, "left")
                    middle[a, b] = float(whole[lo:hi].sum()), int(n_whole[lo:hi].sum())
                s, n = middle[a, b]
                if a in new:
                    there = load(a)
                    i = int(np.searchsorted(there.us, since, "left"))
                    s, n = s + float(there.since[i]), n + int(there.n_since[i])
                row += [s + float(here.upto[end]), n + int(here.n_upto[end])]
            out.append(row)
        cut = (int(numbers[-1]) * self.width - self.longest) // self.width - 1
        for b in [b for b in new if b < cut]:
            for p in range(new[b][2]):
                self.rows.removeKey((b, p))
            del new[b]
        for b, part in fresh.items():
            if b in new:
                s, n, parts = new[b]
                if parts >= PARTS:  # put together, so that reading a bucket takes few calls
                    for p in range(1, parts):
                        self.rows.removeKey((b, p))
                    whole_bucket, parts = load(b), 0
                    part = (whole_bucket.us, whole_bucket.v, whole_bucket.ok.astype(np.uint8))
                self.rows.updateValue((b, parts), (_pack(*part),))
                new[b] = (s, n, parts + 1)
        return out, new

    def close(self) -> None:
        pass


def keyed_features(
    stream: DataFrame, keys: list[str], ts: str, id_col: str | None, value: str | None, windows: dict[str, int], lags: list[str] = (), emit: str = "immediate",
    versions: DataFrame | None = None, version_ts: str | None = None, seq: str | None = None,
) -> DataFrame:
    """stream with sum_<name>, num_<name>, prev_<col>, and the columns of the newest version at or before its time.

    ``immediate`` gives rows out in the batch that brings them: right for input in order of time. ``ordered`` holds rows
    until the watermark has passed them, so that rows and versions out of order by less than the watermark's delay come out
    right; what comes after later rows of its cell have come out is dropped. With versions, a stream of its own with a watermark, the
    smaller of both watermarks counts.

    Rows without a time come out at once with nulls; a null value counts as 0 and not at all; a null key is a key. Version
    columns named like those of the stream are dropped.
    """
    if versions is not None and emit != "ordered":
        raise ValueError("versions that stream need emit='ordered': rows wait for the versions before them")
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    extra = [c for c in versions.columns if c not in stream.columns] if versions is not None else []
    if versions is not None:
        versions = versions.dropna(subset=[*keys, version_ts])  # as in the batch form, null keys match nothing
    null = lambda kind: F.lit(None).cast(kind)

    def plain(df: DataFrame, c: str):  # times as numbers: rows in Python know no time zone
        return F.unix_micros(c) if isinstance(df.schema[c].dataType, TimestampType) else F.col(c)

    def name_of(k: str, df: DataFrame):  # equal for what Spark groups together
        return F.col(k) + F.lit(0).cast(df.schema[k].dataType) if isinstance(df.schema[k].dataType, (DoubleType, FloatType)) else F.col(k)

    def packed(df: DataFrame, at: str, number, amount, side: int, names: list[str]) -> DataFrame:
        micros = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
        key = F.to_json(F.struct(*[name_of(k, df).alias(f"_k{i}") for i, k in enumerate(keys)]), micros)
        values = [c.alias(f"_c{i}") for i, c in enumerate([F.unix_micros(F.col(at)), number, amount, F.lit(side), *[plain(df, c) for c in names]])]
        return df.select(F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int").alias("_cell"), key.alias("_key"), *values).mapInArrow(_pack_cells, _INPUT)

    def kinds(df: DataFrame, names: list[str]) -> list:
        return [f.dataType for f in df.select(*[plain(df, c).alias(f"_c{i}") for i, c in enumerate(names)]).schema] if names else []

    number = F.col(id_col).cast("long") if id_col else null("long")
    amount = F.col(value).cast("double") if value and windows else null("double")
    fields, types = list(stream.columns), kinds(stream, stream.columns)
    one = packed(stream, ts, number, amount, 1, fields)
    if versions is not None:
        one = one.unionByName(packed(versions, version_ts, F.col(seq).cast("long") if seq else null("long"), null("double"), 0, extra))
    made = [(f"{p}_{n}", t) for n in windows for p, t in (("sum", DoubleType()), ("num", LongType()))]
    made += [(f"prev_{c}", types[fields.index(c)]) for c in lags]
    made += list(zip(extra, kinds(versions, extra), strict=True)) if versions is not None else []
    names, kind = zip(*zip(fields, types, strict=True), *made, strict=True)
    schema = StructType([StructField(f"_o{i}", ArrayType(t)) for i, t in enumerate(kind)])
    processor = Keyed(1, len(fields), list(windows.values()), [fields.index(c) for c in lags], emit == "ordered", len(extra) if versions is not None else None, schema.names)
    out = one.groupBy("_cell").transformWithState(processor, schema, "Append", "EventTime" if emit == "ordered" else "None")
    out = out.select(F.inline(F.arrays_zip(*schema.names)))
    times = {c for c in fields if isinstance(stream.schema[c].dataType, TimestampType)}
    times |= {f"prev_{c}" for c in lags if c in times} | {c for c in extra if isinstance(versions.schema[c].dataType, TimestampType)}
    return out.select(*[(F.timestamp_micros(o) if c in times else F.col(o)).alias(c) for o, c in zip(schema.names, names, strict=True)])
