"""Benchmark decontamination by winnowed word fingerprints (operator 10).

A window is ``n`` consecutive words of a benchmark item; an item of fewer words is one window as a whole. Of every
``w`` consecutive k-gram hashes the smallest (the rightmost of equals) is a fingerprint; with k + w - 1 = n, texts that
share n words in a row share the fingerprint chosen inside that span. Equal fingerprints of document and item are the
seeds; each is extended word by word in both texts, so the result is exact and not a matter of hash values. Items under
n words are looked up by the hash of all their words and then compared word by word.

Two plans give the same rows. While the benchmark's text is at most ``max_broadcast_bytes`` (measured first), its index
goes to every task and documents are not shuffled. Beyond that, documents are searched for fingerprints that the
benchmark has (a semi-join, so that a common one makes one row a document), the seeds are extended to the windows of n
words around them, and these meet the benchmark's windows, word by word, in a join of one row a window. Windows of the
same items form a class, and documents of the same classes are given their items once.

Defined results: null or wordless text has no words, hits or items and is not contaminated; a benchmark row without
words matches nothing; repeated item rows count once; a null item_id is listed as ``null``; documents are kept row for
row, so repeated rows and ids give repeated rows; other columns of the input pass through ``decontaminate`` untouched,
unless they bear a name of its result, which then holds the result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, alnum_words, map_rows, mix64, names, written

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of unsigned 64-bit word hashes."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix64(out + words[i : len(words) - k + 1 + i] + _STEP)
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the fingerprints: in each window of w hashes the smallest, of equals the rightmost."""
    if not len(hashes):
        return np.empty(0, np.int64)
    if len(hashes) < w:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(hashes, w)[:, ::-1]
    return np.unique(np.arange(len(view)) + w - 1 - view.argmin(axis=1))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Index:
    """Fingerprints of benchmark items: what a task needs to find their windows in documents."""

    def __init__(self, rows: list[tuple[object, bytes | None]], n: int, k: int):
        self.n, self.k, self.w = n, k, n - k + 1
        ids: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in rows:
            if words := tuple(alnum_words(text)):
                ids[words].add("null" if item is None else str(item))
        self.ids = [sorted(x) for x in ids.values()]
        self.vocab: dict[bytes, int] = {}
        self.items = [np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in words]) for words in ids]
        self.hash_of = np.concatenate([np.zeros(1, np.uint64), word_hashes(list(self.vocab))])
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, item in enumerate(self.items):
            if len(item) < n:
                self.short[len(item)][int(gram_hashes(self.hash_of[item], len(item))[0])].append(i)
                continue
            grams = gram_hashes(self.hash_of[item], k)
            for p in winnow(grams, self.w).tolist():
                self.seeds[int(grams[p])].append((i, p))
        self.seeds, self.short = dict(self.seeds), {m: dict(x) for m, x in self.short.items()}
        self.least = min([n] * bool(self.seeds) + list(self.short), default=0)

    def find(self, words: list[bytes]) -> tuple[int, set[int]]:
        """Number of words inside windows, and which items have a window in these words."""
        get = self.vocab.get
        ids = np.fromiter((get(x, 0) for x in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).view(np.int8)))
        hit, items = np.zeros(len(ids), bool), set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.least > 0:
                self._run(ids[a:b], hit[a:b], items)
        return int(hit.sum()), items

    def _run(self, ids: np.ndarray, hit: np.ndarray, items: set[int]) -> None:
        hashes = self.hash_of[ids]
        for m, known in self.short.items():
            grams = gram_hashes(hashes, m)
            for p in np.flatnonzero(np.isin(grams, np.fromiter(known, np.uint64, len(known)))).tolist():
                for i in known[int(grams[p])]:
                    if np.array_equal(self.items[i], ids[p : p + m]):
                        hit[p : p + m] = True
                        items.add(i)
        if len(ids) < self.n or not self.seeds:
            return
        grams, done = gram_hashes(hashes, self.k), {}
        for p in winnow(grams, self.w).tolist():
            for i, q in self.seeds.get(int(grams[p]), ()):
                if done.get((i, p - q), -1) > p:
                    continue
                s, e = extend(ids, self.items[i], p, q)
                done[i, p - q] = max(e, p + 1)
                if e - s >= self.n:
                    hit[s:e] = True
                    items.add(i)


def extend(a: np.ndarray, b: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """Start and end in a of the longest equal span that holds a[p] and b[q]; empty if these differ."""
    back, on = min(p, q), min(len(a) - p, len(b) - q)
    same = a[p : p + on] == b[q : q + on]
    ahead = on if same.all() else int(same.argmin())
    same = a[p - back : p][::-1] == b[q - back : q][::-1]
    return (p - (back if same.all() else int(same.argmin())), p + ahead) if ahead else (p, p)


def _digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    k: int = 5,
    share: int = 20,
    max_broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size[0] or 0) + 16 * size[1] > max_broadcast_bytes:
        return _by_join(docs, items, n, k, share)
    index = docs.sparkSession.sparkContext.broadcast(Index([tuple(x) for x in items.collect()], n, k))

    def fn(texts: list[bytes | None]) -> list[tuple]:
        found = []
        for text in texts:
            words = alnum_words(text)
            n_hit, which = index.value.find(words)
            ids = {x for i in which for x in index.value.ids[i]}
            found.append((len(words), n_hit, len(ids), _digest(ids), n_hit > 0 and share * n_hit >= len(words)))
        return found

    return add_columns(docs, [docs["text"].cast("binary")], fn, RESULT)


def _by_join(docs: DataFrame, items: DataFrame, n: int, k: int, share: int) -> DataFrame:
    """The plan without a broadcast index; work is done once per distinct text, and no list of items is held per window."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text")

    def windows(columns: list[list]) -> dict:
        out: dict = {"id": [], "w": [], "m": []}
        for item, text in zip(*columns, strict=True):
            words = alnum_words(text)
            m = min(n, len(words))
            own = {b" ".join(words[i : i + m]) for i in range(len(words) - m + 1)} if m else set()
            out["id"] += [item] * len(own)
            out["w"] += own
            out["m"] += [m] * len(own)
        return out

    of_items = written(map_rows(items, windows, "id string, w binary, m int", rows=64).distinct())
    lengths = [r.m for r in of_items.filter(f"m < {n}").select("m").distinct().collect()]  # under n values

    def prints(words: list[bytes]) -> list[tuple[int, int, int]]:
        """(fingerprint, window length, position): k-grams for windows of n words, whole windows for shorter ones."""
        hashes, out = word_hashes(words), []
        for m in [*lengths, n]:
            if m <= len(hashes):
                grams = gram_hashes(hashes, m if m < n else k)
                at = winnow(grams, n - k + 1) if m == n else np.arange(len(grams))
                out += zip(grams[at].view(np.int64).tolist(), [m] * len(at), at.tolist(), strict=True)
        return out

    def item_prints(columns: list[list]) -> dict:
        found = {x[:2] for w in columns[0] for x in _prints_of_window(w.split(), n, k)}
        return {"fp": [x[0] for x in found], "m": [x[1] for x in found]}

    def doc_prints(columns: list[list]) -> dict:
        out: dict = {"doc": [], "fp": [], "m": []}
        for doc, text in zip(*columns, strict=True):
            own = {x[:2] for x in prints(alnum_words(text))}
            out["doc"] += [doc] * len(own)
            out["fp"] += [x[0] for x in own]
            out["m"] += [x[1] for x in own]
        return out

    texts = docs.select(F.col("text").cast("binary").alias("text")).filter("text is not null").distinct()
    texts = written(texts.withColumn("doc", F.sha2("text", 256)))
    known = map_rows(of_items.select("w"), item_prints, "fp long, m int").distinct()
    seeds = map_rows(texts.select("doc", "text"), doc_prints, "doc string, fp long, m int", rows=64).join(known, ["fp", "m"], "left_semi")
    seeds = seeds.groupBy("doc").agg(F.collect_list(F.struct("fp", "m")).alias("seeds"))  # as many as a text has at most

    def around(columns: list[list]) -> dict:
        out: dict = {"doc": [], "start": [], "m": [], "w": []}
        for doc, text, found in zip(*columns, strict=True):
            words, found = alnum_words(text), {(x["fp"], x["m"]) for x in found}
            starts = set()
            for fp, m, at in prints(words):
                if (fp, m) in found:
                    starts |= {(at, m)} if m < n else {(i, m) for i in range(max(0, at - n + k), min(at, len(words) - n) + 1)}
            for i, m in starts:
                out["doc"].append(doc)
                out["start"].append(i)
                out["m"].append(m)
                out["w"].append(b" ".join(words[i : i + m]))
        return out

    near = map_rows(texts.join(seeds, "doc").select("doc", "text", "seeds"), around, "doc string, start int, m int, w binary", rows=16)
    kind = [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (0, 1)]]
    classes = written(of_items.groupBy("w").agg(*kind).select("w", F.concat_ws(":", "n", "x0", "x1").alias("class")))
    hits = written(near.join(classes, "w").select("doc", "start", "m", "class"))
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("m")).alias("end"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"),
            F.greatest(a["to"], s["end"]).alias("to"),
        ),
    )["n"]
    by_doc = hits.groupBy("doc").agg(spans.alias("spans"), F.array_sort(F.collect_set("class")).alias("classes"))
    by_doc = written(by_doc.select("doc", covered.cast("long").alias("n_hit"), F.sha2(F.concat_ws(",", "classes"), 256).alias("set"), "classes"))
    sets = by_doc.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class"))
    members = classes.groupBy("class").agg(F.min("w").alias("w")).join(of_items.select("w", "id"), "w").select("class", "id")
    listed = sets.join(members, "class").select("set", "id").distinct().groupBy("set").agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    listed = listed.select("set", F.size("_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_ids"), 256).alias("items_sha256"))
    by_doc = by_doc.join(listed, "set").select(F.col("doc").alias("_doc"), "n_hit", "n_items", "items_sha256")
    plain = docs.drop(*names(RESULT))
    counted = add_columns(plain, [plain["text"].cast("binary")], lambda x: [(len(alnum_words(t)),) for t in x], "n_words long")
    out = counted.withColumn("_doc", F.sha2(F.col("text").cast("binary"), 256)).join(by_doc, "_doc", "left").drop("_doc")
    return out.withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0)),
            "n_items": F.coalesce("n_items", F.lit(0)),
            "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256)),
        }
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _prints_of_window(words: list[bytes], n: int, k: int) -> list[tuple[int, int]]:
    """(fingerprint, length) of one window: of n words the chosen k-gram, of fewer all words."""
    hashes, m = word_hashes(words), len(words)
    grams = gram_hashes(hashes, m if m < n else k)
    at = winnow(grams, n - k + 1) if m == n else np.arange(len(grams))
    return [(x, m) for x in grams[at].view(np.int64).tolist()]


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", *names(RESULT))


_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark),
i as (
  select item_id, least(13, len(ws)) as m, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) as p, ws from b where len(ws) > 0),
win as (select distinct item_id, m, ws[p : p + m - 1] as w from i),
g as (
  select r, m, p, ws[p : p + m - 1] as w from (
    select r, m, ws, unnest(generate_series(1, len(ws) - m + 1)) as p from d cross join (select distinct m from win) where len(ws) >= m)),
hit as (select r, g.m, p, item_id from g join win on g.m = win.m and g.w = win.w),
n as (select r, count(distinct q) as n_hit from (select r, unnest(generate_series(p, p + m - 1)) as q from hit) group by r),
ids as (select r, count(*) as n_items, string_agg(x, ',' order by x) as x from (select distinct r, item_id::varchar as x from hit) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(x, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join n using (r) left join ids using (r)
"""

QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES = {"op10_decontamination": ORACLE}
