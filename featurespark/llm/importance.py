"""Importance resampling towards a target distribution of hashed n-grams (operator 12).

Each feature (a run of 1 to ``n`` consecutive words, joined by one space) falls into one of ``buckets`` by its crc32. The
gain of a bucket is the log ratio of its smoothed shares in the target texts and in all documents; a document's weight is
the sum of the gains of its features, its score the weight and a Gumbel draw from a hash of its id, so that the highest
scores are a sample without replacement, the same on any partitioning.

Counting: a batch's texts are joined with a separator that no word holds, one pass of a regular expression finds all words
of the batch, ``searchsorted`` on the documents' offsets tells the document of each word, a run whose ends lie in two
documents is masked, and ``bincount`` adds up buckets or gains. Each task brings one count for each bucket that it met, so
that what is shuffled doesn't grow with a task's rows; a table of one gain a bucket is all that is broadcast. Ranks are
numbered in ranges of the scores.

Defined results: null text has no words; documents without features weigh 0; a null id draws like an empty one and is the
smallest of equal scores; repeated rows are ranked one by one; other columns pass ``resample`` unless they bear a name of
its result. With empty targets or documents the smoothed shares are all equal.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurespark.ship import ship
from featurespark.sources.tables import with_row_index

from .common import add_columns, names, scratch, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEPARATOR = b"\x00"  # part of no word
BATCH_BYTES = 4 << 20  # texts are joined up to about this size; a longer text is a batch of its own
RESULT = "n_words long, n_features long, weight long"
RANKED = "score long, rank long"


class _Words(dict):
    """crc32 of words, each computed once; emptied when it has grown large, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = crc = zlib.crc32(word)
        return crc


def batch_features(texts: list[bytes | None], n: int, buckets: int, known: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of each feature of a batch of texts, and the number of words of each document."""
    text = SEPARATOR.join([t or b"" for t in texts]).translate(_LOWER)
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    offsets = np.cumsum(sizes + 1) - (sizes + 1)
    words, starts = [], []
    for found in WORD.finditer(text):
        words.append(found[0])
        starts.append(found.start())
    doc = np.searchsorted(offsets, np.array(starts, np.int64), "right") - 1
    crc = [known[w] for w in words]
    made, of = [np.array(crc, np.int64) % buckets], [doc]
    for m in range(2, n + 1):
        crc = [zlib.crc32(b" " + w, c) for c, w in zip(crc, words[m - 1 :])]
        inside = doc[: len(crc)] == doc[m - 1 :]  # runs over a border are masked
        made.append(np.array(crc, np.int64)[inside] % buckets)
        of.append(doc[: len(crc)][inside])
    return np.concatenate(made), np.concatenate(of), np.bincount(doc, minlength=len(texts))


def _batches(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_BYTES."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or b"") > BATCH_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t or b"")
    if start < len(texts):
        yield start, len(texts)


def bucket_counts(df: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many features of all texts fall into it; buckets without any are left out."""
    ship(df.sparkSession)
    kind = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros(buckets, np.int64), _Words()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _batches(texts):
                total += np.bincount(batch_features(texts[a:b], n, buckets, known)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], schema=kind)

    parts = df.select(F.col("text").cast("binary").alias("text")).mapInArrow(over, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of every bucket, from the counts of documents and targets."""
    spark = documents.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(documents.select("bucket", F.col("n").alias("s")), "bucket", "left").join(targets.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    x = (F.col("t") + 1.0) * (F.col("all_s") + buckets) / ((F.col("s") + 1.0) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(x)).alias("gain"))


def weigh(docs: DataFrame, table: list[int], n: int = 1) -> DataFrame:
    """docs with n_words, n_features and weight, by a list of one gain a bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(table, np.int64))
    buckets = len(table)

    def fn(texts: list[bytes | None]) -> list[tuple]:
        out, known, gain = [], fn.known, shared.value
        for a, b in _batches(texts):
            bucket, doc, words = batch_features(texts[a:b], n, buckets, known)
            # sums of whole numbers in doubles are exact below 2**53
            weight = np.bincount(doc, gain[bucket].astype(np.float64), b - a).astype(np.int64)
            out += zip(words.tolist(), np.bincount(doc, minlength=b - a).tolist(), weight.tolist(), strict=True)
        return out

    fn.known = _Words()
    return add_columns(docs, [docs["text"].cast("binary")], fn, RESULT, rows=1024, drop=("text",))


def resample(docs: DataFrame, targets: DataFrame, share: float = 0.1, n: int = 1, buckets: int = 10_000, least_words: int = 20, seed: str = "2024", id_col: str = "doc_id") -> DataFrame:
    """docs without their texts, with n_words, n_features, weight, score and, if drawn, rank.

    Of the documents of least_words or more the share with the highest scores is drawn; equal scores go to smaller ids.
    """
    with scratch() as tables:
        own = gains(bucket_counts(docs, n, buckets), bucket_counts(targets, n, buckets), buckets)
        table = [0] * buckets
        for row in own.collect():  # one row a bucket
            table[row.bucket] = row.gain
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
        scored = weigh(docs.drop(*names(RANKED)), table, n).withColumn("score", F.col("weight") + draw)
        scored = written(scored.withColumns({"_out": F.col("n_words") < least_words, "_down": -F.col("score")}))
        drawn = int(scored.filter("not _out").count() * round(share * 100) // 100)
        numbered = with_row_index(scored, ["_out", "_down", id_col], start=1, name="rank")
        out = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("_out", "_down")
        return tables.keep(written(out))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all documents, towards the benchmark's texts."""
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = resample(docs.select("doc_id", "text"), target)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of a string w by its polynomial's table ``tab``, as a DuckDB expression; CRC_TABLE makes that table.
CRC_TABLE = "select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) order by i) as tab from range(256) r(i)"


def crc_sql(w: str) -> str:
    octets = f"list_transform(range(octet_length(encode({w}))), lambda k: ('0x' || substr(hex(encode({w})), 2 * k + 1, 2))::bigint)"
    return f"xor(4294967295, list_reduce([4294967295::bigint] || {octets}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


_SQL_WORDS = (
    "unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''))"
)
ORACLE = f"""
with tab as ({CRC_TABLE}),
d as (select doc_id, row_number() over () as r, text from documents),
dw as (select r, {_SQL_WORDS} as w from d),
bw as (select {_SQL_WORDS} as w from benchmark),
crc as (select w, {crc_sql("w")} % 10000 as b from (select w from dw union select w from bw), tab),
s as (select b, count(*) as s from dw join crc using (w) group by b),
t as (select b, count(*) as t from bw join crc using (w) group by b),
g as (
  select b, floor(1000 * ln((coalesce(t.t, 0) + 1)::double * (n.s + 10000) / ((coalesce(s.s, 0) + 1)::double * (n.t + 10000))))::bigint as gain
  from (select unnest(range(10000)) as b) left join s using (b) left join t using (b),
    (select (select count(*) from dw) as s, (select count(*) from bw) as t) n),
x as (select r, count(*) as n_features, sum(gain) as weight from dw join crc using (w) join g using (b) group by r),
y as (
  select d.r, doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double))))::bigint as score
  from d left join x using (r)),
o as (select r, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from y where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from y left join o using (r)
"""

QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLES = {"op12_importance_resampling": ORACLE}
