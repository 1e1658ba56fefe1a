import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featurespark.llm import importance
from featurespark.llm.importance import batch_features, bucket_counts, op12_importance_resampling, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def brute(docs, targets, n, buckets, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, n)[1])
    t = Counter(bucket(f) for x in targets for f in features(x, n)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, made = features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in made)
        rows.append((i, words, len(made), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = Counter()
    ranks = {}
    for rank, r in enumerate(able[: round(100 * share) * len(able) // 100], 1):
        ranks[(r, drawn[r])] = rank
        drawn[r] += 1
    seen, out = Counter(), []
    for r in rows:
        out.append((*r, ranks.get((r, seen[r]))))
        seen[r] += 1
    return sorted(out, key=repr)


ODD = [
    (1, None), (2, ""), (3, " .,;\x00\n"), (4, "ONE Two three Été ÀB 42x a\x00b c_d"), (5, "same words here"), (5, "same words here"), (None, "no id at all"),
    (6, "long " + " ".join(f"w{i % 977}" for i in range(50_000))), (7, "one two"), (8, "two"), (9, "x" * 200_000),
]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(importance, "BATCH_BYTES", 100)  # many batches, long texts alone
    docs = ODD + [(100 + i, " ".join(f"w{(i * j) % 31}" for j in range(i % 9))) for i in range(200)]
    targets = ["one two w3 w4", None, "w5 w6 three", ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'mine' as rank", "7 as other", "doc_id as _words")
    out = resample(df.repartition(5), spark.createDataFrame([(t,) for t in targets], "text string"), 0.3, n, 97, 2)
    assert out.columns == ["doc_id", "other", "_words", "n_words", "n_features", "weight", "score", "rank"]
    got = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in out.collect()]
    assert sorted(got, key=repr) == brute(docs, targets, n, 97, 0.3, 2)


def test_no_feature_crosses_documents():
    bucket, doc, words = batch_features([b"a b", b"", None, b"c", b"A B"], 2, 1 << 31, importance._Words())
    assert words.tolist() == [2, 0, 0, 1, 2] and sorted(zip(doc.tolist(), bucket.tolist())) == sorted(
        (d, zlib.crc32(f) % (1 << 31)) for d, fs in ((0, (b"a", b"b", b"a b")), (3, (b"c",)), (4, (b"a", b"b", b"a b"))) for f in fs
    )


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(ODD, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample(docs.limit(0), docs).count() == 0 and bucket_counts(none).count() == 0
    out = resample(docs, none, 1.0, least_words=0).collect()
    assert sorted(r.rank for r in out) == list(range(1, len(ODD) + 1))


def test_query_on_all_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    targets = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [(r[0], r[2], r[3], r[4], r[5]) for r in brute(docs, targets, 1, 10_000, 0.1, 20)]
    got = [tuple(r) for r in op12_importance_resampling(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    drawn = op12_importance_resampling(spark, sf).filter("rank is not null")
    assert drawn.count() == sum(r[5] is not None for r in brute(docs, targets, 1, 10_000, 0.1, 20))
    assert drawn.agg(F.avg("weight")).first()[0] > sum(r[2] for r in want) / len(want)
