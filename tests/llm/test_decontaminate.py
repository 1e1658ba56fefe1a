import hashlib
import re

import pytest

from featurespark.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(docs, items, n=13):
    out = []
    split = [(i, WORD.findall(low(t or ""))) for i, t in items]
    for doc_id, text in docs:
        words = WORD.findall(low(text or ""))
        hit, ids = set(), set()
        for i, item in split:
            m = min(n, len(item))
            windows = {tuple(item[j : j + m]) for j in range(len(item) - m + 1)} if item else set()
            for p in range(len(words) - m + 1):
                if m and tuple(words[p : p + m]) in windows:
                    hit.update(range(p, p + m))
                    ids.add("null" if i is None else str(i))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def made(rng):
    some = ["a", "B", "Ç", "d1", "e", "É"]
    items = [(i, " ".join(rng.choices(some, k=rng.choice([0, 1, 3, 12, 13, 14, 30])))) for i in range(20)]
    items += [(90, items[3][1]), (3, items[3][1]), (None, " ".join(rng.choices(some, k=15))), (91, None), (92, "!?")]
    docs = []
    for i in range(60):
        words = rng.choices([*some, "x", "y"], k=rng.choice([0, 2, 13, 40, 200]))
        for _, t in rng.sample(items, 2):
            part = (t or "").split()
            a = rng.randrange(len(part) + 1)
            b = rng.randrange(len(words) + 1)
            words[b:b] = part[a : a + rng.choice([5, 12, 13, 30])]
        docs.append((i, rng.choice([" ", "\n", "--"]).join(words)))
    return docs + [docs[5], (500, None), (None, "a b"), (501, ""), (502, "x " * 30000 + items[7][1])], items


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("short", [True, False])
def test_equals_brute_force_with_and_without_broadcast(spark, rng, limit, short):
    docs, items = made(rng)
    if not short:
        items = [x for x in items if len(WORD.findall(x[1] or "")) >= 13]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "id").selectExpr(
        "id doc_id", "text", "'x' as n_hit", "'y' as item"
    )
    got = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), max_broadcast_bytes=limit)
    rows = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted([tuple(r) for r in rows], key=repr) == brute(docs, items)
    assert {r.item for r in got.collect()} == {"y"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).first().n_items == 0
    assert decontaminate(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_columns_doc_and_ids_pass(spark, limit):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text, "x", "y"), (2, "a b", "x", "y")], "doc_id long, text string, doc string, ids string")
    got = decontaminate(docs, spark.createDataFrame([(7, text)], "item_id long, text string"), max_broadcast_bytes=limit)
    assert sorted((r.doc_id, r.doc, r.ids, r.n_hit, r.n_items) for r in got.collect()) == [(1, "x", "y", 20, 1), (2, "x", "y", 0, 0)]


def test_common_passage_stays_linear(spark):
    """A passage in all documents and many items: windows met per document don't grow with the number of items."""
    passage = " ".join(f"p{i}" for i in range(20))
    items = [(i, f"{passage} only{i} " + " ".join(f"i{i}w{j}" for j in range(12))) for i in range(300)]
    docs = [(i, f"d{i} " * 5 + passage) for i in range(10_000)]
    docs.append((10_000, " ".join(items[7][1].split()[5:])))
    df, other = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(df, other, max_broadcast_bytes=0).collect()}
    digest = hashlib.sha256(",".join(sorted(str(i) for i in range(300))).encode()).hexdigest()
    assert len(got) == 10_001
    assert all((got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (25, 20, 300, digest) for i in range(10_000))
    assert (got[10_000].n_hit, got[10_000].n_items) == (28, 300)
