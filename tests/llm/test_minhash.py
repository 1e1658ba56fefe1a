import re

import numpy as np

from featurespark.llm import bloom, minhash
from featurespark.llm.graph import components
from featurespark.llm.minhash import MinMax, drop_near_duplicates, least_agreeing, near_duplicates, op3_minhash_dedup, shape

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sets(docs, k):
    out = []
    for doc_id, text in docs:
        w = WORD.findall(low(text or ""))
        out.append((doc_id, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    return out


def brute(docs, k, percent):
    all_sets = sets(docs, k)
    up = {i: i for i, _ in all_sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for n, (i, s) in enumerate(all_sets):
        for m in {m for x in s for m in by.get(x, ())}:
            j, t = all_sets[m]
            both = len(s & t)
            if 100 * both >= percent * len(s | t):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for x in s:
            by.setdefault(x, []).append(n)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in all_sets)


def test_shapes_and_estimates():
    assert shape(0.85, 120, 1e-6) == (24, 5)
    assert shape(0.8, 120, 1e-6) == (30, 4)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    got = [(m(x[:800]) == m(x[200:])).mean() for m in (MinMax(200, s) for s in range(20))]
    assert abs(np.mean(got) - 0.6) < 0.03


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op3_minhash_dedup(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(docs, 3, 85)


def test_large_group_of_near_copies_loses_no_link(spark, rng):
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((i + 1, " ".join(words)))
    docs += [(1000 + i, docs[7][1].upper()) for i in range(40)] + [(0, docs[11][1])]
    docs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "é one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "'z' as kept")
    for k, percent in ((3, 85), (5, 80)):
        rows = near_duplicates(df.repartition(5), k=k, percent=percent).collect()
        assert sorted(map(tuple, rows)) == brute(docs, k, percent)
    left = drop_near_duplicates(df.union(df.limit(9)), k=3, percent=85)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i, _, _, kept in brute(docs, 3, 85) if kept]


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "q")], "doc_id long, text string")
    rows = sorted(map(tuple, near_duplicates(df, k=3).collect()), key=repr)
    assert rows == [(5, 2, 5, True), (None, 1, None, False), (None, 2, 5, False)]
    assert near_duplicates(df.limit(0)).count() == 0
    more = df.union(spark.createDataFrame([(5, "other text here"), (5, "a b c d"), (None, None), (7, "")], df.schema))
    kept = sorted(map(tuple, drop_near_duplicates(more, k=3).collect()), key=repr)
    assert [t for _, t in kept].count("a b c d") == 1 and len(kept) == 5
    assert {t for _, t in kept} == {"a b c d", "q", "other text here", None, ""}
    assert drop_near_duplicates(more.limit(0)).count() == 0


def test_ids_too_many_to_broadcast_give_the_same_rows(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = sorted(r.doc_id for r in drop_near_duplicates(docs).collect())
    monkeypatch.setattr(minhash, "FOLLOWERS", 2)
    monkeypatch.setattr(bloom, "MOST_WORDS", 64)  # full of bits: nearly all rows are in doubt
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == few
    assert few == [i for i, _, _, kept in brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if kept]


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, "a b c d e"), (5, "v w x y z"), (6, "V w x y z"), (4, "a b c d e f"), (9, "q r s")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=80).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(4, 4), (5, 4), (6, 4), (9, 9)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_cells_are_cut_by_members_and_by_weight(spark, rng, monkeypatch):
    """A group of near copies in one bucket, dealt into many cells either way, loses no link."""
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((i + 1, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name, value in (("BLOCK", 8), ("HEAVY", 2000)):
        with monkeypatch.context() as m:
            m.setattr(minhash, name, value)
            assert sorted(map(tuple, near_duplicates(df, k=3, percent=85).collect())) == brute(docs, 3, 85)


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2])]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 1), (3, 3)]


def test_recall_of_searched_documents(spark, sf):
    """Ids divisible by 100 against all rows: the share of their exact links that end in the same component."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    component = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=85).collect()}
    everything = [(i, s) for i, s in sets(docs, 3) if s]
    linked = [(i, j) for i, s in everything if i % 100 == 0 for j, t in everything if i != j and 100 * len(s & t) >= 85 * len(s | t)]
    assert linked and all(component[i] == component[j] for i, j in linked)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 98), (7, 7), (None, 3)], "a long, b long")
    got = {tuple(r) for r in components(links).collect()}
    assert got == {(i, 0) for i in range(41)} | {(98, 98), (99, 98)}


def test_pair_of_unlike_signatures_is_found(spark):
    """92 of 108 words are common (0.852), but only 85 of 120 signature values agree."""
    words = [f"w8933x{i}" for i in range(108)]
    docs = [(1, " ".join(words[:100])), (2, " ".join(words[:92] + words[100:]))]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=1, percent=85).collect()
    assert sorted(map(tuple, rows)) == brute(docs, 1, 85)
    assert [r.component_id for r in rows] == [1, 1]


def test_signatures_miss_no_more_than_stated():
    for percent, values, least in ((85, 120, 81), (80, 120, 73), (85, 256, 188), (80, 256, 172)):
        assert least_agreeing(percent / 100, values, 1e-6) == least
        agree = np.random.default_rng(4).binomial(values, percent / 100, 10**6)
        assert (agree < least).sum() <= 5
