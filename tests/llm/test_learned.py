import math
import zlib
from collections import Counter

import numpy as np
import pytest

from featurespark.llm.language import KneserNey, count_grams, grams, identify, normal, op1_language_id
from featurespark.llm.toxicity import discounts, draw, logistic, op8_toxicity, posteriors, score_toxicity


def test_counts_equal_brute_force(spark):
    rows = [("Ab ab, ÀB!", "x"), ("b1a", "x"), (None, "x"), ("..", "y"), ("𐐀a", "y")]
    got = {(r.lang, r.gram & (2**64 - 1)): r.n for r in count_grams(spark.createDataFrame(rows, "text string, lang string")).collect()}
    want = Counter()
    for text, lang in rows:
        if (u := normal(text)) is not None:
            want.update((lang, int(g)) for g in grams(u))
    assert got == dict(want)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    units = rng.integers(97, 103, 4000).astype(np.uint16)
    keys, n = np.unique(grams(units), return_counts=True)
    other, m = np.unique(grams(units[:500]), return_counts=True)
    model = KneserNey({"a": (keys, n), "b": (other, m)})
    letters = np.append(np.unique(units), 900).astype(np.uint64)  # and one that no language has
    for context in ([97, 98, 99], [102, 102, 97], [97, 97, 120], [500, 500, 500]):
        base = sum(np.uint64(c) << np.uint64(16 * (3 - i)) for i, c in enumerate(context))
        total = np.exp(model.log_probs(base | letters)).sum(axis=0)
        assert np.allclose(total, 1, atol=1e-3)
    seen = np.exp(model.log_probs(keys))
    assert (seen[:, 0] > 0).all() and np.isfinite(np.log(seen)).all()


def test_language_of_held_out_documents(spark, sf):
    rows = op1_language_id(spark, sf).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(langs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "12 !?", "en"), (3, "the thing that", "en"), (4, "les eaux que", "fr"), (5, "QUE LES", None), (3, "the thing that", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as rejected")
    got = {r.doc_id: r for r in identify(df).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "en", "fr", "fr"]
    assert got[1].score == 0 and got[1].rejected and 0 < got[3].score <= 1
    none = identify(df.filter("lang is null")).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert identify(df.limit(0)).count() == 0


def plain_kneser_ney(texts, vocabulary):
    """Probability of a unit given the three before it, in dictionaries."""
    counts = {4: Counter(), 3: Counter(), 2: Counter(), 1: Counter()}
    for t in texts:
        u = tuple(normal(t).tolist())
        counts[4].update(u[i : i + 4] for i in range(len(u) - 3))
    for k in (3, 2, 1):
        counts[k].update(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        n1, n2 = (sum(n == m for n in c.values()) for m in (1, 2))
        discount[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    total, kinds = {k: Counter() for k in counts}, {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / (1 + vocabulary)
        k, context = len(g), g[:-1]
        if not total[k][context]:
            return p(g[1:])
        rest = discount[k] * kinds[k][context] / total[k][context] * p(g[1:])
        return (max(counts[k][g] - discount[k], 0) if counts[k][g] else 0) / total[k][context] + rest

    return p


def test_query_equals_plain_kneser_ney(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "lang", "pmod(xxhash64(text), 10) = 0 as kept").collect()
    got = {r.doc_id: r for r in op1_language_id(spark, sf).collect()}
    train = {}
    for d in docs:
        if not got[d.doc_id].held_out and d.lang and not d.kept and normal(d.text) is not None:
            train.setdefault(d.lang, []).append(d.text)
    vocabulary = len({u for texts in train.values() for t in texts for u in normal(t).tolist()[3:]})
    models = {x: plain_kneser_ney(texts, vocabulary) for x, texts in train.items()}
    for d in [d for d in docs if normal(d.text) is not None][:40]:
        u = tuple(normal(d.text).tolist())
        entropy = {x: -np.mean([math.log(p(u[i : i + 4])) for i in range(len(u) - 3)]) for x, p in models.items()}
        best = min(entropy, key=entropy.get)
        assert got[d.doc_id].lang_pred == best and abs(got[d.doc_id].cross_entropy - entropy[best]) < 1e-4


def test_models_grow_with_what_occurs():
    """A language's tables hold its own n-grams only, whatever other languages have; a stranger gets the floor."""
    own = {x: np.unique(grams(normal(t)), return_counts=True) for x, t in (("a", "abab abba baab"), ("b", "xyz zyx " * 30), ("c", "\u03b1\u03b2\u03b3 \u03b4\u03b5"))}
    model = KneserNey(own)
    for i, (x, (keys, n)) in enumerate(sorted(own.items())):
        alone = KneserNey({x: (keys, n)})
        sizes = [len(t.hashes) for t in model.models[i].probs.values()]
        assert sizes == [len(t.hashes) for t in alone.models[0].probs.values()] and sizes[-1] == len(keys)
    strange = grams(normal("\u05d0\u05d1\u05d2\u05d3\u05d4"))[3:4]
    assert np.isfinite(model.log_probs(strange)).all()
    assert [model.score([t])[0][0] for t in ("abba", "zyx", "\u03b4\u03b5", "?", None)] == ["a", "b", "c", "und", "und"]


def plain_posteriors(fires, labels, weight, noise, rounds):
    """The label model in plain loops."""
    n, m = len(fires), len(fires[0])
    p = [0.9 if y else 0.1 for y in labels]
    for _ in range(rounds):
        q = [[w * x for w, x in zip(weight, p)], [w * (1 - x) for w, x in zip(weight, p)]]
        total = [sum(c) for c in q]
        on = [[(sum(c[i] * fires[i][j] for i in range(n)) + 0.5) / (t + 1) for j in range(m)] for c, t in zip(q, total)]
        mean = [[sum(c[i] * fires[i][j] for i in range(n)) / t for j in range(m)] for c, t in zip(q, total)]
        cov = [[sum(c[i] * (fires[i][j] - e[j]) * (fires[i][k] - e[k]) for c, e in zip(q, mean) for i in range(n)) for k in range(m)] for j in range(m)]
        own = []
        for j in range(m):
            corr = [cov[j][k] / math.sqrt(cov[j][j] * cov[k][k]) for k in range(m) if k != j]
            own.append(1 / (1 + sum(c for c in corr if c > noise)))
        right1 = (sum(c * y for c, y in zip(q[0], labels)) + 9) / (total[0] + 10)
        wrong0 = (sum(c * y for c, y in zip(q[1], labels)) + 1) / (total[1] + 10)
        prior = total[0] / sum(weight)
        p = []
        for i in range(n):
            z = math.log(prior / (1 - prior)) + math.log(right1 / wrong0 if labels[i] else (1 - right1) / (1 - wrong0))
            for j in range(m):
                z += own[j] * math.log(on[0][j] / on[1][j] if fires[i][j] else (1 - on[0][j]) / (1 - on[1][j]))
            p.append(1 / (1 + math.exp(-z)))
    return p


@pytest.mark.parametrize("share", [0.2, 0.8])
def test_label_model_equals_brute_force(share):
    rng = np.random.default_rng(5)
    y = (rng.random(300) < share).astype(int)
    fire = lambda hit, false: np.where(y == 1, rng.random(300) < hit, rng.random(300) < false).astype(float)
    a, b, c = fire(0.7, 0.02), fire(0.6, 0.05), fire(0.3, 0.1)
    fires = np.stack([a, b, c, c, c, fire(0.1, 0.6)], axis=1)
    noisy = np.where(rng.random(300) < 0.05, 1 - y, y)
    weight = np.where(noisy == 1, 1.0, 2.5)
    for rounds in (1, 3):
        got = posteriors(fires, noisy, weight, 0.1, rounds)
        assert np.allclose(got, plain_posteriors(fires.tolist(), noisy.tolist(), weight.tolist(), 0.1, rounds), atol=1e-9)
    p = posteriors(fires, noisy, np.ones(300))
    assert abs(p.mean() - share) < 0.08 and ((p > 0.5) == y).mean() > 0.95
    own = discounts(fires, np.ones(300), y.astype(float), 0.1)
    assert np.allclose(own[2:5], 1 / 3, atol=0.05) and (own[:2] > 0.7).all()
    w = logistic(np.hstack([fires, np.ones((300, 1))]), p, np.ones(300))
    assert (w[:2] > 0.5).all() and w[5] < 0


@pytest.fixture(scope="module")
def toxic_rows():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)]
        bad = i % 9 == 0
        if bad:
            words[int(rng.integers(60))] = ["idiot", "zorgvex", "ZORGVUM!", "plaxid"][int(rng.integers(4))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxic_documents_are_found(spark, toxic_rows):
    rows, labels = toxic_rows
    df = spark.createDataFrame([*rows, (5000, None), (5001, ""), (0, rows[0][1])], "doc_id long, text string").selectExpr("*", "7 as score", "8 as other")
    lab = spark.createDataFrame([*labels, (0, 1), (None, 1), (77777, 1), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in score_toxicity(df, lab).collect()}
    truth = dict(labels)
    assert all(out[i].predicted == 0 for i in truth if not truth[i])
    assert np.mean([out[i].predicted for i in truth if truth[i]]) > 0.95
    assert out[5000].predicted == 0 and out[5001].score == out[5000].score and out[5000].other == 8
    bare = score_toxicity(spark.createDataFrame([(1, "you IDIOT"), (2, "fine")], "doc_id long, text string"), lab.limit(0)).collect()
    assert {r.doc_id: r.predicted for r in bare} == {1: 1, 2: 0}
    assert score_toxicity(df.limit(0), lab).count() == 0


def test_toxicity_query(spark, sf):
    rows = op8_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([p == y for p, y in held]) > 0.98


def test_labelled_rows_are_drawn_by_hash_within_a_bound(spark, toxic_rows):
    known = spark.createDataFrame(toxic_rows[1], "doc_id long, toxic int")
    drawn, weights = draw(known, 300)
    n = Counter(r.toxic for r in drawn.collect())
    assert n[1] == 100 and 150 < n[0] < 250 and weights == (4.0, 1.0)
    assert sorted(drawn.collect()) == sorted(draw(known.repartition(3), 300)[0].collect())
    df = spark.createDataFrame(toxic_rows[0], "doc_id long, text string")
    out = {r.doc_id: r.predicted for r in score_toxicity(df, known, max_labelled=300).collect()}
    assert np.mean([out[i] == y for i, y in toxic_rows[1]]) > 0.97


def test_very_long_text_is_scored_whole(spark, toxic_rows):
    rows = [(0, "word " * 300_000 + "idiot pathetic"), (1, "word " * 300_000)]
    df = spark.createDataFrame([*rows, *[(i + 10, t) for i, t in toxic_rows[0]]], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 10, y) for i, y in toxic_rows[1]], "doc_id long, toxic int")
    assert [r.n_terms > 0 for r in score_toxicity(df, labels).filter("doc_id < 2").orderBy("doc_id").collect()] == [True, False]
