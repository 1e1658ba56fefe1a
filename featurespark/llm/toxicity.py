"""Toxicity by weak supervision (operator 8).

1. Rows to learn from. Of the labelled ids about ``max_labelled`` are drawn by hash, both labels alike as far as there
   are so many, before any text is touched. The ids are broadcast, so texts are neither shuffled nor written. What the
   draw leaves out of each label enters as its weight.
2. Voters. Tasks count, per term, in how many drawn documents of each label it occurs. Terms are words, word beginnings
   of 4 to 7 letters, and ``PATTERNS`` on the text as it stands. The seed lexicon and all terms and patterns
   indicative of label 1 say 1 where they occur, all terms with clearly less than the usual share of label 1 say 0. No term that
   passes its bound is dropped: beyond the strongest, terms of like strength are one voter. One voter says 0 on texts
   that no voter of label 1 touches. All others abstain.
3. Label model. A generative model with a class prior, the chances of each voter to vote in either class, and those of
   the given label to be 1, is fitted by expectation maximisation. In each round the correlations of the voters inside
   the classes are estimated too; a voter's evidence is divided by the sum of its correlations with all voters, so
   voters that repeat each other count once together.
4. Classifier. Logistic regression on the voters' presence, the number of words with a voter and their share, trained on
   the posteriors. It scores every whole text in one pass without a shuffle.

What reaches the driver are the terms that pass their bounds among about ``max_labelled`` texts, and as many sparse rows
of votes. Labels, lang, source and doc_id are never inputs of a score. With no labels, the seed lexicon alone votes.

Defined results: null and empty text is scored as a text without terms; duplicate label rows of a document count once,
toxic if any is; labels of unknown documents, null labels and null ids are ignored; of rows that repeat a labelled id
all count as texts with terms and one is used for the fit; all rows are scored one by one, texts of any length as a
whole; empty tables give no rows; other columns pass through unless they bear a name of the result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, drop_written, map_rows, names, written

# A small English lexicon of insults.
SEED = "idiot moron stupid loser trash scum pathetic worthless disgusting clown imbecile dumbass retard scumbag".split()
RESULT = "score double, predicted int, n_terms long"
_CLEAN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
STEMS = (4, 5, 6, 7)
#: Terms that look at the text as it stands.
PATTERNS = [
    re.compile(r"!{3,}"),
    re.compile(r"\b[A-Z]{4,}(?:\s+[A-Z]{3,}){2,}"),
    re.compile(r"\b[A-Za-z]+[*@#$%]{2,}[A-Za-z]*"),
    re.compile(rf"\b[Yy]ou(?:r|'re| are| all)?\b[^.!?\n]{{0,40}}\b(?:{'|'.join(SEED)})"),
]


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of letters and digits."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split() if text else []


def terms_of(word: bytes) -> list[str]:
    """A word and its beginnings (marked with a star)."""
    w = word.decode("utf-8", "replace")
    return [w] + [f"{w[:n]}*" for n in STEMS if len(w) > n]


def patterns_of(text: str | None) -> list[str]:
    """The patterns that match, as terms."""
    return [f"/{i}" for i, pattern in enumerate(PATTERNS) if pattern.search(text)] if text else []


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def draw(known: DataFrame, max_labelled: int) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, toxic) of about max_labelled labelled documents, and how many of label 0 and 1 each stands for.

    The draw is by a hash of the id: each label gets half, or what it has, and the other one the rest.
    """
    have = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    n = [have.get(0, 0), have.get(1, 0)]
    take = [min(n[y], max(max_labelled // 2, max_labelled - n[1 - y])) for y in (0, 1)]
    share = [take[y] / n[y] if n[y] else 1.0 for y in (0, 1)]
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, F.lit(int(share[1] * (1 << 30)))).otherwise(F.lit(int(share[0] * (1 << 30))))
    return known.filter(u < limit), (1 / share[0], 1 / share[1])


def term_counts(train: DataFrame) -> DataFrame:
    """term, n1, n0: documents of each label (column toxic) whose text has the term. Tasks count before the shuffle.

    The term of no letters counts the documents themselves.
    """

    def fn(columns: list[list]) -> dict:
        counts = (Counter(), Counter())
        for text, toxic in zip(*columns, strict=True):
            counts[toxic].update({t for w in set(words_of(text)) for t in terms_of(w)}.union(patterns_of(text)))
            counts[toxic][""] += 1
        seen = list(counts[1] | counts[0])
        return {"term": seen, "n1": [counts[1][t] for t in seen], "n0": [counts[0][t] for t in seen]}

    made = map_rows(train.select("text", "toxic"), fn, "term string, n1 long, n0 long", rows=4096)
    return made.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def choose_voters(train: DataFrame, weights: tuple[float, float], max_single: int, least_docs: int) -> tuple[dict[str, int], int, int]:
    """Voter of each term, how many voters say 1 (they come first), and how many there are, the one for untouched texts included.

    The seed votes 1 whatever its counts. A term or pattern votes 1 if a lower bound of its log odds exceeds those of
    the label against it (by weight), and 1.2 at least; it votes 0 if an upper bound of the share of label 1 among its
    documents is under half of that share among all. Of forms that begin alike and are counted alike only the longest is
    kept, as they are the same vote. The max_single strongest terms for 1 are voters of their own; all others vote too, those
    of about the same strength as one voter.
    """
    counts = written(term_counts(train))
    n1, n0 = (counts.filter("term = ''").select("n1", "n0").first() or (0, 0))[:2]
    ones = {t: i for i, t in enumerate(SEED)}
    zeros: dict[str, int] = {}
    n_ones = len(ones)
    if n1 and n0:
        z, (w0, w1) = 2.33, weights
        terms = counts.filter("term <> ''")
        odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
        odds = odds - z * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
        found = terms.filter(F.col("n1") >= least_docs).withColumn("odds", odds).filter(F.col("odds") > max(1.2, float(np.log(n0 * w0 / (n1 * w1)))))
        rows = _longest(found)
        for r in rows[:max_single]:
            if r.term not in ones:
                ones[r.term], n_ones = n_ones, n_ones + 1
        n_ones = _banded([r for r in rows[max_single:] if r.term not in ones], ones, n_ones)
        n, base = F.col("n1") + F.col("n0"), n1 * w1 / (n1 * w1 + n0 * w0)
        share = F.col("n1") * w1 / (F.col("n1") * w1 + F.col("n0") * w0)
        upper = (share + z * z / (2 * n) + z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        found = terms.filter(F.col("n0") >= least_docs).withColumn("odds", F.log(F.lit(float(base)) / upper)).filter(F.col("odds") > float(np.log(2.0)))
        rows = [r for r in _longest(found) if r.term not in ones]
    else:
        rows = []
    drop_written(counts)
    n_all = _banded(rows, zeros, n_ones)
    return ones | zeros, n_ones, n_all + 1


def _longest(found: DataFrame) -> list:
    """term, odds of the longest of forms that begin alike and are counted alike, the strongest first."""
    longest = F.max_by("term", F.struct(F.length("term"), "term")).alias("term")
    found = found.groupBy(F.substring("term", 1, STEMS[0]).alias("start"), "n1", "n0").agg(longest, F.max("odds").alias("odds"))
    return sorted(found.select("term", "odds").collect(), key=lambda r: (-r.odds, r.term))


def _banded(rows: list, voters: dict[str, int], first: int) -> int:
    """Gives terms of the same half of log odds one voter, numbered from ``first``; returns the next number."""
    bands: dict[int, int] = {}
    for r in rows:
        voters[r.term] = bands.setdefault(int(2 * r.odds), first + len(bands))
    return first + len(bands)


class Voting:
    """Which voters a text has: those for 1, those for 0, and the one for untouched texts.

    A word's voters are looked up once and remembered, within a bound.
    """

    def __init__(self, index: dict[str, int], n_ones: int, n: int):
        self.index, self.n_ones, self.n = index, n_ones, n
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[list[int], int, int]:
        """Voters that vote, how many words have one for 1, and the number of words."""
        words, known, n = words_of(text), self.known, 0
        found = {self.index[t] for t in patterns_of(text) if t in self.index}
        if len(known) > 400_000:
            known.clear()
        for w in words:
            got = known.get(w)
            if got is None:
                got = known[w] = tuple(sorted({self.index[t] for t in terms_of(w) if t in self.index}))
            if got:
                found.update(got)
                n += got[0] < self.n_ones
        if not found or min(found) >= self.n_ones:
            found.add(self.n - 1)
        return sorted(found), n, len(words)


def discounts(fires: np.ndarray, weight: np.ndarray, p: np.ndarray, noise: float) -> np.ndarray:
    """One over the sum of each voter's correlations with all voters (its own, 1, included) inside the classes.

    fires: rows x voters, 0 or 1; p: chance of label 1 per row. Correlations up to ``noise`` count as none.
    """
    cov = np.zeros((fires.shape[1],) * 2)
    for q in (weight * p, weight * (1 - p)):
        mean = q @ fires / max(q.sum(), 1e-9)
        cov += (fires * q[:, None]).T @ fires - q.sum() * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = cov / np.outer(scale, scale)
    np.fill_diagonal(corr, 0.0)
    return 1 / (1 + np.where(corr > noise, corr, 0.0).sum(axis=1))


def posteriors(fires: np.ndarray, labels: np.ndarray, weight: np.ndarray, noise: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Chance of label 1 per row under the generative model, fitted by expectation maximisation from the labels.

    The given label is a voter of its own that is right in nine of ten cases to begin with, and whose accuracy is
    estimated as the others' are; its start counts as much as ten rows of each class.
    """
    p = np.where(labels == 1, 0.9, 0.1)
    for _ in range(rounds):
        q1, q0 = weight * p, weight * (1 - p)
        prior = np.clip(q1.sum() / weight.sum(), 1e-4, 1 - 1e-4)
        on1, on0 = (q1 @ fires + 0.5) / (q1.sum() + 1.0), (q0 @ fires + 0.5) / (q0.sum() + 1.0)
        right1, wrong0 = (q1 @ labels + 9.0) / (q1.sum() + 10.0), (q0 @ labels + 1.0) / (q0.sum() + 10.0)
        own = discounts(fires, weight, p, noise)
        logit = np.log(prior / (1 - prior)) + fires @ (own * np.log(on1 / on0)) + (1 - fires) @ (own * np.log((1 - on1) / (1 - on0)))
        logit += np.where(labels == 1, np.log(right1 / wrong0), np.log((1 - right1) / (1 - wrong0)))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            return new
        p = new
    return p


def features(found: list[tuple[list[int], int, int]], n: int) -> np.ndarray:
    """Presence of each voter, two measures of how many words have one for 1, and a constant."""
    x = np.zeros((len(found), n + 3), np.float32)
    for row, (which, hits, words) in zip(x, found, strict=True):
        row[which] = 1.0
        row[n] = np.log1p(hits)
        row[n + 1] = min(1.0, 20.0 * hits / max(words, 1))
        row[n + 2] = 1.0
    return x


def logistic(x: np.ndarray, p: np.ndarray, count: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of logistic regression on soft labels of rows that occur ``count`` times; the rarer class gains half of what equal
    weight would give it."""
    x = x.astype(np.float64)
    share = np.clip(count @ p / count.sum(), 0.02, 0.98)
    one, zero = count * p * np.sqrt(1 - share), count * (1 - p) * np.sqrt(share)
    weight = one + zero
    penal = np.full(x.shape[1], ridge)
    penal[-1] = 1e-6
    cost = lambda w: weight @ np.logaddexp(0, x @ w) - one @ (x @ w) + penal @ w**2 / 2
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps, halved until the cost falls
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(penal), x.T @ (weight * q - one) + penal * w)
        size, now = 1.0, cost(w)
        while size > 1e-6 and cost(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def fit(train: DataFrame, weights: tuple[float, float], max_single: int, least_docs: int, noise: float) -> tuple[Voting, np.ndarray]:
    """Voters and classifier weights from rows (doc_id, text, toxic)."""
    voting = Voting(*choose_voters(train, weights, max_single, least_docs))

    def fn(columns: list[list]) -> dict:
        found = [voting(t) for t in columns[0]]
        return {"which": [f[0] for f in found], "hits": [f[1] for f in found], "words": [f[2] for f in found], "toxic": columns[1], "doc_id": columns[2]}

    kind = train.schema["doc_id"].dataType.simpleString()
    rows = map_rows(train.select("text", "toxic", "doc_id"), fn, f"which array<int>, hits int, words int, toxic int, doc_id {kind}")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("which", "hits", "words", "toxic")).alias("r")).select("r.*")
    same = Counter((tuple(r.which), r.hits, r.words if r.hits else 1, r.toxic) for r in rows.toLocalIterator())
    labels = np.array([k[3] for k in same], int)
    if not len(labels) or labels.max() == 0:
        w = np.zeros(voting.n + 3)
        w[: len(SEED)], w[-1] = 4.0, -3.0
        return voting, w
    x = features([(list(k[0]), k[1], k[2]) for k in same], voting.n)
    count = np.array(list(same.values()), float)
    p = posteriors(x[:, : voting.n], labels, count * np.where(labels == 1, weights[1], weights[0]), noise)
    return voting, logistic(x, p, count)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train_on=None,
    max_single: int = 500,
    least_docs: int = 3,
    max_labelled: int = 30_000,
    noise: float = 0.1,
) -> DataFrame:
    """docs with score, predicted (score of 0.5 or more) and n_terms; train_on is the condition for training rows."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
    known = known.agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text")
    if train_on is not None:
        known = known.filter(train_on)
    drawn, weights = draw(known, max_labelled)
    drawn = written(drawn)
    voting, w = fit(rows.join(F.broadcast(drawn), "doc_id"), weights, max_single, least_docs, noise)
    drop_written(drawn)

    def fn(texts: list[str | None]) -> list[tuple]:
        found = [voting(t) for t in texts]
        score = 1 / (1 + np.exp(-np.clip(features(found, voting.n) @ w, -30, 30)))
        return [(float(s), int(s >= 0.5), sum(i < voting.n_ones for i in f[0])) for s, f in zip(score, found, strict=True)]

    return add_columns(docs, [docs["text"]], fn, RESULT)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels whose document is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_toxicity(docs, labels, ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *names(RESULT))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
