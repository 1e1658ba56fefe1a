"""Language identification by interpolated Kneser-Ney character models (operator 1).

1. Tasks count 4-grams of normalised characters (lower-case letters, any other run a space) of all training rows, by
   language, and combine them before the shuffle; Spark adds them up. The counts cover the whole training data.
2. Per language a Kneser-Ney model of order 4 interpolates absolute-discounted counts with continuation counts of the
   lower orders. For each language and order the n-grams are an array of 64-bit hashes in sorted order (the hash is a
   bijection, so there are no collisions) beside their interpolated probabilities; back-off weights of contexts likewise.
   Texts are scored in batches, each distinct n-gram of a batch by one binary search a language.
3. Each text takes the language of the lowest cross-entropy per character.
4. Rejection is calibrated on a tenth of the training rows, by a hash of the text, that is kept out of the counts: per
   language the mean of their cross-entropies and their deviation for unit length; a text whose standardised excess lies
   beyond the quantile ``1 - reject`` is marked ``rejected``. A language that has no other rows is learned from these.

All n-grams are kept: discounts, continuation counts and totals are those of the whole counts. The model holds one row
per pair of n-gram and language that occurs, so it grows with each language's distinct 4-grams of letters, which level off
as its spellings are exhausted, and not with the number of languages times those of all; nothing else reaches driver and
tasks.

Defined results: a text that is null or has no letter gets ``und`` with score 0; with no training rows all get ``und``;
texts of any length are counted and scored as a whole; an empty table gives no rows; repeated rows repeat; rows are scored one by one; ties go to the language first in order; other columns pass through unless they bear a name
of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurespark.ship import ship

from .common import add_columns, drop_written, mix64, names, written
from .toxicity import held_out

ORDER = 4
RESULT = "lang_pred string, score double, cross_entropy double, n_letters_scored long"
_LETTERS = re.compile(r"[^\W\d_]+")


def normal(text: str | None) -> np.ndarray | None:
    """UTF-16 units of the padded, lower-cased letters; None without a letter."""
    joined = " ".join(_LETTERS.findall(text.lower())) if text else ""
    if not any(map(str.isalpha, joined)):
        return None
    return np.frombuffer(f"   {joined} ".encode("utf-16-le", "surrogatepass"), np.uint16)


def grams(units: np.ndarray) -> np.ndarray:
    """4-grams as integers of four 16-bit units."""
    u = units.astype(np.uint64)
    return u[:-3] << np.uint64(48) | u[1:-2] << np.uint64(32) | u[2:-1] << np.uint64(16) | u[3:]


def count_grams(train: DataFrame) -> DataFrame:
    """lang, gram, n over all rows (text, lang)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold(lang: str) -> None:
            keys, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            if lang in total:
                keys, at = np.unique(np.concatenate([total[lang][0], keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([total[lang][1], n])).astype(np.int64)
            total[lang] = keys, n

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text, lang in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    if (units := normal(text)) is not None:
                        held.setdefault(lang, []).append(grams(units))
                for lang in [x for x, own in held.items() if sum(map(len, own)) > 1 << 20]:
                    fold(lang)
        for lang in list(held):
            fold(lang)
        for lang, (keys, n) in total.items():
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                columns = [pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(n[part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    ship(train.sparkSession)
    made = train.select("text", "lang").mapInArrow(over, "lang string, gram long, n long")
    return made.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Sorted hashes with a row of values for each; rows of unknown keys are -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = mix64(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        hashes = mix64(keys)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


class Language:
    """The model of one language: probabilities of the n-grams that it has, and what their contexts leave to shorter ones."""

    def __init__(self, orders: dict[int, tuple[np.ndarray, np.ndarray]], floor: float):
        self.floor = np.float32(floor)
        self.probs: dict[int, Table] = {}
        self.backs: dict[int, Table] = {}
        below = np.empty(0)
        for k in range(1, ORDER + 1):
            keys, n = orders[k]
            contexts, at = np.unique(keys >> np.uint64(16) if k > 1 else np.zeros(len(keys), np.uint64), return_inverse=True)
            # the end of each n-gram is one itself
            base = below[np.searchsorted(orders[k - 1][0], keys & np.uint64((1 << 16 * (k - 1)) - 1))] if k > 1 else floor
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
            total = np.bincount(at, n, len(contexts))
            backs = discount * np.bincount(at, minlength=len(contexts)) / total
            below = (n - discount) / total[at] + backs[at] * base
            self.probs[k], self.backs[k] = Table(keys, below), Table(contexts, backs)

    def __call__(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Probabilities of the last character of n-grams given the others."""
        if k == 0:
            return np.full(len(keys), self.floor, np.float32)
        at = self.probs[k].find(keys)
        out = self.probs[k].values[at]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            back = self.backs[k].find(keys[rest] >> np.uint64(16))
            weight = np.where(back >= 0, self.backs[k].values[back], np.float32(1))
            out[rest] = weight * self(keys[rest] & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
        return out


class KneserNey:
    """Interpolated Kneser-Ney models of several languages from their 4-gram counts.

    Each holds the n-grams of its own language only, so that the whole grows with the pairs of n-gram and language that
    occur, not with their product.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs, orders = sorted(counts), []
        for lang in self.langs:
            by_order = {ORDER: counts[lang]}
            for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer n-grams it is the end
                by_order[k] = np.unique(by_order[k + 1][0] & np.uint64((1 << 16 * k) - 1), return_counts=True)
            orders.append(by_order)
        units = np.unique(np.concatenate([o[1][0] for o in orders]))
        self.floor = 1.0 / (1 + len(units))  # all units, one unknown
        self.models = [Language(o, self.floor) for o in orders]

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms of the last character's probability given the others, a column a language."""
        return np.stack([np.log(model(keys)) for model in self.models], axis=1)

    def score(self, texts: list[str | None]) -> list[tuple]:
        """(language, score, cross-entropy per character, characters) of each text."""
        out: list[tuple] = [("und", 0.0, None, 0)] * len(texts)
        units = [(i, u) for i, u in enumerate(map(normal, texts)) if u is not None] if self.langs else []
        while units:
            size, some = 0, []
            while units and (not some or size + len(units[-1][1]) < 1 << 19):
                some.append(units.pop())
                size += len(some[-1][1])
            keys = np.concatenate([grams(u) for _, u in some])
            owner = np.repeat(np.arange(len(some)), [len(u) - 3 for _, u in some])
            sums = np.zeros((len(some), len(self.langs)))
            for at in range(0, len(keys), 1 << 19):
                distinct, place = np.unique(keys[at : at + (1 << 19)], return_inverse=True)  # most occur many times
                logs, own = self.log_probs(distinct), owner[at : at + (1 << 19)]
                for j in range(len(self.langs)):
                    sums[:, j] += np.bincount(own, logs[place, j], len(some))
            for (i, u), row in zip(some, sums, strict=True):
                n = len(u) - 3
                entropy = -row / n
                best = int(entropy.argmin())
                score = 1 / np.exp(-(entropy - entropy[best]) * min(n, 64)).sum()
                out[i] = (self.langs[best], float(score), float(entropy[best]), n)
        return out


def fit(train: DataFrame) -> KneserNey | None:
    """The models of all languages of rows (text, lang, _kept); None without any. Rows kept out count where a language
    has no others."""
    counts = written(count_grams(train.filter("not _kept")))
    langs = [r.lang for r in counts.select("lang").distinct().collect()]
    alone = count_grams(train.filter(F.col("_kept") & ~F.col("lang").isin(langs)))
    found = counts.unionByName(alone).toArrow()
    drop_written(counts)
    lang, keys, n = found["lang"].to_numpy(), found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()
    out = {}
    for x in sorted(set(lang)):
        order = np.flatnonzero(lang == x)
        order = order[np.argsort(keys[order])]
        out[x] = keys[order], n[order]
    return KneserNey(out) if out else None


def identify(docs: DataFrame, train_on: Column | None = None, reject: float = 0.001) -> DataFrame:
    """Rows of docs without the text, with RESULT and rejected; learned from rows with a lang where train_on holds."""
    docs = docs.drop("rejected").withColumn("_train", F.coalesce(train_on, F.lit(False)) if train_on is not None else F.lit(True))
    docs = docs.withColumn("_kept", F.pmod(F.xxhash64("text"), F.lit(10)) == 0)
    model = fit(docs.filter("_train and lang is not null"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(texts: list[str | None]) -> list[tuple]:
        return shared.value.score(texts) if shared.value else [("und", 0.0, None, 0)] * len(texts)

    scored = written(add_columns(docs, [docs["text"]], fn, RESULT, 64, drop=("text",)))
    entropy, n = F.col("cross_entropy"), F.col("n_letters_scored")
    known = scored.filter("_train and _kept and lang = lang_pred")
    fitted = known.groupBy("lang_pred").agg(
        (F.sum(entropy * n) / F.sum(n)).alias("_mean"),
        F.avg(n * entropy * entropy).alias("_a"),
        F.avg(n * entropy).alias("_b"),
        F.avg(n).alias("_c"),
    )
    deviation = F.sqrt(F.greatest(F.col("_a") - 2 * F.col("_mean") * F.col("_b") + F.col("_mean") ** 2 * F.col("_c"), F.lit(1e-12)))
    fitted = fitted.select("lang_pred", "_mean", deviation.alias("_dev"))
    excess = ((entropy - F.col("_mean")) * F.sqrt(n) / F.col("_dev")).alias("_excess")
    # fitted and limits have a row for each language
    limits = known.join(F.broadcast(fitted), "lang_pred").select("lang_pred", "_mean", "_dev", excess).groupBy("lang_pred", "_mean", "_dev")
    limits = limits.agg(F.percentile_approx("_excess", 1 - reject, 10_000).alias("_limit"))
    out = scored.join(F.broadcast(limits), "lang_pred", "left")
    rejected = F.coalesce((entropy - F.col("_mean")) * F.sqrt(n) / F.col("_dev") > F.col("_limit"), F.col("lang_pred") == "und")
    return out.withColumn("rejected", rejected).drop("_train", "_kept", "_mean", "_dev", "_limit")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return identify(docs, ~F.col("held_out")).select("doc_id", "held_out", *names(RESULT), "rejected")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
