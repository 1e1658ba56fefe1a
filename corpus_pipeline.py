"""A corpus pipeline over the documents table: each stage applies an operator of featurespark.llm to what is left.

All stages handle every row by itself, whatever other columns hold; columns that the input has beside those of documents
pass all stages but the last, whatever their names: they are set aside under names of their own while an operator works.
Empty tables give empty tables. Texts of any length count as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurespark.llm.common import drop_written, scratch, written
from featurespark.llm.decontaminate import decontaminate
from featurespark.llm.minhash import drop_near_duplicates
from featurespark.llm.packing import pack
from featurespark.llm.pii import redact
from featurespark.llm.toxicity import score_toxicity


def _aside(docs: DataFrame) -> DataFrame:
    """docs with all columns but id and text under names that no operator uses."""
    return docs.withColumnsRenamed({c: f"_own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")})


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, as they were named."""
    return out.select([F.col(c) if c in ("doc_id", "text") else F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic by a model learned from the labels of these documents.

    Null and empty texts are scored as texts without terms; rows without an id or a label are scored as all others;
    repeated rows have one fate.
    """
    scored = score_toxicity(_aside(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(scored.filter("predicted = 0"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose sets of five-word shingles are alike to 0.8 or more: the smallest id.

    All documents without words are kept. Repeated rows are copies. Rows without an id, or of one id with different texts,
    are documents of their own.
    """
    return _back(drop_near_duplicates(_aside(docs), k=5, percent=80), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark windows cover to a twentieth of their words or more.

    Null and empty texts have no words and are kept; repeated rows have one fate.
    """
    judged = decontaminate(_aside(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _back(judged.filter(~F.col("contaminated")), docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, and brings n_chars up to date.

    Null text stays null, and so does its n_chars; all rows are kept.
    """
    clean = _back(redact(_aside(docs)), docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    Null text is packed as an empty one; repeated rows are packed row for row; other columns are not part of the result.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Signatures, learned weights and byte-pair ids can't be expressed in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written as Parquet and read again as the next one's documents.

    What a stage has written beside its result goes when the result is there, and the result when the next one is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as tables:
            kept = written(stage(spark, docs, sf_dir))
            tables.keep(kept)
        drop_written(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
