"""A corpus from raw documents to tokens: each stage works on all that its predecessor kept.

Null and empty texts go in the first stage, as texts in no language. What a stage does with ties, repeated rows and
extra columns is stated in the operator it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from poiscope.llm.bpe import encode_documents
from poiscope.llm.boosting import written
from poiscope.llm.common import held_out, importable, table
from poiscope.llm.decontamination import drop_contaminated
from poiscope.llm.exact_dedup import drop_exact_copies
from poiscope.llm.language_id import UNDEFINED, identify
from poiscope.llm.near_dedup import drop_near_duplicates

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those whose best language has less than half of the probability."""
    judged = identify(docs, teaches=~held_out(F.col("doc_id")), carry=True)
    return judged.filter((F.col("lang_pred") != UNDEFINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the one with the smallest id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in runs of five words, the one with the smallest id stays."""
    return drop_near_duplicates(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of the five-word runs of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every text, and digests of the ids and of what they decode to."""
    done = encode_documents(docs.select("doc_id", "text"), decoded_into="decoded")
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: Language identification and tokens are beyond SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again."""
    docs = table(importable(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
