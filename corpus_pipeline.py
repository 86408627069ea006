"""A training corpus from the table ``documents``: five stages, each by one operator.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept and
returns the columns of ``documents``; the last returns the encoded corpus. ``run`` writes
each stage's rows to the shared folder and rereads them, so a lost executor repeats at
most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontaminate, langid, secrets, simhash
from tessella.session import spare_name, table, written

#: SQL has no XXH64 and trains no classifier; the run is tested against brute force instead.
ORACLE_SQL = None


#: Languages of the corpus (None: all that are labelled), and the least confidence of a prediction.
LANGUAGES: frozenset[str] | None = None
LEAST_SCORE = langid.LEAST_SCORE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is none of LANGUAGES, or whose confidence is under LEAST_SCORE, go.

    So do those without text or letters. A null ``lang`` becomes the predicted language.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.with_language(docs, model, languages=LANGUAGES, least=LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of least id stays, and one row without id."""
    return simhash.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go; others stay as they are."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are masked; documents without one stay as they are."""
    before = spare_name(docs, "text_before")
    masked = secrets.redacted(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return masked.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digests of the ids and of the text that they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
