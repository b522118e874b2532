"""A training-corpus pipeline of five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a
DataFrame; all but the last return the columns of ``docs`` as they came, whatever extra ones it has.

1. language: a text of no known language (``und``), or whose likeliest language has less than
   ``LEAST_SHARE`` of the score, goes; a null lang is filled with the prediction.
2. near_duplicates: of each SimHash group the row with the smallest doc_id stays. Groups are those of ``op2_simhash``:
   fingerprints of four-word shingles that differ in at most four bits, joined through links. They hold nearly equal
   texts; a pair with half of its shingles changed is not among them.
3. personal_data: spans of personal data are replaced by their kind, n_chars follows.
4. mix: documents are taken 0, 1 or 2 times, so that sources come near their target weights.
5. pack: what the mix took becomes token ids in sequences; the result has a row per piece.

Null texts have no language and go in stage 1. Repeated rows are one group in stage 2, and the copies that
stage 4 makes are documents of their own for stage 5. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintageline.llm import language as language_id
from vintageline.llm import mixing, packing, pii, simhash
from vintageline.llm.common import free_name, materialize, table
from vintageline.llm.queries import PIECES, TOKENIZER

LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learn(language_id.training_rows(docs), PIECES)
    predicted, share = (free_name(docs.columns, c) for c in ("lang_pred", "score"))
    found = language_id.identified(docs, model)
    accepted = (F.col(predicted) != language_id.UNDETERMINED) & (F.col(share) >= LEAST_SHARE)
    return found.where(accepted).withColumn("lang", F.coalesce("lang", predicted)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = F.col(free_name(docs.columns, "redacted"))
    found = pii.pii_spans(docs)
    size = F.char_length(clean).cast(docs.schema["n_chars"].dataType)
    changed = {"text": clean, "n_chars": F.when(clean == F.col("text"), F.col("n_chars")).otherwise(size)}
    return found.withColumns(changed).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, TOKENIZER)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pack", pack),
]

# Language scores, fingerprints of hashed shingles and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
