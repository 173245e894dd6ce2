"""The corpus pipeline: documents in, token ids out.

1. ``toxicity``: documents that the toxicity score rejects go.
2. ``near_duplicates``: of each group linked by five-word Jaccard similarity of 0.8, the document with the least id stays.
3. ``decontamination``: documents with a benchmark passage go.
4. ``secrets``: the values of secrets are replaced in the text.
5. ``tokens``: texts are encoded by the BPE automaton; ``token_ids`` and ``n_tokens`` take the place of the text.

Every stage works on all that the one before kept, and is written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detectlab.llm import bpe, decontaminate, nearcopies, secrets, toxicity
from detectlab.session import materialise, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secrets.redact_secrets(docs)
    # The length follows the text.
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode),
]

#: Models, fingerprints and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


#: A row holds a whole text, so what a task has at once is kept small: rows of an Arrow batch (some stand in the JVM and in its Python worker),
#: and what is fetched for a partition after a shuffle.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    before = {name: spark.conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        # All of a stage's work is done when it is written.
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return docs
