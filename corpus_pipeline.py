"""Corpus pipeline: toxicity, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. Every stage works on all that
its predecessor kept; the last returns token ids, the others the columns of documents.

Edge cases, in every stage: rows with null ids, null, empty or very long texts and
repeated rows pass through unless the stage's own rule drops them (a null id is never a
near-duplicate; a null text is never toxic, leaked or masked and has null token ids); of
near copies the least id stays, rows that share it included; empty tables give empty
results; other columns, whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from confab.llm import bpe, decontaminate, secrets, simhash, toxicity
from confab.plans.lineage import cut_lineage, release, temporary
from confab.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on the labelled documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item, exact or edited, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    return secrets.mask_secrets(docs, secrets.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

#: SQL cannot express the trained stages; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with temporary() as kept:  # what a stage wrote for itself goes once its result is written
            done = cut_lineage(stage(spark, docs, sf_dir), name)
            kept.append(done)
        if k:
            release(spark, docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
