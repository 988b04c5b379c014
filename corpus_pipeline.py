"""A corpus from documents to token files: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointmill.llm import bpe
from pointmill.llm.common import new_path, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the ordinal classifier gives little chance of the best grade."""
    from pointmill.llm.quality_classifier import graded, select_quality

    return select_quality(docs, graded(table(spark, sf_dir, "labels")), n_grades=3, keep_grade=2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of SimHash neighbours and of texts alike in four of five shingles."""
    from pointmill.llm.simhash import one_of_each

    return one_of_each(docs, distance=4, width=4, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents into which a benchmark item leaked, edited copies and excerpts included."""
    from pointmill.llm.decontam import clean

    return clean(docs, table(spark, sf_dir, "benchmark"), edited=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that expected domain totals match the targets."""
    from pointmill.llm.mixing import TARGETS, labelled_domains, mixed

    # what labels call low has been rejected before, so only languages have targets here
    targets = {k: v for k, v in TARGETS.items() if k != "low"}
    return mixed(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), targets)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids as ORC and reads back where each document lies."""
    from pointmill.llm.token_output import token_spans, write_token_ids

    write_token_ids(docs, path := new_path(spark, "corpus-token-ids"), bpe.default_path(), end_id=2)
    return token_spans(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token ids", token_ids),
]

#: The trained stages have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
