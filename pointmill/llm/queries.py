"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import new_path, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), edited=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"), folds=5)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import TARGETS, labelled_domains, mixing_rates

    docs = table(spark, sf_dir, "documents")
    found = mixing_rates(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)
    return found.select("doc_id", "n_tokens", "domain", "rate")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import token_spans, write_token_ids

    write_token_ids(table(spark, sf_dir, "documents"), path := new_path(spark, "token-ids"), bpe.default_path(), end_id=2)
    return token_spans(spark, path)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), bpe.default_path(), limit=1024)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import graded, quality_scores

    found = quality_scores(table(spark, sf_dir, "documents"), graded(table(spark, sf_dir, "labels")), n_grades=3, keep_grade=2)
    return found.select("doc_id", "expected_grade", "p_keep", "kept")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import page_outcomes, url_filter

    judged = url_filter(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "bad_mean", "bad_low")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), folds=10)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4, seed=42).select("doc_id", "fingerprint", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_language_id": op2_language_id,
        "op3_mixing": op3_mixing,
        "op4_token_ids": op4_token_ids,
        "op5_quality_rules": op5_quality_rules,
        "op6_token_counts": op6_token_counts,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_url_filters": op8_url_filters,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    from . import decontam, quality_rules, url_filters

    return {"op1_decontamination": decontam.SQL, "op5_quality_rules": quality_rules.SQL, "op8_url_filters": url_filters.SQL}
