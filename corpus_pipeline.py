"""Corpus pipeline: from ``documents`` to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  ``run``
writes every stage's result as Parquet in the shared folder and reads it again, so a lost
executor costs a part of one stage.  All but the last stage return the columns of their
input; the last returns the mix: doc_id, source, size, source_size, target, copies, taken,
one row per document that the mix takes.

Nulls, empty and very long texts, repeated rows and empty tables are treated as the operators'
docstrings say; the stages add no rule of their own, but that of repeated rows with words one
stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellcast.llm import decontaminate, language_id, ngram_join, secret_scan, source_mix, store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is trained on the labelled rows of ``docs``."""
    return language_id.recognised(docs, language_id.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.remove(docs, store.table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a live-looking credential of one owner; widely copied examples may stay."""
    return secret_scan.without_live(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, where it takes any."""
    return source_mix.mix(docs).where("copies > 0")


STAGES = [("language ID", identify_language), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", remove_benchmark),
          ("secret scans", remove_secrets), ("mixing sources", mix_sources)]
ORACLE_SQL = None      # a trained model and randomised rounding; tested against a plain Python version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.save(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
