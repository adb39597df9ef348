"""Small tables that several branches of a plan read are written once.

Spark plans a DataFrame anew wherever it is used.  A per-slot table behind five
lookups would aggregate the raw slice five times, so it is written as Parquet in the
shared checkpoint folder and scanned from there; a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from cellcast.session import ensure_checkpoint_dir


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def side_by_side(jobs: Sequence[Callable], workers: int = 5) -> list:
    """Results of independent jobs, ``workers`` at a time; Spark schedules their tasks together."""
    with ThreadPoolExecutor(max_workers=min(workers, max(1, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def staged(df: DataFrame, label: str) -> DataFrame:
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
