"""Query registry.

A query is ``fn(spark, sf_dir) -> DataFrame`` plus, when expressible, an oracle
SQL text for DuckDB over the raw tables.  DOUBLE outputs are rounded to 6
decimals on both sides (``finish`` in Spark, ``rounded`` in SQL).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from cellcast.functions.numeric import finish


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    notes: str = ""
    tags: tuple = field(default_factory=tuple)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(self.fn(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, notes: str = "", tags: tuple = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, notes, tags)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills REGISTRY
    from cellcast.plans import (q_sources, q_lookups, q_aggregates, q_calibration,  # noqa: F401
                                q_asof, q_features, q_blend, q_profile, q_models)
    return REGISTRY
