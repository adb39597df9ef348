"""Shared input handles for the registered queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cellcast.sources.fixtures import Roles, demand_observations


def roles(spark: SparkSession, sf_dir: str) -> Roles:
    return Roles(demand_observations(spark, sf_dir))
