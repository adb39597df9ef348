"""Observations as a table partitioned by day and bucketed by (cell, slot).

The period filter prunes whole partitions, and grouping or joining on (cell, slot) needs no
shuffle: both periods lie in the same buckets.  The slot belongs to the bucket key so that a
cell with a third of all rows is spread over its slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.operators.lookups import mean_by

# Rows of a day and bucket that one task writes and sorts.
ROWS_PER_BUCKET = 2_000_000


def buckets_for(obs: DataFrame, day: str = "day", rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """As many buckets as the largest day asks for (one counting pass)."""
    largest = obs.groupBy(day).count().agg(F.max("count")).first()[0] or 0
    return max(8, -(-largest // rows_per_bucket))


def store_observations(obs: DataFrame, table: str, path: str, cell: str = "geohash", slot: str = "t", day: str = "day",
                       buckets: int | None = None) -> DataFrame:
    """Write ``obs`` as ``table`` at ``path`` and return it as a scan; fails if the table is there.

    Rows are dealt by the bucket key first, so there is one file per day and bucket.  A null day, cell or slot is stored as any other value.
    """
    n = buckets or buckets_for(obs, day)
    (obs.repartition(n, cell, slot).write.partitionBy(day).bucketBy(n, cell, slot).sortBy(cell, slot)
     .option("path", path).saveAsTable(table))
    return stored_observations(obs.sparkSession, table)


def stored_observations(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def colocated_mean(ref: DataFrame, rows: DataFrame, cell: str = "geohash", slot: str = "t", value: str = "demand", name: str = "ref_exact") -> DataFrame:
    """``rows`` with the mean reference value of their cell and slot, or NULL.

    For two slices of one stored table both the mean and the merge join work bucket by bucket; other inputs are shuffled.
    """
    means = mean_by(ref, [cell, slot], value, name)
    return rows.join(means.hint("merge"), [cell, slot], "left")
