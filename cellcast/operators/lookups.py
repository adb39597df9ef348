"""Reference-period lookup tables and lookup joins.

The reference slice is reduced once to a per-(cell, slot) table of sums and counts
(partial aggregation happens map-side, so a hot cell costs one row per slot per
task, not one row per observation).  Every coarser *mean* grain (cell×hour, cell,
prefix, overall) is derived from that small table, so the raw slice is scanned
and shuffled once however many grains are used.

Lookups are attached with the *resolve-per-key* pattern: the distinct join keys
of the target rows (bounded by cells × slots) are joined to all lookup tables,
and the big target table is joined once, on its own keys, to that result.
"""

from __future__ import annotations

import copy
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.functions.geohash import prefix as gh_prefix
from cellcast.sources.staging import staged


def _not_null(keys: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


def mean_by(df: DataFrame, keys: Sequence[str], value: str = "demand", name: str = "mean",
            on_duplicate: str = "mean", order: str = "row_id") -> DataFrame:
    """One value per key: ``mean`` of the non-null values, or the ``last`` row's value.

    NULL keys form no group (pandas drops them).  ``last`` keeps the value of the
    row with the greatest ``order`` column, NULL included (a dict built in file
    order keeps the last assignment).
    """
    src = df.where(_not_null(keys))
    if on_duplicate == "mean":
        return src.groupBy(*keys).agg(F.avg(value).alias(name))
    if on_duplicate == "last":
        return src.groupBy(*keys).agg(
            F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).getField("v").alias(name))
    raise ValueError(f"unknown on_duplicate={on_duplicate!r}")


class Slots:
    """One slice reduced to its slots, written once: ``table`` holds per (cell, t, hour)

    ``rows`` (all), ``n``, ``s``, ``ss`` (count, sum and sum of squares of the values),
    ``mn`` and ``mx``.  Every mean, deviation, extreme, pair moment and baseline comes from
    this table, so the raw slice is read once however many grains are used.  With ``by`` columns
    several slices share one pass and one table; ``slice`` picks one of them.
    """

    def __init__(self, rows: DataFrame, value: str = "demand", cell: str = "geohash", by: Sequence[str] = ()):
        self.cell, self.value, self.by = cell, value, list(by)
        v = F.col(value)
        self.table = staged(rows.groupBy(*by, cell, "t", "hour").agg(
            F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"),
            F.min(v).alias("mn"), F.max(v).alias("mx")), "slots")

    def slice(self, condition: Column) -> Slots:
        """The slots that meet a condition on the ``by`` columns, cell, t and hour."""
        out = copy.copy(self)
        out.table, out.by = self.table.where(condition).drop(*self.by), []
        return out


def as_slots(x: DataFrame | Slots, value: str = "demand", cell: str = "geohash") -> Slots:
    return x if isinstance(x, Slots) else Slots(x, value, cell)


def slots_std(s: str = "s", ss: str = "ss", n: str = "n") -> Column:
    """Sample deviation of all values below a grouping of slots, 0 for fewer than two."""
    total, squares, count = F.sum(s), F.sum(ss), F.sum(n)
    return F.when(count > 1, F.sqrt(F.greatest(F.lit(0.0), squares - total * total / count) / (count - 1))).otherwise(F.lit(0.0))


class ReferenceLookups:
    """Lookup tables over one reference slice.

    ``base`` holds ``(cell, t, hour, s, n, ...)`` per slot (see ``Slots``).  Means at coarser
    grains are ``sum(s)/sum(n)`` (row-weighted).
    """

    def __init__(self, ref: DataFrame | Slots, value: str = "demand", cell: str = "geohash"):
        self.slots = as_slots(ref, value, cell)
        self.value = value
        self.cell = cell
        self.base = self.slots.table.where(F.col(cell).isNotNull())

    @staticmethod
    def _mean(s: str = "s", n: str = "n") -> Column:
        return F.try_divide(F.sum(s), F.when(F.sum(n) > 0, F.sum(n)))

    def exact(self, name: str = "ref_exact") -> DataFrame:
        """(cell, t) → mean value at that slot."""
        return self.base.select(self.cell, "t",
                                F.try_divide(F.col("s"), F.when(F.col("n") > 0, F.col("n"))).alias(name))

    def geo_hour(self, name: str = "ref_geo_hour") -> DataFrame:
        return self.base.groupBy(self.cell, "hour").agg(self._mean().alias(name))

    def geo(self, name: str = "ref_geo") -> DataFrame:
        return self.base.groupBy(self.cell).agg(self._mean().alias(name))

    def prefix(self, n: int, name: str | None = None, weight: str = "row") -> DataFrame:
        """Prefix-n mean: ``row`` weights every observation, ``cell`` averages cell means."""
        key = f"prefix{n}"
        name = name or f"prefix{n}_mean"
        if weight == "row":
            return (self.base.withColumn(key, gh_prefix(self.cell, n))
                    .groupBy(key).agg(self._mean().alias(name)))
        if weight == "cell":
            return (self.geo("_m").where(F.col("_m").isNotNull())
                    .withColumn(key, gh_prefix(self.cell, n))
                    .groupBy(key).agg(F.avg("_m").alias(name)))
        raise ValueError(f"unknown weight={weight!r}")

    def prefix_hour(self, n: int, name: str) -> DataFrame:
        key = f"prefix{n}"
        return self.base.withColumn(key, gh_prefix(self.cell, n)).groupBy(key, "hour").agg(self._mean().alias(name))

    def hour(self, name: str = "hour_mean") -> DataFrame:
        return self.base.groupBy("hour").agg(self._mean().alias(name))

    def overall(self, name: str = "overall_mean") -> DataFrame:
        """One-row table with the mean of all non-null reference values (of rows with a cell)."""
        return self.base.agg(self._mean().alias(name))


def attach_by_cell(rows: DataFrame, per_cell: DataFrame, cell: str = "geohash", slot: str = "t", how: str = "left",
                   keys: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to a table of one row per cell, through the (cell, slot) keys.

    The cell table meets the distinct keys (``keys``, or those of the rows), and the rows are joined on both
    columns, so a cell with a third of all rows is spread over its slots.  A null slot is a slot of its own.
    """
    at = F.coalesce(F.col(slot), F.lit(-1)).alias("_slot")
    resolved = (rows if keys is None else keys).select(cell, at).distinct().join(per_cell, [cell], how)
    return rows.withColumn("_slot", at).join(resolved, [cell, "_slot"], how).drop("_slot")


def with_prefix_columns(df: DataFrame, cell: str = "geohash", sizes=(5, 4, 3)) -> DataFrame:
    for n in sizes:
        df = df.withColumn(f"prefix{n}", gh_prefix(cell, n))
    return df
