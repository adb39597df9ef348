"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(c: Column) -> Column:
    """Map NaN to NULL so that ``avg`` skips it the way pandas does (``avg`` over NaN is NaN)."""
    return F.nanvl(c, F.lit(None).cast("double"))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """``np.clip`` semantics: a missing value (NULL or NaN) stays missing, as NULL (``least``/``greatest``
    alone would skip a NULL, and order NaN above every bound)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), out)


def round6(c: Column) -> Column:
    """Round half away from zero at 6 decimals through decimal arithmetic.

    A double is first fixed at 9 decimals (absorbing summation-order noise), then
    rounded to 6; the same two casts in DuckDB give the same digits.
    """
    return c.cast("decimal(38,9)").cast("decimal(38,6)").cast("double")


def finish(df: DataFrame, digits: bool = True) -> DataFrame:
    """Round every DOUBLE column to 6 decimals (order-insensitive comparisons)."""
    if not digits:
        return df
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round6(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
