"""Metrics: RMSE, R², score, per-level RMSE, parameter grids."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rmse(y: str | Column, p: str | Column) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    return F.sqrt(F.avg(F.pow(y - p, 2)))


def r2(y: str | Column, p: str | Column) -> Column:
    """``1 − Σ(y − p)² / Σ(y − ȳ)²`` as one aggregate expression."""
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    return F.lit(1.0) - F.sum(F.pow(y - p, 2)) / (F.count(y) * F.var_pop(y))


def score(r2col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) * r2col)


def rmse_by_level(df: DataFrame, methods: Mapping[str, tuple[str, str]], y: str = "y") -> DataFrame:
    """RMSE per (method, level) and overall, plus the relative improvement of the
    second method over the first (``100·(a − b)/a``).  One pass: the methods are
    unpivoted into rows, then grouping sets give per-level and overall rows; the improvement is
    a window over those few result rows.
    """
    rows = df.select(F.col(y).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("method"), F.col(lcol).alias("level"), F.col(pcol).alias("_p"))
        for name, (pcol, lcol) in methods.items()])).alias("_m")).select("_y", "_m.*")
    g = (rows.groupingSets([[F.col("method"), F.col("level")], [F.col("method")]], "method", "level")
         .agg(F.count(F.lit(1)).alias("n"), rmse("_y", "_p").alias("rmse"), F.grouping("level").alias("_gl")))
    a, b = (F.max(F.when((F.col("_gl") == 1) & (F.col("method") == name), F.col("rmse"))).over(Window.partitionBy())
            for name in list(methods)[:2])
    return g.select("method", F.when(F.col("_gl") == 1, F.lit("all")).otherwise(F.col("level")).alias("level"),
                    "n", "rmse", (F.lit(100.0) * (a - b) / a).alias("improvement_pct"))
