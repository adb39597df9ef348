"""Profiles and corrections around temperature, weather and category drift."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.numeric import clip


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """r over rows with both values, their count, the t statistic ``r·sqrt((n−2)/(1−r²))`` and its
    two-sided p-value (that of the slope of a linear regression; NULL for fewer than three rows or
    a constant column)."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    s = d.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy")).first()
    p = None
    if s["n"] > 2 and s["sx"] and s["sy"] and abs(s["r"]) < 1:
        fit = LinearRegression(labelCol=y, regParam=0.0, solver="normal").fit(
            VectorAssembler(inputCols=[x], outputCol="features").transform(d))
        p = float(fit.summary.pValues[0])
    s = df.sparkSession.createDataFrame([(s["r"], s["n"], p)], "r double, n long, p_value double")
    rest = F.lit(1.0) - F.col("r") * F.col("r")
    return s.select("r", "n", "p_value", (F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.when(rest > 0, rest))))
                    .alias("t_stat"))


def scaler(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean and population std of ``x`` over rows with both ``x`` and ``y`` (a fitted standard scaler)."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"),
                 F.covar_pop(x, y).alias("cov"))


def ridge_slope(df: DataFrame, x: str, y: str, alpha: float = 1.0) -> DataFrame:
    """Ridge slope of ``y`` on standardised ``x`` with intercept: ``n·cov(x, y) / (σ·(n + α))``."""
    s = scaler(df, x, y)
    return s.select("n", "mu", "sd", (F.col("n") * F.col("cov") / (F.col("sd") * (F.col("n") + F.lit(alpha))))
                    .alias("slope"))


def temperature_shift(ref: DataFrame, rows: DataFrame, cell: str = "geohash") -> DataFrame:
    """Target temperature minus the reference mean of its (cell, hour): match share, mean/std, |Δ| > 2."""
    m = ref.groupBy(cell, "hour").agg(F.avg("Temperature").alias("_rt"))
    d = rows.join(m, [cell, "hour"], "left").select((F.col("Temperature") - F.col("_rt")).alias("_d"))
    return d.agg(F.count("_d").alias("n_match"), (F.count("_d") / F.count(F.lit(1))).alias("match_share"),
                 F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("std_diff"),
                 F.count_if(F.abs(F.col("_d")) > 2).alias("n_above_2"))


def temperature_correction(ref: DataFrame, rows: DataFrame, base: DataFrame, strengths: DataFrame,
                           cell: str = "geohash") -> DataFrame:
    """``clip(p + s·slope·(z_row − z_ref(cell, hour)), 0, 1)`` per strength; missing terms → 0."""
    rs = ridge_slope(ref, "Temperature", "demand")
    m = ref.groupBy(cell, "hour").agg(F.avg("Temperature").alias("_rt"))
    x = (rows.select("Index", cell, "hour", "Temperature").join(m, [cell, "hour"], "left")
         .join(base.select("Index", F.col("demand").alias("_p")), ["Index"])
         .crossJoin(F.broadcast(rs)))
    z = (F.col("Temperature") - F.col("mu")) / F.col("sd")
    zr = (F.col("_rt") - F.col("mu")) / F.col("sd")
    corr = F.coalesce(F.col("slope") * (z - zr), F.lit(0.0))
    return (x.withColumn("_c", corr).crossJoin(F.broadcast(strengths))
            .select("strength", "Index", clip(F.col("_p") + F.col("strength") * F.col("_c"), 0.0, 1.0).alias("demand")))


def weather_correction(ref: DataFrame, rows: DataFrame, base: DataFrame, weights: DataFrame) -> DataFrame:
    """``clip(p·(1 + w·(clip(ratio, .5, 2) − 1)), 0, 1)``; ratio = weather mean / overall mean, missing → 1."""
    wm = ref.where(F.col("Weather").isNotNull()).groupBy("Weather").agg(F.avg("demand").alias("_wm"))
    ov = ref.agg(F.avg("demand").alias("_ov"))
    x = (rows.select("Index", "Weather").join(wm, ["Weather"], "left").crossJoin(F.broadcast(ov))
         .join(base.select("Index", F.col("demand").alias("_p")), ["Index"]))
    ratio = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.coalesce(F.col("_wm") / F.col("_ov"), F.lit(1.0))))
    return (x.withColumn("_r", ratio).crossJoin(F.broadcast(weights))
            .select("w", "Index", clip(F.col("_p") * (F.lit(1.0) + F.col("w") * (F.col("_r") - 1)), 0.0, 1.0)
                    .alias("demand")))


def category_drift(periods: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Value counts per (column, period, value); NULL values form no group."""
    out = None
    for period, df in periods.items():
        arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
        part = df.select(F.lit(period).alias("period"), F.explode(arr).alias("_x")).select("period", "_x.*")
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("value").isNotNull()).groupBy("feature", "period", "value").agg(
        F.count(F.lit(1)).alias("n"))
