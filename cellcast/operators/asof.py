"""As-of lookups and interpolation between bracketing reference slots.

For each query key ``(cell, t)`` we need the last reference slot ``t_ref <= t``
and the first ``t_ref > t``.  Instead of a range join (rows × slots per cell) the
reference series and the query keys are unioned and scanned once in ``t`` order
per cell: reference rows sort before query rows at equal ``t``, so a running
``last(…, ignorenulls)`` up to the current row is the backward match and a
``first`` over the following rows is the forward match.

Both inputs are *distinct* per ``(cell, t)`` (the series is averaged per slot,
the queries are the distinct keys of the target rows), so one window partition
holds at most two rows per minute of the day: a hot cell cannot grow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions.numeric import clip
from cellcast.operators.lookups import Slots


def series(ref: DataFrame | Slots, cell: str = "geohash", value: str = "demand") -> DataFrame:
    """Per-cell ordered series ``(cell, t, v)``: slot means, slots without a value dropped."""
    if isinstance(ref, Slots):
        return ref.table.where(F.col(cell).isNotNull() & (F.col("n") > 0)).select(cell, "t", (F.col("s") / F.col("n")).alias("v"))
    return (ref.where(F.col(cell).isNotNull())
            .groupBy(cell, "t").agg(F.avg(value).alias("v"))
            .where(F.col("v").isNotNull()))


def brackets(keys: DataFrame, ser: DataFrame, cell: str = "geohash") -> DataFrame:
    """``keys(cell, t)`` → ``+ t_prev, v_prev, t_next, v_next, n_prev, n_next``.

    ``n_prev``/``n_next`` count series slots at or before / after ``t``.
    """
    q = keys.select(cell, "t").distinct().select(cell, "t", F.lit(None).cast("double").alias("v"),
                                                  F.lit(1).alias("_q"))
    r = ser.select(cell, "t", "v", F.lit(0).alias("_q"))
    u = r.unionByName(q)
    point = F.when(F.col("_q") == 0, F.struct(F.col("t").alias("t"), F.col("v").alias("v")))
    is_ref = F.when(F.col("_q") == 0, F.lit(1)).otherwise(F.lit(0))
    w = Window.partitionBy(cell).orderBy("t", "_q")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(cell)
    out = (u.select(cell, "t", "_q",
                    F.last(point, ignorenulls=True).over(upto).alias("_p"),
                    F.first(point, ignorenulls=True).over(after).alias("_n"),
                    F.sum(is_ref).over(upto).alias("n_prev"),
                    F.sum(is_ref).over(whole).alias("_tot"))
           .where(F.col("_q") == 1))
    return out.select(cell, "t",
                      F.col("_p.t").alias("t_prev"), F.col("_p.v").alias("v_prev"),
                      F.col("_n.t").alias("t_next"), F.col("_n.v").alias("v_next"),
                      F.col("n_prev").cast("long").alias("n_prev"),
                      (F.col("_tot") - F.col("n_prev")).cast("long").alias("n_next"))


def interpolate(b: DataFrame, edge: str = "null", name: str = "interp") -> DataFrame:
    """Linear interpolation on bracket columns.

    Both sides: ``v_prev + α·(v_next − v_prev)``, ``α = (t − t_prev)/(t_next − t_prev)``
    clipped to [0, 1].  Only a previous slot: ``v_prev``.  Only a next slot:
    NULL with ``edge='null'``, ``v_next`` with ``edge='nearest'``.
    """
    t, tp, tn = F.col("t"), F.col("t_prev"), F.col("t_next")
    span = tn - tp
    alpha = clip(F.try_divide((t - tp).cast("double"), F.when(span > 0, span).cast("double")), 0.0, 1.0)
    alpha = F.coalesce(alpha, F.lit(0.0))
    both = F.col("v_prev") + alpha * (F.col("v_next") - F.col("v_prev"))
    if edge == "null":
        only_next = F.lit(None).cast("double")
    elif edge == "nearest":
        only_next = F.col("v_next")
    else:
        raise ValueError(f"unknown edge={edge!r}")
    value = (F.when(tp.isNotNull() & tn.isNotNull(), both)
             .when(tp.isNotNull(), F.col("v_prev"))
             .when(tn.isNotNull(), only_next))
    return b.withColumn(name, value)


def interval_join(points: DataFrame, intervals: DataFrame, by: str = "geohash", at: str = "t", low: str = "low", high: str = "high",
                  width: int = 60) -> DataFrame:
    """Every row of ``points`` with every interval of its group that holds its time: low <= at <= high.

    Time is cut into bins of ``width``; an interval goes to the bins it touches and a point to its own, so the
    join is on equal (group, bin) and a pair meets in one bin only.  An interval is repeated at most
    (its length / width + 2) times, and a large group is spread over its bins.  Empty intervals, and
    null groups, times or bounds, match nothing.
    """
    def bin_of(c):
        return F.floor(F.col(c) / F.lit(width))
    spread = intervals.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    placed = points.withColumn("_bin", bin_of(at))
    met = placed.join(spread, [by, "_bin"]).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    return met.drop("_bin")
