"""Day-over-day calibration: per-cell offsets and scales with shrinkage.

Calibration rows (target period, observed part) are paired with reference rows
on ``(cell, slot)``.  The pairing is many-to-many when a slot repeats, but the
pairs are never formed: each side is first reduced to per-slot counts and sums,
and the pair moments follow from products of those (``Σ_i Σ_j (x_i − y_j) =
b·Σx − a·Σy``).  The work is two partial aggregations and one join of small
per-slot tables, whatever the skew of a cell.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.functions.numeric import clip
from cellcast.operators.lookups import Slots, as_slots

# Hour bound of the "hours" baseline and morning bound of the daily ratio.
BASELINE_LAST_HOUR = 2
MORNING_HOURS_BEFORE = 4


def _slot_moments(df: DataFrame | Slots, keys: Sequence[str], value: str, tag: str) -> DataFrame:
    if isinstance(df, Slots):
        return (df.table.where(F.col(keys[0]).isNotNull()).groupBy(*keys)
                .agg(F.sum("rows").alias(f"{tag}_all"), F.sum("n").alias(f"{tag}_nn"),
                     F.coalesce(F.sum("s"), F.lit(0.0)).alias(f"{tag}_sum")))
    return (df.where(F.col(keys[0]).isNotNull())
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias(f"{tag}_all"),
                 F.count(value).alias(f"{tag}_nn"),
                 F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{tag}_sum")))


def pair_stats(cal: DataFrame | Slots, ref: DataFrame | Slots, keys: Sequence[str] = ("geohash", "t"),
               cell: str = "geohash", value: str = "demand") -> DataFrame:
    """Per-cell moments of the inner join ``cal ⋈ ref`` on ``keys`` (pair semantics).

    Columns: ``n_pairs`` (all pairs), ``n_both`` (pairs with both values),
    ``n`` (pairs with a reference value, the shrinkage weight),
    ``m_ref``/``m_cal`` (pair-weighted means of each side), ``mean_diff``
    (mean of ``cal − ref`` over pairs with both values).
    """
    keys = list(keys)
    a = _slot_moments(cal, keys, value, "a")
    b = _slot_moments(ref, keys, value, "b")
    j = a.join(b, keys, "inner")
    a_all, a_nn, sx = F.col("a_all"), F.col("a_nn"), F.col("a_sum")
    b_all, b_nn, sy = F.col("b_all"), F.col("b_nn"), F.col("b_sum")
    agg = j.groupBy(cell).agg(
        F.sum(a_all * b_all).alias("n_pairs"),
        F.sum(a_nn * b_nn).alias("n_both"),
        F.sum(a_all * b_nn).alias("n"),
        F.sum(b_all * a_nn).alias("n_cal"),
        F.sum(a_all * sy).alias("_sy"),
        F.sum(b_all * sx).alias("_sx"),
        F.sum(b_nn * sx - a_nn * sy).alias("_sd"))
    nz = lambda c: F.when(F.col(c) > 0, F.col(c))
    return agg.select(cell, "n_pairs", "n_both", "n",
                      F.try_divide(F.col("_sy"), nz("n")).alias("m_ref"),
                      F.try_divide(F.col("_sx"), nz("n_cal")).alias("m_cal"),
                      F.try_divide(F.col("_sd"), nz("n_both")).alias("mean_diff"))


def pair_sums(cal: DataFrame | Slots, ref: DataFrame | Slots, cell: str = "geohash", value: str = "demand") -> tuple[DataFrame, DataFrame]:
    """What ``without_own`` needs: per cell the pair sums, and per (cell, t) the reference's moments."""
    a, b = (_slot_moments(x, (cell, "t"), value, tag) for x, tag in ((cal, "a"), (ref, "b")))
    j = a.join(b, [cell, "t"])
    per_cell = j.groupBy(cell).agg(
        F.sum(F.col("a_all") * F.col("b_nn")).alias("_pn"), F.sum(F.col("b_all") * F.col("a_nn")).alias("_pc"),
        F.sum(F.col("a_all") * F.col("b_sum")).alias("_py"), F.sum(F.col("b_all") * F.col("a_sum")).alias("_px"))
    return per_cell, b.select(cell, "t", *[F.col(f"b_{m}").alias(f"_own_{m}") for m in ("all", "nn", "sum")])


def without_own(value: str = "demand") -> tuple[Column, Column, Column]:
    """(n, m_ref, m_cal) of a calibration row's cell without the pairs that the row itself makes.

    For rows with the columns of both tables of ``pair_sums``; the row's pairs are its slot's
    reference rows, so their share of each sum is known without forming a pair.
    """
    zero = F.lit(0.0)
    own = {m: F.coalesce(F.col(f"_own_{m}").cast("double"), zero) for m in ("all", "nn", "sum")}
    n, nc, sy, sx = (F.coalesce(F.col(c).cast("double"), zero) for c in ("_pn", "_pc", "_py", "_px"))
    n, sy = n - own["nn"], sy - own["sum"]
    nc = nc - own["all"] * F.col(value).isNotNull().cast("double")
    sx = sx - own["all"] * F.coalesce(F.col(value), zero)
    some = lambda c: F.when(c > 0, c)
    return n, F.try_divide(sy, some(n)), F.try_divide(sx, some(nc))


def overlap_reference(ref: DataFrame, cal: DataFrame, slot: str = "t") -> DataFrame:
    """Reference rows whose slot occurs in the calibration period (left semi join)."""
    return ref.join(cal.select(slot).distinct(), [slot], "left_semi")


def global_baselines(ref: DataFrame | Slots, cal: DataFrame | Slots, baseline: str = "overlap",
                     value: str = "demand") -> DataFrame:
    """One row ``(g_ref, g_cal)``; ``g_ref`` over the chosen reference window.

    ``hours``: reference hours ≤ 2; ``overlap``: reference slots seen in the
    calibration period; ``all``: the whole reference slice.
    """
    ref, cal = as_slots(ref, value).table, as_slots(cal, value).table
    if baseline == "hours":
        r = ref.where(F.col("hour") <= BASELINE_LAST_HOUR)
    elif baseline == "overlap":
        r = overlap_reference(ref, cal)
    elif baseline == "all":
        r = ref
    else:
        raise ValueError(f"unknown baseline={baseline!r}")
    mean = F.try_divide(F.sum("s"), F.when(F.sum("n") > 0, F.sum("n")))
    return r.agg(mean.alias("g_ref")).crossJoin(F.broadcast(cal.agg(mean.alias("g_cal"))))


def global_offset_scale(g: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Add ``global_offset = g_cal − g_ref`` and ``global_scale`` (1 when ``g_ref ≤ 0``)."""
    ratio = F.try_divide(F.col("g_cal"), F.col("g_ref"))
    scale = F.when(F.col("g_ref") > 0, clip(ratio, lo, hi)).otherwise(F.lit(1.0))
    return g.select("*", (F.col("g_cal") - F.col("g_ref")).alias("global_offset"),
                    scale.alias("global_scale"))


def shrunk_offset(stats: DataFrame, g: DataFrame, k: float) -> DataFrame:
    """``(n·(m_cal − m_ref) + k·global_offset) / (n + k)`` per cell (NULL when undefined)."""
    n = F.col("n").cast("double")
    num = n * (F.col("m_cal") - F.col("m_ref")) + F.lit(float(k)) * F.col("global_offset")
    den = n + F.lit(float(k))
    return (stats.crossJoin(F.broadcast(g.select("global_offset")))
            .select("geohash", F.try_divide(num, F.when(den != 0, den)).alias("offset")))


def shrunk_scale(stats: DataFrame, g: DataFrame, k: float, lo: float, hi: float) -> DataFrame:
    """``clip((n·m_cal + k·g_cal)/(n·m_ref + k·g_ref), lo, hi)``.

    Division by zero follows float rules before the clip: ``x/0`` with ``x > 0``
    → ``hi``, ``x < 0`` → ``lo``, ``0/0`` → NULL (the global scale fills it).
    """
    n = F.col("n").cast("double")
    kk = F.lit(float(k))
    num = n * F.col("m_cal") + kk * F.col("g_cal")
    den = n * F.col("m_ref") + kk * F.col("g_ref")
    ratio = (F.when(den != 0, num / den)
             .when(num > 0, F.lit(float(hi)))
             .when(num < 0, F.lit(float(lo))))
    return (stats.crossJoin(F.broadcast(g.select("g_ref", "g_cal")))
            .select("geohash", clip(ratio, lo, hi).alias("scale")))


def plain_scale(stats: DataFrame, lo: float = 0.1, hi: float = 10.0, keep=()) -> DataFrame:
    """``clip(m_cal / m_ref, lo, hi)`` with a zero reference mean → NULL."""
    ratio = F.try_divide(F.col("m_cal"), F.when(F.col("m_ref") != 0, F.col("m_ref")))
    return stats.select("geohash", *keep, clip(ratio, lo, hi).alias("scale"))


def daily_ratio(ref: DataFrame, cal: DataFrame, value: str = "demand",
                cell: str = "geohash") -> DataFrame:
    """Per cell: morning mean of the target day over morning mean of the reference day.

    Both per-cell means are aligned with a full outer join; a zero reference
    mean gives NULL.
    """
    m_ref = (ref.where(F.col("hour") < MORNING_HOURS_BEFORE).groupBy(cell)
             .agg(F.avg(value).alias("ref_am")))
    m_cal = (cal.where(F.col("hour") < MORNING_HOURS_BEFORE).groupBy(cell)
             .agg(F.avg(value).alias("cal_am")))
    j = m_ref.join(m_cal, [cell], "full_outer")
    return j.select(cell, "ref_am", "cal_am",
                    F.try_divide(F.col("cal_am"), F.when(F.col("ref_am") != 0, F.col("ref_am")))
                    .alias("daily_ratio"))
