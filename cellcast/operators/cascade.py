"""Lookup cascades: resolve each target row at the finest level that has a value.

All lookups are resolved on the *distinct* ``(cell, t, hour)`` keys of the rows,
then attached to the rows with a single join on ``(cell, t)``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.functions.numeric import clip
from cellcast.operators import asof
from cellcast.operators.calibration import (global_baselines, global_offset_scale, pair_stats,
                                            plain_scale, shrunk_offset, shrunk_scale)
from cellcast.operators.lookups import ReferenceLookups, as_slots, with_prefix_columns

CELL = "geohash"


LEVELS = ("exact", "geo_hour", "geo", "prefix5", "prefix4", "prefix3", "overall")


def resolve_levels(keys: DataFrame, lk: ReferenceLookups, prefix_weight: str = "row", levels: Sequence[str] = LEVELS) -> DataFrame:
    """Distinct keys ``(geohash, t, hour)`` → the lookup levels asked for (all, and the overall mean)."""
    k = with_prefix_columns(keys.select(CELL, "t", "hour").distinct())
    if "exact" in levels:
        k = k.join(lk.exact(), [CELL, "t"], "left")
    if "geo_hour" in levels:
        k = k.join(lk.geo_hour(), [CELL, "hour"], "left")
    if "geo" in levels:
        k = k.join(lk.geo(), [CELL], "left")
    for n in (5, 4, 3):
        if f"prefix{n}" in levels:
            k = k.join(lk.prefix(n, weight=prefix_weight), [f"prefix{n}"], "left")
    return k.crossJoin(F.broadcast(lk.overall())) if "overall" in levels else k


def first_level(steps: Sequence[tuple[str, Column]], default: tuple[str, Column]) -> tuple[Column, Column]:
    """``(value, level)`` of the first non-NULL step, else the default."""
    value = F.coalesce(*[c for _, c in steps], default[1])
    level = F.lit(default[0])
    for name, c in reversed(steps):
        level = F.when(c.isNotNull(), F.lit(name)).otherwise(level)
    return value, level


class CascadeInputs:
    """Shared inputs of the lookup cascades over (reference, calibration, rows)."""

    def __init__(self, ref: DataFrame, cal: DataFrame, rows: DataFrame, baseline: str = "overlap",
                 prefix_weight: str = "row"):
        self.ref, self.cal, self.rows = as_slots(ref), as_slots(cal), rows
        self.lk = ReferenceLookups(self.ref)
        self.stats = pair_stats(self.cal, self.ref)
        self.g = global_offset_scale(global_baselines(self.ref, self.cal, baseline))
        self.keys = resolve_levels(rows, self.lk, prefix_weight)

    def attach(self, resolved: DataFrame, cols: Sequence[str], row_key: str = "Index") -> DataFrame:
        return (self.rows.select(row_key, CELL, "t")
                .join(resolved.select(CELL, "t", *cols), [CELL, "t"], "left")
                .select(row_key, *cols))


def memorize_cascades(ref: DataFrame, cal: DataFrame, rows: DataFrame, lo: float = 0.0,
                      hi: float = 1.0, row_key: str = "Index") -> DataFrame:
    """Additive, multiplicative and 50/50 blended cascades over the reference lookups.

    * additive: exact → cell×hour → prefix5 → prefix4 → cell → prefix3, each plus
      the cell's mean paired difference (global offset when the cell has no pair);
      last resort overall mean + global offset.  Global offset is measured on the
      reference slots that occur in the calibration period.
    * multiplicative: exact → cell×hour → cell, each times the cell scale
      ``clip(m_cal/m_ref, 0.1, 10)`` (global scale ``g_cal/g_ref`` if ``g_ref > 0``
      else 1); then prefix5 *plus offset*; last resort overall × global scale.
    * blend: mean of the two.  All three clipped to ``[lo, hi]``.
    """
    ci = CascadeInputs(ref, cal, rows, baseline="overlap")
    cell = plain_scale(ci.stats.withColumnRenamed("mean_diff", "_off"), 0.1, 10.0, keep=["_off"])
    k = (ci.keys.join(cell.withColumnRenamed("scale", "_sc"), [CELL], "left")
         .crossJoin(F.broadcast(ci.g.select("global_offset", "global_scale"))))
    off = F.coalesce(F.col("_off"), F.col("global_offset")).alias("offset")
    k = k.withColumn("offset", off).withColumn("scale", F.coalesce(F.col("_sc"), F.col("global_scale")))
    o, s = F.col("offset"), F.col("scale")
    add_val, add_lvl = first_level(
        [("exact", F.col("ref_exact") + o), ("geo_hour", F.col("ref_geo_hour") + o),
         ("prefix5", F.col("prefix5_mean") + o), ("prefix4", F.col("prefix4_mean") + o),
         ("geo", F.col("ref_geo") + o), ("prefix3", F.col("prefix3_mean") + o)],
        ("global", F.col("overall_mean") + F.col("global_offset")))
    mult_val, mult_lvl = first_level(
        [("exact", F.col("ref_exact") * s), ("geo_hour", F.col("ref_geo_hour") * s),
         ("geo", F.col("ref_geo") * s), ("prefix5", F.col("prefix5_mean") + o)],
        ("global", F.col("overall_mean") * F.col("global_scale")))
    add_c = clip(add_val, lo, hi)
    mult_c = clip(mult_val, lo, hi)
    k = k.select(CELL, "t", "offset", "scale",
                 add_lvl.alias("level"), add_c.alias("pred_add"),
                 mult_lvl.alias("level_mult"), mult_c.alias("pred_mult"),
                 clip(F.lit(0.5) * add_c + F.lit(0.5) * mult_c, lo, hi).alias("pred_blend"))
    return ci.attach(k, ["level", "offset", "scale", "pred_add", "level_mult", "pred_mult", "pred_blend"],
                     row_key)


def interp_levels(ref: DataFrame, keys: DataFrame, edge: str = "null", prefix_weight: str = "row") -> DataFrame:
    """``(cell, t, level, base)`` of distinct keys: exact → interpolation → prefix5 → prefix4 → cell → overall."""
    ref = as_slots(ref)
    keys = resolve_levels(keys, ReferenceLookups(ref), prefix_weight)
    br = asof.interpolate(asof.brackets(keys.select(CELL, "t"), asof.series(ref)), edge=edge)
    k = keys.join(br.select(CELL, "t", "interp"), [CELL, "t"], "left")
    base, level = first_level(
        [("exact", F.col("ref_exact")), ("interp", F.col("interp")),
         ("prefix5", F.col("prefix5_mean")), ("prefix4", F.col("prefix4_mean")),
         ("geo", F.col("ref_geo"))],
        ("global", F.col("overall_mean")))
    return k.select(CELL, "t", level.alias("level"), base.alias("base"))


def interp_cascade(ref: DataFrame, rows: DataFrame, edge: str = "null", prefix_weight: str = "row",
                   row_key: str = "Index") -> DataFrame:
    """Uncalibrated base of each row, resolved per key (``interp_levels``)."""
    k = interp_levels(ref, rows, edge, prefix_weight)
    return (rows.select(row_key, CELL, "t").join(k, [CELL, "t"], "left")
            .select(row_key, CELL, "level", "base"))


def compare_cascades(ref: DataFrame, cal: DataFrame, rows: DataFrame, k: float = 1.0,
                     row_key: str = "Index") -> DataFrame:
    """Old vs new cascade, both times a shrunk cell scale and floored at 0.

    old: exact → cell×hour → cell → overall (labels exact/geo_hour/geo/global).
    new: exact → interpolation with nearest edges (cells with a series) →
    prefix5 → prefix4 of cell means → cell/overall.  Scale: k-shrunk
    multiplicative, clip [0.1, 10], global ``clip(g_cal/g_ref, 0.5, 3)`` over
    the whole reference slice.  A NULL reference value moves to the next level.
    """
    ref, cal = as_slots(ref), as_slots(cal)
    lk = ReferenceLookups(ref)
    keys = resolve_levels(rows, lk, prefix_weight="cell")
    ser = asof.series(ref)
    br = asof.interpolate(asof.brackets(keys.select(CELL, "t"), ser), edge="nearest")
    g = global_offset_scale(global_baselines(ref, cal, "all"), 0.5, 3.0)
    scale = shrunk_scale(pair_stats(cal, ref), g, k, 0.1, 10.0)
    kk = (keys.join(br.select(CELL, "t", "interp"), [CELL, "t"], "left")
          .join(scale, [CELL], "left")
          .crossJoin(F.broadcast(g.select("global_scale"))))
    s = F.coalesce(F.col("scale"), F.col("global_scale"))
    old_v, old_l = first_level([("exact", F.col("ref_exact")), ("geo_hour", F.col("ref_geo_hour")),
                                ("geo", F.col("ref_geo"))], ("global", F.col("overall_mean")))
    new_v, new_l = first_level([("exact", F.col("ref_exact")), ("interp", F.col("interp")),
                                ("prefix5", F.col("prefix5_mean")), ("prefix4", F.col("prefix4_mean")),
                                ("geo", F.col("ref_geo"))], ("global", F.col("overall_mean")))
    kk = kk.select(CELL, "t", s.alias("scale"),
                   old_l.alias("level_old"), clip(old_v * s, 0.0, None).alias("pred_old"),
                   new_l.alias("level_new"), clip(new_v * s, 0.0, None).alias("pred_new"))
    return (rows.select(row_key, CELL, "t").join(kk, [CELL, "t"], "left")
            .select(row_key, "scale", "level_old", "pred_old", "level_new", "pred_new"))
