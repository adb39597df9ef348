"""Calibration and cascade queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.operators import cascade
from cellcast.plans.common import roles
from cellcast.plans.registry import query
from cellcast.plans.sqlparts import clip_sql, rounded, with_roles

# Reference lookups at every grain, DuckDB side.
LOOKUP_CTES = [
    "ex AS (SELECT geohash, t, avg(demand) AS v FROM ref GROUP BY geohash, t)",
    "gh AS (SELECT geohash, hour, avg(demand) AS v FROM ref GROUP BY geohash, hour)",
    "g AS (SELECT geohash, avg(demand) AS v FROM ref GROUP BY geohash)",
    "p5 AS (SELECT substr(geohash, 1, 5) AS k, avg(demand) AS v FROM ref GROUP BY 1)",
    "p4 AS (SELECT substr(geohash, 1, 4) AS k, avg(demand) AS v FROM ref GROUP BY 1)",
    "p3 AS (SELECT substr(geohash, 1, 3) AS k, avg(demand) AS v FROM ref GROUP BY 1)",
    "ov AS (SELECT avg(demand) AS v FROM ref)",
]
# memorize-style calibration: raw pairs on (cell, slot) against overlapping reference slots
PAIR_CTES = [
    "early AS (SELECT * FROM ref WHERE t IN (SELECT t FROM cal))",
    "pairs AS (SELECT c.geohash, c.demand AS d_cal, r.demand AS d_ref FROM cal c "
    "JOIN early r ON c.geohash = r.geohash AND c.t = r.t)",
    "cellcal AS (SELECT geohash, avg(d_cal - d_ref) AS off, "
    f"CASE WHEN avg(d_ref) <> 0 THEN {clip_sql('avg(d_cal) / avg(d_ref)', 0.1, 10.0)} END AS sc "
    "FROM pairs GROUP BY geohash)",
    "gl AS (SELECT (SELECT avg(demand) FROM cal) - (SELECT avg(demand) FROM early) AS go, "
    "CASE WHEN (SELECT avg(demand) FROM early) > 0 "
    "THEN (SELECT avg(demand) FROM cal) / (SELECT avg(demand) FROM early) ELSE 1.0 END AS gs)",
]
MEMO_X = """x AS (
  SELECT tg."Index", ex.v AS e, gh.v AS h, g.v AS gg, p5.v AS a5, p4.v AS a4, p3.v AS a3,
         coalesce(cc.off, gl.go) AS "offset", coalesce(cc.sc, gl.gs) AS scale,
         ov.v + gl.go AS glob_add, ov.v * gl.gs AS glob_mult
  FROM tgt tg
  LEFT JOIN ex ON ex.geohash = tg.geohash AND ex.t = tg.t
  LEFT JOIN gh ON gh.geohash = tg.geohash AND gh.hour = tg.hour
  LEFT JOIN g ON g.geohash = tg.geohash
  LEFT JOIN p5 ON p5.k = substr(tg.geohash, 1, 5)
  LEFT JOIN p4 ON p4.k = substr(tg.geohash, 1, 4)
  LEFT JOIN p3 ON p3.k = substr(tg.geohash, 1, 3)
  LEFT JOIN cellcal cc ON cc.geohash = tg.geohash
  CROSS JOIN gl CROSS JOIN ov)"""

ADD_LEVEL = """CASE WHEN e IS NOT NULL THEN 'exact' WHEN h IS NOT NULL THEN 'geo_hour'
  WHEN a5 IS NOT NULL THEN 'prefix5' WHEN a4 IS NOT NULL THEN 'prefix4'
  WHEN gg IS NOT NULL THEN 'geo' WHEN a3 IS NOT NULL THEN 'prefix3' ELSE 'global' END"""
ADD_VALUE = """greatest(0.0, least(1.0, coalesce(e + "offset", h + "offset", a5 + "offset",
  a4 + "offset", gg + "offset", a3 + "offset", glob_add)))"""
MULT_LEVEL = """CASE WHEN e IS NOT NULL THEN 'exact' WHEN h IS NOT NULL THEN 'geo_hour'
  WHEN gg IS NOT NULL THEN 'geo' WHEN a5 IS NOT NULL THEN 'prefix5' ELSE 'global' END"""
MULT_VALUE = """greatest(0.0, least(1.0, coalesce(e * scale, h * scale, gg * scale,
  a5 + "offset", glob_mult)))"""


def _memo(spark, sf_dir):
    r = roles(spark, sf_dir)
    return cascade.memorize_cascades(r.ref, r.cal, r.tgt)


@query("cascade_additive",
       sql=rounded(with_roles(*LOOKUP_CTES, *PAIR_CTES, MEMO_X)
                   + f'SELECT "Index", {ADD_LEVEL} AS level, "offset", {ADD_VALUE} AS demand FROM x',
                   ["offset", "demand"]))
def cascade_additive(spark, sf_dir):
    return _memo(spark, sf_dir).select("Index", "level", "offset", F.col("pred_add").alias("demand"))


@query("cascade_multiplicative",
       sql=rounded(with_roles(*LOOKUP_CTES, *PAIR_CTES, MEMO_X)
                   + f'SELECT "Index", {MULT_LEVEL} AS level, scale, {MULT_VALUE} AS demand FROM x',
                   ["scale", "demand"]))
def cascade_multiplicative(spark, sf_dir):
    return _memo(spark, sf_dir).select("Index", F.col("level_mult").alias("level"), "scale",
                                       F.col("pred_mult").alias("demand"))


# --- calibration operators on their own (D1–D4) ---------------------------------------------
from cellcast.operators.calibration import (global_baselines, global_offset_scale, pair_stats,  # noqa: E402
                                            plain_scale, shrunk_offset, shrunk_scale)

# pairs on (cell, slot) against the whole reference day; baseline = reference hours <= 2
TRAIN_CTES = [
    "pr AS (SELECT c.geohash, c.demand AS d_cal, r.demand AS d_ref FROM cal c JOIN ref r ON c.geohash = r.geohash AND c.t = r.t)",
    "cs AS (SELECT geohash, count(d_ref) AS n, avg(d_ref) AS m_ref, avg(d_cal) AS m_cal FROM pr GROUP BY geohash)",
    "gs AS (SELECT (SELECT avg(demand) FROM ref WHERE hour <= 2) AS g_ref, (SELECT avg(demand) FROM cal) AS g_cal)",
    "cells AS (SELECT DISTINCT geohash FROM tgt)",
]


def _shrunk_sql(k):
    return (f"(n * (m_cal - m_ref) + {float(k)!r} * (g_cal - g_ref)) / "
            f"CASE WHEN n + {float(k)!r} <> 0 THEN n + {float(k)!r} END")


@query("calibrate_additive", sql=rounded(with_roles(*TRAIN_CTES) + f"""
SELECT cells.geohash, coalesce({_shrunk_sql(0)}, gs.g_cal - gs.g_ref) AS offset_k0,
       coalesce({_shrunk_sql(2)}, gs.g_cal - gs.g_ref) AS offset_k2
FROM cells LEFT JOIN cs ON cs.geohash = cells.geohash CROSS JOIN gs""", ["offset_k0", "offset_k2"]))
def calibrate_additive(spark, sf_dir):
    """Per target cell: shrunk additive offset for k = 0 and k = 2 (global offset where no pair)."""
    r = roles(spark, sf_dir)
    stats = pair_stats(r.cal, r.ref)
    g = global_offset_scale(global_baselines(r.ref, r.cal, "hours"))
    cells = r.tgt.select("geohash").distinct()
    k0 = shrunk_offset(stats, g, 0.0).withColumnRenamed("offset", "_k0")
    k2 = shrunk_offset(stats, g, 2.0).withColumnRenamed("offset", "_k2")
    return (cells.join(k0, ["geohash"], "left").join(k2, ["geohash"], "left")
            .crossJoin(F.broadcast(g.select("global_offset")))
            .select("geohash", F.coalesce("_k0", "global_offset").alias("offset_k0"),
                    F.coalesce("_k2", "global_offset").alias("offset_k2")))


def _scale_sql(k, lo, hi):
    num = f"(n * m_cal + {float(k)!r} * g_cal)"
    den = f"(n * m_ref + {float(k)!r} * g_ref)"
    return clip_sql(f"CASE WHEN {den} <> 0 THEN {num} / {den} WHEN {num} > 0 THEN {float(hi)!r} "
                    f"WHEN {num} < 0 THEN {float(lo)!r} END", lo, hi)


@query("calibrate_multiplicative", sql=rounded(with_roles(*TRAIN_CTES) + f"""
SELECT cells.geohash, coalesce({_scale_sql(1, 0.1, 10.0)},
  CASE WHEN g_ref > 0 THEN {clip_sql('g_cal / g_ref', 0.5, 3.0)} ELSE 1.0 END) AS scale
FROM cells LEFT JOIN cs ON cs.geohash = cells.geohash CROSS JOIN gs""", ["scale"]))
def calibrate_multiplicative(spark, sf_dir):
    """Per target cell: k=1 shrunk scale clipped to [0.1, 10]; global ``clip(g_cal/g_ref, .5, 3)``."""
    r = roles(spark, sf_dir)
    g = global_offset_scale(global_baselines(r.ref, r.cal, "hours"), 0.5, 3.0)
    sc = shrunk_scale(pair_stats(r.cal, r.ref), g, 1.0, 0.1, 10.0)
    return (r.tgt.select("geohash").distinct().join(sc, ["geohash"], "left")
            .crossJoin(F.broadcast(g.select("global_scale")))
            .select("geohash", F.coalesce("scale", "global_scale").alias("scale")))


@query("scale_unsmoothed", sql=rounded(with_roles(*TRAIN_CTES) + f"""
SELECT geohash, CASE WHEN m_ref <> 0 THEN {clip_sql('m_cal / m_ref', 0.1, 10.0)} END AS scale FROM cs""", ["scale"]))
def scale_unsmoothed(spark, sf_dir):
    r = roles(spark, sf_dir)
    return plain_scale(pair_stats(r.cal, r.ref), 0.1, 10.0)


@query("global_offset_scale", sql=rounded(with_roles() + """
, b AS (SELECT 'hours' AS baseline, (SELECT avg(demand) FROM ref WHERE hour <= 2) AS g_ref
        UNION ALL SELECT 'overlap', (SELECT avg(demand) FROM ref WHERE t IN (SELECT t FROM cal))
        UNION ALL SELECT 'all', (SELECT avg(demand) FROM ref))
SELECT baseline, g_ref, (SELECT avg(demand) FROM cal) AS g_cal, (SELECT avg(demand) FROM cal) - g_ref AS global_offset,
       CASE WHEN g_ref > 0 THEN """ + clip_sql("(SELECT avg(demand) FROM cal) / g_ref", 0.5, 3.0) + """ ELSE 1.0 END AS global_scale
FROM b""", ["g_ref", "g_cal", "global_offset", "global_scale"]))
def global_offset_scale_q(spark, sf_dir):
    r = roles(spark, sf_dir)
    out = None
    for b in ("hours", "overlap", "all"):
        part = global_offset_scale(global_baselines(r.ref, r.cal, b), 0.5, 3.0).select(
            F.lit(b).alias("baseline"), "g_ref", "g_cal", "global_offset", "global_scale")
        out = part if out is None else out.unionByName(part)
    return out
