"""Scalar feature functions and feature tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellcast.functions.timekeys import with_cyclical, with_time_flags
from cellcast.operators import features as FT
from cellcast.operators.lookups import Slots, attach_by_cell
from cellcast.plans.common import roles
from cellcast.plans.q_calibration import LOOKUP_CTES
from cellcast.plans.q_lookups import NEIGHBOR_SQL
from cellcast.plans.registry import query
from cellcast.plans.sqlparts import clip_sql, geohash_xy_ctes, rounded, rounded_but, with_roles

TWO_PI = f"(2 * pi())"


@query("cyclical_features", sql=rounded(with_roles() + f"""
SELECT row_id, sin({TWO_PI} * hour / 24.0) AS hour_sin, cos({TWO_PI} * hour / 24.0) AS hour_cos,
  sin({TWO_PI} * minute / 60.0) AS minute_sin, cos({TWO_PI} * minute / 60.0) AS minute_cos,
  sin({TWO_PI} * t / 1440.0) AS t_sin, cos({TWO_PI} * t / 1440.0) AS t_cos,
  sin({TWO_PI} * day / 7.0) AS day_sin, cos({TWO_PI} * day / 7.0) AS day_cos FROM p""",
    ["hour_sin", "hour_cos", "minute_sin", "minute_cos", "t_sin", "t_cos", "day_sin", "day_cos"]))
def cyclical_features(spark, sf_dir):
    o = with_cyclical(roles(spark, sf_dir).obs)
    return o.select("row_id", "hour_sin", "hour_cos", "minute_sin", "minute_cos", "t_sin", "t_cos", "day_sin", "day_cos")


@query("time_flags", sql=with_roles() + """
SELECT row_id, CAST(hour <= 5 AS INTEGER) AS is_early_morning, CAST(hour IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_rush_hour,
       CAST(hour IN (10, 11, 12, 13) AS INTEGER) AS is_midday FROM p""")
def time_flags(spark, sf_dir):
    return with_time_flags(roles(spark, sf_dir).obs).select("row_id", "is_early_morning", "is_rush_hour", "is_midday")


TRAIN_COUNT = ("cnt AS (SELECT geohash, count(*) AS c FROM (SELECT geohash FROM ref UNION ALL SELECT geohash FROM cal) "
               "GROUP BY geohash)")


@query("log_frequency", sql=rounded(with_roles(TRAIN_COUNT) + """
SELECT tgt."Index", ln(1 + coalesce(cnt.c, 0)) AS geohash_count FROM tgt LEFT JOIN cnt ON cnt.geohash = tgt.geohash""",
                                    ["geohash_count"]))
def log_frequency(spark, sf_dir):
    r = roles(spark, sf_dir)
    count = FT.cell_frequency(Slots(r.ref), Slots(r.cal))
    return attach_by_cell(r.tgt.select("Index", "geohash", "t"), count).select(
        "Index", F.coalesce("geohash_count", F.lit(0.0)).alias("geohash_count"))


@query("encode_fixed", sql=rounded(with_roles() + """
SELECT "Index", CASE RoadType WHEN 'Residential' THEN 0.0 WHEN 'Street' THEN 1.0 WHEN 'Highway' THEN 2.0 ELSE -1.0 END AS RoadType_enc,
  coalesce(CAST(LargeVehicles = 'Allowed' AS DOUBLE), 0.0) AS LargeVehicles_enc,
  coalesce(CAST(Landmarks = 'Yes' AS DOUBLE), 0.0) AS Landmarks_enc,
  CASE Weather WHEN 'Sunny' THEN 0.0 WHEN 'Rainy' THEN 1.0 WHEN 'Foggy' THEN 2.0 WHEN 'Snowy' THEN 3.0 ELSE -1.0 END AS Weather_enc
FROM tgt""", ["RoadType_enc", "LargeVehicles_enc", "Landmarks_enc", "Weather_enc"]))
def encode_fixed(spark, sf_dir):
    return FT.encode_fixed(roles(spark, sf_dir).tgt).select("Index", "RoadType_enc", "LargeVehicles_enc",
                                                           "Landmarks_enc", "Weather_enc")


@query("encode_domain", sql=with_roles() + """
, dom AS (SELECT feature, category, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY category) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT feature, category FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce({c}, 'Missing') AS category FROM (SELECT {c} FROM cal UNION ALL SELECT {c} FROM tgt)"
    for c in FT.CATEGORIES) + """)))
SELECT tgt."Index", """ + ", ".join(
    f"(SELECT code FROM dom WHERE feature = '{c}' AND category = coalesce(tgt.{c}, 'Missing')) AS {c}_code"
    for c in FT.CATEGORIES) + " FROM tgt")
def encode_domain(spark, sf_dir):
    """Alphabetical codes over the union domain of both tables (``Missing`` for NULL).

    The domain (distinct categories, a few rows per feature) is numbered with a
    window per feature and joined back to the rows.
    """
    from pyspark.sql import Window
    r = roles(spark, sf_dir)
    cats = FT.CATEGORIES
    both = r.cal.select(*cats).unionByName(r.tgt.select(*cats)).fillna(FT.MISSING, subset=cats)
    dom = (both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("category"))
                                           for c in cats])).alias("_x")).select("_x.*").distinct())
    dom = dom.withColumn("code", (F.dense_rank().over(Window.partitionBy("feature").orderBy("category")) - 1).cast("int"))
    out = r.tgt.select("Index", *cats).fillna(FT.MISSING, subset=cats)
    for c in cats:
        d = dom.where(F.col("feature") == c).select(F.col("category").alias(c), F.col("code").alias(f"{c}_code"))
        out = out.join(d, [c], "left")
    return out.select("Index", *[f"{c}_code" for c in cats])


@query("standardize", sql=rounded(with_roles() + """
, sc AS (SELECT avg(Temperature) AS mu, stddev_pop(Temperature) AS sd FROM ref WHERE Temperature IS NOT NULL AND demand IS NOT NULL)
SELECT "Index", (Temperature - mu) / sd AS temp_z FROM tgt CROSS JOIN sc""", ["temp_z"]))
def standardize(spark, sf_dir):
    """z-score with the reference mean and population std (what a fitted scaler stores)."""
    r = roles(spark, sf_dir)
    sc = (r.ref.where(F.col("Temperature").isNotNull() & F.col("demand").isNotNull())
          .agg(F.avg("Temperature").alias("_mu"), F.stddev_pop("Temperature").alias("_sd")))
    return r.tgt.crossJoin(F.broadcast(sc)).select(
        "Index", F.try_divide(F.col("Temperature") - F.col("_mu"), F.col("_sd")).alias("temp_z"))


# ---- residual feature table (16 numeric + 4 categorical) ------------------------------------------
RES_CTES = [
    "pr AS (SELECT c.geohash, c.demand AS d_cal, r.demand AS d_ref FROM cal c JOIN ref r ON c.geohash = r.geohash AND c.t = r.t)",
    "cs AS (SELECT geohash, count(d_ref) AS n, avg(d_ref) AS m_ref, avg(d_cal) AS m_cal FROM pr GROUP BY geohash)",
    "gs AS (SELECT (SELECT avg(demand) FROM ref WHERE hour <= 2) AS g_ref, (SELECT avg(demand) FROM cal) AS g_cal)",
    "offs AS (SELECT geohash, (n * (m_cal - m_ref)) / CASE WHEN n <> 0 THEN n END AS off FROM cs)",
    TRAIN_COUNT,
    """rx AS (SELECT tgt.*, ex.v AS e, gh.v AS h, g.v AS gg, p5.v AS a5, p4.v AS a4, ov.v AS o,
     (SELECT v FROM ex e2 WHERE e2.geohash = tgt.geohash AND e2.t = tgt.t - 15) AS l1,
     (SELECT v FROM ex e2 WHERE e2.geohash = tgt.geohash AND e2.t = tgt.t + 15) AS l2,
     (SELECT v FROM ex e2 WHERE e2.geohash = tgt.geohash AND e2.t = tgt.t - 30) AS l3,
     (SELECT v FROM ex e2 WHERE e2.geohash = tgt.geohash AND e2.t = tgt.t + 30) AS l4,
     coalesce(offs.off, gs.g_cal - gs.g_ref) AS go, ln(1 + coalesce(cnt.c, 0)) AS geohash_count
   FROM tgt LEFT JOIN ex ON ex.geohash = tgt.geohash AND ex.t = tgt.t
   LEFT JOIN gh ON gh.geohash = tgt.geohash AND gh.hour = tgt.hour LEFT JOIN g ON g.geohash = tgt.geohash
   LEFT JOIN p5 ON p5.k = substr(tgt.geohash, 1, 5) LEFT JOIN p4 ON p4.k = substr(tgt.geohash, 1, 4)
   LEFT JOIN offs ON offs.geohash = tgt.geohash LEFT JOIN cnt ON cnt.geohash = tgt.geohash CROSS JOIN gs CROSS JOIN ov)""",
    """rf AS (SELECT "Index", hour, minute, t, NumberofLanes, Temperature,
     coalesce(e, h, a5, a4, gg, o) + go AS exact_calib, coalesce(h, a5, a4, gg, o) + go AS geo_hour_calib,
     coalesce(gg, o) + go AS geo_calib, coalesce(a5, a4, gg, o) + go AS prefix5_calib, coalesce(a4, gg, o) + go AS prefix4_calib,
     coalesce(l1, coalesce(h, a5, a4, gg, o), o) + go AS lag_prev_calib, coalesce(l2, coalesce(h, a5, a4, gg, o), o) + go AS lag_next_calib,
     coalesce(l3, coalesce(h, a5, a4, gg, o), o) + go AS lag_prev2_calib, coalesce(l4, coalesce(h, a5, a4, gg, o), o) + go AS lag_next2_calib,
     go AS geo_offset, geohash_count,
     coalesce(RoadType, 'Missing') AS RoadType, coalesce(LargeVehicles, 'Missing') AS LargeVehicles,
     coalesce(Landmarks, 'Missing') AS Landmarks, coalesce(Weather, 'Missing') AS Weather, demand FROM rx)""",
]
RES_DOUBLES = ["Temperature", "exact_calib", "geo_hour_calib", "geo_calib", "prefix5_calib", "prefix4_calib",
               "lag_prev_calib", "lag_next_calib", "lag_prev2_calib", "lag_next2_calib", "geo_offset", "geohash_count",
               "base_pred", "demand"]


def residual_table(r):
    return FT.residual_features(r.ref, r.cal, r.tgt)


@query("feature_table_residual", sql=rounded(with_roles(*LOOKUP_CTES, *RES_CTES) + """
SELECT *, 0.4 * exact_calib + 0.3 * geo_hour_calib + 0.3 * geo_calib AS base_pred FROM rf""", RES_DOUBLES))
def feature_table_residual(spark, sf_dir):
    return residual_table(roles(spark, sf_dir))


@query("base_prediction", sql=rounded(with_roles(*LOOKUP_CTES, *RES_CTES) + """
SELECT "Index", 0.4 * exact_calib + 0.3 * geo_hour_calib + 0.3 * geo_calib AS base_pred,
       0.4 * (exact_calib - geo_offset) + 0.3 * (geo_hour_calib - geo_offset) + 0.3 * (geo_calib - geo_offset) AS base_pred_raw
FROM rf""", ["base_pred", "base_pred_raw"]))
def base_prediction(spark, sf_dir):
    t = residual_table(roles(spark, sf_dir))
    o = F.col("geo_offset")
    w = FT.BASE_WEIGHTS
    raw = w[0] * (F.col("exact_calib") - o) + w[1] * (F.col("geo_hour_calib") - o) + w[2] * (F.col("geo_calib") - o)
    return t.select("Index", "base_pred", raw.alias("base_pred_raw"))


# ---- neighbour feature table (34 columns) -------------------------------------------------------

def _nb_sql():
    lw_all = """lwa AS (SELECT geohash, t, demand AS v FROM (
  SELECT geohash, t, demand, row_number() OVER (PARTITION BY geohash, t ORDER BY row_id DESC) AS rn FROM tr) WHERE rn = 1)"""
    nbm = """nma AS (SELECT k.geohash, k.t, avg(lwa.v) AS m FROM (SELECT DISTINCT geohash, t FROM tgt) k
  JOIN nb ON nb.geohash = k.geohash JOIN lwa ON lwa.geohash = nb.neighbor AND lwa.t = k.t GROUP BY k.geohash, k.t)"""
    from cellcast.plans.sqlparts import geohash_neighbor_ctes
    ctes = ["tr AS (SELECT * FROM ref UNION ALL SELECT * FROM cal)", lw_all, *geohash_neighbor_ctes("tgt"), nbm,
            "cst AS (SELECT geohash, avg(demand) AS geo_mean, coalesce(stddev_samp(demand), 0.0) AS geo_std, "
            "median(demand) AS geo_median, max(demand) AS geo_max FROM tr GROUP BY geohash)",
            "ghm AS (SELECT geohash, hour, avg(demand) AS v FROM tr GROUP BY 1, 2)",
            "gtm AS (SELECT geohash, t, avg(demand) AS v FROM tr GROUP BY 1, 2)",
            "g3h AS (SELECT substr(geohash, 1, 3) AS k, hour, avg(demand) AS v FROM tr GROUP BY 1, 2)",
            "g3 AS (SELECT substr(geohash, 1, 3) AS k, avg(demand) AS v FROM tr GROUP BY 1)",
            "g4 AS (SELECT substr(geohash, 1, 4) AS k, avg(demand) AS v FROM tr GROUP BY 1)",
            "g5 AS (SELECT substr(geohash, 1, 5) AS k, avg(demand) AS v FROM tr GROUP BY 1)",
            "hrm AS (SELECT hour, avg(demand) AS v FROM tr GROUP BY 1)",
            "g49 AS (SELECT geohash, avg(demand) AS v FROM tr WHERE day = 49 GROUP BY 1)",
            "am AS (SELECT coalesce(a.geohash, b.geohash) AS geohash, CASE WHEN a.v <> 0 THEN b.v / a.v END AS ratio FROM "
            "(SELECT geohash, avg(demand) AS v FROM tr WHERE day = 48 AND hour < 4 GROUP BY 1) a FULL OUTER JOIN "
            "(SELECT geohash, avg(demand) AS v FROM tr WHERE day = 49 AND hour < 4 GROUP BY 1) b ON a.geohash = b.geohash)",
            ]
    lags = ",\n  ".join(
        f"(SELECT v FROM lwa WHERE lwa.geohash = tgt.geohash AND lwa.t = ((tgt.t - {d}) % 1440 + 1440) % 1440) AS raw_{n}"
        for n, d in (("lag1d", 0), ("lag1d_m15", 15), ("lag1d_m30", 30), ("lag1d_m45", 45), ("lag1d_m60", 60)))
    body = f"""
, xy AS (SELECT geohash, -90.0 + (y + 0.5) * 180.0 / pow(2.0, latb) AS lat, -180.0 + (x + 0.5) * 360.0 / pow(2.0, lonb) AS lon FROM gx)
, nx AS (SELECT tgt.*, xy.lat, xy.lon, {lags},
  CASE WHEN nma.m <> 0 THEN nma.m END AS neighbor_mean, cst.geo_mean, cst.geo_std, cst.geo_median, cst.geo_max,
  ghm.v AS geo_hour_mean, gtm.v AS geo_ts_mean, g3h.v AS geo3_hour_mean, g3.v AS geo3_mean, g4.v AS geo4_mean,
  g5.v AS geo5_mean, hrm.v AS hour_global_mean, g49.v AS geo_d49_mean, am.ratio AS daily_ratio
  FROM tgt LEFT JOIN xy ON xy.geohash = tgt.geohash LEFT JOIN nma ON nma.geohash = tgt.geohash AND nma.t = tgt.t
  LEFT JOIN cst ON cst.geohash = tgt.geohash LEFT JOIN ghm ON ghm.geohash = tgt.geohash AND ghm.hour = tgt.hour
  LEFT JOIN gtm ON gtm.geohash = tgt.geohash AND gtm.t = tgt.t
  LEFT JOIN g3h ON g3h.k = substr(tgt.geohash, 1, 3) AND g3h.hour = tgt.hour LEFT JOIN g3 ON g3.k = substr(tgt.geohash, 1, 3)
  LEFT JOIN g4 ON g4.k = substr(tgt.geohash, 1, 4) LEFT JOIN g5 ON g5.k = substr(tgt.geohash, 1, 5)
  LEFT JOIN hrm ON hrm.hour = tgt.hour LEFT JOIN g49 ON g49.geohash = tgt.geohash LEFT JOIN am ON am.geohash = tgt.geohash)
SELECT "Index", lat, lon, hour, minute, day, sin({TWO_PI} * t / 1440.0) AS time_sin, cos({TWO_PI} * t / 1440.0) AS time_cos,
  sin({TWO_PI} * day / 7.0) AS day_sin, cos({TWO_PI} * day / 7.0) AS day_cos,
  CASE RoadType WHEN 'Residential' THEN 0.0 WHEN 'Street' THEN 1.0 WHEN 'Highway' THEN 2.0 ELSE -1.0 END AS RoadType_enc,
  NumberofLanes, coalesce(CAST(LargeVehicles = 'Allowed' AS DOUBLE), 0.0) AS LargeVehicles_enc,
  coalesce(CAST(Landmarks = 'Yes' AS DOUBLE), 0.0) AS Landmarks_enc, Temperature,
  CASE Weather WHEN 'Sunny' THEN 0.0 WHEN 'Rainy' THEN 1.0 WHEN 'Foggy' THEN 2.0 WHEN 'Snowy' THEN 3.0 ELSE -1.0 END AS Weather_enc,
  {", ".join(f"coalesce(raw_{n}, neighbor_mean, geo_ts_mean, geo_hour_mean) AS {n}" for n in FT.NEIGHBOR_LAGS.values())},
  neighbor_mean, geo_mean, geo_std, geo_median, geo_max, geo_hour_mean, geo_ts_mean, geo3_hour_mean, geo3_mean,
  geo4_mean, geo5_mean, hour_global_mean, geo_d49_mean, daily_ratio, demand FROM nx"""
    xy = geohash_xy_ctes("tgt")
    nbc = [c for c in ctes]
    # gc/gx are defined inside the neighbour CTE list already; reuse them for lat/lon
    return with_roles(*nbc) + body


@query("feature_table_neighbor", sql=rounded_but(_nb_sql(), ("Index", "hour", "minute", "day", "NumberofLanes")))
def feature_table_neighbor(spark, sf_dir):
    r = roles(spark, sf_dir)
    return FT.neighbor_features(r.ref.unionByName(r.cal), r.tgt)


# ---- stacking feature table (64 numeric + 8 lags + 4 categorical) ----------------------------------
STACK_LAGS = [f"d48_lag_-{d}" for d in FT.STACK_LAG_MINUTES] + [f"d48_lag_+{d}" for d in FT.STACK_LAG_MINUTES]


def _q(c):
    return f'"{c}"'


def _stack_sql():
    lag_cols = ",\n  ".join(
        f"(SELECT v FROM ex e2 WHERE e2.geohash = tgt.geohash AND e2.t = tgt.t + ({'-' if '-' in n else ''}{n.split('_')[-1][1:]})) AS {_q('raw' + n)}"
        for n in STACK_LAGS)
    scale = clip_sql("CASE WHEN (n * m_ref + 1.0 * g_ref) <> 0 THEN (n * m_cal + 1.0 * g_cal) / (n * m_ref + 1.0 * g_ref) "
                     "WHEN (n * m_cal + 1.0 * g_cal) > 0 THEN 10.0 WHEN (n * m_cal + 1.0 * g_cal) < 0 THEN 0.1 END", 0.1, 10.0)
    ctes = [
        "spr AS (SELECT c.geohash, c.demand AS d_cal, r.demand AS d_ref FROM cal c JOIN ref r ON c.geohash = r.geohash AND c.t = r.t)",
        "scs AS (SELECT geohash, count(d_ref) AS n, avg(d_ref) AS m_ref, avg(d_cal) AS m_cal FROM spr GROUP BY geohash)",
        "sgs AS (SELECT (SELECT avg(demand) FROM ref WHERE hour <= 2) AS g_ref, (SELECT avg(demand) FROM cal) AS g_cal)",
        f"scal AS (SELECT geohash, (n * (m_cal - m_ref)) / CASE WHEN n <> 0 THEN n END AS off, {scale} AS sc FROM scs CROSS JOIN sgs)",
        "sglob AS (SELECT g_cal - g_ref AS go, CASE WHEN g_ref > 0 THEN " + clip_sql("g_cal / g_ref", 0.5, 3.0)
        + " ELSE 1.0 END AS gs FROM sgs)",
        "ghs AS (SELECT geohash, hour, coalesce(stddev_samp(demand), 0.0) AS v FROM ref GROUP BY 1, 2)",
        "cst AS (SELECT geohash, coalesce(stddev_samp(demand), 0.0) AS sd, max(demand) AS mx, min(demand) AS mn, "
        "median(demand) AS md, count(*) AS nobs FROM ref GROUP BY 1)",
        "p5s AS (SELECT substr(geohash, 1, 5) AS k, coalesce(stddev_samp(demand), 0.0) AS v FROM ref GROUP BY 1)",
        "p4s AS (SELECT substr(geohash, 1, 4) AS k, coalesce(stddev_samp(demand), 0.0) AS v FROM ref GROUP BY 1)",
        "hs AS (SELECT hour, avg(demand) AS m, coalesce(stddev_samp(demand), 0.0) AS s, median(demand) AS md FROM ref GROUP BY 1)",
        "rh AS (SELECT RoadType, hour, avg(demand) AS v FROM ref WHERE RoadType IS NOT NULL GROUP BY 1, 2)",
        "rr AS (SELECT RoadType, avg(demand) AS v FROM ref WHERE RoadType IS NOT NULL GROUP BY 1)",
        "wh AS (SELECT Weather, hour, avg(demand) AS v FROM ref WHERE Weather IS NOT NULL GROUP BY 1, 2)",
        f"tm AS (SELECT coalesce(median(Temperature), {FT.DEFAULT_TEMPERATURE}) AS v FROM tgt)",
        TRAIN_COUNT,
        f"""sx AS (SELECT tgt.*, ex.v AS e, gh.v AS h, g.v AS gg, p5.v AS a5, p4.v AS a4, p3.v AS a3, ov.v AS o,
  ghs.v AS ghsd, cst.sd, cst.mx, cst.mn, cst.md, cst.nobs, p5s.v AS p5sd, p4s.v AS p4sd,
  hs.m AS hm, hs.s AS hsd, hs.md AS hmd, rh.v AS rhm, rr.v AS rm, wh.v AS whm, tm.v AS tmed,
  coalesce(scal.off, sglob.go) AS geo_offset, coalesce(scal.sc, sglob.gs) AS geo_scale, ln(1 + coalesce(cnt.c, 0)) AS geohash_count,
  {lag_cols}
  FROM tgt LEFT JOIN ex ON ex.geohash = tgt.geohash AND ex.t = tgt.t
  LEFT JOIN gh ON gh.geohash = tgt.geohash AND gh.hour = tgt.hour LEFT JOIN g ON g.geohash = tgt.geohash
  LEFT JOIN p5 ON p5.k = substr(tgt.geohash, 1, 5) LEFT JOIN p4 ON p4.k = substr(tgt.geohash, 1, 4)
  LEFT JOIN p3 ON p3.k = substr(tgt.geohash, 1, 3)
  LEFT JOIN ghs ON ghs.geohash = tgt.geohash AND ghs.hour = tgt.hour LEFT JOIN cst ON cst.geohash = tgt.geohash
  LEFT JOIN p5s ON p5s.k = substr(tgt.geohash, 1, 5) LEFT JOIN p4s ON p4s.k = substr(tgt.geohash, 1, 4)
  LEFT JOIN hs ON hs.hour = tgt.hour LEFT JOIN rh ON rh.RoadType = tgt.RoadType AND rh.hour = tgt.hour
  LEFT JOIN rr ON rr.RoadType = tgt.RoadType LEFT JOIN wh ON wh.Weather = tgt.Weather AND wh.hour = tgt.hour
  LEFT JOIN scal ON scal.geohash = tgt.geohash LEFT JOIN cnt ON cnt.geohash = tgt.geohash
  CROSS JOIN ov CROSS JOIN sglob CROSS JOIN tm)""",
        f"""sy AS (SELECT "Index", hour, minute, t, NumberofLanes, Temperature AS traw, coalesce(Temperature, tmed) AS Temperature,
  coalesce(e, h, a5, a4, a3, gg, o) AS d48_exact, coalesce(h, a5, a4, gg, o) AS d48_geo_hour,
  coalesce(ghsd, 0.0) AS d48_geo_hour_std, coalesce(gg, o) AS d48_geo, coalesce(sd, 0.0) AS d48_geo_std,
  coalesce(mx, o) AS d48_geo_max, coalesce(mn, o) AS d48_geo_min, coalesce(md, o) AS d48_geo_median,
  coalesce(a5, a4, gg, o) AS prefix5_mean, coalesce(a4, gg, o) AS prefix4_mean, coalesce(a3, o) AS prefix3_mean,
  coalesce(p5sd, 0.0) AS prefix5_std, coalesce(p4sd, 0.0) AS prefix4_std, coalesce(CAST(nobs AS DOUBLE), 0.0) AS d48_geo_n_obs,
  coalesce(hm, o) AS d48_hour_mean, coalesce(hsd, 0.0) AS d48_hour_std, coalesce(hmd, o) AS d48_hour_median,
  coalesce(rhm, o) AS d48_roadtype_hour_mean, coalesce(rm, o) AS d48_roadtype_mean, coalesce(whm, o) AS d48_weather_hour_mean,
  geo_offset, geo_scale, geohash_count,
  {", ".join(f"coalesce({_q('raw' + n)}, coalesce(h, a5, a4, gg, o), o) AS {_q(n)}" for n in STACK_LAGS)},
  coalesce(RoadType, 'Missing') AS RoadType, coalesce(LargeVehicles, 'Missing') AS LargeVehicles,
  coalesce(Landmarks, 'Missing') AS Landmarks, coalesce(Weather, 'Missing') AS Weather, demand FROM sx)""",
    ]
    neg = [_q(n) for n in STACK_LAGS[:4]]
    pos = [_q(n) for n in STACK_LAGS[4:]]
    alll = neg + pos
    mean_all = f"((0.0 + {' + '.join(alll)}) / 8)"
    std_all = f"sqrt((0.0 + {' + '.join(f'power({c} - {mean_all}, 2)' for c in alll)}) / 7)"
    body = f"""
SELECT "Index", hour, minute, t, NumberofLanes, Temperature,
  sin({TWO_PI} * hour / 24.0) AS hour_sin, cos({TWO_PI} * hour / 24.0) AS hour_cos,
  sin({TWO_PI} * minute / 60.0) AS minute_sin, cos({TWO_PI} * minute / 60.0) AS minute_cos,
  sin({TWO_PI} * t / 1440.0) AS t_sin, cos({TWO_PI} * t / 1440.0) AS t_cos,
  CAST(hour <= 5 AS INTEGER) AS is_early_morning, CAST(hour IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_rush_hour,
  CAST(hour IN (10, 11, 12, 13) AS INTEGER) AS is_midday,
  d48_exact, d48_geo_hour, d48_geo_hour_std, d48_geo, d48_geo_std, d48_geo_max, d48_geo_min, d48_geo_median,
  prefix5_mean, prefix4_mean, prefix3_mean, prefix5_std, prefix4_std, d48_geo_n_obs,
  d48_hour_mean, d48_hour_std, d48_hour_median, d48_roadtype_hour_mean, d48_roadtype_mean, d48_weather_hour_mean,
  geo_offset, geo_scale,
  d48_exact + geo_offset AS exact_add, d48_geo_hour + geo_offset AS geo_hour_add, d48_geo + geo_offset AS geo_add,
  d48_exact * geo_scale AS exact_mult, d48_geo_hour * geo_scale AS geo_hour_mult, d48_geo * geo_scale AS geo_mult,
  d48_geo_max - d48_geo_min AS geo_range, d48_geo_std / (d48_geo + 1e-8) AS geo_cv,
  d48_geo_hour_std / (d48_geo_hour + 1e-8) AS geo_hour_cv,
  d48_exact - d48_geo AS exact_vs_geo, d48_exact - d48_geo_hour AS exact_vs_geo_hour,
  d48_geo - d48_hour_mean AS geo_vs_hour_mean, d48_exact - d48_hour_mean AS exact_vs_hour_mean, geohash_count,
  power(traw, 2) AS temp_sq, abs(traw) AS temp_abs, CAST(traw IS NULL AS INTEGER) AS temp_missing,
  NumberofLanes * d48_exact AS lanes_x_exact, Temperature * hour AS temp_x_hour,
  0.4 * (d48_exact + geo_offset) + 0.3 * (d48_geo_hour + geo_offset) + 0.3 * (d48_geo + geo_offset) AS base_pred_add,
  0.4 * (d48_exact * geo_scale) + 0.3 * (d48_geo_hour * geo_scale) + 0.3 * (d48_geo * geo_scale) AS base_pred_mult,
  0.4 * d48_exact + 0.3 * d48_geo_hour + 0.3 * d48_geo AS base_pred_raw,
  0.5 * (0.4 * (d48_exact + geo_offset) + 0.3 * (d48_geo_hour + geo_offset) + 0.3 * (d48_geo + geo_offset))
    + 0.5 * (0.4 * (d48_exact * geo_scale) + 0.3 * (d48_geo_hour * geo_scale) + 0.3 * (d48_geo * geo_scale)) AS base_pred_blend,
  {", ".join(alll)}, RoadType, LargeVehicles, Landmarks, Weather, demand,
  (0.0 + {' + '.join(neg)}) / 4 AS lag_mean_neg, (0.0 + {' + '.join(pos)}) / 4 AS lag_mean_pos,
  {mean_all} AS lag_mean_all, {std_all} AS lag_std_all,
  (0.0 + {' + '.join(pos)}) / 4 - (0.0 + {' + '.join(neg)}) / 4 AS lag_trend
FROM sy"""
    return with_roles(*LOOKUP_CTES, *ctes) + body


STACK_INTS = {"Index", "hour", "minute", "t", "NumberofLanes", "is_early_morning", "is_rush_hour", "is_midday",
              "temp_missing", "RoadType", "LargeVehicles", "Landmarks", "Weather"}


def _stack_doubles():
    cols = ["Temperature", "hour_sin", "hour_cos", "minute_sin", "minute_cos", "t_sin", "t_cos",
            "d48_exact", "d48_geo_hour", "d48_geo_hour_std", "d48_geo", "d48_geo_std", "d48_geo_max", "d48_geo_min",
            "d48_geo_median", "prefix5_mean", "prefix4_mean", "prefix3_mean", "prefix5_std", "prefix4_std",
            "d48_geo_n_obs", "d48_hour_mean", "d48_hour_std", "d48_hour_median", "d48_roadtype_hour_mean",
            "d48_roadtype_mean", "d48_weather_hour_mean", "geo_offset", "geo_scale", "exact_add", "geo_hour_add",
            "geo_add", "exact_mult", "geo_hour_mult", "geo_mult", "geo_range", "geo_cv", "geo_hour_cv", "exact_vs_geo",
            "exact_vs_geo_hour", "geo_vs_hour_mean", "exact_vs_hour_mean", "geohash_count", "temp_sq", "temp_abs",
            "lanes_x_exact", "temp_x_hour", "base_pred_add", "base_pred_mult", "base_pred_raw", "base_pred_blend",
            *STACK_LAGS, "demand", "lag_mean_neg", "lag_mean_pos", "lag_mean_all", "lag_std_all", "lag_trend"]
    return cols


@query("feature_table_stack", sql=rounded(_stack_sql(), _stack_doubles()))
def feature_table_stack(spark, sf_dir):
    r = roles(spark, sf_dir)
    return FT.stack_features(r.ref, r.cal, r.tgt)


@query("lag_row_stats", sql=rounded(_stack_sql().replace("\nSELECT \"Index\", hour, minute", "\n, fin AS (SELECT \"Index\", hour, minute", 1)
                                    + ')\nSELECT "Index", lag_mean_neg, lag_mean_pos, lag_mean_all, lag_std_all, lag_trend FROM fin',
                                    ["lag_mean_neg", "lag_mean_pos", "lag_mean_all", "lag_std_all", "lag_trend"]))
def lag_row_stats(spark, sf_dir):
    """Row-wise mean/std over the eight filled lag columns (sample std)."""
    return feature_table_stack(spark, sf_dir).select("Index", "lag_mean_neg", "lag_mean_pos", "lag_mean_all",
                                                     "lag_std_all", "lag_trend")


@query("derived_features", sql=rounded(_stack_sql().replace("\nSELECT \"Index\", hour, minute", "\n, fin AS (SELECT \"Index\", hour, minute", 1)
                                       + ')\nSELECT "Index", geo_range, geo_cv, geo_hour_cv, exact_vs_geo, exact_vs_geo_hour, '
                                       'geo_vs_hour_mean, exact_vs_hour_mean, temp_sq, temp_abs, temp_missing, lanes_x_exact, '
                                       'temp_x_hour FROM fin',
                                       ["geo_range", "geo_cv", "geo_hour_cv", "exact_vs_geo", "exact_vs_geo_hour",
                                        "geo_vs_hour_mean", "exact_vs_hour_mean", "temp_sq", "temp_abs", "lanes_x_exact",
                                        "temp_x_hour"]))
def derived_features(spark, sf_dir):
    """Ranges, coefficients of variation, contrasts, squares and interactions."""
    return feature_table_stack(spark, sf_dir).select(
        "Index", "geo_range", "geo_cv", "geo_hour_cv", "exact_vs_geo", "exact_vs_geo_hour", "geo_vs_hour_mean",
        "exact_vs_hour_mean", "temp_sq", "temp_abs", "temp_missing", "lanes_x_exact", "temp_x_hour")
