"""Profiles and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.operators import profile as PR
from cellcast.operators.blend import weight_table
from cellcast.plans.common import roles
from cellcast.plans.registry import query
from cellcast.plans.sqlparts import clip_sql, rounded, with_roles
from cellcast.sources.predictions import PRED_CTES, prediction_tables


@query("correlation", sql=rounded(with_roles() + """
, d AS (SELECT Temperature AS x, demand AS y FROM ref WHERE Temperature IS NOT NULL AND demand IS NOT NULL)
, s AS (SELECT corr(x, y) AS r, CAST(count(*) AS BIGINT) AS n, corr(x, y) * sqrt((count(*) - 2) / (1.0 - corr(x, y) * corr(x, y))) AS t_stat FROM d),
-- two-sided tail of Student's t: 2 C times the integral of cos(a)^(n-3) from atan(|t|/sqrt(n-2)) to pi/2, by Simpson's rule
g AS (SELECT r, n, t_stat, n - 2 AS v, atan(abs(t_stat) / sqrt(n - 2)) AS lo, (pi() / 2 - atan(abs(t_stat) / sqrt(n - 2))) / 40000 AS h FROM s),
q AS (SELECT any_value(exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(pi())) * any_value(h) / 3 * sum(
    CASE WHEN i IN (0, 40000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(0.0, cos(lo + i * h)), v - 1)) AS half
  FROM g, range(40001) z(i))
SELECT r, n, t_stat, 2 * half AS p_value FROM s, q""", ["r", "t_stat", "p_value"]))
def correlation(spark, sf_dir):
    return PR.pearson(roles(spark, sf_dir).ref, "Temperature", "demand")


@query("temperature_shift", sql=rounded(with_roles() + """
, m AS (SELECT geohash, hour, avg(Temperature) AS rt FROM ref GROUP BY geohash, hour),
d AS (SELECT tgt.Temperature - m.rt AS dd FROM tgt LEFT JOIN m ON m.geohash = tgt.geohash AND m.hour = tgt.hour)
SELECT CAST(count(dd) AS BIGINT) AS n_match, count(dd) * 1.0 / count(*) AS match_share, avg(dd) AS mean_diff,
       stddev_samp(dd) AS std_diff, CAST(count(CASE WHEN abs(dd) > 2 THEN 1 END) AS BIGINT) AS n_above_2 FROM d""",
                                        ["match_share", "mean_diff", "std_diff"]))
def temperature_shift(spark, sf_dir):
    r = roles(spark, sf_dir)
    return PR.temperature_shift(r.ref, r.tgt)


RIDGE_SQL = """, sc AS (SELECT count(*) AS n, avg(Temperature) AS mu, stddev_pop(Temperature) AS sd,
  covar_pop(Temperature, demand) AS cv FROM ref WHERE Temperature IS NOT NULL AND demand IS NOT NULL),
rs AS (SELECT n, mu, sd, n * cv / (sd * (n + 1.0)) AS slope FROM sc)"""


@query("ridge_slope", sql=rounded(with_roles() + RIDGE_SQL + """
SELECT CAST(n AS BIGINT) AS n, mu, sd, slope FROM rs""", ["mu", "sd", "slope"]))
def ridge_slope(spark, sf_dir):
    return PR.ridge_slope(roles(spark, sf_dir).ref, "Temperature", "demand")


# Correction strengths and weather weights.
STRENGTHS = [0.1, 0.25, 0.5, 0.75, 1.0, 2.0]
WEATHER_WEIGHTS = [0.05, 0.10]


@query("temperature_correction", sql=rounded(with_roles(*PRED_CTES) + RIDGE_SQL + f"""
, m AS (SELECT geohash, hour, avg(Temperature) AS rt FROM ref GROUP BY geohash, hour),
c AS (SELECT tgt."Index", coalesce(rs.slope * ((tgt.Temperature - rs.mu) / rs.sd - (m.rt - rs.mu) / rs.sd), 0.0) AS cc
      FROM tgt LEFT JOIN m ON m.geohash = tgt.geohash AND m.hour = tgt.hour CROSS JOIN rs)
SELECT CAST(s AS DOUBLE) AS strength, c."Index", {clip_sql('a.demand + s * c.cc', 0.0, 1.0)} AS demand
FROM c JOIN pred_a a USING ("Index") CROSS JOIN (VALUES {", ".join(f"({s!r})" for s in STRENGTHS)}) v(s)""",
                                             ["strength", "demand"]))
def temperature_correction(spark, sf_dir):
    r = roles(spark, sf_dir)
    base = prediction_tables(r)["pred_a"]
    return PR.temperature_correction(r.ref, r.tgt, base, weight_table(spark, STRENGTHS, "strength"))


@query("weather_correction", sql=rounded(with_roles(*PRED_CTES) + f"""
, wm AS (SELECT Weather, avg(demand) AS v FROM ref WHERE Weather IS NOT NULL GROUP BY Weather),
x AS (SELECT tgt."Index", greatest(0.5, least(2.0, coalesce(wm.v / (SELECT avg(demand) FROM ref), 1.0))) AS ratio
      FROM tgt LEFT JOIN wm ON wm.Weather = tgt.Weather)
SELECT CAST(w AS DOUBLE) AS w, x."Index", {clip_sql('a.demand * (1.0 + w * (x.ratio - 1))', 0.0, 1.0)} AS demand
FROM x JOIN pred_a a USING ("Index") CROSS JOIN (VALUES {", ".join(f"({w!r})" for w in WEATHER_WEIGHTS)}) v(w)""",
                                         ["w", "demand"]))
def weather_correction(spark, sf_dir):
    r = roles(spark, sf_dir)
    base = prediction_tables(r)["pred_a"]
    return PR.weather_correction(r.ref, r.tgt, base, weight_table(spark, WEATHER_WEIGHTS, "w"))


DRIFT_COLS = ["Weather", "RoadType", "NumberofLanes"]


@query("category_drift", sql=with_roles() + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{p}' AS period, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n "
    f"FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for c in DRIFT_COLS for p, t in (("reference", "ref"), ("target", "tgt"))))
def category_drift(spark, sf_dir):
    r = roles(spark, sf_dir)
    return PR.category_drift({"reference": r.ref, "target": r.tgt}, DRIFT_COLS)
