"""As-of joins, interpolation and the cascades built on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellcast.functions.timekeys import MINUTES_PER_DAY
from cellcast.operators import asof
from cellcast.operators.cascade import compare_cascades, interp_cascade, memorize_cascades
from cellcast.operators.evaluate import rmse_by_level
from cellcast.plans.common import roles
from cellcast.plans.q_calibration import ADD_LEVEL, LOOKUP_CTES, MEMO_X, PAIR_CTES
from cellcast.plans.registry import query
from cellcast.plans.sqlparts import clip_sql, rounded, with_roles

CELL = "geohash"
SER = "ser AS (SELECT geohash, t, avg(demand) AS v FROM ref GROUP BY geohash, t HAVING avg(demand) IS NOT NULL)"
KEYS = "k AS (SELECT DISTINCT geohash, t FROM tgt)"
BR = """br AS (SELECT b.geohash, b.t, b.t_prev, b.v_prev, f.t_next, f.v_next FROM
  (SELECT k.geohash, k.t, s.t AS t_prev, s.v AS v_prev FROM k ASOF LEFT JOIN ser s ON k.geohash = s.geohash AND k.t >= s.t) b
  JOIN (SELECT k.geohash, k.t, s.t AS t_next, s.v AS v_next FROM k ASOF LEFT JOIN ser s ON k.geohash = s.geohash AND k.t < s.t) f
  ON b.geohash = f.geohash AND b.t = f.t)"""


def _brackets(r):
    return asof.brackets(r.tgt.select(CELL, "t"), asof.series(r.ref))


@query("asof_backward", sql=rounded(with_roles(SER, KEYS) + """
SELECT k.geohash, k.t, s.t AS t_prev, s.v AS v_prev FROM k ASOF LEFT JOIN ser s ON k.geohash = s.geohash AND k.t >= s.t""",
                                    ["v_prev"]))
def asof_backward(spark, sf_dir):
    return _brackets(roles(spark, sf_dir)).select(CELL, "t", "t_prev", "v_prev")


@query("asof_forward", sql=rounded(with_roles(SER, KEYS) + """
SELECT k.geohash, k.t, s.t AS t_next, s.v AS v_next FROM k ASOF LEFT JOIN ser s ON k.geohash = s.geohash AND k.t < s.t""",
                                   ["v_next"]))
def asof_forward(spark, sf_dir):
    return _brackets(roles(spark, sf_dir)).select(CELL, "t", "t_next", "v_next")


@query("range_join_counts", sql=with_roles(SER, KEYS) + """
SELECT k.geohash, k.t, CAST(count(CASE WHEN s.t <= k.t THEN 1 END) AS BIGINT) AS n_prev,
       CAST(count(CASE WHEN s.t > k.t THEN 1 END) AS BIGINT) AS n_next
FROM k LEFT JOIN ser s ON s.geohash = k.geohash GROUP BY k.geohash, k.t""")
def range_join_counts(spark, sf_dir):
    """Slots at-or-before / after each key, from running counts (no rows × slots expansion)."""
    b = _brackets(roles(spark, sf_dir))
    return b.select(CELL, "t", F.coalesce("n_prev", F.lit(0)).cast("long").alias("n_prev"),
                    F.coalesce("n_next", F.lit(0)).cast("long").alias("n_next"))


@query("range_join_rows", sql=rounded(with_roles(SER, KEYS) + """
SELECT k.geohash, k.t, CASE WHEN s.t <= k.t THEN 'prev' ELSE 'next' END AS side, s.t AS t_ref, s.v AS v
FROM k JOIN ser s ON s.geohash = k.geohash AND (s.t <= k.t OR s.t > k.t)""", ["v"]))
def range_join_rows(spark, sf_dir):
    """The reference slots at or before, and after, each target key, as rows."""
    r = roles(spark, sf_dir)
    series = asof.series(r.ref).select(CELL, F.col("t").alias("t_ref"), "v")
    keys = r.tgt.select(CELL, "t").distinct()
    sides = F.explode(F.array(F.struct(F.lit("prev").alias("side"), F.lit(0).alias("low"), F.col("t").alias("high")),
                              F.struct(F.lit("next").alias("side"), (F.col("t") + 1).alias("low"), F.lit(MINUTES_PER_DAY - 1).alias("high"))))
    spans = keys.select(CELL, "t", sides.alias("_s")).select(CELL, "t", "_s.*")
    return asof.interval_join(series, spans, CELL, "t_ref").select(CELL, "t", "side", "t_ref", "v")


def _interp_sql(edge):
    alpha = clip_sql("(t - t_prev) * 1.0 / (t_next - t_prev)", 0.0, 1.0)
    only_next = "v_next" if edge == "nearest" else "NULL"
    return f"""SELECT tgt."Index", br.t_prev, br.t_next,
  CASE WHEN br.t_prev IS NOT NULL AND br.t_next IS NOT NULL
       THEN v_prev + coalesce(CASE WHEN t_next > t_prev THEN {alpha.replace('(t ', '(br.t ')} END, 0.0) * (v_next - v_prev)
       WHEN br.t_prev IS NOT NULL THEN v_prev
       WHEN br.t_next IS NOT NULL THEN {only_next} END AS interp
FROM tgt LEFT JOIN br ON br.geohash = tgt.geohash AND br.t = tgt.t"""


def _interp(spark, sf_dir, edge):
    r = roles(spark, sf_dir)
    b = asof.interpolate(_brackets(r), edge=edge)
    return r.tgt.select("Index", CELL, "t").join(b, [CELL, "t"], "left").select("Index", "t_prev", "t_next", "interp")


@query("interp_linear", sql=rounded(with_roles(SER, KEYS, BR) + _interp_sql("null"), ["interp"]))
def interp_linear(spark, sf_dir):
    return _interp(spark, sf_dir, "null")


@query("interp_nearest_edge", sql=rounded(with_roles(SER, KEYS, BR) + _interp_sql("nearest"), ["interp"]))
def interp_nearest_edge(spark, sf_dir):
    return _interp(spark, sf_dir, "nearest")


INTERP_X = """ix AS (SELECT tgt."Index", tgt.geohash, ex.v AS e, it.interp AS ip, p5.v AS a5, p4.v AS a4, g.v AS gg, ov.v AS o
  FROM tgt LEFT JOIN ex ON ex.geohash = tgt.geohash AND ex.t = tgt.t
  LEFT JOIN (""" + _interp_sql("null").replace('SELECT tgt."Index", br.t_prev, br.t_next,', 'SELECT tgt."Index",') + """) it
    ON it."Index" = tgt."Index"
  LEFT JOIN p5 ON p5.k = substr(tgt.geohash, 1, 5) LEFT JOIN p4 ON p4.k = substr(tgt.geohash, 1, 4)
  LEFT JOIN g ON g.geohash = tgt.geohash CROSS JOIN ov)"""
INTERP_LEVEL = """CASE WHEN e IS NOT NULL THEN 'exact' WHEN ip IS NOT NULL THEN 'interp' WHEN a5 IS NOT NULL THEN 'prefix5'
  WHEN a4 IS NOT NULL THEN 'prefix4' WHEN gg IS NOT NULL THEN 'geo' ELSE 'global' END"""


@query("cascade_interp", sql=rounded(with_roles(*LOOKUP_CTES, SER, KEYS, BR, INTERP_X) + f"""
SELECT "Index", geohash, {INTERP_LEVEL} AS level, coalesce(e, ip, a5, a4, gg, o) AS base FROM ix""", ["base"]))
def cascade_interp(spark, sf_dir):
    r = roles(spark, sf_dir)
    return interp_cascade(r.ref, r.tgt)


# validate-style comparison: cell means → prefix means (two-stage), nearest-edge interpolation, k=1 scale
CMP_CTES = [
    "cm AS (SELECT geohash, avg(demand) AS m FROM ref GROUP BY geohash HAVING avg(demand) IS NOT NULL)",
    "c5 AS (SELECT substr(geohash, 1, 5) AS k, avg(m) AS v FROM cm GROUP BY 1)",
    "c4 AS (SELECT substr(geohash, 1, 4) AS k, avg(m) AS v FROM cm GROUP BY 1)",
    "pr AS (SELECT c.geohash, c.demand AS d_cal, r.demand AS d_ref FROM cal c JOIN ref r ON c.geohash = r.geohash AND c.t = r.t)",
    "gs AS (SELECT (SELECT avg(demand) FROM ref) AS g_ref, (SELECT avg(demand) FROM cal) AS g_cal)",
    "gsc AS (SELECT CASE WHEN g_ref > 0 THEN " + clip_sql("g_cal / g_ref", 0.5, 3.0) + " ELSE 1.0 END AS global_scale FROM gs)",
    "cs AS (SELECT pr.geohash, count(d_ref) AS n, avg(d_ref) AS m_ref, avg(d_cal) AS m_cal FROM pr GROUP BY pr.geohash)",
    "sc AS (SELECT geohash, " + clip_sql(
        "CASE WHEN n * m_ref + 1.0 * g_ref <> 0 THEN (n * m_cal + 1.0 * g_cal) / (n * m_ref + 1.0 * g_ref) "
        "WHEN n * m_cal + 1.0 * g_cal > 0 THEN 10.0 WHEN n * m_cal + 1.0 * g_cal < 0 THEN 0.1 END", 0.1, 10.0)
    + " AS scale FROM cs CROSS JOIN gs)",
    BR.replace("br AS", "brn AS"),
    """cx AS (SELECT tgt."Index", ex.v AS e, gh.v AS h, g.v AS gg, ov.v AS o, c5.v AS a5, c4.v AS a4,
   CASE WHEN brn.t_prev IS NOT NULL AND brn.t_next IS NOT NULL
        THEN v_prev + (CASE WHEN t_next > t_prev THEN (brn.t - t_prev) * 1.0 / (t_next - t_prev) ELSE 0.0 END) * (v_next - v_prev)
        WHEN brn.t_prev IS NOT NULL THEN v_prev WHEN brn.t_next IS NOT NULL THEN v_next END AS ip,
   coalesce(sc.scale, gsc.global_scale) AS scale
  FROM tgt LEFT JOIN ex ON ex.geohash = tgt.geohash AND ex.t = tgt.t
  LEFT JOIN gh ON gh.geohash = tgt.geohash AND gh.hour = tgt.hour LEFT JOIN g ON g.geohash = tgt.geohash
  LEFT JOIN c5 ON c5.k = substr(tgt.geohash, 1, 5) LEFT JOIN c4 ON c4.k = substr(tgt.geohash, 1, 4)
  LEFT JOIN brn ON brn.geohash = tgt.geohash AND brn.t = tgt.t
  LEFT JOIN sc ON sc.geohash = tgt.geohash CROSS JOIN gsc CROSS JOIN ov)""",
    """cmp AS (SELECT "Index", scale,
  CASE WHEN e IS NOT NULL THEN 'exact' WHEN h IS NOT NULL THEN 'geo_hour' WHEN gg IS NOT NULL THEN 'geo' ELSE 'global' END AS level_old,
  greatest(0.0, coalesce(e, h, gg, o) * scale) AS pred_old,
  CASE WHEN e IS NOT NULL THEN 'exact' WHEN ip IS NOT NULL THEN 'interp' WHEN a5 IS NOT NULL THEN 'prefix5'
       WHEN a4 IS NOT NULL THEN 'prefix4' WHEN gg IS NOT NULL THEN 'geo' ELSE 'global' END AS level_new,
  greatest(0.0, coalesce(e, ip, a5, a4, gg, o) * scale) AS pred_new FROM cx)""",
]


@query("cascade_compare", sql=rounded(with_roles(*LOOKUP_CTES, SER, KEYS, *CMP_CTES) + "SELECT * FROM cmp",
                                      ["scale", "pred_old", "pred_new"]))
def cascade_compare(spark, sf_dir):
    r = roles(spark, sf_dir)
    return compare_cascades(r.ref, r.cal, r.tgt)


@query("rmse_by_level", sql=rounded(with_roles(*LOOKUP_CTES, SER, KEYS, *CMP_CTES) + """
, y AS (SELECT cmp.*, tgt.demand AS y FROM cmp JOIN tgt USING ("Index") WHERE tgt.demand IS NOT NULL),
lv AS (SELECT 'old' AS method, level_old AS level, CAST(count(*) AS BIGINT) AS n, sqrt(avg(power(y - pred_old, 2))) AS rmse FROM y GROUP BY level_old
       UNION ALL SELECT 'new', level_new, count(*), sqrt(avg(power(y - pred_new, 2))) FROM y GROUP BY level_new
       UNION ALL SELECT 'old', 'all', count(*), sqrt(avg(power(y - pred_old, 2))) FROM y
       UNION ALL SELECT 'new', 'all', count(*), sqrt(avg(power(y - pred_new, 2))) FROM y),
imp AS (SELECT 100.0 * (o.rmse - n.rmse) / o.rmse AS improvement_pct FROM lv o JOIN lv n
        ON o.method = 'old' AND n.method = 'new' AND o.level = 'all' AND n.level = 'all')
SELECT lv.*, imp.improvement_pct FROM lv CROSS JOIN imp""", ["rmse", "improvement_pct"]))
def rmse_by_level_q(spark, sf_dir):
    r = roles(spark, sf_dir)
    cmp = compare_cascades(r.ref, r.cal, r.tgt)
    y = cmp.join(r.tgt.select("Index", F.col("demand").alias("y")), ["Index"]).where(F.col("y").isNotNull())
    return rmse_by_level(y, {"old": ("pred_old", "level_old"), "new": ("pred_new", "level_new")}, "y")


@query("coverage_levels", sql=rounded(with_roles(*LOOKUP_CTES, *PAIR_CTES, MEMO_X) + f"""
SELECT level, CAST(count(*) AS BIGINT) AS n, count(*) * 1.0 / (SELECT count(*) FROM tgt) AS share
FROM (SELECT {ADD_LEVEL} AS level FROM x) GROUP BY level""", ["share"]))
def coverage_levels(spark, sf_dir):
    r = roles(spark, sf_dir)
    c = memorize_cascades(r.ref, r.cal, r.tgt)
    counts = c.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("level", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
