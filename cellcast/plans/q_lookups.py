"""Lookup joins, lags, neighbours, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellcast.functions import geohash as G
from cellcast.functions.timekeys import parse_time_strict, slot_text
from cellcast.operators import lags
from cellcast.operators.asof import series
from cellcast.operators.calibration import daily_ratio, overlap_reference, pair_stats
from cellcast.operators.cascade import resolve_levels
from cellcast.operators.lookups import ReferenceLookups, Slots, attach_by_cell, mean_by
from cellcast.operators.neighbors import neighbor_mean
from cellcast.plans.common import roles
from cellcast.plans.q_calibration import LOOKUP_CTES
from cellcast.plans.registry import query
from cellcast.plans.sqlparts import geohash_neighbor_ctes, geohash_xy_ctes, rounded, with_roles
from cellcast.sources import stored
from cellcast.sources.fixtures import CALIBRATION_LAST_MINUTE, REFERENCE_DAY, TARGET_DAY, demand_observations
from cellcast.sources.staging import new_path

CELL = "geohash"


def _resolved(spark, sf_dir, *levels):
    r = roles(spark, sf_dir)
    return r, resolve_levels(r.tgt, ReferenceLookups(r.ref), levels=levels)


def _attach(r, k, cols):
    return r.tgt.select("Index", CELL, "t").join(k.select(CELL, "t", *cols), [CELL, "t"], "left") \
        .select("Index", *cols)


JOIN_TGT = """FROM tgt
  LEFT JOIN ex ON ex.geohash = tgt.geohash AND ex.t = tgt.t
  LEFT JOIN gh ON gh.geohash = tgt.geohash AND gh.hour = tgt.hour
  LEFT JOIN g ON g.geohash = tgt.geohash
  LEFT JOIN p5 ON p5.k = substr(tgt.geohash, 1, 5)
  LEFT JOIN p4 ON p4.k = substr(tgt.geohash, 1, 4)
  LEFT JOIN p3 ON p3.k = substr(tgt.geohash, 1, 3)"""


@query("lookup_exact", sql=rounded(with_roles(*LOOKUP_CTES) + f'SELECT tgt."Index", ex.v AS ref_exact {JOIN_TGT}',
                                   ["ref_exact"]))
def lookup_exact(spark, sf_dir):
    r, k = _resolved(spark, sf_dir, "exact")
    return _attach(r, k, ["ref_exact"])


@query("stored_lookup", sql=rounded(with_roles(*LOOKUP_CTES) + f'SELECT tgt."Index", ex.v AS ref_exact {JOIN_TGT}',
                                    ["ref_exact"]))
def stored_lookup(spark, sf_dir):
    """The exact lookup on stored observations: partitions pruned by day, buckets joined without a shuffle."""
    name = f"observations_{uuid.uuid4().hex}"
    obs = stored.store_observations(parse_time_strict(demand_observations(spark, sf_dir)), name, new_path(spark, "observations"))
    ref = obs.where(F.col("day") == REFERENCE_DAY)
    tgt = obs.where((F.col("day") == TARGET_DAY) & (F.col("t") > CALIBRATION_LAST_MINUTE))
    return stored.colocated_mean(ref, tgt).select(F.col("row_id").alias("Index"), "ref_exact")


@query("lookup_geo_hour", sql=rounded(with_roles(*LOOKUP_CTES) + f'SELECT tgt."Index", gh.v AS ref_geo_hour {JOIN_TGT}',
                                      ["ref_geo_hour"]))
def lookup_geo_hour(spark, sf_dir):
    r, k = _resolved(spark, sf_dir, "geo_hour")
    return _attach(r, k, ["ref_geo_hour"])


@query("lookup_geo", sql=rounded(with_roles(*LOOKUP_CTES) + f'SELECT tgt."Index", g.v AS ref_geo {JOIN_TGT}',
                                 ["ref_geo"]))
def lookup_geo(spark, sf_dir):
    r, k = _resolved(spark, sf_dir, "geo")
    return _attach(r, k, ["ref_geo"])


@query("lookup_prefix", sql=rounded(with_roles(*LOOKUP_CTES, """p3h AS (SELECT substr(geohash, 1, 3) AS k, hour,
  avg(demand) AS v FROM ref GROUP BY 1, 2)""") + f"""SELECT tgt."Index", p5.v AS prefix5_mean, p4.v AS prefix4_mean,
  p3.v AS prefix3_mean, p3h.v AS prefix3_hour_mean {JOIN_TGT}
  LEFT JOIN p3h ON p3h.k = substr(tgt.geohash, 1, 3) AND p3h.hour = tgt.hour""",
                                    ["prefix5_mean", "prefix4_mean", "prefix3_mean", "prefix3_hour_mean"]))
def lookup_prefix(spark, sf_dir):
    r, k = _resolved(spark, sf_dir, "prefix5", "prefix4", "prefix3")
    p3h = (r.ref.withColumn("prefix3", G.prefix(CELL, 3)).groupBy("prefix3", "hour")
           .agg(F.avg("demand").alias("prefix3_hour_mean")))
    k = k.join(p3h, ["prefix3", "hour"], "left")
    return _attach(r, k, ["prefix5_mean", "prefix4_mean", "prefix3_mean", "prefix3_hour_mean"])


@query("lookup_context", sql=rounded(with_roles(
    "hm AS (SELECT hour, avg(demand) AS v FROM ref GROUP BY hour)",
    "rm AS (SELECT RoadType, avg(demand) AS v FROM ref WHERE RoadType IS NOT NULL GROUP BY RoadType)",
    "rhm AS (SELECT RoadType, hour, avg(demand) AS v FROM ref WHERE RoadType IS NOT NULL GROUP BY RoadType, hour)",
    "whm AS (SELECT Weather, hour, avg(demand) AS v FROM ref WHERE Weather IS NOT NULL GROUP BY Weather, hour)") + """
SELECT tgt."Index", hm.v AS hour_mean, rm.v AS road_mean, rhm.v AS road_hour_mean, whm.v AS weather_hour_mean
FROM tgt LEFT JOIN hm ON hm.hour = tgt.hour LEFT JOIN rm ON rm.RoadType = tgt.RoadType
LEFT JOIN rhm ON rhm.RoadType = tgt.RoadType AND rhm.hour = tgt.hour
LEFT JOIN whm ON whm.Weather = tgt.Weather AND whm.hour = tgt.hour""",
                                     ["hour_mean", "road_mean", "road_hour_mean", "weather_hour_mean"]))
def lookup_context(spark, sf_dir):
    """Context lookups; whether a category table is broadcast is decided at run time by its size."""
    r = roles(spark, sf_dir)
    hm = mean_by(r.ref, ["hour"], name="hour_mean")
    rm = mean_by(r.ref, ["RoadType"], name="road_mean")
    rhm = mean_by(r.ref, ["RoadType", "hour"], name="road_hour_mean")
    whm = mean_by(r.ref, ["Weather", "hour"], name="weather_hour_mean")
    return (r.tgt.select("Index", "hour", "RoadType", "Weather")
            .join(hm, ["hour"], "left").join(rm, ["RoadType"], "left")
            .join(rhm, ["RoadType", "hour"], "left")
            .join(whm, ["Weather", "hour"], "left")
            .select("Index", "hour_mean", "road_mean", "road_hour_mean", "weather_hour_mean"))


@query("calibration_pairs", sql=rounded(with_roles() + """
, pr AS (SELECT c.geohash, c.demand AS d_cal, r.demand AS d_ref FROM cal c JOIN ref r ON c.geohash = r.geohash AND c.t = r.t)
SELECT geohash, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(d_cal - d_ref) AS BIGINT) AS n_both,
       CAST(count(d_ref) AS BIGINT) AS n, avg(d_ref) AS m_ref, avg(d_cal) AS m_cal, avg(d_cal - d_ref) AS mean_diff
FROM pr GROUP BY geohash""", ["m_ref", "m_cal", "mean_diff"]))
def calibration_pairs(spark, sf_dir):
    r = roles(spark, sf_dir)
    return pair_stats(r.cal, r.ref)


@query("semi_overlap_slots", sql=with_roles() + "SELECT row_id, geohash, t FROM ref WHERE t IN (SELECT t FROM cal)")
def semi_overlap_slots(spark, sf_dir):
    r = roles(spark, sf_dir)
    return overlap_reference(r.ref, r.cal).select("row_id", CELL, "t")


# The lag/lead distances (minutes) of the stacked feature table.
LAG_LEAD_MINUTES = [15, 30, 45, 60]
LAG_SHIFTS = {s * d: lags.shift_name(s * d) for d in LAG_LEAD_MINUTES for s in (-1, 1)}


def _lag_sql_cols():
    out = []
    for d, name in LAG_SHIFTS.items():
        out.append(f"(SELECT v FROM ex WHERE ex.geohash = tgt.geohash AND ex.t = tgt.t + ({d})) AS {name}")
    return ",\n  ".join(out)


@query("lag_lead_join", sql=rounded(with_roles(*LOOKUP_CTES) + f"""
SELECT tgt."Index",
  {_lag_sql_cols()}
FROM tgt""", list(LAG_SHIFTS.values())))
def lag_lead_join(spark, sf_dir):
    r = roles(spark, sf_dir)
    slots = ReferenceLookups(r.ref).exact("v")
    lagged = lags.shifted_lookup(slots, LAG_SHIFTS, wrap=False)
    return (r.tgt.select("Index", CELL, "t").join(lagged, [CELL, "t"], "left")
            .select("Index", *LAG_SHIFTS.values()))


# The wrap-around lag distances (minutes) of the neighbour feature table.
WRAP_LAG_MINUTES = [0, 15, 30, 45, 60]
WRAP_SHIFTS = {-d: ("lag1d" if d == 0 else f"lag1d_m{d}") for d in WRAP_LAG_MINUTES}


def last_slots(ref):
    """Last-written value per (cell, slot), NULL included (a dict built in file order)."""
    return mean_by(ref, [CELL, "t"], "demand", "v", on_duplicate="last")


@query("lag_wraparound", sql=rounded(with_roles("""lw AS (SELECT geohash, t, demand AS v FROM (
  SELECT geohash, t, demand, row_number() OVER (PARTITION BY geohash, t ORDER BY row_id DESC) AS rn FROM ref) WHERE rn = 1)""")
    + "SELECT tgt.\"Index\",\n  " + ",\n  ".join(
        f"(SELECT v FROM lw WHERE lw.geohash = tgt.geohash AND lw.t = ((tgt.t + ({d})) % 1440 + 1440) % 1440) AS {n}"
        for d, n in WRAP_SHIFTS.items()) + "\nFROM tgt", list(WRAP_SHIFTS.values())))
def lag_wraparound(spark, sf_dir):
    r = roles(spark, sf_dir)
    lagged = lags.shifted_lookup(last_slots(r.ref), WRAP_SHIFTS, wrap=True)
    return (r.tgt.select("Index", CELL, "t").join(lagged, [CELL, "t"], "left")
            .select("Index", *WRAP_SHIFTS.values()))


@query("daily_ratio", sql=rounded(with_roles() + """
, a AS (SELECT geohash, avg(demand) AS ref_am FROM ref WHERE hour < 4 GROUP BY geohash),
b AS (SELECT geohash, avg(demand) AS cal_am FROM cal WHERE hour < 4 GROUP BY geohash)
SELECT coalesce(a.geohash, b.geohash) AS geohash, ref_am, cal_am,
       CASE WHEN ref_am <> 0 THEN cal_am / ref_am END AS daily_ratio
FROM a FULL OUTER JOIN b ON a.geohash = b.geohash""", ["ref_am", "cal_am", "daily_ratio"]))
def daily_ratio_q(spark, sf_dir):
    r = roles(spark, sf_dir)
    return daily_ratio(r.ref, r.cal)


NEIGHBOR_SQL = with_roles(*geohash_neighbor_ctes("tgt"), """lw AS (SELECT geohash, t, demand AS v FROM (
  SELECT geohash, t, demand, row_number() OVER (PARTITION BY geohash, t ORDER BY row_id DESC) AS rn FROM ref) WHERE rn = 1)""",
    """nm AS (SELECT k.geohash, k.t, avg(lw.v) AS m FROM (SELECT DISTINCT geohash, t FROM tgt) k
  JOIN nb ON nb.geohash = k.geohash JOIN lw ON lw.geohash = nb.neighbor AND lw.t = k.t GROUP BY k.geohash, k.t)""")


@query("neighbor_mean", sql=rounded(NEIGHBOR_SQL + """
SELECT tgt."Index", CASE WHEN nm.m <> 0 THEN nm.m END AS neighbor_mean
FROM tgt LEFT JOIN nm ON nm.geohash = tgt.geohash AND nm.t = tgt.t""", ["neighbor_mean"]))
def neighbor_mean_q(spark, sf_dir):
    r = roles(spark, sf_dir)
    nm = neighbor_mean(r.tgt, last_slots(r.ref))
    return r.tgt.select("Index", CELL, "t").join(nm, [CELL, "t"], "left").select("Index", "neighbor_mean")


@query("self_lookup_loo", sql=rounded(with_roles() + """
, s AS (SELECT geohash, sum(demand) AS sm, count(demand) AS n FROM ref GROUP BY geohash)
SELECT ref.row_id, s.sm / nullif(s.n, 0) AS geo_mean,
  CASE WHEN ref.demand IS NULL THEN s.sm / nullif(s.n, 0)
       WHEN s.n > 1 THEN (s.sm - ref.demand) / (s.n - 1) END AS geo_mean_loo
FROM ref JOIN s ON s.geohash = ref.geohash""", ["geo_mean", "geo_mean_loo"]))
def self_lookup_loo(spark, sf_dir):
    """Cell mean of the reference rows themselves, with and without the row's own value."""
    r = roles(spark, sf_dir)
    slots = Slots(r.ref).table
    s = slots.groupBy(CELL).agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    mean = F.try_divide(F.col("_s"), F.when(F.col("_n") > 0, F.col("_n")))
    loo = (F.when(F.col("demand").isNull(), mean)
           .when(F.col("_n") > 1, (F.col("_s") - F.col("demand")) / (F.col("_n") - 1)))
    return attach_by_cell(r.ref, s, how="inner", keys=slots).select("row_id", mean.alias("geo_mean"), loo.alias("geo_mean_loo"))


@query("geohash_decode", sql=rounded(with_roles(*geohash_xy_ctes("obs")) + """
SELECT geohash, -90.0 + (y + 0.5) * 180.0 / pow(2.0, latb) AS lat, -180.0 + (x + 0.5) * 360.0 / pow(2.0, lonb) AS lon
FROM gx""", ["lat", "lon"]))
def geohash_decode(spark, sf_dir):
    cells = roles(spark, sf_dir).obs.select(CELL).distinct()
    return G.decode(cells)


@query("shift_slot", sql=with_roles() + """
SELECT row_id, CAST(((t - 15) % 1440 + 1440) % 1440 // 60 AS VARCHAR) || ':' ||
       CAST(((t - 15) % 1440 + 1440) % 1440 % 60 AS VARCHAR) AS slot_m15,
       CAST(((t + 60) % 1440 + 1440) % 1440 // 60 AS VARCHAR) || ':' ||
       CAST(((t + 60) % 1440 + 1440) % 1440 % 60 AS VARCHAR) AS slot_p60 FROM p""")
def shift_slot(spark, sf_dir):
    o = roles(spark, sf_dir).obs
    return o.select("row_id", slot_text(F.pmod(F.col("t") - 15, F.lit(1440))).alias("slot_m15"),
                    slot_text(F.pmod(F.col("t") + 60, F.lit(1440))).alias("slot_p60"))


@query("union_cells", sql=with_roles() + "SELECT geohash FROM ref UNION SELECT geohash FROM tgt")
def union_cells(spark, sf_dir):
    r = roles(spark, sf_dir)
    return r.ref.select(CELL).union(r.tgt.select(CELL)).distinct()


CATS = ["RoadType", "LargeVehicles", "Landmarks", "Weather"]


@query("category_domain", sql=with_roles() + " UNION ".join(
    f"SELECT '{c}' AS feature, coalesce({c}, 'Missing') AS category FROM cal "
    f"UNION SELECT '{c}', coalesce({c}, 'Missing') FROM tgt" for c in CATS))
def category_domain(spark, sf_dir):
    r = roles(spark, sf_dir)
    both = r.cal.select(*CATS).unionByName(r.tgt.select(*CATS)).fillna("Missing", subset=CATS)
    long = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("category"))
                                           for c in CATS])).alias("_x")).select("_x.*")
    return long.distinct()


@query("first_k_distinct", sql=with_roles() + """
SELECT timestamp FROM (SELECT DISTINCT timestamp FROM ref) ORDER BY timestamp LIMIT 5""")
def first_k_distinct(spark, sf_dir):
    return roles(spark, sf_dir).ref.select("timestamp").distinct().orderBy("timestamp").limit(5)


@query("top_k", sql=rounded(with_roles() + """
SELECT geohash, avg(demand) AS mean FROM ref GROUP BY geohash HAVING avg(demand) IS NOT NULL
ORDER BY mean DESC, geohash LIMIT 10""", ["mean"]))
def top_k(spark, sf_dir):
    """Top 10 cells by reference mean (TakeOrderedAndProject: a bounded heap per task)."""
    m = ReferenceLookups(roles(spark, sf_dir).ref).geo("mean").where(F.col("mean").isNotNull())
    return m.orderBy(F.col("mean").desc(), F.col(CELL)).limit(10)
