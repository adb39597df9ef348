"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcast.functions.geohash import prefix as gh_prefix
from cellcast.operators import aggregates as agg
from cellcast.operators.calibration import global_baselines, overlap_reference
from cellcast.operators.lookups import ReferenceLookups, mean_by, with_prefix_columns
from cellcast.plans.common import roles
from cellcast.plans.registry import query
from cellcast.plans.sqlparts import rounded, with_roles


@query("global_baseline", sql=rounded(with_roles() + """
SELECT (SELECT avg(demand) FROM ref) AS overall_mean,
       (SELECT avg(demand) FROM ref WHERE hour <= 2) AS g_ref_hours,
       (SELECT avg(demand) FROM ref WHERE t IN (SELECT t FROM cal)) AS g_ref_overlap,
       (SELECT avg(demand) FROM cal) AS g_cal""", ["overall_mean", "g_ref_hours", "g_ref_overlap", "g_cal"]))
def global_baseline(spark, sf_dir):
    r = roles(spark, sf_dir)
    overall = ReferenceLookups(r.ref).overall()
    hours = global_baselines(r.ref, r.cal, "hours").select(F.col("g_ref").alias("g_ref_hours"), "g_cal")
    overlap = global_baselines(r.ref, r.cal, "overlap").select(F.col("g_ref").alias("g_ref_overlap"))
    return overall.crossJoin(hours).crossJoin(overlap).select("overall_mean", "g_ref_hours", "g_ref_overlap",
                                                              "g_cal")


@query("agg_geo_slot", sql=rounded(with_roles() + """
SELECT geohash, t, avg(demand) AS mean, CAST(count(*) AS BIGINT) AS n FROM ref GROUP BY geohash, t""", ["mean"]))
def agg_geo_slot(spark, sf_dir):
    r = roles(spark, sf_dir)
    return r.ref.groupBy("geohash", "t").agg(F.avg("demand").alias("mean"), F.count(F.lit(1)).alias("n"))


@query("agg_geo_hour_std", sql=rounded(with_roles() + """
SELECT geohash, hour, avg(demand) AS mean, coalesce(stddev_samp(demand), 0.0) AS std
FROM ref GROUP BY geohash, hour""", ["mean", "std"]))
def agg_geo_hour_std(spark, sf_dir):
    r = roles(spark, sf_dir)
    return r.ref.groupBy("geohash", "hour").agg(F.avg("demand").alias("mean"), agg.std_samp0("demand").alias("std"))


@query("agg_geo_stats", sql=rounded(with_roles() + """
SELECT geohash, avg(demand) AS geo_mean, coalesce(stddev_samp(demand), 0.0) AS geo_std,
       max(demand) AS geo_max, min(demand) AS geo_min, median(demand) AS geo_median,
       CAST(count(*) AS BIGINT) AS geo_n_obs
FROM ref GROUP BY geohash""", ["geo_mean", "geo_std", "geo_max", "geo_min", "geo_median"]))
def agg_geo_stats(spark, sf_dir):
    return agg.cell_stats(roles(spark, sf_dir).ref)


@query("agg_prefix_rollup", sql=rounded(with_roles() + """
SELECT CASE WHEN grouping(geohash) = 0 THEN 'geohash' WHEN grouping(prefix5) = 0 THEN 'prefix5'
            WHEN grouping(prefix4) = 0 THEN 'prefix4' WHEN grouping(prefix3) = 0 THEN 'prefix3'
            ELSE 'all' END AS level,
       coalesce(geohash, prefix5, prefix4, prefix3, '') AS key,
       avg(demand) AS mean, coalesce(stddev_samp(demand), 0.0) AS std, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, substr(geohash, 1, 5) AS prefix5, substr(geohash, 1, 4) AS prefix4,
             substr(geohash, 1, 3) AS prefix3 FROM ref)
GROUP BY ROLLUP (prefix3, prefix4, prefix5, geohash)""", ["mean", "std"]))
def agg_prefix_rollup(spark, sf_dir):
    """All nested spatial grains in one aggregation (one scan, one shuffle)."""
    r = roles(spark, sf_dir)
    x = with_prefix_columns(r.ref)
    g = (x.rollup("prefix3", "prefix4", "prefix5", "geohash")
         .agg(F.avg("demand").alias("mean"), agg.std_samp0("demand").alias("std"),
              F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid")))
    level = (F.when(F.col("_gid") == 0, "geohash").when(F.col("_gid") == 1, "prefix5")
             .when(F.col("_gid") == 3, "prefix4").when(F.col("_gid") == 7, "prefix3").otherwise("all"))
    return g.select(level.alias("level"),
                    F.coalesce("geohash", "prefix5", "prefix4", "prefix3", F.lit("")).alias("key"),
                    "mean", "std", "n")


@query("agg_prefix3_hour", sql=rounded(with_roles() + """
SELECT substr(geohash, 1, 3) AS prefix3, hour, avg(demand) AS mean FROM ref GROUP BY 1, 2""", ["mean"]))
def agg_prefix3_hour(spark, sf_dir):
    r = roles(spark, sf_dir)
    return (r.ref.withColumn("prefix3", gh_prefix("geohash", 3))
            .groupBy("prefix3", "hour").agg(F.avg("demand").alias("mean")))


@query("agg_prefix_of_means", sql=rounded(with_roles() + """
, cm AS (SELECT geohash, avg(demand) AS m FROM ref GROUP BY geohash HAVING avg(demand) IS NOT NULL)
SELECT 'prefix5' AS level, substr(geohash, 1, 5) AS key, avg(m) AS mean FROM cm GROUP BY 2
UNION ALL SELECT 'prefix4', substr(geohash, 1, 4), avg(m) FROM cm GROUP BY 2""", ["mean"]))
def agg_prefix_of_means(spark, sf_dir):
    lk = ReferenceLookups(roles(spark, sf_dir).ref)
    p5 = lk.prefix(5, "mean", weight="cell").select(F.lit("prefix5").alias("level"),
                                                     F.col("prefix5").alias("key"), "mean")
    p4 = lk.prefix(4, "mean", weight="cell").select(F.lit("prefix4").alias("level"),
                                                     F.col("prefix4").alias("key"), "mean")
    return p5.unionByName(p4)


@query("agg_hour_stats", sql=rounded(with_roles() + """
SELECT hour, avg(demand) AS mean, coalesce(stddev_samp(demand), 0.0) AS std, median(demand) AS median
FROM ref GROUP BY hour""", ["mean", "std", "median"]))
def agg_hour_stats(spark, sf_dir):
    r = roles(spark, sf_dir)
    base = r.ref.groupBy("hour").agg(F.avg("demand").alias("mean"), agg.std_samp0("demand").alias("std"))
    return base.join(agg.exact_median(r.ref, "demand", ["hour"], "median"), ["hour"], "left")


CONTEXT_SETS = [("road", ["RoadType"]), ("road_hour", ["RoadType", "hour"]), ("weather_hour", ["Weather", "hour"]),
                ("weather", ["Weather"]), ("lanes", ["NumberofLanes"])]


@query("agg_context_sets", sql=rounded(with_roles() + """
SELECT 'road' AS grain, RoadType AS category, CAST(NULL AS INTEGER) AS hour, avg(demand) AS mean,
       CAST(count(*) AS BIGINT) AS n FROM ref WHERE RoadType IS NOT NULL GROUP BY RoadType
UNION ALL SELECT 'road_hour', RoadType, hour, avg(demand), count(*) FROM ref WHERE RoadType IS NOT NULL GROUP BY RoadType, hour
UNION ALL SELECT 'weather_hour', Weather, hour, avg(demand), count(*) FROM ref WHERE Weather IS NOT NULL GROUP BY Weather, hour
UNION ALL SELECT 'weather', Weather, NULL, avg(demand), count(*) FROM ref WHERE Weather IS NOT NULL GROUP BY Weather
UNION ALL SELECT 'lanes', CAST(NumberofLanes AS VARCHAR), NULL, avg(demand), count(*) FROM ref
  WHERE NumberofLanes IS NOT NULL GROUP BY NumberofLanes""", ["mean"]))
def agg_context_sets(spark, sf_dir):
    """Five context grains in one pass with GROUPING SETS; NULL category keys form no group."""
    r = roles(spark, sf_dir)
    cols = ["RoadType", "Weather", "NumberofLanes", "hour"]
    sets = [[F.col(c) for c in keys] for _, keys in CONTEXT_SETS]
    g = (r.ref.groupingSets(sets, *cols)
         .agg(F.avg("demand").alias("mean"), F.count(F.lit(1)).alias("n"),
              *[F.grouping(c).alias(f"_g_{c}") for c in cols]))
    grouped = {c: F.col(f"_g_{c}") == 0 for c in cols}
    grain = F.lit(None).cast("string")
    for name, keys in reversed(CONTEXT_SETS):
        cond = None
        for c in cols:
            term = grouped[c] if c in keys else ~grouped[c]
            cond = term if cond is None else cond & term
        grain = F.when(cond, F.lit(name)).otherwise(grain)
    cat = F.coalesce(F.col("RoadType"), F.col("Weather"), F.col("NumberofLanes").cast("string"))
    return (g.select(grain.alias("grain"), cat.alias("category"),
                     F.when(grouped["hour"], F.col("hour")).alias("hour"), "mean", "n")
            .where(F.col("category").isNotNull()))


@query("offset_of_pairs", sql=rounded(with_roles() + """
SELECT c.geohash, avg(c.demand - r.demand) AS mean_diff, CAST(count(c.demand - r.demand) AS BIGINT) AS n_both
FROM cal c JOIN ref r ON c.geohash = r.geohash AND c.t = r.t GROUP BY c.geohash""", ["mean_diff"]))
def offset_of_pairs(spark, sf_dir):
    from cellcast.operators.calibration import pair_stats
    r = roles(spark, sf_dir)
    return pair_stats(r.cal, r.ref).select("geohash", "mean_diff", "n_both")


@query("frequency_table", sql=with_roles() + """
SELECT geohash, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY geohash""")
def frequency_table(spark, sf_dir):
    return roles(spark, sf_dir).obs.groupBy("geohash").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_profile", sql=with_roles() + """
SELECT role, CAST(count(DISTINCT geohash) AS BIGINT) AS n_cells, CAST(count(DISTINCT timestamp) AS BIGINT) AS n_slots
FROM (SELECT 'reference' AS role, geohash, timestamp FROM ref UNION ALL SELECT 'calibration', geohash, timestamp FROM cal
      UNION ALL SELECT 'target', geohash, timestamp FROM tgt) GROUP BY role""")
def distinct_profile(spark, sf_dir):
    r = roles(spark, sf_dir)
    u = (r.ref.select(F.lit("reference").alias("role"), "geohash", "timestamp")
         .unionByName(r.cal.select(F.lit("calibration").alias("role"), "geohash", "timestamp"))
         .unionByName(r.tgt.select(F.lit("target").alias("role"), "geohash", "timestamp")))
    return agg.distinct_counts(u, {"n_cells": "geohash", "n_slots": "timestamp"}, ["role"])


@query("target_geo_mean", sql=rounded(with_roles() + """
SELECT geohash, avg(demand) AS geo_cal_mean FROM cal GROUP BY geohash""", ["geo_cal_mean"]))
def target_geo_mean(spark, sf_dir):
    return roles(spark, sf_dir).cal.groupBy("geohash").agg(F.avg("demand").alias("geo_cal_mean"))


@query("last_value_lookup", sql=rounded(with_roles() + """
SELECT geohash, timestamp, demand AS last_demand FROM (
  SELECT geohash, timestamp, demand, row_number() OVER (PARTITION BY geohash, timestamp ORDER BY row_id DESC) AS rn
  FROM ref) WHERE rn = 1""", ["last_demand"]))
def last_value_lookup(spark, sf_dir):
    return mean_by(roles(spark, sf_dir).ref, ["geohash", "timestamp"], "demand", "last_demand", on_duplicate="last")


@query("equal_width_profile", sql=rounded(with_roles() + """
, rng AS (SELECT min(Temperature) AS mn, max(Temperature) AS mx, (max(Temperature) - min(Temperature)) / 10.0 AS w FROM ref),
b AS (SELECT r.demand, rng.mn, rng.w,
        CAST(1 + (r.Temperature > rng.mn + 1 * rng.w)::INT + (r.Temperature > rng.mn + 2 * rng.w)::INT
          + (r.Temperature > rng.mn + 3 * rng.w)::INT + (r.Temperature > rng.mn + 4 * rng.w)::INT
          + (r.Temperature > rng.mn + 5 * rng.w)::INT + (r.Temperature > rng.mn + 6 * rng.w)::INT
          + (r.Temperature > rng.mn + 7 * rng.w)::INT + (r.Temperature > rng.mn + 8 * rng.w)::INT
          + (r.Temperature > rng.mn + 9 * rng.w)::INT AS INTEGER) AS bucket
      FROM ref r CROSS JOIN rng WHERE r.Temperature IS NOT NULL)
SELECT bucket, mn + (bucket - 1) * w AS lower, mn + bucket * w AS upper, avg(demand) AS mean,
       CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bucket, mn, w""", ["lower", "upper", "mean"]))
def equal_width_profile(spark, sf_dir):
    return agg.equal_width_buckets(roles(spark, sf_dir).ref, "Temperature", "demand", 10)


@query("cell_series", sql=rounded(with_roles() + """
SELECT geohash, CAST(row_number() OVER (PARTITION BY geohash ORDER BY t) - 1 AS INTEGER) AS pos, t, v FROM (
  SELECT geohash, t, avg(demand) AS v FROM ref GROUP BY geohash, t HAVING avg(demand) IS NOT NULL)""", ["v"]))
def cell_series(spark, sf_dir):
    """Per-cell ordered series as one array per cell (≤ 1440 slots), checked through posexplode."""
    from cellcast.operators.asof import series
    s = series(roles(spark, sf_dir).ref)
    arr = s.groupBy("geohash").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("series"))
    return arr.select("geohash", F.posexplode("series").alias("pos", "p")).select(
        "geohash", "pos", F.col("p.t").alias("t"), F.col("p.v").alias("v"))
