"""Scans, sources, sinks, projections and filters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from cellcast.functions.geohash import with_prefixes
from cellcast.functions import timekeys
from cellcast.operators.aggregates import exact_median
from cellcast.operators.lookups import attach_by_cell
from cellcast.operators.cascade import memorize_cascades
from cellcast.operators.lookups import ReferenceLookups
from cellcast.plans.common import roles
from cellcast.plans.registry import query
from cellcast.sources import files
from cellcast.sources.fixtures import FIXTURE_SQL, Roles, demand_observations
from cellcast.sources.predictions import PRED_CTES, long_predictions, prediction_tables
from cellcast.sources.staging import new_path, staged
from cellcast.sources.tables import table_path
from cellcast.plans.q_calibration import ADD_LEVEL, ADD_VALUE, LOOKUP_CTES, MEMO_X, MULT_VALUE, PAIR_CTES
from cellcast.plans.sqlparts import rounded, with_roles

OBS_COLS = ["row_id", "geohash", "day", "timestamp", "demand", "RoadType", "Weather", "LargeVehicles",
            "Landmarks", "NumberofLanes", "Temperature"]


@query("scan_observations", sql=rounded(FIXTURE_SQL, ["demand", "Temperature"]))
def scan_observations(spark, sf_dir):
    return demand_observations(spark, sf_dir)


CSV_SQL = """
SELECT row_id AS "Index", geohash, day, timestamp, CASE WHEN row_id % 7 IN (1, 2, 3, 4) THEN NULL ELSE demand END AS demand,
  RoadType, NumberofLanes, LargeVehicles, Landmarks, Temperature, Weather FROM obs"""


@query("scan_csv", sql=rounded(with_roles() + CSV_SQL, ["demand", "Temperature"]))
def scan_csv(spark, sf_dir):
    """Observations as a CSV file with missing, junk and NaN labels, scanned with the declared schema."""
    obs = demand_observations(spark, sf_dir).withColumnRenamed("row_id", "Index")
    label = (F.when(F.col("Index") % 7 == 1, "n/a").when(F.col("Index") % 7 == 2, "NaN").when(F.col("Index") % 7 == 3, "5d")
             .when(F.col("Index") % 7 == 4, F.lit(None)).otherwise(F.col("demand").cast("string")))
    path = new_path(spark, "observations")
    obs.withColumn("demand", label).select(*files.OBSERVATION_SCHEMA.names).write.option("header", True).csv(path)
    return files.read_observations(spark, path)


@query("coerce_numeric", sql=rounded(with_roles() + """
SELECT row_id, TRY_CAST(CAST(demand AS VARCHAR) AS DOUBLE) AS demand,
       TRY_CAST(props AS DOUBLE) AS props_num
FROM obs JOIN (SELECT event_id, props FROM events) e ON e.event_id = obs.row_id""", ["demand", "props_num"]))
def coerce_numeric(spark, sf_dir):
    obs = demand_observations(spark, sf_dir)
    ev = spark.read.parquet(table_path(sf_dir, "events")).select(F.col("event_id").alias("row_id"), "props")
    return obs.join(ev, ["row_id"]).select(
        "row_id", files.coerce_numeric(F.col("demand").cast("string")).alias("demand"),
        files.coerce_numeric("props").alias("props_num"))


@query("ensemble_average", sql=rounded(with_roles(*PRED_CTES) + """
SELECT "Index", avg(demand) AS demand, CAST(count(DISTINCT source) AS BIGINT) AS n_sources
FROM preds GROUP BY "Index" """, ["demand"]))
def ensemble_average(spark, sf_dir):
    """One file set per source is written, the folder is read back and averaged per row."""
    path = new_path(spark, "predictions")
    files.write_predictions(long_predictions(roles(spark, sf_dir)).withColumnRenamed("source", "variant"), path, partition_by=["variant"])
    return files.ensemble_average(files.read_prediction_dir(spark, path))


@query("first_available", sql=rounded(FIXTURE_SQL, ["demand", "Temperature"]))
def first_available(spark, sf_dir):
    # the first candidate does not exist; the events table is the next one
    src = files.first_available(spark, [os.path.join(sf_dir, "no_such_table.parquet"),
                                        table_path(sf_dir, "events")])
    return demand_observations(spark, sf_dir, events=src)


@query("ordinal_slice", sql=rounded(with_roles(*PRED_CTES) + """,
stacked AS (
  SELECT row_number() OVER (ORDER BY "Index") - 1 AS pos, demand FROM pred_a
  UNION ALL
  SELECT (SELECT count(*) FROM pred_a) + row_number() OVER (ORDER BY "Index") - 1, demand FROM pred_b),
n AS (SELECT count(*) AS n FROM pred_a),
keys AS (SELECT row_number() OVER (ORDER BY "Index") - 1 AS k, "Index" FROM tgt)
SELECT keys."Index", s.pos, s.demand
FROM stacked s CROSS JOIN n JOIN keys ON keys.k = s.pos - n.n
WHERE s.pos >= n.n AND s.pos < 2 * n.n""",
                                  ["demand"]))
def ordinal_slice(spark, sf_dir):
    r = roles(spark, sf_dir)
    t = {n: staged(p, "predictions") for n, p in prediction_tables(r).items() if n in ("pred_a", "pred_b")}
    a = files.with_ordinal(t["pred_a"], ["Index"])
    n = a.agg(F.count(F.lit(1)).alias("_n"))
    b = files.with_ordinal(t["pred_b"], ["Index"]).crossJoin(F.broadcast(n)) \
        .select((F.col("pos") + F.col("_n")).alias("pos"), "demand")
    stacked = a.select("pos", "demand").unionByName(b)
    # half-way split of the stacked table (whose size is checked), then re-keyed by ordinal of the targets
    total = stacked.agg(F.count(F.lit(1)).alias("_t"))
    rows = r.tgt.count()
    half = files.ordinal_slice(stacked, "pos", rows, 2 * rows, expected_total=2 * rows).crossJoin(F.broadcast(total))
    keys = files.with_ordinal(r.tgt.select("Index"), ["Index"]).withColumnRenamed("pos", "_k")
    return (half.withColumn("_k", F.col("pos") - F.col("_t") / 2)
            .withColumn("_k", F.col("_k").cast("long"))
            .join(keys, ["_k"]).select("Index", "pos", "demand"))


@query("submission_frame", sql=rounded(with_roles(*LOOKUP_CTES, *PAIR_CTES, MEMO_X)
                                       + f'SELECT "Index", {ADD_VALUE} AS demand FROM x', ["demand"]))
def submission_frame(spark, sf_dir):
    r = roles(spark, sf_dir)
    path = new_path(spark, "submission")
    files.write_predictions(memorize_cascades(r.ref, r.cal, r.tgt).select("Index", F.col("pred_add").alias("demand")), path)
    return files.read_prediction_dir(spark, path).select("Index", "demand")


@query("variants_long", sql=rounded(with_roles(*LOOKUP_CTES, *PAIR_CTES, MEMO_X) + f""",
v AS (SELECT "Index", {ADD_VALUE} AS a, {MULT_VALUE} AS m FROM x)
SELECT 'memorize_additive' AS variant, "Index", a AS demand FROM v
UNION ALL SELECT 'memorize_mult', "Index", m FROM v
UNION ALL SELECT 'memorize_blend', "Index", greatest(0.0, least(1.0, 0.5 * a + 0.5 * m)) FROM v""",
                                    ["demand"]))
def variants_long(spark, sf_dir):
    r = roles(spark, sf_dir)
    wide = memorize_cascades(r.ref, r.cal, r.tgt)
    path = new_path(spark, "variants")
    files.write_predictions(files.variants_long(wide, "Index", {
        "memorize_additive": "pred_add", "memorize_mult": "pred_mult", "memorize_blend": "pred_blend"}), path, partition_by=["variant"])
    return files.read_prediction_dir(spark, path).withColumnRenamed("source", "variant")


@query("parse_time_strict", sql=with_roles() + "SELECT row_id, hour, minute, t FROM p")
def parse_time_strict(spark, sf_dir):
    return timekeys.parse_time_strict(demand_observations(spark, sf_dir)).select("row_id", "hour", "minute", "t")


TOLERANT_SQL = """
SELECT row_id,
  coalesce(CAST(trunc(TRY_CAST(split_part(coalesce(timestamp, '0:0'), ':', 1) AS DOUBLE)) AS INTEGER), 0) AS hour,
  coalesce(CAST(trunc(TRY_CAST(CASE WHEN strpos(coalesce(timestamp, '0:0'), ':') > 0
     THEN substr(coalesce(timestamp, '0:0'), strpos(coalesce(timestamp, '0:0'), ':') + 1) END AS DOUBLE)) AS INTEGER), 0) AS minute,
  coalesce(CAST(trunc(TRY_CAST(split_part(props, ':', 1) AS DOUBLE)) AS INTEGER), 0) AS props_hour,
  coalesce(CAST(trunc(TRY_CAST(CASE WHEN strpos(props, ':') > 0
     THEN substr(props, strpos(props, ':') + 1) END AS DOUBLE)) AS INTEGER), 0) AS props_minute
FROM obs JOIN (SELECT event_id, props FROM events) e ON e.event_id = obs.row_id"""


@query("parse_time_tolerant", sql=with_roles() + TOLERANT_SQL)
def parse_time_tolerant_q(spark, sf_dir):
    obs = demand_observations(spark, sf_dir)
    ev = spark.read.parquet(table_path(sf_dir, "events")).select(F.col("event_id").alias("row_id"), "props")
    j = obs.join(ev, ["row_id"])
    a = timekeys.parse_time_tolerant(j).select("row_id", F.col("hour").alias("_h"),
                                               F.col("minute").alias("_m"), "props")
    pp = timekeys.parse_time_tolerant(a, "props")
    return pp.select("row_id", F.col("_h").alias("hour"), F.col("_m").alias("minute"),
                     F.col("hour").alias("props_hour"), F.col("minute").alias("props_minute"))


@query("split_periods", sql=rounded(with_roles() + """
SELECT role, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(demand) AS BIGINT) AS n_demand, avg(demand) AS mean_demand
FROM (SELECT 'reference' AS role, demand FROM ref UNION ALL SELECT 'calibration', demand FROM cal
      UNION ALL SELECT 'target', demand FROM tgt) GROUP BY role""", ["mean_demand"]))
def split_periods(spark, sf_dir):
    r = roles(spark, sf_dir)
    parts = [r.ref.select(F.lit("reference").alias("role"), "demand"),
             r.cal.select(F.lit("calibration").alias("role"), "demand"),
             r.tgt.select(F.lit("target").alias("role"), "demand")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("role").agg(F.count(F.lit(1)).alias("n_rows"), F.count("demand").alias("n_demand"),
                                 F.avg("demand").alias("mean_demand"))


@query("geo_prefixes", sql=with_roles() + """
SELECT DISTINCT geohash, substr(geohash, 1, 5) AS prefix5, substr(geohash, 1, 4) AS prefix4,
       substr(geohash, 1, 3) AS prefix3 FROM obs""")
def geo_prefixes(spark, sf_dir):
    return with_prefixes(demand_observations(spark, sf_dir).select("geohash").distinct())


@query("empty_reference", sql=rounded(with_roles() + """
, emp AS (SELECT geohash, avg(demand) AS v, count(*) AS n FROM p WHERE day = 46 GROUP BY geohash)
SELECT tgt."Index", emp.v AS ref_geo, coalesce(emp.n, 0) AS ref_n FROM tgt LEFT JOIN emp ON emp.geohash = tgt.geohash
""", ["ref_geo"]))
def empty_reference(spark, sf_dir):
    r = roles(spark, sf_dir)
    emp = r.obs.where(F.col("day") == 46).groupBy("geohash").agg(F.avg("demand").alias("ref_geo"),
                                                                 F.count(F.lit(1)).alias("_n"))
    return attach_by_cell(r.tgt.select("Index", "geohash", "t"), emp).select("Index", "ref_geo", F.coalesce(F.col("_n"), F.lit(0)).alias("ref_n"))


@query("impute_constants", sql=rounded(with_roles() + """
SELECT "Index", coalesce(RoadType, 'Missing') AS RoadType, coalesce(Landmarks, 'Missing') AS Landmarks,
       coalesce(Weather, 'Missing') AS Weather, coalesce(Temperature, -1.0) AS Temperature,
       coalesce(demand, 0.0) AS demand FROM tgt""", ["Temperature", "demand"]))
def impute_constants(spark, sf_dir):
    r = roles(spark, sf_dir)
    return (r.tgt.select("Index", "RoadType", "Landmarks", "Weather", "Temperature", "demand")
            .fillna({"RoadType": "Missing", "Landmarks": "Missing", "Weather": "Missing",
                     "Temperature": -1.0, "demand": 0.0}))


# Fixed value: temperature used when a table has no temperature at all.
DEFAULT_TEMPERATURE = 16.4


@query("impute_median", sql=rounded(with_roles() + f"""
SELECT "Index", CAST(Temperature IS NULL AS INTEGER) AS temp_missing,
       coalesce(Temperature, (SELECT coalesce(median(Temperature), {DEFAULT_TEMPERATURE}) FROM tgt)) AS Temperature
FROM tgt""", ["Temperature"]))
def impute_median(spark, sf_dir):
    r = roles(spark, sf_dir)
    med = exact_median(r.tgt, "Temperature", (), "_med").select(
        F.coalesce(F.col("_med"), F.lit(DEFAULT_TEMPERATURE)).alias("_med"))
    return (r.tgt.select("Index", "Temperature").crossJoin(F.broadcast(med))
            .select("Index", F.col("Temperature").isNull().cast("int").alias("temp_missing"),
                    F.coalesce(F.col("Temperature"), F.col("_med")).alias("Temperature")))
