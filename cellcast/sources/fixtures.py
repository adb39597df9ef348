"""The ``demand_obs`` fixture: observations derived from the ``events`` table.

``events(event_id, ts, user_id, event_type, value)`` becomes a table of road-cell
observations ``(row_id, geohash, day, timestamp, demand, RoadType, Weather,
LargeVehicles, Landmarks, NumberofLanes, Temperature)``.  Roles:

* held out    = day 47 (some cells of the early period, so that the other roles miss them)
* reference   = day 48
* calibration = day 49 with ``t <= 120``
* target      = day 49 with ``t > 120`` (``Index = row_id``; demand kept for scoring)

The same derivation exists as DuckDB text (``FIXTURE_SQL``) for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.geohash import ALPHABET
from cellcast.functions.timekeys import parse_time_strict
from cellcast.sources.tables import read_table

HELD_OUT_DAY = 47
REFERENCE_DAY = 48
TARGET_DAY = 49
CALIBRATION_LAST_MINUTE = 120


def _digit(pos):
    return F.substr(F.lit(ALPHABET), pos + 1, F.lit(1))


def demand_observations(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Observation rows from ``events`` (read from ``sf_dir`` unless a scan is passed)."""
    ev = events if events is not None else read_table(spark, sf_dir, "events")
    ev = ev.select("event_id", "ts", "user_id", "event_type", "value")
    uid, eid = F.col("user_id"), F.col("event_id")
    u50 = F.floor(uid / 50).cast("int")
    u10 = F.floor(uid / 10).cast("int")
    early = F.dayofmonth("ts") <= 15
    held_out = early & ((uid % 10 == 9) | (u10 % 5 == 4) | (u50 == 2))
    geohash = F.concat(F.when(uid % 50 == 48, F.lit("qp1")).otherwise(F.lit("qp0")),
                       _digit(u50 % 32), _digit(u10 % 5), _digit((uid % 10).cast("int")))
    timestamp = F.concat(F.hour("ts").cast("string"), F.lit(":"),
                         (F.floor(F.minute("ts") / 15).cast("int") * 15).cast("string"))
    return (ev.select(eid.alias("row_id"),
                    geohash.alias("geohash"),
                    F.when(held_out, F.lit(HELD_OUT_DAY)).when(early, F.lit(REFERENCE_DAY)).otherwise(F.lit(TARGET_DAY)).alias("day"),
                    timestamp.alias("timestamp"),
                    F.when(eid % 101 != 0, F.least(F.col("value") / F.lit(100.0), F.lit(1.0))).alias("demand"),
                    F.when(F.col("event_type") == "click", "Residential")
                     .when(F.col("event_type") == "view", "Street")
                     .when(F.col("event_type") == "purchase", "Highway")
                     .when(F.col("event_type") == "error", "Residential").alias("RoadType"),
                    F.when(eid % 5 == 0, "Sunny").when(eid % 5 == 1, "Rainy")
                     .when(eid % 5 == 2, "Foggy").when(eid % 5 == 3, "Snowy").alias("Weather"),
                    F.when(uid % 2 == 0, "Allowed").otherwise("Not Allowed").alias("LargeVehicles"),
                    F.when(uid % 3 == 0, "Yes").when(uid % 3 == 1, "No").alias("Landmarks"),
                    (uid % 5 + 1).cast("int").alias("NumberofLanes"),
                    F.when(eid % 10 != 9, F.lit(10.0) + (eid % 97) / F.lit(4.0)).alias("Temperature")))


class Roles:
    """Parsed observations split into reference / calibration / target rows."""

    def __init__(self, obs: DataFrame, ref_day: int = REFERENCE_DAY, target_day: int = TARGET_DAY,
                 calibration_last_minute: int = CALIBRATION_LAST_MINUTE):
        self.obs = parse_time_strict(obs)
        on_target = F.col("day") == target_day
        # conditions of the three roles, on day and t alone
        self.is_ref = F.col("day") == ref_day
        self.is_cal = on_target & (F.col("t") <= calibration_last_minute)
        self.is_tgt = on_target & (F.col("t") > calibration_last_minute)
        self.ref, self.cal = self.obs.where(self.is_ref), self.obs.where(self.is_cal)
        self.tgt = self.obs.where(self.is_tgt).withColumn("Index", F.col("row_id"))


def roles(spark: SparkSession, sf_dir: str) -> Roles:
    return Roles(demand_observations(spark, sf_dir))


# DuckDB text of the same derivation (oracle side).
FIXTURE_SQL = """
SELECT event_id AS row_id,
 concat(CASE WHEN user_id%50=48 THEN 'qp1' ELSE 'qp0' END,
   substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(floor(user_id/50) AS INT)%32+1, 1),
   substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(floor(user_id/10) AS INT)%5+1, 1),
   substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(user_id%10 AS INT)+1, 1)) AS geohash,
 CAST(CASE WHEN day(ts)<=15 AND (user_id%10=9 OR CAST(floor(user_id/10) AS INT)%5=4
                                 OR CAST(floor(user_id/50) AS INT)=2) THEN 47
           WHEN day(ts)<=15 THEN 48 ELSE 49 END AS INTEGER) AS day,
 concat(CAST(hour(ts) AS VARCHAR),':',
        CAST(CAST(floor(minute(ts)/15) AS INT)*15 AS VARCHAR)) AS timestamp,
 CASE WHEN event_id%101<>0
      THEN least(value/CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) END AS demand,
 CASE event_type WHEN 'click' THEN 'Residential' WHEN 'view' THEN 'Street'
   WHEN 'purchase' THEN 'Highway' WHEN 'error' THEN 'Residential' END AS RoadType,
 CASE CAST(event_id%5 AS INT) WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Rainy'
   WHEN 2 THEN 'Foggy' WHEN 3 THEN 'Snowy' END AS Weather,
 CASE WHEN user_id%2=0 THEN 'Allowed' ELSE 'Not Allowed' END AS LargeVehicles,
 CASE WHEN user_id%3=0 THEN 'Yes' WHEN user_id%3=1 THEN 'No' END AS Landmarks,
 CAST(user_id%5+1 AS INT) AS NumberofLanes,
 CASE WHEN event_id%10<>9
      THEN CAST(10 AS DOUBLE)+(event_id%97)/CAST(4 AS DOUBLE) END AS Temperature
FROM events
"""
