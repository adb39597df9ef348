"""Prediction tables derived from the target rows (inputs for blends and metrics).

``pred_a = least(1, 0.9·demand + 0.02)``, ``pred_b = (row_id % 97)/97``,
``pred_c`` = reference mean; a NULL demand counts as 0.5.  ``Index`` keys them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.sources.fixtures import Roles


def prediction_tables(r: Roles) -> dict[str, DataFrame]:
    d = F.coalesce(F.col("demand"), F.lit(0.5))
    a = r.tgt.select("Index", F.least(F.lit(1.0), d * 0.9 + 0.02).alias("demand"))
    b = r.tgt.select("Index", ((F.col("row_id") % 97) / F.lit(97.0)).alias("demand"))
    ref_mean = r.ref.agg(F.avg("demand").alias("_m"))
    c = r.tgt.select("Index").crossJoin(F.broadcast(ref_mean)).select("Index", F.col("_m").alias("demand"))
    return {"pred_a": a, "pred_b": b, "pred_c": c}


def long_predictions(r: Roles) -> DataFrame:
    """``(source, Index, demand)`` for the three tables."""
    t = prediction_tables(r)
    out = None
    for name, df in t.items():
        part = df.select(F.lit(name).alias("source"), "Index", "demand")
        out = part if out is None else out.unionByName(part)
    return out


PRED_CTES = [
    "pred_a AS (SELECT \"Index\", least(1.0, coalesce(demand, 0.5) * 0.9 + 0.02) AS demand FROM tgt)",
    "pred_b AS (SELECT \"Index\", (row_id % 97) / 97.0 AS demand FROM tgt)",
    "pred_c AS (SELECT \"Index\", (SELECT avg(demand) FROM ref) AS demand FROM tgt)",
    "preds AS (SELECT 'pred_a' AS source, * FROM pred_a UNION ALL SELECT 'pred_b', * FROM pred_b "
    "UNION ALL SELECT 'pred_c', * FROM pred_c)",
]
