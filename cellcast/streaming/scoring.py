"""Stream-static scoring with the additive lookup cascade.

The reference and calibration periods are finite tables; target rows may arrive
as a stream.  The lookup tables are written once (static side) and every
micro-batch is left-joined to them — Structured Streaming supports stream-static
left outer joins with the stream on the left, and keeps no state for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.numeric import clip
from cellcast.functions.timekeys import parse_time_strict
from cellcast.operators.calibration import global_baselines, global_offset_scale, pair_stats
from cellcast.operators.cascade import first_level
from cellcast.operators.lookups import ReferenceLookups, as_slots, with_prefix_columns
from cellcast.sources.staging import staged

CELL = "geohash"


def static_lookups(ref: DataFrame, cal: DataFrame) -> dict[str, DataFrame]:
    """The static side: each lookup as a written table, so no micro-batch computes one again."""
    ref, cal = as_slots(ref), as_slots(cal)
    lk = ReferenceLookups(ref)
    g = global_offset_scale(global_baselines(ref, cal, "overlap"))
    tables = {
        "exact": lk.exact(), "geo_hour": lk.geo_hour(), "geo": lk.geo(),
        "p5": lk.prefix(5), "p4": lk.prefix(4), "p3": lk.prefix(3),
        "offset": pair_stats(cal, ref).select(CELL, F.col("mean_diff").alias("_off")),
        "globals": lk.overall().crossJoin(g.select("global_offset")),
    }
    return {name: staged(df, f"lookup-{name}") for name, df in tables.items()}


def score_stream(rows: DataFrame, lookups: dict[str, DataFrame], lo: float = 0.0, hi: float = 1.0,
                 row_key: str = "Index") -> DataFrame:
    """Additive cascade for streaming (or static) target rows with a ``timestamp`` column."""
    x = with_prefix_columns(parse_time_strict(rows))
    x = (x.join(lookups["exact"], [CELL, "t"], "left").join(lookups["geo_hour"], [CELL, "hour"], "left")
          .join(lookups["geo"], [CELL], "left").join(lookups["p5"], ["prefix5"], "left")
          .join(lookups["p4"], ["prefix4"], "left").join(lookups["p3"], ["prefix3"], "left")
          .join(lookups["offset"], [CELL], "left").crossJoin(F.broadcast(lookups["globals"])))
    o = F.coalesce(F.col("_off"), F.col("global_offset"))
    value, level = first_level(
        [("exact", F.col("ref_exact") + o), ("geo_hour", F.col("ref_geo_hour") + o),
         ("prefix5", F.col("prefix5_mean") + o), ("prefix4", F.col("prefix4_mean") + o),
         ("geo", F.col("ref_geo") + o), ("prefix3", F.col("prefix3_mean") + o)],
        ("global", F.col("overall_mean") + F.col("global_offset")))
    return x.select(row_key, level.alias("level"), o.alias("offset"), clip(value, lo, hi).alias("demand"))
