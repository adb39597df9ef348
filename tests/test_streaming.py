"""The stream-static cascade gives the batch cascade's answers."""

import tempfile

from pyspark.sql import functions as F

from cellcast.functions.numeric import finish
from cellcast.operators.cascade import memorize_cascades
from cellcast.sources.fixtures import Roles, demand_observations
from cellcast.streaming.scoring import score_stream, static_lookups

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    r = Roles(demand_observations(spark, SF))
    src = tempfile.mkdtemp(prefix="cellcast-stream-src-")
    out = tempfile.mkdtemp(prefix="cellcast-stream-out-")
    chk = tempfile.mkdtemp(prefix="cellcast-stream-chk-")
    rows = r.tgt.select("Index", "geohash", "timestamp")
    rows.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    scored = score_stream(stream, static_lookups(r.ref, r.cal))
    q = (scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk)
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = finish(spark.read.parquet(out)).collect()
    want = finish(memorize_cascades(r.ref, r.cal, r.tgt).select("Index", "level", "offset",
                                                                F.col("pred_add").alias("demand"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
