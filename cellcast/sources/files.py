"""Observation and prediction files: scans with declared schemas, sinks, ordinals."""

from __future__ import annotations

import uuid
from typing import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellcast.functions.numeric import nan_to_null
from cellcast.functions.timekeys import NUMBER

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("Index", T.LongType()),
    T.StructField("geohash", T.StringType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("demand", T.StringType()),  # coerced to DOUBLE after the scan
    T.StructField("RoadType", T.StringType()),
    T.StructField("NumberofLanes", T.IntegerType()),
    T.StructField("LargeVehicles", T.StringType()),
    T.StructField("Landmarks", T.StringType()),
    T.StructField("Temperature", T.DoubleType()),
    T.StructField("Weather", T.StringType()),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("Index", T.LongType()),
    T.StructField("demand", T.DoubleType()),
])


def coerce_numeric(c: Column | str) -> Column:
    """Text → DOUBLE; unparsable text and NaN become NULL (``to_numeric(errors='coerce')``)."""
    col = F.col(c) if isinstance(c, str) else c
    text = col.cast("string")
    return nan_to_null(F.when(text.rlike(NUMBER), text).try_cast("double"))


def read_observations(spark: SparkSession, path: str, fmt: str = "csv",
                      schema: T.StructType = OBSERVATION_SCHEMA) -> DataFrame:
    """Scan observations with a declared schema (no inference pass over the data)."""
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    if "demand" in df.columns:
        df = df.withColumn("demand", coerce_numeric("demand"))
    return df


def first_available(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Read the first path that resolves; raise if none does (only schemas are read)."""
    for p in paths:
        try:
            return spark.read.format(fmt).load(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of the sources exists: {list(paths)}")


def read_prediction_dir(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """All prediction files of a folder as ``(source, Index, demand)``.

    ``source`` is the variant of a folder written per variant, else the file.
    """
    reader = spark.read.schema(PREDICTION_SCHEMA).option("recursiveFileLookup", True)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    file = F.col("_metadata.file_path")
    variant = F.regexp_extract(file, "/variant=([^/]+)/", 1)
    return df.select(F.when(variant != "", variant).otherwise(file).alias("source"), "Index", "demand")


def ensemble_average(preds: DataFrame, key: str = "Index", value: str = "demand",
                     source: str = "source") -> DataFrame:
    """Mean prediction per row key across sources, with the number of sources seen."""
    return preds.groupBy(key).agg(F.avg(value).alias(value), F.countDistinct(source).alias("n_sources"))


# Rows of a bucket of the distributed ordinal, and sampled keys for each bound between buckets.
ROWS_PER_BUCKET = 100_000
KEYS_PER_BOUND = 32


def _order_bounds(keyed: DataFrame, buckets: int) -> list:
    """At most ``buckets - 1`` key values that cut the rows into about equal parts.

    The keys of least hash are a sample that partitions merge; any bounds give right ordinals.
    """
    if buckets < 2:
        return []
    sample = keyed.select("_k").orderBy(F.xxhash64("_k", F.lit("sample"))).limit(buckets * KEYS_PER_BOUND)
    keys = [r[0] for r in sample.orderBy("_k").collect()]
    return [keys[len(keys) * i // buckets] for i in range(1, buckets)] if keys else []


def _not_above(bounds: str, key, size: int):
    """How many of ``size`` sorted bounds are not above the key, by binary search."""
    steps = [1 << i for i in reversed(range(size.bit_length()))]

    def step(held, s):
        reached = held + s
        return F.when((reached <= size) & (F.get(F.col(bounds), reached - 1) <= key), reached).otherwise(held)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step) if steps else F.lit(0)


def _bucketed(df: DataFrame, order: Sequence[str], rows_per_bucket: int) -> DataFrame:
    """``df`` with its sort key ``_k`` and the bucket ``_b`` of that key, about ``rows_per_bucket`` rows each."""
    keyed = df.withColumn("_k", F.struct(*[F.col(c) for c in order], F.xxhash64(*df.columns).alias("_hash")))
    values = _order_bounds(keyed, -(-df.count() // rows_per_bucket))
    bounds = keyed.sparkSession.createDataFrame([(values,)], T.StructType([T.StructField("_bounds", T.ArrayType(keyed.schema["_k"].dataType))]))
    return keyed.crossJoin(F.broadcast(bounds)).withColumn("_b", _not_above("_bounds", F.col("_k"), len(values))).drop("_bounds")


def with_ordinal(df: DataFrame, order: Sequence[str], name: str = "pos", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Consecutive 0-based ordinal in ``order`` without a single-partition window.

    The sort key (the order columns, then a hash of the whole row, so ties are split too) is
    cut at a list of bounds, as many as the number of rows asks for: a task sorts about
    ``rows_per_bucket`` rows at any size, and the list holds one key in so many rows.  A row's bucket follows
    from its own values alone (a binary search), so the rows and the counts of earlier buckets
    always agree, whatever the partitioning.  Rows equal in every column are interchangeable
    (and fall into one bucket).
    """
    cut = _bucketed(df, order, rows_per_bucket)
    counts = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_off"))
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy("_b").orderBy("_k")) - 1)
    return (local.join(F.broadcast(offsets), ["_b"]).withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_b", "_k", "_local", "_off"))


def ordinal_slice(df: DataFrame, pos: str, start: int, stop: int,
                  expected_total: int | None = None) -> DataFrame:
    """Rows with ``start <= pos < stop``; optionally fail when the table size is not as expected."""
    out = df.where((F.col(pos) >= start) & (F.col(pos) < stop))
    if expected_total is not None:
        total = df.agg(F.count(F.lit(1)).alias("_total"))
        out = (out.crossJoin(F.broadcast(total))
               .where(F.assert_true(F.col("_total") == expected_total,
                                    f"unexpected row count (expected {expected_total})").isNull())
               .drop("_total"))
    return out


def variants_long(df: DataFrame, key: str, variants: dict[str, str]) -> DataFrame:
    """Wide prediction columns → ``(variant, key, demand)`` (one table instead of one file each)."""
    return df.unpivot([key], list(variants.values()), "_col", "demand") \
        .withColumn("variant", F.create_map(*[x for kv in ((F.lit(v), F.lit(k)) for k, v in variants.items())
                                              for x in kv])[F.col("_col")]) \
        .select("variant", key, "demand")


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", partition_by: Iterable[str] = ()) -> None:
    """Write ``(Index, demand)`` (or a long table partitioned by ``variant``)."""
    w = df.write.mode("overwrite")
    parts = list(partition_by)
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


MANIFEST = "variant string, version string, seq long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every version that was ever published; empty where nothing was."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """All written rows; names of variants are texts, also those that look like numbers."""
    found = spark.read.parquet(f"{path}/data").schema
    named = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("version", "variant") else f for f in found])
    return spark.read.schema(named).parquet(f"{path}/data")


def replace_variants(df: DataFrame, path: str) -> None:
    """Publish the variants of a long table ``(variant, key, demand)``; other variants at ``path`` stay as they are.

    The rows go into a version of their own, and only when all are written does one append to the manifest
    name that version for each variant. A run that fails before leaves the old versions in force. One writer at a time.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "variant").parquet(f"{path}/data")
    seq = _manifest(spark, path).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
    written = _versions(spark, path).where(F.col("version") == version).select("variant").distinct()
    written.select("variant", F.lit(version).alias("version"), F.lit(seq).alias("seq")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """The published rows of each variant: those of its last version in the manifest."""
    last = _manifest(spark, path).groupBy("variant").agg(F.max_by("version", "seq").alias("version"))
    return _versions(spark, path).join(last, ["variant", "version"], "left_semi").drop("version")
