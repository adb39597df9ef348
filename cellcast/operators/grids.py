"""Parameter grids scored on slot sums.

A prediction that depends on a row's (cell, t) alone meets all values of that slot at once:
``Σ(y − p)² = Σ(y − ȳ)² + n·(p − ȳ)²``, and ``n``, ``Σy`` and ``Σy²`` are in the slot table.  So a
grid costs (slots × parameters), whatever the number of rows.  Parameters are arrays by
position: scales and offsets are worked out once per cell, predictions and errors once per
slot, and errors are summed by position.  No row is repeated per parameter.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.numeric import clip


def _vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cell_scales(params: Sequence[tuple[float, float]], lo: float = 0.1, global_lo: float = 0.5, global_hi: float | None = None) -> Column:
    """Array of shrunken scales, one per ``(k, highest scale)``; needs ``n, m_ref, m_cal, g_ref, g_cal``.

    A cell without pairs (null ``n``) gets the global ratio within ``global_lo`` and ``global_hi`` (else the highest scale).
    """
    n = F.col("n").cast("double")

    def scale(p):
        num, den = n * F.col("m_cal") + p["k"] * F.col("g_cal"), n * F.col("m_ref") + p["k"] * F.col("g_ref")
        ratio = F.when(den != 0, num / den).when(num > 0, p["hi"]).when(num < 0, F.lit(lo))
        top = p["hi"] if global_hi is None else F.lit(float(global_hi))
        everywhere = F.greatest(F.lit(global_lo), F.least(top, F.try_divide(F.col("g_cal"), F.col("g_ref"))))
        return F.coalesce(F.when(n.isNotNull(), F.greatest(F.lit(lo), F.least(p["hi"], ratio))), everywhere)
    return F.transform(F.arrays_zip(_vector([k for k, _ in params]).alias("k"), _vector([h for _, h in params]).alias("hi")), scale)


def cell_offsets(ks: Sequence[float]) -> Column:
    """Array of shrunken offsets, one per ``k``; the global offset where a cell has none."""
    n, everywhere = F.col("n").cast("double"), F.col("g_cal") - F.col("g_ref")

    def offset(k):
        return F.coalesce(F.try_divide(n * (F.col("m_cal") - F.col("m_ref")) + k * everywhere, F.when(n + k != 0, n + k)), everywhere)
    return F.transform(_vector(ks), offset)


def with_cell_vectors(slots: DataFrame, stats: DataFrame, g: DataFrame, vectors: dict[str, Column], cell: str = "geohash") -> DataFrame:
    """``slots`` with the named parameter arrays of their cells; cells that ``stats`` lacks get the global arrays of ``g`` (one row)."""
    per_cell = stats.crossJoin(F.broadcast(g)).select(cell, *[v.alias(name) for name, v in vectors.items()])
    nothing = g.select(F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("m_ref"), F.lit(None).cast("double").alias("m_cal"), "*")
    anywhere = nothing.select(*[v.alias(f"_{name}") for name, v in vectors.items()])
    return (slots.join(per_cell, [cell], "left").crossJoin(F.broadcast(anywhere))
            .select(*slots.columns, *[F.coalesce(name, f"_{name}").alias(name) for name in vectors]))


def clipped(predictions: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.transform(predictions, lambda p: clip(p, lo, hi))


def rmse_by_position(slots: DataFrame, predictions: Column, size: int) -> DataFrame:
    """``(pos, rmse)`` of each of ``size`` predictions over the values of all slots (columns ``n, s, ss``).

    A slot without values, and a missing prediction, count nowhere; a position that met no value has a null error.
    """
    n, mean = F.col("n").cast("double"), F.col("s") / F.col("n")
    spread = F.greatest(F.lit(0.0), F.col("ss") - F.col("s") * mean)
    held = slots.where("n > 0").select(n.alias("_n"), mean.alias("_mean"), spread.alias("_spread"), predictions.alias("_p"))
    errors = held.select("_n", F.transform("_p", lambda p: F.col("_spread") + F.col("_n") * (p - F.col("_mean")) * (p - F.col("_mean"))).alias("_e"))

    def one(i):
        e = F.get("_e", F.lit(i))
        return F.sqrt(F.try_divide(F.sum(e), F.sum(F.when(e.isNotNull(), F.col("_n"))))).alias(f"_{i}")
    sums = errors.agg(*[one(i) for i in range(size)])
    return sums.select(F.posexplode(F.array(*[f"_{i}" for i in range(size)])).alias("pos", "rmse"))


def labelled(spark: SparkSession, scored: DataFrame, labels: Sequence[tuple], schema: str) -> DataFrame:
    """Scores with the parameters that their positions stand for (a literal table, as long as the grid)."""
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(labels)], f"pos int, {schema}")
    return scored.join(F.broadcast(table), ["pos"]).drop("pos")
