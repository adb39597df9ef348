"""Geohash column expressions: prefixes, decode to cell centre, 8 neighbours.

All arithmetic is done with SQL higher-order functions on the base-32 digits, so
it stays inside the JVM.  A geohash interleaves bits starting with longitude;
``lon_bits = ceil(5L/2)`` and ``lat_bits = floor(5L/2)`` for a hash of length L.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the geohash base-32 alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def prefix(col: str | Column, n: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, 1, n)


def with_prefixes(df: DataFrame, col: str = "geohash", sizes=(5, 4, 3)) -> DataFrame:
    for n in sizes:
        df = df.withColumn(f"prefix{n}", prefix(col, n))
    return df


def _codes(gh: str) -> str:
    # array<int> of 0..31 digit values
    return f"transform(split({gh}, ''), c -> instr('{ALPHABET}', c) - 1)"


def _interleaved(gh: str, start: int) -> str:
    # integer made of the bits at positions start, start+2, ... (MSB first)
    n = f"(5 * length({gh}))"
    codes = _codes(gh)
    return (f"aggregate(sequence({start}, {n} - 1, 2), CAST(0 AS BIGINT), "
            f"(acc, k) -> acc * 2 + shiftright(element_at({codes}, CAST(k DIV 5 AS INT) + 1), "
            f"4 - CAST(k % 5 AS INT)) % 2)")


def lon_bits(gh: str) -> str:
    return f"CAST(ceil(5 * length({gh}) / 2.0) AS INT)"


def lat_bits(gh: str) -> str:
    return f"CAST(floor(5 * length({gh}) / 2.0) AS INT)"


def cell_xy(gh: str = "geohash") -> tuple[Column, Column]:
    """Integer (x = longitude index, y = latitude index) of a geohash cell."""
    return F.expr(_interleaved(gh, 0)), F.expr(f"CASE WHEN length({gh}) > 0 THEN {_interleaved(gh, 1)} END")


def decode(df: DataFrame, col: str = "geohash", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cell centre latitude/longitude (exact centre, no display rounding)."""
    x, y = cell_xy(col)
    lonb, latb = F.expr(lon_bits(col)), F.expr(lat_bits(col))
    return (df.withColumn(lon, F.lit(-180.0) + (x + 0.5) * F.lit(360.0) / F.pow(F.lit(2.0), lonb))
              .withColumn(lat, F.lit(-90.0) + (y + 0.5) * F.lit(180.0) / F.pow(F.lit(2.0), latb)))


def encode_xy(x: str, y: str, length: str) -> str:
    """SQL text re-encoding integer (x, y) indices into a geohash of ``length`` chars."""
    lonb = f"CAST(ceil(5 * {length} / 2.0) AS INT)"
    latb = f"CAST(floor(5 * {length} / 2.0) AS INT)"
    bit = (f"(CASE WHEN (i * 5 + b) % 2 = 0 "
           f"THEN shiftright({x}, {lonb} - 1 - CAST((i * 5 + b) DIV 2 AS INT)) % 2 "
           f"ELSE shiftright({y}, {latb} - 1 - CAST((i * 5 + b) DIV 2 AS INT)) % 2 END)")
    code = f"aggregate(sequence(0, 4), CAST(0 AS BIGINT), (acc, b) -> acc * 2 + {bit})"
    return (f"array_join(transform(sequence(0, {length} - 1), "
            f"i -> substr('{ALPHABET}', CAST({code} AS INT) + 1, 1)), '')")


# Fixed value: neighbour directions as (d_lon, d_lat): top, bottom, left, right and corners.
DIRECTIONS = [("top", 0, 1), ("bottom", 0, -1), ("left", -1, 0), ("right", 1, 0),
              ("top_left", -1, 1), ("top_right", 1, 1), ("bottom_left", -1, -1),
              ("bottom_right", 1, -1)]


def neighbors(cells: DataFrame, col: str = "geohash") -> DataFrame:
    """``(geohash, direction, neighbor)``: eight rows per cell.

    Longitude wraps around the antimeridian; a latitude step past a pole has no
    neighbour and yields no row.  Run it on *distinct* cells and join back.
    """
    x, y = cell_xy(col)
    base = (cells.select(col).where(F.col(col).isNotNull()).distinct()
            .withColumn("_x", x).withColumn("_y", y)
            .withColumn("_len", F.length(col))
            .withColumn("_lonb", F.expr(lon_bits(col)))
            .withColumn("_latb", F.expr(lat_bits(col))))
    dirs = F.array(*[F.struct(F.lit(n).alias("direction"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                     for n, dx, dy in DIRECTIONS])
    moved = (base.withColumn("_d", F.explode(dirs))
             .withColumn("_nx", F.expr("pmod(_x + _d.dx, shiftleft(CAST(1 AS BIGINT), _lonb))"))
             .withColumn("_ny", F.col("_y") + F.col("_d.dy"))
             .where((F.col("_ny") >= 0) & (F.col("_ny") < F.expr("shiftleft(CAST(1 AS BIGINT), _latb)"))))
    return moved.select(F.col(col), F.col("_d.direction").alias("direction"),
                        F.expr(encode_xy("_nx", "_ny", "_len")).alias("neighbor"))
