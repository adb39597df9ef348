"""DuckDB oracle text: the fixture and role CTEs plus a rounding wrapper."""

from __future__ import annotations

from cellcast.sources.fixtures import FIXTURE_SQL


def r6(expr: str) -> str:
    """Round half away from zero at 6 decimals, the same two casts as ``round6``."""
    return f"CAST(CAST(CAST(CAST({expr} AS DOUBLE) AS DECIMAL(38,9)) AS DECIMAL(38,6)) AS DOUBLE)"


ROLES = f"""
obs AS ({FIXTURE_SQL}),
p AS (
  SELECT *, CAST(split_part(timestamp, ':', 1) AS INTEGER) AS hour,
            CAST(split_part(timestamp, ':', 2) AS INTEGER) AS minute,
            CAST(split_part(timestamp, ':', 1) AS INTEGER) * 60
              + CAST(split_part(timestamp, ':', 2) AS INTEGER) AS t
  FROM obs),
ref AS (SELECT * FROM p WHERE day = 48),
cal AS (SELECT * FROM p WHERE day = 49 AND t <= 120),
tgt AS (SELECT *, row_id AS "Index" FROM p WHERE day = 49 AND t > 120)"""


def with_roles(*ctes: str) -> str:
    """``WITH`` clause holding the roles and the extra CTEs given as text."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {ROLES}{extra}\n"


def rounded(sql: str, doubles: list[str] | tuple[str, ...]) -> str:
    """Wrap a query so the listed DOUBLE columns are rounded like the Spark side."""
    if not doubles:
        return sql
    rep = ", ".join(f"{r6(chr(34) + c + chr(34))} AS \"{c}\"" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def rounded_but(sql: str, others: tuple[str, ...]) -> str:
    """Wrap a query so all columns but the listed ones are rounded like the Spark side."""
    names = ", ".join(f'"{c}"' for c in others)
    return f"SELECT {names}, {r6(f'COLUMNS(* EXCLUDE ({names}))')} FROM (\n{sql}\n) AS _q"


def clip_sql(expr: str, lo: float | None = None, hi: float | None = None) -> str:
    """NULL-preserving clip (DuckDB's least/greatest skip NULL arguments)."""
    out = f"({expr})"
    if hi is not None:
        out = f"least({float(hi)!r}, {out})"
    if lo is not None:
        out = f"greatest({float(lo)!r}, {out})"
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE {out} END)"


GEO_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_xy_ctes(cells: str) -> list[str]:
    """CTEs ``gx(geohash, L, lonb, latb, x, y)`` for the distinct cells of CTE ``cells``."""
    a = GEO_ALPHABET
    return [
        f"gc AS (SELECT geohash, CAST(length(geohash) AS INTEGER) AS L, "
        f"list_transform(string_split(geohash, ''), lambda c: CAST(instr('{a}', c) - 1 AS BIGINT)) AS codes "
        f"FROM (SELECT DISTINCT geohash FROM {cells} WHERE geohash IS NOT NULL))",
        "gx AS (SELECT geohash, L, CAST(ceil(5 * L / 2.0) AS INTEGER) AS lonb, "
        "CAST(floor(5 * L / 2.0) AS INTEGER) AS latb, "
        "list_reduce(list_transform(range(0, 5 * L, 2), lambda k: (codes[k // 5 + 1] >> CAST(4 - k % 5 AS BIGINT)) & 1), "
        "lambda a, b: a * 2 + b) AS x, "
        "list_reduce(list_transform(range(1, 5 * L, 2), lambda k: (codes[k // 5 + 1] >> CAST(4 - k % 5 AS BIGINT)) & 1), "
        "lambda a, b: a * 2 + b) AS y FROM gc)",
    ]


def geohash_neighbor_ctes(cells: str) -> list[str]:
    """CTEs ending in ``nb(geohash, direction, neighbor)`` for the cells of CTE ``cells``."""
    a = GEO_ALPHABET
    return geohash_xy_ctes(cells) + [
        "gm AS (SELECT geohash, L, lonb, latb, d.direction, "
        "((x + d.dx) % (CAST(1 AS BIGINT) << lonb) + (CAST(1 AS BIGINT) << lonb)) % (CAST(1 AS BIGINT) << lonb) AS nx, "
        "y + d.dy AS ny FROM gx CROSS JOIN (VALUES ('top', 0, 1), ('bottom', 0, -1), ('left', -1, 0), "
        "('right', 1, 0), ('top_left', -1, 1), ('top_right', 1, 1), ('bottom_left', -1, -1), "
        "('bottom_right', 1, -1)) d(direction, dx, dy))",
        f"nb AS (SELECT geohash, direction, array_to_string(list_transform(range(L), lambda i: substr('{a}', "
        "CAST(1 + list_sum(list_transform(range(5), lambda b: (CASE WHEN (i * 5 + b) % 2 = 0 "
        "THEN (nx >> CAST(lonb - 1 - (i * 5 + b) // 2 AS BIGINT)) & 1 "
        "ELSE (ny >> CAST(latb - 1 - (i * 5 + b) // 2 AS BIGINT)) & 1 END) << CAST(4 - b AS BIGINT))) AS INTEGER), 1)), '') "
        "AS neighbor FROM gm WHERE ny >= 0 AND ny < (CAST(1 AS BIGINT) << latb))",
    ]
