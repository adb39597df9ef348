"""Embedding near-duplicates by spherical-cap filters over structured product codes.

A filter is a direction; a vector passes the filters whose inner product with it exceeds a
bound.  Directions are all combinations of one random codeword per block of coordinates
(after a random rotation), so a vector's filters are list-decoded block by block, dropping
partial sums that cannot reach the bound, without looking at all directions.

``plan_code`` picks bound, number of directions and number of independent codes from the
number of vectors, for each vector length its own: a filter holds about ``bucket`` unrelated
vectors, a pair at the threshold shares some ``mean`` filters, and codes are added until no
simulated pair shares none, however many that takes.  Vectors join on filters, in bounded blocks, and every pair is verified
in double precision.  The verified links give connected components; inside a component all
pairs are verified again, in blocks, each pair once, which gives the exact link counts.
Equal vectors are one class from the start and are not expanded into pairs.

Result: one row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept.

Defined results: null, empty or zero vectors and vectors with null or non-finite components
link with nothing and are kept; vectors of different lengths never link; repeated rows are
copies that link with each other, of which all with the smallest vec_id are kept; a null
vec_id counts as larger than every other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import graph, store

QUERY = "op9_spherical_caps"
ORACLE_SQL = None     # all pairs in SQL are too slow on whole tables; tested against them on a fixture

BLOCK = 512
HIGHEST = 0.6         # bound at most: in few dimensions no direction need be closer


class Plan(NamedTuple):
    """Independent codes, blocks of each, codewords per block, and the least inner product with a direction."""
    codes: int
    blocks: int
    words: int
    limit: float


def plan_code(n: int, dim: int, threshold: float, bucket: int = 256, mean: float = 20.0, pairs: int = 2000, most: int = 192) -> Plan:
    """The plan for n vectors of ``dim`` components.

    Sixteenths of the ``mean`` shared filters come from each code; codes are added until none
    of ``pairs`` random pairs at the threshold shares no filter (at 95 % confidence a recall of
    1 - 3 / pairs, for pairs at the threshold itself), and a quarter more.
    """
    normal = NormalDist()
    p = min(0.02, bucket / max(n, 1))
    bound = normal.inv_cdf(1 - p)
    rest = math.sqrt(1 - threshold ** 2)
    grid = np.linspace(bound, bound + 6, 600)
    density = np.array([normal.pdf(z) for z in grid])
    both = float(sum(d * (1 - normal.cdf((bound - threshold * z) / rest)) for z, d in zip(grid, density, strict=True)) * (grid[1] - grid[0]))
    total = mean / 16 / both
    blocks = min(2, dim)
    while total ** (1 / blocks) > most and blocks < dim:
        blocks += 1
    words = max(2, math.ceil(total ** (1 / blocks)))
    r = np.random.default_rng(11)
    x = r.standard_normal((pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((pairs, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = threshold * x + rest * z if dim > 1 else x.copy()
    limit, codes = min(bound / math.sqrt(dim), HIGHEST), 0
    while len(x):
        a, b = (_decode_one(v, codes, blocks, words, limit) for v in (x, y))
        missed = np.array([not np.isin(i, j).any() for i, j in zip(a, b, strict=True)])
        x, y = x[missed], y[missed]
        codes += 1
    return Plan(math.ceil(1.25 * codes), blocks, words, limit)


@functools.lru_cache(maxsize=512)
def code(dim: int, blocks: int, words: int, which: int = 0) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """Rotation, and the codewords of each block of coordinates (norm 1 / sqrt(blocks))."""
    r = np.random.default_rng((dim, blocks, words, which))
    rot, _ = np.linalg.qr(r.standard_normal((dim, dim)))
    cuts = np.linspace(0, dim, blocks + 1).astype(int)
    books = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w = r.standard_normal((words, b - a))
        books.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(blocks))
    return rot, books, [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _decode_one(x: np.ndarray, which: int, blocks: int, words: int, limit: float) -> list[np.ndarray]:
    """The filters of one code that each unit vector (row) passes, as numbers in base ``words``."""
    dim = x.shape[1]
    rot, books, cuts = code(dim, min(blocks, dim), words, which)
    y = x @ rot
    scores = [y[:, c] @ b.T for c, b in zip(cuts, books, strict=True)]
    rest = [np.zeros(len(x))]
    for s in reversed(scores[1:]):
        rest.append(rest[-1] + s.max(axis=1))
    rest.reverse()
    row = np.arange(len(x))
    ids, sums = np.zeros(len(x), np.int64), np.zeros(len(x))
    for s, most in zip(scores, rest, strict=True):         # partial sums of all rows, block by block
        total = sums[:, None] + s[row]
        a, b = np.nonzero(total >= (limit - most[row])[:, None])
        row, ids, sums = row[a], ids[a] * words + b, total[a, b]
    return np.split(ids, np.searchsorted(row, np.arange(1, len(x))))


def list_decode(x: np.ndarray, plan: Plan) -> list[np.ndarray]:
    """The filters of all codes that each unit vector (row) passes."""
    per_code = [_decode_one(x, c, plan.blocks, plan.words, plan.limit) for c in range(plan.codes)]
    size = plan.words ** plan.blocks
    return [np.concatenate([ids + c * size for c, ids in enumerate(lists)]) for lists in zip(*per_code, strict=True)]


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


SIGNED = "vec_id long, dim int, k1 long, k2 long, raw binary"


def _reader(kind: str):
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("raw", pa.binary())])

    def run(batches):
        for batch in batches:
            col, n = batch.column("v"), batch.num_rows
            values = pc.fill_null(col.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.concatenate(([0], np.cumsum(lens)))
            good = np.zeros(n, bool)
            for dim in np.unique(lens[lens > 0]).tolist():
                rows = np.flatnonzero(lens == dim)
                x = values[at[rows][:, None] + np.arange(dim)]
                good[rows] = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            raw = [values[at[r]:at[r + 1]].tobytes() if good[r] else b"" for r in range(n)]
            keys = [xxhash.xxh3_128_digest(b) for b in raw]
            halves = [np.frombuffer(b"".join(keys), "<i8").reshape(n, 2)[:, i] if n else np.empty(0, "i8") for i in (0, 1)]
            yield pa.record_batch([batch.column("vec_id"), pa.array(np.where(good, lens, 0).astype(np.int32)),
                                   pa.array(halves[0]), pa.array(halves[1]), pa.array(raw, pa.binary())], schema=schema)
    return run


def _filters(kind: str, plans: dict[int, Plan]):
    schema = pa.schema([("cid", pa.int64()), ("filters", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            dims, raw = batch.column("dim").to_numpy(), batch.column("raw")
            lists: list = [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                found = list_decode(_units(raw.take(pa.array(rows)).to_pylist(), kind), plans[dim])
                for r, ids in zip(rows.tolist(), found, strict=True):
                    lists[r] = ids * 4096 + dim % 4096
            yield pa.record_batch([batch.column("cid"), pa.array(lists, pa.list_(pa.int64()))], schema=schema)
    return run


def _cell_links(t: pa.Table, kind: str, threshold: float):
    """Row numbers of the verified pairs of one cell (each pair once)."""
    left, right = graph.sides(t)
    raw, dims = t.column("raw").to_pylist(), t.column("dim").to_numpy()
    xs, ys = [], []
    for dim in np.unique(dims).tolist():
        p, q = left[dims[left] == dim], right[dims[right] == dim]
        if not len(p) or not len(q):
            continue
        a = _units([raw[r] for r in p], kind)
        b = a if left is right else _units([raw[r] for r in q], kind)
        near = a @ b.T >= threshold
        if left is right:
            near = np.triu(near, 1)
        x, y = np.nonzero(near)
        xs.append(p[x])
        ys.append(q[y])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys])


def _verified(kind: str, threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in graph.groups(batches, ["g", "i", "j"]):
            if len(t) < 2:
                continue
            x, y = _cell_links(t, kind, threshold)
            ids, root = t.column("cid").to_numpy(), graph.forest(len(t), x, y)
            moved = np.flatnonzero(root != np.arange(len(t)))
            yield pa.record_batch([pa.array(ids[moved]), pa.array(ids[root[moved]])], schema=schema)
    return run


def _counted(kind: str, threshold: float):
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64())])

    def run(batches):
        for t in graph.groups(batches, ["g", "i", "j"]):
            if len(t) < 2:
                continue
            x, y = _cell_links(t, kind, threshold)
            ids, copies = t.column("cid").to_numpy(), t.column("copies").to_numpy()
            links = (np.bincount(x, copies[y], len(t)) + np.bincount(y, copies[x], len(t))).astype(np.int64)
            some = np.flatnonzero(links)
            yield pa.record_batch([pa.array(ids[some]), pa.array(links[some])], schema=schema)
    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    kind = "<f8" if dict(vectors.dtypes)[embedding] == "array<double>" else "<f4"
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    signed = store.save(v.mapInArrow(_reader(kind), SIGNED), "caps-vectors")
    first = F.min(F.struct(F.col("vec_id").isNull().alias("void"), "vec_id"))
    classes = signed.where("dim > 0").groupBy("k1", "k2", "dim").agg(first.alias("first"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    classes = store.save(classes.withColumn("cid", F.monotonically_increasing_id()), "caps-classes")
    # a length of one class has no partner to look for
    plans = {r.dim: plan_code(r.n, r.dim, threshold) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").collect()}
    paired = classes.where(F.col("dim").isin(list(plans)))

    met = store.save(paired.select("cid", "dim", "raw").mapInArrow(_filters(kind, plans), "cid long, filters array<long>").select(
        "cid", F.explode("filters").alias("filter")), "caps-filters")
    full = met.groupBy("filter").agg(F.count("*").alias("m")).where("m > 1")
    held = graph.cells(met.join(full, "filter"), "filter", "cid", "m", BLOCK).drop("filter")
    held = graph.by_cell(held.join(classes.select("cid", "dim", "raw"), "cid"))
    comp = store.save_small(graph.components(held.mapInArrow(_verified(kind, threshold), "a long, b long"), "caps"), "caps-components")

    sized = graph.beside(comp, "component", "node", comp.count(), m=(F.count("*"), F.sum))
    member = sized.withColumnRenamed("node", "cid").join(classes.select("cid", "dim", "raw", "copies"), "cid")
    cells = graph.by_cell(graph.cells(member, "component", "cid", "m", BLOCK).drop("component"))
    links = cells.mapInArrow(_counted(kind, threshold), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))

    per = classes.select("cid", "k1", "k2", "first", "copies").join(links, "cid", "left").join(
        comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    per = store.save_small(graph.beside(per, "component", "cid", classes.count(), least=(F.min("first"), F.min)).select("k1", "k2", F.col("least.vec_id").alias("component_id"), (
        F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")), "caps-per")
    linked = signed.where("dim > 0").select("vec_id", "k1", "k2").join(per, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = signed.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(store.table(spark, sf_dir, "embeddings"))
