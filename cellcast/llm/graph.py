"""Shared parts of the similarity joins: groups in bounded blocks, and connected components.

*Blocks.*  A group of any size is dealt by hash into blocks of about ``size`` rows, and a
row is sent to every cell (i, j) of its block's row and column.  Each pair of rows meets in
exactly one cell, a task holds two blocks, and a hot group is only more cells.

*Components.*  Alternating large-star and small-star rounds over an edge table.  Each round
is a grouped minimum and a join, and is written to the shared folder, so neither links nor
labels ever pass through the driver.

*Hubs.*  What a key's rows have in common is brought back to them by (key, part): the rows of
a key are dealt by hash into parts, so a node with a third of all edges, or a component with
a third of all nodes, is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm import store

PART_ROWS = 100_000   # rows of one key that lie together in a join, about
PARTS = 32            # parts of a key, at least


def beside(rows: DataFrame, key: str, other: str, n: int, **values: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """``rows`` with values over all rows of each key, without a task that holds a whole key.

    ``other`` deals a key's rows into parts, and ``n`` is about the number of rows.  A value is
    given by its aggregate over the rows of a part and the function that merges those of the parts.
    Rows whose key is null are left out, as by any join.
    """
    (part,) = store.fresh(rows, "part")
    parts = max(PARTS, -(-n // PART_ROWS))
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(F.lit("part"), other), F.lit(parts)).cast("int")).repartition(key, part)
    per = dealt.groupBy(key, part).agg(*[first.alias(name) for name, (first, _) in values.items()])
    whole = per.groupBy(key).agg(F.collect_list(part).alias(part), *[merge(name).alias(name) for name, (_, merge) in values.items()])
    return dealt.join(whole.withColumn(part, F.explode(part)), [key, part]).drop(part)


def cells(rows: DataFrame, group: str, row_id: str, count: str, size: int) -> DataFrame:
    """Rows with their cell: columns g (group), i, j (blocks) and the row's own block b."""
    blocks = F.ceil(F.col(count) / F.lit(size)).cast("int")
    r = rows.withColumn("nb", blocks).withColumn("b", F.pmod(F.xxhash64(F.lit("block"), row_id), F.col("nb")).cast("int"))
    r = r.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return r.withColumn("g", F.col(group)).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("nb", "o", count)


def by_cell(rows: DataFrame) -> DataFrame:
    """Rows of a cell together, one after the other."""
    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the cell's two blocks (the same ones on the diagonal)."""
    b, i, j = (t.column(c).to_numpy() for c in ("b", "i", "j"))
    return (np.arange(len(b)),) * 2 if i[0] == j[0] else (np.flatnonzero(b == i[0]), np.flatnonzero(b == j[0]))


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, also across batches."""
    held, last = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ks = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for k in ks:
            new[1:] |= k[1:] != k[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), n]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(k[s] for k in ks)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root[i] (smallest index) of each of n nodes under the links a[k]-b[k]; numpy label passing."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def components(edges: DataFrame, label: str) -> DataFrame:
    """edges: a, b (long).  Returns node, component (the smallest node reachable); only nodes with an edge.

    A large-star round joins every neighbour that is larger than a node to the smallest one
    around it, a small-star round a node's smaller neighbours.  In both the node may be a hub,
    whose edges meet their minimum in parts.  It ends when every node hangs on one root that
    hangs on none.
    """
    e = store.save_small(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = 2 * e.count()
        large = beside(both, "u", "v", n, m=(F.min("v"), F.min)).withColumn("m", F.least("u", "m"))
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = beside(large, "u", "v", n, m=(F.min("v"), F.min)).select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = store.save_small(small.where("u <> v").distinct(), f"{label}-round")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether no node has two edges downwards, or one down and one up."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(2).alias("w")), F.struct(F.col("v").alias("x"), F.lit(1).alias("w")))).alias("e"))
    per = ends.select("e.*").groupBy("x").agg(F.count(F.when(F.col("w") == 2, 1)).alias("down"), F.max(F.when(F.col("w") == 1, 1)).alias("up"))
    return per.where("down > 1 or (down = 1 and up = 1)").agg(F.count("*")).first()[0] == 0
