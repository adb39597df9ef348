"""Conversation prefix trie over a splitter skeleton.

A trie's nodes are the distinct sequences of first turns.  Conversations are sorted by their
path (the digests of their turns) and dealt into ranges by splitters from a bounded sample.
Only a node that lies on a splitter's path can have members in two ranges: those paths form
the skeleton, which is broadcast as the list of splitters.  Each range is walked once, in
order, with one open node per depth; it finishes all nodes off the skeleton and returns
partial aggregates of those on it, which are combined by grouped sums over their ancestors.

*Long conversations.*  A path is cut every ``LEVEL`` turns.  The parts of a conversation are rows
of their own, named by a hash of the turns before them, so no row and no group grows with a
conversation.  A node at a cut is the top of the next level's tries.  Sums over subtrees reach
over a cut by ownership: every node belongs to its smallest member, so a subtree's sum is its
own level's plus what its members own further down (a second walk, only if a cut exists).

*Hot conversations and copies.*  Turns are numbered by ranges of (conversation, turn) with the
counts of earlier ranges carried over, and equal paths are ordered by conversation id, so
splitters may cut both.

Turns go into the work as digests and word counts; texts are not shuffled.

Defined results: a null conv_id names no conversation (its rows are left out); null role or text
is empty; turns are ordered by turn (null first), ties by role, the text's first characters
and its digest; repeated rows are repeated turns; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcast.llm import store

QUERY = "op13_prefix_trie"

# Fixed values of the contract: conversations of a family share a base, and how many of its turns at most.
FAMILY = 20
SHARED = 4
WORD = r"[^\x20\x09-\x0D]+"

LEVEL = 512            # turns of a path in one row
RANGE_ROWS = 8_192     # paths of a range, until there are as many ranges as
MOST_RANGES = 1_024
SAMPLE = 8             # sampled paths per range
KEY = 16               # bytes of a turn's digest
TIE = 32               # characters of a text that order tied turns
CHUNK = 65_536         # characters of member ids in one row
ROWS = 10_000          # rows of a returned batch


def turn_rows(conversations: DataFrame) -> DataFrame:
    """c, turn, role, start, key (hex), tokens: one row per turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), F.substring(text, 1, TIE).alias("start"), key.alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))


def _number(batches):
    """Places of sorted rows within their conversation, as far as this partition holds it."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        c = batch.column("c").to_numpy()
        if not len(c):
            continue
        first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        place = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c)))) + 1
        if c[0] == last:
            place[:first[1] if len(first) > 1 else len(c)] += count
        last, count = c[-1], int(place[-1])
        yield pa.record_batch([pa.array(np.full(len(c), part), pa.int32()), batch.column("c"), pa.array(place, pa.int64()), batch.column("key"), batch.column("tokens")],
                              names=["part", "c", "place", "key", "tokens"])


def numbered(turns: DataFrame) -> DataFrame:
    """c, place (from 1, in turn order), key, tokens."""
    order = ["c", F.asc_nulls_first("turn"), "role", "start", "key"]
    rows = store.save(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "key", "tokens").mapInArrow(
        _number, "part int, c long, place long, key string, tokens long"), "trie-turns")
    held = rows.groupBy("c", "part").agg(F.max("place").alias("n"))
    before = held.withColumn("before", F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where(
        "before is not null").select("c", "part", "before")
    return rows.join(before, ["c", "part"], "left").select("c", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "key", "tokens")


def shared_turns(c):
    """How many turns of its family's base a conversation begins with."""
    return F.pmod(F.crc32(F.encode(c.cast("string"), "utf-8")), F.lit(SHARED))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, d, key, tokens) and (c, length) of the conversations that begin with their base's first turns."""
    own = store.save(numbered(turns), "trie-numbered")
    size = own.groupBy("c").agg(F.max("place").alias("n"))
    conv = size.select("c", "n", (F.col("c") - F.col("c") % FAMILY).alias("b"), shared_turns(F.col("c")).alias("h"))
    base = size.select(F.col("c").alias("b"), F.col("n").alias("base_n"))
    conv = store.save(conv.join(base, "b", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).select(
        "c", "b", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    first = own.where(F.col("place") < SHARED).select(F.col("c").alias("b"), F.col("place").alias("d"), "key", "tokens")
    lead = conv.join(first, "b").where("d <= h").select("c", "d", "key", "tokens")
    less = conv.where("taken < h").select("c", (F.col("h") - F.col("taken")).alias("less"))
    rest = own.where(F.col("place") > shared_turns(F.col("c"))).join(less, "c", "left").select(
        "c", (F.col("place") - F.coalesce("less", F.lit(0))).alias("d"), "key", "tokens")
    return lead.unionByName(rest), conv.select("c", "length")


def _bytes(a, b):
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (a, b)]))


def paths(turns: DataFrame, lengths: DataFrame, level: int = LEVEL) -> DataFrame:
    """lv, c, path, tokens, ends, next: the parts of each conversation's path.

    ``path`` is the part's name (a hash of all turns before it; zeros at the start) and its turns'
    digests. A conversation ends in its last part, which is empty if its length is a multiple of ``level``;
    other parts name the next one.
    """
    one = F.struct("d", "key", "tokens")
    part = turns.withColumn("lv", F.floor((F.col("d") - 1) / level)).groupBy("c", "lv").agg(
        F.array_sort(F.collect_list(one)).alias("t"), *[F.bit_xor(F.xxhash64(F.lit(s), "d", "key")).alias(s) for s in ("x", "y")])
    part = part.select("c", "lv", F.array_join(F.transform("t", lambda t: t["key"]), "").alias("keys"), F.transform("t", lambda t: t["tokens"]).alias("tokens"), "x", "y")
    void = lengths.where(F.col("length") % level == 0).select(
        "c", F.floor(F.col("length") / level).alias("lv"), F.lit("").alias("keys"), F.array().cast("array<long>").alias("tokens"),
        F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    up = Window.partitionBy("c").orderBy("lv")
    zero = F.lit(0).cast("long")
    rows = part.unionByName(void)
    for s in ("x", "y"):
        rows = rows.withColumn(f"{s}0", F.coalesce(F.bit_xor(s).over(up.rowsBetween(Window.unboundedPreceding, -1)), zero))
    ends = F.size("tokens") < level
    return rows.select(F.col("lv").cast("int").alias("lv"), "c", F.unhex(F.concat(F.hex(_bytes(F.col("x0"), F.col("y0"))), "keys")).alias("path"), "tokens", ends.alias("ends"),
                       F.when(~ends, _bytes(F.col("x0").bitwiseXOR(F.col("x")), F.col("y0").bitwiseXOR(F.col("y")))).alias("next"))


def splitters(rows: DataFrame, range_rows: int = RANGE_ROWS, most: int = MOST_RANGES) -> list[tuple[bytes, int]]:
    """Bounds (path, c) of the ranges, from a sample of about ``SAMPLE`` paths for each of at most ``most`` ranges."""
    n = rows.count()
    ranges = min(most, -(-n // range_rows))
    if ranges < 2:
        return []
    every = max(1, n // (SAMPLE * ranges))
    some = sorted((bytes(r.path), r.c) for r in rows.where(F.pmod(F.xxhash64("c", "lv"), F.lit(every)) == 0).select("path", "c").collect())
    return sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []


def _dealer(bounds):
    def run(batches):
        for batch in batches:
            at = [bisect.bisect_right(bounds.value, k) for k in zip(batch.column("path").to_pylist(), batch.column("c").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "range"])
    return run


def common(a: bytes, b: bytes) -> int:
    """Digests that two paths share from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    low, high = 0, n // KEY
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid * KEY] == b[:mid * KEY]:
            low = mid
        else:
            high = mid
    return low


class Node:
    """An open node: what its finished children and its own members have brought so far."""

    __slots__ = ("n", "conv", "children", "leaves", "saved", "tok", "skeleton", "link", "sha", "ids", "chunks", "wait")

    def __init__(self, tok: int, skeleton: bool):
        self.n, self.conv, self.children, self.leaves, self.saved, self.tok, self.skeleton = 0, None, 0, 0, 0, tok, skeleton
        self.link, self.sha, self.ids, self.chunks, self.wait = None, None, [], 0, []

    def take(self, n: int, conv: int, leaves: int, saved: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.leaves += leaves
        self.saved += saved


class Found(NamedTuple):
    """A returned row: a finished node (kind 0), a skeleton node's part (1) or some of its members' ids (2)."""
    kind: int
    lv: int
    e: int
    path: bytes | None       # kinds 1, 2
    parent: bytes | None     # digest of the parent's path, if that is on the skeleton
    parent_conv: int | None
    conv: int | None
    n: int
    children: int
    leaves: int
    saved: int
    tok: int
    own: int                 # tokens saved at the node itself
    leaf: int
    link: bytes | None       # name of the level below (at its end) or of the own level (at its top)
    ends: str | None         # digest (kind 0) or ids (kind 2)
    range: int
    chunk: int


FOUND = pa.schema([("kind", pa.int32()), ("lv", pa.int32()), ("e", pa.int32()), ("path", pa.binary()), ("parent", pa.binary()), ("parent_conv", pa.int64()),
                   ("conv", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("tok", pa.int64()), ("own", pa.int64()),
                   ("leaf", pa.int64()), ("link", pa.binary()), ("ends", pa.string()), ("range", pa.int32()), ("chunk", pa.int32())])
FOUND_SQL = ("kind int, lv int, e int, path binary, parent binary, parent_conv long, conv long, n long, children long, leaves long, saved long, tok long, own long,"
             " leaf long, link binary, ends string, range int, chunk int")
NOBODY = hashlib.sha256(b"").hexdigest()


class Walk:
    """One range's sorted rows, with the nodes of the current path open."""

    def __init__(self, number: int, bounds: list, level: int, out: list):
        self.number, self.level, self.out = number, level, out
        self.near = [b[0] for b in bounds[max(0, number - 1):number + 1]]
        self.open: list[Node] = []
        self.path, self.lv = b"", 0

    def row(self, lv: int, c: int, path: bytes, tokens: list[int], ends: bool, link: bytes | None, leaves: int, saved: int) -> None:
        self.close(common(self.path, path))
        skeleton = max((common(path, b) for b in self.near), default=0)
        self.path, self.lv = path, lv
        for e in range(len(self.open), len(path) // KEY):
            self.open.append(Node(tokens[e - 1] if e else 0, e < skeleton))
        node = self.open[-1]
        node.take(1, c, leaves, saved)
        node.link = link
        if ends:
            node.ids.append(str(c))
            if len(node.ids) * 20 >= CHUNK:
                self.members(node, len(self.open) - 1)

    def members(self, node: Node, e: int) -> None:
        """Pass on the ids held so far: into the digest, or as a row of a skeleton node."""
        if not node.ids:
            return
        ids, node.ids = ",".join(node.ids), []
        if node.skeleton:
            self.out.append(Found(2, self.lv, e, self.path[:KEY * (e + 1)], None, None, None, 0, 0, 0, 0, 0, 0, 0, None, ids, self.number, node.chunks))
            node.chunks += 1
        elif node.sha is None:
            node.sha = hashlib.sha256(ids.encode())
        else:
            node.sha.update(b"," + ids.encode())

    def close(self, depth: int) -> None:
        """Finish the open nodes below the first ``depth``."""
        while len(self.open) > depth:
            e = len(self.open) - 1
            node = self.open.pop()
            self.members(node, e)
            link = self.path[:KEY] if e == 0 and self.lv else node.link if e == self.level else None
            if node.skeleton:
                self.out.append(Found(1, self.lv, e, self.path[:KEY * (e + 1)], None, None, node.conv, node.n, node.children, node.leaves, node.saved, node.tok, 0, 0,
                                      link, None, self.number, 0))
                continue
            leaf, own = int(node.children == 0 and e < self.level), (node.n - 1) * node.tok
            node.leaves += leaf
            node.saved += own
            done = Found(0, self.lv, e, None, None, None, node.conv, node.n, node.children, node.leaves, node.saved, node.tok, own, leaf, link,
                         node.sha.hexdigest() if node.sha else NOBODY, self.number, 0)
            if e:
                parent = self.open[-1]
                parent.children += 1
                parent.take(node.n, node.conv, node.leaves, node.saved)
                if parent.skeleton:
                    self.out.append(done._replace(parent=hashlib.md5(self.path[:KEY * e]).digest()))
                else:
                    parent.wait.append(done)
            else:
                self.out.append(done)
            self.out.extend(w._replace(parent_conv=node.conv) for w in node.wait)


def _walker(bounds, level: int):
    def run(batches):
        out: list = []
        walk = None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("range", "lv", "c", "path", "tokens", "ends", "next", "leaves", "saved")]
            for number, *row in zip(*cols, strict=True):
                if walk is None or walk.number != number:
                    if walk:
                        walk.close(0)
                    walk = Walk(number, bounds.value, level, out)
                walk.row(*row)
                if len(out) >= ROWS:
                    yield _batch(out)
                    out.clear()
        if walk:
            walk.close(0)
        if out:
            yield _batch(out)
    return run


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)


def _digests(batches):
    """Digest of each path's ids, from its sorted chunks."""
    path, sha, out = None, None, []
    for batch in batches:
        for p, ids in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if p != path:
                if sha:
                    out.append((path, sha.hexdigest()))
                path, sha = p, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if sha:
        out.append((path, sha.hexdigest()))
    yield pa.record_batch([pa.array([p for p, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["path", "ends"])


def _walked(rows: DataFrame, bounds: list, level: int) -> DataFrame:
    """kind-0 rows of all nodes: those the ranges finished, and the skeleton's after its parts are combined."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(bounds)
    dealt = rows.mapInArrow(_dealer(sent), "lv int, c long, path binary, tokens array<long>, ends boolean, next binary, leaves long, saved long, range int")
    out = store.save(dealt.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "path", "c").mapInArrow(_walker(sent, level), FOUND_SQL), "trie-walk")
    cols = ["lv", "e", "parent_conv", "conv", "n", "children", "leaves", "saved", "own", "leaf", "link", "ends"]
    done = out.where("kind = 0")
    if not bounds:
        return done.select(*cols)

    def above(e):
        return F.explode(F.transform(F.sequence(F.lit(0), e), lambda a: F.substring("path", F.lit(1), (a + 1) * KEY))).alias("at")
    parts = out.where("kind = 1")
    mine = parts.groupBy("path").agg(F.max("lv").alias("lv"), F.max("e").alias("e"), F.max("tok").alias("tok"), F.max("link").alias("link"), F.sum("children").alias("off"))
    sums = parts.select(above(F.col("e")), "n", "conv", "leaves", "saved").groupBy("at").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("leaves").alias("leaves0"), F.sum("saved").alias("saved0")).withColumnRenamed("at", "path")
    on = mine.where("e > 0").groupBy(F.expr(f"substring(path, 1, {KEY} * e)").alias("path")).agg(F.count("*").alias("on"))
    skel = mine.join(sums, "path").join(on, "path", "left").withColumn("children", F.col("off") + F.coalesce("on", F.lit(0)))
    skel = store.save(skel.withColumn("own", (F.col("n") - 1) * F.col("tok")).withColumn(
        "leaf", ((F.col("children") == 0) & (F.col("e") < level)).cast("long")), "trie-skeleton")
    more = skel.select(above(F.col("e")), "own", "leaf").groupBy("at").agg(F.sum("own").alias("own_all"), F.sum("leaf").alias("leaf_all")).withColumnRenamed("at", "path")
    ids = out.where("kind = 2").select("path", "range", "chunk", "ends").repartition("path").sortWithinPartitions("path", "range", "chunk").mapInArrow(
        _digests, "path binary, ends string")
    up = skel.select(F.col("path").alias("above"), F.col("conv").alias("parent_conv"))
    full = skel.join(more, "path").join(ids, "path", "left").withColumn("above", F.expr(f"substring(path, 1, {KEY} * e)")).join(up, "above", "left")
    full = full.withColumn("leaves", F.col("leaves0") + F.col("leaf_all")).withColumn("saved", F.col("saved0") + F.col("own_all")).withColumn(
        "ends", F.coalesce("ends", F.lit(NOBODY))).select(*cols)
    tops = skel.select(F.unhex(F.md5("path")).alias("parent"), F.col("conv").alias("above_conv"))
    done = done.join(tops, "parent", "left").withColumn("parent_conv", F.coalesce("parent_conv", "above_conv")).select(*cols)
    return done.unionByName(full)


def trie(turns: DataFrame, lengths: DataFrame, level: int = LEVEL, range_rows: int = RANGE_ROWS, most: int = MOST_RANGES) -> DataFrame:
    """The nodes of the trie of all conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: c, d (from 1), key (hex digest), tokens; lengths: c, length (0 for a conversation without turns).
    """
    zero = F.lit(0).cast("long")
    rows = store.save(paths(turns, lengths, level), "trie-paths")
    bounds = splitters(rows, range_rows, most)
    deepest = rows.agg(F.coalesce(F.max("lv"), F.lit(0)).alias("lv")).first().lv
    nodes = _walked(rows.withColumn("leaves", zero).withColumn("saved", zero), bounds, level)
    if deepest:
        below = Window.partitionBy("c").orderBy(F.desc("lv")).rowsBetween(Window.unboundedPreceding, 0)
        owned = nodes.groupBy(F.col("conv").alias("c"), "lv").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
        owned = owned.select("c", (F.col("lv") - 1).alias("lv"), F.sum("leaves").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved"))
        # a conversation may own nothing in a level, so the sums are carried to every part above
        every = Window.partitionBy("c").orderBy(F.desc("lv")).rowsBetween(Window.unboundedPreceding, 0)
        more = rows.join(owned, ["c", "lv"], "left").select("lv", "c", "path", "tokens", "ends", "next", *[
            F.coalesce(F.max(s).over(every), zero).alias(s) for s in ("leaves", "saved")])
        nodes = store.save(_walked(store.save(more, "trie-owned"), bounds, level), "trie-nodes")
        head = nodes.where("e = 0 and lv > 0").select("link", F.col("children").alias("below"), F.col("ends").alias("ends_below"))
        cut = nodes.where(F.col("e") == level).join(head, "link").drop("children", "ends").withColumnRenamed("below", "children").withColumnRenamed("ends_below", "ends")
        nodes = nodes.where((F.col("e") < level) & ((F.col("e") > 0) | (F.col("lv") == 0))).unionByName(cut)
    return nodes.select(F.col("conv").alias("conv_id"), (F.col("lv").cast("long") * level + F.col("e")).alias("depth"), F.col("parent_conv").alias("parent_conv_id"),
                        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.col("ends").alias("ends_sha256"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = rebuilt(turn_rows(store.table(spark, sf_dir, "conversations")))
    return trie(store.save(turns, "trie-rebuilt"), lengths)


_CRC = ("xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),"
        " lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")
ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, substr(sha256(length(role) || ':' || role || text), 1, {2 * KEY}) AS key FROM t),
o AS (SELECT c, key, len(regexp_extract_all(text, '{WORD}')) AS tok, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(text, {TIE}), key) AS p FROM k),
v AS (SELECT c, c - c % {FAMILY} AS b, {_CRC} % {SHARED} AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT v.c, 0 AS own, p, key, tok FROM v JOIN o ON o.c = v.b AND o.p <= v.h UNION ALL SELECT v.c, 1, p, key, tok FROM v JOIN o ON o.c = v.c AND o.p > v.h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, key, tok FROM r),
m AS (SELECT c, d, string_agg(key, '') OVER (PARTITION BY c ORDER BY d) AS path, tok FROM q UNION ALL SELECT c, 0, '', 0 FROM v),
len AS (SELECT c, max(d) AS n FROM m GROUP BY c),
nd AS (SELECT path, d, min(c) AS conv, count(*) AS n, (count(*) - 1) * any_value(tok) AS own, left(path, {2 * KEY} * greatest(d - 1, 0)) AS up FROM m GROUP BY path, d),
ch AS (SELECT up AS path, count(*) AS children FROM nd WHERE d > 0 GROUP BY up),
nc AS (SELECT nd.*, coalesce(children, 0) AS children FROM nd LEFT JOIN ch USING (path)),
ow AS (SELECT m.c, m.d, m.path, sum(CASE WHEN nc.conv = m.c THEN own ELSE 0 END) OVER w AS saved, sum(CASE WHEN nc.conv = m.c AND children = 0 THEN 1 ELSE 0 END) OVER w AS leaves
  FROM m JOIN nc USING (path, d) WINDOW w AS (PARTITION BY m.c ORDER BY m.d DESC)),
su AS (SELECT path, sum(saved) AS saved, sum(leaves) AS leaves FROM ow GROUP BY path),
en AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM m JOIN len USING (c) WHERE m.d = len.n GROUP BY path)
SELECT nc.conv AS conv_id, nc.d AS depth, pa.conv AS parent_conv_id, nc.n AS n_convs, nc.children AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nc JOIN su USING (path) LEFT JOIN en USING (path) LEFT JOIN nd pa ON pa.path = nc.up AND nc.d > 0
"""
