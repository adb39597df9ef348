"""N-gram Jaccard join by MinHash banding.

1. Every document's set of word 5-grams is hashed in one pass, with its MinHash bands.
   Documents with equal sets form one class (copies are never expanded into pairs).
2. Bands: the number of rows is the largest, and the number of bands the smallest, that
   find a pair at the threshold with probability ``recall`` (``plan_bands``).  Classes meet
   in the buckets of their band hashes.  Buckets with the same members are visited once.
   Inside a bucket, dealt in bounded blocks, pairs whose short signatures agree too rarely
   are left out (five standard deviations below the threshold), and a spanning forest of the
   others is emitted, so the number of edges is linear in the rows.
3. Classes of one candidate component meet again, in blocks bounded by rows and, for long
   texts, by shingles (about; one text is never cut), with their full sets.  Each pair
   that the signatures allow is verified exactly; the result is a link count per class and a
   forest of verified links, whose connected components are the groups.

Result: one row per document: doc_id, class_id (smallest doc_id with the same set), n_links
(other documents with Jaccard >= threshold, copies included), component_id (smallest doc_id
reachable by links), kept (exactly one document of each component, the one of smallest doc_id).

Defined results: null text is empty; a document without words links with nothing and is
kept; with fewer than five words the whole text is one shingle; repeated rows are copies
of each other, of which one is kept; a null doc_id counts as larger than every other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import graph, shingles, store

QUERY = "op5_ngram_jaccard"
ORACLE_SQL = None     # tested against all pairs on small fixtures

BLOCK = 256           # rows of a block; a task holds two
BLOCK_GRAMS = 1 << 22  # shingles of a block, about: components of long texts have smaller blocks
BUCKET_BLOCK = 1024


def plan_bands(threshold: float, recall: float, most: int = 192) -> tuple[int, int]:
    """(bands, rows): the most rows per band, then the fewest bands, that reach the recall at the threshold."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold ** rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-p))) if p < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mults(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return (r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1),
            r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))


def minhash(grams: np.ndarray, mults: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Minima of (x ^ mask) * mult over 32-bit halves of the shingle hashes, one per (mult, mask)."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(mults), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(x), 512):
        v = x[s:s + 512, None] ^ masks
        v *= mults
        np.minimum(out, v.min(axis=0), out=out)
    return out


def _signer(k: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()),
                        ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mults, masks = _mults(bands * rows)
        fold = shingles.mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        tag = shingles.mixed(np.arange(bands, dtype=np.uint64) + np.uint64(999))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                g = shingles.shingle_set(text, k)
                if not len(g):
                    out.append((0, 0, 0, [], b""))
                    continue
                h = xxhash.xxh3_128_digest(g.tobytes())
                sig = minhash(g, mults, masks)
                b = shingles.mixed((sig.reshape(bands, rows).astype(np.uint64) * fold).sum(axis=1, dtype=np.uint64) + tag)
                out.append((int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True),
                            len(g), b.view(np.int64), (sig >> np.uint32(24)).astype(np.uint8).tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                   batch.column("t1"), batch.column("t2"), pa.array(cols[2], pa.int64()),
                                   pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())], schema=schema)
    return run


SIGNED = "doc_id long, k1 long, k2 long, t1 long, t2 long, n long, bands array<long>, sig binary"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and 128 bits that stand for the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit("a"), "text").alias("t1"),
                       F.xxhash64(F.lit("b"), "text").alias("t2"))


def _agree(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Boolean matrix: rows of x and y whose signatures agree in ``least`` places or more."""
    out = np.empty((len(x), len(y)), bool)
    step = max(1, (1 << 23) // max(1, y.size))
    for s in range(0, len(x), step):
        out[s:s + step] = (x[s:s + step, None, :] == y[None, :, :]).sum(axis=2, dtype=np.uint16) >= least
    return out


def _candidates(least: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in graph.groups(batches, ["g", "i", "j"]):
            left, right = graph.sides(t)
            if len(t) < 2 or not len(left) or not len(right):
                continue
            ids = t.column("cid").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(t), -1)
            x, y = np.nonzero(_agree(sig[left], sig[right], least))
            root = graph.forest(len(t), left[x], right[y])
            moved = np.flatnonzero(root != np.arange(len(t)))
            yield pa.record_batch([pa.array(ids[moved]), pa.array(ids[root[moved]])], schema=schema)
    return run


def _jaccard_links(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs x[k], y[k] have |A & B| / |A | B| >= threshold, exactly."""
    size = np.array([len(s) for s in sets], np.int64)
    ok = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
    x, y = x[ok], y[ok]
    both = np.zeros(len(x), np.int64)
    if len(x):
        rows = np.unique(np.concatenate((x, y)))
        place = np.zeros(len(sets), np.int64)
        place[rows] = np.arange(len(rows))
        vals, col = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), size[rows])
        shared = np.bincount(col, minlength=len(vals)) > 1
        if len(rows) ** 2 * shared.sum() / 1e10 < (size[x] + size[y]).sum() * 1.5e-8 + len(x) * 1e-5:
            new = np.cumsum(shared) - 1
            keep = shared[col]
            col, row = new[col[keep]], row[keep]
            order = np.argsort(col, kind="stable")
            col, row = col[order], row[order]
            total = np.zeros((len(rows), len(rows)), np.float32)
            for s in range(0, int(shared.sum()), 4096):
                lo, hi = np.searchsorted(col, (s, s + 4096))
                m = np.zeros((len(rows), 4096), np.float32)
                m[row[lo:hi], col[lo:hi] - s] = 1
                total += m @ m.T
            both = total[place[x], place[y]].astype(np.int64)
        else:
            for k, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                both[k] = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
    out = np.zeros(len(ok), bool)
    union = size[x] + size[y] - both
    out[np.flatnonzero(ok)] = both >= threshold * union - 1e-9
    return out


def _verifier(k: int, least: int, threshold: float):
    schema = pa.schema([("cid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches):
        for t in graph.groups(batches, ["g", "i", "j"]):
            left, right = graph.sides(t)
            if len(t) < 2 or not len(left) or not len(right):
                continue
            ids, copies = t.column("cid").to_numpy(), t.column("copies").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(t), -1)
            near = _agree(sig[left], sig[right], least)
            if left is right:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            x, y = left[x], right[y]
            sets = [np.frombuffer(s, np.uint64) for s in t.column("grams").to_pylist()]
            real = _jaccard_links(sets, x, y, threshold)
            x, y = x[real], y[real]
            links = np.bincount(x, copies[y], len(t)) + np.bincount(y, copies[x], len(t))
            root = graph.forest(len(t), x, y)
            some = np.flatnonzero(links)
            yield pa.record_batch([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(links[some].astype(np.int64))], schema=schema)
    return run


PACKED = "t1 long, t2 long, row long, packed binary"


def _pack(batches):
    """Texts as zstd frames, which is what the shuffle to the candidates moves."""
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("row", pa.int64()), ("packed", pa.binary())])
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("t1"), b.column("t2"), b.column("row"), pa.array(packed, pa.binary())], schema=schema)


def _gram_sets(k: int):
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for b in batches:
            texts = (press.decompress(z).decode("utf-8", "surrogatepass") for z in b.column("packed").to_pylist())
            yield pa.record_batch([b.column("t1"), b.column("t2"), pa.array([shingles.shingle_set(t, k).tobytes() for t in texts], pa.binary())],
                                  schema=schema)
    return run


def join(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9995) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept, and the text's key t1, t2."""
    bands, rows = plan_bands(threshold, recall)
    least = math.floor(bands * rows * threshold - 5 * math.sqrt(bands * rows * threshold * (1 - threshold)))
    signed = store.save(_keyed(docs).mapInArrow(_signer(k, bands, rows), SIGNED).withColumn(
        "rid", F.monotonically_increasing_id()), "jaccard-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rid", "t1", "t2"))
    classes = signed.where("n > 0").groupBy("k1", "k2").agg(
        first.alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = store.save(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")

    met = classes.select("cid", F.explode(F.array_distinct("bands")).alias("bucket"))
    full = met.groupBy("bucket").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(cid))").alias("x"), F.sum(
        F.pmod(F.xxhash64(F.lit("s"), "cid"), F.lit(1 << 31))).alias("s")).where("m > 1")
    once = store.save_small(full.groupBy("m", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "jaccard-buckets")
    held = graph.cells(met.join(once, "bucket"), "bucket", "cid", "m", BUCKET_BLOCK).join(classes.select("cid", "sig"), "cid")
    cand = graph.by_cell(held.select("g", "i", "j", "b", "cid", "sig")).mapInArrow(_candidates(least), "a long, b long")
    comp = store.save_small(graph.components(cand, "jaccard-candidates"), "jaccard-components")

    member = comp.join(classes.select(F.col("cid").alias("node"), "copies", "n", "sig", "first.t1", "first.t2", "first.doc_id"), "node")
    sized = graph.beside(member, "component", "node", comp.count(), m=(F.count("*"), F.sum), total=(F.sum("n"), F.sum))
    by_size = F.ceil(F.col("total") * BLOCK / BLOCK_GRAMS)
    wanted = store.save_small(sized.withColumn("m", F.greatest("m", by_size)).drop("n", "total"), "jaccard-wanted")

    row = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row")
    texts = _keyed(docs).select("t1", "t2", row, "text").mapInArrow(_pack, PACKED)
    texts = texts.join(wanted.select("t1", "t2", row).hint("merge"), ["t1", "t2", "row"], "left_semi")
    texts = texts.groupBy("t1", "t2").agg(F.first("packed").alias("packed"))
    grams = store.save(texts.mapInArrow(_gram_sets(k), "t1 long, t2 long, grams binary"), "jaccard-grams")
    sets = wanted.join(grams, ["t1", "t2"]).select(F.col("node").alias("cid"), "component", "m", "copies", "sig", "grams")
    cells = graph.cells(sets, "component", "cid", "m", BLOCK).drop("component")
    links = store.save(graph.by_cell(cells).mapInArrow(_verifier(k, least, threshold), "cid long, root long, links long"), "jaccard-links")
    groups = graph.components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")), "jaccard-groups")

    per = classes.select("cid", "k1", "k2", "first", "copies").join(
        links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(
        groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    per = store.save_small(graph.beside(per, "component", "cid", classes.count(), least=(F.min("first"), F.min)).select(
        "k1", "k2", F.col("first.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("least")), "jaccard-per")
    cols = ["doc_id", "t1", "t2", "class_id", "n_links", "component_id", "kept"]
    alone = signed.where("n = 0").select("doc_id", "t1", "t2", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                         F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return signed.where("n > 0").join(per, ["k1", "k2"]).withColumn("kept", F.col("rid") == F.col("least")).select(*cols).unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9995) -> DataFrame:
    """docs with one document of each component; all columns pass through."""
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    r, a, b = key = store.fresh(docs, "row", "ta", "tb")
    kept = store.save_small(join(docs, threshold, k, recall).where("kept").select(row.alias(r), F.col("t1").alias(a), F.col("t2").alias(b)).distinct(),
                      "jaccard-kept")
    keyed = docs.withColumns({r: row, a: F.xxhash64(F.lit("a"), "text"), b: F.xxhash64(F.lit("b"), "text")})
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(store.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "component_id", "kept")
