"""Ranked lexical search by presence masks.

Every item of a query set is ranked against all documents with an integer form of BM25.

1. One pass over the texts counts each document's terms and keeps, for the terms of the items,
   a compact posting row (document, length, term numbers, occurrences), written to the shared
   folder.  Corpus figures (N, L, document frequencies) are aggregated from those rows.
2. A second pass reads the postings in batches.  For each item, every term's documents set one
   bit of a mask, documents with equal masks form a group, and a group's greatest possible
   score is the sum of its terms' greatest gains.  Groups are evaluated by descending greatest
   score until the next one cannot reach the item's k-th best score any more; that score is
   carried from batch to batch.  A partition returns at most k rows per item.
3. The partitions' rows are ranked; Spark cuts each partition to k per item before it shuffles.

Items are taken in blocks of about ``BLOCK_TERMS`` terms (by hash; a block holds at least one
item), which bounds what is broadcast; each block is held against all documents.

Defined results: a null text has no terms; a document without terms is not counted and an item
without terms has no rows; a null doc_id comes after all others among equal scores; repeated
documents and repeated items are rows of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcast.llm import store

QUERY = "op12_mask_search"

# Fixed values of the contract: terms, and the constants of the score.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEPT_SHARE = 75
SCALE = 1_000_000_000
TOP = 10

BLOCK_TERMS = 200_000   # terms of the items that are searched together
STEP = 64               # documents at least that are evaluated before the bound is looked at again
_BYTES = bytes(b if b > 127 or chr(b) in "0123456789" + LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 32 for b in range(256))
NONE = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: all bytes above 127 belong to characters that are in terms."""
    return text.translate(_BYTES).split()


def _poster(numbers):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def run(batches):
        number = numbers.value
        for batch in batches:
            n, rows = [], []
            for text in batch.column("text").cast(pa.binary()):
                words = terms(text.as_py() or b"")
                n.append(len(words))
                rows.append([(number[w], k) for w, k in Counter(words).items() if w in number])
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32())
            pairs = np.array([p for r in rows for p in r], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(pairs[:, 0], pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(pairs[:, 1], pa.int64()))], schema=schema)
    return run


class Items:
    """The items of a block: term numbers and how often each term stands in the item."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in rows]
        self.number: dict[bytes, int] = {}
        self.terms, self.repeats = [], []
        for _, words in rows:
            counts = Counter(words)
            self.terms.append(np.array([self.number.setdefault(w.encode(), len(self.number)) for w in counts], np.int64))
            self.repeats.append(np.array(list(counts.values()), np.int64))


def weights(n_docs: int, df: dict[int, int], size: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(size)], np.int64)


class Best:
    """The k best (score, doc_id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """The score below which nothing enters any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        some = scores >= self.least()
        s, d = np.concatenate((self.scores, scores[some])), np.concatenate((self.docs, docs[some]))
        order = np.lexsort((d, -s))[:self.k]
        self.scores, self.docs = s[order], d[order]


def masks(n: int, docs_of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group documents 0..n-1 by the terms they hold: presence (group x term), the documents that hold any in the order
    of their groups, and where each group begins among them."""
    bits = np.zeros((n, -(-len(docs_of) // 64)), np.uint64)
    for i, docs in enumerate(docs_of):
        bits[docs, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    held = np.flatnonzero(bits.any(axis=1))
    bits = bits[held]
    order = np.lexsort(bits.T)
    bits = bits[order]
    first = np.flatnonzero(np.concatenate(([True] * bool(len(bits)), (bits[1:] != bits[:-1]).any(axis=1))))
    i = np.arange(len(docs_of))
    return (bits[first][:, i // 64] >> (i % 64).astype(np.uint64)) & np.uint64(1) == 1, held[order], first


def rank_batch(best: Best, docs: np.ndarray, docs_of: list[np.ndarray], gains: list[np.ndarray]) -> None:
    """Put the best documents of a batch into ``best``. docs_of and gains: per term of the item, the rows that hold it
    (ascending) and what the term adds to their scores (repeats in the item included)."""
    most = np.array([g.max(initial=0) for g in gains], np.int64)
    if most.sum() < best.least():
        return
    present, rows, first = masks(len(docs), docs_of)
    bound = present.astype(np.int64) @ most
    ends = np.append(first[1:], len(rows))
    wait: list = []
    held = 0

    def settle():
        some = np.sort(np.concatenate(wait))
        score = np.zeros(len(some), np.int64)
        for d, g in zip(docs_of, gains, strict=True):
            if len(d):
                at = np.minimum(np.searchsorted(d, some), len(d) - 1)
                score += np.where(d[at] == some, g[at], 0)
        best.add(score, docs[some])

    for m in np.argsort(-bound, kind="stable").tolist():
        if bound[m] < best.least():
            break
        wait.append(rows[first[m]:ends[m]])
        held += int(ends[m] - first[m])
        if held >= STEP:
            settle()
            wait, held = [], 0
    if wait:
        settle()


def _ranker(sent, n_docs: int, length: int, k: int):
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        items, weight = sent.value
        best = [Best(k) for _ in items.ids]
        for batch in batches:
            docs = batch.column("doc_id").fill_null(NONE).to_numpy()
            m = 100 - KEPT_SHARE + (KEPT_SHARE * batch.column("n").to_numpy() * n_docs) // length
            lists = batch.column("terms")
            term, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            row = np.repeat(np.arange(len(docs)), np.diff(lists.offsets.to_numpy()))
            gain = weight[term] * ((SCALE * times) // (1000 * times + 8 * m[row]))
            order = np.argsort(term, kind="stable")
            row, gain = row[order], gain[order]
            edge = np.searchsorted(term[order], np.arange(len(weight) + 1))
            for b, ts, qs in zip(best, items.terms, items.repeats, strict=True):
                if len(ts):
                    rank_batch(b, docs, [row[edge[t]:edge[t + 1]] for t in ts], [q * gain[edge[t]:edge[t + 1]] for t, q in zip(ts, qs, strict=True)])
        for i, b in enumerate(best):
            if len(b.docs):
                yield pa.record_batch([pa.array(np.full(len(b.docs), i), pa.int32()), pa.array(b.docs, mask=b.docs == NONE), pa.array(b.scores)], schema=schema)
    return run


def _split(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _search_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items.number)
    posted = store.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(
        _poster(sent), "doc_id long, n long, terms array<int>, times array<long>").where("n > 0"), "search-postings")
    total = posted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = {r.term: r.df for r in posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weighed = spark.sparkContext.broadcast((items, weights(total.docs, df, len(items.number))))
    names = spark.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    found = posted.where(F.size("terms") > 0).mapInArrow(_ranker(weighed, total.docs, max(total.length, 1), k), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    q = items.select(F.col("item_id").cast("long").alias("item_id"), _split(F.col("text")).alias("w")).where(F.size("w") > 0)
    total = q.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("n")).first().n
    blocks = max(1, math.ceil(total / block_terms))
    q = store.save(q.withColumn("block", F.pmod(F.xxhash64("item_id", "w"), F.lit(blocks))), "search-items")
    out = None
    for b in range(blocks):
        rows = [(r.item_id, r.w) for r in q.where(F.col("block") == b).select("item_id", "w").collect()]
        if rows:
            part = _search_block(docs, Items(rows), k)
            out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))


def _sql_terms(table: str, row: str) -> str:
    return (f"SELECT row_number() OVER () AS {row}, *, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM {table}")


ORACLE_SQL = rf"""
WITH d AS ({_sql_terms('documents', 'r')}), i AS ({_sql_terms('benchmark', 'i')}),
s AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM s),
q AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY term, docs),
p AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))) AS gain FROM tf JOIN wt USING (term) JOIN s USING (r), c),
sc AS (SELECT i, item_id, r, doc_id, CAST(sum(q * gain) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN s USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
