"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are normalised alike (lower case, every run of other characters one space;
offsets into the original are kept).  An item of m characters may differ by k = edits * m
edits.  By the q-gram lemma a matching region then shares at least m + 1 - q (k + 1) of the
item's q-grams, all within k diagonals of the match's start.  So shared q-grams are counted
in overlapping diagonal bands (each window of 2k + 1 diagonals lies inside one of them), the
bands that meet the bound are kept, and each is verified by banded alignment, which gives
the region and its number of edits.  No text is shuffled: documents are streamed against an
index of the items.

The index is sent to the executors, so its size is checked: items are read one by one and
packed into indexes of at most ``INDEX_CHARS`` characters; further items make further passes.

A match is a whole item: a document that holds only part of one (cut, or a passage of a long item)
differs by more than the budget and is no match.

Defined results: null texts and items have no match; an item too short for the lemma gets a
smaller budget, one shorter than q is no evidence and matches nothing; repeated rows and
repeated items each give their own rows; an empty table gives an empty result; other columns
are ignored (``remove`` passes them through).
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import store

QUERY = "op7_qgram_decontaminate"
ORACLE_SQL = None     # tested against full alignment on a fixture

Q = 8                  # characters of a q-gram; one byte each in a 64-bit word
EDITS = 0.1            # edits allowed per character of an item
INDEX_CHARS = 4_000_000
U = np.uint64
SPACE = 32


@functools.cache
def folded() -> np.ndarray:
    """Lower-case code point of letters, marks and digits; a space for everything else."""
    import unicodedata

    def fold(c):
        ch = chr(c)
        if unicodedata.category(ch)[0] not in "LMN":
            return SPACE
        low = ch.lower()
        return ord(low) if len(low) == 1 else c
    return np.fromiter((fold(c) for c in range(0x110000)), np.uint32, 0x110000)


def normal(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points and the place of each in the text."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    x = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = x != SPACE
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    at = np.flatnonzero(keep)
    if len(at) and not inside[at[-1]]:
        at = at[:-1]
    return x[at], at


def qgrams(x: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each place, one byte a character (equal characters, equal bytes)."""
    if len(x) < Q:
        return np.empty(0, U)
    b = ((x ^ (x >> np.uint32(8))) & np.uint32(0xFF)).astype(np.uint16)
    two = b[:-1] | (b[1:] << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4].astype(U) | (four[4:].astype(U) << U(32))


def slot(g: np.ndarray) -> np.ndarray:
    return ((g * U(0x9E3779B97F4A7C15)) >> U(44)).astype(np.int64)


def budget(m: int, edits: float) -> int:
    """Edits allowed in an item of m characters: as asked, but so that the lemma still asks for a shared q-gram."""
    return min(int(edits * m), max(0, m // Q - 1))


def index(items: list[tuple[int, str]], edits: float) -> dict:
    """Distinct q-grams (sorted), their places (item, offset) in CSR form, and a bitmap over hash slots."""
    texts = [normal(t)[0] for _, t in items]
    texts = [(i, x, budget(len(x), edits)) for (i, _), x in zip(items, texts, strict=True) if len(x) >= Q]
    grams = [qgrams(x) for _, x, _ in texts]
    allg = np.concatenate([np.empty(0, U), *grams])
    owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    offset = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])
    order = np.argsort(allg, kind="stable")
    keys, first = np.unique(allg[order], return_index=True)
    bits = np.zeros(1 << 20, bool)
    bits[slot(keys)] = True
    return {"items": texts, "keys": keys, "first": np.append(first, len(allg)), "owner": owner[order].astype(np.int32),
            "offset": offset[order].astype(np.int32), "bits": bits}


HITS = 1_000_000       # pairs of equal q-grams that a text's window holds, but for one text place and the overlap


def _windows(n: np.ndarray, at: np.ndarray, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(a, c, until): windows of text places a..c with about ``HITS`` pairs before character ``until``, where the next
    window begins, and those of the following ``overlap`` characters."""
    total = np.cumsum(n)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, side="right")))
        until = int(at[b]) if b < len(at) else int(at[-1]) + 1
        yield a, int(np.searchsorted(at, until + overlap, side="right")), until
        a = b


def _bands(ix: dict, x: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(item number, first diagonal, last diagonal, shared q-grams) of the bands that meet the lemma's bound.

    The bound is put to the item's distinct q-grams that have an equal one in the band, which
    is what the lemma counts.  The text is read in windows that overlap by the longest band; a
    band is counted in the window that holds its first text place, so memory is bounded and the
    work follows the number of pairs of equal q-grams.
    """
    g = qgrams(x)
    at = np.flatnonzero(ix["bits"][slot(g)]) if len(g) else np.empty(0, np.int64)
    if not len(at):
        return
    k = np.searchsorted(ix["keys"], g[at])
    real = ix["keys"][np.minimum(k, len(ix["keys"]) - 1)] == g[at]
    at, k = at[real], k[real]
    n = ix["first"][k + 1] - ix["first"][k]
    begin = 0
    for a, c, until in _windows(n, at, ix["longest"] + 2 * int(ix["width"].max())):
        yield from _window_bands(ix, at[a:c], k[a:c], n[a:c], begin, until)
        begin = until


def _window_bands(ix: dict, at: np.ndarray, k: np.ndarray, n: np.ndarray, begin: int, until: int) -> Iterator[tuple[int, int, int, int]]:
    """The bands among some text places whose first place is one of begin..until-1."""
    place = np.repeat(ix["first"][k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    item = ix["owner"][place].astype(np.int64)
    offset = ix["offset"][place].astype(np.int64)
    band = (np.repeat(at, n) - offset + ix["longest"]) // ix["width"][item]
    item, offset, band = np.tile(item, 2), np.tile(offset, 2), np.concatenate((band, band - 1))
    first = np.maximum(band * ix["width"][item] - ix["longest"], 0)
    own = (band >= 0) & (first >= begin) & (first < until)
    item, band, offset = item[own], band[own], offset[own]
    if not len(item):
        return
    low, wide, far = int(band.min()), int(np.ptp(band)) + 1, ix["longest"]
    if len(ix["items"]) * wide * far < 1 << 62:
        key = item * wide + (band - low)                   # one number a band, so that numbers can be sorted
        names = None
    else:
        names, key = np.unique((item << 40) | band, return_inverse=True)
    hit = key * far + offset
    hit.sort()
    hit = hit[np.concatenate(([True], hit[1:] != hit[:-1]))] // far
    edges = np.flatnonzero(np.concatenate(([True], hit[1:] != hit[:-1], [True])))
    shared, keys = np.diff(edges), hit[edges[:-1]]
    keys = (keys // wide << 40) | (keys % wide + low) if names is None else names[keys]
    held = shared >= ix["least"][keys >> 40]
    for kk, s in zip(keys[held].tolist(), shared[held].tolist(), strict=True):
        i, b = kk >> 40, kk & ((1 << 40) - 1)
        w = int(ix["width"][i])
        yield i, b * w - ix["longest"], (b + 2) * w - 1 - ix["longest"], s


FAR = 1 << 40          # more than any number of edits, in the packed table
ONE = 1 << 24          # an edit in the packed table; below it, the diagonal on which a path began


def align(jobs: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[tuple[int, int, int]]:
    """(edits, start, end) of each item p in a stretch of text x whose start diagonal lies in low..high.

    Banded: the table holds the diagonals low..high only, one row per character of p.  All jobs
    go row by row together, as one array (job x diagonal).  A cell packs its edits and the
    diagonal on which its path began; the running minimum along a row is the insertions.
    """
    wide = max(high - low + 1 for _, _, low, high in jobs)
    most = max(len(p) for p, _, _, _ in jobs)
    text = np.full((len(jobs), most + wide), -1, np.int32)
    item = np.full((len(jobs), most), -2, np.int32)
    cell = np.full((len(jobs), wide), FAR, np.int64)
    for r, (p, x, low, high) in enumerate(jobs):
        a, b = max(0, low), min(len(x), low + most + wide)
        if b > a:
            text[r, a - low:b - low] = x[a:b]
        item[r, :len(p)] = p
        first, last = max(0, low) - low, min(high, len(x)) - low
        cell[r, first:last + 1] = np.arange(first, last + 1)
    steps = np.arange(wide, dtype=np.int64) * ONE
    length = np.array([len(p) for p, _, _, _ in jobs])
    out: list = [None] * len(jobs)
    for i in range(most + 1):
        for r in np.flatnonzero(length == i).tolist():
            p, x, low, high = jobs[r]
            ends = i + low + np.arange(wide)
            row = np.where((ends >= 0) & (ends <= len(x)) & (np.arange(wide) <= high - low), cell[r], FAR)
            d = int(row.argmin())
            out[r] = (int(row[d] >> 24), int(row[d] & (ONE - 1)) + low, i + low + d)
        if i == most:
            break
        seen = text[:, i:i + wide]
        new = cell + np.where(seen == item[:, i:i + 1], 0, ONE)
        new[seen < 0] = FAR
        np.minimum(new[:, :-1], cell[:, 1:] + ONE, out=new[:, :-1])
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)
        cell = new + steps
    return out


JOBS = 128             # alignments that run together
HELD = 2_000_000       # characters of texts that wait for alignment


def matches(ix: dict, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
    """(item_id, start, end, edits, shared q-grams) of every item found, for each whole text.

    Bands overlap, so of regions of one item that overlap by half the one of fewest edits stays.
    """
    out: list = [[] for _ in texts]
    wait: list = []
    held = 0
    for r, text in enumerate(texts):
        x, places = normal(text)
        found = list(_bands(ix, x))
        wait += [(r, x, places, *f) for f in found]
        held += len(x) if found else 0
        if held > HELD:
            _settle(ix, wait, out)
            wait, held = [], 0
    _settle(ix, wait, out)
    return out


def _settle(ix: dict, wait: list, out: list) -> None:
    """Align what waits, items of like length together, and put the regions that verify into ``out``."""
    wait.sort(key=lambda c: (len(ix["items"][c[3]][1]), c[0], c[3], c[4]))
    regions: dict = {}
    for s in range(0, len(wait), JOBS):
        part = wait[s:s + JOBS]
        for (r, _, places, i, _, _, shared), (edits, start, end) in zip(
                part, align([(ix["items"][c[3]][1], c[1], c[4], c[5]) for c in part]), strict=True):
            if edits <= ix["items"][i][2] and end > start:
                regions.setdefault((r, i), []).append((edits, start, end, shared, places))
    for (r, i), rows in sorted(regions.items()):
        for edits, start, end, shared, places in _apart(rows):
            out[r].append((ix["items"][i][0], int(places[start]), int(places[end - 1]) + 1, edits, shared))


def _apart(rows: list) -> list:
    """Of regions (edits, start, end, ...) that overlap by more than half of the worse one, the better; by start."""
    kept: list = []        # by start
    most = max(row[2] - row[1] for row in rows)
    for row in sorted(rows, key=lambda t: t[:3]):
        _, start, end = row[:3]
        near = kept[bisect.bisect_left(kept, start - most, key=lambda o: o[1]):bisect.bisect_right(kept, end, key=lambda o: o[1])]
        if all(min(end, o[2]) - max(start, o[1]) <= (end - start) / 2 for o in near):
            bisect.insort(kept, row, key=lambda o: o[1])
    return kept


def _indexes(benchmark: DataFrame, edits: float, most: int) -> Iterator[dict]:
    """Indexes of at most ``most`` characters each (one item may be larger), read row by row."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if held and size + len(r.text) > most:
            yield _finished(index(held, edits))
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield _finished(index(held, edits))


def _finished(ix: dict) -> dict:
    lens = np.array([len(p) for _, p, _ in ix["items"]], np.int64)
    ks = np.array([k for _, _, k in ix["items"]], np.int64)
    return ix | {"width": 2 * ks + 1, "least": lens + 1 - Q * (ks + 1), "longest": int(lens.max()) if len(lens) else 0}


FOUND = "array<struct<item_id:bigint,start:int,end:int,edits:int,shared:int>>"


def _finder(ix, names: list[str], leaks: str = "leaks"):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("shared", pa.int32())]))
    keys = ("item_id", "start", "end", "edits", "shared")

    def run(batches):
        for b in batches:
            rows = [[dict(zip(keys, r, strict=True)) for r in found] for found in matches(ix.value, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(rows, kind)], names=[*names, leaks])
    return run


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), more])


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, most: int = INDEX_CHARS) -> DataFrame:
    """doc_id, item_id, start, end (code points of the original text), edits, shared: one row per place."""
    d, out = docs.select("doc_id", "text"), None
    schema = _schema(d.select("doc_id"), f"leaks {FOUND}")
    for ix in _indexes(benchmark, edits, most):
        sent = docs.sparkSession.sparkContext.broadcast(ix)
        part = store.save(d.mapInArrow(_finder(sent, ["doc_id"]), schema).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*"), "leaks")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = d.limit(0).select("doc_id", F.array().cast(FOUND).alias("l")).select("doc_id", F.explode("l").alias("l")).select("doc_id", "l.*")
    return out


def remove(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, most: int = INDEX_CHARS) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns pass through."""
    out, names = docs, docs.columns
    found, = store.fresh(docs, "leaks")
    for ix in _indexes(benchmark, edits, most):
        sent = docs.sparkSession.sparkContext.broadcast(ix)
        out = out.mapInArrow(_finder(sent, names, found), _schema(docs, f"`{found}` {FOUND}")).where(F.size(found) == 0).select(*names)
    return out


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))
