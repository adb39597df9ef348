"""Byte-level BPE encoding and decoding by DuckDB queries inside the partitions.

``encode`` cuts every whole text into pieces with the vocabulary's pattern (Spark's own regular
expressions) and sends the pieces to Arrow tasks.  A task encodes each different piece once: its
bytes become token-position rows, and a recursive query joins neighbouring rows with the merge
table and contracts each piece's leftmost pair of minimum rank until no pair is left.  ``decode``
joins ids with the vocabulary and concatenates their bytes by an ordered aggregation.

*Long pieces.*  A merge needs a vocabulary entry that holds the two bytes at its seam.  Pieces of
more than ``SHORT`` bytes are cut between bytes that stand side by side in no entry, which changes
no result.  What is still long contracts all places of its minimum pair at once, from the left and
without overlap.  In a trained vocabulary a merge makes only pairs of higher rank than its own, so
this equals contracting them one after the other (``well_ordered`` tests a vocabulary for it); a
run of a million equal characters takes some twenty steps.

*Memory.*  A task holds pieces of about ``PART`` rows, and a store of ``STORED`` encoded pieces that
is emptied when full.  Texts of more than ``LONG`` characters, and texts with characters that the
JVM's Unicode tables do not know, are cut into pieces by the task, some at a time.

The vocabulary is a file whose path is a parameter; it must be on every node.

Defined results: null text has no tokens and decodes to nothing, as the empty one; control strings of the
vocabulary are ordinary text; repeated rows each give their row; an empty table gives an empty
result; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import store

QUERY = "op11_byte_bpe"
ORACLE_SQL = None     # SQL has no such tokenizer; tested against the public tokenizer library

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Unicode's white space, and the vocabulary's pre-tokenisation pattern over it.
SPACE = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

SHORT = 64             # bytes of a piece whose pairs are contracted one at a time
PART = 500_000         # pieces or ids that a task holds at once
BYTES = 300_000        # bytes of new pieces in a query
STORED = 300_000       # encoded pieces that a worker keeps
LONG = 1_000_000       # characters of a text that the JVM cuts into pieces
BLOCK = 4_096          # ids that one ordered aggregation concatenates

# One contraction a step. Row p of a piece holds its token and the next one (-1 at the end), without gaps: the contracted
# row goes, its left neighbour has a new next token and its right neighbour becomes the merged token.
ONE_PAIR = """
WITH RECURSIVE s(w, p, t, nxt, step) AS (
  SELECT w, p, t, nxt, 0 FROM start
  UNION ALL
  SELECT s.w, CASE WHEN s.p > best.p THEN s.p - 1 ELSE s.p END, CASE WHEN s.p = best.p + 1 THEN best.id ELSE s.t END,
    CASE WHEN s.p = best.p - 1 THEN best.id ELSE s.nxt END, s.step + 1
  FROM s JOIN (
    SELECT w, CAST(min(k) >> 32 AS INTEGER) AS id, CAST(min(k) & 4294967295 AS INTEGER) AS p FROM (
      SELECT s.w, (m.id::BIGINT << 32) | s.p AS k FROM s JOIN merges m ON m.l = s.t AND m.r = s.nxt)
    GROUP BY w) best USING (w)
  WHERE s.p <> best.p)
SELECT w, t FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) USING (w, step) ORDER BY w, p
"""

# All places of a piece's minimum pair a step; rows are kept by place, t = -1 marks one that went into its left neighbour,
# e is the place after a row. In a run of overlapping pairs the first, third ... contract.
ALL_PLACES = """
WITH RECURSIVE s(w, p, t, e) USING KEY (w, p) AS (
  SELECT w, p, t, p + 1 FROM start
  UNION
  SELECT w, x.p, x.t, x.e FROM (
    SELECT w, unnest([{'p': p, 't': id, 'e': be}, {'p': bp, 't': -1, 'e': be}]) AS x FROM (
      SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY w ORDER BY p) AS run FROM (
          SELECT *, CASE WHEN lag(bp) OVER (PARTITION BY w ORDER BY p) = p THEN 0 ELSE 1 END AS fresh FROM (
            SELECT a.w, a.p, b.p AS bp, b.e AS be, m.id, min(m.id) OVER (PARTITION BY a.w) AS least
            FROM recurring.s a JOIN recurring.s b ON b.w = a.w AND b.p = a.e JOIN merges m ON m.l = a.t AND m.r = b.t
            WHERE a.t >= 0 AND a.w IN (SELECT w FROM s))
          WHERE id = least)))
    WHERE n % 2 = 1))
SELECT w, t FROM s WHERE t >= 0 ORDER BY w, p
"""

DECODED = "SELECT g, string_agg(chars, '' ORDER BY p) AS chars FROM ids JOIN vocab USING (id) GROUP BY g ORDER BY g"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """A vocabulary in a DuckDB database of this worker, and the pieces encoded so far."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        merges = [(a, b, i) for tok, i in vocabulary.items() for k in range(1, len(tok))
                  if (a := vocabulary.get(tok[:k])) is not None and (b := vocabulary.get(tok[k:])) is not None]
        m = np.array(merges, np.int32).reshape(-1, 3)
        self._table("merges", l=m[:, 0], r=m[:, 1], id=m[:, 2])
        # bytes as the characters of the same number: DuckDB concatenates strings, not blobs
        self._table("vocab", id=np.array(list(vocabulary.values()), np.int32), chars=[t.decode("latin-1") for t in vocabulary])
        self.single = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        self.inside = np.zeros(1 << 16, bool)
        for tok in vocabulary:
            x = np.frombuffer(tok, np.uint8).astype(np.int64)
            self.inside[x[:-1] * 256 + x[1:]] = True
        self._empty()

    def _table(self, name: str, **cols) -> None:
        self.con.register("given", pa.table(cols))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _empty(self) -> None:
        self.number: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids, self.used = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.int32), 0

    def _add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.number), len(self.number) + len(pieces)
        while m > len(self.starts):
            self.starts, self.sizes = (np.concatenate((a, np.zeros_like(a))) for a in (self.starts, self.sizes))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.sizes[n:m] = sizes
        self.starts[n:m] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.number.update(zip(pieces, range(n, m), strict=True))

    def _contract(self, pieces: list[bytes], query: str) -> None:
        """Encode different pieces, some ``BYTES`` a query."""
        for part in _parts(pieces, len, BYTES):
            lens = np.array([len(b) for b in part], np.int64)
            place = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            token = self.single[np.frombuffer(b"".join(part), np.uint8)]
            following = np.append(token[1:], -1)
            following[np.cumsum(lens) - 1] = -1
            self.con.register("start", pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), lens), "p": place.astype(np.int32),
                                                 "t": token, "nxt": following.astype(np.int32)}))
            out = self.con.sql(query).to_arrow_table()
            self.con.unregister("start")
            self._add(part, out["t"].to_numpy(), np.bincount(out["w"].to_numpy(), minlength=len(part)))

    def _cut(self, piece: bytes) -> list[bytes]:
        x = np.frombuffer(piece, np.uint8).astype(np.int64)
        at = [0, *(np.flatnonzero(~self.inside[x[:-1] * 256 + x[1:]]) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in itertools.pairwise(at)]

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Where the store holds each of some different pieces; those it lacks are encoded."""
        new = [p for p in pieces if p not in self.number]
        if new and len(self.number) + len(new) > STORED:
            self._empty()
            new = pieces
        short, long = [p for p in new if len(p) <= SHORT], {p: self._cut(p) for p in new if len(p) > SHORT}
        cuts = set(itertools.chain.from_iterable(long.values())) - set(short) - self.number.keys()
        self._contract([*short, *(c for c in cuts if len(c) <= SHORT)], ONE_PAIR)
        self._contract([c for c in cuts if len(c) > SHORT], ALL_PLACES)
        for piece, parts in long.items():
            if piece not in self.number:
                ids, sizes = self.tokens(np.array([self.number[c] for c in parts], np.int64))
                self._add([piece], ids, np.array([sizes.sum()]))
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def tokens(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stored pieces one after the other, and how many each has."""
        sizes = self.sizes[at]
        place = np.arange(sizes.sum()) + np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[place], sizes

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string array, and how many each string has."""
        coded = pieces.dictionary_encode()
        different = [p.encode() for p in coded.dictionary.to_pylist()]
        return self.tokens(self.numbers(different)[coded.indices.to_numpy(zero_copy_only=False)])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of consecutive groups of ids."""
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        blocks = np.maximum(-(-sizes // BLOCK), 1)
        first = np.cumsum(blocks) - blocks
        group = np.repeat(first, sizes) + place // BLOCK
        self.con.register("ids", pa.table({"g": group, "p": place, "id": ids}))
        got = self.con.sql(DECODED).to_arrow_table()
        self.con.unregister("ids")
        chars = [b""] * int(blocks.sum())
        for g, s in zip(got["g"].to_pylist(), got["chars"].to_pylist(), strict=True):
            chars[g] = s.encode("latin-1")
        return [b"".join(chars[a:a + n]) for a, n in zip(first.tolist(), blocks.tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(ranks(path))


def well_ordered(vocabulary: dict[bytes, int]) -> bool:
    """Whether every entry of several bytes comes out of merges of lower rank than its own."""
    def parts(tok, limit):
        t = [tok[i:i + 1] for i in range(len(tok))]
        while len(t) > 2:
            rank, i = min(((vocabulary.get(t[i] + t[i + 1], limit), i) for i in range(len(t) - 1)))
            if rank >= limit:
                break
            t[i:i + 2] = [t[i] + t[i + 1]]
        return len(t)
    return all(parts(tok, i) == 2 for tok, i in vocabulary.items() if len(tok) > 1)


def _parts(rows: list, size, most: int) -> Iterator[list]:
    """Consecutive rows whose sizes sum to at most ``most`` (or one larger row)."""
    part, held = [], 0
    for r in rows:
        n = size(r)
        if part and held + n > most:
            yield part
            part, held = [], 0
        part.append(r)
        held += n
    if part:
        yield part


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive rows a..b that hold about ``PART`` together."""
    for part in _parts(list(enumerate(sizes.tolist())), lambda r: r[1], PART):
        yield part[0][0], part[-1][0] + 1


@functools.cache
def _pattern():
    return regex.compile(PATTERN)


def _whole(c: Codec, text: str) -> np.ndarray:
    """Ids of a text that is cut into pieces here."""
    found, out = (m.group() for m in _pattern().finditer(text)), [np.empty(0, np.int32)]
    while some := list(itertools.islice(found, PART)):
        out.append(c.encode(pa.array(some, pa.string()))[0])
    return np.concatenate(out)


def _encoder(path: str, key: pa.Field):
    schema = pa.schema([key, ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            lists, whole = batch.column("pieces"), batch.column("whole")
            flat, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
            for a, b in _runs(np.diff(offsets)):
                ids, each = c.encode(flat.slice(offsets[a], offsets[b] - offsets[a]))
                ends = np.concatenate(([0], np.cumsum(each)))[offsets[a:b + 1] - offsets[a]]
                rows = [ids[s:e] for s, e in itertools.pairwise(ends.tolist())]
                for r in range(a, b):
                    if whole[r].is_valid:
                        rows[r - a] = _whole(c, whole[r].as_py())
                sizes = np.array([len(x) for x in rows])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).cast(key.type),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(rows), pa.int32())),
                    pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows])], schema=schema)
    return run


def encode(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, ids (array of int), n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers)."""
    t = F.coalesce(F.col(text), F.lit(""))
    here = (F.length(t) > LONG) | t.rlike(r"\p{Cn}")
    d = docs.select(F.col(key), F.when(here, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).alias("pieces"),
                    F.when(here, t).alias("whole"))
    kind = d.schema[0].dataType
    return d.mapInArrow(_encoder(path, _field(kind)), f"`{key}` {kind.simpleString()}, ids array<int>, n_tokens long, ids_sha256 string")


def _field(kind) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.field("key", to_arrow_type(kind))


def _decoder(path: str, names: list[str]):
    def run(batches):
        c = codec(path)
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
            for a, b in _runs(np.diff(offsets)):
                out = c.decode(flat[offsets[a]:offsets[b]], np.diff(offsets[a:b + 1]))
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, b - a) for n in names), pa.array(out, pa.binary())], names=[*names, "bytes"])
    return run


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The rows of ``tokens`` with the bytes of their ids (column ``bytes``, binary) instead of the ids."""
    names = [c for c in tokens.columns if c != "ids"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids"), "bytes binary"])
    return tokens.mapInArrow(_decoder(path, names), schema)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decode(encode(store.table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
