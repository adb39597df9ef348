"""Token counts as an exact length histogram.

Every whole text is encoded with a byte-level BPE vocabulary (a file whose path is a
parameter; it must be on every node), documents are counted per encoded length, and suffix
sums over the lengths answer, for *every* context limit, how many documents exceed it, how
many tokens remain when each document is cut there, and every quantile.

The sums are exact and distributed: lengths are dealt into ranges of ``RANGE``; each range is
summed in its own window, and the ranges' totals (longest text / RANGE rows) give the offsets.

The tokenizer library's expressions recurse over white space, so runs of ``RUN`` or more white-space characters
are cut out where the pattern splits anyway: all but a run's last character are one piece (all of it at the text's
end), which is contracted by the recursive query of ``byte_bpe``.

Defined results: null text has length 0; repeated rows count each; control strings of the
vocabulary are ordinary text; an empty table gives an empty histogram; other columns are
ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcast.llm import byte_bpe, store

QUERY = "op2_token_histogram"
ORACLE_SQL = None     # SQL has no tokenizer; tested against per-document counts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pre-tokenisation pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANGE = 1024
RUN = 1_000            # white-space characters in a row that are not given to the library


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _long_run():
    return re.compile(f"[{byte_bpe.SPACE}]{{{RUN},}}")


def cut(text: str) -> Iterator[tuple[bool, str]]:
    """(whether it is one long piece of white space, part) of a text, in order; the parts are encoded apart from each other."""
    at = 0
    for m in _long_run().finditer(text):
        end = m.end() - (m.end() < len(text))      # the last character may belong to the next piece
        yield False, text[at:m.start()]
        yield True, text[m.start():end]
        at = end
    yield False, text[at:]


def count(path: str, text: str) -> int:
    """Tokens of a whole text."""
    enc = encoding(path)
    return sum(len(byte_bpe.codec(path).encode(pa.array([part]))[0]) if run else len(enc.encode_ordinary(part)) for run, part in cut(text))


def _counter(path: str):
    def run(batches):
        for b in batches:
            n = [count(path, t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.record_batch([pa.array(n, pa.int64())], names=["n_tokens"])
    return run


def lengths(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """n_tokens of each document."""
    return docs.select("text").mapInArrow(_counter(path), "n_tokens long")


def histogram(lens: DataFrame) -> DataFrame:
    """One row per length that occurs:

    n_tokens; docs, tokens (of that length); docs_over, tokens_over (of greater length);
    docs_upto, tokens_upto (of at most that length); kept_tokens (of all documents, each cut at
    n_tokens), cut_docs (documents that lose tokens there) and quantile (share of documents of
    at most that length).
    """
    per = store.save(lens.groupBy("n_tokens").agg(F.count("*").alias("docs")).withColumn(
        "tokens", F.col("docs") * F.col("n_tokens")).withColumn("range", F.floor(F.col("n_tokens") / RANGE)), "token-lengths")
    up = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranges = per.groupBy("range").agg(F.sum("docs").alias("rd"), F.sum("tokens").alias("rt")).select(
        "range", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"{c}_before") for c in ("rd", "rt")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("rd", "rt")])
    own = Window.partitionBy("range").orderBy("n_tokens")
    d = per.join(ranges, "range")
    d = d.withColumn("docs_upto", F.sum("docs").over(own) + F.col("rd_before")).withColumn("tokens_upto", F.sum("tokens").over(own) + F.col("rt_before"))
    over, over_t = F.col("rd_all") - F.col("docs_upto"), F.col("rt_all") - F.col("tokens_upto")
    return d.select("n_tokens", "docs", "tokens", over.alias("docs_over"), over_t.alias("tokens_over"), "docs_upto", "tokens_upto",
                    (F.col("tokens_upto") + over * F.col("n_tokens")).alias("kept_tokens"), over.alias("cut_docs"),
                    (F.col("docs_upto") / F.col("rd_all")).alias("quantile"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, kept_tokens, cut_docs: exact answers for any list of context limits, from the histogram alone."""
    s = hist.sparkSession
    ask = s.createDataFrame([(int(x),) for x in limits], "limit long")
    total = hist.agg(*[F.coalesce(F.sum(F.least("n_tokens", F.lit(int(x))) * F.col("docs")), F.lit(0)).alias(f"k{i}") for i, x in enumerate(limits)],
                     *[F.coalesce(F.sum(F.when(F.col("n_tokens") > int(x), F.col("docs"))), F.lit(0)).alias(f"c{i}") for i, x in enumerate(limits)])
    rows = total.select(F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("limit"), F.col(f"k{i}").alias("kept_tokens"),
                                                     F.col(f"c{i}").alias("cut_docs")) for i, x in enumerate(limits)])).alias("r"))
    return ask.join(rows.select("r.*").distinct(), "limit")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(store.table(spark, sf_dir, "documents")))
