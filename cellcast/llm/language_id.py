"""Language identification: averaged hashed subword embeddings and a linear softmax.

Character 1- to 3-grams of the whole lower-cased text (runs of non-letters are one space)
are hashed into ``BUCKETS`` rows of an embedding table; the mean of a text's rows goes
through a linear softmax.  Both layers are trained together by mini-batch gradient descent
in numpy on a bounded sample of labelled rows (``sample`` rows at most, the ones of least
hash).  A fifth of the sample is kept for calibration: a temperature that makes the scores
probabilities, and two rejection bounds, each with a ``reject`` share of new texts of the
learned languages below it.  One is on how familiar a text is: the mean log probability of
its n-grams in the language they fit best, less that of the language's own texts, times the
root of their number; it rejects languages, scripts and letter salads that were never
learned, and each fifth in turn is calibrated by the others' n-grams.  The other is on the log odds of the score, and at most even odds: it rejects texts
whose language is unclear by more than that of calibration texts.  As both layers are linear, prediction needs only their product and the log probabilities, two tables of
BUCKETS x languages, which are bounded by their parameters.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected;
if no labelled row can be learned from, every text is; lang, source and doc_id are never
inputs of a prediction; repeated rows get equal results; an empty table gives an empty
result; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

import functools
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import shingles, store

QUERY = "op10_language_id"
ORACLE_SQL = None      # a trained model; tested by held-out accuracy

BUCKETS = 4096
WIDTH = 16
SAMPLE = 4000          # labelled rows at most
REJECT = 0.001         # share of texts of the learned languages below either rejection bound
LONG = 10_000          # n-grams beyond which a text's mean log probability varies no less
U = np.uint64


@functools.cache
def letters() -> np.ndarray:
    """Lower-case code point of each letter, 32 for everything else."""
    def fold(c):
        ch = chr(c)
        if not ch.isalpha():
            return 32
        low = ch.lower()
        return ord(low) if len(low) == 1 else c
    return np.fromiter((fold(c) for c in range(0x110000)), np.uint32, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed 1- to 3-gram counts of a whole text; None if it has no letter."""
    if not text:
        return None
    x = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = x != 32
    if not inside.any():
        return None
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    x = np.concatenate(([32], x[keep], [32])).astype(U)
    two = x[:-1] | (x[1:] << U(21))
    three = two[:-1] | (x[2:] << U(42))
    out = np.zeros(BUCKETS, np.int64)
    for g in (x[1:-1], two, three):
        out += np.bincount((shingles.mixed(g + U(17)) >> U(52)).astype(np.int64), minlength=BUCKETS)
    return out


def _sample_counts(batches):
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    for b in batches:
        rows = []
        for lang, h, text in zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
            c = counts(text)
            if c is not None:
                at = np.flatnonzero(c)
                rows.append((lang, h, at.astype(np.int32), c[at].astype(np.int32)))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def held_out():
    """Whether a row is kept out of training: crc32 of doc_id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, h, and sparse counts of at most ``sample`` labelled rows that are not held out."""
    key = F.xxhash64(F.lit("sample"), "doc_id").alias("h")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    chosen = rows.select("doc_id", "lang", key).distinct().orderBy("h", "lang").limit(sample)
    picked = rows.select("doc_id", "lang", key, "text").join(F.broadcast(chosen.select("h", "lang")), ["h", "lang"], "left_semi")
    picked = picked.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return picked.mapInArrow(_sample_counts, "lang string, h long, at array<int>, n array<int>")


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def log_odds(z: np.ndarray) -> np.ndarray:
    """Log odds of each row's largest logit against the others together; 0 for one language."""
    z = np.sort(z, axis=1)
    if z.shape[1] < 2:
        return np.zeros(len(z))
    top, rest = z[:, -1], z[:, :-1]
    return top - rest[:, -1] - np.log(np.exp(rest - rest[:, -1:]).sum(axis=1))


def log_shares(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Log probability of each bucket in each of n languages: its share, smoothed by that of all texts."""
    back = x.sum(axis=0, dtype=np.float64) + 1 / BUCKETS
    back /= back.sum()
    own = np.stack([x[y == k].sum(axis=0, dtype=np.float64) for k in range(n)], axis=1)
    weight = np.maximum(1, 0.05 * np.bincount(y, minlength=n))
    return np.log((own + weight * back[:, None]) / (own.sum(axis=0) + weight))


def familiarity(share: np.ndarray, size: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Each text's mean log probability less the language's own, in the language that it fits best; spread evened out over ``size`` n-grams."""
    own = (np.exp(logs) * logs).sum(axis=0)
    return (share @ logs - own).max(axis=1) / np.sqrt(1 / size + 1 / LONG)


def lower_bound(v: np.ndarray, share: float) -> float:
    """A bound that at most about ``share`` of new values fall below: the quantile of ``v``, or the normal
    prediction bound (Student's t) where that is lower, as it is if the values are too few for the quantile."""
    n = len(v)
    if n < 2:
        return -np.inf
    z, f = NormalDist().inv_cdf(1 - share), n - 1
    t = z + (z ** 3 + z) / (4 * f) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * f ** 2)
    return float(min(np.quantile(v, share, method="lower"), v.mean() - t * v.std(ddof=1) * np.sqrt(1 + 1 / n)))


def train(docs: DataFrame, sample: int = SAMPLE, reject: float = REJECT, epochs: int = 60, rate: float = 0.5, batch: int = 32) -> dict:
    """The model: languages, table (BUCKETS x languages), bias, logs (log probabilities), and the bounds of log odds and familiarity."""
    rows = sorted(labelled_sample(docs, sample).toLocalIterator(), key=lambda r: (r.h, r.lang))
    langs = sorted({r.lang for r in rows})
    if not rows:
        return {"langs": [], "table": np.zeros((BUCKETS, 0)), "bias": np.zeros(0), "logs": np.zeros((BUCKETS, 0)), "bounds": (np.inf, np.inf)}
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, r.at] = np.array(r.n, np.float32) / sum(r.n)
    y = np.array([langs.index(r.lang) for r in rows])
    aside = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~aside)
    rng = np.random.default_rng(5)
    emb = rng.standard_normal((BUCKETS, WIDTH)).astype(np.float32) * 0.1
    out = rng.standard_normal((WIDTH, len(langs))).astype(np.float32) * 0.1
    bias = np.zeros(len(langs), np.float32)
    scale = 30.0                                     # the mean of many rows is small; the rate of the table is scaled up
    onehot = np.eye(len(langs), dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows_at in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            h = x[rows_at] @ emb
            g = (softmax(h @ out + bias) - onehot[y[rows_at]]) / len(rows_at)
            gh = g @ out.T
            out -= step * (h.T @ g)
            bias -= step * g.sum(axis=0)
            emb -= step * scale * (x[rows_at].T @ gh)
    table = (emb @ out).astype(np.float64)
    cal = np.flatnonzero(aside) if aside.any() else fit
    z = x[cal] @ table + bias
    heat = min(np.geomspace(0.05, 5, 60), key=lambda t: -np.log(softmax(z / t)[np.arange(len(cal)), y[cal]] + 1e-12).mean())
    fold, size, known = np.arange(len(rows)) % 5, np.array([sum(r.n) for r in rows]), np.zeros(len(rows))
    for k in range(5 if aside.any() else 0):
        known[fold == k] = familiarity(x[fold == k], size[fold == k], log_shares(x[fold != k], y[fold != k], len(langs)))
    known, logs = known if aside.any() else known[:0], log_shares(x, y, len(langs))
    bounds = (min(0.0, lower_bound(log_odds(z / heat), reject)), lower_bound(known, reject))
    return {"langs": langs, "table": table / heat, "bias": bias / heat, "logs": logs, "bounds": bounds}


def _predict(model: dict, fields: list[str], names: tuple):
    langs, table, bias, logs, bounds = (model[k] for k in ("langs", "table", "bias", "logs", "bounds"))

    def run(batches):
        for b in batches:
            pred, score, rejected = [], [], []
            for text in b.column("text").to_pylist():
                c = counts(text) if langs else None
                if c is None:
                    pred.append("und")
                    score.append(0.0)
                    rejected.append(True)
                    continue
                share = (c / c.sum())[None, :]
                z = share @ table + bias
                pred.append(langs[int(z.argmax())])
                score.append(float(softmax(z).max()))
                rejected.append(bool(log_odds(z)[0] < bounds[0] or familiarity(share, c.sum(keepdims=True), logs)[0] < bounds[1]))
            extra = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[b.column(f) for f in fields], *extra], names=[*fields, *names])
    return run


def predict(docs: DataFrame, model: dict, names: tuple = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with three more columns: the language, its score, and whether it is rejected."""
    types = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean"), strict=True))]
    return docs.mapInArrow(_predict(model, docs.columns, names), ", ".join(types))


def recognised(docs: DataFrame, model: dict) -> DataFrame:
    """docs without the rejected ones; all columns pass through."""
    names = tuple(store.fresh(docs, "lang_pred", "score", "rejected"))
    return predict(docs, model, names).where(~F.col(names[2])).select(*docs.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    model = train(docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
