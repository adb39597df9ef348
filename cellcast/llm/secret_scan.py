"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

1. *Extraction.*  ``split`` and ``regexp_extract_all`` with the same pattern give the
   pieces between matches and the matches; their running lengths are the code-point
   offsets, so spans come out of built-in expressions alone.
2. *Frequency.*  The SHA-256 of every candidate value (never the value) is counted by
   distinct owner and by distinct (owner, repository).  Each step pre-aggregates on the
   full key, so a value that a third of all documents hold is no hot task.
3. *Verdict.*  A value is a widely copied example (``copied``) if ``min_owners`` owners hold it in
   as many different texts (copies of one text are one witness), or ``min_repos``
   repositories with different texts do.  One that is not copied is an owner-specific live
   credential (``live``) unless it holds a placeholder word or its characters say too little
   (entropy times length below the bound of its kind).  The rest stays a base span only.

Defined results: null text counts as empty; a null owner or repository is a value of its
own; repeated rows each get their own row; an empty table gives an empty result; columns
other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import store

QUERY = "op1_secret_ownership"

# The three base kinds, in listed order, and the least length of each.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,vstart:int,hash:string,held:boolean>>"
MIN_REPOS = 30         # repositories with different texts that make a value a copied example, whoever owns them
# Least bits of a live value by kind (8 characters, 4 of them different; runs of a few characters have less), and placeholder words.
BITS = {"assign": 16.0, "access": 24.0, "hex": 32.0}
EVEN = 1e-6            # sums of logarithms that differ by less are equal
PLACEHOLDER_WORD = r"(?:^|[^A-Za-z])(?i:example|changeme|placeholder|dummy|sample|your|x{4,})(?:$|[^A-Za-z])"


def bits(value):
    """Entropy of the value's characters times its length, the graded score of randomness."""
    n = F.length(value).cast("double")
    chars = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")

    def step(acc, c):
        k = n - F.length(F.replace(value, c, F.lit("")))
        return acc + k * F.log2(n / k)
    return F.aggregate(chars, F.lit(0.0), step)


def _spans(text, kind: str, matches, values):
    """Spans of one kind: running lengths of the pieces between matches and of the matches."""
    rank = KINDS.index(kind)
    parts = F.arrays_zip(F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(matches)).alias("gap"),
                         matches.alias("hit"), values.alias("val"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"),
                        (end - F.length(x["val"])).alias("vstart"), F.sha2(x["val"], 256).alias("hash"),
                        ((bits(x["val"]) >= BITS[kind] - EVEN) & ~x["val"].rlike(PLACEHOLDER_WORD)).alias("held"))
        keep = F.length(x["val"]) >= LEAST[kind]
        return F.struct(end.alias("pos"),
                        F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(parts, start, step, lambda a: a["out"])).otherwise(
        F.array().cast(SPAN))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def extract(docs: DataFrame, repo: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """repo, owner, key (of the text), spans: every base span of every whole text."""
    d = docs.select(F.col(repo).alias("repo"), F.col(owner).alias("owner"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select("*", *[F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)).alias(k) for k in KINDS])
    d = d.withColumn("value", F.when(F.size("assign") > 0, F.regexp_extract_all(
        "text", F.lit(PATTERNS["assign"]), F.lit(1))).otherwise(F.col("assign")))
    spans = [_spans(F.col("text"), k, F.col(k), F.col("value" if k == "assign" else k)) for k in KINDS]
    return d.select("repo", "owner", store.text_key(F.col("text")).alias("key"), F.array_sort(F.concat(*spans)).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos: how many owners and (owner, repository) pairs hold each candidate value."""
    one = found.select("repo", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    by_owner = one.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("x")).groupBy("hash", "owner").agg(
        F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def witnesses(found: DataFrame) -> DataFrame:
    """hash, n_texts, n_own: different texts that hold a value, and owners with a text each of their own.

    n_own is the least of three covers of the (owner, text) pairs: all owners, all texts, or
    one owner and the texts that others hold too.  For three owners that is exact."""
    one = found.select("owner", F.col("key.a").alias("a"), F.col("key.b").alias("b"),
                       F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    pairs = one.groupBy("hash", "a", "b", "owner").agg(F.lit(1).alias("x"))
    texts = pairs.groupBy("hash", "a", "b").agg(F.count("*").alias("held_by"), F.min("owner").alias("owner"))
    shared = F.col("held_by") > 1
    alone = texts.groupBy("hash", shared.alias("shared"), F.when(~shared, F.col("owner")).alias("owner")).agg(F.count("*").alias("n"))
    by_text = alone.groupBy("hash").agg(F.sum("n").alias("n_texts"), F.max(F.when(~F.col("shared"), F.col("n"))).alias("most"))
    owners = pairs.groupBy("hash", "owner").agg(F.lit(1).alias("x")).groupBy("hash").agg(F.count("*").alias("n_o"))
    return by_text.join(owners, "hash").select("hash", "n_texts", F.least(
        "n_o", "n_texts", F.col("n_texts") + 1 - F.coalesce("most", F.lit(0))).alias("n_own"))


def judged(found: DataFrame, min_owners: int = 3, min_repos: int = MIN_REPOS) -> DataFrame:
    """hash, n_owners, n_repos, n_texts, n_own, copied."""
    copied = (F.col("n_own") >= min_owners) | (F.least("n_repos", "n_texts") >= min_repos)
    return store.save_small(ownership(found).join(witnesses(found), "hash").withColumn("copied", copied), "secrets-owners")


def verdict():
    return F.when(F.col("copied"), "copied").when(F.col("held"), "live")


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source", text: str = "text",
         min_owners: int = 3, min_repos: int = MIN_REPOS) -> DataFrame:
    """One row per document: repo, owner, key (128 bits of the text), base, spans (base and verdict spans, sorted), n_live, n_copied,
    n_owners, n_repos (of each base span's value, in order)."""
    found = store.save(extract(docs, repo, owner, text).withColumn("rid", F.monotonically_increasing_id()), "secrets")
    values = found.select("rid", F.explode("spans").alias("s")).select("rid", "s.start", "s.rank", "s.vstart", "s.end", "s.hash", "s.held")
    kind = verdict()
    added = F.struct(F.col("vstart").alias("start"), F.when(kind == "live", 3).otherwise(4).alias("rank"), kind.alias("kind"), "end", "vstart", "hash", "held")
    counts = F.array_sort(F.collect_list(F.struct("start", "rank", "n_owners", "n_repos")))
    per = values.join(judged(found, min_owners, min_repos), "hash").groupBy("rid").agg(
        F.collect_set(F.when(kind.isNotNull(), added)).cast(SPAN).alias("added"), counts.alias("counts"))
    out = found.join(per, "rid", "left").withColumn("added", F.coalesce("added", F.array().cast(SPAN)))
    return out.select("repo", "owner", "key", F.col("spans").alias("base"),
                      F.array_sort(F.concat("spans", "added")).alias("spans"),
                      *[_count("added", k) for k in ("live", "copied")],
                      *[F.coalesce(F.col(f"counts.{n}"), F.array().cast("array<long>")).alias(n) for n in ("n_owners", "n_repos")])


def verdicts(docs: DataFrame, min_owners: int = 3, min_repos: int = MIN_REPOS) -> DataFrame:
    """One row per base span of each document: repo, owner, key, kind, start, end (of the value), hash, n_owners, n_repos, n_texts, n_own,
    verdict (copied, live or null)."""
    found = store.save(extract(docs), "secrets")
    values = found.select("repo", "owner", "key", F.explode("spans").alias("s")).select(
        "repo", "owner", "key", "s.kind", F.col("s.vstart").alias("start"), "s.end", "s.hash", "s.held")
    return values.join(judged(found, min_owners, min_repos), "hash").withColumn("verdict", verdict()).drop("held", "copied")


def without_live(docs: DataFrame, min_owners: int = 3) -> DataFrame:
    """docs (columns doc_id, source, text and any others) without those that hold a live credential."""
    d, a, b, x, y = store.fresh(docs, "d", "a", "b", "x", "y")
    live = store.save(verdicts(docs, min_owners).where("verdict = 'live'").select(
        F.col("repo").alias(d), F.col("key.a").alias(a), F.col("key.b").alias(b)).distinct(), "secrets-live")
    text = F.coalesce("text", F.lit(""))
    some = text.rlike(PATTERNS["assign"]) | text.rlike(PATTERNS["access"]) | text.rlike(PATTERNS["hex"])
    key = store.text_key(text)
    keyed = docs.where(some).withColumns({x: key["a"], y: key["b"]})      # only texts with a match are shuffled
    same = (F.col(x) == F.col(a)) & (F.col(y) == F.col(b)) & F.col("doc_id").eqNullSafe(F.col(d))
    return keyed.join(live.hint("merge"), same, "left_anti").select(*docs.columns).unionByName(docs.where(~some))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(store.table(spark, sf_dir, "documents"))
    return out.select(F.col("repo").alias("doc_id"), *[_count("base", k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                      _joined(F.col("spans")).alias("spans"), "n_live", "n_copied",
                      *[F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n) for n in ("n_owners", "n_repos")])


_ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
           "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")


def _sql_kind(kind: str, pattern: str, group: int) -> str:
    rank = KINDS.index(kind)
    return f"""
  SELECT rid, doc_id, source, {rank} AS rank, '{kind}' AS kind, val,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, length(hits[i]) AS n
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i, unnest(vals) AS val FROM (
    SELECT rid, doc_id, source, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals,
           string_split_regex(text, '{pattern}') AS gaps FROM d WHERE regexp_matches(text, '{pattern}')))
  WHERE length(val) >= {LEAST[kind]}"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS ({_sql_kind('assign', _ASSIGN, 2)} UNION ALL {_sql_kind('access', PATTERNS['access'], 0)}
  UNION ALL {_sql_kind('hex', PATTERNS['hex'], 0)}),
pairs AS (SELECT DISTINCT val, coalesce(d.source, chr(0)) AS owner, text FROM base JOIN d USING (rid)),
repos AS (SELECT val, count(*) AS n_repos FROM (SELECT DISTINCT val, source, doc_id FROM base) GROUP BY val),
texts AS (SELECT val, text, count(*) AS held_by, min(owner) AS owner FROM pairs GROUP BY val, text),
most AS (SELECT val, max(n) AS most FROM (SELECT val, owner, count(*) AS n FROM texts WHERE held_by = 1 GROUP BY val, owner) GROUP BY val),
freq AS (SELECT val, n_owners, n_texts, n_repos, least(n_owners, n_texts, n_texts + 1 - coalesce(most, 0)) AS n_own
  FROM (SELECT val, count(DISTINCT owner) AS n_owners FROM pairs GROUP BY val) JOIN (SELECT val, count(*) AS n_texts FROM texts GROUP BY val) USING (val)
  JOIN repos USING (val) LEFT JOIN most USING (val)),
held AS (SELECT val, rank, list_sum(list_transform(list_distinct(string_split(val, '')), lambda c:
    (length(val) - length(replace(val, c, ''))) * log2(length(val) / (length(val) - length(replace(val, c, ''))))))
    >= (CASE rank WHEN 0 THEN 16 WHEN 1 THEN 24 ELSE 32 END) - 1e-6
    AND NOT regexp_matches(val, '{PLACEHOLDER_WORD}') AS held FROM (SELECT DISTINCT val, rank FROM base)),
judged AS (SELECT DISTINCT rid, s + n - length(b.val) AS s, s + n AS e, CASE WHEN n_own >= 3 OR least(n_repos, n_texts) >= {MIN_REPOS} THEN 'copied'
    WHEN held THEN 'live' END AS kind FROM base b JOIN freq f ON b.val = f.val JOIN held h ON h.val = b.val AND h.rank = b.rank),
owned AS (SELECT rid, string_agg(CAST(n_owners AS VARCHAR), ',' ORDER BY s, rank) AS n_owners, string_agg(CAST(n_repos AS VARCHAR), ',' ORDER BY s, rank) AS n_repos
  FROM base JOIN freq USING (val) GROUP BY rid),
allspans AS (SELECT rid, s, s + n AS e, rank, kind, true AS is_base FROM base UNION ALL
  SELECT rid, s, e, CASE kind WHEN 'live' THEN 3 ELSE 4 END, kind, false FROM judged WHERE kind IS NOT NULL),
per AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'live') AS n_live, count(*) FILTER (kind = 'copied') AS n_copied,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (is_base) AS b,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS a FROM allspans GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  coalesce(n_owners, '') AS n_owners, coalesce(n_repos, '') AS n_repos
FROM d LEFT JOIN per ON d.rid = per.rid LEFT JOIN owned ON d.rid = owned.rid
"""
