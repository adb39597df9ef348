"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Targets: the budget is shared by weight, no source gets more than ``cap`` times its size;
the excess goes to the others by weight (water-filling over the table of sources).

Copies: a document of a source with ratio r = target / size gets floor(r) copies and one
more with probability r - floor(r).  The fractions are rounded by the weighted pivotal
method: two documents trade mass (words) until one is integral; the choice of direction
keeps every probability as asked, and the source's expected words stay as they were up
to one document.  Documents are dealt by hash into groups of about ``fan`` units, each
group leaves one fractional unit, and these meet in the next level of a reduction tree,
so the depth is log_fan(n) and a hot source is only more groups.

Defined results: null text has size 0; a null source is a source of its own, last in
order; rows equal in (doc_id, source, size) form one unit with a multiplicity, so their
order cannot matter and a reread in other partitions gives the same mix; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcast.llm import store

QUERY = "op4_pivotal_mix"
ORACLE_SQL = None   # randomised rounding; tested against exact targets and a sequential version

WEIGHTS = (3, 1, 2)          # fixed values of the contract: by source in code-point order, repeating
SHARE = (3, 2)               # 150 % of all sizes, as a fraction
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 10_000               # repeated rows are expanded in chunks of so many


def unit_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, m: words of each text, and how many rows are equal."""
    d = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    return d.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))


def targets(units: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = 2) -> DataFrame:
    """source, source_size, target, units: one row per source.

    All sums are integers (multiplied by the share's denominator); the one division
    comes last.  The windows run over the table of sources only.
    """
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("units"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    num, den = share
    per = per.withColumn("w", weight.cast("long")).withColumn("full", F.col("source_size") * (cap * den))
    per = per.withColumn("ratio", F.col("full") / F.col("w"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    per = (per.withColumn("left", F.sum("source_size").over(whole) * num - F.coalesce(F.sum("full").over(before), F.lit(0)))
           .withColumn("ws", F.sum("w").over(after)).withColumn("pos", F.row_number().over(by_ratio)))
    per = per.withColumn("open", F.col("ratio") * F.col("ws") > F.col("left"))
    level = F.min(F.when(F.col("open"), F.struct("pos", "left", "ws"))).over(whole)
    per = per.withColumn("level", level)
    free = F.col("level").isNotNull() & (F.col("pos") >= F.col("level.pos"))
    return per.select("source", "source_size", "units", F.when(
        free, (F.col("w") * F.col("level.left")).cast("double") / (F.col("level.ws") * den).cast("double"))
        .otherwise((F.col("source_size") * cap).cast("double")).alias("target"))


UNIT = "struct<doc_id:{t},size:bigint,m:bigint,base:int,k:bigint,p:double>"


def _uniform(*cols):
    """A number in [0, 1) from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _trade(acc, x, seed: int, level: int, unit: str):
    """One pivotal step between the carried unit a and the next unit b."""
    a, b = acc["cur"], x
    u0, u1 = a["size"] * a["p"], a["size"] * (1 - a["p"])
    v0, v1 = b["size"] * b["p"], b["size"] * (1 - b["p"])
    up, down = F.least(u1, v0), F.least(u0, v1)
    rise = _uniform(F.lit(seed), F.lit(level), a["doc_id"], a["size"], b["doc_id"], b["size"], F.lit("trade")) * (up + down) < down
    a_done = F.when(rise, u1 <= v0).otherwise(u0 <= v1)
    a_bit = F.when(rise, 1).otherwise(0)             # if a is done
    b_bit = 1 - a_bit                                # if b is done

    def put(unit_col, p, bit):
        return F.struct(unit_col["doc_id"].alias("doc_id"), unit_col["size"].alias("size"), unit_col["m"].alias("m"),
                        unit_col["base"].alias("base"), (unit_col["k"] + bit).alias("k"), p.alias("p")).cast(unit)

    def near(p):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))

    zero = F.lit(0).cast("long")
    left_b = near(F.when(rise, v0 - u1).otherwise(v0 + u0) / b["size"])
    left_a = near(F.when(rise, u0 + v0).otherwise(u0 - v1) / a["size"])
    done = F.when(a_done, put(a, F.lit(0.0), a_bit)).otherwise(put(b, F.lit(0.0), b_bit))
    cur = F.when(a_done, put(b, left_b, zero)).otherwise(put(a, left_a, zero))
    first = a.isNull()
    return F.struct(F.when(first, x).otherwise(cur).alias("cur"),
                    F.when(first, acc["done"]).otherwise(F.concat(acc["done"], F.array(done))).alias("done"))


def _trader(seed: int, level: int, unit: str):
    return lambda acc, x: _trade(acc, x, seed, level, unit)


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = 2, seed: int = 11, fan: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    units = store.save(unit_sizes(docs), "mix-units")
    goal = targets(units, weights, share, cap)
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = units.alias("u").join(goal.alias("g"), F.col("u.source").eqNullSafe(F.col("g.source"))).select(
        "u.doc_id", "u.source", "u.size", "u.m", "source_size", "target", "units", r.alias("r"))
    rows = rows.withColumn("base", F.floor("r").cast("int"))
    mass = F.when(F.col("size") > 0, F.col("m") * (F.col("r") - F.col("base"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("mass", mass).withColumn("k", F.floor("mass").cast("long"))
    rows = store.save(rows.withColumn("p", F.col("mass") - F.col("k")), "mix-rows")
    unit = UNIT.format(t=dict(rows.dtypes)["doc_id"])
    cols = ["source", "source_size", "target"]
    fields = ["doc_id", "size", "m", "base", "k", "p"]
    decided = [rows.where(F.col("p") <= 0).select(*cols, F.struct(*fields).cast(unit).alias("u"))]
    most = rows.agg(F.max("units")).first()[0] or 0
    todo = rows.where(F.col("p") > 0).select(*cols, F.col("units").alias("n"), F.struct(*fields).cast(unit).alias("u"))
    for level in range(max(1, math.ceil(math.log(max(most, 2), fan)) + 1)):
        groups = F.ceil(F.col("n") / F.lit(fan))
        h = F.xxhash64(F.lit(seed), F.lit(level), "u.doc_id", "source", "u.size")
        dealt = todo.withColumn("groups", groups).withColumn("g", F.pmod(h, F.col("groups")))
        order = F.struct(F.xxhash64(F.lit(seed), F.lit("order"), F.lit(level), "u.doc_id", "u.size").alias("h"), "u")
        lists = dealt.groupBy(*cols, "groups", "g").agg(F.array_sort(F.collect_list(order)).alias("us"))
        start = F.struct(F.lit(None).cast(unit).alias("cur"), F.array().cast(f"array<{unit}>").alias("done"))
        folded = F.aggregate(F.transform("us", lambda o: o["u"]), start, _trader(seed, level, unit))
        out = store.save(lists.select(*cols, F.col("groups").alias("n"), folded.alias("f")), f"mix-level{level}")
        decided.append(out.select(*cols, F.explode("f.done").alias("u")))
        todo = out.select(*cols, "n", F.col("f.cur").alias("u"))
        if most <= fan:
            break
        most = math.ceil(most / fan)
    last = _uniform(F.lit(seed), F.lit("last"), "source", "u.doc_id", "u.size") < F.col("u.p")
    decided.append(todo.select(*cols, F.col("u").withField("k", F.col("u.k") + last.cast("long")).alias("u")))
    done = decided[0]
    for d in decided[1:]:
        done = done.unionByName(d)
    flat = done.select(*cols, "u.doc_id", "u.size", "u.m", "u.base", "u.k")
    few = flat.where(F.col("m") <= CHUNK).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    chunks = flat.where(F.col("m") > CHUNK).withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CHUNK)))).repartition("doc_id", "size", "c")
    many = chunks.withColumn("i", F.explode(F.sequence(F.col("c") * CHUNK + 1, F.least(F.col("m"), (F.col("c") + 1) * CHUNK)))).drop("c")
    copies = F.col("base").cast("long") + (F.col("i") <= F.col("k")).cast("long")
    return few.unionByName(many).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                                        (copies * F.col("size")).alias("taken"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(store.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
