"""Hand-written fixtures for the semantic corner cases (nulls, NaN, zero
denominators, duplicates, midnight, edges)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.functions import geohash as G
from cellcast.functions.numeric import clip, nan_to_null
from cellcast.functions.timekeys import parse_time_tolerant
from cellcast.operators import aggregates as A
from cellcast.operators import asof, blend, grids, lags, profile
from cellcast.operators.calibration import pair_stats, shrunk_scale
from cellcast.operators.lookups import ReferenceLookups, attach_by_cell, mean_by
from cellcast.sources import files, stored


def test_nan_mean(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    assert df.agg(F.avg(nan_to_null(F.col("v")))).first()[0] == 2.0


def test_single_std_is_zero(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("b", 0.3)], "geohash string, demand double")
    out = dict(df.groupBy("geohash").agg(A.std_samp0("demand").alias("s")).collect())
    assert out["a"] == 0.0 and abs(out["b"] - np.std([0.1, 0.3], ddof=1)) < 1e-12


def test_null_key_forms_no_group(spark):
    df = spark.createDataFrame([(None, 1.0), ("Street", 2.0)], "RoadType string, demand double")
    rows = mean_by(df, ["RoadType"]).collect()
    assert [r["RoadType"] for r in rows] == ["Street"]


def test_zero_denominator_scale(spark):
    stats = spark.createDataFrame([("a", 2, 0.0, 0.5), ("b", 2, 0.0, 0.0)], "geohash string, n long, m_ref double, m_cal double")
    g = spark.createDataFrame([(0.0, 0.0)], "g_ref double, g_cal double")
    out = dict(shrunk_scale(stats, g, 0.0, 0.1, 10.0).collect())
    assert out["a"] == 10.0 and out["b"] is None


def test_bad_time_text(spark):
    df = spark.createDataFrame([(None,), ("x:y",), ("7",), ("2:15",), ("7.5:3",), ("NaN:3",), ("1e10:0",), ("Infinity:0",), ("5d:1f",), (" 6 :-",)], "timestamp string")
    got = [(r.hour, r.minute) for r in parse_time_tolerant(df).collect()]
    assert got == [(0, 0), (0, 0), (7, 0), (2, 15), (7, 3), (0, 3), (0, 0), (0, 0), (0, 0), (6, 0)]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(clip(F.col("v"), 0.0, 1.0)).collect()] == [None, 0.0, 1.0, None]


def test_number_text(spark):
    df = spark.createDataFrame([("0.5",), ("5d",), ("1f",), ("NaN",), ("Infinity",), ("x",), (None,), (" 2e1 ",), ("-.5",), ("0x1p3",)], "v string")
    assert [r[0] for r in df.select(files.coerce_numeric("v")).collect()] == [0.5, None, None, None, None, None, None, 20.0, -0.5, None]


def test_duplicate_policy(spark):
    df = spark.createDataFrame([(1, "a", 0, 0.2), (2, "a", 0, 0.4)], "row_id long, geohash string, t int, demand double")
    assert mean_by(df, ["geohash", "t"]).first()["mean"] == pytest.approx(0.3)
    assert mean_by(df, ["geohash", "t"], on_duplicate="last").first()["mean"] == 0.4


def test_midnight_wrap(spark):
    slots = spark.createDataFrame([("a", 1425, 0.7)], "geohash string, t int, v double")
    nowrap = lags.shifted_lookup(slots, {-15: "m15"}, wrap=False).collect()
    wrap = {(r.geohash, r.t): r.m15 for r in lags.shifted_lookup(slots, {-15: "m15"}, wrap=True).collect()}
    assert all(r.t != 0 for r in nowrap) and wrap[("a", 0)] == 0.7


def test_prefix_weights(spark):
    rows = [("abcde1", 0, 0, 1.0)] + [("abcde2", 0, 0, 0.0)] * 3
    df = spark.createDataFrame(rows, "geohash string, t int, hour int, demand double")
    lk = ReferenceLookups(df)
    assert lk.prefix(5, "m").first()["m"] == pytest.approx(0.25)
    assert lk.prefix(5, "m", weight="cell").first()["m"] == pytest.approx(0.5)


def test_asof_edges(spark):
    ser = spark.createDataFrame([("a", 60, 1.0), ("a", 120, 3.0)], "geohash string, t int, v double")
    keys = spark.createDataFrame([("a", 30), ("a", 60), ("a", 90), ("a", 150)], "geohash string, t int")
    b = asof.brackets(keys, ser)
    nul = {r.t: r.interp for r in asof.interpolate(b, "null").collect()}
    near = {r.t: r.interp for r in asof.interpolate(b, "nearest").collect()}
    assert nul == {30: None, 60: 1.0, 90: 2.0, 150: 3.0}
    assert near[30] == 1.0
    counts = {r.t: (r.n_prev, r.n_next) for r in b.collect()}
    assert counts == {30: (0, 2), 60: (1, 1), 90: (1, 1), 150: (2, 0)}


def test_bucket_edges(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in [0, 1, 2, 10]], "x double, y double")
    out = {r.bucket: r.n for r in A.equal_width_buckets(df, "x", "y", 10).collect()}
    assert out == {1: 2, 2: 1, 10: 1}  # 0 and 1 → bucket 1 (right-closed), 2 → 2


def test_pairs_without_fanout(spark):
    cal = spark.createDataFrame([("a", 0, 0.5), ("a", 0, 0.7), ("a", 15, None)], "geohash string, t int, demand double")
    ref = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.3), ("a", 0, None), ("a", 15, 0.2)],
                                "geohash string, t int, demand double")
    s = pair_stats(cal, ref).first()
    # pairs on t=0: 2 cal × 3 ref; on t=15: 1 × 1
    assert s.n_pairs == 7 and s.n_both == 4
    assert s.mean_diff == pytest.approx(np.mean([0.5 - 0.1, 0.5 - 0.3, 0.7 - 0.1, 0.7 - 0.3]))
    # reference side weighted by the cal rows it pairs with: (2·(0.1+0.3) + 1·0.2) / (2·2 + 1·1)
    assert s.m_ref == pytest.approx((2 * 0.4 + 1 * 0.2) / (2 * 2 + 1 * 1))


@pytest.mark.parametrize("n", [1, 2, 7, 50, 501])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    vals = np.round(rng.random(n), 3).tolist()
    df = spark.createDataFrame([("g", v) for v in vals] + [("h", 1.0)], "k string, v double")
    out = dict(A.exact_median(df, "v", ["k"]).collect())
    assert out["g"] == pytest.approx(float(np.median(vals))) and out["h"] == 1.0
    assert A.exact_median(df.where("k = 'g'"), "v").first()[0] == pytest.approx(float(np.median(vals)))


def test_geohash_roundtrip_and_neighbours(spark):
    df = spark.createDataFrame([("ezs42",), ("u4pruydqqvj",)], "geohash string")
    d = {r.geohash: (r.lat, r.lon) for r in G.decode(df).collect()}
    assert abs(d["ezs42"][0] - 42.605) < 0.01 and abs(d["ezs42"][1] + 5.603) < 0.01
    nb = G.neighbors(df).collect()
    by = {}
    for r in nb:
        by.setdefault(r.geohash, set()).add(r.neighbor)
    assert by["ezs42"] == {"ezs48", "ezs40", "ezefr", "ezs43", "ezefx", "ezs49", "ezefp", "ezs41"}
    # symmetry: each neighbour of ezs42 has ezs42 among its neighbours
    back = G.neighbors(spark.createDataFrame([(n,) for n in by["ezs42"]], "geohash string")).collect()
    assert all(any(r.geohash == n and r.neighbor == "ezs42" for r in back) for n in by["ezs42"])


def test_ordinal_is_consecutive(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(7)
    out = files.with_ordinal(df.select("k"), ["k"]).collect()
    assert sorted((r.k, r.pos) for r in out) == [(i, i) for i in range(1000)]


def test_read_observations_csv(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text("Index,geohash,day,timestamp,demand,RoadType,NumberofLanes,LargeVehicles,Landmarks,Temperature,Weather\n"
                 "1,qp0abc,48,0:15,0.5,Street,2,Allowed,Yes,20.5,Sunny\n"
                 "2,qp0abc,48,0:30,bad,,,,,,\n")
    df = files.read_observations(spark, str(p))
    rows = df.orderBy("Index").collect()
    assert rows[0].demand == 0.5 and rows[1].demand is None and rows[1].RoadType is None


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ordinal_of_many_wide_rows(spark, tmp_path, adaptive):
    """Every ordinal once, on both sides of a write, whatever the partitions and however many ties."""
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 3_000_000
        df = spark.range(n, numPartitions=24).select(
            F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id") % 1_000_003).alias("k"), "id",
            F.sha2(F.col("id").cast("string"), 256).alias("wide"))
        files.with_ordinal(df, ["k"]).write.parquet(str(tmp_path / "o"))
        r = spark.read.parquet(str(tmp_path / "o")).agg(
            F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum("pos").alias("s"),
            F.expr("bit_xor(xxhash64(pos))").alias("x")).first()
        want = spark.range(n).agg(F.expr("bit_xor(xxhash64(id))")).first()[0]
        assert (r.n, r.lo, r.hi, r.s, r.x) == (n, 0, n - 1, n * (n - 1) // 2, want)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_row_count_guard(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    assert files.ordinal_slice(df, "pos", 2, 5, expected_total=10).count() == 3
    with pytest.raises(Exception, match="unexpected row count"):
        files.ordinal_slice(df, "pos", 2, 5, expected_total=11).collect()


def test_median_with_a_hot_group(spark):
    """A third of all rows in one group; the raw rows are never shuffled by the group alone."""
    df = spark.range(90_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("k"), ((F.col("id") * 7919) % 10_007).cast("double").alias("v"))
    got = dict(A.exact_median(df, "v", ["k"]).collect())
    pdf = df.toPandas().groupby("k")["v"].median()
    assert got == pdf.to_dict()


def test_pearson_p_value(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(40)
    df = spark.createDataFrame([(float(a), float(a * 0.3 + b)) for a, b in zip(x, rng.standard_normal(40))] + [(None, 1.0)], "x double, y double")
    r = profile.pearson(df, "x", "y").first()
    # two-sided tail of Student's t by numeric integration
    a = np.linspace(np.arctan(abs(r.t_stat) / math.sqrt(38)), math.pi / 2, 200_001)
    c = math.gamma(19.5) / math.gamma(19) / math.sqrt(math.pi)
    assert r.n == 40 and abs(r.p_value - 2 * c * np.trapezoid(np.cos(a) ** 37, a)) < 1e-8
    assert profile.pearson(df.limit(2), "x", "y").first().p_value is None


def test_interval_join_meets_each_pair_once(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab") if i % 9 else None, rng.choice([None, rng.randrange(0, 400)]), float(i)) for i in range(300)]
    spans = [(rng.choice("ab") if i % 7 else None, i, rng.choice([None, rng.randrange(-50, 400)]), rng.randrange(-50, 450)) for i in range(60)]
    p = spark.createDataFrame(points, "geohash string, t int, v double")
    s = spark.createDataFrame(spans, "geohash string, id int, low int, high int")
    want = sorted((c, t, v, i) for c, t, v in points for d, i, lo, hi in spans if c is not None and c == d and t is not None and lo is not None and lo <= t <= hi)
    for width in (1, 60, 1000):
        got = asof.interval_join(p, s, width=width)
        assert sorted((r.geohash, r.t, r.v, r.id) for r in got.collect()) == want


def test_alignment_names_the_gaps(spark):
    mk = lambda rows: spark.createDataFrame(rows, "Index long, demand double")
    tables = {"a": mk([(1, 0.5), (2, 0.9), (4, None), (5, 0.1), (5, 0.2)]), "b": mk([(1, 0.5), (3, 0.4), (4, 0.3), (5, 0.4), (None, 0.7)])}
    wide = blend.aligned(tables)
    got = {r.Index: (r.demand, r.missing) for r in blend.aligned_blend(wide, {"a": 0.5, "b": 0.5}).collect()}
    assert got[1] == (0.5, "") and got[2] == (None, "b") and got[3] == (None, "a") and got[4] == (None, "") and got[None] == (None, "a")
    assert abs(got[5][0] - 0.3) < 1e-12 and got[5][1] == ""
    assert {r.table: (r.present, r.missing, r.repeated) for r in blend.alignment_report(wide, ["a", "b"]).collect()} == {"a": (4, 2, 1), "b": (5, 1, 0)}


@pytest.mark.parametrize("n", [5_000, 100_000])
def test_ordinal_buckets_follow_the_rows(spark, n):
    """As many buckets as the rows need, a third of them tied in the order column; ordinals agree with a plain sort."""
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise((F.col("id") * 7919) % 100_003).alias("k"), "id")
    sizes = [r["count"] for r in files._bucketed(df, ["k"], 1_000).groupBy("_b").count().collect()]
    assert sum(sizes) == n and len(sizes) >= n / 2_500 and max(sizes) <= 2_500
    got = files.with_ordinal(df, ["k"], rows_per_bucket=1_000).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(n)) and [r.k for r in got] == sorted(r.k for r in got)


def test_binary_search_of_bounds(spark):
    for size in (0, 1, 2, 3, 7, 8, 9):
        bounds = [10 * i for i in range(1, size + 1)]
        df = spark.range(-5, 100).select("id", F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>").alias("_bounds"))
        got = df.select("id", files._not_above("_bounds", F.col("id"), size).alias("n")).collect()
        assert all(r.n == sum(b <= r.id for b in bounds) for r in got)


def test_failed_rewrite_leaves_the_old_variant(spark, tmp_path):
    path = str(tmp_path / "variants")
    mk = lambda rows: spark.createDataFrame(rows, "variant string, Index long, demand double")
    read = lambda: sorted((r.variant, r.Index, r.demand) for r in files.read_variants(spark, path).collect())
    files.replace_variants(mk([("a", 1, 0.1), ("a", 2, 0.2), ("007", 1, 0.7)]), path)
    files.replace_variants(mk([("a", 1, 0.5)]), path)
    assert read() == [("007", 1, 0.7), ("a", 1, 0.5)]
    # one good variant, then a row that ends the job: what was written of it stays out of sight
    bad = mk([("007", i, 0.9) for i in range(50)]).withColumn("demand", F.when(F.col("Index") == 49, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("demand")))
    with pytest.raises(Exception, match="lost"):
        files.replace_variants(bad.repartition(5, "Index"), path)
    assert read() == [("007", 1, 0.7), ("a", 1, 0.5)]
    files.replace_variants(mk([("007", 3, 0.3), ("b", 1, 1.0)]), path)
    assert read() == [("007", 3, 0.3), ("a", 1, 0.5), ("b", 1, 1.0)]


def test_median_of_a_hot_group(spark):
    """A third of 3 million distinct values in one cell: brackets are narrowed until 1,000 values are left, in parts of 50,000 rows."""
    n = 3_000_000
    ids = np.arange(n)
    cell, v = np.where(ids % 3 == 0, -1, ids % 7), ((ids * 1_234_577) % 3_000_017) ** 2 / 7.0
    df = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 7).alias("cell"),
                                                (F.pow((F.col("id") * 1_234_577) % 3_000_017, 2) / 7.0).alias("v"))
    got = dict(A.exact_median(df, "v", ["cell"], accuracy=100, ordered_values=1_000, rows_per_part=50_000).collect())
    assert got == pytest.approx({int(c): float(np.median(v[cell == c])) for c in np.unique(cell)}, rel=1e-12) and len(got) == 8


def test_median_passes_end_on_any_values(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.choice([0.0, 1.0, 2.0], 400)] + [("b", float(x)) for x in rng.random(301)] + [("c", 1.0), ("c", 3.0), ("d", None), (None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = dict(A.exact_median(df, "v", ["k"], accuracy=2, ordered_values=2, cuts=4, rows_per_part=10).collect())
    want = {k: float(np.median([x for g, x in rows if g == k])) for k in "abc"}
    assert got == pytest.approx(want)
    whole = A.exact_median(df, "v", ordered_values=2, cuts=4).collect()
    assert whole[0][0] == pytest.approx(float(np.median([x for _, x in rows if x is not None])))
    assert A.exact_median(df.where("k = 'z'"), "v").first()[0] is None and A.exact_median(df.where("k = 'z'"), "v", ["k"]).count() == 0


def test_grids_score_every_value_of_a_slot(spark):
    rows = [("a", 0, 0, 0.2), ("a", 0, 0, 0.9), ("a", 0, 0, None), ("b", 15, 0, 0.4), ("c", 30, 0, None)]
    tgt = spark.createDataFrame(rows, "geohash string, t int, hour int, demand double")
    from cellcast.operators.lookups import Slots
    slots = Slots(tgt).table.select("geohash", "t", "n", "s", "ss", F.when(F.col("geohash") == "a", 0.5).otherwise(0.7).alias("base"))
    stats = spark.createDataFrame([("a", 2, 0.4, 0.6)], "geohash string, n long, m_ref double, m_cal double")
    g = spark.createDataFrame([(0.5, 0.6)], "g_ref double, g_cal double")
    x = grids.with_cell_vectors(slots, stats, g, {"scales": grids.cell_scales([(0.0, 5.0), (2.0, 1.1)]), "offsets": grids.cell_offsets([2.0])})
    p = F.concat(F.transform("scales", lambda s: F.col("base") * s), F.transform("offsets", lambda o: F.col("base") + o))
    got = {r.pos: r.rmse for r in grids.rmse_by_position(x, grids.clipped(p), 3).collect()}
    preds = {"a": [0.5 * 1.5, 0.5 * 1.1, 0.5 + (2 * 0.2 + 2 * 0.1) / 4], "b": [0.7 * 1.2, 0.7 * 1.1, 0.7 + 0.1]}
    for i in range(3):
        errors = [(y - preds[c][i]) ** 2 for c, _, _, y in rows if y is not None]
        assert got[i] == pytest.approx(math.sqrt(sum(errors) / 3))


def test_stored_observations_prune_and_join_in_place(spark, tmp_path):
    """A cell with a third of the rows lies in many buckets; the plan prunes days and holds no exchange."""
    rows = [(i, "hot" if i % 3 == 0 else (f"c{i % 11}" if i % 13 else None), 48 + i % 2, (i * 15) % 1440 if i % 17 else None, float(i % 5) if i % 7 else None) for i in range(6_000)]
    obs = spark.createDataFrame(rows, "row_id long, geohash string, day int, t int, demand double")
    kept = stored.store_observations(obs, "observations_test", str(tmp_path / "obs"), buckets=16)
    assert kept.count() == len(rows) and stored.buckets_for(obs, rows_per_bucket=100) == 30
    hot = kept.where("geohash = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
    assert hot >= 16
    ref, tgt = kept.where("day = 48"), kept.where("day = 49 and t > 120")
    got = stored.colocated_mean(ref, tgt)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2 and "PartitionFilters: [isnotnull(day" in plan
    slots = {}
    for _, c, d, t, v in rows:
        if d == 48 and c is not None and t is not None and v is not None:
            slots.setdefault((c, t), []).append(v)
    want = {i: (float(np.mean(slots[c, t])) if (c, t) in slots else None) for i, c, d, t, _ in rows if d == 49 and t is not None and t > 120}
    assert {r.row_id: r.ref_exact for r in got.collect()} == pytest.approx(want)
    assert stored.stored_observations(spark, "observations_test").count() == len(rows)
    spark.sql("DROP TABLE observations_test")


def test_rows_meet_cells_through_slots(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 15), (3, "a", None), (4, None, 0), (5, "b", 0), (1, "a", 0)], "id long, geohash string, t int")
    cells = spark.createDataFrame([("a", 7.0), (None, 1.0), ("z", 2.0)], "geohash string, v double")
    got = sorted((r.id, r.v) for r in attach_by_cell(rows, cells).collect())
    assert got == [(1, 7.0), (1, 7.0), (2, 7.0), (3, 7.0), (4, None), (5, None)]
    assert sorted(r.id for r in attach_by_cell(rows, cells, how="inner", keys=rows.where("t is not null or id = 3")).collect()) == [1, 1, 2, 3]
    assert attach_by_cell(rows, cells).columns == ["geohash", "id", "t", "v"]


def test_approximate_options_stay_within_their_error(spark):
    n = 40_000
    df = spark.range(n).select(F.when(F.col("id") % 4 == 3, None).otherwise(F.col("id") % 2).alias("geohash"), ((F.col("id") * 7919) % n).cast("double").alias("demand"),
                               (F.col("id") % 96 * 15).cast("int").alias("t"), F.lit(0).alias("hour")).withColumn("geohash", F.col("geohash").cast("string"))
    rows = [(r.geohash, r.demand) for r in df.collect()]
    exact, close = ({r.geohash: r.geo_median for r in A.cell_stats(df, median_error=e).collect()} for e in (None, 0.01))
    for c in ("0", "1"):
        values = np.sort([v for g, v in rows if g == c])
        assert exact[c] == np.median(values) and abs(np.searchsorted(values, close[c]) / len(values) - 0.5) <= 0.011
    assert set(close) == {"0", "1"}
    got = A.distinct_counts(df, {"n": "demand"}, relative_error=0.02).first().n
    assert A.distinct_counts(df, {"n": "demand"}).first().n == n and abs(got / n - 1) < 0.1
