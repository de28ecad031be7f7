"""Hand-computed goldens of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions.numeric import hist_index, share100
from weftline.operators import lift as L
from weftline.operators import post as P
from weftline.operators import prepare as R
from weftline.operators import synteny as S


def bins(spark, weights):
    return spark.createDataFrame([(i, "c", i * 10, i * 10 + 10, w) for i, w in enumerate(weights)], "bin_id int, chrom string, start long, end long, weight float")


def links(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line long, chrom_a string, start_a long, end_a long, chrom_b string, start_b long, end_b long")


def pieces(df):
    return [tuple(r)[2:] for r in df.orderBy("blk", "piece").collect()]


def test_mid_ranks(spark):
    values = spark.createDataFrame([(0, float(v)) for v in (1, 2, 2, 4)], "dist_bins int, val float")
    got = {r.val: (r.rank, r.strict, r["weak"]) for r in R.value_ranks(values).collect()}
    assert got == {1: (12, 0, 25), 2: (50, 25, 75), 4: (87, 75, 99)}


def test_weights(spark):
    got = [r.weight for r in R.clean_bins(bins(spark, [math.nan, 0.0, -1.0, math.inf, 2.0])).orderBy("bin_id").collect()]
    assert got == [1, 1, 1, 1, 2]
    two = bins(spark, [2.0, 1.0])
    values = R.pixel_values(two, spark.createDataFrame([(0, 1, 6.0)], "bin1_id int, bin2_id int, count float"), 10)
    assert values.first().val == 3


def test_missing_weight_column_and_bin_size(spark):
    plain = bins(spark, [1.0, 1.0, 1.0]).drop("weight")
    assert {r.weight for r in R.clean_bins(plain).collect()} == {1.0}
    assert R.bin_size(plain) == 10
    odd = spark.createDataFrame([(0, "c", 0, 10), (1, "c", 10, 25), (2, "c", 25, 35)], "bin_id int, chrom string, start long, end long")
    with pytest.raises(ValueError):
        R.bin_size(odd)


def test_coverage_counts_the_diagonal_twice(spark):
    values = spark.createDataFrame([(0, 0, 5.0), (0, 1, 2.0)], "bin1 int, bin2 int, count float")
    assert {r.bin_id: r["cov"] for r in R.coverage(values).collect()} == {0: 12, 1: 2}


def test_densify(spark):
    plus = pieces(S.densify(links(spark, ("A", 0, 700, "B", 1000, 1700))))
    assert [p[1:3] for p in plus] == [(0, 175), (175, 350), (350, 525), (525, 700)]
    assert [p[4:6] for p in plus] == [(1000, 1175), (1175, 1350), (1350, 1525), (1525, 1700)]
    minus = pieces(S.densify(links(spark, ("A", 0, 700, "B", 1000, 300))))
    assert [p[4:6] for p in minus] == [(825, 1000), (650, 825), (475, 650), (300, 475)] and {p[6] for p in minus} == {-1}
    assert pieces(S.densify(links(spark, ("A", 0, 300, "B", 1000, 300)))) == [("A", 0, 300, "B", 1000, 300, -1, "1")]
    assert [p[1:3] for p in pieces(S.densify(links(spark, ("A", 0, 500, "B", 0, 500))))] == [(0, 166), (166, 332), (332, 500)]


def test_gaps(spark):
    assert pieces(S.gaps(links(spark, ("A", 0, 100, "B", 0, 100), ("A", 150, 300, "B", 180, 330)))) == [("A", 100, 150, "B", 100, 180, 1, "2_gap")]
    assert pieces(S.gaps(links(spark, ("A", 0, 100, "B", 100, 0), ("A", 150, 300, "B", 180, 330)))) == [("A", 100, 150, "B", 180, 0, -1, "2_gap")]
    assert pieces(S.gaps(links(spark, ("A", 0, 100, "B", 0, 100), ("A", 100, 300, "B", 180, 330), ("A", 400, 500, "C", 0, 9)))) == []


def test_share_rounding(spark):
    n = [1, 2, 3, 6, 8, 40, 200, 201]
    got = spark.createDataFrame([(x,) for x in n], "n int").select(share100(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [100, 50, 33, 17, 12, 3, 1, 0]
    wide = spark.range(1, 1000).select("id", share100(F.col("id")).alias("s")).collect()
    assert all(r.s == round(round(1 / r.id, 2) * 100) for r in wide)


def test_sessions_and_frames(spark):
    pairs = spark.createDataFrame([(1, 0, 1, b, b) for b in (5, 6, 9, 13)], "na int, ba int, nb int, bb int, first_line long")
    got = {r.bb: r.j for r in L.remap_groups(pairs, 3).collect()}
    assert got == {5: 0, 6: 0, 9: 0, 13: 1}
    assert [L.frame_bins(x, 40_000) for x in (400_000, 10_000, 100_000)] == [10, 1, 2]


def test_choose_best(spark):
    rows = [(1, 0, 1, 0, 0, j, 0.0, 0, 0, float(c)) for j, c in enumerate((2, 1, 1, 3))]
    cands = spark.createDataFrame(rows, "n1 int, b1 int, n2 int, b2 int, j1 int, j2 int, ctrl_cov2 double, ctrl_weak int, dev_ctrl int, coverage double")
    assert L.choose_best(cands, "default").first().j2 == 2
    assert L.choose_best(cands, "none").first().j2 == 0
    with pytest.raises(ValueError):
        L.choose_best(cands, "other")


def lifted(spark, *rows):
    cols = "chr1_observed string, pos1_observed long, chr2_observed string, pos2_observed long, remap1_control string, remap2_control string, observed_contacts int, control_contacts int, observed_deviations int, control_deviations int, control_contact_distances double, n int"
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], cols)
    return df.withColumn("line", F.struct(F.col("n").alias("n1"), F.lit(0).alias("n2"), F.lit(0).alias("b1")))


def fai(spark, *names):
    return spark.createDataFrame([(c, i + 1, 95_000) for i, c in enumerate(names)], "chrom string, ord int, size long")


def test_dedup_order_and_ties(spark):
    rows = lifted(spark, ("b", 0, "a", 40_000, "x", "y", 1, 2, 3, 4, 5.0), ("a", 40_000, "b", 0, "x", "y", 6, 7, 8, 9, 5.0), ("a", 40_000, "b", 0, "x", "y", 0, 0, 0, 0, 9.0))
    got = P.dedup(rows, fai(spark, "b", "a"), 40_000).collect()
    assert [(r.chrom1, r.b1, r.chrom2, r.b2, r.obs) for r in got] == [("b", 0, "a", 1, 6)]


def contacts(spark, rows):
    return spark.createDataFrame([(c, a, c, b, float(o), float(k), 0.0, 0.0, 0.0) for c, a, b, o, k in rows], "chrom1 string, b1 long, chrom2 string, b2 long, obs double, ctrl double, dev_obs double, dev_ctrl double, l double")


def test_metric_terms_and_thresholds(spark):
    five = contacts(spark, [("c", 0, b, 90, 10) for b in range(5)])
    got = {r.start: r.value for r in P.metric(five, 1, frame=2).collect()}
    assert list(got) == [2]
    six = contacts(spark, [("c", 0, 0, 90, 10), ("c", 0, 1, 90, 10), ("c", 0, 2, 90, 10), ("c", 1, 1, 90, 10), ("c", 1, 2, 90, 10)])
    got = {r.start: r.value for r in P.metric(six, 1, frame=2).collect()}
    assert got[1] == pytest.approx(1.118352, abs=1e-6)
    four = contacts(spark, [("c", 0, 0, 90, 10), ("c", 0, 1, 90, 10), ("c", 0, 2, 90, 10), ("c", 1, 1, 90, 10)])
    assert P.metric(four, 1, frame=2).count() == 0
    flat = contacts(spark, [("c", a, b, 50, 50) for a in range(3) for b in range(a, 3)])
    assert all(math.isnan(r.value) for r in P.metric(flat, 1, frame=2, name="pearsone").collect())


def test_stripe(spark):
    rows = contacts(spark, [("c", j, 9, 10, 10) for j in (1, 3, 5, 7)])
    assert [r.start for r in P.metric(rows, 1, frame=8, name="stripe").collect()] == [9]
    assert P.metric(contacts(spark, [("c", j, 9, 10, 10) for j in (1, 3, 5)]), 1, frame=8, name="stripe").count() == 0


def test_tokens(spark):
    tokens = ["c:10", "c:10-c:31", "c:1-d:5", "-"]
    chrom, pos = P.parse_token(F.col("t"))
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(chrom.alias("c"), pos.alias("p")).collect()
    assert [tuple(r) for r in got] == [("c", 10), ("c", 20), (None, None), (None, None)]


def test_histogram_edges(spark):
    at = lambda v, lo, hi: spark.range(1).select(hist_index(F.lit(float(v)), lo, hi, 100).alias("k")).first().k
    assert at(100, 0, 100) == 99 and at(13, -12, 12) is None and at(5, 0, 5) == 99 and at(0, 0, 5) == 0
    import numpy as np

    values = [k * 0.04 for k in range(126)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", hist_index(F.col("v"), 0, 5, 100).alias("k")).collect()
    edges = np.histogram_bin_edges([], bins=100, range=(0, 5))
    assert all(r.k == min(99, int(np.searchsorted(edges, r.v, side="right")) - 1) for r in rows)


def test_cool_bins_drop_tails(spark):
    assert [(r.start, r.end) for r in P.genome_bins(fai(spark, "c"), 40_000).orderBy("bin_id").collect()] == [(0, 40_000), (40_000, 80_000)]
    kept = P.genome_pixels(contacts(spark, [("c", 0, 1, 1, 2), ("c", 0, 2, 1, 2)]), fai(spark, "c"), 40_000)
    assert [tuple(r) for r in kept.collect()] == [(0, 1, 1.0)]


def test_region_matrix(spark):
    m = P.region_matrix(contacts(spark, [("c", 0, 1, 3, 2), ("c", 1, 2, 9, 9)]), ("c", 0, 100_000), ("c", 0, 100_000), 40_000, "diff")
    assert {(r.iy, r.ix): r.v for r in m.collect()} == {(0, 1): 1, (1, 0): 1}


def test_parameters():
    assert P.parse_region("c:1,000-2,000", {}) == ("c", 1000, 2000) and P.parse_region("c", {"c": 5}) == ("c", 0, 5)
    assert P.parse_heat("obs-diff") == ("obs", "diff") and P.parse_heat("CTRL") == ("ctrl", "ctrl")
    assert P.parse_borders("a.bed:x:red,b.bed") == [("a.bed", "x", "red"), ("b.bed", None, None)]
    for bad in ("c:5-5", "c:9-1"):
        with pytest.raises(ValueError):
            P.parse_region(bad, {})
    with pytest.raises(ValueError):
        P.parse_heat("other")


def test_rough_lift(spark):
    mark = spark.createDataFrame([("A", 0, 400, "B", 1000, 1400)], "chrom_a string, start_a long, end_a long, chrom_b string, start_b long, end_b long")
    bed = spark.createDataFrame([("A", 0, 250, "n"), ("chrA", 300, 320, "m"), ("Z", 0, 9, "z")], "chrom string, start long, end long, name string")
    got = S.rough_lift(bed, mark, fai(spark, "A"), fai(spark, "B")).collect()
    assert sorted(tuple(r) for r in got) == [("B", 1200, 1399, "m"), ("B", 1200, 1399, "n")]


def test_paf(spark):
    paf = spark.createDataFrame([(0, "q", 1, 2, "-", "t", 10, 90, 50), (1, "q", 1, 2, "+", "t", 10, 90, 5)], "line long, qname string, qstart long, qend long, strand string, tname string, tstart long, tend long, nmatch long")
    assert [tuple(r) for r in S.paf_to_link(paf, 10).collect()] == [(0, "q", 1, 2, "t", 90, 10)]


def test_shuffle_keeps_the_values(spark):
    rows = contacts(spark, [("c", a, b, a, b) for a in range(20) for b in range(a, 20)])
    one, again, other = (P.shuffled_contacts(rows, s) for s in ("1", "1", "2"))
    values = lambda df, c="ctrl": [r[c] for r in df.orderBy("b1", "b2").collect()]
    assert sorted(values(one)) == sorted(values(rows)) and values(one) == values(again) != values(other) and values(one, "obs") == values(rows, "obs")
