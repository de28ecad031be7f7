"""Bins and pixels to contacts with distance-stratified percentile ranks, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import percent, valid_weight
from ..storage import TIGHT, release, written

MAX_DISTANCE = 10_000_000
#: Bins of a genome are broadcast up to this many rows; beyond it the joins shuffle.
BROADCAST_BINS = 5_000_000


def clean_bins(bins: DataFrame) -> DataFrame:
    """bins with every weight valid; a missing weight column counts as ones."""
    weight = F.col("weight") if "weight" in bins.columns else F.lit(None).cast("float")
    return bins.select("bin_id", "chrom", "start", "end", valid_weight(weight).alias("weight"))


def bin_size(bins: DataFrame) -> int:
    """The one width of all bins but the last of each chromosome; fails if there are several."""
    last = W.partitionBy("chrom")
    inner = bins.withColumn("last", F.max("start").over(last)).where("start < last").select((F.col("end") - F.col("start")).alias("w")).distinct()
    found = sorted(r.w for r in inner.limit(2).collect())
    if not found:
        found = [bins.agg(F.max(F.col("end") - F.col("start"))).first()[0]]
    if len(found) > 1 or found[0] is None:
        raise ValueError("bins must have one fixed size")
    return found[0]


def _small(bins: DataFrame) -> DataFrame:
    return F.broadcast(bins) if bins.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS else bins


def pixel_values(bins: DataFrame, pixels: DataFrame, resolution: int, *, max_distance: int = MAX_DISTANCE, inter: bool = False) -> DataFrame:
    """Kept pixels with both bins' coordinates, val (count divided by both weights) and dist_bins (-1 between chromosomes)."""
    side = lambda k: _small(clean_bins(bins).select(*(F.col(c).alias(f"{c}{k}") for c in ("chrom", "start", "end", "weight")), F.col("bin_id").alias(f"bin{k}")))
    rows = pixels.select(F.col("bin1_id").alias("bin1"), F.col("bin2_id").alias("bin2"), F.col("count").cast("float").alias("count"))
    rows = rows.join(side(1), "bin1").join(side(2), "bin2")
    intra, step = F.col("chrom1") == F.col("chrom2"), F.col("start2") - F.col("start1")
    keep = intra & (step >= 0) & (step <= max_distance)
    rows = rows.where(keep | ~intra if inter else keep)
    both = valid_weight((F.col("weight1") * F.col("weight2")).cast("float"))
    return rows.withColumn("val", (F.col("count") / both).cast("float")).withColumn("dist_bins", F.when(intra, F.expr(f"(start2 - start1) div {resolution}")).otherwise(-1).cast("int"))


def coverage(values: DataFrame) -> DataFrame:
    """bin_id, cov: raw counts of kept pixels over both ends; a diagonal pixel counts twice."""
    ends = values.select(F.explode(F.array("bin1", "bin2")).alias("bin_id"), F.col("count").cast("double").alias("count"))
    return ends.groupBy("bin_id").agg(F.sum("count").cast("float").alias("cov"))


def _cumulated(values: DataFrame) -> DataFrame:
    """dist_bins, val, c, left, right, n: each distinct value's count, those before and up to it, and those of its distance.

    Equal values are counted first. Distances are cut into ranges of values, a thousand to a doubling, and windows run
    inside a range; only the ranges' counts, a row each, are summed over a distance. So a distance that holds most pixels
    (that between chromosomes), each with a value of its own, is many tasks' work.
    """
    part = F.when(F.col("val") > 0, F.floor(F.log2(F.col("val").cast("double")) * 1024)).otherwise(F.lit(-(1 << 40)).cast("long"))
    counts = values.groupBy("dist_bins", "val").agg(F.count("*").alias("c")).withColumn("part", part)
    parts = counts.groupBy("dist_bins", "part").agg(F.sum("c").alias("in_part"))
    upto = F.sum("in_part").over(W.partitionBy("dist_bins").orderBy("part")) - F.col("in_part")
    parts = parts.select("dist_bins", "part", upto.alias("before"), F.sum("in_part").over(W.partitionBy("dist_bins")).alias("n"))
    inside = counts.withColumn("right", F.sum("c").over(W.partitionBy("dist_bins", "part").orderBy("val")))
    rows = inside.join(parts, ["dist_bins", "part"]).withColumn("right", F.col("right") + F.col("before"))
    return rows.select("dist_bins", "val", "c", (F.col("right") - F.col("c")).alias("left"), "right", "n")


def value_ranks(values: DataFrame) -> DataFrame:
    """dist_bins, val, rank, strict, weak: percentiles of each distinct value in its distance."""
    n = F.col("n")
    return _cumulated(values).select("dist_bins", "val", percent((F.col("left") + F.col("right")) * 0.5 / n).alias("rank"), percent(F.col("left") / n).alias("strict"), percent(F.col("right") / n).alias("weak"))


def written_values(bins: DataFrame, pixels: DataFrame, resolution: int, **options) -> DataFrame:
    """bin1, bin2, count, val, dist_bins of pixel_values() as a table, so that pixels meet their bins once for three passes."""
    values = pixel_values(bins, pixels, resolution, **options).select("bin1", "bin2", "count", "val", "dist_bins")
    out = written(values, "values", **TIGHT)
    release(out.sparkSession)
    return out


def contacts(bins: DataFrame, pixels: DataFrame, resolution: int, **options) -> DataFrame:
    """The 14-column contacts of a map."""
    return ranked(bins, written_values(bins, pixels, resolution, **options))


def ranked(bins: DataFrame, values: DataFrame) -> DataFrame:
    """contacts() of written_values(). Ranks, and bins with their coverages, are written once, and broadcast where their counts
    allow, the bins once for both ends; where ranks are too many for that, no value is that of very many pixels."""
    cov = written(clean_bins(bins).drop("weight").join(coverage(values), "bin_id"), "coverage")
    ranks = written(value_ranks(values), "ranks")
    release(values.sparkSession)
    made, cov = (cov, ranks), _small(cov)
    side = lambda k: cov.select(*(F.col(c).alias(f"{c}{k}") for c in ("chrom", "start", "end", "cov")), F.col("bin_id").alias(f"bin{k}"))
    rows = values.join(_small(ranks), ["dist_bins", "val"]).join(side(1), "bin1").join(side(2), "bin2")
    out = rows.select("chrom1", "start1", "end1", "bin1", "chrom2", "start2", "end2", "bin2", "rank", "strict", "weak", "cov1", "cov2", "dist_bins")
    out._reads = made  # tables that can go once the result has been written
    return out


#: Quantiles of a distance: three of all values, then the medians of 100 equal slices.
POINTS = (0.05, 0.5, 0.95, *((2 * i + 1) / 200 for i in range(100)))


def distance_stats(values: DataFrame) -> DataFrame:
    """dist_bins, n, p05, p50, p95, and the 100 medians of equal slices.

    A quantile lies between two neighbours in the order of values, which are looked up by their counts: each distinct value
    names the few points whose neighbours it is, so no task holds a distance.
    """
    rows = _cumulated(values)
    last = F.col("n") - 1
    # slices whose median may lie at this value, one more on either side for rounding
    first = F.greatest(F.lit(0), F.floor(F.col("left") / F.col("n") * 100 - 2).cast("int"))
    upto = F.least(F.lit(99), F.ceil(F.col("right") / F.col("n") * 100 + 1).cast("int"))
    place = lambda p: last * F.element_at(F.array(*map(F.lit, POINTS)), p + 1)
    holds = lambda at: (at >= F.col("left")) & (at < F.col("right"))
    near = lambda p: holds(F.floor(place(p))) | holds(F.ceil(place(p)))
    points = F.filter(F.concat(F.array(F.lit(0), F.lit(1), F.lit(2)), F.transform(F.sequence(first, upto), lambda i: i + 3)), near)
    found = rows.where(F.size(points) > 0).select("dist_bins", "n", "left", "right", F.col("val").cast("double").alias("val"), F.explode(points).alias("p"))
    low, high = F.floor(place(F.col("p"))), F.ceil(place(F.col("p")))
    ends = found.groupBy("dist_bins", "n", "p").agg(F.max(F.when(holds(low), F.col("val"))).alias("lo"), F.max(F.when(holds(high), F.col("val"))).alias("hi"))
    between = F.when(low == high, F.col("lo")).otherwise((high - place(F.col("p"))) * F.col("lo") + (place(F.col("p")) - low) * F.col("hi"))
    got = ends.select("dist_bins", "n", F.struct("p", between.alias("q")).alias("s")).groupBy("dist_bins", "n").agg(F.array_sort(F.collect_list("s"))["q"].alias("q"))  # 103 each
    return got.select("dist_bins", "n", F.get("q", F.lit(0)).alias("p05"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p95"), F.slice("q", 4, 100).alias("medians"))


def wide_stats(stats: DataFrame) -> DataFrame:
    """The stats file's layout: 105 fields a row."""
    return stats.select("dist_bins", "n", "p05", "p50", "p95", *(F.get("medians", F.lit(i)).alias(f"m{i}") for i in range(100))).orderBy(F.col("dist_bins") == -1, "dist_bins")
