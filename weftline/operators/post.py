"""Metrics, histograms, matrices and exports of lifted contacts.

Deduplicated contacts have the columns chrom1, b1, chrom2, b2 (canonical by the index), obs, ctrl, dev_obs, dev_ctrl, l.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import hist_index, safe_log2
from ..functions.ranks import numbered
from ..storage import TIGHT, forget, release, written

DEFAULT_RESOLUTION, LEAST_RESOLUTION, LEAST_STEP = 40_000, 10_000, 1_000


#: The keys by which controls are shuffled: what a lifted contact observes, whatever file it is in.
LOCUS = ["chr1_observed", "pos1_observed", "chr2_observed", "pos2_observed"]


def _indexed(rows: DataFrame, fai: DataFrame) -> DataFrame:
    index = lambda k: F.broadcast(fai.select(F.col("chrom").alias(f"chr{k}_observed"), F.col("ord").alias(f"o{k}")))
    return rows.join(index(1), "chr1_observed").join(index(2), "chr2_observed")


#: The columns of lifted contacts that dedup() takes, and those of distance_map().
DEDUP = (*LOCUS, "observed_contacts", "control_contacts", "observed_deviations", "control_deviations", "control_contact_distances", "line")
DISTANCE = (*LOCUS, "remap1_control", "remap2_control", "control_contact_distances")


def dedup(lift: DataFrame, fai: DataFrame, resolution: int) -> DataFrame:
    """One row per canonical pair of bins: the least second-to-last column, of equals the last line."""
    rows = _indexed(lift, fai)
    at = lambda k: F.floor(F.col(f"pos{k}_observed") / resolution)
    one, two = (F.struct(F.col(f"o{k}").alias("o"), at(k).alias("b"), F.col(f"chr{k}_observed").alias("c")) for k in (1, 2))
    rows = rows.withColumn("lo", F.least(one, two)).withColumn("hi", F.greatest(one, two))
    rows = rows.select(F.col("lo.c").alias("chrom1"), F.col("lo.b").alias("b1"), F.col("hi.c").alias("chrom2"), F.col("hi.b").alias("b2"), *(F.col(a).cast("double").alias(b) for a, b in (("observed_contacts", "obs"), ("control_contacts", "ctrl"), ("observed_deviations", "dev_obs"), ("control_deviations", "dev_ctrl"), ("control_contact_distances", "l"))), "line")
    best = W.partitionBy("chrom1", "b1", "chrom2", "b2").orderBy("l", F.desc("line"))
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "line")


def short_rows(lift: DataFrame, fai: DataFrame, resolution: int) -> DataFrame:
    """obs, ctrl, lr, l of every row: lr is the distance in bins, -1000 between chromosomes."""
    rows = _indexed(lift, fai)
    lr = F.abs(F.floor(F.col("pos2_observed") / resolution) - F.floor(F.col("pos1_observed") / resolution))
    return rows.select(*LOCUS, F.col("observed_contacts").cast("double").alias("obs"), F.col("control_contacts").cast("double").alias("ctrl"), F.when(F.col("o1") == F.col("o2"), lr).otherwise(-1000).cast("long").alias("lr"), F.col("control_contact_distances").cast("double").alias("l"))


def infer_resolution(lift: DataFrame) -> DataFrame:
    """resolution: the greatest common divisor of position steps and of two-bin label widths.

    Steps between consecutive positions of a chromosome have the divisor of the distances from its least position, so
    the order of rows doesn't matter. The divisor is found by rounds of Euclid's rule over all rows at once: the least
    value, then the least remainder by it that is left, until none is; each round sends one number to the driver. Of
    label widths that are equally frequent the least counts.
    """
    ends = lift.select(F.explode(F.array(*(F.struct(F.col(f"chr{k}_observed").alias("c"), F.col(f"pos{k}_observed").alias("p")) for k in (1, 2)))).alias("e")).select("e.*").distinct()
    least = ends.groupBy("c").agg(F.min("p").alias("p0"))
    steps = ends.join(F.broadcast(least), "c").select((F.col("p") - F.col("p0")).alias("v"))  # a row for each chromosome
    label = lift.select(F.explode(F.array("remap1_control", "remap2_control")).alias("t")).where("instr(t, ':') > 0 and instr(t, '-') > 0")
    place = lambda i: F.get(F.split(F.get(F.split("t", "-"), F.lit(i)), ":"), F.lit(1)).try_cast("long")
    widths = written(label.select(F.abs(place(1) - place(0)).alias("v")).where("v > 0").groupBy("v").agg(F.count("*").alias("c")), "widths")
    values = written(steps.where("v > 0").union(widths.select("v")).distinct(), "steps")
    g = values.agg(F.min("v")).first()[0]
    while g and (rest := values.agg(F.min(F.when(F.col("v") % g != 0, F.col("v") % g))).first()[0]):
        g = math.gcd(g, rest)
    common = widths.agg(F.max_by("v", F.struct("c", -F.col("v"))).alias("w")).first().w
    forget(widths, values)
    chosen = common if g and g < LEAST_STEP and common is not None else g
    found = DEFAULT_RESOLUTION if g is None else max(LEAST_RESOLUTION, chosen) if chosen < LEAST_STEP else chosen
    return lift.sparkSession.createDataFrame([(found,)], "resolution long")


# ---- windowed metrics


@dataclass(frozen=True)
class Metric:
    """How the values of a window become one: an aggregate, its threshold for a frame, and the window's shape."""

    value: Callable[[], Column]
    threshold: Callable[[int], float]
    stripe: bool = False


def _log_ratio() -> Column:
    least = F.lit(1e-6)
    return F.avg(F.log10(F.greatest("obs", least) / F.greatest("ctrl", least)))


def _pbad() -> Column:
    far = lambda p: F.least(F.greatest(1.0 - F.abs(F.col(p) - 50) / 50.0, F.lit(0.01)), F.lit(0.99))
    return F.avg(-(F.abs(F.col("obs") - F.col("ctrl")) / 100.0) * F.log10(far("obs") * far("ctrl")))


def _correlation(x: str, y: str) -> Column:
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(float("nan")))


METRICS = {
    "pbad": Metric(_pbad, lambda f: f**2),
    "log": Metric(_log_ratio, lambda f: f**2),
    "stripe": Metric(_log_ratio, lambda f: 0.4 * f, stripe=True),
    "pearsone": Metric(lambda: _correlation("obs", "ctrl"), lambda f: f**2),
    "spearman": Metric(lambda: _correlation("x", "y"), lambda f: f**2),
}


def anchors(contacts: DataFrame) -> DataFrame:
    """Distinct (chrom, bin) of both ends of all contacts."""
    return contacts.select(F.explode(F.array(*(F.struct(F.col(f"chrom{k}").alias("chrom"), F.col(f"b{k}").alias("bin")) for k in (1, 2)))).alias("e")).select("e.*").distinct()


def windows(contacts: DataFrame, frame: int, max_dist: int) -> DataFrame:
    """Each intra contact under every anchor whose window holds both its bins, near contacts only."""
    near = contacts.where((F.col("chrom1") == F.col("chrom2")) & (F.col("b2") - F.col("b1") <= min(max_dist, 2 * frame)))
    return near.select(F.col("chrom1").alias("chrom"), F.explode(F.sequence(F.col("b2") - frame, F.col("b1") + frame)).alias("bin"), "obs", "ctrl")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    mean = lambda c: F.rank().over(W.partitionBy(*keys).orderBy(c)) + (F.count("*").over(W.partitionBy(*keys, c)) - 1) / 2
    return rows.withColumn("x", mean("obs")).withColumn("y", mean("ctrl"))


def metric(contacts: DataFrame, resolution: int, *, frame: int = 8, name: str = "pbad", max_dist_mb: float = 100.0) -> DataFrame:
    """chrom, start, end, value for every anchor with enough contacts; an unknown name counts as pbad."""
    kind = METRICS.get(name, METRICS["pbad"])
    if kind.stripe:
        rows = contacts.where((F.col("chrom1") == F.col("chrom2")) & (F.col("b2") - F.col("b1") <= frame)).select(F.col("chrom2").alias("chrom"), F.col("b2").alias("bin"), "obs", "ctrl")
    else:
        rows = windows(contacts, frame, int(max_dist_mb * 1e6 / resolution)).join(anchors(contacts), ["chrom", "bin"])
    if name == "spearman":
        rows = _ranked(rows, ["chrom", "bin"])
    got = rows.groupBy("chrom", "bin").agg(F.count("*").alias("n"), kind.value().alias("value")).where(F.col("n") > kind.threshold(frame))
    return got.select("chrom", (F.col("bin") * resolution).alias("start"), ((F.col("bin") + 1) * resolution - 1).alias("end"), "value")


def metric_loci(contacts: DataFrame, loci: DataFrame, resolution: int, *, name: str = "pbad", max_dist_mb: float = 100.0) -> DataFrame:
    """chrom, start, end, value of explicit loci (chrom, start, end in bp): all contacts with both bins inside, any number."""
    kind = METRICS.get(name, METRICS["pbad"])
    cells = loci.select(F.col("chrom").alias("chrom1"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / resolution), F.floor(F.col("end") / resolution))).alias("b1"))
    near = contacts.where((F.col("chrom1") == F.col("chrom2")) & (F.col("b2") - F.col("b1") <= int(max_dist_mb * 1e6 / resolution)))
    rows = near.join(cells, ["chrom1", "b1"]).where(F.col("b2") <= F.floor(F.col("end") / resolution))
    rows = rows.withColumnRenamed("chrom1", "chrom")
    if name == "spearman":
        rows = _ranked(rows, ["chrom", "start", "end"])
    return rows.groupBy("chrom", "start", "end").agg(kind.value().alias("value"))


def ordered_bedgraph(values: DataFrame, fai: DataFrame) -> DataFrame:
    return values.join(F.broadcast(fai.select("chrom", "ord")), "chrom").orderBy("ord", "start", "end").select("chrom", "start", "end", "value")


# ---- shuffled controls


def shuffled(rows: DataFrame, column: str, bucket: Column, order: list[str], seed: str, keep: list[str] | None = None) -> DataFrame:
    """rows with one column permuted: the k-th row in the order of the keys gets the value of the k-th row in the order
    of md5(seed, keys). The permutation depends on the keys and the seed alone; rows with equal keys, which no lift makes, are
    in any order. bucket: coarse part of the key order; keep: the other columns that are needed (all). The values in their drawn
    order are written, and so are the rows in theirs, so that what ordered either can go before the rows move."""
    others = [c for c in rows.columns if c != column] if keep is None else keep
    key = F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in order))
    drawn = rows.select(F.col(column).alias("_v"), F.unhex(F.md5(key.cast("binary"))).alias("_h"))
    first = F.conv(F.hex(F.substring("_h", 1, 2)), 16, 10).cast("int")
    drawn = written(numbered(drawn, first, [F.col("_h")], "_i").select("_v", "_i"), "drawn", **TIGHT)
    release(rows.sparkSession)
    placed = written(numbered(rows.drop(column), bucket, [F.col(c) for c in order], "_i").select(*others, "_i"), "placed", **TIGHT)
    release(rows.sparkSession)
    shown = [c for c in rows.columns if c == column or c in others]
    return placed.join(drawn, "_i").select(*(F.col("_v").alias(c) if c == column else c for c in shown))


def shuffled_contacts(contacts: DataFrame, seed: str = "1") -> DataFrame:
    return shuffled(contacts, "ctrl", F.struct("chrom1", "b1"), ["chrom1", "b1", "chrom2", "b2"], seed)


# ---- histograms


def hist2d(rows: DataFrame, x: Column, y: Column, x_range: tuple[float, float], y_range: tuple[float, float], bins: int, name: str) -> DataFrame:
    """ix, iy and the density of the pairs inside the ranges; empty cells are left out."""
    at = rows.select(x.alias("x"), y.alias("y")).select(hist_index(F.col("x"), *x_range, bins).alias("ix"), hist_index(F.col("y"), *y_range, bins).alias("iy")).dropna()
    counts = at.groupBy("ix", "iy").agg(F.count("*").alias("c"))
    area = (x_range[1] - x_range[0]) / bins * ((y_range[1] - y_range[0]) / bins)
    total = counts.agg(F.sum("c").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("ix", "iy", (F.col("c") / (F.col("total") * area)).alias(name))  # one row


def against_control(spark, observed: DataFrame, control: DataFrame, bins: int) -> DataFrame:
    """ix, iy, observed, control and their log2 ratio for every cell of the grid."""
    grid = spark.range(bins * bins).select((F.col("id") / bins).cast("int").alias("ix"), (F.col("id") % bins).cast("int").alias("iy"))
    rows = grid.join(observed, ["ix", "iy"], "left").join(control, ["ix", "iy"], "left").na.fill(0.0, ["observed", "control"])
    return rows.withColumn("log2_ratio", safe_log2(F.col("observed"), F.col("control")))


def percentile_map(lift: DataFrame, fai: DataFrame, resolution: int, *, min_bins: int = 0, max_bins: int = 20, bins: int = 100, seed: str = "1") -> DataFrame:
    """Control against observed percentiles of contacts in a band of distances."""
    rows = short_rows(lift, fai, resolution).where((F.col("lr") > min_bins) & (F.col("lr") <= max_bins))
    drawn = shuffled(rows, "ctrl", F.struct(*LOCUS[:2]), LOCUS, seed, ["obs"])
    one = lambda df, name: hist2d(df, F.col("ctrl"), F.col("obs"), (0, 100), (0, 100), bins, name)
    return against_control(lift.sparkSession, one(rows, "observed"), one(drawn, "control"), bins)


def _token(part: Column) -> tuple[Column, Column]:
    piece = lambda i, k: F.get(F.split(F.get(part, F.lit(i)), ":"), F.lit(k))
    c1, c2, p1, p2 = piece(0, 0), piece(1, 0), piece(0, 1).try_cast("long"), piece(1, 1).try_cast("long")
    one = (F.size(part) == 1) & p1.isNotNull()
    two = (F.size(part) >= 2) & (c1 == c2) & p1.isNotNull() & p2.isNotNull()
    return F.when(one | two, c1), F.when(one, p1).when(two, F.floor((p1 + p2) / 2))


def parse_token(token: Column) -> tuple[Column, Column]:
    """Chromosome and position of a remap label: that of one bin, or the middle of two on one chromosome."""
    return _token(F.split(token, "-"))


def _distances(lift: DataFrame, *others: Column) -> DataFrame:
    """The others, and da, db (Mb), of all rows; steps are columns, as a step that is named twice would be worked out twice."""
    rows = lift.withColumns({f"_{k}": F.split(f"remap{k}_control", "-") for k in (1, 2)})
    rows = rows.withColumns({f"_{x}{k}": v for k in (1, 2) for x, v in zip("cp", _token(F.col(f"_{k}")))})
    da = F.when(F.col("chr1_observed") == F.col("chr2_observed"), F.abs(F.col("pos2_observed") - F.col("pos1_observed")) / 1e6)
    db = F.when(F.col("_c1") == F.col("_c2"), F.abs(F.col("_p2") - F.col("_p1")) / 1e6).otherwise(F.col("control_contact_distances").cast("double"))
    return rows.select(*LOCUS, *others, da.alias("da"), db.alias("db"))


BOTH_DISTANCES = "da >= 0 and db >= 0 and not isnan(db)"


def stat_rows(lift: DataFrame) -> DataFrame:
    """obs, ctrl, da, db (Mb) of rows with both distances. B's distance is that of its labels on one chromosome, and else
    the raw second-to-last column."""
    return _distances(lift, F.col("observed_contacts").cast("double").alias("obs"), F.col("control_contacts").cast("double").alias("ctrl")).where(BOTH_DISTANCES)


def _clipped(rows: DataFrame, most: float) -> DataFrame:
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(most)))
    return rows.withColumn("da", clip("da")).withColumn("db", clip("db"))


def distance_map(lift: DataFrame, *, max_dist_mb: float = 5.0, bins: int = 100, seed: str = "1") -> DataFrame:
    # written before the filter, which would parse the labels again
    rows = _clipped(written(_distances(lift), "distances", **TIGHT).where(BOTH_DISTANCES), max_dist_mb)
    drawn = shuffled(rows, "db", F.struct(*LOCUS[:2]), LOCUS, seed, ["da"])
    span = (0, max_dist_mb)
    one = lambda df, name: hist2d(df, F.col("db"), F.col("da"), span, span, bins, name)
    return against_control(lift.sparkSession, one(rows, "observed"), one(drawn, "control"), bins)


def ratio_map(lift: DataFrame, *, max_dist_mb: float = 5.0, xy_range: float = 12.0, bins: int = 100, seed: str = "1") -> DataFrame:
    eps = 1e-6
    rows = _clipped(stat_rows(lift), max_dist_mb)
    drawn = shuffled(rows, "ctrl", F.struct(*LOCUS[:2]), LOCUS, seed, ["obs", "da", "db"])
    span = (-xy_range, xy_range)
    ratio = lambda a, b: safe_log2(F.col(a) + eps, F.col(b) + eps)
    one = lambda df, name: hist2d(df, ratio("da", "db"), ratio("obs", "ctrl"), span, span, bins, name)
    return against_control(lift.sparkSession, one(rows, "observed"), one(drawn, "control"), bins)


def metric_range(values: DataFrame, name: str) -> tuple[float, float] | None:
    """1 % and 99 % quantiles of the finite values; symmetric for log and pbad if both differ from 0."""
    finite = values.where(~F.isnan("value") & (F.abs("value") < float("inf")))
    q = finite.agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("q")).first().q
    if q is None:
        return None
    if name in ("log", "pbad") and q[0] and q[1]:
        most = max(abs(q[0]), abs(q[1]))
        return -most, most
    return q[0], q[1]


def metric_hist(values: DataFrame, span: tuple[float, float], bins: int = 50) -> DataFrame:
    """bin, low, high, density of the values inside the span."""
    lo, hi = span if span[1] > span[0] else (span[0] - 0.5, span[1] + 0.5)
    step = (hi - lo) / bins
    counts = values.select(hist_index(F.col("value"), lo, hi, bins).alias("bin")).dropna().groupBy("bin").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    grid = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    rows = grid.join(counts, "bin", "left").crossJoin(F.broadcast(total))  # one row
    return rows.select("bin", (lo + F.col("bin") * step).alias("low"), (lo + (F.col("bin") + 1) * step).alias("high"), (F.coalesce("c", F.lit(0)) / (F.coalesce("total", F.lit(1)) * step)).alias("density"))


def metric_kde(values: DataFrame, span: tuple[float, float], points: int = 400) -> DataFrame:
    """i, x, density: Gaussian kernels of 1/40 of the span, on an even grid over it; equal values are counted first."""
    lo, hi = span
    width = (hi - lo) / 40
    counts = values.where(~F.isnan("value")).groupBy("value").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    x = F.lit(lo) + F.col("i") * F.lit((hi - lo) / (points - 1))
    rows = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    z = (F.col("x") - F.col("value")) / width
    sums = rows.groupBy("i", "x").agg(F.sum(F.col("c") * F.exp(-z * z / 2)).alias("s"))
    return sums.crossJoin(F.broadcast(total)).select("i", "x", (F.col("s") / (F.col("total") * F.lit(width) * F.sqrt(2 * F.pi()))).alias("density"))  # one row


# ---- matrices and exports

MODES = ("obs", "ctrl", "diff", "log2ratio")


def parse_region(text: str, sizes: dict[str, int]) -> tuple[str, int, int]:
    """chr or chr:start-end, commas allowed."""
    name, _, span = text.partition(":")
    start, end = (int(x.replace(",", "")) for x in span.split("-")) if span else (0, sizes[name])
    if end <= start:
        raise ValueError(f"{text}: the end must be after the start")
    return name, start, end


def parse_heat(text: str) -> tuple[str, str]:
    """The modes of the upper and the lower triangle."""
    upper, _, lower = text.lower().partition("-")
    for m in (upper, lower or upper):
        if m not in MODES:
            raise ValueError(f"{m} is not one of {MODES}")
    return upper, lower or upper


def parse_borders(text: str) -> list[tuple[str, str | None, str | None]]:
    """path[:label[:color]], separated by commas."""
    out = []
    for item in filter(None, text.split(",")):
        parts = [*item.split(":"), None, None]
        out.append((parts[0], parts[1] or None, parts[2] or None))
    return out


def region_matrix(contacts: DataFrame, region_y: tuple[str, int, int], region_x: tuple[str, int, int], resolution: int, mode: str = "obs") -> DataFrame:
    """iy, ix, v of the cells with a contact; mirrored on one chromosome. A trailing part of a bin is no bin."""
    (cy, ys, ye), (cx, xs, xe) = ((c, s // resolution, e // resolution) for c, s, e in (region_y, region_x))
    ny, nx = ye - ys, xe - xs
    eps = 1e-6
    value = {"obs": F.col("obs"), "ctrl": F.col("ctrl"), "diff": F.col("obs") - F.col("ctrl")}.get(mode, F.log2((F.col("obs") + eps) / (F.col("ctrl") + eps)))
    rows = contacts.where((F.col("chrom1") == cy) & (F.col("chrom2") == cx)).select((F.col("b1") - ys).alias("iy"), (F.col("b2") - xs).alias("ix"), value.alias("v"))
    rows = rows.where((F.col("iy") >= 0) & (F.col("iy") < ny) & (F.col("ix") >= 0) & (F.col("ix") < nx))
    if cy == cx:
        mirror = rows.select(F.col("ix").alias("iy"), F.col("iy").alias("ix"), "v").where((F.col("iy") < ny) & (F.col("ix") < nx))
        rows = rows.withColumn("m", F.lit(0)).union(mirror.withColumn("m", F.lit(1))).groupBy("iy", "ix").agg(F.min_by("v", "m").alias("v"))
    return rows


def split_matrix(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """iy, ix, upper, lower: one mode on and above the diagonal, another on and below it."""
    up, low = upper.where("ix >= iy").withColumnRenamed("v", "upper"), lower.where("ix <= iy").withColumnRenamed("v", "lower")
    return up.join(low, ["iy", "ix"], "full")


def color_limit(matrix: DataFrame, quantile: float = 0.98) -> DataFrame:
    """limit: a quantile of the absolute values, at least 1e-6."""
    return matrix.agg(F.greatest(F.percentile(F.abs("v"), quantile), F.lit(1e-6)).alias("limit"))


def map_limits(maps: dict[str, DataFrame], given: float | None = None) -> DataFrame:
    """map, limit: that of each map's diverging colours, as given or the 99 % quantile of its ratios' sizes. Maps are grids of
    a fixed size, so a quantile is one small sort."""
    rows = [(color_limit(m.select(F.col("log2_ratio").alias("v")), 0.99) if given is None else m.sparkSession.range(1).select(F.lit(float(given)).alias("limit"))).select(F.lit(name).alias("map"), "limit") for name, m in maps.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def genome_bins(fai: DataFrame, resolution: int) -> DataFrame:
    """bin_id, chrom, start, end of full bins, in the order of the index; tails are dropped."""
    sizes = fai.withColumn("n", F.floor(F.col("size") / resolution))
    sizes = sizes.withColumn("offset", F.sum("n").over(W.orderBy("ord")) - F.col("n")).where("n > 0")  # a row for each chromosome
    rows = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select((F.col("offset") + F.col("i")).alias("bin_id"), "chrom", (F.col("i") * resolution).alias("start"), ((F.col("i") + 1) * resolution).alias("end"))


def genome_pixels(contacts: DataFrame, fai: DataFrame, resolution: int, which: str = "obs") -> DataFrame:
    """bin1_id, bin2_id, count: contacts on the genome's full bins; others are dropped."""
    sizes = fai.withColumn("n", F.floor(F.col("size") / resolution))
    sizes = sizes.withColumn("offset", F.sum("n").over(W.orderBy("ord")) - F.col("n"))
    side = lambda k: F.broadcast(sizes.select(F.col("chrom").alias(f"chrom{k}"), F.col("n").alias(f"n{k}"), F.col("offset").alias(f"off{k}")))
    rows = contacts.join(side(1), "chrom1").join(side(2), "chrom2").where("b1 >= 0 and b2 >= 0 and b1 < n1 and b2 < n2")
    i, j = F.col("off1") + F.col("b1"), F.col("off2") + F.col("b2")
    return rows.select(F.least(i, j).alias("bin1_id"), F.greatest(i, j).alias("bin2_id"), F.col(which).cast("float").alias("count"))


def bedgraph_track(track: DataFrame, chrom: str, start: int, end: int, resolution: int) -> DataFrame:
    """i, value of every bin of a region: later rows overwrite earlier ones, and bins without a row are 0."""
    bs, be = start // resolution, end // resolution
    low, high = F.greatest(F.floor(F.col("start") / resolution), F.lit(bs)), F.least(F.floor((F.col("end") + resolution - 1) / resolution), F.lit(be))
    rows = track.where(F.col("chrom") == chrom).withColumn("lo", low).withColumn("hi", high).where("hi > lo")
    cells = rows.withColumn("i", F.explode(F.sequence(F.col("lo") - bs, F.col("hi") - 1 - bs))).groupBy("i").agg(F.max_by("value", "line").alias("value"))
    grid = track.sparkSession.range(max(0, be - bs)).select(F.col("id").alias("i"))
    return grid.join(cells, "i", "left").select("i", F.coalesce("value", F.lit(0.0)).alias("value"))


def midpoints(bed: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Sorted middles of a chromosome's intervals, in [start, end)."""
    x = F.floor((F.col("start") + F.col("end")) / 2)
    return bed.where(F.col("chrom") == chrom).select(x.cast("long").alias("x")).where((F.col("x") >= start) & (F.col("x") < end)).orderBy("x")


def draw_map(contacts: DataFrame, locus_start: int, resolution: int) -> DataFrame:
    """Relative bins of the contacts with the marker sizes and colours of observed and of both values."""
    start = locus_start // resolution
    square = lambda x: F.least(F.greatest(x, F.lit(2.0)) ** 2, F.lit(100.0)).cast("int")
    s1 = square(F.lit(0.1) * (100 - F.col("dev_obs")))
    s2 = square(F.lit(0.1) * (100 - F.col("dev_obs") - F.col("dev_ctrl")))
    return contacts.select((F.col("b2") - start).alias("x"), (F.col("b1") - start).alias("y"), s1.alias("size_obs"), F.col("obs").alias("color_obs"), s2.alias("size_both"), (F.col("obs") - F.col("ctrl")).alias("color_both"))
