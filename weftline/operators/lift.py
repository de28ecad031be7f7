"""Lifting the contacts of genome A to genome B through a synteny map.

All weights are whole hundredths, so weighted sums of percentiles are exact whatever the order of rows. Keys are
canonical, (ordinal, bin) pairs with the smaller first, so one equi-join finds a lifted pair in either orientation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from copy import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import half_even, share100
from ..storage import TIGHT, release, written, written_in_turn
from .prepare import _small

CRITERIA = ("length", "coverage", "deviation", "none", "default")
MODELS = ("balanced", "raw")
KEY = ("n1", "b1", "n2", "b2")


def checked_chroms(bins: DataFrame, fai: DataFrame) -> None:
    """Fails if a bin lies on a chromosome that the index doesn't have."""
    missing = bins.select("chrom").distinct().join(F.broadcast(fai), "chrom", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"chromosomes without an index entry: {[r.chrom for r in missing]}")


def canonical(contacts: DataFrame, fai: DataFrame) -> DataFrame:
    """n1, b1, n2, b2, rank, strict, weak, cov1, cov2: one row per pair of bins.

    Of several rows for a pair of bin ids the last in the file stays (if there is a line column). Keys are put
    in the order of (ordinal, bin), and the coverages go with their keys.
    """
    rows = contacts
    if "line" in contacts.columns:
        latest = W.partitionBy(F.least("bin1", "bin2"), F.greatest("bin1", "bin2")).orderBy(F.desc("line"))
        rows = rows.withColumn("_k", F.row_number().over(latest)).where("_k = 1")
        # the reader swaps keys into bin order without their coverages
        swap = F.col("bin1") > F.col("bin2")
        pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
        rows = rows.select(pick("chrom1", "chrom2").alias("chrom1"), pick("bin1", "bin2").alias("bin1"), pick("chrom2", "chrom1").alias("chrom2"), pick("bin2", "bin1").alias("bin2"), "rank", "strict", "weak", "cov1", "cov2")
    index = lambda k: F.broadcast(fai.select(F.col("chrom").alias(f"chrom{k}"), F.col("ord").alias(f"o{k}")))
    rows = rows.join(index(1), "chrom1").join(index(2), "chrom2")
    one, two = (F.struct(F.col(f"o{k}").alias("n"), F.col(f"bin{k}").alias("b")) for k in (1, 2))
    swap = two < one
    lo, hi = F.least(one, two), F.greatest(one, two)
    cov = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return rows.select(lo["n"].alias("n1"), lo["b"].alias("b1"), hi["n"].alias("n2"), hi["b"].alias("b2"), "rank", "strict", "weak", cov("cov1", "cov2").alias("cov1"), cov("cov2", "cov1").alias("cov2"))


def observed_bins(contacts: DataFrame) -> DataFrame:
    """bin, chrom, start, end of every bin that some contact has."""
    ends = contacts.select(F.explode(F.array(*(F.struct(F.col(f"bin{k}").alias("bin"), F.col(f"chrom{k}").alias("chrom"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end")) for k in (1, 2)))).alias("e"))
    return ends.select("e.*").groupBy("bin").agg(F.max(F.struct("chrom", "start", "end")).alias("e")).select("bin", "e.*")


def resolution_of(bins: DataFrame) -> int:
    """The most frequent width, the smaller of equals; 1 without bins."""
    top = bins.groupBy((F.col("end") - F.col("start")).alias("w")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").limit(1).collect()
    return top[0].w if top else 1


def located(points: DataFrame, bins: DataFrame, resolution: int, chrom: str, mid: str, out: str) -> DataFrame:
    """points with the observed bin that holds mid in [start, end); the others go.

    Bins have a fixed width, so the start follows from mid and an equi-join finds it.
    """
    side = bins.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("bin").alias(out))
    start = F.floor(F.col(mid) / resolution) * resolution
    return points.join(side, (F.col(chrom) == F.col("_c")) & (start == F.col("_s")) & (F.col(mid) < F.col("_e"))).drop("_c", "_s", "_e")


def _in_cell(points: DataFrame, bins: DataFrame, resolution: int, chrom: str, mid: str) -> DataFrame:
    """points with mid at the start of its cell of the resolution, where all points of a cell are in the same bins: where no
    bin is narrower than the cell. Elsewhere mid stays."""
    narrow = bins.where(F.col("end") - F.col("start") < resolution).select(F.col("chrom").alias(chrom), F.col("start").alias("_s"), F.lit(True).alias("_narrow")).distinct()
    rows = points.withColumn("_s", F.floor(F.col(mid) / resolution) * resolution).join(_small(narrow), [chrom, "_s"], "left")
    return rows.withColumn(mid, F.when(F.col("_narrow"), F.col(mid)).otherwise(F.col("_s"))).drop("_s", "_narrow")


def remap_pairs(mark: DataFrame, bins_a: DataFrame, bins_b: DataFrame, fai_a: DataFrame, fai_b: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """na, ba, nb, bb, first_line: distinct pairs of bins of the mark rows' midpoints. mark: with a sortable line; sizes: of
    the bins. Rows of a pair of cells become one before they are joined with bins, as a link has many rows in a cell."""
    index = lambda fai, k: F.broadcast(fai.select(F.col("chrom").alias(f"chrom_{k}"), F.col("ord").alias(f"n{k}")))
    rows = mark.join(index(fai_a, "a"), "chrom_a").join(index(fai_b, "b"), "chrom_b")
    mid = lambda k: F.floor((F.col(f"start_{k}") + F.col(f"end_{k}")) / 2)
    rows = rows.withColumn("mid_a", mid("a")).withColumn("mid_b", mid("b"))
    rows = _in_cell(_in_cell(rows, bins_a, sizes[0], "chrom_a", "mid_a"), bins_b, sizes[1], "chrom_b", "mid_b")
    rows = rows.groupBy("na", "mid_a", "nb", "mid_b").agg(F.min("line").alias("line"))
    by_ord = lambda bins, fai: bins.join(F.broadcast(fai.select("chrom", "ord")), "chrom").select(F.col("ord").alias("chrom"), "start", "end", "bin")
    rows = located(rows, by_ord(bins_a, fai_a), sizes[0], "na", "mid_a", "ba").drop("mid_a")
    rows = located(rows, by_ord(bins_b, fai_b), sizes[1], "nb", "mid_b", "bb").drop("mid_b")
    return rows.groupBy("na", "ba", "nb", "bb").agg(F.min("line").alias("first_line"))


def frame_bins(agg_frame: int, resolution_b: int) -> int:
    return max(1, round(agg_frame / resolution_b))


def remap_groups(pairs: DataFrame, frame: int) -> DataFrame:
    """na, ba, j, nb, bb, share100, w100: each A bin's groups of B bins, numbered in their order.

    A group is a run of B bins of one chromosome without a step over frame. Chromosomes come in the order of the
    earliest line of any of the A bin's B bins on them, lines counted over all A bins.
    """
    b_bin = W.partitionBy("nb", "bb")
    rows = pairs.withColumn("line_b", F.min("first_line").over(b_bin)).withColumn("w100", share100(F.count("*").over(b_bin)))
    rows = rows.repartition("na", "ba")  # for all windows that follow
    rows = rows.withColumn("line_c", F.min("line_b").over(W.partitionBy("na", "ba", "nb")))
    rows = rows.withColumn("new", F.coalesce(F.col("bb") - F.lag("bb").over(W.partitionBy("na", "ba", "nb").orderBy("bb")) > frame, F.lit(True)).cast("int"))
    rows = rows.withColumn("j", F.sum("new").over(W.partitionBy("na", "ba").orderBy("line_c", "nb", "bb")).cast("int") - 1)
    return rows.withColumn("share100", share100(F.count("*").over(W.partitionBy("na", "ba", "j")))).select("na", "ba", "j", "nb", "bb", "share100", "w100")


#: Bins of a block; a tile is the contacts of two blocks, in either order.
BLOCK = 512
#: What pairs become is written in a pass for so many tiles, in a few passes at most, as each reads all contacts.
TILES, PASSES = 200, 4


def _block(bin_: Column) -> Column:
    return F.floor(bin_ / BLOCK)


def _two(a: Column, b: Column) -> Column:
    """Two whole numbers of 31 bits as one, in whose order the first comes first."""
    return a.cast("long") * (1 << 32) + b


def _tile(a: Column, b: Column) -> Column:
    return _two(F.least(a, b), F.greatest(a, b))


@contextmanager
def by_tile(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile joins rows where their tiles are: tables dealt by tile aren't dealt anew by finer keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def tiled(a: DataFrame) -> DataFrame:
    """Canonical contacts with their tile."""
    return a.select(_tile(_block(F.col("b1")), _block(F.col("b2"))).alias("tile"), *KEY, "rank", "strict", "weak")


def remapped_ends(groups: DataFrame, bins_a: DataFrame, bins_b: DataFrame) -> DataFrame:
    """n, b, pos, us: each A bin's start and all its B bins: group j, code (ordinal and bin), start, weight f, whether the
    group has a share, and the group's least code."""
    rows = groups.join(bins_b.select(F.col("bin").alias("bb"), F.col("start").alias("s")), "bb").withColumn("code", _two(F.col("nb"), F.col("bb")))
    rows = rows.withColumn("p", F.min("code").over(W.partitionBy("na", "ba", "j")))
    u = F.struct("j", "code", "s", (F.col("share100").cast("long") * F.col("w100")).alias("f"), (F.col("share100") > 0).alias("live"), "p")
    ends = rows.groupBy(F.col("na").alias("n"), F.col("ba").alias("b")).agg(F.collect_list(u).alias("us"))
    return ends.join(bins_a.select(F.col("bin").alias("b"), F.col("start").alias("pos")), "b").select("n", "b", "pos", "us")


def mapped_from(groups: DataFrame) -> DataFrame:
    """code, at: each B bin's code, and the blocks of A whose bins map to it."""
    return groups.groupBy(_two(F.col("nb"), F.col("bb")).alias("code")).agg(F.collect_set(_block(F.col("ba"))).alias("at"))


def targets(b: DataFrame, back: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile, lo, hi, b_rank, b_strict, b_weak, b_cov2: B's contacts in every tile of A that may ask for them. back: see
    mapped_from()."""
    back = _small(back)
    side = lambda k: back.select(F.col("code").alias(k), F.col("at").alias(f"at_{k}"))
    rows = b.select(_two(F.col("n1"), F.col("b1")).alias("lo"), _two(F.col("n2"), F.col("b2")).alias("hi"), F.col("rank").alias("b_rank"), F.col("strict").alias("b_strict"), F.col("weak").alias("b_weak"), F.col("cov2").alias("b_cov2"))
    rows = rows.join(side("lo"), "lo").join(side("hi"), "hi")
    every = F.array_distinct(F.flatten(F.transform("at_lo", lambda x: F.transform("at_hi", lambda y: _tile(x, y)))))
    rows = rows.select(F.explode(every).alias("tile"), "lo", "hi", "b_rank", "b_strict", "b_weak", "b_cov2")
    return rows.join(_small(tiles), "tile", "left_semi")


def lifted_pairs(a: DataFrame, found: DataFrame, ends: DataFrame) -> DataFrame:
    """Every combination of the two ends' remapped bins, with B's values where B has that contact (hit).

    a: see tiled(), found: targets(), ends: remapped_ends(). Contacts, the remapped bins that a tile's contacts have, and B's
    contacts that it may meet are dealt out by tile, and combinations are made there only, so they never move. A result
    that is to keep to that is written under by_tile().
    """
    need = a.select("tile", F.explode(F.array(*(F.struct(F.col(f"n{k}").alias("n"), F.col(f"b{k}").alias("b")) for k in (1, 2)))).alias("e")).select("tile", "e.*").distinct()
    held = need.join(ends, ["n", "b"]).repartition("tile")
    end = lambda k: held.select("tile", F.col("n").alias(f"n{k}"), F.col("b").alias(f"b{k}"), F.col("pos").alias(f"pos{k}"), F.col("us").alias(f"us{k}")).hint("shuffle_hash")
    rows = a.repartition("tile").join(end(1), ["tile", "n1", "b1"]).join(end(2), ["tile", "n2", "b2"])
    same = ("tile", *KEY, "rank", "strict", "weak", "pos1", "pos2")
    rows = rows.select(*same, F.explode("us1").alias("u"), "us2").select(*same, "u", F.explode("us2").alias("v"))
    first = F.col("u.code") <= F.col("v.code")
    pick = lambda c, a, b: F.when(first, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
    rows = rows.select(
        *same, F.col("u.j").alias("j1"), F.col("v.j").alias("j2"), (F.col("u.f") * F.col("v.f")).alias("base"), (F.col("u.live") & F.col("v.live")).alias("live"),
        pick("code", "u", "v").alias("lo"), pick("code", "v", "u").alias("hi"), pick("s", "u", "v").alias("s_lo"), pick("s", "v", "u").alias("s_hi"),
        F.least("u.p", "v.p").alias("p_lo"), F.greatest("u.p", "v.p").alias("p_hi"),
    )
    return rows.join(found.repartition("tile").withColumn("hit", F.lit(True)).hint("shuffle_hash"), ["tile", "lo", "hi"], "left")


def _label(k: str) -> Column:
    """The name of one or two bins, joined, or of the first of more.

    No bin lies between the least and the greatest if the sum of (x - least) * (greatest - x) over all is zero.
    """
    low, high = (F.shiftright(f"{m}_{k}", 40) for m in ("min", "max"))
    between = (low + high) * F.col(f"sum_{k}") - F.col(f"squares_{k}") - F.col("n") * low * high
    shown = lambda m: F.concat(F.col(f"chrom_{k}"), F.lit(":"), F.col(f"{m}_{k}").bitwiseAND((1 << 40) - 1).cast("string"))
    return F.when((low < high) & (between == 0), F.concat_ws("-", shown("min"), shown("max"))).otherwise(shown("min"))


CANDIDATE = (*KEY, "j1", "j2", "remap1", "remap2", "obs", "ctrl", "dev_obs", "dev_ctrl", "obs_strict", "obs_weak", "ctrl_strict", "ctrl_weak", "ctrl_cov2", "coverage")


def candidates(pairs: DataFrame, fai_b: DataFrame, model: str = "raw") -> DataFrame:
    """One row for each contact and pair of groups with at least one hit and a positive weight: the columns of CANDIDATE, and
    tile, pos1, pos2.

    A group's B bins lie close to its least one, so a bin is held as its distance from there and its start, in one number.
    """
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    hit = pairs.where("hit and live").withColumns({f"x_{k}": F.col(k) - F.col(f"p_{k}") for k in ("lo", "hi")})
    total = lambda c: F.sum(F.col("base") * F.col(c))
    packed = lambda k: F.col(f"x_{k}") * (1 << 40) + F.col(f"s_{k}")
    bins = lambda k: (F.min(packed(k)).alias(f"min_{k}"), F.max(packed(k)).alias(f"max_{k}"), F.sum(f"x_{k}").alias(f"sum_{k}"), F.sum(F.col(f"x_{k}") * F.col(f"x_{k}")).alias(f"squares_{k}"), F.min(f"p_{k}").alias(f"p_{k}"))
    got = hit.groupBy("tile", *KEY, "j1", "j2", "rank", "strict", "weak", "pos1", "pos2").agg(
        total("b_rank").alias("s_rank"), total("b_strict").alias("s_strict"), total("b_weak").alias("s_weak"), total("b_cov2").alias("s_cov2"),
        F.sum("base").alias("s_base"), F.count("*").alias("n"), *bins("lo"), *bins("hi"),
    ).where("s_base > 0")
    for k in ("lo", "hi"):
        got = got.withColumn(f"o_{k}", F.shiftright(f"p_{k}", 32).cast("int")).join(_index(fai_b, f"o_{k}", f"chrom_{k}"), f"o_{k}")
    unit = 1e8
    norm = F.col("s_base").cast("double") if model == "balanced" else F.lit(unit)
    deviation = F.greatest(F.col("s_weak") - F.col("s_rank"), F.col("s_rank") - F.col("s_strict"))
    return got.select(
        *KEY, "j1", "j2",
        _label("lo").alias("remap1"), _label("hi").alias("remap2"),
        F.col("rank").cast("int").alias("obs"), half_even(F.col("s_rank") / norm).alias("ctrl"),
        F.greatest(F.col("weak") - F.col("rank"), F.col("rank") - F.col("strict")).cast("int").alias("dev_obs"), half_even(deviation / unit).alias("dev_ctrl"),
        F.col("strict").cast("int").alias("obs_strict"), F.col("weak").cast("int").alias("obs_weak"),
        half_even(F.col("s_strict") / norm).alias("ctrl_strict"), half_even(F.col("s_weak") / norm).alias("ctrl_weak"),
        F.bround(F.col("s_cov2") / norm, 2).alias("ctrl_cov2"), F.bround(F.col("s_base") / unit, 5).alias("coverage"),
        "tile", "pos1", "pos2",
    )


def _index(fai: DataFrame, n: str, chrom: str) -> DataFrame:
    return F.broadcast(fai.select(F.col("ord").alias(n), F.col("chrom").alias(chrom)))  # a row for each chromosome


def _placed(cands: DataFrame, criterion: str) -> DataFrame:
    """cands with _k, their places among the candidates of their contact: the least criterion first, of equals the later; with
    none, the first."""
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    value = {"coverage": F.col("ctrl_cov2") * F.col("ctrl_weak"), "deviation": F.col("dev_ctrl"), "length": F.col("ctrl_cov2"), "default": F.col("coverage")}.get(criterion)
    order = ["j1", "j2"] if value is None else [value, F.desc("j1"), F.desc("j2")]
    keys = ["tile"] * ("tile" in cands.columns) + list(KEY)
    return cands.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def choose_best(cands: DataFrame, criterion: str = "default") -> DataFrame:
    """One candidate per contact: the least criterion, of equals the later; with none, the first."""
    return _placed(cands, criterion).where("_k = 1").drop("_k")


def lift_rows(best: DataFrame, fai_a: DataFrame) -> DataFrame:
    """The 16-column result, and line, its order: (n1, n2, b1, b2)."""
    rows = best.join(_index(fai_a, "n1", "chr1_observed"), "n1").join(_index(fai_a, "n2", "chr2_observed"), "n2")
    return rows.select(
        "chr1_observed", F.col("pos1").alias("pos1_observed"), "chr2_observed", F.col("pos2").alias("pos2_observed"), F.col("remap1").alias("remap1_control"), F.col("remap2").alias("remap2_control"),
        F.col("obs").alias("observed_contacts"), F.col("ctrl").alias("control_contacts"), F.col("dev_obs").alias("observed_deviations"), F.col("dev_ctrl").alias("control_deviations"),
        F.col("obs_strict").alias("observed_coverages_pos1"), F.col("obs_weak").alias("observed_coverages_pos2"), F.col("ctrl_strict").alias("control_coverages_pos1"), F.col("ctrl_weak").alias("control_coverages_pos2"),
        F.col("ctrl_cov2").alias("control_contact_distances"), F.col("coverage").alias("remapping_coverages"), F.struct("n1", "n2", "b1", "b2").alias("line"),
    )


def met_contacts(pairs: DataFrame) -> DataFrame:
    """Of each remappable contact: whether some pair of bins was hit, whether some was missed, and its candidates."""
    hit = F.coalesce("hit", F.lit(False))
    by_group = pairs.groupBy("tile", *KEY, "j1", "j2").agg(F.max(hit).alias("hit"), F.max(~hit).alias("missed"), (F.sum(F.when(hit, F.col("base"))) > 0).alias("weighs"))
    return by_group.groupBy("tile", *KEY).agg(F.max("hit").alias("hit"), F.max("missed").alias("missed"), F.count_if("weighs").alias("c")).drop("tile")


def lift_stat(a: DataFrame, groups: DataFrame, met: DataFrame) -> DataFrame:
    """name, contacts, bins: the six counters, from one pass over contacts and one over their ends. met: see met_contacts().

    Bins: unique and duplicated count the bins of remappable contacts with one group or more, without those whose pairs
    were all missed.
    """
    rows = a.select(*KEY).join(met.withColumn("able", F.lit(True)), list(KEY), "left")
    end = lambda k: F.struct(F.col(f"n{k}").alias("n"), F.col(f"b{k}").alias("b"))
    is_set = lambda c: F.max(F.coalesce(c, F.lit(False))).alias(c)
    ends = rows.select(F.explode(F.array(end(1), end(2))).alias("e"), "able", "hit", "missed").groupBy("e.n", "e.b").agg(is_set("able"), is_set("hit"), is_set("missed"))
    mapped = groups.groupBy(F.col("na").alias("n"), F.col("ba").alias("b")).agg((F.max("j") + 1).alias("groups"))
    lost = F.col("missed") & ~F.col("hit")
    names = ("all", "remappable", "processed", "unique", "duplicated", "dropped")
    c = F.coalesce("c", F.lit(0))
    contacts = rows.agg(F.array(F.count("*"), F.count_if("able"), F.count_if("hit"), F.count_if(c == 1), F.count_if(c > 1), F.coalesce(F.sum(F.greatest(c - 1, F.lit(0))), F.lit(0))).alias("contacts"))
    bins = ends.join(mapped, ["n", "b"], "left").agg(F.array(F.count("*"), F.count_if("able"), F.count_if("hit"), F.count_if(F.col("able") & ~lost & (F.col("groups") == 1)), F.count_if(F.col("able") & ~lost & (F.col("groups") > 1)), F.count_if(lost)).alias("bins"))
    both = contacts.crossJoin(bins)  # a row each
    return both.select(F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), "contacts", "bins")).alias("z")).select("z.*")


class Lift:
    """All steps of a lift; each is a DataFrame that can be used on its own. The observed bins and the groups are written
    once, and results when they are first asked for, each straight from the pairs of contacts, which are never written."""

    def __init__(self, contacts_a: DataFrame, contacts_b: DataFrame, fai_a: DataFrame, fai_b: DataFrame, mark: DataFrame, *, agg_frame: int = 150_000, model: str = "raw", bins: tuple[DataFrame, DataFrame] | None = None):
        """bins: the observed ones (see observed_bins()) where they are known; contacts then need no starts and ends."""
        self.spark, self.fai_a, self.fai_b, self.model = contacts_a.sparkSession, fai_a, fai_b, model
        observed = bins or (observed_bins(contacts_a), observed_bins(contacts_b))
        self.bins_a, self.bins_b = (written(x, f"bins-{k}", **TIGHT) for x, k in zip(observed, "ab"))
        checked_chroms(self.bins_a, fai_a)
        checked_chroms(self.bins_b, fai_b)
        self.a, self.b = canonical(contacts_a, fai_a), canonical(contacts_b, fai_b)
        sizes = resolution_of(self.bins_a), resolution_of(self.bins_b)
        self.remap = written(remap_pairs(mark, self.bins_a, self.bins_b, fai_a, fai_b, sizes), "remap", **TIGHT)
        release(self.spark)
        self.groups = written(remap_groups(self.remap, frame_bins(agg_frame, sizes[1])), "groups", **TIGHT)
        release(self.spark)
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame | list[DataFrame]], label: str | None = None) -> DataFrame:
        """make()'s rows, written when they are first asked for, joined tile by tile, and pass by pass if there are several."""
        if name not in self._made:
            made = make()
            with by_tile(self.spark):
                self._made[name] = written_in_turn(made if isinstance(made, list) else [made], label or name, **TIGHT)
            release(self.spark)
        return self._made[name]

    @property
    def pairs(self) -> DataFrame:
        return self._passes(1)[0]

    def _passes(self, n: int | None = None) -> list[DataFrame]:
        """The pairs in n passes, or as many as the tiles call for. A pass has a share of the tiles, all pairs of each; only a
        pass's contacts are dealt out at a time."""
        a = tiled(self.a)
        tiles = self._once("tiles", lambda: a.select("tile").distinct())
        ends = self._once("ends", lambda: remapped_ends(self.groups, self.bins_a, self.bins_b))
        if "back" not in self._made:
            self._made["back"] = written(mapped_from(self.groups), "back")
        n = n or min(PASSES, 1 + tiles.count() // TILES)
        share = lambda df, k: df.where(F.pmod(F.xxhash64("tile"), F.lit(n)) == k) if n > 1 else df
        return [lifted_pairs(share(a, k), targets(self.b, self._made["back"], share(tiles, k)), ends) for k in range(n)]

    def _candidates(self) -> list[DataFrame]:
        return [self._made["candidates"]] if "candidates" in self._made else [candidates(p, self.fai_b, self.model) for p in self._passes()]

    @property
    def candidates(self) -> DataFrame:
        return self._once("candidates", self._candidates).select(*CANDIDATE)

    def rows(self, criterion: str = "default", columns: tuple[str, ...] | None = None) -> DataFrame:
        """columns: those that are needed, where not all are; only they are worked out and written."""
        whole = f"lift-{criterion}"
        if columns is None or whole in self._made:
            rows = self._once(whole, lambda: [lift_rows(choose_best(x, criterion), self.fai_a) for x in self._candidates()])
            return rows if columns is None else rows.select(*columns)
        return self._once(f"{whole}: {columns}", lambda: [lift_rows(choose_best(x, criterion), self.fai_a).select(*columns) for x in self._candidates()], "lift-columns")

    def within(self, bins: DataFrame) -> Lift:
        """The lift of the contacts with both ends in bins (a column bin): the same rows, losers and candidates for them. Ranks
        and groups are those of all contacts and links; of groups, those of the contacts' bins are taken."""
        out = copy(self)
        inside = written(bins.select("bin").distinct(), "inside")
        end = lambda k: inside.select(F.col("bin").alias(k))
        out.a = written(self.a.join(_small(end("b1")), "b1", "left_semi").join(_small(end("b2")), "b2", "left_semi"), "a-within", **TIGHT)
        out.groups = written(self.groups.join(_small(end("ba")), "ba", "left_semi"), "groups-within", **TIGHT)
        out._made = {}
        release(self.spark)
        return out

    def losers(self, criterion: str = "default") -> DataFrame:
        """The candidates that were not chosen."""
        return self._once(f"losers-{criterion}", lambda: [_placed(x, criterion).where("_k > 1").select(*CANDIDATE) for x in self._candidates()])

    def stat(self) -> DataFrame:
        return lift_stat(self.a, self.groups, self._once("met", lambda: [met_contacts(p) for p in self._passes()]))
