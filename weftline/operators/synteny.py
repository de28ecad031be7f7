"""Alignments to links, links to a dense synteny map, and the rough lift of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import numbered


def paf_to_link(paf: DataFrame, min_match: int = 0) -> DataFrame:
    """Links of alignments with enough matches; the minus strand swaps the target's ends."""
    minus = F.col("strand") == "-"
    return paf.where(F.col("nmatch") >= min_match).select("line", F.col("qname").alias("chrom_a"), F.col("qstart").alias("start_a"), F.col("qend").alias("end_a"), F.col("tname").alias("chrom_b"), F.when(minus, F.col("tend")).otherwise(F.col("tstart")).alias("start_b"), F.when(minus, F.col("tstart")).otherwise(F.col("tend")).alias("end_b"))


def _line_bucket(df: DataFrame) -> Column:
    """Blocks of lines whose order is that of the lines."""
    kind = df.schema["line"].dataType.typeName()
    return F.struct("line.file_path", "line.file_block_start") if kind == "struct" else F.floor(F.col("line") / 65_536)


def blocks(links: DataFrame) -> DataFrame:
    """links with blk, the running number of valid rows, and dir, 1 or -1."""
    return numbered(links, _line_bucket(links), [F.col("line")], "blk").withColumn("dir", F.when(F.col("end_b") >= F.col("start_b"), 1).otherwise(-1))


def gaps(links: DataFrame) -> DataFrame:
    """A row for each positive gap to the row just before, of the same pair of chromosomes.

    The row before is found by its number, so no window runs over the whole file.
    """
    rows = blocks(links)
    last = rows.select((F.col("blk") + 1).alias("blk"), F.col("chrom_a").alias("pa"), F.col("chrom_b").alias("pb"), F.col("end_a").alias("pea"), F.col("end_b").alias("peb"), F.col("dir").alias("pdir"))
    rows = rows.join(last, "blk").where("chrom_a = pa and chrom_b = pb and start_a - pea > 0")
    plus = F.col("pdir") > 0
    return rows.select("blk", F.lit(0).alias("piece"), "chrom_a", F.col("pea").alias("start_a"), F.col("start_a").alias("end_a"), "chrom_b", F.when(plus, F.col("peb")).otherwise(F.col("start_b")).alias("start_b"), F.when(plus, F.col("start_b")).otherwise(F.col("peb")).alias("end_b"), F.col("pdir").alias("dir"), F.concat(F.col("blk").cast("string"), F.lit("_gap")).alias("tag"))


def densify(links: DataFrame, *, thr_len: int = 300, step_len: int = 150, dense: bool = True) -> DataFrame:
    """Pieces of each link: links up to thr_len, or all without dense, stay as they are; others are cut into equal
    pieces, the last with the remainder, ascending on both genomes, the minus strand from its far end down."""
    rows = blocks(links)
    la, lb = F.col("end_a") - F.col("start_a"), F.abs(F.col("end_b") - F.col("start_b"))
    cut = (la > thr_len) & F.lit(dense)
    rows = rows.withColumn("k", F.when(cut, F.greatest(F.lit(1).cast("long"), F.floor(la / step_len))).otherwise(F.lit(1).cast("long")))
    rows = rows.withColumn("pa", F.floor(la / F.col("k"))).withColumn("pb", F.floor(lb / F.col("k"))).withColumn("cut", cut)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    i, last = F.col("i"), F.col("i") == F.col("k") - 1
    a0 = F.col("start_a") + i * F.col("pa")
    a1 = F.when(last, F.col("end_a")).otherwise(a0 + F.col("pa"))
    up0 = F.col("start_b") + i * F.col("pb")
    up1 = F.when(last, F.col("end_b")).otherwise(up0 + F.col("pb"))
    down1 = F.col("start_b") - i * F.col("pb")
    down0 = F.when(last, F.col("end_b")).otherwise(down1 - F.col("pb"))
    minus = F.col("dir") < 0
    b0 = F.when(~F.col("cut"), F.col("start_b")).when(minus, down0).otherwise(up0)
    b1 = F.when(~F.col("cut"), F.col("end_b")).when(minus, down1).otherwise(up1)
    return rows.select("blk", (i + 1).cast("int").alias("piece"), "chrom_a", a0.alias("start_a"), a1.alias("end_a"), "chrom_b", b0.alias("start_b"), b1.alias("end_b"), "dir", F.col("blk").cast("string").alias("tag"))


def link_to_mark(links: DataFrame, *, thr_len: int = 300, step_len: int = 150, dense: bool = True, gap: bool = True) -> DataFrame:
    """The mark of a link file; its order is (blk, piece), gaps (piece 0) first."""
    out = densify(links, thr_len=thr_len, step_len=step_len, dense=dense)
    return out.unionByName(gaps(links)) if gap else out


#: Cells of the rough lift.
CELL = 200


def _named(df: DataFrame, fai: DataFrame, chrom: str, out: str) -> DataFrame:
    """df with the ordinal of its chromosome, by its name or by its name without three leading letters; others go."""
    index = fai.select(F.col("chrom").alias("_c"), F.col("ord").alias("_o"))
    short = index.select(F.col("_c").alias("_c2"), F.col("_o").alias("_o2"))
    rows = df.join(F.broadcast(index), F.col(chrom) == F.col("_c"), "left").join(F.broadcast(short), F.expr(f"substr({chrom}, 4)") == F.col("_c2"), "left")  # an index has a row for each chromosome
    return rows.withColumn(out, F.coalesce("_o", "_o2")).where(F.col(out).isNotNull()).drop("_c", "_o", "_c2", "_o2")


def rough_lift(bed: DataFrame, mark: DataFrame, fai_a: DataFrame, fai_b: DataFrame) -> DataFrame:
    """chrom, start, end, name: for each cell of each interval, the cells of genome B that the mark gives."""
    cells = _named(_named(mark, fai_a, "chrom_a", "na"), fai_b, "chrom_b", "nb")
    cell = lambda s, e: F.floor((F.col(s) + F.col(e)) / (2 * CELL))
    cells = cells.select("na", cell("start_a", "end_a").alias("ca"), "nb", cell("start_b", "end_b").alias("cb")).distinct()
    rows = _named(bed, fai_a, "chrom", "na").withColumn("c1", F.floor(F.col("start") / CELL)).withColumn("c2", F.floor(F.col("end") / CELL))
    rows = rows.where("c1 <= c2").withColumn("ca", F.explode(F.sequence("c1", "c2")))
    names = fai_b.select(F.col("ord").alias("nb"), F.col("chrom").alias("to"))
    out = rows.join(cells, ["na", "ca"]).join(F.broadcast(names), "nb")
    return out.select(F.col("to").alias("chrom"), (F.col("cb") * CELL).alias("start"), (F.col("cb") * CELL + CELL - 1).alias("end"), "name")
