"""Readers and writers of the tab-delimited formats.

Lines that a tolerant reader can't parse are dropped; strict readers fail on them. Order is part of
several formats, so readers give every row a sortable ``line`` column: (file, block start, row).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import numbered

#: Fixed column names of the 14-column contact format and of the 16-column lifted format.
CONTACT_COLUMNS = "chrom1 start1 end1 bin1 chrom2 start2 end2 bin2 rank strict weak cov1 cov2 dist_bins".split()
LIFT_COLUMNS = (
    "chr1_observed pos1_observed chr2_observed pos2_observed remap1_control remap2_control observed_contacts control_contacts "
    "observed_deviations control_deviations observed_coverages_pos1 observed_coverages_pos2 control_coverages_pos1 "
    "control_coverages_pos2 control_contact_distances remapping_coverages"
).split()


def lines(spark: SparkSession, path: str) -> DataFrame:
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return spark.read.text(path).select(F.col("value"), order.alias("line"))


def placed(rows: DataFrame) -> DataFrame:
    """rows with place, their number from 1 in the order of files and lines, instead of line."""
    return numbered(rows, F.struct("line.file_path", "line.file_block_start"), [F.col("line")], "place").drop("line")


def tokens(df: DataFrame, sep: str = r"\s+") -> DataFrame:
    return df.withColumn("t", F.split(F.trim(F.translate("value", "\t\r", "  ")) if sep == r"\s+" else F.col("value"), sep))


def token(i: int, kind: str | None = None) -> Column:
    got = F.get("t", F.lit(i))
    return got.try_cast(kind) if kind else got


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """chrom, ord, size: ord is the physical line number from 1, blank lines counted; the last of equal names wins."""
    rows = tokens(lines(spark, path)).withColumn("ord", F.row_number().over(W.orderBy("line")))  # a small index file
    rows = rows.where("value rlike '\\\\S'").select(token(0).alias("chrom"), "ord", token(1, "long").alias("size"))
    return rows.groupBy("chrom").agg(F.max("ord").alias("ord"), F.max_by("size", "ord").alias("size"))


def read_link(spark: SparkSession, path: str) -> DataFrame:
    rows = tokens(lines(spark, path)).where("size(t) >= 6")
    out = rows.select("line", token(0).alias("chrom_a"), token(1, "long").alias("start_a"), token(2, "long").alias("end_a"), token(3).alias("chrom_b"), token(4, "long").alias("start_b"), token(5, "long").alias("end_b"))
    return out.dropna(subset=["start_a", "end_a", "start_b", "end_b"])


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    rows = tokens(lines(spark, path), "\t").where("size(t) >= 12")
    out = rows.select("line", token(0).alias("qname"), token(2, "long").alias("qstart"), token(3, "long").alias("qend"), token(4).alias("strand"), token(5).alias("tname"), token(7, "long").alias("tstart"), token(8, "long").alias("tend"), token(9, "long").alias("nmatch"))
    return out.dropna(subset=["qstart", "qend", "tstart", "tend", "nmatch"])


def read_mark(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Mark rows; the strict reader, that of the contact lift, fails where a coordinate is no number."""
    rows = tokens(lines(spark, path)).where("size(t) >= 6")
    number = (lambda i: token(i).cast("long")) if strict else (lambda i: token(i, "long"))
    out = rows.select("line", token(0).alias("chrom_a"), number(1).alias("start_a"), number(2).alias("end_a"), token(3).alias("chrom_b"), number(4).alias("start_b"), number(5).alias("end_b"), token(6, "int").alias("dir"), token(7).alias("tag"))
    return out if strict else out.dropna(subset=["start_a", "end_a", "start_b", "end_b"])


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    rows = tokens(lines(spark, path)).where("size(t) >= 3")
    out = rows.select("line", token(0).alias("chrom"), token(1, "long").alias("start"), token(2, "long").alias("end"), F.coalesce(token(3), F.lit(".")).alias("name"))
    return out.dropna(subset=["start", "end"])


def read_bed_midpoints(spark: SparkSession, path: str, chrom: str, start: int, end: int, *, use_midpoint: bool = True) -> DataFrame:
    """Midpoints (or starts) of one chromosome's records in [start, end), sorted; lines that begin with #, t or b and lines
    of less than three fields are no records."""
    rows = tokens(lines(spark, path)).where("size(t) >= 3 and substr(value, 1, 1) not in ('#', 't', 'b')")
    x = F.floor((token(1, "long") + token(2, "long")) / 2) if use_midpoint else token(1, "long")
    return rows.where(token(0) == chrom).select(x.cast("long").alias("x")).where((F.col("x") >= start) & (F.col("x") < end)).orderBy("x")


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    rows = tokens(lines(spark, path)).where("size(t) >= 4 and substr(value, 1, 1) != '#'")
    return rows.select("line", token(0).alias("chrom"), token(1, "long").alias("start"), token(2, "long").alias("end"), token(3, "double").alias("value"))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Contacts in the 14-column format, with a header; fails on the short format."""
    head = [r.value.split() for r in spark.read.text(path).limit(2).collect()]
    if len(head) > 1 and (len(head[1]) < 2 or all(x.lstrip("-").isdigit() for x in head[1][:2])):
        raise ValueError(f"{path} is not in the 14-column contact format")
    kinds = dict(zip(CONTACT_COLUMNS, "string long long int string long long int int int int float float int".split()))
    rows = tokens(lines(spark, path), "\t").where(token(0) != "chrom1")
    return rows.select("line", *(token(i).cast(kinds[c]).alias(c) for i, c in enumerate(CONTACT_COLUMNS)))


def read_lift(spark: SparkSession, path: str) -> DataFrame:
    """Lifted contacts; rows without 16 tokens or with odd numbers are dropped."""
    kinds = dict(zip(LIFT_COLUMNS, "string long string long string string double double double double double double double double double double".split()))
    rows = tokens(lines(spark, path)).where("size(t) >= 16")
    out = rows.select("line", *(token(i, kinds[c]).alias(c) for i, c in enumerate(LIFT_COLUMNS)))
    return out.dropna(subset=["pos1_observed", "pos2_observed", "observed_contacts", "control_contacts"])


def formatted(pattern: str, col: Column | str) -> Column:
    """A number by one of Python's patterns, which the JVM's %g and %f round and pad differently."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else format(v, pattern))

    return F.pandas_udf(run, "string")(F.col(col).cast("double") if isinstance(col, str) else col.cast("double"))


def write_rows(df: DataFrame, path: str, *, header: bool = False) -> None:
    """Tab-separated text; the order of df's partitions is the order of the files."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("emptyValue", "").option("quote", "").csv(path)


def write_contacts(df: DataFrame, path: str) -> None:
    ordered = df.orderBy(F.col("dist_bins") == -1, "dist_bins", "bin1", "bin2")
    write_rows(ordered.select(*(formatted(".6g", c).alias(c) if c in ("cov1", "cov2") else F.col(c) for c in CONTACT_COLUMNS)), path, header=True)


def write_mark(df: DataFrame, path: str) -> None:
    write_rows(df.orderBy("blk", "piece").drop("blk", "piece"), path)


def write_stat(df: DataFrame, path: str) -> None:
    order = F.array_position(F.array(*map(F.lit, ("all", "remappable", "processed", "unique", "duplicated", "dropped"))), "name")
    df.orderBy(order).coalesce(1).write.mode("overwrite").option("sep", " ").csv(path)  # six rows


def read_stat(spark: SparkSession, path: str) -> DataFrame:
    return tokens(lines(spark, path)).select("line", token(0).alias("name"), token(1, "long").alias("contacts"), token(2, "long").alias("bins"))


def write_lift(df: DataFrame, path: str) -> None:
    """df must come from operators.lift.lift_rows: its line column holds the order."""
    shown = {"control_contact_distances": ".2f", "remapping_coverages": ".5f"}
    write_rows(df.orderBy("line").select(*(formatted(shown[c], c).alias(c) if c in shown else F.col(c) for c in LIFT_COLUMNS)), path, header=True)
