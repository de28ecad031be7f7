"""Contact maps, links and tracks made of the driver's tables, in whole-number arithmetic.

A map has ``n`` bins on four chromosomes; both genomes have the same names in a different order. The number of bins
follows that of the rows of part (see n_bins), and every row of part is a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESOLUTION = 40_000
LEAST_BINS = 200
ORDER_A = ("c2", "c0", "c3", "c1")
ORDER_B = ("c1", "c3", "c0", "c2")
#: Weights by bin % 7: some are invalid on purpose.
WEIGHTS = (0.5, 1.0, 2.0, 0.25, 0.0, -1.0, float("nan"))


def n_bins(spark: SparkSession, sf_dir: str) -> int:
    """As many bins as part has rows, at least 200, on four chromosomes of equal length."""
    return max(LEAST_BINS, spark.read.parquet(f"{sf_dir}/part.parquet").count()) // 4 * 4


def fai(spark: SparkSession, order: tuple[str, ...], n: int) -> DataFrame:
    size = n // 4 * RESOLUTION
    return spark.createDataFrame([(c, i + 1, size) for i, c in enumerate(order)], "chrom string, ord int, size long")


def bins(spark: SparkSession, n: int) -> DataFrame:
    per = n // 4
    at = F.col("id") % per * RESOLUTION
    weights = F.get(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("id") % 7).cast("int"))
    return spark.range(n).select(F.col("id").cast("int").alias("bin_id"), F.concat(F.lit("c"), F.expr(f"id div {per}")).alias("chrom"), at.alias("start"), (at + RESOLUTION).alias("end"), weights.cast("float").alias("weight"))


def pixels(spark: SparkSession, sf_dir: str, genome: int, n: int) -> DataFrame:
    """bin1_id, bin2_id, count of genome 0 or 1."""
    base = F.col("l_partkey") * 7 + F.col("l_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_linenumber") % 2 == genome)
    u, v = base % n, (base + F.col("l_orderkey") * F.col("l_linenumber") % 23) % n
    return rows.groupBy(F.least(u, v).cast("int").alias("bin1_id"), F.greatest(u, v).cast("int").alias("bin2_id")).agg(F.sum("l_quantity").cast("float").alias("count"))


def links(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """line, chrom_a, start_a, end_a, chrom_b, start_b, end_b; every third is on the minus strand."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    per, k, size = n // 4, F.col("p_partkey"), F.col("p_size").cast("long")
    a, b = k * 37 % n, (k * 37 + k % 7 * 3) % n
    length = 200 + size * 2311 % 120_000
    start_a, low = a % per * RESOLUTION + k * 1009 % 20_000, b % per * RESOLUTION + k * 733 % 20_000
    minus = size % 3 == 0
    name = lambda x: F.concat(F.lit("c"), (F.floor(x / per)).cast("string"))
    return part.select(k.alias("line"), name(a).alias("chrom_a"), start_a.alias("start_a"), (start_a + length).alias("end_a"), name(b).alias("chrom_b"), F.when(minus, low + length).otherwise(low).alias("start_b"), F.when(minus, low).otherwise(low + length).alias("end_b"))


def paf(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The links as alignments: an unordered target interval and a strand."""
    link = links(spark, sf_dir, n)
    return link.select("line", F.col("chrom_a").alias("qname"), F.col("start_a").alias("qstart"), F.col("end_a").alias("qend"), F.when(F.col("start_b") > F.col("end_b"), "-").otherwise("+").alias("strand"), F.col("chrom_b").alias("tname"), F.least("start_b", "end_b").alias("tstart"), F.greatest("start_b", "end_b").alias("tend"), ((F.col("end_a") - F.col("start_a")) % 1000).alias("nmatch"))


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, chrom, start, end, name: short intervals from the part keys."""
    s = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    start = k * 7919 % 2_000_000
    return s.select(k.alias("line"), F.concat(F.lit("chrc"), (k % 4).cast("string")).alias("chrom"), start.alias("start"), (start + 100 + k * 131 % 900).alias("end"), F.concat(F.lit("n"), k.cast("string")).alias("name"))
