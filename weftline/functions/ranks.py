"""Global numbering without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """df with the 1-based number of each row in the order of (bucket, *order).

    Rows are numbered inside their bucket, and the counts of earlier buckets are added; only
    those counts, a row for each bucket, are summed in one place.
    """
    held = df.withColumn("_bucket", bucket)
    before = held.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = held.withColumn("_r", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)))
    joined = inside.join(before, "_bucket")
    return joined.withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_bucket", "_r", "_before")
