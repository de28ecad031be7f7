"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The setting spark.checkpoint.dir, which a cluster always names.

    Where it is absent on one machine (local tests) a temporary folder is made and set; elsewhere that is an error, as other
    machines would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; removed when the driver ends."""
    path = f"{shared_folder(spark)}/weftline/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh_table(spark: SparkSession, label: str) -> tuple[str, str]:
    """A new table name and its path; the table goes, too, when the driver ends."""
    name = f"weft_{label}_{uuid.uuid4().hex}"
    path = fresh_path(spark, label)
    _tables.append((spark, name))
    return name, path


def drop_table(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    drop_path(spark, path)


def _clean() -> None:
    for spark, name in _tables:
        with suppress(Exception):  # the session has ended already, or a table can't be dropped
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for spark, path in _made:
        with suppress(Exception):
            drop_path(spark, path)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage is cut there, and a lost executor costs no recomputation.
    options: of the table's writer."""
    return written_in_turn([df], label, **options)


def written_in_turn(parts: Sequence[DataFrame], label: str, **options: str) -> DataFrame:
    """The rows of all parts, which have one schema, as one table: one part is written after another, and the shuffle files
    of each can go before the next begins."""
    spark = parts[0].sparkSession
    path = fresh_path(spark, label)
    for k, df in enumerate(parts):
        if k:
            release(spark)
        df.write.mode("append").options(**options).parquet(path)
    out = spark.read.schema(parts[0].schema).parquet(path)
    out._written_at = path
    return out


#: For tables that are large and read a few times: about two thirds of the default's bytes.
TIGHT = {"compression": "zstd"}


def forget(*tables: DataFrame) -> None:
    """Removes tables that written() made, once nothing that is still to run reads them."""
    for df in tables:
        drop_path(df.sparkSession, df._written_at)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished queries that nothing refers to any more; it does so when the driver
    collects its garbage, which may not be for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
