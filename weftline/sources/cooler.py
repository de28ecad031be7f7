"""Contact-map containers: a folder with bins and pixels as Parquet, or a .cool file where h5py is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_map(spark: SparkSession, path: str, group: str = "/") -> tuple[DataFrame, DataFrame]:
    """(bins, pixels). bin_id is the row position in a .cool file; Parquet bins carry it."""
    if not path.split("::")[0].endswith((".cool", ".mcool")):
        return spark.read.parquet(f"{path}/bins"), spark.read.parquet(f"{path}/pixels")
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading .cool files needs h5py; a folder with bins and pixels as Parquet does not") from e
    file, _, inner = path.partition("::")
    with h5py.File(file) as f:
        top = f[inner or group]
        names = [x.decode() for x in top["chroms/name"][:]]
        weight = top["bins/weight"][:].astype("float32").tolist() if "weight" in top["bins"] else [None] * len(top["bins/start"])
        rows = zip(range(len(weight)), (names[i] for i in top["bins/chrom"][:]), top["bins/start"][:].tolist(), top["bins/end"][:].tolist(), weight)
        bins = spark.createDataFrame(list(rows), "bin_id int, chrom string, start long, end long, weight float")
        nnz, step = len(top["pixels/count"]), 5_000_000
    where = inner or group

    def chunk(batches):
        import h5py
        import pandas as pd

        for pdf in batches:
            with h5py.File(file) as f:
                p = f[where]["pixels"]
                for a in pdf.id:
                    part = slice(a, a + step)
                    yield pd.DataFrame({"bin1_id": p["bin1_id"][part].astype("int32"), "bin2_id": p["bin2_id"][part].astype("int32"), "count": p["count"][part].astype("float32")})

    starts = spark.range(0, nnz, step, max(1, -(-nnz // step)))
    return bins, starts.mapInPandas(chunk, "bin1_id int, bin2_id int, count float")


def write_map(bins: DataFrame, pixels: DataFrame, path: str, assembly: str | None = None) -> None:
    """bins and pixels as Parquet, with the assembly's name as a column of the bins. A .cool file isn't written."""
    if path.endswith((".cool", ".mcool")):
        raise ValueError(f"{path}: maps are written as folders of Parquet; cooler load makes a .cool file of their rows")
    (bins.withColumn("assembly", F.lit(assembly)) if assembly else bins).write.mode("overwrite").parquet(f"{path}/bins")
    pixels.orderBy("bin1_id", "bin2_id").write.mode("overwrite").parquet(f"{path}/pixels")
