"""Shared pieces: worker set-up, text helpers, CRC hold-outs."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import fresh_path, written

__all__ = ["SPACES", "clear_name", "fold_of", "fresh_path", "groups", "ready", "sub_batches", "table", "text_or_empty", "tidied", "written"]

#: White space of every word contract: blank, and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"

#: Most rows and bytes of an Arrow batch: documents can be long, and a worker holds a batch with what it makes of it.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
#: Bytes that array code takes at once; a worker holds a few dozen times as many.
SUB_BYTES = 1 << 18


def ready(spark: SparkSession) -> None:
    """Python workers can import this package, and get batches of bounded size; smaller bounds of the session stay."""
    ship(spark)
    for key, most in _LIMITS.items():
        now = spark.conf.get(key).removesuffix("b")  # bytes are given back as such
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives freed memory back to the system, large arrays at once and the rest when its task
    ends: workers outlive their tasks."""

    def outer(batches):
        _libc("mallopt", -3, 4 << 20)  # M_MMAP_THRESHOLD, which would grow otherwise
        yield from run(batches)
        give_back()

    return outer


def give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    _libc("malloc_trim", 0)


def _libc(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL("libc.so.6"), name)(*args)
    except (OSError, AttributeError):
        return  # another C library, which has no such call


def groups(batches: Iterator, keys: int) -> Iterator:
    """(key, table) of each run of equal values in the first so many columns of sorted batches, one run at a time."""
    import numpy as np
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            found = tuple(c[a].item() for c in columns)
            if held and found != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = found
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def clear_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with as many underscores after it as no column of df has, whatever the case."""
    used = {c.lower() for c in df.columns}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def fold_of(col: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % parts


def sub_batches(texts, most_chars: int = SUB_BYTES, most_rows: int = 512):
    """(start, end) ranges of a batch that hold a bounded number of characters, at least one row each."""
    start = chars = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and (chars + n > most_chars or i - start >= most_rows):
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)
