"""Variable-capacity best-fit packing over the histogram of lengths.

Pieces of equal length are interchangeable, so best-fit decreasing runs over the histogram of lengths
(at most as many rows as the largest capacity) for any number of documents: whole intervals of equal
bins take whole intervals of equal pieces. Where no open bin fits, the capacity is opened that costs
least per token when it is filled greedily from the lengths that are left, all permitted capacities
compared; at the end every bin becomes the smallest permitted size that holds its contents. The plan is
a short table of intervals; pieces find their places by their rank among pieces of their length.

Pieces of a length come in the order of the table's rows (file by file; rows that come from no file in hashed order of
their ids), and bins are numbered by their first piece in that order, so a mixture that the rows' order states holds in
the sequences too. Ranks come from counts by (length, bucket), a bucket being a file or a hash, so a length that a third of
all pieces have is spread over all buckets. Documents longer than the largest capacity are cut into pieces of that size and
a rest. Texts are read once: their lengths are written as slim rows.

Defined results: a null text has no words and so the length 1 (its end mark); a document whose given length is null or
below 1 takes no room: it gets one row of length 0 without a bin; null ids, ties of length and repeated
rows are packed like any other row; very long texts become as many pieces as they need; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import numbered
from ..storage import written
from .common import SPACES, ready, text_or_empty

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs beside its tokens.
OVERHEAD = 32


@dataclass
class Bins:
    """Bins first .. first + n - 1, of equal capacity and contents."""

    first: int
    n: int
    capacity: int
    fill: int


@dataclass
class Plan:
    """placed: rows (length, first rank, pieces, first bin, pieces per bin, fill before); bins: rows
    (first bin, bins, final capacity, fill)."""

    placed: np.ndarray
    bins: np.ndarray


def fitting(capacities: Sequence[int], content: int) -> int:
    return capacities[bisect_left(capacities, content)]


def best_opening(left: dict[int, int], lengths: list[int], first: int, capacities: Sequence[int], costs: Mapping[int, float]):
    """(capacity, {length: pieces}) of the bin that costs least per token, holding first."""
    best = None
    for c in capacities[bisect_left(capacities, first) :]:
        content, taken, top = 0, {}, bisect_right(lengths, first)
        while content < c and (top := bisect_right(lengths, c - content, 0, top)):
            length = lengths[top - 1]
            t = min(left[length], (c - content) // length)
            taken[length] = t
            content += t * length
            top -= 1
        price = costs[fitting(capacities, content)] / content
        if best is None or price < best[0] - 1e-12:
            best = price, c, taken
    return best[1], best[2]


def plan(histogram: Mapping[int, int], capacities: Sequence[int] = CAPACITIES, costs: Mapping[int, float] | None = None) -> Plan:
    """Best-fit decreasing of all pieces; lengths must be at least 1 and at most the largest capacity."""
    capacities = sorted(capacities)
    costs = costs or {c: c + OVERHEAD for c in capacities}
    left = {length: n for length, n in histogram.items() if n > 0}  # not yet promised to an open bin
    lengths = sorted(left)
    open_bins: dict[int, list[Bins]] = {}
    residuals: list[int] = []
    placed, total = [], 0

    def put(bins: Bins) -> None:
        r = bins.capacity - bins.fill
        if r not in open_bins:
            open_bins[r] = []
            insort(residuals, r)
        open_bins[r].append(bins)

    def promise(length: int, n: int) -> None:
        left[length] -= n
        if left[length] <= 0:
            del left[length]
            del lengths[bisect_left(lengths, length)]

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while n > 0:
            at = bisect_left(residuals, length)
            if at == len(residuals):
                if length not in left:
                    insort(lengths, length)
                left[length] = n
                capacity, taken = best_opening(left, lengths, length, capacities, costs)
                k = max(1, min(min(left[x] // t for x, t in taken.items()), -(-n // taken[length])))
                for x, t in taken.items():
                    promise(x, min(left[x], k * t))
                put(Bins(total, k, capacity, 0))
                total += k
                continue
            r = residuals[at]
            bins = open_bins[r].pop()
            if not open_bins[r]:
                del open_bins[r]
                del residuals[at]
            each = min(r // length, n)
            k = min(bins.n, n // each)
            placed.append((length, rank, k * each, bins.first, each, bins.fill))
            rank, n = rank + k * each, n - k * each
            if bins.n > k:
                put(Bins(bins.first + k, bins.n - k, bins.capacity, bins.fill))
            put(Bins(bins.first, k, bins.capacity, bins.fill + each * length))
        if length in left:
            promise(length, left[length])
    ended = sorted((b.first, b.n, fitting(capacities, b.fill), b.fill) for group in open_bins.values() for b in group if b.fill)
    return Plan(np.array(sorted(placed), np.int64).reshape(-1, 6), np.array(ended, np.int64).reshape(-1, 4))


def word_length(text_col: str = "text") -> Column:
    """Words and an end mark, without taking the words apart: starts of words are counted."""
    text = text_or_empty(text_col)
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.size(F.filter(F.split(text, " "), lambda w: w != "")) + 1


def _order(docs: DataFrame, key: Column, buckets: int) -> tuple[Column, Column]:
    """The file and the row of each row of a table that is read from files, else a bucket and the hash of the key."""
    if "_metadata" not in docs.columns:
        try:
            at = F.col("_metadata.file_name"), F.col("_metadata.row_index")
            docs.select(*at).schema
            return at
        except AnalysisException:
            pass  # rows of no file, or of a file without numbered rows
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"), F.xxhash64(key, F.lit(1))


def pack(docs: DataFrame, length: Column | None = None, *, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES, costs: Mapping[int, float] | None = None) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset, bin_capacity, bin_fill of every piece, and sequence: the bin's
    number, from 1, in the order of the bins' first pieces. length: of each document, else its words and an end mark."""
    spark = docs.sparkSession
    ready(spark)
    capacities = sorted(capacities)
    most = capacities[-1]
    file, row = _order(docs, F.col(id_col), max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce((length if length is not None else word_length()).cast("long"), F.lit(0)).alias("whole"), file.alias("bucket"), row.alias("row"))
    whole = written(whole, "lengths")
    pieces = whole.where("whole > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(whole - 1) div {most}"))))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("whole") - F.col("piece") * most).cast("int").alias("length"), "bucket", "row")
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `most` rows
    made = plan(histogram, capacities, costs)
    sent = spark.sparkContext.broadcast((made.placed, made.bins))
    before = counts.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("r", F.row_number().over(W.partitionBy("length", "bucket").orderBy("row", "doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", (F.col("before") + F.col("r")).alias("rank"), "bucket", "row")

    @F.pandas_udf("bin_id long, bin_offset long, bin_capacity int, bin_fill int")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        placed, bins = sent.value
        lengths, ranks = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        row = np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            own = lengths == length
            a, b = np.searchsorted(placed[:, 0], (length, length + 1))
            row[own] = a + np.searchsorted(placed[a:b, 1], ranks[own], side="right") - 1
        _, lo, _, bin_lo, each, fill = placed[row].T
        bin_id = bin_lo + (ranks - lo) // each
        offset = fill + (ranks - lo) % each * lengths
        end = np.searchsorted(bins[:, 0], bin_id, side="right") - 1
        return pd.DataFrame({"bin_id": bin_id, "bin_offset": offset, "bin_capacity": bins[end, 2], "bin_fill": bins[end, 3]})

    placed = written(ranked.withColumn("p", place("length", "rank")).select("doc_id", "piece", "start", "length", "p.*", "bucket", "row"), "placed")
    first = placed.groupBy("bin_id").agg(F.min(F.struct("bucket", "row")).alias("at")).select("bin_id", "at.*")
    sequences = numbered(first, F.col("bucket"), [F.col("row"), F.col("bin_id")], "sequence").select("bin_id", "sequence")
    out = placed.drop("bucket", "row").join(sequences, "bin_id").select("doc_id", "piece", "start", "length", "bin_id", "bin_offset", "bin_capacity", "bin_fill", "sequence")
    zero, none = F.lit(0), lambda kind: F.lit(None).cast(kind)
    return out.union(whole.where("whole <= 0").select("doc_id", zero.cast("long"), zero.cast("long"), zero, none("long"), none("long"), none("int"), none("int"), none("long")))
