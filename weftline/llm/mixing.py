"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are dealt into blocks of ``block_rows``. Weights are taken as exact fractions: with a / A of
the whole (whole numbers, as large as needed), block j of a source may not start before slot floor(j A / a), its
release time, and has to be out by slot ceil((j + 1) A / a), its deadline. Among the released blocks the one with
the earliest deadline takes each slot. As the weights add up to one, all deadlines are met, and after every slot each
source that has blocks left has had its weight's share of the slots with a deviation of less than one block, however
long the schedule.

The blocks that exist are scheduled, over the whole horizon: a row of four numbers for each block, written in
pieces where they are many. A source that has run out leaves its slots empty, which takes nothing from the others'
deadlines: they keep their proportions, every row comes once, and none is dropped or repeated. A row's slot follows from its
rank in its source; ranks come from counts by (source, hash bucket), so a source with a third of all rows is spread
over all buckets, and within a source rows are in hashed order.

Defined results: a null source is a source of its own; sources without a weight (or with 0) have no share, and their
rows come after all others, in equal turns; null ids and repeated rows are scheduled like other rows, in any order where ids
are equal; deadlines that are equal go to the larger share, then to the source that comes first; an empty table gives no
rows; extra columns, whatever their names, stay in mix() and are ignored by schedule(); texts are never looked at, so very
long ones are like others. The number of sources is what the table holds: one small row each on the driver, which makes the
schedule by itself, about half a million blocks a second, and holds a bounded piece of it.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import fresh_path

BLOCK_ROWS = 64
#: Blocks of the schedule that the driver holds at once, and that may be broadcast.
PIECE, MOST_BLOCKS = 1 << 18, 1 << 20
#: Without weights, a source counts with its number of rows to this power.
TEMPERATURE = 0.5


def exact_shares(weights: Mapping) -> dict[object, int]:
    """Whole numbers in exactly the proportions of the weights."""
    parts = {k: Fraction(w) for k, w in weights.items()}
    if any(x < 0 for x in parts.values()):
        raise ValueError("a weight is negative")
    scale = math.lcm(*(x.denominator for x in parts.values()))
    return {k: int(x * scale) for k, x in parts.items()}


def earliest_first(parts: Mapping, blocks: Mapping) -> Iterator[tuple]:
    """(source, block, slot, release, deadline) of so many blocks of each source, by slot: earliest deadline first among
    released blocks, ties to the larger share, then to the earlier source."""
    period = sum(parts.values())
    order = {s: i for i, s in enumerate(parts)}
    waiting = [(0, order[s], s, 0) for s in parts if blocks[s]]  # by release time
    heapq.heapify(waiting)
    ready, slot = [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])  # until then the slots are those of sources that have run out
        while waiting and waiting[0][0] <= slot:
            release, i, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[s]), -parts[s], i, s, j, release))
        deadline, _, i, s, j, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline is missed")
        yield s, j, slot, release, deadline
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * period // parts[s], i, s, j + 1))
        slot += 1


def whole_schedule(weights: Mapping, blocks: Mapping) -> Iterator[tuple]:
    """(source, block, slot, release, deadline) of all blocks by exact weights; then those of sources without weight."""
    parts, end = exact_shares(weights), 0
    for group in ({s: a for s, a in parts.items() if a}, {s: 1 for s, a in parts.items() if not a}):
        start = end
        for s, j, slot, release, deadline in earliest_first(group, blocks):
            end = start + slot + 1
            yield s, j, start + slot, start + release, start + deadline


def _slots(spark: SparkSession, weights: Mapping, blocks: Mapping) -> DataFrame:
    """si (place of the source in weights), j, at, rel, dead of all blocks."""
    names, place = ["si", "j", "at", "rel", "dead"], {s: i for i, s in enumerate(weights)}
    path, held = None, [array("q") for _ in names]

    def piece() -> DataFrame:
        return spark.createDataFrame(pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, held)}))

    for s, *numbers in whole_schedule(weights, blocks):
        for x, value in zip(held, (place[s], *numbers)):
            x.append(value)
        if len(held[0]) == PIECE:
            path = path or fresh_path(spark, "slots")
            piece().write.mode("append").parquet(path)
            held = [array("q") for _ in names]
    if path is None:
        return piece()
    if held[0]:
        piece().write.mode("append").parquet(path)
    return spark.read.schema(", ".join(f"{n} long" for n in names)).parquet(path)


def _scheduled(docs: DataFrame, source: Column, row_id: Column, weights: Mapping | None, block_rows: int) -> DataFrame:
    """docs with _slot, _place, _block, _release and _deadline."""
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.withColumn("_source", source).withColumn("_id", row_id).withColumn("_bucket", F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int"))
    counts = docs.select(source.alias("s"), F.pmod(F.xxhash64(row_id), F.lit(buckets)).cast("int").alias("b")).groupBy("s", "b").agg(F.count("*").alias("n"))
    sizes = {r.s: r.n for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    wanted = {s: weights.get(s, 0) if weights is not None else n**TEMPERATURE for s, n in sorted(sizes.items(), key=lambda x: (x[0] is None, str(x[0])))}
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    table = _slots(spark, wanted, blocks)
    kind = dict(docs.select(source.alias("s")).dtypes)["s"]
    sources = spark.createDataFrame([(s, i) for i, s in enumerate(wanted)], f"s1 {kind}, i1 long")
    before = counts.select("s", "b", (F.sum("n").over(W.partitionBy("s").orderBy("b")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("_source", "_bucket").orderBy("_id")) - 1)
    ranked = ranked.join(before, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_bucket") == F.col("b"))).withColumn("_rank", F.col("before") + F.col("_r")).drop("s", "b", "before", "_r", "_bucket")
    ranked = ranked.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("s1"))).withColumn("_block", F.expr(f"_rank div {block_rows}"))
    table = F.broadcast(table) if sum(blocks.values()) <= MOST_BLOCKS else table
    out = ranked.join(table, (F.col("i1") == F.col("si")) & (F.col("_block") == F.col("j")))
    return out.withColumn("_slot", F.col("at")).withColumn("_release", F.col("rel")).withColumn("_deadline", F.col("dead")).withColumn("_place", F.expr(f"_rank % {block_rows}"))


def schedule(docs: DataFrame, weights: Mapping | None = None, *, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, block, slot, place, release, deadline: rows come in the order of slot, place."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    out = _scheduled(slim, F.col("source"), F.col("doc_id"), weights, block_rows)
    return out.select("doc_id", "source", *(F.col(f"_{c}").alias(c) for c in ("block", "slot", "place", "release", "deadline")))


def mix(docs: DataFrame, weights: Mapping | None = None, *, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of docs with their own columns, in the order of the schedule."""
    names = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(id_col).alias("_key"), F.col(source_col).alias("_from"))
    out = _scheduled(held, F.col("_from"), F.col("_key"), weights, block_rows)
    return out.orderBy("_slot", "_place").select("_row.*")
