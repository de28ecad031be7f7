"""Nearest neighbours by a block matrix join over int8 product tiles.

1. Vectors are quantised once, to a table of slim rows: int8 codes under a scale of their own, a power of two beside it (so
   that no bound overflows or vanishes), and the exact norm of the error. Of equal vectors only the k + 1 with the least
   ids are candidates, as no other copy can be among the k nearest.
2. Queries and candidates are cut into blocks of a bounded number of rows; each pair of blocks is one tile, to which the
   codes go, not the vectors. Products of int8 vectors give every inner product within an error bound (Cauchy-Schwarz:
   |e_q||y| + |s_q q||e_y|); a candidate whose upper bound lies under the k-th largest lower bound of its query can't be among
   the k nearest and goes. A second look over all tiles of a query drops what only its tile had kept.
3. The survivors are joined to the original vectors and computed again in double precision, summed in the order of the
   components; a heap keeps the k nearest of each query and candidate block, and another merges the blocks.

A query for which very many candidates of a block survive (their bounds can't tell them apart) leaves that block to an
exact pass: there the original vectors of such queries meet the block's. The search is exact.

Defined results: vectors that are null, empty, zero, of another dimension than the most frequent one,
or that hold null or non-finite components take no part, as queries or as candidates; a row with a
null id neither; rows with the query's own id are not its candidates; rows with equal ids and vectors count once, and an id
with several vectors is a query or a candidate by each; ties go to the smaller id; with fewer than k candidates all are
returned; where products overflow, candidates are chosen by their true size, and those chosen are ordered by the score as a
double has it (infinite, or last where it is no number); vectors of any dimension are taken whole, a block of them in a task; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from .common import ready, tidied

QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 32_768
#: Rows of a product that are computed at once.
QUERY_PART, CANDIDATE_PART = 256, 4096
#: int8 products of this many components add up exactly in a float32 matrix product.
EXACT = 1024
#: Candidates of a block that may survive for a query, as a multiple of k; queries with more take the exact pass there.
MOST_SURVIVORS = 32
#: Rows (of hashes and ids) that may be broadcast.
MOST_BROADCAST = 1 << 20


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows; their power of two, and in units of it their scale, norm, norm as quantised, and norm of the error."""
    power = np.frexp(np.abs(x).max(axis=1))[1]
    x = np.ldexp(x, -power[:, None])
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    kept = np.linalg.norm(q.astype(np.float64), axis=1) * scale
    return q, power, scale, np.linalg.norm(x, axis=1), kept, np.linalg.norm(x - q * scale[:, None], axis=1)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 matrices, exact, in double precision if there are many components."""
    if a.shape[1] <= EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T).astype(np.float64) for i in range(0, a.shape[1], EXACT))


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of x and y, summed from the first component to the last."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            out += x[:, j] * y[:, j]
    return out


CODES = "vec_id long, asks boolean, rival boolean, codes binary, power int, scale double, norm double, kept double, error double"


@tidied
def _codes(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        q, power, *numbers = quantised(x)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([row.tobytes() for row in q], pa.binary()), pa.array(power.astype(np.int32)), *map(pa.array, numbers)], names=["vec_id", "asks", "rival", "codes", "power", "scale", "norm", "kept", "error"])


class Block:
    """A block of quantised vectors. most: the largest power of two of all candidates, the unit of products."""

    def __init__(self, pdf: pd.DataFrame, most: int | None = None):
        pdf = pdf.sort_values("vec_id", kind="stable")
        self.ids = pdf.vec_id.to_numpy(np.int64)
        self.q = np.frombuffer(b"".join(pdf.codes), np.int8).reshape(len(pdf), -1)
        shift = pdf.power.to_numpy(np.int64) - most if most is not None else 0
        self.scale, self.norm, self.kept, self.error = (np.ldexp(pdf[c].to_numpy(np.float64), shift) for c in ("scale", "norm", "kept", "error"))


def tile(queries: Block, candidates: Block, k: int):
    """For each query (ids of candidates, lower bounds, upper bounds) of those that may be among its k nearest in the tile."""
    for a in range(0, len(queries.ids), QUERY_PART):
        mine = slice(a, a + QUERY_PART)
        n = len(queries.ids[mine])
        best = np.full((n, k), -np.inf)
        parts: list[list[tuple]] = [[] for _ in range(n)]
        for b in range(0, len(candidates.ids), CANDIDATE_PART):
            theirs = slice(b, b + CANDIDATE_PART)
            about = int8_products(queries.q[mine], candidates.q[theirs]) * queries.scale[mine, None] * candidates.scale[None, theirs]
            slack = queries.error[mine, None] * candidates.norm[None, theirs] + queries.kept[mine, None] * candidates.error[None, theirs]
            slack += 1e-6 * queries.norm[mine, None] * candidates.norm[None, theirs]  # for rounding in the bounds themselves
            own = queries.ids[mine, None] == candidates.ids[None, theirs]
            low, high = np.where(own, -np.inf, about - slack), np.where(own, -np.inf, about + slack)
            both = np.concatenate([best, low], axis=1)
            best = np.partition(both, -k, axis=1)[:, -k:]
            qs, cs = np.nonzero((high >= best.min(axis=1)[:, None]) & ~own)
            cuts = np.searchsorted(qs, np.arange(n + 1))
            for i in range(n):
                if cuts[i] < cuts[i + 1]:
                    c = cs[cuts[i] : cuts[i + 1]]
                    parts[i].append((candidates.ids[theirs][c], low[i, c], high[i, c]))
        for i in range(n):
            if parts[i]:
                ids, low, high = map(np.concatenate, zip(*parts[i]))
                stay = high >= best[i].min()
                yield queries.ids[a + i], ids[stay], low[stay], high[stay]


def sound(vector: Column, dim: Column) -> Column:
    """The vector may take part: dim components, all finite, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(vector) == dim) & fine & F.exists(vector, lambda v: v != 0)


def best_of(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of each query among pairs (query_id, vec_id, score), by a heap."""
    heaps: dict[int, list] = {}
    scores = np.where(np.isnan(pairs.score), -np.inf, pairs.score)
    for q, c, key, s in zip(pairs.query_id.tolist(), pairs.vec_id.tolist(), scores.tolist(), pairs.score.tolist()):
        heap = heaps.setdefault(q, [])
        item = (key, s == s, -c, s)  # what is no number comes after minus infinity
        if len(heap) < k:
            heapq.heappush(heap, item)
        elif item[:3] > heap[0][:3]:
            heapq.heapreplace(heap, item)
    rows = [(q, n + 1, -c, s) for q, heap in heaps.items() for n, (_, _, c, s) in enumerate(sorted(heap, reverse=True, key=lambda x: x[:3]))]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.float64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row."""
    ready(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim, n, n_asks = sizes[0] if sizes else (1, 0, 0)
    rows = rows.where(sound(F.col("x"), F.lit(dim)))
    c_blocks, q_blocks = max(1, math.ceil(n / CANDIDATE_BLOCK)), max(1, math.ceil(n_asks / QUERY_BLOCK))
    # of equal vectors the k + 1 least ids are candidates; the others may ask
    hashed = rows.select("vec_id", "asks", F.struct(F.xxhash64("x"), F.hash("x")).alias("h"), "x")
    often = written(hashed.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > k + 1).select("h"), "often")
    n_often = often.count()
    slim = hashed.withColumn("rival", F.lit(True))
    if n_often:
        bounded = lambda df, n: F.broadcast(df) if n <= MOST_BROADCAST else df
        copies = hashed.select("h", "vec_id").join(bounded(often, n_often), "h", "left_semi").distinct()
        rival = copies.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("h", "vec_id")
        marks = bounded(often.select("h", F.lit(True).alias("many")), n_often)
        slim = hashed.join(marks, "h", "left").join(bounded(rival.withColumn("first", F.lit(True)), n_often * (k + 1)), ["h", "vec_id"], "left").withColumn("rival", F.col("many").isNull() | F.col("first").isNotNull())
    slim = slim.select("vec_id", "asks", "rival", "x").where("asks or rival")
    slim = written(slim, "vectors")
    codes = written(slim.select("vec_id", "asks", "rival", "x").mapInArrow(_codes, CODES), "codes")
    most = codes.where("rival").agg(F.coalesce(F.max("power"), F.lit(0))).first()[0]
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = codes.where("asks").withColumn("c", every(c_blocks)).withColumn("q", block("vec_id", q_blocks))
    asked = codes.where("rival").withColumn("c", block("vec_id", c_blocks)).withColumn("q", every(q_blocks))

    def bounds(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Survivors of a tile; a row without a candidate where a query leaves the block to the exact pass."""
        found: list[pd.DataFrame] = []
        if len(left) and len(right):
            for q, ids, low, high in tile(Block(left), Block(right, most), k):
                many = len(ids) > MOST_SURVIVORS * k
                found.append(pd.DataFrame({"query_id": q, "c": right.c.iloc[0], "vec_id": [None] if many else ids, "low": [None] if many else low, "high": [None] if many else high}))
        return pd.concat(found).astype({"vec_id": "Int64", "low": "Float64", "high": "Float64"}) if found else pd.DataFrame({c: [] for c in ("query_id", "c", "vec_id", "low", "high")})

    kept = written(asking.groupBy("c", "q").cogroup(asked.groupBy("c", "q")).applyInPandas(bounds, "query_id long, c int, vec_id long, low double, high double"), "bounds")

    def among_all(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > k:
            pdf = pdf[pdf.high >= np.partition(pdf.low.to_numpy(), -k)[-k]]
        return pdf[["query_id", "vec_id"]]

    few = kept.where("vec_id is not null").groupBy("query_id").applyInPandas(among_all, "query_id long, vec_id long") if c_blocks > 1 else kept.where("vec_id is not null").select("query_id", "vec_id")
    vector = lambda name, own: slim.select(F.col("vec_id").alias(name), F.col("x").alias(own)).dropDuplicates([name, own])

    def again(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[["query_id", "vec_id"]].assign(score=exact_products(_matrix(pdf.qx), _matrix(pdf.cx)))

    pairs = few.distinct().join(vector("query_id", "qx").join(codes.where("asks").select(F.col("vec_id").alias("query_id")).distinct(), "query_id"), "query_id").join(vector("vec_id", "cx"), "vec_id")
    scored = pairs.mapInPandas(again, "query_id long, vec_id long, score double")

    def whole(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        for a in range(0, len(left) if len(right) else 0, 16):
            qx, qid = _matrix(left.qx.iloc[a : a + 16]), left.query_id.to_numpy()[a : a + 16]
            for b in range(0, len(right), CANDIDATE_PART):
                cx, cid = _matrix(right.cx.iloc[b : b + CANDIDATE_PART]), right.vec_id.to_numpy()[b : b + CANDIDATE_PART]
                for i, q in enumerate(qid):
                    part = pd.DataFrame({"query_id": q, "vec_id": cid, "score": exact_products(np.broadcast_to(qx[i], cx.shape), cx)})
                    found.append(best_of(part[part.vec_id != q], k).drop(columns="rank"))
        return pd.concat(found)

    left_over = kept.where("vec_id is null").select("query_id", "c")
    if not left_over.isEmpty():
        asks = left_over.join(vector("query_id", "qx"), "query_id")
        theirs = slim.where("rival").select("vec_id", F.col("x").alias("cx"), block("vec_id", c_blocks).alias("c"))
        scored = scored.union(asks.groupBy("c").cogroup(theirs.groupBy("c")).applyInPandas(whole, "query_id long, vec_id long, score double"))
    return scored.groupBy("query_id").applyInPandas(lambda pdf: best_of(pdf, k), "query_id long, rank int, vec_id long, score double")
