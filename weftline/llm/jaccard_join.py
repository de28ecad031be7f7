"""N-gram Jaccard join with vertical partitioning.

1. Every document becomes its set of distinct five-word shingles. Equal sets are one class from
   here on, so copies cost nothing more.
2. A global order of shingles: common ones come last, by their count; the others stand in the order of their
   numbers. Counted are those that repeat within a task's share of the corpus, and all shingles of one set in SAMPLED,
   whose counts stand for SAMPLED times as many. Any total order gives right results; this one keeps common
   passages out of prefixes.
3. Two sets that link share shingles of their prefixes (the first n - ceil(0.8 n) + 1 in order), and at least as many as
   their sizes ask for. For each shingle the sets that have it in their prefix are listed by size. The first candidates are
   neighbours in many lists, and each set with the hub of its lists: the set that holds the most common shingles. Of all
   candidates only pairs whose lists meet often enough are checked.
4. Vertical partitioning: the order is cut into fragments, each set into one segment per fragment.
   The overlap of a candidate pair is counted in each fragment separately and summed per pair.
5. Links join sets into components. Then all pairs in a list that are still in different components
   are candidates, whatever their number, if their sizes and the places of a shared shingle leave both sets room for a
   link's overlap (the first shared shingle of a link always does). In each list the sets of its largest
   component only meet those of other components.
6. Links are counted within components. Components of one or two sets need no more; the sets of others are dealt into
   blocks of bounded size, by their own size and a hash, and each pair of blocks of fitting sizes is a tile: fragment by
   fragment, a product of 0-1 matrices adds up the overlaps of all of its pairs. Only a count for each set leaves a tile,
   so a group of near copies is never expanded into pairs.

No link is lost: a link's two sets stand in a common list, so they are in one component after 4, or
are checked in 5. Lists of shingles that very many documents share, sets in very many pairs and tokens with many pairs to
check are spread over tasks by salts.

Defined results: null or empty texts, and texts without words, have no shingles and link with nothing; a
text with fewer words is one shingle; repeated rows and copies get the same class, and link with each other; a null id never
is the least of a class that has another id; ties can't change anything, as ids are the least of sets; empty tables give no
rows; other columns are ignored by near_duplicate_classes() and kept as they are by keep_one(). A very long text is hashed
piece by piece; its set, 8 bytes a shingle, is held by one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import drop_table, forget, fresh_table, release, written
from .common import groups, ready, tidied
from .components import components
from .shingles import digest_of, shingle_sets

FRAGMENTS = 4
#: Shingles counted together before those seen once are left out of the order's counts; one set in so many is counted whole.
SHARE, SAMPLED = 1 << 20, 32
#: The order's common shingles: at least this often, and so many at most (12 bytes each are broadcast).
COMMON, MOST_COMMON = 8, 1 << 20
#: Sets that one list holds before it is salted, and node digests (8 bytes each) that may be broadcast.
LIST, MOST_NODES = 20_000, 1 << 21
#: Sets whose texts are picked out by a broadcast of their hashes (8 bytes each).
MOST_TEXTS = 1 << 20
#: Digests that a task remembers in order to leave out repeats early.
SEEN = 100_000
#: Pairs of one set, and pairs to be looked at for one token, that go to one task; sets spread so that may be broadcast.
HEAVY, LOOKED_AT, MOST_HEAVY = 256, 1 << 20, 1 << 17
#: Sets and shingles of one block of a tile, and shingles of one fragment of it.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 2048


def least_overlap(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


def _records(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


@tidied
def _described(batches):
    """Kind 0: of each document id, digest, size, hash of the text. Kinds 1 and 2: shingles with their counts, of those
    seen twice or more in a share of the task, and of all in sampled sets."""
    held, sampled, n_held = [], [], 0
    names = ["kind", "a", "b", "n", "h"]

    def counted():
        nonlocal held, sampled, n_held
        for kind, least, parts in ((1, 2, held), (2, 1, sampled)):
            values = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            counts = np.diff(at, append=len(values))
            found, counts = values[at[counts >= least]], counts[counts >= least]
            none = np.zeros(len(found), np.int64)
            yield _records(names, np.full(len(found), kind, np.int8), found.view(np.int64), none, counts.astype(np.int32), none)
        held, sampled, n_held = [], [], 0

    for batch in batches:
        ids, digests, sizes = batch.column(0), [], []
        for s in shingle_sets(batch.column(1).to_pylist()):
            digests.append(d := digest_of(s) if len(s) else 0)
            sizes.append(len(s))
            held.append(s)
            if d % SAMPLED == 0:
                sampled.append(s)
            n_held += len(s)
            if n_held >= SHARE:
                yield from counted()
        yield _records(names, np.zeros(len(ids), np.int8), ids, np.array(digests, np.int64), np.array(sizes, np.int32), batch.column(2))
    if held:
        yield from counted()


class Order:
    """The global order: common shingles last, by count; the others by number."""

    def __init__(self, common: np.ndarray, counts: np.ndarray):
        self.common, self.counts = common, counts
        self.near = np.zeros(1 << 22, bool)  # the first 22 bits of common ones
        self.near[(common >> np.uint64(42)).astype(np.int64)] = True

    def count(self, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int32)
        maybe = np.flatnonzero(self.near[(s >> np.uint64(42)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.common, s[maybe]), len(self.common) - 1)
            out[maybe] = np.where(self.common[at] == s[maybe], self.counts[at], 0)
        return out


def _fresh(sets, wanted: np.ndarray | None = None):
    """(digest, set) of each nonempty set that the task doesn't remember, of the wanted ones (sorted) only."""
    seen: set[int] = set()
    for s in sets:
        if not len(s) or (d := digest_of(s)) in seen:
            continue
        if wanted is not None and (not len(wanted) or wanted[min(np.searchsorted(wanted, d), len(wanted) - 1)] != d):
            continue
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(d)
        yield d, s


def _prefixes(order, percent: int):
    def run(batches):
        common = Order(*order.value)
        for batch in batches:
            out = [[], [], [], [], [], []]
            for d, s in _fresh(shingle_sets(batch.column(0).to_pylist())):
                p = len(s) - least_overlap(len(s), percent) + 1
                counts = common.count(s)
                if counts.any():
                    first = np.argsort(counts, kind="stable")[:p]
                    s_p, c_p = s[first], counts[first]
                else:
                    s_p, c_p = s[:p], counts[:p]
                salts = -(-c_p // LIST)
                out[0].append(s_p.view(np.int64))
                out[1].append(np.where(salts > 1, 1 + np.int64(d) % np.maximum(salts, 1).astype(np.int64), 0).astype(np.int32))
                out[2].append(np.full(p, d, np.int64))
                out[3].append(np.full(p, len(s), np.int32))
                out[4].append(np.arange(p, dtype=np.int32))
                out[5].append(np.full(p, counts.mean(), np.float32))
            if out[0]:
                yield _records(["token", "salt", "digest", "n", "pos", "score"], *map(np.concatenate, out))

    return tidied(run)


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64)))


def _segments(order, nodes):
    """Each set's shingles by fragment: quarters of the number range, and the common ones."""

    def run(batches):
        common = Order(*order.value)
        for batch in batches:
            digests, fragments, segments = [], [], []
            for d, s in _fresh(shingle_sets(batch.column(0).to_pylist()), nodes.value if nodes is not None else None):
                often = common.count(s) > 0
                plain = s[~often]
                cuts = np.searchsorted(plain, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(62))
                for f, seg in enumerate([*np.split(plain, cuts), s[often]]):
                    if len(seg):
                        digests.append(d)
                        fragments.append(f)
                        segments.append(seg)
            if digests:
                yield _records(["digest", "fragment", "segment"], np.array(digests, np.int64), np.array(fragments, np.int32), _arrays(segments))

    return tidied(run)


def _whole_sets(nodes):
    def run(batches):
        for batch in batches:
            found = [*_fresh(shingle_sets(batch.column(0).to_pylist()), nodes.value if nodes is not None else None)]
            if found:
                yield _records(["digest", "shingles"], np.array([d for d, _ in found], np.int64), _arrays([s for _, s in found]))

    return tidied(run)


def _heavy(pairs: DataFrame, side: str) -> DataFrame | None:
    """The sets that are one side of more than HEAVY pairs, and over how many tasks they spread."""
    found = written(pairs.groupBy(side).agg(F.count("*").alias("c")).where(F.col("c") > HEAVY).select(side, F.ceil(F.col("c") / HEAVY).cast("int").alias("parts")), "heavy")
    n = found.count()
    return None if not n else F.broadcast(found) if n <= MOST_HEAVY else found


def _with_segments(rows: DataFrame, segments: DataFrame, heavy: DataFrame | None, side: str, on: list[str], value: str) -> DataFrame:
    """rows with the segments of the sets in column side. segments: bucketed as the join needs them."""
    named = segments.withColumnsRenamed({"digest": side, "segment": value})
    if heavy is None:
        return rows.join(named, on)
    few = rows.join(heavy, side).withColumn("salt", F.pmod(F.xxhash64("l", "r"), F.col("parts")).cast("int")).drop("parts")
    many = named.join(heavy, side).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    names = [*rows.columns, *(c for c in named.columns if c not in on)]
    return rows.join(heavy, side, "left_anti").join(named, on).select(*names).union(few.join(many, [*on, "salt"]).select(*names))


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (l, r, nl, nr) that link: overlaps are counted by fragment and summed by pair."""
    rows = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS))))
    rows = _with_segments(rows, segments, _heavy(pairs, "l"), "l", ["l", "fragment"], "ls")
    rows = _with_segments(rows, segments, _heavy(pairs, "r"), "r", ["r", "fragment"], "rs")
    partial = rows.select("l", "r", "nl", "nr", F.size(F.array_intersect("ls", "rs")).alias("overlap"))
    summed = partial.groupBy("l", "r", "nl", "nr").agg(F.sum("overlap").alias("overlap"))
    return summed.where(F.lit(100) * F.col("overlap") >= percent * (F.col("nl") + F.col("nr") - F.col("overlap")))


def _least_shared(percent: int) -> Column:
    """Prefix shingles that the sets of a link share at least (sizes nl <= nr). One of two prefixes ends first in the order;
    what the sets share beyond its end lies in the rest of that set, which has least_overlap(n) - 1 shingles."""
    return F.expr(f"({percent}L * (nl + nr) + {99 + percent}) div {100 + percent} - ({percent}L * nr + 99) div 100 + 1")


def _promising(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (l, r, nl, nr) of the first round: of fitting sizes, and met in a third of the prefix shingles that a link
    shares."""
    return pairs.where(_long_enough(F.col("nl"), F.col("nr"), percent) & (3 * F.col("shared") >= _least_shared(percent))).drop("shared")


def _possible(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs that share as many prefix shingles as a link's sets must. rows: all lists of two sets or more."""
    own = lambda side: rows.select("token", F.col("digest").alias(side))
    shared = pairs.join(own("l"), "l").join(own("r"), ["r", "token"]).groupBy("l", "r", "nl", "nr").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= _least_shared(percent)).drop("shared")


def _texts_of(texts: DataFrame, sets: DataFrame, ids: DataFrame) -> DataFrame:
    """One text of each set in ids, found by the texts' hashes, so that workers only get those; all texts where ids are too
    many for a broadcast."""
    if ids.limit(MOST_TEXTS + 1).count() > MOST_TEXTS:
        return texts
    hashes = sets.join(F.broadcast(ids), "digest").groupBy("digest").agg(F.min("h").alias("h")).select("h")
    return texts.join(F.broadcast(hashes), _text_hash("text") == F.col("h"), "left_semi")


def _few(ids: DataFrame):
    """The sorted values of a column of distinct digests as a broadcast, or None if they are too many."""
    if ids.limit(MOST_NODES + 1).count() > MOST_NODES:
        return None
    return ids.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()["digest"].to_numpy()))


def _segments_of(pairs: DataFrame, texts: DataFrame, sets: DataFrame, order) -> tuple[str, str]:
    """Name and path of a table of the segments of all sets in pairs, bucketed for both of their joins."""
    spark = texts.sparkSession
    ids = written(pairs.select(F.explode(F.array("l", "r")).alias("digest")).distinct(), "ids")
    nodes = _few(ids)
    made = _texts_of(texts, sets, ids).mapInArrow(_segments(order, nodes), "digest long, fragment int, segment array<long>")
    if nodes is None:
        made = made.join(ids, "digest", "left_semi")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name, path = fresh_table(spark, "segments")
    made = made.repartition(buckets, "digest", "fragment").dropDuplicates(["digest", "fragment"])
    made.write.format("parquet").bucketBy(buckets, "digest", "fragment").option("path", path).saveAsTable(name)
    return name, path


def _checked(pairs: DataFrame, texts: DataFrame, sets: DataFrame, order, percent: int) -> DataFrame:
    """The pairs that link, written; their segments are dropped again."""
    spark = texts.sparkSession
    name, path = _segments_of(pairs, texts, sets, order)
    found = written(_linked(pairs, spark.table(name), percent).select("l", "r"), "links")
    drop_table(spark, name, path)
    return found


def _long_enough(small: Column, large: Column, percent: int) -> Column:
    return F.lit(100) * small.cast("long") >= F.lit(percent) * large.cast("long")


def _text_hash(col: str) -> Column:
    return F.xxhash64(F.col(col).cast("string"))


def _classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n, h) of every row of docs, h being the hash of its text; and (digest, root, component_id) of
    every set of shingles."""
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    described = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _text_hash(text_col).alias("h")).mapInArrow(_described, "kind byte, a long, b long, n int, h long"), "described")
    sets = described.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("digest"), "n", "h")
    seen = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    common = described.where("kind > 0").groupBy(F.col("a").alias("token")).agg(seen(1).alias("c"), seen(2).alias("m"))
    common = common.select("token", F.greatest("c", F.when(F.col("m") > 2, F.col("m") * SAMPLED).otherwise(0)).alias("c")).where(F.col("c") >= COMMON)
    top = common.orderBy(F.desc("c"), "token").limit(MOST_COMMON).toArrow()
    values = top["token"].to_numpy().view(np.uint64)
    by_value = np.argsort(values)
    order = spark.sparkContext.broadcast((values[by_value], np.minimum(top["c"].to_numpy(), 2**31 - 1).astype(np.int32)[by_value]))

    # lists of sets by prefix shingle, without lists of one set
    lists = W.partitionBy("token", "salt").orderBy("n", "digest")
    rows = texts.mapInArrow(_prefixes(order, percent), "token long, salt int, digest long, n int, pos int, score float")
    whole = W.partitionBy("token", "salt")
    rows = rows.withColumn("prev", F.lag("digest").over(lists)).withColumn("prev_n", F.lag("n").over(lists)).withColumn("hub", F.max(F.struct("score", "n", "digest")).over(whole))
    several = F.min("digest").over(whole) != F.max("digest").over(whole)
    rows = rows.withColumn("several", several).where((F.col("several") | (F.col("salt") > 0)) & ~F.col("prev").eqNullSafe(F.col("digest")))  # each set once
    rows = written(rows.select("token", "digest", "n", "pos", "salt", "score", "prev", "prev_n", F.col("hub.n").alias("hub_n"), F.col("hub.digest").alias("hub")), "lists")

    # first candidates: neighbours in a list, and every set with the list's hub, the set that holds most common shingles
    heads = rows.where("salt > 0").groupBy("token", "salt").agg(F.min(F.struct("n", "digest")).alias("h"), F.max(F.struct("score", "n", "digest")).alias("t"))
    by_token = W.partitionBy("token").orderBy("h.n", "h.digest")
    top = F.max("t").over(W.partitionBy("token"))
    heads = heads.withColumn("top", top).withColumn("prev", F.lag("h").over(by_token))
    ordered = lambda df, a, an, b, bn: df.where((F.col(a) != F.col(b)) & F.col(a).isNotNull()).select(F.least(F.struct(F.col(an).alias("n"), F.col(a).alias("d")), F.struct(F.col(bn).alias("n"), F.col(b).alias("d"))).alias("x"), F.greatest(F.struct(F.col(an).alias("n"), F.col(a).alias("d")), F.struct(F.col(bn).alias("n"), F.col(b).alias("d"))).alias("y"))
    first = ordered(rows, "prev", "prev_n", "digest", "n").union(ordered(rows, "hub", "hub_n", "digest", "n"))
    first = first.union(ordered(heads, "prev.digest", "prev.n", "h.digest", "h.n")).union(ordered(heads, "top.digest", "top.n", "t.digest", "t.n"))
    first = first.groupBy(F.col("x.d").alias("l"), F.col("y.d").alias("r"), F.col("x.n").alias("nl"), F.col("y.n").alias("nr")).agg(F.count("*").alias("shared"))
    # those that meet in a few lists only are left to the second round
    first = written(_promising(first, percent), "pairs")
    release(spark)
    likely = written(_possible(first, rows, percent), "pairs")
    links = _checked(likely, texts, sets, order, percent)
    linked = components(links)
    release(spark)

    # pairs of lists that are in different components still
    root_of = linked.select(F.col("node").alias("digest"), "root")
    root_of = F.broadcast(root_of) if linked.count() <= MOST_HEAVY else root_of
    members = written(rows.select("token", "digest", "n", "pos").join(root_of, "digest", "left").withColumn("root", F.coalesce("root", "digest")), "members")
    release(spark)
    shares = members.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    parts = F.ceil(F.col("all") * (F.col("all") - F.col("top.c")) / LOOKED_AT).cast("int")
    mixed = members.join(shares.select("token", F.col("top.root").alias("main"), parts.alias("parts")), "token").withColumn("sizes", _size_class("n", percent))
    mixed = written(mixed, "mixed")
    few = mixed.where("root != main").select("token", F.explode(F.expr("sequence(sizes - 1, sizes + 1)")).alias("sizes"), F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"), F.col("digest").alias("d1"), F.col("n").alias("n1"), F.col("pos").alias("pos1"), F.col("root").alias("r1"))
    dealt = mixed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = few.join(dealt, ["token", "sizes", "part"]).where((F.col("r1") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("d1") < F.col("digest"))))
    # the first shingle that a link's sets share leaves them room for their overlap
    met = met.where(F.expr(f"least(n - pos, n1 - pos1) >= ({percent}L * (n + n1) + {99 + percent}) div {100 + percent}"))
    swap = F.col("n1") < F.col("n")
    swap = swap | (F.col("n1") == F.col("n")) & (F.col("d1") < F.col("digest"))
    second = met.select(F.when(swap, F.col("d1")).otherwise(F.col("digest")).alias("l"), F.when(swap, F.col("digest")).otherwise(F.col("d1")).alias("r"), F.least("n", "n1").alias("nl"), F.greatest("n", "n1").alias("nr")).distinct()
    met = written(second.join(first.select("l", "r"), ["l", "r"], "left_anti"), "met")
    second = written(_possible(met, rows, percent), "pairs")
    forget(rows, members, mixed, met, likely)
    release(spark)
    if not second.isEmpty():
        more = _checked(second, texts, sets, order, percent)
        linked = components(more.union(linked))
        forget(more)
    forget(first, second, links)
    release(spark)

    # the least id of each class, back to the rows
    least = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n")).join(linked.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("all"), F.count("*").alias("sets"))
    return sets, _with_roots(written(least, "sets"), roots).select("digest", "root", "component_id", "copies", "n", "all", "sets")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with what roots has of their components. Those of many sets, of which there are few, are broadcast."""
    many = written(roots.where(F.col("sets") > HEAVY), "roots")
    if not (n := many.count()):
        return rows.join(roots, "root")
    large = F.broadcast(many) if n <= MOST_HEAVY else many
    return rows.join(large, "root").union(rows.join(large.select("root"), "root", "left_anti").join(roots.where(F.col("sets") <= HEAVY), "root"))


def _size_class(n: str, percent: int) -> Column:
    """Sets that link are of one class or of neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / math.log(100 / percent)).cast("int")


def _tiles(percent: int):
    """(digest, linked): the copies of the sets that link with a set within a tile."""

    def overlaps(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(cols)), np.float32)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.concatenate([[True], values[1:] != values[:-1]])
        shared = np.diff(np.flatnonzero(new), append=len(values)) > 1
        column = np.cumsum(shared) - 1
        kept = shared[group := np.cumsum(new) - 1]
        owner, group = owner[kept], column[group[kept]]
        place = np.full((2, len(sets)), -1)
        place[0, rows], place[1, cols] = np.arange(len(rows)), np.arange(len(cols))
        for a in range(0, int(shared.sum()), COLUMNS):  # a fragment of the order
            lo, hi = np.searchsorted(group, (a, a + COLUMNS))
            sides = []
            for k, n in ((0, len(rows)), (1, len(cols))):
                m, at = np.zeros((n, COLUMNS), np.float32), place[k, owner[lo:hi]]
                m[at[at >= 0], group[lo:hi][at >= 0] - a] = 1
                sides.append(m)
            out += sides[0] @ sides[1].T
        return out

    def run(batches):
        for _, t in groups(batches, 5):
            side, digest, n, copies = (t[c].to_numpy() for c in ("side", "digest", "n", "copies"))
            sets = [np.asarray(x.values.to_numpy(), np.int64) for x in t["shingles"]]
            rows, cols = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            inner = bool((side == 2).any())
            total = np.zeros(len(sets), np.int64)
            # very many small sets are met part by part
            for a in range(0, len(rows), BLOCK_SETS):
                for b in range(0, len(cols), BLOCK_SETS):
                    i, j = rows[a : a + BLOCK_SETS], cols[b : b + BLOCK_SETS]
                    both = np.union1d(i, j)
                    o = overlaps([sets[k] for k in both], np.searchsorted(both, i), np.searchsorted(both, j))
                    links = 100 * o >= percent * (n[i][:, None] + n[j][None, :] - o)
                    if inner:
                        links &= i[:, None] != j[None, :]
                    total[i] += links @ copies[j]
                    if not inner:
                        total[j] += links.T @ copies[i]
            yield _records(["digest", "linked"], digest, total)

    return tidied(run)


def _link_counts(classes: DataFrame, texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(digest, linked) of the sets in components of three sets or more. classes: a written table."""
    spark = texts.sparkSession
    own = classes.where("sets > 2").select("digest", "root", "copies", "n", _size_class("n", percent).alias("s"))
    sizes = own.groupBy("root", "s").agg(F.sum("n").alias("shingles"), F.count("*").alias("c")).withColumn("k", F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("c") / BLOCK_SETS)).cast("int"))
    # components of one block; those of several, of which there are few: sets are dealt out by class and hash
    per = sizes.groupBy("root").agg(F.sum("shingles").alias("shingles"), F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("s", "k"))).alias("ks"))
    several = written(per.where((F.col("shingles") > BLOCK_SHINGLES) | (F.col("c") > BLOCK_SETS)).select("root", "ks"), "components")
    several_too = F.broadcast(several) if several.count() <= MOST_HEAVY else several
    k = lambda s: F.coalesce(F.try_element_at("ks", s), F.lit(0))
    dealt = own.join(several_too, "root", "left").withColumn("h", F.when(F.col("ks").isNotNull(), F.pmod(F.xxhash64("digest"), k(F.col("s"))).cast("int")))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda s1, k1, s2, k2, side: F.struct(s1.alias("s1"), k1.alias("k1"), s2.alias("s2"), k2.alias("k2"), F.lit(side).cast("byte").alias("side"))
    s, h = F.col("s"), F.col("h")
    within = F.transform(upto(k(s)), lambda x: F.when(x == h, tile(s, h, s, h, 2)).when(x > h, tile(s, h, s, x, 0)).otherwise(tile(s, x, s, h, 1)))
    none = F.array().cast("array<struct<s1:int,k1:int,s2:int,k2:int,side:tinyint>>")
    above = F.when(k(s + 1) > 0, F.transform(upto(k(s + 1)), lambda x: tile(s, h, s + 1, x, 0))).otherwise(none)
    below = F.when(k(s - 1) > 0, F.transform(upto(k(s - 1)), lambda x: tile(s - 1, x, s, h, 1))).otherwise(none)
    zero = F.lit(0)
    tiles = F.when(F.col("ks").isNull(), F.array(tile(zero, zero, zero, zero, 2))).otherwise(F.concat(within, above, below))
    dealt = dealt.select("root", "digest", "n", "copies", F.explode(tiles).alias("t")).select("root", "t.*", "digest", "n", "copies")
    ids = own.select("digest")
    whole = _texts_of(texts, sets, ids).mapInArrow(_whole_sets(_few(ids)), "digest long, shingles array<long>")
    joined = dealt.join(whole.dropDuplicates(["digest"]), "digest").select("root", "s1", "k1", "s2", "k2", "side", "digest", "n", "copies", "shingles")
    keys = ["root", "s1", "k1", "s2", "k2"]
    held = joined.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).sortWithinPartitions(*keys)
    return held.mapInArrow(_tiles(percent), "digest long, linked long").groupBy("digest").agg(F.sum("linked").alias("linked"))


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) and n_links (of other rows) of every row of docs."""
    sets, classes = _classes(docs, id_col=id_col, text_col=text_col, percent=percent)
    classes = written(classes, "classes")
    counts = _link_counts(classes, docs.select(F.col(text_col).cast("string").alias("text")), sets, percent)
    # one or two sets: all rows of the component link with each other
    linked = F.col("copies") - 1 + F.when(F.col("sets") <= 2, F.col("all") - F.col("copies")).otherwise(F.coalesce("linked", F.lit(0)))
    classes = classes.join(counts, "digest", "left").select("digest", "component_id", linked.cast("long").alias("n_links"))
    back = sets.where("n > 0").join(classes, "digest").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")
    zero = F.lit(0).cast("long")
    return back.union(sets.where("n = 0").select("doc_id", zero, "doc_id", zero))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs of which one of each class of near duplicates stays: that with the least id, a null id
    last; of rows with one id, that with the least hash of its text, and of rows with equal ids and texts any one.

    Documents without shingles all stay.
    """
    sets, classes = _classes(docs, id_col=id_col, text_col=text_col, **options)
    # rows with equal ids and texts are one row from here on
    rows = sets.groupBy("doc_id", "h").agg(F.count("*").alias("times"), F.first("digest").alias("digest"), F.first("n").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "times"))
    ones = rows.where("n > 0").join(classes, "digest").groupBy("root").agg(first.alias("r")).select("r.doc_id", "r.h", (F.col("r.times") > 1).alias("again"))
    stay = written(ones.union(rows.where("n = 0").select("doc_id", "h", F.lit(False))).toDF("_id", "_h", "_again"), "stay")
    names = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(id_col).cast("long").alias("_key"), _text_hash(text_col).alias("_hash"))
    kept = held.join(stay, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")))
    once = kept.where("not _again").select("_row")
    if not stay.where("_again").isEmpty():
        once = once.union(kept.where("_again").groupBy("_id", "_h").agg(F.first("_row").alias("_row")).select("_row"))
    return once.select("_row.*")
