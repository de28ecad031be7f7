"""Context-tree weighting over bytes, and a word-count score beside it.

A text is its UTF-8 bytes with A-Z lowered, ended by the byte 0xFF, which UTF-8 never holds and which also
stands before the text as its context. A byte is eight binary decisions; each decision has a tree of
the contexts of 0 to DEPTH bytes before. Every tree node has a Krichevsky-Trofimov estimate of its counts,
and the weighted probability of a node is half its own estimate plus half the product of its children's. With the
training counts, predictions mix the estimates of all depths by these weights; the sum of their logarithms is the
text's code length.

All counts of all training documents are kept, at any size of the corpus:

1. One pass over the texts counts runs of DEPTH + 1 bytes and words in every task. Counts go to the other tasks in
   blobs of sorted numbers, dealt out by a hash of the two bytes nearest to the predicted one (words: by their number).
2. A part holds whole subtrees from depth 2 on, so it is weighted by itself, from the deepest nodes up. Sums over
   parts, at most 65,280 rows, give depths 1 and 0 on the driver. From these every part computes the probability of each
   of its runs, downwards; runs that only unseen texts hold get theirs from the deepest nodes that exist.
3. A second pass over the texts sums these values. Those of the CACHED most frequent runs (and words) are broadcast,
   as a cache only: all other runs and words of a text go through a join with the tables of all values.

Words are compared by 64-bit numbers; two different ones share a number with probability 2**-64. Rows are numbered in the
second pass, so repeated rows don't mix.

Defined results: a null text is empty and has its end only; a null id has the remainder of the empty text; repeated rows each
get their own row, with equal scores; without training rows every count is 0 and each bit has probability 1/2; ties of
frequency only decide what is cached; very long texts are taken whole, in about forty bytes of memory for each of
their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, ready, sub_batches, tidied, written
from .shingles import joined, words_in

DEPTH = 6
#: Runs and words whose values are broadcast (about 24 bytes each): a cache, which no result depends on.
CACHED, CACHED_WORDS = 1 << 21, 1 << 17
#: Runs and words that a task holds before it sends their counts on, and parts that they are dealt into.
HELD, PARTS = 1 << 21, 512
#: Numbers of a part that wait at least, before they are merged.
WAITING = 1 << 17
END = 0xFF
#: The number of a text's end among words.
END_WORD = np.uint64(0x9B05688C2B3E6C1F)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of DEPTH + 1 bytes that end at each byte of the texts and at their ends, where each text's
    runs begin, and how many it has."""
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), np.uint8)
    n = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(n + DEPTH) - n
    runs = np.zeros(len(data) - DEPTH, np.uint64)
    for j in range(DEPTH + 1):
        runs <<= _U(8)
        runs |= data[j : len(data) - DEPTH + j]
    keep = np.ones(len(data), bool)
    for j in range(1, DEPTH + 1):
        keep[starts - j] = False
    return runs[keep[DEPTH:]], np.cumsum(n) - n, n


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the texts and their ends, and the text of each."""
    data, stops = joined(texts)
    numbers, starts, _ = words_in(data)
    own = np.searchsorted(stops, starts, side="right")
    return np.concatenate([numbers, np.full(len(texts), END_WORD)]), np.concatenate([own, np.arange(len(texts))])


def _runs_of(values: np.ndarray) -> np.ndarray:
    """Where each of equal neighbours begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _lowered(texts) -> list[bytes]:
    return [(t or "").encode("utf-8").lower() for t in texts]


class Counts:
    """Counts of 64-bit numbers, for training and in all: sorted, in bounded memory. kind: int32 where they are of one task."""

    def __init__(self, kind=np.int64):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.keys, self.n, self.m = np.zeros(0, np.uint64), np.zeros(0, self.kind), np.zeros(0, self.kind)
        self.raw: list[tuple[np.ndarray, bool]] = []
        self.n_raw = 0

    def add(self, numbers: np.ndarray, training: bool) -> None:
        self.raw.append((numbers, training))
        self.n_raw += len(numbers)
        if self.n_raw >= HELD:
            self.settle()

    def settle(self) -> None:
        for training in (True, False):
            parts = [x for x, t in self.raw if t == training]
            if parts:
                values = np.concatenate(parts)
                values.sort()
                at = _runs_of(values)
                c = np.diff(at, append=len(values)).astype(self.kind)
                self.merge(values[at], c if training else np.zeros(len(c), self.kind), c)
        self.raw, self.n_raw = [], 0

    def merge(self, keys: np.ndarray, n: np.ndarray, m: np.ndarray) -> None:
        """keys: sorted, each once."""
        if len(self.keys):
            self.merge_all([(keys, n, m)])
        else:
            self.keys, self.n, self.m = keys, n, m

    def merge_all(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        if not parts:
            return
        keys, n, m = (np.concatenate(x) for x in zip((self.keys, self.n, self.m), *parts))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = _runs_of(keys)
        self.keys, self.n, self.m = keys[at], np.add.reduceat(n[order], at, dtype=self.kind), np.add.reduceat(m[order], at, dtype=self.kind)


def part_of(keys: np.ndarray, grams: bool) -> np.ndarray:
    """Runs whose two bytes before the last are the same are in one part."""
    near = (keys >> _U(8)) & _U(0xFFFF) if grams else keys
    return ((near + _U(1)) * _GOLDEN >> _U(40)).astype(np.int64) % PARTS


BLOBS = "kind byte, part int, keys binary, n binary, m binary"


def _blobs(kind: int, counts: Counts):
    """The counts as rows of a part each."""
    counts.settle()
    if not len(counts.keys):
        return
    parts = part_of(counts.keys, kind == 0)
    order = np.argsort(parts, kind="stable")
    at = _runs_of(parts[order])
    cuts = [*at.tolist(), len(order)]
    columns = [[x[order[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])] for x in (counts.keys, counts.n)]
    columns.append([counts.m[order[a:b]].tobytes() if kind == 0 else None for a, b in zip(cuts, cuts[1:])])  # all words are for training
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int8)), pa.array(parts[order[at]].astype(np.int32)), *(pa.array(x, pa.binary()) for x in columns)], names=["kind", "part", "keys", "n", "m"])
    counts.clear()


@tidied
def _counted(batches):
    """Blobs of runs (kind 0; all texts) and of words (kind 1; training texts only)."""
    grams, words = Counts(np.int32), Counts(np.int32)
    for batch in batches:
        training = batch.column(1).to_numpy(zero_copy_only=False)
        texts = _lowered(batch.column(0).to_pylist())
        for which in (True, False):
            own = [t for t, x in zip(texts, training) if x == which]
            for a, b in sub_batches(own):
                grams.add(laid_out(own[a:b])[0], which)
                if which:
                    words.add(words_of(own[a:b])[0], True)
            for kind, counts in ((0, grams), (1, words)):
                if len(counts.keys) > HELD:
                    yield from _blobs(kind, counts)
    yield from _blobs(0, grams)
    yield from _blobs(1, words)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 1/2, by Stirling's series after a shift."""
    shift = np.zeros_like(x, dtype=np.float64)
    y = np.array(x, np.float64)
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: ln of gamma(n + 1/2) / gamma(1/2), and of gamma(n + 1), for small n.
_HALVES, _WHOLES = _lgamma(np.arange(4096) + 0.5) - 0.5 * log(np.pi), _lgamma(np.arange(8192) + 1.0)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the estimate of a zeros and b ones, in any order."""
    out = np.empty(len(a))
    small = np.maximum(a, b) < len(_HALVES)
    i, j = a[small].astype(np.int64), b[small].astype(np.int64)
    out[small] = _HALVES[i] + _HALVES[j] - _WHOLES[i + j]
    x, y = a[~small], b[~small]
    out[~small] = _lgamma(x + 0.5) + _lgamma(y + 0.5) - log(np.pi) - _lgamma(x + y + 1)
    return out


class Subtrees:
    """The nodes from depth `top` to DEPTH of some runs, which hold whole subtrees of depth top.

    A depth's rows are its distinct (context, byte) with their counts, sorted by context (its nearest byte first in
    order of keys' low ends) and byte, so the nodes of each bit are neighbouring rows.
    """

    def __init__(self, runs: np.ndarray, counts: np.ndarray, top: int = 2):
        self.top = top
        seen = counts > 0
        rows, counts = runs[seen], counts[seen].astype(np.float64)
        self.rows, self.counts, self.up = {}, {}, {}
        for d in range(DEPTH, top - 1, -1):
            keys = rows & _U((1 << 8 * (d + 1)) - 1)
            order = np.argsort(keys, kind="stable")
            at = _runs_of(keys[order])
            place = np.empty(len(keys), np.int64)
            place[order] = np.repeat(np.arange(len(at)), np.diff(at, append=len(keys)))
            if d < DEPTH:
                self.up[d + 1] = place  # of each row of the depth below
            rows, counts = keys[order][at], np.add.reduceat(counts[order], at) if len(at) else counts
            self.rows[d], self.counts[d] = rows, counts

    def nodes(self, d: int, k: int):
        """(first row of each node, node of each row, zeros, ones) of bit k."""
        rows, counts = self.rows[d], self.counts[d]
        at = _runs_of(rows >> _U(8 - k))
        node = np.repeat(np.arange(len(at)), np.diff(at, append=len(rows)))
        bit = (rows >> _U(7 - k)) & _U(1)
        ones = np.bincount(node, counts * bit, len(at))
        return at, node, np.bincount(node, counts, len(at)) - ones, ones

    def weighted(self, k: int):
        """For bit k, from DEPTH up to top: a dict of (at, node, zeros, ones, own, weighted) by depth."""
        out, below = {}, None
        for d in range(DEPTH, self.top - 1, -1):
            at, node, zeros, ones = self.nodes(d, k)
            own = _log_kt(zeros, ones)
            if below is None:
                total = own
            else:
                parent = node[self.up[d + 1][below[0]]]
                total = log(0.5) + np.logaddexp(own, np.bincount(parent, below[1], len(at)))
            out[d] = at, node, zeros, ones, own, total
            below = at, total
        return out

    def summary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context byte << 8 | node, zeros, ones, weighted) summed over the nodes of depth top = 2 below each of depth 1."""
        parts = []
        for k in range(8):
            at, _, zeros, ones, _, total = self.weighted(k)[self.top]
            first = self.rows[self.top][at]
            key = (first & _U(0xFF00)) | _U(1 << k) | (first & _U(0xFF)) >> _U(8 - k)
            found, inverse = np.unique(key, return_inverse=True)
            parts.append((found.astype(np.int64), *(np.bincount(inverse, x, len(found)) for x in (zeros, ones, total))))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def log2_of(self, runs: np.ndarray, above: "Top") -> np.ndarray:
        """log2 of the probability of each run's last byte after the bytes before it."""
        out = np.zeros(len(runs))
        for k in range(8):
            nodes = self.weighted(k)
            one, open_ = np.empty(len(runs)), np.arange(len(runs))
            value, sure, left = {}, None, None
            for d in range(self.top, DEPTH + 1):
                at, node, zeros, ones, own, total = nodes[d]
                if sure is None:
                    first = self.rows[d][at]
                    s, x = above.open(((first >> _U(8)) & _U(0xFF)).astype(np.int64), (_U(1 << k) | (first & _U(0xFF)) >> _U(8 - k)).astype(np.int64))
                else:
                    parent = nodes[d - 1][1][self.up[d][at]]
                    s, x = sure[parent], left[parent]
                stop = np.ones(len(at)) if d == DEPTH else np.exp(log(0.5) + own - total)
                sure, left = s + x * stop * (ones + 0.5) / (zeros + ones + 1), x * (1 - stop)
                value[d] = sure if d == DEPTH else sure + left * 0.5  # where no deeper node exists
            for d in range(DEPTH, self.top - 1, -1):
                if not len(open_):
                    break
                prefix = self.rows[d][nodes[d][0]] >> _U(8 - k)
                wanted = (runs[open_] & _U((1 << 8 * (d + 1)) - 1)) >> _U(8 - k)
                if len(prefix):
                    place = np.minimum(np.searchsorted(prefix, wanted), len(prefix) - 1)
                    known = prefix[place] == wanted
                    one[open_[known]] = value[d][place[known]]
                    open_ = open_[~known]
            rest = runs[open_]
            one[open_] = above.value(((rest >> _U(8)) & _U(0xFF)).astype(np.int64), (_U(1 << k) | (rest & _U(0xFF)) >> _U(8 - k)).astype(np.int64))
            bit = (runs >> _U(7 - k)) & _U(1)
            out += np.log2(np.where(bit == 1, one, 1 - one))
        return out


class Top:
    """Depths 0 and 1: for each context byte and node, what these depths give surely and the weight left for deeper ones."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        """Sums over the children of each node of depth 1, by context byte << 8 | node."""
        context, node = key >> 8, key & 255
        own = _log_kt(zeros, ones)
        total = log(0.5) + np.logaddexp(own, below)
        z0, o0, b0 = (np.bincount(node, x, 256) for x in (zeros, ones, total))
        own0 = _log_kt(z0, o0)
        stop0 = np.exp(log(0.5) + own0 - (log(0.5) + np.logaddexp(own0, b0)))
        sure0, left0 = stop0 * (o0 + 0.5) / (z0 + o0 + 1), 1 - stop0
        known0 = z0 + o0 > 0
        self.sure, self.left = np.zeros((256, 256)), np.zeros((256, 256))
        # a byte that is no context yet: what depth 0 gives, or a half
        self.one = np.tile(np.where(known0, sure0 + left0 * 0.5, 0.5), (256, 1))
        stop = np.exp(log(0.5) + own - total)
        sure = sure0[node] + left0[node] * stop * (ones + 0.5) / (zeros + ones + 1)
        left = left0[node] * (1 - stop)
        self.sure[context, node], self.left[context, node], self.one[context, node] = sure, left, sure + left * 0.5

    def open(self, context: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.sure[context, node], self.left[context, node]

    def value(self, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        return self.one[context, node]


MERGED = BLOBS + ", key int, zeros double, ones double, below double"


@tidied
def _merged(batches):
    """Each part's counts in one row; beside it, of runs, what depth 1 needs of the part (kind 2)."""
    names = ["kind", "part", "keys", "n", "m", "key", "zeros", "ones", "below"]
    types = [pa.int8(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]

    def rows(n, given):
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def done(kind: int, part: int, counts: Counts):
        yield rows(1, {"kind": [kind], "part": [part], "keys": [counts.keys.tobytes()], "n": [counts.n.tobytes()], "m": [counts.m.tobytes()]})
        if kind == 0 and counts.n.any():
            key, zeros, ones, below = Subtrees(counts.keys, counts.n).summary()
            yield rows(len(key), {"kind": np.full(len(key), 2, np.int8), "key": key.astype(np.int32), "zeros": zeros, "ones": ones, "below": below})

    # blobs wait until they are as many numbers as the part has, so each number is sorted a few times only
    now, counts, waiting, n_waiting = None, Counts(), [], 0
    for batch in batches:
        for kind, part, keys, n, m in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if now != (kind, part):
                if now is not None:
                    counts.merge_all(waiting)
                    yield from done(*now, counts)
                now, counts, waiting, n_waiting = (kind, part), Counts(), [], 0
            waiting.append((np.frombuffer(keys, np.uint64), *(np.frombuffer(x, np.int32).astype(np.int64) for x in (n, m if kind == 0 else n))))
            n_waiting += len(waiting[-1][0])
            if n_waiting >= max(WAITING, len(counts.keys)):
                counts.merge_all(waiting)
                waiting, n_waiting = [], 0
    if now is not None:
        counts.merge_all(waiting)
        yield from done(*now, counts)


def _values(top):
    """(gram, bits, m): log2 of the probability of every run's last byte, and how often texts hold it."""

    def run(batches):
        for batch in batches:
            for keys, n, m in zip(*(batch.column(k).to_pylist() for k in range(3))):
                runs, n = np.frombuffer(keys, np.uint64), np.frombuffer(n, np.int64)
                bits = Subtrees(runs, n).log2_of(runs, top.value)
                yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(bits), pa.array(np.frombuffer(m, np.int64))], names=["gram", "bits", "n"])

    return tidied(run)


@tidied
def _word_rows(batches):
    for batch in batches:
        for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["word", "n"])


class Lookup:
    """Values of known numbers, by an open table; made on the driver and sent as it is."""

    FREE = ~_U(0)  # no run (of at most seven bytes) is this, and a word with 2**-64

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(log2(max(len(keys) - 1, 1))) + 2)  # a quarter to half full
        self.keys = np.full(1 << self.bits, self.FREE)
        self.values = np.zeros(1 << self.bits, values.dtype)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == self.FREE
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several for one slot the last stays
            done = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[done]]] = values[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLDEN) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each, 0 where it isn't known, and which those are."""
        slot = self.slot(keys)
        found = self.keys[slot]
        out = self.values[slot]
        hit = found == keys
        todo, missing = np.flatnonzero(~hit), []
        out[todo] = 0
        found, slot = found[todo], slot[todo]
        while len(todo):
            none = found == self.FREE
            missing.append(todo[none])
            todo, slot = todo[~none], (slot[~none] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo, slot, found = todo[~hit], slot[~hit], found[~hit]
        return out, np.sort(np.concatenate(missing)) if missing else np.zeros(0, np.int64)


def most_frequent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """At most `most` rows of counts (column n), all from some frequency on, in steps of a sixteenth of a doubling, and the
    other rows.

    The threshold comes from a histogram of at most a thousand rows, so nothing is sorted on the driver.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    sizes = {r.step: r.c for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect()}
    least, total = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    return counts.where(step >= least), counts.where(step < least)


def _lookup(spark, table: DataFrame, key: str, value: str, most: int, kind=np.float64):
    """A broadcast of the values of the most frequent rows, at most so many, and the rows of all others."""
    top, rest = most_frequent(table, most)
    found = top.select(key, value).toArrow()  # bounded
    return spark.sparkContext.broadcast(Lookup(found[key].to_numpy().view(np.uint64), found[value].to_numpy().astype(kind))), rest


SCORED = "kind byte, tag long, doc_id long, held_out boolean, n_bytes long, tokens long, known long, logs double, bits double, key long, times long"


def _scored(grams, words):
    """Of each text (kind 0): row number, id, sizes, and the sums over cached words and runs; then of others their
    number and times, words (kind 1) and runs (kind 2)."""
    names = [x.split()[0] for x in SCORED.split(", ")]
    types = [pa.int8(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def rows(n, given):
        return pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x, t)) if (x := given.get(c)) is not None else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def others(kind, keys, own, tags):
        """(row number, number, times) of what isn't cached."""
        order = np.lexsort((keys, own))
        keys, own = keys[order], own[order]
        at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])) if len(keys) else np.zeros(0, np.int64)
        return rows(len(at), {"kind": np.full(len(at), kind, np.int8), "tag": tags[own[at]], "key": keys[at].view(np.int64), "times": np.diff(at, append=len(keys))})

    def run(batches):
        of_gram, of_word = grams.value, words.value
        tag = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, held, texts = batch.column(0), batch.column(1), _lowered(batch.column(2).to_pylist())
            tags = np.arange(tag, tag + len(texts))
            tag += len(texts)
            for a, b in sub_batches(texts):
                n = b - a
                numbers, own = words_of(texts[a:b])
                logs, unknown = of_word(numbers)
                known = np.ones(len(numbers))
                known[unknown] = 0
                runs, starts, n_runs = laid_out(texts[a:b])
                bits, rare = of_gram(runs)
                yield rows(n, {"kind": np.zeros(n, np.int8), "tag": tags[a:b], "doc_id": ids.slice(a, n), "held_out": held.slice(a, n), "n_bytes": n_runs - 1, "tokens": np.bincount(own, minlength=n), "known": np.bincount(own, known, n).astype(np.int64), "logs": np.bincount(own, logs, n), "bits": np.add.reduceat(bits.astype(np.float64), starts)})
                if len(unknown):
                    yield others(1, numbers[unknown], own[unknown], tags[a:b])
                if len(rare):
                    yield others(2, runs[rare], np.searchsorted(starts, rare, side="right") - 1, tags[a:b])

    return tidied(run)


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, bits, n) of every run of DEPTH + 1 bytes of the texts, and (word, n) of every word, both written. texts: a text
    column, and whether the row is for training."""
    spark = texts.sparkSession
    partitions = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blobs = texts.mapInArrow(_counted, BLOBS).repartition(partitions, "kind", "part").sortWithinPartitions("kind", "part")
    merged = written(blobs.mapInArrow(_merged, MERGED), "parts")
    ones = merged.where("kind = 2").groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()  # at most 65,280 rows
    top = spark.sparkContext.broadcast(Top(ones["key"].to_numpy().astype(np.int64), *(ones[c].to_numpy() for c in ("zeros", "ones", "below"))))
    grams = written(merged.where("kind = 0").select("keys", "n", "m").mapInArrow(_values(top), "gram long, bits double, n long"), "grams")
    return grams, written(merged.where("kind = 1").select("keys", "n").mapInArrow(_word_rows, "word long, n long"), "words")


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the tree's probability of the whole
    text and its end) and bits_per_byte (its code length, the end counted as a byte) of every row."""
    spark = docs.sparkSession
    ready(spark)
    held = fold_of(id_col, folds) == held_fold
    text = F.col(text_col).cast("string").alias("text")
    grams, words = train(docs.select(text, ~held))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = words.withColumn("logs", F.log10(F.col("n") + F.lit(1.0)))
    of_gram, rare_grams = _lookup(spark, grams, "gram", "bits", CACHED, np.float32)
    of_word, rare_words = _lookup(spark, words, "word", "logs", CACHED_WORDS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), text)
    passed = written(rows.mapInArrow(_scored(of_gram, of_word), SCORED), "scored")
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    more = passed.where("kind = 1").select("tag", F.col("key").alias("word"), "times").join(rare_words, "word").select("tag", F.col("times").alias("known"), (F.col("times") * F.col("logs")).alias("logs"), none.alias("bits"))
    more = more.union(passed.where("kind = 2").select("tag", F.col("key").alias("gram"), "times").join(rare_grams, "gram").select("tag", zero, none, F.col("times") * F.col("bits")))
    more = more.groupBy("tag").agg(F.sum("known").alias("more_known"), F.sum("logs").alias("more_logs"), F.sum("bits").alias("more_bits"))
    main = passed.where("kind = 0").join(more, "tag", "left")
    bits = F.col("bits") + F.coalesce("more_bits", none)
    return main.select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", none) - F.col("tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (bits * float(np.log10(2.0))).alias("score"), (-bits / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
