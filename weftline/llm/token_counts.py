"""Token counts with a whole-token shortcut for byte-level BPE.

Offline, the merges run over every string of the vocabulary; those that come out as a single
token are proven whole. A pre-token that is proven whole counts as one without merging, and
only the rest is merged (with a bounded memory of counts seen before). Strings of added tokens
inside a text count as one token each, as the library's default has it.

Defined results: a null text is empty (0 bytes, 0 tokens); texts of any length are split at
places where a pre-token always ends (a text, however long, without white space is one piece, whose memory grows with
it); counts don't depend on ties of merges, as ranks are distinct; repeated rows each get their own row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, text_or_empty

#: Fixed value: the pattern of byte-level pre-tokens, as public_tokenizers documents it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 1 << 20
REMEMBERED = 200_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 bytes stand for themselves and the
    others take the code points from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Merger:
    """Merges pre-tokens: short ones by scanning a list of ranks, long ones with a heap in
    O(n log n). Symbols are numbers; a pair's key is left * 2**20 + right."""

    SHORT, NEVER = 96, 1 << 60

    def __init__(self, merges: list[tuple[str, str]]):
        names = dict.fromkeys([*byte_alphabet(), *(x for pair in merges for x in (*pair, pair[0] + pair[1]))])
        self.number = number = {x: i for i, x in enumerate(names)}
        if len(number) >= 1 << 20:
            raise ValueError("the vocabulary has more than a million strings")
        #: Pair key to rank * 2**20 + number of the merged symbol.
        self.into = {number[a] << 20 | number[b]: rank << 20 | number[a + b] for rank, (a, b) in reversed([*enumerate(merges)])}
        self.of_byte = [number[c] for c in byte_alphabet()]

    def count(self, data: bytes) -> int:
        """The number of tokens of a pre-token's bytes."""
        of_byte = self.of_byte
        if len(data) > self.SHORT:
            return self.count_long([of_byte[b] for b in data])
        parts = [of_byte[b] for b in data]
        get, never = self.into.get, self.NEVER
        ranks = [get(a << 20 | b, never) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            parts[i] = new = least & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | new, never)
            if i < len(ranks):
                ranks[i] = get(new << 20 | parts[i + 1], never)
        return len(parts)

    def count_long(self, parts: list[int]) -> int:
        n = left = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.into.get
        pairs = zip(range(n - 1), parts, parts[1:])
        #: By rank, then place.
        heap = [(to >> 20, i, a, b, to & 0xFFFFF) for i, a, b in pairs if (to := get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            if parts[i] != a or (j := after[i]) >= n or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j] = new, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (to := get(new << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (to >> 20, i, new, parts[k], to & 0xFFFFF))
            if (h := before[i]) >= 0 and (to := get(parts[h] << 20 | new)) is not None:
                heapq.heappush(heap, (to >> 20, h, parts[h], new, to & 0xFFFFF))
        return left


def load_model(path: str) -> dict:
    """What counting needs of a tokenizers file, read on the driver: a bounded few MB.

    Only files of the kind proven here are taken: byte-level BPE without normaliser or dropout.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, pre = said["model"], said["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or said["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError(f"{path}: not a plain byte-level BPE file")
    added = [t for t in said["added_tokens"]]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path}: added tokens with conditions are not supported")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"merges": merges, "vocab": list(model["vocab"]), "added": [t["content"] for t in added]}


def prove_whole(model: dict) -> list[str]:
    """The vocabulary's strings, as text, that merge to one token when they stand alone."""
    merger, alphabet = Merger(model["merges"]), byte_alphabet()
    byte_of = {c: b for b, c in enumerate(alphabet)}
    added, whole = set(model["added"]), []
    for token in model["vocab"]:
        if token in added or any(c not in byte_of for c in token):
            continue
        data = bytes(byte_of[c] for c in token)
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            continue  # part of a character: never a whole pre-token
        if merger.count(data) == 1:
            whole.append(text)
    return whole


class Counter:
    """Counts the tokens of texts; one lives in each Python worker."""

    def __init__(self, model: dict, whole: list[str]):
        import regex

        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile(r"\S\s").search
        self.added = regex.compile("|".join(map(regex.escape, sorted(model["added"], key=len, reverse=True)))) if model["added"] else None
        self.merger = Merger(model["merges"])
        outer = self

        class Memory(dict):
            def __missing__(self, pretoken):
                n = outer.merger.count(pretoken.encode("utf-8"))
                if len(pretoken) <= 64:
                    if len(self) > outer.full:
                        self.clear()
                        self.update(outer.ones)
                    self[pretoken] = n
                return n

        self.ones = dict.fromkeys(whole, 1)
        self.full = len(self.ones) + REMEMBERED
        self.memory = Memory(self.ones)

    def pieces(self, text: str):
        """Cuts between a visible character and white space, where a pre-token always ends."""
        at = 0
        while len(text) - at > PIECE:
            found = self.cut(text, at + PIECE)
            if not found:
                break
            yield text[at : found.start() + 1]
            at = found.start() + 1
        yield text[at:] if at else text

    def plain(self, text: str) -> int:
        get = self.memory.__getitem__
        return sum(sum(map(get, self.find(piece))) for piece in self.pieces(text))

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def token_length(spark: SparkSession, tokenizer_path: str) -> Callable[[Column], Column]:
    """A function of a text column that gives its number of tokens; null counts as empty."""
    ready(spark)
    model = load_model(tokenizer_path)
    sent = spark.sparkContext.broadcast((model, prove_whole(model)))  # bounded by the vocabulary
    kept: list[Counter] = []

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Counter(*sent.value))
        return texts.map(kept[0].count)

    return lambda text: n_tokens(F.coalesce(text.cast("string"), F.lit("")))


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs."""
    n_tokens = token_length(docs.sparkSession, tokenizer_path)
    text = text_or_empty(text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(F.col(text_col)).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
