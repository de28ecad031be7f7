"""Secret scans over a trigram inverted index.

From each rule's parsed regex a Boolean query over trigrams (ASCII letters folded to lower case)
is derived: every match must hold trigrams that make the query true. A shard of documents (a
bounded slice of an Arrow batch) is indexed by the trigrams that any query names: posting lists of
the shard's documents, as bit sets. Queries are answered by intersecting and uniting postings,
and only the candidates are verified with the regex. A rule without mandatory trigrams (``hex``)
scans every document. Shards are independent, so nothing is shuffled and a lost executor's shards
are simply built again.

Defined results: a null text is empty; spans are code points, end exclusive, per kind leftmost and
non-overlapping; of spans that start together the kind listed first comes first; repeated rows each get their own row;
empty tables give no rows; other columns are ignored; texts are always scanned whole, very long ones in a shard of their own
(which takes about 15 bytes of memory for each of text).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, sub_batches, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The three base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
#: Kinds that this operator adds to the base ones.
EXTRA = (
    # from the BEGIN line to the END line; where that is missing (a cut text), to the end of the header and key lines
    Rule(
        "private_key",
        r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"
        r"(?:(?:(?!-----)[\s\S])*+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"
        r"|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++(?:\r?\n[A-Za-z0-9+/=]{1,15}(?=[\t\r ]*(?:\n|\Z)))?)?)",
    ),
    Rule("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"\b(?:https?|ftp|postgres|mysql|mongodb)://[^\s:/@]+:[^\s:/@]{3,}@"),
)

MOST_STRINGS = 64


def _and(*parts):
    flat = [p for p in parts if p != ("all",)]
    return ("all",) if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _or(*parts):
    if any(p == ("all",) for p in parts):
        return ("all",)
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]):
    """The query that holds if one of the strings is in the text."""
    return _or(*(_and(*(("gram", s[i : i + 3]) for i in range(len(s) - 2))) for s in sorted(strings)))


def _walk(items) -> list:
    """A sequence's parts: sets of strings where they are few, or queries where they are not."""
    parts: list = []
    for op, arg in items:
        if op is C.LITERAL:
            parts.append({chr(arg)})
        elif op is C.IN:
            chars: set[str] | None = set()
            for kind, what in arg:
                if kind is C.LITERAL and chars is not None:
                    chars.add(chr(what))
                elif kind is C.RANGE and chars is not None and what[1] - what[0] < 8:
                    chars |= {chr(x) for x in range(what[0], what[1] + 1)}
                else:
                    chars = None
            parts.append(chars if chars and len(chars) <= 8 else ("all",))
        elif op is C.SUBPATTERN:
            parts += _walk(arg[3])
        elif op is C.BRANCH:
            options = [_walk(x) for x in arg[1]]
            joined = [_joined(x) for x in options]
            if all(len(x) == 1 and isinstance(x[0], set) for x in joined) and len(whole := set().union(*(x[0] for x in joined))) <= MOST_STRINGS:
                parts.append(whole)
            else:
                parts.append(_or(*(_query(x) for x in options)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            inner_parts = _joined(_walk(inner))
            if low == high == 1:
                parts += inner_parts
            elif low == 0 and high == 1 and len(inner_parts) == 1 and isinstance(inner_parts[0], set):
                parts.append({"", *inner_parts[0]})
            elif low == 0:
                parts.append(("all",))
            else:
                parts += [*inner_parts * min(low, 3), ("all",)] if low <= 3 else [*inner_parts, ("all",)]
        elif op is C.AT or op is C.ASSERT_NOT:
            continue  # nothing of the text is taken
        else:
            parts.append(("all",))
    return parts


def _joined(parts: list) -> list:
    """Neighbouring sets of strings become one, as long as it stays small."""
    out: list = []
    for p in parts:
        if out and isinstance(p, set) and isinstance(out[-1], set) and len(both := {a + b for a in out[-1] for b in p}) <= MOST_STRINGS:
            out[-1] = both
        else:
            out.append(p)
    return out


def _query(parts: list):
    return _and(*(_of_strings(p) if isinstance(p, set) else p for p in _joined(parts)))


def trigram_query(rule: Rule):
    """("gram", g), ("and", ...), ("or", ...), or ("all",) where no trigram is mandatory.

    Grams are folded as fold() folds texts, which can only add candidates.
    """

    def folded(q):
        return ("gram", q[1].lower()) if q[0] == "gram" else (q[0], *map(folded, q[1:]))

    return folded(_query(_walk(parser.parse(rule.pattern))))


def grams_of(query) -> set[str]:
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1:])) if len(query) > 1 else set()


class Index:
    """Postings of a shard: for each wanted trigram, the documents that hold it."""

    def __init__(self, grams: list[str]):
        self.row = {g: i for i, g in enumerate(grams)}
        self.lookup = np.zeros(1 << 24, np.uint16)  # trigram of bytes to posting list, 0: none
        for g, i in self.row.items():
            a, b, c = g.encode("latin-1")
            self.lookup[a << 16 | b << 8 | c] = i + 1
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def build(self, texts: list[bytes]) -> np.ndarray:
        data = self.fold[np.frombuffer(b"\0".join(texts), np.uint8)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        postings = np.zeros((len(self.row) + 1, len(texts)), bool)
        if len(data) > 2:
            found = self.lookup[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
            at = np.flatnonzero(found)
            postings[found[at], np.searchsorted(ends, at, side="right")] = True
        return postings[1:]

    def ask(self, query, postings: np.ndarray) -> np.ndarray:
        if query[0] == "gram":
            return postings[self.row[query[1]]]
        if query[0] == "all":
            return np.ones(postings.shape[1], bool)
        parts = [self.ask(q, postings) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


class Scanner:
    """Finds the spans of all rules in batches of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        self.index = Index(sorted(set().union(*map(grams_of, self.queries))))
        #: A base regex that keeps only long runs is the same as its run with a least length.
        self.found = [re.compile(rf"{r.pattern[:-1]}{{{r.least},}}", re.ASCII) if re.fullmatch(r"\[[^\]\\]+\]\+", r.pattern) else r.compiled() for r in rules]

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of each match, by start, then rule, for each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.index.build([t.encode("utf-8", "surrogatepass") for t in texts])
        for k, (rule, query, found) in enumerate(zip(self.rules, self.queries, self.found)):
            for i in np.flatnonzero(self.index.ask(query, postings)).tolist():
                for m in found.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def scan_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = (*BASE, *EXTRA), text_col: str = "text") -> DataFrame:
    """docs with a column secrets: array of (kind, start, end), by start, then the rules' order."""
    ready(docs.sparkSession)
    kept: list[Scanner] = []
    held = docs.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        if not kept:
            kept.append(Scanner(held.value))
        all_texts, out = texts.tolist(), []
        for a, b in sub_batches(all_texts):
            out += [[{"kind": kept[0].rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in kept[0].scan(all_texts[a:b])]
        return pd.Series(out, dtype=object)

    return docs.withColumn("secrets", spans(text_or_empty(text_col)))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """docs with every secret span replaced by mark; overlapping spans become one.

    A null text stays null, an empty one empty; repeated rows are each redacted, in the same way; an empty table gives
    no rows; other columns, whatever their names, stay as they are.
    """
    ready(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, found):
            if text is None or not len(spans):
                out.append(text)
                continue
            parts, at, end = [], 0, -1
            for s in sorted(spans, key=lambda x: x["start"]):
                if s["start"] > end:
                    if end >= 0:
                        parts.append(mark)
                        at = end
                    parts.append(text[at : s["start"]])
                end = max(end, s["end"])
            out.append("".join([*parts, mark, text[end:]]))
        return pd.Series(out, dtype=object)

    own = [F.col(f"`{c}`") for c in docs.columns]
    scanned = scan_secrets(docs.select(F.struct(*own).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), **options)
    clean = F.when(F.size("secrets") > 0, cleaned("text", "secrets")).otherwise(F.col("text"))
    held = scanned.select("row", clean.alias("clean"))
    return held.select(*(F.col("clean" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, SHA-256 of the base spans, and all spans, as text."""
    joined = lambda arr: F.concat_ws(",", F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE]))
    of_kind = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(r.kind).alias(f"n_{r.kind}") for r in BASE]
    scanned = scan_secrets(docs.select("doc_id", "text"))
    return scanned.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("secrets").alias("spans"))
