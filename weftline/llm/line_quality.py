"""Quality rules on cross-document line frequency, in DataFrame operations only.

Lines are normalised (letters to lower case, white space runs to one blank, ends trimmed) and
hashed. For each host the distinct documents of each line are counted; documents with
equal texts on a host are one document. A line is above the limit if at least ``least_docs`` distinct
documents of a host hold it, whatever the host's size. Such lines are removed, and a document is depleted if less than
``least_left`` of its words remain; without_frequent_lines() gives the texts that remain.

Shuffles carry hashes only, never texts. Distinct (host, line, document) rows are dealt out by all
three, and the counts are partly summed before their shuffle, so a host or line that a third of all
rows hold is one row a task.

Defined results: a null text has no words and fails; lines without a word don't count; a null host
is a host of its own; repeated rows get equal verdicts; empty tables give no rows; extra columns are
ignored unless named as host. There are no ties: a line with exactly ``least_docs`` documents is removed. A very long text
is one row, in a few copies as arrays of its words and lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import SPACES, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Distinct documents of a host from which on a line is boilerplate.
LEAST_DOCS = 8


def _blanks(text: Column, white: str) -> Column:
    for c in white:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """Words without a regex: other white space becomes a blank, and empty pieces go."""
    return F.filter(F.split(_blanks(text, SPACES[1:]), " "), lambda w: w != "")


def _normal_lines(text: Column) -> Column:
    """Of each line: the hash of its words in lower case, and their number."""
    lines = F.split(F.lower(_blanks(text, SPACES[1:].replace("\n", ""))), "\n")
    words = F.transform(lines, lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    return F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("hash"), F.size(w).alias("words")))


def _key(host_col: str, text_col: str) -> list[Column]:
    """What stands for a document of a host: the host, and the hash and size of the text."""
    text = text_or_empty(text_col)
    return [F.col(host_col).alias("host"), F.xxhash64(text).alias("doc"), F.octet_length(text).alias("size")]


def _stripped(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def base_rules(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Repeated windows: hashes of five words are sorted with their places only in documents
    that hold an equal pair; the words covered are the sum of min(5, step to the next place).
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text_or_empty(text_col).alias("_text"))
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = own.withColumn("_lines", lines).withColumn("_hashes", F.transform(words_of(text), lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    at = lambda i: F.get(F.col("_hashes"), i)
    windows = F.when(n >= 5, F.transform(F.slice("_hashes", 1, F.greatest(n - 4, F.lit(1))), lambda x, i: F.xxhash64(x, at(i + 1), at(i + 2), at(i + 3), at(i + 4)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_windows", windows)
    has_pair = F.size(F.array_distinct("_windows")) < F.size("_windows")
    in_order = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(has_pair, in_order))
    near = lambda i: F.get(F.col("_sorted"), i)["h"]
    twice = F.filter("_sorted", lambda x, i: (x["h"] == F.when(i > 0, near(i - 1))) | (x["h"] == near(i + 1)) & near(i + 1).isNotNull())
    out = out.withColumn("_places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    steps = F.transform("_places", lambda x, i: F.least(F.lit(5), F.coalesce(F.get(F.col("_places"), i + 1) - x, F.lit(5))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    bare = _stripped(text, SPACES)
    return out.select(
        "_row.*",
        n.cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(_stripped(bare, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _rows(keyed: DataFrame) -> DataFrame:
    """host, doc, size, hash, words: the words of a document's lines by the lines' hash; those of copies are summed."""
    lines = keyed.select("host", "doc", "size", F.explode("lines").alias("line")).select("host", "doc", "size", "line.*")
    return lines.where("words > 0").groupBy("host", "doc", "size", "hash").agg(F.sum("words").alias("words"))


def depleted_documents(keyed: DataFrame, *, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(host, doc, size, gone) of every document that holds lines above the limit: the number of words of such lines.
    keyed: host, doc, size and lines of documents."""
    copies = keyed.groupBy("host", "doc", "size").agg(F.count("*").alias("copies"))
    rows = _rows(keyed)
    found = rows.alias("r").join(_frequent(rows, least_docs).alias("f"), F.expr("r.host <=> f.host and r.hash = f.hash"))
    gone = found.groupBy("r.host", "doc", "size").agg(F.sum("words").alias("words"))
    return gone.alias("g").join(copies.alias("c"), F.expr("g.host <=> c.host and g.doc = c.doc and g.size = c.size")).select("g.host", "g.doc", "g.size", (F.col("words") / F.col("copies")).alias("gone"))


def _frequent(rows: DataFrame, least_docs: int) -> DataFrame:
    return rows.groupBy("host", "hash").agg(F.count("*").alias("in_docs")).where(F.col("in_docs") >= least_docs).select("host", "hash")


def without_frequent_lines(docs: DataFrame, *, host_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with their texts without the lines above the limit. A null text stays null; texts without such lines stay as they
    are; other columns, whatever their names, too.

    Only documents' keys and the hashes of their frequent lines are joined back.
    """
    text = text_or_empty(text_col)
    lines = _normal_lines(text).alias("lines")
    rows = _rows(docs.select(*_key(host_col, text_col), lines))
    found = rows.alias("r").join(_frequent(rows, least_docs).alias("f"), F.expr("r.host <=> f.host and r.hash = f.hash")).groupBy("r.host", "doc", "size").agg(F.collect_list("r.hash").alias("hashes"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"), *_key(host_col, text_col))
    held = held.alias("d").join(found.alias("g"), F.expr("d.host <=> g.host and d.doc = g.doc and d.size = g.size"), "left").withColumn("lines", F.when(F.col("hashes").isNotNull(), _normal_lines(F.col("text"))))
    line = lambda i: F.get(F.col("lines"), i)
    left = F.filter(F.split("text", "\n"), lambda x, i: (line(i)["words"] == 0) | ~F.array_contains("hashes", line(i)["hash"]))
    clean = F.when(F.col("hashes").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    held = held.select("row", clean.alias("clean"))
    return held.select(*(F.col("clean" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", least_left: float = 0.25, **limits) -> DataFrame:
    """The base counts, base_failed, and kept: neither base_failed nor depleted. Texts are read once, to slim rows."""
    base = base_rules(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    slim = written(base.select("doc_id", *_key("host", "text"), *counts, _normal_lines(text_or_empty("text")).alias("lines")), "lines")
    gone = depleted_documents(slim, **limits)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = slim.alias("b").join(gone.alias("g"), F.expr("b.host <=> g.host and b.doc = g.doc and b.size = g.size"), "left")
    return rows.select("doc_id", *counts, failed.alias("base_failed"), (~failed & ~(F.coalesce(F.col("gone"), F.lit(0)) > (1 - least_left) * F.col("n_words"))).alias("kept"))
