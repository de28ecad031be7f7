"""Column builders for the numeric rules of the contact-map operators.

Spark runs in ANSI mode: divisions that may meet zero use try_divide, and NaN is kept apart from NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def valid_weight(w: Column) -> Column:
    """Missing, non-finite and non-positive weights count as 1."""
    bad = w.isNull() | F.isnan(w) | (w <= 0) | (w == F.lit(float("inf")))
    return F.when(bad, F.lit(1.0)).otherwise(w).cast("float")


def half_even(x: Column) -> Column:
    """Rounding of a double to a whole number, ties to even."""
    return F.bround(x, 0).cast("int")


def share100(n: Column) -> Column:
    """round(1 / n, 2) in hundredths: of the binary ties (8, 40, 200) only 8 goes down."""
    return F.when(n == 8, F.lit(12)).otherwise(F.floor((F.lit(200) + n) / (F.lit(2) * n))).cast("int")


def percent(x: Column) -> Column:
    """A fraction as a whole percentile, truncated, 99 at most."""
    return F.least(F.floor(x * 100).cast("int"), F.lit(99))


def safe_log2(a: Column, b: Column, eps: float = 1e-9) -> Column:
    zero = F.lit(0.0)
    return F.log2((F.greatest(a, zero) + eps) / (F.greatest(b, zero) + eps))


def hist_index(v: Column, lo: float, hi: float, n: int) -> Column:
    """The bin of v among n equal ones of [lo, hi], its top edge included, or NULL outside.

    Edges are lo + i * step, and the last is hi; the quotient is corrected against them, by one step down or up.
    """
    step = (hi - lo) / n
    edge = lambda i: i * F.lit(step) + F.lit(float(lo))
    k = F.least(F.floor((v - lo) / step), F.lit(n - 1))
    off = F.when(v < edge(k), -1).when((k < n - 1) & (v >= edge(k + 1)), 1).otherwise(0)
    return F.when((v >= lo) & (v <= hi) & ~F.isnan(v), (k + off).cast("int"))
