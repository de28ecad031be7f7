"""Queries after a lift leave small tables in the shared folder: a contact there is its two bins, its ranks and its coverages."""

import os

import pytest

from weftline import storage
from weftline.plans import queries as Q

NAMES = ("bedgraph_file", "color_limit", "cool_pixels_control", "matrix_diff", "metric_control", "metric_pbad", "metric_stripe", "matrix_ctrl", "matrix_split", "metric_hist", "metric_kde", "metric_loci", "shuffle_control", "hist_distance", "lift_losers",)


def kept(since: int) -> int:
    """Bytes of the tables that were written after so many, and are still there."""
    tops = [path.removeprefix("file://") for _, path in storage._made[since:]]
    return sum(os.path.getsize(f"{top}/{x}") for top in tops if os.path.isdir(top) for x in os.listdir(top) if x.endswith(".parquet"))


@pytest.fixture(scope="module")
def lifted(spark, small):
    """A comparison that all queries share, and the bytes that its lift keeps."""
    since = len(storage._made)
    c = Q.comparison(spark, small)
    c.dedup()
    return c, kept(since)


@pytest.mark.parametrize("name", NAMES)
def test_tables(spark, small, lifted, monkeypatch, name):
    c, of_lift = lifted
    monkeypatch.setattr(Q, "comparison", lambda *a: c)
    since = len(storage._made)
    Q.QUERIES[name](spark, small).count()
    added = kept(since) if name == "lift_losers" else 0
    read = sum(os.path.getsize(f"{small}/{t}.parquet") for t in ("lineitem", "part"))
    assert of_lift <= 1.3 * read
    assert of_lift + added <= 1.75 * read
