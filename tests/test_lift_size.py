"""Queries after a lift shuffle no more than a few times their input: pairs of remapped bins stay where their tile is."""

import os
import time

import pytest

from weftline.plans import queries as Q

NAMES = ("lift_dedup", "hist_distance", "shuffle_control", "metric_control", "metric_pbad", "metric_stripe", "bedgraph_file", "color_limit", "matrix_diff", "cool_pixels_control", "matrix_ctrl", "matrix_split", "metric_hist", "metric_kde", "metric_loci", "lift_losers",)


def shuffled(spark) -> int:
    """Bytes that shuffles have written so far."""
    time.sleep(0.5)  # the store gets them shortly after a task's end
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


@pytest.fixture(scope="module")
def lifted(spark, small):
    """A comparison that all queries share, and the bytes that its lift shuffled."""
    before = shuffled(spark)
    c = Q.comparison(spark, small)
    c.dedup()
    return c, shuffled(spark) - before


@pytest.mark.parametrize("name", NAMES)
def test_shuffles(spark, small, lifted, monkeypatch, name):
    c, bytes_of_lift = lifted
    monkeypatch.setattr(Q, "comparison", lambda *a: c)
    before = shuffled(spark)
    Q.QUERIES[name](spark, small).count()
    read = sum(os.path.getsize(f"{small}/{t}.parquet") for t in ("lineitem", "part"))
    assert bytes_of_lift + shuffled(spark) - before <= 8 * read
