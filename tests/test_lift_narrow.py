"""A query lifts no more than it asks for: the contacts of its region, and the columns that it reads."""

import os

import pytest

from weftline.operators import lift as L
from weftline.plans import queries as Q

REGIONS = ("matrix_diff", "matrix_ctrl", "matrix_split", "metric_loci",)
COLUMNS = {"cool_pixels_control": 10, "metric_stripe": 10, "metric_pbad": 10, "metric_hist": 10, "metric_kde": 10, "shuffle_control": 10, "hist_distance": 7}


@pytest.fixture(scope="module")
def stages(spark, small):
    """A comparison and its lift, of which no rows have been asked for yet."""
    c = Q.comparison(spark, small)
    c.lift()
    return c


@pytest.fixture
def lifts(spark, small, stages, monkeypatch):
    """Runs a query on the stages; the tables of lifted contacts that it made."""
    made, put = [], L.written_in_turn
    noted = lambda parts, label, **o: (made.append((label, put(parts, label, **o))), made[-1][1])[1]

    def run(name):
        c = Q.Comparison(stages.a, stages.b, stages.links, stages.resolution, stages.max_distance, stages.inter, stages.thr_len, stages.step_len, stages.agg_frame)
        c._kept |= {"lift": stages.lift()} | {k: v for k, v in stages._kept.items() if k.startswith("contacts")}
        c.lift()._made.clear()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(Q, "comparison", lambda *a: c)
            patch.setattr(L, "written_in_turn", noted)
            Q.QUERIES[name](spark, small).collect()
        return [df for label, df in made if label.startswith("lift")]

    return run


@pytest.mark.parametrize("name", REGIONS)
def test_region(stages, lifts, name):
    whole = stages.contacts("a").count()
    assert 0 < sum(df.count() for df in lifts(name)) < 0.8 * whole


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(lifts, name):
    assert [len(df.columns) for df in lifts(name)] == [COLUMNS[name]]


def test_pairs_are_written_before_groups(stages):
    """What the pairs of bins shuffled can go before the groups are made."""
    assert os.path.isdir(stages.lift().remap._written_at.removeprefix("file://"))
