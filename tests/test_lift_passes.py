"""A lift deals out its contacts in passes, and only a pass's shuffle files lie on disk at a time; results are those of one."""

import pytest

from weftline import storage
from weftline.operators import lift as L
from weftline.operators import post as P
from weftline.plans import queries as Q

from test_lift_size import shuffled

NAMES = ("color_limit", "metric_control", "hist_distance", "shuffle_control", "cool_pixels_control", "matrix_diff", "metric_pbad", "metric_stripe", "matrix_ctrl", "matrix_split", "metric_hist", "metric_kde", "metric_loci",)


def by_writes(spark, monkeypatch, run) -> list[int]:
    """Bytes that were shuffled between the points at which shuffle files could go, while run() ran."""
    at, let_go = [shuffled(spark)], storage.release
    noted = lambda s: (at.append(shuffled(spark)), let_go(s))
    for module in (storage, L, P):
        monkeypatch.setattr(module, "release", noted)
    run()
    at.append(shuffled(spark))
    return [b - a for a, b in zip(at, at[1:])]


@pytest.fixture(scope="module")
def small_tiles():
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(L, "BLOCK", 8)
        patch.setattr(L, "TILES", 5, raising=False)
        yield


def ready(spark, small):
    """A comparison with all that the passes of a lift share."""
    c = Q.comparison(spark, small)
    c.lift().pairs  # noqa: B018
    return c


@pytest.fixture(scope="module")
def lifted(spark, small, small_tiles):
    """A comparison and the bytes of each step of its lift."""
    c = ready(spark, small)
    with pytest.MonkeyPatch.context() as patch:
        return c, by_writes(spark, patch, c.rows)


@pytest.mark.parametrize("name", NAMES)
def test_passes(spark, small, lifted, monkeypatch, name):
    c, of_lift = lifted
    monkeypatch.setattr(Q, "comparison", lambda *a: c)
    took = of_lift + by_writes(spark, monkeypatch, lambda: Q.QUERIES[name](spark, small).collect())
    assert max(of_lift) <= 0.6 * sum(of_lift)
    assert max(took) <= 0.6 * sum(took)


def test_losers_of_passes(spark, small, small_tiles, monkeypatch):
    """losers are written in passes, and are those of one pass."""
    c = ready(spark, small)
    took = by_writes(spark, monkeypatch, c.lift().losers)
    assert max(took) <= 0.6 * sum(took)
    monkeypatch.setattr(L, "TILES", 1 << 40)
    c2 = ready(spark, small)
    assert sorted(map(str, c.lift().losers().collect())) == sorted(map(str, c2.lift().losers().collect()))
