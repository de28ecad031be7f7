"""The stages of the workflow over tables: each stage's result is a table in the shared folder."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lift as L
from ..operators import post as P
from ..operators import prepare as R
from ..operators import synteny as S
from ..storage import TIGHT, forget, release, written


@dataclass
class Species:
    bins: DataFrame
    pixels: DataFrame
    fai: DataFrame


@dataclass
class Comparison:
    """A pair of species and the links between them, prepared, marked, lifted and deduplicated on demand."""

    a: Species
    b: Species
    links: DataFrame
    resolution: int
    max_distance: int = R.MAX_DISTANCE
    inter: bool = True
    thr_len: int = 300
    step_len: int = 150
    agg_frame: int = 150_000
    model: str = "raw"
    _kept: dict = field(default_factory=dict)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def contacts(self, which: str) -> DataFrame:
        return self._once(f"contacts_{which}", lambda: self._ranked(which))

    def _ranked(self, which: str) -> DataFrame:
        """Contacts, without starts and ends."""
        s = self.a if which == "a" else self.b
        values = R.written_values(s.bins, s.pixels, self.resolution, max_distance=self.max_distance, inter=self.inter)
        rows = R.ranked(s.bins, values)
        out = written(rows.drop("start1", "end1", "start2", "end2", "dist_bins"), f"contacts-{which}", **TIGHT)
        forget(values, *rows._reads)
        release(out.sparkSession)
        return out

    def observed(self, which: str) -> DataFrame:
        """bin, chrom, start, end of every bin that some contact has."""
        bins = (self.a if which == "a" else self.b).bins
        seen = self.contacts(which).select(F.explode(F.array("bin1", "bin2")).alias("bin")).distinct()
        return bins.select(F.col("bin_id").alias("bin"), "chrom", "start", "end").join(seen, "bin", "left_semi")

    def mark(self) -> DataFrame:
        """The map with its order as a line column."""
        return self._once("mark", lambda: S.link_to_mark(self.links, thr_len=self.thr_len, step_len=self.step_len).selectExpr("struct(blk, piece) as line", "*"))

    def lift(self) -> L.Lift:
        if "lift" not in self._kept:
            self._kept["lift"] = L.Lift(self.contacts("a"), self.contacts("b"), self.a.fai, self.b.fai, self.mark(), agg_frame=self.agg_frame, model=self.model, bins=(self.observed("a"), self.observed("b")))
        return self._kept["lift"]

    def rows(self, criterion: str = "default") -> DataFrame:
        return self._once(f"rows_{criterion}", lambda: self.lift().rows(criterion))

    def dedup(self, resolution: int | None = None) -> DataFrame:
        r = resolution or self.resolution
        return self._once(f"dedup_{r}", lambda: written(P.dedup(self.lift().rows(columns=P.DEDUP), self.a.fai, r), "dedup", **TIGHT))

    def dedup_within(self, *spans: tuple[str, int, int]) -> DataFrame:
        """dedup() of the contacts whose two bins both touch some span (chrom, start, end in bp): only they are lifted. All other
        steps, the ranks, the links and their groups, are those of the whole maps."""
        if f"dedup_{self.resolution}" in self._kept:
            return self._kept[f"dedup_{self.resolution}"]
        r, lift = self.resolution, self.lift()
        cell = F.floor(F.col("start") / r)
        near = lambda c, s, e: (F.col("chrom") == c) & (cell >= s // r) & (cell <= e // r)
        inside = reduce(or_, (near(*x) for x in spans))
        return self._once(f"dedup_{spans}", lambda: written(P.dedup(lift.within(lift.bins_a.where(inside)).rows(columns=P.DEDUP), self.a.fai, r), "dedup-within", **TIGHT))


