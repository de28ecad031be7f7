"""Command line: nine subcommands over files, each a thin layer on the operators, and one that runs them for a project.

Figures are given as tables (histograms, matrices, curves) under the output prefix.
"""

from __future__ import annotations

import argparse
import os
import shutil
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lift as L
from .operators import post as P
from .operators import prepare as R
from .operators import synteny as S
from .plans.project import run as run_project
from .session import local_session, ship
from .sources import cooler as C
from .sources import text as T
from .storage import written

PALETTES = ("pinkblue", "RdBu_r", "coolwarm", "PuOr_r", "viridis")
FORMATS = ("pdf", "png", "svg")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftline", description="Comparison of contact maps across species.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *flags: tuple) -> None:
        p = sub.add_parser(name, help=text)
        for names, options in flags:
            p.add_argument(*names.split(), **options)

    need = {"required": True}
    prefix = ("-p --out-prefix", need)
    figure = [("--format", {"default": "pdf", "choices": FORMATS}), ("--dpi", {"type": int, "default": 300})]
    command("asm2link", "align two assemblies and write their links", ("-ga --genome-a", need), ("-gb --genome-b", need), prefix, ("-x", {"required": True, "choices": ("asm5", "asm10", "asm20")}), ("--min-match", {"type": int, "default": 0}))
    command("link2mark", "links to a dense synteny map", ("--link", need), prefix, ("--no-densify", {"action": "store_true"}), ("--no-gap", {"action": "store_true"}), ("--thr-len", {"type": int, "default": 300}), ("--step-len", {"type": int, "default": 150}))
    command("prepare", "a contact map to ranked contacts and statistics", ("--cool", need), ("--out-prefix", need), ("--chunksize", {"type": int, "default": 5_000_000}), ("--max-distance", {"type": int, "default": R.MAX_DISTANCE}), ("--inter", {"action": "store_true"}), ("--nthreads", {"type": int, "default": 1}))
    command("roughlift", "lift a track by cells of 200 bp", ("--track", need), ("--fadix-a", need), ("--fadix-b", need), ("--remap-mark", need), ("--out-bed", need))
    command("liftcontacts", "lift contacts of A to B", ("--contact-a", need), ("--contact-b", need), ("--fadix-a", need), ("--fadix-b", need), ("--mark", need), ("--agg-frame", {"type": int, "default": 150_000}), ("--dups-filter", {"default": "default", "choices": L.CRITERIA}), ("--model", {"default": "raw", "choices": L.MODELS}), ("--out-prefix", need))
    command("contact-stat", "maps of percentiles, distances and ratios against controls", ("--liftover", need), ("--fadix", need), ("--min-bins", {"type": int, "default": 0}), ("--max-bins", {"type": int, "default": 20}), ("--repeats", {"type": int, "default": 1}), ("--bins", {"type": int, "default": 100}), ("--cmap", {"default": "pinkblue", "choices": PALETTES}), ("--vmax", {"type": float}), ("--max-dist-mb", {"type": float, "default": 5.0}), *figure, ("--xy-range", {"type": float, "default": 12.0}), ("--label-a", {"default": "species A"}), ("--label-b", {"default": "species B"}), ("--out-prefix", need))
    command("metric", "windowed divergence metrics", ("--liftover", need), ("--fadix", need), ("--frames", {"type": int, "nargs": "+", "default": [8]}), ("--metric", {"default": "pbad", "choices": tuple(P.METRICS)}), ("--max-dist-mb", {"type": float, "default": 100.0}), *figure, ("--out-prefix", need))
    command("lift2cool", "lifted contacts to two contact maps", ("--liftover", need), ("--fadix", need), ("--assembly", {}), ("--out-prefix", need))
    command("plot-cross", "the matrix of a region, two modes in two triangles", ("--liftover", need), ("--fadix", need), ("--locus", need), ("--heat", {"default": "obs"}), ("--out-prefix", need), *figure)
    command("project", "all steps of the species and pairs of a settings file that are not done yet", ("--config", need), ("--work", {"default": "."}), ("--dry-run", {"action": "store_true"}))
    return top


def _lifted(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, int]:
    rows = T.read_lift(spark, a.liftover)
    return rows, T.read_fai(spark, a.fadix), P.infer_resolution(rows.where("line is not null")).first().resolution


def asm2link(spark: SparkSession, a: argparse.Namespace) -> None:
    tool = shutil.which("minimap2") or sys.exit("minimap2 was not found")
    paf = f"{a.out_prefix}.paf"
    with open(paf, "w") as out:
        subprocess.run([tool, "-x", a.x, "--secondary=no", "-t", str(os.cpu_count() or 1), a.genome_b, a.genome_a], stdout=out, check=True)
    T.write_rows(S.paf_to_link(T.read_paf(spark, paf), a.min_match).orderBy("line").drop("line"), f"{a.out_prefix}.link")


def link2mark(spark: SparkSession, a: argparse.Namespace) -> None:
    mark = S.link_to_mark(T.read_link(spark, a.link), thr_len=a.thr_len, step_len=a.step_len, dense=not a.no_densify, gap=not a.no_gap)
    T.write_mark(mark, f"{a.out_prefix}.mark")


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    bins, pixels = C.read_map(spark, a.cool)
    size = R.bin_size(bins)
    options = {"max_distance": a.max_distance, "inter": a.inter}
    T.write_contacts(R.contacts(bins, pixels, size, **options), f"{a.out_prefix}.contacts.tsv")
    stats = R.wide_stats(R.distance_stats(R.pixel_values(bins, pixels, size, **options)))
    T.write_rows(stats.select("dist_bins", "n", *(T.formatted(".6g", c).alias(c) for c in stats.columns[2:])), f"{a.out_prefix}.stats.tsv", header=True)


def roughlift(spark: SparkSession, a: argparse.Namespace) -> None:
    T.write_rows(S.rough_lift(T.read_bed(spark, a.track), T.read_mark(spark, a.remap_mark, strict=False), T.read_fai(spark, a.fadix_a), T.read_fai(spark, a.fadix_b)), a.out_bed)


def liftcontacts(spark: SparkSession, a: argparse.Namespace) -> None:
    got = L.Lift(T.read_contacts(spark, a.contact_a), T.read_contacts(spark, a.contact_b), T.read_fai(spark, a.fadix_a), T.read_fai(spark, a.fadix_b), T.read_mark(spark, a.mark), agg_frame=a.agg_frame, model=a.model)
    T.write_lift(got.rows(a.dups_filter), f"{a.out_prefix}.liftContacts")
    T.write_stat(got.stat(), f"{a.out_prefix}.stat")


def contact_stat(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, fai, resolution = _lifted(spark, a)

    def averaged(make) -> DataFrame:
        """The control's mean over the repeats; one repeat is the plain map."""
        maps = [make(str(k + 1)) for k in range(max(1, a.repeats))]
        out = maps[0]
        for other in maps[1:]:
            out = out.union(other)
        return out.groupBy("ix", "iy").agg(F.max("observed").alias("observed"), F.avg("control").alias("control"))

    made = {
        "percentile": lambda s: P.percentile_map(rows, fai, resolution, min_bins=a.min_bins, max_bins=a.max_bins, bins=a.bins, seed=s),
        "distance": lambda s: P.distance_map(rows, max_dist_mb=a.max_dist_mb, bins=a.bins, seed=s),
        "ratio": lambda s: P.ratio_map(rows, max_dist_mb=a.max_dist_mb, xy_range=a.xy_range, bins=a.bins, seed=s),
    }
    maps = {name: written(averaged(make).withColumn("log2_ratio", P.safe_log2(F.col("observed"), F.col("control"))), "map") for name, make in made.items()}
    for name, m in maps.items():
        T.write_rows(m.orderBy("ix", "iy"), f"{a.out_prefix}.{name}_heatmap", header=True)
    T.write_rows(P.map_limits(maps, a.vmax), f"{a.out_prefix}.limits", header=True)


def metric(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, fai, resolution = _lifted(spark, a)
    contacts = P.dedup(rows, fai, resolution).persist()
    for frame in a.frames:
        options = {"frame": frame, "name": a.metric, "max_dist_mb": a.max_dist_mb}
        values = P.metric(contacts, resolution, **options)
        out = f"{a.out_prefix}.{a.metric}.{frame}frame"
        T.write_rows(P.ordered_bedgraph(values, fai), f"{out}.bedGraph")
        span = P.metric_range(values, a.metric)
        if span:
            T.write_rows(P.metric_hist(values, span).orderBy("bin"), f"{out}.hist", header=True)
            if span[1] > span[0]:
                T.write_rows(P.metric_kde(P.metric(P.shuffled_contacts(contacts), resolution, **options), span).orderBy("i"), f"{out}.control", header=True)
    contacts.unpersist()


def lift2cool(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, fai, resolution = _lifted(spark, a)
    contacts = P.dedup(rows, fai, resolution)
    for which, name in (("obs", "observed"), ("ctrl", "control")):
        C.write_map(P.genome_bins(fai, resolution), P.genome_pixels(contacts, fai, resolution, which), f"{a.out_prefix}.{name}", a.assembly)


def plot_cross(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, fai, resolution = _lifted(spark, a)
    contacts = P.dedup(rows, fai, resolution)
    region = P.parse_region(a.locus, {r.chrom: r["size"] for r in fai.collect()})  # a row for each chromosome
    upper, lower = (P.region_matrix(contacts, region, region, resolution, m) for m in P.parse_heat(a.heat))
    T.write_rows(P.split_matrix(upper, lower).orderBy("iy", "ix"), f"{a.out_prefix}.matrix", header=True)


def project(spark: SparkSession, a: argparse.Namespace) -> None:
    for step, due in run_project(spark, a.config, a.work, lambda args: main(args, spark), dry=a.dry_run):
        print("run " if due else "done", step.command, step.target)


#: Flags that only a drawn figure or another execution engine would need.
WITHOUT_EFFECT = ("format", "dpi", "cmap", "label_a", "label_b", "chunksize", "nthreads")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = sys.argv[1:] if args is None else args
    a = parser().parse_args(given)
    for name in WITHOUT_EFFECT:
        if hasattr(a, name) and any(x.split("=")[0] == f"--{name.replace('_', '-')}" for x in given):
            print(f"weftline: --{name.replace('_', '-')} has no effect: results are tables, and Spark deals out the work", file=sys.stderr)
    spark = spark or local_session()
    ship(spark)
    globals()[a.command.replace("-", "_")](spark, a)


if __name__ == "__main__":
    main()
