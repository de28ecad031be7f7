"""Text formats and the command line, from files to files."""

import glob

import pytest

from weftline import cli
from weftline.sources import adapters as A
from weftline.sources import cooler, text


def lines(path):
    return [x for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f).read().splitlines()]


def put(path, rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_readers_drop_odd_lines(spark, tmp_path):
    fai = text.read_fai(spark, put(tmp_path / "x.fai", ["a\t10\t1", "", "b 20", "a\t30"]))
    assert {(r.chrom, r.ord, r["size"]) for r in fai.collect()} == {("a", 4, 30), ("b", 3, 20)}
    link = text.read_link(spark, put(tmp_path / "x.link", [" A 1 2 B 3 4", "A x 2 B 3 4", "A 1 2", "C 5 6 D 8 7 extra"]))
    assert [tuple(r)[1:] for r in link.orderBy("line").collect()] == [("A", 1, 2, "B", 3, 4), ("C", 5, 6, "D", 8, 7)]
    paf = text.read_paf(spark, put(tmp_path / "x.paf", ["\t".join(["q", "9", "1", "2", "-", "t", "9", "3", "4", "5", "0", "0"]), "q\t1\t2"]))
    assert [tuple(r)[1:] for r in paf.collect()] == [("q", 1, 2, "-", "t", 3, 4, 5)]
    bed = text.read_bed(spark, put(tmp_path / "x.bed", ["c 1 2", "c 3 4 n", "c 3", "c y 4 n"]))
    assert [tuple(r)[1:] for r in bed.orderBy("line").collect()] == [("c", 1, 2, "."), ("c", 3, 4, "n")]
    mids = text.read_bed_midpoints(spark, put(tmp_path / "m.bed", ["# c 1 3", "track", "browser", "c 7 10", "c 1 4", "d 1 2", "c 90 99"]), "c", 0, 50)
    assert [r.x for r in mids.collect()] == [2, 8]
    starts = text.read_bed_midpoints(spark, put(tmp_path / "s.bed", ["c 7 10", "c 1 4", "c 5", "c 60 70"]), "c", 0, 50, use_midpoint=False)
    assert [r.x for r in starts.collect()] == [1, 7]
    track = text.read_bedgraph(spark, put(tmp_path / "x.bg", ["#h", "c 0 10 1.5", "c 0"]))
    assert [tuple(r)[1:] for r in track.collect()] == [("c", 0, 10, 1.5)]
    with pytest.raises(ValueError):
        text.read_contacts(spark, put(tmp_path / "short", ["h", "1 2 3"]))


def test_commands(spark, small, tmp_path):
    run = lambda *args: cli.main([str(x) for x in args], spark)
    at = lambda x: f"{tmp_path}/{x}"
    for g, name in ((0, "a"), (1, "b")):
        cooler.write_map(A.bins(spark, 200), A.pixels(spark, small, g, 200), at(f"{name}.map"), "asm")
        run("prepare", "--cool", at(f"{name}.map"), "--out-prefix", at(name), "--inter")
    for order, name in ((A.ORDER_A, "a"), (A.ORDER_B, "b")):
        put(tmp_path / f"{name}.fai", [f"{c}\t2000000" for c in order])
    rows = lines(at("a.contacts.tsv"))
    assert rows[0].split("\t") == text.CONTACT_COLUMNS and {len(r.split("\t")) for r in rows} == {14}
    assert {len(r.split("\t")) for r in lines(at("a.stats.tsv"))} == {105}
    put(tmp_path / "x.link", ["\t".join(map(str, tuple(r)[1:])) for r in A.links(spark, small, 200).orderBy("line").collect()])
    run("link2mark", "--link", at("x.link"), "-p", at("x"), "--thr-len", 5000, "--step-len", 2500)
    assert len(lines(at("x.mark"))) > 4000
    run("liftcontacts", "--contact-a", at("a.contacts.tsv"), "--contact-b", at("b.contacts.tsv"), "--fadix-a", at("a.fai"), "--fadix-b", at("b.fai"), "--mark", at("x.mark"), "--agg-frame", 80000, "--out-prefix", at("x"))
    from weftline.plans import queries as Q

    lifted = [r.split("\t") for r in lines(at("x.liftContacts")) if not r.startswith("chr1_observed")]
    want = Q.comparison(spark, small).lift().rows().orderBy("line").drop("line").collect()
    assert len(lifted) == len(want) and all(x[:14] == [str(v) for v in tuple(r)[:14]] and float(x[14]) == r[14] and float(x[15]) == r[15] for x, r in zip(lifted, want))
    stat = [r.split() for r in lines(at("x.stat"))]
    assert [s[0] for s in stat] == ["all", "remappable", "processed", "unique", "duplicated", "dropped"] and int(stat[3][1]) + int(stat[4][1]) == len(lifted)
    common = ("--liftover", at("x.liftContacts"), "--fadix", at("a.fai"), "--out-prefix", at("y"))
    run("metric", *common, "--frames", 3, "--metric", "log")
    values = [r.split("\t") for r in lines(at("y.log.3frame.bedGraph"))]
    assert len(values) > 50 and [A.ORDER_A.index(v[0]) for v in values] == sorted(A.ORDER_A.index(v[0]) for v in values)
    assert len(lines(at("y.log.3frame.control"))) >= 400
    run("lift2cool", *common, "--assembly", "asm")
    bins, pixels = cooler.read_map(spark, at("y.control"))
    assert bins.count() == 200 and pixels.count() > 0
    run("plot-cross", *common, "--locus", "c0:0-1,200,000", "--heat", "obs-diff")
    assert lines(at("y.matrix"))[0].split("\t") == ["iy", "ix", "upper", "lower"]
    put(tmp_path / "t.bed", ["chrc0 0 400000 x"])
    run("roughlift", "--track", at("t.bed"), "--fadix-a", at("a.fai"), "--fadix-b", at("b.fai"), "--remap-mark", at("x.mark"), "--out-bed", at("t.out"))
    assert all(r.endswith("\tx") for r in lines(at("t.out")))
    run("contact-stat", *common, "--bins", 10, "--repeats", 2)
    assert len([r for r in lines(at("y.ratio_heatmap")) if not r.startswith("ix")]) == 100


def test_project(spark, small, tmp_path, capsys):
    import json

    for g, order, name in ((0, A.ORDER_A, "a"), (1, A.ORDER_B, "b")):
        cooler.write_map(A.bins(spark, 200), A.pixels(spark, small, g, 200), f"{tmp_path}/{name}.map")
        put(tmp_path / f"{name}.fai", [f"{c}\t2000000" for c in order])
    put(tmp_path / "ab.link", ["\t".join(map(str, tuple(r)[1:])) for r in A.links(spark, small, 200).orderBy("line").collect()])
    settings = {"species": {n: {"fai": f"{n}.fai", "cool": f"{n}.map"} for n in "ab"}, "pairs": [{"a": "a", "b": "b", "link": "ab.link"}], "cool_group": "/resolutions/40000"}
    settings["parameters"] = {"prepare_parameters": "--inter", "link2mark_parameters": "--thr-len 5000 --step-len 2500", "liftcontacts_parameters": "--agg-frame 80000 --dups-filter coverage --model balanced", "contact_stat_parameters": "--bins 10", "metric_parameters": "--frames 3 4 --metric log"}
    path = put(tmp_path / "project.yaml", [json.dumps(settings)])  # JSON is YAML, too
    work = f"{tmp_path}/work"
    shown = lambda *more: (cli.main(["project", "--config", path, "--work", work, *more], spark), [x.split()[:2] for x in capsys.readouterr().out.splitlines()])[1]
    commands = ["prepare", "prepare", "link2mark", "liftcontacts", "contact-stat", "metric", "lift2cool"]
    assert shown("--dry-run") == [["run", c] for c in commands]
    assert shown() == [["run", c] for c in commands] and shown() == [["done", c] for c in commands]
    assert len(lines(f"{work}/step2/a_b/a_b.liftContacts")) > 100 and len(lines(f"{work}/step3/a_b.log.4frame.bedGraph")) > 20
