"""A whole project from one settings file: every species prepared, every pair marked, lifted, measured and exported.

The file (YAML where its library is installed, else JSON) names species (fai, cool), pairs (a, b, link), the cool_group of
multi-resolution maps, and under parameters the further flags of each command as text, by command_parameters. Results lie in
step1 to step3 under the work folder. A step whose result is complete is not run again.
"""

from __future__ import annotations

import json
import os
import shlex
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Step:
    """A command with its flags, and one of the tables that it leaves when it is through."""

    command: str
    flags: tuple[str, ...]
    target: str


def read_settings(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def steps(settings: dict[str, Any], home: str, work: str) -> Iterator[Step]:
    """All steps in an order in which each finds its input. home: the folder that relative paths of the settings start in."""
    species, more = settings["species"], settings.get("parameters") or {}
    at = lambda path: path if "://" in path else os.path.join(home, path)

    def step(command: str, target: str, *flags: str) -> Step:
        own = shlex.split(more.get(f"{command.replace('-', '_')}_parameters") or "")
        return Step(command, (*flags, *own), f"{work}/{target}")

    for name, one in species.items():
        cool = at(one["cool"]).split("::")[0]
        if cool.endswith((".cool", ".mcool")) and settings.get("cool_group"):
            cool += f"::{settings['cool_group']}"
        yield step("prepare", f"step1/{name}/{name}.contacts.tsv", "--cool", cool, "--out-prefix", f"{work}/step1/{name}/{name}")
    for pair in settings["pairs"]:
        a, b = pair["a"], pair["b"]
        for name in (a, b):
            if name not in species:
                raise ValueError(f"the pair {a}, {b} names {name}, which is no species of the settings")
        both = f"{a}_{b}"
        mark, lifted = f"step2/{both}.mark", f"step2/{both}/{both}.liftContacts"
        contact = lambda name: f"{work}/step1/{name}/{name}.contacts.tsv"
        yield step("link2mark", mark, "--link", at(pair["link"]), "--out-prefix", f"{work}/step2/{both}")
        yield step("liftcontacts", lifted, "--contact-a", contact(a), "--contact-b", contact(b), "--fadix-a", at(species[a]["fai"]), "--fadix-b", at(species[b]["fai"]), "--mark", f"{work}/{mark}", "--out-prefix", f"{work}/step2/{both}/{both}")
        common = ("--liftover", f"{work}/{lifted}", "--fadix", at(species[a]["fai"]), "--out-prefix", f"{work}/step3/{both}")
        yield step("contact-stat", f"step3/{both}.ratio_heatmap", *common)
        metric = step("metric", "", *common)
        given = dict(zip(metric.flags, metric.flags[1:]))
        kind = given.get("--metric", "pbad")
        frames = metric.flags[metric.flags.index("--frames") + 1 :] if "--frames" in metric.flags else ("8",)
        for frame in frames:
            if frame.startswith("-"):
                break
            last = frame
        yield Step("metric", metric.flags, f"{work}/step3/{both}.{kind}.{last}frame.bedGraph")
        yield step("lift2cool", f"step3/{both}.control/pixels", *common)


def run(spark: SparkSession, path: str, work: str, execute: Callable[[list[str]], None], *, dry: bool = False) -> list[tuple[Step, bool]]:
    """Every step and whether it was (or with dry, would be) run."""
    hadoop, out = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    for s in steps(read_settings(path), os.path.dirname(os.path.abspath(path)), work):
        done = hadoop.Path(f"{s.target}/_SUCCESS")
        due = not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
        if due and not dry:
            execute([s.command, *s.flags])
        out.append((s, due))
    return out
