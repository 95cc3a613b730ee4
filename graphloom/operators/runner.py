"""Runs of a sweep and cells of a grid as Spark work: dispatch, records, what is left to do, and checks before anything starts."""

from __future__ import annotations

import json
import shlex
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import sweep as W
from graphloom.operators.datasets import list_names
from graphloom.storage import write_text


def short(value) -> str:
    """A value for a name: lists joined by '-', no slashes or blanks, 24 characters at most."""
    text = "-".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
    return text.replace("/", "-").replace(" ", "")[:24]


def run_names(runs: list[dict]) -> list[str]:
    """A name for each run: its number, then the parameters of the first run that differ between runs."""
    keys = [k for k in (runs[0] if runs else {}) if len({json.dumps(r[k], sort_keys=True) if k in r else None for r in runs}) > 1]
    width = max(4, len(str(len(runs) - 1)))
    return ["_".join([f"{i:0{width}d}", *(f"{k}{short(r[k])}" for k in keys if k in r)]) for i, r in enumerate(runs)]


def module_name(given: str) -> str:
    """a/b/c.py, a/b/c/ or a.b.c as a.b.c."""
    return given.strip().strip("/").removesuffix(".py").replace("/", ".")


def command(module: str, run: dict, name: str, records: str) -> str:
    """A run's command line, quoted for a shell."""
    return shlex.join(["python", "-m", module_name(module), *W.flags(run), "--runs-jsonl", records, "--run-name", name])


def run_sweep(spark: SparkSession, config: dict, task: Callable[[SparkSession, dict], dict], folder: str) -> list[dict]:
    """All runs of a configuration one after another, each as Spark work of task, recorded as it ends under folder, which may lie in any store;
    report.md there sums them up. A run that is recorded already isn't run again; one that fails is recorded with its error, and the
    others go on."""
    path, schema = f"{folder}/runs", "place long, record string"
    old = spark.read.schema(schema).json(path).orderBy("place").collect() if list_names(spark, path) else []
    records = [json.loads(r["record"]) for r in old]
    done = {r["sweep_run"] for r in records if "error" not in r}
    runs = W.expand(config)
    for name, run in zip(run_names(runs), runs, strict=True):
        if name in done:
            continue
        try:
            record = {"sweep_run": name, **run, **task(spark, run)}
        except Exception as fault:  # what a task raises is its own; the sweep goes on
            record = {"sweep_run": name, **run, "error": f"{type(fault).__name__}: {fault}"}
        spark.createDataFrame([(len(records), json.dumps(record))], schema).coalesce(1).write.mode("append").json(path)
        records.append(record)
    write_text(spark, f"{folder}/report.md", W.report(records, folder.rstrip("/").rsplit("/", 1)[-1]))
    return records


def grid_cells(spark: SparkSession, axes: dict[str, list], tokens: str, limit: int) -> DataFrame:
    """Cells of a grid, the product of axes, whose estimated tokens (a SQL expression over the axes) are within limit; with tokens, largest
    first. Axes are short lists, so the product is a few rows."""
    out = spark.range(1)
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("id").withColumn("tokens", F.expr(tokens).cast("long")).where(F.col("tokens") <= limit).orderBy(F.desc("tokens"), *axes)


def run_grid(spark: SparkSession, cells: DataFrame, keys: list[str], score: Callable[[SparkSession, dict], dict], path: str, largest_first: bool = True) -> DataFrame:
    """score each cell, one record for each as JSON lines in a shared folder; cells with a record are left out, so a grid that was cut off goes on
    where it stopped. Returns all records."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields if f.name in keys) + ", record string"
    if list_names(spark, path):
        cells = cells.join(spark.read.schema(schema).json(path), keys, "left_anti")
    order = F.desc("tokens") if largest_first else F.asc("tokens")
    for cell in cells.orderBy(order, *keys).collect():
        given = cell.asDict()
        row = [tuple(given[f.name] for f in cells.schema.fields if f.name in keys) + (json.dumps(score(spark, given), sort_keys=True),)]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").json(path)
    return spark.read.schema(schema).json(path)


def preflight(config: dict, known: set[str], features: Callable[[dict], set[str]] | None = None, intended: dict[str, set[str]] | None = None, build_key: Callable[[dict], str] | None = None) -> dict:
    """Checks before a sweep starts: {runs, unknown: parameters that no run takes, wrong: runs whose arm has other features than intended,
    duplicates: runs equal to an earlier one, builds: different datasets that must be built}."""
    runs = W.expand(config)
    names = run_names(runs)
    seen: dict[str, str] = {}
    twice = [n for n, r in zip(names, runs, strict=True) if seen.setdefault(W.identity(r), n) != n]
    wrong = [n for n, r in zip(names, runs, strict=True) if features and intended and r.get("arm") in intended and features(r) != intended[r["arm"]]]
    return {
        "runs": len(runs),
        "unknown": sorted({k for r in runs for k in r} - known),
        "wrong": wrong,
        "duplicates": twice,
        "builds": len({build_key(r) for r in runs}) if build_key else len({W.identity(r) for r in runs}),
    }


class Modes:
    """Functions by mode of an experiment; an unknown mode says which there are."""

    def __init__(self):
        self.table: dict[str, Callable] = {}

    def mode(self, name: str) -> Callable:
        return lambda function: self.table.setdefault(name, function)

    def run(self, spark: SparkSession, config: dict):
        if config.get("mode") not in self.table:
            raise ValueError(f"mode is one of {sorted(self.table)}, not {config.get('mode')!r}")
        return self.table[config["mode"]](spark, config)
