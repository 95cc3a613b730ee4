"""Experiment sweeps: commented JSON configurations, their expansion to runs, and reports."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.sinks import cell, markdown_table, shown_columns

#: Keys that steer the runner and are no parameters.
RESERVED = ("name", "execution")
_PIECES = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?(?:\*/|\Z)|,(?=\s*[}\]])', re.DOTALL)


class SweepError(ValueError):
    """A configuration that cannot be expanded."""


def parse_config(text: str) -> dict:
    """JSON with // and /* */ comments and trailing commas; strings are left alone."""
    drop = lambda m: m[0] if m[0][0] == '"' else ""
    # comments first, as one may stand between a comma and the bracket
    bare = re.sub(_PIECES, lambda m: m[0] if m[0][0] in '",' else "", text)
    value = json.loads(re.sub(_PIECES, drop, bare))
    if not isinstance(value, dict):
        raise SweepError("a sweep configuration is an object")
    return value


def expand(config: dict) -> list[dict]:
    """Runs of a configuration: lists are axes, a list of objects is one axis whose objects bring their keys."""
    owner: dict[str, str] = {}
    fixed, axes = {}, []
    for key, value in config.items():
        if key in RESERVED:
            continue
        bundle = isinstance(value, list) and any(isinstance(v, dict) for v in value)
        if bundle and not all(isinstance(v, dict) for v in value):
            raise SweepError(f"{key} mixes objects with other values")
        for name in {k for v in value for k in v} if bundle else {key}:
            if owner.setdefault(name, key) != key:
                raise SweepError(f"{name} is set by {owner[name]} and by {key}")
        if isinstance(value, list):
            axes.append([v if bundle else {key: v} for v in value])
        else:
            fixed[key] = value
    return [fixed | dict(kv for part in combo for kv in part.items()) for combo in itertools.product(*axes)]


def identity(config: dict) -> str:
    """Twelve hex digits that name a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def runs_frame(spark: SparkSession, runs: list[dict]) -> DataFrame:
    """(run, key, value as JSON): one row for each parameter of each run."""
    rows = [(i, k, json.dumps(v)) for i, run in enumerate(runs) for k, v in run.items()]
    return spark.createDataFrame(rows, "run long, key string, value string")


def flags(run: dict) -> list[str]:
    """Command-line arguments of a run: true and false as --key and --no-key, lists and maps (k=v) joined by commas; null leaves none."""
    out = []
    for key, value in run.items():
        name = key.replace("_", "-")
        if isinstance(value, bool):
            out.append(f"--{name}" if value else f"--no-{name}")
        elif value is not None:
            parts = [f"{k}={v}" for k, v in value.items()] if isinstance(value, dict) else map(str, value) if isinstance(value, (list, tuple)) else [str(value)]
            out += [f"--{name}", ",".join(parts)]
    return out


def shared_columns(runs: list[dict]) -> tuple[list[str], dict[str, str]]:
    """(columns that vary, shared values as text): a column is shared when two or more runs all have it with one text."""
    texts = {c: [cell(r[c]) for r in runs if c in r] for c in shown_columns(runs)}
    shared = {c: t[0] for c, t in texts.items() if len(runs) == len(t) > 1 and len(set(t)) == 1}
    return [c for c in texts if c not in shared], shared


def report(runs: list[dict], name: str = "") -> str:
    """Markdown: what all runs share, then a row for each in order of sweep_run; runs without one follow by run_name."""
    runs = sorted(runs, key=lambda r: (0, str(r["sweep_run"])) if "sweep_run" in r else (1, str(r.get("run_name") or "")))
    varying, shared = shared_columns(runs)
    parts = [f"# Sweep report: {name}", f"{len(runs)} run(s) recorded."]
    if shared:
        parts += ["Shared across all runs:", "\n".join(f"- `{k}` = {v}" for k, v in shared.items())]
    return "\n\n".join([*parts, markdown_table(runs, varying)]) + "\n"


def write_report(folder: str) -> str:
    """report.md of a folder's runs.jsonl, which need not exist yet; returns the text. For a folder that the driver can open."""
    base = Path(folder)
    file = base / "runs.jsonl"
    runs = [json.loads(line) for line in file.read_text().splitlines() if line.strip()] if file.exists() else []
    text = report(runs, base.name)
    (base / "report.md").write_text(text)
    return text
