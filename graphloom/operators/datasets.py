"""Collections on storage: records of several shapes, chunk folders, shards, cached builds and the configurations behind them."""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.kg import UNLINKED
from graphloom.operators.textgraph import TextGraphs
from graphloom.storage import file_system


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none where there is no such folder."""
    fs, path = file_system(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def normalise_records(records: DataFrame, dataset: str, names: DataFrame | None = None) -> DataFrame:
    """Records of either question set in one shape: (id, entities array, tuples array of (h, r, t), paths array of (root, relations)).

    'named' records have it already. 'coded' ones hold integer ids as text in tuples and path roots, and in entities_cid beside
    entities: ids are decoded by names (id, name); those without a name become UNLINKED, but a topic entity then keeps its
    own name. Every id of a record is looked up in one join. Another dataset is an error.
    """
    columns = ["id", "entities", "tuples", "paths"]
    if dataset == "named":
        return records.select(*columns)
    if dataset != "coded":
        raise ValueError(f"dataset is 'named' or 'coded', not {dataset!r}")
    ends = F.concat(F.transform("tuples", lambda t: t["h"]), F.transform("tuples", lambda t: t["t"]), F.transform("paths", lambda p: p["root"]), F.coalesce("entities_cid", F.array().cast("array<string>")))
    wanted = records.select("id", F.explode(F.array_distinct(ends)).alias("code")).where(F.col("code").rlike("^-?[0-9]+$"))
    known = wanted.join(names.select(F.col("id").cast("string").alias("code"), "name"), "code", "left").select("id", F.struct("code", F.coalesce("name", F.lit(UNLINKED)).alias("name")).alias("x"))
    maps = known.groupBy("id").agg(F.map_from_entries(F.collect_list("x")).alias("decoded"))
    rows = records.join(maps, "id", "left")
    name = lambda x: F.coalesce(F.element_at("decoded", x), x)
    entity = lambda e, i: F.when(F.coalesce(name(F.get("entities_cid", i)), F.lit(UNLINKED)) == UNLINKED, e).otherwise(name(F.get("entities_cid", i)))
    return rows.select(
        "id",
        F.transform("entities", entity).alias("entities"),
        F.transform("tuples", lambda t: F.struct(name(t["h"]).alias("h"), t["r"].alias("r"), name(t["t"]).alias("t"))).alias("tuples"),
        F.transform("paths", lambda p: F.struct(name(p["root"]).alias("root"), p["relations"].alias("relations"))).alias("paths"),
    )


def chunk_paths(spark: SparkSession, folder: str) -> list[str]:
    """Chunks named <first>-<last> of a folder, by number of the first item."""
    named = [(int(m[1]), n) for n in list_names(spark, folder) if (m := re.fullmatch(r"(\d+)-\d+(?:\.\w+)?", n))]
    return [f"{folder}/{name}" for _, name in sorted(named)]


def shard_paths(spark: SparkSession, folder: str, split: str) -> list[str]:
    """Parts of a split: one folder of its name, or <split>_<first>-<end> by end. None is an error."""
    rule = re.compile(re.escape(split) + r"(?:_\d+-(\d+))?(?:\.\w+)?")
    found = sorted((int(m[1] or 0), n) for n in list_names(spark, folder) if (m := rule.fullmatch(n)))
    if not found:
        raise FileNotFoundError(f"no part of split {split!r} in {folder}")
    return [f"{folder}/{name}" for _, name in found]


def load_parts(spark: SparkSession, paths: list[str], label: str | None = None) -> TextGraphs:
    """Collections of several folders as one, in order; label, where given, replaces theirs."""
    if not paths:
        raise FileNotFoundError("no part to load")
    parts = [TextGraphs.load(spark, p) for p in paths]
    return reduce(TextGraphs.union, [p.assign_label(label) for p in parts] if label else parts)


def load_many(spark: SparkSession, root: str, train: list[str], test: list[str]) -> tuple[TextGraphs, dict[str, TextGraphs]]:
    """(all training sets as one, test sets by name): root/<name>/<split>, each labelled with its name, whatever label it bears.
    A graph's dataset is in ds_label, so that equal graph ids of two sets stay apart by (ds_label, graph_id)."""
    if not train:
        raise ValueError("no training set is named")
    load = lambda name, split: TextGraphs.load(spark, f"{root}/{name}/{split}").assign_label(name)
    return reduce(TextGraphs.union, [load(n, "train") for n in train]), {n: load(n, "test") for n in test}


def citation_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, title, body, label, train, val, test) and edges (src, dst) of a citation graph; both ends must be nodes."""
    nodes, edges = (spark.read.parquet(f"{folder}/{n}") for n in ("nodes", "edges"))
    return nodes, checked_edges(nodes, edges)


def checked_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (src, dst); one that ends at no node (node) raises when it is read."""
    for end in ("src", "dst"):
        known = nodes.select(F.col("node").alias(end), F.lit(True).alias("__known"))
        fault = F.raise_error(F.concat(F.lit(f"{end} is no node: "), F.col(end).cast("string"))).cast("boolean")
        edges = edges.join(known, end, "left").where(F.coalesce("__known", fault)).drop("__known")
    return edges.select("src", "dst")


def superset_build(built: dict[str, set[str]], wanted: set[str], exact: str | None = None) -> str:
    """Key of a build that serves wanted columns: exact if it is built, else the one with the fewest columns that has them all
    (first by name). A reader selects its columns, and the scan prunes the rest. None is an error."""
    if exact in built:
        return exact
    able = sorted((len(columns), key) for key, columns in built.items() if wanted <= columns)
    if not able:
        raise FileNotFoundError(f"no build has {sorted(wanted)}; built: {sorted(built)}")
    return able[0][1]


def parse_job_script(text: str, known: set[str] | None = None) -> tuple[str, list[str]]:
    """(module, arguments) of the line 'python -m module ...' of a job script; continued lines are joined."""
    found = re.search(r"^[ \t]*python3?[ \t]+-m[ \t]+(\S+)(.*)$", text.replace("\\\n", " "), re.MULTILINE)
    if not found:
        raise ValueError("the script runs no module")
    if known is not None and found[1] not in known:
        raise ValueError(f"{found[1]} is not among {sorted(known)}")
    return found[1], shlex.split(found[2])


def cache_path(base: str, config: dict, defaults: dict, tags: dict[str, str]) -> str:
    """Folder of a build: base where all of defaults hold, else base__tag_tag..., a tag for each key that always counts or that
    departs from its default. tags: key to format ('q{}'); a format ending in '?' is left out at the default."""
    if all(config.get(k) == v for k, v in defaults.items()):
        return base
    parts = [f.rstrip("?").format(str(config.get(k)).rsplit("/", 1)[-1]) for k, f in tags.items() if not (f.endswith("?") and config.get(k) == defaults.get(k))]
    return f"{base}__{'_'.join(parts)}"


def arm_label(config: dict, features: list[str], heads: dict[str, tuple[str, str]] | None = None) -> str:
    """Name of an ablation arm: 'base', or 'no-a+b' for features that are off. heads: key to (label, feature it stands for)."""
    head, covered = next((pair for key, pair in (heads or {}).items() if config.get(key)), ("", None))
    off = "+".join(f for f in features if not config.get(f) and f != covered)
    if head:
        return f"{head}+no-{off}" if off else head
    return f"no-{off}" if off else "base"


def role_splits(dataset: str, train_on: list[str], evaluate_on: list[str]) -> list[str]:
    """Splits that a run needs of a dataset: train if it trains on it, dev and test if it is evaluated on it."""
    return ["train"] * (dataset in train_on) + ["dev", "test"] * (dataset in evaluate_on)


Rule = tuple[str, Callable[[dict], bool]]


def clash(*keys: str) -> Rule:
    """At most one of keys may be set."""
    return f"at most one of {', '.join(keys)}", lambda c: sum(bool(c.get(k)) for k in keys) <= 1


def at_least(key: str, low: float) -> Rule:
    """The value, or each value of a list, is low or more; a key that is absent is fine."""
    values = lambda c: c.get(key) if isinstance(c.get(key), (list, tuple)) else [c.get(key)]
    return f"{key} of at least {low}", lambda c: all(v is None or v >= low for v in values(c))


def one_of(key: str, *allowed) -> Rule:
    return f"{key} among {list(allowed)}", lambda c: c.get(key) in allowed


def below(key: str, other: str) -> Rule:
    return f"{key} below {other}", lambda c: c.get(key) is None or c.get(other) is None or c[key] < c[other]


def needs(key: str, *others: str) -> Rule:
    """Where key is set, one of others must be, or it would silently do nothing."""
    return f"{key} only with {' or '.join(others)}", lambda c: not c.get(key) or any(c.get(o) for o in others)


#: Rules of a needle grid: content nodes are all but two, a chain of k hops takes k + 1 of them, and a needle leaves slack.
GRID_RULES: list[Rule] = [
    one_of("mode", "data_prep", "train", "grid"),
    at_least("node_counts", 4),
    at_least("train_shards", 1),
    below("train_shard", "train_shards"),
    at_least("code_len", 1),
    at_least("hops", 0),
    at_least("hop_counts", 0),
    clash("hops", "hop_counts"),
    at_least("fan_out", 1),
    ("a chain that fits the smallest graph", lambda c: max([c.get("hops") or 0, *(c.get("hop_counts") or [])]) + 1 <= min(c["node_counts"]) - 2),
    ("fan_out targets besides a node itself", lambda c: c.get("fan_out", 1) <= min(c["node_counts"]) - 3),
    ("a needle and slack in the smallest node", lambda c: c.get("needle_tokens", 0) + c.get("slack", 0) < min(c["token_counts"])),
    clash("magnetic", "magnetic_linear", "magnetic_magnitude", "magnetic_hybrid"),
    needs("magnetic_m_collate", "magnetic", "magnetic_linear", "magnetic_magnitude", "magnetic_hybrid"),
    ("a checkpoint for grid mode", lambda c: c.get("mode") != "grid" or bool(c.get("checkpoint_path"))),
    at_least("k_hop", 0),
]


def config_problems(config: dict, rules: list[Rule] | None = None) -> list[str]:
    """What a configuration breaks, in the order of the rules; a rule that cannot be evaluated counts as broken."""

    def broken(test: Callable[[dict], bool]) -> bool:
        try:
            return not test(config)
        except (KeyError, TypeError, ValueError):
            return True

    return [text for text, test in (GRID_RULES if rules is None else rules) if broken(test)]


def validate(config: dict, rules: list[Rule] | None = None) -> dict:
    """The configuration, or ValueError with all that it breaks."""
    if problems := config_problems(config, rules):
        raise ValueError("needs " + "; ".join(problems))
    return config
