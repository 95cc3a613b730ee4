"""Writers: record files, chunked tables, manifests and small reports."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.positions import global_index
from graphloom.storage import file_system, free_name, replace_table


def append_records(records: DataFrame, path: str) -> None:
    """Append JSON lines, each with the time of writing."""
    records.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)


def write_chunks(rows: DataFrame, path: str, per_file: int, order: str) -> None:
    """Parquet in files of at most per_file rows, split by ranges of order, so that file order is row order."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.option("maxRecordsPerFile", per_file).mode("overwrite").parquet(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Build only where nothing is yet: a finished table stays as it is."""
    rows.write.mode("ignore").parquet(path)


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], wait: float = 600.0) -> DataFrame:
    """The table at path, built by one of all jobs that ask for it: the one that creates the lock file builds beside path and renames, the
    others wait for it. A failed build leaves no table and no lock, so that another job takes over."""
    fs, target = file_system(spark, path)
    lock, end = file_system(spark, f"{path}.lock")[1], time.monotonic() + wait
    while not fs.exists(target):
        if fs.createNewFile(lock):
            try:
                if not fs.exists(target):
                    replace_table(build(), path, "parquet")
            finally:
                fs.delete(lock, False)
        elif time.monotonic() > end:
            raise TimeoutError(f"{path} is locked by another build")
        else:
            time.sleep(0.2)
    return spark.read.parquet(path)


def write_shards(rows: DataFrame, path: str, shards: int, order: str) -> None:
    """Contiguous ranges of order as numbered shard folders, of sizes at most one apart, the larger ones first."""
    placed = global_index(rows, [order], free_name(rows, "place"))
    place, n = placed.columns[-1], rows.count()
    small, large = n // shards, n % shards
    at = F.col(place)
    shard = F.when(at < large * (small + 1), F.floor(at / (small + 1))).otherwise(large + F.floor((at - large * (small + 1)) / max(small, 1)))
    placed.withColumn("shard", shard.cast("int")).drop(place).write.partitionBy("shard").mode("overwrite").parquet(path)


def merge_shards(spark: SparkSession, path: str, shards: int, total: int) -> DataFrame:
    """All shards as one table; a missing shard or a wrong total is an error."""
    rows = spark.read.parquet(path)
    seen = rows.agg(F.countDistinct("shard").alias("s"), F.count(F.lit(1)).alias("n")).first()
    if seen["s"] != shards or seen["n"] != total:
        raise ValueError(f"{seen['s']} of {shards} shards with {seen['n']} of {total} rows")
    return rows.drop("shard")


def manifest(rows: DataFrame, **facts) -> str:
    """JSON of the schema, the row count and further facts."""
    return json.dumps({"columns": dict(rows.dtypes), "rows": rows.count(), **facts}, sort_keys=True)


def cell(value) -> str:
    """A value for a report: four decimals, three digits for the very small, lists in brackets, nothing for None."""
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.3g}" if value and abs(value) < 1e-3 else f"{value:.4f}"
    return f"[{','.join(map(str, value))}]" if isinstance(value, (list, tuple)) else str(value)


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def shown_columns(rows: list[dict], hidden: tuple[str, ...] = ("timestamp",)) -> list[str]:
    """All keys in the order of their first appearance, without bookkeeping."""
    return [c for c in dict.fromkeys(c for r in rows for c in r) if c not in hidden]


def markdown_table(rows: list[dict], columns: list[str] | None = None) -> str:
    """Pipe table of few rows: columns of numbers to the right, bars escaped; '(no runs)' for none."""
    if not rows:
        return "(no runs)"
    columns = shown_columns(rows) if columns is None else columns
    given = {c: [r[c] for r in rows if r.get(c) is not None] for c in columns}
    rule = "".join(f" {'---:' if given[c] and all(map(_is_number, given[c])) else '---'} |" for c in columns)
    lines = [columns, *([cell(r.get(c)).replace("|", "\\|") for c in columns] for r in rows)]
    head, *body = ("| " + " | ".join(x) + " |" for x in lines)
    return "\n".join([head, "|" + rule, *body])


def text_table(rows: list[dict], columns: list[str] | None = None) -> str:
    """The same in columns of fixed width, for a terminal."""
    if not rows:
        return "(no runs)"
    columns = shown_columns(rows) if columns is None else columns
    grid = [columns, *([cell(r.get(c)) for c in columns] for r in rows)]
    widths = [max(map(len, column)) for column in zip(*grid, strict=True)]
    grid.insert(1, ["-" * w for w in widths])
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)) for line in grid)


def chat_json(turns: DataFrame) -> DataFrame:
    """(conv_id, value): conversations as JSON {"conversations": [{"from", "value"}, ...]} in order of turn."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.coalesce("text", F.lit("")).alias("value"))))
    pairs = F.transform(parts, lambda p: F.struct(p["from"].alias("from"), p["value"].alias("value")))
    return turns.groupBy("conv_id").agg(F.to_json(F.struct(pairs.alias("conversations"))).alias("value"))


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, value): each graph as JSON {"nodes": [...], "links": [...]}."""
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("id")))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")))).alias("links"))
    return n.join(e, "graph_id", "left").select("graph_id", F.to_json(F.struct("nodes", F.coalesce("links", F.array().cast("array<struct<source:bigint,target:bigint>>")).alias("links"))).alias("value"))
