"""Questions, runs and outcomes as rows: predicates, gates, batches and report columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.positions import global_index


def answerable(answers: DataFrame) -> DataFrame:
    """(qid, gold, present) of questions with an answer that is in their graph: rows (qid, present boolean), one for each answer."""
    return answers.groupBy("qid").agg(F.count(F.lit(1)).alias("gold"), F.count(F.when(F.col("present"), 1)).alias("present")).where("present > 0")


def scored_once(items: DataFrame, scores: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are in items and have exactly one score that is not null."""
    return items.select(key).join(scores.where(F.col(value).isNotNull()), key).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(key)


def holds(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, yes): whether an entity (id) has a fact (id). Facts are counted by id first, so a hub costs one row."""
    hit = facts.select("id").distinct().withColumn("yes", F.lit(True))
    return entities.select("id").join(hit, "id", "left").select("id", F.coalesce("yes", F.lit(False)).alias("yes"))


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id): ids of first (id, via) whose via is in second (via)."""
    return first.join(second.select("via"), "via", "left_semi").select("id").distinct()


def lacking(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities (id) without a fact (id)."""
    return entities.select("id").join(facts.select("id"), "id", "left_anti")


def bag_gaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): how many rows of a are beyond b, as multisets ('left'), and of b beyond a ('right'); 0 and 0 for a bijection."""
    gap = lambda x, y, side: x.exceptAll(y).agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return gap(a, b, "left").unionByName(gap(b, a, "right"))


def shuffled(key: Column, seed: str) -> Column:
    """A sort key in no order, the same in every run: the SHA-256 of seed and key."""
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def nearest(rows: DataFrame, group: str, dist: Column, key: str, limit: int, seed: str) -> DataFrame:
    """Of each group the limit nearest rows; equal distances are broken by a hash, so that nearer ones never lose. The rank limit stands on the
    window, so losing rows go before they are shuffled."""
    order = Window.partitionBy(group).orderBy(dist, shuffled(F.col(key), seed), key)
    return rows.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= limit).drop("__rank")


def cell_batches(rows: DataFrame, cell: str, key: str, size: int, seed: str) -> DataFrame:
    """Add batch: rows of a cell in a shuffled order, size by size; batches never mix cells. Places come from ranges of (cell, hash), so that a
    cell of any size is split between tasks."""
    placed = global_index(rows.withColumn("__mark", shuffled(F.col(key), seed)), [cell, "__mark", key], "__at")
    first = placed.groupBy(cell).agg(F.min("__at").alias("__first"))
    joined = placed.join(first.withColumnRenamed(cell, "__cell"), F.col(cell).eqNullSafe(F.col("__cell")))
    return joined.withColumn("batch", F.floor((F.col("__at") - F.col("__first")) / size)).drop("__mark", "__at", "__first", "__cell")


def layer_group(layer: Column, groups: int, layers: int) -> Column:
    """Group of a layer: layers in groups of equal length."""
    return F.floor(layer * groups / layers)


def rare_names(rows: DataFrame, name: str, key: str, most: int = 1) -> DataFrame:
    """(name, k): names that at most `most` rows have, with the least key; with 1, names that tell an entity."""
    return rows.groupBy(F.col(name).alias("name")).agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).drop("n")


def first_failing(gates: dict[str, Column], otherwise: str) -> Column:
    """Name of the first gate, in order, whose condition holds."""
    out = None
    for name, failed in gates.items():
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out.otherwise(otherwise)


def size_bin(size: Column, edges: list[int]) -> Column:
    """'<=a', 'a+1-b', ..., '>z' for rising edges."""
    out = F.when(size <= edges[0], f"<={edges[0]}")
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when(size <= high, f"{low + 1}-{high}")
    return out.otherwise(f">{edges[-1]}")


def success_kept(rows: DataFrame, keys: list[str], ok: str, at: str) -> DataFrame:
    """The last row by at of each key, but a success is never replaced by a later failure."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ok, at)).alias("__x")).select(*keys, "__x.*")


def mode_components(rows: DataFrame, key: str, mode: str, value: str, none: str, frozen: str, full: str) -> DataFrame:
    """(key, gather, scatter): what a frozen mode costs beyond none, and a full one beyond frozen, by sums of value."""
    m = rows.groupBy(key).pivot(mode, [none, frozen, full]).agg(F.sum(value))
    return m.select(key, (F.col(frozen) - F.col(none)).alias("gather"), (F.col(full) - F.col(frozen)).alias("scatter"))


def common_seeds(runs: DataFrame) -> DataFrame:
    """(task, seed, arms): seeds of a task that every arm of runs (arm, task, seed) has."""
    n = runs.agg(F.countDistinct("arm").alias("n"))
    return runs.groupBy("task", "seed").agg(F.countDistinct("arm").alias("arms")).join(F.broadcast(n), F.col("arms") == F.col("n"), "left_semi")


def outcome_counts(rows: DataFrame, cell: str, outcome: Column, names: list[str]) -> DataFrame:
    """A column of counts for each outcome by cell."""
    return rows.withColumn("__o", outcome).groupBy(cell).agg(*(F.count(F.when(F.col("__o") == n, 1)).alias(n) for n in names))


def last_label_distribution(rows: DataFrame, labels: Column, yes: int) -> DataFrame:
    """(answer, n): Yes where the last label is that of yes, otherwise No."""
    return rows.groupBy(F.when(F.element_at(labels, -1) == yes, "Yes").otherwise("No").alias("answer")).agg(F.count(F.lit(1)).alias("n"))


def stall_flags(rows: DataFrame, key: str, value: str, most: float = 1.1) -> DataFrame:
    """(key, ratio, stalled): mean over median; above most, a few slow steps make up the mean."""
    t = rows.groupBy(key).agg(F.avg(value).alias("mean"), F.median(value).alias("mid"))
    ratio = F.col("mean") / F.col("mid")
    return t.select(key, ratio.alias("ratio"), (ratio > most).alias("stalled"))


def line_forecast(points: DataFrame, x: str, y: str) -> DataFrame:
    """(x, predicted, error_percent): the line through the two points of least x predicts all others. Different x."""
    pair = points.orderBy(x).limit(2)
    fit = pair.agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min_by(y, x).alias("__y0"), F.max_by(y, x).alias("__y1"))
    guess = F.col("__y0") + (F.col("__y1") - F.col("__y0")) / (F.col("__x1") - F.col("__x0")) * (F.col(x) - F.col("__x0"))
    return points.crossJoin(F.broadcast(fit)).where(F.col(x) > F.col("__x1")).select(x, guess.alias("predicted"), (100 * (guess - F.col(y)) / F.col(y)).alias("error_percent"))


def result_columns(rows: DataFrame, dataset: str, names: list[str], value: Column, metric: str) -> DataFrame:
    """One row with a column eval_<dataset>_<metric> for each named dataset."""
    wide = rows.groupBy().pivot(dataset, names).agg(value.alias(metric))
    return wide.select(*(F.col(f"`{n}`").alias(f"eval_{n}_{metric}") for n in names))


def shape_timing(rows: DataFrame, shape: Column, value: str) -> DataFrame:
    """(shape, median, mean, n, std) of value; the deviation of one is 0."""
    return rows.groupBy(shape.alias("shape")).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def header_edges(rows: DataFrame, seed: str, table: str, row: str) -> DataFrame:
    """(seed_id, src, dst): an edge from each row of a table to the table's header node, once for each seed."""
    return rows.select(F.col(seed).alias("seed_id"), F.lit(f"header:{table}").alias("dst"), F.col(row).alias("src")).distinct()
