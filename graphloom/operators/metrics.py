"""Scores of predictions, answer sets and experiment records."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def auroc(scores: DataFrame, *keys: str) -> DataFrame:
    """Area under the ROC curve of rows (score, y) by rank sums with average ranks for ties; NaN for a single class.

    Scores are first counted by value, so the ranking window sees distinct scores, not rows."""
    byscore = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = byscore.withColumn("rank", below + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    area = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))
    return sums.select(*keys, F.col("p").alias("n_pos"), F.col("q").alias("n_neg"), F.when((F.col("p") > 0) & (F.col("q") > 0), area).otherwise(F.lit(float("nan"))).alias("auroc"))


def tied_pair_fraction(scores: DataFrame, *keys: str) -> DataFrame:
    """Share of (positive, negative) pairs with equal scores; NaN if a class is empty."""
    byscore = scores.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    sums = byscore.groupBy(*keys).agg(F.sum(F.col("p") * F.col("q")).alias("tied"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.select(*keys, F.when(F.col("p") * F.col("q") > 0, F.col("tied") / (F.col("p") * F.col("q"))).otherwise(F.lit(float("nan"))).alias("tied_fraction"))


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def score_readout(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows (margin, y): AUROC of the sigmoid, number of different scores (6 decimals), mean margin, positive rate."""
    area = auroc(rows.select(*keys, F.col("margin").alias("score"), "y"), *keys)
    rest = rows.groupBy(*keys).agg(F.countDistinct(F.round(sigmoid(F.col("margin")), 6)).alias("n_distinct"), F.avg("margin").alias("margin_mean"), F.avg(F.col("y").cast("double")).alias("pos_rate"))
    return area.join(rest, list(keys)) if keys else area.crossJoin(rest)


def exact_match(rows: DataFrame, *keys: str) -> DataFrame:
    """Exact match and macro-F1 of rows (pred, gold). F1 is over gold classes alone; a prediction outside them counts as a
    false positive of the most frequent gold class (smallest name on ties)."""
    gold = rows.groupBy(*keys, F.col("gold").alias("cls")).agg(F.count(F.lit(1)).alias("support"), F.sum((F.col("pred") == F.col("gold")).cast("long")).alias("tp"))
    pred = rows.groupBy(*keys, F.col("pred").alias("cls")).agg(F.count(F.lit(1)).alias("predicted"))
    on = [*keys, "cls"]
    seen = gold.join(pred, on, "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    stray = pred.join(gold.select(*on), on, "left_anti").groupBy(*keys).agg(F.sum("predicted").alias("stray"))
    seen = seen.join(stray, list(keys), "left") if keys else seen.crossJoin(stray)
    major = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("support"), "cls")) == 1
    seen = seen.withColumn("fp", F.col("predicted") - F.col("tp") + F.when(major, F.coalesce("stray", F.lit(0))).otherwise(0))
    f1 = 2.0 * F.col("tp") / (2.0 * F.col("tp") + F.col("fp") + (F.col("support") - F.col("tp")))
    return seen.groupBy(*keys).agg((F.sum("tp") / F.sum("support")).alias("exact_match"), F.avg(F.when(F.col("tp") > 0, f1).otherwise(0.0)).alias("macro_f1"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval clamped to [0, 1]; (0, 0) for n = 0."""
    p, zz = hits / n, z * z
    centre = (p + zz / (2.0 * n)) / (1.0 + zz / n)
    half = z * F.sqrt(p * (1.0 - p) / n + zz / (4.0 * n * n)) / (1.0 + zz / n)
    zero = F.lit(0.0)
    return F.when(n > 0, F.greatest(zero, centre - half)).otherwise(zero), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(zero)


def coverage_ceilings(per_question: DataFrame, n_max: int, *keys: str) -> DataFrame:
    """Of rows (gold, present): best reachable hits@1, recall and F1, and the same with at most n_max answers given."""
    r = F.when(F.col("gold") > 0, F.col("present") / F.col("gold")).otherwise(0.0)
    cap = F.least(F.col("present"), F.lit(n_max))
    rc = F.when(F.col("gold") > 0, cap / F.col("gold")).otherwise(0.0)
    f1 = lambda x: F.avg(2.0 * x / (1.0 + x))
    return per_question.groupBy(*keys).agg(
        F.avg((F.col("present") >= 1).cast("double")).alias("hits1"), F.avg(r).alias("recall_macro"), (F.sum("present") / F.sum("gold")).alias("recall_micro"),
        f1(r).alias("f1_macro"), F.avg(rc).alias("recall_macro_capped"), (F.sum(cap) / F.sum("gold")).alias("recall_micro_capped"), f1(rc).alias("f1_macro_capped"))


def permutation_p(a: list[float], b: list[float]) -> float:
    """Exact one-sided p of mean(a) - mean(b) over all splits (tolerance 1e-12); for samples of a few seeds."""
    both, k = [*a, *b], len(a)
    total, seen = sum(both), sum(a) / k - sum(b) / len(b)
    splits = [sum(c) / k - (total - sum(c)) / len(b) for c in combinations(both, k)]
    return sum(s >= seen - 1e-12 for s in splits) / len(splits)


def permutation_tests(rows: DataFrame, key: str, max_n: int = 24) -> DataFrame:
    """(key, p) for rows (key, arm 0 or 1, value). All splits are enumerated, so groups over max_n values are an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_n:
            raise ValueError(f"more than {max_n} values in a group")
        a, b = pdf.loc[pdf["arm"] == 1, "value"].tolist(), pdf.loc[pdf["arm"] == 0, "value"].tolist()
        p = permutation_p(a, b) if a and b else float("nan")
        return pd.DataFrame({key: [pdf[key].iloc[0]], "p": [p]})

    return rows.groupBy(key).applyInPandas(run, f"{key} {dict(rows.dtypes)[key]}, p double")


def mean_sd(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean and sample deviation, 0 for a single value."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp(value)).otherwise(0.0).alias("sd"))


def seeds_table(rows: DataFrame, value: str, min_seeds: int, *keys: str) -> DataFrame:
    """Mean and sample deviation in per cent as text, or '?' below min_seeds."""
    cell = F.concat(F.format_string("%.1f", 100 * F.avg(value)), F.lit(" ± "), F.format_string("%.1f", 100 * F.stddev_samp(value)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= min_seeds, cell).otherwise("?").alias("cell"))


def quantile_slices(rows: DataFrame, by: str, value: str, quantiles: list[float]) -> DataFrame:
    """Right-closed buckets of by at its distinct quantiles, with count and mean of value."""
    edges = rows.agg(F.array_distinct(F.expr(f"percentile({by}, array({', '.join(map(str, quantiles))}))")).alias("edges"))
    bucket = F.least(F.greatest(F.size(F.filter("edges", lambda e: e < F.col(by))) - 1, F.lit(0)), F.greatest(F.size("edges") - 2, F.lit(0)))
    return rows.crossJoin(F.broadcast(edges)).groupBy(bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def rank_cells(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """First and second best distinct values (one decimal) by keys."""
    rounded = rows.withColumn("shown", F.round(F.col(value), 1))
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("shown")))
    return rounded.withColumn("place", place).where("place <= 2").withColumn("place", F.col("place").cast("long"))


def latest_by(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """Last-write-wins: of rows with equal keys the one with the largest order; rows with a null key go."""
    rows = rows.dropna(subset=list(keys))
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def best_success(rows: DataFrame, order: str, ok: str, *keys: str) -> DataFrame:
    """As latest_by, but a success is never replaced by a failure."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ok, order)).alias("x")).select(*keys, "x.*")


def constant_columns(runs: DataFrame, columns: list[str]) -> DataFrame:
    """(column, constant): a column is constant if every run has it with one value; never with fewer than two runs."""
    parts = [F.struct(F.lit(c).alias("column"), ((F.count(F.lit(1)) > 1) & (F.count(c) == F.count(F.lit(1))) & (F.countDistinct(c) == 1)).alias("constant")) for c in columns]
    return runs.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def grid_cells(records: DataFrame) -> DataFrame:
    """Pool records (hops, n_nodes, tokens_per_node, n, em, code_acc, packed_len, in_train) by cell with Wilson bounds.

    The metric is code_acc if every record has it, otherwise em."""
    has = records.agg(F.coalesce(F.min(F.col("code_acc").isNotNull()), F.lit(False)).alias("__has"))
    rows = records.crossJoin(F.broadcast(has)).withColumn("metric", F.when(F.col("__has"), F.col("code_acc")).otherwise(F.col("em")))
    out = rows.groupBy("hops", "n_nodes", "tokens_per_node").agg(F.sum(F.round(F.col("metric") * F.col("n"))).cast("long").alias("hits"), F.sum("n").cast("long").alias("total"), F.max("packed_len").alias("packed_len"), F.min("in_train").alias("in_train"), F.count(F.lit(1)).alias("seeds"))
    lo, hi = wilson(F.col("hits"), F.col("total"))
    return out.withColumns({"accuracy": F.col("hits") / F.col("total"), "lo": lo, "hi": hi})


def step_times(samples: DataFrame, window: int, min_span: int = 60) -> DataFrame:
    """Median seconds a step of each run's windows of steps that span at least min_span: rows (run, step, elapsed)."""
    w = samples.groupBy("run", F.floor(F.col("step") / window).alias("w")).agg(F.min("step").alias("s0"), F.max("step").alias("s1"), F.min_by("elapsed", "step").alias("e0"), F.max_by("elapsed", "step").alias("e1"))
    return w.where(F.col("s1") - F.col("s0") >= min_span).withColumn("rate", (F.col("e1") - F.col("e0")) / (F.col("s1") - F.col("s0"))).groupBy("run").agg(F.median("rate").alias("rate"))


def length_summary(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Count, mean, population deviation, extremes and p10, p50, p90, p99 of lengths."""
    p = lambda q: F.expr(f"percentile({column}, {q})")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std_pop"), F.min(column).alias("min"), F.max(column).alias("max"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


def shifted_match(rows: DataFrame, ignore: int = -100) -> DataFrame:
    """(graph_id, hit): whether all supervised labels (graph_id, pos, pred, label) are met by the prediction of the place before;
    nothing supervised is no hit."""
    before = F.lag("pred").over(Window.partitionBy("graph_id").orderBy("pos"))
    met = rows.withColumn("met", F.when(F.col("label") != ignore, F.coalesce(before == F.col("label"), F.lit(False))))
    return met.groupBy("graph_id").agg(F.coalesce(F.min("met"), F.lit(False)).alias("hit"))
