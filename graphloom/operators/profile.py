"""One-pass column profiles and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _texts(df: DataFrame) -> set[str]:
    return {c for c, t in df.dtypes if t == "string"}


def schema_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col, dtype, null_frac, n_unique, len_p50, len_p95, len_max): all columns in one aggregation."""
    columns, texts, kinds = columns or df.columns, _texts(df), dict(df.dtypes)
    rows = []
    for c in columns:
        size = F.length(c) if c in texts else F.lit(None).cast("int")
        rows.append(F.struct(F.lit(c).alias("col"), F.lit(kinds[c]).alias("dtype"), F.round(F.avg(F.col(c).isNull().cast("double")), 4).alias("null_frac"), F.countDistinct(c).alias("n_unique"), F.percentile(size, F.lit(0.5)).alias("len_p50"), F.percentile(size, F.lit(0.95)).alias("len_p95"), F.max(size).alias("len_max")))
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def kept_columns(df: DataFrame, drop: list[str], threshold: float = 0.95, placeholders: list[str] = ()) -> DataFrame:
    """(col): columns besides keys and time whose share of missing values is at most threshold; placeholders are missing."""
    texts, rows = _texts(df), []
    for c in (c for c in df.columns if c not in drop):
        missing = F.col(c).isNull() | F.col(c).isin(*placeholders) if c in texts and placeholders else F.col(c).isNull()
        rows.append(F.struct(F.lit(c).alias("col"), F.avg(F.coalesce(missing, F.lit(True)).cast("double")).alias("missing")))
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*").where(F.col("missing") <= threshold).select("col")


def anonymizable_columns(tables: dict[str, DataFrame], ratio: float = 0.5) -> DataFrame:
    """(tbl, col): string columns of tables without time that have more different values than ratio of the rows."""
    parts = []
    for name, df in tables.items():
        rows = [F.struct(F.lit(name).alias("tbl"), F.lit(c).alias("col"), F.countDistinct(c).alias("u"), F.count(F.lit(1)).alias("n")) for c in df.columns if c in _texts(df)]
        if rows:
            parts.append(df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts).where(F.col("u") > ratio * F.col("n")).select("tbl", "col")
