"""User code on collections: label functions, batched maps, and registries of text mappings, generators, biases and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Registry:
    """Named functions; an unknown name says which there are."""

    def __init__(self, kind: str):
        self.kind, self.items = kind, {}

    def add(self, name: str) -> Callable:
        def keep(function: Callable) -> Callable:
            if name in self.items:
                raise ValueError(f"{self.kind} {name} is there already")
            self.items[name] = function
            return function

        return keep

    def get(self, name: str) -> Callable:
        if name not in self.items:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self.items)}")
        return self.items[name]


def _arrow_schema(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def map_rows(rows: DataFrame, function: Callable[[dict], dict], schema: str) -> DataFrame:
    """function of each row as a dictionary, in Arrow batches; it must not keep state between rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [field.name for field in arrow]
        for batch in batches:
            made = [function(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m.get(n) for m in made], t) for n, t in zip(names, arrow.types, strict=True)], names)

    arrow = _arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def compute_labels(examples: DataFrame, function: Callable[[dict], list[int]], column: str = "labels") -> DataFrame:
    """Add labels: what function makes of each example, a list of integers as long as the function likes. Other columns stay."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema.fields if f.name != column)
    return map_rows(examples, lambda row: row | {column: function(row)}, f"{fields}, `{column}` array<bigint>")


def map_batches(rows: DataFrame, function: Callable[[list[dict], list[int]], list[dict]], schema: str, order: str, batch_size: int = 1000) -> DataFrame:
    """function of batches of batch_size rows and their indices, in order of a unique column; it may return more or fewer rows.

    Indices are global, from positions.global_index()."""
    from graphloom.operators.positions import global_index

    numbered = global_index(rows, [order], "__index").withColumn("__batch", F.floor(F.col("__index") / batch_size))

    arrow = _arrow_schema(schema)

    def run(key, table):
        import pyarrow as pa

        given = sorted(table.to_pylist(), key=lambda r: r["__index"])
        index = [r["__index"] for r in given]
        made = function([{k: v for k, v in r.items() if not k.startswith("__")} for r in given], index)
        return pa.Table.from_pylist(made, arrow)

    return numbered.groupBy("__batch").applyInArrow(run, schema)


TEXT_MAPPINGS, GENERATORS, BIASES, METRICS = Registry("text mapping"), Registry("generator"), Registry("bias"), Registry("metric")


def text_mapping(name: str, near: int = 0, far: int = 2) -> Callable[[Column, Column, Column], Column]:
    """A factory of column expressions (title, body, dist) -> text, by mode: titles everywhere, or the body up to some distance."""
    return TEXT_MAPPINGS.get(name)(near, far)


@TEXT_MAPPINGS.add("all_titles")
def _all_titles(near: int, far: int):
    return lambda title, body, dist: title


@TEXT_MAPPINGS.add("near_bodies")
def _near_bodies(near: int, far: int):
    return lambda title, body, dist: F.when(dist <= near, F.concat_ws("\n", title, body)).otherwise(title)


@TEXT_MAPPINGS.add("fading_bodies")
def _fading_bodies(near: int, far: int):
    """The whole body up to near, then a share that halves with each step, nothing beyond far."""

    def text(title: Column, body: Column, dist: Column) -> Column:
        left = F.floor(F.length(body) / F.pow(F.lit(2.0), F.greatest(dist - near, F.lit(0)))).cast("int")
        return F.when(dist > far, title).otherwise(F.concat_ws("\n", title, F.substring(body, F.lit(1), left)))

    return text


@METRICS.add("exact_match")
def _exact_match(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg((F.col("pred").eqNullSafe(F.col("gold"))).cast("double")).alias("exact_match"))


@METRICS.add("auroc")
def _auroc(rows: DataFrame, *keys: str) -> DataFrame:
    from graphloom.operators.metrics import auroc

    return auroc(rows, *keys)


def evaluate(rows: DataFrame, metrics: list[str], keys: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Registered metrics side by side: one row for each key. prepare turns raw outputs into what the metrics read."""
    rows = prepare(rows) if prepare else rows
    out = rows.select(*keys).distinct() if keys else None
    for name in metrics:
        part = METRICS.get(name)(rows, *keys)
        out = part if out is None else out.join(part, keys, "left") if keys else out.crossJoin(part)
    return out


def batches_by(rows: DataFrame, sampler: Callable[[Column], Column], key: str, batch: int) -> DataFrame:
    """Add batch and slot: rows in the order that sampler gives to their keys, batch by batch. Ranks come from counts of ranges."""
    from graphloom.operators.positions import global_index

    return global_index(rows.withColumn("__at", sampler(F.col(key))), ["__at", key], "__index").withColumns({"batch": F.floor(F.col("__index") / batch), "slot": F.col("__index") % batch}).drop("__at", "__index")
