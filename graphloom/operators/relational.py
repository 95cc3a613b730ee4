"""Relational databases as temporal graphs: foreign-key edges, neighbourhoods that never look ahead, and their rewriting."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.storage import materialize, read_table

#: Time of rows of static tables: before any seed.
STATIC = -(2**40)


@dataclass(frozen=True)
class TableSpec:
    pkey: str | None = None
    time: str | None = None
    fkeys: dict[str, str] = field(default_factory=dict)


@dataclass
class Catalog:
    """Tables with their keys and time columns; the DataFrames are read once and shared."""

    tables: dict[str, DataFrame]
    specs: dict[str, TableSpec]

    def link_tables(self) -> list[str]:
        """Tables all of whose columns are keys or time: pure junctions."""
        return [n for n, s in self.specs.items() if s.fkeys and set(self.tables[n].columns) <= {s.pkey, s.time, *s.fkeys}]

    def upto(self, ts: str) -> Catalog:
        """Rows of timed tables after ts are invisible; rows without a time stay."""
        limit = F.lit(ts).cast("timestamp_ntz")
        cut = {n: df.where(F.col(self.specs[n].time).isNull() | (F.col(self.specs[n].time) <= limit)) if self.specs[n].time else df for n, df in self.tables.items()}
        return Catalog(cut, self.specs)


TPCH = {
    "region": TableSpec("r_regionkey"),
    "nation": TableSpec("n_nationkey", None, {"n_regionkey": "region"}),
    "customer": TableSpec("c_custkey", None, {"c_nationkey": "nation"}),
    "supplier": TableSpec("s_suppkey", None, {"s_nationkey": "nation"}),
    "part": TableSpec("p_partkey"),
    "orders": TableSpec("o_orderkey", "o_orderdate", {"o_custkey": "customer"}),
    "lineitem": TableSpec(None, "l_shipdate", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
}


def tpch(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog({n: read_table(spark, sf_dir, n) for n in TPCH}, TPCH)


def seconds(column: Column) -> Column:
    """Unix seconds of a timestamp without zone; null becomes the static sentinel."""
    return F.coalesce(F.unix_seconds(column.cast("timestamp")), F.lit(STATIC))


def fkey_edges(catalog: Catalog, children: list[str] | None = None) -> DataFrame:
    """(child_table, child_key, fkey, parent_table, parent_key), one for each child row and non-null key.

    Keys without a parent row raise when the edges are read; children are tables with a primary key.
    """
    parts = []
    for name, spec in catalog.specs.items():
        if not spec.pkey or not spec.fkeys or children and name not in children:
            continue
        for fkey, parent in spec.fkeys.items():
            known = catalog.tables[parent].select(F.col(catalog.specs[parent].pkey).cast("long").alias("k"), F.lit(True).alias("hit"))
            rows = catalog.tables[name].where(F.col(fkey).isNotNull()).select(F.col(spec.pkey).cast("long").alias("child_key"), F.col(fkey).cast("long").alias("k"))
            checked = rows.join(known, "k", "left").withColumn("k", F.when(F.col("hit"), F.col("k")).otherwise(F.raise_error(F.lit(f"{name}.{fkey} has no {parent} row")).cast("long")))
            parts.append(checked.select(F.lit(name).alias("child_table"), "child_key", F.lit(fkey).alias("fkey"), F.lit(parent).alias("parent_table"), F.col("k").alias("parent_key")))
    return reduce(DataFrame.unionByName, parts)


def temporal_neighbours(seeds: DataFrame, children: DataFrame, fkey: str, key: str, time: str | None, k: int) -> DataFrame:
    """(seed_id, child_key, child_time, rank): of each seed's children at or before its time the k most recent.

    seeds: (seed_id, entity, seed_ts in seconds). The boundary is inclusive; ties go to the smaller key; children without a
    time column, or with a null time, are always eligible. The rank limit stands on the window, so Spark drops
    losing rows before they are shuffled.
    """
    stamp = seconds(F.col(time)) if time else F.lit(STATIC)
    rows = children.select(F.col(fkey).cast("long").alias("entity"), F.col(key).cast("long").alias("child_key"), stamp.alias("child_time"))
    near = seeds.join(rows, "entity").where(F.col("child_time") <= F.col("seed_ts"))
    order = Window.partitionBy("seed_id").orderBy(F.desc("child_time"), "child_key")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("seed_id", "child_key", "child_time", F.col("rank").cast("long").alias("rank"))


def eligible_degrees(seeds: DataFrame, children: DataFrame, fkey: str, time: str | None) -> DataFrame:
    """(seed_id, degree): children at or before the seed's time, 0 where there are none."""
    stamp = seconds(F.col(time)) if time else F.lit(STATIC)
    rows = children.select(F.col(fkey).cast("long").alias("entity"), stamp.alias("child_time"))
    near = seeds.join(rows, "entity").where(F.col("child_time") <= F.col("seed_ts")).groupBy("seed_id").agg(F.count(F.lit(1)).alias("degree"))
    return seeds.select("seed_id").join(near, "seed_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def distribution(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """Mean, exact linear percentiles, maximum and share of zeros by keys."""
    p = lambda q: F.expr(f"percentile({column}, {q})")
    return values.groupBy(*keys).agg(F.round(F.avg(column), 6).alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max(column).alias("max"), F.round(F.avg((F.col(column) == 0).cast("double")), 6).alias("zero_frac"))


def candidate_order(candidates: DataFrame) -> DataFrame:
    """Add order: within a seed and table by hop, then most recent, then row. Rows (seed_id, tbl, row, hop, ts)."""
    order = Window.partitionBy("seed_id", "tbl").orderBy("hop", F.desc("ts"), "row")
    return candidates.withColumn("order", F.row_number().over(order).cast("long"))


def even_split(ordered: DataFrame, budget: int) -> DataFrame:
    """Keep of each seed at most budget candidates, split evenly over its tables, each table's first ones.

    Taking turns does it: first the first row of every table, then the second of each, and so on, tables in name order. What
    a short table leaves goes to the others, and the remainder to the first tables that still have rows. The rank limit
    stands on the window, so losing rows go before they are shuffled."""
    turns = Window.partitionBy("seed_id").orderBy("order", "tbl", "row")
    return ordered.withColumn("turn", F.row_number().over(turns)).where(F.col("turn") <= budget).drop("turn")


def allocate(candidates: DataFrame, links: DataFrame, link_tables: list[str], budget: int) -> DataFrame:
    """Budgeted selection: the seed row always, then content rows split evenly into the rest of the budget. Rows of link tables
    are structure and free of the budget: one is kept where a neighbour besides the seed is kept.

    links: (seed_id, tbl, row, other_tbl, other), link rows with their neighbours."""
    ordered = candidate_order(candidates)
    content = even_split(ordered.where((F.col("hop") > 0) & ~F.col("tbl").isin(link_tables)), budget - 1)
    ends = content.select("seed_id", F.col("tbl").alias("other_tbl"), F.col("row").alias("other"))
    alive = links.join(ends, ["seed_id", "other_tbl", "other"], "left_semi").select("seed_id", "tbl", "row")
    joined = ordered.where(F.col("tbl").isin(link_tables)).join(alive, ["seed_id", "tbl", "row"], "left_semi").select(*ordered.columns)
    return ordered.where("hop = 0").unionByName(content).unionByName(joined)


def dense_positions(nodes: DataFrame) -> DataFrame:
    """Add pos from 0 in order of (hop, tbl, row) within a seed: the seed is 0."""
    order = Window.partitionBy("seed_id").orderBy("hop", "tbl", "row")
    return nodes.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def clean_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """Distinct edges without self loops."""
    return edges.where("src <> dst").select(*keys, "src", "dst").distinct()


def orient_child_to_parent(edges: DataFrame) -> DataFrame:
    """Rows (graph_id, a, b, a_is_child) as child-to-parent edges, once each."""
    child = F.when(F.col("a_is_child"), F.col("a")).otherwise(F.col("b"))
    parent = F.when(F.col("a_is_child"), F.col("b")).otherwise(F.col("a"))
    return clean_edges(edges.select("graph_id", child.alias("src"), parent.alias("dst")), "graph_id")


def contract_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Replace link nodes by edges between all pairs of their neighbours, from the higher hop to the lower (equal hops:
    lower to higher position), together with the edges that touch no link. nodes: (graph_id, pos, hop, is_link)."""
    link = nodes.where("is_link").select("graph_id", F.col("pos").alias("via"))
    both = edges.select("graph_id", F.col("src").alias("via"), F.col("dst").alias("n")).unionByName(edges.select("graph_id", F.col("dst").alias("via"), F.col("src").alias("n")))
    plain = nodes.where("not is_link").select("graph_id", F.col("pos").alias("n"), "hop")
    near = both.join(link, ["graph_id", "via"], "left_semi").join(plain, ["graph_id", "n"]).distinct()
    x, y = near.alias("x"), near.alias("y")
    pairs = x.join(y, F.expr("x.graph_id = y.graph_id and x.via = y.via and x.n < y.n"))
    down = F.col("x.hop") >= F.col("y.hop")
    made = pairs.select("x.graph_id", F.when(down, F.col("x.n")).otherwise(F.col("y.n")).alias("src"), F.when(down, F.col("y.n")).otherwise(F.col("x.n")).alias("dst"))
    kept = edges.join(plain.select("graph_id", F.col("n").alias("src")), ["graph_id", "src"], "left_semi").join(plain.select("graph_id", F.col("n").alias("dst")), ["graph_id", "dst"], "left_semi")
    return clean_edges(kept.unionByName(made), "graph_id")


def reachable(edges: DataFrame, sources: DataFrame, max_hops: int | None = None, directed: bool = False) -> DataFrame:
    """(graph_id, node, dist): nodes within max_hops (all, where None) of a graph's sources (graph_id, node), by frontier joins.

    Each hop is written to the shared folder; the loop ends when a frontier is empty, and now and then what was seen is
    written anew, so that plans stay short."""
    step = edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("to"))
    if not directed:
        step = step.unionByName(edges.select("graph_id", F.col("dst").alias("node"), F.col("src").alias("to"))).distinct()
    seen = front = materialize(sources.select("graph_id", "node").distinct().withColumn("dist", F.lit(0).cast("long")), "frontier")
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        new = front.join(step, ["graph_id", "node"]).select("graph_id", F.col("to").alias("node")).distinct().join(seen, ["graph_id", "node"], "left_anti")
        front = materialize(new.withColumn("dist", F.lit(hop).cast("long")), "frontier")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % 16 == 0:
            seen = materialize(seen, "reached")
    return seen


def drop_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (graph_id, pos, ...) of the whole component of position 0, with new gapless positions new_pos."""
    inside = reachable(edges, nodes.where("pos = 0").select("graph_id", F.col("pos").alias("node"))).select("graph_id", F.col("node").alias("pos"))
    order = Window.partitionBy("graph_id").orderBy("pos")
    return nodes.join(inside, ["graph_id", "pos"], "left_semi").withColumn("new_pos", (F.row_number().over(order) - 1).cast("long"))
