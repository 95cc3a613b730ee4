"""Collections of text graphs as three tables, and their set-like operations. Rows join by key, never by position."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.positions import global_index
from graphloom.storage import file_system, free_name, materialize, put_in_place


@dataclass(frozen=True)
class TextGraphs:
    """graphs (graph_id, version, ...), nodes (graph_id, node, ...), edges (graph_id, src, dst, ...).

    versions: rows of graphs for each logical item. ordering names how nodes are numbered: original, rcm or mixed.
    """

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    versions: int = 1
    ordering: str = "original"

    def select(self, items: DataFrame) -> TextGraphs:
        """The listed items (graph_id) with all their versions, nodes and edges."""
        keep = items.select("graph_id").distinct()
        part = lambda df: df.join(keep, "graph_id", "left_semi")
        return replace(self, graphs=part(self.graphs), nodes=part(self.nodes), edges=part(self.edges))

    def union(self, other: TextGraphs) -> TextGraphs:
        """Bag union; both sides need the same columns and versions."""
        for a, b in ((self.graphs, other.graphs), (self.nodes, other.nodes), (self.edges, other.edges)):
            if sorted(a.columns) != sorted(b.columns):
                raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
        if self.versions != other.versions:
            raise ValueError("numbers of versions differ")
        order = self.ordering if self.ordering == other.ordering else "mixed"
        return TextGraphs(self.graphs.unionByName(other.graphs), self.nodes.unionByName(other.nodes), self.edges.unionByName(other.edges), self.versions, order)

    def assign_label(self, label: str) -> TextGraphs:
        return replace(self, graphs=self.graphs.withColumn("ds_label", F.lit(label)))

    def pick_version(self, epoch: int) -> DataFrame:
        """One version of each item, by the SHA-256 of item and epoch."""
        mark = F.sha2(F.concat_ws(":", F.col("graph_id").cast("string"), F.lit(str(epoch))), 256)
        return self.graphs.where(F.col("version") == F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % self.versions)

    def relabel(self) -> TextGraphs:
        """Number nodes 0..N-1 within each graph in order of their old names, kept as original_id."""
        rank = (F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1).cast("long")
        nodes = self.nodes.withColumn("original_id", F.col("node")).withColumn("node", rank)
        new = nodes.select("graph_id", F.col("original_id").alias("old"), F.col("node").alias("new"))
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(new.withColumnRenamed("old", end), ["graph_id", end]).drop(end).withColumnRenamed("new", end)
        return replace(self, nodes=nodes, edges=edges)

    def save(self, path: str) -> None:
        """Write all parts beside path and put them in place together."""
        spark, fresh = self.graphs.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
        for name in ("graphs", "nodes", "edges"):
            getattr(self, name).write.parquet(f"{fresh}/{name}")
        spark.createDataFrame([(self.versions, self.ordering)], "versions int, ordering string").write.json(f"{fresh}/meta")
        put_in_place(spark, fresh, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextGraphs:
        """A saved collection. One without meta has one version in original order; one without ds_label gets a label that follows from its
        path. A folder that lacks a part is an error."""
        there = lambda name: (found := file_system(spark, f"{path}/{name}"))[0].exists(found[1])
        if missing := [n for n in ("graphs", "nodes", "edges") if not there(n)]:
            raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")
        meta = spark.read.schema("versions int, ordering string").json(f"{path}/meta").first() if there("meta") else None
        graphs, nodes, edges = (spark.read.parquet(f"{path}/{n}") for n in ("graphs", "nodes", "edges"))
        if "ds_label" not in graphs.columns:
            graphs = graphs.withColumn("ds_label", F.lit("ds_" + hashlib.sha256(path.encode()).hexdigest()[:6]))
        return cls(graphs, nodes, edges, (meta and meta["versions"]) or 1, (meta and meta["ordering"]) or "original")


def stride(rows: DataFrame, order: str, limit: int, one_based: bool = False) -> DataFrame:
    """Every s-th row by order, s = max(1, rows // limit): from the first (i % s = 0), or one-based from the s-th."""
    at = free_name(rows, "at")
    step = max(1, rows.count() // limit)
    return global_index(rows, [order], at).where((F.col(at) + int(one_based)) % step == 0).drop(at)


def strided_blocks(rows: DataFrame, order: str, limit: int, block: int = 50) -> DataFrame:
    """At most limit rows (all if they are no more): limit // block runs of block rows, evenly spread in order."""
    n, at = rows.count(), free_name(rows, "at")
    if n <= limit:
        return rows
    return global_index(rows, [order], at).where(F.col(at) % -(-n // (limit // block)) < block).drop(at)


def tail_carve(rows: DataFrame, order: str, num: int, den: int) -> DataFrame:
    """Add split: 'train' for the first num / den of the rows by order, rounded down, 'val' for the tail."""
    at, first = free_name(rows, "at"), rows.count() * num // den
    return global_index(rows, [order], at).withColumn("split", F.when(F.col(at) < first, "train").otherwise("val")).drop(at)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """A fixed draw of n rows by the SHA-256 of seed and key."""
    mark = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("__mark", mark).orderBy("__mark", key).limit(n).drop("__mark")


def row_order_problems(rows: DataFrame, pos: str, row_id: str, contiguous: bool = False) -> DataFrame:
    """(problem, n): missing ids, ids that fall, and with contiguous ids that are not 0..n-1; no row where all is well.

    Falls are sought within ranges of pos, and between the last id of a range and the first of the next one."""
    ranged = materialize(rows.select(F.col(pos).alias("pos"), F.col(row_id).alias("id")).repartitionByRange("pos").withColumn("part", F.spark_partition_id()), "row-order")
    inner = ranged.withColumn("before", F.lag("id").over(Window.partitionBy("part").orderBy("pos"))).where("id <= before").count()
    ends = ranged.groupBy("part").agg(F.min_by("id", "pos").alias("first"), F.max_by("id", "pos").alias("last"))  # a row for each partition
    falls = inner + ends.withColumn("before", F.lag("last").over(Window.orderBy("part"))).where("first <= before").count()
    facts = ranged.agg(F.count(F.lit(1)).alias("rows"), F.count("id").alias("ids"), F.max("id").alias("top"), F.countDistinct("id").alias("different")).first()
    gaps = contiguous and facts["ids"] and (facts["ids"] != facts["top"] + 1 or facts["different"] != facts["ids"])
    found = [("missing", facts["rows"] - facts["ids"]), ("not monotonic", falls), ("not contiguous", int(bool(gaps)))]
    return rows.sparkSession.createDataFrame([f for f in found if f[1]], "problem string, n long")


def split_by_masks(rows: DataFrame) -> DataFrame:
    """Add split: the first of train, val and test whose mask holds, otherwise 'none'."""
    return rows.withColumn("split", F.when(F.col("train"), "train").when(F.col("val"), "val").when(F.col("test"), "test").otherwise("none"))


def incidence(edges: DataFrame) -> DataFrame:
    """Edges to nodes of their own: (graph_id, src, dst) string edges u -> 'u|v' -> v."""
    mid = F.concat_ws("|", F.col("src").cast("string"), F.col("dst").cast("string"))
    first = edges.select("graph_id", F.col("src").cast("string").alias("src"), mid.alias("dst"))
    return first.unionByName(edges.select("graph_id", mid.alias("src"), F.col("dst").cast("string").alias("dst")))


def first_seen(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """Stable distinct: of equal keys the row that comes first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def interleave(rows: DataFrame, group: str, lane: str, idx: str, value: str) -> DataFrame:
    """Round-robin over lanes with repeats of a value dropped: (group, ord, value)."""
    one = first_seen(rows.select(group, value, F.struct(idx, lane).alias("at")), "at", group, value)
    return one.select(group, (F.row_number().over(Window.partitionBy(group).orderBy("at")) - 1).cast("long").alias("ord"), value)
