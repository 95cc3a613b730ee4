"""Synthetic graphs whose every choice is a hash of (seed, graph, position): the same on any cluster, in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import materialize


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 32 bits of the SHA-256 of the parts joined by ':'."""
    text = F.concat_ws(":", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def node_grid(spark: SparkSession, graphs: int, nodes: int) -> DataFrame:
    return spark.range(graphs * nodes).select(F.floor(F.col("id") / nodes).alias("graph_id"), (F.col("id") % nodes).alias("node"))


def connected_skeleton(spark: SparkSession, graphs: int, nodes: int, seed: str) -> DataFrame:
    """Random trees: every node after the first hangs on an earlier one. (graph_id, src, dst) with src < dst."""
    grid = node_grid(spark, graphs, nodes).where("node > 0")
    return grid.select("graph_id", F.floor(uniform(seed, F.col("graph_id"), F.col("node")) * F.col("node")).alias("src"), F.col("node").alias("dst"))


def random_digraph(spark: SparkSession, graphs: int, nodes: int, p: float, seed: str) -> DataFrame:
    """Each ordered pair of different nodes is an edge with probability p."""
    grid = node_grid(spark, graphs, nodes)
    pairs = grid.select("graph_id", F.col("node").alias("src"), F.explode(F.expr(f"sequence(0L, {nodes - 1}L)")).alias("dst")).where("src <> dst")
    return pairs.where(uniform(seed, F.col("graph_id"), F.col("src"), F.col("dst")) < p)


def clique_pairs(spark: SparkSession, graphs: int, low: int, high: int, seed: str) -> DataFrame:
    """Two disjoint cliques of low..high nodes each: (graph_id, src, dst) with src < dst; the second starts at the first's size."""
    size = lambda k: F.floor(low + uniform(seed, F.col("id"), k) * (high - low + 1))
    sizes = spark.range(graphs).select(F.col("id").alias("graph_id"), size("a").alias("a"), size("b").alias("b"))
    nodes = sizes.select("graph_id", "a", F.explode(F.sequence(F.lit(0), F.col("a") + F.col("b") - 1)).alias("src"), (F.col("a") + F.col("b")).alias("n"))
    pairs = nodes.where("src < n - 1").select("graph_id", "a", "src", F.explode(F.sequence(F.col("src") + 1, F.col("n") - 1)).alias("dst"))
    return pairs.where((F.col("src") < F.col("a")) == (F.col("dst") < F.col("a"))).select("graph_id", "src", "dst")


def connectivity_questions(edges: DataFrame, graphs: DataFrame, seed: str) -> DataFrame:
    """(graph_id, u, v) random node pairs of graphs (graph_id, n), u before v."""
    u = F.floor(uniform(seed, F.col("graph_id"), "u") * F.col("n"))
    v = F.floor(uniform(seed, F.col("graph_id"), "v") * (F.col("n") - 1))
    rows = graphs.withColumns({"x": u, "y": v}).withColumn("y", F.when(F.col("y") >= F.col("x"), F.col("y") + 1).otherwise(F.col("y")))
    return rows.select("graph_id", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def geometric_graph(spark: SparkSession, graphs: int, nodes: int, radius: float, seed: str) -> DataFrame:
    """Points in the unit square, joined up to radius: a range join by grid cells of that width."""
    points = node_grid(spark, graphs, nodes).withColumns({"x": uniform(seed, F.col("graph_id"), F.col("node"), "x"), "y": uniform(seed, F.col("graph_id"), F.col("node"), "y")})
    points = points.withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    near = points.select("graph_id", F.col("node").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.expr("sequence(cx - 1, cx + 1)")).alias("cx"), "cy")
    near = near.withColumn("cy", F.explode(F.expr("sequence(cy - 1, cy + 1)")))
    pairs = points.join(near, ["graph_id", "cx", "cy"]).where("node < dst")
    return pairs.where(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) <= radius * radius).select("graph_id", F.col("node").alias("src"), "dst")


def needle_cells(spark: SparkSession, examples: int, node_counts: list[int], token_counts: list[int], seed: str) -> DataFrame:
    """Needle-in-a-graph designs: (example, cell_n, cell_t, gold_slot, gold_code, codes). All cells of an example share its codes
    and slot order; a smaller cell holds a prefix of a larger one, gold within the smallest."""
    least, most = min(node_counts), max(node_counts)
    pick = lambda key, k: F.floor(uniform(seed, F.col("example"), key) * k)
    code = lambda i: F.concat(F.chr((65 + F.floor(uniform(seed, F.col("example"), i, 0) * 26)).cast("long")), F.lpad(F.floor(uniform(seed, F.col("example"), i, 1) * 10000).cast("string"), 4, "0"))
    base = spark.range(examples).select(F.col("id").alias("example"))
    base = base.withColumns({"gold_slot": pick("gold", least), "codes": F.transform(F.sequence(F.lit(0), F.lit(most - 1)), code)})
    grid = spark.createDataFrame([(n, t) for n in node_counts for t in token_counts], "cell_n int, cell_t int")
    cells = base.crossJoin(F.broadcast(grid)).withColumn("codes", F.slice("codes", F.lit(1), F.col("cell_n")))
    return cells.withColumn("gold_code", F.get("codes", F.col("gold_slot").cast("int"))).select("example", "cell_n", "cell_t", "gold_slot", "gold_code", "codes")


def needle_violations(cells: DataFrame) -> DataFrame:
    """(rule, n) of broken invariants: node count, gold in place, one holder of the gold code, same gold in all cells."""
    size = (F.size("codes") != F.col("cell_n")).cast("long")
    place = ~F.get("codes", F.col("gold_slot").cast("int")).eqNullSafe(F.col("gold_code"))
    holders = (F.size(F.filter("codes", lambda c: c == F.col("gold_code"))) != 1).cast("long")
    single = cells.agg(F.sum(size).alias("node count"), F.sum(place.cast("long")).alias("gold place"), F.sum(holders).alias("single holder"))
    paired = cells.groupBy("example").agg((F.countDistinct("gold_code") != 1).cast("long").alias("x")).agg(F.sum("x").alias("paired gold"))
    both = single.crossJoin(paired)
    return both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n")) for c in both.columns))).alias("x")).select("x.*")


def families(spark: SparkSession, graphs: int, generations: int, children: int, seed: str) -> DataFrame:
    """(graph_id, person, generation, mother, father, gender, born): couples on every level, children 20 to 35 years after
    their mother. Person 0 and 1 found the family; of each couple's children the first marries a newcomer."""
    base = spark.range(graphs).select(F.col("id").alias("graph_id"))
    founder = lambda k, g: F.struct(F.lit(k).cast("long").alias("person"), F.lit(0).alias("generation"), F.lit(None).cast("long").alias("mother"), F.lit(None).cast("long").alias("father"), F.lit(g).alias("gender"), F.floor(1900 + uniform(seed, F.col("graph_id"), k) * 11).alias("born"))
    level = base.select("graph_id", F.explode(F.array(founder(0, "f"), founder(1, "m"))).alias("p")).select("graph_id", "p.*")
    out = level
    for g in range(1, generations):
        first = (g - 1) * (children + 1) + 2
        mother = level.where("gender = 'f'").groupBy("graph_id").agg(F.min("person").alias("mother"), F.min_by("born", "person").alias("mb"))
        father = level.where("gender = 'm'").groupBy("graph_id").agg(F.min("person").alias("father"))
        born = F.floor(F.col("mb") + 20 + uniform(seed, F.col("graph_id"), g, F.col("k")) * 16)
        kids = mother.join(father, "graph_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(children - 1))))
        gender = F.when(F.col("k") == 0, "f").otherwise(F.when(uniform(seed, F.col("graph_id"), g, F.col("k"), "g") < 0.5, "f").otherwise("m"))
        kids = kids.select("graph_id", (F.col("k") + first).cast("long").alias("person"), F.lit(g).alias("generation"), "mother", "father", gender.alias("gender"), born.alias("born"))
        mate = kids.where(F.col("person") == first).select("graph_id", F.lit(first + children).cast("long").alias("person"), F.lit(g).alias("generation"), F.lit(None).cast("long").alias("mother"), F.lit(None).cast("long").alias("father"), F.lit("m").alias("gender"), (F.col("born") - 1).alias("born"))
        out = out.unionByName(kids).unionByName(mate)
        level = materialize(kids.where(F.col("person") == first).unionByName(mate), "couples")
    return out


def kin(people: DataFrame) -> DataFrame:
    """(graph_id, a, relation, b): b is a's parent, child, sibling, grandparent, grandchild, or aunt or uncle."""
    people = materialize(people.select("graph_id", "person", "mother", "father"), "kin-people")
    parent = people.select("graph_id", F.col("person").alias("a"), F.explode(F.array("mother", "father")).alias("b")).where("b is not null")
    child = parent.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))
    via = lambda x, y: x.select("graph_id", "a", F.col("b").alias("c")).join(y.select("graph_id", F.col("a").alias("c"), "b"), ["graph_id", "c"]).select("graph_id", "a", "b").distinct()
    sibling = via(parent, child).where("a <> b")
    named = {"parent": parent, "child": child, "sibling": sibling, "grandparent": via(parent, parent), "grandchild": via(child, child), "aunt_or_uncle": via(parent, sibling)}
    out = None
    for name, rows in named.items():
        rows = rows.select("graph_id", "a", F.lit(name).alias("relation"), "b")
        out = rows if out is None else out.unionByName(rows)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, depth): all descendants along edges, each at its least depth; cycles end where nothing is new."""
    step = edges.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("to"))
    seen = front = materialize(edges.select("graph_id", "src", "dst").distinct().withColumn("depth", F.lit(1).cast("long")), "closure")
    depth = 1
    while not front.isEmpty():
        depth += 1
        new = front.join(step, ["graph_id", "dst"]).select("graph_id", "src", F.col("to").alias("dst")).distinct().join(seen, ["graph_id", "src", "dst"], "left_anti")
        front = materialize(new.withColumn("depth", F.lit(depth).cast("long")), "closure")
        seen = seen.unionByName(front)
        if depth % 16 == 0:
            seen = materialize(seen, "closure")
    return seen
