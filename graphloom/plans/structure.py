"""Queries of structural features. Small graphs: a user's event types, joined by their consecutive events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import structure as S
from graphloom.plans.registry import register
from graphloom.storage import read_table

#: Event types by number, in name order.
TYPES = ("click", "error", "purchase", "signup", "view")
NUM_SQL = "CASE event_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES)) + " END"
GRAPH_SQL = f"""WITH RECURSIVE seq AS (SELECT user_id AS graph_id, event_id, ({NUM_SQL})::BIGINT AS node FROM events),
nxt AS (SELECT graph_id, node AS src, lead(node) OVER (PARTITION BY graph_id ORDER BY event_id) AS dst FROM seq),
nodes AS (SELECT DISTINCT graph_id, node FROM seq), edges AS (SELECT DISTINCT graph_id, src, dst FROM nxt WHERE dst IS NOT NULL AND src <> dst)"""


def graphs(spark, sf):
    """Nodes and edges of each user's transition graph, over all events."""
    number = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    seq = read_table(spark, sf, "events").select(F.col("user_id").alias("graph_id"), "event_id", number.alias("node"))
    nxt = seq.select("graph_id", F.col("node").alias("src"), F.lead("node").over(Window.partitionBy("graph_id").orderBy("event_id")).alias("dst"))
    return seq.select("graph_id", "node").distinct(), nxt.where("dst is not null and src <> dst").distinct()


PATHS_SQL = GRAPH_SQL + """, walk AS (SELECT graph_id, node AS i, node AS j, 0 AS d FROM nodes UNION
SELECT walk.graph_id, i, dst, d + 1 FROM walk JOIN edges ON edges.graph_id = walk.graph_id AND src = j WHERE d < 4),
paths AS (SELECT graph_id, i, j, min(d)::BIGINT AS dist FROM walk GROUP BY 1, 2, 3)"""


@register("ALG01_shortest_paths", PATHS_SQL + " SELECT * FROM paths")
def alg01(spark, sf):
    return S.shortest_paths(*graphs(spark, sf), cutoff=4)


@register("ALG02_flat_distances", PATHS_SQL + """ SELECT a.graph_id, sqrt(count(*))::INT AS n, sum(coalesce(dist, 32767))::BIGINT AS total FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id LEFT JOIN paths ON paths.graph_id = a.graph_id AND i = a.node AND j = b.node GROUP BY 1""")
def alg02(spark, sf):
    nodes, edges = graphs(spark, sf)
    flat = S.flat_distances(nodes, S.shortest_paths(nodes, edges, 4))
    return flat.select("graph_id", "n", F.aggregate("spd", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


WALK_SQL = GRAPH_SQL + """, deg AS (SELECT graph_id, src, count(*) AS deg FROM edges GROUP BY 1, 2),
mv AS (SELECT e.graph_id, e.src, e.dst, 1.0::DOUBLE / deg AS w FROM edges e JOIN deg USING (graph_id, src) UNION ALL SELECT graph_id, node, node, 1.0::DOUBLE FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM deg WHERE deg.graph_id = n.graph_id AND deg.src = n.node)),
p0 AS (SELECT graph_id, 0::BIGINT AS t, node AS i, node AS j, 1.0::DOUBLE AS p FROM nodes),
p1 AS (SELECT p.graph_id, 1::BIGINT AS t, i, dst AS j, sum(p * w) AS p FROM p0 p JOIN mv ON mv.graph_id = p.graph_id AND src = j GROUP BY ALL),
p2 AS (SELECT p.graph_id, 2::BIGINT AS t, i, dst AS j, sum(p * w) AS p FROM p1 p JOIN mv ON mv.graph_id = p.graph_id AND src = j GROUP BY ALL),
p3 AS (SELECT p.graph_id, 3::BIGINT AS t, i, dst AS j, sum(p * w) AS p FROM p2 p JOIN mv ON mv.graph_id = p.graph_id AND src = j GROUP BY ALL),
walk AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"""


@register("ALG03_random_walk", WALK_SQL + " SELECT graph_id, t, i, j, round(p, 6) AS p FROM walk")
def alg03(spark, sf):
    return S.random_walk(*graphs(spark, sf), steps=4).withColumn("p", F.round("p", 6))


@register("ALG04_return_probabilities", WALK_SQL + " SELECT graph_id, t, i AS node, round(p, 6) AS p FROM walk WHERE i = j")
def alg04(spark, sf):
    return S.return_probabilities(S.random_walk(*graphs(spark, sf), steps=4)).withColumn("p", F.round("p", 6))


@register("ALG05_laplacian_coordinates", GRAPH_SQL + """ SELECT graph_id, k, true AS solved, true AS scaled FROM (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1), range(2) r(k) WHERE k < n - 1""")
def alg05(spark, sf):
    """Every coordinate is an eigenvector of the Laplacian that is made of the edges, and as long as its eigenvalue says."""
    nodes, edges = graphs(spark, sf)
    rows = S.laplacian_features(nodes, edges, m=2)
    v = rows.select("graph_id", "node", F.posexplode("coordinates").alias("k", "re")).withColumn("im", F.lit(0.0))
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    found = S.eigen_residuals(S.laplacian_entries(nodes, edges), v).join(n, "graph_id").where("k < n - 1")
    length = F.col("n") / F.greatest(F.col("quotient"), F.lit(0.01))
    return found.select("graph_id", F.col("k").cast("long").alias("k"), (F.col("residual") < 1e-6 * F.sqrt("norm")).alias("solved"), (F.abs(F.col("norm") / length - 1) < 1e-6).alias("scaled"))


@register("ALG06_magnetic_eigenpairs", GRAPH_SQL + """ SELECT graph_id, k::BIGINT AS k, true AS solved, true AS valued, true AS rising FROM (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1), range(8) r(k) WHERE k < n""")
def alg06(spark, sf):
    """Every pair solves L v = value v with L made of the edges; all values of a graph come, in rising order."""
    nodes, edges = graphs(spark, sf)
    pairs = S.magnetic_features(nodes, edges, q=0.25, m=8)
    ids = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_set("node")).alias("ids"))
    v = pairs.join(ids, "graph_id").select("graph_id", "k", F.explode(F.arrays_zip(F.col("ids").alias("node"), "re", "im")).alias("x")).select("graph_id", "k", "x.*")
    found = S.eigen_residuals(S.laplacian_entries(nodes, edges, 0.25), v).join(pairs.select("graph_id", "k", "value"), ["graph_id", "k"])
    last = F.lag("value").over(Window.partitionBy("graph_id").orderBy("k"))
    return found.select("graph_id", "k", (F.col("residual") < 1e-6).alias("solved"), ((F.abs(F.col("quotient") - F.col("value")) < 1e-6) & (F.abs(F.col("norm") - 1) < 1e-6)).alias("valued"), F.coalesce(F.col("value") >= last - 1e-9, F.lit(True)).alias("rising"))


KHOP_SQL = GRAPH_SQL + ", one AS (SELECT graph_id, src AS i, dst AS j FROM edges), two AS (SELECT DISTINCT a.graph_id, a.i, b.j FROM one a JOIN one b ON a.graph_id = b.graph_id AND a.j = b.i), khop AS (SELECT * FROM one UNION SELECT * FROM two)"


@register("ALG07_k_hop_pairs", KHOP_SQL + " SELECT * FROM khop")
def alg07(spark, sf):
    return S.k_hop_pairs(graphs(spark, sf)[1], 2)


@register("ALG08_prompt_mask", GRAPH_SQL + """, e AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, dst, src FROM edges), f AS (SELECT * FROM e WHERE src <> 4 AND dst <> 4),
inner_ AS (SELECT graph_id, src AS i, dst AS j FROM f UNION SELECT a.graph_id, a.src, b.dst FROM f a JOIN f b ON a.graph_id = b.graph_id AND a.dst = b.src),
whole AS (SELECT graph_id, src AS i, dst AS j FROM e UNION SELECT a.graph_id, a.src, b.dst FROM e a JOIN e b ON a.graph_id = b.graph_id AND a.dst = b.src)
SELECT * FROM inner_ UNION SELECT * FROM whole WHERE i = 4 OR j = 4 UNION SELECT graph_id, node, node FROM nodes""")
def alg08(spark, sf):
    nodes, edges = graphs(spark, sf)
    return S.prompt_mask(nodes.withColumn("is_prompt", F.col("node") == 4), edges, 2)


@register("ALG09_multi_source_bfs", GRAPH_SQL + """, e AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, dst, src FROM edges), w AS (SELECT graph_id, node, 0 AS d FROM nodes WHERE node IN (0, 1) UNION SELECT w.graph_id, dst, d + 1 FROM w JOIN e ON e.graph_id = w.graph_id AND src = node WHERE d < 3)
SELECT graph_id, node, min(d)::BIGINT AS dist FROM w GROUP BY 1, 2""")
def alg09(spark, sf):
    from graphloom.operators.relational import reachable

    nodes, edges = graphs(spark, sf)
    return reachable(edges, nodes.where("node in (0, 1)"), 3)


@register("ALG10_directed_reach", GRAPH_SQL + """, w AS (SELECT graph_id, node, 0 AS d FROM nodes WHERE node = 0 UNION SELECT w.graph_id, dst, d + 1 FROM w JOIN edges e ON e.graph_id = w.graph_id AND src = node WHERE d < 5)
SELECT graph_id, node, min(d)::BIGINT AS dist FROM w GROUP BY 1, 2""")
def alg10(spark, sf):
    from graphloom.operators.relational import reachable

    nodes, edges = graphs(spark, sf)
    return reachable(edges, nodes.where("node = 0"), 5, directed=True)


@register("ALG12_relation_paths", GRAPH_SQL + """, w AS (SELECT graph_id, node AS root, node, [node] AS seen, '' AS path, 0 AS d FROM nodes WHERE node = 0 UNION ALL
SELECT w.graph_id, root, dst, list_append(seen, dst), ltrim(path || ' r' || src), d + 1 FROM w JOIN edges e ON e.graph_id = w.graph_id AND src = node WHERE d < 3 AND NOT list_contains(seen, dst))
SELECT graph_id, root, node, path FROM w WHERE d > 0""")
def alg12(spark, sf):
    nodes, edges = graphs(spark, sf)
    named = edges.withColumn("relation", F.concat(F.lit("r"), F.col("src").cast("string")))
    return S.relation_paths(named, nodes.where("node = 0"), 3)


@register("ALG14_pairwise_l2", "SELECT a.vec_id AS q, b.vec_id AS id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0")
def alg14(spark, sf):
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return S.pairwise_l2(v, v.where("id % 50 = 0")).withColumn("dist", F.round("dist", 4))


@register("ALG15_distance_bias", PATHS_SQL + " SELECT graph_id, i, j, CASE dist WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.125 END::DOUBLE AS bias FROM paths")
def alg15(spark, sf):
    return S.distance_bias(S.shortest_paths(*graphs(spark, sf), cutoff=4), [0.5, 0.25, 0.125])


@register("ALG18_degrees", GRAPH_SQL + " SELECT graph_id, node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT graph_id, src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT graph_id, dst, 0, 1 FROM edges) GROUP BY 1, 2")
def alg18(spark, sf):
    return S.degrees(graphs(spark, sf)[1])


@register("GRF17_reordered", GRAPH_SQL + """, e AS (SELECT DISTINCT graph_id, least(src, dst) AS a, greatest(src, dst) AS b FROM edges), s AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1), m AS (SELECT graph_id, count(*) AS m FROM e GROUP BY 1)
SELECT graph_id, n::BIGINT AS n, (n * (n - 1) // 2)::BIGINT AS total, true AS measured, coalesce(m = n * (n - 1) // 2, false) AS whole FROM s LEFT JOIN m USING (graph_id)""")
def grf17(spark, sf):
    """A permutation of 0..N-1 whose bandwidth, measured again on the edges, is as told; a complete graph's is N - 1, and only its."""
    nodes, edges = graphs(spark, sf)
    new = S.reordered(nodes, edges)
    at = lambda c: new.select("graph_id", F.col("node").alias(c), F.col("new_node").alias(f"new_{c}"))
    wide = edges.join(at("src"), ["graph_id", "src"]).join(at("dst"), ["graph_id", "dst"]).groupBy("graph_id").agg(F.max(F.abs(F.col("new_src") - F.col("new_dst"))).alias("wide"))
    out = new.groupBy("graph_id").agg(F.countDistinct("new_node").alias("n"), F.sum("new_node").alias("total"), F.max("bandwidth").alias("told"))
    out = out.join(wide, "graph_id", "left").na.fill(0, ["wide"])
    return out.select("graph_id", "n", "total", (F.col("told") == F.col("wide")).alias("measured"), ((F.col("wide") == F.col("n") - 1) & (F.col("n") > 1)).alias("whole"))


@register("GRF18_k_hop_subgraph", GRAPH_SQL + """, w AS (SELECT graph_id, node, 0 AS d FROM nodes WHERE node = 2 UNION SELECT w.graph_id, x, d + 1 FROM w JOIN (SELECT graph_id, src AS y, dst AS x FROM edges UNION SELECT graph_id, dst, src FROM edges) e ON e.graph_id = w.graph_id AND y = node WHERE d < 1), k AS (SELECT DISTINCT graph_id, node FROM w)
SELECT e.graph_id, e.src, e.dst FROM edges e SEMI JOIN k a ON a.graph_id = e.graph_id AND a.node = e.src SEMI JOIN k b ON b.graph_id = e.graph_id AND b.node = e.dst""")
def grf18(spark, sf):
    from graphloom.operators.relational import reachable

    nodes, edges = graphs(spark, sf)
    near = reachable(edges, nodes.where("node = 2"), 1)
    ends = lambda c: near.select("graph_id", F.col("node").alias(c))
    return edges.join(ends("src"), ["graph_id", "src"], "left_semi").join(ends("dst"), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst")


@register("AGG22_structure_stats", GRAPH_SQL + ", d AS (SELECT graph_id, node, count(*) AS deg FROM (SELECT graph_id, src AS node FROM edges UNION ALL SELECT graph_id, dst FROM edges) GROUP BY 1, 2) SELECT graph_id, count(*)::BIGINT AS n_nodes, max(deg)::BIGINT AS max_degree, round(avg(deg), 6) AS mean_degree FROM d GROUP BY 1")
def agg22(spark, sf):
    d = S.degrees(graphs(spark, sf)[1]).withColumn("deg", F.col("out_degree") + F.col("in_degree"))
    return d.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("deg").alias("max_degree"), F.round(F.avg("deg"), 6).alias("mean_degree"))


@register("AGG25_graph_sizes", GRAPH_SQL + ", s AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1), t AS (SELECT graph_id, count(*) AS m FROM edges GROUP BY 1) SELECT round(avg(n), 6) AS mean_nodes, round(stddev_pop(n), 6) AS std_nodes, min(n)::BIGINT AS min_nodes, max(n)::BIGINT AS max_nodes, round(avg(coalesce(m, 0)), 6) AS mean_edges FROM s LEFT JOIN t USING (graph_id)")
def agg25(spark, sf):
    nodes, edges = graphs(spark, sf)
    n, m = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")), edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, "graph_id", "left").agg(F.round(F.avg("n"), 6).alias("mean_nodes"), F.round(F.stddev_pop("n"), 6).alias("std_nodes"), F.min("n").alias("min_nodes"), F.max("n").alias("max_nodes"), F.round(F.avg(F.coalesce("m", F.lit(0))), 6).alias("mean_edges"))


@register("AGG30_shell_audit", PATHS_SQL + ", s AS (SELECT graph_id, i, dist, count(*) AS size FROM paths WHERE i = 0 AND dist > 0 GROUP BY 1, 2, 3) SELECT dist, count(*)::BIGINT AS graphs, round(avg(size), 6) AS shell, round(avg(1.0 / size)::DOUBLE, 6) AS chance FROM s GROUP BY dist")
def agg30(spark, sf):
    s = S.shortest_paths(*graphs(spark, sf), cutoff=4).where("i = 0 and dist > 0").groupBy("graph_id", "dist").agg(F.count(F.lit(1)).alias("size"))
    return s.groupBy("dist").agg(F.count(F.lit(1)).alias("graphs"), F.round(F.avg("size"), 6).alias("shell"), F.round(F.avg(1.0 / F.col("size")), 6).alias("chance"))
