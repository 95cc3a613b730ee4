"""Queries of probes, needle texts, biases, spectra, hooks and the runner."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import bias as B
from graphloom.operators import fitting as T
from graphloom.operators import generators as G
from graphloom.operators import hooks as H
from graphloom.operators import probes as P
from graphloom.operators import relational as R
from graphloom.operators import runner as N
from graphloom.operators import structure as S
from graphloom.plans.registry import register
from graphloom.plans.structure import GRAPH_SQL, KHOP_SQL, PATHS_SQL, WALK_SQL, graphs
from graphloom.storage import fresh_path, materialize, read_table

EXAMPLES = 120


def told(examples):
    """Answers of direction probes, found again by searching the graphs."""
    edges = examples.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.*")
    near = R.reachable(edges, examples.select("graph_id", F.col("a").alias("node")), directed=True)
    hit = near.select("graph_id", F.col("node").alias("b"), F.lit(True).alias("hit"))
    return examples.join(hit, ["graph_id", "b"], "left").select("graph_id", F.col("label").eqNullSafe(F.coalesce("hit", F.lit(False))).alias("agrees"))


AGREES_SQL = f"SELECT range AS graph_id, true AS agrees FROM range({EXAMPLES})"


@register("GEN05_direction", AGREES_SQL)
def gen05(spark, sf):
    return told(materialize(P.probe_examples(spark, "direction", EXAMPLES, 8, 16, "p"), "probes"))


@register("GEN05_text_path", AGREES_SQL)
def gen05d(spark, sf):
    """The graph is read back from the texts: who is mentioned in whose lines."""
    x = materialize(P.probe_examples(spark, "text_path", EXAMPLES, 8, 14, "p"), "probes")
    nodes = x.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.*")
    name = F.regexp_extract("text", "^(.*?) likes ", 1)
    people = nodes.select("graph_id", F.col("node").alias("dst"), name.alias("name"))
    mentions = nodes.select("graph_id", F.col("node").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r" is ([A-Z]\w+ [A-Z]\w+)\."), F.lit(1))).alias("name"))
    edges = mentions.join(people, ["graph_id", "name"]).select("graph_id", F.struct("src", "dst").alias("e")).groupBy("graph_id").agg(F.collect_list("e").alias("edges"))
    return told(x.drop("edges").join(edges, "graph_id"))


@register("GEN05_substructure", AGREES_SQL)
def gen05b(spark, sf):
    """A node is on a ring if it survives when leaves are dropped until none is left, and isn't a bridge between rings: rings share nodes."""
    x = materialize(P.probe_examples(spark, "substructure", EXAMPLES, 10, 24, "p"), "probes")
    edges = x.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.*")
    # an edge is on a ring if its ends stay connected without it
    cuts = edges.where("src < dst").select(F.struct("graph_id", "src", "dst").alias("cut"), "graph_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    rest = cuts.join(edges, "graph_id").where("not (src = u and dst = v) and not (src = v and dst = u)")
    text = F.to_json("cut")
    near = R.reachable(rest.select(text.alias("graph_id"), "src", "dst"), cuts.select(text.alias("graph_id"), F.col("u").alias("node")))
    rings = cuts.withColumn("key", text).join(near.select(F.col("graph_id").alias("key"), F.col("node").alias("v")), ["key", "v"], "left_semi").select("graph_id", F.explode(F.array("u", "v")).alias("a")).distinct()
    return x.join(rings.withColumn("hit", F.lit(True)), ["graph_id", "a"], "left").select("graph_id", F.col("label").eqNullSafe(F.coalesce("hit", F.lit(False))).alias("agrees"))


@register("GEN05_local_hop", AGREES_SQL)
def gen05c(spark, sf):
    x = materialize(P.probe_examples(spark, "local_hop", EXAMPLES, 10, 20, "p"), "probes")
    edges = x.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.*")
    near = R.reachable(edges, x.select("graph_id", F.col("a").alias("node")), 2, directed=True).where("dist > 0")
    wanted = x.select("graph_id", F.regexp_extract("question", r"Is there a (\w+) node", 1).alias("colour"), F.explode("nodes").alias("n")).where(F.col("n.text").endswith(F.concat(F.lit(": "), "colour"))).select("graph_id", F.col("n.node").alias("node"))
    hit = wanted.join(near, ["graph_id", "node"], "left_semi").select("graph_id").distinct().withColumn("hit", F.lit(True))
    beyond = wanted.join(near, ["graph_id", "node"], "left_anti").select("graph_id").distinct().withColumn("decoy", F.lit(True))
    out = x.join(hit, "graph_id", "left").join(beyond, "graph_id", "left")
    return out.select("graph_id", (F.col("label").eqNullSafe(F.coalesce("hit", F.lit(False))) & F.coalesce("decoy", F.lit(False))).alias("agrees"))


@register("GEN11_random_texts", "SELECT range AS graph_id, true AS agrees FROM range(80)")
def gen11(spark, sf):
    x = P.probe_examples(spark, "random", 40, 6, 12, "ba").unionByName(P.probe_examples(spark, "random", 40, 4, 7, "gnp", directed=0.4).withColumn("graph_id", F.col("graph_id") + 40))
    x = materialize(x, "random-texts")
    out = x.select("graph_id", F.explode("edges").alias("e")).groupBy("graph_id", F.col("e.src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    top = out.groupBy("graph_id").agg(F.max("deg").alias("top"), F.max(F.when(F.col("node") == 0, F.col("deg"))).alias("own"))
    return x.join(top, "graph_id", "left").select("graph_id", F.col("label").eqNullSafe(F.coalesce(F.col("own") == F.col("top"), F.col("top").isNull())).alias("agrees"))


@register("GEN02_kinship_questions", "SELECT range AS graph_id, true AS right FROM range(40)")
def gen02(spark, sf):
    """As many of the named relatives are as old as the answer, or older, as the question says."""
    p = materialize(G.families(spark, 40, 4, 4, "kq"), "families")
    kin = materialize(G.kin(p), "kin")
    born = p.select("graph_id", F.col("person").alias("b"), "born")
    asked = P.kinship_questions(p, kin, "ask").join(born.select("graph_id", F.col("b").alias("answer"), F.col("born").alias("year")), ["graph_id", "answer"])
    older = asked.join(kin, ["graph_id", "a", "relation"]).join(born, ["graph_id", "b"]).where("born <= year")
    return older.groupBy("graph_id").agg((F.count(F.lit(1)) == F.max("k")).alias("right"))


@register("GEN03_company_graphs", f"""WITH n AS (SELECT g AS graph_id, n AS node, ('0x' || sha256('co:' || g || ':' || n || ':kind')[:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM range(30) a(g), range(40) b(n)),
k AS (SELECT graph_id, node, CASE WHEN node = 1 THEN 'skill' WHEN node = 2 THEN 'project' WHEN node = 0 OR u < 0.55 THEN 'person' WHEN u < 0.75 THEN 'skill' ELSE 'project' END AS kind FROM n),
b AS (SELECT graph_id, node, list_sort((SELECT list(p.node) FROM k p WHERE p.graph_id = k.graph_id AND p.kind = 'person' AND p.node < k.node)) AS above FROM k WHERE kind = 'person' AND node > 0)
SELECT graph_id, node AS src, above[1 + floor(('0x' || sha256('co:' || graph_id || ':' || node || ':boss')[:8])::BIGINT / 4294967296.0::DOUBLE * len(above))::INT] AS dst FROM b""")
def gen03(spark, sf):
    return P.company_graphs(spark, 30, 40, "co")[1].where("relation = 'REPORTS_TO'").select("graph_id", "src", "dst")


@register("GEN03_company_facts", "SELECT g AS graph_id, true AS whole FROM range(30) a(g)")
def gen03b(spark, sf):
    """Every person but the first reports to one person, every person has a skill and works on a project, every project requires a skill."""
    nodes, edges = P.company_graphs(spark, 30, 40, "co")
    out = edges.groupBy("graph_id", F.col("src").alias("node")).pivot("relation", ["REPORTS_TO", "HAS_SKILL", "WORKS_ON", "REQUIRES"]).agg(F.count(F.lit(1)))
    n = nodes.join(out, ["graph_id", "node"], "left").na.fill(0)
    fine = F.when(F.col("kind") == "person", (F.col("REPORTS_TO") == (F.col("node") > 0).cast("int")) & (F.col("HAS_SKILL") > 0) & (F.col("WORKS_ON") > 0)).when(F.col("kind") == "project", F.col("REQUIRES") > 0).otherwise(F.col("REPORTS_TO") + F.col("HAS_SKILL") + F.col("WORKS_ON") + F.col("REQUIRES") == 0)
    return n.groupBy("graph_id").agg(F.min(fine).alias("whole"))


LENGTH_SQL = """WITH h AS (SELECT l_linenumber::BIGINT AS length, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT length, n, sum(n) OVER (ORDER BY length) / (SELECT sum(n) FROM h) AS hi FROM h),
d AS (SELECT o_orderkey AS k, ('0x' || sha256('len:' || o_orderkey)[:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM orders), drawn AS (SELECT k, (SELECT min(length) FROM c WHERE hi > u) AS length FROM d)"""


def lengths(spark, sf):
    histogram = read_table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return P.sampled_lengths(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), histogram, "len", "k"), histogram


@register("GEN08_sampled_lengths", LENGTH_SQL + " SELECT k, length FROM drawn")
def gen08(spark, sf):
    return lengths(spark, sf)[0]


@register("GEN08_length_fidelity", LENGTH_SQL + ", m AS (SELECT length, count(*) AS m FROM drawn GROUP BY 1), b AS (SELECT length, n, coalesce(m, 0) AS m FROM h LEFT JOIN m USING (length)) SELECT round(max(abs(a)), 9) AS distance FROM (SELECT sum(m) OVER w / (SELECT sum(m) FROM m) - sum(n) OVER w / (SELECT sum(n) FROM h) AS a FROM b WINDOW w AS (ORDER BY length))")
def gen08b(spark, sf):
    drawn, histogram = lengths(spark, sf)
    return P.length_fidelity(drawn, histogram).select(F.round("distance", 9).alias("distance"))


NEEDLES = {"node_counts": [8, 16], "token_counts": [32]}


@register("GRF21_star_graphs", "SELECT e AS example, n::INT AS cell_n, (n + 2)::BIGINT AS nodes, n::BIGINT AS edges, 2::BIGINT AS holders FROM range(40) a(e), (VALUES (8), (16)) b(n)")
def grf21(spark, sf):
    cells = materialize(G.needle_cells(spark, 40, **NEEDLES, seed="star"), "cells")
    nodes, edges = P.star_graphs(cells)
    key = ["example", "cell_n"]
    n = nodes.join(cells.select(*key, "gold_code"), key).groupBy(*key).agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.contains("text", F.col("gold_code")), 1)).alias("holders"))
    return n.join(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("edges")), key)


@register("GRF21_chain_graphs", "SELECT e AS example, n::INT AS cell_n, k AS steps, (k = 3) AS ends FROM range(40) a(e), (VALUES (8), (16)) b(n), range(4) c(k)")
def grf21b(spark, sf):
    """From the head of the chain the pointers lead in three steps to the one node that states a code; decoys never get there."""
    nodes, edges = P.chain_graphs(G.needle_cells(spark, 40, **NEEDLES, seed="chain"), 3)
    nodes = materialize(nodes, "chain-nodes")
    key = F.concat_ws(":", "example", "cell_n")
    near = R.reachable(edges.select(key.alias("graph_id"), "src", "dst"), nodes.where("place = 0").select(key.alias("graph_id"), "node"), directed=True)
    found = near.join(nodes.select(key.alias("graph_id"), "node", "example", "cell_n", "text"), ["graph_id", "node"])
    return found.select("example", "cell_n", F.col("dist").alias("steps"), F.contains("text", F.lit("The code of")).alias("ends"))


@register("STR20_bios", "SELECT range AS graph_id, 12::BIGINT AS people, true AS mentioned FROM range(30)")
def str20(spark, sf):
    """Each bio begins with its person's own, unique name and mentions everyone that it is asked to, once."""

    def make(row):
        import random

        rng = random.Random(f"bio:{row['graph_id']}")
        people = P.unique_people(rng, 12)
        bios = [P.person_bio(rng, *people[i], [people[i - 1][0], people[i - 2][0]]) for i in range(12)]
        fine = all(b.startswith(people[i][0] + " likes ") and b.count(people[i - 1][0]) == b.count(people[i - 2][0]) == 1 for i, b in enumerate(bios))
        return {"graph_id": row["graph_id"], "people": len(dict(people)), "mentioned": fine}

    return H.map_rows(spark.range(30).withColumnRenamed("id", "graph_id"), make, "graph_id long, people long, mentioned boolean")


def code_sql(i, kind):
    first, many = (65, 26) if kind == "L" else (48, 10)
    return f"chr(({first} + floor(('0x' || sha256('codes:' || k || ':{i}')[:8])::BIGINT / 4294967296.0::DOUBLE * {many}))::INT)"


@register("ARR08_code_candidates", f"SELECT code, min(k) AS try FROM (SELECT k, {' || '.join(code_sql(i, c) for i, c in enumerate('LLDLL'))} AS code FROM range(20000) a(k)) GROUP BY 1")
def arr08(spark, sf):
    return T.code_candidates(spark, 20000, "codes")


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("ARR08_code_pool", "SELECT 300::BIGINT AS codes, 4::BIGINT AS least, 4::BIGINT AS most, 300::BIGINT AS ids")
def arr08b(spark, sf):
    pool = T.code_pool(spark, 300, 4, tokenizer(), "codes").withColumn("spaced", F.concat(F.lit(" "), "code"))
    facts = T.token_counts(pool, "spaced", tokenizer()).agg(F.countDistinct("code").alias("codes"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most"))
    return facts.crossJoin(F.broadcast(T.id_pool(spark, 300).agg(F.countDistinct("name").alias("ids"))))


@register("ARR07_fitted_texts", "SELECT doc_id, 48::BIGINT AS n_tokens, 1::BIGINT AS needles FROM documents")
def arr07(spark, sf):
    docs = read_table(spark, sf, "documents")
    needle = F.concat(F.lit("The code of NODE-"), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit(" is AB1CD."))
    rows = docs.select("doc_id", F.col("text").alias("filler"), needle.alias("needle"), (F.col("doc_id") % 40).cast("int").alias("offset"))
    out = T.token_counts(T.fit_texts(rows, tokenizer(), 48), "fitted", tokenizer())
    return out.select("doc_id", "n_tokens", F.when(F.contains("fitted", F.col("needle")), 1).otherwise(0).cast("long").alias("needles"))


@register("MDL01_walk_bias", WALK_SQL + """, v AS (SELECT graph_id, i, j, [max(CASE WHEN t = 0 THEN p ELSE 0 END), max(CASE WHEN t = 1 THEN p ELSE 0 END), max(CASE WHEN t = 2 THEN p ELSE 0 END)] AS x FROM walk WHERE i <> j AND t < 3 GROUP BY ALL),
h AS (SELECT *, [greatest(0.5 * x[1] + x[2] - x[3] + 0.1, 0), greatest(2 * x[3] - x[2], 0)] AS h FROM v) SELECT graph_id, i, j, round(h[1] - 0.5 * h[2] + 0.25, 6) AS bias FROM h""")
def mdl01(spark, sf):
    walk = S.random_walk(*graphs(spark, sf), steps=3)
    layers = [([[0.5, 1.0, -1.0], [0.0, -1.0, 2.0]], [0.1, 0.0], "relu"), ([[1.0, -0.5]], [0.25], "none")]
    return B.walk_bias(walk, layers).withColumn("bias", F.round("bias", 6))


#: Real part of the magnetic Laplacian with charge 0.25, from the edges alone.
LAPLACIAN_SQL = GRAPH_SQL + """, ways AS (SELECT graph_id, src AS i, dst AS j, 1.0::DOUBLE AS f, 0.0::DOUBLE AS b FROM edges UNION ALL SELECT graph_id, dst, src, 0.0, 1.0 FROM edges), s AS (SELECT graph_id, i, j, (sum(f) + sum(b)) / 2 AS w, sum(f) - sum(b) AS d FROM ways GROUP BY ALL),
deg AS (SELECT graph_id, i, sum(w) AS deg FROM s GROUP BY ALL), lap AS (SELECT graph_id, i, j, 0.0 - w * cos(2 * pi() * 0.25 * d) / sqrt(x.deg * y.deg) AS v FROM s JOIN deg x USING (graph_id, i) JOIN (SELECT graph_id, i AS j, deg FROM deg) y USING (graph_id, j))"""


@register("MDL02_magnetic_kernel", LAPLACIAN_SQL + """ SELECT a.graph_id, a.node AS i, b.node AS j, round((a.node = b.node)::INT + coalesce(v, 0), 6) + 0.0 AS bias FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id LEFT JOIN lap ON lap.graph_id = a.graph_id AND lap.i = a.node AND lap.j = b.node""")
def mdl02(spark, sf):
    """With the eigenvalue itself as response, all eigenpairs give the Laplacian back, entry by entry."""
    return B.magnetic_bias(*graphs(spark, sf), q=0.25, m=8, response=lambda v: v).withColumn("bias", F.round("bias", 6) + F.lit(0.0))


@register("MDL03_magnitude_head", LAPLACIAN_SQL + """, gram AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1) SELECT a.graph_id, a.node AS i, b.node AS j, round((a.node = b.node)::INT, 6)::DOUBLE AS bias FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id""")
def mdl03(spark, sf):
    """With the response 1 the kernel is the projector on all eigenvectors, the unit matrix."""
    return B.magnetic_bias(*graphs(spark, sf), q=0.25, m=8, response=np.ones_like, head="magnitude").withColumn("bias", F.round("bias", 6) + F.lit(0.0))


@register("MDL03_linear_bias", GRAPH_SQL + """, deg AS (SELECT graph_id, node, sum(o)::DOUBLE AS o, sum(k)::DOUBLE AS k FROM (SELECT graph_id, src AS node, 1 AS o, 0 AS k FROM edges UNION ALL SELECT graph_id, dst, 0, 1 FROM edges) GROUP BY ALL)
SELECT a.graph_id, a.node AS i, b.node AS j, round((a.o + 0.5 * a.k) * (b.k - b.o) + 2 * a.k * b.o, 6) + 0.0 AS bias FROM deg a JOIN deg b USING (graph_id)""")
def mdl03b(spark, sf):
    d = S.degrees(graphs(spark, sf)[1])
    x = d.select("graph_id", "node", F.array(F.col("out_degree").cast("double"), F.col("in_degree").cast("double")).alias("x"))
    return B.linear_bias(x, [[1.0, 0.5], [0.0, 2.0]], [[-1.0, 1.0], [1.0, 0.0]]).withColumn("bias", F.round("bias", 6) + F.lit(0.0))


@register("MDL04_gated_sum", PATHS_SQL + """, khop AS (SELECT graph_id, src AS i, dst AS j FROM edges UNION SELECT a.graph_id, a.src, b.dst FROM edges a JOIN edges b ON a.graph_id = b.graph_id AND a.dst = b.src),
d AS (SELECT graph_id, i, j, CASE dist WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.125 END AS x FROM paths), g AS (SELECT graph_id, src AS i, dst AS j, 1.5 AS x FROM edges)
SELECT k.graph_id, k.i, k.j, round(coalesce(d.x, 0) + coalesce(g.x, 0), 6)::DOUBLE AS bias FROM khop k LEFT JOIN d USING (graph_id, i, j) LEFT JOIN g USING (graph_id, i, j)""")
def mdl04(spark, sf):
    nodes, edges = graphs(spark, sf)
    parts = [H.BIASES.get("distance")(S.shortest_paths(nodes, edges, 4), [0.5, 0.25, 0.125]), edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.5).alias("bias"))]
    return B.combined_bias(parts, S.k_hop_pairs(edges, 2)).withColumn("bias", F.round("bias", 6))


MATRIX_SQL = GRAPH_SQL + """, m AS (SELECT a.graph_id, a.node AS i, b.node AS j, (a.node * b.node % 3)::DOUBLE AS x, ((a.node + 2 * b.node) % 4 / 2.0)::DOUBLE AS y FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id)"""


def matrices(spark, sf):
    nodes, _ = graphs(spark, sf)
    pairs = nodes.select("graph_id", F.col("node").alias("i")).join(nodes.select("graph_id", F.col("node").alias("j")), "graph_id")
    return pairs.withColumn("value", (F.col("i") * F.col("j") % 3).cast("double")), pairs.withColumn("value", ((F.col("i") + 2 * F.col("j")) % 4) / 2.0)


@register("AGG32_row_divergence", MATRIX_SQL + """, z AS (SELECT graph_id, i, ln(sum(exp(x))) AS zx, ln(sum(exp(y))) AS zy FROM m GROUP BY ALL)
SELECT graph_id, round(avg(d), 6) + 0.0 AS kl FROM (SELECT graph_id, i, sum(exp(x - zx) * ((x - zx) - (y - zy))) AS d FROM m JOIN z USING (graph_id, i) GROUP BY ALL) GROUP BY 1""")
def agg32(spark, sf):
    return B.row_divergence(*matrices(spark, sf)).withColumn("kl", F.round("kl", 6) + F.lit(0.0))


@register("AGG32_spectrum_ranks", """WITH v AS (SELECT s_suppkey AS graph_id, k, (k % 5 + 1 + s_suppkey % 3)::DOUBLE ** 2 AS e FROM supplier, range(8) r(k)), o AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY e DESC, k) AS r, sum(e) OVER (PARTITION BY graph_id ORDER BY e DESC, k) AS c, sum(e) OVER (PARTITION BY graph_id) AS t FROM v)
SELECT graph_id, share, min(r)::BIGINT AS rank FROM o, (VALUES (0.9::DOUBLE), (0.99::DOUBLE)) s(share) WHERE c >= share * t * (1 - 1e-12) GROUP BY ALL""")
def agg32b(spark, sf):
    """Diagonal matrices in a hidden basis: their singular values are the diagonal, in any order."""
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("graph_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return B.spectrum_ranks(s.select("graph_id", F.col("k").cast("long").alias("i"), ((3 * F.col("k") + 1) % 8).cast("long").alias("j"), (F.col("k") % 5 + 1 + F.col("graph_id") % 3).cast("double").alias("value")))


@register("AGG34_sampled_density", GRAPH_SQL + """, d AS (SELECT n.graph_id AS key, coalesce(m, 0) / (n.n * n.n)::DOUBLE AS value FROM (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1) n LEFT JOIN (SELECT graph_id, count(*) AS m FROM edges GROUP BY 1) e USING (graph_id)),
s AS (SELECT *, row_number() OVER (ORDER BY sha256('dens:' || key), key) - 1 AS r FROM d QUALIFY r < 100), b AS (SELECT r // 8 AS k, avg(value) AS value FROM s GROUP BY 1)
SELECT 'item' AS level, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev(value), 6) AS std, round(1 - avg(value), 6) AS mean_sparsity FROM s UNION ALL SELECT 'batch', count(*), round(avg(value), 6), round(stddev(value), 6), round(1 - avg(value), 6) FROM b""")
def agg34(spark, sf):
    nodes, edges = graphs(spark, sf)
    n, m = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")), edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))
    density = n.join(m, "graph_id", "left").select(F.col("graph_id").alias("key"), (F.coalesce("m", F.lit(0)) / (F.col("n") * F.col("n"))).alias("value"))
    out = B.sampled_density(density, "key", 8, 100, "dens")
    return out.select("level", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "mean_sparsity")))


@register("AGG40_shifted_match", """WITH t AS (SELECT conv_id, turn, lag(length(coalesce(text, '')) % 5) OVER w AS pred, turn % 5 AS gold, turn >= 2 AS supervised FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS graph_id, coalesce(bool_and(pred = gold) FILTER (supervised), false) AS hit FROM t GROUP BY 1""")
def agg40(spark, sf):
    from graphloom.operators.metrics import shifted_match

    c = read_table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("pos"), (F.length(F.coalesce("text", F.lit(""))) % 5).alias("pred"), F.when(F.col("turn") >= 2, F.col("turn") % 5).otherwise(-100).alias("label"))
    return shifted_match(rows)


@register("TOP07_lowest_eigenpairs", GRAPH_SQL + " SELECT graph_id, least(count(*), 2)::BIGINT AS pairs, true AS lowest FROM nodes GROUP BY 1")
def top07(spark, sf):
    """The two lowest of all eigenvalues of each graph."""
    nodes, edges = graphs(spark, sf)
    few, every = S.magnetic_features(nodes, edges, 0.25, 2), S.magnetic_features(nodes, edges, 0.25, 8)
    top = every.groupBy("graph_id").agg(F.slice(F.array_sort(F.collect_list("value")), 1, 2).alias("least"))
    mine = few.groupBy("graph_id").agg(F.count(F.lit(1)).alias("pairs"), F.array_sort(F.collect_list("value")).alias("mine"))
    near = F.forall(F.zip_with("mine", "least", lambda a, b: F.coalesce(F.abs(a - b) < 1e-9, F.lit(False))), lambda x: x)
    return mine.join(top, "graph_id").select("graph_id", "pairs", near.alias("lowest"))


@register("UDF01_labels", "SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS n, CASE WHEN role = 'assistant' THEN 0 ELSE length(coalesce(text, '')) END::BIGINT AS ignored FROM conversations")
def udf01(spark, sf):
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    out = H.compute_labels(rows, lambda r: [ord(c) if r["role"] == "assistant" else -100 for c in r["text"] or ""])
    return out.select("conv_id", "turn", F.size("labels").cast("long").alias("n"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("ignored"))


@register("UDF02_batched_map", "WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT i // 700 AS batch, count(*)::BIGINT AS n, min(i)::BIGINT AS first, round(sum(o_totalprice), 2) AS total FROM o GROUP BY 1")
def udf02(spark, sf):
    def fold(rows, index):
        return [{"batch": index[0] // 700, "n": len(rows), "first": index[0], "total": sum(r["o_totalprice"] for r in rows)}]

    out = H.map_batches(read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), fold, "batch long, n long, first long, total double", "o_orderkey", 700)
    return out.withColumn("total", F.round("total", 2))


@register("UDF03_text_mapping", "SELECT doc_id, CASE WHEN doc_id % 4 > 2 THEN 'T' || doc_id ELSE 'T' || doc_id || chr(10) || text[:floor(length(text) / (2 ** (doc_id % 4)))::INT] END AS text FROM documents WHERE text IS NOT NULL")
def udf03(spark, sf):
    mapping = H.text_mapping("fading_bodies", near=0, far=2)
    d = read_table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", mapping(F.concat(F.lit("T"), F.col("doc_id").cast("string")), F.col("text"), (F.col("doc_id") % 4).cast("int")).alias("text"))


@register("UDF04_generators", "SELECT * FROM (VALUES ('direction'), ('local_hop'), ('random'), ('substructure'), ('text_path')) t(name)")
def udf04(spark, sf):
    return spark.createDataFrame([(n,) for n in sorted(H.GENERATORS.items)], "name string")


@register("UDF06_biases", "SELECT * FROM (VALUES ('distance'), ('linear'), ('magnetic'), ('walk')) t(name)")
def udf06(spark, sf):
    return spark.createDataFrame([(n,) for n in sorted(H.BIASES.items)], "name string")


@register("UDF07_metric_hooks", "SELECT o_orderpriority AS task, avg(((o_totalprice > 150000) = (o_orderstatus = 'F'))::INT)::DOUBLE AS exact_match FROM orders GROUP BY 1")
def udf07(spark, sf):
    raw = read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_totalprice").alias("margin"), F.col("o_orderstatus").alias("status"))
    return H.evaluate(raw, ["exact_match"], ["task"], lambda df: df.select("task", (F.col("margin") > 150000).alias("pred"), (F.col("status") == "F").alias("gold")))


@register("UDF08_sampler", "WITH m AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY sha256('s:' || p_partkey), p_partkey) - 1 AS i FROM part) SELECT k, i // 32 AS batch, i % 32 AS slot FROM m")
def udf08(spark, sf):
    rows = read_table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    return H.batches_by(rows, lambda k: F.sha2(F.concat(F.lit("s:"), k.cast("string")), 256), "k", 32)


@register("ORC02_sweep_runs", "SELECT '000' || (2 * a + b) || '_cut' || c || '_side' || s AS run, s AS side, c AS cut, (SELECT count(*) FROM orders WHERE o_orderstatus = s AND o_totalprice > c)::BIGINT AS n FROM (VALUES (0, 1000), (1, 200000)) x(a, c), (VALUES (0, 'F'), (1, 'O')) y(b, s)")
def orc02(spark, sf):
    def task(spark, run):
        return {"n": read_table(spark, sf, "orders").where((F.col("o_orderstatus") == run["side"]) & (F.col("o_totalprice") > run["cut"])).count()}

    folder = fresh_path(spark, "sweep")
    records, again = (N.run_sweep(spark, {"name": "s", "cut": [1000, 200000], "side": ["F", "O"]}, task, folder) for _ in range(2))
    if again != records:
        raise ValueError("recorded runs ran again")
    return spark.createDataFrame([(r["sweep_run"], r["side"], r["cut"], r["n"]) for r in records], "run string, side string, cut int, n long")


CELL_AXES = {"nodes": [8, 64, 512], "per_node": [32, 128], "hops": [0, 2]}


@register("ORC06_grid_cells", "SELECT nodes::INT AS nodes, per_node::INT AS per_node, hops::INT AS hops, (nodes * per_node + 20 * hops)::BIGINT AS tokens FROM (VALUES (8), (64), (512)) a(nodes), (VALUES (32), (128)) b(per_node), (VALUES (0), (2)) c(hops) WHERE nodes * per_node + 20 * hops <= 20000")
def orc06(spark, sf):
    return N.grid_cells(spark, CELL_AXES, "nodes * per_node + 20 * hops", 20000)


@register("ORC07_grid_records", "SELECT nodes::INT AS nodes, per_node::INT AS per_node, (nodes * per_node)::BIGINT AS tokens, (SELECT count(*) FROM documents WHERE n_chars > nodes * per_node)::BIGINT AS n FROM (VALUES (8), (64)) a(nodes), (VALUES (32), (128)) b(per_node)")
def orc07(spark, sf):
    cells = N.grid_cells(spark, {"nodes": [8, 64], "per_node": [32, 128]}, "nodes * per_node", 1 << 20)
    path = fresh_path(spark, "grid-records")
    score = lambda spark, cell: {"n": read_table(spark, sf, "documents").where(F.col("n_chars") > cell["tokens"]).count()}
    N.run_grid(spark, cells.where("nodes = 8"), ["nodes", "per_node", "tokens"], score, path)  # cut off, then taken up
    out = N.run_grid(spark, cells, ["nodes", "per_node", "tokens"], score, path)
    return out.select("nodes", "per_node", "tokens", F.get_json_object("record", "$.n").cast("long").alias("n"))


@register("ORC08_preflight", "SELECT 4::BIGINT AS runs, 'typo' AS unknown, 2::BIGINT AS wrong, 0::BIGINT AS duplicates, 2::BIGINT AS builds")
def orc08(spark, sf):
    config = {"name": "s", "typo": 1, "x": [{"arm": "base", "spd": True}, {"arm": "no-spd", "spd": True}], "seed": [0, 1]}
    on = lambda r: {"spd"} if r.get("spd") else set()
    found = N.preflight(config, {"arm", "spd", "seed", "dims"}, on, {"base": {"spd"}, "no-spd": set()}, lambda r: f"{r['seed']}")
    return spark.createDataFrame([(found["runs"], ",".join(found["unknown"]), len(found["wrong"]), len(found["duplicates"]), found["builds"])], "runs long, unknown string, wrong long, duplicates long, builds long")


@register("ORC05_modes", "SELECT count(*)::BIGINT AS n FROM orders")
def orc05(spark, sf):
    modes = N.Modes()
    modes.mode("count")(lambda spark, config: read_table(spark, config["sf"], "orders").agg(F.count(F.lit(1)).alias("n")))
    return modes.run(spark, {"mode": "count", "sf": sf})


@register("STM02_visible_rows", """SELECT 'orders' AS tbl, count(*)::BIGINT AS n FROM orders WHERE o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '1996-06-01'
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate IS NULL OR l_shipdate <= TIMESTAMP '1996-06-01' UNION ALL SELECT 'customer', count(*) FROM customer""")
def stm02(spark, sf):
    """What a query at one time may see: timed rows up to it, and all rows of static tables."""
    seen = R.tpch(spark, sf).upto("1996-06-01")
    out = None
    for name in ("orders", "lineitem", "customer"):
        part = seen.tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("STR21_commands", """SELECT n_nationkey::BIGINT AS k, 'python -m lab.run --max-nodes ' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ' --spd' ELSE ' --no-spd' END || ' --dims 1,2 --note ''' || n_name || ' x'' --runs-jsonl r --run-name ' || lpad(n_nationkey::VARCHAR, 4, '0') AS line FROM nation""")
def str21(spark, sf):
    rows = read_table(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # runs are few
    lines = [(r[0], N.command("lab/run.py", {"max_nodes": r[0], "spd": r[0] % 2 == 0, "dims": [1, 2], "note": f"{r[1]} x", "none": None}, f"{r[0]:04d}", "r")) for r in rows]
    return spark.createDataFrame(lines, "k long, line string")


@register("ORC04_report", """SELECT '| ' || lpad(r_regionkey::VARCHAR, 4, '0') || ' | ' || printf('%.4f', r_regionkey / 3.0) || ' |' AS line FROM region UNION ALL SELECT '- `model` = m'""")
def orc04(spark, sf):
    from graphloom.operators.sweep import report

    runs = [{"sweep_run": f"{r['r_regionkey']:04d}", "model": "m", "score": r["r_regionkey"] / 3.0, "timestamp": 1} for r in read_table(spark, sf, "region").collect()]  # runs are few
    lines = [(x,) for x in report(runs, "s").split("\n") if x.startswith(("| 0", "- "))]
    return spark.createDataFrame(lines, "line string")
