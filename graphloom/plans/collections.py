"""Queries of sampling, set operations, graph rewriting, knowledge-graph joins and token packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import kg as K
from graphloom.operators import records as Q
from graphloom.operators import textgraph as G
from graphloom.operators import tokens as P
from graphloom.plans.registry import register
from graphloom.storage import read_table


def table(spark, sf, name, *columns):
    return read_table(spark, sf, name).select(*columns) if columns else read_table(spark, sf, name)


@register("FLT01_select_items", "SELECT conv_id, turn::BIGINT AS turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn >= 6)")
def flt01(spark, sf):
    turns = table(spark, sf, "conversations")
    long = turns.where("turn >= 6").select(F.col("conv_id").alias("graph_id"))
    nodes = turns.select(F.col("conv_id").alias("graph_id"), F.col("turn").cast("long").alias("node"))
    return G.TextGraphs(nodes.select("graph_id").distinct(), nodes, nodes.where("false").select("graph_id", F.col("node").alias("src"), F.col("node").alias("dst"))).select(long).nodes.select(F.col("graph_id").alias("conv_id"), F.col("node").alias("turn"))


@register("FLT02_version_pick", "SELECT DISTINCT conv_id AS graph_id, (('0x' || sha256(conv_id || ':1')[:8])::BIGINT % 3)::INT AS version FROM conversations")
def flt02(spark, sf):
    graphs = table(spark, sf, "conversations", F.col("conv_id").alias("graph_id")).distinct().withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return G.TextGraphs(graphs, graphs, graphs, versions=3).pick_version(1)


@register("FLT03_stride", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER () // 40) AS s FROM documents) WHERE i % s = 0")
def flt03(spark, sf):
    return G.stride(table(spark, sf, "documents", "doc_id"), "doc_id", 40)


@register("FLT03_stride_one_based", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, greatest(1, count(*) OVER () // 40) AS s FROM documents) WHERE i % s = 0")
def flt03b(spark, sf):
    return G.stride(table(spark, sf, "documents", "doc_id"), "doc_id", 40, one_based=True)


@register("FLT05_seeded_sample", "SELECT doc_id FROM documents ORDER BY sha256('eval:' || doc_id), doc_id LIMIT 64")
def flt05(spark, sf):
    return G.seeded_sample(table(spark, sf, "documents", "doc_id"), "doc_id", 64, "eval")


@register("FLT06_split_masks", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'train' WHEN doc_id % 3 = 0 THEN 'val' WHEN doc_id % 5 = 0 THEN 'test' ELSE 'none' END AS split FROM documents")
def flt06(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "documents", "doc_id", (d % 2 == 0).alias("train"), (d % 3 == 0).alias("val"), (d % 5 == 0).alias("test"))
    return G.split_by_masks(rows).select("doc_id", "split")


@register("FLT07_tail_carve", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) > count(*) OVER () * 9 // 10 THEN 'val' ELSE 'train' END AS split FROM documents")
def flt07(spark, sf):
    return G.tail_carve(table(spark, sf, "documents", "doc_id"), "doc_id", 9, 10)


@register("FLT09_answerability", "SELECT o_custkey AS qid, count(*)::BIGINT AS gold, sum((o_orderstatus = 'F')::INT)::BIGINT AS present FROM orders GROUP BY 1 HAVING sum((o_orderstatus = 'F')::INT) > 0")
def flt09(spark, sf):
    return Q.answerable(table(spark, sf, "orders", F.col("o_custkey").alias("qid"), (F.col("o_orderstatus") == "F").alias("present")))


@register("FLT15_banned_substring", "SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'license')")
def flt15(spark, sf):
    return table(spark, sf, "documents").where(~F.contains(F.lower("text"), F.lit("license"))).select("doc_id")


@register("FLT16_selected_cells", "SELECT n, t, (n - 2) * t + 64 AS length FROM (VALUES (8), (16), (32)) a(n), (VALUES (32), (64), (128)) b(t) WHERE (n - 2) * t + 64 <= 1000")
def flt16(spark, sf):
    grid = spark.createDataFrame([(n, t) for n in (8, 16, 32) for t in (32, 64, 128)], "n int, t int")
    return grid.withColumn("length", (F.col("n") - 2) * F.col("t") + 64).where("length <= 1000")


@register("FLT18_row_order", "SELECT 'not monotonic' AS problem, count(*)::BIGINT AS n FROM (SELECT v <= lag(v) OVER (ORDER BY event_id) AS bad FROM (SELECT event_id, CASE WHEN event_id % 1000 = 5 THEN event_id - 2 ELSE event_id END AS v FROM events)) WHERE bad")
def flt18(spark, sf):
    v = F.when(F.col("event_id") % 1000 == 5, F.col("event_id") - 2).otherwise(F.col("event_id"))
    return G.row_order_problems(table(spark, sf, "events", "event_id", v.alias("v")), "event_id", "v").where("problem = 'not monotonic'")


@register("SET01_bag_union", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def set01(spark, sf):
    n = table(spark, sf, "nation", F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), "n_regionkey")
    return n.drop("n_regionkey").unionByName(n.where("n_regionkey = 1").drop("n_regionkey"))


@register("SET02_intersect", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set02(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


@register("SET03_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set03(spark, sf):
    return table(spark, sf, "customer", F.col("c_custkey").alias("id")).exceptAll(table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()).distinct()


@register("SET04_multiset_difference", "SELECT o_orderpriority AS item FROM orders WHERE o_custkey % 2 = 0 EXCEPT ALL SELECT o_orderpriority FROM orders WHERE o_custkey % 4 = 0")
def set04(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_custkey % 2 = 0").select(F.col("o_orderpriority").alias("item")).exceptAll(o.where("o_custkey % 4 = 0").select("o_orderpriority"))


@register("SET05_clean_edges", "SELECT DISTINCT l_suppkey % 50 AS src, l_partkey % 50 AS dst FROM lineitem WHERE l_suppkey % 50 <> l_partkey % 50")
def set05(spark, sf):
    from graphloom.operators.relational import clean_edges

    return clean_edges(table(spark, sf, "lineitem", (F.col("l_suppkey") % 50).alias("src"), (F.col("l_partkey") % 50).alias("dst")))


@register("SET06_subset", "SELECT o_custkey AS id, bool_and(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) AS ok FROM orders GROUP BY 1")
def set06(spark, sf):
    allowed = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")))
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.size(F.array_except(F.collect_set("o_orderpriority"), allowed)) == 0).alias("ok"))


@register("GRF01_relabel", "SELECT o_custkey AS graph_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS node, o_orderkey AS original_id FROM orders")
def grf01(spark, sf):
    nodes = table(spark, sf, "orders", F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("node"))
    return G.TextGraphs(nodes, nodes, nodes.where("false").select("graph_id", F.col("node").alias("src"), F.col("node").alias("dst"))).relabel().nodes


@register("GRF07_incidence", "SELECT n_regionkey AS graph_id, n_nationkey::VARCHAR AS src, n_nationkey || '|' || -1 - n_regionkey AS dst FROM nation UNION ALL SELECT n_regionkey, n_nationkey || '|' || -1 - n_regionkey, (-1 - n_regionkey)::VARCHAR FROM nation")
def grf07(spark, sf):
    return G.incidence(table(spark, sf, "nation", F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("src"), (-1 - F.col("n_regionkey")).alias("dst")))


#: One question for each region: its nations' and customers' triples, ord by key.
TRIPLES_SQL = """WITH t AS (SELECT n_regionkey::BIGINT AS qid, n_nationkey::BIGINT AS ord, 'nation' || n_nationkey AS h, 'geo.in_region' AS r, 'region' || n_regionkey AS t FROM nation
UNION ALL SELECT n_regionkey::BIGINT, 1000 + s_suppkey, 'supplier' || s_suppkey, 'trade.based_in', 'nation' || s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def triples(spark, sf):
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    a = nation.select(F.col("n_regionkey").cast("long").alias("qid"), F.col("n_nationkey").cast("long").alias("ord"), name("nation", "n_nationkey").alias("h"), F.lit("geo.in_region").alias("r"), name("region", "n_regionkey").alias("t"))
    b = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long").alias("qid"), (1000 + F.col("s_suppkey")).alias("ord"), name("supplier", "s_suppkey").alias("h"), F.lit("trade.based_in").alias("r"), name("nation", "s_nationkey").alias("t"))
    return a.unionByName(b)


@register("JOIN01_decode_ids", "SELECT o_orderkey AS k, CASE WHEN c_custkey IS NOT NULL THEN c_name ELSE 'UNLINKED_ENTITY' END AS head FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 700")
def join01(spark, sf):
    rows = table(spark, sf, "orders", F.col("o_orderkey").alias("k"), (F.col("o_custkey") + 700).cast("string").alias("head"))
    return K.decode_ids(rows, table(spark, sf, "customer", F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "head").select("k", "head")


@register("JOIN02_entity_text", "SELECT p_partkey AS k, CASE WHEN p_size < 20 THEN p_name WHEN p_size < 40 THEN 'unnamed entity' ELSE 'part+' || p_partkey END AS text FROM part")
def join02(spark, sf):
    node = F.when(F.col("p_size") < 40, F.concat(F.lit("m.0"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("part$002B"), F.col("p_partkey").cast("string")))
    name = F.when(F.col("p_size") < 20, F.col("p_name"))
    return table(spark, sf, "part", F.col("p_partkey").alias("k"), K.entity_text(node, name).alias("text"))


@register("JOIN03_merge_names", "WITH s AS (SELECT c_custkey AS mid, 'a' || c_name AS name, 0::BIGINT AS priority FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'b' || c_name, 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'c' || c_name, 2 FROM customer) SELECT mid, arg_min(name, priority) AS name, min(priority) AS priority FROM s WHERE mid IN (SELECT o_custkey FROM orders) GROUP BY mid")
def join03(spark, sf):
    c = table(spark, sf, "customer")
    part = lambda tag, cond: c.where(cond).select(F.col("c_custkey").alias("mid"), F.concat(F.lit(tag), "c_name").alias("name"))
    return K.merge_names(table(spark, sf, "orders", F.col("o_custkey").alias("mid")), [part("a", "c_custkey % 3 = 0"), part("b", "c_custkey % 2 = 0"), part("c", "true")])


@register("JOIN07_follow_paths", TRIPLES_SQL + ", one AS (SELECT DISTINCT qid, h, r, t FROM t WHERE r = 'trade.based_in') SELECT qid, h AS path, 0::BIGINT AS hop, h, r, t FROM one UNION SELECT one.qid, one.h, 1, t.h, t.r, t.t FROM one JOIN t ON t.qid = one.qid AND t.h = one.t AND t.r = 'geo.in_region'")
def join07(spark, sf):
    t = triples(spark, sf)
    paths = t.where("r = 'trade.based_in'").select("qid", F.col("h").alias("path"), F.col("h").alias("root"), F.array(F.lit("trade.based_in"), F.lit("geo.in_region")).alias("relations"))
    return K.follow_paths(t.select("qid", "h", "r", "t"), paths, 3)


@register("JOIN09_triplet_graph", TRIPLES_SQL + " SELECT DISTINCT a.qid, a.ord AS src, b.ord AS dst FROM t a JOIN t b ON a.qid = b.qid AND a.ord <> b.ord AND (a.h IN (b.h, b.t) OR a.t IN (b.h, b.t))")
def join09(spark, sf):
    return K.triplet_graph(triples(spark, sf))


@register("GRF02_levi_graph", TRIPLES_SQL + " SELECT qid, h AS src, 'R' || ord AS dst FROM t UNION SELECT qid, 'R' || ord, t FROM t")
def grf02(spark, sf):
    return K.levi_graph(triples(spark, sf))[1]


@register("GRF05_node_text", TRIPLES_SQL + " SELECT qid, node, CASE WHEN is_rel THEN 'relation ' ELSE 'entity ' END || text AS text FROM (SELECT qid, h AS node, false AS is_rel, h AS text FROM t UNION SELECT qid, t, false, t FROM t UNION SELECT qid, 'R' || ord, true, replace(replace(r, '.', ' '), '_', ' ') FROM t)")
def grf05(spark, sf):
    nodes = K.levi_graph(triples(spark, sf))[0]
    return nodes.select("qid", "node", F.concat(F.when(F.col("is_rel"), "relation ").otherwise("entity "), "text").alias("text"))


@register("GRF04_prompt_edges", TRIPLES_SQL + " SELECT DISTINCT qid, 'PROMPT' AS src, 'region' || qid AS dst FROM t")
def grf04(spark, sf):
    t = triples(spark, sf)
    topics = t.select("qid").distinct().select("qid", F.explode(F.array(F.concat(F.lit("region"), F.col("qid").cast("string")), F.lit("nowhere"))).alias("node"))
    nodes, edges = K.levi_graph(t)
    return K.add_prompt(nodes, edges, topics, topics.select("qid").distinct().withColumn("text", F.lit("?")))[1].where("src = 'PROMPT'")


@register("TOP02_bfs_order", TRIPLES_SQL + ", k AS (SELECT *, CASE WHEN t LIKE 'region%' THEN 0 ELSE 1 END::BIGINT AS near FROM t) SELECT qid, ord, near, (row_number() OVER (PARTITION BY qid ORDER BY near, ord) - 1)::BIGINT AS rank FROM k")
def top02(spark, sf):
    t = triples(spark, sf)
    region = t.where("r = 'geo.in_region'").select("qid", F.col("t").alias("node")).distinct().withColumn("dist", F.lit(0).cast("long"))
    nation = t.where("r = 'geo.in_region'").select("qid", F.col("h").alias("node")).distinct().withColumn("dist", F.lit(1).cast("long"))
    return K.bfs_order(t, region.unionByName(nation)).select("qid", "ord", "near", "rank")


@register("TOP01_budgeted_triples", TRIPLES_SQL.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """, n AS (SELECT qid, (SELECT count(DISTINCT e) FROM (SELECT unnest([h, t]) AS e FROM t y WHERE y.qid = x.qid)) + count(*) + 1 <= 24 AS every FROM t x GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord) AS k FROM t),
s AS (SELECT qid, 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS ents, 0 AS kept, false AS took FROM n
UNION ALL SELECT s.qid, r.k, CASE WHEN f THEN e ELSE ents END, kept + f::INT, f FROM s JOIN r ON r.qid = s.qid AND r.k = s.k + 1 JOIN n ON n.qid = s.qid, LATERAL (SELECT list_distinct(list_concat(ents, [h, r.t])) AS e) a, LATERAL (SELECT every OR len(e) + kept + 2 <= 24 AS f) b)
SELECT r.qid, r.ord AS rank, r.h, r.t FROM s JOIN r ON r.qid = s.qid AND r.k = s.k WHERE took""")
def top01(spark, sf):
    t = triples(spark, sf).withColumn("rank", F.col("ord"))
    return K.budgeted_triples(t, 24)


@register("JOIN16_division", "WITH m AS (SELECT DISTINCT o_custkey AS id FROM orders r WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders g WHERE g.o_custkey = r.o_custkey AND g.o_orderkey % 2 = 1 AND g.o_orderpriority = r.o_orderpriority)) SELECT id, NOT EXISTS (SELECT 1 FROM m WHERE m.id = q.id) AS ok FROM (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 2 = 0) q")
def join16(spark, sf):
    o = table(spark, sf, "orders")
    part = lambda m: o.where(f"o_orderkey % 2 = {m}").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("item"))
    return K.division(part(0), part(1))


@register("JOIN11_multiset_parity", "WITH a AS (SELECT o_custkey AS id, o_orderpriority AS item, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT o_custkey AS id, o_orderpriority AS item, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2) SELECT id, sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0))::BIGINT AS only_a, sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0))::BIGINT AS only_b FROM a FULL JOIN b USING (id, item) GROUP BY id")
def join11(spark, sf):
    o = table(spark, sf, "orders")
    part = lambda m: o.where(f"o_orderkey % 2 = {m}").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("item"))
    return K.multiset_gaps(part(0), part(1))


@register("JOIN08_present_answers", "SELECT o_custkey AS qid, min(o_orderkey) AS ord, o_orderpriority AS text FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) GROUP BY 1, 3")
def join08(spark, sf):
    rows = table(spark, sf, "orders", F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("text"))
    there = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("qid"))
    return G.first_seen(rows.join(there, "qid", "left_semi").withColumn("o", F.col("ord")), "o", "qid", "text").select("qid", "ord", "text")


@register("WIN10_interleave", "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY i, lane) - 1)::BIGINT AS ord, v FROM (SELECT user_id, v, i, lane, row_number() OVER (PARTITION BY user_id, v ORDER BY i, lane) AS f FROM (SELECT user_id, event_type AS lane, (props->>'k')::BIGINT AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events)) WHERE f = 1")
def win10(spark, sf):
    from pyspark.sql.window import Window

    i = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    rows = table(spark, sf, "events", "user_id", F.col("event_type").alias("lane"), F.from_json("props", "k long")["k"].alias("v"), i.alias("i"))
    return G.interleave(rows, "user_id", "lane", "i", "v")


@register("WIN13_first_seen", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def win13(spark, sf):
    rows = table(spark, sf, "events", "user_id", "event_type", "event_id", F.col("event_id").alias("o"))
    return G.first_seen(rows, "o", "user_id", "event_type").select("user_id", "event_type", "event_id")


@register("WIN15_unique_names", "SELECT p_name AS name, min(p_partkey) AS k FROM part GROUP BY 1 HAVING count(*) <= 70")
def win15(spark, sf):
    return Q.rare_names(table(spark, sf, "part"), "p_name", "p_partkey", 70)


@register("WIN11_kth_oldest", "SELECT n.n_nationkey AS grp, s_suppkey AS k, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal, s_suppkey)::BIGINT AS place, count(*) OVER (PARTITION BY n_nationkey) > 1 AS ranked FROM supplier JOIN nation n ON s_nationkey = n_nationkey")
def win11(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("s_nationkey")
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("k"), F.row_number().over(w.orderBy("s_acctbal", "s_suppkey")).cast("long").alias("place"), (F.count(F.lit(1)).over(w) > 1).alias("ranked"))


PACK_SQL = "WITH n AS (SELECT conv_id AS graph_id, turn::BIGINT AS node, turn = 0 AS is_prompt, (length(coalesce(text, '')) % 40)::BIGINT AS len FROM conversations), p AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY graph_id ORDER BY is_prompt, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM n)"


def packed(spark, sf):
    rows = table(spark, sf, "conversations", F.col("conv_id").alias("graph_id"), F.col("turn").cast("long").alias("node"), (F.col("turn") == 0).alias("is_prompt"), (F.length(F.coalesce("text", F.lit(""))) % 40).cast("long").alias("len"))
    return P.pack_offsets(rows)


@register("WIN05_pack_offsets", PACK_SQL + " SELECT * FROM p")
def win05(spark, sf):
    return packed(spark, sf)


@register("WIN06_token_rows", PACK_SQL + ' SELECT graph_id, "offset" + k AS pos, node, k AS position_id FROM (SELECT *, unnest(range(len)) AS k FROM p)')
def win06(spark, sf):
    return P.token_rows(packed(spark, sf))


@register("WIN06_depth_positions", PACK_SQL + ", s AS (SELECT *, max(len) OVER (PARTITION BY graph_id) AS stride, max(CASE WHEN NOT is_prompt THEN least(node - 1, 3) END) OVER (PARTITION BY graph_id) AS deepest FROM p) SELECT graph_id, node, (stride * CASE WHEN is_prompt THEN coalesce(deepest + 1, 0) ELSE least(node - 1, 3) END)::BIGINT AS start FROM s")
def win06b(spark, sf):
    return P.depth_positions(packed(spark, sf).withColumn("dist", F.col("node") - 1), 3).select("graph_id", "node", "start")


@register("WIN07_node_starts", PACK_SQL + ' SELECT graph_id, node, CASE WHEN len > 0 THEN "offset" ELSE 0 END::BIGINT AS start FROM p')
def win07(spark, sf):
    p = packed(spark, sf)
    return P.node_starts(p, P.token_rows(p))


@register("WIN08_shift_align", PACK_SQL + ', t AS (SELECT graph_id, "offset" + k AS pos, k FROM (SELECT *, unnest(range(len)) AS k FROM p)) SELECT graph_id, pos, lag(k) OVER (PARTITION BY graph_id ORDER BY pos) AS aligned FROM t')
def win08(spark, sf):
    t = P.token_rows(packed(spark, sf)).select("graph_id", "pos", F.col("position_id").alias("pred"))
    return P.shift_align(t, "pred").select("graph_id", "pos", "aligned")


@register("WIN09_first_supervised", PACK_SQL + ', t AS (SELECT graph_id, node, "offset" + k AS pos FROM (SELECT *, unnest(range(len)) AS k FROM p)) SELECT graph_id, min(pos)::BIGINT AS first FROM t WHERE node = 1 GROUP BY 1')
def win09(spark, sf):
    return P.token_rows(packed(spark, sf)).withColumn("label", F.when(F.col("node") == 1, 1).otherwise(P.IGNORE)).where(F.col("label") != P.IGNORE).groupBy("graph_id").agg(F.min("pos").alias("first"))


@register("ARR02_answer_labels", "SELECT p_partkey AS k, (3 * (p_size % 3) + 2)::INT AS last_ignored, 2::INT AS first_ignored, (p_size + 100)::BIGINT AS answer FROM part")
def arr02(spark, sf):
    # the answer prefix (7, 8) and an answer, one to three times
    ids = F.flatten(F.array_repeat(F.array(F.lit(7), F.lit(8), (F.col("p_size") + 100).cast("int")), (F.col("p_size") % 3 + 1).cast("int")))
    ignored = lambda labels: F.size(F.filter(labels, lambda x: x == P.IGNORE))
    last, first = (P.answer_labels(ids, F.array(F.lit(7), F.lit(8)), p) for p in ("last", "first"))
    return table(spark, sf, "part", F.col("p_partkey").alias("k"), ignored(last).alias("last_ignored"), ignored(first).alias("first_ignored"), F.element_at(last, -1).cast("long").alias("answer"))


@register("ARR05_pad", "SELECT p_partkey AS k, '1,2,' || repeat('0,', (p_size % 4)::INT) || 'r' AS right, repeat('0,', (p_size % 4)::INT) || '1,2,l' AS left FROM part")
def arr05(spark, sf):
    ids, n = F.array(F.lit(1), F.lit(2)), 2 + F.col("p_size") % 4
    text = lambda c, e: F.concat(F.array_join(c.cast("array<string>"), ","), F.lit("," + e))
    return table(spark, sf, "part", F.col("p_partkey").alias("k"), text(P.pad_right(ids, n, 0), "r").alias("right"), text(P.pad_left(ids, n, 0), "l").alias("left"))


@register("ARR06_collate", "WITH r AS (SELECT p_partkey AS k, p_partkey // 10 AS batch, p_size % 7 + 1 AS n FROM part) SELECT k, max(n) OVER (PARTITION BY batch)::BIGINT AS width, n::BIGINT AS real FROM r")
def arr06(spark, sf):
    ids = F.array_repeat(F.lit(5), (F.col("p_size") % 7 + 1).cast("int"))
    rows = table(spark, sf, "part", F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 10).alias("batch"), ids.alias("ids"), ids.alias("labels"))
    return P.collate(rows, "batch", 0).select("k", F.size("ids").cast("long").alias("width"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("real"))


@register("AGG28_density", PACK_SQL + ', t AS (SELECT graph_id, "offset" + k AS pos, node FROM (SELECT *, unnest(range(len)) AS k FROM p)), g AS (SELECT graph_id, sum(len) AS n FROM p GROUP BY 1 HAVING sum(len) > 0), m AS (SELECT a.graph_id, a.pos AS q, b.pos AS k FROM t a JOIN t b ON a.graph_id = b.graph_id AND a.node = b.node AND b.pos <= a.pos) SELECT graph_id, round(count(*) / (n * n)::DOUBLE, 6) AS density, round(count(DISTINCT (q // 16, k // 16)) / (ceil(n / 16) * ceil(n / 16))::DOUBLE, 6) AS block_density FROM m JOIN g USING (graph_id) GROUP BY graph_id, n')
def agg28(spark, sf):
    p = packed(spark, sf)
    t = P.token_rows(p).select("graph_id", "pos", "node")
    mask = t.alias("a").join(t.alias("b"), F.expr("a.graph_id = b.graph_id and a.node = b.node and b.pos <= a.pos")).select("a.graph_id", F.col("a.pos").alias("q"), F.col("b.pos").alias("k"))
    out = P.attention_density(mask, p.groupBy("graph_id").agg(F.sum("len").alias("n")), 16)
    return out.select("graph_id", F.round("density", 6).alias("density"), F.round("block_density", 6).alias("block_density"))


@register("AGG37_distinct_ids", "SELECT id FROM (SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier)")
def agg37(spark, sf):
    return table(spark, sf, "customer", F.col("c_custkey").alias("id")).union(table(spark, sf, "orders", "o_custkey")).union(table(spark, sf, "supplier", "s_suppkey")).distinct()


@register("TOP09_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 128 THEN rtrim(text[:128]) || '…' ELSE text END AS text FROM documents")
def top09(spark, sf):
    from graphloom.operators.rowtext import ellipsis

    return table(spark, sf, "documents", "doc_id", ellipsis(F.col("text"), 128).alias("text"))


@register("JOIN15_anti", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join15(spark, sf):
    return Q.lacking(table(spark, sf, "customer", F.col("c_custkey").alias("id")), table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")))


@register("JOIN13_two_hop", "SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R') AS yes FROM customer")
def join13(spark, sf):
    first = table(spark, sf, "orders", F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("via"))
    second = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("via"))
    return Q.holds(table(spark, sf, "customer", F.col("c_custkey").alias("id")), Q.two_hop(first, second))


@register("JOIN10_scored_by_all", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1 HAVING count(*) = 1")
def join10(spark, sf):
    return Q.scored_once(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "quality")


@register("JOIN21_grid", "SELECT n_nationkey AS a, r_regionkey AS b FROM nation, region")
def join21(spark, sf):
    return table(spark, sf, "nation", F.col("n_nationkey").alias("a")).crossJoin(F.broadcast(table(spark, sf, "region", F.col("r_regionkey").alias("b"))))


@register("JOIN22_bijection", "SELECT 'left' AS side, count(*)::BIGINT AS n FROM (SELECT n_nationkey FROM nation EXCEPT ALL SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey < 12) UNION ALL SELECT 'right', count(*)::BIGINT FROM (SELECT c_nationkey FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey < 12 EXCEPT ALL SELECT n_nationkey FROM nation)")
def join22(spark, sf):
    a = table(spark, sf, "nation", F.col("n_nationkey").alias("k"))
    b = table(spark, sf, "customer").where("c_custkey % 3 = 0 and c_nationkey < 12").select(F.col("c_nationkey").alias("k"))
    return Q.bag_gaps(a, b)


@register("WIN12_cell_batches", "SELECT doc_id, source AS cell, ((row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) - 1) // 8)::BIGINT AS batch FROM documents")
def win12(spark, sf):
    return Q.cell_batches(table(spark, sf, "documents", "doc_id", F.col("source").alias("cell")), "cell", "doc_id", 8, "7")


@register("WIN14_layer_groups", "SELECT n_nationkey AS layer, (n_nationkey * 4 // 25)::BIGINT AS grp FROM nation")
def win14(spark, sf):
    return table(spark, sf, "nation", F.col("n_nationkey").alias("layer"), Q.layer_group(F.col("n_nationkey"), 4, 25).alias("grp"))


@register("TOP03_neighbourhood_cap", "SELECT o_custkey AS graph_id, o_orderkey AS node FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 3), sha256('n:' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn <= 4")
def top03(spark, sf):
    return Q.nearest(table(spark, sf, "orders", F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("node")), "graph_id", F.col("node") % 3, "node", 4, "n")


@register("AGG29_bucket_audit", "WITH b AS (SELECT doc_id // 8 AS batch, max(n_chars) AS longest, sum(n_chars) AS used, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT *, (ceil(longest / 512.0) * 512)::BIGINT AS bucket FROM b) SELECT bucket, count(*)::BIGINT AS batches, round(avg(1 - used / (bucket * n)::DOUBLE), 6) AS waste FROM k GROUP BY 1")
def agg29(spark, sf):
    b = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 8).alias("batch")).agg(F.max("n_chars").alias("longest"), F.sum("n_chars").alias("used"), F.count(F.lit(1)).alias("n"))
    b = b.withColumn("bucket", T.align_up(F.col("longest"), 512))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("batches"), F.round(F.avg(1 - F.col("used") / (F.col("bucket") * F.col("n"))), 6).alias("waste"))
