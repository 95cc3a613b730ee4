"""Further queries: graph builds, masks, budgets, names and report columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as T
from graphloom.operators import hooks as H
from graphloom.operators import generators as N
from graphloom.operators import kg as K
from graphloom.operators import records as Q
from graphloom.operators import relational as R
from graphloom.operators import structure as S
from graphloom.operators import tokens as P
from graphloom.operators import textgraph as G
from graphloom.plans.collections import PACK_SQL, TRIPLES_SQL, packed, table, triples
from graphloom.plans.metrics import RUNS_SQL, runs
from graphloom.plans.registry import register
from graphloom.plans.structure import GRAPH_SQL, PATHS_SQL, graphs


@register("FLT04_strided_blocks", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, (count(*) OVER () + 3) // 4 AS s FROM documents) WHERE i % s < 50")
def flt04(spark, sf):
    return G.strided_blocks(table(spark, sf, "documents", "doc_id"), "doc_id", 200)


@register("FLT12_link_tables", "SELECT 'bridge' AS tbl")
def flt12(spark, sf):
    bridge = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_shipdate")
    specs = {"bridge": R.TableSpec(None, "l_shipdate", {"l_orderkey": "orders", "l_partkey": "part"}), "orders": R.TPCH["orders"]}
    names = R.Catalog({"bridge": bridge, "orders": table(spark, sf, "orders")}, specs).link_tables()
    return spark.createDataFrame([(n,) for n in names], "tbl string")


@register("FLT13_downcast", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 3) AS total FROM embeddings")
def flt13(spark, sf):
    small = table(spark, sf, "embeddings", "vec_id", F.col("embedding").cast("array<double>").cast("array<float>").alias("e"))
    return small.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), 3).alias("total"))


@register("FLT14_assign_label", "SELECT conv_id AS graph_id, 'chat' AS ds_label FROM conversations GROUP BY 1")
def flt14(spark, sf):
    g = table(spark, sf, "conversations", F.col("conv_id").alias("graph_id")).distinct()
    return G.TextGraphs(g, g, g).assign_label("chat").graphs


@register("FLT19_off_diagonal_pairs", "WITH t AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey AS r, (o_orderkey + 1 + (('0x' || sha256('p:' || o_orderkey)[:8])::BIGINT % (n - 1))) % n AS c FROM orders, t WHERE n > 1")
def flt19(spark, sf):
    # an n x n matrix, n the number of orders; one row alone has no place off the diagonal
    orders = table(spark, sf, "orders", "o_orderkey")
    sized = orders.crossJoin(F.broadcast(orders.agg(F.count(F.lit(1)).alias("n")))).where("n > 1")
    off = 1 + F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("p"), F.col("o_orderkey").cast("string")), 256), 1, 8), 16, 10).cast("long") % (F.col("n") - 1)
    return sized.select(F.col("o_orderkey").alias("r"), ((F.col("o_orderkey") + off) % F.col("n")).alias("c"))


@register("JOIN12_one_hop", "SELECT s_suppkey AS id, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50) AS yes FROM supplier")
def join12(spark, sf):
    return Q.holds(table(spark, sf, "supplier", F.col("s_suppkey").alias("id")), table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("id")))


@register("JOIN14_same_boss", "WITH f AS (SELECT s_nationkey::BIGINT AS graph_id, s_suppkey AS src, s_suppkey % 3 AS boss FROM supplier) SELECT x.graph_id, x.src AS a, y.src AS b FROM f x JOIN f y ON x.graph_id = y.graph_id AND x.boss = y.boss AND x.src < y.src")
def join14(spark, sf):
    k = F.col("s_suppkey")
    edges = table(spark, sf, "supplier", F.col("s_nationkey").cast("long").alias("graph_id"), k.alias("src"), F.explode(F.array(k % 3, k % 3 + 5)).alias("dst"))
    return K.shared_first(edges)


@register("JOIN19_alignment", "SELECT event_id AS row_id, value AS margin, user_id AS y FROM events WHERE event_id % 3 = 0")
def join19(spark, sf):
    e = table(spark, sf, "events")
    preds = e.where("event_id % 3 = 0").select(F.col("event_id").alias("row_id"), F.col("value").alias("margin"))
    return preds.join(e.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("y")), "row_id")


@register("JOIN20_pair_bias", PACK_SQL + ', t AS (SELECT graph_id, "offset" + k AS pos, node FROM (SELECT *, unnest(range(len)) AS k FROM p)), g AS (SELECT graph_id, q.pos AS q, k.pos AS k, abs(q.node - k.node)::BIGINT AS bias FROM t q JOIN t k USING (graph_id)) SELECT graph_id, count(*)::BIGINT AS n, sum(bias * (q - k))::BIGINT AS check FROM g GROUP BY 1'.replace("AS check", "AS mark"))
def join20(spark, sf):
    p = packed(spark, sf)
    a, b = p.select("graph_id", F.col("node").alias("i")), p.select("graph_id", F.col("node").alias("j"))
    bias = a.join(b, "graph_id").withColumn("bias", F.abs(F.col("i") - F.col("j")))
    return P.pair_bias(P.token_rows(p), bias).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bias") * (F.col("q") - F.col("k"))).alias("mark"))


@register("JOIN23_common_seeds", RUNS_SQL + " SELECT task, seed, count(DISTINCT arm)::BIGINT AS arms FROM runs GROUP BY 1, 2 HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM runs)")
def join23(spark, sf):
    return Q.common_seeds(runs(spark, sf))


@register("AGG12_question_means", "WITH a AS (SELECT o_custkey AS qid, c_mktsegment AS dataset, max((o_orderstatus = 'F')::INT) AS hit, arg_min((o_orderstatus = 'F')::INT, o_orderkey) AS hit1 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) SELECT dataset, count(*)::BIGINT AS n, round(avg(hit), 6) AS hit, round(avg(hit1), 6) AS hit1 FROM a GROUP BY 1")
def agg12(spark, sf):
    good = (F.col("o_orderstatus") == "F").cast("int")
    q = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey", F.col("c_mktsegment").alias("dataset")).agg(F.max(good).alias("hit"), F.min_by(good, "o_orderkey").alias("hit1"))
    return q.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("hit1"), 6).alias("hit1"))


@register("AGG13_selection_scalar", "SELECT round(avg(m), 6) AS score FROM (SELECT c_mktsegment, avg((o_orderstatus = 'F')::INT) AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)")
def agg13(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("m")).agg(F.round(F.avg("m"), 6).alias("score"))


@register("AGG14_outcome_classes", "SELECT source AS cell, count(CASE WHEN n_chars % 5 = 0 THEN 1 END)::BIGINT AS em, count(CASE WHEN n_chars % 5 <> 0 AND n_chars % 3 = 0 THEN 1 END)::BIGINT AS distractor, count(CASE WHEN n_chars % 5 <> 0 AND n_chars % 3 <> 0 THEN 1 END)::BIGINT AS malformed FROM documents GROUP BY 1")
def agg14(spark, sf):
    n = F.col("n_chars")
    kind = Q.first_failing({"em": n % 5 == 0, "distractor": n % 3 == 0}, "malformed")
    return Q.outcome_counts(table(spark, sf, "documents", F.col("source").alias("cell"), "n_chars"), "cell", kind, ["em", "distractor", "malformed"])


@register("AGG26_answer_distribution", "SELECT CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS answer, count(*)::BIGINT AS n FROM labels GROUP BY 1")
def agg26(spark, sf):
    return Q.last_label_distribution(table(spark, sf, "labels"), F.array(F.lit(-100), F.col("quality")), 1)


@register("AGG27_masking_statistics", PACK_SQL + " SELECT a.graph_id, sum(CASE WHEN abs(a.node - b.node) <= 1 THEN 0 ELSE a.len * b.len END)::BIGINT AS blocked, sum(a.len * b.len)::BIGINT AS pairs FROM p a JOIN p b ON a.graph_id = b.graph_id AND a.node <> b.node AND NOT a.is_prompt AND NOT b.is_prompt GROUP BY 1")
def agg27(spark, sf):
    p = packed(spark, sf)
    a, b = p.select("graph_id", F.col("node").alias("i")), p.select("graph_id", F.col("node").alias("j"))
    near = a.join(b, "graph_id").where("abs(i - j) <= 1")
    return P.prefix_mask_pairs(p, near)


@register("AGG44_stall_flags", RUNS_SQL + ", t AS (SELECT arm, avg(metric) AS mean, median(metric) AS mid FROM runs GROUP BY 1) SELECT arm, round(mean / mid, 6) AS ratio, mean / mid > 1.1 AS stalled FROM t")
def agg44(spark, sf):
    return Q.stall_flags(runs(spark, sf), "arm", "metric").withColumn("ratio", F.round("ratio", 6))


@register("AGG47_cost_model", RUNS_SQL + """, m AS (SELECT arm, avg(metric) AS y FROM runs GROUP BY 1), two AS (SELECT * FROM m ORDER BY arm LIMIT 2),
f AS (SELECT min(arm) AS x0, max(arm) AS x1, arg_min(y, arm) AS y0, arg_max(y, arm) AS y1 FROM two), g AS (SELECT arm, y, y0 + (y1 - y0) / (x1 - x0) * (arm - x0) AS guess FROM m, f WHERE arm > x1)
SELECT arm, round(guess, 6) AS predicted, round(100 * (guess - y) / y, 6) AS error_percent FROM g""")
def agg47(spark, sf):
    out = Q.line_forecast(runs(spark, sf).groupBy("arm").agg(F.avg("metric").alias("y")), "arm", "y")
    return out.select("arm", F.round("predicted", 6).alias("predicted"), F.round("error_percent", 6).alias("error_percent"))


@register("AGG48_result_columns", "SELECT max(CASE WHEN lang = 'en' THEN n END)::BIGINT AS eval_en_n, max(CASE WHEN lang = 'de' THEN n END)::BIGINT AS eval_de_n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def agg48(spark, sf):
    return Q.result_columns(table(spark, sf, "documents"), "lang", ["en", "de"], F.count(F.lit(1)), "n")


@register("AGG50_shape_timing", "SELECT n_chars // 1024 AS shape, round(median(doc_id), 4) AS median, round(avg(doc_id), 4) AS mean, count(*)::BIGINT AS n, round(coalesce(stddev_samp(doc_id), 0.0), 4) AS std FROM documents GROUP BY 1")
def agg50(spark, sf):
    out = Q.shape_timing(table(spark, sf, "documents"), F.floor(F.col("n_chars") / 1024), "doc_id")
    return out.select("shape", "n", *(F.round(c, 4).alias(c) for c in ("median", "mean", "std")))


@register("TOP05_answer_truncation", "SELECT user_id, string_agg(k, ',' ORDER BY h, k) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, k) AS rn FROM (SELECT DISTINCT user_id, (props->>'k') AS k, sha256('0:' || user_id || ':' || (props->>'k')) AS h FROM events)) WHERE rn <= 3 GROUP BY 1")
def top05(spark, sf):
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf, "events", "user_id", k.alias("k")).distinct()
    marks = rows.withColumn("h", F.sha2(F.concat_ws(":", F.lit("0"), F.col("user_id").cast("string"), "k"), 256)).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("h", "k"))).alias("a"))
    return marks.select("user_id", F.array_join(F.transform(F.slice("a", 1, 3), lambda x: x["k"]), ",").alias("kept"))


@register("TOP06_line_drop", "SELECT doc_id, greatest(0, n - 8 * k)::BIGINT AS lines FROM (SELECT doc_id, n, min(k) AS k FROM (SELECT doc_id, len(ls) AS n, ls, k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(200) r(k)) WHERE coalesce(list_sum(list_transform(ls[1 : greatest(0, n - 8 * k)], lambda x: length(x))), 0) <= 1500 AND (k = 0 OR n - 8 * (k - 1) > 0) GROUP BY 1, 2)")
def top06(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents", "doc_id", F.size(P.drop_lines(lines, F.transform(lines, lambda x: F.length(x)), 1500)).cast("long").alias("lines"))


@register("TOP08_report_order", RUNS_SQL + " SELECT arm, row_number() OVER (ORDER BY (arm % 4 = 0), CASE WHEN arm % 4 <> 0 THEN arm END NULLS LAST, arm)::BIGINT AS place FROM (SELECT DISTINCT arm FROM runs)")
def top08(spark, sf):
    sweep = F.when(F.col("arm") % 4 != 0, F.col("arm"))
    arms = runs(spark, sf).select("arm").distinct()
    return arms.select("arm", F.row_number().over(Window.orderBy(sweep.isNull(), sweep.asc_nulls_last(), "arm")).cast("long").alias("place"))


@register("GRF03_contract_mediators", TRIPLES_SQL + """, m AS (SELECT qid, t AS node FROM t WHERE r = 'trade.based_in' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT a.qid, 'R' || a.ord AS src, 'R' || b.ord AS dst FROM t a JOIN m ON m.qid = a.qid AND m.node = a.t JOIN t b ON b.qid = m.qid AND b.h = m.node""")
def grf03(spark, sf):
    """Nations as unnamed mediators between suppliers and a region: those with one supplier go."""
    nodes, edges = K.levi_graph(triples(spark, sf))
    marked = nodes.select("qid", "node", "is_rel", F.col("node").startswith("nation").alias("unnamed"), F.lit(False).alias("is_topic"))
    return K.contract_mediators(marked, edges)[1].where("src like 'R%' and dst like 'R%'")


@register("GRF09_typed_incidence", TRIPLES_SQL + " SELECT qid, h AS src, h || '_' || replace(lower(r), '.', '_') || '_' || t AS dst FROM t UNION SELECT qid, h || '_' || replace(lower(r), '.', '_') || '_' || t, t FROM t")
def grf09(spark, sf):
    t = triples(spark, sf)
    mid = F.concat_ws("_", "h", F.replace(F.lower("r"), F.lit("."), F.lit("_")), "t")
    return t.select("qid", F.col("h").alias("src"), mid.alias("dst")).union(t.select("qid", mid, "t")).distinct()


@register("GRF08_undirected_once", "SELECT DISTINCT least(l_suppkey % 20, l_partkey % 20) AS src, greatest(l_suppkey % 20, l_partkey % 20) AS dst FROM lineitem WHERE l_suppkey % 20 <> l_partkey % 20")
def grf08(spark, sf):
    a, b = F.col("l_suppkey") % 20, F.col("l_partkey") % 20
    return table(spark, sf, "lineitem", F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src <> dst").distinct()


@register("GRF11_question_copies", GRAPH_SQL + " SELECT q || ':' || graph_id AS item, node FROM nodes, range(2) r(q)")
def grf11(spark, sf):
    nodes, _ = graphs(spark, sf)
    q = nodes.withColumn("q", F.explode(F.expr("sequence(0, 1)")))
    return q.select(F.concat_ws(":", F.col("q").cast("string"), F.col("graph_id").cast("string")).alias("item"), "node")


@register("GRF12_header_nodes", "SELECT DISTINCT o_custkey AS seed_id, 'header:orders' AS dst, o_orderkey AS src FROM orders")
def grf12(spark, sf):
    return Q.header_edges(table(spark, sf, "orders"), "o_custkey", "orders", "o_orderkey")


@register("GRF19_oriented", GRAPH_SQL + ", o AS (SELECT graph_id, src, dst, ('0x' || sha256('o:' || graph_id || ':' || src || ':' || dst)[:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM edges WHERE src < dst) SELECT graph_id, src, dst FROM o WHERE u < 0.7 UNION ALL SELECT graph_id, dst, src FROM o WHERE u >= 0.5")
def grf19(spark, sf):
    from graphloom.operators.generators import uniform

    o = graphs(spark, sf)[1].where("src < dst").withColumn("u", uniform("o", F.col("graph_id"), F.col("src"), F.col("dst")))
    # one way, the other, or (0.5 to 0.7) both
    return o.where("u < 0.7").select("graph_id", "src", "dst").union(o.where("u >= 0.5").select("graph_id", "dst", "src"))


@register("GRF20_content_order", "SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY sha256('s:' || conv_id || ':' || turn), turn) AS \"order\" FROM conversations GROUP BY 1")
def grf20(spark, sf):
    mark = F.sha2(F.concat_ws(":", F.lit("s"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256)
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(mark.alias("h"), "turn"))).alias("a"))
    return rows.select("conv_id", F.array_join(F.transform("a", lambda x: x["turn"].cast("string")), ",").alias("order"))


@register("ALG11_hierarchy", """WITH e AS (SELECT 1000 + n_regionkey AS src, 2000 + n_nationkey AS dst FROM nation UNION ALL SELECT 2000 + s_nationkey, 10000 + s_suppkey FROM supplier)
SELECT src, dst, 1::BIGINT AS depth FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON b.src = a.dst""")
def alg11(spark, sf):
    """Everyone below everyone: suppliers under nations under regions."""
    nation = table(spark, sf, "nation", (F.col("n_regionkey").cast("long") + 1000).alias("src"), (F.col("n_nationkey").cast("long") + 2000).alias("dst"))
    supplier = table(spark, sf, "supplier", (F.col("s_nationkey").cast("long") + 2000).alias("src"), (F.col("s_suppkey") + 10000).alias("dst"))
    return N.closure(nation.unionByName(supplier).withColumn("graph_id", F.lit(0).cast("long"))).drop("graph_id")


@register("ALG13_structural_mask", PACK_SQL + ', t AS (SELECT graph_id, "offset" + k AS pos, node, is_prompt FROM (SELECT *, unnest(range(len)) AS k FROM p)), m AS (SELECT a.graph_id, a.pos AS q, b.pos AS k FROM t a JOIN t b ON a.graph_id = b.graph_id AND (b.pos <= a.pos OR (NOT a.is_prompt AND NOT b.is_prompt)) AND abs(a.node - b.node) <= 1 UNION SELECT graph_id, pos, pos FROM t) SELECT graph_id, count(*)::BIGINT AS n, sum(q * 7 + k)::BIGINT AS mark FROM m GROUP BY 1')
def alg13(spark, sf):
    p = packed(spark, sf)
    a, b = p.select("graph_id", F.col("node").alias("i")), p.select("graph_id", F.col("node").alias("j"))
    tokens = P.token_rows(p).join(p.select("graph_id", "node", "is_prompt"), ["graph_id", "node"])
    mask = P.structural_mask(tokens, a.join(b, "graph_id").where("abs(i - j) <= 1"))
    return mask.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q") * 7 + F.col("k")).alias("mark"))


@register("ALG16_distances_with_sentinel", PATHS_SQL + ", c AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1) SELECT a.graph_id, a.node AS i, b.node AS j, coalesce(dist, n)::BIGINT AS dist FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id JOIN c ON c.graph_id = a.graph_id LEFT JOIN paths p ON p.graph_id = a.graph_id AND p.i = a.node AND p.j = b.node")
def alg16(spark, sf):
    nodes, edges = graphs(spark, sf)
    every = nodes.select("graph_id", F.col("node").alias("i")).join(nodes.select("graph_id", F.col("node").alias("j")), "graph_id")
    sizes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return every.join(sizes, "graph_id").join(S.shortest_paths(nodes, edges, 4), ["graph_id", "i", "j"], "left").select("graph_id", "i", "j", F.coalesce("dist", "n").alias("dist"))


@register("STR14_parse_prose", "SELECT o_orderkey AS k, o_custkey AS u, o_orderkey AS v FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1, o_orderkey + 1 FROM orders")
def str14(spark, sf):
    prose = F.format_string("Edges are: (%d, %d) (%d, %d).", "o_custkey", "o_orderkey", F.col("o_custkey") + 1, F.col("o_orderkey") + 1)
    pattern = F.lit(r"\((\d+), (\d+)\)")
    both = F.arrays_zip(F.regexp_extract_all(prose, pattern, F.lit(1)).alias("u"), F.regexp_extract_all(prose, pattern, F.lit(2)).alias("v"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.explode(both).alias("e")).select("k", F.col("e.u").cast("long").alias("u"), F.col("e.v").cast("long").alias("v"))


@register("STR17_distance_text", GRAPH_SQL + """, e AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, dst, src FROM edges), w AS (SELECT graph_id, node, 0 AS d FROM nodes WHERE node = 0 UNION SELECT w.graph_id, dst, d + 1 FROM w JOIN e ON e.graph_id = w.graph_id AND src = node WHERE d < 5),
s AS (SELECT graph_id, node, min(d)::INT AS dist FROM w GROUP BY 1, 2) SELECT graph_id, node, CASE WHEN dist > 1 THEN 't' || node ELSE 't' || node || chr(10) || repeat('x', (8 // 2 ** dist)::INT) END AS fading, CASE WHEN dist <= 1 THEN 't' || node || chr(10) || repeat('x', 8) ELSE 't' || node END AS near, 't' || node AS title FROM s""")
def str17(spark, sf):
    """Texts of the nodes around node 0, by their distance from it."""
    nodes, edges = graphs(spark, sf)
    found = R.reachable(edges, nodes.where("node = 0"))
    args = (F.concat(F.lit("t"), F.col("node").cast("string")), F.lit("x" * 8), F.col("dist").cast("int"))
    return found.select("graph_id", "node", H.text_mapping("fading_bodies", 0, 1)(*args).alias("fading"), H.text_mapping("near_bodies", 1)(*args).alias("near"), H.text_mapping("all_titles")(*args).alias("title"))


@register("STR18_chat_prompt", "SELECT conv_id, turn::BIGINT AS turn, '<|' || role || '|>' || chr(10) || coalesce(text, '') AS text FROM conversations")
def str18(spark, sf):
    return table(spark, sf, "conversations", "conv_id", F.col("turn").cast("long").alias("turn"), T.chat_turn(F.col("role"), F.col("text")).alias("text"))


@register("MTH02_string_seed", "SELECT s_suppkey AS k, sha256('needle|7|' || s_suppkey)[:16] AS seed FROM supplier")
def mth02(spark, sf):
    return table(spark, sf, "supplier", F.col("s_suppkey").alias("k"), F.substring(F.sha2(F.concat_ws("|", F.lit("needle"), F.lit("7"), F.col("s_suppkey").cast("string")), 256), 1, 16).alias("seed"))


@register("MTH06_percentile", "SELECT source, round(quantile_cont(n_chars, 0.35), 4) AS p FROM documents GROUP BY 1")
def mth06(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.round(F.percentile("n_chars", F.lit(0.35)), 4).alias("p"))


@register("MTH08_shard_bounds", "SELECT i AS shard, (i * 1003 // 7)::BIGINT AS first, ((i + 1) * 1003 // 7)::BIGINT AS stop FROM range(7) r(i)")
def mth08(spark, sf):
    return spark.range(7).select(F.col("id").alias("shard"), F.floor(F.col("id") * 1003 / 7).alias("first"), F.floor((F.col("id") + 1) * 1003 / 7).alias("stop"))


@register("MTH12_tight_bucket", "SELECT lang, ((max(n_chars) + 127) // 128 * 128)::BIGINT AS bucket FROM documents GROUP BY 1")
def mth12(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(T.align_up(F.max("n_chars"), 128).alias("bucket"))


@register("ARR01_tokenize", "SELECT item_id::BIGINT AS k, len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+|[^\\sA-Za-zÀ-ÿ]'))::BIGINT AS n FROM benchmark")
def arr01(spark, sf):
    return table(spark, sf, "benchmark", F.col("item_id").cast("long").alias("k"), F.size(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]+|[^\sA-Za-zÀ-ÿ]"), F.lit(0))).cast("long").alias("n"))


@register("ARR03_last_token_label", "SELECT conv_id, turn, greatest(length(text) - 1, 0)::BIGINT AS last_ignored, least(length(text), 5)::BIGINT AS prefix_ignored, CASE WHEN length(text) > 0 THEN ascii(right(text, 1)) END::BIGINT AS label FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)")
def arr03(spark, sf):
    text = F.coalesce("text", F.lit(""))
    ids = F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c)))
    ignored = lambda labels: F.size(F.filter(labels, lambda x: x == P.IGNORE)).cast("long")
    last = P.last_token_labels(ids)
    return table(spark, sf, "conversations", "conv_id", "turn", ignored(last).alias("last_ignored"), ignored(P.prefix_labels(ids, 5)).alias("prefix_ignored"), F.get(last, F.size(last) - 1).cast("long").alias("label"))


@register("ARR04_prefix_search", "SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 2 ELSE NULL END::INT AS at FROM part")
def arr04(spark, sf):
    ids = F.array(F.lit(5), F.lit(6), F.when(F.col("p_size") % 2 == 0, 7).otherwise(9), F.lit(8))
    return table(spark, sf, "part", F.col("p_partkey").alias("k"), F.get(P.occurrences(ids, F.array(F.lit(7), F.lit(8))), F.lit(0)).alias("at"))
