"""Queries of the relational operators over the TPC-H-like tables and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import relational as R
from graphloom.operators import rowtext as T
from graphloom.plans.registry import register
from graphloom.storage import read_table

CUT = "1999-06-30 00:00:00"
SEED_SQL = f"SELECT c_custkey AS seed_id, c_custkey AS entity, epoch(TIMESTAMP '{CUT}')::BIGINT AS seed_ts FROM customer WHERE c_mktsegment = 'BUILDING'"


def seeds(spark, sf):
    rows = read_table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return rows.select(F.col("c_custkey").alias("seed_id"), F.col("c_custkey").alias("entity"), F.unix_seconds(F.lit(CUT).cast("timestamp")).alias("seed_ts"))


@register("SRC07_visible_rows", f"""
SELECT 'orders' AS tbl, count(*)::BIGINT AS n, max(epoch(o_orderdate))::BIGINT AS latest FROM orders WHERE o_orderdate <= TIMESTAMP '{CUT}'
UNION ALL SELECT 'lineitem', count(*)::BIGINT, max(epoch(l_shipdate))::BIGINT FROM lineitem WHERE l_shipdate <= TIMESTAMP '{CUT}'
UNION ALL SELECT 'customer', count(*)::BIGINT, -1099511627776 FROM customer""")
def src07(spark, sf):
    cut = R.tpch(spark, sf).upto(CUT)
    parts = []
    for name in ("orders", "lineitem", "customer"):
        time = R.TPCH[name].time
        parts.append(cut.tables[name].agg(F.count(F.lit(1)).alias("n"), F.max(R.seconds(F.col(time)) if time else F.lit(R.STATIC)).alias("latest")).select(F.lit(name).alias("tbl"), "n", "latest"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("JOIN04_fkey_edges", """
SELECT 'nation' AS child_table, n_nationkey::BIGINT AS child_key, 'n_regionkey' AS fkey, 'region' AS parent_table, n_regionkey::BIGINT AS parent_key FROM nation WHERE n_regionkey IS NOT NULL
UNION ALL SELECT 'customer', c_custkey::BIGINT, 'c_nationkey', 'nation', c_nationkey::BIGINT FROM customer WHERE c_nationkey IS NOT NULL
UNION ALL SELECT 'supplier', s_suppkey::BIGINT, 's_nationkey', 'nation', s_nationkey::BIGINT FROM supplier WHERE s_nationkey IS NOT NULL
UNION ALL SELECT 'orders', o_orderkey::BIGINT, 'o_custkey', 'customer', o_custkey::BIGINT FROM orders WHERE o_custkey IS NOT NULL""")
def join04(spark, sf):
    return R.fkey_edges(R.tpch(spark, sf))


NEAR_SQL = f"""WITH seeds AS ({SEED_SQL}), near AS (
SELECT seed_id, o_orderkey AS child_key, epoch(o_orderdate)::BIGINT AS child_time,
row_number() OVER (PARTITION BY seed_id ORDER BY o_orderdate DESC, o_orderkey)::BIGINT AS rank
FROM seeds JOIN orders ON o_custkey = entity AND epoch(o_orderdate)::BIGINT <= seed_ts)"""


def neighbours(spark, sf, k=3):
    return R.temporal_neighbours(seeds(spark, sf), read_table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate", k)


@register("JOIN05_last_k_children", NEAR_SQL + " SELECT * FROM near WHERE rank <= 3")
def join05(spark, sf):
    return neighbours(spark, sf)


@register("JOIN05_temporal_neighbours", NEAR_SQL + """, picked AS (SELECT * FROM near WHERE rank <= 3), nodes AS (
SELECT seed_id, 0::BIGINT AS hop, 'customer' AS tbl, seed_id AS row_key, 'mktsegment: ' || c_mktsegment || ' | acctbal: ' || printf('%.2f', c_acctbal) AS text FROM seeds JOIN customer ON c_custkey = seed_id
UNION ALL SELECT seed_id, 1, 'orders', child_key, 'status: ' || o_orderstatus || ' | total: ' || printf('%.2f', o_totalprice) || ' | time: ' || ((epoch(TIMESTAMP '""" + CUT + """')::BIGINT - child_time) // 86400) || 'd before' FROM picked JOIN orders ON o_orderkey = child_key
UNION ALL SELECT seed_id, 1, 'nation', n_nationkey::BIGINT, 'name: ' || n_name FROM seeds JOIN customer ON c_custkey = seed_id JOIN nation ON n_nationkey = c_nationkey)
SELECT seed_id, (row_number() OVER (PARTITION BY seed_id ORDER BY hop, tbl, row_key) - 1)::BIGINT AS pos, hop, tbl, row_key, text FROM nodes""")
def join05_text(spark, sf):
    s, orders, customer, nation = seeds(spark, sf), *(read_table(spark, sf, n) for n in ("orders", "customer", "nation"))
    text = T.key_value
    money = lambda c: F.format_string("%.2f", F.col(c))
    own = s.join(customer, F.col("seed_id") == F.col("c_custkey"))
    root = own.select("seed_id", F.lit(0).cast("long").alias("hop"), F.lit("customer").alias("tbl"), F.col("seed_id").alias("row"), text({"mktsegment": F.col("c_mktsegment"), "acctbal": money("c_acctbal")}).alias("text"))
    near = neighbours(spark, sf).join(s.select("seed_id", "seed_ts"), "seed_id").join(orders, F.col("child_key") == F.col("o_orderkey"))
    kids = near.select("seed_id", F.lit(1).cast("long").alias("hop"), F.lit("orders").alias("tbl"), F.col("child_key").alias("row"), text({"status": F.col("o_orderstatus"), "total": money("o_totalprice"), "time": T.relative_days(F.col("child_time"), F.col("seed_ts"))}).alias("text"))
    up = own.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("seed_id", F.lit(1).cast("long").alias("hop"), F.lit("nation").alias("tbl"), F.col("n_nationkey").cast("long").alias("row"), text({"name": F.col("n_name")}).alias("text"))
    nodes = R.dense_positions(root.unionByName(kids).unionByName(up))
    return nodes.select("seed_id", "pos", "hop", "tbl", F.col("row").alias("row_key"), "text")


DEGREE_SQL = f"WITH seeds AS ({SEED_SQL}), deg AS (SELECT seed_id, count(o_orderkey)::BIGINT AS degree FROM seeds LEFT JOIN orders ON o_custkey = entity AND epoch(o_orderdate)::BIGINT <= seed_ts GROUP BY 1)"


@register("JOIN06_eligible_degree", DEGREE_SQL + " SELECT * FROM deg")
def join06(spark, sf):
    return R.eligible_degrees(seeds(spark, sf), read_table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@register("AGG06_degree_distribution", DEGREE_SQL + """ SELECT 'orders' AS relation, round(avg(degree), 6) AS mean, quantile_cont(degree, 0.5)::DOUBLE AS p50, quantile_cont(degree, 0.9)::DOUBLE AS p90, quantile_cont(degree, 0.99)::DOUBLE AS p99, max(degree)::BIGINT AS max, round(avg((degree = 0)::INT::DOUBLE), 6) AS zero_frac FROM deg""")
def agg06(spark, sf):
    return R.distribution(join06(spark, sf).withColumn("relation", F.lit("orders")), "degree", "relation")


CAND_SQL = f"""WITH seeds AS ({SEED_SQL}), cand AS (
SELECT seed_id, 'customer' AS tbl, seed_id AS row, 0::BIGINT AS hop, {R.STATIC}::BIGINT AS ts FROM seeds
UNION ALL SELECT seed_id, 'orders', o_orderkey, 1, epoch(o_orderdate)::BIGINT FROM seeds JOIN orders ON o_custkey = entity AND epoch(o_orderdate)::BIGINT <= seed_ts
UNION ALL SELECT seed_id, 'nation', c_nationkey::BIGINT, 1, {R.STATIC} FROM seeds JOIN customer ON c_custkey = entity)"""


def candidates(spark, sf):
    s = seeds(spark, sf)
    zero, one = F.lit(0).cast("long").alias("hop"), F.lit(1).cast("long").alias("hop")
    root = s.select("seed_id", F.lit("customer").alias("tbl"), F.col("seed_id").alias("row"), zero, F.lit(R.STATIC).alias("ts"))
    near = R.temporal_neighbours(s, read_table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate", 1 << 30)
    kids = near.select("seed_id", F.lit("orders").alias("tbl"), F.col("child_key").alias("row"), one, F.col("child_time").alias("ts"))
    up = s.join(read_table(spark, sf, "customer"), F.col("entity") == F.col("c_custkey")).select("seed_id", F.lit("nation").alias("tbl"), F.col("c_nationkey").cast("long").alias("row"), one, F.lit(R.STATIC).alias("ts"))
    return root.unionByName(kids).unionByName(up)


ORDER_SQL = CAND_SQL + ", ordered AS (SELECT *, row_number() OVER (PARTITION BY seed_id, tbl ORDER BY hop, ts DESC, row)::BIGINT AS \"order\" FROM cand)"


@register("WIN01_candidate_order", ORDER_SQL + " SELECT * FROM ordered")
def win01(spark, sf):
    return R.candidate_order(candidates(spark, sf))


@register("WIN02_even_split", ORDER_SQL + """, turns AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY "order", tbl, row) AS turn FROM ordered) SELECT seed_id, tbl, row, hop, ts, "order" FROM turns WHERE turn <= 5""")
def win02(spark, sf):
    return R.even_split(R.candidate_order(candidates(spark, sf)), 5)


@register("WIN03_dense_positions", CAND_SQL + " SELECT *, (row_number() OVER (PARTITION BY seed_id ORDER BY hop, tbl, row) - 1)::BIGINT AS pos FROM cand")
def win03(spark, sf):
    return R.dense_positions(candidates(spark, sf))


@register("WIN04_hop_counts", CAND_SQL + " SELECT seed_id, hop, count(*)::BIGINT AS n, sum(count(*)) OVER (PARTITION BY seed_id ORDER BY hop)::BIGINT AS upto FROM cand GROUP BY 1, 2")
def win04(spark, sf):
    from pyspark.sql.window import Window

    counts = candidates(spark, sf).groupBy("seed_id", "hop").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("upto", F.sum("n").over(Window.partitionBy("seed_id").orderBy("hop")))


@register("AGG38_table_histogram", CAND_SQL + " SELECT tbl, count(*)::BIGINT AS n FROM cand GROUP BY 1")
def agg38(spark, sf):
    return candidates(spark, sf).groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))


#: Orders and parts of a customer, joined by line items, which are link rows: (order, part) pairs that were shipped in time.
BRIDGE_SQL = CAND_SQL + """, lines AS (SELECT DISTINCT seed_id, l_orderkey, l_partkey, l_orderkey * 1000000 + l_partkey AS row FROM cand JOIN lineitem ON tbl = 'orders' AND l_orderkey = row),
more AS (SELECT * FROM cand UNION ALL SELECT seed_id, 'lineitem', row, 2, 0 FROM lines UNION ALL SELECT DISTINCT seed_id, 'part', l_partkey, 3, 0 FROM lines),
ordered AS (SELECT *, row_number() OVER (PARTITION BY seed_id, tbl ORDER BY hop, ts DESC, row)::BIGINT AS "order" FROM more),
turns AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY "order", tbl, row) AS turn FROM ordered WHERE hop > 0 AND tbl <> 'lineitem'),
content AS (SELECT * EXCLUDE turn FROM turns WHERE turn <= 7),
alive AS (SELECT l.seed_id, l.row FROM lines l WHERE EXISTS (SELECT 1 FROM content c WHERE c.seed_id = l.seed_id AND (c.tbl = 'orders' AND c.row = l_orderkey OR c.tbl = 'part' AND c.row = l_partkey)))"""


@register("TOP04_allocate", BRIDGE_SQL + """ SELECT * FROM ordered WHERE hop = 0 UNION ALL SELECT * FROM content
UNION ALL SELECT o.* FROM ordered o SEMI JOIN alive a ON a.seed_id = o.seed_id AND a.row = o.row WHERE o.tbl = 'lineitem'""")
def top04(spark, sf):
    rows = candidates(spark, sf)
    lines = rows.where("tbl = 'orders'").join(read_table(spark, sf, "lineitem"), F.col("row") == F.col("l_orderkey"))
    lines = lines.select("seed_id", "l_orderkey", "l_partkey", (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("row")).distinct()
    as_rows = lambda df, tbl, row, hop: df.select("seed_id", F.lit(tbl).alias("tbl"), F.col(row).alias("row"), F.lit(hop).cast("long").alias("hop"), F.lit(0).cast("long").alias("ts"))
    rows = rows.unionByName(as_rows(lines, "lineitem", "row", 2)).unionByName(as_rows(lines, "part", "l_partkey", 3).distinct())
    ends = F.explode(F.array(F.struct(F.lit("orders").alias("other_tbl"), F.col("l_orderkey").alias("other")), F.struct(F.lit("part").alias("other_tbl"), F.col("l_partkey").alias("other"))))
    links = lines.select("seed_id", F.lit("lineitem").alias("tbl"), "row", ends.alias("end")).select("seed_id", "tbl", "row", "end.*")
    return R.allocate(rows, links, ["lineitem"], 8)


#: Bipartite sample graphs: of each order, its parts through lineitem as link rows.
LINK_SQL = """WITH pairs AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
links AS (SELECT l_orderkey AS graph_id, l_partkey AS part, 1000000000 + l_partkey AS link FROM pairs)"""


@register("GRF14_contract_links", LINK_SQL + """ SELECT DISTINCT graph_id, src, dst FROM (
SELECT a.graph_id, a.part AS src, b.part AS dst FROM links a JOIN links b ON a.graph_id = b.graph_id AND a.part < b.part)""")
def grf14(spark, sf):
    # all parts of an order hang on one link node, -1
    pairs = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_partkey").alias("pos")).distinct()
    nodes = pairs.select("graph_id", "pos", F.lit(1).alias("hop"), F.lit(False).alias("is_link"))
    hubs = pairs.select("graph_id").distinct().select("graph_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("hop"), F.lit(True).alias("is_link"))
    edges = pairs.select("graph_id", F.col("pos").alias("src"), F.lit(-1).cast("long").alias("dst"))
    return R.contract_links(nodes.unionByName(hubs), edges)


CHAIN_SQL = """WITH nodes AS (SELECT conv_id AS graph_id, turn AS pos FROM conversations), edges AS (
SELECT conv_id AS graph_id, turn AS src, turn + 1 AS dst FROM conversations c WHERE turn <> 2 AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1))"""


def chains(spark, sf):
    turns = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").cast("long").alias("pos"))
    nxt = turns.select("graph_id", (F.col("pos") - 1).alias("pos"))
    edges = turns.where("pos <> 2").join(nxt, ["graph_id", "pos"], "left_semi").select("graph_id", F.col("pos").alias("src"), (F.col("pos") + 1).alias("dst"))
    return turns, edges


@register("GRF15_drop_orphans", CHAIN_SQL + """, inside AS (SELECT graph_id, pos FROM nodes WHERE pos <= 2)
SELECT graph_id, pos, (row_number() OVER (PARTITION BY graph_id ORDER BY pos) - 1)::BIGINT AS new_pos FROM inside WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = inside.graph_id AND n.pos = 0)""")
def grf15(spark, sf):
    return R.drop_orphans(*chains(spark, sf))


@register("GRF16_oriented_edges", """
SELECT DISTINCT o_custkey AS graph_id, o_orderkey AS src, -1 - o_custkey AS dst FROM orders WHERE o_orderkey <> -1 - o_custkey""")
def grf16(spark, sf):
    orders = read_table(spark, sf, "orders")
    down = orders.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("a"), (-1 - F.col("o_custkey")).alias("b"), F.lit(True).alias("a_is_child"))
    up = orders.select(F.col("o_custkey").alias("graph_id"), (-1 - F.col("o_custkey")).alias("a"), F.col("o_orderkey").alias("b"), F.lit(False).alias("a_is_child"))
    return R.orient_child_to_parent(down.unionByName(up))


@register("GRF13_hetero_edges", """
WITH e AS (SELECT 'orders' AS src_table, o_orderkey::BIGINT AS src, 'f2p_o_custkey' AS edge_type, 'customer' AS dst_table, o_custkey::BIGINT AS dst FROM orders WHERE o_custkey IS NOT NULL
UNION ALL SELECT 'customer', c_custkey::BIGINT, 'f2p_c_nationkey', 'nation', c_nationkey::BIGINT FROM customer WHERE c_nationkey IS NOT NULL)
SELECT * FROM e UNION ALL SELECT dst_table, dst, 'rev_' || edge_type, src_table, src FROM e""")
def grf13(spark, sf):
    e = R.fkey_edges(R.tpch(spark, sf), ["orders", "customer"])
    down = e.select(F.col("child_table").alias("src_table"), F.col("child_key").alias("src"), F.concat(F.lit("f2p_"), "fkey").alias("edge_type"), F.col("parent_table").alias("dst_table"), F.col("parent_key").alias("dst"))
    up = down.select(F.col("dst_table").alias("src_table"), F.col("dst").alias("src"), F.concat(F.lit("rev_"), "edge_type").alias("edge_type"), F.col("src_table").alias("dst_table"), F.col("src").alias("dst"))
    return down.unionByName(up)
