"""Queries of collections on storage: readers, sinks, chunk folders, record shapes and prose graphs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from graphloom.operators import datasets as D
from graphloom.operators import kg as K
from graphloom.operators import prose as P
from graphloom.operators import structure as S
from graphloom.operators import sweep as W
from graphloom.operators.textgraph import TextGraphs
from graphloom.plans.registry import register
from graphloom.plans.structure import GRAPH_SQL, graphs
from graphloom.sources import files, reports, sinks
from graphloom.storage import fresh_path, materialize, read_table


@register("SRC02_normalised_records", """WITH names AS (SELECT c_custkey AS id, 'n' || c_custkey AS name FROM customer WHERE c_custkey % 3 <> 0),
named AS (SELECT o.*, coalesce(name, 'UNLINKED_ENTITY') AS who FROM orders o LEFT JOIN names ON id = o_custkey)
SELECT o_orderkey AS id, CASE WHEN who = 'UNLINKED_ENTITY' THEN 'own ' || o_custkey ELSE who END AS entity, who AS head, o_orderstatus AS tail, who AS root FROM named""")
def src02(spark, sf):
    orders, code = read_table(spark, sf, "orders"), F.col("o_custkey").cast("string")
    records = orders.select(
        F.col("o_orderkey").alias("id"),
        F.array(F.concat(F.lit("own "), code)).alias("entities"),
        F.array(code).alias("entities_cid"),
        F.array(F.struct(code.alias("h"), F.lit("placed").alias("r"), F.col("o_orderstatus").alias("t"))).alias("tuples"),
        F.array(F.struct(code.alias("root"), F.array(F.lit("placed")).alias("relations"))).alias("paths"),
    )
    names = read_table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), "c_custkey").alias("name"))
    out = D.normalise_records(records, "coded", names)
    return out.select("id", F.col("entities")[0].alias("entity"), F.col("tuples")[0]["h"].alias("head"), F.col("tuples")[0]["t"].alias("tail"), F.col("paths")[0]["root"].alias("root"))


@register("SRC03_json_array", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def src03(spark, sf):
    path = fresh_path(spark, "json-array")
    rows = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    # the source is one file that is one array, as such files are
    rows.groupBy().agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value")).write.text(path)
    return files.json_array(spark, path, "id long, name string")


@register("SRC04_numbered_lines", "SELECT c_custkey AS id, c_name AS value FROM customer WHERE c_custkey % 2 = 0")
def src04(spark, sf):
    path, c = fresh_path(spark, "lines"), read_table(spark, sf, "customer")
    # line k of the file is the name of customer k
    c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("value")).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    first = c.agg(F.min("c_custkey").alias("k")).first()["k"]
    needed = c.where("c_custkey % 2 = 0").select((F.col("c_custkey") - first).alias("id"))
    return files.numbered_lines(spark, path, needed).withColumn("id", F.col("id") + first)


@register("SRC08_citation_graph", "SELECT p_partkey AS node, count(l_orderkey)::BIGINT AS cited FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def src08(spark, sf):
    folder = fresh_path(spark, "citations")
    read_table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("title")).write.parquet(f"{folder}/nodes")
    read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_partkey").alias("dst")).write.parquet(f"{folder}/edges")
    nodes, edges = D.citation_graph(spark, folder)
    cited = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("cited"))
    return nodes.select("node").join(cited, "node", "left").na.fill(0, ["cited"])


@register("SRC11_config_values", "SELECT * FROM (VALUES ('lr', '0.001'), ('note', '\"a // b\"'), ('seeds', '[0, 1]')) t(key, value)")
def src11(spark, sf):
    config = W.parse_config('{"lr": 1e-3, // rate\n "note": "a // b", /* kept */ "seeds": [0, 1,],}')
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in config.items()], "key string, value string")


@register("SRC12_run_records", "SELECT 's' || s_suppkey AS run, s_acctbal AS score, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::BIGINT END AS extra FROM supplier")
def src12(spark, sf):
    path, s = fresh_path(spark, "runs"), read_table(spark, sf, "supplier")
    if files.run_records(spark, path) is not None:
        raise ValueError("records before any run")
    s.select(F.concat(F.lit("s"), "s_suppkey").alias("run"), F.col("s_acctbal").alias("score"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("long")).alias("extra")).write.json(path)
    return files.run_records(spark, path).select("run", "score", "extra")


@register("SRC14_tsv_map", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def src14(spark, sf):
    path = fresh_path(spark, "tsv")
    read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), "n_name").write.option("sep", "\t").csv(path)
    return files.tsv(spark, path, "k long, name string")


def conversation_graphs(spark, sf, low=None, high=None):
    """Conversations as collections: turns are nodes, and each is joined to the one after it."""
    c = read_table(spark, sf, "conversations")
    c = c if low is None else c.where((F.col("conv_id") >= low) & (F.col("conv_id") < high))
    nodes = c.select(F.col("conv_id").alias("graph_id"), F.col("turn").cast("long").alias("node"), "text")
    edges = nodes.select("graph_id", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    return TextGraphs(nodes.select("graph_id").distinct(), nodes, edges)


SIZES_SQL = "SELECT {label} AS ds_label, count(DISTINCT conv_id)::BIGINT AS graphs, count(*)::BIGINT AS nodes FROM conversations GROUP BY ALL"


def sizes(tg):
    n = tg.nodes.join(tg.graphs.select("graph_id", "ds_label").distinct(), "graph_id")
    return n.groupBy("ds_label").agg(F.countDistinct("graph_id").alias("graphs"), F.count(F.lit(1)).alias("nodes"))


@register("SRC15_legacy_collection", "SELECT 1 AS versions, 'original' AS ordering, count(DISTINCT conv_id)::BIGINT AS graphs, count(*)::BIGINT AS nodes, 9::BIGINT AS label_chars FROM conversations")
def src15(spark, sf):
    path, tg = fresh_path(spark, "legacy"), conversation_graphs(spark, sf)
    for name in ("graphs", "nodes", "edges"):  # no meta and no label, as old builds are
        getattr(tg, name).write.parquet(f"{path}/{name}")
    old = TextGraphs.load(spark, path)
    facts = old.graphs.agg(F.countDistinct("graph_id").alias("graphs"), F.max(F.length("ds_label")).cast("long").alias("label_chars"))
    return facts.crossJoin(F.broadcast(old.nodes.agg(F.count(F.lit(1)).alias("nodes")))).select(F.lit(old.versions).alias("versions"), F.lit(old.ordering).alias("ordering"), "graphs", "nodes", "label_chars")


def cut_points(spark, sf, parts):
    ends = read_table(spark, sf, "conversations").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).first()
    width = -(-(ends["b"] + 1 - ends["a"]) // parts)
    return [ends["a"] + i * width for i in range(parts + 1)]


@register("SRC16_chunk_scan", SIZES_SQL.format(label="'train'"))
def src16(spark, sf):
    folder, at = fresh_path(spark, "chunks"), cut_points(spark, sf, 3)
    for a, b in zip(at, at[1:], strict=False):
        conversation_graphs(spark, sf, a, b).assign_label("old").save(f"{folder}/{a}-{b}.part")
    return sizes(D.load_parts(spark, D.chunk_paths(spark, folder), "train"))


@register("SRC20_shard_scan", "SELECT conv_id AS graph_id, count(*)::BIGINT AS nodes FROM conversations GROUP BY 1")
def src20(spark, sf):
    folder, at = fresh_path(spark, "shards"), cut_points(spark, sf, 2)
    for a, b in zip(at, at[1:], strict=False):
        conversation_graphs(spark, sf, a, b).save(f"{folder}/train_{a}-{b}.part")
    conversation_graphs(spark, sf).save(f"{folder}/trainer.part")  # another split with the same beginning
    return D.load_parts(spark, D.shard_paths(spark, folder, "train"), "x").nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))


@register("SRC17_many_datasets", """SELECT 'train' AS split, 'even' AS ds_label, count(DISTINCT conv_id)::BIGINT AS graphs FROM conversations
UNION ALL SELECT 'train', 'odd', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'test', 'odd', count(DISTINCT conv_id) FROM conversations""")
def src17(spark, sf):
    root, tg = fresh_path(spark, "many"), conversation_graphs(spark, sf)
    for name, split in (("even", "train"), ("odd", "train"), ("odd", "test")):
        tg.assign_label("stale").save(f"{root}/{name}/{split}")
    train, test = D.load_many(spark, root, ["even", "odd"], ["odd"])
    rows = train.graphs.select(F.lit("train").alias("split"), "ds_label", "graph_id")
    for part in test.values():
        rows = rows.unionByName(part.graphs.select(F.lit("test").alias("split"), "ds_label", "graph_id"))
    return rows.groupBy("split", "ds_label").agg(F.countDistinct("graph_id").alias("graphs"))


@register("SRC18_superset_build", "SELECT s_suppkey AS id, s_acctbal AS spd FROM supplier")
def src18(spark, sf):
    folder, s = fresh_path(spark, "builds"), read_table(spark, sf, "supplier")
    columns = {"spd": F.col("s_acctbal").alias("spd"), "rrwp": F.col("s_nationkey").alias("rrwp"), "text": F.col("s_name").alias("text")}
    built = {"spd-rrwp": {"spd", "rrwp"}, "all": set(columns), "text": {"text"}}
    for key, names in built.items():
        s.select(F.col("s_suppkey").alias("id"), *(columns[n] for n in sorted(names))).write.parquet(f"{folder}/{key}")
    return spark.read.parquet(f"{folder}/{D.superset_build(built, {'spd'}, 'spd')}").select("id", "spd")


@register("SRC19_split_records", "SELECT doc_id, lang FROM documents")
def src19(spark, sf):
    folder = fresh_path(spark, "split")
    read_table(spark, sf, "documents").select("doc_id", "lang").write.json(f"{folder}/train.jsonl")
    return files.json_lines(spark, f"{folder}/train.jsonl", "doc_id long, lang string")


@register("SRC21_job_arguments", "SELECT n_nationkey::BIGINT AS k, 'lab.tasks' AS module, 'n_' || n_nationkey AS name, '1,2' AS dims FROM nation")
def src21(spark, sf):
    scripts = [(r["n_nationkey"], f"#!/bin/sh\nset -e\n  python -m lab.tasks --name 'n_{r['n_nationkey']}' \\\n    --dims 1,2\n") for r in read_table(spark, sf, "nation").collect()]  # scripts are small and few
    parsed = [(k, *D.parse_job_script(text, {"lab.tasks"})) for k, text in scripts]
    return spark.createDataFrame([(k, m, a[a.index("--name") + 1], a[a.index("--dims") + 1]) for k, m, a in parsed], "k long, module string, name string, dims string")


@register("SNK01_atomic_save", SIZES_SQL.format(label="'new'"))
def snk01(spark, sf):
    path, tg = fresh_path(spark, "saved"), conversation_graphs(spark, sf)
    tg.assign_label("old").save(path)
    TextGraphs.load(spark, path).assign_label("new").save(path)  # read from what is replaced
    return sizes(TextGraphs.load(spark, path))


@register("SNK03_appended_records", "SELECT n_name AS name, 2::BIGINT AS times FROM nation")
def snk03(spark, sf):
    path, n = fresh_path(spark, "appended"), read_table(spark, sf, "nation").select("n_name")
    sinks.append_records(n, path)
    sinks.append_records(n, path)
    return spark.read.json(path).where("written_at is not null").groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("times"))


@register("SNK04_replaced_records", "SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def snk04(spark, sf):
    from graphloom.storage import replace_table

    path, o = fresh_path(spark, "replaced"), read_table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"))
    replace_table(o.limit(3), path)
    replace_table(o, path)
    return spark.read.schema("status string").json(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("SNK05_manifest", "SELECT count(*)::BIGINT AS rows, 'k3' AS build FROM part")
def snk05(spark, sf):
    facts = json.loads(sinks.manifest(read_table(spark, sf, "part"), build="k3"))
    return spark.createDataFrame([(facts["rows"], facts["build"])], "rows long, build string")


@register("SNK06_predictions", "SELECT o_orderkey AS row_id, round(o_totalprice / 1000, 6) AS margin, (o_orderstatus = 'F')::INT::DOUBLE AS y_true FROM orders")
def snk06(spark, sf):
    path = fresh_path(spark, "predictions")
    reports.write_predictions(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.round(F.col("o_totalprice") / 1000, 6).alias("margin"), (F.col("o_orderstatus") == "F").cast("int").alias("y_true")), path)
    return spark.read.parquet(path)


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line long, text string")


@register("SNK07_markdown", """WITH r AS (SELECT r_name, avg(s_acctbal) AS v, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT 0::BIGINT AS line, '| region | balance | n |' AS text UNION ALL SELECT 1, '| --- | ---: | ---: |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_name), '| ' || r_name || ' | ' || printf('%.4f', v) || ' | ' || n || ' |' FROM r""")
def snk07(spark, sf):
    joined = read_table(spark, sf, "region").join(read_table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(read_table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = joined.groupBy(F.col("r_name").alias("region")).agg(F.avg("s_acctbal").alias("balance"), F.count(F.lit(1)).alias("n")).orderBy("region").collect()  # a row for each region
    return lines(spark, sinks.markdown_table([r.asDict() for r in rows]))


@register("SNK08_latex", """WITH m AS (SELECT lang, round(avg(n_chars)) AS a, count(*) AS b FROM documents WHERE lang IS NOT NULL GROUP BY 1),
k AS (SELECT lang, printf('%.1f', a) AS ta, dense_rank() OVER (ORDER BY a DESC) AS ra, printf('%.1f', b::DOUBLE) AS tb, dense_rank() OVER (ORDER BY b DESC) AS rb FROM m)
SELECT lang || ' & ' || CASE ra WHEN 1 THEN '\\textbf{' || ta || '}' WHEN 2 THEN '\\underline{' || ta || '}' ELSE ta END || ' & ' || CASE rb WHEN 1 THEN '\\textbf{' || tb || '}' WHEN 2 THEN '\\underline{' || tb || '}' ELSE tb END || ' \\\\' AS text FROM k""")
def snk08(spark, sf):
    rows = read_table(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.round(F.avg("n_chars")).alias("chars"), F.count(F.lit(1)).cast("double").alias("docs")).orderBy("lang").collect()  # a row for each language
    text = reports.latex_table([r.asDict() for r in rows], "lang", ["chars", "docs"])
    return lines(spark, text).where(F.col("text").contains(" & ") & ~F.col("text").startswith("lang")).select("text")


CELLS_SQL = "WITH c AS (SELECT (o_custkey % 2)::INT AS k, (o_orderkey % 3)::INT AS nodes, (o_orderkey % 2)::INT AS tokens, (o_orderkey % 5)::INT AS shard, avg((o_orderstatus = 'F')::INT) AS em, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT k, nodes, tokens, sum(round(em * n)) / sum(n) AS v, sum(n) AS m FROM c GROUP BY ALL)"


@register("SNK09_grid_tables", CELLS_SQL + " SELECT k::VARCHAR || ' ' || nodes || ' ' || tokens || ' ' || printf('%.3f', v) AS text FROM p")
def snk09(spark, sf):
    o = read_table(spark, sf, "orders")
    cells = o.groupBy((F.col("o_custkey") % 2).cast("int").alias("k"), (F.col("o_orderkey") % 3).cast("int").alias("nodes"), (F.col("o_orderkey") % 2).cast("int").alias("tokens"), (F.col("o_orderkey") % 5).alias("shard")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("em"), F.count(F.lit(1)).alias("n"))
    out, k, across = [], "", []
    for line in reports.grid_markdown(cells).split("\n"):
        parts = [x.strip() for x in line.strip("|").split("|")]
        if line.startswith("k = "):
            k = line[4:]
        elif parts[0].startswith("N"):
            across = parts[1:]
        elif line.startswith("|") and not parts[0].startswith("-"):
            out += [(f"{k} {parts[0]} {t} {x.split(' ')[0]}",) for t, x in zip(across, parts[1:], strict=True) if x]
    return spark.createDataFrame(out, "text string")


@register("SNK10_pivot", """WITH m AS (SELECT l_linenumber AS a, l_returnflag AS b, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT '| ' || a || ' | ' || string_agg(printf('%.3f', v), ' | ' ORDER BY b) || ' |' AS text FROM m GROUP BY a""")
def snk10(spark, sf):
    text = reports.pivot_markdown(read_table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity")
    return lines(spark, text).where("line > 1").select("text")


@register("SNK12_node_link", GRAPH_SQL + " SELECT graph_id, (SELECT count(*) FROM nodes n WHERE n.graph_id = g.graph_id)::BIGINT AS nodes, (SELECT count(*) FROM edges e WHERE e.graph_id = g.graph_id)::BIGINT AS links FROM (SELECT DISTINCT graph_id FROM nodes) g")
def snk12(spark, sf):
    out = sinks.node_link_json(*graphs(spark, sf))
    parsed = F.from_json("value", "nodes array<struct<id:long>>, links array<struct<source:long,target:long>>")
    return out.select("graph_id", F.size(parsed["nodes"]).cast("long").alias("nodes"), F.size(parsed["links"]).cast("long").alias("links"))


@register("SNK13_document_dump", """WITH d AS (SELECT conv_id AS graph_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS t, sum(length(coalesce(text, ''))) AS chars FROM conversations GROUP BY 1)
SELECT graph_id, length(t) > 300 AS cut, CASE WHEN length(t) > 300 THEN t[:300] || chr(10) || '... [' || (length(t) - 300) || ' more characters]' ELSE t END AS document FROM d""")
def snk13(spark, sf):
    nodes = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("node"), "text")
    return reports.dump_documents(nodes, 300)


@register("SNK13_document_stats", """WITH d AS (SELECT conv_id, count(*) AS nodes, sum(length(coalesce(text, ''))) AS chars FROM conversations GROUP BY 1) SELECT count(*)::BIGINT AS docs, round(avg((chars > 300)::INT), 6) AS cut_share,
round(avg(nodes), 6) AS nodes_mean, quantile_cont(nodes, 0.5)::DOUBLE AS nodes_p50, quantile_cont(nodes, 0.9)::DOUBLE AS nodes_p90, max(nodes)::BIGINT AS nodes_max, round(avg(chars), 6) AS chars_mean, quantile_cont(chars, 0.5)::DOUBLE AS chars_p50, quantile_cont(chars, 0.9)::DOUBLE AS chars_p90, max(chars)::BIGINT AS chars_max FROM d""")
def snk13b(spark, sf):
    nodes = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("node"), "text")
    out = reports.document_stats(nodes, 300)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("mean", "share"))})


@register("SNK14_built_once", "SELECT count(*)::BIGINT AS rows, 1 AS builds FROM supplier")
def snk14(spark, sf):
    path, built = fresh_path(spark, "once"), []

    def build():
        built.append(1)
        return read_table(spark, sf, "supplier")

    rows = [sinks.build_once(spark, path, build).count() for _ in range(2)]
    return spark.createDataFrame([(rows[1], len(built))], "rows long, builds int")


@register("JOIN24_prompt_links", "SELECT DISTINCT o_custkey AS qid, 'PROMPT' AS src, o_orderstatus AS dst FROM orders WHERE o_orderstatus <> 'P'")
def join24(spark, sf):
    o = read_table(spark, sf, "orders")
    nodes = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("qid"), F.col("o_orderstatus").alias("node"), F.lit(False).alias("is_rel"), F.col("o_orderstatus").alias("text")).distinct()
    topics = o.select(F.col("o_custkey").alias("qid"), F.col("o_orderstatus").alias("node"))
    none = nodes.where("false").select("qid", F.col("node").alias("src"), F.col("node").alias("dst"))
    return K.add_prompt(nodes, none, topics, o.select(F.col("o_custkey").alias("qid"), F.lit("q").alias("text")).distinct())[1]


@register("MTH07_identity", "SELECT c_custkey AS k, sha256('{\"a\": ' || c_custkey || ', \"b\": \"x\"}')[:12] AS key FROM customer")
def mth07(spark, sf):
    def keys(batches):
        for pdf in batches:
            yield pdf.assign(key=[W.identity({"b": "x", "a": int(k)}) for k in pdf["k"]])

    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).mapInPandas(keys, "k long, key string")


@register("MTH11_cache_paths", """SELECT n_nationkey::BIGINT AS k, CASE n_nationkey % 3 WHEN 0 THEN 'd/t' WHEN 1 THEN 'd/t__q0.25_rw8' ELSE 'd/t__q0.1_rw8_m' || n_nationkey END AS path,
CASE n_nationkey % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'no-spd' WHEN 2 THEN 'no-spd+rrwp' ELSE 'linear+no-spd' END AS arm FROM nation""")
def mth11(spark, sf):
    defaults = {"q": 0.1, "m": 0, "w": 8, "v": 1}
    tags = {"q": "q{}", "w": "rw{}", "m": "m{}?"}
    out = []
    for r in read_table(spark, sf, "nation").collect():  # configurations are few
        k = r["n_nationkey"]
        path = D.cache_path("d/t", defaults | ({}, {"q": 0.25}, {"m": k})[k % 3], defaults, tags)
        flags = ({"spd": 1, "rrwp": 1, "magnetic": 1}, {"rrwp": 1, "magnetic": 1}, {"magnetic": 1}, {"rrwp": 1, "linear": 1})[k % 4]
        out.append((k, path, D.arm_label(flags, ["spd", "rrwp", "magnetic"], {"linear": ("linear", "magnetic")})))
    return spark.createDataFrame(out, "k long, path string, arm string")


@register("FLT08_role_splits", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 'train,dev,test' WHEN n_nationkey % 2 = 0 THEN 'train' WHEN n_nationkey % 3 = 0 THEN 'dev,test' ELSE '' END AS splits FROM nation")
def flt08(spark, sf):
    keys = [r["n_nationkey"] for r in read_table(spark, sf, "nation").collect()]  # datasets are few
    train, test = [str(k) for k in keys if k % 2 == 0], [str(k) for k in keys if k % 3 == 0]
    return spark.createDataFrame([(k, ",".join(D.role_splits(str(k), train, test))) for k in keys], "k long, splits string")


@register("FLT17_config_problems", "SELECT n_nationkey::BIGINT AS k, (n_nationkey % 2 + n_nationkey % 3 // 2 + (n_nationkey % 5 = 0)::INT)::BIGINT AS problems FROM nation")
def flt17(spark, sf):
    good = {"mode": "train", "node_counts": [8, 16], "token_counts": [64], "hops": 0, "hop_counts": [], "fan_out": 1, "train_shards": 2, "train_shard": 1, "code_len": 3, "k_hop": 0, "needle_tokens": 20, "slack": 8}
    out = []
    for r in read_table(spark, sf, "nation").collect():  # configurations are few
        k = r["n_nationkey"]
        bad = good | ({"mode": "walk"} if k % 2 else {}) | ({"train_shard": 2} if k % 3 == 2 else {}) | ({"token_counts": [28]} if k % 5 == 0 else {})
        out.append((k, len(D.config_problems(bad))))
    return spark.createDataFrame(out, "k long, problems long")


PROSE_KINDS = [*P.POINTERS, *P.WHOLE]
PROSE_SQL = f"""WITH o AS (SELECT o_orderkey AS graph_id, (3 + o_orderkey % 5)::BIGINT AS n, list_extract([{', '.join(f"'{k}'" for k in PROSE_KINDS)}], (o_orderkey % {len(PROSE_KINDS)} + 1)::INT) AS kind FROM orders)"""


def prose_examples(spark, sf):
    """A path of 3 to 7 nodes for each order, told in prose, with a problem of each kind in turn."""
    n = 3 + F.col("o_orderkey") % 5
    kind = F.get(F.array(*map(F.lit, PROSE_KINDS)), (F.col("o_orderkey") % len(PROSE_KINDS)).cast("int"))
    numbers = F.sequence(F.lit(0), (n - 1).cast("int"))
    told = F.concat(F.lit("In an undirected graph G, the nodes "), F.array_join(F.transform(numbers, lambda i: i.cast("string")), ", "), F.lit(". The edges in G are: "), F.array_join(F.transform(F.slice(numbers, 1, (n - 1).cast("int")), lambda i: F.format_string("(%d, %d)", i, i + 1)), " "), F.lit(". Node 1 likes tea. Node 0 likes rain."))
    task = F.concat(F.lit("Q: Is node 0 connected to node 1? "), F.lit("Which nodes are not connected to 2? Does node 1 like tea? The degree of node 2 or the shortest path from node 0 to node 2. A: "))
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("graph_id"), kind.alias("problem_type"), told.alias("question"), task.alias("task_description"), F.lit("yes").alias("answer"), n.cast("string").alias("nnodes"), (n - 1).cast("string").alias("nedges"))


@register("GRF10_prose_graphs", PROSE_SQL + """ SELECT graph_id, (n + 1)::BIGINT AS nodes, (2 * (n - 1) + CASE WHEN kind IN ('edge_existence', 'reachability', 'shortest_path') THEN 2 WHEN kind IN ('cycle_check', 'node_count', 'edge_count', 'triangle_counting') THEN n ELSE 1 END)::BIGINT AS edges,
(CASE WHEN kind = 'node_classification' THEN 2 ELSE 0 END)::BIGINT AS told FROM o""")
def grf10(spark, sf):
    nodes, edges = P.prose_graphs(prose_examples(spark, sf))
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("text").contains(" likes "), 1)).alias("told"))
    return n.join(edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges")), "graph_id")


@register("GRF10_prose_incidence", PROSE_SQL + """ SELECT graph_id, (n + n - 1 + 2)::BIGINT AS nodes, (4 * (n - 1) + CASE WHEN kind IN ('edge_existence', 'reachability', 'shortest_path') THEN 2 WHEN kind IN ('cycle_check', 'node_count') THEN n WHEN kind = 'edge_count' THEN n - 1 WHEN kind = 'triangle_counting' THEN 2 * n - 1 ELSE 1 END)::BIGINT AS edges, 'A: yes' AS prompt FROM o""")
def grf10b(spark, sf):
    nodes, edges = P.prose_graphs(prose_examples(spark, sf), incidence=True, question_node=True)
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), F.max(F.when(F.col("is_prompt"), F.col("text"))).alias("prompt"))
    return n.join(edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges")), "graph_id")


ANSWER_SQL = """WITH a AS (SELECT o_custkey AS id, o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus ELSE '' END AS text, CASE o_orderkey % 4 WHEN 0 THEN 'm.' || o_orderstatus ELSE o_orderpriority END AS kb FROM orders),
s AS (SELECT *, CASE WHEN text <> '' THEN text WHEN kb NOT LIKE 'm.%' THEN kb END AS shown FROM a)"""


@register("STR16_gold_texts", ANSWER_SQL + ", g AS (SELECT id, coalesce(shown, kb) AS t, min(ord) AS first FROM s GROUP BY ALL) SELECT id, string_agg(t, '|' ORDER BY first) AS gold FROM g GROUP BY 1")
def str16(spark, sf):
    o = read_table(spark, sf, "orders")
    answers = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise("").alias("text"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("m."), "o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("kb_id"))
    lists = answers.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "kb_id"))).alias("answers"))
    return lists.select("id", F.array_join(K.gold_texts(F.col("answers")), "|").alias("gold"))


@register("GRF06_question_graphs", """WITH g AS (SELECT DISTINCT o_custkey AS qid, o_orderstatus AS answer FROM orders WHERE o_orderstatus <> 'P'), v AS (SELECT qid, version, answer, sha256('qg:' || qid || ':' || version || ':' || answer) AS mark FROM g, range(2) r(version)),
s AS (SELECT qid, version, string_agg(answer, ', ' ORDER BY mark, answer) AS answers FROM v GROUP BY ALL) SELECT qid, version::INT AS version, 'Q' || qid || ' A: ' || answers AS text, len(string_split(answers, ', '))::BIGINT AS pointed FROM s""")
def grf06(spark, sf):
    o = read_table(spark, sf, "orders")
    triples = o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), "o_custkey").alias("h"), F.lit("a.b").alias("r"), F.col("o_orderstatus").alias("t"))
    nodes, edges = K.levi_graph(triples)
    gold = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("qid"), F.col("o_orderstatus").alias("node"), F.col("o_orderstatus").alias("text"))
    prompts = o.select(F.col("o_custkey").alias("qid"), F.concat(F.lit("Q"), F.col("o_custkey").cast("string"), F.lit(" A: ")).alias("text")).distinct()
    n, e = K.question_graphs(nodes, edges, gold.select("qid", "node"), prompts, gold, versions=2, most=5, sep=", ", seed="qg")
    pointed = e.where("src = 'PROMPT'").groupBy("qid", "version").agg(F.count(F.lit(1)).alias("pointed"))
    return n.where("node = 'PROMPT'").select("qid", "version", "text").join(pointed, ["qid", "version"])
