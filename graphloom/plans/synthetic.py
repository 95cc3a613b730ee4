"""Queries of generators, sources, sinks, sweeps and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import generators as G
from graphloom.operators import sweep as W
from graphloom.plans.registry import register
from graphloom.sources import files, sinks
from graphloom.storage import fresh_path, read_table
from graphloom.streaming import events as E


def u(*parts: str) -> str:
    text = " || ':' || ".join(p if p.startswith("(") or p.isidentifier() else f"'{p}'" for p in parts)
    return f"(('0x' || sha256({text})[:8])::BIGINT / 4294967296.0::DOUBLE)"


@register("GEN04_connected_skeleton", f"SELECT g AS graph_id, floor({u('(' + chr(39) + 'sk' + chr(39) + ')', 'g', 'n')} * n)::BIGINT AS src, n AS dst FROM range(40) a(g), range(1, 12) b(n)")
def gen04(spark, sf):
    return G.connected_skeleton(spark, 40, 12, "sk")


@register("GEN12_out_degree", f"SELECT g AS graph_id, s AS node, count(*)::BIGINT AS answer FROM range(40) a(g), range(6) b(s), range(6) c(d) WHERE s <> d AND {u('(' + chr(39) + 'gnp' + chr(39) + ')', 'g', 's', 'd')} < 0.4 GROUP BY 1, 2")
def gen12(spark, sf):
    return G.random_digraph(spark, 40, 6, 0.4, "gnp").groupBy("graph_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("answer"))


@register("GEN06_clique_pairs", f"""WITH s AS (SELECT g, floor(3 + {u('(' + chr(39) + 'cl' + chr(39) + ')', 'g', '(' + chr(39) + 'a' + chr(39) + ')')} * 4)::BIGINT AS a, floor(3 + {u('(' + chr(39) + 'cl' + chr(39) + ')', 'g', '(' + chr(39) + 'b' + chr(39) + ')')} * 4)::BIGINT AS b FROM range(30) t(g))
SELECT g AS graph_id, x AS src, y AS dst FROM s, range(12) i(x), range(12) j(y) WHERE x < y AND y < a + b AND (x < a) = (y < a)""")
def gen06(spark, sf):
    return G.clique_pairs(spark, 30, 3, 6, "cl")


@register("GEN07_geometric_graph", f"""WITH p AS (SELECT g, n, {u('(' + chr(39) + 'geo' + chr(39) + ')', 'g', 'n', '(' + chr(39) + 'x' + chr(39) + ')')} AS x, {u('(' + chr(39) + 'geo' + chr(39) + ')', 'g', 'n', '(' + chr(39) + 'y' + chr(39) + ')')} AS y FROM range(10) a(g), range(40) b(n))
SELECT a.g AS graph_id, a.n AS src, b.n AS dst FROM p a JOIN p b ON a.g = b.g AND a.n < b.n WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.2::DOUBLE * 0.2::DOUBLE""")
def gen07(spark, sf):
    return G.geometric_graph(spark, 10, 40, 0.2, "geo")


@register("GEN10_needle_violations", """SELECT * FROM (VALUES ('node count', 0::BIGINT, 60::BIGINT), ('gold place', 0, 90), ('single holder', 0, 90), ('paired gold', 0, 10)) t(rule, n, broken)""")
def gen10(spark, sf):
    """Sound cells break no rule; of 50 examples, ten have a code too many, ten have a strange gold code, and ten have one in half of their cells."""
    sound = G.needle_cells(spark, 50, [8, 16, 32], [32, 64], "needle")
    kind = F.col("example") % 5
    gold = F.when(kind == 1, "ZZZZZ").when((kind == 2) & (F.col("cell_t") == 64), "YYYYY").otherwise(F.col("gold_code"))
    # cells with one code more than they may have keep their gold in place
    broken = sound.withColumns({"gold_code": gold, "codes": F.when(kind == 0, F.array_append("codes", F.lit("XXXXX"))).otherwise(F.col("codes"))})
    return G.needle_violations(sound).join(G.needle_violations(broken).withColumnRenamed("n", "broken"), "rule")


def needle_u(*parts):
    return "(('0x' || sha256(" + " || ':' || ".join(parts) + ")[:8])::BIGINT / 4294967296.0::DOUBLE)"


@register("GEN09_needle_cells", f"""WITH e AS (SELECT x AS example, floor({needle_u("'needle'", "x", "'gold'")} * 8)::BIGINT AS gold_slot, list_transform(range(32), lambda i: chr((65 + floor({needle_u("'needle'", "x", "i", "0")} * 26))::INT) || lpad(floor({needle_u("'needle'", "x", "i", "1")} * 10000)::INT::VARCHAR, 4, '0')) AS codes FROM range(50) t(x))
SELECT example, n::INT AS cell_n, t::INT AS cell_t, gold_slot, codes[gold_slot + 1] AS gold_code, codes[:n] AS codes FROM e, (VALUES (8), (16), (32)) a(n), (VALUES (32), (64)) b(t)""")
def gen09(spark, sf):
    return G.needle_cells(spark, 50, [8, 16, 32], [32, 64], "needle")


@register("GEN01_families", "SELECT g AS graph_id, 4::BIGINT AS generations, 17::BIGINT AS people, true AS spaced FROM range(20) t(g)")
def gen01(spark, sf):
    p = G.families(spark, 20, 4, 4, "fam")
    mothers = p.select("graph_id", F.col("person").alias("mother"), F.col("born").alias("mb"))
    gap = p.join(mothers, ["graph_id", "mother"], "left").withColumn("ok", F.coalesce((F.col("born") - F.col("mb")).between(20, 35), F.lit(True)))
    return gap.groupBy("graph_id").agg(F.countDistinct("generation").alias("generations"), F.count(F.lit(1)).alias("people"), F.min("ok").alias("spaced"))


@register("JOIN18_kin", "SELECT g AS graph_id, r AS relation, n FROM range(20) t(g), (VALUES ('parent', 24::BIGINT), ('child', 24), ('sibling', 36), ('grandparent', 16), ('grandchild', 16), ('aunt_or_uncle', 24)) v(r, n)")
def join18(spark, sf):
    return G.kin(G.families(spark, 20, 4, 4, "fam")).groupBy("graph_id", "relation").agg(F.count(F.lit(1)).alias("n"))


@register("JOIN17_closure", """WITH RECURSIVE e AS (SELECT 0::BIGINT AS graph_id, c_custkey // 7 AS src, c_custkey AS dst FROM customer WHERE c_custkey > 0), w AS (SELECT graph_id, src, dst, 1 AS d FROM e UNION ALL SELECT w.graph_id, w.src, e.dst, d + 1 FROM w JOIN e ON e.src = w.dst)
SELECT graph_id, src, dst, min(d)::BIGINT AS depth FROM w GROUP BY 1, 2, 3""")
def join17(spark, sf):
    e = read_table(spark, sf, "customer").where("c_custkey > 0").select(F.lit(0).cast("long").alias("graph_id"), F.floor(F.col("c_custkey") / 7).alias("src"), F.col("c_custkey").alias("dst"))
    # a chain of key // 7 has at most 23 links (7 ** 23 > 2 ** 63); the loop ends with the longest one
    return G.closure(e)


@register("SRC01_json_lines", "SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels")
def src01(spark, sf):
    path = fresh_path(spark, "labels-json")
    read_table(spark, sf, "labels").write.json(path)
    return files.json_lines(spark, path, "doc_id long, quality long, toxic long")


@register("SRC05_name_dump", "SELECT 'm.0' || c_custkey AS mid, c_name AS name FROM customer WHERE c_custkey % 2 = 0")
def src05(spark, sf):
    path = fresh_path(spark, "dump")
    predicate = F.when(F.col("c_custkey") % 2 == 0, "fb:type.object.name").otherwise("fb:type.object.type")
    line = F.format_string('<fb:m.0%d>\t<%s>\t"%s"\t.', "c_custkey", predicate, "c_name")
    read_table(spark, sf, "customer").select(line.alias("value")).write.option("compression", "bzip2").text(path)
    return files.name_dump(spark, path)


@register("SRC06_dictionary", "SELECT 'm.' || n_nationkey AS key, n_name AS value FROM nation")
def src06(spark, sf):
    path = fresh_path(spark, "dictionary")
    pairs = read_table(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m."), F.col("n_nationkey").cast("string")), "n_name")))).alias("value"))
    pairs.coalesce(1).write.text(path)
    return files.dictionary(spark, path)


@register("SRC13_progress_samples", "WITH s AS (SELECT user_id AS run, event_id AS step, (event_id * 3)::BIGINT AS elapsed FROM events) SELECT run, 10000::BIGINT AS total, step, min(elapsed)::BIGINT AS elapsed FROM s GROUP BY 1, 3")
def src13(spark, sf):
    s = F.col("event_id") * 3
    bar = lambda total: F.format_string("%d/%d [%d:%02d:%02d<?]", F.col("event_id"), F.lit(total), F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    lines = read_table(spark, sf, "events")
    noise = lines.where("event_id % 300 = 7").select(F.col("user_id").alias("run"), F.lit("3/5 [0:01<?]").alias("value"))
    return files.progress_samples(lines.select(F.col("user_id").alias("run"), F.concat(bar(10000), F.lit(" eval")).alias("value")).unionByName(noise))


@register("SRC10_corpus_tokens", "WITH w AS (SELECT doc_id AS line, string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+') AS w FROM documents WHERE trim(text) <> '' AND NOT contains(lower(text), 'access code')), s AS (SELECT line, w, sum(len(w)) OVER (ORDER BY line) AS upto FROM w) SELECT line, count(*)::BIGINT AS n FROM (SELECT line, unnest(w) AS t FROM s WHERE upto <= 5000) GROUP BY 1")
def src10(spark, sf):
    lines = read_table(spark, sf, "documents").select(F.col("doc_id").alias("line"), F.trim(F.regexp_replace("text", r"[\r\n\t]+$", "")).alias("value"))
    return files.corpus_tokens(lines, 5000).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@register("SNK02_chunks", "SELECT event_id, user_id FROM events")
def snk02(spark, sf):
    path = fresh_path(spark, "chunks")
    sinks.write_chunks(read_table(spark, sf, "events").select("event_id", "user_id"), path, 2000, "event_id")
    return spark.read.parquet(path)


@register("SNK15_shards", "SELECT event_id, value FROM events")
def snk15(spark, sf):
    path, rows = fresh_path(spark, "shards"), read_table(spark, sf, "events").select("event_id", "value")
    sinks.write_shards(rows, path, 5, "event_id")
    return sinks.merge_shards(spark, path, 5, rows.count())


@register("SNK11_chat_json", "SELECT conv_id, count(*)::BIGINT AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations GROUP BY 1")
def snk11(spark, sf):
    out = sinks.chat_json(read_table(spark, sf, "conversations"))
    turns = F.from_json("value", "conversations array<struct<from:string,value:string>>")["conversations"]
    return out.select("conv_id", F.size(turns).cast("long").alias("n"), F.aggregate(turns, F.lit(0).cast("long"), lambda a, x: a + F.length(x["value"])).alias("chars"))


@register("ORC01_sweep_expansion", "SELECT (s * 2 + k)::BIGINT AS run, s::VARCHAR AS seeds, k::VARCHAR AS k_hops, '0.001' AS bias_lr FROM range(2) a(s), range(2) b(k)")
def orc01(spark, sf):
    config = W.parse_config('{"name": "x", // a comment\n "seeds": [0, 1], "k_hops": [0, 1,], /* another */ "bias_lr": 1e-3}')
    return W.runs_frame(spark, W.expand(config)).groupBy("run").pivot("key", ["seeds", "k_hops", "bias_lr"]).agg(F.first("value"))


WINDOWS_SQL = "SELECT (epoch(ts)::BIGINT - epoch(ts)::BIGINT % 21600)::BIGINT AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM (SELECT *, date_trunc('second', ts) AS t2 FROM events) GROUP BY 1, 2".replace("epoch(ts)::BIGINT", "epoch(t2)::BIGINT")


@register("STM01_windowed_counts", WINDOWS_SQL)
def stm01(spark, sf):
    return E.windowed_counts(read_table(spark, sf, "events"), "6 hours").withColumn("total", F.round("total", 4))


@register("STM01_stream_windows", WINDOWS_SQL)
def stm01b(spark, sf):
    """The same windows from a stream that is read to its end: a last row, later than all windows, closes them."""
    folder, out, state = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")
    rows = read_table(spark, sf, "events")
    rows.repartitionByRange(4, "ts").write.parquet(folder)
    closed = E.drain(lambda: E.windowed_counts(E.event_stream(spark, folder, rows._jdf.schema().toDDL(), 4), "6 hours"), out, state)
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    end.select(*(F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes)).write.mode("append").parquet(folder)
    return closed(spark, "start long, event_type string, n long, total double").withColumn("total", F.round("total", 4))


@register("STM01_sessions", "WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS AS near FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def stm01c(spark, sf):
    return E.sessions(read_table(spark, sf, "events"), "2 hours")


@register("AGG31_least_squares", "SELECT round(regr_slope(value, event_id), 8) AS slope, round(regr_intercept(value, event_id), 6) AS intercept, round(regr_r2(value, event_id), 6) AS r2 FROM events")
def agg31(spark, sf):
    rows = read_table(spark, sf, "events").select(F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    fit = E.line_fit(E.moments(rows, "x", "y"))
    return fit.select(F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"))
