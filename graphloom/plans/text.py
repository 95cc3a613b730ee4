"""Queries of string, hash and bucket functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import rowtext as R
from graphloom.plans.registry import register
from graphloom.storage import read_table

PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def norm_sql(x: str) -> str:
    # DuckDB's word boundary knows ASCII alone: articles are dropped as whole words
    words = f"string_split_regex(translate(replace(lower({x}), '<pad>', ' '), '{PUNCT}', ''), '\\s+')"
    return f"array_to_string(list_filter({words}, lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


@register("STR01_decode_escapes", "SELECT r_regionkey::BIGINT AS k, 'x' || r_name || '+' || r_regionkey || 'é' AS text FROM region")
def str01(spark, sf):
    coded = F.concat(F.lit("x"), "r_name", F.lit("$002B"), F.col("r_regionkey").cast("string"), F.lit("$00E9"))
    return read_table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("k"), T.decode_escapes(coded).alias("text"))


@register("STR02_verbalise_relation", "SELECT o_orderkey::BIGINT AS k, 'orders ' || o_orderstatus || ' in' AS last_two, o_orderstatus || ' in' AS last_one FROM orders WHERE o_orderkey IS NOT NULL")
def str02(spark, sf):
    rel = F.concat(F.lit("db.orders."), "o_orderstatus", F.lit("_in"))
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), T.verbalise_relation(rel, 2).alias("last_two"), T.verbalise_relation(rel, 1).alias("last_one"))


@register("STR03_normalise", f"SELECT item_id::BIGINT AS k, {norm_sql('text')} AS text FROM benchmark")
def str03(spark, sf):
    return read_table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("k"), T.normalise_answer(F.col("text")).alias("text"))


@register("STR04_match", f"SELECT p_partkey::BIGINT AS k, contains({norm_sql('p_name')}, 'red') AS hit FROM part")
def str04(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("k"), T.answers_match(F.col("p_name"), F.lit("The RED")).alias("hit"))


@register("STR05_parse_answers", "SELECT item_id::BIGINT AS k, len(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS parts FROM benchmark")
def str05(spark, sf):
    return read_table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("k"), F.size(T.parse_answers(F.col("text"), r"\.")).cast("long").alias("parts"))


#: Predicted and gold answers of a customer: names of parts in their first and last orders.
ANSWERS_SQL = "WITH a AS (SELECT o_custkey AS qid, list_distinct(list(o_orderpriority)) AS gold, list_distinct(list(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END)) AS pred FROM orders GROUP BY 1)"


@register("STR06_answer_scores", ANSWERS_SQL + """, n AS (SELECT qid, list_transform(gold, lambda g: """ + norm_sql("g") + """) AS g, list_transform(pred, lambda p: """ + norm_sql("p") + """) AS p FROM a),
m AS (SELECT qid, len(p) AS n, len(g) AS m, len(list_filter(g, lambda x: len(list_filter(p, lambda y: contains(y, x))) > 0)) AS k FROM n)
SELECT qid, round(k / n::DOUBLE, 6) AS "precision", round(k / m::DOUBLE, 6) AS recall, CASE WHEN k > 0 THEN round(2.0::DOUBLE * (k / n::DOUBLE) * (k / m::DOUBLE) / (k / n::DOUBLE + k / m::DOUBLE), 6) ELSE 0.0::DOUBLE END AS f1, (k > 0)::INT AS hit FROM m""")
def str06(spark, sf):
    value = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus"))
    rows = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("qid")).agg(F.collect_set("o_orderpriority").alias("gold"), F.collect_set(value).alias("pred"))
    s = T.answer_scores(F.col("pred"), F.col("gold"))
    return rows.select("qid", *(F.round(s[c], 6).alias(c) for c in ("precision", "recall", "f1")), s["hit"].alias("hit"))


@register("STR07_clean_value", "SELECT doc_id::BIGINT AS k, CASE WHEN length(t) > 64 THEN rtrim(t[:64]) || '…' ELSE t END AS text FROM (SELECT doc_id, nullif(trim(regexp_replace(replace(text, '~', '; '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '') AS t FROM documents)")
def str07(spark, sf):
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("k"), R.clean_value(F.col("text"), 64).alias("text"))


@register("STR08_relative_days", "SELECT o_orderkey::BIGINT AS k, CASE WHEN d >= 0 THEN d || 'd before' ELSE 'FUTURE+' || -d || 'd' END AS text FROM (SELECT o_orderkey, floor((epoch(TIMESTAMP '1999-06-30') - epoch(o_orderdate)) / 86400)::BIGINT AS d FROM orders)")
def str08(spark, sf):
    ts = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), R.relative_days(ts, F.unix_seconds(F.lit("1999-06-30").cast("timestamp"))).alias("text"))


@register("STR09_row_text", "SELECT c_custkey::BIGINT AS k, 'name: ' || c_name || CASE WHEN c_acctbal >= 0 THEN ' | segment: ' || c_mktsegment ELSE '' END AS kv, c_name || ' | ' || CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '-' END AS aligned, 'name | segment' AS header FROM customer")
def str09(spark, sf):
    fields = {"name": F.col("c_name"), "segment": F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))}
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), R.key_value(fields).alias("kv"), R.aligned(fields).alias("aligned"), R.header(fields).alias("header"))


@register("STR10_hoisted_tables", "SELECT c_nationkey::BIGINT AS seed, sum(length('name: ' || c_name || ' | segment: ' || c_mktsegment))::BIGINT AS kv, (sum(length(c_name || ' | ' || c_mktsegment)) + 14)::BIGINT AS schema_node, sum(length(c_name || ' | ' || c_mktsegment)) + 14 < sum(length('name: ' || c_name || ' | segment: ' || c_mktsegment)) AS hoist FROM customer GROUP BY 1")
def str10(spark, sf):
    fields = {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}
    rows = read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("seed"))
    out = rows.agg(F.sum(F.length(R.key_value(fields))).alias("kv"), (F.sum(F.length(R.aligned(fields))) + len(" | ".join(fields))).alias("schema_node"))
    return out.withColumn("hoist", F.col("schema_node") < F.col("kv"))


@register("STR11_question_text", "SELECT c_custkey::BIGINT AS k, 'Will customer ' || c_custkey || ' order within 90 days?' AS question, CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS answer FROM customer")
def str11(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), T.forecast_question("customer", F.col("c_custkey"), 90).alias("question"), T.yes_no(F.col("c_acctbal") > 0).alias("answer"))


@register("STR12_spreadsheet_label", "SELECT p_partkey::BIGINT AS k, CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(65 + (i - 26) // 26) || chr(65 + (i - 26) % 26) ELSE chr(65 + (i - 702) // 676) || chr(65 + ((i - 702) // 26) % 26) || chr(65 + (i - 702) % 26) END AS label FROM (SELECT p_partkey, (p_partkey % 18278)::INT AS i FROM part)")
def str12(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("k"), T.spreadsheet_label(F.col("p_partkey") % 18278).alias("label"))


@register("STR13_ordinal", "SELECT p_partkey::BIGINT AS k, p_partkey || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st' WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS text FROM part")
def str13(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("k"), T.ordinal(F.col("p_partkey")).alias("text"))


@register("STR15_templates", "SELECT n_nationkey::BIGINT AS k, 'The access code of ' || n_name || ' is ' || n_regionkey || '.' AS text FROM nation")
def str15(spark, sf):
    return read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), T.needle_sentence(F.col("n_name"), F.col("n_regionkey")).alias("text"))


@register("STR19_flat_text", "SELECT n_regionkey::BIGINT AS graph_id, string_agg('nation ' || n_nationkey || ' | in_region | region ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def str19(spark, sf):
    line = F.concat_ws(" | ", F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")), F.lit("in_region"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))
    rows = read_table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("graph_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("x"))
    return rows.select("graph_id", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("text"))


@register("STR19_conversation_text", "SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def str19b(spark, sf):
    rows = read_table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("text"))


@register("MTH01_stable_seed", "SELECT c_custkey::BIGINT AS k, ('0x' || sha256('train:' || c_custkey)[:8])::BIGINT & 2147483647 AS seed FROM customer")
def mth01(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), T.stable_seed(F.lit("train"), F.col("c_custkey")).alias("seed"))


@register("MTH03_stable_token", "SELECT c_custkey::BIGINT AS k, sha256(c_name)[:8] AS token FROM customer")
def mth03(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), T.stable_token(F.col("c_name")).alias("token"))


@register("MTH04_buckets", """WITH b AS (SELECT doc_id, n_chars, greatest(1, (n_chars + 511) // 512) AS n FROM documents), p AS (SELECT *, (1::BIGINT << floor(log2(n) + 1e-12)::INT) AS lo FROM b)
SELECT doc_id, ((n_chars + 127) // 128 * 128)::BIGINT AS aligned, (512 * CASE WHEN n = lo THEN lo WHEN lo > 1 AND n <= lo * 3 // 2 THEN lo * 3 // 2 ELSE lo * 2 END)::BIGINT AS bucket FROM p""")
def mth04(spark, sf):
    n = F.col("n_chars")
    return read_table(spark, sf, "documents").select("doc_id", T.align_up(n, 128).alias("aligned"), T.bucket_pow2(n, 512).alias("bucket"))


@register("UDF05_bucket_list", "SELECT p_partkey::BIGINT AS k, CASE WHEN p_size <= 16 THEN 16 WHEN p_size <= 32 THEN 32 ELSE 64 END::INT AS bucket FROM part")
def udf05(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("k"), T.bucket_list(F.col("p_size"), [16, 32, 64]).alias("bucket"))


@register("MTH09_time_seconds", "SELECT o_orderkey::BIGINT AS k, coalesce(CASE WHEN o_orderkey % 10 <> 0 THEN epoch(o_orderdate)::BIGINT END, -1099511627776) AS t FROM orders")
def mth09(spark, sf):
    from graphloom.operators.relational import seconds

    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), seconds(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))).alias("t"))


@register("MTH10_size_text", "SELECT o_orderkey::BIGINT AS k, CASE WHEN n >= 1000000 THEN n // 1000000 || 'M' WHEN n >= 1000 THEN n // 1000 || 'k' ELSE n::VARCHAR END AS text FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS n FROM orders)")
def mth10(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), T.size_text(F.col("o_orderkey") * F.col("o_orderkey")).alias("text"))


@register("ARR10_json_field", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def arr10(spark, sf):
    return read_table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("ARR11_pattern_map", "SELECT event_id, regexp_extract(props, '\"(\\w+)\": (\\d+)', 1) AS name, regexp_extract(props, '\"(\\w+)\": (\\d+)', 2) AS value FROM events")
def arr11(spark, sf):
    pattern = F.lit(r'"(\w+)": (\d+)')
    m = F.map_from_arrays(F.regexp_extract_all("props", pattern, F.lit(1)), F.regexp_extract_all("props", pattern, F.lit(2)))
    return read_table(spark, sf, "events").select("event_id", F.explode(m).alias("name", "value"))
