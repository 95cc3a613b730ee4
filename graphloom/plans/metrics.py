"""Queries of scores and reports; experiment records are stood in for by events: user = arm, type = metric, day = seed."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import metrics as M
from graphloom.operators import records as Q
from graphloom.plans.registry import register
from graphloom.storage import read_table

#: One margin and label for each labelled document: a score that is tied often.
SCORED_SQL = "WITH scored AS (SELECT source AS arm, ((n_chars % 37) - 18) / 8.0::DOUBLE AS margin, quality::BIGINT AS y FROM documents JOIN labels USING (doc_id))"


def scored(spark, sf):
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select(F.col("source").alias("arm"), ((F.col("n_chars") % 37 - 18) / 8.0).alias("margin"), F.col("quality").cast("long").alias("y"))


@register("AGG16_auroc", SCORED_SQL + """, r AS (SELECT arm, y, rank() OVER (PARTITION BY arm ORDER BY margin) + (count(*) OVER (PARTITION BY arm, margin) - 1) / 2.0 AS rk FROM scored)
SELECT arm, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN round(((sum(y * rk) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)))::DOUBLE, 6) ELSE 'NaN'::DOUBLE END AS auroc FROM r GROUP BY arm""")
def agg16(spark, sf):
    return M.auroc(scored(spark, sf).withColumnRenamed("margin", "score"), "arm").withColumn("auroc", F.round("auroc", 6))


@register("AGG16_score_readout", SCORED_SQL + """ SELECT arm, count(DISTINCT round(1.0 / (1.0 + exp(-margin)), 6))::BIGINT AS n_distinct, round(avg(margin), 6) AS margin_mean, round(avg(y::DOUBLE), 6) AS pos_rate FROM scored GROUP BY arm""")
def agg16b(spark, sf):
    return M.score_readout(scored(spark, sf), "arm").select("arm", "n_distinct", F.round("margin_mean", 6).alias("margin_mean"), F.round("pos_rate", 6).alias("pos_rate"))


@register("AGG17_tied_pairs", SCORED_SQL + """, s AS (SELECT arm, margin, sum(y) AS p, sum(1 - y) AS q FROM scored GROUP BY 1, 2)
SELECT arm, CASE WHEN sum(p) * sum(q) > 0 THEN round(sum(p * q) / (sum(p) * sum(q))::DOUBLE, 6) ELSE 'NaN'::DOUBLE END AS tied_fraction FROM s GROUP BY arm""")
def agg17(spark, sf):
    return M.tied_pair_fraction(scored(spark, sf).withColumnRenamed("margin", "score"), "arm").withColumn("tied_fraction", F.round("tied_fraction", 6))


@register("MTH05_sigmoid", SCORED_SQL + " SELECT arm, margin, round(1.0 / (1.0 + exp(-margin)), 6) AS p FROM scored")
def mth05(spark, sf):
    return scored(spark, sf).select("arm", "margin", F.round(M.sigmoid(F.col("margin")), 6).alias("p"))


#: Predicted and true classes: a document's source group against its language, with strangers among the predictions.
CLASSES_SQL = "WITH rows AS (SELECT source AS arm, lang AS gold, CASE WHEN n_chars % 3 = 0 THEN lang WHEN n_chars % 7 = 0 THEN 'xx' WHEN n_chars % 2 = 0 THEN 'en' ELSE 'de' END AS pred FROM documents)"


def classes(spark, sf):
    n = F.col("n_chars")
    pred = F.when(n % 3 == 0, F.col("lang")).when(n % 7 == 0, "xx").when(n % 2 == 0, "en").otherwise("de")
    return read_table(spark, sf, "documents").select(F.col("source").alias("arm"), F.col("lang").alias("gold"), pred.alias("pred"))


@register("AGG11_exact_match_macro_f1", CLASSES_SQL + """, g AS (SELECT arm, gold AS cls, count(*) AS support, sum((pred = gold)::INT) AS tp FROM rows GROUP BY 1, 2),
p AS (SELECT arm, pred AS cls, count(*) AS predicted FROM rows GROUP BY 1, 2),
stray AS (SELECT arm, sum(predicted) AS stray FROM p ANTI JOIN g USING (arm, cls) GROUP BY 1),
f AS (SELECT g.arm, support, tp, coalesce(predicted, 0) - tp + CASE WHEN row_number() OVER (PARTITION BY g.arm ORDER BY support DESC, g.cls) = 1 THEN coalesce(stray, 0) ELSE 0 END AS fp FROM g LEFT JOIN p USING (arm, cls) LEFT JOIN stray ON stray.arm = g.arm)
SELECT arm, round((sum(tp) / sum(support))::DOUBLE, 6) AS exact_match, round(avg(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + support - tp) ELSE 0 END)::DOUBLE, 6) AS macro_f1 FROM f GROUP BY arm""")
def agg11(spark, sf):
    return M.exact_match(classes(spark, sf), "arm").select("arm", F.round("exact_match", 6).alias("exact_match"), F.round("macro_f1", 6).alias("macro_f1"))


@register("AGG41_positive_ratio", SCORED_SQL + " SELECT count(*)::BIGINT AS n, round(avg(((margin > 0)::INT = y)::INT::DOUBLE), 6) AS exact_match, round(avg((margin > 0)::INT::DOUBLE), 6) AS positive_prediction_ratio FROM scored")
def agg41(spark, sf):
    up = (F.col("margin") > 0).cast("long")
    return scored(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg((up == F.col("y")).cast("double")), F.lit(0.0)), 6).alias("exact_match"), F.round(F.coalesce(F.avg(up.cast("double")), F.lit(0.0)), 6).alias("positive_prediction_ratio"))


QUESTIONS_SQL = "WITH q AS (SELECT c_custkey AS qid, c_mktsegment AS dataset, count(o_orderkey)::BIGINT AS gold, count(CASE WHEN o_orderstatus = 'F' THEN 1 END)::BIGINT AS present FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"


def questions(spark, sf):
    rows = read_table(spark, sf, "customer").join(read_table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy(F.col("c_custkey").alias("qid"), F.col("c_mktsegment").alias("dataset")).agg(F.count("o_orderkey").alias("gold"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("present"))


@register("AGG01_coverage_ceilings", QUESTIONS_SQL + """ SELECT dataset, round(avg((present >= 1)::INT::DOUBLE), 6) AS hits1, round(avg(present / gold::DOUBLE), 6) AS recall_macro, round((sum(present) / sum(gold)::DOUBLE), 6) AS recall_micro,
round(avg(2 * (present / gold::DOUBLE) / (1 + present / gold::DOUBLE)), 6) AS f1_macro, round(avg(least(present, 3) / gold::DOUBLE), 6) AS recall_macro_capped, round(sum(least(present, 3)) / sum(gold)::DOUBLE, 6) AS recall_micro_capped,
round(avg(2 * (least(present, 3) / gold::DOUBLE) / (1 + least(present, 3) / gold::DOUBLE)), 6) AS f1_macro_capped FROM q GROUP BY dataset""")
def agg01(spark, sf):
    out = M.coverage_ceilings(questions(spark, sf), 3, "dataset")
    return out.select("dataset", *(F.round(c, 6).alias(c) for c in out.columns if c != "dataset"))


@register("AGG02_first_failing_gate", QUESTIONS_SQL + """ SELECT dataset, CASE WHEN gold < 4 THEN 'few_answers' WHEN present = 0 THEN 'not_retrieved' WHEN present * 2 < gold THEN 'capped' ELSE 'kept' END AS gate, count(*)::BIGINT AS n FROM q GROUP BY 1, 2""")
def agg02(spark, sf):
    gates = {"few_answers": F.col("gold") < 4, "not_retrieved": F.col("present") == 0, "capped": F.col("present") * 2 < F.col("gold")}
    return questions(spark, sf).groupBy("dataset", Q.first_failing(gates, "kept").alias("gate")).agg(F.count(F.lit(1)).alias("n"))


LENGTHS_SQL = "SELECT lang AS grp, length(text)::BIGINT AS len FROM documents"


@register("AGG03_length_percentiles", f"""SELECT grp, round(avg(len), 6) AS mean, max(len)::BIGINT AS max, round(quantile_cont(len, 0.5), 4) AS p50, round(quantile_cont(len, 0.75), 4) AS p75, round(quantile_cont(len, 0.9), 4) AS p90, round(quantile_cont(len, 0.95), 4) AS p95, round(quantile_cont(len, 0.99), 4) AS p99 FROM ({LENGTHS_SQL}) GROUP BY grp""")
def agg03(spark, sf):
    rows = read_table(spark, sf, "documents").select(F.col("lang").alias("grp"), F.length("text").cast("long").alias("len"))
    p = lambda q: F.round(F.expr(f"percentile(len, {q})"), 4)
    return rows.groupBy("grp").agg(F.round(F.avg("len"), 6).alias("mean"), F.max("len").alias("max"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@register("AGG23_length_summary", f"""SELECT grp, count(*)::BIGINT AS n, round(avg(len), 6) AS mean, round(stddev_pop(len), 6) AS std_pop, min(len)::BIGINT AS min, max(len)::BIGINT AS max, round(quantile_cont(len, 0.1), 4) AS p10, round(quantile_cont(len, 0.5), 4) AS p50, round(quantile_cont(len, 0.9), 4) AS p90, round(quantile_cont(len, 0.99), 4) AS p99 FROM ({LENGTHS_SQL}) GROUP BY grp""")
def agg23(spark, sf):
    rows = read_table(spark, sf, "documents").select(F.col("lang").alias("grp"), F.length("text").cast("long").alias("len"))
    return M.length_summary(rows, "len", "grp").withColumns({"mean": F.round("mean", 6), "std_pop": F.round("std_pop", 6), **{q: F.round(q, 4) for q in ("p10", "p50", "p90", "p99")}})


@register("AGG23_length_histogram", f"SELECT len // 256 AS bin, count(*)::BIGINT AS n FROM ({LENGTHS_SQL}) GROUP BY 1")
def agg23b(spark, sf):
    return read_table(spark, sf, "documents").groupBy(F.floor(F.length("text") / 256).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


RUNS_SQL = "WITH runs AS (SELECT user_id AS arm, event_type AS task, floor(epoch(ts))::BIGINT // 86400 AS seed, avg(value) AS metric FROM events GROUP BY 1, 2, 3)"


def runs(spark, sf):
    events = read_table(spark, sf, "events")
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    return events.groupBy(F.col("user_id").alias("arm"), F.col("event_type").alias("task"), day.alias("seed")).agg(F.avg("value").alias("metric"))


@register("AGG08_mean_sd", RUNS_SQL + " SELECT arm, task, count(*)::BIGINT AS n, round(avg(metric), 7) AS mean, CASE WHEN count(*) > 1 THEN round(stddev_samp(metric), 7) ELSE 0.0::DOUBLE END AS sd FROM runs GROUP BY 1, 2")
def agg08(spark, sf):
    return M.mean_sd(runs(spark, sf), "metric", "arm", "task").withColumns({"mean": F.round("mean", 7), "sd": F.round("sd", 7)})


@register("AGG07_min_seeds", RUNS_SQL + " SELECT arm, task, count(*)::BIGINT AS n, CASE WHEN count(*) >= 10 THEN printf('%.1f', 100 * avg(metric * 0.73129417)) || ' ± ' || printf('%.1f', 100 * stddev_samp(metric * 0.73129417)) ELSE '?' END AS cell FROM runs GROUP BY 1, 2")
def agg07(spark, sf):
    # scaled, so that no mean of few decimals stands halfway between two texts
    return M.seeds_table(runs(spark, sf).withColumn("metric", F.col("metric") * 0.73129417), "metric", 10, "arm", "task").select("arm", "task", "n", "cell")


@register("AGG33_median_worst", RUNS_SQL + " SELECT task, round(median(metric), 6) AS median, round(max(metric), 6) AS worst FROM runs GROUP BY task")
def agg33(spark, sf):
    return runs(spark, sf).groupBy("task").agg(F.round(F.median("metric"), 6).alias("median"), F.round(F.max("metric"), 6).alias("worst"))


@register("AGG36_best_two", RUNS_SQL + ", m AS (SELECT arm, task, avg(round(metric)) AS v FROM runs GROUP BY 1, 2) SELECT * FROM (SELECT arm, task, round(v, 1) AS shown, dense_rank() OVER (PARTITION BY task ORDER BY round(v, 1) DESC)::BIGINT AS place FROM m) WHERE place <= 2")
def agg36(spark, sf):
    means = runs(spark, sf).groupBy("arm", "task").agg(F.avg(F.round("metric")).alias("v"))
    return M.rank_cells(means, "v", "task").select("arm", "task", "shown", "place")


@register("AGG42_last_write_wins", "SELECT user_id AS arm, event_type AS task, max(event_id)::BIGINT AS event_id, arg_max(value, event_id) AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2")
def agg42(spark, sf):
    rows = read_table(spark, sf, "events").select(F.col("user_id").alias("arm"), F.col("event_type").alias("task"), "event_id", "value")
    return M.latest_by(rows, "event_id", "arm", "task").select("arm", "task", "event_id", "value")


@register("AGG43_success_kept", "SELECT arm, task, event_id, ok FROM (SELECT user_id AS arm, event_type AS task, event_id::BIGINT AS event_id, (value >= 20) AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value >= 20) DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def agg43(spark, sf):
    rows = read_table(spark, sf, "events").select(F.col("user_id").alias("arm"), F.col("event_type").alias("task"), "event_id", (F.col("value") >= 20).alias("ok"))
    return Q.success_kept(rows, ["arm", "task"], "ok", "event_id")


@register("AGG45_crosstab", RUNS_SQL + ", m AS (SELECT seed, task, count(*)::BIGINT AS n FROM runs GROUP BY 1, 2) SELECT seed, max(CASE WHEN task = 'click' THEN n END) AS click, max(CASE WHEN task = 'view' THEN n END) AS view, max(CASE WHEN task = 'error' THEN n END) AS error FROM m GROUP BY seed")
def agg45(spark, sf):
    return runs(spark, sf).groupBy("seed").pivot("task", ["click", "view", "error"]).count()


@register("AGG46_delta_to_baseline", RUNS_SQL + ", m AS (SELECT arm, task, avg(metric) AS mean, stddev_pop(metric) AS sd, min(metric) AS lo FROM runs GROUP BY 1, 2) SELECT a.arm, a.task, round(a.mean, 7) AS mean, round(a.sd, 7) AS std_pop, round(a.lo, 7) AS min, round(100 * (a.mean - b.mean) / b.mean, 7) AS delta_percent FROM m a JOIN m b ON a.task = b.task AND b.arm = 0")
def agg46(spark, sf):
    m = runs(spark, sf).groupBy("arm", "task").agg(F.avg("metric").alias("mean"), F.stddev_pop("metric").alias("sd"), F.min("metric").alias("lo"))
    base = m.where("arm = 0").select("task", F.col("mean").alias("base"))
    return m.join(base, "task").select("arm", "task", F.round("mean", 7).alias("mean"), F.round("sd", 7).alias("std_pop"), F.round("lo", 7).alias("min"), F.round(100 * (F.col("mean") - F.col("base")) / F.col("base"), 7).alias("delta_percent"))


@register("AGG49_components", RUNS_SQL + ", m AS (SELECT arm, sum(CASE WHEN task = 'view' THEN metric END) AS none, sum(CASE WHEN task = 'click' THEN metric END) AS frozen, sum(CASE WHEN task = 'error' THEN metric END) AS full_ FROM runs GROUP BY arm) SELECT arm, round(frozen - none, 4) AS gather, round(full_ - frozen, 4) AS scatter FROM m")
def agg49(spark, sf):
    m = Q.mode_components(runs(spark, sf), "arm", "task", "metric", "view", "click", "error")
    return m.select("arm", F.round("gather", 4).alias("gather"), F.round("scatter", 4).alias("scatter"))


@register("AGG35_step_summary", "SELECT user_id AS run, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn > 3 GROUP BY 1")
def agg35(spark, sf):
    from pyspark.sql.window import Window

    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = read_table(spark, sf, "events").withColumn("rn", rn).where("rn > 3")
    return rows.groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.max("value").alias("peak"))


@register("AGG19_step_times", """WITH s AS (SELECT user_id AS run, event_id AS step, floor(epoch(ts))::BIGINT AS elapsed FROM events), w AS (SELECT run, step // 1000 AS w, min(step) AS s0, max(step) AS s1, arg_min(elapsed, step) AS e0, arg_max(elapsed, step) AS e1 FROM s GROUP BY 1, 2)
SELECT run, round(median((e1 - e0) / (s1 - s0)::DOUBLE), 6) AS rate FROM w WHERE s1 - s0 >= 60 GROUP BY run""")
def agg19(spark, sf):
    s = read_table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("elapsed"))
    return M.step_times(s, 1000).withColumn("rate", F.round("rate", 6))


W = "(p + 3.8416 / (2 * n)) / (1 + 3.8416 / n)", "1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)"
WILSON_SQL = f"CASE WHEN n > 0 THEN round(greatest(0, {W[0]} - {W[1]})::DOUBLE, 6) ELSE 0.0 END AS lo, CASE WHEN n > 0 THEN round(least(1, {W[0]} + {W[1]})::DOUBLE, 6) ELSE 0.0 END AS hi"


@register("AGG15_wilson", f"SELECT arm, {WILSON_SQL} FROM (SELECT user_id AS arm, count(*)::DOUBLE AS n, sum((event_type = 'click')::INT) / count(*)::DOUBLE AS p FROM events GROUP BY 1)")
def agg15(spark, sf):
    rows = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "click").cast("long")).alias("k"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return rows.select("arm", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@register("AGG09_grid_cells", f"""WITH rec AS (SELECT o_custkey % 4 AS hops, (o_orderkey % 3)::INT AS n_nodes, count(*)::BIGINT AS n, avg((o_orderstatus = 'F')::INT::DOUBLE) AS code_acc, max(o_orderkey)::BIGINT AS packed_len FROM orders GROUP BY 1, 2, o_orderpriority),
c AS (SELECT hops, n_nodes, sum(round(code_acc * n))::BIGINT AS hits, sum(n)::BIGINT AS total, max(packed_len)::BIGINT AS packed_len, count(*)::BIGINT AS seeds FROM rec GROUP BY 1, 2)
SELECT hops, n_nodes, hits, total, packed_len, seeds, round(p, 6) AS accuracy, {WILSON_SQL} FROM (SELECT *, total::DOUBLE AS n, hits / total::DOUBLE AS p FROM c)""")
def agg09(spark, sf):
    o = read_table(spark, sf, "orders")
    rec = o.groupBy((F.col("o_custkey") % 4).alias("hops"), (F.col("o_orderkey") % 3).cast("int").alias("n_nodes"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("code_acc"), F.max("o_orderkey").alias("packed_len"))
    out = M.grid_cells(rec.withColumns({"tokens_per_node": F.lit(1), "em": F.lit(0.0), "in_train": F.lit(True)}))
    return out.select("hops", "n_nodes", "hits", "total", "packed_len", "seeds", *(F.round(c, 6).alias(c) for c in ("accuracy", "lo", "hi")))


@register("AGG10_constant_columns", """SELECT 'lang' AS "column", count(*) > 1 AND count(lang) = count(*) AND count(DISTINCT lang) = 1 AS constant FROM documents UNION ALL SELECT 'one', count(*) > 1 FROM documents""")
def agg10(spark, sf):
    return M.constant_columns(read_table(spark, sf, "documents").select("lang", F.lit(1).alias("one")), ["lang", "one"])


@register("AGG18_permutation_p", RUNS_SQL + """, v AS (SELECT task, (arm % 2)::INT AS arm, seed // 5 AS blk, avg(metric) AS value FROM runs GROUP BY ALL), x AS (SELECT task, list(value ORDER BY arm DESC, blk) AS vs, sum(arm)::INT AS k, count(*)::INT AS n FROM v GROUP BY 1),
m AS (SELECT *, unnest(range(1 << n)) AS mask FROM x), s AS (SELECT task, k, mask, list_sum(list_transform(range(n), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN vs[i + 1] / k ELSE -vs[i + 1] / (n - k) END)) AS gap FROM m WHERE bit_count(mask) = k)
SELECT task, avg((gap >= (SELECT o.gap FROM s o WHERE o.task = s.task AND o.mask = (1 << o.k) - 1) - 1e-12)::INT)::DOUBLE AS p FROM s GROUP BY 1""")
def agg18(spark, sf):
    # all splits of single days are too many: the values are means of all runs in blocks of five days
    rows = runs(spark, sf).select(F.col("task"), (F.col("arm") % 2).alias("arm"), F.floor(F.col("seed") / 5).alias("seed"), "metric")
    return M.permutation_tests(rows.groupBy("task", "arm", "seed").agg(F.avg("metric").alias("value")).select("task", "arm", "value"), "task")


@register("AGG20_quantile_slices", """WITH e AS (SELECT list_distinct(quantile_cont(n_chars, [0.0, 0.25, 0.5, 0.75, 1.0])) AS edges FROM documents)
SELECT greatest(0, least(len(list_filter(edges, lambda e: e < n_chars)) - 1, len(edges) - 2))::BIGINT AS bucket, count(*)::BIGINT AS n, round(avg(doc_id), 4) AS mean FROM documents, e GROUP BY 1""")
def agg20(spark, sf):
    return M.quantile_slices(read_table(spark, sf, "documents").select("n_chars", "doc_id"), "n_chars", "doc_id", [0.0, 0.25, 0.5, 0.75, 1.0]).withColumn("mean", F.round("mean", 4))


@register("AGG21_size_bins", "SELECT source AS arm, CASE WHEN n_chars <= 512 THEN '<=512' WHEN n_chars <= 2048 THEN '513-2048' ELSE '>2048' END AS bin, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2")
def agg21(spark, sf):
    return read_table(spark, sf, "documents").groupBy(F.col("source").alias("arm"), Q.size_bin(F.col("n_chars"), [512, 2048]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("AGG24_label_balance", "SELECT coalesce(source, 'OVERALL') AS problem, sum(quality)::BIGINT AS yes, sum(1 - quality)::BIGINT AS no FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP(source)")
def agg24(spark, sf):
    rows = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id").withColumn("quality", F.col("quality").cast("long"))
    return rows.rollup("source").agg(F.sum("quality").alias("yes"), F.sum(1 - F.col("quality")).alias("no")).select(F.coalesce("source", F.lit("OVERALL")).alias("problem"), "yes", "no")


@register("AGG04_schema_profile", """SELECT 'o_totalprice' AS col, round(sum((o_totalprice IS NULL)::INT) / count(*), 4) AS null_frac, count(DISTINCT o_totalprice)::BIGINT AS n_unique, NULL::DOUBLE AS len_p50 FROM orders
UNION ALL SELECT 'o_orderpriority', round(sum((o_orderpriority IS NULL)::INT) / count(*), 4), count(DISTINCT o_orderpriority)::BIGINT, quantile_cont(length(o_orderpriority), 0.5) FROM orders""")
def agg04(spark, sf):
    from graphloom.operators.profile import schema_profile

    return schema_profile(read_table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority"]).select("col", "null_frac", "n_unique", "len_p50")


@register("AGG05_task_profile", "SELECT count(*)::BIGINT AS n_rows, min(epoch(o_orderdate))::BIGINT AS first, max(epoch(o_orderdate))::BIGINT AS last, count(DISTINCT o_orderdate)::BIGINT AS n_times, round(avg((o_orderstatus = 'F')::INT::DOUBLE), 6) AS positive_rate, quantile_cont(o_totalprice, 0.5) AS target_p50 FROM orders")
def agg05(spark, sf):
    t = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return read_table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n_rows"), F.min(t).alias("first"), F.max(t).alias("last"), F.countDistinct("o_orderdate").alias("n_times"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("positive_rate"), F.expr("percentile(o_totalprice, 0.5)").alias("target_p50"))


@register("FLT10_kept_columns", """SELECT col FROM (SELECT 'o_orderstatus' AS col, avg((o_orderstatus IS NULL OR o_orderstatus = 'P')::INT::DOUBLE) AS missing FROM orders UNION ALL SELECT 'o_totalprice', avg((o_totalprice IS NULL)::INT::DOUBLE) FROM orders UNION ALL SELECT 'o_orderpriority', avg((o_orderpriority IS NULL)::INT::DOUBLE) FROM orders) WHERE missing <= 0.3""")
def flt10(spark, sf):
    from graphloom.operators.profile import kept_columns

    return kept_columns(read_table(spark, sf, "orders"), drop=["o_orderkey", "o_custkey", "o_orderdate"], threshold=0.3, placeholders=["P"])


@register("FLT11_anonymizable", """SELECT 'customer' AS tbl, 'c_name' AS col FROM customer HAVING count(DISTINCT c_name) > 0.5 * count(*) UNION ALL SELECT 'customer', 'c_mktsegment' FROM customer HAVING count(DISTINCT c_mktsegment) > 0.5 * count(*) UNION ALL SELECT 'part', 'p_brand' FROM part HAVING count(DISTINCT p_brand) > 0.5 * count(*)""")
def flt11(spark, sf):
    from graphloom.operators.profile import anonymizable_columns

    tables = {n: read_table(spark, sf, n) for n in ("customer", "part")}
    return anonymizable_columns({"customer": tables["customer"].select("c_name", "c_mktsegment"), "part": tables["part"].select("p_brand")})
