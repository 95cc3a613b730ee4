"""The registered queries against DuckDB, and the pipeline against brute force."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import queries
from graphloom.storage import materialize

from .fixtures import corpus, frame
from .test_joins import cut, jaccard_classes
from .test_rules_and_shards import measures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_covers_its_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert queries.QUERIES[name](spark, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_stages(spark, tmp_path):
    rows = [r for r in corpus(n=120) if r[0] < 120]
    docs = materialize(frame(spark, rows), "pipeline-test")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language_id"](spark, docs, "")
    assert kept.columns == docs.columns
    kept = {r.doc_id: r for r in materialize(kept, "t1").collect()}
    ruled = materialize(stage["quality_rules"](spark, docs, ""), "t2")
    assert ruled.columns == docs.columns
    good = {r[0] for r in rows if not (measures(r[1])[0] < 50 or 2 * measures(r[1])[4] > measures(r[1])[0])}
    texts = {r.doc_id: r.text for r in ruled.collect()}
    assert set(texts) == good  # no line of this corpus is frequent enough to go
    single = materialize(stage["near_duplicates"](spark, ruled, ""), "t3")
    classes = jaccard_classes(list(texts.items()), 5, 80, 100)
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in classes.items() if c == d}
    left = {r.doc_id: r.text for r in single.collect()}
    slim = materialize(stage["substring_dedup"](spark, single, ""), "t4")
    assert slim.columns == docs.columns
    want = cut(list(left.items()), 50)
    for r in slim.collect():
        words, gone, text = want[r.doc_id][0]
        assert r.text == (text if gone else left[r.doc_id]) and r.n_chars == len(r.text)
    packed = stage["best_fit_packing"](spark, slim, "").toPandas()
    assert set(packed["doc_id"]) == set(left) and packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_pipeline_rows_with_null_and_repeated_ids(spark):
    stage = dict(corpus_pipeline.STAGES)
    alone, passage = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(8)], " ".join(f"p{i}" for i in range(60))
    # a passage in two rows of one id and in null ids; one of two texts of an id has nothing to lose; copies, without an id and under one id
    rows = [(1, f"{alone[0]} {passage}"), (2, f"{alone[1]} {passage}"), (2, alone[2]), (None, f"{alone[3]} {passage}"), (None, alone[4]), (None, alone[5]), (None, alone[5]), (7, alone[6]), (7, alone[6]), (8, alone[7]), (None, alone[7])]
    docs = materialize(frame(spark, [(d, t, "en", "s", len(t)) for d, t in rows]), "pipeline-ids")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    classes = jaccard_classes([(i, t) for i, (_, t) in enumerate(order)], 5, 80, 100)
    left = [order[i] for i, (_, c) in sorted(classes.items()) if c == i]
    single = materialize(stage["near_duplicates"](spark, docs, ""), "pipeline-ids-single")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert single.columns == docs.columns and sorted(((r.doc_id, r.text) for r in single.collect()), key=key) == left and len(left) == 8
    slim = stage["substring_dedup"](spark, single, "")
    want = cut(list(enumerate(t for _, t in left)), 50)
    want = sorted(((d, want[i][0][2] if want[i][0][1] else t) for i, (d, t) in enumerate(left)), key=key)
    assert slim.columns == docs.columns and sorted(((r.doc_id, r.text) for r in slim.collect()), key=key) == want
    assert sum(passage in t for _, t in want) == 1


CLASHES = ("row_id", "kept_id", "kept_text", "kept_row", "cut_id", "key_id", "key_marks", "removed_marks", "host", "content", "bucket", "component_id", "is_representative")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_pipeline_stages_keep_extra_columns(spark, name):
    rows = corpus(n=40)
    docs = frame(spark, rows).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASHES)
    plain = dict(corpus_pipeline.STAGES)[name](spark, docs.drop(*CLASHES), "")
    same = lambda got: sorted((r.doc_id, r.text or "", r.n_chars or 0) for r in got)
    assert same(found) == same(plain.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_of_an_empty_table(spark, name):
    docs = frame(spark).where("false")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.collect() == [] and (name == "best_fit_packing" or out.columns == docs.columns)


def test_pipeline_stages_of_null_and_empty_texts(spark):
    docs = frame(spark, [r for r in corpus(n=0)])  # null, empty, blank, and two short texts
    stage = dict(corpus_pipeline.STAGES)
    assert stage["language_id"](spark, docs, "").where("doc_id < 3").collect() == []
    assert stage["quality_rules"](spark, docs, "").collect() == []
    assert {r.doc_id for r in stage["near_duplicates"](spark, docs, "").collect()} == {0, 1, 2, 3}
    slim = stage["substring_dedup"](spark, docs, "").collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in slim} == {(r[0], r[1], r[4]) for r in corpus(n=0)}
    assert stage["best_fit_packing"](spark, docs, "").count() == 5


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "substring_dedup", "best_fit_packing"]


def test_held_out_column(spark):
    import zlib

    for r in queries.op7_compression_language(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and re.fullmatch("en|de|fr|es|und", r.lang_pred)
