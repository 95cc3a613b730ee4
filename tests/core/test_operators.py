"""Hand-computed results and invariants of the core operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import kg as K
from graphloom.operators import metrics as M
from graphloom.operators import relational as R
from graphloom.operators import structure as S
from graphloom.operators import sweep as W
from graphloom.operators import tokens as P
from graphloom.operators.textgraph import TextGraphs, row_order_problems
from graphloom.sources.sinks import markdown_table, text_table


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_inclusive_boundary_and_last_k(spark):
    facts = spark.createDataFrame([(i, 0, t) for i, t in enumerate([0, 10, 20, 30, 40, 50, 55, 60, 70, 80])], "fact_id long, entity_id long, t long").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    seeds = spark.createDataFrame([(0, 0, 55)], "seed_id long, entity long, seed_ts long")
    times = lambda k: [r.child_time for r in R.temporal_neighbours(seeds, facts, "entity_id", "fact_id", "ts", k).orderBy("rank").collect()]
    assert times(99) == [55, 50, 40, 30, 20, 10, 0] and times(3) == [55, 50, 40]


@pytest.mark.parametrize(("sizes", "budget"), [([5, 1, 9], 6), ([1, 1], 9), ([3, 3, 3], 2), ([10, 0, 2], 7), ([4, 4, 4], 11)])
def test_even_split(spark, sizes, budget):
    rows = [(1, f"t{t}", i, 1, 0, i + 1) for t, n in enumerate(sizes) for i in range(n)]
    got = R.even_split(spark.createDataFrame(rows, "seed_id long, tbl string, row long, hop long, ts long, order long"), budget).collect()
    # one row at a time to every table that has some left, tables in order, while the budget lasts
    taken, left = [0] * len(sizes), budget
    while left and any(t < s for t, s in zip(taken, sizes)):
        for i, size in enumerate(sizes):
            if left and taken[i] < size:
                taken[i], left = taken[i] + 1, left - 1
    assert {(r.tbl, r.row) for r in got} == {(f"t{t}", i) for t, n in enumerate(taken) for i in range(n)}


def test_link_rows_are_free_of_the_budget(spark):
    """A seed, five rows of a dimension, and between them ten link rows, half of them to rows beyond the budget."""
    cand = [(0, "study", 0, 0, 0)] + [(0, "bridge", i, 1, 100 - i) for i in range(10)] + [(0, "site", i, 2, 0) for i in range(10)]
    links = [(0, "bridge", i, t, k) for i in range(10) for t, k in (("study", 0), ("site", i))]
    out = R.allocate(spark.createDataFrame(cand, "seed_id long, tbl string, row long, hop long, ts long"), spark.createDataFrame(links, "seed_id long, tbl string, row long, other_tbl string, other long"), ["bridge"], 6).collect()
    rows = {t: sorted(r.row for r in out if r.tbl == t) for t in ("study", "bridge", "site")}
    assert rows == {"study": [0], "bridge": [0, 1, 2, 3, 4], "site": [0, 1, 2, 3, 4]}


def test_components_of_any_width(spark):
    from graphloom.operators.generators import closure

    nodes = spark.createDataFrame([(0, i) for i in range(45)], "graph_id long, pos long")
    edges = spark.createDataFrame([(0, i, i + 1) for i in [*range(39), *range(41, 44)]], "graph_id long, src long, dst long")
    assert sorted(r.new_pos for r in R.drop_orphans(nodes, edges).collect()) == list(range(40))
    assert closure(edges).where("src = 0").count() == 39


def test_unknown_parent_is_an_error(spark):
    catalog = R.Catalog({"p": spark.createDataFrame([(1,)], "id long"), "c": spark.createDataFrame([(1, 1), (2, 9)], "id long, pid long")}, {"p": R.TableSpec("id"), "c": R.TableSpec("id", None, {"pid": "p"})})
    with pytest.raises(Exception, match="has no p row"):
        R.fkey_edges(catalog).collect()


def test_contraction(spark):
    nodes = spark.createDataFrame([(0, 0, 0, False), (0, 1, 2, False), (0, 2, 2, False), (0, 9, 1, True)], "graph_id long, pos long, hop int, is_link boolean")
    edges = spark.createDataFrame([(0, 9, 0), (0, 9, 1), (0, 9, 2)], "graph_id long, src long, dst long")
    assert {(r.src, r.dst) for r in R.contract_links(nodes, edges).collect()} == {(1, 0), (2, 0), (1, 2)}


def test_answer_scores(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    get = lambda p, g: [one(spark, c) for c in T.answer_scores(p, g).values()]
    assert get(a("Xyz", "Wrong"), a("Xyz")) == [0.5, 1.0, pytest.approx(2 / 3), 1, 1]
    assert get(a(), a("Xyz")) == [0.0, 0.0, 0.0, 0, 0]
    assert get(a("Xyz", "Qrs"), a("Qrs"))[3:] == [0, 1]
    assert get(a("New York City"), a("New York", "York City"))[0] == 2.0  # matched golds over predictions


def test_text(spark):
    assert one(spark, T.decode_escapes(F.lit("Justin$002BBieber $20AC"))) == "Justin+Bieber €"
    assert one(spark, T.parse_answers(F.lit(" Jamaican English, Jamaican Creole ,"), ",")) == ["Jamaican English", "Jamaican Creole"]
    assert one(spark, T.stable_seed(F.lit("a"), F.lit("b"))) == 1736680222
    assert [one(spark, T.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    assert [one(spark, T.bucket_pow2(F.lit(n), 128)) for n in (1, 128, 129, 257, 385, 513)] == [128, 128, 256, 384, 512, 768]


def test_auroc_and_ties(spark):
    rows = lambda ms, ys: spark.createDataFrame(list(zip(ms, ys)), "score double, y long")
    assert M.auroc(rows([3.0, 2.0, -2.0, -3.0], [1, 1, 0, 0])).first()["auroc"] == 1.0
    assert M.auroc(rows([-3.0, -2.0, 2.0, 3.0], [1, 1, 0, 0])).first()["auroc"] == 0.0
    assert M.auroc(rows([1.0, 1.0], [1, 0])).first()["auroc"] == 0.5
    assert math.isnan(M.auroc(rows([1.0], [1])).first()["auroc"])
    assert M.tied_pair_fraction(rows([1.0, 1.0, 2.0], [1, 0, 0])).first()["tied_fraction"] == 0.5
    assert M.permutation_p([3.0, 4.0], [1.0, 2.0]) == pytest.approx(1 / 6)


def test_walk_rows_sum_to_one_and_paths(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(4)], "graph_id long, node long")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 1), (0, 2, 3)], "graph_id long, src long, dst long")
    sums = S.random_walk(nodes, edges, 4).groupBy("t", "i").agg(F.sum("p").alias("p")).collect()
    assert len(sums) == 16 and all(abs(r.p - 1) < 1e-12 for r in sums)
    flat = S.flat_distances(nodes, S.shortest_paths(nodes, edges, 5)).first()
    assert flat.n == 4 and list(flat.spd) == [0, 1, 2, 3, 32767, 0, 1, 2, 32767, 1, 0, 1, 32767, 32767, 32767, 0]


def test_prompt_does_not_bridge(spark):
    nodes = spark.createDataFrame([(0, 0, False), (0, 1, True), (0, 2, False)], "graph_id long, node long, is_prompt boolean")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "graph_id long, src long, dst long")
    got = {(r.i, r.j) for r in S.prompt_mask(nodes, edges, 2).collect()}
    assert (0, 2) not in got and {(0, 1), (1, 0), (1, 2), (2, 1), (0, 0), (1, 1), (2, 2)} <= got


def test_spectra():
    a = np.zeros((4, 4))
    for i, j in ((0, 1), (1, 2), (2, 1), (2, 3), (3, 0)):
        a[i, j] = 1
    values, vectors = S.magnetic_spectrum(a, 0.25, 4)
    assert (np.diff(values) >= -1e-12).all() and values.sum() == pytest.approx(4) and np.allclose(np.linalg.norm(vectors, axis=0), 1)
    perm = np.array([2, 0, 3, 1])
    assert np.allclose(S.magnetic_spectrum(a[np.ix_(perm, perm)], 0.25, 4)[0], values)
    assert not S.laplacian_coordinates(a, 3).any()  # asymmetric
    sym = np.maximum(a, a.T)
    assert np.allclose(S.laplacian_coordinates(sym, 2).sum(0), 0, atol=1e-9)


def test_budget_skips_and_goes_on(spark):
    rows = [(1, 0, "a", "b"), (1, 1, "c", "d"), (1, 2, "a", "b2"), (1, 3, "b", "a")]
    got = K.budgeted_triples(spark.createDataFrame(rows, "qid long, rank long, h string, t string"), 5)
    assert sorted(r["rank"] for r in got.collect()) == [0, 3]


def test_labels(spark):
    ids, prefix = F.array(*map(F.lit, (7, 8, 1, 7, 8, 2))), F.array(F.lit(7), F.lit(8))
    assert one(spark, P.answer_labels(ids, prefix, "first")) == [-100, -100, 1, 7, 8, 2]
    assert one(spark, P.answer_labels(ids, prefix, "last")) == [-100] * 5 + [2]
    with pytest.raises(Exception, match="unique"):
        one(spark, P.answer_labels(ids, prefix, "unique"))


def test_text_graphs(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x")], "graph_id long, node string")
    edges = spark.createDataFrame([(1, "b", "a")], "graph_id long, src string, dst string")
    tg = TextGraphs(nodes.select("graph_id").distinct(), nodes, edges).relabel()
    assert [(r.src, r.dst) for r in tg.edges.collect()] == [(1, 0)]
    tg.assign_label("t").save(str(tmp_path))
    assert TextGraphs.load(spark, str(tmp_path)).nodes.count() == 3
    with pytest.raises(ValueError, match="columns differ"):
        tg.union(tg.assign_label("x"))
    assert tg.union(tg).nodes.count() == 6


@pytest.mark.parametrize(("ids", "contiguous", "problem"), [([0, 1, 2], True, None), ([0, None, 2], False, "missing"), ([0, 2, 1, 3], False, "not monotonic"), ([0, 5, 10], False, None), ([1, 2, 3], True, "not contiguous")])
def test_row_order(spark, ids, contiguous, problem):
    rows = spark.createDataFrame(list(enumerate(ids)), "pos int, row_id long")
    assert problem in [*(r.problem for r in row_order_problems(rows, "pos", "row_id", contiguous).collect()), None]
    assert (problem is None) == (row_order_problems(rows, "pos", "row_id", contiguous).count() == 0)


def test_sweeps():
    assert W.parse_config('{"a": "x // y /* z */, ]", /* c */ "b": [1, 2, // t\n ],}') == {"a": "x // y /* z */, ]", "b": [1, 2]}
    assert len(W.expand({"seeds": [0, 1], "k": [0, 1], "lr": 1e-3, "name": "n"})) == 4
    assert W.expand({"lens": [[640, 768], [512]]}) == [{"lens": [640, 768]}, {"lens": [512]}]
    assert W.expand({"x": [{"a": 1, "b": 2}, {"a": 3}], "c": 0}) == [{"c": 0, "a": 1, "b": 2}, {"c": 0, "a": 3}]
    assert W.expand({}) == [{}]
    for bad in ({"a": 1, "x": [{"a": 2}]}, {"x": [{"a": 1}, 2]}):
        with pytest.raises(W.SweepError):
            W.expand(bad)
    with pytest.raises(W.SweepError):
        W.parse_config("[1]")
    assert W.identity({"a": 1, "b": 2}) == W.identity({"b": 2, "a": 1})
    assert W.flags({"a_b": True, "b": False, "c": [1, 2], "d": "x", "e": None, "f": {"k": 1, "l": 2}}) == ["--a-b", "--no-b", "--c", "1,2", "--d", "x", "--f", "k=1,l=2"]


def test_reports(tmp_path):
    assert markdown_table([]) == text_table([]) == "(no runs)"
    runs = [{"sweep_run": "0001_b", "model": "m", "f1": 0.5, "note": "a|b", "timestamp": 3}, {"sweep_run": "0000_a", "model": "m", "f1": 0.25, "ok": True, "dims": [1, 2]}]
    text = W.report(runs, "s")
    assert text.startswith("# Sweep report: s\n\n2 run(s) recorded.\n\nShared across all runs:\n\n- `model` = m\n\n| sweep_run | f1 |")
    assert r"a\|b" in text and text.index("0.2500") < text.index("0.5000") and "[1,2]" in text and "timestamp" not in text
    assert "| --- | ---: | --- | --- | --- |" in text  # booleans and lists are no numbers
    assert "Shared" not in W.report(runs[:1])
    assert text_table([{"a": 1, "bb": "x"}]) == "a  bb\n-  --\n1  x "
    assert W.write_report(str(tmp_path)).endswith("(no runs)\n")
    (tmp_path / "runs.jsonl").write_text('{"sweep_run": "0", "lr": 3e-05}\n\n')
    assert "3e-05" in W.write_report(str(tmp_path)) == (tmp_path / "report.md").read_text()
