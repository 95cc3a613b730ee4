"""Collections on storage, reports, hooks, needle texts, probes and the runner: cases by hand and errors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import bias as B
from graphloom.operators import datasets as D
from graphloom.operators import fitting as T
from graphloom.operators import hooks as H
from graphloom.operators import kg as K
from graphloom.operators import probes as P
from graphloom.operators import prose, runner
from graphloom.operators.positions import global_index, running_sum
from graphloom.operators.textgraph import TextGraphs
from graphloom.sources import reports, sinks
from graphloom.storage import replace_table, with_row_id


def test_places_and_sums(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k long, v long").repartition(5)
    assert {(r.k, r["index"]) for r in global_index(rows, ["k"]).collect()} == {(k, k) for k in range(101)}
    sums = {r.k: r.s for r in running_sum(rows, [F.desc("k")], F.col("k"), "s").collect()}
    assert sums == {k: sum(range(k, 101)) for k in range(101)}
    assert global_index(rows.where("false"), ["k"]).collect() == []


def test_row_ids(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n) for r in with_row_id(frame([(5, "a"), (3, None)]), "n").collect()} == {(5, 5), (3, 3)}
    got = sorted(with_row_id(frame([(None, "z"), (2, "b"), (2, "a"), (None, None), (1, "q"), (2, "a")]), "n").collect(), key=lambda r: r.n)
    assert [(r.doc_id, r.text) for r in got] == [(1, "q"), (2, "a"), (2, "a"), (2, "b"), (None, None), (None, "z")] and len({r.n for r in got}) == 6
    assert with_row_id(frame([]), "n").collect() == []


STORY = "In an undirected graph G, the nodes are numbered 0, 1, 2. The edges in G are: (0, 1) (1,2). Node 2 likes tea."


def example(spark, **change):
    row = {"graph_id": 1, "problem_type": "node_classification", "question": STORY, "task_description": "Q: Does node 2 like tea?\nA: ", "answer": "Yes", "nnodes": "3", "nedges": "2"} | change
    return spark.createDataFrame([row], "graph_id long, problem_type string, question string, task_description string, answer string, nnodes string, nedges string")


def test_prose_graph(spark):
    nodes, edges = prose.prose_graphs(example(spark))
    assert {(r.node, r.text, r.is_prompt) for r in nodes.collect()} == {("0", "0", False), ("1", "1", False), ("2", "2 likes tea", False), ("3", "Q: Does node 2 like tea?\nA: Yes", True)}
    assert {(r.src, r.dst) for r in edges.collect()} == {("0", "1"), ("1", "0"), ("1", "2"), ("2", "1"), ("3", "2")}
    nodes, edges = prose.prose_graphs(example(spark, problem_type="triangle_counting"), incidence=True, question_node=True)
    assert {r.node: r.text for r in nodes.collect()} == {"0": "0", "1": "1", "2": "2", "0,1": "0,1", "1,2": "1,2", "3": "Q: Does node 2 like tea?\n", "4": "A: Yes"}
    assert {r.dst for r in edges.collect() if r.src == "4"} == {"0", "1", "2", "0,1", "1,2"} and not [r for r in edges.collect() if "3" in (r.src, r.dst)]


@pytest.mark.parametrize(("change", "fault"), [({"nnodes": "4"}, "number of nodes"), ({"nedges": "1"}, "number of edges"), ({"problem_type": "maximum_flow"}, "have no graph"), ({"problem_type": "reachability"}, "no prompt node"), ({"problem_type": None}, "have no graph")])
def test_prose_faults(spark, change, fault):
    with pytest.raises(Exception, match=fault):
        [x.collect() for x in prose.prose_graphs(example(spark, **change))]


def collection(spark, ids, **columns):
    graphs = spark.createDataFrame([(i,) for i in ids], "graph_id long").withColumns({k: F.lit(v) for k, v in columns.items()})
    return TextGraphs(graphs, graphs.select("graph_id", F.lit(0).alias("node")), graphs.select("graph_id", F.lit(0).alias("src"), F.lit(0).alias("dst")))


def test_parts_on_storage(spark, tmp_path):
    root = str(tmp_path)
    for name in ("10-20.x", "0-10.x", "100-110.x", "notes"):
        collection(spark, [1]).save(f"{root}/c/{name}")
    assert [p.rsplit("/", 1)[1] for p in D.chunk_paths(spark, f"{root}/c")] == ["0-10.x", "10-20.x", "100-110.x"]
    for name in ("train_5-10.x", "train_0-5.x", "trainer_0-5.x", "dev"):
        collection(spark, [1]).save(f"{root}/s/{name}")
    assert [p.rsplit("/", 1)[1] for p in D.shard_paths(spark, f"{root}/s", "train")] == ["train_0-5.x", "train_5-10.x"]
    assert len(D.shard_paths(spark, f"{root}/s", "dev")) == 1
    for missing in (lambda: D.shard_paths(spark, f"{root}/s", "test"), lambda: TextGraphs.load(spark, f"{root}/none"), lambda: D.load_parts(spark, D.chunk_paths(spark, f"{root}/none"))):
        with pytest.raises(FileNotFoundError):
            missing()
    with pytest.raises(ValueError, match="no training set"):
        D.load_many(spark, root, [], [])
    tg = collection(spark, [1, 2], ds_label="mine")
    tg.save(f"{root}/kept")
    back = TextGraphs.load(spark, f"{root}/kept")
    assert back.versions == 1 and {r.ds_label for r in back.graphs.collect()} == {"mine"}


def test_coded_records(spark):
    schema = "id long, entities array<string>, entities_cid array<string>, tuples array<struct<h:string,r:string,t:string>>, paths array<struct<root:string,relations:array<string>>>"
    rows = [(1, ["E1", "E2", "E3"], ["7", "-1"], [("7", "r", "9"), ("x y", "r", "7")], [("7", ["a", "b"])]), (2, [], None, [], [])]
    names = spark.createDataFrame([(7, "m.7"), (8, "m.8")], "id long, name string")
    got = {r.id: r for r in D.normalise_records(spark.createDataFrame(rows, schema), "coded", names).collect()}
    assert got[1].entities == ["m.7", "E2", "E3"] and [tuple(t) for t in got[1].tuples] == [("m.7", "r", "UNLINKED_ENTITY"), ("x y", "r", "m.7")]
    assert got[1].paths[0].root == "m.7" and got[2].entities == [] and got[2].tuples == []
    with pytest.raises(ValueError, match="named"):
        D.normalise_records(spark.createDataFrame(rows, schema), "other")


def test_unknown_ends(spark):
    nodes, edges = spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(1, 2)], "src long, dst long")
    with pytest.raises(Exception, match="dst is no node: 2"):
        D.checked_edges(nodes, edges).collect()


def test_builds_scripts_and_configurations():
    built = {"a": {"x"}, "b": {"x", "y", "z"}, "c": {"x", "y"}}
    assert D.superset_build(built, {"x", "y"}) == "c" and D.superset_build(built, {"x"}, "b") == "b"
    with pytest.raises(FileNotFoundError):
        D.superset_build(built, {"q"})
    assert D.parse_job_script("x\npython -m a.b --n 'two words' \\\n --k 1\n") == ("a.b", ["--n", "two words", "--k", "1"])
    for bad in ("echo", "python -m other"):
        with pytest.raises(ValueError):
            D.parse_job_script(bad, {"a.b"})
    assert D.arm_label({"a": 1, "b": 1}, ["a", "b"]) == "base" and D.arm_label({}, ["a", "b"]) == "no-a+b"
    assert D.role_splits("d", ["d"], ["d"]) == ["train", "dev", "test"] and D.role_splits("d", [], []) == []
    good = {"mode": "train", "node_counts": [8], "token_counts": [64], "hops": 2, "needle_tokens": 20, "slack": 8}
    assert D.validate(good) == good
    for change in ({"hops": 6}, {"hop_counts": [1]}, {"fan_out": 6}, {"token_counts": [28]}, {"mode": "grid"}, {"magnetic": 1, "magnetic_linear": 1}, {"magnetic_m_collate": 4}, {"node_counts": []}, {"k_hop": -1}):
        with pytest.raises(ValueError, match="needs"):
            D.validate(good | change)


def test_replacement_and_single_builds(spark, tmp_path):
    path, n = f"{tmp_path}/t", spark.range(3)
    replace_table(n, path, "parquet")
    replace_table(spark.read.parquet(path).where("id > 0"), path, "parquet")
    assert {r.id for r in spark.read.parquet(path).collect()} == {1, 2} and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(RuntimeError):
        sinks.build_once(spark, f"{tmp_path}/o", lambda: (_ for _ in ()).throw(RuntimeError("no")))
    assert sinks.build_once(spark, f"{tmp_path}/o", lambda: n).count() == 3 and not (tmp_path / "o.lock").exists()
    (tmp_path / "p.lock").write_text("")
    with pytest.raises(TimeoutError):
        sinks.build_once(spark, f"{tmp_path}/p", lambda: n, wait=0.1)
    for bad in ([(1, 0.5, 1.0), (1, 0.5, 1.0)], [(None, 0.5, 1.0)]):
        with pytest.raises(ValueError, match="row ids"):
            reports.write_predictions(spark.createDataFrame(bad, "row_id long, margin double, y_true double"), f"{tmp_path}/x")


def test_report_texts(spark):
    assert reports.ascii_tree([(1, 2), (1, 3), (2, 4), (3, 2)], 1).split("\n") == ["1", "|-- 2", "|   `-- 4", "`-- 3", "    `-- 2 ..."]
    table = reports.latex_table([{"m": "a_b", "x": 1.04, "y": None}, {"m": "c", "x": 1.0, "y": 2.0}, {"m": "d", "x": 0.5, "y": 1.0}], "m", ["x", "y"], caption="50 %")
    assert r"a\_b & \textbf{1.0} & -- \\" in table and r"c & \textbf{1.0} & \textbf{2.0} \\" in table and r"d & \underline{0.5} & \underline{1.0} \\" in table and r"\caption{50 \%}" in table
    cells = spark.createDataFrame([(0, 8, 32, 0.5, 10), (0, 8, 32, 1.0, 30), (0, 16, 32, 0.25, 40), (0, 16, 64, 1.0, 4)], "k int, nodes int, tokens int, em double, n long")
    assert reports.grid_markdown(cells) == "k = 0\n\n| N \\ T | 32 | 64 |\n| ---: | ---: | ---: |\n| 8 | 0.875 |  |\n| 16 | 0.250 | 1.000 (n=4) |"
    assert reports.grid_markdown(cells.where("false")) == ""
    assert reports.pivot_markdown(cells, "nodes", "tokens", "em", 2) == "| nodes \\ tokens | 32 | 64 |\n| --- | --- | --- |\n| 8 | 0.75 | - |\n| 16 | 0.25 | 1.00 |"


def test_gold_and_question_graphs(spark):
    schema = "answers array<struct<text:string,kb_id:string>>"
    rows = [([("A", "m.1"), ("", "1945$002D09"), (None, "m.2"), ("A", "m.3"), ("", "")],), ([],)]
    assert [r.x for r in spark.createDataFrame(rows, schema).select(K.gold_texts(F.col("answers")).alias("x")).collect()] == [["A", "1945-09", "m.2"], []]
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "qid long, text string").select("qid", F.col("text").alias("node"), F.lit(False).alias("is_rel"), "text")
    edges = spark.createDataFrame([(1, "a", "b")], "qid long, src string, dst string")
    gold = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (1, "x", "X"), (2, "y", "Y")], "qid long, node string, text string")
    prompts = spark.createDataFrame([(1, "q1 "), (2, "q2 ")], "qid long, text string")
    args = (nodes, edges, gold.select("qid", "node"), prompts, gold)
    n, e = K.question_graphs(*args, versions=3, most=9, sep="+", seed="s")
    texts = [r.text for r in n.where("node = 'PROMPT'").collect()]
    assert len(texts) == 3 and set(texts) <= {"q1 A+B", "q1 B+A"} and e.where("src = 'PROMPT'").count() == 6 and e.count() == 9
    n, _ = K.question_graphs(*args, versions=2, most=1, sep="+", seed="s", keep_unanswerable=True)
    assert sorted((r.qid, r.version, len(r.text)) for r in n.where("node = 'PROMPT'").collect()) == [(1, 0, 4), (1, 1, 4), (2, 0, 3)]


def test_exact_texts():
    encode, decode = (lambda t: t.split()), " ".join
    filler = [f"w{i}" for i in range(50)]
    for size in (5, 9, 30, 70):
        text = T.fit_text(encode, decode, filler, "the code is X", 3, size)
        assert len(text.split()) == size and "the code is X" in text
    assert T.fit_text(encode, decode, filler, "n", 2, 4) == "w0 w1 n w2"
    with pytest.raises(T.FitError):
        T.fit_text(encode, decode, filler, "a b c", 0, 2)
    # a coder that needs two tokens where pieces join: filler goes, pads close the gap
    joined = lambda t: [x for w in t.split() for x in ([w, "+"] if w.startswith("w") else [w])]
    assert len(joined(T.fit_text(joined, decode, filler, "n", 4, 11))) == 11


def test_registries_and_hooks(spark):
    made = H.Registry("thing")
    made.add("a")(len)
    with pytest.raises(ValueError):
        made.add("a")(len)
    with pytest.raises(KeyError, match="no thing 'b'"):
        made.get("b")
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert {r.id: r.labels for r in H.compute_labels(rows, lambda r: [len(r["text"] or "")] * r["id"]).collect()} == {1: [2], 2: [0, 0]}
    sizes = H.map_batches(spark.range(10).repartition(3), lambda rows, index: [{"first": index[0], "ids": [r["id"] for r in rows]}], "first long, ids array<bigint>", "id", 4)
    assert {r.first: r.ids for r in sizes.collect()} == {0: [0, 1, 2, 3], 4: [4, 5, 6, 7], 8: [8, 9]}


def test_probe_parts():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(2, 20)
        edges = P.skeleton(rng, n, 4, 3)
        assert len(P.reach(n, [(u, v) for a, b in edges for u, v in ((a, b), (b, a))], 0)) == n
        assert max(sum(v in e for e in edges) for v in range(n)) <= 4
    assert P.reach(4, [(0, 1), (1, 2), (2, 3)], 0, 2) == {0: 0, 1: 1, 2: 2}
    assert [P.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    with pytest.raises(ValueError):
        P.unique_people(rng, 10_000)
    labels = [P.direction(random.Random(i), 6, 12)["label"] for i in range(200)]
    assert 60 < sum(labels) < 140


def test_balanced_sides(spark):
    rows = spark.createDataFrame([("a", i, i % 4 == 0) for i in range(40)] + [("b", 1, True)], "task string, i long, yes boolean")
    got = P.balanced(rows, "yes", F.col("i"), "task").collect()
    assert sum(r.yes for r in got) == 10 and len(got) == 20 and {r.task for r in got} == {"a"}


def test_spectral_parts():
    assert B.energy_rank(np.diag([3.0, 1.0, 1.0]), 0.8) == 1 and B.energy_rank(np.diag([3.0, 1.0, 1.0]), 0.99) == 3 and B.energy_rank(np.zeros((2, 2)), 0.9) == 0
    a = np.zeros((5, 5))
    for i, j in ((0, 1), (1, 2), (2, 0), (3, 4)):
        a[i, j] = 1
    real = B.spectral_kernel(a, 0.25, 5, lambda v: v)
    assert np.allclose(np.diag(real), 1) and np.allclose(real, real.T)
    assert not np.diag(B.spectral_kernel(a, 0.25, 5, lambda v: v, self_energy=False)).any()
    for head in B.HEADS:
        assert np.isfinite(B.spectral_kernel(a, 0.1, 3, np.exp, head)).all()


def test_runs_and_checks(spark, tmp_path):
    runs = [{"lr": 0.1, "m": "a/b c"}, {"lr": 0.2, "m": "a/b c"}]
    assert runner.run_names(runs) == ["0000_lr0.1", "0001_lr0.2"] and runner.run_names([]) == [] and runner.short([1, 2]) == "1-2"
    assert runner.module_name(" a/b/c.py ") == "a.b.c"
    assert runner.command("a/b", {"n": "x y", "ok": False}, "r", "f") == "python -m a.b --n 'x y' --no-ok --runs-jsonl f --run-name r"

    def task(spark, run):
        if run["k"] == 1 and not (tmp_path / "mended").exists():
            raise ValueError("broken")
        return {"n": spark.range(run["k"]).count()}

    records = runner.run_sweep(spark, {"k": [0, 1, 2]}, task, str(tmp_path))
    assert [r.get("n") for r in records] == [0, None, 2] and records[1]["error"] == "ValueError: broken"
    (tmp_path / "mended").write_text("")
    assert [r.get("n") for r in runner.run_sweep(spark, {"k": [0, 1, 2]}, task, str(tmp_path))] == [0, None, 2, 1]
    assert (tmp_path / "report.md").read_text().count("\n| 000") == 4
    found = runner.preflight({"x": [{"a": 1}, {"a": 1}]}, {"a"})
    assert found == {"runs": 2, "unknown": [], "wrong": [], "duplicates": ["0001"], "builds": 1}
    with pytest.raises(ValueError, match="mode is one of"):
        runner.Modes().run(spark, {"mode": "x"})


def test_public_names_load():
    import graphloom

    assert all(getattr(graphloom, name) is not None for name in graphloom.__all__) and set(graphloom.__all__) <= set(dir(graphloom))
    with pytest.raises(AttributeError):
        graphloom.nothing


def test_staged_tables_are_cleared(spark):
    from graphloom import storage

    kept, storage._staged[:] = list(storage._staged), []
    try:
        path = storage.fresh_path(spark, "cleared")
        spark.range(3).write.parquet(path)
        assert storage.clear_stages(spark) == 1 and storage.clear_stages(spark) == 0
        fs, target = storage.file_system(spark, path)
        assert not fs.exists(target)
    finally:
        storage._staged[:] = kept
