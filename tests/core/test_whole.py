"""Queries over whole tables: cases by brute force beside the comparison with SQL."""

import pytest

from graphloom.plans import registry


def test_transition_graphs_by_brute_force(spark, tmp_path):
    from graphloom.plans.structure import TYPES, graphs

    rows = [(i, (i * 5) % 3, TYPES[(i * i + i // 4) % 5]) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    nodes, edges = graphs(spark, str(tmp_path))
    seen, last, want = set(), {}, set()
    for _, user, kind in rows:
        node = TYPES.index(kind)
        seen.add((user, node))
        if last.get(user, node) != node:
            want.add((user, last[user], node))
        last[user] = node
    assert {tuple(r) for r in nodes.collect()} == seen and {tuple(r) for r in edges.collect()} == want


@pytest.mark.parametrize("n", [7, 16000])
def test_off_diagonal_pairs_of_any_size(spark, tmp_path, n):
    import hashlib

    spark.range(n).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in registry.queries()["FLT19_off_diagonal_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(k, (k + 1 + int(hashlib.sha256(f"p:{k}".encode()).hexdigest()[:8], 16) % (n - 1)) % n) for k in range(n)}
    assert all(r != c and 0 <= c < n for r, c in got)


def test_closure_of_long_chains(spark, tmp_path):
    keys = [1]
    while keys[-1] < 7**8:
        keys.append(keys[-1] * 7 + 3)
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.src, r.dst, r.depth) for r in registry.queries()["JOIN17_closure"](spark, str(tmp_path)).collect()}
    assert got == {(up // 7, k, j - i + 1) for i, up in enumerate(keys) for j, k in enumerate(keys) if i <= j}


def test_runs_of_any_users(spark, tmp_path):
    from datetime import datetime, timedelta

    start, metric = datetime(2024, 1, 1), {4: 1.0, 7: 4.0, 8: 5.5, 40: 2.0, 90: 87.0}
    days = {4: (0, 1, 2), 7: (0, 2), 8: (2, 3), 40: (1, 2), 90: (2,)}
    rows = [(u, "view", start + timedelta(days=d), metric[u]) for u in metric for d in days[u]]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    common = [(r.task, r.seed, r.arms) for r in registry.queries()["JOIN23_common_seeds"](spark, str(tmp_path)).collect()]
    assert common == [("view", (start - datetime(1970, 1, 1)).days + 2, 5)]
    cost = {r.arm: (r.predicted, r.error_percent) for r in registry.queries()["AGG47_cost_model"](spark, str(tmp_path)).collect()}
    assert cost == {8: (5.0, pytest.approx(-100 / 11, abs=1e-6)), 40: (37.0, 1750.0), 90: (87.0, 0.0)}


def test_permutation_p_of_all_days(spark, tmp_path):
    from datetime import datetime, timedelta

    from graphloom.operators.metrics import permutation_p

    start = datetime(1970, 1, 1) + timedelta(days=19725)  # a multiple of 5, from which on no event falls on another
    value = {(u, d): float((u * 37 + d * d * 11) % 23 + (u % 2) * 6) for u in (1, 2, 5, 6) for d in range(20) if d % 5}
    rows = [(u, "view", start + timedelta(days=d), v) for (u, d), v in value.items()]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    mean = lambda odd, block: sum(x := [v for (u, d), v in value.items() if u % 2 == odd and d // 5 == block]) / len(x)
    want = permutation_p([mean(1, b) for b in range(4)], [mean(0, b) for b in range(4)])
    got = registry.queries()["AGG18_permutation_p"](spark, str(tmp_path)).collect()
    assert [(r.task, r.p) for r in got] == [("view", pytest.approx(want))] and 0 < want < 1
