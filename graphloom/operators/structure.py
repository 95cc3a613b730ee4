"""Structural features of many small graphs in long form: (graph_id, i, j, value).

Nodes (graph_id, node) and edges (graph_id, src, dst) are DataFrames; nodes are numbered 0..N-1 in each graph. Step-wise
features are loops of joins whose steps are written to the shared folder; spectral ones decompose one graph at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import materialize

#: Stored distance of unreachable pairs.
UNREACHABLE = 32767


def shortest_paths(nodes: DataFrame, edges: DataFrame, cutoff: int) -> DataFrame:
    """(graph_id, i, j, dist) of directed pairs within cutoff, the diagonal at 0; other pairs have no row."""
    step = materialize(edges.select("graph_id", F.col("src").alias("j"), F.col("dst").alias("to")).distinct(), "steps")
    seen = front = materialize(nodes.select("graph_id", F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0).cast("long").alias("dist")), "paths")
    for hop in range(1, cutoff + 1):
        new = front.join(step, ["graph_id", "j"]).select("graph_id", "i", F.col("to").alias("j")).distinct().join(seen, ["graph_id", "i", "j"], "left_anti")
        front = materialize(new.withColumn("dist", F.lit(hop).cast("long")), "paths")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def flat_distances(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(graph_id, n, spd array<smallint>): row-major N x N with UNREACHABLE where no path is."""
    every = nodes.select("graph_id", F.col("node").alias("i")).join(nodes.select("graph_id", F.col("node").alias("j")), "graph_id")
    full = every.join(paths, ["graph_id", "i", "j"], "left").select("graph_id", F.struct("i", "j", F.coalesce("dist", F.lit(UNREACHABLE)).cast("smallint").alias("d")).alias("x"))
    out = full.groupBy("graph_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return out.select("graph_id", F.sqrt(F.size("x")).cast("int").alias("n"), F.transform("x", lambda v: v["d"]).alias("spd"))


def random_walk(nodes: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """(graph_id, t, i, j, p): probabilities of t = 0..steps-1 steps of the walk D^-1 A by out-degree; sinks stay put."""
    simple = edges.select("graph_id", F.col("src").alias("j"), F.col("dst").alias("to")).distinct()
    degree = simple.groupBy("graph_id", "j").agg(F.count(F.lit(1)).alias("deg"))
    moves = simple.join(degree, ["graph_id", "j"]).select("graph_id", "j", "to", (1.0 / F.col("deg")).alias("w"))
    sinks = nodes.select("graph_id", F.col("node").alias("j")).join(degree, ["graph_id", "j"], "left_anti").select("graph_id", "j", F.col("j").alias("to"), F.lit(1.0).alias("w"))
    moves = materialize(moves.unionByName(sinks), "walk-moves")
    now = materialize(nodes.select("graph_id", F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("p")), "walk")
    out = now.withColumn("t", F.lit(0))
    for t in range(1, steps):
        nxt = now.join(moves, ["graph_id", "j"]).groupBy("graph_id", "i", F.col("to").alias("k")).agg(F.sum(F.col("p") * F.col("w")).alias("p"))
        now = materialize(nxt.withColumnRenamed("k", "j"), "walk")
        out = out.unionByName(now.withColumn("t", F.lit(t)))
    return out.select("graph_id", F.col("t").cast("long").alias("t"), "i", "j", "p")


def return_probabilities(walk: DataFrame) -> DataFrame:
    """Diagonal of random_walk()."""
    return walk.where("i = j").select("graph_id", "t", F.col("i").alias("node"), "p")


def k_hop_pairs(edges: DataFrame, k: int) -> DataFrame:
    """(graph_id, i, j) reachable in 1..k directed steps; a node reaches itself only through a cycle."""
    step = edges.select("graph_id", F.col("src").alias("j"), F.col("dst").alias("to")).distinct()
    seen = front = materialize(edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j")).distinct(), "khop")
    for _ in range(k - 1):
        new = front.join(step, ["graph_id", "j"]).select("graph_id", "i", F.col("to").alias("j")).distinct().join(seen, ["graph_id", "i", "j"], "left_anti")
        front = materialize(new, "khop")
        seen = seen.unionByName(front)
    return seen


def prompt_mask(nodes: DataFrame, edges: DataFrame, k: int, directed: bool = False) -> DataFrame:
    """Allowed pairs (graph_id, i, j): prefix pairs within k steps that do not pass the prompt node, pairs with the prompt on
    the whole graph, and the diagonal. nodes: (graph_id, node, is_prompt)."""
    if not directed:
        edges = edges.select("graph_id", "src", "dst").unionByName(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    prompt = nodes.where("is_prompt").select("graph_id", F.col("node").alias("q"))
    marked = edges.join(prompt, "graph_id", "left")
    inner = k_hop_pairs(marked.where("q is null or (src <> q and dst <> q)").select("graph_id", "src", "dst"), k)
    whole = k_hop_pairs(edges, k).join(prompt, "graph_id").where("i = q or j = q").select("graph_id", "i", "j")
    diagonal = nodes.select("graph_id", F.col("node").alias("i"), F.col("node").alias("j"))
    return inner.unionByName(whole).unionByName(diagonal).distinct()


def _dense(n: int, src, dst) -> np.ndarray:
    a = np.zeros((n, n))
    a[np.asarray(src, int), np.asarray(dst, int)] = 1.0
    return a


def laplacian_coordinates(adjacency: np.ndarray, m: int) -> np.ndarray:
    """N x m spectral coordinates of a symmetric graph: eigenvectors after the first by rising eigenvalue, over the root of the
    eigenvalue (at least 0.01), times root N, zero-padded; zeros for one node or an asymmetric matrix."""
    n = len(adjacency)
    out = np.zeros((n, m))
    if n <= 1 or not np.array_equal(adjacency, adjacency.T):
        return out
    values, vectors = np.linalg.eigh(np.diag(adjacency.sum(1)) - adjacency)
    take = min(m, n - 1)
    scaled = vectors[:, 1 : take + 1] / np.sqrt(np.maximum(values[1 : take + 1], 1e-2))
    out[:, :take] = scaled * np.sqrt(n)
    return out


def magnetic_spectrum(adjacency: np.ndarray, q: float, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m lowest eigenvalues and eigenvectors of the Hermitian magnetic Laplacian with charge q, in double precision."""
    sym = 0.5 * (adjacency + adjacency.T)
    degree = sym.sum(1)
    root = np.where(degree > 0, 1.0 / np.sqrt(np.where(degree > 0, degree, 1.0)), 0.0)
    phase = np.exp(2j * np.pi * q * (adjacency - adjacency.T))
    lap = np.eye(len(sym)) - (root[:, None] * sym * root[None, :]) * phase
    values, vectors = np.linalg.eigh(lap)
    return values[:m], vectors[:, :m]


def _per_graph(nodes: DataFrame, edges: DataFrame, work, schema: str) -> DataFrame:
    """work(graph_id, node ids, adjacency) for each graph, which must fit one task (N x N doubles)."""

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(n["node"].unique())
        place = {v: i for i, v in enumerate(ids)}
        return work(key[0], ids, _dense(len(ids), e["src"].map(place), e["dst"].map(place)))

    return nodes.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(run, schema)


def laplacian_features(nodes: DataFrame, edges: DataFrame, m: int) -> DataFrame:
    """(graph_id, node, coordinates array<double>) of the symmetrised simple graph."""

    def work(g, ids, a):
        return pd.DataFrame({"graph_id": g, "node": ids, "coordinates": list(laplacian_coordinates(np.maximum(a, a.T), m))})

    return _per_graph(nodes, edges, work, "graph_id long, node long, coordinates array<double>")


def magnetic_features(nodes: DataFrame, edges: DataFrame, q: float, m: int) -> DataFrame:
    """(graph_id, k, value, re array, im array): eigenpairs of each graph's magnetic Laplacian, in rising order."""

    def work(g, ids, a):
        values, vectors = magnetic_spectrum(a, q, m)
        return pd.DataFrame({"graph_id": g, "k": np.arange(len(values)), "value": values, "re": list(vectors.real.T), "im": list(vectors.imag.T)})

    return _per_graph(nodes, edges, work, "graph_id long, k long, value double, re array<double>, im array<double>")


def laplacian_entries(nodes: DataFrame, edges: DataFrame, q: float | None = None) -> DataFrame:
    """(graph_id, i, j, re, im) of Laplacians in long form, zeros left out: the magnetic one with charge q, normalised, or without q the
    combinatorial one of the symmetrised graph."""
    one = edges.select("graph_id", "src", "dst").where("src <> dst").distinct()
    there = one.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("f"), F.lit(0.0).alias("b"))
    back = one.select("graph_id", F.col("dst").alias("i"), F.col("src").alias("j"), F.lit(0.0).alias("f"), F.lit(1.0).alias("b"))
    pairs = there.unionByName(back).groupBy("graph_id", "i", "j").agg(F.sum("f").alias("f"), F.sum("b").alias("b"))
    weight = F.lit(1.0) if q is None else (F.col("f") + F.col("b")) / 2
    pairs = pairs.select("graph_id", "i", "j", weight.alias("w"), (2 * np.pi * (q or 0.0) * (F.col("f") - F.col("b"))).alias("turn"))
    degree = pairs.groupBy("graph_id", "i").agg(F.sum("w").alias("deg"))
    diagonal = nodes.select("graph_id", F.col("node").alias("i")).distinct()
    if q is None:
        off = pairs.select("graph_id", "i", "j", (-F.col("w")).alias("re"), F.lit(0.0).alias("im"))
        own = diagonal.join(degree, ["graph_id", "i"], "left").select("graph_id", "i", F.col("i").alias("j"), F.coalesce("deg", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    else:
        ends = pairs.join(degree.withColumnRenamed("deg", "di"), ["graph_id", "i"]).join(degree.select("graph_id", F.col("i").alias("j"), F.col("deg").alias("dj")), ["graph_id", "j"])
        size = -F.col("w") / F.sqrt(F.col("di") * F.col("dj"))
        off = ends.select("graph_id", "i", "j", (size * F.cos("turn")).alias("re"), (size * F.sin("turn")).alias("im"))
        own = diagonal.select("graph_id", "i", F.col("i").alias("j"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return off.unionByName(own)


def eigen_residuals(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(graph_id, k, quotient, norm, residual): of vectors (graph_id, k, node, re, im) the Rayleigh quotient v*Lv / v*v, v*v, and |Lv - quotient v|."""
    v = vectors.select("graph_id", "k", F.col("node").alias("j"), F.col("re").alias("x"), F.col("im").alias("y"))
    product = entries.join(v, ["graph_id", "j"]).groupBy("graph_id", "k", F.col("i").alias("node")).agg(F.sum(F.col("re") * F.col("x") - F.col("im") * F.col("y")).alias("a"), F.sum(F.col("re") * F.col("y") + F.col("im") * F.col("x")).alias("b"))
    both = vectors.select("graph_id", "k", "node", F.col("re").alias("x"), F.col("im").alias("y")).join(product, ["graph_id", "k", "node"])
    sums = both.groupBy("graph_id", "k").agg(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("norm"), F.sum(F.col("x") * F.col("a") + F.col("y") * F.col("b")).alias("energy"))
    sums = sums.select("graph_id", "k", "norm", F.when(F.col("norm") > 0, F.col("energy") / F.col("norm")).otherwise(0.0).alias("quotient"))
    gaps = both.join(sums, ["graph_id", "k"]).groupBy("graph_id", "k").agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("quotient") * F.col("x"), 2) + F.pow(F.col("b") - F.col("quotient") * F.col("y"), 2))).alias("residual"))
    return sums.join(gaps, ["graph_id", "k"])


def _cuthill_mckee(a: np.ndarray) -> list[int]:
    """Reverse Cuthill-McKee order: breadth-first from nodes of least degree, neighbours by degree, then reversed."""
    a = np.maximum(a, a.T) > 0
    degree, left, order = a.sum(1), set(range(len(a))), []
    while left:
        front = [min(left, key=lambda v: (degree[v], v))]
        left.discard(front[0])
        while front:
            order += front
            nxt = []
            for v in front:
                near = sorted((w for w in np.flatnonzero(a[v]) if w in left), key=lambda w: (degree[w], w))
                left.difference_update(near)
                nxt += near
            front = nxt
    return order[::-1]


def reordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, new_node, bandwidth): nodes renumbered so that edges join near numbers."""

    def work(g, ids, a):
        order = _cuthill_mckee(a)
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        i, j = np.nonzero(a)
        width = int(np.abs(rank[i] - rank[j]).max()) if len(i) else 0
        return pd.DataFrame({"graph_id": g, "node": ids, "new_node": rank, "bandwidth": width})

    return _per_graph(nodes, edges, work, "graph_id long, node long, new_node long, bandwidth long")


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


#: Bytes of queries that are broadcast at most.
QUERY_BYTES = 32 << 20


def pairwise_l2(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, id, dist): distances of a stated query set (id, v) to all vectors (id, v). Queries are counted first: up to QUERY_BYTES they are
    broadcast; beyond, they go in blocks of that size, and each vector meets every block by an equi-join."""
    q = queries.select(F.col("id").alias("q"), F.col("v").alias("w"))
    facts = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("w")).alias("width")).first()
    blocks = -(-facts["n"] * (16 + 8 * (facts["width"] or 0)) // QUERY_BYTES)
    if blocks <= 1:
        pairs = vectors.crossJoin(F.broadcast(q))
    else:
        cut = q.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
        pairs = vectors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(cut, "block")
    return pairs.select("q", "id", l2_distance(F.col("v"), F.col("w")).alias("dist"))


def distance_bias(paths: DataFrame, weights: list[float]) -> DataFrame:
    """(graph_id, i, j, bias): weight of min(dist, last) - 1; the diagonal has none."""
    table = F.array(*map(F.lit, weights))
    at = F.least(F.greatest(F.col("dist") - 1, F.lit(0)), F.lit(len(weights) - 1)).cast("int")
    return paths.select("graph_id", "i", "j", F.when(F.col("dist") == 0, F.lit(0.0)).otherwise(F.get(table, at)).alias("bias"))


def degrees(edges: DataFrame) -> DataFrame:
    """(graph_id, node, out_degree, in_degree), nodes with an edge."""
    out = edges.select("graph_id", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select("graph_id", F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("graph_id", "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def relation_paths(edges: DataFrame, roots: DataFrame, max_len: int) -> DataFrame:
    """(graph_id, root, node, path): simple directed paths of 1..max_len edges with relation names joined by ' '."""
    step = edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("to"), "relation")
    front = roots.select("graph_id", F.col("node").alias("root"), "node", F.array("node").alias("seen"), F.lit("").alias("path"))
    out = None
    for _ in range(max_len):
        front = front.join(step, ["graph_id", "node"]).where(~F.array_contains("seen", F.col("to")))
        front = front.select("graph_id", "root", F.col("to").alias("node"), F.array_append("seen", F.col("to")).alias("seen"), F.ltrim(F.concat_ws(" ", "path", "relation")).alias("path"))
        front = materialize(front, "relation-paths")
        rows = front.select("graph_id", "root", "node", "path")
        out = rows if out is None else out.unionByName(rows)
    return out
