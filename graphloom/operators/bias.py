"""Attention biases with given weights, in long form (graph_id, i, j, bias), and the spectra behind them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.hooks import BIASES
from graphloom.operators.structure import _per_graph, magnetic_spectrum


def dense_layer(x: Column, weights: list[list[float]], biases: list[float], activation: str = "none") -> Column:
    """A layer of a small network on an array column, as an expression: weights has a row for each output."""
    act = {"none": lambda v: v, "relu": lambda v: F.greatest(v, F.lit(0.0)), "tanh": F.tanh, "silu": lambda v: v / (1.0 + F.exp(-v))}[activation]
    dot = lambda row: F.aggregate(F.zip_with(x, F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.array(*(act(dot(row) + F.lit(b)) for row, b in zip(weights, biases, strict=True)))


@BIASES.add("walk")
def walk_bias(walk: DataFrame, layers: list[tuple[list[list[float]], list[float], str]]) -> DataFrame:
    """A network over each pair's walk probabilities (graph_id, t, i, j, p), steps without a row counting as 0; no bias on the
    diagonal. Pairs that no step reaches have no row."""
    steps = len(layers[0][0][0])
    pairs = walk.where(F.col("i") != F.col("j")).groupBy("graph_id", "i", "j").agg(F.map_from_entries(F.collect_list(F.struct(F.col("t").cast("int"), "p"))).alias("m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0)))
    pairs = pairs.withColumn("x", x)
    for weights, biases, activation in layers:
        pairs = pairs.withColumn("x", dense_layer(F.col("x"), weights, biases, activation))
    return pairs.select("graph_id", "i", "j", F.get("x", F.lit(0)).alias("bias"))


@BIASES.add("distance")
def table_bias(paths: DataFrame, weights: list[float]) -> DataFrame:
    from graphloom.operators.structure import distance_bias

    return distance_bias(paths, weights)


#: Heads of the magnetic term: what a pair's complex kernel value becomes.
HEADS = {
    "real": lambda z: z.real,
    "magnitude": np.abs,
    "phase": np.angle,
    "hybrid": lambda z: z.real + np.abs(z),
    "gated": lambda z: z.real / (1.0 + np.exp(-np.abs(z))),
}


def spectral_kernel(adjacency: np.ndarray, q: float, m: int, response, head: str = "real", self_energy: bool = True) -> np.ndarray:
    """N x N: head of sum_k response(value_k) u_k(i) conj(u_k(j)) over the m lowest eigenpairs of the magnetic Laplacian; the diagonal is 0
    without self_energy. With response(v) = v, all eigenpairs and the real head this is the Laplacian's real part."""
    values, vectors = magnetic_spectrum(adjacency, q, m)
    out = HEADS[head]((vectors * np.asarray(response(values))) @ vectors.conj().T)
    if not self_energy:
        np.fill_diagonal(out, 0.0)
    return out


@BIASES.add("magnetic")
def magnetic_bias(nodes: DataFrame, edges: DataFrame, q: float, m: int, response, head: str = "real", self_energy: bool = True) -> DataFrame:
    """(graph_id, i, j, bias) of all pairs of each graph, by spectral_kernel(); a graph must fit one task."""

    def work(g, ids, a):
        k = spectral_kernel(a, q, m, response, head, self_energy)
        i, j = np.divmod(np.arange(k.size), len(ids))
        return pd.DataFrame({"graph_id": g, "i": ids[i], "j": ids[j], "bias": k.ravel()})

    return _per_graph(nodes, edges, work, "graph_id long, i long, j long, bias double")


@BIASES.add("linear")
def linear_bias(features: DataFrame, left: list[list[float]], right: list[list[float]]) -> DataFrame:
    """f(i) . g(j) for node features (graph_id, node, x array): two linear maps and a product, so that pairs need no network of their own."""
    f, g = (features.select("graph_id", F.col("node").alias(n), dense_layer(F.col("x"), w, [0.0] * len(w)).alias(c)) for n, w, c in (("i", left, "f"), ("j", right, "g")))
    product = F.aggregate(F.zip_with("f", "g", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return f.join(g, "graph_id").select("graph_id", "i", "j", product.alias("bias"))


def combined_bias(parts: list[DataFrame], allowed: DataFrame | None = None) -> DataFrame:
    """Sum of biases by pair; allowed (graph_id, i, j) gates them: other pairs have no row, and allowed ones without a bias have 0."""
    rows = reduce(DataFrame.unionByName, [p.select("graph_id", "i", "j", "bias") for p in parts])
    if allowed is not None:
        zeros = allowed.select("graph_id", "i", "j").distinct().withColumns({"bias": F.lit(0.0), "gate": F.lit(True)})
        rows = rows.withColumn("gate", F.lit(False)).unionByName(zeros)
        return rows.groupBy("graph_id", "i", "j").agg(F.sum("bias").alias("bias"), F.max("gate").alias("gate")).where("gate").drop("gate")
    return rows.groupBy("graph_id", "i", "j").agg(F.sum("bias").alias("bias"))


def energy_rank(matrix: np.ndarray, share: float) -> int:
    """How many singular values hold a share of the squared sum."""
    energy = np.cumsum(np.linalg.svd(matrix, compute_uv=False) ** 2)
    return int(np.searchsorted(energy, share * energy[-1] - 1e-12 * energy[-1]) + 1) if len(energy) and energy[-1] > 0 else 0


def spectrum_ranks(entries: DataFrame, shares: tuple[float, ...] = (0.9, 0.99)) -> DataFrame:
    """(graph_id, share, rank) of matrices in long form (graph_id, i, j, value), each of which must fit one task."""

    def work(key, pdf):
        a = pdf.pivot_table(index="i", columns="j", values="value", aggfunc="sum", fill_value=0.0).to_numpy()
        return pd.DataFrame({"graph_id": key[0], "share": shares, "rank": [energy_rank(a, s) for s in shares]})

    return entries.select("graph_id", "i", "j", "value").groupBy("graph_id").applyInPandas(work, "graph_id long, share double, rank long")


def row_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(graph_id, kl): mean over rows of the divergence between softmaxes of two matrices (graph_id, i, j, value) on the same pairs."""
    pairs = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["graph_id", "i", "j"])
    tops = pairs.groupBy("graph_id", "i").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    pairs = pairs.join(tops, ["graph_id", "i"]).withColumns({"x": F.col("x") - F.col("mx"), "y": F.col("y") - F.col("my")})
    # sum_j p (x - y) - log Z_x + log Z_y, with p = exp(x) / Z_x
    rows = pairs.groupBy("graph_id", "i").agg(F.sum(F.exp("x")).alias("zx"), F.sum(F.exp("y")).alias("zy"), F.sum(F.exp("x") * (F.col("x") - F.col("y"))).alias("d"))
    return rows.groupBy("graph_id").agg(F.avg(F.col("d") / F.col("zx") - F.log("zx") + F.log("zy")).alias("kl"))


def sampled_density(density: DataFrame, key: str, batch: int, sample: int, seed: str) -> DataFrame:
    """(level, n, mean, std, mean_sparsity): density (key, value) of a seeded draw of items, and of the means of its batches in draw order."""
    from graphloom.operators.textgraph import seeded_sample

    drawn = seeded_sample(density, key, sample, seed)
    from graphloom.operators.positions import global_index

    placed = global_index(drawn.withColumn("__mark", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)), ["__mark", key], "__at")
    batches = placed.groupBy(F.floor(F.col("__at") / batch).alias("b")).agg(F.avg("value").alias("value"))
    facts = lambda level: (F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev("value"), F.lit(0.0)).alias("std"), (1.0 - F.avg("value")).alias("mean_sparsity"))
    return placed.agg(*facts("item")[1:]).select(F.lit("item").alias("level"), "*").unionByName(batches.agg(*facts("batch")[1:]).select(F.lit("batch").alias("level"), "*"))
