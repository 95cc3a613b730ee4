"""Token rows and arrays: packing, positions, label masks and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IGNORE = -100


def pack_offsets(nodes: DataFrame) -> DataFrame:
    """Add offset: tokens (len) of the nodes before, plain nodes in order and the prompt node last."""
    order = Window.partitionBy("graph_id").orderBy("is_prompt", "node").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("offset", F.coalesce(F.sum("len").over(order), F.lit(0)).cast("long"))


def token_rows(packed: DataFrame) -> DataFrame:
    """(graph_id, pos, node, position_id): one row for each token; positions start anew in each node."""
    rows = packed.where("len > 0").select("graph_id", "node", "offset", F.explode(F.sequence(F.lit(0), (F.col("len") - 1).cast("int"))).alias("k"))
    return rows.select("graph_id", (F.col("offset") + F.col("k")).alias("pos"), "node", F.col("k").cast("long").alias("position_id"))


def depth_positions(nodes: DataFrame, max_depth: int) -> DataFrame:
    """Add start: first position of each node by its distance, stride * min(dist, max_depth); the prompt stands one deeper
    than all others (at 0 when alone); stride is the graph's longest node."""
    w = Window.partitionBy("graph_id")
    stride = F.max("len").over(w)
    depth = F.least(F.col("dist"), F.lit(max_depth))
    deepest = F.max(F.when(~F.col("is_prompt"), depth)).over(w)
    return nodes.withColumn("start", (stride * F.when(F.col("is_prompt"), F.coalesce(deepest + 1, F.lit(0))).otherwise(depth)).cast("long"))


def node_starts(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(graph_id, node, start): first token position of each node, 0 for nodes without tokens."""
    first = tokens.groupBy("graph_id", "node").agg(F.min("pos").alias("start"))
    return nodes.select("graph_id", "node").join(first, ["graph_id", "node"], "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))


def shift_align(tokens: DataFrame, pred: str) -> DataFrame:
    """Add aligned: the prediction made one position before."""
    return tokens.withColumn("aligned", F.lag(pred).over(Window.partitionBy("graph_id").orderBy("pos")))


def occurrences(ids: Column, part: Column) -> Column:
    """Places at which part occurs in ids."""
    last = F.size(ids) - F.size(part)
    return F.when((last >= 0) & (F.size(part) > 0), F.filter(F.sequence(F.lit(0), last), lambda i: F.slice(ids, i + 1, F.size(part)) == part)).otherwise(F.array().cast("array<int>"))


def answer_labels(ids: Column, prefix: Column, policy: str) -> Column:
    """ids with IGNORE up to the end of the prefix's first, last or unique occurrence; an error where it is missing or, for
    unique, repeated."""
    at = occurrences(ids, prefix)
    pick = {"first": F.array_min(at), "last": F.array_max(at), "unique": F.when(F.size(at) == 1, F.get(at, F.lit(0)))}[policy]
    end = F.coalesce(pick, F.raise_error(F.lit(f"no {policy} occurrence of the answer prefix")).cast("int")) + F.size(prefix)
    return F.transform(ids, lambda x, i: F.when(i < end, F.lit(IGNORE)).otherwise(x))


def prefix_labels(ids: Column, masked: int | Column) -> Column:
    """ids with IGNORE in the first masked places. ids enters a few times, not once for each element."""
    masked = F.least(F.lit(masked) if isinstance(masked, int) else masked, F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORE), masked), F.slice(ids, masked + 1, F.size(ids)))


def last_token_labels(ids: Column) -> Column:
    """ids with IGNORE everywhere but in the last place."""
    return prefix_labels(ids, F.greatest(F.size(ids) - 1, F.lit(0)))


def pad_right(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def pad_left(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)).cast("int")), ids)


def collate(rows: DataFrame, batch: str, pad: int) -> DataFrame:
    """Pad ids to the longest of their batch, and labels with IGNORE; add mask."""
    longest = F.max(F.size("ids")).over(Window.partitionBy(batch))
    out = rows.withColumn("longest", longest)
    return out.withColumns({"mask": pad_right(F.transform("ids", lambda _: F.lit(1)), F.col("longest"), 0), "labels": pad_right(F.col("labels"), F.col("longest"), IGNORE), "ids": pad_right(F.col("ids"), F.col("longest"), pad)}).drop("longest")


def attention_density(mask: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """(graph_id, density, block_density) of allowed token pairs (graph_id, q, k) among n * n, by elements and by blocks."""
    blocks = F.ceil(F.col("n") / block)
    seen = mask.groupBy("graph_id").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct(F.floor(F.col("q") / block), F.floor(F.col("k") / block)).alias("hit"))
    return seen.join(lengths, "graph_id").select("graph_id", (F.col("pairs") / (F.col("n") * F.col("n"))).alias("density"), (F.col("hit") / (blocks * blocks)).alias("block_density"))


def prefix_mask_pairs(nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """(graph_id, blocked, pairs): token pairs of different prefix nodes that the node mask (graph_id, i, j) blocks, and all."""
    part = nodes.where(~F.col("is_prompt")).select("graph_id", "node", "len")
    a, b = part.alias("a"), part.alias("b")
    pairs = a.join(b, F.expr("a.graph_id = b.graph_id and a.node <> b.node")).select("a.graph_id", F.col("a.node").alias("i"), F.col("b.node").alias("j"), (F.col("a.len") * F.col("b.len")).alias("w"))
    seen = pairs.join(allowed.select("graph_id", "i", "j", F.lit(True).alias("hit")), ["graph_id", "i", "j"], "left")
    return seen.groupBy("graph_id").agg(F.sum(F.when(F.col("hit").isNull(), F.col("w")).otherwise(0)).alias("blocked"), F.sum("w").alias("pairs"))


def structural_mask(tokens: DataFrame, allowed: DataFrame) -> DataFrame:
    """(graph_id, q, k): token pairs that are causal or both of the prefix, allowed by the node mask, or on the diagonal.

    tokens (graph_id, pos, node, is_prompt)."""
    t = tokens.select("graph_id", "pos", "node", "is_prompt")
    a, b = t.alias("a"), t.alias("b")
    pairs = a.join(b, F.expr("a.graph_id = b.graph_id and (b.pos <= a.pos or (not a.is_prompt and not b.is_prompt))"))
    rows = pairs.select("a.graph_id", F.col("a.pos").alias("q"), F.col("b.pos").alias("k"), F.col("a.node").alias("i"), F.col("b.node").alias("j"))
    inside = rows.join(allowed.select("graph_id", "i", "j"), ["graph_id", "i", "j"], "left_semi").select("graph_id", "q", "k")
    return inside.unionByName(t.select("graph_id", F.col("pos").alias("q"), F.col("pos").alias("k"))).distinct()


def pair_bias(tokens: DataFrame, bias: DataFrame) -> DataFrame:
    """(graph_id, q, k, bias): node-pair values (graph_id, i, j, bias) for all token pairs of those nodes."""
    a = tokens.select("graph_id", F.col("pos").alias("q"), F.col("node").alias("i"))
    b = tokens.select("graph_id", F.col("pos").alias("k"), F.col("node").alias("j"))
    return bias.join(a, ["graph_id", "i"]).join(b, ["graph_id", "j"]).select("graph_id", "q", "k", "bias")


def drop_lines(lines: Column, sizes: Column, limit: int, step: int = 8) -> Column:
    """Lines left when the last step lines go again and again until their sizes fit limit."""
    total = lambda n: F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda a, x: a + x)
    counts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lines) / step).cast("int")), lambda i: F.greatest(F.size(lines) - i * step, F.lit(0)))
    fits = F.array_max(F.filter(counts, lambda n: total(n) <= limit))
    return F.slice(lines, F.lit(1), F.coalesce(fits, F.lit(0)))
