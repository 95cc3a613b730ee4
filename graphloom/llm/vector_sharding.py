"""Sharding by vector bin packing: groups of equal texts are placed where their (bytes, tokens, rows) vector has the largest
dot product with what the shard still has room for.

The number of items packed on the driver is bounded: groups of some weight are items of their own, and all lighter groups
fall by hash into bundles. Slots are numbered unit by unit, so no task sees a whole shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.quality_rules import words_of
from graphloom.storage import materialize

#: Bundles of light groups for each shard; a group of at least 1 / (GRAIN * shards) of any total is an item of its own.
GRAIN = 512
#: With more shards there are fewer bundles for each, 8 at least, so that about this many units, and tables of a few times as many short
#: rows, are packed on the driver and broadcast. It bounds shards at SHARDS.
UNITS, SHARDS = 1 << 18, 1 << 15


def dot_product_packing(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of vectors (items x dimensions), largest items first; ties go to the lowest shard.

    Dimensions count as shares of their totals, and every shard may hold 1 / shards of each. An item goes to a shard with
    room for it in the first dimension where one has, to the one with most room left there otherwise.
    """
    totals = vectors.sum(0)
    share = vectors / np.where(totals > 0, totals, 1)
    room = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -share[:, 0], -share.max(1))):
        fits = room[:, 0] >= share[i, 0] - 1e-12
        score = np.where(fits, room @ share[i], -np.inf) if fits.any() else room[:, 0]
        out[i] = int(score.argmax())
        room[out[i]] -= share[i]
    return out


def vector_sharding(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", grain: int = GRAIN) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot): size is the text's UTF-8 bytes + 1, slots are gapless from 0.

    Equal texts (null counts as empty) share a shard, unless one group alone exceeds a shard's room, which would break the
    balance: such a group is cut by row into the fewest parts that fit. Bytes of the shards end near equal, tokens and
    rows as near as the groups allow. Null and repeated ids are placed like any other row; other columns are ignored; an
    empty table gives an empty result.
    """
    if not 0 < shards <= SHARDS:
        raise ValueError(f"shards must be from 1 to {SHARDS}; shard the shards for more")
    grain = max(8, min(grain, UNITS // shards))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.size(words_of(F.col("text"))).cast("long").alias("tokens"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), F.monotonically_increasing_id().alias("row"))
    base = materialize(base, "shard-rows")
    groups = materialize(base.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    dims = ("bytes", "tokens", "rows")
    total = groups.agg(*(F.coalesce(F.sum(d), F.lit(0)).cast("double").alias(d) for d in dims)).first()
    limits = {d: max(total[d] / (grain * shards), 1e-9) for d in dims}
    heavy_rule = F.lit(False)
    for d in dims:
        heavy_rule = heavy_rule | (F.col(d) >= limits[d])
    # at most len(dims) * grain * shards rows
    heavy = groups.where(heavy_rule).orderBy("k1", "k2").toPandas()
    heavy["parts"] = np.maximum(1, np.ceil(np.max([heavy[d] / max(total[d] / shards, 1e-9) for d in dims], axis=0) - 1e-9)).astype(int) if len(heavy) else []
    heavy["item"] = np.cumsum(heavy["parts"]) - heavy["parts"] if len(heavy) else []
    spark = docs.sparkSession
    listed = spark.createDataFrame([(int(r.k1), int(r.k2), int(r.item), int(r.parts)) for r in heavy.itertuples()], "k1 long, k2 long, item long, parts long")
    first_bundle, bundles = int(heavy["parts"].sum()) if len(heavy) else 0, grain * shards
    # bundle widths fall off, so that small ones are left for the end of the packing
    spread = F.pow(F.pmod("k1", F.lit(1 << 30)) / float(1 << 30), 1.5) * bundles
    placed = base.join(F.broadcast(listed), ["k1", "k2"], "left")
    placed = placed.withColumn("unit", F.when(F.col("item").isNotNull(), F.col("item") + F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(first_bundle + F.floor(spread)).cast("long"))
    placed = materialize(placed.select("doc_id", "size", "tokens", "text_crc32", "row", "unit"), "shard-units")
    # at most first_bundle + bundles rows, each unit in as many pieces as its rows need for numbering
    sums = placed.groupBy("unit").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).orderBy("unit").toPandas()
    shard = dot_product_packing(sums[list(dims)].to_numpy(float), shards) if len(sums) else np.zeros(0, int)
    sums["shard"] = shard
    pieces = np.maximum(1, np.ceil(sums["rows"] / max(sums["rows"].sum() / bundles, 1000))).astype(int) if len(sums) else []
    units = spark.createDataFrame([(int(u), int(s), int(p)) for u, s, p in zip(sums["unit"], shard, pieces, strict=True)], "unit long, shard int, pieces int")
    numbered = placed.join(F.broadcast(units), "unit").withColumn("piece", F.pmod(F.xxhash64("row", F.lit(3)), F.col("pieces")))
    numbered = materialize(numbered, "shard-pieces")
    # at most about first_bundle + 2 * bundles rows
    counts = numbered.groupBy("shard", "unit", "piece").agg(F.count(F.lit(1)).alias("n")).orderBy("shard", "unit", "piece").toPandas()
    counts["base"] = counts.groupby("shard")["n"].cumsum() - counts["n"] if len(counts) else []
    offsets = spark.createDataFrame([(int(r.unit), int(r.piece), int(r.base)) for r in counts.itertuples()], "unit long, piece long, base long")
    from pyspark.sql.window import Window

    within = F.row_number().over(Window.partitionBy("unit", "piece").orderBy("row")) - 1
    out = numbered.withColumn("rank", within).join(F.broadcast(offsets), ["unit", "piece"])
    return out.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"))
