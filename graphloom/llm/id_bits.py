"""Which rows may have an id of a list: a filter by a bit table of fixed size, so that most rows stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import free_name

#: Bits by hash of an id: 2 MiB, in at most 2**18 rows of 64, whatever the length of the list.
ID_BITS = 1 << 24


def flag_listed(rows: DataFrame, ids: DataFrame, column: str, flag: str) -> DataFrame:
    """rows with a boolean column flag: true for all rows whose id is in ids (same column name), and for a few others. A null id is not
    listed. Only the bit table is broadcast."""
    word, bits = free_name(rows, "word"), free_name(rows, "bits")
    place = F.pmod(F.xxhash64(column), F.lit(ID_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{column}`), {ID_BITS}) % 64 as int))")
    words = ids.where(F.col(column).isNotNull()).select(F.floor(place / 64).alias(word), bit.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    found = rows.withColumn(word, F.floor(place / 64)).join(F.broadcast(words), word, "left")
    hit = F.col(column).isNotNull() & F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    return found.withColumn(flag, hit).drop(word, bits)
