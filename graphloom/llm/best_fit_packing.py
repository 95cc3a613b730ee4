"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity.

A document longer than a sequence is cut; full pieces are sequences of their own. The others are dealt by hash into groups of
bounded size, longest first within a group, and each is placed where the sum over residual gaps of the squared number of
open sequences with that gap becomes smallest; a new sequence begins where no open one has room. A group leaves a handful
of open sequences, which is the only cost of packing groups apart from one another.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.storage import materialize

#: Pieces in one group, on average; each costs a few microseconds and some 100 bytes in the task that packs it.
GROUP = 1 << 17
#: Bytes of text that are encoded at once.
BLOCK_BYTES = 1 << 21


class SumOfSquares:
    """Open sequences by residual gap."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.made = capacity, [[] for _ in range(capacity + 1)], 0
        self.count = np.zeros(capacity + 1, np.int64)

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to capacity tokens. A new sequence begins only where no open one has room, as
        all pieces are known and come longest first; ties go to the smallest gap."""
        n, cap = self.count, self.capacity
        # taking gap g: its count falls by one and that of g - size rises by one; gap 0 is closed and not counted
        change = 2 * (n[: cap + 1 - size] - n[size:]) + 2
        change[0] = 1 - 2 * n[size]
        gain = int(np.where(n[size:] > 0, change, np.iinfo(np.int64).max).argmin())
        gap = gain + size
        if n[gap]:
            sequence = self.open[gap].pop()
            n[gap] -= 1
        else:
            sequence, gap = self.made, cap
            self.made += 1
        if gap > size:
            self.open[gap - size].append(sequence)
            n[gap - size] += 1
        return sequence, cap - gap


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each whole text's token ids and end_id, cut at multiples of capacity.

    tokenizer_path names a tokenizers JSON file that executors can read; word_bpe says which kind. Null and empty texts are
    end_id alone. Null and repeated ids are kept as they are, and so are repeated rows; other columns are ignored; an empty
    table gives an empty result. ids_crc32 is over little-endian unsigned 32-bit ids.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        import pyarrow as pa

        from graphloom.llm import word_bpe

        coder = word_bpe.load(tokenizer_path)
        for batch in batches:
            for a, b, texts in K.text_blocks(batch.column(1), BLOCK_BYTES):
                ids, bounds = coder.encode(texts, end_id)
                ids = ids.astype("<u4")
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                own = np.repeat(np.arange(b - a), pieces)
                number = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(sizes[own] - start, capacity)
                first = bounds[own] + start
                data = memoryview(ids.tobytes())
                sums = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(first.tolist(), (first + length).tolist(), strict=True)]
                arrays = [batch.column(0).slice(a, b - a).take(pa.array(own)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(K.released(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _pack(capacity: int):
    """Rows (grp, length, ...) sorted by group and falling length."""

    def run(batches):
        import pyarrow as pa

        group, bins = None, None
        for batch in batches:
            places = []
            for g, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if g != group:
                    group, bins = g, SumOfSquares(capacity)
                sequence, offset = bins.place(length)
                places.append((g << 32 | sequence, offset))
            ids, offsets = zip(*places, strict=True) if places else ((), ())
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*batch.schema.names[1:], "sequence_id", "offset"])

    return run


def sum_of_squares_packing(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to piece rows (doc_id, piece, start, length, ids_crc32), all of length 1 to capacity.

    Within a sequence the offsets are gapless from 0 and stay within capacity. Equal rows are separate pieces. The plan
    carries lengths, not ids. An empty table gives an empty result.
    """
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    pieces = materialize(pieces.select(*names), "pieces")
    small = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-small.count() // group))
    tasks = max(groups, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the row's place in the staged table keeps equal rows apart
    dealt = small.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    dealt = dealt.select("grp", "length", "doc_id", "piece", "start", "ids_crc32").repartition(tasks, "grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "piece", "ids_crc32")
    packed = dealt.mapInArrow(K.released(_pack(capacity)), "length long, doc_id long, piece int, start long, ids_crc32 long, sequence_id long, offset long")
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.select(*names, "sequence_id", "offset").unionByName(full)
