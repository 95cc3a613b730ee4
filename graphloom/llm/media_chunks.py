"""Media columns in a content-addressed chunk store.

A text's bytes become 8-bit samples behind a small header. A rolling gear hash cuts this media object into content-defined
chunks. Chunk digests meet in Spark joins; a chunk is stored once, by the first bucket of documents that has it, and
documents keep ordered chunk lists. Reading rebuilds every object from its list, checks all digests, and only then
computes features.

Buckets of documents travel as compressed packs. A document whose chunks are all its bucket's own is stored whole; only
documents that share chunks with other buckets are joined with the shared ones on reading.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.llm.substring_dedup import by_bucket, pack_documents, unpack_documents
from graphloom.storage import bucket_count, fresh_path

MAGIC = b"SMP8"
#: Chunk bounds in bytes; on average a cut comes 1 KiB after the least size, so that ordinary texts are several chunks.
LEAST, MOST, MASK = 512, 8192, (1 << 10) - 1
WINDOW = 32
#: Input bytes for each bucket of documents. A bucket passes a task as a stream of packs, so it may be large: the more it holds, the
#: better packs compress, and the fewer chunks are shared with other buckets.
BUCKET_BYTES = 16 << 20
_GEAR = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 32, 256, dtype=np.uint32)


def media_object(text: bytes, frame: int = 576) -> bytes:
    """Header (magic, samples, frame) and the samples: the text and bytes 255 up to a positive multiple of frame."""
    size = max(1, -(-len(text) // frame)) * frame
    return MAGIC + struct.pack("<QI", size, frame) + text.ljust(size, b"\xff")


def media_payload(data: bytes) -> bytes:
    magic, size, frame = data[:4], *struct.unpack_from("<QI", data, 4)
    if magic != MAGIC or len(data) != 16 + size or size % frame:
        raise ValueError("malformed media object")
    return data[16:]


def gear_cuts(data: bytes, least: int = LEAST, most: int = MOST, mask: int = MASK) -> list[int]:
    """Ends of the chunks: where the gear hash of the last 32 bytes has no bit of mask, within the bounds."""
    end = len(data)
    if end <= least:
        return [end]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # h[i] = sum of gear[data[i - j]] << j for j < width
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, width * 2
    # high bits depend on all of the window
    places = np.flatnonzero(h >> np.uint32(32 - mask.bit_length()) == 0) + 1
    cuts, at = [], 0
    while end - at > least:
        i = int(np.searchsorted(places, at + least))
        cut = min(int(places[i]) if i < len(places) else end, at + most, end)
        cuts.append(cut)
        at = cut
    if at < end:
        cuts.append(end)
    return cuts


def _chunks(text: bytes) -> tuple[bytes, list[bytes], list[bytes]]:
    data = media_object(text)
    cuts = gear_cuts(data)
    parts = [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
    return data, parts, [hashlib.sha256(p).digest()[:16] for p in parts]


def _references(batches):
    """(bucket, text) to the different chunk digests of each bucket in the batch."""
    import pyarrow as pa

    for batch in batches:
        found = set()
        for bucket, text in zip(batch.column(0).to_pylist(), K.as_bytes(batch.column(1)), strict=True):
            found.update((bucket, digest) for digest in _chunks(text)[2])
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "digest"])


def _store():
    """Store rows (kind, bucket, payload). whole and partial: documents; shared: a chunk that other buckets read too."""
    import pyarrow as pa
    import zstandard

    def work(bucket, answers, packs):
        squeeze = zstandard.ZstdCompressor(level=6).compress
        owner = {a[:16]: int.from_bytes(a[16:], "big") for a in answers}
        rows, told = [], set()
        pending: dict[str, list] = {"whole": [], "partial": []}
        bodies: dict[str, dict] = {"whole": {}, "partial": {}}

        def close(kind):
            if pending[kind]:
                lists, body = b"".join(pending[kind]), b"".join(bodies[kind].values())
                index = b"".join(d + struct.pack("<I", len(p)) for d, p in bodies[kind].items())
                rows.append((kind, bucket, squeeze(struct.pack("<III", len(pending[kind]), len(lists), len(bodies[kind])) + lists + index + body)))
                pending[kind], bodies[kind] = [], {}

        weight = 0
        for pack in packs:  # one at a time: a bucket of any size passes in bounded memory
            _, ids, void, texts = unpack_documents(pack)
            for doc, empty, text in zip(ids.tolist(), void.tolist(), texts, strict=True):
                data, parts, digests = _chunks(text)
                kind = "partial" if any(d in owner for d in digests) else "whole"
                pending[kind].append(struct.pack("<q?16sI", doc, empty, hashlib.sha256(data).digest()[:16], len(digests)) + b"".join(digests))
                weight += 29 + 16 * len(digests)
                for digest, part in zip(digests, parts, strict=True):
                    if digest in owner:
                        if owner[digest] == bucket and digest not in told:
                            told.add(digest)
                            rows.append(("shared", bucket, digest + squeeze(part)))
                    elif digest not in bodies[kind]:
                        bodies[kind][digest] = part
                        weight += len(part)
                if weight > 4 << 20:
                    close("whole")
                    close("partial")
                    weight = 0
                if len(rows) > 64:
                    yield batch_of(rows)
                    rows.clear()
        close("whole")
        close("partial")
        yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.binary()))], ["kind", "bucket", "payload"])

    return by_bucket(work)


def _documents(payload: bytes):
    """Chunk lists and chunks of one store row."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, lists, chunks = struct.unpack_from("<III", raw, 0)
    at, found = 12, []
    for _ in range(n):
        doc, empty, check, count = struct.unpack_from("<q?16sI", raw, at)
        at += struct.calcsize("<q?16sI")
        found.append((doc, empty, check, [raw[at + 16 * i : at + 16 * i + 16] for i in range(count)]))
        at += 16 * count
    body, parts = at + 20 * chunks, {}
    for _ in range(chunks):
        digest, size = struct.unpack_from("<16sI", raw, at)
        parts[digest] = raw[body : body + size]
        at, body = at + 20, body + size
    return found, parts


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def features(data: bytes) -> tuple:
    """Of a rebuilt media object: sizes, digests, and shares of byte classes with the mean and spread of samples."""
    payload = media_payload(data)
    text = payload.rstrip(b"\xff")
    samples = np.frombuffer(payload, np.uint8)
    classes = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    feature = f"mean={samples.mean():.3f};std={samples.std():.3f};hist=" + ",".join(map(str, classes.tolist()))
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature


def _rebuild(found, parts) -> list:
    rows = []
    for doc, empty, check, digests in found:
        data = b"".join(map(parts.__getitem__, digests))
        if hashlib.sha256(data).digest()[:16] != check:
            raise ValueError("a rebuilt media object differs from what was stored")
        rows.append((None if empty else doc, *features(data), len(digests)))
    return rows


def _feature_batch(rows):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in FEATURES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _check(parts: dict) -> dict:
    for digest, part in parts.items():
        if hashlib.sha256(part).digest()[:16] != digest:
            raise ValueError("a stored chunk differs from its digest")
    return parts


def _read_whole(batches):
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            found, parts = _documents(payload)
            if rows := _rebuild(found, _check(parts)):
                yield _feature_batch(rows)


def _read_partial(batches):
    """Rows (bucket, kind, payload) sorted: shared chunks of a bucket first, then its documents."""
    import zstandard

    inflate = zstandard.ZstdDecompressor().decompress
    bucket, shared = None, {}
    for batch in batches:
        for b, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                bucket, shared = b, {}
            if kind == 0:
                shared[payload[:16]] = inflate(payload[16:])
            else:
                found, parts = _documents(payload)
                if rows := _rebuild(found, _check(parts) | _check(shared)):
                    yield _feature_batch(rows)


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts as media objects into a chunk store at folder; returns (bucket, digest, owner) of shared chunks.

    Null texts are empty ones. Null and repeated ids are stored like any other row; rows are dealt by id and text, so that
    ids that are null or repeat don't gather in one bucket. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(base, BUCKET_BYTES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    placed = base.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).alias("bucket"), F.lit(0).cast("long").alias("row_id"), "doc_id", "text")
    refs = placed.select("bucket", "text").mapInArrow(_references, "bucket long, digest binary").distinct()
    owners = refs.groupBy("digest").agg(F.min("bucket").alias("owner"), F.max("bucket").alias("last")).where("owner <> last").drop("last")
    shared = refs.join(owners, "digest")
    path = f"{folder}/shared-digests"
    shared.select("bucket", "digest", "owner").write.parquet(path)
    shared = spark.read.schema("bucket long, digest binary, owner long").parquet(path)
    told = shared.select("bucket", F.lit(0).alias("kind"), F.concat("digest", F.unhex(F.lpad(F.hex("owner"), 16, "0"))).alias("payload"))
    packs = placed.mapInArrow(pack_documents, "bucket long, payload binary").select("bucket", F.lit(1).alias("kind"), "payload")
    rows = told.unionByName(packs).repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind")
    rows.mapInArrow(_store(), "kind string, bucket long, payload binary").write.partitionBy("kind").parquet(f"{folder}/store")
    return shared


def read_media(shared: DataFrame, folder: str) -> DataFrame:
    """Rebuild every stored object and return its features, one row for each stored row (columns FEATURES)."""
    spark = shared.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = spark.read.schema("bucket long, payload binary, kind string").parquet(f"{folder}/store")
    whole = store.where("kind = 'whole'").select("payload").mapInArrow(_read_whole, FEATURES)
    chunks = store.where("kind = 'shared'").select(F.expr("substring(payload, 1, 16)").alias("digest"), "payload")
    sent = shared.join(chunks, "digest").select("bucket", F.lit(0).alias("kind"), "payload")
    parts = store.where("kind = 'partial'").select("bucket", F.lit(1).alias("kind"), "payload")
    partial = sent.unionByName(parts).repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_read_partial, FEATURES)
    return whole.unionByName(partial)


def media_roundtrip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts in a fresh folder of the shared storage and read them back. An empty table gives an empty result."""
    folder = fresh_path(docs.sparkSession, "media")
    return read_media(store_media(docs, folder, id_col, text_col), folder)
