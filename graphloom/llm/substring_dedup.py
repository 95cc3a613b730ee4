"""Substring dedup by seed and extend over winnowed anchors.

Seed: of every window of min_words words, the smallest hash among its short k-grams is the window's anchor (winnowing), so
two equal windows anywhere have equal anchors. Documents are joined on anchors; only anchors that occur at two places
can start a match.
Extend: each shared anchor is extended to the full windows that it stands for, both ways, and a window whose word
sequence starts earlier in the corpus is a repeat. Runs of repeated windows are the maximal repeats.

Nothing is compared pair by pair: occurrences of an anchor or a window meet under its hash, once for each bucket of
documents, and only the earliest is remembered. Anchors only propose; a window is told by a 128-bit name under a key that
is drawn for the run, so that different windows do not pass for equal. Documents travel in compressed packs by bucket, twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.storage import bound_batches, bucket_count, free_name, with_row_id

U = np.uint64
TOP = U(2**64 - 1)
#: Marks a window that repeats within its own bucket only.
HERE = -(2**63)
CHUNK = 1 << 21
#: Bytes of texts that are packed at once.
PACK = 1 << 23
#: Input bytes for each bucket of documents, which one task holds at a time.
BUCKET_BYTES = 3 << 20


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i:i + width]."""
    if len(x) < width:
        return x[:0]
    step = 1
    while step * 2 <= width:
        x = pick(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _inside(offsets: np.ndarray, count: int, length: int) -> np.ndarray:
    """Which of count window starts lie, with their window, within one document."""
    inside = np.ones(count, bool)
    for b in offsets[1:-1]:
        inside[max(b - length + 1, 0) : b] = False
    return inside


def window_names(words: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the windows that start at these places, in two halves."""
    return K.gram_hashes(words, length)[at], K.gram_hashes(K.mix(words ^ U(0x5851F42D4C957F2D)), length)[at]


def _windows(words: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-gram hashes, the anchor of each window by its start, and which starts lie within one document."""
    grams = K.gram_hashes(words, k)
    low = _sliding(grams, length - k + 1, np.minimum)
    return grams, low, _inside(offsets, len(low), length)


def anchor_hashes(words: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected anchors (hash, word position): the k-grams that are smallest in some window."""
    grams, low, inside = _windows(words, offsets, length, k)
    width = length - k + 1
    held = np.concatenate((np.zeros(width - 1, U), np.where(inside, low, U(0)), np.zeros(width - 1, U)))
    best = _sliding(held, width, np.maximum)[: len(grams)]
    at = np.flatnonzero((best == grams[: len(best)]) & (best > 0))
    return grams[at], at


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array; a bit table by low bits settles most of them."""
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    size = 1 << int(np.ceil(np.log2(len(ordered) * 16 + 1024)))
    table = np.zeros(size, bool)
    table[ordered & U(size - 1)] = True
    out = table[values & U(size - 1)]
    at = np.flatnonzero(out)
    places = np.minimum(np.searchsorted(ordered, values[at]), len(ordered) - 1)
    out[at] = ordered[places] == values[at]
    return out


def _send(kind_rows: list, hashes: np.ndarray, bucket: np.ndarray, extras: list[np.ndarray], parts: int) -> None:
    """Append one row for each part of the hash space: runs of hashes by bucket of origin, and what goes with each hash."""
    part = (hashes % U(parts)).astype(np.int64)
    order = np.lexsort((bucket, part))
    hashes, bucket, part = hashes[order], bucket[order], part[order]
    extras = [x[order].astype(np.int64) for x in extras]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        names, runs = np.unique(bucket[a:b], return_counts=True)
        body = np.int64(len(names)).tobytes() + names.astype(np.int64).tobytes() + runs.astype(np.int64).tobytes() + hashes[a:b].tobytes()
        kind_rows.append((int(part[a]), body + b"".join(x[a:b].tobytes() for x in extras)))


def _received(payload: bytes, extras: int) -> tuple[np.ndarray, ...]:
    """Hashes, their buckets, and what goes with each."""
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    names, runs = np.frombuffer(payload, np.int64, n, 8), np.frombuffer(payload, np.int64, n, 8 + 8 * n)
    total = int(runs.sum())
    at = 8 + 16 * n
    return np.frombuffer(payload, U, total, at), np.repeat(names, runs), *(np.frombuffer(payload, np.int64, total, at + 8 * total * (i + 1)) for i in range(extras))


def _rows(rows: list, names: tuple[str, str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], list(names))


def _seed(length: int, k: int, parts: int, key: int):
    """(bucket, text) to the anchors of its documents, at most twice for each bucket and chunk."""

    def run(batches):
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            for a, b, texts in K.text_blocks(batch.column(1), CHUNK):
                words, offsets = K.hash_words(texts, key)
                hashes, at = anchor_hashes(words, offsets, length, k)
                if not len(hashes):
                    continue
                home = buckets[a:b][np.searchsorted(offsets, at, "right") - 1].astype(np.int64)
                order = np.lexsort((home, hashes))
                hashes, home = hashes[order], home[order]
                same = (hashes[1:] == hashes[:-1]) & (home[1:] == home[:-1])
                third = np.concatenate(([False, False], same[1:] & same[:-1]))[: len(hashes)]
                rows: list = []
                _send(rows, hashes[~third], home[~third], [], parts)
                yield _rows(rows, ("part", "payload"))

    return run


def _gather(batches, extras: int):
    got = [_received(p, extras) for batch in batches for p in batch.column(1).to_pylist()]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else None


def _shared_anchors(batches):
    """Anchors that occur twice or more, told to every bucket that has one."""
    got = _gather(batches, 0)
    if got is None:
        return
    hashes, home = got
    order = np.argsort(hashes, kind="stable")
    hashes, home = hashes[order], home[order]
    twin = hashes[1:] == hashes[:-1]
    keep = np.concatenate((twin, [False])) | np.concatenate(([False], twin))
    yield from _answers(home[keep], hashes[keep])


def _answers(home: np.ndarray, *columns: np.ndarray) -> Iterator:
    """A row for each bucket: its entries, column by column."""
    order = np.argsort(home, kind="stable")
    home, columns = home[order], [c[order] for c in columns]
    names, first = np.unique(home, return_index=True)
    first = np.append(first, len(home)).tolist()
    rows = [(int(name), b"".join(c[a:b].tobytes() for c in columns)) for name, a, b in zip(names, first, first[1:], strict=False)]
    if rows:
        yield _rows(rows, ("bucket", "payload"))


def pack_documents(batches):
    """(bucket, row_id, doc_id, text) rows to compressed packs, one for each bucket and block of texts."""
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        bucket, places, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        void = np.array(ids.is_null())
        ids = ids.fill_null(0).to_numpy()
        for a, b, texts in K.text_blocks(batch.column(3), PACK):
            order = np.argsort(bucket[a:b], kind="stable")
            names, first = np.unique(bucket[a:b][order], return_index=True)
            first, out = np.append(first, len(order)), []
            for i in range(len(names)):
                own = order[first[i] : first[i + 1]]
                mine, rows = [texts[j] for j in own], own + a
                head = np.int64(len(own)).tobytes() + places[rows].astype(np.int64).tobytes() + ids[rows].astype(np.int64).tobytes() + void[rows].tobytes() + np.array([len(t) for t in mine], np.int64).tobytes()
                out.append(squeeze.compress(head + b"".join(mine)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["bucket", "payload"])


def unpack_documents(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Row ids, ids, which of these are null, and texts of a pack."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    places, ids, void = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), np.frombuffer(raw, bool, n, 8 + 16 * n)
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 17 * n)))) + 8 + 25 * n
    return places, ids, void, [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def by_bucket(work):
    """Stream rows (bucket, kind, payload) sorted by both: work(bucket, answers, packs) for each bucket that has documents."""

    def run(batches):
        name, answers, packs = None, [], []
        for batch in batches:
            for b, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != name:
                    if packs:
                        yield from work(name, answers, packs)
                    name, answers, packs = b, [], []
                (answers if kind == 0 else packs).append(payload)
        if packs:
            yield from work(name, answers, packs)

    return run


def _documents(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """All documents of a bucket in order of their row ids."""
    got = [unpack_documents(p) for p in packs]
    places, ids, void = (np.concatenate([p[i] for p in got]) for i in range(3))
    texts = [t for p in got for t in p[3]]
    order = np.argsort(places, kind="stable")
    return places[order], ids[order], void[order], [texts[i] for i in order]


def _extend(length: int, k: int, parts: int, key: int):
    """Extend the bucket's shared anchors to windows; send each window's first document, answer its repeats at home."""

    def work(bucket, answers, packs):
        if not answers:
            return
        shared = np.unique(np.frombuffer(b"".join(answers), U))
        places, _, _, texts = _documents(packs)
        words, offsets = K.hash_words(texts, key)
        _, low, inside = _windows(words, offsets, length, k)
        at = np.flatnonzero(inside)
        at = at[member(low[at], shared)]
        if not len(at):
            return
        name, check = window_names(words, length, at)
        order = np.lexsort((check, name))
        name, check, at = name[order], check[order], at[order]
        lead = np.concatenate(([True], (name[1:] != name[:-1]) | (check[1:] != check[:-1])))
        rows: list = []
        again = np.flatnonzero(~lead)
        if len(again):
            again = again[lead[again - 1]]
            rows.append((-1 - int(bucket), name[again].tobytes() + check[again].tobytes()))
        owner = places[np.searchsorted(offsets, at[lead], "right") - 1]
        _send(rows, name[lead], np.full(int(lead.sum()), bucket), [check[lead].view(np.int64), owner], parts)
        yield _rows(rows, ("part", "payload"))

    return by_bucket(work)


def _earlier_windows(batches):
    """Windows that start earlier in another bucket, with the earliest document, told to all buckets but the first."""
    import pyarrow as pa

    mine = []

    def others():
        for batch in batches:
            keep = batch.column(0).to_numpy() >= 0
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part < 0:
                    mine.append((-1 - part, payload + np.full(len(payload) // 16, HERE, np.int64).tobytes()))
            yield batch.filter(pa.array(keep))

    got = _gather(others(), 2)
    if mine:
        yield _rows(mine, ("bucket", "payload"))
    if got is None:
        return
    name, home, check, doc = got
    order = np.lexsort((home, doc, check, name))
    name, home, check, doc = name[order], home[order], check[order], doc[order]
    lead = np.concatenate(([True], (name[1:] != name[:-1]) | (check[1:] != check[:-1])))
    first = doc[np.maximum.accumulate(np.where(lead, np.arange(len(doc)), 0))]
    yield from _answers(home[~lead], name[~lead], check[~lead], first[~lead])


def find_pairs(name: np.ndarray, check: np.ndarray, names: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Place of each (name, check) among entries sorted by both, or -1."""
    at = np.searchsorted(names, name)
    out, todo = np.full(len(name), -1, np.int64), np.arange(len(name))
    while len(todo):
        todo = todo[at[todo] < len(names)]
        todo = todo[names[at[todo]] == name[todo]]
        hit = checks[at[todo]] == check[todo]
        out[todo[hit]] = at[todo[hit]]
        todo = todo[~hit]
        at[todo] += 1
    return out


def _cut(length: int, key: int):
    """Mark the repeated windows of a bucket and drop the words that they cover."""
    import pyarrow as pa

    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("source", pa.int64())]))

    def work(_, answers, packs):
        places, ids, void, texts = _documents(packs)
        sizes = [len(t) for t in texts]
        words, offsets = K.hash_words(texts, key)
        covered, repeats = np.zeros(len(words), bool), {}
        if answers and len(words) >= length:
            third = [len(a) // 24 for a in answers]
            names, checks, source = (np.concatenate([np.frombuffer(a, kind, n, 8 * n * i) for a, n in zip(answers, third, strict=True)]) for i, kind in enumerate((U, U, np.int64)))
            order = np.lexsort((~source, checks, names))  # another bucket's document before HERE
            names, checks, source = names[order], checks[order], source[order]
            fresh = np.concatenate(([True], (names[1:] != names[:-1]) | (checks[1:] != checks[:-1])))
            names, checks, source = names[fresh], checks[fresh], source[fresh]
            full = K.gram_hashes(words, length)
            at = np.flatnonzero(_inside(offsets, len(full), length))
            at = at[member(full[at], names)]
            found, check = window_names(words, length, at)
            which = find_pairs(found, check, names, checks)
            at, which = at[which >= 0], which[which >= 0]
            origin = source[which]
            order = np.lexsort((at, which))
            lead = np.concatenate(([True], which[order][1:] != which[order][:-1]))[: len(order)]
            head = np.zeros(len(at), bool)
            head[order] = lead
            own = places[np.searchsorted(offsets, at, "right") - 1]
            first_own = np.empty(len(at), np.int64)
            first_own[order] = own[order][np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))] if len(at) else own
            # the earliest is another bucket's document, or the first occurrence here
            keep = ~head | (origin != HERE)
            origin = np.where((origin == HERE) | (first_own < origin), first_own, origin)
            at, origin = at[keep], origin[keep]
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + length, -1)
            covered = np.cumsum(marks)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
            for a in edge[::2]:
                stop = int(edge[1::2][np.searchsorted(edge[1::2], a, "right")])
                inner = [int(a), *(int(c) for c in offsets[(offsets > a) & (offsets < stop)]), stop]
                for x, y in zip(inner, inner[1:], strict=False):
                    if x < y:
                        d = int(np.searchsorted(offsets, x, "right")) - 1
                        repeats.setdefault(d, []).append({"first": x - int(offsets[d]), "last": y - int(offsets[d]) - 1, "source": int(origin[np.searchsorted(at, x)])})
        counts = np.diff(offsets)
        removed = np.add.reduceat(np.append(covered, False).astype(np.int64), offsets[:-1]) if len(texts) else counts
        removed = np.where(counts > 0, removed, 0)
        for a, b in K.blocks(sizes, CHUNK):
            kept = [b" ".join(compress(texts[i].split(), (~covered[offsets[i] : offsets[i + 1]]).tolist()) if removed[i] else texts[i].split()) for i in range(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], mask=void[a:b]), pa.array(counts[a:b], pa.int64()), pa.array(removed[a:b], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([repeats.get(i, []) for i in range(a, b)], spans), pa.array(places[a:b])], ["doc_id", "n_words", "n_removed", "kept_text", "repeats", "row_id"])

    return by_bucket(work)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Remove words covered by a window of min_words words that also starts earlier (smaller id, or same text before).

    Returns one row for each input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space), repeats
    and row_id. row_id is unique and orders the rows: the id itself, or where ids are null or repeat the place of a row in
    order of id (null last) and text. repeats are the maximal removed spans as (first word, last word, row_id of the document
    where its first window occurs first).

    Windows are judged on the input. Null and empty texts have no word and give the empty text. Other columns are ignored,
    so no name can clash. An empty table gives an empty result.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    k = max(1, min_words // 4)
    spark, key = docs.sparkSession, K.fresh_key()
    bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = with_row_id(base, free_name(base, "row_id"))
    buckets = bucket_count(base, BUCKET_BYTES)
    parts = max(buckets // 2, 1)
    # a task holds the messages, or one bucket, of what it receives; it receives a few tens of MB
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    placed = base.select(F.pmod(F.xxhash64("row_id"), F.lit(buckets)).alias("bucket"), "row_id", "doc_id", "text")
    packs = placed.mapInArrow(K.released(pack_documents), "bucket long, payload binary").select("bucket", F.lit(1).alias("kind"), "payload")

    def meet(sent: DataFrame, work) -> DataFrame:
        return sent.repartition(tasks, F.when(F.col("part") >= 0, F.col("part")).otherwise(F.xxhash64("part"))).mapInArrow(K.released(work), "bucket long, payload binary")

    def visit(answers: DataFrame, work, schema: str) -> DataFrame:
        rows = answers.select("bucket", F.lit(0).alias("kind"), "payload").unionByName(packs)
        return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(K.released(work), schema)

    seeds = placed.select("bucket", "text").mapInArrow(K.released(_seed(min_words, k, parts, key)), "part long, payload binary")
    windows = visit(meet(seeds, _shared_anchors), _extend(min_words, k, parts, key), "part long, payload binary")
    return visit(meet(windows, _earlier_windows), _cut(min_words, key), "doc_id long, n_words long, n_removed long, kept_text string, repeats array<struct<first:long,last:long,source:long>>, row_id long")
