"""N-gram Jaccard join: near-duplicate documents by prefix trees over globally ordered n-gram sets.

1. Every text becomes its set of distinct n-word shingles, in one global order (by hash value, under a key drawn for the run).
2. Pigeonhole signatures find candidates without missing any: for set sizes near each other, the universe is cut into
   more parts than two linked sets can differ in, so linked sets agree on a whole non-empty part. Documents that
   share a part's signature are joined to the smallest of them: a star, never all pairs. Very frequent shingles (a bounded
   list, by counts over all documents) stay out of the parts, so that a common passage does not join what holds it.
3. Each connected group of candidates is cut into blocks of bounded size. In a block the sets go into a prefix tree
   (rare tokens of the block first) whose branches share tokens; a probing set enters it by the tokens of its prefix, walks it carrying partial overlaps and leaves a branch when the
   remaining lengths cannot reach the threshold, or when all below is already in its own component.
4. Blocks of one group first compare representatives; only components that stay apart are compared block by block.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernels as K
from graphloom.llm.components import connected_components
from graphloom.llm.id_bits import flag_listed
from graphloom.llm.substring_dedup import member
from graphloom.storage import bound_batches, bucket_count, materialize

U = np.uint64
CHUNK = 1 << 20
#: Signatures that a task gathers before it deals them to buckets (8 MB with their documents): dealt by the chunk, each bucket would get
#: ever smaller shreds as buckets grow in number.
RUN = 1 << 19
#: Shingles that one block of a candidate group may hold: 8 MB.
BLOCK_TOKENS = 1 << 20
#: At most so many frequent shingles (2 MB) are set aside when parts are formed; which ones, decides speed alone.
HOT_TOKENS, HOT_TIMES = 1 << 18, 8


def shingle_sets(texts: list[bytes], n: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and offsets; fewer than n words make one shingle."""
    words, offsets = K.hash_words(texts, key, fold_case=True)
    grams = K.gram_hashes(words, n)
    counts = np.diff(offsets)
    sizes = np.maximum(counts - n + 1, 0)
    sizes[(counts > 0) & (counts < n)] = 1
    out, bounds = np.empty(int(sizes.sum()), U), np.concatenate(([0], np.cumsum(sizes)))
    for i in np.flatnonzero(sizes):
        a, b, w = bounds[i], bounds[i + 1], offsets[i]
        if counts[i] >= n:
            part = out[a:b]
            part[:] = grams[w : w + b - a]
            part.sort()
        else:
            out[a] = K.gram_hashes(words[w : offsets[i + 1]], int(counts[i]))[0] ^ U(counts[i])
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][sizes > 0]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


class Partitions:
    """Part counts by size class. Linked sets lie in one class or in adjacent ones, and share the lower one's scheme."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]

    def classes(self, sizes: np.ndarray) -> np.ndarray:
        while self.starts[-1] <= int(sizes.max(initial=1)):
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return np.searchsorted(self.starts, sizes, "right") - 1

    def differences(self, k: int) -> int:
        """Most tokens in which linked sets can differ when the smaller one is of class k."""
        while len(self.starts) <= k + 1:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return (self.den - self.num) * (self.starts[k + 1] - 1) // self.num

    def layout(self, sizes: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scheme of each set, the tokens in which it can differ from a linked set at most, and the parts that the scheme has.

        Linked sets differ in at most (den - num) / num times the smaller one's size, so neither side differs in more than that
        share of its own. The parts are those of the scheme, for both sides alike.
        """
        k = self.classes(sizes) - shift
        most = np.array([self.differences(x) if x >= 0 else 0 for x in range(-1, int(k.max(initial=0)) + 1)], np.int64)[k + 1]
        parts = np.where(most > 0, (most + 1) * 5 // 4 + 4, 0)
        return k, np.minimum(most, (self.den - self.num) * sizes // self.num), parts

    def _parts(self, sets: np.ndarray, owner: np.ndarray, k: np.ndarray, most: np.ndarray, parts: np.ndarray, salt: int):
        """Parts of the sets' tokens: (number, set, tokens, signature, where its tokens begin), and the places of those that a
        set gives: as many as it can differ in and one more, of most tokens first, ties by signature."""
        h = sets >> U(32)
        part = (h * parts[owner].astype(U)) >> U(32)
        first = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1]))))
        o, part, runs = owner[first], part[first], np.diff(np.append(first, len(sets)))
        sums = np.add.reduceat(K.mix(sets ^ U(0xA5A5A5A5 + salt)), first)
        sig = K.mix(sums + K.mix(part + (k[o].astype(U) << U(32))))
        best = np.lexsort((sig, -runs, o))  # sets stay in place
        filled = np.bincount(o, minlength=len(k))
        return part, o, runs, sig, first, best[np.arange(len(o)) - (np.cumsum(filled) - filled)[o] <= most[o]]

    def small_parts(self, sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens that stand in given parts of one or two: where such a token is frequent, parts say little about likeness."""
        owner = K.span_owner(bounds)
        k, most, parts = self.layout(np.diff(bounds), 0)
        use = parts[owner] > 0
        if not use.any():
            return sets[:0]
        tokens = sets[use]
        _, _, runs, _, first, given = self._parts(tokens, owner[use], k, most, parts, 0)
        given = given[runs[given] <= 2]
        return tokens[K.ragged(first[given], runs[given])]

    def signatures(self, sets: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, index of the set) for the schemes of each set's own class and the one below.

        Parts are formed of the tokens outside hot: linked sets differ there in no more tokens than over all. Of its parts a set
        gives as many as linked sets can differ in, and one more. One of these a linked set has as it is; and since what is in
        the parts says which come first, one of two linked sets gives all that both have and the other gives. A set that has
        too few parts for the pigeonhole gives them all, also the parts of all its tokens, and then those it leaves empty.
        """
        sizes = np.diff(bounds)
        owner, outs = K.span_owner(bounds), []
        cool = ~member(sets, hot)
        for shift in (0, 1):
            k, most, parts = self.layout(sizes, shift)
            short = parts > 0
            for tier, pick in ((0, cool), (1, None)):
                use = short[owner] if pick is None else short[owner] & pick
                if use.any():
                    part, o, _, sig, _, given = self._parts(sets[use], owner[use], k, most, parts, tier)
                    outs.append((sig[given], o[given]))
                    filled = np.bincount(o, minlength=len(sizes))
                else:
                    o, part, filled = np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(sizes), np.int64)
                short = short & (filled <= most)
                if not short.any():
                    break
            for i in np.flatnonzero(short & (sizes > 0)):
                gaps = np.setdiff1d(np.arange(parts[i], dtype=U), part[o == i])
                outs.append((K.mix(K.mix(gaps + (U(int(k[i])) << U(32)))), np.full(len(gaps), i)))
        if not outs:
            return np.zeros(0, U), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*outs, strict=True))


def _keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit name of every set, as two int64 columns."""
    out = np.zeros((len(bounds) - 1, 2), np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for j, salt in enumerate((0x1234567, 0x89ABCDEF)):
            out[full, j] = np.add.reduceat(K.mix(sets ^ U(salt)), bounds[:-1][full]).view(np.int64)
    return out


def _texts(batch) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for a, b, texts in K.text_blocks(batch.column(1), CHUNK):
        yield ids[a:b], texts


def _describe(n: int, key: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, texts in K.text_blocks(batch.column(1), CHUNK):
                sets, bounds = shingle_sets(texts, n, key)
                names = _keys(sets, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(names[:, 0]), pa.array(names[:, 1])], ["doc_id", "n_shingles", "k1", "k2"])

    return run


def _small_parts(n: int, num: int, den: int, key: int):
    def run(batches):
        import pyarrow as pa

        scheme = Partitions(num, den)
        for batch in batches:
            for _, texts in _texts(batch):
                tokens, counts = np.unique(scheme.small_parts(*shingle_sets(texts, n, key)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], ["token", "times"])

    return run


def _edge_batch(a: np.ndarray, b: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])


def _pack_run(docs: np.ndarray, sigs: np.ndarray, squeeze) -> bytes:
    """Signatures of a bucket in order of their documents, so that each is named once. Five bytes of a signature are kept:
    more documents than share one may meet by it, at most."""
    names, runs = np.unique(docs, return_counts=True)
    columns = [np.diff(names.astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8), runs.astype("<u4").view(np.uint8).reshape(-1, 4)]
    head = squeeze(b"".join(c.T.tobytes() for c in columns))
    return struct.pack("<II", len(names), len(head)) + head + np.ascontiguousarray(sigs).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpack_run(payload: bytes, inflate) -> tuple[np.ndarray, np.ndarray]:
    """Documents and what is kept of their signatures."""
    count, size = struct.unpack_from("<II", payload)
    head = np.frombuffer(inflate(payload[8 : 8 + size]), np.uint8)
    names = np.cumsum(np.ascontiguousarray(head[: 8 * count].reshape(8, -1).T).view(np.int64).ravel())
    runs = np.ascontiguousarray(head[8 * count :].reshape(4, -1).T).view("<u4").ravel()
    sigs = np.zeros((int(runs.sum()), 8), np.uint8)
    sigs[:, 3:] = np.frombuffer(payload, np.uint8, -1, 8 + size).reshape(-1, 5)
    return np.repeat(names, runs), sigs.view(U).ravel()


def _sign(n: int, num: int, den: int, buckets: int, hot: np.ndarray, key: int):
    """Signatures by bucket; within a run, sharers are joined to their smallest document at once (bucket -1 rows)."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        squeeze, scheme, held = zstandard.ZstdCompressor(level=1).compress, Partitions(num, den), []

        def flush():
            sig, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = (sig % U(buckets)).astype(np.int64)
            order = np.lexsort((doc, sig, bucket))
            sig, doc, bucket = sig[order], doc[order], bucket[order]
            lead = np.concatenate(([True], sig[1:] != sig[:-1]))[: len(sig)]
            head = np.maximum.accumulate(np.where(lead, np.arange(len(sig)), 0))
            pairs = np.unique(np.stack([doc[head[~lead]], doc[~lead]], 1), axis=0)
            rows = [(-1, pairs.astype(np.int64).tobytes())] if len(pairs) else []
            sig, doc, bucket = sig[lead], doc[lead], bucket[lead]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    by_doc = np.argsort(doc[a:b], kind="stable")
                    rows.append((k, _pack_run(doc[a:b][by_doc], sig[a:b][by_doc], squeeze)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for ids, texts in _texts(batch):
                order = np.argsort(ids, kind="stable")
                ids, texts = ids[order], [texts[i] for i in order]
                sets, bounds = shingle_sets(texts, n, key)
                names = _keys(sets, bounds)
                fresh = np.zeros(len(ids), bool)
                fresh[np.unique(names, axis=0, return_index=True)[1]] = True
                keep = fresh & (np.diff(bounds) > 0)
                sets = sets[np.repeat(keep, np.diff(bounds))]
                bounds = np.concatenate(([0], np.cumsum(np.diff(bounds)[keep])))
                own = ids[keep]
                if len(own):
                    sig, who = scheme.signatures(sets, bounds, hot)
                    held.append((sig, own[who].astype(np.int64)))
                if sum(len(sig) for sig, _ in held) >= RUN:
                    yield flush()
        if held:
            yield flush()

    return run


def _stars(parts: int):
    """All signatures of the task's buckets: whoever shares one is joined to the smallest document that has it.

    A task's stars are merged, and leave as packed pairs by a part of the larger end."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        inflate = zstandard.ZstdDecompressor().decompress
        sigs, docs, found = [], [], []
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket < 0:
                    found.append(np.frombuffer(payload, np.int64).reshape(-1, 2)[:, ::-1])
                    continue
                doc, sig = _unpack_run(payload, inflate)
                docs.append(doc)
                sigs.append(sig)
        if sigs:
            sig, doc = np.concatenate(sigs), np.concatenate(docs)
            del sigs, docs
            order = np.argsort(sig, kind="stable")
            sig, doc = sig[order], doc[order]
            del order
            start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            low = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(sig))))
            del sig, start
            pick = low != doc
            found.append(np.stack([doc[pick], low[pick]], 1))
            del doc, low, pick
        pairs = _contract(found)
        if len(pairs):
            part = (K.mix(pairs[:, 0].astype(U)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            names, first = np.unique(part[order], return_index=True)
            blobs = [pairs[own].tobytes() for own in np.split(order, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["part", "payload"])

    return run


def _contract(found: list[np.ndarray]) -> np.ndarray:
    """(member, root) pairs that connect what the given pairs connect: one for each member that is no root. Roots are the smallest."""
    if not found:
        return np.zeros((0, 2), np.int64)
    names, ends = np.unique(np.concatenate(found), return_inverse=True)
    ends = ends.reshape(-1, 2).astype(np.int32 if len(names) < 1 << 31 else np.int64)
    x, y = ends[:, 0], ends[:, 1]
    root = np.arange(len(names), dtype=ends.dtype)
    while len(x):  # roots go below the smallest root that they meet, until none meet
        u, v = root[x], root[y]
        apart = u != v
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(above := root[root], root):
            root = above
    member = np.flatnonzero(root != np.arange(len(names)))
    return np.stack([names[member], names[root[member]]], 1)


def _merge(batches):
    """Packed pairs of one part of the documents to edges: each document to the smallest it was joined to, and those to it."""
    blobs = [np.frombuffer(p, np.int64).reshape(-1, 2) for batch in batches for p in batch.column(1).to_pylist()]
    edges = _contract(blobs)
    if len(edges):
        yield _edge_batch(edges[:, 0], edges[:, 1])


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x


class _Node:
    __slots__ = ("below", "ends", "least", "member", "mixed", "most", "tokens")

    def __init__(self, tokens, member, size):
        self.tokens, self.below, self.ends = tokens, {}, []
        self.member, self.mixed, self.least, self.most = member, False, size, size


class PrefixTree:
    """Path-compressed trie of ascending token arrays. Linked: den * overlap >= num * union."""

    def __init__(self, num: int, den: int, forest: Forest):
        self.num, self.den, self.forest, self.roots, self.entries = num, den, forest, {}, {}

    def prefix(self, tokens: np.ndarray) -> list[int]:
        """Linked sets share a token among the first of each: as many as one can lack, and one more."""
        return tokens[: len(tokens) - -(-self.num * len(tokens) // self.den) + 1].tolist()

    def insert(self, name: int, tokens: np.ndarray) -> None:
        for token in self.prefix(tokens):
            self.entries.setdefault(token, set()).add(int(tokens[0]))
        level, at, size = self.roots, 0, len(tokens)
        while True:
            node = level.get(int(tokens[at]))
            if node is None:
                level[int(tokens[at])] = node = _Node(tokens[at:], name, size)
                node.ends.append((name, size))
                return
            shared = min(len(node.tokens), size - at)
            differs = node.tokens[:shared] != tokens[at : at + shared]
            shared = int(differs.argmax()) if differs.any() else shared
            if shared < len(node.tokens):  # split: the rest of the run moves below
                rest = _Node(node.tokens[shared:], node.member, 0)
                rest.below, rest.ends, rest.least, rest.most, rest.mixed = node.below, node.ends, node.least, node.most, node.mixed
                node.tokens, node.below, node.ends = node.tokens[:shared], {int(rest.tokens[0]): rest}, []
            node.least, node.most = min(node.least, size), max(node.most, size)
            node.mixed = node.mixed or self.forest.find(node.member) != self.forest.find(name)
            at += shared
            if at == size:
                node.ends.append((name, size))
                return
            level = node.below

    def probe(self, name: int, tokens: np.ndarray) -> Iterator[int]:
        """Sets linked with tokens that are not in name's component yet; the caller joins them as they come."""
        num, den, size, find = self.num, self.den, len(tokens), self.forest.find
        entries = set().union(*(self.entries.get(token, ()) for token in self.prefix(tokens)))
        todo = [(self.roots[first], 0, 0, 0) for first in entries]
        while todo:
            node, at, depth, overlap = todo.pop()
            if node.least * num > size * den or size * num > node.most * den or not node.mixed and find(node.member) == find(name):
                continue
            places = np.searchsorted(tokens[at:], node.tokens)
            inside = places < size - at
            overlap += int((tokens[at:][places[inside]] == node.tokens[inside]).sum())
            at += int(np.searchsorted(tokens[at:], node.tokens[-1], "right"))
            depth += len(node.tokens)
            # linked sets of sizes x, y overlap in at least num * (x + y) / (num + den)
            if (overlap + min(size - at, node.most - depth)) * (num + den) < num * (size + node.least):
                continue
            for other, length in node.ends:
                if overlap * (num + den) >= num * (size + length) and find(other) != find(name):
                    yield other
            todo.extend((below, at, depth, overlap) for below in node.below.values())


def _rare_first(*sides: list) -> list[list]:
    """Rename tokens by (frequency in the block, hash) and order each set so."""
    arrays = [tokens for side in sides for _, tokens in side]
    if not arrays:
        return list(sides)
    tokens, back, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(tokens))
    ranks = iter(np.split(rank[back], np.cumsum([len(a) for a in arrays])[:-1]))
    return [[(name, np.sort(next(ranks))) for name, _ in side] for side in sides]


def link_block(stored: list, probing: list, known: dict, num: int, den: int, among: bool) -> list[tuple[int, int]]:
    """Edges (member, root) that join what is linked between stored and probing, or within stored if among."""
    forest = Forest()
    for name, root in known.items():
        forest.join(name, root)
    before = {name: forest.find(name) for name, _ in (*stored, *probing)}
    tree = PrefixTree(num, den, forest)
    stored, probing = _rare_first(stored, probing)
    for name, tokens in stored:
        if among:
            for other in tree.probe(name, tokens):
                forest.join(name, other)
        tree.insert(name, tokens)
    for name, tokens in probing:
        for other in tree.probe(name, tokens):
            forest.join(name, other)
    return [(name, root) for name in before if (root := forest.find(name)) != before[name]]


def _linker(num: int, den: int):
    """Rows (task, side, doc_id, component, tokens) sorted by task: one prefix tree for each task."""

    def run(batches):
        task, sides, known = None, ([], []), {}

        def close():
            edges = link_block(*sides, known, num, den, among=not sides[1])
            if edges:
                yield _edge_batch(*map(np.array, zip(*edges, strict=True)))

        for batch in batches:
            for t, side, doc, component, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != task:
                    if task is not None:
                        yield from close()
                    task, sides, known = t, ([], []), {}
                sides[side].append((doc, np.frombuffer(tokens, U)))
                if component is not None:
                    known[doc] = component
        if task is not None:
            yield from close()

    return run


def _link(rows: DataFrame, num: int, den: int, tasks: int) -> DataFrame:
    rows = rows.select("task", "side", "doc_id", "component", "tokens")
    return rows.repartition(tasks, "task").sortWithinPartitions("task", "side", F.length("tokens"), "doc_id").mapInArrow(K.released(_linker(num, den)), "a long, b long")


def _tokens(n: int, key: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            for a, b, texts in K.text_blocks(batch.column(1), CHUNK):
                sets, bounds = shingle_sets(texts, n, key)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(c.slice(a, b - a) for c in rest), pa.array([sets[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary())], ["doc_id", "grp", "block", "blocks", "tokens"])

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (80, 100), block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Near-duplicate classes: (doc_id, n_shingles, component_id, is_representative), one row for each input row.

    Two documents link when den * |A & B| >= num * |A | B| over their sets of distinct n-word shingles (A-Z lower-cased;
    fewer words: the whole sequence is one shingle). component_id is the smallest id reachable by links. Links follow
    exactly from the sets; no bucket, group or partner count is capped.

    Null, empty and blank texts have no shingle, link with nothing and are their own component. Rows with a null id are
    returned with a null component and take no part. Rows that share an id count as one document for links. Other columns,
    whatever their names, are ignored. An empty table gives an empty result.
    """
    num, den = threshold
    spark, key = docs.sparkSession, K.fresh_key()
    bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(base, 2 << 20)
    label = f"jaccard-{uuid.uuid4().hex[:8]}"
    known = base.where("doc_id is not null")
    sets = materialize(base.mapInArrow(K.released(_describe(n, key)), "doc_id long, n_shingles long, k1 long, k2 long"), label)
    firsts = sets.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    small = known.mapInArrow(K.released(_small_parts(n, num, den, key)), "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    small = small.where(F.col("times") >= HOT_TIMES).orderBy(F.desc("times"), "token").limit(HOT_TOKENS)
    hot = np.sort(small.select("token").toPandas()["token"].to_numpy(np.int64).view(U))
    signed = known.mapInArrow(K.released(_sign(n, num, den, buckets, hot, key)), "bucket int, payload binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = max(tasks, buckets // 2)  # tasks of the prefix trees, each of which writes a file
    met = signed.repartition(buckets, F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.xxhash64("payload"))).mapInArrow(K.released(_stars(tasks)), "part int, payload binary")
    stars = met.repartition(tasks, "part").mapInArrow(K.released(_merge), "a long, b long")
    groups = materialize(connected_components(stars, f"{label}-candidates"), f"{label}-groups")
    # equal sets are one member of their group: the smallest document
    members = groups.join(firsts.select(F.col("rep").alias("id"), "n"), "id")
    weights = members.groupBy("component").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = members.join(weights, "component").select(F.col("id").alias("doc_id"), F.col("component").alias("grp"), F.ceil(F.col("total") / block_tokens).cast("long").alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    members = materialize(members, f"{label}-members")
    rows = flag_listed(known, members, "doc_id", "listed").where("listed").join(members, "doc_id").select("doc_id", "text", "grp", "block", "blocks").mapInArrow(K.released(_tokens(n, key)), "doc_id long, grp long, block long, blocks long, tokens binary")
    task = F.xxhash64("grp", "block")
    local = materialize(_link(rows.withColumns({"task": task, "side": F.lit(0), "component": F.lit(None).cast("long")}), num, den, links), f"{label}-local")
    found = local
    if members.where("blocks > 1").limit(1).count():
        found = _across_blocks(rows.where("blocks > 1"), local, num, den, links, label)
    linked = connected_components(found, f"{label}-links")
    reps = firsts.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(reps, ["k1", "k2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("is_representative", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across_blocks(rows: DataFrame, local: DataFrame, num: int, den: int, buckets: int, label: str) -> DataFrame:
    """Groups of several blocks: representatives against all blocks, then what is still apart, block against block."""
    rows = materialize(rows, f"{label}-blocks")
    spread = rows.select("grp", "blocks").distinct().withColumn("target", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", F.col("target").cast("long"))

    def labelled(edges):
        roots = connected_components(edges, f"{label}-round").withColumnRenamed("id", "doc_id")
        return materialize(rows.join(roots, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), f"{label}-labelled")

    state = labelled(local)
    first = state.groupBy("grp", "block", "component").agg(F.min_by(F.struct("doc_id", "tokens"), "doc_id").alias("x")).select("grp", "component", "x.*", "block")
    queries = first.join(spread, "grp").where("target <> block").select(F.xxhash64("grp", "target").alias("task"), F.lit(1).alias("side"), "doc_id", "component", "tokens")
    stored = state.select(F.xxhash64("grp", "block").alias("task"), F.lit(0).alias("side"), "doc_id", "component", "tokens")
    found = materialize(local.unionByName(_link(stored.unionByName(queries), num, den, buckets)), f"{label}-reps")
    state = labelled(found)
    apart = state.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("grp")
    state = state.join(apart, "grp", "left_semi")
    # the largest component of a group stays where it is; members of all others go to every block, in blocks of their own
    sizes = state.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("grp").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    others = state.join(main, "grp").where("component <> main").join(spread, "grp")
    queries = others.select("grp", "target", "block", F.lit(1).alias("side"), "doc_id", "component", "tokens")
    wanted = queries.select("grp", "target", "block").distinct()
    stored = state.withColumnRenamed("block", "target").join(wanted, ["grp", "target"]).select("grp", "target", "block", F.lit(0).alias("side"), "doc_id", "component", "tokens")
    both = stored.unionByName(queries).withColumn("task", F.xxhash64("grp", "target", "block"))
    return materialize(found.unionByName(_link(both, num, den, buckets)), f"{label}-all")
