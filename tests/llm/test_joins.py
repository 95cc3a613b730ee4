"""op2 and op3 against brute force."""

import collections
import re

import numpy as np
import pytest

from graphloom.llm import ngram_jaccard as J
from graphloom.llm import substring_dedup as S
from graphloom.llm.components import connected_components

from .fixtures import SCHEMA, corpus, frame, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def jaccard_classes(rows, n, num, den):
    sets = {}
    for doc, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "threshold", "block"), [(4, (85, 100), 1 << 20), (2, (60, 100), 1 << 20), (2, (60, 100), 300)])
def test_jaccard_matches_brute_force(spark, n, threshold, block):
    rows = corpus()
    out = J.ngram_jaccard_join(with_clashes(frame(spark)), n=n, threshold=threshold, block_tokens=block).collect()
    assert len(out) == len(rows)
    want = jaccard_classes([(r[0], r[1]) for r in rows], n, *threshold)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_jaccard_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e", None, None, None), (1, "a b c d e", None, None, None), (2, "a b c d e", None, None, None), (2, "a b c d e", None, None, None)]
    out = J.ngram_jaccard_join(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0) for r in out) == [(False, 1, 1), (False, 2, 1), (False, 2, 1), (True, 0, 0)]
    assert J.ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signatures_miss_no_linked_pair():
    rng = np.random.default_rng(5)
    for num, den in ((85, 100), (60, 100)):
        for _ in range(60):
            size = int(rng.integers(3, 200))
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop = rng.random(len(a)) < rng.random() * 0.2
            b = np.unique(np.concatenate([a[~drop], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 8))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or den * both < num * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            bounds = np.array([0, len(a), len(a) + len(b)])
            hot = np.sort(rng.choice(a, len(a) // int(rng.integers(1, 4)), replace=False))
            sig, who = J.Partitions(num, den).signatures(np.concatenate([a, b]), bounds, hot)
            assert set(sig[who == 0]) & set(sig[who == 1])


def test_sets_that_share_a_few_tokens_do_not_meet():
    rng, met = np.random.default_rng(11), 0
    for _ in range(300):
        common = rng.integers(0, 2**64, 40, np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 2**64, 400, np.uint64)])) for _ in range(2)]
        bounds = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        sig, who = J.Partitions(80, 100).signatures(np.concatenate(sets), bounds, np.zeros(0, np.uint64))
        met += bool(set(sig[who == 0]) & set(sig[who == 1]))
        assert len(sig) <= 2 * sum(len(s) // 4 + 1 for s in sets)
    assert met <= 10  # chance lets a few meet


def test_a_bucket_gets_the_signatures_of_many_chunks_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(J, "CHUNK", 2000)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 100)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([(i + 1) << 33 for i in range(60)]), pa.array(texts)], ["doc_id", "text"])
    rows = [r for b in J._sign(5, 80, 100, 16, np.zeros(0, np.uint64), 1)(iter([batch])) for r in b["bucket"].to_pylist()]
    assert sorted(rows) == list(range(16))


def test_contracted_pairs_connect_the_same():
    rng = np.random.default_rng(6)
    for most in (40, 400, 4000):
        pairs = rng.integers(-most, most, (300, 2)) * (1 << 40)
        forest = J.Forest()
        for x, y in pairs.tolist():
            forest.join(x, y)
        want = {(x, forest.find(x)) for x in pairs.ravel().tolist() if forest.find(x) != x}
        got = J._contract([pairs[:100], pairs[100:]])
        assert got.dtype == np.int64 and len(got) == len(want) and {tuple(r) for r in got.tolist()} == want


def test_long_texts_go_to_workers_in_bounded_batches(spark):
    import pyarrow as pa

    from graphloom.storage import BATCH_BYTES

    J.ngram_jaccard_join(frame(spark, [(1, "a b c d e", None, None, None)]))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    rows = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('word ', 2000) as text").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 3000 and max(r.size for r in rows) < BATCH_BYTES + (1 << 16)


def test_packed_signatures_come_back():
    import zstandard

    rng = np.random.default_rng(4)
    docs = np.sort(rng.integers(-(2**62), 2**62, 50))[rng.integers(0, 50, 400)]
    docs.sort()
    sigs = rng.integers(0, 2**63, 400).astype(np.uint64)
    got = J._unpack_run(J._pack_run(docs, sigs, zstandard.ZstdCompressor(level=1).compress), zstandard.ZstdDecompressor().decompress)
    assert np.array_equal(got[0], docs) and np.array_equal(got[1] >> np.uint64(24), sigs >> np.uint64(24))


def test_components(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (9, 9), (20, 21), (None, 4), (21, 22), (22, 23), (23, 24)], "a long, b long")
    assert {(r.id, r.component) for r in connected_components(edges, "t").collect()} == {(3, 3), (5, 3), (9, 3), *((i, 20) for i in range(20, 25))}


def cut(rows, length):
    seen, out = set(), collections.defaultdict(list)
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        out[doc].append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [20, 5, 2])
def test_substring_matches_brute_force(spark, length):
    rows = [*corpus(), (7, "same id " * 20, None, None, None), (None, "no id at all " * 9, None, None, None)]
    out = collections.defaultdict(list)
    for r in S.substring_dedup(with_clashes(frame(spark, rows)), min_words=length).collect():
        out[r.doc_id].append((r.n_words, r.n_removed, r.kept_text))
        assert sum(s["last"] - s["first"] + 1 for s in r.repeats) == r.n_removed
    want = cut([(r[0], r[1]) for r in rows], length)
    assert {k: sorted(v) for k, v in out.items()} == {k: sorted(v) for k, v in want.items()}


def test_substring_empty_table_and_long_word(spark):
    assert S.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "x" * 3_000_000
    out = S.substring_dedup(frame(spark, [(1, long, None, None, None), (2, f"{long} y", None, None, None)]), min_words=2).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in out) == [(1, 1, 0), (2, 2, 0)]


def two_alike(size=2048):
    """Two words that polynomial hashes modulo a power of two cannot tell apart (the Thue-Morse word and its complement)."""
    bits = [0]
    while len(bits) < size:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_alike_to_polynomials_stay_apart(spark):
    one, other = two_alike()
    same = " ".join(f"w{i}" for i in range(19))
    out = S.substring_dedup(frame(spark, [(1, f"{same} {one}", None, None, None), (2, f"{same} {other}", None, None, None)]), min_words=20).collect()
    assert {r.doc_id: r.n_removed for r in out} == {1: 0, 2: 0}
    out = J.ngram_jaccard_join(frame(spark, [(1, f"{one} x y z", None, None, None), (2, f"{other} x y z", None, None, None)]), n=4, threshold=(85, 100)).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 2}


def test_word_hashes_depend_on_the_key_and_every_byte():
    words = ["a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 64, "a" * 65, "é", *two_alike(64), *two_alike(1024)]
    (one, _), (two, _) = (S.K.hash_words([" ".join(words).encode()], key) for key in (1, 2))
    assert len(set(one.tolist())) == len(words) and not set(one.tolist()) & set(two.tolist())
    split, offsets = S.K.hash_words([w.encode() for w in ["", *words, ""]], 1)
    assert split.tolist() == one.tolist() and offsets.tolist() == [0, 0, *range(1, len(words) + 1), len(words)]


def test_find_pairs():
    names, checks = np.array([3, 5, 5, 9], np.uint64), np.array([1, 2, 7, 0], np.uint64)
    got = S.find_pairs(np.array([5, 5, 5, 9, 10, 3], np.uint64), np.array([7, 2, 3, 0, 0, 2], np.uint64), names, checks)
    assert got.tolist() == [2, 1, -1, 3, -1, -1]


def test_substring_row_ids_where_ids_repeat(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (None, "other"), (4, text), (4, "a b"), (4, text)]
    out = sorted(S.substring_dedup(frame(spark, [(d, t, None, None, None) for d, t in rows]), min_words=10).collect(), key=lambda r: r.row_id)
    assert [(r.doc_id, r.n_words, r.n_removed) for r in out] == [(4, 2, 0), (4, 30, 0), (4, 30, 30), (None, 1, 0), (None, 30, 30), (None, 30, 30)]
    assert len({r.row_id for r in out}) == 6 and {s["source"] for r in out for s in r.repeats} == {out[1].row_id}
