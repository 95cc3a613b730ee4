"""op1, op4 and op7."""

import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import compression_language as L
from graphloom.llm import quality_rules as Q
from graphloom.llm import vector_sharding as V

from .fixtures import SCHEMA, corpus, frame, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for i in range(len(words) - 2):
        if grams[words[i], words[i + 1], words[i + 2]] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_measures_match_brute_force(spark):
    rows = [*corpus(), (90, "a b c a b c a b", None, "h", 0), (91, "x\nx\n y#\n\nx ", None, None, 0), (92, "to " * 4000, None, "h", 0), (None, "<a> & é 𝒳", None, "h", 0)]
    out = Q.quality_rules(with_clashes(frame(spark, rows))).collect()
    assert len(out) == len(rows)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == collections.Counter((r[0], *measures(r[1])) for r in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_line_frequency(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"{body(i)}\nAll  Rights RESERVED", "en", "a", 0) for i in range(8)]
    rows += [(20 + i, "\n".join([*(f"menu item {k} of the common site" for k in range(30)), body(50 + i)[:20]]), "en", "a", 0) for i in range(4)]
    rows += [(40 + i, body(99) + "\nall rights reserved", "en", "b", 0) for i in range(9)]  # copies count once
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in Q.quality_rules(docs, min_docs=3, max_share=0.2).collect()}
    assert all(out[i].kept and out[i].removed_chars == len("All  Rights RESERVED") for i in range(8))
    assert not any(out[20 + i].kept for i in range(4))
    assert all(out[40 + i].kept and out[40 + i].removed_chars == 0 for i in range(9))
    kept = {r.doc_id: r.text for r in Q.quality_filter(docs, min_docs=3, max_share=0.2).collect()}
    assert kept == {r[0]: body(r[0]) if r[0] < 8 else r[1] for r in rows if r[0] < 8 or r[0] >= 40}
    assert Q.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sharding(spark):
    rows = [*corpus(n=200), *[(1000 + i, "hot copy " * 40, "en", "x", 0) for i in range(60)], (None, "no id", None, None, None)]
    out = V.vector_sharding(with_clashes(frame(spark, rows)), shards=4, grain=64).toPandas()
    assert len(out) == len(rows)
    by = out.groupby("shard")
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in by)
    size = by["size"].sum()
    assert size.max() - size.min() <= max(len((r[1] or "").encode()) + 1 for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    known = out.dropna(subset=["doc_id"])
    assert all(zlib.crc32(text[d].encode()) == c and len(text[d].encode()) + 1 == s for d, c, s in zip(known["doc_id"], known["text_crc32"], known["size"]))
    homes = collections.defaultdict(set)
    for d, s in zip(known["doc_id"], known["shard"]):
        homes[text[d]].add(s)
    assert all(len(v) == 1 or t.startswith("hot copy") for t, v in homes.items())
    assert V.vector_sharding(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dot_product_packing_balances():
    vectors = np.random.default_rng(3).integers(1, 100, (500, 3)).astype(float)
    shard = V.dot_product_packing(vectors, 8)
    sums = np.array([vectors[shard == s].sum(0) for s in range(8)])
    assert sums[:, 0].max() / sums[:, 0].min() < 1.01


def test_dot_product_packing_is_the_rule():
    rng = np.random.default_rng(9)
    for shards in (2, 5):
        vectors = rng.integers(1, 50, (80, 3)).astype(float)
        share = [[x / t for x, t in zip(v, vectors.sum(0))] for v in vectors.tolist()]
        room = [[1 / shards] * 3 for _ in range(shards)]
        want = {}
        for i in sorted(range(80), key=lambda i: (-max(share[i]), -share[i][0], i)):
            able = [s for s in range(shards) if room[s][0] >= share[i][0] - 1e-12]
            score = lambda s: sum(a * b for a, b in zip(room[s], share[i])) if able else room[s][0]  # noqa: B023, E731
            best = max(score(s) for s in able or range(shards))
            want[i] = min(s for s in able or range(shards) if abs(score(s) - best) < 1e-15)
            room[want[i]] = [a - b for a, b in zip(room[want[i]], share[i])]
        assert V.dot_product_packing(vectors, shards).tolist() == [want[i] for i in range(80)]


def test_query_op4_against_plain_python(spark):
    from graphloom.llm import queries

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op4_vector_sharding(spark, sf).collect()
    assert len(out) == len(text) and {r.law for r in out} == {"bytes"} and {r.shard for r in out} <= set(range(8))
    for r in out:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(data) + 1, zlib.crc32(data), None)
    sizes, homes = collections.Counter(), collections.defaultdict(set)
    for r in out:
        sizes[r.shard] += r.size
        homes[text[r.doc_id]].add(r.shard)
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in out) and all(len(h) == 1 for h in homes.values())
    for shard in range(8):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_repeats_in_long_texts(spark):
    """Windows are told by their whole hashes, however many there are."""
    words = [f"w{i}" for i in range(60_000)]
    words[50_000:50_003] = words[10:13]
    rows = [(1, " ".join(words), None, "h", 0), (2, "a b c " * 20_000, None, "h", 0), (3, "x" * 2_000_000, None, "h", 0)]
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in Q.quality_rules(frame(spark, rows)).collect()}
    assert got == {1: (60_000, 6), 2: (60_000, 60_000), 3: (1, 0)}


def test_language_by_compression(spark):
    import random

    rng = random.Random(2)
    vocabulary = {"xx": ["blun", "drava", "kelto", "misk", "roxan"], "yy": ["çapé", "ôrelu", "sinté", "wagoué", "zélim"]}
    rows = []
    for i in range(300):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "s", "a"]) for _ in range(rng.randint(20, 80))), lang, "s", 0))
    rows += [(900, None, "xx", "s", 0), (901, "123 !!", "yy", "s", 0), (902, "", None, None, None), (None, "blun drava kelto " * 9, None, None, None)]
    docs = frame(spark, rows)
    models = L.learn_dictionaries(docs.where(~L.held_out(F.col("doc_id"))))
    out = {r.doc_id: r for r in L.classify(with_clashes(docs), models).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(out[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.97
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[None].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = L.keep_identified(docs, models)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in out.items() if not r.rejected}
    assert L.learn_dictionaries(spark.createDataFrame([], SCHEMA)) == {}
    assert {r.lang_pred for r in L.classify(docs, {}).collect()} == {"und"}
    assert L.classify(spark.createDataFrame([], SCHEMA), models).collect() == []


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.classify(docs, L.learn_dictionaries(docs.where(~L.held_out(F.col("doc_id"))))).join(docs.select("doc_id", "lang"), "doc_id").where(L.held_out(F.col("doc_id")))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_language_margin_does_not_fall_with_length():
    import random

    rng = random.Random(5)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(3000)] for lang, letters in (("xx", "abdeiklmnorst"), ("yy", "acefghilouvz"))}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    models = {lang: text(lang, 25000).encode() for lang in words}
    short, long = text("xx", 30000), text("xx", 900000)
    (a, _, near, _), (b, _, far, rejected) = L._judge([short, long], models, 0.0005, 6)
    assert a == b == "xx" and not rejected and far > near / 2
    # the end of a text has a say: a short head in one language, all the rest in the other
    assert L._judge([text("yy", 150000) + " " + long], models, 0.0005, 6)[0][0] == "xx"
