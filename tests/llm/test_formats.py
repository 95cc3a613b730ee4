"""op5, op6, op8, op9 and op10."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import best_fit_packing as B
from graphloom.llm import bpe_automaton as A
from graphloom.llm import media_chunks as M
from graphloom.llm import prefix_targets as P
from graphloom.llm import warc_zstd as W

from .fixtures import SCHEMA, corpus, frame, with_clashes

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "<|endoftext|>a <|endoftext|>", "don't  stop \n\n it's é日本語🙂", "a" * 300, "=-" * 40, " \n ab\n \n c ", "x y  z ​"]


def odd_rows():
    return [*corpus(n=30), *((200 + i, t, None, None, None) for i, t in enumerate(ODD)), (None, "no id", None, None, None)]


def test_pieces_match_the_library(spark):
    rows = odd_rows()
    out = B.token_pieces(with_clashes(frame(spark, rows)), WORDS, capacity=64).collect()
    coder = Tokenizer.from_file(WORDS)
    want = []
    for doc, text, *_ in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc, k, s, ids[s : s + 64]) for k, s in enumerate(range(0, len(ids), 64))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.piece, r.start, r.ids) for r in out), key=key) == sorted(want, key=key)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in out)


@pytest.mark.parametrize("group", [1 << 17, 50])
def test_packing(spark, group):
    rng = np.random.default_rng(1)
    lengths = [int(min(2048, max(1, x))) for x in rng.lognormal(6, 1, 1500)] + [2048, 2048, 1]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = B.sum_of_squares_packing(pieces, group=group).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(out["length"]) == sorted(lengths)
    ends = out.groupby("sequence_id")["length"].cumsum()
    assert (ends - out["length"] == out["offset"]).all() and ends.max() <= 2048
    least = -(-sum(lengths) // 2048)
    assert out["sequence_id"].nunique() <= least * (1.01 if group > 1000 else 1.2) + 1
    assert B.sum_of_squares_packing(pieces.where("false")).collect() == []


def test_sum_of_squares_rule():
    bins = B.SumOfSquares(10)
    assert bins.place(6) == (0, 0)
    assert bins.place(4) == (0, 6)  # closing a gap lowers the sum
    assert bins.place(10) == (1, 0)


def test_archives_round_trip(spark):
    pages = [(i, f"http://h/{i} x", ("page %d " % (i % 7)) * (3 if i % 2 else 40)) for i in range(40)]
    pages += [(99, None, None), (100, "u", ""), (None, "n", "page 0 " * 40), (3, pages[3][1], pages[3][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("refers_to", F.lit(1))
    out = W.warc_roundtrip(df).collect()
    first = {}
    for i, _, html in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        if len(html or "") >= 100:
            first.setdefault(html, i)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        ref = first.get(html, i) if i is not None else i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if ref == i else "revisit", None if ref == i else ref))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=key) == sorted(want, key=key)
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in out)
    assert W.warc_roundtrip(df.where("false")).collect() == []


def test_archive_faults_are_found():
    records = [W.write_record(i, "u", b"p%d" % i * 60, hashlib.sha256(b"p%d" % i * 60).hexdigest(), None) for i in range(20)]
    data = b"".join(W.write_archive(iter(records)))
    assert struct.unpack_from("<I", data)[0] == W.SKIPPABLE and len(list(W.read_archive(data))) == 20
    with pytest.raises(W.WarcError):
        list(W.read_archive(data[:-3]))
    with pytest.raises(W.WarcError):
        list(W.read_archive(data[:-9] + bytes([data[-9] ^ 255]) + data[-8:]))
    for bad in (records[0].replace(b"Content-Length: ", b"Content-Length: 1", 1), records[0].replace(b"WARC-Date", b"X-Date"), records[0].replace(b"WARC/1.1", b"WARC/9.9"), records[0].replace(b"p0p0", b"p0p1", 1), records[0][:-2]):
        with pytest.raises(W.WarcError):
            W.parse_record(bad)


def test_media_round_trip(spark):
    rows = [*odd_rows(), *((300 + i, "shared payload " * 3000 + str(i % 2), None, None, None) for i in range(6)), (302, "é" * 5000, None, None, None)]
    out = M.media_roundtrip(with_clashes(frame(spark, rows))).collect()
    want = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        want.append((doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=key) == sorted(want, key=key)
    assert M.media_roundtrip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_gear_cuts_are_content_defined():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    cuts = M.gear_cuts(data)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(data) and sizes[:-1].min() >= M.LEAST and sizes.max() <= M.MOST
    chunks = lambda d: {d[a:b] for a, b in zip([0, *M.gear_cuts(d)], M.gear_cuts(d))}
    assert len(chunks(data) & chunks(b"inserted" + data)) > len(cuts) * 0.7
    h, slow = 0, []
    for byte in data[:200]:
        h = ((h << 1) + int(M._GEAR[byte])) % 2**32
        slow.append(h)
    wide = M._GEAR[np.frombuffer(data[:200], np.uint8)]
    step = 1
    while step < 32:
        longer = wide.copy()
        longer[step:] += wide[:-step] << np.uint32(step)
        wide, step = longer, step * 2
    assert slow == wide.tolist()  # 32 bits of the rolling hash are those of the last 32 bytes


TURNS = [(1, 0, "user", "hi <turn assistant>\n"), (1, 1, "assistant", "a\\l # </turn> é"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "user", "only"), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"), (3, None, None, "x"), (None, 1, "assistant", "no id"), (4, 5, "we>ird\nrole", "t")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(9)).withColumn("start", F.lit("x"))
    segments = P.format_turns(df)
    examples = P.expand_targets(segments)
    out = {r.conv_id: r for r in P.read_back(segments, examples).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = out[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = {(r.conv_id, r.example): r for r in P.render_examples(segments, examples).collect()}
    assert len(shown) == sum(t[2] == "assistant" for t in TURNS)
    one = shown[1, 1]
    assert one.context.count("<turn ") == 3 and P.parse_segment(one.target) == ("assistant", "")
    assert P.read_back(*(x.where("false") for x in (segments, examples))).collect() == []
    for change in ({"context_end": F.col("context_end") + 1}, {"example": F.col("example") + 1}, {"loss_end": F.col("loss_end") + 50}):
        with pytest.raises(Exception, match="does not fit"):
            P.read_back(segments, examples.withColumns(change)).collect()


def test_bpe_matches_the_library(spark):
    rows = odd_rows()
    pattern = public_tokenizers.PATTERN
    coded = A.bpe_encode(with_clashes(frame(spark, rows)), BYTES, pattern)
    out = A.bpe_decode(coded, BYTES, pattern).collect()
    coder = Tokenizer.from_file(BYTES)
    want = [(r[0], coder.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.ids) for r in out), key=key) == sorted(want, key=key)
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.text == text[r.doc_id] == coder.decode(r.ids, skip_special_tokens=False) for r in out)
    assert A.bpe_encode(spark.createDataFrame([], SCHEMA), BYTES, pattern).collect() == []


def test_automaton_of_few_merges():
    a, b, c = range(3)
    labels = {a: b"a", b: b"b", c: b"c", 3: b"aa", 4: b"ab", 5: b"abc"}
    auto = A.MergeAutomaton([(a, a, 3), (a, b, 4), (4, c, 5)], labels)

    def slow(word):
        ids = [labels_back[bytes([x])] for x in word]
        for u, v, w in ((a, a, 3), (a, b, 4), (4, c, 5)):
            i = 0
            while i < len(ids) - 1:
                if (ids[i], ids[i + 1]) == (u, v):
                    ids[i : i + 2] = [w]
                i += 1
        return ids

    labels_back = {v: k for k, v in labels.items()}
    rng = np.random.default_rng(0)
    for _ in range(300):
        word = bytes(rng.choice(list(b"abc"), rng.integers(1, 12)).tolist())
        assert auto.encode(word) == slow(word)


def test_byte_pieces_match_the_library():
    import random

    rng = random.Random(5)
    symbols = [*"abcdeghinorstuTHEING   \n\t éÉèßñ'<>|#.,:;!?0129½²  ́\x1c\x7f\x00\x85ªµ中ſKẞİΣσ🙂", "<|endoftext|>", "'s", "'LL", " the", "ing", "  ", "\n\n"]
    texts = ["".join(rng.choices(symbols, k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 200, "é" * 300, "=-" * 100, "", "\n", " " * 90, " " * 40 + "a", "x" * 33, "x" * 32, "<|endoftext|>", "\x00special<|endoftext|>"]
    coder, library = A.load(BYTES, public_tokenizers.PATTERN), Tokenizer.from_file(BYTES)
    ids, bounds = coder.encode(texts)
    back = coder.decode(ids.astype(np.int64), bounds)
    for text, a, b, data in zip(texts, bounds, bounds[1:], back):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert data.decode() == text
    assert coder.automaton.encode_words([])[0].tolist() == []


def test_very_long_words_are_encoded_in_one_pass():
    coder, library = A.load(BYTES, public_tokenizers.PATTERN), Tokenizer.from_file(BYTES)
    texts = ["abc" * 20_000, "é中" * 9000, "a" * 70_000]
    ids, bounds = coder.encode(texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_op10_against_the_library(spark):
    from graphloom.llm import queries

    sf = "/root/testdata/sf0.001"
    coder = Tokenizer.from_file(BYTES)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op10_bpe_automaton(spark, sf).collect()
    assert len(out) == len(text)
    for r in out:
        ids = coder.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_op8_against_plain_python(spark):
    from graphloom.llm import queries

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op8_media_chunks(spark, sf).collect()
    assert len(out) == len(text)
    for r in out:
        data = text[r.doc_id]
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        media = b"SMP8" + struct.pack("<QI", len(payload), 576) + payload
        samples = list(payload)
        mean = sum(samples) / len(samples)
        spread = (sum((x - mean) ** 2 for x in samples) / len(samples)) ** 0.5
        hist = ",".join(str(sum(x >> 5 == k for x in samples) * 1000 // len(samples)) for k in range(8))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == f"mean={mean:.3f};std={spread:.3f};hist={hist}"


def test_query_op5_against_the_library_and_the_rule(spark):
    from graphloom.llm import queries

    sf = "/root/testdata/sf0.001"
    coder = Tokenizer.from_file(WORDS)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 0]
        want |= {(r.doc_id, k): (s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    out = queries.op5_best_fit_packing(spark, sf).toPandas()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()}
    assert got == want and len(out) == len(want)
    out = out.sort_values(["sequence_id", "offset"])
    ends = out.groupby("sequence_id")["length"].cumsum()
    assert (ends - out["length"] == out["offset"]).all() and ends.max() <= 2048
    bins, fewest = B.SumOfSquares(2048), set()
    for size in sorted((n for _, n, _ in want.values() if n < 2048), reverse=True):
        fewest.add(bins.place(size)[0])
    assert out["sequence_id"].nunique() == len(fewest) + sum(n == 2048 for _, n, _ in want.values())
