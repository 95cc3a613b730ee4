"""The block encoder of op5 against the tokenizers library, and its placement against a plain statement of the rule."""

import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import best_fit_packing as B
from graphloom.llm import kernels as K
from graphloom.llm import word_bpe as W

PATH = public_tokenizers.path("word_bpe_49k.json")
SYMBOLS = [*"abcdeghinorstuTHEING   éÉèßñÑ×÷ÿÜ''<>|#.,:;!?0129½²  ́\u0085ªµ中ſKẞİΣσ\x1c\x7f\x00\t\n\r\v\f🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "the", "ing"]


def agree(texts):
    ids, bounds = W.load(PATH).encode([t.encode() for t in texts], 0)
    library = Tokenizer.from_file(PATH)
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text


def test_blocks_match_the_library():
    rng = random.Random(5)
    agree(["".join(rng.choices(SYMBOLS, k=rng.randint(0, 50))) for _ in range(4000)])
    agree(["", "\n", "a" * 24, "a" * 25, "a" * 3000, "É" * 12, "é" * 13, "x" * 24 + "." * 40, "ß" + "," * 30])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text_matches_the_library(texts):
    agree([t.encode("utf-8", "ignore").decode() for t in texts])


def test_equal_rows_are_told_by_content():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 9, (5000, 2)).astype(np.uint64)
    lead, number = K.equal_rows([rows[:, 0], rows[:, 1]])
    seen = {}
    want = [seen.setdefault(tuple(r), i) for i, r in enumerate(rows.tolist())]
    assert lead[number].tolist() == want


def test_placement_is_the_rule():
    rng = random.Random(3)
    for capacity in (7, 12):
        bins, gaps = B.SumOfSquares(capacity), {}
        for size in sorted((rng.randint(1, capacity) for _ in range(300)), reverse=True):
            fitting = sorted({g for g in gaps.values() if g >= size})

            def squares(gap):
                left = [g for g in gaps.values() if g]
                left.remove(gap)
                left += [gap - size] * (gap > size)
                return sum(left.count(g) ** 2 for g in range(1, capacity))

            sequence, offset = bins.place(size)
            if fitting:
                best = min(fitting, key=lambda g: (squares(g), g))
                assert gaps[sequence] == best == capacity - offset
            else:
                assert sequence not in gaps and offset == 0
                gaps[sequence] = capacity
            gaps[sequence] -= size
