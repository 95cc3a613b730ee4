"""Byte-level BPE with word ends over whole blocks of text.

A vocabulary of this kind lower-cases, drops white space, and parts letters, single digits and punctuation from one another. ASCII
and the letters of Latin-1 are parted here, by byte classes; equal pieces are told by their bytes, and different pieces
are merged side by side: in every round each applies its merge of lowest rank, leftmost first, which is the order that
the merge list prescribes. Words with any other byte, with an apostrophe (contractions) or with a less-than sign (special
strings), and pieces too long for this, go to the tokenizers library.
"""

from __future__ import annotations

import json
import os

import numpy as np

from graphloom.llm import kernels as K
from graphloom.llm.bpe_automaton import byte_symbols

#: Longest piece, in bytes, that is merged here.
LONGEST = 24
#: Pieces merged side by side; their arrays stay within a core's cache.
TOGETHER = 8000
NONE = np.int32(2**31 - 1)
SPACE, LETTER, DIGIT, SIGN, OTHER, END = range(6)


def _kinds() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[list(range(0x21, 0x7F))] = SIGN
    out[list(b"'<")] = OTHER
    out[list(b"0123456789")] = DIGIT
    out[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
    return out


class PairTable:
    """Rank and product of token pairs: open addressing over (left << 16 | right)."""

    BITS = 18

    def __init__(self, pairs: np.ndarray, products: np.ndarray):
        if len(pairs) > 1 << (self.BITS - 1) or (len(pairs) and int(max(pairs.max(), products.max())) >= 1 << 16):
            raise ValueError("the vocabulary is too large for this table")
        self.keys = np.full(1 << self.BITS, 2**32 - 1, np.uint32)
        self.rank = np.full(1 << self.BITS, -1, np.int32)
        self.product = np.concatenate((products.astype(np.int32), [-1])).astype(np.int32)
        keys = (pairs[:, 0].astype(np.uint32) << np.uint32(16)) | pairs[:, 1].astype(np.uint32)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.rank[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            mine = left[free][first]
            self.keys[slots], self.rank[slots] = keys[mine], mine
            rest = np.ones(len(left), bool)
            rest[np.flatnonzero(free)[first]] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        at = self._home(keys)
        out = self.rank[at]
        lost = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & (len(self.keys) - 1)
            out[lost] = self.rank[at[lost]]
            lost = lost[(self.keys[at[lost]] != keys[lost]) & (out[lost] >= 0)]
        return out


class WordBpe:
    """A tokenizers file whose words end in a suffix."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path).encode_batch_fast
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable(np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2), np.array([vocab[a + b] for a, b in merges], np.int64))
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], np.int32)
        self.kinds = _kinds()

    def by_library(self, words: list[bytes]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(words), 1000):
            out += [np.array(code.ids, np.uint32) for code in self.library([w.decode() for w in words[i : i + 1000]], add_special_tokens=False)]
        return out

    def _pieces(self, buf: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, and start, end and kind of each piece. A word that holds anything unusual is one piece, OTHER; each
        text's end is a piece, END."""
        kind = self.kinds[buf]
        after = np.flatnonzero(buf[:-1] == 0xC3) + 1
        second = buf[after]
        latin = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        kind[after[latin]] = LETTER
        low = buf.copy()
        low[(buf >= 65) & (buf <= 90)] += 32
        low[after[latin & (second <= 0x9E)]] += 0x20
        if (kind == OTHER).any():
            starts, ends = K.word_spans(buf)
            odd = np.add.reduceat((kind == OTHER).astype(np.int32), starts) > 0
            for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True):
                kind[a:b] = OTHER
        kind[text_ends] = END
        edge = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == END)))
        starts = np.flatnonzero(edge & (kind != SPACE))
        edge = np.concatenate((edge[1:], [True]))
        return low, starts, np.flatnonzero(edge & (kind != SPACE)) + 1, kind[starts]

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts end to end, each with end_id behind it, and the places where texts begin."""
        raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(raw, np.uint8)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        low, starts, ends, kind = self._pieces(buf, text_ends)
        sizes = ends - starts
        short = (kind != OTHER) & (kind != END) & (sizes <= LONGEST)
        code = np.zeros(len(starts), np.int64)  # 0: the end of a text
        ids, counts = [np.array([end_id], np.uint32)], [np.ones(1, np.int64)]
        known = 1
        rest = np.flatnonzero(~short & (kind != END)).tolist()
        if rest:
            words = [raw[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            names = {w: i for i, w in enumerate(dict.fromkeys(words), known)}
            code[rest] = [names[w] for w in words]
            found = self.by_library(list(names))
            ids += found
            counts.append(np.array([len(x) for x in found], np.int64))
            known += len(names)
        at = np.flatnonzero(short)
        if len(at):
            lead, own = K.equal_rows(K.packed(low, starts[at], sizes[at]))
            order = np.argsort(sizes[at[lead]], kind="stable")
            place = np.empty(len(lead), np.int64)
            place[order] = np.arange(len(lead))
            code[at] = known + place[own]
            lead = at[lead[order]]
            for part in np.array_split(lead, -(-len(lead) // TOGETHER)):
                merged, number = self._merge(low, starts[part], ends[part])
                ids.append(merged)
                counts.append(number)
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        first, number = np.cumsum(counts) - counts, counts[code]
        before = np.cumsum(number) - number
        out = ids[np.repeat(first[code] - before, number) + np.arange(int(number.sum()))]
        texts_end = (before + number)[code == 0]
        return out, np.concatenate(([0], texts_end))

    def _merge(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of buf[starts:stops] end to end, and how many of them each piece has."""
        n, sizes = len(starts), stops - starts
        width = int(sizes.max())
        # one column for each piece, with an empty row above and below; a token stands in the row of its first byte
        row = np.arange(-1, width + 1)[:, None]
        byte = buf[np.minimum(starts + np.maximum(row, 0), stops - 1)]
        token = np.where(row == sizes - 1, self.final[byte], self.inner[byte])
        token[(row < 0) | (row >= sizes)] = -1
        token = token.ravel()
        after = np.arange(n, n + len(token))
        before = after - 2 * n
        score = np.full((width + 2, n), NONE, np.int32)
        ranks = self.pairs.find(token[n : n * (width + 1)], token[2 * n :]).reshape(width, n)
        score[1:-1] = np.where(ranks >= 0, ranks * 32 + row[1:-1].astype(np.int32), NONE)
        flat = score.ravel()
        while True:
            best = score.min(0)
            column = np.flatnonzero(best != NONE)
            if not len(column):
                break
            best = best[column]
            at = ((best & 31) + 1) * n + column
            product = self.pairs.product[best >> 5]
            gone = after[at]
            beyond, prior = after[gone], before[at]
            token[at], token[gone], flat[gone] = product, -1, NONE
            after[at], before[beyond] = beyond, at
            ranks = self.pairs.find(np.concatenate((product, token[prior])), np.concatenate((token[beyond], product)))
            places = np.concatenate((best & 31, prior // n - 1))
            flat[np.concatenate((at, prior))] = np.where(ranks >= 0, ranks * 32 + places, NONE)
        token = token.reshape(width + 2, n)
        filled = token >= 0
        return token.T[filled.T].astype(np.uint32), filled.sum(0)


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
