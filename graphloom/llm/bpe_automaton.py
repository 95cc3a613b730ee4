"""Byte-level BPE as a deterministic automaton over tokens, built merge by merge.

The automaton accepts exactly the correct tokenizations. It starts as one state with a loop for every byte. The gadget of
merge (u, v) -> w splits the state that u leads to: u now leads to a copy that has lost its v arc, and every state with a
u arc gets a w arc to where v led. So each merge adds one state and one token, an arc's target depends on its token
alone, and a state is told apart from its parent by one lost arc. The finished automaton is compiled into tables: the tree of
states in preorder, with each token's lost arcs as intervals of it, from which whether a state has an arc is read; a trie of
labels, as a table of (node, byte); and a table of the arcs that were met.

Encoding follows transitions from left to right, for many words at once. Every prefix of a word has exactly one accepted path, so
a place in a word has one last token, and with it one state: from each place, every label that begins there and has an arc
settles the place where it ends. Nothing is tried and taken back. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import kernels as K

#: Arcs that a worker may hold; beyond, it starts anew. Results do not depend on it.
ARCS = 1 << 20
#: Longest word, in bytes, that is encoded side by side with others, and how many are. Longer ones are encoded one by one.
LONGEST, TOGETHER = 32, 8000
#: Starts of a long word that are looked up at once.
STRETCH = 1 << 16
#: Bytes of texts that are encoded at once.
BLOCK_BYTES = 1 << 22
#: Stands for the state before the first token.
ROOT = 0xFFFF
NOTHING = np.uint32(2**32 - 1)
SPACE, LETTER, DIGIT, SIGN, OTHER, END = range(6)
#: Code points of Unicode's White_Space property beyond ASCII, as a character class.
WHITE = "\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Table:
    """32-bit keys (all but 2**32 - 1) to 32-bit numbers that are not negative, by open addressing."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.full(1 << bits, NOTHING, np.uint32), np.full(1 << bits, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys that are not there yet; at most half of the table may be filled."""
        at, todo, last = self._home(keys), np.arange(len(keys)), len(self.keys) - 1
        self.count += len(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[at] == NOTHING)
            slots, first = np.unique(at[free], return_index=True)
            mine = free[first]
            self.keys[slots], self.values[slots] = keys[todo[mine]], values[todo[mine]]
            rest = np.ones(len(todo), bool)
            rest[mine] = False
            todo, at = todo[rest], (at[rest] + 1) & last

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        at, last = self._home(keys), len(self.keys) - 1
        seen, out = self.keys[at], self.values[at]
        lost = np.flatnonzero((seen != keys) & (seen != NOTHING))
        out[seen == NOTHING] = -1
        while len(lost):
            at[lost] = (at[lost] + 1) & last
            seen = self.keys[at[lost]]
            out[lost] = np.where(seen == keys[lost], self.values[at[lost]], -1)
            lost = lost[(seen != keys[lost]) & (seen != NOTHING)]
        return out


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class MergeAutomaton:
    """States: parent, lost token and birth (merge number). Tokens: left half, birth, and the state that they lead to."""

    def __init__(self, merges: list[tuple[int, int, int]], labels: dict[int, bytes]):
        self.labels = labels
        self.spell = {label: token for token, label in labels.items()}
        self.parent, self.lost, self.birth = [0], [-1], [-1]
        self.left, self.born, self.leads = {}, {}, {}
        for token, label in labels.items():
            if len(label) == 1:
                self.born[token], self.leads[token] = -1, 0
        for number, (u, v, w) in enumerate(merges):
            self._gadget(number, u, v, w)
        self.spell = {label: token for label, token in self.spell.items() if token in self.leads}
        self._compile()

    def _gadget(self, number: int, u: int, v: int, w: int) -> None:
        if u not in self.leads or v not in self.leads or w in self.leads:
            return
        state, beyond = self.leads[u], self.leads[v]
        if not self._allows(state, v):
            return  # u is never followed by v: the merge has nothing to act on
        self.parent.append(state)
        self.lost.append(v)
        self.birth.append(number)
        self.left[w], self.born[w], self.leads[w] = u, number, beyond
        self.leads[u] = len(self.parent) - 1

    def _allows(self, state: int, token: int) -> bool:
        """Whether state has an arc for token: younger tokens follow their left half, older ones are inherited."""
        parent, lost, birth, left, born = self.parent, self.lost, self.birth, self.left, self.born
        while state:
            if born[token] >= birth[state]:
                token = left[token]
            elif token == lost[state]:
                return False
            else:
                state = parent[state]
        return True

    def _compile(self) -> None:
        """Tables of the finished automaton."""
        # preorder places of states; each token keeps the subtrees that have lost its arc, as disjoint intervals
        below: list[list[int]] = [[] for _ in self.parent]
        for state in range(1, len(self.parent)):
            below[self.parent[state]].append(state)
        enter, leave, todo, clock = np.zeros(len(below), np.int64), np.zeros(len(below), np.int64), [0], 0
        while todo:
            state = todo.pop()
            if state < 0:
                leave[~state] = clock
                continue
            enter[state], clock = clock, clock + 1
            todo.append(~state)
            todo.extend(below[state])
        lost = np.array(self.lost[1:], np.int64)
        order = np.argsort(lost * len(below) + enter[1:], kind="stable")
        self.gap_key = (lost * len(below) + enter[1:])[order]
        self.gap_end, self.gap_birth = leave[1:][order], np.array(self.birth[1:], np.int64)[order]
        self.gap_token, self.states = lost[order], len(below)
        size = max([ROOT, *self.labels]) + 1
        if size > ROOT + 1 or ROOT in self.leads:
            raise ValueError("the vocabulary is too large for these tables")
        # by token: the place of the state that it leads to, its left half and its birth
        self.place, self.half, self.age = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for token, state in self.leads.items():
            self.place[token], self.age[token] = enter[state], self.born[token]
            self.half[token] = self.left.get(token, -1)
        self.arcs = Table(ARCS.bit_length())
        # labels as a trie: node 0 is the root, ends has the token whose label ends at a node
        edges, ends = {}, [-1]
        for label, token in self.spell.items():
            node = 0
            for byte in label:
                step = node << 8 | byte
                if step not in edges:
                    edges[step] = len(ends)
                    ends.append(-1)
                node = edges[step]
            ends[node] = token
        self.trie = Table(max(8, len(edges).bit_length() + 1))
        self.trie.put(np.fromiter(edges, np.uint32, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.ends = np.array(ends, np.int32)

    def has_arcs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state that each token of before leads to has an arc for token: no state from there up to the root has lost it, or
        a left half of it before it was made."""
        place, limit = self.place[before], np.full(len(token), 2**40)
        out, todo, token = np.ones(len(token), bool), np.arange(len(token)), token.astype(np.int64)
        while len(todo) and len(self.gap_key):
            t = token[todo]
            i = np.searchsorted(self.gap_key, t * self.states + place[todo], "right") - 1
            shut = (i >= 0) & (self.gap_token[i] == t) & (place[todo] < self.gap_end[i]) & (self.gap_birth[i] <= limit[todo])
            out[todo[shut]] = False
            todo = todo[~shut & (self.age[t] >= 0)]
            limit[todo], token[todo] = self.age[token[todo]], self.half[token[todo]]
        return out

    def _open(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """has_arcs() through the table of arcs that were met."""
        keys = (before.astype(np.uint32) << np.uint32(16)) | token.astype(np.uint32)
        known = self.arcs.get(keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            value = self.has_arcs((fresh >> np.uint32(16)).astype(np.int64), (fresh & np.uint32(0xFFFF)).astype(np.int64)).astype(np.int32)
            known[new] = value[back]
            if self.arcs.count + len(fresh) > ARCS:
                self.arcs = Table(self.arcs.bits)
            if len(fresh) <= ARCS:
                self.arcs.put(fresh, value)
        return known > 0

    def _labels(self, buf: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All labels that begin at the starts and end by the limits: (which start, end, token)."""
        which, at, node, found = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.int32), []
        while len(which):
            node = self.trie.get((node.astype(np.uint32) << np.uint32(8)) | buf[at])
            alive = node >= 0
            which, at, node = which[alive], at[alive] + 1, node[alive]
            token = self.ends[node]
            hit = token >= 0
            found.append((which[hit], at[hit], token[hit]))
            alive = at < limits[which]
            which, at, node = which[alive], at[alive], node[alive]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, those of a word the labels of its one accepted path, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        short = int(np.searchsorted(sizes[order], LONGEST, "right"))
        found = []
        for a in range(0, short, TOGETHER):
            some = order[a : min(a + TOGETHER, short)]
            ids, counts[some] = self._encode_short([words[i] for i in some.tolist()])
            found.append(ids)
        for i in order[short:].tolist():
            found.append(self._encode_long(words[i]))
            counts[i] = len(found[-1])
        if not found:
            return np.zeros(0, np.int32), counts
        # from the order by size to that of the words
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(found)[K.ragged(first, counts)], counts

    def _encode_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width, first = int(sizes.max()), np.cumsum(sizes) - sizes
        buf = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), sizes)
        which, end, token = self._labels(buf, np.arange(len(buf)), (first + sizes)[owner])
        word = owner[which]
        start, end = which - first[word], end - first[word]
        order = np.argsort(start.astype(np.uint8), kind="stable")
        word, end, token = word[order], end[order], token[order]
        cuts = np.searchsorted(start[order], np.arange(width + 1))
        # last[w, p]: the token that ends at p on the path of the first p bytes; back: where it begins
        last, back = np.full((len(words), width + 1), -1, np.int32), np.zeros((len(words), width + 1), np.int32)
        last[:, 0] = ROOT
        for p in range(width):
            w, e, t = (x[cuts[p] : cuts[p + 1]] for x in (word, end, token))
            before = last[w, p]
            ok = before >= 0
            ok[ok] = self._open(before[ok], t[ok])
            last[w[ok], e[ok]], back[w[ok], e[ok]] = t[ok], p
        if (last[np.arange(len(words)), sizes] < 0).any():
            raise ValueError("the vocabulary lacks a byte of the text")
        on = np.zeros(last.shape, bool)
        rows, at = np.arange(len(words)), sizes
        while len(rows):
            on[rows, at] = True
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        return last[on], on.sum(1)

    def _encode_long(self, word: bytes) -> np.ndarray:
        """The same for one word of any length: its places are settled one after another."""
        buf, size = np.frombuffer(word, np.uint8), len(word)
        last, back = np.full(size + 1, -1, np.int32), np.zeros(size + 1, np.int64)
        last[0] = ROOT
        for a in range(0, size, STRETCH):
            b = min(a + STRETCH, size)
            which, end, token = self._labels(buf, np.arange(a, b), np.full(b - a, size))
            order = np.argsort(which, kind="stable")
            known: dict[tuple[int, int], bool] = {}
            for p, e, t in zip((which[order] + a).tolist(), end[order].tolist(), token[order].tolist(), strict=True):
                before = int(last[p])
                if before < 0:
                    continue
                ok = known.get((before, t))
                if ok is None:
                    ok = known[before, t] = bool(self._open(np.array([before]), np.array([t]))[0])
                if ok:
                    last[e], back[e] = t, p
        if last[size] < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        path, at = [], size
        while at:
            path.append(last[at])
            at = back[at]
        return np.array(path[::-1], np.int32)

    def encode(self, word: bytes) -> list[int]:
        return self.encode_words([word])[0].tolist()


class ByteBpe:
    """A byte-level tokenizers file: special strings first, then pattern words, then the automaton.

    Of pattern's words, none may cross white space but for one leading space, and of a run of white space before a word
    all but the last character is one word; letters, digits (in runs) and other signs part from one another (so it is in byte-level
    vocabularies). ASCII and the letters of Latin-1 are parted by byte classes; words with anything else, or with an apostrophe, by
    pattern, and so is a whole text that has white space beyond ASCII.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {symbol: b for b, symbol in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        labels = {token: bytes(back[c] for c in text) for text, token in vocab.items()}
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.automaton = MergeAutomaton(merges, labels)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels = dict(labels) | {token: text.encode() for text, token in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.words = regex.compile(pattern).findall
        self.odd_white = re.compile(f"[{WHITE}]").search
        self.kinds = np.full(256, OTHER, np.uint8)
        self.kinds[0x21:0x7F] = SIGN
        self.kinds[ord("'")] = OTHER
        self.kinds[list(b"0123456789")] = DIGIT
        self.kinds[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
        self.kinds[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
        ordered = [self.labels[t] for t in sorted(self.labels)]
        self.label_bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.label_size = np.zeros(max(self.labels, default=0) + 1, np.int64)
        self.label_at = np.zeros(len(self.label_size), np.int64)
        tokens, sizes = np.array(sorted(self.labels), np.int64), np.fromiter(map(len, ordered), np.int64, len(ordered))
        self.label_size[tokens], self.label_at[tokens] = sizes, np.cumsum(sizes) - sizes

    def _cuts(self, buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts begin, texts beginning at begins, and their kinds. Letters, digits and signs part from one another and
        take one space before them along; of a run of white space before a word the last character stands apart. A word that holds
        anything unusual is one piece, OTHER."""
        n = len(buf)
        kind = self.kinds[buf]
        after = np.flatnonzero(buf[:-1] == 0xC3) + 1
        second = buf[after]
        kind[after[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]] = LETTER
        fresh = np.zeros(n + 1, bool)
        fresh[begins] = True
        fresh[n] = True
        white = kind == SPACE
        edge = np.flatnonzero(np.concatenate((fresh[:1] | True, (white[1:] != white[:-1]) | fresh[1:-1])))
        odd = np.add.reduceat((kind == OTHER).astype(np.int32), edge) > 0
        for a, b in zip(edge[odd].tolist(), np.append(edge[1:], n)[odd].tolist(), strict=True):
            kind[a:b] = OTHER
        before = np.concatenate(([False], white[:-1])) & ~fresh[:n]  # white space stands before, in the same text
        behind = np.concatenate((~white[1:], [False])) & ~fresh[1:]  # a word follows, in the same text
        spaced = before & np.concatenate(([False], buf[:-1] == 0x20))
        changed = np.concatenate(([True], kind[1:] != kind[:-1]))
        start = np.where(white, ~before | behind, np.where(before, ~spaced, changed))
        start |= fresh[:n]
        starts = np.flatnonzero(start)
        # a piece is of the kind of its last byte, as its first may be a space
        return starts, kind[np.append(starts[1:], n) - 1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, bounds of each). Special strings become their ids; equal pieces are told by their bytes, and each is
        encoded once for all texts."""
        spans: list[bytes] = []
        owner, special, whole = [], [], []
        for i, text in enumerate(texts):
            parts = self.split_special(text) if self.split_special and any(s in text for s in self.special) else [text]
            for k, part in enumerate(parts):
                if part:
                    spans.append(part.encode())
                    owner.append(i)
                    special.append(self.special[part] if k % 2 else -1)
                    # unusual white space may go on across a cut
                    whole.append(k % 2 == 0 and not part.isascii() and self.odd_white(part) is not None)
        sizes = np.fromiter(map(len, spans), np.int64, len(spans))
        raw = b"".join(spans)
        if raw:
            buf, begins = np.frombuffer(raw, np.uint8), np.cumsum(sizes) - sizes
            starts, kind = self._cuts(buf, begins)
            first = np.searchsorted(starts, begins)
            drop = np.zeros(len(starts) + 1, np.int64)
            for j in [j for j, (t, w) in enumerate(zip(special, whole, strict=True)) if t >= 0 or w]:
                a, b = first[j], first[j + 1] if j + 1 < len(first) else len(starts)
                drop[a + 1] += 1
                drop[b] -= 1
                kind[a] = END
            keep = np.cumsum(drop[:-1]) == 0
            starts, kind = starts[keep], kind[keep]
            ends = np.append(starts[1:], len(buf))
            length = ends - starts
            span = np.searchsorted(begins, starts, "right") - 1
            code = np.zeros(len(starts), np.int64)
            plain = (kind != OTHER) & (kind != END) & (length <= LONGEST)
            at = np.flatnonzero(plain)
            words: list[bytes] = []
            if len(at):
                lead, own = K.equal_rows(K.packed(buf, starts[at], length[at]))
                words = [raw[a:b] for a, b in zip(starts[at[lead]].tolist(), ends[at[lead]].tolist(), strict=True)]
                code[at] = own
            # the rest by text: a piece becomes one or several words
            names: dict[tuple[int, bytes], int] = {}
            units: list[tuple[int, ...]] = []
            place: dict[bytes, int] = {}
            for k in np.flatnonzero(~plain).tolist():
                piece, token = raw[starts[k] : ends[k]], special[span[k]] if kind[k] == END else -1
                if (token, piece) not in names:
                    names[token, piece] = len(names)
                    if token >= 0:
                        units.append((-1 - token,))
                    else:
                        found = (piece,) if kind[k] in (LETTER, DIGIT, SIGN, SPACE) else [w.encode() for w in self.words(piece.decode())]
                        units.append(tuple(place.setdefault(w, len(words) + len(place)) for w in found))
                code[k] = names[token, piece]
            own_ids, own_counts = self.automaton.encode_words(words + list(place))
            upto = np.concatenate(([0], np.cumsum(own_counts)))
            more = [np.concatenate([np.array([-1 - u], np.int32) if u < 0 else own_ids[upto[u] : upto[u + 1]] for u in unit]) if unit else np.zeros(0, np.int32) for unit in units]
            code[~plain] += len(own_counts)
            counts = np.concatenate((own_counts, np.fromiter(map(len, more), np.int64, len(more))))
            ids = np.concatenate((own_ids, *more))
            number = counts[code]
            out = ids[K.ragged((np.cumsum(counts) - counts)[code], number)]
            rows = np.bincount(np.array(owner, np.int64)[span], number, len(texts)).astype(np.int64)
        else:
            out, rows = np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        return out, np.concatenate(([0], np.cumsum(rows)))

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Labels of ids[bounds[i]:bounds[i + 1]], joined."""
        size = self.label_size[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        data = self.label_bytes[np.repeat(self.label_at[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        ends = upto[bounds].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_loaded: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): token ids of every whole text; special strings in a text become their ids.

    path names a byte-level tokenizers JSON file that executors can read; pattern is its pre-splitting pattern. Null
    and empty texts give no ids. One row comes out for each row that goes in, null and repeated ids included; other columns
    are ignored.
    """

    def run(batches):
        import pyarrow as pa

        coder = load(path, pattern)
        for batch in batches:
            for a, b in K.spans(batch.column(1), BLOCK_BYTES):
                ids, bounds = coder.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(K.released(run), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, text): labels of all ids joined; bytes that are not UTF-8 become U+FFFD. Null ids give the empty text."""

    def run(batches):
        import pyarrow as pa

        import pyarrow.compute as pc

        coder = load(path, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist()
            for a, b in K.blocks(sizes, BLOCK_BYTES // 8):
                column = batch.column(1).slice(a, b - a)
                bounds = np.concatenate(([0], np.cumsum(sizes[a:b])))
                texts = coder.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(K.released(run), "doc_id long, ids array<int>, text string")
