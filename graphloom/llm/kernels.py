"""Vectorised byte kernels shared by the word and window operators.

Texts are handled as UTF-8 bytes. A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; since those are ASCII,
splitting bytes equals splitting code points. Every word and n-gram is named by a 64-bit hash under a key that is drawn
anew for each run (fresh_key): equal sequences always have equal hashes, and since the key is not known beforehand, no text can be
written whose words collide. Words are hashed eight bytes at a time, with a mixing step between, so that no pattern of
bytes cancels. Where one collision would change a result, operators use two such hashes, or compare further.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def fresh_key() -> int:
    """A key for one run; the driver draws it, and all tasks of the run get it with their code."""
    return secrets.randbits(64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte array."""
    edge = np.diff(np.concatenate(([True], _SPACE[buf], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hash_words(texts: list[bytes], key: int, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and offsets: text i has words offsets[i]:offsets[i + 1]."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    buf = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(LONG_WORD), np.uint8) if texts else np.zeros(0, np.uint8)
    starts, ends = word_spans(buf[: len(buf) - LONG_WORD] if texts else buf)
    offsets = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    if fold_case:
        buf = buf + ((buf >= 65) & (buf <= 90)).view(np.uint8) * np.uint8(32)
    sizes = ends - starts
    out = mix(sizes.astype(U) * U(0x9E3779B97F4A7C15) + U(key))
    if len(starts):
        eight = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), 0, (1,))
        todo = np.arange(len(starts)) if sizes.max() <= LONG_WORD else np.flatnonzero(sizes <= LONG_WORD)
        for skip in range(0, LONG_WORD, 8):
            todo = todo[sizes[todo] > skip] if skip else todo
            if not len(todo):
                break
            left = np.minimum(sizes[todo] - skip, 8).astype(U)
            out[todo] = mix(out[todo] ^ (eight[starts[todo] + skip] & (U(2**64 - 1) >> (U(64) - U(8) * left))))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        word = buf[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return out, offsets


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i:i + n] for every i; the last n - 1 entries are missing."""
    if len(words) < n:
        return np.zeros(0, U)
    total, width, power, done = None, 1, words, 0
    factor = 0xD6E8FEB86659FD93
    left = n
    while left:  # binary expansion of n, with runs of 1, 2, 4, ... words built by doubling
        if left & 1:
            part = power[done:] * U(pow(factor, done, 1 << 64))
            total = part if total is None else total[: len(part)] + part[: len(total)]
            done += width
        left >>= 1
        if left:
            power = power[:-width] + power[width:] * U(pow(factor, width, 1 << 64))
            width *= 2
    return mix(total[: len(words) - n + 1])


def span_owner(offsets: np.ndarray) -> np.ndarray:
    """Index of the text that each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most limit, or hold one item."""
    a = total = 0
    for i, size in enumerate(sizes):
        if i > a and total + size > limit:
            yield a, i
            a = i
            total = 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spans(column, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows a:b of an Arrow string column, at most limit bytes or one row at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    yield from blocks(pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_pylist(), limit)


def text_blocks(column, limit: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """spans() with the rows' UTF-8 bytes; null counts as empty."""
    for a, b in spans(column, limit):
        yield a, b, as_bytes(column.slice(a, b - a))


def packed(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Pieces of buf as rows of 64-bit numbers, eight bytes in each, with zeros behind: rows are equal where pieces of bytes that are
    not zero are. There are as many columns as the longest piece needs."""
    width = int(sizes.max(initial=1))
    eight = np.ndarray((len(buf) + 1,), "<u8", np.concatenate((buf, np.zeros(8 + width, np.uint8))), 0, (1,))
    columns = []
    for skip in range(0, width, 8):
        left = np.clip(sizes - skip, 0, 8).astype(U)
        mask = np.where(left > 0, U(2**64 - 1) >> (U(64) - U(8) * np.maximum(left, U(1))), U(0))
        columns.append(eight[np.minimum(starts + skip, len(buf))] & mask)
    return columns


def equal_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each class of equal rows, class of every row), by a table of row numbers in place of a sort."""
    n = len(columns[0])
    h = columns[0]
    for c in columns[1:]:
        h = mix(h) + c
    h = mix(h)
    bits = max(10, int(n).bit_length() + 1)
    table = np.empty(1 << bits, np.int32)
    head, todo, turn = np.empty(n, np.int32), np.arange(n, dtype=np.int32), 0
    while len(todo):
        at = ((h[todo] >> np.uint64(64 - bits)) if not turn else mix(h[todo] + np.uint64(turn)) >> np.uint64(64 - bits)).astype(np.int64)
        table[at[::-1]] = todo[::-1]
        found = table[at]
        same = np.ones(len(todo), bool)
        for c in columns:
            same &= c[found] == c[todo]
        head[todo[same]] = found[same]
        todo, turn = todo[~same], turn + 1
    lead = np.flatnonzero(head == np.arange(n))
    number = np.empty(n, np.int32)
    number[lead] = np.arange(len(lead), dtype=np.int32)
    return lead, number[head]


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at first and have sizes, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))


def release() -> None:
    """Give freed memory back to the system. Workers live on between stages, and would keep the most that any stage took."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc
        trim(0)


def released(work):
    """work on batches, with release() at its end."""

    def run(batches):
        yield from work(batches)
        release()

    return run
