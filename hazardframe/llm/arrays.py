"""Arrow text columns as byte arrays: word bounds, word hashes, window hashes.

All of it works on whole Arrow batches with numpy, so a task handles many documents per call.
Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in runs of at most so many bytes (or one text, if that is longer).
CHUNK_BYTES = 1 << 19
U64 = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # fixed values: odd multipliers of the two rolling hashes


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 offsets at which they start and end."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their text bytes and offsets."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buf, off = text_buffer(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    pa.default_memory_pool().release_unused()  # workers go on to other stages


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the published splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """1, P, P^2, ... modulo 2^64, for P or its inverse; grown on demand."""
    got = _POWERS.get((which, inverse))
    if got is None or len(got) < n:
        base = pow(_ODD[which], -1, 1 << 64) if inverse else _ODD[which]
        got = np.full(max(n, 1 << 16), U64(base))
        got[0] = 1
        got = np.multiply.accumulate(got)
        _POWERS[which, inverse] = got
    return got[:n]


SPACE = np.ones(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each text's first word index (n + 1 values)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = is_word[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[(off[1:] - 1)[off[1:] > 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """One 64-bit hash per word."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    inside = at - np.repeat(first, size)
    value = (buf[np.repeat(starts, size) + inside].astype(U64) + U64(1)) * powers(int(size.max()), which)[inside]
    return mix(np.add.reduceat(value, first) ^ (size.astype(U64) << U64(48)))


def hash_bytes(word: bytes, which: int = 0) -> int:
    """The hash that ``word_hashes`` gives to one word."""
    b = np.frombuffer(word, np.uint8)
    return int(word_hashes(b, np.array([0]), np.array([len(b)]), which)[0])


#: Windows from this size on are hashed by a prime modulus too: modulo 2^64 alone, long strings of a known kind collide.
LONG_WINDOW = 512
_PRIME, _BASE = U64(2147483647), U64(1103515245)  # fixed values: a Mersenne prime and a base below it


class Rolling:
    """Hashes of any window of a symbol sequence from one pass of prefix sums.

    ``longest``: windows may be so long; from ``LONG_WINDOW`` on, two hashes are combined.
    """

    def __init__(self, symbols: np.ndarray, which: int = 0, longest: int = 0):
        n = len(symbols)
        self.which, self.twice = which, longest >= LONG_WINDOW
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * powers(n + 1, which)[:n], out=self.sums[1:])
        self.inverse = powers(n + 1, which, True)
        if self.twice:
            self.small = np.zeros(n + 1, U64)
            np.cumsum(mix(symbols) % _PRIME * prime_powers(n + 1)[:n] % _PRIME, out=self.small[1:])
            self.small_inverse = prime_powers(n + 1, True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scrambled hash of symbols[start:end], the same wherever the window stands."""
        value = (self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64)
        if self.twice:
            value = mix(value) ^ (self.small[end] - self.small[start]) % _PRIME * self.small_inverse[start] % _PRIME
        return mix(value)


_PRIME_POWERS: dict[bool, np.ndarray] = {}


def prime_powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of the base (or its inverse) modulo the prime; grown by doubling."""
    got = _PRIME_POWERS.get(inverse)
    if got is None or len(got) < n:
        base = pow(int(_BASE), -1, int(_PRIME)) if inverse else int(_BASE)
        got = np.ones(1, U64)
        while len(got) < max(n, 1 << 16):
            got = np.concatenate([got, got * U64(pow(base, len(got), int(_PRIME))) % _PRIME])
        _PRIME_POWERS[inverse] = got
    return got[:n]


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def row_of(counts: np.ndarray) -> np.ndarray:
    """0, 0, 1, 2, 2, 2, ... for counts 2, 1, 3, ..."""
    return np.repeat(np.arange(len(counts)), counts)


def strings(values: list[bytes]) -> pa.Array:
    return pa.array([v.decode() for v in values], pa.string())
