"""Anchors: places of a sequence chosen by its content, so that equal windows share theirs.

A window of ``length`` symbols has one anchor: the place with the least key among its first
``reach`` places. The key depends on the next few symbols only, so two equal windows have
their anchors at the same offset, and the block of ``length - reach + 1`` symbols from the
anchor on lies in both. A sequence has about 2 / (reach + 1) anchors per symbol. Windows with
one anchor are a run of consecutive starts; ``stretch`` is the string they cover.

Whether a window is repeated is thus settled by comparing blocks, then stretches, and only
where a block stands in different stretches by comparing windows one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from hazardframe.llm.arrays import U64, Rolling, mix


@dataclass(frozen=True)
class Windows:
    """Window length and anchor choice: ``reach`` places, keyed by ``gram`` symbols each."""

    length: int
    reach: int
    gram: int

    @property
    def block(self) -> int:
        return self.length - self.reach + 1


@dataclass
class Anchors:
    """Parallel arrays over anchors; starts are relative to the text that holds them."""

    text: np.ndarray  # row of the text in the chunk
    first: np.ndarray  # first and last window start that have this anchor
    last: np.ndarray
    offset: np.ndarray  # anchor minus first window start
    head: np.ndarray  # hash of the first half of the block
    tail: np.ndarray  # hash of its second half
    stretch: np.ndarray  # hash of all that the windows cover


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _BYTES[buf]


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def find(symbols: np.ndarray, off: np.ndarray, spec: Windows) -> tuple[Anchors, Rolling]:
    """All anchors of a chunk of sequences (``off``: n + 1 offsets)."""
    n, w, roll = len(symbols), spec.reach, Rolling(symbols, longest=spec.length + spec.reach)
    size = np.diff(off)
    rows = np.flatnonzero(size >= spec.length)
    if len(rows) == 0:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, none.view(U64), none.view(U64), none.view(U64)), roll
    pos_bits = U64(max(1, int(n).bit_length()))
    at = np.arange(n - spec.gram + 1)
    low = (U64(1) << pos_bits) - U64(1)
    keys = np.full(-(-(n + w) // w) * w, ~U64(0))
    keys[: len(at)] = (roll.of(at, at + spec.gram) & ~low) | at.astype(U64)
    tiles = keys.reshape(-1, w)
    before = np.minimum.accumulate(tiles, axis=1).ravel()
    after = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    counts = size[rows] - spec.length + 1
    to = np.cumsum(counts) - counts
    start = np.repeat(off[rows] - to, counts) + np.arange(int(counts.sum()))
    anchor = (np.minimum(after[start], before[start + w - 1]) & low).astype(np.int64)
    head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    tail = np.append(head[1:], len(anchor)) - 1
    a, first, last = anchor[head], start[head], start[tail]
    text = rows[np.searchsorted(to, head, "right") - 1]
    half = spec.block // 2
    stretch = mix(roll.of(first, last + spec.length) ^ (a - first).astype(U64))
    return Anchors(text, first - off[text], last - off[text], a - first, roll.of(a, a + half), roll.of(a + half, a + spec.block), stretch), roll
