"""Removal of word windows repeated from earlier documents, behind a count-min prefilter.

A first pass gives every window's anchor block (see ``anchors``) to a count-min sketch: each
partition counts its blocks, the parts are merged cell by cell. A cell never undercounts,
so a block estimated once occurs once, and all windows with that anchor are unrepeated. The
second pass groups exactly what is left; false alarms of the sketch end there.

The sketch has ``ROWS`` rows of cells; their number follows the count of blocks up to
``MAX_BITS``, and what is broadcast is one bit per cell (estimated twice or more), at most
``ROWS`` times 16 MiB. Beyond that size the filter lets more through and the exact pass has more
to group; no result changes. Parts travel as compressed cell lists, one per range of cells.

Defined cases: null texts have no words; documents shorter than a window lose nothing; of
repeated rows with one id none is earlier than the other; a null id is later than any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm import anchors as an
from hazardframe.llm import repeats
from hazardframe.llm.arrays import U64, mix, text_chunks, word_bounds, word_hashes
from hazardframe.operators.common import materialise

WINDOW = 50
ROWS, MIN_BITS, MAX_BITS, RANGES = 3, 16, 27, 64


def spec(window: int = WINDOW) -> an.Windows:
    return an.Windows(window, max(1, (window + 2) // 2), 1)


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(buf, off)
    return word_hashes(buf, starts, ends), first


def cells(blocks: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(blocks ^ U64(row * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1)) >> U64(64 - bits)).astype(np.uint32)


def _column(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (b.column("block").to_numpy().view(U64) for b in batches if b.num_rows)


def sketch(blocks: DataFrame, bits: int, read: Callable = _column) -> list[np.ndarray]:
    """Per sketch row, the packed bits of the cells counted twice or more over all ``block`` values.

    ``read`` makes arrays of values from a partition's batches; with it, rows of any kind can be counted in one step.
    """
    span = bits - RANGES.bit_length() + 1  # bits of a cell's number within its range

    def count(batches):
        held = list(read(batches))
        if not held:
            return
        values = np.concatenate(held)
        for row in range(ROWS):
            cell, n = np.unique(cells(values, row, bits), return_counts=True)
            at = np.searchsorted(cell >> np.uint32(span), np.arange(RANGES + 1))
            packed = [zlib.compress(np.diff(cell[a:b], prepend=np.uint32(0)).astype(np.uint32).tobytes() + np.packbits(n[a:b] > 1).tobytes(), 1) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([row * RANGES + i for i in range(RANGES)], pa.int32()), pa.array(np.diff(at)), pa.array(packed, pa.binary())], names=["part", "n", "cells"])

    def merge(batches):
        at, seen = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, n, raw in zip(*(batch.column(k).to_pylist() for k in ("part", "n", "cells"))):
                if part != at:
                    if at is not None:
                        yield done()
                    at, seen = part, np.zeros(1 << span, np.uint8)
                raw = zlib.decompress(raw)
                cell = np.cumsum(np.frombuffer(raw, np.uint32, n)).astype(np.int64) - ((part % RANGES) << span)
                twice = np.unpackbits(np.frombuffer(raw, np.uint8, offset=4 * n), count=n)
                seen[cell] = np.minimum(2, seen[cell] + 1 + twice)
        if at is not None:
            yield done()

    parts = blocks.mapInArrow(count, "part int, n long, cells binary").repartition(ROWS * RANGES // 8, "part").sortWithinPartitions("part")
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
    size = 1 << (span - 3)
    for r in parts.mapInArrow(merge, "part int, bits binary").collect():  # ROWS * RANGES rows, at most 48 MiB
        out[r.part // RANGES][(r.part % RANGES) * size : (r.part % RANGES + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def may_repeat(values: np.ndarray, twice: list[np.ndarray], bits: int) -> np.ndarray:
    """Which values the sketch does not show to be unique."""
    keep = np.ones(len(values), bool)
    for row, packed in enumerate(twice):
        cell = cells(values, row, bits)
        keep &= (packed[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
    return keep


def estimated_repeated(rows: DataFrame, column: str = "block") -> DataFrame:
    """Rows whose value the sketch does not show to be unique; loses no repeated value."""
    spark, schema = rows.sparkSession, rows.schema
    n = rows.count()
    bits = min(MAX_BITS, max(MIN_BITS, (4 * n).bit_length()))
    twice = spark.sparkContext.broadcast(sketch(rows.select(rows[column].alias("block")), bits))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(may_repeat(b.column(column).to_numpy().view(U64), twice.value, bits)))

    return rows.mapInArrow(run, schema)


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Word spans of ``repeats.keyed`` documents that an earlier document also holds."""
    w = spec(window)
    rows = repeats.anchor_table(docs, _words, w)
    # Halves of a block are hashed apart; together they name it.
    rows = rows.withColumn("block", F.xxhash64("head", "tail")).drop("head", "tail")
    left = materialise(estimated_repeated(rows), "estimated")
    return repeats.repeated_spans(left, docs, _words, w, earlier=True)


def remove(docs: DataFrame, window: int = WINDOW, digest: bool = True) -> DataFrame:
    """(doc_id, t, n_words, n_removed, kept_sha256, kept): kept words joined by a space.

    ``kept`` is null with ``digest``, the digest is null without.
    """
    rows = repeats.keyed(docs)
    rows = repeats.with_spans(rows, repeated(rows, window))

    def run(batches):
        for batch, buf, off in text_chunks(batches):
            starts, ends, first = word_bounds(buf, off)
            gone, _ = repeats.covered(batch.column("spans"), np.diff(first))
            removed = np.append(0, np.cumsum(gone))
            # Every kept word with one space after it, in one buffer; a text's last space is left out.
            s, e = starts[~gone], ends[~gone]
            size = e - s + 1
            to = np.append(0, np.cumsum(size))
            at = np.repeat(s - to[:-1], size) + np.arange(int(to[-1]))
            flat = np.append(buf, np.uint8(0x20))[np.minimum(at, len(buf))]
            flat[to[1:] - 1] = 0x20
            bound = to[first - removed[first]]
            raw = flat.tobytes()
            parts = [raw[a : max(a, b - 1)] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("t"), pa.array(np.diff(first)), pa.array(removed[first[1:]] - removed[first[:-1]]),
                    pa.array([hashlib.sha256(p).hexdigest() for p in parts] if digest else [None] * len(parts), pa.string()), pa.array([None] * len(parts) if digest else [p.decode() for p in parts], pa.string()),
                ],
                names=["doc_id", "t", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return rows.select("doc_id", "t", "text", "spans").mapInArrow(run, "doc_id long, t long, n_words long, n_removed long, kept_sha256 string, kept string")
