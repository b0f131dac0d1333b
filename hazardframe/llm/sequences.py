"""Token ids as fixed-size-list batches in Arrow files.

Documents in ascending id order are dealt to shards by id range. A shard is one Arrow file
whose record batches hold equal-length sequences of ids and a mask of the used places, so
any sequence is found by its number and mapped without a copy. Ids are 16 bits wide where
the vocabulary allows. The last sequence of a shard is padded; the index of documents
(committed by Spark with the shard that produced it) tells where each one starts.

Defined cases: null and empty texts hold the end id only; a null id comes first; equal ids
are ordered by their texts' hash; an empty input gives no shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.llm import store
from hazardframe.llm.arrays import text_chunks
from hazardframe.llm.fragments import ENCODED_BYTES, encoder
from hazardframe.operators.common import estimated_bytes, materialise

SEQUENCE, SEQUENCES_PER_BATCH = 2048, 32
#: Size of the input that goes to one shard, by Spark's estimate of the scan.
SHARD_BYTES = 16 << 20
INDEX = "doc_id long, shard int, file string, local_start long, n_tokens long"


def input_bytes(docs: DataFrame) -> int:
    """Spark's estimate of the rows' size; where it has none, the bytes of the texts are summed."""
    known = estimated_bytes(docs)
    if known < 1 << 50:
        return known
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def id_ranges(docs: DataFrame, n: int, id_col: str = "doc_id") -> tuple[Column, int]:
    """A column that gives each row its range of ids (0 to n - 1, in order), and n."""
    cuts = docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    if not cuts:
        return F.lit(0), 1
    listed, steps = F.array(*[F.lit(c).cast("long") for c in cuts]), [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        below = F.element_at(listed, F.least(at + step, F.lit(len(cuts)))) < F.col(id_col)
        return F.when((at + step <= len(cuts)) & below, at + step).otherwise(at)

    # A binary search over one constant list: the plan is as deep for ten thousand ranges as for two.
    return F.aggregate(F.array(*[F.lit(i) for i in steps]), F.lit(0), further), len(cuts) + 1


class Shard:
    """A shard's file, mapped; sequences are views of it."""

    def __init__(self, uri: str):
        path = uri.removeprefix("file://")
        self.source = pa.memory_map(path) if path.startswith("/") else store.open_input(uri)
        self.file = pa.ipc.open_file(self.source)
        self.width = self.file.schema.field("ids").type.list_size
        self.per_batch = int(self.file.schema.metadata[b"sequences_per_batch"])
        self._at: tuple[int, pa.RecordBatch] | None = None

    def batch(self, i: int) -> pa.RecordBatch:
        if self._at is None or self._at[0] != i:
            self._at = (i, self.file.get_batch(i))
        return self._at[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of one sequence."""
        b, j = self.batch(i // self.per_batch), i % self.per_batch
        ids = b.column("ids").values.to_numpy(zero_copy_only=True)[j * self.width : (j + 1) * self.width]
        return ids, b.column("mask").values[j * self.width : (j + 1) * self.width].to_numpy(zero_copy_only=False)

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of places start to end of the shard's stream."""
        size, parts = self.per_batch * self.width, []
        while start < end:
            i = start // size
            stop = min(end, (i + 1) * size)
            parts.append(self.batch(i).column("ids").values.to_numpy(zero_copy_only=True)[start - i * size : stop - i * size])
            start = stop
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self._at = None
        self.source.close()


class _Writer:
    """Packs a stream of ids into sequences and writes full batches."""

    def __init__(self, uri: str, kind: np.dtype):
        self.out, self.kind, self.held, self.n_held, self.length = store.open_output(uri), kind, [], 0, 0
        self.types = [pa.list_(pa.from_numpy_dtype(kind), SEQUENCE), pa.list_(pa.bool_(), SEQUENCE)]
        schema = pa.schema([("ids", self.types[0]), ("mask", self.types[1])], metadata={"sequences_per_batch": str(SEQUENCES_PER_BATCH)})
        self.file = pa.ipc.new_file(self.out, schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.length += len(ids)
        if self.n_held >= SEQUENCE * SEQUENCES_PER_BATCH:
            flat, size = np.concatenate(self.held), SEQUENCE * SEQUENCES_PER_BATCH
            for i in range(0, len(flat) - size + 1, size):
                self._write(flat[i : i + size], size)
            rest = flat[len(flat) - len(flat) % size :].copy()
            self.held, self.n_held = [rest], len(rest)

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), SEQUENCE), pa.FixedSizeListArray.from_arrays(pa.array(mask), SEQUENCE)], schema=self.file_schema()))

    def file_schema(self) -> pa.Schema:
        return pa.schema([("ids", self.types[0]), ("mask", self.types[1])], metadata={"sequences_per_batch": str(SEQUENCES_PER_BATCH)})

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            full = np.zeros(-(-len(flat) // SEQUENCE) * SEQUENCE, self.kind)
            full[: len(flat)] = flat
            self._write(full, len(flat))
        self.file.close()
        self.out.close()


def write_sequences(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the shards; returns the committed index of documents."""
    store.make_folder(folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    # A shard is a range of Spark's own range exchange; equal ids are split by their texts' hash.
    dealt = docs.repartitionByRange(max(1, round(input_bytes(docs) / shard_bytes)), *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())

    def run(batches):
        e, writer, at, uri = encoder(tokenizer_file), None, None, None
        for batch, buf, off in text_chunks(batches, limit=ENCODED_BYTES):
            got = e.encode(buf, off)
            shards = batch.column("shard").to_pylist()
            starts, sizes, files = [], [], []
            for i, s in enumerate(shards):
                if s != at:
                    if writer:
                        writer.close()
                    at, uri = s, store.new_name(folder, f"shard-{s:06d}", ".arrow")
                    writer = _Writer(uri, np.dtype(e.kind))
                ids = np.append(got.ids(i), np.array([end_id], e.kind))
                starts.append(writer.length)
                sizes.append(len(ids))
                files.append(uri)
                writer.add(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), pa.array(files), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "shard", "file", "local_start", "n_tokens"])
        if writer:
            writer.close()

    return materialise(dealt.mapInArrow(run, INDEX), "sequence-index")


def read_documents(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards."""
    base = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = base.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))  # one row per shard

    def run(batches):
        shard, at = None, None
        for b in batches:
            d, sums = b.to_pydict(), []
            for uri, start, n in zip(d["file"], d["local_start"], d["n_tokens"]):
                if uri != at:
                    if shard:
                        shard.close()
                    shard, at = Shard(uri), uri
                sums.append(zlib.crc32(shard.span(start, start + n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        if shard:
            shard.close()

    rows = index.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("local_start"))
    return rows.select("doc_id", "file", "local_start", "start", "n_tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
