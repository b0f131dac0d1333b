"""BPE encoding and decoding of whole texts by forced boundaries (see ``fragments``).

A narrow step: every task encodes its own rows, nothing is shuffled. Defined cases: null and
empty texts give no ids and an empty decoding; repeated rows give repeated results; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.arrays import text_chunks
from hazardframe.llm.fragments import ENCODED_BYTES, encoder


def encode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, ids array<int>)."""

    def run(batches):
        e = encoder(tokenizer_file)
        for batch, buf, off in text_chunks(batches, limit=ENCODED_BYTES):
            got = e.encode(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([got.ids(i).astype(np.int32) for i in range(len(got))], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), as the library decodes."""

    def run(batches):
        library = encoder(tokenizer_file).library
        for batch in batches:
            ids = [x or [] for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([library.decode(x, skip_special_tokens=False) for x in ids], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids as little-endian 32-bit values."""

    def run(batches):
        e = encoder(tokenizer_file)
        for batch, buf, off in text_chunks(batches, limit=ENCODED_BYTES):
            got = e.encode(buf, off)
            ids = [got.ids(i) for i in range(len(got))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in got.decoded()], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def tokenised(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids of every text, and those ids decoded."""

    def run(batches):
        e = encoder(tokenizer_file)
        for batch, buf, off in text_chunks(batches, limit=ENCODED_BYTES):
            got = e.encode(buf, off)
            ids = [got.ids(i).astype(np.int32) for i in range(len(got))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([x.decode(errors="replace") for x in got.decoded()], pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )
        e.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")
