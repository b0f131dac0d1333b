"""Bottom-k fingerprints of shingle sets.

A fingerprint is the ``K`` least hashes of a text's distinct five-word shingles, so the
fingerprint of a union is computed from fingerprints alone. Two of them estimate resemblance,
containment and the number of distinct shingles; sets of fewer than ``K`` shingles are held
whole and compared exactly.

Defined cases: a text of fewer words than a shingle is one shingle; null and wordless texts
have the empty fingerprint, which resembles only itself (1.0, any other 0.0); equal texts have
equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.arrays import U64, text_buffer, text_chunks
from hazardframe.llm.sequences import id_ranges, input_bytes
from hazardframe.llm.signature_join import shingle_sets

K, WORDS = 128, 5
RANGE_BYTES = 8 << 20


def pack(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def unpack(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), "<u8")


def sketches(buf: np.ndarray, off: np.ndarray, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    return [s[:k] for s in shingle_sets(buf, off, words)]


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """Fingerprint of the union."""
    return np.unique(np.concatenate(parts))[:k] if parts else np.zeros(0, U64)


def _common(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """Sizes of a, b and their intersection among the hashes that both fingerprints cover."""
    full = [x[-1] for x in (a, b) if len(x) >= k]
    if full:
        a, b = (x[: np.searchsorted(x, min(full), "right")] for x in (a, b))
    both = np.concatenate([a, b])
    both.sort()
    return len(a), len(b), int((both[1:] == both[:-1]).sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y, shared = _common(a, b, k)
    return shared / (x + y - shared)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b holds; 1.0 for an empty a."""
    x, _, shared = _common(a, b, k)
    return shared / x if x else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below ``k``, then an estimate."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def fingerprint(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, distinct_shingles) of every document."""

    def run(batches):
        for batch, buf, off in text_chunks(batches):
            s = sketches(buf, off, k, words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack(x) for x in s], pa.string()), pa.array([distinct(x, k) for x in s])], names=["doc_id", "fingerprint", "distinct_shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, distinct_shingles double")


def merged(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, fingerprint) of the union of each key's fingerprints; tasks merge before the shuffle."""
    kind = parts.schema[key].dataType.simpleString()

    def fold(batches):
        held: dict = {}
        for b in batches:
            for x, f in zip(b.column(key).to_pylist(), b.column("fingerprint").to_pylist()):
                held[x] = merge([held[x], unpack(f)], k) if x in held else unpack(f)
            if len(held) > 50_000:
                yield _rows(held)
                held = {}
        yield _rows(held)

    def _rows(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), parts_type), pa.array([pack(v) for v in held.values()], pa.string())], names=[key, "fingerprint"])

    def final(batches):
        at, total = None, None
        for b in batches:
            for x, f in zip(b.column(key).to_pylist(), b.column("fingerprint").to_pylist()):
                if total is not None and x == at:
                    total = merge([total, unpack(f)], k)
                    continue
                if total is not None:
                    yield _rows({at: total})
                at, total = x, unpack(f)
        if total is not None:
            yield _rows({at: total})

    from pyspark.sql.pandas.types import to_arrow_type

    parts_type = to_arrow_type(parts.schema[key].dataType)
    schema = f"`{key}` {kind}, fingerprint string"
    once = parts.select(key, "fingerprint").mapInArrow(fold, schema)
    return once.repartition(key).sortWithinPartitions(key).mapInArrow(final, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, is_tail, doc_id, text) in id order per part; a part ends with the first row of the next.

    Nulls come first; rows of one id are ordered by their texts' hash. After the last row
    comes the first one. Parts are id ranges; what the driver sees is one id per part.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    part, n = id_ranges(docs, max(1, round(input_bytes(docs) / RANGE_BYTES)))
    firsts = docs.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min(F.struct("doc_id")).alias("least")).orderBy("part").collect()
    least, before = [None] * n, [0] * n
    for i, r in enumerate(firsts):
        least[r.part], before[r.part] = r.least.doc_id, firsts[i - 1].part
    of_part = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), part + 1)
    target = F.when(F.col("doc_id").eqNullSafe(of_part(least, "long")), of_part(before, "int"))
    own = F.struct(part.alias("part"), F.lit(False).alias("is_tail"))
    rows = docs.select(F.explode(F.filter(F.array(own, F.struct(target.alias("part"), F.lit(True).alias("is_tail"))), lambda x: x["part"].isNotNull())).alias("to"), "doc_id", "text")
    rows = rows.select("to.part", "to.is_tail", "doc_id", "text").repartitionById(n, F.col("part"))
    return rows.sortWithinPartitions("part", "is_tail", F.asc_nulls_first("doc_id"), F.xxhash64("text"))


def edited_report(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with both likenesses.

    The edited text is the text with its last half (rounded down) replaced by as many first
    characters of the next document, or all of them.
    """

    def run(batches):
        last = None  # (part, id, text, sketch) of the row whose successor is still to come
        for batch, buf, off in text_chunks(batches):
            own = sketches(buf, off, k, words)
            rows = list(zip(batch.column("part").to_pylist(), batch.column("is_tail").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), own))
            pairs = []
            for r in rows:
                if last is not None and last[0] == r[0]:
                    pairs.append((last, r))
                    last = None
                if not r[1]:
                    last = (r[0], None, r[2], r[3], r[4])
                else:
                    last = None  # further rows of the tail's id follow; only its first one counts
            if not pairs:
                continue
            edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            column = pa.array(edited, pa.string())
            changed = sketches(*text_buffer(column), k, words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                    pa.array([pack(a[4]) for a, _ in pairs]), pa.array([pack(c) for c in changed]),
                    pa.array([resemblance(a[4], c, k) for (a, _), c in zip(pairs, changed)]), pa.array([resemblance(a[4], b[4], k) for a, b in pairs]),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
