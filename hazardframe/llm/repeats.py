"""Which windows of the corpus are repeated, from candidate anchors.

Candidates carry a block id (equal for equal blocks). Per block, anchors fall into classes of
equal stretches. A block with one class is settled at once; where a block stands in several
different stretches, one representative of each class has its windows compared one by one.
Every comparison is an aggregation with partial sums or a join with one row per key on the
other side, so a block or class that holds a third of all rows is split by Spark like any
skewed join. Only blocks of bounded size are compared inside one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.llm import anchors as an
from hazardframe.llm.arrays import U64, Rolling, mix, signed, text_chunks
from hazardframe.operators.common import CREATED, keep_only, materialise

#: Blocks whose packed window hashes may exceed this are compared by window rows, others inside a task.
TASK_BYTES = 32 << 20
#: Classes that a task gathers before it compares the complete blocks among them.
TASK_ROWS = 5000
_LIST = "array<struct<first:int,last:int,block:long,stretch:long,offset:int,n:long,least:long,many:boolean>>"
ANCHOR = "doc_id long, t long, first int, last int, offset int, head long, tail long, stretch long"

#: Symbols of a chunk: (symbols, offsets of the texts in symbols, byte starts, byte ends).
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, text): a row is named by its id and its text's hash, so repeated rows agree."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t"] == b["t"])


def anchor_table(docs: DataFrame, symbols: Symbols, spec: an.Windows) -> DataFrame:
    """Anchors of every text of ``keyed`` documents, written once."""

    def run(batches):
        for batch, buf, off in text_chunks(batches):
            a, _ = an.find(*symbols(buf, off), spec)
            if len(a.text):
                row = pa.array(a.text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("t").take(row), pa.array(a.first.astype(np.int32)), pa.array(a.last.astype(np.int32)), pa.array(a.offset.astype(np.int32)), signed(a.head), signed(a.tail), signed(a.stretch)],
                    names=["doc_id", "t", "first", "last", "offset", "head", "tail", "stretch"],
                )

    return materialise(docs.mapInArrow(run, ANCHOR), "anchors")


def _windows(part: dict, i: int, roll: Rolling, base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(part["first"][i], part["last"][i] + 1) + base
    return at, roll.of(at, at + length)


def _open_rows(docs: DataFrame, listed: DataFrame, symbols: Symbols, spec: an.Windows, many: bool) -> DataFrame:
    """Windows of open classes: one row each if ``many``, else one row per class with packed hashes."""
    joined = docs.join(listed.hint("shuffle_merge"), same_row(docs, listed)).select(docs["text"], "open")

    def run(batches):
        for batch, buf, off in text_chunks(batches):
            syms, base = symbols(buf, off)
            roll, column = Rolling(syms, longest=spec.length), batch.column("open")
            flat = column.flatten()
            text = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            keep = np.flatnonzero(flat.field("many").to_numpy(zero_copy_only=False) == many)
            if len(keep) == 0:
                continue
            part = {k: flat.field(k).take(pa.array(keep)) for k in ("first", "last", "block", "stretch", "offset", "n", "least")}
            first, last = (part[k].to_numpy().astype(np.int64) + base[text[keep]] for k in ("first", "last"))
            counts = last - first + 1
            to = np.cumsum(counts) - counts
            step = np.arange(int(counts.sum())) - np.repeat(to, counts)
            start = np.repeat(first, counts) + step
            hashes = roll.of(start, start + spec.length)
            if many:
                row = pa.array(np.repeat(np.arange(len(keep)), counts))
                yield pa.RecordBatch.from_arrays([*(part[k].take(row) for k in ("block", "stretch", "offset", "n", "least")), pa.array(step.astype(np.int32)), signed(hashes)], names=["block", "stretch", "offset", "n", "least", "step", "window"])
            else:
                ends = pa.py_buffer(np.append(to, len(hashes)).astype(np.int32) * np.int32(8))
                packed = pa.Array.from_buffers(pa.binary(), len(keep), [None, ends, pa.py_buffer(hashes)])
                yield pa.RecordBatch.from_arrays([*(part[k] for k in ("block", "stretch", "offset", "n", "least")), packed], names=["block", "stretch", "offset", "n", "least", "windows"])

    tail = "step int, window long" if many else "windows binary"
    return joined.mapInArrow(run, f"block long, stretch long, offset int, n long, least long, {tail}")


def _by_rows(windows: DataFrame, earlier: bool) -> DataFrame:
    """Verdicts of window rows: per class, the windows found elsewhere (or in an earlier document)."""
    key = ["block", "window", "back"]
    rows = windows.withColumn("back", F.col("offset") - F.col("step"))
    found = rows.groupBy(*key).agg(F.min("least").alias("m"), ((F.max("n") > 1) | (F.min("stretch") != F.max("stretch"))).alias("again"))
    rows = rows.join(found.filter("again"), key)
    run = F.struct(F.col("step").alias("a"), F.col("step").alias("b"), (F.col("m") if earlier else F.lit(None).cast("long")).alias("m"))
    return rows.groupBy("block", "stretch", "offset").agg(F.collect_list(run).alias("runs"))


def _in_tasks(classes: DataFrame, earlier: bool) -> DataFrame:
    """Verdicts of packed classes, a block's classes side by side in one task."""
    out = "block long, stretch long, offset int, runs array<struct<a:int,b:int,m:long>>"

    def settle(part: pa.Table):
        block, stretch, offset = (part.column(k).to_numpy() for k in ("block", "stretch", "offset"))
        n, least = part.column("n").to_numpy(), part.column("least").to_numpy(zero_copy_only=False)
        packed = part.column("windows").combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        hashes = np.frombuffer(packed.buffers()[2], U64)[ends[0] // 8 : ends[-1] // 8]
        counts = np.diff(ends) // 8
        row = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        # Equal windows share block and distance to the anchor; both go into the compared value.
        key = mix(hashes ^ mix(block.view(U64))[row]) + mix((offset[row] - step).astype(U64))
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        sizes = np.diff(np.append(head, len(order)))
        again = np.repeat((sizes > 1) | np.logical_or.reduceat(n[row[order]] > 1, head), sizes)
        value = np.where(np.isnan(least.astype(float)), np.inf, least) if least.dtype == object or least.dtype.kind == "f" else least
        smallest = np.repeat(np.minimum.reduceat(value[row[order]], head), sizes) if earlier else np.zeros(len(order), np.int64)
        hit, m = np.zeros(len(order), bool), np.zeros(len(order), smallest.dtype)
        hit[order], m[order] = again, smallest
        # Runs of consecutive windows of one class with one verdict.
        begins = hit.copy()
        begins[1:] &= ~(hit[:-1] & (row[1:] == row[:-1]) & (m[1:] == m[:-1]))
        b = np.flatnonzero(begins)
        follows = np.append(hit[1:] & ~begins[1:], False)
        e = np.flatnonzero(hit & ~follows)
        if len(b) == 0:
            return None
        per = np.bincount(row[b], minlength=len(counts))
        ms = pa.nulls(len(b), pa.int64()) if not earlier else pa.array(np.where(np.isfinite(m[b].astype(float)), m[b], 0).astype(np.int64), mask=~np.isfinite(m[b].astype(float)))
        items = pa.StructArray.from_arrays([pa.array(step[b].astype(np.int32)), pa.array(step[e].astype(np.int32)), ms], names=["a", "b", "m"])
        runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), items)
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(stretch), pa.array(offset), runs], names=["block", "stretch", "offset", "runs"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:  # sorted by block: everything before the batch's last block is complete
            held.append(batch)
            rows += batch.num_rows
            if rows < TASK_ROWS:
                continue
            part = pa.Table.from_batches(held)
            block = part.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                done = settle(part.slice(0, cut))
                if done is not None:
                    yield done
            held, rows = part.slice(cut).combine_chunks().to_batches(), part.num_rows - cut
        if rows:
            done = settle(pa.Table.from_batches(held))
            if done is not None:
                yield done

    return classes.repartition("block").sortWithinPartitions("block").mapInArrow(run, out)


def repeated_spans(candidates: DataFrame, docs: DataFrame, symbols: Symbols, spec: an.Windows, earlier: bool) -> DataFrame:
    """(doc_id, t, spans): stretches of symbols covered by repeated windows, not yet merged.

    ``candidates`` are anchors with ``block``. With ``earlier``, a window counts only if it
    also starts in a document with a smaller id (a null id is larger than any other).
    """
    per = F.struct("doc_id", "t", "first", "last")
    classes = candidates.groupBy("block", "stretch", "offset").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min(per).alias("own"))
    since = len(CREATED)
    classes = materialise(classes, "classes")
    blocks = classes.groupBy("block").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"))
    classes = keep_only(classes.join(blocks.filter("total > 1"), "block"), "classes", since)
    task_classes = TASK_BYTES // (8 * spec.reach)
    whole = F.struct(F.lit(0).alias("a"), (F.col("own.last") - F.col("own.first")).alias("b"), (F.col("least") if earlier else F.lit(None).cast("long")).alias("m"))
    settled = classes.filter("kinds = 1").select("block", "stretch", "offset", F.array(whole).alias("runs"))
    member = F.struct(F.col("own.first").alias("first"), F.col("own.last").alias("last"), "block", "stretch", "offset", "n", "least", (F.col("kinds") > task_classes).alias("many"))
    listed = classes.filter("kinds > 1").groupBy(F.col("own.doc_id").alias("doc_id"), F.col("own.t").alias("t")).agg(F.collect_list(member).alias("open"))
    listed = listed.select("doc_id", "t", F.col("open").cast(_LIST).alias("open"))
    verdicts = settled
    if classes.filter("kinds > 1").take(1):
        listed = materialise(listed, "open")
        verdicts = verdicts.unionByName(_in_tasks(_open_rows(docs, listed, symbols, spec, False), earlier))
        if classes.filter(F.col("kinds") > task_classes).take(1):
            verdicts = verdicts.unionByName(_by_rows(materialise(_open_rows(docs, listed, symbols, spec, True), "windows"), earlier))
    found = candidates.join(keep_only(verdicts, "verdicts", since), ["block", "stretch", "offset"])
    runs = F.filter("runs", lambda r: F.col("doc_id").isNull() & r["m"].isNotNull() | (r["m"] < F.col("doc_id"))) if earlier else F.col("runs")
    spans = F.transform(runs, lambda r: F.struct((F.col("first") + r["a"]).alias("start"), (F.col("first") + r["b"] + spec.length).alias("end")))
    found = found.select("doc_id", "t", spans.alias("spans")).filter(F.size("spans") > 0)
    return found.groupBy("doc_id", "t").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents (all columns) with the spans found in them; null where there are none."""
    return docs.join(spans.hint("shuffle_merge"), same_row(docs, spans), "left").drop(spans["doc_id"], spans["t"])


def covered(column: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per symbol of a chunk, whether a span covers it; and each text's number of merged spans."""
    n_texts, total = len(size), int(size.sum())
    base = np.cumsum(size) - size
    steps = np.zeros(total + 1, np.int64)
    flat, per = column.flatten(), np.diff(column.offsets.to_numpy())
    per = np.where(column.is_valid().to_numpy(zero_copy_only=False), per, 0)
    text = np.repeat(np.arange(n_texts), per)
    np.add.at(steps, flat.field("start").to_numpy() + base[text], 1)
    np.add.at(steps, flat.field("end").to_numpy() + base[text], -1)
    gone = np.cumsum(steps)[:total] > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    begins[base[size > 0]] = gone[base[size > 0]]
    ends = np.append(base, total)
    count = np.append(0, np.cumsum(begins))
    return gone, count[ends[1:]] - count[ends[:-1]]
