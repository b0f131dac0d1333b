"""Toxicity scores from a linear classifier over character n-grams with naive Bayes weights.

Features are the distinct character n-grams (bytes of the lower-cased text) of a document.
Each is scaled by the log ratio of its smoothed frequencies in the two label classes, and a
logistic model is trained on the scaled features. The counts and the model come from every
labelled row that is not held out, with its whole text: rows stay in Spark, and each step of
the training sums their gradients in tasks. Scoring covers every document and every byte of it.

A feature enters the model when at least ``MIN_ROWS`` positive rows and ``MIN_SHARE`` of them hold
it and its likelihood-ratio statistic (presence against label) is at least ``MIN_G``; at most
``FEATURES`` do, the strongest first.

Defined cases: null and empty texts get the model's score of no features; labels of unknown
documents are unused; several rows or labels of one id are all used; a null label is
unknown; without both classes the score is the share of positives (0 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardframe.llm.arrays import U64, lower_ascii, mix, signed, text_chunks
from hazardframe.operators.common import materialise, small

GRAMS = (4, 5, 6)
FEATURES, MIN_ROWS, MIN_SHARE, MIN_G = 1 << 15, 4, 0.001, 20.0
THRESHOLD = 0.7
_TABLE_BITS = 22
_STEPS, _MEMORY, _FLAT, _DECAY = 60, 10, 1e-5, 1e-4


def grams(buf: np.ndarray):
    """(n, hashes of the n bytes from every place on) for each length; some places reach into the next text."""
    value = np.zeros(len(buf), U64)
    for n in range(1, GRAMS[-1] + 1):
        if len(buf) < n:
            return
        value = (value[: len(buf) - n + 1] << U64(8)) | buf[n - 1 :]
        if n in GRAMS:
            yield n, mix(value | (U64(n) << U64(56)))


def rows_of(off: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' rows of places, and which of the places hold n bytes of one text."""
    row = np.searchsorted(off, place, "right") - 1
    return row, place + n <= off[row + 1]


class Places:
    """Places of hashes in a sorted array of distinct hashes, found from their leading bits."""

    def __init__(self, known: np.ndarray):
        self.known = np.append(known, U64((1 << 64) - 1))  # an end for the walk below
        self.shift = U64(64 - max(1, min(22, len(known).bit_length() + 1)))
        ends = np.searchsorted(known >> self.shift, np.arange((1 << int(U64(64) - self.shift)), dtype=U64))
        self.first = ends.astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is not known."""
        at = self.first[(h >> self.shift).astype(np.int64)].astype(np.int64)
        open_ = np.flatnonzero(self.known[at] < h)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.known[at[open_]] < h[open_]]
        return np.where((self.known[at] == h) & (at < len(self.known) - 1), at, -1)


def by_row(rows: list[np.ndarray], found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(found)[order]


def last_places(own: np.ndarray, stamp: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """One place of each distinct value: the last to write its number there."""
    stamp[own] = numbers
    return stamp[own] == numbers


class Model:
    """Sorted feature hashes with weights, a table that rejects most other n-grams, a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(features)
        self.features, self.weights, self.bias = features[order], weights[order], bias
        self.places = Places(self.features)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.features & U64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True

    def present(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs of a chunk of texts."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, h in grams(lower_ascii(buf)):
            place = np.flatnonzero(self.table[(h & U64((1 << _TABLE_BITS) - 1)).astype(np.uint32)])
            at = self.places.find(h[place])
            same = at >= 0
            at, (row, whole) = at[same], rows_of(off, place[same], n)
            rows.append(row[whole])
            found.append(at[whole])
        row, at = by_row(rows, found)
        kept = np.zeros(len(at), bool)
        ends = np.searchsorted(row, np.arange(len(off)))
        stamp, numbers = np.zeros(len(self.features), np.int64), np.arange(len(at))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            kept[a:b] = last_places(at[a:b], stamp, numbers[: b - a])
        return row[kept], at[kept]

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        row, at = self.present(buf, off)
        return _sigmoid(np.bincount(row, self.weights[at], minlength=len(off) - 1) + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


_COUNTS = "gram long, p long, q long"


def _often(rows: DataFrame, least: float) -> DataFrame:
    """n-grams that at least ``least`` of the rows hold."""

    def run(batches):
        for _, buf, off in text_chunks(batches):
            own = [np.zeros(0, U64)]
            for n, h in grams(lower_ascii(buf)):
                row, whole = rows_of(off, np.arange(len(h)), n)
                h, row = h[whole], row[whole]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                own.append(h[new])
            gram, p = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(gram), pa.array(p.astype(np.int64))], names=["gram", "p"])

    return rows.mapInArrow(run, "gram long, p long").groupBy("gram").agg(F.sum("p").alias("p")).filter(F.col("p") >= least)


def _counted(rows: DataFrame, wanted) -> DataFrame:
    """(gram, p, q): labelled rows of each class that hold a wanted n-gram."""

    def run(batches):
        places = Places(wanted.value)
        size = len(wanted.value)
        counts, stamp = np.zeros((2, size), np.int64), np.zeros(size, np.int64)
        for batch, buf, off in text_chunks(batches):
            toxic, rows, found = batch.column("toxic").to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n, h in grams(lower_ascii(buf)):
                at = places.find(h)
                place = np.flatnonzero(at >= 0)
                row, whole = rows_of(off, place, n)
                rows.append(row[whole])
                found.append(at[place[whole]])
            row, at = by_row(rows, found)
            ends, numbers = np.searchsorted(row, np.arange(len(off))), np.arange(len(at))
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                own = at[a:b]
                counts[toxic[i], own[last_places(own, stamp, numbers[: b - a])]] += 1
        some = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([signed(wanted.value[some]), pa.array(counts[1, some]), pa.array(counts[0, some])], names=["gram", "p", "q"])

    return rows.mapInArrow(run, _COUNTS).groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))


def training_rows(labels: DataFrame, held_out: Column, label: str = "toxic") -> DataFrame:
    """(doc_id, toxic) of every labelled id that is not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    return known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic") -> Model:
    """Train on rows of ``labels`` (doc_id, label) for which ``held_out`` (of doc_id) is false."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(training_rows(labels, held_out, label)), "doc_id")
    # Read three times; the labelled rows of a split may be few, so they are dealt out once more.
    rows = materialise(rows.select("text", "toxic").repartition(max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))), "labelled")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, U64), np.zeros(0), 40.0 if n1 else -40.0)
    # First the n-grams that positives hold often enough, then their counts in both classes.
    often = _often(rows.filter("toxic = 1"), max(MIN_ROWS, MIN_SHARE * n1))
    known = spark.sparkContext.broadcast(np.sort(np.array([r.gram for r in often.select("gram").toLocalIterator()], np.int64).view(U64)))
    p, q = F.col("p") + 1.0, F.col("q") + 1.0
    ratio = F.log((p / (n1 + 2)) / (q / (n0 + 2)))
    seen = F.col("p") + F.col("q")

    def term(part: Column, share: float) -> Column:
        return F.when(part > 0, part * F.log(part / (seen * share))).otherwise(0.0)

    g = 2 * (term(F.col("p"), n1 / (n1 + n0)) + term(F.col("q"), n0 / (n1 + n0)))
    best = _counted(rows, known).select("gram", ratio.alias("r"), g.alias("g")).filter(F.col("g") >= MIN_G).orderBy(F.desc("g"), "gram").limit(FEATURES).collect()
    known.unpersist()
    gram, r = np.array([x.gram for x in best], np.int64).view(U64), np.array([x.r for x in best])
    order = np.argsort(gram)
    model, r = Model(gram, r, 0.0), r[order]
    used = spark.sparkContext.broadcast(model)

    def hits(batches):
        for batch, buf, off in text_chunks(batches):
            row, at = used.value.present(buf, off)
            ends = np.searchsorted(row, np.arange(len(off)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([at[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=["toxic", "at"])

    data = materialise(rows.mapInArrow(hits, "toxic int, at binary"), "features")
    return Model(model.features, *_train(data, r, n1, n0))


def _loss(data: DataFrame, w: np.ndarray, r: np.ndarray, bias: float, n1: int, n0: int) -> tuple[float, np.ndarray]:
    """Loss of all rows, both classes counting alike, and its gradient (bias last); one short row a task comes back."""
    sent = data.sparkSession.sparkContext.broadcast(w * r)

    def part(batches):
        v = sent.value
        loss, out = 0.0, np.zeros(len(v) + 1)
        for batch in batches:
            y = batch.column("toxic").to_numpy()
            held = batch.column("at").to_pylist()
            row, at = np.repeat(np.arange(len(y)), [len(x) // 4 for x in held]), np.frombuffer(b"".join(held), np.int32)
            z = np.bincount(row, v[at], minlength=len(y)) + bias
            weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
            loss += float((weight * np.logaddexp(0.0, np.where(y > 0, -z, z))).sum())
            e = (_sigmoid(z) - y) * weight
            out[:-1] += np.bincount(at, e[row], minlength=len(v))
            out[-1] += e.sum()
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([out.tobytes()], pa.binary())], names=["loss", "g"])

    total, gradient = 0.0, np.zeros(len(r) + 1)
    for x in data.mapInArrow(part, "loss double, g binary").collect():
        total += x.loss
        gradient += np.frombuffer(x.g)
    sent.unpersist()
    gradient[:-1] = gradient[:-1] * r + _DECAY * w
    return total + 0.5 * _DECAY * float(w @ w), gradient


def _train(data: DataFrame, r: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by ``r``: limited-memory quasi-Newton steps on full gradients."""
    x = np.zeros(len(r) + 1)
    f, g = _loss(data, x[:-1], r, 0.0, n1, n0)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(_STEPS):
        if np.abs(g).max() <= _FLAT:
            break
        d, back = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            back.append(a)
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(back)):
            d = d + s * (a - (y @ d) / (s @ y))
        step, slope = 1.0, float(g @ d)
        while True:
            new = x + step * d
            f1, g1 = _loss(data, new[:-1], r, float(new[-1]), n1, n0)
            if f1 <= f + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        if f1 >= f:
            break
        s, y = new - x, g1 - g
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-_MEMORY:]
        x, f, g = new, f1, g1
    return x[:-1] * r, float(x[-1])


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scores(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` (default: the id) of every row of ``docs``, and the score as ``name``."""
    keep = keep or ["doc_id"]
    if name in keep:
        raise ValueError(f"the rows already have a column {name}")
    used = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name in keep]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], *([] if "text" in keep else ["text"]))

    def run(batches):
        for batch, buf, off in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(used.value.score(buf, off))], names=[*(f.name for f in kept), name])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, whose score stays below ``threshold``."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return scores(docs, model, docs.columns, name).filter(F.col(name) < threshold).drop(name)
