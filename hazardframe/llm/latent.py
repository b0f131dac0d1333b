"""Benchmark decontamination by latent semantic retrieval.

Texts become sequences of benchmark terms (words of any benchmark item; other words cannot
match one). Passages of ``2 * BLOCK`` words at steps of ``BLOCK`` words are TF-IDF vectors over
these terms; a randomised SVD gives a latent space of ``RANK`` dimensions, fitted on all items
and all blocks of all documents, with document frequencies counted over all documents. Every passage of every document is projected; passages near an
item in the space (cosine ``MIN_COSINE``) are candidates, and so is, whatever its cosine,
every passage around which enough weight of the item's rarest terms stands that the item's
term weight can be reached (see ``rarest``; this bound leaves out no match, and passages near
an item that it leaves out are not looked at). The longest common
subsequence of words, the share of the item's term weight found and the coverage of the
item's answer confirm or reject them.

The items are the query set; they are held by every task in parts of at most ``PART_ITEMS``
items, one search per part. What a search broadcasts is bounded by that part: its terms and
``RANK`` floats for each. Statistics leave a task as one row per term or matrix slice.

Defined cases: null and empty texts match nothing; items without words match nothing; a null
answer falls back to the item's last words, unless ``SURE_LCS`` of the item is found; repeated rows give repeated matches; an empty
benchmark gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.arrays import ALNUM, U64, lower_ascii, text_buffer, text_chunks, word_bounds, word_hashes
from hazardframe.operators.common import CREATED, keep_only, materialise

BLOCK, RANK, OVERSAMPLE, POWER_ROUNDS = 32, 128, 8, 1
#: The rarest terms of an item hold this share of its weight.
RARE_SHARE = 0.8
PART_ITEMS = 20_000
MIN_COSINE, MIN_LCS, MIN_WEIGHT, MIN_ANSWER, ANSWER_SHARE = 0.4, 0.6, 0.6, 0.5, 0.2
#: An item without an answer of its own needs no more than this share of its words in order.
SURE_LCS = 0.75
#: Postings looked at together.
RUN = 1 << 19
#: Blocks whose rows of a matrix are gathered at once, so that they stay in a core's cache.
NEAR = 256
_SLICES = 16
FOUND = "doc_id long, t long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"


class Items:
    """Benchmark items as term sequences over their own vocabulary."""

    def __init__(self, rows: list):
        texts = [r["text"] for r in rows]
        buf, off = text_buffer(pa.array(texts, pa.string()))
        low = lower_ascii(buf)
        starts, ends, first = word_bounds(low, off, ALNUM)
        hashes = word_hashes(low, starts, ends)
        said = [self._hashes(r["answer"]) for r in rows]
        self.vocabulary = np.unique(np.concatenate([hashes, *said]))
        terms = np.searchsorted(self.vocabulary, hashes)
        self.ids = [r["item_id"] for r in rows]
        self.terms = [terms[a:b] for a, b in zip(first[:-1], first[1:])]
        self.answers = [self._answer(s, t) for s, t in zip(said, self.terms)]
        self.assumed = [not len(s) for s in said]
        keep = [i for i, t in enumerate(self.terms) if len(t)]
        self.ids, self.terms, self.answers, self.assumed = ([x[i] for i in keep] for x in (self.ids, self.terms, self.answers, self.assumed))

    @staticmethod
    def _hashes(answer: str | None) -> np.ndarray:
        b = lower_ascii(np.frombuffer((answer or "").encode(), np.uint8))
        s, e, _ = word_bounds(b, np.array([0, len(b)]), ALNUM)
        return word_hashes(b, s, e)

    def _answer(self, said: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Terms of the answer, or else of the item's last words."""
        if len(said):
            return np.unique(np.searchsorted(self.vocabulary, said))
        return np.unique(terms[-max(3, int(len(terms) * ANSWER_SHARE)) :]) if len(terms) else terms

    def matches(self) -> list[dict[int, int]]:
        """Per item, the bit mask of its places for each term (for the subsequence search)."""
        out = []
        for t in self.terms:
            masks: dict[int, int] = {}
            for i, x in enumerate(t.tolist()):
                masks[x] = masks.get(x, 0) | 1 << i
            out.append(masks)
        return out


def lcs_length(masks: dict[int, int], size: int, terms: list[int]) -> int:
    """Length of the longest common subsequence, one big-integer step per term."""
    full = (1 << size) - 1
    row = full
    for x in terms:
        m = masks.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def as_terms(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, t, terms, per_block): benchmark terms in order and their number per block of words; written once."""
    kind = np.uint16 if len(items.vocabulary) < 1 << 16 else np.uint32
    known = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches):
        vocabulary = known.value
        table = np.zeros(1 << 20, bool)
        table[(vocabulary & U64((1 << 20) - 1)).astype(np.int64)] = True
        for batch, buf, off in text_chunks(batches):
            low = lower_ascii(buf)
            starts, ends, first = word_bounds(low, off, ALNUM)
            h = word_hashes(low, starts, ends)
            at = np.flatnonzero(table[(h & U64((1 << 20) - 1)).astype(np.int64)])
            term = np.minimum(np.searchsorted(vocabulary, h[at]), len(vocabulary) - 1)
            same = vocabulary[term] == h[at]
            at, term = at[same], term[same].astype(kind)
            doc = np.searchsorted(first, at, "right") - 1
            blocks = -(-np.diff(first) // BLOCK)
            base = np.append(0, np.cumsum(blocks))
            counts = np.bincount(base[doc] + (at - first[doc]) // BLOCK, minlength=int(base[-1])).astype(np.uint8)
            ends_of = np.searchsorted(at, first)
            raw, per = term.tobytes(), counts.tobytes()
            w = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array([raw[a * w : b * w] for a, b in zip(ends_of[:-1], ends_of[1:])], pa.binary()), pa.array([per[a:b] for a, b in zip(base[:-1], base[1:])], pa.binary())],
                names=["doc_id", "t", "terms", "per_block"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return materialise(rows.mapInArrow(run, "doc_id long, t long, terms binary, per_block binary").filter("length(terms) > 0"), "terms")


def _unpack(batches, kind, limit: int = 1 << 18):
    """Chunks of documents: (batch, terms, first term of each document, per-block counts, first block of each)."""
    for batch in batches:
        i = 0
        while i < batch.num_rows:
            part = batch.slice(i, 512)
            i += part.num_rows
            terms, blocks = part.column("terms").to_pylist(), part.column("per_block").to_pylist()
            w = np.dtype(kind).itemsize
            yield part, np.frombuffer(b"".join(terms), kind).astype(np.int64), np.append(0, np.cumsum([len(x) // w for x in terms])), np.frombuffer(b"".join(blocks), np.uint8).astype(np.int64), np.append(0, np.cumsum([len(x) for x in blocks]))


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """Adds up (slice, values) rows by slice, one payload in memory at a time; flat result."""

    def merge(batches):
        rows = (x for b in batches for x in zip(b.column("slice").to_pylist(), b.column("values").to_pylist()))
        for s, group in itertools.groupby(rows, key=lambda x: x[0]):
            total = None
            for _, raw in group:
                v = np.frombuffer(raw, np.float64)
                total = v.copy() if total is None else total + v
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "values"])

    out = np.zeros(_SLICES * width)
    for r in parts.repartition(_SLICES, "slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, values binary").collect():  # _SLICES rows
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["values"], np.float64)
    return out


def _emit(total: np.ndarray) -> pa.RecordBatch:
    flat = total.ravel()
    width = -(-len(flat) // _SLICES)
    flat = np.append(flat, np.zeros(width * _SLICES - len(flat)))
    return pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([flat[i * width : (i + 1) * width].tobytes() for i in range(_SLICES)], pa.binary())], names=["slice", "values"])


def _sum_over(rows: DataFrame, shape: tuple[int, ...], add, kind) -> np.ndarray:
    """Sum over all partitions of what ``add`` accumulates into a zero array of ``shape``."""

    def run(batches):
        total = np.zeros(shape)
        for chunk in _unpack(batches, kind):
            add(total, *chunk)
        yield _emit(total)

    size = int(np.prod(shape))
    return _summed(rows.mapInArrow(run, "slice int, values binary"), -(-size // _SLICES))[:size].reshape(shape)


def _project(m: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the rows ``m[term]`` per block; zero for blocks without terms."""
    out, ends = np.zeros((len(counts), m.shape[1]), m.dtype), np.append(0, np.cumsum(counts))
    for i in range(0, len(counts), NEAR):
        full = i + np.flatnonzero(counts[i : i + NEAR])
        if len(full):
            out[full] = np.add.reduceat(m[terms[ends[i] : ends[min(i + NEAR, len(counts))]]], ends[full] - ends[i], axis=0)
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequencies; never zero, so that a common item keeps its words."""
    return np.log((n_docs + 1) / (df + 1)) + 0.05


def rarest(items: Items, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings (first of each term, item, weight) of the items' rarest terms, and the weight needed of them.

    A match misses at most ``1 - MIN_WEIGHT`` of an item's weight, so the rest of the rarest terms' weight is found.
    """
    term, item, need = [], [], np.zeros(len(items.terms))
    for i, terms in enumerate(items.terms):
        own = np.unique(terms)
        own = own[np.argsort(-weights[own], kind="stable")]
        reached = np.cumsum(weights[own])
        n = min(len(own), 1 + int(np.searchsorted(reached, RARE_SHARE * reached[-1])))
        need[i] = reached[n - 1] - (1 - MIN_WEIGHT + 1e-6) * reached[-1]
        term.append(own[:n])
        item.append(np.full(n, i))
    term, item = np.concatenate(term), np.concatenate(item)
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(len(weights) + 1)), item[order], weights[term[order]], need


def _rare_windows(terms: np.ndarray, row: np.ndarray, blocks: np.ndarray, postings: tuple, reaches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, last, item): starts of all windows in which enough weight of the item's rarest terms stands.

    A window is what ``reach`` blocks on both sides of a passage hold, inside one document; it starts where it is
    whole, or with its document. Its words before the first rare term count too, so no start is left out: those whose
    first block with a rare term is the same are one run, and ``last`` is that block where a whole window starts there.
    The work follows the postings met, not blocks times items.
    """
    first, item, weight, need = postings
    keep = first[terms + 1] > first[terms]
    pair = np.unique(row[keep] * (len(first) - 1) + terms[keep])
    row, term = np.divmod(pair, len(first) - 1)
    n = first[term + 1] - first[term]
    met = np.append(0, np.cumsum(n))
    n_rows, wide, lo, out = np.int64(blocks[-1]), 2 + 2 * int(reaches.max()), 0, []
    while lo < len(row):  # starts in runs of blocks that meet about ``RUN`` postings, and what their windows reach
        hi = max(lo + 1, int(np.searchsorted(met, met[lo] + RUN)) - 1)
        hi = int(np.searchsorted(row, row[hi - 1], "right"))
        upper = int(np.searchsorted(row, row[hi - 1] + wide))
        own_n = n[lo:upper]
        at = np.arange(met[upper] - met[lo]) + np.repeat(first[term[lo:upper]] - (met[lo:upper] - met[lo]), own_n)
        key = item[at] * n_rows + np.repeat(row[lo:upper], own_n)
        order = np.argsort(key, kind="stable")
        key, upto = key[order], np.append(0, np.cumsum(weight[at[order]]))
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        own, block = np.divmod(key[start], n_rows)
        before = np.append(-1, np.where(own[1:] == own[:-1], block[:-1], -1))  # the block with rare terms that comes before
        here = block <= row[hi - 1]
        start, own, block, before = start[here], own[here], block[here], before[here]
        of = np.searchsorted(blocks, block, "right")
        begin, end, width = blocks[of - 1], blocks[of], 2 + 2 * reaches[own]  # of the block's document
        stop = np.searchsorted(key, own * n_rows + np.minimum(block + width, end))
        enough = upto[stop] - upto[start] >= need[own]
        start, stop, own, block, before, begin, end, width = (x[enough] for x in (start, stop, own, block, before, begin, end, width))
        # The block in which the weight is reached ends every window of the run.
        reached = np.minimum(np.searchsorted(upto, upto[start] + need[own]), stop)
        reached = key[np.maximum(reached - 1, start)] - own * n_rows
        whole = np.maximum(begin, end - width)
        least = np.maximum(np.maximum(reached - width, before) + 1, begin)
        last = np.minimum(block, whole)
        some = least <= last
        out.append((least[some], last[some], own[some]))
        lo = hi
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _among(starts: np.ndarray, own: np.ndarray, runs: tuple, n_rows: int) -> np.ndarray:
    """Whether a window of an item is one of the ``runs`` of ``_rare_windows``."""
    least, last, item = runs
    if not len(item):
        return np.zeros(len(own), bool)
    order = np.argsort(item * n_rows + least, kind="stable")
    low, high = (item * n_rows + least)[order], np.maximum.accumulate((item * n_rows + last)[order])
    key = own * n_rows + starts
    at = np.searchsorted(low, key, "right") - 1
    return (at >= 0) & (high[np.maximum(at, 0)] >= key)


def _spread(total: np.ndarray, terms: np.ndarray, rows: np.ndarray, y: np.ndarray) -> None:
    """total[term] += y[row] for every occurrence."""
    if len(terms):
        order = np.argsort(terms, kind="stable")
        sorted_terms = terms[order]
        head = np.flatnonzero(np.append(True, sorted_terms[1:] != sorted_terms[:-1]))
        total[sorted_terms[head]] += np.add.reduceat(y[rows[order]], head, axis=0)


def fit(rows: DataFrame, items: Items, idf: np.ndarray, n_passages: int) -> np.ndarray:
    """Terms x RANK basis of the latent space, scaled by the term weights (randomised range finder)."""
    kind = np.uint16 if len(items.vocabulary) < 1 << 16 else np.uint32
    v, width = len(idf), min(len(idf), RANK + OVERSAMPLE)
    # Items weigh as much as all passages together, so their terms shape the space.
    item_terms, item_counts = np.concatenate(items.terms), np.array([len(t) for t in items.terms])
    item_weight = max(1, n_passages) / len(items.terms)

    def gram(q: np.ndarray) -> np.ndarray:
        """(A^T A) q over all passages and the items."""
        scaled = (q * idf[:, None]).astype(np.float32)
        shared = rows.sparkSession.sparkContext.broadcast(scaled)

        def add(total, part, terms, first, counts, blocks):
            ends = np.append(0, np.cumsum(counts))
            for i in range(0, len(counts), 2 * NEAR):
                some, own = counts[i : i + 2 * NEAR], terms[ends[i] : ends[min(i + 2 * NEAR, len(counts))]]
                _spread(total, own, np.repeat(np.arange(len(some)), some), _project(shared.value, own, some))

        total = _sum_over(rows, (v, q.shape[1]), add, kind)
        _spread(total, item_terms, np.repeat(np.arange(len(item_counts)), item_counts), _project(scaled, item_terms, item_counts) * item_weight)
        shared.unpersist()
        return total * idf[:, None]

    q = np.random.default_rng(7).standard_normal((v, width))
    for _ in range(1 + POWER_ROUNDS):
        q, _ = np.linalg.qr(q)
        image = gram(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        q = image @ turn[:, ::-1]
    q, _ = np.linalg.qr(q)
    return q[:, :RANK]


class _Held:
    """Terms of a run of blocks, as a list and as a set; the last run is kept."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray):
        self.terms, self.ends, self.at, self.got = terms, ends.tolist(), None, None

    def words(self, lo: int, hi: int) -> tuple[list[int], set[int]]:
        if self.at != (lo, hi):
            words = self.terms[self.ends[lo] : self.ends[hi]].tolist()
            self.at, self.got = (lo, hi), (words, set(words))
        return self.got


def _search_part(docs: DataFrame, items: Items) -> DataFrame:
    spark = docs.sparkSession
    rows = as_terms(docs, items)
    kind = np.uint16 if len(items.vocabulary) < 1 << 16 else np.uint32
    v = len(items.vocabulary)

    def count(total, part, terms, first, counts, blocks):
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pair = np.unique(doc * v + terms)
        total[:v] += np.bincount(pair % v, minlength=v)
        total[v] += len(counts)

    counted = _sum_over(rows, (v + 1,), count, kind)
    idf = term_weights(counted[:v], docs.count())  # all documents: a weight does not hang on the part its item is in
    basis = (fit(rows, items, idf, int(counted[v])) * idf[:, None]).astype(np.float32)
    item_counts = np.array([len(t) for t in items.terms])
    q = _project(basis, np.concatenate(items.terms), item_counts)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    shared = spark.sparkContext.broadcast((basis, q.astype(np.float32), items, idf, rarest(items, idf)))

    def run(batches):
        basis, q, items, idf, postings = shared.value
        masks = items.matches()
        weighted = [[(x, float(idf[x])) for x in np.unique(t).tolist()] for t in items.terms]
        wanted = [MIN_WEIGHT * sum(w for _, w in x) for x in weighted]
        reaches = 1 + np.array([len(t) for t in items.terms]) // BLOCK
        step = max(64, min(1024, (1 << 21) // len(items.terms)))
        for part, terms, first, counts, blocks in _unpack(batches, kind):
            z = _project(basis, terms, counts)
            doc = np.repeat(np.arange(len(blocks) - 1), np.diff(blocks))
            both = z.copy()
            if len(z) > 1:
                both[:-1][doc[1:] == doc[:-1]] += z[1:][doc[1:] == doc[:-1]]
            size = np.linalg.norm(both, axis=1)
            ends, found = np.append(0, np.cumsum(counts)), []
            for i in range(0, len(both), step):
                rows_at = np.arange(i, min(len(both), i + step))
                cosine = (both[rows_at] / np.maximum(size[rows_at, None], 1e-9)) @ q.T
                hit = np.nonzero(cosine >= MIN_COSINE)
                found.append((rows_at[hit[0]], hit[1], cosine[hit]))
            at, item, near = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
            rare = _rare_windows(terms, np.repeat(np.arange(len(counts)), counts), blocks, postings, reaches)
            first_of, end_of = blocks[doc[at]], blocks[doc[at] + 1]
            starts = np.clip(at - reaches[item], first_of, np.maximum(first_of, end_of - 2 - 2 * reaches[item]))
            possible = _among(starts, item, rare, int(blocks[-1]))  # the others' weight is not in their window
            at, item, near = at[possible], item[possible], near[possible]
            best, first_block, reach_of, held = {}, blocks.tolist(), reaches.tolist(), _Held(terms, ends)

            def share(i: int, lo: int, hi: int) -> float:
                """Share of the item's words that stand in order in blocks lo to hi; 0 without enough of its weight."""
                words, known = held.words(lo, hi)
                return lcs_length(masks[i], len(items.terms[i]), words) / len(items.terms[i]) if sum(w for x, w in weighted[i] if x in known) >= wanted[i] else 0.0

            def region(d: int, i: int, b: int) -> tuple[int, int]:
                return max(first_block[d], b - reach_of[i]), min(first_block[d + 1], b + 2 + reach_of[i])

            def check(d: int, i: int, b: int, c: float) -> None:
                lo, hi = region(d, i, b)
                lcs = share(i, lo, hi)
                if lcs >= MIN_LCS:
                    known = held.words(lo, hi)[1]
                    answer = sum(x in known for x in items.answers[i].tolist()) / len(items.answers[i])
                    best[d, i] = max(best.get((d, i), (0.0,)), (lcs, answer, c, (b - first_block[d]) * BLOCK))

            for b, i, c in zip(at.tolist(), item.tolist(), near.tolist()):
                d = int(doc[b])
                if best.get((d, i), (0.0,))[0] < 0.999:
                    check(d, i, b, c)
            for least, last, i in zip(*(x.tolist() for x in rare)):
                d = int(doc[last])
                # What all windows of the run hold together bounds what one of them holds.
                if best.get((d, i), (0.0,))[0] >= 0.999 or least < last and share(i, least, min(first_block[d + 1], last + 2 + 2 * reach_of[i])) < max(MIN_LCS, best.get((d, i), (0.0,))[0]):
                    continue
                for start in range(last, least - 1, -1):
                    b = min(start + reach_of[i], first_block[d + 1] - 1)
                    c = float(both[b] @ q[i] / max(size[b], 1e-9))
                    if c < MIN_COSINE and best.get((d, i), (0.0,))[0] < 0.999:  # the others were checked already
                        check(d, i, b, c)
            hits = [(k, x) for k, x in sorted(best.items()) if x[1] >= MIN_ANSWER or items.assumed[k[1]] and x[0] >= SURE_LCS]
            if hits:
                row = pa.array([k[0] for k, _ in hits])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(row), part.column("t").take(row), pa.array([items.ids[k[1]] for k, _ in hits], pa.int64()), pa.array([x[2] for _, x in hits]), pa.array([x[0] for _, x in hits]), pa.array([x[1] for _, x in hits]), pa.array([x[3] for _, x in hits])],
                    names=["doc_id", "t", "item_id", "cosine", "lcs_share", "answer_share", "first_word"],
                )

    return rows.mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """Every (document, item) pair whose passage holds the item or a paraphrase of it."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer"))
    parts = max(1, -(-items.count() // PART_ITEMS))
    out = None
    for i in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        held = Items(own.collect())  # about PART_ITEMS rows
        if held.ids:
            found = _search_part(docs, held)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, in which no benchmark item was found."""
    since = len(CREATED)
    found = contaminated(docs, benchmark, answer).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct()
    found = keep_only(found, "found", since)
    t = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (t == F.col("_t")), "left_anti")
