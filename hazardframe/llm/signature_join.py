"""Jaccard join of word-shingle sets by signature trees.

Equal sets form one class; trees hold classes. A tree node keeps the size range of its sets,
the OR and the AND of their token bitmaps; a pair of nodes is given up when even the best
pair below it stays under the threshold, and when all its sets are already connected.

1. One pass gives every document its set's hash, a bitmap and the rarest tokens of its set
   (as many as two linked sets cannot all miss). "Rare" follows corpus-wide counts in hashed
   cells; any order gives whole results, a good one gives small blocks.
2. Classes that share a rare token form a block. Trees over blocks keep a spanning forest of
   the pairs that their bitmaps allow: the coarse groups.
3. Each coarse group gets its whole sets once; trees with wider bitmaps and exact
   intersections give the true links, of which again a spanning forest is kept.

Large blocks and groups are dealt out as pairs of pages. Components come from alternating
stars (see ``operators.components``). No pair inside a connected part is emitted.

Defined cases: a text of fewer words than a shingle is one shingle; null and wordless texts
have no shingles and link with nothing; repeated rows share a class; a null id never becomes
a component's name unless the component has no other. Two different sets of one 64-bit hash
would count as equal; for a billion sets the odds are about one in forty.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.llm.arrays import U64, Rolling, lower_ascii, mix, signed, text_chunks, word_bounds, word_hashes
from hazardframe.llm.repeats import keyed
from hazardframe.llm.sketch_dedup import MAX_BITS, ROWS, cells, estimated_repeated, sketch
from hazardframe.operators.common import CREATED, estimated_bytes, keep_only, materialise
from hazardframe.operators.components import components

WORDS, PERCENT = 4, 85
#: Classes of a block or group that one task compares; larger ones are dealt out as page pairs.
PAGE = 4096
_FAN = 8
_LEVEL_RANGES = 64


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    low = lower_ascii(buf)
    starts, ends, first = word_bounds(low, off)
    hashes = word_hashes(low, starts, ends)
    roll, out = Rolling(hashes), []
    n = np.diff(first)
    at = np.arange(max(0, len(hashes) - words + 1))
    full = roll.of(at, at + words) if len(at) else np.zeros(0, U64)
    for i, count in enumerate(n.tolist()):
        a = int(first[i])
        if count >= words:
            out.append(np.unique(full[a : a + count - words + 1]))
        elif count:
            out.append(roll.of(np.array([a]), np.array([a + count])))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_hash(s: np.ndarray) -> int:
    if not len(s):
        return 0
    return int(mix(np.array([mix(s).sum(dtype=U64) ^ U64(len(s)) ^ mix(np.bitwise_xor.reduce(mix(s ^ U64(0x5851F42D4C957F2D)), keepdims=True))[0]], U64))[0])


def row_key(doc_id: int | None, h: int) -> int:
    """Names a class's representative row for the membership filter."""
    return int(mix(np.array([h], U64) ^ mix(np.array([(-1 if doc_id is None else doc_id) & (1 << 64) - 1], U64)))[0])


def bitmap(s: np.ndarray, factor: int) -> tuple[int, int]:
    """(bits, width): one bit per token in a power-of-two width of at least ``factor`` times the size."""
    width = max(64, 1 << (factor * max(1, len(s)) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(s & U64(width - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), width


def fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width >>= 1
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class Node:
    __slots__ = ("low", "high", "union", "common", "width", "kids", "member", "first", "one")

    def __init__(self, low, high, union, common, width, kids, member, first):
        self.low, self.high, self.union, self.common, self.width, self.kids, self.member, self.first, self.one = low, high, union, common, width, kids, member, first, False


def _leaf(i: int, size: int, bits: int, width: int) -> Node:
    return Node(size, size, bits, bits, width, None, i, i)


def _join(kids: list[Node]) -> Node:
    width = min(k.width for k in kids)
    union, common = 0, (1 << width) - 1
    for k in kids:
        union |= fold(k.union, k.width, width)
        # Folding a leaf keeps "set by every member"; folding an AND keeps it too (a set bit stays set).
        common &= fold(k.common, k.width, width)
    return Node(min(k.low for k in kids), max(k.high for k in kids), union, common, width, kids, None, kids[0].first)


def tree(leaves: list[Node]) -> Node:
    """Leaves by size; every node over the next few."""
    level = sorted(leaves, key=lambda x: (x.low, x.union))
    while len(level) > 1:
        level = [_join(level[i : i + _FAN]) for i in range(0, len(level), _FAN)]
    return level[0]


class Forest:
    """Union-find over member numbers; ``links`` are the pairs that joined two parts."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def part(self, node: Node) -> int | None:
        """The part that holds all of a node's members, if one does."""
        if node.kids is None or node.one:
            return self.find(node.first)
        seen = None
        for k in node.kids:
            p = self.part(k)
            if p is None or (seen is not None and p != seen):
                return None
            seen = p
        node.one = True
        return seen


def possible(a: Node, b: Node, percent: int) -> bool:
    """Whether some pair of sets below the two nodes can reach the threshold."""
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    w = min(a.width, b.width)
    a_or, b_or = fold(a.union, a.width, w), fold(b.union, b.width, w)
    only_a = (fold(a.common, a.width, w) & ~b_or).bit_count()
    only_b = (fold(b.common, b.width, w) & ~a_or).bit_count()
    shared = min(a.high - only_a, b.high - only_b)
    return shared > 0 and 100 * shared >= percent * (shared + only_a + only_b)


def traverse(a: Node, b: Node, forest: Forest, linked: Callable[[int, int], bool], percent: int) -> None:
    """Dual traversal: joins the parts of all pairs (one below ``a``, one below ``b``) that link."""
    if a is b:
        if a.kids is None or forest.part(a) is not None:
            return
        for k in a.kids:
            traverse(k, k, forest, linked, percent)
        for i, k in enumerate(a.kids):
            for other in a.kids[i + 1 :]:
                traverse(k, other, forest, linked, percent)
        return
    p = forest.part(a)
    if p is not None and p == forest.part(b):
        return
    if not possible(a, b, percent):
        return
    if a.kids is None and b.kids is None:
        if linked(a.member, b.member):
            forest.link(a.member, b.member)
    elif b.kids is None or (a.kids is not None and a.high - a.low >= b.high - b.low):
        for k in a.kids:
            traverse(k, b, forest, linked, percent)
    else:
        for k in b.kids:
            traverse(a, k, forest, linked, percent)


def jaccard_reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _groups(batches, key: list[str], columns: list[str]):
    """Consecutive rows with one key, from batches sorted by it."""
    at, held = None, []
    for b in batches:
        keys = list(zip(*(b.column(k).to_pylist() for k in key)))
        for k, row in zip(keys, zip(*(b.column(c).to_pylist() for c in columns))):
            if k != at:
                if held:
                    yield at, held
                at, held = k, []
            held.append(row)
    if held:
        yield at, held


def _paged(rows: DataFrame, key: str, counted: DataFrame) -> DataFrame:
    """Rows with ``page_a``, ``page_b`` and ``side``: large groups become all pairs of their pages."""
    rows = rows.join(counted.select(key, F.ceil(F.col("k") / PAGE).cast("int").alias("pages")), key)
    page = F.pmod(F.xxhash64("h"), F.col("pages")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("pages") - 1), lambda o: F.struct(F.least(o, page).alias("page_a"), F.greatest(o, page).alias("page_b"), (o < page).alias("side")))
    return rows.select("*", F.inline(others)).drop("pages")


def _spanning(rows: DataFrame, key: str, payload: str, leaf: Callable, percent: int, exact: bool) -> DataFrame:
    """Links (u, v) of a spanning forest of every group's pairs."""

    def run(batches):
        for (_, a, b), members in _groups(batches, [key, "page_a", "page_b"], ["h", "size", payload, "side"]):
            members = list({m[0]: m for m in members}.values())
            hs, raw = [m[0] for m in members], [m[2] for m in members]
            sets = [np.frombuffer(r, U64) for r in raw] if exact else raw
            nodes = [leaf(i, m[1], s) for i, (m, s) in enumerate(zip(members, sets))]
            forest = Forest(len(members))
            linked = (lambda i, j: jaccard_reaches(sets[i], sets[j], percent)) if exact else (lambda i, j: True)
            if a == b:
                root = tree(nodes)
                traverse(root, root, forest, linked, percent)
            else:
                sides = [[n for n, m in zip(nodes, members) if m[3] == s] for s in (False, True)]
                if all(sides):
                    traverse(tree(sides[0]), tree(sides[1]), forest, linked, percent)
            if forest.links:
                yield pa.RecordBatch.from_pydict({"u": [hs[i] for i, _ in forest.links], "v": [hs[j] for _, j in forest.links]}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    dealt = rows.repartition(key, "page_a", "page_b").sortWithinPartitions(key, "page_a", "page_b")
    return dealt.select(key, "page_a", "page_b", "h", "size", payload, "side").mapInArrow(run, "u long, v long")


def rarity(docs: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Level (log2 of the count) of every hashed token cell, over all documents; and the cells' bits."""
    bits = min(24, max(16, (estimated_bytes(docs) // 256).bit_length()))
    part_bits = bits - _LEVEL_RANGES.bit_length() + 1

    def count(batches):
        total, held, n = np.zeros(1 << bits, np.uint32), [], 0

        def add() -> None:
            nonlocal held, n
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
            held, n = [], 0

        for _, buf, off in text_chunks(batches):
            held += [(s >> U64(64 - bits)).astype(np.int32) for s in shingle_sets(buf, off, words)]
            n += len(buf)
            if n > 1 << 22:
                add()
        add()
        parts = total.reshape(_LEVEL_RANGES, -1)
        keep = [i for i in range(_LEVEL_RANGES) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in keep], pa.binary())], names=["part", "counts"])

    def merge(batches):
        for (part,), rows in _streams(batches):
            total = np.zeros(1 << part_bits, np.int64)
            for raw in rows:
                total += np.frombuffer(zlib.decompress(raw), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(255, np.ceil(np.log2(total + 1))).astype(np.uint8).tobytes()], pa.binary())], names=["part", "levels"])

    parts = docs.select("text").mapInArrow(count, "part int, counts binary").repartition(8, "part").sortWithinPartitions("part")
    levels = np.zeros((_LEVEL_RANGES, 1 << part_bits), np.uint8)
    for r in parts.mapInArrow(merge, "part int, levels binary").collect():  # at most 16 MiB in all
        levels[r.part] = np.frombuffer(r.levels, np.uint8)
    return levels.ravel(), bits


def _streams(batches):
    """(key, iterator of payloads) per part, one payload in memory at a time."""
    import itertools

    rows = ((p, c) for b in batches for p, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()))
    for part, group in itertools.groupby(rows, key=lambda x: x[0]):
        yield (part,), (c for _, c in group)


def profiles(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: set hash ``h``, ``size``, ``key``, rare tokens, packed bitmap; written once."""
    levels, bits = rarity(docs, words)
    table = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for batch, buf, off in text_chunks(batches):
            sets, level = shingle_sets(buf, off, words), table.value
            hashes = [set_hash(s) for s in sets]
            rare, maps = [], []
            for s in sets:
                n = len(s)
                take = n - (percent * n + 99) // 100 + 1 if n else 0
                order = (level[(s >> U64(64 - bits)).astype(np.int64)].astype(U64) << U64(58)) | (s >> U64(6))
                rare.append(np.partition(order, take - 1)[:take].view(np.int64) if n else order.view(np.int64))
                m, width = bitmap(s, 2)
                maps.append(m.to_bytes(width // 8, "little"))
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("t"), signed(np.array(hashes, U64)), pa.array([len(s) for s in sets], pa.int32()), signed(np.array([row_key(d, h) for d, h in zip(ids, hashes)], U64)),
                    pa.array(rare, pa.list_(pa.int64())), pa.array(maps, pa.binary()),
                ],
                names=["doc_id", "t", "h", "size", "key", "rare", "bits"],
            )

    return materialise(docs.mapInArrow(run, "doc_id long, t long, h long, size int, key long, rare array<long>, bits binary"), "profiles")


def _member_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(h, size, tokens) of the representatives; a bounded bitmap skips other documents early."""
    n = members.count()
    bits = min(MAX_BITS, max(16, (16 * n).bit_length()))
    keys = members.select(F.col("key").alias("block"))
    wanted = docs.sparkSession.sparkContext.broadcast(sketch(keys.unionAll(keys), bits))

    def run(batches):
        for batch, buf, off in text_chunks(batches):
            sets = shingle_sets(buf, off, words)
            hashes, ids = [set_hash(s) for s in sets], batch.column("doc_id").to_pylist()
            keys = np.array([row_key(d, h) for d, h in zip(ids, hashes)], U64)
            keep = np.ones(len(keys), bool)
            for row in range(ROWS):
                cell = cells(keys, row, bits)
                keep &= (wanted.value[row][cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays([signed(np.array([hashes[i] for i in at], U64)), signed(keys[at]), pa.array([len(sets[i]) for i in at], pa.int32()), pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["h", "key", "size", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, key long, size int, tokens binary")


def linked_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of ``docs`` (doc_id, text)."""
    return components_of(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def components_of(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``linked_components`` with ``t``, the hash of the row's text."""
    docs = keyed(docs)
    rows = profiles(docs, words, percent)
    classes = rows.filter("size > 0").groupBy("h").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "key")).alias("own"), F.max("size").alias("size"))
    classes = materialise(classes.select("h", "least", F.col("own.key").alias("key"), "size"), "classes")
    own = rows.join(classes.select("h", "key"), ["h", "key"], "left_semi")
    # Repeated rows share h and key and all stay in ``own``; a block counts every class once.
    tokens = estimated_repeated(own.select("h", F.explode("rare").alias("token")), "token")
    tokens = materialise(tokens.dropDuplicates(["h", "token"]), "tokens")
    blocks = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("h")).alias("who")).filter("k > 1")
    # Blocks with the same members are one block.
    blocks = materialise(blocks.groupBy("k", "who").agg(F.min("token").alias("token")), "blocks")
    in_blocks = tokens.join(blocks.select("token"), "token")
    sides = own.select("h", "size", "bits").dropDuplicates(["h"])
    coarse_rows = _paged(in_blocks.join(sides, "h"), "token", blocks)
    coarse = _spanning(coarse_rows, "token", "bits", lambda i, n, s: _leaf(i, n, int.from_bytes(s, "little"), 8 * len(s)), percent, False)
    groups = components(materialise(coarse.distinct(), "coarse")).select(F.col("id").alias("h"), F.col("comp").alias("grp"))
    members = materialise(classes.join(groups, "h").select("h", "key", "grp"), "members")
    counted = members.groupBy("grp").agg(F.count(F.lit(1)).alias("k"))
    sets = _member_sets(docs, members, words).join(members, ["h", "key"])
    exact = _spanning(_paged(sets, "grp", counted), "grp", "tokens", lambda i, n, s: _leaf(i, n, *bitmap(s, 16)), percent, True)
    true = components(materialise(exact, "links")).select(F.col("id").alias("h"), "comp")
    named = classes.join(true, "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(names, "comp").select("h", "component_id"), "named")
    out = rows.select("doc_id", "t", "h", "size").join(named, "h", "left")
    own_name = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t", F.col("size").cast("long").alias("n_shingles"), own_name.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs``, all columns: of every component the row with the least id stays.

    Rows without shingles all stay; of rows with one id in one component, that with the
    least text hash stays, and of equal rows one.
    """
    since = len(CREATED)
    rows = keep_only(components_of(docs, words, percent), "components", since)
    empty = rows.filter("n_shingles = 0").select("doc_id", "t").distinct().withColumn("single", F.lit(False))
    first = rows.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")).alias("own"))
    stay = empty.unionAll(first.select("own.doc_id", "own.t", F.lit(True).alias("single")))
    stay = stay.select(F.col("doc_id").alias("_stay_id"), F.col("t").alias("_stay_t"), F.col("single").alias("_single"))
    t = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(stay.hint("shuffle_merge"), docs["doc_id"].cast("long").eqNullSafe(F.col("_stay_id")) & (t == F.col("_stay_t")))
    repeats = rows.filter("n_shingles > 0").groupBy("doc_id", "t").count().filter("count > 1")
    if repeats.take(1):  # equal rows: keep one of each
        w = W.partitionBy("_stay_id", "_stay_t").orderBy(F.lit(1))
        kept = kept.withColumn("_n", F.row_number().over(w)).filter(~F.col("_single") | (F.col("_n") == 1)).drop("_n")
    return kept.select(*[docs[c] for c in docs.columns])
