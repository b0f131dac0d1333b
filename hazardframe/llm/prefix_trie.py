"""Prefix trie of conversations: sorted shards below a skeleton of splitter paths.

A conversation is a key: the digests of its turns, one after the other. Keys sort as their paths
do in a depth-first walk, so a range of sorted keys holds whole subtrees, but for the nodes on the
paths of the range's ends. Splitters are drawn from the keys (and ids, so a group of copies can
be split); the trie of their paths, the skeleton, is broadcast. A task walks through its sorted shard with
a stack of open nodes and finishes every node off the skeleton. For skeleton nodes it gives partial
aggregates, which are reduced over the shards; what lies between skeleton nodes is summed over
the skeleton itself, whose size is bounded by ``SPLITTER_BYTES``.

Keys hold at most ``WINDOW`` turns. Conversations that go on after a window are put in classes by
their node there, and each class is a trie of its own in the next window; windows are worked from the
last to the first, and a class's totals are carried to its node. A conversation that is alone past a
window needs no trie: its rows are its nodes.

Defined cases: a null role or text counts as empty; null turns sort first; rows of one turn are
taken by role and the text's SHA-256; repeated rows are turns of their own; rows without a
conv_id belong to no conversation; an empty table has no nodes, not even a root; further
columns are ignored, whatever their names. Turns are compared by 128 bits of SHA-256.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.ordering import ranked
from hazardframe.operators.common import is_empty, materialise, small

#: Turns of a key at most.
WINDOW = 512
#: Bytes of all splitter paths together at most; a shard has about so many bytes of keys.
SPLITTER_BYTES, SHARD_BYTES = 4 << 20, 8 << 20
#: Keys drawn for each shard.
DRAWN = 20
_DIGEST = 16
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NAMES = [x.split()[0] for x in NODES.split(", ")]
_NOBODY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest of role and text, bytes of text) of each row."""
    said = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.sha2(said, 256).alias("said"), F.octet_length(said).cast("long").alias("size"),
    )
    rows = ranked(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")])
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length("role"), "role", "said"), 256), 1, 2 * _DIGEST))
    rows = materialise(rows.select("conv_id", "rank", digest.alias("digest"), "size"), "turns")
    first = small(rows.groupBy("conv_id").agg(F.min("rank").alias("_first")))
    return rows.join(first, "conv_id").select("conv_id", (F.col("rank") - F.col("_first") + 1).alias("pos"), "digest", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, size) and lengths (conv_id, n) of the rebuilt conversations.

    The first h turns of conversation c - c % 5, then c's own after its first h; h is the
    checksum of c's decimals modulo 9.
    """
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("_n"))
    own = own.withColumn("_h", F.crc32(F.col("conv_id").cast("string")) % 9).withColumn("_base", F.col("conv_id") - F.col("conv_id") % 5)
    base = own.select(F.col("conv_id").alias("_base"), F.col("_n").alias("_m"))
    info = materialise(own.join(base, "_base", "left").withColumn("_k", F.least("_h", F.coalesce("_m", F.lit(0)))), "lengths")
    kept = turns.join(small(info.select("conv_id", "_h", "_k")), "conv_id").filter("pos > _h").select("conv_id", (F.col("_k") + F.col("pos") - F.col("_h")).alias("depth"), "digest", "size")
    heads = turns.filter("pos <= 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "_base")
    taken = heads.join(info.select("conv_id", "_base", "_k"), "_base").filter("pos <= _k").select("conv_id", F.col("pos").alias("depth"), "digest", "size")
    lengths = info.select("conv_id", (F.col("_k") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).alias("n"))
    return kept.unionByName(taken), lengths


def nodes(turns: DataFrame, lengths: DataFrame, window: int = WINDOW, splitter_bytes: int = SPLITTER_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per node (``NODES``) of the trie of conversations given by turns and lengths."""
    lengths = materialise(lengths, "lengths")
    at = F.floor((F.col("depth") - 1) / window)
    step = F.struct("depth", "digest", "size")
    keys = turns.withColumn("w", at).groupBy("conv_id", "w").agg(F.array_sort(F.collect_list(step)).alias("_s"))
    keys = keys.select("conv_id", "w", F.expr("unhex(array_join(transform(_s, x -> hex(x.digest)), ''))").alias("key"), F.col("_s.size").alias("sizes"))
    first = lengths.filter("n = 0").select("conv_id", F.lit(0).cast("long").alias("w"), F.lit(b"").alias("key"), F.array().cast("array<long>").alias("sizes"))
    keys = materialise(keys.unionByName(first), "keys")
    # Classes of conversations that go on, window by window.
    here = lengths.withColumn("class", F.lit(0).cast("long"))
    rounds, tails = [], []
    while True:
        r = len(rounds)
        now = materialise(keys.filter(F.col("w") == r).drop("w").join(here, "conv_id"), "window")
        rounds.append(now)
        if is_empty(now.filter(F.col("n") > (r + 1) * window)):
            break
        full = now.filter(F.col("n") >= (r + 1) * window).select("conv_id", "n", "class", F.sha2("key", 256).alias("_h"))
        groups = full.groupBy("class", "_h").agg(F.min("conv_id").alias("_c"), F.sum((F.col("n") > (r + 1) * window).cast("long")).alias("_going"))
        groups = small(materialise(groups, "classes"))
        on = full.filter(F.col("n") > (r + 1) * window).join(groups, ["class", "_h"]).select("conv_id", "n", F.col("_c").alias("class"), "_going")
        on = materialise(on, "going")
        tails.append(on.filter("_going = 1").drop("_going"))
        here = on.filter("_going > 1").drop("_going")
        if is_empty(here):
            break
    out, carried = [], None
    for r in reversed(range(len(rounds))):
        if r < len(tails):
            alone = tails[r].select(F.col("class").alias("conv_id"), F.lit(1).cast("long").alias("more"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
            carried = alone if carried is None else carried.unionByName(alone)
            rows = turns.filter(F.col("depth") > (r + 1) * window).join(tails[r], "conv_id")
            last = F.col("depth") == F.col("n")
            out.append(
                rows.select(
                    "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == (r + 1) * window + 1, F.col("class")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                    (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_NOBODY).alias("ends_sha256"),
                )
            )
        found = materialise(_window_nodes(rounds[r], carried, r, window, splitter_bytes, shard_bytes), "nodes")
        # A class is one more step at the start of its keys; its node's totals go to the window before.
        carried = found.filter("depth < 0").select("conv_id", F.col("n_children").alias("more"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        out.append(found.filter("depth >= 0"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _window_nodes(now: DataFrame, carried: DataFrame | None, r: int, window: int, splitter_bytes: int, shard_bytes: int) -> DataFrame:
    """Nodes of one window; class nodes have depth -1 and their class as conv_id."""
    rows = now.withColumn("goes_on", F.col("n") > (r + 1) * window)
    if carried is not None:
        rows = rows.join(small(carried), "conv_id", "left")
    else:
        rows = rows.select("*", *[F.lit(None).cast("long").alias(c) for c in ("more", "leaves", "saved")])
    if r:  # eight bytes that keep the order of ids, and eight more
        lead = F.unhex(F.lpad(F.hex(F.col("class").bitwiseXOR(F.lit(-(1 << 63)))), 2 * _DIGEST, "0"))
        rows = rows.withColumn("key", F.concat(lead, "key")).withColumn("sizes", F.concat(F.array(F.lit(0).cast("long")), "sizes"))
    rows = materialise(rows.select("conv_id", "key", "sizes", "goes_on", "more", "leaves", "saved"), "keyed")
    splitters = _splitters(rows, splitter_bytes, shard_bytes)
    skeleton = Skeleton([k for k, _ in splitters])
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((splitters, skeleton.ids))
    depth_of = r * window - 1 if r else 0

    def dealt(batches):
        ends = shared.value[0]
        for b in batches:
            shard = [bisect.bisect_right(ends, x) for x in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], names=["shard", *b.schema.names])

    def walked(batches):
        walk = _Walk(shared.value[1], depth_of, bool(r))
        yield from walk.run(batches)

    schema = "shard int, conv_id long, key binary, sizes array<long>, goes_on boolean, more long, leaves long, saved long"
    n_shards = len(splitters) + 1
    sharded = rows.mapInArrow(dealt, schema).repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "key", "conv_id")
    made = materialise(sharded.mapInArrow(walked, _MADE), "walked")
    own = made.filter("skeleton < 0").drop("skeleton", "shard", "ends", "size")
    partial = made.filter("skeleton >= 0")
    reduced = partial.groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("size").alias("size"))
    top = skeleton.finished({x["skeleton"]: x for x in reduced.collect()}, depth_of, bool(r))  # bounded: nodes of the splitters' paths
    ends = partial.filter("ends IS NOT NULL").select("skeleton", "shard", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "shard")
    hashes = ends.mapInArrow(_ends_hash, "skeleton int, ends_sha256 string")
    kept = "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    top = spark.createDataFrame(top, kept)
    names = small(top.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("_name")))
    own = own.join(names, "parent_skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_name")).select(*NAMES)
    top = top.join(hashes, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOBODY))).filter("depth > -2").select(*NAMES)
    return own.unionByName(top)


def _splitters(rows: DataFrame, splitter_bytes: int, shard_bytes: int) -> list[tuple[bytes, int]]:
    """Ordered (key, conv_id) at which shards start, drawn by a checksum of the ids."""
    n, size, longest = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("key") + 64), F.lit(0)), F.max(F.length("key"))).first()
    shards = -(-size // shard_bytes)
    if shards < 2:
        return []
    want = min(DRAWN * shards, max(1, 4 * splitter_bytes // max(1, longest)))
    share = min(1 << 30, max(1, (want << 30) // n))
    drawn = rows.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < share).select("key", "conv_id").collect()
    drawn = sorted((bytes(x["key"]), x["conv_id"]) for x in drawn)
    count = min(shards - 1, len(drawn))
    picked = sorted({drawn[(i + 1) * len(drawn) // (count + 1)] for i in range(count)})
    while sum(len(k) for k, _ in picked) > splitter_bytes:
        picked = picked[1::2]
    return picked


class Skeleton:
    """The trie of the splitters' paths: ids by (parent's id, digest); the root is 0."""

    def __init__(self, keys: list[bytes]):
        self.ids: dict[tuple[int, bytes], int] = {}
        self.parent, self.level, self.step = [-1], [0], [b""]
        for key in keys:
            at = 0
            for i in range(0, len(key), _DIGEST):
                step = (at, key[i : i + _DIGEST])
                if step not in self.ids:
                    self.ids[step] = len(self.parent)
                    self.parent.append(at)
                    self.level.append(i // _DIGEST + 1)
                    self.step.append(step[1])
                at = self.ids[step]

    def finished(self, partial: dict, depth_of: int, classes: bool) -> list[tuple]:
        """Rows of the skeleton's nodes: what shards gave, and sums over the skeleton from its leaves up."""
        if not partial:
            return []
        n = len(self.parent)
        children, leaves, saved, ids = [0] * n, [0] * n, [0] * n, [None] * n
        for i in range(1, n):
            children[self.parent[i]] += 1
        for i in reversed(range(n)):  # a child's id is larger than its parent's
            x = partial[i]
            children[i] += x["n_children"]
            leaves[i] += x["n_leaves"] + (children[i] == 0)
            saved[i] += x["saved_tokens"] + (x["n_convs"] - 1) * x["size"]
            is_class = classes and self.level[i] == 1
            ids[i] = class_id(self.step[i]) if is_class else x["conv_id"]
            if i:
                leaves[self.parent[i]] += leaves[i]
                saved[self.parent[i]] += saved[i]
        out = []
        for i in range(n):
            depth = -2 if classes and not i else -1 if classes and self.level[i] == 1 else depth_of + self.level[i]
            out.append((i, ids[i], depth, ids[self.parent[i]] if i else None, partial[i]["n_convs"], children[i], leaves[i], saved[i]))
        return out


def class_id(step: bytes) -> int:
    return int.from_bytes(step[-8:], "big") - (1 << 63)


_MADE = f"{NODES}, parent_skeleton int, skeleton int, shard int, ends string, size long"
_MADE_NAMES = [x.split()[0] for x in _MADE.split(", ")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


class _Node:
    __slots__ = ("level", "skeleton", "step", "size", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, level: int, skeleton: int, step: bytes, size: int):
        self.level, self.skeleton, self.step, self.size = level, skeleton, step, size
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[str] = []
        self.waiting: list[list] = []

    def member(self, conv_id: int, n: int) -> None:
        self.n += n
        self.least = conv_id if self.least is None else min(self.least, conv_id)


class _Walk:
    """A walk through sorted shards with a stack of open nodes.

    Rows of a node's children wait for the node's smallest member, which is known when it is left;
    children of skeleton nodes don't wait. A node off the skeleton lies in one shard, and so do they.
    """

    def __init__(self, ids: dict, depth_of: int, classes: bool):
        self.ids, self.depth_of, self.classes = ids, depth_of, classes
        self.out: list[list] = []

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Node] = []
        before, shard = b"", None
        for b in batches:
            for s, conv_id, key, sizes, goes_on, more, leaves, saved in zip(*[c.to_pylist() for c in b.columns]):
                if s != shard:
                    while stack:
                        self._leave(stack, shard)
                    stack, before, shard = [_Node(0, 0, b"", 0)], b"", s
                level = self._shared(before, key)
                while stack[-1].level > level:
                    self._leave(stack, shard)
                for i in range(level, len(key) // _DIGEST):
                    step = key[i * _DIGEST : (i + 1) * _DIGEST]
                    up = stack[-1].skeleton
                    stack.append(_Node(i + 1, self.ids.get((up, step), -1) if up >= 0 else -1, step, sizes[i]))
                own, before = stack[-1], key
                own.member(conv_id, 1)
                if not goes_on:
                    own.ends.append(str(conv_id))
                if more:
                    own.children += more
                    own.leaves += leaves
                    own.saved += saved
                if len(self.out) >= 5000:
                    yield self._batch()
        while stack:
            self._leave(stack, shard)
        yield self._batch()

    @staticmethod
    def _shared(a: bytes, b: bytes) -> int:
        """Steps that two keys begin with alike."""
        n = min(len(a), len(b)) // _DIGEST
        if a[: n * _DIGEST] == b[: n * _DIGEST]:
            return n
        lo, hi = 0, n - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if a[: mid * _DIGEST] == b[: mid * _DIGEST]:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def _leave(self, stack: list[_Node], shard: int) -> None:
        node = stack.pop()
        up = stack[-1] if stack else None
        if node.skeleton >= 0:
            self.out.append([node.least, -1, None, node.n, node.children, node.leaves, node.saved, None, None, node.skeleton, shard, ",".join(node.ends) or None, node.size])
            if up:
                up.member(node.least, node.n)  # leaves and savings are summed over the skeleton later
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.size
        is_class = self.classes and node.level == 1
        name = class_id(node.step) if is_class else node.least
        for row in node.waiting:
            row[2] = name
            self.out.append(row)
        sha = hashlib.sha256(",".join(node.ends).encode()).hexdigest() if node.ends else _NOBODY
        row = [name, -1 if is_class else self.depth_of + node.level, None, node.n, node.children, leaves, saved, sha, up.skeleton if up.skeleton >= 0 else None, -1, None, None, None]
        up.member(node.least, node.n)
        up.children += 1
        up.leaves += leaves
        up.saved += saved
        if up.skeleton >= 0:
            self.out.append(row)
        else:
            up.waiting.append(row)

    def _batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = zip(*rows) if rows else [[] for _ in _MADE_NAMES]
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[x.split()[1]]) for c, x in zip(columns, _MADE.split(", "))], names=_MADE_NAMES)


def _ends_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the ids that end at skeleton nodes, from their pieces in shard order."""
    out, node, sha = [], None, None
    for b in batches:
        for skeleton, ends in zip(b.column("skeleton").to_pylist(), b.column("ends").to_pylist()):
            if skeleton != node:
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = skeleton, hashlib.sha256(ends.encode())
            else:
                sha.update(b"," + ends.encode())
    if node is not None:
        out.append((node, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.string())], names=["skeleton", "ends_sha256"])
