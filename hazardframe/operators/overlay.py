"""Hourly routing over an overlay of the road network.

The network is cut into parts. Border nodes are those with an edge to another part; an overlay arc leads
from a border node to the next ones, at the cost of the cheapest way inside the part. Arcs of a part that a run's fire never touches are found once and
serve every run and hour; where the fire changes costs, arcs are found once per stretch of hours with equal
costs, and neighbouring stretches with equal arcs are joined. So edges and arcs carry a span
of hours and are never copied per hour.

Refuges first label the borders of their own parts. The overlay then spreads these labels, by groups
of parts: a group takes the labels it has, settles them and passes improved ones on over the edges
between groups. Every round appends improved labels and nothing else; the least of a node's labels
is its label. At the end each part is filled once from its refuges and its neighbours' borders.
Hours at which a part has equal costs and equal labels to start from are settled once.

Costs are whole nanometres, so sums do not depend on their order and ties are exact.
"""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.functions import geo
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import attach_all, global_rank, is_empty, materialise, materialise_observed
from hazardframe.operators.network import EDGE, cut_edges, fire_distance, hops

#: Nodes of a part, and parts of a group that settles overlay labels in one task.
PART_NODES, GROUP_PARTS = 500, 200
#: Tasks that share the hours of one group.
SLOTS = 4
#: Hours before and after all others.
EVER, NEVER = -(1 << 31), 1 << 31
UNIT = 1e9
_OWN = float("-inf")  # a refuge's own label has no next hop and sorts first


def units(cost: Column) -> Column:
    return F.round(cost * UNIT).cast("long")


def edge_spans(edges: DataFrame, arrival: DataFrame, grid: Grid, keys: list[str], cuts: DataFrame | None = None) -> DataFrame:
    """(keys, u, v, key, a, b, cost, length_m): costs from hour a until before b of edges that a fire changes.

    Hours from which an edge is cut have no span. Other edges cost their length at all hours.
    """
    cut = cut_edges(edges, arrival, grid, keys) if cuts is None else cuts
    steps = fire_distance(edges, arrival, grid, keys)
    known = steps.select(*keys, *EDGE, F.col("period").cast("long").alias("a"), "dist_m")
    touched = known.select(*keys, *EDGE).unionByName(cut.select(*keys, *EDGE)).distinct()
    first = touched.select(*keys, *EDGE, F.lit(EVER).cast("long").alias("a"), F.lit(None).cast("double").alias("dist_m"))
    w = W.partitionBy(*keys, *EDGE).orderBy("a")  # as many rows as an edge's cost has steps
    spans = known.unionByName(first).withColumn("b", F.coalesce(F.lead("a").over(w), F.lit(NEVER)))
    spans = spans.join(cut, [*keys, *EDGE], "left").withColumn("b", F.least("b", F.coalesce("cut_at", F.lit(NEVER))))
    spans = spans.filter("a < b").join(edges.select(*EDGE, "length_m"), EDGE)
    return spans.select(*keys, *EDGE, "a", "b", units(geo.friction("length_m", F.col("dist_m"))).alias("cost"), "length_m")


def at_hours(edges: DataFrame, spans: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Shortest length of the wanted (keys, period, u, v) hops among the edges open at their hour."""
    hop = [*keys, "period", "u", "v"]
    wanted = wanted.select(*hop).distinct()
    changed = spans.select(*keys, *EDGE).distinct()
    plain = wanted.join(edges.select(*EDGE, "length_m"), ["u", "v"]).join(changed, [*keys, *EDGE], "left_anti")
    near = wanted.join(spans, [*keys, "u", "v"]).filter("a <= period AND period < b")
    return plain.select(*hop, "length_m").unionByName(near.select(*hop, "length_m")).groupBy(*hop).agg(F.min("length_m").alias("length_m"))


def network_parts(nodes: DataFrame, size: int = PART_NODES, group: int = GROUP_PARTS) -> DataFrame:
    """(node, part, grp): neighbouring nodes together, about ``size`` to a part however they crowd.

    Nodes are dealt by x to strips and by y within a strip. The number of strips follows the network's
    own proportions, so parts are about as wide as high and have few border nodes even in a long and
    narrow network. A group is a block of neighbouring parts of neighbouring strips.
    """
    at = nodes.select(F.col("node_id").cast("long").alias("node"), "x", "y")
    n, wide, high = nodes.agg(F.count(F.lit(1)), F.stddev_pop("x"), F.stddev_pop("y")).first()
    parts = max(1.0, n / size)
    strips = round((parts * (wide or 0.0) / high) ** 0.5) if high else round(parts)
    strips = min(max(1, strips), max(1, round(parts)))
    by_x = global_rank(at, [F.col("x"), F.col("y"), F.col("node")], "_rx").withColumn("_strip", F.floor((F.col("_rx") - 1) * strips / max(1, n)))
    by_y = global_rank(by_x, [F.col("_strip"), F.col("y"), F.col("x"), F.col("node")], "_ry")
    part = F.floor((F.col("_ry") - 1) / size)
    # A block is about as many parts wide as high; where there are fewer strips, it is higher.
    across = min(strips, max(1, round(group ** 0.5)))
    blocks = -(-strips // across)
    tall = max(1, group // across)
    first = F.floor(F.col("_strip") * n / strips / size)
    grp = F.floor((part - first) / tall) * blocks + F.floor(F.col("_strip") / across)
    placed = materialise(by_y.select("node", part.alias("part"), grp.alias("grp")), "parts")
    # A part that reaches into the next strip belongs to one group.
    own = placed.groupBy("part").agg(F.min("grp").alias("grp"))
    return materialise(placed.select("node", "part").join(own, "part").select("node", "part", "grp"), "parts")


def _spread(labels: dict[int, tuple], fresh: list[int], out: dict[int, list], hour: int) -> set[int]:
    """Settles fresh labels along (to, cost, a, b) links; returns the nodes whose labels got better."""
    heap, moved = [(labels[n], n) for n in fresh], set()
    heapq.heapify(heap)
    while heap:
        label, n = heapq.heappop(heap)
        if label != labels[n]:
            continue
        for to, cost, a, b in out.get(n, ()):
            if a <= hour < b:
                new = (label[0] + cost, label[1], n)
                if to not in labels or new < labels[to]:
                    labels[to] = new
                    moved.add(to)
                    heapq.heappush(heap, (new, to))
    return moved


def _links(e: pd.DataFrame) -> dict[int, list]:
    """Links against the direction of travel: labels run from a refuge to the places that can reach it."""
    out: dict[int, list] = {}
    for u, v, cost, a, b in zip(e["u"].tolist(), e["v"].tolist(), e["cost"].tolist(), e["a"].tolist(), e["b"].tolist()):
        out.setdefault(v, []).append((u, cost, a, b))
    return out


def _ways(links: dict[int, list], marked: list[int]) -> list[tuple]:
    """(u, v, a, b, cost): cheapest ways between marked nodes that meet no other, by stretch of hours."""
    cuts = sorted({x for own in links.values() for _, _, a, b in own for x in (a, b)} | {EVER})
    cuts = [c for c in cuts if c < NEVER]
    stop, found = set(marked), {}
    for hour, until in zip(cuts, [*cuts[1:], NEVER]):
        for s in marked:
            best, heap = {s: 0}, [(0, s)]
            while heap:
                d, n = heapq.heappop(heap)
                if d > best[n] or (n in stop and n != s):
                    continue
                for to, cost, a, b in links.get(n, ()):
                    if a <= hour < b and d + cost < best.get(to, 1 << 62):
                        best[to] = d + cost
                        heapq.heappush(heap, (d + cost, to))
            for t, d in best.items():
                if t in stop and t != s:
                    own = found.setdefault((t, s), [])
                    if own and own[-1][1] == hour and own[-1][2] == d:
                        own[-1][1] = until
                    else:
                        own.append([hour, until, d])
    return [(u, v, a, b, d) for (u, v), own in found.items() for a, b, d in own]


_LINK = "part long, u long, v long, a long, b long, cost long"


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by group over all cores; adaptive execution would put small tables into one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.toDF(*df.columns).repartition(n, *keys)


def _cogrouped(left: DataFrame, right: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    return _dealt(left, keys).groupBy(*keys).cogroup(_dealt(right, keys).groupBy(*keys)).applyInPandas(fn, schema)


class Overlay:
    """A network under the fires of many runs: spans of its changed edges, parts, border nodes (``marks``) and arcs."""

    def __init__(self, edges: DataFrame, spans: DataFrame, parts: DataFrame, keys: list[str]):
        self.keys, self.parts = keys, parts
        here, there = (parts.select(F.col("node").alias(c), F.col("part").alias(f"_p{c}"), F.col("grp").alias(f"_g{c}")) for c in ("u", "v"))
        place = ["_pu", "_gu", "_pv", "_gv"]
        plain = edges.select(*EDGE, F.lit(EVER).cast("long").alias("a"), F.lit(NEVER).cast("long").alias("b"), units(F.col("length_m").cast("double")).alias("cost"))
        self.plain = materialise(plain.join(here, "u").join(there, "v"), "plain-edges")
        self.changed = materialise(spans.select(*keys, *EDGE, "a", "b", "cost").join(here, "u").join(there, "v"), "changed-edges")
        self.touched = materialise(self.changed.filter("_pu = _pv").select(*keys, F.col("_pu").alias("part")).distinct(), "touched")
        border = self.plain.filter("_pu <> _pv")
        marks = border.select(F.col("u").alias("node")).union(border.select("v"))
        self.marks = materialise(marks.distinct().join(parts, "node"), "marks")
        self.place = place
        self._arcs()

    def own_edges(self, where: str, runs: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
        """Edges of given runs (or parts of runs): changed ones by their spans, others as they are."""
        kept = self.plain.filter(where)
        if on:
            kept = kept.withColumn("part", F.col("_pu")).join(runs, on)
        else:
            kept = attach_all(kept, runs)
        kept = kept.join(self.changed.select(*self.keys, *EDGE).distinct(), [*self.keys, *EDGE], "left_anti")
        changed = self.changed.filter(where).filter("a < b")
        columns = [*self.keys, "u", "v", "a", "b", "cost", *self.place]
        return kept.select(*columns).unionByName(changed.select(*columns))

    def _arcs(self) -> None:
        keys = self.keys

        def ways(key: tuple, e: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
            rows = [(*key, *x) for x in _ways(_links(e), sorted(m["node"].tolist()))] if len(e) and len(m) else []
            return pd.DataFrame(rows, columns=[*names[: len(key)], "u", "v", "a", "b", "cost"])

        names = ["part"]
        inner = self.plain.filter("_pu = _pv").select(F.col("_pu").alias("part"), "u", "v", "a", "b", "cost")
        self.common = materialise(_cogrouped(inner, self.marks, ["part"], ways, _LINK), "arcs")
        names = [*keys, "part"]
        kinds = dict(self.touched.dtypes)
        own = self.own_edges("_pu = _pv", self.touched, ["part"]).withColumn("part", F.col("_pu"))
        own = own.join(self.touched, [*keys, "part"], "left_semi").select(*keys, "part", "u", "v", "a", "b", "cost")
        marks = self.marks.join(self.touched, "part").select(*keys, "part", "node")
        schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), _LINK])
        self.special = materialise(_cogrouped(own, marks, names, ways, schema), "arcs")

    def inner(self, runs: DataFrame) -> DataFrame:
        """(keys, part, u, v, a, b, cost): edges inside parts."""
        return materialise(self.own_edges("_pu = _pv", runs).select(*self.keys, F.col("_pu").alias("part"), "u", "v", "a", "b", "cost"), "inner-edges")

    def links(self, runs: DataFrame) -> DataFrame:
        """(keys, grp, u, v, a, b, cost, _gu, _gv): arcs and edges between parts."""
        keys = self.keys
        common = attach_all(self.common, runs).join(self.touched, [*keys, "part"], "left_anti").select(*keys, "part", "u", "v", "a", "b", "cost")
        arcs = common.unionByName(self.special.select(*keys, "part", "u", "v", "a", "b", "cost"))
        groups = self.parts.select("part", "grp").distinct()
        arcs = arcs.join(groups, "part").select(*keys, "u", "v", "a", "b", "cost", F.col("grp").alias("_gu"), F.col("grp").alias("_gv"))
        cross = self.own_edges("_pu <> _pv", runs).select(*keys, "u", "v", "a", "b", "cost", "_gu", "_gv")
        return arcs.unionByName(cross)


def _label_table(rows: pd.DataFrame) -> dict[int, dict[int, tuple]]:
    """By hour, the least label of each node."""
    out: dict[int, dict[int, tuple]] = {}
    hops = [_OWN if pd.isna(h) else int(h) for h in rows["next_hop"].tolist()]
    for hour, n, c, r, h in zip(rows["period"].tolist(), rows["node"].tolist(), rows["cost"].tolist(), rows["refuge_id"].tolist(), hops):
        own = out.setdefault(hour, {})
        new = (c, r, h)
        if n not in own or new < own[n]:
            own[n] = new
    return out


_COLUMNS = ["period", "node", "cost", "refuge_id", "next_hop"]


def _frame(head: list[str], rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(*r[:-1], None if r[-1] == _OWN else r[-1]) for r in rows], columns=[*head, *_COLUMNS])
    return out.astype({"next_hop": "Int64"})


def route(overlay: Overlay, seeds: DataFrame) -> DataFrame:
    """(keys, period, node, cost, refuge_id, next_hop): each node's cheapest refuge at each hour with seeds.

    ``seeds`` has keys, period, node_id, refuge_id. Labels are (cost, refuge, next hop); costs in metres.
    """
    keys = overlay.keys
    least = seeds.groupBy(*keys, F.col("period").cast("long").alias("period"), F.col("node_id").cast("long").alias("node")).agg(F.min("refuge_id").cast("long").alias("refuge_id"))
    own = least.join(overlay.parts, "node").withColumn("cost", F.lit(0).cast("long")).withColumn("next_hop", F.lit(None).cast("long"))
    own = materialise(own, "seeds")
    inner = overlay.inner(own.select(*keys).distinct())
    within = [*keys, "part"]
    entry = _settled(inner, own.select(*within, *_COLUMNS), within)
    entry = entry.join(overlay.marks.select("node", "grp"), "node").select(*keys, "grp", *_COLUMNS)
    labels = overlay_labels(overlay, materialise(entry, "entry"))
    cross = overlay.own_edges("_pu <> _pv", labels.select(*keys).distinct()).select(*keys, F.col("v").alias("node"), "u", "a", "b", "cost", F.col("_pu").alias("part"))
    over = labels.withColumnRenamed("cost", "_c").select(*keys, "period", "node", "_c", "refuge_id").join(cross, [*keys, "node"]).filter("a <= period AND period < b")
    offer = F.struct((F.col("_c") + F.col("cost")).alias("cost"), "refuge_id", F.col("node").alias("next_hop"))
    over = over.select(*within, "period", F.col("u").alias("node"), offer.alias("o")).groupBy(*within, "period", "node").agg(F.min("o").alias("o"))
    begin = over.select(*within, "period", "node", "o.*").unionByName(own.select(*within, *_COLUMNS))
    full = _settled(inner, begin, within)
    return materialise(full.select(*keys, "period", "node", (F.col("cost") / UNIT).alias("cost"), "refuge_id", "next_hop"), "routes")


def _settled(inner: DataFrame, begin: DataFrame, within: list[str]) -> DataFrame:
    """Labels that spread inside parts from those to begin with."""
    kinds = dict(begin.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in within), "period long, node long, cost long, refuge_id long, next_hop long"])

    def settle(key: tuple, e: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out, rows, done = _links(e), [], {}
        cuts = sorted({*e["a"].tolist(), *e["b"].tolist()})
        for hour, own in _label_table(held).items():
            same = (bisect.bisect_right(cuts, hour), frozenset(own.items()))
            if same not in done:
                _spread(own, list(own), out, hour)
                done[same] = own
            rows += [(*key, hour, n, *x) for n, x in done[same].items()]
        return _frame(within, rows)

    return _cogrouped(inner, begin, within, settle, schema)


def overlay_labels(overlay: Overlay, start: DataFrame) -> DataFrame:
    """Labels of border nodes (next hop: the border node before) from those that parts begin with."""
    keys, node = overlay.keys, [*overlay.keys, "period", "node"]
    runs = start.select(*keys).distinct()
    links = overlay.links(runs)
    inside = links.filter("_gu = _gv").select(*keys, F.col("_gv").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"), "u", "v", "a", "b", "cost")
    inside = materialise(inside, "links")
    between = materialise(links.filter("_gu <> _gv").select(*keys, F.col("v").alias("node"), "u", "a", "b", "cost", F.col("_gu").alias("grp")), "links")
    group = [*keys, "grp", "slot"]
    slot = F.pmod(F.col("period"), F.lit(SLOTS)).cast("int").alias("slot")
    kinds = dict(inside.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in group), "period long, node long, cost long, refuge_id long, next_hop long"])

    def settle(key: tuple, e: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out, rows = _links(e), []
        known = _label_table(held[~held["fresh"]])
        for hour, new in _label_table(held[held["fresh"]]).items():
            own = known.get(hour, {})
            better = [n for n, x in new.items() if n not in own or x < own[n]]
            own.update({n: new[n] for n in better})
            moved = _spread(own, better, out, hour) | set(better)
            rows += [(*key, hour, n, *own[n]) for n in moved]
        return _frame(group, rows)

    fresh = start.select(*keys, "grp", slot, *_COLUMNS)
    settled: list[DataFrame] = []
    while True:
        active = fresh.select(*group).distinct()
        held = fresh.withColumn("fresh", F.lit(True))
        for before in settled:
            held = held.unionByName(before.join(active, group, "left_semi").withColumn("fresh", F.lit(False)))
        now = _cogrouped(inside.join(active, group, "left_semi"), held, group, settle, schema)
        now = materialise(now, "labels")
        settled.append(now)
        over = now.withColumnRenamed("cost", "_c").drop("grp", "next_hop").join(between, [*keys, "node"]).filter("a <= period AND period < b")
        offer = F.struct((F.col("_c") + F.col("cost")).alias("cost"), "refuge_id", F.col("node").alias("next_hop"))
        offers = over.select(*group, "period", F.col("u").alias("node"), offer.alias("o")).groupBy(*group, "period", "node").agg(F.min("o").alias("o"))
        offers = offers.select(*group, "period", "node", "o.*")
        # Only offers that beat what the node has go on.
        known = settled[0]
        for more in settled[1:]:
            known = known.unionByName(more)
        known = known.groupBy(*node).agg(F.min(F.struct("cost", "refuge_id", "next_hop")).alias("_k"))
        offers = offers.join(known, node, "left").filter(F.col("_k").isNull() | (F.struct("cost", "refuge_id") < F.struct("_k.cost", "_k.refuge_id")))
        fresh, found = materialise_observed(offers.drop("_k"), "labels", n=F.count(F.lit(1)))
        if not found["n"]:
            known = settled[0]
            for more in settled[1:]:
                known = known.unionByName(more)
            known = known.groupBy(*group, "period", "node").agg(F.min(F.struct("cost", "refuge_id", "next_hop")).alias("_k"))
            return materialise(known.select(*keys, "grp", "period", "node", "_k.*"), "border-labels")


def shortest_path(edges: DataFrame, nodes: DataFrame, src: int, dst: int) -> DataFrame:
    """Shortest path by length between two nodes as ordered hops (seq, u, v, length_m); empty when disconnected.

    The target is the only refuge of one hour without fire, so parts are settled whole and the rounds follow
    groups of parts, not the hops of the path; the path itself is followed by doubling.
    """
    spark, key = edges.sparkSession, ["run_id", "period"]
    edges = materialise(edges.select(*EDGE, "length_m"), "edges")
    run = spark.range(1).select(F.lit(0).cast("long").alias("run_id"), F.lit(0).cast("long").alias("period"))
    spans = edges.limit(0).select(F.lit(0).cast("long").alias("run_id"), *EDGE, F.lit(EVER).cast("long").alias("a"), F.lit(NEVER).cast("long").alias("b"), units(F.col("length_m").cast("double")).alias("cost"))
    target = run.select(*key, F.lit(dst).cast("long").alias("node_id"), F.lit(dst).cast("long").alias("refuge_id"))
    routes = route(Overlay(edges, spans, network_parts(nodes), ["run_id"]), target)
    origin = run.select(*key, F.lit(src).cast("long").alias("origin_id"), F.lit(src).cast("long").alias("node"))
    path = materialise(hops(routes, origin, key), "steps")
    length = edges.join(path.select("u", "v"), ["u", "v"], "left_semi").groupBy("u", "v").agg(F.min("length_m").alias("length_m"))
    return path.join(length, ["u", "v"]).select("origin_id", "seq", "u", "v", "length_m")


# One hour from the hour before


def still_valid(overlay: Overlay, before: DataFrame, seeds: DataFrame, inner: DataFrame, cross: DataFrame) -> DataFrame:
    """Labels of the hour before whose whole way stands unchanged, now at the hour of ``seeds``.

    ``before`` has keys, node, cost (units), refuge_id, next_hop and the new ``period``. A label's
    first step is sound if the edge still costs the difference of the two labels, or if its own refuge
    is still open. Unsound labels spoil all whose way leads over them; ways are followed by doubling.
    """
    keys, node = overlay.keys, [*overlay.keys, "node"]
    both = inner.select(*keys, "u", "v", "a", "b", "cost").unionByName(cross.select(*keys, F.col("node").alias("v"), "u", "a", "b", "cost").select(*keys, "u", "v", "a", "b", "cost"))
    there = before.select(*keys, F.col("node").alias("next_hop"), F.col("cost").alias("_there"))
    steps = before.filter("next_hop IS NOT NULL").join(there, [*keys, "next_hop"])
    price = both.withColumnRenamed("cost", "_edge").withColumnsRenamed({"u": "node", "v": "next_hop"})
    now = steps.join(price, [*node, "next_hop"]).filter("a <= period AND period < b").groupBy(*node, "period", "refuge_id", "next_hop", "cost", "_there").agg(F.min("_edge").alias("_edge"))
    kept = now.filter("cost - _there = _edge").select(*node, F.col("next_hop").alias("to"))
    roots = before.filter("next_hop IS NULL").join(seeds.select(*keys, F.col("node_id").cast("long").alias("node"), F.col("refuge_id").cast("long").alias("refuge_id")), [*node, "refuge_id"])
    # A sound root leads to itself; a chain is sound when it ends at one.
    ahead = materialise(kept.withColumn("done", F.lit(False)).unionByName(roots.select(*node, F.col("node").alias("to"), F.lit(True).alias("done"))), "ahead")
    while True:
        second = ahead.select(*keys, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("done").alias("_done"))
        ahead, open_ = materialise_observed(
            ahead.join(second, [*keys, "to"]).select(*node, F.when(F.col("done"), F.col("to")).otherwise(F.col("_to")).alias("to"), (F.col("done") | F.col("_done")).alias("done")),
            "ahead", n=F.count_if(~F.col("done")))
        if not open_["n"]:  # chains over an unsound label have dropped out
            return materialise(before.join(ahead.select(*node), node, "left_semi"), "valid-labels")


def next_hour(overlay: Overlay, before: DataFrame, seeds: DataFrame) -> DataFrame:
    """Routes of one hour, as ``route`` gives them, from those of an hour before it.

    Costs must not fall in between, as under a growing fire. Labels that lost their way are
    dropped; parts with such nodes or a newly open refuge are settled anew from the labels that stand, and
    pass better ones on to their neighbours until none is better.
    """
    keys, within, node = overlay.keys, [*overlay.keys, "part"], [*overlay.keys, "node"]
    runs = seeds.select(*keys, F.col("period").cast("long").alias("period")).distinct()
    inner = overlay.inner(runs.select(*keys))
    cross = overlay.own_edges("_pu <> _pv", runs.select(*keys)).select(*keys, F.col("v").alias("node"), "u", "a", "b", "cost", F.col("_pu").alias("part"))
    cross = materialise(cross, "cross-edges")
    old = before.drop("period").join(runs, keys).select(*node, "period", units(F.col("cost")).alias("cost"), "refuge_id", "next_hop")
    old = materialise(old.join(overlay.parts.select("node", "part"), "node"), "before")
    valid = still_valid(overlay, old, seeds, inner, cross)
    lost = old.join(valid.select(*node), node, "left_anti").select(*within)
    own = seeds.groupBy(*keys, F.col("period").cast("long").alias("period"), F.col("node_id").cast("long").alias("node")).agg(F.min("refuge_id").cast("long").alias("refuge_id"))
    own = own.join(overlay.parts.select("node", "part"), "node").select(*within, "period", "node", F.lit(0).cast("long").alias("cost"), "refuge_id", F.lit(None).cast("long").alias("next_hop"))
    # A node's closed refuge may have hidden another one there.
    opened = own.join(valid.filter("next_hop IS NULL").select(*node, "refuge_id"), [*node, "refuge_id"], "left_anti")
    opened = materialise(opened.select(*within, *_COLUMNS), "opened")
    labels = [valid.select(*within, *_COLUMNS), opened]
    active = materialise(lost.unionByName(opened.select(*within)).distinct(), "active")
    while not is_empty(active):
        known = _least(labels, [*within, "period", "node"])
        # What neighbours offer is taken anew from all labels at the edges of the active parts.
        over = known.withColumnRenamed("cost", "_c").drop("part", "next_hop").join(cross.join(active, within, "left_semi"), node).filter("a <= period AND period < b")
        offer = F.struct((F.col("_c") + F.col("cost")).alias("cost"), "refuge_id", F.col("node").alias("next_hop"))
        offers = over.select(*within, "period", F.col("u").alias("node"), offer.alias("o")).groupBy(*within, "period", "node").agg(F.min("o").alias("o")).select(*within, "period", "node", "o.*")
        begin = known.join(active, within, "left_semi").select(*within, *_COLUMNS).unionByName(offers.select(*within, *_COLUMNS))
        full = _settled(inner.join(active, within, "left_semi"), begin, within)
        had = known.select(*node, "period", F.struct("cost", "refuge_id", "next_hop").alias("_k"))
        mine = F.struct("cost", "refuge_id", "next_hop")
        better = full.join(had, [*node, "period"], "left").filter(F.col("_k").isNull() | (mine < F.col("_k"))).drop("_k")
        better = materialise(better.select(*within, *_COLUMNS), "better")
        labels.append(better)
        # Parts that a better label reaches and improves are next.
        out = better.withColumnRenamed("cost", "_c").drop("part", "next_hop").join(cross, node).filter("a <= period AND period < b")
        reach = out.select(*within, "period", F.col("u").alias("node"), F.struct((F.col("_c") + F.col("cost")).alias("cost"), "refuge_id", F.col("node").alias("next_hop")).alias("o"))
        now = _least(labels, [*within, "period", "node"]).select(*node, "period", F.struct("cost", "refuge_id", "next_hop").alias("_k"))
        active = materialise(reach.join(now, [*node, "period"], "left").filter(F.col("_k").isNull() | (F.col("o") < F.col("_k"))).select(*within).distinct(), "active")
    whole = _least(labels, [*within, "period", "node"])
    return materialise(whole.select(*keys, "period", "node", (F.col("cost") / UNIT).alias("cost"), "refuge_id", "next_hop"), "routes")


def _least(labels: list[DataFrame], keys: list[str]) -> DataFrame:
    whole = labels[0]
    for more in labels[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy(*keys).agg(F.min(F.struct("cost", "refuge_id", "next_hop")).alias("_l")).select(*keys, "_l.*")
