"""Road network under fire: cut edges, friction costs, refuge routing for every hour.

An edge table has u, v, key, length_m and its line as x1, y1, x2, y2. Fire enters as an
arrival table, so one plan keyed by hour answers every period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.functions import geo
from hazardframe.operators.cells import Grid, ever_boundary
from hazardframe.operators.common import attach_all, materialise, materialise_observed
from hazardframe.operators.spatial import _bucketed, cell_distance

EDGE = ["u", "v", "key"]


def segment_cells(segs: DataFrame, grid: Grid, keep: list[str]) -> DataFrame:
    """Every cell a segment meets, touching included (column by column)."""
    fx = lambda x: (F.col(x) - grid.x0) / grid.cell
    fy = lambda y: (F.lit(grid.y_top) - F.col(y)) / grid.cell
    s = segs.select(*keep, fx("x1").alias("_a"), fy("y1").alias("_b"), fx("x2").alias("_c"), fy("y2").alias("_d"))
    s = s.withColumn("c", F.explode(F.sequence(F.ceil(F.least("_a", "_c")) - 1, F.floor(F.greatest("_a", "_c")))))
    lo, hi = F.greatest(F.least("_a", "_c"), F.col("c").cast("double")), F.least(F.greatest("_a", "_c"), F.col("c") + 1.0)
    dx = F.col("_c") - F.col("_a")

    def y_at(x: Column) -> Column:
        return F.col("_b") + (x - F.col("_a")) * (F.col("_d") - F.col("_b")) / F.when(dx != 0, dx)

    ya, yb = F.coalesce(y_at(lo), F.col("_b")), F.coalesce(y_at(hi), F.col("_d"))
    s = s.withColumn("r", F.explode(F.sequence(F.ceil(F.least(ya, yb)) - 1, F.floor(F.greatest(ya, yb)))))
    return s.select(*keep, "r", "c").distinct()


def edges_near(edges: DataFrame, cells: DataFrame, grid: Grid, band: float) -> DataFrame:
    """Edges that may come within ``band`` of some cell, found by buckets as wide as the band and a cell.

    Most of a large network is far from any fire and drops out before it is copied to cells or buckets.
    """
    size = band + grid.cell
    at = _bucketed(cells.select("r", "c").distinct().withColumns({"_x": grid.x(), "_y": grid.y()}), F.col("_x"), F.col("_x"), F.col("_y"), F.col("_y"), size, 1)
    own = _bucketed(edges, F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"), size)
    return own.join(at.select("_bx", "_by").distinct(), ["_bx", "_by"], "left_semi").drop("_bx", "_by").dropDuplicates(EDGE)


def cut_edges(edges: DataFrame, arrival: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Hour each directed edge is first cut by the fire (touching cuts)."""
    at = segment_cells(edges_near(edges, arrival, grid, 0.0), grid, EDGE)
    hit = at.join(arrival.select(*keys, "r", "c", "arrival"), ["r", "c"])
    return hit.groupBy(*keys, *EDGE).agg(F.min("arrival").alias("cut_at"))


def _segment_cell_distance(grid: Grid) -> Column:
    """Distance of a segment to a cell's square when they do not meet."""
    half = grid.cell / 2
    ends = [cell_distance("x1", "y1", grid), cell_distance("x2", "y2", grid)]
    corners = [
        geo.segment_distance(grid.x() + i * half, grid.y() + j * half, "x1", "y1", "x2", "y2")
        for i in (-1, 1) for j in (-1, 1)
    ]
    return F.least(*ends, *corners)


def fire_distance(edges: DataFrame, arrival: DataFrame, grid: Grid, keys: list[str], band: float = geo.FRICTION_BAND_M) -> DataFrame:
    """Distance of each edge to the fire, as steps: from hour ``period`` on it is ``dist_m``.

    Only edges within the band appear. Only cells that are on the fire's edge at some hour
    are compared, found by buckets as wide as the band.
    """
    near = edges_near(edges.select(*EDGE, "x1", "y1", "x2", "y2"), arrival, grid, band)
    e = _bucketed(near, F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"), band, 1)
    b = ever_boundary(arrival, keys).select(*keys, "r", "c", "arrival")
    b = b.withColumns({"_bx": F.floor(grid.x() / band), "_by": F.floor(grid.y() / band)})
    # An edge of several buckets may meet a cell more than once; the minimum absorbs it.
    j = e.join(b, ["_bx", "_by"]).withColumn("dist_m", _segment_cell_distance(grid)).filter(F.col("dist_m") < band)
    step = j.groupBy(*keys, *EDGE, F.col("arrival").alias("period")).agg(F.min("dist_m").alias("dist_m"))
    w = W.partitionBy(*keys, *EDGE).orderBy("period")
    return step.withColumn("dist_m", F.min("dist_m").over(w))


def hourly_edges(edges: DataFrame, arrival: DataFrame, periods: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Surviving edges of every hour with their friction cost; parallel edges reduced to the
    cheapest cost and the shortest length."""
    cut = cut_edges(edges, arrival, grid, keys)
    steps = fire_distance(edges, arrival, grid, keys)
    w = W.partitionBy(*keys, *EDGE).orderBy("period")
    spans = steps.withColumn("_to", F.coalesce(F.lead("period").over(w), F.lit(1 << 30)))
    spans = spans.groupBy(*keys, *EDGE).agg(F.collect_list(F.struct(F.col("period").alias("a"), F.col("_to").alias("b"), F.col("dist_m").alias("d"))).alias("steps"))
    e = _per_period(edges, periods, keys).join(cut, [*keys, *EDGE], "left").filter(F.col("cut_at").isNull() | (F.col("cut_at") > F.col("period")))
    e = e.join(spans, [*keys, *EDGE], "left")
    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint,d:double>>)")
    d = F.aggregate(
        F.coalesce("steps", none), F.lit(None).cast("double"),
        lambda acc, s: F.when((s["a"] <= F.col("period")) & (F.col("period") < s["b"]), s["d"]).otherwise(acc),
    )
    e = e.withColumn("cost", geo.friction("length_m", d))
    return e.groupBy(*keys, "period", "u", "v").agg(F.min("cost").alias("cost"), F.min("length_m").alias("length_m"))


def _per_period(edges: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """Edges repeated for each hour; the hours come as one array per run."""
    hours = periods.groupBy(*keys).agg(F.collect_set("period").alias("hours"))
    return attach_all(edges.select(*EDGE, "length_m"), hours).withColumn("period", F.explode("hours")).drop("hours")


def route_all(edges: DataFrame, refuges: DataFrame, keys: list[str], hops: int = 3) -> DataFrame:
    """Cheapest refuge of every node and hour: one relaxation from all refuges over reversed edges.

    ``edges`` has keys, u, v, cost; ``refuges`` has keys, node_id, refuge_id. Labels are
    (cost, refuge, next hop), so ties are settled the same way everywhere. Each round
    relaxes only nodes whose label improved; the loop ends when none did. Edges stay
    partitioned by the frontier's key, so a round moves only labels.
    """
    node = [*keys, "node"]
    back = edges.select(*keys, F.col("v").alias("node"), F.col("u").alias("_u"), "cost")
    ends = back.select(*node).union(edges.select(*keys, F.col("u").alias("node"))).distinct()
    back = back.unionByName(ends.withColumn("_u", F.col("node")).withColumn("cost", F.lit(0.0)))
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Kept partitioned by the join key; a lost block is rebuilt from the written table.
    back = materialise(back, "edges").repartition(n, *node).persist()
    label = F.struct(F.lit(0.0).alias("cost"), F.col("refuge_id").alias("refuge_id"), F.lit(None).cast("long").alias("next_hop"))
    best = refuges.groupBy(*keys, F.col("node_id").alias("node")).agg(F.min(label).alias("lab"))
    best = materialise(best, "labels")
    front = best

    def relax(labels: DataFrame) -> DataFrame:
        """One hop; the zero-cost link to itself keeps a node's own label in the chain."""
        j = labels.join(back, node)
        own = F.col("_u") == F.col("node")
        cand = F.struct(
            (F.col("lab.cost") + F.col("cost")).alias("cost"), F.col("lab.refuge_id").alias("refuge_id"),
            F.when(own, F.col("lab.next_hop")).otherwise(F.col("node")).alias("next_hop"),
        )
        return j.select(*keys, F.col("_u").alias("node"), cand.alias("lab")).groupBy(*node).agg(F.min("lab").alias("lab"))

    while True:
        found = front
        for _ in range(hops):
            found = relax(found)
        found = found.withColumnRenamed("lab", "new")
        better = F.col("new").isNotNull() & (F.col("lab").isNull() | (F.col("new") < F.col("lab")))
        both, gained = materialise_observed(best.join(found, node, "full_outer"), "relax", n=F.count_if(better))
        front = both.filter(better).select(*node, F.col("new").alias("lab"))
        if not gained["n"]:
            break
        best = both.select(*node, F.when(better, F.col("new")).otherwise(F.col("lab")).alias("lab"))
    back.unpersist()
    return best.select(*node, "lab.cost", "lab.refuge_id", "lab.next_hop")


def reconstruct(routes: DataFrame, origins: DataFrame, edges: DataFrame, keys: list[str], oid: str = "origin_id") -> DataFrame:
    """``hops`` with the shortest parallel length of each."""
    at = hops(routes, origins, keys, oid)
    length = edges.groupBy(*keys, "u", "v").agg(F.min("length_m").alias("length_m"))
    return at.join(length, [*keys, "u", "v"]).select(*keys, oid, "seq", "u", "v", "length_m")


def hops(routes: DataFrame, origins: DataFrame, keys: list[str], oid: str = "origin_id") -> DataFrame:
    """Ordered hops (seq, u, v) from each origin to its refuge.

    Paths grow by doubling: round k appends the hops 2^k ahead through a jump table that is
    squared each round, so the number of rounds is the logarithm of the longest path.
    """
    k = [*keys, "node"]
    hop = materialise(routes.filter(F.col("next_hop").isNotNull()).select(*k, F.col("next_hop").alias("to")), "hops")
    at = materialise(origins.select(*keys, oid, "node", F.lit(0).cast("long").alias("seq")), "path")
    jump, reach = hop, 1
    while True:
        ahead = at.join(jump, k).select(*keys, oid, F.col("to").alias("node"), (F.col("seq") + reach).alias("seq"))
        ahead, grown = materialise_observed(ahead, "path", n=F.count(F.lit(1)))
        if not grown["n"]:
            break
        at = at.unionByName(ahead)
        second = jump.select(*keys, F.col("node").alias("to"), F.col("to").alias("to2"))
        jump = materialise(jump.join(second, [*keys, "to"]).select(*k, F.col("to2").alias("to")), "jump")
        reach *= 2
    return at.join(hop, k).select(*keys, oid, "seq", F.col("node").alias("u"), F.col("to").alias("v"))


def route_length(path: DataFrame, keys: list[str], oid: str = "origin_id") -> DataFrame:
    return path.groupBy(*keys, oid).agg(F.sum("length_m").alias("length_m"), F.count("*").alias("n_hops"))


def route_lines(path: DataFrame, nodes: DataFrame, keys: list[str], oid: str = "origin_id") -> DataFrame:
    """Continuity of each drawn route (hops chain without a break) and its drawn length."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    nxt = path.select(*keys, oid, (F.col("seq") - 1).alias("seq"), F.col("u").alias("_nu"))
    j = path.join(a, "u").join(b, "v").join(nxt, [*keys, oid, "seq"], "left")
    breaks = F.count_if(F.col("_nu").isNotNull() & (F.col("_nu") != F.col("v")))
    return j.groupBy(*keys, oid).agg(
        (breaks + 1).alias("n_parts"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("drawn_m")
    )
