"""Independent checks of an evacuation run, its headline and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.operators import evacuation as ev
from hazardframe.operators import network as net
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import aggregate_with_percentiles


def run_headline(summary: DataFrame, keys: list[str], fronts: DataFrame | None = None) -> DataFrame:
    """Final hour's row, hours simulated and the last front's share of class 4."""
    cols = [c for c in summary.columns if c not in keys]
    last = summary.groupBy(*keys).agg(F.max_by(F.struct(*cols), "period").alias("f"), (F.count("*") - 1).alias("hours_simulated"))
    out = last.select(*keys, "f.*", "hours_simulated")
    if fronts is not None:
        tail = fronts.groupBy(*keys).agg(F.bround(F.max_by("pct4", "period"), 0).cast("long").alias("class4_pct"))
        out = out.join(tail, keys, "left")
    return out


def route_segments(path: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return path.join(a, "u").join(b, "v")


def overlap_lengths(segs: DataFrame, arrival: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Metres of each route that run inside the fire of its hour (cell by cell clip)."""
    keep = [*keys, "period", "origin_id", "seq", "x1", "y1", "x2", "y2"]
    at = _clip_cells(segs.select(*keep), grid)
    fire = arrival.select(*keys, "r", "c", "arrival")
    hit = at.join(fire, [*keys, "r", "c"]).filter(F.col("arrival") <= F.col("period"))
    return hit.groupBy(*keys, "period", "origin_id").agg(F.sum("inside_m").alias("inside_m"))


def _clip_cells(segs: DataFrame, grid: Grid) -> DataFrame:
    """Each segment with the cells it crosses and its length inside each cell."""
    base = net.segment_cells(segs.withColumn("sid", F.struct(*segs.columns)), grid, ["sid"]).select("sid", "sid.*", "r", "c")
    x0, y1 = F.col("c") * grid.cell + grid.x0, F.lit(grid.y_top) - F.col("r") * grid.cell
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def span(p, d, lo, hi):
        a, b = (lo - p) / F.when(d != 0, d), (hi - p) / F.when(d != 0, d)
        return F.coalesce(F.least(a, b), F.lit(0.0)), F.coalesce(F.greatest(a, b), F.lit(1.0))

    ax, bx = span(F.col("x1"), dx, x0, x0 + grid.cell)
    ay, by = span(F.col("y1"), dy, y1 - grid.cell, y1)
    t = F.greatest(F.least(bx, by, F.lit(1.0)) - F.greatest(ax, ay, F.lit(0.0)), F.lit(0.0))
    return base.withColumn("inside_m", t * F.hypot(dx, dy)).drop("sid")


def evacuation_checks(run, edges: DataFrame, nodes: DataFrame, arrival: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Violations per check: C1 route in fire (> 5 m), C2 monotone closures, C3 outcome and
    routes agree, C4 stated against drawn length (25 m or 1 %), C5 routes are one line."""
    segs = route_segments(run.path, nodes)
    c1 = overlap_lengths(segs, arrival, grid, keys).filter("inside_m > 5")
    c2 = ev.c2_monotone(run.summary, keys)
    c3 = ev.join_outcome_routes(run.outcome, ev.drawn_routes(run.path, keys), keys)
    lines = net.route_lines(run.path, nodes, [*keys, "period"])
    stated = net.route_length(run.path, [*keys, "period"])
    both = lines.join(stated, [*keys, "period", "origin_id"])
    c4 = both.filter(F.abs(F.col("drawn_m") - F.col("length_m")) > F.greatest(F.lit(25.0), 0.01 * F.col("length_m")))
    c5 = lines.filter("n_parts <> 1")
    out = None
    for name, df in zip(("C1", "C2", "C3", "C4", "C5"), (c1, c2, c3, c4, c5)):
        one = df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check_id"), "n_violations")
        out = one if out is None else out.unionByName(one)
    return out


def length_report(run, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Median and largest difference between stated and drawn route length."""
    lines = net.route_lines(run.path, nodes, [*keys, "period"])
    both = lines.join(net.route_length(run.path, [*keys, "period"]), [*keys, "period", "origin_id"])
    d = F.abs(F.col("drawn_m") - F.col("length_m"))
    out = aggregate_with_percentiles(both, [], [F.count("*").alias("n_routes"), F.round(F.max(d), 3).alias("max_diff_m")], d, {"median_diff_m": 0.5})
    return out.withColumn("median_diff_m", F.round("median_diff_m", 3))


def reproduce(stored: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Recomputed against stored statuses and refuges."""
    k = [*keys, "period", "settlement_id"]
    a = stored.select(*k, F.struct("status", "refuge_id").alias("_a"))
    b = again.select(*k, F.struct("status", "refuge_id").alias("_b"))
    return a.join(b, k, "full_outer").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_diff"))


def dashboard_feed(run, keys: list[str]) -> DataFrame:
    """One row per hour: areas, growth, counts, and that hour's outcomes and events."""
    w = W.partitionBy(*keys).orderBy("period")
    o = run.outcome.groupBy(*keys, "period").agg(F.sort_array(F.collect_list(F.struct("settlement_id", "status", "refuge_id", "route_km"))).alias("outcomes"))
    e = ev.hourly_events(run.outcome, run.summary, keys).groupBy(*keys, "period").agg(F.sort_array(F.collect_list(F.struct("kind", "settlement_id", "n"))).alias("events"))
    s = run.summary.withColumn("d_km2", F.round(F.col("fire_km2") - F.coalesce(F.lag("fire_km2").over(w), F.col("fire_km2")), 2))
    return s.join(o, [*keys, "period"], "left").join(e, [*keys, "period"], "left")
