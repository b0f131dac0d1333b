"""Full hourly evacuation as one plan keyed by (run, hour)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.operators import cells as cl
from hazardframe.operators import evacuation as ev
from hazardframe.operators import network as net
from hazardframe.operators import overlay as ov
from hazardframe.operators import spatial as sp
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import materialise


@dataclass
class Evacuation:
    outcome: DataFrame
    path: DataFrame
    summary: DataFrame
    cuts: DataFrame
    zone: DataFrame
    routes: DataFrame


def evacuate(arrival: DataFrame, width: DataFrame, grid: Grid, nodes: DataFrame, edges: DataFrame, settlements: DataFrame,
             refuges: DataFrame, keys: list[str], t0=None, since: DataFrame | None = None, before: DataFrame | None = None) -> Evacuation:
    """Danger zone, exposure, refuge eligibility, cut and friction, routing and summary.

    Every hour of every run is solved together; only the relaxation and the path walk
    iterate. Snapping to nodes does not depend on the hour and is done once.

    With ``since`` (keys, since) only the hours from then on are solved; ``before`` gives the
    routes of the hour before, from which those hours follow one by one.
    """
    # Inputs may be views over large tables; what several steps read is written once.
    arrival, edges, nodes = materialise(arrival, "arrival"), materialise(edges, "edges"), materialise(nodes, "nodes")
    stats = cl.perimeter_stats(arrival, grid.cell, keys)
    fire = materialise(stats.select(*keys, "period", F.round(F.col("area_m2") / 1e6, 2).alias("fire_km2")), "hours")
    if since is not None:
        fire = materialise(fire.join(since, keys).filter("period >= since").drop("since"), "hours")
    zone = materialise(cl.blocked_zone(arrival, width, grid.cell, keys), "zone")
    exposed = materialise(ev.exposure(settlements, zone, arrival, grid, keys), "exposed")
    risk = materialise(ev.at_risk_by_period(exposed, fire, keys).join(fire.select(*keys, "period"), [*keys, "period"], "left_semi"), "at-risk")

    node_pts = nodes.select(F.col("node_id").alias("tid"), "x", "y")
    open_ = ev.open_refuges(settlements, refuges, nodes, zone, exposed, fire, grid, keys)
    cuts = materialise(net.cut_edges(edges, arrival, grid, keys), "cuts")
    spans = materialise(ov.edge_spans(edges, arrival, grid, keys, cuts), "edge-spans")
    open_ = materialise(open_.select(*keys, "period", "node_id", "refuge_id"), "open-refuges")
    overlay = ov.Overlay(edges, spans, ov.network_parts(nodes), keys)
    routes = ov.route(overlay, open_) if before is None else _hour_by_hour(overlay, open_, before)

    threatened = risk.filter("NOT impacted")
    at = settlements.join(threatened.select("settlement_id").distinct(), "settlement_id", "left_semi")
    origin_node = sp.nearest(at, node_pts, ["settlement_id"]).select("settlement_id", F.col("tid").alias("node"))
    origins = materialise(threatened.join(origin_node, "settlement_id").select(*keys, "period", F.col("settlement_id").alias("origin_id"), "node"), "origins")
    steps = materialise(net.hops(routes, origins, [*keys, "period"]), "steps")
    path = materialise(steps.join(ov.at_hours(edges, spans, steps, keys), [*keys, "period", "u", "v"]), "paths")
    length = net.route_length(path, [*keys, "period"])
    reach = origins.join(routes.select(*keys, "period", "node", "cost", "refuge_id"), [*keys, "period", "node"])
    reach = reach.join(length, [*keys, "period", "origin_id"], "left").select(
        *keys, "period", F.col("origin_id").alias("settlement_id"), "refuge_id", "cost", F.coalesce("length_m", F.lit(0)).cast("double").alias("length_m"))
    status = F.when(F.col("impacted"), "impacted").when(F.col("refuge_id").isNotNull(), "ok").otherwise("cut_off")
    outcome = risk.join(reach, [*keys, "period", "settlement_id"], "left").withColumn("status", status)
    outcome = outcome.join(settlements.select("settlement_id", "name", "pop"), "settlement_id")
    outcome = outcome.withColumn("route_km", F.round(F.col("length_m") / 1000, 2))
    outcome = materialise(outcome.select(*keys, "period", "settlement_id", "name", "pop", "status", "refuge_id", "cost", "length_m", "route_km"), "outcome")
    if since is not None:  # what was cut before counts from the first hour on
        cuts = cuts.join(since, keys).withColumn("cut_at", F.greatest("cut_at", "since")).drop("since")
    summary = ev.hourly_summary(outcome, cuts, fire, t0, keys)
    return Evacuation(outcome, path, summary, cuts, zone, routes)


def _hour_by_hour(overlay: ov.Overlay, seeds: DataFrame, before: DataFrame) -> DataFrame:
    """Routes of consecutive hours, each from the one before; hours of a run are few (a calendar's)."""
    keys, whole = overlay.keys, None
    turn = before.select(*keys, F.col("period").alias("_last")).distinct()
    turn = materialise(seeds.join(turn, keys).withColumn("_turn", F.col("period") - F.col("_last")), "turns")
    for n in range(1, (turn.agg(F.max("_turn")).first()[0] or 0) + 1):
        now = turn.filter(F.col("_turn") == n)
        before = ov.next_hour(overlay, before.join(now.select(*keys).distinct(), keys, "left_semi"), now)
        whole = before if whole is None else whole.unionByName(before)
    return materialise(whole, "routes")
