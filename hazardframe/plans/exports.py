"""User-facing layers of a run: hourly fronts, growth rings, settlements, flagged roads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.operators import cells as cl
from hazardframe.operators import components as cc
from hazardframe.operators import evacuation as ev
from hazardframe.operators import rings as rg
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import materialise

SPECK_M2 = 2e4


def isochrones(arrival: DataFrame, intensity: DataFrame, horizon: int, grid: Grid) -> DataFrame:
    """Outer front of every hour (hole-free, without specks) with its class shares.

    ``intensity`` (r, c, arrival, fi) gives a cell's intensity from its arrival on.
    """
    hours = F.explode(F.sequence(F.col("arrival").cast("long"), F.lit(horizon).cast("long")))
    per = arrival.withColumn("period", hours).select("period", "r", "c")
    parts = cc.drop_specks(materialise(cc.cell_components(per, 4, ["period"]), "parts"), grid.cell, SPECK_M2, ["period"])
    rings = rg.boundary_rings(materialise(parts.select("period", "r", "c"), "fronts"), ["period"])
    segs = materialise(rg.ring_segments(rings, grid, ["period"]), "front-segments")
    fi = intensity.withColumn("period", hours).select("period", "r", "c", "fi")
    sides = rg.cell_sides_classes(segs, fi, grid, ["period"])
    length = sides.groupBy("period").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length_m"))
    return rg.front_classes(sides, ["period"]).join(length, "period")


def build_exports(arrival: DataFrame, run, settlements: DataFrame, edges: DataFrame, grid: Grid, keys: list[str]) -> dict[str, DataFrame]:
    """Hour rings, settlements with first evacuation hour, roads with first route hour."""
    return {
        "rings": cl.growth_rings(arrival, grid.cell, keys),
        "settlements": ev.settlement_evac_hour(settlements, run.outcome, run.summary, keys),
        "roads": ev.flag_route_edges(edges, run.path.drop(*keys)),
    }


def run_overlay(tables: dict[str, DataFrame], run_id) -> dict[str, DataFrame]:
    """All tables of one run; the run filter prunes partitions of stored tables."""
    return {k: t.filter(F.col("run_id") == run_id) for k, t in tables.items()}
