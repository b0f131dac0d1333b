"""End-to-end validation of a run against detections and a final scar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.functions import geo
from hazardframe.operators import components as cc
from hazardframe.operators import detections as dt
from hazardframe.operators import perimeter as pm
from hazardframe.operators import rings as rg
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import attach_all, materialise


def scored_detections(det: DataFrame, arrival: DataFrame, seed: DataFrame, grid: Grid, sim_start, t0, sim_end, horizon: int) -> DataFrame:
    """Evaluation detections with pass, matched hour, distance and inside flag."""
    ev = dt.split_detections(det, sim_start, t0, sim_end, seed, grid).filter("part = 'eval'")
    ev = materialise(dt.match_period(dt.group_passes(ev), sim_start, horizon), "eval")
    return materialise(dt.dist_to_footprint(ev, arrival, grid), "scored")


def validate_detections(det, arrival, seed, scar, grid: Grid, sim_start, t0, sim_end, horizon: int, ox: float, oy: float) -> dict[str, DataFrame]:
    scored = scored_detections(det, arrival, seed, grid, sim_start, t0, sim_end, horizon)
    sim = arrival.filter(F.col("arrival") <= horizon)
    all_eval = dt.split_detections(det, sim_start, t0, sim_end, seed.limit(0), grid).filter("part = 'eval'")
    return {
        "per_pass": dt.pass_metrics(scored, arrival, seed, grid, ox, oy),
        "pooled": dt.pooled_metrics(scored),
        "overspread": dt.overspread(sim, seed, all_eval, grid),
        "agreement": dt.footprint_agreement(sim.join(seed, ["r", "c"], "left_anti"), scored, grid, ox, oy),
        "scored": scored,
    }


def perimeter_convergence(arrival: DataFrame, scar: DataFrame, horizon: int, grid: Grid, window=None) -> dict[str, DataFrame]:
    """Directed distances both ways for every hour, indicators, t* and its stability.

    Hours are a key: one ring extraction and one nearest search per direction serve all.
    """
    box = window or grid.box()
    filled, segs = pm.perimeters(arrival, horizon, grid)
    real = materialise(cc.fill_holes(scar.select(F.lit(0).cast("long").alias("hour"), "r", "c"), ["hour"]), "scar")
    rsegs = materialise(rg.ring_segments(rg.boundary_rings(real, ["hour"]), grid, ["hour"]).drop("hour"), "scar-segments")

    pid = ["hour", "ring_id", "idx"]
    sim_s = rg.exclude_samples(rg.sample_rings(segs, keys=["hour"], side=grid.cell), box, side="sim")
    real_s = rg.exclude_samples(rg.sample_rings(rsegs, keys=[], side=grid.cell), box, side="real")
    real_h = attach_all(real_s, filled.select("hour").distinct())
    s2r = pm.dist_to_segments(sim_s.filter("NOT excluded"), rg.strip_frame(rsegs, box), pid)
    r2s = pm.dist_to_segments(real_h.filter("NOT excluded"), rg.strip_frame(segs, box), ["ring_id", "idx"], ["hour"])
    s2r, r2s = materialise(s2r, "s2r"), materialise(r2s, "r2s")
    hourly = materialise(pm.hour_indicators(pm.direction_stats(s2r, ["hour"]), pm.direction_stats(r2s, ["hour"])), "hourly")

    in_real = pm.inside_cells(sim_s.select(*pid, "x", "y"), real.select("r", "c"), grid, pid, [])
    in_sim = pm.inside_cells(real_h.select(*pid, "x", "y"), filled, grid, pid, ["hour"])
    a = sim_s.select(*pid, "x", "y", "excluded").join(in_real.select(*pid, "inside"), pid).join(s2r.select(*pid, "dist"), pid, "left")
    b = real_h.select(*pid, "x", "y", "excluded").join(in_sim.select(*pid, "inside"), pid).join(r2s.select(*pid, "dist"), pid, "left")
    samples = a.select("*", F.lit("s2r").alias("direction"), geo.signed("dist", "inside", F.lit(False)).alias("signed_m")).unionByName(
        b.select("*", F.lit("r2s").alias("direction"), geo.signed("dist", "inside", F.lit(True)).alias("signed_m")))
    t_star = pm.find_t_star(hourly)
    return {"hourly": hourly, "t_star": t_star, "stability": pm.stability(hourly, t_star), "samples": samples, "filled": filled, "segments": segs}


def fragment_sensitivity(arrival: DataFrame, hour: int, scar_segs: DataFrame, grid: Grid, thresholds_ha=(0.0, 0.1, 1.0, 10.0)) -> DataFrame:
    """Counts, area, perimeter and mean distance to the scar of the parts kept by each threshold."""
    cells = arrival.filter(F.col("arrival") <= hour).select(F.lit(0).cast("long").alias("hour"), "r", "c")
    comp = materialise(cc.cell_components(cells, 4, ["hour"]), "parts")
    size = comp.groupBy("comp").agg((F.count("*") * grid.cell**2 / 1e4).alias("ha"))
    arr = F.array(*[F.lit(float(t)) for t in thresholds_ha])
    kept = size.withColumn("min_ha", F.explode(arr)).filter("ha >= min_ha")
    side = rg.boundary_sides(comp, ["hour"]).select((F.col("id")).alias("cid"), "ar", "ac", "br", "bc")
    sides = comp.select(cc.cell_id(["hour"]).alias("cid"), "comp").join(side, "cid")
    mid = sides.withColumn("x", (F.col("ac") + F.col("bc")) / 2 * grid.cell + grid.x0).withColumn("y", F.lit(grid.y_top) - (F.col("ar") + F.col("br")) / 2 * grid.cell)
    mid = mid.withColumn("sid", F.struct("cid", "ar", "ac", "br", "bc"))
    d = pm.dist_to_segments(mid.select("sid", "comp", "x", "y"), scar_segs, ["sid", "comp"])
    per = d.groupBy("comp").agg(F.sum("dist").alias("ds"), F.count("*").alias("n"))
    out = kept.join(per, "comp").groupBy("min_ha").agg(
        F.count("*").alias("n_parts"), F.round(F.sum("ha"), 2).alias("area_ha"), (F.sum("n") * grid.cell).alias("perimeter_m"),
        F.round(F.sum("ds") / F.sum("n"), 1).alias("mean_m"),
    )
    return out
