"""Preparation of a simulation instance: window grids and seed points of drawn fronts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.functions import geo
from hazardframe.operators import cells as cl
from hazardframe.operators import spatial as sp
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import require_empty

# Spacing of seed points (m) and their largest number per polygon.
SEED_SPACING_M = 300.0
SEED_MAX_POINTS = 1200


def build_grids(slope: DataFrame, elevation: DataFrame, fuel: DataFrame, fuel_codes: DataFrame, window: tuple[int, int, int, int],
                grid: Grid, fuel_grid: Grid, nodata: float, nonfuel: int) -> DataFrame:
    """Slope, elevation, aspect, fuel code and burnable flag of every cell of the window.

    The row and column range is applied first, so stored grids are pruned at the scan.
    """
    r0, r1, c0, c1 = window
    inside = F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)
    key = F.lit(0).alias("run_id")
    s = cl.fill_nodata(slope.filter(inside).select(key, "r", "c", "value"), nodata, "zero").withColumnRenamed("value", "slope")
    e = cl.fill_nodata(elevation.filter(inside).select(key, "r", "c", "value"), nodata, "median")
    e = cl.aspect(e, grid.cell).withColumnRenamed("value", "elevation")
    f = cl.resample_nearest(slope.filter(inside).select("r", "c"), grid, fuel, fuel_grid, -1)
    f = cl.reclassify(f, fuel_codes, nonfuel).select("r", "c", "code")
    out = s.join(e, ["run_id", "r", "c"]).join(f, ["r", "c"]).drop("run_id")
    return out.withColumn("burnable", F.col("code") != nonfuel)


def polygon_seed_points(vertices: DataFrame, max_points: int = SEED_MAX_POINTS) -> DataFrame:
    """Seed points of drawn polygons (polygon_id, idx, lat, lon): the outline about every
    300 m and a 300 m grid inside, with the area in km2. Too many points are an error."""
    pid = ["polygon_id"]
    mid = vertices.groupBy(*pid).agg(F.avg("lat").alias("lat0"))
    v = vertices.join(mid, pid).withColumn("m_lon", geo.METRES_PER_DEGREE * F.cos(F.radians("lat0")))
    v = v.withColumns({"x1": F.col("lon") * F.col("m_lon"), "y1": F.col("lat") * geo.METRES_PER_DEGREE})
    w = W.partitionBy(*pid).orderBy("idx")
    first = F.first(F.struct("x1", "y1")).over(w)
    nxt = F.coalesce(F.lead(F.struct("x1", "y1")).over(w), first)
    s = v.withColumn("_n", nxt).withColumns({"x2": F.col("_n.x1"), "y2": F.col("_n.y1")})
    s = s.withColumn("_len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    s = s.withColumn("_from", F.sum("_len").over(w) - F.col("_len"))
    ring = s.groupBy(*pid).agg(
        F.sum("_len").alias("_total"), (F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2e6).alias("area_km2"),
        F.min("x1").alias("ax"), F.max("x1").alias("bx"), F.min("y1").alias("ay"), F.max("y1").alias("by"), F.first("m_lon").alias("m_lon"),
    )
    require_empty(ring.filter("area_km2 = 0").select(*pid), "degenerate polygons")
    n = F.greatest(F.floor(F.col("_total") / SEED_SPACING_M), F.lit(1))
    edge = s.join(ring.select(*pid, n.alias("_n_seg"), "_total"), pid).withColumn("_step", F.col("_total") / F.col("_n_seg"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n_seg") - 1))
    edge = edge.withColumn("_i", i).withColumn("_t", F.col("_i") * F.col("_step") - F.col("_from")).filter("_t >= 0 AND _t < _len")
    outline = edge.select(*pid, (F.col("x1") + F.col("_t") / F.col("_len") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("_t") / F.col("_len") * (F.col("y2") - F.col("y1"))).alias("y"))

    def axis(lo: str, hi: str):
        k = F.sequence(F.lit(0), F.greatest(F.ceil((F.col(hi) - F.col(lo)) / SEED_SPACING_M).cast("int"), F.lit(0)))
        return F.explode(F.filter(F.transform(k, lambda j: F.col(lo) + SEED_SPACING_M / 2 + j * SEED_SPACING_M), lambda z: z < F.col(hi)))

    g = ring.select(*pid, "ax", "bx", "ay", "by").withColumn("y", axis("ay", "by")).withColumn("x", axis("ax", "bx"))
    g = g.withColumn("gid", F.struct(*pid, "x", "y"))
    segs = s.select(F.col("polygon_id").alias("ring_id"), "x1", "y1", "x2", "y2")
    inner = sp.points_in_rings(g.select("gid", "x", "y"), segs, "gid", 1000.0).filter("gid.polygon_id = ring_id")
    pts = outline.unionByName(inner.select("gid.polygon_id", "gid.x", "gid.y"))
    require_empty(pts.groupBy(*pid).agg(F.count("*").alias("n")).filter(F.col("n") > max_points), "too many seed points")
    out = pts.join(ring.select(*pid, "area_km2", "m_lon"), pid)
    return out.select(*pid, F.round(F.col("y") / geo.METRES_PER_DEGREE, 5).alias("lat"), F.round(F.col("x") / F.col("m_lon"), 5).alias("lon"), "area_km2")
