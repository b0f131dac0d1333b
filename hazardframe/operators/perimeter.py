"""Convergence of a simulated perimeter series towards a final scar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions import geo
from hazardframe.operators import cells as cl
from hazardframe.operators import components as cc
from hazardframe.operators import rings as rg
from hazardframe.operators import spatial as sp
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import aggregate_with_percentiles, attach_all, materialise

INDICATORS = ["mean_s2r_m", "mean_r2s_m", "median_s2r_m", "median_r2s_m", "p95_s2r_m", "p95_r2s_m",
              "max_s2r_m", "max_r2s_m", "hd95_m", "hausdorff_sym_m"]


def dist_to_segments(points: DataFrame, segs: DataFrame, pid: list[str], keys: list[str] | None = None) -> DataFrame:
    """Exact distance of points to a line made of axis-aligned segments."""
    t = segs.select(*(keys or []), F.lit(0).cast("long").alias("tid"), F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"),
                    F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"))
    return sp.nearest(points, t, pid, keys, metric=sp.rect_distance).drop("tid")


def direction_stats(df: DataFrame, keys: list[str], dist: str = "dist") -> DataFrame:
    """Directed distances: mean, median, p95 and maximum (the directed Hausdorff distance)."""
    out = aggregate_with_percentiles(df, keys, [F.round(F.avg(dist), 1).alias("mean_m"), F.round(F.max(dist), 1).alias("max_m")], F.col(dist), {"median_m": 0.5, "p95_m": 0.95})
    return out.select(*keys, "mean_m", F.round("median_m", 1).alias("median_m"), F.round("p95_m", 1).alias("p95_m"), "max_m")


def hour_indicators(s2r: DataFrame, r2s: DataFrame, key: str = "hour") -> DataFrame:
    """Both directions side by side with D_t, symmetric Hausdorff and HD95; null where a side is missing."""
    names = ["mean_m", "median_m", "p95_m", "max_m"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(key, *[F.col(n).alias(n.replace("_m", f"_{tag}_m")) for n in names])

    j = side(s2r, "s2r").join(side(r2s, "r2s"), key, "full_outer")
    both = F.col("mean_s2r_m").isNotNull() & F.col("mean_r2s_m").isNotNull()
    return j.withColumns({
        "d_t_m": F.when(both, F.round((F.col("mean_s2r_m") + F.col("mean_r2s_m")) / 2, 1)),
        "hausdorff_sym_m": F.when(both, F.greatest("max_s2r_m", "max_r2s_m")),
        "hd95_m": F.when(both, F.greatest("p95_s2r_m", "p95_r2s_m")),
    })


def find_t_star(hourly: DataFrame, key: str = "hour") -> DataFrame:
    """Hour of the smallest D_t: ties to the earliest, all listed, censored at either end."""
    ok = hourly.filter(F.col("d_t_m").isNotNull())
    a = ok.groupBy("d_t_m").agg(F.array_sort(F.collect_set(key)).alias("hours"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    a = a.agg(F.min_by("hours", "d_t_m").alias("hours"), F.min("d_t_m").alias("d_t_m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    h = F.element_at("hours", 1)
    return a.filter("hours IS NOT NULL").select(
        h.alias("hour"), "d_t_m", ((h == F.col("lo")) | (h == F.col("hi"))).alias("censored"), F.slice("hours", 2, F.greatest(F.size("hours") - 1, F.lit(1))).alias("ties")
    )


def stability(hourly: DataFrame, t_star: DataFrame, key: str = "hour") -> DataFrame:
    """Best hour of every other indicator and whether it agrees with t*."""
    cols = [c for c in INDICATORS if c in hourly.columns]
    long = hourly.unpivot([key], cols, "indicator", "value").filter("value IS NOT NULL")
    best = long.groupBy("indicator").agg(F.min(F.struct("value", key)).alias("m"))
    best = best.select("indicator", F.col(f"m.{key}").alias("argmin_hour"), F.col("m.value").alias("min_value_m"))
    return attach_all(best, t_star.select(F.col("hour").alias("_t"))).withColumn("agrees", F.col("argmin_hour") == F.col("_t")).drop("_t")


def first_exceed(areas: DataFrame, target: float, strict: bool = True, key: str = "hour", area: str = "area_m2") -> DataFrame:
    """First hour the simulated area passes the target (strict) or reaches it."""
    hit = F.col(area) > target if strict else F.col(area) >= target
    return areas.agg(F.min(F.when(hit, F.col(key))).alias("hour"))


def signed_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by sign, share positive, mean and median of signed distances."""
    s = F.col("signed_m")
    aggs = [
        F.count("*").alias("n"), F.count_if(s > 0).alias("n_pos"), F.count_if(s < 0).alias("n_neg"),
        F.round(100.0 * F.count_if(s > 0) / F.count("*"), 1).alias("pos_pct"), F.round(F.avg(s), 1).alias("mean_m"),
    ]
    out = aggregate_with_percentiles(samples.filter("NOT excluded AND signed_m IS NOT NULL"), keys, aggs, s, {"median_m": 0.5})
    return out.withColumn("median_m", F.round("median_m", 1))


def sample_stats(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Size, distance statistics and sign shares of stored samples."""
    a, s = F.abs("signed_m"), F.col("signed_m")
    aggs = [
        F.count("*").alias("n"), F.round(F.avg(a), 1).alias("mean_m"),
        F.round(100.0 * F.count_if(s > 0) / F.count("*"), 1).alias("pos_pct"), F.round(F.avg(s), 1).alias("mean_signed_m"),
    ]
    out = aggregate_with_percentiles(samples, keys, aggs, a, {"median_m": 0.5, "p95_m": 0.95})
    return out.select(*keys, "n", "mean_m", F.round("median_m", 1).alias("median_m"), F.round("p95_m", 1).alias("p95_m"), "pos_pct", "mean_signed_m")


def clip_with_guard(points: DataFrame, region: DataFrame, guard: float, pid: str, band: float = 1000.0) -> DataFrame:
    """Points inside the region ring and more than ``guard`` from its border."""
    at = points.select(pid, "x", "y")
    inside = sp.points_in_rings(at, region, pid, band).select(pid).distinct()
    t = region.select(F.lit(0).cast("long").alias("tid"), "x1", "y1", "x2", "y2")
    near = sp.nearest(at, t, [pid], max_dist=guard).select(pid)
    return points.join(inside, pid, "left_semi").join(near, pid, "left_anti")


def perimeters(arrival: DataFrame, horizon: int, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Hole-free footprint cells and exterior ring segments of every hour (key ``hour``)."""
    per = arrival.withColumn("hour", F.explode(F.sequence(F.col("arrival").cast("long"), F.lit(horizon).cast("long"))))
    filled = materialise(cc.fill_holes(per.select("hour", "r", "c"), ["hour"]), "filled")
    segs = materialise(rg.ring_segments(rg.boundary_rings(filled, ["hour"]), grid, ["hour"]), "segments")
    return filled, segs


def inside_cells(points: DataFrame, cells: DataFrame, grid: Grid, pid: list[str], keys: list[str]) -> DataFrame:
    """Flag ``inside``: strictly within the cell set of the point's own key."""
    at = sp.point_cells(points, grid, [*pid, *[k for k in keys if k not in pid]])
    c = cells.select(*keys, "r", "c").withColumn("_hit", F.lit(1))
    agg = at.join(c, [*keys, "r", "c"], "left").groupBy(*pid).agg((F.count("*") == F.count("_hit")).alias("inside"))
    return points.join(agg, pid)
