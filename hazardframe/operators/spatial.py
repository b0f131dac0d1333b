"""Distance joins on grid buckets: theta joins become equi-joins with a residual test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.functions.base import dbl
from hazardframe.functions.geo import segment_distance
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import is_empty, materialise, materialise_observed


def _span(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo).cast("long"), F.floor(hi).cast("long"))


def _bucketed(df: DataFrame, x1, x2, y1, y2, size: float, pad: int = 0) -> DataFrame:
    """Rows repeated for each bucket their extent (padded by whole buckets) covers."""
    df = df.withColumn("_bx", F.explode(_span(F.least(x1, x2) / size - pad, F.greatest(x1, x2) / size + pad)))
    return df.withColumn("_by", F.explode(_span(F.least(y1, y2) / size - pad, F.greatest(y1, y2) / size + pad)))


def rect_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point to an axis-aligned rectangle, 0 inside (x1 <= x2, y1 <= y2)."""
    px, py, x1, y1, x2, y2 = (dbl(c) for c in (px, py, x1, y1, x2, y2))
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x1 - px, px - x2, zero), F.greatest(y1 - py, py - y2, zero))


def _as_segments(targets: DataFrame) -> DataFrame:
    if "x1" in targets.columns:
        return targets
    return targets.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x"), "y2": F.col("y")}).drop("x", "y")


#: Targets that one row of a bucket's list may hold.
LIST_TARGETS = 1_000


def nearest(points: DataFrame, targets: DataFrame, pid: list[str], keys: list[str] | None = None,
            bucket: float | None = None, max_dist: float | None = None, factor: int = 4, metric=segment_distance) -> DataFrame:
    """Nearest target (point or segment) of each point, exact; ties go to the smallest ``tid``.

    ``metric=rect_distance`` reads the two target corners as an axis-aligned rectangle.

    ``points`` has ``pid`` columns, x, y; ``targets`` has tid and x, y or x1, y1, x2, y2;
    both have ``keys``. Each distinct place is searched once. Targets are gathered into short lists per
    occupied bucket and its neighbours, so a place meets lists and never becomes a row per target. Buckets start
    fine, so dense places are settled among few candidates; a place is settled once its best
    distance is within the searched block. Only unsettled places go on to the next, coarser grid.
    With ``max_dist`` farther targets are not searched and such points are left out, as are points without a place.
    """
    keys = list(keys or [])
    segs = _as_segments(targets).select(*keys, "tid", *[dbl(c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    if bucket is None:
        # Cheap driver-side choice of the first bucket: about two targets per bucket.
        b = segs.agg(F.min("x1"), F.max("x1"), F.min("y1"), F.max("y1"), F.count("*")).first()
        if not b[4]:
            return points.select(*keys, *pid, "x", "y").limit(0).withColumns({"tid": F.lit(None).cast("long"), "dist": F.lit(None).cast("double")})
        area = max(b[1] - b[0], 1.0) * max(b[3] - b[2], 1.0)
        bucket = max((2.0 * area / b[4]) ** 0.5, 1e-6)
    if max_dist is not None:
        bucket = max(bucket, max_dist)
    place, at = list(dict.fromkeys([*keys, "x", "y"])), [*keys, "_bx", "_by"]
    points = points.select(*dict.fromkeys([*keys, *pid, "x", "y"])).filter("x IS NOT NULL AND y IS NOT NULL").distinct()
    todo = points.select(*place).distinct()
    if keys:
        todo = todo.join(segs.select(*keys).distinct(), keys, "left_semi")
    todo, done = materialise(todo, "nearest-places"), None
    block = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        p = todo.withColumns({"_bx": F.floor(F.col("x") / bucket), "_by": F.floor(F.col("y") / bucket)})
        held = p.select(*at).distinct().withColumn("_o", F.explode(block)).select(*at, (F.col("_bx") + F.col("_o.i")).alias("_nx"), (F.col("_by") + F.col("_o.j")).alias("_ny"))
        s = _bucketed(segs, F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2"), bucket).withColumnsRenamed({"_bx": "_nx", "_by": "_ny"})
        near = materialise(held.join(s, [*keys, "_nx", "_ny"]).drop("_nx", "_ny"), "nearest-targets")
        lists = F.ceil(F.count(F.lit(1)) / F.lit(float(LIST_TARGETS))).cast("long").alias("_lists")
        near = near.join(near.groupBy(*at).agg(lists), at).withColumn("_slot", F.pmod(F.xxhash64("tid", "x1", "y1", "x2", "y2"), F.col("_lists")))
        near = near.groupBy(*at, "_lists", "_slot").agg(F.collect_list(F.struct("tid", "x1", "y1", "x2", "y2")).alias("_near"))
        near, seen = materialise_observed(near, "nearest-lists", lists=F.max("_lists"))
        found = F.transform("_near", lambda t: F.struct(metric(F.col("x"), F.col("y"), t["x1"], t["y1"], t["x2"], t["y2"]).alias("dist"), t["tid"].alias("tid")))
        best = p.join(near.select(*at, "_near"), at, "left").select(*place, F.array_min(found).alias("_m"))
        if (seen["lists"] or 0) > 1:
            best = best.groupBy(*place).agg(F.min("_m").alias("_m"))
        # Distance from the place to the border of its 3 x 3 block.
        fx, fy = F.pmod(F.col("x"), F.lit(bucket)), F.pmod(F.col("y"), F.lit(bucket))
        reach = F.lit(max_dist) if max_dist is not None else F.least(fx, bucket - fx, fy, bucket - fy) + bucket
        best = best.select(*place, F.col("_m.tid").alias("tid"), F.col("_m.dist").alias("dist")).withColumn("_ok", F.coalesce(F.col("dist") <= reach, F.lit(False)))
        best, seen = materialise_observed(best, "nearest", open=F.count_if(~F.col("_ok")))
        settled = best.filter("_ok").drop("_ok")
        done = settled if done is None else done.unionByName(settled)
        if max_dist is not None or not seen["open"]:
            return points.join(done, place)
        todo = best.filter("NOT _ok").select(*place)
        bucket *= factor


def within_distance(left: DataFrame, right: DataFrame, d: float, keys: list[str] | None = None, anti: bool = False) -> DataFrame:
    """Rows of ``left`` (points x, y) with a point of ``right`` at most ``d`` away.

    Buckets of ``d / 3`` are compared first: a bucket pair that lies wholly within ``d``
    settles all its points without looking at them, so a crowded place never becomes a
    product of points. Only points of undecided buckets are compared one by one, against
    distinct places, and a semi join stops at the first hit.
    """
    keys = list(keys or [])
    g = d / 3.0
    fx, fy = F.floor(F.col("x") / g), F.floor(F.col("y") / g)
    lt = left.withColumns({"_bx": fx, "_by": fy})
    rt = right.select(*keys, "x", "y").distinct().withColumns({"_bx": fx, "_by": fy})
    near = [(i, j) for i in range(-4, 5) for j in range(-4, 5) if max(abs(i) - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2 <= 9]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near])
    lb = lt.select(*keys, "_bx", "_by").distinct()
    rb = rt.select(*keys, F.col("_bx").alias("_rx"), F.col("_by").alias("_ry")).distinct()
    probe = lb.withColumn("_o", F.explode(steps)).withColumns({"_rx": F.col("_bx") + F.col("_o.i"), "_ry": F.col("_by") + F.col("_o.j")})
    pairs = probe.join(rb, [*keys, "_rx", "_ry"])
    far2 = F.pow(F.abs(F.col("_rx") - F.col("_bx")) + 1, F.lit(2)) + F.pow(F.abs(F.col("_ry") - F.col("_by")) + 1, F.lit(2))
    pairs = pairs.withColumn("_sure", far2 <= 9)
    sure = pairs.filter("_sure").select(*keys, "_bx", "_by").distinct()
    k = [*keys, "_bx", "_by"]
    hit_sure = lt.join(sure, k, "left_semi")
    open_left = lt.join(sure, k, "left_anti")
    cand = pairs.filter(~F.col("_sure")).select(*k, "_rx", "_ry").distinct()
    cand = cand.join(rt.select(*keys, F.col("_bx").alias("_rx"), F.col("_by").alias("_ry"), F.col("x").alias("_x"), F.col("y").alias("_y")), [*keys, "_rx", "_ry"])
    cond = [open_left[c] == cand[c] for c in k]
    d2 = F.pow(open_left["x"] - cand["_x"], F.lit(2.0)) + F.pow(open_left["y"] - cand["_y"], F.lit(2.0))
    hit_open = open_left.join(cand, [*cond, d2 <= d * d], "left_semi")
    if anti:
        return open_left.join(cand, [*cond, d2 <= d * d], "left_anti").drop("_bx", "_by")
    return hit_sure.unionByName(hit_open).drop("_bx", "_by")


def pairs_within(points: DataFrame, lo: float, hi: float, pid: str) -> DataFrame:
    """Pairs (a < b) whose distance lies in [lo, hi]."""
    a = _bucketed(points.select(F.col(pid).alias("a"), "x", "y"), F.col("x"), F.col("x"), F.col("y"), F.col("y"), hi, 1)
    b = points.select(F.col(pid).alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    b = b.withColumns({"_bx": F.floor(F.col("x2") / hi), "_by": F.floor(F.col("y2") / hi)})
    out = a.join(b, ["_bx", "_by"]).filter(F.col("a") < F.col("b"))
    out = out.withColumn("dist", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))
    return out.filter(F.col("dist").between(lo, hi)).select("a", "b", "dist")


def closest_pair(points: DataFrame, lo: float, hi: float, target: float, pid: str) -> DataFrame:
    """The pair inside the distance band whose distance is nearest to ``target``."""
    p = pairs_within(points, lo, hi, pid)
    return p.agg(F.min(F.struct(F.abs(F.col("dist") - target).alias("off"), "a", "b", "dist")).alias("m")).select("m.a", "m.b", "m.dist")


def point_cells(points: DataFrame, grid: Grid, keep: list[str]) -> DataFrame:
    """The cells a point touches: one inside, two or four on cell edges and corners."""
    fx = (F.col("x") - grid.x0) / grid.cell
    fy = (F.lit(grid.y_top) - F.col("y")) / grid.cell
    out = points.select(*keep, "x", "y", F.explode(F.sequence(F.ceil(fx) - 1, F.floor(fx))).alias("c"), fy.alias("_fy"))
    return out.withColumn("r", F.explode(F.sequence(F.ceil("_fy") - 1, F.floor("_fy")))).drop("_fy")


def inside_arrival(points: DataFrame, arrival: DataFrame, grid: Grid, pid: list[str], keys: list[str]) -> DataFrame:
    """Hour each point first lies strictly inside the footprint.

    A point on a cell edge is inside only when every cell it touches has burned.
    """
    at = point_cells(points, grid, pid)
    n = at.groupBy(*pid).agg(F.count("*").alias("_n"))
    hit = at.join(arrival.select(*keys, "r", "c", "arrival"), ["r", "c"])
    agg = hit.groupBy(*keys, *pid).agg(F.count("*").alias("_k"), F.max("arrival").alias("arrival"))
    return agg.join(n, pid).filter("_k = _n").drop("_k", "_n")


def cell_distance(px, py, grid: Grid, r="r", c="c") -> Column:
    """Distance of a point to the square of a cell."""
    half = grid.cell / 2
    dx = F.greatest(F.abs(dbl(px) - grid.x(c)) - half, F.lit(0.0))
    dy = F.greatest(F.abs(dbl(py) - grid.y(r)) - half, F.lit(0.0))
    return F.hypot(dx, dy)


def near_arrival(points: DataFrame, arrival: DataFrame, grid: Grid, d: float, pid: list[str], keys: list[str]) -> DataFrame:
    """Hour each point first lies within ``d`` of the cell set (inclusive)."""
    n = int(d // grid.cell) + 1
    at = points.select(*pid, "x", "y", grid.col_of("x").alias("_c"), grid.row_of("y").alias("_r"))
    at = at.withColumn("c", F.explode(F.sequence(F.col("_c") - n, F.col("_c") + n)))
    at = at.withColumn("r", F.explode(F.sequence(F.col("_r") - n, F.col("_r") + n)))
    at = at.filter(cell_distance("x", "y", grid) <= d)
    hit = at.join(arrival.select(*keys, "r", "c", "arrival"), ["r", "c"])
    return hit.groupBy(*keys, *pid).agg(F.min("arrival").alias("arrival"))


#: Segments of one ring in one band that a single row may hold, and slots that share the rings of one bucket.
RING_SEGMENTS, RING_SLOTS = 1_000, 32


def points_in_rings(points: DataFrame, segs: DataFrame, pid: str, band: float) -> DataFrame:
    """Points strictly inside closed rings: odd ray crossings and not on the boundary.

    Segments are bucketed into horizontal bands, and a ring's segments of a band travel as one row, copied to the
    columns of buckets they span. A bucket that no segment of a ring touches lies wholly inside or outside, so its
    points are settled at once by its centre; points of other buckets are tested where they meet the ring. Nothing but
    the result grows with the product of points and rings, and it is dealt over slots.
    Rings with more than ``RING_SEGMENTS`` segments in a band meet their points segment by segment.
    """
    size, x, y = band / 2.0, F.col("x"), F.col("y")
    bucket = lambda v: F.floor(v / size)
    p = points.select(pid, "x", "y", bucket(x).alias("_bx"), bucket(y).alias("_by"))
    s = segs.select("ring_id", *[dbl(c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    s = s.withColumn("_by", F.explode(_span(F.least("y1", "y2") / size, F.greatest("y1", "y2") / size)))

    def crosses(g, x=x, y=y) -> Column:
        """The ray to the right crosses the segment."""
        at_x = g("x1") + (y - g("y1")) * (g("x2") - g("x1")) / F.when(g("y2") != g("y1"), g("y2") - g("y1"))
        return F.coalesce(((g("y1") > y) != (g("y2") > y)) & (x < at_x), F.lit(False))

    def odd(x: Column, y: Column) -> Column:
        return F.aggregate("_segs", F.lit(False), lambda acc, g: acc != crosses(g.__getitem__, x, y))

    def on(g) -> Column:
        return F.coalesce(segment_distance(x, y, g("x1"), g("y1"), g("x2"), g("y2")) == 0, F.lit(False))

    bands = s.groupBy("ring_id", "_by").agg(
        F.count(F.lit(1)).alias("_k"), F.min(F.least("x1", "x2")).alias("_xa"), F.max(F.greatest("x1", "x2")).alias("_xb"),
        F.min(F.least("y1", "y2")).alias("_ya"), F.max(F.greatest("y1", "y2")).alias("_yb"))
    bands = materialise(bands, "ring-bands")
    few = s.join(bands.filter(F.col("_k") <= RING_SEGMENTS), ["ring_id", "_by"]).groupBy("ring_id", "_by", "_xa", "_xb", "_ya", "_yb")
    few = few.agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_segs")).withColumn("_bx", F.explode(_span(F.col("_xa") / size, F.col("_xb") / size)))
    touched = F.exists("_segs", lambda g: F.col("_bx").between(bucket(F.least(g["x1"], g["x2"])), bucket(F.greatest(g["x1"], g["x2"]))))
    few = few.withColumns({"_touched": touched, "_in": odd((F.col("_bx") + 0.5) * size, (F.col("_by") + 0.5) * size)}).filter("_touched OR _in")
    few = few.withColumn("_slot", F.pmod(F.xxhash64("ring_id"), F.lit(RING_SLOTS)).cast("int"))
    few = materialise(few.withColumn("_segs", F.when(F.col("_touched"), F.col("_segs"))).drop("_in"), "ring-buckets")
    spark = points.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    at = ["_bx", "_by", "_slot"]
    near = p.join(few.select("_bx", "_by").distinct(), ["_bx", "_by"], "left_semi").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(RING_SLOTS - 1))))
    near = near.repartition(n, *at)  # a given number keeps adaptive execution from joining small tables in one task
    whole = near.join(few.filter("NOT _touched").select(*at, "ring_id").repartition(n, *at), at).select(pid, "ring_id")
    in_box = x.between(F.col("_xa"), F.col("_xb")) & y.between(F.col("_ya"), F.col("_yb"))
    met = near.join(few.filter("_touched").repartition(n, *at), at).filter(in_box)
    tested = met.filter(odd(x, y) & ~F.exists("_segs", lambda g: on(g.__getitem__))).select(pid, "ring_id")
    inside = whole.unionByName(tested)
    many = bands.filter(F.col("_k") > RING_SEGMENTS)
    if is_empty(many):
        return inside
    long = p.join(s.join(many, ["ring_id", "_by"]), "_by").filter(in_box)
    agg = long.groupBy(pid, "ring_id").agg(F.count_if(crosses(F.col)).alias("_n"), F.bool_or(on(F.col)).alias("_on"))
    return inside.unionByName(agg.filter("_n % 2 = 1 AND NOT _on").select(pid, "ring_id"))


def dedupe_snaps(snaps: DataFrame, keys: list[str], node: str = "node_id", order=("dist", "refuge_id")) -> DataFrame:
    """One point per node: the closest, then the smallest id."""
    w = W.partitionBy(*keys, node).orderBy(*order)
    return snaps.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def far_pin(pins: DataFrame, new_lat, new_lon, limit_km: float = 40.0) -> DataFrame:
    """Largest distance from a new pin to the existing ones and whether it passes the limit."""
    from hazardframe.functions.geo import planar_m

    return pins.agg(F.max(planar_m("lat", "lon", new_lat, new_lon) / 1000.0).alias("max_km")).withColumn("too_far", F.col("max_km") > limit_km)
