"""Comparison of an hourly footprint with satellite detections and a final scar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.functions import geo
from hazardframe.functions.base import half_even
from hazardframe.operators import cells as cl
from hazardframe.operators import spatial as sp
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import aggregate_with_percentiles, materialise, materialise_observed, require_empty

SEED_RADIUS_M = 187.5
BUFFERS_M = (375, 500, 1000)
FAR_M = 1000.0


def _ts(v) -> Column:
    return F.lit(v).cast("timestamp")


def split_detections(det: DataFrame, sim_start, t0, sim_end, seed: DataFrame, grid: Grid) -> DataFrame:
    """Detections marked ``init`` [start, t0] or ``eval`` (t0, end]; eval ones inside the
    seed footprint are left out."""
    t = F.col("t").cast("timestamp")
    part = F.when((t >= _ts(sim_start)) & (t <= _ts(t0)), "init").when((t > _ts(t0)) & (t <= _ts(sim_end)), "eval")
    d = det.withColumn("part", part).filter(F.col("part").isNotNull())
    inside = sp.inside_arrival(d, seed.withColumn("arrival", F.lit(0)), grid, ["det_id"], []).select("det_id")
    hit = d.filter("part = 'eval'").join(inside, "det_id", "left_semi").select("det_id")
    return d.join(hit, "det_id", "left_anti")


def group_passes(det: DataFrame, tol_min: int = 20, keys: list[str] | None = None) -> DataFrame:
    """``pass_t``: first time of the satellite pass; a pass spans at most ``tol_min`` minutes
    from its first time.

    A gap longer than the tolerance always starts a new pass, so starts are searched inside
    gap-free stretches of distinct times, in a logarithmic number of rounds.
    """
    keys = list(keys or [])
    times = det.select(*keys, "t").distinct().withColumn("_s", F.col("t").cast("timestamp").cast("double"))
    # Gap search per day; a day's first time looks back at the last earlier day's last time.
    day = times.withColumn("_day", F.to_date("t"))
    ends = day.groupBy(*keys, "_day").agg(F.max("_s").alias("_end"))
    w_day = W.partitionBy(*keys).orderBy("_day")
    ends = ends.select(*keys, "_day", F.lag("_end").over(w_day).alias("_before"))
    w = W.partitionBy(*keys, "_day").orderBy("_s")
    day = day.join(ends, [*keys, "_day"]).withColumn("_prev", F.coalesce(F.lag("_s").over(w), "_before"))
    tol = tol_min * 60.0
    day = day.withColumn("_new", (F.col("_prev").isNull() | (F.col("_s") - F.col("_prev") > tol)).cast("int"))
    starts = day.groupBy(*keys, "_day").agg(F.sum("_new").alias("_k"))
    starts = starts.withColumn("_off", F.sum("_k").over(w_day.rowsBetween(W.unboundedPreceding, -1)))
    day = day.join(starts, [*keys, "_day"])
    day = day.withColumn("_stretch", F.sum("_new").over(w) + F.coalesce("_off", F.lit(0)))
    # From a stretch's first time on, each pass starts at the first time beyond the tolerance after
    # the start before it. The starts are found by pointer doubling over that successor. In a stretch it
    # lies in the bucket (as wide as the tolerance) of the earliest time it may have, or is the next bucket's first.
    tol_us = tol_min * 60_000_000
    micros = F.unix_micros(F.timestamp_seconds("_s"))
    bucket = lambda c: F.floor(F.col(c) / F.lit(tol_us)).cast("long")
    day = materialise(day.select(*keys, "_stretch", "_s", micros.alias("_u"), (F.col("_new") == 1).alias("_first")).withColumn("_b", bucket("_u")), "pass-times")
    at = [*keys, "_stretch", "_u"]
    none = F.lit(None).cast("long")
    asked = day.select(*keys, "_stretch", "_u", (F.col("_u") + tol_us + 1).alias("_at")).withColumn("_b", bucket("_at"))
    held = day.select(*keys, "_stretch", none.alias("_u"), F.col("_u").alias("_at"), "_b")
    onward = W.partitionBy(*keys, "_stretch", "_b").orderBy(F.col("_at").desc(), F.col("_u").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = held.unionByName(asked).withColumn("_in", F.last(F.when(F.col("_u").isNull(), F.col("_at")), ignorenulls=True).over(onward)).filter("_u IS NOT NULL")
    opens = day.groupBy(*keys, "_stretch", (F.col("_b") - 1).alias("_b")).agg(F.min("_u").alias("_open"))
    jump = met.join(opens, [*keys, "_stretch", "_b"], "left").select(*at, F.coalesce("_in", "_open").alias("_next")).filter("_next IS NOT NULL")
    jump = materialise(jump, "pass-jumps")
    heads = materialise(day.filter("_first").select(*at), "pass-starts")
    while True:
        more, grown = materialise_observed(heads.join(jump, at).select(*keys, "_stretch", F.col("_next").alias("_u")), "pass-starts", n=F.count(F.lit(1)))
        if not grown["n"]:
            break
        heads = heads.unionByName(more)
        second = jump.select(*keys, "_stretch", F.col("_u").alias("_next"), F.col("_next").alias("_then"))
        jump = materialise(jump.join(second, [*keys, "_stretch", "_next"]).select(*at, F.col("_then").alias("_next")), "pass-jumps")
    # A time's start is the last one in its bucket up to it, or the last of the bucket before.
    heads = materialise(heads.distinct().withColumn("_head", F.lit(True)), "pass-starts")
    closes = heads.withColumn("_b", bucket("_u") + 1).groupBy(*keys, "_stretch", "_b").agg(F.max("_u").alias("_close"))
    upto = W.partitionBy(*keys, "_stretch", "_b").orderBy("_u").rowsBetween(W.unboundedPreceding, 0)
    lab = day.join(heads, at, "left").withColumn("_in", F.last(F.when(F.col("_head"), F.col("_u")), ignorenulls=True).over(upto))
    lab = lab.join(closes, [*keys, "_stretch", "_b"], "left").select(*keys, "_s", F.timestamp_micros(F.coalesce("_in", "_close")).alias("pass_t"))
    return det.withColumn("_s", F.col("t").cast("timestamp").cast("double")).join(lab, [*keys, "_s"]).drop("_s")


def match_period(det: DataFrame, sim_start, horizon: int, t: str = "pass_t") -> DataFrame:
    """Last forecast hour at or before the time, clamped to [0, horizon]."""
    h = F.floor((F.col(t).cast("timestamp").cast("double") - _ts(sim_start).cast("double")) / 3600.0)
    return det.withColumn("period", F.least(F.greatest(h, F.lit(0)), F.lit(horizon)))


def dist_to_footprint(points: DataFrame, arrival: DataFrame, grid: Grid, pid: str = "det_id") -> DataFrame:
    """Distance of each point to the footprint of its own hour (0 inside) and the inside flag.

    One nearest search keyed by hour. Only cells on the fire's edge at some hour are
    targets; a cell stays part of every later footprint.
    """
    edge = cl.ever_boundary(arrival, [])
    last = points.agg(F.max("period").alias("_last"))
    from hazardframe.operators.common import attach_all

    tgt = attach_all(edge.select("r", "c", "arrival"), last).filter("arrival <= _last")
    tgt = tgt.withColumn("period", F.explode(F.sequence(F.col("arrival").cast("long"), F.col("_last").cast("long"))))
    h = grid.cell / 2
    tgt = tgt.select("period", geo.cell_id("r", "c", grid.ncols).alias("tid"), (grid.x() - h).alias("x1"), (grid.y() - h).alias("y1"), (grid.x() + h).alias("x2"), (grid.y() + h).alias("y2"))
    inside = sp.inside_arrival(points, arrival, grid, [pid], []).withColumnRenamed("arrival", "_in")
    p = points.join(inside, pid, "left").withColumn("inside", F.coalesce(F.col("_in") <= F.col("period"), F.lit(False))).drop("_in")
    near = sp.nearest(p.filter("NOT inside"), tgt, [pid], ["period"], metric=sp.rect_distance).select(pid, F.col("dist").alias("_d"))
    return p.join(near, pid, "left").withColumn("dist", F.when(F.col("inside"), 0.0).otherwise(F.col("_d"))).drop("_d")


def distance_stats(df: DataFrame, keys: list[str], aggs: list[Column], col: str = "dist") -> DataFrame:
    """``aggs`` per group with mean, median, upper percentiles and maximum in whole metres."""
    shares = {"median_m": 0.5, "p75_m": 0.75, "p90_m": 0.9, "p95_m": 0.95}
    aggs = [*aggs, half_even(F.avg(col)).alias("mean_m"), half_even(F.max(col)).alias("max_m")]
    out = aggregate_with_percentiles(df, keys, aggs, F.col(col), shares)
    return out.withColumns({n: half_even(F.col(n)) for n in shares})


def _inclusion() -> list[Column]:
    return [
        F.count("*").alias("n_detections"), F.count_if("inside").alias("n_inside"),
        half_even(100 * F.avg(F.col("inside").cast("double"))).alias("inclusion_pct"),
        *[half_even(100 * F.avg((F.col("dist") <= b).cast("double"))).alias(f"within_{b}m_pct") for b in BUFFERS_M],
    ]


def pass_metrics(det: DataFrame, arrival: DataFrame, seed: DataFrame, grid: Grid, ox: float, oy: float) -> DataFrame:
    """Agreement of each pass with the footprint of its matched hour.

    The simulated direction is that of the growth (footprint minus seed) of that hour,
    taken from running sums over hours; the whole footprint serves where nothing grew.
    """
    m = distance_stats(det, ["pass_t", "period"], [*_inclusion(), F.avg("x").alias("vx"), F.avg("y").alias("vy")])
    a = arrival.join(seed.select("r", "c").withColumn("_seed", F.lit(1)), ["r", "c"], "left")
    grown = F.col("_seed").isNull()
    per = a.groupBy(F.col("arrival").cast("long").alias("a")).agg(
        F.count_if(grown).alias("g"), F.sum(F.when(grown, grid.x())).alias("gx"), F.sum(F.when(grown, grid.y())).alias("gy"),
        F.count("*").alias("n"), F.sum(grid.x()).alias("nx"), F.sum(grid.y()).alias("ny"),
    )
    from hazardframe.operators.common import attach_all

    j = attach_all(per, m.select("period").distinct()).filter("a <= period")
    c = j.groupBy("period").agg(*[F.sum(k).alias(k) for k in ("g", "gx", "gy", "n", "nx", "ny")])
    sx = F.when(F.col("g") > 0, F.col("gx") / F.col("g")).otherwise(F.col("nx") / F.when(F.col("n") > 0, F.col("n")))
    sy = F.when(F.col("g") > 0, F.col("gy") / F.col("g")).otherwise(F.col("ny") / F.when(F.col("n") > 0, F.col("n")))
    obs = geo.bearing(F.col("vx") - ox, F.col("vy") - oy)
    sim = geo.bearing(sx - ox, sy - oy)
    return m.join(c, "period", "left").withColumns({
        "obs_bearing_deg": half_even(obs), "sim_bearing_deg": half_even(sim), "direction_diff_deg": half_even(geo.ang_diff(sim, obs)),
    }).drop("vx", "vy", "g", "gx", "gy", "n", "nx", "ny")


def pooled_metrics(det: DataFrame) -> DataFrame:
    """All detections pooled, each with its own matched outcome."""
    require_empty(det.filter("dist IS NULL OR inside IS NULL").select("det_id"), "every scored detection needs a distance")
    return distance_stats(det, [], _inclusion())


def footprint_agreement(pred: DataFrame, det: DataFrame, grid: Grid, ox: float, oy: float) -> DataFrame:
    """IoU, precision and recall of a cell set against the union of detection discs, with
    nearest distances and direction."""
    disc = cl.disc_cells(det, SEED_RADIUS_M, grid, []).select("r", "c").distinct().withColumn("d", F.lit(1))
    p = pred.select("r", "c").withColumn("p", F.lit(1))
    b = p.join(disc, ["r", "c"], "full_outer").agg(
        F.count("p").alias("np"), F.count("d").alias("nd"), F.count_if(F.col("p").isNotNull() & F.col("d").isNotNull()).alias("ni"),
        F.avg(F.when(F.col("p") == 1, grid.x())).alias("px"), F.avg(F.when(F.col("p") == 1, grid.y())).alias("py"),
    )
    dd = dist_to_footprint(det.withColumn("period", F.lit(0).cast("long")), pred.select("r", "c").withColumn("arrival", F.lit(0).cast("long")), grid)
    aggs = [
        F.count("*").alias("n_detections"),
        half_even(100 * F.avg((F.col("dist") <= 375).cast("double"))).alias("within_pixel_pct"),
        half_even(100 * F.avg((F.col("dist") <= 1000).cast("double"))).alias("within_1km_pct"), F.avg("x").alias("vx"), F.avg("y").alias("vy"),
    ]
    v = aggregate_with_percentiles(dd, [], aggs, F.col("dist") / 1000, {"nn_median_km": 0.5}).withColumn("nn_median_km", F.round("nn_median_km", 2))
    one = b.withColumn("_k", F.lit(1)).join(v.withColumn("_k", F.lit(1)), "_k")
    sim, obs = geo.bearing(F.col("px") - ox, F.col("py") - oy), geo.bearing(F.col("vx") - ox, F.col("vy") - oy)
    return one.select(
        "n_detections", half_even(100.0 * F.col("ni") / (F.col("np") + F.col("nd") - F.col("ni"))).alias("iou_pct"),
        half_even(100.0 * F.col("ni") / F.col("np")).alias("precision_pct"), half_even(100.0 * F.col("ni") / F.col("nd")).alias("recall_pct"),
        "nn_median_km", "within_pixel_pct", "within_1km_pct", half_even(geo.ang_diff(sim, obs)).alias("direction_diff_deg"),
    )


def overspread(sim: DataFrame, seed: DataFrame, det: DataFrame, grid: Grid) -> DataFrame:
    """Growth area and its share farther than 1 km from every detection disc."""
    growth = sim.join(seed.select("r", "c"), ["r", "c"], "left_anti")
    near = cl.disc_cells(det, FAR_M + SEED_RADIUS_M, grid, []).select("r", "c").distinct().withColumn("_n", F.lit(1))
    km2 = grid.cell**2 / 1e6
    a = growth.join(near, ["r", "c"], "left").agg(F.count("*").alias("g"), F.count_if(F.col("_n").isNull()).alias("f"))
    pct = F.when(F.col("g") > 0, half_even(100.0 * F.col("f") / F.col("g"))).otherwise(F.lit(0))
    return a.select(F.round(F.col("g") * km2, 1).alias("growth_km2"), F.round(F.col("f") * km2, 1).alias("growth_far_km2"), pct.alias("growth_far_pct"))


def nearest_detection(cells: DataFrame, det: DataFrame, grid: Grid) -> DataFrame:
    """Nearest detection of each cell centre (ties: the smallest id)."""
    pts = cells.select("r", "c", grid.x().alias("x"), grid.y().alias("y"))
    out = sp.nearest(pts, det.select(F.col("det_id").alias("tid"), "x", "y"), ["r", "c"])
    return out.select("r", "c", F.col("tid").alias("det_id"), "dist")


def reconstruct_arrival(scar: DataFrame, det: DataFrame, grid: Grid) -> DataFrame:
    """Arrival hours of the real fire: each scar cell takes its nearest detection's time."""
    t = F.col("t").cast("timestamp")
    t0 = det.agg(F.date_trunc("hour", F.min(t)).alias("_t0"))
    from hazardframe.operators.common import attach_all

    near = nearest_detection(scar, det, grid).join(det.select("det_id", "t"), "det_id")
    hours = (F.col("t").cast("timestamp").cast("double") - F.col("_t0").cast("double")) / 3600.0
    return attach_all(near, t0).select("r", "c", hours.alias("arrival"), F.col("_t0").alias("t0"))


def extent_at(real: DataFrame, hours: float) -> DataFrame:
    return real.filter(F.col("arrival") <= hours)


def hourly_extents(real: DataFrame, cell: float) -> DataFrame:
    """Real burned area at every hour, hours before the first detection left out."""
    step = real.groupBy(F.greatest(F.ceil("arrival"), F.lit(0)).alias("hour"), "t0").agg(F.count("*").alias("_n"))
    span = step.groupBy("t0").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    hours = span.select("t0", F.explode(F.sequence("a", "b")).alias("hour"))
    w = W.partitionBy("t0").orderBy("hour")
    out = hours.join(step, ["t0", "hour"], "left").withColumn("n", F.sum(F.coalesce("_n", F.lit(0))).over(w))
    stamp = F.col("t0") + F.make_interval(hours=F.col("hour").cast("int"))
    return out.select("hour", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm").alias("time_utc"), F.round(F.col("n") * cell * cell / 1e6, 2).alias("km2"))


def arrival_timing(sim: DataFrame, real: DataFrame, seed: DataFrame, seed_h: float, off: float, end_h: float, cell: float) -> DataFrame:
    """Timing of the simulated against the real arrival in the forecast window."""
    s = sim.select("r", "c", (F.col("arrival") + off).alias("s"))
    a = real.select("r", "c", F.col("arrival").alias("a"))
    j = s.join(a, ["r", "c"], "full_outer").join(seed.select("r", "c"), ["r", "c"], "left_anti")
    win = F.col("a").isNotNull() & (F.col("a") > seed_h) & (F.col("a") <= end_h)
    hit = win & F.col("s").isNotNull()
    late = F.when(F.coalesce(hit, F.lit(False)), F.col("s") - F.col("a"))
    j, err = j.withColumn("_err", late), F.col("_err")
    km2 = cell * cell / 1e6
    n_win, n_hit = F.count_if(win), F.count(err)
    aggs = [
        F.round(n_win * km2, 4).alias("real_window_km2"), half_even(100.0 * n_hit / F.greatest(n_win, F.lit(1))).alias("sim_reached_pct"),
        F.round(F.avg(F.abs(err)), 4).alias("timing_mae_h"),
        half_even(100.0 * F.count_if(err < 0) / F.when(n_hit > 0, n_hit)).alias("early_pct"),
        F.round(F.count_if((F.col("a") > end_h) & F.col("s").isNotNull()) * km2, 4).alias("ahead_km2"),
        F.round(F.count_if(F.col("a").isNull() & F.col("s").isNotNull()) * km2, 4).alias("outside_scar_km2"),
    ]
    return aggregate_with_percentiles(j, [], aggs, err, {"timing_median_h": 0.5}).withColumn("timing_median_h", F.round("timing_median_h", 1))


def anchor_sensitivity(det: DataFrame, arrival: DataFrame, grid: Grid, anchors: list[tuple[str, str]], horizon: int) -> DataFrame:
    """The pooled scores under each time anchor (name, simulation start)."""
    arr = F.array(*[F.struct(F.lit(n).alias("anchor"), F.lit(t).cast("timestamp").alias("_t0")) for n, t in anchors])
    d = det.withColumn("_a", F.explode(arr)).select("det_id", "x", "y", "t", "_a.*")
    h = F.floor((F.col("t").cast("timestamp").cast("double") - F.col("_t0").cast("double")) / 3600.0)
    d = d.withColumn("period", F.least(F.greatest(h, F.lit(0)), F.lit(horizon)))
    d = d.withColumn("det_id", F.concat_ws("@", F.col("det_id"), F.col("anchor")))
    scored = dist_to_footprint(d, arrival, grid)
    return distance_stats(scored, ["anchor"], _inclusion())
