"""Boundary rings of cell sets, chainage samples along them, and runs of samples.

A ring is a linked list of directed cell sides. Links inside a block of sides are followed in one
task; what leaves a block is joined by pointer doubling, so the number of rounds grows with the
logarithm of the blocks a ring meets and no ring is ever held by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.functions.base import dbl
from hazardframe.functions.geo import segment_distance
from hazardframe.operators.cells import RUN, Grid, shift
from hazardframe.operators.common import fingerprint, global_rank, is_empty, materialise, materialise_observed
from hazardframe.operators.components import cell_id

SPACING_M = 30.0
#: Sides whose links one task follows at once.
BLOCK_SIDES = 65_536
# Sides of a cell in clockwise order from the top: (neighbour offset, from corner, to corner).
_SIDES = [((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0))]


def boundary_sides(cells: DataFrame, keys=RUN) -> DataFrame:
    """Directed sides between the set and its outside, the set on the right-hand side.

    ``side_id`` names them; corners are in grid units (row, column).
    """
    keys = list(keys)
    base = cells.select(*keys, "r", "c").distinct()
    arr = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(n[0]).alias("nr"), F.lit(n[1]).alias("nc"), F.lit(a[0]).alias("ar"),
                 F.lit(a[1]).alias("ac"), F.lit(b[0]).alias("br"), F.lit(b[1]).alias("bc"))
        for k, (n, a, b) in enumerate(_SIDES)
    ])
    s = base.withColumn("id", cell_id(keys)).withColumn("s", F.explode(arr))
    s = s.select(
        *keys, "id", F.col("s.k").alias("k"), (F.col("r") + F.col("s.nr")).alias("nr"), (F.col("c") + F.col("s.nc")).alias("nc"),
        (F.col("r") + F.col("s.ar")).alias("ar"), (F.col("c") + F.col("s.ac")).alias("ac"),
        (F.col("r") + F.col("s.br")).alias("br"), (F.col("c") + F.col("s.bc")).alias("bc"),
    )
    there = base.select(*keys, F.col("r").alias("nr"), F.col("c").alias("nc"))
    return s.join(there, [*keys, "nr", "nc"], "left_anti").withColumn("side_id", F.struct("id", "k"))


def _next_sides(sides: DataFrame, keys) -> DataFrame:
    """Each side's follower by number; where two start at one corner, the one of the same cell."""
    out = sides.select(*keys, F.col("ar").alias("br"), F.col("ac").alias("bc"), F.col("side").alias("nxt"), F.col("side_id.id").alias("_nid"))
    j = sides.join(out, [*keys, "br", "bc"])
    pick = F.min_by("nxt", F.when(F.col("_nid") == F.col("side_id.id"), 0).otherwise(1))
    return j.groupBy("side").agg(pick.alias("nxt"))


def _stretches(rows: pd.DataFrame) -> pd.DataFrame:
    """One block's links (side, nxt) as stretches inside the block.

    Rings that close inside the block get ``head`` (their smallest side) and ``seq``; sides of other stretches get the
    stretch's first side ``chain`` and their place ``off`` in it, the last one also the next stretch ``exit``.
    """
    side, nxt = rows["side"].to_numpy(), rows["nxt"].to_numpy()
    order = np.argsort(side)
    side, nxt = side[order], nxt[order]
    n = len(side)
    to = np.searchsorted(side, nxt)
    inside = (to < n) & (side[np.minimum(to, n - 1)] == nxt)
    here = np.arange(n)
    prev = here.copy()  # a stretch's first side leads to itself
    prev[to[inside]] = here[inside]

    def walk(prev: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the way back ends, the steps to there, and the least side met."""
        at, steps = prev.copy(), (prev != here).astype(np.int64)
        low = np.minimum(low, low[at])
        for _ in range(max(1, int(n).bit_length())):
            steps, low, at = steps + steps[at], np.minimum(low, low[at]), at[at]
        return at, steps, low

    end, steps, low = walk(prev, here)
    open_ = prev[end] == end
    # A ring inside the block is cut at its smallest side.
    cut = np.where(~open_ & (low == here), here, prev)
    _, seq, _ = walk(cut, here)
    out = pd.DataFrame({"side": side, "head": side[low], "seq": seq, "chain": side[end], "off": steps, "exit": nxt})
    out.loc[open_, ["head", "seq"]] = -1
    out.loc[~open_, ["chain", "off"]] = -1
    out.loc[~open_ | inside, "exit"] = -1
    return out


def boundary_rings(cells: DataFrame, keys=RUN, exterior_only: bool = True, block: int = BLOCK_SIDES) -> DataFrame:
    """Closed boundary rings: one row per side with ``ring_id`` (its first side: cell and side number), position ``seq`` and length ``n_ring``.

    Cells that touch only at a corner belong to different rings. With ``exterior_only``
    the rings around islands (counter-clockwise) are left out.

    Sides are numbered in row-major order and dealt to blocks of ``block`` numbers. Inside a block links are followed at
    once; only the stretches of rings that leave a block are joined by doubling.
    """
    keys = list(keys)
    sides = materialise(boundary_sides(cells, keys).drop("id", "k", "nr", "nc"), "sides")
    sides = materialise(global_rank(sides, [*[F.col(f"side_id.id.{c}") for c in [*keys, "r", "c"]], F.col("side_id.k")], "side"), "sides")
    link = _next_sides(sides, keys)
    # Few hashed tasks would hold many blocks; the number of tasks follows the number of blocks.
    n = sides.agg(F.max("side")).first()[0] or 0
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // block))
    link = link.withColumn("_b", F.floor((F.col("side") - 1) / block)).repartition(tasks, "_b")
    part = link.groupBy("_b").applyInPandas(lambda rows: _stretches(rows), "side long, head long, seq long, chain long, off long, exit long")
    part = materialise(part, "stretches")
    whole = part.filter("chain < 0").select("side", "head", "seq")
    loose = part.filter("chain >= 0").select("side", "chain", "off", "exit")
    chains = loose.groupBy("chain").agg(
        F.max("exit").alias("nxt"), F.count(F.lit(1)).alias("len"), F.min("side").alias("low"), F.min_by("off", "side").alias("low_off"))
    chains = materialise(chains, "chains")
    if not is_empty(chains):
        whole = whole.unionByName(_join_stretches(loose, chains))
    out = sides.join(whole, "side")
    # Twice the signed area in grid units: positive for rings around the set.
    size = out.groupBy("head").agg(
        F.count("*").alias("n_ring"), F.sum(F.col("ac") * F.col("br") - F.col("bc") * F.col("ar")).alias("area2"), F.min_by("side_id", "side").alias("ring_id")
    )
    if exterior_only:
        size = size.filter("area2 > 0")
    out = out.join(size, "head")
    return out.select(*keys, "ring_id", "seq", "n_ring", "area2", "ar", "ac", "br", "bc")


def _join_stretches(loose: DataFrame, chains: DataFrame) -> DataFrame:
    """(side, head, seq) of rings made of several stretches."""
    # Doubling pass 1: smallest side of the ring, with its stretch.
    cur = chains.select("chain", F.col("nxt").alias("ptr"), F.struct("low", "low_off", F.col("chain").alias("at")).alias("low"))
    prev_sum = None
    while True:
        hop = cur.select(F.col("chain").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        step = cur.join(hop, "ptr").select("chain", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"))
        cur, now = materialise_observed(step, "ring", h=fingerprint("chain", "low"))
        if now == prev_sum:
            break
        prev_sum = now
    ring = cur.select("chain", "low")
    total = materialise(chains.select("chain", "len").join(ring, "chain").groupBy("low").agg(F.sum("len").alias("n_ring")), "ring-lengths")
    # Doubling pass 2: sides from the first stretch's start, walking backwards until it is reached.
    back = chains.select(F.col("nxt").alias("chain"), F.col("chain").alias("ptr"), "len").join(ring, "chain")
    at_head = F.col("chain") == F.col("low.at")
    rank = back.select("chain", "low", F.when(at_head, F.col("chain")).otherwise(F.col("ptr")).alias("ptr"), F.when(at_head, 0).otherwise(F.col("len")).alias("seq"))
    while True:
        rank, left = materialise_observed(rank, "rank", n=F.count_if(F.col("ptr") != F.col("low.at")))
        if not left["n"]:
            break
        hop = rank.select(F.col("chain").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("seq").alias("seq2"))
        rank = rank.join(hop, "ptr").select("chain", "low", F.col("ptr2").alias("ptr"), (F.col("seq") + F.col("seq2")).alias("seq"))
    placed = rank.join(total, "low").select("chain", F.col("low.low").alias("head"), F.col("low.low_off").alias("_from"), F.col("seq").alias("_at"), "n_ring")
    seq = F.pmod(F.col("_at") + F.col("off") - F.col("_from"), F.col("n_ring"))
    return loose.join(placed, "chain").select("side", "head", seq.alias("seq"))


def ring_segments(rings: DataFrame, grid: Grid, keys=RUN) -> DataFrame:
    """Ring sides in map metres."""
    x, y = (lambda c: F.col(c) * grid.cell + grid.x0), (lambda r: F.lit(grid.y_top) - F.col(r) * grid.cell)
    return rings.select(
        *keys, "ring_id", "seq", "n_ring", x("ac").alias("x1"), y("ar").alias("y1"), x("bc").alias("x2"), y("br").alias("y2")
    )


def sample_rings(segs: DataFrame, spacing: float = SPACING_M, keys=RUN, side: float | None = None) -> DataFrame:
    """Points every ``spacing`` metres along each ring from its start, closing point left out.

    With equal sides (``side``) the chainage is known per row and no ring-wide window is needed.
    """
    ring = [*keys, "ring_id"]
    if side is not None:
        s = segs.withColumns({"_len": F.lit(float(side)), "_from": F.col("seq") * float(side)})
    else:
        w = W.partitionBy(*ring).orderBy("seq")
        s = segs.withColumn("_len", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
        s = s.withColumn("_from", F.sum("_len").over(w) - F.col("_len"))
    lo = F.ceil(F.col("_from") / spacing)
    hi = F.ceil((F.col("_from") + F.col("_len")) / spacing) - 1
    s = s.filter(hi >= lo).withColumn("idx", F.explode(F.sequence(lo, hi)))
    t = (F.col("idx") * spacing - F.col("_from")) / F.col("_len")
    return s.select(
        *ring, "idx", (F.col("idx") * spacing).alias("chainage_m"),
        (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"),
    )


def frame_distance(x, y, box: tuple[float, float, float, float]) -> Column:
    """Distance of a point to the border of an axis-aligned window."""
    xmin, ymin, xmax, ymax = (float(v) for v in box)
    corners = [(xmin, ymin, xmax, ymin), (xmax, ymin, xmax, ymax), (xmax, ymax, xmin, ymax), (xmin, ymax, xmin, ymin)]
    return F.least(*[segment_distance(x, y, *(F.lit(v) for v in s)) for s in corners])


def exclude_samples(samples: DataFrame, box, tol: float = SPACING_M, side: str = "real") -> DataFrame:
    """Marks samples outside the window or near its frame; the two marks never overlap."""
    xmin, ymin, xmax, ymax = (float(v) for v in box)
    inside = (F.col("x") > xmin) & (F.col("x") < xmax) & (F.col("y") > ymin) & (F.col("y") < ymax)
    near = frame_distance("x", "y", box) <= tol
    outside = ~inside if side == "real" else F.lit(False)
    out = samples.withColumn("outside", outside).withColumn("near_frame", near & ~F.col("outside"))
    return out.withColumn("excluded", F.col("outside") | F.col("near_frame"))


def strip_frame(segs: DataFrame, box, tol: float = SPACING_M) -> DataFrame:
    """Axis-aligned target segments without their parts within ``tol`` of the window's frame.

    Each segment is cut at the frame band's edges and the pieces inside the band dropped.
    """
    xmin, ymin, xmax, ymax = (float(v) for v in box)
    horiz = F.col("y1") == F.col("y2")
    lo, hi = F.when(horiz, F.least("x1", "x2")).otherwise(F.least("y1", "y2")), F.when(horiz, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2"))
    a, b = F.when(horiz, F.lit(xmin)).otherwise(F.lit(ymin)), F.when(horiz, F.lit(xmax)).otherwise(F.lit(ymax))
    cuts = [c for edge in (a, b) for c in (edge - tol, edge + tol)]
    pts = F.array_sort(F.filter(F.array(lo, hi, *cuts), lambda v: (v >= lo) & (v <= hi)))
    s = segs.withColumns({"_h": horiz, "_fix": F.when(horiz, F.col("y1")).otherwise(F.col("x1")), "_pts": pts})
    s = s.withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_pts") - 1)))
    s = s.withColumns({"_a": F.element_at("_pts", F.col("_i")), "_b": F.element_at("_pts", F.col("_i") + 1)})
    s = s.filter("_b > _a").withColumn("_m", (F.col("_a") + F.col("_b")) / 2)
    mx, my = F.when(F.col("_h"), F.col("_m")).otherwise(F.col("_fix")), F.when(F.col("_h"), F.col("_fix")).otherwise(F.col("_m"))
    s = s.filter(frame_distance(mx, my, box) > tol)
    keep = [c for c in segs.columns if c not in ("x1", "y1", "x2", "y2")]
    return s.select(
        *keep, F.when(F.col("_h"), F.col("_a")).otherwise(F.col("_fix")).alias("x1"), F.when(F.col("_h"), F.col("_fix")).otherwise(F.col("_a")).alias("y1"),
        F.when(F.col("_h"), F.col("_b")).otherwise(F.col("_fix")).alias("x2"), F.when(F.col("_h"), F.col("_fix")).otherwise(F.col("_b")).alias("y2"),
    )


def ring_runs(samples: DataFrame, keys: list[str], threshold: float = 60.0, min_points: int = 5) -> DataFrame:
    """Circular runs of samples beyond the threshold, of one sign.

    ``samples`` has ring keys, idx, signed_m, excluded. A run across the closing point is
    one run. Runs of at least ``min_points`` are zones, shorter ones isolated extremes.
    """
    cls = F.when(F.col("excluded"), 0).when(F.col("signed_m") > threshold, 1).when(F.col("signed_m") < -threshold, -1).otherwise(0)
    w = W.partitionBy(*keys).orderBy("idx")
    s = samples.withColumn("cls", F.coalesce(cls, F.lit(0)))
    s = s.withColumn("_new", (F.coalesce(F.lag("cls").over(w), F.lit(9)) != F.col("cls")).cast("long"))
    s = s.withColumn("run", F.sum("_new").over(w))
    a = F.abs(F.col("signed_m"))
    runs = s.groupBy(*keys, "run", "cls").agg(
        F.min("idx").alias("start_idx"), F.count("*").alias("n_points"), F.sum(a).alias("_s"), F.max(a).alias("max_abs_m")
    )
    ends = runs.groupBy(*keys).agg(
        F.max("run").alias("last"), F.min_by("cls", "run").alias("c0"), F.max_by("cls", "run").alias("c1")
    )
    joined = runs.join(ends, keys)
    wraps = (F.col("last") > 1) & (F.col("c0") == F.col("c1")) & (F.col("run") == 1)
    joined = joined.withColumn("run", F.when(wraps, F.col("last")).otherwise(F.col("run")))
    out = joined.groupBy(*keys, "run", "cls").agg(
        F.max("start_idx").alias("start_idx"), F.sum("n_points").alias("n_points"), F.sum("_s").alias("_s"), F.max("max_abs_m").alias("max_abs_m")
    ).filter("cls <> 0")
    kind = F.when(F.col("n_points") >= min_points, "zone").otherwise("isolated_extreme")
    return out.select(
        *keys, "start_idx", "n_points", F.col("cls").alias("sign"), kind.alias("kind"),
        F.round(F.col("_s") / F.col("n_points"), 1).alias("mean_abs_m"), F.round("max_abs_m", 1).alias("max_abs_m"),
    )


def zone_table(samples: DataFrame, keys=("direction", "ring_id"), spacing: float = SPACING_M) -> DataFrame:
    """All runs numbered by direction and ring (zones before extremes), with meaning and length.

    The numbering windows only over runs, and runs are few compared to samples; offsets
    per ring are added from per-ring counts.
    """
    keys = list(keys)
    runs = ring_runs(samples, keys)
    order = [F.when(F.col("kind") == "zone", 0).otherwise(1), F.col("start_idx")]
    runs = runs.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    per = runs.groupBy(*keys).agg(F.count("*").alias("_k"))
    per = per.withColumn("_off", F.sum("_k").over(W.orderBy(*keys)) - F.col("_k"))
    out = runs.join(per, keys)
    meaning = F.when(F.col("sign") > 0, "over-extension").otherwise("lag")
    return out.select(
        (F.col("_n") + F.col("_off")).alias("zone_id"), *keys, "kind", "sign", meaning.alias("meaning"), "n_points",
        F.bround(F.col("n_points") * spacing, 0).cast("long").alias("length_m"), "start_idx", "mean_abs_m", "max_abs_m",
    )


def zone_lines(zones: DataFrame, samples: DataFrame, keys=("direction", "ring_id")) -> DataFrame:
    """Each run's samples in order, positions wrapping around the ring."""
    keys = list(keys)
    n = samples.groupBy(*keys).agg(F.count("*").alias("_n"))
    steps = zones.join(n, keys).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_points") - 1)))
    steps = steps.withColumn("idx", F.pmod(F.col("start_idx") + F.col("step"), F.col("_n")))
    pts = samples.select(*keys, "idx", "x", "y")
    kind = F.when(F.col("n_points") == 1, "Point").otherwise("LineString")
    return steps.join(pts, [*keys, "idx"]).select("zone_id", *keys, kind.alias("geom"), "step", "idx", "x", "y")


def cell_sides_classes(segs: DataFrame, intensity: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Suppression class of each side: the largest intensity in the 3 x 3 cells around its midpoint."""
    from hazardframe.functions.geo import supp_class

    mid = segs.withColumn("c", grid.col_of((dbl("x1") + dbl("x2")) / 2)).withColumn("r", grid.row_of((dbl("y1") + dbl("y2")) / 2))
    # The window is looked at once per cell, not once per side.
    own = [*keys, "_mr", "_mc"]
    at = mid.select(*keys, F.col("r").alias("_mr"), F.col("c").alias("_mc")).distinct().withColumns({"r": F.col("_mr"), "c": F.col("_mc")})
    at = shift(at, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], own)
    # The window is clamped at the grid's edge.
    at = at.withColumn("r", F.least(F.greatest("r", F.lit(0)), F.lit(grid.nrows - 1))).withColumn("c", F.least(F.greatest("c", F.lit(0)), F.lit(grid.ncols - 1)))
    hit = at.join(intensity.select(*keys, "r", "c", "fi"), [*keys, "r", "c"])
    best = hit.groupBy(*own).agg(F.max("fi").alias("fi")).withColumnsRenamed({"_mr": "r", "_mc": "c"})
    out = mid.join(best, [*keys, "r", "c"], "left").select(*segs.columns, F.coalesce("fi", F.lit(0)).alias("fi"))
    return out.withColumn("cls", supp_class("fi"))


def front_classes(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Length shares of the four classes in percent and the dominant class (ties: the lowest)."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    agg = sides.groupBy(*keys).agg(*[F.sum(F.when(F.col("cls") == k, length).otherwise(0.0)).alias(f"l{k}") for k in range(1, 5)])
    total = sum((F.col(f"l{k}") for k in range(2, 5)), F.col("l1"))
    pct = [F.coalesce(100.0 * F.col(f"l{k}") / F.when(total > 0, total), F.lit(0.0)) for k in range(1, 5)]
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-k).alias("k")) for k, p in enumerate(pct, 1)]))
    return agg.select(*keys, *[p.alias(f"pct{k}") for k, p in enumerate(pct, 1)], F.when(best["p"] > 0, -best["k"]).otherwise(0).alias("dom"))
