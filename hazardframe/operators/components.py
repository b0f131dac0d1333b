"""Connected components by alternating large-star and small-star steps.

The edge list shrinks to one star per component in a logarithmic number of rounds, with
map-side pre-aggregated minima, so neither long chains nor hub nodes slow it down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.operators.cells import RUN, shift
from hazardframe.operators.common import fingerprint, global_rank, materialise, materialise_observed


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest member id of each node's component, for nodes that have an edge."""
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    state = None
    while True:
        # Each star reads its input twice, so each is written once instead of computed twice.
        e, now = materialise_observed(_small_star(materialise(_large_star(e), "cc")), "cc", n=F.count(F.lit(1)), h=fingerprint("u", "v"))
        if state == now:
            break
        state = now
    star = e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return star.union(star.select(F.col("comp").alias("id"), "comp").distinct())


def cell_id(keys: list[str], c: str = "c") -> Column:
    """A cell's identity over all grids: sorts by the grid's keys (any number and type), then row-major."""
    return F.struct(*keys, "r", F.col(c).alias("c"))


def cell_components(cells: DataFrame, conn: int = 8, keys=RUN) -> DataFrame:
    """Cells with ``comp``: the identity (keys, r, c) of the component's first cell in row-major order.

    Cells of one row that follow each other are one node, numbered by its first cell's place in
    that order, so the graph has row runs as nodes, whole numbers as ids, and links only between
    neighbouring rows.
    """
    keys = list(keys)
    w = W.partitionBy(*keys, "r").orderBy("c")
    base = cells.select(*keys, "r", "c").withColumn("_g", F.col("c") - F.row_number().over(w))
    base = materialise(base.withColumn("_s", F.min("c").over(W.partitionBy(*keys, "r", "_g"))).drop("_g"), "row-runs")
    first = base.filter("c = _s").select(*keys, "r", "_s")
    first = materialise(global_rank(first, [F.col(k) for k in (*keys, "r", "_s")], "id"), "run-ids")
    base = materialise(base.join(first, [*keys, "r", "_s"]).drop("_s"), "numbered")
    steps = [(1, -1), (1, 0), (1, 1)] if conn == 8 else [(1, 0)]
    below = shift(base, steps, [*keys, "id"]).select(*keys, "r", "c", F.col("id").alias("_from"))
    e = below.join(base, [*keys, "r", "c"]).select(F.col("_from").alias("u"), F.col("id").alias("v")).distinct()
    named = first.select(F.col("id").alias("_c"), cell_id(keys, "_s").alias("comp"))
    of = first.select("id").join(components(e).withColumnRenamed("comp", "_c"), "id", "left").withColumn("_c", F.coalesce("_c", "id"))
    return base.join(of.join(named, "_c").drop("_c"), "id").drop("id")


def front_components(pins: DataFrame, d: float = 375.0, pid: str = "pin_id") -> DataFrame:
    """Fronts: pins linked transitively by distances of at most ``d``.

    Buckets of side d / 6 are linked first: bucket pairs that lie wholly within ``d`` join
    all their pins at once. Pins are compared one by one only between buckets that are
    still in different fronts, so a crowded place never becomes a product of pins.
    """
    g = d / 6.0
    b = pins.select(pid, "x", "y", F.floor(F.col("x") / g).alias("bx"), F.floor(F.col("y") / g).alias("by"))
    hub = materialise(b.groupBy("bx", "by").agg(F.min(pid).alias("hub")), "hubs")
    steps = [(i, j) for i in range(0, 8) for j in range(-7, 8)
             if (i, j) > (0, 0) and max(i - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2 <= 36]
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit((i + 1) ** 2 + (abs(j) + 1) ** 2 <= 36).alias("sure")) for i, j in steps])
    near = hub.withColumn("o", F.explode(arr))
    near = near.select("hub", "bx", "by", (F.col("bx") + F.col("o.i")).alias("bx2"), (F.col("by") + F.col("o.j")).alias("by2"), "o.sure")
    near = near.join(hub.select(F.col("bx").alias("bx2"), F.col("by").alias("by2"), F.col("hub").alias("hub2")), ["bx2", "by2"])
    sure = components(near.filter("sure").select(F.col("hub").alias("u"), F.col("hub2").alias("v")))
    first = hub.join(sure.withColumnRenamed("id", "hub"), "hub", "left").withColumn("comp", F.coalesce("comp", "hub"))
    first = materialise(first, "fronts")
    la = first.select("hub", F.col("comp").alias("ca"))
    lb = first.select(F.col("hub").alias("hub2"), F.col("comp").alias("cb"))
    open_pairs = near.filter("NOT sure").join(la, "hub").join(lb, "hub2").filter("ca <> cb")
    spots = b.select("bx", "by", "x", "y").distinct()
    pa = open_pairs.join(spots, ["bx", "by"])
    pb = spots.select(F.col("bx").alias("bx2"), F.col("by").alias("by2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    hit = pa.join(pb, ["bx2", "by2"]).filter(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= d)
    links = components(hit.select(F.col("ca").alias("u"), F.col("cb").alias("v")).distinct())
    final = first.join(links.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    final = final.select("bx", "by", F.coalesce("top", "comp").alias("front"))
    return b.join(final, ["bx", "by"]).select(pid, "front").join(pins, pid)


def drop_specks(comps: DataFrame, cell: float, min_area: float = 2e4, keys=RUN) -> DataFrame:
    """Cells of components of at least ``min_area``; the largest is kept when all are smaller."""
    size = comps.groupBy(*keys, "comp").agg((F.count("*") * cell * cell).alias("area"))
    top = size.groupBy(*keys).agg(F.max("area").alias("top"), F.min_by("comp", F.struct(-F.col("area"), "comp")).alias("big"))
    keep = size.join(top, list(keys)).filter((F.col("area") >= min_area) | ((F.col("top") < min_area) & (F.col("comp") == F.col("big"))))
    return comps.join(keep.select(*keys, "comp"), [*keys, "comp"], "left_semi")


def fill_holes(cells: DataFrame, keys=RUN) -> DataFrame:
    """Footprint with the unburned islands of each 4-connected part filled in.

    A row of a part is burned cells with gaps between them; what lies before the first and after
    the last cell is outside. Gaps of neighbouring rows are linked where they share a column, and to
    the outside where they reach past the neighbouring row's cells. Gaps that no chain links to
    the outside are islands. The work follows the part's outline, not its bounding box.
    """
    keys = list(keys)
    part = materialise(cell_components(cells, 4, keys).select(*keys, "comp", "r", "c"), "parts")
    rows = materialise(part.groupBy(*keys, "comp", "r").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count(F.lit(1)).alias("_n")), "part-rows")
    w = W.partitionBy(*keys, "comp", "r").orderBy("c")  # cells of one row of one grid
    holed = rows.filter("_hi - _lo + 1 > _n").select(*keys, "comp", "r")
    gaps = part.join(holed, [*keys, "comp", "r"], "left_semi").withColumn("_next", F.lead("c").over(w)).filter("_next > c + 1")
    gaps = gaps.select(*keys, "comp", "r", (F.col("c") + 1).alias("a"), (F.col("_next") - 1).alias("b"))
    gaps = materialise(global_rank(gaps, [F.col("comp"), F.col("r"), F.col("a")], "id"), "gaps")
    # The gap of the next or previous row that holds a gap's first column; every overlap begins at such a column.
    step = F.explode(F.array(F.lit(-1), F.lit(1))).alias("_step")
    asked = gaps.select("comp", "r", "a", "id", step).select("comp", (F.col("r") + F.col("_step")).alias("r"), F.col("a").alias("at"), F.lit(1).alias("_ask"), F.col("id").alias("_from"), F.lit(None).cast("struct<b:bigint,id:bigint>").alias("_gap"))
    held = gaps.select("comp", "r", F.col("a").alias("at"), F.lit(0).alias("_ask"), F.lit(None).cast("long").alias("_from"), F.struct(F.col("b").cast("long").alias("b"), F.col("id").cast("long").alias("id")).alias("_gap"))
    before = W.partitionBy("comp", "r").orderBy("at", "_ask").rowsBetween(W.unboundedPreceding, 0)
    met = held.unionByName(asked).withColumn("_last", F.last("_gap", ignorenulls=True).over(before))
    inner = met.filter("_ask = 1 AND _last.b >= at").select(F.col("_from").alias("u"), F.col("_last.id").alias("v"))
    beside = gaps.select("comp", "r", "a", "b", "id", step).withColumn("r", F.col("r") + F.col("_step"))
    beside = beside.join(rows.select("comp", "r", "_lo", "_hi"), ["comp", "r"], "left")
    outer = beside.filter("_lo IS NULL OR a < _lo OR b > _hi").select(F.col("id").cast("long").alias("u"), F.lit(0).cast("long").alias("v"))
    links = inner.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).unionByName(outer.distinct())
    reached = components(links).filter("comp = 0").select("id")
    holes = gaps.join(reached, "id", "left_anti").withColumn("c", F.explode(F.sequence("a", "b"))).select(*keys, "r", "c")
    return cells.select(*keys, "r", "c").union(holes).distinct()
