"""Cell-table algebra: a footprint is a table of cells with the hour each first burned.

``keys`` are the columns that separate independent grids (a run, a case); ``r`` and ``c``
are row and column counted from the north-west corner.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.functions import geo
from hazardframe.functions.base import dbl
from hazardframe.operators.common import BROADCAST_LIMIT_BYTES, aggregate_with_percentiles, estimated_bytes, materialise, materialise_observed, small

RUN = ["run_id"]


@dataclass(frozen=True)
class Grid:
    """Placement of a north-up grid in map metres."""

    x0: float
    y_top: float
    cell: float
    nrows: int
    ncols: int

    def x(self, c="c") -> Column:
        return geo.cell_x(c, self.x0, self.cell)

    def y(self, r="r") -> Column:
        return geo.cell_y(r, self.y_top, self.cell)

    def col_of(self, x) -> Column:
        return F.floor((dbl(x) - self.x0) / self.cell)

    def row_of(self, y) -> Column:
        return F.floor((F.lit(self.y_top) - dbl(y)) / self.cell)

    def box(self) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax of the grid."""
        return (self.x0, self.y_top - self.nrows * self.cell, self.x0 + self.ncols * self.cell, self.y_top)


def offsets(radius: float, inclusive: bool = True) -> list[tuple[int, int]]:
    """Cell offsets whose centres lie within ``radius`` cells."""
    n = int(math.floor(radius))
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= radius * radius]


def shift(df: DataFrame, steps: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """Each cell repeated at every offset; ``dr`` and ``dc`` are kept."""
    arr = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i, j in steps])
    out = df.select(*keep, "r", "c", F.explode(arr).alias("_o"))
    return out.select(
        *keep, (F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c"),
        F.col("_o.dr").alias("dr"), F.col("_o.dc").alias("dc"),
    )


def footprint(arrival: DataFrame, period) -> DataFrame:
    return arrival.filter(F.col("arrival") <= period)


def perimeter_stats(arrival: DataFrame, cell: float, keys=RUN) -> DataFrame:
    """Burned cells and raw area per hour, every hour from the first to the last."""
    new = arrival.groupBy(*keys, F.col("arrival").alias("period")).agg(F.count("*").alias("n_new"))
    span = new.groupBy(*keys).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    hours = span.select(*keys, F.explode(F.sequence("a", "b")).alias("period"))
    w = W.partitionBy(*keys).orderBy("period")
    out = hours.join(new, [*keys, "period"], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    out = out.withColumn("n_cells", F.sum("n_new").over(w))
    return out.withColumn("area_m2", F.col("n_cells") * float(cell) ** 2)


def growth_rings(arrival: DataFrame, cell: float, keys=RUN) -> DataFrame:
    """Newly burned area per hour (the first hour is the seed) and the change in km2."""
    s = perimeter_stats(arrival, cell, keys)
    w = W.partitionBy(*keys).orderBy("period")
    km2 = F.col("area_m2") / 1e6
    return s.select(
        *keys, "period", "n_new", F.round(km2, 4).alias("km2"),
        F.round(km2 - F.coalesce(F.lag(km2).over(w), km2), 4).alias("d_km2"),
    )


def cells_union(a: DataFrame, b: DataFrame, keys=RUN) -> DataFrame:
    k = [*keys, "r", "c"]
    return a.select(*k).union(b.select(*k)).distinct()


def cells_minus(a: DataFrame, b: DataFrame, keys=RUN) -> DataFrame:
    return a.join(b.select(*keys, "r", "c"), [*keys, "r", "c"], "left_anti")


def cells_intersect(a: DataFrame, b: DataFrame, keys=RUN) -> DataFrame:
    return a.join(b.select(*keys, "r", "c"), [*keys, "r", "c"], "left_semi")


def pick_footprint(arrival: DataFrame, period: int | None, grid: Grid, keys=RUN) -> DataFrame:
    """Centroid and size of the final footprint, or of the given hour's."""
    df = arrival if period is None else footprint(arrival, period)
    return df.groupBy(*keys).agg(
        F.max("arrival").alias("period"), F.count("*").alias("n_cells"),
        F.avg(grid.x()).alias("cx"), F.avg(grid.y()).alias("cy"),
    )


def ros_grid(messages: DataFrame, nrows: int, ncols: int, keys=RUN) -> DataFrame:
    """Fastest spread rate that reached each cell; ids outside the grid are dropped."""
    ok = messages.filter(F.col("target").between(1, nrows * ncols))
    best = ok.groupBy(*keys, "target").agg(F.max("ros").alias("ros"))
    return best.select(*keys, geo.cell_row("target", ncols).alias("r"), geo.cell_col("target", ncols).alias("c"), "ros")


def sector_areas(cells: DataFrame, ox, oy, grid: Grid, keys=RUN) -> DataFrame:
    """Area in km2 by compass sector (sector 0 centred on north) around an origin."""
    b = geo.bearing(grid.x() - dbl(ox), grid.y() - dbl(oy))
    sector = F.floor(F.pmod(b + 22.5, F.lit(360.0)) / 45.0).cast("int")
    named = F.element_at(F.array(*[F.lit(n) for n in geo.COMPASS]), sector + 1)
    km2 = (grid.cell**2) / 1e6
    return cells.groupBy(*keys, named.alias("sector")).agg(F.round(F.count("*") * km2, 4).alias("km2"))


def resample_nearest(target: DataFrame, tgrid: Grid, source: DataFrame, sgrid: Grid, nodata) -> DataFrame:
    """Nearest source value of each target cell centre; outside the source: ``nodata``.

    The source index is computed, so this is an equi-join on (row, column).
    """
    xmin, ymin, xmax, ymax = sgrid.box()
    x, y = tgrid.x(), tgrid.y()

    def index(v: Column, n: int) -> Column:
        return F.least(F.greatest(F.bround(v - 0.5, 0).cast("long"), F.lit(0)), F.lit(n - 1))

    keyed = target.withColumn("_sc", index((x - sgrid.x0) / sgrid.cell, sgrid.ncols))
    keyed = keyed.withColumn("_sr", index((F.lit(sgrid.y_top) - y) / sgrid.cell, sgrid.nrows))
    inside = x.between(xmin, xmax) & y.between(ymin, ymax)
    src = source.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), "value")
    out = keyed.join(src, ["_sr", "_sc"], "left")
    return out.withColumn("value", F.when(inside, F.coalesce("value", F.lit(nodata))).otherwise(F.lit(nodata))).drop("_sr", "_sc")


def reclassify(cells: DataFrame, table: DataFrame, default, on: str = "value", out: str = "code") -> DataFrame:
    """Code lookup with a default; the table is broadcast after a size check."""
    return cells.join(small(table), on, "left").withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def fill_nodata(cells: DataFrame, nodata, how: str = "zero", value: str = "value", keys=RUN) -> DataFrame:
    """Nodata becomes 0, or the median of the grid's valid cells (0 when there are none)."""
    bad = F.col(value) == nodata
    if how == "zero":
        return cells.withColumn(value, F.when(bad, 0.0).otherwise(dbl(value)))
    med = aggregate_with_percentiles(cells.select(*keys, value), list(keys), [F.count(F.lit(1)).alias("_cells")], F.when(~bad, F.col(value)), {"_med": 0.5}).drop("_cells")
    joined = cells.join(small(med), list(keys), "left")
    return joined.withColumn(value, F.when(bad, F.coalesce("_med", F.lit(0.0))).otherwise(dbl(value))).drop("_med")


def crop_window(cx, cy, window_km, grid: Grid) -> tuple[Column, Column, Column, Column]:
    """Row and column range (r0, r1, c0, c1; ends excluded) of a centred square window."""
    half = F.bround(dbl(window_km) * 1000.0 / grid.cell / 2, 0).cast("long")
    c = ((dbl(cx) - grid.x0) / grid.cell).cast("long")
    r = ((F.lit(grid.y_top) - dbl(cy)) / grid.cell).cast("long")
    return (
        F.greatest(r - half, F.lit(0)), F.least(r + half, F.lit(grid.nrows)),
        F.greatest(c - half, F.lit(0)), F.least(c + half, F.lit(grid.ncols)),
    )


def crop_bbox(points: DataFrame, margin: float, grid: Grid, keys=()) -> DataFrame:
    """Row and column range that covers the points and a margin, far ends rounded up."""
    b = points.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    c0 = ((F.col("x0") - margin - grid.x0) / grid.cell).cast("long")
    c1 = F.ceil((F.col("x1") + margin - grid.x0) / grid.cell)
    r0 = ((F.lit(grid.y_top) - F.col("y1") - margin) / grid.cell).cast("long")
    r1 = F.ceil((F.lit(grid.y_top) - F.col("y0") + margin) / grid.cell)
    return b.select(
        *keys, F.greatest(r0, F.lit(0)).alias("r0"), F.least(r1, F.lit(grid.nrows)).alias("r1"),
        F.greatest(c0, F.lit(0)).alias("c0"), F.least(c1, F.lit(grid.ncols)).alias("c1"),
    )


def aspect(cells: DataFrame, cell: float, value: str = "value", keys=RUN) -> DataFrame:
    """Azimuth of the uphill direction: central differences, one-sided at borders, flat is 0."""
    by_row = W.partitionBy(*keys, "r").orderBy("c")
    by_col = W.partitionBy(*keys, "c").orderBy("r")

    def slope(w) -> Column:
        prev, nxt, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return (
            F.when(prev.isNotNull() & nxt.isNotNull(), (nxt - prev) / (2.0 * cell))
            .when(nxt.isNotNull(), (nxt - here) / cell)
            .when(prev.isNotNull(), (here - prev) / cell)
            .otherwise(0.0)
        )

    g = cells.withColumn("_gx", slope(by_row)).withColumn("_gy", slope(by_col))
    flat = (F.col("_gx") == 0) & (F.col("_gy") == 0)
    return g.withColumn("aspect", F.when(flat, 0.0).otherwise(geo.bearing(F.col("_gx"), -F.col("_gy")))).drop("_gx", "_gy")


def disc_cells(points: DataFrame, radius: float, grid: Grid, keep: list[str]) -> DataFrame:
    """Cells whose centre lies within ``radius`` of each point (one row per point and cell)."""
    n = int(math.ceil(radius / grid.cell)) + 1
    steps = [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1)]
    at = points.select(*keep, "x", "y", grid.row_of("y").alias("r"), grid.col_of("x").alias("c"))
    out = shift(at, steps, [*keep, "x", "y"])
    d2 = F.pow(grid.x() - F.col("x"), F.lit(2.0)) + F.pow(grid.y() - F.col("y"), F.lit(2.0))
    return out.filter(d2 <= radius * radius).filter(
        F.col("r").between(0, grid.nrows - 1) & F.col("c").between(0, grid.ncols - 1)
    ).drop("dr", "dc")


def seed_cells(points: DataFrame, grid: Grid, burnable: DataFrame, radius: float = 187.5, keys=RUN) -> DataFrame:
    """Burnable cells inside the discs around the observations, with their cell numbers."""
    cells = disc_cells(points, radius, grid, list(keys)).select(*keys, "r", "c").distinct()
    out = cells.join(burnable.select("r", "c"), ["r", "c"], "left_semi")
    return out.withColumn("ncell", geo.cell_id("r", "c", grid.ncols))


def nearest_burnable(points: DataFrame, burnable: DataFrame, grid: Grid, keys=("point_id",)) -> DataFrame:
    """Burnable cell nearest in index distance, first in row-major order on ties."""
    from hazardframe.operators.spatial import nearest

    at = points.select(
        *keys, F.bround((F.col("x") - grid.x0) / grid.cell, 0).alias("x"),
        F.bround((F.lit(grid.y_top) - F.col("y")) / grid.cell, 0).alias("y"),
    )
    tgt = burnable.select(geo.cell_id("r", "c", grid.ncols).alias("tid"), dbl("c").alias("x"), dbl("r").alias("y"))
    return nearest(at, tgt, list(keys)).select(*keys, F.col("tid").alias("ncell"), "dist")


def _edges_marked(arrival: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell with ``_edge``: a neighbour never burned or burned later than the cell."""
    cross = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    spread = shift(arrival, cross, [*keys, "arrival"])
    own = (F.col("dr") == 0) & (F.col("dc") == 0)
    agg = spread.groupBy(*keys, "r", "c").agg(
        F.max(F.when(own, F.col("arrival"))).alias("arrival"),
        F.count(F.when(~own, 1)).alias("_n"), F.max(F.when(~own, F.col("arrival"))).alias("_late"),
    )
    edge = (F.col("_n") < 4) | (F.col("_late") > F.col("arrival"))
    return agg.filter(F.col("arrival").isNotNull()).withColumn("_edge", edge).drop("_n", "_late")


def ever_boundary(arrival: DataFrame, keys=RUN) -> DataFrame:
    """Cells that lie on the fire's edge at some hour.

    A cell with all four neighbours burned no later than itself is never the nearest fire
    cell of any unburned place, so distance work needs only the others.
    """
    return _edges_marked(arrival, list(keys)).filter("_edge").drop("_edge")


#: Side of the square tiles that neighbourhood work is dealt out by, and cells of one task.
TILE, TILE_ROWS = 64, 200_000


def in_tiles(cells: DataFrame, reach: int, keys: list[str]) -> DataFrame:
    """Cells copied to every tile (``_tr``, ``_tc``) within ``reach``, the tiles of a grid dealt over tasks.

    What follows by (keys, tile) needs no further shuffle; only the cells of a tile itself are whole in it.
    """
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE)))
    tiled = cells.select("*", tiles("r").alias("_tr")).select("*", tiles("c").alias("_tc"))
    tiled, seen = materialise_observed(tiled, "tiles", n=F.count(F.lit(1)))
    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, -(-seen["n"] // TILE_ROWS))
    return tiled.repartition(tasks, *keys, "_tr", "_tc")


def blocked_zone(arrival: DataFrame, width: DataFrame, cell: float, keys=RUN, max_width: float = 600.0) -> DataFrame:
    """Danger zone: cells whose distance to the fire is at most their own width.

    ``width(r, c, width_m)`` covers the grid. The result is again an arrival table (hour a
    cell first becomes blocked), so every hour is answered by one pass, tile by tile: only the cells and
    their copies at the tiles' borders are shuffled.
    """
    steps, tile = offsets(max_width / cell), [*keys, "_tr", "_tc"]
    # Cells at the rim of a tile's copies lack neighbours and count as edge, which only adds work.
    cells = _edges_marked(in_tiles(arrival.select(*keys, "r", "c", "arrival"), int(max_width // cell) + 1, list(keys)), tile)
    step = lambda i, j: F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc"))
    near = cells.withColumn("_o", F.explode(F.when(F.col("_edge"), F.array(*[step(i, j) for i, j in steps])).otherwise(F.array(step(0, 0)))))
    dist = F.sqrt((F.col("_o.dr") * F.col("_o.dr") + F.col("_o.dc") * F.col("_o.dc")).cast("double")) * cell
    near = near.select(*tile, (F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c"), dist.alias("dist"), "arrival")
    near = near.filter((F.floor(F.col("r") / TILE) == F.col("_tr")) & (F.floor(F.col("c") / TILE) == F.col("_tc")))
    w = materialise(width.select("r", "c", "width_m"), "widths")
    if estimated_bytes(w) > BROADCAST_LIMIT_BYTES:
        near = near.groupBy(*tile, "r", "c", "dist").agg(F.min("arrival").alias("arrival"))
    hit = near.join(small(w), ["r", "c"]).filter((F.col("dist") <= F.col("width_m")) | (F.col("dist") == 0))
    return hit.groupBy(*tile, "r", "c").agg(F.min("arrival").alias("arrival")).drop("_tr", "_tc")


def dilate(cells: DataFrame, radius: float, cell: float, keys=RUN) -> DataFrame:
    """Cells whose centre lies within ``radius`` of a cell centre of the set."""
    return shift(cells, offsets(radius / cell), list(keys)).select(*keys, "r", "c").distinct()


def diff_grids(ref: DataFrame, cand: DataFrame, tol: int = 0, keys=RUN, value: str = "arrival") -> DataFrame:
    """Cell-by-cell comparison of two runs: mismatches per grid and a verdict."""
    k = [*keys, "r", "c"]
    a = ref.select(*k, F.col(value).alias("_a"))
    b = cand.select(*k, F.col(value).alias("_b"))
    both = a.join(b, k, "full_outer")
    out = both.groupBy(*keys).agg(
        F.count("*").alias("n_cells"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_diff")
    )
    verdict = F.when(F.col("n_diff") == 0, "PASS").when(F.col("n_diff") <= tol, "WARN").otherwise("FAIL")
    return out.withColumn("verdict", verdict)


def containment(pred: DataFrame, scar: DataFrame, keys=RUN) -> DataFrame:
    """Share of the predicted cells that lie in the reference scar, in percent."""
    s = scar.select("r", "c").distinct().withColumn("_in", F.lit(1))
    j = pred.join(s, ["r", "c"], "left")
    return j.groupBy(*keys).agg(F.round(100.0 * F.count("_in") / F.count("*"), 4).alias("containment_pct"))


def require_seed(cells: DataFrame) -> DataFrame:
    """Error when no burnable cell lies under the observations."""
    if not cells.take(1):
        raise ValueError("no burnable cell under the given observations")
    return cells
