"""Queries of the cell-table, spatial-join, component and ring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.catalog.registry import query
from hazardframe.functions import geo
from hazardframe.operators.common import materialise
from hazardframe.operators import cells as cl, components as cc, rings as rg, spatial as sp
from hazardframe.operators.cells import Grid

CELL = 200.0
RUN_GRID = Grid(0.0, 24000.0, CELL, 120, 120)
RUN = ["run_id"]

# Parts of twins used by several queries.
SIDES = """side AS (SELECT run_id, r, c, unnest([{'k':0,'nr':r-1,'nc':c,'ar':r,'ac':c,'br':r,'bc':c+1},
  {'k':1,'nr':r,'nc':c+1,'ar':r,'ac':c+1,'br':r+1,'bc':c+1},{'k':2,'nr':r+1,'nc':c,'ar':r+1,'ac':c+1,'br':r+1,'bc':c},
  {'k':3,'nr':r,'nc':c-1,'ar':r+1,'ac':c,'br':r,'bc':c}]) AS s FROM CELLS),
bnd AS (SELECT run_id, ((run_id*1048576*1048576)+(r+1)*1048576+(c+1))*4+s.k AS id, r, c, s.ar AS ar, s.ac AS ac, s.br AS br, s.bc AS bc FROM side
  WHERE NOT EXISTS (SELECT 1 FROM CELLS f WHERE f.run_id=side.run_id AND f.r=side.s.nr AND f.c=side.s.nc)),
nx AS (SELECT a.run_id, a.id, arg_min(b.id, CASE WHEN a.r=b.r AND a.c=b.c THEN 0 ELSE 1 END) AS nid FROM bnd a JOIN bnd b
  ON a.run_id=b.run_id AND a.br=b.ar AND a.bc=b.ac GROUP BY 1,2),
walk AS (SELECT run_id, id AS head, id, nid, CAST(0 AS BIGINT) AS seq FROM nx
  UNION ALL SELECT w.run_id, w.head, n.id, n.nid, w.seq+1 FROM walk w JOIN nx n ON n.id=w.nid WHERE w.nid>w.head),
ring AS (SELECT w.run_id, w.head AS ring_id, w.seq, b.ar, b.ac, b.br, b.bc FROM walk w JOIN bnd b ON b.id=w.id
  WHERE w.head IN (SELECT head FROM walk WHERE nid=head))"""


def cell_number(cell: str):
    """The number that the twins give a cell of one run."""
    return F.expr(f"{cell}.run_id * 1099511627776 + ({cell}.r + 1) * 1048576 + {cell}.c + 1")


def numbered(rings):
    """Ring ids as the twins number them."""
    return rings.withColumn("ring_id", cell_number("ring_id.id") * 4 + F.col("ring_id.k"))


def _rings(cells: str) -> str:
    return SIDES.replace("CELLS", cells)


@query("a1_perimeter_stats", """SELECT run_id, period, CAST(sum(n) OVER (PARTITION BY run_id ORDER BY period) AS BIGINT) AS n_cells,
  sum(n) OVER (PARTITION BY run_id ORDER BY period)*40000.0::DOUBLE AS area_m2 FROM (
  SELECT h.run_id, h.period, count(a.r) AS n FROM (SELECT run_id, unnest(generate_series(min(arrival),max(arrival))) AS period FROM fx_arrival GROUP BY run_id) h
  LEFT JOIN fx_arrival a ON a.run_id=h.run_id AND a.arrival=h.period GROUP BY 1,2) t""")
def a1(v):
    return cl.perimeter_stats(v("fx_arrival"), CELL).drop("n_new")


@query("a2_ros_grid", """SELECT run_id, CAST(floor((t-1)/120) AS BIGINT) AS r, (t-1)%120 AS c, max(ros) AS ros FROM (
  SELECT l_suppkey AS run_id, (l_partkey*31)%15000 AS t, l_quantity AS ros FROM lineitem) z WHERE t BETWEEN 1 AND 14400 GROUP BY 1,2,3""")
def a2(v):
    m = v("lineitem").select(F.col("l_suppkey").alias("run_id"), ((F.col("l_partkey") * 31) % 15000).alias("target"), F.col("l_quantity").alias("ros"))
    return cl.ros_grid(m, 120, 120)


@query("w8_growth_rings", """SELECT run_id, period, n AS n_new, round(k,4) AS km2, round(k-coalesce(lag(k) OVER (PARTITION BY run_id ORDER BY period),k),4) AS d_km2 FROM (
  SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY period)*40000.0::DOUBLE/1e6 AS k FROM (
  SELECT h.run_id, h.period, count(a.r) AS n FROM (SELECT run_id, unnest(generate_series(min(arrival),max(arrival))) AS period FROM fx_arrival GROUP BY run_id) h
  LEFT JOIN fx_arrival a ON a.run_id=h.run_id AND a.arrival=h.period GROUP BY 1,2) t) z""")
def w8(v):
    return cl.growth_rings(v("fx_arrival"), CELL)


@query("u3_cell_algebra", """WITH a AS (SELECT run_id,r,c FROM fx_arrival WHERE arrival<=4), b AS (SELECT run_id,r,c FROM fx_arrival WHERE arrival BETWEEN 2 AND 6)
SELECT 'union' AS op, run_id, r, c FROM (SELECT * FROM a UNION SELECT * FROM b) x UNION ALL SELECT 'minus', run_id, r, c FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y
UNION ALL SELECT 'intersect', run_id, r, c FROM (SELECT * FROM a INTERSECT SELECT * FROM b) z""")
def u3(v):
    f = v("fx_arrival")
    a, b = f.filter("arrival <= 4").select("run_id", "r", "c"), f.filter("arrival BETWEEN 2 AND 6").select("run_id", "r", "c")
    parts = {"union": cl.cells_union(a, b), "minus": cl.cells_minus(a, b), "intersect": cl.cells_intersect(a, b)}
    outs = [d.select(F.lit(k).alias("op"), "run_id", "r", "c") for k, d in parts.items()]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@query("r35_pick_footprint", """SELECT run_id, max(arrival) AS period, count(*) AS n_cells, round(avg((c+0.5::DOUBLE)*200),4) AS cx, round(avg(24000-(r+0.5::DOUBLE)*200),4) AS cy
  FROM fx_arrival WHERE arrival<=5 GROUP BY run_id""")
def r35(v):
    out = cl.pick_footprint(v("fx_arrival"), 5, RUN_GRID)
    return out.select("run_id", "period", "n_cells", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


@query("a12_sector_areas", """SELECT run_id, (['N','NE','E','SE','S','SW','W','NW'])[CAST(floor(((degrees(atan2((c+0.5)*200-12093,24000-(r+0.5)*200-11921))+360)%360+22.5)%360/45) AS INT)+1] AS sector,
  round(count(*)*0.04::DOUBLE,4) AS km2 FROM fx_arrival GROUP BY 1,2""")
def a12(v):
    return cl.sector_areas(v("fx_arrival"), 12093.0, 11921.0, RUN_GRID)


_VALUE = "CAST(100+3*r+((c*c)%50) AS DOUBLE)"


@query("w4_aspect", f"""WITH e AS (SELECT run_id, r, c, {_VALUE} AS v FROM fx_arrival),
g AS (SELECT *, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN (n-p)/400 WHEN n IS NOT NULL THEN (n-v)/200 WHEN p IS NOT NULL THEN (v-p)/200 ELSE 0 END AS gx,
  CASE WHEN u IS NOT NULL AND d IS NOT NULL THEN (d-u)/400 WHEN d IS NOT NULL THEN (d-v)/200 WHEN u IS NOT NULL THEN (v-u)/200 ELSE 0 END AS gy FROM (
  SELECT *, lag(v) OVER a AS p, lead(v) OVER a AS n, lag(v) OVER b AS u, lead(v) OVER b AS d FROM e WINDOW a AS (PARTITION BY run_id,r ORDER BY c), b AS (PARTITION BY run_id,c ORDER BY r)) t)
SELECT run_id, r, c, CASE WHEN gx=0 AND gy=0 THEN 0.0::DOUBLE ELSE round((degrees(atan2(gx,-gy))+360)%360,4) END AS aspect FROM g""")
def w4(v):
    e = v("fx_arrival").withColumn("value", F.expr("CAST(100+3*r+((c*c)%50) AS DOUBLE)"))
    return cl.aspect(e, CELL).select("run_id", "r", "c", F.round("aspect", 4).alias("aspect"))


@query("j1_resample_nearest", """SELECT t.run_id, t.r, t.c, coalesce(s.v, -1) AS value FROM (SELECT run_id, r, c, (c+0.5::DOUBLE)*200 AS x, 24000-(r+0.5::DOUBLE)*200 AS y FROM fx_arrival) t
  LEFT JOIN (SELECT p_partkey%160 AS sc, CAST(floor(p_partkey/160) AS BIGINT) AS sr, p_size AS v FROM part) s
  ON s.sc=least(greatest(CAST(round_even((t.x-5000)/70.0-0.5,0) AS BIGINT),0),159) AND s.sr=least(greatest(CAST(round_even((18000-t.y)/70.0-0.5,0) AS BIGINT),0),99)
  AND t.x BETWEEN 5000 AND 16200 AND t.y BETWEEN 11000 AND 18000""")
def j1(v):
    src = v("part").select((F.col("p_partkey") % 160).alias("c"), F.floor(F.col("p_partkey") / 160).alias("r"), F.col("p_size").alias("value"))
    out = cl.resample_nearest(v("fx_arrival"), RUN_GRID, src, Grid(5000.0, 18000.0, 70.0, 100, 160), -1)
    return out.select("run_id", "r", "c", "value")


@query("j2_reclassify", """SELECT run_id, r, c, CASE arrival WHEN 0 THEN 101 WHEN 1 THEN 7 WHEN 3 THEN 13 WHEN 5 THEN 21 ELSE 0 END AS code FROM fx_arrival""")
def j2(v):
    table = v.spark.createDataFrame([(0, 101), (1, 7), (3, 13), (5, 21)], "arrival bigint, code int")
    return cl.reclassify(v("fx_arrival"), table, 0, on="arrival").select("run_id", "r", "c", "code")


@query("p6_fill_nodata", """SELECT f.run_id, f.r, f.c, CASE WHEN arrival=7 THEN 0.0::DOUBLE ELSE arrival END AS zeroed, CASE WHEN arrival=7 THEN coalesce(m.med,0) ELSE arrival END AS filled FROM fx_arrival f
  LEFT JOIN (SELECT run_id, quantile_cont(arrival,0.5) AS med FROM fx_arrival WHERE arrival<>7 GROUP BY 1) m ON m.run_id=f.run_id""")
def p6(v):
    f = v("fx_arrival").withColumn("zeroed", F.col("arrival")).withColumn("filled", F.col("arrival"))
    out = cl.fill_nodata(cl.fill_nodata(f, 7, "zero", "zeroed"), 7, "median", "filled")
    return out.select("run_id", "r", "c", "zeroed", "filled")


@query("p3_crop_window", """SELECT settlement_id, greatest(r-h,0) AS r0, least(r+h,120) AS r1, greatest(c-h,0) AS c0, least(c+h,120) AS c1 FROM (
  SELECT settlement_id, CAST(trunc(x/200) AS BIGINT) AS c, CAST(trunc((24000-y)/200) AS BIGINT) AS r, CAST(round_even((6+settlement_id%30)*1000.0/200/2,0) AS BIGINT) AS h FROM fx_settlement) t""")
def p3(v):
    r0, r1, c0, c1 = cl.crop_window("x", "y", 6 + F.col("settlement_id") % 30, RUN_GRID)
    return v("fx_settlement").select("settlement_id", r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))


@query("p2_pins_outside_window", """SELECT settlement_id FROM fx_settlement WHERE NOT (x BETWEEN 4000 AND 16000 AND y BETWEEN 5000 AND 20000)""")
def p2(v):
    from hazardframe.operators.requests import pins_outside_window
    return pins_outside_window(v("fx_settlement"), (4000.0, 5000.0, 16000.0, 20000.0)).select("settlement_id")


@query("p20_window_box", """SELECT run_id, min(c)*200.0::DOUBLE AS xmin, 24000.0::DOUBLE-(max(r)+1)*200 AS ymin, (max(c)+1)*200.0::DOUBLE AS xmax, 24000.0::DOUBLE-min(r)*200 AS ymax FROM fx_arrival GROUP BY 1""")
def p20(v):
    from hazardframe.operators.requests import window_box
    m = v("fx_arrival").groupBy("run_id").agg((F.min("c") * 200.0).alias("x0"), (24000.0 - F.min("r") * 200.0).alias("y_top"), F.lit(200.0).alias("cell"),
                                              (F.max("r") - F.min("r") + 1).alias("nrows"), (F.max("c") - F.min("c") + 1).alias("ncols"))
    return window_box(m).select("run_id", "xmin", "ymin", "xmax", "ymax")


_BURNABLE = "(r*7+c*3)%5<>0"


@query("r1_seed_cells", f"""SELECT DISTINCT run_id, r, c, r*120+c+1 AS ncell FROM (SELECT event_id, user_id AS run_id, (user_id*7919)%20011 AS x, (event_id*6271)%20013 AS y FROM events WHERE event_type='error') d,
  (SELECT r, c FROM (SELECT DISTINCT r, c FROM fx_arrival) q WHERE {_BURNABLE}) b WHERE c BETWEEN floor(x/200)-2 AND floor(x/200)+2 AND r BETWEEN floor((24000-y)/200)-2 AND floor((24000-y)/200)+2
  AND pow((c+0.5)*200-x,2)+pow(24000-(r+0.5)*200-y,2)<=187.5*187.5""")
def r1(v):
    pts = v("events").filter("event_type='error'").select(F.col("user_id").alias("run_id"), ((F.col("user_id") * 7919) % 20011).cast("double").alias("x"), ((F.col("event_id") * 6271) % 20013).cast("double").alias("y"))
    burnable = v("fx_arrival").select("r", "c").distinct().filter(_BURNABLE)
    return cl.seed_cells(pts, RUN_GRID, burnable)


@query("j11_nearest_burnable", f"""WITH b AS (SELECT r, c FROM (SELECT DISTINCT r, c FROM fx_arrival) q WHERE {_BURNABLE}),
p AS (SELECT refuge_id, round_even(x/200,0) AS pc, round_even((24000-y)/200,0) AS pr FROM fx_refuge)
SELECT refuge_id, r*120+c+1 AS ncell, round(sqrt(d2),6) AS dist FROM (SELECT refuge_id, r, c, pow(c-pc,2)+pow(r-pr,2) AS d2, row_number() OVER (PARTITION BY refuge_id ORDER BY pow(c-pc,2)+pow(r-pr,2), r, c) AS n FROM p, b) t WHERE n=1""")
def j11(v):
    burnable = v("fx_arrival").select("r", "c").distinct().filter(_BURNABLE)
    return cl.nearest_burnable(v("fx_refuge"), burnable, RUN_GRID, ("refuge_id",)).withColumn("dist", F.round("dist", 6))


WIDTH = "least(greatest(100+((r*7+c*3)%5*0.3::DOUBLE*(1+least((r*5+c*11)%60,45)/45.0::DOUBLE)-0.3::DOUBLE)*300,100),600)"


@query("f10_buffer_width", f"SELECT DISTINCT r, c, round({WIDTH},4) AS width_m FROM fx_arrival")
def f10(v):
    return v("fx_arrival").select("r", "c").distinct().select("r", "c", F.round(geo.buffer_width(F.expr("(r*7+c*3)%5*0.3D"), F.expr("(r*5+c*11)%60")), 4).alias("width_m"))


def _width(grid_cells):
    return grid_cells.select("r", "c", geo.buffer_width(F.expr("(r*7+c*3)%5*0.3D"), F.expr("(r*5+c*11)%60")).alias("width_m"))


@query("r3_blocked_zone", f"""WITH w AS (SELECT r, c, {WIDTH} AS w FROM (SELECT DISTINCT r, c FROM fx_arrival) q), o AS (SELECT a.i, b.j FROM (SELECT unnest([-3,-2,-1,0,1,2,3]) AS i) a, (SELECT unnest([-3,-2,-1,0,1,2,3]) AS j) b)
SELECT f.run_id, w.r, w.c, min(f.arrival) AS arrival FROM fx_arrival f, o JOIN w ON TRUE WHERE w.r=f.r+o.i AND w.c=f.c+o.j AND 200*sqrt(o.i*o.i+o.j*o.j)<=w.w GROUP BY 1,2,3""")
def r3(v):
    f = materialise(v("fx_arrival"), "arrival")
    return cl.blocked_zone(f, _width(f.select("r", "c").distinct()), CELL)


@query("j22_diff_grids", """SELECT a.run_id, count(*) AS n_cells, count(*) FILTER (a.arrival<>b.arrival) AS n_diff, CASE WHEN count(*) FILTER (a.arrival<>b.arrival)=0 THEN 'PASS'
  WHEN count(*) FILTER (a.arrival<>b.arrival)<=3 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM fx_arrival a JOIN fx_arrival_b b ON a.run_id=b.run_id AND a.r=b.r AND a.c=b.c GROUP BY 1""")
def j22(v):
    return cl.diff_grids(v("fx_arrival"), v("fx_arrival_b"), 3)


@query("a10_containment", """SELECT run_id, round(100.0::DOUBLE*count(s.r)/count(*),4) AS containment_pct FROM fx_arrival f LEFT JOIN (SELECT DISTINCT r, c FROM fx_arrival_b WHERE arrival<=3) s ON f.r=s.r AND f.c=s.c GROUP BY 1""")
def a10(v):
    return cl.containment(v("fx_arrival"), v("fx_arrival_b").filter("arrival <= 3"))


@query("f13_cell_index", """SELECT DISTINCT r, c, r*120+c+1 AS ncell, (c+0.5::DOUBLE)*200 AS x, 24000-(r+0.5::DOUBLE)*200 AS y, CAST(floor((r*120+c)/120) AS BIGINT) AS r2, (r*120+c)%120 AS c2 FROM fx_arrival""")
def f13(v):
    k = geo.cell_id("r", "c", 120)
    return v("fx_arrival").select("r", "c").distinct().select("r", "c", k.alias("ncell"), RUN_GRID.x().alias("x"), RUN_GRID.y().alias("y"), geo.cell_row(k, 120).alias("r2"), geo.cell_col(k, 120).alias("c2"))


@query("f12_supp_class", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN fi<=0 THEN 0 WHEN fi>=3500 THEN 4 WHEN fi>=1750 THEN 3 WHEN fi>=350 THEN 2 ELSE 1 END AS cls FROM (SELECT *, l_partkey%41*100 AS fi FROM lineitem) t""")
def f12(v):
    return v("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", geo.supp_class(F.col("l_partkey") % 41 * 100).alias("cls"))


@query("j3_within_distance", """SELECT settlement_id FROM fx_settlement s WHERE EXISTS (SELECT 1 FROM fx_refuge r WHERE pow(s.x-r.x,2)+pow(s.y-r.y,2)<=500*500)""")
def j3(v):
    return sp.within_distance(v("fx_settlement"), v("fx_refuge"), 500.0).select("settlement_id")


@query("j4_safe_settlements", """SELECT settlement_id FROM fx_settlement s WHERE NOT EXISTS (SELECT 1 FROM fx_refuge r WHERE pow(s.x-r.x,2)+pow(s.y-r.y,2)<=300*300)""")
def j4(v):
    s = v("fx_settlement")
    return s.join(sp.within_distance(s, v("fx_refuge"), 300.0).select("settlement_id"), "settlement_id", "left_anti").select("settlement_id")


@query("j21_pairs_within", """SELECT a.settlement_id AS a, b.settlement_id AS b, round(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)),6) AS dist FROM fx_settlement a JOIN fx_settlement b ON a.settlement_id<b.settlement_id
  WHERE sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) BETWEEN 300 AND 900""")
def j21(v):
    return sp.pairs_within(v("fx_settlement"), 300.0, 900.0, "settlement_id").withColumn("dist", F.round("dist", 6))


@query("j10_snap_to_nodes", """SELECT settlement_id, node_id, round(d,6) AS dist FROM (SELECT settlement_id, node_id, d, row_number() OVER (PARTITION BY settlement_id ORDER BY d, node_id) AS n FROM (
  SELECT s.settlement_id, k.node_id, sqrt(pow(s.x-k.x,2)+pow(s.y-k.y,2)) AS d FROM fx_settlement s, fx_node k) t) z WHERE n=1""")
def j10(v):
    out = sp.nearest(v("fx_settlement"), v("fx_node").select(F.col("node_id").alias("tid"), "x", "y"), ["settlement_id"])
    return out.select("settlement_id", F.col("tid").alias("node_id"), F.round("dist", 6).alias("dist"))


@query("w16_dedupe_snaps", """SELECT node_id, settlement_id AS refuge_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY d, settlement_id) AS m FROM (
  SELECT settlement_id, node_id, d, row_number() OVER (PARTITION BY settlement_id ORDER BY d, node_id) AS n FROM (
  SELECT s.settlement_id, k.node_id, sqrt(pow(s.x-k.x,2)+pow(s.y-k.y,2)) AS d FROM fx_settlement s, fx_node k) t) z WHERE n=1) y WHERE m=1""")
def w16(v):
    out = sp.nearest(v("fx_settlement"), v("fx_node").select(F.col("node_id").alias("tid"), "x", "y"), ["settlement_id"])
    return sp.dedupe_snaps(out.select(F.col("tid").alias("node_id"), F.col("settlement_id").alias("refuge_id"), "dist"), []).select("node_id", "refuge_id")


@query("p19_far_pin", """SELECT round(max(d),6) AS max_km, max(d)>40 AS too_far FROM (SELECT sqrt(pow((lat-38.9)*111320.0,2)+pow((lon-23.3)*111320.0*cos(radians((lat+38.9)/2)),2))/1000 AS d FROM fx_wgrid) t""")
def p19(v):
    return sp.far_pin(v("fx_wgrid"), 38.9, 23.3).withColumn("max_km", F.round("max_km", 6))


@query("j6_points_in_rings", """SELECT settlement_id, run_id AS ring_id FROM fx_settlement, (SELECT run_id, min(c)*200+30 AS x1, max(c)*200+70 AS x2, 24000-max(r)*200+10 AS y1, 24000-min(r)*200+90 AS y2 FROM fx_arrival GROUP BY 1) b
  WHERE x>x1 AND x<x2 AND y>y1 AND y<y2""")
def j6(v):
    b = v("fx_arrival").groupBy("run_id").agg((F.min("c") * 200 + 30).alias("a"), (F.max("c") * 200 + 70).alias("b"), (24000 - F.max("r") * 200 + 10).alias("d"), (24000 - F.min("r") * 200 + 90).alias("e"))
    sides = [("a", "d", "b", "d"), ("b", "d", "b", "e"), ("b", "e", "a", "e"), ("a", "e", "a", "d")]
    segs = b.select(F.col("run_id").alias("ring_id"), F.explode(F.array(*[F.struct(*[F.col(n).cast("double").alias(k) for n, k in zip(s, ("x1", "y1", "x2", "y2"))]) for s in sides])).alias("s")).select("ring_id", "s.*")
    return sp.points_in_rings(v("fx_settlement"), segs, "settlement_id", 1000.0)


@query("g1_front_components", """WITH RECURSIVE e AS (SELECT a.settlement_id AS u, b.settlement_id AS v FROM fx_settlement a JOIN fx_settlement b ON pow(a.x-b.x,2)+pow(a.y-b.y,2)<=700*700),
cc(id, front) USING KEY (id) AS (SELECT settlement_id, settlement_id FROM fx_settlement UNION SELECT e.v, min(cc.front) FROM cc JOIN e ON e.u=cc.id JOIN recurring.cc k ON k.id=e.v WHERE cc.front<k.front GROUP BY e.v)
SELECT id AS settlement_id, front FROM cc""")
def g1(v):
    return cc.front_components(v("fx_settlement"), 700.0, "settlement_id").select("settlement_id", "front")


def _cc_sql(cells: str, conn: int) -> str:
    near = "abs(a.r-b.r)<=1 AND abs(a.c-b.c)<=1" if conn == 8 else "abs(a.r-b.r)+abs(a.c-b.c)=1"
    rr = "SELECT * FROM cellk"
    return f"""cellk AS (SELECT run_id, r, c, (run_id*1048576*1048576)+(r+1)*1048576+(c+1) AS id FROM {cells}),
nb AS (SELECT a.id AS u, b.id AS v FROM (SELECT *, unnest([-1,0,1]) AS dr FROM cellk) a JOIN cellk b ON a.run_id=b.run_id AND b.r=a.r+a.dr AND {near}),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM cellk UNION SELECT nb.v, min(cc.comp) FROM cc JOIN nb ON nb.u=cc.id JOIN recurring.cc k ON k.id=nb.v WHERE cc.comp<k.comp GROUP BY nb.v)"""


@query("g2_cell_components", f"WITH RECURSIVE {_cc_sql('fx_arrival', 8)} SELECT run_id, r, c, comp FROM cellk JOIN cc ON cc.id=cellk.id")
def g2(v):
    return cc.cell_components(v("fx_arrival"), 8).select("run_id", "r", "c", cell_number("comp").alias("comp"))


@query("p11_drop_specks", f"""WITH RECURSIVE {_cc_sql('fx_arrival', 8)}, s AS (SELECT run_id, comp, count(*)*40000 AS area FROM cellk JOIN cc ON cc.id=cellk.id GROUP BY 1,2),
t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY area DESC, comp) AS n, max(area) OVER (PARTITION BY run_id) AS top FROM s)
SELECT k.run_id, k.r, k.c FROM cellk k JOIN cc ON cc.id=k.id JOIN t ON t.comp=cc.comp WHERE t.area>=200000 OR (t.top<200000 AND t.n=1)""")
def p11(v):
    comps = cc.cell_components(v("fx_arrival"), 8)
    return cc.drop_specks(comps, CELL, 200000.0).select("run_id", "r", "c")


FILL = _cc_sql("fx_arrival", 4) + """, pt AS (SELECT run_id, comp, r, c FROM cellk JOIN cc ON cc.id=cellk.id),
bx AS (SELECT run_id, comp, min(r)-1 AS r0, max(r)+1 AS r1, min(c)-1 AS c0, max(c)+1 AS c1 FROM pt GROUP BY 1,2 HAVING count(*)>=7),
bg AS (SELECT q.* FROM (SELECT *, unnest(generate_series(c0,c1)) AS c FROM (SELECT *, unnest(generate_series(r0,r1)) AS r FROM bx) p) q
  WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.comp=q.comp AND pt.r=q.r AND pt.c=q.c)),
fl AS (SELECT comp, r, c FROM bg WHERE r=r0 OR r=r1 OR c=c0 OR c=c1
  UNION SELECT bg.comp, bg.r, bg.c FROM (SELECT comp, r+o.i AS r, c+o.j AS c FROM fl, (VALUES (1,0),(-1,0),(0,1),(0,-1)) o(i,j)) n JOIN bg ON bg.comp=n.comp AND bg.r=n.r AND bg.c=n.c),
filled AS (SELECT run_id, r, c FROM fx_arrival UNION SELECT run_id, r, c FROM bg WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.comp=bg.comp AND fl.r=bg.r AND fl.c=bg.c))"""


@query("u4_fill_holes", f"WITH RECURSIVE {FILL} SELECT run_id, r, c FROM filled")
def u4(v):
    return cc.fill_holes(v("fx_arrival"))


@query("g7_boundary_rings", f"""WITH RECURSIVE fire AS (SELECT run_id, r, c FROM fx_arrival), {_rings('fire')},
ext AS (SELECT ring_id, count(*) AS n_ring FROM ring GROUP BY 1 HAVING sum(ac*br-bc*ar)>0)
SELECT ring.run_id, ring.ring_id, ring.seq, ext.n_ring, ar, ac, br, bc FROM ring JOIN ext ON ext.ring_id=ring.ring_id""")
def g7(v):
    return numbered(rg.boundary_rings(v("fx_arrival")).drop("area2"))


@query("w13_sample_rings", f"""WITH RECURSIVE fire AS (SELECT run_id, r, c FROM fx_arrival), {_rings('fire')},
ext AS (SELECT ring_id, count(*) AS n_ring FROM ring GROUP BY 1 HAVING sum(ac*br-bc*ar)>0),
sm AS (SELECT ring.*, unnest(generate_series(CAST(ceil(seq*200/30.0) AS BIGINT), CAST(ceil((seq+1)*200/30.0) AS BIGINT)-1)) AS idx FROM ring JOIN ext ON ext.ring_id=ring.ring_id)
SELECT run_id, ring_id, idx, idx*30.0::DOUBLE AS chainage_m, round(ac*200+(idx*30-seq*200)/200.0*(bc-ac)*200,4) AS x, round(24000-ar*200-(idx*30-seq*200)/200.0*(br-ar)*200,4) AS y FROM sm""")
def w13(v):
    segs = rg.ring_segments(rg.boundary_rings(v("fx_arrival")), RUN_GRID)
    out = numbered(rg.sample_rings(segs, side=CELL))
    return out.withColumn("x", F.round("x", 4)).withColumn("y", F.round("y", 4))
