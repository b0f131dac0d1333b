"""Queries of the detection and perimeter validation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.catalog.q_cells import CELL, RUN_GRID, _rings, numbered
from hazardframe.catalog.q_network import GRID, _fire
from hazardframe.catalog.registry import query
from hazardframe.functions import geo
from hazardframe.operators import cells as cl, components as cc, detections as dt, perimeter as pm, rings as rg, spatial as sp
from hazardframe.operators.common import materialise
from hazardframe.plans import validation as pv

START, T0, END = "2021-08-05 12:00:00", "2021-08-05 13:00:00", "2021-08-05 18:00:00"
OX, OY = 9000.0, 9700.0

SPLIT = """seed AS (SELECT r, c FROM fx_burn WHERE arrival=0),
touch AS (SELECT d.det_id, count(*) AS n FROM fx_det d JOIN seed s ON s.c BETWEEN ceil(d.x/200)-1 AND floor(d.x/200) AND s.r BETWEEN ceil((19400-d.y)/200)-1 AND floor((19400-d.y)/200) GROUP BY 1),
inseed AS (SELECT d.det_id FROM fx_det d JOIN touch ON touch.det_id=d.det_id WHERE n=CASE WHEN d.x%200=0 THEN 2 ELSE 1 END*CASE WHEN d.y%200=0 THEN 2 ELSE 1 END),
split AS (SELECT *, CASE WHEN t<=TIMESTAMP '2021-08-05 13:00' THEN 'init' ELSE 'eval' END AS part FROM fx_det WHERE t BETWEEN TIMESTAMP '2021-08-05 12:00' AND TIMESTAMP '2021-08-05 18:00'),
parts AS (SELECT * FROM split WHERE part='init' OR det_id NOT IN (SELECT det_id FROM inseed))"""
PASS = SPLIT + """, tm AS (SELECT DISTINCT t FROM parts WHERE part='eval'),
ps(t, p) AS (SELECT min(t), min(t) FROM tm UNION ALL SELECT n.t, CASE WHEN n.t-ps.p>INTERVAL 20 MINUTE THEN n.t ELSE ps.p END FROM ps, LATERAL (SELECT min(t) AS t FROM tm WHERE tm.t>ps.t) n WHERE n.t IS NOT NULL),
ev AS (SELECT d.*, ps.p AS pass_t, least(greatest(CAST(floor(date_diff('second',TIMESTAMP '2021-08-05 12:00',ps.p)/3600.0) AS BIGINT),0),6) AS period FROM parts d JOIN ps ON ps.t=d.t WHERE part='eval')"""


def _score(src: str, out: str) -> str:
    return f"""{out}0 AS (SELECT e.det_id, e.period, min(sqrt(pow(greatest(abs(e.x-(b.c+0.5)*200)-100,0),2)+pow(greatest(abs(e.y-(19400-(b.r+0.5)*200))-100,0),2))) AS dist,
  count(*) FILTER (b.c BETWEEN ceil(e.x/200)-1 AND floor(e.x/200) AND b.r BETWEEN ceil((19400-e.y)/200)-1 AND floor((19400-e.y)/200))=CASE WHEN e.x%200=0 THEN 2 ELSE 1 END*CASE WHEN e.y%200=0 THEN 2 ELSE 1 END AS inside
  FROM {src} e JOIN fx_burn b ON b.arrival<=e.period GROUP BY e.det_id, e.period, e.x, e.y),
{out} AS (SELECT e.*, CASE WHEN s.inside THEN 0.0::DOUBLE ELSE s.dist END AS dist, s.inside FROM {src} e JOIN {out}0 s ON s.det_id=e.det_id AND s.period=e.period)"""


SC = PASS + ", " + _score("ev", "sc")
_RE = "CAST(round_even({},0) AS BIGINT)"
INCL = "count(*) AS n_detections, count(*) FILTER (inside) AS n_inside, " + ", ".join(
    [_RE.format("100*avg(CASE WHEN inside THEN 1.0 ELSE 0 END)") + " AS inclusion_pct"]
    + [_RE.format(f"100*avg(CASE WHEN dist<={b} THEN 1.0 ELSE 0 END)") + f" AS within_{b}m_pct" for b in (375, 500, 1000)])
STATS = ", ".join([_RE.format("avg(dist)") + " AS mean_m", _RE.format("max(dist)") + " AS max_m"] + [
    _RE.format(f"quantile_cont(dist,{q})") + f" AS {n}" for q, n in ((0.5, "median_m"), (0.75, "p75_m"), (0.9, "p90_m"), (0.95, "p95_m"))])


_KEPT: dict = {}


def _kept(v, name):
    """A small view over a large table, written once per session: operators read it in many steps."""
    key = (v.sf_dir, v.spark.sparkContext.applicationId, name)
    if key not in _KEPT:
        _KEPT[key] = materialise(v(name), name)
    return _KEPT[key]


def _seed(v):
    return _kept(v, "fx_burn").filter("arrival = 0").select("r", "c")


def _arr(v):
    return _kept(v, "fx_burn")


def _eval(v):
    ev_ = dt.split_detections(_kept(v, "fx_det"), START, T0, END, _seed(v), GRID).filter("part = 'eval'")
    return dt.match_period(dt.group_passes(ev_), START, 6)


def _scored(v):
    return dt.dist_to_footprint(materialise(_eval(v), "eval"), _arr(v), GRID)


@query("p7_split_detections", f"WITH {SPLIT} SELECT det_id, part FROM parts")
def p7(v):
    return dt.split_detections(_kept(v, "fx_det"), START, T0, END, _seed(v), GRID).select("det_id", "part")


@query("w9_group_passes", f"WITH RECURSIVE {PASS} SELECT det_id, strftime(pass_t,'%Y-%m-%d %H:%M') AS pass_t FROM ev")
def w9(v):
    return _eval(v).select("det_id", F.date_format("pass_t", "yyyy-MM-dd HH:mm").alias("pass_t"))


@query("j12_match_period", f"WITH RECURSIVE {PASS} SELECT det_id, period FROM ev")
def j12(v):
    return _eval(v).select("det_id", "period")


@query("j8_dist_to_footprint", f"WITH RECURSIVE {SC} SELECT det_id, period, round(dist,4) AS dist, inside FROM sc")
def j8(v):
    return _scored(v).select("det_id", "period", F.round("dist", 4).alias("dist"), "inside")


_DIR = f"""grow AS (SELECT h.period, avg((c+0.5)*200) AS gx, avg(19400-(r+0.5)*200) AS gy FROM (SELECT DISTINCT period FROM ev) h JOIN fx_burn b ON b.arrival<=h.period AND (b.arrival>0 OR h.period=0) GROUP BY 1)"""


@query("a6_pass_metrics", f"""WITH RECURSIVE {SC}, {_DIR}, m AS (SELECT pass_t, period, {INCL}, {STATS}, avg(x) AS vx, avg(y) AS vy FROM sc GROUP BY 1,2)
SELECT strftime(pass_t,'%H:%M') AS pass_t, m.* EXCLUDE (pass_t, vx, vy), {_RE.format('ob')} AS obs_bearing_deg, {_RE.format('sb')} AS sim_bearing_deg, {_RE.format('abs(((sb-ob+180)%360+360)%360-180)')} AS direction_diff_deg
FROM (SELECT m.*, (degrees(atan2(vx-9000,vy-9700))+360)%360 AS ob, (degrees(atan2(gx-9000,gy-9700))+360)%360 AS sb FROM m JOIN grow ON grow.period=m.period) m""".replace("m.* EXCLUDE (pass_t, vx, vy)", "m.* EXCLUDE (pass_t, vx, vy, ob, sb)"))
def a6(v):
    out = dt.pass_metrics(materialise(_scored(v), "scored"), _arr(v), _seed(v), GRID, OX, OY)
    return out.withColumn("pass_t", F.date_format("pass_t", "HH:mm"))


@query("a7_distance_stats", f"WITH RECURSIVE {SC} SELECT period, {STATS} FROM sc GROUP BY 1")
def a7(v):
    return dt.distance_stats(_scored(v), ["period"], [])


@query("a8_pooled_metrics", f"WITH RECURSIVE {SC} SELECT {INCL}, {STATS} FROM sc")
def a8(v):
    return dt.pooled_metrics(materialise(_scored(v), "scored"))


def _disc(radius: float, name: str, src: str) -> str:
    n = int(radius // 200) + 2
    return f"""{name} AS (SELECT DISTINCT r, c FROM (SELECT d.x, d.y, unnest(generate_series(CAST(floor((19400-d.y)/200) AS BIGINT)-{n},CAST(floor((19400-d.y)/200) AS BIGINT)+{n})) AS r, d.c FROM
  (SELECT x, y, unnest(generate_series(CAST(floor(x/200) AS BIGINT)-{n},CAST(floor(x/200) AS BIGINT)+{n})) AS c FROM {src}) d) t
  WHERE r BETWEEN 0 AND 96 AND c BETWEEN 0 AND 88 AND pow((c+0.5)*200-x,2)+pow(19400-(r+0.5)*200-y,2)<={radius * radius})"""


@query("a9_footprint_agreement", f"""WITH ev AS (SELECT *, CAST(6 AS BIGINT) AS period FROM fx_det), {_score('ev', 'sc')}, {_disc(187.5, 'disc', 'fx_det')},
k AS (SELECT (SELECT count(*) FROM fx_burn) AS np, (SELECT count(*) FROM disc) AS nd, (SELECT count(*) FROM fx_burn b JOIN disc ON disc.r=b.r AND disc.c=b.c) AS ni),
g AS (SELECT avg((c+0.5)*200) AS px, avg(19400-(r+0.5)*200) AS py FROM fx_burn),
q AS (SELECT count(*) AS n_detections, round(median(dist/1000),2) AS nn_median_km, {_RE.format('100*avg(CASE WHEN dist<=375 THEN 1.0 ELSE 0 END)')} AS within_pixel_pct, {_RE.format('100*avg(CASE WHEN dist<=1000 THEN 1.0 ELSE 0 END)')} AS within_1km_pct, avg(x) AS vx, avg(y) AS vy FROM sc)
SELECT n_detections, {_RE.format('100.0::DOUBLE*ni/(np+nd-ni)')} AS iou_pct, {_RE.format('100.0::DOUBLE*ni/np')} AS precision_pct, {_RE.format('100.0::DOUBLE*ni/nd')} AS recall_pct, nn_median_km, within_pixel_pct, within_1km_pct,
 {_RE.format('abs(((degrees(atan2(px-9000,py-9700))-degrees(atan2(vx-9000,vy-9700))+180)%360+360)%360-180)')} AS direction_diff_deg FROM k, g, q""")
def a9(v):
    return dt.footprint_agreement(_arr(v).select("r", "c"), _kept(v, "fx_det"), GRID, OX, OY)


@query("a11_overspread", f"""WITH {_disc(1187.5, 'near', 'fx_det')}, g AS (SELECT b.r, b.c, n.r IS NULL AS far FROM fx_burn b LEFT JOIN near n ON n.r=b.r AND n.c=b.c WHERE arrival>0)
SELECT round(count(*)*0.04::DOUBLE,1) AS growth_km2, round(count(*) FILTER (far)*0.04::DOUBLE,1) AS growth_far_km2, {_RE.format('100.0::DOUBLE*count(*) FILTER (far)/count(*)')} AS growth_far_pct FROM g""")
def a11(v):
    return dt.overspread(_arr(v), _seed(v), _kept(v, "fx_det"), GRID)


NEARDET = """nd AS (SELECT r, c, det_id, t, d FROM (SELECT s.r, s.c, k.det_id, k.t, sqrt(pow((s.c+0.5)*200-k.x,2)+pow(19400-(s.r+0.5)*200-k.y,2)) AS d, row_number() OVER (PARTITION BY s.r, s.c ORDER BY sqrt(pow((s.c+0.5)*200-k.x,2)+pow(19400-(s.r+0.5)*200-k.y,2)), k.det_id) AS n FROM fx_scar s, fx_det k) t WHERE n=1),
real AS (SELECT r, c, date_diff('second',(SELECT date_trunc('hour',min(t)) FROM fx_det),t)/3600.0::DOUBLE AS arrival FROM nd)"""


@query("j9_nearest_detection", f"WITH {NEARDET} SELECT r, c, det_id, round(d,6) AS dist FROM nd")
def j9(v):
    return dt.nearest_detection(_kept(v, "fx_scar"), _kept(v, "fx_det"), GRID).withColumn("dist", F.round("dist", 6))


@query("r14_reconstruct_arrival", f"WITH {NEARDET} SELECT r, c, round(arrival,6) AS arrival FROM real")
def r14(v):
    return dt.reconstruct_arrival(_kept(v, "fx_scar"), _kept(v, "fx_det"), GRID).select("r", "c", F.round("arrival", 6).alias("arrival"))


@query("r15_hourly_extents", f"""WITH {NEARDET} SELECT h.hour, strftime((SELECT date_trunc('hour',min(t)) FROM fx_det)+h.hour*INTERVAL 1 HOUR,'%Y-%m-%dT%H:%M') AS time_utc, round(count(*)*0.04::DOUBLE,2) AS km2
FROM (SELECT unnest(generate_series(0,CAST(ceil(max(arrival)) AS BIGINT))) AS hour FROM real) h JOIN real ON real.arrival<=h.hour GROUP BY 1""")
def r15(v):
    return dt.hourly_extents(dt.reconstruct_arrival(_kept(v, "fx_scar"), _kept(v, "fx_det"), GRID), CELL)


@query("a13_arrival_timing", f"""WITH {NEARDET}, j AS (SELECT coalesce(b.r,a.r) AS r, coalesce(b.c,a.c) AS c, b.arrival+0.5::DOUBLE AS s, a.arrival AS a FROM fx_burn b FULL JOIN real a ON a.r=b.r AND a.c=b.c),
w AS (SELECT * , a>1 AND a<=5 AS win FROM j WHERE NOT EXISTS (SELECT 1 FROM fx_burn z WHERE z.arrival=0 AND z.r=j.r AND z.c=j.c))
SELECT round(count(*) FILTER (win)*0.04::DOUBLE,4) AS real_window_km2, {_RE.format('100.0::DOUBLE*count(s) FILTER (win)/count(*) FILTER (win)')} AS sim_reached_pct, round(median(s-a) FILTER (win),1) AS timing_median_h, round(avg(abs(s-a)) FILTER (win),4) AS timing_mae_h,
 {_RE.format('100.0::DOUBLE*count(*) FILTER (win AND s<a)/count(s) FILTER (win)')} AS early_pct, round(count(*) FILTER (a>5 AND s IS NOT NULL)*0.04::DOUBLE,4) AS ahead_km2, round(count(*) FILTER (a IS NULL)*0.04::DOUBLE,4) AS outside_scar_km2 FROM w""")
def a13(v):
    real = dt.reconstruct_arrival(_kept(v, "fx_scar"), _kept(v, "fx_det"), GRID)
    return dt.arrival_timing(_arr(v), real, _seed(v), 1.0, 0.5, 5.0, CELL)


@query("a19_anchor_sensitivity", f"""WITH ev AS (SELECT det_id*10+k AS det_id, x, y, k, least(greatest(CAST(floor(date_diff('second',CASE k WHEN 0 THEN TIMESTAMP '2021-08-05 12:00' ELSE TIMESTAMP '2021-08-05 15:00' END,t)/3600.0) AS BIGINT),0),6) AS period FROM fx_det, (SELECT unnest([0,1]) AS k) z), {_score('ev', 'sc')}
SELECT CASE k WHEN 0 THEN 'noon' ELSE 'three' END AS anchor, {INCL}, {STATS} FROM sc GROUP BY 1""")
def a19(v):
    return dt.anchor_sensitivity(_kept(v, "fx_det"), _arr(v), GRID, [("noon", START), ("three", "2021-08-05 15:00:00")], 6)


@query("r16_validate_detections", f"WITH RECURSIVE {SC} SELECT {INCL}, {STATS} FROM sc")
def r16(v):
    out = pv.validate_detections(_kept(v, "fx_det"), _arr(v), _seed(v), _kept(v, "fx_scar"), GRID, START, T0, END, 6, OX, OY)
    return out["pooled"]


# Perimeter convergence: samples of both boundaries against both lines, by brute force.
_CONV_BODY = f"""sim AS (SELECT h.period AS run_id, b.r, b.c FROM fx_burn b JOIN (SELECT unnest([0,1,2,3,4,5,6]::BIGINT[]) AS period) h ON b.arrival<=h.period UNION ALL SELECT CAST(-1 AS BIGINT), r, c FROM fx_scar), {_rings('sim')},
ext AS (SELECT ring_id FROM ring GROUP BY 1 HAVING sum(ac*br-bc*ar)>0),
er AS (SELECT ring.*, least(ac,bc)*200.0::DOUBLE AS x1, greatest(ac,bc)*200.0::DOUBLE AS x2, 19400.0::DOUBLE-greatest(ar,br)*200 AS y1, 19400.0::DOUBLE-least(ar,br)*200 AS y2 FROM ring JOIN ext ON ext.ring_id=ring.ring_id),
sm AS (SELECT run_id, ring_id, idx, ac*200+(idx*30-seq*200)/200.0::DOUBLE*(bc-ac)*200 AS x, 19400-ar*200-(idx*30-seq*200)/200.0::DOUBLE*(br-ar)*200 AS y FROM (SELECT er.*, unnest(generate_series(CAST(ceil(seq*200/30.0) AS BIGINT), CAST(ceil((seq+1)*200/30.0) AS BIGINT)-1)) AS idx FROM er) z),
dd AS (SELECT 's2r' AS direction, s.run_id AS hour, s.ring_id, s.idx, s.x, s.y, min(sqrt(pow(greatest(e.x1-s.x,s.x-e.x2,0),2)+pow(greatest(e.y1-s.y,s.y-e.y2,0),2))) AS dist FROM sm s JOIN er e ON e.run_id=-1 WHERE s.run_id>=0 GROUP BY ALL
  UNION ALL SELECT 'r2s', e.run_id, s.ring_id, s.idx, s.x, s.y, min(sqrt(pow(greatest(e.x1-s.x,s.x-e.x2,0),2)+pow(greatest(e.y1-s.y,s.y-e.y2,0),2))) FROM sm s JOIN er e ON e.run_id>=0 WHERE s.run_id=-1 GROUP BY ALL),
st AS (SELECT direction, hour, round(avg(dist),1) AS mean_m, round(quantile_cont(dist,0.5),1) AS median_m, round(quantile_cont(dist,0.95),1) AS p95_m, round(max(dist),1) AS max_m FROM dd GROUP BY 1,2),
hi AS (SELECT a.hour, a.mean_m AS mean_s2r_m, b.mean_m AS mean_r2s_m, a.median_m AS median_s2r_m, b.median_m AS median_r2s_m, a.p95_m AS p95_s2r_m, b.p95_m AS p95_r2s_m, a.max_m AS max_s2r_m, b.max_m AS max_r2s_m,
  round((a.mean_m+b.mean_m)/2,1) AS d_t_m, greatest(a.max_m,b.max_m) AS hausdorff_sym_m, greatest(a.p95_m,b.p95_m) AS hd95_m FROM st a JOIN st b ON a.hour=b.hour AND a.direction='s2r' AND b.direction='r2s'),
sg AS (SELECT dd.direction, dd.hour, dd.ring_id, dd.idx, dd.x, dd.y, dist, CASE WHEN (direction='r2s')=(count(m.r)=CASE WHEN dd.x%200=0 THEN 2 ELSE 1 END*CASE WHEN dd.y%200=0 THEN 2 ELSE 1 END) THEN dist ELSE -dist END AS signed_m
  FROM dd LEFT JOIN sim m ON m.run_id=CASE WHEN direction='s2r' THEN -1 ELSE dd.hour END AND m.c BETWEEN ceil(dd.x/200)-1 AND floor(dd.x/200) AND m.r BETWEEN ceil((19400-dd.y)/200)-1 AND floor((19400-dd.y)/200) GROUP BY dd.direction, dd.hour, dd.ring_id, dd.idx, dd.x, dd.y, dd.dist)"""
CONV = "WITH RECURSIVE " + _CONV_BODY
_CONV: dict = {}


def _conv(v):
    key = (v.sf_dir, v.spark.sparkContext.applicationId)
    if key not in _CONV:
        out = pv.perimeter_convergence(_arr(v), _kept(v, "fx_scar"), 6, GRID)
        out["samples"] = materialise(out["samples"], "samples")
        _CONV[key] = out
    return _CONV[key]


@query("r17_perimeter_convergence", f"{CONV} SELECT * FROM hi")
def r17(v):
    return _conv(v)["hourly"]


@query("j7_dist_to_segments", f"{CONV} SELECT direction, hour, idx, round(x,3) AS x, round(y,3) AS y, round(dist,3) AS dist FROM dd")
def j7(v):
    return _conv(v)["samples"].select("direction", "hour", "idx", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("dist", 3).alias("dist"))


@query("a14_direction_stats", f"{CONV} SELECT direction, hour, mean_m, median_m, p95_m, max_m FROM st")
def a14(v):
    return pm.direction_stats(_conv(v)["samples"].filter("NOT excluded"), ["direction", "hour"])


@query("a15_hour_indicators", f"{CONV} SELECT hour, d_t_m, hausdorff_sym_m, hd95_m FROM hi")
def a15(v):
    s = _conv(v)["samples"].filter("NOT excluded")
    d = {k: pm.direction_stats(s.filter(F.col("direction") == k), ["hour"]) for k in ("s2r", "r2s")}
    return pm.hour_indicators(d["s2r"], d["r2s"]).select("hour", "d_t_m", "hausdorff_sym_m", "hd95_m")


@query("t3_find_t_star", f"{CONV} SELECT arg_min(hour, struct_pack(d:=d_t_m,h:=hour)) AS hour, min(d_t_m) AS d_t_m, arg_min(hour, struct_pack(d:=d_t_m,h:=hour)) IN (0,6) AS censored, CAST(count(*) FILTER (d_t_m=(SELECT min(d_t_m) FROM hi))-1 AS BIGINT) AS n_ties FROM hi")
def t3(v):
    return _conv(v)["t_star"].select("hour", "d_t_m", "censored", F.size("ties").cast("long").alias("n_ties"))


@query("t4_stability", f"""{CONV}, lg AS (UNPIVOT hi ON {', '.join(pm.INDICATORS)} INTO NAME indicator VALUE value), ts AS (SELECT arg_min(hour, struct_pack(d:=d_t_m,h:=hour)) AS t FROM hi)
SELECT indicator, arg_min(hour, struct_pack(d:=value,h:=hour)) AS argmin_hour, min(value) AS min_value_m, arg_min(hour, struct_pack(d:=value,h:=hour))=(SELECT t FROM ts) AS agrees FROM lg GROUP BY 1""")
def t4(v):
    return _conv(v)["stability"]


@query("f18_signed", f"{CONV} SELECT direction, hour, idx, round(x,3) AS x, round(y,3) AS y, round(signed_m,3)+0.0 AS signed_m FROM sg")
def f18(v):
    return _conv(v)["samples"].select("direction", "hour", "idx", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), (F.round("signed_m", 3) + 0.0).alias("signed_m"))


@query("a16_signed_summary", f"""{CONV} SELECT direction, hour, count(*) AS n, count(*) FILTER (signed_m>0) AS n_pos, count(*) FILTER (signed_m<0) AS n_neg, round(100.0::DOUBLE*count(*) FILTER (signed_m>0)/count(*),1) AS pos_pct, round(avg(signed_m),1)+0.0 AS mean_m, round(median(signed_m),1)+0.0 AS median_m FROM sg GROUP BY 1,2""")
def a16(v):
    out = pm.signed_summary(_conv(v)["samples"], ["direction", "hour"])
    return out.withColumn("mean_m", F.col("mean_m") + 0.0).withColumn("median_m", F.col("median_m") + 0.0)


@query("a51_sample_stats", f"""{CONV} SELECT direction, hour, count(*) AS n, round(avg(dist),1) AS mean_m, round(median(dist),1) AS median_m, round(quantile_cont(dist,0.95),1) AS p95_m, round(100.0::DOUBLE*count(*) FILTER (signed_m>0)/count(*),1) AS pos_pct, round(avg(signed_m),1)+0.0 AS mean_signed_m FROM sg GROUP BY 1,2""")
def a51(v):
    return pm.sample_stats(_conv(v)["samples"], ["direction", "hour"]).withColumn("mean_signed_m", F.col("mean_signed_m") + 0.0)


_RUNSQL = f""", cl AS (SELECT *, CASE WHEN signed_m>60 THEN 1 WHEN signed_m<-60 THEN -1 ELSE 0 END AS cls, count(*) OVER (PARTITION BY direction, hour, ring_id) AS n FROM sg),
br AS (SELECT a.*, (SELECT b.cls FROM cl b WHERE b.direction=a.direction AND b.hour=a.hour AND b.ring_id=a.ring_id AND b.idx=(a.idx-1+a.n)%a.n) AS pc FROM cl a),
sr AS (SELECT *, sum(CASE WHEN cls<>pc THEN 1 ELSE 0 END) OVER (PARTITION BY direction, hour, ring_id ORDER BY idx) AS g0, sum(CASE WHEN cls<>pc THEN 1 ELSE 0 END) OVER (PARTITION BY direction, hour, ring_id) AS gn FROM br),
rn AS (SELECT direction, hour, ring_id, CASE WHEN g0=0 THEN gn ELSE g0 END AS g, min(cls) AS sign, count(*) AS n_points, min(CASE WHEN cls<>pc THEN idx ELSE 1000000 END) AS si, round(avg(dist),1) AS mean_abs_m, round(max(dist),1) AS max_abs_m FROM sr WHERE cls<>0 GROUP BY 1,2,3,4),
rt AS (SELECT direction, hour, ring_id, sign, n_points, CASE WHEN si=1000000 THEN 0 ELSE si END AS start_idx, CASE WHEN n_points>=5 THEN 'zone' ELSE 'isolated_extreme' END AS kind, mean_abs_m, max_abs_m FROM rn)"""


@query("w11_ring_runs", f"{CONV}{_RUNSQL} SELECT direction, hour, CAST(start_idx AS BIGINT) AS start_idx, n_points, sign, kind, mean_abs_m, max_abs_m FROM rt")
def w11(v):
    return rg.ring_runs(_conv(v)["samples"], ["direction", "hour", "ring_id"]).drop("ring_id")


@query("w12_zone_table", f"""{CONV}{_RUNSQL} SELECT row_number() OVER (ORDER BY direction, hour, ring_id, kind DESC, start_idx) AS zone_id, direction, hour, kind, sign, CASE WHEN sign>0 THEN 'over-extension' ELSE 'lag' END AS meaning, n_points, n_points*30 AS length_m, CAST(start_idx AS BIGINT) AS start_idx, mean_abs_m, max_abs_m FROM rt""")
def w12(v):
    return rg.zone_table(_conv(v)["samples"], ["direction", "hour", "ring_id"]).drop("ring_id")


@query("r36_zone_lines", f"""{CONV}{_RUNSQL}, zt AS (SELECT row_number() OVER (ORDER BY direction, hour, ring_id, kind DESC, start_idx) AS zone_id, * FROM rt), ss AS (SELECT zone_id, direction, hour, ring_id, n_points, unnest(generate_series(0,n_points-1)) AS step, start_idx FROM zt)
SELECT zone_id, CASE WHEN n_points=1 THEN 'Point' ELSE 'LineString' END AS geom, step, round(cl.x,3) AS x, round(cl.y,3) AS y FROM ss JOIN cl ON cl.direction=ss.direction AND cl.hour=ss.hour AND cl.ring_id=ss.ring_id AND cl.idx=(ss.start_idx+step)%cl.n""")
def r36(v):
    s = _conv(v)["samples"]
    k = ["direction", "hour", "ring_id"]
    return rg.zone_lines(rg.zone_table(s, k), s, k).select("zone_id", "geom", "step", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("a17_first_exceed", """SELECT min(h) FILTER (a>(SELECT count(*) FROM fx_scar)) AS strict_hour, min(h) FILTER (a>=(SELECT count(*) FROM fx_scar WHERE r<50)) AS reach_hour FROM (SELECT h, (SELECT count(*) FROM fx_burn WHERE arrival<=h) AS a FROM (SELECT unnest([0,1,2,3,4,5,6]::BIGINT[]) AS h) z) t""")
def a17(v):
    s = cl.perimeter_stats(_fire(v), CELL, ["run_id"]).withColumnRenamed("period", "hour")
    n = _kept(v, "fx_scar").agg(F.count("*") * CELL * CELL, F.count_if(F.col("r") < 50) * CELL * CELL).first()
    a = pm.first_exceed(s, float(n[0]), True).withColumnRenamed("hour", "strict_hour")
    b = pm.first_exceed(s, float(n[1]), False).withColumnRenamed("hour", "reach_hour")
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


_BOX = (2000.0, 3000.0, 15000.0, 21000.0)


@query("p8_exclude_samples", """SELECT settlement_id, outside, NOT outside AND near AS near_frame, outside OR near AS excluded FROM (SELECT settlement_id, NOT (x>2000 AND x<15000 AND y>3000 AND y<21000) AS outside,
  least(abs(x-2000),abs(x-15000),abs(y-3000),abs(y-21000))<=200 AND x BETWEEN 1800 AND 15200 AND y BETWEEN 2800 AND 21200 AS near FROM fx_settlement) t""")
def p8(v):
    out = rg.exclude_samples(v("fx_settlement"), _BOX, 200.0)
    return out.select("settlement_id", "outside", "near_frame", "excluded")


@query("p9_strip_frame", """WITH b AS (SELECT u, v, key, least(x1,x2) AS x1, greatest(x1,x2) AS x2, least(y1,y2) AS y1, greatest(y1,y2) AS y2 FROM fx_edge),
s AS (SELECT *, CASE WHEN y1=y2 THEN y1 ELSE x1 END AS fix, CASE WHEN y1=y2 THEN x1 ELSE y1 END AS lo, CASE WHEN y1=y2 THEN x2 ELSE y2 END AS hi, CASE WHEN y1=y2 THEN 2100 ELSE 3100 END AS a, CASE WHEN y1=y2 THEN 15100 ELSE 21100 END AS z, CASE WHEN y1=y2 THEN 3100 ELSE 2100 END AS fa, CASE WHEN y1=y2 THEN 21100 ELSE 15100 END AS fz FROM b),
n AS (SELECT *, fix>fa+30 AND fix<fz-30 AS inner_, (fix BETWEEN fa-30 AND fa+30) OR (fix BETWEEN fz-30 AND fz+30) AS band FROM s)
SELECT u, v, key, round(sum(greatest(0,least(hi,a-30)-lo)+greatest(0,least(hi,z-30)-greatest(lo,a+30))+greatest(0,hi-greatest(lo,z+30))),3) AS kept_m FROM n WHERE NOT band AND (inner_) GROUP BY 1,2,3 HAVING kept_m>0
UNION ALL SELECT u, v, key, round(sum(hi-lo),3) FROM n WHERE NOT band AND NOT inner_ GROUP BY 1,2,3""")
def p9(v):
    out = rg.strip_frame(v("fx_edge").select("u", "v", "key", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]), (2100.0, 3100.0, 15100.0, 21100.0), 30.0)
    return out.groupBy("u", "v", "key").agg(F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 3).alias("kept_m"))


def _region(v):
    b = v("supplier").agg((F.min("s_suppkey") * 0 + 4000).cast("double").alias("a"), (F.max("s_suppkey") * 0 + 14000).cast("double").alias("b"))
    sides = [("a", "a", "b", "a"), ("b", "a", "b", "b"), ("b", "b", "a", "b"), ("a", "b", "a", "a")]
    return b.select(F.lit(1).alias("ring_id"), F.explode(F.array(*[F.struct(*[F.col(n).alias(k) for n, k in zip(s, ("x1", "y1", "x2", "y2"))]) for s in sides])).alias("s")).select("ring_id", "s.*")


@query("p10_clip_with_guard", "SELECT settlement_id FROM fx_settlement WHERE x>4030 AND x<13970 AND y>4030 AND y<13970")
def p10(v):
    return pm.clip_with_guard(v("fx_settlement"), _region(v), 30.0, "settlement_id").select("settlement_id")


@query("r18_hourly_common", f"""{CONV} SELECT hour, direction, count(*) AS n, round(avg(dist),1) AS mean_m FROM dd WHERE x>4030 AND x<13970 AND y>4030 AND y<13970 GROUP BY 1,2""")
def r18(v):
    s = _conv(v)["samples"].filter("NOT excluded").withColumn("pid", F.struct("direction", "hour", "ring_id", "idx"))
    kept = pm.clip_with_guard(s, _region(v), 30.0, "pid")
    return kept.groupBy("hour", "direction").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 1).alias("mean_m"))


_INT = "(r*131+c*17+arrival*29)%5000"


@query("r12_segment_classes", f"""WITH RECURSIVE fire AS (SELECT run_id, r, c FROM fx_arrival), {_rings('fire')}, ext AS (SELECT ring_id FROM ring GROUP BY 1 HAVING sum(ac*br-bc*ar)>0), er AS (SELECT ring.* FROM ring JOIN ext ON ext.ring_id=ring.ring_id),
md AS (SELECT run_id, ring_id, seq, floor((ac+bc)/2.0) AS c, floor((ar+br)/2.0) AS r FROM er)
SELECT m.run_id, m.ring_id, m.seq, CASE WHEN max(f.fi) IS NULL OR max(f.fi)<=0 THEN 0 WHEN max(f.fi)>=3500 THEN 4 WHEN max(f.fi)>=1750 THEN 3 WHEN max(f.fi)>=350 THEN 2 ELSE 1 END AS cls FROM md m
LEFT JOIN (SELECT run_id, r, c, {_INT} AS fi FROM fx_arrival) f ON f.run_id=m.run_id AND abs(f.r-m.r)<=1 AND abs(f.c-m.c)<=1 GROUP BY 1,2,3""")
def r12(v):
    f = v("fx_arrival")
    segs = rg.ring_segments(rg.boundary_rings(f), RUN_GRID)
    return numbered(rg.cell_sides_classes(segs, f.withColumn("fi", F.expr(_INT)), RUN_GRID, ["run_id"]).select("run_id", "ring_id", "seq", "cls"))


_A3 = """x AS (SELECT l_suppkey AS run_id, l_partkey%5 AS cls, l_quantity AS len FROM lineitem), p AS (SELECT run_id, k, coalesce(sum(len) FILTER (cls=k),0)*100.0/sum(len) FILTER (cls>0) AS pct FROM x, (SELECT unnest([1,2,3,4]) AS k) z GROUP BY 1,2)"""


@query("a3_front_classes", f"WITH {_A3} SELECT run_id, round(max(pct) FILTER (k=1),4) AS pct1, round(max(pct) FILTER (k=2),4) AS pct2, round(max(pct) FILTER (k=3),4) AS pct3, round(max(pct) FILTER (k=4),4) AS pct4, arg_min(k, struct_pack(a:=-pct,b:=k)) AS dom FROM p GROUP BY 1")
def a3(v):
    s = v("lineitem").select(F.col("l_suppkey").alias("run_id"), (F.col("l_partkey") % 5).alias("cls"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), F.lit(0.0).alias("y2"))
    out = rg.front_classes(s, ["run_id"])
    return out.select("run_id", *[F.round(f"pct{k}", 4).alias(f"pct{k}") for k in range(1, 5)], "dom")


@query("r13_isochrones", f"""{CONV}, md AS (SELECT run_id AS period, ring_id, seq, floor((ac+bc)/2.0) AS c, floor((ar+br)/2.0) AS r FROM er WHERE run_id>=0),
k AS (SELECT m.period, m.ring_id, m.seq, CASE WHEN max(f.fi) IS NULL OR max(f.fi)<=0 THEN 0 WHEN max(f.fi)>=3500 THEN 4 WHEN max(f.fi)>=1750 THEN 3 WHEN max(f.fi)>=350 THEN 2 ELSE 1 END AS cls FROM md m LEFT JOIN (SELECT r, c, arrival, {_INT} AS fi FROM fx_burn) f ON f.arrival<=m.period AND abs(f.r-m.r)<=1 AND abs(f.c-m.c)<=1 GROUP BY 1,2,3)
SELECT period, count(*)*200.0::DOUBLE AS length_m, round(100.0::DOUBLE*count(*) FILTER (cls=4)/count(*) FILTER (cls>0),4) AS pct4 FROM k GROUP BY 1""")
def r13(v):
    from hazardframe.plans.exports import isochrones
    fire = v("fx_burn").withColumn("fi", F.expr(_INT))
    out = isochrones(_arr(v), fire.select("r", "c", "arrival", "fi"), 6, GRID)
    return out.select("period", "length_m", F.round("pct4", 4).alias("pct4"))


@query("a18_fragment_sensitivity")
def a18(v):
    f = _kept(v, "fx_scar").select(F.lit(0).cast("long").alias("hour"), "r", "c")
    segs = rg.ring_segments(rg.boundary_rings(f, ["hour"]), GRID, ["hour"]).drop("hour")
    return pv.fragment_sensitivity(_arr(v), 5, materialise(segs, "scar-segments"), GRID, (0.0, 5.0, 20.0, 100.0))
