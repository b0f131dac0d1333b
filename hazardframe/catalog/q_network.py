"""Queries of the road network, routing and evacuation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.catalog.q_cells import WIDTH, _width
from hazardframe.catalog.registry import query
from hazardframe.operators import cells as cl
from hazardframe.operators import checks as ck
from hazardframe.operators import evacuation as ev
from hazardframe.operators import network as net
from hazardframe.operators import overlay as ov
from hazardframe.operators import spatial as sp
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import materialise
from hazardframe.plans.evacuate import Evacuation, evacuate

GRID = Grid(0.0, 19400.0, 200.0, 97, 89)
KEY = ["run_id"]

ZONE = f"""w AS (SELECT r, c, {WIDTH} AS w FROM fx_gridcell), o AS (SELECT a.i, b.j FROM (SELECT unnest([-3,-2,-1,0,1,2,3]) AS i) a, (SELECT unnest([-3,-2,-1,0,1,2,3]) AS j) b),
zone AS (SELECT w.r, w.c, min(f.arrival) AS arrival FROM fx_burn f, o JOIN w ON TRUE WHERE w.r=f.r+o.i AND w.c=f.c+o.j AND 200*sqrt(o.i*o.i+o.j*o.j)<=w.w GROUP BY 1,2)"""
_RECT = "sqrt(pow(greatest(abs({p}.x-(z.c+0.5)*200)-100,0),2)+pow(greatest(abs({p}.y-(19400-(z.r+0.5)*200))-100,0),2))"
EXPO = ZONE + f""",
risk AS (SELECT s.settlement_id, min(z.arrival) AS risk_at FROM fx_settlement s JOIN zone z ON z.c BETWEEN floor(s.x/200)-3 AND floor(s.x/200)+3 AND {_RECT.format(p='s')}<=300 GROUP BY 1),
hit AS (SELECT settlement_id, max(b.arrival) AS hit_at FROM (SELECT *, (ceil(x/200)<>floor(x/200))::INT AS one, CASE WHEN x%200=0 THEN 2 ELSE 1 END * CASE WHEN y%200=0 THEN 2 ELSE 1 END AS n FROM fx_settlement) s
  JOIN fx_burn b ON b.c BETWEEN ceil(s.x/200)-1 AND floor(s.x/200) AND b.r BETWEEN ceil((19400-s.y)/200)-1 AND floor((19400-s.y)/200) GROUP BY settlement_id, n HAVING count(*)=n),
expo AS (SELECT risk.settlement_id, risk_at, hit_at FROM risk LEFT JOIN hit ON hit.settlement_id=risk.settlement_id)"""
CUT = """cut AS (SELECT e.u, e.v, e.key, min(b.arrival) AS cut_at FROM fx_edge e JOIN fx_burn b ON b.c BETWEEN ceil(least(x1,x2)/200)-1 AND floor(greatest(x1,x2)/200)
  AND b.r BETWEEN ceil((19400-greatest(y1,y2))/200)-1 AND floor((19400-least(y1,y2))/200) GROUP BY 1,2,3)"""
HOURLY = CUT + """, hours AS (SELECT unnest(generate_series(min(arrival),max(arrival))) AS period FROM fx_burn),
dst AS (SELECT e.u, e.v, e.key, b.arrival, min(sqrt(pow(greatest(b.c*200-greatest(x1,x2), least(x1,x2)-(b.c+1)*200, 0),2)+pow(greatest(19400-(b.r+1)*200-greatest(y1,y2), least(y1,y2)-(19400-b.r*200), 0),2))) AS d
  FROM fx_edge e JOIN fx_burn b ON b.c*200 BETWEEN least(x1,x2)-1800 AND greatest(x1,x2)+1800 AND 19400-b.r*200 BETWEEN least(y1,y2)-1800 AND greatest(y1,y2)+1800 GROUP BY 1,2,3,4),
he AS (SELECT h.period, e.u, e.v, min(e.length_m*(1+4*greatest(0,least(1,1-coalesce((SELECT min(d) FROM dst WHERE dst.u=e.u AND dst.v=e.v AND dst.key=e.key AND dst.arrival<=h.period),1500)/1500.0::DOUBLE)))) AS cost, min(e.length_m) AS length_m
  FROM fx_edge e, hours h WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.u=e.u AND cut.v=e.v AND cut.key=e.key AND cut.cut_at<=h.period) GROUP BY 1,2,3)"""
ROUTE = EXPO + ", " + HOURLY + f""",
pool AS (SELECT refuge_id, x, y FROM fx_refuge UNION ALL SELECT -settlement_id-1, x, y FROM fx_settlement WHERE source='official'),
snap AS (SELECT refuge_id, x, y, node_id, d FROM (SELECT p.*, k.node_id, sqrt(pow(p.x-k.x,2)+pow(p.y-k.y,2)) AS d, row_number() OVER (PARTITION BY refuge_id ORDER BY sqrt(pow(p.x-k.x,2)+pow(p.y-k.y,2)), k.node_id) AS n FROM pool p, fx_node k) t WHERE n=1),
uns AS (SELECT s.refuge_id, min(z.arrival) AS unsafe_at FROM snap s JOIN zone z ON z.c BETWEEN floor(s.x/200)-4 AND floor(s.x/200)+4 AND {_RECT.format(p='s')}<=500 GROUP BY 1),
opn AS (SELECT h.period, s.node_id, s.refuge_id, s.d FROM snap s, hours h WHERE NOT EXISTS (SELECT 1 FROM uns WHERE uns.refuge_id=s.refuge_id AND unsafe_at<=h.period)
  AND NOT EXISTS (SELECT 1 FROM expo WHERE -expo.settlement_id-1=s.refuge_id AND risk_at<=h.period)),
seed AS (SELECT period, node_id, refuge_id FROM (SELECT *, row_number() OVER (PARTITION BY period, node_id ORDER BY d, refuge_id) AS n FROM opn) t WHERE n=1),
lab(period,node,cost,refuge_id,next_hop) USING KEY (period,node) AS (SELECT period, node_id, 0.0::DOUBLE, refuge_id, CAST(NULL AS BIGINT) FROM seed
  UNION SELECT n.period, n.u, m.cost, m.ref, m.nxt FROM (SELECT e.period, e.u, min(struct_pack(cost:=l.cost+e.cost, ref:=l.refuge_id, nxt:=l.node)) AS m FROM lab l JOIN he e ON e.period=l.period AND e.v=l.node GROUP BY 1,2) n
  LEFT JOIN recurring.lab k ON k.period=n.period AND k.node=n.u WHERE k.cost IS NULL OR m.cost<k.cost OR (m.cost=k.cost AND (m.ref<k.refuge_id OR (m.ref=k.refuge_id AND m.nxt<k.next_hop))))"""
OUTCOME = ROUTE + """,
atr AS (SELECT h.period, e.settlement_id, coalesce(hit_at<=h.period, FALSE) AS impacted FROM expo e JOIN hours h ON h.period>=e.risk_at),
org AS (SELECT settlement_id, node_id FROM (SELECT s.settlement_id, k.node_id, row_number() OVER (PARTITION BY settlement_id ORDER BY sqrt(pow(s.x-k.x,2)+pow(s.y-k.y,2)), k.node_id) AS n FROM fx_settlement s, fx_node k WHERE s.settlement_id IN (SELECT settlement_id FROM expo)) t WHERE n=1),
pth AS (SELECT a.period, a.settlement_id, CAST(0 AS BIGINT) AS seq, o.node_id AS u, l.next_hop AS v FROM atr a JOIN org o ON o.settlement_id=a.settlement_id JOIN lab l ON l.period=a.period AND l.node=o.node_id WHERE NOT a.impacted AND l.next_hop IS NOT NULL
  UNION ALL SELECT p.period, p.settlement_id, p.seq+1, p.v, l.next_hop FROM pth p JOIN lab l ON l.period=p.period AND l.node=p.v WHERE l.next_hop IS NOT NULL),
pl AS (SELECT pth.*, he.length_m FROM pth JOIN he ON he.period=pth.period AND he.u=pth.u AND he.v=pth.v),
outc AS (SELECT a.period, a.settlement_id, s.pop, CASE WHEN a.impacted THEN 'impacted' WHEN l.refuge_id IS NOT NULL THEN 'ok' ELSE 'cut_off' END AS status, CASE WHEN NOT a.impacted THEN l.refuge_id END AS refuge_id,
  CASE WHEN NOT a.impacted THEN l.cost END AS cost, CASE WHEN NOT a.impacted AND l.cost IS NOT NULL THEN coalesce((SELECT sum(length_m) FROM pl WHERE pl.period=a.period AND pl.settlement_id=a.settlement_id),0)::DOUBLE END AS length_m
  FROM atr a JOIN fx_settlement s ON s.settlement_id=a.settlement_id JOIN org o ON o.settlement_id=a.settlement_id LEFT JOIN lab l ON l.period=a.period AND l.node=o.node_id),
summ AS (SELECT h.period, round((SELECT count(*) FROM fx_burn WHERE arrival<=h.period)*40000.0::DOUBLE/1e6,2) AS fire_km2, count(x.settlement_id) AS at_risk, CAST(coalesce(sum(x.pop),0) AS BIGINT) AS population,
  count(*) FILTER (x.status='ok') AS routed, count(*) FILTER (x.status='cut_off') AS cut_off, count(*) FILTER (x.status='impacted') AS impacted, (SELECT count(*) FROM cut WHERE cut_at<=h.period) AS edges_removed,
  round(max(x.length_m)/1000,2) AS longest_route_km FROM hours h LEFT JOIN outc x ON x.period=h.period GROUP BY h.period)"""


def _fire(v):
    return v("fx_burn").withColumn("run_id", F.lit(0).cast("long")).select("run_id", "r", "c", "arrival")


_RUNS: dict = {}


def run(v) -> Evacuation:
    """The evacuation of one data folder, shared by the queries of one session."""
    key = (v.sf_dir, v.spark.sparkContext.applicationId)
    if key not in _RUNS:
        _RUNS[key] = evacuate(_fire(v), _width(v("fx_gridcell")), GRID, v("fx_node"), v("fx_edge"), v("fx_settlement"), v("fx_refuge"), KEY, "2021-08-05 12:00:00")
    return _RUNS[key]


@query("j5_cut_edges", f"WITH {CUT} SELECT * FROM cut")
def j5(v):
    return net.cut_edges(v("fx_edge"), _fire(v), GRID, KEY).drop("run_id")


@query("f11_friction", f"WITH {HOURLY} SELECT period, u, v, round(cost,4) AS cost, length_m FROM he")
def f11(v):
    hours = cl.perimeter_stats(_fire(v), 200.0, KEY).select("run_id", "period")
    out = net.hourly_edges(v("fx_edge"), _fire(v), hours, GRID, KEY)
    return out.select("period", "u", "v", F.round("cost", 4).alias("cost"), "length_m")


@query("r4_exposure", f"WITH {EXPO} SELECT settlement_id, risk_at, hit_at FROM expo")
def r4(v):
    fire = _fire(v)
    zone = cl.blocked_zone(fire, _width(v("fx_gridcell")), 200.0, KEY)
    return ev.exposure(v("fx_settlement"), zone, fire, GRID, KEY).drop("run_id")


@query("r5_eligible_refuges", f"""WITH {ZONE}, hours AS (SELECT unnest(generate_series(min(arrival),max(arrival))) AS period FROM fx_burn)
SELECT h.period, s.refuge_id FROM fx_refuge s, hours h WHERE NOT EXISTS (SELECT 1 FROM zone z WHERE z.arrival<=h.period AND {_RECT.format(p='s')}<=500)""")
def r5(v):
    fire = _fire(v)
    zone = cl.blocked_zone(fire, _width(v("fx_gridcell")), 200.0, KEY)
    return ev.eligible_refuges(v("fx_refuge"), zone, cl.perimeter_stats(fire, 200.0, KEY), GRID, KEY).select("period", "refuge_id")


@query("u1_all_settlements", "SELECT settlement_id, name, x, y, pop, source FROM fx_settlement")
def u1(v):
    s = v("fx_settlement")
    return ev.all_settlements(s.filter("source='official'"), s.filter("source='osm'"))


@query("u2_refuge_pool", """SELECT source, count(*) AS n FROM (SELECT 'osm' AS source FROM fx_refuge UNION ALL SELECT 'official' FROM fx_settlement WHERE source='official') t GROUP BY 1""")
def u2(v):
    safe = v("fx_settlement").filter("source='official'").select(F.col("settlement_id").alias("refuge_id"), "name", "x", "y")
    return ev.refuge_pool(v("fx_refuge"), safe).groupBy("source").agg(F.count("*").alias("n"))


_ONE = """e1 AS (SELECT u, v, min(length_m) AS length_m FROM fx_edge GROUP BY 1,2), d(node,cost,nxt) USING KEY (node) AS (SELECT max(node_id), 0.0::DOUBLE, CAST(NULL AS BIGINT) FROM fx_node
  UNION SELECT n.u, m.cost, m.nxt FROM (SELECT e.u, min(struct_pack(cost:=d.cost+e.length_m, nxt:=d.node)) AS m FROM d JOIN e1 e ON e.v=d.node GROUP BY 1) n LEFT JOIN recurring.d k ON k.node=n.u
  WHERE k.cost IS NULL OR m.cost<k.cost OR (m.cost=k.cost AND m.nxt<k.nxt)),
p AS (SELECT CAST(0 AS BIGINT) AS seq, node AS u, nxt AS v FROM d WHERE node=(SELECT min(node_id) FROM fx_node WHERE sz>3) AND nxt IS NOT NULL UNION ALL SELECT p.seq+1, p.v, d.nxt FROM p JOIN d ON d.node=p.v WHERE d.nxt IS NOT NULL)"""


@query("g3_shortest_path", f"WITH RECURSIVE {_ONE} SELECT p.seq, p.u, p.v, e1.length_m FROM p JOIN e1 ON e1.u=p.u AND e1.v=p.v")
def g3(v):
    b = v("fx_node").agg(F.min(F.when(F.col("sz") > 3, F.col("node_id"))), F.max("node_id")).first()
    return ov.shortest_path(v("fx_edge"), v("fx_node"), b[0], b[1]).select("seq", "u", "v", "length_m")


@query("g4_route_all", f"WITH RECURSIVE {ROUTE} SELECT period, node, round(cost,3) AS cost, refuge_id, next_hop FROM lab")
def g4(v):
    """Labels of every node and hour, from all eligible refuges at once."""
    fire, edges = materialise(_fire(v), "arrival"), materialise(v("fx_edge"), "edges")
    hours = materialise(cl.perimeter_stats(fire, 200.0, KEY).select("run_id", "period"), "hours")
    zone = materialise(cl.blocked_zone(fire, _width(v("fx_gridcell")), 200.0, KEY), "zone")
    seeds = materialise(ev.open_refuges(v("fx_settlement"), v("fx_refuge"), v("fx_node"), zone, ev.exposure(v("fx_settlement"), zone, fire, GRID, KEY), hours, GRID, KEY), "seeds")
    spans = materialise(ov.edge_spans(edges, fire, GRID, KEY), "edge-spans")
    out = ov.route(ov.Overlay(edges, spans, ov.network_parts(v("fx_node")), KEY), seeds)
    return out.select("period", "node", F.round("cost", 3).alias("cost"), "refuge_id", "next_hop")


@query("g5_reconstruct", f"WITH RECURSIVE {OUTCOME} SELECT period, settlement_id, seq, u, v, length_m FROM pl")
def g5(v):
    return run(v).path.select("period", F.col("origin_id").alias("settlement_id"), "seq", "u", "v", "length_m")


@query("g6_route_lines", f"""WITH RECURSIVE {OUTCOME} SELECT period, settlement_id, CAST(1 AS BIGINT) AS n_parts, round(sum(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))),3) AS drawn_m
  FROM pl JOIN fx_node a ON a.node_id=pl.u JOIN fx_node b ON b.node_id=pl.v GROUP BY 1,2""")
def g6(v):
    out = net.route_lines(run(v).path, v("fx_node"), ["period"])
    return out.select("period", F.col("origin_id").alias("settlement_id"), "n_parts", F.round("drawn_m", 3).alias("drawn_m"))


@query("t2_nearest_refuge", f"WITH RECURSIVE {OUTCOME} SELECT period, settlement_id, refuge_id, round(cost,1) AS cost, length_m FROM outc WHERE status='ok'")
def t2(v):
    return run(v).outcome.filter("status='ok'").select("period", "settlement_id", "refuge_id", F.round("cost", 1).alias("cost"), "length_m")


@query("r6_evacuate", f"WITH RECURSIVE {OUTCOME} SELECT period, strftime(TIMESTAMP '2021-08-05 12:00'+period*INTERVAL 1 HOUR,'%Y-%m-%d %H:%M') AS time_utc, fire_km2, at_risk, population, routed, cut_off, impacted, edges_removed, longest_route_km FROM summ")
def r6(v):
    return run(v).summary.drop("run_id").withColumn("time_utc", F.date_format("time_utc", "yyyy-MM-dd HH:mm"))


@query("a4_hourly_summary", f"WITH RECURSIVE {OUTCOME} SELECT period, at_risk, routed+cut_off+impacted AS counted, edges_removed, fire_km2 FROM summ")
def a4(v):
    return run(v).summary.select("period", "at_risk", (F.col("routed") + F.col("cut_off") + F.col("impacted")).alias("counted"), "edges_removed", "fire_km2")


@query("a5_run_headline", f"WITH RECURSIVE {OUTCOME} SELECT arg_max(at_risk,period) AS at_risk, arg_max(cut_off,period) AS cut_off, arg_max(fire_km2,period) AS fire_km2, count(*)-1 AS hours_simulated FROM summ")
def a5(v):
    return ck.run_headline(run(v).summary, KEY).select("at_risk", "cut_off", "fire_km2", "hours_simulated")


@query("t1_rank_exposed", f"WITH RECURSIVE {EXPO} SELECT settlement_id, pop, row_number() OVER (ORDER BY pop DESC NULLS LAST, settlement_id) AS rank FROM fx_settlement JOIN risk USING (settlement_id)")
def t1(v):
    risk = v("fx_settlement").join(r4(v).select("settlement_id"), "settlement_id", "left_semi")
    return ev.with_rank(ev.rank_exposed(risk)).select("settlement_id", "pop", "rank")


@query("w7_hourly_events", f"""WITH RECURSIVE {OUTCOME}, pv AS (SELECT a.*, b.status AS ps, b.refuge_id AS pr, b.settlement_id AS pid FROM outc a LEFT JOIN outc b ON b.settlement_id=a.settlement_id AND b.period=a.period-1)
SELECT period, kind, settlement_id, CAST(NULL AS BIGINT) AS n FROM (SELECT *, CASE WHEN pid IS NULL THEN CASE status WHEN 'ok' THEN 'at_risk_ok' WHEN 'cut_off' THEN 'at_risk_cut' ELSE 'at_risk_impacted' END
  WHEN ps<>'cut_off' AND status='cut_off' THEN 'cut_off' WHEN ps='cut_off' AND status='ok' THEN 'reaccessible' WHEN status='ok' AND pr<>refuge_id THEN 'refuge_change' END AS kind FROM pv) t WHERE kind IS NOT NULL
UNION ALL SELECT period, 'road', NULL, d FROM (SELECT period, edges_removed-lag(edges_removed) OVER (ORDER BY period) AS d FROM summ) z WHERE d>0""")
def w7(v):
    e = run(v)
    return ev.hourly_events(e.outcome, e.summary, KEY).drop("run_id")


@query("w10_c2_monotone", f"""WITH RECURSIVE {OUTCOME}, f AS (SELECT period, CASE WHEN period=3 THEN -1 ELSE edges_removed END AS edges_removed FROM summ),
p AS (SELECT *, lag(edges_removed) OVER (ORDER BY period) AS prev_removed FROM f) SELECT * FROM p WHERE edges_removed<prev_removed""")
def w10(v):
    """One hour's count is spoilt, so the check has something to find."""
    spoilt = run(v).summary.withColumn("edges_removed", F.when(F.col("period") == 3, -1).otherwise(F.col("edges_removed")))
    return ev.c2_monotone(spoilt, KEY).select("period", "edges_removed", "prev_removed")


@query("a20_scenario_deltas", f"""WITH RECURSIVE {OUTCOME}, pv AS (SELECT period, settlement_id, status, refuge_id, round(length_m/1000,2) AS km, lag(period) OVER w AS pp, lag(status) OVER w AS ps, lag(refuge_id) OVER w AS pr, lag(round(length_m/1000,2)) OVER w AS pk FROM outc WINDOW w AS (PARTITION BY settlement_id ORDER BY period))
SELECT settlement_id, pp AS from_period, period, CASE WHEN status='ok' THEN round(km-pk,2) END AS delta_km, CASE WHEN status='ok' THEN refuge_id<>pr END AS refuge_changed, CASE WHEN status<>'ok' THEN status END AS lost_to FROM pv WHERE ps='ok'""")
def a20(v):
    return ev.scenario_deltas(run(v).outcome, KEY).drop("run_id")


@query("j14_outcome_routes", f"""WITH RECURSIVE {OUTCOME} SELECT period, settlement_id, status, CAST(CASE WHEN settlement_id%2=0 THEN 0 ELSE 2 END AS BIGINT) AS n_routes
FROM outc WHERE status='ok' AND length_m>0""")
def j14(v):
    """The routes are spoilt: even settlements lose theirs, odd ones have theirs twice."""
    e = run(v)
    odd = ev.drawn_routes(e.path).filter("settlement_id % 2 = 1")
    return ev.join_outcome_routes(e.outcome, odd.unionAll(odd), [])


@query("j15_settlement_evac_hour", f"""WITH RECURSIVE {EXPO} SELECT s.settlement_id, risk_at AS evac_hour, strftime(TIMESTAMP '2021-08-05 15:00'+risk_at*INTERVAL 1 HOUR,'%d/%m/%Y %H:%M') AS evac_local FROM fx_settlement s LEFT JOIN risk USING (settlement_id)""")
def j15(v):
    e = run(v)
    return ev.settlement_evac_hour(v("fx_settlement"), e.outcome, e.summary, KEY).select("settlement_id", "evac_hour", "evac_local")


@query("j16_flag_route_edges", f"WITH RECURSIVE {OUTCOME} SELECT e.u, e.v, e.key, min(pl.period) AS first_hour, count(pl.period)>0 AS on_route FROM fx_edge e LEFT JOIN pl ON pl.u=e.u AND pl.v=e.v GROUP BY 1,2,3")
def j16(v):
    return ev.flag_route_edges(v("fx_edge"), run(v).path.drop("run_id")).select("u", "v", "key", "first_hour", "on_route")


@query("r24_status_at", f"WITH RECURSIVE {OUTCOME} SELECT settlement_id, status FROM outc WHERE period=4")
def r24(v):
    return ev.status_at(run(v).outcome, 4).select("settlement_id", "status")


@query("r23_dashboard_feed", f"""WITH RECURSIVE {OUTCOME} SELECT s.period, s.fire_km2, round(s.fire_km2-coalesce(lag(s.fire_km2) OVER (ORDER BY s.period),s.fire_km2),2) AS d_km2, s.at_risk,
  (SELECT count(*) FROM outc o WHERE o.period=s.period AND o.status='ok') AS n_routes FROM summ s""")
def r23(v):
    e = run(v)
    feed = ck.dashboard_feed(e, KEY)
    return feed.select("period", "fire_km2", "d_km2", "at_risk", F.size(F.filter("outcomes", lambda o: o["status"] == "ok")).cast("long").alias("n_routes"))


@query("r19_evacuation_checks", f"""WITH RECURSIVE {OUTCOME}, sg AS (SELECT pl.*, least(a.x,b.x) AS xa, greatest(a.x,b.x) AS xb, least(a.y,b.y) AS ya, greatest(a.y,b.y) AS yb FROM pl JOIN fx_node a ON a.node_id=pl.u JOIN fx_node b ON b.node_id=pl.v),
d AS (SELECT period, settlement_id, sum(greatest(xb-xa,yb-ya)) AS drawn, sum(length_m) AS stated FROM sg GROUP BY 1,2)
SELECT 'C1' AS check_id, CAST(0 AS BIGINT) AS n_violations UNION ALL SELECT 'C2', 0 UNION ALL SELECT 'C3', 0
UNION ALL SELECT 'C4', count(*) FILTER (abs(drawn-stated)>greatest(25,0.01*stated)) FROM d UNION ALL SELECT 'C5', 0""")
def r19(v):
    e = run(v)
    return ck.evacuation_checks(e, v("fx_edge"), v("fx_node"), _fire(v), GRID, KEY).select("check_id", "n_violations")


@query("a21_check_report", f"""WITH RECURSIVE {OUTCOME}, d AS (SELECT period, settlement_id, sum(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) AS drawn, sum(length_m) AS stated FROM pl JOIN fx_node a ON a.node_id=pl.u JOIN fx_node b ON b.node_id=pl.v GROUP BY 1,2)
SELECT count(*) AS n_routes, round(median(abs(drawn-stated)),3) AS median_diff_m, round(max(abs(drawn-stated)),3) AS max_diff_m FROM d""")
def a21(v):
    return ck.length_report(run(v), v("fx_node"), KEY)


@query("r20_reproduce", f"WITH RECURSIVE {OUTCOME} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_diff FROM outc")
def r20(v):
    e = run(v)
    again = evacuate(_fire(v), _width(v("fx_gridcell")), GRID, v("fx_node"), v("fx_edge"), v("fx_settlement"), v("fx_refuge"), KEY, "2021-08-05 12:00:00")
    return ck.reproduce(e.outcome, again.outcome, KEY)
