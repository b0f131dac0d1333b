"""Input bindings: the library's inputs derived from the driver's parquet tables.

Each view is one SQL text that runs unchanged in Spark and DuckDB. Views may use each
other; ``with_views`` prepends whatever a query text names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["fx_settlement"] = """
SELECT c_custkey AS settlement_id, c_name AS name,
  CAST((c_custkey*7919)%20011 AS DOUBLE) AS x, CAST((c_custkey*6271)%25013 AS DOUBLE) AS y,
  CASE WHEN c_acctbal<0 THEN NULL ELSE CAST(floor(c_acctbal) AS BIGINT) END AS pop,
  CASE WHEN c_nationkey%2=0 THEN 'official' ELSE 'osm' END AS source FROM customer"""

VIEWS["fx_refuge"] = """
SELECT s_suppkey AS refuge_id, s_name AS name,
  CAST((s_suppkey*4001)%20011 AS DOUBLE) AS x, CAST((s_suppkey*3001)%25013 AS DOUBLE) AS y
FROM supplier"""

VIEWS["fx_node"] = """
SELECT p_partkey AS node_id, CAST((p_partkey%40)*500 AS DOUBLE) AS x,
  CAST(floor(p_partkey/40)*500 AS DOUBLE) AS y, CAST(p_size AS BIGINT) AS sz FROM part"""

# One-way lattice links; narrow roads (size 1 to 3) are closed, which leaves holes.
VIEWS["fx_link"] = """
SELECT a.node_id AS u, b.node_id AS v, 500+7*a.sz AS length_m,
  a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM fx_node a JOIN fx_node b ON b.node_id=a.node_id+1 WHERE a.x<19500 AND a.sz>3
UNION ALL
SELECT a.node_id, b.node_id, 500+7*a.sz, a.x, a.y, b.x, b.y
  FROM fx_node a JOIN fx_node b ON b.node_id=a.node_id+40 WHERE a.sz>3"""

VIEWS["fx_edge"] = """
SELECT u, v, CAST(0 AS BIGINT) AS key, length_m, x1, y1, x2, y2 FROM fx_link
UNION ALL SELECT v, u, CAST(0 AS BIGINT), length_m, x2, y2, x1, y1 FROM fx_link
UNION ALL SELECT u, v, CAST(1 AS BIGINT), length_m+40, x1, y1, x2, y2 FROM fx_link
  WHERE length_m>800"""

# A footprint per supplier: a speckled fire that grows from its own centre.
VIEWS["fx_arrival"] = """
SELECT run_id, r, c, min(CAST(floor(greatest(abs(r-60),abs(c-60))/2) AS BIGINT)) AS arrival
FROM (SELECT l_suppkey AS run_id, 60+l_partkey%31-15 AS r, 60+l_orderkey%29-14 AS c
      FROM lineitem) t GROUP BY run_id, r, c"""

# The same run recomputed elsewhere, with a few differing cells.
VIEWS["fx_arrival_b"] = """
SELECT run_id, r, c, CASE WHEN (r*31+c*17+run_id)%97=0 THEN arrival+1 ELSE arrival END AS arrival
FROM fx_arrival"""

# One large contiguous fire (run 0) on a 200 m grid over the road network.
VIEWS["fx_burn"] = """
SELECT r, c, CAST(min(CASE WHEN d2<=9 THEN 0 WHEN d2<=25 THEN 1 WHEN d2<=49 THEN 2 WHEN d2<=81 THEN 3
  WHEN d2<=121 THEN 4 WHEN d2<=169 THEN 5 ELSE 6 END) AS BIGINT) AS arrival
FROM (SELECT r, c, (r-48)*(r-48)+(c-44)*(c-44) AS d2 FROM
      (SELECT l_partkey%97 AS r, l_orderkey%89 AS c FROM lineitem) s) t
WHERE d2<=225 GROUP BY r, c"""

# Every cell of that grid.
VIEWS["fx_gridcell"] = "SELECT DISTINCT l_partkey%97 AS r, l_orderkey%89 AS c FROM lineitem"

# Hourly weather of many stations (one per supplier), irregular hours.
VIEWS["fx_weather"] = """
SELECT station_id, ts,
  5+CAST(sum(CAST(l_quantity AS BIGINT)*37)%2800 AS DOUBLE)/97 AS temp_c,
  20+CAST(sum(l_partkey*13)%7000 AS DOUBLE)/100 AS rh_pct,
  CAST(sum(l_orderkey)%400 AS DOUBLE)/10 AS ws_kmh,
  CAST(sum(l_partkey*7)%360 AS DOUBLE) AS wd_from,
  CASE WHEN sum(l_partkey+l_orderkey)%9=0 THEN CAST(sum(l_orderkey)%120 AS DOUBLE)/10 ELSE 0 END AS precip_mm
FROM (SELECT l_suppkey AS station_id, l_partkey, l_orderkey, l_quantity,
        l_shipdate + CAST((l_linenumber*5+5)%24 AS INT) * INTERVAL '1' HOUR AS ts FROM lineitem) t
GROUP BY station_id, ts"""

# The dense hourly series of one place.
VIEWS["fx_hourly"] = """
SELECT date_trunc('hour',ts) AS ts,
  10+CAST(sum(CAST(round(value*100) AS BIGINT))%2500 AS DOUBLE)/100 AS temp_c,
  20+CAST(sum(event_id)%6000 AS DOUBLE)/100 AS rh_pct, CAST(sum(user_id)%400 AS DOUBLE)/10 AS ws_kmh,
  CAST(sum(event_id*7)%360 AS DOUBLE) AS wd_from,
  CASE WHEN sum(event_id)%9=0 THEN CAST(sum(user_id)%120 AS DOUBLE)/10 ELSE 0 END AS precip_mm
FROM events GROUP BY 1"""

# Gridded hourly weather: each event is one cell's reading.
VIEWS["fx_wgrid"] = """
SELECT cell, CAST(38.5+(cell%5)*0.1 AS DOUBLE) AS lat, CAST(23.0+floor(cell/5)*0.1 AS DOUBLE) AS lon, ts,
  CASE WHEN s%17=0 THEN NULL ELSE CAST(s%400 AS DOUBLE)/10 END AS ws_kmh,
  CAST(s%360 AS DOUBLE) AS wd_from, CAST(s%300 AS DOUBLE)/10 AS temp_c,
  CASE WHEN s%13=0 THEN NULL ELSE CAST(s%1000 AS DOUBLE)/10 END AS rh_pct, CAST(s%50 AS DOUBLE)/10 AS precip_mm
FROM (SELECT user_id%20 AS cell, date_trunc('hour',ts) AS ts, sum(event_id*31+user_id) AS s
      FROM events GROUP BY 1,2) t"""

VIEWS["fx_detection"] = """
SELECT event_id AS det_id, ts AS t, CAST((user_id*7919)%20011 AS DOUBLE) AS x,
  CAST((event_id*6271)%25013 AS DOUBLE) AS y FROM events WHERE event_type='error'"""

# The same detections within the hours of the network fire.
VIEWS["fx_det"] = """
SELECT event_id AS det_id, TIMESTAMP '2021-08-05 12:00:00' + CAST(((event_id*37)%60)*7 AS INT) * INTERVAL '1' MINUTE AS t,
  CAST((user_id*7919+event_id*13)%17801 AS DOUBLE) AS x, CAST((event_id*6271)%19403 AS DOUBLE) AS y
FROM events WHERE event_type='error'"""

# The scar the fire finally left.
VIEWS["fx_scar"] = "SELECT r, c FROM fx_gridcell WHERE (r-51)*(r-51)+(c-46)*(c-46)<=150"

VIEWS["fx_eval"] = """
SELECT conv_id AS case_id, turn AS rep, text AS reply, length(text)%7<>0 AS stage_a_ok,
  (conv_id+turn)%5<>0 AS stage_b_ok, length(text)%13<>0 AS numeric_ok,
  CASE WHEN length(text)%11=0 THEN NULL ELSE length(text)%3<>0 END AS stage_c,
  CASE WHEN (conv_id+turn)%9=0 THEN NULL ELSE (conv_id*3+turn)%4<>0 END AS coverage,
  CASE WHEN conv_id%2=0 THEN 'free' ELSE 'structured' END AS arm,
  CASE conv_id%3 WHEN 0 THEN 'complete' WHEN 1 THEN 'invalid_input' ELSE 'follow_up' END AS category
FROM conversations WHERE role='assistant'"""

VIEWS["fx_rater"] = """
SELECT doc_id AS record_id, quality=1 AS primary_pass, toxic=0 AS second_pass FROM labels"""

# Two-arm evaluation records, one per order: 5 cases' worth of repetitions per model.
VIEWS["fx_record"] = """
SELECT o_orderkey AS record_id, CONCAT('m', CAST(o_custkey%3 AS STRING)) AS model,
  CONCAT('C', CAST(floor(o_orderkey/10) AS BIGINT)) AS case_id, floor((o_orderkey%10)/2)+1 AS rep,
  CASE WHEN o_orderkey%2=0 THEN 'free' ELSE 'structured' END AS arm,
  o_orderpriority AS category, (o_custkey*7+o_orderkey)%6<>0 AS stage_a_ok, (o_custkey+o_orderkey)%8<>0 AS stage_b_ok,
  (o_custkey*5+o_orderkey*3)%7<>0 AS numeric_ok,
  CASE WHEN (o_custkey+o_orderkey)%19=0 THEN NULL ELSE (o_custkey*3+o_orderkey)%5<>0 END AS stage_c,
  CASE WHEN (o_custkey*11+o_orderkey)%23=0 THEN NULL ELSE (o_custkey*2+o_orderkey)%6<>0 END AS coverage
FROM orders"""

# Structured and free answers of several kinds (valid, broken, refused ...), one per order,
# with the tool payload they speak about. The cut-off counts c0..c3 are at hours 0, 1, 2, 4.
VIEWS["fx_answer0"] = """
SELECT o_orderkey AS record_id, CONCAT('C', CAST(floor(o_orderkey/50) AS BIGINT)) AS case_id, o_orderkey%5+1 AS rep, o_orderkey%10 AS kind,
  o_custkey%5 AS c0, (o_custkey+o_orderkey)%7 AS c1, (o_custkey*3+o_orderkey)%9 AS c2, (o_custkey*7+o_orderkey)%11 AS c3,
  20+o_custkey%13 AS at_risk, 700+o_custkey%50 AS edges FROM orders"""

VIEWS["fx_answer"] = """
SELECT record_id, case_id, rep, kind, c0, c1, c2, c3, at_risk, edges,
  CASE WHEN kind=7 THEN 'free' ELSE 'structured' END AS arm, CASE WHEN kind=8 THEN 'timeout' END AS error,
  CASE WHEN kind=9 THEN 0 ELSE 1 END AS n_tool_calls,
  CONCAT('{"run_id":"r","inputs":{"weather_source":"', CASE WHEN c1%2=0 THEN 'forecast' ELSE 'archive' END, '","n_fronts_detected":', CAST(1+c0%2 AS STRING),
    '},"final_front_class4_pct":62.5,"change_hours":[{"period":0,"cut_off":', CAST(c0 AS STRING), ',"impacted":0},{"period":1,"cut_off":', CAST(c1 AS STRING), ',"impacted":0},{"period":2,"cut_off":', CAST(c2 AS STRING),
    ',"impacted":2},{"period":4,"cut_off":', CAST(c3 AS STRING), ',"impacted":3}],"final_hour":{"period":5,"cut_off":', CAST(c3 AS STRING), ',"at_risk":', CAST(at_risk AS STRING), ',"edges_removed":', CAST(edges AS STRING), '}}') AS payload,
  CASE WHEN kind=1 THEN 'Plain words, no object' WHEN kind=7 THEN CONCAT('Cut off ', CAST(c3 AS STRING), ' of ', CAST(at_risk AS STRING), ' places; 777.5 ha and ', CAST(edges AS STRING), ' roads. This is a longer narrative text that goes on until it has more than one hundred and twenty characters.')
   WHEN kind=4 THEN '{"status":"tool_error","initial_state":[],"critical_transitions":[],"final_state":[],"interpretation":"none","limitations":"none"}'
   ELSE CONCAT('{"status":"ok","initial_state":[{"period":0,"settlements_without_route":', CAST(c0+bump AS STRING), '}],"critical_transitions":[', SUBSTRING(CASE WHEN kind=5 THEN ',{"period":"x","settlements_without_route":1}' ELSE CONCAT(
     CASE WHEN c1>c0 THEN CONCAT(',{"period":1,"settlements_without_route":', CAST(c1+bump AS STRING), '}') ELSE '' END, CASE WHEN c2>c1 THEN CONCAT(',{"period":2,"settlements_without_route":', CAST(c2+bump AS STRING), '}') ELSE '' END,
     CASE WHEN c3>c2 THEN CONCAT(',{"period":4,"settlements_without_route":', CAST(c3+bump AS STRING), '}') ELSE '' END, CASE WHEN kind=3 THEN ',{"period":9,"settlements_without_route":1}' ELSE '' END) END, 2),
     '],"final_state":[{"period":5,"settlements_without_route":', CAST(c3+bump AS STRING), ',"road_segments_removed":', CAST(edges AS STRING), '}],"interpretation":"The situation of ', CAST(at_risk AS STRING), ' places grows and the wind carries the front toward the coast while crews hold the northern road open for everyone."',
     CASE WHEN kind=2 THEN '' ELSE ',"limitations":"Indicative, without suppression; 123.4 km2 is an estimate."' END, '}') END AS reply
FROM (SELECT *, CASE WHEN kind=6 THEN 1 ELSE 0 END AS bump FROM fx_answer0) t"""

# Claim labels and notes of a labelling pass, one record per labelled document.
VIEWS["fx_note"] = """
SELECT doc_id AS uid, CASE doc_id%6 WHEN 0 THEN 'Invented settlement names: Ροβιές, Δαμιά. No crown fire claim.' WHEN 1 THEN 'Omits the uncalibrated caveat; invented road and invented wind.'
  WHEN 2 THEN 'No invented settlement names: Ιστιαία, Λίμνη. Includes uncalibrated note' WHEN 3 THEN 'Claims forecast where the source is archive; place names: Κήρινθος, the coast' WHEN 4 THEN 'OFF-BY-ONE: none. Crown fire wording used' ELSE 'Nothing to report' END AS notes,
  CASE doc_id%3 WHEN 0 THEN 'fires' WHEN 1 THEN 'routes' ELSE 'weather' END AS category FROM labels"""

VIEWS["fx_claim"] = """
SELECT d.doc_id AS uid, CASE (d.doc_id*7+n.n_nationkey)%5 WHEN 0 THEN 'CONTRADICTED' WHEN 1 THEN 'NOT_IN_RESULT' ELSE 'SUPPORTED' END AS label,
  CASE (d.doc_id+n.n_nationkey)%3 WHEN 0 THEN 'wrong field: counts SETTLEMENTS' WHEN 1 THEN 'off by one, wrong hour' ELSE 'weather_source is archive' END AS justification
FROM labels d JOIN nation n ON n.n_nationkey=d.doc_id%25 OR n.n_regionkey=d.doc_id%7"""

# Six-answer judge decisions.
VIEWS["fx_decision"] = """
SELECT doc_id AS record_id, doc_id%11<>0 AS judgeable, doc_id%2=0 AS q1, doc_id%3<>0 AS q2, doc_id%5<>0 AS q3, doc_id%7<>0 AS q4, doc_id%13<>0 AS q5,
  CASE doc_id%4 WHEN 0 THEN 'false' WHEN 1 THEN 'NOT_APPLICABLE' ELSE 'true' END AS q6 FROM labels"""

_NAME = re.compile(r"\bfx_\w+\b")


def needed_views(text: str) -> list[str]:
    """Views a text names, with their own inputs first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for dep in _NAME.findall(VIEWS[name]):
                if dep != name:
                    visit(dep)
            order.append(name)

    for name in _NAME.findall(text):
        visit(name)
    return order


def with_views(text: str) -> str:
    """``text`` with the definitions of the views it names in front."""
    names = needed_views(text)
    if not names:
        return text.strip()
    defs = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = text.strip()
    recursive = ""
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:
        recursive = "RECURSIVE " if m.group(1) else ""
        body = ",\n" + body[m.end():]
    return f"WITH {recursive}{defs}\n{body}"


class Views:
    """Frames of one data folder, by table or view name: ``v("fx_weather")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        names = "|".join(TABLES)
        path = rf"\1 parquet.`{self.sf_dir}/\2.parquet`"
        return self.spark.sql(re.sub(rf"(?i)\b(from|join)\s+({names})\b", path, full))

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        return self.sql(f"SELECT * FROM {name}")
