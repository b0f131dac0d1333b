"""Queries of the weather and fire-danger operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.catalog import sqltext as q
from hazardframe.catalog.registry import query
from hazardframe.functions import clock, fireweather as fw, geo
from hazardframe.operators import weather as wx

TS = "strftime(ts, '%Y-%m-%d %H:%M')"


def _ts(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm")


_STEP_IN = "SELECT station_id, ts, 20+rh_pct*0.8 AS f, temp_c*3 AS p, rh_pct*6 AS d, temp_c AS t, rh_pct AS h, ws_kmh AS w, precip_mm AS r, month(ts) AS m FROM fx_weather"
_KEY = f"station_id, {TS} AS hour"


def _step_frame(v):
    return v("fx_weather").select(
        "station_id", _ts().alias("hour"), (20 + F.col("rh_pct") * 0.8).alias("f"), (F.col("temp_c") * 3).alias("p"),
        (F.col("rh_pct") * 6).alias("d"), "temp_c", "rh_pct", "ws_kmh", "precip_mm", F.month("ts").alias("m"),
    )


@query("f1_ffmc", f"SELECT station_id, hour, round(f1,6) AS ffmc FROM ({q.codes_step(_STEP_IN, _KEY)}) z")
def f1(v):
    return _step_frame(v).select("station_id", "hour", F.round(fw.ffmc("f", "temp_c", "rh_pct", "ws_kmh", "precip_mm"), 6).alias("ffmc"))


@query("f2_dmc", f"SELECT station_id, hour, round(p1,6) AS dmc FROM ({q.codes_step(_STEP_IN, _KEY)}) z")
def f2(v):
    return _step_frame(v).select("station_id", "hour", F.round(fw.dmc("p", "temp_c", "rh_pct", "precip_mm", "m"), 6).alias("dmc"))


@query("f3_dc", f"SELECT station_id, hour, round(d1,6) AS dc FROM ({q.codes_step(_STEP_IN, _KEY)}) z")
def f3(v):
    return _step_frame(v).select("station_id", "hour", F.round(fw.dc("d", "temp_c", "precip_mm", "m"), 6).alias("dc"))


@query("f4_isi", f"SELECT station_id, {TS} AS hour, round({q.isi('(20+rh_pct*0.8)', 'ws_kmh')},6) AS isi FROM fx_weather")
def f4(v):
    return _step_frame(v).select("station_id", "hour", F.round(fw.isi("f", "ws_kmh"), 6).alias("isi"))


@query("f5_bui_fwi", f"""SELECT station_id, hour, round(b,6) AS bui, round({q.fwi('i', 'b')},6) AS fwi FROM (
  SELECT station_id, {TS} AS hour, {q.bui('(temp_c*3)', '(rh_pct*6)')} AS b, ws_kmh AS i FROM fx_weather) t""")
def f5(v):
    b = fw.bui("p", "d")
    return _step_frame(v).select("station_id", "hour", F.round(b, 6).alias("bui"), F.round(fw.fwi("ws_kmh", b), 6).alias("fwi"))


@query("f6_bearing", """SELECT det_id, round(b,6) AS bearing, round(abs(((b-200+180)%360+360)%360-180),6) AS diff FROM (
  SELECT det_id, (degrees(atan2(x-9000,y-8000))+360)%360 AS b FROM fx_detection) t""")
def f6(v):
    b = geo.bearing(F.col("x") - 9000, F.col("y") - 8000)
    return v("fx_detection").select("det_id", F.round(b, 6).alias("bearing"), F.round(geo.ang_diff(b, 200), 6).alias("diff"))


@query("f7_wind", f"""SELECT station_id, {TS} AS hour, (wd_from+180)%360 AS blows_to, round(-ws_kmh*sin(radians(wd_from)),6)+0.0 AS u,
  round(-ws_kmh*cos(radians(wd_from)),6)+0.0 AS v, CASE WHEN ws_kmh>0 THEN wd_from END AS back FROM fx_weather""")
def f7(v):
    u, w = geo.wind_u("ws_kmh", "wd_from"), geo.wind_v("ws_kmh", "wd_from")
    back = F.pmod(F.round(geo.wind_from_uv(u, w), 4), F.lit(360.0))
    return v("fx_weather").select(
        "station_id", _ts().alias("hour"), geo.blows_to("wd_from").alias("blows_to"), (F.round(u, 6) + 0.0).alias("u"),
        (F.round(w, 6) + 0.0).alias("v"), F.when(F.col("ws_kmh") > 0, back).alias("back"),
    )


@query("f8_compass", f"""SELECT station_id, {TS} AS hour, (['N','NE','E','SE','S','SW','W','NW'])[CAST(round_even(wd_from/45.0,0) AS BIGINT)%8+1] AS label FROM fx_weather""")
def f8(v):
    return v("fx_weather").select("station_id", _ts().alias("hour"), geo.compass("wd_from").alias("label"))


@query("f9_planar_m", f"""SELECT cell, {TS} AS hour, round(sqrt(pow((lat-38.9)*111320.0,2)+pow((lon-23.3)*111320.0*cos(radians((lat+38.9)/2)),2)),4) AS d FROM fx_wgrid""")
def f9(v):
    return v("fx_wgrid").select("cell", _ts().alias("hour"), F.round(geo.planar_m("lat", "lon", 38.9, 23.3), 4).alias("d"))


@query("f14_local_time", """SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens','%d/%m/%Y %H:%M') AS shown,
  strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS back FROM events""")
def f14(v):
    e = v("events").withColumn("t", F.col("ts").cast("timestamp"))
    local = F.date_format(F.from_utc_timestamp("t", clock.LOCAL_ZONE), "yyyy-MM-dd'T'HH:mm")
    return e.select("event_id", clock.fmt_local("t").alias("shown"), _ts(clock.to_utc(local, "t")).alias("back"))


@query("f15_period_ts", """SELECT o_orderkey, strftime(o_orderdate + (o_orderkey%48) * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS stamp,
  CASE WHEN CAST(o_orderdate AS DATE)+3<=DATE '1997-01-01' THEN 'archive' WHEN CAST(o_orderdate AS DATE)>DATE '1997-01-01' THEN 'forecast'
    ELSE 'archive+forecast' END AS source FROM orders""")
def f15(v):
    o = v("orders")
    cutoff = clock.archive_cutoff(F.lit("1997-01-07"))
    d0 = F.to_date("o_orderdate")
    return o.select(
        "o_orderkey", _ts(clock.period_ts(F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 48)).alias("stamp"),
        clock.weather_source(d0, clock.shift_date(d0, 3), cutoff).alias("source"),
    )


@query("f16_run_mode", """SELECT o_orderkey, CASE WHEN o_orderstatus='P' THEN 'scenario' WHEN o_orderkey%3>=2 THEN 'multi_front'
  WHEN o_custkey%3>=2 THEN 'front' ELSE 'point_ignition' END AS mode FROM orders""")
def f16(v):
    return v("orders").select("o_orderkey", clock.run_mode(
        F.when(F.col("o_orderstatus") == "P", "named"), F.col("o_orderkey") % 3, F.col("o_custkey") % 3).alias("mode"))


@query("f17_reproject")
def f17(v):
    s = v("fx_settlement").select("settlement_id", (F.col("x") + 480000).alias("x"), (F.col("y") + 4290000).alias("y"))
    out = geo.to_2100(geo.to_4326(s), x="x2", y="y2")
    return out.select("settlement_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("x2", 2).alias("x"), F.round("y2", 2).alias("y"))


@query("f50_request_grid", """SELECT s_suppkey, round(38+s_suppkey*0.001+i*0.05,6)::DOUBLE AS lat, round(23+j*0.1,6)::DOUBLE AS lon
  FROM supplier, (SELECT unnest([0,1,2]) AS i) a, (SELECT unnest([0,1,2,3,4]) AS j) b""")
def f50(v):
    box = v("supplier").select("s_suppkey", (38 + F.col("s_suppkey") * 0.001).alias("lat0"), (38.1 + F.col("s_suppkey") * 0.001).alias("lat1"),
                               F.lit(23.0).alias("lon0"), F.lit(23.4).alias("lon1"))
    return wx.request_grid(box, 5, 3).select("s_suppkey", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("p4_slice_hours", f"SELECT station_id, {TS} AS hour, temp_c FROM fx_weather WHERE ts BETWEEN TIMESTAMP '1997-01-01 00:00' AND TIMESTAMP '1997-06-01 10:00'")
def p4(v):
    return wx.slice_hours(v("fx_weather"), "1997-01-01 00:00:00", "1997-06-01 10:00:00").select("station_id", _ts().alias("hour"), "temp_c")


@query("p5_take_horizon", f"""SELECT station_id, {TS} AS hour, temp_c FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts) AS n
  FROM fx_weather WHERE ts>=TIMESTAMP '1998-01-01') t WHERE n<=24""")
def p5(v):
    return wx.take_horizon(v("fx_weather"), "1998-01-01 00:00:00", 24).select("station_id", _ts().alias("hour"), "temp_c")


@query("w1_rain24", f"""SELECT station_id, {TS} AS hour, round(sum(coalesce(precip_mm,0)) OVER (PARTITION BY station_id ORDER BY ts ROWS 23 PRECEDING),4) AS rain24 FROM fx_weather""")
def w1(v):
    return wx.rain24(v("fx_weather")).select("station_id", _ts().alias("hour"), F.round("rain24", 4).alias("rain24"))


@query("w2_find_gaps", f"""SELECT station_id, strftime(p,'%Y-%m-%d %H:%M') AS prev, {TS} AS hour, CAST(date_diff('second',p,ts) AS BIGINT) AS gap_s FROM (
  SELECT station_id, ts, lag(ts) OVER (PARTITION BY station_id ORDER BY ts) AS p FROM fx_weather) t WHERE date_diff('second',p,ts)<>3600""")
def w2(v):
    return wx.find_gaps(v("fx_weather")).select("station_id", _ts("prev_ts").alias("prev"), _ts().alias("hour"), "gap_s")


@query("w3_daily_codes", f"WITH RECURSIVE {q.DAILY} SELECT station_id, strftime(day,'%Y-%m-%d') AS day, ffmc, dmc, dc FROM daily")
def w3(v):
    return wx.daily_codes(v("fx_weather")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_ASOF = """codes AS (SELECT h.station_id, h.ts, h.temp_c, h.rh_pct, h.ws_kmh, h.wd_from, h.precip_mm,
  coalesce(d.ffmc,85.0) AS ffmc, coalesce(d.dmc,6.0) AS dmc, coalesce(d.dc,15.0) AS dc
  FROM fx_weather h ASOF LEFT JOIN daily d ON h.station_id=d.station_id AND CAST(h.ts AS DATE)>=d.day)"""


@query("j13_asof_codes", f"WITH RECURSIVE {q.DAILY}, {_ASOF} SELECT station_id, {TS} AS hour, ffmc, dmc, dc FROM codes")
def j13(v):
    h = v("fx_weather")
    return wx.asof_codes(h, wx.daily_codes(h)).select("station_id", _ts().alias("hour"), "ffmc", "dmc", "dc")


_FWX = f"""WITH RECURSIVE {q.DAILY}, {_ASOF}, fwx AS (SELECT station_id, {TS} AS hour, round(precip_mm,2) AS apcp, temp_c AS tmp, rh_pct AS rh, round(ws_kmh,1) AS ws,
  CAST(round_even(wd_from,0) AS BIGINT) AS wd, ffmc, dmc, dc, round(i,2) AS isi, round(b,2) AS bui, round({q.fwi('i', 'b')},2) AS fwi FROM (
  SELECT *, {q.isi('ffmc', 'ws_kmh')} AS i, {q.bui('dmc', 'dc')} AS b FROM codes) t)"""


@query("r9_fire_weather", f"{_FWX} SELECT * FROM fwx")
def r9(v):
    h = v("fx_weather")
    return wx.fire_weather(h, wx.daily_codes(h)).withColumn("ts", _ts()).withColumnRenamed("ts", "hour")


@query("a48_instance_stats", f"""{_FWX} SELECT min(ws) AS ws_min, max(ws) AS ws_max, min(isi) AS isi_min, max(isi) AS isi_max, count(*) AS hours FROM fwx""")
def a48(v):
    h = v("fx_weather")
    return wx.instance_stats(wx.fire_weather(h, wx.daily_codes(h)))


@query("w14_stitch", f"""SELECT station_id, {TS} AS hour, CASE WHEN precip_mm=0 THEN temp_c ELSE temp_c+1 END AS temp_c FROM fx_weather""")
def w14(v):
    h = v("fx_weather").select("station_id", "ts", "temp_c", "precip_mm")
    out = wx.stitch(h.filter("precip_mm = 0"), h.withColumn("temp_c", F.col("temp_c") + 1))
    return out.select("station_id", _ts().alias("hour"), "temp_c")


@query("w15_dedupe_cells", """SELECT cell_lat, cell_lon, min(event_id) AS request_id FROM (
  SELECT event_id, round(38.5::DOUBLE+(user_id%20)*0.0003::DOUBLE,3) AS cell_lat, round(23.0::DOUBLE+(user_id%7)*0.0004::DOUBLE,3) AS cell_lon FROM events) t GROUP BY 1,2""")
def w15(v):
    g = v("events").select(F.col("event_id").alias("request_id"), (38.5 + (F.col("user_id") % 20) * 0.0003).alias("lat"),
                           (23.0 + (F.col("user_id") % 7) * 0.0004).alias("lon"))
    return wx.dedupe_cells(g).select("cell_lat", "cell_lon", "request_id")


@query("r7_idw", f"""WITH g AS (SELECT *, sqrt(pow((lat-38.62)*111320.0,2)+pow((lon-23.17)*111320.0*cos(radians(38.62)),2)) AS d FROM fx_wgrid),
s AS (SELECT ts, sum(1/(d*d)) AS w, sum(-ws_kmh*sin(radians(wd_from))/(d*d)) AS u, sum(-ws_kmh*cos(radians(wd_from))/(d*d)) AS v,
   sum(temp_c/(d*d)) AS t, sum(coalesce(rh_pct,0)/(d*d)) AS h, sum(precip_mm/(d*d)) AS p FROM g WHERE ws_kmh IS NOT NULL GROUP BY ts)
SELECT {TS} AS hour, round(sqrt(u*u+v*v)/w,4) AS ws_kmh, round((degrees(atan2(-u,-v))+360)%360,3) AS wd_from, round(t/w,4) AS temp_c,
  round(h/w,4) AS rh_pct, round(p/w,4) AS precip_mm FROM s
UNION ALL SELECT {TS}, NULL, round(arg_min(wd_from,cell),3), round(arg_min(temp_c,cell),4), round(arg_min(rh_pct,cell),4), round(arg_min(precip_mm,cell),4)
  FROM g WHERE ts NOT IN (SELECT ts FROM s) GROUP BY ts""")
def r7(v):
    out = wx.idw(v("fx_wgrid"), 38.62, 23.17)
    return out.select(_ts().alias("hour"), F.round("ws_kmh", 4).alias("ws_kmh"), F.round("wd_from", 3).alias("wd_from"),
                      *[F.round(c, 4).alias(c) for c in ("temp_c", "rh_pct", "precip_mm")])


@query("r8_wind_arrows", f"""SELECT cell, {TS} AS hour, round((wd_from+180)%360,1) AS blows_to,
  round(lon+coalesce(ws_kmh,0)*40*sin(radians((wd_from+180)%360))/(111320.0*cos(radians(lat))),6) AS end_lon,
  round(lat+coalesce(ws_kmh,0)*40*cos(radians((wd_from+180)%360))/111320.0,6) AS end_lat FROM fx_wgrid""")
def r8(v):
    return wx.wind_arrows(v("fx_wgrid")).select("cell", _ts().alias("hour"), "blows_to", F.round("end_lon", 6).alias("end_lon"), F.round("end_lat", 6).alias("end_lat"))


@query("r10_implied_wind", """SELECT round((b+180)%360,6) AS wd_from, round(b,6) AS blows_to FROM (
  SELECT (degrees(atan2(avg(x)-9000,avg(y)-8000))+360)%360 AS b FROM fx_detection WHERE t BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04') z""")
def r10(v):
    out = wx.implied_wind(v("fx_detection"), 9000, 8000, "2024-01-02 00:00:00", 48)
    return out.select(F.round("wd_from", 6).alias("wd_from"), F.round("blows_to", 6).alias("blows_to"))
