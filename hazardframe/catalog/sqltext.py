"""SQL texts of the fire-danger rules, for the twins."""

from __future__ import annotations

LE = "[6.5,7.5,9.0,12.8,13.9,13.9,12.4,10.9,9.4,8.0,7.0,6.0]"
LF = "[-1.6,-1.6,-1.6,0.9,3.8,5.8,6.4,5.0,2.4,0.4,-1.6,-1.6]"


def codes_step(source: str, keep: str) -> str:
    """SELECT of next codes f1, p1, d1 from ``source`` (f, p, d, t, h, w, r, m) and ``keep``."""
    return f"""
SELECT {keep}, 59.5*(250.0-mm)/(147.2+mm) AS f1, p0+100.0*k AS p1, d0+0.5*greatest(0.0, v) AS d1 FROM (
 SELECT *, CASE WHEN m2>ed THEN ed+(m2-ed)*pow(10.0,-(0.424*(1-pow(h/100,1.7))+0.0694*sqrt(w)*(1-pow(h/100,8)))*0.581*exp(0.0365*t))
   WHEN m2<ew THEN ew-(ew-m2)*pow(10.0,-(0.424*(1-pow((100-h)/100,1.7))+0.0694*sqrt(w)*(1-pow((100-h)/100,8)))*0.581*exp(0.0365*t))
   ELSE m2 END AS mm,
   CASE WHEN r>1.5 THEN greatest(0.0, 43.43*(5.6348-ln(20.0+exp(5.6348-p/43.43)+1000.0*(0.92*r-1.27)/(48.77+b*(0.92*r-1.27))-20.0))) ELSE p END AS p0,
   CASE WHEN t>-1.1 THEN 1.894*(t+1.1)*(100.0-h)*({LE})[m]*1e-6 ELSE 0 END AS k,
   CASE WHEN r>2.8 THEN greatest(0.0, 400.0*ln(800.0/(800.0*exp(-d/400.0)+3.937*(0.83*r-1.27)))) ELSE d END AS d0,
   CASE WHEN t>-2.8 THEN 0.36*(t+2.8)+({LF})[m] ELSE ({LF})[m] END AS v
 FROM (SELECT *, CASE WHEN r>0.5 THEN least(250.0, mo+42.5*(r-0.5)*exp(-100.0/(251.0-mo))*(1-exp(-6.93/(r-0.5)))
     + CASE WHEN mo>150 THEN 0.0015*(mo-150)*(mo-150)*sqrt(r-0.5) ELSE 0 END) ELSE mo END AS m2,
   0.942*pow(h,0.679)+11.0*exp((h-100)/10)+0.18*(21.1-t)*(1-exp(-0.115*h)) AS ed,
   0.618*pow(h,0.753)+10.0*exp((h-100)/10)+0.18*(21.1-t)*(1-exp(-0.115*h)) AS ew,
   CASE WHEN p<=33 THEN 100.0/(0.5+0.3*p) WHEN p<=65 THEN 14.0-1.3*ln(p) ELSE 6.2*ln(p)-17.2 END AS b
  FROM (SELECT *, 147.2*(101.0-f)/(59.5+f) AS mo FROM ({source}) s0) s1) s2) s3"""


def isi(f: str, w: str) -> str:
    m = f"(147.2*(101.0-{f})/(59.5+{f}))"
    return f"(0.208*exp(0.05039*{w})*91.9*exp(-0.1386*{m})*(1+pow({m},5.31)/4.93e7))"


def bui(p: str, d: str) -> str:
    return (
        f"(CASE WHEN {p}<=0.4*{d} THEN CASE WHEN {p}+0.4*{d}>0 THEN 0.8*{p}*{d}/({p}+0.4*{d}) ELSE 0 END "
        f"ELSE {p}-(1-0.8*{d}/({p}+0.4*{d}))*(0.92+pow(0.0114*{p},1.7)) END)"
    )


def fwi(i: str, b: str) -> str:
    mix = f"(0.1*{i}*CASE WHEN {b}<=80 THEN 0.626*pow({b},0.809)+2.0 ELSE 1000.0/(25.0+108.64*exp(-0.023*{b})) END)"
    return f"(CASE WHEN {mix}>1 THEN exp(2.72*pow(0.434*ln({mix}),0.647)) ELSE {mix} END)"


NOON = """noon AS (SELECT station_id, CAST(ts AS DATE) AS day, temp_c, rh_pct, ws_kmh, r24,
  row_number() OVER (PARTITION BY station_id ORDER BY ts) AS n FROM (
    SELECT *, sum(precip_mm) OVER (PARTITION BY station_id ORDER BY ts ROWS 23 PRECEDING) AS r24 FROM fx_weather) t
  WHERE hour(ts)=10)"""

DAILY = NOON + f""", fold AS (
  SELECT station_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS day, 85.0::DOUBLE AS f, 6.0::DOUBLE AS p, 15.0::DOUBLE AS d
    FROM (SELECT DISTINCT station_id FROM noon) t
  UNION ALL SELECT station_id, n, day, f1, p1, d1 FROM ({codes_step(
    "SELECT noon.station_id, noon.n, noon.day, fold.f, fold.p, fold.d, noon.temp_c AS t, noon.rh_pct AS h, "
    "noon.ws_kmh AS w, noon.r24 AS r, month(noon.day) AS m FROM fold JOIN noon "
    "ON noon.station_id=fold.station_id AND noon.n=fold.n+1", "station_id, n, day")}) z),
daily AS (SELECT station_id, day, round(f,2) AS ffmc, round(p,2) AS dmc, round(d,2) AS dc FROM fold WHERE n>0)"""
