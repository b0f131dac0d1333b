"""Queries of sources, sinks and stream forms: round trips of tables Spark derives."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.catalog import q_network
from hazardframe.catalog import sqltext as q
from hazardframe.catalog.q_cells import RUN_GRID
from hazardframe.catalog.q_network import GRID, OUTCOME, _fire, run
from hazardframe.catalog.registry import query
from hazardframe.operators.common import materialise, scratch_path
from hazardframe.plans import exports as ex
from hazardframe.plans.evacuate import evacuate
from hazardframe.sources import readers as rd
from hazardframe.sources import writers as wr
from hazardframe.streaming import feeds

_GRIDSQL = "SELECT g.r, g.c, coalesce(b.arrival,-9999)::DOUBLE AS value FROM (SELECT r, unnest(generate_series(0,88)) AS c FROM (SELECT unnest(generate_series(0,96)) AS r) z) g LEFT JOIN fx_burn b ON b.r=g.r AND b.c=g.c"


@query("s1_read_asc", _GRIDSQL)
def s1(v):
    p = scratch_path(v.spark, "asc")
    wr.write_asc(v("fx_burn").withColumnRenamed("arrival", "value"), GRID, p, "%d")
    return rd.read_asc(v.spark, p)[0].drop("file")


@query("k1_write_asc", "SELECT run_id, count(*) AS n_lines FROM (SELECT DISTINCT run_id FROM fx_arrival) a, (SELECT unnest(generate_series(1,126)) AS k) z GROUP BY 1")
def k1(v):
    p = scratch_path(v.spark, "asc-runs")
    wr.write_asc(v("fx_arrival").withColumnRenamed("arrival", "value"), RUN_GRID, p, "%d", keys=["run_id"])
    return v.spark.read.option("basePath", p).text(p).groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.count("*").alias("n_lines"))


def _series(v, name: str, value: str):
    root = scratch_path(v.spark, name)
    for period in range(7):
        g = v("fx_burn").withColumn("value", F.expr(f"CASE WHEN arrival <= {period} THEN {value} ELSE 0 END"))
        rows = wr.asc_lines(g.select("r", "c", "value"), GRID, "%d", 0).filter("ord >= 6")
        rows.coalesce(1).sortWithinPartitions("ord").select(F.regexp_replace("value", " ", ",").alias("value")).write.text(f"{root}/{name}{period:02d}.csv")
    return f"{root}/*/part-*"


@query("s2_read_burn_series", "SELECT r, c, arrival FROM fx_burn")
def s2(v):
    return rd.arrivals(rd.read_burn_series(v.spark, _series(v, "ForestGrid", "1"))).drop("run")


@query("s3_read_intensity_series", "SELECT period, r, c, ((r*131+c*17)%5000+1)::DOUBLE AS fi FROM fx_burn, (SELECT unnest([0,1,2,3,4,5,6]::BIGINT[]) AS period) h WHERE arrival<=period")
def s3(v):
    return rd.read_intensity_series(v.spark, _series(v, "Intensity", "(r*131+c*17)%5000+1")).drop("run")


@query("s4_read_messages", "SELECT l_orderkey AS source, l_partkey AS target, l_linenumber::BIGINT AS period, l_quantity AS ros FROM lineitem WHERE l_linenumber<>3")
def s4(v):
    p = scratch_path(v.spark, "messages")
    l = v("lineitem")
    l.select("l_orderkey", F.when(F.col("l_linenumber") == 3, "bad").otherwise(F.col("l_partkey").cast("string")), "l_linenumber", "l_quantity").write.csv(p)
    return rd.read_messages(v.spark, p)


@query("s5_read_hourly_weather", "SELECT station_id::DOUBLE AS lat, strftime(ts,'%Y-%m-%d %H:%M') AS hour, ws_kmh, temp_c, 0.0::DOUBLE AS precip_mm FROM fx_weather")
def s5(v):
    p = scratch_path(v.spark, "weather")
    row = F.struct("ts", "ws_kmh", "wd_from", "temp_c", "rh_pct")
    w = v("fx_weather").groupBy("station_id").agg(F.sort_array(F.collect_list(row)).alias("s"))
    arr = lambda c: F.transform("s", lambda x: x[c])
    hourly = F.struct(F.transform("s", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm")).alias("time"), arr("ws_kmh").alias("wind_speed_10m"), arr("wd_from").alias("wind_direction_10m"),
                      arr("temp_c").alias("temperature_2m"), arr("rh_pct").alias("relative_humidity_2m"))
    w.select(F.col("station_id").cast("double").alias("latitude"), F.lit(23.0).alias("longitude"), hourly.alias("hourly")).write.json(p)
    return rd.read_hourly_weather(v.spark, p, multi_line=False).select("lat", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("hour"), "ws_kmh", "temp_c", "precip_mm")


@query("s6_read_features", "SELECT settlement_id, name, x, y FROM fx_settlement")
def s6(v):
    p = scratch_path(v.spark, "features")
    wr.write_geojson(wr.geojson_features(v("fx_settlement").select("settlement_id", "name", "x", "y"), "x", "y"), p)
    f = rd.read_features(v.spark, p, "type = 'Point'")
    return f.select(F.col("properties")["settlement_id"].cast("long").alias("settlement_id"), F.col("properties")["name"].alias("name"), "x", "y")


@query("k3_write_geojson", "SELECT count(*) AS n FROM fx_wgrid")
def k3(v):
    from hazardframe.operators.weather import wind_arrows
    a = wind_arrows(v("fx_wgrid")).select("cell", "ts", "ws_kmh", "lon", "lat", "end_lon", "end_lat")
    p = scratch_path(v.spark, "arrows")
    wr.write_geojson(wr.line_features(a, [("lon", "lat"), ("end_lon", "end_lat")]), p)
    return rd.read_features(v.spark, p, "type = 'LineString'").agg(F.count("*").alias("n"))


#: Nodes and edges of one GraphML file.
GRAPHML_ROWS = 100_000


@query("s7_read_graphml", "SELECT u, v, key, length_m::DOUBLE AS length FROM fx_edge")
def s7(v):
    p = scratch_path(v.spark, "graphml")
    keys = "".join(f'<key id="{i}" for="{of}" attr.name="{n}" attr.type="string"/>' for i, (of, n) in enumerate((("node", "x"), ("node", "y"), ("edge", "length"), ("edge", "highway"))))
    node = v("fx_node").select(F.lit(1).alias("ord"), F.format_string('<node id="%d"><data key="0">%s</data><data key="1">%s</data></node>', "node_id", F.col("x").cast("string"), F.col("y").cast("string")).alias("value"))
    edge = v("fx_edge").select(F.lit(2).alias("ord"), F.format_string('<edge source="%d" target="%d" id="%d"><data key="2">%s</data><data key="3">[\'primary\', \'residential\']</data></edge>', "u", "v", "key", F.col("length_m").cast("string")).alias("value"))
    rows = materialise(node.union(edge), "graphml-rows")
    files = -(-rows.count() // GRAPHML_ROWS)  # each a document of its own, since one task parses a file
    rows = rows.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(files)))
    ends = v.spark.range(2 * files).select((F.col("id") % 2 * 3).cast("int").alias("ord"), F.when(F.col("id") % 2 == 0, f"<graphml>{keys}<graph>").otherwise("</graph></graphml>").alias("value"), F.floor(F.col("id") / 2).alias("part"))
    ends.union(rows).repartition(files, "part").sortWithinPartitions("part", "ord").select("part", "value").write.partitionBy("part").text(p)
    return rd.read_graphml(v.spark, p)[1].select("u", "v", "key", "length")


@query("s8_read_jsonl_runs", "SELECT record_id, kind, payload FROM fx_answer")
def s8(v):
    p = scratch_path(v.spark, "jsonl")
    v("fx_answer").select("record_id", "kind", "payload").write.json(p)
    return rd.read_jsonl_runs(v.spark, p, "record_id bigint, kind bigint, payload string").drop("file")


@query("s9_read_records", "SELECT record_id::VARCHAR AS record_id, model, CASE WHEN arm='structured' THEN category END AS category FROM fx_record")
def s9(v):
    a, b = scratch_path(v.spark, "rec-a"), scratch_path(v.spark, "rec-b")
    r = v("fx_record")
    wr.write_records(r.filter("arm='free'").select("record_id", "model"), a)
    wr.write_records(r.filter("arm='structured'").select("record_id", "model", "category"), b)
    return rd.read_records(v.spark, [a, b]).select("record_id", "model", "category")


@query("s10_read_decisions", "SELECT record_id::VARCHAR AS record_id, q1 FROM fx_decision")
def s10(v):
    p = scratch_path(v.spark, "decisions")
    d = F.struct(F.col("record_id").cast("string").alias("record_id"), "q1")
    b = v("fx_decision").groupBy(F.pmod(F.col("record_id"), F.lit(3)).alias("k"), F.floor(F.col("record_id") / 30).alias("g")).agg(F.to_json(F.collect_list(d)).alias("j"))
    shape = F.when(F.col("k") == 0, F.concat(F.lit('{"decisions":'), "j", F.lit("}"))).when(F.col("k") == 1, F.concat(F.lit('{"b1":{"result":{"decisions":'), "j", F.lit("}}}"))).otherwise(F.concat(F.lit('{"R1":{"decisions":'), "j", F.lit("}}")))
    b.repartition(1000, "k", "g").select(shape.alias("value")).write.option("maxRecordsPerFile", 1).text(p, lineSep="\n")
    return rd.read_decisions(v.spark, p).select("record_id", F.try_variant_get("d", "$.q1", "boolean").alias("q1"))


@query("s11_list_runs", """WITH f AS (SELECT 'run_id='||run_id AS run_id, bool_or(arrival=7) AS done FROM fx_arrival WHERE r>=70 GROUP BY 1) SELECT run_id, run_id=(SELECT max(run_id) FROM f WHERE done) AS newest FROM f WHERE done""")
def s11(v):
    root = scratch_path(v.spark, "runs")
    c = v("fx_arrival").filter("r >= 70").groupBy("run_id", F.when(F.col("arrival") == 7, "final").otherwise("early").alias("layer")).agg(F.count("*").alias("n"))
    c.unionByName(c.select("run_id", F.lit("summary").alias("layer"), "n")).repartition(8, "run_id").write.partitionBy("run_id", "layer").parquet(root)
    return rd.list_runs(v.spark, root, ["layer=final", "layer=summary"])


@query("s12_read_batches", "SELECT uid, notes FROM fx_note")
def s12(v):
    p = scratch_path(v.spark, "batches")
    v("fx_note").groupBy(F.floor(F.col("uid") / 12)).agg(F.to_json(F.collect_list(F.struct("uid", "notes"))).alias("value")).select("value").repartition(8).write.option("maxRecordsPerFile", 1).text(p)
    return rd.read_batches(v.spark, p, "uid bigint, notes string")


@query("s13_read_key_map", "SELECT 'D'||record_id AS decision_id, model AS run_id, record_id::VARCHAR AS uid FROM fx_record WHERE arm='free'")
def s13(v):
    p = scratch_path(v.spark, "keys") + ".csv"
    v("fx_record").filter("arm='free'").select(F.concat(F.lit("D"), F.col("record_id").cast("string")).alias("decision_id"), F.col("model").alias("run_id"), F.col("record_id").alias("uid")).write.option("header", True).csv(p)
    return rd.read_key_map(v.spark, p)


@query("s15_read_run", "SELECT period, count(*) AS n FROM (SELECT arrival AS period FROM fx_arrival WHERE run_id=3) t GROUP BY 1")
def s15(v):
    root = scratch_path(v.spark, "layers")
    wr.write_run({"cells": v("fx_arrival").withColumnRenamed("arrival", "period")}, root)
    cells = rd.read_run(v.spark, root, 3, "cells", "r bigint, c bigint, period bigint, run_id bigint")
    return cells.groupBy("period").agg(F.count("*").alias("n"))


@query("k4_write_run", "SELECT run_id, arrival AS period, count(*) AS n FROM fx_arrival GROUP BY 1,2")
def k4(v):
    root = scratch_path(v.spark, "layers")
    wr.write_run({"cells": v("fx_arrival").withColumnRenamed("arrival", "period")}, root)
    t = v.spark.read.parquet(f"{root}/cells")
    return t.groupBy(F.col("run_id").cast("long").alias("run_id"), F.col("period").cast("long").alias("period")).agg(F.count("*").alias("n"))


@query("k5_write_atomic", "SELECT doc_id, quality, toxic FROM labels")
def k5(v):
    p = scratch_path(v.spark, "atomic")
    wr.write_atomic(v("labels").limit(0), p)
    wr.write_atomic(v("labels"), p)
    return v.spark.read.parquet(p)


@query("k7_write_records", "SELECT record_id::VARCHAR AS record_id, '1,'||rep AS hours FROM (SELECT record_id, CAST(rep AS BIGINT) AS rep FROM fx_record) t")
def k7(v):
    p = scratch_path(v.spark, "records")
    wr.write_records(v("fx_record").select("record_id", F.array(F.lit(1), F.col("rep").cast("long")).alias("hours")), p)
    return v.spark.read.option("header", True).csv(p)


@query("k11_manifest", "SELECT 'r1' AS run_id, count(*) AS n_cases FROM fx_answer")
def k11(v):
    c = v("fx_answer").select(F.col("record_id").alias("case_id"), F.col("payload").alias("body"))
    p = scratch_path(v.spark, "manifest")
    wr.write_manifest(wr.manifest(c, {"run_id": "r1"}), p)
    return v.spark.read.json(p).select("run_id", "n_cases")


@query("j23_diff_trees", "SELECT page_id::VARCHAR AS path, CASE WHEN page_id%5=0 THEN 'removed' WHEN page_id%7=0 THEN 'changed' END AS change FROM pages WHERE page_id%5=0 OR page_id%7=0")
def j23(v):
    p = v("pages").select(F.col("page_id").cast("string").alias("path"), F.sha2("html", 256).alias("sha"), "page_id")
    after = p.filter("page_id % 5 <> 0").withColumn("sha", F.when(F.col("page_id") % 7 == 0, F.lit("x")).otherwise(F.col("sha")))
    return wr.diff_trees(p, after)


@query("r21_build_exports", "SELECT u, v, key, length_m FROM fx_edge")
def r21(v):
    out = ex.build_exports(_fire(v), run(v), v("fx_settlement"), v("fx_edge"), GRID, ["run_id"])
    return out["roads"].select("u", "v", "key", "length_m")


@query("r22_run_overlay", "SELECT r, c, arrival FROM fx_arrival WHERE run_id=2")
def r22(v):
    return ex.run_overlay({"cells": v("fx_arrival")}, 2)["cells"].select("r", "c", "arrival")


def _stream(v, df, label: str, parts: int = 3):
    """A file stream over a table Spark has written."""
    p = scratch_path(v.spark, label)
    df.repartition(parts).write.parquet(p)
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(p)


def _finish(v, writer, label: str):
    running = writer.option("checkpointLocation", scratch_path(v.spark, f"{label}-state")).trigger(availableNow=True).start()
    running.awaitTermination()


@query("st5_stream_rates", "SELECT arm, count(*) AS reps, count(*) FILTER (stage_a_ok) AS passed FROM fx_eval GROUP BY 1")
def st5(v):
    s = _stream(v, v("fx_eval").select("arm", "stage_a_ok"), "rates-in")
    _finish(v, feeds.stream_rates(s, "stage_a_ok", ["arm"]).writeStream.outputMode("complete").format("memory").queryName("hf_rates"), "rates")
    return v.spark.table("hf_rates")


@query("st1_stream_codes", f"WITH RECURSIVE {q.DAILY} SELECT station_id, strftime(day,'%Y-%m-%d') AS day, ffmc, dmc, dc FROM daily")
def st1(v):
    """Hours in four batches that overlap in time, each shuffled; every third row comes twice."""
    w = v("fx_weather").select(F.col("station_id").cast("long").alias("station_id"), F.col("ts").cast("timestamp").alias("ts"), "precip_mm", "temp_c", "rh_pct", "ws_kmh")
    span = w.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step, p = (span.b - span.a) / 4, scratch_path(v.spark, "codes-in")
    jitter = F.pmod(F.xxhash64("station_id", "ts"), F.lit(86400)).cast("long")  # up to a day early
    near = (F.col("ts").cast("long") - jitter).cast("timestamp")
    for i in range(4):
        part = w.filter(near >= F.lit(span.a + i * step)) if i else w
        part = part.filter(near < F.lit(span.a + (i + 1) * step)) if i < 3 else part
        part = part.unionByName(part.filter("station_id % 3 = 0"))
        part.orderBy(F.xxhash64("ts", "station_id")).coalesce(1).write.mode("append").parquet(p)
    # A row of no station, later than all, moves the watermark past the last real one.
    close = w.agg(F.lit(-1).cast("long").alias("station_id"), (F.max("ts") + F.expr("INTERVAL 30 DAY")).alias("ts"))
    close.select("*", *[F.lit(None).cast("double").alias(c) for c in ("precip_mm", "temp_c", "rh_pct", "ws_kmh")]).write.mode("append").parquet(p)
    s = v.spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(p)
    out, store = scratch_path(v.spark, "codes"), "spark.sql.streaming.stateStore.providerClass"
    before = v.spark.conf.get(store)
    v.spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _finish(v, feeds.stream_codes(s).writeStream.outputMode("append").format("parquet").option("path", out), "codes")
    finally:
        v.spark.conf.set(store, before)
    got = v.spark.read.schema("station_id long, day date, ffmc double, dmc double, dc double").parquet(out)
    return got.select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "ffmc", "dmc", "dc")


@query("st3_stream_gaps")
def st3(v):
    w = v("fx_hourly").select(F.lit(0).alias("station_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = scratch_path(v.spark, "gaps")
    _finish(v, feeds.stream_gaps(_stream(v, w, "gaps-in", 1)).writeStream.outputMode("append").format("parquet").option("path", out), "gaps")
    return v.spark.read.schema("station_id int, day date, n_hours bigint").parquet(out)


_PS = """WITH RECURSIVE tm AS (SELECT DISTINCT t FROM fx_det), ps(t, p) AS (SELECT min(t), min(t) FROM tm UNION ALL SELECT n.t, CASE WHEN n.t-ps.p>INTERVAL 20 MINUTE THEN n.t ELSE ps.p END FROM ps, LATERAL (SELECT min(t) AS t FROM tm WHERE tm.t>ps.t) n WHERE n.t IS NOT NULL)
SELECT det_id, strftime(p,'%Y-%m-%d %H:%M') AS pass_t FROM fx_det d JOIN ps ON ps.t=d.t"""


@query("st2_stream_passes", _PS)
def st2(v):
    d = v("fx_det").select(F.lit(0).cast("long").alias("fire_id"), "det_id", F.col("t").cast("timestamp").alias("t"))
    p = scratch_path(v.spark, "passes-in")
    d.repartition(1).write.parquet(p)
    # A later detection moves the watermark past the last real one.
    close = d.agg(F.min("fire_id").alias("fire_id"), F.lit(-1).cast("long").alias("det_id"), (F.max("t") + F.expr("INTERVAL 1 DAY")).alias("t"))
    close.coalesce(1).write.mode("append").parquet(p)
    s = v.spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(p)
    out = scratch_path(v.spark, "passes")
    _finish(v, feeds.stream_passes(s).writeStream.outputMode("append").format("parquet").option("path", out), "passes")
    got = v.spark.read.schema(feeds.PASS_SCHEMA).parquet(out).filter("det_id >= 0")
    return got.select("det_id", F.date_format(F.timestamp_seconds("pass_s"), "yyyy-MM-dd HH:mm").alias("pass_t"))


@query("st4_stream_evacuate", f"WITH RECURSIVE {OUTCOME} SELECT period, fire_km2, at_risk, population, routed, cut_off, impacted, edges_removed, longest_route_km FROM summ")
def st4(v):
    """The fire arrives in three batches by hour, the last two overlapping; every hour's evacuation is kept up to date."""
    fire, root, p = _fire(v), scratch_path(v.spark, "evac"), scratch_path(v.spark, "evac-in")
    for a, b in ((0, 2), (3, 4), (4, 99)):
        fire.filter(F.col("arrival").between(a, b)).coalesce(1).write.mode("append").parquet(p)
    tables = [materialise(v(t), t) for t in ("fx_gridcell", "fx_node", "fx_edge", "fx_settlement", "fx_refuge")]
    cells, nodes, edges, settlements, refuges = tables

    def solve(arrived, since, before):
        e = evacuate(arrived, q_network._width(cells), GRID, nodes, edges, settlements, refuges, q_network.KEY, None, since, before)
        return e.routes, e.outcome, e.summary

    s = v.spark.readStream.schema(fire.schema).option("maxFilesPerTrigger", 1).parquet(p)
    _finish(v, feeds.stream_evacuate(s, solve, root), "evac")
    t = v.spark.read.parquet(f"{root}/summary")
    return t.select(F.col("period").cast("long").alias("period"), "fire_km2", "at_risk", "population", "routed", "cut_off", "impacted", "edges_removed", "longest_route_km")
