"""Queries of instance preparation and the remaining sinks and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.catalog.q_network import GRID
from hazardframe.catalog.registry import query
from hazardframe.operators.common import scratch_path
from hazardframe.plans import instance as ins
from hazardframe.sources import readers as rd
from hazardframe.sources import writers as wr


@query("r2_polygon_seed_points", "SELECT s_suppkey AS polygon_id, CAST(floor(4*s/300)+pow(ceil((s-150)/300),2) AS BIGINT) AS n, round(s*s/1e6,3) AS area_km2 FROM (SELECT s_suppkey, (1037+(s_suppkey%7)*100)::DOUBLE AS s FROM supplier) t")
def r2(v):
    s = v("supplier").select(F.col("s_suppkey").alias("polygon_id"), (1037 + (F.col("s_suppkey") % 7) * 100).cast("double").alias("s"))
    half = F.col("s") / 2 / 111320.0
    wide = half / F.cos(F.radians(F.lit(38.5)))
    corners = [(-1, -1), (-1, 1), (1, 1), (1, -1)]
    arr = F.array(*[F.struct(F.lit(i).alias("idx"), (F.lit(38.5) + a * half).alias("lat"), (F.lit(23.2) + b * wide).alias("lon")) for i, (a, b) in enumerate(corners)])
    out = ins.polygon_seed_points(s.select("polygon_id", F.explode(arr).alias("c")).select("polygon_id", "c.*"))
    return out.groupBy("polygon_id").agg(F.count("*").alias("n"), F.round(F.first("area_km2"), 3).alias("area_km2"))


@query("r11_build_grids", """SELECT r, c, CASE WHEN (r*5+c*11)%60=59 THEN 0.0::DOUBLE ELSE (r*5+c*11)%60 END AS slope, (100+3*r+(c*c)%50)::DOUBLE AS elevation, CASE (r*7+c*3)%5 WHEN 0 THEN 101 WHEN 1 THEN 7 WHEN 3 THEN 13 ELSE 0 END AS code, (r*7+c*3)%5 IN (0,1,3) AS burnable
  FROM fx_gridcell WHERE r BETWEEN 10 AND 59 AND c BETWEEN 5 AND 69""")
def r11(v):
    g = v("fx_gridcell")
    layer = lambda e: g.withColumn("value", F.expr(e))
    codes = v.spark.createDataFrame([(0, 101), (1, 7), (3, 13)], "value bigint, code int")
    out = ins.build_grids(layer("CASE WHEN (r*5+c*11)%60=59 THEN -9999D ELSE CAST((r*5+c*11)%60 AS DOUBLE) END"), layer("CAST(100+3*r+(c*c)%50 AS DOUBLE)"), layer("(r*7+c*3)%5"), codes, (10, 60, 5, 70), GRID, GRID, -9999.0, 0)
    return out.select("r", "c", "slope", "elevation", "code", "burnable")


@query("k2_write_instance", "SELECT DISTINCT r*89+c+1 AS ncell FROM fx_burn WHERE arrival=0")
def k2(v):
    p = scratch_path(v.spark, "instance")
    wr.write_instance({"InitialBurned": v("fx_burn").filter("arrival = 0").select((F.col("r") * 89 + F.col("c") + 1).alias("Ncell")).distinct()}, p)
    return v.spark.read.schema("ncell bigint").option("header", True).option("enforceSchema", True).csv(f"{p}/InitialBurned")


@query("k6_guard_output", "SELECT doc_id FROM labels")
def k6(v):
    p = scratch_path(v.spark, "guarded")
    v("labels").select("doc_id").write.parquet(wr.guard_output(v.spark, p))
    try:
        wr.guard_output(v.spark, p)
        raise AssertionError("a filled folder was not refused")
    except FileExistsError:
        return v.spark.read.parquet(wr.guard_output(v.spark, p, "resume"))


@query("k9_validation_layers", "SELECT det_id, x, y FROM fx_det")
def k9(v):
    p = scratch_path(v.spark, "layers")
    wr.write_validation_layers({"detections": v("fx_det").select("det_id", "x", "y")}, p)
    f = rd.read_features(v.spark, f"{p}/detections")
    return f.select(F.col("properties")["det_id"].cast("long").alias("det_id"), "x", "y")


@query("k10_publish", "SELECT refuge_id, x, y FROM fx_refuge")
def k10(v):
    p = scratch_path(v.spark, "shared")
    wr.publish({"refuges": v("fx_refuge").select("refuge_id", "x", "y")}, ["refuges"], p)
    wr.publish({"refuges": v("fx_refuge").select("refuge_id", "x", "y").limit(0)}, ["refuges"], p)
    return v.spark.read.parquet(f"{p}/refuges")


@query("k12_write_params", "SELECT count(*) AS n_cells FROM fx_burn")
def k12(v):
    p = scratch_path(v.spark, "params")
    wr.write_params(v("fx_burn").agg(F.count("*").alias("n_cells"), F.lit("/abs/path").alias("source")), p)
    return v.spark.read.json(p).select("n_cells")


@query("s14_fuel_lookup", "SELECT p_size AS code, count(*) AS n FROM part GROUP BY 1")
def s14(v):
    p = scratch_path(v.spark, "lookup")
    v("part").groupBy(F.col("p_size").alias("code")).agg(F.count("*").alias("n")).write.option("header", True).csv(p)
    return rd.read_fuel_lookup(v.spark, p).select(F.col("code").cast("int").alias("code"), F.col("n").cast("long").alias("n"))


@query("s16_read_labels", "SELECT uid::VARCHAR AS uid, count(*) AS n_claims FROM fx_claim GROUP BY 1")
def s16(v):
    p = scratch_path(v.spark, "labels")
    c = v("fx_claim").groupBy(F.col("uid").cast("string").alias("uid")).agg(F.collect_list(F.struct("label", "justification")).alias("claims"))
    b = c.groupBy(F.pmod(F.xxhash64("uid"), F.lit(16)).alias("k")).agg(F.to_json(F.collect_list(F.struct("uid", "claims"))).alias("value"))
    b.repartition(16, "k").select("value").write.option("maxRecordsPerFile", 1).text(p)
    return rd.read_labels(v.spark, p).select("uid", F.size("claims").cast("long").alias("n_claims"))


@query("k8_md_lines", "SELECT '| '||model||' | '||n||' |' AS line FROM (SELECT model, count(*) AS n FROM fx_record GROUP BY 1 ORDER BY 1) t")
def k8(v):
    return wr.md_lines(v("fx_record").groupBy("model").agg(F.count("*").alias("n")), ["model"])
