"""File scans: grids, series, messages, weather, features, graphs, run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.operators.common import attach_all, require_empty

FILE = "_metadata.file_path"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its path; a grid file is bounded by the model window."""
    return spark.read.text(path, wholetext=True).select(F.col(FILE).alias("file"), "value")


def read_asc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """ASCII grids: cells (file, r, c, value) and one header row per file."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")
    f = _whole(spark, path).select("file", lines.alias("lines"))
    head = F.map_from_entries(F.transform(F.slice("lines", 1, 6), lambda s: F.struct(F.lower(F.split(F.trim(s), r"\s+")[0]).alias("k"), F.split(F.trim(s), r"\s+")[1].cast("double").alias("v"))))
    f = f.withColumn("h", head)
    g = lambda k: F.try_element_at(F.col("h"), F.lit(k))
    cell = g("cellsize")
    meta = f.select(
        "file", g("ncols").cast("long").alias("ncols"), g("nrows").cast("long").alias("nrows"), cell.alias("cell"), g("nodata_value").alias("nodata"),
        F.coalesce(g("xllcorner"), g("xllcenter") - cell / 2).alias("x0"),
        (F.coalesce(g("yllcorner"), g("yllcenter") - cell / 2) + g("nrows") * cell).alias("y_top"),
    )
    rows = f.select("file", F.posexplode(F.slice("lines", 7, F.size("lines"))).alias("r", "line"))
    cells = rows.select("file", F.col("r").cast("long").alias("r"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "v"))
    return cells.select("file", "r", F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("value")), meta


def _series(spark: SparkSession, path: str, name: str) -> DataFrame:
    period = F.regexp_extract("file", name + r"(\d+)\.csv(?:/|$)", 1)
    run = F.regexp_extract("file", "^(.*/)?" + name + r"\d+\.csv(?:/|$)", 1)
    f = _whole(spark, path).withColumns({"period": period.try_cast("bigint"), "run": run}).filter("period IS NOT NULL")
    rows = f.select("run", "period", F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: s != "")).alias("r", "line"))
    return rows.select("run", "period", F.col("r").cast("long").alias("r"), F.posexplode(F.split("line", ",")).alias("c", "v")).withColumn("c", F.col("c").cast("long"))


def read_burn_series(spark: SparkSession, path: str) -> DataFrame:
    """Burned cells of every run (the folder of its files) and period; the period comes from the file
    name, other files are skipped."""
    return _series(spark, path, "ForestGrid").filter(F.col("v").try_cast("int") == 1).select("run", "period", "r", "c")


def read_intensity_series(spark: SparkSession, path: str) -> DataFrame:
    """Fireline intensity of every period, cells with fire only."""
    return _series(spark, path, "Intensity").select("run", "period", "r", "c", F.col("v").try_cast("double").alias("fi")).filter("fi > 0")


def arrivals(series: DataFrame) -> DataFrame:
    """First period of every run's cells of a burned series."""
    return series.groupBy("run", "r", "c").agg(F.min("period").alias("arrival"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Spread messages; rows with missing or unreadable target or rate are dropped."""
    m = spark.read.schema("source string, target string, period string, ros string").option("mode", "PERMISSIVE").csv(path)
    out = m.select(F.col("source").try_cast("bigint").alias("source"), F.trim("target").try_cast("bigint").alias("target"), F.col("period").try_cast("bigint").alias("period"), F.trim("ros").try_cast("double").alias("ros"))
    return out.filter("target IS NOT NULL AND ros IS NOT NULL")


WEATHER_SCHEMA = "latitude double, longitude double, hourly struct<time:array<string>,wind_speed_10m:array<double>,wind_direction_10m:array<double>,wind_gusts_10m:array<double>,temperature_2m:array<double>,relative_humidity_2m:array<double>,precipitation:array<double>>"


def read_hourly_weather(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Column-array weather documents as one row per point and hour; no rain array means 0."""
    d = spark.read.schema(WEATHER_SCHEMA).option("multiLine", multi_line).json(path)
    h = F.col("hourly")
    names = ["wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "temperature_2m", "relative_humidity_2m", "precipitation"]
    empty = F.expr("cast(array() as array<double>)")
    z = F.arrays_zip(h["time"].alias("time"), *[F.coalesce(h[n], empty).alias(n) for n in names])
    x = d.select("latitude", "longitude", h["precipitation"].isNull().alias("dry"), F.explode(z).alias("z"))
    return x.select(
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.to_timestamp(F.regexp_replace("z.time", "T", " ")).alias("ts"),
        F.col("z.wind_speed_10m").alias("ws_kmh"), F.col("z.wind_direction_10m").alias("wd_from"), F.col("z.wind_gusts_10m").alias("gust_kmh"),
        F.col("z.temperature_2m").alias("temp_c"), F.col("z.relative_humidity_2m").alias("rh_pct"), F.when(F.col("dry"), 0.0).otherwise(F.col("z.precipitation")).alias("precip_mm"),
    )


def read_features(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Point features of GeoJSON collections: properties as a map, x and y. A filter without
    a match is an error."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    f = d.select(F.explode("features").alias("f")).select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))
    if where is not None:
        f = f.filter(where)
        if not f.take(1):
            raise ValueError(f"no feature matches: {where}")
    xy = F.from_json(F.when(F.col("type") == "Point", F.col("coordinates")), "array<double>")
    return f.withColumns({"x": xy[0], "y": xy[1]})


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y) and edges (u, v, key, length, highway) of GraphML files.

    Attribute keys are resolved through the files' key declarations; a node or edge without
    attributes keeps its row. A file is parsed by one task, so a large network comes in several files.
    """
    def table(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    keys = table("key", "_id string, `_attr.name` string, _for string").select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name"), F.col("_for").alias("of")).distinct()

    def wide(df: DataFrame, of: str, ids: list[str], cols: list[str]) -> DataFrame:
        """One row per id with its attributes, looked up in the row itself. Rows leave the task that parsed their file before they are grouped."""
        names = keys.filter(F.col("of") == of).agg(*[F.collect_set(F.when(F.col("name") == c, F.col("k"))).alias(f"_{c}") for c in cols])
        d = df.crossJoin(F.broadcast(names))
        text = lambda c: F.transform(F.filter("data", lambda x: F.array_contains(F.col(f"_{c}"), x["_key"])), lambda x: F.regexp_replace(x["_VALUE"], r"[\[\]']", ""))
        d = d.select(*ids, *[F.array_max(text(c)).alias(c) for c in cols])
        return d.repartition(*ids).groupBy(*ids).agg(*[F.max(c).alias(c) for c in cols])

    data = "data array<struct<_VALUE:string,_key:string>>"
    n = wide(table("node", f"_id bigint, {data}").withColumnRenamed("_id", "node_id"), "node", ["node_id"], ["x", "y"])
    e = table("edge", f"_source bigint, _target bigint, _id bigint, {data}")
    e = e.select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.coalesce("_id", F.lit(0)).alias("key"), "data")
    e = wide(e, "edge", ["u", "v", "key"], ["length", "highway"])
    return n.select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), e.withColumn("length", F.col("length").cast("double"))


def read_jsonl_runs(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Run records, one JSON object per line. A torn last line is tolerated; a bad line
    elsewhere is an error."""
    lines = spark.read.text(path).select(F.col(FILE).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.trim("value").alias("line")).filter("line <> ''")
    # A split's rows keep their order in the file; splits are ordered by where they start.
    lines = lines.withColumn("pos", F.struct("block", "row")).drop("block", "row")
    bad = lines.filter(F.try_parse_json("line").isNull())
    if strict:
        last = lines.groupBy("file").agg(F.max("pos").alias("last"))
        require_empty(bad.join(last, "file").filter("pos < last").select("file", "line"), "bad lines inside a run file")
    good = lines.filter(F.try_parse_json("line").isNotNull())
    return good.select("file", F.from_json("line", schema).alias("j")).select("file", "j.*")


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of several CSV files with their united headers and their source file."""
    out = None
    for p in paths:
        df = spark.read.option("header", True).option("encoding", "UTF-8").csv(p)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns]).withColumn("source_file", F.input_file_name())
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Judge decisions of any of the three nestings, as VARIANT keyed by record id."""
    v = _whole(spark, path).select(F.try_parse_json("value").alias("v"))
    kids = lambda c: F.map_values(F.try_variant_get(c, "$", "map<string,variant>"))
    dec = lambda c: F.try_variant_get(c, "$.decisions", "array<variant>")
    inner = lambda c: F.coalesce(F.try_variant_get(c, "$.result", "variant"), c)
    none = F.expr("cast(array() as array<variant>)")
    deeper = F.flatten(F.transform(F.coalesce(kids(inner(F.col("v"))), none), lambda c: F.coalesce(dec(inner(c)), none)))
    d = v.select(F.explode(F.coalesce(dec(inner(F.col("v"))), deeper)).alias("d"))
    return d.select(F.try_variant_get("d", "$.record_id", "string").alias("record_id"), "d")


def list_runs(spark: SparkSession, root: str, required: list[str]) -> DataFrame:
    """Run folders that hold every required entry; the newest has the greatest name."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split(F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", ""), "/")
    runs = f.select(parts[0].alias("run_id"), parts[1].alias("name")).groupBy("run_id").agg(F.collect_set("name").alias("names"))
    full = runs.filter(F.forall(F.array(*[F.lit(r) for r in required]), lambda r: F.array_contains("names", r))).select("run_id")
    top = full.agg(F.max("run_id").alias("_top"))
    return attach_all(full, top).select("run_id", (F.col("run_id") == F.col("_top")).alias("newest"))


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batch arrays of a folder as one table."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_labels(spark: SparkSession, path: str, marker: str = "REHEARSAL", allow: bool = False) -> DataFrame:
    """Label records (uid, claims, notes); files that carry the rehearsal marker are refused."""
    schema = "uid string, notes string, claims array<struct<text:string,label:string,justification:string>>"
    if not allow:
        require_empty(_whole(spark, path).filter(F.contains("value", F.lit(marker)) | F.contains("file", F.lit(marker))).select("file"), "fabricated label files")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_key_map(spark: SparkSession, path: str) -> DataFrame:
    """Decision keys from CSV, or from a JSON object of objects or of two-element lists."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).csv(path).select("decision_id", "run_id", "uid")
    m = _whole(spark, path).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")).alias("decision_id", "e"))
    pick = lambda name, i: F.coalesce(F.try_variant_get("e", f"$.{name}", "string"), F.try_variant_get("e", f"$[{i}]", "string"))
    return m.select("decision_id", pick("run_id", 0).alias("run_id"), pick("uid", 1).alias("uid"))


def read_fuel_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_run(spark: SparkSession, root: str, run_id, layer: str, schema: str) -> DataFrame:
    """One layer of one run; an absent layer is an empty table."""
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(f"{root}/{layer}/run_id={run_id}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{layer}").parquet(f"{root}/{layer}/run_id={run_id}")


def find_messages(spark: SparkSession, root: str, sim: int) -> str | None:
    """Message file of a simulation: its exact number, else the first by name."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "MessagesFile*.csv").option("recursiveFileLookup", True).load(root).select("path")
    exact = F.col("path").endswith(f"MessagesFile{sim:02d}.csv")
    return f.agg(F.coalesce(F.min(F.when(exact, F.col("path"))), F.min("path"))).first()[0]
