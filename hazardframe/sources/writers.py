"""Sinks: grids, GeoJSON, run folders, records, guards against overwriting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.operators.cells import Grid


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def asc_lines(cells: DataFrame, grid: Grid, fmt: str, nodata: float = -9999, keys: list[str] = ()) -> DataFrame:
    """Header and body lines of ASCII grids, numbered in file order; absent cells are nodata."""
    head = [f"ncols {grid.ncols}", f"nrows {grid.nrows}", f"xllcorner {grid.x0:.6f}", f"yllcorner {grid.y_top - grid.nrows * grid.cell:.6f}", f"cellsize {grid.cell:.6f}", f"NODATA_value {nodata:g}"]
    val = F.format_string(fmt, F.col("value").cast("long" if fmt.endswith("d") else "double"))
    row = cells.groupBy(*keys, "r").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), val.alias("v")))).alias("m"))
    files = cells.select(*keys).distinct() if keys else cells.sparkSession.range(1).select()
    rows = files.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.nrows - 1).cast("long")))).join(row, [*keys, "r"], "left")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(grid.ncols - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(f"{nodata:g}"))), " ")
    body = rows.select(*keys, (F.col("r") + 6).alias("ord"), line.alias("value"))
    top = files.withColumn("h", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(t).alias("value")) for i, t in enumerate(head)]))).select(*keys, "h.*")
    return top.unionByName(body)


def write_asc(cells: DataFrame, grid: Grid, path: str, fmt: str = "%d", nodata: float = -9999, keys: list[str] = ()) -> None:
    """One ASCII grid, or one per key (partition folders)."""
    lines = asc_lines(cells, grid, fmt, nodata, keys)
    if keys:
        lines.repartition(*keys).sortWithinPartitions(*keys, "ord").drop("ord").write.partitionBy(*keys).text(path)
    else:
        lines.coalesce(1).sortWithinPartitions("ord").drop("ord").write.text(path)


def write_instance(tables: dict[str, DataFrame], path: str) -> None:
    """Small engine tables (ignition, seeded cells, hourly weather) as one CSV each."""
    for name, df in tables.items():
        df.coalesce(1).write.option("header", True).csv(f"{path}/{name}")


def geojson_features(df: DataFrame, x: str, y: str, nd: int = 5) -> DataFrame:
    """One GeoJSON feature text per row, coordinates rounded."""
    props = [c for c in df.columns if c not in (x, y)]
    geom = F.struct(F.lit("Point").alias("type"), F.array(F.round(x, nd), F.round(y, nd)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geom.alias("geometry"))).alias("value"))


def line_features(df: DataFrame, ends: list[tuple[str, str]], nd: int = 5) -> DataFrame:
    """Line features from coordinate column pairs (wind arrows, segments)."""
    used = {c for e in ends for c in e}
    props = [c for c in df.columns if c not in used]
    geom = F.struct(F.lit("LineString").alias("type"), F.array(*[F.array(F.round(a, nd), F.round(b, nd)) for a, b in ends]).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geom.alias("geometry"))).alias("value"))


def write_geojson(features: DataFrame, path: str, batch: int = 10000) -> None:
    """Feature collections; every output file is a complete collection of up to ``batch``
    features, so the table is written in parallel. Features are batched by their place in
    their partition, so equal features do not meet in one batch."""
    b = features.withColumn("_b", F.floor(F.monotonically_increasing_id() / batch))
    coll = b.groupBy("_b").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    # A reader takes one document from a file, so no file holds two.
    coll.select("value").write.option("maxRecordsPerFile", 1).text(path, lineSep="\n")


def write_run(tables: dict[str, DataFrame], root: str, mode: str = "error") -> None:
    """Layers of runs, one folder per run with its rows in order of the hour; a run is written whole,
    other runs' folders are kept. Hours are columns, not folders, so their number adds no files."""
    for name, df in tables.items():
        hour = ["period"] if "period" in df.columns else []
        # A run's rows meet in one task first: else every task leaves a file in nearly every folder.
        rows = df.repartition("run_id").sortWithinPartitions("run_id", *hour)
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")


def write_atomic(df: DataFrame, path: str, fmt: str = "parquet") -> str | None:
    """Replacement that keeps the previous version and returns its path; a failed rename is an error
    and leaves the previous version in place."""
    spark = df.sparkSession
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.format(fmt).save(tmp)
    target, fs = _fs(spark, path)
    kept = None
    if fs.exists(target):
        kept = f"{path}.prev-{uuid.uuid4().hex[:8]}"
        if not fs.rename(target, _fs(spark, kept)[0]):
            raise OSError(f"{path} could not be set aside; the new version is at {tmp}")
    if not fs.rename(_fs(spark, tmp)[0], target):
        if kept and not fs.rename(_fs(spark, kept)[0], target):
            raise OSError(f"{path} could not be replaced nor restored; versions are at {tmp} and {kept}")
        raise OSError(f"{path} could not be replaced; the new version is at {tmp}")
    return kept


def guard_output(spark: SparkSession, path: str, mode: str = "error") -> str:
    """Refuse a folder that already holds results unless resume or discard is explicit."""
    if not exists(spark, path) or mode == "resume":
        return path
    if mode == "discard":
        p, fs = _fs(spark, path)
        fs.rename(p, _fs(spark, f"{path}.discarded-{uuid.uuid4().hex[:8]}")[0])
        return path
    raise FileExistsError(f"{path} already holds results; choose resume or discard")


def records_frame(df: DataFrame) -> DataFrame:
    """Record cells as text: numbers lists comma-joined, text lists as JSON."""
    out = []
    for c, t in df.dtypes:
        if t == "array<string>":
            out.append(F.to_json(c).alias(c))
        elif t.startswith("array"):
            out.append(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    return df.select(*out)


def write_records(df: DataFrame, path: str) -> None:
    records_frame(df).write.option("header", True).option("escape", '"').csv(path)


def md_table(df: DataFrame, max_rows: int) -> str:
    """Markdown table of an aggregated frame, cut at ``max_rows`` with a note."""
    rows = df.limit(max_rows + 1).collect()
    cols = df.columns
    out = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    out += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in cols) + " |" for r in rows[:max_rows]]
    return "\n".join(out + (["", f"(first {max_rows} rows)"] if len(rows) > max_rows else []))


def md_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """Body lines of the whole table as a frame, for reports written by Spark."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_validation_layers(layers: dict[str, DataFrame], path: str) -> None:
    """One feature collection folder per layer with x and y."""
    for name, df in layers.items():
        write_geojson(geojson_features(df, "x", "y"), f"{path}/{name}")


def publish(tables: dict[str, DataFrame], names: list[str], root: str) -> None:
    """Copy named deliverables to a shared folder; existing ones are kept, unknown names refused."""
    unknown = [n for n in names if n not in tables]
    if unknown:
        raise KeyError(f"unknown exports: {unknown}")
    for n in names:
        tables[n].write.mode("ignore").parquet(f"{root}/{n}")


def manifest(cases: DataFrame, identity: dict[str, str], body: str = "body") -> DataFrame:
    """One row: identity fields, number and hash of the sorted case ids, hash of the case texts.

    Every case is hashed where it lies; only fixed-size digests are combined.
    """
    from hazardframe.functions.json_text import canonical

    d = cases.select("case_id", F.sha2(F.concat_ws("\x1f", F.col("case_id").cast("string"), canonical(body)), 256).alias("h"))
    agg = d.agg(F.count("*").alias("n_cases"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("cases_hash"))
    return agg.select(*[F.lit(v).alias(k) for k, v in identity.items()], "*")


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").json(path)


def write_params(df: DataFrame, path: str, drop_absolute: bool = True) -> None:
    """Provenance record; absolute paths are dropped from the portable form."""
    if drop_absolute:
        df = df.select(*[F.when(~F.col(c).rlike("^(/|[A-Za-z]:)"), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    df.coalesce(1).write.mode("overwrite").json(path)


def diff_trees(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and changed files by checksum (path, sha)."""
    a, b = before.select("path", F.col("sha").alias("a")), after.select("path", F.col("sha").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").withColumn("change", change).filter("change IS NOT NULL").select("path", "change")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder with their checksums."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select(F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "").alias("path"), F.sha2("content", 256).alias("sha"))
