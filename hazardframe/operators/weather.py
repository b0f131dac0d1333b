"""Hourly weather operators: gaps, stitching, interpolation, daily codes, index table.

A station's series is bounded by the calendar (one row per hour after de-duplication),
so per-station windows and folds never collect an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.functions import fireweather as fw
from hazardframe.functions import geo
from hazardframe.functions.base import dbl, round_scaled
from hazardframe.operators.common import require_empty

STATION = ["station_id"]


def slice_hours(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Hours in [start, end], both ends kept."""
    return df.filter(F.col(ts).between(F.lit(start), F.lit(end)))


def take_horizon(df: DataFrame, start, hours: int, keys=STATION, strict: bool = False) -> DataFrame:
    """First ``hours`` rows at or after ``start`` per station; ``strict`` raises when fewer."""
    w = W.partitionBy(*keys).orderBy("ts")
    out = df.filter(F.col("ts") >= F.lit(start)).withColumn("_n", F.row_number().over(w))
    out = out.filter(F.col("_n") <= hours).drop("_n")
    if strict:
        short = out.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") < hours)
        require_empty(short, f"weather covers fewer than {hours} hours")
    return out


def rain24(df: DataFrame, keys=STATION) -> DataFrame:
    """Rain of this row and the 23 rows before it (missing values count as zero)."""
    w = W.partitionBy(*keys).orderBy("ts").rowsBetween(-23, 0)
    return df.withColumn("rain24", F.sum(F.coalesce(F.col("precip_mm"), F.lit(0.0))).over(w))


def find_gaps(df: DataFrame, keys=STATION) -> DataFrame:
    """Consecutive hours that are not one hour apart, both times named."""
    w = W.partitionBy(*keys).orderBy("ts")
    out = df.select(*keys, "ts").withColumn("prev_ts", F.lag("ts").over(w))
    step = F.col("ts").cast("timestamp").cast("long") - F.col("prev_ts").cast("timestamp").cast("long")
    return out.withColumn("gap_s", step).filter(F.col("gap_s") != 3600)


def assert_contiguous(df: DataFrame, keys=STATION) -> DataFrame:
    require_empty(find_gaps(df, keys), "hourly series has gaps")
    return df


def daily_noon(df: DataFrame, noon_hour: int = 10, keys=STATION) -> DataFrame:
    """One usable noon row per station and day, with its 24-hour rain."""
    noon = rain24(df, keys).filter(F.hour("ts") == noon_hour)
    return noon.filter(
        F.col("temp_c").isNotNull() & F.col("rh_pct").isNotNull() & F.col("ws_kmh").isNotNull()
    ).select(*keys, F.to_date("ts").alias("day"), "temp_c", "rh_pct", "ws_kmh", "rain24")


def daily_codes(df: DataFrame, noon_hour: int = 10, keys=STATION) -> DataFrame:
    """Daily FFMC, DMC and DC carried from day to day; days without a noon row are skipped.

    The state-free terms of the update are computed per row in generated code; what is left
    is one short ordered fold per station, bounded by its calendar days. One shuffle by
    station serves the rain window and the fold. The carried state stays unrounded, the
    output has two decimals.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    noon = daily_noon(df.repartition(n, *keys), noon_hour, keys)
    month = F.month("day")
    terms = {
        **fw.ffmc_terms("temp_c", "rh_pct", "ws_kmh", "rain24"),
        **fw.dmc_terms("temp_c", "rh_pct", "rain24", month),
        **fw.dc_terms("temp_c", "rain24", month),
    }
    noon = noon.select(*keys, F.struct("day", *[c.alias(k) for k, c in terms.items()]).alias("d"))
    series = noon.groupBy(*keys).agg(F.sort_array(F.collect_list("d")).alias("s"))

    def step(acc: Column, d: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(
            d["day"].alias("day"), fw.ffmc_next(last["ffmc"], d).alias("ffmc"),
            fw.dmc_next(last["dmc"], d).alias("dmc"), fw.dc_next(last["dc"], d).alias("dc"),
        )))

    f0, p0, d0 = (F.lit(v) for v in fw.START_CODES)
    start = F.array(F.struct(F.lit(None).cast("date").alias("day"), f0.alias("ffmc"), p0.alias("dmc"), d0.alias("dc")))
    days = series.select(*keys, F.explode(F.aggregate("s", start, step)).alias("o"))
    return days.filter("o.day is not null").select(
        *keys, F.col("o.day").alias("day"),
        *[round_scaled(f"o.{c}", 2).alias(c) for c in ("ffmc", "dmc", "dc")],
    )


def asof_codes(hourly: DataFrame, daily: DataFrame, keys=STATION) -> DataFrame:
    """Each hour gets its day's codes, else the latest earlier day's, else the start codes."""
    codes = ["ffmc", "dmc", "dc"]
    left = hourly.withColumn("day", F.to_date("ts")).withColumn("_side", F.lit(1))
    right = daily.select(*keys, "day", *codes).withColumn("_side", F.lit(0))
    w = W.partitionBy(*keys).orderBy("day", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    for c, start in zip(codes, fw.START_CODES):
        both = both.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(start)))
    return both.filter("_side = 1").drop("_side", "day")


def fire_weather(hourly: DataFrame, daily: DataFrame, wd_fixed=None, keys=STATION) -> DataFrame:
    """Hourly engine table: rounded wind and codes plus ISI, BUI and FWI.

    The indices use the two-decimal daily codes and the unrounded hourly wind.
    """
    df = asof_codes(hourly, daily, keys)
    wd = F.col("wd_from") if wd_fixed is None else dbl(wd_fixed)
    i = fw.isi("ffmc", "ws_kmh")
    b = fw.bui("dmc", "dc")
    return df.select(
        *keys, "ts",
        round_scaled(F.coalesce(F.col("precip_mm"), F.lit(0.0)), 2).alias("apcp"),
        F.col("temp_c").alias("tmp"), F.col("rh_pct").alias("rh"),
        round_scaled("ws_kmh", 1).alias("ws"), F.bround(wd, 0).cast("long").alias("wd"),
        "ffmc", "dmc", "dc",
        round_scaled(i, 2).alias("isi"), round_scaled(b, 2).alias("bui"), round_scaled(fw.fwi(i, b), 2).alias("fwi"),
    )


def stitch(archive: DataFrame, forecast: DataFrame, keys=STATION) -> DataFrame:
    """One row per station and hour; the archive wins over the forecast."""
    both = archive.withColumn("_p", F.lit(0)).unionByName(forecast.withColumn("_p", F.lit(1)))
    w = W.partitionBy(*keys, "ts").orderBy("_p")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")


def dedupe_cells(grid: DataFrame, order: str = "request_id", hour: str | None = None) -> DataFrame:
    """First request wins per weather cell (coordinates rounded to 3 decimals)."""
    keyed = grid.withColumn("cell_lat", F.round("lat", 3)).withColumn("cell_lon", F.round("lon", 3))
    part = ["cell_lat", "cell_lon"] + ([hour] if hour else [])
    w = W.partitionBy(*part).orderBy(order)
    return keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def idw(grid: DataFrame, lat: float, lon: float, power: float = 2.0, order: str = "cell") -> DataFrame:
    """Inverse-distance weather at one point, per hour.

    Wind is blended by components; missing scalars count as zero; hours of a cell without
    wind speed are left out; a cell within 1 km gives its own series; an hour with no
    usable cell falls back to the first cell's row.
    """
    scalars = [c for c in ("temp_c", "rh_pct", "gust_kmh", "precip_mm") if c in grid.columns]
    d = geo.planar_m("lat", "lon", lat, lon, cos_lat=lat)
    g = grid.withColumn("_d", d).withColumn("_w", F.when(F.col("ws_kmh").isNotNull(), F.pow(F.greatest(d, F.lit(1.0)), F.lit(-power))))
    row = F.struct("ws_kmh", "wd_from", *scalars)
    agg = g.groupBy("ts").agg(
        F.sum("_w").alias("w"),
        F.sum(F.col("_w") * geo.wind_u("ws_kmh", "wd_from")).alias("u"),
        F.sum(F.col("_w") * geo.wind_v("ws_kmh", "wd_from")).alias("v"),
        *[F.sum(F.col("_w") * F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in scalars],
        F.min_by(F.when(F.col("_d") < 1000.0, row), F.when(F.col("_d") < 1000.0, F.col(order))).alias("exact"),
        F.min_by(row, F.col(order)).alias("first"),
    )
    own = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("w").isNull(), F.col("first"))
    u, v = F.col("u") / F.col("w"), F.col("v") / F.col("w")
    return agg.select(
        "ts",
        F.when(own.isNotNull(), own["ws_kmh"]).otherwise(F.hypot(u, v)).alias("ws_kmh"),
        F.when(own.isNotNull(), own["wd_from"]).otherwise(geo.wind_from_uv(u, v)).alias("wd_from"),
        *[F.when(own.isNotNull(), own[c]).otherwise(F.col(c) / F.col("w")).alias(c) for c in scalars],
    )


def wind_arrows(grid: DataFrame, metres_per_kmh: float = 40.0) -> DataFrame:
    """Arrow end points per cell and hour, pointing where the wind blows to."""
    length = F.coalesce(F.col("ws_kmh"), F.lit(0.0)) * metres_per_kmh
    to = F.radians(geo.blows_to("wd_from"))
    per_lon = geo.METRES_PER_DEGREE * F.cos(F.radians(F.col("lat")))
    return grid.select(
        "*", F.round(geo.blows_to("wd_from"), 1).alias("blows_to"),
        (F.col("lon") + length * F.sin(to) / per_lon).alias("end_lon"),
        (F.col("lat") + length * F.cos(to) / geo.METRES_PER_DEGREE).alias("end_lat"),
    )


def implied_wind(det: DataFrame, ign_x: float, ign_y: float, t0, hours: int) -> DataFrame:
    """Wind direction implied by the first hours' detections: from the opposite of their bearing."""
    end = F.lit(t0).cast("timestamp") + F.make_interval(hours=F.lit(hours))
    first = det.filter((F.col("t") >= F.lit(t0).cast("timestamp")) & (F.col("t") <= end))
    c = first.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    to = geo.bearing(F.col("cx") - ign_x, F.col("cy") - ign_y)
    return c.select(geo.blows_to(to).alias("wd_from"), to.alias("blows_to"))


def request_grid(points: DataFrame, nx: int, ny: int) -> DataFrame:
    """nx by ny evenly spaced request points over each row's bounding box."""

    def axis(lo: str, hi: str, n: int) -> Column:
        step = (F.col(hi) - F.col(lo)) / (n - 1) if n > 1 else F.lit(0.0)
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col(lo) + i * step)

    out = points.withColumn("lat", F.explode(axis("lat0", "lat1", ny)))
    return out.withColumn("lon", F.explode(axis("lon0", "lon1", nx)))


def instance_stats(table: DataFrame) -> DataFrame:
    """Wind and ISI spans of an hourly engine table."""
    return table.agg(
        F.min("ws").alias("ws_min"), F.max("ws").alias("ws_max"),
        F.min("isi").alias("isi_min"), F.max("isi").alias("isi_max"), F.count("*").alias("hours"),
    )
