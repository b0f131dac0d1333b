"""Guards of scenario requests: bounds, coverage, window containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted window (km), horizon (h) and forecast reach (days).
WINDOW_KM = (6.0, 40.0)
HORIZON_H = (1, 48)
FORECAST_DAYS = 15


def _outside(box):
    xmin, ymin, xmax, ymax = box
    return ~(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def pins_outside_window(pins: DataFrame, box) -> DataFrame:
    """Pins outside a rectangle (edges belong to it)."""
    return pins.filter(_outside(box))


def window_box(meta: DataFrame) -> DataFrame:
    """Rectangle of a grid from its header columns x0, y_top, cell, nrows, ncols."""
    return meta.select(
        "*", F.col("x0").alias("xmin"), (F.col("y_top") - F.col("nrows") * F.col("cell")).alias("ymin"),
        (F.col("x0") + F.col("ncols") * F.col("cell")).alias("xmax"), F.col("y_top").alias("ymax"),
    )


def validate_requests(req: DataFrame, pins: DataFrame, box, now) -> DataFrame:
    """First failing rule of each request, and its pins outside the coverage.

    ``req`` has request_id, window_km, horizon_h, start; ``pins`` has request_id, pin_id, x, y.
    """
    per = pins.groupBy("request_id").agg(
        F.count("*").alias("n_pins"),
        F.array_sort(F.collect_list(F.when(_outside(box), F.col("pin_id")))).alias("bad_pins"),
    )
    end = F.col("start") + F.make_interval(hours=F.col("horizon_h").cast("int"))
    code = (
        F.when(F.coalesce(F.col("n_pins"), F.lit(0)) == 0, "no_points")
        .when(F.col("window_km").isNull() | ~F.col("window_km").between(*WINDOW_KM), "window")
        .when(F.col("horizon_h").isNull() | ~F.col("horizon_h").between(*HORIZON_H), "horizon")
        .when(F.col("start").isNull(), "start_time")
        .when(end > F.lit(now).cast("timestamp") + F.make_interval(days=F.lit(FORECAST_DAYS)), "beyond_forecast")
        .when(F.size("bad_pins") > 0, "outside_coverage")
    )
    out = req.join(per, "request_id", "left").withColumn("error_code", code)
    return out.select("request_id", F.col("error_code").isNull().alias("ok"), "error_code",
                      F.when(F.col("error_code") == "outside_coverage", F.col("bad_pins")).alias("bad_pins"))
