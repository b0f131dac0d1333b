"""Time rules: local clock, period stamps, labels of weather source and run mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardframe.functions.base import col

LOCAL_ZONE = "Europe/Athens"
ARCHIVE_LAG_DAYS = 6


def to_utc(local_text, now) -> Column:
    """UTC minute of a user's time text: an explicit offset is kept, a naive time is local."""
    s = F.regexp_replace(F.trim(col(local_text)), r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(?!:)", "$1 $2:00")
    has_offset = s.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    naive = F.to_utc_timestamp(F.when(~has_offset, s).try_cast("timestamp_ntz").cast("timestamp"), LOCAL_ZONE)
    exact = F.when(has_offset, s).try_cast("timestamp")
    picked = F.when(s.isNull() | (s == ""), col(now)).when(has_offset, exact).otherwise(naive)
    return F.date_trunc("minute", picked)


def fmt_local(ts) -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), LOCAL_ZONE), "dd/MM/yyyy HH:mm")


def period_ts(t0, period) -> Column:
    """Time stamp of a forecast hour."""
    return col(t0) + F.make_interval(hours=col(period).cast("int"))


def shift_date(day, n) -> Column:
    return F.date_add(col(day).cast("date"), col(n))


def archive_cutoff(today) -> Column:
    return F.date_add(col(today).cast("date"), -ARCHIVE_LAG_DAYS)


def weather_source(d0, d1, cutoff) -> Column:
    return (
        F.when(col(d1) <= col(cutoff), "archive")
        .when(col(d0) > col(cutoff), "forecast")
        .otherwise("archive+forecast")
    )


def run_mode(scenario, n_fronts, n_pins) -> Column:
    return (
        F.when(col(scenario).isNotNull(), "scenario")
        .when(col(n_fronts) >= 2, "multi_front")
        .when(col(n_pins) >= 2, "front")
        .otherwise("point_ignition")
    )
