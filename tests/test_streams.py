"""Streams: carried state against batch results, late and repeated rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hazardframe.functions import fireweather as fw
from hazardframe.operators.common import scratch_path
from hazardframe.operators.weather import daily_codes
from hazardframe.streaming import feeds


def _run(spark, stream, label):
    out = scratch_path(spark, label)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, f"{label}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


def _fed(spark, batches, schema):
    path = scratch_path(spark, "stream-in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_scalar_codes_equal_the_column_rules(spark):
    r = random.Random(3)
    rows = [(r.uniform(20, 99), r.uniform(0, 120), r.uniform(0, 700), r.uniform(-8, 38), r.uniform(3, 100), r.uniform(0, 60), r.choice([0.0, 0.4, 1.0, 2.0, 5.0, 60.0]), m) for m in range(1, 13) for _ in range(12)]
    df = spark.createDataFrame(rows, "f double, p double, d double, t double, h double, w double, r double, m int")
    got = df.select("*", fw.ffmc("f", "t", "h", "w", "r").alias("f1"), fw.dmc("p", "t", "h", "r", "m").alias("p1"), fw.dc("d", "t", "r", "m").alias("d1")).collect()
    for x in got:
        mine = fw.next_codes((x.f, x.p, x.d), x.t, x.h, x.w, x.r, x.m)
        assert max(abs(a - b) for a, b in zip(mine, (x.f1, x.p1, x.d1))) < 1e-9


def test_late_detections_are_counted_and_move_no_anchor(spark):
    at = lambda minute: dt.datetime(2021, 8, 5) + dt.timedelta(minutes=minute)
    big = 1 << 60  # an id that a double can not hold
    first = [(1, 1, at(0)), (1, big + 1, at(5)), (1, 3, at(100))]
    second = [(1, 4, at(130)), (1, 6, at(101))]  # out of order; settles what is 30 minutes before the first batch's end
    third = [(1, 5, at(2)), (1, 7, at(131))]  # 5 comes after its time has been settled
    last = [(9, 0, at(2000))]
    stream = _fed(spark, [first, second, third, last], "fire_id long, det_id long, t timestamp")
    got, query = _run(spark, feeds.stream_passes(stream, 20, "30 minutes"), "passes")
    rows = {r.det_id: r.pass_s for r in got.filter("fire_id = 1").collect()}
    base = rows[1]
    assert rows == {1: base, big + 1: base, 3: base + 6000, 6: base + 6000, 4: base + 7800, 7: base + 7800}
    assert feeds.late_rows(query) == 1


def test_streamed_codes_take_the_batch_rain_total(spark):
    """0.7 + 1.5 + 0.6 passes the drought code's threshold of 2.8 from the left and not as an exact sum."""
    at = lambda hour: dt.datetime(2021, 8, 5) + dt.timedelta(hours=hour)
    rows = [(1, at(8), 0.7, 20.0, 40.0, 10.0), (1, at(9), 1.5, 20.0, 40.0, 10.0), (1, at(10), 0.6, 20.0, 40.0, 10.0), (1, at(34), 0.0, 25.0, 30.0, 12.0)]
    schema = "station_id long, ts timestamp, precip_mm double, temp_c double, rh_pct double, ws_kmh double"
    stream = _fed(spark, [rows, [(-1, at(24 * 40), None, None, None, None)]], schema)
    store, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got, _ = _run(spark, feeds.stream_codes(stream), "codes")
    finally:
        spark.conf.set(store, before)
    want = daily_codes(spark.createDataFrame(rows, schema))
    codes = ["station_id", "day", "ffmc", "dmc", "dc"]
    assert feeds.rain_total([0.7, 1.5, 0.6]) > 2.8
    assert sorted(got.select(codes).collect()) == sorted(want.select(codes).collect())
