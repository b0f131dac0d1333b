"""Threshold and algebra tests of the scalar rules on literal frames."""

import pytest
from pyspark.sql import functions as F

from hazardframe.functions import answers as an
from hazardframe.functions import base
from hazardframe.functions import fireweather as fw
from hazardframe.functions import geo
from hazardframe.functions import text as tx
from hazardframe.operators import runs as rn
from hazardframe.sources import readers as rd


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_rain_at_the_threshold_changes_nothing(spark):
    assert one(spark, fw.ffmc(F.lit(85.0), F.lit(20.0), F.lit(50.0), F.lit(10.0), F.lit(0.5))) == pytest.approx(one(spark, fw.ffmc(F.lit(85.0), F.lit(20.0), F.lit(50.0), F.lit(10.0), F.lit(0.0))))
    assert one(spark, fw.dmc(F.lit(30.0), F.lit(20.0), F.lit(50.0), F.lit(1.5), F.lit(7))) == pytest.approx(one(spark, fw.dmc(F.lit(30.0), F.lit(20.0), F.lit(50.0), F.lit(0.0), F.lit(7))))
    assert one(spark, fw.dc(F.lit(200.0), F.lit(20.0), F.lit(2.8), F.lit(7))) == pytest.approx(one(spark, fw.dc(F.lit(200.0), F.lit(20.0), F.lit(0.0), F.lit(7))))


def test_hot_dry_day_raises_ffmc(spark):
    assert one(spark, fw.ffmc(F.lit(85.0), F.lit(32.0), F.lit(20.0), F.lit(15.0), F.lit(0.0))) > 88


def test_bui_is_zero_without_fuel(spark):
    assert one(spark, fw.bui(F.lit(0.0), F.lit(0.0))) == 0.0


def test_two_decimal_ties_round_as_their_binary_values(spark):
    bui = lambda p, d: one(spark, base.round_scaled(fw.bui(F.lit(p), F.lit(d)), 2))
    assert (bui(0.36, 1.98), bui(0.72, 4.6)) == (0.49, 1.03)  # 0.495 and 1.035, both a little less in binary


def test_bearing_and_wrap(spark):
    assert one(spark, geo.bearing(F.lit(1.0), F.lit(0.0))) == pytest.approx(90.0)
    assert one(spark, geo.ang_diff(F.lit(350.0), F.lit(10.0))) == pytest.approx(20.0)
    assert one(spark, geo.compass(F.lit(359.0))) == "N"


def test_suppression_class_moves_up_on_equality(spark):
    got = [one(spark, geo.supp_class(F.lit(v))) for v in (0, 349, 350, 1750, 3500)]
    assert got == [0, 1, 2, 3, 4]


def test_projection_round_trip_and_origin(spark):
    df = spark.createDataFrame([(38.85, 23.3), (39.0, 24.0)], "lat double, lon double")
    rows = geo.to_4326(geo.to_2100(df), lat="lat2", lon="lon2").collect()
    for r in rows:
        assert r["lat2"] == pytest.approx(r["lat"], abs=1e-7) and r["lon2"] == pytest.approx(r["lon"], abs=1e-7)
    assert abs(rows[1]["x"] - 500000) < 300 and 4.31e6 < rows[1]["y"] < 4.33e6


def test_bounds_and_case_states(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("a", True)], "case_id string, v boolean")
    assert tuple(rn.bounds(df, "v").first()) == (0.5, 0.75, 1)
    cases = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", None), ("c", False), ("c", None)], "case_id string, v boolean")
    r = rn.passk_bounds(cases, "v").first()
    assert (r["lower"], r["upper"], r["pending"]) == (0.333333, 0.666667, 1)


def test_sign_test_values(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (3, 3)], "b int, c int")
    assert [r[0] for r in df.select(rn.sign_test("b", "c")).collect()] == [None, 0.0625, 1.0]


def test_pairing_repetitions_is_refused(spark):
    df = spark.createDataFrame([("a", "free", True)], "case_id string, arm string, v boolean")
    with pytest.raises(ValueError):
        rn.discordance(df, "v", unit="rep")


def _answer(spark, text):
    return spark.createDataFrame([(text,)], "reply string").withColumn("v", an.parse_reply("reply")).withColumn("a", an.answer_of(F.col("v")))


def test_true_is_not_an_integer(spark):
    df = _answer(spark, '{"status":"ok","initial_state":[],"critical_transitions":[{"period":true,"settlements_without_route":1}],"final_state":[],"interpretation":"a","limitations":"b"}')
    r = df.select(an.entry_periods(F.col("a.critical_transitions")).alias("p"), an.schema_conformant(F.col("a")).alias("ok")).first()
    assert r["p"] is None and r["ok"] is False


def test_duplicate_period_is_one_extra(spark):
    ints = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    ct = one(spark, an.transition_fields(ints(1, 3, 3, 9, 4), ints(1, 3, 4), ints(0, 1, 3, 4)))
    assert (list(ct["extras"]), list(ct["duplicates"]), ct["matched"], ct["exact"], ct["order_ok"]) == ([3, 9], [3], 3, False, True)
    assert list(ct["extra_not_in_payload"]) == [9]


def test_payload_pick_takes_last_or_first_object(spark):
    df = spark.createDataFrame([(["INPUT ERROR: x", '{"a":1}', "not json", '{"a":2}'],)], "o array<string>")
    r = df.select(F.to_json(an.pick_payload("o")).alias("last"), F.to_json(an.pick_payload("o", "first")).alias("first")).first()
    assert (r["last"], r["first"]) == ('{"a":2}', '{"a":1}')


def test_traced_numbers(spark):
    nums = F.array(F.lit(200000.0), F.lit(62.5))
    got = [one(spark, tx.traced(F.lit(t), nums)) for t in ("48", "2021", "200.000", "62,5", "62500", "777")]
    assert got == [True, True, True, True, True, False]


def test_negated_family_is_not_flagged(spark):
    p = tx.NOTE_FAMILIES["fabricated_geography"]
    df = spark.createDataFrame([("No invented settlement",), ("an invented settlement",), ("invented road: none",)], "n string")
    assert [r[0] > 0 for r in df.select(tx.flagged("n", p)).collect()] == [False, True, False]


def test_graphml_comes_in_files_with_own_ends_and_keeps_edges_without_attributes(spark, tmp_path):
    """A file with keys, one that repeats none of them, and an edge and a node without data, which were dropped."""
    keys = '<key id="d0" for="node" attr.name="x" attr.type="string"/><key id="d1" for="edge" attr.name="length" attr.type="string"/>'
    (tmp_path / "a.graphml").write_text(f'<graphml>\n{keys}\n<graph>\n<node id="1"><data key="d0">2.5</data></node>\n<node id="2"/>\n<edge source="1" target="2" id="0"><data key="d1">7</data></edge>\n</graph></graphml>')
    (tmp_path / "b.graphml").write_text('<graphml>\n<graph>\n<edge source="2" target="1" id="0"/>\n</graph></graphml>')
    nodes, edges = rd.read_graphml(spark, str(tmp_path))
    assert sorted((r["node_id"], r["x"]) for r in nodes.collect()) == [(1, 2.5), (2, None)]
    assert sorted((r["u"], r["v"], r["length"] or 0) for r in edges.collect()) == [(1, 2, 7.0), (2, 1, 0)]
