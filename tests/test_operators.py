"""Operators against brute force and the known small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hazardframe.operators import cells as cl
from hazardframe.operators import components as cc
from hazardframe.operators import detections as dt
from hazardframe.operators import network as net
from hazardframe.operators import overlay as ov
from hazardframe.operators import rings as rg
from hazardframe.operators import runs as rn
from hazardframe.operators import spatial as sp
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import CREATED, estimated_bytes, materialise, scratch_path, size_files_as_rows
from hazardframe.operators.requests import validate_requests
from hazardframe.sources import readers as rd
from hazardframe.sources import writers as wr


def _points(n, seed, hot):
    rnd = random.Random(seed)
    pts = [(i, rnd.uniform(0, 5000), rnd.uniform(0, 5000)) for i in range(n)]
    return pts + [(n + i, 1000 + rnd.uniform(0, 5), 1000 + rnd.uniform(0, 5)) for i in range(hot)]


def test_within_distance_matches_brute_force_with_a_crowded_place(spark):
    a, b = _points(150, 1, 75), _points(60, 2, 30)
    left = spark.createDataFrame(a, "id long, x double, y double")
    right = spark.createDataFrame(b, "rid long, x double, y double")
    want = {p[0] for p in a if any(math.dist(p[1:], q[1:]) <= 300 for q in b)}
    assert {r["id"] for r in sp.within_distance(left, right, 300.0).collect()} == want
    assert {r["id"] for r in sp.within_distance(left, right, 300.0, anti=True).collect()} == {p[0] for p in a} - want


def test_nearest_matches_brute_force(spark):
    a, b = _points(120, 3, 60), _points(40, 4, 0)
    left = spark.createDataFrame(a, "id long, x double, y double")
    right = spark.createDataFrame(b, "tid long, x double, y double")
    want = {p[0]: min((math.dist(p[1:], q[1:]), q[0]) for q in b)[1] for p in a}
    assert {r["id"]: r["tid"] for r in sp.nearest(left, right, ["id"]).collect()} == want


def test_nearest_of_crowded_places_and_of_points_without_a_place(spark, monkeypatch):
    """Targets beyond one list, points that share a place, ties, and a null place, which was searched without end."""
    monkeypatch.setattr(sp, "LIST_TARGETS", 3)
    at = [(i, float(i % 4), float(i % 3)) for i in range(60)]
    right = spark.createDataFrame([(i, x + 0.25, y) for i, x, y in at], "tid long, x double, y double")
    left = spark.createDataFrame([*at, (98, 500.0, -70.0), (99, None, 1.0)], "id long, x double, y double")
    want = {i: min((math.hypot(x - a - 0.25, y - b), t) for t, a, b in at)[1] for i, x, y in [*at, (98, 500.0, -70.0)]}
    got = sp.nearest(left, right, ["id"]).collect()
    assert {r["id"]: r["tid"] for r in got} == want and len(got) == 61


def test_blocked_zone_across_tiles_matches_brute_force(spark, monkeypatch):
    """A filled block with later and missing cells, cut by tiles narrower than the reach, and two runs."""
    monkeypatch.setattr(cl, "TILE", 2)
    fire = {(k, r, c): (r * 3 + c + k) % 4 for k in (0, 1) for r in range(-3, 5) for c in range(6) if (r * 5 + c * 3 + k) % 7}
    width = {(r, c): 100.0 + (r * 7 + c * 11) % 6 * 100 for r in range(-6, 8) for c in range(-3, 9)}
    want = {}
    for (k, r, c), hour in fire.items():
        for (r2, c2), w in width.items():
            if 200 * math.hypot(r - r2, c - c2) <= w:
                want[k, r2, c2] = min(hour, want.get((k, r2, c2), hour))
    f = spark.createDataFrame([(*k, h) for k, h in fire.items()], "run_id long, r long, c long, arrival long")
    w = spark.createDataFrame([(*k, m) for k, m in width.items()], "r long, c long, width_m double")
    assert {(x["run_id"], x["r"], x["c"]): x["arrival"] for x in cl.blocked_zone(f, w, 200.0).collect()} == want


def test_fronts_are_transitive_and_inclusive(spark):
    pins = spark.createDataFrame([(1, 0.0, 0.0), (2, 375.0, 0.0), (3, 750.0, 0.0), (4, 1126.0, 0.0)], "pin_id long, x double, y double")
    assert {r["pin_id"]: r["front"] for r in cc.front_components(pins).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_holes_are_filled_and_corner_cells_are_two_rings(spark):
    ring = [(0, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(0, 3, 3)]
    df = spark.createDataFrame(ring, "run_id long, r long, c long")
    assert cc.fill_holes(df).count() == 10
    rings = rg.boundary_rings(df)
    assert rings.select("ring_id").distinct().count() == 2
    assert rg.boundary_rings(df, exterior_only=False).select("ring_id").distinct().count() == 3


def _filled(cells: set) -> set:
    """Per 4-connected part, what its outside does not reach, by flooding."""

    def flood(start, inside):
        seen, todo = {start}, [start]
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n not in seen and inside(n):
                    seen.add(n)
                    todo.append(n)
        return seen

    out, left = set(cells), set(cells)
    while left:
        part = flood(next(iter(left)), lambda n: n in cells)
        left -= part
        r0, r1, c0, c1 = (f(x[i] for x in part) + d for i in (0, 1) for f, d in ((min, -1), (max, 1)))
        outside = flood((r0, c0), lambda n: r0 <= n[0] <= r1 and c0 <= n[1] <= c1 and n not in part)
        out |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)} - outside
    return out


def test_holes_equal_flooding(spark):
    r, cells = random.Random(6), set()
    for run in range(6):
        share = 0.5 + 0.08 * run
        cells |= {(run, i, j) for i in range(18) for j in range(18) if r.random() < share}
    ring = {(9, i, j) for i in range(9) for j in range(9) if max(abs(i - 4), abs(j - 4)) in (2, 4)}  # a ring in a ring
    comb = {(10, i, j) for i in range(30) for j in range(0, 30) if j % 2 == 0 or i == 0}
    closed = comb | {(10, 29, j) for j in range(0, 28)}
    cells |= ring | {(11, i, j) for _, i, j in comb} | closed
    got = {tuple(x) for x in cc.fill_holes(spark.createDataFrame(list(cells), "run_id long, r long, c long")).collect()}
    want = {(run, *x) for run in {k for k, _, _ in cells} for x in _filled({(i, j) for k, i, j in cells if k == run})}
    assert got == want and len(want) > len(cells)


def test_a_long_diagonal_costs_its_length(spark):
    n = 10_000
    df = spark.range(2 * n).selectExpr("0L AS run_id", "CAST(floor(id / 2) AS BIGINT) AS r", "CAST(floor((id + 1) / 2) AS BIGINT) AS c")
    assert cc.fill_holes(df).count() == 2 * n


def test_burn_series_areas(spark):
    cells = [(0, r, c, max(r, c)) for r in range(3) for c in range(3)]
    s = cl.perimeter_stats(spark.createDataFrame(cells, "run_id long, r long, c long, arrival long"), 30.0).orderBy("period")
    assert [r["n_cells"] for r in s.collect()] == [1, 4, 9]


def test_passes_anchor_on_their_first_time(spark):
    t = ["10:43", "10:43", "10:43", "11:34", "11:34", "12:23", "12:40", "12:44"]
    df = spark.createDataFrame([(i, f"2021-08-06 {x}:00") for i, x in enumerate(t)], "det_id long, t string").withColumn("t", F.to_timestamp("t"))
    got = [r[0].strftime("%H:%M") for r in dt.group_passes(df).select("pass_t").distinct().orderBy("pass_t").collect()]
    assert got == ["10:43", "11:34", "12:23", "12:44"]


def test_runs_wrap_around_the_ring(spark):
    d = [100.0, 100.0, 0.0, -80.0, 0.0, 100.0, 100.0, 100.0]
    df = spark.createDataFrame([(0, i, x, False) for i, x in enumerate(d)], "ring_id long, idx long, signed_m double, excluded boolean")
    got = {(r["start_idx"], r["n_points"], r["sign"], r["kind"]) for r in rg.ring_runs(df, ["ring_id"]).collect()}
    assert got == {(5, 5, 1, "zone"), (3, 1, -1, "isolated_extreme")}


def test_cheapest_refuge_is_not_the_nearest(spark):
    e = spark.createDataFrame([(0, 1, 2, 1000.0, 1000.0), (0, 1, 3, 50.0, 50.0), (0, 3, 4, 50.0, 50.0)], "period int, u long, v long, cost double, length_m double")
    ref = spark.createDataFrame([(0, 2, 20), (0, 4, 40)], "period int, node_id long, refuge_id long")
    r = net.route_all(e, ref, ["period"]).filter("node = 1").first()
    assert (r["refuge_id"], r["cost"], r["next_hop"]) == (40, 100.0, 3)


def test_touching_the_fire_cuts_an_edge(spark):
    fire = spark.createDataFrame([(0, 0, 0, 0)], "run_id long, r long, c long, arrival long")
    e = spark.createDataFrame([(1, 2, 0, 100.0, -50.0, 100.0, 150.0), (3, 4, 0, 101.0, -50.0, 101.0, 150.0)], "u long, v long, key long, x1 double, y1 double, x2 double, y2 double")
    assert [r["u"] for r in net.cut_edges(e, fire, Grid(0.0, 100.0, 100.0, 1, 1), ["run_id"]).collect()] == [1]


@pytest.mark.parametrize("window,horizon,code", [(6.0, 1, None), (40.0, 48, None), (5.9, 6, "window"), (12.0, 49, "horizon")])
def test_request_bounds(spark, window, horizon, code):
    req = spark.createDataFrame([(1, window, horizon, "2021-08-05 00:00:00")], "request_id long, window_km double, horizon_h int, start string").withColumn("start", F.to_timestamp("start"))
    pins = spark.createDataFrame([(1, 1, 0.0, 0.0)], "request_id long, pin_id long, x double, y double")
    assert validate_requests(req, pins, (0, 0, 1, 1), "2021-08-05 00:00:00").first()["error_code"] == code


def test_components_with_two_keys_stay_apart(spark):
    from hazardframe.operators import components as cc
    from hazardframe.operators import rings as rg

    rows = [(run, hour, r, c) for run, hour, r, c in [(1, 0, 9, 9), (1, 1, 9, 9), (1, 1, 9, 10), (2, 0, 9, 10), (2, 0, 1 << 21, 5), (1 << 30, 0, 9, 9)]]
    cells = spark.createDataFrame(rows, "run_id long, hour long, r long, c long")
    parts = cc.cell_components(cells, 8, ["run_id", "hour"])
    assert parts.select("comp").distinct().count() == 5
    assert {(r.run_id, r.hour) == (r.comp.run_id, r.comp.hour) for r in parts.collect()} == {True}
    rings = rg.boundary_rings(cells, ["run_id", "hour"])
    assert rings.select("ring_id").distinct().count() == 5 and rings.count() == 4 * 4 + 6


def test_negated_lists_name_nothing(spark):
    from hazardframe.functions import text as tx

    df = spark.createDataFrame([("No invented settlement names: Ροβιές, Δαμιά.",), ("Invented settlement names: Ροβιές, Δαμιά. No invented road names: Λίμνη.",), ("fine",), (None,)], "n string")
    assert [r.x for r in df.select(tx.extract_names("n").alias("x")).collect()] == [[], ["Ροβιές", "Δαμιά"], [], []]


def test_percentiles_by_position(spark):
    import random

    from pyspark.sql import functions as F

    from hazardframe.operators.common import aggregate_with_percentiles

    r = random.Random(1)
    rows = [(k, None if r.random() < 0.1 else float(r.randint(0, 9) if k < 2 else r.random())) for k in range(4) for _ in range(50 * k + 1)]
    df = spark.createDataFrame(rows + [(9, None)], "k int, v double")
    shares = {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}
    got = {x.k: x for x in aggregate_with_percentiles(df, ["k"], [F.count("v").alias("n")], F.col("v"), shares).collect()}
    want = df.groupBy("k").agg(*[F.percentile("v", F.lit(s)).alias(n) for n, s in shares.items()]).collect()
    for w in want:
        for n in shares:
            g = got[w.k][n]
            assert (g is None and w[n] is None) or abs(g - w[n]) < 1e-12
    assert aggregate_with_percentiles(df.limit(0), [], [F.count("v").alias("n")], F.col("v"), shares).first().n == 0


def test_overlay_routes_equal_routes_by_hops(spark):
    """Two runs, spans of hours, refuges that open and close, parallel edges, several groups of parts."""
    from hazardframe.operators import overlay as ov

    r = random.Random(2)
    nodes = spark.createDataFrame([(i, float(i % 12), float(i // 12)) for i in range(144)], "node_id long, x double, y double")
    plain = [(i, j, k, float(r.randint(1, 4))) for i in range(144) for j in (i + 1, i - 1, i + 12, i - 12) for k in (0, 1) if 0 <= j < 144 and r.random() < 0.5]
    spans, hourly = [], []
    for run in (7, 8):
        for u, v, k, cost in plain:
            pieces = [(ov.EVER, ov.NEVER, cost)]
            if (u * 5 + v + k + run) % 6 == 0:  # dearer from hour 1 on, cut at hour 3
                pieces = [(ov.EVER, 1, cost), (1, 3, 2 * cost)]
                spans += [(run, u, v, k, a, b, int(c * ov.UNIT), cost) for a, b, c in pieces]
            hourly += [(run, h, u, v, c) for a, b, c in pieces for h in range(4) if a <= h < b]
    edges = spark.createDataFrame([(u, v, k, c) for u, v, k, c in plain], "u long, v long, key long, length_m double")
    changed = spark.createDataFrame(spans, "run_id long, u long, v long, key long, a long, b long, cost long, length_m double")
    open_ = [(run, h, n, f) for run in (7, 8) for h in range(4) for n, f in ((5, 1), (140, 2), (77, 3), (77, 2), (61, 4)) if (n + run + h) % 3]
    seeds = spark.createDataFrame(open_, "run_id long, period int, node_id long, refuge_id long")
    names = ["run_id", "period", "node", "cost", "refuge_id", "next_hop"]
    costs = spark.createDataFrame(hourly, "run_id long, period int, u long, v long, cost double")
    want = sorted(map(str, net.route_all(costs, seeds, ["run_id", "period"]).select(*names).collect()))
    for size, group in ((20, 2), (1000, 1)):
        overlay = ov.Overlay(edges, changed, ov.network_parts(nodes, size, group), ["run_id"])
        got = sorted(map(str, ov.route(overlay, seeds).select(*names).collect()))
        assert got == want and len(got) > 900
    # Hour by hour; refuges close and open.
    overlay = ov.Overlay(edges, changed, ov.network_parts(nodes, 20, 2), ["run_id"])
    now = ov.route(overlay, seeds.filter("period = 0"))
    got = list(map(str, now.select(*names).collect()))
    for h in (1, 2, 3):
        now = ov.next_hour(overlay, now, seeds.filter(F.col("period") == h))
        got += list(map(str, now.select(*names).collect()))
    assert sorted(got) == want
    hop = spark.createDataFrame([(7, h, *plain[i][:2]) for h in range(4) for i in range(0, 60, 7)], "run_id long, period int, u long, v long")
    lengths = {(x.run_id, x.period, x.u, x.v): x.length_m for x in ov.at_hours(edges, changed, hop, ["run_id"]).collect()}
    open_at = {(run, h, u, v) for run, h, u, v, _ in hourly}
    shut = {(run, u, v, k) for run, u, v, k, *_ in spans}
    for x in hop.collect():
        own = [c for u, v, k, c in plain if (u, v) == (x.u, x.v) and ((7, u, v, k) not in shut or x.period < 3)]
        assert lengths.get((7, x.period, x.u, x.v)) == (min(own) if (7, x.period, x.u, x.v) in open_at else None)


def test_steady_detections_form_passes(spark):
    from hazardframe.operators import detections as dt

    rows = [(i, f"2021-08-05 {i // 60:02d}:{i % 60:02d}:00") for i in range(0, 1440, 7)]
    df = spark.createDataFrame(rows, "det_id int, t string").selectExpr("det_id", "cast(t as timestamp) AS t")
    got = {r.det_id: r.pass_t.hour * 60 + r.pass_t.minute for r in dt.group_passes(df).collect()}
    anchor, want = None, {}
    for i, _ in rows:
        anchor = i if anchor is None or i - anchor > 20 else anchor
        want[i] = anchor
    assert got == want


def test_a_day_without_gaps_forms_passes(spark):
    """Two satellites, one with a detection every second or two all day."""
    r = random.Random(9)
    times = {1: sorted(r.sample(range(86_400), 50_000)), 2: sorted(r.sample(range(86_400), 150))}
    rows = [(k, i, s) for k, own in times.items() for i, s in enumerate(own)]
    df = spark.createDataFrame(rows, "sat int, det_id int, s long").selectExpr("sat", "det_id", "timestamp_seconds(1628121600 + s) AS t")
    got = {(x.sat, x.det_id): x.p - 1628121600 for x in dt.group_passes(df, 20, ["sat"]).selectExpr("sat", "det_id", "cast(pass_t AS long) AS p").collect()}
    want = {}
    for k, own in times.items():
        anchor = None
        for i, s in enumerate(own):
            anchor = s if anchor is None or s - anchor > 1200 else anchor
            want[k, i] = anchor
    assert got == want


def test_features_of_many_collections_are_all_read_back(spark):
    path = scratch_path(spark, "collections")
    points = spark.range(0, 95, 1, 2).select("id", F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    wr.write_geojson(wr.geojson_features(points, "x", "y"), path, batch=5)
    assert rd.read_features(spark, path).count() == 95


def test_packed_files_are_not_taken_for_small_tables(spark):
    size_files_as_rows(spark)
    df = materialise(spark.range(0, 400_000, 1, 4).selectExpr("struct(id % 7 AS k, id AS r) AS id"), "packed")
    assert estimated_bytes(df) > 400_000 * 16  # two longs a row, though the files take a fraction of that


def test_components_use_whole_numbers_and_name_the_first_cell(spark, monkeypatch):
    met = []
    inner = cc.components
    monkeypatch.setattr(cc, "components", lambda e: met.append(dict(e.dtypes)) or inner(e))
    cells = [("b", 0, 0), ("b", 0, 1), ("b", 1, 2), ("b", 5, 5), ("a", 1, 1), ("a", 0, 2), ("a", 0, 4)]
    got = cc.cell_components(spark.createDataFrame(cells, "run_id string, r long, c long"), 8).collect()
    assert {(r.run_id, r.r, r.c): tuple(r.comp) for r in got} == {
        ("b", 0, 0): ("b", 0, 0), ("b", 0, 1): ("b", 0, 0), ("b", 1, 2): ("b", 0, 0), ("b", 5, 5): ("b", 5, 5),
        ("a", 1, 1): ("a", 0, 2), ("a", 0, 2): ("a", 0, 2), ("a", 0, 4): ("a", 0, 4)}
    assert met == [{"u": "bigint", "v": "bigint"}]


def test_a_run_is_one_file_and_other_runs_are_kept(spark, tmp_path):
    cells = spark.range(0, 400, 1, 4).selectExpr("id % 2 AS run_id", "id % 40 AS period", "id AS c")
    wr.write_run({"cells": cells}, str(tmp_path))
    assert len(list((tmp_path / "cells").rglob("*.parquet"))) == 2
    wr.write_run({"cells": cells.filter("run_id = 1").withColumn("c", -F.col("c"))}, str(tmp_path), "overwrite")
    got = [rd.read_run(spark, str(tmp_path), i, "cells", "period bigint, c bigint, run_id bigint").selectExpr("count(*)", "sum(c)").first() for i in (0, 1)]
    assert [tuple(r) for r in got] == [(200, 39800), (200, -40000)]


def test_parts_of_a_long_narrow_network_have_few_border_nodes(spark):
    from hazardframe.operators import overlay as ov

    nodes = spark.range(10 * 400).selectExpr("id AS node_id", "CAST(id % 10 AS DOUBLE) AS x", "CAST(id DIV 10 AS DOUBLE) AS y")
    place = {r.node: (r.part, r.grp) for r in ov.network_parts(nodes, 100, 4).collect()}
    border = [i for i in place for j in (i + 1, i - 1, i + 10, i - 10) if j in place and abs(j % 10 - i % 10) <= 1 and place[j][0] != place[i][0]]
    assert len(place) == 4000 and len(set(border)) < 1600
    groups = {}
    for part, grp in place.values():
        groups.setdefault(part, set()).add(grp)
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == 10


def test_rings_over_many_blocks_equal_rings_of_one_block(spark, monkeypatch):
    """Blocks of five sides: rings leave them, close inside them and start in the middle of a stretch."""
    r = random.Random(4)
    cells = [(run, i, j) for run in (1, 2) for i in range(14) for j in range(14) if r.random() < 0.6]
    df = spark.createDataFrame(cells, "run_id long, r long, c long")
    names = ["run_id", "ring_id", "seq", "n_ring", "area2", "ar", "ac", "br", "bc"]
    rows = lambda block: sorted(map(str, rg.boundary_rings(df, exterior_only=False, block=block).select(*names).collect()))
    assert rows(5) == rows(1 << 16)
    # One block needs no rounds of doubling.
    labels = []
    inner = rg.materialise_observed
    monkeypatch.setattr(rg, "materialise_observed", lambda d, label, **m: labels.append(label) or inner(d, label, **m))
    got = rg.boundary_rings(df, exterior_only=False).collect()
    assert not labels
    ends = {}
    for x in got:
        ends.setdefault((x.run_id, tuple(x.ring_id)), {})[x.seq] = (x.ar, x.ac, x.br, x.bc, x.n_ring)
    for ring in ends.values():
        n = len(ring)
        assert sorted(ring) == list(range(n)) and all(ring[i][4] == n and ring[i][2:4] == ring[(i + 1) % n][:2] for i in range(n))


def test_rows_are_dealt_evenly_whatever_their_splits_hold(spark):
    from hazardframe.operators.common import spread

    lopsided = spark.range(0, 4000, 1, 1).repartition(16, F.lit(0))  # as many splits as wanted, all rows in one
    sizes = [len(p) for p in spread(lopsided, 200).rdd.glom().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 300


def test_points_in_rings_against_every_pair(spark, monkeypatch):
    """Rings with many and few segments in a band, buckets wholly inside, points on sides and corners."""
    monkeypatch.setattr(sp, "RING_SEGMENTS", 8)
    r, rings = random.Random(11), {}
    for k in range(14):
        cx, cy, size, n = r.uniform(-900, 900), r.uniform(-900, 900), r.uniform(30, 900), r.choice([3, 4, 7, 40])
        rings[k] = [(cx + size * r.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + size * r.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    rings[20] = [(-500.0, -500.0), (500.0, -500.0), (500.0, 500.0), (-500.0, 500.0)]
    segs = [(k, *a, *b) for k, ring in rings.items() for a, b in zip(ring, [*ring[1:], ring[0]])]
    points = [(i, r.uniform(-1200, 1200), r.uniform(-1200, 1200)) for i in range(300)] + [(1000, 500.0, 0.0), (1001, 500.0, 500.0), (1002, 0.0, -500.0), (1003, 250.0, 250.0), (1004, 0.0, 0.0)]

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
            if min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) and (x2 - x1) * (y - y1) == (x - x1) * (y2 - y1):
                return False
        return odd

    want = sorted((i, k) for i, x, y in points for k, ring in rings.items() if inside(x, y, ring))
    got = sp.points_in_rings(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(segs, "ring_id int, x1 double, y1 double, x2 double, y2 double"), "id", 200.0)
    assert sorted((x.id, x.ring_id) for x in got.collect()) == want


def test_shortest_path_of_many_hops_in_few_rounds(spark, monkeypatch):
    """A long ladder with equal ways and a detour; its hops are many times the tables written."""
    monkeypatch.setattr(ov, "PART_NODES", 60)
    n = 600
    links = [(i, i + 2, 0, 10.0) for i in range(2 * n - 2)] + [(i, i + 1, 0, 1.0) for i in range(0, 2 * n, 2)] + [(0, 2, 1, 9.5), (5, 1, 0, 1.0)]
    edges = spark.createDataFrame(links, "u long, v long, key long, length_m double")
    nodes = spark.createDataFrame([(i, float(i % 2), float(i // 2)) for i in range(2 * n)] + [(9999, 5.0, 5.0)], "node_id long, x double, y double")
    before = len(CREATED)
    got = ov.shortest_path(edges, nodes, 0, 2 * n - 1).orderBy("seq").collect()
    assert [x.seq for x in got] == list(range(n)) and got[0].u == 0 and got[-1].v == 2 * n - 1
    assert all(a.v == b.u for a, b in zip(got, got[1:])) and sum(x.length_m for x in got) == 9.5 + 10.0 * (n - 2) + 1.0
    assert len(CREATED) - before < n / 6
    assert ov.shortest_path(edges, nodes, 9999, 2 * n - 1).count() == 0


@pytest.mark.parametrize("table", [1 << 20, 5])
def test_bootstrap_sums_are_those_of_the_picked_cases(spark, monkeypatch, table):
    """Draws against their picks one by one, by a table of the cases and by each case's own places; bounded work."""
    monkeypatch.setattr(rn, "TABLE_CASES", table)
    monkeypatch.setattr(rn, "PLACES", 1000)
    monkeypatch.setattr(rn, "_PRIME", 65537)  # a small prime: stretches of places wrap and overlap, and cases outnumber none or all
    r = random.Random(4)
    for n, draws in ((7, 3), (400, 300), (70_000, 4)):
        cases = [(i, r.randint(0, 3), r.randint(3, 6)) for i in range(n)]
        if table > n > 1000 or table < n < 100:
            continue
        got = rn._sums_of_draws(spark.createDataFrame(cases, "_i long, num long, den long").repartition(3), n, draws, 7)
        m = 65537

        def mixed(*parts):
            x = 0
            for p in parts:
                x = (x * 48271 + p % m * 69621 + 12345) % m * 16807 % m
            return x

        want = []
        for d in range(draws):
            at = [mixed(7, d, k) % n for k in range(n)]
            want.append((d, sum(cases[i][1] for i in at), sum(cases[i][2] for i in at)))
        assert got == want


def test_bootstrap_of_many_draws_and_no_cases(spark):
    rows = spark.range(3000).select(F.concat(F.lit("c"), F.col("id") % 1000).alias("case_id"), (F.col("id") % 7 > 2).alias("ok"))
    got = rn.cluster_bootstrap(rows, "ok", 2000, 7).first()
    assert got.lower < 4 / 7 < got.upper and got.upper - got.lower < 0.05
    assert tuple(rn.cluster_bootstrap(rows.limit(0), "ok", 2000, 7).first()) == (None, None)
