"""Exposure, refuge pools, outcomes and hourly summaries of an evacuation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.functions.clock import period_ts
from hazardframe.operators import spatial as sp
from hazardframe.operators.cells import Grid
from hazardframe.operators.common import attach_all, global_rank, materialise

AT_RISK_M = 300.0
SAFE_MARGIN_M = 500.0


def all_settlements(official: DataFrame, osm: DataFrame) -> DataFrame:
    """Both sources on one schema, without de-duplication."""
    return official.unionByName(osm, allowMissingColumns=True)


def refuge_pool(osm: DataFrame, safe_official: DataFrame) -> DataFrame:
    """Places from the map plus the safe official settlements."""
    a = osm.withColumn("source", F.lit("osm"))
    b = safe_official.withColumn("source", F.lit("official"))
    return a.unionByName(b, allowMissingColumns=True)


def exposure(settlements: DataFrame, zone: DataFrame, fire: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Hour each settlement first comes within 300 m of the danger zone (``risk_at``) and
    first lies inside the fire (``hit_at``). Settlements never at risk do not appear."""
    sid = ["settlement_id"]
    risk = sp.near_arrival(settlements, zone, grid, AT_RISK_M, sid, keys).withColumnRenamed("arrival", "risk_at")
    hit = sp.inside_arrival(settlements, fire, grid, sid, keys).withColumnRenamed("arrival", "hit_at")
    return risk.join(hit, [*keys, *sid], "left")


def at_risk_by_period(exposed: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """One row per hour and settlement at risk, with the flag ``impacted``."""
    last = periods.groupBy(*keys).agg(F.max("period").alias("_last"))
    e = exposed.join(last, keys) if keys else attach_all(exposed, last)
    e = e.filter(F.col("risk_at") <= F.col("_last")).withColumn("period", F.explode(F.sequence("risk_at", "_last")))
    return e.select(*keys, "period", "settlement_id", F.coalesce(F.col("hit_at") <= F.col("period"), F.lit(False)).alias("impacted"))


def unsafe_refuges(pool: DataFrame, zone: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Hour from which each refuge lies within 500 m of the danger zone."""
    return sp.near_arrival(pool, zone, grid, SAFE_MARGIN_M, ["refuge_id"], keys).withColumnRenamed("arrival", "unsafe_at")


def eligible_refuges(pool: DataFrame, zone: DataFrame, periods: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Refuges of each hour that are not within 500 m of that hour's danger zone."""
    hours = periods.groupBy(*keys).agg(F.collect_set("period").alias("_h"))
    out = attach_all(pool, hours).withColumn("period", F.explode("_h")).drop("_h")
    out = out.join(unsafe_refuges(pool, zone, grid, keys), [*keys, "refuge_id"], "left")
    return out.filter(F.col("unsafe_at").isNull() | (F.col("unsafe_at") > F.col("period"))).drop("unsafe_at")


def open_refuges(settlements: DataFrame, refuges: DataFrame, nodes: DataFrame, zone: DataFrame, exposed: DataFrame,
                 periods: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """Refuge nodes of each hour: map places and official settlements that are safe then.

    Official settlements carry the id -(settlement_id + 1). Snapping to the network does
    not depend on the hour and is done once; the closest refuge of a node is kept.
    """
    official = settlements.filter("source = 'official'").select((-F.col("settlement_id") - 1).alias("refuge_id"), "x", "y")
    pool = refuges.select("refuge_id", "x", "y").unionByName(official)
    node_pts = nodes.select(F.col("node_id").alias("tid"), "x", "y")
    snapped = materialise(sp.nearest(pool, node_pts, ["refuge_id"]).select("refuge_id", "x", "y", F.col("tid").alias("node_id"), "dist"), "pool")
    open_ = eligible_refuges(snapped, zone, periods, grid, keys)
    risky = exposed.select(*keys, (-F.col("settlement_id") - 1).alias("refuge_id"), "risk_at")
    open_ = open_.join(risky, [*keys, "refuge_id"], "left").filter(F.col("risk_at").isNull() | (F.col("risk_at") > F.col("period")))
    return sp.dedupe_snaps(open_.select(*keys, "period", "node_id", "refuge_id", "dist"), [*keys, "period"])


def hourly_summary(outcome: DataFrame, cuts: DataFrame, fire: DataFrame, t0=None, keys: list[str] | None = None) -> DataFrame:
    """One row per hour: fire area, at risk, people, counts by status, removed edges, longest route.

    ``fire`` (keys, period, fire_km2) lists the hours; ``cuts`` has keys, cut_at per edge.
    """
    keys = list(keys or [])
    k = [*keys, "period"]
    st = F.col("status")
    a = outcome.groupBy(*k).agg(
        F.count("*").alias("at_risk"), F.sum(F.coalesce("pop", F.lit(0))).alias("population"),
        F.count_if(st == "ok").alias("routed"), F.count_if(st == "cut_off").alias("cut_off"),
        F.count_if(st == "impacted").alias("impacted"), F.round(F.max("length_m") / 1000, 2).alias("longest_route_km"),
    )
    new = cuts.groupBy(*keys, F.col("cut_at").alias("period")).agg(F.count("*").alias("_new"))
    w = W.partitionBy(*keys).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    out = fire.join(a, k, "left").join(new, k, "left")
    out = out.withColumn("edges_removed", F.sum(F.coalesce("_new", F.lit(0))).over(w)).drop("_new")
    out = out.fillna(0, ["at_risk", "population", "routed", "cut_off", "impacted"])
    if t0 is not None:
        out = out.withColumn("time_utc", period_ts(F.lit(t0).cast("timestamp"), "period"))
    return out


def rank_exposed(outcome: DataFrame) -> DataFrame:
    """Settlements by population, largest first, unknown last."""
    return outcome.orderBy(F.col("pop").desc_nulls_last(), F.col("settlement_id"))


def with_rank(exposed: DataFrame) -> DataFrame:
    """Position of each settlement in the population order."""
    return global_rank(exposed, [F.col("pop").desc_nulls_last(), F.col("settlement_id")])


def hourly_events(outcome: DataFrame, summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What changed since the hour before: new risks, lost and regained routes, refuge changes, road closures."""
    keys = list(keys or [])
    k = [*keys, "settlement_id"]
    w = W.partitionBy(*k).orderBy("period")
    here = F.struct("period", "status", "refuge_id")
    o = outcome.withColumn("_p", F.lag(here).over(w))
    o = o.withColumn("_p", F.when(F.col("_p.period") == F.col("period") - 1, F.col("_p")))
    st, ps = F.col("status"), F.col("_p.status")
    kind = (
        F.when(F.col("_p").isNull() & (st == "ok"), "at_risk_ok")
        .when(F.col("_p").isNull() & (st == "cut_off"), "at_risk_cut")
        .when(F.col("_p").isNull(), "at_risk_impacted")
        .when((ps != "cut_off") & (st == "cut_off"), "cut_off")
        .when((ps == "cut_off") & (st == "ok"), "reaccessible")
        .when((st == "ok") & F.col("_p.refuge_id").isNotNull() & F.col("refuge_id").isNotNull() & (F.col("refuge_id") != F.col("_p.refuge_id")), "refuge_change")
    )
    ev = o.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(*keys, "period", "kind", "settlement_id", F.lit(None).cast("long").alias("n"))
    ws = W.partitionBy(*keys).orderBy("period")
    d = F.col("edges_removed") - F.lag("edges_removed").over(ws)
    road = summary.withColumn("n", d).filter(F.col("n") > 0).select(*keys, "period", F.lit("road").alias("kind"), F.lit(None).cast("long").alias("settlement_id"), F.col("n").cast("long"))
    return ev.unionByName(road)


def scenario_deltas(outcome: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Route length changes and access losses between consecutive hours present per settlement."""
    keys = list(keys or [])
    w = W.partitionBy(*keys, "settlement_id").orderBy("period")
    o = outcome.select(*keys, "settlement_id", "period", "status", "refuge_id", "route_km",
                       F.lag(F.struct("period", "status", "refuge_id", "route_km")).over(w).alias("_p"))
    both = (F.col("status") == "ok") & (F.col("_p.status") == "ok")
    lost = (F.col("_p.status") == "ok") & F.col("status").isin("cut_off", "impacted")
    return o.filter(both | lost).select(
        *keys, "settlement_id", F.col("_p.period").alias("from_period"), "period",
        F.when(both, F.round(F.col("route_km") - F.col("_p.route_km"), 2)).alias("delta_km"),
        F.when(both, F.col("refuge_id") != F.col("_p.refuge_id")).alias("refuge_changed"),
        F.when(lost, F.col("status")).alias("lost_to"),
    )


def settlement_evac_hour(settlements: DataFrame, outcome: DataFrame, summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every settlement with the first hour it was at risk, and that hour's local time."""
    from hazardframe.functions.clock import fmt_local

    keys = list(keys or [])
    first = outcome.groupBy(*keys, "settlement_id").agg(F.min("period").alias("evac_hour"))
    t = summary.select(*keys, F.col("period").alias("evac_hour"), "time_utc")
    out = settlements.join(first, "settlement_id", "left").join(t, [*keys, "evac_hour"], "left")
    return out.withColumn("evac_local", fmt_local("time_utc")).drop("time_utc")


def flag_route_edges(edges: DataFrame, path: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges used by some route, with the first hour."""
    keys = list(keys or [])
    used = path.groupBy(*keys, "u", "v").agg(F.min("period").alias("first_hour"))
    return edges.join(used, [*keys, "u", "v"], "left").withColumn("on_route", F.col("first_hour").isNotNull())


def status_at(outcome: DataFrame, hour: int) -> DataFrame:
    return outcome.filter(F.col("period") == hour)


def join_outcome_routes(outcome: DataFrame, routes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Outcomes that disagree with the drawn routes (one row per route): ``ok`` goes with a refuge, a
    length and exactly one route, any other status with none of them. A route of no length is not drawn."""
    keys = list(keys or [])
    k = [*keys, "period", "settlement_id"]
    n = routes.groupBy(*k).agg(F.count("*").alias("n_routes"))
    j = outcome.join(n, k, "left").withColumn("n_routes", F.coalesce("n_routes", F.lit(0)))
    refuge, length = F.col("refuge_id").isNotNull(), F.col("length_m").isNotNull()
    whole = refuge & length & (F.col("n_routes") == F.when(F.col("length_m") > 0, 1).otherwise(0))
    bad = F.when(F.col("status") == "ok", ~whole).otherwise(refuge | length | (F.col("n_routes") > 0))
    return j.filter(bad).select(*k, "status", "n_routes")


def drawn_routes(path: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per route that has a line: the first hop of each path."""
    return path.filter("seq = 0").select(*(keys or []), "period", F.col("origin_id").alias("settlement_id"))


def c2_monotone(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hours at which fewer edges are removed than the hour before."""
    w = W.partitionBy(*(keys or [])).orderBy("period")
    prev = F.lag("edges_removed").over(w)
    return summary.withColumn("prev_removed", prev).filter(F.col("edges_removed") < F.col("prev_removed"))
