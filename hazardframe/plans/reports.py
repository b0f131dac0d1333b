"""Reports over stored run records, and the guards that protect them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions import answers as an
from hazardframe.functions import text as tx
from hazardframe.functions.base import col
from hazardframe.operators import runs as rn
from hazardframe.operators.common import require_empty


def structured_diagnostics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Schema-valid and slot-clean shares, transition recall and precision, in percent."""
    s = F.col("ct_scored")
    ok = F.col("contract_outcome").isin("valid", "validator_invalid")
    part = lambda c: F.sum(F.when(s, F.col(c)))
    return scored.groupBy(*keys).agg(
        F.round(100.0 * F.count_if(ok) / F.count("*"), 2).alias("schema_pct"), F.round(100.0 * F.count_if(ok & (F.size("mm") == 0)) / F.count("*"), 2).alias("slot_clean_pct"),
        F.round(100.0 * part("ct.matched") / F.nullif(part("ct.n_gt"), F.lit(0)), 2).alias("recall_pct"), F.round(100.0 * part("ct.matched") / F.nullif(part("ct.n_emitted"), F.lit(0)), 2).alias("precision_pct"),
    )


def audit_tables(claims: DataFrame, meta: DataFrame) -> DataFrame:
    """Records and claims per category and audit tier."""
    t = rn.audit_tiers(claims).join(meta.select("uid", "category"), "uid")
    return t.groupBy("category", "tier").agg(F.count("*").alias("records"), F.sum("n_claims").alias("claims"))


def stage_c_cases(cases: DataFrame, must: str = "must_call_tool") -> DataFrame:
    """Cases that need a tool call and are no invalid input."""
    return cases.filter(F.col(must) & (F.col("category") != "invalid_input"))


def clean_places(df: DataFrame, names: list[str], population: str = "population") -> DataFrame:
    """First non-empty name, unnamed places dropped, bad populations null."""
    name = F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])
    out = df.withColumn("name", name).filter(F.col("name").isNotNull())
    return out.withColumn(population, tx.parse_population(population))


def refuse_marked(df: DataFrame, marker: str, allow: bool = False) -> DataFrame:
    """Refuse a table whose column names or text cells carry the rehearsal marker."""
    if allow:
        return df
    if any(marker in c for c in df.columns):
        raise ValueError("a column name carries the rehearsal marker")
    texts = [c for c, t in df.dtypes if t == "string"]
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit(marker)), F.lit(False))
    require_empty(df.filter(hit).select(*texts[:1]), "rows carry the rehearsal marker")
    return df


def assert_columns(df: DataFrame, allow: list[str], forbid: list[str]) -> DataFrame:
    """Only the named columns, none with a forbidden prefix."""
    bad = [c for c in df.columns if c not in allow or any(c.startswith(f) for f in forbid)]
    if bad:
        raise ValueError(f"columns not allowed here: {bad}")
    return df


def resolve_sources(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Each criterion from its first usable column; empty cells fall through to the next.

    ``<criterion>_provisional`` tells that the preferred column is absent.
    """
    for name, options in wanted.items():
        have = [c for c in options if c in df.columns]
        if not have:
            df = df.withColumn(name, F.lit(None).cast("string")).withColumn(f"{name}_provisional", F.lit(True))
            continue
        df = df.withColumn(name, F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in have]))
        df = df.withColumn(f"{name}_provisional", F.lit(have[0] != options[0]))
    return df


def frozen_reason(path, folders: list[str], prefixes: list[str]) -> Column:
    """Why a path is protected, or null."""
    p = col(path)
    out = F.when(F.lit(False), "")
    for f in folders:
        out = out.when(F.contains(p, F.lit(f"/{f}/")), f"folder {f}")
    for x in prefixes:
        out = out.when(p.startswith(x), f"prefix {x}")
    return out


def rescore(rows: DataFrame) -> DataFrame:
    """Gate recomputed from stored rows and whether it changed."""
    fault = an.score_calls("n_tool_calls", "must")
    out = rows.withColumn("gate", fault.isNull() & F.col("policy_ok"))
    return out.withColumn("changed", F.col("gate") != F.col("stored_gate"))


def evaluation_report(rows: DataFrame, checks: list[str], verdict: str, keys: list[str]) -> dict[str, DataFrame]:
    """Rates by key and category, and value counts of the checks."""
    return {
        "rates": rn.pass_rates(rows, verdict, keys), "categories": rn.category_rates(rows, checks, verdict, [*keys, "category"]),
        "counts": rn.value_counts(rows, [*keys, *checks]),
    }


def prep_labeling(rows: DataFrame, surface: str, has_payload: Column, order: list[str], size: int) -> DataFrame:
    """Narrated rows with their atomic claims, in batches of fixed size."""
    kept = rows.filter(an.narrated("n_tool_calls", has_payload, F.col(surface))).withColumn("claims", tx.atomic_claims(surface))
    return rn.assign_batches(kept, size, order)


def full_system(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Deterministic gate, judged text and coverage joined into one bounded rate."""
    r = rows.withColumn("det", an.deterministic_pass("stage_a_ok", "stage_b_ok", "numeric_ok", F.lit(0), F.lit(None)))
    r = r.withColumn("full_ok", an.full_system("det", "stage_c", "coverage"))
    more = r.groupBy(*keys).agg(F.count("*").alias("reps"), F.count_if(F.col("stage_c").isNull()).alias("c_pending"))
    return rn.bounds(r, "full_ok", keys).drop("upper").join(more, keys)


def arm_report(rows: DataFrame, verdict: str, criteria: list[str], keys: tuple = ("model",)) -> dict[str, DataFrame]:
    k = list(keys)
    return {
        "pairs": rn.pair_arms(rows, [*k, "case_id", "rep"]), "cells": rn.rate_cell(rows, verdict, "case", [*k, "arm"]),
        "comparison": rn.comparison_table(rows, criteria, k), "discordance": rn.discordance(rows, verdict, k),
        "flips": rn.flip_attribution(rows, verdict, criteria, k), "failures": rn.failure_attribution(rows, verdict, criteria), "variants": rn.variants(rows, verdict, [*k, "arm"]),
    }


def v3_aggregate(rows: DataFrame, verdict: str, keys: tuple = ("model",)) -> dict[str, DataFrame]:
    d = rn.discordance(rows, verdict, list(keys)).withColumn("p", rn.sign_test("b", "c"))
    return {"cells": rn.v3_cells(rows, verdict), "paired": d, "categories": rn.category_rates(rows, [], verdict, ["category", "arm"])}


def gold_events(parsed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Events a narration must convey, from payload and profile, and the profile's problems.

    ``parsed`` has the key, the typed payload ``p`` and ``profile`` (list of items).
    """
    rises = an.cutoff_events(F.col("p"))
    hit = F.try_element_at(F.filter("p.rows", lambda r: r["impacted"] > 0), F.lit(1))["period"]
    x = parsed.withColumn("_rises", rises).withColumn("_hit", hit).select(key, "p", "_rises", "_hit", F.explode("profile").alias("item"))
    i, r = F.col("item"), F.col("_rises")
    rise_at = F.regexp_extract("item", r"^rise:(\d+)$", 1).try_cast("bigint")
    eid = (
        F.when((i == "escalation") & (F.size(r) > 0), "E_ESCALATION").when(rise_at.isNotNull() & F.array_contains(r, rise_at), F.concat(F.lit("E_RISE_"), rise_at.cast("string")))
        .when((i == "first_impacted") & F.col("_hit").isNotNull(), "E_FIRST_IMPACTED").when(i == "final", "E_FINAL")
        .when((i == "weather") & (F.col("p.weather_source") == "forecast"), "E_WEATHER_FORECAST").when(i == "fronts_multi", "E_FRONTS_MULTI")
        .when(i == "fronts_single", "E_FRONTS_SINGLE").when(i == "class4", "E_CLASS4").when(i == "nospread", "E_NOSPREAD")
    )
    lo, hi = F.array_min(r).cast("string"), F.array_max(r).cast("string")
    path = (
        F.when(i == "escalation", F.concat(F.lit("change_hours[period="), lo, F.lit(".."), hi, F.lit("].cut_off")))
        .when(rise_at.isNotNull(), F.concat(F.lit("change_hours[period="), rise_at.cast("string"), F.lit("].cut_off")))
        .when(i == "first_impacted", F.concat(F.lit("change_hours[period="), F.col("_hit").cast("string"), F.lit("].impacted")))
        .when(i == "final", "final_hour.cut_off, final_hour.at_risk").when(i == "weather", "inputs.weather_source")
        .when(i.isin("fronts_multi", "fronts_single"), "inputs.n_fronts_detected").when(i == "class4", "final_front_class4_pct")
        .when(i == "nospread", "change_hours[period=0], final_hour.at_risk, final_hour.cut_off")
    )
    kind = (
        F.when(i.isin("final", "nospread"), "final_outcome").when(i.isin("weather", "fronts_multi", "fronts_single", "class4"), "policy_disclosure").otherwise("transition")
    )
    all_ = x.select(key, "item", eid.alias("event_id"), kind.alias("kind"), path.alias("source_path"))
    return all_.filter("event_id IS NOT NULL").drop("item"), all_.filter("event_id IS NULL").select(key, "item")


def judge_inputs(parsed: DataFrame, seed: int, order: Column | None = None, key: str = "record_id") -> DataFrame:
    """Blinded record texts: delivered text and payload figures under an opaque id."""
    t = parsed.withColumn("judged_text", an.judged_text("reply", "arm", F.col("a"))).withColumn("sheet", an.number_sheet(F.col("p")))
    out = rn.blind(t.select(key, "judged_text", "sheet"), "R", seed, order, key)
    body = F.concat_ws("\n", F.lit("## ANSWER"), "judged_text", F.lit("## PAYLOAD"), "sheet")
    return out.withColumn("record_text", body)


def result_card(p: Column) -> Column:
    return F.format_string("Final hour %d: %d of %d cut off, %d roads removed", p["final"]["period"], p["final"]["cut_off"], p["final"]["at_risk"], p["final"]["edges"])


def params_card(run_id, start, window_km, horizon_h) -> Column:
    return F.format_string("Run %s: start %s UTC, window %s km, horizon %d h", col(run_id), F.date_format(col(start), "yyyy-MM-dd HH:mm"), col(window_km), col(horizon_h))
