"""Structured final answers: parsing, contract outcome, slots, transitions, verdicts.

JSON is read as VARIANT, so types stay strict (``true`` is not 1) and nothing is repaired.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardframe.functions.base import col
from hazardframe.functions.text import matches, norm_num

SLOTS = ("initial_state", "critical_transitions", "final_state")
# Reply that marks the round ceiling, statuses, error banners, surface size.
ROUND_CEILING = "Σταμάτησα - πολλές διαδοχικές κλήσεις εργαλείου."
STATUSES = ["ok", "tool_error", "insufficient_input", "abstained"]
BANNERS = ("INPUT ERROR", "PIPELINE ERROR")
SURFACE_MIN_CHARS = 120
SAMPLE_MIN_CHARS = 200
# Sentences of the slot renderer.
SAY_INITIAL = "Στην έναρξη (ώρα %d): %d οικισμοί χωρίς καμία διαδρομή διαφυγής."
SAY_TRANSITION = "Στην ώρα %d: %d οικισμοί χωρίς καμία διαδρομή διαφυγής."
SAY_FINAL = "Τελική ώρα %d: %d οικισμοί χωρίς καμία διαδρομή διαφυγής, %d οδικά τμήματα αφαιρέθηκαν."
SAY_STATUS = "Το εργαλείο δεν παρήγαγε αποτέλεσμα: %s."

EMPTY_INTS = "cast(array() as array<bigint>)"


def parse_reply(text) -> Column:
    """The reply as an object, or null; no repair of any kind."""
    v = F.try_parse_json(col(text))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def pick_payload(outputs, which: str = "last") -> Column:
    """Last (or first) tool output that is a JSON object and no error banner.

    The last parseable output decides in the ``last`` form, even when it is no object.
    """
    usable = F.filter(col(outputs), lambda o: ~(o.startswith(BANNERS[0]) | o.startswith(BANNERS[1])) & F.try_parse_json(o).isNotNull())
    if which == "last":
        return parse_reply(F.try_element_at(usable, F.lit(-1)))
    objects = F.filter(usable, lambda o: F.schema_of_variant(F.try_parse_json(o)).startswith("OBJECT"))
    return F.try_parse_json(F.try_element_at(objects, F.lit(1)))


def vint(v: Column, path: str) -> Column:
    """Integer at a path; null for anything else, booleans and numeric texts included."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def vstr(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def slot(v: Column, name: str) -> Column:
    """Entries of a slot as (is object, period, settlements, roads, exact keys); null when no list."""
    at = F.try_variant_get(v, f"$.{name}", "array<variant>")
    n_keys = 3 if name == "final_state" else 2

    def entry(e: Column) -> Column:
        shape = F.schema_of_variant(e)
        return F.struct(
            shape.startswith("OBJECT").alias("is_obj"), vint(e, "$.period").alias("period"),
            vint(e, "$.settlements_without_route").alias("cut"), vint(e, "$.road_segments_removed").alias("roads"),
            (F.size(F.split(shape, ": ")) - 1 == n_keys).alias("exact"),
        )

    return F.transform(at, entry)


def answer_of(v: Column) -> Column:
    """Typed view of a parsed structured reply; null when there is none."""
    top = F.try_variant_get(v, "$", "map<string,variant>")
    return F.when(v.isNotNull(), F.struct(
        vstr(v, "$.status").alias("status"), *[slot(v, s).alias(s) for s in SLOTS],
        vstr(v, "$.interpretation").alias("interpretation"), vstr(v, "$.limitations").alias("limitations"),
        F.size(F.map_keys(top)).alias("n_keys"),
    ))


def payload(v: Column) -> Column:
    """Typed view of a tool payload."""
    rows = F.transform(F.coalesce(F.try_variant_get(v, "$.change_hours", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda r: F.struct(
        vint(r, "$.period").alias("period"), F.coalesce(vint(r, "$.cut_off"), F.lit(0)).alias("cut_off"), F.coalesce(vint(r, "$.impacted"), F.lit(0)).alias("impacted")))
    return F.struct(
        v.isNotNull().alias("present"), rows.alias("rows"),
        F.struct(vint(v, "$.final_hour.period").alias("period"), vint(v, "$.final_hour.cut_off").alias("cut_off"),
                 vint(v, "$.final_hour.at_risk").alias("at_risk"), vint(v, "$.final_hour.edges_removed").alias("edges")).alias("final"),
        vstr(v, "$.inputs.weather_source").alias("weather_source"), vint(v, "$.inputs.n_fronts_detected").alias("n_fronts"),
        F.try_variant_get(v, "$.final_front_class4_pct", "double").alias("class4"),
    )


def cutoff_events(p: Column) -> Column:
    """Hours of the payload's change rows whose cut-off count exceeds the row before."""
    rows = p["rows"]
    idx = F.filter(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1))), lambda i: (i > 1) & (F.try_element_at(rows, i)["cut_off"] > F.try_element_at(rows, F.greatest(i - 1, F.lit(1)))["cut_off"]))
    return F.transform(idx, lambda i: F.try_element_at(rows, i)["period"])


def entry_periods(entries: Column) -> Column:
    """Emitted hours in order; null when an entry is no object with an integer period."""
    ok = F.forall(entries, lambda e: e["is_obj"] & e["period"].isNotNull())
    return F.when(entries.isNotNull() & ok, F.transform(entries, lambda e: e["period"]))


def slot_mismatches(a: Column, p: Column) -> Column:
    """Slot values that differ from the payload (an hour the payload lacks counts as null)."""

    def at(period: Column) -> Column:
        return F.try_element_at(F.filter(p["rows"], lambda r: r["period"] == period), F.lit(1))["cut_off"]

    def pairs(name: str) -> Column:
        def one(e: Column) -> Column:
            return F.array(F.struct(F.lit(name).alias("slot"), e["period"].alias("period"), F.lit("settlements_without_route").alias("field"), e["cut"].alias("emitted"), at(e["period"]).alias("payload")))

        def last(e: Column) -> Column:
            here = p["final"]["period"] == e["period"]
            return F.array(
                F.struct(F.lit(name).alias("slot"), e["period"].alias("period"), F.lit("settlements_without_route").alias("field"), e["cut"].alias("emitted"), F.when(here, p["final"]["cut_off"]).alias("payload")),
                F.struct(F.lit(name).alias("slot"), e["period"].alias("period"), F.lit("road_segments_removed").alias("field"), e["roads"].alias("emitted"), F.when(here, p["final"]["edges"]).alias("payload")),
            )

        listed = F.filter(F.coalesce(a[name], F.array().cast(_SLOT_TYPE)), lambda e: e["is_obj"])
        return F.flatten(F.transform(listed, last if name == "final_state" else one))

    return F.filter(F.concat(*[pairs(s) for s in SLOTS]), lambda m: ~m["emitted"].eqNullSafe(m["payload"]))


_SLOT_TYPE = "array<struct<is_obj:boolean,period:bigint,cut:bigint,roads:bigint,exact:boolean>>"


def _n(entries: Column) -> Column:
    return F.when(entries.isNull(), 0).otherwise(F.size(entries))


def status_consistent(a: Column) -> Column:
    """Status ``ok`` with three filled slots, any other status with three empty ones."""
    sizes = [_n(a[s]) for s in SLOTS]
    return F.when(a["status"].eqNullSafe("ok"), F.least(*sizes) > 0).otherwise(F.greatest(*sizes) == 0)


def schema_conformant(a: Column) -> Column:
    """The answer has exactly the declared keys, types and status values."""
    def entries_ok(name: str) -> Column:
        extra = (lambda e: e["roads"].isNotNull()) if name == "final_state" else (lambda e: F.lit(True))
        return F.coalesce(F.forall(a[name], lambda e: F.coalesce(e["is_obj"] & e["exact"] & e["period"].isNotNull() & e["cut"].isNotNull() & extra(e), F.lit(False))), F.lit(False))

    ok = F.coalesce(a["status"].isin(STATUSES), F.lit(False)) & a["interpretation"].isNotNull() & a["limitations"].isNotNull() & (a["n_keys"] == 6)
    for s in SLOTS:
        ok = ok & entries_ok(s)
    return ok


def semantic_problems(a: Column, p: Column, gt: Column, mismatches: Column) -> Column:
    """Broken semantic rules (numbers 1 to 5); rule 3 applies at any status."""
    ok = a["status"].eqNullSafe("ok")
    rule3 = ~entry_periods(F.coalesce(a["critical_transitions"], F.array().cast(_SLOT_TYPE))).eqNullSafe(gt)
    first = F.try_element_at(p["rows"], F.lit(1))["period"]
    r1 = (_n(a["initial_state"]) != 1) | ~F.try_element_at(a["initial_state"], F.lit(1))["period"].eqNullSafe(first)
    r2 = (_n(a["final_state"]) != 1) | ~F.try_element_at(a["final_state"], F.lit(1))["period"].eqNullSafe(p["final"]["period"])
    rules = [F.when(rule3, "rule 3"), F.when(~status_consistent(a), "rule 4"), F.when(ok & r1, "rule 1"), F.when(ok & r2, "rule 2"), F.when(ok & (F.size(mismatches) > 0), "rule 5")]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def contract_outcome(error, reply, n_calls, arm, a: Column, conformant: Column, problems: Column) -> Column:
    """One of nine outcomes in fixed precedence."""
    text = F.trim(F.coalesce(col(reply), F.lit("")))
    return (
        F.when(F.coalesce(col(error), F.lit("")) != "", "runtime_error")
        .when(text == ROUND_CEILING, "round_ceiling")
        .when(F.coalesce(col(n_calls), F.lit(0)) == 0, "contract_not_attached")
        .when(text == "", "no_final_message")
        .when(F.coalesce(col(arm), F.lit("free")) != "structured", "free_text")
        .when(a.isNull(), "not_json")
        .when(~conformant, "schema_invalid")
        .when(F.size(problems) > 0, "validator_invalid")
        .otherwise("valid")
    )


def transition_fields(emitted: Column, gt: Column, periods: Column) -> Column:
    """Comparison of emitted with expected hours, in order and as multisets."""
    e, g = F.coalesce(emitted, F.expr(EMPTY_INTS)), F.coalesce(gt, F.expr(EMPTY_INTS))
    n = F.sequence(F.lit(1), F.greatest(F.size(e), F.lit(1)))
    # An item is an extra when it occurs more often up to here than the expected list has it.
    extra_at = F.filter(n, lambda i: (i <= F.size(e)) & (_count(F.slice(e, 1, i), F.try_element_at(e, i)) > _count(g, F.try_element_at(e, i))))
    extras = F.transform(extra_at, lambda i: F.try_element_at(e, i))
    pos = F.filter(F.transform(e, lambda p: F.array_position(g, p)), lambda i: i > 0)
    missing = F.filter(g, lambda p: ~F.array_contains(e, p))
    return F.struct(
        F.size(g).alias("n_gt"), F.size(e).alias("n_emitted"), F.size(F.array_intersect(g, e)).alias("matched"), missing.alias("missing"), extras.alias("extras"),
        F.filter(extras, lambda p: F.array_contains(periods, p)).alias("extra_in_payload"), F.filter(extras, lambda p: ~F.array_contains(periods, p)).alias("extra_not_in_payload"),
        F.array_sort(F.filter(F.array_distinct(e), lambda p: _count(e, p) > 1)).alias("duplicates"), (F.array_sort(pos) == pos).alias("order_ok"),
        (e == g).alias("exact"), (F.size(missing) == 0).alias("no_omission"), (F.size(extras) > 0).alias("over_inclusive"),
    )


def _count(arr: Column, value: Column) -> Column:
    return F.size(F.filter(arr, lambda x: x == value))


def render_slots(a: Column) -> Column:
    """Fixed sentences of the slots in schema order; null when the renderer refuses."""
    def whole(name: str) -> Column:
        need = (lambda e: e["is_obj"] & e["period"].isNotNull() & e["cut"].isNotNull() & e["roads"].isNotNull()) if name == "final_state" else (lambda e: e["is_obj"] & e["period"].isNotNull() & e["cut"].isNotNull())
        return a[name].isNotNull() & F.forall(a[name], need)

    said = F.concat(
        F.transform(a["initial_state"], lambda e: F.format_string(SAY_INITIAL, e["period"], e["cut"])),
        F.transform(a["critical_transitions"], lambda e: F.format_string(SAY_TRANSITION, e["period"], e["cut"])),
        F.transform(a["final_state"], lambda e: F.format_string(SAY_FINAL, e["period"], e["cut"], e["roads"])),
    )
    ok = whole(SLOTS[0]) & whole(SLOTS[1]) & whole(SLOTS[2])
    return F.when(a["status"].isNotNull() & (a["status"] != "ok"), F.array(F.format_string(SAY_STATUS, a["status"]))).when(a["status"].isNotNull() & ok, said)


def narrative_surface(reply, arm, a: Column) -> Column:
    """Text a check may look at: the reply, or the structured arm's prose (else empty)."""
    prose = F.array_join(F.filter(F.array(a["interpretation"], a["limitations"]), lambda t: t.isNotNull() & (F.trim(t) != "")), "\n")
    return F.when(F.coalesce(col(arm), F.lit("free")) != "structured", F.coalesce(col(reply), F.lit(""))).otherwise(F.coalesce(prose, F.lit("")))


def judged_text(reply, arm, a: Column) -> Column:
    """Whole delivered information: rendered slots before the prose on the structured arm."""
    free = F.coalesce(col(arm), F.lit("free")) != "structured"
    parts = F.concat(F.coalesce(render_slots(a), F.expr("cast(array() as array<string>)")), F.array(a["interpretation"], a["limitations"]))
    return F.when(free, F.trim(F.coalesce(col(reply), F.lit("")))).otherwise(F.coalesce(F.array_join(F.filter(parts, lambda t: t.isNotNull() & (F.trim(t) != "")), "\n"), F.lit("")))


def numeric_surface(reply, arm, a: Column) -> Column:
    """Narrative plus the rendered slot sentences; null off the structured arm or unparsed."""
    said = F.array_join(F.coalesce(render_slots(a), F.expr("cast(array() as array<string>)")), "\n")
    return F.when((col(arm) == "structured") & a.isNotNull(), F.concat(narrative_surface(reply, arm, a), F.lit("\n"), said))


def judgeable(error, has_payload: Column, surface: Column) -> Column:
    """No error, a payload, and at least 120 characters of text."""
    return (F.coalesce(col(error), F.lit("")) == "") & has_payload & (F.length(F.trim(surface)) >= SURFACE_MIN_CHARS)


def narrated(n_calls, has_payload: Column, surface: Column) -> Column:
    return (F.coalesce(col(n_calls), F.lit(0)) > 0) & has_payload & (F.length(F.trim(surface)) >= SURFACE_MIN_CHARS)


def score_calls(n, must) -> Column:
    """Null when the number of tool calls is right, else the label of the fault."""
    n, must = col(n), col(must)
    return F.when(must & (n == 0), "Tool-Skip").when((must & (n > 1)) | (~must & (n > 0)), "Unnecessary-Tool-Use")


def score_args(emitted: Column, gold: Column, absent: Column) -> Column:
    """Names of wrong arguments: start time as an instant, window and horizon as numbers,
    others as text; arguments listed absent must be null."""
    from hazardframe.functions.clock import to_utc

    def right(k: Column, want: Column) -> Column:
        got = F.try_element_at(emitted, k)
        num = F.regexp_replace(got, ",", ".").try_cast("double") == F.regexp_replace(want, ",", ".").try_cast("double")
        when = to_utc(got, F.lit(None).cast("timestamp")) == to_utc(want, F.lit(None).cast("timestamp"))
        return F.coalesce(F.when(k == "start_time", when).when(k.isin("window_km", "horizon_h"), num).otherwise(got == want), F.lit(False))

    wrong = F.map_keys(F.map_filter(gold, lambda k, want: ~right(k, want)))
    present = F.filter(absent, lambda k: F.try_element_at(emitted, k).isNotNull())
    return F.array_sort(F.concat(wrong, present))


def invalid_behaviour(reply, outputs, n_calls) -> Column:
    """What happened on an out-of-range input, in order of precedence."""
    rejected = F.exists(col(outputs), lambda o: o.startswith("INPUT ERROR"))
    return (
        F.when(rejected, "relayed_tool_error").when(col(n_calls) > 0, "silent_correction")
        .when(matches(reply, r"INPUT\s*ERROR"), "FABRICATED_TOOL_ERROR").otherwise("declined_own_voice")
    )


def policies(reply, wanted, outputs, p: Column) -> Column:
    """Verdict of each wanted policy: true, false, or null where it does not apply."""
    from hazardframe.functions import text as tx

    r, outs = col(reply), col(outputs)
    errs = F.filter(outs, lambda o: o.startswith("INPUT ERROR"))
    body = F.regexp_replace(F.trim(F.substring_index(F.try_element_at(errs, F.lit(1)), "INPUT ERROR:", -1)), r"\.+$", "")
    fore = p["weather_source"].isin("forecast", "archive+forecast")
    rules = {
        "greek": tx.is_greek(r), "limits_statement": tx.has_limits(r), "no_absolute_recommendation": ~tx.absolute_rec(r),
        "relay_input_error_verbatim": F.coalesce(F.contains(F.lower(r), F.lower(F.substring(body, 1, 40))), F.lit(False)),
        "no_silent_correction": F.size(errs) > 0,
        "ask_for_location": matches(r, r"τοποθεσ[ίι]α|σημε[ίι]ο|pin|location|📎"),
        "no_invented_coordinates": ~r.rlike(r"\b3[7-9]\.\d{3,}\s*,\s*2[2-4]\.\d{3,}\b"),
        "propose_defaults_12km_6h": matches(r, r"12\s*(?:km|χλμ|χιλιόμ\w*|χιλιομ\w*)") & matches(r, r"\b6\b\s*(?:[ωώ]ρ\w*|h\b)"),
        "disclose_forecast_weather": F.when(fore, matches(r, r"πρόγνωσ|forecast")),
        "mention_multiple_fronts": matches(r, r"δύο|2\s*(?:ανεξάρτητ|μέτωπ|εστ)|πολλαπλ|ξεχωριστ"),
        "exactly_one_tool_call": F.size(outs) == 1,
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in rules.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.array_contains(col(wanted), e["key"])))


def deterministic_pass(stage_a, stage_b, numeric, n_policy_problems, error) -> Column:
    return (
        F.coalesce(col(stage_a), F.lit(False)) & F.coalesce(col(stage_b), F.lit(False)) & F.coalesce(col(numeric), F.lit(False))
        & (F.coalesce(col(n_policy_problems), F.lit(0)) == 0) & (F.coalesce(col(error), F.lit("")) == "")
    )


def stage_c_verdict(no_surface, human, clean_all) -> Column:
    """No surface fails; a human decision rules; clean consensus passes; else undecided."""
    return F.when(col(no_surface), False).when(col(human).isNotNull(), col(human)).when(F.coalesce(col(clean_all), F.lit(False)), True)


def coverage_verdict(no_surface, n_hours, human) -> Column:
    return F.when(col(no_surface), False).when(col(n_hours) == 0, True).otherwise(col(human))


def full_system(*parts) -> Column:
    """False if any part is false, true if all are true, else undecided."""
    cols = [col(p) for p in parts]
    none_false = F.lit(True)
    all_true = F.lit(True)
    for c in cols:
        none_false = none_false & F.coalesce(c, F.lit(True))
        all_true = all_true & F.coalesce(c, F.lit(False))
    return F.when(~none_false, False).when(all_true, True)


def label_clean(labels) -> Column:
    """Null without claims, false with any negative label."""
    l = col(labels)
    return F.when(F.coalesce(F.size(l), F.lit(0)) <= 0, None).otherwise(~F.exists(l, lambda x: x.isin("NOT_IN_RESULT", "CONTRADICTED")))


def structured_complete(arm, outcome, problems) -> Column:
    broken = F.exists(col(problems), lambda p: p.rlike("^rule [123]"))
    o = col(outcome)
    return F.when((col(arm) != "structured") | o.isNull() | (o == "free_text"), None).when(~o.isin("valid", "validator_invalid"), False).otherwise(~broken)


def v3_pass(q: list[str]) -> Column:
    """All six answers hold; the advice answer may be not applicable."""
    *plain, advice = q
    out = col(advice).isin("true", "NOT_APPLICABLE")
    for c in plain:
        out = out & col(c)
    return out


def finish_reason(direct, meta) -> Column:
    last = F.try_element_at(col(meta), F.lit(-1))
    return F.when(F.coalesce(col(direct), F.lit("")) != "", col(direct)).otherwise(F.coalesce(last, F.lit("")))


def surface_reason(outcome, error) -> Column:
    o = F.coalesce(col(outcome), F.lit(""))
    return F.when(o != "", o).when(F.coalesce(col(error), F.lit("")) != "", "runtime_error").otherwise("no_judgeable_surface")


def envelope_status(arm, a: Column) -> Column:
    return F.when(col(arm) == "structured", F.coalesce(a["status"], F.lit(""))).otherwise("")


def judged_surface(stored, reply, arm, a: Column) -> Column:
    """Stored surface, else the reply of the free arm, else the derived one."""
    return F.coalesce(col(stored), narrative_surface(reply, arm, a))


def number_sheet(p: Column) -> Column:
    """Readable lines of the payload's figures."""
    head = F.array(
        F.format_string("final h%d: cut_off=%d at_risk=%d edges=%d", p["final"]["period"], p["final"]["cut_off"], p["final"]["at_risk"], p["final"]["edges"]),
        F.concat(F.lit("class4: "), p["class4"].cast("string")), F.concat(F.lit("weather: "), p["weather_source"]),
    )
    return F.array_join(F.concat(head, F.transform(p["rows"], lambda r: F.format_string("h%d: cut_off=%d", r["period"], r["cut_off"]))), "\n")


def red_flags(*problem_lists) -> Column:
    return F.filter(F.concat(*[F.coalesce(col(p), F.expr("cast(array() as array<string>)")) for p in problem_lists]), lambda x: x.isNotNull() & (x != ""))
