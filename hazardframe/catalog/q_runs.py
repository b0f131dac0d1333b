"""Queries of the run-record aggregates, joins, samples and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.catalog.q_answers import ANS, parsed, scored
from hazardframe.catalog.registry import query
from hazardframe.functions import answers as an
from hazardframe.functions import text as tx
from hazardframe.operators import runs as rn
from hazardframe.plans import reports as rp

FULL = "CASE WHEN NOT (stage_a_ok AND stage_b_ok AND numeric_ok) OR NOT stage_c OR NOT coverage THEN FALSE WHEN stage_c AND coverage THEN TRUE END"
REC = f"rec AS (SELECT *, stage_a_ok AND stage_b_ok AND numeric_ok AS det, {FULL} AS full_ok FROM fx_record)"
STATE = "CASE WHEN count(*) FILTER (NOT {v})>0 THEN FALSE WHEN count(*) FILTER ({v})=count(*) THEN TRUE END"
CS = f"cs AS (SELECT model, arm, case_id, {STATE.format(v='full_ok')} AS st FROM rec GROUP BY 1,2,3)"
CRIT = ["stage_a_ok", "stage_b_ok", "numeric_ok", "stage_c", "coverage"]


def _rec(v):
    r = v("fx_record").withColumn("det", an.deterministic_pass("stage_a_ok", "stage_b_ok", "numeric_ok", F.lit(0), F.lit(None)))
    return r.withColumn("full_ok", an.full_system("det", "stage_c", "coverage"))


@query("f39_deterministic_pass", f"WITH {REC} SELECT record_id, det FROM rec")
def f39(v):
    return _rec(v).select("record_id", "det")


@query("f38_component_verdicts", """SELECT record_id, CASE WHEN o%7=0 THEN FALSE WHEN o%5=0 THEN o%2=0 WHEN o%3=0 THEN TRUE END AS stage_c, CASE WHEN o%7=0 THEN FALSE WHEN o%4=0 THEN TRUE WHEN o%5=0 THEN o%2=0 END AS coverage FROM (SELECT record_id, record_id AS o FROM fx_record) t""")
def f38(v):
    o = F.col("record_id")
    human = F.when(o % 5 == 0, o % 2 == 0)
    return v("fx_record").select("record_id", an.stage_c_verdict(o % 7 == 0, human, o % 3 == 0).alias("stage_c"), an.coverage_verdict(o % 7 == 0, o % 4, human).alias("coverage"))


@query("a22_pass_rates", f"""WITH {REC}, p AS (SELECT model, arm, case_id, count(*) AS n, count(*) FILTER (full_ok) AS t FROM rec GROUP BY 1,2,3)
SELECT model, arm, CAST(sum(n) AS BIGINT) AS reps, count(*) AS cases, round(sum(t)/sum(n),3) AS pass1, round(count(*) FILTER (t=n)/count(*),3) AS passk FROM p GROUP BY 1,2""")
def a22(v):
    return rn.pass_rates(_rec(v), "full_ok", ["model", "arm"])


@query("a23_category_rates", """WITH p AS (SELECT category, case_id, count(*) AS n, count(*) FILTER (stage_a_ok) AS a, count(*) FILTER (stage_b_ok) AS b, count(*) FILTER (numeric_ok) AS m, count(*) FILTER (stage_a_ok AND stage_b_ok) AS t FROM fx_eval GROUP BY 1,2)
SELECT category, count(*) AS cases, CAST(sum(n) AS BIGINT) AS reps, round(sum(a)/sum(n),3) AS stage_a_ok, round(sum(b)/sum(n),3) AS stage_b_ok, round(sum(m)/sum(n),3) AS numeric_ok, round(sum(t)/sum(n),3) AS pass1, round(count(*) FILTER (t=n)/count(*),3) AS passk FROM p GROUP BY 1""")
def a23(v):
    e = v("fx_eval").withColumn("gate", F.col("stage_a_ok") & F.col("stage_b_ok"))
    return rn.category_rates(e, ["stage_a_ok", "stage_b_ok", "numeric_ok"], "gate")


@query("a24_behaviour_counts", "SELECT b AS behaviour, count(*) AS n FROM (SELECT CASE WHEN kind IN (0,1) THEN 'relayed_tool_error' WHEN kind IN (2,3) THEN 'silent_correction' WHEN kind IN (4,5) THEN 'FABRICATED_TOOL_ERROR' ELSE 'declined_own_voice' END AS b FROM fx_answer0) t GROUP BY 1")
def a24(v):
    k = F.col("kind")
    outs = F.when(k.isin(0, 1), F.array(F.lit("INPUT ERROR: bad"))).otherwise(F.array(F.lit("ok")))
    reply = F.when(k.isin(4, 5), "INPUT ERROR").otherwise("no")
    return rn.value_counts(v("fx_answer0").withColumn("behaviour", an.invalid_behaviour(reply, outs, F.when(k.isin(2, 3), 1).otherwise(0))), ["behaviour"])


@query("a25_bounds", f"WITH {REC} SELECT model, arm, round(count(*) FILTER (full_ok)/count(*),6) AS lower, round((count(*) FILTER (full_ok)+count(*) FILTER (full_ok IS NULL))/count(*),6) AS upper, count(*) FILTER (full_ok IS NULL) AS pending FROM rec GROUP BY 1,2")
def a25(v):
    return rn.bounds(_rec(v), "full_ok", ["model", "arm"])


@query("a26_passk_bounds", f"WITH {REC}, {CS} SELECT model, arm, round(count(*) FILTER (st)/count(*),6) AS lower, round((count(*) FILTER (st)+count(*) FILTER (st IS NULL))/count(*),6) AS upper, count(*) FILTER (st IS NULL) AS pending FROM cs GROUP BY 1,2")
def a26(v):
    return rn.passk_bounds(_rec(v), "full_ok", ["model", "arm"])


def _cell(name: str, src: str, col: str, itt: bool = False) -> str:
    den = "count(*)" if itt else f"count({col})"
    exc = "CAST(0 AS BIGINT)" if itt else f"count(*) FILTER ({col} IS NULL)"
    return f"SELECT '{name}' AS level, model, arm, count(*) FILTER ({col}) AS passed, {den} AS denominator, {exc} AS excluded, count(*) FILTER ({col} IS NULL) AS pending, round(count(*) FILTER ({col})/{den},4) AS rate FROM {src} GROUP BY 2,3"


@query("a27_rate_cell", f"WITH {REC}, {CS} {_cell('row', 'rec', 'full_ok')} UNION ALL {_cell('case', 'cs', 'st')} UNION ALL {_cell('itt', 'rec', 'full_ok', True)}")
def a27(v):
    r = _rec(v)
    outs = [rn.rate_cell(r, "full_ok", lv, ["model", "arm"]).withColumn("level", F.lit(lv)) for lv in ("row", "case", "itt")]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@query("a28_arm_difference", f"WITH {REC} SELECT model, round((count(*) FILTER (full_ok AND arm='structured')/count(full_ok) FILTER (arm='structured')-count(*) FILTER (full_ok AND arm='free')/count(full_ok) FILTER (arm='free'))*100,1) AS diff_pp FROM rec GROUP BY 1")
def a28(v):
    return rn.arm_difference(rn.rate_cell(_rec(v), "full_ok", "row", ["model", "arm"]), ["model"])


PAIR = f"{CS}, pr AS (SELECT a.model, a.case_id, a.st AS x, b.st AS y FROM cs a JOIN cs b ON a.model=b.model AND a.case_id=b.case_id AND a.arm='free' AND b.arm='structured')"


@query("a29_discordance", f"WITH {REC}, {PAIR} SELECT model, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c, count(*) FILTER (x=y) AS concordant, count(*) FILTER (x IS NULL OR y IS NULL) AS undecided, count(*) AS pairs FROM pr GROUP BY 1")
def a29(v):
    return rn.discordance(_rec(v), "full_ok", ["model"])


@query("a39_sign_test", f"""WITH RECURSIVE {REC}, {PAIR}, d AS (SELECT model, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM pr GROUP BY 1),
t AS (SELECT model, b+c AS n, least(b,c) AS k, CAST(0 AS BIGINT) AS i, -(b+c)*ln(2.0::DOUBLE) AS l FROM d UNION ALL SELECT model, n, k, i+1, l+ln(n-i)-ln(i+1) FROM t WHERE i<k)
SELECT model, CASE WHEN max(n)>0 THEN round(least(1.0, 2*sum(exp(l))),4) END AS p FROM t GROUP BY 1""")
def a39(v):
    return rn.discordance(_rec(v), "full_ok", ["model"]).select("model", rn.sign_test("b", "c").alias("p"))


_CST = ", ".join(f"{STATE.format(v=c)} AS {c}" for c in CRIT)


@query("a30_flip_attribution", f"""WITH {REC}, {PAIR}, s AS (SELECT model, arm, case_id, {_CST} FROM rec GROUP BY 1,2,3), f AS (SELECT pr.model, pr.case_id, CASE WHEN x THEN 'lost' ELSE 'gained' END AS direction FROM pr WHERE x<>y)
SELECT f.model, f.case_id, f.direction, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in CRIT)}], lambda z: z IS NOT NULL)),',') AS changed FROM f JOIN s a ON a.model=f.model AND a.case_id=f.case_id AND a.arm='free' JOIN s b ON b.model=f.model AND b.case_id=f.case_id AND b.arm='structured'""")
def a30(v):
    return rn.flip_attribution(_rec(v), "full_ok", CRIT, ["model"])


@query("a31_failure_attribution", f"WITH {REC} " + " UNION ALL ".join(f"SELECT arm, '{c}' AS criterion, count(*) AS failing, count(*) FILTER (NOT {c}) AS n_failed FROM rec WHERE NOT full_ok GROUP BY 1" for c in CRIT))
def a31(v):
    return rn.failure_attribution(_rec(v), "full_ok", CRIT)


@query("a32_variants", f"""WITH {REC}, {CS}, c AS (SELECT model, arm, round(count(*) FILTER (st)/count(st),4) AS v5 FROM cs GROUP BY 1,2)
SELECT r.model, r.arm, round(count(*) FILTER (full_ok)/count(full_ok),4) AS p, round(count(*) FILTER (full_ok)/count(*),4) AS v1, round((count(*) FILTER (full_ok)+count(*) FILTER (full_ok IS NULL))/count(*),4) AS v2, max(c.v5) AS v5 FROM rec r JOIN c ON c.model=r.model AND c.arm=r.arm GROUP BY 1,2""")
def a32(v):
    return rn.variants(_rec(v), "full_ok", ["model", "arm"])


@query("a33_validity_rates", f"WITH {ANS}, x AS (SELECT *, outcome IN ('runtime_error','contract_not_attached') AS ex FROM ans WHERE arm='structured') SELECT c0, count(*) AS rows, count(*) FILTER (ex) AS excluded, count(*) FILTER (NOT ex) AS denominator, round(count(*) FILTER (outcome IN ('valid','validator_invalid'))/count(*) FILTER (NOT ex),4) AS schema_rate, round(count(*) FILTER (outcome='valid')/count(*) FILTER (NOT ex),4) AS contract_rate FROM x GROUP BY 1")
def a33(v):
    return rn.validity_rates(scored(v).withColumn("finish_reason", F.lit("stop")), ["c0"])


@query("a34_transition_totals", f"""WITH {ANS}, x AS (SELECT * FROM ans WHERE sc) SELECT c0, count(*) AS n_scored, round(count(*) FILTER (nx=0 AND nm=nr)/count(*),4) AS exact_rate, round(sum(nm)/sum(nr),4) AS event_recall, count(*) FILTER (nr=0) AS dropped_gt0,
 round(count(*) FILTER (nm=nr)/count(*),4) AS no_omission_rate, round(sum(nx)/sum(nm+nx),4) AS extra_rate, round(sum(nx)/count(*),4) AS extra_per_record, round(count(*) FILTER (nx>0)/count(*),4) AS over_rate, CAST(0 AS BIGINT) AS extra_in_payload, CAST(sum(nx) AS BIGINT) AS extra_not_in_payload,
 CAST(0 AS BIGINT) AS order_violations, CAST(0 AS BIGINT) AS with_duplicates FROM x GROUP BY 1""")
def a34(v):
    return rn.transition_totals(scored(v), ["c0"])


@query("a49_structured_diagnostics", f"""WITH {ANS} SELECT c0, round(100.0::DOUBLE*count(*) FILTER (outcome IN ('valid','validator_invalid'))/count(*),2) AS schema_pct, round(100.0::DOUBLE*count(*) FILTER (outcome IN ('valid','validator_invalid') AND kind IN (0,4))/count(*),2) AS slot_clean_pct,
 round(100.0::DOUBLE*sum(nm) FILTER (sc)/sum(nr) FILTER (sc),2) AS recall_pct, round(100.0::DOUBLE*sum(nm) FILTER (sc)/sum(nm+nx) FILTER (sc),2) AS precision_pct FROM ans WHERE arm='structured' GROUP BY 1""")
def a49(v):
    return rp.structured_diagnostics(scored(v).filter("arm = 'structured'"), ["c0"])


@query("a35_label_distribution", """WITH p AS (SELECT uid, count(*) FILTER (label='SUPPORTED') AS s, count(*) FILTER (label='NOT_IN_RESULT') AS m, count(*) FILTER (label='CONTRADICTED') AS c FROM fx_claim GROUP BY 1)
SELECT CAST(sum(s) AS BIGINT) AS supported, CAST(sum(m) AS BIGINT) AS not_in_result, CAST(sum(c) AS BIGINT) AS contradicted, count(*) AS records, count(*) FILTER (m+c>0) AS with_negative, count(*) FILTER (m+c=0) AS clean FROM p""")
def a35(v):
    return rn.label_distribution(v("fx_claim"))


@query("f37_label_clean", "SELECT d.doc_id AS uid, CASE WHEN count(c.label)=0 THEN NULL ELSE count(*) FILTER (c.label IN ('NOT_IN_RESULT','CONTRADICTED'))=0 END AS clean FROM labels d LEFT JOIN fx_claim c ON c.uid=d.doc_id AND c.uid%10<>9 GROUP BY 1")
def f37(v):
    c = v("fx_claim").filter("uid % 10 <> 9").groupBy("uid").agg(F.collect_list("label").alias("l"))
    return v("labels").select(F.col("doc_id").alias("uid")).join(c, "uid", "left").select("uid", an.label_clean("l").alias("clean"))


@query("t8_audit_tiers", "SELECT uid, w AS weight, n AS n_claims, CASE WHEN w>=6 THEN 1 WHEN w>0 THEN 2 ELSE 3 END AS tier, row_number() OVER (ORDER BY w DESC, uid) AS position FROM (SELECT uid, CAST(sum(CASE label WHEN 'CONTRADICTED' THEN 3 WHEN 'NOT_IN_RESULT' THEN 1 ELSE 0 END) AS BIGINT) AS w, count(*) AS n FROM fx_claim GROUP BY 1) t")
def t8(v):
    return rn.audit_tiers(v("fx_claim"))


@query("r34_audit_tables", "SELECT category, tier, count(*) AS records, CAST(sum(n) AS BIGINT) AS claims FROM (SELECT uid, count(*) AS n, CASE WHEN sum(CASE label WHEN 'CONTRADICTED' THEN 3 WHEN 'NOT_IN_RESULT' THEN 1 ELSE 0 END)>=6 THEN 1 WHEN sum(CASE label WHEN 'CONTRADICTED' THEN 3 WHEN 'NOT_IN_RESULT' THEN 1 ELSE 0 END)>0 THEN 2 ELSE 3 END AS tier FROM fx_claim GROUP BY 1) t JOIN fx_note USING (uid) GROUP BY 1,2")
def r34(v):
    return rp.audit_tables(v("fx_claim"), v("fx_note"))


@query("a38_v3_cells", f"""WITH {REC}, s AS (SELECT model, arm, case_id, {STATE.format(v='stage_c')} AS st, count(*) AS n, count(*) FILTER (stage_c) AS t FROM rec GROUP BY 1,2,3)
SELECT r.*, s2.pass1, s2.passk, s2.pf FROM (SELECT model, arm, count(*) AS reps, count(*) FILTER (stage_a_ok) AS a_ok, count(*) FILTER (stage_b_ok) AS b_ok, count(*) FILTER (stage_c) AS c_ok, count(*) FILTER (stage_c IS NULL) AS not_reached FROM rec GROUP BY 1,2) r
JOIN (SELECT model, arm, round(sum(t)/sum(n),3) AS pass1, round(count(*) FILTER (t=n)/count(*),3) AS passk, string_agg(CASE WHEN st THEN 'P' WHEN NOT st THEN 'F' ELSE '-' END,'' ORDER BY case_id) AS pf FROM s GROUP BY 1,2) s2 ON s2.model=r.model AND s2.arm=r.arm""")
def a38(v):
    return rn.v3_cells(_rec(v), "stage_c")


_MIX = lambda a: f"(({a}*16807)%2147483647)"


@query("a40_cluster_bootstrap", """WITH p AS (SELECT case_id, count(*) FILTER (stage_c) AS num, count(*) AS den, row_number() OVER (ORDER BY case_id)-1 AS i FROM fx_record GROUP BY 1), c AS (SELECT count(*) AS n FROM p),
d AS (SELECT d.draw, k.k FROM (SELECT unnest(generate_series(0,1999)) AS draw) d, (SELECT unnest(generate_series(0,(SELECT n-1 FROM c))) AS k) k),
m1 AS (SELECT draw, k, ((7::BIGINT*69621+12345)%2147483647*16807::BIGINT)%2147483647 AS m FROM d), m2 AS (SELECT draw, k, ((m*48271+draw*69621+12345)%2147483647*16807)%2147483647 AS m FROM m1), m3 AS (SELECT draw, ((m*48271+k*69621+12345)%2147483647*16807)%2147483647%(SELECT n FROM c) AS i FROM m2),
r AS (SELECT draw, sum(num)/sum(den) AS rate FROM m3 JOIN p ON p.i=m3.i GROUP BY 1), o AS (SELECT rate, row_number() OVER (ORDER BY rate)-1 AS pos FROM r)
SELECT round(max(rate) FILTER (pos=50),4) AS lower, round(max(rate) FILTER (pos=1949),4) AS upper FROM o""")
def a40(v):
    return rn.cluster_bootstrap(v("fx_record"), "stage_c", 2000, 7)


@query("a41_cohens_kappa", """SELECT tt, tf, ft, ff, round(((tt+ff)/n-pe)/(1-pe),6) AS kappa FROM (SELECT *, ((tt+tf)*(tt+ft)+(ft+ff)*(tf+ff))/(n*n) AS pe FROM (SELECT count(*) FILTER (primary_pass AND second_pass) AS tt, count(*) FILTER (primary_pass AND NOT second_pass) AS tf,
  count(*) FILTER (NOT primary_pass AND second_pass) AS ft, count(*) FILTER (NOT primary_pass AND NOT second_pass) AS ff, count(*)::DOUBLE AS n FROM fx_rater) t) z""")
def a41(v):
    return rn.cohens_kappa(v("fx_rater"), "primary_pass", "second_pass")


_QS = ["q1", "q2", "q3", "q4", "q5"]


@query("a42_agreement", "WITH b AS (SELECT record_id, q2 AS q1, q2, q4 AS q3, q4, q1 AS q5 FROM fx_decision) " + " UNION ALL ".join(f"SELECT '{q}' AS question, count(*) AS n, round(100.0::DOUBLE*count(*) FILTER (a.{q}=b.{q})/count(*),2) AS agree_pct, count(*) FILTER (a.{q}<>b.{q}) AS flipped, count(*) FILTER (a.{q}) AS true1, count(*) FILTER (b.{q}) AS true2 FROM fx_decision a JOIN b ON a.record_id=b.record_id" for q in _QS))
def a42(v):
    d = v("fx_decision")
    b = d.select("record_id", F.col("q2").alias("q1"), "q2", F.col("q4").alias("q3"), "q4", F.col("q1").alias("q5"))
    return rn.agreement(d, b, _QS)


@query("f40_v3_pass", "SELECT record_id, q1 AND q2 AND q3 AND q4 AND q5 AND q6 IN ('true','NOT_APPLICABLE') AS passed FROM fx_decision")
def f40(v):
    return v("fx_decision").select("record_id", an.v3_pass([*_QS, "q6"]).alias("passed"))


@query("a44_validate_decisions", """WITH d AS (SELECT record_id, judgeable, CASE WHEN judgeable OR record_id%2=0 THEN q1 END AS q1, CASE WHEN judgeable THEN q2 END AS q2, CASE WHEN judgeable THEN q3 END AS q3, CASE WHEN judgeable THEN q4 END AS q4, CASE WHEN judgeable THEN q5 END AS q5, CASE WHEN record_id%17=0 AND judgeable THEN 'maybe' WHEN judgeable THEN q6 END AS q6,
  CASE WHEN judgeable THEN (q1 AND q2 AND q3 AND q4 AND q5 AND q6 IN ('true','NOT_APPLICABLE')) <> (record_id%19=0) END AS sp FROM fx_decision WHERE record_id%23<>0)
SELECT doc_id AS record_id, 'missing' AS fault FROM labels WHERE doc_id%23=0 UNION SELECT record_id, 'null_pattern' FROM d WHERE NOT judgeable AND q1 IS NOT NULL UNION SELECT record_id, 'enum' FROM d WHERE judgeable AND q6='maybe'
UNION SELECT record_id, 'pass' FROM d WHERE judgeable AND q6<>'maybe' AND sp<>(q1 AND q2 AND q3 AND q4 AND q5 AND q6 IN ('true','NOT_APPLICABLE'))""")
def a44(v):
    d = v("fx_decision").filter("record_id % 23 <> 0")
    ok = an.v3_pass([*_QS, "q6"])
    j, r = F.col("judgeable"), F.col("record_id")
    d = d.withColumn("stage_c_pass", F.when(j, ok != (r % 19 == 0)))
    d = d.withColumns({"q1": F.when(j | (r % 2 == 0), F.col("q1")), **{q: F.when(j, F.col(q)) for q in _QS[1:]}, "q6": F.when((r % 17 == 0) & j, F.lit("maybe")).when(j, F.col("q6"))})
    return rn.validate_decisions(d, v("labels").select(F.col("doc_id").alias("record_id")), [*_QS, "q6"])


@query("a43_verify_runs", """WITH p AS (SELECT arm, case_id, rep, count(*) AS n, count(error) AS e, count(*) FILTER (n_tool_calls>1) AS m FROM fx_answer GROUP BY 1,2,3)
SELECT arm, CAST(sum(n) AS BIGINT) AS rows, count(*) AS unique_reps, count(DISTINCT case_id) AS cases, count(*) FILTER (n>1) AS duplicates, CAST(sum(e) AS BIGINT) AS error_rows, CAST(sum(m) AS BIGINT) AS multi_calls, sum(n)=1500 AND count(*)=1500 AND count(*) FILTER (n>1)=0 AND sum(e)=0 AS ok FROM p GROUP BY 1""")
def a43(v):
    return rn.verify_runs(v("fx_answer"), 1500, ["arm"])


@query("a45_compare_runs", "SELECT metric, max(v) FILTER (arm='free') AS free, max(v) FILTER (arm='structured') AS structured FROM (SELECT arm, unnest(['reps','pass1']) AS metric, unnest([count(*)::DOUBLE, round(count(*) FILTER (stage_c)/count(*),3)]) AS v FROM fx_record GROUP BY 1) t GROUP BY 1")
def a45(v):
    return rn.compare_runs(rn.pass_rates(v("fx_record"), "stage_c", ["arm"]), "arm", ["free", "structured"], ["reps", "pass1"])


@query("a46_diff_summaries", """WITH a AS (SELECT run_id, count(*)::DOUBLE AS n, sum(arrival)::DOUBLE AS s FROM fx_arrival GROUP BY 1), b AS (SELECT run_id, count(*)::DOUBLE AS n, sum(arrival)::DOUBLE AS s FROM fx_arrival_b GROUP BY 1)
SELECT a.run_id, 's' AS field, a.s AS a, b.s AS b FROM a JOIN b USING (run_id) WHERE a.s<>0 AND abs(b.s-a.s)>0.002*abs(a.s)""")
def a46(v):
    g = lambda n: v(n).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("arrival").alias("s"))
    return rn.diff_summaries(g("fx_arrival"), g("fx_arrival_b"), ["run_id"], ["n"], ["s"], 0.002)


@query("a47_source_counts", "SELECT arm, CASE WHEN arm='structured' THEN 'full_surface' ELSE 'prose_only_fallback' END AS numeric_source, count(*) AS n FROM fx_record GROUP BY 1,2")
def a47(v):
    r = v("fx_record").withColumn("numeric_source", F.when(F.col("arm") == "structured", "full_surface").otherwise("prose_only_fallback"))
    return rn.value_counts(r, ["arm", "numeric_source"])


def _cmp(level: str, src: str, c: str) -> str:
    t = lambda a: f"count(*) FILTER ({c} AND arm='{a}')/count({c}) FILTER (arm='{a}')"
    return f"SELECT model, '{c}' AS criterion, round({t('free')},4) AS baseline, round({t('structured')},4) AS structured, round(({t('structured')}-{t('free')})*100,1) AS diff_pp, '{level}' AS level FROM {src} GROUP BY 1"


@query("a50_comparison_table", f"WITH {REC}, k AS (SELECT model, arm, case_id, {_CST} FROM rec GROUP BY 1,2,3) " + " UNION ALL ".join([_cmp("pass1", "rec", c) for c in CRIT] + [_cmp("passk", "k", c) for c in CRIT]))
def a50(v):
    return rn.comparison_table(_rec(v), CRIT)


# Joins, set operations and ordered picks.

@query("j17_blind_sheet", "SELECT record_id, (record_id*7)%3<>0 AS passed FROM fx_record")
def j17(v):
    r = v("fx_record")
    key = r.select(F.concat(F.lit("D"), F.col("record_id").cast("string")).alias("decision_id"), "record_id")
    sheet = key.select("decision_id", F.when((F.col("record_id") * 7) % 3 != 0, " pass").otherwise("FAIL").alias("decision"))
    return rn.join_blind_sheet(sheet, key).select("record_id", "passed")


@query("j18_pair_arms", "SELECT coalesce(a.model,b.model) AS model, coalesce(a.case_id,b.case_id) AS case_id, coalesce(a.rep,b.rep)::BIGINT AS rep, CASE WHEN b.model IS NULL THEN 'only_base' WHEN a.model IS NULL THEN 'only_other' ELSE 'both' END AS side FROM (SELECT DISTINCT model, case_id, rep FROM fx_record WHERE arm='free') a FULL JOIN (SELECT DISTINCT model, case_id, rep FROM fx_record WHERE arm='structured') b ON a.model=b.model AND a.case_id=b.case_id AND a.rep=b.rep")
def j18(v):
    return rn.pair_arms(v("fx_record").withColumn("rep", F.col("rep").cast("long")), ["model", "case_id", "rep"])


@query("u8_key_difference", "SELECT side, count(*) AS n FROM (SELECT CASE WHEN b.model IS NULL THEN 'only_base' WHEN a.model IS NULL THEN 'only_other' ELSE 'both' END AS side FROM (SELECT DISTINCT model, case_id FROM fx_record WHERE arm='free') a FULL JOIN (SELECT DISTINCT model, case_id FROM fx_record WHERE arm='structured') b ON a.model=b.model AND a.case_id=b.case_id) t GROUP BY 1")
def u8(v):
    return rn.value_counts(rn.pair_arms(v("fx_record"), ["model", "case_id"]), ["side"])


@query("j19_label_passes", "SELECT r.doc_id AS uid, CASE WHEN r.doc_id%3<>0 THEN quality=1 END AS clean1, CASE WHEN r.doc_id%4<>0 THEN toxic=0 END AS clean2 FROM labels r")
def j19(v):
    l = v("labels").withColumn("uid", F.col("doc_id"))
    p1 = l.filter("doc_id % 3 <> 0").select("uid", (F.col("quality") == 1).alias("clean"))
    p2 = l.filter("doc_id % 4 <> 0").select("uid", (F.col("toxic") == 0).alias("clean"))
    return rn.join_label_passes(l.select("uid"), p1, p2)


@query("j24_common_cases", """SELECT case_id, CASE WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b' ELSE 'both' END AS support
FROM (SELECT case_id, max(CASE WHEN arm='free' THEN 1 END) AS a, max(CASE WHEN arm='structured' THEN 1 END) AS b FROM fx_record WHERE stage_c AND arm IN ('free','structured') GROUP BY 1) t""")
def j24(v):
    r = v("fx_record").filter("stage_c")
    return rn.case_support(r.filter("arm='free'"), r.filter("arm='structured'"))


@query("u5_resume_plan", "SELECT c.case_id, k.rep, CASE WHEN count(r.record_id)=0 THEN 'owe' WHEN count(r.error)>0 THEN 'redo' ELSE 'keep' END AS action FROM (SELECT DISTINCT record_id AS case_id FROM fx_answer) c CROSS JOIN (SELECT unnest([1,2,3,4,5,6]::BIGINT[]) AS rep) k LEFT JOIN fx_answer r ON r.record_id=c.case_id AND r.rep=k.rep GROUP BY 1,2")
def u5(v):
    a = v("fx_answer").select(F.col("record_id").alias("case_id"), F.col("rep").cast("long").alias("rep"), "error")
    return rn.resume_plan(a, a, 6)


@query("u6_manifest_diff", "SELECT run_id, 'arrival' AS field, CAST(a AS VARCHAR) AS \"left\", CAST(b AS VARCHAR) AS \"right\" FROM (SELECT a.run_id, sum(a.arrival)::BIGINT AS a, sum(b.arrival)::BIGINT AS b FROM fx_arrival a JOIN fx_arrival_b b ON a.run_id=b.run_id AND a.r=b.r AND a.c=b.c GROUP BY 1) t WHERE a<>b")
def u6(v):
    g = lambda n: v(n).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("arrival").alias("arrival"))
    return rn.manifest_diff(g("fx_arrival"), g("fx_arrival_b"), "run_id", ["n", "arrival"])


@query("u9_apply_decisions", "SELECT record_id, CASE WHEN record_id%4=0 THEN 'PASS' WHEN record_id%3=0 THEN 'FAIL' END AS decision FROM fx_record")
def u9(v):
    k = F.col("record_id")
    audit = v("fx_record").select("record_id", F.when(k % 4 == 0, "PASS").alias("decision"), (k % 3 == 0).alias("required"))
    verdicts = v("fx_record").select("record_id", F.lit("FAIL").alias("decision"))
    return rn.apply_decisions(audit, verdicts, ["record_id"]).select("record_id", "decision")


_ORD = "((conv_id*10+turn)*7919+11)%10007"


@query("t5_sample_narrations", f"""SELECT uid FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN category='complete' THEN 0 ELSE 1 END, o, uid) AS k FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY o, uid) AS n FROM (SELECT case_id*10+rep AS uid, case_id, category, ((case_id*10+rep)*7919+11)%10007 AS o FROM fx_eval WHERE length(reply)>200) t) z WHERE n=1) y WHERE k<=20""")
def t5(v):
    e = v("fx_eval").withColumn("uid", F.col("case_id") * 10 + F.col("rep"))
    return rn.sample_narrations(e, 20, 11, ["complete"], (F.col("uid") * 7919 + 11) % 10007).select("uid")


@query("t6_stratified_sample", """WITH s AS (SELECT record_id, model, arm, (record_id*7919+5)%10007 AS o FROM fx_record), q AS (SELECT model, arm, CAST(floor(100/count(*) OVER ()) AS BIGINT)+CASE WHEN row_number() OVER (ORDER BY model, arm)<=100%count(*) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT model, arm FROM s) d)
SELECT record_id, model, arm FROM (SELECT s.*, quota, row_number() OVER (PARTITION BY s.model, s.arm ORDER BY o, record_id) AS n FROM s JOIN q ON q.model=s.model AND q.arm=s.arm) t WHERE n<=quota""")
def t6(v):
    r = v("fx_record").select("record_id", "model", "arm")
    return rn.stratified_sample(r, ["model", "arm"], 100, 5, (F.col("record_id") * 7919 + 5) % 10007, "record_id")


@query("t7_blind", "SELECT record_id, 'R'||lpad(CAST(row_number() OVER (ORDER BY (record_id*7919+3)%10007, record_id) AS VARCHAR),6,'0') AS blind_id FROM fx_record")
def t7(v):
    return rn.blind(v("fx_record").select("record_id"), "R", 3, (F.col("record_id") * 7919 + 3) % 10007, "record_id")


@query("w17_assign_batches", "SELECT record_id, CAST(floor((row_number() OVER (ORDER BY record_id)-1)/12) AS BIGINT) AS batch FROM fx_record")
def w17(v):
    return rn.assign_batches(v("fx_record").select("record_id"), 12, ["record_id"])


@query("w5_change_hours", """SELECT user_id, period, cut_off, at_risk FROM (SELECT *, lag(cut_off) OVER w AS pc, lag(at_risk) OVER w AS pa, row_number() OVER w AS n FROM (SELECT user_id, event_id AS period, CAST(floor(value/20) AS BIGINT) AS cut_off, event_id%2 AS at_risk FROM events) t WINDOW w AS (PARTITION BY user_id ORDER BY period)) z WHERE n=1 OR pc<>cut_off OR pa<>at_risk""")
def w5(v):
    e = v("events").select("user_id", F.col("event_id").alias("period"), F.floor(F.col("value") / 20).alias("cut_off"), (F.col("event_id") % 2).alias("at_risk"))
    return rn.change_hours(e, ["user_id"])


@query("p16_stage_c_cases", "SELECT case_id, count(*) AS n FROM fx_eval WHERE stage_a_ok AND category<>'invalid_input' GROUP BY 1")
def p16(v):
    return rp.stage_c_cases(v("fx_eval"), "stage_a_ok").groupBy("case_id").agg(F.count("*").alias("n"))


@query("p12_clean_places", "SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN 'Village '||c_custkey ELSE c_name END AS name, CASE WHEN c_custkey%4<>0 THEN c_custkey::DOUBLE END AS population FROM customer WHERE NOT (c_custkey%3=1 AND c_custkey%5=0)")
def p12(v):
    k = F.col("c_custkey")
    c = v("customer").select("c_custkey", F.when(k % 3 == 0, F.concat(F.lit(" Village "), k.cast("string"), F.lit(" "))).otherwise("  ").alias("name_el"),
                             F.when((k % 3 == 1) & (k % 5 == 0), F.lit(None)).otherwise(F.col("c_name")).alias("name_en"), F.when(k % 4 == 0, "many").otherwise(k.cast("string")).alias("population"))
    return rp.clean_places(c, ["name_el", "name_en"]).select("c_custkey", "name", "population")


@query("p17_refuse_marked", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def p17(v):
    return rp.refuse_marked(v("documents"), "REHEARSAL-STUB").groupBy("source").agg(F.count("*").alias("n"))


@query("p18_assert_columns", "SELECT count(*) AS n FROM labels")
def p18(v):
    return rp.assert_columns(v("labels"), ["doc_id", "quality", "toxic"], ["ct_"]).agg(F.count("*").alias("n"))


@query("p21_resolve_sources", "SELECT record_id, CASE WHEN record_id%3=0 THEN 'human' WHEN record_id%3=1 THEN 'judge' END AS verdict FROM fx_record")
def p21(v):
    k = F.col("record_id") % 3
    r = v("fx_record").select("record_id", F.when(k == 0, "human").otherwise(" ").alias("human"), F.when(k < 2, "judge").alias("judge"))
    return rp.resolve_sources(r, {"verdict": ["missing", "human", "judge"]}).select("record_id", "verdict")


@query("p22_frozen_reason", "SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'folder en' WHEN url LIKE 'https://m.%' THEN 'prefix https://m.' END AS reason FROM pages")
def p22(v):
    return v("pages").select("page_id", rp.frozen_reason("url", ["en"], ["https://m."]).alias("reason"))


@query("p23_check_arms", "SELECT case_id, count(DISTINCT arm)<>1 AS mixed FROM fx_eval GROUP BY 1")
def p23(v):
    return rn.check_arms(v("fx_eval"))


@query("p1_validate_requests", """WITH q AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey%11=0 THEN NULL ELSE 3+o_custkey%42 END AS w, o_custkey%60 AS h, o_orderdate AS st FROM orders), p AS (SELECT l_orderkey AS request_id, count(*) AS n, count(*) FILTER (NOT (l_partkey BETWEEN 3 AND 1900)) AS bad FROM lineitem GROUP BY 1)
SELECT q.request_id, CASE WHEN coalesce(n,0)=0 THEN 'no_points' WHEN w IS NULL OR NOT w BETWEEN 6 AND 40 THEN 'window' WHEN NOT h BETWEEN 1 AND 48 THEN 'horizon' WHEN st+h*INTERVAL 1 HOUR>TIMESTAMP '1999-01-16' THEN 'beyond_forecast' WHEN bad>0 THEN 'outside_coverage' END AS error_code, CAST(CASE WHEN coalesce(n,0)=0 OR w IS NULL OR NOT w BETWEEN 6 AND 40 OR NOT h BETWEEN 1 AND 48 OR st+h*INTERVAL 1 HOUR>TIMESTAMP '1999-01-16' OR bad=0 THEN -1 ELSE bad END AS INT) AS n_bad FROM q LEFT JOIN p ON p.request_id=q.request_id""")
def p1(v):
    from hazardframe.operators.requests import validate_requests
    k = F.col("o_orderkey")
    req = v("orders").select(k.alias("request_id"), F.when(k % 11 != 0, 3 + F.col("o_custkey") % 42).alias("window_km"), (F.col("o_custkey") % 60).alias("horizon_h"), F.col("o_orderdate").cast("timestamp").alias("start"))
    pins = v("lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("pin_id"), F.col("l_partkey").alias("x"), F.lit(0).alias("y"))
    out = validate_requests(req, pins, (3, 0, 1900, 0), "1999-01-01 00:00:00")
    return out.select("request_id", "error_code", F.coalesce(F.size("bad_pins"), F.lit(-1)).alias("n_bad"))


# Reports.

@query("r25_rescore", "SELECT record_id, (kind%3<>0)<>(kind<5) AS changed, kind%3<>0 AS gate FROM fx_answer0")
def r25(v):
    r = v("fx_answer0").select("record_id", F.lit(1).alias("n_tool_calls"), F.lit(True).alias("must"), (F.col("kind") % 3 != 0).alias("policy_ok"), (F.col("kind") < 5).alias("stored_gate"))
    return rp.rescore(r).select("record_id", "changed", "gate")


@query("r26_evaluation_report", """SELECT arm, count(*) AS reps, count(DISTINCT case_id) AS cases, round(count(*) FILTER (stage_a_ok AND stage_b_ok)/count(*),3) AS pass1 FROM fx_eval GROUP BY 1""")
def r26(v):
    e = v("fx_eval").withColumn("gate", F.col("stage_a_ok") & F.col("stage_b_ok"))
    return rp.evaluation_report(e, ["stage_a_ok", "stage_b_ok"], "gate", ["arm"])["rates"].select("arm", "reps", "cases", "pass1")


@query("r27_prep_labeling", r"""SELECT CAST(floor((row_number() OVER (ORDER BY conv_id, turn)-1)/12) AS BIGINT) AS batch, conv_id, turn FROM conversations WHERE role='assistant' AND length(trim(text))>=120""")
def r27(v):
    c = v("conversations").filter("role = 'assistant'").withColumn("has", F.lit(True)).withColumn("n_tool_calls", F.lit(1))
    return rp.prep_labeling(c, "text", F.col("has"), ["conv_id", "turn"], 12).select("batch", "conv_id", "turn")


@query("r28_full_system", f"WITH {REC} SELECT model, arm, count(*) AS reps, round(count(*) FILTER (full_ok)/count(*),6) AS lower, count(*) FILTER (full_ok IS NULL) AS pending, count(*) FILTER (stage_c IS NULL) AS c_pending FROM rec GROUP BY 1,2")
def r28(v):
    return rp.full_system(v("fx_record"), ["model", "arm"])


@query("r29_arm_report", f"WITH {REC}, {PAIR} SELECT model, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c, count(*) AS pairs FROM pr GROUP BY 1")
def r29(v):
    return rp.arm_report(_rec(v), "full_ok", CRIT)["discordance"].select("model", "b", "c", "pairs")


@query("r30_gold_events", """WITH e AS (SELECT record_id, CASE WHEN c1>c0 THEN 1 WHEN c2>c1 THEN 2 WHEN c3>c2 THEN 4 END AS lo, CASE WHEN c3>c2 THEN 4 WHEN c2>c1 THEN 2 WHEN c1>c0 THEN 1 END AS hi, c1, c2, c3, c0 FROM fx_answer0)
SELECT record_id, 'E_ESCALATION' AS event_id, 'change_hours[period='||lo||'..'||hi||'].cut_off' AS source_path FROM e WHERE lo IS NOT NULL UNION ALL SELECT record_id, 'E_RISE_2', 'change_hours[period=2].cut_off' FROM e WHERE c2>c1
UNION ALL SELECT record_id, 'E_FIRST_IMPACTED', 'change_hours[period=2].impacted' FROM e UNION ALL SELECT record_id, 'E_FINAL', 'final_hour.cut_off, final_hour.at_risk' FROM e UNION ALL SELECT record_id, 'E_WEATHER_FORECAST', 'inputs.weather_source' FROM e WHERE c1%2=0 UNION ALL SELECT record_id, 'E_CLASS4', 'final_front_class4_pct' FROM e""")
def r30(v):
    prof = F.array(*[F.lit(x) for x in ("escalation", "rise:2", "first_impacted", "final", "weather", "class4")])
    return rp.gold_events(parsed(v).select("record_id", "p").withColumn("profile", prof), "record_id")[0].select("record_id", "event_id", "source_path")


@query("r32_judge_inputs", "SELECT record_id, 'R'||lpad(CAST(row_number() OVER (ORDER BY (record_id*7919+3)%10007, record_id) AS VARCHAR),6,'0') AS blind_id, kind IN (1) AS empty_text FROM fx_answer0")
def r32(v):
    out = rp.judge_inputs(parsed(v), 3, (F.col("record_id") * 7919 + 3) % 10007)
    return out.select("record_id", "blind_id", (F.trim("judged_text") == "").alias("empty_text"))


@query("r33_v3_aggregate", f"""WITH RECURSIVE {REC}, {PAIR}, d AS (SELECT model, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c FROM pr GROUP BY 1), t AS (SELECT model, b, c, b+c AS n, least(b,c) AS k, CAST(0 AS BIGINT) AS i, -(b+c)*ln(2.0::DOUBLE) AS l FROM d UNION ALL SELECT model, b, c, n, k, i+1, l+ln(n-i)-ln(i+1) FROM t WHERE i<k)
SELECT model, max(b) AS b, max(c) AS c, round(least(1.0, 2*sum(exp(l))),4) AS p FROM t GROUP BY 1""")
def r33(v):
    return rp.v3_aggregate(_rec(v), "full_ok")["paired"].select("model", "b", "c", "p")


@query("f46_cards", "SELECT record_id, 'Final hour 5: '||c3||' of '||at_risk||' cut off, '||edges||' roads removed' AS card FROM fx_answer0")
def f46(v):
    return parsed(v).select("record_id", rp.result_card(F.col("p")).alias("card"))
