"""Queries of the text, answer and contract rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.catalog.registry import query
from hazardframe.functions import answers as an
from hazardframe.functions import json_text as jt
from hazardframe.functions import text as tx
from hazardframe.operators import runs as rn
from hazardframe.plans.contract import parse_answers, score_contract


_PARSED: dict = {}
_SCORED: dict = {}


def _key(v):
    return (v.sf_dir, v.spark.sparkContext.applicationId)


def parsed(v):
    """Answers with typed reply ``a`` and payload ``p``, written once per session."""
    if _key(v) not in _PARSED:
        outs = F.array(F.lit("INPUT ERROR: none"), F.col("payload"), F.lit("PIPELINE ERROR"))
        _PARSED[_key(v)] = parse_answers(v("fx_answer").withColumn("tool_outputs", outs))
    return _PARSED[_key(v)]


def scored(v):
    if _key(v) not in _SCORED:
        _SCORED[_key(v)] = score_contract(parsed(v))
    return _SCORED[_key(v)]


NR = "(CASE WHEN c1>c0 THEN 1 ELSE 0 END+CASE WHEN c2>c1 THEN 1 ELSE 0 END+CASE WHEN c3>c2 THEN 1 ELSE 0 END)"
OUTCOME = f"""CASE kind WHEN 8 THEN 'runtime_error' WHEN 9 THEN 'contract_not_attached' WHEN 7 THEN 'free_text' WHEN 1 THEN 'not_json' WHEN 2 THEN 'schema_invalid' WHEN 5 THEN 'schema_invalid' WHEN 3 THEN 'validator_invalid'
  WHEN 6 THEN 'validator_invalid' WHEN 4 THEN CASE WHEN {NR}>0 THEN 'validator_invalid' ELSE 'valid' END ELSE CASE WHEN {NR}>0 THEN 'valid' ELSE 'validator_invalid' END END"""
SCORED = "kind IN (0,2,3,4,6)"
ANS = f"ans AS (SELECT *, {NR} AS nr, {OUTCOME} AS outcome, {SCORED} AS sc, CASE WHEN kind IN (0,2,3,6) THEN {NR} ELSE 0 END AS nm, CASE WHEN kind=3 THEN 1 ELSE 0 END AS nx FROM fx_answer)"


@query("f26_pick_payload", "SELECT record_id, c3 AS cut_off, CASE WHEN c1%2=0 THEN 'forecast' ELSE 'archive' END AS source, kind NOT IN (1,7) AS is_object FROM fx_answer")
def f26(v):
    s = scored(v)
    return s.select("record_id", F.col("p.final.cut_off").alias("cut_off"), F.col("p.weather_source").alias("source"), F.col("a").isNotNull().alias("is_object"))


@query("f27_contract_outcome", f"WITH {ANS} SELECT record_id, outcome, outcome IN ('valid','validator_invalid') AS conformant FROM ans")
def f27(v):
    o = F.col("contract_outcome")
    return scored(v).select("record_id", o.alias("outcome"), o.isin("valid", "validator_invalid").alias("conformant"))


@query("f28_transition_fields", f"""WITH {ANS} SELECT record_id, CAST(nr AS INT) AS n_gt, CAST(nm+nx AS INT) AS n_emitted, CAST(nm AS INT) AS matched, CAST(nr-nm AS INT) AS n_missing, CAST(nx AS INT) AS n_extra, nx=0 AND nm=nr AS exact, nm=nr AS no_omission FROM ans WHERE sc""")
def f28(v):
    s = scored(v).filter("ct_scored")
    return s.select("record_id", "ct.n_gt", "ct.n_emitted", "ct.matched", F.size("ct.missing").alias("n_missing"), F.size("ct.extras").alias("n_extra"), "ct.exact", "ct.no_omission")


@query("u7_extras", f"WITH {ANS} SELECT record_id, CAST(9 AS BIGINT) AS period, FALSE AS in_payload FROM ans WHERE sc AND nx=1")
def u7(v):
    s = scored(v).filter("ct_scored").select("record_id", "ct", F.explode("ct.extras").alias("period"))
    return s.select("record_id", "period", F.array_contains("ct.extra_in_payload", F.col("period")).alias("in_payload"))


@query("w6_cutoff_events", """SELECT record_id, period FROM (SELECT record_id, unnest([{'p':1,'b':c0,'a':c1},{'p':2,'b':c1,'a':c2},{'p':4,'b':c2,'a':c3}]) AS x FROM fx_answer0) t, LATERAL (SELECT CAST(x.p AS BIGINT) AS period WHERE x.a>x.b) z""")
def w6(v):
    return parsed(v).select("record_id", F.explode(an.cutoff_events(F.col("p"))).alias("period"))


@query("f29_slot_mismatches", f"""WITH {ANS} SELECT record_id, CAST(CASE kind WHEN 6 THEN nr+2 WHEN 3 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS INT) AS n FROM ans WHERE kind NOT IN (1,7)""")
def f29(v):
    return scored(v).filter("a IS NOT NULL").select("record_id", F.size("mm").alias("n"))


_SAY = """CASE WHEN kind=4 THEN 'Το εργαλείο δεν παρήγαγε αποτέλεσμα: tool_error.' WHEN kind IN (1,5,7) THEN NULL ELSE 'Στην έναρξη (ώρα 0): '||(c0+b)||' οικισμοί χωρίς καμία διαδρομή διαφυγής.'
||CASE WHEN c1>c0 THEN '|Στην ώρα 1: '||(c1+b)||' οικισμοί χωρίς καμία διαδρομή διαφυγής.' ELSE '' END||CASE WHEN c2>c1 THEN '|Στην ώρα 2: '||(c2+b)||' οικισμοί χωρίς καμία διαδρομή διαφυγής.' ELSE '' END
||CASE WHEN c3>c2 THEN '|Στην ώρα 4: '||(c3+b)||' οικισμοί χωρίς καμία διαδρομή διαφυγής.' ELSE '' END||CASE WHEN kind=3 THEN '|Στην ώρα 9: 1 οικισμοί χωρίς καμία διαδρομή διαφυγής.' ELSE '' END
||'|Τελική ώρα 5: '||(c3+b)||' οικισμοί χωρίς καμία διαδρομή διαφυγής, '||edges||' οδικά τμήματα αφαιρέθηκαν.' END"""


@query("f30_render_slots", f"SELECT record_id, {_SAY} AS said FROM (SELECT *, CASE WHEN kind=6 THEN 1 ELSE 0 END AS b FROM fx_answer0) t")
def f30(v):
    said = an.render_slots(F.col("a"))
    return parsed(v).select("record_id", F.when(said.isNotNull(), F.array_join(said, "|")).alias("said"))


_INTERP = "'The situation of '||at_risk||' places grows and the wind carries the front toward the coast while crews hold the northern road open for everyone.'"
_SURF = f"CASE WHEN kind=7 THEN reply WHEN kind=1 THEN '' WHEN kind=4 THEN 'none'||chr(10)||'none' ELSE {_INTERP}||CASE WHEN kind=2 THEN '' ELSE chr(10)||'Indicative, without suppression; 123.4 km2 is an estimate.' END END"


@query("f31_narrative_surface", f"SELECT record_id, {_SURF} AS surface FROM fx_answer")
def f31(v):
    return parsed(v).select("record_id", an.narrative_surface("reply", "arm", F.col("a")).alias("surface"))


@query("f32_numeric_surface", f"SELECT record_id, CASE WHEN kind IN (1,7) THEN NULL ELSE s||chr(10)||coalesce(replace({_SAY},'|',chr(10)),'') END AS surface FROM (SELECT *, {_SURF} AS s, CASE WHEN kind=6 THEN 1 ELSE 0 END AS b FROM fx_answer) t")
def f32(v):
    return parsed(v).select("record_id", an.numeric_surface("reply", "arm", F.col("a")).alias("surface"))


@query("f51_judged_surface", f"SELECT record_id, CASE WHEN kind=0 THEN 'stored' ELSE {_SURF} END AS surface FROM fx_answer")
def f51(v):
    return parsed(v).select("record_id", an.judged_surface(F.when(F.col("kind") == 0, F.lit("stored")), "reply", "arm", F.col("a")).alias("surface"))


@query("p14_judgeable", f"SELECT record_id, kind<>8 AND length(trim({_SURF}))>=120 AS judgeable, kind<>9 AND length(trim({_SURF}))>=120 AS narrated FROM fx_answer")
def p14(v):
    a = parsed(v).withColumn("s", an.narrative_surface("reply", "arm", F.col("a"))).withColumn("has", F.col("p.present"))
    return a.select("record_id", an.judgeable("error", F.col("has"), F.col("s")).alias("judgeable"), an.narrated("n_tool_calls", F.col("has"), F.col("s")).alias("narrated"))


@query("p15_narrated", f"SELECT record_id FROM fx_answer WHERE kind<>9 AND length(trim({_SURF}))>=120")
def p15(v):
    a = parsed(v).withColumn("s", an.narrative_surface("reply", "arm", F.col("a")))
    return a.filter(an.narrated("n_tool_calls", F.col("p.present"), F.col("s"))).select("record_id")


@query("f41_structured_complete", f"WITH {ANS} SELECT record_id, CASE WHEN outcome='free_text' OR kind=7 THEN NULL WHEN outcome NOT IN ('valid','validator_invalid') THEN FALSE ELSE kind IN (0,6) OR (kind=4 AND nr=0) END AS complete FROM ans")
def f41(v):
    return scored(v).select("record_id", an.structured_complete("arm", "contract_outcome", "problems").alias("complete"))


@query("f49_envelope_status", """SELECT record_id, CASE WHEN kind IN (1,7) THEN '' WHEN kind=4 THEN 'tool_error' ELSE 'ok' END AS status, CASE WHEN kind=3 THEN 'direct' WHEN kind=5 THEN '' ELSE 'stop' END AS finish, CASE WHEN kind=8 THEN 'runtime_error' WHEN kind=9 THEN 'given' ELSE 'no_judgeable_surface' END AS reason FROM fx_answer""")
def f49(v):
    k = F.col("kind")
    meta = F.when(k == 5, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("tool_calls"), F.lit("stop")))
    return parsed(v).select("record_id", an.envelope_status("arm", F.col("a")).alias("status"), an.finish_reason(F.when(k == 3, F.lit("direct")), meta).alias("finish"),
                                 an.surface_reason(F.when(k == 9, F.lit("given")), "error").alias("reason"))


@query("f48_number_sheet", """SELECT record_id, 'final h5: cut_off='||c3||' at_risk='||at_risk||' edges='||edges||chr(10)||'class4: 62.5'||chr(10)||'weather: '||CASE WHEN c1%2=0 THEN 'forecast' ELSE 'archive' END||chr(10)||'h0: cut_off='||c0||chr(10)||'h1: cut_off='||c1||chr(10)||'h2: cut_off='||c2||chr(10)||'h4: cut_off='||c3 AS sheet FROM fx_answer""")
def f48(v):
    return parsed(v).select("record_id", an.number_sheet(F.col("p")).alias("sheet"))


@query("f19_numeric_traceability", """WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) AS t FROM documents), num AS (SELECT unnest([62.5,737,200,1500.25,200000,63,1500]::DOUBLE[]) AS n),
c AS (SELECT doc_id, t, unnest([TRY_CAST(replace(t,',','.') AS DOUBLE), CASE WHEN t LIKE '%.%' THEN TRY_CAST(replace(t,'.','') AS DOUBLE) END]) AS c FROM tok),
ok AS (SELECT doc_id, t, bool_or(coalesce(c<=48 OR (c BETWEEN 1900 AND 2100 AND floor(c)=c) OR EXISTS (SELECT 1 FROM num WHERE n IN (round(c,2),round_even(c,0)) OR n*1000 IN (round(c,2),round_even(c,0)) OR n/1000 IN (round(c,2),round_even(c,0))), FALSE)) AS fine, count(c) AS k FROM c GROUP BY 1,2)
SELECT d.doc_id, coalesce((SELECT count(*) FROM tok JOIN ok ON ok.doc_id=tok.doc_id AND ok.t=tok.t WHERE tok.doc_id=d.doc_id AND NOT fine AND k>0),0) AS n_untraced, (SELECT count(*) FROM tok WHERE tok.doc_id=d.doc_id) AS n_tokens FROM documents d""")
def f19(v):
    nums = tx.payload_numbers(F.lit('{"a": 62.5, "b": [737, 200], "c": "1500,25", "d": {"e": 200000}}'))
    d = v("documents").withColumn("n", nums)
    return d.select("doc_id", F.size(tx.untraced("text", F.col("n"))).cast("long").alias("n_untraced"), F.size(tx.numeric_tokens("text")).cast("long").alias("n_tokens"))


_GREEK = "CASE doc_id%4 WHEN 0 THEN ' Το μοντέλο είναι ενδεικτικό, χωρίς κατάσβεση.' WHEN 1 THEN ' Πρέπει οπωσδήποτε να φύγετε' WHEN 2 THEN ' Η τελική απόφαση είναι δική σας' ELSE '' END"


@query("f20_has_limits", """SELECT doc_id, doc_id%4=0 AS limits, doc_id%4=1 AS absolute FROM documents""")
def f20(v):
    t = F.concat(F.col("text"), F.expr(_GREEK))
    d = v("documents").withColumn("t", t)
    return d.select("doc_id", tx.has_limits("t").alias("limits"), tx.absolute_rec("t").alias("absolute"))


@query("f21_is_greek", r"""SELECT doc_id, coalesce(length(regexp_replace(regexp_replace(t,'[^\p{L}]','','g'),'[^\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]','','g'))/nullif(length(regexp_replace(t,'[^\p{L}]','','g')),0)>0.5, FALSE) AS greek
  FROM (SELECT doc_id, CASE WHEN doc_id%3=0 THEN 'Ελληνικό κείμενο με λίγα latin' ELSE text END AS t FROM documents) z""")
def f21(v):
    d = v("documents").withColumn("t", F.when(F.col("doc_id") % 3 == 0, "Ελληνικό κείμενο με λίγα latin").otherwise(F.col("text")))
    return d.select("doc_id", tx.is_greek("t").alias("greek"))


@query("f33_atomic_claims", r"""SELECT conv_id, turn, pos, claim FROM (SELECT conv_id, turn, unnest(l) AS claim, generate_subscripts(l,1) AS pos FROM (
  SELECT conv_id, turn, list_filter([trim(regexp_replace(regexp_replace(x,'^[\s\-*•·\d.)]+',''),'\s+',' ','g')) FOR x IN regexp_split_to_array(regexp_replace(text,'([.!;])\s+','\1'||chr(10),'g'),'\n+')], lambda x: length(x)>=12) AS l FROM conversations) t) z""")
def f33(v):
    c = v("conversations").select("conv_id", "turn", F.posexplode(tx.atomic_claims("text")).alias("pos", "claim"))
    return c.select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("pos"), "claim")


@query("f35_names", """SELECT uid, n.name, n.key FROM fx_note, (VALUES (0,'Ροβιές','ΡΟΒΙΕΣ'),(0,'Δαμιά','ΔΑΜΙΑ'),(3,'Κήρινθος','ΚΗΡΙΝΘΟΣ')) n(k,name,key) WHERE uid%6=n.k""")
def f35(v):
    n = v("fx_note").select("uid", F.explode(tx.extract_names("notes")).alias("name"))
    return n.select("uid", "name", tx.name_key("name").alias("key"))


_FAM = """fam AS (SELECT uid, 'fabricated_geography' AS family FROM fx_note WHERE uid%6 IN (0,1) UNION SELECT uid, 'uncalibrated_omitted' FROM fx_note WHERE uid%6=1 UNION SELECT uid, 'weather_source_error' FROM fx_note WHERE uid%6=3 UNION SELECT uid, 'crown_fire_gloss' FROM fx_note WHERE uid%6=4
  UNION SELECT uid, CASE justification WHEN 'wrong field: counts SETTLEMENTS' THEN 'field_confusion' WHEN 'off by one, wrong hour' THEN 'hour_attribution' ELSE 'weather_source_error' END FROM fx_claim WHERE label='CONTRADICTED')"""


@query("f34_family_flags", f"WITH {_FAM} SELECT uid, family FROM fam")
def f34(v):
    return rn.family_flags(v("fx_note"), v("fx_claim"))


@query("a36_family_counts", f"WITH {_FAM} SELECT family, category, count(*) AS n FROM fam JOIN fx_note USING (uid) GROUP BY 1,2")
def a36(v):
    return rn.family_counts(rn.family_flags(v("fx_note"), v("fx_claim")), v("fx_note"))


@query("a37_name_inventory", """SELECT n.key, n.name, count(*) AS n FROM fx_note, (VALUES (0,'Ροβιές','ΡΟΒΙΕΣ'),(0,'Δαμιά','ΔΑΜΙΑ'),(3,'Κήρινθος','ΚΗΡΙΝΘΟΣ')) n(k,name,key) WHERE uid%6=n.k GROUP BY 1,2""")
def a37(v):
    return rn.name_inventory(v("fx_note"))


@query("t9_top_names", """SELECT n.key, n.name, count(*) AS n FROM fx_note, (VALUES (0,'Ροβιές','ΡΟΒΙΕΣ'),(0,'Δαμιά','ΔΑΜΙΑ'),(3,'Κήρινθος','ΚΗΡΙΝΘΟΣ')) n(k,name,key) WHERE uid%6=n.k GROUP BY 1,2 ORDER BY n DESC, n.key LIMIT 12""")
def t9(v):
    return rn.top_names(rn.name_inventory(v("fx_note")))


@query("f36_mentions_hour", """SELECT record_id, rep IN (1,3) AS hit FROM fx_answer0""")
def f36(v):
    t = F.when(F.col("rep") == 1, F.lit("Την πρώτη ώρα κλείνει ο δρόμος 13")).when(F.col("rep") == 3, F.lit("στις 3 η ώρα")).otherwise(F.concat(F.lit("ώρα "), F.col("rep").cast("string"), F.lit(" και 1"), F.col("rep").cast("string"), F.lit("h")))
    return v("fx_answer0").select("record_id", tx.mentions_hour(t, "rep").alias("hit"))


@query("f42_fingerprint", r"SELECT doc_id, substr(sha256(regexp_replace(text,'\r\n?',chr(10),'g')),1,12) AS fp FROM documents")
def f42(v):
    return v("documents").select("doc_id", tx.fingerprint("text").alias("fp"))


@query("r37_instrument_hashes", r"SELECT item_id, substr(sha256(regexp_replace(text,'\r\n?',chr(10),'g')),1,12) AS prefix, sha256(regexp_replace(text,'\r\n?',chr(10),'g')) AS full_hash FROM benchmark")
def r37(v):
    return v("benchmark").select("item_id", tx.fingerprint("text").alias("prefix"), tx.fingerprint("text", 64).alias("full_hash"))


@query("f43_leaks", r"SELECT doc_id, len(regexp_extract_all(lower(text),'heren|ation|[0-9]{3}-[0-9]{4}'))::BIGINT AS n FROM documents")
def f43(v):
    return v("documents").select("doc_id", F.size(tx.leaks("text", "heren|ation|[0-9]{3}-[0-9]{4}")).cast("long").alias("n"))


@query("f44_parse_bool", """SELECT o_orderkey, CASE o_orderkey%6 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE END AS b, CASE WHEN o_orderkey%6<5 THEN o_orderkey END AS i FROM orders""")
def f44(v):
    k = F.col("o_orderkey") % 6
    t = F.element_at(F.array(*[F.lit(x) for x in (" True ", "PASS", "no", "F", "maybe", "")]), (k + 1).cast("int"))
    i = F.when(k < 5, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).otherwise("x1")
    return v("orders").select("o_orderkey", tx.parse_bool(t).alias("b"), tx.parse_int(i).alias("i"))


@query("p13_parse_population", "SELECT c_custkey, CASE WHEN c_custkey%5=0 THEN NULL ELSE (1000+c_custkey%9000)::DOUBLE END AS pop FROM customer")
def p13(v):
    n = (1000 + F.col("c_custkey") % 9000).cast("string")
    t = F.when(F.col("c_custkey") % 5 == 0, "about two").otherwise(F.concat(F.lit(" "), F.regexp_replace(n, r"(\d)(\d{3})$", "$1,$2")))
    return v("customer").select("c_custkey", tx.parse_population(t).alias("pop"))


@query("f45_delete_sentence", """SELECT item_id, CASE WHEN (length(text)-length(replace(text, s, '')))=length(s) THEN replace(text, s, '') END AS rest FROM (SELECT item_id, text, split_part(text,'.',1)||'.' AS s FROM benchmark) t""")
def f45(v):
    b = v("benchmark").withColumn("s", F.concat(F.split("text", r"\.")[0], F.lit(".")))
    return b.select("item_id", tx.delete_sentence("text", "s").alias("rest"))


@query("f24_score_calls", "SELECT record_id, CASE WHEN kind%2=0 AND kind=9 THEN NULL WHEN kind%2=0 AND c0=0 THEN 'Tool-Skip' WHEN (kind%2=0 AND c0>1) OR (kind%2=1 AND c0>0) THEN 'Unnecessary-Tool-Use' END AS fault FROM fx_answer0")
def f24(v):
    return v("fx_answer0").select("record_id", an.score_calls("c0", F.col("kind") % 2 == 0).alias("fault"))


@query("f23_score_args", """SELECT record_id, array_to_string(list_sort(list_filter([CASE WHEN kind IN (1,2) THEN 'window_km' END, CASE WHEN kind IN (2,3) THEN 'start_time' END, CASE WHEN kind=4 THEN 'scenario' END], lambda x: x IS NOT NULL)),',') AS wrong FROM fx_answer0""")
def f23(v):
    k = F.col("kind")
    got = F.create_map(F.lit("window_km"), F.when(k.isin(1, 2), "13").otherwise("12,0"), F.lit("start_time"), F.when(k.isin(2, 3), "2021-08-05T15:00").otherwise("2021-08-05T12:00Z"), F.lit("scenario"), F.when(k == 4, F.lit("x")))
    want = F.create_map(F.lit("window_km"), F.lit("12"), F.lit("start_time"), F.when(k.isin(2, 3), "2021-08-05T13:00").otherwise("2021-08-05T15:00"))
    return v("fx_answer0").select("record_id", F.array_join(an.score_args(got, want, F.array(F.lit("scenario"))), ",").alias("wrong"))


@query("f25_invalid_behaviour", "SELECT record_id, CASE WHEN kind IN (0,1) THEN 'relayed_tool_error' WHEN kind IN (2,3) THEN 'silent_correction' WHEN kind IN (4,5) THEN 'FABRICATED_TOOL_ERROR' ELSE 'declined_own_voice' END AS b FROM fx_answer0")
def f25(v):
    k = F.col("kind")
    outs = F.when(k.isin(0, 1), F.array(F.lit("ok"), F.lit("INPUT ERROR: bad"))).otherwise(F.array(F.lit("ok")))
    reply = F.when(k.isin(2, 3, 4, 5), "input  error: window").otherwise("no")
    return v("fx_answer0").select("record_id", an.invalid_behaviour(reply, outs, F.when(k.isin(2, 3), 1).otherwise(0)).alias("b"))


@query("f22_policies", """SELECT record_id, kind IN (0,1) AS relay, CASE WHEN c1%2=0 THEN kind IN (0,2) END AS disclose, kind=3 AS defaults, kind<>4 AS no_coords FROM fx_answer""")
def f22(v):
    k = F.col("kind")
    reply = (F.when(k == 0, "Window must be 6-40 km; the weather is a forecast").when(k == 1, "WINDOW must be 6-40 km").when(k == 2, "Με πρόγνωση καιρού").when(k == 3, "Προτείνω 12 χιλιόμετρα και 6 ωρών")
             .when(k == 4, "at 38.123, 23.456").otherwise("nothing"))
    want = F.array(*[F.lit(x) for x in ("relay_input_error_verbatim", "disclose_forecast_weather", "propose_defaults_12km_6h", "no_invented_coordinates")])
    m = an.policies(reply, want, F.array(F.lit("INPUT ERROR: window must be 6-40 km.")), F.col("p"))
    a = parsed(v).withColumn("m", m)
    return a.select("record_id", F.col("m")["relay_input_error_verbatim"].alias("relay"), F.col("m")["disclose_forecast_weather"].alias("disclose"), F.col("m")["propose_defaults_12km_6h"].alias("defaults"), F.col("m")["no_invented_coordinates"].alias("no_coords"))


@query("f47_red_flags", "SELECT record_id, array_to_string(list_filter([CASE WHEN kind=1 THEN 'args' END, CASE WHEN kind<3 THEN 'policy' END, CASE WHEN kind=5 THEN 'numbers' END], lambda x: x IS NOT NULL), ',') AS flags FROM fx_answer0")
def f47(v):
    k = F.col("kind")
    f = an.red_flags(F.array(F.when(k == 1, F.lit("args"))), F.array(F.when(k < 3, F.lit("policy")), F.lit("")), F.array(F.when(k == 5, F.lit("numbers"))))
    return v("fx_answer0").select("record_id", F.array_join(f, ",").alias("flags"))


@query("j20_payload_matches", "SELECT record_id, kind<>6 AS same FROM fx_answer0")
def j20(v):
    a = v("fx_answer").withColumn("case_id", F.col("record_id"))
    frozen = a.select("case_id", "payload")
    own = F.when(F.col("kind") == 6, F.regexp_replace("payload", "62.5", "62.6")).otherwise(F.regexp_replace("payload", r'"run_id":"r",', ' "elapsed_min": 3.5, "run_id" : "other" , '))
    rows = a.withColumn("payload", own)
    return rn.payload_matches(rows, frozen, ["run_id", "elapsed_min"]).select("record_id", "same")


@query("r31_freeze_payloads", "SELECT case_id, count(DISTINCT payload) AS n_payloads FROM (SELECT case_id, replace(payload,'\"run_id\":\"r\",','') AS payload FROM fx_answer) t GROUP BY 1")
def r31(v):
    return v("fx_answer").groupBy("case_id").agg(F.countDistinct(jt.canonical_hash("payload", ["run_id"])).alias("n_payloads"))
