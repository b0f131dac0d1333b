"""Aggregates, joins and samples over run records (one row per case and repetition).

Verdicts are three-valued: null is undecided, never a failure. Rates always carry their
denominator and what was left out of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.functions.base import col
from hazardframe.operators.common import TASK_ROWS, global_rank, require_empty, small, spread

CASE = "case_id"


def _true(c: str) -> Column:
    return F.count_if(F.col(c))


def case_states(rows: DataFrame, verdict: str, keys: list[str] = (), case: str = CASE) -> DataFrame:
    """One verdict per case: false if any repetition fails, true if all pass, else undecided."""
    v = F.col(verdict)
    return rows.groupBy(*keys, case).agg(
        F.when(F.count_if(~v) > 0, False).when(F.count_if(v) == F.count("*"), True).alias(verdict), F.count("*").alias("reps")
    )


def pass_rates(rows: DataFrame, verdict: str, keys: list[str] = ()) -> DataFrame:
    """pass^1 over repetitions and pass^k over cases whose every repetition passes."""
    v = F.coalesce(F.col(verdict), F.lit(False))
    per = rows.groupBy(*keys, CASE).agg(F.count_if(v).alias("_p"), F.count("*").alias("_n"))
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("reps"), F.count("*").alias("cases"), F.round(F.sum("_p") / F.sum("_n"), 3).alias("pass1"),
        F.round(F.count_if(F.col("_p") == F.col("_n")) / F.count("*"), 3).alias("passk"),
    )


def category_rates(rows: DataFrame, checks: list[str], verdict: str, keys: list[str] = ("category",)) -> DataFrame:
    """Cases, repetitions, rate of every check, pass^1 and pass^k per category."""
    v = F.coalesce(F.col(verdict), F.lit(False))
    sums = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in checks]
    per = rows.groupBy(*keys, CASE).agg(F.count("*").alias("_n"), F.count_if(v).alias("_p"), *sums)
    n = F.sum("_n")
    return per.groupBy(*keys).agg(
        F.count("*").alias("cases"), n.alias("reps"), *[F.round(F.sum(c) / n, 3).alias(c) for c in checks],
        F.round(F.sum("_p") / n, 3).alias("pass1"), F.round(F.count_if(F.col("_p") == F.col("_n")) / F.count("*"), 3).alias("passk"),
    )


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def bounds(rows: DataFrame, verdict: str, keys: list[str] = ()) -> DataFrame:
    """Lower and upper bound of a rate with undecided rows, and their number."""
    n, t, u = F.count("*"), _true(verdict), F.count_if(F.col(verdict).isNull())
    rate = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    return rows.groupBy(*keys).agg(F.round(rate(t), 6).alias("lower"), F.round(rate(t + u), 6).alias("upper"), u.alias("pending"))


def passk_bounds(rows: DataFrame, verdict: str, keys: list[str] = ()) -> DataFrame:
    return bounds(case_states(rows, verdict, keys), verdict, keys)


def rate_cell(rows: DataFrame, verdict: str, level: str = "row", keys: list[str] = ()) -> DataFrame:
    """Passed, denominator, excluded and pending at row level, case level, or over everyone.

    ``itt`` counts undecided rows as not passed instead of leaving them out.
    """
    src = case_states(rows, verdict, keys) if level == "case" else rows
    v = F.col(verdict)
    out = src.groupBy(*keys).agg(
        F.count_if(v).alias("passed"), (F.count("*") if level == "itt" else F.count(v)).alias("denominator"),
        (F.lit(0) if level == "itt" else F.count_if(v.isNull())).cast("long").alias("excluded"), F.count_if(v.isNull()).alias("pending"),
    )
    return out.withColumn("rate", F.round(F.col("passed") / F.when(F.col("denominator") > 0, F.col("denominator")), 4))


def arm_difference(cells: DataFrame, keys: list[str], arm: str = "arm", base: str = "free", other: str = "structured") -> DataFrame:
    """Structured minus baseline in percentage points; null when either rate is undefined."""
    g = cells.groupBy(*keys).agg(
        F.max(F.when(F.col(arm) == base, F.col("passed") / F.when(F.col("denominator") > 0, F.col("denominator")))).alias("_b"),
        F.max(F.when(F.col(arm) == other, F.col("passed") / F.when(F.col("denominator") > 0, F.col("denominator")))).alias("_s"),
    )
    return g.select(*keys, F.round((F.col("_s") - F.col("_b")) * 100, 1).alias("diff_pp"))


def paired_states(rows: DataFrame, verdict: str, keys: list[str] = (), arm: str = "arm", base: str = "free", other: str = "structured") -> DataFrame:
    """Case verdicts of both arms side by side, cases present in both."""
    s = case_states(rows, verdict, [*keys, arm])
    a = s.filter(F.col(arm) == base).select(*keys, CASE, F.col(verdict).alias("base"))
    b = s.filter(F.col(arm) == other).select(*keys, CASE, F.col(verdict).alias("other"))
    return a.join(b, [*keys, CASE])


def discordance(rows: DataFrame, verdict: str, keys: list[str] = (), unit: str = "case") -> DataFrame:
    """Discordant cases in both directions, concordant and undecided ones. Only cases are
    paired units; pairing repetitions is refused."""
    if unit != "case":
        raise ValueError("repetitions of two arms are not paired observations; only cases are")
    p = paired_states(rows, verdict, keys)
    x, y = F.col("base"), F.col("other")
    both = x.isNotNull() & y.isNotNull()
    return p.groupBy(*keys).agg(
        F.count_if(both & x & ~y).alias("b"), F.count_if(both & ~x & y).alias("c"), F.count_if(both & (x == y)).alias("concordant"),
        F.count_if(~both).alias("undecided"), F.count("*").alias("pairs"),
    )


def sign_test(b, c) -> Column:
    """Exact two-sided sign test of discordant counts; null without any."""
    b, c = col(b), col(c)
    n, k = b + c, F.least(b, c)
    # ln of C(n, i) / 2^n by recurrence, summed up to the smaller count.
    start = F.struct((-n * F.log(F.lit(2.0))).alias("ln"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        ln = acc["ln"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(ln.alias("ln"), (acc["s"] + F.exp(ln)).alias("s"))

    steps = F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1).cast("long"))), lambda i: i <= k)
    return F.when(n > 0, F.round(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step, lambda a: a["s"])), 4))


def flip_attribution(rows: DataFrame, verdict: str, criteria: list[str], keys: list[str] = ()) -> DataFrame:
    """For each discordant case, the criteria whose case verdict differs between the arms."""
    d = paired_states(rows, verdict, keys).filter("base <> other").select(*keys, CASE, F.when(F.col("base"), "lost").otherwise("gained").alias("direction"))
    k = [*keys, "arm", CASE]
    agg = [F.when(F.count_if(~F.col(c)) > 0, False).when(F.count_if(F.col(c)) == F.count("*"), True).alias(c) for c in criteria]
    long = rows.groupBy(*k).agg(*agg).unpivot(k, criteria, "criterion", "state")
    side = long.groupBy(*keys, CASE, "criterion").agg(
        F.max(F.when(F.col("arm") == "free", F.col("state"))).alias("f"), F.max(F.when(F.col("arm") == "structured", F.col("state"))).alias("s"))
    changed = side.filter(~F.col("f").eqNullSafe(F.col("s")))
    out = d.join(changed, [*keys, CASE], "left")
    return out.groupBy(*keys, CASE, "direction").agg(F.array_join(F.array_sort(F.collect_list("criterion")), ",").alias("changed"))


def failure_attribution(rows: DataFrame, verdict: str, criteria: list[str], keys: list[str] = ("arm",)) -> DataFrame:
    """Among failing rows, how many fail each criterion."""
    bad = rows.filter(~F.col(verdict))
    long = bad.select(*keys, *criteria).unpivot(list(keys), criteria, "criterion", "state")
    return long.groupBy(*keys, "criterion").agg(F.count("*").alias("failing"), F.count_if(~F.col("state")).alias("n_failed"))


def variants(rows: DataFrame, verdict: str, keys: list[str]) -> DataFrame:
    """Headline under four denominator rules: P decided rows, V1 everyone, V2 pending counted
    as passed, V5 cases."""
    v = F.col(verdict)
    a = rows.groupBy(*keys).agg(F.count_if(v).alias("t"), F.count(v).alias("d"), F.count("*").alias("n"), F.count_if(v.isNull()).alias("u"))
    c = rate_cell(rows, verdict, "case", keys).select(*keys, F.col("passed").alias("cp"), F.col("denominator").alias("cd"))
    j = a.join(c, list(keys))
    r = lambda x, y: F.round(x / F.when(y > 0, y), 4)
    return j.select(*keys, r(F.col("t"), F.col("d")).alias("p"), r(F.col("t"), F.col("n")).alias("v1"), r(F.col("t") + F.col("u"), F.col("n")).alias("v2"), r(F.col("cp"), F.col("cd")).alias("v5"))


NOT_OUTPUT = ["runtime_error", "round_ceiling", "contract_not_attached"]


def validity_rates(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Schema and contract validity of the structured arm; provider and harness events are
    left out of the denominator and counted."""
    s = rows.filter(F.col("arm") == "structured")
    out = F.col("contract_outcome")
    excl = out.isin(NOT_OUTPUT) | ((out == "no_final_message") & (F.coalesce(F.col("finish_reason"), F.lit("")) == "content_filter"))
    den = F.count_if(~excl)
    return s.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(excl).alias("excluded"), den.alias("denominator"),
        F.round(F.count_if(~excl & out.isin("valid", "validator_invalid")) / F.when(den > 0, den), 4).alias("schema_rate"),
        F.round(F.count_if(~excl & (out == "valid")) / F.when(den > 0, den), 4).alias("contract_rate"),
    )


def transition_totals(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Decomposition of the transition requirement over scored rows (``ct`` struct, ``ct_scored``)."""
    s = rows.filter("ct_scored")
    n, gt = F.count("*"), F.sum("ct.n_gt")
    size = lambda c: F.sum(F.size(c)).cast("long")
    return s.groupBy(*keys).agg(
        n.alias("n_scored"), F.round(F.count_if("ct.exact") / n, 4).alias("exact_rate"),
        F.round(F.sum(F.when(F.col("ct.n_gt") > 0, F.col("ct.matched"))) / F.when(gt > 0, gt), 4).alias("event_recall"),
        F.count_if(F.col("ct.n_gt") == 0).alias("dropped_gt0"), F.round(F.count_if("ct.no_omission") / n, 4).alias("no_omission_rate"),
        F.round(size("ct.extras") / F.when(F.sum("ct.n_emitted") > 0, F.sum("ct.n_emitted")), 4).alias("extra_rate"),
        F.round(size("ct.extras") / n, 4).alias("extra_per_record"), F.round(F.count_if("ct.over_inclusive") / n, 4).alias("over_rate"),
        size("ct.extra_in_payload").alias("extra_in_payload"), size("ct.extra_not_in_payload").alias("extra_not_in_payload"),
        F.count_if(~F.col("ct.order_ok")).alias("order_violations"), F.count_if(F.size("ct.duplicates") > 0).alias("with_duplicates"),
    )


def label_distribution(claims: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Claims per label, records, records with a negative claim, and clean records."""
    neg = F.col("label").isin("NOT_IN_RESULT", "CONTRADICTED")
    per = claims.groupBy(*keys, "uid").agg(
        F.count_if(F.col("label") == "SUPPORTED").alias("s"), F.count_if(F.col("label") == "NOT_IN_RESULT").alias("m"),
        F.count_if(F.col("label") == "CONTRADICTED").alias("c"), F.count_if(neg).alias("neg"),
    )
    return per.groupBy(*keys).agg(
        F.sum("s").alias("supported"), F.sum("m").alias("not_in_result"), F.sum("c").alias("contradicted"), F.count("*").alias("records"),
        F.count_if(F.col("neg") > 0).alias("with_negative"), F.count_if(F.col("neg") == 0).alias("clean"),
    )


def family_flags(notes: DataFrame, claims: DataFrame) -> DataFrame:
    """Failure families per record, from the notes and from contradicted claims."""
    from hazardframe.functions import text as tx

    flags = [F.when(tx.flagged("notes", p) > 0, F.lit(f)) for f, p in tx.NOTE_FAMILIES.items()]
    verdict = F.lower(F.regexp_extract("notes", r"(?i)invented\s+(?:detail|content)\s*:\s*(none|no\b|yes|extensive)", 1))
    state = tx.uncalibrated_state("notes")
    geo = F.when(verdict.isin("yes", "extensive"), "fabricated_geography").when(verdict != "", None).otherwise(flags[0])
    a = notes.select("uid", F.explode(F.array_compact(F.array(geo, *flags[1:], F.when(state == "OMITTED", F.lit("uncalibrated_omitted"))))).alias("family"))
    cues = [F.when(tx.matches("justification", p), F.lit(f)) for f, p in tx.CLAIM_CUES.items()]
    b = claims.filter("label = 'CONTRADICTED'").select("uid", F.explode(F.array_compact(F.array(*cues))).alias("family"))
    return a.union(b).distinct()


def family_counts(flags: DataFrame, meta: DataFrame) -> DataFrame:
    """Records per family and category."""
    return flags.join(meta.select("uid", "category"), "uid").groupBy("family", "category").agg(F.count("*").alias("n"))


def name_inventory(notes: DataFrame) -> DataFrame:
    """Listed place names, once per record, under an accent-free key with the commonest spelling."""
    from hazardframe.functions import text as tx

    names = notes.select("uid", F.explode(tx.extract_names("notes")).alias("name")).distinct()
    per = names.groupBy(tx.name_key("name").alias("key"), "name").agg(F.count("*").alias("n"))
    return per.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"), F.sum("n").alias("n"))


def top_names(inventory: DataFrame, k: int = 12) -> DataFrame:
    return inventory.orderBy(F.col("n").desc(), F.col("key")).limit(k)


def cohens_kappa(pairs: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """Two-by-two table and kappa; null when chance agreement is complete."""
    x, y = F.col(a), F.col(b)
    t = pairs.groupBy(*keys).agg(
        F.count_if(x & y).alias("tt"), F.count_if(x & ~y).alias("tf"), F.count_if(~x & y).alias("ft"), F.count_if(~x & ~y).alias("ff"))
    n = F.col("tt") + F.col("tf") + F.col("ft") + F.col("ff")
    po = (F.col("tt") + F.col("ff")) / n
    pe = ((F.col("tt") + F.col("tf")) * (F.col("tt") + F.col("ft")) + (F.col("ft") + F.col("ff")) * (F.col("tf") + F.col("ff"))) / (n * n)
    return t.withColumn("kappa", F.when(pe != 1, F.round((po - pe) / (1 - pe), 6)))


def agreement(p1: DataFrame, p2: DataFrame, questions: list[str], key: str = "record_id") -> DataFrame:
    """Agreement of two passes per question: percent, distributions, flipped records."""
    a = p1.select(key, *[F.col(q).cast("string").alias(q) for q in questions]).unpivot([key], questions, "question", "a")
    b = p2.select(key, *[F.col(q).cast("string").alias(q) for q in questions]).unpivot([key], questions, "question", "b")
    j = a.join(b, [key, "question"])
    same = F.col("a").eqNullSafe(F.col("b"))
    return j.groupBy("question").agg(
        F.count("*").alias("n"), F.round(100.0 * F.count_if(same) / F.count("*"), 2).alias("agree_pct"), F.count_if(~same).alias("flipped"),
        F.count_if(F.col("a") == "true").alias("true1"), F.count_if(F.col("b") == "true").alias("true2"),
    )


#: ``mix`` goes from x to ((x * _MIX_A + part * _MIX_B + _MIX_C) * _MIX_D) modulo this prime.
_PRIME, _MIX_A, _MIX_B, _MIX_C, _MIX_D = 2147483647, 48271, 69621, 12345, 16807


def mix(*parts) -> Column:
    """Integer mixing of long columns (two multiplicative steps), for repeatable draws."""
    out = F.lit(0).cast("long")
    for p in parts:
        out = F.pmod((out * _MIX_A + F.pmod(col(p).cast("long"), F.lit(_PRIME)) * _MIX_B + _MIX_C), F.lit(_PRIME))
        out = F.pmod(out * _MIX_D, F.lit(_PRIME))
    return out


#: Up to so many cases, a table of them goes to every task. Places that a task looks at together.
TABLE_CASES, PLACES = 1 << 17, 1 << 20


def _sums_of_draws(per: DataFrame, n: int, draws: int, seed: int) -> list[tuple[int, int, int]]:
    """(draw, num, den): sums over the ``n`` cases that each draw picks, case ``mix(seed, draw, k) % n`` for each k below n.

    ``mix`` adds the same step to its value for each further k. Counted in such steps round the prime, a draw is one
    stretch of places, and stretches of several draws overlap: each stretch between two draws' ends is summed once, so
    the work is at most one look at every place, whatever the number of draws times cases. Few cases are looked up
    place by place; of many, each finds the places at which it stands, so no task holds more than its own cases.
    """
    spark, step = per.sparkSession, _MIX_B * _MIX_D % _PRIME
    back, turns, width = pow(step, -1, _PRIME), *divmod(n, _PRIME)
    of_seed = (seed % _PRIME * _MIX_B + _MIX_C) % _PRIME * _MIX_D % _PRIME
    of_draw = (of_seed * _MIX_A + np.arange(draws, dtype=np.int64) % _PRIME * _MIX_B + _MIX_C) % _PRIME * _MIX_D % _PRIME
    start = (of_draw * _MIX_A + _MIX_C) % _PRIME * _MIX_D % _PRIME * back % _PRIME
    end = (start + width) % _PRIME
    wraps = start + width >= _PRIME
    cuts = np.unique(np.concatenate([[0], start, end]))
    first, last = np.searchsorted(cuts, start), np.searchsorted(cuts, end)

    if n <= TABLE_CASES:
        covered = np.zeros(len(cuts) + 1, np.int64)
        np.add.at(covered, first, 1)
        np.add.at(covered, last, -1)
        covered = np.cumsum(covered)[:-1] + wraps.sum() > 0
        parts = [(i, x, min(x + PLACES, b)) for i, a, b in zip(np.flatnonzero(covered).tolist(), cuts[covered].tolist(), np.append(cuts[1:], _PRIME)[covered].tolist()) for x in range(a, b, PLACES)]
        table = np.zeros((2, n), np.int64)
        case, *both = (c.to_numpy() for c in per.select("_i", "num", "den").toArrow().columns)  # at most TABLE_CASES rows
        table[:, case] = both
        held = spark.sparkContext.broadcast(table)

        def run(batches):
            for batch in batches:
                own = [(i, *held.value[:, np.arange(a, b) * step % _PRIME % n].sum(axis=1).tolist()) for i, a, b in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], pa.int64()) for k in range(3)], names=["part", "num", "den"])

        tasks = max(1, min(len(parts), 4 * spark.sparkContext.defaultParallelism))
        rows = spark.createDataFrame(parts, "part long, a long, b long").repartition(tasks)
    else:
        shift = max(0, _PRIME.bit_length() - 20)
        bounds = np.searchsorted(cuts, np.arange((_PRIME >> shift) + 2, dtype=np.int64) << shift, "right") - 1

        def run(batches):
            sums = np.zeros((2, len(cuts)))
            for batch in batches:
                case, *both = (c.to_numpy() for c in batch.columns)
                for i in range(0, len(case), max(1, PLACES * n // _PRIME)):
                    some = slice(i, i + max(1, PLACES * n // _PRIME))
                    value = case[some, None] + np.arange(0, _PRIME, n)[None, :]
                    own, at = np.nonzero(value < _PRIME)
                    place = value[own, at] * back % _PRIME
                    part, upto = bounds[place >> shift], bounds[(place >> shift) + 1]
                    open_ = np.flatnonzero(part != upto)  # a cut stands among the places that share a bound
                    part[open_] = np.searchsorted(cuts, place[open_], "right") - 1
                    for total, x in zip(sums, both):
                        total += np.bincount(part, x[some][own], len(cuts))  # whole numbers below 2^53
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts))), *(pa.array(x.astype(np.int64)) for x in sums)], names=["part", "num", "den"])

        rows = spread(per.select("_i", "num", "den"), max(TASK_ROWS, -(-n // 512)))
    sums = np.zeros((2, len(cuts) + 1), np.int64)
    for r in rows.mapInArrow(run, "part long, num long, den long").groupBy("part").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).collect():  # two rows a draw at most
        sums[:, r["part"] + 1] = r["num"], r["den"]
    upto = np.cumsum(sums, axis=1)
    num, den = upto[:, last] - upto[:, first] + (wraps + turns) * upto[:, -1:]
    return list(zip(range(draws), num.tolist(), den.tolist()))


def cluster_bootstrap(rows: DataFrame, verdict: str, draws: int = 20000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a rate, resampling whole cases; null bounds without cases.

    Cases are pre-aggregated and numbered, picks come from integer mixing (see ``_sums_of_draws``); the
    bounds are order statistics found by rank over one number per draw.
    """
    spark = rows.sparkSession
    per = rows.groupBy(CASE).agg(F.count_if(F.coalesce(F.col(verdict), F.lit(False))).alias("num"), F.count("*").alias("den"))
    per = global_rank(per, [F.col(CASE)], "_r").select((F.col("_r") - 1).cast("long").alias("_i"), "num", "den")
    n = per.count()
    d = spark.createDataFrame(_sums_of_draws(per, n, draws, seed) if n else [], "draw long, num long, den long").select((F.col("num") / F.col("den")).alias("rate"))
    # Few distinct rates: count them, then find the bounds by cumulative rank.
    h = d.groupBy("rate").agg(F.count("*").alias("n"))
    h = h.withColumn("hi", F.sum("n").over(W.orderBy("rate")))
    lo, up = int(alpha / 2 * draws), int((1 - alpha / 2) * draws) - 1
    pick = lambda at: F.round(F.min(F.when(F.col("hi") > at, F.col("rate"))), 4)
    return h.agg(pick(lo).alias("lower"), pick(up).alias("upper"))


def verify_runs(rows: DataFrame, expect: int, keys: list[str]) -> DataFrame:
    """Counts, uniqueness, errors and excess tool calls per run cell, with a verdict."""
    per = rows.groupBy(*keys, CASE, "rep").agg(F.count("*").alias("_n"), F.count_if(F.col("error").isNotNull()).alias("_e"), F.count_if(F.col("n_tool_calls") > 1).alias("_m"))
    out = per.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.count("*").alias("unique_reps"), F.countDistinct(CASE).alias("cases"), F.count_if(F.col("_n") > 1).alias("duplicates"),
        F.sum("_e").alias("error_rows"), F.sum("_m").alias("multi_calls"),
    )
    return out.withColumn("ok", (F.col("rows") == expect) & (F.col("unique_reps") == expect) & (F.col("duplicates") == 0) & (F.col("error_rows") == 0))


def validate_decisions(dec: DataFrame, manifest: DataFrame, questions: list[str], stated: str = "stage_c_pass") -> DataFrame:
    """Records with a fault: missing, extra, duplicate, wrong null pattern, out-of-list
    answer, or a pass that contradicts the answers."""
    from hazardframe.functions.answers import v3_pass

    n = dec.groupBy("record_id").agg(F.count("*").alias("_n"))
    ids = manifest.select("record_id").withColumn("_want", F.lit(1)).join(n, "record_id", "full_outer")
    a = ids.select("record_id", F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_n") > 1, "duplicate").alias("fault"))
    any_null = F.lit(False)
    any_set = F.col(stated).isNotNull()
    for q in questions:
        any_null, any_set = any_null | F.col(q).isNull(), any_set | F.col(q).isNotNull()
    f = (
        F.when(~F.col("judgeable"), F.when(any_set, "null_pattern")).when(any_null, "null_pattern")
        .when(~F.col(questions[-1]).isin("true", "false", "NOT_APPLICABLE"), "enum").when(~F.col(stated).eqNullSafe(v3_pass(questions)), "pass")
    )
    b = dec.join(manifest.select("record_id"), "record_id", "left_semi").select("record_id", f.alias("fault"))
    return a.union(b).filter("fault IS NOT NULL").distinct()


def compare_runs(metrics: DataFrame, key: str, runs: list[str], names: list[str]) -> DataFrame:
    """Metrics as rows and runs as columns."""
    long = metrics.select(F.col(key).cast("string").alias("run"), *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["run"], names, "metric", "value")
    return long.groupBy("metric").pivot("run", runs).agg(F.max("value"))


def diff_summaries(ref: DataFrame, cand: DataFrame, keys: list[str], exact: list[str], close: list[str], rel: float = 0.01) -> DataFrame:
    """Fields that differ: exact ones at all, the others by more than one percent."""
    names = [*exact, *close]
    def long(d: DataFrame, v: str) -> DataFrame:
        return d.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(list(keys), names, "field", v)

    j = long(ref, "a").join(long(cand, "b"), [*keys, "field"], "full_outer")
    tol = F.when(F.col("field").isin(exact), ~F.col("a").eqNullSafe(F.col("b"))).otherwise(
        F.when(F.col("a").isNull() | F.col("b").isNull(), ~F.col("a").eqNullSafe(F.col("b"))).otherwise((F.col("a") != 0) & (F.abs(F.col("b") - F.col("a")) > rel * F.abs(F.col("a")))))
    return j.filter(tol)


def comparison_table(rows: DataFrame, criteria: list[str], keys: list[str] = ("model",)) -> DataFrame:
    """Baseline, structured and difference per criterion, at row and case level."""
    k = [*keys, "arm", CASE]
    long = rows.select(*k, *criteria).unpivot(k, criteria, "criterion", "v")
    out = None
    for level, name in (("row", "pass1"), ("case", "passk")):
        cells = rate_cell(long, "v", level, [*keys, "arm", "criterion"])
        g = cells.groupBy(*keys, "criterion").agg(
            F.max(F.when(F.col("arm") == "free", F.col("rate"))).alias("baseline"), F.max(F.when(F.col("arm") == "structured", F.col("rate"))).alias("structured"))
        g = g.join(arm_difference(cells, [*keys, "criterion"]), [*keys, "criterion"]).withColumn("level", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


def v3_cells(rows: DataFrame, verdict: str, keys: list[str] = ("arm", "model")) -> DataFrame:
    """Per arm and model: stage rates, rows not reached, pass^1, pass^k and the P/F string."""
    s = case_states(rows, verdict, keys).withColumn("pf", F.when(F.col(verdict), "P").when(~F.col(verdict), "F").otherwise("-"))
    pf = s.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(CASE, "pf"))), lambda x: x["pf"]), "").alias("pf"))
    r = rows.groupBy(*keys).agg(
        F.count("*").alias("reps"), _true("stage_a_ok").alias("a_ok"), _true("stage_b_ok").alias("b_ok"), _true(verdict).alias("c_ok"), F.count_if(F.col(verdict).isNull()).alias("not_reached"))
    return r.join(pass_rates(rows, verdict, keys).select(*keys, "pass1", "passk"), list(keys)).join(pf, list(keys))


# Joins and set operations over records.

def join_blind_sheet(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """Decisions joined back to their records; every id resolves once and holds PASS or FAIL."""
    require_empty(sheet.join(key, "decision_id", "left_anti").select("decision_id"), "unknown decision ids")
    require_empty(sheet.filter("decision IS NULL OR upper(trim(decision)) NOT IN ('PASS','FAIL')").select("decision_id"), "blank or invalid decisions")
    require_empty(sheet.groupBy("decision_id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate decisions")
    return sheet.join(key, "decision_id").withColumn("passed", F.upper(F.trim("decision")) == "PASS")


def pair_arms(rows: DataFrame, on: list[str], arm: str = "arm", base: str = "free", other: str = "structured") -> DataFrame:
    """Keys of both arms side by side with the side each is missing from."""
    a = rows.filter(F.col(arm) == base).select(*on).distinct().withColumn("_a", F.lit(1))
    b = rows.filter(F.col(arm) == other).select(*on).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "only_base").when(F.col("_a").isNull(), "only_other").otherwise("both")
    return a.join(b, on, "full_outer").select(*on, side.alias("side"))


def common_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases present in both frames."""
    return a.select(CASE).intersect(b.select(CASE))


def case_support(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every case of either frame with its ``support``: both, only_a or only_b (the lost cases)."""
    left = a.select(CASE).distinct().withColumn("_a", F.lit(True))
    right = b.select(CASE).distinct().withColumn("_b", F.lit(True))
    j = left.join(right, CASE, "full_outer")
    return j.select(CASE, F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both").alias("support"))


def check_arms(rows: DataFrame, arm: str = "arm") -> DataFrame:
    """Per case, whether its rows carry more than one value of the arm label."""
    return rows.groupBy(CASE).agg((~F.min(arm).eqNullSafe(F.max(arm)) | F.min(arm).isNull()).alias("mixed"))


def join_label_passes(rows: DataFrame, p1: DataFrame, p2: DataFrame, value: str = "clean") -> DataFrame:
    a = p1.select("uid", F.col(value).alias(f"{value}1"))
    b = p2.select("uid", F.col(value).alias(f"{value}2"))
    return rows.join(a, "uid", "left").join(b, "uid", "left")


def payload_matches(rows: DataFrame, frozen: DataFrame, strip: list[str] = ()) -> DataFrame:
    """Own payload equals the frozen one of its case, time keys left out (canonical text hash)."""
    from hazardframe.functions.json_text import canonical_hash

    f = frozen.select(CASE, canonical_hash("payload", strip).alias("_want"))
    return rows.join(f, CASE, "left").withColumn("same", canonical_hash("payload", strip).eqNullSafe(F.col("_want"))).drop("_want")


def resume_plan(rows: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Every (case, repetition) of the grid: keep, drop (error) or owe."""
    grid = cases.select(CASE).distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("rep", F.col("rep").cast("long"))
    have = rows.groupBy(CASE, "rep").agg(F.count("*").alias("_n"), F.count_if(F.col("error").isNotNull()).alias("_e"))
    require_empty(have.join(grid, [CASE, "rep"], "left_anti").select(CASE, "rep"), "rows outside the run's grid")
    require_empty(have.filter("_n > 1").select(CASE, "rep"), "duplicate rows")
    action = F.when(F.col("_n").isNull(), "owe").when(F.col("_e") > 0, "redo").otherwise("keep")
    return grid.join(have, [CASE, "rep"], "left").select(CASE, "rep", action.alias("action"))


def manifest_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of two manifests that disagree."""
    la = a.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], fields, "field", "left")
    lb = b.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], fields, "field", "right")
    return la.join(lb, [key, "field"]).filter(~F.col("left").eqNullSafe(F.col("right")))


def apply_decisions(audit: DataFrame, verdicts: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Earlier decisions stay, required open rows are filled; a missing one is an error."""
    v = verdicts.select(*keys, F.col("decision").alias("_d"))
    out = audit.join(v, keys, "left").withColumn("decision", F.coalesce(F.col("decision"), F.when(F.col("required"), F.col("_d")))).drop("_d")
    if strict:
        require_empty(out.filter("required AND decision IS NULL").select(*keys), "missing decisions")
    return out


# Ordered picks. ``order`` is a repeatable pseudo-random order, by default a hash.

def _order(seed: int, uid: str, order: Column | None) -> Column:
    return F.xxhash64(F.lit(seed), F.col(uid)) if order is None else order


def sample_narrations(rows: DataFrame, n: int, seed: int, priority: list[str], order: Column | None = None, uid: str = "uid") -> DataFrame:
    """Narrated rows, one repetition per case, priority categories first, ``n`` in all."""
    o = _order(seed, uid, order)
    first = rows.filter(F.length("reply") > 200).withColumn("_o", o).withColumn("_n", F.row_number().over(W.partitionBy(CASE).orderBy("_o", uid))).filter("_n = 1")
    rank = F.when(F.col("category").isin(priority), 0).otherwise(1)
    return first.orderBy(rank, "_o", uid).limit(n).drop("_o", "_n")


def stratified_sample(df: DataFrame, strata: list[str], n: int, seed: int, order: Column | None = None, uid: str = "uid") -> DataFrame:
    """``n`` rows over the strata: equal quotas, the remainder to the first strata in order."""
    s = df.withColumn("_o", _order(seed, uid, order))
    cells = s.groupBy(*strata).agg(F.count("*").alias("_size"))
    cells = cells.withColumn("_rank", F.row_number().over(W.orderBy(*strata))).withColumn("_k", F.count("*").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    quota = F.floor(F.lit(n) / F.col("_k")) + F.when(F.col("_rank") <= F.lit(n) % F.col("_k"), 1).otherwise(0)
    cells = cells.withColumn("_quota", quota)
    r = s.join(small(cells.select(*strata, "_quota")), strata).withColumn("_n", F.row_number().over(W.partitionBy(*strata).orderBy("_o", uid)))
    # The literal bound lets Spark keep only each task's first n rows of a stratum.
    return r.filter(F.col("_n") <= n).filter(F.col("_n") <= F.col("_quota")).drop("_o", "_n", "_quota")


def blind(df: DataFrame, prefix: str, seed: int, order: Column | None = None, uid: str = "uid") -> DataFrame:
    """Opaque sequential ids in shuffled order."""
    out = global_rank(df.withColumn("_o", _order(seed, uid, order)), [F.col("_o"), F.col(uid)], "_n")
    return out.withColumn("blind_id", F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), 6, "0"))).drop("_o", "_n")


def assign_batches(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Batch number of fixed size in order."""
    out = global_rank(df, [F.col(c) for c in order], "_n")
    return out.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def audit_tiers(claims: DataFrame) -> DataFrame:
    """Records with claim weight, tier and ``position``: heaviest first, then by uid."""
    weight = F.when(F.col("label") == "CONTRADICTED", 3).when(F.col("label") == "NOT_IN_RESULT", 1).otherwise(0)
    per = claims.groupBy("uid").agg(F.sum(weight).alias("weight"), F.count("*").alias("n_claims"))
    per = per.withColumn("tier", F.when(F.col("weight") >= 6, 1).when(F.col("weight") > 0, 2).otherwise(3))
    return global_rank(per, [F.desc("weight"), F.col("uid")], "position")


def change_hours(per_hour: DataFrame, keys: list[str]) -> DataFrame:
    """First hour and hours whose cut-off or at-risk count differs from the hour before."""
    w = W.partitionBy(*keys).orderBy("period")
    prev = F.lag(F.struct("cut_off", "at_risk")).over(w)
    return per_hour.withColumn("_p", prev).filter(F.col("_p").isNull() | ~F.col("_p").eqNullSafe(F.struct("cut_off", "at_risk"))).drop("_p")


def compact_payload(per_hour: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run: change rows in order and the final hour."""
    cols = [c for c in per_hour.columns if c not in keys]
    row = F.struct("period", *[c for c in cols if c != "period"])
    ch = change_hours(per_hour, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("change_hours"))
    return ch.join(per_hour.groupBy(*keys).agg(F.max_by(row, "period").alias("final_hour")), keys)


def cutoff_rises(change_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Change rows whose cut-off count exceeds the change row before; the first never."""
    w = W.partitionBy(*keys).orderBy("period")
    return change_rows.withColumn("before", F.lag("cut_off").over(w)).filter(F.col("cut_off") > F.col("before"))
