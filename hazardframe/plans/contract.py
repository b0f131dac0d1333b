"""Contract scoring of structured answers as a staged pass over the run's rows.

Typed reply and payload are written once before the rules read them, so no rule parses a
text again and no filter on a verdict repeats the parse below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.functions import answers as an
from hazardframe.operators.common import materialise, spread


def parse_answers(rows: DataFrame, outputs: str = "tool_outputs", which: str = "last") -> DataFrame:
    """Rows with ``a`` (typed reply or null) and ``p`` (typed payload)."""
    staged = spread(rows).withColumn("_v", an.parse_reply("reply")).withColumn("_pv", an.pick_payload(outputs, which))
    return materialise(staged.withColumn("a", an.answer_of(F.col("_v"))).withColumn("p", an.payload(F.col("_pv"))).drop("_v", "_pv", outputs), "answers")


def score_contract(parsed: DataFrame) -> DataFrame:
    """Outcome, broken rules, slot mismatches and transition fields of every row."""
    a, p = F.col("a"), F.col("p")
    s = parsed.withColumns({
        "gt": an.cutoff_events(p), "mm": F.when(a.isNotNull(), an.slot_mismatches(a, p)),
        "emitted": an.entry_periods(F.col("a.critical_transitions")), "conformant": an.schema_conformant(a),
    })
    s = materialise(s, "contract")
    s = s.withColumn("problems", an.semantic_problems(a, p, F.col("gt"), F.col("mm")))
    s = s.withColumn("contract_outcome", an.contract_outcome("error", "reply", "n_tool_calls", "arm", a, F.col("conformant"), F.col("problems")))
    o = F.col("contract_outcome")
    s = s.withColumn("ct_scored", o.isin("valid", "validator_invalid") | ((o == "schema_invalid") & F.col("emitted").isNotNull()))
    s = s.withColumn("ct", an.transition_fields(F.when(F.col("ct_scored"), F.col("emitted")), F.col("gt"), F.transform("p.rows", lambda r: r["period"])))
    return materialise(s, "scored")
