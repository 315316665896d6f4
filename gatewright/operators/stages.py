"""What the validation stages do over a set of results: triggers, routing, failure modes.

Stage order is G5, G2, G4, G1, G3; the first stage that routes a record locks its decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import count_where, is_false, is_true, ratio

ORDER = ("G5", "G2", "G4", "G1", "G3")


def original_decision() -> Column:
    """BLOCK where the reviewer predicts a secret, else PASS."""
    return F.when(is_true(F.col("pred_has_secret")), "BLOCK").otherwise("PASS")


def router() -> Column:
    """The stage that routes a record to review; missing validity counts as valid."""
    return (
        F.when(is_false(F.col("g5_valid")), "G5")
        .when(is_false(F.col("g2_valid")), "G2")
        .when(is_true(F.col("g4_should_review")) & (F.col("original_decision") == "PASS"), "G4")
        .when(is_false(F.col("g1_valid")), "G1")
        .when(is_true(F.col("g3_leak_persisted")), "G3")
    )


def fired() -> dict[str, Column]:
    """Pipeline triggers: validity only."""
    return {
        "G5": is_false(F.col("g5_valid")),
        "G2": is_false(F.col("g2_valid")),
        "G4": is_true(F.col("g4_should_review")),
        "G1": is_false(F.col("g1_valid")),
        "G3": is_true(F.col("g3_triggered")),
    }


def noted() -> dict[str, Column]:
    """Triggers as the indicators count them: any issue, or having routed."""
    f, by = fired(), lambda g: F.col("routed_by").eqNullSafe(F.lit(g))
    return {
        "G5": f["G5"] | F.col("g5_category").isNotNull() | by("G5"),
        "G2": f["G2"] | is_true(F.col("g2_issue")) | by("G2"),
        "G4": f["G4"] | by("G4"),
        "G1": f["G1"] | is_true(F.col("g1_issue")) | by("G1"),
        "G3": f["G3"],
    }


def routed(results: DataFrame) -> DataFrame:
    """Evaluable results with original_decision, routed_by, final_decision and triggered (stages in order)."""
    out = results.where("guardrail_decision is not null").withColumn("original_decision", original_decision()).withColumn("routed_by", router())
    names = F.array_compact(F.array(*(F.when(c, F.lit(g)) for g, c in fired().items())))
    return out.withColumn("final_decision", F.when(F.col("routed_by").isNotNull(), "REVIEW").otherwise(F.col("original_decision"))).withColumn("triggered", names)


def routing_changes(results: DataFrame) -> DataFrame:
    """How recomputed routing differs from the stored decisions."""
    found = routed(results)
    stored, now = F.col("guardrail_decision"), F.col("final_decision")
    change = F.when(stored == now, "unchanged").when(now == "BLOCK", "block_restored").when(F.col("routed_by").isin("G1", "G3"), "rerouted").otherwise("other")
    return found.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def activity(results: DataFrame) -> DataFrame:
    """Triggers and routings by stage, and their shares of the evaluable results."""
    found = routed(results)
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("stage"), c.alias("hit"), F.col("routed_by").eqNullSafe(F.lit(g)).alias("lock")) for g, c in noted().items())))
    counted = found.select(each.alias("x")).groupBy("x.stage").agg(F.count("*").alias("n"), count_where(F.col("x.hit")).alias("n_triggered"), count_where(F.col("x.lock")).alias("n_routed"))
    return counted.select("*", ratio(F.col("n_triggered"), F.col("n")).alias("trigger_rate"), ratio(F.col("n_routed"), F.col("n_triggered")).alias("route_share"))


def activity_summary(results: DataFrame) -> DataFrame:
    n = F.size("triggered")
    return routed(results).agg(
        F.count("*").alias("n"),
        count_where(n > 0).alias("n_any"),
        count_where(n > 1).alias("n_several"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("most"),
        count_where(F.col("routed_by").isNotNull()).alias("n_routed"),
    )


def combinations(results: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent sets of stages that fire together; ties by name."""
    counted = routed(results).where(F.size("triggered") > 1).groupBy(F.array_join("triggered", "+").alias("stages")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "stages").limit(top)


def issue_breakdown(results: DataFrame) -> DataFrame:
    """How often each rule or category fires, by stage."""
    found = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("g5_category").isNotNull(), F.struct(F.lit("G5").alias("stage"), F.col("g5_category").alias("issue"))),
                F.when(is_true(F.col("g4_should_review")), F.struct(F.lit("G4").alias("stage"), F.coalesce("g4_rule", F.lit("unknown")).alias("issue"))),
                F.when(is_true(F.col("g2_issue")), F.struct(F.lit("G2").alias("stage"), F.lit("inconsistency").alias("issue"))),
                F.when(is_true(F.col("g1_issue")), F.struct(F.lit("G1").alias("stage"), F.lit("location").alias("issue"))),
            )
        )
    )
    return results.where("guardrail_decision is not null").select(found.alias("x")).groupBy("x.stage", "x.issue").agg(F.count("*").alias("n"))


def escalations(results: DataFrame) -> DataFrame:
    """Results that the uncertainty rules escalate, by rule, and how many of them hold a secret."""
    gt = is_true(F.col("gt_has_secret"))
    found = routed(results).where(is_true(F.col("g4_should_review")))
    return found.groupBy(F.coalesce("g4_rule", F.lit("unknown")).alias("rule")).agg(
        F.count("*").alias("n"), count_where(F.col("routed_by").eqNullSafe(F.lit("G4"))).alias("n_routed"), count_where(gt).alias("n_positive"), count_where(~gt).alias("n_negative")
    )


def coverage(results: DataFrame) -> DataFrame:
    """One row: how many results there are, how many each system has judged, and on how many several stages fire."""
    evaluable, n = F.col("guardrail_decision").isNotNull(), F.size(F.array_compact(F.array(*(F.when(c, F.lit(g)) for g, c in fired().items()))))
    counted = results.agg(
        F.count("*").alias("n_total"),
        count_where(F.col("scanner_hit").isNotNull()).alias("n_scanner"),
        count_where(F.col("baseline_decision").isNotNull()).alias("n_baseline"),
        count_where(evaluable).alias("n_evaluable"),
        count_where(~evaluable).alias("n_missing"),
        count_where(evaluable & (n == 1)).alias("n_single"),
        count_where(evaluable & (n > 1)).alias("n_several"),
    )
    return counted.select("*", ratio(F.col("n_single"), F.col("n_evaluable")).alias("single_rate"), ratio(F.col("n_several"), F.col("n_evaluable")).alias("several_rate"))


def leakage_kpis(results: DataFrame) -> DataFrame:
    before, after = is_true(F.col("leak_in_baseline")), is_true(F.col("leak_in_guardrail"))
    counted = results.where("guardrail_decision is not null").agg(
        F.count("*").alias("n"),
        count_where(before).alias("n_before"),
        count_where(after).alias("n_after"),
        count_where(before & after).alias("n_residual"),
        count_where(is_true(F.col("g3_triggered"))).alias("n_triggered"),
        count_where(is_true(F.col("g3_triggered")) & ~after).alias("n_mitigated"),
    )
    return counted.select("*", ratio(F.col("n_before") - F.col("n_residual"), F.col("n_before")).alias("mitigation_rate"))


def hint_kpis(results: DataFrame) -> DataFrame:
    """Detection among true secrets with and without a format hint."""
    hint, gt = is_true(F.col("g6_hint_injected")), is_true(F.col("gt_has_secret"))
    found = F.col("guardrail_decision").isin("BLOCK", "REVIEW")
    counted = results.where("guardrail_decision is not null").agg(
        count_where(hint).alias("n_hints"),
        count_where(hint & gt).alias("n_pos_with"),
        count_where(~hint & gt).alias("n_pos_without"),
        count_where(hint & gt & found).alias("n_found_with"),
        count_where(~hint & gt & found).alias("n_found_without"),
    )
    return counted.select("*", ratio(F.col("n_found_with"), F.col("n_pos_with")).alias("detection_with"), ratio(F.col("n_found_without"), F.col("n_pos_without")).alias("detection_without"))


def schema_kpis(results: DataFrame) -> DataFrame:
    valid = F.col("g5_valid")
    counted = results.where("guardrail_decision is not null").agg(F.count("*").alias("n"), count_where(is_true(valid)).alias("n_valid"), count_where(is_false(valid)).alias("n_invalid"), count_where(is_false(valid) & is_true(F.col("gt_has_secret"))).alias("n_invalid_pos"))
    return counted.select("*", ratio(F.col("n_invalid"), F.col("n")).alias("invalid_rate"))


def failure_modes(results: DataFrame) -> DataFrame:
    """Prevalence, intervention and residual of six failure modes, each over its own population.

    Residuals of the second and fifth mode cannot be observed and are null.
    """
    evaluated = F.col("guardrail_decision").isNotNull()
    found = results.withColumn("original_decision", original_decision())
    found = found.withColumn("routed_by", F.when(evaluated, router())).withColumn("triggered", F.when(evaluated, F.array_compact(F.array(*(F.when(c, F.lit(g)) for g, c in fired().items())))))
    done = is_true(F.col("bfm_executed"))
    acted = lambda g: F.coalesce(F.array_contains("triggered", g), F.lit(False)) | F.col("routed_by").eqNullSafe(F.lit(g))
    guarded = F.col("guardrail_decision").isNotNull()
    unseen = F.lit(None).cast("boolean")
    modes = {
        "FM1": (done, is_false(F.col("bfm_g1_valid")), acted("G1"), is_false(F.col("g1_valid"))),
        "FM2": (done, is_false(F.col("bfm_g2_valid")), acted("G2"), unseen),
        "FM3": (F.col("leak_in_baseline").isNotNull(), is_true(F.col("leak_in_baseline")), is_true(F.col("g3_triggered")), is_true(F.col("leak_in_guardrail"))),
        "FM4": (done, is_true(F.col("bfm_g4_should_review")), acted("G4"), is_true(F.col("g4_should_review"))),
        "FM5": (F.col("g5_valid").isNotNull(), is_false(F.col("g5_valid")), acted("G5"), unseen),
        "FM6": (guarded, is_true(F.col("g6_hint_injected")), F.lit(True), is_true(F.col("gt_has_secret")) & is_false(F.col("pred_has_secret"))),
    }
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("failure_mode"), e.alias("e"), (e & p).alias("p"), (e & p & i).alias("i"), (e & p & r).alias("r"), r.isNotNull().alias("seen")) for m, (e, p, i, r) in modes.items())))
    counted = found.select(each.alias("x")).groupBy("x.failure_mode").agg(
        count_where(F.col("x.e")).alias("n_evaluable"),
        count_where(F.col("x.p")).alias("prevalence"),
        count_where(F.col("x.i")).alias("intervention"),
        F.when(F.bool_or("x.seen"), count_where(F.col("x.r"))).alias("residual"),
    )
    return counted.select("*", ratio(F.col("prevalence"), F.col("n_evaluable")).alias("prevalence_rate"), ratio(F.col("intervention"), F.col("prevalence")).alias("intervention_rate"), ratio(F.col("residual"), F.col("prevalence")).alias("residual_rate"))
