"""Gate policies as columns, and what they do over a set of results.

A policy is a chain of conditions over a few boolean inputs, so a decision is one
``CASE`` expression; all policies are computed in the same projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import count_where, is_false, is_true, ratio, ratio_or_zero

# Path fragments and types that raise a policy's risk.
RISKY_PATHS = (".env", "config", "credentials", "auth", "secret", "key")
RISKY_PATHS_LEGACY = (".env", "config", "settings", "credentials", "secrets", "auth", "password", "key", "token", "certificate")
CRITICAL_TYPES = ("private_key", "connection_string")
# Signs of an obfuscated secret, matched without regard to case.
OBFUSCATION = (r'\+\s*"[^"]*"\s*\+\s*"', r"part\d?\s*=", r"base64", r"\.decode\s*\(", r"\\x[0-9a-f]{2}", r"chr\s*\(", r"join\s*\(\s*\[")

POLICIES = ("p1", "p2", "p3")


def path_holds(path: Column, fragments: tuple[str, ...]) -> Column:
    """Whether the lower-cased path holds any fragment; false for a null path."""
    low = F.lower(F.coalesce(path, F.lit("")))
    out = F.lit(False)
    for f in fragments:
        out = out | F.contains(low, F.lit(f))
    return out


def critical(secret_type: Column) -> Column:
    return F.coalesce(F.lower(secret_type).isin(*CRITICAL_TYPES), F.lit(False))


def obfuscated(diff: Column) -> Column:
    return F.coalesce(diff.rlike("(?i)" + "|".join(f"(?:{p})" for p in OBFUSCATION)), F.lit(False))


def inputs(results: DataFrame) -> DataFrame:
    """``results`` with the policies' inputs; rows without a guarded decision are left out.

    Missing validity counts as valid. A hint is ignored only where the prediction is
    false, not where it is missing.
    """
    return results.where("guardrail_decision is not null").withColumns(
        {
            "S": is_true(F.col("scanner_hit")),
            "LB": F.col("guardrail_decision") == "BLOCK",
            "LR": F.col("guardrail_decision") == "REVIEW",
            "hard_fail": is_false(F.col("g5_valid")) | is_true(F.col("g3_leak_persisted")),
            "R": is_true(F.col("g4_should_review")) | is_false(F.col("g1_valid")) | is_false(F.col("g2_valid")) | (is_true(F.col("g6_hint_injected")) & is_false(F.col("pred_has_secret"))),
            "Q": is_true(F.col("g6_hint_injected")),
            "H": path_holds(F.col("file_path"), RISKY_PATHS),
            "C": critical(F.col("pred_secret_type")),
        }
    )


def veto() -> Column:
    """Whether the second policy lets the reviewer overrule the scanner."""
    s, lb = F.col("S"), F.col("LB")
    return ~F.col("hard_fail") & ~(s & lb) & s & is_false(F.col("pred_has_secret")) & ~F.col("H") & ~F.col("C")


def risk_score() -> Column:
    one = lambda c: F.when(c, 1).otherwise(0)
    return (2 * one(F.col("S")) + 2 * one(F.col("LB")) + one(F.col("LR") | F.col("R")) + one(F.col("Q")) + one(F.col("H")) + one(F.col("C"))).cast("long")


def decisions(results: DataFrame) -> DataFrame:
    """``inputs`` with the decisions p1, p2, p3, the score and the veto flag."""
    s, lb, lr, r, hard = (F.col(c) for c in ("S", "LB", "LR", "R", "hard_fail"))
    p1 = F.when(hard, "REVIEW").when(s | lb, "BLOCK").when(lr | r, "REVIEW").otherwise("PASS")
    p2 = F.when(hard, "REVIEW").when(s & lb, "BLOCK").when(F.col("vetoed"), "PASS").when(s | lb | lr | r, "REVIEW").otherwise("PASS")
    p3 = F.when(hard, "REVIEW").when((F.col("score") >= 4) & (s | lb), "BLOCK").when(F.col("score") >= 2, "REVIEW").otherwise("PASS")
    return inputs(results).withColumns({"score": risk_score(), "vetoed": veto()}).withColumns({"p1": p1, "p2": p2, "p3": p3})


def plain_policies(scanner: Column, reviewer: Column, secret_type: Column, path: Column) -> dict[str, Column]:
    """The three policies where no stage has run: the reviewer blocks or passes, and no review signal is set."""
    one = lambda c: F.when(c, 1).otherwise(0)
    risky, grave = path_holds(path, RISKY_PATHS), critical(secret_type)
    score = 2 * one(scanner) + 2 * one(reviewer) + one(risky) + one(grave)
    p2 = F.when(scanner & reviewer, "BLOCK").when(scanner & ~reviewer & ~risky & ~grave, "PASS").when(scanner | reviewer, "REVIEW").otherwise("PASS")
    return {"p1": F.when(scanner | reviewer, "BLOCK").otherwise("PASS"), "p2": p2, "p3": F.when((score >= 4) & (scanner | reviewer), "BLOCK").when(score >= 2, "REVIEW").otherwise("PASS")}


def reasons() -> dict[str, Column]:
    """Why each policy decided as it did."""
    hard = F.col("hard_fail")
    return {
        "p1_reason": F.when(hard, "output failed validation").when(F.col("S") | F.col("LB"), "scanner or reviewer found a secret").when(F.col("LR") | F.col("R"), "a review signal is set").otherwise("no signal"),
        "p2_reason": F.when(hard, "output failed validation").when(F.col("S") & F.col("LB"), "scanner and reviewer agree").when(F.col("vetoed"), "reviewer overrules scanner").when(F.col("p2") == "REVIEW", "signals disagree").otherwise("no signal"),
        "p3_reason": F.when(hard, "output failed validation").otherwise(F.concat(F.lit("score "), F.col("score").cast("string"))),
    }


def legacy_decisions(results: DataFrame) -> DataFrame:
    """The two older policies: consensus, and escalation with its cost gate.

    A null reviewer decision is one that was not invoked.
    """
    s = is_true(F.col("scanner_hit"))
    llm = F.col("guardrail_decision")
    hit = F.coalesce(llm == "BLOCK", F.lit(False))
    risky = path_holds(F.col("file_path"), RISKY_PATHS_LEGACY)
    grave, hidden = critical(F.col("pred_secret_type")), obfuscated(F.col("text"))
    invoke = risky | s | hidden
    consensus = F.when(llm == "REVIEW", "REVIEW").when(s & hit, "BLOCK").when(s | hit, "REVIEW").otherwise("PASS")
    escalation = (
        F.when(grave & s, "BLOCK")
        .when(~invoke, F.when(s, "REVIEW").otherwise("PASS"))
        .when(llm.isNull(), F.when(s, "REVIEW").otherwise("PASS"))
        .when(llm == "REVIEW", "REVIEW")
        .when(hit, "BLOCK")
        .when(s, "REVIEW")
        .otherwise("PASS")
    )
    return results.select("doc_id", risky.alias("is_high_risk_file"), grave.alias("is_critical_secret_type"), hidden.alias("obfuscation_suspected"), invoke.alias("invoke_llm"), consensus.alias("p2_consensus"), escalation.alias("p3_escalation"))


def _stacked(results: DataFrame) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.col(p).alias("decision")) for p in POLICIES)))
    return decisions(results).select(F.coalesce("gt_has_secret", F.lit(False)).alias("gt"), each.alias("x")).select("gt", "x.*")


def policy_metrics(results: DataFrame) -> DataFrame:
    """Decision counts, leak and false-block rates, review load and detection rates by policy."""
    d, gt = F.col("decision"), F.col("gt")
    alert = d.isin("BLOCK", "REVIEW")
    counted = _stacked(results).groupBy("policy").agg(
        F.count("*").alias("n"),
        *(count_where(d == x).alias(f"n_{x.lower()}") for x in ("BLOCK", "REVIEW", "PASS")),
        count_where(gt).alias("n_pos"),
        count_where(gt & (d == "PASS")).alias("n_leaked"),
        count_where(~gt & (d == "BLOCK")).alias("n_false_block"),
        count_where(gt & alert).alias("tp"),
        count_where(~gt & alert).alias("fp"),
    )
    n, pos, tp, fp = (F.col(c) for c in ("n", "n_pos", "tp", "fp"))
    return counted.select(
        "*",
        ratio_or_zero(F.col("n_leaked"), pos).alias("leak_escape_rate"),
        ratio_or_zero(F.col("n_false_block"), n - pos).alias("false_block_rate"),
        ratio_or_zero(F.col("n_review"), n).alias("review_load"),
        ratio_or_zero(2 * tp, tp + fp + pos).alias("alert_f1"),
    )


def gate_metrics(results: DataFrame) -> DataFrame:
    """Leak escape, false block and review load by policy over all results; a missing decision is PASS."""
    decided = decisions(results).select("doc_id", *POLICIES)
    rows = results.select("doc_id", F.coalesce("gt_has_secret", F.lit(False)).alias("gt")).join(decided, "doc_id", "left")
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.coalesce(F.col(p), F.lit("PASS")).alias("decision")) for p in POLICIES)))
    rows = rows.select("gt", each.alias("x")).select("gt", "x.*")
    d, gt = F.col("decision"), F.col("gt")
    return rows.groupBy("policy").agg(
        ratio_or_zero(count_where(gt & (d == "PASS")), count_where(gt)).alias("leak_escape_rate"),
        ratio_or_zero(count_where(~gt & (d == "BLOCK")), count_where(~gt)).alias("false_block_rate"),
        ratio_or_zero(count_where(d == "REVIEW"), F.count("*")).alias("review_load"),
    )


def best_policies(results: DataFrame) -> DataFrame:
    """For each gate metric the policy with the least value; a tie goes to the first policy."""
    long = gate_metrics(results).unpivot(["policy"], ["leak_escape_rate", "false_block_rate", "review_load"], "metric", "value")
    best = F.min(F.struct("value", "policy"))
    return long.groupBy("metric").agg(best["policy"].alias("policy"), best["value"].alias("value"))


def score_histogram(results: DataFrame) -> DataFrame:
    return decisions(results).groupBy("score").agg(F.count("*").alias("n"))


def veto_counts(results: DataFrame) -> DataFrame:
    """How often the reviewer overrules the scanner, and how often that lets a secret pass."""
    v = F.col("vetoed")
    return decisions(results).agg(count_where(v).alias("n_vetoes"), count_where(v & ~is_true(F.col("gt_has_secret"))).alias("n_right"), count_where(v & is_true(F.col("gt_has_secret"))).alias("n_leaks"))


def pass_difference(results: DataFrame) -> DataFrame:
    """Results that exactly one of the first two policies lets pass, and which."""
    found = decisions(results)
    first, second = (found.where(F.col(p) == "PASS").select("sample_id") for p in ("p1", "p2"))
    only_first = first.join(second, "sample_id", "left_anti").withColumn("only", F.lit("p1"))
    return only_first.unionByName(second.join(first, "sample_id", "left_anti").withColumn("only", F.lit("p2")))


def share_of_review(results: DataFrame) -> DataFrame:
    return policy_metrics(results).select("policy", ratio(F.col("n_review"), F.col("n")).alias("review_share"))
