"""Confusion tables, decision profiles and slices of three detection systems.

All tables come from one pass: each result is unfolded into a row a system, and one
aggregation counts everything, so only counts cross the network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import count_where, is_true, rates, rates_or_zero, ratio

#: The systems in their order of report.
SYSTEMS = ("Scanner", "LLM_Baseline", "LLM_Guardrails")
#: Slices a result may belong to, any number of them at once.
SLICES: dict[str, Callable[[], Column]] = {
    "base": lambda: F.col("condition") == "B0",
    "stress": lambda: F.col("condition").startswith("E"),
    "neg_clean": lambda: F.col("control_type") == "no_secret",
    "neg_decoy": lambda: F.col("control_type") == "decoy",
    "real": lambda: F.col("sample_id").startswith("REAL"),
    "synthetic": lambda: F.col("sample_id").startswith("SYNTH"),
    "stress_untrusted_input": lambda: F.col("condition") == "E1-B",
    "stress_uncertainty": lambda: F.col("condition") == "E2-A",
    "stress_multi_fm": lambda: F.col("condition") == "E3-A",
    "stress_hardened": lambda: F.col("condition") == "E3-B",
}


def scanner_decision() -> Column:
    """BLOCK or PASS from the scanner's flag; null stays null."""
    return F.when(F.col("scanner_hit"), "BLOCK").when(~F.col("scanner_hit"), "PASS")


def unfolded(results: DataFrame, *keep: str) -> DataFrame:
    """A row for each result and system: mode, decision, gt and the columns to keep."""
    decisions = zip(SYSTEMS, (scanner_decision(), F.col("baseline_decision"), F.col("guardrail_decision")))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), d.alias("decision")) for m, d in decisions)))
    return results.select(F.coalesce("gt_has_secret", F.lit(False)).alias("gt"), *keep, each.alias("s")).select("gt", *keep, "s.mode", "s.decision")


def positive(view: str) -> Column:
    """Whether a decision counts as detection: alert takes BLOCK and REVIEW, autonomous BLOCK alone."""
    return F.col("decision").isin("BLOCK", "REVIEW") if view == "alert" else F.col("decision") == "BLOCK"


def _cells(hit: Column) -> dict[str, Column]:
    known, gt = F.col("decision").isNotNull(), F.col("gt")
    return {"tp": count_where(known & gt & hit), "fp": count_where(known & ~gt & hit), "tn": count_where(known & ~gt & ~hit), "fn": count_where(known & gt & ~hit)}


def _with(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select("*", *(c.alias(n) for n, c in columns.items()))


def _cell_columns() -> list[Column]:
    return [F.col(c) for c in ("tp", "fp", "tn", "fn")]


def mode_comparison(results: DataFrame, view: str) -> DataFrame:
    """Counts and rates by system; results without a decision are counted apart and left out of rates."""
    counted = unfolded(results).groupBy("mode").agg(
        F.count("*").alias("n_total"),
        F.count("decision").alias("n_evaluable"),
        count_where(F.col("decision").isNull()).alias("n_missing"),
        *(c.alias(n) for n, c in _cells(positive(view)).items()),
    )
    return _with(counted, rates(*_cell_columns()))


def mode_delta(results: DataFrame, view: str = "alert") -> DataFrame:
    """Each system's rates less those of the unguarded reviewer."""
    names = ("precision", "recall", "f1", "fpr", "fnr")
    found = mode_comparison(results, view)
    # a table of one row a system: the base is one row, fixed in size
    base = found.where(F.col("mode") == "LLM_Baseline").select(*(F.col(n).alias(f"base_{n}") for n in names))
    return found.crossJoin(F.broadcast(base)).select("mode", *(F.round(F.col(n) - F.col(f"base_{n}"), 4).alias(f"delta_{n}") for n in names))


def decision_profile(results: DataFrame, part: str = "all") -> DataFrame:
    """Decision counts and shares by system over all results, or those with or without a true secret."""
    rows = unfolded(results)
    rows = rows.where("gt") if part == "positive" else rows.where("not gt") if part == "negative" else rows
    known = F.col("decision").isNotNull()
    counted = rows.groupBy("mode").agg(
        F.count("*").alias("n_total"),
        *(count_where(F.col("decision") == d).alias(f"n_{d.lower()}") for d in ("BLOCK", "REVIEW", "PASS")),
        count_where(F.col("decision").isNull()).alias("n_missing"),
        count_where(known & F.col("gt")).alias("n_pos"),
        count_where(F.col("gt") & (F.col("decision") == "PASS")).alias("n_escaped"),
    )
    whole = F.col("n_block") + F.col("n_review") + F.col("n_pass")
    return _with(
        counted,
        {
            **{f"{d}_rate": ratio(F.col(f"n_{d}"), whole) for d in ("block", "review", "pass")},
            "escape_rate": ratio(F.col("n_escaped"), F.col("n_pos")),
            "block_share": ratio(F.col("n_block"), F.col("n_block") + F.col("n_review")),
        },
    )


def profile_delta(results: DataFrame) -> DataFrame:
    """Decision shares less those of the unguarded reviewer."""
    names = ("block_rate", "review_rate", "pass_rate", "escape_rate")
    found = decision_profile(results)
    base = found.where(F.col("mode") == "LLM_Baseline").select(*(F.col(n).alias(f"base_{n}") for n in names))
    return found.crossJoin(F.broadcast(base)).select("mode", *(F.round(F.col(n) - F.col(f"base_{n}"), 4).alias(f"delta_{n}") for n in names))


def legacy_modes() -> dict[str, Column]:
    """Predictions of the four older modes; a missing decision is no prediction."""
    guarded = F.col("guardrail_decision")
    return {
        "Scanner": F.col("scanner_hit"),
        "LLM_Baseline": F.col("baseline_pred"),
        "LLM_Guardrails_Autonomous": guarded == "BLOCK",
        "LLM_Guardrails_Alert": guarded.isin("BLOCK", "REVIEW"),
    }


def confusion(results: DataFrame, predictions: dict[str, Column], by: list[Column], null_is_false: bool = False) -> DataFrame:
    """Confusion counts and zero-filled rates by ``by`` and mode.

    A null prediction is skipped and counted, or taken as false. ``by`` columns must be aliased.
    """
    filled = {m: F.coalesce(p, F.lit(False)) if null_is_false else p for m, p in predictions.items()}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), p.alias("hit")) for m, p in filled.items())))
    rows = results.select(*(b for b in by), F.coalesce("gt_has_secret", F.lit(False)).alias("gt"), each.alias("s"))
    keys = [c for c in rows.columns if c not in ("gt", "s")]
    hit, gt = F.col("s.hit"), F.col("gt")
    counted = rows.groupBy(*keys, F.col("s.mode").alias("mode")).agg(
        F.count("*").alias("n"),
        count_where(hit.isNull()).alias("n_skipped"),
        count_where(gt & hit).alias("tp"),
        count_where(~gt & hit).alias("fp"),
        count_where(~gt & ~hit).alias("tn"),
        count_where(gt & ~hit).alias("fn"),
    )
    return _with(counted, rates_or_zero(*_cell_columns()))


def slice_performance(results: DataFrame) -> DataFrame:
    """Alert-level counts and rates by overlapping slice and system; empty slices have no row."""
    names = F.array_compact(F.array(*(F.when(member(), F.lit(name)) for name, member in SLICES.items())))
    marked = results.select("*", F.explode(names).alias("slice"))
    counted = unfolded(marked, "slice").groupBy("slice", "mode").agg(
        F.count("*").alias("n_total"),
        F.count("decision").alias("n_evaluable"),
        *(c.alias(n) for n, c in _cells(positive("alert")).items()),
    )
    return _with(counted.where("n_evaluable > 0"), rates(*_cell_columns()))


def partitions() -> dict[str, Column]:
    """Nine ways to part the results, each into disjoint classes."""
    negative = F.when(F.col("control_type") == "decoy", "NEG_DECOY").when(F.col("control_type") == "no_secret", "NEG_CLEAN")
    by_id = F.when(F.contains(F.upper("sample_id"), F.lit("DECOY")), "NEG_DECOY").when(F.contains(F.upper("sample_id"), F.lit("CLEAN")), "NEG_CLEAN").otherwise("NEG_OTHER")
    risky = F.lower(F.coalesce("file_path", F.lit("")))
    return {
        "by_condition": F.coalesce("condition", F.lit("unknown")),
        "by_stress": F.when((F.coalesce("condition", F.lit("B0")) != "B0") | is_true(F.col("is_extreme_case")), "STRESS").otherwise("B0"),
        "by_neg_type": F.when(is_true(F.col("gt_has_secret")), "POS").otherwise(F.coalesce(negative, by_id)),
        "by_origin": F.when(F.col("sample_id").startswith("REAL"), "REAL").when(F.col("sample_id").startswith("SYNT"), "SYNTH").otherwise("NEG"),
        "by_sample_group": F.regexp_extract("sample_id", "^([A-Z]+(?:_[A-Z]+)?)_", 1),
        "by_failure_mode": F.coalesce("failure_mode_target", F.lit("none")),
        "by_context_family": F.coalesce("context_family", F.lit("unknown")),
        "by_secret_type": F.coalesce("gt_secret_type", F.lit("none")),
        "by_high_risk_file": F.contains(risky, F.lit("config")).cast("string"),
    }


def slice_partition_metrics(results: DataFrame) -> DataFrame:
    """Confusion by each of the partitions, stacked: one unfolding, one aggregation."""
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("slice_name"), v.alias("slice_value")) for n, v in partitions().items())))
    rows = results.select("*", parts.alias("p"))
    return confusion(rows, legacy_modes(), [F.col("p.slice_name").alias("slice_name"), F.col("p.slice_value").alias("slice_value")])


def location_accuracy(results: DataFrame) -> DataFrame:
    """Of the true positives by type, how many name a span that holds the true line; no line is a miss."""
    found = results.where(is_true(F.col("gt_has_secret")) & is_true(F.col("pred_has_secret")))
    inside = F.coalesce(F.col("gt_line").between(F.col("pred_start"), F.col("pred_end")), F.lit(False))
    counted = found.groupBy(F.coalesce("gt_secret_type", F.lit("none")).alias("secret_type")).agg(F.count("*").alias("n"), count_where(inside).alias("n_correct"))
    return _with(counted, {"accuracy": ratio(F.col("n_correct"), F.col("n"))})


def dataset_summary(results: DataFrame) -> DataFrame:
    """How often each value of each descriptive column occurs, and its share."""
    names = ("condition", "control_type", "context_family", "gt_secret_type", "failure_mode_target")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.coalesce(F.col(n), F.lit("None")).alias("value")) for n in names)))
    counted = results.select(each.alias("v")).groupBy("v.field", "v.value").agg(F.count("*").alias("n"))
    totals = counted.groupBy("field").agg(F.sum("n").alias("total"))
    return counted.join(totals, "field").select("field", "value", "n", ratio(F.col("n"), F.col("total")).alias("share"))
