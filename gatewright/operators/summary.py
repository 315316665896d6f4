"""The summary of a run: totals, subtotals and shares by grouping sets, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import count_where, is_true

#: Groupings of the summary: all, by truth, by condition, by family, by condition and truth, and by file kind.
SETS = ((), ("truth",), ("condition",), ("context_family",), ("condition", "truth"), ("context_family", "truth"))
GROUPS = ("condition", "context_family", "truth")
DECISIONS = ("BLOCK", "REVIEW", "PASS")


def run_summary(results: DataFrame) -> DataFrame:
    """One row for every group of ``SETS``: counts and shares of decisions, of the scanner's and the reviewers' hits and of leaks.

    ``grouping`` has a bit for each of ``GROUPS``, the first the highest, that is set where
    the row is over all its values. A row's shares are of its own n; missing decisions count
    as undecided. Only partial counts are shuffled, once.
    """
    guarded, plain = F.col("guardrail_decision"), F.col("baseline_decision")
    truth = F.when(is_true(F.col("gt_has_secret")), "secret").otherwise("clean")
    rows = results.select("condition", "context_family", truth.alias("truth"), guarded, plain, "scanner_hit", "gt_has_secret", "leak_in_baseline", "leak_in_guardrail", "g3_leak_persisted", "n_chars")
    counts = {
        "n": F.count("*"),
        **{f"n_{d.lower()}": count_where(guarded == d) for d in DECISIONS},
        "n_undecided": count_where(guarded.isNull()),
        **{f"n_baseline_{d.lower()}": count_where(plain == d) for d in DECISIONS},
        "n_scanner": count_where(is_true(F.col("scanner_hit"))),
        "n_missed": count_where(is_true(F.col("gt_has_secret")) & (guarded == "PASS")),
        "n_false_blocks": count_where(~is_true(F.col("gt_has_secret")) & (guarded == "BLOCK")),
        "n_leaks_before": count_where(is_true(F.col("leak_in_baseline"))),
        "n_leaks_after": count_where(is_true(F.col("leak_in_guardrail"))),
        "n_chars": F.sum("n_chars"),
    }
    columns = [F.col(g) for g in GROUPS]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in SETS], *columns).agg(F.grouping_id().cast("int").alias("grouping"), *(c.alias(n) for n, c in counts.items()))
    share = lambda n: F.round(F.col(n) / F.col("n"), 4)
    return grouped.select("grouping", *GROUPS, *counts, *(share(f"n_{d.lower()}").alias(f"share_{d.lower()}") for d in DECISIONS), share("n_scanner").alias("share_scanner"), share("n_leaks_after").alias("share_leaks"))
