"""Paired comparison of two detectors by McNemar's test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.gamma import chi_square_tail
from ..functions.rates import count_where, is_true

# The same p-values need the same limits and tolerance.
#: Discordant pairs below which the exact binomial is used.
EXACT_BELOW = 25
#: Arguments from which the logarithm of the factorial is approximated.
STIRLING_FROM = 20
#: Masses that exceed the observed one by no more count as no greater.
TOLERANCE = 1e-10

PAIRS = (
    ("Scanner", "LLM_Baseline"),
    ("Scanner", "LLM_Guardrails"),
    ("LLM_Baseline", "LLM_Guardrails"),
    ("Scanner", "LLM_Alert"),
    ("LLM_Baseline", "LLM_Alert"),
)


def detectors() -> dict[str, Column]:
    """Predictions of the detectors that are compared; a missing one is false."""
    guarded = F.col("guardrail_decision")
    return {
        "Scanner": is_true(F.col("scanner_hit")),
        "LLM_Baseline": is_true(F.col("baseline_pred")),
        "LLM_Guardrails": F.coalesce(guarded == "BLOCK", F.lit(False)),
        "LLM_Alert": F.coalesce(guarded.isin("BLOCK", "REVIEW"), F.lit(False)),
    }


def contingency(results: DataFrame) -> DataFrame:
    """Per pair: both right (a), only the first (b), only the second (c), both wrong (d)."""
    gt, found = F.coalesce("gt_has_secret", F.lit(False)), detectors()
    pair = F.explode(F.array(*(F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), (found[x] == gt).alias("r1"), (found[y] == gt).alias("r2")) for x, y in PAIRS)))
    one, two = F.col("x.r1"), F.col("x.r2")
    return results.select(pair.alias("x")).groupBy("x.first", "x.second").agg(
        count_where(one & two).alias("a"), count_where(one & ~two).alias("b"), count_where(~one & two).alias("c"), count_where(~one & ~two).alias("d")
    )


def log_factorial(n: int) -> float:
    if n < STIRLING_FROM:
        return sum(math.log(i) for i in range(2, n + 1))
    return n * math.log(n) - n + 0.5 * math.log(2 * math.pi * n)


def p_value(b: int, c: int) -> tuple[float, float, str]:
    """Statistic without correction, two-sided p-value, and the method."""
    n = b + c
    if n == 0:
        return 0.0, 1.0, "none"
    statistic = (b - c) ** 2 / n
    if n < EXACT_BELOW:
        mass = [math.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2)) for k in range(n + 1)]
        return statistic, min(1.0, sum(m for m in mass if m <= mass[min(b, c)] + TOLERANCE)), "exact"
    corrected = max(0.0, abs(b - c) - 1) ** 2 / n
    return statistic, math.erfc(math.sqrt(corrected / 2)), "chi2"


@F.pandas_udf(T.StructType([T.StructField("statistic", T.DoubleType()), T.StructField("p", T.DoubleType()), T.StructField("method", T.StringType())]))
def tested(b: pd.Series, c: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([p_value(int(x), int(y)) for x, y in zip(b, c)], columns=["statistic", "p", "method"])


def meaning(p: Column) -> Column:
    """How strong a p-value speaks against equal error rates."""
    return F.when(p < 0.001, "very strong").when(p < 0.01, "strong").when(p < 0.05, "moderate").otherwise("none")


def mcnemar(results: DataFrame) -> DataFrame:
    """The contingency table with statistic, p-value, method and meaning; one row a pair reaches Python."""
    found = contingency(results).withColumn("t", tested("b", "c"))
    return found.select("first", "second", "a", "b", "c", "d", F.round("t.statistic", 4).alias("statistic"), F.round("t.p", 6).alias("p_value"), "t.method", (F.col("t.p") < 0.05).alias("significant"), meaning(F.col("t.p")).alias("evidence"))


def cochran(results: DataFrame) -> DataFrame:
    """Cochran's Q over all ``detectors`` at once: whether they are right equally often.

    One row: n, how many detectors, how many samples they agree on, the statistic, its degrees
    of freedom, p-value and meaning. Detectors that agree on every sample give 0 and 1. All of
    it is one aggregation and column expressions.
    """
    gt, found = F.coalesce("gt_has_secret", F.lit(False)), detectors()
    k = len(found)
    right = [(p == gt).cast("long") for p in found.values()]
    marked = results.select(*(r.alias(f"r{i}") for i, r in enumerate(right))).withColumn("l", sum((F.col(f"r{i}") for i in range(k)), F.lit(0)))
    none = lambda c: F.coalesce(c, F.lit(0))
    sums = marked.agg(F.count("*").alias("n"), none(F.count_if(F.col("l").isin(0, k))).alias("n_agreed"), none(F.sum("l")).alias("t"), none(F.sum(F.col("l") * F.col("l"))).alias("t2"), *(none(F.sum(f"r{i}")).alias(f"g{i}") for i in range(k)))
    squares = sum((F.col(f"g{i}").cast("double") * F.col(f"g{i}") for i in range(k)), F.lit(0.0))
    total = F.col("t").cast("double")
    spread = k * total - F.col("t2")
    q = F.when(spread > 0, (k - 1) * (k * squares - total * total) / spread).otherwise(0.0)
    tested = sums.select("n", F.lit(k).alias("n_detectors"), "n_agreed", q.alias("q"), F.lit(k - 1).alias("df")).withColumn("p", chi_square_tail(F.col("q"), F.col("df")))
    return tested.select("n", "n_detectors", "n_agreed", F.round("q", 4).alias("statistic"), "df", F.round("p", 6).alias("p_value"), (F.col("p") < 0.05).alias("significant"), meaning(F.col("p")).alias("evidence"))
