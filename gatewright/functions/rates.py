"""Ratios with the two rules for an empty denominator, and three-valued counting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    """Rows where ``condition`` is true; null is not."""
    return F.count_if(condition)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole``; null for an empty whole."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def ratio_or_zero(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole``; zero for an empty whole."""
    return F.coalesce(ratio(part, whole, digits), F.lit(0.0))


def parity_round(value: Column, digits: int = 4) -> Column:
    """Rounding half to even on the decimal form, as Python's ``round`` does for most values."""
    return F.bround(value, digits)


def is_true(flag: Column) -> Column:
    return flag.eqNullSafe(F.lit(True))


def is_false(flag: Column) -> Column:
    return flag.eqNullSafe(F.lit(False))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Rates of a confusion table, null for empty denominators."""
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    }


def rates_or_zero(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """The same rates, zero for empty denominators; F1 from unrounded precision and recall."""
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    return {
        "precision": F.round(p, 4),
        "recall": F.round(r, 4),
        "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4),
        "accuracy": ratio_or_zero(tp + tn, tp + fp + tn + fn),
    }
