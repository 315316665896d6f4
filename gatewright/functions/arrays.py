"""Running values over arrays, within a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` of each element with all before it, for an associative ``join``.

    Each step joins every element with the one 1, 2, 4, ... places before it, so n elements
    take n * log2(n) joins; appending to an array one by one would copy it n times.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def widened(state: Column, k: Column) -> Column:
        by = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(state, lambda v, i: F.when(i >= by, join(F.get(state, i - by), v)).otherwise(v))

    return F.aggregate(steps, values, widened)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def settled(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the named columns computed once.

    A projection's expressions are copied into each filter and, if cheap by the optimizer's
    reckoning, into each expression behind it; the columns of a generator are not.
    """
    out = rows.withColumn("_settled", F.explode(F.array(F.struct(*names))))
    return out.withColumns({n: F.col(f"_settled.{n}") for n in names}).drop("_settled")
