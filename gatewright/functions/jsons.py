"""Strict reading of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """``text`` as VARIANT if it is one JSON value and nothing else; null otherwise.

    Spark reads the first value and ignores what follows. What follows must be nothing if the
    text is both an array's only content and a member's value: no character but white space
    can end the value in both.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_parse_json(text))
