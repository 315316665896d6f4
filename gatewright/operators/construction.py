"""Building samples: injection points, generated secrets, templates, and cleaning of collected diffs."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diffs import lines as diff_lines
from .datasets import order_of
from .scanning import any_of

# Names that suggest a secret, and words that show a diff to be about one.
SECURE_NAMES = ("key", "token", "secret", "api", "auth", "password", "credential")
INDICATORS: dict[str, tuple[str, ...]] = {
    "api_key": ("api_key", "apikey", "api-key"),
    "password": ("password", "passwd", "pwd"),
    "token": ("token", "access_token", "auth_token"),
    "secret": ("secret", "client_secret"),
    "private_key": ("private_key", "-----begin"),
    "credential": ("credential", "cred"),
    "aws": ("akia", "aws_access_key", "aws_secret"),
    "database": ("db_password", "database_url", "connection_string"),
}
#: Shapes of generated secrets by type: what stands before the digest, and how much of it is used.
SHAPES = {"token": ("ghp_", 36), "api_key": ("sk_live_", 24), "password": ("Pw-", 12), "connection_string": ("postgres://svc:", 20)}
_ASSIGNED = r"""^\+\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*["'](.+?)["']"""


def injection_points(diffs: DataFrame, key: str, diff: str, hunk: int | None = None) -> DataFrame:
    """(key, line, name, value): of each diff, or of its ``hunk`` from 1, the first added assignment whose name suggests a secret, else the first."""
    of_hunk = "hunk > 0" if hunk is None else f"hunk = {hunk}"
    shown = diff_lines(diffs, key, diff).where(f"{of_hunk} and kind in ('added', 'context', 'other')")
    target = F.col("start") - 1 + F.row_number().over(Window.partitionBy(key, "hunk").orderBy("pos"))
    found = shown.withColumn("line", target.cast("long")).where(F.col("kind") == "added").where(F.col("text").rlike(_ASSIGNED))
    name, value = F.regexp_extract("text", _ASSIGNED, 1), F.regexp_extract("text", _ASSIGNED, 2)
    rank = F.when(any_of(F.lower(name), SECURE_NAMES), 0).otherwise(1)
    best = F.min(F.struct(rank.alias("rank"), "pos", "line", name.alias("name"), value.alias("value")))
    return found.groupBy(key).agg(best.alias("b")).select(key, "b.line", "b.name", "b.value")


def injected(diff: Column, name: Column, value: Column, secret: Column) -> Column:
    """``diff`` with ``secret`` for the literal ``value`` that ``name`` is given, where that stands first."""
    quoted = F.concat(name, F.lit(' = "'), value, F.lit('"'))
    at = F.position(quoted, diff)
    return F.when(at > 0, F.concat(F.left(diff, at - 1), name, F.lit(' = "'), secret, F.lit('"'), F.substr(diff, at + F.length(quoted)))).otherwise(diff)


def generated(kind: Column, seed: Column) -> Column:
    """A secret of the type's shape from a digest of the seed: the same under any partitioning; null for other types."""
    digest = F.sha2(F.concat(F.lit("secret-"), seed.cast("string")), 256)
    out = F.lit(None).cast("string")
    for name, (prefix, size) in SHAPES.items():
        out = F.when(kind == name, F.concat(F.lit(prefix), F.left(digest, F.lit(size)))).otherwise(out)
    return out


def all_added(code: Column, path: Column) -> Column:
    """Code as a diff that adds all of its lines."""
    body = F.split(code, "\n")
    return F.concat(F.lit("+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(body).cast("string"), F.lit(" @@\n"), F.array_join(F.transform(body, lambda x: F.concat(F.lit("+"), x)), "\n"))


def numbered_by(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """``rows`` numbered from 0 in a hexadecimal ``order``, without a task that sees them all.

    The order's first three digits deal the rows into buckets; the buckets are counted, and
    a row's number is that of the rows in the buckets before its own and its place there.
    """
    keyed = rows.withColumn("_order", order).withColumn("_bucket", F.left("_order", F.lit(3)))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # 4,096 rows at most
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order")) - 1
    return keyed.withColumn("_place", place).join(F.broadcast(starts), "_bucket").withColumn(name, F.col("_first") + F.col("_place")).drop("_order", "_bucket", "_place", "_first")


def dealt_families(samples: DataFrame, key: str, families: list[str], seed: int = 42) -> DataFrame:
    """(key, family): families in turn over a seeded order of the keys, so each is dealt once before any repeats."""
    names = F.array(*(F.lit(f) for f in families))
    turns = numbered_by(samples.select(key), order_of(seed, F.col(key)), "_turn")
    return turns.select(key, F.get(names, F.pmod("_turn", F.lit(len(families))).cast("int")).alias("family"))


def cycled(rows: DataFrame, order: str, templates: DataFrame, place: str, seed: int = 42) -> DataFrame:
    """Each row with the template that is its turn; ``templates`` has ``place``, counted from 0 without gaps."""
    n = templates.agg(F.count("*").alias("_total"))
    turns = numbered_by(rows, order_of(seed, F.col(order)), "_turn").crossJoin(F.broadcast(n))  # one row
    return turns.withColumn(place, F.pmod("_turn", F.col("_total"))).drop("_turn", "_total").join(templates, place).drop(place)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """``template`` with ``{name}`` replaced for each name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def indicators(diff: Column) -> Column:
    """The categories of words about secrets that a diff holds, in their order."""
    low = F.lower(F.coalesce(diff, F.lit("")))
    return F.array_compact(F.array(*(F.when(any_of(low, words), F.lit(c)) for c, words in INDICATORS.items())))


def sanitized(diff: Column) -> Column:
    """Long runs of token characters between delimiters, replaced."""
    return F.regexp_replace(diff, r"""(?<=["'=>:\s])([A-Za-z0-9+/=_-]{32,})(?=["'\s,;\n])""", "<REDACTED>")


def owner_and_repo(url: Column) -> Column:
    parts = F.split(F.rtrim(url, F.lit("/")), "/")
    return F.struct(F.element_at(parts, -2).alias("owner"), F.element_at(parts, -1).alias("repo"))


def limited(rows: DataFrame, group: str, order: str, each: int) -> DataFrame:
    """At most ``each`` rows a group, in the order of a column: a report's limit."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_k") <= each).drop("_k")


def _parses(diff: str | None) -> str:
    code = [x[1:] if x[:1] in "+ " else x for x in (diff or "").split("\n") if not x.startswith(("-", "@@", "diff --git", "index ", "+++"))]
    try:
        ast.parse("\n".join(code))
    except (SyntaxError, ValueError, RecursionError, OverflowError) as e:
        return type(e).__name__
    except MemoryError as e:
        # code nested too deep for the parser; any other lack of memory is no property of the code
        if "too complex" not in str(e):
            raise
        return type(e).__name__
    return ""


def syntax_errors(rows: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, error): whether the code that a diff leaves parses as Python; empty if it does.

    Code that is nested too deep for Python's parser is an error of the code, with the name that Python gives it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "error": [_parses(d) for d in b[diff]]})

    return rows.select(key, diff).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, error string")
