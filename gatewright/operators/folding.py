"""The string that a line of code assigns, with sums of literals and of names folded.

A text's lines are joined where one goes on in the next (a backslash, an open bracket), and
each assignment is evaluated in order: its terms are literals or names that were assigned
before, added up or side by side. The state is an array of names and values, so nothing
leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import bound

#: A string literal, a comment, a name, or any other character but white space.
_TOKEN = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|#.*|[A-Za-z_][\w.]*|[^\s]"""
_LITERAL = r"""^["']"""
_STATE = "array<struct<name:string,value:string>>"


def logical_lines(code: Column, until: Column | None = None) -> Column:
    """Array of (first, last, text): lines without their diff mark, joined where they go on, with the numbers of their first and last.

    With ``until``, only statements that begin on that line or before it, whole; the text of
    the lines behind them is not looked at.
    """
    bare = lambda t: F.regexp_replace(t, r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|#.*""", "")
    opened = lambda t: bound(bare(t), lambda b: F.length(F.regexp_replace(b, r"[^(\[{]", "")) - F.length(F.regexp_replace(b, r"[^)\]}]", "")))
    statements = "array<struct<first:int,last:int,text:string,depth:int,goes_on:boolean>>"

    def add(done: Column, line: Column) -> Column:
        before = F.when(F.size(done) > 0, F.element_at(done, -1))
        return bound(F.struct(before.alias("before"), F.coalesce(before["goes_on"], F.lit(False)).alias("joins")), lambda x: extended(done, line, x["before"], x["joins"]))

    def extended(done: Column, line: Column, before: Column, joins: Column) -> Column:
        i = line["i"]
        first = F.when(joins, before["first"]).otherwise(i)

        def statement(x: Column) -> Column:
            whole = F.when(joins, F.concat(F.regexp_replace(before["text"], r"\\$", " "), F.lit(" "), x["text"])).otherwise(x["text"])
            depth = F.when(joins, before["depth"]).otherwise(0) + x["opened"]
            # a line that goes on without end would swallow the text, so brackets are followed over fifty lines only
            goes_on = ((depth > 0) | x["text"].endswith("\\")) & (i - first < 50)
            return F.struct(first.cast("int").alias("first"), i.cast("int").alias("last"), whole.alias("text"), depth.cast("int").alias("depth"), goes_on.alias("goes_on"))

        text = F.regexp_replace(line["text"], r"^[+\- ]", "")
        new = bound(bound(text, lambda t: F.struct(t.alias("text"), opened(t).alias("opened"))), statement)
        more = F.concat(F.when(joins, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done), F.array(new).cast(statements))
        return more if until is None else F.when(joins | (i <= until), more).otherwise(done)

    numbered = F.transform(F.split(code, "\n"), lambda x, i: F.struct((i + 1).alias("i"), x.alias("text")))
    return F.aggregate(numbered, F.array().cast(statements), add)


def _value(expression: Column, known: Column) -> Column:
    """What a sum of literals and known names gives; null if it holds anything else."""
    tokens = F.filter(F.regexp_extract_all(expression, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.startswith("#") & ~t.isin("+", "(", ")", ";", ",", "\\"))

    def term(t: Column) -> Column:
        literal = F.substr(t, F.lit(2), F.length(t) - 2)
        named = F.get(F.reverse(F.transform(F.filter(known, lambda k: k["name"] == t), lambda k: k["value"])), F.lit(0))
        return F.when(t.rlike(_LITERAL), literal).otherwise(named)

    values = F.transform(tokens, term)
    return F.when((F.size(tokens) > 0) & ~F.exists(values, lambda v: v.isNull()), F.array_join(values, ""))


def folded(code: Column, line: Column) -> Column:
    """The string that the statement of line ``line`` (from 1) assigns or is; null if it is no sum of strings."""
    split = lambda t: F.struct(F.trim(F.regexp_extract(t, r"^\s*([A-Za-z_][\w.]*)\s*=(?!=)", 1)).alias("name"), F.regexp_replace(t, r"^\s*[A-Za-z_][\w.]*\s*=(?!=)", "").alias("expression"))
    statements = F.transform(logical_lines(code, line), lambda s: F.struct(split(s["text"]).alias("s"), s["first"].alias("first"), s["last"].alias("last")))

    def assign(known: Column, x: Column) -> Column:
        value = _value(x["s"]["expression"], known)
        new = F.array(F.struct(x["s"]["name"].alias("name"), value.alias("value"))).cast(_STATE)
        return F.when(x["s"]["name"] != "", F.concat(known, new)).otherwise(known)

    def state(x: Column) -> Column:
        known = F.aggregate(F.filter(x, lambda s: s["last"] < line), F.array().cast(_STATE), assign)
        return F.struct(known.alias("known"), F.get(F.filter(x, lambda s: s["last"] >= line), F.lit(0)).alias("at"))

    # statements, and then the state beside the statement, are bound, so that they are built once
    return bound(bound(statements, state), lambda b: _value(b["at"]["s"]["expression"], b["known"]))


def secret_of_line(code: Column, line: Column) -> Column:
    """The secret of a line: its folded string, else its quoted parts joined if they are several and give more than ten characters, else the longest part."""
    at = F.get(F.split(code, "\n"), (line - 1).cast("int"))

    def quoted(parts: Column) -> Column:
        joined = F.array_join(parts, "")
        longest = F.aggregate(parts, F.lit(""), lambda s, p: F.when(F.length(p) > F.length(s), p).otherwise(s))
        return F.when((F.size(parts) > 1) & (F.length(joined) > 10), joined).otherwise(F.when(longest != "", longest))

    found = bound(F.regexp_extract_all(at, F.lit(r"""["']([^"']+)["']"""), F.lit(1)), quoted)
    return F.when(line > 0, bound(folded(code, line), lambda v: F.coalesce(F.nullif(v, F.lit("")), found)))
