"""Unified diffs as rows: hunks, added lines, context around a line, numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, running


def numbered(text: Column) -> Column:
    """Each line behind its zero-padded number, as wide as the last number."""

    def padded(x: Column) -> Column:
        number = lambda i: F.lpad((i + 1).cast("string"), x["width"], F.lit("0"))
        return F.array_join(F.transform(x["lines"], lambda line, i: F.concat(F.lit("L"), number(i), F.lit(": "), line)), "\n")

    # lines and width are bound: within the inner function, the text would be split once a line
    return bound(bound(F.split(text, "\n"), lambda lines: F.struct(lines.alias("lines"), F.length(F.size(lines).cast("string")).alias("width"))), padded)


def _kind(text: Column) -> Column:
    return (
        F.when(text.startswith("+++ "), "file")
        .when(text.rlike("^(?:diff --git|index |---)"), "meta")
        .when(text.startswith("@@"), "hunk")
        .when(text.rlike(r"^\+(?!\+\+)"), "added")
        .when(text.startswith(" "), "context")
        .when(text.startswith("-"), "removed")
        .otherwise("other")
    )


def _segments(diff: Column, kinds: tuple[str, ...]) -> Column:
    """A diff cut before its hunk headers: array of (lines, pos, idx, base, hunk, start).

    pos is the number of a segment's first line, idx that of its first line of ``kinds``
    among all such lines, base the idx at which its hunk begins; a header that names no
    place goes on with the hunk before it. All of it stays within the row.
    """
    cut = F.transform(
        F.split(diff, "\n(?=@@)"),
        lambda seg: F.struct(
            F.transform(F.split(seg, "\n"), lambda x: F.struct(x.alias("text"), _kind(x).alias("kind"))).alias("lines"),
            F.regexp_extract(seg, r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1).try_cast("bigint").alias("header"),
        ),
    )
    total = lambda n: running(n, lambda a, b: a + b)
    latest = lambda v: running(v, lambda a, b: F.coalesce(b, a))

    def counted(segs: Column) -> Column:
        sizes = F.transform(segs, lambda s: F.size(s["lines"]).cast("long"))
        shown = F.transform(segs, lambda s: F.size(F.filter(s["lines"], lambda x: x["kind"].isin(*kinds))).cast("long"))
        sums = F.struct(
            total(sizes).alias("pos"), sizes.alias("n_pos"), total(shown).alias("idx"), shown.alias("n_idx"),
            total(F.transform(segs, lambda s: F.when(s["header"].isNotNull(), 1).otherwise(0).cast("long"))).alias("hunk"), latest(F.transform(segs, lambda s: s["header"])).alias("start"),
        )

        def placed(x: Column) -> Column:
            begins = F.transform(segs, lambda s, i: F.when(s["header"].isNotNull(), F.get(x["idx"], i) - F.get(x["n_idx"], i)))
            at = lambda n, i: F.get(x[n], i)
            return bound(
                latest(begins),
                lambda base: F.transform(
                    segs,
                    lambda s, i: F.struct(
                        s["lines"].alias("lines"), (at("pos", i) - at("n_pos", i)).alias("pos"), (at("idx", i) - at("n_idx", i)).alias("idx"),
                        F.coalesce(F.get(base, i), F.lit(0)).alias("base"), at("hunk", i).alias("hunk"), at("start", i).alias("start"),
                    ),
                ),
            )

        return bound(sums, placed)

    return bound(cut, counted)


SHOWN = ("added", "context")


def lines(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, pos, text, kind, hunk, start): a row a line, pos from 0, hunk 0 before the first header.

    kind is file, meta, hunk, added, context, removed or other; start is the target line
    that the hunk's header names. Lines are numbered within their row, so nothing is shuffled.
    """
    cut = diffs.select(key, F.explode(_segments(F.col(diff), SHOWN)).alias("s"))
    each = cut.select(key, F.col("s.pos").alias("first"), F.col("s.hunk").alias("hunk"), F.col("s.start").alias("start"), F.posexplode("s.lines").alias("at", "x"))
    return each.select(key, (F.col("first") + F.col("at")).cast("int").alias("pos"), F.col("x.text").alias("text"), F.col("x.kind").alias("kind"), "hunk", "start")


def target_lines(diffs: DataFrame, key: str, diff: str, include_context: bool = True) -> DataFrame:
    """(key, idx, line, text): the new file's lines that the diff shows, without their mark.

    idx counts them from 0 in the diff, line is their number in the new file: a hunk
    header sets it, every added or context line moves it on.
    """
    kinds = SHOWN if include_context else ("added",)
    cut = diffs.select(key, F.explode(_segments(F.col(diff), kinds)).alias("s"))
    shown = F.filter("s.lines", lambda x: x["kind"].isin(*kinds))
    each = cut.select(key, F.col("s.idx").alias("first"), F.col("s.base").alias("base"), F.col("s.start").alias("start"), F.posexplode(shown).alias("at", "x"))
    idx = F.col("first") + F.col("at")
    return each.select(key, idx.cast("long").alias("idx"), (F.coalesce("start", F.lit(1)) + idx - F.col("base")).cast("long").alias("line"), F.expr("substr(x.text, 2)").alias("text"))


def hunk_sizes(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, hunk, start, n_added, n_removed, n_context) of every hunk."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return lines(diffs, key, diff).where("hunk > 0").groupBy(key, "hunk").agg(F.max("start").alias("start"), n("added").alias("n_added"), n("removed").alias("n_removed"), n("context").alias("n_context"))


def first_hunk(diff: Column) -> Column:
    """A diff up to its second hunk header."""
    return bound(F.split(diff, "\n(?=@@)"), lambda x: F.when(F.get(x, F.lit(0)).startswith("@@"), F.get(x, F.lit(0))).otherwise(F.array_join(F.slice(x, 1, 2), "\n")))


def file_path(diff: Column) -> Column:
    """The path behind the first ``+++``, without its ``b/``; ``unknown.txt`` if there is none."""
    found = F.regexp_extract(diff, r"(?m)^\+\+\+ (?:b/)?(.+)$", 1)
    return F.when(found != "", found).otherwise("unknown.txt")


def context_window(code: Column, line: Column, around: int = 15) -> Column:
    """Lines around a line, joined; those removed by the diff are left out before counting."""
    kept = F.filter(F.split(code, "\n"), lambda x: ~x.startswith("-"))
    first = F.greatest(line - around, F.lit(1)).cast("int")
    return F.array_join(F.slice(kept, first, (line + around - first + 1).cast("int")), "\n")
