"""Building a set by quotas: so many rows of each stratum, chosen by hash.

Quotas are shares of a total in proportion to the strata, rounded by largest remainders. A
stratum's rows are taken in the order of a hash of their key. No task sees a stratum: the
rows are counted by ranges of the hash, which tells the range at which the quota is
reached; rows of lower ranges are taken where they are, and only those of the one range are
put in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strata up to which their cuts are sent to all tasks; beyond it they are joined by range of the hash, too.
SENT_STRATA = 100_000


def order_of(key: Column) -> Column:
    """The hash that rows are taken by: 32 hexadecimal digits."""
    return F.md5(key.cast("string").cast("binary"))


def largest_remainders(counts: DataFrame, total: Column) -> DataFrame:
    """``counts`` (strata, n) with ``quota``: shares of ``total`` in proportion to n, those with the largest remainders rounded up.

    Ties go to the larger stratum, then to the one whose names come first. One row a stratum
    passes through one task.
    """
    strata = [c for c in counts.columns if c != "n"]
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, wide = F.col("n").cast("decimal(19,0)"), "decimal(38,0)"
    sized = counts.withColumns({"_all": F.sum(n).over(every).cast(wide)}).withColumn("_total", F.least(total.cast(wide), F.col("_all")))
    shared = sized.withColumn("_share", (F.col("_total") * n).cast(wide)).withColumns({"_floor": F.expr("cast(_share div _all as bigint)"), "_rest": F.expr("_share % _all")})
    left = F.col("_total").cast("long") - F.sum("_floor").over(every)
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc("n"), *strata))
    return shared.withColumns({"_left": left, "_place": place}).select(*strata, "n", (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("long")).alias("quota"))


def by_quota(rows: DataFrame, strata: list[str], key: str, share: tuple[int, int], digits: int = 3) -> DataFrame:
    """``rows`` of which ``share`` (a fraction) are kept, each of ``strata`` by its quota, the first by hash of ``key``.

    ``digits`` of the hash make the ranges, 16 ** digits of them. Null strata are strata; rows
    of one key have one hash and are ordered by it only, so of rows that tie at the cut any
    are taken, but as many as the quota says.
    """
    hashed = rows.withColumns({"_order": order_of(F.coalesce(F.col(key).cast("string"), F.lit("")))}).withColumn("_range", F.left("_order", F.lit(digits)))
    ranges = hashed.groupBy(*strata, "_range").agg(F.count("*").alias("_n"))
    counts = ranges.groupBy(*strata).agg(F.sum("_n").alias("n"))
    total = rows.select(F.expr(f"count(*) * {int(share[0])} div {int(share[1])}")).first()[0]
    quotas = largest_remainders(counts, F.lit(total)).withColumnsRenamed({s: f"_{i}" for i, s in enumerate(strata)})
    same = reduce(lambda a, b: a & b, (F.col(s).eqNullSafe(F.col(f"_{i}")) for i, s in enumerate(strata)))
    upto = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_range"))
    reached = ranges.join(quotas, same).withColumn("_upto", upto).where("_upto - _n < quota")
    # the last range that is needed, and how many rows of it
    cuts = reached.groupBy(*(F.col(f"_{i}") for i in range(len(strata)))).agg(F.max("_range").alias("_cut"), F.max_by(F.col("quota") - F.col("_upto") + F.col("_n"), "_range").alias("_take"))
    if counts.count() <= SENT_STRATA:
        marked = hashed.join(F.broadcast(cuts), same)
    else:
        # the ranges up to the cut are joined with the rows, so a stratum's rows are dealt by range
        known = ranges.join(cuts, same).where("_range <= _cut").select(*(F.col(f"_{i}") for i in range(len(strata))), F.col("_range").alias("_r"), "_cut", "_take")
        marked = hashed.join(known, same & (F.col("_range") == F.col("_r"))).drop("_r")
    below = marked.where(F.col("_range") < F.col("_cut"))
    place = F.row_number().over(Window.partitionBy(*strata, "_range").orderBy("_order"))
    at = marked.where(F.col("_range") == F.col("_cut")).withColumn("_place", place).where("_place <= _take")
    return below.select(rows.columns).unionByName(at.select(rows.columns))
