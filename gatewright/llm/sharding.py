"""Weighted rendezvous sharding, by DataFrame functions only.

A record's key is hashed with every shard's number; the shard with the least
``-ln(u) / weight`` wins. A new shard takes records only where its own score is the
least, so no record moves between old shards, and a weight's share of the records is
the weight's share of the total.

Slots are numbered without a task that sees a whole shard: each shard is dealt into
buckets of keys, buckets are counted, their counts summed up in order, and rows are
numbered within their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that the rows of each shard are dealt into, at any size of the table.
BUCKETS = 4096


def _score(key: Column, shard: int, weight: float) -> Column:
    """An exponential draw with rate ``weight`` from the hash of (key, shard)."""
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)  # 53 bits, exact as a double
    return -F.log((draw.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key`` among ``len(weights)`` shards; a tie goes to the lower number.

    A null key is hashed as null, so all null keys share a shard. Shards of weight zero take nothing.
    """
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live or min(weights) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    best = F.least(*(F.struct(_score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in live)) if len(live) > 1 else None
    return best["shard"] if best is not None else F.lit(live[0][0])


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    ``size`` is the text's UTF-8 bytes plus 8, ``text_crc32`` that of the bytes; a null
    text counts as empty. The law is ``key``: doc_id and the weights decide alone, so rows
    that repeat a doc_id share its shard, and so do all rows with a null doc_id.
    ``grown_shard`` is the shard under the weights ``grown``. ``slot`` numbers the rows of
    a shard from 0 without gaps, in an order that the rows' contents decide; equal rows
    take neighbouring slots. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = body.withColumn("shard", rendezvous(F.col("doc_id"), weights).cast("int")).withColumn("grown_shard", rendezvous(F.col("doc_id"), grown).cast("int"))
    # the whole row decides its bucket: rows that repeat one doc_id are spread unless they are equal
    rows = rows.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, size, text_crc32, 7), {BUCKETS})"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(order) - 1)
    placed = numbered.join(starts, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), "grown_shard")
