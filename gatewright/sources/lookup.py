"""A layout for looking rows up by id: hash buckets as folders, sorted files with Bloom filters.

A key's bucket follows from its hash, so a look-up names the folders that it reads, and
Spark lists no others. Within a bucket the rows are sorted by key, and each file has the
bounds and a Bloom filter of its row groups, so that most of those without the key are left
out, too. Which buckets there are is written once beside the data.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import read_text, write_once

#: Ids that a look-up may name in its plan; more are joined as a table.
MOST_LITERALS = 10_000
_MANIFEST = "_lookup.json"


def bucket_of(key: Column, buckets: int) -> Column:
    """A key's bucket; a null key has bucket 0."""
    return F.when(key.isNull(), 0).otherwise(F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets))).cast("int")


def write_lookup(df: DataFrame, path: str, key: str, buckets: int = 64, rows_per_file: int = 5_000_000) -> None:
    """``df`` laid out by ``key``; ``path`` must not exist.

    ``buckets`` should grow with the table, to some 1 GB each. Rows are dealt to tasks by
    bucket and a finer hash, so that neither many rows of one bucket nor of one key make a
    task larger than others; files end after ``rows_per_file``.
    """
    if "bucket" in df.columns:
        raise ValueError("a column named bucket is taken by the layout")
    laid = df.withColumn("bucket", bucket_of(F.col(key), buckets))
    tasks = max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = laid.repartitionByRange(tasks, "bucket", key).sortWithinPartitions("bucket", key)
    writer = sorted_rows.write.partitionBy("bucket").option("maxRecordsPerFile", rows_per_file)
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.dynamic.enabled", "true").parquet(path)
    write_once(df.sparkSession, json.dumps({"key": key, "buckets": buckets, "columns": df.columns}), f"{path}/{_MANIFEST}")


def find(spark: SparkSession, path: str, ids: list | DataFrame) -> DataFrame:
    """The rows whose key is among ``ids``, a list, or a table of one column of any size.

    Only the buckets of the ids are read. Rows that share a key are all found; ids without
    rows, null ones and repeated ones give nothing more.
    """
    layout = json.loads(read_text(spark, f"{path}/{_MANIFEST}"))
    key, buckets = layout["key"], layout["buckets"]
    rows = spark.read.parquet(path)
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).cast(rows.schema[key].dataType).alias(key)).where(F.col(key).isNotNull()).distinct()
        marked = wanted.withColumn("bucket", bucket_of(F.col(key), buckets))
        # at most as many numbers as there are buckets
        at = [r[0] for r in marked.select("bucket").distinct().collect()]
        return rows.where(F.col("bucket").isin(at)).join(marked, ["bucket", key], "left_semi").select(layout["columns"])
    known = sorted({i for i in ids if i is not None})
    if not known:
        return rows.limit(0).select(layout["columns"])
    named = spark.createDataFrame([(i,) for i in known], rows.select(key).schema)
    if len(known) > MOST_LITERALS:
        return find(spark, path, named)
    at = [r[0] for r in named.select(bucket_of(F.col(key), buckets)).distinct().collect()]
    return rows.where(F.col("bucket").isin(at) & F.col(key).isin(known)).select(layout["columns"])
