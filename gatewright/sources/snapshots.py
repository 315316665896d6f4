"""Versions of a table as snapshots, and what changed between two of them.

A version's rows are written to a folder of their own, which no reader knows until the
manifest of the version's number is put in place by one rename. A write that dies half-way
leaves a folder that is never read, and of two writers of one number one fails.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import list_names, read_text, write_once


def history(spark: SparkSession, path: str) -> list[dict]:
    """Manifests of all versions, the oldest first: version, folder, rows, columns, note."""
    numbers = sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in list_names(spark, f"{path}/versions")) if m)
    return [json.loads(read_text(spark, f"{path}/versions/{n}.json")) for n in numbers]


def latest(spark: SparkSession, path: str) -> int:
    """The latest version's number; 0 if there is none."""
    return max((int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in list_names(spark, f"{path}/versions")) if m), default=0)


def commit(df: DataFrame, path: str, note: str = "", after: int | None = None) -> int:
    """Writes ``df`` as the next version and returns its number.

    ``after`` is the version that ``df`` was made from: if another has come since, nothing is
    committed and FileExistsError is raised, as it is for the slower of two writers.
    """
    spark = df.sparkSession
    version = (latest(spark, path) if after is None else after) + 1
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    rows = spark.read.parquet(f"{path}/{folder}").count()  # counted from the files' footers
    manifest = {"version": version, "folder": folder, "rows": rows, "columns": df.columns, "note": note}
    write_once(spark, json.dumps(manifest), f"{path}/versions/{version}.json")
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A committed version, the latest by default."""
    number = latest(spark, path) if version is None else version
    if number < 1 or f"{number}.json" not in list_names(spark, f"{path}/versions"):
        raise FileNotFoundError(f"no version {number} in {path}")
    return spark.read.parquet(f"{path}/{json.loads(read_text(spark, f'{path}/versions/{number}.json'))['folder']}")


def _by_key(df: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    """One row a key: how many rows it has, and sums of two hashes over them that do not depend on their order."""
    one = F.xxhash64(*(F.col(c) for c in columns))
    two = F.xxhash64(F.lit(1), *(F.col(c) for c in reversed(columns)))
    wide = lambda h: F.sum(h.cast("decimal(20,0)"))
    return df.groupBy(F.col(key).alias(key)).agg(F.count("*").alias(f"{prefix}_n"), F.struct(wide(one), wide(two)).alias(f"{prefix}_hash"))


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, n_old, n_new) of the keys that differ: added, removed or changed.

    Rows are compared by the columns that both versions have, by hashes of 128 bits in all; a
    column that only one has is no change. Keys with several rows are compared as bags, and a
    null key is a key. Each side is aggregated first, so a key with many rows is one in the join.
    """
    columns = sorted(set(old.columns) & set(new.columns))
    a, b = _by_key(old, key, columns, "old"), _by_key(new, key, columns, "new")
    joined = a.alias("a").join(b.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    change = F.when(F.col("old_n").isNull(), "added").when(F.col("new_n").isNull(), "removed").when((F.col("old_n") != F.col("new_n")) | (F.col("old_hash") != F.col("new_hash")), "changed")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    found = joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"), number(F.col("old_n")).alias("n_old"), number(F.col("new_n")).alias("n_new"))
    return found.where("change is not null")
