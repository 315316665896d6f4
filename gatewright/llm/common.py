"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters to lower case, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset, on one machine, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gatewright-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and joins are planned by its measured size."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def spaced(text: Column) -> Column:
    """``text`` with every white space of ASCII as one literal space; null is empty."""
    out = or_empty(text)
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words_in(text: Column) -> Column:
    """Words of a text that ``spaced`` gave. Splitting at one literal space is many times faster than at a pattern."""
    return F.array_remove(F.split(text, " "), "")


def words_of(text: Column) -> Column:
    """Native word array by ``[^\x20\x09-\x0D]+``; null and blank texts have none."""
    return words_in(spaced(text))


def lower_words(text: str | None) -> list[bytes]:
    """The same words of a Python string as UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
