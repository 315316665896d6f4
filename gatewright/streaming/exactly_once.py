"""Results of a stream written exactly once, with failing rows in a table of their own.

Spark runs a micro-batch again, with the same rows, if it was not known to be finished.
Each batch is written to folders of its number, results and errors apart, and becomes
visible by a commit file of that number, which is put in place by one rename. A batch that
was killed before the commit is written anew over what it left; one that was killed after
it is found committed and is not written again. Readers take committed batches only.

A run has a folder of its own. ``auto`` goes on with the latest run, ``fresh`` begins the
next one and leaves the former as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.io import list_names, write_once

TABLES = ("results", "errors")


def with_errors(rows: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], added: T.StructType) -> DataFrame:
    """``rows`` with the columns that ``judge`` gives them, and with error and error_text where it raises.

    ``judge`` gets a table of some rows and returns one of the ``added`` columns, row by row.
    Where it raises, the table is halved until the failing rows stand alone, so one poison
    row costs a logarithmic number of calls and takes no other row with it. Failing rows have
    null in the added columns, others null in error (the exception's class) and error_text.
    """
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f.name, f.dataType) for f in added), T.StructField("error", T.StringType()), T.StructField("error_text", T.StringType())])
    names = [f.name for f in added]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def judged(part: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            found = judge(part)
            if len(found) != len(part):
                raise ValueError(f"{len(found)} rows for {len(part)}")
            return [found[names].reset_index(drop=True).assign(error=None, error_text=None)]
        except Exception as e:
            if len(part) == 1:
                return [pd.DataFrame([[None] * len(names) + [type(e).__name__, str(e)]], columns=[*names, "error", "error_text"], dtype=object)]
            half = len(part) // 2
            return judged(part.iloc[:half].reset_index(drop=True)) + judged(part.iloc[half:].reset_index(drop=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = judged(batch.to_pandas())
            new = [pa.array([v for p in parts for v in p[f.name].tolist()], arrow.field(f.name).type, from_pandas=True) for f in [*added, *schema.fields[-2:]]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return rows.mapInArrow(run, schema)


def runs(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the runs that a folder has, in their order."""
    return sorted(int(m[1]) for m in (re.fullmatch(r"run=(\d+)", n) for n in list_names(spark, folder)) if m)


def run_folder(spark: SparkSession, folder: str, resume: str = "auto") -> str:
    """The folder of the run to write: the latest with ``auto``, a new one with ``fresh`` or if there is none."""
    if resume not in ("auto", "fresh"):
        raise ValueError("resume is auto or fresh")
    found = runs(spark, folder)
    return f"{folder}/run={found[-1] if found and resume == 'auto' else (found[-1] + 1 if found else 0)}"


def committed(spark: SparkSession, run: str) -> list[int]:
    """Numbers of the committed batches of a run."""
    return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in list_names(spark, f"{run}/commits")) if m)


def commit_batch(rows: DataFrame, batch: int, run: str, before_commit: Callable[[int], None] | None = None) -> None:
    """Writes one batch (rows of ``with_errors``) and commits it; nothing happens if it is committed already.

    ``before_commit`` is called between the two, for tests that stop a batch there.
    """
    spark = rows.sparkSession
    if batch in committed(spark, run):
        return
    failed = F.col("error").isNotNull()
    # judged once and kept while both tables are written
    rows = rows.persist()
    try:
        rows.where(~failed).drop("error", "error_text").write.mode("overwrite").parquet(f"{run}/results/batch={batch}")
        rows.where(failed).write.mode("overwrite").parquet(f"{run}/errors/batch={batch}")
        counts = rows.agg(F.count("*").alias("n"), F.count("error").alias("n_errors")).first()
    finally:
        rows.unpersist()
    if before_commit:
        before_commit(batch)
    write_once(spark, json.dumps({"batch": batch, "n": counts["n"], "n_errors": counts["n_errors"]}), f"{run}/commits/{batch}.json")


def start(stream: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], added: T.StructType, folder: str, resume: str = "auto", before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Judges all that is available of ``stream`` and commits it to the run that ``resume`` names.

    The stream's own checkpoint lies in the run, so a rerun goes on behind its last batch.
    """
    run = run_folder(stream.sparkSession, folder, resume)
    judged = with_errors(stream, judge, added)
    writer = judged.writeStream.foreachBatch(lambda rows, batch: commit_batch(rows, batch, run, before_commit))
    return writer.option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()


def read_committed(spark: SparkSession, folder: str, name: str, run: int | None = None) -> DataFrame:
    """The committed rows of a run, the latest by default: ``results`` or ``errors``, with their batch."""
    if name not in TABLES:
        raise ValueError(f"one of {TABLES}")
    at = f"{folder}/run={runs(spark, folder)[-1] if run is None else run}"
    done = committed(spark, at)
    if not done:
        raise FileNotFoundError(f"no batch is committed in {at}")
    return spark.read.option("basePath", f"{at}/{name}").parquet(*(f"{at}/{name}/batch={b}" for b in done))


def commits(spark: SparkSession, folder: str, run: int | None = None) -> DataFrame:
    """(batch, n, n_errors) of the committed batches of a run: how far it has come."""
    at = f"{folder}/run={runs(spark, folder)[-1] if run is None else run}"
    return spark.read.schema("batch long, n long, n_errors long").json(f"{at}/commits/*.json")


# judging verdicts

VERDICT = T.StructType([T.StructField("decision", T.StringType()), T.StructField("start_line", T.LongType())])


def judge_verdicts(part: pd.DataFrame) -> pd.DataFrame:
    """The decision and first line of raw verdicts; raises on the first that is broken."""

    def one(raw: str | None) -> tuple:
        verdict = json.loads(raw)
        if not isinstance(verdict, dict):
            raise TypeError("no object")
        if verdict["final_decision"] not in ("BLOCK", "REVIEW", "PASS") or not isinstance(verdict["used_untrusted_input"], bool):
            raise ValueError(str(verdict["final_decision"]))
        return verdict["final_decision"], verdict["pred_location_start"] and int(verdict["pred_location_start"])

    return pd.DataFrame([one(r) for r in part["raw"]], columns=VERDICT.names, dtype=object)
