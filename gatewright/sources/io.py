"""Readers and writers of datasets, results, reports and checkpoints."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsons import strict_json

# Columns that reports show first.
FIRST_COLUMNS = ("mode", "policy", "slice", "slice_name", "slice_value", "failure_mode", "stage", "n", "n_total", "n_evaluable", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "escape_rate", "leak_escape_rate", "false_block_rate", "review_load")

SAMPLE_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("sample_id", T.StringType()), ("gt_has_secret", T.BooleanType()), ("gt_secret_type", T.StringType()), ("gt_secret_value", T.StringType()),
        ("gt_file_path", T.StringType()), ("gt_line_start", T.IntegerType()), ("gt_line_end", T.IntegerType()), ("condition", T.StringType()),
        ("pr_title", T.StringType()), ("pr_body", T.StringType()), ("code_context", T.StringType()), ("context_family", T.StringType()), ("control_type", T.StringType()),
    )]
)


def read_array(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """A file that holds one JSON array of objects; unknown keys are dropped."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_lines(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """JSON lines; malformed ones are left out."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


#: What a file of a tolerant scan turned out to be.
SCAN_STATES = ("array", "not an array", "broken", "empty")


def _parsed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, state): whole files as VARIANT with the type of their top level; none for a missing path."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "path string, text string").select("path", strict_json(F.col("text")).alias("value"), F.lit("empty").alias("state"))
    files = read_files(spark, path).withColumn("value", strict_json(F.col("text")))
    is_array = F.schema_of_variant("value").startswith("ARRAY<")
    state = F.when(F.col("text").rlike(r"^\s*$"), "empty").when(F.col("value").isNull(), "broken").when(is_array, "array").otherwise("not an array")
    return files.select("path", "value", state.alias("state"))


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """The objects of files that hold a JSON array; anything else is an empty table.

    A missing path, an empty or broken file, and one whose top level is an object or a scalar
    give no rows; elements that are no objects are left out, unknown keys dropped, and values
    that do not fit their column null. ``scan_report`` says which was which.
    """
    rows = _parsed_files(spark, path).where("state = 'array'").select(F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT<"))
    return rows.select(*(F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema))


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, state, n_rows, n_left_out) of the files of a tolerant scan."""
    elements = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.size(F.filter(elements, lambda v: F.schema_of_variant(v).startswith("OBJECT<")))
    is_array = F.col("state") == "array"
    return _parsed_files(spark, path).select("path", "state", F.when(is_array, objects).otherwise(0).alias("n_rows"), F.when(is_array, F.size(elements) - objects).otherwise(0).alias("n_left_out"))


def positives(samples: DataFrame) -> DataFrame:
    return samples.where(F.coalesce("gt_has_secret", F.lit(False)))


def remaining(samples: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    """``samples`` that a former run has not finished: the batch form of resuming."""
    return samples.join(done.select(key).distinct(), key, "left_anti")


def report_columns(df: DataFrame) -> list[str]:
    """Flat columns in report order: the fixed first ones, then the others as they come; nested ones are dropped."""
    flat = [f.name for f in df.schema if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))]
    return [c for c in FIRST_COLUMNS if c in flat] + [c for c in flat if c not in FIRST_COLUMNS]


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file of a small report; an empty one writes nothing."""
    if not df.isEmpty():
        df.select(report_columns(df)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_version(df: DataFrame, path: str, version: str) -> None:
    """A version of a dataset beside the others; one that is there already is never overwritten."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def markdown(df: DataFrame, title: str) -> str:
    """A report as a markdown table, all rows; null is n/a, doubles have four digits."""
    columns = report_columns(df)
    show = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = [" | ".join(show(r[c]) for c in columns) for r in df.toLocalIterator()]
    return "\n".join([f"## {title}", "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *(f"| {r} |" for r in rows)]) + "\n"


def report(title: str, tables: dict[str, DataFrame], most_rows: int = 10_000) -> str:
    """A run's report: a section a table, with its contents ahead; a table of more rows is refused, as a report goes through the driver."""
    heads = [f"# {title}", "", *(f"{i}. {name} ({', '.join(report_columns(df)[:3])}, ...)" for i, (name, df) in enumerate(tables.items(), 1)), ""]
    for name, df in tables.items():
        if df.limit(most_rows + 1).count() > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows; write it as a data set")
    return "\n".join(heads) + "\n" + "\n".join(markdown(df, name) for name, df in tables.items())


def document(df: DataFrame) -> str:
    """A report as an indented JSON document, all rows, other scripts kept as they are."""
    return json.dumps([r.asDict(recursive=True) for r in df.toLocalIterator()], indent=2, ensure_ascii=False, default=str)


def ascii_json(value: Column) -> Column:
    """A value as JSON in ASCII: other characters as escapes, those beyond 16 bits as two."""
    escape = lambda code: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def one(c: Column) -> Column:
        code, over = F.ascii(c), F.ascii(c) - 0x10000
        pair = F.concat(escape(F.lit(0xD800) + F.floor(over / 0x400).cast("int")), escape(F.lit(0xDC00) + over % 0x400))
        return F.when(code < 128, c).when(code < 0x10000, escape(code)).otherwise(pair)

    text = F.to_json(value, {"ignoreNullFields": "false"})
    return F.when(text.rlike("^\\p{ASCII}*$"), text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def _at(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, whatever store it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    at, system = _at(spark, path)
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def write_once(spark: SparkSession, text: str, path: str) -> None:
    """A small file that is there whole or not at all: written beside its place and renamed; an error if it exists."""
    at, system = _at(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at.getParent()}/_{uuid.uuid4().hex}")
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if system.exists(at) or not system.rename(beside, at):
        system.delete(beside, False)
        raise FileExistsError(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object as one row, its schema from the file: scenario settings, manifests; a missing file is an empty table."""
    return spark.read.json(path, multiLine=True) if _exists(spark, path) else spark.createDataFrame([], "path string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


PULL_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "repo", "title", "body", "diff", "merged_at")] + [T.StructField("number", T.LongType()), T.StructField("files", T.ArrayType(T.StringType()))])


def read_pulls(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Pull requests as JSON lines, one a URL (the first by number); ``most``: the range limit of a collection run."""
    first = F.min_by(F.struct("*"), F.struct("number", "title"))
    found = read_lines(spark, path, PULL_SCHEMA).where("url is not null").groupBy("url").agg(first.alias("p")).select("p.*")
    return found if most is None else found.orderBy("url").limit(most)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Versions that ``write_version`` has left in a folder, numbers in their order, the latest last."""
    found = [m[1] for m in (re.fullmatch(r"version=(.+)", n) for n in list_names(spark, path)) if m]
    return sorted(found, key=lambda v: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", v) if x])


def read_text(spark: SparkSession, path: str) -> str:
    """The text of one small file, through the file system of ``path``."""
    at, system = _at(spark, path)
    source = system.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
    finally:
        source.close()


def work_folder(spark: SparkSession) -> str:
    """A new folder for tables between two steps: in ``spark.checkpoint.dir``, and only where that is unset, on one machine, a temporary one."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="gatewright-work-")
    return f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}"


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a dataset; an error if there is none."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no version in {path}")
    return spark.read.parquet(f"{path}/version={found[-1]}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report's text as one file, written anew through the file system of ``path``."""
    at, system = _at(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
