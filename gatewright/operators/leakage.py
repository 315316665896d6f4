"""Leakage of known secrets by two outputs, hits by span, and the experimental review floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import is_true, ratio_or_zero
from .scanning import leak_ratios


def rates(rows: DataFrame, secret: str, outputs: dict[str, Column], least: int = 8) -> DataFrame:
    """Per output: evaluable rows (a secret and an output), exact leaks, their rate."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("system"), o.alias("output")) for n, o in outputs.items())))
    known = rows.where(is_true(F.col("gt_has_secret")) & (F.coalesce(F.col(secret), F.lit("")) != "")).select(F.col(secret).alias("secret"), each.alias("x"))
    shown = known.where("x.output is not null")
    leak = (F.length("secret") >= least) & F.contains("x.output", F.col("secret"))
    counted = shown.groupBy("x.system").agg(F.count("*").alias("n"), F.count_if(leak).alias("n_leaked"))
    return counted.select("*", ratio_or_zero(F.col("n_leaked"), F.col("n")).alias("leak_rate"))


def comparison(rows: DataFrame, secret: str, before: Column, after: Column) -> DataFrame:
    """One row: both rates, and the reduction in percent; no reduction where nothing leaked before."""
    found = rates(rows, secret, {"before": before, "after": after})
    pick = lambda s: F.coalesce(F.max(F.when(F.col("system") == s, F.col("leak_rate"))), F.lit(0.0))
    both = found.agg(pick("before").alias("before_rate"), pick("after").alias("after_rate"))
    cut = F.when(F.col("before_rate") > 0, F.round((F.col("before_rate") - F.col("after_rate")) / F.col("before_rate") * 100, 2)).otherwise(0.0)
    return both.select("*", cut.alias("reduction_pct"), (F.col("after_rate") < F.col("before_rate")).alias("effective"))


def exposure(rows: DataFrame, secret: str, outputs: dict[str, Column]) -> DataFrame:
    """Per output: evaluable rows, leaks in all and by kind, their rate, and the mean share shown of the secrets that leak."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("system"), o.alias("output")) for n, o in outputs.items())))
    known = rows.where(is_true(F.col("gt_has_secret")) & (F.coalesce(F.col(secret), F.lit("")) != "")).select(F.col(secret).alias("secret"), each.alias("x"))
    found = leak_ratios(known.where("x.output is not null").select("secret", "x.system", "x.output"), "secret", "output")
    leaked = F.col("leak") != "none"
    counted = found.groupBy("system").agg(F.count("*").alias("n"), F.count_if(leaked).alias("n_leaked"), F.count_if(F.col("leak") == "exact").alias("n_exact"), F.count_if(F.col("leak") == "partial").alias("n_partial"), F.sum(F.when(leaked, F.col("ratio"))).alias("shown"))
    return counted.select("system", "n", "n_leaked", "n_exact", "n_partial", ratio_or_zero(F.col("n_leaked"), F.col("n")).alias("leak_rate"), ratio_or_zero(F.coalesce("shown", F.lit(0.0)), F.col("n_leaked")).alias("mean_exposure"))


def leaked_rows(rows: DataFrame, key: str, secret: str, output: Column) -> DataFrame:
    """(key, leak, ratio) of the rows whose output leaks."""
    known = rows.where(is_true(F.col("gt_has_secret")) & (F.coalesce(F.col(secret), F.lit("")) != "")).select(key, F.col(secret).alias("secret"), output.alias("output"))
    return leak_ratios(known, "secret", "output").where("leak <> 'none'").select(key, "leak", "ratio")


def span_hit(line: Column, start: Column, end: Column) -> Column:
    """Whether the true line is inside the predicted span; a missing one is a miss."""
    return F.coalesce(line.between(start, end), F.lit(False))


def confidence(value: Column) -> Column:
    """HIGH, MEDIUM or LOW; null for anything else."""
    up = F.upper(value)
    return F.when(up.isin("HIGH", "MEDIUM", "LOW"), up)


def review_floor(rows: DataFrame, verdicts: str) -> DataFrame:
    """``rows`` with a floor under the decision: a doubtful verdict on any candidate makes a PASS a REVIEW and counts as detection."""
    doubtful = F.coalesce(F.exists(verdicts, lambda v: F.lower(F.trim(v)).isin("uncertain", "likely_secret")), F.lit(False))
    out = rows.withColumn("floor_applied", doubtful)
    found = F.coalesce("pred_has_secret", F.lit(False)) | F.col("floor_applied")
    kind = F.when(F.col("gt_has_secret") & found, "TRUE POSITIVE").when(F.col("gt_has_secret"), "FALSE NEGATIVE").when(found, "FALSE POSITIVE").otherwise("TRUE NEGATIVE")
    decision = F.when(F.col("floor_applied") & (F.col("final_decision") == "PASS"), "REVIEW").otherwise(F.col("final_decision"))
    return out.withColumns({"final_decision": decision, "classification": kind})
