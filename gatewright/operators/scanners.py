"""Scanner findings: from diffs by pattern rules, combined into a verdict a sample, and put into older results.

An external scanner's findings come as a table of the same columns and take the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import is_true
from .diffs import target_lines
from .policies import RISKY_PATHS_LEGACY, critical, obfuscated, path_holds, plain_policies
from .scanning import PATTERNS, matches, secret_type

#: Columns of a finding.
FINDING = ("key", "rule", "secret_type", "line", "match")


def pattern_findings(samples: DataFrame, key: str, diff: str, rules: tuple[str, ...] | None = None) -> DataFrame:
    """(key, rule, secret_type, line, match) of the patterns in the added and context lines of a diff, at their target lines."""
    lines = target_lines(samples, key, diff)
    text, low = F.col("text"), F.lower("text")
    named = lambda rule, found: F.transform(found, lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("match")))
    found = F.concat(*(named(n, matches(text, low, n, p)) for n, p, _ in PATTERNS if rules is None or n in rules))
    each = lines.select(F.col(key).alias("key"), "line", F.explode(found).alias("f"))
    return each.select("key", F.col("f.rule").alias("rule"), secret_type(F.col("f.rule")).alias("secret_type"), "line", F.col("f.match").alias("match"))


def combined(samples: DataFrame, findings: DataFrame, key: str, line: str) -> DataFrame:
    """One row a sample: scanner_hit, n_findings, scanner_secret_type (of the first finding by line, then rule) and line_hit."""
    first = F.min(F.struct("line", "rule", "secret_type"))
    by_key = findings.groupBy("key").agg(F.count("*").alias("n_findings"), first["secret_type"].alias("scanner_secret_type"), F.collect_set("line").alias("_lines"))
    joined = samples.join(by_key, samples[key] == by_key["key"], "left")
    hit = F.coalesce(F.array_contains("_lines", samples[line].cast("bigint")), F.lit(False))
    return joined.select(samples["*"], F.col("key").isNotNull().alias("scanner_hit"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"), "scanner_secret_type", hit.alias("line_hit"))


def evaluated(samples: DataFrame, scans: dict[str, DataFrame], key: str, errors: dict[str, DataFrame] | None = None) -> DataFrame:
    """``samples`` with what several scanners say: of each its hit, the type and line of its first finding and its error, and scanner_hit, the OR of the hits.

    ``scans`` has a table of findings a scanner, ``errors`` (key, error) of the samples on
    which one failed: such a sample is no hit of it, and the others decide. The columns are
    called by the scanner's name. Findings are reduced to one row a sample before the join.
    """
    out = samples
    for name, findings in scans.items():
        first = findings.groupBy("key").agg(F.min(F.struct("line", "rule", "secret_type")).alias("f")).select(F.col("key").alias("_key"), F.col("f.secret_type").alias("_type"), F.col("f.line").alias("_line"), F.lit(True).alias("_hit"))
        out = out.join(first, out[key] == F.col("_key"), "left").drop("_key")
        failed = (errors or {}).get(name)
        if failed is None:
            out = out.withColumn("_error", F.lit(None).cast("string"))
        else:
            said = failed.groupBy("key").agg(F.min("error").alias("_error")).withColumnRenamed("key", "_key")
            out = out.join(said, out[key] == F.col("_key"), "left").drop("_key")
        works = F.col("_error").isNull()
        new = {f"{name}_hit": F.coalesce(F.col("_hit") & works, F.lit(False)), f"{name}_secret_type": F.when(works, F.col("_type")), f"{name}_location_line": F.when(works, F.col("_line")), f"{name}_error": F.col("_error")}
        out = out.withColumns(new).drop("_hit", "_type", "_line", "_error")
    hit = F.lit(False)
    for name in scans:
        hit = hit | F.col(f"{name}_hit")
    return out.withColumn("scanner_hit", hit)


def with_policies(results: DataFrame, scans: DataFrame, key: str, names: tuple[str, ...], path: str = "file_path", diff: str = "text") -> DataFrame:
    """``results`` with the columns of a new scan (``evaluated``) and the three policies recomputed from it, for the plain and the guarded reviewer.

    A refresh knows a reviewer's hit only, so its decision is BLOCK or PASS, and a policy is
    null where the reviewer is missing. The type is that of the first scanner that has one,
    else the reviewer's. Samples without a new scan keep their hit and get the policies of it;
    ``hit_changed`` marks the others whose hit is another one.
    """
    columns = [c for n in names for c in (f"{n}_hit", f"{n}_secret_type", f"{n}_location_line", f"{n}_error")]
    new = scans.select(F.col(key).alias("_key"), F.col("scanner_hit").alias("_hit"), *columns)
    out = results.join(new, results[key] == F.col("_key"), "left")
    hit = F.coalesce(F.col("_hit"), is_true(F.col("scanner_hit")))
    out = out.withColumn("hit_changed", F.col("_key").isNotNull() & (hit != is_true(F.col("scanner_hit")))).withColumn("scanner_hit", hit).drop("_key", "_hit")
    found = F.coalesce(*(F.col(f"{n}_secret_type") for n in names))
    for reviewer in ("baseline", "guardrail"):
        said = F.col({"baseline": "baseline_pred", "guardrail": "pred_has_secret"}[reviewer])
        p = plain_policies(F.col("scanner_hit"), is_true(said), F.coalesce(found, F.col("pred_secret_type")), F.col(path))
        out = out.withColumns({f"policy_{n}_{reviewer}": F.when(said.isNotNull(), c) for n, c in p.items()})
    return out.withColumns({"is_high_risk_file": path_holds(F.col(path), RISKY_PATHS_LEGACY), "is_critical_secret_type": critical(found), "obfuscation_suspected": obfuscated(F.col(diff))})


def refreshed(results: DataFrame, scans: DataFrame, key: str, columns: tuple[str, ...] = ("scanner_hit",)) -> DataFrame:
    """``results`` with the scanner's columns from ``scans`` where it has the sample, and ``scanner_changed``; all else stays."""
    new = scans.select(F.col(key).alias("_key"), F.lit(True).alias("_known"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = results.join(new, results[key] == F.col("_key"), "left")
    now = lambda c: F.when(F.col("_known"), F.col(f"_{c}")).otherwise(results[c])
    changed: Column = F.lit(False)
    for c in columns:
        changed = changed | ~now(c).eqNullSafe(results[c])
    return joined.select(*(now(c).alias(c) if c in columns else results[c] for c in results.columns), changed.alias("scanner_changed"))
