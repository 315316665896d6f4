"""Queries over arrivals, failing rows, layouts, snapshots, summaries, folded code and quotas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import settled
from ..operators import datasets as ds
from ..operators import folding, quotas, significance, summary
from ..sources import lookup, snapshots
from ..sources.adapters import responses, results, samples, with_responses, with_results, with_samples
from ..sources.io import work_folder
from ..streaming import arrivals, exactly_once
from .text_queries import _HALVES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


# results that arrive apart

_SIDE = "LEFT JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = '{kind}') AS {n} ON {n}.user_id = v.user_id AND {n}.ts >= v.ts AND {n}.ts <= v.ts + INTERVAL 12 HOURS"
_SIDES = " ".join(_SIDE.format(n=n, kind=kind) for n, kind in arrivals.EVENT_SIDES.items())
_HERE = " + ".join(f"CASE WHEN {n}.ts IS NULL THEN 0 ELSE 1 END" for n in arrivals.EVENT_SIDES)
_LAST = f"greatest({', '.join(f'{n}.ts' for n in arrivals.EVENT_SIDES)})"
_add(
    "late_arrivals",
    lambda spark, sf: arrivals.event_arrivals(_table(spark, sf, "events")).select("event_id", "scanner_value", "reviewer_value", "guarded_value", "n_arrived", "waited_seconds", "status"),
    f"""SELECT v.event_id, scanner.event_id AS scanner_value, reviewer.event_id AS reviewer_value, guarded.event_id AS guarded_value, CAST({_HERE} AS INTEGER) AS n_arrived,
  CAST(floor((epoch_us({_LAST}) - epoch_us(v.ts)) / 1000000) AS BIGINT) AS waited_seconds, CASE {_HERE} WHEN 3 THEN 'complete' WHEN 0 THEN 'missing' ELSE 'partial' END AS status
FROM (SELECT * FROM events WHERE event_type = 'view') AS v {_SIDES}""",
)

# rows that fail

_add(
    "verdict_failures",
    lambda spark, sf: exactly_once.with_errors(responses(spark, sf).select("doc_id", "raw"), exactly_once.judge_verdicts, exactly_once.VERDICT).select("doc_id", "decision", "start_line", "error"),
    with_responses(
        """, read AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM responses),
fields AS (SELECT doc_id, j, json_type(j) = 'OBJECT' AS is_object, j->>'final_decision' AS decision, json_type(j, '$.used_untrusted_input') AS used, try_cast(j->>'pred_location_start' AS BIGINT) AS start FROM read),
judged AS (SELECT *, CASE WHEN j IS NULL THEN 'JSONDecodeError' WHEN NOT is_object THEN 'TypeError' WHEN decision NOT IN ('BLOCK', 'REVIEW', 'PASS') THEN 'ValueError' WHEN used IS NULL THEN 'KeyError' WHEN used <> 'BOOLEAN' THEN 'ValueError' END AS error FROM fields)
SELECT doc_id, CASE WHEN error IS NULL THEN decision END AS decision, CASE WHEN error IS NULL THEN start END AS start_line, error FROM judged"""
    ),
)

# look-up by id


def _document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic labels' documents, by a layout of all documents."""
    docs, path = _table(spark, sf_dir, "documents"), work_folder(spark)
    lookup.write_lookup(docs, path, "doc_id", buckets=16)
    found = lookup.find(spark, path, _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    return found.select("doc_id", "lang", "source", F.length("text").cast("long").alias("length"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


_add("document_lookup", _document_lookup, "SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS length, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")


# versions


def _edited(docs: DataFrame) -> DataFrame:
    """A next version of the documents: some gone, some with another text, some new, some twice."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).when(F.col("doc_id") % 11 == 5, F.lit(None)).otherwise(F.col("text"))
    kept = docs.where("doc_id % 10 <> 3").withColumn("text", text)
    new = docs.where("doc_id % 13 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return kept.unionByName(new).unionByName(docs.where("doc_id % 17 = 0"))


def _snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), work_folder(spark)
    snapshots.commit(docs, path, "as delivered")
    snapshots.commit(_edited(snapshots.read(spark, path)), path, "edited", after=1)
    return snapshots.difference(snapshots.read(spark, path, 1), snapshots.read(spark, path), "doc_id")


_add(
    "snapshot_changes",
    _snapshot_changes,
    """WITH next AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(coalesce(text, ''), '!') WHEN doc_id % 11 = 5 THEN NULL ELSE text END AS text, lang, source, n_chars FROM documents WHERE doc_id % 10 <> 3
  UNION ALL SELECT doc_id + 1000000000, text, lang, source, n_chars FROM documents WHERE doc_id % 13 = 0
  UNION ALL SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id % 17 = 0),
bags AS (SELECT doc_id, 'old' AS side, list_sort(list(to_json({t: text, l: lang, s: source, n: n_chars})::VARCHAR)) AS bag FROM documents GROUP BY doc_id
  UNION ALL SELECT doc_id, 'new', list_sort(list(to_json({t: text, l: lang, s: source, n: n_chars})::VARCHAR)) FROM next GROUP BY doc_id),
pairs AS (SELECT doc_id, max(bag) FILTER (WHERE side = 'old') AS a, max(bag) FILTER (WHERE side = 'new') AS b FROM bags GROUP BY doc_id)
SELECT doc_id, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change, CAST(coalesce(len(a), 0) AS BIGINT) AS n_old, CAST(coalesce(len(b), 0) AS BIGINT) AS n_new
FROM pairs WHERE a IS DISTINCT FROM b""",
)

# detectors and the run

_RIGHT = ["coalesce(scanner_hit, FALSE)", "coalesce(baseline_pred, FALSE)", "coalesce(guardrail_decision = 'BLOCK', FALSE)", "coalesce(guardrail_decision IN ('BLOCK', 'REVIEW'), FALSE)"]
_add(
    "cochran_q",
    lambda spark, sf: significance.cochran(results(spark, sf)),
    with_results(
        ", r AS (SELECT "
        + ", ".join(f"CAST(({c}) = coalesce(gt_has_secret, FALSE) AS INTEGER) AS r{i}" for i, c in enumerate(_RIGHT))
        + """ FROM results),
s AS (SELECT *, r0 + r1 + r2 + r3 AS l FROM r),
q AS (SELECT count(*) AS n, count(*) FILTER (WHERE l IN (0, 4)) AS n_agreed, 3 * (4 * (sum(r0) ** 2 + sum(r1) ** 2 + sum(r2) ** 2 + sum(r3) ** 2) - sum(l) ** 2) / (4 * sum(l) - sum(l * l)) AS q FROM s),
p AS (SELECT *, greatest(0.0, 1.0 - list_sum(list_transform(range(0, 6000), lambda i: exp((1.5 + i) * ln(q / 2) - q / 2 - lgamma(2.5 + i))))) AS p FROM q)
SELECT n, CAST(4 AS INTEGER) AS n_detectors, n_agreed, round(q, 4) AS statistic, CAST(3 AS INTEGER) AS df, round(p, 6) AS p_value, p < 0.05 AS significant,
  CASE WHEN p < 0.001 THEN 'very strong' WHEN p < 0.01 THEN 'strong' WHEN p < 0.05 THEN 'moderate' ELSE 'none' END AS evidence FROM p"""
    ),
)
_SUMMARY_SETS = ", ".join("(" + ", ".join(s) + ")" for s in summary.SETS)


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


_SUMMARY = {
    "n": "count(*)",
    **{f"n_{d.lower()}": _n(f"guardrail_decision = '{d}'") for d in summary.DECISIONS},
    "n_undecided": _n("guardrail_decision IS NULL"),
    **{f"n_baseline_{d.lower()}": _n(f"baseline_decision = '{d}'") for d in summary.DECISIONS},
    "n_scanner": _n("scanner_hit"),
    "n_missed": _n("gt_has_secret AND guardrail_decision = 'PASS'"),
    "n_false_blocks": _n("NOT gt_has_secret AND guardrail_decision = 'BLOCK'"),
    "n_leaks_before": _n("leak_in_baseline"),
    "n_leaks_after": _n("leak_in_guardrail"),
    "n_chars": "CAST(sum(n_chars) AS BIGINT)",
}
_SHARES = {"share_block": "n_block", "share_review": "n_review", "share_pass": "n_pass", "share_scanner": "n_scanner", "share_leaks": "n_leaks_after"}
_add(
    "run_summary",
    lambda spark, sf: summary.run_summary(results(spark, sf)),
    with_results(
        f"""SELECT *, {", ".join(f"round({c} / CAST(n AS DOUBLE), 4) AS {n}" for n, c in _SHARES.items())} FROM (
  SELECT CAST(grouping_id(condition, context_family, truth) AS INTEGER) AS "grouping", condition, context_family, truth, {", ".join(f"{c} AS {n}" for n, c in _SUMMARY.items())}
  FROM (SELECT *, CASE WHEN gt_has_secret THEN 'secret' ELSE 'clean' END AS truth FROM results) AS t GROUP BY GROUPING SETS ({_SUMMARY_SETS})) AS g"""
    ),
)

# folded code


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of samples whose literal was split, on one line and over several, folded back."""
    s = samples(spark, sf_dir)
    rows = settled(ds.split_inline(s).unionByName(ds.split_lines(s)), "code_context")
    return rows.select("doc_id", "sample_id", folding.secret_of_line(F.col("code_context"), F.col("gt_line_start").cast("int")).alias("secret"))


_add(
    "folded_secrets",
    _folded,
    with_samples(_HALVES + "SELECT doc_id, concat(sample_id, '_E3-A') AS sample_id, v AS secret FROM h WHERE gt_secret_type NOT IN ('private_key', 'certificate') UNION ALL SELECT doc_id, concat(sample_id, '_E3-B'), v FROM h"),
)

# quotas

_add(
    "quota_sample",
    lambda spark, sf: quotas.by_quota(_table(spark, sf, "documents"), ["lang", "source"], "doc_id", (1, 5)).select("doc_id", "lang", "source"),
    """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL),
t AS (SELECT *, sum(n) OVER () AS every, CAST(floor(sum(n) OVER () / 5) AS BIGINT) AS total FROM c),
s AS (SELECT *, CAST(floor(total * n / every) AS BIGINT) AS f, CAST(total * n AS BIGINT) % CAST(every AS BIGINT) AS rest FROM t),
q AS (SELECT lang, source, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, lang, source) <= total - sum(f) OVER () THEN 1 ELSE 0 END AS quota FROM s),
r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS place FROM documents)
SELECT doc_id, r.lang, r.source FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang AND r.source IS NOT DISTINCT FROM q.source WHERE place <= quota""",
)
