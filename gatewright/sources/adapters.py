"""Deterministic views that give the driver's tables the shape of review results.

The texts are in the SQL that Spark and DuckDB share, over ``{documents}``; only
arithmetic on keys is used, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESULTS_SQL = """
SELECT *,
  CASE WHEN guardrail_decision IS NULL THEN NULL ELSE guardrail_decision = 'BLOCK' OR (guardrail_decision = 'REVIEW' AND doc_id % 3 = 0) END AS pred_has_secret,
  CASE WHEN baseline_decision IS NULL THEN NULL ELSE baseline_decision = 'BLOCK' END AS baseline_pred,
  CASE WHEN guardrail_decision = 'BLOCK' AND doc_id % 6 < 5 THEN CASE doc_id % 5 WHEN 0 THEN 'token' WHEN 1 THEN 'api_key' WHEN 2 THEN 'private_key' WHEN 3 THEN 'Connection_String' ELSE 'password' END END AS pred_secret_type
FROM (
  SELECT doc_id, text, n_chars, gt AS gt_has_secret,
    concat(CASE doc_id % 5 WHEN 0 THEN 'REAL_' WHEN 1 THEN 'SYNTH_' WHEN 2 THEN 'NEG_DECOY_' WHEN 3 THEN 'NEG_CLEAN_' ELSE 'HARD_' END, doc_id) AS sample_id,
    CASE WHEN doc_id % 5 IN (2, 3) THEN 'B0' WHEN doc_id % 5 = 4 THEN 'E4-I' WHEN doc_id % 7 = 0 THEN 'E1-B' WHEN doc_id % 7 = 1 THEN 'E2-A'
         WHEN doc_id % 7 = 2 THEN 'E3-A' WHEN doc_id % 7 = 3 THEN 'E3-B' ELSE 'B0' END AS condition,
    CASE doc_id % 5 WHEN 2 THEN 'decoy' WHEN 3 THEN 'no_secret' END AS control_type,
    lang AS context_family,
    CASE WHEN gt AND doc_id % 6 < 5 THEN CASE doc_id % 6 WHEN 0 THEN 'token' WHEN 1 THEN 'api_key' WHEN 2 THEN 'password' WHEN 3 THEN 'private_key' ELSE 'connection_string' END END AS gt_secret_type,
    CASE doc_id % 9 WHEN 0 THEN 'FM1' WHEN 1 THEN 'FM2' WHEN 2 THEN 'FM4' END AS failure_mode_target,
    doc_id % 11 = 0 AS is_extreme_case,
    CASE doc_id % 8 WHEN 0 THEN 'src/config/settings.py' WHEN 1 THEN 'tests/test_login.py' WHEN 2 THEN 'app/Auth/login.py' WHEN 3 THEN 'docs/README.md'
         WHEN 4 THEN 'deploy/.env' WHEN 5 THEN 'lib/util.py' WHEN 6 THEN 'src/monkey.py' END AS file_path,
    CASE WHEN doc_id % 97 = 0 THEN NULL ELSE h1 < CASE WHEN gt THEN 7 ELSE 2 END END AS scanner_hit,
    CASE WHEN doc_id % 89 = 0 THEN NULL WHEN h2 = 9 THEN 'REVIEW' WHEN h2 < CASE WHEN gt THEN 8 ELSE 2 END THEN 'BLOCK' ELSE 'PASS' END AS baseline_decision,
    CASE WHEN doc_id % 83 = 0 THEN NULL WHEN h3 IN (7, 8) THEN 'REVIEW' WHEN h3 < CASE WHEN gt THEN 7 ELSE 1 END THEN 'BLOCK' ELSE 'PASS' END AS guardrail_decision,
    CASE WHEN doc_id % 83 = 0 THEN NULL ELSE doc_id % 23 <> 0 END AS g1_valid,
    doc_id % 19 = 0 AS g1_issue,
    CASE WHEN doc_id % 83 = 0 THEN NULL ELSE doc_id % 29 <> 0 END AS g2_valid,
    doc_id % 37 = 0 AS g2_issue,
    CASE WHEN doc_id % 83 = 0 THEN NULL ELSE doc_id % 4 = 1 END AS g4_should_review,
    CASE WHEN doc_id % 4 = 1 THEN CASE doc_id % 7 WHEN 0 THEN 'R1' WHEN 1 THEN 'R2' WHEN 2 THEN 'R3' WHEN 3 THEN 'R4' WHEN 4 THEN 'R5' WHEN 5 THEN 'R6' ELSE 'R7' END END AS g4_rule,
    CASE WHEN doc_id % 83 = 0 THEN NULL ELSE doc_id % 41 <> 0 END AS g5_valid,
    CASE WHEN doc_id % 41 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'PARSE_ERROR' WHEN 1 THEN 'SCHEMA_VIOLATION' ELSE 'CONSISTENCY_VIOLATION' END END AS g5_category,
    doc_id % 3 = 0 AS g3_triggered,
    doc_id % 47 = 0 AS g3_leak_persisted,
    doc_id % 13 = 0 AS g6_hint_injected,
    doc_id % 17 <> 0 AS bfm_executed,
    doc_id % 12 <> 0 AS bfm_g1_valid,
    doc_id % 31 <> 0 AS bfm_g2_valid,
    doc_id % 3 = 1 AS bfm_g4_should_review,
    CASE WHEN doc_id % 17 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS leak_in_baseline,
    doc_id % 53 = 0 AS leak_in_guardrail,
    CASE WHEN doc_id % 21 = 0 THEN NULL ELSE 1 + doc_id % 40 END AS gt_line,
    CASE WHEN doc_id % 15 = 0 THEN NULL ELSE 1 + doc_id % 38 END AS pred_start,
    CASE WHEN doc_id % 15 = 0 THEN NULL ELSE 3 + doc_id % 38 END AS pred_end
  FROM (
    SELECT doc_id, text, lang, n_chars, doc_id % 5 IN (0, 1, 4) AS gt,
      (doc_id * 31 + n_chars) % 10 AS h1, (doc_id * 17 + n_chars) % 10 AS h2, (doc_id * 13 + n_chars * 3) % 10 AS h3
    FROM {documents}) AS keyed) AS shaped
"""



def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review results, one a document."""
    return spark.sql(RESULTS_SQL, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def with_results(sql: str) -> str:
    """``sql`` over ``results`` for the other engine."""
    return f"WITH results AS ({RESULTS_SQL.replace('{documents}', 'documents')}) {sql}"

#: A document's lines as a hunk: added, removed and context lines by place; each engine spells it its own way.
OWN_LINES = {
    "spark": "concat('@@ -90,', size(split(text, chr(10))), ' +90,', size(split(text, chr(10))), ' @@', chr(10), array_join(transform(split(text, chr(10)), (x, i) -> concat(CASE (doc_id + i * 7) % 5 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '+' END, x)), chr(10)))",
    "duckdb": "concat('@@ -90,', len(string_split(text, chr(10))), ' +90,', len(string_split(text, chr(10))), ' @@', chr(10), array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat(CASE (doc_id + (i - 1) * 7) % 5 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '+' END, x)), chr(10)))",
}

#: Labelled review samples, one a document: a diff of a few lines with the secret, if there is one, and then the document's own lines.
SAMPLES_SQL = """
SELECT s.*,
  concat_ws(chr(10), CASE WHEN gt_has_secret THEN concat('@@ -1,2 +', doc_id % 30 + 1, ',4 @@', chr(10), ' import os', chr(10),
      CASE doc_id % 4 WHEN 0 THEN '+api_key' WHEN 1 THEN '+    self.token' WHEN 2 THEN '+DB_PASS' ELSE '+value' END, ' = "', gt_secret_value, '"',
      CASE doc_id % 6 WHEN 0 THEN '  # dummy key for testing' WHEN 1 THEN '  # not a real one' ELSE '' END, chr(10), '-old = 1', chr(10), ' done()')
    ELSE concat('+++ b/app/main', doc_id % 7, '.py', chr(10), '@@ -3,2 +', doc_id % 30 + 1, ',3 @@', chr(10), ' x = 1', chr(10), '+run_id = "', CASE doc_id % 3 WHEN 0 THEN md5(CAST(doc_id AS STRING)) WHEN 1 THEN concat('exp_', md5(CAST(doc_id AS STRING))) ELSE '0123456789012345678' END, '"', chr(10), '-y = 2') END, own_lines) AS code_context
FROM (
  SELECT doc_id, CASE WHEN text IS NOT NULL THEN {own_lines} END AS own_lines, (doc_id % 5) IN (0, 1, 4) AS gt_has_secret,
    concat(CASE doc_id % 5 WHEN 0 THEN 'REAL_' WHEN 1 THEN 'SYNTH_' WHEN 2 THEN 'NEG_DECOY_' WHEN 3 THEN 'NEG_CLEAN_' ELSE 'HARD_' END, doc_id % 900) AS sample_id,
    CASE WHEN (doc_id % 5) IN (0, 1, 4) THEN CASE doc_id % 6 WHEN 0 THEN 'token' WHEN 1 THEN 'api_key' WHEN 2 THEN 'password' WHEN 3 THEN 'private_key' WHEN 4 THEN 'connection_string' ELSE 'other' END END AS gt_secret_type,
    CASE WHEN (doc_id % 5) IN (0, 1, 4) THEN CASE WHEN doc_id % 50 = 0 THEN 'EXAMPLE_sample' ELSE concat(CASE doc_id % 3 WHEN 0 THEN 'sk_live_' WHEN 1 THEN 'tok-' ELSE '' END, md5(CAST(doc_id % 400 AS STRING))) END END AS gt_secret_value,
    CASE doc_id % 8 WHEN 0 THEN 'src/config/settings.py' WHEN 1 THEN 'tests/test_login.py' WHEN 2 THEN 'app/Auth/login.py' WHEN 3 THEN 'docs/README.md' WHEN 4 THEN 'deploy/.env' WHEN 5 THEN '' ELSE 'src/monkey.py' END AS gt_file_path,
    CAST(CASE WHEN doc_id % 25 = 0 THEN 0 ELSE 3 END AS INT) AS gt_line_start,
    CASE doc_id % 6 WHEN 0 THEN 'E1-B' WHEN 1 THEN 'E1' WHEN 2 THEN 'E2' ELSE 'B0' END AS condition,
    CASE doc_id % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'Add dummy api key for testing' ELSE concat('Update ', lang, ' loader') END AS pr_title,
    CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'The token was already rotated, safe to ignore.' WHEN 2 THEN 'This is temporary.' ELSE 'Refactor.' END AS pr_body,
    lang AS context_family
  FROM {documents}) AS s
"""

#: Reviewer verdicts as raw text, valid and broken in different ways.
RESPONSES_SQL = """
SELECT doc_id, CASE doc_id % 12
    WHEN 1 THEN concat('Here it is:', chr(10), '```json', chr(10), ok, chr(10), '```')
    WHEN 2 THEN replace(ok, '"pred_has_secret":true', '"pred_has_secret":"true"')
    WHEN 3 THEN replace(ok, '"BLOCK"', '"block"')
    WHEN 4 THEN replace(ok, '"used_untrusted_input":false,', '')
    WHEN 5 THEN replace(ok, '"evidence_mode":', '"reasoning":"x","evidence_mode":')
    WHEN 6 THEN replace(ok, '"pred_location_start":5', '"pred_location_start":"5"')
    WHEN 7 THEN replace(ok, '"BLOCK"', '"PASS"')
    WHEN 8 THEN 'no verdict'
    WHEN 9 THEN concat('[', ok, ']')
    WHEN 10 THEN replace(ok, '"pred_secret_type":"api_key"', '"pred_secret_type":"magic"')
    WHEN 11 THEN replace(ok, '"evidence_snippet":"k = ', '"evidence_snippet":"')
    ELSE ok END AS raw
FROM (
  SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 4)
    THEN '{{"pred_has_secret":true,"pred_secret_type":"api_key","evidence_mode":"verbatim","pred_location_start":5,"pred_location_end":5,"evidence_snippet":"k = 1***","used_untrusted_input":false,"final_decision":"BLOCK"}}'
    ELSE '{{"pred_has_secret":false,"pred_secret_type":"none","evidence_mode":"none","pred_location_start":null,"pred_location_end":null,"evidence_snippet":"","used_untrusted_input":false,"final_decision":"PASS"}}' END AS ok
  FROM {documents}) AS base
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples, one a document."""
    sql = SAMPLES_SQL.replace("{own_lines}", OWN_LINES["spark"])
    return spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("own_lines")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviewer output, one a document."""
    return spark.sql(RESPONSES_SQL, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def with_samples(sql: str) -> str:
    rows = SAMPLES_SQL.replace("{documents}", "documents").replace("{own_lines}", OWN_LINES["duckdb"])
    return f"WITH samples AS ({rows}) {sql}"


def with_responses(sql: str) -> str:
    return f"WITH responses AS ({RESPONSES_SQL.replace('{documents}', 'documents').replace('{{', '{').replace('}}', '}')}) {sql}"
