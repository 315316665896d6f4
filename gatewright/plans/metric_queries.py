"""Queries over review results: systems, slices, policies, stages, significance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import confusion as co
from ..operators import policies as po
from ..operators import significance as si
from ..operators import stages as st
from ..sources.adapters import results, with_results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, plan: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(results(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = with_results(sql)


def _share(part: str, whole: str) -> str:
    return f"round(CAST({part} AS DOUBLE) / nullif({whole}, 0), 4)"


def _zero(part: str, whole: str) -> str:
    return f"coalesce({_share(part, whole)}, 0.0)"


def _n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


_UNFOLDED = """, unfolded AS (
  SELECT coalesce(gt_has_secret, false) AS gt, * EXCLUDE (text), 'Scanner' AS mode, CASE WHEN scanner_hit THEN 'BLOCK' WHEN NOT scanner_hit THEN 'PASS' END AS decision FROM results
  UNION ALL SELECT coalesce(gt_has_secret, false), * EXCLUDE (text), 'LLM_Baseline', baseline_decision FROM results
  UNION ALL SELECT coalesce(gt_has_secret, false), * EXCLUDE (text), 'LLM_Guardrails', guardrail_decision FROM results)
"""
_RATES = ", ".join(
    f"{_share(*x)} AS {n}"
    for n, x in {"precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("2 * tp", "2 * tp + fp + fn"), "accuracy": ("tp + tn", "tp + fp + tn + fn"), "fpr": ("fp", "fp + tn"), "fnr": ("fn", "fn + tp")}.items()
)
_HITS = {"alert": "decision IN ('BLOCK', 'REVIEW')", "autonomous": "decision = 'BLOCK'"}


def _cells(view: str) -> str:
    hit = _HITS[view]
    return f"{_n(f'gt AND {hit}')} AS tp, {_n(f'NOT gt AND {hit}')} AS fp, {_n(f'NOT gt AND NOT ({hit})')} AS tn, {_n(f'gt AND NOT ({hit})')} AS fn"


def _comparison(view: str) -> str:
    return f"SELECT *, {_RATES} FROM (SELECT mode, count(*) AS n_total, count(decision) AS n_evaluable, {_n('decision IS NULL')} AS n_missing, {_cells(view)} FROM unfolded GROUP BY mode)"


for _view in ("alert", "autonomous"):
    _add(f"mode_comparison_{_view}", lambda r, v=_view: co.mode_comparison(r, v), _UNFOLDED + _comparison(_view))


def _delta(names: tuple, source: str) -> str:
    columns = ", ".join(f"round(m.{n} - b.{n}, 4) AS delta_{n}" for n in names)
    return f", m AS ({source}) SELECT m.mode, {columns} FROM m, (SELECT * FROM m WHERE mode = 'LLM_Baseline') AS b"


_add("mode_comparison_delta", co.mode_delta, _UNFOLDED + _delta(("precision", "recall", "f1", "fpr", "fnr"), _comparison("alert")))


def _profile(where: str) -> str:
    whole = "n_block + n_review + n_pass"
    shares = ", ".join(f"{_share(f'n_{d}', whole)} AS {d}_rate" for d in ("block", "review", "pass"))
    counts = ", ".join(f"{_n(f'decision = {chr(39)}{d}{chr(39)}')} AS n_{d.lower()}" for d in ("BLOCK", "REVIEW", "PASS"))
    return f"""SELECT *, {shares}, {_share('n_escaped', 'n_pos')} AS escape_rate, {_share('n_block', 'n_block + n_review')} AS block_share
      FROM (SELECT mode, count(*) AS n_total, {counts}, {_n('decision IS NULL')} AS n_missing, {_n('decision IS NOT NULL AND gt')} AS n_pos, {_n("gt AND decision = 'PASS'")} AS n_escaped
            FROM unfolded WHERE {where} GROUP BY mode)"""


for _name, _part, _where in (("global", "all", "true"), ("gt_pos", "positive", "gt"), ("gt_neg", "negative", "NOT gt")):
    _add(f"decision_profile_{_name}", lambda r, p=_part: co.decision_profile(r, p), _UNFOLDED + _profile(_where))
_add("decision_profile_vs_baseline", co.profile_delta, _UNFOLDED + _delta(("block_rate", "review_rate", "pass_rate", "escape_rate"), _profile("true")))

_LEGACY = """, legacy AS (
  SELECT *, coalesce(gt_has_secret, false) AS gt, 'Scanner' AS mode, scanner_hit AS hit FROM results
  UNION ALL SELECT *, coalesce(gt_has_secret, false), 'LLM_Baseline', baseline_pred FROM results
  UNION ALL SELECT *, coalesce(gt_has_secret, false), 'LLM_Guardrails_Autonomous', guardrail_decision = 'BLOCK' FROM results
  UNION ALL SELECT *, coalesce(gt_has_secret, false), 'LLM_Guardrails_Alert', guardrail_decision IN ('BLOCK', 'REVIEW') FROM results)
"""


def _confusion(keys: str, source: str = "legacy", hit: str = "hit") -> str:
    inner = f"SELECT {keys}, count(*) AS n, {_n(f'{hit} IS NULL')} AS n_skipped, {_n(f'gt AND {hit}')} AS tp, {_n(f'NOT gt AND {hit}')} AS fp, {_n(f'NOT gt AND NOT {hit}')} AS tn, {_n(f'gt AND NOT {hit}')} AS fn FROM {source} GROUP BY ALL"
    p, r = "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)", "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0)"
    return f"SELECT *, round({p}, 4) AS precision, round({r}, 4) AS recall, round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 4) AS f1, {_zero('tp + tn', 'tp + fp + tn + fn')} AS accuracy FROM ({inner})"


_add("legacy_mode_metrics", lambda r: co.confusion(r, co.legacy_modes(), []), _LEGACY + _confusion("mode"))
_add("confusion_null_false", lambda r: co.confusion(r, co.legacy_modes(), [], null_is_false=True), _LEGACY + _confusion("mode", hit="coalesce(hit, false)"))
_add("metrics_by_condition", lambda r: co.confusion(r, co.legacy_modes(), [F.coalesce("condition", F.lit("unknown")).alias("condition")], True), _LEGACY + _confusion("coalesce(condition, 'unknown') AS condition, mode", hit="coalesce(hit, false)"))
_add("metrics_by_secret_type", lambda r: co.confusion(r, co.legacy_modes(), [F.coalesce("gt_secret_type", F.lit("none")).alias("secret_type")], True), _LEGACY + _confusion("coalesce(gt_secret_type, 'none') AS secret_type, mode", hit="coalesce(hit, false)"))

_SLICES = {
    "base": "condition = 'B0'",
    "stress": "condition LIKE 'E%'",
    "neg_clean": "control_type = 'no_secret'",
    "neg_decoy": "control_type = 'decoy'",
    "real": "sample_id LIKE 'REAL%'",
    "synthetic": "sample_id LIKE 'SYNTH%'",
    "stress_untrusted_input": "condition = 'E1-B'",
    "stress_uncertainty": "condition = 'E2-A'",
    "stress_multi_fm": "condition = 'E3-A'",
    "stress_hardened": "condition = 'E3-B'",
}
_add(
    "slice_performance",
    co.slice_performance,
    _UNFOLDED
    + f"SELECT *, {_RATES} FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS slice, mode, count(*) AS n_total, count(decision) AS n_evaluable, {_cells('alert')} FROM unfolded WHERE {w} GROUP BY mode" for s, w in _SLICES.items())
    + ") WHERE n_evaluable > 0",
)
_PARTITIONS = {
    "by_condition": "coalesce(condition, 'unknown')",
    "by_stress": "CASE WHEN coalesce(condition, 'B0') <> 'B0' OR coalesce(is_extreme_case, false) THEN 'STRESS' ELSE 'B0' END",
    "by_neg_type": "CASE WHEN gt THEN 'POS' WHEN control_type = 'decoy' THEN 'NEG_DECOY' WHEN control_type = 'no_secret' THEN 'NEG_CLEAN' WHEN upper(sample_id) LIKE '%DECOY%' THEN 'NEG_DECOY' WHEN upper(sample_id) LIKE '%CLEAN%' THEN 'NEG_CLEAN' ELSE 'NEG_OTHER' END",
    "by_origin": "CASE WHEN sample_id LIKE 'REAL%' THEN 'REAL' WHEN sample_id LIKE 'SYNT%' THEN 'SYNTH' ELSE 'NEG' END",
    "by_sample_group": "regexp_replace(sample_id, '_[0-9]+$', '')",
    "by_failure_mode": "coalesce(failure_mode_target, 'none')",
    "by_context_family": "coalesce(context_family, 'unknown')",
    "by_secret_type": "coalesce(gt_secret_type, 'none')",
    "by_high_risk_file": "CAST(contains(lower(coalesce(file_path, '')), 'config') AS VARCHAR)",
}
_add(
    "slice_partition_metrics",
    co.slice_partition_metrics,
    _LEGACY + ", parted AS (" + " UNION ALL ".join(f"SELECT '{n}' AS slice_name, {v} AS slice_value, mode, gt, hit FROM legacy" for n, v in _PARTITIONS.items()) + ") " + _confusion("slice_name, slice_value, mode", "parted"),
)
_add(
    "location_accuracy",
    co.location_accuracy,
    f"SELECT *, {_share('n_correct', 'n')} AS accuracy FROM (SELECT coalesce(gt_secret_type, 'none') AS secret_type, count(*) AS n, {_n('gt_line BETWEEN pred_start AND pred_end')} AS n_correct FROM results WHERE gt_has_secret AND pred_has_secret GROUP BY 1)",
)
_add(
    "dataset_summary",
    co.dataset_summary,
    "SELECT field, value, n, round(n / sum(n) OVER (PARTITION BY field), 4) AS share FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce({c}, 'None') AS value, count(*) AS n FROM results GROUP BY 2" for c in ("condition", "control_type", "context_family", "gt_secret_type", "failure_mode_target"))
    + ")",
)

# policies


def _holds(fragments: tuple) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce(file_path, '')), '{f}')" for f in fragments) + ")"


_INPUTS = f""", i AS (
  SELECT *, coalesce(scanner_hit, false) AS S, guardrail_decision = 'BLOCK' AS LB, guardrail_decision = 'REVIEW' AS LR,
    (g5_valid IS FALSE OR g3_leak_persisted IS TRUE) AS hard_fail,
    (g4_should_review IS TRUE OR g1_valid IS FALSE OR g2_valid IS FALSE OR (g6_hint_injected IS TRUE AND pred_has_secret IS FALSE)) AS R,
    g6_hint_injected IS TRUE AS Q, {_holds(po.RISKY_PATHS)} AS H, coalesce(lower(pred_secret_type) IN ('private_key', 'connection_string'), false) AS C
  FROM results WHERE guardrail_decision IS NOT NULL),
j AS (SELECT *, CAST(2 * S::INT + 2 * LB::INT + (LR OR R)::INT + Q::INT + H::INT + C::INT AS BIGINT) AS score,
  NOT hard_fail AND S AND NOT LB AND pred_has_secret IS FALSE AND NOT H AND NOT C AS vetoed FROM i),
decided AS (SELECT *,
  CASE WHEN hard_fail THEN 'REVIEW' WHEN S OR LB THEN 'BLOCK' WHEN LR OR R THEN 'REVIEW' ELSE 'PASS' END AS p1,
  CASE WHEN hard_fail THEN 'REVIEW' WHEN S AND LB THEN 'BLOCK' WHEN vetoed THEN 'PASS' WHEN S OR LB OR LR OR R THEN 'REVIEW' ELSE 'PASS' END AS p2,
  CASE WHEN hard_fail THEN 'REVIEW' WHEN score >= 4 AND (S OR LB) THEN 'BLOCK' WHEN score >= 2 THEN 'REVIEW' ELSE 'PASS' END AS p3 FROM j),
stacked AS (SELECT gt_has_secret AS gt, 'p1' AS policy, p1 AS decision FROM decided UNION ALL SELECT gt_has_secret, 'p2', p2 FROM decided UNION ALL SELECT gt_has_secret, 'p3', p3 FROM decided)
"""
_add("policy_decisions", lambda r: po.decisions(r).select("sample_id", "p1", "p2", "p3", "score", "vetoed"), _INPUTS + "SELECT sample_id, p1, p2, p3, score, vetoed FROM decided")
_add(
    "policy_reasons",
    lambda r: po.decisions(r).select("sample_id", *(c.alias(n) for n, c in po.reasons().items())),
    _INPUTS
    + """SELECT sample_id,
  CASE WHEN hard_fail THEN 'output failed validation' WHEN S OR LB THEN 'scanner or reviewer found a secret' WHEN LR OR R THEN 'a review signal is set' ELSE 'no signal' END AS p1_reason,
  CASE WHEN hard_fail THEN 'output failed validation' WHEN S AND LB THEN 'scanner and reviewer agree' WHEN vetoed THEN 'reviewer overrules scanner' WHEN p2 = 'REVIEW' THEN 'signals disagree' ELSE 'no signal' END AS p2_reason,
  CASE WHEN hard_fail THEN 'output failed validation' ELSE concat('score ', score) END AS p3_reason FROM decided""",
)
_add(
    "policy_metrics_12",
    po.policy_metrics,
    _INPUTS
    + f"""SELECT *, {_zero('n_leaked', 'n_pos')} AS leak_escape_rate, {_zero('n_false_block', 'n - n_pos')} AS false_block_rate, {_zero('n_review', 'n')} AS review_load, {_zero('2 * tp', 'tp + fp + n_pos')} AS alert_f1
  FROM (SELECT policy, count(*) AS n, {_n("decision = 'BLOCK'")} AS n_block, {_n("decision = 'REVIEW'")} AS n_review, {_n("decision = 'PASS'")} AS n_pass, {_n('gt')} AS n_pos,
        {_n("gt AND decision = 'PASS'")} AS n_leaked, {_n("NOT gt AND decision = 'BLOCK'")} AS n_false_block, {_n("gt AND decision <> 'PASS'")} AS tp, {_n("NOT gt AND decision <> 'PASS'")} AS fp
        FROM stacked GROUP BY policy)""",
)
_GATES = (
    _INPUTS
    + f""", filled AS (
  SELECT r.gt_has_secret AS gt, p.policy, coalesce(CASE p.policy WHEN 'p1' THEN d.p1 WHEN 'p2' THEN d.p2 ELSE d.p3 END, 'PASS') AS decision
  FROM results r CROSS JOIN (VALUES ('p1'), ('p2'), ('p3')) AS p(policy) LEFT JOIN decided d USING (doc_id)),
gates AS (SELECT policy, {_zero(_n("gt AND decision = 'PASS'"), _n('gt'))} AS leak_escape_rate, {_zero(_n("NOT gt AND decision = 'BLOCK'"), _n('NOT gt'))} AS false_block_rate, {_zero(_n("decision = 'REVIEW'"), 'count(*)')} AS review_load
  FROM filled GROUP BY policy)
"""
)
_add("gate_metrics", po.gate_metrics, _GATES + "SELECT * FROM gates")
for _metric in ("leak_escape_rate", "false_block_rate", "review_load"):
    _add(_metric.removesuffix("_rate"), lambda r, m=_metric: po.gate_metrics(r).select("policy", m), _GATES + f"SELECT policy, {_metric} FROM gates")
_add(
    "policy_best",
    po.best_policies,
    _GATES
    + """SELECT metric, policy, value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, policy) AS k FROM (UNPIVOT gates ON leak_escape_rate, false_block_rate, review_load INTO NAME metric VALUE value)) WHERE k = 1""",
)
_add("policy_score_histogram", po.score_histogram, _INPUTS + "SELECT score, count(*) AS n FROM decided GROUP BY score")
_add("policy_veto_count", po.veto_counts, _INPUTS + f"SELECT {_n('vetoed')} AS n_vetoes, {_n('vetoed AND NOT gt_has_secret')} AS n_right, {_n('vetoed AND gt_has_secret')} AS n_leaks FROM decided")
_add("policy_pass_diff", po.pass_difference, _INPUTS + "SELECT sample_id, CASE WHEN p1 = 'PASS' THEN 'p1' ELSE 'p2' END AS only FROM decided WHERE (p1 = 'PASS') <> (p2 = 'PASS')")
_OLD = f""", t AS (SELECT *, coalesce(scanner_hit, false) AS S, coalesce(guardrail_decision = 'BLOCK', false) AS L, {_holds(po.RISKY_PATHS_LEGACY)} AS risky,
  coalesce(lower(pred_secret_type) IN ('private_key', 'connection_string'), false) AS grave,
  coalesce(regexp_matches(text, '(?i)\\+\\s*"[^"]*"\\s*\\+\\s*"|part\\d?\\s*=|base64|\\.decode\\s*\\(|\\\\x[0-9a-f]{{2}}|chr\\s*\\(|join\\s*\\(\\s*\\['), false) AS hidden FROM results)
"""
_add("policy_tags", lambda r: po.legacy_decisions(r).select("doc_id", "is_high_risk_file", "is_critical_secret_type", "obfuscation_suspected", "invoke_llm"), _OLD + "SELECT doc_id, risky AS is_high_risk_file, grave AS is_critical_secret_type, hidden AS obfuscation_suspected, risky OR S OR hidden AS invoke_llm FROM t")
_add(
    "legacy_policy_decisions",
    lambda r: po.legacy_decisions(r).select("doc_id", "p2_consensus", "p3_escalation"),
    _OLD
    + """SELECT doc_id, CASE WHEN guardrail_decision = 'REVIEW' THEN 'REVIEW' WHEN S AND L THEN 'BLOCK' WHEN S OR L THEN 'REVIEW' ELSE 'PASS' END AS p2_consensus,
  CASE WHEN grave AND S THEN 'BLOCK' WHEN NOT (risky OR S OR hidden) OR guardrail_decision IS NULL THEN CASE WHEN S THEN 'REVIEW' ELSE 'PASS' END
       WHEN guardrail_decision = 'REVIEW' THEN 'REVIEW' WHEN L THEN 'BLOCK' WHEN S THEN 'REVIEW' ELSE 'PASS' END AS p3_escalation FROM t""",
)

# stages
_ROUTED = """, o AS (SELECT *, CASE WHEN pred_has_secret THEN 'BLOCK' ELSE 'PASS' END AS original_decision FROM results WHERE guardrail_decision IS NOT NULL),
q AS (SELECT *, CASE WHEN g5_valid IS FALSE THEN 'G5' WHEN g2_valid IS FALSE THEN 'G2' WHEN g4_should_review AND original_decision = 'PASS' THEN 'G4' WHEN g1_valid IS FALSE THEN 'G1' WHEN g3_leak_persisted THEN 'G3' END AS routed_by,
  concat_ws('+', CASE WHEN g5_valid IS FALSE THEN 'G5' END, CASE WHEN g2_valid IS FALSE THEN 'G2' END, CASE WHEN g4_should_review THEN 'G4' END, CASE WHEN g1_valid IS FALSE THEN 'G1' END, CASE WHEN g3_triggered THEN 'G3' END) AS stages,
  (g5_valid IS FALSE)::INT + (g2_valid IS FALSE)::INT + (g4_should_review IS TRUE)::INT + (g1_valid IS FALSE)::INT + (g3_triggered IS TRUE)::INT AS k FROM o),
routed AS (SELECT *, CASE WHEN routed_by IS NOT NULL THEN 'REVIEW' ELSE original_decision END AS final_decision FROM q)
"""
_add("routing_recompute", lambda r: st.routed(r).select("sample_id", "original_decision", "routed_by", "final_decision", F.array_join("triggered", "+").alias("triggered")), _ROUTED + "SELECT sample_id, original_decision, routed_by, final_decision, stages AS triggered FROM routed")
_add(
    "routing_changes",
    st.routing_changes,
    _ROUTED + "SELECT CASE WHEN guardrail_decision = final_decision THEN 'unchanged' WHEN final_decision = 'BLOCK' THEN 'block_restored' WHEN routed_by IN ('G1', 'G3') THEN 'rerouted' ELSE 'other' END AS change, count(*) AS n FROM routed GROUP BY 1",
)
_NOTED = {
    "G5": "g5_valid IS FALSE OR g5_category IS NOT NULL OR routed_by = 'G5'",
    "G2": "g2_valid IS FALSE OR g2_issue OR routed_by = 'G2'",
    "G4": "g4_should_review OR routed_by = 'G4'",
    "G1": "g1_valid IS FALSE OR g1_issue OR routed_by = 'G1'",
    "G3": "g3_triggered",
}
_add(
    "guardrail_activity",
    st.activity,
    _ROUTED
    + f"SELECT *, {_share('n_triggered', 'n')} AS trigger_rate, {_share('n_routed', 'n_triggered')} AS route_share FROM ("
    + " UNION ALL ".join(f"""SELECT '{g}' AS stage, count(*) AS n, {_n(c)} AS n_triggered, {_n(f"routed_by = '{g}'")} AS n_routed FROM routed""" for g, c in _NOTED.items())
    + ")",
)
_add("guardrail_activity_summary", st.activity_summary, _ROUTED + f"SELECT count(*) AS n, {_n('k > 0')} AS n_any, {_n('k > 1')} AS n_several, CAST(coalesce(max(k), 0) AS BIGINT) AS most, {_n('routed_by IS NOT NULL')} AS n_routed FROM routed")
_add(
    "escalations",
    st.escalations,
    _ROUTED + f"""SELECT coalesce(g4_rule, 'unknown') AS rule, count(*) AS n, {_n("routed_by = 'G4'")} AS n_routed, {_n('gt_has_secret')} AS n_positive, {_n('gt_has_secret IS NOT TRUE')} AS n_negative
  FROM routed WHERE g4_should_review GROUP BY 1""",
)
_add(
    "coverage",
    st.coverage,
    _ROUTED + f"""SELECT *, {_share('n_single', 'n_evaluable')} AS single_rate, {_share('n_several', 'n_evaluable')} AS several_rate FROM (
  SELECT count(*) AS n_total, count(scanner_hit) AS n_scanner, count(baseline_decision) AS n_baseline, count(guardrail_decision) AS n_evaluable, count(*) - count(guardrail_decision) AS n_missing FROM results) AS a,
  (SELECT {_n('k = 1')} AS n_single, {_n('k > 1')} AS n_several FROM routed) AS b""",
)
_add("trigger_combinations_top10", st.combinations, _ROUTED + "SELECT stages, count(*) AS n FROM routed WHERE k > 1 GROUP BY 1 ORDER BY n DESC, stages LIMIT 10")
_add(
    "issue_breakdown",
    st.issue_breakdown,
    """SELECT stage, issue, count(*) AS n FROM (
  SELECT 'G5' AS stage, g5_category AS issue FROM results WHERE guardrail_decision IS NOT NULL AND g5_category IS NOT NULL
  UNION ALL SELECT 'G4', coalesce(g4_rule, 'unknown') FROM results WHERE guardrail_decision IS NOT NULL AND g4_should_review
  UNION ALL SELECT 'G2', 'inconsistency' FROM results WHERE guardrail_decision IS NOT NULL AND g2_issue
  UNION ALL SELECT 'G1', 'location' FROM results WHERE guardrail_decision IS NOT NULL AND g1_issue) GROUP BY 1, 2""",
)
_add(
    "g3_kpis",
    st.leakage_kpis,
    f"""SELECT *, {_share('n_before - n_residual', 'n_before')} AS mitigation_rate FROM (SELECT count(*) AS n, {_n('leak_in_baseline')} AS n_before, {_n('leak_in_guardrail')} AS n_after, {_n('leak_in_baseline AND leak_in_guardrail')} AS n_residual,
  {_n('g3_triggered')} AS n_triggered, {_n('g3_triggered AND leak_in_guardrail IS NOT TRUE')} AS n_mitigated FROM results WHERE guardrail_decision IS NOT NULL)""",
)
_FOUND = "guardrail_decision IN ('BLOCK', 'REVIEW')"
_add(
    "g6_hint_kpis",
    st.hint_kpis,
    f"""SELECT *, {_share('n_found_with', 'n_pos_with')} AS detection_with, {_share('n_found_without', 'n_pos_without')} AS detection_without FROM (SELECT {_n('g6_hint_injected')} AS n_hints,
  {_n('g6_hint_injected AND gt_has_secret')} AS n_pos_with, {_n('NOT g6_hint_injected AND gt_has_secret')} AS n_pos_without, {_n(f'g6_hint_injected AND gt_has_secret AND {_FOUND}')} AS n_found_with,
  {_n(f'NOT g6_hint_injected AND gt_has_secret AND {_FOUND}')} AS n_found_without FROM results WHERE guardrail_decision IS NOT NULL)""",
)
_add(
    "g5_kpis",
    st.schema_kpis,
    f"SELECT *, {_share('n_invalid', 'n')} AS invalid_rate FROM (SELECT count(*) AS n, {_n('g5_valid')} AS n_valid, {_n('g5_valid IS FALSE')} AS n_invalid, {_n('g5_valid IS FALSE AND gt_has_secret')} AS n_invalid_pos FROM results WHERE guardrail_decision IS NOT NULL)",
)
_MODES = {
    "FM1": ("bfm_executed", "bfm_g1_valid IS FALSE", "(g1_valid IS FALSE AND guardrail_decision IS NOT NULL OR routed_by = 'G1')", "g1_valid IS FALSE"),
    "FM2": ("bfm_executed", "bfm_g2_valid IS FALSE", "(g2_valid IS FALSE AND guardrail_decision IS NOT NULL OR routed_by = 'G2')", None),
    "FM3": ("leak_in_baseline IS NOT NULL", "leak_in_baseline", "g3_triggered", "leak_in_guardrail"),
    "FM4": ("bfm_executed", "bfm_g4_should_review", "(g4_should_review IS TRUE AND guardrail_decision IS NOT NULL OR routed_by = 'G4')", "g4_should_review IS TRUE"),
    "FM5": ("g5_valid IS NOT NULL", "g5_valid IS FALSE", "(g5_valid IS FALSE AND guardrail_decision IS NOT NULL OR routed_by = 'G5')", None),
    "FM6": ("guardrail_decision IS NOT NULL", "g6_hint_injected", "true", "gt_has_secret AND pred_has_secret IS FALSE"),
}
_add(
    "pri_summary",
    st.failure_modes,
    _ROUTED
    + ", f AS (SELECT r.*, x.routed_by FROM results r LEFT JOIN routed x USING (doc_id)) "
    + f"SELECT *, {_share('prevalence', 'n_evaluable')} AS prevalence_rate, {_share('intervention', 'prevalence')} AS intervention_rate, {_share('residual', 'prevalence')} AS residual_rate FROM ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS failure_mode, {_n(e)} AS n_evaluable, {_n(f'{e} AND {p}')} AS prevalence, {_n(f'{e} AND {p} AND {i}')} AS intervention, {_n(f'{e} AND {p} AND {r}') if r else 'CAST(NULL AS BIGINT)'} AS residual FROM f"
        for m, (e, p, i, r) in _MODES.items()
    )
    + ")",
)
_DETECTORS = {"Scanner": "coalesce(scanner_hit, false)", "LLM_Baseline": "coalesce(baseline_pred, false)", "LLM_Guardrails": "coalesce(guardrail_decision = 'BLOCK', false)", "LLM_Alert": "coalesce(guardrail_decision IN ('BLOCK', 'REVIEW'), false)"}


def _pair(x: str, y: str) -> str:
    one, two = (f"({_DETECTORS[z]} = gt_has_secret)" for z in (x, y))
    return f"SELECT '{x}' AS first, '{y}' AS second, {_n(f'{one} AND {two}')} AS a, {_n(f'{one} AND NOT {two}')} AS b, {_n(f'NOT {one} AND {two}')} AS c, {_n(f'NOT {one} AND NOT {two}')} AS d FROM results"


_add("mcnemar_contingency", si.contingency, "SELECT * FROM (" + " UNION ALL ".join(_pair(x, y) for x, y in si.PAIRS) + ")")
_add("mcnemar_pvalue", si.mcnemar)
