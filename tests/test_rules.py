"""Operators against cases worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from gatewright.operators import datasets as ds
from gatewright.operators import diffs as di
from gatewright.operators import policies as po
from gatewright.operators import review as rv
from gatewright.operators import scanning as sc
from gatewright.operators import significance as si
from gatewright.operators import verdicts as ve
from gatewright.plans import pipeline

SECRET = {"pred_has_secret": True, "pred_secret_type": "api_key", "evidence_mode": "verbatim", "pred_location_start": 5, "pred_location_end": 5, "evidence_snippet": "API_KEY = 'sk_t***'", "used_untrusted_input": False, "final_decision": "BLOCK"}
NONE = {"pred_has_secret": False, "pred_secret_type": "none", "evidence_mode": "none", "pred_location_start": None, "pred_location_end": None, "evidence_snippet": "", "used_untrusted_input": False, "final_decision": "PASS"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def without(row, key):
    return {k: v for k, v in row.items() if k != key}


VERDICTS = [
    (json.dumps(SECRET), True, []),
    (json.dumps(NONE), True, []),
    ("```json\n" + json.dumps(NONE) + "\n```", True, []),
    ("not json", False, ["PARSE_ERROR"]),
    (None, False, ["PARSE_ERROR"]),
    ("null", False, ["PARSE_ERROR"]),
    (json.dumps([SECRET]), False, ["SCHEMA_VIOLATION"]),
    (json.dumps(without(SECRET, "final_decision")), False, ["REPAIR_FAIL", "SCHEMA_VIOLATION"]),
    (json.dumps(SECRET | {"pred_secret_type": "magic"}), False, ["REPAIR_FAIL", "SCHEMA_VIOLATION"]),
    (json.dumps(SECRET | {"pred_secret_type": "none"}), False, ["CONSISTENCY_VIOLATION", "REPAIR_FAIL"]),
    (json.dumps(SECRET | {"evidence_snippet": " "}), False, ["CONSISTENCY_VIOLATION", "REPAIR_FAIL"]),
    (json.dumps(SECRET | {"pred_location_start": None}), False, ["CONSISTENCY_VIOLATION", "REPAIR_FAIL"]),
    (json.dumps(SECRET | {"final_decision": "PASS"}), False, ["CONSISTENCY_VIOLATION", "REPAIR_FAIL"]),
    (json.dumps(SECRET | {"pred_location_start": 3, "pred_location_end": 7}), False, ["CONSISTENCY_VIOLATION", "REPAIR_FAIL"]),
    (json.dumps(NONE | {"final_decision": "BLOCK"}), False, ["CONSISTENCY_VIOLATION", "REPAIR_FAIL"]),
    (json.dumps(NONE | {"pred_location_start": 3}), False, ["CONSISTENCY_VIOLATION", "REPAIR_FAIL"]),
    (json.dumps(NONE | {"reasoning": "x"}), False, ["REPAIR_FAIL", "SCHEMA_VIOLATION"]),
    (json.dumps(NONE | {"confidence": "HIGH"}), True, []),
    (json.dumps(NONE | {"pred_has_secret": "false"}), True, ["REPAIR_SUCCESS", "SCHEMA_VIOLATION"]),
    (json.dumps(SECRET | {"pred_location_start": 5.0}), True, ["CONSISTENCY_VIOLATION", "REPAIR_SUCCESS", "SCHEMA_VIOLATION"]),
    (json.dumps(SECRET | {"pred_secret_type": "Token"}), True, []),
    ('{"pred_has_secret": true}', False, ["CONSISTENCY_VIOLATION", "REPAIR_FAIL", "SCHEMA_VIOLATION"]),
]


def test_verdicts(spark):
    rows = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VERDICTS)], "i int, raw string")
    got = {r["i"]: r for r in ve.validated(rows).withColumn("d", ve.routed_decision()).collect()}
    for i, (raw, valid, categories) in enumerate(VERDICTS):
        assert (got[i]["schema_valid"], got[i]["error_categories"]) == (valid, categories), raw
        assert got[i]["d"] == ("REVIEW" if not valid else got[i]["verdict"]["final_decision"].upper())


SCANS = [
    ("sk_live_" + "a1" * 12, "stripe_key"),
    ("AKIA" + "A1" * 8, "aws_access_key"),
    ("ghp_" + "a" * 36, "github_pat"),
    ("glpat-" + "a" * 20, "gitlab_pat"),
    ("xoxb-" + "1" * 10, "slack_token"),
    ("-----BEGIN RSA PRIVATE KEY-----", "pem_private_key"),
    ("postgres://u:" + "p" * 9 + "@h", "connection_string"),
    ("password = 'abcdefgh1'", "password_assignment"),
    ("sk_l***", None),
    ("AKIAI***", None),
    ("the word password alone", None),
]


@pytest.mark.parametrize("text,name", SCANS)
def test_patterns(spark, text, name):
    got = [f["pattern"] for f in one(spark, sc.findings(F.lit(text)))]
    assert (name in got) if name else got == []


def test_entropy_and_spans(spark):
    assert one(spark, sc.entropy(F.lit("abcdefghij"))) == pytest.approx(math.log2(10))
    assert one(spark, sc.entropy(F.lit("aaaa"))) == 0
    spans = one(spark, sc.entropy_spans(F.lit("aaaaaaaaaaaa placeholder evidence_snippet a1B2c3D4e5F6 src/a/b/c.py aB3***xyz123456")))
    assert spans == ["a1B2c3D4e5F6"]


def test_echo_and_redaction(spark):
    found = one(spark, sc.literals(F.lit("a = 'abcdefgh1' b = 'your_key_123' c = 'ab***cdefgh'")))
    assert found == ["abcdefgh1"]
    assert one(spark, sc.exact_echoes(F.lit("has abcdefgh1 in"), F.array(F.lit("abcdefgh1"), F.lit("short")))) == ["abcdefgh1"]
    assert one(spark, sc.redacted(F.lit("x abcd abcdef y"), F.array(F.lit("abcd"), F.lit("abcdef"), F.lit("y")))) == "x ***REDACTED*** ***REDACTED*** y"


def test_partial_leaks(spark):
    secret = "abcdEFGHIJKLMN"
    rows = spark.createDataFrame([(1, secret, f"<{secret}>"), (2, secret, "xx FGHIJK yy"), (3, secret, "FGHIJ"), (4, None, "x"), (5, "short", "short")], "i int, s string, o string")
    got = {r["i"]: (r["leak"], r["ratio"]) for r in sc.leak_ratios(rows, "s", "o").collect()}
    assert got == {1: ("exact", 1.0), 2: ("partial", round(10 / 14, 4)), 3: ("none", 0.0), 4: ("none", 0.0), 5: ("none", 0.0)}
    pieces = {r["i"]: r for r in sc.reconstructed(rows.where("i <= 3").withColumn("o", F.when(F.col("i") == 3, "abcdEF and GHIJKLM").otherwise(F.col("o"))), "s", "o").collect()}
    assert pieces[3]["reconstructed"] and pieces[3]["n_fragments"] == 2 and not pieces[1]["reconstructed"]


@pytest.mark.parametrize("value,name", [("a" * 8 + "-1234" * 3 + "-" + "b" * 12, "UUID"), ("1" * 15, "Numeric token (>=15 digits)"), ("run_" + "a1" * 8, "Prefixed hex ID"), ("plain", None), ("f" * 24, "BSON ObjectId")])
def test_formats(spark, value, name):
    assert one(spark, sc.formats(F.lit(value))) == name


def context(**more):
    base = dict(has_secret=True, used=False, evidence_mode="verbatim", snippet="", start=1, end=1, file_path="", title="", body="", code="", repaired=False, scanner_hit=None, n_familiar=0)
    out = {k: F.lit(v) for k, v in (base | more).items()}
    out["scanner_hit"] = out["scanner_hit"].cast("boolean")
    return out | {"issues": F.array(*(F.lit(i) for i in more["issues"])) if "issues" in more else F.array().cast("array<string>")}


RULES = [
    (dict(snippet="API_KEY = 'your_api_key_here'"), "R1_ambiguous_context"),
    (dict(file_path="tests/test_config.py"), "R1_ambiguous_context"),
    (dict(snippet="API_KEY = 'your_api_key_here'", file_path="src/config/settings.py"), None),
    (dict(snippet="DB_PASS = '1234'"), None),
    (dict(evidence_mode="reconstructed", start=3, end=5, snippet="key = p1 + p2  # example concat", file_path="src/app.py"), "R2_reconstructed_plus_ambiguity"),
    (dict(title="Add dummy api key for testing"), "R4_exculpatory_escalation"),
    (dict(issues=["G2_UNREPORTED: x"]), "R4_exculpatory_escalation"),
    (dict(issues=["G2_EXCULPATORY: x"]), None),
    (dict(repaired=True), "R5_schema_repair"),
    (dict(has_secret=False, code='KEY_ID = "aB3dE5"\nurl = base + "/oauth/x"'), "R6_auth_context_hardcoded"),
    (dict(has_secret=False, code='API_HOST = "aB3dE5"\nurl = base + "/oauth/x"'), None),
    (dict(has_secret=False, n_familiar=1, scanner_hit=True), "R7_g6_format_candidate_pass"),
    (dict(has_secret=False, n_familiar=1), None),
]


@pytest.mark.parametrize("more,name", RULES)
def test_rules(spark, more, name):
    c = context(**more)
    assert one(spark, rv.rule(rv.flags(c), c)) == name


def test_only_pass_is_escalated(spark):
    assert [one(spark, rv.escalated(F.lit(d), F.lit("R5"))) for d in ("PASS", "BLOCK", "REVIEW")] == ["REVIEW", "BLOCK", "REVIEW"]


LINES = 'a = 1\np1 = "sk-x"\np2 = "abc"\nkey = p1 + p2'


@pytest.mark.parametrize(
    "mode,start,end,snippet,issue",
    [
        ("verbatim", 2, 2, 'p1 = "sk-x"', None),
        ("verbatim", 2, 2, "elsewhere", "snippet not on its line"),
        ("verbatim", 2, 3, "p1", "verbatim over several lines"),
        ("verbatim", 2, 2, "sk***", None),
        ("verbatim", 9, 9, "p1", "span out of range"),
        ("multiline", 2, 3, 'p2 = "abc"', None),
        ("reconstructed", 2, 4, "p1 + p2", None),
        ("reconstructed", 2, 3, '"sk-x"', "snippet does not show fragment and assembly"),
        ("none", 1, 1, "x", "no evidence mode"),
        ("other", 1, 1, "x", None),
    ],
)
def test_evidence(spark, mode, start, end, snippet, issue):
    assert one(spark, rv.evidence(F.lit(True), F.lit(mode), F.lit(start), F.lit(end), F.lit(snippet), F.split(F.lit(LINES), "\n"))) == issue


def test_policy_truth_table(spark):
    rows = [(i, s, d, p, g5, t) for i, (s, d, p, g5, t) in enumerate((s, d, p, g5, t) for s in (True, False, None) for d in ("BLOCK", "REVIEW", "PASS") for p in (True, False, None) for g5 in (True, False) for t in ("token", "private_key"))]
    base = spark.createDataFrame(rows, "doc_id long, scanner_hit boolean, guardrail_decision string, pred_has_secret boolean, g5_valid boolean, pred_secret_type string")
    full = base.withColumns({"g3_leak_persisted": F.lit(False), "g4_should_review": F.lit(None).cast("boolean"), "g1_valid": F.lit(None).cast("boolean"), "g2_valid": F.lit(True), "g6_hint_injected": F.lit(False), "file_path": F.lit("src/monkey.py")})
    got = {r["doc_id"]: r for r in po.decisions(full).collect()}
    for i, s, d, p, g5, t in rows:
        s, lb, lr, c = bool(s), d == "BLOCK", d == "REVIEW", t == "private_key"
        score = 2 * s + 2 * lb + lr + 1 + c  # the path holds "key"
        want1 = "REVIEW" if not g5 else "BLOCK" if s or lb else "REVIEW" if lr else "PASS"
        want2 = "REVIEW" if not g5 else "BLOCK" if s and lb else "REVIEW" if s or lb or lr else "PASS"
        want3 = "REVIEW" if not g5 else "BLOCK" if score >= 4 and (s or lb) else "REVIEW" if score >= 2 else "PASS"
        assert (got[i]["p1"], got[i]["p2"], got[i]["p3"], got[i]["score"]) == (want1, want2, want3, score)


def test_veto_needs_an_explicit_no(spark):
    rows = spark.createDataFrame([(1, False), (2, None), (3, True)], "doc_id long, pred_has_secret boolean")
    full = rows.withColumns({"scanner_hit": F.lit(True), "guardrail_decision": F.lit("PASS"), "pred_secret_type": F.lit("none"), "g5_valid": F.lit(True), "g3_leak_persisted": F.lit(False), "g4_should_review": F.lit(False), "g1_valid": F.lit(True), "g2_valid": F.lit(True), "g6_hint_injected": F.lit(False), "file_path": F.lit("src/a.py")})
    assert {r["doc_id"]: r["p2"] for r in po.decisions(full).collect()} == {1: "PASS", 2: "REVIEW", 3: "REVIEW"}


@pytest.mark.parametrize("b,c,p,method", [(0, 0, 1.0, "none"), (1, 0, 1.0, "exact"), (5, 1, 0.21875, "exact"), (10, 9, 1.0, "exact"), (30, 10, 0.0026639, "chi2")])
def test_mcnemar(b, c, p, method):
    _, got, how = si.p_value(b, c)
    assert how == method and got == pytest.approx(p, rel=1e-3)


def test_diffs(spark):
    diff = "+++ b/x.py\n@@ -1,2 +10,3 @@\n a\n+b\n-c\n@@ -9 +30 @@\n+d\n+++ not a line\n--- nor this"
    rows = spark.createDataFrame([(1, diff)], "k long, d string")
    got = [(r["idx"], r["line"], r["text"]) for r in di.target_lines(rows, "k", "d").orderBy("idx").collect()]
    assert got == [(0, 10, "a"), (1, 11, "b"), (2, 30, "d")]
    assert one(spark, di.file_path(F.lit(diff))) == "x.py"
    assert one(spark, di.numbered(F.lit("\n".join("x" * 10)))).split("\n")[0] == "L01: x"


def sample(spark, code, value, kind="token", line=1):
    columns = "doc_id long, sample_id string, gt_has_secret boolean, gt_secret_type string, gt_secret_value string, gt_line_start int, condition string, pr_body string, code_context string"
    return spark.createDataFrame([(1, "REAL_7_x", True, kind, value, line, "B0", None, code)], columns)


def test_perturbations(spark):
    code = '+++ b/a.py\n+    self.x: str = "ab_cdef"\n done'
    inline = ds.split_inline(sample(spark, code, "ab_cdef")).first()
    assert inline["code_context"].split("\n")[1] == '+    self.x: str = "ab_" + "cdef"' and inline["gt_line_start"] == 2 and inline["sample_id"] == "REAL_7_E3-A"
    three = ds.split_lines(sample(spark, code, "ab_cdef")).first()
    assert three["code_context"].split("\n")[1:4] == ['+    p1 = "ab_"', '+    p2 = "cdef"', "+    self.x: str = p1 + p2"] and three["gt_line_start"] == 4
    note = ds.commented(sample(spark, code, "ab_cdef")).first()
    assert note["code_context"].split("\n")[1].startswith("+    # ") and note["gt_line_start"] == 3
    assert ds.framed(sample(spark, code, "ab_cdef")).first()["gt_line_start"] == 2
    assert ds.split_inline(sample(spark, code, "ab_cdef", kind="private_key")).count() == 0
    assert ds.split_inline(sample(spark, 'a = "xyz"', "xyz")).count() == 0
    assert ds.split_inline(sample(spark, 'a = "abcdefgh"', "abcdefgh")).first()["code_context"] == 'a = "abcd" + "efgh"'


def test_repeats(spark):
    assert [one(spark, ds.repeats(F.lit(s))) for s in ("abcdabcdabcd", "abcdefghijkl", "short", "")] == [True, False, False, False]


def test_pipeline_routes(spark):
    rows = [(1, "not json"), (2, json.dumps(SECRET | {"pred_location_start": 1, "pred_location_end": 1, "evidence_snippet": "key"})), (3, json.dumps(NONE))]
    full = spark.createDataFrame(rows, "doc_id long, raw string").withColumns({"code_context": F.lit("key = load()"), "pr_title": F.lit(""), "pr_body": F.lit(None).cast("string"), "gt_file_path": F.lit("src/a.py"), "scanner_hit": F.lit(None).cast("boolean")})
    got = {r["doc_id"]: (r["routed_by"], r["final_decision"]) for r in pipeline.validate(full).collect()}
    assert got == {1: ("G5", "REVIEW"), 2: (None, "BLOCK"), 3: (None, "PASS")}
    off = {r["doc_id"]: (r["routed_by"], r["final_decision"]) for r in pipeline.validate(full, pipeline.Settings.baseline()).collect()}
    assert off[1] == (None, "REVIEW")
