"""Detail records, evidence over several lines and lenient parsing, by hand."""

import json

import pytest
from pyspark.sql import functions as F

from gatewright.functions.jsons import strict_json
from gatewright.operators import details, review, verdicts

OK = {"pred_has_secret": True, "pred_secret_type": "token", "evidence_mode": "verbatim", "pred_location_start": 2, "pred_location_end": 2, "evidence_snippet": 'token = "abcdef"', "used_untrusted_input": False, "final_decision": "BLOCK"}
CODE = '@@ -1 +1,3 @@\n+token = "abcdef"\n+other = part_one + part_two\n done()'
CASES = {
    "fine": ({}, {}),
    "bare": ({"pred_location_start": None, "pred_location_end": None, "evidence_snippet": " ", "evidence_mode": "none"}, {}),
    "short": ({"evidence_snippet": "token"}, {}),
    "elsewhere": ({"pred_location_start": 4, "pred_location_end": 4}, {}),
    "far": ({"pred_location_start": 9, "pred_location_end": 9}, {}),
    "excused": ({"used_untrusted_input": True, "untrusted_effect": "Exculpatory_Claim", "untrusted_input_role": "pr_title", "decision_basis": "CODE_only", "final_decision": "PASS"}, {}),
    "unreported": ({"pred_has_secret": False, "pred_secret_type": "none", "evidence_mode": "none", "pred_location_start": None, "pred_location_end": None, "evidence_snippet": "", "final_decision": "PASS"}, {"pr_body": "This token is a dummy key for testing."}),
    "extra": ({"reasoning": "x"}, {}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(n, json.dumps({**OK, **change}), CODE, request.get("pr_title", "title"), request.get("pr_body", "body")) for n, (change, request) in CASES.items()]
    rows += [("text", "no verdict", CODE, "t", "b"), ("list", "[1]", CODE, "t", "b"), ("null", None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, raw string, code_context string, pr_title string, pr_body string")
    return {r["name"]: r for r in details.detailed(df).collect()}


def test_schema_details(found):
    s = {n: r["schema_detail"] for n, r in found.items()}
    assert s["text"] is s["list"] is s["null"] is None
    assert (s["fine"]["is_valid"], s["fine"]["field_count"], s["fine"]["has_evidence"], s["fine"]["has_location"]) == (True, 8, True, True)
    assert (s["bare"]["is_valid"], s["bare"]["has_evidence"], s["bare"]["has_location"]) == (False, False, False)
    assert s["extra"]["field_count"] == 9 and s["extra"]["violations"] == ["SCHEMA_VIOLATION: unknown reasoning"]


def test_influence_details(found):
    g = {n: r["influence_detail"] for n, r in found.items()}
    assert g["fine"]["is_valid"] and g["fine"]["violations"] == g["fine"]["warnings"] == [] and g["fine"]["untrusted_effect"] == "none"
    e = g["excused"]
    assert (e["is_valid"], e["violations"], e["warnings"], e["used_untrusted_input"], e["untrusted_effect"], e["decision_basis"]) == (False, ["G2_EXCULPATORY: claim excuses the finding"], [], True, "exculpatory_claim", "code_only")
    u = g["unreported"]
    assert u["is_valid"] and u["violations"] == [] and len(u["warnings"]) == 1 and u["warnings"][0].startswith("G2_UNREPORTED")


def test_evidence_details(found):
    e = {n: r["evidence_detail"] for n, r in found.items()}
    assert e["fine"]["is_valid"] and e["fine"]["warnings"] == [] and e["fine"]["evidence_mode"] == "verbatim"
    assert e["bare"]["violations"] == ["no evidence mode for a secret", "no first line for a secret", "no last line for a secret", "no snippet for a secret"]
    assert e["short"]["warnings"] == ["snippet is short"] and e["short"]["is_valid"]
    assert e["elsewhere"]["violations"] == ["snippet not on its line"] and e["far"]["violations"] == ["span out of range"]
    assert e["unreported"]["is_valid"] and not e["unreported"]["has_location"]


def test_evidence_over_several_lines(spark):
    cases = [(2, 3, "multiline", "token part_one", None), (2, 2, "multiline", "nowhere_at_all", "snippet not in its span"), (3, 2, "multiline", "token", "span out of range"), (2, 3, "reconstructed", "token part_one part_two", None), (4, 4, "reconstructed", "nowhere_at_all", "snippet does not show fragment and assembly")]
    df = spark.createDataFrame([(*c, CODE) for c in cases], "a int, b int, mode string, snippet string, want string, code string")
    for r in df.select("*", review.evidence(F.lit(True), F.col("mode"), F.col("a"), F.col("b"), F.col("snippet"), F.split("code", "\n")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_lenient_parsing_takes_the_outermost_braces(spark):
    texts = ['{"a": 1}', 'so: {"a": {"b": 2}} I think', '```json\n{"a": 3}\n```', "no braces", "{broken", 'x {"a": 4} y {b}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    got = {r["i"]: r["v"] for r in df.select("i", F.to_json(verdicts.lenient(F.col("raw"))).alias("v")).collect()}
    assert got == {0: '{"a":1}', 1: '{"a":{"b":2}}', 2: '{"a":3}', 3: None, 4: None, 5: None, 6: None}
    strict = {r["i"]: r["v"] for r in df.select("i", F.to_json(verdicts.parsed(F.col("raw"))).alias("v")).collect()}
    assert strict[1] is None and strict[2] == '{"a":3}'


def test_strict_json_takes_whole_texts_only(spark):
    whole = ["1", ' {"a": [1, 2]} \n', '"x"', "[]", "null", "-2.5e3"]
    broken = ["", " ", '{"a": 1} y', '{"a": 1}]', '{"a": 1}}', '{"a": 1}, {"b": 2}', '{"a": 1}, "b": 2', "1 2", '{"a": 1}] [', '{"a": 1}} {', '{"a": 1', "[1", "x"]
    df = spark.createDataFrame([(t,) for t in [*whole, *broken, None]], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", strict_json(F.col("t")).isNotNull().alias("v")).collect()}
    assert got == {**dict.fromkeys(whole, True), **dict.fromkeys(broken, False), None: False}
    for t in [*whole, *broken]:
        try:
            json.loads(t)
            assert t in whole
        except ValueError:
            assert t in broken


def test_constants_in_code_that_authenticates(spark):
    """A constant that may be a credential counts only beside an authenticated path, and not by a harmless name or value."""
    path = 'L1: +post("/auth/login", h)\n'
    cases = [
        (path + 'L2: +SESSION_KEY = "Ab12Cd34"', True),
        ('L2: +SESSION_KEY = "Ab12Cd34"', False),
        (path + 'L2: +API_HOST = "Ab12Cd34"', False),
        (path + 'L2: +SESSION_KEY = "https://Ab12"', False),
        (path + 'L2: +SESSION_KEY = "abcdefgh"', False),
        (path + 'L2: +SESSION_KEY = "Ab.Cdefgh"', False),
        (path + 'L2: +session_key = "Ab12Cd34"', False),
    ]
    df = spark.createDataFrame([(i, c, w) for i, (c, w) in enumerate(cases)], "i int, code string, want boolean")
    none = F.lit(None).cast("string")
    context = {n: none for n in ("evidence_mode", "snippet", "file_path", "title", "body", "start", "end")} | {"has_secret": F.lit(False), "used": F.lit(False), "repaired": F.lit(False), "scanner_hit": F.lit(False), "n_familiar": F.lit(0), "issues": F.array().cast("array<string>"), "code": F.col("code")}
    for r in df.select("*", review.hardcoded_constant(F.col("code")).alias("got"), review.flags(context).alias("flags")).collect():
        assert r["got"] == r["want"] and ("auth_context_hardcoded_value" in r["flags"]) == r["want"], r


def test_report(spark, tmp_path):
    from gatewright.operators import summary
    from gatewright.sources import io
    from gatewright.sources.adapters import results

    tables = {"Summary": summary.run_summary(results(spark, "/root/testdata/sf0.001")), "Numbers": spark.range(3)}
    text = io.report("Run", tables)
    assert text.startswith("# Run\n\n1. Summary (") and text.count("\n## ") == 2 and text.index("## Summary") < text.index("## Numbers")
    io.write_text(spark, text, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text().endswith("| 2 |\n")
    with pytest.raises(ValueError):
        io.report("Run", {"Numbers": spark.range(11)}, 10)
