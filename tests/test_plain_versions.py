"""Queries without SQL, row by row against plain versions."""

import ast
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from gatewright import catalog
from gatewright.operators import builders, construction, datasets, scanning, significance
from gatewright.sources import io
from gatewright.sources.adapters import samples

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def exact(b, c):
    """Two-sided p-value: binomial below 25 discordant pairs, else chi-squared with continuity correction."""
    n = b + c
    if n == 0:
        return 1.0
    if n < 25:
        mass = [math.comb(n, k) / 2**n for k in range(n + 1)]
        return min(1.0, sum(m for m in mass if m <= mass[min(b, c)] * (1 + 1e-6)))
    return math.erfc(math.sqrt(max(0, abs(b - c) - 1) ** 2 / n / 2))


def test_mcnemar(spark):
    found = rows(spark, "mcnemar_pvalue")
    assert len(found) == 5
    for r in found:
        assert r["p_value"] == pytest.approx(exact(r["b"], r["c"]), abs=2e-3 if r["b"] + r["c"] < 25 else 1e-6) and r["significant"] == (r["p_value"] < 0.05)
        assert r["statistic"] == pytest.approx((r["b"] - r["c"]) ** 2 / max(1, r["b"] + r["c"]), abs=1e-4)
    for b in range(0, 40):
        for c in range(0, 40, 3):
            assert significance.p_value(b, c)[1] == pytest.approx(exact(b, c), abs=6e-3)  # the factorial is approximated from 20 on
    shown = spark.createDataFrame([(0.0005,), (0.005,), (0.03,), (0.2,)], "p double").select(significance.meaning(F.col("p"))).collect()
    assert [r[0] for r in shown] == ["very strong", "strong", "moderate", "none"]


def test_reconstructed(spark):
    kept = {r["doc_id"]: r for r in samples(spark, SF).collect()}
    for r in rows(spark, "reconstructed_leak"):
        s, k = kept[r["doc_id"]], r["doc_id"] % 5
        secret = s["gt_secret_value"]
        if secret is None:
            assert (r["n_fragments"], r["covered"], r["reconstructed"]) == (0, 0.0, False)
            continue
        output = f"finding in {s['gt_file_path']}: " + (secret if k == 0 else secret[:4] + "***" if k == 1 else ".." + secret[9:21])
        at, parts = 0, []
        while at < len(secret):
            ok = lambda n: secret[at : at + n] in output and not re.search(scanning.MASKED, output[max(0, output.index(secret[at : at + n]) - 5) : output.index(secret[at : at + n]) + n + 5])
            n = next((n for n in range(len(secret) - at, 3, -1) if ok(n)), 0)
            parts += [secret[at : at + n]] if n else []
            at += max(n, 1)
        share = sum(map(len, parts)) / len(secret)
        assert (r["n_fragments"], r["covered"], r["reconstructed"]) == (len(parts), round(share, 4), len(parts) >= 2 and share >= 0.7)


def test_reconstructed_evidence(spark):
    variants = {r["doc_id"]: r for r in datasets.split_lines(samples(spark, SF)).collect()}
    for r in rows(spark, "g1_evidence_reconstructed"):
        v = variants[r["doc_id"]]
        lines, end = v["code_context"].split("\n"), v["gt_line_start"]
        span = lines[end - 3 : end]
        words = [w for w in "p1 = p1 + p2".split() if len(w) > 1]
        hit = [x for x in span if any(w in x for w in words)]
        part = any(re.search("=\\s*[\"'][^\"']*[\"']", x) for x in hit)
        joins = any(re.search("\\w+\\s*\\+\\s*\\w+", x) for x in hit)
        good = (part and joins) or (not part and not joins and len(hit) >= 2)
        assert (r["issue"] is None) == good


def test_syntax_gate(spark):
    want = {}
    for r in samples(spark, SF).collect():
        code = "\n".join(x[1:] if x[:1] in ("+", " ") else x for x in r["code_context"].split("\n") if not re.match("-|@@|diff --git|index |\\+\\+\\+", x))
        try:
            ast.parse(code)
            error = ""
        except SyntaxError as e:
            error = type(e).__name__
        want[error] = want.get(error, 0) + 1
    assert {r["error"]: r["n"] for r in rows(spark, "syntax_gate")} == want


def test_variant_checks(spark):
    base, want = {r["doc_id"]: r for r in samples(spark, SF).collect()}, {}
    for v in datasets.split_lines(samples(spark, SF)).collect():
        before, code = base[v["doc_id"]]["code_context"], v["code_context"]
        issues = [m for m, bad in (("code unchanged", code == before), ("no concatenation", "p1 + p2" not in code), ("secret still whole", v["gt_secret_value"] in code), ("doubled quotes", '""' in code), ("header lost", any(x not in code.split("\n") for x in before.split("\n") if re.match("@@|---|\\+\\+\\+", x.strip())))) if bad]
        for m in issues or [None]:
            want[m] = want.get(m, 0) + 1
    checked = datasets.checked_variants(samples(spark, SF), datasets.split_lines(samples(spark, SF)), "E3-B")
    assert {r["issue"]: r["n"] for r in checked.select(F.explode_outer("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).collect()} == want


def test_selection_is_disjoint_until_it_runs_out(spark):
    df = spark.createDataFrame([(f"s{i}", True, i) for i in range(30)] + [("n", False, 1), ("s1", True, 1)], "sample_id string, gt_has_secret boolean, v int")
    got = datasets.dealt(df, {"a": 10, "b": 15, "c": 8}, {"c": F.col("v") < 6}).collect()
    by = {n: [r["sample_id"] for r in got if r["strategy"] == n] for n in "abc"}
    assert list(map(len, by.values())) == [10, 15, 6] and not set(by["a"]) & set(by["b"]) and set(by["c"]) == {f"s{i}" for i in range(6)}
    assert {r["sample_id"] for r in got if r["reused"]} == set(by["c"]) & (set(by["a"]) | set(by["b"]))
    again = datasets.dealt(df.repartition(7), {"a": 10, "b": 15, "c": 8}, {"c": F.col("v") < 6}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_families_are_dealt_evenly(spark):
    got = construction.dealt_families(spark.range(1000).repartition(5), "id", list("abcdefg")).groupBy("family").count().collect()
    assert sorted(r["count"] for r in got) == [142] + [143] * 6
    templates = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "place long, t string")
    cycled = construction.cycled(spark.range(10), "id", templates, "place").groupBy("t").count().collect()
    assert sorted(r["count"] for r in cycled) == [3, 3, 4]


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"name": "x", "scenarios": [{"id": 1}, {"id": 2}]}')
    assert io.read_document(spark, str(tmp_path / "m.json")).selectExpr("name", "size(scenarios) AS n").first() == ("x", 2)
    assert io.read_document(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "files").mkdir()
    for n in "ab":
        (tmp_path / "files" / f"{n}.py").write_text(f"{n} = 1\n\nprint({n})\n")
    assert {r["path"][-4:]: r["text"] for r in io.read_files(spark, str(tmp_path / "files")).collect()} == {f"{n}.py": f"{n} = 1\n\nprint({n})\n" for n in "ab"}
    pulls = [{"url": "u1", "number": 2, "title": "t"}, {"url": "u1", "number": 1, "title": "s", "files": ["a"]}, {"title": "no url"}, {"url": "u0", "number": 5}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, pulls)) + "\n{broken\n")
    assert sorted((r["url"], r["number"]) for r in io.read_pulls(spark, str(tmp_path / "p.jsonl")).collect()) == [("u0", 5), ("u1", 1)]
    assert io.read_pulls(spark, str(tmp_path / "p.jsonl"), 1).first()["url"] == "u0"
    for v in ("2", "10", "1"):
        io.write_version(spark.range(int(v)), str(tmp_path / "v"), v)
    assert io.versions(spark, str(tmp_path / "v")) == ["1", "2", "10"] and io.read_latest(spark, str(tmp_path / "v")).count() == 10
    assert io.versions(spark, str(tmp_path / "nothing")) == []
    io.write_text(spark, "# naïve\n", str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == "# naïve\n"
    assert len(json.loads(io.document(spark.range(2500)))) == 2500 and io.markdown(spark.range(1500), "T").count("\n") == 1504


def test_ascii_json(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "𝔘 \x01 é\u2028\"\\"), (-2, None)], "doc_id long, text string"))
    for r in docs.select("doc_id", "text", io.ascii_json(F.struct("doc_id", "text")).alias("j")).collect():
        assert r["j"].isascii() and json.loads(r["j"]) == {"doc_id": r["doc_id"], "text": r["text"]}


def test_baseline_annotation(spark):
    """What the stages say of a plain verdict: as the pipeline says, but that a repair is no sign of uncertainty."""
    want = {r["doc_id"]: r for r in rows(spark, "pipeline_routing")}
    got = rows(spark, "baseline_annotation")
    assert len(got) == len(want) and all(r["bfm_executed"] for r in got)
    for r in got:
        fired = (want[r["doc_id"]]["triggered"] or "").split("+")
        assert (r["bfm_g1_valid"], r["bfm_g2_valid"]) == ("G1" not in fired, "G2" not in fired)
        assert r["bfm_g4_should_review"] == (r["bfm_g4_rule"] is not None) and r["bfm_g4_rule"] != "R5_schema_repair"
        if want[r["doc_id"]]["rule"] not in ("R7_g6_format_candidate_pass", "R5_schema_repair"):
            assert r["bfm_g4_rule"] == want[r["doc_id"]]["rule"]


def test_repaired_verdicts_are_no_uncertainty_of_a_plain_reviewer(spark):
    """A verdict whose line is a text is repaired: the pipeline routes it by that, the annotation does not."""
    from gatewright.plans import pipeline

    verdict = {"pred_has_secret": False, "pred_secret_type": "none", "evidence_mode": "none", "pred_location_start": None, "pred_location_end": None, "evidence_snippet": "", "used_untrusted_input": "false", "final_decision": "PASS"}
    verdicts = [verdict, {**verdict, "used_untrusted_input": False}, {**verdict, "pred_has_secret": True, "pred_secret_type": "token", "evidence_mode": "verbatim", "evidence_snippet": "x = 1", "pred_location_start": "2", "pred_location_end": 2, "final_decision": "BLOCK"}]
    df = spark.createDataFrame([(i, json.dumps(v), "@@ -1 +1,2 @@\n a\n+x = 1", "t", "b", "src/a.py", False) for i, v in enumerate(verdicts)], "doc_id int, raw string, code_context string, pr_title string, pr_body string, gt_file_path string, scanner_hit boolean")
    staged = {r["doc_id"]: (r["repair_used"], r["rule"]) for r in pipeline.validate(df).collect()}
    assert staged[0] == (True, "R5_schema_repair") and staged[1] == (False, None) and staged[2][0]
    assert {r["doc_id"]: r["bfm_g4_rule"] for r in pipeline.annotated(df).collect()} == {0: None, 1: None, 2: None}


def test_failing_variants_count_towards_no_target(spark):
    """The next sample in order takes the place of one whose variant breaks its rule."""
    from gatewright.operators import datasets as ds

    code = '@@ -1 +1,2 @@\n import os\n+key = "abcdefgh_ijkl"\n+again = "{}"'
    samples = [(i, f"S_{i}", True, "api_key", "abcdefgh_ijkl", 3, "B0", "title", "body", code.format("abcdefgh_ijkl" if i % 2 else "other")) for i in range(20)]
    df = spark.createDataFrame(samples, "doc_id long, sample_id string, gt_has_secret boolean, gt_secret_type string, gt_secret_value string, gt_line_start int, condition string, pr_title string, pr_body string, code_context string")
    # the secret stands twice in odd samples, so splitting one literal leaves it whole
    assert {r["sample_id"] for r in ds.succeeding(df, "E3-A").collect()} == {f"S_{i}" for i in range(0, 20, 2)}
    assert ds.succeeding(df, "E1-A").count() == ds.succeeding(df, "E2-A").count() == 20
    chosen = ds.generated(df, {"E1-B": 12, "E3-A": 9}).collect()
    mine = [r for r in chosen if r["strategy"] == "E3-A"]
    assert len(mine) == 9 and all(int(r["sample_id"][2:]) % 2 == 0 for r in mine)
    free = {r["sample_id"] for r in chosen if r["strategy"] == "E1-B"}
    assert all(r["reused"] == (r["sample_id"] in free) for r in mine) and any(not r["reused"] for r in mine)
    assert len(ds.generated(df, {"E3-A": 50}).collect()) == 10


def test_scanners_that_fail_leave_the_others(spark):
    from gatewright.operators import scanners as sn

    base = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "doc_id int, f.x string".replace("f.x", "f"))
    finding = lambda rows: spark.createDataFrame(rows, "key int, rule string, secret_type string, line long, match string")
    scans = {"a": finding([(0, "r", "token", 9, "m"), (0, "q", "api_key", 4, "m"), (1, "r", "token", 1, "m")]), "b": finding([(1, "z", "password", 7, "m"), (2, "z", "password", 8, "m")])}
    errors = {"b": spark.createDataFrame([(1, "timeout"), (3, "crash"), (3, "again")], "key int, error string")}
    got = {r["doc_id"]: tuple(r)[2:] for r in sn.evaluated(base, scans, "doc_id", errors).collect()}
    assert got == {
        0: (True, "api_key", 4, None, False, None, None, None, True),
        1: (True, "token", 1, None, False, None, None, "timeout", True),
        2: (False, None, None, None, True, "password", 8, None, True),
        3: (False, None, None, None, False, None, None, "again", False),
        4: (False, None, None, None, False, None, None, None, False),
    }


SHAPES = {
    "stripe": r"(sk|rk)_(live|test)_[A-Za-z0-9]{24}", "github": r"gh[pousr]_[A-Za-z0-9]{36}", "aws_access": r"A[A-Z]{3}[A-Z0-9]{16}", "aws_secret": r"[A-Za-z0-9+/]{40}", "openai": r"sk-(proj-|org-)?[A-Za-z0-9]{48}",
    "slack": r"https://hooks\.slack\.com/services/T[A-Z0-9]{10}/B[A-Z0-9]{10}/[A-Za-z0-9]{24}", "sendgrid": r"SG\.[A-Za-z0-9]{22}\.[A-Za-z0-9]{43}", "twilio_sid": "AC[0-9a-f]{32}", "twilio_auth": "[0-9a-f]{32}", "jwt": "[A-Za-z0-9+/]{32,64}",
    "database_pwd": r"[A-Za-z0-9!@#$%^&*]{16,24}", "connection_string": r"(postgresql|mysql|mongodb)://\w+:[A-Za-z0-9]{16}@[\w.-]+:\d+/\w+", "private_key": r"-----BEGIN RSA PRIVATE KEY-----\n([A-Za-z0-9+/]{64}\n){19,28}[A-Za-z0-9+/]{1,64}\n-----END RSA PRIVATE KEY-----", "firebase": "AIza[A-Za-z0-9]{35}", "docker": "[A-Za-z0-9+/]{48}",
}


def test_generated_secrets(spark):
    assert set(SHAPES) == set(builders.KINDS)
    df = spark.createDataFrame([(k, i) for k in [*SHAPES, "nothing"] for i in range(20)], "k string, i int").repartition(3)
    got = df.select("k", "i", builders.secret(F.col("k"), F.col("i")).alias("s"), builders.type_of(F.col("k")).alias("t")).collect()
    assert all((r["s"] is None and r["t"] is None) if r["k"] == "nothing" else re.fullmatch(SHAPES[r["k"]], r["s"]) for r in got), [r for r in got if r["s"] and not re.fullmatch(SHAPES[r["k"]], r["s"])][:2]
    assert len({r["s"] for r in got}) == 15 * 20 + 1
    again = {(r["k"], r["i"]): r["s"] for r in df.coalesce(1).select("k", "i", builders.secret(F.col("k"), F.col("i")).alias("s")).collect()}
    assert again == {(r["k"], r["i"]): r["s"] for r in got}
