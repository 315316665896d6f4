"""Queries over samples against their SQL, on documents whose own lines hold assignments, comments and hundreds of lines."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gatewright import catalog
from gatewright.operators import construction as cs
from gatewright.operators import diffs as di
from gatewright.operators import folding, review
from gatewright.operators import scanning as sc

LONG = "\n".join(f"line {i}" for i in range(150))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    texts = ["plain", LONG, 'token = "0123456789abcdef" in prose\n' * 6, 'en### token = "ab12" mail@example.com### x', "# a dummy key\n" * 5, LONG + '\napi_key = "0123456789abcdef"\n# not a real key']
    rows = [(i, texts[i // 6 % len(texts)] + ("" if i % 7 else "\n\n"), "en", "src", i % 50) for i in range(720)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def same_rows(spark, folder, name):
    got = catalog.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]}) AS q").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_code_too_deep_for_the_parser(spark):
    deep = ["+" + "(" * n for n in (50, 150, 5000)] + ["+" + "-" * 200_000 + "1", "+x = 1" + " + 1" * 100_000, "+x = 1", "+x = ="]
    rows = spark.createDataFrame(list(enumerate(deep)), "doc_id long, diff string")
    got = {r["doc_id"]: r["error"] for r in cs.syntax_errors(rows, "doc_id", "diff").collect()}
    assert len(got) == len(deep) and got[5] == "" and got[6] == "SyntaxError"
    assert got[3] == "MemoryError" and got[4] == "RecursionError"


def test_evidence_of_diffs_with_over_99_lines(spark, folder):
    same_rows(spark, folder, "g1_evidence")


@pytest.mark.parametrize("name", ["g4_flags", "g4_rule_first_match"])
def test_comments_in_the_documents_own_lines(spark, folder, name):
    same_rows(spark, folder, name)


def test_first_hunk(spark):
    diffs = ["+++ b/a\n@@ -1 +1 @@\n+x\n@@ -9 +9 @@\n+y", "@@ -1 +1 @@\n+x\n@@ -9 +9 @@\n+y", "+++ b/a\n+x", ""]
    rows = spark.createDataFrame(list(enumerate(diffs)), "i long, diff string")
    got = {r["i"]: r["h"] for r in rows.select("i", di.first_hunk(F.col("diff")).alias("h")).collect()}
    assert got == {0: "+++ b/a\n@@ -1 +1 @@\n+x", 1: "@@ -1 +1 @@\n+x", 2: "+++ b/a\n+x", 3: ""}


@pytest.mark.parametrize("name", ["injection_points", "inject_secret"])
def test_assignments_in_the_documents_own_lines(spark, folder, name):
    same_rows(spark, folder, name)


def test_injection_points_of_all_hunks(spark):
    diff = '@@ -1 +7,2 @@\n+value = "first one"\n@@ -90 +90,2 @@\n x\n+api_key = "second one"'
    rows = spark.createDataFrame([(1, diff)], "doc_id long, diff string")
    found = lambda hunk: tuple(cs.injection_points(rows, "doc_id", "diff", hunk).first())
    assert found(None) == found(2) == (1, 91, "api_key", "second one")
    assert found(1) == (1, 7, "value", "first one")


def test_statements_until_a_line(spark):
    code = ["a = 1\nb = (2,\n 3)\nc = 4", "a = 1 + \\\n 2\n(\n" + "x\n" * 60 + ")", "", "a\nb\nc\nd"]
    rows = spark.createDataFrame([(c, n) for c in code for n in range(6)], "code string, n int")
    whole = F.filter(folding.logical_lines(F.col("code")), lambda s: s["first"] <= F.col("n"))
    assert rows.where(~whole.eqNullSafe(folding.logical_lines(F.col("code"), F.col("n")))).count() == 0


def test_folding_takes_code_apart_once(spark, folder):
    plan = catalog.QUERIES["folded_secrets"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"^[+\- ]") == 1
    assert plan.count("@@ -90,") == 2  # the document's own lines: once for the one-line variants, once for the others
    same_rows(spark, folder, "folded_secrets")


def test_numbering_splits_a_text_once(spark):
    rows = spark.createDataFrame([("a\n" * 99 + "b",), ("",), (None,)], "code string")
    got = rows.select(di.numbered(F.col("code")).alias("n"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    texts = [r["n"] for r in got.collect()]
    assert texts[0].startswith("L001: a\nL002: a\n") and texts[0].endswith("\nL100: b") and texts[1:] == ["L1: ", None]


def test_signs_before_searches(spark):
    code = ["x = 1", "# dummy key", "a // fake token", "/* safe */", "Authorization: x", "aUTHORIZATION", "get('/token')", "/x", "", "#", "b /* no */ # a test key for testing"]
    rows = spark.createDataFrame([(c,) for c in code], "code string")
    c = F.col("code")
    comments = F.regexp_extract_all(c, F.lit(r"(?m)(?:#|//)\s*(.+?)$"), F.lit(1))
    claimed = F.exists(comments, lambda x: sc.any_of(F.lower(x), review.CLAIMS) & sc.any_of(F.lower(x), review.SECRET_WORDS))
    same = (review.comment_claims(c) == claimed) & (review.decoy(c) == c.rlike(review.DECOY)) & (review.authenticates(c) == c.rlike(review.AUTH_PATH))
    assert rows.where(~same | same.isNull()).count() == 0
