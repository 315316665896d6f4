"""Paged collection, layouts, snapshots, tolerant scans, quotas, folding and the incomplete gamma function."""

import collections
import hashlib
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from gatewright.functions.gamma import chi_square_tail, log_gamma, upper_gamma
from gatewright.operators import folding, quotas, significance, summary
from gatewright.sources import io, lookup, paged, snapshots
from gatewright.sources.adapters import results

SF = "/root/testdata/sf0.001"

# paged collection


def record(folder, repo, page, numbers, statuses=()):
    at = folder / repo.replace("/", "__")
    at.mkdir(parents=True, exist_ok=True)
    (at / f"{page}.json").write_text(json.dumps([{"number": n, "html_url": f"https://x/{repo}/{n}", "title": f"pull {n}", "body": None, "merged_at": "2024-01-01T00:00:00Z", "diff_url": f"https://x/{n}.diff"} for n in numbers]))
    if statuses:
        (at / f"{page}.statuses").write_text(json.dumps(list(statuses)))


def source(reader, folder, **options):
    given = {"address": str(folder), "repos": "a/b, c/d,e/empty", "per_page": "5", "most_pages": "9", "pages_per_task": "2", "pause": "0.01"} | {k: str(v) for k, v in options.items()}
    return reader.format("paged_pulls").options(**given)


@pytest.fixture
def pages(spark, tmp_path):
    spark.dataSource.register(paged.PagedPulls)
    for page in range(1, 5):
        record(tmp_path, "a/b", page, range(page * 5, page * 5 + 5), (503, 429) if page == 3 else ())
    record(tmp_path, "a/b", 5, [25, 26], (500, 502, 503, 504))
    record(tmp_path, "c/d", 1, [1, 2])
    return tmp_path


def test_paged_pulls_in_a_batch(spark, pages):
    rows = source(spark.read, pages).load()
    assert rows.rdd.getNumPartitions() == 3 * 5
    got = rows.collect()
    assert sorted((r["repo"], r["number"]) for r in got) == [("a/b", n) for n in range(5, 27)] + [("c/d", 1), ("c/d", 2)]
    assert {r["page"]: r["tries"] for r in got if r["repo"] == "a/b"} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    assert all(r["url"] == f"https://x/{r['repo']}/{r['number']}" and r["body"] is None for r in got)


def test_paged_pulls_give_up(spark, pages):
    with pytest.raises(Exception, match="after 4 tries"):
        source(spark.read, pages, tries=4).load().collect()
    record(pages, "c/d", 1, [1], [404])
    with pytest.raises(Exception, match="status 404 after 1 tries"):
        source(spark.read, pages).load().where("repo = 'c/d'").collect()
    with pytest.raises(Exception, match="are needed"):
        spark.read.format("paged_pulls").load().collect()


def test_waits_double(monkeypatch, pages):
    waited = []
    monkeypatch.setattr(paged.time, "sleep", waited.append)
    options = paged.PagedOptions(str(pages), ("a/b",), per_page=5)
    assert paged.pulls(options, "a/b", 5)[1] == 5 and waited == [4, 8, 16, 32]


def test_paged_pulls_as_a_stream(spark, pages):
    """Full pages come once, in one batch or the next; the last, open page waits until it is full."""
    query = source(spark.readStream, pages).load().writeStream.format("memory").queryName("pulls").option("checkpointLocation", str(pages / "at")).start()
    try:
        query.processAllAvailable()
        assert sorted(r["number"] for r in spark.table("pulls").collect()) == list(range(5, 25))
        record(pages, "a/b", 5, range(25, 30))
        record(pages, "c/d", 1, range(1, 6))
        query.processAllAvailable()
        got = sorted((r["repo"], r["number"]) for r in spark.table("pulls").collect())
    finally:
        query.stop()
    assert got == [("a/b", n) for n in range(5, 30)] + [("c/d", n) for n in range(1, 6)]


# look-up by id


def test_lookup_reads_its_buckets_only(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(None, "nameless", "en", "s", 8), (7, "seven again", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long"))
    path = str(tmp_path / "l")
    lookup.write_lookup(docs, path, "doc_id", buckets=8)
    want = collections.Counter((r["doc_id"], r["text"]) for r in docs.where("doc_id in (7, 12, 150)").collect())
    found = lookup.find(spark, path, [7, 12, 150, 7, None, 10**12])
    assert found.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in found.collect()) == want
    one = lookup.find(spark, path, [12])
    bucket = spark.range(1).select(lookup.bucket_of(F.lit(12).cast("long"), 8)).first()[0]
    assert {re.search(r"bucket=(\d+)", f)[1] for f in (r[0] for r in one.select(F.input_file_name()).collect())} == {str(bucket)}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ (?:= {bucket}\)|IN \({bucket}\))", plan) and re.search(r"PushedFilters: \[[^\]]*(?:EqualTo|In)\(doc_id", plan)
    table = lookup.find(spark, path, spark.createDataFrame([(7,), (12,), (150,), (None,), (7,)], "i int"))
    assert collections.Counter((r["doc_id"], r["text"]) for r in table.collect()) == want
    buckets = sorted({r[0] for r in spark.createDataFrame([(7,), (12,), (150,)], "i long").select(lookup.bucket_of(F.col("i"), 8)).collect()})
    listed = re.search(r"PartitionFilters: \[.*?bucket#\d+ IN \(([\d,]+)\)", table._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(int, listed[1].split(","))) == buckets
    assert lookup.find(spark, path, []).count() == 0 and lookup.find(spark, path, [10**12]).count() == 0
    lookup.write_lookup(docs.limit(0), str(tmp_path / "none"), "doc_id")


def test_lookup_files_are_sorted_and_filtered(spark, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "l"
    lookup.write_lookup(spark.range(5000).withColumnRenamed("id", "doc_id"), str(path), "doc_id", buckets=2)
    files = list(path.rglob("*.parquet"))
    whole = [pq.ParquetFile(f).read().column("doc_id").to_pylist() for f in files]
    assert all(ids == sorted(ids) for ids in whole) and sum(map(len, whole)) == 5000
    plain = tmp_path / "p"
    spark.range(5000).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(str(plain))
    size = lambda at: sum(f.stat().st_size for f in at.rglob("*.parquet"))
    assert size(path) > size(plain) + 5000  # a Bloom filter takes more than a byte a distinct value


# snapshots


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "n")], "k long, v string")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    assert snapshots.commit(first, path, "one") == 1
    # a write that dies half-way: rows, but no manifest
    first.limit(2).write.parquet(f"{path}/data/half")
    assert snapshots.latest(spark, path) == 1 and snapshots.read(spark, path).count() == 5
    second = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c"), (None, "m"), (4, "d")], "k long, v string")
    assert snapshots.commit(second, path, "two", after=1) == 2
    with pytest.raises(FileExistsError):
        snapshots.commit(first, path, "made from an old version", after=1)
    assert [(h["version"], h["rows"], h["note"]) for h in snapshots.history(spark, path)] == [(1, 5, "one"), (2, 5, "two")]
    got = snapshots.difference(snapshots.read(spark, path, 1), snapshots.read(spark, path), "k").collect()
    assert {tuple(r) for r in got} == {(2, "changed", 1, 1), (3, "changed", 2, 1), (None, "changed", 1, 1), (4, "added", 0, 1)}
    assert snapshots.difference(first, first.orderBy(F.desc("v")), "k").count() == 0
    assert snapshots.difference(first, first.limit(0), "k").where("change = 'removed'").count() == 4
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path, 3)


# tolerant scans


def test_tolerant_scan(spark, tmp_path):
    files = {
        "array.json": '[{"sample_id": "A", "gt_has_secret": true, "gt_line_start": 3, "more": {"x": 1}}, 5, {"sample_id": "B", "gt_line_start": "many"}, null]',
        "object.json": '{"sample_id": "C"}',
        "broken.json": '[{"sample_id": "D"}, {"sample_id"',
        "empty.json": "",
        "blank.json": " \n",
        "none.json": "[]",
        "scalar.json": '"text"',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = {n: io.read_tolerant(spark, str(tmp_path / n)).collect() for n in files}
    assert {n: len(r) for n, r in rows.items()} == {"array.json": 2, **dict.fromkeys(list(files)[1:], 0)}
    a, b = rows["array.json"]
    assert (a["sample_id"], a["gt_has_secret"], a["gt_line_start"]) == ("A", True, 3) and (b["sample_id"], b["gt_line_start"]) == ("B", None)
    report = {r["path"].rsplit("/", 1)[1]: (r["state"], r["n_rows"], r["n_left_out"]) for r in io.scan_report(spark, str(tmp_path)).collect()}
    want = {"array.json": ("array", 2, 2), "object.json": ("not an array", 0, 0), "broken.json": ("broken", 0, 0), "blank.json": ("empty", 0, 0), "none.json": ("array", 0, 0), "scalar.json": ("not an array", 0, 0)}
    assert report in (want, want | {"empty.json": ("empty", 0, 0)})  # Spark may skip files without a byte
    missing = io.read_tolerant(spark, str(tmp_path / "missing.json"))
    assert missing.count() == 0 and missing.columns == io.SAMPLE_SCHEMA.names
    assert io.scan_report(spark, str(tmp_path / "missing.json")).count() == 0


# quotas


def plain_quota(rows, share):
    """Largest remainders and the first by hash, with everything in memory."""
    by = collections.defaultdict(list)
    for i, s in rows:
        by[s].append(i)
    total, n = len(rows) * share[0] // share[1], len(rows)
    floors = {s: total * len(v) // n for s, v in by.items()}
    order = sorted(by, key=lambda s: (-(total * len(by[s]) % n), -len(by[s]), s is not None, s or ""))
    for s in order[: total - sum(floors.values())]:
        floors[s] += 1
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    return sorted((i, s) for s, v in by.items() for i in sorted(v, key=digest)[: floors[s]])


@pytest.mark.parametrize("share", [(1, 5), (1, 3), (0, 1), (1, 1), (7, 100)])
@pytest.mark.parametrize("digits", [1, 3])
def test_quotas(spark, share, digits, monkeypatch):
    rows = [(i, "hot" if i % 3 else ("x", "y", None)[i // 3 % 3]) for i in range(900)] + [(5000 + i, f"rare{i}") for i in range(7)]
    df = spark.createDataFrame([(i, s, "clash", 1) for i, s in rows], "doc_id long, stratum string, quota string, n int").repartition(5)
    key = lambda x: (x[0], x[1] or "")
    want = sorted(plain_quota(rows, share), key=key)
    got = quotas.by_quota(df.drop("quota", "n"), ["stratum"], "doc_id", share, digits)
    assert sorted(((r["doc_id"], r["stratum"]) for r in got.collect()), key=key) == want
    monkeypatch.setattr(quotas, "SENT_STRATA", 2)
    got = quotas.by_quota(df.drop("quota", "n"), ["stratum"], "doc_id", share, digits)
    assert sorted(((r["doc_id"], r["stratum"]) for r in got.collect()), key=key) == want
    assert quotas.by_quota(df.drop("quota", "n").limit(0), ["stratum"], "doc_id", (1, 2)).count() == 0


# folding


CODE = {
    ('+key = "abc" + "def"', 1): "abcdef",
    ("+key = 'abc' 'def'  # \"note\" + more", 1): "abcdef",
    ('+p1 = "ab"\n+p2 = "cd"\n+self.key = p1 + p2', 3): "abcd",
    ('+p1 = "ab"\n+p1 = p1 + "x"\n key = p1 + "y"', 3): "abxy",
    ('+key = ("ab" +\n+    "cd"\n+    + "ef")', 1): "abcdef",
    ('+key = ("ab" +\n+    "cd")', 2): "abcd",
    ('+key = "ab" + \\\n+   "cd"', 2): "abcd",
    ('+a = "x#y" + "z"', 1): "x#yz",
    ('+key = load("abcdefgh", "ijklmnop")', 1): "abcdefghijklmnop",  # no sum: quoted parts that are long together
    ('+key = load("abc")', 1): "abc",
    ('+key = unknown + "tail"', 1): "tail",
    ("+key = 5", 1): None,
    ("", 1): None,
    ('+key = "a"', 0): None,
    ('+key = "a"', 9): None,
    ('+call(\n+key = "deep"', 2): "deep",
    ('+if x == "a":', 1): "a",
}


def test_folding(spark):
    rows = [(i, c, line) for i, (c, line) in enumerate(CODE)] + [(100, None, 1), (101, "a = 'x'\n" * 300 + "b = a + 'y'", 301)]
    df = spark.createDataFrame(rows, "i int, code string, line int")
    got = {r["i"]: r["s"] for r in df.select("i", folding.secret_of_line(F.col("code"), F.col("line")).alias("s")).collect()}
    for i, (key, want) in enumerate(CODE.items()):
        assert got[i] == want, key
    assert got[100] is None and got[101] == "xy"


# incomplete gamma


def exact_tail(x, df):
    """Closed forms: sums of exponentials for even degrees of freedom, the error function and a recurrence for odd ones."""
    half = x / 2
    if df % 2 == 0:
        return math.fsum(math.exp(-half + k * math.log(half) - math.lgamma(k + 1)) if half > 0 else float(k == 0) for k in range(df // 2))
    out, a = math.erfc(math.sqrt(half)), 0.5
    while a < df / 2:
        out += math.exp(a * math.log(half) - half - math.lgamma(a + 1)) if half > 0 else 0.0
        a += 1
    return out


def test_chi_square_tails(spark):
    cases = [(x, df) for df in (1, 2, 3, 4, 5, 7, 10, 25, 60, 151, 400) for x in (0.0, 1e-6, 0.01, 0.5, 1.0, 2.3, 7.8147, 11.345, 30.0, 58.0, 122.0, 380.0, 600.0, 1400.0)]
    df = spark.createDataFrame([(x, d) for x, d in cases], "x double, df int")
    for r in df.select("x", "df", chi_square_tail(F.col("x"), F.col("df")).alias("p")).collect():
        want = exact_tail(r["x"], r["df"])
        assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-12), (r["x"], r["df"])
    # from printed tables: the 5 % and 1 % points
    table = spark.createDataFrame([(3.841458820694124, 1, 0.05), (7.814727903251179, 3, 0.05), (11.344866730144373, 3, 0.01), (18.307038053275146, 10, 0.05)], "x double, df int, p double")
    assert all(abs(r["q"] - r["p"]) < 1e-9 for r in table.select("p", chi_square_tail(F.col("x"), F.col("df")).alias("q")).collect())


def test_gamma_edges(spark):
    row = spark.range(1).select(
        upper_gamma(F.lit(0.0), F.lit(1.0)).alias("zero"), upper_gamma(F.lit(2.0), F.lit(-1.0)).alias("negative"), upper_gamma(F.lit(2.0), F.lit(None)).alias("null"), upper_gamma(F.lit(3000.0), F.lit(3000.0)).alias("large"), *(log_gamma(F.lit(a)).alias(f"g{i}") for i, a in enumerate((0.5, 1.0, 7.5, 1000.0)))
    ).first()
    assert row["zero"] is None and row["negative"] == 1.0 and row["null"] is None and row["large"] == pytest.approx(0.5, abs=3e-3)
    assert [row[f"g{i}"] for i in range(4)] == pytest.approx([math.lgamma(a) for a in (0.5, 1.0, 7.5, 1000.0)], rel=1e-13, abs=1e-13)


def test_cochran_by_hand(spark):
    rows = results(spark, SF).collect()
    marks = []
    for r in rows:
        said = [bool(r["scanner_hit"]), bool(r["baseline_pred"]), r["guardrail_decision"] == "BLOCK", r["guardrail_decision"] in ("BLOCK", "REVIEW")]
        marks.append([s == bool(r["gt_has_secret"]) for s in said])
    g, lines = [sum(c) for c in zip(*marks)], [sum(m) for m in marks]
    q = 3 * (4 * sum(x * x for x in g) - sum(g) ** 2) / (4 * sum(lines) - sum(x * x for x in lines))
    got = significance.cochran(results(spark, SF)).first()
    assert got["statistic"] == pytest.approx(q, abs=1e-4) and got["p_value"] == pytest.approx(exact_tail(q, 3), abs=1e-6) and got["n"] == len(rows)
    none = significance.cochran(results(spark, SF).limit(0)).first()
    assert (none["n"], none["statistic"], none["p_value"], none["evidence"]) == (0, 0.0, 1.0, "none")


def test_run_summary_is_one_shuffle(spark):
    df = summary.run_summary(results(spark, SF))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Expand") == 1
    rows = df.collect()
    total = next(r for r in rows if r["grouping"] == 7)
    assert total["n"] == results(spark, SF).count()
    for part in (3, 5, 6, 2, 4):
        assert sum(r["n"] for r in rows if r["grouping"] == part) == total["n"]
