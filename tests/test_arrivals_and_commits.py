"""Late left outer joins and exactly-once results, stream against batch."""

import collections
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from gatewright.sources.adapters import responses
from gatewright.streaming import arrivals, exactly_once, gates

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
COLUMNS = ["event_id", "user_id", "ts", "scanner_value", "reviewer_value", "guarded_value", "n_arrived", "waited_seconds", "status"]


def put(spark, folder, rows, n):
    """One file of events; the stream reads one a batch, in the order in which they were put."""
    df = spark.createDataFrame(rows, gates.EVENTS).coalesce(1)
    df.write.mode("append").parquet(folder)


def events_of(spark, folder):
    return spark.readStream.schema(gates.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def event(i, minutes, user, kind):
    return i, T0 + dt.timedelta(minutes=minutes), user, kind, 1.0, "{}"


#: What moves all four watermarks far beyond the rest.
LAST = [event(9000 + i, 60 * 24 * 30, 999, kind) for i, kind in enumerate(["view", "click", "error", "purchase"])]


def streamed(spark, folder, batches, name):
    os.makedirs(folder)
    query = arrivals.event_arrivals(events_of(spark, folder), "60 minutes", "2 hours").select(COLUMNS).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for n, rows in enumerate([*batches, LAST, [event(9100, 60 * 24 * 31, 999, k) for k in ("view", "click", "error", "purchase")], [event(9200, 60 * 24 * 32, 999, k) for k in ("view", "click", "error", "purchase")]]):
            put(spark, folder, rows, n)
            query.processAllAvailable()
    finally:
        query.stop()
    return sorted((tuple(r) for r in spark.table(name).where("event_id < 9000").collect()), key=lambda r: tuple((x is not None, x) for x in r))


def batched(spark, batches):
    rows = [r for b in batches for r in b]
    return sorted((tuple(r) for r in arrivals.event_arrivals(spark.createDataFrame(rows, gates.EVENTS), "60 minutes").select(COLUMNS).collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_late_results_stream_as_in_a_batch(spark, tmp_path, few_partitions):
    """Rows out of order by less than the watermark's delay change nothing."""
    batches = [
        [event(1, 0, 1, "view"), event(2, 5, 2, "view"), event(3, 20, 1, "click"), event(4, 100, 3, "view")],
        # results that are older than what has been seen, by up to two hours
        [event(5, 10, 1, "error"), event(6, 60, 1, "purchase"), event(7, 61, 1, "purchase"), event(8, 30, 2, "error"), event(9, 35, 2, "error"), event(10, 4, 2, "click")],
        [event(11, 110, 3, "click"), event(12, 90, 4, "view"), event(13, 95, 4, "purchase"), event(14, 150, None, "view"), event(15, 151, None, "click")],
    ]
    want = batched(spark, batches)
    got = streamed(spark, str(tmp_path / "in"), batches, "late_ok")
    assert got == want
    by = collections.defaultdict(list)
    for r in want:
        by[r[0]].append(r)
    assert by[1][0][3:] == (3, 5, 6, 3, 3600, "complete") and len(by[1]) == 1  # 61 minutes are too late
    assert [r[4] for r in by[2]] == [8, 9] and by[2][0][3] is None and by[2][0][-1] == "partial"
    assert by[14][0][-1] == "missing"


def test_results_behind_the_watermark_leave_nulls(spark, tmp_path, few_partitions):
    first = [event(1, 0, 1, "view"), event(2, 10, 1, "click")]
    far = [event(20 + i, 60 * 24 * 10, 50, k) for i, k in enumerate(["view", "click", "error", "purchase"])]
    late = [event(3, 20, 1, "error")]
    got = streamed(spark, str(tmp_path / "in"), [first, far, late], "late_gone")
    assert [r for r in got if r[0] == 1] == [(1, 1, T0, 2, None, None, 1, 600, "partial")]
    assert [r for r in batched(spark, [first, far, late]) if r[0] == 1][0][4] == 3


def test_pieces_of_time_lose_and_double_nothing(spark):
    """A key with many rows against a plain nested loop, times on the pieces' edges among them."""
    import random

    rng = random.Random(3)
    rows = [event(i, rng.randrange(0, 1500), rng.choice([1, 1, 1, 2]), rng.choice(["view", "view", "click", "error", "purchase"])) for i in range(300)]
    rows += [event(400 + i, m, 1, k) for i, (m, k) in enumerate([(0, "view"), (60, "click"), (120, "view"), (180, "purchase"), (-60, "view"), (0, "error")])]
    got = batched(spark, [rows])
    want = []
    for v in rows:
        if v[3] != "view":
            continue
        near = {k: [r for r in rows if r[3] == k and r[2] == v[2] and v[1] <= r[1] <= v[1] + dt.timedelta(minutes=60)] or [None] for k in ("click", "error", "purchase")}
        for a in near["click"]:
            for b in near["error"]:
                for c in near["purchase"]:
                    here = [x for x in (a, b, c) if x]
                    waited = int((max(x[1] for x in here) - v[1]).total_seconds()) if here else None
                    want.append((v[0], v[2], v[1], *(x and x[0] for x in (a, b, c)), len(here), waited, "missing" if not here else "complete" if len(here) == 3 else "partial"))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


# exactly once


def verdict_files(spark, folder):
    """Raw verdicts in three files, one a batch."""
    raw = responses(spark, SF).select("doc_id", "raw")
    for k in range(3):
        raw.where(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    return raw


def stream_of(spark, folder):
    return spark.readStream.schema("doc_id long, raw string").option("maxFilesPerTrigger", 1).parquet(folder)


def expected(raw):
    out = {}
    for r in raw.collect():
        try:
            exactly_once.judge_verdicts(__import__("pandas").DataFrame({"raw": [r["raw"]]}))
            out[r["doc_id"]] = None
        except Exception as e:
            out[r["doc_id"]] = type(e).__name__
    return out


def check(spark, out, want, run=None):
    results = [r["doc_id"] for r in exactly_once.read_committed(spark, out, "results", run).collect()]
    errors = {r["doc_id"]: r["error"] for r in exactly_once.read_committed(spark, out, "errors", run).collect()}
    assert sorted(results) == sorted(i for i, e in want.items() if e is None)
    assert errors == {i: e for i, e in want.items() if e}
    n = exactly_once.commits(spark, out, run).agg(F.sum("n"), F.sum("n_errors")).first()
    assert tuple(n) == (len(want), len(errors))


class Killed(Exception):
    pass


def test_batches_killed_between_write_and_commit(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = expected(verdict_files(spark, source))
    assert {"JSONDecodeError", "KeyError", "TypeError", "ValueError"} <= set(want.values())

    def kill(batch):
        if batch == 1:
            raise Killed(str(batch))

    query = exactly_once.start(stream_of(spark, source), exactly_once.judge_verdicts, exactly_once.VERDICT, out, before_commit=kill)
    with pytest.raises(Exception, match="Killed"):
        query.awaitTermination()
    run = f"{out}/run=0"
    assert exactly_once.committed(spark, run) == [0]
    # the killed batch has written its rows, but no reader sees them
    assert spark.read.parquet(f"{run}/results/batch=1").count() > 0
    seen = exactly_once.read_committed(spark, out, "results")
    assert {r["batch"] for r in seen.select("batch").distinct().collect()} == {0}
    exactly_once.start(stream_of(spark, source), exactly_once.judge_verdicts, exactly_once.VERDICT, out).awaitTermination()
    assert exactly_once.committed(spark, run) == [0, 1, 2] and exactly_once.runs(spark, out) == [0]
    check(spark, out, want)


def test_batches_killed_after_the_commit(spark, tmp_path):
    """Spark did not learn that the batch was done and runs it again: it is not written twice."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = expected(verdict_files(spark, source))
    exactly_once.start(stream_of(spark, source), exactly_once.judge_verdicts, exactly_once.VERDICT, out).awaitTermination()
    for f in (tmp_path / "out/run=0/checkpoint/commits").iterdir():
        if f.name.strip(".").startswith("2"):
            f.unlink()
    written = sorted((tmp_path / "out/run=0/results/batch=2").iterdir())
    exactly_once.start(stream_of(spark, source), exactly_once.judge_verdicts, exactly_once.VERDICT, out).awaitTermination()
    assert sorted((tmp_path / "out/run=0/results/batch=2").iterdir()) == written
    check(spark, out, want)


def test_fresh_runs_leave_the_former(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = expected(verdict_files(spark, source))
    for resume in ("auto", "fresh", "fresh"):
        exactly_once.start(stream_of(spark, source), exactly_once.judge_verdicts, exactly_once.VERDICT, out, resume).awaitTermination()
    assert exactly_once.runs(spark, out) == [0, 1, 2]
    for run in range(3):
        check(spark, out, want, run)
    with pytest.raises(ValueError):
        exactly_once.run_folder(spark, out, "ask")


def test_poison_rows_alone_fail(spark):
    """Halving finds each failing row; columns of all types pass through; empty tables give nothing."""
    calls = []

    def judge(part):
        if (part["x"] % 37 == 5).any():
            raise ArithmeticError("bad")
        return part.assign(y=part["x"] * 2)[["y"]]

    added = exactly_once.T.StructType([exactly_once.T.StructField("y", exactly_once.T.LongType())])
    rows = spark.range(500).selectExpr("id x", "array(id) a", "CASE WHEN id % 2 = 0 THEN 'even' END s").coalesce(1)
    got = exactly_once.with_errors(rows, judge, added).collect()
    assert len(got) == 500 and not calls
    assert all((r["error"] == "ArithmeticError" and r["y"] is None) if r["x"] % 37 == 5 else (r["error"] is None and r["y"] == 2 * r["x"]) for r in got)
    assert exactly_once.with_errors(rows.limit(0), judge, added).count() == 0
    wrong = exactly_once.with_errors(rows.limit(3), lambda p: p.head(0).assign(y=[]), added).collect()
    assert {r["error"] for r in wrong} == {"ValueError"}


def test_a_commit_is_put_in_place_once(spark, tmp_path):
    from gatewright.sources import io

    io.write_once(spark, "one", f"{tmp_path}/c/0.json")
    with pytest.raises(FileExistsError):
        io.write_once(spark, "two", f"{tmp_path}/c/0.json")
    assert io.list_names(spark, f"{tmp_path}/c") == ["0.json"] or sorted(n for n in io.list_names(spark, f"{tmp_path}/c") if not n.endswith(".crc")) == ["0.json"]
    assert (tmp_path / "c/0.json").read_text() == "one" and json.dumps(1)
