import json

import pytest

from gatewright.operators import confusion
from gatewright.sources import io
from gatewright.sources.adapters import results
from gatewright.streaming import exactly_once, gates

SF = "/root/testdata/sf0.001"


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"sample_id": "REAL_1", "gt_has_secret": True, "extra": 1}, {"sample_id": "REAL_2", "gt_has_secret": False}]))
    (tmp_path / "b.jsonl").write_text('{"sample_id": "X_1"}\n{broken\n{"sample_id": "X_2"}\n')
    rows = io.read_array(spark, str(tmp_path / "a.json"))
    assert rows.count() == 2 and io.positives(rows).count() == 1 and "extra" not in rows.columns
    assert io.read_lines(spark, str(tmp_path / "b.jsonl")).cache().count() == 2
    assert io.read_tolerant(spark, str(tmp_path / "none.json")).count() == 0
    assert [r["sample_id"] for r in io.remaining(rows, rows.limit(1)).collect()] == ["REAL_2"]


def test_writers(spark, tmp_path):
    table = confusion.mode_comparison(results(spark, SF), "alert")
    io.write_csv(table, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns[0] == "mode"
    assert io.markdown(table, "Modes").count("\n") == 7
    assert len(json.loads(io.document(table))) == 3
    io.write_version(table, str(tmp_path / "v"), "1")
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_version(table, str(tmp_path / "v"), "1")
    assert io.report_columns(spark.sql("SELECT 1 AS z, array(1) AS a, 2 AS n")) == ["n", "z"]


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(source))
    stream = gates.windowed_kpis(gates.read_events(spark, str(source)), late="400 days")
    query = stream.writeStream.format("memory").queryName("kpis").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = gates.windowed_kpis(spark.read.parquet(f"{SF}/events.parquet"))
    assert sorted(map(tuple, spark.table("kpis").collect())) == sorted(map(tuple, batch.collect()))


def test_resume(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.limit(10).coalesce(1).write.parquet(source)
    for resume, n_runs in (("auto", 1), ("auto", 1), ("fresh", 2), ("fresh", 3)):
        gates.resumable(gates.read_events(spark, source), out, resume).awaitTermination()
        assert exactly_once.runs(spark, out) == list(range(n_runs))
        assert spark.read.parquet(f"{out}/run={n_runs - 1}/rows").count() == 10
