"""The registered queries at the smallest scale: SQL where there is some, the pipeline against its stages."""

import collections
import re
import zlib

import duckdb
import pytest

from gatewright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op1_packing", "op2_simhash", "op4_quality_rules", "op7_secret_scan", "op8_sharding"])
def test_whole_table(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert found.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline(spark):
    """Each stage's decisions, taken over by hand from the operators' own results."""
    import corpus_pipeline
    import numpy as np
    from gatewright.llm import decontam, packing, quality_rules, secret_scan, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = lambda texts: spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    texts = {r["doc_id"]: r["cleaned"] for r in quality_rules.judged(docs).where("kept").collect()}
    kept = {r["component_id"] for r in simhash.near_duplicates(frame(texts)).collect()}
    hit = {r["doc_id"] for r in decontam.contamination(frame(texts), spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
    texts = {i: t for i, t in texts.items() if i in kept - hit}
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(frame(texts)).collect()}
    encode = packing.public_encoder()
    want = {}
    for i, text in texts.items():
        at, out = 0, ""
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        ids = [*encode(out + text[at:]).tolist(), 0]
        want[i] = (len(ids), ids)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(texts) and 0 < len(texts) < docs.count()
    for r in got.itertuples():
        n, ids = want[r.doc_id]
        assert r.doc_tokens == n and zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
    assert got.length.sum() == sum(n for n, _ in want.values())


def test_stages_on_awkward_tables(spark, tmp_path):
    """Every stage on an empty table, and on rows with nulls, repeats and clashing columns."""
    import corpus_pipeline

    long_text = " ".join(f"word{i}" for i in range(30)) + ".\n"
    rows = [(1, long_text, "en", "s", 1, 0.5), (1, long_text, "en", "s", 1, 0.5), (2, None, None, None, None, None), (None, long_text.upper(), "en", "s", 2, 0.1), (3, "", "en", "s", 0, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept_id double")
    for first in (docs, docs.limit(0)):
        stage = first
        for name, f in corpus_pipeline.STAGES:
            last = name == corpus_pipeline.STAGES[-1][0]
            stage = f(spark, stage, SF)
            assert last or stage.columns == docs.columns
        assert (stage.count() > 0) == (first is docs)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_packs_cleaned_texts(spark):
    """A document that loses failed lines is packed without them."""
    import corpus_pipeline
    from gatewright.llm import packing, quality_rules, secret_scan

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in quality_rules.judged(docs).where("kept").collect()}
    plain = {r["doc_id"] for r in secret_scan.scan(docs).where("spans = ''").collect()}
    encode = packing.public_encoder()
    got = {r["doc_id"]: r["doc_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert any(rows[i]["n_failed_lines"] for i in got if i in plain)
    assert {i: n for i, n in got.items() if i in plain} == {i: len(encode(rows[i]["cleaned"])) + 1 for i in got if i in plain}


SPACES = " \t\n\x0b\x0c\r"


def plain_quality(text):
    """Words, failed lines, lost characters, the text left and the verdict, by loops."""
    from gatewright.llm import quality_rules as q

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    size = lambda t: sum(c not in SPACES for c in t)
    left, failed, n_lines, seen, dup = [], 0, 0, set(), 0
    for line in text.split("\n"):
        if not line.strip(SPACES):
            left.append(line)
            continue
        n_lines, dup = n_lines + 1, dup + (line in seen)
        seen.add(line)
        n_words = len(re.split("[\x20\x09-\x0d]+", line.strip(" ")))
        bad = not re.search("[.!?:;…。！？][\"')\\]»”’]*$", line.rstrip(SPACES)[-3:])
        marks = sum(c in "|»«›•" for c in line), sum(c in "#*$%&|<>" for c in line)
        bad |= any(marks) and (marks[0] * 100 >= n_words * 20 or marks[1] * 100 >= size(line) * 8)
        bad |= any(p in line.lower() for p in q.BOILERPLATE)
        failed += bad
        if not bad:
            left.append(line)
    cleaned = "\n".join(left)
    base_failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    lost = size(text) - size(cleaned)
    kept = not base_failed and lost * 100 <= size(text) * 50
    return len(words), size(text), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), n_lines, failed, lost, cleaned, base_failed, kept


def test_op4_against_brute_force(spark):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars", "cleaned", "base_failed", "kept"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.op4_quality_rules(spark, SF).collect()}
    assert got == {i: plain_quality(t) for i, t in texts.items()}
    assert len({g[-1] for g in got.values()}) == 2 and any(g[6] for g in got.values())


def test_op4_limits_and_long_texts(spark):
    from gatewright.llm import quality_rules

    words = lambda n, k=0: " ".join(f"w{k + i}" for i in range(n))
    rows = [words(19) + ".", words(20) + ".", words(70) + ". " + words(30) + ".", words(8) + " " + words(8) + " " + words(37, 50) + ".", words(8) + " " + words(8) + " " + words(38, 50) + ".", "a" * 50 + " " + words(25) + ".\n" + "x" * 10, words(30) + ".\n" + "b" * 300]
    rows += [words(30) + ".\n" + "c " * 44, "| | | | | menu | item |\n" * 5 + words(60) + ".", words(40_000) + ".\n" + words(30_000, 7) + ".", (words(12) + ".\n") * 4000, "\n".join(f"{words(5, i)} end {i}." for i in range(9000)), "", None, "\n\n \n", words(30) + ".  \t", words(30) + '."\')', words(30) + ".'''')"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars", "cleaned", "base_failed", "kept"]
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in quality_rules.judged(df).collect()}
    for i, t in enumerate(rows):
        assert got[i] == plain_quality(t), i
    plan = quality_rules.clean_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Filter transform" not in plan  # a text is judged once


def plain_sample(column, modulus, remainder):
    """The labelled rows that training may read, in the order of Spark's hash of the id."""
    import struct

    import pyarrow.parquet as pq
    from xxhash import xxh64_intdigest

    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r[column] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}

    def order(i):
        h = xxh64_intdigest(struct.pack("<q", i), 42)
        return h - (1 << 64) if h >= 1 << 63 else h

    ids = sorted((i for i in labels if zlib.crc32(str(i).encode()) % modulus != remainder and texts.get(i) is not None and labels[i] is not None), key=order)
    return texts, [texts[i] for i in ids], [labels[i] for i in ids]


@pytest.mark.parametrize("name, column, modulus, remainder", [("op5_toxicity", "toxic", 4, 2), ("op10_quality_zstd", "quality", 5, 0)])
def test_scores_against_a_model_trained_here(spark, name, column, modulus, remainder):
    from gatewright.llm import quality_zstd, toxicity

    texts, known, labels = plain_sample(column, modulus, remainder)
    model = (toxicity if name.startswith("op5") else quality_zstd).train(known, labels)
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i]["score"] == pytest.approx(model.score(t), abs=1e-6)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % modulus == remainder) and got[i]["predicted"] == (got[i]["score"] >= 0.3)
    twice = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    again = twice.unionByName(twice).unionByName(spark.createDataFrame([(10**9, "long " * 200_000, "en", "s", 0), (10**9 + 1, None, "en", "s", 0)], twice.schema))
    scored = (toxicity if name.startswith("op5") else quality_zstd).score(again, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    by = collections.defaultdict(set)
    for r in scored:
        by[r["doc_id"]].add(r["score"])
    assert len(scored) == 12 and all(len(v) == 1 for v in by.values()) and all(0 <= r["score"] <= 1 for r in scored)


def test_training_reads_whole_texts_within_its_bytes(spark):
    from gatewright.llm import toxicity

    docs = spark.createDataFrame([(i, f"{i} " * 1000) for i in range(40)] + [(3, "0"), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(4, None), (None, 1), (50, 1), (1, 0)], "doc_id long, toxic int")
    texts, found = toxicity.labelled_sample(docs, labels, "toxic", 4, 2, 4000, 1 << 20)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(texts) == len(ids) and sorted(texts) == sorted("0" if i == 3 else f"{i} " * 1000 for i in ids)
    few, _ = toxicity.labelled_sample(docs, labels, "toxic", 4, 2, 4000, 10_000)
    assert few == texts[: len(few)] and sum(map(len, few)) <= 10_000 and len(few) >= 3
    assert toxicity.labelled_sample(docs, labels, "toxic", 4, 2, 5, 1 << 20)[0] == [t for t in texts][:5]
