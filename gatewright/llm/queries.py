"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontam, filter_audit, html_text, packing, periodic_runs, quality_rules, quality_zstd, secret_scan, sharding, simhash, tool_calls, toxicity
from .common import table, words_of

SHARDS = 24


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars", "cleaned")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.format_chats(table(spark, sf_dir, "conversations"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(ids, ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_zstd.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` as op12 reads them: where the CRC-32 of the id is divisible by ten, the text's tail repeats."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = docs.select("doc_id", "text", (F.coalesce(crc % 10 == 0, F.lit(False))).alias("planted"), F.floor(crc / 10).alias("g"))
    n = F.size("w").cast("long")
    # without a planted tail the words are not looked at here
    split = planted.withColumn("w", F.when(F.col("planted"), words_of("text"))).withColumn("a", F.when(n > 0, F.col("g") % n))
    period = F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8))
    tailed = split.withColumn("p", period)
    word = lambda _, i: F.when(i < F.col("a"), F.get("w", i)).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return tailed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("w", word), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        F.col("longest.length").alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("longest.length * 1000 div longest.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.round_trip(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_simhash,
        op3_html_text,
        op4_quality_rules,
        op5_toxicity,
        op6_chat_format,
        op7_secret_scan,
        op8_sharding,
        op9_decontamination,
        op10_quality_zstd,
        op11_filter_audit,
        op12_periodic_runs,
        op13_byte_bpe,
    )
}

_OP9 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.n, g.i, p.item_id FROM g JOIN p ON g.n = p.n AND g.g = p.g),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s
  FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
first AS (SELECT x, min(doc_id) AS least FROM t GROUP BY x),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(bad, FALSE) AS bad,
    {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(x),
     'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(t.doc_id > least, FALSE)} AS f
  FROM t JOIN first USING (x) LEFT JOIN said ON said.doc_id = t.doc_id),
f AS (SELECT part, good, bad, list_filter(['A', 'B', 'C', 'D', 'E'], lambda k: CASE k WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails, count(*) AS n FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM l a, l b, l d, l e, l g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
c AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS k,
    sum(CASE WHEN NOT list_has_any(fails, string_split(substr(filter_order, 1, step), '')) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN here THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(fails, substr(filter_order, step, 1)) AND NOT here THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = [substr(filter_order, step, 1)] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN here AND bad THEN n ELSE 0 END) AS toxic_lost
  FROM (
    SELECT f.*, s.*, list_contains(fails, substr(filter_order, step, 1)) AND (step = 1 OR NOT list_has_any(fails, string_split(substr(filter_order, 1, step - 1), ''))) AS here
    FROM f, s)
  GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM c
"""

ORACLE_SQL: dict[str, str] = {"op9_decontamination": _OP9, "op11_filter_audit": _OP11}
