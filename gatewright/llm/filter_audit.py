"""How document filters interact: what each removes in every order, alone, or in vain.

Five filters are judged on every document: few words (A), few distinct words (B), many
capitals (C), a symbol (D), and a text that a smaller id has, too (E). A document is the
mask of the filters that it fails; all counts follow from how many documents of a part have
each mask, so the documents are read once, however many orders there are.

Copies are found by an RDD that is routed by fingerprint. A task first settles the copies
among its own documents, a block of bounded bytes at a time: what is not the least id of its
text there is settled, and one document a text goes on, compressed. It is sent by the
XXH64 of its text to a partition that keeps, for each fingerprint, a chain of the full texts
with their least id; whatever is displaced, or comes too late, is not the least. A group of
copies of any size sends one text a block, and texts whose fingerprints collide stay apart.
``combineByKey`` then adds up the vectors of mask counts of each part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)


@dataclass(frozen=True)
class AuditOptions:
    #: A: fewer words fail.
    least_words: int = 200
    #: B: a smaller share of distinct words, in per cent, fails.
    least_distinct: int = 50
    #: C: a larger share of capitals A-Z among the characters, in per cent, fails.
    most_capitals: int = 2
    #: D: any of these fails.
    symbols: str = "#$%&*|"
    #: Bytes of texts that a task settles among themselves before it sends one of each.
    block_bytes: int = 32 << 20
    #: Bytes of texts, before they are compressed, that one partition keeps in chains, about.
    task_bytes: int = 64 << 20


_CAPITALS = bytes(range(65, 91))
Document = tuple  # (doc_id, part, mask)


def text_mask(text: str, options: AuditOptions) -> int:
    """The mask of the four filters that the text alone decides."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    failed = (
        len(words) < options.least_words,
        100 * len(set(words)) < options.least_distinct * len(words),
        100 * capitals > options.most_capitals * len(text),
        any(s in text for s in options.symbols),
    )
    return sum(f << i for i, f in enumerate(failed))


class Chains:
    """Full texts by fingerprint, each with its least id and the documents that have it."""

    def __init__(self) -> None:
        #: By fingerprint: [text, least id, documents of that id] of each text.
        self.by_print: dict[int, list[list]] = {}

    def add(self, fingerprint: int, text: bytes, documents: list[Document]) -> list[Document]:
        """Takes documents of one text and one id; returns those that are now known not to be the least."""
        chain = self.by_print.setdefault(fingerprint, [])
        entry = next((e for e in chain if e[0] == text), None)
        doc_id = documents[0][0]
        if entry is None:
            chain.append([text, doc_id, documents])
        elif doc_id == entry[1]:
            entry[2] = _counted([*entry[2], *documents])
        elif doc_id < entry[1]:
            late, entry[1], entry[2] = entry[2], doc_id, documents
            return late
        else:
            return documents
        return []

    def texts(self) -> Iterator[tuple[int, bytes, list[Document]]]:
        for fingerprint, chain in self.by_print.items():
            for text, _, documents in chain:
                yield fingerprint, text, documents


def _counted(documents: list[tuple]) -> list[tuple]:
    """Documents (id, part, mask, n) with equal ones added up, so that rows that repeat stay few."""
    out: dict[tuple, int] = {}
    for *key, n in documents:
        out[tuple(key)] = out.get(tuple(key), 0) + n
    return [(*key, n) for key, n in out.items()]


def _late(documents: list[tuple]) -> Iterator[tuple]:
    return ((doc_id, part, mask | COPY, n) for doc_id, part, mask, n in documents)


def masked(docs: DataFrame, options: AuditOptions = AuditOptions()) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of ``docs`` (doc_id, text, source) have an id, a source and a mask.

    Only rows that agree in all three are counted together, in one row or several, so with
    distinct ids there is one row a document and n is 1. The filters that a document fails
    are the bits of its mask, A the lowest. Null
    text is empty, null source is the empty string. A null id has no smaller one and is no
    smaller than any: it never fails E and makes no other fail it. Rows of one id and text
    are not copies of each other.
    """

    def settled(rows: Iterator[Row]) -> Iterator[tuple]:
        """(route, (text or null, documents)); documents without a text are settled."""
        from xxhash import xxh64_intdigest
        from zstandard import ZstdCompressor

        small = ZstdCompressor(level=1).compress
        own, held = Chains(), 0
        nameless: dict[tuple[str, int], int] = {}

        def sent() -> Iterator[tuple]:
            for fingerprint, text, documents in own.texts():
                yield fingerprint, (small(text), documents)

        for row in rows:
            doc_id, part, text = row[0], row[1], row[2]
            mask = text_mask(text, options)
            if doc_id is None:
                nameless[part, mask] = nameless.get((part, mask), 0) + 1
                continue
            data = text.encode("utf-8", "surrogatepass")
            late = own.add(xxh64_intdigest(data), data, [(doc_id, part, mask, 1)])
            if late:
                yield doc_id, (None, list(_late(late)))
            else:
                held += len(data)
            if held >= options.block_bytes:
                yield from sent()
                own, held = Chains(), 0
        yield from sent()
        yield 0, (None, [(None, part, mask, n) for (part, mask), n in nameless.items()])

    def routed(rows: Iterator[tuple]) -> Iterator[tuple]:
        from zstandard import ZstdDecompressor

        full = ZstdDecompressor().decompress
        chains = Chains()
        for route, (text, documents) in rows:
            if text is None:
                yield from documents
                continue
            entries = chains.by_print.get(route)
            if entries and all(e[0] != text for e in entries):
                # equal texts may be compressed to different bytes by other versions of the library
                plain = full(text)
                text = next((e[0] for e in entries if full(e[0]) == plain), text)
            yield from _late(chains.add(route, text, documents))
        for _, _, documents in chains.texts():
            yield from documents

    chosen = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).rdd
    # the bytes of all texts decide on how many partitions keep them, so a partition's chains stay as small at any size
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    tasks = max(-(-size // options.task_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows: RDD = chosen.mapPartitions(settled).partitionBy(tasks, lambda route: route & 0x7FFFFFFFFFFFFFFF).mapPartitions(routed)
    return docs.sparkSession.createDataFrame(rows, "doc_id long, part string, mask int, n long", verifySchema=False)


def non_minimum_ids(docs: DataFrame, options: AuditOptions = AuditOptions()) -> DataFrame:
    """(doc_id, n) of the rows whose text a smaller id has, too."""
    return masked(docs, options).where(F.col("mask").bitwiseAND(COPY) > 0).groupBy("doc_id").agg(F.sum("n").alias("n"))


def mask_vectors(docs: DataFrame, labels: DataFrame, options: AuditOptions = AuditOptions()) -> RDD:
    """(part, counts): documents, good ones and toxic ones of a part by mask, three rows of 32 numbers.

    A document is good or toxic if any row of ``labels`` (doc_id, quality, toxic) for its id says so.
    """
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    said = said.where("doc_id is not null and (good or bad)").groupBy("doc_id").agg(F.bool_or(F.coalesce("good", F.lit(False))).alias("good"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("bad"))
    joined = masked(docs, options).join(said, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)), F.coalesce("bad", F.lit(False)), "n")

    def add(counts: np.ndarray, seen: tuple) -> np.ndarray:
        mask, good, bad, n = seen
        counts[:, mask] += (n, n * good, n * bad)
        return counts

    pairs = joined.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4])))
    return pairs.combineByKey(lambda seen: add(np.zeros((3, MASKS), dtype=np.int64), seen), add, lambda a, b: a + b)


def order_rows(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of one part: each order of the filters, each step of it."""
    total, good, bad = counts.tolist()
    left = [sum(total[m] for m in range(MASKS) if not m & gone) for gone in range(MASKS)]  # kept by the filters of a set
    good_left = [sum(good[m] for m in range(MASKS) if not m & gone) for gone in range(MASKS)]
    bad_left = [sum(bad[m] for m in range(MASKS) if not m & gone) for gone in range(MASKS)]
    fails = [sum(total[m] for m in range(MASKS) if m >> i & 1) for i in range(len(FILTERS))]
    rows, shapley = [], [0] * len(FILTERS)
    for order in itertools.permutations(range(len(FILTERS))):
        name, gone = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now = gone | 1 << i
            removed = left[gone] - left[now]
            shapley[i] += removed
            rows.append((name, step, i, left[now], removed, fails[i] - removed, total[1 << i], good_left[gone] - good_left[now], bad_left[gone] - bad_left[now]))
            gone = now
    for name, step, i, *numbers in rows:
        yield (part, name, step, *numbers, shapley[i])


_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, options: AuditOptions = AuditOptions()) -> DataFrame:
    """One row for every part of ``docs`` (doc_id, text, source), order of the filters and step.

    A part is a source, null as the empty string. ``kept`` counts its documents after the
    step, ``removed`` those that the step's filter takes, ``redundant`` those that fail it but
    are gone already, ``unique_fails`` those that fail no other; ``good_lost`` and
    ``toxic_lost`` are the removed ones that ``labels`` (doc_id, quality, toxic) call so, and
    ``shapley`` is what the filter removes summed over all orders. Rows that repeat count as
    often as they occur. An empty table gives no rows; without labels nothing is lost. Other
    columns are not read. ``masked`` says how nulls are judged.
    """
    vectors = mask_vectors(docs, labels, options)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: order_rows(*kv)), _AUDIT, verifySchema=False)
