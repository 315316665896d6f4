"""Benchmark decontamination by one Aho-Corasick automaton over normalised windows.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. An
item's windows of ten consecutive words (a shorter item: all its words) are the
patterns of one automaton. Every word of the benchmark is spelled by two characters of its
own, all other words by two that are in no pattern, so a node has few children (about the
root of the number of words) and a window few nodes. A text is scanned once; every
occurrence of a window comes with its end, from which the hit words and their offsets in
the original text follow.

The benchmark is sent to the executors, and each Python worker builds the
automaton once and keeps it for its later tasks. Its memory grows with the benchmark
(about 2 KB a window), never with the documents; ``most_bytes`` bounds it. A benchmark
beyond that is dealt by hash into parts below it, each with an automaton of its own, and
the documents go through the parts one after the other, with the same results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 10
#: Bytes of benchmark text that one automaton may be made of; some 2.5 GB in a worker at the bound, 0.15 GB for 1 MB.
MOST_BYTES = 16 << 20
#: A-Z to lower case, other ASCII characters that are not alphanumeric to a space; other bytes stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Rows that are scanned together.
ROWS = 1000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


class Scanner:
    """The automaton over the windows of ``items``, pairs of an id and a text."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        import ahocorasick

        texts = [(item, normal_words(text)) for item, text in items]
        names = sorted({w for _, words in texts for w in words})
        side = max(1, math.isqrt(max(0, len(names) - 1)) + 1)
        # first and second characters are of different ranges, so an occurrence starts where a word does
        self.spelled = {w: chr(1 + i // side) + chr(1 + side + i % side) for i, w in enumerate(names)}
        self.automaton = ahocorasick.Automaton()
        windows: dict[str, set] = {}
        for item, words in texts:
            n = min(WINDOW, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                windows.setdefault("".join(map(self.spelled.__getitem__, words[i : i + n])), set()).add(item)
        for window, ids in windows.items():
            self.automaton.add_word(window, (len(window) // 2, frozenset(ids)))
        self.n_windows = len(windows)
        if windows:
            self.automaton.make_automaton()

    def found(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(second character of the last word, (words, item ids)) of each occurrence of a window."""
        return self.automaton.iter("".join(map(self.spelled.get, words, repeat("\0\0")))) if self.n_windows and words else iter(())

    def any(self, words: list[bytes]) -> bool:
        return next(self.found(words), None) is not None

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are inside an occurrence, and the ids of the items with one."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        for end, (size, ids) in self.found(words):
            last = end // 2
            hit[last - size + 1 : last + 1] = True
            items |= ids
        return hit, items


#: The scanners of this worker by their broadcast, the latest only.
_KEPT: dict[int, Scanner] = {}


def _scanner(sent: Broadcast, key: int) -> Scanner:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Scanner(sent.value)
    return _KEPT[key]


def _parts(benchmark: DataFrame, most_bytes: int) -> Iterator[tuple[Broadcast, int]]:
    """The benchmark's ids and texts on all executors, a part of bounded size after the other, each with a key of its broadcast.

    An item whose text alone exceeds the bound is a part of its own.
    """
    import uuid

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = F.octet_length("text").cast("long") + 16
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    # twice as many parts as the sum calls for, as hashes do not deal evenly
    n = 1 if total <= most_bytes else 2 * -(-total // most_bytes)
    if n > 1:
        rows = written(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))))
    for k in range(n):
        part = rows.where(F.col("part") == k).drop("part") if n > 1 else rows
        items = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(items), uuid.uuid4().int


def runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of word numbers that are hit."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Code-point spans of the original text, from the first to the last word of each run of hit words."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"start": at[s][0], "end": at[e - 1][1]} for s, e in runs_of(hit)]


_FOUND = "doc_id long, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<long>"


def _passes(benchmark: DataFrame, most_bytes: int) -> list[tuple[Broadcast, int]]:
    return list(_parts(benchmark, most_bytes))


def _row_batch(ids: pa.Array, texts: list[str | None], found: list[tuple[np.ndarray, list]]) -> pa.RecordBatch:
    columns = [
        pa.array([len(h) for h, _ in found], pa.int64()),
        pa.array([int(h.sum()) for h, _ in found], pa.int64()),
        pa.array([spans_of(t, h) if h.any() else [] for t, (h, _) in zip(texts, found)], _SPANS),
        pa.array([items for _, items in found], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_words", "n_hit", "spans", "items"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _listed(items: set) -> list[int]:
    return sorted(x for x in items if x is not None)


def _one_pass(sent: Broadcast, key: int):
    """Scans by the one automaton there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(sent, key)
        for part in _slices(batches):
            texts = [t.as_py() for t in part.column(1)]
            found = [scanner.scan(normal_words(t)) for t in texts]
            yield _row_batch(part.column(0), texts, [(hit, _listed(items)) for hit, items in found])

    return run


def _next_pass(sent: Broadcast, key: int):
    """Scans by one of several automata and adds what it finds to what the former ones have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(sent, key)
        for part in _slices(batches):
            runs, items = part.column(2).to_pylist(), part.column(3).to_pylist()
            for i, text in enumerate(part.column(1)):
                hit, more = scanner.scan(normal_words(text.as_py()))
                if hit.any():
                    for r in runs[i]:
                        hit[r["start"] : r["end"]] = True
                    runs[i] = [{"start": a, "end": b} for a, b in runs_of(hit)]
                    items[i] = _listed({*items[i], *more})
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(runs, _SPANS), pa.array(items, pa.list_(pa.int64()))], names=part.schema.names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        texts, found = [t.as_py() for t in part.column(1)], []
        for text, runs, items in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
            hit = np.zeros(len(normal_words(text)), dtype=bool)
            for r in runs:
                hit[r["start"] : r["end"]] = True
            found.append((hit, items))
        yield _row_batch(part.column(0), texts, found)


def contamination(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, spans, items.

    ``n_hit`` counts the words inside any occurrence of a window, ``spans`` has the runs
    of such words as code-point offsets of the original text, ``items`` the sorted ids of
    the items with occurring windows. Null, empty and wordless texts have no words and no
    hits; a text of any length is scanned as a whole. An item without words has no windows,
    and one whose id is null marks words but is not listed; items that repeat, or share an
    id, add up. An empty benchmark hits nothing. Rows that repeat are returned as often as
    they occur. Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first, *others = _passes(benchmark, most_bytes)
    if not others:
        return source.mapInArrow(_one_pass(*first), _FOUND)
    # runs of hit words and items are gathered from part to part; texts are written once a part
    now = source.withColumns({"runs": F.array().cast("array<struct<start: long, end: long>>"), "items": F.array().cast("array<long>")})
    for sent, key in (first, *others):
        now = written(now.mapInArrow(_next_pass(sent, key), now.schema))
    return now.mapInArrow(_summed, _FOUND)


def clean_documents(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a window of ``benchmark``; all columns stay.

    The documents are scanned once for each part of the benchmark, in their own tasks, and no
    row is shuffled. A row
    whose text is null or wordless stays; an empty table stays empty.
    """
    passes = _passes(benchmark, most_bytes)
    for n, (sent, key) in enumerate(passes, 1):
        docs = docs.mapInArrow(_clean_pass(sent, key), docs.schema)
        docs = written(docs) if n < len(passes) else docs
    return docs


def _clean_pass(sent: Broadcast, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(sent, key)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not scanner.any(normal_words(t.as_py())) for t in text], pa.bool_()))

    return run
