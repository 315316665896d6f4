"""SimHash near-duplicates by pigeonring candidate search.

A 64-bit fingerprint is a ring of eight segments of 8 bits. If two fingerprints differ in
at most 3 bits, some start on the ring has a chain of segments whose cumulative
differences stay within the proportional budgets, 3/8 of a bit a segment: none in two
segments, at most 1 in five, at most 2 in seven, at most 3 in all. Candidates must
therefore agree in two whole segments, and in at least one half of the next three (their
budget is one bit): sixteen keys of 28 bits for each distinct fingerprint. The rest of
the chain is tested on the pairs of a key before the full Hamming check.

Only distinct fingerprints are compared, so a group of copies is one candidate, and
a key's links are reduced to a spanning forest before they leave the task, so a group
of near copies sends as many links as it has members. Keys are counted with a partial
sum in each task first; those with many members are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_words, written
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
SEGMENTS, SEGMENT_BITS = 8, 8
#: Whole segments in a key, and bits of each half of the segments that have a budget of one bit.
WHOLE, HALF_BITS = 2, 12
KEY_BITS = WHOLE * SEGMENT_BITS + HALF_BITS
#: Members of one key that one task compares; larger keys are dealt out as pairs of blocks of about this size.
BLOCK = 4096
_MASK = np.uint64((1 << SEGMENT_BITS) - 1)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text; zero without words."""
    from xxhash import xxh64_intdigest

    words = lower_words(text)
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _keys() -> list:
    """The candidate keys of a fingerprint: (start, half) and their ``KEY_BITS`` bits, in one long."""
    out = []
    for i in range(SEGMENTS):
        by = SEGMENT_BITS * i
        # segment i and those behind it, the ring's first behind its last, from the lowest bit on
        ring = F.shiftrightunsigned("fp", by).bitwiseOR(F.shiftleft("fp", 64 - by)) if by else F.col("fp")
        whole = ring.bitwiseAND(F.lit((1 << WHOLE * SEGMENT_BITS) - 1))
        for half in range(2):
            part = F.shiftrightunsigned(ring, WHOLE * SEGMENT_BITS + HALF_BITS * half).bitwiseAND(F.lit((1 << HALF_BITS) - 1))
            tag = F.lit((2 * i + half) << KEY_BITS).cast("long")
            out.append(tag.bitwiseOR(F.shiftleft(whole, HALF_BITS)).bitwiseOR(part))
    return out


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether pairs of fingerprints pass the chain from segment ``start`` and the full check."""
    rest = a ^ b
    ok = np.ones(len(a), dtype=bool)
    total = np.zeros(len(a), dtype=np.int64)
    for step in range(SEGMENTS):
        shift = ((start + step) % SEGMENTS * SEGMENT_BITS).astype(np.uint64)
        total += np.bitwise_count((rest >> shift) & _MASK)
        ok &= total * SEGMENTS <= (step + 1) * DISTANCE
    return ok


class _Forest:
    """Union-find over fingerprints; ``add`` keeps a link only if it joins two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            self.parent[y] = x
        return x

    def add(self, pairs: Iterator[tuple[int, int]]) -> None:
        for a, b in pairs:
            x, y = self.find(a), self.find(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.kept.append((a, b))


def _compare(fp: np.ndarray, side: np.ndarray, start: int, forest: _Forest) -> None:
    """Links among the members of one key, or between its two blocks (side 1 and 2; 0: within)."""
    a, b = (fp, fp) if not side.any() else (fp[side == 1], fp[side == 2])
    for i in range(len(a)):
        other = b[i + 1 :] if a is b else b
        if len(other):
            hit = linked(np.full(len(other), a[i]), other, np.full(len(other), start))
            forest.add(zip(repeat(int(a[i])), other[hit].tolist()))


def _batch_links(key: np.ndarray, block: np.ndarray, side: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within the groups (key, block) of sorted rows."""
    forest = _Forest()
    change = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
    starts = np.concatenate([[0], change])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    small = sizes <= 64
    group_end = np.repeat(starts + sizes, sizes)
    in_small = np.repeat(small, sizes) & (side == 0)
    ring = key >> (KEY_BITS + 1)
    at = np.flatnonzero(in_small)
    step = 1
    while len(at := at[at + step < group_end[at]]):
        ok = linked(fp[at], fp[at + step], ring[at])
        forest.add(zip(fp[at[ok]].tolist(), fp[at[ok] + step].tolist()))
        step += 1
    for g in np.flatnonzero((sizes > 1)):
        s, e = starts[g], starts[g] + sizes[g]
        if not small[g] or side[s:e].any():
            _compare(fp[s:e], side[s:e], int(ring[s]), forest)
    return forest.kept


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of rows sorted by key and block; a group may span batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        differs = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        held = [x[cut:] for x in now]
        if cut:
            yield _as_batch(_batch_links(*(x[:cut] if i < 3 else x[:cut].view(np.uint64) for i, x in enumerate(now))))
    if held is not None and len(held[0]):
        yield _as_batch(_batch_links(held[0], held[1], held[2], held[3].view(np.uint64)))


def _as_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def near_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints ``fps`` (fp) at ``DISTANCE`` or fewer bits."""
    keyed = fps.select("fp", F.explode(F.array(*_keys())).alias("key"))
    # counted with a partial sum in each task, so a hot key costs one row a task; the join may split it
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    counted = keyed.join(shared, "key")
    columns = ["key", "block", "side", "fp"]
    plain = counted.where(f"n > 1 and n <= {block}").select("key", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("side"), "fp")
    # an exchange of its own: a key that the join has split is put together again
    plain = plain.repartition("key").sortWithinPartitions("key", "block")
    # a key of n members has m = ceil(n / block) blocks; each member meets every block once
    own = F.expr("pmod(xxhash64(fp), m)")
    hot = counted.where(f"n > {block}").withColumn("m", F.expr(f"cast(ceil(n / {block}) as long)")).withColumn("own", own)
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    pair = F.least("own", "other") * F.col("m") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("long")
    hot = hot.select("key", pair.alias("block"), side.alias("side"), "fp").repartition("key", "block").sortWithinPartitions("key", "block")
    return plain.select(columns).mapInArrow(_links, "a long, b long").unionByName(hot.select(columns).mapInArrow(_links, "a long, b long"))


def _placed(marked: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``marked`` (doc_id, fp); root names the component."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct.select("fp")))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(named, "root").select(F.col("fp").alias("own_fp"), "root", "component_id")
    return marked.join(by_fp, marked.fp == F.col("own_fp")).select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Words are runs of ``[^\x20\x09-\x0D]`` with A-Z lower-cased; null, empty and blank
    texts have fingerprint zero, which links like any other. component_id is the least
    doc_id reachable, null where all doc_ids of a component are null. Rows that repeat
    are returned as often as they occur. An empty table gives no rows. Other columns are
    not read.
    """
    joined = _placed(checkpointed(fingerprints(docs)))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with one more column, ``_fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("_text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found, pa.int64())], names=["_row", "_fp"])

    source = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("_text"))
    return source.mapInArrow(run, source.select("_row").schema.add("_fp", "long")).select("_row.*", "_fp")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row a component: that of the least doc_id, and there of the least fingerprint.

    Which ids go is decided without their texts; the texts cross the network only where the
    list of those ids is too large to be sent to them. Rows that share a doc_id but not their
    component are told apart by their fingerprints, so each component keeps a row of its own;
    repeated rows are kept once. Rows with a null doc_id are kept, since no id can name a
    representative among them. An empty table stays empty.
    """
    marked = checkpointed(fingerprints(docs))
    named = marked.where("doc_id is not null")
    several = written(named.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("several_id")))
    placed = checkpointed(_placed(marked))
    chosen = placed.where("doc_id = component_id").groupBy("root").agg(F.min("doc_id").alias("kept_id"), F.min("fp").alias("kept_fp")).select("kept_id", "kept_fp")
    # ids alone decide; the rows that go are the fewer, so a small list of them is sent to the texts and not the other way
    gone = written(placed.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")))
    if several.isEmpty():
        return docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")
    gone = gone.unionByName(several.select(F.col("several_id").alias("gone_id"))).distinct()
    single = docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")
    shared = _with_fingerprint(docs.join(several, docs.doc_id == several.several_id, "left_semi"))
    shared = shared.join(chosen, (shared.doc_id == chosen.kept_id) & (shared["_fp"] == chosen.kept_fp), "left_semi").dropDuplicates(["doc_id", "_fp"])
    return single.unionByName(shared.drop("_fp"))
