"""Sequence packing by Karmarkar-Karp multiway differencing.

Each task streams over its documents, cuts every token stream into whole windows and a
remainder, and collects remainders, uncut, until they fill a block of a fixed number of
windows. A block is then partitioned by multiway differencing: every remainder starts as
a partial partition of its own, and the two partial partitions with the widest spread are
merged again and again, the fullest windows of one onto the emptiest windows of the other.
If a window of the result exceeds the capacity, the block is partitioned anew with one
window more. The near-equal windows leave small gaps, and only to close these are the
next documents of the task cut.

A task holds one Arrow batch and one block, whatever the input's size; there is no
shuffle, and sequence numbers are unique because they carry the task's partition.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The end-of-document id that follows each document's ids.
END_ID = 0
SPECIAL = "<|endoftext|>"


@dataclass(frozen=True)
class PackingOptions:
    capacity: int = 1024
    #: Windows that the remainders of a block fill, about.
    block_windows: int = 64
    #: A gap of fewer ids is left as padding, so that no document is cut for a crumb.
    least_piece: int = 8


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Piece indexes by window, by multiway differencing of ``lengths`` into ``windows`` sets.

    A partial partition is a list of (sum, indexes), fullest first, without its empty
    windows. Ties go to the piece that comes first, so equal inputs give equal results.
    """
    if windows <= 1:
        return [list(range(len(lengths)))]
    heap = [(-n, i, [(n, (i,))]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    order = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        overlap = len(a) + len(b) - windows
        if overlap > 0:
            # the emptiest windows of a take the emptiest of b in opposite order
            keep, low = len(a) - overlap, b[len(b) - overlap :][::-1]
            joined = [(x + y, p + q) for (x, p), (y, q) in zip(a[keep:], low)]
            merged = a[:keep] + b[: len(b) - overlap] + joined
        else:
            merged = a + b
        merged.sort(key=lambda s: -s[0])
        if len(merged) == windows:  # only differences matter from here on for the order of merging
            spread = merged[0][0] - merged[-1][0]
        else:
            spread = merged[0][0]
        heapq.heappush(heap, (-spread, order, merged))
        order += 1
    out = [list(p) for _, p in heap[0][2]] if heap else []
    return out + [[] for _ in range(windows - len(out))]


class Packer:
    """Packs the token streams of one task; ``add`` and ``finish`` give rows of pieces."""

    def __init__(self, base: int, options: PackingOptions) -> None:
        self.options, self.next_id = options, base
        self.pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.held = 0
        self.open: list[tuple[int, list[tuple]]] = []  # (ids in it, pieces) of windows with a gap, fullest first
        self.rows: list[tuple] = []

    def place(self, members: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in members:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        o, total = self.options, len(ids)
        whole = total - total % o.capacity
        for start in range(0, whole, o.capacity):
            self.place([(doc_id, start, ids[start : start + o.capacity], total)])
        left = self.close((doc_id, whole, ids[whole:], total))
        if left is not None:
            self.pieces.append(left)
            self.held += len(left[2])
            if self.held >= o.block_windows * o.capacity:
                self.partition()

    def close(self, piece: tuple) -> tuple | None:
        """Cuts ``piece`` into the widest gaps, until it ends or no gap is left; what remains of it."""
        doc_id, start, ids, total = piece
        while self.open and len(ids):
            size, members = self.open.pop()
            cut = ids[: self.options.capacity - size]
            members.append((doc_id, start, cut, total))
            start, ids, size = start + len(cut), ids[len(cut) :], size + len(cut)
            self.settle(size, members)
        return (doc_id, start, ids, total) if len(ids) else None

    def settle(self, size: int, members: list[tuple]) -> None:
        if self.options.capacity - size < self.options.least_piece:
            self.place(members)
        else:
            bisect.insort(self.open, (size, members), key=lambda w: -w[0])

    def partition(self) -> None:
        """The held pieces in as many near-equal windows as their sum calls for, or more if one exceeds the capacity."""
        lengths = [len(p[2]) for p in self.pieces]
        windows = -(-self.held // self.options.capacity)
        while True:
            found = difference(lengths, windows)
            if max(sum(lengths[i] for i in w) for w in found) <= self.options.capacity:
                break
            windows += 1
        for members in found:
            if members:
                self.settle(sum(lengths[i] for i in members), [self.pieces[i] for i in members])
        self.pieces, self.held = [], 0

    def finish(self) -> None:
        """The last windows: the emptiest are taken apart to fill the others, the rest goes to powers of two."""
        if self.pieces:
            self.partition()
        whole = sum(size for size, _ in self.open) // self.options.capacity
        apart, self.open = [p for _, members in self.open[whole:] for p in members], self.open[:whole]
        cut = [left for left in map(self.close, apart) if left is not None]
        for _, members in self.open:
            self.place(members)
        self.open = []
        left = sum(len(p[2]) for p in cut)
        while left:
            size, members = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc_id, start, ids, total = cut.pop(0)
                members.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    cut.insert(0, (doc_id, start + size, ids[size:], total))
                size -= len(members[-1][2])
            self.place(members)

    def drain(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        out = pd.DataFrame(rows, columns=columns)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out.astype({c: "int64" for c in columns[1:]})


def encoder(tokenizer: str, ranks: str | None = None):
    """A function from a text to the array of its ids by the vocabulary file ``tokenizer``.

    ``ranks`` names a rank file of the same vocabulary for ``tiktoken``, which gives the same
    ids three times as fast. The two vocabularies are compared here and must be equal. A
    text that names the special token goes through ``tokenizers`` itself.
    """
    import base64

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    if ranks is None:
        return by_tokenizers
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # the vocabulary file spells bytes as printable characters: itself, or the next free one from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    vocabulary = slow.get_vocab()
    if any(vocabulary.get("".join(map(spelled.__getitem__, token))) != rank for token, rank in merges.items()) or len(vocabulary) != len(merges) + 1:
        raise ValueError(f"{ranks} is not the vocabulary of {tokenizer}")
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if SPECIAL in text:
            return by_tokenizers(text)
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return ids


def public_encoder():
    """The encoder of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, options: PackingOptions = PackingOptions()) -> DataFrame:
    """Pieces of packed sequences for ``docs`` (doc_id, text), one row a piece.

    ``tokenizer`` and ``ranks``: paths of a vocabulary file and, if there is one, its rank
    file, on every executor; by default those of the public 50k byte-level vocabulary. Null
    and empty texts are the end id alone. A null doc_id keeps its pieces under null; rows
    that repeat are packed as often as they occur. A text is cut where it fills whole
    windows, and else only to close the gaps of a block. An empty table gives no rows. Other
    columns of ``docs`` are not read. Sequence ids are unique and depend on the partitioning
    of the input.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = None, Packer(TaskContext.get().partitionId() << 36, options)
        for batch in batches:
            encode = encode or (encoder(tokenizer, ranks) if tokenizer else public_encoder())
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode(text) if text else np.zeros(0, "<u4"), np.uint32(END_ID)).astype("<u4", copy=False)
                packer.add(None if pd.isna(doc_id) else int(doc_id), ids)
                if len(packer.rows) >= 20_000:
                    yield packer.drain()
        packer.finish()
        if packer.rows:
            yield packer.drain()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SCHEMA)
