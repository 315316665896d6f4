"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

No tokenizer is trained. A rank file gives each token as bytes, in the order of the merges.
Each byte is mapped to one letter, so every token becomes a piece of letters and every text
has a spelling in them; a piece's score is its negative rank. The model of type BPE then
joins, again and again, the adjacent pair whose joined piece scores best, the leftmost
first: the merges that the ranks prescribe. Its normalization is the identity, so nothing
is folded, trimmed or escaped.

A text is split by the vocabulary's pattern first, and each match is encoded by itself; a
worker keeps the ids of matches that it has met, as prose repeats them. The pattern is that
of ``tiktoken``, whose letters are those of an older Unicode than ``regex`` knows; characters
that only the newer one calls letters or numbers are masked while a text is split. Decoding maps ids back
through the model's own pieces to letters and bytes.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes 0 to 255 as letters: code points that no normalization touches and no white space is among.
FIRST_LETTER = 0x100
LETTERS = {b: FIRST_LETTER + b for b in range(256)}
#: Matches whose ids a task keeps, and the code points of the longest such match.
KEPT_MATCHES, KEPT_LENGTH = 500_000, 64
#: Code points of the texts that are split and encoded together, about.
SLICE = 1 << 18

# Field numbers of sentencepiece's model file, and the values for BPE and for a piece that stands for unknown text.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND, UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, BPE = 3, 4, 40, 41, 42, 43, 2
RULE_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | str | bytes) -> bytes:
    """One field of a message: integers as varints, floats in 32 bits, texts and messages with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode("utf-8") if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def spelled(data: bytes) -> str:
    """Bytes as the letters that stand for them."""
    return data.decode("latin-1").translate(LETTERS)


def unspelled(letters: str) -> bytes:
    return bytes(ord(c) - FIRST_LETTER for c in letters)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank a line) by rank; ranks must run from 0 without gaps."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"the ranks of {path} have gaps")
    return [found[i] for i in range(len(found))]


def serialized(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the tokens' ranks; the piece for unknown text has the id behind them.

    All 256 bytes must be tokens, so that no text is unknown.
    """
    if len(set(tokens)) != len(tokens) or not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("tokens must be distinct and hold every single byte")
    pieces = [_field(PIECES, _field(PIECE_TEXT, spelled(t)) + _field(PIECE_SCORE, float(-i))) for i, t in enumerate(tokens)]
    pieces.append(_field(PIECES, _field(PIECE_TEXT, "<unk>") + _field(PIECE_SCORE, 0.0) + _field(PIECE_KIND, UNKNOWN)))
    trainer = _field(MODEL_TYPE, BPE) + _field(VOCAB_SIZE, len(pieces)) + _field(UNK_ID, len(tokens)) + b"".join(_field(k, -1) for k in (BOS_ID, EOS_ID, PAD_ID))
    normalizer = _field(RULE_NAME, "identity") + b"".join(_field(k, 0) for k in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES))
    return b"".join(pieces) + _field(TRAINER, trainer) + _field(NORMALIZER, normalizer)


def newer_characters() -> set[int]:
    """Code points that ``regex`` counts as letters or numbers and ``tiktoken``, by its older Unicode tables, does not."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        found = regex.findall(kind, every)
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out |= set(found).difference(probe.decode(probe.encode_ordinary("".join(found))))
    return set(map(ord, out))


#: A code point that no version of Unicode assigns: neither letter nor number nor white space.
NEITHER = 0xFFFF


class ByteBpe:
    """Encodes texts to ids and decodes ids to bytes by one vocabulary."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialized(read_ranks(ranks)))
        self.pattern = regex.compile(pattern)
        self.masks = dict.fromkeys(newer_characters(), NEITHER)
        self.newer = frozenset(map(chr, self.masks))
        #: Bytes of each id, from the model's own pieces.
        self.bytes_of = [unspelled(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)]
        self.known: dict[str, list[int]] = {}

    def masked_split(self, text: str) -> list[str]:
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.masks))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; matches that are not known yet are encoded all at once."""
        if len(self.known) > KEPT_MATCHES:
            self.known.clear()
        split = [self.pattern.findall(t) for t in texts]
        new = set().union(*split).difference(self.known)
        # known matches hold no newer character, so a text that has one shows it here
        newer = {m for m in new if not m.isascii() and not self.newer.isdisjoint(m)}
        if newer:
            split = [s if newer.isdisjoint(s) else self.masked_split(t) for s, t in zip(split, texts)]
            new = set().union(*split).difference(self.known)
        order = list(new)
        self.known.update(zip(order, self.model.encode([spelled(m.encode("utf-8")) for m in order], num_threads=1)))
        out = [list(chain.from_iterable(map(self.known.__getitem__, matches))) for matches in split]
        for m in order:
            if len(m) > KEPT_LENGTH or newer and not self.newer.isdisjoint(m):
                del self.known[m]
        return out

    def decode(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            raise IndexError("ids are not negative")
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def _loaded(ranks: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def _vocabulary(ranks: str | None, pattern: str | None) -> ByteBpe:
    import public_tokenizers

    return _loaded(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def _encoded(batches: Iterator[pa.RecordBatch], bpe: ByteBpe) -> Iterator[tuple[pa.Array, list[list[int]]]]:
    """(doc ids, ids of their texts), some texts at a time."""
    for batch in batches:
        texts = [t.as_py() or "" for t in batch.column(1)]
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (size == 0 or size < SLICE):
                size += len(texts[end])
                end += 1
            yield batch.column(0).slice(start, end - start), bpe.encode(texts[start:end])
            start = end


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs`` (doc_id, text), as ``round_trip`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in _encoded(batches, _vocabulary(ranks, pattern)):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, decoded binary) for every row of ``encoded`` (doc_id, ids).

    The bytes of any ids are joined, so a list that was cut within a character decodes to a
    part of it. Null ids are no ids; an id that the vocabulary has not is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(ranks, pattern)
        for batch in batches:
            decoded = [bpe.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for every row of ``docs`` (doc_id, text).

    ``ranks``: path of a rank file on every executor, ``pattern``: that of its pre-tokens; by
    default those of the public vocabulary for many languages. Null and empty texts have no
    ids and decode to no bytes. Whole texts are encoded whatever their length. A null doc_id
    stays null; rows that repeat are returned as often as they occur. Special tokens are
    ordinary text. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(ranks, pattern)
        for doc_ids, ids in _encoded(batches, bpe):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
