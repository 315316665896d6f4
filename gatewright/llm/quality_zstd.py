"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained, one from good and one from bad labelled text. A text is
cut into blocks, each is compressed with either, and the difference of the total sizes
over the text's own size says which dictionary knows it better. A logistic curve,
fitted on labelled rows that no dictionary has seen, turns that number into a score.

Blocks are small, so a dictionary's share does not fade along a long text, and memory
is one block's, whatever the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import _logistic, held_out, labelled_sample


@dataclass(frozen=True)
class CompressionOptions:
    dictionary_bytes: int = 40_000
    block_bytes: int = 512
    level: int = 3
    #: Labelled rows that are read at most, taken by the hash of their id, and bytes of their whole texts together.
    sample_rows: int = 6000
    sample_bytes: int = 24 << 20
    #: Share of the sample that dictionaries are made from; the rest calibrates.
    dictionary_share: float = 0.7


def blocks(text: str, size: int) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class CompressionModel:
    def __init__(self, good: bytes, bad: bytes, curve: tuple[float, float], options: CompressionOptions) -> None:
        import zstandard as z

        self.good, self.bad, self.curve, self.options = good, bad, curve, options
        make = lambda raw: z.ZstdCompressor(level=options.level, dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_FULLDICT), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.pair = None
        if good and bad:
            self.pair = make(good), make(bad)

    def difference(self, text: str | None) -> float:
        """(size with the bad dictionary - size with the good one) / size as it is; 0 for no text."""
        if not text or self.pair is None:
            return 0.0
        parts = blocks(text, self.options.block_bytes)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.pair)
        return (bad - good) / sum(map(len, parts))

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * self.difference(text) + b, -30, 30))))


def _dictionary(texts: list[str], options: CompressionOptions) -> bytes:
    """A trained dictionary of the texts' blocks; empty if there is too little text for one."""
    import zstandard as z

    parts = [p for t in texts for p in blocks(t, options.block_bytes) if len(p) >= 8]
    total = sum(map(len, parts))
    try:
        return z.train_dictionary(min(options.dictionary_bytes, max(1024, total // 8)), parts, level=options.level).as_bytes()
    except (z.ZstdError, ValueError):
        return b""


def train(texts: list[str], labels: list[int], options: CompressionOptions = CompressionOptions()) -> CompressionModel:
    """Dictionaries and curve from labelled texts; without both classes the score is the labels' mean.

    The texts come in the order of a hash of their ids, so the first share of them, which the
    dictionaries are made from, is a random one.
    """
    y = np.array(labels, dtype=np.float64)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    flat = (0.0, float(np.log(mean / (1 - mean))))
    first = np.arange(len(y)) < len(y) * options.dictionary_share
    good, bad = (_dictionary([t for t, label, f in zip(texts, labels, first) if f and label == want], options) for want in (1, 0))
    model = CompressionModel(good, bad, flat, options)
    if model.pair is not None and len(set(y[~first])) == 2:
        found = np.array([model.difference(t) for t, f in zip(texts, first) if not f])
        model.curve = _logistic(found, y[~first])
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, options: CompressionOptions = CompressionOptions()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) are read only where the CRC-32 of the id, modulo 5, is
    not 0; the score comes from the whole text alone. Null and empty texts have
    difference 0 and its score. Rows that repeat score alike; a null doc_id is not held out. With
    labels of one class, or too little text for a dictionary, all scores are the same.
    Other columns are not read.
    """
    model = train(*labelled_sample(docs, labels, "quality", 5, 0, options.sample_rows, options.sample_bytes), options)
    sent = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CompressionModel(*sent.value, options)
        for batch in batches:
            scores = pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
