"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Each word is a bag of hashed character n-grams, so an unseen misspelling shares vectors
with the words it resembles. The words' vectors are averaged over the whole text and go
through a linear layer into a softmax. The average is weighted: a word counts by the
exponential of its vector's product with one more vector, so a few telling words in a
long text are not averaged away. Table, layer and weights are trained jointly with numpy
on a bounded sample of labelled rows.

An average does not grow with the text: what decides is the weighted share of telling
words, so clean texts stay clean however long they are. Because the layer is linear, a
word's part in the result is two numbers, its weight and its score, which a task keeps;
scoring is a pass of additions over the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_words


@dataclass(frozen=True)
class ToxicityOptions:
    buckets: int = 1 << 18
    #: Training texts that must hold a bucket's n-grams for its vector to count by half; in n texts it counts by n / (n + this).
    least_texts: int = 2
    width: int = 8
    shortest: int = 3
    longest: int = 6
    #: Steps of training, in as many epochs as they take, and the texts of one step.
    steps: int = 300
    batch: int = 32
    rate: float = 0.4
    #: Bound of the logarithm of a word's weight.
    steepest: float = 8.0
    seed: int = 7
    #: Labelled rows that training reads at most, taken by the hash of their id, and bytes of their whole texts together.
    sample_rows: int = 4000
    sample_bytes: int = 24 << 20
    #: Words whose result a task keeps, about.
    kept_words: int = 400_000


def gram_buckets(words: list[bytes], options: ToxicityOptions) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the words' character n-grams, word after word, and how many each word has.

    Words are marked at both ends, so the shortest has one n-gram. All n-grams of one size
    are hashed at once, by a polynomial over their code points.
    """
    marked = [f"<{w.decode('utf-8', 'surrogatepass')}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    size = np.array([len(m) for m in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # code points from here to the word's end
    found, of = [], []
    rolled = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, min(options.longest, len(points)) + 1):
        ahead = np.zeros(len(points), dtype=np.uint64)
        ahead[: len(points) - n + 1] = points[n - 1 :]
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + ahead + np.uint64(n)
        if n >= options.shortest:
            at = left >= n
            h = rolled[at]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append(((h ^ (h >> np.uint64(29))) % np.uint64(options.buckets)).astype(np.int64))
            of.append(owner[at])
    words_of = np.concatenate(of)
    order = np.argsort(words_of, kind="stable")
    return np.concatenate(found)[order], np.bincount(words_of, minlength=len(words))


class ToxicityModel:
    """The trained scores and weights of n-grams, and the curve that calibrates the texts' log-odds."""

    def __init__(self, options: ToxicityOptions, table: np.ndarray, layer: np.ndarray, bias: float, gate: np.ndarray) -> None:
        self.options, self.bias = options, float(bias)
        self.calibration = (1.0, 0.0)
        #: Log-odds of a text without words: those of a middling clean text, once trained.
        self.blank = self.bias
        #: Each n-gram's part in its word's score and in the logarithm of its weight.
        self.grams = np.stack([table @ (layer[:, 1] - layer[:, 0]), table @ gate], axis=1).astype(np.float32)
        #: The kept words' places in ``known``, which has (weight * score, weight) of each.
        self.words: dict[bytes, int] = {}
        self.known = np.zeros((0, 2))

    def learn_words(self, words: set[bytes]) -> None:
        """Keeps (weight * score, weight) of words that are not known yet, all of them at once."""
        if len(self.words) + len(words) > self.options.kept_words:
            self.words.clear()
            self.known = self.known[:0]
        new = [w for w in words if w not in self.words]
        found = [self.known]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            buckets, counts = gram_buckets(part, self.options)
            sums = np.add.reduceat(self.grams[buckets], np.cumsum(counts) - counts, axis=0, dtype=np.float64) / counts[:, None]
            weight = np.exp(np.clip(sums[:, 1], -self.options.steepest, self.options.steepest))
            found.append(np.stack([weight * sums[:, 0], weight], axis=1))
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.known = np.concatenate(found)

    def word_score(self, word: bytes) -> float:
        """A word's own score, without its weight."""
        self.learn_words({word})
        part, weight = self.known[self.words[word]]
        return float(part / weight)

    def logit(self, words: list[bytes]) -> float:
        """Log-odds of a text's weighted average, before calibration; the words' numbers are known."""
        if not words:
            return self.blank
        total = self.known[np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
        return self.bias + float(total[0] / total[1])

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """Log-odds of several texts; their words are looked up together, some thousand words at a time."""
        out, start = [], 0
        while start < len(texts):
            end, n = start, 0
            while end < len(texts) and (n == 0 or n < 200_000):
                n += len(texts[end])
                end += 1
            self.learn_words(set().union(*texts[start:end]))
            out += [self.logit(t) for t in texts[start:end]]
            start = end
        return np.array(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.logits([lower_words(t) for t in texts]) + b, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit, by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def train(texts: list[str], labels: list[int], options: ToxicityOptions = ToxicityOptions()) -> ToxicityModel:
    """A model from labelled texts; without both classes it is constant at the labels' mean.

    Table, layer and weights are learned on three quarters of the rows and calibrated on the
    rest. The texts are read whole, as their distinct words and how often each occurs.
    """
    rng = np.random.default_rng(options.seed)
    table = rng.uniform(-1, 1, (options.buckets, options.width)).astype(np.float32) / options.width
    layer = np.zeros((options.width, 2), dtype=np.float32)
    layer[:, 1] = rng.normal(0, 0.1, options.width)
    gate, bias = np.zeros(options.width, dtype=np.float32), np.zeros(2, dtype=np.float32)
    y = np.array(labels, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        table[:] = 0
        mean = (y.sum() + 0.5) / (len(y) + 1)
        return ToxicityModel(options, table, layer, np.log(mean / (1 - mean)), gate)
    # one text's words at a time: what is kept of a text are its distinct words' numbers and counts
    number: dict[bytes, int] = {}
    bags = []
    for text in texts:
        codes = np.fromiter((number.setdefault(w, len(number)) for w in lower_words(text)), dtype=np.int32)
        bags.append(np.unique(codes, return_counts=True))
    names = list(number)
    del number
    if not names:
        return ToxicityModel(options, table, layer, 0.0, gate)
    parts = []
    for i in range(0, len(names), 10_000):
        buckets, counts = gram_buckets(names[i : i + 10_000], options)
        parts.append((buckets.astype(np.int32), counts))
    flat, size = np.concatenate([f for f, _ in parts]), np.concatenate([c for _, c in parts])
    del parts, names
    # training sees only the buckets that its words use, numbered without gaps
    seen = np.flatnonzero(np.bincount(flat, minlength=options.buckets))
    place = np.zeros(options.buckets, dtype=np.int32)
    place[seen] = np.arange(len(seen), dtype=np.int32)
    flat = place[flat]
    whole, table = table, table[seen]
    begin = np.concatenate([[0], np.cumsum(size)])
    held = rng.random(len(bags)) < 0.25
    order = np.array([i for i in np.flatnonzero(~held) if len(bags[i][0])], dtype=np.int64)
    rate_of = np.clip(y[order].mean(), 1e-3, 1 - 1e-3) if len(order) else 0.5
    weight = np.where(y == 1, 0.5 / rate_of, 0.5 / (1 - rate_of))

    def grams_of(used: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size[used])
        return flat[np.arange(ends[-1]) + np.repeat(begin[used] - ends + size[used], size[used])]

    # rare n-grams are shrunk, not cut: what is learned of them counts by how many texts show it
    texts_with = np.zeros(len(seen), dtype=np.int64)
    for i in order:
        texts_with[np.unique(grams_of(bags[i][0]))] += 1
    shrunk = (texts_with / np.maximum(texts_with + options.least_texts, 1)).astype(np.float32)
    table *= shrunk[:, None]
    squares_t = np.full(len(seen), 1e-8, dtype=np.float32)
    squares_l, squares_b, squares_g = np.full_like(layer, 1e-8), np.full_like(bias, 1e-8), np.full_like(gate, 1e-8)
    batches = max(1, len(order) // options.batch)
    for _ in range(-(-options.steps // batches) if len(order) else 0):
        rng.shuffle(order)
        for part in np.array_split(order, batches):
            used, codes = np.unique(np.concatenate([bags[i][0] for i in part]), return_inverse=True)
            times = np.concatenate([bags[i][1] for i in part])
            lengths = np.array([len(bags[i][0]) for i in part])
            starts = np.cumsum(lengths) - lengths
            pieces = grams_of(used)
            heads = np.cumsum(size[used]) - size[used]
            vectors = np.add.reduceat(table[pieces], heads, axis=0) / size[used][:, None]
            steep = vectors @ gate
            free = np.abs(steep) < options.steepest
            share = np.exp(np.clip(steep, -options.steepest, options.steepest))[codes] * times
            share /= np.repeat(np.add.reduceat(share, starts), lengths)
            each = vectors[codes]
            means = np.add.reduceat(each * share[:, None], starts, axis=0)
            z = means @ layer + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p = z / z.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part].astype(int)] -= 1
            p *= (weight[part] / len(part))[:, None]
            back = np.repeat(p @ layer.T, lengths, axis=0)
            pull = share * ((each - np.repeat(means, lengths, axis=0)) * back).sum(axis=1) * free[codes]
            grad_v = np.stack([np.bincount(codes, share * back[:, k] + pull * gate[k], len(used)) for k in range(options.width)], axis=1)
            grad_l, grad_b, grad_g = means.T @ p, p.sum(axis=0), each.T @ pull
            squares_l += grad_l**2
            squares_b += grad_b**2
            squares_g += grad_g**2
            layer -= (options.rate * 0.5 * grad_l / np.sqrt(squares_l)).astype(np.float32)
            bias -= (options.rate * 0.1 * grad_b / np.sqrt(squares_b)).astype(np.float32)
            gate -= (options.rate * 0.5 * grad_g / np.sqrt(squares_g)).astype(np.float32)
            at = np.flatnonzero(np.bincount(pieces, minlength=len(seen)))
            spread = np.repeat(grad_v / size[used][:, None], size[used], axis=0)
            total = np.stack([np.bincount(pieces, spread[:, k], len(seen))[at] for k in range(options.width)], axis=1)
            squares_t[at] += (total**2).mean(axis=1)
            table[at] -= (options.rate * total * (shrunk[at] / np.sqrt(squares_t[at]))[:, None]).astype(np.float32)
    whole *= 0  # n-grams that no training text shows count for nothing
    whole[seen] = table
    model = ToxicityModel(options, whole, layer, bias[1] - bias[0], gate)
    at = np.flatnonzero(held) if len(set(y[held])) == 2 else np.arange(len(y))
    logits = np.concatenate([model.logits([lower_words(texts[i])]) for i in at])
    model.calibration = _logistic(logits, y[at])
    model.blank = float(np.median(logits[y[at] == 0]))
    model.words.clear()
    model.known = model.known[:0]
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, rows: int, most_bytes: int) -> tuple[list[str], list[int]]:
    """Whole labelled texts outside the held-out remainder, in the order of a hash of the id.

    The remainder is that of the CRC-32 of the id as text. At most ``rows`` rows are taken,
    and fewer where their texts exceed ``most_bytes`` together; no text is cut, and one that
    exceeds them alone is passed over. Rows without id, label or text are left out; of several
    labels for one id the least counts, of several texts the shortest. Only ids, lengths and
    hashes cross the network before the sample is chosen.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(column).cast("int").alias("_label"))
    chosen = (
        own.where("_id is not null and _label is not null")
        .where((F.crc32(F.col("_id").cast("string").cast("binary")) % modulus) != held_out)
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
        .withColumn("_order", F.xxhash64("_id"))
        .orderBy("_order", "_id")
        .limit(rows)
    )
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_text"), F.octet_length(text).alias("_bytes"), F.xxhash64(text).alias("_hash")).where("_text is not null")
    # at most ``rows`` rows of a few numbers on this side: the bound that makes it safe to broadcast
    sizes = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_order", "_label").agg(F.min(F.struct("_bytes", "_hash")).alias("m")).select("_id", "_order", "_label", "m.*")
    taken, size = [], 0
    for r in sorted(sizes.where(F.col("_bytes") <= most_bytes).collect(), key=lambda r: (r["_order"], r["_id"])):
        size += r["_bytes"]
        if size > most_bytes:
            break
        taken.append(r)
    if not taken:
        return [], []
    # the texts themselves are read only once it is known that they fit
    wanted = docs.sparkSession.createDataFrame(taken, "_id long, _order long, _label int, _bytes int, _hash long")
    got = {r["_id"]: r["_text"] for r in texts.join(F.broadcast(wanted), ["_id", "_bytes", "_hash"]).groupBy("_id").agg(F.min("_text").alias("_text")).collect()}
    return [got[r["_id"]] for r in taken], [r["_label"] for r in taken]


def held_out(modulus: int, remainder: int):
    return F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus) == remainder, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) are read only where the CRC-32 of the id, modulo 4, is not
    2; the score comes from the whole text alone. Null, empty and blank texts get the
    score of a middling clean text. Rows that repeat score alike; a null doc_id is not held out. With no label, or
    labels of one class, all scores are the same. Other columns are not read.
    """
    model = train(*labelled_sample(docs, labels, "toxic", 4, 2, options.sample_rows, options.sample_bytes), options)
    sent = docs.sparkSession.sparkContext.broadcast((model.grams, model.bias, model.calibration, model.blank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, bias, calibration, blank = sent.value
        none = np.zeros((0, options.width), np.float32)
        own = ToxicityModel(options, none, np.zeros((options.width, 2), np.float32), bias, np.zeros(options.width, np.float32))
        own.grams, own.calibration, own.blank = grams, calibration, blank
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                scores = pa.array(own.scores([t.as_py() for t in part.column(1)]), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), scores], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
