"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch with a period that no neighbour extends. Every text is handled by
itself, in time about linear in its words:

1. The words become numbers. Stretches that no run of the asked exponent can touch are left
   out: in a run of at least x periods every window of 2x - 3 words (or one less than the
   shortest run) occurs once more in the run, so a run lies within consecutive windows that
   occur twice in the text. The bound is exact; with an exponent of 2 nothing is left out.
2. A suffix automaton gives the factorization of Lempel and Ziv: each factor is the longest
   stretch that also begins earlier, or a new word.
3. Main's algorithm finds, at each border of factors, the runs that touch or cross it, by
   the extensions of each period to both sides. Such a run with its last word in a factor
   begins behind a bound that the two factors at the border give.
4. A run inside a factor, touching neither end, is a copy of one in the factor's earlier
   occurrence and is taken over from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of texts that are handled between two results, about.
SLICE = 1 << 20


@dataclass(frozen=True)
class RunOptions:
    #: Words that a run has at least.
    least_length: int = 6
    #: Periods that it has at least; 2 or more.
    least_exponent: int = 4


Run = tuple[int, int, int]  # start, end (exclusive), smallest period


class SuffixAutomaton:
    """The suffix automaton of a list of numbers.

    State i, up to the length n, is that of the prefix of i letters; the states behind n are
    clones. A prefix's step along the text is implied, so only other steps are stored.
    """

    def __init__(self, word: list[int]) -> None:
        n = len(word)
        self.word, self.n = word, n
        self.length = list(range(n + 1))
        #: Last place of the first occurrence of a state's strings.
        self.first = list(range(-1, n))
        self.steps: dict[int, dict[int, int]] = {0: {}}
        link = [-1] + [0] * n
        length, first, steps = self.length, self.first, self.steps
        for i, c in enumerate(word):
            at, here = link[i], i + 1
            # states on the way up from the prefix's own one; -1 is above the root
            while at >= 0:
                if at < i and word[at] == c:
                    to = at + 1
                else:
                    own = steps.get(at)
                    to = own.get(c, -1) if own else -1
                if to >= 0:
                    break
                if own is None:
                    steps[at] = {c: here}
                else:
                    own[c] = here
                at = link[at]
            if at < 0:
                continue  # the link stays the root
            if length[at] + 1 == length[to]:
                link[here] = to
                continue
            clone = len(length)
            length.append(length[at] + 1)
            first.append(first[to])
            link.append(link[to])
            copied = dict(steps.get(to, ()))
            if to <= i:
                copied[word[to]] = to + 1
            steps[clone] = copied
            link[to] = link[here] = clone
            while at >= 0 and (own := steps.get(at)) is not None and own.get(c) == to:
                own[c] = clone
                at = link[at]

    def step(self, state: int, letter: int) -> int:
        """The state behind ``letter``, or -1."""
        if state < self.n and self.word[state] == letter:
            return state + 1
        own = self.steps.get(state)
        return own.get(letter, -1) if own else -1


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, source) of the factors: the longest stretch that also begins at ``source`` before, or a new letter with source -1."""
    automaton, n = SuffixAutomaton(word), len(word)
    out, start = [], 0
    while start < n:
        state, end = 0, start
        while end < n:
            to = automaton.step(state, word[end])
            # the first occurrence of what is read so far must end before this one does
            if to < 0 or automaton.first[to] >= end:
                break
            state, end = to, end + 1
        if end == start:
            out.append((start, start + 1, -1))
            start += 1
        else:
            out.append((start, end, automaton.first[state] - (end - start) + 1))
            start = end
    return out


def _z(word: list[int]) -> list[int]:
    """For each place, how many letters from there on equal the word's beginning."""
    n = len(word)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def border_runs(word: list[int], low: int, border: int, high: int, longest: int, options: RunOptions) -> Iterator[Run]:
    """Runs within [low, high) that touch or cross ``border``, with periods up to ``longest``; some come with a multiple of their period."""
    n, x = len(word), options.least_exponent
    left, right = word[low:border], word[border:high]
    back = left[::-1]
    ahead, behind = _z(right), _z(back)
    ahead_of_left = _z([*right, -1, *left])  # what each place of the left shares with the right's beginning
    back_of_right = _z([*back, -1, *right[::-1]])  # what each place of the right, read backward, shares with the left's end
    n_left, n_right = len(left), len(right)
    for p in range(1, min(longest, max(n_left, n_right)) + 1):
        found = []
        after = ahead[p] if p < n_right else 0  # equal letters from the border and from a period to the right of it
        before = behind[p] if p < n_left else 0  # and backward from the border and from a period to the left of it
        if p <= n_right:
            # a period to the right of the border, extended to both sides; where it equals the one to the left, on from there
            common = back_of_right[n_left + 1 + n_right - p]
            found.append((border - common - (before if common == p else 0), border + p + after))
        if p <= n_left:
            # a period to the left of it
            common = ahead_of_left[n_right + 1 + n_left - p]
            found.append((border - p - before, border + common + (after if common == p else 0)))
        for b, e in found:
            if e - b >= x * p and e - b >= options.least_length and (b == 0 or word[b - 1] != word[b - 1 + p]) and (e == n or word[e] != word[e - p]):
                yield b, e, p


def runs(word: list[int], options: RunOptions = RunOptions()) -> list[Run]:
    """All runs of a list of numbers (none negative) by start and end."""
    x = options.least_exponent
    if x < 2:
        raise ValueError("a run has two periods at least")
    found: dict[tuple[int, int], int] = {}
    begins: dict[int, list[tuple[int, int]]] = {}  # by start: (end, period)

    def keep(b: int, e: int, p: int) -> None:
        if (b, e) not in found:
            begins.setdefault(b, []).append((e, p))
        elif p < found[b, e]:
            begins[b] = [(end, p if end == e else q) for end, q in begins[b]]
        else:
            return
        found[b, e] = p

    before = 0  # size of the factor before
    for start, end, source in [*factors(word), (len(word), len(word), -1)]:
        # a run that ends in this factor and crosses its start has fewer than ``both / (x - 1)`` words a period, and begins less than one period before the factor before
        both = before + end - start
        longest = both // (x - 1) + 1
        if both >= options.least_length - 1 or end == len(word) or start == 0:
            for b, e, p in border_runs(word, max(0, start - before - longest), start, end, longest, options):
                keep(b, e, p)
        if source >= 0:
            shift, last = start - source, end - start + source
            for b in range(source + 1, last - options.least_length):
                for e, p in list(begins.get(b, ())):
                    if e < last:
                        keep(b + shift, e + shift, p)
        before = end - start
    return sorted((b, e, p) for (b, e), p in found.items())


def stretches(codes: np.ndarray, options: RunOptions) -> list[tuple[int, int]]:
    """(start, end) of what runs may touch: windows that occur twice, joined where they follow each other."""
    n, size = len(codes), min(options.least_length - 1, 2 * options.least_exponent - 3)
    if n < options.least_length:
        return []
    if options.least_exponent == 2 or size < 1:
        return [(0, n)]
    hashes = np.zeros(n - size + 1, dtype=np.uint64)
    for i in range(size):
        hashes = (hashes + codes[i : n - size + 1 + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    # windows whose hashes collide are looked at in vain, and nothing more
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(hashes) + 2, dtype=np.int8)
    twice[order[1:][same] + 1] = 1
    twice[order[:-1][same] + 1] = 1
    edges = np.diff(twice)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + size - 1
    long = ends - starts >= options.least_length
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def runs_of(words: list[bytes], options: RunOptions = RunOptions()) -> list[Run]:
    """All runs of a list of words, by start and end."""
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    out = []
    for start, end in stretches(codes, options):
        out += [(start + b, start + e, p) for b, e, p in runs(codes[start:end].tolist(), options)]
    return sorted(out)


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words without those that a run holds behind its first period, joined by one space."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for b, e, p in found:
        edge[b + p] += 1
        edge[e] -= 1
    gone = np.cumsum(edge)[:-1] > 0 if found else np.zeros(len(words), dtype=bool)
    return b" ".join(words) if not gone.any() else b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def _longest(found: list[Run]) -> Run | None:
    """The run of the greatest exponent, compared exactly; of several the one that starts first, then that of the least period."""
    best = None
    for b, e, p in found:
        if best is None or (e - b) * best[2] > (best[1] - best[0]) * p or ((e - b) * best[2] == (best[1] - best[0]) * p and (b, p) < (best[0], best[2])):
            best = (b, e, p)
    return best


_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, options: RunOptions = RunOptions()) -> DataFrame:
    """doc_id, n_words, runs, longest and collapsed for every row of ``docs`` (doc_id, text).

    ``runs`` is an array of (start, length, period) by start and period, ``longest`` the one of
    the greatest exponent (null without any), ``collapsed`` the words that are left when each
    run keeps its first period, joined by one space. Words are maximal ``[^\\x20\\x09-\\x0D]+``,
    compared byte by byte and numbered from 0. Null, empty and blank texts have no words.
    Texts are read whole, whatever their length, and no run is left out. A null doc_id stays
    null; rows that repeat are returned as often as they occur. An empty table gives no rows.
    Other columns are not read.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                end, size, rows = start, 0, []
                while end < batch.num_rows and size < SLICE:
                    text = batch.column(1)[end].as_py() or ""
                    words = text.encode("utf-8", "surrogatepass").split()
                    found = sorted(runs_of(words, options), key=lambda r: (r[0], r[2]))
                    as_run = lambda r: r and {"start": r[0], "length": r[1] - r[0], "period": r[2]}
                    rows.append((len(words), [as_run(r) for r in found], as_run(_longest(found)), collapsed(words, found).decode("utf-8", "surrogatepass")))
                    end, size = end + 1, size + len(text)
                count, all_runs, longest, left = zip(*rows)
                columns = [pa.array(count, pa.int64()), pa.array(all_runs, pa.list_(run_type)), pa.array(longest, run_type), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *columns], names=["doc_id", "n_words", "runs", "longest", "collapsed"])
                start = end

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, n_words long, runs array<{_RUN}>, longest {_RUN}, collapsed string")
