"""Line-first quality rules, by DataFrame functions only.

Each line of a text is judged by itself: it fails if it lacks a sentence's end, looks
like navigation, reads as boilerplate or is thick with symbols. Failed lines are removed,
and a document that loses too large a share of its characters with them is rejected.
Counts over the whole text (words, symbols, repeated lines, repeated eight-word windows)
reject documents beforehand.

Everything is computed within a row: there is no shuffle, and a text is never exploded.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import or_empty, spaced, words_in

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»«›•"
SPACES = " \t\n\x0b\x0c\r"
REPEAT_WINDOW = 8
#: Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "apache license",
    "click here",
    "cookie policy",
    "copyright (c)",
    "enable javascript",
    "licensed under",
    "mit license",
    "privacy policy",
    "public license",
    "sign up for",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "without warranties",
    "without warranty",
)


@dataclass(frozen=True)
class QualityOptions:
    least_words: int = 20
    #: Largest share in percent of words in repeated windows.
    most_repeated: int = 30
    #: Largest share in percent of a document's non-space characters that may go with failed lines.
    most_lost: int = 50
    #: A line with this many separators for each hundred words is navigation.
    separators: int = 20
    #: A line with this many symbols for each hundred non-space characters fails.
    symbols: int = 8


def _stripped(text: Column, characters: str) -> Column:
    """``text`` without ``characters``; a literal search for each is many times faster than ``translate``."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_stripped(text, characters))


def repeated_words(words: Column) -> Column:
    """Words inside eight-word windows that occur twice or more in ``words``.

    Windows are told apart by a 64-bit hash, built from word hashes in three doublings.
    Texts without a repeated window stop at the count of distinct hashes. Of the others,
    the hashes' lower bits are sorted together with the window's place, neighbours that agree
    there are compared in full, and the words that the equal ones cover are added up.
    """
    w = REPEAT_WINDOW
    tail = lambda a, by: F.slice(a, by + 1, F.size(a))
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    doubled = lambda by: lambda a: F.zip_with(a, tail(a, by), lambda x, y: F.xxhash64(x, y))
    for by in (1, 2, 4):
        hashes = F.transform(F.array(hashes), doubled(by))[0]
    hashes = F.slice(hashes, 1, F.size(words) - w + 1)
    bits = 24  # places below 16 million; longer texts sort whole hashes
    low = F.lit((1 << bits) - 1)
    within = lambda value, body: F.transform(F.array(value), body)[0]
    pairs_of = lambda a, body: F.zip_with(F.slice(a, 1, F.size(a) - 1), tail(a, 1), body)
    place = lambda x: x.bitwiseAND(low)

    def spread(places: Column) -> Column:
        """Words that windows at the sorted, distinct ``places`` cover."""
        gaps = F.zip_with(places, tail(places, 1), lambda i, j: F.least(F.coalesce(j - i, F.lit(w).cast("long")), F.lit(w).cast("long")))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def in_full(h: Column) -> Column:
        """Covered words by sorting whole hashes."""
        sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        equal = lambda s: F.filter(pairs_of(s, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())
        return within(within(sorted_, lambda s: F.sort_array(F.array_distinct(F.flatten(equal(s))))), spread)

    def covered(h: Column) -> Column:
        """Covered words by sorting (lower bits, place) as one long; if other bits ever differ there, in full."""

        def of(packed: Column) -> Column:
            same = F.filter(pairs_of(packed, lambda x, y: F.when(F.call_function("shiftright", x.bitwiseXOR(y), F.lit(bits)) == 0, F.array(place(x), place(y)))), lambda p: p.isNotNull())
            differ = lambda pairs: F.exists(pairs, lambda p: F.get(h, p[0].cast("int")) != F.get(h, p[1].cast("int")))
            return within(same, lambda pairs: F.when(differ(pairs), in_full(h)).otherwise(within(F.sort_array(F.array_distinct(F.flatten(pairs))), spread)))

        packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, F.lit(bits)).bitwiseOR(i.cast("long"))))
        return F.when(F.size(h) < (1 << bits), within(packed, of)).otherwise(in_full(h))

    counted = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))[0]
    return F.when(F.size(words) > w, counted).otherwise(F.lit(0).cast("long"))


def failed_line(line: Column, options: QualityOptions, marks: Column, phrases: Column) -> Column:
    """Whether a line that holds a word fails; ``line`` has no line feed.

    ``marks`` and ``phrases`` tell whether the whole text has a separator or symbol, or a
    phrase of boilerplate; where it has none, its lines are not searched for them.
    """
    ending = F.substring(F.rtrim(line, F.lit(SPACES)), -3, 3)
    no_end = ~ending.rlike("[.!?:;\\u2026\\u3002\\uFF01\\uFF1F][\"')\\]\\u00BB\\u201D\\u2019]*$")
    n_words = F.size(F.split(F.trim(line), "[\\x20\\x09-\\x0D]+"))
    navigation = _count(line, SEPARATORS) * 100 >= n_words * options.separators
    symbols = _count(line, SYMBOLS) * 100 >= F.length(_stripped(line, SPACES)) * options.symbols
    marked = marks & line.rlike(f"[{SYMBOLS}{SEPARATORS}]")
    boilerplate = _any_phrase(F.lower(line))
    return F.when(no_end, True).when(marked & (navigation | symbols), True).when(phrases, boilerplate).otherwise(False)


def _any_phrase(lower: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(p)) for p in BOILERPLATE])


def judged(docs: DataFrame, options: QualityOptions = QualityOptions(), keep: list[str] | None = None) -> DataFrame:
    """Quality figures and verdict for every row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_failed_lines, lost_chars, cleaned, base_failed and kept; ``keep`` names
    further columns of ``docs`` to carry. ``cleaned`` is the text without its failed lines,
    for kept and rejected rows alike; all counts are those of the text before. A null text
    counts as empty: no words, base_failed, not kept. Blank lines are no lines; they stay in
    ``cleaned``. A null doc_id stays null; rows that repeat are judged alike. An empty table
    gives no rows.
    """
    text = or_empty(F.col("text").cast("string"))
    lines = F.split(text, "\n")
    blank = lambda line: F.trim(line, F.lit(SPACES)) == ""
    carried = [c for c in keep or [] if c != "doc_id"]
    within = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  value is computed once

    def counts(x: Column) -> Column:
        held = F.filter(x["l"], lambda line: ~blank(line))
        has = F.struct((_count(x["t"], SYMBOLS + SEPARATORS) > 0).alias("marks"), _any_phrase(F.lower(x["t"])).alias("phrases"))
        return F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.replace(x["s"], F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
            _count(x["t"], SYMBOLS).cast("long").alias("n_symbols"),
            within(held, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"))).alias("held"),
            repeated_words(x["w"]).alias("n_repeat_words"),
            # failed lines become null, which array_join leaves out
            within(has, lambda h: F.transform(x["l"], lambda line: F.when(blank(line) | ~failed_line(line, options, h["marks"], h["phrases"]), line))).alias("left"),
        )

    def verdict(f: Column) -> Column:
        failed = (f["n_words"] < options.least_words) | (F.lit(100) * f["n_repeat_words"] > F.lit(options.most_repeated) * f["n_words"])
        n_failed = F.size(f["left"]) - F.size(F.array_compact(f["left"]))
        cleaned = F.array_join(f["left"], "\n")
        named = lambda c: F.struct(
            *(f[n].alias(n) for n in ("n_words", "word_chars", "n_symbols")),
            f["held"]["dup"].alias("n_dup_lines"),
            f["n_repeat_words"].alias("n_repeat_words"),
            f["held"]["n"].alias("n_lines"),
            n_failed.cast("long").alias("n_failed_lines"),
            (f["word_chars"] - F.length(_stripped(c, SPACES))).alias("lost_chars"),
            c.alias("cleaned"),
            failed.alias("base_failed"),
        )
        return within(within(cleaned, named), lambda v: F.struct(v.alias("v"), (~v["base_failed"] & (v["lost_chars"] * 100 <= v["word_chars"] * options.most_lost)).alias("kept")))

    texts = within(spaced(text), lambda s: F.struct(words_in(s).alias("w"), lines.alias("l"), text.alias("t"), s.alias("s")))
    # one column holds the whole judgement, and it comes from a generator of one row, behind
    # which filters stay, so that a filter on it does not judge the text a second time;
    # internal names cannot clash with carried columns: those are wrapped in one struct
    done = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *([F.struct(*carried).alias("_carried")] if carried else []),
        F.explode(F.array(within(texts, lambda x: within(counts(x), verdict)))).alias("f"),
    )
    return done.select("doc_id", *(["_carried"] if carried else []), "f.v.*", "f.kept")


def clean_documents(docs: DataFrame, options: QualityOptions = QualityOptions()) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts without the failed lines.

    Other columns stay as they are, but ``n_chars``, if there, becomes the new length where
    the text changed.
    """
    judged_rows = judged(docs.select("doc_id", "text", F.struct("*").alias("_row")), options, keep=["_row"])
    out = []
    for c in docs.columns:
        old = F.col("_carried._row").getField(c)
        if c == "text":
            old = F.col("cleaned")
        elif c == "n_chars":
            old = F.when(F.col("n_failed_lines") > 0, F.length("cleaned").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return judged_rows.where("kept").select(out)
