"""Secret scanning by base patterns and sliding-window entropy, by DataFrame functions only.

Base patterns give spans by kind. Beside them, maximal runs of token characters are
candidates: a window slides over each, the counts of its characters are kept up to
date as one character enters and one leaves, and so is the sum that Shannon's entropy
needs. Each window is held to the threshold of its own class (hex digits, letters and
digits, or signs too), so a key of hex digits is seen within a longer, mixed string. A
candidate is reported where a window reaches its threshold, unless an allow-list pattern
explains the string.

All work stays within a row; positions come from splitting the text at the pattern, so
they are exact for every match. Rows that a cheap test clears are never split.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import or_empty

#: Base kinds in their order: name, pattern, group that must be long enough, its least length.
BASE = (
    ("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
KINDS = ("assign", "access", "hex", "entropy")
#: Code points of the pieces that a redacted text is put together from.
PIECE = 256
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class EntropyOptions:
    window: int = 20
    #: Least bits a character in the best window, by class: hex digits; letters and digits; with signs too.
    thresholds: tuple = (("hex", 2.9), ("alnum", 3.6), ("base64", 3.8))
    #: Strings that are explained: no digit, one case of letters without digits, repeated units, UUIDs, dotted or dashed words.
    allow: tuple = field(
        default=(
            "^[^0-9]*$",
            "^[0-9_=+/-]*$",
            "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
            "^(?:[A-Za-z]+[-_/=+])+[A-Za-z]*[0-9]{0,4}$",
            "(?i)(example|sample|dummy|placeholder|changeme|xxxx)",
        )
    )


def _running(values: Column, join) -> Column:
    """``join`` of each element with all before it, for an associative ``join`` of two columns.

    Each step joins every element with the one 1, 2, 4, ... places before it, so a text of n
    matches takes n * log2(n) joins, where appending to an array would copy it n times.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def widened(state: Column, k: Column) -> Column:
        by = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(state, lambda v, i: F.when(i >= by, join(F.get(state, i - by), v)).otherwise(v))

    return F.aggregate(steps, values, widened)


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Spans (start, end, rank, body) of all matches, positions in code points from 0, end exclusive.

    The pieces between matches and the matches alternate, so running lengths are positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    columns = F.struct(found.alias("found"), counted.alias("counted"), F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        sizes = F.zip_with(x["found"], F.slice(x["gaps"], 1, F.size(x["found"])), lambda m, gap: F.length(m) + F.length(gap))

        def spans(ends: Column) -> Column:
            every = F.transform(
                x["found"],
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"),
                    F.get(ends, i).alias("end"),
                    F.lit(KINDS.index(kind)).alias("rank"),
                    F.when(F.length(F.get(x["counted"], i)) >= least, m).alias("body"),
                ),
            )
            return F.filter(every, lambda s: s["body"].isNotNull())

        return _bound(_running(sizes, lambda a, b: a + b), spans)

    return _bound(columns, placed)


def best_margin(token: Column, window: int, thresholds: tuple) -> Column:
    """The most by which a window of ``token`` exceeds its class's threshold, in bits of Shannon entropy a character.

    A window has ``window`` characters, or the whole token if that is shorter. The state
    holds the count of each character of the alphabet, as bit fields of a few longs, the
    sum of n * log2(n) over them, and where the last letter, the last sign and the last
    character that is no hex digit stand, which tell a window's class: hex digits with a
    letter among them, letters and digits, or any. A step adds the entering and takes off the
    leaving character.
    """
    limits = dict(thresholds)
    bits = max(1, window.bit_length())  # a count is at most the window
    fields = 63 // bits
    words = range(-(-(len(ALPHABET) + 1) // fields))
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    codes_of = F.transform(letters, lambda c: F.position(c, F.lit(ALPHABET)))
    part = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    zero = F.struct(*(F.lit(0).cast("long").alias(f"c{j}") for j in words), F.lit(0.0).alias("total"), F.lit(0).alias("at"), F.lit(-99.0).alias("best"), F.lit(-1).alias("no_hex"), F.lit(-1).alias("letter"), F.lit(-1).alias("sign"))

    # where a character's count is: the long, the bits it is shifted by, and a count of one there
    digits, hex_letters, signs = ([ALPHABET.index(c) + 1 for c in part] for part in ("0123456789", "ABCDEFabcdef", "+/_=-"))
    places = F.transform(
        codes_of,
        lambda c: F.struct(
            F.floor(c / fields).cast("int").alias("j"), (c % fields * bits).alias("by"), F.call_function("shiftleft", F.lit(1).cast("long"), c % fields * bits).alias("one"), c.isin(digits + hex_letters).alias("hex"), c.isin(digits).alias("digit"), c.isin(signs).alias("sign")
        ),
    )

    def count(s: Column, place: Column) -> Column:
        held = s[f"c{words[-1]}"]
        for j in reversed(words[:-1]):
            held = F.when(place["j"] == j, s[f"c{j}"]).otherwise(held)
        return F.call_function("shiftright", held, place["by"]).bitwiseAND(F.lit((1 << bits) - 1)).cast("double")

    def run(at: Column) -> Column:
        size = F.least(F.size(at), F.lit(window))

        def step(s: Column, entering: Column) -> Column:
            def moved(x: Column) -> Column:
                out, n = x["out"], x["n"]
                full = out.isNotNull()
                share = lambda place, j: F.when(place["j"] == j, place["one"]).otherwise(0)
                counts = [(s[f"c{j}"] + share(entering, j) - share(out, j)).alias(f"c{j}") for j in words]
                gone = x["gone"] + F.when(out == entering, 1.0).otherwise(0.0)
                total = s["total"] + part(n + 1) - part(n) - F.when(full, part(gone) - part(gone - 1)).otherwise(0.0)
                latest = {n: F.when(is_one, s["at"]).otherwise(s[n]).alias(n) for n, is_one in (("no_hex", ~entering["hex"]), ("letter", ~entering["digit"] & ~entering["sign"]), ("sign", entering["sign"]))}
                return F.struct(*counts, total.alias("total"), (s["at"] + 1).alias("at"), s["best"].alias("best"), *latest.values())

            def scored(e: Column) -> Column:
                begin = e["at"] - size
                limit = F.when((e["no_hex"] < begin) & (e["letter"] >= begin), limits["hex"]).when(e["sign"] < begin, limits["alnum"]).otherwise(limits["base64"])
                return F.when(begin < 0, e).otherwise(e.withField("best", F.greatest(e["best"], F.log2(size) - e["total"] / size - limit)))

            out = F.get(at, s["at"] - window)
            return _bound(_bound(F.struct(count(s, entering).alias("n"), out.alias("out"), count(s, out).alias("gone")), moved), scored)

        return F.aggregate(at, zero, step, lambda s: s["best"])

    return _bound(places, run)


def _apart(base: Column, more: Column) -> Column:
    """The spans of ``more`` that touch no span of ``base``.

    Base spans by start and others by end go into one order; the latest end of the base
    spans before a span's end tells whether one of them reaches into it.
    """
    none = F.lit(None).cast("struct<start:int,end:int,rank:int,body:string>")
    marks = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("order"), b["end"].alias("reach"), none.alias("span")))
    asked = F.transform(more, lambda m: F.struct(m["end"].alias("at"), F.lit(0).alias("order"), F.lit(0).alias("reach"), m.alias("span")))

    def free(events: Column) -> Column:
        reach = _running(F.transform(events, lambda e: e["reach"]), lambda a, b: F.greatest(a, b))
        kept = lambda r: F.filter(F.transform(events, lambda e, i: F.when(F.get(r, i) <= e["span"]["start"], e["span"])), lambda m: m.isNotNull())
        return _bound(reach, kept)

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(_bound(F.sort_array(F.concat(marks, asked)), free))


def _entropy_spans(text: Column, base: Column, options: EntropyOptions) -> Column:
    """Candidates that touch no base span, are not allowed and have a window that reaches its class's entropy."""
    runs = _matches(text, f"[A-Za-z0-9+/_=-]{{{options.window},}}", 0, options.window, "entropy")

    def hot(s: Column) -> Column:
        return F.when(_any(s["body"], options.allow), False).otherwise(best_margin(s["body"], options.window, options.thresholds) >= 0)

    return F.filter(_apart(base, runs), hot)


def _any(body: Column, patterns: tuple) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | body.rlike(p)
    return out


def _spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by the kinds' order."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans_of(text: Column, options: EntropyOptions = EntropyOptions()) -> Column:
    """Array of struct(start, end, rank, body) for ``text``: base spans, then entropy spans outside them."""
    none = F.array().cast("array<struct<start:int,end:int,rank:int,body:string>>")
    base = F.concat(*(F.when(text.rlike(p), _matches(text, p, g, n, k)).otherwise(none) for k, p, g, n in BASE))
    more = lambda found: F.when(text.rlike(f"[A-Za-z0-9+/_=-]{{{options.window},}}"), _entropy_spans(text, found, options)).otherwise(none)
    return _bound(base, lambda found: F.concat(found, more(found)))


def scan(docs: DataFrame, options: EntropyOptions = EntropyOptions()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans for every row of ``docs`` (doc_id, text).

    Positions are code points from 0, ends exclusive. A null text counts as empty and has
    no spans; the hash is then that of the empty string. A null doc_id stays null, rows
    that repeat are scanned alike, an empty table gives no rows. Base matches of one kind
    never overlap; those of different kinds may. An entropy span that touches a base span
    is not added. Other columns are not read.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans_of(or_empty(F.col("text").cast("string")), options).alias("s"))
    of = lambda rank: F.size(F.filter("s", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("s", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id",
        *(of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(F.encode(_spelled(base), "UTF-8"), 256).alias("base_sha256"),
        _spelled(F.col("s")).alias("spans"),
    )


def redact(docs: DataFrame, options: EntropyOptions = EntropyOptions(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; all rows and columns stay.

    Overlapping spans are replaced once, from the first start to the last end. ``n_chars``,
    if there, becomes the new length where the text changed.
    """
    text = F.col("text").cast("string")
    ordered = lambda spans: F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    # a stretch of the text is put together from short pieces, so none is searched from the text's start
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def stretch(parts: Column, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        head = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        inner = F.when(last - first > 1, F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise("")
        within = F.substring(head(first), begin % PIECE + 1, end - begin)
        return F.when(first == last, within).otherwise(F.concat(F.substring(head(first), begin % PIECE + 1, F.lit(PIECE)), inner, F.substring(head(last), F.lit(1), end % PIECE)))

    def cut(x: Column) -> Column:
        def joined(reach: Column) -> Column:
            behind = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            kept = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= behind(i), stretch(x["parts"], behind(i), s["start"])))
            tail = stretch(x["parts"], F.element_at(reach, -1), F.length(text))
            return F.array_join(F.concat(kept, F.array(tail)), mark)  # array_join leaves out spans that reach into others

        return _bound(_running(F.transform(x["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b)), joined)

    changed = _bound(spans_of(text, options), lambda spans: F.when(F.size(spans) > 0, _bound(F.struct(ordered(spans).alias("spans"), pieces.alias("parts")), cut)))
    columns = docs.columns
    found = docs.select(F.struct("*").alias("row"), F.when(F.col("text").isNotNull(), changed).alias("new"))
    out = []
    for c in columns:
        old = F.col("row").getField(c)
        if c == "text":
            old = F.coalesce("new", old)
        elif c == "n_chars":
            old = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return found.select(out)
