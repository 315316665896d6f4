"""Main text of web pages, boilerplate found by a host's suffix array.

A page becomes a list of text blocks, each with the evidence of its markup. Elements that
name themselves as menu, advert, form, comment and the like are dropped by it. What it
does not settle is decided by repetition: the token streams of a host's pages are
concatenated and sorted into a suffix array, long substrings that occur on several pages
are marked and taken out, and what is unique between them stays. This holds for all
blocks outside the article, on pages with one and without, and for the parts of an
article that stand in an element with a class, an id or a role of their own (share bars,
"read more" lines, sign-offs). Plain paragraphs of the article are the page's own text, so
repeated wording is never taken out of them.

Pages of one host are handled together, in groups of bounded size. A host with more pages
is dealt into as many groups as it needs; their suffix arrays give the distinct substrings
and the pages of each, which are added up over the host by hash, so a substring counts
alike however the pages are dealt. The HTML is parsed before the shuffle, so only text
crosses the network.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Elements whose content is no text.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas head select".split())
#: Elements that are boilerplate by name, wherever they stand.
CHROME = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Elements that end a block.
BLOCK = frozenset(
    "address article aside blockquote body br button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li "
    "legend main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that mark an element as boilerplate.
HINTS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices paywall pagination popup promo promoted related replies reply respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

#: Pages that one task of the suffix arrays has on average.
TASK_PAGES = 1024
#: Groups of a host whose substrings one task adds up, about; a larger host has more such tasks.
BUCKET_GROUPS = 16

#: Of these, the words for what readers write; such a part may be longer than the page's own text.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: First words of a class that says what a page has or lacks, not what an element is.
STATES = frozenset("has no not with without".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class ExtractionOptions:
    #: Bytes of HTML of a host that share a suffix array, about; results do not depend on it.
    group_bytes: int = 1 << 20
    #: Tokens that a repeated substring has at least.
    least_tokens: int = 6
    #: Pages that it occurs on at least.
    least_pages: int = 3


#: How an element says that it is boilerplate: not at all; by words that are part of a longer name; by a name or role of its own; by its element or by being hidden.
PLAIN, PARTLY, NAMED, HARD = range(4)


def attributes_of(tag: str) -> dict[str, str]:
    """Lower-case names and values of a tag's attributes, the first of each name; one without a value has the empty one."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), "".join(values))
    return out


def _sign(name: str, attributes: dict[str, str], inside: bool) -> tuple[int, bool]:
    """What an element says of itself, and whether it speaks of readers' comments; ``inside``: within the article, whose header is its own."""
    if name in CHROME or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.IGNORECASE):
        return HARD, False
    sign, comments = PLAIN, False
    if (name == "header" and not inside) or attributes.get("role", "").lower() in ROLES:
        sign = NAMED
    for token in (*attributes.get("class", "").lower().split(), attributes.get("id", "").lower()):
        words = {w for w in re.split(r"[^a-z]+", token) if w}
        named = words & (HINTS - {"header"} if inside else HINTS)
        if named and re.match("[a-z]*", token)[0] not in STATES:
            sign = max(sign, NAMED if named == words else PARTLY)
            comments |= not COMMENTS.isdisjoint(named)
    return sign, comments


class _Element:
    """An open element: its candidates for boilerplate and articles are linked, so that only these are walked."""

    __slots__ = ("name", "sign", "comments", "is_article", "is_form", "marked", "above", "closed", "article_at", "size", "cleared")

    def __init__(self, name: str, above: _Element | None) -> None:
        self.name, self.above = name, above
        self.sign, self.comments, self.is_article, self.is_form, self.marked = PLAIN, False, False, False, False
        self.closed, self.cleared = False, False
        #: Number of the block at which the first article within begins.
        self.article_at: int | None = None
        #: Characters within.
        self.size = 0

    def upward(self) -> Iterator[_Element]:
        at: _Element | None = self
        while at is not None:
            yield at
            at = at.above

    def drops(self, block: int) -> bool:
        """Whether it takes a block out; an unclosed element ends where an article begins."""
        return self.sign != PLAIN and not self.is_form and not self.cleared and (self.closed or self.article_at is None or block < self.article_at)


def _clear(elements: list[_Element], total: int) -> None:
    """Clears elements that bear a name of boilerplate, but hold the article or, if the name is part of a longer one, most of the text.

    The article is the largest one outside of anything named as boilerplate, if there is one,
    even if that has the name as a part only. One that is named so itself counts only where
    there is no other, if it is not for comments and holds most of the text.
    """
    articles = [e for e in elements if e.is_article and e.size]
    articles = [e for e in articles if e.sign < NAMED] or [e for e in articles if e.sign == NAMED and not e.comments and e.size * 2 > total]
    hidden = lambda e, least: any(o.sign >= least and (o.closed or o.is_article) for o in e.upward() if o is not e)
    free = next((f for least in (PARTLY, NAMED, HARD) if (f := [e for e in articles if not hidden(e, least)])), [])
    best = max(free, key=lambda e: e.size, default=None)
    if best is not None:
        for e in best.upward():
            e.cleared = e.sign in (PARTLY, NAMED)
    for e in elements:
        if e.sign == PARTLY and not e.comments and e.size * 2 > (total if best is None else best.size) and (best is None or best in e.upward()):
            e.cleared = True


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of a page's blocks in order.

    Kind 0: not settled by markup; 1: plain text of the article; 2: boilerplate by markup.
    Character references are decoded, white space of any kind is one space. An end tag
    without its start is ignored. An unclosed element ends with the element around it, and
    one of boilerplate where an article begins. An element that is boilerplate only by its
    class, id or role is kept if it holds the article; one whose class or id has such a word
    as a part (``search-page``) is kept, too, if it holds most of the text. Classes that begin
    with has, no, not, with or without say nothing. A form counts as boilerplate, but not one
    that is put round the article, nor one that holds most text of a page without any.
    """
    if not page:
        return []
    root = _Element("", None)
    # (element, its nearest candidate or article) of what is open, and all candidates and articles
    stack: list[tuple[_Element, _Element]] = [(root, root)]
    linked: list[_Element] = []
    blocks: list[list[tuple[str, _Element, bool, bool]]] = []
    pieces: list[tuple[str, _Element, bool, bool]] = []
    articles = marks = 0

    def text(raw: str) -> None:
        if raw:
            pieces.append((raw, stack[-1][1], articles > 0, marks > 0))

    def flush() -> None:
        if pieces:
            blocks.append(pieces.copy())
            pieces.clear()

    def leave(n: int, name: str) -> None:
        """Ends the innermost ``n`` elements; the outermost of them by its own end tag if it is ``name``."""
        nonlocal articles, marks
        for i, (e, _) in enumerate(stack[-n:]):
            e.closed = i == 0 and e.name == name
            articles -= e.is_article
            marks -= e.marked
        del stack[-n:]

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        name, closing = m[1].lower(), page[m.start() + 1] == "/"
        if name in BLOCK or name in RAW:
            flush()
        if closing:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0].name == name), None)
            if found is not None:
                leave(len(stack) - found, name)
        elif name in RAW:
            # a closing tag ends raw text; without one the rest of the page is raw, but for a head, which the body ends
            stop = re.compile(rf"</{re.escape(name)}\s*>" + (r"|(?=<body\b)" if name == "head" else ""), re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
        elif name not in VOID and not m[0].endswith("/>"):
            if name == "p" and stack[-1][0].name == "p":
                leave(1, "p")
            e = _Element(name, stack[-1][1])
            attributes = attributes_of(m[2]) if m[2] else {}
            e.is_article = name in ("article", "main")
            if name not in ("html", "body"):
                e.sign, e.comments = _sign(name, attributes, articles > 0)
            e.is_form = name == "form" and not articles
            e.marked = articles > 0 and not e.is_article and name in BLOCK and not attributes.keys().isdisjoint(("class", "id", "role"))
            if e.is_article:
                for o in e.above.upward():
                    o.article_at = len(blocks) if o.article_at is None else o.article_at
            link = e if e.sign != PLAIN or e.is_article else e.above
            if link is e:
                linked.append(e)
            stack.append((e, link))
            articles += e.is_article
            marks += e.marked
    flush()
    total = 0
    for block in blocks:
        for raw, link, _, _ in block:
            n = len(raw.strip())
            total += n
            for e in link.upward():
                e.size += n
    _clear(linked, total)
    out: list[tuple[str, int]] = []
    for i, block in enumerate(blocks):
        kept = [p for p in block if not any(e.drops(i) for e in p[1].upward())]
        shown = _SPACE.sub(" ", html.unescape("".join(raw for raw, *_ in kept or block))).strip()
        if shown:
            inside, marked = any(p[2] for p in kept), any(p[3] for p in kept)
            form = any(e.is_form for p in kept for e in p[1].upward())
            out.append((shown, 2 if not kept else (0 if marked else 1) if inside else 3 if form else 0))
    sizes = [sum(len(t) for t, kind in out if kind == k) for k in range(4)]
    formed = 0 if not sizes[1] and sizes[3] > sizes[0] else 2
    return [(t, formed if kind == 3 else kind) for t, kind in out]


def suffix_array(tokens: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``tokens`` by prefix doubling, and the ranks by the first 1, 2, 4, ... up to ``most`` tokens."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while n > 1 and rank.max() < n:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] if width < n else 0
        order = np.lexsort((second, rank))
        key = np.stack([rank[order], second[order]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum((np.diff(key, axis=1) != 0).any(axis=0))])
        width *= 2
        if width <= most:
            levels.append(rank)
        if width >= n:
            break
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common prefix of each suffix in ``order`` and the one before it; 0 for the first.

    With the widest of ``levels`` w tokens wide, lengths of 2 * w - 1 and above count as that.
    """
    n = len(order)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(n, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, rank = 1 << k, levels[k]
        fits = (a + width <= n) & (b + width <= n)
        same = fits & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        out[1:] += same * width
        a, b = a + same * width, b + same * width
    return out


def shared_substrings(tokens: np.ndarray, page: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, pages): which group of equal ``size`` tokens starts at each token, and the distinct pages of each group.

    ``tokens`` has a token of its own after each page, so no substring that repeats spans pages.
    """
    order, levels = suffix_array(tokens, size)
    sorted_group = np.cumsum(common_prefixes(order, levels) < size) - 1
    pairs = np.unique(np.stack([sorted_group, page[order]]), axis=1)[0]
    group = np.empty(len(tokens), dtype=np.int64)
    group[order] = sorted_group
    return group, np.bincount(pairs)


def covered_tokens(starts: np.ndarray, size: int) -> np.ndarray:
    """Which tokens lie within ``size`` tokens from one of the marked ``starts``."""
    n = len(starts)
    edge = np.zeros(n + size + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + size] -= 1
    return np.cumsum(edge)[:n] > 0


def long_stretches(marked: np.ndarray, least: int) -> np.ndarray:
    """``marked`` tokens of one block without stretches of fewer than ``least``, unless all tokens are marked.

    A repeated substring may run on over the next blocks, whose first words are their own.
    """
    if marked.all():
        return marked
    edges = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = np.zeros(len(marked), dtype=bool)
    for a, b in zip(starts, ends):
        out[a:b] = b - a >= least
    return out


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, options: ExtractionOptions) -> np.ndarray:
    """Which tokens lie in a substring of ``least_tokens`` that occurs on ``least_pages`` distinct pages."""
    if len(tokens) <= options.least_tokens:
        return np.zeros(len(tokens), dtype=bool)
    group, pages = shared_substrings(tokens, page, options.least_tokens)
    return covered_tokens(pages[group] >= options.least_pages, options.least_tokens)


@dataclass
class _Stream:
    """The tokens of a group's pages outside their articles, a token of its own after each page."""

    tokens: np.ndarray
    page: np.ndarray
    words: list[str]
    #: First and last place of each page's blocks.
    spans: list[list[tuple[int, int]]]

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the ``size`` tokens from each place, and whether they are all of one page."""
        from xxhash import xxh64_intdigest

        n = len(self.tokens)
        known = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.words] + [0], dtype=np.uint64)
        ahead = np.concatenate([known[np.maximum(self.tokens, -1)], np.zeros(size, dtype=np.uint64)])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([self.tokens < 0, np.ones(size, dtype=bool)]))])
        out = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ahead[i : i + n]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29)), ends[size : size + n] == ends[:n]


def _stream(pages: list[list[tuple[str, int]]]) -> _Stream:
    names: dict[str, int] = {}
    tokens: list[int] = []
    owner: list[int] = []
    spans: list[list[tuple[int, int]]] = []
    for p, parts in enumerate(pages):
        spans.append([])
        for text, kind in parts:
            begin = len(tokens)
            if kind != 1:  # the article's own blocks are kept whatever repeats
                tokens += [names.setdefault(w, len(names)) for w in text.split(" ")]
            spans[-1].append((begin, len(tokens)))
        tokens.append(-1 - p)
        owner += [p] * (len(tokens) - len(owner))
    return _Stream(np.array(tokens, dtype=np.int64), np.array(owner, dtype=np.int64), list(names), spans)


def group_substrings(pages: list[list[tuple[str, int]]], options: ExtractionOptions) -> np.ndarray:
    """Hashes of the distinct substrings of one group, each as often as it has pages, ``least_pages`` times at most."""
    stream = _stream(pages)
    if len(stream.tokens) <= options.least_tokens:
        return np.zeros(0, dtype=np.uint64)
    group, n_pages = shared_substrings(stream.tokens, stream.page, options.least_tokens)
    hashes, whole = stream.hashes(options.least_tokens)
    at = np.flatnonzero(whole)
    found, first = np.unique(group[at], return_index=True)
    return np.repeat(hashes[at[first]], np.minimum(n_pages[found], options.least_pages))


def main_texts(pages: list[list[tuple[str, int]]], options: ExtractionOptions, repeated: np.ndarray | None = None) -> list[str]:
    """The main text of each page of one group; ``repeated``: hashes of what repeats, for a group that is not its whole host."""
    stream = _stream(pages)
    if repeated is None:
        repeats = repeated_tokens(stream.tokens, stream.page, options)
    else:
        hashes, whole = stream.hashes(options.least_tokens)
        repeats = covered_tokens(whole & np.isin(hashes, repeated), options.least_tokens)
    out = []
    for parts, at in zip(pages, stream.spans):
        kept = []
        for (text, kind), (s, e) in zip(parts, at):
            if kind == 1 or (kind == 0 and not repeats[s:e].any()):
                kept.append(text)
            elif kind == 0:
                # the covered stretches go, the unique ones between them stay
                again = long_stretches(repeats[s:e], options.least_tokens)
                kept += [w for w, gone in zip(text.split(" "), again.tolist()) if not gone]
        out.append(" ".join(kept))
    return out


_PARSED = "page_id long, url string, host string, texts array<string>, kinds array<int>, at long"
_RESULT = "page_id long, url string, text string, n_chars long"
_COUNTED = "host string, part long, bucket long, hashes binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0  # a row's place in its task, so that rows that repeat are dealt into different groups
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            found = [blocks_of(h.as_py()) for h in part.column(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    part.column(2),
                    pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[k for _, k in f] for f in found], pa.list_(pa.int32())),
                    pa.array(range(at, at + part.num_rows), pa.int64()),
                ],
                names=["page_id", "url", "host", "texts", "kinds", "at"],
            )
            at += part.num_rows


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and leading ``www.``; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), "^www\\.", "")


def extract(pages: DataFrame, options: ExtractionOptions = ExtractionOptions()) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html).

    The whole of each page is read. Null, empty and text-free pages give an empty text;
    n_chars counts code points. Pages without a host in their URL, null URLs among them,
    share one empty host. Repetition is seen from ``least_pages`` pages of a host on; on a host
    with fewer, markup alone decides. A null page_id stays null; rows that repeat are returned as
    often as they occur, and count as distinct pages. An empty table gives no rows. Other
    columns are not read.
    """
    url = F.col("url").cast("string")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.col("html").cast("string").alias("html"))
    parsed = source.mapInArrow(_parse, _PARSED)
    # hosts of more than one group only: far fewer than pages, and the join's side is chosen by its measured size
    sizes = written(source.groupBy(F.col("host").alias("big_host")).agg(F.sum(F.octet_length("html")).alias("bytes")).where(F.col("bytes") > options.group_bytes))
    groups = F.ceil(F.coalesce("bytes", F.lit(1)) / F.lit(options.group_bytes)).cast("long")
    dealt = parsed.join(sizes, parsed.host == F.col("big_host"), "left").withColumn("groups", groups).withColumn("part", F.pmod(F.xxhash64("page_id", "url", "at"), "groups")).drop("big_host", "bytes", "at")

    def blocks(pdf: pd.DataFrame) -> list[list[tuple[str, int]]]:
        return [list(zip(t, k)) for t, k in zip(pdf["texts"], pdf["kinds"])]

    def texts_of(pdf: pd.DataFrame, repeated: np.ndarray | None) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_id", "url"], kind="stable", na_position="last")
        texts = main_texts(blocks(pdf), options, repeated)
        return pd.DataFrame({"page_id": pdf["page_id"].astype("Int64").to_numpy(), "url": pdf["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts]})

    def substrings(pdf: pd.DataFrame) -> pd.DataFrame:
        n, rows = int(pdf["groups"].iloc[0]), []
        if n > 1:
            hashes = group_substrings(blocks(pdf), options)
            buckets = -(-n // BUCKET_GROUPS)
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            rows = [(pdf["host"].iloc[0], pdf["part"].iloc[0], b, hashes[bucket == b].tobytes()) for b in np.unique(bucket).tolist()]
        return pd.DataFrame(rows, columns=["host", "part", "bucket", "hashes"])

    def over_host(pdf: pd.DataFrame) -> pd.DataFrame:
        """What repeats over the host, given back to each group that has it."""
        parts = [np.frombuffer(h, dtype=np.uint64) for h in pdf["hashes"]]
        values, times = np.unique(np.concatenate(parts), return_counts=True)
        named = values[times >= options.least_pages]
        return pdf.assign(hashes=[np.intersect1d(p, named).tobytes() for p in parts])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return texts_of(pdf, None)

    def run_with(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return texts_of(pdf, None if pdf["groups"].iloc[0] == 1 else np.frombuffer(b"".join(found["hashes"]), dtype=np.uint64))

    # the number of tasks follows the pages, so a task's share stays the same at any size
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pages.select(F.lit(1)).count() // TASK_PAGES))
    # both readers of the dealt pages use one shuffle: the plan has it once and reuses it
    spread = dealt.repartition(tasks, "host", "part").groupBy("host", "part")
    if sizes.isEmpty():
        return spread.applyInPandas(run, _RESULT)
    counted = spread.applyInPandas(substrings, _COUNTED).groupBy("host", "bucket").applyInPandas(over_host, _COUNTED)
    return spread.cogroup(counted.groupBy("host", "part")).applyInPandas(run_with, _RESULT)
