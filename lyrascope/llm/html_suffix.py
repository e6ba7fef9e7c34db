"""Main text of web pages, with boilerplate found by host suffix arrays (operator 4).

A page becomes blocks of text.  Elements that are never part of an article (menus, forms,
scripts and the like, by their name, role or class) are left out, and if a page marks its
article, only the blocks inside count.

The pages of a host are put one after the other as a stream of words, and a suffix array is
sorted by prefix doubling to a depth of RUN words: positions of equal rank begin the same run of
RUN words, so its distinct pages are counted.  A run on more than half of a host's pages, and on
LEAST_PAGES at least, is boilerplate wherever it stands, also inside a marked article: its words
go, and the unique runs between them stay.  Runs on fewer pages are quotations, passages and
mirrors, which are text.  A page whose text is boilerplate to COPY_PERCENT or more is a copy of
the host's other pages and stays whole.

Pages are sorted by host and taken in shards of at most SHARD_BYTES.  A run on more than half of
all pages of a host is on more than half of them in one of its shards, so the shards propose
all such runs, and only what is proposed for a host of several shards is counted on its pages
again.  The result does not depend on how pages are dealt.
"""

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrascope.llm.shared import map_arrow, written
from lyrascope.llm.text import chunks
from lyrascope.operators.skew import salted_join

RUN = 8
SHARD_BYTES = 4 << 20

# Pages of a host that share a run of boilerplate, at least.
LEAST_PAGES = 3

# A page with so much boilerplate is a copy.
COPY_PERCENT = 90

# Runs (a host and 8 bytes) that may be broadcast.
BROADCAST_RUNS = 500_000

# Elements whose content is no text at all.
RAW = frozenset(
    "script style template noscript iframe object svg math textarea title canvas".split()
)

# Elements that are never part of an article.
OUTSIDE = frozenset(
    "nav footer header aside form button select dialog menu head fieldset datalist".split()
)

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# Elements inside a line; all others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)

# Roles and words of classes and ids of elements that are never part of an article.
OUTSIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert".split()
)
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright dialog disqus feedback footer form header login masthead "
    "menu modal nav navbar navigation newsletter notice notification pager pagination popup promo "
    "promotion related reply replies respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())

START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(
    r"""(?<![^\s"'])(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I
)
MAIN_ROLE = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
WORD = re.compile(r"[a-z]+")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")


@dataclass
class Page:
    """Blocks of a page outside all that is never article, and whether an article marks them."""

    blocks: list[str] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)


def _outside(name: str, attributes: str) -> bool:
    """Whether an element is never part of an article."""
    if name in OUTSIDE:
        return True
    if not attributes or name in ("html", "body"):
        return False
    words = COMMENT_WORDS if name in ("article", "main") else OUTSIDE_WORDS
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "role" and value in OUTSIDE_ROLES:
            return True
        if key in ("class", "id") and not words.isdisjoint(WORD.findall(value)):
            return True
    return False


@dataclass
class Source:
    """The markup of a page, read once from its start to its end."""

    text: str
    place: int = 0
    quoted: bool = True  # False from a quotation on that hides all further ends of tags

    def tag_end(self, start: int) -> int:
        """Place of the > that ends a tag, which may stand in quotation marks before; or -1."""
        if self.quoted:
            at = start
            while (stop := STOP.search(self.text, at)) is not None:
                if stop[0] == ">":
                    return stop.start()
                close = self.text.find(stop[0], stop.end())
                if close < 0:
                    break
                at = close + 1
            self.quoted = False
        return self.text.find(">", start)

    def after(self, mark: str, start: int) -> int:
        """Place behind the next ``mark``, or the end."""
        found = self.text.find(mark, start)
        return len(self.text) if found < 0 else found + len(mark)

    def skip(self, name: str) -> None:
        """Go behind the end of an element that holds no markup."""
        end = re.compile(rf"</{name}\b", re.I).search(self.text, self.place)
        self.place = self.after(">", end.end()) if end else len(self.text)

    def tags(self) -> Iterator[tuple[str, str, bool, str]]:
        """Text before a tag, the tag's name (empty for none), whether it closes, attributes."""
        while (tag := START.search(self.text, self.place)) is not None:
            before = self.text[self.place : tag.start()]
            if tag[1]:
                self.place = self.after("-->", tag.end())
                yield before, "", False, ""
                continue
            end = self.text.find(">", tag.end()) if tag[2] else self.tag_end(tag.end())
            if end < 0:
                break
            self.place = end + 1
            yield before, (tag[4] or "").lower(), bool(tag[3]), self.text[tag.end() : end]
        yield self.text[self.place :], "", False, ""


def blocks_of(source: str) -> Page:
    """Parse one page; unclosed elements end with those around them."""
    page, stack, parts = Page(), [], []
    opened: Counter[str] = Counter()
    outside = marked = 0  # open elements of either kind

    def flush() -> None:
        text = BLANKS.sub(" ", html.unescape("".join(parts))).strip("\x20\x09\x0a\x0b\x0c\x0d")
        parts.clear()
        if text:
            page.blocks.append(text)
            page.marked.append(marked > 0)

    reader = Source(source)
    for before, name, closes, attributes in reader.tags():
        if not outside:
            parts.append(before)
        if not name:
            continue
        if name == "br" and not outside:
            parts.append(" ")
        if name not in INLINE and not outside:
            flush()
        if not closes:
            if name in RAW:
                reader.skip(name)
            elif name not in VOID and not attributes.endswith("/"):
                away = _outside(name, attributes)
                body = name in ("article", "main") or MAIN_ROLE.search(attributes) is not None
                if away and not outside:
                    flush()
                stack.append((name, away, body))
                opened[name] += 1
                outside += away
                marked += body
        elif opened[name]:
            while True:
                open_name, away, body = stack.pop()
                opened[open_name] -= 1
                outside -= away
                marked -= body
                if open_name == name:
                    break
    if not outside:
        flush()
    return page


@dataclass
class Stream:
    """Words of the blocks of some pages, one after the other."""

    words: list[str]
    page: np.ndarray  # by word

    @classmethod
    def of(cls, pages: list[Page]) -> "Stream":
        own = [[w for block in page.blocks for w in block.split(" ")] for page in pages]
        sizes = np.array([len(words) for words in own], np.int64)
        return cls([w for words in own for w in words], np.repeat(np.arange(len(own)), sizes))

    def codes(self) -> np.ndarray:
        """64 bits of hash of each word."""
        of = {w: xxhash.xxh3_64_intdigest(w) for w in set(self.words)}
        return np.array([of[w] for w in self.words], np.uint64)

    def runs(self, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run of words inside one page starts, and the runs' hashes."""
        starts = np.arange(max(len(self.words) - run + 1, 0))
        starts = starts[self.page[starts] == self.page[starts + run - 1]] if len(starts) else starts
        codes, made = self.codes(), np.zeros(len(starts), np.uint64)
        for k in range(run):
            made = (made ^ codes[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
            made ^= made >> np.uint64(29)
        return starts, made.view(np.int64)


def distinct_pages(words: list[str], page: np.ndarray, run: int = RUN) -> np.ndarray:
    """By word, the number of pages that hold the run that starts there; 0 where none starts.

    ``page`` has the page of each word, in ascending order.
    """
    n = len(words)
    found = np.zeros(n, np.int64)
    if n < run:
        return found
    # Sort suffixes by their first 1, 2, 4 ... words; runs end with their page.
    numbers: dict[str, int] = {}
    rank = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        at = np.arange(n)
        after = np.minimum(at + step, n - 1)
        last = np.minimum(at + step + depth - 1, n - 1)
        # A suffix that is too short for its page is like no other.
        inside = (at + step + depth <= n) & (page[last] == page)
        key = np.where(inside, rank * (int(rank.max()) + 2) + rank[after] + 1, -1 - at)
        rank = np.unique(key, return_inverse=True)[1]
        depth += step
    order = np.argsort(rank, kind="stable")
    sorted_rank, sorted_page = rank[order], page[order]
    new_run = np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]
    first = np.flatnonzero(new_run)
    new_page = new_run | np.r_[True, sorted_page[1:] != sorted_page[:-1]]
    pages = np.add.reduceat(new_page.astype(np.int64), first)
    found[order] = np.repeat(pages, np.diff(np.r_[first, n]))
    at = np.arange(n)
    found[(at + run > n) | (page[np.minimum(at + run - 1, n - 1)] != page)] = 0
    return found


def covered(n: int, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which of n words are in a run that starts at one of the places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + run, -1)
    return np.cumsum(change[:n]) > 0


def main_text(page: Page, flags: np.ndarray) -> tuple[str, int]:
    """Text of the article, and its words that are boilerplate by ``flags`` of all words."""
    cuts = np.cumsum([b.count(" ") + 1 for b in page.blocks])
    parts = np.split(flags, cuts[:-1]) if page.blocks else []
    own = [
        (block, flag)
        for block, flag, marked in zip(page.blocks, parts, page.marked, strict=True)
        if marked or not any(page.marked)
    ]
    repeated = sum(int(flag.sum()) for _, flag in own)
    if 100 * repeated >= COPY_PERCENT * sum(len(flag) for _, flag in own):
        return "\n\n".join(block for block, _ in own), repeated
    kept = []
    for block, flag in own:
        text = block
        if flag.any():
            text = " ".join(w for w, f in zip(block.split(" "), flag, strict=True) if not f)
        if text:
            kept.append(text)
    return "\n\n".join(kept), repeated


def host() -> Column:
    return F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


PROPOSED = "host string, run long, n long, pages long"


def _proposed(host: str, sources: list[str]) -> pa.RecordBatch:
    """Runs on more than half of a shard's pages, with their pages and those of the shard."""
    stream = Stream.of([blocks_of(source) for source in sources])
    pages = distinct_pages(stream.words, stream.page)
    starts, hashes = stream.runs()
    n = pages[starts]
    often = 2 * n > len(sources)
    runs, at = np.unique(hashes[often], return_index=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([host] * len(runs), pa.string()),
            pa.array(runs, pa.int64()),
            pa.array(n[often][at], pa.int64()),
            pa.array(np.full(len(runs), len(sources)), pa.int64()),
        ],
        ["host", "run", "n", "pages"],
    )


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, of = [], 0, None
    for chunk in chunks(batches, "html"):
        columns = (chunk.column(c).to_pylist() for c in ("host", "html"))
        for name, source in zip(*columns, strict=True):
            if held and (name != of or size > SHARD_BYTES):
                yield _proposed(of, held)
                held, size = [], 0
            held.append(source or "")
            of = name
            size += len(source or "")
    if held:
        yield _proposed(of, held)


def _known(chunk: pa.RecordBatch) -> tuple[list[Page], Stream, np.ndarray, np.ndarray]:
    """Pages of a chunk, their words, and the starts and hashes of runs in the page's ``runs``."""
    pages = [blocks_of(source or "") for source in chunk.column("html").to_pylist()]
    known = [np.array(r or [], np.int64) for r in chunk.column("runs").to_pylist()]
    stream = Stream.of(pages)
    if not any(map(len, known)):
        return pages, stream, np.empty(0, np.int64), np.empty(0, np.int64)
    starts, hashes = stream.runs()
    bounds = np.searchsorted(stream.page[starts], np.arange(len(pages) + 1))
    found = [
        np.isin(hashes[a:b], own) if len(own) else np.zeros(b - a, bool)
        for own, a, b in zip(known, bounds[:-1], bounds[1:], strict=True)
    ]
    hit = np.concatenate(found)
    return pages, stream, starts[hit], hashes[hit]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages by host and known run."""
    for chunk in chunks(batches, "html"):
        _, stream, starts, hashes = _known(chunk)
        hosts = chunk.column("host").to_pylist()
        seen = set(zip(stream.page[starts].tolist(), hashes.tolist(), strict=True))
        counts = Counter((hosts[page], run) for page, run in seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([host for host, _ in counts], pa.string()),
                pa.array([run for _, run in counts], pa.int64()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["host", "run", "n"],
        )


SCHEMA = "page_id long, url string, text string, n_chars long, n_repeated_words long"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, "html"):
        pages, stream, starts, _ = _known(chunk)
        flags = covered(len(stream.words), starts)
        bounds = np.searchsorted(stream.page, np.arange(1, len(pages)))
        made = [main_text(*own) for own in zip(pages, np.split(flags, bounds), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                chunk.column("page_id"),
                chunk.column("url"),
                pa.array([text for text, _ in made], pa.string()),
                pa.array([len(text) for text, _ in made], pa.int64()),
                pa.array([n for _, n in made], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars", "n_repeated_words"],
        )


def _with_runs(rows: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Rows with the array of their host's runs (host, run); broadcast if there are few."""
    by_host = runs.groupBy("host").agg(F.collect_list("run").alias("runs"))
    if runs.count() <= BROADCAST_RUNS:
        return rows.join(F.broadcast(by_host), "host", how)
    return salted_join(rows, by_host, ["host"], "page_id", how)


def boilerplate(rows: DataFrame) -> DataFrame:
    """host and run (a hash of RUN words) on more than half of a host's pages.

    Rows are (host, page_id, html).
    """
    totals = rows.groupBy("host").agg(F.count("*").alias("total"))
    keys = ["host", F.xxhash64("page_id")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions("host")
    found = map_arrow(dealt, _propose, PROPOSED).groupBy("host", "run")
    proposed = written(
        found.agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
        .join(totals, "host")
        .filter(F.col("total") >= LEAST_PAGES),
        "proposed",
    )
    often = (2 * F.col("n") > F.col("total")) & (F.col("n") >= LEAST_PAGES)
    # What all shards of a host have proposed is counted already.
    whole = F.col("pages") == F.col("total")
    counted = proposed.filter(whole & often).select("host", "run")
    left = proposed.filter(~whole)
    again = map_arrow(
        _with_runs(rows, left.select("host", "run"), "inner"),
        _count,
        "host string, run long, n long",
    )
    summed = again.groupBy("host", "run").agg(F.sum("n").alias("n"))
    more = summed.join(left.select("host", "run", "total"), ["host", "run"]).filter(often)
    return counted.unionByName(more.select("host", "run"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_repeated_words of pages (page_id, url, html).

    NULL and empty pages have an empty text; pages with a NULL or odd url share one host;
    repeated rows are pages of their own; further columns are left out.  Pages are shuffled
    once, by ranges of host and a hash of the page, so that large hosts are split; they are
    parsed again for the result, as the runs of boilerplate are few.
    """
    rows = pages.select(
        F.coalesce(host(), F.lit("")).alias("host"),
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
    )
    runs = written(boilerplate(rows.drop("url")), "boilerplate")
    return map_arrow(_with_runs(rows, runs, "left"), _texts, SCHEMA)
