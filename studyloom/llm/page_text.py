"""HTML extraction: the main text of pages, by their markup and by what a host repeats.

A page becomes a stream of words, block after block. Scripts, styles, menus, footers, sidebars,
forms, adverts, notices and comments go by their element, role, class or id; of a header inside
an article the headings stay. If there is an ``article`` the stream is what stands in articles,
else in ``main``, else in an element named like one, else all blocks that aren't links alone.

Then the streams of a host are concatenated and their suffix array is built (ranks by prefix
doubling; suffixes that are alone in their rank go no further). Its intervals with a common
prefix of ``LEAST_WORDS`` words are strings that pages repeat. What OPEN_SHARE of the host's distinct
streams (OPEN_PAGES at least) have is boilerplate: its words go from pages without an article
or main element, and the runs between them stay. Inside those elements text is trusted: a whole
block goes, and only if ARTICLE_SHARE of the streams (ARTICLE_PAGES at least) have all of it. So copies
of a page, and passages that some articles share, stay.

A host with much text is dealt into shards by a hash of the stream (equal streams meet, and count
once; tasks send one of those they hold). Each shard has its own suffix array; windows that have
the least share in one of them are counted in all of them, so a host's counts are exact whatever
its size. Words are 16-bit hashes in the streams, windows 64-bit ones of those. Windows
of a host go to tasks for at most PASS_WINDOWS in all; more take several passes over hosts.

A null page, or one without text, has an empty text. Each row gets a row; repeated page_ids are
separate pages. Pages without a readable host count as one host. Unclosed and stray tags are
closed as browsers do. Other columns are ignored; an empty table gives no rows. A very long page
is one row of one task.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm._store import keep, rows_of
from studyloom.llm._text import NOT_SPACE, Words, chain, mix, slices, text_bytes

LEAST_WORDS = 12
OPEN_SHARE, OPEN_PAGES = 0.3, 3
ARTICLE_SHARE, ARTICLE_PAGES = 0.8, 10
SHARD_BYTES = 2 << 20
PASS_WINDOWS = 1 << 20
SEEN = 1 << 16

_RAW = "script style textarea title xmp iframe noembed noframes"
_VALUES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|=)*+"""
_TAG = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comment
    rf"|<(?:{_RAW.replace(' ', '|')})(?=[\s/>]){_VALUES}(?:\Z|>)"  # start of raw text; its end is sought apart
    rf"|<[!?][^>]*+(?:>|\Z)|</[^a-z>][^>]*+(?:>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*+)({_VALUES})(?:>|\Z)",
    re.I | re.S,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in _RAW.split()}
_NAME = re.compile("[a-z]+", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SINGLE = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles that never hold main text.
GONE = frozenset("audio button canvas datalist dialog fieldset footer form head label menu map nav noscript object optgroup option select svg template video aside".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or an id of elements beside the text, and of those whose articles aren't the page's own.
BESIDE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar rail widget widgets banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social footer copyright toolbar search skip".split()
)
OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted promotion comment comments disqus respond "
    "reply replies related recommended recommendations trending".split()
)
TOP = frozenset("header masthead".split())
WHOLE = frozenset("html body article main".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
_P, _NONE = frozenset({"p"}), frozenset()
ARTICLE, MAIN, NAMED = 4, 2, 1


@lru_cache(4096)
def _role(tag: str, attributes: str) -> tuple[str, int]:
    """What an element is: "" (nothing special), "beside", "others" (gone with all in it) or "top"; and its kind of container."""
    if tag in GONE:
        return ("beside" if tag == "form" else "others"), 0
    given = {}
    for k, *v in _ATTRIBUTE.findall(attributes) if attributes else ():
        given.setdefault(k.lower(), references.unescape("".join(v)))
    style = given.get("style", "").replace(" ", "").lower()
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return "others", 0
    role = given.get("role", "").lower().strip()
    if role in GONE_ROLES and tag not in WHOLE:
        return ("top" if role == "banner" else "others"), 0
    names = [{w.lower() for w in _WORD.findall(n)} for n in (given.get("class", "") + " " + given.get("id", "")).split()]
    names = [n for n in names if not n & {"has", "with", "no", "without", "free"}]
    if tag not in ("html", "body") and any(n and n <= OTHERS if tag in WHOLE else n & OTHERS for n in names):
        return "others", 0
    if tag == "article" or role == "article":
        return "", ARTICLE
    if tag == "main" or role == "main":
        return "", MAIN
    if tag in WHOLE:
        return "", 0
    if tag == "header" or tag in BLOCKS - HEADINGS - {"p"} and any(n & TOP for n in names):
        return "top", 0
    if any(n & BESIDE for n in names):
        return "beside", 0
    body = given.get("itemprop", "").lower() == "articlebody" or any(n & {"article", "entry", "post", "story"} and n & {"body", "content", "text"} for n in names)
    return "", NAMED if body else 0


def page_blocks(html: str | None) -> tuple[list[str], bool]:
    """The texts of a page's blocks, and whether they stand in an article or main element."""
    found: list[tuple[str, int, bool]] = []
    piece: list[str] = []
    #: Open elements as (tag, containers it stands in, "" or why its text goes); inline ones only if their text goes.
    stack: list[tuple[str, int, str]] = [("", 0, "")]
    link, text_outside = False, False

    def flush() -> None:
        nonlocal text_outside
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                found.append((text, stack[-1][1], not text_outside))
            piece.clear()
        text_outside = False

    def close(names: frozenset, limit: frozenset) -> None:
        """The end of the innermost open element of these names, unless one of the limit stands between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in limit:
                return

    def say(segment: str) -> None:
        nonlocal text_outside
        tag, within, why = stack[-1]
        if why == "" or why == "top" and within and tag in HEADINGS:
            piece.append(references.unescape(segment) if "&" in segment else segment)
            text_outside |= not link and not segment.isspace()

    html, at = html or "", 0
    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            raw = _NAME.match(html, m.start() + 1)
            if raw and html[at - 1] == ">":  # raw text up to its end tag
                ended = _RAW_END[raw[0].lower()].search(html, at)
                at = ended.end() if ended else len(html)
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if block:
            flush()
        elif tag == "a":
            link = not m[1]
        if m[1]:
            if block:
                link = False
            close(frozenset({tag}), _NONE if block else BLOCKS)
            continue
        if tag in SINGLE:
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            stack.pop()
        if block:
            close(_P, BLOCKS)
            if tag in CLOSES:
                close(*CLOSES[tag])
        what, container = _role(tag, m[3])
        _, within, why = stack[-1]
        if container & (ARTICLE | MAIN) and why in ("beside", "top"):
            why = ""  # it was a wrapper around the text itself
        elif what and why != "others" and (what != "top" or not why):
            why = what
        if block or why and why != stack[-1][2]:
            stack.append((tag, within | container, why))
    flush()
    for kind in (ARTICLE, MAIN, NAMED):
        if any(k & kind for _, k, _ in found):
            return [t for t, k, _ in found if k & kind], kind != NAMED
    return [t for t, _, linked in found if not linked], False


class Streams:
    """The words of a slice's pages: 16-bit tokens, and where blocks and pages begin."""

    def __init__(self, pages: list[tuple[list[str], bool]]):
        self.inside = np.array([i for _, i in pages], bool)
        data, offsets = text_bytes(pa.array([t for texts, _ in pages for t in texts], pa.large_string()))
        words = Words(data, offsets, NOT_SPACE)
        self.data, self.start, self.end, self.block_at, self.offsets = data, words.start, words.end, words.at, offsets
        self.tokens = (words.hash >> np.uint64(48)).astype("<u2")
        self.page_block = np.concatenate([[0], np.cumsum([len(texts) for texts, _ in pages])]).astype(np.int64)
        self.page_at = self.block_at[self.page_block]

    def windows(self, least: int) -> np.ndarray:
        """The hash of the window from each token on, 0 where a page ends before it does."""
        return window_hashes(self.tokens, np.repeat(self.page_at[1:], np.diff(self.page_at)), least)


def window_hashes(tokens: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    out = np.zeros(len(tokens), np.uint64)
    at = np.flatnonzero(np.arange(len(tokens)) + least <= ends)
    h = mix(np.full(len(at), least, np.uint64))
    for j in range(least):
        h = chain(h, tokens[at + j].astype(np.uint64))
    out[at] = h
    return out


def repeated_windows(tokens: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array's part with neighbours of a common prefix of ``least`` tokens: positions in its order, and their rank.

    ends: the end of each token's page, which no prefix crosses.
    """
    rank, depth = tokens.astype(np.int64), 1
    alive = np.arange(len(tokens)) < ends
    while depth < least and alive.any():
        step = min(depth, least - depth)
        at = np.flatnonzero(alive)
        at = at[at + step < ends[at]]
        at = at[alive[at + step]]
        _, named, n = np.unique(rank[at] << 32 | rank[at + step], return_inverse=True, return_counts=True)
        alive = np.zeros(len(tokens), bool)
        again = n[named] > 1
        alive[at[again]] = True
        rank[at] = named
        depth += step
    at = np.flatnonzero(alive)
    at = at[at + least <= ends[at]]
    order = np.argsort(rank[at], kind="stable")
    return at[order], rank[at][order]


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    for part in slices(batch, "html"):
        yield part, [page_blocks(h) for h in part.column("html").to_pylist()]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, content (a hash of the stream) and the stream; of the equal streams a task holds, mostly one."""
    seen: set = set()
    for batch in batches:
        for part, pages in _parsed(batch):
            s = Streams(pages)
            out: list[list] = [[], [], []]
            for i, host in enumerate(part.column("host").to_pylist()):
                tokens = s.tokens[s.page_at[i] : s.page_at[i + 1]]
                if len(tokens) < LEAST_WORDS:
                    continue
                stream = tokens.tobytes()
                if (key := hash((host, stream))) not in seen:
                    seen = seen if len(seen) < SEEN else set()
                    seen.add(key)
                    for column, v in zip(out, (host, zlib.crc32(stream), stream), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["host", "content", "stream"])


def _joined(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct streams, their tokens in a row, the end of each token's stream, and its number."""
    streams = sorted(set(table.column("stream").to_pylist()))
    sizes = np.array([len(s) // 2 for s in streams], np.int64)
    return streams, np.frombuffer(b"".join(streams), "<u2"), np.repeat(np.cumsum(sizes), sizes), np.repeat(np.arange(len(streams)), sizes)


_WINDOWS = "host string, window long, pages long"


def _counted(host: str | None, windows: np.ndarray, pages: np.ndarray) -> pa.Table:
    return pa.table([pa.array([host] * len(windows), pa.string()), pa.array(windows, pa.int64()), pa.array(pages, pa.int64())], names=["host", "window", "pages"])


def _shard_windows(table: pa.Table) -> pa.Table:
    """Windows that the share of the shard's distinct streams have, with their number; and that of all (window 0).

    What the share of a host's streams has, the share of at least one shard's streams has.
    """
    host, shards = table.column("host")[0].as_py(), table.column("shards")[0].as_py()
    streams, tokens, ends, page = _joined(table)
    least = OPEN_SHARE * len(streams) - 1e-6 if shards > 1 else max(OPEN_PAGES, OPEN_SHARE * len(streams))
    if least <= 1:  # few long streams: one of them is enough
        h = np.unique(window_hashes(tokens, ends, LEAST_WORDS))
        h = h[h != 0]
        return _counted(host, np.concatenate([[0], h.view(np.int64)]), np.concatenate([[len(streams)], np.ones(len(h), np.int64)]))
    at, rank = repeated_windows(tokens, ends, LEAST_WORDS)
    first = np.flatnonzero(np.diff(rank, prepend=-1))
    _, pages = np.unique(np.unique(rank * len(streams) + page[at]) // len(streams), return_counts=True)
    common = pages >= least
    starts = at[first][common]
    h = np.full(len(starts), 0, np.uint64)
    if len(starts):
        span = starts[:, None] + np.arange(LEAST_WORDS)
        h = window_hashes(tokens[span].ravel(), np.repeat((np.arange(len(starts)) + 1) * LEAST_WORDS, LEAST_WORDS), LEAST_WORDS)[::LEAST_WORDS]
    return _counted(host, np.concatenate([[0], h.view(np.int64)]), np.concatenate([[len(streams)], pages[common]]))


def _shard_counts(streams: pa.Table, windows: pa.Table) -> pa.Table:
    """How many of the shard's distinct streams have each of the host's windows."""
    if not streams.num_rows or not windows.num_rows:
        return _counted(None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    known, tokens, ends, page = _joined(streams)
    wanted = np.unique(windows.column("window").to_numpy())
    h = window_hashes(tokens, ends, LEAST_WORDS).view(np.int64)
    at = np.flatnonzero((h != 0) & np.isin(h, wanted))
    which, n = np.unique(np.unique(np.searchsorted(wanted, h[at]) * len(known) + page[at]) // len(known), return_counts=True)
    return _counted(streams.column("host")[0].as_py(), wanted[which], n)


def host_windows(pages: DataFrame) -> DataFrame:
    """host, window, share: what hosts repeat often enough to be boilerplate; always: enough inside articles too."""
    pages = pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    sizes = keep(pages.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("html")) / SHARD_BYTES)).cast("long").alias("shards")).where("shards > 1"))

    def dealt(rows: DataFrame) -> DataFrame:
        streams = rows.mapInArrow(_streams, "host string, content long, stream binary").join(sizes, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1).cast("long")))
        return streams.withColumn("shard", F.pmod("content", "shards"))

    found = keep(dealt(pages).groupBy("host", "shards", "shard").applyInArrow(_shard_windows, _WINDOWS))
    # hosts of several shards: what may be common is counted in all of them
    several = found.join(sizes, "host")
    shards = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
    asked = several.where("window <> 0").select("host", "window", "shards").distinct().select("host", "window", shards)
    counts = dealt(pages.join(sizes.select("host"), "host", "left_semi")).groupBy("host", "shard").cogroup(asked.groupBy("host", "shard")).applyInArrow(_shard_counts, _WINDOWS)
    found = found.join(sizes, "host", "left_anti").unionByName(several.where("window = 0").select("host", "window", "pages")).unionByName(counts)
    found = keep(found.groupBy("host", "window").agg(F.sum("pages").alias("pages")))
    total = found.where("window = 0").select("host", F.col("pages").alias("total"))
    often = lambda share, least: (F.col("pages") >= share * F.col("total")) & (F.col("pages") >= least)
    both = found.where("window <> 0").join(total, "host").where(often(OPEN_SHARE, OPEN_PAGES))
    return both.select("host", "window", often(ARTICLE_SHARE, ARTICLE_PAGES).alias("always"))


def _left(s: Streams, page: int, texts: list[str], covered: np.ndarray) -> list[str]:
    """The block texts of a page without the boilerplate: covered tells it for the page's words."""
    out, first = [], s.page_at[page]
    for b, text in enumerate(texts, s.page_block[page]):
        words = np.arange(s.block_at[b], s.block_at[b + 1])
        gone = covered[words - first]
        if not gone.any():
            out.append(text)
        elif not s.inside[page] and not gone.all():
            out.append(b" ".join(s.data[s.start[w] : s.end[w]].tobytes() for w in words[~gone]).decode())
        elif not gone.all():
            out.append(text)
    return out


def _texts(known: dict[str, tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """known: by host, its windows in order and whether they count inside articles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pages in _parsed(batch):
                hosts = part.column("host").to_pylist()
                texts = [" ".join(t) for t, _ in pages]
                mine = [i for i, h in enumerate(hosts) if h in known and pages[i][0]]
                if mine:
                    s = Streams([pages[i] for i in mine])
                    windows = s.windows(LEAST_WORDS)
                    for j, i in enumerate(mine):
                        w, (have, always) = windows[s.page_at[j] : s.page_at[j + 1]], known[hosts[i]]
                        have = have[always] if s.inside[j] else have
                        hit = np.flatnonzero((w != 0) & np.isin(w, have))
                        if len(hit):
                            edge = np.zeros(len(w) + 1, np.int64)
                            np.add.at(edge, hit, 1)
                            np.add.at(edge, hit + LEAST_WORDS, -1)
                            texts[i] = " ".join(_left(s, j, pages[i][0], np.cumsum(edge[:-1]) > 0))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. page_id, url, text, n_chars of every row."""
    windows = keep(host_windows(pages))
    passes = max(1, -(-windows.count() // PASS_WINDOWS))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", _host(F.col("url")))
    out = None
    for i in range(passes):
        mine = lambda df: df.where(F.pmod(F.xxhash64("host"), F.lit(passes)) == i)  # noqa: B023, E731
        known: dict[str, list] = {}
        for r in mine(windows).toLocalIterator():
            known.setdefault(r.host, []).append((r.window, r.always))
        tables = {}
        for h, found in known.items():
            found.sort()
            tables[h] = np.array([w for w, _ in found], np.int64).view(np.uint64), np.array([a for _, a in found], bool)
        part = (mine(rows) if passes > 1 else rows).mapInArrow(_texts(tables), "page_id long, url string, text string, n_chars long")
        out = part if out is None else out.unionByName(part)
    return out


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(rows_of(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable] = {"op13_main_text": op13_main_text}
#: HTML can't be read in SQL; tests compare with a plain version.
ORACLES: dict[str, str] = {}
