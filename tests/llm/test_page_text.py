import html
import random
import re

import numpy as np
import pytest

from studyloom.llm import page_text
from studyloom.llm.page_text import main_text, page_blocks, repeated_windows

SCHEMA = "page_id long, url string, html string, host string, text string"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("x < y &amp;&lt; z&nbsp;&nbsp;w", "x < y &< z w"), ("<script>if (a < b) '</p>'", ""), ("a<!-- b", "a"),
        ("<p>a<p class='ad'>b<p>c", "a c"), ("<ul><li>a<li class=ad>b<li>c</ul>", "a c"), ("<p>wo<b>rd</b> <i>x</i><br>y", "word x y"),
        ("<head><title>t</title><p>a", "a"), ("<p title=it's>a</p><p>b", "a b"), ("<p title='<p>'>a", "a"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<nav>m</nav><header><h1>site</h1></header><article><header><h1>T</h1><p>by</p></header><p>a</p><footer>f</footer></article><aside>s</aside>", "T a"),
        ("<main><p>a</p><section id='comments'><article><p>c</p></article></section></main>", "a"), ("<article><p>a</p></article><article class='comment'>c</article>", "a"),
        ("<div class='has-sidebar'><p>a</p></div><div class='left-sidebar'>b</div><div id=cookieNotice>c</div><div role=navigation>d</div>", "a"),
        ("<div class='menu wrapper'><article>a</article></div><form><p>q</p><input><button>go</button></form>", "a"),
        ("<div><a href=x>Home</a></div><p><a href=x>link</a> in text</p>", "link in text"), ("<div hidden>n</div><span style='display: none'>n</span>y<noscript>n</noscript>", "y"),
        ("<div class='entry-content'><p>a</p></div><p>b</p>", "a"), ("<h1 class='header'>a</h1><p>b</p></div></p>", "a b"), ("<P>A</P><ARTICLE>B</ARTICLE>", "B"),
    ],
)
def test_markup(page, text):
    assert " ".join(page_blocks(page)[0]) == text


def test_no_end_of_tags_takes_long():
    for s in ("<a " * 50_000, "<!-- " * 50_000, "<script>" * 50_000, "<div>" * 20_000, "</p>" * 50_000, "<p>x" * 20_000, "<" * 100_000, "<b a='" * 30_000):
        page_blocks(s)


def plain_windows(streams, least):
    """Windows that occur twice or more, by position."""
    seen = {}
    for p, s in enumerate(streams):
        for i in range(len(s) - least + 1):
            seen.setdefault(tuple(s[i : i + least]), []).append((p, i))
    return sorted((w, sorted(at)) for w, at in seen.items() if len(at) > 1)


@pytest.mark.parametrize("least", [1, 2, 3, 5, 8, 12])
def test_suffix_intervals(least):
    rng = random.Random(least)
    for _ in range(20):
        streams = [[rng.choice("abc") for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 6))]
        if least > 5:
            streams += [streams[0][:20] + streams[-1][:30]]
        tokens = np.array([ord(c) for s in streams for c in s], "<u2")
        sizes = [len(s) for s in streams]
        ends = np.repeat(np.cumsum(sizes), sizes)
        at, rank = repeated_windows(tokens, ends, least)
        found = [[int(i) for i in at[rank == r]] for r in np.unique(rank)]
        starts = np.cumsum([0, *sizes])
        where = lambda i: (int(np.searchsorted(starts, i, "right")) - 1, int(i - starts[np.searchsorted(starts, i, "right") - 1]))  # noqa: B023, E731
        got = sorted((tuple(map(chr, tokens[f[0] : f[0] + least])), sorted(map(where, f))) for f in found if len(f) > 1)
        assert got == plain_windows(streams, least) if least > 1 else True
        assert all((np.diff(rank) >= 0).tolist())  # in the order of the suffix array


def plain_text(rows, open_share=0.3, article_share=0.8, least=12):
    """The rule, page by page, without shards."""
    host = lambda u: (re.match(r"\w+://([^/]*)", u or "") or [0, ""])[1]
    pages = [(i, u, *page_blocks(h)) for i, u, h in rows]
    words = lambda texts: [w.lower() for t in texts for w in t.split()]
    out = []
    for i, u, texts, inside in pages:
        streams = {tuple(words(t)) for _, v, t, _ in pages if host(v) == host(u) and len(words(t)) >= least}
        mine = words(texts)
        gone = [False] * len(mine)
        for k in range(len(mine) - least + 1):
            w = mine[k : k + least]
            n = sum(any(list(s[j : j + least]) == w for j in range(len(s) - least + 1)) for s in streams)
            if n >= (max(10, article_share * len(streams)) if inside else max(3, open_share * len(streams))):
                gone[k : k + least] = [True] * least
        kept, at = [], 0
        for t in texts:
            ws = t.split()
            flags, at = gone[at : at + len(ws)], at + len(ws)
            if not any(flags):
                kept.append(t)
            elif not all(flags):
                kept.append(t if inside else " ".join(w for w, g in zip(ws, flags, strict=True) if not g))
        out.append((i, u, " ".join(kept)))
    return sorted(out, key=str)


def test_host_repeats(spark, monkeypatch):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 999)) for _ in range(n))
    top, bottom, notice, passage = "Our Site serves &amp; news " + say(12), say(20), say(15), say(30)
    rows = []
    for i in range(14):  # no article element: what the host repeats is found by its suffix array
        rows.append((i, f"http://open.example/{i}", f"<div>{top}</div><p>{say(40)} {passage if i < 3 else ''}</p><div>{bottom} page {i}</div>"))
    for i in range(14, 30):  # in articles only whole blocks on nearly all pages go
        rows.append((i, f"http://marked.example/{i}?x", f"<article><p>{say(40)}</p><p>{passage if i % 2 else say(9)}</p><p>{notice}</p></article>"))
    rows += [(100 + i, "http://copies.example/x", f"<p>{passage} {bottom}</p>") for i in range(6)]
    rows += [(200, None, "<p>a</p>"), (201, "no url", None), (202, "http://open.example/e", ""), (202, "http://open.example/e", "<p>b</p>"), (None, "http://open.example/n", f"<div>{top}</div>c")]
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], SCHEMA)
    got = main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows_got = got.collect()
    assert sorted(((r.page_id, r.url, r.text) for r in rows_got), key=str) == plain_text(rows)
    assert all(r.n_chars == len(r.text) for r in rows_got)
    by_id = {r.page_id: r.text for r in rows_got}
    assert not any(html.unescape(top) in t or bottom in t for i, t in by_id.items() if i is not None and i < 14)
    assert passage in by_id[15] and notice not in by_id[15] and passage in by_id[103] and passage in by_id[0]
    # shards and passes change nothing that is common enough
    monkeypatch.setattr(page_text, "SHARD_BYTES", 3000)
    monkeypatch.setattr(page_text, "PASS_WINDOWS", 20)
    assert sorted(map(str, main_text(df).collect())) == sorted(map(str, rows_got))
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shards_of_a_page_or_two_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(n))
    often, seldom = say(20), say(20)
    rows = [(i, f"http://h.example/{i}", f"<p>{say(30)}</p><div>{often if i % 5 < 2 else ''}</div><div>{seldom if i % 5 == 4 else ''}</div>", "h", "t") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.page_id: r.text for r in main_text(df).collect()}
    assert not any(often in t for t in whole.values()) and sum(seldom in t for t in whole.values()) == 4
    for size in (250, 900):
        monkeypatch.setattr(page_text, "SHARD_BYTES", size)
        assert {r.page_id: r.text for r in main_text(df).collect()} == whole
