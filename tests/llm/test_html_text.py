"""Main text of pages: names, forms, headlines, broken pages, and whole results against loops over all pages."""

import random
import time

import pytest

from navspark.llm import html_text
from navspark.llm.html_text import blocks, stream_blocks

SCHEMA = "page_id long, url string, html string"
WORDS = [a + b for a in ("ka", "le", "mi", "no", "ru", "sa", "to", "vi") for b in ("ban", "der", "fix", "gol", "hum", "jet")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choices(WORDS, k=n))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="content no-sidebar"><p>main text', ["main text"]),
        ('<article><p class="promo-code-explained">a</p><p>b</article>', ["a", "b"]),
        ('<article><section id="related-work">a</section></article>', ["a"]),
        ('<article><h2 class="section-header">a</h2><p>b</article>', ["a", "b"]),
        ('<article><div class="article-header"><h1>a</h1></div><p>b</article>', ["a", "b"]),
        ("<body><form action=x><nav>n</nav><p>a</p><p>b</p></form></body>", ["a", "b"]),
        ("<form><div class=siteHeader>q</div><article><h1>a</h1>b</article></form>", ["a", "b"]),
        ("<p>a</p><form><p>login</p></form>", ["a"]),
        ("<article><p>a</p><article class=comment>c</article><form><p>f</form></article>", ["a"]),
        ("<article>a<div class='related-posts'>r</div><div id=ad-slot-3>d</div><ul class=comment_list>c</ul></article>", ["a"]),
        ("<main><h1>a</h1><p>b</main><aside><article>t</article></aside>", ["a", "b"]),
        ("<div id=content><div>o</div><article>a</article></div>", ["a"]),
        ("<p a=\"x>y\">a</p> <p don't>b</p> <p q=\"open>c</p>", ["a", "b", "c"]),
        ("<script>x</scripty>z</SCRIPT >aİ<b>b</b>", ["aİb"]),
        ("a < b > c </ d><x", ["a < b > c </ d><x"]),
    ],
)
def test_parts(page, want):
    assert blocks(page)[1] == want


@pytest.mark.parametrize("unit", ["<a ", '<p x="', "<a x=\">' y='", '<a x="> ', "<div>", "<main>", "<form>", "<", "<![CDATA[ ", "<![CDATA[ >", "<!-- ", "<!", "</a ", "<script>", "<title>", "<p a= ", "<div></p></p>", "<main><article>x", "&"])
def test_broken_pages_take_linear_time(unit):
    began = time.process_time()
    stream_blocks(unit * (1_000_000 // len(unit)))
    stream_blocks("<div>" * 60_000 + unit * (700_000 // len(unit)))
    assert time.process_time() - began < 8


def test_headlines_and_small_hosts(spark):
    """A headline on every page of a host stays, and so does a passage in the articles of a host of few pages."""
    rng = random.Random(5)
    line, own = prose(rng, 14), {i: prose(rng, 30) for i in range(20)}
    page = lambda i, *more: f"<title>{line}</title><article><h1>{line}</h1><p>{own[i]}</p>{''.join(more)}</article>"
    said = prose(rng, 12)
    rows = [(i, "http://small/x", page(i, f"<p>{said}")) for i in range(4)] + [(i, "http://large/x", page(i, f"<p>{said}" if i < 13 else "")) for i in range(4, 20)]
    rows += [(30 + i, "http://plain/x", f"<title>{line} - Site</title><h1>{line}</h1><p>{own[i]}</p><p>{said}") for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: f"{line}\n{own[i]}\n{said}" for i in range(4)} | {i: f"{line}\n{own[i]}" for i in range(4, 20)} | {30 + i: f"{line}\n{own[i]}" for i in range(4)}
    assert got == want


def test_text_equals_loops_over_pages(spark):
    """Pages built from parts of known kinds; runs are counted by loops over all pages of the host."""
    rng = random.Random(9)
    pool = {h: [prose(rng, rng.randint(6, 16)) for _ in range(5)] for h in "abc"}
    made, rows = {}, []
    for k in range(90):
        host = "abc"[0 if k < 40 else 1 if k < 86 else 2]
        marked = rng.random() < 0.5
        own = [prose(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 3))]
        parts = [("text", p) for p in own] + [("text", p) for p in pool[host] if rng.random() < (0.65 if p == pool[host][0] else 0.2)]
        rng.shuffle(parts)
        menu, advert, headline = prose(rng, 9), prose(rng, 10), rng.choice([pool[host][0], prose(rng, 9)])
        body = "".join(f"<p>{p}</p>" for _, p in parts)
        inner = f"<h1>{headline}</h1>{body}" if marked else body
        html = f"<nav>{menu}</nav><div class='ad-box'>{advert}</div>" + (f"<article>{inner}</article>" if marked else f"<div>{inner}</div>")
        found = [("beside", menu), ("beside", advert), *([("headline", headline)] if marked else []), *(("inside" if marked else "plain", p) for _, p in parts)]
        made[k] = (host, found)
        rows.append((k, f"http://{host}/{k}", html))
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(0, 90, 7)]
    made |= {100 + k: made[k] for k in range(0, 90, 7)}
    streams: dict[str, set] = {}
    for host, found in made.values():
        streams.setdefault(host, set()).add(tuple(" ".join(b for _, b in found).split()))
    on: dict[tuple, set] = {}
    for host, all_ in streams.items():
        for t in all_:
            for i in range(len(t) - 7):
                on.setdefault((host, t[i : i + 8]), set()).add(t)
    want = {}
    for k, (host, found) in made.items():
        t = tuple(" ".join(b for _, b in found).split())
        shared, wide = set(), set()
        for i in range(len(t) - 7):
            n = len(on[host, t[i : i + 8]])
            if n >= 3:
                shared.update(range(i, i + 8))
            if n >= 5 and 2 * n > len(streams[host]):
                wide.update(range(i, i + 8))
        out, at = [], 0
        for kind, b in found:
            cut = wide if kind == "inside" else shared if kind == "plain" else set()
            words = b.split()
            stay = [w for i, w in enumerate(words, at) if i not in cut]
            at += len(words)
            if kind != "beside" and stay:
                out.append(" ".join(stay))
        want[k] = "\n".join(out)
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert got == want and any(len(t.split()) < sum(len(b.split()) for kind, b in made[k][1] if kind != "beside") for k, t in want.items())


def test_empty_and_clashing(spark):
    rows = [(1, None, None, "x", 1), (1, None, "", "x", 1), (None, "no host", "<p>a&nbsp;&amp;\n b", None, None)]
    got = sorted((r.page_id or 0, r.text) for r in html_text.extracted(spark.createDataFrame(rows, SCHEMA + ", text string, host int")).collect())
    assert got == [(0, "a & b"), (1, ""), (1, "")]
