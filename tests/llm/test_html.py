from __future__ import annotations

import random

from lodestone.llm import html as H
from tests.llm.conftest import DATA


def page(host: int, title: str, *paragraphs: str, extra: str = "") -> str:
    body = "".join(f"<p>{p}" + "</p>" * (k % 2) for k, p in enumerate(paragraphs))
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><header><h1>Site {host}</h1></header><nav><ul><li><a href='/'>Home</a><li>News</ul></nav>"
        f"<script>var t='</p><p>no';</script><div class='content-{host}'><h2>{title}</h2>{body}{extra}</div><div class=sidebar><p>Side {title}</div><form><p>Ask</p></form>"
        "<div id=comments><p>I agree</p></div><div class='cookie-notice'>We use cookies</div><footer>&copy; all</footer></body></html>"
    )


def test_blocks_and_references():
    got = H.main_text("<article><h1>A &amp; B</h1><p>one<br>two  \n three &eacute;&#233;<p><b>bold</b> text <ul><li>x<li>y</ul><!-- no --></article><aside>no</aside>", None)
    assert got == "A & B\n\none two three éé\n\nbold text\n\nx\n\ny"


def test_noise_is_left_out():
    text = H.main_text(page(1, "Title", "First paragraph here.", "Second one."), None)
    assert text == "Title\n\nFirst paragraph here.\n\nSecond one."
    inside = '<article><header><h1>T</h1></header><p>Body</p><div class="ad">Buy</div><section id="comments"><p>Reader says</p></section><p style="display:none">hid</p></article>'
    assert H.main_text(inside, None) == "T\n\nBody"
    assert H.main_text("plain text only", None) == "plain text only" and H.main_text("<p>a<p hidden>b<a href=", None) == "a"


def test_wrapper_is_inferred():
    pages = [page(2, f"T{k}", *(f"p{k}{j}" for j in range(2 + k)), extra="<blockquote>q</blockquote>" if k == 1 else "") for k in range(3)]
    wrapper = H.infer(pages)
    shape = H.pattern(wrapper.tree)
    assert "(<p>#</p>)+" in shape and "(<blockquote>#</blockquote>)?" in shape and "<h2>#</h2>" in shape
    assert wrapper.root[-1] == "div.content-0"
    again = H.Wrapper.loads(wrapper.dumps())
    assert again == wrapper and H.matched(H.read(pages[1]), again)[0] == 1.0


def plain_length(x: list[str], y: list[str]) -> int:
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, v in enumerate(x):
        for j, w in enumerate(y):
            best[i + 1][j + 1] = best[i][j] + 1 if v == w else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        got = H.common(x, y)
        assert len(got) == plain_length(x, y) and all(x[i] == y[j] for i, j in got)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))
    x = [str(k % 97) for k in range(6000)]
    y = [str(k % 89) for k in range(6000)]
    assert all(x[i] == y[j] for i, j in H.common(x, y))


def test_wrapper_takes_all_its_pages():
    """The expression of random pages matches each of them whole, and one that differs only in slots and repeats."""
    rng = random.Random(7)

    def make() -> str:
        parts = [f"<h1>t{rng.random()}</h1>"]
        for _ in range(rng.randrange(1, 5)):
            kind = rng.choice(("p", "ul", "table", "blockquote"))
            inner = "".join(f"<li>i{rng.random()}</li>" for _ in range(rng.randrange(1, 4))) if kind == "ul" else f"<tr><td>c{rng.random()}</td></tr>" if kind == "table" else f"x{rng.random()}"
            parts += [f"<{kind}>{inner}</{kind}>"] * 1
        return f"<body><div class=top>Shop {rng.random()}</div><article>{''.join(parts)}</article></body>"

    for _ in range(20):
        pages = [make() for _ in range(6)]
        wrapper = H.infer(pages)
        assert all(H.matched(H.read(p), wrapper)[0] == 1.0 for p in pages)
        assert all(H.main_text(p, wrapper) == H.main_text(p, None) for p in pages)


def test_wrapper_decides():
    """Where the rule on one page goes wrong and the wrapper is right."""

    def site(k: int, rel: str = "", more: str = "") -> str:
        return f"<body><div class=q1><p>Story {k} begins here and goes on for a while, long enough to be one.<p>It has a second part {k * 7}.{rel}<div class=q9>Read our rules first.</div>{more}</div><div class=z><a href=/>Home</a></div></body>"

    pages = [site(k, f"<div class=related><p>Related work {k} is discussed in this part of the story.</div>" if k % 2 else "", "<div class=related><a href=/a>More</a></div>" if k % 3 == 0 else "") for k in range(6)]
    wrapper = H.infer(pages)
    want = "Story 5 begins here and goes on for a while, long enough to be one.\n\nIt has a second part 35.\n\nRelated work 5 is discussed in this part of the story."
    assert H.main_text(pages[5], wrapper) == want
    alone = H.main_text(pages[5], None)
    assert "Read our rules" in alone and "Related work" not in alone
    # A box of links with the same class is no part of it.
    assert H.main_text(pages[0], wrapper) == "Story 0 begins here and goes on for a while, long enough to be one.\n\nIt has a second part 0."
    # Teasers in article elements beside a long text in another container.
    teasers = [f"<body><div class=k1><p>{f'Long text {k} of the page. ' * 30}<p>{f'And more {k}. ' * 20}</div><article>Teaser {k}</article></body>" for k in range(4)]
    assert H.main_text(teasers[0], H.infer(teasers)).startswith("Long text 0") and "Teaser" not in H.main_text(teasers[0], H.infer(teasers))
    # Near copies of one article lose nothing, headings stay, and a page that does not fit is read on its own.
    copies = [f"<article><h2>Same</h2><p>All of this is shared.<p>So is this.<p>Only {k} differs.</article>" for k in range(5)]
    assert H.main_text(copies[0], H.infer(copies)) == "Same\n\nAll of this is shared.\n\nSo is this.\n\nOnly 0 differs."
    heads = [f"<article><h2>Method</h2><p>{f'text {k} ' * 20}</article>" for k in range(5)]
    assert H.main_text(heads[1], H.infer(heads)).startswith("Method\n\n")
    assert H.by_wrapper(H.read("<table><tr><td>other</table><ul><li>a<li>b</ul>"), wrapper) is None


def test_whole_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = {r["page_id"]: r for r in H.extract(pages).collect()}
    assert len(rows) == pages.count()
    for p in pages.collect():
        text = rows[p["page_id"]]["text"]
        assert rows[p["page_id"]]["n_chars"] == len(text) and "track(" not in text and "©" not in text
        heading = H.main_text("<p>" + p["html"].split("<h1>")[1].split("</h1>")[0], None)
        assert text.split("\n\n")[0] == heading


def test_wrapper_decides_in_the_table(spark):
    """One page_id on two hosts, each with a template of its own; the box that all pages of a.org have goes, that of one page of b.org stays."""
    box = "<div class=k7>Box of a.org that is on all of its pages.</div>"
    rows = [(k, "http://a.org/" + str(k), f"<body><div class=k1><p>{f'Article {k} of a. ' * 15}{box}</div></body>") for k in range(12)]
    rows += [(k, "http://b.org/" + str(k), f"<body><section><p>{f'Piece {k} of b. ' * 15}{box if k == 3 else ''}</section></body>") for k in range(12)]
    got = {r["url"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("Box of" in t) == (u == "http://b.org/3") for u, t in got.items())
    assert all(t.startswith("Article" if "a.org" in u else "Piece") for u, t in got.items())


def test_odd_rows(spark):
    rows = [(1, "http://a.org/x", None), (2, None, "<p>x</p>"), (3, "junk", ""), (None, "http://a.org/y", "<article>t</article>"), (4, "http://a.org/z", "<p>" + "long " * 50_000), (4, "http://a.org/z", "<p>twice</p>"), (5, "http://a.org/w", "<" * 2000), (6, "http://a.org/v", "<div>" * 5000 + "deep" + "<p>a<h2>b</h2>" * 4000)]
    df = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, html string, host string, root string")
    got = H.extract(df).collect()
    assert len(got) == len(rows) and {r["text"] for r in got if r["page_id"] in (1, 3)} == {""} and {r["text"] for r in got if r["page_id"] is None} == {"t"}
    assert next(r["text"] for r in got if r["page_id"] == 6).count("\n\n") == 8000
    assert H.extract(df.limit(0)).count() == 0


LONG = "The river rises in the hills and runs for many miles before it meets the sea, as all who live along it know. "


def test_class_words_are_evidence_only():
    """Names that merely contain a listed word, on what holds the article, silence nothing."""
    body, want = f"<h1>Head</h1><p>{LONG * 3}</p><p>{LONG * 2}</p>", f"Head\n\n{(LONG * 3).strip()}\n\n{(LONG * 2).strip()}"
    box = f"<div class=teaser><p>{LONG}</p></div>"
    frames = [
        f'<div class="content has-sidebar"><article>{body}</article></div>{box}', f'<div id=page class="no-sidebar"><article>{body}</article></div>', f'<div class="story promo-subscribe-free">{body}</div>',
        f'<div class="wp navbar-fixed-top-layout">{body}</div>', f'<div class="recommended-layout widget-area-none">{body}</div><div class=q><p>Short.</p></div>', f"<form id=aspnetForm>{body}</form>", f'<div class="with-banner"><main>{body}</main><div class=banner>Buy now</div></div>',
        f'<div class="comments-open">{body}</div>', f'<div aria-hidden="true"><article>{body}</article></div>', f'<section role=dialog><div class="has-cookie-bar">{body}</div></section>',
    ]
    for html in frames:
        page = f"<html><body><nav><a href=/>Home</a></nav>{html}<footer>All rights</footer></body></html>"
        assert H.main_text(page, None) == want, html
        pages = [page.replace("Head", f"Head{k}").replace("hills", f"hills{k}") for k in range(8)]
        wrapper = H.infer(pages)
        assert wrapper.root is not None and H.main_text(pages[3], wrapper) == want.replace("Head", "Head3").replace("hills", "hills3"), html


def test_what_the_names_say_still_goes():
    body = f"<h1>Head</h1><p>{LONG * 3}</p>"
    want = f"Head\n\n{(LONG * 3).strip()}"
    comments = "".join(f"<article class=comment><p>I say {k}.</p></article>" for k in range(9))
    for more in (f"<div id=comments>{comments}</div>", f"<div class=comments-area>{comments}</div>", "<div class=site-footer>About us</div>", "<aside><article>Teaser</article></aside>", "<div class=sidebar-box><article>Teaser</article></div>", "<div class=subscribe-box>Join</div>"):
        assert H.main_text(f"<body><article>{body}</article>{more}</body>", None) == want, more
        assert H.main_text(f"<body><div class=content>{body}{more}</div></body>", None) == want, more
    assert H.main_text(f"<body><div class=content>{body}<p>in <span class=ad>buy</span>side <span class='fine-ad-slot'>more</span></p></div></body>", None) == want + "\n\nin side"


def test_constants_in_the_flow_stay():
    """A paragraph that all pages of a host have is the article's where it stands between its paragraphs; a box of its own is a notice."""
    shared = "This licence applies to every story we publish on this site."
    for kind in ("article", "main", "div class=content"):
        pages = [f"<body><{kind}><h1>T{k}</h1><p>{LONG * 3} {k}</p><p>{shared}</p><p>{LONG * 2}{k}</p><div class=note-x>Read our rules first.</div></{kind.split()[0]}></body>" for k in range(8)]
        got = H.main_text(pages[2], H.infer(pages))
        assert shared in got and "Read our rules" not in got and got.startswith("T2\n\n")


def test_mathematics_stays():
    assert H.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math> be so.</article>", None) == "Let x=2 be so."


def test_marks_cost_linear_time():
    """Very many open marked elements, each with a text of its own."""
    import time

    began = time.time()
    got = H.main_text("<article>" + "".join(f"<span class=widget-x>t{k} " for k in range(60_000)) + "</article>", None)
    assert time.time() - began < 20 and len(got) >= 0
