"""Main text of pages: hand-built pages, a plain density, and random markup against the standard library's parser."""

import html as H
import math
import random
import time
from html.parser import HTMLParser

import pytest

from strata.llm import html

PROSE = "Some sentence of plain prose that stands for the article and goes on for a while, as such sentences do."
PARAGRAPHS = "".join(f"<p>{PROSE} {i}</p>" for i in range(6))
WANT = [f"{PROSE} {i}" for i in range(6)]
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Page {i}</a></li>' for i in range(5)) + "</ul>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>The title</title><style>p{{}}</style><script>var t='<p>no</p>';</script></head><body>{body}</body></html>"


PAGES = {
    "article": (f"<nav>{MENU}</nav><article><h1>Title</h1>{PARAGRAPHS}</article><footer>&copy; us</footer>", ["Title", *WANT]),
    "main": (f"<header><h1>Site</h1>{MENU}</header><main><h1>Title</h1>{PARAGRAPHS}</main><aside><p>{PROSE}</p></aside>", ["Title", *WANT]),
    "header in article": (f"<article><header><h1>Title</h1></header>{PARAGRAPHS}<footer>tags</footer></article>", ["Title", *WANT]),
    "plain divs": (f"<div>{MENU}</div><div>short</div><div><h2>Title</h2><div>{PARAGRAPHS}</div></div><div>By the way</div>", ["Title", *WANT]),
    "named asides": (
        f'<div class="cookie-notice"><p>{PROSE}</p></div><div id="sideBar"><p>{PROSE}</p></div><div class="has-sidebar"><h1>Title</h1>{PARAGRAPHS}</div><div class="ad">{PROSE}</div><section id="comments"><article class="comment"><p>{PROSE}</p></article></section>',
        ["Title", *WANT],
    ),
    "form around all": (f'<form action="/x"><div class="menu">{MENU}</div><main>{PARAGRAPHS}</main></form><form><label>Your mail</label><input></form>', WANT),
    "sections": (f"<article><h1>Title</h1><section>{PARAGRAPHS}</section><section><p>Short.</p></section>{MENU}</article>", ["Title", *WANT, "Short."]),
    "tables and lists": (f"<article>{PARAGRAPHS}<ul><li>one<li>two <b>bold</b></ul><table><tr><td>a<td>b</table><pre>x\n  y</pre></article>", [*WANT, "one", "two bold", "a", "b", "x y"]),
    "inline": ("<article><p>a<b>b</b> <i> c</i><br>d<span>e</span>&nbsp;f&amp;g &lt;p&gt; &#233; &quot</p>tail<hr>more</article>", ["ab c de f&g <p> é \"", "tail", "more"]),
    "comments and scripts": (f"<article><!-- <p>no</p> -->{PARAGRAPHS}<script>if (a<b) x('</p>')</script><style>x</style><noscript>no</noscript></article>", WANT),
    "unclosed": (f"<article><p><b>one<br><p>two<div>three<p>four</div>five", ["one", "two", "three", "four", "five"]),
    "nothing": (f"<nav>{MENU}</nav><footer>us</footer>", []),
    "no elements": ("just words\nand more", ["just words and more"]),
    "tiny article": (f"<nav>{MENU}</nav><div class='ad'>{PROSE}</div><article><h1>Was.</h1><p><b>Was.<br></article><footer>&copy; {PROSE}</footer>", ["Was.", "Was."]),
    "articles beside each other": (f"<main><article>{PARAGRAPHS}</article><article><p>{PROSE}</p></article></main>", [*WANT, PROSE]),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(name):
    body, want = PAGES[name]
    assert html.main_text(page(body)).split("\n") == (want or [""])


def test_broken_and_empty():
    for text in (None, "", " \n ", "<", "<p", "<!--", "<script>x", "<a href='", "</", "</p></div>", "<!DOCTYPE html><html>"):
        assert html.main_text(text) in ("", "<")
    assert html.main_text("<article><p>kept</p><!-- cut off <p>gone</p>") == "kept"
    assert html.main_text("<article><p title=it's>kept</p><p data-id='ad' alt=\"a>b\">too</p>") == "kept\ntoo"


def test_work_is_linear():
    for unit in ("<div>", "<b>", "<p>x", "<li>x", "</b>", "<", "<a x='", "<!--", "<td><i>"):
        took = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            html.main_text("<article>" + unit * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 0.5 + 8 * took[0], unit


class Plain(HTMLParser):
    """Text and densities of well-formed markup by recursion over a tree of lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("html", [])
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def counted(node, linked=False):
    linked = linked or node[0] == "a"
    c = t = lc = lt = 0
    for x in node[1]:
        if isinstance(x, str):
            size = len("".join(x.split()))
            c, lc = c + size, lc + size * linked
        else:
            a = counted(x, linked)
            c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3] + (x[0] == "a")
    return c, t, lc, lt


def brute_density(node, body, linked=False):
    c, t, lc, lt = counted(node, linked)
    cb, _, lcb, _ = counted(body)
    if not c:
        return 0
    base = max(math.e, math.log(c / max(1, c - lc) * lc + lcb / cb * c + math.e))
    return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1), base)


def test_densities_equal_the_plain_formula():
    rng = random.Random(3)

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            return H.escape("".join(rng.choice("ab <&é ") for _ in range(rng.randrange(12))))
        tag = rng.choice(["div", "section", "span", "a", "b"])
        return f"<{tag}>" + "".join(some(depth - 1) for _ in range(rng.randrange(4))) + f"</{tag}>"

    for _ in range(150):
        text = "<body>" + "".join(some(4) for _ in range(3)) + "</body>"
        plain = Plain()
        plain.feed(text)
        plain.close()
        tree = html.Tree(text)
        d = html.Densities(tree, [False] * len(tree.tag))
        nodes, walk = [], [(plain.root, False)]
        while walk:
            node, linked = walk.pop()
            nodes.append((node, linked))
            walk.extend((x, linked or node[0] == "a") for x in reversed(node[1]) if not isinstance(x, str))
        body = nodes[1][0]
        assert [n[0] for n, _ in nodes] == tree.tag
        for i, (node, linked) in enumerate(nodes):
            assert d.density[i] == pytest.approx(brute_density(node, body, linked))
            assert d.sums[i] == pytest.approx(sum(brute_density(x, body, linked or node[0] == "a") for x in node[1] if not isinstance(x, str)))


def test_table(spark):
    rows = [(1, page(PAGES["article"][0]), "clash", "u"), (1, page(PAGES["article"][0]), "clash", "u"), (None, None, None, None), (2, "", "", ""), (3, "<article>" + PARAGRAPHS * 5000, "", "")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, html string, main_text string, `a.b` string"))
    got = sorted(out.collect(), key=repr)
    assert out.columns == ["page_id", "html", "a.b", "main_text"] and len(got) == 5
    assert [r.main_text.count("\n") for r in got if r.page_id == 3] == [29_999]
    assert [r.main_text for r in got if r.page_id == 1] == ["\n".join(["Title", *WANT])] * 2
    assert [r.main_text for r in got if r.page_id in (None, 2)] == ["", ""]
    assert html.extract(out.limit(0)).count() == 0
