"""Main text of web pages by composite text density.

A page is read into a tree kept as arrays (an element's parent stands before it), so everything
below is one pass down or up, whatever the depth. For every element: its characters by its tags,
adjusted for the part of them that stands in links (composite density), and the sum of its
children's densities. The element with the largest sum holds the text; the least density on its
way to the body is the threshold that other elements must reach. Pages are rows: no shuffle.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("noscript template svg object audio video canvas select button datalist dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose end tags are often left out; a start tag of the second column ends an open one of the first.
SOFT = frozenset("p li dt dd tr td th tbody thead tfoot".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
#: Elements that are never part of an article, and words of a class, an id or a role that say the same.
ASIDE = frozenset("nav aside footer form header menu search fieldset".split())
ASIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted banner outbrain taboola
    nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager toolbar skip skiplink
    header masthead footer copyright sidebar aside widget widgets complementary contentinfo
    cookie cookies consent gdpr notice notices alert alertdialog popup modal overlay newsletter subscribe subscription signup login register paywall
    share sharing social related recommended recommendations search form
    comment comments commentlist disqus respond reply replies discussion""".split()
)
#: A name with one of these speaks of something else than the element itself, as in has-sidebar.
ELSEWHERE = frozenset("has with without no not enabled open layout".split())
#: What holds an article. Something named like an aside that holds one of these isn't an aside.
HOLDS = frozenset("article main".split())

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=(?:\s*"[^"]*(?:"|\Z)|\s*'[^']*(?:'|\Z))?)*+)(?:>|\Z)""",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"(?=([A-Za-z]+))(?<![A-Za-z])|([A-Z]?[a-z]+|[A-Z]+(?![a-z]))")
_CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}


def _named_aside(attributes: str) -> bool:
    for values in _NAMED.findall(attributes):
        for name in " ".join(values).split():
            words = {w.lower() for pair in _WORDS.findall(name) for w in pair}
            if words & ASIDE_WORDS and not words & ELSEWHERE:
                return True
    return False


class Tree:
    """tag, parent, end (one past the last descendant) and aside (so named) of each element, which has
    its place in the page as its number; runs: (element, block number, text) in page order. Runs of one
    block number have no block's begin or end between them."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.end, self.aside = ["html"], [-1], [0], [False]
        self.runs: list[tuple[int, int, str]] = []
        self._stack, self._at = [0], {"html": [0]}  # numbers of open elements; places in the stack by tag
        self._blocks, self._walls = [0], [0]  # places of blocks, and of those that aren't SOFT
        at, block, hidden = 0, 0, None  # hidden: the place of an open element whose content isn't seen
        while at < len(page):
            m = _TOKEN.search(page, at)
            if hidden is None and (text := page[at : m.start() if m else len(page)]):
                self.runs.append((self._stack[-1], block, html.unescape(text)))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                end = _CLOSERS[tag].search(page, at)
                at = end.end() if end else len(page)
            elif tag not in ("html", "body") or not self._at.get(tag):
                self._start(tag, m[3])
                if hidden is None and tag in UNSEEN:
                    hidden = len(self._stack) - 1
                elif hidden is None and tag == "br":
                    self.runs.append((self._stack[-1], block, "\n"))
            block += tag in BLOCK
            if hidden is not None and len(self._stack) <= hidden:
                hidden = None
        self._pop(0)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK and self.tag[self._stack[self._blocks[-1]]] == "p":
            self._pop(self._blocks[-1])
        open_ = [self._at[t][-1] for t in ENDS.get(tag, ()) if self._at.get(t)]
        if open_ and max(open_) > self._walls[-1]:
            self._pop(max(open_))
        self.parent.append(self._stack[-1])
        self.aside.append(tag in ASIDE or (tag not in ("html", "body", "main") and _named_aside(attributes)))
        self.tag.append(tag)
        self.end.append(len(self.tag))
        if tag not in VOID:
            self._at.setdefault(tag, []).append(len(self._stack))
            if tag in BLOCK:
                self._blocks.append(len(self._stack))
                if tag not in SOFT:
                    self._walls.append(len(self._stack))
            self._stack.append(len(self.tag) - 1)

    def _close(self, tag: str) -> None:
        """A block's end tag ends all that is open in it; another's does nothing if a block began in it."""
        open_ = self._at.get(tag)
        if open_ and tag not in ("html", "body") and (tag in BLOCK or tag in UNSEEN or open_[-1] > self._blocks[-1]):
            self._pop(open_[-1])

    def _pop(self, place: int) -> None:
        for x in self._stack[place:]:
            self.end[x] = len(self.tag)
            self._at[self.tag[x]].pop()
        del self._stack[place:]
        for places in (self._blocks, self._walls):
            while places and places[-1] >= place:
                places.pop()


def _asides(tree: Tree) -> list[bool]:
    """Whether each element is an aside or in one. A header in an article or main part isn't one; a form, or
    what is only named like an aside, isn't one if an article, a main part or an h1 stands in it."""
    n = len(tree.tag)
    holds, plain = [False] * n, ASIDE - {"form", "fieldset"}
    for i in range(n - 1, 0, -1):
        holds[i] = holds[i] or (tree.tag[i] in HOLDS and not tree.aside[i]) or tree.tag[i] == "h1"
        if holds[i] and tree.tag[i] not in plain:
            holds[tree.parent[i]] = True
    out, held = [False] * n, [False] * n
    for i in range(1, n):
        up, tag = tree.parent[i], tree.tag[i]
        spared = held[up] if tag == "header" else holds[i] and tag not in plain
        out[i] = out[up] or (tree.aside[i] and not spared)
        held[i] = held[up] or (tag in HOLDS and not out[i])
    return out


class Densities:
    """Of each element: characters, tags, link characters and link tags below it, its composite density
    and the sum of its children's. Asides count in what holds them, but not in sums."""

    def __init__(self, tree: Tree, asides: list[bool]) -> None:
        n = len(tree.tag)
        self.chars, self.tags, self.link_chars, self.links, self.sums = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[tree.parent[i]] or tree.tag[i] == "a"
        for i, _, text in tree.runs:
            size = sum(map(len, text.split()))
            self.chars[i] += size
            self.link_chars[i] += size if linked[i] else 0
        for i in range(n - 1, 0, -1):
            up = tree.parent[i]
            self.chars[up] += self.chars[i]
            self.tags[up] += self.tags[i] + 1
            self.link_chars[up] += self.link_chars[i]
            self.links[up] += self.links[i] + (tree.tag[i] == "a")
        self.body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
        self.share = self.link_chars[self.body] / max(1, self.chars[self.body])
        self.density = [self._composite(i) for i in range(n)]
        for i in range(n - 1, 0, -1):
            if not asides[i]:
                self.sums[tree.parent[i]] += self.density[i]

    def _composite(self, i: int) -> float:
        """C/T times log(C/LC * T/LT) to the base ln(C/(C-LC) * LC + LCb/Cb * C + e): C characters, T tags, LC
        and LT those of links, b of the body; zeros below a line count as one. The base is e at least: below
        that a short text would come out the denser the fewer links the page has."""
        c, t, lc, lt = self.chars[i], max(1, self.tags[i]), self.link_chars[i], max(1, self.links[i])
        if not c:
            return 0.0
        base = max(math.e, math.log(c / max(1, c - lc) * lc + self.share * c + math.e))
        return c / t * math.log(c / max(1, lc) * t / lt) / math.log(base)


def _areas(tree: Tree, asides: list[bool], d: Densities) -> list[bool]:
    """Whether each element is in a part of the page that was chosen."""
    n, body = len(tree.tag), d.body
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        if d.chars[i] and not asides[i]:
            children.setdefault(tree.parent[i], []).append(i)
    best = max((i for i in range(body, n) if not asides[i]), key=lambda i: d.sums[i], default=body)
    path = [best]
    while path[-1] not in (body, 0):
        path.append(tree.parent[path[-1]])
    threshold = min(d.density[i] for i in path)
    top = next((i for tag in ("article", "main") for i in path if tree.tag[i] == tag), None)
    if top is not None:  # the article around the best element, and others beside it
        more = [i for i in children.get(tree.parent[top], ()) if tree.tag[i] == tree.tag[top]]
    else:
        top, own = best, {i for i, _, text in tree.runs if not text.isspace()}
        for up in path[1:]:  # what holds it, as long as that adds only headings and what reaches the threshold
            if up in own or any(i != top and tree.tag[i] not in HEADING and d.density[i] < threshold for i in children.get(up, ())):
                break
            top = up
        more = [i for up in path if up < top for i in children.get(up, ()) if d.density[i] >= threshold and not i <= top < tree.end[i]]
    out = [False] * n
    for i in (top, *more):
        out[i : tree.end[i]] = [True] * (tree.end[i] - i)
    return out


def main_text(page: str | None) -> str:
    """The article of one page: its blocks, white space inside them as one space, joined by line ends. Blocks
    of three links or more without a word outside of links are menus and stay out wherever they are."""
    tree = Tree(page or "")
    asides = _asides(tree)
    d = Densities(tree, asides)
    chosen, menu, blocks = _areas(tree, asides, d), [False] * len(tree.tag), {}
    for i in range(1, len(tree.tag)):
        menu[i] = menu[tree.parent[i]] or (tree.tag[i] in BLOCK and d.links[i] >= 3 and d.chars[i] == d.link_chars[i])
    for i, block, text in tree.runs:
        if chosen[i] and not asides[i] and not menu[i]:
            blocks.setdefault(block, []).append(text)
    return "\n".join(x for b in blocks.values() if (x := " ".join("".join(b).split())))


def extract(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """pages plus main_text, a string that is empty where a page has no article.

    Null and empty pages have empty texts; text outside of any element is read as a page of its own.
    Broken markup is read as browsers do: end tags may be missing, comments and scripts may be
    cut off. Of elements with equal sums the first in the page counts. Repeated rows get equal texts.
    The work is linear in a page's length, one page at a time, so a very long one needs memory for
    its own tree only. An empty table gives no rows. Columns of pages stay; one named main_text is
    overwritten.
    """
    rows = pages.drop(*([] if page == "main_text" else ["main_text"]))
    plain = [f"c{i}" for i in range(len(rows.columns))]
    kept = [p for p, c in zip(plain, rows.columns, strict=True) if c != "main_text"]
    at = plain[rows.columns.index(page)]

    def texts(batches):
        for batch in batches:
            found = pa.array([main_text(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(p) for p in kept], found], [*kept, "main_text"])

    fields = [T.StructField(p, f.dataType) for p, f in zip(plain, rows.schema.fields, strict=True) if p in kept]
    out = rows.toDF(*plain).mapInArrow(texts, T.StructType([*fields, T.StructField("main_text", T.StringType())]))
    return out.toDF(*[c for c in rows.columns if c != "main_text"], "main_text")
