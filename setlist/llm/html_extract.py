"""Main text of web pages by composite text density.

Each page becomes a flat tree of nodes. A node's density is its characters per tag, lowered by
the share of its characters and tags that stand in links; a node's density sum adds the
densities of its children. The subtree with the largest density sum is the core of the article;
no tag name takes part in that choice. The lowest density on the path from ``body`` to the core is
the threshold: subtrees and loose text that hang off the path stay if they are at least as dense.

A core is often a part of the article only, such as its longest paragraph or its body without the
heading. So the path has a *scope*: the core's own container if the core is a single text block, and
every ancestor below ``body`` of whose characters the core has half or more. What hangs off the path
within the scope stays whatever its density, unless most of it stands in links.

Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are cut before densities are taken. A tag, role, class or id is evidence only and is weighed against text: an
element with the bulk of the page's text stays, whatever it is called, and so does one around an article or main element or, of weak names
such as ``social``, one with prose within an article; a form that stays loses its controls. A header's heading stays if the
page's title begins with it. One pass over the pages, no shuffle; the Python in
a task is the tree of one page. Parsing and scoring take time in proportion to the page, whatever is
left open in it: open elements are found by their tag's places on the stack, and a search for the
end of a quoted attribute that failed is not made again.

A null page is empty; a page without a main text gives an empty string; malformed markup is
parsed as far as it goes; a page of any length is parsed whole and nothing is capped. Between equal
density sums the first node in page order wins; repeated rows give equal rows; an empty table gives an
empty result. Columns ``text`` and ``n_chars`` of the pages are replaced, all others are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
COMMENT_END = re.compile(r"--!?>")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTR = re.compile(r"(?<![a-zA-Z:_-])([a-zA-Z:_-]++)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "body", "option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOP = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements without text of their own, whatever holds them.
NEVER = frozenset("head select button script style textarea title noscript iframe template svg object canvas input".split())
DROPPED = frozenset("nav footer aside form menu dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: A class or id that is one of these, or has one of them among its words: ``page-footer``, ``ad_top``.
DROPPED_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer menu modal nav navbar navigation newsletter popup promo sidebar sponsor sponsored".split())
#: A class or id that is one of these as a whole, unless the element holds prose within an article.
DROPPED_NAMES = frozenset("disclaimer notice notices promotion related share sharing social subscribe toolbar widget".split())
#: Words that make of such a name a switch of the layout around the main text: ``has-sidebar``, ``sidebar-left-layout``.
LAYOUT = frozenset("open closed on off layout page wrapper container content main visible hidden enabled disabled has no with without".split())
COMMENTS = frozenset(["comment", "comments"])
MAIN = frozenset(["article", "main"])
#: What speaks for dropping an element, from weakest to strongest.
NONE, NAME, WORD, REMARKS, TAG, ALWAYS = range(6)
#: An element that has so much of the page's text is the page's text, whatever it is called; reader comments
#: are longer than their article at times, and have to have nearly all of it. Percent, and characters at least.
BULK_PCT, REMARKS_PCT, BULK_CHARS = 85, 97, 140


def _named(names: str) -> int:
    """What the white-space separated names say of an element."""
    found = NONE
    for name in names.lower().split():
        words = set(name.replace("_", "-").split("-"))
        if name in DROPPED_NAMES:
            found = max(found, NAME)
        # the article's page-footer is a footer, but page-with-footer is a page
        if (hit := words & DROPPED_WORDS) and (name in DROPPED_WORDS or LAYOUT.isdisjoint(words) or words <= hit | {"page", "main", "container", "wrapper"}):
            found = max(found, REMARKS if hit & COMMENTS else WORD)
    return found


def _evidence(tag: str, attrs: str, in_main: bool) -> int:
    """What its tag, role, class and id say for dropping an element."""
    if tag in NEVER:
        return ALWAYS
    if tag in DROPPED or (tag == "header" and not in_main):
        return TAG
    found = NONE
    if attrs and "=" in attrs:
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "role" and value.lower() in DROPPED_ROLES:
                return TAG
            if name in ("class", "id") and tag not in MAIN and tag not in ("body", "html"):
                found = max(found, _named(value))
    return found


def _tag_end(html: str, at: int, failed: set[int]) -> int:
    """Where a start tag ends whose name ends at ``at``: behind the first ``>`` outside of quotes, or
    the first one at all if a quote is never closed. ``failed`` keeps opening quotes from which no end
    was found, so that tags do not look for it again and again; there must be a ``>``."""
    seen, pos = [], at
    while m := QUOTE_OR_END.search(html, pos):
        if m[0] == ">":
            return m.end()
        if m.start() in failed:
            break
        seen.append(m.start())
        close = html.find(m[0], m.end())
        if close < 0:
            break
        pos = close + 1
    failed.update(seen)
    return html.find(">", at) + 1


class Page:
    """The tree of one page: parallel lists, a child always after its parent."""

    def __init__(self, html: str):
        self.tag, self.parent, self.cut, self.parts = ["#root"], [-1], [0], [[]]
        #: The open elements, the places on that stack of each tag, and those of all blocks.
        self.stack, self.open, self.blocks = [0], {}, []
        self._parse(html)
        self._settle()

    def _settle(self) -> None:
        """Elements to drop. What speaks against an element is weighed against its text: none is dropped that has the bulk of
        the page's. A class, id or form drops no element that holds an article or main outside of others, a weak name none
        with prose within an article, and names drop nothing if no text would be left."""
        n = len(self.tag)
        inside, never, linked = [False] * n, [False] * n, [False] * n
        plain, links, holds, hard = [0] * n, [0] * n, [False] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            inside[i] = inside[up] or self.tag[up] in MAIN
            never[i] = never[up] or self.cut[i] == ALWAYS
            hard[i] = hard[up] or (self.cut[i] >= TAG and self.tag[i] != "form")
            linked[i] = linked[up] or self.tag[i] == "a"
        for i in range(n - 1, -1, -1):
            if not never[i]:
                own = sum(len(t) - t.count(" ") for t in self.parts[i] if type(t) is str and not t.isspace())
                (links if linked[i] else plain)[i] += own
                if i:
                    plain[self.parent[i]] += plain[i]
                    links[self.parent[i]] += links[i]
            if i and not hard[i] and not inside[i] and (holds[i] or self.tag[i] in MAIN):
                holds[self.parent[i]] = True
        self.drop, tags = [False] * n, [False] * n
        for i in range(1, n):
            up, cut = self.parent[i], self.cut[i]
            bulk = plain[i] >= BULK_CHARS and plain[i] * 100 >= plain[0] * (REMARKS_PCT if cut == REMARKS else BULK_PCT)
            prose = inside[i] and plain[i] >= BULK_CHARS and links[i] * 2 <= plain[i]
            kept = cut == NONE or (cut != ALWAYS and bulk) or (cut <= REMARKS and holds[i]) or (self.tag[i] == "form" and holds[i]) or (cut == NAME and prose)
            self.drop[i] = self.drop[up] or not kept
            tags[i] = tags[up] or (not kept and cut >= TAG)
        if not self._any_text(self.drop):
            self.drop = tags
        self.heading = self._heading()

    def _any_text(self, drop: list[bool]) -> bool:
        return any(type(t) is str and not t.isspace() for i in range(len(self.tag)) if not drop[i] for t in self.parts[i])

    def _inner(self, x: int) -> str:
        """All text below a node as one line."""
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if type(y) is str:
                out.append(unescape(y))
            else:
                todo.extend(reversed(self.parts[y]))
        return " ".join("".join(out).split())

    def _heading(self) -> int | None:
        """The page's only ``h1``, if it stands in a header that goes and the page's title begins with it: a heading of the
        article, not the name of the site."""
        found = [i for i, t in enumerate(self.tag) if t == "h1"]
        if len(found) != 1 or not self.drop[found[0]]:
            return None
        up = self.parent[found[0]]
        while up > 0 and self.cut[up] == NONE:
            up = self.parent[up]
        if self.tag[up] != "header" or self.drop[self.parent[up]]:
            return None
        title = next((self._inner(i) for i, t in enumerate(self.tag) if t == "title"), "")
        text = self._inner(found[0])
        return found[0] if text and (not title or title.startswith(text)) else None

    def _last(self, tags: Iterable[str]) -> int:
        """The highest place on the stack of any of ``tags``, or 0."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _pop(self, place: int) -> None:
        """Close the element at ``place`` of the stack and all above it."""
        for i in range(len(self.stack) - 1, place - 1, -1):
            tag = self.tag[self.stack[i]]
            self.open[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
        del self.stack[place:]

    def _open(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P and (at := self._last(("p",))) and at == self.blocks[-1]:
            self._pop(at)
        if tag in SAME and (at := self._last(SAME[tag])) > self._last(STOP[tag]):
            self._pop(at)
        up = self.stack[-1]
        cut = _evidence(tag, attrs, tag == "header" and self._last(MAIN) > 0)
        self.tag.append(tag)
        self.parent.append(up)
        self.cut.append(cut)
        self.parts.append([])
        self.parts[up].append(len(self.tag) - 1)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCK:
                self.blocks.append(len(self.stack))
            self.stack.append(len(self.tag) - 1)

    def _close(self, tag: str) -> None:
        """An end tag closes its element; that of an inline element not across a block."""
        at = self._last((tag,))
        if at and (tag in BLOCK or not self.blocks or at > self.blocks[-1]):
            self._pop(at)

    def _parse(self, html: str) -> None:
        at = done = 0
        last = html.rfind(">")
        failed: set[int] = set()
        while m := START.search(html, at):
            if m[1]:
                # <!--> and <!---> are comments too
                end = COMMENT_END.search(html, m.start() + 2)
                stop = end.end() if end else len(html)
            elif m.end() > last:
                break
            elif m[2] or m[3]:
                stop = html.find(">", m.end()) + 1
            else:
                stop = _tag_end(html, m.end(), failed)
            if m.start() > done:
                self.parts[self.stack[-1]].append(html[done : m.start()])
            at = done = stop
            if not m[4]:
                continue
            tag = m[4].lower()
            if m[3]:
                if tag == "br":
                    self._open("br", "")
                elif tag not in ("html", "body"):
                    self._close(tag)
                continue
            attrs = html[m.end() : stop - 1]
            self._open(tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                if tag == "title":
                    self.parts[-1].append(html[at : end.start() if end else len(html)])
                at = done = html.find(">", end.end()) + 1 or len(html) if end else len(html)
                self._pop(len(self.stack) - 1)
        if done < len(html):
            self.parts[self.stack[-1]].append(html[done:])

    def content(self) -> list:
        """Nodes and loose strings that make up the article, in page order."""
        n = len(self.tag)
        chars, tags, lchars, ltags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for i in range(n - 1, -1, -1):
            if self.drop[i]:
                continue
            own = sum(len(t) - t.count(" ") for t in self.parts[i] if type(t) is str and not t.isspace())
            chars[i] += own
            lchars[i] += own * in_link[i]
            if i:
                up = self.parent[i]
                chars[up] += chars[i]
                lchars[up] += lchars[i]
                tags[up] += tags[i] + 1
                ltags[up] += ltags[i] + (self.tag[i] == "a")
        if not chars[0]:
            return []
        ratio = lchars[0] / chars[0]
        density = [0.0] * n
        for i in range(n):
            if c := chars[i]:
                t, lc, lt = max(tags[i], 1), max(lchars[i], 1), max(ltags[i], 1)
                plain = max(c - lchars[i], 1)
                base = math.log(c / plain * lchars[i] + ratio * c + math.e)
                density[i] = c / t * max(math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 1.0) if base > 1 else 1.0, 1e-3)
        total = [0.0] * n
        for i in range(1, n):
            total[self.parent[i]] += density[i]
        for i in range(n):
            if not total[i]:
                total[i] = density[i]
        core = max(range(n), key=lambda i: (total[i], -i))
        path = [core]
        while path[-1] > 0 and self.tag[path[-1]] != "body":
            path.append(self.parent[path[-1]])
        threshold = min(density[i] for i in path)
        scope = self._scope(core, path, chars)
        on_path, kept, todo = set(path), [], [(path[-1], False)]
        while todo:
            x, within = todo.pop()
            if type(x) is str:
                if within or len(x.strip()) >= threshold:
                    kept.append(x)
            elif x == core or (x not in on_path and not self.drop[x] and (density[x] >= threshold or (within and lchars[x] * 2 <= chars[x]))):
                kept.append(x)
            elif x in on_path:
                todo.extend((part, x in scope) for part in reversed(self.parts[x]))
        return kept

    def _scope(self, core: int, path: list[int], chars: list[int]) -> set[int]:
        """The nodes of the path above the core that belong to the article as a whole."""
        scope = {i for i in path[1:-1] if chars[core] * 2 >= chars[i]}
        if not self._holds_blocks(core):
            for i in path[1:]:
                scope.add(i)
                if self.tag[i] in BLOCK:
                    break
        return scope

    def _holds_blocks(self, x: int) -> bool:
        todo = [x]
        while todo:
            for part in self.parts[todo.pop()]:
                if type(part) is int and not self.drop[part]:
                    if self.tag[part] in BLOCK:
                        return True
                    todo.append(part)
        return False

    def text(self) -> str:
        blocks, open_block, todo = [], [], self.content()[::-1]
        if self.heading is not None and todo:
            blocks.append([self._inner(self.heading)])
        while todo:
            x = todo.pop()
            if type(x) is str:
                open_block.append(unescape(x) if "&" in x else x)
            elif x is None:
                blocks.append(open_block)
                open_block = []
            elif not self.drop[x]:
                tag = self.tag[x]
                if tag == "br":
                    open_block.append(" ")
                elif tag in BLOCK:
                    blocks.append(open_block)
                    open_block = []
                    todo.append(None)
                    todo.extend(reversed(self.parts[x]))
                else:
                    todo.extend(reversed(self.parts[x]))
        blocks.append(open_block)
        lines = (" ".join("".join(b).split()) for b in blocks if b)
        return "\n".join(x for x in lines if x)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the markup, plus ``text`` and ``n_chars``."""
    columns = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(F.col(html).alias("__html"), *[F.col(f"`{c}`") for c in columns])
    out = rows.select(*[F.col(f"`{c}`") for c in columns], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    return rows.mapInArrow(run, out)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
