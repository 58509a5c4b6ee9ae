"""Main text of web pages by tree scoring.

A page becomes a tree of elements and a list of text blocks in page order.  Each block passes
points for its length and its commas to its ancestors, fewer the further away and none beyond ``REACH`` of them, and an
element's points are discounted by its link density.  The best element, or the article or main
element it lies in, which stays whole, and those siblings that look like content are kept; menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out wherever they stand.  The header of an article is part of it.  A list that is mostly
links is a menu, unless a heading introduces it.

Defined cases: null, empty or text-free html gives an empty text; unclosed elements end with
their parent; an unclosed script, style or comment hides the rest of the page; a page without
any candidate gives all its remaining blocks; ties go to the element that starts first; a column that is called as the
result is replaced by it.  Reading takes time in proportion to the page, however deep or broken it is.
Pages are independent of each other, so the work is one scan without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsieve.llm.common import small_batches, table

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption tr td th summary".split())
_BLOCKS = _PARAGRAPHS - {"td", "th"} | frozenset(
    "html body main article section div ul ol dl table thead tbody tfoot figure address details center fieldset hr nav header footer aside form menu dialog".split())
_SPACES = frozenset("br td th".split())
_LEFT_OUT = frozenset("head nav header footer aside form button select option input object embed canvas dialog menu audio video datalist label legend".split()) | _RAW
_NEVER_BY_NAME = frozenset("html body main article".split())
#: Start tags that end an open element of the given kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("html body table ul ol dl div section article main td th blockquote button".split())
_UNWANTED = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar comment comments disqus
 cookie cookies notice notices consent gdpr newsletter subscribe subscription signup login share sharing social related recommended breadcrumb
 breadcrumbs menu nav navbar navigation footer header masthead popup modal overlay widget toolbar pagination pager alert replies respond outbrain taboola""".split())
_WANTED = frozenset("article body content main post entry story text".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_BONUS = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "form": -3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}
_LEAST_CHARS = 25
#: Ancestors a block passes points to.
REACH = 16
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SENTENCE = re.compile(r"[.!?\u2026\u3002](\s|$)")


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): html.unescape(value.strip("\"'")) for name, value in _ATTRIBUTE.findall(raw)}


def _unwanted(tag: str, raw: str) -> bool:
    """Whether an element is no article text by its name, role, classes or id."""
    if tag in _LEFT_OUT:
        return True
    if not raw or tag in _NEVER_BY_NAME:
        return False
    found = _attributes(raw)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _ROLES:
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    names = [set(re.split(r"[-_\s]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower())) for n in [*found.get("class", "").split(), found.get("id", "")]]
    bad = [bool(n & _UNWANTED) for n in names]
    return any(bad) and not any(n & _WANTED and not b for n, b in zip(names, bad, strict=True))


class _Page:
    """Elements by number (parent, tag, left out) and blocks (element, text, characters in links)."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.out = [-1], ["#"], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._open = [0]
        # Where in ``_open`` the elements of a tag, the blocks and the scopes stand, innermost last.
        self._at: dict[str, list[int]] = {}
        self._blocks_at, self._scopes_at = [0], [0]
        self._articles = 0
        self._text: list[str] = []
        self._links: list[str] = []
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            block = self._open[self._blocks_at[-1]]
            text = " ".join("".join(self._text).split())
            if text and not self.out[block]:
                self.blocks.append((block, text, len(" ".join("".join(self._links).split()))))
            self._text, self._links = [], []

    def _add(self, text: str) -> None:
        if text and not self.out[self._open[-1]]:
            self._text.append(text)
            if self._at.get("a"):
                self._links.append(text)

    def _close(self, depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        if self._blocks_at[-1] >= max(depth, 1):
            self._flush()
        for at in range(len(self._open) - 1, depth - 1, -1):
            tag = self.tag[self._open[at]]
            self._at[tag].pop()
            for stack in (self._blocks_at, self._scopes_at):
                if stack[-1] == at:
                    stack.pop()
            self._articles -= tag in ("article", "main")
        del self._open[depth:]

    def _innermost(self, tags: frozenset[str] | set[str]) -> int:
        """The place of the innermost open element of the tags, 0 for none."""
        return max((self._at[tag][-1] for tag in tags if self._at.get(tag)), default=0)

    def _start(self, tag: str, raw: str) -> None:
        if tag in _BLOCKS:
            self._flush()
            at = self._innermost({"p"})
            if tag != "hr" and at and self._scopes_at[-1] <= at:
                self._close(at)
        if tag in _ENDS:
            at = self._innermost(_ENDS[tag])
            if at and self._scopes_at[-1] <= at:
                self._close(at)
        if tag in _SPACES:
            self._add(" ")
        if tag in _VOID or raw.endswith("/") and tag in _RAW:
            return
        at = len(self._open)
        own_header = tag == "header" and self._articles > 0
        self.parent.append(self._open[-1])
        self.tag.append(tag)
        self.out.append(self.out[self._open[-1]] or _unwanted("div" if own_header else tag, "" if own_header else raw))
        self._open.append(len(self.tag) - 1)
        self._at.setdefault(tag, []).append(at)
        if tag in _BLOCKS:
            self._blocks_at.append(at)
        if tag in _SCOPES:
            self._scopes_at.append(at)
        self._articles += tag in ("article", "main")

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">") + 1
        while True:
            found = _MARKUP.search(source, at, last) if at < last else None
            if found and found[0].startswith("<!--") and not found[0].endswith("-->"):
                found = _MARKUP.search(source, found.start())
            until = found.start() if found else source.find("<!--", at)  # only an unclosed comment can follow the last tag
            self._add(html.unescape(source[at:until if until >= 0 else len(source)]))
            if not found:
                break
            at = found.end()
            closing, tag, raw = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                depth = self._at[tag][-1] if self._at.get(tag) else None
                if depth is not None and (tag in _BLOCKS or self._scopes_at[-1] <= depth):
                    self._close(depth)
                continue
            self._start(tag, raw)
            if tag in _RAW and not raw.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
                self._close(len(self._open) - 1)
        self._close(1)
        self._flush()


def _scored(page: _Page) -> tuple[list[float], list[int], list[int], list[float]]:
    """Per element its score, characters, blocks with links, and link density."""
    count = len(page.tag)
    points, chars, linked, links = [0.0] * count, [0] * count, [0] * count, [0] * count
    holds_blocks = {page.parent[e] for e in range(1, count) if page.tag[e] in _BLOCKS}
    for element, text, in_links in page.blocks:
        # Text of a paragraph, or of another element without blocks in it, counts for what is around.
        paragraph = page.tag[element] in _PARAGRAPHS or element not in holds_blocks and page.tag[element] not in _NEVER_BY_NAME
        up = page.parent[element] if paragraph and page.parent[element] >= 0 else element
        worth = 1 + text.count(",") + text.count("、") + min(len(text) / 100, 3.0) if len(text) >= _LEAST_CHARS else 0.0
        worth *= 1 - in_links / max(len(text), 1)
        for level in range(REACH if worth else 0):
            points[up] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = page.parent[up]
            if up < 0:
                break
        chars[element] += len(text)
        linked[element] += in_links
        links[element] += in_links > 0
    for e in range(count - 1, 0, -1):  # an element comes after its parent
        up = page.parent[e]
        chars[up] += chars[e]
        linked[up] += linked[e]
        links[up] += links[e]
    density = [linked[e] / chars[e] if chars[e] else 0.0 for e in range(count)]
    scores = [(points[e] + _BONUS.get(page.tag[e], 0.0)) * (1 - density[e]) if points[e] > 0 or page.tag[e] in _NEVER_BY_NAME and chars[e] else 0.0 for e in range(count)]
    return scores, chars, links, density


def _within(page: _Page, roots: set[int]) -> list[bool]:
    """Whether an element is one of the roots or lies in one."""
    inside = [e in roots for e in range(len(page.tag))]
    for e in range(1, len(inside)):
        inside[e] = inside[e] or inside[page.parent[e]]
    return inside


def _introduced(page: _Page, chars: list[int]) -> set[int]:
    """Elements that a heading directly before them, beside them or around its end, introduces."""
    before: dict[int, int] = {}  # the last child with text, per parent
    found = set()
    for e in range(1, len(page.tag)):
        if page.out[e] or not chars[e]:
            continue
        previous = before.get(page.parent[e])
        if previous is not None and page.tag[previous] in _HEADINGS:
            found.add(e)
        before[page.parent[e]] = e
    return found


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, an empty line between them."""
    page = _Page(source or "")
    count = len(page.tag)
    scores, chars, links, density = _scored(page)
    best = max(range(count), key=lambda e: (scores[e], -e))
    article = best if scores[best] > 0 else -1
    while article >= 0 and page.tag[article] not in ("article", "main"):
        article = page.parent[article]
    best = article if article >= 0 else best
    roots = {best} if scores[best] > 0 or article >= 0 else {0}
    if scores[best] > 0:
        said = [False] * count  # whether it holds a block with a whole sentence
        for e, text, in_links in page.blocks:
            said[e] = said[e] or len(text) > 80 or bool(_SENTENCE.search(text)) and not in_links
        for e in range(count - 1, 0, -1):
            said[page.parent[e]] = said[page.parent[e]] or said[e]
        for e in range(count):
            if page.parent[e] == page.parent[best] and e != best and not page.out[e] and chars[e]:
                plain = density[e] < 0.25 and said[e]
                plain = plain or page.tag[e] in ("h1", "h2", "h3") and density[e] == 0
                if plain or scores[e] >= max(10.0, scores[best] * 0.2):
                    roots.add(e)
    introduced = _introduced(page, chars)
    menus = {e for e in range(count) if page.tag[e] in ("ul", "ol", "div", "table", "section") and links[e] >= 3 and density[e] > 0.6 and e not in introduced}
    kept, whole, menu = _within(page, roots), _within(page, {article} if article >= 0 else set()), _within(page, menus)
    return "\n\n".join(text for e, text, _ in page.blocks if whole[e] or kept[e] and not menu[e])


def extract(pages: DataFrame, to: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in column ``to``."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda source: main_text(source if isinstance(source, str) else None))

    return pages.withColumn(to, texts.asNondeterministic()(F.col("html")))


def op8_html_extraction(spark, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
