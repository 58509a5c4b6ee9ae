"""HTML extraction (X1): elements as rows, parsed where the page lies.

HTML is not a regular language and Spark has no HTML reader, so this is the one
Python operator.  It streams Arrow batches: no shuffle, a bounded number of elements in memory.  A board gets a row
per card with the elements in it, so that a card's fields are expressions over one row and nothing is grouped again;
``elements`` gives a row per element with the path of its ancestors.  All further logic is DataFrame expressions.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ship the parser itself to the executors: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NO_TEXT = frozenset(("script", "style", "template"))
_WHOLE_PAGE = frozenset(("html", "head", "body"))  # their text is the page: not repeated per element

_COLUMNS = ("request_seq", "fetched_at", "node", "tag", "classes", "href", "alt", "datetime", "pieces", "path")
ELEMENTS_SCHEMA = ("request_seq BIGINT, fetched_at TIMESTAMP, node INT, tag STRING, classes ARRAY<STRING>, href STRING, "
                   "alt STRING, datetime STRING, pieces ARRAY<STRING>, "
                   "path ARRAY<STRUCT<node: INT, tag: STRING, classes: ARRAY<STRING>, href: STRING>>")


class _Elements(HTMLParser):
    """Collects elements in document order with their parent and inner text pieces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        known = dict(attrs)
        row = {"node": len(self.rows), "tag": tag, "classes": (known.get("class") or "").split(),
               "href": known.get("href"), "alt": known.get("alt"), "datetime": known.get("datetime"), "pieces": []}
        row["parent"] = self.open[-1]["node"] if self.open else None
        self.rows.append(row)
        if tag not in _VOID:
            self.open.append(row)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        piece = data.strip()
        if piece and self.open and self.open[-1]["tag"] not in _NO_TEXT:
            for row in self.open:
                if row["tag"] not in _WHOLE_PAGE:
                    row["pieces"].append(piece)

    def read_plain(self, page: str) -> bool:
        """Read a page of nothing but plain tags and text by one pattern; False as soon as something else is met.

        A plain tag has quoted attributes without entities.  Elements whose content is no markup are not plain.
        """
        at = 0
        for token in _TOKEN.finditer(page):
            if token.start() != at:
                return False
            at = token.end()
            tag, attrs, ended, text = token.groups()
            if text is not None:
                self.handle_data(unescape(text) if "&" in text else text)
            elif tag is not None:
                tag = tag.lower()
                if tag in _NO_MARKUP or (self.open and self.open[-1]["tag"] == "title"):
                    return False
                self.handle_starttag(tag, [(name.lower(), value) for name, value in _ATTRIBUTE.findall(attrs)])
            elif ended is not None:
                ended = ended.lower()
                if self.open and self.open[-1]["tag"] == "title" and ended != "title":
                    return False
                self.handle_endtag(ended)
        return at == len(page)


_NO_MARKUP = frozenset("script style textarea xmp iframe noembed noframes noscript plaintext svg math".split())
_ATTRIBUTE = re.compile(r'([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
_TOKEN = re.compile(r'''<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9-]*="[^"<>&]*")*)[ \t\n\r\f]*>'''
                    r'''|</([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>|([^<]+)|<!(?:DOCTYPE|doctype)[ a-zA-Z0-9]*>''')


def _rows_of(page: str) -> list[dict]:
    """Elements of a page, by the parser for all of HTML only where it takes that."""
    parser = _Elements()
    if not parser.read_plain(page):
        parser = _Elements()
        parser.feed(page)
        parser.close()
    return parser.rows


_ROWS_PER_FRAME = 20_000


def _paths(rows: list[dict]) -> list[list[dict]]:
    """Per element the steps from the root to itself."""
    paths: list[list[dict]] = []
    for row in rows:
        step = {name: row[name] for name in ("node", "tag", "classes", "href")}
        paths.append([*(paths[row["parent"]] if row["parent"] is not None else []), step])
    return paths


@dataclass(frozen=True)
class Cards:
    """Which elements of a page are cards: those of the first selector that any element meets, else the
    innermost blocks around links that match a pattern, or a link itself outside of any."""

    selectors: tuple[str, ...]
    link: str | None = None
    blocks: tuple[str, ...] = ()

    def of(self, rows: list[dict]) -> set[int]:
        for selector in self.selectors:
            found = {r["node"] for r in rows if meets(selector, r["tag"], r["classes"])}
            if found:
                return found
        around: list[int | None] = []
        found = set()
        for row in rows:
            above = around[row["parent"]] if row["parent"] is not None else None
            around.append(row["node"] if row["tag"] in self.blocks else above)
            if self.link and row["tag"] == "a" and re.search(self.link, row["href"] or ""):
                found.add(row["node"] if around[-1] is None else around[-1])
        return found


def meets(selector: str, tag: str, classes: list[str]) -> bool:
    """'tag.class', 'tag' or '*part' (any class containing the part)."""
    if selector.startswith("*"):
        return selector[1:] in " ".join(classes)
    name, _, wanted = selector.partition(".")
    return tag == name and (not wanted or wanted in classes)


def _in_cards(rows: list[dict], cards: Cards) -> dict[int, list[dict]]:
    """Elements per card, the card itself first; one in several cards stands in each."""
    chosen = cards.of(rows)
    inside: list[tuple[int, ...]] = []
    found: dict[int, list[dict]] = {}
    for row in rows:
        above = inside[row["parent"]] if row["parent"] is not None else ()
        inside.append((*above, row["node"]) if row["node"] in chosen else above)
        for card in inside[-1]:
            found.setdefault(card, []).append(row)
    return found


def _extract(columns: tuple[str, ...], rows_of):
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for page in batch.itertuples(index=False):
                rows += [(page.request_seq, page.fetched_at, *row) for row in rows_of(_rows_of(page.body))]
                if len(rows) >= _ROWS_PER_FRAME:
                    yield pd.DataFrame(rows, columns=list(columns))
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=list(columns))

    return extract


_PLAIN = ("node", "tag", "classes", "href", "alt", "datetime", "pieces")


def _all_rows(rows: list[dict]) -> Iterator[tuple]:
    return ((*(row[name] for name in _PLAIN), path) for row, path in zip(rows, _paths(rows), strict=True))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("request_seq").cast("long"), "fetched_at", "body").filter(F.col("body").isNotNull())


def _joined(rows: DataFrame) -> DataFrame:
    """Text leaves the parser once, as pieces; both joined forms are expressions over them."""
    return rows.withColumns({"text": F.array_join("pieces", ""), "spaced_text": F.array_join("pieces", " ")}).drop("pieces")


def elements(pages: DataFrame) -> DataFrame:
    """One row per element of each page (columns request_seq, fetched_at, body), with its path."""
    return _joined(_pages(pages).mapInPandas(_extract(_COLUMNS, _all_rows), ELEMENTS_SCHEMA))


_ELEMENT = (("node", pa.int32()), ("tag", pa.string()), ("classes", pa.string()), ("href", pa.string()), ("alt", pa.string()),
            ("datetime", pa.string()), ("box", pa.int32()), ("text", pa.string()))
_ELEMENT_SCHEMA = "ARRAY<STRUCT<node: INT, tag: STRING, classes: STRING, href: STRING, alt: STRING, datetime: STRING, box: INT, text: STRING>>"
CARDS_SCHEMA = f"request_seq BIGINT, fetched_at TIMESTAMP, card INT, spaced_text STRING, elements {_ELEMENT_SCHEMA}"
LINKS_SCHEMA = f"{CARDS_SCHEMA}, around {_ELEMENT_SCHEMA}, outer {_ELEMENT_SCHEMA}, outer_text STRING"


def _element_lists(lists: list[list[dict] | None], boxes: list[list[int | None]]) -> pa.Array:
    """Elements as one Arrow list per entry, null for none; ``boxes`` has the box of each element by node, per entry."""
    flat = [(row, box[row["node"]]) for rows, box in zip(lists, boxes, strict=True) for row in rows or ()]
    columns = ([r["node"] for r, _ in flat], [r["tag"] for r, _ in flat], [" ".join(r["classes"]) for r, _ in flat], [r["href"] for r, _ in flat],
               [r["alt"] for r, _ in flat], [r["datetime"] for r, _ in flat], [b for _, b in flat], ["".join(r["pieces"]) for r, _ in flat])
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _ELEMENT, strict=True)], names=[n for n, _ in _ELEMENT])
    starts, at = [], 0
    for rows in lists:
        starts.append(None if rows is None else at)
        at += len(rows or ())
    return pa.ListArray.from_arrays(pa.array([*starts, at], pa.int32()), values)


def _boxes(rows: list[dict], selector: str | None) -> list[int | None]:
    """Per element the innermost one around it, or itself, that meets the selector."""
    out: list[int | None] = []
    for row in rows:
        above = out[row["parent"]] if row["parent"] is not None else None
        out.append(row["node"] if selector and meets(selector, row["tag"], row["classes"]) else above)
    return out


@dataclass(frozen=True)
class Around:
    """Elements beside a card: those with ``near`` tags in the innermost of ``blocks`` around it, and those with
    ``far`` tags in the innermost of ``outer`` blocks around that one, or in that one if there is none."""

    blocks: tuple[str, ...]
    outer: tuple[str, ...]
    near: tuple[str, ...]
    far: tuple[str, ...]

    def of(self, rows: list[dict], cards: list[int]) -> list[tuple]:
        above: list[tuple[int, ...]] = []  # the blocks around each element, itself left out
        for row in rows:
            up = row["parent"]
            above.append(() if up is None else (*above[up], up) if rows[up]["tag"] in self.blocks else above[up])
        inner = {card: above[card][-1] if above[card] else None for card in cards}
        wide = {card: next((n for n in reversed(above[b]) if rows[n]["tag"] in self.outer), b) if (b := inner[card]) is not None else None for card in cards}
        near = {b: [] for b in inner.values() if b is not None}
        far = {b: [] for b in wide.values() if b is not None}
        for row in rows:
            for block in above[row["node"]]:
                if block in near and row["tag"] in self.near:
                    near[block].append(row)
                if block in far and row["tag"] in self.far:
                    far[block].append(row)
        return [(near.get(inner[c]), far.get(wide[c]), None if wide[c] is None else " ".join(rows[wide[c]]["pieces"])) for c in cards]


def _cards(cards: Cards, box: str | None, around: Around | None):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            held = 0
            for at, body in enumerate(batch.column("body")):
                elements = _rows_of(body.as_py())
                inside, boxes = _in_cards(elements, cards), _boxes(elements, box)
                beside = around.of(elements, list(inside)) if around else [()] * len(inside)
                found += [(at, card, rows, boxes, more) for (card, rows), more in zip(inside.items(), beside, strict=True)]
                held += sum(map(len, inside.values()))
                if held >= _ROWS_PER_FRAME:
                    yield frame(batch, found)
                    found, held = [], 0
            if found:
                yield frame(batch, found)

    def frame(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        pages = pa.array([f[0] for f in found], pa.int32())
        boxes = [f[3] for f in found]
        columns = {"request_seq": batch.column("request_seq").take(pages), "fetched_at": batch.column("fetched_at").take(pages),
                   "card": pa.array([f[1] for f in found], pa.int32()), "spaced_text": pa.array([" ".join(f[2][0]["pieces"]) for f in found], pa.string()),
                   "elements": _element_lists([f[2] for f in found], boxes)}
        if around:
            columns |= {"around": _element_lists([f[4][0] for f in found], boxes), "outer": _element_lists([f[4][1] for f in found], boxes),
                        "outer_text": pa.array([f[4][2] for f in found], pa.string())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return extract


def card_elements(pages: DataFrame, cards: Cards, box: str | None = None, around: Around | None = None) -> DataFrame:
    """One row per card (column ``card``, its node) with the elements in it in page order, the card itself first.

    Classes are one text, single-spaced.  ``box`` is the innermost element around an element that meets the selector; with
    ``around`` come the elements beside the card.  The rest of a page doesn't leave the parser.
    """
    return _pages(pages).mapInArrow(_cards(cards, box, around), LINKS_SCHEMA if around else CARDS_SCHEMA)
