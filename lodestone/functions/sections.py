"""The part of a page that tells of a product: its list of specifications, its best table, or the text around the first mention."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without content of their own, words that specifications are full of, and the limits of a table and of a window.
SKIPPED = ("script", "style", "noscript", "nav", "footer", "header", "aside", "form", "svg")
SIGNALS = ("ghz", "mhz", " bit", "mb", "gb", "tdp", "core", "clock", "memory", "pipeline", "vram", " mm", "nm", "watt", "@")
TABLE_CHARACTERS, LEAST_DENSITY, REACH, MOST = 8000, 0.006, 6000, 16000
#: Elements that never close.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """Reads a page's tags once. Pieces of text stand in order; tables and the list of specifications are ranges of them.

    An end tag closes all that was opened after its start; one without a start is passed over; what is never closed ends with the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[tuple[str, int | None]] = []  # tag, place of its range
        self.ranges: list[list] = []  # kind, from, to
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        listed = any(name == "id" and value == "specs-list" for name, value in attrs)
        at = None
        if (tag == "table" or listed) and not self.hidden:
            at = len(self.ranges)
            self.ranges.append(["list" if listed else "table", len(self.pieces), None])
        self.hidden += tag in SKIPPED
        self.open.append((tag, at))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while True:
            t, at = self.open.pop()
            self.hidden -= t in SKIPPED
            if at is not None:
                self.ranges[at][2] = len(self.pieces)
            if t == tag:
                return

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.pieces.append(" ".join(data.split()))

    def text(self, start: int = 0, end: int | None = None) -> str:
        return " ".join(self.pieces[start:end])


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def _mentions(folded: str, models: list[str]) -> int:
    """How often one of the models stands in the text as a word of its own."""
    return sum(len(re.findall(rf"(?<![a-z0-9]){re.escape(m)}(?![a-z0-9])", folded)) for m in models)


def _density(text: str) -> float:
    low = text.lower()
    return sum(low.count(s) for s in SIGNALS) / max(1, len(text))


def section_of(html: str, needles: list[str], prefer_text: bool = False) -> str:
    page = _Page()
    page.feed(html)
    page.close()
    for kind, start, end in page.ranges:
        if kind == "list":
            return page.text(start, end)
    wanted = [n.casefold() for n in needles]
    models = [n for n in wanted if len(n) >= 3 and " " not in n and re.search("[0-9]", n)]
    if not prefer_text:
        tables = [(t, f) for t, f in ((t, _folded(t)) for t in (page.text(a, b) for _, a, b in page.ranges)) if any(n in f for n in wanted)]
        pool = [x for x in tables if len(x[0]) <= TABLE_CHARACTERS] or tables
        if pool:
            best, _ = max(pool, key=lambda x: (_mentions(x[1], models), _density(x[0])))  # of equals the first
            if _density(best) >= LEAST_DENSITY:
                return best
    text = page.text()
    folded = _folded(text)
    first = min((i for i in (folded.find(n) for n in wanted) if i >= 0), default=None)
    return text[:MOST] if first is None else text[max(0, first - REACH) : first + REACH]


@F.pandas_udf(T.StringType())
def section(html: pd.Series, needles: pd.Series) -> pd.Series:
    """For each page (html) and its product's words (needles, an array): the text of the element with the id specs-list; else of the table that
    names a needle, at most TABLE_CHARACTERS long if there is one, with the most mentions of models, then the highest density
    of SIGNALS, if that is LEAST_DENSITY or more; else a window around the first needle. Null pages have none, null needles are none."""
    return pd.Series([None if h is None else section_of(h, [n for n in (ns if ns is not None else []) if n]) for h, ns in zip(html, needles, strict=True)])
