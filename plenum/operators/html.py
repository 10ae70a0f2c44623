"""Rows of HTML tables and links of pages, by table functions that are called laterally.

The parser streams: it keeps the open elements and the open rows, never a tree.  Markup is read as browsers do where tables need
it: a row or cell ends where the next one of its table begins, a row outside a section belongs to the table's body, end tags that
nothing has opened do not count, and no end tag reaches beyond the table in which it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Elements without content, those whose text is not shown, and the ids of the pages' tables.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
HIDDEN = frozenset(("script", "style", "template"))
TABLE = "engagementTable"
BODY = "engagementTable:tbody_element"
HISTORY = "person-history"

ROWS = "rad int, ids array<string>, del string, rubriker array<string>, celler array<struct<text:string,href:string>>"
LINKS = "nr int, href string, text string, ids array<string>"


class _Page(HTMLParser):
    """Calls ``row`` and ``link`` with what is complete; a row within a cell is a row of its own, too."""

    #: What the start of an element ends, up to the nearest of the elements behind it.
    ENDS = {
        "td": (("td", "th"), ("tr", "table")),
        "th": (("td", "th"), ("tr", "table")),
        "tr": (("tr", "td", "th"), ("table",)),
        "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    }
    ENDS |= {"thead": ENDS["tbody"], "tfoot": ENDS["tbody"]}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []
        self.rows: list[dict] = []
        self.cells: list[dict] = []
        self.anchors: list[dict] = []
        self.begun = self.linked = 0
        self.found: list[tuple[str, tuple]] = []

    def _ids(self) -> list[str]:
        return [i for _, i in self.open if i]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, barrier = self.ENDS.get(tag, ((), ()))
        if tag == "a" and any(t == "a" for t, _ in self._inside(("table",))):
            self._close("a", ("table",))
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in barrier or not ended:
                break
            if self.open[i][0] in ended:
                while len(self.open) > i:
                    self._pop()
        values = dict(reversed(attrs))  # of repeated attributes the first counts
        if tag in VOID:
            return
        if tag == "tr":
            part = next((t for t, _ in reversed(self._inside(("table",))) if t in ("thead", "tfoot", "tbody")), "tbody")
            self.rows.append({"depth": len(self.open), "rad": self.begun, "ids": [*self._ids(), *([values["id"]] if values.get("id") else [])], "del": part, "heads": [], "cells": []})
            self.begun += 1
        elif tag in ("td", "th"):
            cell = {"depth": len(self.open), "text": [], "href": None}
            self.cells.append(cell)
            for row in self.rows:
                row["cells" if tag == "td" else "heads"].append(cell)
        elif tag == "a" and values.get("href") is not None:
            self.anchors.append({"depth": len(self.open), "nr": self.linked, "href": values["href"], "text": [], "ids": self._ids()})
            self.linked += 1
            for cell in self.cells:
                if cell["href"] is None:
                    cell["href"] = values["href"]
        self.open.append((tag, values.get("id")))

    def _inside(self, barrier: tuple[str, ...]) -> list[tuple[str, str | None]]:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in barrier:
                return self.open[i + 1 :]
        return self.open

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, () if tag == "table" else ("table",))

    def _close(self, tag: str, barrier: tuple[str, ...]) -> None:
        inside = self._inside(barrier)
        if any(t == tag for t, _ in inside):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, _ = self.open.pop()
        depth = len(self.open)
        if self.cells and self.cells[-1]["depth"] == depth:
            self.cells.pop()
        if self.anchors and self.anchors[-1]["depth"] == depth:
            a = self.anchors.pop()
            self.found.append(("link", (a["nr"], a["href"], "".join(a["text"]).strip(), a["ids"])))
        if self.rows and self.rows[-1]["depth"] == depth:
            r = self.rows.pop()
            cells = [{"text": "".join(c["text"]).strip(), "href": c["href"]} for c in r["cells"]]
            self.found.append(("row", (r["rad"], r["ids"], r["del"], ["".join(c["text"]).strip() for c in r["heads"]], cells)))
        return tag

    def handle_data(self, data: str) -> None:
        if not any(t in HIDDEN for t, _ in self.open[-1:]):
            for x in (*self.cells, *self.anchors):
                x["text"].append(data)

    def read(self, html: str, kind: str) -> Iterator[tuple]:
        for i in range(0, len(html), 1 << 16):
            self.feed(html[i : i + (1 << 16)])
            yield from self._taken(kind)
        self.close()
        while self.open:
            self._pop()
        yield from self._taken(kind)

    def _taken(self, kind: str) -> Iterator[tuple]:
        found, self.found = self.found, []
        return (x for k, x in found if k == kind)


@udtf(returnType=ROWS)
class HtmlRows:
    """Every table row of a page: place, ids of the elements around it (outermost first, its own last), section, texts of
    header cells, other cells with their first link."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from _Page().read(html or "", "row")


@udtf(returnType=LINKS)
class HtmlLinks:
    """Every link of a page: place, address, text, ids of the elements around it."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from _Page().read(html or "", "link")


def table_rows(pages: DataFrame, html: str) -> DataFrame:
    """``pages`` without ``html``, with a row per table row; a null or empty page has none."""
    rest = [c for c in pages.columns if c != html]
    return pages.lateralJoin(HtmlRows(F.col(html).outer())).select(*rest, *[x.split()[0] for x in ROWS.split(", ")])


def links(pages: DataFrame, html: str) -> DataFrame:
    """``pages`` without ``html``, with a row per link."""
    rest = [c for c in pages.columns if c != html]
    return pages.lateralJoin(HtmlLinks(F.col(html).outer())).select(*rest, *[x.split()[0] for x in LINKS.split(", ")])


def _engagements(pages: DataFrame, html: str) -> DataFrame:
    """Body rows of the pages' tables of engagements."""
    rows = table_rows(pages, html)
    return rows.filter((F.array_contains("ids", TABLE) & (F.col("del") == "tbody")) | F.array_contains("ids", BODY))


def _cell(n: int, field: str = "text") -> Column:
    return F.coalesce(F.get("celler", n)[field], F.lit(""))


def _after(href: Column, mark: str) -> Column:
    """What follows ``mark`` in an address, up to the query."""
    return F.split_part(F.split_part(href, F.lit(mark), F.lit(2)), F.lit("?"), F.lit(1))


def members(pages: DataFrame, html: str = "html") -> DataFrame:
    """An organisation page's members: id, efternamn, fornamn, parti, roll; rows without a person's link or name are none."""
    rest = [c for c in pages.columns if c != html]
    rows = _engagements(pages, html).select(
        *rest, "rad", _after(_cell(0, "href"), "/person/").alias("id"), _cell(0).alias("efternamn"), _cell(1).alias("fornamn"), _cell(2).alias("parti"), _cell(3).alias("roll")
    )
    return rows.filter((F.col("id") != "") & ((F.col("fornamn") != "") | (F.col("efternamn") != "")))


def assignments(pages: DataFrame, html: str = "html") -> DataFrame:
    """A person page's present assignments; the table of earlier ones has the same id and other columns, and is left out."""
    rest = [c for c in pages.columns if c != html]
    rows = _engagements(pages, html).filter(~F.array_contains("ids", HISTORY))
    rows = rows.select(
        *rest, "rad", _cell(0).alias("organisation"), F.split_part(_cell(0, "href"), F.lit("/organisation/"), F.lit(2)).alias("organisation_id"),
        _cell(1).alias("roll"), _cell(2).alias("fran"), F.nullif(_cell(3), F.lit("")).alias("till"),
    )
    return rows.filter("organisation != ''")


def emails(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, epost: the text of a page's first mail link."""
    found = links(pages.select(key, html), html).filter(F.col("href").startswith("mailto:"))
    return found.groupBy(key).agg(F.min_by("text", "nr").alias("epost"))
