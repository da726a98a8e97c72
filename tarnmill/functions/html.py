"""HTML functions: columns where expressions do, a parser where tables must be followed."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.functions.text import squeeze, unescape


def title(x: Column) -> Column:
    return squeeze(unescape(F.regexp_extract(x, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def heading(x: Column) -> Column:
    return squeeze(unescape(F.regexp_replace(F.regexp_extract(x, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")))


def page_text(x: Column, most: int = 15_000) -> Column:
    """Text without scripts, styles, comments and tags, in lower case."""
    c = F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.substring(F.lower(squeeze(unescape(F.regexp_replace(c, "<[^>]+>", " ")))), 1, most)


def links(x: Column) -> Column:
    """Targets of links, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r'<a href="([^"]+)"'), F.lit(1)))


def meta(x: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(x, rf'(?i)<meta[^>]+(?:property|name)="{name}"[^>]+content="([^"]*)"', 1), F.lit(""))


def json_ld(x: Column) -> Column:
    """Struct (title, company, city, id) of a posting in JSON-LD, or null."""
    raw = F.regexp_extract(x, r'(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    field = lambda p: F.get_json_object(raw, p)
    found = F.struct(field("$.title").alias("title"), field("$.hiringOrganization.name").alias("company"), field("$.jobLocation.address.addressLocality").alias("city"), field("$.identifier.value").alias("id"))
    return F.when(field("$.title").isNotNull(), found)


class _Tables(HTMLParser):
    """Rows of tables with the heading above each."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[str, list[str], str]] = []
        self.section, self.cells, self.href = "", None, ""
        self.inside: str | None = None
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.cells, self.href = [], ""
        elif tag in ("td", "th", "h1", "h2", "h3"):
            self.inside, self.text = tag, ""
        elif tag == "a" and self.cells is not None:
            self.href = dict(attrs).get("href") or self.href

    def handle_data(self, data):
        if self.inside:
            self.text += data

    def handle_endtag(self, tag):
        if tag == self.inside:
            text = " ".join(html.unescape(self.text).split())
            if tag[0] == "h":
                self.section = text
            elif tag == "td" and self.cells is not None:
                self.cells.append(text)
            self.inside = None
        elif tag == "tr":
            if self.cells:
                self.rows.append((self.section, self.cells, self.href))
            self.cells = None


def table_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, section, cells, url) of every row of every table of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = _Tables()
                parser.feed(text or "")
                if parser.rows:
                    section, cells, url = zip(*parser.rows)
                    yield pa.record_batch([pa.array([page] * len(url), batch.schema.field(0).type), pa.array(section), pa.array(cells, pa.list_(pa.string())), pa.array(url)], names=[id_col, "section", "cells", "url"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, section string, cells array<string>, url string")


def original_link(x: Column, own: str) -> Column:
    """Link to the posting that a page was made from: a link marked as origin, then one whose text says so, then the
    apply link of the page's data; links to the site itself (a pattern) don't count. Null if there is none."""
    href = r"""href=["'](https?://[^"']+)["']"""
    ways = [
        rf"""(?is)<a\b(?=[^>]*class=["'][^"']*origin)[^>]*{href}""", rf"""(?is)<a\b[^>]*{href}[^>]*>(?:(?!</a>).)*original(?:(?!</a>).)*(?:job|post)""",
        r"""(?is)"(?:applyLink|originalUrl)"\s*:\s*"(https?://[^"]+)\"""",
    ]
    found = F.array(*[F.nullif(F.regexp_extract(x, w, 1), F.lit("")) for w in ways])
    return F.get(F.filter(found, lambda u: u.isNotNull() & ~F.lower(u).rlike(own)), 0)


class _Cards(HTMLParser):
    """Cards of postings: elements marked as a job card, with their first link and their lines of text."""

    def __init__(self):
        super().__init__()
        self.cards: list[tuple[str, list[str]]] = []
        self.depth, self.tag, self.href, self.lines = 0, "", "", []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if not self.depth and (own.get("data-test-id") == "job-card" or "job-card" in (own.get("class") or "").split()):
            self.depth, self.tag, self.href, self.lines = 1, tag, "", []
        elif self.depth:
            self.depth += tag == self.tag
            if tag == "a" and not self.href:
                self.href = own.get("href") or ""

    def handle_data(self, data):
        if self.depth and data.strip():
            self.lines.append(" ".join(data.split()))

    def handle_endtag(self, tag):
        if self.depth and tag == self.tag:
            self.depth -= 1
            if not self.depth and self.lines:
                self.cards.append((self.href, self.lines))


def cards(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, company, location, url) of every job card of each page, one for each URL without its query: the
    title is the first line, 'Company \u00b7 Place' (or two lines) follow. Cards without a link or a title go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = _Cards()
                parser.feed(text or "")
                seen = set()
                for href, lines in parser.cards:
                    url = href.split("?")[0]
                    rest = [part.strip() for line in lines[1:] for part in line.split("\u00b7") if part.strip()]
                    if url and url not in seen:
                        seen.add(url)
                        out.append((page, lines[0], rest[0] if rest else None, rest[1] if len(rest) > 1 else None, url))
            if out:
                kinds = [batch.schema.field(0).type, *[pa.string()] * 4]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[id_col, "title", "company", "location", "url"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, title string, company string, location string, url string")
