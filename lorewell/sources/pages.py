"""Web results: the search interface, an offline provider over a table, page text from HTML, and result filters."""

from __future__ import annotations

from html.parser import HTMLParser
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.text import result_title
from lorewell.operators.merge import keep_first


class SearchProvider(Protocol):
    """Results of a web search: pos, url, title, text."""

    def search(self, query: str) -> DataFrame: ...


class TableProvider:
    """Offline results: the rows of a table of fetched pages that were fetched for the query."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def search(self, query: str) -> DataFrame:
        return self.pages.where(F.col("query_text") == query).select(F.col("page_id").alias("pos"), "url", "title", "text")


def result_links(results: DataFrame, order: str = "pos") -> DataFrame:
    """Results whose link holds `http` and not `doc.`, the first of each url, with the short title."""
    good = results.where(F.contains("url", F.lit("http")) & ~F.contains("url", F.lit("doc.")))
    return keep_first(good, ["url"], order).withColumn("title", result_title(F.col("title")))


class _Paragraphs(HTMLParser):
    """Text directly inside p elements; nested elements' text is left out, an unclosed p ends at the next."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.VOID:
            if self.out and self.stack[-1:] == ["p"]:
                self.out.append("")
            return
        if tag == "p" and "p" in self.stack:
            del self.stack[self.stack.index("p") :]
        self.stack.append(tag)

    def handle_endtag(self, tag) -> None:
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data) -> None:
        if self.stack[-1:] == ["p"]:
            self.out.append(data)


def paragraph_text(html: str | None) -> str:
    if not html:
        return ""
    p = _Paragraphs()
    p.feed(html)
    p.close()
    return "\n".join(x for x in p.out if x)


def page_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(paragraph_text)

    return run(html)


def extract_pages(pages: DataFrame, html: str = "html", least: int = 15) -> DataFrame:
    """Pages with the text of their paragraphs; those with no more than `least` characters are left out."""
    return pages.withColumn("text", page_text(F.col(html))).where(F.length("text") > least)
