"""Text out of markup, with the standard library's parser over Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "tr", "div")
SILENT = ("script", "style", "noscript")
VOID = ("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr")


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str | None], parent: _Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[_Node | str] = []

    def text(self) -> str:
        out: list[str] = []

        def walk(n: _Node) -> None:
            for k in n.kids:
                if isinstance(k, str):
                    if s := k.strip():
                        out.append(s)
                elif k.tag not in SILENT:
                    walk(k)

        walk(self)
        return " ".join(out)

    def all(self, tags: tuple[str, ...]) -> list[_Node]:
        out: list[_Node] = []
        for k in self.kids:
            if not isinstance(k, str) and k.tag not in SILENT:
                if k.tag in tags:
                    out.append(k)
                out += k.all(tags)
        return out


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("p", "li") and self.at.tag == tag:  # these end where the next begins
            self.at = self.at.parent or self.root
        n = _Node(tag, dict(attrs), self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag: str) -> None:
        n: _Node | None = self.at
        while n and n.tag != tag:
            n = n.parent
        if n and n.parent:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def tree(html: str) -> _Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def plain(html: str | None) -> str:
    """The text of every block element, a blank line between; a block within a block is there twice. Without blocks, all of the text."""
    root = tree(html or "")
    parts = [s for n in root.all(BLOCKS) if (s := n.text())]
    return "\n\n".join(parts) if parts else root.text()


def article(html: str | None) -> dict[str, str | None]:
    """headline (first h1), date (of the time element, or of a class with date in its name), body (p, li, h2, h3 of the article, else all p)."""
    root = tree(html or "")
    h1 = root.all(("h1",))
    times = root.all(("time",))
    when = None
    if times:
        when = times[0].attrs.get("datetime") or times[0].text() or None
    else:
        dated = [n for n in _every(root) if "date" in (n.attrs.get("class") or "").lower()]
        when = dated[0].text() if dated else None
    inner = root.all(("article",))
    parts = [n.text() for n in (inner[0].all(("p", "li", "h2", "h3")) if inner else root.all(("p",)))]
    return {"headline": h1[0].text() if h1 else None, "date_raw": when, "body": "\n\n".join(p for p in parts if p)}


def _every(n: _Node) -> list[_Node]:
    out: list[_Node] = []
    for k in n.kids:
        if not isinstance(k, str):
            out += [k, *_every(k)]
    return out


def html_to_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(plain)

    return f(html)


def parse_article(html: Column) -> Column:
    """STRUCT<headline, date_raw, body>."""

    @F.pandas_udf("headline string, date_raw string, body string")
    def f(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(x) for x in s], columns=["headline", "date_raw", "body"])

    return f(html)


def article_links(html: Column, base: str) -> Column:
    """Links to dated articles, /…/YYYY-MM-DD-slug, made absolute, each once in the order they stand."""
    root = re.match(r"https?://[^/]+", base)
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""href=["']([^"'#?]*/\d{4}-\d{2}-\d{2}-[^"'#?/]+)"""), F.lit(1))
    return F.array_distinct(F.transform(hrefs, lambda h: F.when(h.rlike("^https?://"), h).otherwise(F.concat(F.lit(root[0] if root else base), h))))
