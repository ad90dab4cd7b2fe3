"""What a page's HTML holds: title, visible text, description, canonical URL, language, links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spidex.schemas import PARSED_PAGE

_HIDDEN = {"script", "style", "noscript", "template"}
_BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul body".split())
LARGEST = 2 * 1024 * 1024  # bytes of a body that are read; the rest is left
AT_ONCE = 64  # pages that are parsed before their rows are handed on
_BLANK = re.compile(r"[ \t\n\f\r\xa0]+")
_BARE = re.compile(r"&(?=#?[A-Za-z0-9]++(?!;))")


def collapsed(text: str) -> str:
    return _BLANK.sub(" ", text).strip(" ")


class _Page(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.hidden, self.in_head, self.titles = base, 0, False, None
        self.title: list[str] = []
        self.text: list[str] = []
        self.description, self.canonical, self.language = None, None, None
        self.links: list[list] = []
        self.anchor: list | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "html" and self.language is None:
            self.language = a.get("lang", "")
        elif tag == "title" and self.titles is None:
            self.titles = True
        elif tag == "meta" and a.get("name", "").lower() == "description" and self.description is None:
            self.description = a.get("content", "")
        elif tag == "base" and "href" in a:
            self.base = urljoin(self.base, a["href"])
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split() and self.canonical is None:
            self.canonical = self.absolute(a.get("href"))
        elif tag == "a" and "href" in a:
            self.anchor = [self.absolute(a["href"]), []]
            self.links.append(self.anchor)
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BLOCKS:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag == "head":
            self.in_head = False
        elif tag == "title":
            self.titles = False if self.titles else self.titles
        elif tag == "a":
            self.anchor = None
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in _BLOCKS:
            self.text.append(" ")

    def handle_data(self, data):
        if self.titles:
            self.title.append(data)
        elif not self.hidden and not self.in_head:
            self.text.append(data)
            if self.anchor:
                self.anchor[1].append(data)

    def absolute(self, href: str | None) -> str:
        try:
            return urljoin(self.base, (href or "").strip())
        except ValueError:
            return ""


def capped(html: str | None, largest: int = LARGEST) -> str:
    """The body as far as it is read."""
    html = html or ""
    return html if 4 * len(html) <= largest or len(data := html.encode("utf-8", "replace")) <= largest else data[:largest].decode("utf-8", "ignore")


def parse_page(html: str | None, base: str | None, bare: bool = True) -> dict:
    """bare: a reference without its semicolon (``&amp`` at the end of a text that was cut) is one, as in HTML; else it is text."""
    page = _Page(base or "")
    page.feed(capped(html) if bare else _BARE.sub("&amp;", capped(html)))
    page.close()
    return {
        "title": collapsed("".join(page.title)),
        "text": collapsed("".join(page.text)),
        "description": page.description or "",
        "canonical_url": page.canonical or "",
        "language": page.language or "",
        "links": [{"ord": k, "href": h, "anchor": collapsed("".join(t))} for k, (h, t) in enumerate(page.links)],
    }


def parsed_pages(batches: Iterator[tuple[pa.Array, pa.Array]], bare: bool = True) -> Iterator[pa.Array]:
    """Batches of (pages, base URLs) as rows of PARSED_PAGE. However many rows a batch has, AT_ONCE pages are parsed and handed on at a time."""
    kind = to_arrow_type(PARSED_PAGE)
    for pages, bases in batches:
        for at in range(0, len(pages), AT_ONCE):
            some = zip(pages.slice(at, AT_ONCE).to_pylist(), bases.slice(at, AT_ONCE).to_pylist())
            yield pa.array([parse_page(h, b, bare) for h, b in some], kind)


def parse_html(html: Column | str, base_url: Column | str, bare: bool = True) -> Column:
    """struct<title, text, description, canonical_url, language, links array<struct<ord, href, anchor>>>; ``bare`` as in parse_page()."""

    @F.arrow_udf(PARSED_PAGE)
    def parsed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return parsed_pages(batches, bare)

    return parsed(*(F.col(x) if isinstance(x, str) else x for x in (html, base_url)))
