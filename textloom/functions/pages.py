"""Web pages: text, links and addresses, by pandas functions over batches of pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "button"}
_BLOCKS = {"p", "div", "section", "article", "li", "ul", "ol", "table", "tr", "td", "br", "blockquote", "pre", "main", "body"}
_NO_PAGE = re.compile(r"\.(png|jpe?g|gif|svg|css|js|ico|zip|gz|pdf|mp[34]|webp|woff2?)$", re.I)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.skip, self.in_title, self.links, self.base, self.heading = [[]], "", 0, False, [], None, ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = dict(attrs)
        if tag in _SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.parts.append(["## "])
        elif tag in _BLOCKS:
            self.parts.append([])
        if tag == "base" and at.get("href") and self.base is None:
            self.base = at["href"]
        if tag == "a" and at.get("href"):
            self.links.append((at["href"], "nofollow" in (at.get("rel") or "")))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in _BLOCKS or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.parts.append([])

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.parts[-1].append(data)


def read_page(source: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(source or "")
    reader.close()
    return reader


def page_text(source: str | None) -> str:
    """Title and paragraphs, one a line; headings are marked; scripts, styles and navigation are left out."""
    page = read_page(source)
    lines = [" ".join("".join(p).split()) for p in page.parts]
    return "\n".join(x for x in [" ".join(page.title.split()), *lines] if x and x != "##")


def html_to_text(source: str) -> Column:
    """``page_text`` over a column, a batch at a time."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(page_text)

    return F.pandas_udf(run, "string")(source)


def normal_url(base: str | None, href: str) -> str | None:
    """An absolute http(s) address without fragment or ``utm_`` parameters; None for others and for files."""
    try:
        parts = urlsplit(urljoin(base or "", html.unescape(href).strip()))
        if parts.scheme not in ("http", "https") or not parts.netloc or _NO_PAGE.search(parts.path):
            return None
        query = urlencode([(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_")])
        return urlunsplit((parts.scheme, parts.netloc.lower(), parts.path or "/", query, ""))
    except ValueError:
        return None


def extract_links(pages: DataFrame) -> DataFrame:
    """``(page_id, link, nofollow)``: each link of a page once, nofollow only if every copy is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, url, source in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                page = read_page(source)
                base = urljoin(url or "", page.base) if page.base else url
                out += [(page_id, link, no) for href, no in page.links if (link := normal_url(base, href))]
            yield pd.DataFrame(out, columns=["page_id", "link", "nofollow"])

    found = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, link string, nofollow boolean")
    return found.groupBy("page_id", "link").agg(F.bool_and("nofollow").alias("nofollow"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one number (Hyyrö, 2004)."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        same = row & places.get(x, 0)
        row = ((row + same) | (row - same)) & full
    return len(b) - row.bit_count()


def chrf(a: str, b: str, most: int = 6, beta: float = 2.0) -> float:
    """Character n-gram F score of ``a`` against ``b`` without white space; lengths beyond either are skipped."""
    from collections import Counter

    a, b = "".join(a.split()), "".join(b.split())
    p = r = n = 0.0
    for k in range(1, most + 1):
        x, y = (Counter(s[i : i + k] for i in range(len(s) - k + 1)) for s in (a, b))
        if not x or not y:
            continue
        both = sum((x & y).values())
        p, r, n = p + both / sum(x.values()), r + both / sum(y.values()), n + 1
    if not n or not p + r:
        return 0.0
    p, r = p / n, r / n
    return (1 + beta**2) * p * r / (beta**2 * p + r)


def chrf_score(a: str, b: str) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([chrf(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "double")(a, b)


def lcs(a: str, b: str) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "long")(a, b)
