"""Pages to text, links, meta data and tables: standard-library parsing in vectorised Python functions."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DROPPED = frozenset("script style noscript nav header footer form aside template svg".split())
_BLOCK = frozenset("p div br li ul ol tr td th table section article main h1 h2 h3 h4 h5 h6 blockquote pre hr dt dd".split())
_VOID = frozenset("br hr img input meta link base col source embed wbr".split())


#: What holds an article's text, the surest first: (attribute or tag, value); and classes of what is no part of it.
ARTICLE_NODES = [("itemprop", "articleBody"), ("tag", "article"), ("class", "entry-content"), ("class", "post-content"), ("class", "article-content"), ("class", "article-body"), ("class", "post__content"), ("tag", "main")]
ARTICLE_NOISE = re.compile(r"share|social|related|coment|comment|advert|banner|cookie|newsletter|menu|breadcrumb|sidebar", re.I)
#: Lines of pages that say nothing.
NOISE = frozenset({"[Input]", "[Button: Pesquisar]", "expand_more", "collapse"})
CONTENT_ID = re.compile(r"conteudo|content|corpo", re.I)
#: Least characters of an article's node, most of a line.
LEAST_ARTICLE, LONGEST_LINE = 800, 10_000


class _Reader(HTMLParser):
    """Collects visible text, links, meta tags, titles, JSON-LD, table rows and the regions of elements that may hold the main text in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.meta: dict[str, str] = {}
        self.title, self.h1, self.ld = "", "", []
        self.rows: list[list[str]] = []
        self._hidden = self._struck = 0
        self._link: list | None = None
        self._into: str | None = None
        self._cell: list[str] | None = None
        self._open: list[tuple[str, bool, bool, list[int]]] = []
        #: Places in text that belong to no article; regions by what marks them: first and last place in text.
        self.noise: set[int] = set()
        self.regions: list[tuple[str, str, list[int]]] = []
        self._noisy = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        struck = "line-through" in (a.get("style") or "") or tag in ("s", "strike", "del")
        if tag not in _VOID:
            noisy = bool(ARTICLE_NOISE.search(a.get("class") or ""))
            self._noisy += noisy
            region = [len(self.text), -1]
            self._open.append((tag, struck, noisy, region))
            if tag in ("main", "article", "body"):
                self.regions.append(("tag", tag, region))
            if a.get("itemprop"):
                self.regions.append(("itemprop", a["itemprop"], region))
            self.regions += [("class", c, region) for c in (a.get("class") or "").split() if ("class", c) in ARTICLE_NODES]
            if CONTENT_ID.search(a.get("id") or ""):
                self.regions.append(("id", a["id"], region))
        if tag in _DROPPED:
            self._hidden += 1
        if struck and tag not in _VOID:
            self._struck += 1
        if tag in _BLOCK:
            self.text.append("\n")
        if tag == "a" and a.get("href"):
            self._link = [a["href"], ""]
        if tag == "meta" and (k := a.get("property") or a.get("name") or a.get("itemprop")) and a.get("content"):
            self.meta.setdefault(k.lower(), a["content"].strip())
        if tag == "time" and a.get("datetime"):
            self.meta.setdefault("time", a["datetime"])
        if tag in ("title", "h1") or tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self._into = "ld" if tag == "script" else tag
            if self._into == "ld":
                self.ld.append("")
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th"):
            self._cell = []

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                for t, struck, noisy, region in self._open[i:]:
                    self._hidden -= t in _DROPPED
                    self._struck -= struck
                    self._noisy -= noisy
                    region[1] = len(self.text)
                del self._open[i:]
                break
        if tag in _BLOCK:
            self.text.append("\n")
        if tag == "a" and self._link:
            self.links.append((self._link[0], " ".join(self._link[1].split())))
            self._link = None
        if tag in ("title", "h1", "script"):
            self._into = None
        if tag in ("td", "th") and self._cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self._cell).split()))
            self._cell = None

    def handle_data(self, data: str) -> None:
        if self._into == "ld":
            self.ld[-1] += data
            return
        if self._into == "title":
            self.title += data
        if self._into == "h1":
            self.h1 += data
        if self._link:
            self._link[1] += data
        if self._cell is not None:
            self._cell.append(data)
        if not self._hidden and not self._struck and self._into != "title":
            if self._noisy:
                self.noise.add(len(self.text))
            self.text.append(data)

    def lines(self, region: list[int] | None = None, article: bool = False) -> list[str]:
        """The lines of a region, or of the page, none blank; of an article without what is no part of it."""
        a, b = region or (0, -1)
        b = len(self.text) if b < 0 else b
        parts = (x for i, x in enumerate(self.text[a:b], a) if not (article and i in self.noise))
        return [x for x in (" ".join(x.split()) for x in "".join(parts).split("\n")) if x]


def read(html: str) -> _Reader:
    """Read a page; broken markup is read as far as it goes."""
    r = _Reader()
    r.feed(html)
    r.close()
    return r


def page_text(html: str) -> str:
    """Visible text, a line for each block, none blank."""
    return "\n".join(read(html).lines())


def main_text(html: str, noise: frozenset[str] = NOISE) -> str:
    """Text of the page's main element, else of one whose id names content, else of the body; without noise lines and lines over LONGEST_LINE, which are no text by definition."""
    r = read(html)
    find = lambda kind, value=None: next((g for k, v, g in r.regions if k == kind and value in (None, v)), None)
    root = find("tag", "main") or find("id") or find("tag", "body")
    return "\n".join(x for x in r.lines(root) if x not in noise and len(x) <= LONGEST_LINE)


def article_text(r: _Reader) -> str:
    """Text of the surest node of an article that has LEAST_ARTICLE characters, else of the body."""
    for kind, value in ARTICLE_NODES:
        region = next((g for k, v, g in r.regions if k == kind and v == value), None)
        if region and len(text := "\n".join(r.lines(region, True))) >= LEAST_ARTICLE:
            return text
    return "\n".join(r.lines(next((g for k, v, g in r.regions if (k, v) == ("tag", "body")), None), True))


def json_ld(html: str) -> list[dict]:
    """All objects of the page's JSON-LD, nested ones too; what can't be read is left out."""
    out: list[dict] = []
    for raw in read(html).ld:
        try:
            stack = [json.loads(raw)]
        except ValueError:
            continue
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                out.append(x)
                stack += list(x.values())[::-1]
            elif isinstance(x, list):
                stack += x[::-1]
    return out


def article(html: str) -> dict[str, str | None]:
    """title, date, author, section, body of an article: JSON-LD first, then meta tags, then elements."""
    r = read(html)
    ld = next((x for x in json_ld(html) if str(x.get("@type", "")).lower() in ("article", "newsarticle", "blogposting", "scholarlyarticle")), {})
    author = ld.get("author")
    author = author[0] if isinstance(author, list) and author else author
    name = author.get("name") if isinstance(author, dict) else author
    first = lambda *v: next((str(x).strip() for x in v if x and str(x).strip()), None)
    m = r.meta.get
    body = article_text(r)
    return {
        "title": first(ld.get("headline"), m("og:title"), m("twitter:title"), r.h1, r.title),
        "date": first(ld.get("datePublished"), m("article:published_time"), m("datepublished"), m("date"), m("time")),
        "author": first(name, m("author"), m("article:author")),
        "section": first(ld.get("articleSection"), m("article:section")),
        "body": body if len(body) >= LEAST_ARTICLE else first(ld.get("articleBody"), body),
    }


@F.pandas_udf(T.StringType())
def text_of(v: pd.Series) -> pd.Series:
    """Visible text of pages; null for null."""
    return pd.Series([None if x is None else page_text(x) for x in v], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("label", T.StringType())])))
def _links(v: pd.Series) -> pd.Series:
    return pd.Series([[] if x is None else [{"href": h, "label": t} for h, t in read(x).links] for x in v])


@F.pandas_udf(T.StringType())
def _absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urldefrag(urljoin(b or "", h or ""))[0] or None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "date", "author", "section", "body")]))
def article_of(v: pd.Series) -> pd.DataFrame:
    """Article fields of pages."""
    return pd.DataFrame([dict.fromkeys(("title", "date", "author", "section", "body")) if x is None else article(x) for x in v], columns=["title", "date", "author", "section", "body"])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def rows_of(v: pd.Series) -> pd.Series:
    """Cells of all table rows of pages, rows without cells left out."""
    return pd.Series([[] if x is None else [r for r in read(x).rows if r] for x in v])


def main_text_of(html: Column, noise: list[str] = tuple(NOISE)) -> Column:
    """Main text of pages, without lines that are noise; null for null."""
    held = frozenset(noise)

    @F.pandas_udf(T.StringType())
    def text(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else main_text(x, held) for x in v], dtype=object)

    return text(html)


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, url, link, label, place: every link made absolute, without fragment, each target once a page."""
    out = pages.select(key, F.col(url).alias("url"), F.posexplode(_links(html))).select(key, "url", "pos", F.col("col.href").alias("href"), F.col("col.label").alias("label"))
    full = out.withColumn("link", _absolute("url", "href")).where(F.col("link").rlike("^https?://"))
    w = Window.partitionBy(key, "link").orderBy("pos")
    return full.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).select(key, "url", "link", "label", F.col("pos").alias("place"))


def discover(found: DataFrame, key: str, include: list[str], exclude: list[str], most: int, cross_host: bool = False) -> DataFrame:
    """Links to follow: of the same host unless allowed, excluded by no pattern, included by one, at most ``most`` a page as asked."""
    hay = F.concat_ws(" ", "link", "label")
    ok = F.lit(True) if cross_host else (F.regexp_extract("link", r"^https?://([^/]+)", 1) == F.regexp_extract("url", r"^https?://([^/]+)", 1))
    for p in exclude:
        ok = ok & ~hay.rlike(p)
    if include:
        ok = ok & F.greatest(F.lit(False), *[hay.rlike(p) for p in include])
    w = Window.partitionBy(key).orderBy("place")
    return found.where(ok).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most)


def link_kind(link: Column, label: Column) -> Column:
    """next (paging), pdf, asset or page."""
    paging = label.rlike(r"(?i)^(próxim[ao]|next|seguinte|»|›|\d{1,3})$") | link.rlike(r"(?i)(/page/\d+|[?&](pagina|page|p)=\d+)")
    return (
        F.when(link.rlike(r"(?i)\.pdf($|\?)") | label.rlike(r"(?i)inteiro teor|\bpdf\b"), "pdf")
        .when(link.rlike(r"(?i)\.(css|js|png|jpe?g|gif|svg|ico|zip|mp[34]|woff2?)($|\?)"), "asset")
        .when(paging, "next")
        .otherwise("page")
    )


def is_shell(html: str) -> bool:
    """A page that is filled by scripts only."""
    return len(page_text(html)) < 300 and bool(re.search(r"<script", html, re.I)) and bool(re.search(r"id=[\"'](?:root|app|__next)[\"']", html, re.I))


def host_of(url: str) -> str:
    """Host without www."""
    return (urlsplit(url).hostname or "").removeprefix("www.")
