"""Documents as rows: HTML and Markdown sections, tables, images, metadata, delimited text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SKIP = frozenset(("script", "style", "noscript", "template"))
#: Elements without content in the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = re.compile(r"h[1-6]$")
#: Classes of parts a publisher's page sets beside its text.
ASIDE = frozenset("figure table sidebar caption footnote references nav header footer ads comments toolbar share".split())

#: Exact classes left out of a publisher's chapter.
CHAPTER_ASIDE = frozenset((
    "app-article-access", "app-explore-related-subjects", "c-article-access-provider", "c-article-recommendations", "c-article-share-box", "c-article-sidebar", "c-article-section__figure",
    "c-article-section__figure-caption", "c-article-section__figure-content", "c-article-section__figure-description", "c-article-section__figure-item", "c-article-table", "c-article-table__figcaption",
))
#: What may hold a saved page's text, by class, id, role and tag; the one with the longest text does, if that has more than 100 characters.
CONTAINERS = {"class": frozenset("article-content widget-items chapter-para section content main-content full-text article-body".split()), "id": frozenset(("content", "main")), "role": frozenset(("main",)), "tag": frozenset(("article", "main"))}
LEAST_TEXT = 100

SECTION = "ord int, kind string, level int, path string, text string"


class _Reader(HTMLParser):
    """One pass over a page; unclosed tags end with their parents."""

    def __init__(self, base: str = "", scope=None, asides=None):
        super().__init__(convert_charrefs=True)
        self.scope, self.asides = scope, asides
        self.open: list[tuple[int, int]] = []  # scopes open now: depth and number
        self.sizes: list[int] = []  # characters of text in each scope
        self.within: list[tuple[int, ...]] = []  # scopes of each row
        self.block_scopes: tuple[int, ...] = ()
        self.base, self.rows, self.heads = base, [], []
        self.stack: list[str] = []
        self.block: str | None = None
        self.buffer: list[str] = []
        self.skip = 0
        self.table: list[list[str]] | None = None
        self.tables: list[tuple[str, list[list[str]]]] = []
        self.images: dict[str, str] = {}
        self.links: list[tuple[str, str]] = []
        self.ids: dict[str, list[str]] = {}
        self.meta: dict[str, list[str]] = {}
        self.title = ""
        self.caption = ""
        self.inside: list[str] = []
        self.text: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if self.block and text:
            self.within.append(self.block_scopes)
            if _HEADING.match(self.block):
                level = int(self.block[1])
                self.heads = [h for h in self.heads if h[0] < level] + [(level, text)]
                self.rows.append(("heading", level, " / ".join(h[1] for h in self.heads), text))
            else:
                self.rows.append((self.block, len(self.heads), " / ".join(h[1] for h in self.heads), f"- {text}" if self.block == "li" else text))
        self.block, self.buffer = None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "img" and a.get("src"):
            self.images.setdefault(urljoin(self.base, a["src"]), a.get("alt") or "")
        if tag == "meta" and a.get("name") and a.get("content"):
            self.meta.setdefault(a["name"].lower(), []).append(a["content"])
        if tag == "a" and (a.get("href") or "").startswith("#"):
            self.links.append((a["href"][1:], ""))
        if tag in _VOID:
            if tag == "br":
                self.buffer.append(" ")
                self.text.append("\n")
            return
        self.stack.append(tag)
        if self.scope is not None and self.scope(tag, a):
            self.open.append((len(self.stack), len(self.sizes)))
            self.sizes.append(0)
        if self.asides is None:
            aside = tag in ("nav", "aside", "footer") or {*(a.get("class") or "").lower().replace("-", " ").split()} & ASIDE
        else:
            aside = {*(a.get("class") or "").split()} & self.asides
        if self.skip or tag in _SKIP or aside:
            self.skip += 1
        if a.get("id"):
            self.inside.append(a["id"])
            self.ids.setdefault(a["id"], [])
        if tag in ("p", "li", "div", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"):
            self.text.append("\n")
        if tag in ("p", "li") or _HEADING.match(tag):
            self._flush()
            self.block, self.block_scopes = tag, tuple(i for _, i in self.open)
        elif tag == "table":
            self._flush()
            self.table, self.caption = [], ""
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table is not None:
            if not self.table:
                self.table.append([])
            self.table[-1].append("")
        elif tag == "caption":
            self.block = None

    def handle_endtag(self, tag):
        if tag in _VOID or tag not in self.stack:
            return
        if tag == self.block:
            self._flush()
        if tag == "table" and self.table is not None:
            self.tables.append((self.caption.strip(), [[" ".join(c.split()) for c in r] for r in self.table if r]))
            self.table = None
        while self.stack:
            top = self.stack.pop()
            self.open = [x for x in self.open if x[0] <= len(self.stack)]
            if self.skip:
                self.skip -= 1
            if top == tag:
                break

    def handle_data(self, data):
        top = self.stack[-1] if self.stack else ""
        if top == "title":
            self.title += data
        if any(t in _SKIP for t in self.stack):
            return
        self.text.append(data)
        for _, i in self.open:
            self.sizes[i] += len(data.strip())
        for i in self.inside[-1:]:
            self.ids[i].append(data)
        if self.table is not None:
            if top == "caption":
                self.caption += data
            elif self.table and self.table[-1]:
                self.table[-1][-1] += data
            return
        if not self.skip and self.block:
            self.buffer.append(data)


def _read(html: str | None, base: str = "", scope=None, asides=None) -> _Reader:
    r = _Reader(base, scope, asides)
    r.feed((html or "").replace("\x00", ""))
    r.close()
    r._flush()
    return r


def _rows(df: DataFrame, id_col: str, html_col: str, make, schema: str, types: list[pa.DataType], names: list[str]) -> DataFrame:
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for r in make(h):
                    ids.append(i)
                    out.append(r)
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, *names])

    return df.select(F.col(id_col), F.col(html_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def _container(tag: str, a: dict) -> bool:
    return bool(tag in CONTAINERS["tag"] or {*(a.get("class") or "").split()} & CONTAINERS["class"] or a.get("id") in CONTAINERS["id"] or a.get("role") in CONTAINERS["role"])


def _page_rows(html: str | None) -> list[tuple]:
    return _read(html).rows


def _chapter_rows(html: str | None) -> list[tuple]:
    """Rows within the article's body, under "Untitled" before its first heading."""
    r = _read(html, scope=lambda tag, a: tag == "div" and a.get("data-article-body") == "true", asides=CHAPTER_ASIDE)
    return [(kind, level, path or "Untitled", text) for (kind, level, path, text), own in zip(r.rows, r.within, strict=True) if own]


def _saved_rows(html: str | None) -> list[tuple]:
    """Rows within the container that holds the most text, of the whole page if none holds enough."""
    r = _read(html, scope=_container)
    best = max(range(len(r.sizes)), key=lambda i: (r.sizes[i], -i), default=None)
    if best is None or r.sizes[best] <= LEAST_TEXT:
        return r.rows
    return [row for row, own in zip(r.rows, r.within, strict=True) if best in own]


#: Readers of a page's sections: of live pages, of publishers' chapters, of saved pages.
VARIANTS = {"page": _page_rows, "chapter": _chapter_rows, "saved": _saved_rows}


def html_sections(df: DataFrame, id_col: str, html_col: str, variant: str = "page") -> DataFrame:
    """(id, ord, kind, level, path, text): headings, paragraphs and list items with the headings above them.

    `page` reads a live page without its asides (S17, with html_tables and
    html_images beside it), `chapter` a publisher's article body (S15), `saved`
    the container with the longest text (S16). Scripts and styles are left out;
    null gives no rows.
    """
    rows = VARIANTS[variant]
    make = lambda h: [(k, *r) for k, r in enumerate(rows(h))]
    return _rows(df, id_col, html_col, make, SECTION, [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()], ["ord", "kind", "level", "path", "text"])


def html_tables(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_ix, row_ix, caption, cells) of every table row."""
    make = lambda h: [(t, r, c, cells) for t, (c, rows) in enumerate(_read(h).tables) for r, cells in enumerate(rows)]
    return _rows(df, id_col, html_col, make, "table_ix int, row_ix int, caption string, cells array<string>", [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())], ["table_ix", "row_ix", "caption", "cells"])


def html_images(df: DataFrame, id_col: str, html_col: str, base: str = "") -> DataFrame:
    """(id, url, alt): images by absolute address, each once a page."""
    return _rows(df, id_col, html_col, lambda h: list(_read(h, base).images.items()), "url string, alt string", [pa.string(), pa.string()], ["url", "alt"])


def html_metadata(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, authors, doi, date) from title and meta tags."""

    def make(h):
        r = _read(h)
        pick = lambda *ks: next((r.meta[k][0] for k in ks if k in r.meta), None)
        return [(" ".join(r.title.split()) or pick("citation_title"), r.meta.get("citation_author", []) or r.meta.get("author", []), pick("citation_doi", "dc.identifier"), pick("citation_publication_date", "citation_date", "dc.date", "date"))]

    return _rows(df, id_col, html_col, make, "title string, authors array<string>, doi string, date string", [pa.string(), pa.list_(pa.string()), pa.string(), pa.string()], ["title", "authors", "doi", "date"])


def html_anchor_sections(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, anchor, text): elements that links of the page point to."""

    def make(h):
        r = _read(h)
        return [(a, " ".join("".join(r.ids[a]).split())) for a in dict.fromkeys(a for a, _ in r.links) if a in r.ids]

    return _rows(df, id_col, html_col, make, "anchor string, text string", [pa.string(), pa.string()], ["anchor", "text"])


def html_text(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, text): a page's lines without markup, blank ones dropped."""
    make = lambda h: [("\n".join(t for x in "".join(_read(h).text).split("\n") if (t := " ".join(x.split()))),)]
    return _rows(df, id_col, html_col, make, "text string", [pa.string()], ["text"])


def markdown_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, level, title, line): lines with the level of headings, JVM side."""
    x = df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("line_no", "line"))
    head = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    return x.select(id_col, "line_no", F.nullif(F.length(head), F.lit(0)).alias("level"), F.when(F.length(head) > 0, F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))).alias("title"), "line")


def markdown_chapters(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chapter_no, level, title, parent_no, text): chapters of Markdown text.

    Text before the first heading is chapter 0 without title. A chapter's
    parent is the nearest earlier one with a smaller level.
    """
    x = markdown_lines(df, id_col, text_col)
    w = Window.partitionBy(id_col).orderBy("line_no")
    x = x.withColumn("chapter_no", F.count("level").over(w))
    heads = x.filter("level is not null").select(id_col, "chapter_no", "level", "title")
    for n in range(1, 7):
        last = F.last(F.when(F.col("level") == n, F.col("chapter_no")), ignorenulls=True).over(Window.partitionBy(id_col).orderBy("chapter_no").rowsBetween(Window.unboundedPreceding, -1))
        heads = heads.withColumn(f"_{n}", last)
    ups = F.array(*[F.when((F.lit(n) < F.col("level")) & F.col(f"_{n}").isNotNull(), F.col(f"_{n}")) for n in range(1, 7)])
    heads = heads.withColumn("parent_no", F.array_max(ups)).drop(*[f"_{n}" for n in range(1, 7)])
    body = x.filter("level is null and trim(line) <> ''").groupBy(id_col, "chapter_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: F.trim(s["line"])), "\n").alias("text"))
    return heads.join(body, [id_col, "chapter_no"], "full_outer").select(id_col, "chapter_no", "level", "title", "parent_no", F.coalesce("text", F.lit("")).alias("text"))


def body_after_rule(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): non-blank lines after the first line that begins with =; other such lines drop."""
    x = df.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    after = F.max(F.col("line").startswith("=").cast("int")).over(Window.partitionBy(id_col).orderBy("line_no"))
    return x.withColumn("_a", after).filter((F.col("_a") == 1) & ~F.col("line").startswith("=") & (F.trim("line") != "")).drop("_a")
