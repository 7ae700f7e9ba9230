"""Records out of raw pages: regular expressions where the page is regular, a streaming HTML parser where tables are not."""

from __future__ import annotations

import base64
import codecs
import html as entities
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import YEARS, digits, is_year, norm, plain_words, without_suffix


def title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def list_links(html: Column) -> Column:
    """Targets of links inside list items, distinct, in page order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<li><a href="([^"]*)"'), F.lit(1)))


def links_matching(html: Column, pattern: str) -> Column:
    """Targets of all links that a pattern matches, distinct, in page order."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1)))
    return F.filter(found, lambda x: x.rlike(pattern))


def sitemap_locations(xml: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(xml, F.lit(r"<loc>\s*(.*?)\s*</loc>"), F.lit(1)))


def sitemap_targets(sitemaps: DataFrame, root: str, pattern: str) -> DataFrame:
    """``url``, ``position``: the pages that the sitemaps named by the index ``root`` list and a pattern matches, each once, in the
    order of the index. sitemaps: url, xml of the fetched files, the index among them."""
    listed = sitemaps.where(F.col("url") == root).select(F.posexplode(sitemap_locations(F.col("xml"))).alias("nth", "url"))
    pages = listed.join(sitemaps, "url").select("nth", F.posexplode(sitemap_locations(F.col("xml"))).alias("at", "url"))
    return pages.where(F.col("url").rlike(pattern)).groupBy("url").agg(F.min(F.struct("nth", "at")).alias("position"))


def url_parts(url: Column) -> list[Column]:
    """Host, first path segment, and the number that ends the path."""
    return [F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, r"^[a-z]+://[^/]+/([^/?#]+)", 1).alias("section"), F.regexp_extract(url, r"/([0-9]+)(?:[?#]|$)", 1).try_cast("long").alias("number")]


# How the priced pages are written. The path ends in /brand/number/model-year/contact.html; a sentence gives the price,
# a question the name after an article, and a badge the category.
PAGE_END, PRICE_FROM, PRICE_IS, PRICE_TO = "contact.html", "Le prix de ", " est de ", "€"
NAME_FROM, NAME_TO, ARTICLES, BADGE = "Quel est le prix de ", " ?", ("la ", "le ", "l'"), '<em class="icon-'


def _between(text: Column, start: str, end: str) -> Column:
    """What stands after the first ``start``, up to the next ``end``; null without both."""
    after = F.when(F.instr(text, start) > 0, F.substr(text, F.instr(text, start) + len(start)))
    return F.when(F.instr(after, end) > 0, F.substring_index(after, end, 1))


def priced_page(url: Column, html: Column) -> list[Column]:
    """``brand``, ``model``, ``year``, ``price_eur``, ``category_fr`` of a page: the name that the page shows, without its year, or else
    that of the path. Null parts where the page does not have them; all are null if the path is another one."""
    path = F.split(url, "/")
    slug, fits = F.get(path, F.size(path) - 2), (F.get(path, F.size(path) - 1) == PAGE_END) & F.get(path, F.size(path) - 3).rlike("^[0-9]+$")
    dash = F.length(slug) - F.length(F.substring_index(slug, "-", -1))  # where the last dash stands
    year = F.when(fits & F.substring_index(slug, "-", -1).rlike("^[0-9]{4}$"), F.substring_index(slug, "-", -1))
    plain = F.regexp_replace(_between(html, PRICE_FROM, PRICE_TO), "<[^>]*>|&nbsp;|\u00a0", " ")
    price = F.when(F.instr(plain, PRICE_IS.rstrip()) > 0, F.substring_index(plain, PRICE_IS.rstrip(), -1))
    shown = unescaped(_between(html, NAME_FROM, NAME_TO))
    for article in ARTICLES:
        shown = F.when(shown.startswith(article), F.substr(shown, F.lit(len(article) + 1))).otherwise(shown)
    name = F.trim(without_suffix(shown, F.concat(F.lit(" "), year)))
    badge = F.trim(unescaped(_between(F.substr(html, F.instr(html, BADGE)), "></em>", "<")))
    return [
        F.when(year.isNotNull(), F.translate(F.get(path, F.size(path) - 4), "-", " ")).alias("brand"),
        F.when(year.isNotNull(), F.coalesce(F.nullif(name, F.lit("")), F.translate(F.substr(slug, F.lit(1), dash - 1), "-", " "))).alias("model"),
        year.cast("int").alias("year"), F.when(price.rlike(r"^[0-9\s]+$"), digits(price)).alias("price_eur"), F.when(F.instr(html, BADGE) > 0, F.nullif(badge, F.lit(""))).alias("category_fr"),
    ]


@dataclass
class Cell:
    text: str = ""
    bold: str = ""


@dataclass
class Row:
    cells: list[Cell] = field(default_factory=list)
    noise: bool = False  # scripts or advertisements
    links: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(c.text for c in self.cells if c.text)


class _Tables(HTMLParser):
    """Rows of the tables of a class; tables inside such a table count as its rows."""

    _BREAKS = frozenset({"br", "p", "div", "span"})

    def __init__(self, css_class: str | None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.inside, self.script, self.bold = css_class, 0, 0, 0, 0
        self.tables: list[list[Row]] = []

    def _row(self) -> Row | None:
        return self.tables[-1][-1] if self.inside and self.tables[-1] else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        told = dict(attrs)
        if tag == "table":
            self.depth += 1
            if not self.inside and (self.wanted is None or self.wanted in (told.get("class") or "").split()):
                self.inside = self.depth
                self.tables.append([])
        elif tag == "tr" and self.inside:
            self.tables[-1].append(Row())
            self.bold = 0
        elif row := self._row():
            row.noise |= tag in ("script", "ins")
            self.script += tag == "script"
            self.bold += tag == "b"
            if tag in ("td", "th"):
                row.cells.append(Cell())
            elif tag == "a" and told.get("href"):
                row.links.append(told["href"])
            elif tag in self._BREAKS:
                self._add(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            if self.inside == self.depth:
                self.inside = 0
            self.depth = max(0, self.depth - 1)
        self.script = max(0, self.script - (tag == "script"))
        self.bold = max(0, self.bold - (tag == "b"))

    def handle_data(self, data: str) -> None:
        if not self.script:
            self._add(data)

    def _add(self, data: str) -> None:
        row = self._row()
        if row and row.cells:
            row.cells[-1].text += data
            if self.bold:
                row.cells[-1].bold += data


def tables_of(html: str, css_class: str | None = None) -> list[list[Row]]:
    parser = _Tables(css_class)
    parser.feed(html)
    parser.close()
    squeezed = lambda text: " ".join(text.replace("\xa0", " ").split())
    return [[Row([Cell(squeezed(c.text), squeezed(c.bold)) for c in row.cells], row.noise, row.links) for row in rows] for rows in parser.tables]


class _Shown(HTMLParser):
    """The text of a piece of HTML that a reader sees: no comments, and nothing inside an element whose style hides it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[bool] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        style = "".join((dict(attrs).get("style") or "").split()).rstrip(";")
        if tag not in ("br", "img", "input", "hr"):
            self.open.append("display:none" in style.split(";"))

    def handle_endtag(self, tag: str) -> None:
        if self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if not any(self.open):
            self.parts.append(data)


def shown_text(html: str) -> str:
    parser = _Shown()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


# How the pages name the list of their encoded cells, and the class of their tables.
CELLS_VARIABLE, TABLE_CLASS = "dataArray", "Grid"


def encoded_cells(html: str) -> dict[str, str]:
    """Class name to text of a page's encoded cells: base64 of a JSON string in rot13. A list that is no JSON holds none."""
    at = html.find(CELLS_VARIABLE)
    start = html.find("[", at) if at >= 0 else -1
    if start < 0:
        return {}
    try:
        entries, _ = json.JSONDecoder().raw_decode(html, start)
    except ValueError:
        return {}
    return {name: shown_text(codecs.decode(json.loads(base64.b64decode(code)), "rot13")) if code else "" for entry in entries for name, code in entry.items()}


def revealed(html: str) -> str:
    """The page with its encoded cells filled in, each into the first span of its class."""
    for name, text in encoded_cells(html).items():
        tag = html.find(f'<span class="{name}"')
        start = html.find(">", tag) + 1 if tag >= 0 else 0
        end = html.find("</span>", start) if start else -1
        if end >= 0:
            html = html[:start] + entities.escape(text) + html[end:]
    return html


def spec_rows(html: str) -> dict[str, str]:
    """Label to value out of two-cell rows with a bold label; the last of equal labels counts."""
    out = {}
    for rows in tables_of(revealed(html), TABLE_CLASS):
        for row in rows:
            if len(row.cells) == 2 and row.cells[0].bold and row.cells[0].text:
                out[row.cells[0].text.rstrip(":")] = row.cells[1].text
    return out


# The word between author and date in the head of a message, and how a line of page links begins.
SAID, PAGE_LINKS = "said", "<< Previous"


def message_head(text: str) -> tuple[str, str] | None:
    """(author, date and time) of a row that heads a message, else None."""
    words = text.split(" ")
    for k in range(1, len(words) - 1):
        if words[k] == SAID:
            try:
                date.fromisoformat(words[k + 1][:10])
            except ValueError:
                continue
            return " ".join(words[:k]), " ".join(words[k + 1 :])
    return None


def comments_of(html: str, look_ahead: int = 3) -> list[tuple[str, str, str]]:
    """(author, posted at, text) of a thread, in one pass over its rows: a head opens a message, which takes the first row of text
    within ``look_ahead`` rows. Advertisements and empty rows only count; page links end the search."""
    out, opened, left = [], None, 0
    for row in (tables_of(html, TABLE_CLASS) or [[]])[0]:
        if head := message_head(row.text):
            opened, left = head, look_ahead
            continue
        if not opened or not left:
            continue
        left -= 1
        if row.noise or not row.text:
            continue
        if not row.text.startswith(PAGE_LINKS):
            out.append((*opened, row.text))
        opened = None
    return out


def listing_rows(html: str, year: int, years: tuple[int, int] = (1894, 2025)) -> list[dict]:
    """Brand, model, year, category, engine and link out of the second table: four cells or more, the name in a link, no header."""
    if not years[0] <= year <= years[1]:
        raise ValueError(f"the year must be within {years[0]} and {years[1]}")
    out = []
    for row in [r for rows in tables_of(html)[1:2] for r in rows[1:]]:
        if len(row.cells) >= 4 and row.links and row.cells[0].text:
            brand, _, model = row.cells[0].text.partition(" ")
            out.append({"brand": brand, "model": model, "year": year, "category": row.cells[1].text, "engine_text": row.cells[3].text, "url": row.links[0]})
    return out


def extract_listings(pages: DataFrame, year: str = "year", html: str = "html") -> DataFrame:
    """``brand``, ``model``, ``year``, ``category``, ``engine_text``, ``url`` of every row of every year's listing. A null page has none, and a
    year outside the catalogue's is an error."""
    names = ("brand", "model", "year", "category", "engine_text", "url")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for y, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if page is not None for row in listing_rows(page, y)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], pa.int32() if n == "year" else pa.string()) for n in names], names=list(names))

    rows = pages.select(F.col(year).cast("int").alias("year"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(parse, "brand string, model string, year int, category string, engine_text string, url string")


def extract_comments(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key``, ``position``, ``author``, ``posted_at``, ``text`` of every comment on every page. A null page has none."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, *c) for k, page in enumerate(batch.column(1).to_pylist()) for n, c in enumerate(comments_of(page or ""))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:])], names=["key", "position", "author", "posted_at", "text"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    out = rows.mapInArrow(parse, f"key {rows.schema['key'].dataType.simpleString()}, position int, author string, posted_at string, text string")
    return out.withColumnRenamed("key", key)


def forum_comments(forums: DataFrame, pages: DataFrame, pattern: str, max_threads: int | None = None) -> DataFrame:
    """``forum``, ``thread``, ``thread_no``, ``position``, ``author``, ``posted_at``, ``text``: the comments of the threads that a forum's page
    links, newest first, of the first ``max_threads`` if given. forums: url, html. pages: url, html of the fetched threads."""
    links = links_matching(F.col("html"), pattern)
    listed = forums.select(F.col("url").alias("forum"), F.posexplode(links if max_threads is None else F.slice(links, 1, max_threads)).alias("thread_no", "thread"))
    threads = pages.join(listed.select(F.col("thread").alias("url")).distinct(), "url", "left_semi")
    return listed.join(extract_comments(threads, "url").withColumnRenamed("url", "thread"), "thread").select("forum", "thread", "thread_no", "position", "author", "posted_at", "text")


def extract_specs(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key``, ``raw_specs`` (label to value) of every page."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            specs = [list(spec_rows(page or "").items()) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(specs, pa.map_(pa.string(), pa.string()))], names=["key", "raw_specs"])

    rows = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(parse, f"key {rows.schema['key'].dataType.simpleString()}, raw_specs map<string,string>").withColumnRenamed("key", key)


# Words that begin a line of a sheet, not a name; the least and greatest length of a name in an answer and of a sheet's label; how far behind
# a name its year may stand; what marks a list item.
SHEET_WORDS = ("displacement", "weight", "power", "torque", "seat", "fuel", "price", "prix", "cylindr", "poids", "puissance", "hauteur", "couple")
NAME_LENGTH, LABEL_LENGTH, YEAR_WITHIN = (3, 80), (3, 25), 20
BULLETS = "-•"


def _word_end(text: str, at: int = 0) -> int:
    """Where the run of letters, digits and underscores that begins at ``at`` ends."""
    while at < len(text) and (text[at].isalnum() or text[at] == "_"):
        at += 1
    return at


def year_of(text: str) -> int | None:
    """The first word of a text that is a plausible year."""
    at = 0
    while at < len(text):
        end = _word_end(text, at)
        word = text[at:end]
        if len(word) == 4 and word.isascii() and word.isdigit() and YEARS[0] <= int(word) <= YEARS[1]:
            return int(word)
        at = max(end, at + 1)
    return None


def _item_at(line: str) -> int:
    """Where the text of a list item begins, 0 if the line is none: it is marked by a bullet, or a number and a dot, and a blank."""
    at = len(line) - len(line.lstrip())
    end = at
    while end < len(line) and line[end].isdecimal():
        end += 1
    marked = line[at : at + 1] in BULLETS and at < len(line) if end == at else line[end : end + 1] == "."
    rest = line[end + 1 :]
    return len(line) - len(rest.lstrip()) if marked and rest[:1].isspace() else 0


def _of_a_sheet(text: str) -> bool:
    """A line that tells a value: one of the sheet's words first, or a short label of plain words and a colon."""
    bare = text.lstrip(BULLETS + " \t").lower()
    label, colon, _ = bare.partition(":")
    plain = all(c.isalnum() or c in "_ " for c in label)
    return bare[: _word_end(bare)] in SHEET_WORDS or bool(colon) and plain and LABEL_LENGTH[0] <= len(label) <= LABEL_LENGTH[1]


def _named_parts(line: str) -> Iterator[tuple[str, int]]:
    """(text, where it ends) of what a line of an answer may name: a list item up to a bracket, and spans between double stars."""
    at = _item_at(line)
    if at:
        text = line[at:].split("(")[0][: NAME_LENGTH[1]]
        at += len(text)
        yield text, at
    while (start := line.find("**", at)) >= 0:
        end = line.find("*", start + 2)
        if end < 0 or line[end : end + 2] != "**":
            at = start + 2
            continue
        yield line[start + 2 : end], end + 2
        at = end + 2


def mentions_of(answer: str) -> list[tuple[str, int | None]]:
    """(name, year if one is told) of the products that an answer names, each name once.

    A name holds a digit or two words, is no line of a sheet (a known word first, or a label and a colon), and its year is its own first one or
    stands right behind it.
    """
    out: dict[str, tuple[str, int | None]] = {}
    lines, begin = answer.split("\n"), 0
    for line in lines:
        for text, end in _named_parts(line):
            name = text.strip().rstrip(":,.")
            if not NAME_LENGTH[0] <= len(text) <= NAME_LENGTH[1] or not name or _of_a_sheet(name) or not (any(c.isdigit() for c in name) or len(name.split()) > 1):
                continue
            year = year_of(name) or year_of(answer[begin + end : begin + end + YEAR_WITHIN])
            out.setdefault("".join(c for c in name.lower() if c.isascii() and c.isalnum()), (name, year))
        begin += len(line) + 1
    return list(out.values())


def extract_mentions(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``position``, ``mention``, ``year`` of what every answer names. A null answer names nothing."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, *m) for k, answer in enumerate(batch.column(1).to_pylist()) for n, m in enumerate(mentions_of(answer or ""))]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())], names=["key", "position", "mention", "year"])

    rows = answers.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(parse, f"key {rows.schema['key'].dataType.simpleString()}, position int, mention string, year int")
    return out.withColumnRenamed("key", key)


def mention_key(mention: Column) -> Column:
    """What a mention is matched by: letters and digits without its years; null if fewer than four are left."""
    bare = norm(F.array_join(F.filter(plain_words(mention), lambda w: ~is_year(w)), ""))
    return F.when(F.length(bare) >= 4, bare)


def unescaped(text: Column) -> Column:
    """HTML entities as characters, a batch of rows at a time."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: entities.unescape(t) if t is not None and "&" in t else t)

    return decode(text)
