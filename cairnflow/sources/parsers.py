"""Document parsers: from file bytes to rows of sections and tables. Standard library only; one row per section."""

from __future__ import annotations

import html
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Section = tuple[str, str, str]  # kind (section or table), text, tag
Parser = Callable[[bytes], list[Section]]
PARSERS: dict[str, Parser] = {}

#: Encodings tried in turn. Fixed values.
CODECS = ("utf-8", "gb18030", "big5", "shift_jis", "euc-kr", "cp1252", "latin-1")
_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div"}
_SKIPPED = {"script", "style", "nav", "footer", "header"}
_OPEN = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}


def parses(*extensions: str) -> Callable[[Parser], Parser]:
    def put(f: Parser) -> Parser:
        for e in extensions:
            PARSERS[e] = f
        return f

    return put


def find_codec(data: bytes) -> str:
    """The first encoding that decodes the head of ``data`` or all of it."""
    for codec in CODECS:
        for part in (data[:1024], data):
            try:
                part.decode(codec)
                return codec
            except UnicodeDecodeError:
                continue
    return "utf-8"


def decoded(data: bytes) -> str:
    return data.decode(find_codec(data), "replace")


def html_table(rows: list[list[str]], caption: str = "", header: bool = True) -> str:
    """Rows as a table; the first is the header."""
    out = ["<table>"]
    if caption:
        out.append(f"<caption>{html.escape(caption)}</caption>")
    for k, row in enumerate(rows):
        tag = "th" if header and not k else "td"
        out.append("<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in row) + "</tr>")
    return "".join([*out, "</table>"])


def paragraphs(text: str) -> list[Section]:
    return [("section", p.strip(), "text") for p in re.split(r"\n\s*\n", text) if p.strip()]


@parses("txt", "csv")
def parse_text(data: bytes) -> list[Section]:
    return paragraphs(decoded(data))


class _Page(HTMLParser):
    """Collects the text of block elements, nested ones again in their parents, and tables as they stand."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.blocks: list[list] = []
        self.tables: list[str] = []
        self.skipped = self.depth = 0
        self.all: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            self.skipped += 1
        elif not self.skipped:
            if tag == "table":
                self.depth += 1
                if self.depth == 1:
                    self.tables.append("")
            if self.depth:
                self.tables[-1] += self.get_starttag_text() or ""
            elif tag in _BLOCKS:
                self.blocks.append([tag, []])
                self.open.append((tag, len(self.blocks) - 1))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif not self.skipped:
            if self.depth:
                self.tables[-1] += f"</{tag}>"
                self.depth -= tag == "table"
            elif tag in _BLOCKS:
                while self.open:
                    if self.open.pop()[0] == tag:
                        break

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self.depth:
            self.tables[-1] += html.escape(data, quote=False)
            return
        self.all.append(data)
        if data.strip():
            for _, k in self.open:
                self.blocks[k][1].append(data.strip())


@parses("html", "htm")
def parse_html(data: bytes) -> list[Section]:
    page = _Page()
    page.feed(decoded(data))
    page.close()
    out: list[Section] = [("table", t, "table") for t in page.tables]
    found = [("section", "".join(parts), "title" if tag in ("h1", "h2", "h3") else "text") for tag, parts in page.blocks]
    found = [x for x in found if len(x[1]) > 1]
    return out + (found or paragraphs("".join(page.all)))


def leaves(value, path: str = "") -> Iterator[str]:
    """``a.b[0].c: value`` for each leaf."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from leaves(v, f"{path}[{k}]")
    else:
        yield f"{path}: {value}" if path else str(value)


@parses("json")
def parse_json(data: bytes) -> list[Section]:
    return [("section", x, "text") for x in leaves(json.loads(decoded(data))) if x.strip()]


@parses("jsonl")
def parse_json_lines(data: bytes) -> list[Section]:
    """Lines that aren't JSON are left out."""
    out: list[Section] = []
    for line in decoded(data).split("\n"):
        if line.strip():
            try:
                out += [("section", x, "text") for x in leaves(json.loads(line)) if x.strip()]
            except ValueError:
                continue
    return out


@parses("md", "markdown")
def parse_markdown(data: bytes) -> list[Section]:
    """A heading with the lines below it; a heading without a body gives none."""
    out: list[Section] = []
    title, body = "", []

    def close(last: bool) -> None:
        text = "\n".join(body).strip()
        body.clear()
        if text:
            out.append(("section", f"{title}\n{text}" if title else text, "text" if title or last else "title"))

    for line in decoded(data).split("\n"):
        if m := re.match(r"(#{1,6})\s+(.+)", line):
            close(False)
            title = m[2].strip()
        else:
            body.append(line)
    close(True)
    return out


def _parts(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ElementTree.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == tag)


def _rows(table: ElementTree.Element) -> list[list[str]]:
    return [[_text(c).strip() for c in r if _local(c) == "tc"] for r in table if _local(r) == "tr"]


@parses("docx")
def parse_docx(data: bytes) -> list[Section]:
    body = ElementTree.fromstring(_parts(data).read("word/document.xml"))[0]
    out: list[Section] = []
    for e in body:
        if _local(e) == "tbl":
            out.append(("table", html_table(_rows(e)), "table"))
        elif _local(e) == "p" and (t := _text(e).strip()):
            style = next((v for x in e.iter() if _local(x) == "pStyle" for v in x.attrib.values()), "").lower()
            out.append(("section", t, "title" if "heading" in style or "title" in style else "text"))
    return out


@parses("pptx")
def parse_pptx(data: bytes) -> list[Section]:
    z = _parts(data)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out: list[Section] = []
    for k, name in enumerate(slides, 1):
        root = ElementTree.fromstring(z.read(name))
        tables = [e for e in root.iter() if _local(e) == "tbl"]
        inside = {id(p) for t in tables for p in t.iter() if _local(p) == "p"}
        lines = [_text(p).strip() for p in root.iter() if _local(p) == "p" and id(p) not in inside]
        if text := "\n".join(x for x in lines if x):
            out.append(("section", text, f"slide_{k}"))
        out += [("table", html_table(_rows(t)), "table") for t in tables]
    return out


@parses("xlsx")
def parse_xlsx(data: bytes) -> list[Section]:
    """Per sheet a table with a caption, and its rows as text."""
    z = _parts(data)
    names = set(z.namelist())
    shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    titles = [e.attrib.get("name", "") for e in book.iter() if _local(e) == "sheet"]
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out: list[Section] = []
    for title, name in zip([*titles, *[""] * len(sheets)], sheets, strict=False):
        rows = []
        for r in ElementTree.fromstring(z.read(name)).iter():
            if _local(r) != "row":
                continue
            row: dict[int, str] = {}
            for k, c in enumerate(r):
                letters = re.match("[A-Z]*", c.attrib.get("r", ""))[0]
                col = 0
                for ch in letters:
                    col = col * 26 + ord(ch) - 64
                value = _text(c, "v") if c.attrib.get("t") != "inlineStr" else _text(c)
                row[col - 1 if col else k] = shared[int(value)] if c.attrib.get("t") == "s" and value else value
            if any(row.values()):
                rows.append([row.get(k, "") for k in range(max(row) + 1)])
        if rows:
            out.append(("table", html_table(rows, title), "table"))
            out.append(("section", "\n".join([f"[{title}]", *(" | ".join(r) for r in rows)]), "table"))
    return out


@parses("epub")
def parse_epub(data: bytes) -> list[Section]:
    """Pages in the order of the book's spine, or by name without one."""
    z = _parts(data)
    names = z.namelist()
    order: list[str] = []
    try:
        opf = next(e.attrib["full-path"] for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(e) == "rootfile")
        root = ElementTree.fromstring(z.read(opf))
        items = {e.attrib["id"]: e.attrib["href"] for e in root.iter() if _local(e) == "item"}
        order = [posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[e.attrib["idref"]])) for e in root.iter() if _local(e) == "itemref" and e.attrib["idref"] in items]
    except (KeyError, StopIteration, ElementTree.ParseError):
        order = []
    pages = [n for n in order if n in names] or sorted(n for n in names if n.endswith((".xhtml", ".html", ".htm")))
    return [s for n in pages for s in parse_html(z.read(n))]


def extension(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2].lower()


def parse(path: str, data: bytes) -> list[Section]:
    """Sections by the file's extension; unknown ones as text, files that can't be read give none."""
    try:
        return PARSERS.get(extension(path), parse_text)(data)
    except Exception:  # noqa: BLE001  whatever a damaged file brings about, it must not fail the job
        return []


#: Files that are Python objects at a time, and rows of their sections sent on at once.
FILES_AT_ONCE, ROWS_AT_ONCE = 50, 2000


def parsed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sections of the files (path, content) of the batches, few files at a time."""
    names = ["path", "pos", "kind", "text", "tag"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    made: list[tuple] = []

    def sent() -> pa.RecordBatch:
        cols = zip(*made, strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        made.clear()
        return out

    for b in batches:
        for start in range(0, b.num_rows, FILES_AT_ONCE):
            part = b.slice(start, FILES_AT_ONCE)
            for p, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                made += [(p, k, *s) for k, s in enumerate(parse(p, bytes(c or b"")))]
                if len(made) >= ROWS_AT_ONCE:
                    yield sent()
        if made:
            yield sent()


def parsed(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, pos, kind, text, tag) of a table of files."""
    src = files.select(F.col(path_col).cast("string"), F.col(content_col).cast("binary"))
    return src.mapInArrow(parsed_batches, "path string, pos int, kind string, text string, tag string")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files below a folder that a parser knows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    known = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(sorted(PARSERS))
    return files.where(known).select("path", "content")
