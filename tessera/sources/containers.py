"""Texts of zipped XML documents (docx, xlsx, pptx, odt, ods, odp, epub), told by what is inside: [(page, text)]."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

ZIP_MAGIC = b"PK\x03\x04"
#: A member that unpacks to more isn't read: a few bytes can stand for any number.
MOST_BYTES = 512 << 20
#: Elements, without their namespaces, that end a line of text, and those that stand for white space.
_LINES = {"p", "h", "tr", "title", "li", "div", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "row", "table-row"}
_SPACES = {"tab": "\t", "br": "\n", "cr": "\n", "line-break": "\n", "s": " "}
_SILENT = {"script", "style", "head"}


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


class _Zip:
    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def open(self, name: str):
        if self.zip.getinfo(name).file_size > MOST_BYTES:
            raise ValueError(f"{name} unpacks to over {MOST_BYTES} bytes")
        return self.zip.open(name)

    def numbered(self, pattern: str) -> list[tuple[int, str]]:
        return sorted((int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n)))

    def links(self, name: str) -> dict[str, str]:
        """What a part's relations point to, by their id."""
        folder, base = posixpath.split(name)
        rels = f"{folder}/_rels/{base}.rels"
        if rels not in self.names:
            return {}
        found = ElementTree.parse(self.open(rels)).getroot()
        return {r.get("Id"): r.get("Target").lstrip("/") if r.get("Target").startswith("/") else posixpath.normpath(posixpath.join(folder, r.get("Target"))) for r in found if r.get("TargetMode") != "External"}


def _flow(stream) -> str:
    """The text of a part of the office formats, read element by element: all that its `t` elements hold."""
    parts, properties = [], 0
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        name = _local(e.tag)
        if event == "start":
            properties += name == "pPr"  # a tab in there is a tab stop
            if name in _SPACES and not properties:
                parts.append(_SPACES[name])
            continue
        properties -= name == "pPr"
        if name == "t":
            parts.append(e.text or "")
        elif name in ("p", "tr"):
            parts.append("\n")
            e.clear()
    return re.sub(r"\n{3,}", "\n\n", "".join(parts)).strip()


def _mixed(stream) -> str:
    """The text of a document whose elements hold text and elements side by side (odf, xhtml)."""
    parts: list[str] = []

    def walk(e) -> None:
        name = _local(e.tag)
        if name in _SILENT or not name:
            return
        if name in _SPACES:
            parts.append(_SPACES[name] * int(next((v for k, v in e.attrib.items() if _local(k) == "c" and v.isdigit()), 1)))
        parts.append(e.text or "")
        for child in e:
            walk(child)
            parts.append(child.tail or "")
        if name in _LINES:
            parts.append("\n")

    body = ElementTree.parse(stream).getroot()
    for e in body.iter():
        if _local(e.tag) == "body":
            body = e
            break
    walk(body)
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(parts)).strip()


def _sheets(z: _Zip) -> Iterator[tuple[int, str]]:
    """A page for each sheet, in the workbook's order: cells by tabs, rows by line feeds."""
    shared = []
    if "xl/sharedStrings.xml" in z.names:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for _, si in ElementTree.iterparse(z.open("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
    links = z.links("xl/workbook.xml")
    sheets = [next(v for k, v in s.attrib.items() if k.endswith("}id")) for _, s in ElementTree.iterparse(z.open("xl/workbook.xml")) if _local(s.tag) == "sheet"]
    for page, rid in enumerate(sheets, 1):
        lines = []
        for _, row in ElementTree.iterparse(z.open(links[rid])):
            if _local(row.tag) != "row":
                continue
            cells = []
            for c in (c for c in row if _local(c.tag) == "c"):
                v = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
            lines.append("\t".join(cells))
            row.clear()
        yield page, "\n".join(lines).strip()


def _slides(z: _Zip) -> Iterator[tuple[int, str]]:
    """A page for each slide, in the presentation's order."""
    links = z.links("ppt/presentation.xml")
    order = [links[next(v for k, v in s.attrib.items() if k.endswith("}id"))] for _, s in ElementTree.iterparse(z.open("ppt/presentation.xml")) if _local(s.tag) == "sldId"]
    for page, name in enumerate(order or [n for _, n in z.numbered(r"ppt/slides/slide(\d+)\.xml")], 1):
        yield page, _flow(z.open(name))


def _book(z: _Zip) -> Iterator[tuple[int, str]]:
    """A page for each document of an epub's spine."""
    container = ElementTree.parse(z.open("META-INF/container.xml")).getroot()
    package = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
    root, folder = ElementTree.parse(z.open(package)).getroot(), posixpath.dirname(package)
    items = {e.get("id"): posixpath.normpath(posixpath.join(folder, unquote(e.get("href")))) for e in root.iter() if _local(e.tag) == "item"}
    for page, ref in enumerate((e.get("idref") for e in root.iter() if _local(e.tag) == "itemref"), 1):
        if items.get(ref) in z.names:
            yield page, _mixed(z.open(items[ref]))


def parse_container(content: bytes) -> list[tuple[int | None, str]]:
    """[(page or None, text)]; raises ValueError where the archive is none of these documents, or broken."""
    try:
        z = _Zip(content)
        if "word/document.xml" in z.names:
            return [(None, _flow(z.open("word/document.xml")))]
        if "xl/workbook.xml" in z.names:
            return list(_sheets(z))
        if "ppt/presentation.xml" in z.names:
            return list(_slides(z))
        if "META-INF/container.xml" in z.names:
            return list(_book(z))
        if "content.xml" in z.names:
            return [(None, _mixed(z.open("content.xml")))]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, RuntimeError) as e:
        raise ValueError(f"broken container: {type(e).__name__}: {e}") from e
    raise ValueError("an archive of no known kind")
