"""Plain readers of office files and PDF as Markdown-like text, by the standard library alone.

They take what such files say in so many words: paragraphs, headings, tables, slides and cells; of PDF the text operators
of streams in simple encodings. Richer adapters go into files.ADAPTERS.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def table_markdown(rows: list[list[str]]) -> str:
    """Header and rows as a Markdown table, padded or cut to the header's width, bars escaped."""
    if not rows:
        return ""
    width = len(rows[0])
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * width][:width]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def numbered(names: list[str], pattern: str) -> list[str]:
    """Members whose name fits, in the order of their number."""
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx_text(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    said = lambda e: "".join((t.text or "") if t.tag == f"{W}t" else "\n" if t.tag == f"{W}br" else "\t" if t.tag == f"{W}tab" else "" for t in e.iter())
    parts = []
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            style = e.find(f"{W}pPr/{W}pStyle")
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style.get(f"{W}val", "")) if style is not None else None
            text = said(e).strip()
            if text:
                parts.append("#" * int(level[1]) + " " + text if level else text)
        elif e.tag == f"{W}tbl":
            parts.append(table_markdown([[said(c).strip() for c in r.iter(f"{W}tc")] for r in e.iter(f"{W}tr")]))
    return "\n\n".join(parts)


def pptx_text(raw: bytes) -> str:
    parts = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for k, name in enumerate(numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml"), 1):
            lines = ["".join(t.text or "" for t in p.iter(f"{A}t")) for p in ElementTree.fromstring(z.read(name)).iter(f"{A}p")]
            parts.append("\n".join([f"## Slide {k}", *(x for x in lines if x.strip())]))
    return "\n\n".join(parts)


def xlsx_text(raw: bytes, most_rows: int = 500) -> str:
    """Sheets in the workbook's order, most_rows rows of each, as the reader's feature."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in e.iter(f"{S}t")) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        parts = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
            target = targets[sheet.get(f"{REL}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{S}row"):
                if len(rows) == most_rows:
                    break
                cells: dict[int, str] = {}
                for k, c in enumerate(row.iter(f"{S}c")):
                    value = c.find(f"{S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{S}t")) if value is None else value.text or ""
                    cells[column_of(c.get("r"), k)] = shared[int(text)] if c.get("t") == "s" and text else text
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            parts.append(f"## {sheet.get('name')}\n" + table_markdown(rows))
    return "\n\n".join(parts)


def column_of(place: str | None, default: int) -> int:
    letters = re.match("[A-Z]+", place or "")
    if not letters:
        return default
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|(?<![A-Za-z])(?:Tj|TJ|Td|TD|T\*|ET|'|\")(?![A-Za-z])", re.S)
PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else PDF_ESCAPES.get(m[1], b"" if m[1].strip() == b"" else m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def pdf_streams(raw: bytes) -> Iterator[bytes]:
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        if b"/Filter" not in m[1]:
            yield m[2]
        elif b"/FlateDecode" in m[1]:
            try:
                yield zlib.decompressobj().decompress(m[2])
            except zlib.error:
                continue


def pdf_text(raw: bytes) -> str:
    """Text that the content streams show, a line for each move of the pen. ValueError if there is none (scans, other encodings)."""
    lines: list[str] = []
    for stream in pdf_streams(raw):
        held: list[str] = []
        line = ""
        for m in PDF_TOKEN.finditer(stream):
            token = m[0]
            if token[:1] in b"(<":
                held.append(pdf_string(token))
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"') and line:
                    lines.append(line)
                    line = ""
                line += "".join(held)
                held = []
            elif token in (b"Td", b"TD", b"T*", b"ET"):
                held = []
                if line:
                    lines.append(line)
                line = ""
        if line:
            lines.append(line)
    if not any(x.strip() for x in lines):
        raise ValueError("no text in simple encodings")
    return "\n".join(lines)
