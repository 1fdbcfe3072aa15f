"""Small DOCX, PPTX and XLSX files from lists of texts: what an export of a table hands to people, and what the extractors read back.

The bytes depend on the texts only, so a recomputed task gives the same file and a file's id is stable.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

# The public namespaces of Office Open XML.
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DRAWING = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
SLIDE = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" {DRAWING}'
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


#: Parts under so many characters are stored as they are: setting up a compressor takes longer than all else about them.
STORED = 1024


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(zipfile.ZipInfo(name), f'<?xml version="1.0" encoding="UTF-8"?>{xml}', zipfile.ZIP_STORED if len(xml) < STORED else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def relations(links: Iterable[tuple[str, str]]) -> str:
    rows = "".join(f'<Relationship Id="r{i}" Type="{LINKS}/{kind}" Target={quoteattr(target)}/>' for i, (kind, target) in enumerate(links, 1))
    return f"<Relationships {PACKAGE}>{rows}</Relationships>"


def docx(sections: Iterable[tuple[str | None, Iterable[str]]], tables: Iterable[Iterable[Iterable[str]]] = ()) -> bytes:
    """A document of sections (heading or None, paragraphs), then tables of rows of cells."""

    def paragraph(text: str, style: str = "") -> str:
        head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{head}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = "".join((paragraph(h, "Heading1") if h is not None else "") + "".join(paragraph(p) for p in ps) for h, ps in sections)
    for rows in tables:
        cells = ("".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) for r in rows)
        body += f"<w:tbl>{''.join(f'<w:tr>{c}</w:tr>' for c in cells)}</w:tbl>"
    styles = f'<w:styles {WORD}><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return archive({"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def pptx(slides: Iterable[tuple[Iterable[str], str | None]]) -> bytes:
    """Slides of (texts of the shapes, the first one the title; speaker notes or None)."""

    def page(tag: str, shapes: Iterable[tuple[str, str]]) -> str:
        made = "".join(
            f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>' for kind, t in shapes
        )
        return f"<p:{tag} {SLIDE}><p:cSld><p:spTree>{made}</p:spTree></p:cSld></p:{tag}>"

    parts, links = {}, []
    for i, (texts, notes) in enumerate(slides, 1):
        parts[f"ppt/slides/slide{i}.xml"] = page("sld", [("body" if k else "title", t) for k, t in enumerate(texts)])
        links.append(("slide", f"slides/slide{i}.xml"))
        if notes is not None:
            parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = relations([("notesSlide", f"../notesSlides/notesSlide{i}.xml")])
            parts[f"ppt/notesSlides/notesSlide{i}.xml"] = page("notes", [("sldNum", str(i)), ("body", notes)])
    order = "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in range(1, len(links) + 1))
    parts["ppt/presentation.xml"] = f'<p:presentation {SLIDE} xmlns:r="{LINKS}"><p:sldIdLst>{order}</p:sldIdLst></p:presentation>'
    parts["ppt/_rels/presentation.xml.rels"] = relations(links)
    return archive(parts)


def xlsx(title: str, rows: Iterable[Iterable[str | int | None]]) -> bytes:
    """A workbook of one sheet: whole numbers as such, texts shared, nothing for None."""
    shared: dict[str, int] = {}
    lines = []
    for n, cells in enumerate(rows, 1):
        line = ""
        for k, v in enumerate(cells):
            at, k = "", k + 1
            while k:
                k, d = divmod(k - 1, 26)
                at = chr(65 + d) + at
            if isinstance(v, int):
                line += f'<c r="{at}{n}"><v>{v}</v></c>'
            elif v is not None:
                line += f'<c r="{at}{n}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'
        lines.append(f'<row r="{n}">{line}</row>')
    texts = "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in shared)
    return archive({
        "xl/workbook.xml": f'<workbook {SHEET} xmlns:r="{LINKS}"><sheets><sheet name={quoteattr(title)} sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations([("worksheet", "worksheets/sheet1.xml"), ("sharedStrings", "sharedStrings.xml")]),
        "xl/sharedStrings.xml": f"<sst {SHEET}>{texts}</sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {SHEET}><sheetData>{''.join(lines)}</sheetData></worksheet>",
    })
