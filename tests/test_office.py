"""Files that the writers make, read back by the extractors."""

from quernstone.sources import extract as X
from quernstone.sources import office


def test_round_trip_and_markup():
    texts = ['a < b & "c"', "ünï 文字", "x" * 100_000]
    found, meta = X.docx_sections(office.docx([(None, texts), (" H & J ", ["p", "", " "]), ("Last", [])], [[["a", "<b>"], ["", "2"], ["", ""]], [["t"]]]))
    assert found == [("\n".join(texts), "body"), ("H & J\np", "H & J"), ("Last", "Last"), ("a | <b>\n2", "table 1"), ("t", "table 2")] and meta == {"tables": "2"}
    found, meta = X.pptx_sections(office.pptx([([f"T{i}", "b<r>"], "note & more" if i % 2 else None) for i in range(1, 13)] + [([], None)]))
    assert [x[1] for x in found] == [f"slide {i}" for i in range(1, 13)] and meta == {"slides": "13"}
    assert found[0][0] == "T1\nb<r>\nSpeaker notes: note & more" and found[11][0] == "T12\nb<r>"
    wide = [f"h{i}" for i in range(60)]
    found, meta = X.xlsx_sections(office.xlsx('Q "1" & 2', [wide, [i if i % 2 else f"<{i}>" for i in range(60)], [None] * 60, [None] * 59 + ["end"]]))
    first = " | ".join(f"h{i}: {i if i % 2 else f'<{i}>'}" for i in range(60))
    assert found == [(f"{first}\nh59: end", 'sheet Q "1" & 2')] and meta == {"sheets": "1"}


def test_nothing_in_them():
    assert X.docx_sections(office.docx([]))[0] == [] and X.pptx_sections(office.pptx([]))[0] == [] and X.xlsx_sections(office.xlsx("S", []))[0] == []


def test_same_texts_same_bytes():
    assert office.docx([("h", ["p"])]) == office.docx([("h", ["p"])]) and office.xlsx("S", [["a", 1]]) == office.xlsx("S", [["a", 1]]) != office.xlsx("S", [["a", 2]])
