import zlib

import pytest

from lexforge.sources import pdf

CMAP = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <7B2C> <0002> <4E00> endbfchar 1 beginbfrange <0003> <0004> <7AE0> endbfrange endcmap"


def make(pages, outline=(), packed=False, extra=b""):
    """A file with pages of content streams; entries of an outline have level 1 or 2, title and page from 1."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>"}
    first = 20
    kids = b" ".join(b"%d 0 R" % (first + 2 * k) for k in range(len(pages)))
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 600 800] /Resources << /Font << /F1 4 0 R /F2 5 0 R /F3 6 0 R >> >> >>" % (kids, len(pages))
    objects[4] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    objects[5] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>"
    objects[6] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Song /Encoding /Identity-H /ToUnicode 7 0 R >>"
    streams = {7: CMAP} | {first + 2 * k + 1: body for k, body in enumerate(pages)}
    for k in range(len(pages)):
        objects[first + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (first + 2 * k + 1)
    at = 1000
    if outline:
        objects[3] = b"<< /First %d 0 R >>" % at
    for k, (level, title, page) in enumerate(outline):
        links = b""
        if level == 1 and k + 1 < len(outline) and outline[k + 1][0] == 2:
            links += b" /First %d 0 R" % (at + k + 1)
        after = next((j for j in range(k + 1, len(outline)) if outline[j][0] <= level), None)
        if after is not None and outline[after][0] == level:
            links += b" /Next %d 0 R" % (at + after)
        objects[at + k] = b"<< /Title <FEFF%s> /Dest [%d 0 R /Fit]%s >>" % (title.encode("utf-16-be").hex().encode(), first + 2 * (page - 1), links)
    out = b"%PDF-1.7\n"
    if packed:
        numbers = sorted(objects)
        body, places = b"", []
        for n in numbers:
            places.append(b"%d %d" % (n, len(body)))
            body += objects[n] + b" "
        head = b" ".join(places) + b" "
        data = zlib.compress(head + body)
        out += b"900 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(numbers), len(head), len(data), data)
    else:
        for n, body in objects.items():
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    for n, body in streams.items():
        data = zlib.compress(body)
        out += b"%d 0 obj << /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (n, len(data), data)
    return out + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGE = rb"BT /F2 16 Tf 1 0 0 1 50 700 Tm (Chapter 1 \(A\)) Tj /F1 10 Tf 0 -30 Td [(Wo) -20 (rds)] TJ 0 -12 Td (next \154ine) Tj ET BT /F3 12 Tf 50 500 Td <0001000200030004> Tj ET"


@pytest.mark.parametrize("packed", [False, True])
def test_lines_with_size_weight_and_place(packed):
    lines = pdf.page_lines(make([PAGE, b"BT /F1 9 Tf 1 0 0 2 50 300 Tm (big) Tj ET"], packed=packed))
    assert [(p, k, t, size, bold) for p, k, t, size, bold, _ in lines] == [(0, 0, "Chapter 1 (A)", 16.0, True), (0, 1, "Words", 10.0, False), (0, 2, "next line", 10.0, False), (0, 3, "第一章竡", 12.0, False), (1, 0, "big", 18.0, False)]
    assert lines[0][5] == 84.0 and lines[1][5] > lines[0][5]


def test_outline_with_levels_and_pages():
    entries = [(1, "第一章", 1), (2, "一节", 2), (2, "二节", 2), (1, "B", 3)]
    assert pdf.outline(make([PAGE] * 3, entries)) == entries
    assert pdf.outline(make([PAGE])) == []


def test_files_that_cannot_be_read():
    for data, why in ((b"no file", "no PDF"), (b"%PDF-1.4 trailer << /Root 1 0 R >>", "no pages"), (make([PAGE], extra=b"trailer << /Encrypt 9 0 R >>\n"), "encrypted")):
        with pytest.raises(pdf.BrokenPdf, match=why):
            pdf.page_lines(data)
    assert pdf.page_lines(make([b""])) == [] and pdf.page_count(make([b""])) == 1
