"""Office files: split runs, cells, formulas, metadata, embedded files, and what is refused."""

import io
import zipfile

import pytest

from quillveil.operators import document
from quillveil.sources import files, office

DOC = '<w:document xmlns:w="x"><w:body>{}</w:body></w:document>'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def part(content, name):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.read(name).decode()


def names(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return z.namelist()


def paragraph(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def test_a_value_over_several_runs_is_masked_in_the_first():
    body = paragraph("טל 052", "-123", "4567 סוף") + "<w:p><w:r><w:delText>123456709</w:delText></w:r></w:p>"
    out, text, key = office.redacted(packed(**{"word/document.xml": DOC.format(body)}), "docx")
    xml = part(out, "word/document.xml")
    assert "<w:t>טל [PHONE_1]</w:t>" in xml and "<w:t></w:t>" in xml and "<w:t> סוף</w:t>" in xml and "<w:delText>[ID_1]</w:delText>" in xml
    assert text == "טל [PHONE_1] סוף\n[ID_1]" and [k[1] for k in key] == ["052-1234567", "123456709"]


def test_nothing_is_found_across_paragraphs_and_parts_come_in_order():
    parts = {"word/footer1.xml": DOC.format(paragraph("f@x.co")), "word/header2.xml": DOC.format(paragraph("h2@x.co")), "word/header1.xml": DOC.format(paragraph("h1@x.co")), "word/document.xml": DOC.format(paragraph("12345") + paragraph("6709 d@x.co")), "word/media/a.bin": "123456709"}
    out, text, key = office.redacted(packed(**parts), "docx")
    assert [k[1] for k in key] == ["d@x.co", "h1@x.co", "h2@x.co", "f@x.co"] and text.startswith("12345\n6709 [EMAIL_1]")
    assert part(out, "word/media/a.bin") == "123456709"


def test_a_value_in_another_form_is_healed():
    out, text, key = office.redacted(packed(**{"word/document.xml": DOC.format(paragraph("דרכון 31847205") + paragraph("שוב 31-847-205"))}), "docx")
    assert "847" not in text and len(key) == 2


def test_cells_strings_and_headers_of_a_sheet():
    sheet = '<worksheet><c r="A1" t="s"><v>0</v></c><c r="A2" s="3"><v>521234567</v></c><c r="A3"><v>487500</v></c><c r="A4" t="inlineStr"><is><t>a@b.co</t></is></c><c r="A5"/><c r="A6"><f>A2+1</f><v>12</v></c><oddHeader>ת"ז 123456709</oddHeader></worksheet>'
    strings = "<sst><si><r><t>052</t></r><r><t>-7654321</t></r></si><si><t>plain &amp; simple</t></si></sst>"
    out, _, key = office.redacted(packed(**{"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": strings}), "xlsx")
    xml = part(out, "xl/worksheets/sheet1.xml")
    assert '<c r="A1" t="s"><v>0</v></c>' in xml and '<c r="A3"><v>487500</v></c>' in xml and "<f>A2+1</f><v>12</v>" in xml
    assert '<c r="A2" s="3" t="inlineStr"><is><t xml:space="preserve">[PHONE_2]</t></is></c>' in xml and "<t>[EMAIL_1]</t>" in xml and 'ת"ז [ID_1]' in xml
    assert part(out, "xl/sharedStrings.xml") == "<sst><si><r><t>[PHONE_1]</t></r><r><t></t></r></si><si><t>plain &amp; simple</t></si></sst>"
    assert {k[1] for k in key} == {"052-7654321", "0521234567", "a@b.co", "123456709"}


@pytest.mark.parametrize("raw, value", [("521234567", "0521234567"), ("123456709", "123456709"), ("31847205", "031847205"), ("71847205", None), ("487500", None), ("0521234567", "0521234567"), ("12345670", None)])
def test_numbers_of_cells(raw, value):
    assert office.number_value(raw) == value


def test_a_formula_with_a_value_is_refused():
    sheet = '<worksheet><c r="A1"><f>B1</f><v>a@b.co</v></c></worksheet>'
    with pytest.raises(office.Refused, match=office.FORMULA):
        office.redacted(packed(**{"xl/worksheets/sheet1.xml": sheet}), "xlsx")


def test_metadata_goes_and_bodies_stay():
    parts = {
        "word/document.xml": DOC.format('<w:ins w:author="Dana" w:initials="D">' + paragraph("a@b.co") + "</w:ins>"),
        "docProps/core.xml": "<p><dc:creator>Dana Levi</dc:creator><dcterms:created>2020</dcterms:created></p>", "docProps/app.xml": "<p><Company>Acme</Company><Application>Word</Application></p>",
        "docProps/custom.xml": "<p><vt:lpwstr>Secret</vt:lpwstr><vt:i4>7</vt:i4></p>", "docProps/thumbnail.jpeg": "image",
        "_rels/.rels": '<R><Relationship Id="1" Target="docProps/thumbnail.jpeg"/><Relationship Id="2" Target="word/document.xml"/></R>',
    }
    out, _, _ = office.redacted(packed(**parts), "docx")
    assert 'w:author=""' in part(out, "word/document.xml") and 'w:initials=""' in part(out, "word/document.xml")
    assert "Dana" not in part(out, "docProps/core.xml") and "2020" in part(out, "docProps/core.xml")
    assert part(out, "docProps/app.xml") == "<p><Company></Company><Application>Word</Application></p>" and "Secret" not in part(out, "docProps/custom.xml")
    assert "docProps/thumbnail.jpeg" not in names(out) and part(out, "_rels/.rels") == '<R><Relationship Id="2" Target="word/document.xml"/></R>'


def test_a_value_left_in_another_part_is_refused():
    parts = {"word/document.xml": DOC.format(paragraph("a@b.co")), "word/settings.xml": "<s>mail a@b.co</s>"}
    with pytest.raises(office.Refused, match="word/settings.xml: a@b.co"):
        office.redacted(packed(**parts), "docx")


@pytest.mark.parametrize("name, content, clean", [
    ("word/embeddings/a.xlsx", packed(**{"xl/sharedStrings.xml": "<si><t>other@x.co</t></si>"}), False), ("word/embeddings/a.xlsx", packed(**{"xl/sharedStrings.xml": "<si><t>1</t></si>"}), True),
    ("word/embeddings/b.bin", "x a@b.co".encode("utf-16-le"), False), ("word/embeddings/b.bin", b"other@x.co", True), ("word/embeddings/a.docx", b"broken a@b.co", False),
])
def test_embedded_files_are_looked_into(name, content, clean):
    raw = packed(**{"word/document.xml": DOC.format(paragraph("a@b.co")), name: content})
    if clean:
        assert name in names(office.redacted(raw, "docx")[0])
    else:
        with pytest.raises(office.Refused, match=name):
            office.redacted(raw, "docx")


def test_what_inflates_too_far_is_refused():
    with pytest.raises(office.Refused, match=office.BOMB):
        office.redacted(packed(**{"word/document.xml": DOC.format(paragraph("a" * 10_000))}), "docx", most=5_000)
    assert office.redacted_file("a.docx", b"no zip")[3] == office.BROKEN and office.redacted_file("a.xls", b"")[3] == office.LEGACY and office.redacted_file("noending", b"")[3] == "UNSUPPORTED"


def test_tokens_split_over_runs_are_restored():
    raw = packed(**{"word/document.xml": DOC.format(paragraph("x [PHO", "NE_1] y") + paragraph("[ID_1] and [‏ID_1 ]"))})
    out = office.restored(raw, {document.plain_token("[PHONE_1]"): "052 & 1", document.plain_token("[ID_1]"): "<7>"})
    assert files.plain_text(out) == "x 052 & 1 y\n<7> and <7>"


def test_a_masked_file_comes_back(spark):
    text = "לקוח dana@example.com\nטל 052-1234567, שוב 052-1234567"
    rows = spark.createDataFrame([("a.docx", bytearray(files.token_docx(text))), (None, None)], "path string, content binary")
    back = office.restore_files(office.redact_files(rows), "redacted", "key").collect()
    assert files.plain_text(bytes(back[0].restored)) == text and "dana" not in files.plain_text(bytes(back[0].redacted))
    assert back[1].redacted is None and back[1].restored is None and back[1].error == office.BROKEN
