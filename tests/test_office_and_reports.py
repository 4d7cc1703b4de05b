"""Office files read by Spark's XML functions, and reports that a failed task leaves none of."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, office, reports

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def made(folder):
    para = lambda *runs: "<w:p><w:pPr/>" + "".join(f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"
    body = para("Fish &amp; ", "chips") + para() + "<w:tbl><w:tr><w:tc>" + para("cell") + "</w:tc></w:tr></w:tbl><w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:tab/><w:t>after</w:t><w:br/><w:t>below</w:t></w:r></w:p>"
    slide = lambda *ps: f"{HEAD}<p:sld {A}><p:txBody>" + "".join(f"<a:p><a:r><a:t>{p}</a:t></a:r></a:p>" for p in ps) + "</p:txBody></p:sld>"
    strings = f"{HEAD}<sst {S}><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch &lt;b&gt;</t></r></si><si><t/></si></sst>"
    sheet = f'{HEAD}<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>3.5</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    put = lambda name, data: (folder / name).write_bytes(data)
    put("a.docx", archive(word__document=f"{HEAD}<w:document {W}><w:body>{body}</w:body></w:document>", word__styles="<x/>"))
    put("b.pptx", archive(ppt__slides__slide10=slide("tenth"), ppt__slides__slide2=slide("second", "more"), ppt__slides__slide1=slide("first")))
    put("c.xlsx", archive(xl__sharedStrings=strings, xl__worksheets__sheet1=sheet, xl__worksheets__sheet2=f"{HEAD}<worksheet {S}><sheetData/></worksheet>"))
    put("broken.docx", b"PK no archive")
    put("cut.docx", archive(word__document=f"<w:document {W}><w:body>"))
    put("evil.docx", archive(word__document='<!DOCTYPE x [<!ENTITY e "e">]><x>&e;</x>'))
    put("none.pptx", archive(other="<x/>"))
    put("old.pdf", b"%PDF")
    put("d.txt", b"plain")
    put("empty.md", b"")


def test_office_files(spark, tmp_path):
    made(tmp_path)
    docs = {r.url: r.raw_content for r in files.load(spark, str(tmp_path)).collect()}
    assert docs == {
        "a.docx": "Fish & chips\n\ncell\n\nlink after\n\nbelow",
        "b.pptx": "first\n\nsecond\n\nmore\n\ntenth",
        "c.xlsx": "name rich <b>\n3.5 in",
        "d.txt": "plain",
    }
    listed = spark.read.format("binaryFile").load(str(tmp_path))
    lost = {r.path.rpartition("/")[2]: r.reason for r in files.unread(listed).collect()}
    assert set(lost) == {"broken.docx", "cut.docx", "evil.docx", "none.pptx", "old.pdf"}
    assert lost["broken.docx"].startswith("BadZipFile") and "document type" in lost["evil.docx"] and lost["old.pdf"] == "no reader for pdf"
    assert office.members(listed.limit(0).withColumn("kind", F.lit("docx"))).count() == 0


def test_reports_are_written_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.range(20).select(F.concat(F.lit("r"), F.col("id"), F.lit(".md")).alias("name"), F.concat(F.lit("# Überschrift "), F.col("id")).alias("content")).repartition(4)
    reports.save(rows, path)
    seen = lambda: {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if p.name[0] != "_"}
    before = seen()
    assert before == {f"r{i}.md": f"# Überschrift {i}" for i in range(20)}
    fails = F.when(F.col("id") == 17, F.raise_error(F.lit("lost"))).otherwise(F.lit("new"))
    with pytest.raises(Exception, match="lost"):
        reports.save(spark.range(20).repartition(4).select(F.concat(F.lit("r"), F.col("id"), F.lit(".md")).alias("name"), fails.alias("content")), path)
    assert seen() == before
    with pytest.raises(Exception, match="one name"):
        reports.save(rows.select(F.lit("same").alias("name"), "content"), path)
    assert seen() == before
    reports.save(rows.where("name = 'r3.md'").withColumn("content", F.lit("again")), path)
    assert seen() == before | {"r3.md": "again"}
