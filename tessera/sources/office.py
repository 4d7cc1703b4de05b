"""Office files as rows: the members of their zip archives, and what Spark's XPath functions read in them.

Files come as Spark's ``binaryFile`` source lists them, from any file system,
several to a task. Python only opens the archives; texts, slides and cells are
column expressions over their XML.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The members that hold text, by kind of file.
MEMBERS = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide(\d+)\.xml", "xlsx": r"xl/(?:sharedStrings|worksheets/sheet(\d+))\.xml"}
#: Parameter: a member of more bytes, unpacked, is not read: what a task holds stays bounded, whatever an archive claims.
MOST_BYTES = 2**29


def members(files: DataFrame) -> DataFrame:
    """(path, kind, number, xml, error) of archives (path, kind, content): a row for each member with text, or one with what is wrong with the file.

    A member that isn't well-formed XML, or brings a document type with it, is an error of its file.
    """

    def unpacked(kind: str, content: bytes) -> list[tuple[int, str]]:
        out = []
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                found = re.fullmatch(MEMBERS[kind], info.filename)
                if not found:
                    continue
                if info.file_size > MOST_BYTES:
                    raise ValueError(f"{info.filename} is too large")
                xml = archive.read(info)
                if b"<!DOCTYPE" in xml:
                    raise ValueError(f"{info.filename} has a document type")
                expat.ParserCreate().Parse(xml, True)
                out.append((int(found[1] or 0) if found.groups() else 0, xml.decode("utf-8")))
        if not out:
            raise ValueError("no member with text")
        return out

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(len(batch)):
                path, kind = batch.column("path")[i].as_py(), batch.column("kind")[i].as_py()
                try:
                    rows = [(n, xml, None) for n, xml in unpacked(kind, batch.column("content")[i].as_py() or b"")]
                except (ValueError, zipfile.BadZipFile, expat.ExpatError, RuntimeError, NotImplementedError, OSError, EOFError) as error:
                    rows = [(None, None, f"{type(error).__name__}: {error}")]
                number, xml, error = zip(*rows, strict=True)
                same = lambda x, k=len(rows): pa.array([x] * k, pa.string())
                yield pa.RecordBatch.from_arrays([same(path), same(kind), pa.array(number, pa.int32()), pa.array(xml, pa.string()), pa.array(error, pa.string())], names=["path", "kind", "number", "xml", "error"])

    rows = files.where(F.col("kind").isin(*MEMBERS)).select("path", "kind", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(read, "path string, kind string, number int, xml string, error string")


def _plain(xml: Column, mark: str, *tags: tuple[str, str]) -> Column:
    """``xml`` without its declaration, with a text element ``mark`` of newlines or tabs where the ``tags`` stand."""
    out = F.regexp_replace(xml, r"^\ufeff?<\?xml[^>]*\?>", "")
    for pattern, text in tags:
        out = F.regexp_replace(out, pattern, f"<{mark}>{text}</{mark}>$0")
    return out


def _texts(xml: Column, name: str) -> Column:
    return F.array_join(F.xpath(xml, F.lit(f"//*[name()='{name}']/text()")), "")


def paragraphs(text: Column) -> Column:
    """Lines without what surrounds them, empty ones left out, with a blank line between."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), F.trim), lambda p: p != ""), "\n\n")


def docx_text(xml: Column) -> Column:
    """The paragraphs of a document, those of tables included, in order."""
    return paragraphs(_texts(_plain(xml, "w:t", (r"</w:p>|<w:br[ />]", "&#10;"), (r"<w:tab ?/>", " ")), "w:t"))


def pptx_text(xml: Column) -> Column:
    """The paragraphs of a slide."""
    return paragraphs(_texts(_plain(xml, "a:t", (r"</a:p>|<a:br[ />]", "&#10;")), "a:t"))


#: A string table's strings end with this, a character for private use.
STOP = "\ue000"


def shared_strings(xml: Column) -> Column:
    return F.split(_texts(_plain(xml, "t", (r"</si>", STOP)), "t"), STOP)


SHEET = "sheetData struct<row: array<struct<c: array<struct<_t: string, v: string, is: struct<t: string>>>>>>"


def sheet_text(xml: Column, strings: Column) -> Column:
    """A sheet's rows as lines, its cells with a blank between; empty cells and rows are left out."""
    sheet = F.from_xml(xml, SHEET, {"ignoreNamespace": "true"})
    cell = lambda c: F.when(c["_t"] == "s", F.get(strings, c["v"].cast("int"))).when(c["_t"] == "inlineStr", c["is"]["t"]).otherwise(c["v"])
    line = lambda row: F.array_join(F.filter(F.transform(row["c"], cell), lambda x: F.trim(x) != ""), " ")
    return F.array_join(F.filter(F.transform(sheet["sheetData"]["row"], line), lambda x: x != ""), "\n")


def texts(found: DataFrame) -> DataFrame:
    """(path, number, text) of :func:`members`: a row for each document and sheet, and one for all slides of a presentation."""
    found = found.where("error is null")
    docs = found.where("kind = 'docx'").select("path", "number", docx_text(F.col("xml")).alias("text"))
    slides = found.where("kind = 'pptx'").select("path", "number", pptx_text(F.col("xml")).alias("text"))
    slides = slides.where("text <> ''").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("s"))  # one presentation's
    slides = slides.select("path", F.lit(0).alias("number"), F.array_join(F.transform("s", lambda s: s["text"]), "\n\n").alias("text"))
    book = found.where("kind = 'xlsx'")
    strings = book.where("number = 0").select("path", shared_strings(F.col("xml")).alias("strings"))
    sheets = book.where("number > 0").join(strings, "path", "left").select("path", "number", sheet_text(F.col("xml"), F.col("strings")).alias("text"))
    return docs.unionByName(slides).unionByName(sheets).where("text <> ''")
