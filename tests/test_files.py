"""Files of every kind through their converters, bad bytes among them."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from marlstone.sources import files

DOCX = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Trees</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Oaks</w:t></w:r><w:r><w:t> grow.</w:t></w:r></w:p></w:body></w:document>"""


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", DOCX)
    return out.getvalue()


KINDS = {
    "note.txt": "﻿A Title\r\n\r\nSome text — here.".encode() + b" \xff\xfe bad",
    "page.html": b"<html><nav><a href='/x'>Home</a></nav><main><h1>Oaks</h1><p>" + b"Oaks are tall trees. " * 8 + b"</p></main><footer>Imprint</footer></html>",
    "table.csv": b"name;sum\noak|red;12\nelm;\xff7;9\n",
    "paper.docx": docx(), "broken.docx": b"no zip",
}


def test_folders_are_read_and_converted(spark, tmp_path):
    for name, data in KINDS.items():
        (tmp_path / name).write_bytes(data)
    texts = {r.path.rsplit("/", 1)[-1]: r.content for r in files.read_texts(spark, str(tmp_path / "note.txt")).collect()}
    assert texts == {"note.txt": "A Title\r\n\r\nSome text — here. �� bad"}
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content").withColumn("title", F.lit("x"))
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.convert(raw).collect()}
    assert set(got) == set(KINDS)
    assert (got["note.txt"].source_type, got["note.txt"].title, got["note.txt"].body) == ("text", "A Title", "Some text — here. �� bad")
    assert got["page.html"].title == "Oaks" and got["page.html"].body.startswith("Oaks are tall") and "Imprint" not in got["page.html"].body
    assert got["table.csv"].body == "| name | sum |  |\n| --- | --- | --- |\n| oak\\|red | 12 |  |\n| elm | �7 | 9 |"
    assert got["paper.docx"].title == "Trees" and "**Oaks** grow." in got["paper.docx"].body and got["broken.docx"].body is None
    assert files.convert(raw.where("1 = 0")).count() == 0


def test_results_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "# A", '{"a": 1}', [("i.png", bytearray(b"x"))]), (2, None, None, None)], "job_id long, markdown string, metadata string, assets array<struct<name:string,content:binary>>")
    files.write_results(rows, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    files.write_result_files(rows, str(tmp_path / "jobs"))
    assert (tmp_path / "jobs/1/result.md").read_text() == "# A" and json.loads((tmp_path / "jobs/2/metadata.json").read_text()) == {}
    with zipfile.ZipFile(tmp_path / "jobs/1/result.zip") as z:
        assert z.namelist() == ["assets/i.png", "metadata.json", "result.md"]
