from __future__ import annotations

import io
import zipfile

import pytest

from parchmill import schemas as S
from parchmill.operators import extract
from parchmill.sources import files as file_source

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs: str) -> bytes:
    body = "".join(f"<w:p><w:r>{p}</w:r></w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{body}{table}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", xml)
    return out.getvalue()


def pages(content: bytes) -> list[str]:
    text = content.decode()
    if text.startswith("broken"):
        raise ValueError("bad page")
    return text.split("\f")


FILES = [
    ("a.txt", "Привет".encode("cp1251")),
    ("b.TXT", b"  \n"),
    ("c.docx", docx("<w:t>one</w:t><w:tab/><w:t>two</w:t>", "<w:t>three</w:t><w:br/><w:t>four</w:t>", "")),
    ("d.docx", b"no zip"),
    ("e.pdf", b"p1\fp2"),
    ("f.pdf", b" \f\n"),
    ("g.pdf", b"broken"),
    ("h.doc", b"old"),
    ("i", b"none"),
    ("j.txt", b""),
]


@pytest.fixture()
def uploads(spark):
    return spark.createDataFrame(FILES, "filename string, content binary")


def test_dispatch_decoding_and_guards(uploads):
    texts = extract.extract_text(uploads, pages, ocr_reader=lambda content: ["scan ", "text"])
    got = {r.filename: r for r in texts.collect()}
    assert {k: r.text for k, r in got.items()} == {
        "a.txt": "Привет",
        "b.TXT": "  \n",
        "c.docx": "one\ttwo\nthree\nfour\n",
        "d.docx": "",
        "e.pdf": "p1p2",
        "f.pdf": "scan text",
        "g.pdf": "",
        "h.doc": "",
        "i": "",
        "j.txt": "",
    }
    assert got["g.pdf"].read_error == "ValueError: bad page"
    assert got["d.docx"].read_error.startswith("BadZipFile")
    assert {k for k, r in got.items() if r.accepted} == set(got) - {"i"}
    assert {r.filename for r in extract.accepted_requests(texts).collect()} == {"a.txt", "b.TXT", "c.docx", "e.pdf", "f.pdf"}
    rejected = extract.rejected_requests(texts).collect()
    assert {r.filename for r in rejected} == {"d.docx", "g.pdf", "h.doc", "i", "j.txt"}
    assert {r.error for r in rejected} == {S.EXTRACT_FAILED}


def test_without_a_pdf_reader_pdfs_are_unsupported(uploads):
    got = {r.filename: r for r in extract.extract_text(uploads).collect()}
    assert len(got) == len(FILES)
    assert (got["e.pdf"].text, got["e.pdf"].read_error) == ("", "unsupported format")


def test_folder_source_reads_each_format_by_its_branch(spark, tmp_path):
    for name, content in FILES:
        if content:
            (tmp_path / name).write_bytes(content)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "k.Txt").write_bytes(b"deep")
    got = {r.filename: r.text for r in file_source.read_texts(spark, str(tmp_path), pages).collect()}
    assert got == {
        "a.txt": "Привет", "b.TXT": "  \n", "c.docx": "one\ttwo\nthree\nfour\n", "d.docx": "", "e.pdf": "p1p2",
        "f.pdf": " \n", "g.pdf": "", "k.Txt": "deep",
    }
    assert file_source.read_files(spark, str(tmp_path)).count() == 10


def test_ocr_pages_are_taken_for_blank_files_only(spark):
    rows = [("a", 1, "x"), ("a", 0, "y"), ("b", 0, " "), ("b", 1, "\n"), ("c", 0, "")]
    printed = spark.createDataFrame(rows, "path string, page_no int, text string")
    scans = spark.createDataFrame([("a", 0, "no"), ("b", 1, "2"), ("b", 0, "1")], printed.schema)
    got = sorted(tuple(r) for r in extract.with_ocr_fallback(printed, scans).collect())
    assert got == [("a", "yx", False), ("b", "12", True), ("c", "", True)]
