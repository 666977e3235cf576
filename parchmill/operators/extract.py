"""Text of uploaded files: dispatch by extension, decoders, page assembly, guards."""

from __future__ import annotations

import io
import logging
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill import schemas as S
from parchmill.functions import text as tx
from parchmill.functions.decoding import decode_text
from parchmill.session import cut_lineage

log = logging.getLogger(__name__)

# File bytes to its text parts: paragraphs of a document, pages of a PDF.
PartReader = Callable[[bytes], Sequence[str]]

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx_paragraphs(content: bytes) -> list[str]:
    """Texts of the body paragraphs (not of tables, headers or notes)."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    body = root.find(f"{_W}body")
    return [] if body is None else [_paragraph_text(p) for p in body.findall(f"{_W}p")]


def _paragraph_text(paragraph: ElementTree.Element) -> str:
    pieces = []
    for child in paragraph:
        runs = [child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else []
        for item in (item for run in runs for item in run):
            if item.tag == f"{_W}t":
                pieces.append(item.text or "")
            elif item.tag == f"{_W}tab":
                pieces.append("\t")
            elif item.tag == f"{_W}cr" or (item.tag == f"{_W}br" and item.get(f"{_W}type") in (None, "textWrapping")):
                pieces.append("\n")
            elif item.tag == f"{_W}noBreakHyphen":
                pieces.append("-")
    return "".join(pieces)


def with_format(files: DataFrame, filename_col: str = "filename") -> DataFrame:
    """Add ext, accepted (what a client lets the user pick) and supported (what can be read)."""
    return files.withColumn("ext", tx.extension(F.col(filename_col))).withColumns(
        {
            "accepted": F.col("ext").isin(*S.ACCEPTED_EXTENSIONS),
            "supported": F.col("ext").isin(*S.EXTRACTED_EXTENSIONS),
        }
    )


def read_parts(df: DataFrame, readers: dict[str, tuple[PartReader, PartReader | None]]) -> DataFrame:
    """Replace ``content`` by ``parts`` array<string> and ``read_error``.

    ``readers`` maps an extension to its reader and, if there is one, the reader (OCR)
    to use when all parts are blank. A file that cannot be read costs its own row only.
    """
    kept = [f for f in df.schema.fields if f.name != "content"]
    schema = T.StructType(
        [*kept, T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("read_error", T.StringType())]
    )

    def read(ext: str, content: bytes) -> tuple[list[str], str | None]:
        reader, fallback = readers[ext]
        try:
            parts = list(reader(content))
            if fallback is not None and not "".join(parts).strip():
                parts = list(fallback(content))
            return parts, None
        except Exception as error:
            log.exception("file could not be read")
            return [], f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                read(ext.as_py(), content.as_py()) for ext, content in zip(batch.column("ext"), batch.column("content"))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in kept],
                    pa.array([parts for parts, _ in done], pa.list_(pa.string())),
                    pa.array([error for _, error in done], pa.string()),
                ],
                names=schema.names,
            )

    return df.mapInArrow(run, schema)


def extract_text(
    files: DataFrame,
    pdf_reader: PartReader | None = None,
    ocr_reader: PartReader | None = None,
    docx_reader: PartReader = read_docx_paragraphs,
) -> DataFrame:
    """(filename, content, ...) -> the same without content, with ext, text, read_error
    and ``error``, which is set where nothing could be read.

    Two branches, put together by union: plain texts and unreadable files stay native,
    and only documents go through Python.
    """
    readers = {".docx": (docx_reader, None)}
    if pdf_reader is not None:
        readers[".pdf"] = (pdf_reader, ocr_reader)
    typed = with_format(files)
    by_python = F.col("ext").isin(*readers)

    is_plain = F.col("ext") == ".txt"
    native = tx.computed(
        typed.filter(~by_python),
        {
            "text": F.when(is_plain, decode_text(F.col("content"))).otherwise(F.lit("")),
            "read_error": F.when(~is_plain, F.lit("unsupported format")),
        },
    )
    joined = F.when(F.col("ext") == ".docx", F.array_join("parts", "\n")).otherwise(F.array_join("parts", ""))
    documents = read_parts(typed.filter(by_python), readers).withColumn("text", joined).drop("parts")
    texts = native.drop("content").unionByName(documents)
    # Whitespace counts as text here.
    unread = F.coalesce(F.col("text"), F.lit("")) == ""
    return texts.withColumn("error", F.when(unread, F.lit(S.EXTRACT_FAILED)))


def accepted_requests(extracted: DataFrame) -> DataFrame:
    """Files with text, on their way to a frame and a state row."""
    return extracted.filter(F.col("error").isNull())


def rejected_requests(extracted: DataFrame) -> DataFrame:
    """Files without text: an error, and neither a frame nor a state row."""
    return extracted.filter(F.col("error").isNotNull())


def assemble_pages(pages: DataFrame, key: str = "path", separator: str = "") -> DataFrame:
    """Page rows (key, page_no, text) -> (key, text) in page order.

    A group is one file, and its text has to fit in a row anyway.
    """
    return pages.groupBy(key).agg(_in_page_order(F.struct("page_no", "text"), separator).alias("text"))


def with_ocr_fallback(
    pages: DataFrame, ocr_pages: DataFrame | Callable[[DataFrame], DataFrame], key: str = "path"
) -> DataFrame:
    """Assembled texts (key, text, by_ocr); where the pages give only blanks, the OCR pages are taken.

    ``ocr_pages``: page rows, or a function that makes them for the files (key) it is given, so that
    nothing else is recognized. The pages are put together once and written; only blank files, which have
    next to no text, are joined with what was recognized. A blank file nothing was recognized in gets the empty text.
    """
    texts = pages.groupBy(key).agg(
        _in_page_order(F.struct("page_no", "text")).alias("text"), F.bool_and(tx.is_blank(F.col("text"))).alias("blank")
    )
    texts = cut_lineage(texts)
    blank = texts.filter("blank").select(key)
    wanted = ocr_pages(blank) if callable(ocr_pages) else ocr_pages.join(blank, key, "left_semi")
    recognized = blank.join(assemble_pages(wanted, key), key, "left")
    printed = texts.filter(~F.col("blank")).select(key, "text", F.lit(False).alias("by_ocr"))
    return printed.unionByName(recognized.select(key, F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("by_ocr")))


def _in_page_order(page: Column, separator: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["text"]), separator)
