"""Uploaded files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill import schemas as S
from parchmill.operators import extract


def read_files(spark: SparkSession, folder: str, ext: str | None = None) -> DataFrame:
    """(path, filename, content, modified) of the files below a folder.

    With ``ext`` only files of that extension are listed and read. Empty files are not listed
    by Spark's source, here and on the stream; rows that come with their content may be empty.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if ext is not None:
        reader = reader.option("pathGlobFilter", "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext))
    return reader.load(folder).select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        "content",
        F.col("modificationTime").alias("modified"),
    )


# Fixed by the source; a stream has to be told.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """As ``read_files``, following new files below a folder."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder).select(
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"),
        "content",
        F.col("modificationTime").alias("modified"),
    )


def read_texts(
    spark: SparkSession,
    folder: str,
    pdf_reader: extract.PartReader | None = None,
    ocr_reader: extract.PartReader | None = None,
) -> DataFrame:
    """Extracted texts of the supported files below a folder.

    One listing and one branch per format, so each file is read once and by its own
    decoder only.
    """
    branches = [
        extract.extract_text(read_files(spark, folder, ext), pdf_reader, ocr_reader) for ext in S.EXTRACTED_EXTENSIONS
    ]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out
