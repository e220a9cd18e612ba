"""Text of filings from their files: a cascade of extractors with the status of the text it ends in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t

#: From a file's bytes to the texts of its pages; an error or nothing at all sends the file to the next extractor.
Extractor = Callable[[bytes], list[str]]
OCR_PAGES = 20


def read_plain(content: bytes) -> list[str]:
    """Pages of a text file, at form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def extract_texts(files: DataFrame, extractors: list[Extractor], ocr: Extractor | None = None, least: int = 100) -> DataFrame:
    """(source, text, total_pages, text_status) of files (source, content), one row for each.

    The first extractor whose text has at least `least` characters wins, else the longest text. A text judged corrupted goes to
    `ocr`, of which the first OCR_PAGES pages are used. Status: valid; corrupted_ocr_success or corrupted_ocr_failed;
    ocr_needed, where nothing was found and there is no ocr; empty, where the file has no content. A corrupted text is kept.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pages(extractor: Extractor, content: bytes) -> list[str]:
            try:
                return extractor(content)
            except Exception:  # noqa: BLE001  a damaged file must not end the job
                return []

        for batch in batches:
            texts, counts, again = [], [], []
            for content in batch.column("content").to_pylist():
                best: list[str] = []
                for extractor in extractors if content else []:
                    found = pages(extractor, content)
                    if sum(map(len, found)) > sum(map(len, best)):
                        best = found
                    if len("\n".join(found)) >= least:
                        break
                texts.append("\n".join(best))
                counts.append(len(best))
                again.append("\n".join(pages(ocr, content)[:OCR_PAGES]) if ocr and content else None)
            yield pa.RecordBatch.from_arrays([batch.column("source"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(again, pa.string()), pa.array([bool(c) for c in batch.column("content").to_pylist()])], names=["source", "t", "total_pages", "o", "filled"])

    raw = files.select("source", "content").mapInArrow(read, "source string, t string, total_pages int, o string, filled boolean")
    bad, usable = t.corruption(F.col("t")) != "valid", t.corruption(F.col("o")) == "valid"
    status = F.when(~F.col("filled"), "empty").when(~bad, "valid").when(F.col("o").isNotNull() & usable, "corrupted_ocr_success").when(F.length("t") < least, "ocr_needed").otherwise("corrupted_ocr_failed")
    rows = raw.withColumn("text_status", status)
    return rows.select("source", F.when(F.col("text_status") == "corrupted_ocr_success", F.col("o")).otherwise(F.col("t")).alias("text"), "total_pages", "text_status")


def read_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(source, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), "content")


def error_rows(sources: DataFrame, message: str) -> DataFrame:
    """Rows of processed documents for files that could not be processed: status error, nothing found."""
    return sources.select("source", F.lit("").alias("text"), F.lit(0).alias("total_pages"), F.lit("error").alias("text_status"), F.lit(message).alias("error"))
