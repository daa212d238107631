"""PDF files and recognised text come through plug-ins; results go out as JSON or Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliant.schemas import LINES, listed, table

#: What a reader yields for each page of a file.
_SPAN = table("text string, font string, size double, flags int", listed("bbox", T.DoubleType()))
READ_PAGE = table(
    "page int, page_width double, page_height double, plain_text string, has_images boolean",
    listed("blocks", table("type int", listed("lines", T.ArrayType(_SPAN)))),
)
PageReader = Callable[[bytes, int | None], Iterator[dict]]


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, filename, content, length): doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "content", "length")


def read_pages(files: DataFrame, reader: PageReader, max_pages: int | None = None) -> DataFrame:
    """Pages of files by a plug-in `reader(content, max_pages)`; a file it cannot read gives one row with `error`."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *READ_PAGE.fields, T.StructField("error", T.StringType())])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [{"doc_id": doc, "error": None, **p} for p in reader(content, max_pages)]
                except Exception as e:  # noqa: BLE001  a broken file is data, not a failed job
                    rows = [{"doc_id": doc, "error": f"Could not read PDF: {e}"}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(schema.names, types, strict=True)], names=schema.names)

    return files.select("doc_id", "content").mapInArrow(run, schema)


def title_payload(results: DataFrame, ocr_available: bool = False) -> DataFrame:
    """(doc_id, ok, title, title_source, filename, method, message) of (doc_id, title, source, filename, pdf_type)."""
    title = F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit(""))
    return results.select(
        "doc_id", title.isNotNull().alias("ok"), title.alias("title"), F.col("source").alias("title_source"), "filename",
        F.coalesce(F.nullif("source", F.lit("")), F.nullif("pdf_type", F.lit(""))).alias("method"),
        F.when(title.isNull() & (F.col("pdf_type") == "scanned") & F.lit(not ocr_available), "No OCR").alias("message"),
    )


def write_json(results: DataFrame, path: str) -> None:
    results.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def preview(texts: DataFrame, chars: int = 800) -> DataFrame:
    return texts.select("doc_id", F.substring("text", 1, chars).alias("preview"))


def top_signals(titles: DataFrame) -> DataFrame:
    """(doc_id, signals): those not zero, largest first by size, to one decimal."""
    entries = F.filter(F.map_entries("signals"), lambda e: e["value"] != 0)
    by_size = F.array_sort(F.transform(entries, lambda e: F.struct((-F.abs(e["value"])).alias("k"), e["key"].alias("name"), F.round(e["value"], 1).alias("value"))))
    return titles.select("doc_id", F.transform(by_size, lambda e: F.struct(e["name"], e["value"])).alias("signals"))


def first_lines(lines: DataFrame, rows: int = 400) -> DataFrame:
    """The first rows of each document, as a report shows them."""
    return lines.where(F.col("ord") < rows).select(*LINES.names)
