"""Schemas of the stages: one row per record, keyed by doc_id throughout."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}


def table(columns: str, *more: T.StructField) -> T.StructType:
    """A schema from "name kind, name kind" and further fields; needs no session, unlike DDL."""
    return T.StructType([*(T.StructField(n, KINDS[k]) for n, k in (c.split() for c in columns.split(","))), *more])


def listed(name: str, of: T.DataType) -> T.StructField:
    return T.StructField(name, T.ArrayType(of))

DOCS = table("doc_id long, filename string, meta_title string, meta_author string, document_page_count int")
PAGES = table(
    "doc_id long, page int, page_width double, page_height double, plain_text string, has_images boolean"
)
SPANS = table(
    "doc_id long, ord int, text string, page int, font_name string, font_size double, bold boolean, italic boolean, "
    "x0 double, y0 double, x1 double, y1 double, block int, line int, source string, confidence double"
)
OCR_WORDS = table(
    "doc_id long, page int, block_num int, par_num int, line_num int, text string, conf double, "
    "x0 double, y0 double, x1 double, y1 double"
)
LINES = table(
    "doc_id long, ord int, text string, page int, font_name string, font_size double, bold boolean, italic boolean, "
    "x0 double, y0 double, x1 double, y1 double, block int, line int, source string, span_count int, "
    "page_width double, page_height double"
)
TITLES = table(
    "doc_id long, title string, source string, confidence string, score double, page int, reason string",
    T.StructField("signals", T.MapType(T.StringType(), T.DoubleType())),
    listed("alternatives", table("text string, score double, page int, font_size double")),
    T.StructField("rejected_metadata", table("title string, reason string")),
)
