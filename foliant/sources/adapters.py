"""Documents and lines from tables: HTML pages, plain texts, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import rules
from foliant.functions.text import collapse_space
from foliant.schemas import DOCS, LINES

#: Elements whose text is a line; lines of a page, points from line to line, first line's top, left edge.
ELEMENT = r"<(h1|p|b|li|a|div|footer)(?: [^>]*)?>([^<]+)"
PAGE_LINES, LINE_STEP, TOP, LEFT, CHAR_WIDTH, MOST_WIDTH = 12, 60.0, 40.0, 72.0, 5.0, 468.0


def _placed(rows: DataFrame, size: Column, bold: Column, centred: Column, page: Column | None = None) -> DataFrame:
    """Lines (schema LINES) of (doc_id, ord, text): twelve to a page, unless the page is given."""
    at = F.col("ord") % PAGE_LINES
    width = F.least(F.lit(MOST_WIDTH), F.length("text") * CHAR_WIDTH)
    left = F.when(centred, (rules.PAGE_WIDTH - width) / 2).otherwise(LEFT)
    top = TOP + at * LINE_STEP
    cols = {
        "doc_id": F.col("doc_id"), "ord": F.col("ord"), "text": F.col("text"),
        "page": F.floor(F.col("ord") / PAGE_LINES) + 1 if page is None else page, "font_name": F.lit(""), "font_size": size, "bold": bold,
        "italic": F.lit(False), "x0": left, "y0": top, "x1": left + width, "y1": top + size, "block": F.col("ord"), "line": F.lit(0),
        "source": F.lit("native"), "span_count": F.lit(1), "page_width": F.lit(rules.PAGE_WIDTH), "page_height": F.lit(rules.PAGE_HEIGHT),
    }
    return rows.select(*(cols[f.name].cast(f.dataType).alias(f.name) for f in LINES.fields))


def html_lines(pages: DataFrame) -> DataFrame:
    """Lines of (page_id, html): the text of headings, paragraphs, list items, links and the like, in order."""
    html = F.coalesce("html", F.lit(""))
    both = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(ELEMENT), F.lit(1)).alias("tag"), F.regexp_extract_all(html, F.lit(ELEMENT), F.lit(2)).alias("text")
    )
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(both).alias("ord", "e")).select(
        "doc_id", "ord", F.col("e.tag").alias("tag"), collapse_space(F.col("e.text")).alias("text")
    )
    tag = F.col("tag")
    size = F.when(tag == "h1", 18.0).when(tag == "b", 12.0).when(tag == "p", 10.0).otherwise(8.0)
    return _placed(rows, size, tag.isin("h1", "b"), tag == "h1")


def html_docs(pages: DataFrame) -> DataFrame:
    """Documents (schema DOCS) of (page_id, url, html): the last part of the path is the file's name."""
    path = F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*$", "")
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1)
    return pages.select(
        F.col("page_id").alias("doc_id"), F.regexp_extract(path, "([^/]*)$", 1).alias("filename"), title.alias("meta_title"),
        F.lit("").alias("meta_author"), F.lit(1).alias("document_page_count"),
    ).select(*(F.col(f.name).cast(f.dataType) for f in DOCS.fields))


def text_lines(documents: DataFrame) -> DataFrame:
    """Lines of (doc_id, text): one per line end; the first is a heading by size."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "raw"))
    rows = rows.select("doc_id", "ord", collapse_space(F.col("raw")).alias("text"))
    first = F.col("ord") == 0
    return _placed(rows, F.when(first, 18.0).otherwise(10.0), first, first)


def conversation_lines(turns: DataFrame) -> DataFrame:
    """Lines of (conv_id, turn, text): a page for each turn, a line for each line end."""
    rows = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("at"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "raw"))
    rows = rows.select("doc_id", "at", "ord", collapse_space(F.col("raw")).alias("text"))
    return _placed(rows, F.lit(10.0), F.lit(False), F.lit(False), F.col("at"))
