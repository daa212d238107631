"""From pages and spans to visual lines."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import rules
from foliant.functions import text as X
from foliant.operators.folds import per_document
from foliant.operators.windows import page_window
from foliant.schemas import LINES, OCR_WORDS, SPANS, table

URL = r"https?://|\bwww\."


def is_bold(font_name: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(16) != 0) | F.lower(font_name).rlike("|".join(rules.BOLD_HINTS))


def is_italic(font_name: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(2) != 0) | F.lower(font_name).rlike("|".join(rules.ITALIC_HINTS))


def normalize_box(box: Column) -> Column:
    """Four doubles of two decimals; zeros for anything but four numbers."""
    return F.when(F.size(box) == 4, F.transform(box, lambda v: F.round(v.cast("double"), 2))).otherwise(F.array(*[F.lit(0.0)] * 4))


def layout_spans(pages: DataFrame) -> DataFrame:
    """Spans from pages with `blocks`: array of (type, lines: array of array of (text, font, size, flags, bbox)).

    Only text blocks (type 0) and spans with text count.
    """
    block = pages.select("doc_id", "page", F.posexplode("blocks").alias("block", "b")).where(F.coalesce("b.type", F.lit(0)) == 0)
    line = block.select("doc_id", "page", "block", F.posexplode("b.lines").alias("line", "l"))
    span = line.select("doc_id", "page", "block", "line", F.posexplode("l").alias("k", "s")).where(F.trim(F.coalesce("s.text", F.lit(""))) != "")
    font, flags = F.coalesce("s.font", F.lit("")), F.coalesce("s.flags", F.lit(0))
    box = normalize_box(F.col("s.bbox"))
    order = W.partitionBy("doc_id").orderBy("page", "block", "line", "k")
    return span.select(
        "doc_id", (F.row_number().over(order) - 1).alias("ord"), F.col("s.text").alias("text"), "page", font.alias("font_name"),
        F.round(F.coalesce("s.size", F.lit(0.0)), 2).alias("font_size"), is_bold(font, flags).alias("bold"), is_italic(font, flags).alias("italic"),
        *(F.get(box, k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), "block", "line",
        F.lit("native").alias("source"), F.lit(None).cast("double").alias("confidence"),
    )


def block_spans(blocks: DataFrame) -> DataFrame:
    """Spans from plain text blocks (doc_id, page, block, type, text, x0, y0, x1, y1): the lines of a
    block share its height evenly, and the font size is three quarters of a line."""
    parts = F.filter(F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.where(F.coalesce("type", F.lit(0)) == 0).withColumn("parts", parts).where(F.size("parts") > 0)
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)) / F.size("parts")
    lined = rows.withColumn("height", height).select("*", F.posexplode("parts").alias("line", "part"))
    top = F.col("y0") + F.col("line") * F.col("height")
    order = W.partitionBy("doc_id").orderBy("page", "block", "line")
    return lined.select(
        "doc_id", (F.row_number().over(order) - 1).alias("ord"), F.col("part").alias("text"), "page", F.lit("").alias("font_name"),
        F.round(F.col("height") * 0.75, 2).alias("font_size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"),
        F.round("x0", 2).alias("x0"), F.round(top, 2).alias("y0"), F.round("x1", 2).alias("x1"), F.round(top + F.col("height"), 2).alias("y1"),
        "block", "line", F.lit("native").alias("source"), F.lit(None).cast("double").alias("confidence"),
    )


def page_kind(text: Column, has_images: Column) -> Column:
    """native, scanned, garbled or empty."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""))
    images = F.coalesce(has_images, F.lit(False))
    return (
        F.when(t == "", F.when(images, "scanned").otherwise("empty"))
        .when(X.is_garbled(t), "garbled")
        .when((F.length(t) < rules.NATIVE_CHARS) & images, "scanned")
        .otherwise("native")
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("kind", page_kind(F.col("plain_text"), F.col("has_images")))


def has_text_layer(pages: DataFrame, max_pages: int | None = 3) -> DataFrame:
    """(doc_id, has_text_layer): whether one of the first pages is native."""
    first = (F.col("page") <= max_pages) if max_pages is not None else F.lit(True)
    native = F.coalesce(F.bool_or(first & (page_kind(F.col("plain_text"), F.col("has_images")) == "native")), F.lit(False))
    return pages.groupBy("doc_id").agg(native.alias("has_text_layer"))


def document_type(reports: DataFrame) -> DataFrame:
    """(doc_id, pdf_type): empty, native, scanned or mixed, by the kinds of the pages that hold anything."""
    some = F.col("kind") != "empty"
    kinds = F.count_if(some)
    return reports.groupBy("doc_id").agg(
        F.when(kinds == 0, "empty")
        .when(kinds == F.count_if(F.col("kind") == "native"), "native")
        .when(F.count_if(F.col("kind") == "native") == 0, "scanned")
        .otherwise("mixed")
        .alias("pdf_type")
    )


def _readable(of: Column) -> Column:
    """Letters in spans that hold no address."""
    return F.sum(F.when(of & ~X.matches(F.col("text"), URL), X.letters(F.col("text"))).otherwise(0)).over(page_window())


def page_spans(spans: DataFrame, pages: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Spans to use of each page.

    A page whose spans are garbled while its plain text is not takes its `blocks` spans instead.
    Else garbled spans go, if a third or 40 readable letters are left.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text")).over(page_window())), lambda x: x["text"]), " ")
    plain = pages.select(F.col("doc_id").alias("p_doc"), F.col("page").alias("p_page"), X.is_garbled(F.coalesce("plain_text", F.lit(""))).alias("plain_bad"))
    marked = (
        spans.withColumns({"bad": X.is_garbled(F.col("text")), "page_bad": X.is_garbled(joined)})
        .join(plain, (F.col("doc_id") == F.col("p_doc")) & (F.col("page") == F.col("p_page")), "left")
        .withColumn("swap", F.lit(blocks is not None) & F.col("page_bad") & ~F.coalesce("plain_bad", F.lit(True)))
    )
    clean = F.count_if(~F.col("bad")).over(page_window())
    least = F.greatest(F.lit(1), F.floor(F.count("*").over(page_window()) * 0.35))
    enough = (clean > 0) & ((clean >= least) | (_readable(~F.col("bad")) >= 40))
    own = marked.withColumn("enough", enough).where("not swap and (not enough or not bad)").select(*SPANS.names)
    if blocks is None:
        return own
    swapped = marked.where("swap").select(F.col("doc_id").alias("s_doc"), F.col("page").alias("s_page")).distinct()
    other = blocks.join(swapped, (F.col("doc_id") == F.col("s_doc")) & (F.col("page") == F.col("s_page")), "left_semi")
    return own.unionByName(other.select(*SPANS.names))


def usable_spans(spans: DataFrame) -> DataFrame:
    """Spans worth keeping of scanned or garbled pages: the clean ones with 40 readable letters, else all with as many."""
    marked = spans.withColumn("bad", X.is_garbled(F.col("text")))
    marked = marked.withColumns({"clean_letters": _readable(~F.col("bad")), "all_letters": _readable(F.lit(True))})
    return marked.where("(clean_letters >= 40 and not bad) or (clean_letters < 40 and all_letters >= 40)").select(*spans.columns)


def page_reports(pages: DataFrame, native: DataFrame, ocr: DataFrame | None = None, use_ocr: bool = True, ocr_ready: bool = False) -> DataFrame:
    """Routes each page: (doc_id, page, kind, method, span_count, char_count, error).

    `native` are the spans to use of each page by its kind. Pages without any go to OCR, the first
    OCR_PAGES of a document that need it; `ocr` has what came back.
    """
    count = lambda df, tag: df.groupBy(F.col("doc_id").alias(f"{tag}_doc"), F.col("page").alias(f"{tag}_page")).agg(
        F.count("*").cast("int").alias(f"{tag}_spans"), F.sum(F.length("text")).cast("int").alias(f"{tag}_chars")
    )
    out = classify_pages(pages).join(count(native, "n"), (F.col("doc_id") == F.col("n_doc")) & (F.col("page") == F.col("n_page")), "left")
    wants = F.col("kind").isin("scanned", "garbled") & F.col("n_spans").isNull()
    turn = F.sum(F.when(F.col("wants"), 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("page"))
    out = out.withColumn("wants", wants).withColumn("turn", turn)
    if ocr is not None:
        out = out.join(count(ocr, "o"), (F.col("doc_id") == F.col("o_doc")) & (F.col("page") == F.col("o_page")), "left")
    else:
        out = out.withColumns({"o_spans": F.lit(None).cast("int"), "o_chars": F.lit(None).cast("int")})
    method = (
        F.when(F.col("kind") == "empty", "empty")
        .when(~F.col("wants"), "native")
        .when(F.lit(not use_ocr) | (F.col("turn") > rules.OCR_PAGES), "ocr_skipped")
        .when(F.lit(not ocr_ready), "ocr_unavailable")
        .otherwise("ocr")
    )
    error = F.when((F.col("method") == "ocr_skipped"), F.when(F.lit(not use_ocr), "OCR skipped").otherwise("OCR page limit reached")).when(
        F.col("method") == "ocr_unavailable", "OCR is not available."
    )
    used = lambda c: F.coalesce(F.when(F.col("method") == "ocr", F.col(f"o_{c}")).when(F.col("method") != "empty", F.col(f"n_{c}")), F.lit(0))
    return out.withColumn("method", method).select(
        "doc_id", "page", "kind", "method", used("spans").alias("span_count"), used("chars").alias("char_count"), error.alias("error")
    )


class OcrUnavailable(RuntimeError):
    """What an engine raises where recognition cannot be had at all."""


def recognise(pages: DataFrame, engine: Callable[[dict, float], list[dict]], clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """(doc_id, page, method, error, timeout, words) of pages that need OCR, the first OCR_PAGES of a document.

    `engine(row of pages, timeout)` yields words (OCR_WORDS without doc_id and page). A page's time is what is
    left of its document's budget, OCR_MIN_TIMEOUT_SEC at least, and the whole budget again once it is spent. Errors
    of the engine are a page's method and error, and fail no task.
    """
    word = T.StructType([f for f in OCR_WORDS.fields if f.name not in ("doc_id", "page")])
    out = table("doc_id long, page int, method string, error string, timeout double", T.StructField("words", T.ArrayType(word)))

    def fold(rows: list[dict]) -> list[dict]:
        made, used = [], 0.0
        for k, row in enumerate(rows):
            page = {"doc_id": row["doc_id"], "page": row["page"], "method": "ocr", "error": None, "timeout": None, "words": []}
            made.append(page)
            if k >= rules.OCR_PAGES:
                page |= {"method": "ocr_skipped", "error": "OCR page limit reached"}
                continue
            left = rules.OCR_BUDGET_SEC - used
            page["timeout"] = max(rules.OCR_MIN_TIMEOUT_SEC, left if left > 0 else rules.OCR_BUDGET_SEC)
            began = clock()
            try:
                page["words"] = [{f: w.get(f) for f in word.names} for w in engine(row, page["timeout"])]
            except OcrUnavailable as e:
                page |= {"method": "ocr_unavailable", "error": str(e)}
            except Exception as e:  # noqa: BLE001  a page that cannot be read is data
                page |= {"method": "ocr_failed", "error": f"OCR failed: {e}"}
            used += clock() - began
        return made

    return per_document(pages, ["page"], fold, out)


def recognised_words(pages: DataFrame) -> DataFrame:
    """Words (schema OCR_WORDS) of what recognise() gives."""
    return pages.select("doc_id", "page", F.explode("words").alias("w")).select("doc_id", "page", "w.*").select(*OCR_WORDS.names)


def ocr_lines(words: DataFrame) -> DataFrame:
    """Spans of recognised words (schema OCR_WORDS): one for each block, paragraph and line."""
    good = words.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("conf", F.lit(-1.0)) >= 0))
    word = F.struct("x0", "y0", F.trim("text").alias("text"))
    order = W.partitionBy("doc_id").orderBy("page", "block_num", "par_num", "line_num")
    return (
        good.groupBy("doc_id", "page", "block_num", "par_num", "line_num")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["text"]), " ").alias("text"),
            F.round(F.percentile(F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0)), 0.5), 2).alias("font_size"),
            F.round(F.avg("conf"), 1).alias("confidence"),
            *(F.min(c).alias(c) for c in ("x0", "y0")),
            *(F.max(c).alias(c) for c in ("x1", "y1")),
        )
        .select(
            "doc_id", (F.row_number().over(order) - 1).alias("ord"), "text", "page", F.lit("ocr").alias("font_name"), "font_size",
            F.lit(False).alias("bold"), F.lit(False).alias("italic"), "x0", "y0", "x1", "y1", F.col("block_num").alias("block"),
            F.col("line_num").alias("line"), F.lit("ocr").alias("source"), "confidence",
        )
    )


def join_spans(spans: list[dict]) -> str:
    """Texts from left to right, with a space where a gap has none."""
    out, end = "", None
    for s in spans:
        text = s["text"]
        if end is not None and s["x0"] - end > 1.2 and not out.endswith(" ") and not text.startswith(" "):
            out += " "
        out, end = out + text, s["x1"]
    return (re.sub("[ \t]+", " ", out) if "  " in out or "\t" in out else out).strip()


def _size(x: dict, least: float = 0.0) -> float:
    return x["font_size"] or least


class _Cluster:
    """Spans of a baseline, with what the next ones are held against."""

    __slots__ = ("bottom", "left", "ocr", "right", "size", "size1", "spans", "top")

    def __init__(self, span: dict):
        self.spans = [span]
        self.left, self.top, self.right, self.bottom = span["x0"], span["y0"], span["x1"], span["y1"]
        self.size, self.size1, self.ocr = _size(span), _size(span, 1.0), span["source"] == "ocr"

    def add(self, span: dict) -> None:
        self.spans.append(span)
        x0, y0, x1, y1, size = span["x0"], span["y0"], span["x1"], span["y1"], _size(span)
        if x0 < self.left:
            self.left = x0
        if y0 < self.top:
            self.top = y0
        if x1 > self.right:
            self.right = x1
        if y1 > self.bottom:
            self.bottom = y1
        if size > self.size:
            self.size = size
        if (size or 1.0) > self.size1:
            self.size1 = size or 1.0
        self.ocr = self.ocr or span["source"] == "ocr"

    def tall(self) -> float:
        return max(self.bottom - self.top, self.size1, 1.0)


def _home(span: dict, clusters: list[_Cluster]) -> _Cluster | None:
    """The first cluster whose baseline a span shares."""
    x0, y0, x1, y1 = span["x0"], span["y0"], span["x1"], span["y1"]
    size, own_ocr = _size(span), span["source"] == "ocr"
    tall, middle = max(y1 - y0, size or 1.0, 1.0), (y0 + y1) / 2
    for c in clusters:
        before, after = x0 - c.right, c.left - x1
        if before > 20.0 or after > 20.0:
            if not (own_ocr or c.ocr):
                continue
            far = max(90.0, 0.16 * max(c.right, x1, 1.0))
            if before > far or after > far:
                continue
        line_tall = c.tall()
        if min(y1, c.bottom) - max(y0, c.top) <= 0.25 * min(tall, line_tall) and abs(middle - (c.top + c.bottom) / 2) >= 0.4 * max(tall, line_tall):
            continue
        if (before > 8 or after > 8) and size and c.size and abs(size - c.size) > 0.30 * max(size, c.size):
            continue
        return c
    return None


def _clusters(spans: list[dict]) -> list[_Cluster]:
    """Spans of a page by baseline, from the top: each goes to the first cluster that it is on line with.

    A cluster that no span from here on down can reach, were it as tall as the page's tallest, is
    looked at no more.
    """
    tallest = max(max(s["y1"] - s["y0"], _size(s, 1.0), 1.0) for s in spans)
    upturned = max(0.0, max(s["y0"] - s["y1"] for s in spans)) / 2
    slack = 1e-6 * (1 + sum(abs(s["y0"]) + abs(s["y1"]) + abs(_size(s)) for s in spans))  # for rounding
    sound = math.isfinite(slack)
    made: list[_Cluster] = []
    near: list[_Cluster] = []
    at = None
    for s in sorted(spans, key=lambda s: (s["y0"], s["x0"])):
        y = s["y0"]
        if sound and y != at:
            at, edge = y, y - slack
            near = [c for c in near if c.bottom > edge or edge - upturned - (c.top + c.bottom) / 2 < 0.4 * max(tallest, c.tall())]
        home = _home(s, near)
        if home is None:
            home = _Cluster(s)
            made.append(home)
            near.append(home)
        else:
            home.add(s)
    return made


def _halves(a: dict, b: dict) -> bool:
    """Whether two lines, one of OCR at least, are halves of one line."""
    if a["page"] != b["page"] or "ocr" not in (a["source"], b["source"]):
        return False
    over = min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    if over <= 0:
        return False
    tall = [max(x["y1"] - x["y0"], _size(x, 1.0), 1.0) for x in (a, b)]
    if over <= 0.45 * min(tall):
        return False
    p, q = _size(a), _size(b)
    if p and q and abs(p - q) > 0.18 * max(p, q):
        return False
    return max(0.0, b["x0"] - a["x1"], a["x0"] - b["x1"]) <= max(90.0, 0.18 * max(a["x1"], b["x1"], 1.0))


def _box(xs: list[dict]) -> dict:
    return {c: round(f(x[c] for x in xs), 2) for c, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}


def lines_of(spans: list[dict]) -> list[dict]:
    """Visual lines of a document's spans, which come in arrival order."""
    pages: dict[int, list[dict]] = {}
    for s in spans:
        pages.setdefault(s["page"], []).append(s)
    made = []
    for page, own in pages.items():
        for number, cluster in enumerate(_clusters(own)):
            row = cluster.spans
            if len(row) > 1:
                row = sorted(row, key=lambda s: (s["x0"], s["y0"]))
            text = join_spans(row)
            if not text:
                continue
            main, bold, italic = row[0], False, False
            longest, largest = len(main["text"]), _size(main)
            for s in row:
                bold, italic = bold or s["bold"], italic or s["italic"]
                n = len(s["text"])
                if n > longest or (n == longest and _size(s) > largest):
                    main, longest, largest = s, n, _size(s)
            made.append(
                {
                    "doc_id": main["doc_id"], "text": text, "page": page, "font_name": main["font_name"] or "",
                    "font_size": round(cluster.size, 2), "bold": bool(bold), "italic": bool(italic),
                    "block": main["block"], "line": number, "source": main["source"] or "native",
                    "span_count": len(row), "x0": round(cluster.left, 2), "y0": round(cluster.top, 2),
                    "x1": round(cluster.right, 2), "y1": round(cluster.bottom, 2),
                }
            )
    place = lambda x: (x["page"], x["y0"], x["x0"])
    out: list[dict] = []
    for line in sorted(made, key=place):
        if out and _halves(out[-1], line):
            a = out[-1]
            out[-1] = a | _box([a, line]) | {
                "text": " ".join(t for t in (a["text"].strip(), line["text"].strip()) if t),
                "font_size": max(a["font_size"], line["font_size"]),
                "bold": a["bold"] or line["bold"],
                "italic": a["italic"] or line["italic"],
                "span_count": a["span_count"] + line["span_count"],
                "source": "ocr",
            }
        else:
            out.append(line)
    peak = max((x["font_size"] for x in out if x["source"] == "ocr"), default=0.0)
    out.sort(key=place)
    for k, x in enumerate(out):
        x["ord"] = k
        x["bold"] = x["bold"] or (x["source"] == "ocr" and peak > 0 and x["font_size"] >= 0.97 * peak)
    return out


def spans_to_lines(spans: DataFrame, pages: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Lines (schema LINES) of spans (schema SPANS), with the pages' sizes, 612 by 792 where unknown.

    Null boxes count as zero and a null text as blank; blank spans make no line. With `dealt` the spans
    of a document are in one partition and in order already, and are not dealt and sorted again.
    """
    boxes = {c: F.coalesce(c, F.lit(0.0)) for c in ("x0", "y0", "x1", "y1")}
    src = spans.select(*(c for c in SPANS.names if c not in ("line", "confidence"))).withColumns(boxes | {"text": F.coalesce("text", F.lit("")), "page": F.coalesce("page", F.lit(1))})
    bare = [f for f in LINES.fields if f.name not in ("page_width", "page_height")]
    lines = per_document(src, None if dealt else ["ord"], lines_of, T.StructType(bare), together=dealt)
    return with_page_size(lines, pages)


def with_page_size(lines: DataFrame, pages: DataFrame | None) -> DataFrame:
    if pages is None:
        return lines.withColumns({"page_width": F.lit(rules.PAGE_WIDTH), "page_height": F.lit(rules.PAGE_HEIGHT)}).select(*LINES.names)
    size = pages.select(F.col("doc_id").alias("g_doc"), F.col("page").alias("g_page"), F.col("page_width").alias("w"), F.col("page_height").alias("h"))
    return (
        lines.join(size, (F.col("doc_id") == F.col("g_doc")) & (F.col("page") == F.col("g_page")), "left")
        .withColumns(
            {
                "page_width": F.round(F.coalesce("w", F.lit(rules.PAGE_WIDTH)), 2),
                "page_height": F.round(F.coalesce("h", F.lit(rules.PAGE_HEIGHT)), 2),
            }
        )
        .select(*LINES.names)
    )
