"""Registered queries over the driver's tables, and the same in SQL.

Each runs one operator over whole tables through the adapters of foliant.sources. Queries without
SQL are order-dependent folds; the tests hold them against straightforward loops.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import predicates as P
from foliant.functions import rules
from foliant.functions import text as X
from foliant.operators import features, front, merge, model, spans, titles
from foliant.operators.windows import doc_window
from foliant.plans import oracle as O
from foliant.plans import oracle_folds
from foliant.plans.extract import Options, extract_titles
from foliant.schemas import LINES
from foliant.sources import adapters, pdf

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.html_lines(_table(spark, sf_dir, "pages"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.text_lines(_table(spark, sf_dir, "documents"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.conversation_lines(_table(spark, sf_dir, "conversations"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.html_docs(_table(spark, sf_dir, "pages"))


def _classified(lines: DataFrame) -> DataFrame:
    return features.classify(features.annotate(lines))


def _dealt(lines: DataFrame) -> DataFrame:
    """Classified lines, dealt by document for what follows."""
    return features.classify(features.annotate(features.deal(lines), compose=False))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_scores(_dealt(_pages(spark, sf_dir)))


def _value(of: Column, name: str = "value") -> Column:
    return F.round(of, 4).alias(name)


def _of_lines(make: Callable[[], Column], source: Callable = _pages, prepare: Callable = features.annotate) -> Query:
    return lambda spark, sf_dir: prepare(source(spark, sf_dir)).select("doc_id", "ord", _value(make()))


def body_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_context(_dealt(_pages(spark, sf_dir))).select("doc_id", "body_size").distinct()


def in_context(make: Callable[[], Column]) -> Query:
    return lambda spark, sf_dir: features.with_context(_dealt(_pages(spark, sf_dir))).select("doc_id", "ord", _value(make()))


def isolation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_context(_dealt(_pages(spark, sf_dir))).select("doc_id", "ord", _value(F.col("gap_above"), "gap_above"), _value(F.col("gap_below"), "gap_below"))


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over turns of which every other conversation's begin with the same line, as the tables have none."""
    given = F.when((F.col("ord") % 12 == 0) & (F.col("doc_id") % 2 == 0), "Running head of the report").otherwise(F.col("text"))
    found = features.with_context(_dealt(_turns(spark, sf_dir).withColumn("text", given)))
    return found.where("header").select("doc_id", "norm").distinct()


def cover_pages_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.drop_cover_pages(features.annotate(_texts(spark, sf_dir))).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_distinct("page").alias("pages"))


def first_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.with_context(_dealt(_pages(spark, sf_dir))).where("author_at is not null")
    return found.select("doc_id", F.col("author_at.page").alias("page"), F.col("author_at.y0").alias("y0")).distinct()


def hard_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(_texts(spark, sf_dir)).select("doc_id", "ord", F.coalesce("reject_bare", F.lit("kept")).alias("reason"))


def garbled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", "ord", X.is_garbled(F.col("text")).alias("garbled"))


def _turn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn a page; those of under 200 characters stand for scans without a text layer."""
    t = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.lit(rules.PAGE_WIDTH).alias("page_width"),
        F.lit(rules.PAGE_HEIGHT).alias("page_height"), F.when(F.length(t) < 200, "").otherwise(t).alias("plain_text"), F.lit(True).alias("has_images"),
    )


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.classify_pages(_turn_pages(spark, sf_dir)).select("doc_id", "page", "kind")


def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.document_type(spans.classify_pages(_turn_pages(spark, sf_dir)))


def has_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.has_text_layer(_turn_pages(spark, sf_dir))


def ocr_page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _turn_pages(spark, sf_dir)
    native = pages.where("plain_text <> ''").select("doc_id", "page", F.col("plain_text").alias("text"))
    empty = native.where("false")
    return spans.page_reports(pages, native, empty, ocr_ready=True).select("doc_id", "page", "kind", "method", "span_count", "char_count", "error")


def page_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return front.page_char_counts(_texts(spark, sf_dir))


def front_text_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return front.front_text(_turns(spark, sf_dir)).select("doc_id", "text", "sent_chars")


def sparse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return front.sparse_documents(docs, _texts(spark, sf_dir))


def reconstruct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return front.reconstruct_text(_turns(spark, sf_dir))


def exact_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.annotate(_texts(spark, sf_dir)).select("doc_id", "ord", "norm", "word_count")


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return features.annotate(_texts(spark, sf_dir)).select(
        "doc_id", "ord", _value(X.letter_ratio(t), "letter_ratio"), X.mostly_all_caps(t).alias("all_caps"), X.mostly_title_or_caps(t).alias("title_or_caps"),
        X.starts_capitalised(t).alias("starts_capital"), X.ends_with_period(t).alias("period_end"), X.ends_incomplete(t).alias("incomplete"),
    )


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(_texts(spark, sf_dir)).select(
        "doc_id", "ord", "topical", "author", "fragment", "sentence", "short_name", "abstract_mark", "cover_role",
        P.looks_like_formula(F.col("text")).alias("formula"), P.looks_like_ocr_junk(F.col("text"), F.col("topical")).alias("ocr_junk"),
        P.looks_like_person_names(F.col("text"), F.col("word_count"), F.col("topical")).alias("names"),
        F.coalesce("boilerplate", F.lit("")).alias("boilerplate"), F.coalesce("venue", F.lit("")).alias("venue"),
    )


def metadata_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.validate_metadata(_docs(spark, sf_dir)).select("doc_id", "meta_clean", "meta_status")


def title_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = titles.validate_metadata(_docs(spark, sf_dir))
    return titles.title_on_page(meta, "meta_clean", features.annotate(_pages(spark, sf_dir)))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best line of each document, unmerged, with its confidence over the next line."""
    # One aggregation, not a filter and two windows: what a filter says of the score is carried into
    # every later expression, and planning took seconds.
    scored = _scored(spark, sf_dir).withColumn("score", F.round("score", 4))
    first = F.min_by(F.struct("text", "score", "page"), F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), F.col("ord"))))
    best = scored.groupBy("doc_id").agg(first.alias("b"), F.sort_array(F.collect_list("score"), asc=False).alias("scores")).where("b is not null")
    score = F.col("b.score")
    sure = titles.confidence_of(score, score - F.coalesce(F.get("scores", F.lit(1)), F.lit(0.0)))
    return best.select(F.col("doc_id").alias("b_doc"), F.col("b.text").alias("title"), score.alias("score"), F.col("b.page").alias("page"), sure.alias("confidence"))


def title_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = titles.validate_metadata(_docs(spark, sf_dir))
    on_page = titles.title_on_page(meta, "meta_clean", features.annotate(_pages(spark, sf_dir))).withColumnRenamed("doc_id", "p_doc")
    both = meta.join(_best(spark, sf_dir), F.col("doc_id") == F.col("b_doc"), "left").join(on_page, F.col("doc_id") == F.col("p_doc"), "left")
    return titles.reconcile(both.withColumn("source", F.lit("heuristic"))).select("doc_id", "title", "meta_status", "choice")


def labelled_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over lines of which every seventh is given a label, as the tables have none."""
    lines = _pages(spark, sf_dir)
    given = lines.withColumn("text", F.when(F.col("ord") % 7 == 3, F.concat(F.lit("Project Title: "), "text")).otherwise(F.col("text")))
    return titles.labelled_titles(_classified(given)).select("doc_id", "title", "page")


def fallback_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over lines of which every fifth is given a topical ending, as the tables' words are invented."""
    lines = _pages(spark, sf_dir)
    given = lines.withColumn("text", F.when(F.col("ord") % 5 == 2, F.concat("text", F.lit(" Design Study"))).otherwise(F.col("text")))
    return titles.fallback_titles(_classified(given))


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "ord", F.coalesce("reject_reason", F.lit("kept")).alias("reason"), _value(F.coalesce("score", F.lit(-1.0)), "score"))


def top_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _scored(spark, sf_dir).where("score is not null").withColumn("score", F.round("score", 4))
    rank = F.row_number().over(doc_window().orderBy(F.desc("score"), "ord"))
    return ranked.withColumn("rank", rank).where("rank <= 7").select("doc_id", "rank", "text", "score", "page")


def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).groupBy("confidence").agg(F.count("*").alias("documents"))


def title_only_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _docs(spark, sf_dir).select("doc_id", "filename")
    both = files.join(_best(spark, sf_dir), F.col("doc_id") == F.col("b_doc"), "left")
    kind = F.when(F.col("doc_id") % 2 == 0, "scanned").otherwise("native")
    return pdf.title_payload(both.withColumns({"source": F.when(F.col("title").isNotNull(), "heuristic"), "pdf_type": kind}))


def ocr_word_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of a document as a recognised one, eight to a line and forty to a block."""
    words = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("i", "text"))
    i = F.col("i")
    words = words.select(
        "doc_id", F.lit(1).alias("page"), F.floor(i / 40).cast("int").alias("block_num"), F.lit(0).alias("par_num"),
        (F.floor(i / 8) % 5).cast("int").alias("line_num"), "text", F.when(i % 11 == 0, -1.0).otherwise(i % 97 + 0.5).alias("conf"),
        (i % 8 * 50.0).alias("x0"), (i % 3 * 1.0).alias("y0"), (i % 8 * 50.0 + 40).alias("x1"), (10.0 + i % 5).alias("y1"),
    )
    return spans.ocr_lines(words).select("doc_id", "block", "line", "text", "font_size", "confidence", "x0", "y0", "x1", "y1")


def parse_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about each page's first heading: fenced, bare, amid words, and without a title."""
    docs = titles.validate_metadata(_docs(spark, sf_dir))
    name = F.regexp_replace("meta_clean", r'["\\]', "")
    body = F.concat(F.lit('{"title": "'), F.when(F.col("doc_id") % 5 == 4, "None").otherwise(name), F.lit('", "page": '), (F.col("doc_id") % 4).cast("string"), F.lit("}"))
    raw = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" as asked")))
        .otherwise(body)
    )
    reply = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.lit("STOP").alias("finishReason"),
                    F.struct(F.array(F.struct(F.lit("ignored").alias("text"), F.lit(True).alias("thought")), F.struct(raw.alias("text"), F.lit(False).alias("thought"))).alias("parts")).alias("content"),
                )
            ).alias("candidates")
        )
    )
    found = model.parse_reply(model.candidate_text(F.col("reply"))["text"])
    return docs.withColumn("reply", reply).select("doc_id", found.alias("f")).select("doc_id", F.col("f.title").alias("title"), F.col("f.page").alias("page"))


MESSAGES = (
    "404 model models/x is not found", "429 Resource_Exhausted: quota", "429 Too Many Requests", "403 Permission denied",
    "500 internal", "The model is no longer available", "You exceeded your current plan", "Rate limit reached",
)


def model_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("page_id") % len(MESSAGES) + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", model.error_kind_column(text).alias("kind"), model.blocked_by_quota(F.lit("error"), text).alias("blocked"))


def _wrapped(lines: DataFrame) -> DataFrame:
    """Lines cut into pieces of five words and set solid, some in a second column, some with a topical or
    an open end: as the tables have them, lines are too far apart to be joined."""
    w = F.split("text", " ")
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / 5).cast("int") - 1), lambda k: F.array_join(F.slice(w, k * 5 + 1, 5), " "))
    cut = lines.select("*", F.posexplode(pieces).alias("k", "piece"))
    at = F.col("ord")
    ended = F.concat("piece", F.when(at % 9 == 4, " Design Study").when(at % 13 == 5, " of the").otherwise(""))
    numbered = cut.withColumn("ord", (F.row_number().over(doc_window().orderBy("ord", "k")) - 1).cast("int"))
    placed = numbered.withColumns(
        {
            "text": ended, "page": (F.floor(at / 40) + 1).cast("int"), "x0": F.when(at % 11 == 7, 330.0).otherwise(72.0 + at % 3 * 10),
            "y0": 40.0 + at % 40 * 18,
        }
    )
    boxed = placed.withColumns({"x1": F.col("x0") + F.least(F.lit(220.0), F.length("text") * 5.0), "y1": F.col("y0") + F.col("font_size")})
    return boxed.select(*LINES.names)


def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = merge.with_merge_flags(_classified(_wrapped(_pages(spark, sf_dir))))
    return merge.merge_adjacent(lines).select("doc_id", "ord", "text", "page", "font_size", "bold", "x0", "y0", "x1", "y1")


def multiline_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = merge.with_merge_flags(titles.layout_candidates(_dealt(_wrapped(_pages(spark, sf_dir)))))
    return merge.grow_candidates(scored, ["text"]).select("doc_id", "ord", "text", "merged_text", _value(F.col("merged_score"), "merged_score"))


def spans_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of a page's lines as a span of its own: two lines side by side, some words apart, some
    larger, every fifth line of OCR."""
    # Lines are dealt and numbered, not their words, which are some thirty times as many.
    some = F.filter(F.transform(F.split("text", " "), lambda x, k: F.struct(k.alias("k"), x.alias("word"))), lambda x: x["word"] != "")
    lines = _pages(spark, sf_dir).repartition("doc_id").withColumn("some", some)
    above = F.sum(F.size("some")).over(doc_window().orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    words = lines.withColumn("above", F.coalesce(above, F.lit(0))).select("*", F.posexplode("some").alias("i", "w")).select("*", "w.k", "w.word")
    at, k = F.col("ord"), F.col("k")
    left = 72.0 + at % 2 * 270 + k * 45 + F.when(k % 6 == 5, 22).otherwise(0)
    top = 40.0 + F.floor(at / 2) % 12 * 50 + k % 3
    src = words.select(
        "doc_id", (F.col("above") + F.col("i")).cast("int").alias("ord"), F.col("word").alias("text"),
        (F.floor(at / 24) + 1).cast("int").alias("page"), "font_name", (F.col("font_size") + F.when(k % 8 == 7, 6).otherwise(0)).alias("font_size"), "bold", "italic",
        left.alias("x0"), top.alias("y0"), (left + 40).alias("x1"), (top + F.col("font_size")).alias("y1"), "block", "line",
        F.when(at % 5 == 2, "ocr").otherwise("native").alias("source"), F.lit(None).cast("double").alias("confidence"),
    )
    return spans.spans_to_lines(src, dealt=True).select("doc_id", "ord", "text", "page", "font_size", "bold", "span_count", "x0", "y0", "x1", "y1")


def _flat(found: DataFrame) -> DataFrame:
    """Titles with plain columns in place of maps, lists and structs."""
    total = F.aggregate(F.map_values("signals"), F.lit(0.0), lambda s, x: s + x)
    second = F.get("alternatives", F.lit(1))
    return found.select(
        "doc_id", "title", "source", "confidence", "score", "page", "reason", F.round(total, 2).alias("signal_sum"), F.size("alternatives").alias("n_alternatives"),
        second["text"].alias("runner_up"), second["score"].alias("runner_up_score"), F.col("rejected_metadata.title").alias("rejected_title"),
        F.col("rejected_metadata.reason").alias("rejected_reason"),
    )


def titles_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.detect_titles(_docs(spark, sf_dir), _pages(spark, sf_dir))


def detect_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(titles_of_pages(spark, sf_dir))


def detect_wrapped_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over lines that are close enough to be joined."""
    return _flat(titles.detect_titles(_docs(spark, sf_dir), _wrapped(_pages(spark, sf_dir))))


def extract_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job without a key: no title, and why."""
    out = extract_titles(_docs(spark, sf_dir), _pages(spark, sf_dir), Options())
    return out.select("doc_id", "title", "mode", "reason", "quota_exhausted", "pages_extended", "sent_chars")


def title_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best lines are strong or weak titles; some are cut to a word, left open or called a fallback."""
    best, doc = _best(spark, sf_dir), F.col("b_doc")
    t = F.when(doc % 7 == 3, F.concat("title", F.lit(" of the"))).when(doc % 11 == 2, F.substring_index("title", " ", 1)).when(doc % 13 == 5, "Introduction to Dryers").otherwise(F.col("title"))
    why = F.when(doc % 5 == 0, titles.FALLBACK).otherwise(titles.HEURISTIC)
    return best.select(
        doc.alias("doc_id"), titles.is_high_confidence(t, F.col("confidence"), F.col("score"), F.col("page")).alias("high"), titles.is_weak(t, why).alias("weak")
    )


FONTS = ("Arial-Bold", "Times-Italic", "Helvetica", "Lato-SemiBold", "Georgia-Oblique", "")


def _raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a reader yields them: a block for each line, with its text, a blank span and one of few fields."""
    at = F.col("ord")
    box = F.array("x0", "y0", F.col("x1") + 0.126, "y1")
    font = F.element_at(F.lit(list(FONTS)), (at % len(FONTS) + 1).cast("int"))
    none = F.lit(None)
    made = [(F.col("text"), font, F.col("font_size") + 0.333, at % 32, box), (F.lit(" "), font, F.col("font_size"), at % 32, box), (F.lit("tail"), none, none, none, F.array(F.lit(1.0), F.lit(2.0)))]
    span = lambda t, f, z, g, b: F.struct(
        t.alias("text"), f.cast("string").alias("font"), z.cast("double").alias("size"), g.cast("int").alias("flags"), b.alias("bbox")
    )
    block = F.struct(F.col("ord"), F.when(at % 6 == 5, 1).otherwise(0).alias("type"), F.array(F.array(*(span(*m) for m in made))).alias("lines"))
    garbled = F.when(F.col("doc_id") % 2 == 0, F.lit(MESS)).otherwise(F.lit("plain text"))
    return _pages(spark, sf_dir).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(block)), lambda b: F.struct(b["type"], b["lines"])).alias("blocks")).withColumn("plain_text", garbled)


#: A text that no reader could decode.
MESS = "(cid:1)" * 9


def layout_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.layout_spans(_raw_pages(spark, sf_dir)).drop("source", "confidence")


def _text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's lines as one block, with a blank line behind each; some are no text."""
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n \n")
    return _pages(spark, sf_dir).groupBy("doc_id", "page").agg(
        rows.alias("text"), F.lit(0).alias("block"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    ).withColumn("type", F.when((F.col("doc_id") + F.col("page")) % 5 == 4, 1))


def block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.block_spans(_text_blocks(spark, sf_dir)).select("doc_id", "ord", "text", "page", "font_size", "x0", "y0", "x1", "y1", "line")


def _partly_garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of pages, of which some, or on some pages all, cannot be read, and some are addresses."""
    raw = spans.layout_spans(_raw_pages(spark, sf_dir))
    all_bad = (F.col("doc_id") + F.col("page")) % 3 == 0
    some = F.when(all_bad | (F.col("ord") % 4 == 1), MESS).when(F.col("ord") % 7 == 2, F.concat(F.lit("www."), "text")).otherwise(F.col("text"))
    return raw.withColumn("text", some)


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.page_spans(_partly_garbled(spark, sf_dir), _raw_pages(spark, sf_dir), spans.block_spans(_text_blocks(spark, sf_dir)))
    return found.select("doc_id", "page", "ord", "text", "font_size")


def usable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.usable_spans(_partly_garbled(spark, sf_dir)).select("doc_id", "page", "ord", "text")


def ocr_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn a page to recognise, by an engine that takes a time told by the page, on a clock of its own."""
    now = [0.0]

    def engine(page: dict, timeout: float) -> list[dict]:
        now[0] += (page["doc_id"] * 7 + page["page"] * 13) % 50
        if page["page"] % 5 == 4:
            raise spans.OcrUnavailable("no engine")
        if page["page"] % 3 == 2:
            raise ValueError("bad page")
        return [{"block_num": 1, "par_num": 1, "line_num": 1, "text": "seen", "conf": 90.0, "x0": 1.0, "y0": 1.0, "x1": 2.0, "y1": 2.0}]

    pages = _turn_pages(spark, sf_dir).select("doc_id", "page")
    return spans.recognise(pages, engine, lambda: now[0]).select("doc_id", "page", "method", "error", "timeout", F.size("words").alias("words"))


def _quick_ring(keys: list[tuple[str, str]]) -> model.KeyRing:
    return model.KeyRing(keys, clock=lambda: 0.0, sleep=lambda seconds: None)


def extract_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with a caller that names the second line of the prompt, fails, or is not let in, by the prompt's length."""

    def call(key: str, name: str, prompt: str, timeout: float, **options: object) -> str:
        if len(prompt) % 3 == 1:
            raise RuntimeError("500 internal")
        if len(prompt) % 3 == 2:
            raise RuntimeError("Permission denied")
        said = json.dumps({"title": prompt.split("\n")[1], "page": 1, "reason": "as asked"})
        return json.dumps({"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": said}]}}]})

    options = Options(call=call, keys=[("K", "k")], models=["m"], ring=_quick_ring)
    out = extract_titles(_docs(spark, sf_dir), _pages(spark, sf_dir), options)
    return out.select("doc_id", "title", "source", "confidence", "page", "mode", "reason", "quota_exhausted")


def extract_on_spent_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with keys out of quota: the layout's title, and why."""

    def call(key: str, name: str, prompt: str, timeout: float, **options: object) -> str:
        raise RuntimeError("429 Resource_Exhausted: quota")

    options = Options(call=call, keys=[("K", "k")], models=["m"], ring=_quick_ring)
    out = extract_titles(_docs(spark, sf_dir), _pages(spark, sf_dir), options)
    return out.select("doc_id", "title", "source", "confidence", "score", "page", "mode", "reason", "quota_exhausted")


QUERIES: dict[str, Query] = {
    "body_font_size": body_font_size,
    "weighted_percentile": in_context(lambda: features.percentile_signal(F.col("percentile"))),
    "size_ratio_signal": in_context(lambda: features.size_ratio_signal(F.col("font_size"), F.col("body_size"))),
    "word_count_signal": _of_lines(lambda: features.word_count_signal(F.col("word_count"))),
    "caps_signal": _of_lines(lambda: features.caps_signal(F.col("text"))),
    "page_signal": in_context(lambda: features.page_signal(F.col("page"), F.col("first_page"))),
    "vertical_signal": _of_lines(lambda: features.vertical_signal(F.col("y_ratio"), F.lit(False), F.lit(False))),
    "center_signal": _of_lines(lambda: features.center_signal(F.col("center_offset"))),
    "isolation_gaps": isolation_gaps,
    "prominence": in_context(lambda: features.prominence_signal(F.col("font_size"), F.col("body_size"))),
    "running_headers": running_headers,
    "cover_pages_dropped": cover_pages_dropped,
    "first_marker": first_marker,
    "hard_reject_reason": hard_reject_reason,
    "garbled_lines": garbled_lines,
    "page_kinds": page_kinds,
    "document_type": document_type,
    "has_text_layer": has_text_layer,
    "ocr_page_cap": ocr_page_cap,
    "page_char_counts": page_char_counts,
    "front_text_block": front_text_block,
    "sparse_documents": sparse_documents,
    "reconstruct_text": reconstruct_text,
    "exact_key": exact_key,
    "text_functions": text_functions,
    "line_classes": line_classes,
    "metadata_validation": metadata_validation,
    "title_on_page": title_on_page,
    "title_reconcile": title_reconcile,
    "labeled_title": labelled_title,
    "fallback_title": fallback_title,
    "line_scores": line_scores,
    "top_alternatives": top_alternatives,
    "confidence_histogram": confidence_histogram,
    "title_only_payload": title_only_payload,
    "ocr_word_grouping": ocr_word_grouping,
    "parse_model_json": parse_model_json,
    "model_errors": model_errors,
    "merge_adjacent": merge_adjacent,
    "multiline_title": multiline_title,
    "spans_to_lines": spans_to_lines,
    "detect_title": detect_title,
    "detect_wrapped_title": detect_wrapped_title,
    "extract_without_model": extract_without_model,
    "extract_with_model": extract_with_model,
    "extract_on_spent_quota": extract_on_spent_quota,
    "title_strength": title_strength,
    "layout_spans": layout_spans,
    "block_spans": block_spans,
    "page_spans": page_spans,
    "usable_spans": usable_spans,
    "ocr_budget": ocr_budget,
}


def _sql() -> dict[str, str]:
    pages, texts, turns = O.html_lines(), O.text_lines(), O.conversation_lines()
    a, sized = O.annotated(pages), O.body_sizes(O.annotated(pages))
    value = lambda expr, src: f"SELECT doc_id, ord, round(({expr})::DOUBLE, 4) AS value FROM ({src})"
    joined = f"SELECT l.*, body_size FROM ({a}) l JOIN ({sized}) b USING (doc_id)"
    share = f"""SELECT *, sum(greatest(length(text), 1)) OVER (PARTITION BY doc_id ORDER BY font_size RANGE UNBOUNDED PRECEDING)
      / sum(greatest(length(text), 1)) OVER (PARTITION BY doc_id) AS p FROM ({a})"""
    w = rules.WEIGHTS["prominence"]
    near = f"""SELECT c.*, body_size, lag(font_size) OVER o AS above, lead(font_size) OVER o AS below, lead(author) OVER o AS next_author
      FROM ({O.classified(pages)}) c JOIN ({sized}) b ON c.doc_id = b.doc_id WINDOW o AS (PARTITION BY c.doc_id, page ORDER BY y0, ord)"""
    bonus = f"""(CASE WHEN font_size >= above * 0.92 THEN {w * 0.35} ELSE 0 END
      + CASE WHEN coalesce(next_author, false) OR coalesce(below > 0 AND font_size >= below * 1.12, false) THEN {w * 0.65} ELSE 0 END)"""
    prominence = f"least({w}, CASE WHEN body_size > 0 AND font_size >= body_size * 1.25 THEN least({w}, {bonus} + 2.0) ELSE {bonus} END)"
    text_cell = "coalesce(text, '')"
    turn_pages = f"SELECT conv_id AS doc_id, turn + 1 AS page, CASE WHEN length({text_cell}) < 200 THEN '' ELSE {text_cell} END AS t FROM conversations"
    kinds = f"""SELECT *, CASE WHEN trim(t, ' ' || chr(10)) = '' THEN 'scanned' WHEN {O.garbled('t')} THEN 'garbled'
      WHEN length(trim(t)) < {rules.NATIVE_CHARS} THEN 'scanned' ELSE 'native' END AS kind FROM ({turn_pages})"""
    ratio = "y0 / page_height"
    headed = f"SELECT * REPLACE (CASE WHEN ord % 12 = 0 AND doc_id % 2 = 0 THEN 'Running head of the report' ELSE text END AS text) FROM ({turns})"

    def front_sql(lines: str) -> str:
        return f"""
        SELECT doc_id, string_agg(header || substring(body, 1, least({rules.FRONT_CHARS} - used - length(header), {rules.FRONT_CHARS_PER_PAGE})::BIGINT), chr(10) || chr(10) ORDER BY page) AS text
        FROM (SELECT *, coalesce(sum(length(header) + least(length(body), {rules.FRONT_CHARS_PER_PAGE})) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
          FROM (SELECT doc_id, page, '--- page ' || page || ' (top 40%) ---' || chr(10) AS header, string_agg(trim(text), chr(10) ORDER BY k) AS body
            FROM (SELECT *, {ratio} AS r, row_number() OVER o AS k, count(*) OVER p AS n, count(*) FILTER ({ratio} <= {rules.FRONT_FRACTION}) OVER p AS top
              FROM ({lines}) WHERE trim(text) <> '' WINDOW p AS (PARTITION BY doc_id, page), o AS (PARTITION BY doc_id, page ORDER BY {ratio}, x0, ord))
            WHERE (top > 0 AND r <= {rules.FRONT_FRACTION}) OR (top = 0 AND k <= greatest(1, (n + 1) // 2)) GROUP BY doc_id, page))
        WHERE {rules.FRONT_CHARS} - used - length(header) > 0 GROUP BY doc_id"""

    first = front_sql(f"SELECT * FROM ({texts}) WHERE page <= {rules.PRIMARY_PAGES}")
    path = r"regexp_replace(coalesce(url, ''), '[?#].*$', '')"
    docs = f"""SELECT page_id AS doc_id, regexp_extract({path}, '([^/]*)$', 1) AS filename, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS meta_title FROM pages"""
    medium = r"\s*[|_].*?\bMedium\s*$"
    meta_clean = O.collapse(f"replace(regexp_replace(regexp_replace({O.collapse('meta_title')}, {O.quoted(medium)}, '', 'i'), '^#+', ''), '_', ' ')")
    low = lambda t: f"regexp_replace(lower({t}), '[^a-z0-9]+', '', 'g')"
    stem = r"regexp_replace(filename, '([^.])\.[^.]*$', '\1')"
    meta = f"""SELECT *, CASE WHEN meta_clean = '' THEN 'empty' WHEN contains(meta_title, '...') THEN 'truncated'
      WHEN length(meta_clean) < {rules.MIN_METADATA_CHARS} THEN 'too_short' WHEN {O.hit('meta_clean', rules.FILE_EXTENSION)} THEN 'file_extension'
      WHEN {O.hit('meta_clean', rules.WORD_PROCESSOR)} THEN 'word_processor' WHEN {O.hit('meta_clean', rules.FILE_PATH)} THEN 'filepath'
      WHEN {O.hit('meta_title', rules.SHARING_SITE)} OR {O.hit('meta_clean', '^' + chr(92) + 'd+' + chr(92) + 's*,' + chr(92) + 's*' + chr(92) + 'd+')} THEN 'studocu'
      WHEN {O.key('meta_clean')} IN {O.members(rules.GENERIC_TITLES)} THEN 'generic'
      WHEN filename <> '' AND {low('meta_clean')} = {low(stem)} AND length({low('meta_clean')}) >= 6 THEN 'matches_filename'
      WHEN {O.boilerplate('meta_clean')} IS NOT NULL THEN 'boilerplate' WHEN {O.venue('meta_clean')} IS NOT NULL THEN 'journal_masthead'
      WHEN {O.n_words('meta_clean')} > {rules.MAX_WORDS} THEN 'too_long' ELSE 'ok' END AS meta_status FROM (SELECT *, {meta_clean} AS meta_clean FROM ({docs}))"""
    k = O.key("meta_clean")
    packed = f"replace({k}, ' ', '')"
    on_page = f"""SELECT m.doc_id, length({k}) >= 8 AND (contains(coalesce(blob, ''), {k}) OR (length({packed}) >= 10 AND contains(replace(coalesce(blob, ''), ' ', ''), {packed}))) AS on_page
      FROM ({meta}) m LEFT JOIN (SELECT doc_id, string_agg(norm, ' ' ORDER BY ord) AS blob FROM ({a}) WHERE page <= 3 GROUP BY doc_id) b ON m.doc_id = b.doc_id"""
    scored = O.scored(pages)
    ranked = f"SELECT *, row_number() OVER o AS rank, lead(s, 1, 0.0) OVER o AS next FROM (SELECT *, round(score, 4) AS s FROM ({scored}) WHERE score IS NOT NULL) WINDOW o AS (PARTITION BY doc_id ORDER BY s DESC, ord)"
    best = f"""SELECT doc_id, text AS title, s AS score, page, CASE WHEN s >= {rules.HIGH_SCORE} AND s - next >= {rules.HIGH_MARGIN} THEN 'high'
      WHEN s >= {rules.MEDIUM_SCORE} THEN 'medium' ELSE 'low' END AS confidence FROM ({ranked}) WHERE rank = 1"""
    tk = O.key("title")
    same = f"({k} <> '' AND {tk} <> '' AND (contains({k}, {tk}) OR contains({tk}, {k})))"
    strong = f"(confidence = 'high' OR score >= {rules.HIGH_SCORE})"
    given = f"SELECT * REPLACE (CASE WHEN ord % 7 = 3 THEN 'Project Title: ' || text ELSE text END AS text) FROM ({pages})"
    # The adapter's width follows the text before the label is put in front, as in the query.
    label = f"CASE WHEN {O.hit('text', rules.LABELLED_TITLE)} THEN {O.collapse('regexp_extract(text, ' + O.quoted(rules.LABELLED_TITLE) + ', 1, ' + O.quoted('i') + ')')} ELSE '' END"
    topical_given = f"SELECT * REPLACE (CASE WHEN ord % 5 = 2 THEN text || ' Design Study' ELSE text END AS text) FROM ({pages})"
    strip_json = "regexp_replace(meta_clean, '[\"\\\\]', '', 'g')"
    messages = "[" + ", ".join(map(O.quoted, MESSAGES)) + "]"
    m = f"lower({messages}[(page_id % {len(MESSAGES)} + 1)::INT])"
    any_of = lambda xs: "(" + " OR ".join(f"contains({m}, {O.quoted(x)})" for x in xs) + ")"
    said = f"""SELECT d.doc_id, coalesce(f.text, '') AS front FROM ({docs}) d LEFT JOIN ({front_sql(f"SELECT * FROM ({pages}) WHERE page <= {rules.PRIMARY_PAGES}")}) g ON d.doc_id = g.doc_id
      LEFT JOIN ({front_sql(f"SELECT * FROM ({pages}) WHERE page <= {rules.SEARCH_PAGES}")}) f7 ON d.doc_id = f7.doc_id
      LEFT JOIN LATERAL (SELECT CASE WHEN coalesce(length(g.text), 0) < {rules.SPARSE_CHARS} THEN f7.text ELSE g.text END AS text) f ON true"""
    asked = "CASE WHEN front = '' THEN 'no text' WHEN length(front) % 3 = 0 THEN 'said' WHEN length(front) % 3 = 1 THEN 'failed' ELSE 'barred' END"
    named_title = O.collapse("string_split(front, chr(10))[2]")
    spent = "'All Gemini keys were quota-exhausted; used heuristic as the last fallback. '"
    best_title = """CASE WHEN doc_id % 7 = 3 THEN title || ' of the' WHEN doc_id % 11 = 2 THEN string_split(title, ' ')[1] WHEN doc_id % 13 = 5 THEN 'Introduction to Dryers' ELSE title END"""
    fonts = "[" + ", ".join(map(O.quoted, FONTS)) + "]"
    quote = "''"
    of_line = lambda value, other: f"CASE k WHEN 0 THEN {value} ELSE {other} END"
    font_name = of_line(f"{fonts}[ord % {len(FONTS)} + 1]", quote)
    style = lambda bit, hints: f"({of_line(f'(ord % 32) & {bit}', '0')} <> 0 OR regexp_matches(lower({font_name}), {O.quoted('|'.join(hints))}))"
    raw_spans = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, block, k) - 1 AS ord, {of_line('text', "'tail'")} AS text, page::INT AS page,
        {font_name} AS font_name, {of_line('round(font_size + 0.333, 2)', '0.0')}::DOUBLE AS font_size, {style(16, rules.BOLD_HINTS)} AS bold,
        {style(2, rules.ITALIC_HINTS)} AS italic, {of_line('round(x0, 2)', '0.0')}::DOUBLE AS x0, {of_line('round(y0, 2)', '0.0')}::DOUBLE AS y0,
        {of_line('round(x1 + 0.126, 2)', '0.0')}::DOUBLE AS x1, {of_line('round(y1, 2)', '0.0')}::DOUBLE AS y1, block::INT AS block, 0 AS line
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1 AS block FROM ({pages})) CROSS JOIN (VALUES (0), (2)) v(k)
      WHERE ord % 6 <> 5 AND (k = 2 OR trim(text) <> '')"""
    block_lines = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS ord, p AS text, page::INT AS page, round(h * 0.75, 2) AS font_size, round(x0, 2) AS x0,
        round(y0 + i * h, 2) AS y0, round(x1, 2) AS x1, round(y0 + i * h + h, 2) AS y1, i::INT AS line FROM (
          SELECT *, unnest(parts) AS p, unnest(range(len(parts))) AS i, greatest(y1 - y0, 1.0) / len(parts) AS h FROM (
            SELECT doc_id, page, list(text ORDER BY ord) FILTER (trim(text) <> '') AS parts, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({pages}) GROUP BY doc_id, page)
          WHERE (doc_id + page) % 5 <> 4)"""
    partly = f"""SELECT doc_id, page, ord, font_size, CASE WHEN (doc_id + page) % 3 = 0 OR ord % 4 = 1 THEN {O.quoted(MESS)} WHEN ord % 7 = 2 THEN 'www.' || text ELSE text END AS text FROM ({raw_spans})"""
    address = O.hit("text", spans.URL)
    judged = f"""SELECT *, count(*) FILTER (NOT bad) OVER p AS n_clean, count(*) OVER p AS n_all,
        sum(CASE WHEN NOT bad AND NOT {address} THEN {O.letters('text')} ELSE 0 END) OVER p AS clean_letters, sum(CASE WHEN NOT {address} THEN {O.letters('text')} ELSE 0 END) OVER p AS all_letters
      FROM (SELECT *, {O.garbled('text')} AS bad FROM ({partly})) WINDOW p AS (PARTITION BY doc_id, page)"""
    joined_text = "string_agg(text, ' ' ORDER BY ord)"
    whole_page = f"SELECT doc_id, page, {O.garbled('t')} AS page_bad FROM (SELECT doc_id, page, {joined_text} AS t FROM ({partly}) GROUP BY doc_id, page)"
    spent_time = "(doc_id * 7 + page * 13) % 50"
    turns_in_order = f"""SELECT *, row_number() OVER o AS turn_no, {rules.OCR_BUDGET_SEC} - coalesce(sum({spent_time}) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
      FROM ({turn_pages}) WINDOW o AS (PARTITION BY doc_id ORDER BY page)"""
    return {
        "body_font_size": sized,
        "weighted_percentile": value(O.percentile_signal("p"), share),
        "size_ratio_signal": value(O.size_signal("font_size", "body_size"), joined),
        "word_count_signal": value(O.word_signal("word_count"), a),
        "caps_signal": value(O.caps_signal("text"), a),
        "page_signal": value(O.page_signal("page", "first"), f"SELECT *, min(page) OVER (PARTITION BY doc_id) AS first FROM ({a})"),
        "vertical_signal": value(O.vertical_signal("y_ratio"), a),
        "center_signal": value(O.center_signal("center_offset"), a),
        "isolation_gaps": f"SELECT doc_id, ord, round(gap_above, 4) AS gap_above, round(gap_below, 4) AS gap_below FROM ({O.isolation(a)})",
        "prominence": value(prominence, near),
        "running_headers": f"""SELECT doc_id, norm FROM ({O.annotated(headed)}) WHERE norm <> '' AND word_count <= 18 GROUP BY doc_id, norm
          HAVING count(DISTINCT page) >= 2 AND count(*) FILTER (y_ratio < 0.12 OR y_ratio > 0.88) >= 2""",
        "cover_pages_dropped": f"""WITH l AS ({O.annotated(texts)}), c AS (SELECT doc_id, page, {O.hit("string_agg(text, ' ' ORDER BY ord)", rules.COVER_PAGE)} AS cover FROM l GROUP BY doc_id, page)
          SELECT l.doc_id, count(*) AS lines, count(DISTINCT l.page) AS pages FROM l JOIN c ON l.doc_id = c.doc_id AND l.page = c.page
          WHERE NOT cover OR l.doc_id IN (SELECT doc_id FROM c GROUP BY doc_id HAVING bool_and(cover)) GROUP BY l.doc_id""",
        "first_marker": f"SELECT doc_id, s.p AS page, s.y AS y0 FROM (SELECT doc_id, min(struct_pack(p := page, y := y0)) AS s FROM ({O.classified(pages)}) WHERE author GROUP BY doc_id)",
        "hard_reject_reason": f"SELECT doc_id, ord, coalesce(reject_bare, 'kept') AS reason FROM ({O.with_bare_reject(texts)})",
        "garbled_lines": f"SELECT doc_id, ord, {O.garbled('text')} AS garbled FROM ({texts})",
        "page_kinds": f"SELECT doc_id, page::INT AS page, kind FROM ({kinds})",
        "document_type": f"SELECT doc_id, CASE WHEN bool_and(kind = 'native') THEN 'native' WHEN NOT bool_or(kind = 'native') THEN 'scanned' ELSE 'mixed' END AS pdf_type FROM ({kinds}) GROUP BY doc_id",
        "has_text_layer": f"SELECT doc_id, bool_or(kind = 'native' AND page <= 3) AS has_text_layer FROM ({kinds}) GROUP BY doc_id",
        "ocr_page_cap": f"""SELECT doc_id, page::INT AS page, kind, method, CASE WHEN method = 'native' THEN 1 ELSE 0 END AS span_count,
            CASE WHEN method = 'native' THEN length(t) ELSE 0 END AS char_count, CASE WHEN method = 'ocr_skipped' THEN 'OCR page limit reached' END AS error
          FROM (SELECT *, CASE WHEN t <> '' THEN 'native' WHEN sum((t = '')::INT) OVER (PARTITION BY doc_id ORDER BY page) > {rules.OCR_PAGES} THEN 'ocr_skipped' ELSE 'ocr' END AS method FROM ({kinds}))""",
        "page_char_counts": f"SELECT doc_id, page, sum(length(text))::BIGINT AS char_count FROM ({texts}) GROUP BY doc_id, page",
        "front_text_block": f"SELECT *, length(text) AS sent_chars FROM ({front_sql(turns)})",
        "sparse_documents": f"""SELECT doc_id, sent_chars FROM (SELECT d.doc_id, coalesce(length(f.text), 0) AS sent_chars FROM documents d LEFT JOIN ({first}) f ON d.doc_id = f.doc_id)
          WHERE sent_chars < {rules.SPARSE_CHARS}""",
        "reconstruct_text": f"""SELECT doc_id, string_agg('--- page ' || page || ' ---' || chr(10) || trim(body, ' ' || chr(10)), chr(10) || chr(10) ORDER BY page) AS text
          FROM (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord) AS body FROM ({turns}) GROUP BY doc_id, page) GROUP BY doc_id""",
        "exact_key": f"SELECT doc_id, ord, norm, word_count FROM ({O.annotated(texts)})",
        "text_functions": f"""SELECT doc_id, ord, round(coalesce({O.letters('text')} / nullif(length(regexp_replace(text, '\\s+', '', 'g')), 0), 0), 4) AS letter_ratio,
            {O.all_caps('text')} AS all_caps, {O.title_or_caps('text')} AS title_or_caps,
            regexp_matches(regexp_extract(text, '\\p{{L}}'), '^\\p{{Lu}}') AS starts_capital, {O.period_end('text')} AS period_end, {O.incomplete('text')} AS incomplete
          FROM ({O.annotated(texts)})""",
        "line_classes": f"""SELECT doc_id, ord, topical, author, fragment, sentence, {O.short_name('text', 'topical')} AS short_name, abstract_mark, cover_role,
            {O.formula('text')} AS formula, {O.ocr_junk('text', 'topical')} AS ocr_junk, {O.person_names('text', 'word_count', 'topical')} AS names,
            coalesce(boilerplate, '') AS boilerplate, coalesce(venue, '') AS venue FROM ({O.classified(texts)})""",
        "metadata_validation": f"SELECT doc_id, meta_clean, meta_status FROM ({meta})",
        "title_on_page": on_page,
        "title_reconcile": f"""SELECT m.doc_id, title, meta_status, CASE WHEN meta_status <> 'ok' THEN 'layout' WHEN trim(coalesce(title, '')) = '' THEN 'metadata'
            WHEN {same} AND contains({k}, {tk}) AND length({k}) > length({tk}) + 10 AND on_page THEN 'metadata_fuller' WHEN {same} THEN 'agreed'
            WHEN {strong} THEN CASE WHEN on_page THEN 'layout:page_title_differs' ELSE 'layout:not_on_page' END
            WHEN (confidence IN ('high', 'medium') OR score >= {rules.MEDIUM_SCORE}) AND NOT on_page THEN 'layout:not_on_page' ELSE 'metadata' END AS choice
          FROM ({meta}) m LEFT JOIN ({best}) b ON m.doc_id = b.doc_id LEFT JOIN ({on_page}) p ON m.doc_id = p.doc_id""",
        "labeled_title": f"""SELECT doc_id, s.title AS title, s.page AS page FROM (SELECT doc_id, min_by(struct_pack(title := title, page := page), struct_pack(p := page, y := y0, o := ord)) AS s
          FROM (SELECT *, {O.n_words('title')} AS n, {O.topical('title')} AS about FROM (SELECT *, {label} AS title FROM ({O.annotated(given)})) WHERE title <> '')
          WHERE n >= {rules.MIN_WORDS} AND {O.boilerplate('title')} IS NULL AND NOT {O.sentence('title', 'n', 'about')} GROUP BY doc_id)""",
        "fallback_title": f"""SELECT doc_id, s.t AS title, s.p AS page FROM (SELECT doc_id, max_by(struct_pack(t := text, p := page), struct_pack(a := font_size, b := word_count, c := -y0, d := -ord)) AS s
          FROM ({O.with_bare_reject(topical_given)}) WHERE reject_bare IS NULL AND word_count >= {rules.MIN_WORDS} AND topical AND NOT fragment AND NOT sentence GROUP BY doc_id)""",
        "line_scores": f"SELECT doc_id, ord, coalesce(reject_reason, 'kept') AS reason, round(coalesce(score, -1.0), 4) AS score FROM ({scored})",
        "top_alternatives": f"SELECT doc_id, rank, text, s AS score, page FROM ({ranked}) WHERE rank <= 7",
        "confidence_histogram": f"SELECT confidence, count(*) AS documents FROM ({best}) GROUP BY confidence",
        "title_only_payload": f"""SELECT d.doc_id, title IS NOT NULL AS ok, trim(title) AS title, CASE WHEN title IS NOT NULL THEN 'heuristic' END AS title_source, filename,
            CASE WHEN title IS NOT NULL THEN 'heuristic' WHEN d.doc_id % 2 = 0 THEN 'scanned' ELSE 'native' END AS method,
            CASE WHEN title IS NULL AND d.doc_id % 2 = 0 THEN 'No OCR' END AS message FROM ({docs}) d LEFT JOIN ({best}) b ON d.doc_id = b.doc_id""",
        "ocr_word_grouping": """SELECT doc_id, (i // 40)::INT AS block, (i // 8 % 5)::INT AS line, string_agg(trim(w), ' ' ORDER BY i % 8 * 50.0, i % 3 * 1.0, trim(w)) AS text,
            round(median(10.0 + i % 5 - i % 3), 2)::DOUBLE AS font_size, round(avg(i % 97 + 0.5), 1) AS confidence, min(i % 8 * 50.0)::DOUBLE AS x0, min(i % 3 * 1.0)::DOUBLE AS y0,
            max(i % 8 * 50.0 + 40)::DOUBLE AS x1, max(10.0 + i % 5)::DOUBLE AS y1
          FROM (SELECT doc_id, i, parts[i + 1] AS w FROM (SELECT *, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS parts FROM documents)))
          WHERE trim(w) <> '' AND i % 11 <> 0 GROUP BY doc_id, i // 40, i // 8 % 5""",
        "parse_model_json": f"""SELECT doc_id, CASE WHEN doc_id % 5 <> 4 AND lower(t) NOT IN ('null', 'none', 'n/a') AND t <> '' THEN t END AS title, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 4)::INT END AS page
          FROM (SELECT doc_id, trim(trim({O.collapse(strip_json)}, '"'), '''') AS t FROM ({meta}))""",
        "model_errors": f"""SELECT page_id, CASE WHEN contains({m}, 'no longer available') OR (contains({m}, '404') AND contains({m}, 'model') AND NOT contains({m}, '429')) THEN 'missing_model'
            WHEN {any_of(model.DAILY_QUOTA)} THEN 'daily_quota' WHEN {any_of(model.RATE_LIMIT)} THEN 'rate_limit'
            WHEN regexp_matches(' ' || {m} || ' ', ' 40[13] |permission denied|unauthenticated') THEN 'auth' ELSE 'other' END AS kind, {any_of(model.FALLBACK_MARKERS)} AS blocked FROM pages""",
        "merge_adjacent": f"SELECT doc_id, ord, text, page, font_size, bold, x0, y0, x1, y1 FROM {oracle_folds.merged(oracle_folds.flagged(O.with_bare_reject(oracle_folds.wrapped(pages))))}",
        "spans_to_lines": oracle_folds.spans_to_lines(oracle_folds.word_spans(pages)),
        "detect_title": oracle_folds.detected(meta, pages),
        "detect_wrapped_title": oracle_folds.detected(meta, oracle_folds.wrapped(pages)),
        "multiline_title": oracle_folds.multiline_titles(oracle_folds.wrapped(pages)),
        "extract_with_model": f"""SELECT doc_id, CASE WHEN asked = 'said' AND t <> '' AND lower(t) NOT IN ('null', 'none', 'n/a') THEN t END AS title, CASE WHEN title IS NOT NULL THEN 'gemini' END AS source,
            CASE WHEN title IS NOT NULL THEN 'high' ELSE 'low' END AS confidence, CASE WHEN asked = 'said' THEN 1 END AS page,
            CASE asked WHEN 'said' THEN 'extract' WHEN 'failed' THEN 'error' ELSE 'unavailable' END AS mode,
            CASE asked WHEN 'said' THEN 'as asked' WHEN 'failed' THEN '500 internal' WHEN 'barred' THEN 'Gemini auth failed on K' ELSE {O.quoted(model.NO_TEXT)} END AS reason, false AS quota_exhausted
          FROM (SELECT doc_id, asked, trim(trim(n, '"'), '''') AS t FROM (SELECT doc_id, {asked} AS asked, {named_title} AS n FROM ({said})))""",
        "extract_on_spent_quota": f"""SELECT s.doc_id, CASE WHEN front <> '' THEN t.title END AS title, CASE WHEN front <> '' THEN coalesce(t.source, 'heuristic') END AS source,
            CASE WHEN front <> '' THEN t.confidence ELSE 'low' END AS confidence, CASE WHEN front <> '' THEN t.score END AS score, CASE WHEN front <> '' THEN t.page END AS page,
            CASE WHEN front <> '' THEN 'quota_exhausted' ELSE 'unavailable' END AS mode, CASE WHEN front <> '' THEN trim({spent} || coalesce(t.reason, '')) ELSE {O.quoted(model.NO_TEXT)} END AS reason,
            front <> '' AS quota_exhausted FROM ({said}) s JOIN ({oracle_folds.detected(meta, f"SELECT * FROM ({pages}) WHERE page <= {rules.PRIMARY_PAGES}")}) t ON s.doc_id = t.doc_id""",
        "title_strength": f"""SELECT doc_id, trim(t) <> '' AND (confidence = 'high' OR (page = 1 AND score >= {rules.MEDIUM_SCORE} AND {O.hit('t', rules.INTRODUCTION_TO)})) AS high,
            trim(t) = '' OR {O.n_words('t')} <= 2 OR {O.incomplete('t')} OR doc_id % 5 = 0 AS weak FROM (SELECT *, {best_title} AS t FROM ({best}))""",
        "layout_spans": raw_spans,
        "block_spans": block_lines,
        "page_spans": f"""SELECT doc_id, page, ord, text, font_size FROM ({judged}) JOIN ({whole_page}) USING (doc_id, page) WHERE NOT (page_bad AND doc_id % 2 = 1)
            AND (NOT bad OR NOT (n_clean > 0 AND (n_clean >= greatest(1, floor(n_all * 0.35)) OR clean_letters >= 40)))
          UNION ALL SELECT doc_id, page, ord, text, font_size FROM ({block_lines}) JOIN ({whole_page}) USING (doc_id, page) WHERE page_bad AND doc_id % 2 = 1""",
        "usable_spans": f"SELECT doc_id, page, ord, text FROM ({judged}) WHERE (clean_letters >= 40 AND NOT bad) OR (clean_letters < 40 AND all_letters >= 40)",
        "ocr_budget": f"""SELECT doc_id, page::INT AS page, CASE WHEN turn_no > {rules.OCR_PAGES} THEN 'ocr_skipped' WHEN page % 5 = 4 THEN 'ocr_unavailable' WHEN page % 3 = 2 THEN 'ocr_failed' ELSE 'ocr' END AS method,
            CASE WHEN turn_no > {rules.OCR_PAGES} THEN 'OCR page limit reached' WHEN page % 5 = 4 THEN 'no engine' WHEN page % 3 = 2 THEN 'OCR failed: bad page' END AS error,
            CASE WHEN turn_no <= {rules.OCR_PAGES} THEN greatest({rules.OCR_MIN_TIMEOUT_SEC}, CASE WHEN rest > 0 THEN rest ELSE {rules.OCR_BUDGET_SEC} END)::DOUBLE END AS timeout,
            CASE WHEN turn_no <= {rules.OCR_PAGES} AND page % 5 <> 4 AND page % 3 <> 2 THEN 1 ELSE 0 END AS words FROM ({turns_in_order})""",
        "extract_without_model": f"""SELECT d.doc_id, CAST(NULL AS VARCHAR) AS title, 'unavailable' AS mode, CASE WHEN coalesce(f.text, '') = '' THEN {O.quoted(model.NO_TEXT)} ELSE {O.quoted(model.NO_KEY)} END AS reason,
            false AS quota_exhausted, coalesce(length(g.text), 0) < {rules.SPARSE_CHARS} AND coalesce(last, 0) > {rules.PRIMARY_PAGES} AS pages_extended, coalesce(length(f.text), 0) AS sent_chars
          FROM ({docs}) d LEFT JOIN ({front_sql(f"SELECT * FROM ({pages}) WHERE page <= {rules.PRIMARY_PAGES}")}) g ON d.doc_id = g.doc_id
          LEFT JOIN (SELECT doc_id, max(page) AS last FROM ({pages}) GROUP BY doc_id) p ON d.doc_id = p.doc_id
          LEFT JOIN ({front_sql(f"SELECT * FROM ({pages}) WHERE page <= {rules.SEARCH_PAGES}")}) f7 ON d.doc_id = f7.doc_id
          LEFT JOIN LATERAL (SELECT CASE WHEN coalesce(length(g.text), 0) < {rules.SPARSE_CHARS} THEN f7.text ELSE g.text END AS text) f ON true""",
    }


SQL: dict[str, str] = _sql()
