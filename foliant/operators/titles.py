"""Title selection: labelled lines, ranking, fallback, metadata, reconciliation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import predicates as P
from foliant.functions import rules
from foliant.functions import text as X
from foliant.operators import features, merge
from foliant.operators.folds import per_document
from foliant.operators.windows import doc_window, page_window
from foliant.schemas import LINES, TITLES

HEURISTIC = "Weighted layout heuristic over font, position, isolation, and structure."
FALLBACK = "Fallback to the largest topical heading after stronger title candidates were rejected."
LABEL = "Found an explicit Title / Project Title label."
CHROME = "Recovered the article title from browser/print chrome."
COURSE = "Extracted the project title from a Course: cover line."
COURSE_NEXT = "Used the topical line under a Course: label as the title."
ALL_REJECTED = "Every candidate was rejected as boilerplate, header, or author text."
NO_LINES = "No extractable lines to score."
METADATA = "Validated PDF /Title metadata field."
FULLER = "PDF /Title matches the in-PDF title and is more complete."
AGREED = "In-PDF title agrees with /Title metadata; using the page text."
OVER_LABEL = " Overrode /Title metadata with an explicit on-page Title label."
OVER_ABSENT = " Overrode /Title metadata; that field does not appear on the page."
OVER_WEAKER = " Overrode /Title metadata with the stronger in-PDF title."


#: The longest word of each phrase of a cover page; only a page that has one is put together.
COVER_WORDS = tuple(dict.fromkeys(max(re.findall("[a-z]+", phrase), key=len) for phrase in re.sub(r"\\.", " ", rules.COVER_PAGE).split("|")))


def with_covers(lines: DataFrame) -> DataFrame:
    """Adds `kept`: false on pages whose joined text is a publisher's cover, unless nothing would be left."""
    hint = F.max(F.lower("text").rlike("|".join(COVER_WORDS))).over(page_window())
    own = F.collect_list(F.when(F.col("hint"), F.struct("ord", "text"))).over(page_window())
    blob = F.array_join(F.transform(F.array_sort(F.col("own")), lambda x: x["text"]), " ")
    marked = lines.withColumn("hint", hint).withColumn("own", own).withColumn("on_cover", F.col("hint") & X.matches(blob, rules.COVER_PAGE))
    return marked.withColumn("kept", ~F.col("on_cover") | F.min("on_cover").over(doc_window())).drop("hint", "own", "on_cover")


def drop_cover_pages(lines: DataFrame) -> DataFrame:
    """Without the pages that with_covers() marks."""
    return with_covers(lines).where("kept").drop("kept")


def with_label(lines: DataFrame) -> DataFrame:
    """Adds `label`, (title, page, reason), to classified lines that say what the title is; else null."""
    order = doc_window().orderBy("page", "y0", "ord")
    t = F.col("text")
    label = X.collapse_space(F.regexp_extract(t, X.rx(rules.LABELLED_TITLE), 1))
    chrome = F.regexp_replace(X.collapse_space(F.regexp_extract(t, X.rx(rules.PRINT_CHROME_TITLE), 1)), r"(?U)^I\s+", "")
    course = F.trim(F.regexp_replace(X.collapse_space(F.regexp_extract(t, X.rx(rules.COURSE_LINE), 1)), X.rx(rules.COURSE_PREFIX), ""))
    is_course = X.matches(t, rules.COURSE_LINE)
    fine = (F.col("word_count") >= 3) & F.col("topical") & F.col("boilerplate").isNull() & ~F.col("sentence")
    following = F.when(F.lead("page").over(order) == F.col("page"), F.lead(F.when(fine, t)).over(order))
    course_ok = (X.word_count(course) >= 3) & P.looks_topical(course)
    title = F.when(label != "", label).when(chrome != "", chrome).when(is_course & course_ok, course).when(is_course, following)
    why = F.when(label != "", LABEL).when(chrome != "", CHROME).when(course_ok, COURSE).otherwise(COURSE_NEXT)
    n, lt = F.col("label_words"), F.col("label_title")
    good = (
        (lt != "")
        & (n >= rules.MIN_WORDS)
        & P.boilerplate_reason(X.bare("label_title")).isNull()
        & ~P.looks_like_sentence(X.bare("label_title"), n, P.looks_topical(X.bare("label_title")))
    )
    return (
        lines.withColumns({"label_title": title, "label_why": why})
        .withColumn("label_words", X.word_count(lt))
        .withColumn("label", F.when(good, F.struct(lt.alias("title"), F.col("page"), F.col("label_why").alias("reason"))))
        .drop("label_title", "label_why", "label_words")
    )


def first_label() -> Column:
    """Aggregate: the first label by page and height."""
    return F.min_by("label", F.when(F.col("label").isNotNull(), F.struct("page", "y0", "ord")))


def labelled_titles(lines: DataFrame) -> DataFrame:
    """(doc_id, title, page, reason): the first line, by page and height, that says it is the title."""
    return with_label(lines).where("label is not null").groupBy("doc_id").agg(first_label().alias("label")).select("doc_id", "label.*")


def best_fallback() -> Column:
    """Aggregate: (title, page) of the largest topical line that nothing rejects; longer, then higher lines first."""
    good = (
        F.col("reject_bare").isNull()
        & (F.col("word_count") >= rules.MIN_WORDS)
        & F.col("topical")
        & ~F.col("fragment")
        & ~F.col("sentence")
    )
    rank = F.struct(F.coalesce("font_size", F.lit(0.0)).alias("size"), "word_count", (-F.col("y0")).alias("up"), (-F.col("ord")).alias("first"))
    return F.max_by(F.struct(F.col("text").alias("title"), "page"), F.when(good, rank))


def fallback_titles(lines: DataFrame) -> DataFrame:
    """(doc_id, title, page) of the documents that have a fallback."""
    return lines.groupBy("doc_id").agg(best_fallback().alias("best")).where("best is not null").select("doc_id", "best.*")


def first_keys() -> Column:
    """Aggregate: the lines of the first three pages, with their keys."""
    return F.collect_list(F.when(F.col("page") <= 3, F.struct("ord", "norm")))


def joined_keys(rows: Column) -> Column:
    """The keys that first_keys() collected, in order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["norm"]), " ")


def key_in(title: Column, blob: Column) -> Column:
    """Whether a title's key of eight letters stands in joined keys, or ten letters of it without spaces."""
    key, blob = X.exact_key(title), F.coalesce(blob, F.lit(""))
    packed = F.regexp_replace(key, " ", "")
    return (F.length(key) >= 8) & (blob.contains(key) | ((F.length(packed) >= 10) & F.regexp_replace(blob, " ", "").contains(packed)))


def validate_metadata(docs: DataFrame, compose: bool = True) -> DataFrame:
    """Adds meta_clean (the cleaned title) and meta_status (`ok`, or why it is no title)."""
    x, source = X.bare("meta_clean"), F.coalesce("meta_title", F.lit(""))
    t = x.text
    key = X.exact_key(t)
    status = (
        F.when(t == "", "empty")
        .when(source.contains("..."), "truncated")
        .when(F.length(t) < rules.MIN_METADATA_CHARS, "too_short")
        .when(X.matches(x, rules.FILE_EXTENSION), "file_extension")
        .when(X.matches(t, rules.WORD_PROCESSOR), "word_processor")
        .when(X.matches(t, rules.FILE_PATH), "filepath")
        .when(X.matches(source, rules.SHARING_SITE) | X.matches(t, r"^\d+\s*,\s*\d+"), "studocu")
        .when(key.isin(*rules.GENERIC_TITLES), "generic")
        .when(X.matches_filename(t, F.col("filename")), "matches_filename")
        .when(F.coalesce((F.col("meta_author") != "") & (X.exact_key(F.col("meta_author")) == key), F.lit(False)), "matches_author")
        .when(P.boilerplate_reason(x).isNotNull(), "boilerplate")
        .when(P.venue_reason(x).isNotNull(), "journal_masthead")
        .when(X.word_count(t) > rules.MAX_WORDS, "too_long")
        .otherwise("ok")
    )
    return docs.withColumn("meta_clean", X.clean_metadata_title(F.col("meta_title"), compose)).withColumn("meta_status", status)


def title_on_page(titles: DataFrame, title_col: str, lines: DataFrame) -> DataFrame:
    """(doc_id, on_page): whether the title's key stands in the joined keys of the first three pages."""
    early = lines.groupBy(F.col("doc_id").alias("of")).agg(joined_keys(first_keys()).alias("blob"))
    return titles.join(early, F.col("doc_id") == F.col("of"), "left").select("doc_id", key_in(F.col(title_col), F.col("blob")).alias("on_page"))


def reconcile(both: DataFrame) -> DataFrame:
    """Adds `choice` to rows with meta_clean, meta_status, on_page and the layout's title, source,
    confidence and score: metadata, metadata_fuller, agreed, or layout:<why metadata lost>."""
    meta_key, key = X.exact_key(F.col("meta_clean")), X.exact_key(F.coalesce("title", F.lit("")))
    score = F.coalesce("score", F.lit(0.0))
    strong = (F.col("confidence") == "high") | (score >= rules.HIGH_SCORE)
    usable = F.col("confidence").isin("high", "medium") | (score >= rules.MEDIUM_SCORE)
    on_page = F.coalesce("on_page", F.lit(False))
    same = X.is_title_fragment(meta_key, key)
    fuller = meta_key.contains(key) & (F.length(meta_key) > F.length(key) + 10) & on_page
    choice = (
        F.when(F.col("meta_status") != "ok", "layout")
        .when(F.trim(F.coalesce("title", F.lit(""))) == "", "metadata")
        .when(same & fuller, "metadata_fuller")
        .when(same, "agreed")
        .when((F.col("source") == "labeled") & usable, "layout:page_title_differs")
        .when(strong, F.when(on_page, "layout:page_title_differs").otherwise("layout:not_on_page"))
        .when(usable & ~on_page, "layout:not_on_page")
        .otherwise("metadata")
    )
    return both.withColumn("choice", choice)


def confidence_of(score: Column, margin: Column) -> Column:
    return F.when((score >= rules.HIGH_SCORE) & (margin >= rules.HIGH_MARGIN), "high").when(score >= rules.MEDIUM_SCORE, "medium").otherwise("low")


def is_high_confidence(title: Column, confidence: Column, score: Column, page: Column) -> Column:
    intro = (page == 1) & (score >= rules.MEDIUM_SCORE) & X.matches(title, rules.INTRODUCTION_TO)
    return F.coalesce((F.trim(title) != "") & ((confidence == "high") | intro), F.lit(False))


def is_weak(title: Column, reason: Column) -> Column:
    weak = (F.trim(title) == "") | (X.word_count(title) <= 2) | X.ends_incomplete(title) | reason.contains("Fallback to the largest topical heading")
    return F.coalesce(weak, F.lit(True))


def _fragment(a: str, b: str) -> bool:
    return bool(a and b) and (a in b or b in a)


def _result(doc_id: int, title: str, source: str, confidence: str, score: float, page: int, reason: str) -> dict:
    marks = [{"key": "labeled", "value": score}] if source == "labeled" else []
    return {
        "doc_id": doc_id, "title": title, "source": source, "confidence": confidence, "score": score, "page": page, "reason": reason,
        "signals": marks, "alternatives": [], "rejected_metadata": None,
    }


def _select(rows: list[dict]) -> dict:
    """The title of a document from its candidates; `give_up` where a fallback should rather be taken."""
    ranked = sorted(rows, key=lambda r: (-r["score"], r["ord"]))
    apart = lambda c, m: not _fragment(c["norm"], m["m_norm"])
    title = ranked[0]
    early = [r for r in ranked if r["page"] <= 2]
    if early and title["page"] > 2:
        about = next((r for r in early if r["topical"]), None)
        form = not title["topical"] or (title["all_caps"] and title["word_count"] <= 8)
        margin = title["score"] - early[0]["score"]
        if form and about:
            title = about
        elif margin < 12 or (form and margin < 22):
            title = early[0]
    give_up = False
    if title["m_author"]:
        other = next((r for r in ranked if apart(r, title) and not r["author"]), None)
        give_up, title = other is None, other or title
    give_up |= title["m_short"]
    rivals = [r for r in ranked if apart(r, title)]
    if title["m_prose"]:
        other = next((r for r in rivals if not (r["prose"] or r["author"])), None)
        if other:
            title = other
            rivals = [r for r in ranked if apart(r, title)]
    score = title["merged_score"]
    margin = score - (rivals[0]["score"] if rivals else 0.0)
    sure = "high" if score >= rules.HIGH_SCORE and margin >= rules.HIGH_MARGIN else "medium" if score >= rules.MEDIUM_SCORE else "low"
    if sure == "high" and merge.ends_open(title["merged_text"]):
        sure = "medium"
    entry = lambda text, value, r: {"text": text, "score": round(value, 2), "page": r["page"], "font_size": r["font_size"]}
    found = _result(title["doc_id"], title["merged_text"], "heuristic", sure, round(score, 2), title["page"], HEURISTIC)
    return found | {
        "signals": title["signals"],
        "alternatives": [entry(title["merged_text"], score, title), *(entry(r["text"], r["score"], r) for r in rivals[:7])],
        "give_up": give_up,
    }


def _layout(rows: list[dict]) -> list[dict]:
    """A document's layout title: a label, else the best candidate, else the fallback, else none."""
    doc, carried = rows[0]["doc_id"], rows[0]["carried"]
    label = carried["label"] or carried["raw_label"]
    spare = carried["fallback"]
    if label:
        made = _result(doc, label["title"], "labeled", "high", 95.0, label["page"], label["reason"])
    else:
        candidates = [r for r in rows if r["score"] is not None]
        made = _select(candidates) if candidates else None
        if spare and (made is None or made["give_up"]):
            made = _result(doc, spare["title"], "heuristic", "medium", 40.0, spare["page"], FALLBACK)
        made = made or _result(doc, None, None, "low", 0.0, None, ALL_REJECTED)
    return [made | {"blob": carried["blob"]}]


def layout_candidates(raw: DataFrame) -> DataFrame:
    """Usable lines of classified ones: merged, classified anew and scored; `score` null where rejected.

    The windows and the fold share one exchange; the windows after the fold take a second.
    """
    usable = merge.merge_adjacent(merge.with_merge_flags(drop_cover_pages(raw)), together=True).repartition("doc_id")
    return features.with_scores(features.classify(features.geometry(usable)))


def layout_titles(lines: DataFrame, compose: bool = True) -> DataFrame:
    """Layout titles (schema TITLES, and `blob`) of lines (schema LINES): a chain with two exchanges.

    What is known of a document as a whole rides on its first line from step to step.
    """
    dealt = features.deal(lines.select(*LINES.names), compose)  # before the costly expressions, which are then spread too
    raw = with_label(features.classify(features.annotate(dealt, compose=False)))
    raw = with_covers(raw.withColumns({"raw_label": first_label().over(doc_window()), "keys": first_keys().over(doc_window())}).drop("label"))
    first = F.row_number().over(doc_window().orderBy(F.desc("kept"), "ord")) == 1
    whole = F.struct("raw_label", joined_keys(F.col("keys")).alias("blob"))
    raw = raw.withColumn("first", first).withColumn("carried", F.when(F.col("first"), whole)).where("kept").drop("kept", "first", "raw_label", "keys")
    usable = merge.merge_adjacent(merge.with_merge_flags(raw), together=True).repartition("doc_id")
    scored = merge.with_merge_flags(with_label(features.with_scores(features.classify(features.geometry(usable)))))
    names = list(rules.WEIGHTS)
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.round(f"s_{n}", 2).alias("value")) for n in names))
    scored = scored.withColumns({"d_label": first_label().over(doc_window()), "d_spare": best_fallback().over(doc_window())}).withColumns(
        {
            "carried": F.when(
                F.col("carried").isNotNull(),
                F.struct(
                    F.col("carried.raw_label").alias("raw_label"), F.col("carried.blob").alias("blob"),
                    F.col("d_label").alias("label"), F.col("d_spare").alias("fallback"),
                ),
            ),
            "signals": pairs,
            "prose": F.col("boilerplate").isNotNull() | F.col("fragment") | F.col("sentence"),
        }
    )
    keep = ["text", "norm", "page", "font_size", "score", "topical", "all_caps", "word_count", "author", "prose", "signals", "carried"]
    grown = merge.grow_candidates(scored, keep, together=True)
    m = X.bare("merged_text")
    judged = grown.withColumns({"m_words": X.word_count(m.text), "m_topical": P.looks_topical(m), "m_norm": X.exact_key(m.text)}).withColumns(
        {
            "m_author": P.looks_like_author(m, F.col("word_count"), F.col("m_topical")),
            "m_short": X.matches(m, rules.NAME_PREFIX) | P.looks_like_short_name(m, F.col("m_topical")),
            "m_prose": P.boilerplate_reason(m).isNotNull()
            | P.looks_like_fragment(m, F.col("m_words"))
            | P.looks_like_sentence(m, F.col("m_words"), F.col("m_topical")),
        }
    )
    signal_list = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.DoubleType())]))
    fields = [T.StructField("signals", signal_list) if f.name == "signals" else f for f in TITLES.fields]
    schema = T.StructType([*fields, T.StructField("blob", T.StringType())])
    return per_document(judged, None, _layout, schema, together=True).withColumn("signals", F.map_from_entries("signals"))


def detect_titles(docs: DataFrame, lines: DataFrame, compose: bool = True) -> DataFrame:
    """One row (schema TITLES) per row of `docs`, from its metadata and lines (schemas DOCS and LINES).

    doc_id is the key of docs. Lines come in `ord` order, which breaks every tie. Null and blank texts
    are no lines; a document without lines falls back on its metadata. Other columns are not read.
    """
    layout = layout_titles(lines, compose).withColumnRenamed("doc_id", "t_doc")
    meta = validate_metadata(docs.select("doc_id", "filename", "meta_title", "meta_author"), compose)
    both = meta.join(layout, F.col("doc_id") == F.col("t_doc"), "left").withColumn("on_page", key_in(F.col("meta_clean"), F.col("blob")))
    return _chosen(reconcile(both))


def _chosen(rows: DataFrame) -> DataFrame:
    empty_list, empty_map = F.array().cast(TITLES["alternatives"].dataType), F.create_map().cast(TITLES["signals"].dataType)
    choice = F.col("choice")
    meta, agreed = choice.startswith("metadata"), choice == "agreed"
    lost = choice.startswith("layout:")
    why = F.substring_index(choice, ":", -1)
    had = F.coalesce("reason", F.lit(NO_LINES))
    overrode = (
        F.when(F.col("source") == "labeled", OVER_LABEL).when(why == "not_on_page", OVER_ABSENT).otherwise(OVER_WEAKER)
    )
    rejected = F.struct(
        F.nullif(F.col("meta_clean"), F.lit("")).alias("title"), F.when(lost, why).otherwise(F.col("meta_status")).alias("reason")
    )
    return rows.select(
        "doc_id",
        F.when(meta, F.col("meta_clean")).otherwise(F.col("title")).alias("title"),
        F.when(meta, "metadata").otherwise(F.col("source")).alias("source"),
        F.when(meta | agreed, "high").otherwise(F.coalesce("confidence", F.lit("low"))).alias("confidence"),
        F.when(meta, 100.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        F.when(choice == "metadata", F.lit(None).cast("int")).otherwise(F.col("page")).alias("page"),
        F.when(choice == "metadata", METADATA)
        .when(choice == "metadata_fuller", FULLER)
        .when(agreed, AGREED)
        .when(lost, F.concat(had, overrode))
        .otherwise(had)
        .alias("reason"),
        F.when(meta, F.create_map(F.lit("metadata"), F.lit(100.0))).otherwise(F.coalesce("signals", empty_map)).alias("signals"),
        F.when(meta, empty_list).otherwise(F.coalesce("alternatives", empty_list)).alias("alternatives"),
        F.when(lost | (choice == "layout"), rejected).alias("rejected_metadata"),
    )
