"""Annotated lines, reject reasons and layout signals.

Every window is over doc_id or a refinement of it, so all of them share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import predicates as P
from foliant.functions import rules
from foliant.functions import text as X
from foliant.operators.windows import doc_window, page_window


def geometry(lines: DataFrame) -> DataFrame:
    """Adds what follows from text and box: norm, word_count, y_ratio, x_mid, center_offset, line_height."""
    height = F.when(F.coalesce("page_height", F.lit(0.0)) != 0, F.col("page_height")).otherwise(1.0)
    width = F.when(F.coalesce("page_width", F.lit(0.0)) != 0, F.col("page_width")).otherwise(1.0)
    mid = (F.col("x0") + F.col("x1")) / 2
    return lines.withColumns(
        {
            "norm": X.exact_key(F.col("text")),
            "word_count": X.word_count(F.col("text")),
            "y_ratio": F.col("y0") / height,
            "x_mid": mid,
            "center_offset": F.abs(mid - width / 2) / width,
            "line_height": F.greatest(F.col("y1") - F.col("y0"), F.coalesce("font_size", F.lit(0.0)), F.lit(1.0)),
        }
    )


def deal(lines: DataFrame, compose: bool = True) -> DataFrame:
    """Lines after NFKC, a document's in one partition; annotate them without composing them again.

    What Python has worked on counts as dealt no longer, so this comes first.
    """
    texts = lines.withColumn("text", X.composed(F.coalesce("text", F.lit("")))) if compose else lines
    return texts.repartition("doc_id")


def annotate(lines: DataFrame, compose: bool = True) -> DataFrame:
    """Lines with text, cleaned, with their geometry. Null boxes count as zero."""
    boxes = {c: F.coalesce(c, F.lit(0.0)) for c in ("x0", "y0", "x1", "y1")}
    kept = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return geometry(X.with_clean_lines(kept.withColumns(boxes), compose))


def classify(lines: DataFrame) -> DataFrame:
    """Adds one column per classifier, for lines of any length, `reject_bare`, the reject reason without
    page context, and `reject_first`, its part that no context can change."""
    t, n = X.line(), F.col("word_count")
    topical = F.col("topical")
    return (
        X.with_parts(lines)
        .withColumns({"topical": P.looks_topical(t), "boilerplate": P.boilerplate_reason(t), "venue": P.venue_reason(t)})
        .withColumns(
            {
                "author": P.looks_like_author(t, n, topical),
                "fragment": P.looks_like_fragment(t, n),
                "sentence": P.looks_like_sentence(t, n, topical),
                "short_name": P.looks_like_short_name(t, topical),
                "garbled": X.is_garbled(t.text),
                "abstract_mark": P.is_abstract_marker(t.text),
                "cover_role": P.is_cover_role(t),
                "all_caps": X.mostly_all_caps(t),
                "period_end": X.ends_with_period(t.text),
            }
        )
        .withColumn("reject_first", _first_arm(_plain_arms()))
        .withColumn("reject_bare", F.coalesce("reject_first", _first_arm(_later_arms())))
        .drop(*X.PARTS)
    )


Arms = list[tuple[Column, Column | str]]


def _first_arm(arms: Arms) -> Column:
    """The reason of the first arm that holds, or null."""
    out = None
    for when, reason in arms:
        out = F.when(when, reason) if out is None else out.when(when, reason)
    return out


def _plain_arms() -> Arms:
    key, n = F.col("norm"), F.col("word_count")
    return [
        (key == "", "empty"),
        (X.is_in("norm", rules.NEVER_TITLES) | X.exact_key(P.without_section_number(F.col("text"))).isin(*rules.NEVER_TITLES), "section_heading"),
        (~n.between(rules.MIN_WORDS, rules.MAX_WORDS), "word_count"),
    ]


def _later_arms() -> Arms:
    """Arms of classified lines with their parts, in order."""
    x, key, n, y, size = X.line(), *(F.col(c) for c in ("norm", "word_count", "y_ratio", "font_size"))
    t, topical, caps = x.text, F.col("topical"), F.col("all_caps")
    size = F.coalesce(size, F.lit(0.0))
    m = lambda p, case=False: X.matches(x, p, case)
    at_start = lambda p, case=False: X.matches(X.bare("text"), p, case)  # noqa: E731  as fast as looking for a needle
    intro = m(rules.INTRODUCTION_TO)
    return [
        (F.col("boilerplate").isNotNull(), F.col("boilerplate")),
        (F.col("garbled"), "garbled"),
        (at_start(rules.COURSE_CODE, True), "course_code"),
        (key.isin(*rules.GENERIC_COURSES) & ~((size >= 18) & (F.col("page") == 1) & (y < 0.25)), "generic_course"),
        (m(rules.DEPARTMENT) | (~topical & (at_start(rules.INSTITUTION) | ((n <= 12) & m(rules.TEACHING_PLACE)))), "institution"),
        ((y < 0.12) & F.col("venue").isNotNull(), F.col("venue")),
        ((y < 0.12) & caps & (n <= 4) & ~topical & (size < 14), "masthead_caps"),
        (P.is_venue_line(x, F.col("venue"), n), "journal_name"),
        (F.col("author"), "author_or_affiliation"),
        (X.letter_ratio(x) < 0.55, "low_letter_ratio"),
        (at_start(rules.MONTH_YEAR, True), "date"),
        (at_start(rules.DEEP_HEADING) | (at_start(rules.SUB_HEADING) & ~intro), "body_section_heading"),
        ((n >= 8) & m(rules.DEFINITION), "definition"),
        ((n >= 8) & at_start(rules.LIST_ITEM, True), "list_item"),
        ((n <= 8) & at_start(rules.ROMAN_HEADING, True), "body_section_heading"),
        (~intro & (key.rlike(rules.CHAPTER_KEY) | m(rules.INTRODUCTION)), "section_heading"),
        (m(rules.EDITOR), "editor"),
        (m(rules.DEGREE), "degree"),
        (~topical & (n <= 8) & at_start(rules.TITLED_NAME), "author_or_affiliation"),
        (F.col("fragment"), "body_fragment"),
        ((caps & F.col("period_end") & (n >= 6)) | F.col("sentence"), "sentence"),
        (P.looks_like_formula(x), "formula"),
        (P.looks_like_ocr_junk(x, topical) | m(rules.NO_PERMISSION) | (t.contains("=") & (n <= 6) & ~topical), "ocr_junk"),
        (t.rlike("(?U)" + rules.NUMERIC), "numeric"),
    ]


def reject_reason() -> Column:
    """The first reason why a classified line in its context is no title, or null."""
    n, y, size, no = F.col("word_count"), F.col("y_ratio"), F.coalesce("font_size", F.lit(0.0)), F.lit(False)
    chrome, header = F.coalesce("chrome_page", no), F.coalesce("header", no)
    width = F.when(F.coalesce("page_width", F.lit(0.0)) != 0, F.col("page_width")).otherwise(1.0)
    before = [
        (chrome & (F.col("x0") / width >= 0.48), "iop_sidebar"),
        (chrome & (y < 0.12) & (n <= 4) & ~F.col("topical"), "journal_subtitle"),
    ]
    after = [(header & ((y < 0.12) | (y > 0.88)) & ((n > 10) | (size <= 12)), "running_header")]
    return F.coalesce(_first_arm(before), F.col("reject_first"), _first_arm(after), F.col("reject_bare"))


def with_context(lines: DataFrame) -> DataFrame:
    """Adds per-document statistics over all lines, before any is rejected: body size, weighted share
    of characters not larger, first page, markers, running headers, chrome pages, page neighbours.

    Deal the lines by doc_id before they are classified: all windows are then in place, where the
    first one, by document and size, would else have an exchange of its own."""
    size = F.coalesce("font_size", F.lit(0.0))
    weight = F.greatest(F.length("text"), F.lit(1))
    by_size = W.partitionBy("doc_id", "size_key")
    by_norm = W.partitionBy("doc_id", "norm")
    order = page_window().orderBy("y0", "ord")
    marker = lambda when: F.min(F.when(when, F.struct("page", "y0"))).over(doc_window())
    margin = (F.col("y_ratio") < 0.12) | (F.col("y_ratio") > 0.88)
    listed = (F.col("norm") != "") & (F.col("word_count") <= 18)
    # Where each line of a page ends before the next begins, the lines next to it tell the gaps; else all of the page do.
    reach = F.max("y1").over(order.rowsBetween(W.unboundedPreceding, -1))
    crossed = F.coalesce(F.col("reach") > F.col("y0") + 0.4, F.lit(False)) | (F.col("y1") - F.col("y0") <= 0.4)
    others = F.filter("on_page", lambda o: o["ord"] != F.col("ord"))
    is_above = lambda o: o["y1"] <= F.col("y0") + 0.4
    above = F.array_min(F.transform(F.filter(others, is_above), lambda o: F.col("y0") - o["y1"]))
    below = F.array_min(
        F.transform(F.filter(others, lambda o: ~is_above(o) & (o["y0"] >= F.col("y1") - 0.4)), lambda o: o["y0"] - F.col("y1"))
    )
    above = F.when(F.col("crossed"), above).otherwise(F.col("y0") - F.col("reach"))
    below = F.when(F.col("crossed"), below).otherwise(F.col("next_y0") - F.col("y1"))
    return (
        lines.withColumns({"size_key": F.round(size, 1), "size_or_0": size, "weight": weight})
        .withColumns({"size_chars": F.sum("weight").over(by_size), "size_ord": F.min("ord").over(by_size), "reach": reach, "next_y0": F.lead("y0").over(order)})
        .withColumn("crossed", F.max(crossed).over(page_window()))
        .withColumns(
            {
                "body_size": F.coalesce(
                    F.max(F.when(F.col("size_key") > 0, F.struct("size_chars", -F.col("size_ord"), "size_key"))).over(doc_window())["size_key"],
                    F.lit(11.0),
                ),
                "percentile": F.sum("weight").over(doc_window().orderBy("size_or_0").rangeBetween(W.unboundedPreceding, 0)) / F.sum("weight").over(doc_window()),
                "first_page": F.min("page").over(doc_window()),
                "abstract_at": marker(F.col("abstract_mark")),
                "author_at": marker(F.col("author")),
                "cover_at": marker(F.col("cover_role")),
                "header": listed
                & (F.min(F.when(listed, F.col("page"))).over(by_norm) < F.max(F.when(listed, F.col("page"))).over(by_norm))
                & (F.sum(F.when(listed & margin, 1).otherwise(0)).over(by_norm) >= 2),
                "chrome_page": F.max(X.matches(F.col("text"), rules.CHROME_MARKER)).over(page_window()),
                "on_page": F.collect_list(F.when(F.col("crossed"), F.struct("ord", "y0", "y1"))).over(page_window()),
                "above_size": F.lag(size).over(order),
                "below_size": F.lead(size).over(order),
                "below_author": F.lead("author").over(order),
            }
        )
        .withColumns(
            {
                "gap_above": F.greatest(F.least(F.col("y0"), F.coalesce(above, F.col("y0"))), F.lit(0.0)),
                "gap_below": F.greatest(
                    F.least(F.coalesce("page_height", F.lit(0.0)) - F.col("y1"), F.coalesce(below, F.lit(1e9))), F.lit(0.0)
                ),
            }
        )
        .drop("on_page", "reach", "next_y0", "crossed", "size_key", "size_or_0", "weight", "size_chars", "size_ord")
    )


def percentile_signal(p: Column) -> Column:
    return rules.WEIGHTS["font_percentile"] * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p - 0.55) / 0.45))


def size_ratio_signal(size: Column, body: Column) -> Column:
    r = F.try_divide(size, body)
    w = rules.WEIGHTS["size_vs_body"]
    return F.when((body <= 0) | (r <= 1.05), 0.0).otherwise(w * F.least(F.lit(1.0), (r - 1.05) / 0.55))


def vertical_signal(y: Column, ocr: Column, large: Column) -> Column:
    w = rules.WEIGHTS["vertical"]
    return (
        F.when(ocr & large & (y <= 0.78), w * 0.85)
        .when(y < 0.04, 1.0).when(y < 0.08, w * 0.8).when(y <= 0.48, w).when(y <= 0.62, w * 0.55).when(y <= 0.75, w * 0.2)
        .otherwise(0.0)
    )


def center_signal(offset: Column) -> Column:
    w = rules.WEIGHTS["centering"]
    return F.when(offset <= 0.04, w).when(offset <= 0.08, w * 0.7).when(offset <= 0.14, w * 0.3).otherwise(0.0)


def isolation_signal(above: Column, below: Column, height: Column) -> Column:
    typical = F.greatest(height * 0.35, F.lit(2.0))
    w = rules.WEIGHTS["isolation"]
    side = lambda gap: F.when(gap / typical >= 1.6, w * 0.5).when(gap / typical >= 1.1, w * 0.25).otherwise(0.0)
    return side(above) + side(below)


def word_count_signal(n: Column) -> Column:
    w = rules.WEIGHTS["word_count"]
    outer = F.when(n.between(rules.MIN_WORDS, rules.MAX_WORDS), w * 0.25).otherwise(0.0)
    return F.when(~n.between(rules.SWEET_MIN, rules.SWEET_MAX), outer).when(n.between(5, 16), w).otherwise(w * 0.7)


def caps_signal(text: Column) -> Column:
    w = rules.WEIGHTS["capitalization"]
    found = X.alpha_words(text)
    shouted = F.forall(found, lambda x: (F.length(x) <= 1) | (F.upper(x) == x))
    # Behind the first capital: only small letters, or capitals exactly where a part of the word begins.
    rest = lambda x: F.substr(x, F.lit(2))
    small = lambda r: r.rlike("[a-z]") & ~r.rlike("[A-Z]")
    parts = lambda r: r.rlike("[A-Z]") & ~r.rlike("[A-Za-z][A-Z]") & ~r.rlike("(?:^|[^A-Za-z])[a-z]")
    titled = F.filter(found, lambda x: x.rlike("^[A-Z]") & ((F.length(x) == 1) | small(rest(x)) | parts(rest(x))))
    content = F.exists(found, lambda x: ~F.lower(x).isin(*rules.SMALL_WORDS))
    return (
        F.when(F.size(found) == 0, 0.0)
        .when(shouted, w * 0.7)
        .when(content & (F.size(titled) >= 0.6 * F.size(found)), w)
        .when(F.element_at(found, 1).rlike("^[A-Z]"), w * 0.35)
        .otherwise(0.0)
    )


def page_signal(page: Column, first: Column) -> Column:
    w, k = rules.WEIGHTS["page_bias"], page - first
    return F.when(k <= 0, w).when(k == 1, w * 0.45).when(k == 2, w * 0.2).otherwise(0.0)


def comes_after(marker: Column) -> Column:
    """Whether the line is on a later page than the marker, or more than eight points below it."""
    same = F.col("page") == marker["page"]
    return F.coalesce((F.col("page") > marker["page"]) | (same & (F.col("y0") > marker["y0"] + 8)), F.lit(False))


def abstract_signal(marker: Column) -> Column:
    w, same = rules.WEIGHTS["before_abstract"], F.col("page") == marker["page"]
    return (
        F.when(marker.isNull() | comes_after(marker), 0.0)
        .when(same & (marker["y0"] - F.col("y0") < 280), w)
        .when(same, w * 0.6)
        .when(F.col("page") == marker["page"] - 1, w * 0.3)
        .otherwise(0.0)
    )


def _sandwich(marker: Column, near: tuple[float, float], far: tuple[float, float], weight: float, part: float) -> Column:
    d = F.when(F.col("page") == marker["page"], marker["y0"] - F.col("y1"))
    return F.when(d.between(*near), weight).when(d.between(*far), weight * part).otherwise(0.0)


def author_signal(marker: Column) -> Column:
    return _sandwich(marker, (4, 90), (0, 160), rules.WEIGHTS["above_authors"], 0.55)


def cover_signal(marker: Column) -> Column:
    return _sandwich(marker, (2, 140), (0, 220), rules.WEIGHTS["above_cover_role"], 0.5)


def prominence_signal(size: Column, body: Column) -> Column:
    w = rules.WEIGHTS["prominence"]
    a, b = F.col("above_size"), F.col("below_size")
    over = F.coalesce((b > 0) & (size >= b * 1.12), F.lit(False))
    bonus = F.when(size >= a * 0.92, w * 0.35).otherwise(0.0) + F.when(F.coalesce("below_author", F.lit(False)) | over, w * 0.65).otherwise(0.0)
    return F.least(F.lit(w), F.when((body > 0) & (size >= body * 1.25), F.least(F.lit(w), bonus + 2.0)).otherwise(bonus))


def penalties() -> Column:
    size, body, y = F.coalesce("font_size", F.lit(0.0)), F.col("body_size"), F.col("y_ratio")
    ocr, bold = F.coalesce(F.col("source") == "ocr", F.lit(False)), F.coalesce("bold", F.lit(False))
    cut = lambda when, by: F.when(when, -float(by)).otherwise(0.0)
    large = (size >= body * 0.98) | bold
    return (
        cut(comes_after(F.col("abstract_at")), 28)
        + cut((y > 0.72) & ~(ocr & (y <= 0.82) & large), 12)
        + cut((size <= body * 1.04) & ~(ocr & large), 14)
        + cut((F.col("center_offset") > 0.22) & (size < body * 1.4), 4)
        + cut(F.col("period_end") & (F.col("word_count") > 12), 3)
        + cut(F.coalesce("italic", F.lit(False)) & ~bold & (size < body * 1.3), 2)
        + cut((y < 0.18) & F.coalesce(F.col("venue").isin(*rules.VENUE_PENALTY), F.lit(False)), 18)
    )


def signals() -> dict[str, Column]:
    """Every signal by name, in the order in which they are added up."""
    size, body = F.coalesce("font_size", F.lit(0.0)), F.col("body_size")
    ocr, bold = F.coalesce(F.col("source") == "ocr", F.lit(False)), F.coalesce("bold", F.lit(False))
    return {
        "font_percentile": percentile_signal(F.col("percentile")),
        "size_vs_body": size_ratio_signal(size, body),
        "bold": F.when(bold, rules.WEIGHTS["bold"]).otherwise(0.0),
        "vertical": vertical_signal(F.col("y_ratio"), ocr, (size >= body * 0.98) | (ocr & bold)),
        "centering": center_signal(F.col("center_offset")),
        "isolation": isolation_signal(F.col("gap_above"), F.col("gap_below"), F.col("line_height")),
        "word_count": word_count_signal(F.col("word_count")),
        "capitalization": caps_signal(F.col("text")),
        "page_bias": page_signal(F.col("page"), F.col("first_page")),
        "before_abstract": abstract_signal(F.col("abstract_at")),
        "above_authors": author_signal(F.col("author_at")),
        "above_cover_role": cover_signal(F.col("cover_at")),
        "prominence": prominence_signal(size, body),
        "starts_capital": F.when(X.starts_capitalised(F.col("text")), rules.WEIGHTS["starts_capital"]).otherwise(0.0),
    }


def with_scores(lines: DataFrame) -> DataFrame:
    """Adds reject_reason, a column s_<name> per signal, and score: null where the line is no candidate."""
    named = signals()
    out = with_context(lines).withColumn("reject_reason", reject_reason())
    out = out.withColumns({f"s_{k}": v for k, v in named.items()})
    total = sum((F.col(f"s_{k}") for k in named), F.lit(0.0)) + penalties()
    size, body = F.coalesce("font_size", F.lit(0.0)), F.col("body_size")
    short = (F.col("word_count") < rules.SWEET_MIN) & (size < body * 1.35)
    ocr_cover = F.coalesce(F.col("source") == "ocr", F.lit(False)) & F.col("all_caps") & (size >= body * 0.95)
    good = F.col("reject_reason").isNull() & ~(short & ~ocr_cover)
    out = out.withColumn("total", total)
    return out.withColumn("score", F.when(good & (F.col("total") >= rules.LEAST_SCORE), F.col("total"))).drop("total")
